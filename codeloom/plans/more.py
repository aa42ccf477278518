"""Queries over symbols with several definitions, ranges, orders and the remaining small operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..operators import align, defs, delta, locate, order, ranges
from ..schema import CAP_RESULTS, LINE, unsigned_order
from . import adapters as A
from .registry import query

# --- several definitions of a symbol: a user's views and clicks are its definitions, purchases its declarations

DEFS_SQL = """defs AS (
    SELECT user_id AS usr, event_id AS ord, event_type || ' ' || props AS name, CAST(event_id % 26 + 1 AS INTEGER) AS kind, CASE WHEN event_id % 3 = 0 THEN event_id * 65536 + 4 END AS spell_p
    FROM events WHERE event_type IN ('view', 'click')
), decls AS (SELECT user_id AS usr, event_id AS ord, event_id * 65536 AS p FROM events WHERE event_type = 'purchase'
), standing AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY usr ORDER BY spell_p IS NULL, CASE WHEN spell_p IS NULL THEN -ord ELSE ord END) AS n FROM defs) WHERE n = 1)"""


def _defs(spark: SparkSession, sf: str) -> DataFrame:
    e = A.table(spark, sf, "events").where("event_type in ('view', 'click')")
    n = F.col("event_id")
    return e.select(F.col("user_id").alias("usr"), n.alias("ord"), F.concat_ws(" ", "event_type", "props").alias("name"), (n % 26 + 1).cast("int").alias("kind"), F.when(n % 3 == 0, n * LINE + 4).alias("spell_p"))


def _decls(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("usr"), F.col("event_id").alias("ord"), (F.col("event_id") * LINE).alias("p"))


@query("prj03_any_def", f"WITH {DEFS_SQL} SELECT usr, ord, name, kind, spell_p FROM standing")
def any_def(spark: SparkSession, sf: str) -> DataFrame:
    return defs.any_def(_defs(spark, sf)).select("usr", "ord", "name", "kind", "spell_p")


@query("prj04_symbol_kind", f"WITH {DEFS_SQL} SELECT usr, min_by(kind, ord) AS kind FROM defs GROUP BY usr")
def symbol_kind(spark: SparkSession, sf: str) -> DataFrame:
    return defs.first_kind(_defs(spark, sf))


@query("prj05_symbol_info", f"WITH {DEFS_SQL} SELECT s.usr, s.name, k.kind FROM standing s JOIN (SELECT usr, min_by(kind, ord) AS kind FROM defs GROUP BY usr) k USING (usr)")
def symbol_info(spark: SparkSession, sf: str) -> DataFrame:
    own = _defs(spark, sf)
    return defs.any_def(own).select("usr", "name").join(defs.first_kind(own), "usr")


@query("prj06_definition_spelling", f"WITH {DEFS_SQL} SELECT usr, min_by(spell_p, ord) FILTER (WHERE spell_p IS NOT NULL) AS spell_p FROM defs GROUP BY usr")
def definition_spelling(spark: SparkSession, sf: str) -> DataFrame:
    return defs.spelling(_defs(spark, sf))


@query("jn12_representatives", f"""WITH {DEFS_SQL}, d AS (SELECT usr, min_by(spell_p, ord) FILTER (WHERE spell_p IS NOT NULL) AS spell_p FROM defs GROUP BY usr), c AS (SELECT usr, min_by(p, ord) AS decl_p FROM decls GROUP BY usr)
    SELECT usr, coalesce(spell_p, decl_p) AS p, spell_p IS NOT NULL AS is_def FROM (SELECT DISTINCT user_id AS usr FROM events) LEFT JOIN d USING (usr) LEFT JOIN c USING (usr) WHERE coalesce(spell_p, decl_p) IS NOT NULL""")
def representatives(spark: SparkSession, sf: str) -> DataFrame:
    ids = A.table(spark, sf, "events").select(F.col("user_id").alias("usr")).distinct()
    return defs.representative(ids, _defs(spark, sf), _decls(spark, sf))


@query("prj02_symbol_names", f"""WITH {DEFS_SQL}, ids AS (SELECT DISTINCT user_id AS usr, CAST(CASE WHEN user_id % 2 = 0 THEN 1 ELSE 3 END AS INTEGER) AS ekind FROM events)
    SELECT i.usr, i.ekind, coalesce(CASE WHEN i.ekind = 1 THEN d.source || '/' || d.doc_id ELSE s.name END, '') AS name FROM ids i LEFT JOIN documents d ON i.ekind = 1 AND d.doc_id = i.usr LEFT JOIN standing s ON s.usr = i.usr""")
def symbol_names(spark: SparkSession, sf: str) -> DataFrame:
    ids = A.table(spark, sf, "events").select(F.col("user_id").alias("usr"), F.when(F.col("user_id") % 2 == 0, 1).otherwise(3).alias("ekind")).distinct()
    files = A.table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"))
    return defs.names_of(ids, files, _defs(spark, sf))


@query("flt12_defined_only", f"WITH {DEFS_SQL} SELECT DISTINCT user_id AS usr FROM events WHERE user_id IN (SELECT usr FROM defs)")
def defined_only(spark: SparkSession, sf: str) -> DataFrame:
    ids = A.table(spark, sf, "events").select(F.col("user_id").alias("usr")).distinct()
    return ids.join(_defs(spark, sf), "usr", "left_semi")


@query("prj01_short_and_qualified", "SELECT p_partkey, substr('void ' || p_brand || '::' || p_name || '(int)', 6, length(p_brand) + 2 + length(p_name)) AS qualified, substr('void ' || p_brand || '::' || p_name || '(int)', 8 + length(p_brand), length(p_name)) AS short FROM part")
def short_and_qualified(spark: SparkSession, sf: str) -> DataFrame:
    """Names as slices of the detailed name by the offsets stored with it."""
    detailed = F.concat(F.lit("void "), "p_brand", F.lit("::"), "p_name", F.lit("(int)"))
    qual, short = F.lit(5), F.length("p_brand") + 7
    own = A.table(spark, sf, "part").select("p_partkey", detailed.alias("d"), qual.alias("q"), short.alias("s"), (F.length("p_brand") + 2 + F.length("p_name")).alias("qn"), F.length("p_name").alias("sn"))
    cut = lambda at, n: F.substr("d", F.col(at) + 1, F.col(n))
    return own.select("p_partkey", cut("q", "qn").alias("qualified"), cut("s", "sn").alias("short"))


@query("prj07_locations", "SELECT doc_id, 'file://' || source || '/' || doc_id || '.' || lang AS uri, 65536 * (doc_id % 50) AS start_p FROM documents")
def locations(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), "lang"))
    return A.table(spark, sf, "documents").select("doc_id", names.to_uri(path).alias("uri"), (F.col("doc_id") % 50 * LINE).alias("start_p"))


@query("prj14_builtin_names", "WITH b(id, name) AS (VALUES (1, 'void'), (2, 'bool'), (3, 'char'), (4, 'int'), (5, 'long'), (6, 'float'), (7, 'double')) SELECT l_orderkey, l_linenumber, coalesce(name, '') AS name, count(*) AS n FROM lineitem LEFT JOIN b ON id = l_linenumber GROUP BY ALL")
def builtin_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of builtin types by a small constant table."""
    table = F.create_map(*[F.lit(x) for pair in enumerate(("void", "bool", "char", "int", "long", "float", "double"), 1) for x in pair])
    own = A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce(F.try_element_at(table, F.col("l_linenumber")), F.lit("")).alias("name"))
    return own.groupBy("l_orderkey", "l_linenumber", "name").agg(F.count("*").alias("n"))


# --- ranges


@query("flt02_point_in_range", f"WITH {A.EVENTS_SQL} SELECT u.event_id, count(*) AS n_covering FROM ev_uses u JOIN ev_scopes s ON s.file_id = u.file_id AND s.start_p <= u.start_p AND u.start_p < s.end_p GROUP BY u.event_id")
def point_in_range(spark: SparkSession, sf: str) -> DataFrame:
    s = A.event_scopes(spark, sf).select(F.col("file_id").alias("s_file"), F.col("start_p").alias("s_start"), F.col("end_p").alias("s_end"))
    on = (F.col("file_id") == F.col("s_file")) & locate.covers(F.col("s_start"), F.col("s_end"), F.col("start_p"))
    return A.event_uses(spark, sf).join(s, on).groupBy("event_id").agg(F.count("*").alias("n_covering"))


OVERLAPS = """SELECT a.scope_id, count(*) FILTER (WHERE a.start_p < b.end_p AND b.start_p < a.end_p) AS n_intersecting, count(*) FILTER (WHERE a.start_p <= b.start_p AND b.end_p <= a.end_p) AS n_included
    FROM ev_scopes a JOIN ev_scopes b ON b.file_id = a.file_id AND b.scope_id <> a.scope_id GROUP BY a.scope_id"""


@query("flt03_range_overlaps", f"WITH {A.EVENTS_SQL} {OVERLAPS}")
def range_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    return ranges.overlap_counts(A.event_scopes(spark, sf))


@query("jn26_quick_fixes", f"""WITH {A.EVENTS_SQL}, d AS (SELECT event_id AS diag_id, file_id, start_p AS d_start, start_p + 3600 AS d_end, start_p + 86400 AS e_start, start_p + 90000 AS e_end FROM ev_uses)
    SELECT s.scope_id, d.diag_id FROM ev_scopes s JOIN d ON d.file_id = s.file_id WHERE (d.d_start < s.end_p AND s.start_p < d.d_end) OR (d.e_start < s.end_p AND s.start_p < d.e_end)""")
def quick_fixes(spark: SparkSession, sf: str) -> DataFrame:
    """Fixes whose diagnostic, or any of whose edits, meets a requested range."""
    p = F.col("start_p")
    edits = F.array(F.struct((p + 86400).alias("start_p"), (p + 90000).alias("end_p")))
    fixes = A.event_uses(spark, sf).select(F.col("event_id").alias("diag_id"), "file_id", p, (p + 3600).alias("end_p"), edits.alias("edits"))
    return ranges.quick_fixes(A.event_scopes(spark, sf), fixes)


@query("jn05_innermost_parent", f"WITH {A.SCOPES_SQL} SELECT * FROM (SELECT c.cursor_id, s.start_p, s.end_p FROM points c JOIN scopes s ON s.file_id = c.file_id AND s.start_p <= c.p AND c.p < s.end_p QUALIFY row_number() OVER (PARTITION BY c.cursor_id ORDER BY s.start_p DESC, s.end_p DESC) = 1)")
def innermost_parent(spark: SparkSession, sf: str) -> DataFrame:
    s = A.scopes(spark, sf).select(F.col("file_id").alias("s_file"), "start_p", "end_p")
    met = A.points(spark, sf).join(s, (F.col("file_id") == F.col("s_file")) & locate.covers(F.col("start_p"), F.col("end_p"), F.col("p")))
    return met.groupBy("cursor_id").agg(F.max(F.struct("start_p", "end_p")).alias("b")).select("cursor_id", "b.*")


@query("jn29_skipped_ranges", f"WITH {A.LINES_SQL} SELECT file_id, line * 65536 AS start_p, (line + 1) * 65536 AS end_p FROM lines WHERE content = ''")
def skipped(spark: SparkSession, sf: str) -> DataFrame:
    line = F.col("line").cast("long")
    return A.lines(spark, sf).where("content = ''").select("file_id", (line * LINE).alias("start_p"), ((line + 1) * LINE).alias("end_p"))


@query("str18_range_size", f"WITH {A.SCOPES_SQL} SELECT file_id, start_p, end_p, scope_id, CASE WHEN start_p // 65536 = end_p // 65536 THEN end_p - start_p ELSE 2147483647 END AS size FROM scopes")
def range_size(spark: SparkSession, sf: str) -> DataFrame:
    return A.scopes(spark, sf).select("file_id", "start_p", "end_p", "scope_id", locate.range_size(F.col("start_p"), F.col("end_p")).alias("size"))


@query("str04_position_offsets", f"""WITH {A.LINES_SQL}, o AS (SELECT file_id, line, coalesce(sum(length(content) + 1) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + least(5, length(content)) AS off FROM lines)
    SELECT file_id, line, off::BIGINT AS char_offset, substr(text, off::BIGINT + 1, 1) AS c FROM o JOIN documents ON doc_id = file_id""")
def position_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Column 5 of every line as an offset into the text, and the character there."""
    before = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    own = A.lines(spark, sf).select("file_id", F.col("line").cast("long").alias("line"), (F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0)) + F.least(F.lit(5), F.length("content"))).alias("char_offset"))
    text = A.table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "text")
    return own.join(text, "file_id").select("file_id", "line", "char_offset", F.substr("text", (F.col("char_offset") + 1).cast("int"), F.lit(1)).alias("c"))


@query("str05_completion_start", f"WITH {A.LINES_SQL} SELECT file_id, line, length(substr(content, 1, 20)) - length(regexp_extract(substr(content, 1, 20), '([A-Za-z0-9_]*)$', 1)) AS start_col FROM lines")
def completion_start(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("content")
    at = F.length(F.substr(c, F.lit(1), F.lit(20))) - F.length(names.identifier_prefix(c, F.lit(20)))
    return A.lines(spark, sf).select("file_id", F.col("line").cast("long").alias("line"), at.cast("long").alias("start_col"))


@query("str11_path_helpers", "SELECT p_partkey, '/lib/' || p_brand || '/' || p_partkey || '.h' AS path, p_brand || '/' AS folder FROM part")
def path_helpers(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.project import absolute

    name = F.concat(F.lit("../"), "p_brand", F.lit("/./x/../"), F.col("p_partkey").cast("string"), F.lit(".h"))
    return A.table(spark, sf, "part").select("p_partkey", absolute(F.lit("/lib/build"), name).alias("path"), names.ensure_slash(F.col("p_brand")).alias("folder"))


@query("str08_comment_text", "SELECT p_partkey, p_name || chr(10) || '  ' || p_brand AS comment FROM part")
def comment_text(spark: SparkSession, sf: str) -> DataFrame:
    """Comments without markers and common indentation."""
    raw = F.concat(F.lit("/** "), "p_name", F.lit("\n *   "), "p_brand", F.lit("\n */"))
    return A.table(spark, sf, "part").select("p_partkey", names.comment_text(raw).alias("comment"))


@query("str20_initializer_hover", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'static ' ELSE '' END || 'int ' || p_name || CASE WHEN p_size < 30 THEN ' = ' || p_size ELSE '' END AS hover FROM part")
def initializer_hover(spark: SparkSession, sf: str) -> DataFrame:
    """A declaration with its storage and, if short, its initializer."""
    text = F.concat(F.lit("int "), "p_name")
    return A.table(spark, sf, "part").select("p_partkey", names.hover_with_initializer(text, F.col("p_size").cast("string"), F.col("p_size"), 30, F.col("p_size") % 2 == 0).alias("hover"))


# --- orders and sets


@query("srt12_unsigned_order", "SELECT p_partkey, row_number() OVER (ORDER BY xor(CAST(p_partkey * 7919 - 500000 AS BIGINT), (-9223372036854775808)::BIGINT)) AS ord FROM part")
def unsigned(spark: SparkSession, sf: str) -> DataFrame:
    """All ids in unsigned order."""
    usr = F.col("p_partkey") * 7919 - 500000
    return order.ranked(A.table(spark, sf, "part").select("p_partkey", unsigned_order(usr).alias("o")), "o").select("p_partkey", "ord")


@query("srt13_folder_order", "SELECT source, row_number() OVER (ORDER BY length(source) DESC, source) AS ord FROM (SELECT DISTINCT source FROM documents)")
def folder_order(spark: SparkSession, sf: str) -> DataFrame:
    """Workspace folders, longest first; there are few."""
    own = A.table(spark, sf, "documents").select("source").distinct()
    return own.select("source", F.row_number().over(Window.orderBy(F.desc(F.length("source")), "source")).cast("long").alias("ord"))


@query("srt03_link_results", f"WITH {A.INCLUDES_SQL}, d AS (SELECT DISTINCT path AS uri, line FROM includes) SELECT uri, line FROM (SELECT *, row_number() OVER (ORDER BY uri, line) AS n FROM d) WHERE n <= 2000")
def link_results(spark: SparkSession, sf: str) -> DataFrame:
    """Links, each place once, in order, up to the cap of a result list."""
    return A.includes(spark, sf).select(F.col("path").alias("uri"), "line").distinct().orderBy("uri", "line").limit(CAP_RESULTS)


@query("srt11_location_order", f"WITH {A.EVENTS_SQL} SELECT file_id, start_p, end_p, row_number() OVER (PARTITION BY file_id ORDER BY start_p, end_p) AS ord FROM (SELECT DISTINCT file_id, start_p, end_p FROM ev_scopes)")
def location_order(spark: SparkSession, sf: str) -> DataFrame:
    own = A.event_scopes(spark, sf).select("file_id", "start_p", "end_p").distinct()
    return own.withColumn("ord", F.row_number().over(Window.partitionBy("file_id").orderBy("start_p", "end_p")).cast("long"))


@query("set01_append", f"WITH {A.UPDATES_SQL} SELECT path, count(*) AS n FROM (SELECT path FROM updates WHERE change = 'create' UNION ALL SELECT path FROM updates WHERE change <> 'delete') GROUP BY path")
def append(spark: SparkSession, sf: str) -> DataFrame:
    own = A.updates(A.table(spark, sf, "events"))
    both = own.where("change = 'create'").select("path").unionByName(own.where("change <> 'delete'").select("path"))
    return both.groupBy("path").agg(F.count("*").alias("n"))


@query("set07_distinct_places", f"WITH {A.CALLS_SQL} SELECT DISTINCT src, dst FROM calls")
def distinct_places(spark: SparkSession, sf: str) -> DataFrame:
    return A.calls(spark, sf).select("src", "dst").dropDuplicates()


@query("set08_intersect", f"WITH {A.CALLS_SQL} SELECT src, dst FROM calls INTERSECT SELECT dst, src FROM calls")
def mutual_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls that are answered the other way: pairs of both sets, each once."""
    own = A.calls(spark, sf)
    return own.select("src", "dst").intersect(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query("agg13_max_name_length", "SELECT p_size, max(length(p_name)) AS longest FROM part GROUP BY p_size")
def longest_name(spark: SparkSession, sf: str) -> DataFrame:
    """The longest name of each group, as a completion list lays out its column."""
    return A.table(spark, sf, "part").groupBy("p_size").agg(F.max(F.length("p_name")).cast("long").alias("longest"))


@query("set04_delete_defs", f"WITH {DEFS_SQL} SELECT usr, count(*) AS n FROM defs WHERE (usr, ord) NOT IN (SELECT usr, ord FROM defs WHERE ord % 4 = 0) GROUP BY usr")
def delete_defs(spark: SparkSession, sf: str) -> DataFrame:
    own = _defs(spark, sf)
    return delta.remove(own, own.where("ord % 4 = 0"), ["usr", "ord"]).groupBy("usr").agg(F.count("*").alias("n"))


@query("jn27_workspace_folders", "SELECT doc_id, CASE WHEN starts_with(source, 'src1') THEN '/home/work' || substr(source, 5) ELSE '/real/' || source END AS path FROM documents")
def workspace_folders(spark: SparkSession, sf: str) -> DataFrame:
    """Paths under a folder's real place are told by the folder's own name; the first folder that fits counts."""
    path = F.concat(F.lit("/real/"), "source")
    return A.table(spark, sf, "documents").select("doc_id", names.under_folder(path, [("/home/work", "/real/src1"), ("/never", "/real/src1")]).alias("path"))


@query("mth03_rainbow", "SELECT p_partkey, p_partkey % least(7, 20) AS rainbow, p_size & 3 AS low_bits, 1 << (p_size % 5) AS modifier FROM part")
def rainbow(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    return A.table(spark, sf, "part").select("p_partkey", F.pmod("p_partkey", F.lit(min(7, 20))).alias("rainbow"), size.bitwiseAND(3).alias("low_bits"), F.call_function("shiftleft", F.lit(1), size % 5).alias("modifier"))


@query("arr01_array_ops", """WITH a AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey)
    SELECT o_custkey, len(l) AS n, l[1] AS first, len(list_filter(l, lambda x: x % 2 = 0)) AS n_even, list_contains(l, 7) AS has_seven, list_sum(l[1:3])::BIGINT AS head_sum FROM a""")
def array_ops(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("l")
    own = A.table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"))
    head = F.aggregate(F.slice(x, 1, 3), F.lit(0).cast("long"), lambda a, v: a + v)
    return own.select("o_custkey", F.size(x).alias("n"), F.get(x, F.lit(0)).alias("first"), F.size(F.filter(x, lambda v: v % 2 == 0)).alias("n_even"), F.array_contains(x, F.lit(7).cast("long")).alias("has_seven"), head.alias("head_sum"))


@query("map01_dependency_maps", "SELECT l_orderkey, count(DISTINCT l_partkey) AS n_deps, max(floor(epoch(l_shipdate)))::BIGINT AS newest FROM lineitem GROUP BY l_orderkey")
def dependency_maps(spark: SparkSession, sf: str) -> DataFrame:
    """Dependencies as a map of path to time; of equal paths the newest time stays."""
    own = A.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max(F.unix_timestamp("l_shipdate")).alias("t"))
    maps = own.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_partkey", "t"))).alias("m"))
    return maps.select("l_orderkey", F.size("m").alias("n_deps"), F.array_max(F.map_values("m")).alias("newest"))


@query("jsn01_json_fields", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("dte01_epoch_seconds", "SELECT o_orderkey, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS seconds FROM orders")
def epoch_seconds(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "orders").select("o_orderkey", F.unix_timestamp("o_orderdate").alias("seconds"))


@query("txt03_range_remap_identity", f"WITH {A.SCOPES_SQL} SELECT file_id, scope_id, start_p, end_p FROM scopes")
def remap_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Without index lines a range stays where it is."""

    def run(pdf):  # noqa: ANN001, ANN202
        out = [align.remap([], [], (s // LINE, s % LINE), (e // LINE, e % LINE)) for s, e in zip(pdf["start_p"].tolist(), pdf["end_p"].tolist(), strict=True)]
        return pdf.assign(start_p=[a * LINE + b for a, b, _, _ in out], end_p=[c * LINE + d for _, _, c, d in out])

    own = A.scopes(spark, sf).select("file_id", "scope_id", "start_p", "end_p")
    return own.mapInPandas(lambda batches: map(run, batches), own.schema)


@query("flt14_completion_available", "SELECT p_partkey FROM part WHERE p_size % 7 <> 0 AND NOT starts_with(p_name, 'operator') AND NOT starts_with(p_name, '~')")
def completion_available(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates that may be offered: accessible ones, no destructors or operators."""
    own = A.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("label"), (F.col("p_size") % 7 != 0).alias("accessible"))
    return names.available(own).select("p_partkey")


@query("flt19_large_file_gate", "SELECT doc_id FROM documents WHERE octet_length(encode(text)) <= 4096")
def large_files(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "documents").where(F.octet_length("text") <= 4096).select("doc_id")


@query("grf14_switch_counterpart", f"""WITH {A.INCLUDES_SQL}, v AS (SELECT i.file_id, p.page_id AS other, count(*) AS n FROM includes i JOIN pages p ON p.url = i.resolved_path AND p.page_id <> i.file_id GROUP BY ALL),
    b AS (SELECT file_id, other FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, other) AS k FROM v) WHERE k = 1),
    f AS (SELECT file_id, min_by(resolved_path, line * 1000 + ord) AS path FROM includes GROUP BY file_id)
    SELECT p.page_id AS file_id, coalesce(o.url, f.path) AS target FROM pages p LEFT JOIN b ON b.file_id = p.page_id LEFT JOIN pages o ON o.page_id = b.other LEFT JOIN f ON f.file_id = p.page_id WHERE coalesce(o.url, f.path) IS NOT NULL""")
def switch(spark: SparkSession, sf: str) -> DataFrame:
    """The counterpart by vote, else the first include."""
    inc = A.includes(spark, sf)
    pages = A.table(spark, sf, "pages").select("page_id", "url")
    votes = inc.join(pages.withColumnsRenamed({"url": "resolved_path", "page_id": "other"}), "resolved_path").where("other <> file_id").groupBy("file_id", "other").agg(F.count("*").alias("n"))
    best = votes.groupBy("file_id").agg(F.max_by("other", F.struct(F.col("n"), -F.col("other"))).alias("other")).join(pages.select(F.col("page_id").alias("other"), F.col("url").alias("voted")), "other")
    first = inc.groupBy("file_id").agg(F.min_by("resolved_path", F.col("line") * 1000 + F.col("ord")).alias("first"))
    met = pages.select(F.col("page_id").alias("file_id")).join(best, "file_id", "left").join(first, "file_id", "left")
    return met.select("file_id", F.coalesce("voted", "first").alias("target")).where("target is not null")
