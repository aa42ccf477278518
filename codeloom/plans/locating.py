"""Queries at positions: symbols, references, definitions, scopes, neighbours, outlines, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import locate, tokens, xref
from ..schema import LINE, OUTLINE_EXCLUDES, ROLE, has_roles
from . import adapters as A
from .registry import query

AT = A.CURSOR_SQL + """, met AS (
    SELECT c.cursor_id, c.p, o.*, row_number() OVER (PARTITION BY c.cursor_id ORDER BY
        CASE WHEN o.start_p // 65536 = o.end_p // 65536 THEN o.end_p - o.start_p ELSE 2147483647 END, o.role & 64 DESC, o.role & 2 DESC, o.ekind DESC,
        xor(o.usr, (-9223372036854775808)::BIGINT), o.start_p, o.role) AS rank
    FROM cursors c JOIN occ o ON o.file_id = c.file_id AND o.start_p <= c.p AND c.p < o.end_p WHERE o.refcnt > 0
), target AS (SELECT cursor_id, usr, ekind FROM met WHERE rank = 1)"""


def _occ(spark: SparkSession, sf: str) -> DataFrame:
    return A.occurrences(spark, sf)


def _targets(spark: SparkSession, sf: str) -> DataFrame:
    return xref.first_symbol(A.cursors(spark, sf), _occ(spark, sf))


@query("jn03_symbols_at_cursor", f"WITH {AT} SELECT cursor_id, usr, ekind, role, start_p, end_p, rank FROM met")
def symbols_at_cursor(spark: SparkSession, sf: str) -> DataFrame:
    return locate.symbols_at(A.cursors(spark, sf), _occ(spark, sf)).select("cursor_id", "usr", "ekind", "role", "start_p", "end_p", "rank")


@query("srt02_smallest_symbols_at_cursor", f"WITH {AT} SELECT m.cursor_id, m.usr, m.ekind, m.rank FROM met m JOIN met f ON f.cursor_id = m.cursor_id AND f.rank = 1 AND f.start_p = m.start_p AND f.end_p = m.end_p AND f.ekind = m.ekind")
def smallest_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return locate.symbols_at(A.cursors(spark, sf), _occ(spark, sf), smallest=True).select("cursor_id", "usr", "ekind", "rank")


REFS = AT + """, places AS (
    SELECT t.cursor_id, o.file_id, o.start_p, o.end_p, min(o.role) AS role FROM target t JOIN occ o USING (usr, ekind)
    WHERE (o.role & $WANT) = $WANT AND (o.role & $WITHOUT) = 0 AND (o.role & 3) = 0 GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY cursor_id ORDER BY file_id, start_p, end_p) AS ord FROM places)"""


def _refs(want: int, without: int) -> str:
    return REFS.replace("$WANT", str(want)).replace("$WITHOUT", str(without))


@query("grf10_references_at_cursor", f"WITH {_refs(0, 0)} SELECT cursor_id, file_id, start_p, end_p, role, ord FROM ranked WHERE ord <= 2000")
def references(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: references of the symbol at a cursor of every document, at most 2000 for each."""
    return xref.references(_targets(spark, sf), _occ(spark, sf), single=True).select("cursor_id", "file_id", "start_p", "end_p", "role", "ord")


@query("flt04_references_by_role", f"WITH {_refs(4, 32)} SELECT cursor_id, file_id, start_p, end_p, role, ord FROM ranked WHERE ord <= 2000")
def references_by_role(spark: SparkSession, sf: str) -> DataFrame:
    return xref.references(_targets(spark, sf), _occ(spark, sf), role=ROLE["reference"], exclude=ROLE["call"], single=True).select("cursor_id", "file_id", "start_p", "end_p", "role", "ord")


@query("jn01_reference_counts", f"WITH {_refs(0, 0)} SELECT cursor_id, count(*) AS n_refs, count(DISTINCT file_id) AS n_files FROM places GROUP BY cursor_id")
def reference_counts(spark: SparkSession, sf: str) -> DataFrame:
    targets = _targets(spark, sf)
    counted = _symbol_places(targets, _occ(spark, sf)).groupBy("usr").agg(F.count("*").alias("n_refs"), F.countDistinct("file_id").alias("n_files"))
    return targets.join(counted, "usr").select("cursor_id", "n_refs", "n_files")


def _symbol_places(targets: DataFrame, occ: DataFrame) -> DataFrame:
    """Places of each target symbol, once however many cursors stand on it."""
    return xref.references(targets.select(F.col("usr").alias("cursor_id"), "usr", "ekind").distinct(), occ, cap=None).withColumnRenamed("cursor_id", "usr")


@query("flt06_references_in_folders", f"""WITH {_refs(0, 0)}
    SELECT p.cursor_id, count(*) AS n FROM places p JOIN documents d ON d.doc_id = p.file_id
    WHERE starts_with(d.source || '/' || d.doc_id || '.' || d.lang, 'src1/') OR starts_with(d.source || '/' || d.doc_id || '.' || d.lang, 'src2/') GROUP BY p.cursor_id""")
def references_in_folders(spark: SparkSession, sf: str) -> DataFrame:
    targets = _targets(spark, sf)
    own = _symbol_places(targets, _occ(spark, sf))
    path = F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), "lang"))
    files = A.table(spark, sf, "documents").where(path.startswith("src1/") | path.startswith("src2/")).select(F.col("doc_id").alias("file_id"))
    counted = own.join(files, "file_id", "left_semi").groupBy("usr").agg(F.count("*").alias("n"))
    return targets.join(counted, "usr").select("cursor_id", "n")


DECLS = """, decls AS (
    SELECT DISTINCT t.cursor_id, o.file_id, o.start_p, o.end_p FROM target t JOIN occ o USING (usr, ekind) JOIN cursors c ON c.cursor_id = t.cursor_id
    WHERE (o.role & 1) = 1 AND (o.role & 2) = 0 AND NOT (o.file_id = c.file_id AND o.start_p <= c.p AND c.p < o.end_p)
)"""


@query("jn15_declarations_except_cursor", f"WITH {AT}{DECLS} SELECT * FROM decls")
def declarations(spark: SparkSession, sf: str) -> DataFrame:
    return xref.declarations_except(_targets(spark, sf), _occ(spark, sf), A.cursors(spark, sf), single=True)


@query("jn16_definition_at_cursor", f"""WITH {AT}{DECLS}, defs AS (
        SELECT t.cursor_id, e.file_id, e.spell_start_p AS start_p, e.spell_end_p AS end_p, (e.file_id = c.file_id AND e.spell_start_p <= c.p AND c.p < e.spell_end_p) AS here
        FROM target t JOIN ents e USING (usr, ekind) JOIN cursors c ON c.cursor_id = t.cursor_id)
    SELECT cursor_id, file_id, start_p, end_p FROM defs WHERE NOT here OR cursor_id NOT IN (SELECT cursor_id FROM decls)
    UNION SELECT * FROM decls WHERE cursor_id IN (SELECT cursor_id FROM defs WHERE here)""")
def definition(spark: SparkSession, sf: str) -> DataFrame:
    occ = _occ(spark, sf)
    return xref.definitions(_targets(spark, sf), A.entities(occ), occ, A.cursors(spark, sf))


@query("srt10_document_highlight", f"""WITH {AT} SELECT m.cursor_id, o.start_p, o.end_p, CASE WHEN o.role & 16 > 0 THEN 3 WHEN o.role & 8 > 0 THEN 2 ELSE 1 END AS hkind, o.role
    FROM (SELECT DISTINCT cursor_id, file_id, usr, ekind FROM met) m JOIN occ o USING (file_id, usr, ekind)""")
def highlight(spark: SparkSession, sf: str) -> DataFrame:
    return xref.highlights(A.cursors(spark, sf), _occ(spark, sf))


@query("grf13_rename_edits", f"WITH {AT} SELECT cursor_id, file_id, count(*) AS n_edits, min(start_p) AS first_p, max(start_p) AS last_p FROM (SELECT DISTINCT t.cursor_id, o.file_id, o.start_p, o.end_p FROM target t JOIN occ o USING (usr, ekind)) GROUP BY ALL")
def rename(spark: SparkSession, sf: str) -> DataFrame:
    occ = _occ(spark, sf)
    return xref.rename_edits(_targets(spark, sf), occ, A.lines(spark, sf), A.entities(occ).select("usr", "name"), single=True)


@query("prj12_hover", f"WITH {AT} SELECT t.cursor_id, e.name, length(e.name) AS n_chars, e.kind FROM target t JOIN ents e USING (usr, ekind)")
def hover(spark: SparkSession, sf: str) -> DataFrame:
    """The longest name of the first symbol's definitions."""
    occ = _occ(spark, sf)
    met = _targets(spark, sf).join(A.entities(occ), ["usr", "ekind"])
    return met.groupBy("cursor_id").agg(F.max_by(F.struct("name", "kind"), F.length("name")).alias("b")).select("cursor_id", "b.name", F.length("b.name").alias("n_chars"), "b.kind")


@query("srt09_best_definition_guess", f"""WITH {AT}, c AS (
        SELECT t.cursor_id, m.file_id AS c_file, m.p // 65536 AS c_line, o.name FROM target t JOIN met m ON m.cursor_id = t.cursor_id AND m.rank = 1 JOIN ents o ON o.usr = t.usr),
    r AS (SELECT c.cursor_id, e.usr, row_number() OVER (PARTITION BY c.cursor_id ORDER BY abs(length(e.name) - length(c.name)), CASE WHEN e.file_id = c.c_file THEN 0 ELSE 1 END,
              abs(e.spell_start_p // 65536 - c.c_line), xor(e.usr, (-9223372036854775808)::BIGINT)) AS n
          FROM c JOIN ents e ON lower(e.name) = lower(c.name))
    SELECT cursor_id, usr FROM r WHERE n = 1""")
def best_guess(spark: SparkSession, sf: str) -> DataFrame:
    occ = _occ(spark, sf)
    ents = A.entities(occ)
    at = locate.symbols_at(A.cursors(spark, sf), occ).where("rank = 1").select("cursor_id", F.col("file_id").alias("c_file"), F.floor(F.col("p") / LINE).alias("c_line"), F.col("name").alias("c_name"))
    met = at.join(ents.withColumn("low", F.lower("name")), F.lower("c_name") == F.col("low"))
    order = F.struct(
        F.abs(F.length("name") - F.length("c_name")), F.when(F.col("file_id") == F.col("c_file"), 0).otherwise(1),
        F.abs(F.floor(F.col("spell_start_p") / LINE) - F.col("c_line")), F.col("usr").bitwiseXOR(F.lit(-(2**63))),
    )
    return met.groupBy("cursor_id").agg(F.min_by("usr", order).alias("usr"))


@query("flt05_document_symbols_flat", f"WITH {A.OCC_SQL} SELECT o.file_id, o.usr, o.start_p, o.role, e.kind FROM occ o JOIN ents e USING (usr, ekind) WHERE (o.role & 444) = 0 AND NOT (e.ekind = 4 AND e.parent_kind IN (6, 9, 12, 254) AND e.storage IN (0, 4, 5)) AND e.kind <> 26")
def document_symbols(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences of an outline: the default roles, without locals and type parameters."""
    occ = _occ(spark, sf)
    ents = A.entities(occ).select("usr", "ekind", "kind", xref.is_local(F.col("parent_kind"), F.col("storage")).alias("local"))
    own = locate.live(occ).where(has_roles(F.col("role"), 0, OUTLINE_EXCLUDES))
    return own.join(ents, ["usr", "ekind"]).where("not (ekind = 4 and local) and kind <> 26").select("file_id", "usr", "start_p", "role", "kind")


@query("flt11_line_window_symbols", f"WITH {A.OCC_SQL} SELECT file_id, usr, start_p FROM occ WHERE start_p // 65536 BETWEEN 1 AND 2 AND (role & 444) = 0")
def line_window(spark: SparkSession, sf: str) -> DataFrame:
    return locate.live(_occ(spark, sf)).where(f"start_p >= {LINE} and start_p < {3 * LINE}").where(has_roles(F.col("role"), 0, OUTLINE_EXCLUDES)).select("file_id", "usr", "start_p")


@query("prj10_folding_ranges", f"WITH {A.OCC_SQL} SELECT DISTINCT file_id, ext_start_p // 65536 AS start_line, ext_end_p // 65536 AS end_line FROM occ WHERE ekind IN (2, 3) AND ext_start_p IS NOT NULL")
def folding(spark: SparkSession, sf: str) -> DataFrame:
    own = locate.live(_occ(spark, sf)).where("ekind in (2, 3) and ext_start_p is not null")
    return own.select("file_id", F.floor(F.col("ext_start_p") / LINE).alias("start_line"), F.floor(F.col("ext_end_p") / LINE).alias("end_line")).distinct()


@query("prj08_location_links", f"WITH {A.OCC_SQL} SELECT usr, file_id, spell_start_p AS sel_start, spell_end_p AS sel_end, CASE WHEN ext_start_p <= spell_start_p AND spell_end_p <= ext_end_p THEN ext_start_p ELSE spell_start_p END AS target_start, CASE WHEN ext_start_p <= spell_start_p AND spell_end_p <= ext_end_p THEN ext_end_p ELSE spell_end_p END AS target_end FROM ents")
def location_links(spark: SparkSession, sf: str) -> DataFrame:
    inside = (F.col("ext_start_p") <= F.col("spell_start_p")) & (F.col("spell_end_p") <= F.col("ext_end_p"))
    pick = lambda a, b: F.when(inside, F.col(a)).otherwise(F.col(b))
    return A.entities(_occ(spark, sf)).select("usr", "file_id", F.col("spell_start_p").alias("sel_start"), F.col("spell_end_p").alias("sel_end"), pick("ext_start_p", "spell_start_p").alias("target_start"), pick("ext_end_p", "spell_end_p").alias("target_end"))


# --- scopes and neighbours


@query("jn04_innermost_scope_docs", f"""WITH {A.OCC_SQL}, {A.SCOPES_SQL.replace(A.LINES_SQL + ', ', '')},
    r AS (SELECT s.file_id, s.start_p, x.scope_id, x.start_p AS scope_start, x.end_p AS scope_end,
              row_number() OVER (PARTITION BY s.file_id, s.start_p ORDER BY x.start_p DESC, x.end_p, xor(x.scope_id, (-9223372036854775808)::BIGINT)) AS n
          FROM occ s JOIN scopes x ON x.file_id = s.file_id AND x.start_p <= s.start_p AND s.end_p <= x.end_p WHERE s.ekind = 3 AND s.role & 32 > 0)
    SELECT file_id, start_p, scope_id, scope_start, scope_end FROM r WHERE n = 1""")
def innermost_docs(spark: SparkSession, sf: str) -> DataFrame:
    """The innermost scope of each call; scopes are binned by blocks of eight lines."""
    uses = locate.live(_occ(spark, sf)).where("ekind = 3 and role & 32 > 0").select("file_id", "start_p", "end_p")
    return locate.scope_of(uses, A.scopes(spark, sf), ["file_id", "start_p"], bin_size=8 * LINE)


@query("jn04_innermost_scope_events", f"""WITH {A.EVENTS_SQL}, r AS (
        SELECT u.event_id, x.scope_id, x.start_p AS scope_start, x.end_p AS scope_end, row_number() OVER (PARTITION BY u.event_id ORDER BY x.start_p DESC, x.end_p, x.scope_id) AS n
        FROM ev_uses u JOIN ev_scopes x ON x.file_id = u.file_id AND x.start_p <= u.start_p AND u.end_p <= x.end_p)
    SELECT event_id, scope_id, scope_start, scope_end FROM r WHERE n = 1""")
def innermost_events(spark: SparkSession, sf: str) -> DataFrame:
    return locate.scope_of(A.event_uses(spark, sf), A.event_scopes(spark, sf), ["event_id"])


def _nav(direction: str):  # noqa: ANN202
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return locate.navigate(A.points(spark, sf), A.scopes(spark, sf), direction).select("cursor_id", "start_p", "end_p")

    return run


NAV = A.SCOPES_SQL + """, par AS (SELECT * FROM (
        SELECT c.cursor_id, s.start_p AS par_start, s.end_p AS par_end, row_number() OVER (PARTITION BY c.cursor_id ORDER BY s.start_p DESC, s.end_p DESC) AS n
        FROM points c JOIN scopes s ON s.file_id = c.file_id AND s.start_p <= c.p AND c.p < s.end_p) WHERE n = 1),
    cand AS (SELECT c.cursor_id, c.p, s.start_p, s.end_p, par_start, par_end,
        CASE WHEN par_start // 65536 = c.p // 65536 THEN par_end - CASE WHEN par_end % 65536 > 0 THEN 1 ELSE 0 END ELSE c.p END AS from_p
        FROM points c JOIN scopes s ON s.file_id = c.file_id LEFT JOIN par USING (cursor_id))
    SELECT cursor_id, start_p, end_p FROM (SELECT *, row_number() OVER (PARTITION BY cursor_id ORDER BY $ORDER) AS n FROM cand WHERE $WHERE) WHERE n = 1"""
for _name, _direction, _order, _where in (
    ("jn08_navigate_down", "D", "start_p, end_p DESC", "start_p > p AND (par_end IS NULL OR end_p <= par_end)"),
    ("jn06_navigate_left", "L", "end_p DESC, start_p", "end_p <= p"),
    ("jn07_navigate_right", "R", "start_p, end_p DESC", "start_p > from_p"),
    ("jn09_navigate_up", "U", "start_p DESC, end_p DESC", "start_p < p AND p < end_p"),
):
    query(_name, "WITH " + NAV.replace("$ORDER", _order).replace("$WHERE", _where))(_nav(_direction))


@query("win03_outline_parents", f"""WITH {A.SCOPES_SQL}, r AS (
        SELECT c.file_id, c.scope_id, p.scope_id AS parent, row_number() OVER (PARTITION BY c.file_id, c.scope_id ORDER BY p.start_p DESC, p.end_p, p.scope_id DESC) AS n
        FROM scopes c LEFT JOIN scopes p ON p.file_id = c.file_id AND p.scope_id <> c.scope_id AND p.start_p <= c.start_p AND p.end_p > c.start_p
             AND (p.start_p, -p.end_p, p.scope_id) < (c.start_p, -c.end_p, c.scope_id))
    SELECT file_id, scope_id, parent FROM r WHERE n = 1""")
def outline(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.outline_parents(A.scopes(spark, sf))


@query("win01_token_delta_encoding", f"""WITH {A.OCC_SQL} SELECT file_id, start_p, start_p // 65536 - lag(start_p // 65536, 1, 0) OVER w AS d_line,
        start_p % 65536 - CASE WHEN start_p // 65536 = lag(start_p // 65536, 1, 0) OVER w THEN lag(start_p % 65536, 1, 0) OVER w ELSE 0 END AS d_col, end_p - start_p AS len, role
    FROM occ WINDOW w AS (PARTITION BY file_id ORDER BY start_p)""")
def token_deltas(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.delta_encode(locate.live(_occ(spark, sf))).select("file_id", "start_p", "d_line", "d_col", "len", "role")


@query("agg05_symbol_groups", f"WITH {A.OCC_SQL} SELECT file_id, usr, count(*) AS n_ranges, min(start_p) AS first_p, max(start_p) AS last_p, bit_or(role) AS roles FROM occ GROUP BY file_id, usr")
def symbol_groups(spark: SparkSession, sf: str) -> DataFrame:
    own = locate.live(_occ(spark, sf)).groupBy("file_id", "usr")
    return own.agg(F.count("*").alias("n_ranges"), F.min("start_p").alias("first_p"), F.max("start_p").alias("last_p"), F.bit_or("role").alias("roles"))


@query("win02_disjoint_tokens", f"""WITH {A.EVENTS_SQL}, s AS (SELECT file_id, start_p, end_p, scope_id FROM ev_scopes WHERE end_p > start_p),
    b AS (SELECT DISTINCT file_id, x FROM (SELECT file_id, start_p AS x FROM s UNION ALL SELECT file_id, end_p FROM s)),
    seg AS (SELECT file_id, x AS lo, lead(x) OVER (PARTITION BY file_id ORDER BY x) AS hi FROM b),
    r AS (SELECT g.file_id, g.lo, g.hi, s.scope_id, row_number() OVER (PARTITION BY g.file_id, g.lo ORDER BY s.end_p - s.start_p, s.start_p DESC, s.scope_id) AS n
          FROM seg g JOIN s ON s.file_id = g.file_id AND s.start_p <= g.lo AND g.hi <= s.end_p WHERE g.hi IS NOT NULL)
    SELECT file_id, lo, hi, scope_id FROM r WHERE n = 1""")
def disjoint(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.disjoint_segments(A.event_scopes(spark, sf).where("end_p > start_p"))


@query("mth02_semantic_tokens", f"""WITH {A.OCC_SQL} SELECT usr, CASE WHEN kind = 254 THEN 6 WHEN kind >= 252 THEN kind - 225 ELSE kind END AS token_type,
        usr % 20 AS rainbow, CASE WHEN storage = 2 THEN 1 ELSE 0 END | CASE WHEN ekind = 3 THEN 2 ELSE 0 END | CASE WHEN parent_kind IN (6, 12) THEN 4 ELSE 0 END AS modifiers FROM ents""")
def semantic_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_types(A.entities(_occ(spark, sf)))


@query("agg02_db_info", f"WITH {A.OCC_SQL} SELECT (SELECT count(*) FROM documents) AS files, count(*) FILTER (WHERE ekind = 3) AS funcs, count(*) FILTER (WHERE ekind = 2) AS types, count(*) FILTER (WHERE ekind = 4) AS vars FROM ents")
def db_info(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda k: F.count(F.when(F.col("ekind") == k, 1))
    own = A.entities(_occ(spark, sf)).agg(n(3).alias("funcs"), n(2).alias("types"), n(4).alias("vars"))
    files = A.table(spark, sf, "documents").agg(F.count("*").alias("files"))
    return files.join(own, F.lit(True)).select("files", "funcs", "types", "vars")  # one row each


@query("prj09_file_info", """SELECT doc_id AS file_id, source || '/' || doc_id || '.' || lang AS path, CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 ELSE 3 END AS language,
    len(string_split(text, chr(10))) AS n_lines, octet_length(encode(text)) <= 2097152 AS highlighted FROM documents""")
def file_info(spark: SparkSession, sf: str) -> DataFrame:
    lang = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).when(F.col("lang") == "fr", 2).otherwise(3)
    path = F.concat_ws("/", "source", F.concat_ws(".", F.col("doc_id").cast("string"), "lang"))
    return A.table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), path.alias("path"), lang.alias("language"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), (F.octet_length("text") <= 2097152).alias("highlighted"))


@query("jn02_all_occurrences", f"""WITH {A.OCC_SQL} SELECT usr, ekind, 'use' AS part, count(*) AS n FROM occ WHERE (role & 3) = 0 GROUP BY ALL
    UNION ALL SELECT usr, ekind, 'spell', count(*) FROM occ WHERE role & 2 > 0 GROUP BY ALL UNION ALL SELECT usr, ekind, 'declaration', count(*) FROM occ WHERE role & 1 > 0 GROUP BY ALL""")
def all_occurrences(spark: SparkSession, sf: str) -> DataFrame:
    part = F.when(F.col("role").bitwiseAND(2) > 0, "spell").when(F.col("role").bitwiseAND(1) > 0, "declaration").otherwise("use")
    return _occ(spark, sf).groupBy("usr", "ekind", part.alias("part")).agg(F.count("*").alias("n"))


@query("flt08_locals", f"WITH {A.OCC_SQL} SELECT usr, file_id, kind, parent_kind, storage, (parent_kind IN (6, 9, 12, 254) AND storage IN (0, 4, 5)) AS is_local FROM ents WHERE ekind = 4")
def locals_(spark: SparkSession, sf: str) -> DataFrame:
    return A.entities(_occ(spark, sf)).where("ekind = 4").select("usr", "file_id", "kind", "parent_kind", "storage", xref.is_local(F.col("parent_kind"), F.col("storage")).alias("is_local"))


@query("flt10_variable_kinds", f"WITH {A.OCC_SQL} SELECT usr, kind FROM ents WHERE ekind = 4 AND (CASE kind WHEN 8 THEN 1 WHEN 13 THEN 2 WHEN 253 THEN 4 ELSE 7 END & 5) > 0")
def variable_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Fields and parameters; variables of any other kind always pass."""
    bit = F.when(F.col("kind") == 8, 1).when(F.col("kind") == 13, 2).when(F.col("kind") == 253, 4).otherwise(7)
    return A.entities(_occ(spark, sf)).where("ekind = 4").where(bit.bitwiseAND(5) > 0).select("usr", "kind")


@query("flt13_highlightable_names", f"""WITH {A.OCC_SQL} SELECT o.file_id, count(*) AS n FROM occ o JOIN ents e USING (usr, ekind) WHERE e.ekind = 3 AND NOT starts_with(e.name, 'operator') GROUP BY o.file_id""")
def highlightable(spark: SparkSession, sf: str) -> DataFrame:
    """Function occurrences whose name stands at its place in the line."""
    occ = locate.live(_occ(spark, sf)).where("ekind = 3")
    words = A.lines(spark, sf).select("file_id", F.col("line").cast("long").alias("line"), F.array_remove(F.split("content", " "), "").alias("words"))
    met = occ.withColumn("line", F.floor(F.col("start_p") / LINE)).join(words, ["file_id", "line"])
    return met.where((F.get("words", F.pmod("start_p", F.lit(LINE)).cast("int")) == F.col("name")) & ~F.col("name").startswith("operator")).groupBy("file_id").agg(F.count("*").alias("n"))


@query("win05_code_point_offsets", f"WITH {A.LINES_SQL} SELECT file_id, line, coalesce(sum(length(content) + 1) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset FROM lines")
def offsets(spark: SparkSession, sf: str) -> DataFrame:
    before = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return A.lines(spark, sf).select("file_id", F.col("line").cast("long").alias("line"), F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0)).alias("start_offset"))
