"""Queries over names, paths, text versions, updates and deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import fuzzy, names
from ..operators import align, delta, order
from ..schema import CAP_COMPLETION, CAP_SYMBOLS, LINE
from . import adapters as A
from .registry import query

# --- versions


@query("jn28_unique_line_match", f"""WITH {A.VERSIONS_SQL}, a AS (SELECT file_id, content, min(line) AS index_line FROM index_lines GROUP BY ALL HAVING count(*) = 1),
    b AS (SELECT file_id, content, min(line) AS buffer_line FROM buffer_lines GROUP BY ALL HAVING count(*) = 1) SELECT file_id, index_line, buffer_line FROM a JOIN b USING (file_id, content)""")
def unique_lines(spark: SparkSession, sf: str) -> DataFrame:
    return align.unique_matches(*A.versions(spark, sf))


@query("txt01_line_map")
def line_map(spark: SparkSession, sf: str) -> DataFrame:
    """Unique matches spread to their neighbours; tested against a fold over the lines."""
    return align.line_maps(*A.versions(spark, sf))


@query("str06_split_lines", "SELECT doc_id, CAST(len(l) - CASE WHEN l[len(l)] = '' THEN 1 ELSE 0 END AS BIGINT) AS n_lines FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def split_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines without a trailing empty one."""
    parts = F.split("text", "\n")
    return A.table(spark, sf, "documents").select("doc_id", (F.size(parts) - (F.element_at(parts, -1) == "").cast("int")).cast("long").alias("n_lines"))


# --- names and ranking

ENTITY_SQL = """names AS (SELECT 3 AS ekind, p_partkey AS id, p_name AS name, p_brand AS container FROM part UNION ALL SELECT 2, c_custkey, c_name, c_mktsegment FROM customer UNION ALL SELECT 4, s_suppkey, s_name, 'suppliers' FROM supplier)"""


def _names(spark: SparkSession, sf: str) -> DataFrame:
    one = lambda t, k, i, n, c: A.table(spark, sf, t).select(F.lit(k).alias("ekind"), F.col(i).alias("id"), F.col(n).alias("name"), c.alias("container"))
    parts = one("part", 3, "p_partkey", "p_name", F.col("p_brand")), one("customer", 2, "c_custkey", "c_name", F.col("c_mktsegment")), one("supplier", 4, "s_suppkey", "s_name", F.lit("suppliers"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("str01_symbol_subsequence", f"WITH {ENTITY_SQL} SELECT ekind, id, name FROM names WHERE regexp_matches(name, '(?is)c.*m.*7.*3')")
def subsequence(spark: SparkSession, sf: str) -> DataFrame:
    return _names(spark, sf).where(F.col("name").rlike(names.subsequence_pattern("cm73"))).select("ekind", "id", "name")


def _first(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` in order of functions, types, variables and their ids: the limit comes before the ranking."""
    order = F.when(F.col("ekind") == 3, 0).when(F.col("ekind") == 2, 1).otherwise(2)
    return rows.orderBy(order, "id").limit(most)


@query("srt05_workspace_symbol_candidates", f"WITH {ENTITY_SQL} SELECT ekind, id, name FROM (SELECT *, row_number() OVER (ORDER BY CASE ekind WHEN 3 THEN 0 WHEN 2 THEN 1 ELSE 2 END, id) AS n FROM names WHERE regexp_matches(name, '(?is)r.*1')) WHERE n <= 1000")
def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _first(_names(spark, sf).where(F.col("name").rlike(names.subsequence_pattern("r1"))), CAP_SYMBOLS).select("ekind", "id", "name")


@query("srt05_workspace_symbol_ranked")
def workspace_symbol(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates up to the cap, scored, best first. The score has no SQL twin; its ranking is tested."""
    own = _first(_names(spark, sf).where(F.col("name").rlike(names.subsequence_pattern("Cus7"))), CAP_SYMBOLS)
    scored = own.withColumn("score", fuzzy.score("Cus7", F.col("name"), 1)).where(F.col("score") > fuzzy.MIN_SCORE)
    return scored.orderBy(F.desc("score"), "ekind", "name", "id").select("ekind", "id", "name", "score")


@query("srt06_completion_ranked")
def completion(spark: SparkSession, sf: str) -> DataFrame:
    """Fuzzy filter, then by edits, score, priority and label; capped."""
    own = _names(spark, sf).withColumn("priority", (F.col("id") % 5).cast("int")).withColumn("score", fuzzy.score("su1", F.col("name"), 0)).where(F.col("score") > fuzzy.MIN_SCORE)
    return own.orderBy(F.desc("score"), "priority", "name", "ekind", "id").limit(CAP_COMPLETION).select("name", "priority", "score")


@query("srt07_signature_order", "SELECT p_partkey, row_number() OVER (ORDER BY p_size, length(p_name), p_name, p_partkey) AS ord FROM part")
def signature_order(spark: SparkSession, sf: str) -> DataFrame:
    """Signatures by number of parameters, length and text."""
    own = A.table(spark, sf, "part").withColumn("chars", F.length("p_name"))
    return order.ranked(own, "p_size", "chars", "p_name", "p_partkey").select("p_partkey", "ord")


@query("win04_sort_keys", "SELECT p_partkey, chr(32 + CAST(p_partkey // 35937 % 33 AS INTEGER)) || chr(32 + CAST(p_partkey // 1089 % 33 AS INTEGER)) || chr(32 + CAST(p_partkey // 33 % 33 AS INTEGER)) || chr(32 + CAST(p_partkey % 33 AS INTEGER)) AS sort_key FROM part")
def sort_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Four digits of base 33 from the blank on."""
    n = F.col("p_partkey")
    return A.table(spark, sf, "part").select("p_partkey", F.concat(*[F.char(F.lit(32) + (F.floor(n / 33**k) % 33)) for k in (3, 2, 1, 0)]).alias("sort_key"))


# --- strings and paths

PATH = "source || '/' || lang || ' lib/f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.cc' WHEN 1 THEN '.h' WHEN 2 THEN '.mm' ELSE '' END"


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("doc_id") % 4
    ext = F.when(n == 0, ".cc").when(n == 1, ".h").when(n == 2, ".mm").otherwise("")
    return A.table(spark, sf, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit(" lib/f"), F.col("doc_id").cast("string"), ext).alias("path"))


@query("str10_uri_encode", "SELECT page_id, 'file://' || " + "replace(" * 11 + "url" + "".join(f", '{a}', '{b}')" for a, b in names.URI_ESCAPES) + " AS uri FROM pages")
def uri_encode(spark: SparkSession, sf: str) -> DataFrame:
    return A.table(spark, sf, "pages").select("page_id", names.to_uri(F.col("url")).alias("uri"))


@query("str10_uri_round_trip", f"SELECT doc_id, {PATH} AS path FROM documents")
def uri_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select("doc_id", names.from_uri(names.to_uri(F.col("path"))).alias("path"))


@query("str12_path_mapping", f"WITH p AS (SELECT doc_id, {PATH} AS path FROM documents) SELECT doc_id, CASE WHEN strpos(path, 'src1') > 0 THEN substr(path, 1, strpos(path, 'src1') - 1) || 'lib' || substr(path, strpos(path, 'src1') + 4) ELSE path END AS path FROM p")
def path_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select("doc_id", names.map_path(F.col("path"), ["src1>lib"]).alias("path"))


@query("str13_path_parts", f"WITH p AS (SELECT doc_id, {PATH} AS path FROM documents) SELECT doc_id, regexp_extract(path, '([^/]*?)(\\.[^./]*)?/?$', 1) AS stem, regexp_extract(path, '\\.([^./]+)$', 1) AS ext, regexp_extract(path, '^(.*)/[^/]*$', 1) AS parent FROM p")
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, sf).select("doc_id", names.stem(p).alias("stem"), names.extension(p).alias("ext"), names.parent(p).alias("parent"))


@query("src16_extension_language", f"WITH p AS (SELECT doc_id, {PATH} AS path FROM documents) SELECT doc_id, CASE WHEN ends_with(path, '.cc') THEN 1 WHEN ends_with(path, '.h') THEN 0 WHEN ends_with(path, '.mm') THEN 3 ELSE -1 END AS language, ends_with(path, '.h') AS is_header FROM p")
def extension_language(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select("doc_id", names.language(F.col("path")).alias("x")).select("doc_id", "x.language", "x.is_header")


@query("src08_cache_names", f"WITH p AS (SELECT doc_id, {PATH} AS path FROM documents) SELECT doc_id, replace(replace(path, '/', '@'), ':', '@') AS cache_name FROM p")
def cache_names(spark: SparkSession, sf: str) -> DataFrame:
    return _paths(spark, sf).select("doc_id", names.cache_name(F.col("path")).alias("cache_name"))


@query("flt07_group_match", f"WITH p AS (SELECT doc_id, {PATH} AS path FROM documents) SELECT doc_id, regexp_matches(path, '(?i)SRC1/') OR NOT regexp_matches(path, '(?i)(?:^src1)|(?:\\.mm$)') AS matches FROM p")
def group_match(spark: SparkSession, sf: str) -> DataFrame:
    """Allowed patterns win over denied ones."""
    return _paths(spark, sf).select("doc_id", names.group_match(F.col("path"), ["SRC1/"], ["^src1", r"\.mm$"]).alias("matches"))


@query("jn22_longest_prefix", f"""WITH p AS (SELECT doc_id, {PATH} AS path FROM documents), f AS (SELECT DISTINCT source || '/' AS folder FROM documents UNION SELECT DISTINCT source || '/' || lang || ' lib/' FROM documents WHERE lang IN ('en', 'fr'))
    SELECT doc_id, max_by(folder, length(folder)) AS folder FROM p JOIN f ON starts_with(path, folder) GROUP BY doc_id""")
def longest_prefix(spark: SparkSession, sf: str) -> DataFrame:
    """The deepest configured folder above a path: ancestors are exploded, so that the join has an equality key."""
    docs = A.table(spark, sf, "documents")
    folders = docs.select(F.concat("source", F.lit("/")).alias("folder")).union(docs.where("lang in ('en', 'fr')").select(F.concat("source", F.lit("/"), "lang", F.lit(" lib/")))).distinct()
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    own = _paths(spark, sf).where(F.instr("path", "/") > 0).select("doc_id", F.explode(ancestors).alias("folder"))
    return own.join(folders, "folder").groupBy("doc_id").agg(F.max_by("folder", F.length("folder")).alias("folder"))


@query("str07_anonymous_names", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '(anon ns)::' || p_name WHEN 1 THEN '(anon)::' || p_name ELSE p_name END AS name FROM part")
def anonymous(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey") % 3
    full = F.when(n == 0, F.concat(F.lit("(anonymous namespace)::"), "p_name")).when(n == 1, F.concat(F.lit("(anonymous struct)::"), "p_name")).otherwise(F.col("p_name"))
    return A.table(spark, sf, "part").select("p_partkey", names.simplify_anonymous(full).alias("name"))


@query("str14_position_codecs", f"WITH {A.TOKENS_SQL} SELECT file_id, count(*) AS n, sum(start_p)::BIGINT AS total, max((line + 1) || ':' || (col + 1)) AS last FROM sited GROUP BY file_id")
def position_codecs(spark: SparkSession, sf: str) -> DataFrame:
    """Positions written as text and read again."""
    own = A.tokens(spark, sf).select("file_id", names.format_position(F.col("start_p")).alias("text"))
    return own.groupBy("file_id").agg(F.count("*").alias("n"), F.sum(names.parse_position(F.col("text"))).alias("total"), F.max("text").alias("last"))


@query("str03_identifier_at", f"WITH {A.LINES_SQL} SELECT file_id, line, regexp_extract(substr(content, 1, 12), '([A-Za-z0-9_]*)$', 1) || regexp_extract(substr(content, 13), '^([A-Za-z0-9_]*)', 1) AS name FROM lines")
def identifier_at(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("content")
    after = F.regexp_extract(F.substr(c, F.lit(13)), "^([A-Za-z0-9_]*)", 1)
    return A.lines(spark, sf).select("file_id", F.col("line").cast("long").alias("line"), F.concat(names.identifier_prefix(c, F.lit(12)), after).alias("name"))


@query("mth01_zigzag", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_id * 2 ELSE event_id * 2 - 1 END AS z FROM events")
def zigzag(spark: SparkSession, sf: str) -> DataFrame:
    n = F.when(F.col("event_id") % 2 == 0, F.col("event_id")).otherwise(-F.col("event_id"))
    return A.table(spark, sf, "events").select("event_id", names.zigzag(n).alias("z"))


# --- updates and deltas


def _updates(spark: SparkSession, sf: str) -> DataFrame:
    return A.updates(A.table(spark, sf, "events"))


ACCEPTED = f"""WITH {A.UPDATES_SQL}, u AS (SELECT *, max(ts * 10 + step) OVER (PARTITION BY path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM updates)
    SELECT seq, path, ts, step FROM u WHERE last IS NULL OR ts * 10 + step > last"""


@query("stm02_monotone_stamp", ACCEPTED)
def monotone(spark: SparkSession, sf: str) -> DataFrame:
    return delta.accepted(_updates(spark, sf)).select("seq", "path", "ts", "step")


@query("stm04_keep_latest", f"WITH {A.UPDATES_SQL} SELECT * FROM (SELECT path, seq, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS age FROM updates) WHERE age <= 3")
def keep_latest(spark: SparkSession, sf: str) -> DataFrame:
    return delta.keep_newest(_updates(spark, sf), 3).select("path", "seq", "age")


@query("stm03_lane_order", f"WITH {A.UPDATES_SQL} SELECT path, seq, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN step = 3 THEN 0 ELSE 1 END, seq) AS ord FROM updates")
def lane_order(spark: SparkSession, sf: str) -> DataFrame:
    """Interactive requests before background ones, each lane in order of arrival."""
    w = Window.partitionBy("path").orderBy(F.when(F.col("step") == 3, 0).otherwise(1), "seq")
    return _updates(spark, sf).select("path", "seq", F.row_number().over(w).cast("long").alias("ord"))


@query("stm06_request_wait_join", f"""WITH {A.UPDATES_SQL}, r AS (SELECT seq AS req_id, path, "at" AS t FROM updates WHERE step = 0)
    SELECT req_id, min(u."at") AS answered_at, min(u."at") IS NULL AS overdue FROM r LEFT JOIN updates u ON u.step = 2 AND u.path = r.path AND u."at" BETWEEN r.t AND r.t + 86400 GROUP BY req_id""")
def request_wait(spark: SparkSession, sf: str) -> DataFrame:
    own = _updates(spark, sf)
    return delta.answered(own.where("step = 0").select(F.col("seq").alias("req_id"), "path", "at"), own.where("step = 2"), 86400).select("req_id", "answered_at", "overdue")


@query("stm07_debounce")
def debounce(spark: SparkSession, sf: str) -> DataFrame:
    """Runs that are scheduled when a change within an hour of a pending run adds none; tested against a fold."""
    return delta.debounced(_updates(spark, sf).where("change = 'change'"), 3600).select("path", "seq", "at")


@query("stm10_watch_events", f"WITH {A.UPDATES_SQL} SELECT path, max_by(change, seq) AS last_change, count(*) FILTER (WHERE change = 'delete') AS n_deleted, count(*) AS n FROM updates GROUP BY path")
def watch_events(spark: SparkSession, sf: str) -> DataFrame:
    own = _updates(spark, sf).groupBy("path")
    return own.agg(F.max_by("change", "seq").alias("last_change"), F.count(F.when(F.col("change") == "delete", 1)).alias("n_deleted"), F.count("*").alias("n"))


@query("stm13_load_counter", f"WITH {A.UPDATES_SQL} SELECT path, count(*) AS loads, count(*) >= 5 AS retained FROM updates WHERE change <> 'delete' GROUP BY path")
def load_counter(spark: SparkSession, sf: str) -> DataFrame:
    return _updates(spark, sf).where("change <> 'delete'").groupBy("path").agg(F.count("*").alias("loads"), (F.count("*") >= 5).alias("retained"))


@query("agg07_directory_priority", f"WITH {A.UPDATES_SQL} SELECT path % 10 AS folder, sum(CASE WHEN path % 3 = 0 THEN 524288 ELSE 262144 END)::BIGINT AS priority FROM (SELECT DISTINCT path FROM updates WHERE change = 'create') GROUP BY ALL")
def directory_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Open files raise their folders by 2^20 halved for each level."""
    open_ = _updates(spark, sf).where("change = 'create'").select("path").distinct()
    depth = F.when(F.col("path") % 3 == 0, 1).otherwise(2)
    return open_.groupBy((F.col("path") % 10).alias("folder")).agg(F.sum(F.call_function("shiftright", F.lit(1 << 20), depth)).alias("priority"))


@query("agg01_occurrence_refcount", f"WITH {A.OCC_SQL} SELECT usr, ekind, role, count(*) AS refcnt, count(DISTINCT file_id) AS n_files FROM occ GROUP BY ALL")
def occurrence_refcount(spark: SparkSession, sf: str) -> DataFrame:
    own = A.occurrences(spark, sf).withColumn("delta", F.lit(1))
    counted = delta.refcount(own)
    return counted.groupBy("usr", "ekind", "role").agg(F.sum("refcnt").alias("refcnt"), F.countDistinct("file_id").alias("n_files"))


DELTA_SQL = f"""{A.VERSIONS_SQL}, signed AS (SELECT file_id, content, -1 AS delta FROM index_lines UNION ALL SELECT file_id, content, 1 FROM buffer_lines),
    d AS (SELECT file_id, content, sum(delta)::BIGINT AS delta FROM signed GROUP BY ALL HAVING sum(delta) <> 0)"""


@query("set05_delta_create", f"WITH {DELTA_SQL} SELECT file_id, count(*) FILTER (WHERE delta > 0) AS added, count(*) FILTER (WHERE delta < 0) AS removed, sum(abs(delta))::BIGINT AS weight FROM d GROUP BY file_id")
def delta_create(spark: SparkSession, sf: str) -> DataFrame:
    before, after = A.versions(spark, sf)
    own = delta.create(before, after, ("file_id", "content")).groupBy("file_id")
    return own.agg(F.count(F.when(F.col("delta") > 0, 1)).alias("added"), F.count(F.when(F.col("delta") < 0, 1)).alias("removed"), F.sum(F.abs("delta")).alias("weight"))


@query("set06_delta_apply", f"WITH {A.VERSIONS_SQL} SELECT file_id, content, count(*) AS refcnt FROM buffer_lines GROUP BY ALL")
def delta_apply(spark: SparkSession, sf: str) -> DataFrame:
    """The old state and the delta give the new one."""
    before, after = A.versions(spark, sf)
    key = ("file_id", "content")
    state = before.groupBy(*key).agg(F.count("*").alias("refcnt"))
    return delta.apply(state, delta.create(before, after, key), key).select("file_id", "content", "refcnt")


@query("set06_delta_to_empty", "SELECT CAST(0 AS BIGINT) AS left_over, count(DISTINCT doc_id) AS files FROM documents WHERE text IS NOT NULL")
def delta_to_empty(spark: SparkSession, sf: str) -> DataFrame:
    """Deleting is the delta to nothing: no row is left."""
    before, _ = A.versions(spark, sf)
    key = ("file_id", "content")
    state = before.groupBy(*key).agg(F.count("*").alias("refcnt"))
    left = delta.apply(state, delta.create(before, before.limit(0), key), key).agg(F.count("*").alias("left_over"))
    return left.join(before.agg(F.countDistinct("file_id").alias("files")), F.lit(True))  # one row each


@query("set02_set_removal", f"WITH {A.VERSIONS_SQL} SELECT file_id, content, count(*) AS n FROM index_lines WHERE (file_id, content) NOT IN (SELECT file_id, content FROM index_lines WHERE line % 2 = 0) GROUP BY ALL")
def set_removal(spark: SparkSession, sf: str) -> DataFrame:
    index, _ = A.versions(spark, sf)
    return delta.remove(index, index.where("line % 2 = 0"), ["file_id", "content"]).groupBy("file_id", "content").agg(F.count("*").alias("n"))


@query("set03_upsert_defs", f"WITH {A.UPDATES_SQL}, o AS (SELECT path, ts FROM updates WHERE change = 'create'), n AS (SELECT DISTINCT path, CAST(-1 AS BIGINT) AS ts FROM updates WHERE change = 'delete') SELECT path, ts, count(*) AS n FROM (SELECT * FROM o WHERE path NOT IN (SELECT path FROM n) UNION ALL SELECT * FROM n) GROUP BY ALL")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    own = _updates(spark, sf)
    new = own.where("change = 'delete'").select("path", F.lit(-1).cast("long").alias("ts")).distinct()
    return delta.upsert(own.where("change = 'create'").select("path", "ts"), new, ["path"]).groupBy("path", "ts").agg(F.count("*").alias("n"))


@query("agg11_global_merge", f"WITH {A.UPDATES_SQL} SELECT path, max_by(seq, seq) AS seq, max_by(step, seq) AS step FROM updates GROUP BY path")
def global_merge(spark: SparkSession, sf: str) -> DataFrame:
    return delta.latest(_updates(spark, sf).select("path", "seq", "step"), ["path"], ["seq"])


@query("agg10_index_build", f"""WITH {A.OCC_SQL} SELECT file_id, usr, count(*) FILTER (WHERE (role & 3) = 0) AS n_uses, count(*) FILTER (WHERE role & 1 > 0) AS n_decls, min(CASE WHEN role & 2 > 0 THEN start_p END) AS spell_p FROM occ GROUP BY file_id, usr""")
def index_build(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences folded into one record for each file and symbol."""
    role = F.col("role")
    own = A.occurrences(spark, sf).groupBy("file_id", "usr")
    return own.agg(
        F.count(F.when(role.bitwiseAND(3) == 0, 1)).alias("n_uses"), F.count(F.when(role.bitwiseAND(1) > 0, 1)).alias("n_decls"), F.min(F.when(role.bitwiseAND(2) > 0, F.col("start_p"))).alias("spell_p")
    )


@query("agg08_language_or", "SELECT source, bit_or(CASE lang WHEN 'en' THEN 1 WHEN 'de' THEN 2 WHEN 'fr' THEN 4 ELSE 8 END) AS languages FROM documents GROUP BY source")
def language_or(spark: SparkSession, sf: str) -> DataFrame:
    bit = F.when(F.col("lang") == "en", 1).when(F.col("lang") == "de", 2).when(F.col("lang") == "fr", 4).otherwise(8)
    return A.table(spark, sf, "documents").groupBy("source").agg(F.bit_or(bit).alias("languages"))


@query("agg09_ordered_distinct", f"WITH {A.TOKENS_SQL}, f AS (SELECT file_id, token, min(start_p) AS p FROM sited GROUP BY ALL) SELECT file_id, token, row_number() OVER (PARTITION BY file_id ORDER BY p) AS ord FROM f")
def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """First occurrences, in order."""
    first = A.tokens(spark, sf).groupBy("file_id", "token").agg(F.min("start_p").alias("p"))
    return first.select("file_id", "token", F.row_number().over(Window.partitionBy("file_id").orderBy("p")).cast("long").alias("ord"))


@query("jn25_dependency_freshness", """SELECT o_orderkey AS file_id, coalesce(bool_or(l_shipdate > o_orderdate), false) OR count(l_orderkey) = 0 AS stale FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def freshness(spark: SparkSession, sf: str) -> DataFrame:
    """A file is stale if a dependency is newer or it has none on record."""
    deps = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    met = A.table(spark, sf, "orders").join(deps, "o_orderkey", "left").groupBy(F.col("o_orderkey").alias("file_id"))
    return met.agg((F.coalesce(F.bool_or(F.col("l_shipdate") > F.col("o_orderdate")), F.lit(False)) | (F.count("l_shipdate") == 0)).alias("stale"))


@query("jn21_local_file_ids", f"WITH {A.EVENTS_SQL}, l AS (SELECT DISTINCT file_id AS local_id, file_id * 7 + 1 AS global_id FROM ev_scopes) SELECT event_id, coalesce(global_id, -1) AS file_id FROM ev_uses LEFT JOIN l ON local_id = file_id")
def local_ids(spark: SparkSession, sf: str) -> DataFrame:
    known = A.event_scopes(spark, sf).select("file_id", (F.col("file_id") * 7 + 1).alias("global_id")).distinct()
    return A.event_uses(spark, sf).join(known, "file_id", "left").select("event_id", F.coalesce("global_id", F.lit(-1)).alias("file_id"))


@query("flt18_watch_filter", f"WITH p AS (SELECT doc_id, {PATH} AS path FROM documents) SELECT doc_id, path FROM p WHERE NOT starts_with(path, 'src3/') AND NOT starts_with(path, '.') AND regexp_matches(path, '\\.(cc|h|mm)$')")
def watch_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Paths under the cache, hidden ones and unknown extensions are left out."""
    p = F.col("path")
    return _paths(spark, sf).where(~p.startswith("src3/") & ~p.startswith(".") & (names.language(p)["language"] >= 0))


@query("srt08_index_priority", f"WITH {A.UPDATES_SQL}, d AS (SELECT path % 10 AS folder, count(DISTINCT path) AS prio FROM updates WHERE change = 'create' GROUP BY ALL) SELECT path, seq, row_number() OVER (PARTITION BY u.path % 10 ORDER BY coalesce(prio, 0) DESC, seq) AS ord FROM updates u LEFT JOIN d ON folder = u.path % 10")
def index_priority(spark: SparkSession, sf: str) -> DataFrame:
    own = _updates(spark, sf).withColumn("folder", F.col("path") % 10)
    prio = own.where("change = 'create'").groupBy("folder").agg(F.countDistinct("path").alias("prio"))
    w = Window.partitionBy("folder").orderBy(F.desc(F.coalesce("prio", F.lit(0))), "seq")
    return own.join(prio, "folder", "left").select("path", "seq", F.row_number().over(w).cast("long").alias("ord"))
