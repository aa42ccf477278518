"""Projections of the test tables onto the canonical tables, each with its twin in DuckDB SQL.

Lexical index (documents): a file is a document, a line a line, a column the ordinal of a blank-separated token; the
token is the symbol, its first occurrence the definition. Scopes: lines, blocks of four lines, the document.
Intervals (events): signups open extents, errors are uses. Types: region, nation, customer and supplier.
Calls (lineitem): a part calls the next part of its order. Includes (pages): links. Updates (events).
Versions (documents): the text against a deterministically edited copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schema import LINE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_id(x) -> F.Column:  # noqa: ANN001
    """60 bits of MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(x), 1, 15), 16, 10).cast("long")


# --- lexical index

LINES_SQL = """lines AS (
    SELECT file_id, line, content FROM (
        SELECT file_id, unnest(range(len(l))) AS line, unnest(l) AS content FROM (SELECT doc_id AS file_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))
)"""
TOKENS_SQL = LINES_SQL + """, tokens AS (
    SELECT file_id, least(line, 65535) AS line, least(col, 32767) AS col, token FROM (SELECT file_id, line, unnest(range(len(t))) AS col, unnest(t) AS token FROM (
        SELECT file_id, line, list_filter(string_split(content, ' '), lambda x: x <> '') AS t FROM lines))
), sited AS (
    SELECT file_id, line, col, token, line * 65536 + col AS start_p, line * 65536 + col + 1 AS end_p,
           ('0x' || substr(md5(token), 1, 15))::BIGINT AS usr
    FROM tokens
)"""
OCC_SQL = TOKENS_SQL + """, firsts AS (
    SELECT token, min({'f': file_id, 'p': start_p}) AS at FROM sited GROUP BY token
), occ AS (
    SELECT s.file_id, s.usr, CAST(2 + s.usr % 3 AS INTEGER) AS ekind, s.token AS name,
           CASE WHEN s.file_id = f.at.f AND s.start_p = f.at.p THEN 2
                ELSE CASE (s.line + s.col) % 5 WHEN 0 THEN 1 WHEN 1 THEN 12 WHEN 2 THEN 20 WHEN 3 THEN 36 ELSE 260 END END AS role,
           s.start_p, s.end_p,
           CASE WHEN s.file_id = f.at.f AND s.start_p = f.at.p AND s.usr % 3 < 2 THEN s.line // 4 * 4 * 65536 END AS ext_start_p,
           CASE WHEN s.file_id = f.at.f AND s.start_p = f.at.p AND s.usr % 3 < 2 THEN (s.line // 4 * 4 + 4) * 65536 END AS ext_end_p,
           1 AS refcnt
    FROM sited s JOIN firsts f USING (token)
), ents AS (
    SELECT usr, ekind, file_id, name, start_p AS spell_start_p, end_p AS spell_end_p, ext_start_p, ext_end_p,
           CASE ekind WHEN 2 THEN 5 WHEN 3 THEN CASE WHEN usr % 2 = 0 THEN 12 ELSE 6 END
                ELSE CASE usr % 4 WHEN 0 THEN 8 WHEN 1 THEN 13 WHEN 2 THEN 253 ELSE 14 END END AS kind,
           CASE WHEN usr % 7 < 3 THEN 12 WHEN usr % 7 < 5 THEN 6 ELSE 1 END AS parent_kind, CASE WHEN usr % 11 < 7 THEN 0 WHEN usr % 11 < 9 THEN 2 ELSE 4 END AS storage
    FROM occ WHERE role = 2
)"""
#: One cursor for each document: the third token of its first line, or as far as that goes.
CURSOR_SQL = OCC_SQL + ", cursors AS (SELECT doc_id AS cursor_id, doc_id AS file_id, CAST(2 AS BIGINT) AS p FROM documents WHERE text IS NOT NULL)"


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(F.col("doc_id").alias("file_id"), F.posexplode(F.split("text", "\n")).alias("line", "content"))


def placed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by the number that a position can hold: those beyond the last one are clamped to it."""
    return lines(spark, sf_dir).withColumn("line", F.least(F.col("line").cast("long"), F.lit(LINE - 1)))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens_of(placed_lines(spark, sf_dir))


def tokens_of(own: DataFrame) -> DataFrame:
    """The tokens of lines (file_id, line, content); further columns stay. Columns are clamped as well."""
    more = [c for c in own.columns if c != "content"]
    own = own.select(*more, F.posexplode(F.array_remove(F.split("content", " "), "")).alias("col", "token")).withColumn("col", F.least(F.col("col").cast("long"), F.lit(32767)))
    p = F.col("line") * LINE + F.col("col")
    return own.select("*", p.alias("start_p"), (p + 1).alias("end_p"), symbol_id("token").alias("usr"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First occurrences are found from minima of each token and joined to their lines, so that lines are exchanged and not tokens."""
    firsts = tokens(spark, sf_dir).groupBy("token").agg(F.min(F.struct(F.col("file_id").alias("f"), F.col("start_p").alias("p"))).alias("at"))
    firsts = firsts.groupBy(F.col("at.f").alias("file_id"), F.floor(F.col("at.p") / LINE).alias("line")).agg(F.collect_list(F.struct(F.col("at.p").alias("p"), "token")).alias("firsts"))
    own = tokens_of(placed_lines(spark, sf_dir).join(firsts, ["file_id", "line"], "left"))
    first = F.coalesce(F.array_contains("firsts", F.struct(F.col("start_p").alias("p"), "token")), F.lit(False))
    turn = (F.col("line") + F.col("col")) % 5
    other = F.when(turn == 0, 1).when(turn == 1, 12).when(turn == 2, 20).when(turn == 3, 36).otherwise(260)
    block = F.floor(F.col("line") / 4) * 4
    wide = first & (F.col("usr") % 3 < 2)
    return own.select(
        "file_id", "usr", (F.lit(2) + F.col("usr") % 3).cast("int").alias("ekind"), F.col("token").alias("name"), F.when(first, 2).otherwise(other).alias("role"),
        "start_p", "end_p", F.when(wide, block * LINE).alias("ext_start_p"), F.when(wide, (block + 4) * LINE).alias("ext_end_p"), F.lit(1).alias("refcnt"),
    )


def entities(occ: DataFrame) -> DataFrame:
    u = F.col("usr")
    kind = F.when(F.col("ekind") == 2, 5).when(F.col("ekind") == 3, F.when(u % 2 == 0, 12).otherwise(6)).otherwise(F.when(u % 4 == 0, 8).when(u % 4 == 1, 13).when(u % 4 == 2, 253).otherwise(14))
    return occ.where("role = 2").select(
        "usr", "ekind", "file_id", "name", F.col("start_p").alias("spell_start_p"), F.col("end_p").alias("spell_end_p"), "ext_start_p", "ext_end_p", kind.alias("kind"),
        F.when(u % 7 < 3, 12).when(u % 7 < 5, 6).otherwise(1).alias("parent_kind"), F.when(u % 11 < 7, 0).when(u % 11 < 9, 2).otherwise(4).alias("storage"),
    )


def cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("cursor_id"), F.col("doc_id").alias("file_id"), F.lit(2).cast("long").alias("p"))


# --- scopes

SCOPES_SQL = LINES_SQL + """, scopes AS (
    SELECT file_id, line * 65536 AS start_p, (line + 1) * 65536 AS end_p, line * 4 + 3 AS scope_id FROM lines
    UNION ALL SELECT file_id, line // 4 * 4 * 65536, (line // 4 * 4 + 4) * 65536, line // 4 * 4 + 1 FROM lines WHERE line % 4 = 0
    UNION ALL SELECT file_id, 0, max(line + 1) * 65536, 0 FROM lines GROUP BY file_id
), points AS (
    SELECT file_id * 1000003 + line AS cursor_id, file_id, line * 65536 + 1 AS p FROM lines
)"""


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir).select("file_id", F.col("line").cast("long").alias("line"))
    block = F.floor(F.col("line") / 4) * 4
    one = own.select("file_id", (F.col("line") * LINE).alias("start_p"), ((F.col("line") + 1) * LINE).alias("end_p"), (F.col("line") * 4 + 3).alias("scope_id"))
    four = own.where("line % 4 = 0").select("file_id", (block * LINE).alias("start_p"), ((block + 4) * LINE).alias("end_p"), (block + 1).alias("scope_id"))
    whole = own.groupBy("file_id").agg(((F.max("line") + 1) * LINE).alias("end_p")).select("file_id", F.lit(0).cast("long").alias("start_p"), "end_p", F.lit(0).cast("long").alias("scope_id"))
    return one.unionByName(four).unionByName(whole)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lines(spark, sf_dir).select("file_id", F.col("line").cast("long").alias("line"))
    return own.select((F.col("file_id") * 1000003 + F.col("line")).alias("cursor_id"), "file_id", (F.col("line") * LINE + 1).alias("p"))


# --- intervals

EVENTS_SQL = """ev AS (SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
ev_scopes AS (SELECT user_id AS file_id, t AS start_p, t + CAST(floor(value * 3600) AS BIGINT) AS end_p, event_id AS scope_id FROM ev WHERE event_type = 'signup'),
ev_uses AS (SELECT event_id, user_id AS file_id, t AS start_p, t AS end_p FROM ev WHERE event_type = 'error')"""


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.unix_timestamp("ts").alias("t"))


def event_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = event_rows(spark, sf_dir).where("event_type = 'signup'")
    return own.select(F.col("user_id").alias("file_id"), F.col("t").alias("start_p"), (F.col("t") + F.floor(F.col("value") * 3600)).alias("end_p"), F.col("event_id").alias("scope_id"))


def event_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = event_rows(spark, sf_dir).where("event_type = 'error'")
    return own.select("event_id", F.col("user_id").alias("file_id"), F.col("t").alias("start_p"), F.col("t").alias("end_p"))


# --- types: ids are kind * 10^9 + key; an edge goes from the base to what derives from it

TYPES_SQL = """type_nodes AS (
    SELECT r_regionkey + 1000000000 AS usr, r_name AS name FROM region
    UNION ALL SELECT n_nationkey + 2000000000, n_name FROM nation
    UNION ALL SELECT c_custkey + 3000000000, c_name FROM customer
    UNION ALL SELECT s_suppkey + 4000000000, s_name FROM supplier
), type_edges AS (
    SELECT n_regionkey + 1000000000 AS src, n_nationkey + 2000000000 AS dst FROM nation
    UNION ALL SELECT c_nationkey + 2000000000, c_custkey + 3000000000 FROM customer
    UNION ALL SELECT s_nationkey + 2000000000, s_suppkey + 4000000000 FROM supplier
)"""


def type_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [("region", "r_regionkey", "r_name", 1), ("nation", "n_nationkey", "n_name", 2), ("customer", "c_custkey", "c_name", 3), ("supplier", "s_suppkey", "s_name", 4)]
    parts = [table(spark, sf_dir, t).select((F.col(k).cast("long") + n * 10**9).alias("usr"), F.col(v).alias("name")) for t, k, v, n in own]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def type_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [("nation", "n_regionkey", 1, "n_nationkey", 2), ("customer", "c_nationkey", 2, "c_custkey", 3), ("supplier", "s_nationkey", 2, "s_suppkey", 4)]
    parts = [table(spark, sf_dir, t).select((F.col(a).cast("long") + m * 10**9).alias("src"), (F.col(b).cast("long") + n * 10**9).alias("dst")) for t, a, m, b, n in own]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- calls

CALLS_SQL = """calls AS (
    SELECT l_orderkey AS file_id, n AS start_p, src, dst FROM (
        SELECT l_orderkey, row_number() OVER w AS n, l_partkey AS src, lead(l_partkey) OVER w AS dst FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax)
    ) WHERE dst IS NOT NULL AND dst <> src
)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    own = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), F.row_number().over(w).cast("long").alias("start_p"), F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst")
    )
    return own.where("dst is not null and dst <> src")


# --- includes

INCLUDES_SQL = """page_lines AS (
    SELECT page_id, url, unnest(range(len(l))) AS line, unnest(l) AS content FROM (SELECT page_id, url, string_split(html, chr(10)) AS l FROM pages WHERE html IS NOT NULL)
), includes AS (
    SELECT page_id AS file_id, url AS path, line, ord, resolved_path FROM (
        SELECT page_id, url, line, unnest(range(len(h))) AS ord, unnest(h) AS resolved_path FROM (SELECT page_id, url, line, regexp_extract_all(content, 'href="([^"]*)"', 1) AS h FROM page_lines))
)"""


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where("html is not null").select("page_id", "url", F.posexplode(F.split("html", "\n")).alias("line", "content"))


def includes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = page_lines(spark, sf_dir).select(F.col("page_id").alias("file_id"), F.col("url").alias("path"), F.col("line").cast("long").alias("line"), F.posexplode(F.regexp_extract_all("content", F.lit('href="([^"]*)"'), 1)).alias("ord", "resolved_path"))
    return own.withColumn("ord", F.col("ord").cast("long"))


# --- updates

UPDATES_SQL = """updates AS (
    SELECT event_id AS seq, user_id AS path, CAST(floor(value / 10) AS BIGINT) AS ts, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS step,
           CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'change' END AS change, CAST(floor(epoch(ts)) AS BIGINT) AS "at"
    FROM events
)"""


def updates(events: DataFrame) -> DataFrame:
    """Works on a stream of events as well as on the table."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("path"), F.floor(F.col("value") / 10).cast("long").alias("ts"),
        F.when(kind == "view", 0).when(kind == "click", 1).when(kind == "purchase", 2).otherwise(3).alias("step"),
        F.when(kind == "signup", "create").when(kind == "error", "delete").otherwise("change").alias("change"), F.unix_timestamp("ts").alias("at"),
    )


# --- versions: the buffer lacks every line whose number is 3 modulo 7 and has a mark on those that are 5 modulo 7

VERSIONS_SQL = LINES_SQL + """, index_lines AS (SELECT file_id, line, content FROM lines
), buffer_lines AS (
    SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY line) - 1 AS line, CASE WHEN line % 7 = 5 THEN content || ' +' ELSE content END AS content FROM lines WHERE line % 7 <> 3
)"""


def versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    index = lines(spark, sf_dir).select("file_id", F.col("line").cast("long").alias("line"), "content")
    w = Window.partitionBy("file_id").orderBy("line")
    new = F.when(F.col("line") % 7 == 5, F.concat("content", F.lit(" +"))).otherwise(F.col("content"))
    buffer = index.where("line % 7 <> 3").select("file_id", (F.row_number().over(w) - 1).cast("long").alias("line"), new.alias("content"))
    return index, buffer
