"""Queries over graphs: hierarchies, calls, members, lenses, includes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import names
from ..operators import graph, locate, xref
from . import adapters as A
from .registry import query

# --- types


@query("grf05_inheritance_levels", f"""WITH {A.TYPES_SQL}, l1 AS (SELECT r_regionkey + 1000000000 AS root, 1 AS level, src AS parent, dst AS node FROM region JOIN type_edges ON src = r_regionkey + 1000000000),
    l2 AS (SELECT root, 2 AS level, e.src AS parent, e.dst AS node FROM l1 JOIN type_edges e ON e.src = l1.node) SELECT * FROM l1 UNION SELECT * FROM l2""")
def inheritance(spark: SparkSession, sf: str) -> DataFrame:
    """Derived types of every root, two levels down."""
    roots = A.table(spark, sf, "region").select((F.col("r_regionkey").cast("long") + 10**9).alias("root"))
    return graph.tree(roots, A.type_edges(spark, sf), 2)


@query("grf06_implementations", f"WITH {A.TYPES_SQL} SELECT DISTINCT src AS root, dst AS node FROM type_edges")
def implementations(spark: SparkSession, sf: str) -> DataFrame:
    edges = A.type_edges(spark, sf)
    return graph.flatten(graph.tree(edges.select(F.col("src").alias("root")).distinct(), edges, 1))


@query("grf09_flattened_hierarchy", f"""WITH RECURSIVE {A.TYPES_SQL}, c AS (SELECT src AS root, dst AS node FROM type_edges UNION SELECT c.root, e.dst FROM c JOIN type_edges e ON e.src = c.node)
    SELECT c.root, c.node, n.name FROM c JOIN type_nodes n ON n.usr = c.node""")
def flattened(spark: SparkSession, sf: str) -> DataFrame:
    edges = A.type_edges(spark, sf)
    all_ = graph.flatten(graph.closure(edges.select(F.col("src").alias("root")).distinct(), edges))
    return all_.join(A.type_nodes(spark, sf), F.col("node") == F.col("usr")).select("root", "node", "name")


@query("jn11_uses_over_all_derived", f"""WITH RECURSIVE {A.TYPES_SQL}, c AS (SELECT src AS root, dst AS node FROM type_edges UNION SELECT c.root, e.dst FROM c JOIN type_edges e ON e.src = c.node)
    SELECT c.root, count(*) AS n_uses, count(DISTINCT o_custkey) AS n_users FROM c JOIN orders ON o_custkey + 3000000000 = c.node GROUP BY c.root""")
def over_derived(spark: SparkSession, sf: str) -> DataFrame:
    """Uses (orders) of everything that derives from a type."""
    edges = A.type_edges(spark, sf)
    all_ = graph.closure(edges.select(F.col("src").alias("root")).distinct(), edges)
    uses = A.table(spark, sf, "orders").select((F.col("o_custkey") + 3 * 10**9).alias("node"), "o_custkey")
    return all_.join(uses, "node").groupBy("root").agg(F.count("*").alias("n_uses"), F.countDistinct("o_custkey").alias("n_users"))


@query("jn10_uses_over_all_bases", f"""WITH RECURSIVE {A.TYPES_SQL}, c AS (SELECT dst AS root, src AS node FROM type_edges UNION SELECT c.root, e.src FROM c JOIN type_edges e ON e.dst = c.node)
    SELECT root, count(*) AS n_bases, min(node) AS first_base, max(node) AS last_base FROM c GROUP BY root""")
def over_bases(spark: SparkSession, sf: str) -> DataFrame:
    edges = A.type_edges(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    all_ = graph.closure(edges.select(F.col("src").alias("root")).distinct(), edges)
    return all_.groupBy("root").agg(F.count("*").alias("n_bases"), F.min("node").alias("first_base"), F.max("node").alias("last_base"))


@query("jn13_instances_of_type", "SELECT c_nationkey + 2000000000 AS type_usr, o_custkey + 3000000000 AS instance_of, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL")
def instances(spark: SparkSession, sf: str) -> DataFrame:
    cust = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return (
        A.table(spark, sf, "orders").join(cust, "o_custkey")
        .groupBy((F.col("c_nationkey").cast("long") + 2 * 10**9).alias("type_usr"), (F.col("o_custkey") + 3 * 10**9).alias("instance_of")).agg(F.count("*").alias("n"))
    )


@query("jn14_type_definition", f"""WITH {A.TYPES_SQL} SELECT o_orderkey AS var_usr, e.src AS type_usr, n.name FROM orders JOIN type_edges e ON e.dst = o_custkey + 3000000000 JOIN type_nodes n ON n.usr = e.src""")
def type_definition(spark: SparkSession, sf: str) -> DataFrame:
    """From a variable (order) over its type (customer) to what that is an alias of (nation)."""
    edges = A.type_edges(spark, sf)
    own = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("var_usr"), (F.col("o_custkey") + 3 * 10**9).alias("dst"))
    return own.join(edges, "dst").join(A.type_nodes(spark, sf), F.col("src") == F.col("usr")).select("var_usr", F.col("src").alias("type_usr"), "name")


MEMBER_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
MEMBERS_SQL = f"""members AS (SELECT l_orderkey AS usr, l_partkey AS member, row_number() OVER w AS ord, CAST(coalesce(sum(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS bits
    FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {', '.join(MEMBER_ORDER)}))"""


def _members(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*MEMBER_ORDER)
    before = F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = A.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.row_number().over(w).cast("long").alias("ord"), F.coalesce(before, F.lit(0.0)).cast("long").alias("bits"))
    return own.withColumnsRenamed({"l_orderkey": "usr", "l_partkey": "member"})


@query("grf07_members_with_offsets", f"WITH {MEMBERS_SQL} SELECT usr, member, ord, bits FROM members")
def members(spark: SparkSession, sf: str) -> DataFrame:
    return _members(spark, sf)


@query("prj13_field_labels", f"""WITH {MEMBERS_SQL} SELECT usr, ord, bits // 8 || CASE WHEN bits % 8 > 0 THEN '.' || bits % 8 ELSE '' END || CASE WHEN bits // 8 < 10 THEN '  ' ELSE ' ' END || p_name AS label
    FROM members JOIN part ON p_partkey = member""")
def field_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Byte offset, bits beyond it, padding below ten, name."""
    parts = A.table(spark, sf, "part").select(F.col("p_partkey").alias("member"), "p_name")
    return _members(spark, sf).join(parts, "member").select("usr", "ord", names.field_label(F.col("bits"), F.col("p_name")).alias("label"))


@query("mth04_bit_offsets", f"WITH {MEMBERS_SQL} SELECT usr, ord, bits // 8 AS byte_offset, bits % 8 AS bit_offset FROM members")
def bit_offsets(spark: SparkSession, sf: str) -> DataFrame:
    return _members(spark, sf).select("usr", "ord", F.floor(F.col("bits") / 8).alias("byte_offset"), (F.col("bits") % 8).alias("bit_offset"))


@query("grf08_function_members", f"WITH {MEMBERS_SQL} SELECT m.usr, m.member, CAST(-1 AS BIGINT) AS bits FROM members m JOIN orders ON o_orderkey = m.usr WHERE o_orderstatus = 'F'")
def function_members(spark: SparkSession, sf: str) -> DataFrame:
    """Locals of functions have no offset."""
    funcs = A.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("usr"))
    return _members(spark, sf).join(funcs, "usr").select("usr", "member", F.lit(-1).cast("long").alias("bits"))


LENS_SQL = f"""WITH {A.TYPES_SQL}, counts AS (
        SELECT usr, (SELECT count(*) FROM orders WHERE o_custkey + 3000000000 = usr) AS ref, (SELECT count(*) FROM type_edges WHERE dst = usr) AS base, (SELECT count(*) FROM type_edges WHERE src = usr) AS derived FROM type_nodes),
    x AS (SELECT usr, 'ref' AS command, ref AS n FROM counts UNION ALL SELECT usr, 'base', base FROM counts UNION ALL SELECT usr, 'derived', derived FROM counts)
    SELECT usr, command, n, n || ' ' || command || CASE WHEN n > 1 AND command <> 'derived' THEN 's' ELSE '' END AS title FROM x WHERE n > 0"""


@query("agg03_code_lens", LENS_SQL)
def code_lens(spark: SparkSession, sf: str) -> DataFrame:
    edges, nodes = A.type_edges(spark, sf), A.type_nodes(spark, sf)
    ref = A.table(spark, sf, "orders").groupBy((F.col("o_custkey") + 3 * 10**9).alias("usr")).agg(F.count("*").alias("ref"))
    base = edges.groupBy(F.col("dst").alias("usr")).agg(F.count("*").alias("base"))
    derived = edges.groupBy(F.col("src").alias("usr")).agg(F.count("*").alias("derived"))
    counts = nodes.select("usr").join(ref, "usr", "left").join(base, "usr", "left").join(derived, "usr", "left").fillna(0)
    return xref.code_lens(nodes, counts)


@query("grf12_xref_command", f"""WITH {A.TYPES_SQL} SELECT usr, 'derived' AS field, count(*) AS n FROM type_nodes JOIN type_edges ON src = usr GROUP BY usr
    UNION ALL SELECT usr, 'bases', count(*) FROM type_nodes JOIN type_edges ON dst = usr GROUP BY usr
    UNION ALL SELECT usr, 'instances', count(*) FROM type_nodes JOIN orders ON o_custkey + 3000000000 = usr GROUP BY usr""")
def xref_command(spark: SparkSession, sf: str) -> DataFrame:
    """One command over its fields: the same rows, filtered on ``field``, answer each of them."""
    edges = A.type_edges(spark, sf)
    parts = [
        edges.select(F.col("src").alias("usr"), F.lit("derived").alias("field")),
        edges.select(F.col("dst").alias("usr"), F.lit("bases").alias("field")),
        A.table(spark, sf, "orders").select((F.col("o_custkey") + 3 * 10**9).alias("usr"), F.lit("instances").alias("field")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("usr", "field").agg(F.count("*").alias("n"))


# --- calls


@query("grf01_callees_two_levels", f"""WITH {A.CALLS_SQL}, e AS (SELECT DISTINCT src, dst FROM calls)
    SELECT level, parent, count(*) AS n FROM (
        SELECT DISTINCT p_partkey AS root, 1 AS level, src AS parent, dst AS node FROM part JOIN e ON src = p_partkey
        UNION ALL SELECT DISTINCT a.src, 2, b.src, b.dst FROM e a JOIN e b ON b.src = a.dst) GROUP BY ALL""")
def callees(spark: SparkSession, sf: str) -> DataFrame:
    roots = A.table(spark, sf, "part").select(F.col("p_partkey").alias("root"))
    return graph.tree(roots, A.calls(spark, sf), 2).groupBy("level", "parent").agg(F.count("*").alias("n"))


@query("grf02_callers_by_scope", f"""WITH {A.EVENTS_SQL}, r AS (
        SELECT u.event_id, u.file_id, x.scope_id, row_number() OVER (PARTITION BY u.event_id ORDER BY x.start_p DESC, x.end_p, x.scope_id) AS n
        FROM ev_uses u JOIN ev_scopes x ON x.file_id = u.file_id AND x.start_p <= u.start_p AND u.end_p <= x.end_p)
    SELECT scope_id AS caller, count(*) AS n_calls, min(event_id) AS first_call FROM r WHERE n = 1 GROUP BY scope_id""")
def callers(spark: SparkSession, sf: str) -> DataFrame:
    """Callers are the innermost scopes of the uses."""
    own = locate.scope_of(A.event_uses(spark, sf), A.event_scopes(spark, sf), ["event_id"])
    return own.groupBy(F.col("scope_id").alias("caller")).agg(F.count("*").alias("n_calls"), F.min("event_id").alias("first_call"))


@query("grf03_calls_over_derived", f"""WITH {A.TYPES_SQL}, d AS (SELECT dst - 3000000000 AS callee, src AS via FROM type_edges WHERE dst >= 3000000000 AND dst < 4000000000)
    SELECT via AS root, 'direct' AS call_type, CAST(0 AS BIGINT) AS n FROM d WHERE false
    UNION ALL SELECT via, 'derived', count(*) FROM d JOIN orders ON o_custkey = callee GROUP BY via
    UNION ALL SELECT o_custkey + 3000000000, 'direct', count(*) FROM orders GROUP BY o_custkey""")
def calls_over_derived(spark: SparkSession, sf: str) -> DataFrame:
    """Calls of a node itself, and those of what derives from it, tagged with the kind."""
    uses = A.table(spark, sf, "orders").select((F.col("o_custkey") + 3 * 10**9).alias("node"))
    direct = uses.groupBy(F.col("node").alias("root")).agg(F.count("*").alias("n")).select("root", F.lit("direct").alias("call_type"), "n")
    edges = A.type_edges(spark, sf)
    derived = edges.select(F.col("src").alias("root"), F.col("dst").alias("node")).join(uses, "node").groupBy("root").agg(F.count("*").alias("n")).select("root", F.lit("derived").alias("call_type"), "n")
    return direct.unionByName(derived)


@query("grf04_num_children", f"WITH {A.CALLS_SQL} SELECT src AS node, count(*) AS num_children, count(DISTINCT dst) AS distinct_children FROM calls GROUP BY src")
def num_children(spark: SparkSession, sf: str) -> DataFrame:
    return graph.child_counts(A.calls(spark, sf))


GROUPED = """WITH {calls}, f AS (SELECT src, dst, min(file_id) AS file_id FROM calls GROUP BY src, dst)
    SELECT src, dst, file_id, count(*) AS n_ranges, min(start_p) AS first_p, max(start_p) AS last_p FROM calls JOIN f USING (src, dst, file_id) GROUP BY src, dst, file_id"""


@query("grf11_outgoing_calls_grouped", GROUPED.replace("{calls}", A.CALLS_SQL))
def outgoing(spark: SparkSession, sf: str) -> DataFrame:
    return graph.grouped_calls(A.calls(spark, sf), "src", "dst")


@query("grf11_incoming_calls_grouped", f"WITH {A.CALLS_SQL} SELECT dst AS node, count(DISTINCT src) AS n_callers, count(*) AS n_calls FROM calls GROUP BY dst")
def incoming(spark: SparkSession, sf: str) -> DataFrame:
    return A.calls(spark, sf).groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("n_callers"), F.count("*").alias("n_calls"))


@query("jn10_reachable_from_first_part", f"""WITH RECURSIVE {A.CALLS_SQL}, e AS (SELECT DISTINCT src, dst FROM calls), r AS (
        SELECT min(p_partkey) AS node FROM part UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)
    SELECT node FROM r WHERE node <> (SELECT min(p_partkey) FROM part)""")
def reachable(spark: SparkSession, sf: str) -> DataFrame:
    """Closure over a graph with cycles, from one root."""
    roots = A.table(spark, sf, "part").agg(F.min("p_partkey").alias("root"))
    return graph.closure(roots, graph.durable(A.calls(spark, sf).select("src", "dst").distinct())).select("node")


# --- includes


@query("jn17_includes_at_line", f"WITH {A.INCLUDES_SQL} SELECT file_id, line, ord, resolved_path FROM includes")
def includes_at(spark: SparkSession, sf: str) -> DataFrame:
    return A.includes(spark, sf).select("file_id", "line", "ord", "resolved_path")


@query("jn18_reverse_includes", f"WITH {A.INCLUDES_SQL} SELECT resolved_path, file_id, min(line) AS line FROM includes GROUP BY resolved_path, file_id")
def reverse_includes(spark: SparkSession, sf: str) -> DataFrame:
    """The files that include a path, with the first such line of each."""
    return A.includes(spark, sf).groupBy("resolved_path", "file_id").agg(F.min("line").alias("line"))


STEM = r"regexp_extract({}, '([^/]*?)(\.[^./]*)?/?$', 1)"


@query("jn19_same_stem_includes", f"WITH {A.INCLUDES_SQL} SELECT file_id, count(*) AS n FROM includes WHERE {STEM.format('path')} = {STEM.format('resolved_path')} AND {STEM.format('path')} <> '' GROUP BY file_id")
def same_stem(spark: SparkSession, sf: str) -> DataFrame:
    own = A.includes(spark, sf).where((names.stem(F.col("path")) == names.stem(F.col("resolved_path"))) & (names.stem(F.col("path")) != ""))
    return own.groupBy("file_id").agg(F.count("*").alias("n"))


@query("jn20_related_files", f"""WITH s AS (SELECT page_id, url, {STEM.format('url')} AS stem FROM pages) SELECT a.page_id, count(*) AS n_related, min(b.page_id) AS first_related FROM s a JOIN s b ON a.stem = b.stem AND a.url <> b.url AND a.stem <> '' GROUP BY a.page_id""")
def related(spark: SparkSession, sf: str) -> DataFrame:
    """Other files of the same stem, from sums and the two least files of each stem: no stem's files are paired or gathered."""
    own = A.table(spark, sf, "pages").select("page_id", "url", names.stem(F.col("url")).alias("stem")).where("stem <> ''")
    by_url = own.groupBy("stem", "url").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    by_stem = by_url.groupBy("stem").agg(F.sum("n").alias("total"), F.min(F.struct("first", "url")).alias("least"))
    met = by_url.join(by_stem, "stem")
    second = met.where("url <> least.url").groupBy("stem").agg(F.min("first").alias("second"))
    other = F.when(F.col("url") != F.col("least.url"), F.col("least.first")).otherwise(F.col("second"))
    told = met.join(second, "stem").select("stem", "url", (F.col("total") - F.col("n")).alias("n_related"), other.alias("first_related"))
    return own.join(told, ["stem", "url"]).select("page_id", "n_related", "first_related")


@query("agg04_counterpart_vote", f"""WITH {A.INCLUDES_SQL}, v AS (SELECT i.file_id, p.page_id AS other, count(*) AS n FROM includes i JOIN pages p ON p.url = i.resolved_path AND p.page_id <> i.file_id GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, other) AS k FROM v) SELECT file_id, other, n FROM r WHERE k = 1""")
def counterpart(spark: SparkSession, sf: str) -> DataFrame:
    """The other file with the most votes, of equals the least id."""
    pages = A.table(spark, sf, "pages").select(F.col("url").alias("resolved_path"), F.col("page_id").alias("other"))
    votes = A.includes(spark, sf).join(pages, "resolved_path").where("other <> file_id").groupBy("file_id", "other").agg(F.count("*").alias("n"))
    return votes.groupBy("file_id").agg(F.max_by(F.struct("other", "n"), F.struct(F.col("n"), -F.col("other"))).alias("b")).select("file_id", "b.other", "b.n")


@query("prj11_document_links", f"""WITH {A.INCLUDES_SQL} SELECT page_id AS file_id, line, strpos(content, '"') AS start_col, length(content) - strpos(reverse(content), '"') + 1 AS end_col FROM page_lines WHERE regexp_matches(content, '"[^"]*"')""")
def document_links(spark: SparkSession, sf: str) -> DataFrame:
    """The quoted span of a line: from its first quote to its last."""
    own = A.page_lines(spark, sf).where(F.col("content").rlike('"[^"]*"'))
    return own.select(F.col("page_id").alias("file_id"), F.col("line").cast("long").alias("line"), F.instr("content", '"').cast("long").alias("start_col"), (F.length("content") - F.instr(F.reverse("content"), '"') + 1).cast("long").alias("end_col"))
