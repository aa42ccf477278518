"""The request surface over a small hand-made index."""

import pytest
from pyspark.sql import functions as F

from codeloom import api

#: struct A (1) <- struct B (2); f (10) overrides g (11); h (12) calls f; var v (20) of type B, field m (21) of A at 64 bits.
OCC = [
    (1, 1, 2, 2, 7, 8, 0, 65536), (1, 2, 2, 2, 65536 + 7, 65536 + 8, 65536, 131072), (1, 1, 2, 4, 65536 + 11, 65536 + 12, None, None),
    (1, 11, 3, 2, 131072, 131073, 131072, 140000), (1, 10, 3, 2, 196608, 196609, 196608, 200000), (2, 10, 3, 36, 5, 6, None, None), (2, 11, 3, 36, 65536, 65537, None, None),
    (2, 12, 3, 2, 0, 1, 0, 65536 * 3), (2, 20, 4, 2, 131075, 131076, None, None), (2, 2, 2, 4, 131072, 131073, None, None), (2, 10, 3, 1, 65536 * 5, 65536 * 5 + 1, None, None),
]
EDGES = [(2, 1, "base"), (1, 2, "derived"), (10, 11, "base"), (11, 10, "derived"), (12, 10, "callee"), (20, 2, "var_type"), (2, 20, "instance"), (1, 21, "member")]
NAMES = {1: "A", 2: "B", 10: "f", 11: "g", 12: "h", 20: "value", 21: "m"}


@pytest.fixture(scope="module")
def tables(spark):
    occ = spark.createDataFrame(OCC, "file_id long, usr long, ekind int, role int, start_p long, end_p long, ext_start_p long, ext_end_p long").withColumn("refcnt", F.lit(1))
    ents = spark.createDataFrame([(u, k, f, NAMES[u], s, e) for f, u, k, r, s, e, _, _ in OCC if r == 2], "usr long, ekind int, file_id long, name string, spell_start_p long, spell_end_p long")
    edges = spark.createDataFrame([(a, b, t, 64 if t == "member" else None, 0) for a, b, t in EDGES], "src long, dst long, etype string, offset_bits long, ord int")
    return {
        "occurrences": occ, "entities": ents, "edges": edges, "files": spark.createDataFrame([(1, "/a/x.h"), (2, "/b/y.cc")], "file_id long, path string"),
        "includes": spark.createDataFrame([(2, 0, "/a/x.h")], "file_id long, line int, resolved_path string"),
        "scopes": occ.where("ext_start_p is not null").select("file_id", F.col("ext_start_p").alias("start_p"), F.col("ext_end_p").alias("end_p"), F.col("usr").alias("scope_id")),
        "lines": spark.createDataFrame([(1, 0, "x")], "file_id long, line int, content string"),
    }


@pytest.fixture(scope="module")
def cursor(spark):
    return lambda file_id, p: spark.createDataFrame([(0, file_id, p)], "cursor_id long, file_id long, p long")


def got(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_references_follow_overrides(tables, cursor):
    at = cursor(2, 5)
    assert got(api.call("textDocument/references", tables, cursors=at), "file_id", "start_p") == [(2, 5), (2, 65536)]
    assert got(api.call("textDocument/references", tables, cursors=at, base=False), "start_p") == [(5,)]
    assert got(api.call("textDocument/references", tables, cursors=at, base=False, include_declaration=True), "file_id", "start_p") == [(1, 196608), (2, 5), (2, 65536 * 5)]
    assert got(api.call("textDocument/references", tables, cursors=at, folders=["/a"]), "start_p") == []


def test_definitions(tables, cursor):
    assert got(api.call("textDocument/definition", tables, cursors=cursor(2, 5)), "file_id", "start_p") == [(1, 196608)]
    assert got(api.call("textDocument/definition", tables, cursors=cursor(1, 196608)), "file_id", "start_p") == [(2, 65536 * 5)]
    assert got(api.call("textDocument/definition", tables, cursors=cursor(1, 7)), "file_id", "start_p") == [(1, 7)]
    assert got(api.call("textDocument/typeDefinition", tables, cursors=cursor(2, 131075)), "usr") == [(2,)]


def test_graphs(spark, tables, cursor):
    root = lambda n: spark.createDataFrame([(n,)], "root long")
    assert got(api.call("$xref/call", tables, roots=root(12)), "node") == [(10,)]
    assert got(api.call("callHierarchy/incomingCalls", tables, roots=root(10)), "node") == [(12,)]
    assert got(api.call("$xref/inheritance", tables, roots=root(1)), "node") == [(2,)]
    assert got(api.call("$xref/member", tables, roots=root(2)), "owner", "member", "offset_bits") == [(1, 21, 64)]
    assert got(api.call("$xref/vars", tables, cursors=cursor(2, 131075)), "usr") == [(20,)]
    assert got(api.call("workspace/executeCommand", tables, usr=1, field="derived"), "usr") == [(2,)]


def test_small_ones(tables, cursor):
    assert got(api.call("textDocument/hover", tables, cursors=cursor(2, 131075)), "hover") == [("value",)]
    assert [r["name"] for r in api.call("workspace/symbol", tables, query="va").collect()] == ["value"]
    assert got(api.call("$xref/navigate", tables, cursors=cursor(2, 70000), direction="up"), "start_p") == [(0,)]
    assert got(api.call("textDocument/codeLens", tables).where("usr = 1"), "title") == [("1 derived",), ("1 ref",)]
    assert api.call("textDocument/foldingRange", tables).count() == 5
    assert api.call("$xref/info", tables).count() == 3


def test_errors(tables, cursor):
    with pytest.raises(api.UnknownMethod):
        api.call("no/such", tables)
    with pytest.raises(api.InvalidParams, match="/cursors"):
        api.call("textDocument/hover", tables)
    with pytest.raises(api.InvalidParams, match="/x"):
        api.call("$xref/info", tables, x=1)
    with pytest.raises(api.InvalidParams, match="/field"):
        api.call("workspace/executeCommand", tables, usr=1, field="x")
