"""Delta algebra, alignment and sweep properties."""

import random

from pyspark.sql import functions as F

from codeloom.operators import align, delta, graph, locate, order, tokens


def test_apply_of_create_is_the_new_state(spark):
    random.seed(3)
    key = ("file_id", "usr")
    make = lambda n: [(random.randint(1, 3), random.randint(1, 9)) for _ in range(n)]
    for n, m in ((30, 25), (0, 10), (10, 0)):
        a, b = (spark.createDataFrame(make(k), "file_id long, usr long") for k in (n, m))
        state = a.groupBy(*key).agg(F.count("*").alias("refcnt"))
        got = {tuple(r) for r in delta.apply(state, delta.create(a, b, key), key).collect()}
        assert got == {tuple(r) for r in b.groupBy(*key).agg(F.count("*")).collect()}


def test_remove_takes_every_equal_row(spark):
    rows = spark.createDataFrame([(1, 2, 4), (1, 2, 8), (1, 3, 4)], "file_id long, start_p long, role int")
    assert [tuple(r) for r in delta.remove(rows, rows.where("role = 4 and start_p = 2"), ["file_id", "start_p"]).collect()] == [(1, 3, 4)]


def test_debounce_is_a_fold(spark):
    rows = [(1, i, t) for i, t in enumerate([0, 10, 99, 100, 150, 260])] + [(2, 9, 5)]
    got = delta.debounced(spark.createDataFrame(rows, "path long, seq long, at long"), 100)
    assert sorted((r["path"], r["at"]) for r in got.collect()) == [(1, 0), (1, 100), (1, 260), (2, 5)]


def test_line_map_and_lookup():
    index = ["a", "x", "b", "{", "c", "}", "d"]
    buffer = ["new", "a", "x", "b", "{", "cc", "}", "d"]
    assert align.line_map(index, buffer) == [1, 2, 3, 4, -1, 6, 7]
    assert align.find_line(index, align.line_map(index, buffer), buffer, 4, 0) == (5, 0)
    assert align.line_map(["a", "a"], ["a", "a"]) == [-1, -1]
    assert align.line_map(["a", "u", "a"], ["a", "u", "a"]) == [0, 1, 2]
    assert align.remap([], buffer, (1, 2), (1, 4)) == (1, 2, 1, 4)
    assert align.remap(index, buffer, (0, 0), (2, 1)) == (1, 0, 3, 1)


def test_line_maps_match_the_function(spark):
    a = spark.createDataFrame([(1, i, x) for i, x in enumerate("abcab")], "file_id long, line long, content string")
    b = spark.createDataFrame([(1, i, x) for i, x in enumerate("abxcab")], "file_id long, line long, content string")
    got = [r["buffer_line"] for r in align.line_maps(a, b).orderBy("index_line").collect()]
    assert got == align.line_map(list("abcab"), list("abxcab"))


def test_edits():
    assert align.apply_edits("one\ntwo\n", [((1, 0), (1, 3), "2"), ((0, 3), (1, 0), " ")]) == "one 2\n"
    assert align.apply_edits("x", [(None, None, "new"), ((5, 0), (6, 0), "!")]) == "new!"
    assert align.split_lines("a\r\nb\n") == ["a", "b"]
    assert align.split_lines("") == []


def test_segments_are_disjoint_and_cover(spark):
    random.seed(1)
    rows = [(1, s, s + random.randint(1, 20), i) for i, s in enumerate(random.choices(range(50), k=15))]
    got = sorted((r["lo"], r["hi"], r["scope_id"]) for r in tokens.disjoint_segments(spark.createDataFrame(rows, "file_id long, start_p long, end_p long, scope_id long")).collect())
    assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))
    want = {p: min((e - s, -s, i) for _, s, e, i in rows if s <= p < e)[2] for p in range(80) if any(s <= p < e for _, s, e, _ in rows)}
    assert {p: i for lo, hi, i in got for p in range(lo, hi)} == want


def test_binned_scopes_equal_unbinned(spark):
    random.seed(2)
    scopes = spark.createDataFrame([(f, s, s + random.randint(0, 900), i) for i, (f, s) in enumerate((random.randint(1, 2), random.randint(0, 2000)) for _ in range(60))], "file_id long, start_p long, end_p long, scope_id long")
    uses = spark.createDataFrame([(random.randint(1, 2), p, p, p) for p in range(0, 2500, 7)], "file_id long, start_p long, end_p long, use_id long")
    plain, binned = (sorted(map(tuple, locate.scope_of(uses, scopes, ["use_id"], b).collect())) for b in (None, 100))
    assert plain == binned
    assert plain


def test_closure_of_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    got = {(r["node"], r["level"]) for r in graph.closure(spark.createDataFrame([(1,)], "root long"), edges).collect()}
    assert got == {(2, 1), (3, 2), (4, 3)}


def test_full_tree_goes_to_the_last_level_and_refuses_cycles(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 25)] + [(1, 3)], "src long, dst long")
    got = graph.full_tree(spark.createDataFrame([(1,)], "root long"), chain)
    assert got.agg(F.max("level")).first()[0] == 24
    assert got.where("node = 25").count() == 2  # two ways lead there


def test_ranked_numbers_all_rows(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("x"), F.col("id").alias("_range_"))
    got = {r["x"]: r["ord"] for r in order.ranked(df, "x").collect()}
    assert got == {i: i + 1 for i in range(1000)}
    assert order.ranked(df.limit(0), "x").count() == 0
