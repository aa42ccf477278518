"""Index documents, golden files, build descriptions."""

import json

from pyspark.sql import functions as F

from codeloom import schema
from codeloom.functions import names
from codeloom.sources import index_io, project

BIG = 2**63 + 5
DOC = {
    "includes": [{"line": 0, "resolved_path": "/p/b.h"}],
    "skipped_ranges": ["2:1-4:7"],
    "usr2func": [{
        "usr": BIG, "detailed_name": "void f()", "short_name": "f", "kind": 12, "parent_kind": 1, "storage": 0, "declarations": [], "spell": "1:6-1:7|1:1-1:20|2|-1",
        "bases": [], "vars": [7], "callees": ["1:12-1:13|9|3|36"], "derived": [], "uses": ["3:1-3:2|36|-1", "5:1-5:2|4|-1"],
    }],
    "usr2type": [{"usr": 9, "detailed_name": "struct S {}", "short_name": "S", "kind": 23, "parent_kind": 1, "declarations": [], "bases": [], "funcs": [], "types": [], "vars": [{"L": 7, "R": 64}], "alias_of": 0, "derived": [], "instances": [7], "uses": []}],
    "usr2var": [{"usr": 7, "detailed_name": "int x", "short_name": "x", "type": 9, "kind": 13, "parent_kind": 12, "storage": 0, "declarations": ["8:1-8:2|8:1-8:5|1|-1"], "uses": []}],
}


def test_golden_files_to_tables(spark, tmp_path):
    (tmp_path / "a.cc").write_text(f"int x;\n/*\nEXTRA_FLAGS:\n-std=c++17\n-Wall\n\nOUTPUT: b.h\n{json.dumps(DOC)}\nOUTPUT:\n{json.dumps(DOC)}\n*/\n")
    sections = index_io.golden_sections(spark, str(tmp_path))
    assert sorted(r["name"] for r in sections.collect()) == ["", "b.h"]
    assert index_io.golden_flags(spark, str(tmp_path)).first()["flags"] == ["-std=c++17", "-Wall"]
    t = index_io.tables(index_io.parse(sections.where("name = ''").withColumn("file_id", F.lit(1).cast("long"))))
    signed = BIG - 2**64
    assert {r["usr"] for r in t["entities"].collect()} == {signed, 9, 7}
    assert {(r["src"], r["dst"], r["etype"], r["offset_bits"]) for r in t["edges"].collect()} == {
        (signed, 9, "callee", None), (signed, 7, "member", -1), (9, 7, "member", 64), (9, 7, "instance", None), (7, 9, "var_type", None),
    }
    assert {(r["usr"], r["role"], r["start_p"], r["ext_end_p"]) for r in t["occurrences"].collect()} == {
        (signed, 2, 5, 19), (signed, 36, 2 * 65536, None), (signed, 4, 4 * 65536, None), (7, 1, 7 * 65536, 7 * 65536 + 4),
    }
    assert t["skipped_ranges"].first()["end_p"] == 3 * 65536 + 6


def test_cache_versions(spark, tmp_path):
    for name, text in (("a", f"21\n{json.dumps(DOC)}"), ("b", f"20\n{json.dumps(DOC)}"), ("c", "21\nnot json"), ("d", "")):
        (tmp_path / name).write_text(text)
    assert [r["path"][-1] for r in index_io.read_cache(spark, str(tmp_path)).select("path").collect()] == ["a"]


def test_write_replaces_touched_files_only(spark, tmp_path):
    path = str(tmp_path / "t")
    index_io.write(spark.createDataFrame([(1, 10), (2, 20)], "file_id long, usr long"), path, 64)
    index_io.write(spark.createDataFrame([(2, 21)], "file_id long, usr long"), path, 64)
    assert sorted((r["file_id"], r["usr"]) for r in spark.read.parquet(path).collect()) == [(1, 10), (2, 21)]


def test_stale(spark):
    schema_ = "path string, mtime long, args array<string>"
    cached = spark.createDataFrame([("/a/x.cc", 5, ["cc", "x.cc"]), ("/a/y.cc", 5, ["cc"]), ("/a/z.cc", 5, ["cc", "-O1"])], schema_)
    seen = spark.createDataFrame([("/a/x.cc", 5, ["cc", "../x.cc"]), ("/a/y.cc", 6, ["cc"]), ("/a/z.cc", 5, ["cc", "-O2"]), ("/a/n.cc", 1, [])], schema_)
    assert sorted(r["path"] for r in index_io.stale(cached, seen).collect()) == ["/a/n.cc", "/a/y.cc", "/a/z.cc"]


def test_compile_commands(spark, tmp_path):
    rows = [
        {"directory": "/p/b", "file": "../a.cc", "arguments": ["cc", "-c", "-MF", "dep", "-O2", "-Xclang", "-foo", "a.cc", "-MMD", "-Wx"]},
        {"directory": "/p", "file": "/p/a.cc", "command": "cc second"},
        {"directory": "/p", "file": "b.cc", "command": "cc  -o b.o b.cc"},
    ]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    got = {r["filename"]: r["args"] for r in project.compile_commands(spark, str(tmp_path / "c.json"), ("-W*",)).collect()}
    assert got == {"/p/a.cc": ["cc", "-O2", "a.cc"], "/p/b.cc": ["cc", "b.cc"]}


def test_flag_files_and_resolution(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "flags.txt").write_text("# note\n-I.\n\n")
    (tmp_path / "sub" / "flags.txt").write_text("%cpp -std=c++17\n%c -std=c99\n-DX\n")
    flags = project.flag_files(spark, str(tmp_path), "flags.txt")
    got = {r["folder"].rstrip("/").rsplit("/", 1)[-1]: r["args"] for r in flags.collect()}
    assert got["sub"] == ["%cpp -std=c++17", "%c -std=c99", "-DX"]
    args = flags.where("folder like '%sub/'").select(project.directives(F.col("args"), F.lit("/a/b.cc")).alias("a")).first()["a"]
    assert args == ["-std=c++17", "-DX"]
    entries = spark.createDataFrame([("/p/sub/a.cc", ["A"]), ("/q/sub/b.c", ["B"])], "filename string, args array<string>")
    own = spark.createDataFrame([("/p/", ["-P"]), ("/p/sub/", ["-S"])], "folder string, args array<string>")
    paths = spark.createDataFrame([("/p/sub/a.cc",), ("/p/z.cc",), ("/q/sub/bb.cc",), ("/none/x.cc",)], "path string")
    got = {r["path"]: r["args"] for r in project.resolve(paths, entries, own).collect()}
    assert got == {"/p/sub/a.cc": ["A", "-S"], "/p/z.cc": ["-P"], "/q/sub/bb.cc": ["B"], "/none/x.cc": ["A"]}


def test_unsigned_ids(spark):
    df = spark.createDataFrame([(str(x),) for x in (0, 1, 2**63 - 1, 2**63, 2**64 - 1)], "t string").withColumn("u", schema.from_unsigned(F.col("t")))
    assert [r["t"] for r in df.orderBy(schema.unsigned_order(F.col("u"))).collect()] == [str(x) for x in (0, 1, 2**63 - 1, 2**63, 2**64 - 1)]
    assert all(r["t"] == str(r["back"]) for r in df.withColumn("back", schema.to_unsigned(F.col("u"))).collect())


def test_paths(spark):
    df = spark.createDataFrame([("a b#c+d%",)], "p string")
    row = df.select(names.to_uri(F.col("p")).alias("u"), project.absolute(F.lit("/x/y"), F.lit("../z/./w")).alias("a")).first()
    assert (row["u"], row["a"]) == ("file://a%20b%23c%2Bd%", "/x/z/w")
