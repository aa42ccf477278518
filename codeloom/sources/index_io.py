"""Index documents in and out: JSON records with string-coded ranges, and golden files that embed them.

Reading gives the canonical tables; writing partitions them by a bucket of the file id and replaces only the
partitions that a batch touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import parse_position
from ..schema import KIND_FUNC, KIND_TYPE, KIND_VAR, from_unsigned

U64 = T.DecimalType(20, 0)
_IDS = T.ArrayType(U64)
_TEXTS = T.ArrayType(T.StringType())


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


_COMMON = [
    ("usr", U64), ("detailed_name", T.StringType()), ("qual_name_offset", T.IntegerType()), ("short_name", T.StringType()), ("hover", T.StringType()), ("comments", T.StringType()),
    ("spell", T.StringType()), ("kind", T.IntegerType()), ("parent_kind", T.IntegerType()), ("declarations", _TEXTS), ("uses", _TEXTS), ("derived", _IDS),
]
DOCUMENT = _struct(
    ("includes", T.ArrayType(_struct(("line", T.IntegerType()), ("resolved_path", T.StringType())))),
    ("skipped_ranges", _TEXTS),
    ("usr2func", T.ArrayType(_struct(*_COMMON, ("storage", T.IntegerType()), ("bases", _IDS), ("vars", _IDS), ("callees", _TEXTS)))),
    ("usr2type", T.ArrayType(_struct(*_COMMON, ("bases", _IDS), ("funcs", _IDS), ("types", _IDS), ("instances", _IDS), ("alias_of", U64), ("vars", T.ArrayType(_struct(("L", U64), ("R", T.LongType()))))))),
    ("usr2var", T.ArrayType(_struct(*_COMMON, ("storage", T.IntegerType()), ("type", U64)))),
)
VERSION = 21
KINDS = {"usr2func": KIND_FUNC, "usr2type": KIND_TYPE, "usr2var": KIND_VAR}


def parse(raw: DataFrame, column: str = "json") -> DataFrame:
    """Rows with a JSON document in ``column``; broken documents are dropped. The document's fields stand beside the other columns."""
    parsed = raw.withColumn("_doc", F.from_json(column, DOCUMENT, {"mode": "PERMISSIVE"})).where("_doc is not null and (_doc.usr2func is not null or _doc.usr2type is not null or _doc.usr2var is not null)")
    return parsed.select(*[c for c in raw.columns if c != column], "_doc.*")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached documents: a version line, then the document. Other versions and broken ones are left out."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    cut = raw.select("path", F.split_part("value", F.lit("\n"), F.lit(1)).alias("version"), F.regexp_replace("value", r"^[^\n]*\n", "").alias("json"))
    return parse(cut.where(F.trim("version") == str(VERSION)).drop("version"))


def golden_sections(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, json): the expected documents that golden files hold in a trailing comment; the unnamed one has name ''."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    found = F.regexp_extract_all("value", F.lit(r"(?ms)^OUTPUT:[ \t]*([^\n]*)\n(.*?)(?=^OUTPUT:|^\*/)"), 0)
    one = raw.select("path", F.explode(found).alias("s"))
    return one.select("path", F.trim(F.regexp_extract("s", r"^OUTPUT:[ \t]*([^\n]*)", 1)).alias("name"), F.regexp_replace("s", r"^[^\n]*\n", "").alias("json"))


def golden_flags(spark: SparkSession, path: str) -> DataFrame:
    """(path, flags) of golden files with an EXTRA_FLAGS block: one flag a line up to an empty line."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    block = F.regexp_extract("value", r"(?ms)^EXTRA_FLAGS:\n(.*?)\n\s*\n", 1)
    return raw.where(F.col("value").contains("EXTRA_FLAGS:")).select("path", F.filter(F.transform(F.split(block, "\n"), F.trim), lambda x: x != "").alias("flags"))


def _symbols(docs: DataFrame) -> DataFrame:
    """One row for each symbol of a document, the fields that not all kinds have as nulls."""
    parts = []
    for field, kind in KINDS.items():
        own = docs.select("file_id", F.explode(field).alias("s")).select("file_id", F.lit(kind).alias("ekind"), "s.*")
        for name, t in (("storage", "int"), ("bases", "array<decimal(20,0)>"), ("callees", "array<string>"), ("funcs", "array<decimal(20,0)>"), ("types", "array<decimal(20,0)>"), ("instances", "array<decimal(20,0)>"), ("alias_of", "decimal(20,0)"), ("type", "decimal(20,0)")):
            if name not in own.columns:
                own = own.withColumn(name, F.lit(None).cast(t))
        if kind == KIND_FUNC:
            members = F.transform("vars", lambda v: F.struct(v.alias("L"), F.lit(-1).cast("long").alias("R")))
        elif kind == KIND_TYPE:
            members = F.col("vars")
        else:
            members = F.lit(None).cast("array<struct<L:decimal(20,0),R:bigint>>")
        parts.append(own.withColumn("members", members.cast("array<struct<L:decimal(20,0),R:bigint>>")).drop("vars"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("usr", from_unsigned(F.col("usr")))


def _part(text: Column, n: int) -> Column:
    return F.split_part(text, F.lit("|"), F.lit(n))


def _span(text: Column, name: str) -> list[Column]:
    return [parse_position(F.split_part(text, F.lit("-"), F.lit(i))).alias(f"{name}{end}_p") for i, end in ((1, "start"), (2, "end"))]


def tables(docs: DataFrame) -> dict[str, DataFrame]:
    """Canonical tables of documents with a column ``file_id``."""
    s = _symbols(docs)
    x = F.col("x")
    declared = lambda rows: rows.select("file_id", "usr", "ekind", *_span(_part(x, 1), ""), *_span(_part(x, 2), "ext_"), _part(x, 3).cast("int").alias("role"))
    uses = s.select("file_id", "usr", "ekind", F.posexplode("uses").alias("ord", "x")).select("file_id", "usr", "ekind", "ord", *_span(_part(x, 1), ""), _part(x, 2).cast("int").alias("role"))
    decls = declared(s.select("file_id", "usr", "ekind", F.explode("declarations").alias("x")))
    spells = declared(s.where("spell is not null").select("file_id", "usr", "ekind", F.col("spell").alias("x")))
    null = F.lit(None).cast("long")
    occ = uses.withColumn("ext_start_p", null).withColumn("ext_end_p", null).drop("ord").unionByName(decls).unionByName(spells)
    occ = occ.groupBy("file_id", "usr", "ekind", "role", "start_p", "end_p", "ext_start_p", "ext_end_p").agg(F.count("*").alias("refcnt"))

    def edge(kind: str, column: str) -> DataFrame:
        return s.select("file_id", F.col("usr").alias("src"), F.posexplode(column).alias("ord", "d")).select("file_id", "src", from_unsigned(F.col("d")).alias("dst"), F.lit(kind).alias("etype"), F.lit(None).cast("long").alias("offset_bits"), "ord")

    def single(kind: str, column: str) -> DataFrame:
        return s.where(F.col(column).isNotNull() & (F.col(column) != 0)).select("file_id", F.col("usr").alias("src"), from_unsigned(F.col(column)).alias("dst"), F.lit(kind).alias("etype"), F.lit(None).cast("long").alias("offset_bits"), F.lit(0).alias("ord"))

    callee = s.select("file_id", F.col("usr").alias("src"), F.posexplode("callees").alias("ord", "d")).select("file_id", "src", from_unsigned(_part(F.col("d"), 2)).alias("dst"), F.lit("callee").alias("etype"), F.lit(None).cast("long").alias("offset_bits"), "ord")
    member = s.select("file_id", F.col("usr").alias("src"), F.posexplode("members").alias("ord", "d")).select("file_id", "src", from_unsigned(F.col("d.L")).alias("dst"), F.lit("member").alias("etype"), F.col("d.R").alias("offset_bits"), "ord")
    edges = callee.unionByName(member)
    for kind, column in (("base", "bases"), ("derived", "derived"), ("type_func", "funcs"), ("type_type", "types"), ("instance", "instances")):
        edges = edges.unionByName(edge(kind, column))
    edges = edges.unionByName(single("alias", "alias_of")).unionByName(single("var_type", "type"))
    return {
        "entities": s.select("file_id", "usr", "ekind", "detailed_name", "short_name", "hover", "comments", "kind", "parent_kind", "storage"),
        "uses": uses, "declarations": decls, "spells": spells, "occurrences": occ, "edges": edges,
        "includes": docs.select("file_id", F.explode("includes").alias("i")).select("file_id", "i.line", "i.resolved_path"),
        "skipped_ranges": docs.select("file_id", F.explode("skipped_ranges").alias("x")).select("file_id", *_span(x, "")),
    }


def write(table: DataFrame, path: str, buckets: int = 256) -> None:
    """Replace the partitions of the files in ``table``; the others stay."""
    rows = table.withColumn("bucket", F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int"))
    rows.repartition("bucket").sortWithinPartitions("file_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def stale(cached: DataFrame, seen: DataFrame) -> DataFrame:
    """Files (path, mtime, args) whose cached record is older or has other arguments; an argument that is the file's own stem may differ."""
    own = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    met = seen.select("path", F.col("mtime").alias("now"), F.col("args").alias("now_args")).join(cached.select("path", F.col("mtime").alias("then"), F.col("args").alias("then_args")), "path", "left")
    same = lambda a, b: a.eqNullSafe(b) | (F.regexp_extract(a, r"([^/]*?)(\.[^./]*)?$", 1) == own)
    differ = (F.size("now_args") != F.size("then_args")) | ~F.forall(F.zip_with("now_args", "then_args", same), lambda x: x)
    return met.where(F.col("then").isNull() | (F.col("now") > F.col("then")) | differ).select("path")
