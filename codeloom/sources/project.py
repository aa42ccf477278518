"""Build descriptions: compile commands, flag files, argument filters, and the entry that a path resolves to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fuzzy import batched, path_similarity
from ..functions.names import language

#: Options left out with the argument that follows them, and on their own.
DROP_WITH_NEXT = ["-MF", "-MT", "-MQ", "-MJ", "-o", "-Xclang"]
DROP = ["-c", "-M", "-MM", "-MD", "-MG", "-MMD", "-MP", "-MV", "-MFT"]


def filter_args(args: Column, globs: tuple[str, ...] = ()) -> Column:
    """Arguments without those that only steer output; the fold remembers whether the next one goes with its option."""
    drop = lambda x: x.isin(*DROP) | reduce(lambda a, g: a | x.rlike("^" + g.replace(".", "\\.").replace("*", ".*").replace("?", ".") + "$"), globs, F.lit(False))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("skip"))

    def step(a: Column, x: Column) -> Column:
        next_ = x.isin(*DROP_WITH_NEXT)
        keep = ~a["skip"] & ~next_ & ~drop(x)
        return F.struct(F.when(keep, F.concat(a["out"], F.array(x))).otherwise(a["out"]).alias("out"), (~a["skip"] & next_).alias("skip"))

    return F.aggregate(args, start, step, lambda a: a["out"])


def directives(args: Column, path: Column) -> Column:
    """Arguments behind %-tags stay, without the tags, if a tag names the file's language (%c, %cpp, %objective-c, %objective-cpp, %cu) or its being a header (%h, %hpp)."""
    lang = language(path)
    tags = {"%c": (0, None), "%h": (0, True), "%cpp": (1, None), "%hpp": (1, True), "%objective-c": (2, None), "%objective-cpp": (3, None), "%cu": (4, None)}

    def fits(tag: Column) -> Column:
        out = F.lit(False)
        for t, (n, header) in tags.items():
            out = out | ((tag == t) & (lang["language"] == n) & (F.lit(True) if header is None else lang["is_header"]))
        return out

    words = lambda x: F.split(x, " ")
    tagged = lambda x: F.filter(words(x), lambda w: w.startswith("%"))
    keep = F.filter(args, lambda x: ~x.startswith("%") | F.exists(tagged(x), fits))
    return F.transform(keep, lambda x: F.array_join(F.filter(words(x), lambda w: ~w.startswith("%")), " "))


def absolute(directory: Column, name: Column) -> Column:
    """A path made absolute, with '.' and '..' taken out."""
    joined = F.when(name.startswith("/"), name).otherwise(F.concat_ws("/", directory, name))
    parts = F.filter(F.split(joined, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def compile_commands(spark: SparkSession, path: str, globs: tuple[str, ...] = ()) -> DataFrame:
    """(filename, directory, args): the first command of each file."""
    raw = spark.read.schema("directory string, file string, command string, arguments array<string>").option("multiLine", "true").json(path)
    args = F.coalesce("arguments", F.filter(F.split("command", r"\s+"), lambda x: x != ""))
    rows = raw.select(absolute(F.col("directory"), F.col("file")).alias("filename"), "directory", filter_args(args, globs).alias("args"), F.monotonically_increasing_id().alias("ord"))
    return rows.groupBy("filename").agg(F.min_by(F.struct("directory", "args"), "ord").alias("b")).select("filename", "b.directory", "b.args")


def flag_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(folder, args) of every flag file below a root: an argument a line, lines with # in front and empty ones left out.

    Spark's readers pass over names that start with a dot or an underscore, so such flag files need another name.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
    lines = F.filter(F.transform(F.split("value", "\n"), F.trim), lambda x: (x != "") & ~x.startswith("#"))
    return raw.select(F.regexp_extract(F.input_file_name(), "^(.*/)[^/]*$", 1).alias("folder"), lines.alias("args"))


def best_guess(paths: DataFrame, entries: DataFrame) -> DataFrame:
    """For each path without an entry the entry (filename, args) most like it; another language costs 30. Candidates share the folder's last
    name; where none does, the entry of the least name stands in."""
    folder = lambda p: F.element_at(F.concat(F.array(F.lit("")), F.split(p, "/")), -2)
    open_ = paths.join(entries.select(F.col("filename").alias("path")), "path", "left_anti")
    own = entries.select("filename", "args", folder(F.col("filename")).alias("folder"))
    likeness = batched(path_similarity, "int")(F.col("path"), F.col("filename"))
    same = language(F.col("path"))["language"] == language(F.col("filename"))["language"]
    met = open_.withColumn("folder", folder(F.col("path"))).join(own, "folder").withColumn("score", likeness - F.when(same, 0).otherwise(30))
    best = met.groupBy("path").agg(F.max_by(F.struct("filename", "args"), F.struct("score", F.col("filename"))).alias("b")).select("path", "b.filename", "b.args")
    least = entries.agg(F.min_by(F.struct("filename", "args"), "filename").alias("b"))
    rest = open_.join(best.select("path"), "path", "left_anti").join(least, F.lit(True)).select("path", "b.filename", "b.args")  # one row on the right
    return best.unionByName(rest)


def resolve(paths: DataFrame, entries: DataFrame, flags: DataFrame) -> DataFrame:
    """(path, args): the exact entry, else the deepest flag file above the path, else the best guess; the flag file's arguments follow the entry's."""
    exact = paths.join(entries.select(F.col("filename").alias("path"), F.col("args").alias("own")), "path", "left")
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    near = paths.where(F.size(parts) > 1).select("path", F.explode(up).alias("folder")).join(flags.withColumnRenamed("args", "extra"), "folder")
    near = near.groupBy("path").agg(F.max_by("extra", F.length("folder")).alias("extra"))
    met = exact.join(near, "path", "left")
    none = met.where("own is null and extra is null").select("path")
    guess = best_guess(none, entries).select("path", F.col("args").alias("guess"))
    empty = F.array().cast("array<string>")
    return met.join(guess, "path", "left").select("path", F.concat(F.coalesce("own", "guess", empty), F.coalesce("extra", empty)).alias("args"))


def first_per_file(entries: DataFrame, order: str) -> DataFrame:
    """The first entry of each file by ``order``."""
    return entries.withColumn("_n", F.row_number().over(Window.partitionBy("filename").orderBy(order))).where("_n = 1").drop("_n")
