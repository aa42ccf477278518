"""Alignment of two versions of a text: unique lines, propagation to neighbours, lookup of a line and column, edits."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import align_column, insert_delete


def unique_matches(index: DataFrame, buffer: DataFrame) -> DataFrame:
    """(file_id, index_line, buffer_line) of lines that occur once on either side and are equal."""

    def once(rows: DataFrame, name: str) -> DataFrame:
        h = rows.select("file_id", "line", F.xxhash64("content").alias("h"), F.crc32(F.col("content").cast("binary")).alias("c"))
        return h.groupBy("file_id", "h", "c").agg(F.count("*").alias("n"), F.min("line").alias(name)).where("n = 1").drop("n")

    return once(index, "index_line").join(once(buffer, "buffer_line"), ["file_id", "h", "c"]).select("file_id", "index_line", "buffer_line")


def line_map(index: list[str], buffer: list[str]) -> list[int]:
    """Buffer line of each index line, -1 if unsure: unique equal lines, then neighbours downward and upward while lines agree."""
    once = lambda rows: {x: i for i, x in enumerate(rows) if counts[x] == 1}
    counts = Counter(index)
    left = once(index)
    counts = Counter(buffer)
    right = once(buffer)
    out = [right[x] if left.get(x) == i and x in right else -1 for i, x in enumerate(index)]
    for i in range(len(index) - 1):
        j = out[i] + 1
        if 0 < j < len(buffer) and index[i + 1] == buffer[j]:
            out[i + 1] = j
    for i in range(len(index) - 1, 0, -1):
        j = out[i] - 1
        if out[i] > 0 and index[i - 1] == buffer[j]:
            out[i - 1] = j
    return out


def find_line(index: list[str], mapping: list[int], buffer: list[str], line: int, column: int, is_end: bool = False) -> tuple[int, int] | None:
    """Buffer place of an index place. An unsure line takes the closest line between its sure neighbours; none if those cross."""
    to = mapping[line]
    if to < 0:
        low = next((mapping[i] for i in range(line - 1, -1, -1) if mapping[i] >= 0), 0)
        high = next((mapping[i] for i in range(line + 1, len(mapping)) if mapping[i] >= 0), len(buffer) - 1)
        if low > high:
            return None
        distances = [(insert_delete(index[line], buffer[i]), i) for i in range(low, high + 1)]
        best = min(distances)
        to = best[1] if best[0] <= 20 else low
    return to, align_column(index[line], column, buffer[to], is_end)


def remap(index: list[str], buffer: list[str], start: tuple[int, int], end: tuple[int, int]) -> tuple[int, int, int, int] | None:
    """A range in the buffer; an end that comes before its start keeps the range's height. Without an index it stays."""
    if not index:
        return (*start, *end)
    mapping = line_map(index, buffer)
    a, b = find_line(index, mapping, buffer, *start), find_line(index, mapping, buffer, *end, is_end=True)
    if a is None or b is None:
        return None
    if b < a:
        b = (a[0] + end[0] - start[0], b[1])
    return (*a, *b)


def split_lines(text: str) -> list[str]:
    """Lines without their \\n and one \\r before it; no empty line at the end."""
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
    return [x.removesuffix("\r") for x in out]


def apply_edits(text: str, edits: Iterable[tuple[tuple[int, int] | None, tuple[int, int] | None, str]]) -> str:
    """Edits in order: (start, end, new text), or (None, None, text) for the whole."""
    for start, end, new in edits:
        if start is None or end is None:
            text = new
            continue
        starts = [0]
        for line in text.split("\n")[:-1]:
            starts.append(starts[-1] + len(line) + 1)
        place = lambda p: min(len(text), (starts[p[0]] if p[0] < len(starts) else len(text)) + p[1])  # noqa: B023, E731
        text = text[: place(start)] + new + text[place(end) :]
    return text


def line_maps(index: DataFrame, buffer: DataFrame) -> DataFrame:
    """(file_id, index_line, buffer_line) of all lines, file by file: a file's two versions are one task's work."""

    def run(key, left, right):  # noqa: ANN001, ANN202
        import pandas as pd

        a, b = left.sort_values("line")["content"].tolist(), right.sort_values("line")["content"].tolist()
        return pd.DataFrame({"file_id": key[0], "index_line": range(len(a)), "buffer_line": line_map(a, b)})

    return index.groupBy("file_id").cogroup(buffer.groupBy("file_id")).applyInPandas(run, "file_id long, index_line long, buffer_line long")
