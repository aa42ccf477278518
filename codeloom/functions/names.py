"""Names, paths and codecs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that a URI escapes.
URI_ESCAPES = [(" ", "%20"), ("#", "%23"), ("$", "%24"), ("&", "%26"), ("(", "%28"), (")", "%29"), ("+", "%2B"), (",", "%2C"), (";", "%3B"), ("?", "%3F"), ("@", "%40")]
#: Extension to (language, is header).
EXTENSIONS = {
    "c": (0, False), "m": (2, False), "mm": (3, False), "cc": (1, False), "cpp": (1, False), "cxx": (1, False), "cu": (4, False),
    "h": (0, True), "hh": (1, True), "hpp": (1, True), "hxx": (1, True),
}


def stem(path: Column) -> Column:
    """Last path component without its extension."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?/?$", 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./]+)$", 1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def ensure_slash(path: Column) -> Column:
    return F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))


def cache_name(path: Column) -> Column:
    """A flat file name for a path: separators and colons become @."""
    return F.translate(path, "/\\:", "@@@")


def to_uri(path: Column) -> Column:
    for a, b in URI_ESCAPES:
        path = F.replace(path, F.lit(a), F.lit(b))
    return F.concat(F.lit("file://"), path)


def from_uri(uri: Column) -> Column:
    """Path of a file URI; a plus sign stays one."""
    plain = F.when(uri.startswith("file://"), F.substr(uri, F.lit(8))).otherwise(uri)
    return F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))


def map_path(path: Column, mappings: list[str]) -> Column:
    """Each mapping 'from>to' replaces its first occurrence."""
    for m in mappings:
        old, _, new = m.partition(">")
        at = F.locate(old, path)
        path = F.when(at > 0, F.concat(F.substr(path, F.lit(1), at - 1), F.lit(new), F.substr(path, at + len(old)))).otherwise(path)
    return path


def language(path: Column) -> Column:
    """struct<language, is_header> by extension; -1 if unknown."""
    out = F.struct(F.lit(-1).alias("language"), F.lit(False).alias("is_header"))
    ext = extension(path)
    for e, (lang, header) in EXTENSIONS.items():
        out = F.when(ext == e, F.struct(F.lit(lang).alias("language"), F.lit(header).alias("is_header"))).otherwise(out)
    return out


def group_match(text: Column, allow: list[str], deny: list[str]) -> Column:
    """True if an allow pattern is found, else false if a deny pattern is, else true; case does not count."""
    found = lambda ps: F.lit(False) if not ps else text.rlike("(?i)" + "|".join(f"(?:{p})" for p in ps))
    return found(allow) | ~found(deny)


def simplify_anonymous(name: Column) -> Column:
    short = F.replace(name, F.lit("(anonymous namespace"), F.lit("(anon ns"))
    return F.regexp_replace(short, r"\(anonymous \w+", "(anon")


def field_label(bits: Column, name: Column) -> Column:
    """Byte offset, a dot and the bits beyond it if any, two blanks below ten and one from there, the name; only the name without an offset."""
    whole, rest = F.floor(bits / 8), bits % 8
    text = F.concat(whole.cast("string"), F.when(rest > 0, F.concat(F.lit("."), rest.cast("string"))).otherwise(""), F.when(whole < 10, "  ").otherwise(" "), name)
    return F.when(bits < 0, name).otherwise(text)


def format_position(p: Column) -> Column:
    """1-based line:column of a packed position."""
    return F.concat_ws(":", (F.floor(p / 65536) + 1).cast("string"), (F.pmod(p, F.lit(65536)) + 1).cast("string"))


def parse_position(text: Column) -> Column:
    return (F.split_part(text, F.lit(":"), F.lit(1)).cast("long") - 1) * 65536 + F.split_part(text, F.lit(":"), F.lit(2)).cast("long") - 1


def parse_use(text: Column) -> Column:
    """struct of 'l:c-l:c|role|file'."""
    span = F.split_part(text, F.lit("|"), F.lit(1))
    return F.struct(
        parse_position(F.split_part(span, F.lit("-"), F.lit(1))).alias("start_p"), parse_position(F.split_part(span, F.lit("-"), F.lit(2))).alias("end_p"),
        F.split_part(text, F.lit("|"), F.lit(2)).cast("int").alias("role"), F.split_part(text, F.lit("|"), F.lit(3)).cast("long").alias("file_id"),
    )


def subsequence_pattern(pattern: str, sensitivity: int = 1) -> str:
    """A regex for texts that hold the pattern as a subsequence. 0 ignores case, 1 unless the pattern has capitals, 2 never."""
    folded = sensitivity == 0 or (sensitivity == 1 and not any(c.isupper() for c in pattern))
    body = ".*".join(c if c.isalnum() else "\\" + c for c in pattern)
    return ("(?is)" if folded else "(?s)") + body


def identifier_prefix(line: Column, column: Column) -> Column:
    """The identifier characters before a column."""
    return F.regexp_extract(F.substr(line, F.lit(1), column), "([A-Za-z0-9_]*)$", 1)


def zigzag(n: Column) -> Column:
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def comment_text(raw: Column) -> Column:
    """A comment without its markers; the first line's indentation comes off the others as far as they have it."""
    lines = F.split(raw, "\n")
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"\s*\*+/\s*$", ""), r"^\s*(?:/\*+[!<]*|//+[!<]*|\*(?!/))?", ""))
    first = F.length(F.regexp_extract(F.get(bare, F.lit(0)), r"^(\s*)", 1))
    cut = F.transform(bare, lambda x: F.substr(x, F.least(first, F.length(F.regexp_extract(x, r"^(\s*)", 1))) + 1))
    return F.regexp_replace(F.array_join(cut, "\n"), r"^\n+|\s+$", "")


def hover_with_initializer(declaration: Column, initializer: Column, size: Column, most: int, static: Column) -> Column:
    """The declaration, ' = initializer' if its size stays below ``most``, 'static ' in front of statics."""
    return F.concat(F.when(static, "static ").otherwise(""), declaration, F.when(size < most, F.concat(F.lit(" = "), initializer)).otherwise(""))


def under_folder(path: Column, folders: list[tuple[str, str]]) -> Column:
    """The path told by a workspace folder (name, real path) instead of its real path; the first that fits counts."""
    out = path
    for name, real in reversed(folders):
        out = F.when(path.startswith(real), F.concat(F.lit(name), F.substr(path, F.lit(len(real) + 1)))).otherwise(out)
    return out


def available(candidates):  # noqa: ANN001, ANN201
    """Completion candidates (label, accessible) that may be offered: no inaccessible ones, destructors or operators."""
    label = F.col("label")
    return candidates.where(F.col("accessible") & ~label.startswith("~") & ~label.startswith("operator"))
