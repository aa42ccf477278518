"""The canonical tables and their constants.

Positions are packed as line * 65536 + column in a BIGINT, ranges are half-open pairs of them. Symbol ids are
unsigned 64-bit numbers held in BIGINT by two's complement; ``unsigned_order`` gives their unsigned order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the data model.
KIND_INVALID, KIND_FILE, KIND_TYPE, KIND_FUNC, KIND_VAR = 0, 1, 2, 3, 4
ROLE = {"declaration": 1, "definition": 2, "reference": 4, "read": 8, "write": 16, "call": 32, "dynamic": 64, "address": 128, "implicit": 256, "all": 511}
SYMBOL_KIND = {
    "unknown": 0, "file": 1, "module": 2, "namespace": 3, "package": 4, "class": 5, "method": 6, "property": 7, "field": 8, "constructor": 9, "enum": 10,
    "interface": 11, "function": 12, "variable": 13, "constant": 14, "string": 15, "number": 16, "boolean": 17, "array": 18, "object": 19, "key": 20, "null": 21,
    "enum_member": 22, "struct": 23, "event": 24, "operator": 25, "type_parameter": 26, "type_alias": 252, "parameter": 253, "static_method": 254, "macro": 255,
}
STORAGE_NONE, STORAGE_AUTO, STORAGE_REGISTER = 0, 4, 5
LANGUAGE = {"c": 0, "cpp": 1, "objc": 2, "objcpp": 3, "cuda": 4}
LINE = 65536
#: Default role mask that an outline leaves out: all but definition, declaration and dynamic.
OUTLINE_EXCLUDES = ROLE["all"] - ROLE["definition"] - ROLE["declaration"] - ROLE["dynamic"]
CAP_RESULTS, CAP_SYMBOLS, CAP_COMPLETION, WAIT_MS = 2000, 1000, 100, 5000
HIGHLIGHT_BYTES = 2 * 1024 * 1024

#: Equality of uses ignores the role.
USE_KEY = ("file_id", "start_p", "end_p")
OCC_KEY = ("file_id", "usr", "ekind", "role", "start_p", "end_p", "ext_start_p", "ext_end_p")

OCCURRENCES = T.StructType([
    T.StructField("file_id", T.LongType()), T.StructField("usr", T.LongType()), T.StructField("ekind", T.IntegerType()), T.StructField("role", T.IntegerType()),
    T.StructField("start_p", T.LongType()), T.StructField("end_p", T.LongType()), T.StructField("ext_start_p", T.LongType()), T.StructField("ext_end_p", T.LongType()),
    T.StructField("refcnt", T.LongType()),
])


def pack(line: Column, column: Column) -> Column:
    """Line and column as one number; lines stop at 65535 and columns at 32767."""
    return F.least(line.cast("long"), F.lit(65535)) * LINE + F.least(column.cast("long"), F.lit(32767))


def line_of(p: Column) -> Column:
    return F.floor(p / LINE).cast("long")


def column_of(p: Column) -> Column:
    return F.pmod(p, F.lit(LINE)).cast("long")


def unsigned_order(usr: Column) -> Column:
    """A BIGINT that sorts as the unsigned id does."""
    return usr.bitwiseXOR(F.lit(-(2**63)))


def from_unsigned(text: Column) -> Column:
    """BIGINT of an unsigned decimal (string or decimal(20,0))."""
    n = text.cast("decimal(20,0)")
    return F.when(n >= F.lit("9223372036854775808").cast("decimal(20,0)"), (n - F.lit("18446744073709551616").cast("decimal(20,0)"))).otherwise(n).cast("long")


def to_unsigned(usr: Column) -> Column:
    """decimal(20,0) of an id."""
    n = usr.cast("decimal(20,0)")
    return F.when(n < 0, n + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(n).cast("decimal(20,0)")


def has_roles(role: Column, want: int, without: int = 0) -> Column:
    """All bits of ``want`` and none of ``without``."""
    return (role.bitwiseAND(F.lit(want)) == want) & (role.bitwiseAND(F.lit(without)) == 0)
