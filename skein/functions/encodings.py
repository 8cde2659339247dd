"""Byte forms of keys and values, as Columns: order-preserving escapes, decimals, base64 of URLs, variant paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LATIN = "ISO-8859-1"

#: Escapes within a quoted name of a variant path. Control characters have their short form where there is one.
_ESCAPE = r"\\(?:[bfnrt'\\]|u00(?:0[0-7bef]|1[0-9a-f]))"
_PATH = rf"^\$(?:\[(?:'(?:[^'\\\x00-\x1F]|{_ESCAPE})*'|0|[1-9][0-9]{{0,15}})\])*$"
_LARGEST_INDEX, _LONGEST_PATH, _DEEPEST_PATH = 2**53 - 1, 4096, 32


def escaped(key: Column) -> Column:
    """A binary key as a part of a longer one, in the same order: 00 becomes 00 FF, and 00 00 ends it."""
    text = F.decode(key, _LATIN)
    return F.encode(F.concat(F.replace(text, F.lit("\0"), F.lit("\0\xff")), F.lit("\0\0")), _LATIN)


def unscaled(value: Column, precision: int) -> Column:
    """The whole number of a big-endian two's complement of any length; null if it is empty or has over `precision` digits."""
    if not 1 <= precision <= 38:
        raise ValueError("a decimal has 1 to 38 digits")
    text = F.hex(value)
    negative = F.substring(text, 1, 1) >= "8"
    sign = F.when(negative, "FF").otherwise("00")
    wide = F.concat(F.repeat(sign, F.greatest(F.lit(0), 16 - F.octet_length(value))), text)
    extra = F.length(wide) - 32
    fits = (F.substring(wide, F.lit(1), extra) == F.repeat(sign, (extra / 2).cast("int"))) & ((F.substring(wide, extra + 1, F.lit(1)) >= "8") == negative)
    plain = F.when(negative, F.translate(wide, "0123456789ABCDEF", "FEDCBA9876543210")).otherwise(wide)  # of x < 0, -x - 1
    low = F.conv(F.substring(plain, -16, 16), 16, 10).cast("decimal(38,0)")
    high = F.conv(F.substring(F.substring(plain, -32, 32), 1, 16), 16, 10).cast("decimal(38,0)")
    size = F.try_add(_times(high, F.lit(str(2**64)).cast("decimal(38,0)")), low)
    whole = F.when(negative, F.try_subtract(F.lit(-1).cast("decimal(38,0)"), size)).otherwise(size)  # a unary minus rounds to 34 digits
    end = "1" + "0" * precision
    inside = (whole < F.lit(end).cast("decimal(38,0)")) & (whole > F.lit(f"-{end}").cast("decimal(38,0)")) if precision < 38 else whole.isNotNull()
    return F.when((F.octet_length(value) > 0) & fits & inside, whole)


def _times(a: Column, b: Column) -> Column:
    return F.try_multiply(a, b).cast("decimal(38,0)")


def base64url(value: Column) -> Column:
    """Base64 of URLs, without padding."""
    return F.rtrim(F.translate(F.replace(F.base64(value), F.lit("\r\n"), F.lit("")), "+/", "-_"), F.lit("="))


def from_base64url(text: Column) -> Column:
    plain = F.translate(text, "-_", "+/")
    return F.unbase64(F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.length(plain), F.lit(4)))))


def normalized_path(path: Column) -> Column:
    """Whether a variant bound's path is in normal form: $ and bracketed names or indexes."""
    steps = F.regexp_extract_all(path, F.lit(r"\[(?:'(?:[^'\\]|\\.)*'|[0-9]+)\]"), F.lit(0))
    indexes = F.transform(F.filter(steps, lambda s: ~s.startswith("['")), lambda s: F.substring(s, F.lit(2), F.length(s) - 2).try_cast("long"))
    small = F.forall(indexes, lambda i: F.coalesce(i <= _LARGEST_INDEX, F.lit(False)))
    return F.coalesce(path.rlike(_PATH) & (F.octet_length(path) <= _LONGEST_PATH) & (F.size(steps) <= _DEEPEST_PATH) & small, F.lit(False))


def checked_sum(a: Column, b: Column) -> Column:
    """a + b as a long; null where that overflows."""
    return F.try_add(a.cast("long"), b.cast("long"))
