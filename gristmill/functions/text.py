"""Text expressions with the white-space and word rules of Python strings, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str.split`` sees it. Fixed values.
WS = r"[\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_SPACES = [(0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
_CHARS = "".join(chr(i) for a, b in _SPACES for i in range(a, b + 1))
_RARE = WS.replace(r"\x{1C}-\x{20}", r"\x{1C}-\x{1F}")
# Characters below U+1680 that are no white space but the plain space: texts of these alone skip the slow class.
_OTHER = r"[^\x{20}-\x{7E}\x{A1}-\x{167F}]"
_W = r"[\p{L}\p{N}_]"
_EDGE = rf"(?:(?<!{_W})(?={_W})|(?<={_W})(?!{_W}))"
#: An e-mail address between Unicode word boundaries.
EMAIL = rf"{_EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}{_EDGE}"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_CHARS))


def fold(c: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    for common in "\n\r\t":
        c = F.replace(c, F.lit(common), F.lit(" "))
    plain = let(c, lambda x: F.when(x.rlike(_OTHER), F.regexp_replace(x, _RARE, " ")).otherwise(x))
    single = let(plain, lambda x: F.when(x.contains("  "), F.regexp_replace(x, r"\x20{2,}+", " ")).otherwise(x))
    return F.btrim(single, F.lit(" "))


def blank(c: Column) -> Column:
    """Null or nothing but white space."""
    return c.isNull() | ~c.rlike(f"[^{WS[1:]}")


def has_email(c: Column) -> Column:
    return c.contains("@") & c.rlike(EMAIL)


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often f uses it; keeps plans small."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _lower_escapes(json: Column) -> Column:
    fixed = json
    for upper in "ABCDEF":
        fixed = F.regexp_replace(fixed, rf"(?<!\\)((?:\\\\)*)\\u00([01]){upper}", rf"$1\\u00$2{upper.lower()}")
    return F.when(json.rlike(r"\\u00[01][A-F]"), fixed).otherwise(json)


def canonical_json(c: Column) -> Column:
    """JSON of a struct with alphabetical fields: no nulls, no spaces, lower-case control escapes."""
    return let(F.to_json(c), _lower_escapes)


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def isclose(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= F.greatest(F.lit(1e-9) * F.greatest(F.abs(a), F.abs(b)), F.lit(tolerance))


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
