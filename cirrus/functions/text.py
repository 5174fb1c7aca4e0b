"""String column builders (T1–T13). Each is `f(col, **params) -> Column`,
built from Spark's JVM string functions and higher-order array functions so
it stays inside whole-stage codegen. Null stays null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cirrus.functions.common import col

# Characters Python's str.strip() removes (fixed values): ASCII controls
# \t \n \v \f \r, \x1c-\x1f, space, NEL, NBSP and the Unicode spaces.
WHITESPACE_CLASS = (r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]")


def truncate(c, length: int = 50, ellipsis: bool = False) -> Column:
    """Cut to `length` characters, adding `...` only when cut."""
    x = col(c)
    cut = F.substring(x, 1, length)
    if ellipsis:
        cut = F.concat(cut, F.lit("..."))
    return F.when(F.length(x) > length, cut).otherwise(x)


def extract(c, start: int = 0, length: int = 10) -> Column:
    """Python slice `value[start:start+length]` (0-based, negative start
    counts from the end)."""
    x = col(c)
    n = F.length(x)
    end = start + length

    def norm(i: int) -> Column:
        if i < 0:
            return F.greatest(n + F.lit(i), F.lit(0))
        return F.least(F.lit(i), n)

    s, e = norm(start), norm(end)
    return x.substr(s + 1, F.greatest(e - s, F.lit(0)))


def remove_chars(c, chars: str = "") -> Column:
    """Delete every character listed in `chars`."""
    return F.translate(col(c), chars, "") if chars else col(c)


def upper(c) -> Column:
    """T4."""
    return F.upper(col(c))


def lower(c) -> Column:
    """T5/T12."""
    return F.lower(col(c))


def title(c) -> Column:
    """Python `str.title()` — a cased character is upper-cased when the
    previous character is not cased, lower-cased otherwise (so `o'neil
    foo-bar` → `O'Neil Foo-Bar`, unlike `initcap`). Higher-order functions
    on the character array, no Python UDF."""
    x = col(c)
    chars = F.split(x, "")
    cased = lambda ch: F.upper(ch) != F.lower(ch)
    out = F.transform(chars, lambda ch, i: F.when(
        (i == 0) | ~cased(F.get(chars, i - 1)), F.upper(ch)).otherwise(F.lower(ch)))
    return F.when(x.isNotNull(), F.array_join(out, ""))


def capitalize(c) -> Column:
    """First character upper, the rest lower."""
    x = col(c)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, 2, 2147483647)))


def trim_ws(c, side: str = "both") -> Column:
    """Strip all whitespace as Python does (`trim` strips spaces only)."""
    x = col(c)
    if side == "left":
        return F.regexp_replace(x, f"^{WHITESPACE_CLASS}+", "")
    if side == "right":
        return F.regexp_replace(x, f"{WHITESPACE_CLASS}+$", "")
    return F.regexp_replace(x, f"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$", "")


def split_part(c, separator: str = ",", part: int = 0) -> Column:
    """Split on the literal separator, take part `part` (negative from the
    end), strip it; out of range → ''."""
    x = col(c)
    pattern = "\\Q" + separator + "\\E"
    parts = F.split(x, pattern, -1)
    n = F.size(parts)
    k = F.lit(part) if part >= 0 else n + F.lit(part)
    picked = trim_ws(F.element_at(parts, (k + 1).cast("int")))
    return F.when(x.isNull(), F.lit(None).cast("string")).when(
        (k >= 0) & (k < n), picked).otherwise(F.lit(""))


def pad(c, length: int = 10, char: str = "0", direction: str = "left") -> Column:
    """rjust/ljust — values already long enough are unchanged
    (`lpad` alone would cut them)."""
    x = col(c)
    padded = F.lpad(x, length, char) if direction == "left" else F.rpad(x, length, char)
    return F.when(F.length(x) < length, padded).otherwise(x)


def apply(c, operation: str, **params) -> Column:
    """Dispatch of the text manipulation operations by name."""
    op = operation.lower()
    if op == "truncate":
        return truncate(c, params.get("length", 50), params.get("ellipsis", False))
    if op == "extract":
        return extract(c, params.get("start", 0), params.get("length", 10))
    if op == "remove_chars":
        return remove_chars(c, params.get("chars", ""))
    if op == "case":
        kind = params.get("type", "upper")
        return {"upper": upper, "lower": lower, "title": title, "capitalize": capitalize}[kind](c)
    if op == "trim":
        return trim_ws(c, params.get("type", "both"))
    if op == "split":
        return split_part(c, params.get("separator", ","), params.get("part", 0))
    if op == "pad":
        return pad(c, params.get("length", 10), params.get("char", "0"), params.get("direction", "left"))
    raise ValueError(f"unknown text operation: {operation}")
