"""Numbers read from printed text, and repairs of common misreadings. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keratoline.functions.dates import trimmed


def number(text: Column) -> Column:
    """A double of digits with an optional sign and point; null of anything else."""
    return F.nullif(F.regexp_extract(text, r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)\z", 0), F.lit("")).try_cast("double")


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


# Character and unit rules for measurement tokens, in order.
_REPAIRS = [
    (",", "."), ("[oO]", "0"), (r"(?<![A-Za-z])Z(?=[0-9.])", "7"), (r"~-?([0-9])", "-$1"), (r"\.{2,}", "."),
]
_UNITS = [(r"[pµu]m\z", ""), (r"(?U)\s*mm[23³]?\z", ""), (r"(?U)\s*[dD]\z", "")]
# What is left becomes the number alone: a lone fraction, a fraction that lost its
# point, a number split before its point, a number with a point.
_READ = [
    (r"^\.([0-9]+)\z", "0.$1"), (r"^[(\[]*0([0-9]+)\z", "0.$1"), (r"(?s)^.*?(-?[0-9]+)(?U:\s+)\.([0-9]+).*\z", "$1.$2"), (r"(?s)^.*?(-?[0-9]+\.[0-9]+).*\z", "$1"),
]


def extract_numeric(text: Column) -> Column:
    """The first number of a printed token, with common misreadings undone; null if there is none.

    A lone fraction gets its zero, a number that starts with zero is a fraction,
    digits split from their fraction are joined, and a number with a point goes
    before a whole one. One chain of replacements, so its code stays short.
    """
    s = text
    for pattern, to in _REPAIRS:
        s = F.regexp_replace(s, pattern, to)
    s = trimmed(s)
    for pattern, to in _UNITS:
        s = F.regexp_replace(s, pattern, to)
    s = trimmed(s)
    for pattern, to in _READ:
        s = F.regexp_replace(s, pattern, to)
    return _first(s, r"-?[0-9]+\.?[0-9]*").try_cast("double")


def signed_number(text: Column) -> Column:
    """The first signed number of a token of the ectasia page, without its unit."""
    s = F.regexp_replace(F.regexp_replace(text, "−", "-"), ",", ".")
    for unit in (r"(?i)(?U)\s*[µμu]m\z", r"(?i)(?U)\s*mm\z", r"(?U)\s*[dD]\z", r"[°*]\z"):
        s = F.regexp_replace(s, unit, "")
    return number(_first(s, r"[-+]?[0-9]+\.?[0-9]*"))


def quality_code(text: Column) -> Column:
    """0 for OK, 1 for SUSPECT or A, 2 for ABNORMAL; null otherwise."""
    s = F.upper(trimmed(text))
    return F.when(s == "OK", 0.0).when(s.isin("SUSPECT", "A"), 1.0).when(s == "ABNORMAL", 2.0)


def token(text: Column, lead: str = "", trail: str = "") -> Column:
    """The first word, without the given characters at its ends."""
    s = F.regexp_extract(text, r"(?U)(\S+)", 1)
    if lead:
        s = F.regexp_replace(s, f"^[{lead}]+", "")
    return F.regexp_replace(s, f"[{trail}]+\\z", "") if trail else s


def _shifted(tok: Column, pattern: str, groups: tuple[int, ...] = (1,)) -> Column:
    """The number that a pattern's groups make, the second after a point."""
    parts = [_first(tok, pattern, g) for g in groups]
    return number(parts[0] if len(parts) == 1 else F.concat(parts[0], F.lit("."), parts[1]))


def fix_coordinate(value: Column, tok: Column, digits: Column) -> Column:
    """tok: the first word without brackets; digits: its digits without sign and point."""
    near = lambda c: F.when(F.abs(c) <= 5, c)
    sign = F.when(F.startswith(tok, F.lit("+")), 1.0).otherwise(-1.0)
    spread = near(number(F.regexp_replace(digits, r"^([0-9])([0-9]+)\z", "$1.$2"))) * sign
    far = F.coalesce(-near(_shifted(tok, r"^[0-9]([0-9]\.[0-9]+)\z")), F.when(F.length(digits) > 1, spread), value)
    return F.coalesce(-near(_shifted(tok, r"^1\+([0-9]+\.[0-9]+)\z")), F.when(F.abs(value) > 3, far).otherwise(value))


def fix_back_power(value: Column, tok: Column) -> Column:
    read = F.coalesce(_shifted(tok, r"^1([0-9]+\.[0-9]+)\z"), _shifted(tok, r"^1?([0-9])([0-9])\z", (1, 2)), F.abs(value))
    return F.when(value > 0, -read).otherwise(value)


def fix_front_power(value: Column, tok: Column) -> Column:
    read = F.coalesce(_shifted(tok, r"^1([3-9][0-9]\.[0-9]+)\z"), _shifted(tok, r"^([3-9][0-9])([0-9]{1,2})\z", (1, 2)), value)
    return F.when(value > 100, read).otherwise(value)


def fix_astigmatism(value: Column, tok: Column) -> Column:
    one = number(F.concat(F.lit("1."), _first(tok, r"^1([1-9])\z", 1)))
    tenth = number(F.concat(F.lit("0."), _first(tok, r"^10([0-9])(?:\.[0-9]*)?\z", 1)))
    return (
        F.when((value > 10) & (value < 11), value - 10)
        .when((value >= 11) & (value <= 20), F.coalesce(_shifted(tok, r"^1([0-9]\.[0-9]+)\z"), one, value))
        .when((value >= 100) & (value < 120), F.coalesce(tenth, value))
        .when((value < 0) & F.startswith(tok, F.lit("1-")), F.abs(value))
        .otherwise(value)
    )


def fix_asphericity(value: Column) -> Column:
    rest = value % 10
    return F.when(value > 5, F.when(rest <= 2.5, -rest).otherwise(-(value - 10))).otherwise(value)


def fix_spurious_digit(value: Column, tok: Column, above: float, pattern: str) -> Column:
    return F.when(value > above, F.coalesce(_shifted(tok, pattern), value)).otherwise(value)


def fix_thickness(value: Column) -> Column:
    last = F.rint(value).cast("bigint") % 1000
    fits = (value >= 1000) & (value < 10000) & (F.rint(value) < 10000) & last.between(300, 700)
    return F.when(fits, last.cast("double")).otherwise(value)


_POWERS = ("K1", "K2", "Km")
_RADII = ("Rf", "Rs", "Rm", "Rmin", "Rper")
_EXTRA = r"^1([0-9]\.[0-9]+)\z"


def repair(rows: DataFrame, field: str = "field", value: str = "value", raw: str = "raw_text") -> DataFrame:
    """Rows with `value` repaired. All rules in one projection: each reads its own measurement only, so their order is of no matter."""
    f, v = F.col(field), F.col(value)
    with_tokens = rows.withColumn("__word", token(F.col(raw))).withColumns({
        "__bare": F.regexp_replace("__word", r"^[(\[]+|\)+\z", ""), "__power": F.regexp_replace("__word", r"[dD]+\z", ""), "__size": F.regexp_replace("__word", r"[mM]+\z", ""), "__both": F.regexp_replace("__word", r"[dDmM]+\z", ""),
    }).withColumn("__digits", F.regexp_extract(F.regexp_replace("__bare", r"^[+-]*([0-9]*)\.?([0-9]*)\z", "$1$2"), r"^[0-9]+\z", 0))
    coordinates = [f"{t}_{p}" for t in ("PupilCenter", "PachyVertex", "Thinnest", "Kmax") for p in "xy"]
    fixed = (
        F.when(f.isin(coordinates), fix_coordinate(v, F.col("__bare"), F.col("__digits")))
        .when(f.isin([f"{k}_back" for k in _POWERS]), fix_back_power(v, F.col("__power")))
        .when(f.isin([*(f"{k}_front" for k in _POWERS), "Kmax"]), fix_front_power(v, F.col("__power")))
        .when(f.isin("Astig_front", "Astig_back"), fix_astigmatism(v, F.col("__power")))
        .when(f.isin("Qval_front", "Qval_back"), fix_asphericity(v))
        .when(f.isin([f"{r}_{s}" for r in _RADII for s in ("front", "back")]), fix_spurious_digit(v, F.col("__size"), 12, r"^[0-9]([4-9]\.[0-9]+)\z"))
        .when(f == "PupilDia", fix_spurious_digit(v, F.col("__both"), 10, _EXTRA))
        .when(f == "AC_depth", fix_spurious_digit(v, F.col("__size"), 10, _EXTRA))
        .when(f.isin("Thinnest", "PachyVertex", "PupilCenter"), fix_thickness(v))
        .otherwise(v)
    )
    return with_tokens.select(*[fixed.alias(c) if c == value else F.col(c) for c in rows.columns])
