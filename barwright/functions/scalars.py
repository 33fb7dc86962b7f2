"""Scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")


def free_name(columns: list[str], name: str) -> str:
    """The name, with as many underscores behind as it takes to clash with no column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: str | Column, places: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(col(c), places) + F.lit(0.0)


def clean_key(c: str | Column) -> Column:
    return F.upper(F.trim(col(c)))


#: Exchange codes of the listing files.
EXCHANGES = {
    "A": "AMEX",
    "N": "NYSE",
    "P": "NYSEARCA",
    "Z": "BATS",
    "V": "IEXG",
}


def exchange_of(code: str | Column) -> Column:
    """The exchange of a code, `OTHER` for one that isn't known or is missing."""
    lookup = F.create_map(*(F.lit(x) for kv in EXCHANGES.items() for x in kv))
    return F.coalesce(F.try_element_at(lookup, F.upper(F.trim(col(code)))), F.lit("OTHER"))


def to_bool(c: str | Column) -> Column:
    """Words and 1/0 to booleans; anything else is NULL. Fractions of a numeric column are cut off, so 1.0 is true."""
    c = col(c)
    word = F.lower(F.trim(c.cast("string")))
    word = F.when(F.typeof(c).rlike("^(double|float|decimal)"), F.regexp_replace(word, r"^(-?\d+)\.\d*$", "$1")).otherwise(word)
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS, "-0"), F.lit(False))


def sample_key(ticker: str | Column, date: str | Column, setup: str | Column) -> Column:
    """16 hex digits that name a (ticker, date, setup); NULL if one of them is."""
    bar = F.lit("|")
    return F.substring(F.sha1(F.concat(F.upper(col(ticker)), bar, col(date).cast("string"), bar, col(setup)).cast("binary")), 1, 16)


def no_nan(c: str | Column) -> Column:
    """NaN as NULL: NULL is the only missing value in this library."""
    return F.when(~F.isnan(col(c)), col(c))


def ratio(a: str | Column, b: str | Column) -> Column:
    """a / b; NULL if b is 0 or either is NULL."""
    return F.try_divide(col(a), col(b))


def log_ratio(a: str | Column, b: str | Column) -> Column:
    """ln(a / b) of positive numbers, else NULL."""
    a, b = col(a), col(b)
    return F.when((a > 0) & (b > 0), F.ln(a / b))


def clean_token(c: str | Column) -> Column:
    """Letters, digits, `_`, `.` and `-`; each other character becomes `_`, none stays at the ends."""
    return F.regexp_replace(F.regexp_replace(col(c), r"[^\p{L}\p{N}_.\-]", "_"), "^_+|_+$", "")


def ticker_bucket(c: str | Column) -> Column:
    first = F.upper(F.substring(col(c), 1, 1))
    return F.when(F.coalesce(first, F.lit("")) == "", F.lit("_")).otherwise(first)


def vendor_symbol(c: str | Column, style: str) -> Column:
    """A vendor's spelling of a ticker: `us_lower` (brk-b -> brk.b.us) or `dashed` (BRK.B -> BRK-B)."""
    if style == "us_lower":
        return F.concat(F.lower(F.replace(F.trim(col(c)), F.lit("-"), F.lit("."))), F.lit(".us"))
    return F.upper(F.replace(F.trim(col(c)), F.lit("."), F.lit("-")))
