"""Small column expressions; all run inside code generation."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- dates -------------------------------------------------------------------------------

def month_end(year: ColumnLike, month: ColumnLike) -> Column:
    """Year and month numbers to the last day of that month."""
    return F.last_day(F.make_date(col(year), col(month), F.lit(1)))


def month_index(d: ColumnLike) -> Column:
    """Whole months since January 1970, the time axis of every trend."""
    return ((F.year(col(d)) - 1970) * 12 + F.month(col(d)) - 1).cast("double")


def days_in_month(d: ColumnLike) -> Column:
    return F.day(F.last_day(col(d)))


def parse_month(text: str) -> date:
    """'MM-YYYY' to the first day of that month."""
    return datetime.strptime(text, "%m-%Y").date()


# ---- missing values ----------------------------------------------------------------------

def finite(c: ColumnLike) -> Column:
    """NaN and infinities to NULL."""
    c = col(c)
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def sanitize(df: DataFrame) -> DataFrame:
    """Apply :func:`finite` to every floating-point column."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[finite(F.col(f"`{n}`")).alias(n) if n in floats else F.col(f"`{n}`")
                       for n in df.columns])


# ---- coordinates -------------------------------------------------------------------------

def round_coord(c: ColumnLike, decimals: int = 3) -> Column:
    """Halves go to the even neighbour, as in NumPy."""
    scale = F.lit(10.0 ** decimals)
    return F.rint(col(c) * scale) / scale


def wrap_lon(c: ColumnLike) -> Column:
    """Longitudes of any range to [-180, 180)."""
    return F.pmod(col(c) + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


# ---- recoding ----------------------------------------------------------------------------

def recode(c: ColumnLike, mapping: dict, keep_unknown: bool = False) -> Column:
    """Literal lookup; unknown values become NULL, or stay when ``keep_unknown``."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.try_element_at(pairs, col(c))
    return F.coalesce(found, col(c)) if keep_unknown else found


# ---- reproducible draws ------------------------------------------------------------------

def hash_key(seed: ColumnLike | int, *keys: ColumnLike) -> Column:
    """md5 of the seed and the keys: the same on any partitioning."""
    s = F.lit(str(seed)) if isinstance(seed, int) else col(seed).cast("string")
    return F.md5(F.concat_ws("|", s, *[col(k).cast("string") for k in keys]).cast("binary"))


def uniform(seed: ColumnLike | int, *keys: ColumnLike) -> Column:
    """Uniform draw in (0, 1) from the first 52 bits of :func:`hash_key`."""
    bits = F.conv(F.substring(hash_key(seed, *keys), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(4503599627370496.0)


# ---- arithmetic --------------------------------------------------------------------------

def ratio(a: ColumnLike, b: ColumnLike) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(col(a), col(b))


def r2_from_sums(n: Column, ss_res: Column, ss_tot: Column) -> Column:
    """1 - SS_res/SS_tot; NULL below two points; a constant truth scores 1 if met exactly, else 0."""
    constant = F.when(ss_res == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return (F.when(n < 2, F.lit(None).cast("double"))
            .when(ss_tot == 0, constant)
            .otherwise(1 - ratio(ss_res, ss_tot)))
