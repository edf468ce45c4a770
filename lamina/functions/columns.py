"""Column expressions: labels, guarded arithmetic, finite filters, natural order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that stand for "no cluster".
IGNORED_LABELS = ("unassigned", "nan", "none", "null")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def canonical_label(c: Column | str) -> Column:
    """Trimmed text; whole numbers lose a trailing ``.0``; null and NaN become empty."""
    t = F.regexp_replace(F.trim(col(c).cast("string")), r"^(\d+)\.0$", "$1")
    return F.when(t.isNull() | (F.lower(t) == "nan"), "").otherwise(t)


def loose_label(c: Column | str) -> Column:
    """A canonical label after a ``cluster``, ``cluster_`` or ``c`` prefix goes; any whole number is written without a fraction."""
    t = F.regexp_replace(F.lower(F.trim(col(c).cast("string"))), r"^(cluster[_ ]?|c(?=\d))", "")
    n = t.try_cast("double")
    return F.when(n.isNotNull() & (n == F.floor(n)), n.cast("bigint").cast("string")).otherwise(canonical_label(t))


def is_cluster(c: Column | str) -> Column:
    return ~F.lower(F.trim(col(c))).isin(*IGNORED_LABELS) & (F.trim(col(c)) != "")


def natural_key(c: Column | str) -> Column:
    """Text whose order puts digit runs by value: each run is padded to 12 places."""
    runs = F.regexp_extract_all(col(c), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(r, 12, "0")).otherwise(r)), "")


def finite(c: Column | str) -> Column:
    """Not null, NaN or infinite."""
    x = col(c)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def rounded(c: Column | str, places: int) -> Column:
    """As SQL rounds doubles: a whole number of steps over a power of ten, halves away from zero."""
    r = F.round(col(c) * float(10**places)) / float(10**places)
    return F.when(r == 0, col(c) * 0.0).otherwise(r)  # what is rounded to zero keeps its sign


def ratio(n: Column | str, d: Column | str) -> Column:
    """n / d, null where the denominator is about zero."""
    return F.when(F.abs(col(d)) > 1e-9, col(n) / col(d))


def ratio_or_zero(n: Column | str, d: Column | str) -> Column:
    return F.coalesce(F.try_divide(col(n), col(d)), F.lit(0.0))


def pair(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    """Two labels in order."""
    return F.least(col(a), col(b)), F.greatest(col(a), col(b))


def truthy(c: Column | str) -> Column:
    return F.lower(F.trim(col(c).cast("string"))).isin("true", "1", "yes", "y")


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
