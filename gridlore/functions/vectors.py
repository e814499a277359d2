"""Column functions over array<float> embeddings.

All sums are in double.  A result that has no value is NULL; NaN never reaches a
comparison, as Spark orders NaN above every number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-12
FILL_BYTE = -128
FILL = -9999.0
SCALE = 127.5


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(e: Column | str) -> Column:
    return _col(e).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products; NULL if either is NULL; an error for different sizes."""
    a, b = _col(a), _col(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in their number of bands")).cast("double")).otherwise(total)


def norm(a: Column | str) -> Column:
    """Euclidean length, at least EPS so that dividing by it is safe."""
    a = _col(a)
    return F.greatest(F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(EPS))


def normalise(a: Column | str) -> Column:
    """The vector at unit length; a zero vector stays zero."""
    a = _col(a)
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / n)


def cosine(a: Column | str, b: Column | str) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine, from 0 to 2; 1 where a vector is zero."""
    return F.lit(1.0) - cosine(a, b)


def euclidean_distance(a: Column | str, b: Column | str) -> Column:
    """Plain distance, without normalising."""
    a, b = _col(a), _col(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in their number of bands")).cast("double")).otherwise(F.sqrt(total))


_DISTANCES = {"cosine": cosine_distance, "euclidean": euclidean_distance}


def distance(a: Column | str, b: Column | str, metric: str = "cosine") -> Column:
    """Distance by the metric's name (case and space around it do not matter)."""
    name = metric.strip().lower()
    if name not in _DISTANCES:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(_DISTANCES)}")
    return _DISTANCES[name](a, b)


def finite(x: Column | str) -> Column:
    """True for numbers that are neither NULL, NaN nor infinite."""
    x = _col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or_null(x: Column | str) -> Column:
    x = _col(x).cast("double")
    return F.when(finite(x), x)


def valid(e: Column | str, nodata: float | None = None) -> Column:
    """All bands finite and, where a no-data value is set, at least one band different from it."""
    e = as_double(e)
    ok = F.forall(e, finite)
    if nodata is not None and nodata == nodata:
        ok = ok & F.exists(e, lambda x: x != F.lit(float(nodata)))
    return F.coalesce(ok, F.lit(False))


def masked(value: Column | str, ok: Column) -> Column:
    """The value where ok, else NULL."""
    return F.when(ok, _col(value))


def band(e: Column | str, number: int, nodata: float | None = None) -> Column:
    """Band `number` (from 1); no-data and NaN become NULL, a band out of range is an error."""
    e = _col(e)
    value = finite_or_null(F.get(e, F.lit(number - 1)))
    if nodata is not None and nodata == nodata:
        value = F.nullif(value, F.lit(float(nodata)))
    return F.when((F.size(e) < number) | F.lit(number < 1), F.raise_error(F.lit(f"no band {number}")).cast("double")).otherwise(value)


def null_nodata(e: Column | str, nodata: float | None) -> Column:
    """Each element equal to the no-data value, or not finite, as NULL."""
    clean = F.transform(as_double(e), finite_or_null)
    return clean if nodata is None else F.transform(clean, lambda x: F.nullif(x, F.lit(float(nodata))))


def quantise(e: Column | str) -> Column:
    """Signed bytes, value * 127.5 rounded half to even and held within -127..127; NULL or NaN is the fill byte."""
    return F.transform(_col(e), lambda x: F.when(finite(x), F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.rint(x.cast("double") * F.lit(SCALE))))).otherwise(F.lit(float(FILL_BYTE))).cast("tinyint"))


def dequantise(q: Column | str) -> Column:
    """Floats from signed bytes; the fill byte becomes the no-data value, element by element."""
    return F.transform(_col(q), lambda x: F.when(x == F.lit(FILL_BYTE), F.lit(FILL)).otherwise(x.cast("double") / F.lit(SCALE)).cast("float"))


def to_sentinel(value: Column | str, sentinel: float, kind: str = "float") -> Column:
    """What a sink writes where the engine has NULL."""
    return F.coalesce(_col(value), F.lit(sentinel)).cast(kind)
