"""Vector arithmetic as Column expressions: all of it stays in the JVM. Sums are taken in double precision.

SURVEY ids: M1-M7, M13-M17, A9-A11, O1, O5, P1-P3, P11-P13, W9, F7, F8.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values that must equal the specification's.
FLOAT_EPSILON = 1.1920928955078125e-07
NORM_FLOOR = 9.999
PEAK_FLOOR = 0.01
INT16_SCALE = 32767.0


def let(value, use) -> Column:
    """``use(value)`` with the value computed once, not again for each element of the array that ``use`` maps."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def doubles(v) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def total(v) -> Column:
    """Sum of an array in its own order."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a, b) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(v) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a, b, eps: float = FLOAT_EPSILON) -> Column:
    """Similarity; the denominator is at least ``eps``, so a zero vector is similar to none."""
    return dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(eps))


def cosine_distance(a, b) -> Column:
    """1 - similarity; an error for vectors of unequal length or of zero norm."""
    return (
        F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double"))
        .when((norm(a) == 0) | (norm(b) == 0), F.raise_error(F.lit("a vector is zero")).cast("double"))
        .otherwise(1 - dot(a, b) / (norm(a) * norm(b)))
    )


def euclidean(a, b) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))))


def l2_normalised(v) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(doubles(v)))


def log_add(a: Column, b: Column) -> Column:
    """log(exp(a) + exp(b)) without overflow."""
    return F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b)))


def log_sum_exp(v) -> Column:
    return let(F.array_max(v), lambda top: top + F.log(total(F.transform(v, lambda x: F.exp(x - top)))))


def log_softmax(v) -> Column:
    return let(log_sum_exp(v), lambda s: F.transform(v, lambda x: x - s))


def argmax(v) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def top_indices(v, k: int) -> Column:
    """0-based places of the k largest, descending; ties to the lower place."""
    pairs = F.transform(v, lambda x, i: F.struct((-x).alias("key"), i.alias("i")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: p["i"])


def rint(x: Column) -> Column:
    """Round half to even."""
    return F.rint(x)


def to_int16(v, rounding: bool = True) -> Column:
    """x * 32767 as short: rounded half away from zero, or truncated. Not clamped."""
    return F.transform(v, lambda x: (F.round(x.cast("double") * INT16_SCALE) if rounding else x.cast("double") * INT16_SCALE).cast("int").cast("short"))


def from_int16(v) -> Column:
    return F.transform(v, lambda x: x.cast("double") / 32768)


def scaled(v, factor: float) -> Column:
    return F.transform(v, lambda x: x.cast("double") * factor)


def pre_emphasis(v, coefficient: float, keep_first: bool) -> Column:
    """x[i] - c x[i-1]; the first element is kept, or scaled by 1 - c."""
    first = lambda x: x if keep_first else x * (1 - coefficient)
    d = doubles(v)
    return F.transform(d, lambda x, i: F.when(i == 0, first(x)).otherwise(x - coefficient * F.get(d, i - 1)))


def min_max_scaled(v) -> Column:
    ends = F.struct(F.array_min(v).cast("double").alias("low"), F.array_max(v).cast("double").alias("high"))
    return let(ends, lambda e: F.transform(v, lambda x: F.when(e["high"] > e["low"], (x.cast("double") - e["low"]) / (e["high"] - e["low"])).otherwise(0.0)))


def floor_normalised(v, floor: float = NORM_FLOOR) -> Column:
    """Divided by the L2 norm, which counts as ``floor`` at least."""
    return let(F.greatest(norm(v), F.lit(floor)), lambda n: F.transform(v, lambda x: x.cast("double") / n))


def peak_int16(v) -> Column:
    """Scaled so that the peak is full scale (a peak counts as 0.01 at least), clamped to 16 bits."""
    scale = INT16_SCALE / F.greatest(F.lit(PEAK_FLOOR), F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))))
    return let(scale, lambda s: F.transform(v, lambda x: F.greatest(F.lit(-32767.0), F.least(F.lit(32767.0), x.cast("double") * s)).cast("short")))


def log_mel_normalised(v) -> Column:
    """log10 of at least 1e-10, not more than 8 below the maximum, then (x + 4) / 4."""
    logs = F.transform(v, lambda x: F.log10(F.greatest(x.cast("double"), F.lit(1e-10))))
    return let(logs, lambda own: let(F.array_max(own) - 8, lambda floor: F.transform(own, lambda x: (F.greatest(x, floor) + 4) / 4)))


def cmvn(v, negative_mean, inverse_std) -> Column:
    return F.zip_with(F.zip_with(v, negative_mean, lambda x, m: x.cast("double") + m), inverse_std, lambda x, s: x * s)


def mean(v) -> Column:
    return total(doubles(v)) / F.size(v)


def standardised(v) -> Column:
    """(x - mean) / (std + 1e-5), population deviation."""
    deviation = lambda m: F.sqrt(total(F.transform(v, lambda x: F.pow(x.cast("double") - m, F.lit(2)))) / F.size(v))
    return let(mean(v), lambda m: let(deviation(m) + 1e-5, lambda d: F.transform(v, lambda x: (x.cast("double") - m) / d)))


def padded(v, length: int, value: float) -> Column:
    return F.concat(v, F.array_repeat(F.lit(value), F.greatest(F.lit(0), F.lit(length) - F.size(v))))


def cropped(v, start: Column, length: int) -> Column:
    """``length`` elements from 0-based ``start`` (which may be negative), zeros outside."""
    return F.transform(F.sequence(start, start + (length - 1)), lambda i: F.when((i >= 0) & (i < F.size(v)), F.get(v, i.cast("int")).cast("double")).otherwise(0.0))


def compacted(v, mask) -> Column:
    """The elements under a true mask first, zeros behind, same length."""
    kept = F.transform(F.filter(F.arrays_zip(v.alias("x"), mask.alias("m")), lambda p: p["m"]), lambda p: p["x"].cast("double"))
    return F.concat(kept, F.array_repeat(F.lit(0.0), F.size(v) - F.size(kept)))


def upsampled_mask(weights, length: int, threshold: float = 0.5) -> Column:
    """Nearest frame for each of ``length`` samples, as booleans of weight > threshold."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda j: F.get(weights, F.floor(j * F.size(weights) / length).cast("int")) > threshold)


def mel(frequency: Column) -> Column:
    return 1127.0 * F.log1p(frequency / 700.0)


def mel_inverse(m: Column) -> Column:
    return 700.0 * F.expm1(m / 1127.0)
