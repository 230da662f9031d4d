"""Arrays of arrays (time x features) as columns: joining, stacking, selecting and padding. SURVEY ids: U2, U3, F10-F13, F19.

Everything is a JVM expression over one row; a null matrix gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _checked(ok: Column, value: Column, message: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast("array<array<double>>"))


def concatenated(a, b, dim: int = 0) -> Column:
    """Two matrices one after another (dim 0: the rows must be equally long) or side by side (dim 1: there must be equally many)."""
    if dim == 0:
        whole = F.concat(a, b)
        return F.when(a.isNotNull() & b.isNotNull(), _checked(F.size(F.array_distinct(F.transform(whole, lambda r: F.size(r)))) <= 1, whole, "rows differ in length"))
    return F.when(a.isNotNull() & b.isNotNull(), _checked(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: F.concat(x, y)), "numbers of rows differ"))


def stacked(*vectors) -> Column:
    """Equally long vectors on a new first dimension."""
    whole = F.array(*vectors)
    return _checked(F.size(F.array_distinct(F.transform(whole, lambda r: F.size(r)))) <= 1, whole, "vectors differ in length")


def unbound(rows: DataFrame, matrix: str) -> DataFrame:
    """One row per row of the matrix: ``part`` and ``slice``, a matrix of that one row, so the dimension is kept."""
    others = [c for c in rows.columns if c != matrix]
    return rows.select(*others, F.posexplode(matrix).alias("part", "one")).select(*others, "part", F.array("one").alias("slice"))


def repeated(matrix, splits) -> Column:
    """Row i as often as splits[i + 1] - splits[i] says; ``splits`` has one entry more than there are rows."""
    times = lambda i: F.get(splits, i + 1) - F.get(splits, i)
    return F.flatten(F.transform(matrix, lambda r, i: F.array_repeat(r, times(i).cast("int"))))


def index_selected(matrix, index) -> Column:
    """The rows at the places that ``index`` lists, in its order; a place outside is an error."""
    return F.transform(index, lambda i: F.element_at(matrix, i + 1))


def frame_at(matrix, t) -> Column:
    """The row at place t, or null beyond the end."""
    return F.get(matrix, t)


def tail_padded(matrix, most: int = 3000, least_padding: int = 50, padding: int = 50) -> Column:
    """At most ``most`` - ``least_padding`` frames, then ``padding`` frames of zeros, ``most`` together at most.

    Recognisers of fixed context use 50 for one language, 300 for several, or a configured number.
    """
    kept = F.slice(matrix, 1, most - least_padding)
    zeros = F.transform(F.get(matrix, F.lit(0)), lambda x: x * 0)
    room = F.least(F.lit(padding), F.lit(most) - F.size(kept))
    return F.when(F.size(matrix) > 0, F.concat(kept, F.array_repeat(zeros, room))).otherwise(matrix)
