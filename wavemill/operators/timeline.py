"""Scores of overlapping chunks to labelled intervals, all in DataFrame operations.

SURVEY ids: A1-A3, A12-A14, A16, W1, W4-W7, O4, O7, O8, T13, P6-P8, J9, F14.

Scores are rows (chunk, frame, class, score): long form makes reshaping and transposing needless, and the shuffle key of
each step is what it groups by.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ONSET = 0.5442333667381752
EPSILON = 1e-12
NOT_ASSIGNED = -2


@dataclass(frozen=True)
class Geometry:
    """A sliding window: frame or chunk k covers [start + k step, start + k step + duration)."""

    start: float
    step: float
    duration: float

    def frame_at(self, time: Column) -> Column:
        return F.rint(F.greatest(F.lit(0.0), (time - self.start - 0.5 * self.duration) / self.step)).cast("long")

    def middle(self, k: Column) -> Column:
        return self.start + k * self.step + 0.5 * self.duration


def binarised(scores: DataFrame, onset: float = ONSET, offset: float | None = None, initial: bool = False) -> DataFrame:
    """``active``: on above the onset, off below the offset; anything between inherits the last state of its chunk and class, at first ``initial``."""
    offset = onset if offset is None else offset
    state = F.when(F.col("score") > onset, True).when(F.col("score") < offset, False)
    before = Window.partitionBy("chunk", "class").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return scores.withColumn("active", F.coalesce(F.last(state, ignorenulls=True).over(before), F.lit(initial)))


def without_overlaps(scores: DataFrame) -> DataFrame:
    """``clean``: the score where fewer than two classes of a frame are active, else 0."""
    together = F.sum("score").over(Window.partitionBy("chunk", "frame"))
    return scores.withColumn("clean", F.when(together < 2, F.col("score")).otherwise(0.0))


def mask_choice(scores: DataFrame, least: int) -> DataFrame:
    """``mask``: of each chunk and class the clean scores if they sum to more than ``least``, else all."""
    enough = F.sum("clean").over(Window.partitionBy("chunk", "class")) > least
    return scores.withColumn("mask", F.when(enough, F.col("clean")).otherwise(F.col("score")))


def global_frame(chunk: Column, frame: Column, chunks: Geometry, frames: Geometry) -> Column:
    return frames.frame_at(chunks.start + chunk * chunks.step) + frame


def overlap_added(scores: DataFrame, chunks: Geometry, frames: Geometry, skip_average: bool = False, missing: float | None = None, total_chunks: int | None = None) -> DataFrame:
    """Chunk scores on the global frame axis: frame, class, value.

    The sum of scores over the chunks that cover a frame, divided by how many do (unless ``skip_average``). NaN and null scores don't count.
    Frames that no score covers, up to the end of the last of ``total_chunks`` chunks, have the value ``missing``.
    """
    good = F.col("score").isNotNull() & ~F.isnan("score")
    placed = scores.select(global_frame(F.col("chunk"), F.col("frame"), chunks, frames).alias("frame"), "class", F.when(good, F.col("score")).otherwise(0.0).alias("score"), good.cast("double").alias("mask"))
    summed = placed.groupBy("frame", "class").agg(F.sum("score").alias("sum"), F.sum("mask").alias("n"), F.max("mask").alias("any"))
    value = F.col("sum") if skip_average else F.col("sum") / F.greatest(F.col("n"), F.lit(EPSILON))
    found = summed.select("frame", "class", F.when(F.col("any") > 0, value).otherwise(F.lit(missing)).alias("value"))
    if total_chunks is None:
        return found
    last = int(round((chunks.duration + (total_chunks - 1) * chunks.step + chunks.start - frames.start - 0.5 * frames.duration) / frames.step)) + 1
    axis = scores.sparkSession.range(last).withColumnRenamed("id", "frame").crossJoin(scores.select("class").distinct())
    return axis.join(found, ["frame", "class"], "left").select("frame", "class", F.coalesce("value", F.lit(missing)).alias("value"))


def active_count(binary: DataFrame, chunks: Geometry, frames: Geometry, frames_per_chunk: int, trim: float = 0.1) -> DataFrame:
    """Active classes per global frame, half to even; a tenth of each chunk is left out at either end."""
    cut = int(frames_per_chunk * trim)
    inner = binary.where(F.col("frame").between(cut, frames_per_chunk - cut - 1))
    counts = inner.groupBy("chunk", "frame").agg(F.sum(F.col("active").cast("double")).alias("score")).withColumn("class", F.lit(0))
    return overlap_added(counts, chunks, frames, missing=0.0).select("frame", F.rint("value").cast("long").alias("count"))


def cluster_maxima(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """Local classes to clusters: the maximum over the classes of a chunk that share one. clusters: chunk, class, cluster (-2: none)."""
    known = clusters.where(F.col("cluster") != NOT_ASSIGNED)
    return scores.join(known, ["chunk", "class"]).groupBy("chunk", "frame", F.col("cluster").alias("class")).agg(F.max("score").alias("score"))


def inactive_as_unassigned(binary: DataFrame, clusters: DataFrame) -> DataFrame:
    """clusters, with -2 for the classes that are active in no frame of their chunk."""
    ever = binary.groupBy("chunk", "class").agg(F.max("active").alias("ever"))
    return clusters.join(ever, ["chunk", "class"], "left").select("chunk", "class", F.when(F.coalesce("ever", F.lit(False)), F.col("cluster")).otherwise(F.lit(NOT_ASSIGNED)).alias("cluster"))


def top_per_frame(activations: DataFrame, counts: DataFrame) -> DataFrame:
    """``on``: whether a class is among the ``count`` strongest of its frame; ties to the lower class."""
    place = F.row_number().over(Window.partitionBy("frame").orderBy(F.desc("value"), "class"))
    return activations.join(counts, "frame").withColumn("on", place <= F.col("count")).drop("count")


def reconstructed(scores: DataFrame, clusters: DataFrame, counts: DataFrame, chunks: Geometry, frames: Geometry) -> DataFrame:
    """Global clusters per frame: maxima per cluster, summed over chunks, and the strongest ``count`` of each frame."""
    summed = overlap_added(cluster_maxima(scores, clusters), chunks, frames, skip_average=True, missing=0.0)
    return top_per_frame(summed, counts)


def mean_activity(scores: DataFrame, skip: int = 200) -> DataFrame:
    """Mean score per chunk and class after the first ``skip`` frames."""
    return scores.where(F.col("frame") >= skip).groupBy("chunk", "class").agg(F.avg("score").alias("activity"))


def change_points(activity: DataFrame, stream: str, order: str, least: float = 0.2) -> DataFrame:
    """Rows (class, activity: the strongest of a chunk) above ``least`` whose class differs from the one reported before; class 0 counts as reported at first."""
    heard = activity.where(F.col("activity") > least)
    before = F.coalesce(F.lag("class").over(Window.partitionBy(stream).orderBy(order)), F.lit(0))
    return heard.withColumn("before", before).where(F.col("class") != F.col("before")).drop("before")


def on_off_intervals(frames: DataFrame, geometry: Geometry, onset: float, offset: float | None = None, by: tuple[str, ...] = ("class",), value: str = "value") -> DataFrame:
    """Intervals (start, end) in which a class is on: they open above the onset and close below the offset, at the middle of that frame; an open one closes at the last frame."""
    offset = onset if offset is None else offset
    state = F.when(F.col(value) > onset, True).when(F.col(value) < offset, False)
    order = Window.partitionBy(*by).orderBy("frame")
    held = frames.withColumn("on", F.coalesce(F.last(state, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))
    edged = held.withColumn("opens", F.col("on") & ~F.coalesce(F.lag("on").over(order), F.lit(False))).withColumn("next", F.lead("frame").over(order))
    runs = edged.withColumn("run", F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("on")
    ends = runs.groupBy(*by, "run").agg(F.min("frame").alias("first"), F.max(F.coalesce("next", "frame")).alias("last"))
    return ends.select(*by, geometry.middle(F.col("first")).alias("start"), geometry.middle(F.col("last")).alias("end")).where("end > start")


def merged_intervals(intervals: DataFrame, collar: float, by: tuple[str, ...] = ("class",)) -> DataFrame:
    """Intervals of a track joined while the gap is less than the collar (overlapping: gap 0; so a collar of 0 joins nothing)."""
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.greatest(F.lit(0.0), F.col("start") - reach)
    new = (reach.isNull() | (gap >= collar)).cast("int")
    islands = intervals.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def without_short(intervals: DataFrame, least: float, by: tuple[str, ...] = ("class",), keep_first: bool = True) -> DataFrame:
    """Intervals of at least ``least``; the first of each track stays in any case unless ``keep_first`` is off."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("start", "end"))
    ok = F.col("end") - F.col("start") >= least
    return intervals.withColumn("place", place).where(ok | (F.col("place") == 1) if keep_first else ok).drop("place")


def cropped(frames: DataFrame, geometry: Geometry, start: float, end: float) -> DataFrame:
    """The frames that touch a time range: from ceil((start - duration - origin)/step) to floor((end - origin)/step)."""
    low, high = (start - geometry.duration - geometry.start) / geometry.step, (end - geometry.start) / geometry.step
    return frames.where((F.col("frame") >= F.ceil(F.lit(low))) & (F.col("frame") <= F.floor(F.lit(high))))


def ordered_annotation(intervals: DataFrame, label: str = "class") -> DataFrame:
    return intervals.orderBy("start", label, "end")


def dense_labels(rows: DataFrame, label: str) -> DataFrame:
    """``rank``: the label's place among the distinct labels, from 0. The distinct labels are numbered, not the rows."""
    numbers = rows.select(label).distinct().withColumn("rank", (F.dense_rank().over(Window.orderBy(label)) - 1).cast("long"))
    return rows.join(numbers, label)


def renumbered(rows: DataFrame, label: str, order: str) -> DataFrame:
    """``renumbered``: labels numbered from 0 in the order of their first row."""
    first = rows.groupBy(label).agg(F.min(order).alias("first"))
    numbers = first.withColumn("renumbered", (F.row_number().over(Window.orderBy("first", label)) - 1).cast("long")).drop("first")
    return rows.join(numbers, label)


def embedded(rows: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Rows whose embedding is there: not null, and no NaN in its first element."""
    return rows.where(F.col(embedding).isNotNull() & ~F.isnan(F.get(F.col(embedding), F.lit(0)).cast("double")))
