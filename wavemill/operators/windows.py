"""Windows over sample counts and time, and cuts of sample arrays. SURVEY ids: T1, T2, F15, F18, P4, P5, J8, W2, W3, W8, W9, A15, P9.

A stream is a key column; order within it is a bigint index. Nothing here needs a row's neighbours but through a window
function or an equi-key, so one shuffle by stream (and window) is all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_SEGMENT_SECONDS, MIN_VIEW_MS, MIN_DIARY_SECONDS = 29, 500, 1.5


def count_windows(samples: DataFrame, size: int, hop: int = 0, stream: str = "stream_id", index: str = "idx", value: str = "value") -> DataFrame:
    """Each full window of ``size`` samples, advancing by ``hop`` (0: by the window): stream, window, start, samples.

    A window that isn't full is not returned, so a short tail waits for more samples.
    """
    hop = hop or size
    first = F.greatest(F.lit(0), F.floor((F.col(index) - size) / hop) + 1)
    keyed = samples.withColumn("window", F.explode(F.sequence(first.cast("long"), F.floor(F.col(index) / hop).cast("long"))))
    whole = keyed.groupBy(stream, "window").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(index, value))).alias("items"))
    return whole.where(F.col("n") == size).select(stream, "window", (F.col("window") * hop).alias("start"), F.transform("items", lambda x: x[value]).alias("samples"))


def count_window_stats(samples: DataFrame, size: int, hop: int = 0, stream: str = "stream_id", index: str = "idx", value: str = "value") -> DataFrame:
    """Sum, mean, minimum and maximum of each full window, with partial sums before the shuffle."""
    hop = hop or size
    first = F.greatest(F.lit(0), F.floor((F.col(index) - size) / hop) + 1)
    keyed = samples.withColumn("window", F.explode(F.sequence(first.cast("long"), F.floor(F.col(index) / hop).cast("long"))))
    stats = keyed.groupBy(stream, "window").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return stats.where(F.col("n") == size)


def view(samples: DataFrame, start: int, end: int, rate: int = 16000, index: str = "idx") -> DataFrame:
    """The samples of an absolute range; nothing if it is shorter than half a second."""
    wanted = samples.where((F.col(index) >= start) & (F.col(index) < end))
    return wanted if end - start >= MIN_VIEW_MS * rate // 1000 else wanted.limit(0)


def split_long(segments: DataFrame, rate: int = 16000, seconds: int = MAX_SEGMENT_SECONDS, start: str = "start", end: str = "end") -> DataFrame:
    """Segments cut into consecutive pieces of at most ``seconds``; an added ``piece`` counts them."""
    step = seconds * rate
    pieces = segments.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil((F.col(end) - F.col(start)) / step) - 1))))
    low = F.col(start) + F.col("piece") * step
    return pieces.withColumn("piece_end", F.least(F.col(end), low + step)).withColumn(start, low).withColumn(end, F.col("piece_end")).drop("piece_end")


def long_enough(segments: DataFrame, samples: str = "samples", rate: int = 16000, seconds: float = MIN_DIARY_SECONDS) -> DataFrame:
    return segments.where(F.size(samples) >= seconds * rate)


def trimmed(frames: DataFrame, total: int, left: float, right: float, frame: str = "frame") -> DataFrame:
    """Frames without a fraction at either end."""
    return frames.where(F.col(frame).between(int(total * left), total - int(total * right) - 1))


def closest_frame(time: Column, start: float, duration: float, step: float) -> Column:
    """The frame whose middle is nearest to a time, half to even."""
    return F.rint((time - start - 0.5 * duration) / step).cast("long")


def numbered(events: DataFrame, stream: str, *order: str) -> DataFrame:
    """A bigint index from 0 within each stream."""
    return events.withColumn("idx", (F.row_number().over(Window.partitionBy(stream).orderBy(*order)) - 1).cast("long"))


def recent_share(rows: DataFrame, stream: str, order: str, ident: str, size: int = 20) -> DataFrame:
    """``ratio``: the share of the row's id among the last ``size`` rows, its own included."""
    recent = Window.partitionBy(stream).orderBy(order).rowsBetween(1 - size, 0)
    ids = F.collect_list(ident).over(recent)
    return rows.withColumn("recent_ids", ids).withColumn("ratio", F.size(F.filter("recent_ids", lambda x: x == F.col(ident))) / F.size("recent_ids")).drop("recent_ids")


def first_seen(rows: DataFrame, stream: str, order: str, ident: str) -> DataFrame:
    """``is_first``: the id's first row of its stream."""
    return rows.withColumn("is_first", F.row_number().over(Window.partitionBy(stream, ident).orderBy(order)) == 1)


def running_count(rows: DataFrame, stream: str, order: str, flag: Column) -> DataFrame:
    whole = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(flag.cast("long")).over(whole))


def lag_difference(rows: DataFrame, stream: str, order: str, value: str, coefficient: float) -> DataFrame:
    """``emphasised``: x[i] - c x[i-1], the first kept."""
    before = F.lag(value).over(Window.partitionBy(stream).orderBy(order))
    return rows.withColumn("emphasised", F.coalesce(F.col(value) - coefficient * before, F.col(value)))


def speaking_gate(rows: DataFrame, stream: str, index: str, code: str, size: int = 20, least: int = 6) -> DataFrame:
    """Of each block of ``size`` VAD codes, whether at least ``least`` are a start (2) or speech (4)."""
    blocks = rows.groupBy(stream, F.floor(F.col(index) / size).alias("block"))
    return blocks.agg(F.count_if(F.col(code).isin(2, 4)).alias("speech")).withColumn("speaking", F.col("speech") >= least)


def sliding_chunks(samples: DataFrame, size: int, hop: int, stream: str = "stream_id", idx: str = "idx", value: str = "value") -> DataFrame:
    """stream, chunk, filled, samples (array of ``size``), tail: windows of a whole stream, a hop apart, as long as they are full, and then one window padded with zeros if samples are left.

    Survey id T9. A stream shorter than a window is one padded chunk. A sample goes to size / hop chunks.
    """
    n = samples.groupBy(stream).agg((F.max(idx) + 1).alias("n"))
    whole = F.when(F.col("n") >= size, F.expr(f"(n - {size}) div {hop} + 1")).otherwise(0)
    last = F.when((F.col("n") < size) | ((F.col("n") - size) % hop > 0), whole).otherwise(whole - 1)
    own = samples.join(n.select(stream, whole.alias("whole"), last.alias("last")), stream)
    first = F.greatest(F.lit(0), F.ceil((F.col(idx) - size + 1) / hop)).cast("long")
    to = F.least(F.floor(F.col(idx) / hop).cast("long"), F.col("last"))
    placed = own.withColumn("chunk", F.explode(F.when(first <= to, F.sequence(first, to))))
    items = placed.groupBy(stream, "chunk").agg(F.array_sort(F.collect_list(F.struct(idx, value))).alias("items"), F.max(F.col("chunk") >= F.col("whole")).alias("tail"))
    filled = F.transform("items", lambda x: x[value])
    return items.select(stream, "chunk", F.size("items").cast("long").alias("filled"), F.concat(filled, F.array_repeat(F.lit(0).cast("double"), F.lit(size) - F.size("items"))).alias("samples"), "tail")


def unread(samples: DataFrame, size: int, hop: int = 0, stream: str = "stream_id") -> DataFrame:
    """stream, unread: samples that no window has consumed yet; each full window moves the cursor by ``hop`` (0: by itself). Survey id T2."""
    step, n = hop or size, F.count(F.lit(1))
    return samples.groupBy(stream).agg(n.alias("n")).select(stream, (F.col("n") - F.when(F.col("n") >= size, F.expr(f"((n - {size}) div {step} + 1) * {step}")).otherwise(0)).alias("unread"))


def cleared(samples: DataFrame, marks: DataFrame, stream: str = "stream_id", idx: str = "idx", mark: str = "cleared_to") -> DataFrame:
    """What is left after each stream was cleared up to a place (that sample included); streams without a mark keep all. Survey id T2."""
    return samples.join(marks.select(stream, mark), stream, "left").where(F.col(mark).isNull() | (F.col(idx) > F.col(mark))).drop(mark)
