"""Operator 13: features of each sale as they were known at a given moment.

A row of history counts for a moment t in a window of d days from the time at which all of it is known, max(event, arrival + lag, shipping), until event + d days.
So it emits a delta of +1 there and one of -1 at its end, the moments themselves (probes) are added as rows without a delta, and a running sum over a client's rows in order of
time, deltas before probes, leaves at each probe what is active. The latest click is a running maximum over the same order. Distinct items are intervals of one client and item: each interval
emits only what the earlier ones leave uncovered, which takes a running maximum of their ends.

A client with very many rows ("hot") is cut into about sqrt(n) chunks of time. Windows run within chunks; a second window over the chunks' totals gives what precedes each
chunk. Deltas of a hot client that fall on one microsecond are added up before they are shuffled to their window. Lines meet their sale through copies of it by block of input rows, so a sale
with any share of the lines is dealt out. What is broadcast are the hot clients: a client is hot if it has HOT_ROWS rows and more than
1/MAX_HOT of all, so there are at most MAX_HOT, whatever the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.llm.common import materialise, spread_join, with_rows

DAY = 86_400_000_000
#: Rows from which a client can be hot, and the number of clients that are hot at most.
HOT_ROWS, MAX_HOT = 100_000, 1 << 16
#: Input rows of lines that share a copy of a sale's facts.
BLOCK_ROWS = 1 << 16
CLICK, PURCHASE, SALE, LINE, ITEM, FUTURE, PROBE = range(7)


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970; a time without a zone is UTC, whatever the session's zone."""
    value = df[f"`{column}`"]
    if df.schema[column].dataType.simpleString() != "timestamp_ntz":
        return F.unix_micros(value.cast("timestamp"))
    since = value - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    part = lambda unit: F.extract(F.lit(unit), since)
    whole = (part("DAY").cast("long") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60) * 1_000_000
    return whole + (part("SECOND") * 1_000_000).cast("long")


def cents(value: Column) -> Column:
    """floor(100 x + 0.5); null, non-finite and absurd amounts (over 10^15) are 0."""
    x = value.cast("double")
    return F.coalesce(F.when(F.abs(x) <= 1e15, F.floor(x * 100 + 0.5)), F.lit(0)).cast("long")


def _deltas(rows: DataFrame, kind: Column, start: Column, end: Column, windows: Sequence[int]) -> DataFrame:
    """Of rows (client, n, cents, at, id) the deltas at start and end (which may use the column d), for each window in which the row is ever active."""
    each = rows.withColumn("d", F.explode(F.array(*map(F.lit, windows)))).select("*", start.alias("start"), end.alias("end")).where("start < end")
    moves = F.explode(F.array(F.struct(F.col("start").alias("time"), F.lit(1).alias("sign")), F.struct(F.col("end").alias("time"), F.lit(-1).alias("sign"))))
    plus = F.col("move.sign") == 1
    return each.withColumn("move", moves).select(
        "client", "d", "move.time", kind.cast("byte").alias("kind"), (F.col("move.sign") * F.col("n")).cast("long").alias("n"), (F.col("move.sign") * F.col("cents")).alias("cents"),
        F.when(plus, F.col("at")).alias("at"), F.when(plus, F.col("id")).alias("id"),
    )


def _running(kind_is: Sequence[int], value: str) -> Column:
    return F.sum(F.when(F.col("kind").isin(*kind_is), F.col(value)).otherwise(0))


def _measures() -> dict[str, Column]:
    return {
        "n_clicks": _running([CLICK, PURCHASE], "n"), "n_purchases": _running([PURCHASE], "n"), "click_cents": _running([CLICK, PURCHASE], "cents"), "n_sales": _running([SALE], "n"),
        "sale_cents": _running([SALE], "cents"), "n_lines": _running([LINE], "n"), "n_items": _running([ITEM], "n"), "line_cents": _running([LINE], "cents"), "n_future": _running([FUTURE], "n"),
    }


def _last() -> Column:
    return F.max(F.when(F.col("kind").isin(CLICK, PURCHASE) & F.col("at").isNotNull(), F.struct("at", "id")))


def _hot(parts: list[DataFrame]) -> DataFrame:
    """client, low, length: where a hot client's time begins and how long its chunks are. parts: client, time."""
    each = [p.groupBy("client").agg(F.count(F.lit(1)).alias("n"), F.min("time").alias("low"), F.max("time").alias("high")) for p in parts]
    counts = each[0]
    for more in each[1:]:
        counts = counts.union(more)
    counts = materialise(counts.groupBy("client").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")), "clients")
    total = counts.agg(F.sum("n")).first()[0] or 0  # one number
    hot = counts.where(F.col("n") > max(HOT_ROWS, total / MAX_HOT))
    return hot.select("client", "low", F.ceil((F.col("high") - F.col("low") + 1) / F.sqrt("n")).cast("long").alias("length"))


def _chunked(rows: DataFrame, hot: DataFrame, time: str) -> DataFrame:
    """``rows`` with the chunk of a hot client's time, null for other clients. The broadcast side has at most MAX_HOT rows."""
    chunk = F.floor((F.col(time) - F.col("low")) / F.col("length")).cast("long")
    return rows.join(F.broadcast(hot), "client", "left").withColumn("chunk", chunk).drop("low", "length")


def _item_rows(lines: DataFrame, hot: DataFrame, windows: Sequence[int]) -> DataFrame:
    """Of each line's interval the part that no earlier line of the same client and item covers, as rows for ``_deltas``. lines: client, item, sold, start."""
    each = lines.where("item is not null").withColumn("d", F.explode(F.array(*map(F.lit, windows)))).withColumn("end", F.col("sold") + F.col("d") * DAY).where("start < end")
    each = _chunked(each.groupBy("client", "item", "d", "start").agg(F.max("end").alias("end")), hot, "start")
    keys = ["client", "item", "d"]
    within = Window.partitionBy(*keys, "chunk").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    own = each.withColumn("covered", F.max("end").over(within))
    totals = each.where("chunk is not null").groupBy(*keys, "chunk").agg(F.max("end").alias("last"))
    before = totals.select(*keys, "chunk", F.max("last").over(Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    cold, split = own.where("chunk is null").withColumn("before", F.lit(None).cast("long")), own.where("chunk is not null").join(before.hint("merge"), [*keys, "chunk"])
    return cold.unionByName(split).select("client", "d", F.greatest("start", "covered", "before").alias("start"), "end").where("start < end")


def features(
    clicks: DataFrame, sales: DataFrame, lines: DataFrame, delay_seconds: Column, windows: Sequence[int] = (2, 14), lag_minutes: int = 240, horizon_days: int = 7
) -> DataFrame:
    """One row per sale with a client and a time, and window of d days: what was known at t = sold_at + ``delay_seconds`` (a column of sales).

    sale_id, d, t_us, label (does the client buy within ``horizon_days`` after t), and counts and sums over that client's clicks, sales and those sales' lines after t - d days
    up to t that had arrived ``lag_minutes`` before t (lines: that had been shipped). n_items counts distinct items; last_click_id is the click with the latest time, then the largest id, or null.

    Clicks that are equal in all columns count once; sales and lines count as often as they are there, and a line belongs to every row of its sale. A null time, arrival or client leaves a row
    out of history (of a line: a null sale or shipping time); a sale without an arrival still gets its rows and counts for the label. Null amounts are 0, a null click_id comes before all others,
    and a null delay is 0. Empty tables give zeros, no sales no rows; other columns of sales and lines are not read, whatever their names, and of clicks they only tell rows apart.
    """
    lag = lag_minutes * 60_000_000
    bought = sales.select(
        sales["sale_id"].cast("long").alias("sale"), sales["client_id"].cast("long").alias("client"), micros(sales, "sold_at").alias("sold"), (micros(sales, "arrived_at") + lag).alias("known"),
        cents(sales["total"]).alias("cents"), F.coalesce(delay_seconds.cast("long"), F.lit(0)).alias("delay"),
    ).where("client is not null and sold is not null")
    arrived = bought.where("known is not null").withColumn("start", F.greatest("sold", "known"))
    seen = clicks.distinct()
    seen = seen.select(
        seen["client_id"].cast("long").alias("client"), micros(seen, "ts").alias("at"), (micros(seen, "arrived_at") + lag).alias("known"), seen["click_id"].cast("long").alias("id"),
        F.coalesce(seen["kind"] == "purchase", F.lit(False)).alias("purchase"), cents(seen["value"]).alias("cents"), F.lit(1).alias("n"),
    ).where("client is not null and at is not null and known is not null")

    with_block = with_rows(lines.select("sale_id", "item_id", "amount", "shipped_at"))
    shipped = with_block.select(
        F.col("sale_id").cast("long").alias("sale"), F.col("item_id").cast("long").alias("item"), cents(F.col("amount")).alias("cents"), micros(with_block, "shipped_at").alias("shipped"),
        F.xxhash64("_row_part", F.floor(F.col("_row_pos") / BLOCK_ROWS)).alias("block"),
    ).where("sale is not null and shipped is not null")
    sold = spread_join(shipped, arrived.select("sale", "client", "sold", F.col("start").alias("from")), "sale", "block")
    line = materialise(sold.select("client", "item", "sold", F.greatest("from", "shipped").alias("start"), "cents"), "lines")
    hot = _hot([line.select("client", F.col("start").alias("time")), bought.select("client", F.col("sold").alias("time")), clicks.select(F.col("client_id").cast("long").alias("client"), micros(clicks, "ts").alias("time")).dropna()])

    none, one = F.lit(None).cast("long"), F.lit(1)
    end = F.col("at") + F.col("d") * DAY
    sale_rows = bought.select("client", one.alias("n"), "cents", F.col("sold").alias("at"), none.alias("id"))
    line_rows = line.select("client", one.alias("n"), "cents", F.col("sold").alias("at"), none.alias("id"), F.col("start").alias("from"))
    items = _item_rows(line, hot, windows)
    item_deltas = items.select("client", "d", F.explode(F.array(F.struct(F.col("start").alias("time"), F.lit(1).alias("n")), F.struct(F.col("end").alias("time"), F.lit(-1).alias("n")))).alias("move"))
    t = F.col("sold") + F.col("delay") * 1_000_000
    rows = (
        _deltas(seen, F.when(F.col("purchase"), PURCHASE).otherwise(CLICK), F.greatest("at", "known"), end, windows)
        .unionByName(_deltas(arrived.select("client", one.alias("n"), "cents", F.col("sold").alias("at"), none.alias("id"), F.col("start").alias("from")), F.lit(SALE), F.col("from"), end, windows))
        .unionByName(_deltas(sale_rows.withColumn("cents", F.lit(0).cast("long")), F.lit(FUTURE), F.col("at") - horizon_days * DAY, F.col("at"), windows))
        .unionByName(_deltas(line_rows, F.lit(LINE), F.col("from"), end, windows))
        .unionByName(item_deltas.select("client", "d", "move.time", F.lit(ITEM).cast("byte").alias("kind"), F.col("move.n").cast("long").alias("n"), F.lit(0).cast("long").alias("cents"), none.alias("at"), none.alias("id")))
        .unionByName(bought.withColumn("d", F.explode(F.array(*map(F.lit, windows)))).select("client", "d", t.alias("time"), F.lit(PROBE).cast("byte").alias("kind"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("cents"), none.alias("at"), F.col("sale").alias("id")))
    )
    return _probed(materialise(rows, "deltas"), hot)


def _probed(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The probes among the rows (client, d, time, kind, n, cents, at, id) with the sums of all deltas up to their time."""
    rows = _chunked(rows, hot, "time")
    keys, measures = ["client", "d"], _measures()
    many = rows.where(F.col("chunk").isNotNull() & (F.col("kind") != PROBE))
    added = many.groupBy(*keys, "chunk", "time", "kind").agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"), F.max(F.when(F.col("at").isNotNull(), F.struct("at", "id"))).alias("top"))
    added = added.select(*keys, "time", "kind", "n", "cents", "top.at", "top.id", "chunk")
    order = Window.partitionBy(*keys, "chunk").orderBy("time", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = rows.where(F.col("chunk").isNull() | (F.col("kind") == PROBE)).unionByName(added)
    running = line.select("*", *[m.over(order).alias(name) for name, m in measures.items()], _last().over(order).alias("last")).where(F.col("kind") == PROBE)

    totals = added.groupBy(*keys, "chunk").agg(*[m.alias(name) for name, m in measures.items()], _last().alias("last"))
    earlier = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = line.where("chunk is not null").select(*keys, "chunk").distinct().join(totals, [*keys, "chunk"], "left")
    before = chunks.select(*keys, "chunk", *[F.sum(name).over(earlier).alias(f"before_{name}") for name in measures], F.max("last").over(earlier).alias("before_last"))
    empty = {f"before_{name}": F.lit(0).cast("long") for name in measures} | {"before_last": F.lit(None).cast("struct<at: bigint, id: bigint>")}
    found = running.where("chunk is null").withColumns(empty).unionByName(running.where("chunk is not null").join(before.hint("merge"), [*keys, "chunk"]))
    value = {name: (F.col(name) + F.coalesce(f"before_{name}", F.lit(0))).alias(name) for name in measures}
    last = F.greatest("last", "before_last")
    return found.select(
        F.col("id").alias("sale_id"), "d", F.col("time").alias("t_us"), (F.col("n_future") + F.coalesce("before_n_future", F.lit(0)) > 0).alias("label"),
        value["n_clicks"], value["n_purchases"], value["click_cents"], F.when(last["at"] > F.col("time") - F.col("d") * DAY, last["id"]).alias("last_click_id"),
        value["n_sales"], value["sale_cents"], value["n_lines"], value["n_items"], value["line_cents"],
    )
