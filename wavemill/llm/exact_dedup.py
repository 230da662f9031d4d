"""Operator 2: exact deduplication by an exchange of Golomb-coded fingerprints.

1. One scan takes a 64-bit fingerprint of each normalised text.
2. Each task sorts its fingerprints, some million documents' since it reads nothing else, splits them by the owner of their range, and sends each owner
   one Golomb-coded message (some five bytes a document), with a bit for those that the task itself holds twice.
3. An owner merges the messages of its range and answers each with a bitmap: which fingerprints occur elsewhere or twice.
4. Bitmaps become suspects by part of the corpus. A second scan lets only suspect rows through, and groups them by the bytes
   of their text, with partial sums before the shuffle, so a text with a million copies is sent once per task. The rows of a group get its result task by task.

Texts that nobody shares are never shuffled. Fingerprints that collide cost a needless verification, never a wrong result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.llm import golomb
from wavemill.llm.common import drop_dir, lean, shared_dir, SideTable, spread_join, stored, text_of, with_rows

#: Fingerprints that one owner merges, about.
OWNER_SIZE = 1 << 22
#: Rows whose fingerprints one task holds at most.
SENDER_ROWS = 1 << 22
LIGHT = "doc_id long, part long, pos long, uid long, fp long, sha string"
#: ``which`` gives each fingerprint's place in ``parts``; it stays with the sender.
MESSAGE = "message string, owner long, raw binary, twice binary, parts binary, which binary"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def _owner(prints: np.ndarray, owners: int) -> np.ndarray:
    """Equal ranges of the fingerprints' upper half."""
    return ((prints >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def send(light: DataFrame, owners: int) -> DataFrame:
    """The messages of each task: one per owner for each SENDER_ROWS rows."""
    schema = pa.schema([("message", pa.string()), ("owner", pa.int64()), *((c, pa.binary()) for c in ("raw", "twice", "parts", "which"))])

    def sent(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        prints, (parts, which) = np.concatenate([h[0] for h in held]), np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
        order = np.lexsort((which, prints))
        prints, which = prints[order], which[order]
        start = np.flatnonzero(np.concatenate([[True], (prints[1:] != prints[:-1]) | (which[1:] != which[:-1])]))
        own, at, twice = prints[start], which[start].astype("<u4"), np.diff(np.append(start, len(prints))) > 1
        owner = _owner(own, owners)
        for to in np.unique(owner).tolist():
            lo, hi = np.searchsorted(owner, [to, to + 1])
            row = {"message": uuid.uuid4().hex, "owner": to, "raw": golomb.encode(own[lo:hi]), "twice": np.packbits(twice[lo:hi]).tobytes(), "parts": parts.tobytes(), "which": at[lo:hi].tobytes()}
            yield pa.RecordBatch.from_pylist([row], schema)

    @lean
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append((batch.column("fp").to_numpy().view(np.uint64), batch.column("part").to_numpy()))
            size += batch.num_rows
            if size >= SENDER_ROWS:
                yield from sent(held)
                held, size = [], 0
        if size:
            yield from sent(held)

    return light.select("part", "fp").mapInArrow(coded, MESSAGE)


def answer(messages: DataFrame) -> DataFrame:
    """Each owner's bitmaps: message, twice."""

    def merged(table: pa.Table) -> pa.Table:
        lists = [golomb.decode(raw) for raw in table["raw"].to_pylist()]
        flags = [np.unpackbits(np.frombuffer(t, np.uint8), count=len(x)).astype(bool) for t, x in zip(table["twice"].to_pylist(), lists, strict=True)]
        every = np.concatenate(lists)
        distinct, at, count = np.unique(every, return_inverse=True, return_counts=True)
        twice = count > 1
        twice[at[np.concatenate(flags)]] = True
        ends = np.cumsum([len(x) for x in lists])
        bitmaps = [np.packbits(twice[at[e - len(x) : e]]).tobytes() for e, x in zip(ends, lists, strict=True)]
        return pa.table({"message": table["message"], "bitmap": pa.array(bitmaps, pa.binary())})

    return messages.select("owner", "message", "raw", "twice").groupBy("owner").applyInArrow(merged, "message string, bitmap binary")


def resolve(messages: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Suspects by part: key, item (the fingerprint), value."""

    @lean
    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, bits, parts, which in zip(*(batch.column(c).to_pylist() for c in ("raw", "bitmap", "parts", "which")), strict=True):
                own = golomb.decode(raw)
                some = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own)).astype(bool)
                part = np.frombuffer(parts, np.int64)[np.frombuffer(which, "<u4")[some]]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(own[some].view(np.int64)), pa.array(np.ones(len(part), np.int64))], ["key", "item", "value"])

    joined = messages.select("message", "raw", "parts", "which").join(bitmaps, "message").select("raw", "bitmap", "parts", "which")
    return joined.mapInArrow(suspects, "key long, item long, value long").distinct()


def dedup(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and part and pos, the row's identity (``with_rows``).

    Null text counts as empty. Of equal texts the row with the smallest doc_id stays; rows without a doc_id come after all others, and
    among rows with the same doc_id (or none) the first of the input stays: exactly one per text. keep_id is null where no row of the
    group has a doc_id. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "exact")
    rows = with_rows(docs.select(F.col("doc_id"), F.col("text")))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(rows).alias("text"), F.col("_row_part").alias("part"), F.col("_row_pos").alias("pos"))
    norm = rows.withColumn("norm", normalised(F.col("text")))
    norm.select("doc_id", "part", "pos", F.monotonically_increasing_id().alias("uid"), F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("sha")).write.parquet(f"{folder}/light")
    light = stored(spark, f"{folder}/light", LIGHT)
    size = light.count()

    send(light, max(1, -(-size // OWNER_SIZE))).write.parquet(f"{folder}/messages")
    messages = stored(spark, f"{folder}/messages", MESSAGE)
    table = SideTable(f"{folder}/suspects").write(resolve(messages, answer(messages)))
    drop_dir(spark, f"{folder}/messages")
    light.withColumn("suspect", table.find(F.col("part"), F.col("fp")).isNotNull()).write.parquet(f"{folder}/marked")
    marked = stored(spark, f"{folder}/marked", f"{LIGHT}, suspect boolean")
    drop_dir(spark, f"{folder}/light")
    shared = marked.where("suspect").withColumn("task", F.shiftright("uid", 33))

    wanted = SideTable(f"{folder}/wanted").write(shared.select(F.col("part").alias("key"), F.col("pos").alias("item"), F.lit(1).cast("long").alias("value")))
    texts = rows.where(wanted.find(F.col("part"), F.col("pos")).isNotNull()).select("doc_id", normalised(F.col("text")).alias("norm"))
    same = texts.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = same.select(F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")
    first = shared.groupBy("sha").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))["uid"].alias("first"))
    columns = ["doc_id", "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"), "part", "pos"]
    alone = marked.where("not suspect").withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)})
    copies = spread_join(shared, groups.join(first, "sha"), "sha", "task").withColumn("kept", F.col("uid") == F.col("first"))
    return alone.select(*columns).unionByName(copies.select(*columns))


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows whose part and pos ``dropped`` lists. The documents stay where they are: no shuffle."""
    spark = docs.sparkSession
    keys = dropped.select(F.col("part").alias("key"), F.col("pos").alias("item"), F.lit(1).cast("long").alias("value"))
    table = SideTable(shared_dir(spark, "dropped")).write(keys)
    prefix = "_row"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    own = [f"{prefix}_part", f"{prefix}_pos"]
    return with_rows(docs, prefix).where(table.find(*map(F.col, own)).isNull()).drop(*own)
