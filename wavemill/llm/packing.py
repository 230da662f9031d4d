"""Operator 6: packing along a space-filling curve.

A document's token ids are counted into hashed buckets, the normalised vector is projected to a few dimensions, and the cell it falls into
has a number along a Hilbert curve. Documents are range-sorted by that number and laid end to end, so a
sequence holds neighbours on the curve; the line is cut every 4096 tokens. Only the very last sequence can be padded.

The ids are encoded once, without a shuffle, and written to the shared folder as raw payload; what is sorted and
cut are rows of a few numbers. No text and no id is shuffled until somebody asks for whole sequences (``assemble``).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import arrow_rows, filesystem, lean, shared_dir, stored, text_of
from wavemill.llm.encoding import encoder, with_end
from wavemill.llm.perfect_hash import mix
from wavemill.llm.token_store import crc_u32

BUCKETS, DIMENSIONS, BITS = 512, 4, 12
RECORDS = "curve long, doc_id long, file string, record long, at long, n long"
#: Bytes of ids after which a task begins another payload file, and the span of a file that one reading task takes.
FILE_BYTES, SPAN_BYTES = 256 << 20, 16 << 20
#: Documents that are placed on the curve together.
GROUP_ROWS = 500


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of integer cells (rows x dimensions), each coordinate below 2**bits.

    Coordinates become the transposed index by undoing, from the highest bit down, the exchanges and inversions of the
    sub-cubes (Skilling 2004), then by Gray decoding.
    """
    x, n = cells.astype(np.int64).T.copy(), cells.shape[1]
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(n):
            inside = (x[i] & bit) > 0
            swap = np.where(inside, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[i] ^= swap if i else 0
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


class Curve:
    """Places documents on the curve by their token ids."""

    def __init__(self, vocabulary: int):
        self.bucket = (mix(np.arange(vocabulary), 11) % np.uint64(BUCKETS)).astype(np.int64)
        self.directions = np.random.default_rng(6).standard_normal((BUCKETS, DIMENSIONS)) / 2

    def cells(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Cells (rows x dimensions) of documents of these sizes whose ids stand one after another. A document without ids lies in cell 0."""
        ends = np.cumsum(sizes)
        parts = [self._cells(ids[ends[lo] - sizes[lo] : ends[min(lo + 64, len(sizes)) - 1]], sizes[lo : lo + 64]) for lo in range(0, len(sizes), 64)]
        return np.concatenate([np.zeros((0, DIMENSIONS), np.int64), *parts])

    def _cells(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(sizes)) * BUCKETS, sizes)
        vectors = np.sqrt(np.bincount(self.bucket[ids] + row, minlength=len(sizes) * BUCKETS)).reshape(len(sizes), BUCKETS)
        place = vectors @ self.directions / np.sqrt(np.maximum(sizes, 1))[:, None]  # the squares of a row add up to its size
        cells = np.clip(np.floor((place + 1) / 2 * (1 << BITS)), 0, (1 << BITS) - 1).astype(np.int64)
        cells[sizes == 0] = 0
        return cells


def encode_to_files(docs: DataFrame, tokenizer: str, end_id: int | None, folder: str) -> DataFrame:
    """Write the ids of all documents as raw payload; one row per document: curve, doc_id, file, record, at (first id in the file), n."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))

    @lean
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        curve = Curve(own.tokenizer.get_vocab_size())
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        out, name, at, record = None, "", 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, GROUP_ROWS):
                part = batch.slice(lo, GROUP_ROWS)
                if out is None or at * own.dtype.itemsize >= FILE_BYTES:
                    if out:
                        out.close()
                    name, at, record = uuid.uuid4().hex, 0, 0
                    out = fs.open_output_stream(f"{base}/{name}.ids")
                ids, sizes = own.encode_many(part.column("text").to_pylist())
                keys = hilbert(curve.cells(ids, sizes), BITS)
                ids, n = with_end(ids, sizes, end_id)
                out.write(ids.tobytes())
                starts, records = at + np.cumsum(n) - n, record + np.arange(len(n))
                at, record = at + int(n.sum()), record + len(n)
                yield pa.RecordBatch.from_arrays([pa.array(keys), part.column("doc_id"), pa.array([name] * len(n)), *map(pa.array, (records, starts, n))], ["curve", "doc_id", "file", "record", "at", "n"])
        if out:
            out.close()

    spark, path = docs.sparkSession, f"{folder}-records"
    with arrow_rows(spark, 1000):
        slim.mapInArrow(written, RECORDS).write.parquet(path)
    return stored(spark, path, RECORDS)


def pack(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int | None = 2) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, file, at.

    ``file`` and ``at`` say where the piece's ids stand in the payload (``read_pieces``). Each id of each document lies in exactly one
    piece. Null text: empty, so just the end id (without one, such a document has no piece). doc_id may be null or
    repeat; each row is packed for itself. Other columns are not read. An empty table has no pieces.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession, "packed")
    records = encode_to_files(docs, tokenizer, end_id, folder).where("n > 0")
    ordered = (
        records.repartitionByRange("curve", "doc_id", "file", "record")
        .sortWithinPartitions("curve", "doc_id", "file", "record")
        .withColumn("part", F.spark_partition_id().cast("long"))
    )

    @lean
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            n = batch.column("n").to_numpy()
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "file", "at", "n", "part")), pa.array(before, pa.int64())], ["doc_id", "file", "at", "n", "part", "before"])

    schema = "doc_id long, file string, at long, n long, part long, before long"
    path = f"{folder}-ordered"
    ordered.mapInArrow(summed, schema).write.parquet(path)
    line = stored(spark, path, schema)
    sizes = sorted((r["part"], r["n"]) for r in line.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row per partition
    starts = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    bases = spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts[:-1], strict=True)], "part long, base long")
    first = F.col("base") + F.col("before")
    return (
        line.join(F.broadcast(bases), "part")
        .withColumn("first", first)
        .withColumn("sequence_id", F.explode(F.sequence(F.expr(f"first div {length}"), F.expr(f"(first + n - 1) div {length}"))))
        .withColumn("start", F.greatest(F.lit(0).cast("long"), F.col("sequence_id") * length - F.col("first")))
        .withColumn("length", F.least(F.col("n"), (F.col("sequence_id") + 1) * length - F.col("first")) - F.col("start"))
        .withColumn("offset", F.col("first") + F.col("start") - F.col("sequence_id") * length)
        .select("doc_id", "start", "length", F.col("n").alias("doc_tokens"), "sequence_id", "offset", F.concat(F.lit(f"{folder}/"), "file", F.lit(".ids")).alias("file"), (F.col("at") + F.col("start")).alias("at"))
    )


def read_pieces(pieces: DataFrame, width: int, with_ids: bool) -> DataFrame:
    """The pieces with ``ids_crc32``, and with ``ids`` (array of int) if asked for; rows are dealt by spans of the payload files."""
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
    dealt = pieces.withColumn("span", F.expr(f"at div {SPAN_BYTES // width}")).repartition("file", "span").sortWithinPartitions("file", "at")

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, handle, held, low = None, None, np.zeros(0, f"<u{width}"), 0
        for batch in batches:
            crc, ids = [], []
            for file, at, n in zip(batch.column("file").to_pylist(), batch.column("at").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if file != opened:
                    fs, path = filesystem(file)
                    handle, opened, held, low = fs.open_input_file(path), file, held[:0], 0
                if at < low or at + n > low + len(held):
                    held, low = np.frombuffer(handle.read_at(max(n * width, 1 << 20), at * width), f"<u{width}"), at
                own = held[at - low : at - low + n]
                crc.append(crc_u32(own))
                if with_ids:
                    ids.append(own.astype(np.int32))
            extra = [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(crc, pa.int64()), *extra], [*names, "ids_crc32", *(["ids"] if with_ids else [])])

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids_crc32 long" + ", ids array<int>" * with_ids
    return dealt.mapInArrow(read, schema)


def assemble(pieces: DataFrame, width: int, length: int = 4096, pad_id: int = 0) -> DataFrame:
    """Whole sequences: sequence_id, ids (array of int). A sequence shorter than ``length`` is padded, unless its length is a power of two."""
    whole = read_pieces(pieces, width, with_ids=True).groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.transform("parts", lambda p: p["ids"]))
    n = F.size("ids")
    full = F.bit_count(n.cast("long")) == 1
    return whole.select("sequence_id", ids.alias("ids")).select("sequence_id", F.when(full, F.col("ids")).otherwise(F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(length) - n))).alias("ids"))
