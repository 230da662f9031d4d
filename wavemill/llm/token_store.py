"""Operator 1: token ids in a binary format, with a minimal perfect hash index.

A store is a folder of shards and a manifest. Rows are range-partitioned and sorted by doc_id, in as many partitions as their bytes ask for, each partition writes
one shard as a stream, and the ids of all shards in manifest order are the corpus in ascending doc_id order.

    {shard}.ids    nothing but ids, little-endian, two bytes each where the vocabulary allows it, else four
    {shard}.idx    "WMTOKENS", the length of a JSON header (u32), the header, then its arrays one after another:
                   offsets    u64 x (records + 1)  first id of each record, in ids
                   doc_ids    i64 x records        ascending; records without a doc_id come first (header: nulls)
                   first      u32 x keys           by the key's number: its first record
                   prints     u16 x keys           by the key's number: its fingerprint
                   rest       u64 x rest           keys that no level of the hash settled
                   level k    packed bits          the levels of the hash (see perfect_hash)

To look a doc_id up: its number in the hash, the fingerprint there (a stranger is turned away without reading more), the
first record, and from there all records of that doc_id; the time doesn't depend on the size of the shard.

A task writes under a name of its own; only the names that the manifest holds count, so a lost or
repeated task leaves a stray file at worst.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm.common import arrow_rows, filesystem, lean, shared_dir, stored, text_of
from wavemill.llm.encoding import encoder, with_end
from wavemill.llm.perfect_hash import PerfectHash, fingerprint

MAGIC = b"WMTOKENS"
MANIFEST = "ord long, shard string, records long, tokens long, first_id long, last_id long, width int"
#: Bytes of ids that a reader holds at once, and bytes of text that a shard should hold (more by a sampling error of the ranges, or a single document).
READ_BYTES, SHARD_BYTES = 8 << 20, 512 << 20


class ShardWriter:
    def __init__(self, folder: str, width: int):
        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.name, self.base, self.width = uuid.uuid4().hex, base, width
        self.out = self.fs.open_output_stream(f"{base}/{self.name}.ids")
        self.lengths: list[int] = []
        self.keys: list[int | None] = []

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.out.write(ids.tobytes())
        self.lengths += sizes.tolist()
        self.keys += doc_ids

    def close(self) -> dict:
        self.out.close()
        nulls = sum(k is None for k in self.keys)
        doc_ids = np.array([0 if k is None else k for k in self.keys], "<i8")
        offsets = np.concatenate([[0], np.cumsum(np.array(self.lengths, np.int64))]).astype("<u8")
        keys, first = np.unique(doc_ids[nulls:], return_index=True)
        keys = keys.view(np.uint64)
        table = PerfectHash.build(keys)
        number = table.number(keys)
        by_number, prints = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u2")
        by_number[number], prints[number] = first + nulls, fingerprint(keys)
        header = {"width": self.width, "records": len(doc_ids), "nulls": nulls, "keys": len(keys), "rest": len(table.rest), "levels": table.sizes}
        head = json.dumps(header).encode()
        with self.fs.open_output_stream(f"{self.base}/{self.name}.idx") as f:
            f.write(MAGIC + len(head).to_bytes(4, "little") + head)
            for part in (offsets, doc_ids, by_number, prints, table.rest.astype("<u8"), *table.bits):
                f.write(part.tobytes())
        known = doc_ids[nulls:]
        return {"shard": self.name, "records": len(doc_ids), "tokens": int(offsets[-1]), "first_id": int(known[0]) if len(known) else None, "last_id": int(known[-1]) if len(known) else None, "width": self.width}


class Shard:
    """One shard, open for reading."""

    def __init__(self, folder: str, name: str):
        fs, base = filesystem(folder)
        raw = fs.open_input_file(f"{base}/{name}.idx").read()
        if raw[:8] != MAGIC:
            raise ValueError(f"{name}.idx is no token index")
        size = int.from_bytes(raw[8:12], "little")
        h = json.loads(raw[12 : 12 + size])
        self.width, self.nulls, self.records, at = h["width"], h["nulls"], h["records"], 12 + size
        self.dtype = np.dtype(f"<u{self.width}")
        parts = []
        for kind, n in (("<u8", h["records"] + 1), ("<i8", h["records"]), ("<u4", h["keys"]), ("<u2", h["keys"]), ("<u8", h["rest"]), *(("u1", -(-n // 8)) for n in h["levels"])):
            parts.append(np.frombuffer(raw, kind, n, at))
            at += parts[-1].nbytes
        self.offsets, self.doc_ids, self.first, self.prints = (parts[0].astype(np.int64), *parts[1:4])
        self.hash = PerfectHash(h["levels"], parts[5:], parts[4].astype(np.uint64))
        self.payload = fs.open_input_file(f"{base}/{name}.ids")

    def find(self, doc_ids: np.ndarray) -> np.ndarray:
        """First record of each doc_id, or -1."""
        keys = doc_ids.astype("<i8").view(np.uint64)
        number = self.hash.number(keys)
        out = np.full(len(keys), -1, np.int64)
        ok = number >= 0
        ok[ok] = self.prints[number[ok]] == fingerprint(keys[ok])
        record = self.first[number[ok]].astype(np.int64)
        out[ok] = np.where(self.doc_ids[record] == doc_ids[ok], record, -1)
        return out

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi of the shard."""
        return np.frombuffer(self.payload.read_at((hi - lo) * self.width, lo * self.width), self.dtype)

    def of(self, doc_id: int) -> list[np.ndarray]:
        """The ids of all records of a doc_id, through the index."""
        record, out = int(self.find(np.array([doc_id]))[0]), []
        while 0 <= record < self.records and self.doc_ids[record] == doc_id:
            out.append(self.ids(self.offsets[record], self.offsets[record + 1]))
            record += 1
        return out


def crc_u32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def write_store(docs: DataFrame, tokenizer: str, end_id: int | None = 2, folder: str | None = None) -> TokenStore:
    """Encode every whole text (null: empty), append ``end_id``, and write a store in ascending doc_id order.

    Rows without a doc_id come first; rows that share one stand together, in the order of the input. Other
    columns are not read. An empty table gives a store without shards.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("at", F.monotonically_increasing_id())
    shards = -(-(slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES)
    many = [shards] if shards > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
    rows = slim.repartitionByRange(*many, "doc_id", "at").sortWithinPartitions("doc_id", "at").select("doc_id", "text", F.spark_partition_id().cast("long").alias("ord"))

    @lean
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, writer, order = encoder(tokenizer), None, 0
        for batch in batches:
            if writer is None and batch.num_rows:
                writer, order = ShardWriter(folder, own.dtype.itemsize), batch.column("ord")[0].as_py()
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                writer.add(part.column("doc_id").to_pylist(), *with_end(*own.encode_many(part.column("text").to_pylist()), end_id))
        if writer:
            row = {"ord": order} | writer.close()
            yield pa.RecordBatch.from_pylist([row], pa.schema([("ord", pa.int64()), ("shard", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("width", pa.int32())]))

    with arrow_rows(spark, 1000):
        rows.mapInArrow(written, MANIFEST).write.parquet(f"{folder}/manifest")
    return TokenStore(spark, folder)


class TokenStore:
    """A store in the shared folder. The manifest, one row per shard, is all that the driver holds of it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        rows = sorted(stored(spark, f"{folder}/manifest", MANIFEST).collect(), key=lambda r: r["ord"])
        self.shards, start = [], 0
        for r in rows:
            self.shards.append((r["shard"], start, r["records"], r["first_id"], r["last_id"]))
            start += r["tokens"]
        self.tokens = start

    def _tasks(self) -> DataFrame:
        rows = [(i, name, start) for i, (name, start, *_) in enumerate(self.shards)]
        frame = self.spark.createDataFrame(rows, "n long, shard string, start long")
        return frame.repartitionByRange(max(1, len(rows)), "n") if rows else frame

    def documents(self) -> DataFrame:
        """Read every record back through its shard's index: doc_id, start, n_tokens, ids_crc32, shard."""
        folder = self.folder

        @lean
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist(), strict=True):
                    shard = Shard(folder, name)
                    known, count = np.unique(shard.doc_ids[shard.nulls :], return_counts=True)
                    first = shard.find(known)
                    if (first < 0).any():
                        raise ValueError(f"the index of {name} misses a doc_id")
                    order = np.concatenate([np.arange(shard.nulls), np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())])
                    if not np.array_equal(order, np.arange(shard.records)):
                        raise ValueError(f"the index of {name} doesn't lead through its records in order")
                    for part in _runs(shard.offsets, READ_BYTES // shard.width):
                        lo, hi = order[part][0], order[part][-1] + 1
                        at = shard.offsets[lo : hi + 1]
                        ids = shard.ids(at[0], at[-1])
                        crc = [crc_u32(ids[a - at[0] : b - at[0]]) for a, b in zip(at[:-1], at[1:], strict=True)]
                        doc_id = pa.array(shard.doc_ids[lo:hi], pa.int64(), mask=np.arange(lo, hi) < shard.nulls)
                        yield pa.RecordBatch.from_arrays([doc_id, pa.array(start + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array([name] * len(crc))], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

        return self._tasks().mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")

    def lookup(self, keys: DataFrame, column: str = "doc_id") -> DataFrame:
        """doc_id, ids (array of int) of every record of the wanted doc_ids; strangers and nulls give no row.

        A key goes to the shards whose range of doc_ids holds it (the manifest has the ranges), and there through the perfect hash.
        """
        ranges = [(name, a, b) for name, _, _, a, b in self.shards if a is not None]
        folder = self.folder
        lows, highs = np.array([a for _, a, _ in ranges], np.int64), np.array([b for _, _, b in ranges], np.int64)

        @F.arrow_udf("array<int>")
        def where(ids: pa.Array) -> pa.Array:
            lo, hi = np.searchsorted(highs, ids.to_numpy(), "left"), np.searchsorted(lows, ids.to_numpy(), "right")
            return pa.array([list(range(a, b)) for a, b in zip(lo, hi, strict=True)], pa.list_(pa.int32()))

        routed = keys.select(F.col(column).cast("long").alias("doc_id")).where("doc_id is not null").distinct().select("doc_id", F.explode(where("doc_id")).alias("n"))

        @lean
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards: dict[int, Shard] = {}
            for batch in batches:
                for n in pc.unique(batch.column("n")).to_pylist():
                    if n not in shards:
                        shards = {n: Shard(folder, ranges[n][0])}
                    for key in batch.filter(pc.equal(batch.column("n"), n)).column("doc_id").to_pylist():
                        got = shards[n].of(key)
                        if got:
                            yield pa.RecordBatch.from_arrays([pa.array([key] * len(got), pa.int64()), pa.array([x.tolist() for x in got], pa.list_(pa.int32()))], ["doc_id", "ids"])

        return routed.repartition("n").sortWithinPartitions("n").mapInArrow(found, "doc_id long, ids array<int>")


def _runs(offsets: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of records of at most so many ids together, one record at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield slice(lo, min(hi, n))
        lo = min(hi, n)
