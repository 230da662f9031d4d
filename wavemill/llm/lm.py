"""Operator 3: language-model scores by deleted interpolation.

P(word | before) = l2 * c(before, word)/c(before) + l1 * c(word)/N + l0 / (V+1), where the weights depend on a bucket of the context's
frequency c(before), by powers of two. The weights are learned by expectation-maximisation on held-out counts: each training
token is held out of the counts in turn (its pair, its word and its context each lose one), which is the deleted
estimate in its finest form.

The corpus is read and split into words once. A chunk of about CHUNK_TOKENS tokens keeps its sorted distinct word hashes and, for each token, the
place of its word there. What the chunks then exchange are sorted lists of distinct 64-bit hashes of words and of word pairs, with
their training counts, packed into one message per chunk and owner of a hash range; an owner adds up and answers each
chunk with the corpus counts of just its list. No table of counts is collected or broadcast anywhere; messages and answers grow with the
input, memory doesn't. A hot word is one entry per chunk, so it weighs on no task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm.common import arrow_rows, filesystem, lean, shared_dir, stored, text_of
from wavemill.llm.perfect_hash import mix

CHUNK_TOKENS, OWNER_ENTRIES, SLICE_BYTES = 1 << 20, 1_000_000, 1 << 22
END, START = (xxhash.xxh3_64_intdigest(x) for x in (b" end", b" start"))  # no word holds a space
BUCKETS, BINS = 40, 8  # context-frequency buckets; bins per octave in which probabilities are gathered for the EM
CHUNKS = "chunk long, uid array<long>, doc_id array<long>, held_out array<boolean>, train array<boolean>, sizes array<long>, before array<long>, words binary, tokens binary, n_tokens long, n_words long"
_white = b" \t\n\r\x0b\x0c"


def word_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a lower-cased piece of text."""
    words = text.split()
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def slices(text: bytes, most: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text in slices that don't cut a word, so that a very long one is never held as a list of words."""
    lo = 0
    while len(text) - lo > most:
        hi = lo + most
        while hi < len(text) and text[hi] not in _white:
            hi += 1
        yield text[lo:hi]
        lo = hi
    if lo < len(text) or not text:
        yield text[lo:]


def _packed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, n * np.dtype(kind).itemsize, codec="zstd"), kind)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts, nearly all of them small: a byte each, and those of 255 or more listed behind."""
    large = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + counts[large].astype("<i8").tobytes()


def unpack_counts(raw: bytes, n: int) -> np.ndarray:
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw, "<i8", offset=n)
    return counts


def head_bits(owners: int) -> int:
    """Bits of a hash by which owners are told apart: 16, or as many as give each owner a value of its own."""
    return max(16, (owners - 1).bit_length())


def pack_hashes(hashes: np.ndarray, low: int, high: int, head: int = 16) -> bytes:
    """Sorted hashes whose upper ``head`` bits (16 at least) lie in low..high-1: how many there are of each, then 32 and 16 bits of each."""
    top = np.bincount((hashes >> np.uint64(64 - head)).astype(np.int64) - low, minlength=high - low).astype("<u4")
    return top.tobytes() + (hashes & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + ((hashes >> np.uint64(32)) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def unpack_hashes(raw: bytes, low: int, high: int, head: int = 16) -> np.ndarray:
    top = np.frombuffer(raw, "<u4", high - low).astype(np.int64)
    n = int(top.sum())
    at = top.size * 4
    upper = np.repeat(np.arange(low, high, dtype=np.uint64), top) << np.uint64(64 - head)
    return upper | (np.frombuffer(raw, "<u2", n, at + 4 * n).astype(np.uint64) << np.uint64(32)) | np.frombuffer(raw, "<u4", n, at).astype(np.uint64)


def owner_range(owner: int, owners: int) -> tuple[int, int]:
    values = 1 << head_bits(owners)
    return -(-owner * values // owners), -(-(owner + 1) * values // owners)


def chunks(docs: DataFrame, chunk_tokens: int = CHUNK_TOKENS, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """docs (uid, doc_id, held_out, train, text) as chunks of tokens; a long document may go on in the next chunk."""

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def reset() -> None:
            held.update({k: [] for k in ("uid", "doc_id", "held_out", "train", "sizes", "before", "parts")}, size=0)

        def flush() -> pa.RecordBatch:
            sizes = np.array(held["sizes"], np.int64)
            every = np.concatenate([*held["parts"], np.array(held["before"], np.uint64)])
            words, place = np.unique(every, return_inverse=True)
            n = int(sizes.sum())
            row = {"uid": held["uid"], "doc_id": held["doc_id"], "held_out": held["held_out"], "train": held["train"], "sizes": sizes.tolist(), "before": place[n:].tolist(), "words": words.tobytes(), "tokens": _packed(place[:n].astype("<u4")), "n_tokens": n, "n_words": len(words)}
            reset()
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("uid", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("train", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("before", pa.list_(pa.int64())), ("words", pa.binary()), ("tokens", pa.binary()), ("n_tokens", pa.int64()), ("n_words", pa.int64())])
        reset()
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "held_out", "train")), batch.column("text"), strict=True)
            for uid, doc_id, out, train, text in rows:
                before = START
                raw = text.as_py().encode("utf-8", "surrogatepass").lower()
                size = len(raw)
                for part in slices(raw, slice_bytes):
                    size -= len(part)
                    hashes = word_hashes(part)
                    if not size:
                        hashes = np.append(hashes, np.uint64(END))
                    for column, value in (("uid", uid), ("doc_id", doc_id), ("held_out", out), ("train", train), ("sizes", len(hashes)), ("before", before), ("parts", hashes)):
                        held[column].append(value)
                    before = int(hashes[-1]) if len(hashes) else before
                    held["size"] += len(hashes)
                    if held["size"] >= chunk_tokens:
                        yield flush()
        if held["sizes"]:
            yield flush()

    schema = CHUNKS.replace("chunk long, ", "")
    return docs.mapInArrow(cut, schema).withColumn("chunk", F.monotonically_increasing_id())


class Chunk:
    """A chunk's tokens and its distinct words and word pairs."""

    def __init__(self, row: dict):
        self.row, self.words = row, np.frombuffer(row["words"], np.uint64)
        self.token = _unpacked(row["tokens"], row["n_tokens"], "<u4").astype(np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        self.some = self.sizes > 0
        self.first = (np.cumsum(self.sizes) - self.sizes)[self.some]
        self.before = np.concatenate([[0], self.token[:-1]]) if len(self.token) else self.token.copy()
        self.before[self.first] = np.array(row["before"], np.int64)[self.some]
        self.train = np.repeat(np.array(row["train"], bool), self.sizes)
        pair, at = np.unique(self.before * len(self.words) + self.token, return_inverse=True)
        with np.errstate(over="ignore"):
            hashes = mix(self.words[pair // max(1, len(self.words))], 5) + mix(self.words[pair % max(1, len(self.words))], 6)
        order = np.argsort(hashes, kind="stable")
        self.pairs = hashes[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.pair = rank[at]

    def training_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of the words (for the start symbol: the training documents that begin here) and of the pairs."""
        words = np.bincount(self.token[self.train], minlength=len(self.words))
        start = np.searchsorted(self.words, np.uint64(START))
        if start < len(self.words) and self.words[start] == START:
            words[start] = int((self.train[self.first] & (self.before[self.first] == start)).sum())
        return words, np.bincount(self.pair[self.train], minlength=len(self.pairs))


def send(table: DataFrame, owners: dict[str, int]) -> DataFrame:
    """Messages: chunk, kind, owner, hashes, counts."""

    @lean
    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = Chunk(batch.slice(k, 1).to_pylist()[0])
                for kind, hashes, counts in zip("wp", (own.words, own.pairs), own.training_counts(), strict=True):
                    edges = np.searchsorted(hashes, np.array([owner_range(o, owners[kind])[0] << (64 - head_bits(owners[kind])) for o in range(owners[kind])], np.uint64)).tolist() + [len(hashes)]
                    for o in range(owners[kind]):
                        a, b = edges[o], edges[o + 1]
                        if b > a:
                            yield pa.RecordBatch.from_pylist([{"chunk": own.row["chunk"], "kind": kind, "owner": o, "hashes": pack_hashes(hashes[a:b], *owner_range(o, owners[kind]), head_bits(owners[kind])), "counts": pack_counts(counts[a:b])}], schema)

    schema = pa.schema([("chunk", pa.int64()), ("kind", pa.string()), ("owner", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
    return table.mapInArrow(messages, "chunk long, kind string, owner long, hashes binary, counts binary")


def answer(messages: DataFrame, owners: dict[str, int]) -> DataFrame:
    """Corpus counts for each message: chunk, kind, owner, counts; and one row per owner of words, without a chunk, with its tokens and types."""

    def added(table: pa.Table) -> pa.Table:
        kind, owner = table["kind"][0].as_py(), table["owner"][0].as_py()
        span = (*owner_range(owner, owners[kind]), head_bits(owners[kind]))
        lists = [unpack_hashes(raw, *span) for raw in table["hashes"].to_pylist()]
        counts = [unpack_counts(raw, len(x)) for raw, x in zip(table["counts"].to_pylist(), lists, strict=True)]
        distinct, at = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.bincount(at, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)
        ends = np.cumsum([len(x) for x in lists])
        out = [pack_counts(total[at[e - len(x) : e]]) for e, x in zip(ends, lists, strict=True)]
        word = (distinct != START) & (kind == "w")
        rows = len(out) + 1
        return pa.table({"chunk": pa.array([*table["chunk"].to_pylist(), None], pa.int64()), "kind": [kind] * rows, "owner": pa.array([owner] * rows, pa.int64()), "counts": pa.array([*out, None], pa.binary()), "tokens": pa.array([0] * (rows - 1) + [int(total[word].sum())], pa.int64()), "types": pa.array([0] * (rows - 1) + [int((total[word] > 0).sum())], pa.int64())})

    return messages.groupBy("kind", "owner").applyInArrow(added, "chunk long, kind string, owner long, counts binary, tokens long, types long")


class Answers:
    """The answers in the shared folder, by chunk."""

    def __init__(self, uri: str, spread: int):
        self.uri, self.spread = uri, spread

    def of(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Corpus counts of the chunk's words and of its pairs."""
        key = chunk.row["chunk"]
        fs, base = filesystem(self.uri)
        parts: dict[str, list[tuple[int, bytes]]] = {"w": [], "p": []}
        for f in fs.get_file_info(pafs.FileSelector(f"{base}/slot={key % self.spread}", allow_not_found=True)):
            if f.path.endswith(".parquet"):
                with fs.open_input_file(f.path) as handle:
                    table = pq.read_table(handle, filters=[("chunk", "=", key)])
                for kind, owner, raw in zip(*(table[c].to_pylist() for c in ("kind", "owner", "counts")), strict=True):
                    parts[kind].append((owner, raw))
        out = []
        for kind, hashes in (("w", chunk.words), ("p", chunk.pairs)):
            raws = dict(parts[kind])
            top = (hashes >> np.uint64(64 - head_bits(self.owners[kind]))).astype(np.int64)
            counts, lo = [], 0
            for owner in sorted(raws):
                hi = int(np.searchsorted(top, owner_range(owner, self.owners[kind])[1]))
                counts.append(unpack_counts(raws[owner], hi - lo))
                lo = hi
            out.append(np.concatenate(counts) if counts else np.zeros(0, np.int64))
            if len(out[-1]) != len(hashes):
                raise ValueError(f"answers are missing for chunk {key}")
        return out[0], out[1]

    owners: dict[str, int] = {}


def bucket(count: np.ndarray) -> np.ndarray:
    """0 for no occurrence of the context, else 1 + floor(log2(count))."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], BUCKETS - 1).astype(np.int64)


def learn(gathered: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights (buckets x [pair, word, uniform]) by expectation-maximisation. gathered: rows of bucket, n, mean p2, mean p1, p0.

    Each component has one pseudo-count, so none is ever 0 where a word may need it; the weight of pairs is 0 in bucket 0, which has none.
    """
    weights = np.full((BUCKETS, 3), 1 / 3)
    weights[0] = [0, 0.5, 0.5]
    if len(gathered):
        b, n, p = gathered[:, 0].astype(np.int64), gathered[:, 1], gathered[:, 2:5]
        prior = np.ones((BUCKETS, 3))
        prior[0, 0] = 0
        for _ in range(rounds):
            share = weights[b] * p
            share *= (n / share.sum(axis=1))[:, None]
            sums = prior.copy()
            np.add.at(sums, b, share)
            weights = sums / sums.sum(axis=1, keepdims=True)
    return weights


def score(docs: DataFrame, held_out, chunk_tokens: int = CHUNK_TOKENS, slice_bytes: int = SLICE_BYTES, owner_entries: int = OWNER_ENTRIES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out``: a boolean column over doc_id. Training rows are those with a doc_id that are not held out. Null text counts as empty: its only token is
    the end. A row without a doc_id is scored, not learned from, and not held out. doc_id may repeat. If nothing can be
    learned, N and V are 0 and every token has the probability 1. Other columns are not read. base_score is
    log10 of add-one unigrams, score log10 of the interpolated model.
    """
    spark: SparkSession = docs.sparkSession
    folder = shared_dir(spark, "lm")
    out = F.coalesce(held_out, F.lit(False))
    slim = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), (F.col("doc_id").isNotNull() & ~out).alias("train"), text_of(docs).alias("text"))
    with arrow_rows(spark, 1000):
        chunks(slim, chunk_tokens, slice_bytes).write.parquet(f"{folder}/chunks")
    table = stored(spark, f"{folder}/chunks", CHUNKS)
    n_chunks, n_words, n_tokens = table.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    owners = {"w": max(1, -(-n_words // owner_entries)), "p": max(1, -(-n_tokens // owner_entries))}
    answers = Answers(f"{folder}/answers", max(1, n_chunks // 2))
    answers.owners = owners
    replies = answer(send(table, owners), owners).withColumn("slot", F.coalesce(F.pmod("chunk", F.lit(answers.spread)), F.lit(-1)))
    with arrow_rows(spark, 1):  # a row is a chunk
        replies.repartition("slot").write.partitionBy("slot").parquet(answers.uri)
    totals = spark.read.schema("chunk long, tokens long, types long, slot long").parquet(answers.uri).where("slot = -1").agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    n, v = int(totals[0]), int(totals[1])

    @lean
    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = Chunk(batch.slice(k, 1).to_pylist()[0])
                words, pairs = answers.of(own)
                use = own.train
                context = words[own.before[use]] - 1
                p2 = np.where(context > 0, (pairs[own.pair[use]] - 1) / np.maximum(1, context), 0)
                p1 = (words[own.token[use]] - 1) / max(1, n - 1)
                level = lambda p: np.where(p > 0, 1 + np.floor(-np.log2(np.where(p > 0, p, 1)) * BINS), 0).astype(np.int64)
                key, at = np.unique((bucket(context) * 1024 + level(p2)) * 1024 + level(p1), return_inverse=True)
                columns = [np.bincount(at, weights=w, minlength=len(key)) for w in (np.ones(len(at)), p2, p1)]
                yield pa.RecordBatch.from_arrays([pa.array(key), *map(pa.array, columns)], ["key", "n", "p2", "p1"])

    cells = table.mapInArrow(gathered, "key long, n double, p2 double, p1 double").groupBy("key").agg(*(F.sum(c).alias(c) for c in ("n", "p2", "p1")))
    with arrow_rows(spark, 1):
        rows = cells.orderBy("key").collect()  # at most BUCKETS x (64 BINS)^2 cells, whatever the corpus
    rows = np.array([[r["key"] >> 20, r["n"], r["p2"] / r["n"], r["p1"] / r["n"], 1 / (v + 1)] for r in rows])
    weights = learn(rows) if n else np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))

    @lean
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = Chunk(batch.slice(k, 1).to_pylist()[0])
                words, pairs = answers.of(own)
                count, context = words[own.token], words[own.before]
                mixed = weights[bucket(context)]
                p = mixed[:, 0] * pairs[own.pair] / np.maximum(1, context) + mixed[:, 1] * count / max(1, n) + mixed[:, 2] / (v + 1)
                sums = []
                for x in (np.log10((count + 1) / (n + v + 1)), np.log10(p), (count > 0).astype(np.int64)):
                    full = np.zeros(len(own.sizes), x.dtype)
                    if len(own.first):
                        full[own.some] = np.add.reduceat(x, own.first)
                    sums.append(full)
                r = own.row
                yield pa.RecordBatch.from_arrays([pa.array(r["uid"], pa.int64()), pa.array(r["doc_id"], pa.int64()), pa.array(r["held_out"], pa.bool_()), pa.array(own.sizes), *map(pa.array, sums)], ["uid", "doc_id", "held_out", "n_tokens", "base_score", "score", "n_known"])

    pieces = table.mapInArrow(scored, "uid long, doc_id long, held_out boolean, n_tokens long, base_score double, score double, n_known long")
    return (
        pieces.groupBy("uid", "doc_id", "held_out")
        .agg(*(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")))
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
    )
