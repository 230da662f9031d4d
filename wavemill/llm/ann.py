"""Operator 8: approximate nearest neighbours by largest inner product, with score-aware anisotropic quantisation.

A vector is coded in four bits for each pair of dimensions. Codes and codebooks minimise |r|^2 + (h - 1) (r . u)^2, where r is the residual and u the vector's
direction: error along the vector, which changes large inner products, costs h times as much as error across it. A scan adds up table entries
by code, two codes a byte; the best RERANK_SHARE of a block are scored again on the original vectors in double precision. What the codes leave is coded in four bits
a pair again, and so is what that leaves (FINE_STAGES, by plain distance). Of the other rows, those whose scan score plus a bound (the query's norm times the row's residual) reaches the k-th of these get the finer
stages added, and those that still reach it with the much smaller residual of all stages are scored exactly too. So the cut loses no neighbour, however many vectors share a code, and few rows but near ones are read as vectors.

The index is a table of blocks in the shared folder: each task packs the rows that it reads, so nothing is shuffled to build it. A search task holds up to
TASK_BLOCKS blocks, streams the query blocks past them and leaves the k best of each query over all its blocks; these are merged in two levels.
Equal vectors of a block are coded and scored once and keep the list of their ids, so ties are whole and go to the smaller id.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import filesystem, lean, shared_dir, stored

#: Rows that the codebooks are fitted on (a bounded sample, by a hash of the id); all rows are indexed.
SAMPLE_ROWS = 8192
#: The parallel weight is (d - 1) T^2 / (1 - T^2) for inner products of at least T (on unit vectors).
SCORE_THRESHOLD = 0.2
CODES, PAIR, BLOCK_ROWS, QUERY_ROWS = 16, 2, 16384, 512
#: Finer stages of codes, which rows besides the reranked ones have to pass.
FINE_STAGES = 2
RERANK_SHARE, RERANK_LEAST = 0.03, 40
TASK_BLOCKS = 16
BLOCKS = "n long, ids binary, asks binary, ends binary, vectors binary, codes binary, errors binary"
FOUND = "query_id long, rank int, vec_id long, score double"


def valid(vector: Column, dim: int | None = None) -> Column:
    """Neither null nor zero, and without null or non-finite components (and of ``dim`` dimensions)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    ok = vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)
    return F.coalesce(ok & (F.size(vector) == dim) if dim is not None else ok, F.lit(False))


class Codebooks:
    """``books``: pairs of dimensions x 16 x 2. Odd dimensions are padded with a zero. ``finer`` are the books of what these leave, stage by stage."""

    def __init__(self, sample: np.ndarray, rounds: int = 8, fine_rounds: int = 3, seed: int = 8, finer: int = FINE_STAGES):
        self.dim = sample.shape[1]
        self.weight = max(0.0, (self.dim - 1) * SCORE_THRESHOLD**2 / (1 - SCORE_THRESHOLD**2) - 1) if finer else 0.0
        x, rng = self.pairs(sample), np.random.default_rng(seed)
        pick = rng.permutation(len(x))[:CODES]
        self.books = x[np.resize(pick, CODES)].transpose(1, 0, 2).copy() + rng.normal(0, 1e-4, (x.shape[1], CODES, PAIR))
        for _ in range(rounds):
            for m in range(x.shape[1]):
                code = self._nearest(x[:, m], m)
                n = np.bincount(code, minlength=CODES)
                for d in range(PAIR):
                    sums = np.bincount(code, weights=x[:, m, d], minlength=CODES)
                    self.books[m, :, d] = np.where(n > 0, sums / np.maximum(1, n), self.books[m, :, d])
        for _ in range(fine_rounds if self.weight else 0):
            self._refit(x, self.assign(sample))
        self.finer: list[Codebooks] = []
        left = self.left(sample, self.assign(sample)) if finer else sample
        for _ in range(finer):
            self.finer.append(Codebooks(left, rounds, finer=0))
            left = self.finer[-1].left(left, self.finer[-1].assign(left))

    def pairs(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors.astype(np.float64)
        if v.shape[1] % (2 * PAIR):
            v = np.pad(v, ((0, 0), (0, -v.shape[1] % (2 * PAIR))))
        return v.reshape(len(v), -1, PAIR)

    def _nearest(self, x: np.ndarray, m: int) -> np.ndarray:
        book = self.books[m]
        return ((book**2).sum(axis=1) - 2 * x @ book.T).argmin(axis=1)

    def assign(self, vectors: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows x pairs): nearest first, then each code in turn against the anisotropic loss."""
        x = self.pairs(vectors)
        u = x / np.maximum(np.sqrt((x**2).sum(axis=(1, 2), keepdims=True)), 1e-300)
        code = np.stack([self._nearest(x[:, m], m) for m in range(x.shape[1])], axis=1)
        along = sum(((x[:, m] - self.books[m][code[:, m]]) * u[:, m]).sum(axis=1) for m in range(x.shape[1]))
        for _ in range(sweeps):
            for m in range(x.shape[1]):
                book = self.books[m]
                part = (x[:, m] * u[:, m]).sum(axis=1)[:, None] - u[:, m] @ book.T
                rest = along - part[np.arange(len(x)), code[:, m]]
                loss = (book**2).sum(axis=1) - 2 * x[:, m] @ book.T + self.weight * (rest[:, None] + part) ** 2
                code[:, m] = loss.argmin(axis=1)
                along = rest + part[np.arange(len(x)), code[:, m]]
        return code

    def _refit(self, x: np.ndarray, code: np.ndarray) -> None:
        """Best codebooks for given codes, one pair of dimensions after another: a 2 x 2 system for each entry."""
        u = x / np.maximum(np.sqrt((x**2).sum(axis=(1, 2), keepdims=True)), 1e-300)
        along = sum(((x[:, m] - self.books[m][code[:, m]]) * u[:, m]).sum(axis=1) for m in range(x.shape[1]))
        for m in range(x.shape[1]):
            c, um, xm = code[:, m], u[:, m], x[:, m]
            rest = along - ((xm - self.books[m][c]) * um).sum(axis=1)
            total = lambda w: np.bincount(c, weights=w, minlength=CODES)  # noqa: B023, E731
            n, dot = np.bincount(c, minlength=CODES), (xm * um).sum(axis=1)
            left = np.zeros((CODES, PAIR, PAIR))
            right = np.zeros((CODES, PAIR))
            for i in range(PAIR):
                right[:, i] = total(xm[:, i] + self.weight * um[:, i] * (dot + rest))
                for j in range(PAIR):
                    left[:, i, j] = self.weight * total(um[:, i] * um[:, j]) + (i == j) * n
            used = n > 0
            self.books[m][used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            along = rest + ((xm - self.books[m][c]) * um).sum(axis=1)

    def left(self, vectors: np.ndarray, code: np.ndarray) -> np.ndarray:
        """What each row's codes leave of it (with the padding)."""
        rest = self.pairs(vectors)
        for m in range(rest.shape[1]):
            rest[:, m] -= self.books[m][code[:, m]]
        return rest.reshape(len(rest), -1)

    def encoded(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed codes of all stages, one below the other, and the norms of what the first one and all of them leave: 2 x rows."""
        packed, norms, left = [], [], vectors
        for books in (self, *self.finer):
            code = books.assign(left)
            left = books.left(left, code)
            packed.append(books.pack(code))
            norms.append(np.sqrt((left**2).sum(axis=1)))
        return np.concatenate(packed), np.stack([norms[0], norms[-1]])

    def pack(self, code: np.ndarray) -> np.ndarray:
        """Two codes a byte, by byte: (pairs / 2) x rows."""
        return np.ascontiguousarray((code[:, 0::2] | (code[:, 1::2] << 4)).astype(np.uint8).T)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """queries x bytes x 256: what each byte of codes adds to the inner product, all stages one below the other."""
        stages = []
        for books in (self.books, *(f.books for f in self.finer)):
            entry = np.einsum("qmd,mkd->qmk", self.pairs(queries), books).astype(np.float32)
            stages.append((entry[:, 1::2, :, None] + entry[:, 0::2, None, :]).reshape(len(queries), entry.shape[1] // 2, CODES * CODES))
        return np.concatenate(stages, axis=1)


def fit(vectors: DataFrame, dim: int, sample_rows: int = SAMPLE_ROWS) -> Codebooks:
    """vectors: vec_id, vector (valid)."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector").collect()
    return Codebooks(np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), dim))


class Block:
    def __init__(self, row: dict, dim: int, kind: str):
        self.name, self.ids, self.ends = row["block"], np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)
        self.asks = np.unpackbits(np.frombuffer(row["asks"], np.uint8), count=len(self.ids)).astype(bool)
        self.vectors = np.frombuffer(row["vectors"], kind).reshape(-1, dim)
        self.codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, max(1, len(self.vectors)))
        self.first = len(self.codes) // (1 + FINE_STAGES)  # bytes of the first stage
        self.errors = np.frombuffer(row["errors"], np.float64).reshape(2, -1)
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors, dtype=np.float64).max(initial=0.0))  # the largest

    def exact(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        return (self.vectors[at].astype(np.float64) * query).sum(axis=1)

    def within_reach(self, rough: np.ndarray, done: np.ndarray, scores: np.ndarray, k: int, query: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Rows besides ``done``, whose scores are known, that may be among the k best: first by scan score and residual, then by all stages of codes and what they leave.

        The k best by all stages raise the bar for the others. Both bounds are strict, with room for rounding; what isn't finite stays in.
        """
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        size, dim = float(np.sqrt((query**2).sum())), len(query)
        room = (len(table) + 4) * np.finfo(np.float32).eps * float(np.abs(table).max(axis=1).sum()) + 4 * dim * np.finfo(np.float64).eps * size * self.norm
        may = ~(rough + size * self.errors[0] + room < bar) | ~np.isfinite(rough)
        may[done] = False
        more = np.flatnonzero(may)
        both = rough[more].astype(np.float64)
        for byte in range(self.first, len(self.codes)):
            both += table[byte].take(self.codes[byte, more])
        ahead = more[np.argpartition(both, len(both) - k)[len(both) - k :]] if len(both) > k else more
        scores = np.concatenate([scores, self.exact(ahead, query)])
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        return more[~(both + size * self.errors[1, more] + room < bar) | ~np.isfinite(both)]

    def search(self, query: np.ndarray, own: int, table: np.ndarray, k: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best ids and scores, without the row at place ``own`` (none: -1)."""
        n = len(self.vectors)
        k_own = k + 1  # the own row may be among the best
        some = max(least, int(np.ceil(share * n)), k_own)
        at = np.arange(n)
        if some < n:
            rough = table[0].take(self.codes[0])
            for byte in range(1, self.first):
                rough += table[byte].take(self.codes[byte])
            at = np.argpartition(rough, n - some)[n - some :]
        exact = self.exact(at, query)
        if some < n:
            more = self.within_reach(rough, at, exact, k_own, query, table)
            at, exact = np.concatenate([at, more]), np.concatenate([exact, self.exact(more, query)])
        if len(at) > k_own:
            bound = np.partition(exact, len(at) - k_own)[len(at) - k_own]
            at, exact = at[exact >= bound], exact[exact >= bound]
        order = np.argsort(-exact, kind="stable")
        starts = np.concatenate([[0], self.ends[:-1]])
        places = [np.arange(starts[i], min(self.ends[i], starts[i] + k_own + 1)) for i in at[order]]  # one more, for the own row
        scores = np.repeat(exact[order], [len(x) for x in places])
        every = np.concatenate(places) if places else np.zeros(0, np.int64)
        return best(self.ids[every[every != own]], scores[every != own], k)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest scores, ties to the smaller id."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def build(vectors: DataFrame, books: Codebooks, kind: str, folder: str) -> DataFrame:
    """Index every row: a table of blocks. vectors: vec_id, vector (valid), is_query."""

    @lean
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asks, rows, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            every, vec_ids = np.concatenate(rows), np.concatenate(ids)
            distinct, at = np.unique(every.view(np.dtype((np.void, every.dtype.itemsize * books.dim))).ravel(), return_inverse=True)
            distinct = distinct.view(every.dtype).reshape(-1, books.dim)
            order = np.lexsort((vec_ids, at))
            ends = np.cumsum(np.bincount(at, minlength=len(distinct)))
            codes, errors = books.encoded(distinct)
            row = {"n": len(vec_ids), "ids": vec_ids[order].tobytes(), "asks": np.packbits(np.concatenate(asks)[order]).tobytes(), "ends": ends.astype(np.int64).tobytes(), "vectors": distinct.tobytes(), "codes": codes.tobytes(), "errors": errors.tobytes()}
            ids.clear(), asks.clear(), rows.clear()
            return pa.RecordBatch.from_pylist([row], pa.schema([("n", pa.int64()), *((c, pa.binary()) for c in ("ids", "asks", "ends", "vectors", "codes", "errors"))]))

        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS // 4):
                part = batch.slice(lo, BLOCK_ROWS // 4)
                ids.append(part.column("vec_id").to_numpy())
                asks.append(part.column("is_query").to_numpy(zero_copy_only=False))
                rows.append(np.ascontiguousarray(part.column("vector").flatten().to_numpy().astype(kind).reshape(-1, books.dim)) + 0.0)  # -0.0 is 0.0
                size += len(part)
                if size >= BLOCK_ROWS:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    vectors.mapInArrow(packed, BLOCKS).withColumn("block", F.monotonically_increasing_id()).write.parquet(f"{folder}/blocks")
    return stored(vectors.sparkSession, f"{folder}/blocks", f"{BLOCKS}, block long")


def _query_blocks(blocks: DataFrame, dim: int, kind: str, folder: str) -> DataFrame:
    """The query rows of all blocks, QUERY_ROWS together: ids, vectors, and where each row stands (block and place)."""
    names = ["ids", "vectors", "block", "places"]

    @lean
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, dim, kind)
                places = np.flatnonzero(block.asks)
                for lo in range(0, len(places), QUERY_ROWS):
                    some = places[lo : lo + QUERY_ROWS]
                    vectors = block.vectors[np.searchsorted(block.ends, some, "right")]
                    yield pa.RecordBatch.from_arrays([pa.array([block.ids[some].tobytes()]), pa.array([vectors.tobytes()]), pa.array([block.name]), pa.array([some.tobytes()])], names)

    schema = "ids binary, vectors binary, block long, places binary"
    blocks.mapInArrow(packed, schema).withColumn("queries", F.monotonically_increasing_id()).write.parquet(f"{folder}/queries")
    return stored(blocks.sparkSession, f"{folder}/queries", f"{schema}, queries long")


def search(embeddings: DataFrame, is_query: Column, k: int = 20, rerank_share: float = RERANK_SHARE, rerank_least: int = RERANK_LEAST) -> DataFrame:
    """Of each query row its k nearest others by inner product: query_id, rank (from 1), vec_id, score. Ties to the smaller vec_id.

    embeddings: vec_id, embedding (array of float or double). Rows without a vec_id, and vectors that are null, empty, zero, or hold null or non-finite
    components, take no part. Inner products are of vectors with equally many dimensions, so each number of dimensions is searched by itself. Only the query's own row is left out
    of its candidates; other rows of the same vec_id are listed like any, each query row has its own list, and repeated ids are listed as often as they occur. With fewer than k
    candidates, all are listed. An empty table gives no rows. Other columns are not read.
    """
    spark, folder = embeddings.sparkSession, shared_dir(embeddings.sparkSession, "ann")
    double = "double" in embeddings.schema["embedding"].dataType.simpleString()
    kind, element = ("<f8", "double") if double else ("<f4", "float")
    slim = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{element}>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query")).where(F.col("vec_id").isNotNull() & valid(F.col("vector")))
    dims = sorted(r["dim"] for r in slim.groupBy(F.size("vector").alias("dim")).count().collect())  # a row per number of dimensions
    found = [_search(slim.where(F.size("vector") == dim), dim, kind, f"{folder}/{dim}", k, rerank_share, rerank_least) for dim in dims]
    return functools.reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], FOUND)


def _search(own: DataFrame, dim: int, kind: str, folder: str, k: int, rerank_share: float, rerank_least: int) -> DataFrame:
    spark = own.sparkSession
    books = spark.sparkContext.broadcast(fit(own, dim))  # 16 x dim doubles for each stage
    blocks = build(own, books.value, kind, folder)
    _query_blocks(blocks, dim, kind, folder)
    count = blocks.count()
    query_uri = f"{folder}/queries"

    @lean
    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(query_uri)
        files = [f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.path.endswith(".parquet")]

        def past(some: list[Block]) -> Iterator[pa.RecordBatch]:
            for path in files:
                with fs.open_input_file(path) as handle:
                    for part in pq.ParquetFile(handle).iter_batches(4):
                        for q in part.to_pylist():
                            ids, places = np.frombuffer(q["ids"], np.int64), np.frombuffer(q["places"], np.int64)
                            vectors = np.frombuffer(q["vectors"], kind).reshape(-1, dim).astype(np.float64)
                            found = []
                            for lo in range(0, len(ids), 64):
                                for v, place, t in zip(vectors[lo : lo + 64], places[lo : lo + 64].tolist(), books.value.tables(vectors[lo : lo + 64]), strict=True):
                                    parts = [block.search(v, place if block.name == q["block"] else -1, t, k, rerank_share, rerank_least) for block in some]
                                    found.append(best(*map(np.concatenate, zip(*parts, strict=True)), k) if len(parts) > 1 else parts[0])
                            yield _part(q["queries"], some[0].name, ids, found)

        held = []
        for batch in batches:
            for row in batch.to_pylist():
                held.append(Block(row, dim, kind))
                if len(held) == TASK_BLOCKS:
                    yield from past(held)
                    held = []
        if held:
            yield from past(held)

    def merged(table: pa.Table) -> pa.Table:
        ids = np.frombuffer(table["ids"][0].as_py(), np.int64)
        parts = []
        for sizes, vec_ids, scores in zip(*(table[c].to_pylist() for c in ("sizes", "vec_ids", "scores")), strict=True):
            cut = np.cumsum(np.frombuffer(sizes, np.int64))[:-1]
            parts.append((np.split(np.frombuffer(vec_ids, np.int64), cut), np.split(np.frombuffer(scores, np.float64), cut)))
        found = [best(np.concatenate([p[0][i] for p in parts]), np.concatenate([p[1][i] for p in parts]), k) for i in range(len(ids))]
        return pa.Table.from_batches([_part(table["queries"][0].as_py(), table["block"][0].as_py(), ids, found)])

    packed = "queries long, block long, ids binary, sizes binary, vec_ids binary, scores binary"
    tasks = max(1, min(count, spark.sparkContext.defaultParallelism), -(-count // TASK_BLOCKS))
    found = blocks.repartitionByRange(tasks, "block").mapInArrow(searched, packed)
    groups = max(1, round(tasks**0.5))
    half = found.groupBy("queries", F.pmod(F.xxhash64("block"), F.lit(groups)).alias("half")).applyInArrow(merged, packed)
    whole = half.groupBy("queries").applyInArrow(merged, packed)

    @lean
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int64)
                rank = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.frombuffer(row["ids"], np.int64), sizes)), pa.array(rank, pa.int32()), pa.array(np.frombuffer(row["vec_ids"], np.int64)), pa.array(np.frombuffer(row["scores"], np.float64))], ["query_id", "rank", "vec_id", "score"])

    return whole.mapInArrow(listed, FOUND)


def _part(queries: int, block: int, ids: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    sizes = np.array([len(x) for x, _ in found], np.int64)
    vec_ids, scores = (np.concatenate([f[c] for f in found]) for c in (0, 1))
    return pa.RecordBatch.from_pylist(
        [{"queries": queries, "block": block, "ids": ids.tobytes(), "sizes": sizes.tobytes(), "vec_ids": vec_ids.astype(np.int64).tobytes(), "scores": scores.astype(np.float64).tobytes()}],
        pa.schema([("queries", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "sizes", "vec_ids", "scores"))]),
    )
