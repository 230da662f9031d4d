"""Matching embeddings: thresholded nearest neighbours, lookups, centroids and running blends.

SURVEY ids: J1-J7, J10, A4, A5, A7, A8, A20, C7, D11, P10, P15.

All-pairs work is done block against block in numpy: registry and queries are packed into blocks of vectors, as bytes and once, and dealt over a grid of tasks; each pair of blocks is
one matrix product. The product is in single precision and bounds what it can't decide: only pairs within its rounding error of a query's best, or of the threshold, are computed in double precision.
A task holds a pair of blocks and a query block's best rows so far, and these leave it once. Work is the square of the rows by nature, memory and messages of a task don't grow with them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.functions import vectors as V

#: Rows of a query block and of a registry block, bytes of a block's vectors, rows of a product at once, columns that are looked at by their maximum first, and pairs that are computed in double precision at once.
MATCH, QUERIES, BLOCK, BLOCK_BYTES, TILE, LANE, EXACT = 0.4, 2048, 4096, 4 << 20, 256, 64, 1 << 15
#: Blocks of a task (the registry's side is held by it), and the tasks of the queries' side that are wanted if there are as many blocks.
QUERY_BLOCKS, REGISTRY_BLOCKS, TASKS = 8, 32, 48


def _tagged(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector and tag, a hash of the vector: rows that share a key are told apart by it, and equal rows share their result."""
    own = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
    return own.withColumn("tag", F.xxhash64("vector"))


def _packed(rows: DataFrame, key: str, vector: str, side: str, size: int, copies: int | None = None) -> DataFrame:
    """Blocks of about ``size`` rows of one dimension, in order of key. Rows without a key, and vectors that are null, empty or hold a null, NaN or infinite element, take no part.

    With ``copies``, of equal vectors in a block only those of the lowest copies + 1 keys stay, and of each of these ``copies`` rows: a list of that many never needs others.
    """
    n, elements = rows.agg(F.count(F.lit(1)), F.sum(F.greatest(F.lit(0), F.size(vector)).cast("long"))).first()
    blocks = max(1, -(-n // size), -(-8 * (elements or 0) // BLOCK_BYTES))
    tasks = min(blocks, max(TASKS, -(-blocks // QUERY_BLOCKS))) if side == "q" else -(-blocks // REGISTRY_BLOCKS)
    own = _tagged(rows, key, vector).where("key is not null and size(vector) > 0 and forall(vector, x -> x is not null and abs(x) < double('infinity'))")
    items = own.groupBy(F.pmod(F.xxhash64("key", "tag"), F.lit(blocks)).alias("block"), F.size("vector").alias("dim")).agg(F.collect_list(F.struct("key", "tag", "vector")).alias("items"))
    lists = items.select("block", "dim", F.col("items.key").alias("keys"), F.col("items.tag").alias("tags"), F.flatten("items.vector").alias("vectors"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                keys, tags, vectors = (batch.column(c)[k].values.to_numpy(zero_copy_only=False) for c in ("keys", "tags", "vectors"))
                vectors = vectors.reshape(len(keys), -1)
                order = np.argsort(keys, kind="stable")
                if copies is not None:
                    order = order[_few_copies(keys[order], vectors[order], copies)]
                data = [pa.array([x[order].tobytes()], pa.binary()) for x in (keys, tags, vectors)]
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(k, 1), batch.column("dim").slice(k, 1), *data], ["block", "dim", "keys", "tags", "vectors"])

    packed = lists.mapInArrow(pack, "block long, dim int, keys binary, tags binary, vectors binary")
    return packed.repartitionById(tasks, (F.col("block") % tasks).cast("int")).toDF(*(f"{side}_{c}" for c in packed.columns))


def _few_copies(keys: np.ndarray, vectors: np.ndarray, copies: int) -> np.ndarray:
    """Places (rising) of the rows that stay of sorted keys: of equal vectors the lowest copies + 1 keys, ``copies`` rows each."""
    rows = np.ascontiguousarray(vectors + 0.0).view(np.dtype((np.void, vectors.shape[1] * 8))).ravel()
    same = np.unique(rows, return_inverse=True)[1].ravel()
    order = np.argsort(same, kind="stable")
    new = np.diff(same[order], prepend=-1) != 0
    new_key = new | (np.diff(keys[order], prepend=keys[order[0]]) != 0)
    at, key_number = np.arange(len(order)), np.cumsum(new_key)
    number = key_number - np.maximum.accumulate(np.where(new, key_number, 0))
    row = at - np.maximum.accumulate(np.where(new_key, at, 0))
    return np.sort(order[(number <= copies) & (row < copies)])


def _matrix(row: pa.RecordBatch, side: str) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(row.column(f"{side}_keys")[0].as_buffer(), np.int64)
    return keys, np.frombuffer(row.column(f"{side}_vectors")[0].as_buffer(), np.float64).reshape(len(keys), -1)


def _tags(row: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(row.column("q_tags")[0].as_buffer(), np.int64)


def _pairs(queries: DataFrame, registry: DataFrame, key: str, vector: str, registry_key: str, registry_vector: str, copies: int | None = None) -> DataFrame:
    return _packed(queries, key, vector, "q", QUERIES).crossJoin(_packed(registry, registry_key, registry_vector, "r", BLOCK, copies))


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of blocks whose vectors have one dimension, one by one; others have no product."""
    for batch in batches:
        for k in range(batch.num_rows):
            if batch.column("q_dim")[k].as_py() == batch.column("r_dim")[k].as_py():
                yield batch.slice(k, 1)


class _Best:
    """The k most similar registry rows of each row of one block of queries, above ``floor``, ties to the lowest key, as blocks of the registry come by."""

    def __init__(self, row: pa.RecordBatch, k: int, floor: float):
        self.block, self.k, self.floor, self.tags = (row.column("q_block")[0].as_py(), row.column("q_dim")[0].as_py()), k, floor, _tags(row)
        self.keys, self.q = _matrix(row, "q")
        self.norms, self.unit = _units(self.q)
        self.sims, self.matches = np.full((len(self.q), k), -np.inf), np.full((len(self.q), k), np.iinfo(np.int64).max)

    def meet(self, row: pa.RecordBatch, exclude_same: bool) -> None:
        rk, r = _matrix(row, "r")
        norms, unit = _units(r)
        lanes = -(-len(rk) // LANE)
        unit = np.concatenate([unit, np.zeros((lanes * LANE - len(rk), r.shape[1]), np.float32)]).T
        tiny = self.norms.min() * norms.min() < V.FLOAT_EPSILON
        error = 2.0**-23 * (r.shape[1] + 8)
        first, last = np.searchsorted(rk, self.keys), np.searchsorted(rk, self.keys, "right")
        for lo in range(0, len(self.q), TILE):
            part = slice(lo, lo + TILE)
            rough = self.unit[part] @ unit
            if tiny:
                rough[:, : len(rk)] = _cosines(self.q[part], r)
            rough[:, len(rk) :] = -np.inf
            if exclude_same:
                for step in range((last - first)[part].max()):
                    own = np.flatnonzero(first[part] + step < last[part])
                    rough[own, first[part][own] + step] = -np.inf
            cells = rough.reshape(len(rough), LANE, lanes)  # A lane is every lanes-th column.
            peaks = cells.max(axis=1)
            low = np.maximum(self.sims[part, -1], self.floor)
            if self.k == 1:
                low = np.maximum(low, peaks.max(axis=1) - error)
            elif lanes >= self.k and np.isneginf(low).any():
                low = np.maximum(low, np.partition(peaks, lanes - self.k, axis=1)[:, lanes - self.k] - error)
            low = low - error
            i, lane = np.nonzero((peaks >= low[:, None]) & (peaks > -np.inf))
            near = cells[i, :, lane]
            at, column = np.nonzero((near >= low[i][:, None]) & (near > -np.inf))
            self._take(lo, i[at], column * lanes + lane[at], rk, r, norms)

    def _take(self, lo: int, i: np.ndarray, j: np.ndarray, rk: np.ndarray, r: np.ndarray, norms: np.ndarray) -> None:
        for at in range(0, len(i), EXACT):
            a, b = lo + i[at : at + EXACT], j[at : at + EXACT]
            sim = np.einsum("ij,ij->i", self.q[a], r[b]) / np.maximum(self.norms[a] * norms[b], V.FLOAT_EPSILON)
            ok = sim > self.floor
            a, sim, found = a[ok], sim[ok], rk[b[ok]]
            rows = np.unique(a)
            of, sims = np.concatenate([a, np.repeat(rows, self.k)]), np.concatenate([sim, self.sims[rows].ravel()])
            matches = np.concatenate([found, self.matches[rows].ravel()])
            order = np.lexsort((matches, -sims, of))
            best = order[np.searchsorted(of[order], rows)[:, None] + np.arange(self.k)]
            self.sims[rows], self.matches[rows] = sims[best], matches[best]

    def rows(self) -> pa.RecordBatch:
        ok = self.sims > -np.inf
        times = ok.sum(axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.keys, times)), pa.array(np.repeat(self.tags, times)), pa.array(self.matches[ok]), pa.array(self.sims[ok])], ["query", "tag", "match_id", "sim"])


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.linalg.norm(x, axis=1)
    return norms, (x / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)


def _ranked(pairs: DataFrame, k: int, floor: float, exclude_same: bool) -> DataFrame:
    """query, tag, match_id, sim: of each query row and task the k best rows above ``floor``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for row in _alike(batches):
            if best is None or best.block != (row.column("q_block")[0].as_py(), row.column("q_dim")[0].as_py()):
                if best is not None:
                    yield best.rows()
                best = _Best(row, k, floor)
            best.meet(row, exclude_same)
        if best is not None:
            yield best.rows()

    return pairs.mapInArrow(run, "query long, tag long, match_id long, sim double")


def _cosines(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    return q @ r.T / np.maximum(np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(r, axis=1), V.FLOAT_EPSILON)


def nearest(queries: DataFrame, registry: DataFrame, threshold: float = MATCH, key: str = "vec_id", vector: str = "embedding", registry_key: str = "vec_id", registry_vector: str = "embedding", exclude_same: bool = False, keep_vector: bool = False) -> DataFrame:
    """Of each query the most similar registry key above the threshold (strictly; ties to the lowest key): query, match_id (-1: none), sim, and the query's own ``vector`` if asked for.

    One row per query row. Null and empty vectors, and those that hold a null, NaN or infinite element, match nothing, and vectors only match vectors of their own dimension.
    """
    found = _ranked(_pairs(queries, registry, key, vector, registry_key, registry_vector, copies=1), 1, threshold, exclude_same)
    top = found.groupBy("query", "tag").agg(F.max(F.struct("sim", (-F.col("match_id")).alias("low"))).alias("top"))
    hits = top.select("query", "tag", (-F.col("top.low")).alias("match_id"), F.col("top.sim").alias("sim"))
    every = _tagged(queries, key, vector).select(F.col("key").alias("query"), "tag", *(["vector"] if keep_vector else []))
    return every.join(hits, ["query", "tag"], "left").drop("tag").fillna({"match_id": -1})


def top_k(queries: DataFrame, registry: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", exclude_same: bool = True) -> DataFrame:
    """The k most similar registry keys of each query: query, rank, match_id, sim. Rows that share a key but not the vector have a list each; equal rows share one."""
    from pyspark.sql import Window

    distinct = _tagged(queries, key, vector).dropDuplicates(["key", "tag"]).select(F.col("key").alias(key), F.col("vector").alias(vector))
    found = _ranked(_pairs(distinct, registry, key, vector, key, vector, copies=k), k, -np.inf, exclude_same)
    place = F.row_number().over(Window.partitionBy("query", "tag").orderBy(F.desc("sim"), "match_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).drop("tag")


def best_named(queries: DataFrame, enrolled: DataFrame, nobody: str = "Nobody", key: str = "vec_id", vector: str = "embedding", name: str = "name", named_vector: str = "emb", threshold: float = 0.0, keep_vector: bool = False) -> DataFrame:
    """The name with the best score over all its vectors, if above ``threshold`` (else ``nobody`` with 0): query, name, sim, and the query's own ``vector`` if asked for; ties to the first name in order.

    enrolled: name, emb, one row per vector. The names, without their vectors, are numbered within their first three characters, after all names of smaller beginnings.
    """
    from pyspark.sql import Window

    distinct = enrolled.where(F.col(name).isNotNull()).select(name).distinct().withColumn("head", F.substring(name, 1, 3))
    heads = distinct.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    bases = heads.select("head", (F.sum("n").over(Window.orderBy("head")) - F.col("n")).alias("base"))
    place = F.row_number().over(Window.partitionBy("head").orderBy(name))
    ids = distinct.join(bases, "head").select(name, (F.col("base") + place).cast("long").alias("name_id"))
    hits = nearest(queries, enrolled.join(ids, name), threshold, key, vector, "name_id", named_vector, keep_vector=keep_vector)
    return hits.join(ids, hits["match_id"] == ids["name_id"], "left").select("query", F.coalesce(name, F.lit(nobody)).alias("name"), F.coalesce("sim", F.lit(0.0)).alias("sim"), *(["vector"] if keep_vector else []))


def last_match(queries: DataFrame, registry: DataFrame, threshold: float = MATCH, key: str = "vec_id", vector: str = "embedding", registry_key: str = "id", registry_vector: str = "emb") -> DataFrame:
    """The highest registry id any of whose vectors is above the threshold (not the best score): query, match_id (-1: none)."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _alike(batches):
            (qk, q), (rk, r), tags = _matrix(row, "q"), _matrix(row, "r"), _tags(row)
            for lo in range(0, len(qk), TILE):
                part = slice(lo, lo + TILE)
                ids = np.where(_cosines(q[part], r) > threshold, rk, np.iinfo(np.int64).min).max(axis=1)
                hit = ids > np.iinfo(np.int64).min
                yield pa.RecordBatch.from_arrays([pa.array(qk[part][hit]), pa.array(tags[part][hit]), pa.array(ids[hit])], ["query", "tag", "match_id"])

    found = _pairs(queries, registry, key, vector, registry_key, registry_vector).mapInArrow(hits, "query long, tag long, match_id long")
    every = _tagged(queries, key, vector).select(F.col("key").alias("query"), "tag")
    return every.join(found.groupBy("query", "tag").agg(F.max("match_id").alias("match_id")), ["query", "tag"], "left").drop("tag").fillna({"match_id": -1})


def pair_distances(rows: DataFrame, within: float | None = None, cosine: bool = False, key: str = "vec_id", vector: str = "embedding", other: DataFrame | None = None) -> DataFrame:
    """Distances a, b, distance of all pairs (a < b; or all pairs of two sets), at most ``within`` if given."""

    two_sets = other is not None

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _alike(batches):
            (qk, q), (rk, r) = _matrix(row, "q"), _matrix(row, "r")
            same = row.column("q_block")[0].as_py() == row.column("r_block")[0].as_py()
            near = None if cosine or within is None else _within(q, r, within)
            for lo in range(0, len(qk), TILE):
                part = slice(lo, lo + TILE)
                if near is not None:
                    i, j, d = near(lo)
                else:
                    d = 1 - _cosines(q[part], r) if cosine else np.stack([_distances(np.broadcast_to(x, r.shape), r) for x in q[part]])
                    i, j = np.nonzero(np.ones(d.shape, bool) if within is None else d <= within)
                    d = d[i, j]
                a, b = qk[part][i], rk[j]
                if not two_sets:  # A pair of two blocks is met once; within a block it is met from both sides.
                    ok = a < b if same else a != b
                    a, b, d = np.minimum(a, b)[ok], np.maximum(a, b)[ok], d[ok]
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d)], ["a", "b", "distance"])

    pairs = _packed(rows, key, vector, "q", BLOCK).crossJoin(_packed(rows if other is None else other, key, vector, "r", BLOCK))
    return (pairs if two_sets else pairs.where("q_block <= r_block")).mapInArrow(far, "a long, b long, distance double")


def _distances(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    away = q - r
    return np.sqrt(np.einsum("ij,ij->i", away, away))


def _within(q: np.ndarray, r: np.ndarray, within: float):
    """A function of the first of TILE rows of q: (i, j, distance) of their pairs at most ``within``. A product rules out, by its rounding error, what is farther; the others are computed from their differences."""
    square, own = (r**2).sum(axis=1), (q**2).sum(axis=1)
    most = float(square.max() + own.max())
    kind = np.float32 if 1e-12 < most < 1e12 and within**2 < 1e12 else np.float64
    slack = 8 * float(np.finfo(kind).eps) * (q.shape[1] + 8) * (most + within**2)
    right = np.concatenate([-2 * r, square[:, None]], axis=1).astype(kind).T
    left = np.concatenate([q, np.ones((len(q), 1))], axis=1).astype(kind)

    def of(lo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        most_left = within**2 + slack - own[lo : lo + TILE]
        i, j = np.nonzero(left[lo : lo + TILE] @ right <= most_left[:, None].astype(kind)) if within >= 0 else (np.zeros(0, np.int64),) * 2
        d = np.concatenate([np.zeros(0), *(_distances(q[lo + i[at : at + EXACT]], r[j[at : at + EXACT]]) for at in range(0, len(i), EXACT))])
        ok = d <= within
        return i[ok], j[ok], d[ok]

    return of


def centroids(rows: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """Mean vector of each label: label, n, centroid. Means are taken per dimension with partial sums, then put in order."""
    parts = rows.select(label, F.posexplode(vector).alias("pos", "x"))
    means = parts.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    return means.groupBy(label).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("centroid"))


def without_mean(rows: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """``centred``: each vector less the mean vector of its group."""
    means = centroids(rows, by, vector).select(by, "centroid")
    return rows.join(means, by).withColumn("centred", F.zip_with(F.col(vector), F.col("centroid"), lambda x, m: x.cast("double") - m)).drop("centroid")


def assigned(rows: DataFrame, centres: DataFrame, label: str = "label", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each vector's nearest centroid by cosine, without a threshold (ties to the lowest label): query, match_id, sim."""
    return nearest(rows, centres, -np.inf, key, vector, label, "centroid")


def cluster_sizes(rows: DataFrame, label: str, least: int) -> DataFrame:
    """label, n, large (n at least ``least``)."""
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).withColumn("large", F.col("n") >= least)


def blended(rows: DataFrame, by: str, order: str, vector: str = "embedding") -> DataFrame:
    """The running blend of each key's vectors in order, stored = (stored + new) / 2; a vector of another size leaves it as it is."""
    lists = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, vector))).alias("items"))
    all_vectors = F.transform("items", lambda p: p[vector].cast("array<double>"))
    start = F.element_at(all_vectors, 1)
    step = lambda s, v: F.when(F.size(s) == F.size(v), F.zip_with(s, v, lambda a, b: (a + b) / 2)).otherwise(s)
    return lists.select(by, F.aggregate(F.slice(all_vectors, 2, 1 << 30), start, step).alias("blend"))


def wake_word(queries: DataFrame, bank: DataFrame, threshold: float = 0.7, key: str = "vec_id", vector: str = "embedding", bank_key: str = "vec_id", bank_vector: str = "embedding") -> DataFrame:
    """Whether any vector of the bank has (cosine + 1) / 2 above the threshold: query, hit."""
    return nearest(queries, bank, 2 * threshold - 1, key, vector, bank_key, bank_vector).select("query", (F.col("match_id") >= 0).alias("hit"))


def looked_up(tokens: DataFrame, symbols: DataFrame, ident: str = "id", skip_missing: bool = True) -> DataFrame:
    """Symbols of token ids; a missing id is skipped, or is an error."""
    joined = tokens.join(symbols, ident, "inner" if skip_missing else "left")
    if skip_missing:
        return joined
    return joined.withColumn("sym", F.when(F.col("sym").isNull(), F.raise_error(F.concat(F.lit("no symbol for id "), F.col(ident).cast("string"))).cast("string")).otherwise(F.col("sym")))


def missing_if_short(samples: Column, embedding: Column, least: int = 640) -> Column:
    """The embedding, or null if it was made of fewer than ``least`` samples."""
    return F.when(samples >= least, embedding)


def enrolment(segments: DataFrame, whole: DataFrame, name: str = "name", vector: str = "emb") -> DataFrame:
    """One vector per segment, their mean, and the vector of the whole file: name, kind, emb."""
    mean = centroids(segments, name, vector).select(name, F.lit("mean").alias("kind"), F.col("centroid").alias(vector))
    part = lambda rows, kind: rows.select(name, F.lit(kind).alias("kind"), F.col(vector).cast("array<double>").alias(vector))
    return part(segments, "segment").unionByName(mean).unionByName(part(whole, "whole"))


def phrase_hits(texts: DataFrame, phrases: DataFrame, text_key: str, phrase_key: str) -> DataFrame:
    """The texts that hold a phrase as a run of whole words: text_key, phrase_key. Both sides have an array of words, ``words``.

    A phrase is met by its first words, three at most, through an equi-join of slim rows; the texts are then joined to their candidates alone, and the whole phrase is looked for.
    Phrases without words, rows without a key and null arrays have no hits. Of rows that repeat a key each counts for itself.
    """
    phrases = phrases.where(F.size("words") > 0).select(F.col(phrase_key), "words")
    met = []
    for n in (1, 2, 3):
        of = F.size("words") == n if n < 3 else F.size("words") >= n
        starts = phrases.where(of).select(F.array_join(F.slice("words", 1, n), " ").alias("gram"), phrase_key)
        grams = F.transform(F.sequence(F.lit(1), F.size("words") - (n - 1)), lambda i: F.array_join(F.slice("words", i, F.lit(n)), " "))  # noqa: B023
        found = texts.where(F.size("words") >= n).select(text_key, F.explode(F.array_distinct(grams)).alias("gram"))
        met.append(found.join(starts, "gram").select(text_key, phrase_key))
    near = met[0].union(met[1]).union(met[2]).distinct()
    line = lambda name: F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")).alias(name)
    both = near.join(phrases.select(phrase_key, line("phrase")), phrase_key).join(texts.select(text_key, line("line")), text_key)
    return both.where(F.contains("line", "phrase")).select(text_key, phrase_key)
