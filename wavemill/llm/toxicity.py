"""Operator 12: toxicity by a factorization machine over hashed terms.

A text is the set of its hashed terms. The machine adds to a bias and a weight for each term an interaction for each pair of terms, the product of their factors, so that an insult beside the mention of a
group can weigh more than both alone. With x the set's indicator, all pairs cost no more than the terms: sum over pairs <v_i, v_j> = (|sum v_i|^2 - sum |v_i|^2) / 2.

It is fitted on a sample of SAMPLE_ROWS labelled rows of either class at most, drawn by a hash of doc_id and weighted back to the classes' shares; what reaches the driver are the counts of
the FEATURES terms whose share differs most between the classes, and which of these each sample row has. Every text is scored whole, in the task that reads it; the model that is broadcast has
FEATURES x (RANK + 1) numbers whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import arrow_rows, drop_caches_of_others, give_back, lean, shared_dir, stored, text_of

#: Buckets of the term hash; sample rows of a class; terms that the machine knows, and factors of a term; sample rows that a term must be in, and standard errors by which its share must differ between the classes.
BUCKETS, SAMPLE_ROWS, FEATURES, RANK, LEAST_ROWS, LEAST_SIGMA = 1 << 18, 10_000, 1024, 8, 5, 4.0
#: Passes over the sample, and steps at least.
EPOCHS, STEPS, BATCH, RATE, DECAY, FACTOR_DECAY, SEED = 40, 1500, 256, 0.05, 2e-5, 2e-4, 7
#: Texts of an Arrow batch; terms whose bucket a worker remembers; letters that are cut into terms at once.
BATCH_ROWS, REMEMBERED, SLICE = 500, 200_000, 1 << 20
_TERM = re.compile(r"\w+")


def terms_of(text: str) -> set[str]:
    """The different lower-case terms of a whole text; a long one is cut at places between terms, so that no list of all its terms is held."""
    if len(text) <= SLICE:
        return set(_TERM.findall(text.lower()))
    return {m.group().lower() for m in _TERM.finditer(text)}


def bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


class Machine:
    """A factorization machine: ``score`` of texts. Without terms every text has the bias's score."""

    def __init__(self, buckets: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.place = np.full(BUCKETS, -1, np.int32)
        self.place[buckets] = np.arange(len(buckets))
        self.bias, self.weights, self.factors = bias, weights, factors
        self.known: dict[str, int] = {}

    def features(self, text: str | None) -> np.ndarray:
        """The places of the text's terms that the machine knows."""
        found = set()
        for term in terms_of(text) if text else ():
            at = self.known.get(term)
            if at is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                at = self.known[term] = int(self.place[bucket(term)])
            if at >= 0:
                found.add(at)
        return np.array(sorted(found), np.int64)

    def score(self, text: str | None) -> float:
        at = self.features(text)
        v = self.factors[at]
        return float(_logistic(self.bias + self.weights[at].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum())))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}


def _logistic(z: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def trained(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rank: int = RANK) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, weights and factors by Adam on the weighted logistic loss with weight decay. x: rows x terms, 0 or 1."""
    rng = np.random.default_rng(SEED)
    share = np.average(y, weights=weight)
    model = [np.array([np.log((share + 1e-4) / (1 - share + 1e-4))]), np.zeros(x.shape[1]), rng.normal(0, 0.02, (x.shape[1], rank))]
    first, second, step = [np.zeros_like(m) for m in model], [np.zeros_like(m) for m in model], 0
    batches = -(-len(x) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // batches))
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), BATCH):
            rows = order[lo : lo + BATCH]
            here, v = x[rows].astype(np.float64), model[2]
            summed = here @ v
            z = model[0] + here @ model[1] + 0.5 * ((summed**2).sum(axis=1) - here @ (v * v).sum(axis=1))
            error = (_logistic(z) - y[rows]) * weight[rows] / weight[rows].sum()
            pull = here.T @ error
            gradient = [np.array([error.sum()]), pull + DECAY * model[1], here.T @ (error[:, None] * summed) - pull[:, None] * v + FACTOR_DECAY * v]
            step += 1
            for m, g, a, b in zip(model, gradient, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                m -= RATE / (1 + 4 * epoch / epochs) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return float(model[0][0]), model[1], model[2]


def fit(docs: DataFrame, labels: DataFrame, train: Column, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Machine:
    """Learn from the documents of labels (doc_id, toxic: 1 or 0) where ``train``, a condition on labels, holds: ``sample_rows`` of a class at most, whole texts.

    Rows that are null in doc_id or have another toxic value teach nothing; a doc_id with several labels is toxic if one says so; of rows of documents that repeat a doc_id one counts. A null or
    empty text has no terms. Without labelled rows of both classes the machine has no terms, and scores the toxic share (0 if nothing is labelled).
    """
    spark = docs.sparkSession
    marked = labels.where(train).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}  # two rows at most
    order = F.xxhash64("doc_id", F.lit(SEED))
    sample = marked.where("toxic = 0").orderBy(order, "doc_id").limit(sample_rows).union(marked.where("toxic = 1").orderBy(order, "doc_id").limit(sample_rows))

    @lean
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(np.fromiter(map(bucket, terms_of(t.as_py())), np.int32)).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "terms"])

    folder = shared_dir(spark, "toxicity")
    schema = "doc_id long, toxic int, terms binary"
    with arrow_rows(spark, BATCH_ROWS):
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))
        rows = texts.join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text").mapInArrow(hashed, schema)  # 2 x sample_rows rows are broadcast
        rows.groupBy("doc_id", "toxic").agg(F.min("terms").alias("terms")).write.parquet(folder)
    taken = stored(spark, folder, schema)

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for toxic, terms in zip(batch.column("toxic").to_pylist(), batch.column("terms").to_pylist(), strict=True):
                n[toxic, np.frombuffer(terms, np.int32)] += 1
        some = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[0, some]), pa.array(n[1, some])], ["term", "clean", "toxic"])

    drawn = {r["toxic"]: r["count"] for r in taken.groupBy("toxic").count().collect()}
    share = sizes.get(1, 0) / max(1, sum(sizes.values()))
    if len(drawn) < 2:
        return Machine(np.zeros(0, np.int64), float(np.log((share + 1e-4) / (1 - share + 1e-4))) if sizes else -30.0, np.zeros(0), np.zeros((0, RANK)))
    counts = taken.mapInArrow(counted, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).where(F.col("clean") + F.col("toxic") >= LEAST_ROWS)
    overall = (F.col("clean") + F.col("toxic")) / sum(drawn.values())
    sigma = F.sqrt((overall * (1 - overall) + 1e-9) * (1 / drawn[0] + 1 / drawn[1]))
    apart = F.abs(F.col("toxic") / drawn[1] - F.col("clean") / drawn[0]) / sigma
    best = counts.where(apart >= LEAST_SIGMA).orderBy(F.desc(apart), "term").limit(features)
    chosen = np.array([r["term"] for r in best.select("term").collect()], np.int64)
    place = np.full(BUCKETS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    @lean
    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [place[np.frombuffer(terms, np.int32)] for terms in batch.column("terms").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([f[f >= 0].astype(np.int16).tobytes() for f in found], pa.binary())], ["doc_id", "toxic", "terms"])

    rows = sorted((r["doc_id"], r["toxic"], bytes(r["terms"])) for r in taken.mapInArrow(known, schema).collect())  # 2 x sample_rows rows of FEATURES terms at most
    x, y = np.zeros((len(rows), len(chosen)), np.uint8), np.array([toxic for _, toxic, _ in rows], np.float64)
    for i, (_, _, terms) in enumerate(rows):
        x[i, np.frombuffer(terms, np.int16)] = 1
    weight = np.where(y == 1, sizes[1] / drawn[1], sizes[0] / drawn[0])
    return Machine(chosen, *trained(x, y, weight))


def toxicity(docs: DataFrame, machine: Machine, columns: list[str], threshold: float = 0.3) -> DataFrame:
    """``columns`` of the rows with score (0 to 1, higher: likelier toxic) and predicted (1 if score >= threshold, else 0).

    One row per input row, repeated ones too; a null or empty text, or one without known terms, has the bias's score; an empty table gives none. Columns that aren't asked for are not read, whatever their names.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        drop_caches_of_others(__name__)
        out = pa.array([model.value.score(t.as_py()) for t in texts], pa.float64())
        give_back()
        return out

    found = docs.select(*columns, scored(F.col("text").cast("string")).alias("found"))
    return found.select(*columns, F.col("found").alias("score"), (F.col("found") >= threshold).cast("int").alias("predicted"))
