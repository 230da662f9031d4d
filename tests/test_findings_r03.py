"""One test for each finding of FINDINGS_r03.md that was right: each would have failed before its mend."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.operators import clustering, folds, match, tracking
from wavemill.sources import tables


def test_f1_two_places_as_c_rounds(spark):
    rng = random.Random(1)
    values = [0.125, 0.285, 0.375, 0.475, 0.435, 0.995, 1.005, 0.0, -0.0, -0.001, -2.675, 1e15 + 0.125, 2.0**53 + 2, 0.99999, float("inf"), float("-inf"), float("nan")]
    values += [k / 200 for k in range(-400, 400)] + [rng.uniform(-2, 2) for _ in range(200)]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i long, v double")
    found = [r["s"] for r in rows.orderBy("i").select(tables.two_places(F.col("v")).alias("s")).collect()]
    assert found == [f"{v:.2f}" for v in values] + [None]
    lines = rows.where("i < 4").select(tables.status_line(F.col("i"), F.lit(True), F.col("v")).alias("s")).collect()
    assert sorted(r["s"] for r in lines) == ["0/1/0.12", "1/1/0.28", "2/1/0.38", "3/1/0.47"]


def with_copies(n, dims, seed):
    """Vectors of which a third are copies of one another and some are scaled, zero or tiny, by shuffled keys."""
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims))
    v[: n // 3] = v[rng.integers(0, 2, n // 3)]
    v[n // 3 : n // 3 + 8] *= 1e3
    v[n // 3 + 8] = 0
    v[n // 3 + 9] = 1e-6
    return rng.permutation(n), v


def brute_lists(keys, v, k):
    norms = np.linalg.norm(v, axis=1)
    out = {}
    for i, key in enumerate(keys):
        sim = np.einsum("ij,ij->i", np.broadcast_to(v[i], v.shape), v) / np.maximum(norms * norms[i], np.finfo(np.float32).eps)
        sim[i] = -np.inf
        out[int(key)] = [int(keys[j]) for j in np.lexsort((keys, -sim))[:k]]
    return out


def embedded(spark, keys, v):
    return spark.createDataFrame([(int(k), x.tolist()) for k, x in zip(keys, v, strict=True)], "vec_id long, embedding array<double>")


def counted_pairs(monkeypatch, cls, name, arg):
    seen, real = [], getattr(cls, name)

    def counting(self, *args):
        seen.append(len(args[arg]))
        return real(self, *args)

    monkeypatch.setattr(cls, name, counting)
    return seen


@pytest.mark.parametrize("blocks", [(2048, 4096), (64, 128)])
def test_f2_f3_lists_equal_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(match, "QUERIES", blocks[0])
    monkeypatch.setattr(match, "BLOCK", blocks[1])
    keys, v = with_copies(500, 12, 3)
    lists, rows = brute_lists(keys, v, 5), embedded(spark, keys, v)
    found = {}
    for r in match.top_k(rows, rows, 5).orderBy("query", "rank").collect():
        found.setdefault(r["query"], []).append(r["match_id"])
    assert found == lists
    near = {r["query"]: r["match_id"] for r in match.nearest(rows, rows, -2.0, exclude_same=True).collect()}
    assert near == {k: x[0] for k, x in lists.items()}


def test_f2_f3_few_pairs_in_double_precision(monkeypatch):
    """Of two blocks few pairs are computed exactly, and a third of copies doesn't change that."""
    import pyarrow as pa

    keys, v = with_copies(2000, 64, 5)
    order = np.argsort(keys)
    keys, v = keys[order].astype(np.int64), v[order]
    few = match._few_copies(keys, v, 5)
    q, r = (keys, keys, v), (keys[few], keys[few], v[few])
    columns = {f"{s}_{c}": [x.tobytes()] for s, side in (("q", q), ("r", r)) for c, x in zip(("keys", "tags", "vectors"), side, strict=True)}
    row = pa.RecordBatch.from_pydict(columns | {f"{s}_{c}": [x] for s in "qr" for c, x in (("block", 0), ("dim", 64))})
    seen = counted_pairs(monkeypatch, match._Best, "_take", 1)
    best = match._Best(row, 5, -np.inf)
    best.meet(row, True)
    lists = brute_lists(keys, v, 5)
    assert {int(k): m.tolist() for k, m in zip(keys, best.matches, strict=True)} == lists
    assert sum(seen) < 0.02 * len(v) ** 2


@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e9])
def test_f4_pairs_equal_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(match, "BLOCK", 100)
    keys, v = with_copies(300, 6, 7)
    v[1] += 1e3  # Near one another and far from the rest: a product loses their distance.
    v[2] = v[1] + 1e-6
    v *= scale
    within = 2.0 * scale
    d = {(min(a, b), max(a, b)): float(np.linalg.norm(v[i] - v[j])) for i, a in enumerate(keys.tolist()) for j, b in enumerate(keys.tolist()) if i < j}
    found = match.pair_distances(embedded(spark, keys, v), within=within).collect()
    assert sorted((r["a"], r["b"]) for r in found) == sorted(p for p, x in d.items() if x <= within)
    assert all(abs(r["distance"] - d[r["a"], r["b"]]) <= 1e-12 * scale for r in found)


def peak_of(run):
    import tracemalloc

    tracemalloc.start()
    out = run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_f5_f6_linkage_in_linear_memory():
    """Unit vectors whose centroids draw near to all others, as those of the queries: memory grows with their number."""
    peaks = []
    for n in (1000, 3000):
        points = np.random.default_rng(3).normal(size=(n, 64))
        merges, peak = peak_of(lambda p=points: clustering.linkage(p / np.linalg.norm(p, axis=1, keepdims=True)))
        assert len(merges) == n - 1
        peaks.append(peak)
    assert peaks[1] < 3.5 * peaks[0] and peaks[1] < 3000 * 64 * 8 * 12


def test_f5_small_clusters_in_linear_memory():
    """Many small clusters and many large ones: pairs and single points, all far apart, each small one goes to the large one it is nearest to."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(1500, 64))
    points = np.concatenate([centres, centres + 1e-4, centres + 0.7 * rng.normal(size=centres.shape)])
    labels, peak = peak_of(lambda: clustering.cluster(points, cutoff=0.05, min_large=2, merge_distance=0.7))
    assert len(set(labels.tolist())) == 1500 and (labels[:1500] == labels[1500:3000]).all()
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    assert (labels[3000:] == labels[(unit[3000:] @ unit[:1500].T).argmax(axis=1)]).mean() > 0.99
    assert peak < 1500 * 1500 * 8


def test_f8_short_streams_are_handed_on_together(monkeypatch):
    """Frames of output grow with the rows, not with the streams; the rows and their order are those of the program."""
    import pandas as pd

    class Twice(folds.Program):
        output = "value double"

        def take(self, state, rows):
            return self.frame([(v * 2,) for v in rows["value"] if v >= 0])

        def finish(self, state):
            return self.frame([(-1.0,)])

    given = {}
    monkeypatch.setattr(folds, "chunks_in_order", lambda rows, stream, order, run, schema: given.update(run=run))
    rows = type("Rows", (), {"schema": {"s": type("Field", (), {"dataType": type("Kind", (), {"simpleString": lambda self: "long"})()})()}, "select": lambda self, *c: self})()
    folds.folded(rows, Twice(), "s")
    pieces = [(k, True, pd.DataFrame({"s": k, "value": [float(k), -1.0]})) for k in range(12_000)]
    frames = list(given["run"](iter(pieces)))
    assert len(frames) <= 4
    whole = pd.concat(frames)
    assert whole["s"].tolist() == [k for k in range(12_000) for _ in range(2)] and whole["value"].tolist() == [x for k in range(12_000) for x in (2.0 * k, -1.0)]


def test_f8_lengths_are_computed_once(monkeypatch):
    seen, real = [], tracking.length
    monkeypatch.setattr(tracking, "length", lambda v: seen.append(1) or real(v))
    rng = np.random.default_rng(0)
    own = tracking.Tracker(threshold=0.5, prune_every=50)
    vectors = rng.normal(size=(400, 4))
    found = [own.step(True, v)[0] for v in vectors]
    assert len(seen) <= 2 * len(vectors)

    def plain(self, v):
        scores = {k: max(float(v @ x / max(np.linalg.norm(v) * np.linalg.norm(x), np.finfo(np.float32).eps)) for x in xs) for k, xs in self.vectors.items() if xs}
        hits = {k: s for k, s in scores.items() if s > self.threshold}
        return max(hits) if hits else -1

    monkeypatch.setattr(tracking.Tracker, "match", plain)
    again = tracking.Tracker(threshold=0.5, prune_every=50)
    assert found == [again.step(True, v)[0] for v in vectors]
