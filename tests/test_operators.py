"""Clustering, tracking, decoding, signal features, files and text against brute force and stated properties."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavemill import queries
from wavemill.functions import dsp
from wavemill.functions import text as X
from wavemill.functions import vectors as V
from wavemill.operators import clustering, decoding, match, timeline, tracking, windows

DEMO = np.array([(0, 0), (0, 1), (1, 0), (0, 4), (0, 3), (1, 4), (4, 0), (3, 0), (4, 1), (4, 4), (3, 4), (4, 3)], float)


def parts(labels):
    return {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(np.asarray(labels).tolist())}


def test_demo_partition():
    labels = clustering.flat_labels(clustering.linkage(DEMO), 12, 1.1)
    assert parts(labels) == {frozenset(x) for x in ({0, 1}, {2}, {3, 4}, {5}, {6, 7}, {8}, {9, 10}, {11})}


def brute_linkage(points):
    clusters, out = {i: (p, 1) for i, p in enumerate(points)}, []
    for k in range(len(points) - 1):
        d, a, b = min((np.linalg.norm(clusters[a][0] - clusters[b][0]), a, b) for a in clusters for b in clusters if a < b)
        (x, nx), (y, ny) = clusters.pop(a), clusters.pop(b)
        clusters[len(points) + k] = ((x * nx + y * ny) / (nx + ny), nx + ny)
        out.append((a, b, d, nx + ny))
    return np.array(out)


@pytest.mark.parametrize("seed", range(5))
def test_linkage_equals_brute_force(seed):
    points = np.random.default_rng(seed).normal(size=(40, 5))
    assert np.allclose(clustering.linkage(points), brute_linkage(points))


def test_clustering_ignores_order_and_merges_small():
    rng = np.random.default_rng(1)
    centres = np.eye(8)[:3]
    points = np.concatenate([c + rng.normal(0, 0.03, (6, 8)) for c in centres] + [np.eye(8)[0][None] + 0.4 * np.eye(8)[4][None]])
    labels = clustering.cluster(points, cutoff=0.3, min_large=2)
    order = rng.permutation(len(points))
    again = np.empty_like(labels)
    again[order] = clustering.cluster(points[order], cutoff=0.3, min_large=2)
    assert parts(labels) == parts(again) and len(parts(labels)) == 3 and labels[-1] == labels[0]
    assert clustering.cluster(points[:1]).tolist() == [0] and clustering.cluster(np.eye(3), 0.1, min_large=2).tolist() == [0, 0, 0]


def test_linkage_with_ties_and_equal_points():
    def by_place(points):
        c, size, name, out = {i: p for i, p in enumerate(points)}, dict.fromkeys(range(len(points)), 1), {i: i for i in range(len(points))}, []
        for k in range(len(points) - 1):
            d, x, y = min((np.sqrt(((c[j] - c[i]) ** 2).sum()), i, j) for i in c for j in c if i < j)
            c[y] = np.where(c[x] == c[y], c[x], (size[x] * c[x] + size[y] * c[y]) / (size[x] + size[y]))
            size[y] += size[x]
            out.append((min(name[x], name[y]), max(name[x], name[y]), d, size[y]))
            name[y] = len(points) + k
            del c[x]
        return np.array(out).reshape(-1, 4)

    rng = np.random.default_rng(2)
    for trial in range(60):
        points = rng.integers(0, 2 + trial % 4, (rng.integers(0, 25), 1 + trial % 3)).astype(float)
        assert np.allclose(clustering.linkage(points), by_place(points), atol=0)
    assert clustering.linkage(np.ones((3000, 4)))[:, 2].max() == 0


def test_linkage_takes_no_square():
    import tracemalloc

    points = np.random.default_rng(0).normal(size=(3000, 8))
    tracemalloc.start()
    merges = clustering.linkage(points)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(merges) == 2999 and peak < 3000 * 3000 * 8 / 10


def test_clusters_of_odd_rows(spark):
    nan = float("nan")
    rows = spark.createDataFrame([(1, i, [float(i % 2), 1.0, 0.0]) for i in range(6)] + [(1, 6, None), (1, 7, []), (1, 8, [None, 1.0, 1.0]), (1, 9, [nan, 1.0, 1.0]), (2, 1, None), (3, 1, [1.0, 2.0, 3.0])], "g int, i int, embedding array<double>").withColumns({"cluster": F.lit(1), "step": F.lit(2)})
    found = {(r["g"], r["i"]): r["cluster"] for r in clustering.clustered(rows, "g", "i", cutoff=0.3).collect()}
    assert found == {(1, i): i % 2 for i in range(6)} | {(3, 1): 0}
    steps = clustering.dendrogram(rows, "g", "i").collect()
    assert [(r["g"], r["size"]) for r in steps] == [(1, 2), (1, 2), (1, 3), (1, 3), (1, 6)] and clustering.dendrogram(rows.limit(0), "g", "i").count() == 0
    with pytest.raises(Exception, match="fixed number"):
        clustering.clustered(rows, "g", "i", count=2).collect()
    with pytest.raises(Exception, match="at least 4 and at most 2"):
        clustering.clustered(rows.where("g = 1"), "g", "i", least=4, most=2).collect()


def test_tracker_last_match_and_first():
    t = tracking.Tracker(threshold=0.4)
    a, b = np.array([1.0, 0, 0]), np.array([0, 1.0, 0])
    assert t.step(True, a) == (1, True, 0.0) and t.step(True, b) == (2, True, 0.0)
    both = (a + 0.9 * b) / np.linalg.norm(a + 0.9 * b)
    assert t.step(True, both)[0] == 2  # the highest id, though the first scores more
    assert tracking.Tracker(threshold=0.4, best=True, vectors={1: [a], 2: [b]}, last=2).step(True, both)[0] == 1
    assert t.step(False, a) == (0, False, 0.0)


def test_tracker_prunes_rare_ids():
    t = tracking.Tracker()
    t.step(True, np.array([0, 0, 1.0]))
    for _ in range(120):
        t.step(True, np.array([1.0, 0, 0]))
    assert list(t.vectors) == [2] and len(t.vectors[2]) == 50


def test_changes_spare_the_first_speaker():
    d = tracking.ChangeDetector()
    e = np.eye(3)
    assert [d.step(v) for v in (e[0], e[0], e[1], e[1], e[1])] == [False, False, True, False, False]


def test_diarist_relabels():
    d = tracking.Diarist()
    e = np.eye(6)
    for v in (e[0], e[1], e[0] + 0.1 * e[2]):
        d.step(v)
    assert d.keys == [0, 1, 0] and d.speakers()[0] == d.speakers()[2]


class EagerDiarist:
    """The definition: all keys are clustered anew after every miss."""

    def __init__(self, threshold):
        self.threshold, self.registry, self.labels, self.keys = threshold, [], [], []

    def step(self, v):
        scores = [tracking.cosine(v, x) for x in self.registry]
        key = int(np.argmax(scores)) if scores else -1
        if key >= 0 and scores[key] > self.threshold:
            self.registry[key] = (self.registry[key] + v) / 2
        else:
            key = len(self.registry)
            self.registry.append(v)
            self.labels = clustering.by_first_appearance(clustering.cluster(np.array(self.registry))).tolist()
        self.keys.append(key)


@pytest.fixture(scope="module")
def far_embeddings(spark, tmp_path_factory):
    """A folder with a small table of embeddings whose ids reach beyond 300, and its vectors by id."""
    rng, folder = np.random.default_rng(3), tmp_path_factory.mktemp("far")
    vectors = {k: rng.normal(size=8) for k in [0, 7, 199, 200, 299, 300, 1000, *range(2000, 2600, 10)]}
    spark.createDataFrame([(k, 0, v.tolist()) for k, v in vectors.items()], "vec_id long, label int, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    return str(folder), vectors


def test_online_diarize_over_the_whole_table(spark, far_embeddings):
    folder, vectors = far_embeddings
    want = {}
    for stream in range(10):
        ids, d = [k for k in sorted(vectors) if k % 10 == stream], EagerDiarist(0.3)
        for k in ids:
            d.step(vectors[k])
        want |= {k: d.labels[x] for k, x in zip(ids, d.keys, strict=True)}
    got = queries.queries()["online_diarize"](spark, folder).collect()
    assert {r.vec_id: r.speaker for r in got} == want and len(got) == len(want)


def test_phrase_boost():
    g = decoding.PhraseGraph([[1, 2], [1, 2, 3], [2, 3]], 1.0)
    state, total = g.root, 0.0
    for token in (1, 2, 3):
        state, gain = g.step(state, token)
        total += gain
    # three steps of 1, [1,2] done at 2 (2), [1,2,3] done at 3 (3) with its suffix [2,3] (2)
    assert total == 3 + 2 + 3 + 2 and g.finish(state) == -3
    state, gain = g.step(g.root, 1)
    assert g.step(state, 9)[1] == -1


def test_phrase_graph_holds_whole_phrases(spark, tmp_path, monkeypatch):
    """Phrases that share no words: 1.5 for each word of each whole occurrence, nothing for an opening."""
    phrases = ["alpha beta gamma delta epsilon", "one two", None]
    spark.createDataFrame(list(enumerate(phrases)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["x alpha beta gamma y", "x alpha beta gamma delta epsilon y one two", "one two one two z one", "beta gamma delta epsilon", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    count = lambda t: sum(1.5 * len(p.split()) * f" {t or ''} ".replace(" ", "  ").count(" " + p.replace(" ", "  ") + " ") for p in phrases if p)
    run = lambda: {r.doc_id: r.boost for r in queries.queries()["phrase_graph"](spark, str(tmp_path)).collect()}
    assert run() == {k: count(t) for k, t in enumerate(texts)} == {0: 0, 1: 10.5, 2: 6, 3: 0, 4: 0}
    monkeypatch.setattr(queries, "MAX_PHRASE_CHARS", 10)
    with pytest.raises(ValueError):
        run()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_beam_with_all_paths_is_exhaustive(seed):
    """With every path kept, the best sequence is the one of the largest summed probability, length-normalised."""
    rng = np.random.default_rng(seed)
    frames = rng.normal(size=(3, 3))
    logs = decoding.log_softmax(frames)
    total = {}
    for path in np.ndindex(3, 3, 3):
        key = tuple(t for t in path if t)
        total[key] = np.logaddexp(total.get(key, -np.inf), sum(logs[t, k] for t, k in enumerate(path)))
    best = max(total, key=lambda k: total[k] / (len(k) + 2))
    h = decoding.beam(frames, paths=27, lm=lambda tokens: 0.0)
    assert h.tokens == best and math.isclose(h.log_prob, total[best], abs_tol=1e-9)


def test_greedy_and_beam_in_spark(spark):
    rows = spark.createDataFrame([(1, [[0.0, 5.0], [5.0, 0.0], [0.0, 5.0]]), (2, [])], "utt int, frames array<array<double>>")
    assert [(r.utt, r.tokens, r.times) for r in decoding.decoded(rows).orderBy("utt").collect()] == [(1, [1, 1], [0, 2]), (2, [], [])]
    assert decoding.decoded(rows, "beam").orderBy("utt").first().tokens == [1, 1]


def test_log_mel_against_a_naive_transform():
    signal = np.sin(np.arange(1000) * 0.3)
    got = dsp.log_mel(signal, 20)
    assert got.shape == (1 + (1000 - 400) // 160, 20)
    frame = signal[160:560] - signal[160:560].mean()
    frame = np.concatenate([[frame[0] * (1 - 0.97)], frame[1:] - 0.97 * frame[:-1]])
    frame = np.pad(frame * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(400) / 399)), (0, 112))
    k, n = np.arange(256)[:, None], np.arange(512)
    power = np.abs((frame * np.exp(-2j * np.pi * k * n / 512)).sum(axis=1)) ** 2
    assert np.allclose(got[1], np.log(np.maximum(dsp.mel_bank(20, 16000, 512) @ power, dsp.EPSILON)))
    assert dsp.log_mel(signal[:399]).shape[0] == 0


def test_keyword_features_shape():
    assert dsp.keyword_features(np.zeros(24000), np.ones((257, 64))).shape == (149, 64)


@pytest.mark.parametrize(("a", "b"), [(16000, 8000), (8000, 16000), (44100, 16000)])
def test_resampling_in_blocks_is_the_same(a, b):
    signal = np.sin(np.arange(3000) * 0.05) + 0.3 * np.sin(np.arange(3000) * 0.21)
    whole = dsp.Resampler(a, b)(signal, flush=True)
    own, out = dsp.Resampler(a, b), []
    for lo in range(0, 3000, 271):
        out.append(own(signal[lo : lo + 271], flush=lo + 271 >= 3000))
    assert np.allclose(np.concatenate(out), whole) and abs(len(whole) - 3000 * b / a) < 2
    middle = np.arange(len(whole) // 4, len(whole) // 2)
    want = np.sin(middle * a / b * 0.05) + 0.3 * np.sin(middle * a / b * 0.21)
    assert np.abs(whole[middle] - want).max() < 0.02


def test_chunks_stacking_and_mean():
    f = np.arange(500 * 2, dtype=float).reshape(500, 2)
    chunks = dsp.cyclic_chunks(f)
    assert [len(c) for c in chunks] == [198] * 3 and (chunks[2][104:] == chunks[0][:94]).all()
    assert (dsp.cyclic_chunks(f[:50])[0][50:100] == f[:50]).all()
    assert dsp.stacked(f, 7, 6).shape == (83, 14) and (dsp.stacked(f, 7, 6)[1] == f[6:13].ravel()).all()
    assert np.allclose(dsp.without_mean(f).mean(axis=0), 0)
    assert np.allclose(dsp.dft(dsp.dft(f[:, 0]), inverse=True).real, f[:, 0])


def test_wav_and_pcm_files(spark, tmp_path):
    from wavemill.sources import audio

    samples = np.array([0, 1, -2, 32767, -32768, 40000])
    rows = spark.createDataFrame([("a", samples.astype(float).tolist())], "name string, samples array<double>")
    assert audio.write_wav(rows, str(tmp_path)).first().bytes == 44 + 12
    (tmp_path / "b.pcm").write_bytes(np.array([5, -6], "<i2").tobytes())
    raw = (tmp_path / "a.wav").read_bytes()
    (tmp_path / "c.wav").write_bytes(raw[:12] + b"LIST" + (4).to_bytes(4, "little") + b"abcd" + raw[12:-2])  # a chunk before, and cut short
    got = {r.path.rsplit("/", 1)[1]: (r.channels, r.rate, r.bits, r.samples) for r in audio.read_audio(spark, str(tmp_path)).collect()}
    clipped = [0.0, 1.0, -2.0, 32767.0, -32768.0, 32767.0]
    assert got == {"a.wav": (1, 16000, 16, clipped), "b.pcm": (1, 16000, 16, [5.0, -6.0]), "c.wav": (1, 16000, 16, clipped[:-1])}
    for bits in (8, 32):
        assert audio.decode_wav(audio.encode_wav([1, -5], bits=bits))[3].tolist() == [1, -5]
    with pytest.raises(ValueError):
        audio.decode_wav(b"nothing here at all")


def test_text_sources(spark, tmp_path):
    from wavemill.sources import tables

    (tmp_path / "v.txt").write_text("1 2.5\n\n-3 4\n")
    assert sorted(r.vector for r in tables.read_vectors(spark, f"{tmp_path}/v.txt").collect()) == [[-3.0, 4.0], [1.0, 2.5]]
    tables.write_vectors(tables.read_vectors(spark, f"{tmp_path}/v.txt"), f"{tmp_path}/w")
    assert tables.read_vectors(spark, f"{tmp_path}/w").count() == 2
    (tmp_path / "e.json").write_text('{"ann": [[1, 2], [3, 4]], "bob": [[5, 6]]}')
    assert {(r["name"], r["pos"], tuple(r["emb"])) for r in tables.read_enrolled(spark, f"{tmp_path}/e.json").collect()} == {("ann", 0, (1, 2)), ("ann", 1, (3, 4)), ("bob", 0, (5, 6))}
    (tmp_path / "t.txt").write_text("<blk> 0\n▁hello 1\nlo 2\n<0x0> 3\n<0xFF> 258\n 9\n", encoding="utf-8")
    symbols = tables.read_symbols(spark, f"{tmp_path}/t.txt")
    assert {r.id: bytes(r.sym) for r in symbols.collect()} == {0: b"<blk>", 1: b" hello", 2: b"lo", 3: b"<0x0>", 258: b"\xff", 9: b" "}
    phrases = spark.createDataFrame([("▁hello lo",)], "value string")
    assert tables.encode_hot_words(phrases, symbols).first().token_ids == [1, 2]
    with pytest.raises(Exception, match="no id for token"):
        tables.encode_hot_words(spark.createDataFrame([("what",)], "value string"), symbols).collect()
    (tmp_path / "voice.json").write_text('{"audio": {"sample_rate": 22050}, "phoneme_type": "text", "phoneme_id_map": {"ab": [1], "c": [2, 3]}, "phoneme_map": {"x": ["y"]}}')
    voice = tables.read_voice(spark, f"{tmp_path}/voice.json").first()
    assert voice.phoneme_id_map == {"a": [1], "c": [2, 3]} and voice.audio.sample_rate == 22050


def test_options():
    from dataclasses import dataclass

    from wavemill.sources import tables

    @dataclass
    class Options:
        num_threads: int = 1
        debug: bool = False
        scale: float = 0.5

    got = tables.read_options(Options(), ["--Num_Threads=4 # four", "", "--scale=2"], ["--debug", "--num-threads=8"])
    assert got == Options(8, True, 2.0)
    with pytest.raises(ValueError):
        tables.read_options(Options(), [], ["--nothing=1"])


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    words = lambda *w: F.array(*map(F.lit, w))
    assert value(X.sentences(F.lit("你好，世界。a.b,,c!"))) == ["你好", "世界", "a", "b", "c"]
    assert value(X.join_merged(words("hel@@", "lo", "world", "你", "好", "ok"))) == " hello world 你好 ok"
    assert value(X.join_merged(words("你", "好"))) == "你好"
    assert value(X.base64_token(F.lit("aGVsbG8="))) == b"hello" and value(X.base64_token(F.lit("=abc"))) == b" "
    assert value(X.to_integers(F.lit("1,-2,3"))) == [1, -2, 3] and value(X.to_integers(F.lit("1,2x"))) is None and value(X.to_integers(F.lit("99999999999"))) is None
    assert value(X.to_real(F.lit("-1.#INF"))) == -math.inf and math.isnan(value(X.to_real(F.lit("NaN")))) and value(X.to_real(F.lit("1.5e2"))) == 150 and value(X.to_real(F.lit("1.5x"))) is None
    assert value(X.codepoints(F.lit("ÉA"))) == ["e", "́", "a"] and value(X.codepoints(F.lit("Straße"), "upper")) == list("STRASSE")
    ids = {"_": [0], "^": [1], "$": [2], "a": [14], "b": [15, 16]}
    assert value(X.phoneme_ids(words("a", "?", "b"), ids)) == [1, 0, 14, 0, 15, 16, 0, 2]
    assert value(X.missing_phonemes(words("a", "?"), ids)) == ["?"]
    with pytest.raises(Exception, match="no id for phoneme"):
        value(X.phoneme_ids(words("?"), ids, intersperse=False))
    assert value(X.mapped_phonemes(words("a", "c"), {"a": ["x", "y"]})) == ["x", "y", "c"]
    assert value(X.peak_times(F.array(F.lit(0.2), F.lit(1.0), F.lit(1.0)), F.lit(1))) == [0.02]
    assert value(X.peak_times(F.array(F.lit(1.0), F.lit(1.0)), F.lit(5))) is None
    assert value(X.without_language_flags(F.lit("(en)hello(fr)"))) == "hello"
    assert len(X.PHONEMES) == 154 and X.default_phoneme_map()["↑"] == [151] and X.default_phoneme_map(X.PHONEMES_UK)["—"] == [48]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 8)), min_size=1, max_size=30), st.integers(0, 6))
def test_interval_merge(spark, spans, collar):
    rows = sorted((float(a), float(a + d)) for a, d in spans)
    want = []
    for a, b in rows:
        if want and max(0.0, a - want[-1][1]) < collar:
            want[-1][1] = max(want[-1][1], b)
        else:
            want.append([a, b])
    df = spark.createDataFrame([("x", a, b) for a, b in rows], "class string, start double, end double")
    got = timeline.merged_intervals(df, float(collar))
    assert sorted([r.start, r.end] for r in got.collect()) == sorted(want)


def test_overlap_add_with_missing_frames_and_nan(spark):
    rows = [(0, 0, 0, 1.0), (0, 1, 0, math.nan), (1, 0, 0, 3.0), (1, 1, 0, 5.0)]
    df = spark.createDataFrame(rows, "chunk long, frame long, class int, score double")
    chunks, frames = timeline.Geometry(0.0, 1.0, 2.0), timeline.Geometry(0.0, 1.0, 1.0)
    got = {r.frame: r.value for r in timeline.overlap_added(df, chunks, frames, missing=-1.0, total_chunks=2).collect()}
    assert got[0] == 2.0 and got[1] == 5.0 and all(v == -1.0 for k, v in got.items() if k > 1)


def test_count_windows_cover_every_sample_once(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(23)], "stream_id int, idx long, value double")
    tumbled = windows.count_windows(df, 5).orderBy("window").collect()
    assert sum((r.samples for r in tumbled), []) == [float(i) for i in range(20)]
    assert [r.start for r in windows.count_windows(df, 5, 2).orderBy("window").collect()] == list(range(0, 19, 2))


def test_matching_edges(spark):
    reg = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    q = spark.createDataFrame([(10, [2.0, 0.0]), (11, [0.0, 1.0]), (12, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = {r["query"]: r["match_id"] for r in match.nearest(q, reg).collect()}
    assert got == {10: 1, 11: -1, 12: -1}
    with pytest.raises(Exception, match="zero"):
        q.select(V.cosine_distance(F.col("embedding"), F.array(F.lit(0.0), F.lit(0.0)))).collect()
    with pytest.raises(Exception, match="no symbol"):
        match.looked_up(spark.createDataFrame([(5,)], "id int"), spark.createDataFrame([(1, "a")], "id int, sym string"), skip_missing=False).collect()


def test_streaming_trackers_windows_and_features(spark, tmp_path):
    from wavemill.streaming import stateful

    rng = np.random.default_rng(5)
    rows = [(s, i, float(x), [float(y) for y in rng.normal(size=4)]) for s in (1, 2) for i, x in enumerate(rng.normal(size=1500))]
    df = spark.createDataFrame(rows, "stream_id long, idx long, value double, embedding array<double>")
    for k in range(3):
        df.where(f"idx div 500 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")

    def run(build, name):
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        out = build(source).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start(f"{tmp_path}/{name}")
        out.awaitTermination(180)
        return spark.read.parquet(f"{tmp_path}/{name}")

    got = run(lambda s: stateful.count_windows(s, 400, 300), "windows")
    want = windows.count_windows(df, 400, 300)
    assert sorted((r.stream_id, r.start, r.samples) for r in got.collect()) == sorted((r.stream_id, r.start, r.samples) for r in want.collect())
    got = {(r.stream_id, r.frame): r.feat for r in run(stateful.features, "features").collect()}
    whole = dsp.log_mel(np.array([r[2] for r in rows if r[0] == 1]))
    assert len(got) == 2 * len(whole) and np.allclose([got[1, k] for k in range(len(whole))], whole)
    got = run(lambda s: stateful.tracked(s, threshold=0.9), "tracks").collect()
    want = tracking.tracked(df, "stream_id", "idx", threshold=0.9).collect()
    assert sorted((r.stream_id, r.idx, r.ident) for r in got) == sorted((r.stream_id, r.idx, r.ident) for r in want)


def test_pipelines(spark):
    from wavemill.plans import pipelines, scorers

    rng = np.random.default_rng(0)
    silence, a, b = np.zeros(24000), np.sin(np.arange(40000) * 0.3), np.sin(np.arange(40000) * 1.2)
    wave = np.concatenate([silence, a, silence, b, silence, a, silence]) + rng.normal(0, 1e-4, 4 * 24000 + 3 * 40000)
    rows = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(wave)], "stream_id long, idx long, value double")
    got = pipelines.diarise_online(rows, scorers.EnergyVad(), scorers.create("spelled"), scorers.MeanSpectrum()).orderBy("start").collect()
    assert len(got) == 3 and got[0].speaker == got[2].speaker != got[1].speaker and all(r.text for r in got)
    sound = pipelines.text_to_sound(spark.createDataFrame([(1, "Ab, c.")], "id int, text string"), scorers.Beep()).first().sound
    assert len(sound) == 80 * (7 + 7) + 2 * 1600 and max(sound) == 32767
    timed = scorers.scored(rows.limit(1).select("stream_id", F.array("value").alias("samples")), scorers.EnergyVad(), timed=True)
    assert scorers.real_time_factor(timed).first().rtf > 0


def test_matching_of_odd_rows(spark):
    """Nulls, empty and ragged vectors, repeated ids, and names that tie."""
    registry = spark.createDataFrame([(10, None), (11, [1.0, 0.0]), (12, [0.0, 1.0, 0.0]), (13, []), (14, [None, 1.0]), (15, [1.0, 0.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.1]), (1, [0.0, 2.0, 0.1]), (2, None), (3, [1.0]), (4, [2.0, 0.0]), (4, [2.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((r["query"], r.match_id) for r in match.nearest(queries, registry, 0.4).collect())
    assert got == [(1, 11), (1, 12), (2, -1), (3, -1), (4, 11), (4, 11)]
    last = sorted((r["query"], r.match_id) for r in match.last_match(queries, registry.withColumnsRenamed({"vec_id": "id", "embedding": "emb"}), 0.4).collect())
    assert last == [(1, 12), (1, 15), (2, -1), (3, -1), (4, 15), (4, 15)]
    lists = sorted((r["query"], r["rank"], r.match_id) for r in match.top_k(queries, registry, 2).collect())
    assert lists == [(1, 1, 11), (1, 1, 12), (1, 2, 15), (4, 1, 11), (4, 2, 15)]
    named = registry.select(F.concat(F.lit("n"), (20 - F.col("vec_id")).cast("string")).alias("name"), F.col("embedding").alias("emb"))
    found = sorted((r["query"], r["name"], round(r.sim, 3)) for r in match.best_named(queries, named).collect())
    assert found == [(1, "n5", 0.995), (1, "n8", 0.999), (2, "Nobody", 0.0), (3, "Nobody", 0.0), (4, "n5", 1.0), (4, "n5", 1.0)]
    assert match.nearest(queries, registry.limit(0), 0.4).where("match_id >= 0").count() == 0
    assert match.nearest(queries.where("vec_id = 2"), registry.where("vec_id = 10"), 0.4).collect()[0].match_id == -1


def test_shapes_are_checked(spark):
    from wavemill.operators import arrays

    rows = spark.createDataFrame([([[1.0, 2.0]], [[3.0]], None)], "a array<array<double>>, b array<array<double>>, c array<array<double>>")
    for bad in (arrays.concatenated(F.col("a"), F.col("b")), arrays.concatenated(F.col("a"), F.concat("b", "b"), dim=1), arrays.stacked(F.get("a", F.lit(0)), F.get("b", F.lit(0)))):
        with pytest.raises(Exception, match="differ"):
            rows.select(bad).collect()
    assert rows.select(arrays.concatenated(F.col("a"), F.col("b"), dim=1).alias("x"), arrays.concatenated(F.col("a"), F.col("c")).alias("y"), arrays.tail_padded(F.col("c")).alias("z")).first() == ([[1.0, 2.0, 3.0]], None, None)


def test_options_from_a_named_file_and_their_checks(tmp_path):
    import dataclasses

    from wavemill.sources import tables

    @dataclasses.dataclass
    class Options:
        rate: int = dataclasses.field(default=16000, metadata={"unsigned": True})
        share: float = 0.5
        model: str = ""

    (tmp_path / "o.conf").write_text("--rate=8000 # low\n--share=2\n")
    found = tables.read_options(Options(), [], ["--share=0.25", f"--config={tmp_path}/o.conf"])
    assert (found.rate, found.share) == (8000, 0.25)
    with pytest.raises(ValueError, match="negative"):
        tables.read_options(Options(), [], ["--rate=-1"])
    checks = {"rate": tables.POSITIVE, "share": tables.SHARE, "model": tables.EXISTING_FILE}
    assert tables.problems(found, checks) == ["model: there is no such file"]
    assert tables.problems(dataclasses.replace(found, share=2.0, model=str(tmp_path / "o.conf")), checks) == ["share: must lie in 0 to 1"]


class Adder:
    """A session of a model with two inputs, a constant, a state and two outputs."""

    def __init__(self, path):
        self.path = path

    def run(self, names, fed):
        total = fed["h"] + fed["x"].sum() + fed["sr"]
        found = {"prob": total[:, 0], "hn": total, "twice": fed["x"] * 2}
        return [found[n] for n in names]

    def get_modelmeta(self):
        return type("Meta", (), {"custom_metadata_map": {"model_type": "adder"}})


def test_models_of_many_inputs_and_states(spark):
    from wavemill.plans import scorers

    model = scorers.OnnxModel("m", {"x": "samples", "sr": np.float32(1)}, {"prob": ("prob", "double"), "twice": ("twice", "array<array<double>>")}, {"h": ("hn", (1, 1))}, {"x": (2, 2)}, Adder)
    rows = spark.createDataFrame([(s, i, [float(i)] * 4) for s in ("a", "b") for i in range(5)], "stream_id string, idx long, samples array<double>")
    got = scorers.scored_in_order(rows, model, "stream_id", "idx").collect()
    assert len(got) == 10
    for r in got:
        assert r.prob == sum(4 * i + 1 for i in range(r.idx + 1)) and r.twice == [[2.0 * r.idx] * 2] * 2
    assert scorers.recogniser(model, {"adder": lambda m: m}) is model and scorers.recogniser(model, {"x": lambda m: 1, "adder": lambda m: 2}, "x") == 1
    with pytest.raises(ValueError, match="adder"):
        scorers.recogniser(model, {"other": lambda m: m})


def test_prompted_decoding(spark):
    """Language by the best logit or by the row, the end symbol, half the context, and null frames."""
    from wavemill import queries as own

    frames = np.array([[0, 0, 0, 0, 0, 1, 2, 3], [9, 0, 0, 0, 0, 0, 0, 0], [9, 0, 0, 0, 0, 0, 0, 0], [0, 0, 5, 0, 0, 0, 0, 0], [0, 0, 0, 0, 6, 0, 0, 0]], float).tolist()
    rows = spark.createDataFrame([(1, frames, None), (2, frames, 5), (3, None, 5), (4, [*frames, frames[1]], None)], "utt long, frames array<array<double>>, lang int")
    got = {r.utt: (r.language, r.tokens) for r in decoding.prompted(rows, own.Table(), 0, 1, 2, 3, [5, 6, 7], 16, "lang").collect()}
    assert got == {1: (7, [2, 4, 4, 4]), 2: (5, [2, 4, 4, 4]), 3: (None, None), 4: (7, [2, 4])}


def test_cleared_streams(spark):
    rows = spark.range(10).select((F.col("id") % 2).alias("stream_id"), F.col("id").alias("idx"))
    marks = spark.createDataFrame([(0, 4)], "stream_id long, cleared_to long")
    assert sorted(r.idx for r in windows.cleared(rows, marks).collect()) == [1, 3, 5, 6, 7, 8, 9]


def test_a_replayed_batch_is_kept_once(spark, tmp_path):
    from wavemill.streaming import stateful

    rows = lambda n: spark.createDataFrame([("s", i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(n, n + 4)], "stream_id string, start long, embedding array<double>")
    for batch_id, batch in ((0, rows(0)), (1, rows(4)), (1, rows(4))):
        got = stateful.relabelled(batch, batch_id, f"{tmp_path}/history").collect()
    assert sorted(r.start for r in got) == list(range(8)) and {r.stream_id for r in got} == {"s"}
    assert len({r.speaker for r in got if r.start % 2}) == 1


def test_phrase_hits_equals_brute_force(spark):
    """Short and long phrases, a shared opening, repeated keys, nulls, empty sides, and a gram that only occurs across two words."""
    rnd = random.Random(5)
    text = lambda n: [rnd.choice("abc") for _ in range(n)]
    texts = [(i % 37, text(rnd.randrange(0, 30))) for i in range(40)] + [(100, None), (None, ["a"]), (101, ["ab", "c"]), (102, [])]
    phrases = [(i, text(1 + i % 8)) for i in range(30)] + [(7, ["a", "b", "c", "a"]), (50, []), (51, None), (None, ["a"]), (52, ["b", "c"]), (53, ["a", "b", "c", "zz"])]
    t, p = spark.createDataFrame(texts, "t long, words array<string>"), spark.createDataFrame(phrases, "p long, words array<string>")
    holds = lambda w, x: any(w[i : i + len(x)] == x for i in range(len(w)))
    want = [(a, b) for a, w in texts for b, x in phrases if a is not None and b is not None and w and x and holds(w, x)]
    assert sorted(map(tuple, match.phrase_hits(t, p, "t", "p").collect())) == sorted(want)
    assert match.phrase_hits(t.limit(0), p, "t", "p").count() == match.phrase_hits(t, p.limit(0), "t", "p").count() == 0
