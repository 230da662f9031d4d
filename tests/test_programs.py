"""Folds over streams, in batch and in micro-batches, batched decoding and growing registries."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill import queries
from wavemill.functions import dsp
from wavemill.functions import text as X
from wavemill.operators import batched, decoding, folds, match, signals, tracking, vad
from wavemill.sources import audio, wav_sink
from wavemill.streaming import programs

ROWS = "stream_id long, idx long, value double, ts timestamp"


def signal(streams=3, n=400, seed=0):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    return [(s, i, round(rng.uniform(0, 100), 2), start + dt.timedelta(seconds=i)) for s in range(streams) for i in range(n + 7 * s)]


def buffer_rows(values, capacity, block, window, hop, reads):
    out, written, start = [], 0, 0
    while written + block <= len(values):
        written += block
        if written - start > capacity:
            out.append(("overrun", start, written - start - capacity))
            start = written - capacity
        for _ in range(reads):
            if written - start >= window:
                out.append(("window", start, window))
                start += hop
    if start < len(values):
        out.append(("rest", start, len(values) - start))
    return out


def wake_rows(values, program):
    out, at, listening = [], 0, False
    while at + (size := program.sizes[listening]) <= len(values):
        window = np.array(values[at : at + size])
        if listening:
            out.append(("text", at, at + size, program.text(window)))
            at, listening = at + program.hops[1], False
        elif program.wake(window):
            out.append(("wake", at, at + size, None))
            at, listening = at + size, True
        else:
            at += program.hops[0]
    return out


def change_rows(values, program):
    out, reported = [], 0
    for at in range(0, len(values) - program.window + 1, program.hop):
        frames = program.scores(np.array([values[at : at + program.window]]))[0]
        share = [sum(f[k] > program.onset for f in frames[program.skip :]) / (len(frames) - program.skip) for k in range(frames.shape[1])]
        k = share.index(max(share))
        if share[k] > program.least and k != reported:
            reported = k
            out.append((at, k, share[k]))
    return out


BUFFER = folds.BoundedBuffer(capacity=20, block=5, window=8, hop=3)
WAKE = folds.WakeThenText(queries.loud, queries.quiet_count, 6, 2, 10, 9)
CHANGE = folds.SpeakerChange(queries.thirds, window=12, hop=3, skip=2, least=0.35)
CASES = [
    (BUFFER, lambda v: buffer_rows(v, 20, 5, 8, 3, 1), lambda r: (r["kind"], r["start"], r["n"])),
    (WAKE, lambda v: wake_rows(v, WAKE), lambda r: (r["kind"], r["start"], r["end"], r["text"])),
    (CHANGE, lambda v: change_rows(v, CHANGE), lambda r: (r["start"], r["class"], r["activity"])),
]


@pytest.mark.parametrize("program,brute,shown", CASES, ids=["buffer", "wake", "change"])
def test_programs_against_brute_force(spark, program, brute, shown):
    rows = signal()
    df = spark.createDataFrame([*rows, (None, 1, 1.0, None)], ROWS).repartition(5)
    got = folds.folded(df, program).collect()
    want = {s: brute([r[2] for r in rows if r[0] == s]) for s in range(3)}
    assert all(len(w) > 3 for w in want.values())
    assert {s: sorted(shown(r) for r in got if r["stream_id"] == s) for s in range(3)} == {s: sorted(w) for s, w in want.items()}
    assert folds.folded(df.limit(0), program).count() == 0


@pytest.mark.parametrize("program,brute,shown", CASES, ids=["buffer", "wake", "change"])
def test_cuts_into_batches_make_no_difference(program, brute, shown):
    import pandas as pd

    rng = random.Random(4)
    values = [r[2] for r in signal(1)]
    state, at, out = program.begin(), 0, []
    while at < len(values):
        n = rng.choice([1, 2, 3, 50])
        out += program.take(state, pd.DataFrame({"value": values[at : at + n]})).to_dict("records")
        at += n
    out += program.finish(state).to_dict("records")
    assert [shown(r) for r in out] == brute(values)


def test_samples_of_windows_and_the_rest(spark):
    rows = signal(1, 103)
    got = folds.folded(spark.createDataFrame(rows, ROWS), BUFFER).where("samples is not null").collect()
    assert all(r["samples"] == [x[2] for x in rows[r["start"] : r["start"] + r["n"]]] for r in got)
    with pytest.raises(ValueError, match="capacity"):
        folds.BoundedBuffer(capacity=10, block=20)


def streamed(spark, folder, files, build, name):
    schema = ROWS
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/in/{k}")
    return run(spark, folder, build, name)


def run(spark, folder, build, name):
    source = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    out = build(source).writeStream.format("parquet").option("checkpointLocation", f"{folder}/{name}-state").trigger(availableNow=True).start(f"{folder}/{name}")
    out.awaitTermination(240)
    return spark.read.parquet(f"{folder}/{name}").collect()


def test_state_ends_and_late_rows_come_out(spark, tmp_path):
    """Two streams end; the third's later rows move the watermark on. A replay from the start, and a restart after half, give the same rows."""
    rows = signal(2, 120)
    start = dt.datetime(2024, 1, 1)
    first = [r for r in rows if r[1] < 60]
    second = [r for r in rows if r[1] >= 60] + [(0, 30, 1.0, start + dt.timedelta(seconds=61)), (1, 59, 1.0, start + dt.timedelta(seconds=61))]
    far = [(9, i, 1.0, start + dt.timedelta(hours=3, seconds=i)) for i in range(3)]
    later = [(9, i, 1.0, start + dt.timedelta(hours=3, seconds=i)) for i in range(3, 6)]
    files = [first, second, far, later]
    build = lambda s: programs.program(s, BUFFER, idle="10 minutes", delay="1 minute")
    got = streamed(spark, str(tmp_path / "whole"), files, build, "out")
    key = lambda r: (r["stream_id"], r["output"], str(r["kind"]), r["late_idx"], r["start"], r["n"], r["samples"])
    want = [(s, *x) for s in (0, 1) for x in buffer_rows([r[2] for r in rows if r[0] == s], 20, 5, 8, 3, 1)]
    assert sorted((r["stream_id"], r["kind"], r["start"], r["n"]) for r in got if r["output"] == "row" and r["stream_id"] < 2) == sorted(want)
    assert sorted((r["stream_id"], r["late_idx"]) for r in got if r["output"] == "late") == [(0, 30), (1, 59)]
    state = spark.read.format("statestore").option("stateVarName", "state").load(str(tmp_path / "whole/out-state"))
    assert {r["key"]["stream_id"] for r in state.collect()} == {9}

    halves = str(tmp_path / "halves")
    once = streamed(spark, halves, files[:2], build, "out")
    assert len(once) < len(got)
    for k, part in enumerate(files[2:], 2):
        spark.createDataFrame(part, ROWS).coalesce(1).write.parquet(f"{halves}/in/{k}")
    again = run(spark, halves, build, "out")
    assert sorted(map(str, map(key, again))) == sorted(map(str, map(key, got)))


@pytest.mark.parametrize("program", [WAKE, CHANGE], ids=["wake", "change"])
def test_programs_on_streams_equal_the_batch_form(spark, tmp_path, program):
    rows = signal(2, 150, seed=2)
    files = [[r for r in rows if r[1] // 40 == k] for k in range(5)]
    got = streamed(spark, str(tmp_path), [f for f in files if f], lambda s: programs.program(s, program), "out")
    want = folds.folded(spark.createDataFrame(rows, ROWS), program).collect()
    names = [c for c in want[0].__fields__ if c != "stream_id"]
    assert len(want) > 4
    assert sorted(str((r["stream_id"], *[r[c] for c in names])) for r in got) == sorted(str((r["stream_id"], *[r[c] for c in names])) for r in want)


def test_a_registry_that_grows_while_it_is_asked(spark, tmp_path):
    rng = np.random.default_rng(3)
    people = {"ann": rng.normal(size=8), "bob": rng.normal(size=8)}
    noisy = lambda v, s: [float(x) for x in v + rng.normal(0, s, 8)]
    batches = []
    for k in range(4):  # voices drift away from what was enrolled
        for v in people.values():
            v += rng.normal(0, 0.35, 8)
        batches.append([(10 * k + i, noisy(v, 0.1)) for i, v in enumerate([*people.values(), rng.normal(size=8) * 0.01])] + [(10 * k + 8, None), (10 * k + 9, [float("nan")] * 8)])
    enrolled = [("ann", noisy(people["ann"], 0.1)), ("bob", noisy(people["bob"], 0.1)), ("bob", None)]
    schema = "seg_id long, embedding array<double>"

    def play(folder, replays):
        registry, out = programs.Registry(spark, str(folder)), {}
        registry.enrol(spark.createDataFrame(enrolled, "name string, emb array<double>"))
        for k in replays:
            found = programs.identified(spark.createDataFrame(batches[k], schema).repartition(3), k, registry).collect()
            rows = sorted((r["seg_id"], r["name"], round(r["sim"], 9)) for r in found)
            assert out.setdefault(k, rows) == rows
        return out, sorted((r["name"], [round(x, 9) for x in r["emb"] or []]) for r in registry.before(99).collect())

    known = [(n, np.array(v)) for n, v in enrolled if v]
    want = {}
    for k, batch in enumerate(batches):
        rows, new = [], []
        for seg, v in batch:
            best = ("Nobody", 0.0)
            if v is not None and np.isfinite(v).all():
                name, sim = max(((n, tracking.cosine(np.array(v), x)) for n, x in known), key=lambda p: (p[1], [-ord(c) for c in p[0]]))
                best = (name, round(sim, 9)) if sim > 0.4 else best
            rows.append((seg, *best))
            if best[0] != "Nobody":
                new.append((best[0], np.array(v)))
        known += new
        want[k] = sorted(rows)
    once, kept = play(tmp_path / "once", [0, 1, 2, 3])
    assert once == want and len(kept) == len(known) + 1 > 6
    assert play(tmp_path / "again", [0, 1, 1, 2, 1, 2, 3, 3]) == (once, kept)


# batched decoding


def test_batches_decode_like_single_rows():
    rng = np.random.default_rng(0)
    for trial in range(40):
        symbols, n, paths, context = int(rng.integers(2, 9)), int(rng.integers(1, 12)), int(rng.integers(1, 6)), int(rng.integers(1, 4))
        frames = [rng.normal(0, 1.5, (k, symbols)).round(trial % 3) for k in rng.integers(0, 12, n)]  # rounded: with ties
        phrases = lambda k: [rng.integers(1, symbols, int(rng.integers(1, 4))).tolist() for _ in range(k)]  # noqa: B023, E731
        shared, own, table, mark = phrases(int(rng.integers(0, 4))), [phrases(int(rng.integers(0, 4))) for _ in range(n)], rng.normal(0, 1, (symbols, symbols)), trial % 4 == 0
        single, batch = (lambda f, c: f + table[c[-1]], lambda f, c: f + table[c[:, -1]]) if trial % 2 else (decoding.frame_is_logits, None)  # noqa: B023
        lm = (lambda t: 0.3 * len(t) + sum(t) % 3) if trial % 5 == 0 else None
        graph = batched.PhraseArrays([shared], 1.5, mark) if shared else None
        tokens, times, size, log_prob, lm_prob = batched.beam_batch(
            np.concatenate(frames), np.array([len(f) for f in frames]), batch, graph, batched.PhraseArrays(own, 1.5, mark, graph), paths, context, (lambda ts: np.array([lm(t.tolist()) for t in ts])) if lm else None  # noqa: B023
        )
        ends = np.cumsum(size)
        for u in range(n):
            want = decoding.beam(frames[u], single, decoding.PhraseGraph(shared + own[u], 1.5, mark), paths, context, lm)
            part = slice(ends[u] - size[u], ends[u])
            assert (tuple(tokens[part].tolist()), tuple(times[part].tolist())) == (want.tokens, want.frames)
            assert abs(log_prob[u] - want.log_prob) < 1e-9 and abs(lm_prob[u] - want.lm_log_prob) < 1e-9


def test_batched_query_over_the_whole_table(spark, sf_dir):
    got = {r["utt"]: (r["tokens"], r["times"], round(r["score"], 9)) for r in queries.beam_search_in_batches(spark, sf_dir).collect()}
    want = {}
    for r in queries.embeddings(spark, sf_dir).collect():
        frames = np.array(r["embedding"]).reshape(-1, 8)[: r["vec_id"] % 8 + 1]
        k = r["label"]
        h = decoding.beam(frames, graph=decoding.PhraseGraph([[1, 2], [3, 4, 5], [4, 5], [k % 8, (k + 1) % 8], [(k + 3) % 8]], 1.5))
        want[r["vec_id"]] = (list(h.tokens), list(h.frames), round(h.log_prob + h.lm_log_prob, 9))
    assert got == want


def test_decoding_of_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [[0.0, 9.0]]), (4, [None]), (5, [[1.0, None]]), (6, [[0.0, 1.0], [5.0, 0.0]]), (6, [[0.0, 1.0], [5.0, 0.0]])]
    df = spark.createDataFrame(rows, "utt int, frames array<array<double>>").withColumns({"tokens": F.lit(1), "own": F.lit(None).cast("array<array<int>>")})
    shown = lambda frame: sorted((r["utt"], str(r["tokens"]), str(r["times"]), None if r["score"] is None else round(r["score"], 6)) for r in frame.collect())
    want = shown(decoding.decoded(df, "modified_beam_search"))
    assert [r[0] for r in want if r[1] == "None"] == [1, 4, 5]
    assert shown(batched.decoded(df)) == want == shown(batched.decoded(df, own_phrases="own"))
    assert [r[1] for r in shown(decoding.decoded(df))] == ["None", "[]", "[1]", "None", "None", "[1]", "[1]"]
    assert batched.decoded(df.limit(0)).count() == 0
    with pytest.raises(Exception, match="frames of"):
        batched.decoded(spark.createDataFrame([(1, [[1.0]]), (2, [[1.0, 2.0]])], "utt int, frames array<array<double>>").coalesce(1)).collect()


# matching and folds in pieces


def test_a_nan_hides_no_match(spark):
    nan, inf = float("nan"), float("inf")
    registry = spark.createDataFrame([(10, [1.0, 0.0]), (11, [nan, 1.0]), (12, [inf, 0.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [nan, 0.0])], "vec_id long, embedding array<double>")
    assert {r["query"]: r["match_id"] for r in match.nearest(asked, registry).collect()} == {1: 10, 2: -1}
    assert {r["query"]: r["hit"] for r in match.wake_word(asked, registry).collect()} == {1: True, 2: False}
    names = registry.select(F.concat(F.lit("n"), F.col("vec_id").cast("string")).alias("name"), F.col("embedding").alias("emb"))
    assert {r["query"]: r["name"] for r in match.best_named(asked, names).collect()} == {1: "n10", 2: "Nobody"}


def test_folds_don_t_depend_on_arrow_batches(spark):
    rng = np.random.default_rng(8)
    rows = [(s, i, float(p), [float(x) for x in rng.normal(size=4)]) for s in range(3) for i, p in enumerate(rng.uniform(size=300))]
    df = spark.createDataFrame(rows, "stream_id long, idx long, prob double, embedding array<double>").repartition(4)
    build = lambda: [
        vad.gate_codes(df, vad.GateConfig()), vad.speech_segments(df, vad.SpeechConfig(threshold=0.4, min_speech=512, min_silence=160), flush=True),
        tracking.tracked(df, "stream_id", "idx", threshold=0.5), tracking.changes(df, "stream_id", "idx", threshold=0.5), tracking.wake_then_listen(df.withColumn("hit", F.col("prob") > 0.9), "stream_id", "idx", "hit", 7),
    ]
    want = [sorted(map(str, f.collect())) for f in build()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert [sorted(map(str, f.collect())) for f in build()] == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    left, heard = 0, []
    for r in [x for x in rows if x[0] == 1]:
        heard.append(left > 0)
        left = 7 if left == 0 and r[2] > 0.9 else max(0, left - 1)
    got = tracking.wake_then_listen(df.withColumn("hit", F.col("prob") > 0.9), "stream_id", "idx", "hit", 7).where("stream_id = 1").orderBy("idx").collect()
    assert [r["listening"] for r in got] == heard


# speakers of a sliding window


def speaker_rows(values, changes):
    """The definition, window after window, with the activity machine and the vectors written out."""
    out, triggered, quiet, now, known, recent, last, seen = [], False, 0, 0, {}, [], 0, 0
    for at in range(0, len(values) - 11, 4):
        window, heard = np.array(values[at : at + 12]), 0
        for k in range(4):
            p = min(1.0, max(0.0, window[3 * k : 3 * k + 3].mean() / 100))
            now += 3
            quiet = 0 if p >= 0.5 else quiet
            if not triggered:
                triggered = p >= 0.5
                heard += triggered
            elif p >= 0.35:
                heard += 1
            else:
                quiet = quiet or now
                if now - quiet >= 3:
                    triggered, quiet = False, 0
        ident, first, ratio, change = 0, False, 0.0, False
        if heard >= 2:
            parts = np.array([window[3 * k : 3 * k + 3].mean() for k in range(4)])
            v = parts - parts.mean()
            hits = [k for k, vs in known.items() if any(v @ x / max(np.linalg.norm(v) * np.linalg.norm(x), 1.1920929e-07) > 0.9 for x in vs)]
            first = not hits
            if first:
                last += 1
                change = changes and bool(known)
                known = {} if change else known
                ident = last
                if not change:
                    known[ident] = [v]
            else:
                ident = max(hits)
                if len(known[ident]) < (5 if changes else 50):
                    known[ident].append(v)
            recent = [*recent, ident][-20:]
            ratio = 0.0 if first else recent.count(ident) / len(recent)
        seen += 1
        if not changes and seen % 121 == 0:
            known = {k: x for k, x in known.items() if len(x) >= 3 or recent.count(k) / len(recent) >= 0.2}
        out.append((at, heard >= 2, ident, first, round(ratio, 6), change))
    return out


@pytest.mark.parametrize("changes", [False, True])
def test_speakers_of_the_whole_table(spark, sf_dir, changes):
    want = {(u, *r) for u, v in user_values(spark, sf_dir).items() for r in speaker_rows(v, changes)}
    got = queries._speakers(spark, sf_dir, changes=changes).collect()
    assert {(r["user_id"], r["start"], r["speaking"], r["ident"], r["is_first"], r["ratio"], r["change"]) for r in got} == want and len(got) == len(want)
    assert sum(r["change"] for r in got) > 5 if changes else any(r["ident"] and not r["is_first"] for r in got)


def test_speakers_in_any_pieces_and_pruned():
    import json

    import pandas as pd

    values, rng = [r[2] for r in signal(1, 900, seed=5)], random.Random(2)
    for changes in (False, True):
        program = tracking.SpeakerTrack(queries.loudness, queries.shape, window=12, hop=4, gate=vad.GateConfig(window=3, threshold=0.5, min_silence=3), least=2, threshold=0.9, changes=changes)
        state, at, out = program.begin(), 0, []
        while at < len(values):
            n = rng.choice([1, 5, 40])
            out += program.take(state, pd.DataFrame({"value": values[at : at + n]})).to_dict("records")
            state = json.loads(json.dumps({k: v for k, v in state.items() if k != "held"})) | {"held": state["held"]}  # as a checkpoint keeps it
            at += n
        assert [(r["start"], r["speaking"], r["ident"], r["is_first"], round(r["ratio"], 6), r["change"]) for r in out] == speaker_rows(values, changes)


# signals


def naive_frames(values, bins, length, shift):
    """Centred frames, one sample after another; a sample before or behind the signal is found by walking back from its end."""
    out, n = [], len(values)
    for t in range((n + shift // 2) // shift):
        frame = []
        for i in range(t * shift + shift // 2 - length // 2, t * shift + shift // 2 - length // 2 + length):
            while not 0 <= i < n:
                i = -i - 1 if i < 0 else 2 * n - 1 - i
            frame.append(values[i])
        x = np.array(frame) - np.mean(frame)
        y = np.array([x[0] - 0.97 * x[0]] + [x[k] - 0.97 * x[k - 1] for k in range(1, length)]) * [0.54 - 0.46 * np.cos(2 * np.pi * k / (length - 1)) for k in range(length)]
        points = 1 << (length - 1).bit_length()
        power = [abs(sum(y[k] * np.exp(-2j * np.pi * f * k / points) for k in range(length))) ** 2 for f in range(points // 2)]
        out.append(np.log(np.maximum(dsp.mel_bank(bins, 16000, points) @ power, dsp.EPSILON)))
    return out


@pytest.mark.parametrize("n", [0, 1, 3, 16, 40, 101])
@pytest.mark.parametrize("length,shift", [(16, 5), (10, 10), (8, 12)])
def test_reflected_frames_in_any_pieces(n, length, shift):
    import pandas as pd

    rng = random.Random(n)
    values = [rng.uniform(-1, 1) for _ in range(n)]
    want = naive_frames(values, 5, length, shift)
    for sizes in ([1], [2, 7], [1000]):
        for program in (signals.MelFrames(5, length, shift), signals.MelFrames(5, length, shift, at_once=2)):
            state, at, out = program.begin(), 0, []
            while at < n:
                step = rng.choice(sizes)
                out += program.take(state, pd.DataFrame({"value": values[at : at + step]})).to_dict("records")
                at += step
                assert len(state["held"]) <= 2 * length + shift + max(sizes)
            out += program.finish(state).to_dict("records")
            assert [r["frame"] for r in out] == list(range(len(want)))
            assert all(np.allclose(r["feat"], w, atol=1e-9) for r, w in zip(out, want, strict=True))


def test_whole_frames_equal_the_features_of_the_whole(spark):
    rows = signal(2, 90)
    df = spark.createDataFrame(rows, ROWS)
    got = {(r["stream_id"], r["frame"]): r["feat"] for r in folds.folded(df, signals.MelFrames(4, 16, 5, reflect=False)).collect()}
    want = {(s, k): f for s in (0, 1) for k, f in enumerate(dsp.log_mel([r[2] for r in rows if r[0] == s], 4, length=16, shift=5))}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def user_values(spark, sf_dir):
    out = {}
    for r in queries.scores(spark, sf_dir).orderBy("user_id", "idx").collect():
        out.setdefault(r["user_id"], []).append(r["value"])
    return out


def test_mel_features_of_the_whole_table(spark, sf_dir):
    got = {(r["user_id"], r["frame"], r["bin"]): r["energy"] for r in queries.mel_features(spark, sf_dir).collect()}
    want = {(u, t, k): x for u, v in user_values(spark, sf_dir).items() for t, f in enumerate(naive_frames(v, 4, 16, 5)) for k, x in enumerate(f)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_resampling_of_the_whole_table(spark, sf_dir):
    got = {(r["user_id"], r["pos"]): r["sample"] for r in queries.resample(spark, sf_dir).collect()}
    want, cutoff = {}, 0.99
    half = 6 / (2 * cutoff)
    for user, values in user_values(spark, sf_dir).items():
        for k in range(-(-2 * len(values) // 3)):
            total = 0.0
            for i, x in enumerate(values):
                d = i / 3 - k / 2
                if abs(d) < half:
                    total += x * 0.5 * (1 + np.cos(2 * np.pi * cutoff / 6 * d)) * 2 * cutoff * np.sinc(2 * cutoff * d) / 3
            want[user, k] = total
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_speech_to_text_of_the_whole_table(spark, sf_dir):
    config = vad.SpeechConfig(window=2, threshold=0.5, min_speech=2, min_silence=2)
    want = []
    for user, values in user_values(spark, sf_dir).items():
        state = vad.SegmentState()
        for w in range(len(values) // 2):
            energy = np.mean([(x / 100) ** 2 for x in values[2 * w : 2 * w + 2]])
            state, pieces = vad.segment_step(state, [energy / (energy + 0.2)], config)
            want += [(user, float(a), float(b), f"{min(b, len(values)) - a} samples") for a, b in pieces]
    got = [(r["stream_id"], r["start"], r["end"], r["text"]) for r in queries.speech_to_text_pipeline(spark, sf_dir).collect()]
    assert len(want) > 10 and sorted(got) == sorted(want)


# WAV files as a sink


def wav_of(path):
    with open(path, "rb") as f:
        raw = f.read()
    assert int.from_bytes(raw[4:8], "little") == len(raw) - 8
    return audio.decode_wav(raw)[3].tolist()


def test_wav_files_as_a_sink(spark, tmp_path):
    wav_sink.register(spark)
    rows = [(n, i, float(i * k - 40_000 * (i == 5))) for k, n in enumerate("abc", 1) for i in range(3000)] + [(None, 0, 1.0), ("a", 9000, None)]
    df = spark.createDataFrame(rows, "name string, idx long, value double").repartition(7)
    for _ in range(2):  # written anew, not appended
        wav_sink.sorted_samples(df).write.format("wav_stream").option("path", str(tmp_path)).mode("append").save()
        for k, n in enumerate("abc", 1):
            assert wav_of(tmp_path / f"{n}.wav") == [max(-32768, i * k - 40_000 * (i == 5)) for i in range(3000)]
    failing = wav_sink.sorted_samples(df).withColumn("value", F.when(F.col("value") > 8000, F.raise_error(F.lit("stop")).cast("double")).otherwise(F.col("value")))
    with pytest.raises(Exception, match="stop"):
        failing.write.format("wav_stream").option("path", str(tmp_path / "failed")).mode("append").save()
    assert not list((tmp_path / "failed").glob("*.wav"))
    with pytest.raises(Exception, match="no file can be named"):
        wav_sink.sorted_samples(df.withColumn("name", F.lit("a/b"))).write.format("wav_stream").option("path", str(tmp_path / "failed")).mode("append").save()


def test_wav_stream_and_replayed_commits(spark, tmp_path):
    wav_sink.register(spark)
    for k in range(3):
        spark.createDataFrame([(n, i, float(i)) for n in "xy" for i in range(100 * k, 100 * k + 100)], "name string, idx long, value double").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema("name string, idx long, value double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    out = wav_sink.sorted_samples(source).writeStream.format("wav_stream").option("path", f"{tmp_path}/wav").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert all(wav_of(f"{tmp_path}/wav/{n}.wav") == list(range(300)) for n in "xy")

    files = wav_sink._Files({"path": f"{tmp_path}/own"})
    part = lambda lo: [files.write(iter([{"name": "z", "value": float(i)} for i in range(lo, lo + 10)]))]
    files.commit(part(0), 0)
    files.commit(part(10), 1)
    files.commit(part(10), 1)  # committed before: changes nothing
    with open(f"{tmp_path}/own/z.wav", "ab") as f:
        f.write(b"cut off")  # a commit that was interrupted while it appended
    files.commit(part(20), 2)
    assert wav_of(f"{tmp_path}/own/z.wav") == list(range(30)) and not list((tmp_path / "own/_parts").glob("*.raw"))
    failed = part(30)
    files.abort(failed)
    assert wav_of(f"{tmp_path}/own/z.wav") == list(range(30)) and not list((tmp_path / "own/_parts").glob("*.raw"))


# phoneme sentences


def test_phoneme_sentences(spark):
    def fold(text):
        """Code point after code point: a clause is open until its sign, a sentence until one that ends it."""
        done, sentence, clause = [], "", ""
        for c in [*(text or ""), None]:
            if c is not None and c not in ".?!,:;":
                clause += c
                continue
            if clause.strip(" "):
                spoken, flag = "", False
                for x in clause.strip(" ").lower():
                    if flag:
                        flag = x != ")"
                    elif x == "(":
                        flag = True
                    else:
                        spoken += x
                sentence += spoken + (c or "") + (" " if c in (",", ":", ";") else "")
            clause = ""
            if c is None or c in ".?!":
                done += [sentence] if sentence else []
                sentence = ""
        return done

    rng = random.Random(1)
    texts = ["".join(rng.choices("ab É(),.;:?! \n", k=rng.randrange(40))) for _ in range(300)] + [None, "", "...", "Hello, (en)World(de): yes; no? Well", "x" * 100_000 + ". " + "y, " * 20_000]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", X.phoneme_sentences(F.col("t")).alias("s")).collect()
    assert {r["k"]: r["s"] for r in got} == {k: fold(t) for k, t in enumerate(texts)}
