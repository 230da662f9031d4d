"""The state machines against an independent reading of their decision tables, and batch against streaming."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wavemill.operators import vad

LEVELS = st.lists(st.sampled_from([0.0, 0.3, 0.35, 0.36, 0.45, 0.5, 0.51, 0.9]), max_size=60)


def table_a(scores, window, thr, min_silence, pad):
    """Rules tried in their order, with plain variables."""
    triggered, temp, now, out = False, 0, 0, []
    for p in scores:
        now += window
        if p >= thr and temp:
            temp = 0
        if p < thr and not triggered:
            out.append(1)
        elif p >= thr - 0.15 and triggered:
            out.append(4)
        elif p >= thr and not triggered:
            triggered = True
            out.append(2)
        elif p < thr - 0.15 and triggered:
            temp = temp or now
            if now - temp < min_silence:
                out.append(0)
            else:
                triggered, temp = False, 0
                out.append(3)
        else:
            out.append(0)
    return out


def table_b(scores, window, thr, min_speech, min_silence):
    triggered, begin, temp, now, out = False, 0, 0, 0, []
    for p in scores:
        now += window
        if p > thr and temp:
            temp = 0
        if p > thr and not begin:
            begin = now
            out.append(False)
        elif p > thr and not triggered:
            triggered = now - begin >= min_speech
            out.append(triggered)
        elif p < thr and not triggered:
            begin = temp = 0
            out.append(False)
        elif p > thr - 0.15 and triggered:
            out.append(True)
        elif p < thr and triggered:
            temp = temp or now
            if now - temp < min_silence:
                out.append(True)
            else:
                triggered, begin, temp = False, 0, 0
                out.append(False)
        else:
            out.append(False)
    return out


@settings(max_examples=300, deadline=None)
@given(LEVELS)
def test_machine_a(scores):
    c = vad.GateConfig(window=100, threshold=0.5, min_silence=200)
    assert vad.steps(vad.GateState(), scores, vad.gate_step, c) == table_a(scores, 100, 0.5, 200, 0)


@settings(max_examples=300, deadline=None)
@given(LEVELS)
def test_machine_b(scores):
    c = vad.SpeechConfig(window=100, threshold=0.5, min_speech=200, min_silence=150)
    assert vad.steps(vad.SpeechState(), scores, vad.speech_step, c) == table_b(scores, 100, 0.5, 200, 150)


def test_segments_are_ordered_and_split():
    c = vad.SpeechConfig(window=100, threshold=0.5, min_speech=200, min_silence=100, max_segment=700)
    state, out = vad.SegmentState(), []
    for p in [0.0] * 5 + [0.9] * 20 + [0.0] * 6 + [0.9] * 6 + [0.0] * 6:
        state, pieces = vad.segment_step(state, [p], c)
        out += pieces
    assert len(out) > 2 and all(a < b <= a + 700 for a, b in out)
    assert all(x[1] <= y[0] for x, y in zip(out, out[1:]))


def test_short_circuit_leaves_later_windows_unscored():
    c = vad.SpeechConfig(window=100, threshold=0.5, min_speech=100, min_silence=100)
    one, _ = vad.segment_step(vad.SegmentState(), [0.9, 0.9, 0.0], c)
    assert one.speech.now == 200 and one.tail == 300 and one.start >= 0


@pytest.fixture(scope="module")
def score_rows():
    rng = np.random.default_rng(3)
    return pd.DataFrame([(s, i, float(p)) for s in range(3) for i, p in enumerate(rng.choice([0.1, 0.4, 0.6, 0.9], 120))], columns=["stream_id", "idx", "prob"])


@pytest.mark.parametrize("files", [1, 5])
def test_stream_equals_batch(spark, tmp_path, score_rows, files):
    from wavemill.streaming import stateful

    config = vad.SpeechConfig(window=100, threshold=0.5, min_speech=200, min_silence=100)
    df = spark.createDataFrame(score_rows)
    want = sorted(map(tuple, vad.speech_segments(df, config).collect()))
    for k in range(files):
        part = score_rows[(score_rows["idx"] >= 120 * k // files) & (score_rows["idx"] < 120 * (k + 1) // files)]
        spark.createDataFrame(part).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(f"{tmp_path}/in")
    query = stateful.speech_segments(source, config).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination(180)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select("stream_id", "start", "end").collect())) == want


def test_marked_slices(spark):
    codes = spark.createDataFrame([(1, 0, 1, -1), (1, 1, 2, 9000), (1, 2, 4, -1), (1, 3, 3, 20000), (1, 4, 2, 30000)], "stream_id int, idx int, code int, sample long")
    assert [tuple(r) for r in vad.marked_slices(codes).collect()] == [(1, 1000, 20000)]
