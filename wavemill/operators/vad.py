"""Voice activity: hysteresis state machines over window scores, and segments. SURVEY ids: T3, T4, T5, T11, F18, N1 (score side).

Each machine is one pure step, (state, score) -> (state, code). The batch form folds it over the ordered rows of a
stream, batch by batch (parallel over streams; rows without a stream take no part), the streaming form keeps the state between micro-batches (``wavemill.streaming.vad``). Both use the same step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame

from wavemill.operators.folds import chunks_in_order

SILENCE, START, END, SPEAKING, UNDECIDED = 1, 2, 3, 4, 0
#: How far below the threshold a score still counts as going on.
MARGIN = 0.15


@dataclass(frozen=True)
class GateConfig:
    """Machine A: samples of a window, the threshold, the silence that ends speech, and the pad around it."""

    window: int = 1536
    threshold: float = 0.5
    min_silence: int = 1600
    pad: int = 0


@dataclass(frozen=True)
class GateState:
    triggered: bool = False
    silence_from: int = 0
    now: int = 0
    start: int = -1
    end: int = -1


def gate_step(state: GateState, p: float, c: GateConfig) -> tuple[GateState, int]:
    """One window of machine A. A score in the margin keeps speech going without ending a silence run; only a score at the threshold does that."""
    now, high, low = state.now + c.window, p >= c.threshold, p < c.threshold - MARGIN
    quiet = 0 if high else state.silence_from
    if not state.triggered:
        return (GateState(True, quiet, now, now - c.window - c.pad, state.end), START) if high else (GateState(False, quiet, now, state.start, state.end), SILENCE)
    if not low:
        return GateState(True, quiet, now, state.start, state.end), SPEAKING
    quiet = quiet or now
    if now - quiet < c.min_silence:
        return GateState(True, quiet, now, state.start, state.end), UNDECIDED
    return GateState(False, 0, now, state.start, quiet + c.pad), END


@dataclass(frozen=True)
class SpeechConfig:
    """Machine B and its segments, in samples."""

    window: int = 512
    threshold: float = 0.65
    min_speech: int = 4000
    min_silence: int = 160
    max_segment: int = 29 * 16000


@dataclass(frozen=True)
class SpeechState:
    triggered: bool = False
    speech_from: int = 0
    silence_from: int = 0
    now: int = 0


def speech_step(state: SpeechState, p: float, c: SpeechConfig) -> tuple[SpeechState, bool]:
    """One window of machine B: is there speech?"""
    now = state.now + c.window
    if p > c.threshold:
        if state.silence_from:  # a silence run is called off; what follows is judged by the rules for a going-on score
            s = replace(state, now=now, silence_from=0)
            if state.triggered:
                return s, True
        else:
            s = replace(state, now=now)
        if not s.speech_from:
            return replace(s, speech_from=now), False
        if not s.triggered:
            return (s, False) if now - s.speech_from < c.min_speech else (replace(s, triggered=True), True)
        return s, True
    s = replace(state, now=now)
    if not s.triggered:
        return (replace(s, speech_from=0, silence_from=0), False) if p < c.threshold else (s, False)
    if p > c.threshold - MARGIN:
        return s, True
    quiet = s.silence_from or now
    if now - quiet < c.min_silence:
        return replace(s, silence_from=quiet), True
    return SpeechState(now=now), False


@dataclass(frozen=True)
class SegmentState:
    speech: SpeechState = SpeechState()
    head: int = 0
    tail: int = 0
    start: int = -1


def segment_step(state: SegmentState, scores: list[float], c: SpeechConfig) -> tuple[SegmentState, list[tuple[int, int]]]:
    """One call with the scores of its windows: segments (start, end) that it completes. After the first window with speech the scorer is not asked again in the same call."""
    speech, any_speech = state.speech, False
    for p in scores:
        if not any_speech:
            speech, any_speech = speech_step(speech, p, c)
    tail, back = state.tail + c.window * len(scores), 2 * c.window + c.min_speech
    s = replace(state, speech=speech, tail=tail)
    if any_speech:
        return (replace(s, start=max(tail - back, s.head)) if s.start < 0 else s), []
    if s.start < 0:
        return replace(s, head=max(s.head, tail - back)), []
    end = tail - c.min_silence
    pieces = [(a, min(a + c.max_segment, end)) for a in range(s.start, end, c.max_segment)]
    return replace(s, start=-1, head=end), pieces


def dump(state) -> dict:
    return asdict(state)


def gate_codes(rows: DataFrame, config: GateConfig, stream: str = "stream_id", order: str = "idx", score: str = "prob") -> DataFrame:
    """stream, order, code, and on codes START and END the marked sample."""

    def run(pieces: Iterator[tuple[object, bool, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        state = GateState()
        for _, first, pdf in pieces:
            state, out = GateState() if first else state, []
            for p in pdf[score]:
                state, code = gate_step(state, p, config)
                out.append((code, state.start if code == START else state.end if code == END else -1))
            codes = pd.DataFrame(out, columns=["code", "sample"], index=pdf.index)
            yield pd.concat([pdf[[stream, order]], codes], axis=1)

    slim = rows.select(stream, order, score)
    schema = f"{stream} {slim.schema[stream].dataType.simpleString()}, {order} long, code int, sample long"
    return chunks_in_order(slim, stream, order, run, schema)


def speech_segments(rows: DataFrame, config: SpeechConfig, stream: str = "stream_id", order: str = "idx", score: str = "prob", flush: bool = False) -> DataFrame:
    """Segments of each stream: stream, start, end (samples). One row is one window and one call. A segment still open at the end is left out, unless ``flush``."""

    def rest(state: SegmentState) -> list[tuple[int, int]]:
        return [(a, min(a + config.max_segment, state.tail)) for a in range(state.start, state.tail, config.max_segment)] if flush and state.start >= 0 else []

    def framed(name: object, out: list[tuple[int, int]]) -> pd.DataFrame:
        return pd.DataFrame({stream: name, "start": [a for a, _ in out], "end": [b for _, b in out]})

    def run(pieces: Iterator[tuple[object, bool, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        state, last = SegmentState(), None
        for name, first, pdf in pieces:
            if first:
                yield framed(last, rest(state))
                state, last = SegmentState(), name
            out = []
            for p in pdf[score]:
                state, done = segment_step(state, [p], config)
                out += done
            yield framed(name, out)
        yield framed(last, rest(state))

    slim = rows.select(stream, order, score)
    return chunks_in_order(slim, stream, order, run, f"{stream} {slim.schema[stream].dataType.simpleString()}, start long, end long")


def marked_slices(codes: DataFrame, pre_roll: int = 8000, stream: str = "stream_id", order: str = "idx") -> DataFrame:
    """From START and END codes to sample ranges: each end with the start before it, half a second earlier."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    before = Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("code") == START, F.col("sample")), ignorenulls=True).over(before)
    return codes.withColumn("start", F.greatest(F.lit(0).cast("long"), start - pre_roll)).where((F.col("code") == END) & F.col("start").isNotNull()).select(stream, "start", F.col("sample").alias("end"))


def steps(state, scores: Iterator[float], step, config) -> list:
    """A fold that keeps every output, for tests and small batches."""
    out = []
    for p in scores:
        state, x = step(state, p, config)
        out.append(x)
    return out
