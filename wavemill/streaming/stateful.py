"""The sequential operators on Structured Streaming. SURVEY ids: S1-S3, F2, T1-T8, T12, K1-K4.

State is kept per stream by ``transformWithStateInPandas`` (RocksDB), and survives restarts through the checkpoint; it holds the same
state values that the batch folds use, so both give the same rows. Rows of a micro-batch are put in order by their index; a row that comes
behind one already folded is late and dropped, as a watermark would drop it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wavemill.functions import dsp
from wavemill.operators import tracking, vad

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Folding(StatefulProcessor):
    """Keeps one JSON text per stream: the state and the last index folded."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("state", "text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        saved = json.loads(self.kept.get()[0]) if self.kept.exists() else None
        state, last = self.load(saved["state"] if saved else None), saved["last"] if saved else None
        pdf = pd.concat(list(rows)).sort_values("idx")
        if last is not None:
            pdf = pdf[pdf["idx"] > last]
        if len(pdf):
            state, out = self.fold(state, pdf)
            self.kept.update((json.dumps({"state": self.save(state), "last": int(pdf["idx"].iloc[-1])}),))
            if len(out):
                out.insert(0, "stream_id", key[0])
                yield out

    def close(self) -> None:
        pass


class _Segments(_Folding):
    def __init__(self, config: vad.SpeechConfig):
        self.config = config

    def load(self, saved):
        return vad.SegmentState(**(saved | {"speech": vad.SpeechState(**saved["speech"])})) if saved else vad.SegmentState()

    def save(self, state):
        return asdict(state)

    def fold(self, state, pdf):
        out = []
        for p in pdf["prob"]:
            state, pieces = vad.segment_step(state, [p], self.config)
            out += pieces
        return state, pd.DataFrame({"start": [a for a, _ in out], "end": [b for _, b in out]}, dtype="int64")


class _Codes(_Folding):
    def __init__(self, config: vad.GateConfig):
        self.config = config

    def load(self, saved):
        return vad.GateState(**saved) if saved else vad.GateState()

    def save(self, state):
        return asdict(state)

    def fold(self, state, pdf):
        codes = []
        for p in pdf["prob"]:
            state, code = vad.gate_step(state, p, self.config)
            codes.append(code)
        return state, pd.DataFrame({"idx": pdf["idx"].to_numpy(), "code": np.array(codes, np.int32)})


class _Tracks(_Folding):
    def __init__(self, options: dict):
        self.options = options

    def load(self, saved):
        own = tracking.Tracker(**self.options)
        if saved:
            own.vectors = {int(k): [np.array(v) for v in x] for k, x in saved["vectors"].items()}
            own.last, own.recent, own.windows = saved["last"], saved["recent"], saved["windows"]
        return own

    def save(self, own):
        return {"vectors": {k: [v.tolist() for v in x] for k, x in own.vectors.items()}, "last": own.last, "recent": own.recent, "windows": own.windows}

    def fold(self, own, pdf):
        out = [own.step(True, v) for v in pdf["embedding"]]
        return own, pd.DataFrame({"idx": pdf["idx"].to_numpy(), "ident": [x[0] for x in out], "is_first": [x[1] for x in out], "ratio": [x[2] for x in out]})


class _Windows(_Folding):
    """Count windows; what is not yet a full window waits."""

    def __init__(self, size: int, hop: int):
        self.size, self.hop = size, hop or size

    def load(self, saved):
        return saved or {"start": 0, "held": []}

    def save(self, state):
        return state

    def fold(self, state, pdf):
        held, start, out = state["held"] + pdf["value"].astype(float).tolist(), state["start"], []
        at = 0
        while at + self.size <= len(held):
            out.append((start + at, held[at : at + self.size]))
            at += self.hop
        gone = min(at, len(held))
        return {"start": start + gone, "held": held[gone:]}, pd.DataFrame({"start": [s for s, _ in out], "samples": [x for _, x in out]})


class _Features(_Folding):
    """Log-mel frames; the samples that no whole shift has consumed wait."""

    def __init__(self, bins: int, length: int, shift: int):
        self.bins, self.length, self.shift = bins, length, shift

    def load(self, saved):
        return saved or {"frame": 0, "held": []}

    def save(self, state):
        return state

    def fold(self, state, pdf):
        wave = np.array(state["held"] + pdf["value"].astype(float).tolist())
        found = dsp.log_mel(wave, self.bins, length=self.length, shift=self.shift)
        first = state["frame"]
        return {"frame": first + len(found), "held": wave[len(found) * self.shift :].tolist()}, pd.DataFrame({"frame": np.arange(first, first + len(found)), "feat": list(found.tolist())})


def _stateful(rows: DataFrame, columns: list[str], processor: _Folding, schema: str) -> DataFrame:
    slim = rows.select("stream_id", *columns)
    kind = slim.schema["stream_id"].dataType.simpleString()
    return slim.groupBy("stream_id").transformWithStateInPandas(processor, f"stream_id {kind}, {schema}", "append", "None")


def speech_segments(rows: DataFrame, config: vad.SpeechConfig) -> DataFrame:
    """stream_id, idx, prob to stream_id, start, end."""
    return _stateful(rows, ["idx", "prob"], _Segments(config), "start long, end long")


def gate_codes(rows: DataFrame, config: vad.GateConfig) -> DataFrame:
    return _stateful(rows, ["idx", "prob"], _Codes(config), "idx long, code int")


def tracked(rows: DataFrame, **options) -> DataFrame:
    return _stateful(rows, ["idx", "embedding"], _Tracks(options), "idx long, ident long, is_first boolean, ratio double")


def count_windows(rows: DataFrame, size: int, hop: int = 0) -> DataFrame:
    return _stateful(rows, ["idx", "value"], _Windows(size, hop), "start long, samples array<double>")


def features(rows: DataFrame, bins: int = 80, length: int = 400, shift: int = 160) -> DataFrame:
    return _stateful(rows, ["idx", "value"], _Features(bins, length, shift), "frame long, feat array<double>")


def time_windows(events: DataFrame, size: str, hop: str | None, delay: str, time: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """Event-time windows with a watermark: late rows beyond ``delay`` are dropped and their state with them. A timestamp without a zone is taken as session time."""
    typed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    window = F.window(time, size, hop) if hop else F.window(time, size)
    return typed.groupBy(window.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, delay: str, time: str = "ts", by: str = "user_id") -> DataFrame:
    typed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return typed.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def relabelled(batch: DataFrame, batch_id: int, history: str, stream: str = "stream_id") -> DataFrame:
    """For ``foreachBatch``: keep a batch of segments (stream_id, start, embedding, ...) in the history, and return the streams that it touches with all labels anew.

    A new speaker can change old labels, so the output of these streams is complete and replaces what was there. A batch lies in a folder of its id, which a replay overwrites.
    """
    batch.write.mode("overwrite").parquet(f"{history}/batch={batch_id}")
    touched = batch.select(stream).distinct()
    own = batch.sparkSession.read.schema(batch.schema).parquet(history).join(touched, stream, "left_semi")
    return own.join(tracking.diarised(own, stream, "start"), [stream, "start"])


def keep_latest(batch: DataFrame, path: str, stream: str = "stream_id", order: str = "idx") -> None:
    """For ``foreachBatch``: one status line per stream, replaced whole."""
    from wavemill.sources import tables

    tables.latest_status(batch, stream, order).select(F.concat_ws(" ", F.col(stream).cast("string"), F.col("status")).alias("value")).write.mode("overwrite").text(path)
