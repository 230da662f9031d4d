"""The programs of ``operators.folds`` on Structured Streaming, with state that ends, and a registry that grows while it is asked. SURVEY ids: S2, T9, T10, W7, P1, J2, section 2.15.

A stream's state has an event-time timer: once the watermark is ``idle`` past its last row, the stream has ended, its rest comes out and its state is gone. Rows that come behind one already folded are not
lost but come out as a second output.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wavemill.operators import match
from wavemill.operators.folds import Program

ROW, LATE = "row", "late"


class _Timed(StatefulProcessor):
    def __init__(self, program: Program, idle_ms: int):
        self.program, self.idle_ms = program, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("state", "head string, held binary")

    def _load(self) -> tuple[dict, int | None, int | None]:
        if not self.kept.exists():
            return self.program.begin(), None, None
        head, held = self.kept.get()
        saved = json.loads(head)
        return saved["state"] | {"held": np.frombuffer(held, np.float64)}, saved["last"], saved["timer"]

    def _named(self, key, out: pd.DataFrame, kind: str = ROW, late: object = None) -> pd.DataFrame:
        out.insert(0, "late_idx", late)
        out.insert(0, "output", kind)
        out.insert(0, "stream_id", key[0])
        return out

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state, last, timer = self._load()
        pdf = pd.concat(list(rows)).sort_values("idx", kind="stable")
        late = pdf[pdf["idx"] <= last] if last is not None else pdf[:0]
        if len(late):
            empty = pd.DataFrame({c: [None] * len(late) for c in self.program.frame([]).columns}, dtype=object)
            yield self._named(key, empty, LATE, late["idx"].to_numpy())
        pdf = pdf[len(late) :]
        if not len(pdf):
            return
        out = self.program.take(state, pdf)
        due = int(pdf["event_ms"].max()) + self.idle_ms
        if timer is None or due > timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        plain = {k: v for k, v in state.items() if k != "held"}
        self.kept.update((json.dumps({"state": plain, "last": int(pdf["idx"].iloc[-1]), "timer": timer}), np.ascontiguousarray(state["held"]).tobytes()))
        if len(out):
            yield self._named(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, _, _ = self._load()
        out = self.program.finish(state)
        self.kept.clear()
        if len(out):
            yield self._named(key, out)

    def close(self) -> None:
        pass


def program(rows: DataFrame, fold: Program, idle: str = "1 hour", delay: str = "10 minutes", time: str = "ts") -> DataFrame:
    """stream_id, output, late_idx and the program's columns of a streaming frame (stream_id, idx, ``time``, and what the program reads).

    output ``row`` is the program's own; ``late`` is a row (late_idx) that came behind one of its stream that had already been folded, with nulls in the program's columns. Rows behind the watermark of ``delay``
    are dropped by Spark. After ``idle`` without rows the stream ends: what ``finish`` returns comes out, and its state is deleted. A restart from the checkpoint gives the same rows.
    """
    interval = rows.sparkSession.range(1).select(((F.unix_micros(F.expr(f"timestamp'1970-01-10 00:00:00' + interval {idle}")) - F.unix_micros(F.expr("timestamp'1970-01-10 00:00:00'"))) / 1000).cast("long"))
    timed = rows.where("stream_id is not null and idx is not null").withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    slim = timed.select("stream_id", "idx", time, F.unix_millis(time).alias("event_ms"), *fold.columns)
    kind = slim.schema["stream_id"].dataType.simpleString()
    return slim.groupBy("stream_id").transformWithStateInPandas(_Timed(fold, interval.first()[0]), f"stream_id {kind}, output string, late_idx long, {fold.output}", "append", "EventTime")


class Registry:
    """Named vectors that grow while they are asked for: enrolled ones, and for each micro-batch a folder of those that it has added.

    Batch k sees the enrolled vectors and the additions of the batches before it, and only these, so a batch that is replayed sees what it saw, and writes its own folder over: nothing is added twice.
    """

    SCHEMA = "name string, emb array<double>"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def enrol(self, named: DataFrame) -> None:
        """Replace the enrolled vectors (name, emb)."""
        named.select("name", F.col("emb").cast("array<double>").alias("emb")).write.mode("overwrite").parquet(f"{self.folder}/enrolled")

    def _exists(self, path: str) -> bool:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(found)

    def before(self, batch_id: int) -> DataFrame:
        """The snapshot that batch ``batch_id`` is answered from."""
        enrolled = self.spark.read.schema(self.SCHEMA).parquet(f"{self.folder}/enrolled")
        if not self._exists(f"{self.folder}/added"):
            return enrolled
        added = self.spark.read.schema(f"{self.SCHEMA}, batch long").parquet(f"{self.folder}/added")
        return enrolled.unionByName(added.where(F.col("batch") < batch_id).select("name", "emb"))

    def commit(self, batch_id: int, named: DataFrame) -> None:
        named.select("name", F.col("emb").cast("array<double>").alias("emb")).write.mode("overwrite").parquet(f"{self.folder}/added/batch={batch_id}")


def identified(batch: DataFrame, batch_id: int, registry: Registry, threshold: float = 0.4, key: str = "seg_id", vector: str = "embedding", nobody: str = "Nobody") -> DataFrame:
    """For ``foreachBatch``: key, name, sim of each segment, by the most similar vector of the registry above ``threshold``; matched segments' vectors join the registry under their name.

    A segment without a usable vector, or without a match, is ``nobody`` with 0 and is not added. Segments of one batch don't see each other; rows that repeat a key and vector are answered, and added, once each.
    """
    found = match.best_named(batch, registry.before(batch_id), nobody, key, vector, threshold=threshold, keep_vector=True)
    registry.commit(batch_id, found.where(F.col("name") != nobody).select("name", F.col("vector").alias("emb")))
    return found.select(F.col("query").alias(key), "name", "sim")
