"""WAV files as a sink, in batches and on streams. SURVEY id: K5.

``rows.write.format("wav_stream")`` and ``writeStream`` take rows (name, idx, value): a file per name, samples in order of idx. Tasks write raw samples beside the files; only a commit
makes them part of one, and patches its header. What a failed or repeated task has written is never seen, and a batch that is committed again changes nothing.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from wavemill.sources.audio import PCM_RATE, encode_wav

HEADER, COPIED = 44, 1 << 20


@dataclass
class Parts(WriterCommitMessage):
    """name, path of the raw samples and their number of bytes, in the order of the names."""

    files: list[tuple[str, str, int]]


class _Files:
    """The folder of one sink: ``name.wav``, and under ``_parts`` what tasks have written and how far each file is committed."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].removeprefix("file://")
        if "://" in self.folder:
            raise ValueError("headers are patched in place, so the folder must be a path that driver and executors mount")
        self.rate, self.bits = int(options.get("rate", PCM_RATE)), int(options.get("bits", 16))
        self.parts = f"{self.folder}/_parts"

    def write(self, rows: Iterator) -> Parts:
        """The rows of one task; a name's rows must be in one task and in order (see ``sorted_samples``)."""
        os.makedirs(self.parts, exist_ok=True)
        kind = np.dtype({8: "<i1", 16: "<i2", 32: "<i4"}[self.bits])
        limit, task, out = np.iinfo(kind), uuid.uuid4().hex, []
        handle, last, held = None, None, []

        def flush() -> None:
            if held:
                handle.write(np.clip(np.array(held, np.float64), limit.min, limit.max).astype(kind).tobytes())
                held.clear()

        try:
            for row in rows:
                if handle is None or row["name"] != last:
                    if handle:
                        flush()
                        out[-1] = (*out[-1][:2], handle.tell())
                        handle.close()
                    last = row["name"]
                    if not last or "/" in last:
                        raise ValueError(f"no file can be named {last!r}")
                    out.append((last, f"{self.parts}/{task}-{len(out)}.raw", 0))
                    handle = open(out[-1][1], "wb")  # noqa: SIM115
                held.append(row["value"])
                if len(held) >= COPIED:
                    flush()
            if handle:
                flush()
                out[-1] = (*out[-1][:2], handle.tell())
        finally:
            if handle:
                handle.close()
        if len({name for name, _, _ in out}) < len(out):
            raise ValueError("the samples of a name are not together; use sorted_samples")
        return Parts(out)

    def _mark(self, name: str) -> str:
        return f"{self.parts}/{name}.json"

    def commit(self, messages: list[Parts | None], batch_id: int | None) -> None:
        """Append each part to its file; without a batch id the files are written anew. What an interrupted commit has appended is cut off first."""
        for message in messages:
            for name, path, size in message.files if message else []:
                mark, file = self._mark(name), f"{self.folder}/{name}.wav"
                done = {"batch": -1, "bytes": 0}
                if batch_id is not None and os.path.exists(mark):
                    with open(mark) as f:
                        done = json.load(f)
                if batch_id is None or done["batch"] < batch_id:
                    fresh = batch_id is None or not os.path.exists(file)
                    target = f"{self.parts}/{uuid.uuid4().hex}.wav" if fresh else file
                    with open(target, "w+b" if fresh else "r+b") as f, open(path, "rb") as part:
                        f.truncate(HEADER + done["bytes"])
                        f.seek(HEADER + done["bytes"])
                        while block := part.read(COPIED):
                            f.write(block)
                        f.seek(0)
                        f.write(self.header(done["bytes"] + size))
                    if fresh:
                        os.replace(target, file)
                    with open(f"{mark}.new", "w") as f:
                        json.dump({"batch": -1 if batch_id is None else batch_id, "bytes": done["bytes"] + size}, f)
                    os.replace(f"{mark}.new", mark)
                os.remove(path)

    def header(self, size: int) -> bytes:
        head = bytearray(encode_wav(np.zeros(0), self.rate, self.bits))
        head[4:8], head[40:44] = (36 + size).to_bytes(4, "little"), size.to_bytes(4, "little")
        return bytes(head)

    def abort(self, messages: list[Parts | None]) -> None:
        for message in messages:
            for _, path, _ in message.files if message else []:
                if os.path.exists(path):
                    os.remove(path)


class _Writer(DataSourceWriter):
    def __init__(self, files: _Files):
        self.files = files

    def write(self, iterator):
        return self.files.write(iterator)

    def commit(self, messages):
        self.files.commit(messages, None)

    def abort(self, messages):
        self.files.abort(messages)


class _StreamWriter(DataSourceStreamWriter):
    def __init__(self, files: _Files):
        self.files = files

    def write(self, iterator):
        return self.files.write(sorted(iterator, key=lambda row: (row["name"], row["idx"])))  # a task's rows of one micro-batch

    def commit(self, messages, batchId):
        self.files.commit(messages, batchId)

    def abort(self, messages, batchId):
        self.files.abort(messages)


class WavSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav_stream"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(_Files(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        return _StreamWriter(_Files(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WavSink)


def sorted_samples(rows: DataFrame, name: str = "name", order: str = "idx", value: str = "value") -> DataFrame:
    """name, idx, value as the sink takes them: a name's rows in one task and, in a batch, in order. Rows without a name, index or value take no part.

    On a stream the sink puts the rows of a micro-batch in order itself; they go behind those of the batches before.
    """
    slim = rows.select(rows[name].cast("string").alias("name"), rows[order].alias("idx"), rows[value].cast("double").alias("value")).where("name is not null and idx is not null and value is not null")
    placed = slim.repartition("name")
    return placed if rows.isStreaming else placed.sortWithinPartitions("name", "idx")
