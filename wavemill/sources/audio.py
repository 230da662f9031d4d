"""Sample files: WAV and raw PCM in, WAV out. SURVEY ids: S4-S8, S14, K5, K6, K8.

Files are read with the ``binaryFile`` source (listing, partition pruning and retries are Spark's) and decoded in Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PCM_RATE, PLAY_GAIN = 16000, 0.2
AUDIO = "path string, channels int, rate int, bits int, samples array<float>"
_KINDS = {8: "<i1", 16: "<i2", 32: "<i4"}


def decode_wav(raw: bytes) -> tuple[int, int, int, np.ndarray]:
    """channels, rate, bits, samples (not normalised) of a RIFF file; chunks before ``data`` are skipped, and a wrong data size is cut to what is there."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE header")
    at, form = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        at += 8
        if name == b"fmt ":
            form = struct.unpack_from("<HHIIHH", raw, at)
        elif name == b"data":
            if form is None:
                raise ValueError("data before fmt")
            channels, rate, bits = form[1], form[2], form[5]
            if bits not in _KINDS:
                raise ValueError(f"{bits} bits a sample")
            size = min(size, len(raw) - at)
            size -= size % (bits // 8 * max(1, channels))
            return channels, rate, bits, np.frombuffer(raw, _KINDS[bits], size * 8 // bits, at)
        at += size + size % 2
    raise ValueError("no data chunk")


def encode_wav(samples: np.ndarray, rate: int = PCM_RATE, bits: int = 16, channels: int = 1) -> bytes:
    """A RIFF file of integer samples, clamped to the width."""
    kind = np.dtype(_KINDS[bits])
    limit = np.iinfo(kind)
    data = np.clip(np.asarray(samples), limit.min, limit.max).astype(kind).tobytes()
    frame = channels * bits // 8
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * frame, frame, bits) + b"data" + struct.pack("<I", len(data)) + data


def decode_pcm(raw: bytes) -> tuple[int, int, int, np.ndarray]:
    """One channel of 16 bits at 16 kHz."""
    return 1, PCM_RATE, 16, np.frombuffer(raw, "<i2", len(raw) // 2)


def read_audio(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One row per file: path, channels, rate, bits, samples. ``.wav`` and ``.WAV`` are RIFF, all else is raw PCM; samples are as stored (divide by 32768 to normalise)."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")
    return files.mapInArrow(_decoded, AUDIO)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            decode = decode_wav if path.endswith((".wav", ".WAV")) else decode_pcm
            channels, rate, bits, samples = decode(raw.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([channels], pa.int32()), pa.array([rate], pa.int32()), pa.array([bits], pa.int32()), pa.array([samples.astype(np.float32)], pa.list_(pa.float32()))], ["path", "channels", "rate", "bits", "samples"])


@F.arrow_udf(T.BinaryType())
def _wav(samples: pa.Array) -> pa.Array:
    return pa.array([None if s is None else encode_wav(np.array(s, np.float64)) for s in samples.to_pylist()], pa.binary())


def wav_bytes(samples: Column) -> Column:
    """A 16-bit WAV file of integer samples, as a binary column."""
    return _wav(samples)


def write_wav(rows: DataFrame, folder: str, name: str = "name", samples: str = "samples", rate: int = PCM_RATE, bits: int = 16) -> DataFrame:
    """One file per row, written by the tasks through the file system of ``folder``; returns name, path, bytes (lazily: an action writes)."""
    from pyarrow import fs as pafs

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for key, values in zip(batch.column(name).to_pylist(), batch.column(samples).to_pylist(), strict=True):
                raw = encode_wav(np.array(values, np.float64), rate, bits)
                with fs.open_output_stream(f"{base}/{key}.wav") as f:
                    f.write(raw)
                yield pa.RecordBatch.from_arrays([pa.array([str(key)]), pa.array([f"{folder}/{key}.wav"]), pa.array([len(raw)], pa.int64())], ["name", "path", "bytes"])

    return rows.select(F.col(name).cast("string").alias(name), samples).mapInArrow(written, "name string, path string, bytes long")


def read_matrix(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Float32 matrices in raw files: path, row, vector."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = np.frombuffer(raw.as_py(), "<f4")
                matrix = data[: len(data) // columns * columns].reshape(-1, columns)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(matrix)), pa.array(np.arange(len(matrix))), pa.array(list(matrix), pa.list_(pa.float32()))], ["path", "row", "vector"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "path string, row long, vector array<float>")


def playback(samples: Column) -> Column:
    """The gain of playback: a fifth."""
    return F.transform(samples, lambda x: x * PLAY_GAIN)
