"""Models behind one interface. SURVEY ids: N1-N12, D9, A19.

The weights of the specification's models are not available, so a model is whatever maps a pandas frame of inputs to a frame of outputs. A
scorer is loaded once per Python worker and fed in Arrow batches; put filters before it by hand, since the optimizer can't look inside.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Scorer(Protocol):
    """``output`` is the DDL of what ``score`` returns."""

    output: str

    def score(self, rows: pd.DataFrame) -> pd.DataFrame: ...


class OnnxScorer:
    """A model file for ONNX Runtime, if that is installed: one array column in, one out."""

    def __init__(self, model: str, column: str, output_column: str, threads: int = 1, providers: tuple[str, ...] = ("CPUExecutionProvider",)):
        self.model, self.column, self.output_column, self.threads, self.providers = model, column, output_column, threads, providers
        self.output = f"{output_column} array<float>"
        self._session = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_session": None}

    def score(self, rows: pd.DataFrame) -> pd.DataFrame:
        if self._session is None:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = self.threads
            offered = [p for p in self.providers if p in onnxruntime.get_available_providers()] or ["CPUExecutionProvider"]
            self._session = onnxruntime.InferenceSession(self.model, options, providers=offered)
        name = self._session.get_inputs()[0].name
        out = [self._session.run(None, {name: np.asarray(x, np.float32)[None]})[0][0] for x in rows[self.column]]
        return pd.DataFrame({self.output_column: [o.ravel() for o in out]})


class OnnxModel:
    """A model file with any number of inputs, outputs and states.

    ``inputs`` maps the model's input names to columns (arrays, with shapes in ``shapes`` if they have more dimensions than one, a batch dimension of 1 is put in front) or to
    constants; ``outputs`` maps its output names to columns, each (name, DDL type), whose arrays are flattened into the type's nesting. ``state`` maps an input name to (output
    name, shape): it starts as zeros for every value of ``stream`` and then is what the row before has left, so rows of a stream must come in order (see ``scored_in_order``).
    A recurrent activity model, a transducer's encoder, decoder and joiner, or a decoder with its cache are each one of these.
    """

    def __init__(self, model: str, inputs: dict[str, object], outputs: dict[str, tuple[str, str]], state: dict[str, tuple[str, tuple[int, ...]]] | None = None, shapes: dict[str, tuple[int, ...]] | None = None, open_session: Callable[[str], object] | None = None):
        self.model, self.inputs, self.outputs, self.state, self.shapes, self.open_session = model, inputs, outputs, state or {}, shapes or {}, open_session
        self.output = ", ".join(f"{name} {ddl}" for name, ddl in outputs.values())
        self._session = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_session": None}

    def _open(self):
        if self._session is None:
            if self.open_session:
                self._session = self.open_session(self.model)
            else:
                import onnxruntime

                self._session = onnxruntime.InferenceSession(self.model, providers=["CPUExecutionProvider"])
        return self._session

    def metadata(self) -> dict[str, str]:
        """The model's own key-value notes, such as its type."""
        return dict(self._open().get_modelmeta().custom_metadata_map)

    def _fed(self, row: pd.Series, name: str, source: object) -> np.ndarray:
        value = np.asarray(row[source] if isinstance(source, str) else source)
        value = value.astype(np.int64 if value.dtype.kind in "iub" else np.float32)
        if not isinstance(source, str):
            return value
        return value.reshape(1, *self.shapes[name]) if name in self.shapes else value[None]

    def score(self, rows: pd.DataFrame, state: dict[str, np.ndarray] | None = None) -> pd.DataFrame:
        """Outputs of the rows, in their order. ``state`` is read and left as it is after the last row; without one it begins as zeros."""
        session, own = self._open(), {} if state is None else state
        for name, (_, shape) in self.state.items():
            own.setdefault(name, np.zeros(shape, np.float32))
        wanted = [*self.outputs, *(out for out, _ in self.state.values())]
        found: dict[str, list] = {name: [] for name, _ in self.outputs.values()}
        for _, row in rows.iterrows():
            fed = {name: self._fed(row, name, source) for name, source in self.inputs.items()}
            results = dict(zip(wanted, session.run(wanted, fed | own), strict=True))
            own.update({name: results[out] for name, (out, _) in self.state.items()})
            for out, (name, ddl) in self.outputs.items():
                value = np.asarray(results[out])
                depth = ddl.count("array<")
                found[name].append(value.reshape(value.shape[value.ndim - depth :] if value.ndim > depth and value.size == np.prod(value.shape[value.ndim - depth :]) else value.shape).tolist() if depth else value.ravel()[0].item())
        return pd.DataFrame(found, index=rows.index)


class EnergyVad:
    """A stand-in for a voice activity model: the share of a window's energy over a floor."""

    output = "prob double"

    def __init__(self, floor: float = 1e-4):
        self.floor = floor

    def score(self, rows: pd.DataFrame) -> pd.DataFrame:
        energy = [float(np.mean(np.square(np.asarray(x, np.float64)))) for x in rows["samples"]]
        return pd.DataFrame({"prob": [e / (e + self.floor) for e in energy]})


class MeanSpectrum:
    """A stand-in for a speaker model: mean log-mel features over two-second chunks, unit length."""

    output = "embedding array<double>"

    def score(self, rows: pd.DataFrame) -> pd.DataFrame:
        from wavemill.functions import dsp

        out = []
        for samples in rows["samples"]:
            features = dsp.log_mel(np.asarray(samples, np.float64))
            if not len(features):
                out.append(None)
                continue
            v = np.mean([c.mean(axis=0) for c in dsp.cyclic_chunks(features)], axis=0)
            v = v - v.mean()
            out.append(v / max(np.linalg.norm(v), 1e-12))
        return pd.DataFrame({"embedding": out})


class Spelled:
    """A stand-in for a recogniser: the length of a segment in words."""

    output = "text string"

    def score(self, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"text": [f"{len(x)} samples" for x in rows["samples"]]})


class Beep:
    """A stand-in for speech synthesis: a tone as long as the phonemes."""

    output = "samples array<double>"

    def score(self, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"samples": [np.sin(np.arange(len(ids) * 80) * 0.1) for ids in rows["phoneme_ids"]]})


def scored(rows: DataFrame, scorer: Scorer, timed: bool = False) -> DataFrame:
    """The rows with the scorer's columns, and with ``seconds`` of the batch per row if ``timed``."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {scorer.output}" + ", seconds double" * timed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            began = time.perf_counter()
            found = scorer.score(batch)
            found.index = batch.index
            out = pd.concat([batch, found], axis=1)
            yield out.assign(seconds=(time.perf_counter() - began) / max(1, len(batch))) if timed else out

    return rows.mapInPandas(run, own)


def scored_in_order(rows: DataFrame, scorer: OnnxModel, stream: str, order: str) -> DataFrame:
    """``scored`` for models with state: each stream's rows in order, in one task, batch after batch with the state carried on; no stream is held as a whole."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {scorer.output}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, {}
        for batch in batches:
            for name, part in batch.groupby(stream, sort=False, dropna=False):
                if name != last:
                    last, state = name, {}
                yield pd.concat([part, scorer.score(part, state)], axis=1)

    return rows.repartition(stream).sortWithinPartitions(stream, order).mapInPandas(run, own)


def recogniser(model: OnnxModel, makers: dict[str, Callable[[OnnxModel], Scorer]], kind: str | None = None, key: str = "model_type") -> Scorer:
    """The recogniser of a model: by the type that is asked for, or else by the model's own metadata. Survey id D9."""
    kind = kind or model.metadata().get(key)
    if kind not in makers:
        raise ValueError(f"no recogniser for models of type {kind!r}; there are {', '.join(sorted(makers))}")
    return makers[kind](model)


def real_time_factor(rows: DataFrame, rate: int = 16000, seconds: str = "seconds", samples: str = "samples"):
    """Elapsed seconds over audio seconds."""
    from pyspark.sql import functions as F

    return rows.agg((F.sum(seconds) / (F.sum(F.size(samples)) / rate)).alias("rtf"))


_makers: dict[str, Callable[..., Scorer]] = {"energy_vad": EnergyVad, "mean_spectrum": MeanSpectrum, "spelled": Spelled, "beep": Beep, "onnx": OnnxScorer}


def register(kind: str, maker: Callable[..., Scorer]) -> None:
    _makers[kind] = maker


def create(kind: str, **options) -> Scorer:
    """A scorer by its type name."""
    if kind not in _makers:
        raise ValueError(f"no scorer {kind!r}; there are {', '.join(sorted(_makers))}")
    return _makers[kind](**options)
