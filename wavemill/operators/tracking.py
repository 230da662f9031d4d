"""Online identities: tracking, change detection, diarisation. SURVEY ids: T6, T7, T8, T10, J3, A8, A15, O9, W2, W8, X16.

Pure steps over the ordered rows of a stream, batch by batch as in ``operators.vad``; streams run in parallel. A relabelling (``diarised``) needs its stream's segments as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wavemill.operators import vad
from wavemill.operators.clustering import by_first_appearance, cluster
from wavemill.operators.folds import RATE, Program, chunks_in_order, consumed, fed

MATCH, RECENT, PRUNE_EVERY, PRUNE_LEAST, PRUNE_SHARE = 0.4, 20, 121, 3, 0.2
CHANGE_OPTIONS = {"cap": 5, "prune_every": 0}
EPSILON = float(np.finfo(np.float32).eps)


def length(v: np.ndarray) -> float:
    return math.sqrt(v.dot(v))


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return float(a @ b / max(length(a) * length(b), EPSILON))


@dataclass
class Tracker:
    """Ids with their vectors. ``best`` matches the best score instead of the highest id above the threshold; every ``prune_every`` windows (0: never) rare ids are forgotten."""

    threshold: float = MATCH
    cap: int = 50
    best: bool = False
    prune_every: int = PRUNE_EVERY
    vectors: dict[int, list[np.ndarray]] = field(default_factory=dict)
    last: int = 0
    recent: list[int] = field(default_factory=list)
    windows: int = 0
    known: dict[int, tuple[list[np.ndarray], list[float]]] = field(default_factory=dict, init=False, repr=False, compare=False)

    def lengths(self, ident: int) -> list[float]:
        """The lengths of an id's vectors, each computed once."""
        xs = self.vectors[ident]
        kept = self.known.get(ident)
        if kept is None or kept[0] is not xs or len(kept[1]) > len(xs):
            if len(self.known) > 2 * len(self.vectors) + 8:
                self.known = {k: x for k, x in self.known.items() if k in self.vectors}
            kept = self.known[ident] = (xs, [])
        kept[1].extend(length(x) for x in xs[len(kept[1]) :])
        return kept[1]

    def match(self, v: np.ndarray) -> int:
        own = length(v)
        scores = {k: max([float(v.dot(x)) / max(own * n, EPSILON) for x, n in zip(xs, self.lengths(k), strict=True)]) for k, xs in self.vectors.items() if xs}
        hits = {k: s for k, s in scores.items() if s > self.threshold}
        if not hits:
            return -1
        return max(hits, key=lambda k: (hits[k], -k)) if self.best else max(hits)

    def share(self, ident: int) -> float:
        return self.recent.count(ident) / len(self.recent) if self.recent else 0.0

    def step(self, speaking: bool, vector) -> tuple[int, bool, float]:
        """(id, first, share of the last 20); (0, False, 0) in silence."""
        out = (0, False, 0.0)
        if speaking and vector is not None:
            v = np.asarray(vector, np.float64)
            ident = self.match(v)
            first = ident < 0
            if first:
                self.last += 1
                ident = self.last
                self.vectors[ident] = [v]
            elif len(self.vectors[ident]) < self.cap:
                self.vectors[ident].append(v)
            self.recent = (self.recent + [ident])[-RECENT:]
            out = (ident, first, 0.0 if first else self.share(ident))
        self.windows += 1
        if self.prune_every and self.windows % self.prune_every == 0:
            self.vectors = {k: x for k, x in self.vectors.items() if len(x) >= PRUNE_LEAST or self.share(k) >= PRUNE_SHARE}
        return out


@dataclass
class ChangeDetector:
    """A new id is a change, unless it is the very first; after a change the tracker starts anew, and ids go on counting. The specification's program never prunes."""

    tracker: Tracker = field(default_factory=lambda: Tracker(**CHANGE_OPTIONS))

    def step(self, vector) -> bool:
        _, first, _ = self.tracker.step(True, vector)
        if not first or (len(self.tracker.vectors) == 1 and len(next(iter(self.tracker.vectors.values()))) == 1):
            return False
        self.tracker.vectors.clear()
        return True


@dataclass
class Diarist:
    """Segments to speakers: a match blends the stored vector, a miss adds a key and clusters all keys anew, which may relabel what came before.

    Only the clustering after the last miss is seen in the labels, so it is made when they are asked for, of the vectors as they were then.
    """

    threshold: float = MATCH
    registry: list[np.ndarray] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)
    missed: list[np.ndarray] | None = None
    rows: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def _store(self, key: int, v: np.ndarray) -> None:
        """The registry, and its vectors' norms and rows of one array that doubles when it is full."""
        if key == len(self.registry):
            self.registry.append(v)
        self.registry[key] = v
        if key >= len(self.rows):
            grown = np.zeros((max(16, 2 * key), len(v) + 1))
            grown[:key] = self.rows[:key] if key else 0
            self.rows = grown
        self.rows[key, 0], self.rows[key, 1:] = np.linalg.norm(v), v

    def step(self, vector) -> int:
        """The key that the segment goes to."""
        v = np.asarray(vector, np.float64)
        n = len(self.registry)
        scores = self.rows[:n, 1:] @ v / np.maximum(self.rows[:n, 0] * np.linalg.norm(v), np.finfo(np.float32).eps) if n else []
        key = int(np.argmax(scores)) if n else -1
        if key >= 0 and scores[key] > self.threshold:
            self._store(key, (self.registry[key] + v) / 2)
        else:
            key = n
            self._store(key, v)
            self.missed = list(self.registry)
        self.keys.append(key)
        return key

    def speakers(self) -> list[int]:
        """The label of every segment so far, in the order of arrival."""
        if self.missed is not None:
            self.labels = by_first_appearance(cluster(np.array(self.missed))).tolist()
            self.missed = None
        return [self.labels[k] for k in self.keys]


class SpeakerTrack(Program):
    """Who speaks in a sliding window (the specification's track_demo), or whether the speaker has changed (change_id_demo; ``changes``). Survey ids T1, T3, P9, N2, J3, T6, T8.

    A window is cut into whole pieces of ``gate.window`` samples; ``probability`` maps them (n x samples; the pieces of up to ``at_once`` windows in a call) to scores, which the activity machine follows from window to window. If at least ``least`` pieces start
    or go on with speech, ``embed`` maps the window to a vector (or None), and the tracker looks for it. Rows: start (sample), speaking, ident, is_first, ratio (0, false and 0 in silence),
    change (false unless ``changes``).
    """

    output = "start long, speaking boolean, ident long, is_first boolean, ratio double, change boolean"

    def __init__(self, probability: Callable[[np.ndarray], np.ndarray], embed: Callable[[np.ndarray], np.ndarray | None], window: int = 2 * RATE, hop: int = RATE // 2, gate: vad.GateConfig | None = None, least: int = 6, changes: bool = False, at_once: int = 64, **options):
        self.at_once = at_once
        self.probability, self.embed, self.window, self.hop, self.least, self.changes = probability, embed, window, hop, least, changes
        self.gate = gate or vad.GateConfig(threshold=0.85)
        self.options = CHANGE_OPTIONS | options if changes else options

    def begin(self) -> dict[str, Any]:
        return super().begin() | {"gate": asdict(vad.GateState()), "tracker": None}

    def take(self, state: dict[str, Any], rows: pd.DataFrame) -> pd.DataFrame:
        fed(state, rows)
        own, gate, out = Tracker(**self.options), vad.GateState(**state["gate"]), []
        if saved := state["tracker"]:
            own.vectors = {int(k): [np.array(v) for v in x] for k, x in saved["vectors"].items()}
            own.last, own.recent, own.windows = saved["last"], saved["recent"], saved["windows"]
        detector, at = ChangeDetector(own), 0
        n = max(0, (len(state["held"]) - self.window) // self.hop + 1)
        pieces = self.window // self.gate.window
        for k in range(n):
            if k % self.at_once == 0:
                firsts = np.arange(k, min(n, k + self.at_once)) * self.hop
                cut = state["held"][firsts[:, None] + np.arange(pieces * self.gate.window)].reshape(-1, self.gate.window)
                scores = np.asarray(self.probability(cut), np.float64).reshape(len(firsts), pieces).tolist()
            window = state["held"][at : at + self.window]
            heard = 0
            for p in scores[k % self.at_once]:
                gate, code = vad.gate_step(gate, p, self.gate)
                heard += code in (vad.START, vad.SPEAKING)
            vector = self.embed(window) if heard >= self.least else None
            last, change = (0, False, 0.0), False
            if not self.changes:
                last = own.step(vector is not None, vector)
            elif vector is not None:
                before = own.last
                change = detector.step(vector)
                last = (own.recent[-1], own.last > before, 0.0 if own.last > before else own.share(own.recent[-1]))
            out.append((state["start"] + at, heard >= self.least, *last, change))
            at += self.hop
        consumed(state, at)
        state["gate"] = asdict(gate)
        state["tracker"] = {"vectors": {k: [v.tolist() for v in x] for k, x in own.vectors.items()}, "last": own.last, "recent": own.recent, "windows": own.windows}
        return self.frame(out)


def tracked(rows: DataFrame, stream: str, order: str, vector: str = "embedding", speaking: str | None = None, **options) -> DataFrame:
    """stream, order, ident, is_first, ratio."""
    def take(own: Tracker, pdf: pd.DataFrame) -> pd.DataFrame:
        flags = pdf[speaking] if speaking else [True] * len(pdf)
        out = [own.step(bool(f), v) for f, v in zip(flags, pdf[vector], strict=True)]
        return pdf[[stream, order]].assign(ident=[x[0] for x in out], is_first=[x[1] for x in out], ratio=[x[2] for x in out])

    return _chunked(rows, lambda: Tracker(**options), take, stream, order, vector, speaking, "ident long, is_first boolean, ratio double")


def changes(rows: DataFrame, stream: str, order: str, vector: str = "embedding", **options) -> DataFrame:
    """stream, order, change."""
    def take(own: ChangeDetector, pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[[stream, order]].assign(change=[own.step(v) for v in pdf[vector]])

    return _chunked(rows, lambda: ChangeDetector(Tracker(**(CHANGE_OPTIONS | options))), take, stream, order, vector, None, "change boolean")


def diarised(segments: DataFrame, stream: str, order: str, vector: str = "embedding", threshold: float = MATCH) -> DataFrame:
    """stream, order, speaker: the labels after the last segment of the stream (the complete relabelling)."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, own = pdf.sort_values(order), Diarist(threshold)
        for v in pdf[vector]:
            own.step(v)
        return pdf[[stream, order]].assign(speaker=own.speakers())

    return _folded(segments, fold, stream, order, vector, None, "speaker long")


def wake_then_listen(rows: DataFrame, stream: str, order: str, hit: str, windows: int) -> DataFrame:
    """Rows during which a stream is listened to: the ``windows`` rows after a wake word; wake words within them don't count."""
    def take(left: list[int], pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for h in pdf[hit]:
            out.append(left[0] > 0)
            left[0] = windows if left[0] == 0 and h else max(0, left[0] - 1)
        return pdf[[stream, order]].assign(listening=out)

    return _chunked(rows, lambda: [0], take, stream, order, hit, None, "listening boolean")


def _slim(rows: DataFrame, stream: str, order: str, value: str, flag: str | None, schema: str) -> tuple[DataFrame, str]:
    slim = rows.select(*dict.fromkeys(c for c in (stream, order, value, flag) if c))
    kind = lambda c: slim.schema[c].dataType.simpleString()
    return slim, f"{stream} {kind(stream)}, {order} {kind(order)}, {schema}"


def _chunked(rows: DataFrame, begin: Callable[[], object], take: Callable[[object, pd.DataFrame], pd.DataFrame], stream: str, order: str, value: str, flag: str | None, schema: str) -> DataFrame:
    """A fold that gives rows as it goes: batch by batch, with what ``begin`` returns carried on."""

    def run(pieces: Iterator[tuple[object, bool, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        own = None
        for _, first, pdf in pieces:
            own = begin() if first else own
            yield take(own, pdf)

    slim, schema = _slim(rows, stream, order, value, flag, schema)
    return chunks_in_order(slim, stream, order, run, schema)


def _folded(rows: DataFrame, fold, stream: str, order: str, value: str, flag: str | None, schema: str) -> DataFrame:
    slim, schema = _slim(rows, stream, order, value, flag, schema)
    return slim.groupBy(stream).applyInPandas(fold, schema)
