"""Folds over the ordered rows of a stream, batch after batch: no stream is held as a whole. SURVEY ids: S2, T1, T2, T9, T10, W7, section 2.15.

A ``Program`` has one definition for both uses: ``folded`` runs it over a table, ``streaming.programs`` over micro-batches, and any cut of
the rows into batches gives the same rows. Its state is a dictionary of plain values and, under ``held``, the samples that no window has consumed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from wavemill.operators.timeline import ONSET

RATE = 16000
#: Rows that a fold reads, over streams, before it hands on what they gave.
GATHERED = 10_000


class Program:
    """``columns`` are read, ``output`` is the DDL of what ``take`` (some more rows, in order) and ``finish`` (the stream has ended) return."""

    columns: tuple[str, ...] = ("value",)
    output: str = ""

    def begin(self) -> dict[str, Any]:
        return {"start": 0, "held": np.zeros(0)}

    def take(self, state: dict[str, Any], rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def finish(self, state: dict[str, Any]) -> pd.DataFrame:
        return self.frame([])

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[c.split()[0] for c in self.output.split(", ")])


def fed(state: dict[str, Any], rows: pd.DataFrame) -> None:
    """The values of some more rows go behind the samples that are held."""
    state["held"] = np.concatenate([state["held"], rows["value"].to_numpy(np.float64)])


def consumed(state: dict[str, Any], n: int) -> None:
    """The first n samples that are held are not needed any more."""
    n = min(n, len(state["held"]))
    state["start"] += n
    state["held"] = state["held"][n:].copy()


class BoundedBuffer(Program):
    """A buffer of ``capacity`` samples that is written in blocks and read by windows, at most ``reads`` after each block.

    What is not read before it must make room is lost, oldest first, and an ``overrun`` row says where and how much; the specification's ring overwrites it silently. Rows: kind (window,
    overrun, or rest at the end of the stream), start, n, samples (null for an overrun). A block is written when it is full.
    """

    output = "kind string, start long, n long, samples array<double>"

    def __init__(self, capacity: int = 30 * RATE, block: int = RATE // 10, window: int = RATE, hop: int = 0, reads: int = 1):
        if capacity < max(block, window):
            raise ValueError(f"a capacity of {capacity} samples for blocks of {block} and windows of {window}")
        self.capacity, self.block, self.window, self.hop, self.reads = capacity, block, window, hop or window, reads

    def begin(self) -> dict[str, Any]:
        return super().begin() | {"written": 0}

    def take(self, state: dict[str, Any], rows: pd.DataFrame) -> pd.DataFrame:
        fed(state, rows)
        out = []
        while state["start"] + len(state["held"]) >= state["written"] + self.block:
            state["written"] += self.block
            lost = state["written"] - state["start"] - self.capacity
            if lost > 0:
                out.append(("overrun", state["start"], lost, None))
                consumed(state, lost)
            for _ in range(self.reads):
                if state["written"] - state["start"] >= self.window:
                    out.append(("window", state["start"], self.window, state["held"][: self.window].copy()))
                    consumed(state, self.hop)
        return self.frame(out)

    def finish(self, state: dict[str, Any]) -> pd.DataFrame:
        return self.frame([("rest", state["start"], len(state["held"]), state["held"])] if len(state["held"]) else [])


class WakeThenText(Program):
    """A wake word, then speech to text (T10): short windows until one holds the wake word, which clears the buffer; then one long window is recognised, and waiting begins again.

    ``wake`` says of a window whether it holds the wake word, ``text`` what is said in one. Each window is looked at as soon as it is full, so nothing but it is in the
    buffer when it is cleared. Rows: kind (wake or text), start, end (samples), text (null for a wake word).
    """

    output = "kind string, start long, end long, text string"

    def __init__(self, wake: Callable[[np.ndarray], bool], text: Callable[[np.ndarray], str], wake_window: int = RATE * 3 // 2, wake_hop: int = RATE // 2, text_window: int = 3 * RATE, text_hop: int = RATE * 29 // 10):
        self.wake, self.text, self.sizes, self.hops = wake, text, (wake_window, text_window), (wake_hop, text_hop)

    def begin(self) -> dict[str, Any]:
        return super().begin() | {"listening": False}

    def take(self, state: dict[str, Any], rows: pd.DataFrame) -> pd.DataFrame:
        fed(state, rows)
        out = []
        while len(state["held"]) >= (size := self.sizes[state["listening"]]):
            window, start, hop = state["held"][:size], state["start"], self.hops[state["listening"]]
            if state["listening"]:
                out.append(("text", start, start + size, self.text(window)))
                state["listening"] = False
            elif self.wake(window):
                out.append(("wake", start, start + size, None))
                state["listening"], hop = True, size
            consumed(state, hop)
        return self.frame(out)


class SpeakerChange(Program):
    """Changes of the strongest class of a sliding window (T9, W1, A12, W7).

    ``scores`` maps windows (n x samples) to scores (n x frames x classes). A class is active in a frame above ``onset`` (at it, as in the frame before); a window's strongest class, by the
    share of frames after the first ``skip``, is a change if that share is above ``least`` and the class is not the one last reported; class 0 counts as reported at
    first. Of equal shares the first class is the strongest. Rows: start (sample), class, activity.
    """

    output = "start long, class int, activity double"

    def __init__(self, scores: Callable[[np.ndarray], np.ndarray], window: int = 5 * RATE, hop: int = RATE // 2, onset: float = ONSET, skip: int = 200, least: float = 0.2, at_once: int = 64):
        self.scores, self.window, self.hop, self.onset, self.skip, self.least, self.at_once = scores, window, hop, onset, skip, least, at_once

    def begin(self) -> dict[str, Any]:
        return super().begin() | {"reported": 0}

    def take(self, state: dict[str, Any], rows: pd.DataFrame) -> pd.DataFrame:
        fed(state, rows)
        n = max(0, (len(state["held"]) - self.window) // self.hop + 1)
        out = []
        for lo in range(0, n, self.at_once):
            firsts = np.arange(lo, min(n, lo + self.at_once)) * self.hop
            found = np.asarray(self.scores(state["held"][firsts[:, None] + np.arange(self.window)]), np.float64)
            frame = np.arange(found.shape[1])[None, :, None]
            last = np.maximum.accumulate(np.where(found != self.onset, frame, -1), axis=1)
            active = np.where(last >= 0, np.take_along_axis(found, np.maximum(last, 0), axis=1) > self.onset, False)
            share = active[:, self.skip :].mean(axis=1)
            strongest = share.argmax(axis=1)
            for first, k, activity in zip(firsts.tolist(), strongest.tolist(), share.max(axis=1).tolist(), strict=True):
                if activity > self.least and k != state["reported"]:
                    state["reported"] = k
                    out.append((state["start"] + first, k, activity))
        consumed(state, n * self.hop)
        return self.frame(out)


def chunks_in_order(rows: DataFrame, stream: str, order: str, run: Callable[[Iterator[tuple[Any, bool, pd.DataFrame]]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """Each stream's rows in order, in one task, as ``run`` gets them: (stream, whether it is the first piece of it, a piece). Rows without a stream take no part."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[Any, bool, pd.DataFrame]]:
        last = None
        for batch in batches:
            for name, part in batch.groupby(stream, sort=False):
                yield name, name != last, part
                last = name

    placed = rows.where(rows[f"`{stream}`"].isNotNull()).repartition(stream).sortWithinPartitions(stream, order)
    return placed.mapInPandas(lambda batches: run(pieces(batches)), schema)


def folded(rows: DataFrame, program: Program, stream: str = "stream_id", order: str = "idx") -> DataFrame:
    """stream and the program's output. A stream takes one task, which holds a batch of its rows and the program's state; a null value counts as NaN."""
    slim = rows.select(stream, order, *program.columns)

    def outputs(pieces: Iterator[tuple[Any, bool, pd.DataFrame]]) -> Iterator[tuple[Any, pd.DataFrame, int]]:
        state, last = None, None
        for name, first, part in pieces:
            if first:
                if state is not None:
                    yield last, program.finish(state), 0
                state, last = program.begin(), name
            yield name, program.take(state, part), len(part)
        if state is not None:
            yield last, program.finish(state), 0

    def run(pieces: Iterator[tuple[Any, bool, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        """Short streams give a few rows each: these are handed on together."""
        held, size = [], 0
        for name, out, read in outputs(pieces):
            size += read
            if len(out):
                out.insert(0, stream, name)
                held.append(out)
            if size >= GATHERED and held:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held, size = [], 0
        if held:
            yield pd.concat(held, ignore_index=True)

    return chunks_in_order(slim, stream, order, run, f"{stream} {slim.schema[stream].dataType.simpleString()}, {program.output}")
