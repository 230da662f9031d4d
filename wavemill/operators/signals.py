"""Features and resampling of streams of samples, as programs of ``operators.folds``. SURVEY ids: F1, F2, F3, M11, M12.

Any cut of a stream into batches gives what the whole would; a stream's state is the samples that later frames still need.
"""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd

from wavemill.functions import dsp
from wavemill.operators.folds import RATE, Program


def first_sample(frame: np.ndarray, length: int, shift: int) -> np.ndarray:
    """Where a frame begins if frames are centred on the middles of shifts; negative for the first ones."""
    return frame * shift + shift // 2 - length // 2


def reflected(at: np.ndarray, n: int) -> np.ndarray:
    """Sample numbers before 0 and from n on, mirrored at the ends (the end sample is repeated) as often as it takes; n > 0."""
    at = np.mod(at, 2 * n)
    return np.where(at < n, at, 2 * n - 1 - at)


def frame_count(n: int, length: int, shift: int, ended: bool) -> int:
    """Centred frames of n samples: one for each shift, or, while more may come, those that end within them."""
    count = (n + shift // 2) // shift
    if ended:
        return count
    over = int(first_sample(np.int64(count - 1), length, shift)) + length - n
    return max(0, count - max(0, -(-over // shift)))


class MelFrames(Program):
    """Log-mel frames. With ``reflect`` they are centred, one for each shift, and mirror the samples at both ends (the last ones come out when the stream ends); else only
    whole frames count, and what is left is dropped. Rows: frame, feat."""

    output = "frame long, feat array<double>"

    def __init__(self, bins: int = 80, length: int = 400, shift: int = 160, reflect: bool = True, rate: int = RATE, at_once: int = 4096):
        self.bins, self.length, self.shift, self.reflect, self.rate, self.at_once = bins, length, shift, reflect, rate, at_once

    def begin(self) -> dict[str, Any]:
        return super().begin() | {"frame": 0}

    def _features(self, state: dict[str, Any], to: int) -> pd.DataFrame:
        """The frames before ``to``; the state then holds what the next ones need."""
        n, out = state["start"] + len(state["held"]), []
        for lo in range(state["frame"], to, self.at_once):
            frames = np.arange(lo, min(to, lo + self.at_once))
            begin = first_sample(frames, self.length, self.shift) if self.reflect else frames * self.shift
            at = begin[:, None] + np.arange(self.length)
            cut = state["held"][(reflected(at, n) if self.reflect else at) - state["start"]]
            out += list(zip(frames.tolist(), dsp.log_mel_frames(cut, self.bins, self.rate).tolist(), strict=True))
        state["frame"] = max(state["frame"], to)
        begin = int(first_sample(np.int64(state["frame"]), self.length, self.shift)) if self.reflect else state["frame"] * self.shift
        gone = max(0, min(begin, n - self.length - self.shift) - state["start"]) if self.reflect else min(max(0, begin - state["start"]), len(state["held"]))
        state["start"] += gone
        state["held"] = state["held"][gone:].copy()
        return self.frame(out)

    def take(self, state: dict[str, Any], rows: pd.DataFrame) -> pd.DataFrame:
        state["held"] = np.concatenate([state["held"], rows["value"].to_numpy(np.float64)])
        n = state["start"] + len(state["held"])
        return self._features(state, frame_count(n, self.length, self.shift, False) if self.reflect else max(0, (n - self.length) // self.shift + 1))

    def finish(self, state: dict[str, Any]) -> pd.DataFrame:
        n = state["start"] + len(state["held"])
        return self._features(state, frame_count(n, self.length, self.shift, True)) if self.reflect and n else self.frame([])


class Resampled(Program):
    """Windowed-sinc resampling. Rows: pos, sample."""

    output = "pos long, sample double"

    def __init__(self, rate_in: int, rate_out: int, cutoff: float | None = None, zeros: int = 6):
        self.options = (rate_in, rate_out, cutoff, zeros)

    def begin(self) -> dict[str, Any]:
        return super().begin() | {"done": 0}

    def _run(self, state: dict[str, Any], block: np.ndarray, flush: bool) -> pd.DataFrame:
        own = dsp.Resampler(*self.options)
        own.held, own.held_from, own.done = state["held"], state["start"], state["done"]
        out = own(block, flush)
        rows = self.frame(list(zip(range(state["done"], state["done"] + len(out)), out.tolist(), strict=True)))
        state["held"], state["start"], state["done"] = own.held, own.held_from, own.done
        return rows

    def take(self, state: dict[str, Any], rows: pd.DataFrame) -> pd.DataFrame:
        return self._run(state, rows["value"].to_numpy(np.float64), False)

    def finish(self, state: dict[str, Any]) -> pd.DataFrame:
        return self._run(state, np.zeros(0), True)
