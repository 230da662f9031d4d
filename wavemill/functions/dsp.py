"""Signal features on numpy arrays; the operators run them in Arrow batches. SURVEY ids: M8-M13, F1, F3, F4, F6, A6.

The spectrum is numpy's; a filter bank, a window and resampling weights are built once per worker.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

EPSILON = np.finfo(np.float32).eps


def frames_of(signal: np.ndarray, length: int, shift: int) -> np.ndarray:
    """Overlapping frames as a view: 1 + floor((n - length) / shift) of them, none if the signal is shorter than a frame."""
    if len(signal) < length:
        return np.zeros((0, length), signal.dtype)
    return np.lib.stride_tricks.sliding_window_view(signal, length)[::shift]


@lru_cache
def mel_bank(bins: int, rate: int, points: int, low: float = 20.0) -> np.ndarray:
    """Triangles with equal spacing on the mel scale, over points/2 spectrum bins: bins x points/2."""
    scale = 1127.0 * np.log1p(np.arange(points // 2) * rate / points / 700.0)
    edges = np.linspace(1127.0 * np.log1p(low / 700.0), 1127.0 * np.log1p(rate / 2 / 700.0), bins + 2)
    left, centre, right = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    inside = (scale > left) & (scale < right)
    return np.where(inside, np.where(scale <= centre, (scale - left) / (centre - left), (right - scale) / (right - centre)), 0.0)


def log_mel(signal: np.ndarray, bins: int = 80, rate: int = 16000, length: int = 400, shift: int = 160, emphasis: float = 0.97, log: bool = True) -> np.ndarray:
    """Frames x bins: mean removed, pre-emphasised (the first sample scaled), Hamming window, power spectrum, mel bank, log of at least epsilon."""
    return log_mel_frames(frames_of(np.asarray(signal, np.float64), length, shift), bins, rate, emphasis, log)


def log_mel_frames(frames: np.ndarray, bins: int = 80, rate: int = 16000, emphasis: float = 0.97, log: bool = True) -> np.ndarray:
    """``log_mel`` of frames that have been cut already: frames x bins."""
    length = frames.shape[1]
    points = 1 << (length - 1).bit_length()
    frames = frames - frames.mean(axis=1, keepdims=True) if len(frames) else frames
    lagged = np.concatenate([frames[:, :1], frames[:, :-1]], axis=1)
    power = np.abs(np.fft.rfft((frames - emphasis * lagged) * np.hamming(length), points)[:, : points // 2]) ** 2
    energy = power @ mel_bank(bins, rate, points).T
    return np.log(np.maximum(energy, EPSILON)) if log else energy


def keyword_features(signal: np.ndarray, bank: np.ndarray, gain: float = 500.0, tail: int = 80, length: int = 400, shift: int = 160, points: int = 512) -> np.ndarray:
    """Frames x bank columns: zero tail, gain, power / points over points/2 + 1 bins, bank, log; an energy of exactly 0 counts as epsilon."""
    frames = frames_of(np.concatenate([np.asarray(signal, np.float64), np.zeros(tail)]), length, shift)
    power = np.abs(np.fft.rfft(frames * gain, points)) ** 2 / points
    energy = power @ bank
    return np.log(np.where(energy == 0, EPSILON, energy))


def without_mean(features: np.ndarray) -> np.ndarray:
    """Cepstral mean subtraction over one chunk."""
    return features - features.mean(axis=0, keepdims=True)


def cyclic_chunks(features: np.ndarray, size: int = 198) -> list[np.ndarray]:
    """Chunks of ``size`` frames; the last is filled by repeating its own frames if it is the only one, else the first chunk's head."""
    out = []
    for at in range(0, len(features), size):
        chunk = features[at : at + size]
        if len(chunk) < size:
            source = chunk if at == 0 else out[0]
            chunk = np.concatenate([chunk, np.resize(source, (size - len(chunk), features.shape[1]))])
        out.append(chunk)
    return out


def stacked(features: np.ndarray, window: int, shift: int) -> np.ndarray:
    """Low frame rate: ``window`` neighbouring frames as one row, every ``shift`` frames."""
    if len(features) < window:
        return np.zeros((0, window * features.shape[1]))
    return np.lib.stride_tricks.sliding_window_view(features, window, axis=0)[::shift].transpose(0, 2, 1).reshape(-1, window * features.shape[1])


class Resampler:
    """Windowed-sinc resampling between rational rates, in blocks: what a later block still needs is kept.

    The filter is a sinc of the cutoff under a raised cosine of ``zeros`` zero crossings to each side. Output sample k stands at k / rate_out seconds; without
    ``flush`` only samples whose whole filter lies in the input so far come out.
    """

    def __init__(self, rate_in: int, rate_out: int, cutoff: float | None = None, zeros: int = 6):
        self.rate_in, self.rate_out, self.zeros = rate_in, rate_out, zeros
        self.cutoff = 0.99 * 0.5 * min(rate_in, rate_out) if cutoff is None else cutoff
        if not 0 < 2 * self.cutoff <= min(rate_in, rate_out):
            raise ValueError("the cutoff must be at most half of either rate")
        self.reset()

    def reset(self) -> None:
        self.held, self.held_from, self.done = np.zeros(0), 0, 0

    def _count(self, samples: int, flush: bool) -> int:
        """Output samples at times before the end of the input, less half a filter unless flushing. In ticks of the common multiple, so exact."""
        tick = int(np.lcm(self.rate_in, self.rate_out))
        ticks = samples * (tick // self.rate_in) - (0 if flush else int(np.floor(self.zeros / (2 * self.cutoff) * tick)))
        return 0 if ticks <= 0 else -(-ticks // (tick // self.rate_out))

    def __call__(self, block: np.ndarray, flush: bool = False) -> np.ndarray:
        signal = np.concatenate([self.held, np.asarray(block, np.float64)])
        end = self.held_from + len(signal)
        k = np.arange(self.done, self._count(end, flush))
        half = self.zeros / (2 * self.cutoff)
        centre = k / self.rate_out
        first = np.ceil((centre - half) * self.rate_in - 1e-9).astype(np.int64)
        taps = first[:, None] + np.arange(int(np.floor(2 * half * self.rate_in)) + 1)
        delta = taps / self.rate_in - centre[:, None]
        window = np.where(np.abs(delta) < half, 0.5 * (1 + np.cos(2 * np.pi * self.cutoff / self.zeros * delta)), 0.0)
        weight = 2 * self.cutoff * np.sinc(2 * self.cutoff * delta) * window / self.rate_in
        at = taps - self.held_from
        inside = (at >= 0) & (at < len(signal))
        out = (np.where(inside, signal[np.clip(at, 0, max(0, len(signal) - 1))], 0.0) * weight).sum(axis=1) if len(signal) else np.zeros(len(k))
        if flush:
            self.reset()
        else:
            self.done += len(k)
            need = max(self.held_from, int(np.floor((self.done / self.rate_out - half) * self.rate_in)) - 1)
            self.held, self.held_from = signal[need - self.held_from :], need
        return out


def dft(signal: np.ndarray, inverse: bool = False, scaled: bool = True) -> np.ndarray:
    """Complex transform of any size; the inverse divides by n unless ``scaled`` is off."""
    return np.fft.ifft(signal) * (1 if scaled else len(signal)) if inverse else np.fft.fft(signal)
