"""Operator 5: URL filters by a bit-parallel wildcard automaton.

All rules are packed into one multiword Shift-And mask. A pattern of n literal bytes has n+1 states, one bit
each; a wildcard is a state that keeps itself on the bytes that it may swallow. One step of the automaton moves the states of
all patterns for one byte of every URL in a batch:

    states = ((states << 1) & follows[byte]) | (states & loops[byte])

Only the URL column reaches Python, in Arrow batches; the memory of a step is rows x words of 64 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import lean

#: Bytes of a padded block of URLs that are simulated at once.
BLOCK_BYTES = 1 << 22
_LOWER = {c: c + 32 for c in range(65, 91)}
_PARTS = re.compile(r"([^/?#]*)([^?#]*)", re.S)


def canonical(url: str | None) -> tuple[str, str]:
    """(host, path) of a url: what stands after the first ``://``; both empty where there is none."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host, path = _PARTS.match(rest).groups()
    return host.translate(_LOWER), path


class Automaton:
    """Anchored globs over bytes, all at once. ``*`` swallows anything, ``?`` one byte, and ``~`` anything but ``/``.

    A pattern is a list of literal strings and of these wildcards as one-character tuples, so that literals may hold any character.
    """

    def __init__(self, patterns: list[list]):
        follows, loops, starts, ends, n = [], [], [], [], 0
        for pattern in patterns:
            starts.append(n)
            state = n
            for item in pattern:
                if isinstance(item, str):
                    for byte in item.encode():
                        state += 1
                        follows.append((state, 1 if byte == 0 else byte))
                elif item[0] == "?":
                    state += 1
                    follows += [(state, b) for b in range(1, 256)]
                else:
                    loops += [(state, b) for b in range(1, 256) if item[0] == "*" or b != 47]
            ends.append(state)
            n = state + 1
        self.words, self.ends = max(1, -(-n // 64)), np.array(ends, dtype=np.int64)
        self.follows, self.loops = np.zeros((256, self.words), np.uint64), np.zeros((256, self.words), np.uint64)
        for table, pairs in ((self.follows, follows), (self.loops, loops)):
            for state, byte in pairs:
                table[byte, state // 64] |= np.uint64(1) << np.uint64(state % 64)
        self.loops[0] = ~np.uint64(0)  # byte 0 pads: it keeps all states
        self.start = np.zeros(self.words, np.uint64)
        for state in starts:
            self.start[state // 64] |= np.uint64(1) << np.uint64(state % 64)

    def run(self, strings: list[bytes]) -> np.ndarray:
        """strings x patterns: which match as a whole."""
        out = np.zeros((len(strings), len(self.ends)), bool)
        order = sorted(range(len(strings)), key=lambda i: len(strings[i]))
        while order:
            width = len(strings[order[-1]])
            rows = max(1, min(len(order), BLOCK_BYTES // max(1, width * 1)))
            some, order = order[-rows:], order[:-rows]
            out[some] = self._block([strings[i] for i in some], width)
        return out

    def _block(self, strings: list[bytes], width: int) -> np.ndarray:
        flat = np.frombuffer(b"".join(s.replace(b"\0", b"\1").ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
        states = np.repeat(self.start[None, :], len(strings), axis=0)
        one, top = np.uint64(1), np.uint64(63)
        for k in range(width):
            byte = flat[:, k]
            moved = states << one
            moved[:, 1:] |= states[:, :-1] >> top
            states = (moved & self.follows[byte]) | (states & self.loops[byte])
        return (states[:, self.ends // 64] >> (self.ends % 64).astype(np.uint64)) & one > 0


class UrlRules:
    """Allow and block rules ``host/path``: a rule fits its host and all its subdomains, and paths that start with its path; the longest wins."""

    def __init__(self, rules: list[tuple[str, str]], default: str = "allow"):
        self.default, self.names, self.verdicts, globs = default, [], [], []
        for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
            host, slash, path = rule.partition("/")
            globs += [[host, slash + path, ("*",)], [("~",), "." + host, slash + path, ("*",)]]
            self.names.append(rule)
            self.verdicts.append(verdict)
        self.automaton = Automaton(globs)

    def judge(self, urls: list[str | None]) -> tuple[list, list, list, list]:
        """host, path, rule, verdict of each url."""
        parts = [canonical(u) for u in urls]
        hits = self.automaton.run([(h + p).encode("utf-8", "surrogatepass") for h, p in parts])
        best = np.full(len(urls), -1)
        for k in range(len(self.names)):
            best[hits[:, 2 * k] | hits[:, 2 * k + 1]] = k
        best = best.tolist()
        rule = [self.names[k] if k >= 0 else None for k in best]
        return [h for h, _ in parts], [p for _, p in parts], rule, [self.verdicts[k] if k >= 0 else self.default for k in best]


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: ``key``, host, path, rule, verdict.

    A null, empty or scheme-less url has an empty host and path and fits no rule with a host: it gets the default
    verdict. Of equally long rules that fit, the last one in text order wins, and of a rule that is listed twice the last listing. Keys may be null or repeat; every row is judged for itself. Other columns are not read.
    """
    slim = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"))

    @lean
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = UrlRules(rules, default)
        for batch in batches:
            host, path, rule, verdict = own.judge(batch.column("url").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *[pa.array(x, pa.string()) for x in (host, path, rule, verdict)]], [key, "host", "path", "rule", "verdict"]
            )

    return slim.mapInArrow(judged, f"`{key}` long, host string, path string, rule string, verdict string")
