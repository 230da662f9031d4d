"""A tokenizers-library encoder that remembers the ids of words, with exactly the library's results.

For a vocabulary whose normaliser works character by character (or composes within a word) and whose
pre-tokenizer cuts runs of letters, single digits and runs of other signs, the ids of a text are the ids of its
white-space-free runs one after another; and where a run only holds Latin letters and plain ASCII signs (no apostrophe,
which begins contractions), it may be cut between the letters and the signs as well. Words are then looked up in a bounded cache, and only new ones
go through the library. Every other run goes through the library whole; any other vocabulary is used on whole texts.

Texts of plain signs are cut together, wherever white space, letters and signs meet; Arrow numbers their words, each distinct word is looked up once, and numpy lays the ids out.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wavemill.llm.common import keep

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The cut that the word cache is proven for (a fixed value: it must equal the vocabulary file's own pattern).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)]))
_PLAIN = bytes([9, 10, 11, 12, 13, *(c for c in range(32, 127) if c != 39), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])
_WORDS = re.compile("[a-z\xdf-\xf6\xf8-\xff]+|[!-&(-@\\[-`{-~]+")
_RUNS = re.compile(r"[^ \t\n\r\x0b\x0c]+")
#: Characters of texts that are cut together; a longer text is taken alone.
GROUP_CHARS = 1 << 19
#: Of the Latin-1 signs: lower case, and whether it is white space (0), a letter (1) or another sign (2).
_LOWER = bytes(c + 32 if 65 <= c <= 90 or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
_KIND = np.array([0 if chr(c) in " \t\n\r\x0b\x0c" else 1 if chr(c) in LETTERS else 2 for c in range(256)], np.uint8)


class _Cache(dict):
    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.encode(word)
        return found


def _plain(text: str) -> bool:
    """Nothing but Latin letters, digits, plain ASCII signs and white space?"""
    try:
        return not text.encode("latin-1").translate(None, _PLAIN) and "<|" not in text
    except UnicodeEncodeError:
        return False


class Encoder:
    """ids of a text as little-endian bytes, ``dtype`` wide: two bytes where the vocabulary allows it, else four."""

    def __init__(self, path: str, cache_words: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.limit = cache_words
        with open(path, encoding="utf-8") as f:
            head, model, _ = f.read().partition('"model":')  # the vocabulary itself isn't wanted a second time
        try:
            spec = json.loads(head + '"model": null}') if model else {}
        except ValueError:
            spec = {}
        steps = [(x["type"], x.get("content")) for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = (
            steps == [("NFC", None), ("Replace", " "), ("Lowercase", None)]
            and spec["normalizer"]["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and (cuts[0]["pattern"], cuts[0]["behavior"], cuts[0]["invert"]) == ({"Regex": WORD_PATTERN}, "Removed", True)
            and not cuts[1]["add_prefix_space"]
            and not cuts[1]["use_regex"]
            and not spec.get("post_processor")
            and all(re.fullmatch(r"<\|\w+\|>", t["content"]) and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))
        )
        if self.by_word:
            table = {c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in LETTERS}
            self.as_bytes = str.maketrans({c: x for c, x in table.items() if c != x})
        self.words, self.runs, self.known = _Cache(self._word), _Cache(self._run), _Cache(self._piece)

    def _piece(self, piece: bytes) -> bytes:
        return self._word(piece.decode("latin-1")) if _KIND[piece[0]] else b""

    def _run(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        if word[0] in self.as_bytes_letters:
            return np.array([t.id for t in self.tokenizer.model.tokenize(word.translate(self.as_bytes))], self.dtype).tobytes()
        return self._run(word)

    as_bytes_letters = frozenset(LETTERS)

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._run(text)
        for cache in (self.words, self.runs):
            if len(cache) > self.limit // 4:
                cache.clear()
        if _plain(text):
            return b"".join(map(self.words.__getitem__, _WORDS.findall(text.lower())))
        return b"".join(self._mixed(run) for run in _RUNS.findall(text))

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many there are of each."""
        parts, sizes, group, chars = [np.zeros(0, self.dtype)], np.zeros(len(texts), np.int64), [], 0

        def flush() -> None:
            if group:
                ids, sizes[group] = self._together([texts[i] for i in group])
                parts.append(ids)

        for i, text in enumerate(texts):
            if self.by_word and _plain(text):
                if group and chars + len(text) > GROUP_CHARS:
                    flush()
                    group, chars = [], 0
                group.append(i)
                chars += len(text)
            else:
                flush()
                group, chars = [], 0
                parts.append(np.frombuffer(self.encode(text), self.dtype))
                sizes[i] = len(parts[-1])
        flush()
        return np.concatenate(parts), sizes

    def _together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode_many`` for plain texts."""
        if len(self.known) > self.limit:
            self.known.clear()
        raw = "\n".join([*texts, ""]).encode("latin-1").translate(_LOWER)
        kind = _KIND[np.frombuffer(raw, np.uint8)]
        starts = np.concatenate([[0], np.flatnonzero(kind[1:] != kind[:-1]) + 1])
        offsets = np.append(starts, len(raw))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        numbered = pc.dictionary_encode(pieces)
        found = list(map(self.known.__getitem__, numbered.dictionary.to_pylist()))
        each = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        words = kind[starts] > 0
        starts, number = starts[words], numbered.indices.to_numpy()[words]
        n = each[number]
        ends = np.cumsum(n)
        place = np.repeat((np.cumsum(each) - each)[number] - ends + n, n)
        place += np.arange(len(place))
        texts_end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        last = np.concatenate([[0], ends])[np.searchsorted(starts, texts_end)]
        return np.frombuffer(b"".join(found), self.dtype)[place], np.diff(last, prepend=0)

    def _mixed(self, run: str) -> bytes:
        if len(run) < 64 and run.isascii() and "'" not in run and "<|" not in run and run.isprintable():
            return b"".join(map(self.words.__getitem__, _WORDS.findall(run.lower())))
        return self.runs[run] if len(run) < 64 else self._run(run)


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and sizes of texts with ``end_id`` (none: nothing) after each."""
    return (ids, sizes) if end_id is None else (np.insert(ids, np.cumsum(sizes), end_id), sizes + 1)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process: later tasks of the operators that use it find its cache warm."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    keep(("token_store", "packing"), _encoders.clear)
    return _encoders[path]
