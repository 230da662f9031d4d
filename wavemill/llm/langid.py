"""Operator 7: language identification by cross-parsing against suffix automata.

Each language is a suffix automaton of a bounded sample of its labelled text. A document is parsed against each: from left
to right into the longest phrases that occur in the sample. The language with the least cross-entropy, phrases x
log2(sample length) / document length, wins.

All letters of the samples are told apart. For the commonest symbols the automata of all languages are one dense table of (state, symbol) -> state, with the
restart after a phrase folded in, so a step of the parse is one gather; transitions on the others are sorted by state and symbol and looked up. The table's width changes
its memory and no result. Documents are cut into blocks of BLOCK symbols (each parsed from a fresh phrase), and
all blocks of a batch step through all automata side by side; every character of every text is parsed.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavemill.llm.common import drop_caches_of_others, give_back, text_of

#: Bounds of what is learned from: labelled rows per language, and characters taken of a row. Both hold for each language alone, however many there are.
SAMPLE_ROWS, ROW_CHARS = 64, 256
#: Symbols of the dense table at most, and its entries (a wide table is narrowed to them).
SYMBOLS, DENSE = 48, 1 << 23
BLOCK, BATCH_SYMBOLS, SLICE_ROWS = 1024, 1 << 19, 250
SPACE, RARE = 0, 1
UNDETERMINED = "und"
_COUNT, _PLACE = 28, (1 << 28) - 1


class SuffixAutomaton:
    """The least automaton of all substrings of a sequence of symbols: ``next[state]`` maps symbols to states, 0 is the start."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            new = len(self.next)
            self.next.append({})
            link.append(0)
            length.append(length[last] + 1)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new


    def edges(self) -> np.ndarray:
        """Rows of state, symbol and next state."""
        return np.array([(state, c, to) for state, out in enumerate(self.next) for c, to in out.items()], np.int64).reshape(-1, 3)


def folded(text: str) -> np.ndarray:
    """Code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


class CrossParser:
    """Languages and their automata, as one table. ``samples`` maps each language to its sample texts."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        letters = Counter(c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha())
        known = [c for c, _ in sorted(letters.items(), key=lambda x: (-x[1], x[0]))]
        code = {c: k + 2 for k, c in enumerate(known)}
        self.size = len(known) + 2
        self.symbol = np.zeros(0x110000, np.uint8 if self.size <= 1 << 8 else np.uint16 if self.size <= 1 << 16 else np.int32)
        for point in range(0x40000):
            c = chr(point)
            if c.isalpha():
                self.symbol[point] = code.get(c.lower()[0], RARE)  # no sample has RARE
        automata, self.bits = [], []  # of each language its number of states and its transitions
        for language in self.languages:
            text: list[int] = []
            for t in samples[language]:
                text += [*self.codes(t).tolist(), SPACE]
            automaton = SuffixAutomaton(text)
            automata.append((len(automaton.next), automaton.edges()))
            self.bits.append(np.log2(max(2, len(text))))
        self.width = width = max(2, min(SYMBOLS, self.size, DENSE // max(1, sum(n for n, _ in automata))))
        tables, self.roots, keys, values, base = [], [], [], [], 0
        for states, edges in automata:
            state, symbol, to = edges.T
            narrow = symbol < width
            root = np.full(width, (base * width) | (1 << _COUNT), np.int64)  # a symbol that the sample lacks is a phrase by itself
            first = narrow & (state == 0)
            root[symbol[first]] = (base + to[first]) * width
            table = np.empty((states, width), np.int64)
            table[:] = root + (1 << _COUNT)  # the phrase ends before this symbol, which begins the next
            table[0] = root
            table[state[narrow], symbol[narrow]] = (base + to[narrow]) * width
            keys.append((base + state[~narrow]) * self.size + symbol[~narrow])
            values.append((base + to[~narrow]) * width)
            tables.append(table.astype(np.int32))
            self.roots.append(base * width)
            base += states
        if base * width > _PLACE:
            raise ValueError(f"{len(self.languages)} languages have {base} states; places of at most {_PLACE // width} fit the table")
        self.table = np.concatenate(tables).ravel() if tables else np.zeros(0, np.int32)
        every, to = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (keys, values))
        order = np.argsort(every)
        self.keys = np.append(every[order], np.iinfo(np.int64).max)
        self.values = np.append(to[order], 0).astype(np.int32)

    def _sparse(self, place: np.ndarray, symbol: np.ndarray, root: np.ndarray) -> np.ndarray:
        """What the table would hold for symbols beyond its width."""

        def found(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = at.astype(np.int64) // self.width * self.size + symbol
            k = np.searchsorted(self.keys, key)
            return self.keys[k] == key, self.values[k]

        (hit, to), (begins, first) = found(place), found(root)
        restart = np.where(begins, first, root | (1 << _COUNT)) + np.where(place == root, 0, 1 << _COUNT)
        return np.where(hit, to, restart).astype(np.int32)

    def codes(self, text: str) -> np.ndarray:
        """Symbols of a text: lower-case letters, and one space for each run of anything else."""
        code = self.symbol[folded(text)]
        if len(code) > 1:
            code = code[np.concatenate([[True], (code[1:] != SPACE) | (code[:-1] != SPACE)])]
        return code

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """texts x languages: the number of phrases."""
        owner, blocks = [], []
        for k, code in enumerate(texts):
            for at in range(0, len(code), BLOCK):
                owner.append(k)
                blocks.append(code[at : at + BLOCK])
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        if not blocks:
            return out
        sizes = np.array([len(b) for b in blocks])
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        padded = np.zeros((len(blocks), sizes[0]), np.int32)
        for row, k in enumerate(order):
            padded[row, : sizes[row]] = blocks[k]
        steps = np.ascontiguousarray(padded.T)
        beyond = steps >= self.width
        some_beyond = beyond.any(axis=1).tolist()
        dense = np.where(beyond, RARE, steps) if any(some_beyond) else steps
        roots = np.array(self.roots, np.int32)[:, None]
        active = len(blocks) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), "right")
        place = np.repeat(np.array(self.roots, np.int32)[:, None], len(blocks), axis=1)
        count = np.zeros_like(place)
        for k, n in enumerate(active.tolist()):
            moved = self.table.take(place[:, :n] + dense[k, :n])
            if some_beyond[k]:
                at = np.flatnonzero(beyond[k, :n])
                moved[:, at] = self._sparse(place[:, at], steps[k, at], roots)
            count[:, :n] += moved >> _COUNT
            np.bitwise_and(moved, _PLACE, out=place[:, :n])
        count += place != np.array(self.roots, np.int32)[:, None]
        np.add.at(out, np.array(owner)[order], count.T)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each text. The score is the winner's share of 2^(-entropy x letters, 32 at most), so between 1/languages and 1."""
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        if not self.languages:
            return names, scores
        lo = 0
        while lo < len(texts):
            rows, some, size = [], [], 0
            while lo < len(texts) and size < BATCH_SYMBOLS:
                code = self.codes(texts[lo] or "")
                if code.any():
                    rows.append(lo)
                    some.append(code)
                    size += len(code)
                lo += 1
            length = np.array([len(c) for c in some])[:, None]
            entropy = self.phrases(some) * np.array(self.bits) / np.maximum(length, 1)
            best = entropy.argmin(axis=1) if rows else []
            worse = entropy - entropy.min(axis=1, keepdims=True) if rows else entropy
            share = 1 / np.exp2(-worse * np.minimum(length, 32)).sum(axis=1)
            for row, k, s in zip(rows, best, share.tolist(), strict=True):
                names[row], scores[row] = self.languages[k], s
        return names, scores


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """crc32(doc_id as text) mod folds is fold; a row without a doc_id is not held out (and not learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, train: Column, max_languages: int | None = None, sample_rows: int = SAMPLE_ROWS) -> CrossParser:
    """Learn from the rows where ``train`` holds, of all languages (or the ``max_languages`` most frequent): of each language the ``sample_rows`` rows that come first by a hash of doc_id, ROW_CHARS characters of each.

    Labels may be wrong: the sample is parsed against the first automata, rows that another language explains better are dropped (unless a language would
    lose over half), and the automata are built anew.

    Rows that are null in doc_id or lang teach nothing; a null or empty text adds nothing to its language's sample. Of rows that repeat a doc_id and a label, the piece that is first in
    text order counts. An empty or unlabelled table gives a parser without languages. Of other columns only those that ``train`` names are read.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_of(docs).alias("text"), train.alias("train")).where("train and lang is not null and doc_id is not null")
    counts = slim.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    languages = [r["lang"] for r in (counts if max_languages is None else counts.limit(max_languages)).collect()]
    if not languages:
        return CrossParser({})
    hashed = F.xxhash64("doc_id")
    first = (
        slim.where(F.col("lang").isin(languages))
        .select("doc_id", "lang")
        .withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(hashed, "doc_id")))
        .where(F.col("place") <= sample_rows)
        .select("doc_id", "lang")
    )
    wanted = spark.createDataFrame(first.distinct().collect(), "doc_id long, lang string")  # at most languages x sample_rows rows
    room = F.greatest(F.lit(1), F.char_length("text") - ROW_CHARS + 1)
    piece = F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), room) + 1).cast("int"), F.lit(ROW_CHARS))
    taken = slim.join(F.broadcast(wanted), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min(piece).alias("piece")).collect()
    rows = sorted((r["lang"], r["doc_id"], r["piece"]) for r in taken)
    samples: dict[str, list[str]] = {k: [] for k in languages}
    for lang, _, text in rows:
        samples[lang].append(text)
    guesses, _ = CrossParser(samples).predict([text for _, _, text in rows])
    clean: dict[str, list[str]] = {k: [] for k in languages}
    for (lang, _, text), guess in zip(rows, guesses, strict=True):
        if guess == lang:
            clean[lang].append(text)
    return CrossParser({k: clean[k] if 2 * len(clean[k]) >= len(samples[k]) else samples[k] for k in languages})


def language(spark: SparkSession, parser: CrossParser, text: Column) -> Column:
    """struct(lang_pred string, score double) of a text column.

    A null text, or one without letters, is ``und`` with score 0; so is every text if nothing was learned. Only the text reaches
    Python. The model is broadcast; its size is bounded by the module's limits for each labelled language, whatever the corpus.
    """
    model = spark.sparkContext.broadcast(parser)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predicted(texts: pa.Array) -> pa.Array:
        drop_caches_of_others(__name__)
        names, scores = [], []
        for lo in range(0, len(texts), SLICE_ROWS):
            some = model.value.predict(texts[lo : lo + SLICE_ROWS].to_pylist())
            names += some[0]
            scores += some[1]
        give_back()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predicted(text.cast("string"))


def identify(docs: DataFrame, parser: CrossParser, columns: list[str]) -> DataFrame:
    """``columns`` of the rows, with lang_pred and score (see ``language``).

    One row per input row, repeated ones too, in any length of text; an empty table gives none. If several languages need equally little, the one that is
    first in alphabetical order wins. Columns that aren't asked for are not read, whatever their names.
    """
    found = language(docs.sparkSession, parser, F.col("text"))
    return docs.select(*columns, found.alias("found")).select(*columns, "found.lang_pred", "found.score")
