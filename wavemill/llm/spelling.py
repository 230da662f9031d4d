"""Operator 11: spelling variants, by a self-join of the vocabulary's trie at distance one.

Words are counted in the tasks that read the texts, and only their counts are shuffled. The vocabulary is the trie, and its tasks are subtries, one per prefix. Down the trie go the nodes, each
with the set of nodes that are active for it: those whose text is one edit away. A node x makes new ones active from its children: x+c for x+e (a replacement) and x for x+c (a deletion; of
a run of equal letters only the first is deleted, so that every pair has one derivation). From there the distance is used up, so both nodes go on to their children of equal letters, and the pair
is near if both end in a word. All nodes of a level are moved on together, as arrays.

The edits above a task's prefix cross from one subtrie to another. There what is left of both words must be equal, so the two meet under the word without its edited letter: a key that at most one word for
each letter has, and the word without it. A prefix that more than GROUP_WORDS words share is not given to one task: its own level is done by such keys too, and its children are the next tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import arrow_rows, lean, materialise, text_of

#: Depth of the first tasks' prefixes; words, and letters in more than FEW_WORDS words, that one task takes of a prefix.
DEPTH, GROUP_WORDS, GROUP_LETTERS, FEW_WORDS = 2, 100_000, 1 << 22, 1024
#: Different words and their letters that a counting task holds, and texts in an Arrow batch.
HELD_WORDS, HELD_LETTERS, BATCH_ROWS = 200_000, 1 << 22, 500
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RUN = re.compile("[a-zÀ-ÿ]+")
NEAR = "word string, n_near long, near_n long, near string"


def runs_of(doc_id: int | None, text: str, every: int) -> Iterator[tuple[str, int]]:
    """The words of a text and how often: runs of letters, lower-cased; one letter goes where ``every`` divides the crc32 of doc_id and run. Without a doc_id nothing goes."""
    base = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
    lowered = text.encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")
    for run, n in Counter(m.group() for m in _RUN.finditer(lowered)).items():
        if base is not None and (h := zlib.crc32(run.encode(), base)) % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run, n


def vocabulary(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199) -> DataFrame:
    """word, n of the words of at least ``least_length`` code points and ``least_count`` occurrences in whole texts."""

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        letters = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                for word, n in runs_of(doc_id, text.as_py(), every):
                    if len(word) >= least_length:
                        if word not in held:
                            letters += len(word)
                        held[word] += n
                        if len(held) >= HELD_WORDS or letters >= HELD_LETTERS:
                            yield flush()
                            letters = 0
        if held:
            yield flush()

    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text")).mapInArrow(counted, "word string, n long")
        return materialise(words.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count), "vocabulary")


class Level:
    """The nodes of one depth: the words [lo, hi) of each, its last letter, and where its children lie in the next level."""

    def __init__(self, lo: np.ndarray, hi: np.ndarray, letter: np.ndarray):
        self.lo, self.hi, self.letter = lo, hi, letter

    def children(self, depth: int, letters: np.ndarray, start: np.ndarray, length: np.ndarray, wanted: np.ndarray) -> Level:
        """The next level, below the ``wanted`` nodes only, in order of (parent, letter)."""
        size = np.where(wanted, self.hi - self.lo, 0)
        parent = np.repeat(np.arange(len(size)), size)
        word = np.arange(len(parent)) - np.repeat(np.cumsum(size) - size, size) + self.lo[parent]
        on = length[word] > depth
        parent, word = parent[on], word[on]
        letter = letters[start[word] + depth].astype(np.int64)
        new = np.ones(len(word), bool)
        new[1:] = (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(word)) - 1
        below = Level(word[first], word[last[: len(first)]] + 1, letter[first])
        self.begin = np.searchsorted(parent[first], np.arange(len(size)))
        self.count = np.searchsorted(parent[first], np.arange(len(size)), "right") - self.begin
        self.keys = parent[first] << 21 | letter[first]
        below.parent = parent[first]
        return below

    def ends(self, depth: int, length: np.ndarray) -> np.ndarray:
        """The word that ends in each node, or -1: the first in order, if any."""
        return np.where(length[self.lo] == depth, self.lo, -1)


def _together(p: np.ndarray, q: np.ndarray, of_p: Level, of_q: Level, below_p: Level) -> tuple[np.ndarray, np.ndarray]:
    """The children of each pair of nodes that have equal letters. below_p: the level of p's children."""
    n = of_p.count[p]
    child = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(of_p.begin[p], n)
    key = np.repeat(q, n) << 21 | below_p.letter[child]
    at = np.minimum(np.searchsorted(of_q.keys, key), max(0, len(of_q.keys) - 1))
    same = of_q.keys[at] == key if len(of_q.keys) else np.zeros(len(key), bool)
    return child[same], at[same]


def near_pairs(words: list[str], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of all pairs of the sorted, distinct words that share their first ``depth`` letters and differ by one edit after them, each pair once."""
    length = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(length) - length
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    heads = [w[:depth] for w in words]
    new = np.flatnonzero([True, *(a != b for a, b in zip(heads[1:], heads[:-1], strict=True))])
    level = Level(new, np.append(new[1:], len(words)), letters[start[new] + depth - 1].astype(np.int64) if depth else np.full(len(new), -1))
    above: Level | None = None
    none = np.zeros(0, np.int64)
    replaced, shorter = (none, none), (none, none)  # pairs of nodes of this level; of a node of this level and one of the level above
    found = [(none, none)]

    def settled(p: np.ndarray, q: np.ndarray, of_p: Level, of_q: Level, at_p: int, at_q: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of nodes with one word each are compared as texts; the others whose ends are words are near, and go on."""
        single = (of_p.hi[p] - of_p.lo[p] == 1) & (of_q.hi[q] - of_q.lo[q] == 1)
        i, j = of_p.lo[p[single]], of_q.lo[q[single]]
        ok = np.fromiter((words[a][at_p:] == words[b][at_q:] for a, b in zip(i.tolist(), j.tolist(), strict=True)), bool, len(i))
        found.append((i[ok], j[ok]))
        p, q = p[~single], q[~single]
        i, j = of_p.ends(at_p, length)[p], of_q.ends(at_q, length)[q]
        both = (i >= 0) & (j >= 0)
        found.append((i[both], j[both]))
        return p, q

    while len(level.lo):
        wide = level.hi - level.lo > 1
        wanted = wide.copy()
        for nodes in (*replaced, shorter[0]):
            wanted[nodes] = True
        if above is not None:  # these may be the shorter side of the next level's pairs
            wanted |= np.isin(level.parent, shorter[1])
        below = level.children(depth, letters, start, length, wanted)
        deletions = np.flatnonzero(wide[below.parent] & (below.letter != level.letter[below.parent]))
        siblings = np.flatnonzero(wide[below.parent])
        left = (level.begin + level.count)[below.parent[siblings]] - siblings - 1  # siblings after each one
        p = np.repeat(siblings, left)
        q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(left) - left, left)
        more = _together(*replaced, level, level, below)
        replaced = settled(np.concatenate([p, more[0]]), np.concatenate([q, more[1]]), below, below, depth + 1, depth + 1)
        more = _together(*shorter, level, above, below) if above is not None else (none, none)
        shorter = settled(np.concatenate([deletions, more[0]]), np.concatenate([below.parent[deletions], more[1]]), below, level, depth + 1, depth)
        above, level, depth = level, below, depth + 1
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def _within(words: DataFrame, depth: int) -> DataFrame:
    """NEAR of the pairs within each subtrie of the rows (word, n, prefix), for each word and task."""

    def joined(rows: list[tuple[str, int]]) -> pa.RecordBatch:
        names, n = [w for w, _ in rows], np.array([c for _, c in rows], np.int64)
        i, j = near_pairs(names, depth)
        a, b = np.concatenate([i, j]), np.concatenate([j, i])
        order = np.lexsort((b, -n[b], a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else a
        count, best = np.diff(np.append(first, len(a))), b[first]
        return pa.RecordBatch.from_arrays([pa.array([names[k] for k in a[first]], pa.string()), pa.array(count, pa.int64()), pa.array(n[best]), pa.array([names[k] for k in best], pa.string())], ["word", "n_near", "near_n", "near"])

    @lean
    def joined_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, int]] = []
        prefix, size = None, 0
        for batch in batches:
            for head, word, n in zip(*(batch.column(c).to_pylist() for c in ("prefix", "word", "n")), strict=True):
                if head != prefix and (len(held) >= GROUP_WORDS // 4 or size >= GROUP_LETTERS // 4):  # several small subtries at once
                    yield joined(held)
                    held, size = [], 0
                prefix = head
                held.append((word, n))
                size += len(word)
        if held:
            yield joined(held)

    return words.repartition("prefix").sortWithinPartitions("prefix", "word").select("prefix", "word", "n").mapInArrow(joined_tasks, NEAR)


def _across(words: DataFrame, depth: int) -> DataFrame:
    """NEAR of the pairs of the rows (word, n) whose edit is the letter at ``depth``: they meet under the word without it, at most one word for each letter and the word itself."""
    letter = lambda at: F.substring("word", at + 1, 1)
    cut = F.concat(F.substring("word", 1, depth), F.expr(f"substring(word, {depth + 2})"))
    first = F.lit(True) if depth == 0 else letter(depth) != letter(depth - 1)
    one = F.struct((-F.col("n")).alias("low"), "word", first.alias("first"))
    longer = words.where(F.char_length("word") > depth).select(cut.alias("key"), one.alias("cut"), F.lit(None).cast("struct<low: bigint, word: string>").alias("whole"))
    whole = words.select(F.col("word").alias("key"), F.lit(None).cast("struct<low: bigint, word: string, first: boolean>").alias("cut"), F.struct((-F.col("n")).alias("low"), "word").alias("whole"))
    met = longer.unionByName(whole).groupBy("key").agg(F.sort_array(F.collect_list("cut")).alias("cuts"), F.max("whole").alias("whole"))
    met = met.where((F.size("cuts") > 1) | ((F.size("cuts") > 0) & F.col("whole").isNotNull()))
    plain = lambda x: F.struct(x["low"].alias("low"), x["word"].alias("word"))
    other = F.transform(F.filter("cuts", lambda x: x["word"] != F.col("one.word")), plain)
    near_of_cut = F.when(F.col("one.first") & F.col("whole").isNotNull(), F.sort_array(F.concat(other, F.array("whole")))).otherwise(other)
    of_cuts = met.select("cuts", "whole", F.explode("cuts").alias("one")).select(F.col("one.word").alias("word"), near_of_cut.alias("near"))
    of_whole = met.where("whole is not null").select(F.col("whole.word").alias("word"), F.transform(F.filter("cuts", lambda x: x["first"]), plain).alias("near"))
    both = of_cuts.unionByName(of_whole).where(F.size("near") > 0)
    return both.select("word", F.size("near").cast("long").alias("n_near"), (-F.col("near")[0]["low"]).alias("near_n"), F.col("near")[0]["word"].alias("near"))


def neighbours(words: DataFrame) -> DataFrame:
    """NEAR of each of the rows (word, n; words distinct) that has a word at distance one: how many, and the most frequent of them (of equal ones the first in code-point order)."""
    found, depth = [], 0
    while True:
        if depth >= DEPTH:
            words = words.where(F.char_length("word") >= depth).withColumn("prefix", F.substring("word", 1, depth))
            sizes = words.groupBy("prefix").agg(F.count(F.lit(1)).alias("words"), F.sum(F.char_length("word")).alias("letters"))
            large = sizes.where((F.col("words") > GROUP_WORDS) | ((F.col("words") > FEW_WORDS) & (F.col("letters") > GROUP_LETTERS))).select("prefix")
            found.append(_within(words.join(large, "prefix", "left_anti"), depth))
            words = words.join(large, "prefix", "left_semi").select("word", "n")
            if large.limit(1).count() == 0:
                break
            words = materialise(words, "large")
        found.append(_across(words, depth))
        depth += 1
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = F.min(F.struct((-F.col("near_n")).alias("low"), "near"))
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.low")).alias("near_n"), "best.near")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of the rows (word, form): the end of the chain of forms. Counts grow from form to form, so there is no circle; each round doubles the reach."""
    left = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = materialise(left.join(left.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        left = step.select("word", "root")
        if step.where("moved").limit(1).count() == 0:
            return left


def variants(docs: DataFrame, least_length: int = 6, least_count: int = 5, every: int = 199, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the vocabulary of whole texts (see ``vocabulary``).

    Near words differ by one inserted, deleted or replaced code point. form is the near word of the largest n (of equal ones the first in code-point order) if that is at least ``ratio``
    times the word's own, else null, as form_n; root is where the chain of forms ends, the word itself if it has none. A null text has no words; repeated rows count each; rows without a doc_id lose no letter.
    An empty table has no words. Other columns are not read, whatever their names.
    """
    words = vocabulary(docs, least_length, least_count, every)
    known = F.col("near_n") >= ratio * F.col("n")
    table = words.join(neighbours(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(known, F.col("near")).alias("form"), F.when(known, F.col("near_n")).alias("form_n"))
    table = materialise(table, "forms")
    roots = _roots(table.where("form is not null"))
    return table.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
