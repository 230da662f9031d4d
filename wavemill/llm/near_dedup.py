"""Operator 9: near-duplicates by DartMinHash.

A document is a weighted set of five-word shingles, the weight being the number of occurrences; similarity is weighted Jaccard
(so plain Jaccard where no shingle repeats). Its weight is laid out in unit regions, one per occurrence of each shingle. Into
each region darts fall as a Poisson process over ranks that a hash of the region seeds: equal regions get equal darts in every document. Only
darts of rank below about (k ln k + 2k) / weight are ever drawn, so a document costs its length plus some
k ln k steps, not k steps for each shingle. Each dart hits one of k coordinates, and the earliest dart of each
coordinate is the signature: two documents agree on a coordinate with a probability of their similarity.

Signatures are cut into bands. Whole texts with equal words are one node. Candidates come from buckets, texts that share a band, in steps that are linear in a
bucket's members: first each node meets the likeliest of its buckets' smallest nodes, and verified links join components. Of buckets that still hold several components, those of
at most SMALL members are compared pair by pair, by signature and then by shingles; in larger ones each member meets one of two leaders drawn by hash, of another component. What is then still apart goes to an exact join by
rare shingles. Overlap with another component is at most the number of shingles that other components hold too, so a text of which they hold less than
the threshold's share is done: unlike texts with a common passage leave here, without being compared. The others are listed under the rarest of their shared shingles, as
many as any similar pair must have one in common of, and entries of a list are compared by size, place and signature: first each entry proposes its likeliest partner, and then all candidates that are still apart are
verified by their shingles.
No pair that meets in a bucket goes untested unless it is in one component already or can't reach the threshold. Classes are the connected components of verified links.

With 24 bands of 5, a pair at the threshold meets with probability 0.99993. The signature's filter lets pairs through down to five standard
deviations under the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import arrow_rows, lean, materialise, shared_dir, SideTable, spread_join, stored, text_of, with_rows
from wavemill.llm.perfect_hash import mix

WORDS, THRESHOLD, BANDS, BAND_ROWS = 5, 0.8, 24, 5
SIGNATURES = "doc_id long, part long, pos long, uid long, copy string, size long, bands array<long>, sig binary"
#: Members of an unresolved bucket that are compared pair by pair; larger buckets are left to leaders and the exact join.
SMALL = 16
#: Shingles of a chunk of texts in the exact join; entries of a list in a block; texts of a group that are compared as a matrix, shingles of a text that has a group of its own, columns of a matrix, and
#: pairs a text from which groups are worth it.
CHUNK_CELLS, WINDOW, GROUP, HEAVY, COLUMNS, DENSE = 1 << 17, 256, 128, 1 << 14, 2048, 8
CHUNKS = "uids binary, labels binary, sizes binary, cells binary"
ENTRIES = "token long, uid long, size long, pos long"
PAIRS = "a long, b long, size_a long, size_b long"
#: Texts or pairs of shingle sets that a Python worker holds at once.
BATCH_ROWS = 1000
_GAP = bytes.maketrans(bytes(c for c in range(128) if not chr(c).isalnum()), b" " * sum(not chr(c).isalnum() for c in range(128)))
_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * i + 1)) & (2**64 - 1)) for i in range(64)]


def words_of(text: str) -> list[bytes]:
    """Lower-case words: runs of anything but ASCII signs and white space."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_GAP).split()


def regions(words: list[bytes], width: int = WORDS) -> np.ndarray:
    """Sorted 64-bit names of a text's unit regions: each shingle hash mixed with the number of its occurrence. A text of fewer words than ``width`` is one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(ids) - width + 1)
    with np.errstate(over="ignore"):
        shingle = np.zeros(n, np.uint64)
        for i in range(min(width, len(ids))):
            shingle += mix(ids[i : i + n], i) * _ODD[i]
        shingle = np.sort(mix(shingle, min(width, len(ids))))
        new = np.concatenate([[True], shingle[1:] != shingle[:-1]])
        if not new.all():
            nth = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
            shingle = np.sort(shingle + nth.astype(np.uint64) * _ODD[63])
    return shingle


def dart_minhash(sets: list[np.ndarray], k: int) -> np.ndarray:
    """Signatures (sets x k, 64-bit) of non-empty sets of unit regions."""
    out, rank = np.zeros((len(sets), k), np.uint64), np.full((len(sets), k), np.inf)
    sizes = np.array([len(s) for s in sets])
    reach, todo = (k * np.log(k) + 2 * k) / np.maximum(1, sizes), np.arange(len(sets))
    while len(todo):
        owner = np.repeat(todo, sizes[todo])
        state = np.concatenate([sets[i] for i in todo])
        at = np.zeros(len(owner))
        while len(owner):
            state = mix(state, 1)
            at = at - np.log(((state >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))
            near = at < reach[owner]
            owner, state, at = owner[near], state[near], at[near]
            dart = mix(state, 2)
            cell = owner * k + (dart % np.uint64(k)).astype(np.int64)
            flat = rank.ravel()
            np.minimum.at(flat, cell, at)
            first = flat[cell] == at
            out.ravel()[cell[first]] = dart[first]
        todo = todo[np.isinf(rank[todo]).any(axis=1)]
        reach[todo] *= 2  # a coordinate that no dart has hit: throw further
    return out


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = BAND_ROWS, width: int = WORDS) -> DataFrame:
    """One row per document of a frame (doc_id, text, part, pos, uid); size is the number of regions, bands and sig are null for texts without words."""
    k = bands * rows

    @lean
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for lo in range(0, len(texts), 256):
                copies, sets = [], []
                for text in texts[lo : lo + 256]:
                    words = words_of(text.as_py())
                    copies.append(xxhash.xxh3_128_hexdigest(b" ".join(words)))
                    sets.append(regions(words, width))
                some = [i for i, s in enumerate(sets) if len(s)]
                sig = dart_minhash([sets[i] for i in some], k)
                with np.errstate(over="ignore"):
                    key = np.zeros((len(some), bands), np.uint64)
                    for r in range(rows):
                        key = mix(key + sig[:, r::rows], r)
                    key = mix(key + np.arange(bands, dtype=np.uint64), 77).view(np.int64)
                low = (sig & np.uint64(255)).astype(np.uint8)
                at = {i: n for n, i in enumerate(some)}
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c)[lo : lo + 256] for c in ("doc_id", "part", "pos", "uid")),
                        pa.array(copies),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([key[at[i]] if i in at else None for i in range(len(sets))], pa.list_(pa.int64())),
                        pa.array([low[at[i]].tobytes() if i in at else None for i in range(len(sets))], pa.binary()),
                    ],
                    ["doc_id", "part", "pos", "uid", "copy", "size", "bands", "sig"],
                )

    return docs.select("doc_id", "part", "pos", "uid", "text").mapInArrow(signed, SIGNATURES)


def overlap(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Is the similarity of two sorted, non-empty sets of regions at least ``threshold``?"""
    if len(x) > len(y):
        x, y = y, x
    if len(x) < threshold * len(y) - 1e-9:
        return False
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return common >= threshold * (len(x) + len(y) - common) - 1e-9


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least ``threshold``. sets: uid, cells (binary, sorted)."""

    @lean
    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                keep.append(overlap(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), threshold))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(sets.select(F.col("uid").alias("b"), F.col("cells").alias("y")), "b")
    both = with_b.join(sets.select(F.col("uid").alias("a"), F.col("cells").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInArrow(compared, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """uid, label: one label, a uid of its own, for each connected component. edges: a, b; only nodes with an edge are listed.

    Rounds of contraction: each node goes to the first of itself and its neighbours, edges follow, and those within a node vanish, so the
    graph shrinks by a factor a round. First is by uid in the first two rounds, which settles stars around their smallest node, and then by a hash of the round,
    which leaves no order that could make a long chain. Each round is a table in the shared folder; hubs are reduced before the shuffle.
    """
    spark, folder = edges.sparkSession, shared_dir(edges.sparkSession, "components")
    pair, moves = "a long, b long", []
    edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().write.parquet(f"{folder}/edges0")
    left = stored(spark, f"{folder}/edges0", pair)
    while left.limit(1).count() or not moves:
        step = len(moves)
        order = F.lit(0).cast("long") if step < 2 else F.xxhash64("b", F.lit(step))
        both = left.union(left.select("b", "a"))
        near = both.union(left.select("a", F.col("a").alias("b"))).union(left.select("b", F.col("b").alias("a")))
        to = near.groupBy("a").agg(F.min(F.struct(order.alias("order"), "b"))["b"].alias("to"))
        to.select(F.col("a").alias("uid"), F.col("to").alias("label")).write.parquet(f"{folder}/moves{step}")
        moves.append(stored(spark, f"{folder}/moves{step}", "uid long, label long"))
        move = moves[-1]
        moved = left.join(move.select(F.col("uid").alias("a"), F.col("label").alias("x")), "a").join(move.select(F.col("uid").alias("b"), F.col("label").alias("y")), "b")
        moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().write.parquet(f"{folder}/edges{step + 1}")
        left = stored(spark, f"{folder}/edges{step + 1}", pair)
    found = moves[-1]
    for move in moves[-2::-1]:
        later = found.select(F.col("uid").alias("label"), F.col("label").alias("last"))
        found = move.join(later, "label", "left").select("uid", F.coalesce("last", "label").alias("label"))
    return materialise(found, "labels")


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, width: int = WORDS, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept, and part and pos, the row's identity (``with_rows``).

    class_id is the smallest doc_id of the class, and that row stays; rows without a doc_id come after all others, and among rows with the same
    doc_id the first of the input stays. Texts with equal words are one class, so all texts without words (null, empty, signs only) are one class too. A text of fewer
    than ``width`` words is one shingle. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    source = with_rows(docs.select("doc_id", "text"))
    source = source.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(source).alias("text"), F.col("_row_part").alias("part"), F.col("_row_pos").alias("pos"))
    with arrow_rows(spark, BATCH_ROWS):
        rows_of = _labelled(source, threshold, width, bands, rows)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid"))
    classes = rows_of.groupBy("label").agg(first.alias("first"), F.count(F.lit(1)).alias("class_size"))
    return spread_join(rows_of, classes, "label", "task").select("doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("uid") == F.col("first.uid")).alias("kept"), "part", "pos")


def _labelled(source: DataFrame, threshold: float, width: int, bands: int, rows: int) -> DataFrame:
    """The rows (doc_id, part, pos, uid, task) of a frame (doc_id, text, part, pos) with a label for each class."""
    spark = source.sparkSession
    folder = shared_dir(spark, "near")
    k, least = bands * rows, bands * rows * threshold - 5 * (bands * rows * threshold * (1 - threshold)) ** 0.5
    signatures(source.withColumn("uid", F.monotonically_increasing_id()), bands, rows, width).write.parquet(f"{folder}/signed")
    signed = stored(spark, f"{folder}/signed", SIGNATURES)

    task = F.shiftright("uid", 33)  # the task that has numbered the row: no hot key holds more of one task's rows than the task had
    copies = signed.groupBy("copy").agg(F.min("uid").alias("uid"))
    nodes = materialise(signed.join(copies.select("uid"), "uid", "left_semi").where("size > 0").select("uid", "part", "pos", "bands", "sig"), "nodes")
    members = nodes.select("uid", task.alias("task"), F.explode("bands").alias("band"))
    buckets = members.groupBy("band").agg(F.min("uid").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = materialise(spread_join(members, buckets, "band", "task"), "buckets")  # only buckets of two or more, so most bands are gone

    hopeful = materialise(_likeliest(shared.where("a != uid").select("a", F.col("uid").alias("b")), nodes, k, least), "stars")
    cells = _cells(source, nodes.join(_ends(hopeful), "uid", "left_semi"), f"{folder}/first", width)
    links = materialise(similar(hopeful, cells, threshold), "links")
    labels = _merged(shared.select("uid", "task").distinct().withColumn("label", F.col("uid")), links)

    apart = materialise(_apart(shared.drop("a"), labels), "apart")
    if apart.limit(1).count():
        large = apart.where(F.col("n") > SMALL)
        met = materialise(_rated(_small_pairs(apart), nodes, k, least).select("a", "b").union(_likeliest(_leaders(large), nodes, k, least)).distinct(), "met")
        missing = _ends(met).union(large.select("uid")).distinct().join(cells.select("uid"), "uid", "left_anti")
        cells = cells.unionByName(_cells(source, nodes.join(missing, "uid", "left_semi"), f"{folder}/second", width))
        labels = _merged(labels, materialise(similar(met, cells, threshold), "links"))
        left = materialise(_apart(large.drop("label", "n"), labels).select("uid", "label").distinct(), "left")
        if left.limit(1).count():
            labels = _by_rare_shingles(left, cells, labels, nodes, k, least, threshold)

    label = copies.join(labels.select("uid", "label"), "uid", "left").select("copy", F.coalesce("label", "uid").alias("label"))
    rows_of = spread_join(signed.select("doc_id", "part", "pos", "uid", "copy", task.alias("task")), label, "copy", "task").drop("copy")
    return materialise(rows_of, "labelled")


def _bytes(binaries: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(binaries.to_pylist()), np.uint8).reshape(len(binaries), width)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct()


def _rated(pairs: DataFrame, nodes: DataFrame, k: int, least: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree in ``least`` coordinates at least, and in how many."""

    @F.arrow_udf("int")
    def agreeing(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array((_bytes(left, k) == _bytes(right, k)).sum(axis=1), pa.int32())

    of = lambda end: nodes.select(F.col("uid").alias(end), F.col("sig").alias(f"sig_{end}"))
    rated = spread_join(pairs.distinct().join(of("b"), "b").withColumn("task", F.shiftright("b", 33)), of("a"), "a", "task")
    return rated.select("a", "b", agreeing("sig_a", "sig_b").alias("agree")).where(F.col("agree") >= least)


def _likeliest(pairs: DataFrame, nodes: DataFrame, k: int, least: float) -> DataFrame:
    """Of each b the pair (a, b) whose signatures agree most, in ``least`` coordinates at least."""
    best = _rated(pairs, nodes, k, least).groupBy("b").agg(F.max(F.struct("agree", (-F.col("a")).alias("low"))).alias("best"))
    return best.select((-F.col("best.low")).alias("a"), "b")


def _small_pairs(apart: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components of the small buckets, SMALL / 2 of a member at most."""
    groups = apart.where(F.col("n") <= SMALL).groupBy("band").agg(F.collect_list(F.struct("uid", "label")).alias("group"))
    pairs = F.flatten(F.transform("group", lambda x: F.transform(F.filter("group", lambda y: (x["uid"] < y["uid"]) & (x["label"] != y["label"])), lambda y: F.struct(x["uid"].alias("a"), y["uid"].alias("b")))))
    return groups.select(F.explode(pairs).alias("pair")).select("pair.a", "pair.b").distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (uid, task, label: a uid of the component) after more links (a, b) between its uids."""
    own = lambda name: labels.select(F.col("uid").alias(name), F.col("label").alias(f"label_{name}"))
    joined = spread_join(links.withColumn("task", F.shiftright("b", 33)), own("a"), "a", "task").join(own("b"), "b")
    found = components(joined.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")))
    moved = spread_join(labels, found.select(F.col("uid").alias("label"), F.col("label").alias("to")), "label", "task", "left")
    return materialise(moved.select("uid", "task", F.coalesce("to", "label").alias("label")), "labels")


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Of the rows (uid, task, band) those of buckets that hold several components, with their label and the bucket's size n."""
    own = members.join(labels.select("uid", "label"), "uid")
    split = own.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("band", "n")
    return spread_join(own, split, "band", "task").select("uid", "task", "band", "label", "n")


def _leaders(apart: DataFrame) -> DataFrame:
    """Pairs (a, b): each member b of a bucket and that of two members drawn by hash that is of another component, the first of them if both are."""
    drawn = F.struct(F.xxhash64("uid").alias("order"), "uid", "label")
    leaders = apart.groupBy("band").agg(F.min(drawn).alias("first"), F.max(drawn).alias("last"))
    met = spread_join(apart, leaders, "band", "task")
    other = F.when(F.col("label") != F.col("first.label"), F.col("first.uid")).when(F.col("label") != F.col("last.label"), F.col("last.uid"))
    return met.select(other.alias("a"), F.col("uid").alias("b")).where("a is not null")


def _by_rare_shingles(apart: DataFrame, cells: DataFrame, labels: DataFrame, nodes: DataFrame, k: int, least: float, threshold: float) -> DataFrame:
    """``labels`` after every similar pair of different components among ``apart`` (uid, label) has been linked.

    Shingles are ordered: first those of one component alone, then by how many chunks of these texts hold them. Two similar texts of sizes n and m share at least t/(1+t) (n+m)
    shingles, so the first that they share, at places i and j of theirs, leaves as many behind it in both: i <= (1-t) n, and
    min(n-i, m-j) reaches that bound.

    Candidates must agree in ``least`` coordinates of their signatures. First each entry of a block proposes one partner, the likeliest of another component, which joins most of what is similar in as many pairs as
    there are entries. Then all candidates of components that are still apart are verified: those that stand less than WINDOW places apart in a list, and, of longer lists, block against block, unless
    both hold one and the same component.
    """
    entries = _entries(apart, cells, threshold)
    lengths = entries.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    line = materialise(_line(entries, "token", "size", "uid").select("token", "uid", "size", "pos", "place"), "places")
    known = lambda labels: labels.select("uid", "label").join(nodes.select("uid", "sig"), "uid")
    labels = _linked(_candidates(line, known(labels), least, threshold, True), labels, cells, threshold)
    pairs = _candidates(line, known(labels), least, threshold, False)
    long = materialise(lengths.where(F.col("n") > WINDOW).select("token"), "long")
    if long.limit(1).count():
        own = entries.join(long, "token").join(known(labels), "uid")
        blocks = materialise(_line(own, "token", "label", "size", "uid").withColumn("block", F.expr(f"place div {WINDOW}")), "blocks")
        pairs = pairs.union(_between_blocks(blocks, least, threshold))
    return _linked(pairs, labels, cells, threshold)


def _line(entries: DataFrame, *order: str) -> DataFrame:
    """The entries with their place in the given order of all, from 0."""
    line = entries.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    line = materialise(line, "line").withColumn("range", F.shiftright("id", 33))
    sizes = sorted((r["range"], r["count"]) for r in line.groupBy("range").count().collect())  # one row per partition
    bases = [(part, sum(n for _, n in sizes[:i]) - (part << 33)) for i, (part, _) in enumerate(sizes)]
    return line.join(F.broadcast(entries.sparkSession.createDataFrame(bases, "range long, base long")), "range").withColumn("place", F.col("id") + F.col("base"))


def _linked(pairs: DataFrame, labels: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """``labels`` after those of the candidate pairs (PAIRS) have been linked that are similar."""
    likely = materialise(pairs.distinct(), "likely")
    n = likely.count()
    if not n:
        return labels
    with arrow_rows(pairs.sparkSession, BATCH_ROWS):
        return _merged(labels, materialise(_verified(likely, n, cells, threshold), "links"))


def _alike(rows: pa.Table, i: np.ndarray, j: np.ndarray, least: float, best: bool) -> pa.Table:
    """PAIRS of the rows (uid, size, sig) at places i and j whose signatures agree in ``least`` coordinates at least; with ``best``, of each row's pairs only the one that agrees most (then of the smallest uid)."""
    uid, size = rows["uid"].to_numpy(), rows["size"].to_numpy()
    sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint8).reshape(len(uid), -1)
    agree = np.concatenate([np.zeros(0, np.int64), *((sig[i[lo : lo + 8192]] == sig[j[lo : lo + 8192]]).sum(axis=1) for lo in range(0, len(i), 8192))])
    ok = agree >= least
    i, j, agree = i[ok], j[ok], agree[ok]
    if best:
        one, other, both = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([agree, agree])
        order = np.lexsort((uid[other], -both, one))
        first = order[np.append(True, one[order][1:] != one[order][:-1])] if len(order) else order
        i, j = one[first], other[first]
    swap = uid[i] > uid[j]
    a, b = np.where(swap, j, i), np.where(swap, i, j)
    found = np.unique(np.stack([uid[a], uid[b], size[a], size[b]]), axis=1) if len(a) else np.zeros((4, 0), np.int64)
    return pa.table(dict(zip(("a", "b", "size_a", "size_b"), map(pa.array, found), strict=True)))


def _verified(pairs: DataFrame, n: int, cells: DataFrame, threshold: float) -> DataFrame:
    """``similar`` of the ``n`` pairs (a, b, size_a, size_b) where texts may have very many of them: they are dealt into groups, and the sets of two groups are compared as one product of matrices, so a set is
    sent once for a group of partners."""
    ends = pairs.agg(F.approx_count_distinct("a"), F.approx_count_distinct("b")).first()
    texts = max(1, ends[0], ends[1])
    if n < DENSE * texts:
        return similar(pairs.select("a", "b"), cells, threshold)
    slot = lambda end: F.when(F.col(f"size_{end}") > HEAVY, F.xxhash64(end)).otherwise(F.pmod(F.xxhash64(end), F.lit(-(-texts // GROUP))))
    met = pairs.select("a", "b", F.least(slot("a"), slot("b")).alias("low"), F.greatest(slot("a"), slot("b")).alias("high"))
    of = lambda end: met.select(F.col(end).alias("uid"), F.col("low").alias("first"), F.col("high").alias("second"))
    sets = of("a").union(of("b")).distinct().join(cells, "uid").select("first", "second", "uid", "cells")

    def compared(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        uid = sets["uid"].to_numpy()
        order = np.argsort(uid)
        held = [np.frombuffer(c.as_buffer(), np.uint64) for c in sets["cells"]]
        sizes = np.array([len(x) for x in held])
        flat = np.concatenate(held) if held else np.zeros(0, np.uint64)
        at = np.argsort(flat, kind="stable")
        new = np.concatenate([[True], flat[at][1:] != flat[at][:-1]])
        column = np.cumsum(new) - 1
        shared = (np.bincount(column) > 1)[column]  # a shingle of one text adds nothing
        owner, column = np.repeat(np.arange(len(held)), sizes)[at][shared], column[shared]
        _, column = np.unique(column, return_inverse=True)
        common = np.zeros((len(held), len(held)), np.float32)
        for lo in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
            rows = slice(*np.searchsorted(column, [lo, lo + COLUMNS]))
            some = np.zeros((len(held), COLUMNS), np.float32)
            some[owner[rows], column[rows] - lo] = 1
            common += some @ some.T
        i, j = (order[np.searchsorted(uid[order], pairs[c].to_numpy())] for c in ("a", "b"))
        both = common[i, j].astype(np.float64)
        return pairs.select(["a", "b"]).filter(pa.array(both >= threshold * (sizes[i] + sizes[j] - both) - 1e-9))

    return sets.groupBy("first", "second").cogroup(met.groupBy("low", "high")).applyInArrow(compared, "a long, b long")


def _between_blocks(line: DataFrame, least: float, threshold: float) -> DataFrame:
    """PAIRS of different components in the lists of the rows (token, uid, size, pos, label, sig, block) that may be similar by size, place and signature; a task takes two blocks of a list."""
    parts = materialise(line.groupBy("token", "block").agg(F.min("label").alias("least"), F.max("label").alias("most")), "parts")
    low, high = (parts.select("token", F.col("block").alias(side), F.col("least").alias(f"least_{side}"), F.col("most").alias(f"most_{side}")) for side in ("low", "high"))
    one = (F.col("least_low") == F.col("most_low")) & (F.col("least_high") == F.col("most_high")) & (F.col("least_low") == F.col("least_high"))
    tasks = low.join(high, "token").where((F.col("low") <= F.col("high")) & ~one).select("token", "low", "high")
    rows = tasks.select("*", F.explode(F.array_distinct(F.array("low", "high"))).alias("block")).join(line, ["token", "block"])

    def pairs(rows: pa.Table) -> pa.Table:
        size, pos, label, block = (rows[c].to_numpy() for c in ("size", "pos", "label", "block"))
        behind, need = size - pos, threshold / (1 + threshold)
        x, y = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        ok = label[x][:, None] != label[y]
        ok &= np.minimum(behind[x][:, None], behind[y]) >= need * (size[x][:, None] + size[y]) - 1e-9
        i, j = np.nonzero(ok)
        return _alike(rows, x[i], y[j], least, False)

    return rows.select("token", "low", "high", "uid", "size", "pos", "label", "sig", "block").groupBy("token", "low", "high").applyInArrow(pairs, PAIRS)


def _entries(apart: DataFrame, cells: DataFrame, threshold: float) -> DataFrame:
    """token, uid, size, pos: the texts that may be similar to one of another component, under their rarest shared shingles."""
    spark = apart.sparkSession
    folder = shared_dir(spark, "rare")

    @lean
    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            row = {"uids": np.array([h[0] for h in held], np.int64), "labels": np.array([h[1] for h in held], np.int64), "sizes": np.array([len(h[2]) // 8 for h in held], np.int64)}
            row = {c: x.tobytes() for c, x in row.items()} | {"cells": b"".join(h[2] for h in held)}
            held.clear()
            return pa.RecordBatch.from_pylist([row], pa.schema([(c, pa.binary()) for c in ("uids", "labels", "sizes", "cells")]))

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("uid", "label", "cells")), strict=True):
                held.append(row)
                size += len(row[2]) // 8
                if size >= CHUNK_CELLS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    with arrow_rows(spark, BATCH_ROWS):
        apart.select("uid", "label").join(cells, "uid").select("uid", "label", "cells").mapInArrow(chunked, CHUNKS).withColumn("chunk", F.monotonically_increasing_id()).write.parquet(f"{folder}/chunks")
    chunks = stored(spark, f"{folder}/chunks", f"{CHUNKS}, chunk long")

    @lean
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat, owner = np.frombuffer(row["cells"], np.int64), np.repeat(np.frombuffer(row["labels"], np.int64), np.frombuffer(row["sizes"], np.int64))
                order = np.lexsort((owner, flat))
                flat, owner = flat[order], owner[order]
                start = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
                low, high = owner[start], owner[np.append(start[1:], len(flat)) - 1]
                several = low != high  # these give two rows
                token, label = np.concatenate([flat[start], flat[start][several]]), np.concatenate([low, high[several]])
                yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(np.full(len(token), row["chunk"])), pa.array(label)], ["token", "chunk", "label"])

    with arrow_rows(spark, 1):  # a row is a chunk
        chunks.mapInArrow(held, "token long, chunk long, label long").write.parquet(f"{folder}/held")
    each = stored(spark, f"{folder}/held", "token long, chunk long, label long")
    common = each.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low < high").select("token", "n")
    table = SideTable(f"{folder}/common").write(each.select("token", "chunk").join(common, "token").select(F.col("chunk").alias("key"), F.col("token").alias("item"), F.col("n").alias("value")))

    @lean
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat, uids, sizes = (np.frombuffer(row[c], np.int64) for c in ("cells", "uids", "sizes"))
                n, there = table.values(np.full(len(flat), row["chunk"]), flat)
                ends = np.cumsum(sizes)
                shared = np.add.reduceat(there.astype(np.int64), ends - sizes)
                out = []
                for i in np.flatnonzero(shared >= threshold * sizes - 1e-9).tolist():
                    mine = np.arange(ends[i] - sizes[i], ends[i])[there[ends[i] - sizes[i] : ends[i]]]
                    mine = mine[np.lexsort((flat[mine], n[mine]))]
                    pos = sizes[i] - shared[i] + np.arange(len(mine))
                    first = pos <= (1 - threshold) * sizes[i] + 1e-9
                    out.append((flat[mine[first]], np.full(first.sum(), uids[i]), np.full(first.sum(), sizes[i]), pos[first]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["token", "uid", "size", "pos"])

    with arrow_rows(spark, 1):
        chunks.mapInArrow(listed, ENTRIES).write.parquet(f"{folder}/entries")
    return stored(spark, f"{folder}/entries", ENTRIES)


def _candidates(line: DataFrame, known: DataFrame, least: float, threshold: float, best: bool) -> DataFrame:
    """PAIRS of different components that stand less than WINDOW places apart in one list and may be similar by size, place and signature (with ``best`` as in ``_alike``). known: uid, label, sig.

    The line of all lists is cut every WINDOW places; an entry goes to its own block and, to be met by later entries, to the next one.
    """
    own = line.join(known, "uid").withColumn("block", F.expr(f"place div {WINDOW}"))
    rows = own.withColumn("after", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("block", F.col("block") + F.col("after"))

    def pairs(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        token, size, pos, label, place, after = (rows[c].to_numpy() for c in ("token", "size", "pos", "label", "place", "after"))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        behind, need = size - pos, threshold / (1 + threshold)
        for d in range(1, min(WINDOW, len(token))):
            same = token[d:] == token[:-d]
            if not same.any():
                break
            apart = place[d:] - place[:-d]  # no smaller than d: entries of other blocks are missing only at the ends
            ok = same & (apart < WINDOW) & (after[d:] == 0) & (label[d:] != label[:-d])
            ok &= np.minimum(behind[d:], behind[:-d]) >= need * (size[d:] + size[:-d]) - 1e-9
            left.append(np.flatnonzero(ok))
            right.append(left[-1] + d)
        return _alike(rows, np.concatenate(left), np.concatenate(right), least, best)

    return rows.select("block", "token", "uid", "size", "pos", "label", "sig", "place", "after").groupBy("block").applyInArrow(pairs, PAIRS)


def _cells(source: DataFrame, wanted: DataFrame, folder: str, width: int) -> DataFrame:
    """uid, cells of the wanted nodes (uid, part, pos): a scan of the texts that lets only their rows through."""
    spark = source.sparkSession
    table = SideTable(f"{folder}-rows").write(wanted.select(F.col("part").alias("key"), F.col("pos").alias("item"), F.col("uid").alias("value")))
    rows = materialise(source.withColumn("uid", table.find(F.col("part"), F.col("pos"))).where("uid is not null").select("uid", "text"), "wanted")

    @lean
    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                cells = [regions(words_of(t.as_py()), width).tobytes() for t in batch.column("text")[lo : lo + 256]]
                yield pa.RecordBatch.from_arrays([batch.column("uid")[lo : lo + 256], pa.array(cells, pa.binary())], ["uid", "cells"])

    with arrow_rows(spark, BATCH_ROWS):
        rows.mapInArrow(taken, "uid long, cells binary").write.parquet(f"{folder}-cells")
    return stored(spark, f"{folder}-cells", "uid long, cells binary")
