"""Beam search over whole batches of utterances, and phrase lists per utterance. SURVEY ids: D10, O6, U4, D2, D4, D5.

All hypotheses of all utterances of an Arrow batch take a step together, as arrays. Utterances are in order of length, so those that still
have frames are the first ones, and the live set shrinks as short ones end; what is returned is in the order of the input. A row's result is that of ``decoding.beam`` on it alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wavemill.operators.decoding import ACTIVE_PATHS, BLANK, CONTEXT_SIZE, LM_SCALE, log_softmax

#: Scores (hypotheses x symbols) of the next symbol, given a frame and the last symbols of each hypothesis.
BatchJoiner = Callable[[np.ndarray, np.ndarray], np.ndarray]
BATCH_ROWS = 256


class PhraseArrays:
    """The automaton of a phrase list in array form: sorted keys (node, token) with the child of each, failure links, scores and outputs.

    A phrase that ends where a node already is, in this list or in ``known``, the automaton of a list that comes before it, is not marked as an end unless ``mark_prefixes``
    (and then only if it isn't an end there): so the pair of automata is worth what one automaton of both lists would be. ``lists`` are independent lists; list k starts at ``roots[k]``.
    """

    def __init__(self, lists: Sequence[Sequence[Sequence[int]]], bonus: float, mark_prefixes: bool = False, known: PhraseArrays | None = None):
        keys: dict[tuple[int, int], int] = {}
        depth, above, token_of, end, root_of = [], [], [], [], []

        def node(parent: int, token: int, root: int) -> int:
            depth.append(0 if parent < 0 else depth[parent] + 1)
            above.append(parent)
            token_of.append(token)
            end.append(False)
            root_of.append(len(depth) - 1 if root < 0 else root)
            return len(depth) - 1

        self.roots = []
        for phrases in lists:
            root = node(-1, -1, -1)
            self.roots.append(root)
            for phrase in phrases:
                at, new, elsewhere = root, False, 0 if known else -1
                for token in phrase:
                    new = (at, token) not in keys
                    if new:
                        keys[at, token] = node(at, token, root)
                    at = keys[at, token]
                    elsewhere = known.child_of(elsewhere, token) if elsewhere >= 0 else -1
                if at != root:
                    taken = known is not None and elsewhere >= 0 and (not mark_prefixes or known.is_end[elsewhere])
                    end[at] |= (new or mark_prefixes) and not taken
        fail, output, order = [-1] * len(depth), [0.0] * len(depth), sorted(range(len(depth)), key=depth.__getitem__)
        for at in order:
            if above[at] < 0:
                continue
            link = fail[above[at]]
            while link >= 0 and (link, token_of[at]) not in keys:
                link = fail[link]
            fail[at] = keys[link, token_of[at]] if link >= 0 else root_of[at]
            output[at] = (bonus * depth[at] if end[at] else 0.0) + output[fail[at]]
        items = sorted((parent << 32 | token, child) for (parent, token), child in keys.items())
        self.keys, self.child = np.array([k for k, _ in items], np.int64), np.array([c for _, c in items], np.int64)
        self.fail, self.output, self.is_end = np.array(fail, np.int64), np.array(output), np.array(end, bool)
        self.score = bonus * np.array(depth, np.float64)

    def child_of(self, node: int, token: int) -> int:
        at = int(np.searchsorted(self.keys, node << 32 | token))
        return int(self.child[at]) if at < len(self.keys) and self.keys[at] == node << 32 | token else -1

    def step(self, states: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """The states after one token each."""
        out, left = states.copy(), np.arange(len(states))
        while len(left):
            key = out[left] << 32 | tokens[left]
            at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            there = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
            out[left[there]] = self.child[at[there]]
            left = left[~there]
            left = left[self.fail[out[left]] >= 0]  # a root without the token stays where it is
            out[left] = self.fail[out[left]]
        return out


def _mixed(h: np.ndarray, token: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (h ^ (token.astype(np.uint64) + np.uint64(seed))) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(32))


def _best(flat: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k largest values of each row, largest first, ties to the first column; -1 where a row has fewer columns."""
    k_here = min(k, flat.shape[1])
    least = np.partition(flat, flat.shape[1] - k_here, axis=1)[:, flat.shape[1] - k_here]
    row, column = np.nonzero(flat >= least[:, None])
    order = np.lexsort((column, -flat[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    out = np.full((len(flat), k), -1, np.int64)
    out[row[place < k], place[place < k]] = column[place < k]
    return out


class _Beams:
    """The hypotheses of all utterances: arrays (utterance, slot), the first ``count`` slots of an utterance in use."""

    def __init__(self, n: int, paths: int, context_size: int, roots: np.ndarray):
        self.log_prob = np.full((n, paths), -np.inf)
        self.log_prob[:, 0] = 0
        self.lm, self.size, self.trace = np.zeros((n, paths)), np.zeros((n, paths), np.int64), np.full((n, paths), -1, np.int64)
        self.hash = np.zeros((2, n, paths), np.uint64)  # two of 64 bits each tell token sequences apart
        self.context = np.full((n, paths, context_size), BLANK, np.int64)
        self.state, self.own = np.zeros((n, paths), np.int64), np.repeat(roots[:, None], paths, axis=1)
        self.count = np.ones(n, np.int64)


def beam_batch(
    rows: np.ndarray, lengths: np.ndarray, joiner: BatchJoiner | None = None, graph: PhraseArrays | None = None, own: PhraseArrays | None = None,
    paths: int = ACTIVE_PATHS, context_size: int = CONTEXT_SIZE, lm: Callable[[list[np.ndarray]], np.ndarray] | None = None, lm_scale: float = LM_SCALE,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens and frames of the best hypothesis of each utterance (end to end), how many of them each has, and log_prob and lm_log_prob.

    ``rows`` are the frames of all utterances end to end, ``lengths`` how many each has. Without a joiner the frames are the logits. ``graph`` is a list of phrases for all,
    ``own`` has one list for each utterance; an utterance's boost is that of one list of both. ``lm`` maps token sequences to negative log likelihoods.
    """
    n = len(lengths)
    order = np.argsort(-lengths, kind="stable")
    start, sorted_lengths = (np.cumsum(lengths) - lengths)[order], lengths[order]
    b = _Beams(n, paths, context_size, np.array(own.roots, np.int64)[order] if own else np.zeros(n, np.int64))
    before, token_of, frame_of, traced = [], [], [], 0

    def worth(part: PhraseArrays | None, states: np.ndarray, what: str) -> np.ndarray:
        return getattr(part, what)[states] if part else np.zeros(states.shape)

    for t in range(int(sorted_lengths[0]) if n else 0):
        live = int(np.searchsorted(-sorted_lengths, -t, "left"))  # utterances of more than t frames
        x = rows[start[:live] + t]
        used = np.arange(paths) < b.count[:live, None]
        at = np.nonzero(used)
        if joiner is None:
            scores = np.repeat(log_softmax(x)[:, None], paths, axis=1)
        else:
            logits = joiner(x[at[0]], b.context[:live][at])
            scores = np.zeros((live, paths, logits.shape[1]))
            scores[at] = log_softmax(np.asarray(logits, np.float64))
        symbols = scores.shape[2]
        scores = scores + b.log_prob[:live, :, None]
        scores[~used] = -np.inf
        picked = _best(scores.reshape(live, -1), paths)
        slot, token = np.maximum(picked, 0) // symbols, np.maximum(picked, 0) % symbols
        u = np.arange(live)[:, None]
        valid = (picked >= 0) & used[u, slot]
        said = valid & (token != BLANK)
        log_prob = np.take_along_axis(scores.reshape(live, -1), np.maximum(picked, 0), axis=1)
        lm_prob, size, trace = b.lm[u, slot], b.size[u, slot] + said, b.trace[u, slot]
        hashes = [np.where(said, _mixed(b.hash[k][u, slot], token, k + 1), b.hash[k][u, slot]) for k in (0, 1)]
        context = b.context[u, slot]
        context[said] = np.concatenate([context[said], token[said][:, None]], axis=1)[:, -context_size:] if context_size else context[said]
        state, mine = b.state[u, slot], b.own[u, slot]
        old = np.maximum(worth(graph, state, "score"), worth(own, mine, "score"))
        if graph:
            state[said] = graph.step(state[said], token[said])
        if own:
            mine[said] = own.step(mine[said], token[said])
        gain = np.maximum(worth(graph, state, "score"), worth(own, mine, "score")) - old + worth(graph, state, "output") + worth(own, mine, "output")
        log_prob[said] += gain[said]
        before.append(trace[said])
        token_of.append(token[said])
        frame_of.append(np.full(int(said.sum()), t, np.int64))
        trace[said] = traced + np.arange(int(said.sum()))
        traced += int(said.sum())

        count, line = np.zeros(live, np.int64), np.arange(live)
        for r in range(paths):  # equal sequences become one, in order
            same = (b.hash[0][:live] == hashes[0][:, r, None]) & (b.hash[1][:live] == hashes[1][:, r, None]) & (np.arange(paths) < count[:, None]) if r else np.zeros((live, paths), bool)
            met = same.any(axis=1) & valid[:, r]
            into = same.argmax(axis=1)[met]
            b.log_prob[line[met], into] = np.logaddexp(b.log_prob[line[met], into], log_prob[met, r])
            b.lm[line[met], into] = np.logaddexp(b.lm[line[met], into], lm_prob[met, r])
            new = valid[:, r] & ~met
            to = (line[new], count[new])
            for kept, value in ((b.log_prob, log_prob), (b.lm, lm_prob), (b.size, size), (b.trace, trace), (b.context, context), (b.state, state), (b.own, mine), (b.hash[0], hashes[0]), (b.hash[1], hashes[1])):
                kept[to] = value[new, r]
            count += new
        b.count[:live] = count

    before, token_of, frame_of = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (before, token_of, frame_of))
    used = np.arange(paths) < b.count[:, None]
    b.log_prob -= np.maximum(worth(graph, b.state, "score"), worth(own, b.own, "score"))
    if lm is not None:
        tokens, _ = _traced(b.trace[used], b.size[used], before, token_of, frame_of)
        b.lm[used] = -lm_scale * np.asarray(lm(np.split(tokens, np.cumsum(b.size[used])[:-1])))
    total = np.where(used, (b.log_prob + b.lm) / (b.size + context_size), -np.inf)
    best = (np.arange(n), total.argmax(axis=1))
    back = np.argsort(order)
    trace, size, log_prob, lm_prob = (x[best][back] for x in (b.trace, b.size, b.log_prob, b.lm))
    tokens, frames = _traced(trace, size, before, token_of, frame_of)
    return tokens, frames, size, log_prob, lm_prob


def _traced(trace: np.ndarray, size: np.ndarray, before: np.ndarray, token_of: np.ndarray, frame_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and frames along the links of all hypotheses, end to end."""
    ends = np.cumsum(size)
    tokens, frames = np.zeros(int(size.sum()), np.int64), np.zeros(int(size.sum()), np.int64)
    at, left = ends - 1, np.flatnonzero(size > 0)
    trace = trace.copy()
    while len(left):
        tokens[at[left]], frames[at[left]] = token_of[trace[left]], frame_of[trace[left]]
        trace[left] = before[trace[left]]
        at[left] -= 1
        left = left[trace[left] >= 0]
    return tokens, frames


def _lists(flat: np.ndarray, size: np.ndarray, null: np.ndarray) -> pa.Array:
    offsets = np.append(0, np.cumsum(size)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)), pa.array(flat.astype(np.int32)))


def decoded(
    utterances: DataFrame, phrases: list[list[int]] | None = None, own_phrases: str | None = None, bonus: float = 1.5, mark_prefixes: bool = False, joiner: BatchJoiner | None = None, paths: int = ACTIVE_PATHS,
    context_size: int = CONTEXT_SIZE, lm: Callable[[list[np.ndarray]], np.ndarray] | None = None, key: str = "utt", frames: str = "frames",
) -> DataFrame:
    """key, tokens, times (frames), score of each utterance by beam search, batch by batch. frames: array of arrays of logits, or of what the joiner takes, all of one size in a table.

    ``phrases`` hold for every utterance, those in the column ``own_phrases`` (array of arrays of token ids) for its own as well. Null frames, and frames that hold a null or NaN, give nulls; no frames give no tokens and score 0.
    Rows of frames of different sizes are an error. Repeated rows have a result each; other columns are not read.
    """
    slim = utterances.select(key, frames, *([own_phrases] if own_phrases else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = PhraseArrays([phrases], bonus, mark_prefixes) if phrases else None
        for big in batches:
            for lo in range(0, big.num_rows, BATCH_ROWS):
                batch = big.slice(lo, BATCH_ROWS)
                column = batch.column(frames)
                inner = column.flatten()
                values = inner.flatten()
                lengths = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                sizes = np.nan_to_num(inner.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                missing = np.asarray(column.is_null())
                of_row = np.repeat(np.arange(len(lengths)), lengths)
                flat = values.to_numpy(zero_copy_only=False).astype(np.float64)  # null as NaN
                missing = missing.copy()
                missing[of_row[np.asarray(inner.is_null())]] = True
                missing[np.repeat(of_row, sizes)[np.isnan(flat)]] = True
                good = ~missing[of_row]
                wide = np.unique(sizes[good])
                if len(wide) > 1:
                    raise ValueError(f"frames of {wide.tolist()} values")
                matrix = flat[np.repeat(good, sizes)].reshape(int(good.sum()), int(wide[0]) if len(wide) else 1)
                lengths = np.where(missing, 0, lengths)
                lists = [[list(p) for p in x or [] if p] for x in batch.column(own_phrases).to_pylist()] if own_phrases else None
                own = PhraseArrays(lists, bonus, mark_prefixes, graph) if lists and any(lists) else None
                tokens, times, size, log_prob, lm_prob = beam_batch(matrix, lengths, joiner, graph, own, paths, context_size, lm)
                yield pa.RecordBatch.from_arrays([batch.column(key), _lists(tokens, size, missing), _lists(times, size, missing), pa.array(log_prob + lm_prob, mask=missing)], [key, "tokens", "times", "score"])

    return slim.mapInArrow(run, f"{key} {slim.schema[key].dataType.simpleString()}, tokens array<int>, times array<int>, score double")
