"""Decoding: greedy and beam search, phrase boosting, hypotheses. SURVEY ids: D1-D8, D10, A18, O2, O3, O6, U5, J6, X17.

With fixed log-probabilities the greedy forms are array expressions. Searches whose next scores depend on what was decoded take a
``Joiner``, and run per utterance in Arrow batches.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavemill.functions import vectors as V

BLANK, CONTEXT_SIZE, ACTIVE_PATHS, LM_SCALE = 0, 2, 4, 0.5


class Joiner(Protocol):
    """Scores of the next symbol, given a frame and the last symbols."""

    def __call__(self, frame: np.ndarray, context: tuple[int, ...]) -> np.ndarray: ...


def frame_is_logits(frame: np.ndarray, context: tuple[int, ...]) -> np.ndarray:
    """The joiner of a model without memory: the frame's own logits."""
    return frame


def greedy(frames: np.ndarray, joiner: Joiner = frame_is_logits, context_size: int = CONTEXT_SIZE) -> tuple[list[int], list[int]]:
    """At most one symbol per frame: tokens and the frames they came from."""
    tokens, at, context = [], [], (BLANK,) * context_size
    for t, frame in enumerate(frames):
        best = int(np.argmax(joiner(frame, context)))
        if best != BLANK:
            tokens.append(best)
            at.append(t)
            context = (*context, best)[-context_size:]
    return tokens, at


def greedy_column(log_probs) -> Column:
    """struct(tokens, frames) of an array of frames of scores, for a model without memory."""
    best = F.transform(log_probs, lambda row, t: F.struct(V.argmax(row).alias("token"), t.alias("frame")))
    kept = F.filter(best, lambda b: b["token"] != BLANK)
    return F.struct(F.transform(kept, lambda b: b["token"]).alias("tokens"), F.transform(kept, lambda b: b["frame"]).alias("frames"))


def until_end(log_probs, end_id: int) -> Column:
    """Best symbols up to the first end symbol (which is left out)."""
    best = F.transform(log_probs, lambda row: V.argmax(row))
    stop = F.array_position(best, F.lit(end_id))
    return F.when(stop > 0, F.slice(best, F.lit(1), F.greatest(stop.cast("int") - 1, F.lit(0)))).otherwise(best)


def autoregressive(start: list[int], scorer: Joiner, memory: np.ndarray, end_id: int, most: int) -> list[int]:
    """Greedy decoding after a prompt, until the end symbol or ``most`` symbols."""
    out: list[int] = []
    while len(out) < most:
        best = int(np.argmax(scorer(memory, (*start, *out))))
        if best == end_id:
            break
        out.append(best)
    return out


def prompted(utterances: DataFrame, scorer: Joiner, end_id: int, start_id: int, task_id: int, no_times_id: int, language_ids: list[int], context: int = 448, language: str | None = None, key: str = "utt", frames: str = "frames") -> DataFrame:
    """utt, language, tokens: greedy decoding after the prompt (start, language, task, no timestamps), until the end symbol or half the context. Survey id D7.

    ``scorer`` maps frames and the tokens so far to logits. The language is the column ``language`` of ids, or, where that is null or not named, the best of ``language_ids`` after the start symbol
    (ties to the first listed). Null frames give a null result. Rows go through in Arrow batches; each is decoded for itself.
    """
    own = [key, frames, *([language] if language else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple[int | None, list[int] | None]] = []
            for n, rows in enumerate(pdf[frames]):
                if rows is None:
                    out.append((None, None))
                    continue
                memory = np.array([np.asarray(r, np.float64) for r in rows])
                asked = pdf[language].iloc[n] if language else None
                if asked is None or pd.isna(asked):
                    asked = language_ids[int(np.argmax(np.asarray(scorer(memory, (start_id,)))[language_ids]))]
                prompt = [start_id, int(asked), task_id, no_times_id]
                out.append((int(asked), autoregressive(prompt, scorer, memory, end_id, context // 2 - len(prompt))))
            yield pd.DataFrame({key: pdf[key], "language": pd.array([x for x, _ in out], "Int32"), "tokens": [x for _, x in out]})

    slim = utterances.select(*own)
    return slim.mapInPandas(run, f"{key} {slim.schema[key].dataType.simpleString()}, language int, tokens array<int>")


def best_language(logits, language_ids: list[int]) -> Column:
    """The language id with the largest logit (ties to the first listed)."""
    pairs = F.array(*[F.struct(F.get(logits, F.lit(i)).alias("score"), F.lit(-k).alias("order"), F.lit(i).alias("id")) for k, i in enumerate(language_ids)])
    return F.array_max(pairs)["id"]


@dataclass
class PhraseNode:
    token: int
    score: float = 0.0
    output: float = 0.0
    is_end: bool = False
    children: dict[int, PhraseNode] = field(default_factory=dict)
    fail: PhraseNode | None = None


class PhraseGraph:
    """Phrases as a trie with failure links. Each token on a path is worth ``bonus``; a step that fails gives back what the lost path had earned.

    A phrase that is the beginning of one inserted before it is not marked as an end (the specification's behaviour; ``mark_prefixes`` marks it).
    """

    def __init__(self, phrases: list[list[int]], bonus: float, mark_prefixes: bool = False):
        self.root = PhraseNode(-1)
        for phrase in phrases:
            node = self.root
            for k, token in enumerate(phrase):
                last, new = k == len(phrase) - 1, token not in node.children
                if new:
                    node.children[token] = PhraseNode(token, node.score + bonus)
                node = node.children[token]
                node.is_end |= last and (new or mark_prefixes)
        queue = deque()
        for child in self.root.children.values():
            child.fail = self.root
            queue.append(child)
        while queue:
            node = queue.popleft()
            node.output = (node.score if node.is_end else 0.0) + (node.fail.output if node.fail else 0.0)
            for token, child in node.children.items():
                link = node.fail
                while link is not None and token not in link.children:
                    link = link.fail
                child.fail = link.children[token] if link is not None else self.root
                queue.append(child)

    def step(self, state: PhraseNode, token: int) -> tuple[PhraseNode, float]:
        node = state
        while node is not self.root and token not in node.children:
            node = node.fail
        node = node.children.get(token, self.root)
        return node, node.score - state.score + node.output

    def finish(self, state: PhraseNode) -> float:
        """What an unfinished path has to give back."""
        return -state.score


@dataclass
class Hypothesis:
    tokens: tuple[int, ...]
    frames: tuple[int, ...] = ()
    log_prob: float = 0.0
    lm_log_prob: float = 0.0
    state: PhraseNode | None = None


def log_softmax(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=-1, keepdims=True)
    return x - top - np.log(np.exp(x - top).sum(axis=-1, keepdims=True))


def beam(frames: np.ndarray, joiner: Joiner = frame_is_logits, graph: PhraseGraph | None = None, paths: int = ACTIVE_PATHS, context_size: int = CONTEXT_SIZE, lm=None, lm_scale: float = LM_SCALE) -> Hypothesis:
    """Modified beam search: at most one symbol per frame, equal sequences merged in log space, phrases boosted, the best by length-normalised score.

    ``lm`` maps a token sequence to its negative log likelihood; without one, merged hypotheses add their (zero) language-model scores in log space
    as well, as specified. The length counts the leading blanks too. Ties go to the earlier hypothesis, then the lower symbol.
    """
    beams = [Hypothesis((BLANK,) * context_size, state=graph.root if graph else None)]
    for t, frame in enumerate(frames):
        scores = np.stack([log_softmax(joiner(frame, h.tokens[-context_size:])) + h.log_prob for h in beams])
        flat = scores.ravel()
        merged: dict[tuple[int, ...], Hypothesis] = {}
        for at in np.argsort(-flat, kind="stable")[:paths]:
            old, token = beams[at // scores.shape[1]], int(at % scores.shape[1])
            new = Hypothesis(old.tokens, old.frames, float(flat[at]), old.lm_log_prob, old.state)
            if token != BLANK:
                new.tokens, new.frames = (*old.tokens, token), (*old.frames, t)
                if graph:
                    new.state, gain = graph.step(old.state, token)
                    new.log_prob += gain
            if new.tokens in merged:
                same = merged[new.tokens]
                same.log_prob = float(np.logaddexp(same.log_prob, new.log_prob))
                same.lm_log_prob = float(np.logaddexp(same.lm_log_prob, new.lm_log_prob))
            else:
                merged[new.tokens] = new
        beams = list(merged.values())
    for h in beams:
        if graph:
            h.log_prob += graph.finish(h.state)
        if lm:
            h.lm_log_prob = -lm_scale * lm(h.tokens[context_size:])
    best = max(beams, key=lambda h: (h.log_prob + h.lm_log_prob) / len(h.tokens))
    return Hypothesis(best.tokens[context_size:], best.frames, best.log_prob, best.lm_log_prob, best.state)


def decoded(utterances: DataFrame, method: str = "greedy", phrases: list[list[int]] | None = None, bonus: float = 1.5, joiner: Joiner = frame_is_logits, key: str = "utt", frames: str = "frames") -> DataFrame:
    """utt, tokens, times (frames), score of each utterance (frames: array of arrays of logits). Phrase boosting acts in beam search only.

    Null frames, and frames that hold a null or NaN, give nulls; no frames give no tokens. ``operators.batched`` does the same for whole batches at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        graph = PhraseGraph(phrases, bonus) if phrases else None
        for pdf in batches:
            out = []
            for rows in pdf[frames]:
                matrix = None if rows is None or any(r is None for r in rows) else np.array([np.asarray(r, np.float64) for r in rows])
                if matrix is None or np.isnan(matrix).any():
                    out.append((None, None, None))
                    continue
                if method == "greedy":
                    tokens, at = greedy(matrix, joiner)
                    out.append((tokens, at, None))
                else:
                    h = beam(matrix, joiner, graph)
                    out.append((list(h.tokens), list(h.frames), h.log_prob + h.lm_log_prob))
            yield pd.DataFrame({key: pdf[key], "tokens": [x[0] for x in out], "times": [x[1] for x in out], "score": [x[2] for x in out]})

    slim = utterances.select(key, frames)
    return slim.mapInPandas(run, f"{key} {slim.schema[key].dataType.simpleString()}, tokens array<int>, times array<int>, score double")


def merged_hypotheses(rows: DataFrame, *by: str, log_prob: str = "log_prob", lm_log_prob: str | None = None) -> DataFrame:
    """Duplicate hypotheses (equal keys ``by``) as one, their probabilities added in log space, with partial sums.

    exp(x - top) is summed against the group's maximum, so it takes two aggregations and no overflow.
    """
    names = [c for c in (log_prob, lm_log_prob) if c]
    tops = rows.groupBy(*by).agg(*[F.max(c).alias(f"{c}_top") for c in names])
    joined = rows.join(tops, list(by))
    sums = joined.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[(F.max(f"{c}_top") + F.log(F.sum(F.exp(F.col(c) - F.col(f"{c}_top"))))).alias(c) for c in names])
    return sums


def best_hypotheses(rows: DataFrame, utterance: str, k: int, total: Column, length: Column | None = None, tie: str = "key") -> DataFrame:
    """The k best of each utterance (at least one) by total log-probability, divided by the length if given: an added ``rank``."""
    score = total / length if length is not None else total
    place = F.row_number().over(Window.partitionBy(utterance).orderBy(F.desc("hyp_score"), tie))
    return rows.withColumn("hyp_score", score).withColumn("rank", place).where(F.col("rank") <= max(1, k))


def with_lm(hypotheses: DataFrame, scores: DataFrame, on: list[str], scale: float = LM_SCALE) -> DataFrame:
    """lm_log_prob = -scale x negative log likelihood."""
    return hypotheses.join(scores, on).withColumn("lm_log_prob", -scale * F.col("nll"))
