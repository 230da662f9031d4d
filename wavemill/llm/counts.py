"""Operator 4: token counts with overlap resynchronisation.

A text of up to ``chunk_chars`` characters is encoded at once. A longer one is encoded in chunks that overlap, with the
offsets of the pieces; neighbours are spliced in the overlap at a boundary that both encodings have and that is proven
stable. The proof: byte-pair merging only ever joins neighbours into a piece of the vocabulary, so where no
piece holds the two characters around a boundary side by side, no merge crosses it, whatever stands on either side.
The set of such character pairs is read from the vocabulary once. Where an overlap holds no such
boundary (or the encodings disagree on it), the chunk is widened and encoded again, up to the end of the text if need be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.llm.common import lean, text_of

SPACE = "▁"


class Splicer:
    """A sentencepiece BPE model that encodes texts of any length in bounded chunks, with the same ids as at once."""

    def __init__(self, model: str, chunk_chars: int = 32768, overlap_chars: int = 512):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(self.sp.serialized_model_proto())
        if proto.trainer_spec.model_type != proto.trainer_spec.BPE or proto.normalizer_spec.name != "identity" or proto.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("splicing is proven for BPE models that leave the text as it is")
        self.joined = {p.piece[i : i + 2] for p in proto.pieces if p.type in (1, 4) for i in range(len(p.piece) - 1)}
        self.chunk, self.overlap = chunk_chars, overlap_chars

    def stable(self, text: str, at: int) -> bool:
        """No piece of the vocabulary can cross this boundary."""
        return text[at - 1 : at + 1].replace(" ", SPACE) not in self.joined

    def _pieces(self, text: str, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and first characters (in the text) of text[lo:hi]'s pieces."""
        part = text[lo:hi]
        pieces = self.sp.encode(part, return_type="proto").pieces
        ids, begins = np.array([p.id for p in pieces], np.int64), np.array([p.begin for p in pieces], np.int64)
        if not part.isascii():  # offsets are bytes: count the characters that start before them
            raw = np.frombuffer(part.encode(), np.uint8)
            before = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            begins = before[begins]
        return ids, begins + lo

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text, as encoding it at once gives them."""
        if len(text) <= self.chunk:
            return np.array(self.sp.encode(text), np.int64)
        out, done, lo, hi = [], 0, 0, self.chunk
        left = self._pieces(text, lo, hi)
        while hi < len(text):
            overlap, cut = self.overlap, None
            while cut is None:
                begin = max(done, hi - overlap)
                end = min(len(text), begin + self.chunk + overlap)
                right = self._pieces(text, begin, end)
                common = np.intersect1d(left[1], right[1])
                inner = common[(common > begin) & (common > done) & (common < hi)]
                middle = (begin + hi) // 2
                for at in sorted(inner.tolist(), key=lambda p: abs(p - middle)):
                    if self.stable(text, at):
                        cut = at
                        break
                else:
                    if hi == len(text):
                        break
                    overlap *= 2  # widen: the left chunk reaches further, and the right one starts earlier
                    hi = min(len(text), hi + overlap)
                    left = self._pieces(text, lo, hi)
            if cut is None:
                break
            keep = (left[1] >= done) & (left[1] < cut)
            out.append(left[0][keep] if done else left[0][left[1] < cut])
            done, lo, hi, left = cut, begin, end, right
        out.append(left[0][left[1] >= done] if done else left[0])
        return np.concatenate(out)

    def counts(self, texts: list[str]) -> list[int]:
        short = [t if len(t) <= self.chunk else "" for t in texts]
        n = [len(x) for x in self.sp.encode(short, num_threads=1)]
        return [k if len(t) <= self.chunk else len(self.ids(t)) for t, k in zip(texts, n, strict=True)]


#: Characters of texts that are encoded in one call.
CALL_CHARS = 1 << 20


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, chunk_chars: int = 32768, overlap_chars: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty, with 0 tokens. doc_id may be null or repeat: each row is counted for itself. Other columns are not read.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of(docs).alias("text"))

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Splicer(model, chunk_chars, overlap_chars)
        for batch in batches:
            texts = batch.column("text")
            n: list[int] = []
            lo = 0
            while lo < len(texts):
                some, chars = [], 0
                while lo < len(texts) and (not some or chars < CALL_CHARS):
                    some.append(texts[lo].as_py())
                    chars += len(some[-1])
                    lo += 1
                n += own.counts(some)
            sizes = pa.compute.binary_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return slim.mapInArrow(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
