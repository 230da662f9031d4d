"""Text functions as Column expressions, and phoneme handling. SURVEY ids: X1-X19, S11, K9, J7, A17."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sentence delimiters, and the default phoneme alphabets, whose ids are the places in these strings.
DELIMITERS = ".,;:!?，。"
PHONEMES = (
    "_^$ !'(),-.:;?abcdefhijklmnopqrstuvwxyzæçðøħŋœǀǁǂǃɐɑɒɓɔɕɖɗɘəɚɛɜɞɟɠɡɢɣɤɥɦɧɨɪɫɬɭɮɯɰɱɲɳɴɵɶɸɹɺɻɽɾʀʁʂʃʄʈʉʊʋʌʍʎʏʐʑʒʔʕʘʙʛʜʝʟʡʢʲˈˌːˑ˞βθχᵻⱱ0123456789"
    "̧̪̯̩̃ʰˤε↓#\"↑̺̻"
)
PHONEMES_UK = "_^$ !',-.:;?абвгґдеєжзиіїйклмнопрстуфхцчшщьюя́̆̈—"
PAD, BEGIN, END = "_", "^", "$"
SPACE_MARK = "▁"


def default_phoneme_map(alphabet: str = PHONEMES) -> dict[str, list[int]]:
    return {c: [i] for i, c in enumerate(alphabet)}


def _class(chars: str) -> str:
    return "[" + "".join("\\" + c if not c.isalnum() and ord(c) < 128 else c for c in chars) + "]"


def split_any(text, delimiters: str, omit_empty: bool = True) -> Column:
    """Split at each delimiter character."""
    parts = F.split(text, _class(delimiters))
    return F.filter(parts, lambda x: x != "") if omit_empty else parts


def split_literal(text, delimiter: str) -> Column:
    return F.split(text, "\\Q" + delimiter + "\\E")


def split_blanks(text) -> Column:
    return F.filter(F.split(text, r"[ \t\n\r]+"), lambda x: x != "")


def trimmed(text, side: str = "both") -> Column:
    pattern = {"left": r"^[ \t\n\r\x0b\f]+", "right": r"[ \t\n\r\x0b\f]+$", "both": r"^[ \t\n\r\x0b\f]+|[ \t\n\r\x0b\f]+$"}[side]
    return F.regexp_replace(text, pattern, "")


def to_integers(text, delimiters: str = ",", omit_empty: bool = False) -> Column:
    """Array of ints, or null if any part is no integer of 32 bits."""
    parts = F.transform(split_any(text, delimiters, omit_empty), lambda x: F.when(x.rlike(r"^[ \t]*[+-]?[0-9]+$"), F.trim(x)).try_cast("int"))
    return F.when(F.forall(parts, lambda x: x.isNotNull()), parts)


def to_real(text) -> Column:
    """A double; reads inf, infinity, nan and the spellings 1.#INF, 1.#QNAN; null for anything else."""
    t = F.lower(F.trim(text))
    sign = F.when(t.startswith("-"), -1.0).otherwise(1.0)
    bare = F.regexp_replace(t, "^[+-]", "")
    return (
        F.when(bare.isin("inf", "infinity") | bare.rlike(r"^1\.#inf"), sign * F.lit(float("inf")))
        .when((bare == "nan") | bare.rlike(r"^1\.#qnan"), F.lit(float("nan")))
        .when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), t.try_cast("double"))
    )


def base64_token(text) -> Column:
    """Decoded bytes; where a group of four begins with ``=``, a single space instead."""
    bad = F.exists(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length(text) - 1) / 4))), lambda i: F.substring(text, (i * 4 + 1).cast("int"), F.lit(1)) == "=")
    padded = F.rpad(text, (F.ceil(F.length(text) / 4) * 4).cast("int"), "=")
    return F.when(bad, F.to_binary(F.lit(" "), F.lit("utf-8"))).otherwise(F.unbase64(padded))


def lower_ascii(text) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentences(text, delimiters: str = DELIMITERS) -> Column:
    """Segments between delimiters, without them and without empty ones; cut at characters, not bytes."""
    return F.filter(F.split(text, _class(delimiters) + "+"), lambda x: x != "")


def join_pieces(tokens) -> Column:
    """Tokens one after another (transducer)."""
    return F.array_join(tokens, "")


def shown_pieces(tokens) -> Column:
    """Tokens for display: a single byte that is no ASCII character (as binary) prints as ``<0xNN>``."""
    return F.transform(tokens, lambda t: F.when((F.octet_length(t) == 1) & (F.hex(t) > "7F"), F.concat(F.lit("<0x"), F.hex(t), F.lit(">"))).otherwise(F.decode(t, "utf-8")))


def join_merged(tokens) -> Column:
    """Tokens whose ``@@`` end joins them to the next; ASCII words are set apart by spaces, others aren't, and a space parts the two kinds."""
    state = F.struct(F.lit("").alias("text"), F.lit(False).alias("open"), F.lit(False).alias("ascii"), F.lit(True).alias("first"))

    def step(s: Column, t: Column) -> Column:
        goes_on = t.endswith("@@")
        ascii_ = F.ascii(F.substring(t, 1, 1)) < 128
        bare = F.when(goes_on, F.regexp_replace(t, "@@$", "")).otherwise(t)
        gap = F.when(goes_on | ascii_, ~s["open"]).otherwise(~s["first"] & s["ascii"])
        return F.struct(
            F.concat(s["text"], F.when(gap, F.lit(" ")).otherwise(F.lit("")), bare).alias("text"),
            F.when(goes_on, F.lit(True)).otherwise(F.lit(False)).alias("open"),
            ascii_.alias("ascii"),
            F.lit(False).alias("first"),
        )

    return F.aggregate(tokens, state, step, lambda s: s["text"])


def hypothesis_key(ids) -> Column:
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), "-")


def hot_words(text) -> Column:
    """Phrases of a string parted by ``/``."""
    return F.filter(F.split(text, "/"), lambda x: x != "")


def symbol(text, ident) -> Column:
    """A vocabulary symbol as it is used: a leading mark becomes a space, and ``<0xNN>`` of ids 3..258 becomes the byte id-3 where NN is its unpadded hex (so from 0x10 on)."""
    byte = (F.length(text) == 6) & (ident >= 3) & (ident <= 258) & (text == F.concat(F.lit("<0x"), F.hex(ident.cast("long") - 3), F.lit(">")))
    spaced = F.when(text.startswith(SPACE_MARK), F.concat(F.lit(" "), F.substring(text, 2, 1 << 30))).otherwise(text)
    return F.when(byte, F.unhex(F.lpad(F.hex(ident.cast("long") - 3), 2, "0"))).otherwise(F.encode(spaced, "utf-8"))


def token_times(frames, shift_ms: float = 10.0, subsampling: int = 4) -> Column:
    """Seconds of tokens by their encoder frame."""
    return F.transform(frames, lambda t: t * subsampling * shift_ms / 1000)


def peak_times(peaks, n_tokens, threshold: float = 1 - 1e-4, step: float = 0.02) -> Column:
    """Seconds of the frames whose integrate-and-fire value exceeds the threshold, without the last; null unless there is one per token."""
    places = F.filter(F.transform(peaks, lambda p, i: F.when(p > threshold, i)), lambda i: i.isNotNull())
    kept = F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0)))
    return F.when(F.size(kept) == n_tokens, F.transform(kept, lambda i: i * step))


def result_json(text, timestamps, tokens) -> Column:
    """A recognition result as (properly escaped) JSON; times with two decimals."""
    return F.to_json(F.struct(text.alias("text"), F.transform(timestamps, lambda t: F.round(t, 2)).alias("timestamps"), tokens.alias("tokens")))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _codepoints(texts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    for frame in texts:
        out = []
        for text, casing in zip(frame["text"], frame["casing"], strict=True):
            cased = {"ignore": str, "lower": str.lower, "upper": str.upper, "fold": str.casefold}[casing](text or "")
            out.append(list(unicodedata.normalize("NFD", cased)))
        yield pd.Series(out)


def codepoints(text, casing: str = "fold") -> Column:
    """Code points after case handling and canonical decomposition."""
    return _codepoints(F.struct(text.alias("text"), F.lit(casing).alias("casing")))


def mapped_phonemes(phonemes, mapping: dict[str, list[str]]) -> Column:
    """Each phoneme replaced by its list, where the map has one."""
    if not mapping:
        return phonemes
    table = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.flatten(F.transform(phonemes, lambda p: F.coalesce(F.try_element_at(table, p), F.array(p))))


def _id_map(ids: dict[str, list[int]]) -> Column:
    return F.create_map(*[x for k, v in ids.items() for x in (F.lit(k), F.array(*[F.lit(i).cast("long") for i in v]))])


def phoneme_ids(phonemes, ids: dict[str, list[int]], intersperse: bool = True, begin: bool = True, end: bool = True) -> Column:
    """Begin, pad, then each phoneme followed by the pad, then end. An unknown phoneme is left out if the pad is interspersed, else it is an error."""
    table, none = _id_map(ids), F.array().cast("array<long>")
    pad = F.array(*[F.lit(i).cast("long") for i in ids[PAD]]) if intersperse else none
    found = F.transform(
        phonemes,
        lambda p: F.when(F.try_element_at(table, p).isNotNull(), F.concat(F.element_at(table, p), pad)).otherwise(none if intersperse else F.raise_error(F.concat(F.lit("no id for phoneme "), p)).cast("array<long>")),
    )
    head = F.concat(F.array(*[F.lit(i).cast("long") for i in ids[BEGIN]]), pad) if begin else none
    tail = F.array(*[F.lit(i).cast("long") for i in ids[END]]) if end else none
    return F.concat(head, F.flatten(found), tail)


def missing_phonemes(phonemes, ids: dict[str, list[int]]) -> Column:
    """The phonemes without an id (explode and count them for a report)."""
    return F.filter(phonemes, lambda p: ~p.isin(list(ids)))


def without_language_flags(phonemes: Column) -> Column:
    """``(xx)`` marks of a language switch removed from a phoneme string."""
    return F.regexp_replace(phonemes, r"\([^)]*\)", "")


def missing_phoneme_counts(rows: DataFrame, phonemes: str, ids: dict[str, list[int]]) -> DataFrame:
    """phoneme, n: how often each phoneme without an id occurs. Survey id A17."""
    return rows.select(F.explode(missing_phonemes(F.col(phonemes), ids)).alias("phoneme")).groupBy("phoneme").agg(F.count(F.lit(1)).alias("n"))


#: What ends a clause, and which of these end a sentence too.
CLAUSE_ENDS, SENTENCE_ENDS = ".?!,:;", ".?!"


def phoneme_sentences(text: Column, speak: Callable[[Column], Column] = F.lower) -> Column:
    """The sentences of a text as strings of phonemes, in an array. Survey id X13.

    A text is cut into sentences after ``. ? !``, and these into clauses after ``, : ;`` as well. Each clause is spoken for itself: ``speak`` maps its words to phonemes (the step from letters to
    phonemes is not part of the specification). Language flags ``(xx)`` go, an open one to the end of its clause; then the clause's own sign follows, with a space after ``, : ;``, and the end of the text
    has none. A clause without words has no sign either, and a sentence without clauses is left out; null has no sentences. ``codepoints`` and ``mapped_phonemes`` go on from there.
    """
    sentences = F.regexp_extract_all(text, F.lit(f"[^{SENTENCE_ENDS}]*[{SENTENCE_ENDS}]?"), F.lit(0))

    def clause(c: Column) -> Column:
        words, sign = F.regexp_replace(c, f"[{CLAUSE_ENDS}]$", ""), F.regexp_extract(c, f"[{CLAUSE_ENDS}]$", 0)
        spoken = F.regexp_replace(speak(F.trim(words)), r"\([^)]*(\)|$)", "")
        return F.when(F.trim(words) == "", "").otherwise(F.concat(spoken, sign, F.when(sign.isin(*",:;"), " ").otherwise("")))

    def sentence(s: Column) -> Column:
        return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(f"[^{CLAUSE_ENDS}]*[{CLAUSE_ENDS}]?"), F.lit(0)), clause), "")

    return F.filter(F.transform(F.coalesce(sentences, F.array().cast("array<string>")), sentence), lambda s: s != "")
