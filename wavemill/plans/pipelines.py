"""Composed pipelines: samples to text and to speaker-labelled text, scores to an annotation, text to sound. SURVEY ids: section 2.15, N12, 3.1-3.3.

Streams are (stream_id, idx, value) rows of samples, or arrays of windows; every stage is one operator of the library, and models are scorers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavemill.functions import text as X
from wavemill.operators import clustering, timeline, tracking, vad, windows
from wavemill.plans.scorers import Scorer, scored


def speech_to_text(samples: DataFrame, vad_scorer: Scorer, recogniser: Scorer, config: vad.SpeechConfig | None = None, rate: int = 16000, flush: bool = False) -> DataFrame:
    """stream_id, start, end (seconds), text: windows, activity, segments of 29 s at most, recognition."""
    config = config or vad.SpeechConfig()
    spoken = segments_with_samples(samples, vad_scorer, config, flush)
    return scored(spoken, recogniser).select("stream_id", (F.col("start") / rate).alias("start"), (F.col("end") / rate).alias("end"), "text")


def segments_with_samples(samples: DataFrame, vad_scorer: Scorer, config: vad.SpeechConfig, flush: bool = False) -> DataFrame:
    """stream_id, start, end, samples of each speech segment."""
    framed = windows.count_windows(samples, config.window)
    scores = scored(framed.select("stream_id", F.col("window").alias("idx"), "samples"), vad_scorer).select("stream_id", "idx", "prob")
    segments = vad.speech_segments(scores, config, flush=flush)
    # Samples meet their segment through the window that holds them: an equi-join, with no range join.
    covered = segments.withColumn("window", F.explode(F.sequence(F.floor(F.col("start") / config.window).cast("long"), F.floor((F.col("end") - 1) / config.window).cast("long"))))
    keyed = samples.withColumn("window", F.floor(F.col("idx") / config.window).cast("long"))
    inside = keyed.join(covered, ["stream_id", "window"]).where((F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("end")))
    items = inside.groupBy("stream_id", "start", "end").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("items"))
    return items.select("stream_id", "start", "end", F.transform("items", lambda x: x["value"]).alias("samples"))


def diarise_online(samples: DataFrame, vad_scorer: Scorer, recogniser: Scorer, speaker_model: Scorer, config: vad.SpeechConfig | None = None, rate: int = 16000, least_seconds: float = 1.5) -> DataFrame:
    """stream_id, start, end, text, speaker: segments of at least 1.5 s, text and embedding, online speakers (labels as they are after the last segment)."""
    config = config or vad.SpeechConfig()
    spoken = windows.long_enough(segments_with_samples(samples, vad_scorer, config), rate=rate, seconds=least_seconds)
    known = scored(scored(spoken, recogniser), speaker_model).drop("samples").where("embedding is not null")
    speakers = tracking.diarised(known, "stream_id", "start")
    return known.join(speakers, ["stream_id", "start"]).select("stream_id", (F.col("start") / rate).alias("start"), (F.col("end") / rate).alias("end"), "text", "speaker")


def diarise_whole(segments: DataFrame, speaker_model: Scorer, recogniser: Scorer, cutoff: float = clustering.CUTOFF) -> DataFrame:
    """stream_id, start, end, text, speaker: every segment embedded, one clustering per stream, speakers numbered by first appearance."""
    known = scored(scored(segments, recogniser), speaker_model).drop("samples")
    labels = clustering.clustered(known, "stream_id", "start", cutoff=cutoff)
    return known.join(labels, ["stream_id", "start"]).select("stream_id", "start", "end", "text", F.col("cluster").alias("speaker"))


def annotate(scores: DataFrame, clusters: DataFrame, chunks: timeline.Geometry, frames: timeline.Geometry, frames_per_chunk: int, collar: float = 0.0, least: float = 0.0, onset: float = timeline.ONSET) -> DataFrame:
    """Chunk scores and local clusters to labelled intervals, sorted: binarise, count, reconstruct, intervals, merge, drop short ones."""
    binary = timeline.binarised(scores, onset)
    counts = timeline.active_count(binary, chunks, frames, frames_per_chunk)
    own = timeline.inactive_as_unassigned(binary, clusters)
    on = timeline.reconstructed(scores, own, counts, chunks, frames).select("frame", "class", F.col("on").cast("double").alias("value"))
    intervals = timeline.on_off_intervals(on, frames, 0.5)
    return timeline.ordered_annotation(timeline.without_short(timeline.merged_intervals(intervals, collar), least))


def text_to_sound(texts: DataFrame, voice: Scorer, ids: dict[str, list[int]] | None = None, silence: int = 1600, key: str = "id", text: str = "text") -> DataFrame:
    """id, sound (array of 16-bit samples): sentences, phonemes (code points), ids, synthesis, silence between, in order."""
    ids = ids or X.default_phoneme_map()
    parts = texts.select(key, F.posexplode(X.sentences(F.col(text))).alias("pos", "sentence"))
    phonemes = parts.select(key, "pos", X.phoneme_ids(X.codepoints(F.col("sentence")), ids).alias("phoneme_ids"))
    spoken = scored(phonemes, voice)
    pieces = spoken.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "samples"))).alias("parts"))
    gap = F.array_repeat(F.lit(0.0), silence)
    sound = F.flatten(F.transform("parts", lambda p: F.concat(p["samples"], gap)))
    from wavemill.functions import vectors as V

    return pieces.select(key, V.peak_int16(sound).alias("sound"))
