"""Text, JSON and vocabulary files, configuration, and result sinks. SURVEY ids: S9-S13, S15, K1-K4, K7, K9, X16, P14."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.functions import text as X


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """One vector per line, numbers parted by white space: vector."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("float")).alias("vector"))


def write_vectors(rows: DataFrame, path: str, vector: str = "vector", mode: str = "errorifexists") -> None:
    rows.select(F.concat_ws(" ", F.transform(vector, lambda x: x.cast("string"))).alias("value")).write.mode(mode).text(path)


def read_enrolled(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object of name -> list of vectors: name, pos, emb."""
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.explode(F.from_json("value", "map<string,array<array<float>>>")).alias("name", "vectors"))
    return parsed.select("name", F.posexplode("vectors").alias("pos", "emb"))


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """``symbol id`` lines: id, sym (binary, as it prints), raw. A symbol that occurs twice is an error. A line of just an id is the space."""
    parts = F.split(F.rtrim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.element_at(parts, -1).cast("int").alias("id"), F.when((F.size(parts) > 1) & (F.element_at(parts, 1) != ""), F.element_at(parts, 1)).otherwise(F.lit(" ")).alias("raw"))
    counted = lines.groupBy("raw").agg(F.max("id").alias("id"), F.count(F.lit(1)).alias("n"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("symbol occurs twice: "), F.col("raw"))).cast("int")).otherwise(F.col("id"))
    return counted.select(checked.alias("id"), X.symbol(F.col("raw"), F.col("id")).alias("sym"), "raw")


def encode_hot_words(phrases: DataFrame, symbols: DataFrame, phrase: str = "value") -> DataFrame:
    """Phrases (tokens parted by white space) to token ids: phrase_id, token_ids. A token that is not in the table fails the whole load."""
    numbered = phrases.where(F.trim(phrase) != "").select(F.xxhash64(phrase).alias("phrase_id"), F.posexplode(F.split(F.trim(F.col(phrase)), r"\s+")).alias("pos", "raw"))
    joined = numbered.join(symbols.select("raw", "id"), "raw", "left")
    checked = F.when(F.col("id").isNull(), F.raise_error(F.concat(F.lit("no id for token "), F.col("raw"))).cast("int")).otherwise(F.col("id"))
    items = joined.groupBy("phrase_id").agg(F.array_sort(F.collect_list(F.struct("pos", checked.alias("id")))).alias("items"))
    return items.select("phrase_id", F.transform("items", lambda x: x["id"]).alias("token_ids"))


VOICE_SCHEMA = """
    audio struct<sample_rate: int>, espeak struct<voice: string>, phoneme_type string, num_symbols int, num_speakers int,
    phoneme_id_map map<string, array<bigint>>, phoneme_map map<string, array<string>>, speaker_id_map map<string, bigint>,
    inference struct<noise_scale: double, length_scale: double, noise_w: double>
"""


def read_voice(spark: SparkSession, path: str) -> DataFrame:
    """A voice's JSON configuration, one row. Keys of the maps are cut to their first code point."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", VOICE_SCHEMA).alias("v")).select("v.*")
    first = lambda c: F.transform_keys(c, lambda k, _: F.substring(k, 1, 1))
    return whole.withColumns({"phoneme_id_map": first("phoneme_id_map"), "phoneme_map": first("phoneme_map")})


def read_options(defaults: Any, config_lines: list[str], arguments: list[str]) -> Any:
    """A dataclass of options with the values of a config file and then of ``--name=value`` arguments. Names are matched in lower case with ``-`` for ``_``; ``#`` begins a comment.

    ``--config=file`` among the arguments names a further file, which is read before any argument, so that arguments override it wherever they stand. A field whose metadata has
    ``unsigned`` takes no negative number. Files are read from the driver's own disk.
    """
    files = [a.partition("=")[2].strip() for a in arguments if a.strip().partition("=")[0].lower() == "--config"]
    config_lines = [*config_lines, *(line for f in files for line in Path(f).read_text(encoding="utf-8").splitlines())]
    fields = {f.name.lower().replace("_", "-"): f for f in dataclasses.fields(defaults)}
    out: dict[str, Any] = {}
    for line in [*config_lines, *arguments]:
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        if not line.startswith("--"):
            raise ValueError(f"no option: {line}")
        name, equals, value = line[2:].partition("=")
        name = name.lower().replace("_", "-")
        if name == "config":
            continue
        if name not in fields:
            raise ValueError(f"unknown option --{name}")
        kind = type(getattr(defaults, fields[name].name))
        if kind is bool:
            if equals and value not in ("true", "false", ""):
                raise ValueError(f"--{name} takes true or false")
            out[fields[name].name] = value != "false"
        else:
            out[fields[name].name] = kind(value)
            if fields[name].metadata.get("unsigned") and out[fields[name].name] < 0:
                raise ValueError(f"--{name} takes no negative number")
    return dataclasses.replace(defaults, **out)


def problems(options: Any, checks: dict[str, tuple[Callable[[Any], bool], str]]) -> list[str]:
    """What is wrong with a dataclass of options: of each field that fails its predicate, the message. Survey id P14."""
    return [f"{name}: {message}" for name, (ok, message) in checks.items() if not ok(getattr(options, name))]


#: Predicates of common options, for ``problems``.
POSITIVE = (lambda x: x > 0, "must be above 0")
SHARE = (lambda x: 0 <= x <= 1, "must lie in 0 to 1")
EXISTING_FILE = (lambda x: Path(x).is_file(), "there is no such file")


def two_places(x: Column) -> Column:
    """A double with two decimals, rounded by its exact binary value and half to even, as C and SQL print it. (``%.2f`` of the JVM rounds its shortest decimal half up: 0.125 to 0.13, 0.285 to 0.29.)

    Whether a fraction is above the middle of two hundredths is the sign of fraction * 200 - (2 k + 1), which is exact when the fraction is cut into a float and the rest.
    """
    x = x.cast("double")
    size = F.abs(x)
    whole = F.floor(size)
    part = size - whole
    head, k = part.cast("float").cast("double"), F.floor(part * 100)
    above = (head * 200 - (2 * k + 1)) + (part - head) * 200
    n = k + F.when((above > 0) | ((above == 0) & (k % 2 == 1)), 1).otherwise(0)
    digits = F.concat((whole + F.floor(n / 100)).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))
    text = F.when(size < 2.0**63, digits).when(F.isnan(x), "nan").when(size == float("inf"), "inf").otherwise(F.format_string("%.2f", size))
    return F.when(x.isNotNull(), F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise(""), text))


def segment_line(start: Column, end: Column, text: Column) -> Column:
    return F.format_string("Time: [%ss ~ %ss], Text: %s", two_places(start), two_places(end), text)


def append_segments(rows: DataFrame, path: str) -> None:
    """Append report lines of (start, end, text)."""
    rows.select(segment_line(F.col("start"), F.col("end"), F.col("text")).alias("value")).write.mode("append").text(path)


def write_diary(rows: DataFrame, path: str, by_speaker: bool = False) -> None:
    """Replace the report of (seq, speaker, start, end, text), in order of arrival or by speaker."""
    order = ["speaker", "seq"] if by_speaker else ["seq"]
    line = F.concat(F.format_string("Speaker %d, ", F.col("speaker").cast("long")), segment_line(F.col("start"), F.col("end"), F.col("text")))
    rows.orderBy(*order).select(line.alias("value")).write.mode("overwrite").text(path)


def status_line(ident: Column, first: Column, ratio: Column) -> Column:
    """``id/first/ratio``."""
    return F.format_string("%d/%d/%s", ident.cast("long"), first.cast("int"), two_places(ratio))


def latest_status(rows: DataFrame, stream: str, order: str) -> DataFrame:
    """The last status line of each stream."""
    last = F.max_by(F.struct("ident", "is_first", "ratio"), order)
    return rows.groupBy(stream).agg(last.alias("last")).select(stream, status_line(F.col("last.ident"), F.col("last.is_first"), F.col("last.ratio")).alias("status"))
