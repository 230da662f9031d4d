"""What the operators of this subpackage share: the shared folder, row identities and side tables.

Every intermediate result that a later job needs lies in the folder named by ``spark.checkpoint.dir``
(the only place that all executors and the driver see); nothing is kept in executor-local folders,
so a lost executor costs a recomputed task and never a result.
"""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a file that share one part number (see ``with_rows``).
PART_ROWS = 1 << 20
#: Folders of a side table at most; there are no more of them than keys.
SLOTS = 4096
#: Bytes of an Arrow batch of wide rows, whatever their number.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; where that is unset (tests on one machine), under the temp folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        base = "file://" + tempfile.gettempdir() + "/wavemill-shared"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, uri: str) -> None:
    """Delete an intermediate folder once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's view of a shared folder: file, hdfs, s3 (s3a and s3n are Spark's names for it) and gs addresses alike."""
    uri = re.sub("^s3[an]://", "s3://", uri)
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write to the shared folder and read again: cuts the lineage and fixes what later jobs see."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table written earlier; with its schema given no job is needed to infer it, and an empty one reads too."""
    return spark.read.schema(schema).parquet(path)


def with_rows(docs: DataFrame, prefix: str = "_row") -> DataFrame:
    """``docs`` with two long columns that identify each row wherever and however often it is read.

    ``{prefix}_part`` numbers runs of PART_ROWS rows of one file, ``{prefix}_pos`` is the place within the run.
    They come from the Parquet reader, so any scan of the same files gives the same numbers, whatever
    the splits. A frame that is not a plain scan is written to the shared folder first.
    """
    for frame in (docs, None):
        frame = frame if frame is not None else materialise(docs, "rows")
        try:
            meta = frame.metadataColumn("_metadata")
            index = meta["row_index"]
            return frame.select(
                *[frame[f"`{c}`"] for c in frame.columns],
                F.xxhash64(meta["file_path"], F.floor(index / PART_ROWS)).alias(f"{prefix}_part"),
                (index % PART_ROWS).cast("long").alias(f"{prefix}_pos"),
            )
        except AnalysisException:
            if frame is not docs:
                raise
    raise AssertionError


def spread_join(rows: DataFrame, facts: DataFrame, key: str, salt: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``facts`` (one row per key) where one key may hold any share of the rows.

    ``salt``, a column of ``rows``, deals the rows of a key out; the facts of a key are copied once to each salt under which the key occurs.
    """
    wanted = rows.select(key, salt).distinct().join(facts, key)
    return rows.join(wanted, [key, salt], how)


def give_back() -> None:
    """Return memory that this process has freed to the system."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Caches of this worker process that outlive a task, by the modules that use them.
_kept: dict[tuple[str, ...], Callable[[], None]] = {}


def keep(modules: tuple[str, ...], drop: Callable[[], None]) -> None:
    """A cache that later tasks of these modules find warm; ``drop`` empties it as soon as a task of another module runs here."""
    _kept[modules] = drop


def drop_caches_of_others(module: str) -> None:
    for modules in [m for m in _kept if not module.endswith(m)]:
        _kept.pop(modules)()
        give_back()


def lean(function):
    """For the functions of ``mapInArrow``: a task drops what other operators have left in its Python worker, and gives freed memory back when it ends."""

    @functools.wraps(function)
    def run(batches):
        drop_caches_of_others(function.__module__)
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows and BATCH_BYTES of an Arrow batch, for the jobs that an operator runs itself on wide rows: what a Python worker holds at once. A row is never cut."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {key: spark.conf.get(key) for key in keys}
    for key, value in keys.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def text_of(df: DataFrame, column: str = "text"):
    """The text column, null as empty."""
    return F.coalesce(df[f"`{column}`"].cast("string"), F.lit(""))


class SideTable:
    """Pairs (item, value) by key in the shared folder, which a task reads by key without a shuffle of the reading side.

    ``write`` takes rows (key, item, value), all long, and lays them out in folders by ``pmod(key, spread)``, one row per key with its items in order. The
    items of one key must fit in memory: keys are the parts of ``with_rows``. ``find`` is a column expression: the value of an item
    under a key, or null. A worker keeps the last keys that it has read, and a scan meets its parts one after another.
    """

    def __init__(self, uri: str, spread: int = SLOTS):
        self.uri, self.spread = uri, spread

    def write(self, rows: DataFrame) -> SideTable:
        items = F.sort_array(F.collect_list(F.struct("item", "value")))
        (
            rows.groupBy("key")
            .agg(items.alias("items"))
            .select("key", F.col("items.item").alias("item"), F.col("items.value").alias("value"), F.pmod("key", F.lit(self.spread)).alias("slot"))
            .repartition("slot")
            .sortWithinPartitions("slot", "key")
            .write.partitionBy("slot")
            .parquet(self.uri)
        )
        return self

    def _load(self, key: int) -> tuple[np.ndarray, np.ndarray]:
        """Items, in order, and their values."""
        while self.uri not in _loaded and len(_loaded) >= 2:
            _loaded.pop(next(iter(_loaded)))
        cache = _loaded.setdefault(self.uri, {})
        if key not in cache:
            while len(cache) >= 2:
                cache.pop(next(iter(cache)))
            fs, base = filesystem(self.uri)
            found = fs.get_file_info(pafs.FileSelector(f"{base}/slot={key % self.spread}", allow_not_found=True))
            cache[key] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            for f in found:
                if f.path.endswith(".parquet"):
                    with fs.open_input_file(f.path) as handle:
                        table = pq.read_table(handle, filters=[("key", "=", key)])
                    if table.num_rows:
                        cache[key] = tuple(table[c].combine_chunks().values.to_numpy() for c in ("item", "value"))
        return cache[key]

    def values(self, keys: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of items under their keys, and which there are."""
        out, there = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for key in np.unique(keys).tolist():
            rows = keys == key
            known, value = self._load(key)
            if len(known):
                at = np.minimum(np.searchsorted(known, items[rows]), len(known) - 1)
                there[rows] = known[at] == items[rows]
                out[rows] = value[at]
        return out, there

    def find(self, key: Column, item: Column) -> Column:
        @F.arrow_udf("long")
        def value(keys: pa.Array, items: pa.Array) -> pa.Array:
            drop_caches_of_others(__name__)
            out, there = self.values(keys.to_numpy(zero_copy_only=False), items.to_numpy(zero_copy_only=False))
            return pa.array(out, mask=~there)

        return value(key, item)


_loaded: dict[str, dict] = {}
