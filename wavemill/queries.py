"""The registered queries over the driver's tables, and the SQL that each must equal.

``events`` stand in for score streams (user = stream, order = ts then event_id, score = value / 100, 1 at most), ``embeddings`` for speaker
embeddings, ``documents``, ``conversations`` and ``benchmark`` for text. Floats are rounded to six places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavemill.functions import text as X
from wavemill.functions import vectors as V
from wavemill.operators import arrays, batched, clustering, decoding, folds, match, signals, timeline, tracking, vad, windows

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def arrays6(c) -> Column:
    return F.transform(c, lambda x: F.round(x, 6) + F.lit(0.0))


# --- embeddings: vectors ---------------------------------------------------------------------------------------------

EMB = "select vec_id, label, embedding::double[] as v from embeddings"
CENTRES = """cx as (select label, pos, avg(x) as x from (select label, unnest(v) as x, unnest(generate_series(0, len(v) - 1)) as pos from e) group by label, pos),
cen as (select label, list(x order by pos) as v from cx group by label)"""
THRESHOLD, GROUPS = 0.3, 10


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


@register("nearest_above_threshold", f"""
with e as ({EMB}), p as (
  select a.vec_id, b.vec_id as match_id, list_cosine_similarity(a.v, b.v) as sim from e a join e b on a.vec_id <> b.vec_id
), best as (select vec_id, match_id, sim, row_number() over (partition by vec_id order by sim desc, match_id) as rn from p where sim > {THRESHOLD})
select vec_id, match_id, round(sim, 6) as sim from best where rn = 1""")
def nearest_above_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    found = match.nearest(e, e, THRESHOLD, exclude_same=True).where("match_id >= 0")
    return found.select(F.col("query").alias("vec_id"), "match_id", r6("sim").alias("sim"))


@register("cosine_topk", f"""
with e as ({EMB}), p as (
  select a.vec_id, b.vec_id as match_id, list_cosine_similarity(a.v, b.v) as sim from e a join e b on a.vec_id <> b.vec_id
), best as (select *, row_number() over (partition by vec_id order by sim desc, match_id) as rank from p)
select vec_id, rank, match_id, round(sim, 6) as sim from best where rank <= 5""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return match.top_k(e, e, 5).select(F.col("query").alias("vec_id"), F.col("rank").cast("long").alias("rank"), "match_id", r6("sim").alias("sim"))


@register("last_match", f"""
with e as ({EMB}), {CENTRES}, reg as (select label::bigint as id, v from cen)
select e.vec_id, coalesce(max(reg.id) filter (where list_cosine_similarity(e.v, reg.v) > {THRESHOLD}), -1) as match_id
from e cross join reg group by e.vec_id""")
def last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    registry = match.centroids(e, "label").select(F.col("label").cast("long").alias("id"), F.col("centroid").alias("emb"))
    return match.last_match(e, registry, THRESHOLD).select(F.col("query").alias("vec_id"), "match_id")


@register("best_named", f"""
with e as ({EMB}), {CENTRES}, p as (
  select e.vec_id, 'speaker ' || cen.label as name, list_cosine_similarity(e.v, cen.v) as sim from e cross join cen
), best as (select vec_id, name, sim, row_number() over (partition by vec_id order by sim desc, name) as rn from p)
select vec_id, case when sim > 0 then name else 'Nobody' end as name, case when sim > 0 then round(sim, 6) else 0 end as sim from best where rn = 1""")
def best_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    enrolled = match.centroids(e, "label").select(F.concat(F.lit("speaker "), F.col("label").cast("string")).alias("name"), F.col("centroid").alias("emb"))
    return match.best_named(e, enrolled).select(F.col("query").alias("vec_id"), "name", r6("sim").alias("sim"))


@register("wake_word", f"""
with e as ({EMB}), bank as (select v from e where label = 3)
select e.vec_id, bool_or((list_cosine_similarity(e.v, bank.v) + 1) / 2 > 0.7) as hit from e cross join bank group by e.vec_id""")
def wake_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return match.wake_word(e, e.where("label = 3")).select(F.col("query").alias("vec_id"), "hit")


@register("euclid_pairs", f"""
with e as ({EMB}), p as (select a.vec_id as a, b.vec_id as b, list_distance(a.v, b.v) as distance from e a join e b on a.vec_id < b.vec_id)
select a, b, round(distance, 6) as distance from p where distance <= 1.2""")
def euclid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.pair_distances(embeddings(spark, sf_dir), within=1.2).select("a", "b", r6("distance").alias("distance"))


@register("cosine_set_distances", f"""
with e as ({EMB}) select a.vec_id as a, b.vec_id as b, round(1 - list_cosine_similarity(a.v, b.v), 6) as distance
from e a cross join e b where a.label = 1 and b.label = 2""")
def cosine_set_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return match.pair_distances(e.where("label = 1"), cosine=True, other=e.where("label = 2")).select("a", "b", r6("distance").alias("distance"))


@register("class_centroids", f"""
with e as ({EMB}), x as (select label, unnest(v) as x, unnest(generate_series(0, len(v) - 1)) as pos from e)
select label, pos, count(*) as n, round(avg(x), 6) as mean from x group by label, pos""")
def class_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = match.centroids(embeddings(spark, sf_dir), "label")
    return c.select("label", "n", F.posexplode("centroid").alias("pos", "mean")).select("label", F.col("pos").cast("long").alias("pos"), "n", r6("mean").alias("mean"))


@register("assign_nearest_centroid", f"""
with e as ({EMB}), x as (select label, unnest(v) as x, unnest(generate_series(0, len(v) - 1)) as pos from e),
m as (select label, pos, avg(x) as x from x group by label, pos), c as (select label, list(x order by pos) as v from m group by label), p as (
  select e.vec_id, c.label, list_cosine_similarity(e.v, c.v) as sim, row_number() over (partition by e.vec_id order by list_cosine_similarity(e.v, c.v) desc, c.label) as rn from e cross join c)
select vec_id, label::bigint as nearest, round(sim, 6) as sim from p where rn = 1""")
def assign_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    return match.assigned(e, match.centroids(e, "label")).select(F.col("query").alias("vec_id"), F.col("match_id").alias("nearest"), r6("sim").alias("sim"))


@register("cmn_subtract", f"""
with e as ({EMB}), x as (select vec_id, label, unnest(v) as x, unnest(generate_series(0, len(v) - 1)) as pos from e)
select vec_id, pos, round(x - avg(x) over (partition by label, pos), 6) + 0.0 as x from x""")
def cmn_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    centred = match.without_mean(embeddings(spark, sf_dir), "label")
    return centred.select("vec_id", F.posexplode("centred").alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), r6("x").alias("x"))


@register("cluster_sizes", "select label, count(*) as n, count(*) >= 50 as large from embeddings group by label")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.cluster_sizes(table(spark, sf_dir, "embeddings"), "label", 50)


@register("running_blend", f"""
with recursive e as (select label, v, row_number() over (partition by label order by vec_id) as rn from ({EMB})), b(label, rn, v) as (
  select label, rn, v from e where rn = 1
  union all select e.label, e.rn, list_transform(list_zip(b.v, e.v), lambda p: (p[1] + p[2]) / 2) from b join e on e.label = b.label and e.rn = b.rn + 1)
select label, pos, round(x, 6) + 0.0 as x from (
  select label, unnest(v) as x, unnest(generate_series(0, len(v) - 1)) as pos, rn, max(rn) over (partition by label) as last from b) where rn = last""")
def running_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = match.blended(embeddings(spark, sf_dir), "label", "vec_id")
    return b.select("label", F.posexplode("blend").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), r6("x").alias("x"))


@register("vector_scalars", f"""
with e as ({EMB}), n as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as nrm from e)
select vec_id, round(nrm, 6) as norm, list_position(v, list_max(v)) - 1 as argmax, round(list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))), 6) as lse,
  round(list_sum(v) / len(v), 6) + 0.0 as mean, round(list_min(v), 6) as low, round(list_max(v), 6) as high from n""")
def vector_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return embeddings(spark, sf_dir).select("vec_id", r6(V.norm(v)).alias("norm"), V.argmax(v).cast("long").alias("argmax"), r6(V.log_sum_exp(v)).alias("lse"), r6(V.mean(v)).alias("mean"), r6(F.array_min(v)).alias("low"), r6(F.array_max(v)).alias("high"))


def _vector_query(name: str, transform: Callable[[Column], Column], sql: str) -> None:
    """A query that maps each embedding to a vector, listed by place."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = embeddings(spark, sf_dir).select("vec_id", F.posexplode(transform(F.col("embedding"))).alias("pos", "x"))
        return out.select("vec_id", F.col("pos").cast("long").alias("pos"), r6(F.col("x").cast("double")).alias("x"))

    run.__name__ = name
    register(name, f"""
with e as ({EMB}), m as (select vec_id, {sql} as w from e), x as (select vec_id, unnest(w) as x, unnest(generate_series(0, len(w) - 1)) as pos from m)
select vec_id, pos, round(x::double, 6) + 0.0 as x from x""")(run)


_NORM = "sqrt(list_sum(list_transform(v, lambda y: y * y)))"
_MEAN = "(list_sum(v) / len(v))"
_vector_query("l2_normalize", V.l2_normalised, f"list_transform(v, lambda x: x / {_NORM})")
_vector_query("log_softmax", V.log_softmax, "list_transform(v, lambda x: x - (list_max(v) + ln(list_sum(list_transform(v, lambda y: exp(y - list_max(v)))))))")
_vector_query("pre_emphasis", lambda v: V.pre_emphasis(v, 0.97, keep_first=False), "list_transform(v, lambda x, i: case when i = 1 then x * (1 - 0.97::double) else x - 0.97::double * v[i - 1] end)")
_vector_query("to_int16", V.to_int16, "list_transform(v, lambda x: round(x * 32767)::int)")
_vector_query("to_int16_truncated", lambda v: V.to_int16(v, rounding=False), "list_transform(v, lambda x: trunc(x * 32767)::int)")
_vector_query("min_max_scaled", V.min_max_scaled, "list_transform(v, lambda x: (x - list_min(v)) / (list_max(v) - list_min(v)))")
_vector_query("floor_normalised", lambda v: V.floor_normalised(V.scaled(v, 20.0)), f"list_transform(v, lambda x: x * 20 / greatest(20 * {_NORM}, 9.999::double))")
_vector_query("peak_int16", V.peak_int16, "list_transform(v, lambda x: trunc(greatest(-32767.0::double, least(32767.0::double, x * (32767.0::double / greatest(0.01::double, list_max(list_transform(v, lambda y: abs(y)))))))))")
_vector_query("log_mel_normalised", lambda v: V.log_mel_normalised(F.transform(v, lambda x: x * x)), "list_transform(v, lambda x: (greatest(log10(greatest(x * x, 1e-10::double)), list_max(list_transform(v, lambda y: log10(greatest(y * y, 1e-10::double)))) - 8) + 4) / 4)")
_vector_query("standardised", V.standardised, f"list_transform(v, lambda x: (x - {_MEAN}) / (sqrt(list_sum(list_transform(v, lambda y: (y - {_MEAN}) * (y - {_MEAN}))) / len(v)) + 1e-5::double))")
_vector_query("cmvn", lambda v: V.cmvn(v, F.transform(v, lambda x, i: -i / 100.0), F.transform(v, lambda x, i: 1 + i / 10.0)), "list_transform(v, lambda x, i: (x - (i - 1) / 100.0::double) * (1 + (i - 1) / 10.0::double))")
_vector_query("cropped", lambda v: V.cropped(v, F.lit(-3), 70), "list_transform(generate_series(-3, 66), lambda i: case when i >= 0 and i < len(v) then v[i + 1] else 0.0 end)")
_vector_query("compacted", lambda v: V.compacted(v, F.transform(v, lambda x: x > 0)), "list_concat(list_filter(v, lambda x: x > 0), list_transform(generate_series(1, len(v) - len(list_filter(v, lambda x: x > 0))), lambda i: 0.0::double))")
_vector_query("padded", lambda v: V.padded(v, 66, -23.0258), "list_concat(v, [-23.0258::double, -23.0258::double])")
_vector_query("upsampled_mask", lambda v: F.transform(V.upsampled_mask(v, 150, 0.0), lambda b: b.cast("int")), "list_transform(generate_series(0, 149), lambda j: (v[1 + (j * len(v)) // 150] > 0)::int)")
_vector_query("mel_forward", lambda v: F.transform(v, lambda x: V.mel(F.abs(x) * 4000)), "list_transform(v, lambda x: 1127.0::double * ln(1 + abs(x) * 4000 / 700.0::double))")
_vector_query("mel_backward", lambda v: F.transform(v, lambda x: V.mel_inverse(F.abs(x) * 2000)), "list_transform(v, lambda x: 700.0::double * (exp(abs(x) * 2000 / 1127.0::double) - 1))")
_vector_query("top_indices", lambda v: V.top_indices(v, 3), "list_transform(list_grade_up(list_transform(v, lambda x: -x))[1:3], lambda i: i - 1)")
_vector_query("mel_scale", lambda v: F.transform(v, lambda x: V.mel_inverse(V.mel(F.abs(x) * 4000))), "list_transform(v, lambda x: 700.0::double * (exp(1127.0::double * ln(1 + abs(x) * 4000 / 700.0::double) / 1127.0::double) - 1))")


@register("cosine_distance_to_first", f"""
with e as ({EMB}), f as (select label, min_by(v, vec_id) as w from e group by label)
select vec_id, round(1 - list_cosine_similarity(v, w), 6) + 0.0 as distance, round(list_distance(v, w), 6) as euclidean from e join f using (label)""")
def cosine_distance_to_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir)
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("w"))
    v, w = F.col("embedding"), F.col("w")
    return e.join(first, "label").select("vec_id", r6(V.cosine_distance(v, w)).alias("distance"), r6(V.euclidean(v, w)).alias("euclidean"))


@register("enrolment", f"""
with e as ({EMB}), seg as (select 'speaker ' || label as name, v from e), one as (select 'speaker ' || label as name, min_by(v, vec_id) as v from e group by label),
flat as (select name, 'segment' as kind, unnest(v) as x, unnest(generate_series(0, len(v) - 1)) as pos from seg union all select name, 'whole', unnest(v), unnest(generate_series(0, len(v) - 1)) from one)
select name, kind, pos, round(x, 6) + 0.0 as x from flat
union all select name, 'mean', pos, round(avg(x), 6) + 0.0 from flat where kind = 'segment' group by name, pos""")
def enrolment(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir).withColumn("name", F.concat(F.lit("speaker "), F.col("label").cast("string"))).withColumnRenamed("embedding", "emb")
    out = match.enrolment(e, e.groupBy("name").agg(F.min_by("emb", "vec_id").alias("emb")))
    return out.select("name", "kind", F.posexplode("emb").alias("pos", "x")).select("name", "kind", F.col("pos").cast("long").alias("pos"), r6("x").alias("x"))


# --- events: streams, windows, timelines ------------------------------------------------------------------------------

SCORES = """select user_id, event_id, ts, event_type, value, (row_number() over (partition by user_id order by ts, event_id) - 1)::bigint as idx,
  round(least(1.0::double, value / 100), 6) as prob from events"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return windows.numbered(events, "user_id", "ts", "event_id").withColumn("prob", F.round(F.least(F.lit(1.0), F.col("value") / 100), 6))


@register("count_hop_window", f"""
with s as ({SCORES}), k as (select user_id, value, unnest(generate_series(greatest(0, ((idx - 8) // 3) + case when idx < 8 then 0 else 1 end), idx // 3)) as w from s)
select user_id, w as "window", count(*) as n, round(avg(value), 6) as mean, min(value) as low, max(value) as high from k group by user_id, w having count(*) = 8""")
def count_hop_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = windows.count_window_stats(scores(spark, sf_dir), 8, 3, "user_id")
    return stats.select("user_id", "window", "n", r6("mean").alias("mean"), "low", "high")


@register("count_tumbling_window", f"""
with s as ({SCORES}) select user_id, idx // 5 as "window", min(idx) as start, round(list(value order by idx)[1], 6) as first, round(sum(value), 6) as total
from s group by user_id, idx // 5 having count(*) = 5""")
def count_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = windows.count_windows(scores(spark, sf_dir), 5, stream="user_id")
    return framed.select("user_id", "window", "start", r6(F.element_at("samples", 1)).alias("first"), r6(V.total("samples")).alias("total"))


@register("event_tumble", """
select time_bucket(interval '1 hour', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def event_tumble(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


@register("event_hop", """
with k as (select value, event_type, unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval '30 minutes']) as start from events)
select start, event_type, count(*) as n, round(avg(value), 4) as mean from k group by 1, 2""")
def event_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


@register("event_session", """
with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '6 hours' then 0 else 1 end as new from events),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as session from g)
select user_id, min(ts) as start, count(*) as n from s group by user_id, session""")
def event_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


@register("recent_ratio", f"""
with s as ({SCORES}), w as (select user_id, idx, event_type, list(event_type) over (partition by user_id order by idx rows between 19 preceding and current row) as l from s)
select user_id, idx, event_type, round(len(list_filter(l, lambda x: x = event_type))::double / len(l), 6) as ratio from w""")
def recent_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.recent_share(scores(spark, sf_dir), "user_id", "idx", "event_type").select("user_id", "idx", "event_type", r6("ratio").alias("ratio"))


@register("first_seen", f"with s as ({SCORES}) select user_id, idx, event_type, row_number() over (partition by user_id, event_type order by idx) = 1 as is_first from s")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.first_seen(scores(spark, sf_dir), "user_id", "idx", "event_type").select("user_id", "idx", "event_type", "is_first")


@register("running_count", f"with s as ({SCORES}) select user_id, idx, (sum((prob > 0.5)::int) over (partition by user_id order by idx rows unbounded preceding))::bigint as running from s")
def running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.running_count(scores(spark, sf_dir), "user_id", "idx", F.col("prob") > 0.5).select("user_id", "idx", "running")


@register("lag_difference", f"with s as ({SCORES}) select user_id, idx, round(coalesce(value - 0.97::double * lag(value) over (partition by user_id order by idx), value), 6) + 0.0 as emphasised from s")
def lag_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.lag_difference(scores(spark, sf_dir), "user_id", "idx", "value", 0.97).select("user_id", "idx", r6("emphasised").alias("emphasised"))


@register("speaking_gate", f"""
with s as ({SCORES}) select user_id, idx // 20 as block, count(*) filter (where event_id % 5 in (2, 4)) as speech, count(*) filter (where event_id % 5 in (2, 4)) >= 6 as speaking
from s group by user_id, idx // 20""")
def speaking_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = scores(spark, sf_dir).withColumn("code", F.col("event_id") % 5)
    return windows.speaking_gate(coded, "user_id", "idx", "code")


@register("split_long_segments", """
with s as (select event_id, 0::bigint as start, (value * 3000)::bigint as "end" from events), p as (select *, unnest(generate_series(0, greatest(0, ceil("end" / 464000.0)::bigint - 1))) as piece from s)
select event_id, piece, start + piece * 464000 as start, least("end", start + (piece + 1) * 464000) as "end" from p""")
def split_long_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "events").select("event_id", F.lit(0).cast("long").alias("start"), F.round(F.col("value") * 3000).cast("long").alias("end"))
    return windows.split_long(segments).select("event_id", "piece", "start", "end")


CHUNKS, FRAMES, PER_CHUNK = timeline.Geometry(0.0, 0.5, 1.0), timeline.Geometry(0.0, 0.1, 0.1), 10
FRAME_SCORES = 'select event_id // 30 as chunk, (event_id // 3) % 10 as frame, (event_id % 3)::int as "class", round(least(1.0::double, value / 100), 6) as score from events'
GLOBAL = "round_even(greatest(0.0::double, (0.5::double * chunk - 0.05::double) / 0.1::double), 0)::bigint + frame"


def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.expr("event_id div 30").alias("chunk"), F.expr("(event_id div 3) % 10").alias("frame"), (F.col("event_id") % 3).cast("int").alias("class"), F.round(F.least(F.lit(1.0), F.col("value") / 100), 6).alias("score"))


BINARY = f"""select chunk, frame, "class", score, coalesce(last_value(case when score > 0.6 then true when score < 0.4 then false end ignore nulls)
  over (partition by chunk, "class" order by frame rows unbounded preceding), false) as active from ({FRAME_SCORES})"""


@register("hysteresis_fill", BINARY)
def hysteresis_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.binarised(frame_scores(spark, sf_dir), 0.6, 0.4)


@register("clean_overlaps", f"""
with s as (select chunk, frame, "class", (score > 0.5)::int::double as score from ({FRAME_SCORES}))
select *, case when sum(score) over (partition by chunk, frame) < 2 then score else 0.0 end as clean from s""")
def clean_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.without_overlaps(frame_scores(spark, sf_dir).withColumn("score", (F.col("score") > 0.5).cast("double")))


@register("mask_choice", f"""
with s as (select chunk, frame, "class", (score > 0.5)::int::double as score from ({FRAME_SCORES})),
c as (select *, case when sum(score) over (partition by chunk, frame) < 2 then score else 0.0 end as clean from s)
select chunk, frame, "class", case when sum(clean) over (partition by chunk, "class") > 2 then clean else score end as mask from c""")
def mask_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    binary = frame_scores(spark, sf_dir).withColumn("score", (F.col("score") > 0.5).cast("double"))
    return timeline.mask_choice(timeline.without_overlaps(binary), 2).select("chunk", "frame", "class", "mask")


ADDED = f"""select frame, "class", sum(score) / count(*) as value from (select {GLOBAL} as frame, "class", score from ({FRAME_SCORES})) group by frame, "class" """


@register("overlap_add", f'select frame, "class", round(value, 6) as value from ({ADDED})')
def overlap_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.overlap_added(frame_scores(spark, sf_dir), CHUNKS, FRAMES).withColumn("value", r6("value"))


COUNTS = f"""select {GLOBAL} as frame, round_even(avg(n), 0)::bigint as "count" from (
  select chunk, frame, sum(active::int)::double as n from ({BINARY}) where frame between 1 and 8 group by chunk, frame) group by 1"""


@register("active_count", COUNTS)
def active_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.active_count(timeline.binarised(frame_scores(spark, sf_dir), 0.6, 0.4), CHUNKS, FRAMES, PER_CHUNK)


@register("variable_topk", f"""
with a as ({ADDED}), c as ({COUNTS})
select frame, "class", round(value, 6) as value, row_number() over (partition by frame order by value desc, "class") <= "count" as "on" from a join c using (frame)""")
def variable_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = frame_scores(spark, sf_dir)
    counts = timeline.active_count(timeline.binarised(s, 0.6, 0.4), CHUNKS, FRAMES, PER_CHUNK)
    return timeline.top_per_frame(timeline.overlap_added(s, CHUNKS, FRAMES), counts).withColumn("value", r6("value"))


LOCAL = f'select distinct chunk, "class", case when (chunk + "class") % 5 = 0 then -2 else ((chunk + "class") % 2)::int end as cluster from ({FRAME_SCORES})'


def local_clusters(s: DataFrame) -> DataFrame:
    k = F.col("chunk") + F.col("class")
    return s.select("chunk", "class").distinct().withColumn("cluster", F.when(k % 5 == 0, -2).otherwise((k % 2).cast("int")))


@register("cluster_maxima", f"""
select chunk, frame, cluster as "class", max(score) as score from ({FRAME_SCORES}) join ({LOCAL}) using (chunk, "class") where cluster <> -2 group by chunk, frame, cluster""")
def cluster_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = frame_scores(spark, sf_dir)
    return timeline.cluster_maxima(s, local_clusters(s))


@register("reconstruct", f"""
with m as (select chunk, frame, cluster as "class", max(score) as score from ({FRAME_SCORES}) join ({LOCAL}) using (chunk, "class") where cluster <> -2 group by chunk, frame, cluster),
a as (select {GLOBAL} as frame, "class", sum(score) as value from m group by 1, 2), c as ({COUNTS})
select frame, "class", round(value, 6) as value, row_number() over (partition by frame order by value desc, "class") <= "count" as "on" from a join c using (frame)""")
def reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = frame_scores(spark, sf_dir)
    counts = timeline.active_count(timeline.binarised(s, 0.6, 0.4), CHUNKS, FRAMES, PER_CHUNK)
    return timeline.reconstructed(s, local_clusters(s), counts, CHUNKS, FRAMES).withColumn("value", r6("value"))


@register("inactive_unassigned", f"""
with b as (select chunk, "class", bool_or(score > 0.9) as ever from ({FRAME_SCORES}) group by chunk, "class")
select chunk, "class", case when ever then cluster else -2 end as cluster from ({LOCAL}) join b using (chunk, "class")""")
def inactive_unassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = frame_scores(spark, sf_dir)
    return timeline.inactive_as_unassigned(s.withColumn("active", F.col("score") > 0.9), local_clusters(s))


@register("mean_activity", f'select chunk, "class", round(avg(score), 6) as activity from ({FRAME_SCORES}) where frame >= 4 group by chunk, "class"')
def mean_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.mean_activity(frame_scores(spark, sf_dir), 4).withColumn("activity", r6("activity"))


@register("change_points", f"""
with m as (select chunk, "class", avg(score) as activity from ({FRAME_SCORES}) group by chunk, "class"),
t as (select chunk, arg_max("class", (activity, -"class")) as "class", max(activity) as activity, chunk // 50 as stream from m group by chunk),
h as (select *, coalesce(lag("class") over (partition by stream order by chunk), 0) as before from t where activity > 0.3)
select stream, chunk, "class", round(activity, 6) as activity from h where "class" <> before""")
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = timeline.mean_activity(frame_scores(spark, sf_dir), 0)
    top = means.groupBy("chunk").agg(F.max_by("class", F.struct("activity", -F.col("class"))).alias("class"), F.max("activity").alias("activity")).withColumn("stream", F.expr("chunk div 50"))
    return timeline.change_points(top, "stream", "chunk", 0.3).select("stream", "chunk", "class", r6("activity").alias("activity"))


@register("trimmed_frames", f"select chunk, frame, \"class\", score from ({FRAME_SCORES}) where frame between 1 and 8")
def trimmed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.trimmed(frame_scores(spark, sf_dir), 10, 0.1, 0.1)


@register("cropped_frames", f"""select frame, "class", round(value, 6) as value from ({ADDED}) where frame >= ceil((10.0::double - 0.1::double) / 0.1::double) and frame <= floor(12.0::double / 0.1::double)""")
def cropped_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.cropped(timeline.overlap_added(frame_scores(spark, sf_dir), CHUNKS, FRAMES), FRAMES, 10.0, 12.0).withColumn("value", r6("value"))


STREAM_FRAMES = f'select user_id as "class", idx as frame, prob as value from ({SCORES})'
INTERVALS = f"""
with f as ({STREAM_FRAMES}), h as (select *, coalesce(last_value(case when value > 0.6 then true when value < 0.4 then false end ignore nulls) over (partition by "class" order by frame rows unbounded preceding), false) as "on" from f),
e as (select *, "on" and not coalesce(lag("on") over w, false) as opens, lead(frame) over w as nxt from h window w as (partition by "class" order by frame)),
r as (select *, sum(opens::int) over (partition by "class" order by frame rows unbounded preceding) as run from e),
i as (select "class", run, min(frame) as first, max(coalesce(nxt, frame)) as last from r where "on" group by "class", run)
select "class", 0.0::double + first * 1.0::double + 0.5::double * 1.0::double as start, 0.0::double + last * 1.0::double + 0.5::double * 1.0::double as "end" from i where last > first"""
UNIT = timeline.Geometry(0.0, 1.0, 1.0)


def stream_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = scores(spark, sf_dir).select(F.col("user_id").alias("class"), F.col("idx").alias("frame"), F.col("prob").alias("value"))
    return timeline.on_off_intervals(frames, UNIT, 0.6, 0.4)


@register("onoff_intervals", INTERVALS)
def onoff_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_intervals(spark, sf_dir)


MERGED = f"""
with i as ({INTERVALS}), g as (select *, max("end") over (partition by "class" order by start, "end" rows between unbounded preceding and 1 preceding) as reach from i),
n as (select *, case when reach is null or greatest(0, start - reach) >= 3 then 1 else 0 end as new from g),
s as (select *, sum(new) over (partition by "class" order by start, "end" rows unbounded preceding) as island from n)
select "class", min(start) as start, max("end") as "end" from s group by "class", island"""


@register("interval_merge", MERGED)
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.merged_intervals(stream_intervals(spark, sf_dir), 3.0)


@register("drop_short", f"""
select "class", start, "end" from (select *, row_number() over (partition by "class" order by start, "end") as rn from ({INTERVALS})) where "end" - start >= 2 or rn = 1""")
def drop_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.without_short(stream_intervals(spark, sf_dir), 2.0)


@register("dense_labels", "select event_id, event_type, (dense_rank() over (order by event_type) - 1)::bigint as rank from events")
def dense_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.dense_labels(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type").select("event_id", "event_type", "rank")


@register("renumber_by_first", """
with f as (select event_type, (row_number() over (order by min(event_id), event_type) - 1)::bigint as renumbered from events group by event_type)
select event_id, event_type, renumbered from events join f using (event_type)""")
def renumber_by_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.renumbered(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id").select("event_id", "event_type", "renumbered")


@register("status_lines", f"""
with s as ({SCORES}) select user_id, format('{{}}/{{}}/{{:.2f}}', arg_max(event_id, idx), arg_max((event_id % 2)::int, idx), arg_max(prob, idx)) as status from s group by user_id""")
def status_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavemill.sources import tables

    rows = scores(spark, sf_dir).select("user_id", "idx", F.col("event_id").alias("ident"), (F.col("event_id") % 2 == 1).alias("is_first"), F.col("prob").alias("ratio"))
    return tables.latest_status(rows, "user_id", "idx")


@register("hyp_logadd_merge", """
with h as (select user_id as utt, event_type as key, -value / 50 as log_prob from events), t as (select utt, key, max(log_prob) as top from h group by utt, key)
select utt, key, count(*) as n, round(max(top) + ln(sum(exp(log_prob - top))), 6) + 0.0 as log_prob from h join t using (utt, key) group by utt, key""")
def hyp_logadd_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").select(F.col("user_id").alias("utt"), F.col("event_type").alias("key"), (-F.col("value") / 50).alias("log_prob"))
    return decoding.merged_hypotheses(h, "utt", "key").select("utt", "key", "n", r6("log_prob").alias("log_prob"))


@register("best_hyp", """
with h as (select user_id as utt, event_id as key, -value / 50 as log_prob, 2 + event_id % 7 as len from events),
r as (select *, row_number() over (partition by utt order by log_prob / len desc, key) as rank from h)
select utt, key, rank, round(log_prob / len, 6) + 0.0 as score from r where rank <= 4""")
def best_hyp(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "events").select(F.col("user_id").alias("utt"), F.col("event_id").alias("key"), (-F.col("value") / 50).alias("log_prob"), (2 + F.col("event_id") % 7).alias("len"))
    return decoding.best_hypotheses(h, "utt", 4, F.col("log_prob"), F.col("len")).select("utt", "key", F.col("rank").cast("long").alias("rank"), r6("hyp_score").alias("score"))


@register("lm_rescoring", """
with h as (select user_id as utt, event_id as key, -value / 50 as log_prob from events)
select utt, key, round(log_prob - 0.5::double * (key % 11), 6) + 0.0 as total from h""")
def lm_rescoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    h = e.select(F.col("user_id").alias("utt"), F.col("event_id").alias("key"), (-F.col("value") / 50).alias("log_prob"))
    nll = e.select(F.col("event_id").alias("key"), (F.col("event_id") % 11).cast("double").alias("nll"))
    return decoding.with_lm(h, nll, ["key"]).select("utt", "key", r6(F.col("log_prob") + F.col("lm_log_prob")).alias("total"))


@register("log_add", """
select event_id, round(greatest(-value / 50, -value / 70 - 1) + ln(1 + exp(-abs(-value / 50 + value / 70 + 1))), 6) + 0.0 as x from events""")
def log_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", r6(V.log_add(-v / 50, -v / 70 - 1)).alias("x"))


@register("json_props", "select event_id, json_extract(props, '$.k')::bigint as k from events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@register("result_json", """select event_id, '{"text":"' || event_type || '","timestamps":[' || (round(value, 2))::varchar || '],"tokens":["' || event_type || '"]}' as json from events""")
def result_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", X.result_json(F.col("event_type"), F.array("value"), F.array("event_type")).alias("json"))


# --- arrays of arrays ----------------------------------------------------------------------------------------------------

_ROWS = "list_transform(generate_series(0, 7), lambda i: v[i * 8 + 1 : i * 8 + 8])"


def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as eight rows of eight."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    return embeddings(spark, sf_dir).select("vec_id", "label", rows.alias("m"))


def _matrix_query(name: str, transform: Callable[[Column], Column], sql: str) -> None:
    """A query that maps the matrix m of each embedding to another, listed by row and column."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = matrices(spark, sf_dir).select("vec_id", F.posexplode(transform(F.col("m"))).alias("row", "r")).select("vec_id", "row", F.posexplode("r").alias("col", "x"))
        return rows.select("vec_id", F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), r6("x").alias("x"))

    run.__name__ = name
    register(name, f"""
with e as ({EMB}), m as (select vec_id, {_ROWS} as m from e), o as (select vec_id, {sql} as o from m),
r as (select vec_id, unnest(o) as r, unnest(generate_series(0, len(o) - 1)) as "row" from o)
select vec_id, "row", col, round(x, 6) + 0.0 as x from (select vec_id, "row", unnest(r) as x, unnest(generate_series(0, len(r) - 1)) as col from r)""")(run)


_matrix_query("concat_rows", lambda m: arrays.concatenated(m, m, dim=0), "list_concat(m, m)")
_matrix_query("concat_columns", lambda m: arrays.concatenated(m, F.reverse(m), dim=1), "list_transform(m, lambda r, i: list_concat(r, m[9 - i]))")
_matrix_query("stack", lambda m: arrays.stacked(F.get(m, F.lit(0)), F.get(m, F.lit(3)), F.get(m, F.lit(7))), "[m[1], m[4], m[8]]")
_matrix_query("index_select", lambda m: arrays.index_selected(m, F.array(*map(F.lit, (7, 0, 0, 3)))), "[m[8], m[1], m[1], m[4]]")
_matrix_query("frame_slice", lambda m: F.array(arrays.frame_at(m, F.lit(2))), "[m[3]]")
_matrix_query("repeat_rows", lambda m: arrays.repeated(m, F.array(*map(F.lit, (0, 2, 2, 3, 4, 6, 6, 7, 10)))), "[m[1], m[1], m[3], m[4], m[5], m[5], m[7], m[8], m[8], m[8]]")
_matrix_query("whisper_frames", lambda m: arrays.tail_padded(m, most=10, least_padding=3, padding=4), "list_concat(m[1:7], [[0.0::double, 0, 0, 0, 0, 0, 0, 0], [0.0::double, 0, 0, 0, 0, 0, 0, 0], [0.0::double, 0, 0, 0, 0, 0, 0, 0]])")


@register("unbind", f"""
with e as ({EMB}), m as (select vec_id, {_ROWS} as m from e), r as (select vec_id, unnest(m) as r, unnest(generate_series(0, 7)) as part from m)
select vec_id, part, col, round(x, 6) + 0.0 as x from (select vec_id, part, unnest(r) as x, unnest(generate_series(0, len(r) - 1)) as col from r)""")
def unbind(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = arrays.unbound(matrices(spark, sf_dir), "m").select("vec_id", F.col("part").cast("long").alias("part"), F.posexplode(F.get("slice", F.lit(0))).alias("col", "x"))
    return parts.select("vec_id", "part", F.col("col").cast("long").alias("col"), r6("x").alias("x"))


@register("sliding_chunks", f"""
with s as ({SCORES}), n as (select user_id, count(*) as n from s group by user_id), g as (
  select user_id, n, case when n >= 5 then (n - 5) // 2 + 1 else 0 end as whole from n
), c as (select user_id, unnest(generate_series(0, whole - (case when n < 5 or (n - 5) % 2 > 0 then 0 else 1 end))) as chunk, whole from g)
select c.user_id, chunk, count(*) as filled, 5 as size, round(sum(prob), 6) as total, chunk >= whole as tail
from c join s on s.user_id = c.user_id and idx >= chunk * 2 and idx < chunk * 2 + 5 group by c.user_id, chunk, whole""")
def sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scores(spark, sf_dir).select("user_id", "idx", F.col("prob").alias("value"))
    found = windows.sliding_chunks(rows, 5, 2, stream="user_id")
    return found.select("user_id", "chunk", "filled", F.size("samples").alias("size"), r6(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)).alias("total"), "tail")


@register("unread_length", f"with s as ({SCORES}) select user_id, count(*) - (case when count(*) >= 7 then ((count(*) - 7) // 3 + 1) * 3 else 0 end) as unread from s group by user_id")
def unread_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.unread(scores(spark, sf_dir).select("user_id", "idx"), 7, 3, stream="user_id")


# --- text ----------------------------------------------------------------------------------------------------------------

DELIMITER_CLASS = "[.,;:!?，。]+"


@register("text_segments", f"""
with p as (select doc_id, list_filter(regexp_split_to_array(text, '{DELIMITER_CLASS}'), lambda x: x <> '') as parts from documents where text is not null)
select doc_id, pos, segment from (select doc_id, unnest(generate_series(0, len(parts) - 1)) as pos, unnest(parts) as segment from p)""")
def text_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "segment")).withColumn("pos", F.col("pos").cast("long"))


@register("lower_ascii", "select conv_id, turn, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lowered from conversations")
def lower_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.lower_ascii(F.col("text")).alias("lowered"))


@register("token_join", """
with w as (select conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda x: x <> '') as parts from conversations)
select conv_id, turn, len(parts) as n, array_to_string(parts, '') as joined, array_to_string(parts, '-') as key from w""")
def token_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = X.split_blanks(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(parts).cast("long").alias("n"), X.join_pieces(parts).alias("joined"), X.hypothesis_key(parts).alias("key"))


@register("trimmed_text", r"select item_id, regexp_replace(text, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') as trimmed, regexp_split_to_array(text, 'e')[1] as head from benchmark")
def trimmed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", X.trimmed(F.col("text")).alias("trimmed"), F.element_at(X.split_literal(F.col("text"), "e"), 1).alias("head"))


VOCABULARY = r"""
with w as (select unnest(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')) as word from benchmark)
select word, (row_number() over (order by word) - 1)::bigint as id from (select distinct word from w)"""


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words numbered in order: within their first three characters, plus the words of all smaller beginnings, so that no task sorts all words."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(X.split_blanks(F.col("text"))).alias("word")).distinct().withColumn("head", F.substring("word", 1, 3))
    heads = words.groupBy("head").agg(F.count(F.lit(1)).alias("n"))
    bases = heads.select("head", (F.sum("n").over(Window.orderBy("head")) - F.col("n")).alias("base"))
    place = F.row_number().over(Window.partitionBy("head").orderBy("word")) - 1
    return words.join(bases, "head").select("word", (F.col("base") + place).cast("long").alias("id"))


@register("vocab_lookup", rf"""
with v as ({VOCABULARY}), w as (select doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')) as word from documents)
select doc_id, count(*) as words, count(id) as known, count(*) - count(id) as missing from w left join v using (word) group by doc_id""")
def vocab_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(X.split_blanks(F.col("text"))).alias("word"))
    joined = words.join(vocabulary(spark, sf_dir), "word", "left")
    return joined.groupBy("doc_id").agg(F.count(F.lit(1)).alias("words"), F.count("id").alias("known"), F.count_if(F.col("id").isNull()).alias("missing"))


@register("hotword_hits", r"""
with p as (select item_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> ''), ' ') as phrase from benchmark),
d as (select doc_id, ' ' || array_to_string(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> ''), ' ') || ' ' as line from documents)
select doc_id, item_id from d join p on phrase <> '' and contains(line, ' ' || phrase || ' ')""")
def hotword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", X.split_blanks(F.col("text")).alias("words"))
    phrases = table(spark, sf_dir, "benchmark").select("item_id", X.split_blanks(F.col("text")).alias("words"))
    return match.phrase_hits(texts, phrases, "doc_id", "item_id")


@register("phoneme_ids", f"""
with c as (select item_id, list_filter(string_split(lower(regexp_replace(text, '[^A-Za-z ,.]', '', 'g')), ''), lambda c: c <> 'g') as chars from benchmark)
select item_id, list_concat([1, 0], list_concat(flatten(list_transform(chars, lambda c: [strpos('{X.PHONEMES.replace("'", "''")}', c) - 1, 0])), [2]))::bigint[] as ids from c""")
def phoneme_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^A-Za-z ,.]", "").alias("text"))
    ids = X.phoneme_ids(F.split(F.lower("text"), ""), X.default_phoneme_map())
    return clean.select("item_id", ids.alias("ids"))


@register("missing_phonemes", """
with c as (select item_id, unnest(string_split(text, '')) as c from benchmark)
select c as phoneme, count(*) as n from c where not regexp_matches(c, '[a-fh-z ,.!?''():;-]') and c not in ('"') group by c""")
def missing_phonemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = {c: [0] for c in "abcdefhijklmnopqrstuvwxyz ,.!?'():;-" + '"'}
    return X.missing_phoneme_counts(table(spark, sf_dir, "benchmark").select(F.split("text", "").alias("phonemes")), "phonemes", ids)


@register("integers_and_reals", """
select event_id, try_cast(replace(props, '{"k": ', '') as int) as bad, regexp_extract(props, '[0-9]+')::int as k, (value::varchar)::double as value from events""")
def integers_and_reals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    bad = F.get(X.to_integers(F.replace(F.col("props"), F.lit('{"k": '), F.lit(""))), F.lit(0))
    k = F.get(X.to_integers(F.regexp_extract("props", "[0-9]+", 0)), F.lit(0))
    return e.select("event_id", bad.alias("bad"), k.alias("k"), X.to_real(F.col("value").cast("string")).alias("value"))


# --- sequential, iterative and numerical operators (no SQL; held against brute force in the tests) ---------------------------


@register("vad_segments")
def vad_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vad.speech_segments(scores(spark, sf_dir), vad.SpeechConfig(threshold=0.5, min_speech=512, min_silence=160), stream="user_id")


@register("vad_gate")
def vad_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vad.gate_codes(scores(spark, sf_dir), vad.GateConfig(), stream="user_id")


def _vector_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).withColumn("stream_id", F.col("vec_id") % GROUPS)


@register("online_tracker")
def online_tracker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.tracked(_vector_stream(spark, sf_dir), "stream_id", "vec_id", threshold=0.2)


class Table:
    """A decoder whose logits are the frame of the number of tokens so far, so that its answer can be told from the frames."""

    def __call__(self, memory, tokens):
        return memory[min(len(tokens), len(memory)) - 1]


@register("prompted_greedy", f"""
with e as ({EMB}), m as (select vec_id, list_transform(generate_series(0, 7), lambda i: v[i * 8 + 1 : i * 8 + 8]) as m from e),
s as (select vec_id, case when m[1][7] > m[1][6] and m[1][7] >= m[1][8] then 6 when m[1][8] > m[1][6] then 7 else 5 end as lang, m from m),
b as (select vec_id, lang, list_transform(generate_series(4, 7), lambda i: list_position(m[i], list_max(m[i])) - 1) as best from s),
c as (select vec_id, lang, best, list_position(best, 0) as stop from b)
select vec_id, lang as language, case when stop is null or stop = 0 then best else best[1 : stop - 1] end::bigint[] as tokens from c""")
def prompted_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decoding.prompted(matrices(spark, sf_dir), Table(), end_id=0, start_id=1, task_id=2, no_times_id=3, language_ids=[5, 6, 7], context=16, key="vec_id", frames="m")
    return found.select("vec_id", "language", F.col("tokens").cast("array<long>").alias("tokens"))


@register("change_detector")
def change_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.changes(_vector_stream(spark, sf_dir), "stream_id", "vec_id", threshold=0.2)


@register("online_diarize")
def online_diarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracking.diarised(_vector_stream(spark, sf_dir), "stream_id", "vec_id", threshold=0.3)


@register("centroid_linkage")
def centroid_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.clustered(_vector_stream(spark, sf_dir), "stream_id", "vec_id", cutoff=1.1, min_large=2)


@register("dendrogram")
def dendrogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.dendrogram(_vector_stream(spark, sf_dir), "stream_id", "vec_id")


def _lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as utterances of eight frames of eight logits."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("embedding", t * 8 + 1, F.lit(8)))
    return embeddings(spark, sf_dir).select(F.col("vec_id").alias("utt"), frames.alias("frames"))


@register("greedy_search", """
with f as (select vec_id as utt, t, embedding[t * 8 + 1 : t * 8 + 8] as row from embeddings, generate_series(0, 7) as g(t)),
b as (select utt, t, list_position(row, list_max(row)) - 1 as token from f)
select utt, coalesce(string_agg(token::varchar, ' ' order by t) filter (where token <> 0), '') as tokens, coalesce(string_agg(t::varchar, ' ' order by t) filter (where token <> 0), '') as times from b group by utt""")
def greedy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = decoding.greedy_column(F.col("frames"))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    return _lattice(spark, sf_dir).select("utt", best.alias("best")).select("utt", text("best.tokens").alias("tokens"), text("best.frames").alias("times"))


@register("greedy_until_end", """
with f as (select vec_id as utt, t, embedding[t * 8 + 1 : t * 8 + 8] as row from embeddings, generate_series(0, 7) as g(t)),
b as (select utt, t, list_position(row, list_max(row)) - 1 as token from f), s as (select *, min(case when token = 2 then t else 99 end) over (partition by utt) as stop from b)
select utt, coalesce(string_agg(token::varchar, ' ' order by t) filter (where t < stop), '') as tokens from s group by utt""")
def greedy_until_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = decoding.until_end(F.col("frames"), 2)
    return _lattice(spark, sf_dir).select("utt", F.array_join(F.transform(tokens, lambda x: x.cast("string")), " ").alias("tokens"))


@register("best_language", """
with l as (select vec_id, unnest([3, 9, 17, 33]) as id, embedding from embeddings)
select vec_id, arg_max(id, embedding[id + 1])::int as language from l group by vec_id""")
def best_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings(spark, sf_dir).select("vec_id", decoding.best_language(F.col("embedding"), [3, 9, 17, 33]).alias("language"))


def loud(window) -> bool:
    return int((window > 50).sum()) >= 4


def quiet_count(window) -> str:
    return f"{int((window < 5).sum())} of {len(window)}"


@register("wake_then_text", f"""
with recursive s as ({SCORES}), w as (
  select user_id, idx, sum((value > 50)::int) over next6 >= 4 as wakes, count(*) over next6 = 6 as full6, sum((value < 5)::int) over next10 as quiet, count(*) over next10 = 10 as full10 from s
  window next6 as (partition by user_id order by idx rows between current row and 5 following), next10 as (partition by user_id order by idx rows between current row and 9 following)
), walk as (
  select distinct user_id, 0::bigint as pos, false as listening from s
  union all
  select w.user_id, pos + case when listening then 9 when wakes then 6 else 2 end, not listening and wakes from walk join w on w.user_id = walk.user_id and w.idx = pos where case when listening then full10 else full6 end
)
select w.user_id, case when listening then 'text' else 'wake' end as kind, pos as start, pos + case when listening then 10 else 6 end as "end", case when listening then quiet || ' of 10' end as text
from walk join w on w.user_id = walk.user_id and w.idx = pos where case when listening then full10 else full6 and wakes end""")
def wake_then_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = folds.WakeThenText(loud, quiet_count, wake_window=6, wake_hop=2, text_window=10, text_hop=9)
    return folds.folded(scores(spark, sf_dir), program, "user_id")


def thirds(windows_of_samples):
    """A segmentation whose frames are samples: class k is active where the whole part of a sample leaves k, divided by 3."""
    return (windows_of_samples.astype("int64")[:, :, None] % 3 == [0, 1, 2]).astype(float)


@register("speaker_change", f"""
with s as ({SCORES}), k as (select user_id, floor(value)::bigint % 3 as class, unnest(range(greatest(0, (idx - 9) // 3), idx // 3 + 1)) as w, idx from s),
n as (select user_id, max(idx) + 1 as n from s group by user_id),
c as (select user_id, w, class, count(*) as c from k join n using (user_id) where idx >= w * 3 + 2 and idx < w * 3 + 12 and w * 3 + 12 <= n group by user_id, w, class),
best as (select user_id, w, class, c / 10 as activity, row_number() over (partition by user_id, w order by c desc, class) as place from c),
heard as (select user_id, w, class, activity, coalesce(lag(class) over (partition by user_id order by w), 0) as before from best where place = 1 and activity > 0.35)
select user_id, w * 3 as start, class::int as class, round(activity, 6) as activity from heard where class <> before""")
def speaker_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = folds.SpeakerChange(thirds, window=12, hop=3, skip=2, least=0.35)
    return folds.folded(scores(spark, sf_dir), program, "user_id").withColumn("activity", r6("activity"))


def loudness(pieces):
    return (pieces.mean(axis=1) / 100).clip(0, 1)


def shape(window):
    """Four means of a window less their mean, as if it were a speaker's embedding."""
    parts = window.reshape(4, -1).mean(axis=1)
    return parts - parts.mean()


def _speakers(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    program = tracking.SpeakerTrack(loudness, shape, window=12, hop=4, gate=vad.GateConfig(window=3, threshold=0.5, min_silence=3), least=2, threshold=0.9, **options)
    return folds.folded(scores(spark, sf_dir), program, "user_id").withColumn("ratio", r6("ratio"))


@register("speaker_track")
def speaker_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _speakers(spark, sf_dir)


@register("speaker_change_by_identity")
def speaker_change_by_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _speakers(spark, sf_dir, changes=True).where("change").select("user_id", "start", "ident")


@register("bounded_buffer", f"""
with recursive s as ({SCORES}), n as (select user_id, count(*) as n from s group by user_id),
walk as (
  select user_id, 0::bigint as written, 0::bigint as kept, 0::bigint as lost, 0::bigint as pos, false as was_read, n from n
  union all
  select user_id, written + 4, kept + lost_now + case when read_now then 3 else 0 end, lost_now, kept, read_now, n
  from (select *, written + 4 - (kept + lost_now) >= 6 as read_now from (select user_id, written, kept, n, greatest(0, written + 4 - kept - 12) as lost_now from walk where written + 4 <= n))
), rows as (
  select user_id, 'overrun' as kind, pos as start, lost as n from walk where lost > 0
  union all select user_id, 'window', pos + lost, 6 from walk where was_read
  union all select user_id, 'rest', kept, n - kept from walk where written + 4 > n and n > kept
)
select r.user_id, kind, start, n, case when kind <> 'overrun' then round(sum(value), 6) end as total
from rows r join s on s.user_id = r.user_id and s.idx >= start and s.idx < start + n group by r.user_id, kind, start, n""")
def bounded_buffer(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = folds.BoundedBuffer(capacity=12, block=4, window=6, hop=3)
    found = folds.folded(scores(spark, sf_dir), program, "user_id")
    return found.select("user_id", "kind", "start", "n", r6(F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@register("beam_search_in_batches")
def beam_search_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Utterances of one to eight frames, each boosted by a list for all and by its label's own phrases."""
    own = F.array(F.array(F.col("label") % 8, (F.col("label") + 1) % 8), F.array((F.col("label") + 3) % 8))
    frames = F.transform(F.sequence(F.lit(0), (F.col("vec_id") % 8).cast("int")), lambda t: F.slice("embedding", t * 8 + 1, F.lit(8)))
    utterances = embeddings(spark, sf_dir).select(F.col("vec_id").alias("utt"), frames.alias("frames"), own.alias("own"))
    return batched.decoded(utterances, phrases=[[1, 2], [3, 4, 5], [4, 5]], own_phrases="own")


@register("beam_search")
def beam_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decoding.decoded(_lattice(spark, sf_dir), "modified_beam_search", phrases=[[1, 2], [3, 4, 5], [4, 5]])


@register("mel_features")
def mel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mel frames, mirrored at the ends, of the events' values as a signal for each user."""
    frames = folds.folded(scores(spark, sf_dir), signals.MelFrames(bins=4, length=16, shift=5, reflect=True), "user_id")
    return frames.select("user_id", "frame", F.posexplode("feat").alias("bin", "energy")).withColumn("energy", r6("energy"))


@register("resample")
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' values as a signal for each user, at two thirds of its rate."""
    return folds.folded(scores(spark, sf_dir), signals.Resampled(3, 2), "user_id").withColumn("sample", r6("sample"))


@register("phoneme_sentences", r"""
with s as (select conv_id, turn, unnest(regexp_extract_all(text, '[^.?!]*[.?!]?')) as s, generate_subscripts(regexp_extract_all(text, '[^.?!]*[.?!]?'), 1) as place from conversations),
c as (select conv_id, turn, place, unnest(regexp_extract_all(s, '[^.?!,:;]*[.?!,:;]?')) as c, generate_subscripts(regexp_extract_all(s, '[^.?!,:;]*[.?!,:;]?'), 1) as part from s),
p as (select conv_id, turn, place, part, trim(regexp_replace(c, '[.?!,:;]$', '')) as words, regexp_extract(c, '[.?!,:;]$') as sign from c),
j as (select conv_id, turn, place, string_agg(case when words = '' then '' else regexp_replace(lower(words), '\([^)]*(\)|$)', '', 'g') || sign || case when sign in (',', ':', ';') then ' ' else '' end end, '' order by part) as phonemes
  from p group by conv_id, turn, place)
select conv_id, turn, row_number() over (partition by conv_id, turn order by place) - 1 as sentence, phonemes from j where phonemes <> ''""")
def phoneme_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(X.phoneme_sentences(F.col("text"))).alias("sentence", "phonemes"))
    return said.withColumn("sentence", F.col("sentence").cast("long"))


#: A longer phrase list is an error.
MAX_PHRASE_CHARS = 1 << 23


@register("phrase_graph")
def phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boost of each document by the benchmark's texts as whole phrases (in the order of their ids), through the phrase automaton."""
    import pandas as pd

    given = table(spark, sf_dir, "benchmark").select("item_id", "text")
    size = given.agg(F.sum(F.char_length("text"))).first()[0] or 0
    if size > MAX_PHRASE_CHARS:
        raise ValueError(f"the phrases have {size} characters; every task holds their graph, and MAX_PHRASE_CHARS is {MAX_PHRASE_CHARS}")
    phrases = [(r["text"] or "").split() for r in given.orderBy("item_id", "text").collect()]

    def run(batches):
        ids: dict[str, int] = {}
        graph = decoding.PhraseGraph([[ids.setdefault(w, len(ids)) for w in p] for p in phrases], 1.5)
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                state, boost = graph.root, 0.0
                for word in (text or "").split():
                    state, gain = graph.step(state, ids.get(word, -1))
                    boost += gain
                out.append(boost + graph.finish(state))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "boost": out})

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, boost double")


@register("annotate_pipeline")
def annotate_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavemill.plans import pipelines

    s = frame_scores(spark, sf_dir)
    return pipelines.annotate(s, local_clusters(s), CHUNKS, FRAMES, PER_CHUNK, collar=0.3, least=0.2)


@register("speech_to_text_pipeline")
def speech_to_text_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wavemill.plans import pipelines, scorers

    samples = scores(spark, sf_dir).select(F.col("user_id").alias("stream_id"), "idx", (F.col("value") / 100).alias("value"))
    return pipelines.speech_to_text(samples, scorers.EnergyVad(0.2), scorers.Spelled(), vad.SpeechConfig(window=2, threshold=0.5, min_speech=2, min_silence=2), rate=1)
