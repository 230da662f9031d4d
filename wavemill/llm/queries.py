"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import ann, counts, exact_dedup, langid, lm, mixing, near_dedup, packing, point_in_time, spelling, token_store, toxicity, urls


def tokenizer_path(name: str) -> str:
    """A public vocabulary file; looked up where the code runs, since it lies in the Python installation."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The contract's tokenizer, its end id, and the bytes of an id in the payload (its vocabulary has 49,408 entries).
PACK_TOKENIZER, END_ID, ID_BYTES = "word_bpe_49k.json", 2, 2


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write_store(_table(spark, sf_dir, "documents"), tokenizer_path(PACK_TOKENIZER), END_ID)
    return store.documents().select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(PACK_TOKENIZER), 4096, END_ID)
    return packing.read_pieces(pieces, ID_BYTES, with_ids=False)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
with norm as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size,
  doc_id = min(doc_id) over same as kept, sha256(norm) as text_sha256
from norm window same as (partition by norm)
"""


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 3, 1)
    parser = langid.fit(docs, ~out)
    return langid.identify(docs.select("doc_id", out.alias("held_out"), "text"), parser, ["doc_id", "held_out"])


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES, default="allow")


OP5_SQL = """
with parts as (
  select page_id, coalesce(contains(url, '://'), false) as ok, substr(url, strpos(url, '://') + 3) as rest from pages
), split as (
  select page_id, case when ok then regexp_extract(rest, '^[^/?#]*') else '' end as raw_host, case when ok then rest else '' end as rest from parts
), canon as (
  select page_id,
    translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path
  from split
), rules(rule, rule_host, rule_path, rule_verdict) as (
  values ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
    ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), best as (
  select page_id, host, path, max_by(rule, length(rule)) as rule, max_by(rule_verdict, length(rule)) as verdict
  from canon left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  group by page_id, host, path
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from best
"""

def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"), threshold=0.8).select("doc_id", "class_id", "class_size", "kept")


#: The hot source is held to a tenth of the mixture, the others get equal shares; sources beyond the list share one more.
MIX_WEIGHTS = {"src0": 0.10} | {f"src{k}": 0.045 for k in range(1, 20)}
MIX_OTHER = 0.045


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_OTHER, unit="chars", seed="mix", keep=["doc_id", "source"])
    return mixed.select("doc_id", "source", "mix_copy", "mix_repeats", "mix_key", F.round("mix_rate", 9).alias("mix_rate"))


_WEIGHTS_SQL = ", ".join(f"('{k}', {w / (sum(MIX_WEIGHTS.values()) + MIX_OTHER)!r}::double)" for k, w in [*MIX_WEIGHTS.items(), (mixing.OTHER, MIX_OTHER)])
OP10_SQL = f"""
with recursive weights(bucket, weight) as (values {_WEIGHTS_SQL}),
docs as (
  select doc_id, source, case when source in ({", ".join(f"'{k}'" for k in MIX_WEIGHTS)}) then source else '{mixing.OTHER}' end as bucket,
    length(coalesce(text, '')) as size from documents
), sizes as (select bucket, sum(size)::double as size from docs group by bucket),
rates as (
  select bucket, coalesce(case when size > 0 then (select sum(size) from sizes) * weight / size end, 0.0) as rate
  from weights left join sizes using (bucket)
), cdf(bucket, rate, k, p, cum) as (
  select bucket, rate, 0, exp(-rate), exp(-rate) from rates
  union all
  select bucket, rate, k + 1, p * rate / (k + 1), cum + p * rate / (k + 1) from cdf where k < ceil(rate + 10 * sqrt(rate) + 40)
), draws as (
  select doc_id, source, bucket, rate,
    (('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, 'null') || '|1'), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u
  from docs join rates using (bucket)
), counted as (
  select d.doc_id, d.source, d.rate, count(*) filter (where c.cum <= d.u) as n from draws d join cdf c on c.bucket = d.bucket group by d.doc_id, d.source, d.rate
)
select doc_id, source, mix_copy, n as mix_repeats, round(rate, 9) as mix_rate,
  ('0x' || substr(md5('mix|' || coalesce(doc_id::varchar, 'null') || '|copy|' || mix_copy::varchar), 1, 15))::bigint as mix_key
from (select *, unnest(generate_series(1, n)) as mix_copy from counted where n > 0)
"""


#: crc32 of an ASCII or UTF-8 text x, in DuckDB: a list of the 256 table entries and a fold over the bytes.
CRC_TABLE = "select list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc_table"


def crc_sql(text: str) -> str:
    digits = f"hex(encode({text}))"
    step = f"xor(c >> 8, crc_table[(xor(c, ('0x' || substr({digits}, 2 * i + 1, 2))::bigint) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, range(strlen({text}))), lambda c, i: {step}), 4294967295)"


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


OP11_SQL = f"""
with recursive runs as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) as run from documents
), each as (
  select doc_id, run, count(*) as n from runs group by doc_id, run
), tab as ({CRC_TABLE}), hashed as (
  select run, n, coalesce({crc_sql("doc_id::varchar || ':' || run")}, 1) as h from each, tab
), changed as (
  select case when h % 199 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word, n from hashed
), words as materialized (
  select word, sum(n)::bigint as n from changed where length(word) >= 6 group by word having sum(n) >= 5
), cut as (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)
), near as materialized (
  select distinct a.word, b.word as other, b.n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word != b.word
  union select c.word, w.word, w.n from cut c join words w on w.word = c.rest
  union select w.word, c.word, c.n from cut c join words w on w.word = c.rest
), best as (
  select word, count(*) as n_near, arg_min(other, (-n, other)) as other, max(n) as other_n from near group by word
), forms as materialized (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * w.n then other end as form, case when other_n >= 5 * w.n then other_n end as form_n from words w left join best b on b.word = w.word
), chain as (
  select word, word as root, 0 as step from forms union all select c.word, f.form, step + 1 from chain c join forms f on f.word = c.root where f.form is not null
), roots as (select word, arg_max(root, step) as root from chain group by word)
select f.word, form, root, n, n_near, form_n from forms f join roots r on r.word = f.word
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = _table(spark, sf_dir, "documents"), langid.held_out(F.col("doc_id"), 4, 2)
    machine = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~out)
    return toxicity.toxicity(docs.select("doc_id", out.alias("held_out"), "text"), machine, ["doc_id", "held_out"])


def op13_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = _table(spark, sf_dir, "sales")
    delay = F.crc32(sales["sale_id"].cast("string")) % 259200
    return point_in_time.features(_table(spark, sf_dir, "clicks"), sales, _table(spark, sf_dir, "sale_lines"), delay, windows=(2, 14), lag_minutes=240, horizon_days=7)


OP13_SQL = f"""
with tab as ({CRC_TABLE}), clean as (
  select row_number() over () as row, sale_id, client_id, sold_at, arrived_at + interval 240 minutes as known, coalesce(floor(100 * total + 0.5)::bigint, 0) as cents,
    sold_at + to_seconds(coalesce({crc_sql("sale_id::varchar")} % 259200, 0)) as t
  from sales, tab where client_id is not null and sold_at is not null
), seen as (
  select client_id, click_id, ts, arrived_at + interval 240 minutes as known, kind, coalesce(floor(100 * value + 0.5)::bigint, 0) as cents from (select distinct * from clicks)
), probes as (select row, sale_id, client_id, t, d from clean, (values (2), (14)) as windows(d)),
from_clicks as (
  select row, d, count(*) as n_clicks, count(*) filter (where kind = 'purchase') as n_purchases, sum(cents) as click_cents, first(click_id order by ts desc, click_id desc nulls last) as last_click_id
  from probes p join seen c on c.client_id = p.client_id and c.ts <= t and c.ts > t - to_days(d) and c.known <= t group by row, d
), known_sales as (
  select p.row, d, p.t, s.sale_id, s.cents from probes p join clean s on s.client_id = p.client_id and s.sold_at <= p.t and s.sold_at > p.t - to_days(d) and s.known <= p.t
), from_sales as (select row, d, count(*) as n_sales, sum(cents) as sale_cents from known_sales group by row, d),
from_lines as (
  select row, d, count(*) as n_lines, count(distinct item_id) as n_items, sum(coalesce(floor(100 * amount + 0.5)::bigint, 0)) as line_cents
  from known_sales k join sale_lines l on l.sale_id = k.sale_id and l.shipped_at <= t group by row, d
), labels as (select distinct p.row from clean p join clean s on s.client_id = p.client_id and s.sold_at > p.t and s.sold_at <= p.t + interval 7 days)
select sale_id, p.d, epoch_us(t) as t_us, l.row is not null as label, coalesce(n_clicks, 0)::bigint as n_clicks, coalesce(n_purchases, 0)::bigint as n_purchases, coalesce(click_cents, 0)::bigint as click_cents,
  last_click_id, coalesce(n_sales, 0)::bigint as n_sales, coalesce(sale_cents, 0)::bigint as sale_cents, coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_items, 0)::bigint as n_items,
  coalesce(line_cents, 0)::bigint as line_cents
from probes p left join from_clicks c on c.row = p.row and c.d = p.d left join from_sales s on s.row = p.row and s.d = p.d left join from_lines i on i.row = p.row and i.d = p.d left join labels l on l.row = p.row
"""



def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_ids": op1_token_ids,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_token_counts": op4_token_counts,
        "op5_url_filters": op5_url_filters,
        "op6_packing": op6_packing,
        "op7_language_id": op7_language_id,
        "op8_nearest_neighbours": op8_nearest_neighbours,
        "op9_near_dedup": op9_near_dedup,
        "op10_mixing": op10_mixing,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_toxicity": op12_toxicity,
        "op13_point_in_time": op13_point_in_time,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op5_url_filters": OP5_SQL, "op10_mixing": OP10_SQL, "op11_spelling_variants": OP11_SQL, "op13_point_in_time": OP13_SQL}
