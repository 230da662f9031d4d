"""Spelling variants, toxicity and point-in-time features against brute force and SQL, with nulls, ties, repeats, empty tables and clashing columns."""

import datetime as dt
import itertools
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.compare import duck_rows, spark_rows
from tests.llm.test_llm_operators import CLASH, DOCS, clash, edge_rows
from wavemill.llm import point_in_time, queries, spelling, toxicity


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edge-new") / "docs")
    spark.createDataFrame(edge_rows(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


# spelling variants


def apart_by_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows, every=199):
    n = Counter()
    for doc_id, text, *_ in rows:
        run = ""
        for c in (text or "") + " ":
            c = c.lower() if "A" <= c <= "Z" else c
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
                continue
            if run:
                h = zlib.crc32(f"{doc_id}:{run}".encode())
                if doc_id is not None and h % every == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                n[run] += 1
            run = ""
    words = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in words if apart_by_one(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 5 * words[w]}
    out = set()
    for w, c in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, c, len(near[w]), words.get(form.get(w))))
    return out


def shown_variants(frame):
    rows = [tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_near_pairs_of_a_subtrie():
    rng = random.Random(5)
    for _ in range(120):
        letters, depth = rng.choice(["ab", "abc", "abÿé"]), rng.choice([0, 1, 2])
        words = sorted({"".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(rng.randint(1, 90))})
        first = {}
        for i, j in itertools.combinations(range(len(words)), 2):
            a, b = words[i], words[j]
            if apart_by_one(a, b):
                short, long = sorted((a, b), key=len)
                first[i, j] = next(k for k in range(len(long)) if (a[:k] + a[k + 1 :] == b[:k] + b[k + 1 :] if len(a) == len(b) else long[:k] + long[k + 1 :] == short))
        i, j = spelling.near_pairs(words, depth)
        found = sorted(tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True))
        assert found == sorted(p for p, at in first.items() if at >= depth)


def test_near_pairs_of_long_words():
    words = sorted(["x" * 30_000, "x" * 30_001, "x" * 29_999 + "y", "y" + "x" * 30_000, "x" * 15_000 + "z" + "x" * 15_000])
    i, j = spelling.near_pairs(words, 0)
    assert len(i) == sum(apart_by_one(a, b) for a, b in itertools.combinations(words, 2))


@pytest.mark.parametrize("group", [100_000, 4])
def test_variants_against_brute_force(spark, group, monkeypatch):
    monkeypatch.setattr(spelling, "GROUP_WORDS", group)  # at 4 nearly every prefix is split, level by level
    rng = random.Random(3)
    stems = ["planet", "plänet", "planets", "plane", "aaaaaa", "aaaaaaa", "colour", "color", "colours", "İstanbul"]
    rows = []
    for doc_id in range(60):
        words = []
        for _ in range(60):
            w = rng.choices(stems, weights=[60, 2, 9, 5, 30, 3, 50, 5, 1, 2])[0]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = w[:k] + rng.choice(["", "o", "É"]) + w[k + 1 :]
            words.append(w if rng.random() < 0.9 else w.upper())
        rows.append((doc_id - 5, " ".join(words), None, None, 1))
    rows += [rows[0], rows[0], (None, rows[1][1], None, None, 1), (99, None, None, None, None), (100, "", None, None, 0), (101, "planet" * 30_000 + ("-" + "colour") * 50_000, None, None, 0)]
    docs = clash(spark.createDataFrame(rows, DOCS).repartition(5)).withColumns({c: F.lit(1) for c in ("word", "n", "near", "prefix")})
    want = brute_variants(rows)
    assert any(w[1] for w in want) and any(w[4] > 3 for w in want)
    assert shown_variants(spelling.variants(docs)) == want


def test_chains_of_forms_and_empty_tables(spark, edge):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)] + [("v", "w3")], "word string, form string")
    assert {tuple(r) for r in spelling._roots(forms).collect()} == {(f"w{i}", "w9") for i in range(9)} | {("v", "w9")}
    assert spelling.variants(edge.limit(0)).count() == 0
    assert shown_variants(spelling.variants(edge)) == brute_variants(edge_rows())


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op13_point_in_time"])
def test_against_sql(spark, sf_dir, duck, name):
    assert spark_rows(queries.queries()[name](spark, sf_dir)) == duck_rows(duck, queries.oracle_sql()[name])


# toxicity


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in queries.op12_toxicity(spark, folder).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    hit = sum(r["predicted"] and labels[r["doc_id"]] for r in rows)
    assert len(rows) > 900
    assert hit > 0.9 * sum(r["predicted"] for r in rows)
    assert hit > 0.75 * sum(labels[r["doc_id"]] for r in rows)  # a tenth of the toxic rows of this table has no toxic word


def test_interactions_are_learned(spark):
    """Neither word is toxic by itself; both together are. Weights alone can't tell."""
    rng = random.Random(1)
    rows = []
    for i in range(1200):
        words = rng.choices(["la", "le", "lu", "lo", "li"], k=6) + ["group"] * (i % 2) + ["dumb"] * (i // 2 % 2)
        rows.append((i, " ".join(words), int(i % 4 == 3)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 0)
    assert machine.score("la group dumb le") > 0.5 > 0.3 > max(machine.score("la group le"), machine.score("dumb lu lo"), machine.score("la"))


def test_toxicity_of_edges(spark, edge):
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (5, None), (7, 0), (8, 5), (9, 0)], "doc_id long, toxic int")
    for table in (edge, clash(edge).withColumns({c: F.lit(1) for c in ("toxic", "predicted", "terms", "found")})):
        for marks in (labels, labels.limit(0), labels.where("toxic = 0")):
            machine = toxicity.fit(table, clash(marks).drop("text"), F.lit(True))
            rows = toxicity.toxicity(table.select("doc_id", "text"), machine, ["doc_id"]).collect()
            assert len(rows) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in rows)
            assert toxicity.toxicity(table.limit(0), machine, ["doc_id"]).count() == 0
    assert toxicity.fit(edge.limit(0), labels.limit(0), F.lit(True)).score("x") < 0.01
    long = "word " * 400_000 + "Scum"
    assert len(long) > toxicity.SLICE and toxicity.terms_of(long) == {"word", "scum"}


# point-in-time features

CLICKS = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"
SALES = "sale_id long, client_id long, status string, total double, sold_at timestamp_ntz, arrived_at timestamp_ntz, priority int"
LINES = "sale_id long, line_no int, item_id long, vendor_id long, quantity int, amount double, discount double, flag string, shipped_at timestamp_ntz"


def shop(seed=0, n=150):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    time = lambda: None if rng.random() < 0.03 else start + dt.timedelta(hours=rng.randrange(24 * 40), microseconds=rng.choice([0, 0, 1]))
    late = lambda t: None if t is None or rng.random() < 0.05 else t + dt.timedelta(minutes=rng.choice([0, 5, 600, 5000, 60_000]))
    client = lambda: rng.choice([1, 1, 1, 2, 3, None])
    amount = lambda: rng.choice([None, 0.0, 1.005, -2.5, 10.0])
    clicks, sales, lines = [], [], []
    for i in range(3 * n):
        t = time()
        clicks.append((rng.choice([i, i, 7, None]), t, late(t), client(), rng.choice(["purchase", "view", None]), amount(), "{}"))
    clicks += clicks[:30]
    for i in range(n):
        t = time()
        sales.append((i, client(), "x", amount(), t, late(t), 1))
    for _ in range(4 * n):
        sale = rng.choice([5, 5, *range(n), None, 10_000])
        sold = sales[sale][4] if sale is not None and sale < n else None
        lines.append((sale, 1, rng.choice([1, 2, 3, None]), 1, 1, amount(), 0.0, "k", None if sold is None or rng.random() < 0.05 else sold + dt.timedelta(days=rng.choice([-1, 0, 1, 3, 9, 20]))))
    lines += lines[:20]
    return clicks, sales, lines


def delay(sales):
    return F.crc32(sales["sale_id"].cast("string")) % 259200


@pytest.mark.parametrize("hot", [100_000, 20])
def test_features_against_sql(spark, tmp_path, hot, monkeypatch):
    monkeypatch.setattr(point_in_time, "HOT_ROWS", hot)  # at 20 every client is cut into chunks of time
    con = duckdb.connect()
    frames = {}
    for name, rows, schema in zip(("clicks", "sales", "sale_lines"), shop(), (CLICKS, SALES, LINES), strict=True):
        path = str(tmp_path / name)
        spark.createDataFrame(rows, schema).repartition(4).write.parquet(path)
        con.execute(f"create view {name} as select * from '{path}/*.parquet'")
        frames[name] = spark.read.parquet(path)
    got = point_in_time.features(frames["clicks"], frames["sales"], frames["sale_lines"], delay(frames["sales"]))
    columns, rows = spark_rows(got)
    assert (columns, rows) == duck_rows(con, queries.oracle_sql()["op13_point_in_time"])
    assert len({r[columns.index("n_items")] for r in rows}) > 2 and len({r[columns.index("label")] for r in rows}) == 2
    names = ("time", "n", "cents", "at", "id", "kind_", "block", "chunk", "low", "length", "client", "sold", "start", "d", "move", "known")
    wide = frames["sales"].withColumns({c: F.lit(7) for c in (*CLASH, *names)})
    assert spark_rows(point_in_time.features(frames["clicks"].withColumn("time", F.lit(1)), wide, frames["sale_lines"].withColumns({c: F.lit(7) for c in (*CLASH, *names)}), delay(wide))) == (columns, rows)


def test_features_in_another_time_zone(spark, sf_dir):
    want = spark_rows(queries.op13_point_in_time(spark, sf_dir))
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert spark_rows(queries.op13_point_in_time(spark, sf_dir)) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_features_of_empty_and_repeated_tables(spark):
    clicks, sales, lines = (spark.createDataFrame(rows, schema) for rows, schema in zip(shop(n=20), (CLICKS, SALES, LINES), strict=True))
    assert point_in_time.features(clicks, sales.limit(0), lines, F.lit(0)).count() == 0
    alone = point_in_time.features(clicks.limit(0), sales, lines.limit(0), F.lit(0)).collect()
    assert len(alone) == 2 * sales.where("client_id is not null and sold_at is not null").count()
    assert all(r["n_clicks"] == r["n_lines"] == r["n_items"] == 0 and r["last_click_id"] is None for r in alone)
    day = dt.datetime(2024, 1, 1)
    twice = spark.createDataFrame([(1, 1, "x", 2.5, day, day, 1)] * 2, SALES)
    rows = point_in_time.features(clicks.limit(0), twice, spark.createDataFrame([(1, 1, 9, 1, 1, 1.0, 0.0, "k", day)], LINES), F.lit(86400), windows=[2]).collect()
    assert [(r["n_sales"], r["sale_cents"], r["n_lines"], r["n_items"]) for r in rows] == [(2, 500, 2, 1)] * 2


# near-duplicates whose texts are all a little too unlike


def test_families_of_blocks(spark, tmp_path, monkeypatch):
    """Each text has 17 of 20 shared blocks of words: most pairs are just below the threshold. Blocks of lists and groups of sets are small here, and every link is found."""
    from wavemill.llm import near_dedup

    for name, value in (("WINDOW", 8), ("GROUP", 16), ("DENSE", 0), ("COLUMNS", 64), ("HEAVY", 330)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(7)
    blocks = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(20)]
    rows = [(i, " ".join(blocks[k] for k in sorted(rng.sample(range(20), 17)))) for i in range(90)]
    sets = [near_dedup.regions(near_dedup.words_of(t)) for _, t in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if near_dedup.overlap(sets[i], sets[j], 0.8)]
    root = list(range(len(rows)))
    for _ in rows:
        for i, j in links:
            root[i] = root[j] = min(root[i], root[j])
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(path)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(spark.read.parquet(path)).collect()}
    assert got == dict(enumerate(root)) and 1 < len(set(root)) < len(rows)


@pytest.mark.parametrize("dense", [0, 10**9])
def test_pairs_are_verified_alike(spark, dense, monkeypatch):
    import numpy as np

    from wavemill.llm import near_dedup

    for name, value in (("DENSE", dense), ("GROUP", 4), ("COLUMNS", 8), ("HEAVY", 45)):
        monkeypatch.setattr(near_dedup, name, value)
    rng = np.random.default_rng(1)
    sets = {i: np.unique(rng.choice(np.arange(60), rng.integers(1, 59), replace=False)).astype(np.uint64) for i in range(30)}
    cells = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in sets.items()], "uid long, cells binary")
    every = list(itertools.combinations(range(30), 2))
    pairs = spark.createDataFrame([(a, b, len(sets[a]), len(sets[b])) for a, b in every], "a long, b long, size_a long, size_b long")
    got = near_dedup._verified(pairs, len(every), cells, 0.5).collect()
    assert sorted((r["a"], r["b"]) for r in got) == [p for p in every if near_dedup.overlap(sets[p[0]], sets[p[1]], 0.5)]
