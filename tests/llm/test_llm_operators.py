"""Each operator against SQL or a brute-force version, with nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import functools
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.compare import duck_rows, spark_rows
from wavemill.llm import ann, counts, exact_dedup, langid, lm, mixing, near_dedup, packing, queries, token_store, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that clash with names used inside the operators.
CLASH = ("uid", "fp", "sha", "part", "pos", "score", "lang_pred", "size", "bands", "sig", "at", "ord", "held_out", "train", "bucket", "rate", "label", "copy", "_row_part", "norm")


def clash(df):
    return df.withColumns({c: F.lit(7) for c in CLASH})
LONG = "The quick brown fox jumps over the lazy dog while seventeen curious foxes watch. " * 4000
PROSE = ["one two three four five six seven eight nine ten eleven twelve", "uno dos tres cuatro cinco seis siete ocho nueve diez"]
WORDS = public_tokenizers.path("word_bpe_49k.json")


def edge_rows():
    return [
        (5, "same text\there", "en", "src0", 1), (3, "same  text here", "en", "src0", 2), (9, "same text here", None, None, 3), (3, "same text here", "en", "src1", 4), (None, "same text here", "en", "src0", 5),
        (1, None, "en", "src2", None), (2, "", "fr", "src2", 0), (4, "   ", "fr", "src9", 3), (6, "!!! ... ###", "de", "src1", 9), (7, LONG, "en", "src0", len(LONG)), (8, LONG + "end", "en", "src0", 1),
        (-10, "x", "en", "src3", 1), (None, None, None, None, None), (11, PROSE[0], "en", "src1", 1), (12, PROSE[1], "es", "src1", 1), (12, PROSE[1], "es", "src1", 1), (13, PROSE[0] + " thirteen", "en", "src4", 1),
    ]


@pytest.fixture(scope="module")
def edge(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("edge") / "docs")
    spark.createDataFrame(edge_rows(), DOCS).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def clashing(spark, edge, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("clash") / "docs")
    clash(edge).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "docs")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, sf_dir, duck, name):
    assert spark_rows(queries.queries()[name](spark, sf_dir)) == duck_rows(duck, queries.oracle_sql()[name])


# --- 1: token ids


@functools.cache
def encoded_one(text):
    return tokenizer().encode(text, add_special_tokens=False).ids + [2]


@functools.cache
def tokenizer():
    return Tokenizer.from_file(WORDS)


def encoded(texts):
    return [encoded_one(x or "") for x in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_ids_round_trip(spark, sf_dir, docs):
    want, start = [], 0
    for k, ids in zip(sorted(docs), encoded([docs[k] for k in sorted(docs)]), strict=True):
        want.append((k, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, queries.op1_token_ids(spark, sf_dir).collect())) == want


@pytest.mark.parametrize("which", ["edge", "clashing"])
def test_token_store_edges(spark, request, which):
    df = request.getfixturevalue(which)
    store = token_store.write_store(df, WORDS)
    rows = sorted(store.documents().collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == sorted((r[0] for r in edge_rows()), key=lambda k: (k is not None, k)) and rows[-1].start + rows[-1].n_tokens == store.tokens
    assert collections.Counter((r.doc_id, r.ids_crc32) for r in rows) == collections.Counter((r[0], crc(x)) for r, x in zip(edge_rows(), encoded([r[1] for r in edge_rows()]), strict=True))
    keys = spark.createDataFrame([(k,) for k in (12, 1, -10, 999, None)], "doc_id long")
    found = sorted((r.doc_id, tuple(r.ids)) for r in store.lookup(keys).collect())
    assert found == sorted((k, tuple(encoded([t])[0])) for k, t in [(12, PROSE[1]), (12, PROSE[1]), (1, None), (-10, "x")])


def test_token_store_empty(spark, empty):
    store = token_store.write_store(empty, WORDS)
    assert store.tokens == 0 and store.documents().count() == 0 and store.lookup(spark.range(3).withColumnRenamed("id", "doc_id")).count() == 0


# --- 2: exact deduplication


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for place, r in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")].append((r[0] is None, r[0] or 0, place, r[0]))
    out = []
    for text, members in groups.items():
        keep = min(m[3] for m in members if m[3] is not None) if any(m[3] is not None for m in members) else None
        out += [(m[3], keep, len(members), hashlib.sha256(text.encode()).hexdigest()) for m in members]
    return groups, out


@pytest.mark.parametrize("which", ["edge", "clashing"])
def test_exact_dedup_edges(request, which):
    df = request.getfixturevalue(which)
    got = exact_dedup.dedup(df).collect()
    groups, want = brute_exact(edge_rows())
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == collections.Counter(want)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)
    left = exact_dedup.without(df, exact_dedup.dedup(df).where("not kept"))
    assert left.columns == df.columns and left.count() == len(groups)


def test_exact_dedup_without_files_and_empty(spark, edge, empty):
    assert exact_dedup.dedup(empty).count() == 0
    derived = edge.repartition(2).union(edge.limit(0))
    assert exact_dedup.dedup(derived).where("kept").count() == exact_dedup.dedup(edge).where("kept").count()


def test_exact_dedup_with_many_owners(spark, sf_dir, monkeypatch):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = spark_rows(exact_dedup.dedup(df).drop("part", "pos"))
    monkeypatch.setattr(exact_dedup, "OWNER_SIZE", 20)
    assert spark_rows(exact_dedup.dedup(df).drop("part", "pos")) == want


# --- 3: language model


def tokens_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) + ["\n"]


def brute_lm(rows, fold=2, folds=7):
    """The whole model in plain Python, with the exact probabilities instead of the binned ones in the EM."""
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % folds == fold
    toks = [tokens_of(t) for _, t in rows]
    train = [t for (k, _), t in zip(rows, toks, strict=True) if k is not None and not held(k)]
    one = collections.Counter(w for t in train for w in t)
    two = collections.Counter(p for t in train for p in zip([None, *t], t))
    ctx = collections.Counter(w for t in train for w in [None, *t[:-1]])
    n, v = sum(one.values()), len(one)
    bucket = lambda c: 0 if c <= 0 else 1 + int(math.floor(math.log2(c)))
    data = collections.Counter()
    for t in train:
        for a, b in zip([None, *t], t):
            c = ctx[a] - 1
            data[bucket(c), (two[a, b] - 1) / c if c > 0 else 0.0, (one[b] - 1) / max(1, n - 1)] += 1
    weights = lm.learn(np.array([[b, k, p2, p1, 1 / (v + 1)] for (b, p2, p1), k in data.items()]))
    out = []
    for (k, _), t in zip(rows, toks, strict=True):
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in t)
        total = 0.0
        for a, b in zip([None, *t], t):
            w = weights[bucket(ctx[a])]
            total += math.log10(w[0] * (two[a, b] / ctx[a] if ctx[a] else 0) + w[1] * one[b] / n + w[2] / (v + 1))
        out.append((k, held(k), len(t), sum(one[w] > 0 for w in t), n, base, total))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_lm_equals_brute_force(spark, sf_dir, docs, small):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = (5000, 900, 2000) if small else (lm.CHUNK_TOKENS, lm.SLICE_BYTES, lm.OWNER_ENTRIES)
    got = {r.doc_id: r for r in lm.score(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, *sizes).collect()}
    want = brute_lm(sorted(docs.items()))
    assert len(got) == len(want)
    for k, held, n, known, train, base, total in want:
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, train)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, total, rel_tol=2e-3)  # the EM sees probabilities in eighths of an octave
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


@pytest.mark.parametrize("which", ["edge", "clashing"])
def test_lm_edges(request, which):
    df = request.getfixturevalue(which)
    got = lm.score(df, F.crc32(F.col("doc_id").cast("string")) % 7 == 2, 3000, 5000).collect()
    want = brute_lm([(r[0], r[1]) for r in edge_rows()])
    show = lambda rows: collections.Counter((*r[:5], round(r[5], 6)) for r in rows)
    assert show([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got]) == show(want)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_lm_with_nothing_to_learn(spark, empty):
    assert lm.score(empty, F.lit(False)).count() == 0
    r = lm.score(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(True)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_owners_beyond_sixteen_bits():
    hashes = np.unique(np.random.default_rng(0).integers(0, 2**63, 3000).astype(np.uint64) * np.uint64(2))
    for owners in (1, 3, 65536, 65537, 200_000):
        head, got = lm.head_bits(owners), []
        ranges = [lm.owner_range(o, owners) for o in range(owners)]
        assert ranges[0][0] == 0 and ranges[-1][1] == 1 << head and all(a[1] == b[0] and a[0] < a[1] for a, b in zip(ranges, ranges[1:]))
        edges = np.searchsorted(hashes, np.array([lo << (64 - head) for lo, _ in ranges], np.uint64)).tolist() + [len(hashes)]
        for o, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                got.append(lm.unpack_hashes(lm.pack_hashes(hashes[a:b], *ranges[o], head), *ranges[o], head))
        assert np.array_equal(np.concatenate(got), hashes)


# --- 4: token counts


@pytest.mark.parametrize("which", ["edge", "clashing"])
def test_token_counts(request, which):
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = counts.count_tokens(request.getfixturevalue(which), model, chunk_chars=1000, overlap_chars=40).collect()
    want = [(r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or ""))) for r in edge_rows()]
    assert collections.Counter(map(tuple, got)) == collections.Counter((*w, w[2] > 4096) for w in want)


def test_token_counts_empty(empty):
    assert counts.count_tokens(empty, public_tokenizers.path("piece_bpe_32k.model")).count() == 0


# --- 5: URL filters


def test_url_rules_equal_brute_force(spark):
    hosts = ["com", "a.com", "xcom", "example.com", "EXAMPLE.com", "www.example.com", "m.www.example.com", "fr.net", "net", "a.b.net:80", ".com", "", "u@net", "ünï.net"]
    paths = ["", "/", "/en", "/en/", "/en/x?y=/es/", "/es/#", "/fr/a", "?x", "#/en/", "/x.example.com/en/", "/\x00"]
    found = [f"{s}{h}{p}" for s in ("http://", "", "a://b://") for h in hosts for p in paths] + [None, "", "://", "http://net/es/" + "y" * 5000]
    rows = clash(spark.createDataFrame(list(enumerate(found)) + [(None, "http://a.net/fr/"), (0, "http://net/fr/")], "page_id long, url string"))
    got = collections.Counter(map(tuple, urls.judge_urls(rows, queries.URL_RULES).collect()))
    want = collections.Counter()
    for k, u in [*enumerate(found), (None, "http://a.net/fr/"), (0, "http://net/fr/")]:
        host, path = urls.canonical(u)
        fits = [(len(r), r, v) for v, r in queries.URL_RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        best = max(fits, default=(0, None, "allow"))
        want[k, host, path, best[1], best[2]] += 1
    assert got == want
    assert urls.judge_urls(rows.limit(0), queries.URL_RULES).count() == 0


def test_automaton_of_many_words_equals_regular_expressions():
    rng = np.random.default_rng(4)
    kinds = {("*",): ".*", ("?",): ".", ("~",): "[^/]*"}
    patterns = [[x if rng.random() < 0.6 else list(kinds)[rng.integers(3)] for x in rng.choice(["a", "b/", "ab"], rng.integers(1, 6))] for _ in range(60)]
    strings = ["".join(rng.choice(["a", "b", "/"], rng.integers(0, 9))) for _ in range(200)]
    got = urls.Automaton(patterns).run([s.encode() for s in strings])
    want = [[bool(re.fullmatch("".join(re.escape(x) if isinstance(x, str) else kinds[x] for x in p), s)) for p in patterns] for s in strings]
    assert got.tolist() == want


# --- 6: packing


def check_pieces(rows, texts):
    """Every id of every document in one piece, and every sequence without a gap. A document may occur many times."""
    own = collections.Counter((key, text or "") for key, text in texts)
    known = collections.defaultdict(list)
    for key, text in own:
        known[key].append(encoded_one(text))
    tokens, by_sequence = collections.Counter(), collections.defaultdict(list)
    for (key, start, length, n, check), count in collections.Counter((r.doc_id, r.start, r.length, r.doc_tokens, r.ids_crc32) for r in rows).items():
        assert length > 0 and any(len(x) == n and crc(x[start : start + length]) == check for x in known[key])
        tokens[key] += length * count
    want = collections.Counter()
    for (key, text), count in own.items():
        want[key] += len(encoded_one(text)) * count
    assert tokens == want
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(by_sequence) == -(-sum(want.values()) // 4096)


def test_packing(spark, sf_dir, docs):
    check_pieces(queries.op6_packing(spark, sf_dir).collect(), docs.items())


@pytest.mark.parametrize("which", ["edge", "clashing"])
def test_packing_edges(request, which):
    pieces = packing.pack(request.getfixturevalue(which), WORDS)
    check_pieces(packing.read_pieces(pieces, 2, False).collect(), [(r[0], r[1]) for r in edge_rows()])
    whole = packing.assemble(pieces, 2).collect()
    assert all(len(r.ids) == 4096 for r in whole) and len(whole) == len({r.sequence_id for r in whole})


def test_packing_empty_and_powers_of_two(spark, empty):
    assert packing.read_pieces(packing.pack(empty, WORDS), 2, False).count() == 0
    two = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")  # four ids with the end
    assert [len(r.ids) for r in packing.assemble(packing.pack(two, WORDS), 2).collect()] == [4]


def test_curve_places_documents_one_by_one_or_together():
    rng = np.random.default_rng(2)
    curve, docs = packing.Curve(1000), [rng.integers(0, 1000, n) for n in (5, 0, 700, 1, 0, 40)]
    together = curve.cells(np.concatenate(docs), np.array([len(d) for d in docs]))
    for ids, cell in zip(docs, together, strict=True):
        vector = np.sqrt(np.bincount(curve.bucket[ids], minlength=packing.BUCKETS))
        place = vector @ curve.directions / np.linalg.norm(vector) if len(ids) else np.full(packing.DIMENSIONS, -1.0)
        assert cell.tolist() == np.clip(np.floor((place + 1) / 2 * (1 << packing.BITS)), 0, (1 << packing.BITS) - 1).astype(int).tolist()


def test_neighbours_share_sequences(spark):
    """Documents of two vocabularies are not interleaved."""
    rng = np.random.default_rng(0)
    kinds = [["alpha", "beta", "gamma", "delta"], ["river", "stone", "cloud", "tree"]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2], 200))) for i in range(200)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), WORDS).collect()
    mixed = collections.defaultdict(set)
    for r in got:
        mixed[r.sequence_id].add(r.doc_id % 2)
    assert sum(len(v) == 2 for v in mixed.values()) <= 2


# --- 7: language identification


def test_cross_parsing_equals_brute_force():
    samples = {"a": ["the cat sat on the mat", "hello there"], "b": ["el gato se sienta", "hola que tal"]}
    parser = langid.CrossParser(samples)
    rng = np.random.default_rng(1)
    for _ in range(100):
        text = "".join(rng.choice(list("thecaslo gmqué1Z"), rng.integers(1, 2500)))
        code = parser.codes(text)
        got = parser.phrases([code])[0].tolist()
        for k, language in enumerate(parser.languages):
            sample = bytes(c for t in samples[language] for c in [*parser.codes(t).tolist(), 0])
            n = at = 0
            while at < len(code):
                end, to = (at // langid.BLOCK + 1) * langid.BLOCK, at
                while to < min(len(code), end) and bytes(code[at : to + 1]) in sample:
                    to += 1
                n, at = n + 1, max(to, at + 1)
            assert got[k] == n


@pytest.mark.parametrize("dense", [1, langid.DENSE])
def test_all_letters_count(monkeypatch, dense):
    """Scripts of more letters than the table is wide, with any width, against brute force."""
    monkeypatch.setattr(langid, "DENSE", dense)
    han = [chr(0x4E00 + k) for k in range(400)]
    samples = {"en": ["the cat sat on the mat"], "el": ["η γάτα κάθεται στο χαλί"], "ru": ["кошка сидит на ковре"], "zh": ["".join(han[:200])], "ja": ["".join(han[150:] + ["\U00030001"])]}
    parser = langid.CrossParser(samples)
    assert parser.predict(["cat mat", "γάτα", "ковре", "".join(han[20:30]), "".join(han[300:310]), "".join(han[390:]) + "\U00030001"])[0] == ["en", "el", "ru", "zh", "ja", "ja"]
    rng = np.random.default_rng(1)
    whole = {k: " ".join([*v, ""]) for k, v in samples.items()}
    for _ in range(40):
        texts = [str(rng.choice(list(whole.values()))) for _ in range(8)]
        text = "".join(t[(a := rng.integers(len(t))) : a + rng.integers(1, 12)] for t in texts).lower() + "ж鿿"
        text = " ".join(text.split(" "))
        code = parser.codes(text).tolist()
        for k, language in enumerate(parser.languages):
            sample = [c for t in samples[language] for c in [*parser.codes(t).tolist(), 0]]
            holds = {tuple(sample[a:b]) for a in range(len(sample)) for b in range(a + 1, min(len(sample), a + 40) + 1)}
            n = at = 0
            while at < len(code):
                to = at
                while to < len(code) and tuple(code[at : to + 1]) in holds:
                    to += 1
                n, at = n + 1, max(to, at + 1)
            assert parser.phrases([np.array(code)])[0][k] == n


def test_all_labelled_languages_count(spark):
    rng = np.random.default_rng(5)
    words = {f"l{k:02d}": ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(20)] for k in range(100)}
    rows = [(100 * k + i, " ".join(rng.choice(words[lang], 20)), lang) for k, lang in enumerate(sorted(words)) for i in range(4)]
    parser = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert parser.languages == sorted(words) and len(words) == 100
    assert parser.predict([" ".join(words[lang][:10]) for lang in sorted(words)])[0] == sorted(words)


def test_held_out_accuracy(spark, sf_dir):
    got = queries.op7_language_id(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert got and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95 and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark, edge, clashing, empty):
    parser = langid.fit(edge, F.lit(True))
    for df in (edge, clashing):
        got = langid.identify(df.select("doc_id", "text"), parser, ["doc_id"]).collect()
        und = {r.doc_id for r in got if r.lang_pred == "und"}
        assert len(got) == len(edge_rows()) and und == {1, 2, 4, 6, None} and all(r.score == 0 for r in got if r.lang_pred == "und")
    assert langid.fit(empty, F.lit(True)).languages == [] and langid.identify(empty, parser, ["doc_id"]).count() == 0
    none = langid.identify(edge, langid.CrossParser({}), ["doc_id"]).collect()
    assert {r.lang_pred for r in none} == {"und"}


def test_wrong_labels_are_dropped(spark):
    en, es = "the man with the hat and the dog ran to the house by the sea ", "el hombre con la casa y el perro que va por la calle de la mar "
    rows = [(i, en * 3 if i % 2 == 0 or i % 10 == 1 else es * 3, "en" if i % 2 == 0 else "es") for i in range(60)]
    parser = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert parser.predict([en, es])[0] == ["en", "es"]


# --- 8: nearest neighbours


def brute_nearest(rows, k=20):
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for at, (i, q) in enumerate(ok):
        if i % 20 == 0:
            found = sorted((-float((v * q).sum()), j) for other, (j, v) in enumerate(ok) if other != at and len(v) == len(q))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return collections.Counter(out)


def test_nearest_edges(spark):
    rng = np.random.default_rng(2)
    vector = lambda: [float(np.float32(x)) for x in rng.normal(size=4)]
    rows = [(i, vector()) for i in range(1, 60)] + [(i, [1.0, 2.0, 0.0, -1.0]) for i in range(60, 100)]
    rows += [(100, None), (120, [0.0] * 4), (140, [1.0, None, 0.0, 0.0]), (160, [math.nan, 1.0, 1.0, 1.0]), (180, [math.inf, 1.0, 1.0, 1.0]), (200, [1.0]), (220, []), (240, [1.0, 2.0]), (241, [3.0, 1.0]), (None, [1.0] * 4), (20, [1.0, 2.0, 0.0, -1.0]), (61, [1.0, 2.0, 0.0, -1.0])]
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    got = collections.Counter(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == brute_nearest(rows)
    assert ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.search(df.where("vec_id in (40, 41)"), F.col("vec_id") % 20 == 0).count() == 1
    wide = spark.createDataFrame([(20, [0.1, 0.2, 0.3]), (21, [0.3, 0.2, 0.1])], "vec_id long, embedding array<double>")
    assert ann.search(wide, F.col("vec_id") % 20 == 0).first().score == sum([0.1 * 0.3, 0.2 * 0.2, 0.3 * 0.1])


def test_recall_of_the_scan(spark):
    """With the production share of candidates but a low floor, over several blocks' worth of random directions."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 60 == 0, rerank_least=50).collect():
        got[r.query_id].add(r.vec_id)
    y, hits = x.astype(np.float64), 0
    for q, found in got.items():
        s = y @ y[q]
        s[q] = -9
        hits += len(found & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 100 and hits / 2000 >= 0.9


def test_blocks_of_a_task_are_searched_together(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(size=4)]) for i in range(300)]
    monkeypatch.setattr(ann, "BLOCK_ROWS", 8)
    monkeypatch.setattr(ann, "TASK_BLOCKS", 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1)
    assert collections.Counter(map(tuple, ann.search(df, F.col("vec_id") % 20 == 0).collect())) == brute_nearest(rows)


def test_near_equal_vectors_are_all_reranked(spark):
    """Groups of 2,000 vectors nearer to each other than a codebook cell, and a query id that has more rows than k, of which each sees the others."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(3, 64))
    x = np.concatenate([np.repeat(centres, 2000, axis=0) + rng.normal(0, 1e-4, (6000, 64)), rng.normal(size=(3000, 64))])
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = np.arange(len(x))
    ids[1:31] = 0
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").coalesce(1)
    got = collections.defaultdict(list)
    for r in ann.search(df, (F.col("vec_id") % 200 == 0)).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    y = x.astype(np.float64)
    for q in range(200, len(x), 200):
        s = (y * y[q]).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if i != q][:20]
        assert sorted(got[q]) == [(n + 1, int(ids[i]), float(s[i])) for n, i in enumerate(order)]
    assert len(got) == 45 and len(got[0]) == 31 * 20
    want = collections.Counter()
    for q in range(31):
        s = (y * y[q]).sum(axis=1)
        want.update((n + 1, int(ids[i]), float(s[i])) for n, i in enumerate([i for i in np.lexsort((ids, -s)) if i != q][:20]))
    assert collections.Counter(got[0]) == want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_recall_on_the_table(spark, sf, monkeypatch):
    """The registered query against brute force, in one block and in several; a small block is scanned by code too."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    scans, real = [], ann.Block.within_reach
    for block_rows in (ann.BLOCK_ROWS, 64):
        monkeypatch.setattr(ann, "BLOCK_ROWS", block_rows)
        got = collections.defaultdict(set)
        for r in queries.op8_nearest_neighbours(spark, f"/root/testdata/{sf}").collect():
            got[r.query_id].add(r.vec_id)
        hits = total = 0
        for q in np.flatnonzero(ids % 20 == 0):
            s = x @ x[q]
            s[q] = -np.inf
            want = set(ids[np.lexsort((ids, -s))[: min(20, len(ids) - 1)]].tolist())
            hits, total = hits + len(want & got[int(ids[q])]), total + len(want)
        assert total and hits / total >= 0.99
    dim = x.shape[1]
    books = ann.Codebooks(x)
    code, errors = books.encoded(x)
    row = {"block": 0, "ids": ids.astype(np.int64).tobytes(), "asks": np.packbits(ids % 20 == 0).tobytes(), "ends": np.arange(1, len(ids) + 1).tobytes(), "vectors": x.tobytes(), "codes": code.tobytes(), "errors": errors.tobytes()}


    def counted(self, rough, done, *rest):
        more = real(self, rough, done, *rest)
        scans.append((len(done), len(more)))
        return more

    monkeypatch.setattr(ann.Block, "within_reach", counted)
    asked = np.flatnonzero(ids % 20 == 0)
    for q, table in zip(asked, books.tables(x[asked]), strict=True):
        ann.Block(row, dim, "<f8").search(x[q], int(q), table, 20, ann.RERANK_SHARE, ann.RERANK_LEAST)
    assert all(done <= max(40, 0.03 * len(ids) + 1) for done, _ in scans)
    print(sf, "exact products beyond the best by code:", sum(more for _, more in scans) / len(scans) / len(ids))
    assert sum(more for _, more in scans) < 0.10 * len(scans) * len(ids)  # the codes decide


def test_codes_lose_less_along_the_vector():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = ann.Codebooks(x)
    books.finer, books.weight = [], 0.0
    plain = books.assign(x)
    books.weight = 8.0
    aware = books.assign(x)

    def parallel(code):
        decoded = np.stack([books.books[m][code[:, m]] for m in range(8)], axis=1).reshape(len(x), -1)
        return np.mean(((x - decoded) * x).sum(axis=1) ** 2)

    assert parallel(aware) < parallel(plain)
    table = books.tables(x[:3])
    decoded = np.stack([books.books[m][aware[:, m]] for m in range(8)], axis=1).reshape(len(x), -1)
    packed = books.pack(aware)
    assert np.allclose([sum(table[q][b][packed[b]] for b in range(4)) for q in range(3)], x[:3] @ decoded.T, atol=1e-4)


# --- 9: near-duplicates


def brute_near(texts, threshold=0.8):
    """Components of weighted Jaccard over all pairs; texts with equal words are one class."""
    words = [near_dedup.words_of(t or "") for t in texts]
    bags = [collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter() for w in words]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = sum((bags[i] & bags[j]).values())
            if words[i] == words[j] or (common and common >= threshold * sum((bags[i] | bags[j]).values())):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def classes(labels):
    groups = collections.defaultdict(set)
    for k, label in labels:
        groups[label].add(k)
    return {frozenset(v) for v in groups.values()}


def planted(seed=0, n=60):
    """Documents with copies of 1 to 20 edits, a passage that many share, and a large group of noisy copies."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    passage, base, out = [word() for _ in range(60)], [word() for _ in range(150)], []
    for _ in range(n):
        own = [word() for _ in range(rng.integers(3, 200))]
        out.append(own)
        for edits in rng.integers(0, 20, rng.integers(0, 3)):
            copy = list(own)
            for _ in range(edits):
                copy[rng.integers(len(copy))] = word()
            out.append(copy)
    out += [[word() for _ in range(60)] + passage for _ in range(30)]
    for _ in range(80):
        copy = list(base)
        for _ in range(rng.integers(0, 7)):
            copy[rng.integers(len(copy))] = word()
        out.append(copy)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize(("seed", "small", "leaders"), [(0, 1, False), (1, 1, True), (1, near_dedup.SMALL, True)])
def test_near_dedup_equals_brute_force(spark, seed, small, leaders, monkeypatch):
    """With no small buckets and without leaders all is left to the exact join, here with lists longer than its first windows."""
    for name, value in (("SMALL", small), ("CHUNK_CELLS", 2000), ("WINDOW", 2), ("DENSE", small % 2), ("GROUP", 3)):
        monkeypatch.setattr(near_dedup, name, value)
    if not leaders:
        monkeypatch.setattr(near_dedup, "_leaders", lambda apart: apart.select(F.col("uid").alias("a"), F.col("uid").alias("b")).limit(0))
    texts = planted(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = near_dedup.near_dedup(df).collect()
    assert classes((r.doc_id, r.class_id) for r in got) == classes(enumerate(brute_near(texts)))
    sizes = collections.Counter(r.class_id for r in got)
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_unlike_texts_with_a_common_passage_are_not_paired(spark, monkeypatch):
    """5,000 texts that share 60 of 110 words: they meet in common buckets by the thousand, and no step may pair more than a few of each."""
    rng, seen = np.random.default_rng(3), []
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"w{x}" for x in rng.integers(0, 10**9, 50))) for i in range(5000)]
    rows += [(5000 + i, rows[i][1] + " more") for i in range(3)]
    real = near_dedup.similar

    def counted(pairs, *rest):
        seen.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(near_dedup, "similar", counted)
    got = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got if r.class_size > 1) == [(0, 0), (1, 1), (2, 2), (5000, 0), (5001, 1), (5002, 2)]
    assert seen and max(seen) <= 2 * len(rows)


def test_the_exact_join_finds_what_leaders_miss(spark, monkeypatch):
    """A chain of versions, each like the next alone, in one class with a template that only some resemble."""
    monkeypatch.setattr(near_dedup, "WINDOW", 4)
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(30):
        for at in (i * 4 + 1, i * 4 + 2):
            words[at] = f"x{i}-{at}"
        texts.append(" ".join(words))
    got = near_dedup.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert classes((r.doc_id, r.class_id) for r in got) == classes(enumerate(brute_near(texts)))


@pytest.mark.parametrize("which", ["edge", "clashing"])
def test_near_dedup_edges(request, which):
    got = near_dedup.near_dedup(request.getfixturevalue(which)).collect()
    rows = edge_rows()
    labels = brute_near([r[1] for r in rows])
    first = {}
    for r, label in zip(rows, labels, strict=True):
        first[label] = min([x for x in (first.get(label), r[0]) if x is not None], default=None)
    size = collections.Counter(labels)
    want = collections.Counter((r[0], first[label], size[label]) for r, label in zip(rows, labels, strict=True))
    assert collections.Counter((r.doc_id, r.class_id, r.class_size) for r in got) == want and sum(r.kept for r in got) == len(size)


def test_near_dedup_empty(empty):
    assert near_dedup.near_dedup(empty).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = [rng.integers(0, 2**63, 400).astype(np.uint64) for _ in range(60)]
    b = [np.concatenate([x[:300], rng.integers(0, 2**63, 100).astype(np.uint64)]) for x in a]
    s = near_dedup.dart_minhash(a + b, 120)
    assert abs((s[:60] == s[60:]).mean() - 0.6) < 0.03
    one = near_dedup.dart_minhash([a[0][:1]], 120)
    assert (one == near_dedup.dart_minhash([a[0][:1]], 120)).all() and len(np.unique(one)) == 120


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100), (7, 200)]
    got = [(r.uid, r.label) for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert classes(got) == {frozenset([*range(41), 200]), frozenset([100, 101, 102])} and len(got) == 45
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 10: mixing


def test_mixing_meets_its_targets(spark):
    rows = [(i, "x" * 10, "a" if i % 10 else "b") for i in range(20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df, {"a": 0.5, "b": 0.5}).groupBy("source").agg(F.count("*").alias("n"), F.max("mix_repeats").alias("most"), F.first("mix_rate").alias("rate")).collect()
    n = {r["source"]: r["n"] for r in got}
    assert abs(n["a"] - 10000) < 500 and abs(n["b"] - 10000) < 500 and {round(r["rate"], 3) for r in got} == {0.556, 5.0}


def test_mixing_inverts_the_distribution(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("a").alias("source"))
    got = {r.doc_id: r.n for r in mixing.mix(df, {"a": 1.0}, budget=4500.0, unit="docs").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for k in range(3000):
        u = (int(hashlib.md5(f"mix|{k}|1".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        n, p = 0, math.exp(-1.5)
        c = p
        while c <= u:
            n += 1
            p *= 1.5 / n
            c += p
        assert got.get(k, 0) == n
    large = mixing.mix(df.limit(20), {"a": 1.0}, budget=20 * 1200.0, unit="docs").groupBy("doc_id").count().collect()
    assert len(large) == 20 and all(1000 < r["count"] < 1400 for r in large)


def test_mixing_edges(spark, edge, clashing, empty):
    for df in (edge, clashing):
        mixed = mixing.mix(df, {"src0": 1.0, "nowhere": 1.0}, 2.0, unit="docs")
        got = mixed.collect()
        assert mixed.columns[: len(df.columns)] == df.columns and got
        keys = [(r.mix_key, r.doc_id is not None, r.doc_id or 0, r.mix_copy) for r in got]
        assert keys == sorted(keys)
    assert mixing.mix(empty, {"a": 1.0}).count() == 0 and mixing.mix(edge, {}, 1.0).count() > 0
    with pytest.raises(ValueError):
        mixing.mix(edge, {"a": -1.0})
    plan = mixing.mix(edge, {"src0": 1.0})._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- the pipeline


def test_pipeline_stages(spark, edge, clashing, sf_dir, tmp_path):
    import corpus_pipeline

    for n, df in enumerate((clashing, spark.read.parquet(f"{sf_dir}/documents.parquet"))):
        before = df
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, before, sf_dir)
            out.write.parquet(f"{tmp_path}/{n}-{name}")
            after = spark.read.parquet(f"{tmp_path}/{n}-{name}")
            rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
            if name != "packing":
                assert after.columns == df.columns
                left = [(r.doc_id, r.text) for r in after.select("doc_id", "text").collect()]
            if name == "language_id":
                letters = collections.Counter(r for r in rows if any(c.isalpha() for c in r[1] or ""))
                assert not collections.Counter(left) - letters and len(left) >= 0.97 * sum(letters.values())
            elif name == "exact_dedup":
                groups, _ = brute_exact(rows)
                assert len(left) == len(groups) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t) for _, t in left})
            elif name == "near_dedup":
                labels = brute_near([t for _, t in rows])
                assert len(left) == len(set(labels)) and set(left) <= set(rows)
            elif name == "mixing":
                assert set(left) <= set(rows)
            else:
                check_pieces(after.collect(), rows)
            before = after


def test_pipeline_language_stage(spark, sf_dir, empty):
    """The stage's own decisions against the parser's answers, and tables without labels or rows."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    parser = langid.fit(docs, F.lit(True))
    rows = docs.select("doc_id", "text", "lang").collect()
    names, scores = parser.predict([r.text for r in rows])
    want = sorted(r.doc_id for r, name, score in zip(rows, names, scores, strict=True) if name != "und" and not (r.lang in parser.languages and name != r.lang and score >= 0.99))
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, sf_dir).select("doc_id").collect()) == want
    plain = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = sorted(r.doc_id for r in corpus_pipeline.language_id(spark, plain, sf_dir).select("doc_id").collect())
    assert kept == sorted(r.doc_id for r in rows if any(c.isalpha() for c in r.text or "")) and len(kept) > 0.9 * len(rows)
    assert corpus_pipeline.language_id(spark, empty, sf_dir).count() == 0


def test_pipeline_rejects_contradicted_labels(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    en, es = "the man with the hat and the dog ran to the house by the sea ", "el hombre con la casa y el perro que va por la calle de la mar "
    rows = [(i, (en if i % 2 else es) * 3, "en" if i % 2 else "es") for i in range(60)] + [(90, es * 3, "en"), (91, en * 3, None), (92, es * 3, "pt"), (93, "123", "en"), (94, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(langid, "fit", lambda docs, train: langid.CrossParser({"en": [en], "es": [es]}))
    left = corpus_pipeline.language_id(spark, spark.read.parquet(f"{tmp_path}/docs"), "").collect()
    assert {r[0] for r in rows} - {r.doc_id for r in left} == {90, 93, 94}


def test_pipeline_of_an_empty_table(spark, empty, sf_dir, tmp_path):
    import corpus_pipeline

    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert name == "packing" or out.columns == empty.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{tmp_path}/{name}")
        assert docs.count() == 0


def test_pipeline_runs_whole(spark, sf_dir):
    import corpus_pipeline

    assert corpus_pipeline.run(spark, sf_dir).count() > 0 and corpus_pipeline.ORACLE_SQL is None
