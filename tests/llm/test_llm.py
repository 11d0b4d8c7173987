"""The training-data operators against brute force, their round trips, and the defined corner cases."""

import collections
import gzip
import hashlib
import io
import itertools
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import common, decontaminate, language_id, lm_scoring, near_dedup, quality_classifier, quality_rules, registry, sentencepiece_scan, sharding, token_counts, warc
from tests.conftest import DATA, same

SF = f"{DATA}/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall((text or "").translate(LOWER))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = np.random.default_rng(1)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary, n))
    base = text(200)
    near = base.split()
    near[100] = "changed"
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, " ".join(near), "en", "b"), (4, None, None, None), (5, "", "en", "a"), (6, " \t\n ", None, "b"), (7, "one two", "de", None), (7, "one two", "de", None), (None, text(80), "en", "a"), (None, None, "en", "a"),
            (8, text(30_000), "en", "a"), (9, "x" * 70_000, "xx", "c"), (10, "Ünï cödé ☃ 日本 " * 30, "ja", "c"), (11, base, "en", "a"), (12, "one two", "en", "a")]
    return spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], DOCS).withColumns({"n_words": F.lit(-1), "kept": F.lit("x"), "h": F.lit(1.5), "shard": F.lit(None).cast("int"), "node": F.lit("q")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    assert same(registry.queries()[name](spark, SF), duck.sql(registry.oracle_sql()[name]))


# --- 1 quality classifier


def test_quality_classifier(spark, odd, empty):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    train = labels.where("doc_id % 3 <> 0")  # the others are held out
    got = quality_classifier.classify(docs, train).withColumnRenamed("quality", "p").join(labels, "doc_id").where("doc_id % 3 = 0").toPandas()
    assert ((got["p"] >= 0.5) == (got["quality"] == 1)).mean() > 0.9 and ((got["p"] >= 0.5) == got["kept"]).all()
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_classifier.classify(odd, none).count() == odd.count()
    assert quality_classifier.classify(empty, labels).count() == 0
    odd_labels = spark.createDataFrame([(1, 1), (1, 0), (7, 1), (None, 1), (99, 0), (3, None)], "doc_id long, quality int")
    got = rows_of(quality_classifier.classify(odd, odd_labels), "doc_id")
    assert got == rows_of(odd, "doc_id")
    # without labels there is no evidence, and the prior is one half everywhere
    assert rows_of(quality_classifier.classify(odd, none), "evidence", "prior", "kept") == {(0.0, 0.5, True): odd.count()}


def test_sites_shrink(spark):
    """A site's prior follows its own documents the more, the more there are."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(i, text, "p", "big") for i in range(200)] + [(1000, text, "p", "small")] + [(2000 + i, text, "p", "other") for i in range(200)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], DOCS)
    labels = spark.createDataFrame([(i, 0) for i in range(200)] + [(2000 + i, 1) for i in range(200)], "doc_id long, quality int")
    prior = quality_classifier.classify(docs, labels).select("doc_id", "prior").toPandas().set_index("doc_id")["prior"]
    assert prior[0] < 0.1 < prior[1000] < 0.9 < prior[2000]


def test_strengths_are_recovered(spark):
    """Sites of 1, 2, 5 and 500 rows, drawn with known variances."""
    rng = np.random.default_rng(4)
    rows = []
    for host in range(1500):
        centre = 0.5 + 0.10 * rng.normal()
        for path in range(4):
            own = centre + 0.05 * rng.normal()
            n = int(rng.choice([1, 2, 5, 500]))
            p = own + 0.2 * rng.normal(size=n)
            rows.append((f"h{host}", f"p{path}", float(p.sum()), n, float((p * p).sum())))
    mean, k_host, k_path = quality_classifier.strengths(spark.createDataFrame(rows, "host string, path string, ps double, pn long, pq double"))
    assert mean == pytest.approx(0.5, abs=0.02) and k_host == pytest.approx(4, rel=0.2) and k_path == pytest.approx(16, rel=0.2)
    single = spark.createDataFrame([(f"h{i}", "p", float(i % 2), 1, float(i % 2)) for i in range(50)], "host string, path string, ps double, pn long, pq double")
    assert quality_classifier.strengths(single)[1] > 10  # sites of one row say nothing of how sites differ


# --- 2 SentencePiece


@pytest.fixture(scope="module")
def models(tmp_path_factory):
    from sentencepiece import sentencepiece_model_pb2 as pb

    path = sentencepiece_scan.default_model()
    m = pb.ModelProto()
    m.ParseFromString(open(path, "rb").read())
    m.trainer_spec.model_type = 1  # the same pieces read as a unigram model
    for p in m.pieces:
        p.score = max(p.score, -40000.0)
    out = tmp_path_factory.mktemp("models") / "unigram.model"
    out.write_bytes(m.SerializeToString())
    return {"bpe": path, "unigram": str(out)}


@pytest.mark.parametrize("kind", ["bpe", "unigram"])
def test_chunks_equal_the_library(models, kind):
    """Matrices of chunks that are cut anywhere, multiplied as a tree and scanned down again."""
    from sentencepiece import SentencePieceProcessor

    library, model = SentencePieceProcessor(model_file=models[kind]), sentencepiece_scan.load(models[kind])
    rng, wide = np.random.default_rng(2), 0
    for k in range(30):
        text = "".join(rng.choice(list("the and of in tion er aé日本\n  x1234567890zq☃"), 600))
        text, chunk = text.replace(" ", "") if k % 2 else text, int(rng.choice([33, 64, 200]))
        t = model.normal(text)
        assert k % 2 and kind == "bpe" or model.encode(t) == library.encode(text)
        n = max(1, len(t) // chunk)
        cuts = [(i * chunk, len(t) if i == n - 1 else (i + 1) * chunk) for i in range(n)]
        backs = [min(a, model.longest) for a, _ in cuts]
        chunks = [sentencepiece_scan.Chunk(model, t[a - back : b + 2 * model.longest], back, b - a, i == 0, i == n - 1) for i, ((a, b), back) in enumerate(zip(cuts, backs, strict=True))]
        matrices = [c.matrix() for c in chunks]
        wide += sum(m.size > 1 for m in matrices)
        groups = [matrices[i : i + 3] for i in range(0, n, 3)]
        ends = sentencepiece_scan.scan([sentencepiece_scan.product(g) for g in groups])
        states = list(itertools.chain.from_iterable(sentencepiece_scan.scan(g, *e) for g, e in zip(groups, ends, strict=True)))
        assert list(itertools.chain.from_iterable(c.ids(i, j)[0] for c, (i, j) in zip(chunks, states, strict=True))) == library.encode(text)
    assert wide > 150


def test_units_equal_the_library(models, spark):
    """Every unit of the documents, the long ones along the pieces as well."""
    from sentencepiece import SentencePieceProcessor

    docs = pd.read_parquet(f"{SF}/documents.parquet")["text"].dropna().tolist()
    for kind in ("bpe", "unigram"):
        library, model = SentencePieceProcessor(model_file=models[kind]), sentencepiece_scan.load(models[kind])
        for t in docs[: 200 if kind == "bpe" else 10]:
            assert model.encode(model.normal(t)) == library.encode(t)


def test_max_plus_is_associative():
    a, b, c = (np.random.default_rng(i).normal(size=(3, 3)) for i in range(3))
    m = sentencepiece_scan.multiply
    assert np.allclose(m(m(a, b), c), m(a, m(b, c)))


def test_sentencepiece_round_trip(spark, odd, empty, models):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=models["bpe"])
    got = sentencepiece_scan.round_trip(odd, models["bpe"], 2000)
    expect = collections.Counter()
    for r in odd.collect():
        ids = library.encode(r.text or "")
        expect[r.doc_id, len(ids), sum((x + 1) * (i + 1) for i, x in enumerate(ids)), True] += 1
    assert rows_of(got, "doc_id", "n_tokens", "id_digest", "round_trip") == expect
    assert got.agg(F.max("n_chunks")).first()[0] > 10
    encoded = sentencepiece_scan.encode(odd, models["bpe"], 2000)
    back = sentencepiece_scan.decode(encoded, models["bpe"]).toPandas().sort_values(["rid", "chunk"]).groupby("rid")["decoded"].agg("".join)
    assert sorted(back) == sorted(r.text or "" for r in odd.collect())
    assert sentencepiece_scan.round_trip(empty, models["bpe"]).count() == 0


# --- 3 language ID


def test_language_id(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(language_id.of_documents(docs)).join(docs.withColumnRenamed("doc_id", "id"), "id").toPandas()
    assert (got["language"] == got["lang"]).mean() > 0.98
    hidden = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))  # half are not declared
    got = language_id.identify(language_id.of_documents(hidden)).join(docs.withColumnRenamed("doc_id", "id"), "id").where("id % 2 = 1").toPandas()
    assert (got["language"] == got["lang"]).mean() > 0.95
    o = language_id.identify(language_id.of_documents(odd))
    assert o.count() == odd.count() and o.where("id IN (4, 5)").agg(F.max(F.col("kept").cast("int"))).first()[0] == 0
    assert language_id.identify(language_id.of_documents(empty)).count() == 0
    pages = spark.createDataFrame([(1, "https://a.example.de/x", '<HTML xml:lang="x" LANG=de><script>var a="</p>"</script><p>Hallo'), (2, None, None), (3, "no address", "")], "page_id long, url string, html string")
    p = {r.id: r for r in language_id.of_pages(pages).collect()}
    assert (p[1].declared, p[1].host, p[1].suffix) == ("de", "a.example.de", "de") and "var" not in p[1].text and p[2].declared is None and p[3].host is None


def test_language_id_knows_all_declared_languages(spark):
    """Also more than a block of them, and texts of the rarest."""
    rng = np.random.default_rng(6)
    letters = [rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7, replace=False) for _ in range(70)]
    text = lambda z: " ".join("".join(rng.choice(letters[z], 6)) for _ in range(40))
    rows = [(z * 100 + i, text(z), f"l{z:02}" if i < 6 + (z < 64) else None, f"host{z}", None) for z in range(70) for i in range(8)]
    got = language_id.identify(spark.createDataFrame(rows, "id long, text string, declared string, host string, suffix string")).collect()
    assert len(got) == len(rows) and np.mean([r.language == f"l{r.id // 100:02}" and r.kept for r in got]) > 0.95
    assert {r.language for r in got if r.kept} >= {f"l{z:02}" for z in range(70)}


# --- 4 decontamination


def brute_hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    hit, found = set(), set()
    for item, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        n = min(10, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
        for i in range(len(w) - n + 1) if n else ():
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add("null" if item is None else str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_decontaminate(spark, odd, empty, most):
    base = odd.where("doc_id = 1").first().text.split()
    items = [(1, " ".join(base[20:45])), (2, "One, TWO"), (3, None), (4, ""), (10, " ".join(base[20:45])), (None, " ".join(base[150:160])), (6, " ".join(base[190:199])), (7, "☃ 日本 Ünï"), (8, "never seen words here at all in any of the texts")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(odd, bench, most)
    expect = collections.Counter((r.doc_id, *brute_hits(r.text, items)) for r in odd.collect())
    assert rows_of(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == expect
    assert decontaminate.decontaminate(odd, bench.limit(0), most).where("contaminated").count() == 0
    assert decontaminate.decontaminate(empty, bench, most).count() == 0


def test_winnowing_keeps_a_print_of_every_window():
    rng = np.random.default_rng(3)
    for _ in range(20):
        h = rng.integers(0, 50, 60).astype(np.uint64)
        kept = set(decontaminate.winnow(h, np.arange(60) + 5 <= 60, 5).tolist())
        assert all(kept & set(range(i, i + 5)) for i in range(56))


# --- 5 token counts


def test_token_counts(spark, odd, empty, tmp_path):
    path = token_counts.vocabulary("byte_bpe_50k.tiktoken")
    got = token_counts.count_tokens(odd, {"v1": path})
    e = token_counts.encoder(path)
    assert rows_of(got, "doc_id", "v1") == collections.Counter((r.doc_id, len(e.encode_ordinary(r.text or ""))) for r in odd.collect())
    assert token_counts.count_tokens(empty, {"v1": path}).count() == 0
    change = "kind string, source string, lang string, tokenizer string, old_tokens long, new_tokens long"
    r = token_counts.Rollup(spark, str(tmp_path / "rollup"))
    assert r.totals().count() == 0
    first = spark.createDataFrame([("insert", "a", None, "v1", None, 10), ("insert", "a", None, "v1", None, 5), ("insert", None, "en", "v1", None, None)], change)
    assert r.commit(1, first) and not r.commit(1, first)
    r.commit(2, spark.createDataFrame([("revise", "a", None, "v1", 5, 7), ("delete", None, "en", "v1", 0, None)], change))
    expect = {("a", None, "v1", 2, 17): 1}
    assert rows_of(r.totals(), "source", "lang", "tokenizer", "n_docs", "n_tokens") == expect
    r.compact()
    r.compact()
    assert not r.commit(2, first) and rows_of(r.totals(), "source", "lang", "tokenizer", "n_docs", "n_tokens") == expect
    assert r.commit(3, first.limit(0)) and rows_of(r.totals(), "source", "lang", "tokenizer", "n_docs", "n_tokens") == expect
    (tmp_path / "rollup" / "batch=4").mkdir()  # a batch whose job died
    assert r.commit(4, spark.createDataFrame([("delete", "a", None, "v1", 10, None)], change))
    assert rows_of(r.totals(), "n_docs", "n_tokens") == {(1, 7): 1}
    with pytest.raises(Exception, match="unknown kind"):
        r.commit(5, spark.createDataFrame([("lose", "a", None, "v1", 1, 1)], change))


def test_token_counts_in_any_order(spark, tmp_path):
    """Deletes before their inserts, batches that come late, compactions between them: the totals are the plain sums."""
    change = "kind string, source string, lang string, tokenizer string, old_tokens long, new_tokens long"
    rng = np.random.default_rng(1)
    insert, delete = ("insert", "a", "en", "v1", None, 10), ("delete", "a", "en", "v1", 7, None)
    r = token_counts.Rollup(spark, str(tmp_path / "one"))
    for i, x in enumerate([insert, delete, ("insert", "a", "en", "v1", None, 7)], 1):
        assert r.commit(i, spark.createDataFrame([x], change))
        if i == 2:
            r.compact()
    assert rows_of(r.totals(), "n_docs", "n_tokens") == {(1, 10): 1}
    late = token_counts.Rollup(spark, str(tmp_path / "late"))
    sums, order = collections.Counter(), rng.permutation(6).tolist()
    for k, i in enumerate(order):
        rows = [("insert", f"s{rng.integers(2)}", "en", "v1", None, int(rng.integers(1, 100))) if rng.random() < 0.6 else ("delete", f"s{rng.integers(2)}", "en", "v1", int(rng.integers(1, 100)), None) for _ in range(5)]
        for kind, source, _, _, old, new in rows:
            sums[source, "docs"] += 1 if kind == "insert" else -1
            sums[source, "tokens"] += new or -old
        batch = spark.createDataFrame(rows, change)
        assert late.commit(i, batch) and not late.commit(i, batch)
        if k % 2:
            late.compact()
    assert not late.commit(order[0], batch)
    assert {(x.source, x.n_docs, x.n_tokens) for x in late.totals().collect()} == {(s, sums[s, "docs"], sums[s, "tokens"]) for s in ("s0", "s1") if sums[s, "docs"]}


def test_token_count_query(spark):
    docs, labels = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/labels.parquet")
    a, b = (token_counts.encoder(token_counts.vocabulary(f"{n}.tiktoken")) for n in ("byte_bpe_50k", "byte_bpe_multi_50k"))
    q = dict(zip(labels["doc_id"], labels["quality"], strict=True))
    expect = collections.defaultdict(lambda: [0, 0])
    for d in docs.itertuples():
        e, name = (b, "byte_bpe_multi_50k") if q.get(d.doc_id) == 1 else (a, "byte_bpe_50k")
        if q.get(d.doc_id) != 0:
            x = expect[d.source, d.lang, name]
            x[0], x[1] = x[0] + 1, x[1] + len(e.encode_ordinary(d.text))
    got = {(r.source, r.lang, r.tokenizer): [r.n_docs, r.n_tokens] for r in token_counts.query(spark, SF).collect()}
    assert got == dict(expect)


# --- 6 WARC


def test_arc_versions():
    for version in (1, 2):
        name = "x.arc"
        content = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nline\nhttp://a 1 2 3 4\n"
        data = warc.arc_version_block(name, version) + warc.arc_record(version, b"http://a/b c", content, b"text/html", name, 0) + warc.arc_record(version, b"dns:a", b"", b"text/dns", name, 1)
        got = list(warc.parse_arc(data))
        assert [(u, m, c) for _, u, _, m, c in got] == [(b"http://a/b c", b"text/html", content), (b"dns:a", b"text/dns", b"")]
        with pytest.raises(ValueError):
            list(warc.parse_arc(data[:-30]))
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"filedesc://x 0.0.0.0 2 text/plain 4\n9 0\n"))
    assert warc.split_http(b"plain") == (b"", b"plain")


@pytest.mark.parametrize("most", [10, 0])
def test_warc(spark, tmp_path, most):
    big = "é" * 700
    rows = [(1, "http://a", big), (2, "http://b", big), (3, None, big), (4, "http://d d", "x" * 999), (5, "http://e", "x" * 999), (6, "http://f", None), (6, "http://f", None), (7, "u", ""), (None, "http://n", big), (8, "http://g", "\r\n\r\nWARC/1.1\r\n" + "y" * 1000), (8, "http://g", "\r\n\r\nWARC/1.1\r\n" + "y" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rid", F.lit(1)).withColumn("payload", F.lit("z"))
    path = str(tmp_path / "out")
    warc.arc_to_warc(warc.pages_to_arc(pages, 2000), path, map_side=most)
    expect = collections.Counter()
    for page, _, html in rows:
        p = (html or "").encode()
        top = 3 if html == big else None
        again = top is not None and page != top
        expect[page, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", top if again else None] += 1
    assert rows_of(warc.read_warc(spark, path), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expect
    found = {}
    for f in sorted((tmp_path / "out").glob("part-*")):
        found |= {h["warc-record-id"]: h for h, _ in warc.parse_warc(io.BufferedReader(gzip.open(f)))}
    again = [h for h in found.values() if h["warc-type"] == "revisit"]
    assert len(again) == 3 and all(found[h["warc-refers-to"]]["warc-type"] == "response" and found[h["warc-refers-to"]]["warc-target-uri"] == h["warc-refers-to-target-uri"] for h in again)
    nothing = str(tmp_path / "nothing")
    warc.arc_to_warc(warc.pages_to_arc(pages.limit(0)), nothing)
    assert warc.read_warc(spark, nothing).count() == 0


# --- 7 sharding


def test_difference_keeps_sums():
    rng = np.random.default_rng(4)
    for n, k in ((1, 8), (7, 3), (200, 8)):
        sizes = rng.integers(1, 1000, n).tolist()
        places, total = sharding.difference([[s] + [0] * (k - 1) for s in sizes], k)
        sums = [0] * k
        for s, p in zip(sizes, places, strict=True):
            assert sorted(p) == list(range(k))
            sums[p[0]] += s
        assert sums == total and (n < 100 or max(sums) - min(sums) <= 5)
    assert sharding.difference([], 4) == ([], [0] * 4)


def test_differencing_beats_greedy():
    sizes = [8, 7, 6, 5, 4]
    _, total = sharding.difference([[s, 0] for s in sizes], 2)
    assert max(total) - min(total) == 2


@pytest.mark.parametrize("fan_in", [4096, 3])
def test_shard(spark, odd, empty, fan_in):
    got = sharding.shard(odd, 4, fan_in, 2).toPandas()
    expect = collections.Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert collections.Counter((None if pd.isna(a) else int(a), b, c) for a, b, c in zip(got["doc_id"], got["size"], got["text_crc32"], strict=True)) == expect
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert got[got["size"] > 1].groupby("text_crc32")["shard"].nunique().max() == 1
    assert sharding.shard(empty).count() == 0


def test_slots_of_equal_rows(spark):
    """Very many equal rows: still gapless, and in more than one sub-bucket."""
    docs = spark.createDataFrame([(7, "same")] * 300 + [(i, f"t{i}") for i in range(50)], "doc_id long, text string")
    got = sharding.shard(docs, 4, slot_rows=20).toPandas()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert got[got["doc_id"] == 7][["size", "text_crc32", "shard"]].drop_duplicates().shape[0] <= 2


def test_differencing_equals_a_plain_version():
    """The same combinations, written out on lists of items."""
    rng = np.random.default_rng(12)
    for n, k in ((1, 3), (5, 2), (40, 4), (120, 8)):
        sizes = rng.integers(1, 1000, n).tolist()
        parts = [(i, [[i]] + [[] for _ in range(k - 1)]) for i in range(n)]
        load = lambda bins: sorted((sum(sizes[x] for x in b) for b in bins), reverse=True)
        made = n
        while len(parts) > 1:
            parts.sort(key=lambda p: (load(p[1])[-1] - load(p[1])[0], p[0]))
            (_, a), (_, b), parts = parts[0], parts[1], parts[2:]
            by = lambda bins: sorted(bins, key=lambda x: -sum(sizes[i] for i in x))
            parts.append((made, [x + y for x, y in zip(by(a), reversed(by(b)), strict=True)]))
            made += 1
        _, total = sharding.difference([[s] + [0] * (k - 1) for s in sizes], k)
        assert sorted(total, reverse=True) == load(parts[0][1])


def test_shards_are_even(spark):
    got = sharding.query(spark, SF).groupBy("shard").agg(F.sum("size").alias("s")).toPandas()["s"]
    assert len(got) == 8 and got.max() - got.min() <= 0.001 * got.mean()


# --- 8 LM scoring


@pytest.mark.parametrize(("chunk", "group"), [(100, 1000), (1, 1), (2, 4), (3, 1)])
def test_forward_and_counts_equal_enumeration(monkeypatch, chunk, group):
    """Also where texts are cut into chunks, and chunks are handled in groups."""
    monkeypatch.setattr(lm_scoring, "CHUNK", chunk)
    monkeypatch.setattr(lm_scoring, "GROUP", group)
    rng = np.random.default_rng(1)
    s, v = 3, 5
    m = lm_scoring.Model(rng.dirichlet(np.ones(s)), rng.dirichlet(np.ones(s), s), rng.dirichlet(np.ones(v), s).T.copy())
    texts = [rng.integers(0, v, n) for n in (1, 4, 2, 7, 3)]
    flat, starts = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    expect, logs = [np.zeros(s), np.zeros((s, s)), np.zeros((v, s))], []
    for x in texts:
        total, own = 0.0, [np.zeros(s), np.zeros((s, s)), np.zeros((v, s))]
        for z in itertools.product(range(s), repeat=len(x)):
            p = m.start[z[0]] * np.prod([m.emit[b, a] for a, b in zip(z, x, strict=True)]) * np.prod([m.move[a, b] for a, b in itertools.pairwise(z)])
            total += p
            own[0][z[0]] += p
            for a, b in itertools.pairwise(z):
                own[1][a, b] += p
            for a, b in zip(z, x, strict=True):
                own[2][b, a] += p
        logs.append(math.log(total))
        expect = [e + o / total for e, o in zip(expect, own, strict=True)]
    assert np.allclose(lm_scoring.Chunks(m, flat, starts).logs(), logs)
    *got, log = lm_scoring.baum_welch(m, flat, starts)
    assert log == pytest.approx(sum(logs)) and all(np.allclose(a, b) for a, b in zip(got, expect, strict=True))


def test_lm_forward_runs_once_a_symbol(monkeypatch):
    """Also over texts that are cut into chunks, and over texts that fill a group to the last symbol."""
    monkeypatch.setattr(lm_scoring, "CHUNK", 10)
    monkeypatch.setattr(lm_scoring, "GROUP", 200)
    ran, forward = [], lm_scoring.Chunks._forward
    monkeypatch.setattr(lm_scoring.Chunks, "_forward", lambda self, rows, *a: ran.append(int(self.n[rows].sum())) or forward(self, rows, *a))
    rng = np.random.default_rng(4)
    m = lm_scoring.starting_model(np.full(6, 1 / 6), 3)
    starts = np.concatenate([[0], np.cumsum([5, 35, 10, 100, 50])])
    flat = rng.integers(0, 6, starts[-1])
    *_, log = lm_scoring.baum_welch(m, flat, starts)
    assert ran == [200]
    ran.clear()
    assert lm_scoring.Chunks(m, flat, starts).logs().sum() == pytest.approx(log) and ran == [15]


def test_lm_groups_are_alike_in_length(monkeypatch):
    """A loop over a group's longest chunk isn't paid for by every group; counts don't depend on the groups."""
    rng = np.random.default_rng(6)
    n = rng.permutation(np.repeat([2, 5, 40, 90], 50))
    m, starts = lm_scoring.starting_model(np.full(6, 1 / 6), 3), np.concatenate([[0], np.cumsum(n)])
    flat = rng.integers(0, 6, starts[-1])
    ran, steps = [], lm_scoring.Chunks._steps
    monkeypatch.setattr(lm_scoring.Chunks, "_steps", lambda self, rows: ran.append(int(self.n[rows].max())) or steps(self, rows))
    monkeypatch.setattr(lm_scoring, "CHUNK", 60)
    expect = lm_scoring.baum_welch(m, flat, starts)
    logs = lm_scoring.Chunks(m, flat, starts).logs()
    ran.clear()
    monkeypatch.setattr(lm_scoring, "GROUP", 500)
    got = lm_scoring.baum_welch(m, flat, starts)
    assert all(np.allclose(a, b) for a, b in zip(got, expect, strict=True))
    assert ran.count(60) <= 15 and min(ran) <= 5
    assert np.allclose(lm_scoring.Chunks(m, flat, starts).logs(), logs)


def test_baum_welch_climbs():
    rng = np.random.default_rng(2)
    texts = [np.repeat(rng.integers(0, 2), 20) * 3 + rng.integers(0, 3, 20) for _ in range(40)]
    flat, starts = np.concatenate(texts), np.arange(41) * 20
    m = lm_scoring.starting_model(np.full(6, 1 / 6), 2)
    logs = []
    for _ in range(5):
        *counts, log = lm_scoring.baum_welch(m, flat, starts)
        logs.append(log)
        m = lm_scoring.Model(counts[0] / counts[0].sum(), counts[1] / counts[1].sum(axis=1, keepdims=True), counts[2] / counts[2].sum(axis=0, keepdims=True))
    assert all(b >= a - 1e-6 for a, b in itertools.pairwise(logs))


def brute_scores(rows, fitted):
    """Log10 probability of each text by the plain forward recursion in logarithms, from the table of words."""
    states = len(fitted.start)
    words_of = {r.h: (r.c, np.frombuffer(r.n, dtype=np.float32).astype(float)) for r in fitted.words.collect()}
    n, v = sum(c for c, _ in words_of.values()), len(words_of)
    total = sum((x for _, x in words_of.values()), np.zeros(states))
    out = []
    for text in rows:
        block = common.Block(np.frombuffer((text or "").encode(), dtype=np.uint8), np.array([0, len((text or "").encode())]), common.NONSPACE)
        a, log = None, 0.0
        for h in lm_scoring.tokens_of(block)[0].view(np.int64).tolist():
            c, x = words_of.get(h, (0, np.zeros(states)))
            e = (x + fitted.beta * (c + 1) / (n + v + 1)) / (total + fitted.beta)
            a = (fitted.start if a is None else a @ fitted.move) * e
            log, a = log + math.log10(a.sum()), a / a.sum()
        out.append(log)
    return out


@pytest.mark.parametrize(("head", "chunk"), [(32_768, 4096), (50, 700), (0, 4096)])
def test_lm_score(spark, odd, empty, monkeypatch, head, chunk):
    monkeypatch.setattr(lm_scoring, "HEAD", head)
    monkeypatch.setattr(lm_scoring, "CHUNK", chunk)
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", 1000 if head == 50 else 2_000_000)
    made = []
    fit = lm_scoring.fit
    monkeypatch.setattr(lm_scoring, "fit", lambda *a: made.append(fit(*a)) or made[-1])
    got = lm_scoring.lm_score(odd, states=2)
    rows = odd.collect()
    held = [r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows]
    tokens = [[*words(r.text), "\n"] for r in rows]
    c = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    scores = brute_scores([r.text for r in rows], made[0])
    expect = collections.Counter((r.doc_id, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 3), round(x, 2)) for r, t, h, x in zip(rows, tokens, held, scores, strict=True))
    assert rows_of(got.withColumns({"base_score": F.round("base_score", 3), "score": F.round("score", 2)}), "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score") == expect
    assert lm_scoring.lm_score(empty, states=2).count() == 0


def test_lm_states_tell_rare_words_apart(spark):
    """Words outside of the head, alike in count, belong to the states of the texts they were seen in."""
    rng = np.random.default_rng(3)
    common_words = [[f"{side}{i}" for i in range(10)] for side in ("left", "right")]
    rare = [[f"{side}{i:03}zz" for i in range(100)] for side in ("l", "r")]
    text = lambda a, b: " ".join(itertools.chain.from_iterable(zip(rng.choice(common_words[a], 30), rng.permutation(rare[b])[:30], strict=True)))
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    ids = [i for i in range(300) if not held(i)]
    rows = [(i, text(i % 2, i % 2)) for i in ids]
    at, crossed = [i for i in range(1000, 2000) if held(i)][:40], {}
    for k, i in enumerate(at):
        own = text(k % 2, k % 2)
        mixed = own.split()
        mixed[1::2] = rng.permutation(rare[1 - k % 2])[:30]
        rows += [(i, own), (i + 5000, " ".join(mixed))] if held(i + 5000) else []
        crossed |= {i: i + 5000} if held(i + 5000) else {}
    assert crossed
    got = {r.doc_id: r.score for r in lm_scoring.lm_score(spark.createDataFrame(rows, "doc_id long, text string"), states=2).collect()}
    assert all(got[a] > got[b] + 1 for a, b in crossed.items())


@pytest.mark.parametrize("most", [0, 10, 120, 500])
def test_lm_head_is_filled(spark, most):
    """Also where very many words have equal counts: to a range of hashes (one of 4096) below the limit."""
    rng = np.random.default_rng(5)
    rows = [(int(x), 9 if i < 50 else 100 if i < 52 else 1) for i, x in enumerate(rng.integers(-(1 << 63), (1 << 63) - 1, 400))]
    df = spark.createDataFrame(rows, "h long, c long")
    got = [tuple(r) for r in df.where(lm_scoring.head_of(df, most)).collect()]
    expect = sorted(rows, key=lambda r: (-r[1], r[0] >> 52))[: len(got)]
    assert sorted(got) == sorted(expect) and min(most, 400) - 3 <= len(got) <= most


def test_lm_emissions_sum_to_one(spark):
    rows = [(i, f"{'a b c d'[i % 7:]} word{i} tail{i % 5}") for i in range(60)]
    f = lm_scoring.fit(spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", lm_scoring.held_out()), 3)
    w = f.words.toPandas()
    e = f.emissions(np.append(w["c"], 0), np.concatenate([np.stack([np.frombuffer(x, dtype=np.float32) for x in w["n"]]), np.zeros((1, 3))]))
    assert np.allclose(e.sum(axis=0), 1)


def test_lm_training_sees_all_texts(spark, monkeypatch):
    """Rare kinds of text, all of them longer than a chunk, have a part in each round."""
    seen = []
    update = lm_scoring.Model.update
    monkeypatch.setattr(lm_scoring.Model, "update", lambda self, *a: seen.append(a[2].sum()) or update(self, *a))
    rows = [(i, "one two three") for i in range(20)] + [(i, "seldom " * 5000) for i in range(100, 110)]
    train = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    fitted = lm_scoring.fit(spark.createDataFrame(rows, "doc_id long, text string").withColumn("held_out", lm_scoring.held_out()), 2)
    tokens = sum(len(words(t)) + 1 for _, t in train)
    assert len(seen) > 3 and all(x == pytest.approx(tokens) for x in seen[:-1]) and fitted.state_n.sum() == pytest.approx(tokens, rel=1e-4)


@pytest.mark.parametrize("held", [4_000_000, 60])
def test_lm_words_travel_packed(spark, monkeypatch, held):
    """A row holds all words of a part of the table, also of texts that are longer than what is held."""
    made, deal = [], type(spark.range(0)).repartitionById
    monkeypatch.setattr(type(spark.range(0)), "repartitionById", lambda self, *a: made.append(self.where("h IS NOT NULL").count()) or deal(self, *a))
    monkeypatch.setattr(lm_scoring, "HELD", held)
    monkeypatch.setattr(lm_scoring, "GROUP", held)
    monkeypatch.setattr(lm_scoring, "WORD_TOKENS", 1000)
    texts = [(i, " ".join(f"w{i}x{k % 70}" for k in range(100))) for i in range(40)]
    train = [t for i, t in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    fitted = lm_scoring.fit(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).withColumn("held_out", lm_scoring.held_out()), 2)
    c = collections.Counter(w for t in train for w in [*t.split(), "\n"])
    rows = fitted.words.collect()
    assert sorted(r.c for r in rows) == sorted(c.values()) and made[0] < len(c) / 2
    assert all(np.frombuffer(r.n, dtype=np.float32).sum() == pytest.approx(r.c, rel=1e-4) and r.d <= r.c for r in rows)


def test_lm_beats_unigrams(spark):
    r = lm_scoring.query(spark, SF).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


# --- 9 near-dedup


def brute_components(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset([tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i)), d is not None and d == least.get(root(i))) for i, (d, _) in enumerate(rows)]


def test_near_dedup_odd(spark, odd, empty):
    got = near_dedup.near_dedup(odd)
    assert rows_of(got, "doc_id", "n_shingles", "component_id", "kept") == collections.Counter(brute_components([(r.doc_id, r.text) for r in odd.collect()]))
    assert near_dedup.near_dedup(empty).count() == 0


def test_near_dedup_families(spark, monkeypatch):
    """Copies at all degrees of similarity, with chains that only strays connect; small blocks, so that buckets are split."""
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    rng = np.random.default_rng(6)
    rows = []
    for _ in range(4):
        now = [f"w{rng.integers(10_000)}" for _ in range(120)]
        for _ in range(25):
            now = list(now)
            for _ in range(int(rng.integers(0, 4))):
                now[rng.integers(len(now))] = f"w{rng.integers(10_000)}"
            rows.append((len(rows), " ".join(now)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(near_dedup.near_dedup(docs), "doc_id", "n_shingles", "component_id", "kept") == collections.Counter(brute_components(rows))


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(8)
    a, b = (rng.integers(0, 2**63, 300).astype(np.uint64) for _ in range(2))
    both = rng.integers(0, 2**63, 900).astype(np.uint64)
    x, y = np.concatenate([a, both]), np.concatenate([b, both])
    r = lambda v: near_dedup.registers_of(v, np.array([0, len(v)]))[0]
    assert (near_dedup.merge(r(x), r(y)) == r(np.unique(np.concatenate([x, y])))).all()
    n = np.array([1200.0])
    got = near_dedup.estimate(np.array([(r(x) > r(y)).sum()]), np.array([(r(x) < r(y)).sum()]), n, n)[0]
    assert got == pytest.approx(0.6, abs=0.15)
    assert (near_dedup.unpack(near_dedup.pack(x)) == np.sort(x)).all()


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101), (101, 100), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in near_dedup.components(links).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100}


def test_components_of_a_long_chain(spark):
    """Neither the estimates of sizes nor the files in the shared folder grow with the rounds."""
    rng = np.random.default_rng(9)
    name = rng.permutation(2001).tolist()
    links = spark.createDataFrame([(name[i], name[i + 1]) for i in range(2000)], "u long, v long")
    with common.scope(spark) as kept:
        got = near_dedup.components(links)
        kept.append(got)
    assert {r.root for r in got.collect()} == {0} and got.count() == 2001
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 63
    assert not common._scopes


# --- 10 quality rules


def test_quality_rules(spark, odd, empty):
    text = "the cat sat on the mat\nthe cat sat on the mat\n\nthe dog | $5 #tag\n  \n"
    docs = odd.select(*DOCS.replace(" long", "").replace(" string", "").split(", ")).unionByName(spark.createDataFrame([(50, text, "en", "a", 0), (51, "Ä b\tc", "en", "a", 0)], DOCS))
    expect = collections.Counter()
    for r in docs.collect():
        t = r.text or ""
        w = SPACE.findall(t)
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        rep = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in t.split("\n") if SPACE.search(x)]
        expect[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep), len(w) < 50 or 100 * len(rep) > 50 * len(w)] += 1
    got = quality_rules.quality_rules(docs)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == expect
    assert got.where("kept AND base_failed").count() == 0 and quality_rules.quality_rules(odd).count() == odd.count()
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_agree_with_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    r = quality_rules.query(spark, SF).join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert r[r["quality"] == 1]["kept"].mean() > 0.98 and r[r["quality"] == 0]["kept"].mean() < 0.5


def test_quality_rules_with_few_languages(spark, duck, tmp_path):
    """Documents without a language, and of a language too rare for a reference; against the SQL."""
    import duckdb

    rng = np.random.default_rng(5)
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    docs["lang"] = [None if i % 5 == 0 else "xx" if i % 50 == 1 else z for i, z in enumerate(docs["lang"])]
    docs.loc[rng.integers(0, len(docs), 5), "text"] = None
    docs = docs.astype(object).where(docs.notna(), None)
    docs["doc_id"] = docs["doc_id"].astype("int64")
    docs.to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    assert same(quality_rules.query(spark, str(tmp_path)), con.sql(quality_rules.SQL))


def test_common_words_are_learned(spark):
    rows = [(i, f"alpha beta{i} 12 " + f"w{i} " * 50, "aa") for i in range(40)] + [(100 + i, "gamma alpha " + f"v{i} " * 50, "bb") for i in range(30)]
    lists, every = quality_rules.common_words(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {r.lang: list(r.common) for r in lists.collect()} == {"aa": ["alpha"], "bb": ["alpha", "gamma"]} and every[:2] == ["alpha", "gamma"]


# --- the pipeline


def test_pipeline_stages(spark, odd, empty):
    clean = spark.read.parquet(f"{SF}/documents.parquet")
    docs = clean.unionByName(odd, allowMissingColumns=True)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns, name
            keys = rows_of(out, "doc_id", "text")
            assert not keys - rows_of(docs, "doc_id", "text"), name
        assert stage(spark, empty, SF).count() == 0, name
    assert out.count() == docs.count()


def test_pipeline_dedup_leaves_one(spark, odd):
    out = corpus_pipeline.dedup(spark, odd, SF)
    got = rows_of(out, "doc_id", "text")
    base = odd.where("doc_id = 1").first().text
    assert got[1, base] == 1 and (2, base) not in got and not any(d == 3 for d, _ in got) and got[7, "one two"] == 1 and (12, "one two") not in got
    assert got[4, None] == 1 and got[5, ""] == 1 and out.columns == odd.columns


def test_pipeline_equals_brute_force(spark):
    """Stage by stage: each verdict again from its operator's own rows, near-duplicates and benchmark hits by brute force."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keep = lambda df, key="doc_id": {r[key] for r in df.where("kept").collect()}
    left = docs.where(F.col("doc_id").isin(keep(quality_rules.quality_rules(docs))))
    left = left.where(F.col("doc_id").isin(keep(language_id.identify(language_id.of_documents(left)), "id")))
    kept = [x[0] for x in brute_components([(r.doc_id, r.text) for r in left.collect()]) if x[3]]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r.doc_id: r.text for r in left.collect()}
    expect = {d for d in kept if not brute_hits(texts[d], items)[4]}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == expect and len(got) == len(expect) and all(r.round_trip for r in got)


def test_rows_of_numbers_unpack_without_objects():
    """Rows of the table of words, whole, sliced and in chunks, as numbers; memory is that of the numbers, not of a Python object a row."""
    import tracemalloc

    import pyarrow as pa

    from tessera.llm import lm_scoring

    n = np.arange(8 * 50_000, dtype=np.float32).reshape(-1, 8)
    column = lm_scoring._packed(n)
    tracemalloc.start()
    got = lm_scoring.unpacked(column, 8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == n).all() and got.dtype == float and peak < 2 * got.nbytes
    assert (lm_scoring.unpacked(column.slice(3, 5), 8) == n[3:8]).all()
    assert (lm_scoring.unpacked(pa.chunked_array([column.slice(7, 2), column.slice(0, 0), column.cast(pa.large_binary()).cast(pa.binary()).slice(9)]), 8) == n[7:]).all()
    assert (lm_scoring.unpacked(column.cast(pa.large_binary()).slice(2, 4), 8) == n[2:6]).all()
    assert lm_scoring.unpacked(pa.array([], pa.binary()), 8).shape == (0, 8)
    with pytest.raises(ValueError):
        lm_scoring.unpacked(pa.array([None], pa.binary()), 8)
