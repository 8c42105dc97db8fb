"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import hashlib

import pytest
from pyspark.sql import functions as F

from stratacast.llm import archives, decontaminate, embeddings, language, mixing, neardup, pagetext, quality, secrets, simhash, urls
from stratacast.llm.runtime import scratch_path

LONG = "lorem ipsum dolor " * 20_000
CLASH = ["fp", "words", "text_key", "least", "node", "component", "source_", "key", "start", "block", "held", "id", "good", "path", "digest", "unit", "cid", "_text", "_nth", "nth", "good", "log_weight", "_log_weight", "label_id", "doc", "run", "starts", "mins", "token", "index"]


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 69),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a", 69),
        (2, None, None, None, None),
        (3, "", "en", "a", 0),
        (None, "some words without an id", "en", None, 24),
        (4, LONG, "la", "b", len(LONG)),
        (5, "12345 --- !!!", None, "b", 13),
        (6, "Étréque \U0001f600 ok", "fr", "b", 12),
    ]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="module")
def items(spark):
    rows = [(7, "quick brown fox jumps over the lazy dog near the river"), (8, "fox jumps"), (None, "some words"), (9, None), (10, "")]
    return clashing(spark.createDataFrame(rows, "item_id long, text string"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (3, None, 0), (5, 0, 0), (None, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def pages(spark):
    html = "<html><body><nav><a href='/'>Home</a></nav><article><p>One &amp; two<p>three</article></body></html>"
    rows = [(1, "http://a.example.com/en/x", html), (2, "HTTP://A.Example.com/en/7?x", html), (2, "HTTP://A.Example.com/en/7?x", html), (3, None, None), (None, "nothing", ""), (4, "http://b.net/de/1", "<div>" + LONG)]
    return clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_simhash(docs):
    out = simhash.simhash_components(docs).collect()
    assert len(out) == 8
    zero = [r for r in out if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {2, 3} and {r.component_id for r in zero} == {2}
    assert [r.component_id for r in out if r.doc_id is None] == [None]
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_mixing(docs):
    out = mixing.mix_sources(docs, block_tokens=100).collect()
    assert all(r.source in ("", "a", "b") for r in out)
    for b in {r.block for r in out}:
        assert sorted(r.position for r in out if r.block == b) == list(range(1, 1 + sum(r.block == b for r in out)))
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs.withColumn("text", F.lit(None))).count() == 0


def test_archives(spark, pages):
    out = archives.archive_pages(pages, scratch_path(spark, "edge")).collect()
    assert len(out) == 6
    by = {(r.page_id, r.record_type): r for r in out}
    assert sum(r.page_id == 2 for r in out) == 2
    assert by[2, "revisit"].refers_to == 1 and by[1, "response"].refers_to is None
    assert by[None, "revisit"].refers_to == 3 and by[3, "response"].payload_bytes == 0
    assert archives.archive_pages(pages.limit(0), scratch_path(spark, "none")).count() == 0


def test_embeddings(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [None, 1.0], 1), (9, [nan, 1.0], 1), (None, [1.0, 0.005], 1), (10, [1.0, 0.0, 0.0], 1)]
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    out = embeddings.near_vectors(df).collect()
    assert len(out) == 12
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in out}
    assert got == {(1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False)} | {(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10)}
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_page_text(pages):
    out = {(r.page_id, r.text) for r in pagetext.extract_text(pages).collect()}
    assert (1, "One & two\nthree") in out and (3, "") in out and (None, "") in out
    assert any(p == 4 and len(t) == len(LONG.strip()) for p, t in out)
    assert pagetext.extract_text(pages.limit(0)).count() == 0


def test_urls(pages):
    out = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, urls.production_rules()).collect()]
    assert out.count((2, "a.example.com", "/en/7", "example.com/en/7", "allow")) == 2
    assert (1, "a.example.com", "/en/x", "com/en/", "block") in out
    assert (4, "b.net", "/de/1", "net/de/", "allow") in out
    assert (3, "", "", None, "allow") in out and (None, "", "", None, "allow") in out
    assert urls.judge_urls(pages.limit(0), urls.production_rules()).count() == 0


def test_contamination(docs, items):
    out = decontaminate.contamination(docs, items).collect()
    assert len(out) == 8
    one = [r for r in out if r.doc_id == 1]
    assert len(one) == 2 and all((r.n_words, r.n_hit, r.n_items) == (14, 11, 2) for r in one)
    assert one[0].items_sha256 == hashlib.sha256(b"7,8").hexdigest()
    anon = next(r for r in out if r.doc_id is None)
    assert (anon.n_hit, anon.n_items, anon.contaminated) == (2, 0, True)
    assert {(r.n_words, r.n_hit) for r in out if r.doc_id in (2, 3)} == {(0, 0)}
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items.limit(0)).collect())
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {2, 3, 4, 5, 6}


def test_blocks_of_the_benchmark_give_the_same(docs, items):
    whole = sorted(map(str, decontaminate.contamination(docs, items).collect()))
    assert sorted(map(str, decontaminate.contamination(docs, items, block_bytes=200).collect())) == whole


def test_quality(docs, labels):
    out = quality.select_documents(docs, labels).collect()
    assert len(out) == 8 and {r.log_weight for r in out if r.doc_id in (2, 3)} == {0.0}
    assert all(r.selected for r in quality.select_documents(docs, labels.limit(0)).collect())
    assert quality.select_documents(docs.limit(0), labels).count() == 0
    kept = quality.keep_selected(docs, labels)
    assert kept.columns == docs.columns
    chosen = sorted(str(r.doc_id) for r in out if r.selected)
    assert sorted(str(r.doc_id) for r in kept.collect()) == chosen
    assert quality.keep_selected(docs.limit(0), labels).count() == 0


def test_secrets(docs):
    out = secrets.scan_secrets(docs).collect()
    assert len(out) == 8 and all(r.spans == "" and r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in out)
    same = secrets.redact_secrets(docs)
    assert same.columns == docs.columns and sorted(map(str, same.collect())) == sorted(map(str, docs.collect()))
    assert secrets.scan_secrets(docs.limit(0)).count() == 0


def test_language(docs):
    model = language.fit(docs)
    out = language.identify(docs, model).collect()
    assert len(out) == 8
    assert {(r.lang_pred, r.score) for r in out if r.doc_id in (2, 3, 5)} == {("und", 0.0)}
    none = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_near_duplicates(docs):
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "5", "6", "None"]
    assert neardup.drop_near_duplicates(docs.limit(0)).count() == 0


def test_rows_are_dropped_by_id_and_text(spark, items):
    def prose(tag, n=30):
        return " ".join(f"{tag}{i}" for i in range(n))

    copied = prose("c")
    rows = [
        (1, copied), (None, copied), (None, prose("p")), (None, prose("q")), (None, prose("q")), (None, prose("q") + " tail"),
        (7, copied), (7, prose("r")), (7, prose("s")), (7, prose("s")),
    ]
    kept = neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((str(r.doc_id), r.text.split()[0]) for r in kept)
    assert got == sorted([("1", "c0"), ("None", "p0"), ("None", "q0"), ("7", "r0"), ("7", "s0")])
    leak = "quick brown fox jumps over the lazy dog near the river"
    rows = [(None, leak), (None, "a clean text"), (7, leak), (7, "another clean text"), (7, "another clean text")]
    kept = decontaminate.drop_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted(r.text for r in kept) == ["a clean text", "another clean text", "another clean text"]
