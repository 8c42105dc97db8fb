"""Operators against brute force, SQL, exact round trips and held-out accuracy."""

import hashlib
import html
import itertools
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from conftest import same
from pyspark.sql import functions as F

from stratacast.llm import archives, components, decontaminate, embeddings, language, mixing, neardup, pagetext, quality, secrets, simhash, urls
from stratacast.llm.queries import ORACLES, QUERIES
from stratacast.llm.runtime import scratch_path, small_batches, spooled, written


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, duck, sf_dir, name):
    same(QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df())


# components

@pytest.mark.parametrize("large", [0, 1_000_000])
def test_components(monkeypatch, spark, large):
    monkeypatch.setattr(components, "LARGE", large)
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 100), (100, 100), (None, 3), (7, 300)]
    got = dict(tuple(r) for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in [*range(41), 300]} | {100: 100, 105: 100}


# SimHash

def _components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: _plain_fingerprint(r.text) for r in rows}
    links = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 2]
    roots = _components(prints, links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash"](spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", roots[i]) for i in prints}


@pytest.mark.parametrize("limit", [4, 64, 4096])
def test_dense_balls_of_fingerprints(spark, limit):
    """Nodes far beyond the limit are cut by further masks and lose no link."""
    rng = np.random.default_rng(limit)
    centre = int(rng.integers(0, 1 << 62))
    values = {centre} | {centre ^ 1 << int(i) for i in rng.integers(0, 63, 40)} | {centre ^ int(rng.integers(0, 1 << 20)) for _ in range(60)} | {int(x) for x in rng.integers(0, 1 << 62, 60)}
    roots = _components(values, [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 2])
    links = simhash.hamming_links(spark.createDataFrame([(v,) for v in values], "fp long"), 2, limit).collect()
    assert _components(values, [(r.a, r.b) for r in links]) == roots


def test_gray_rank_counts_up():
    codes = np.array([i ^ i >> 1 for i in range(1000)], dtype=np.uint64)
    assert (simhash.gray_rank(codes) == np.arange(1000)).all()


# near duplicates

def test_near_duplicates_equal_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.limit(60).select((F.col("doc_id") + 10_000).alias("doc_id"), F.concat("text", F.lit(" tail")).alias("text"), "lang", "source", "n_chars")
    docs = docs.unionByName(extra)
    sets = {r.doc_id: set(neardup.shingle_set(r.text.encode(), 5).tolist()) for r in docs.select("doc_id", "text").collect()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = set(_components(sets, links).values())
    got = {r.doc_id for r in neardup.drop_near_duplicates(docs).collect()}
    assert got >= want and len(got - want) <= 0.02 * len(links) + 1


def test_no_pair_of_short_texts_is_missed(spark):
    """Sets of 1 to 20 shingles that share four fifths exactly, and some that share a little less."""
    rng, rows = np.random.default_rng(5), []
    for _ in range(400):
        n = int(rng.integers(5, 19))
        base = [f"w{x}" for x in rng.integers(0, 10_000, n)]
        rows += [base, base + [f"t{x}" for x in rng.integers(0, 10_000, int(rng.integers(0, 6)))], base[int(rng.integers(0, 3)) :]]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    sets = {i: set(neardup.shingle_set(t.encode(), 5).tolist()) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    got = {r.doc_id for r in neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(_components(sets, links).values())


@pytest.mark.parametrize(("rows_of_block", "shingles"), [(3, 1 << 20), (512, 200)])
def test_block_boundaries_keep_links(monkeypatch, spark, rows_of_block, shingles):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows_of_block)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(i, base + f" x{i}") for i in range(10)] + [(99, "other words entirely " * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.drop_near_duplicates(docs).collect()) == [0, 99]


@pytest.mark.parametrize("rows_of_node", [2, 5, 4096])
def test_nodes_keep_the_links_of_a_chain(monkeypatch, spark, rows_of_node):
    monkeypatch.setattr(neardup, "NODE_ROWS", rows_of_node)
    # each print differs from the next in 3 bits; far ends in many; nodes of 40 rows, and small ones around
    prints = [(n, 100 * n + i, (1 << 3 * i) - 1 if i < 21 else -1, 0 if i < 21 else (1 << 3 * (i - 20)) - 1) for n in (1, 4) for i in range(40)]
    prints += [(n, 100 * n + i, i * 7, 0) for n in (0, 2, 3) for i in range(3)]
    prints = [prints[i] for i in np.random.default_rng(3).permutation(len(prints))]
    df = spark.createDataFrame(prints, "node long, fid long, f0 long, f1 long").coalesce(1)
    got = dict(tuple(r) for r in components.connected_components(neardup.node_links(df, 3)).collect())
    rows = {fid: (n, f0 % (1 << 64), f1) for n, fid, f0, f1 in prints}
    near = [(a, b) for a, b in itertools.combinations(rows, 2) if rows[a][0] == rows[b][0] and (rows[a][1] ^ rows[b][1]).bit_count() + (rows[a][2] ^ rows[b][2]).bit_count() <= 3]
    want = _components(rows, near)
    assert {fid: got.get(fid, fid) for fid in rows} == want and len(set(want.values())) < len(rows)


def test_sets_stay_whole_when_links_come_in_parts():
    labels = simhash._settle(np.arange(12), np.array([10]), np.array([11]))
    labels = simhash._settle(labels, np.array([11, 10]), np.array([5, 3]))
    assert labels[[3, 5, 10, 11]].tolist() == [3, 3, 3, 3]


def test_near_dedup_searches_gray_order_trees(spark, monkeypatch):
    rng, radius = np.random.default_rng(4), 24
    heads = rng.integers(0, 1 << 63, (40, 2), dtype=np.int64)
    prints = heads[rng.integers(0, 40, 1500)]
    for _ in range(14):  # chains and dense groups: up to 14 bits of each row turned over
        flip, at = np.zeros_like(prints), rng.integers(0, 63, 1500)
        flip[np.arange(1500), rng.integers(0, 2, 1500)] = np.left_shift(1, at)
        prints = np.where(rng.random((1500, 1)) < 0.9, prints ^ flip, prints)
    nodes = rng.integers(0, 30, 1500) * (rng.random(1500) < 0.5)  # one node of half the rows
    labels = simhash.linked_within(nodes, prints.view(np.uint64), radius)
    x = prints.view(np.uint64)
    want = np.arange(1500)
    bits = sum(np.bitwise_count(x[:, None, w] ^ x[None, :, w]).astype(int) for w in (0, 1))
    a, b = np.nonzero((bits <= radius) & (nodes[:, None] == nodes[None, :]))
    want = simhash._settle(want, a, b)
    assert len(set(zip(labels, want, strict=True))) == len(set(want)) == len(set(labels)) and (labels[labels] == labels).all()
    order = simhash.gray_order(np.zeros(16, dtype=int), np.array([[i >> 2, i & 3] for i in range(16)], dtype=np.uint64))
    steps = np.array([[i >> 2, i & 3] for i in range(16)])[order]
    assert all(bin(p[0] ^ q[0]).count("1") <= 1 for p, q in zip(steps, steps[1:], strict=False))
    # every link of the stage comes from the index: none is left where it links nothing
    df = spark.createDataFrame([(0, i, i & 1, 0) for i in range(50)], "node long, fid long, f0 long, f1 long")
    assert neardup.node_links(df, 3).count() == 49

    def no_links(nodes, words, radius):
        return np.arange(len(nodes))

    monkeypatch.setattr(neardup, "linked_within", no_links)
    assert neardup.node_links(df, 3).count() == 0


# mixing

def test_mixing_of_unequal_sources_matches_sql(spark, duck):
    # some twelve million words, so that the mix has several blocks
    rows = [(i, "a b c " * (10_000 * (1 + i % 5)), "big" if i % 10 else f"s{i % 3}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).toPandas()
    pdf = docs.toPandas()  # noqa: F841
    con = duck.cursor()
    con.execute("create temp view documents as select * from pdf")
    same(got, con.sql(mixing.OP2_SQL).df())
    assert got.groupby("doc_id").size().max() > 1 and got["block"].nunique() > 5  # small sources are repeated


def test_mixing_weights_and_limits(spark):
    docs = spark.createDataFrame([(i, "w " * 50, "a" if i < 950 else "b") for i in range(1000)], "doc_id long, text string, source string")
    out = mixing.mix_sources(docs, block_tokens=5000, max_repeats=2.0, target_entropy=1.0).toPandas()
    tokens = out.groupby("source")["n_tokens"].sum()
    assert abs(tokens["b"] / 5000 - 1.0) <= 1.05  # 2500 tokens, used at most twice
    assert out.groupby("doc_id").size().max() <= 2
    assert out.groupby("block")["n_tokens"].sum().std() < 200


def test_mixing_weights_do_not_depend_on_the_blocks(spark):
    sizes = {"a": 9000, "b": 900, "c": 90, "d": 10}
    docs = spark.createDataFrame([(f"{s}{i}", "w", s) for s, n in sizes.items() for i in range(n)], "doc_id string, text string, source string")
    one, many = (mixing.mix_sources(docs, block_tokens=b).toPandas() for b in (1_000_000, 25))
    assert (one.groupby("source")["n_tokens"].sum() == many.groupby("source")["n_tokens"].sum()).all()
    assert many.groupby("doc_id").size().max() <= mixing.MAX_REPEATS
    assert set(many["block"]) == set(range(400)) and abs(many.groupby("block")["n_tokens"].sum() - 25).max() <= len(sizes)
    assert (many.groupby("source")["block"].nunique() >= many.groupby("source").size().clip(upper=400) * 0.9).all()


# archives

@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    pages = [("1", "http://a/ b", b"x\n\ny"), (None, None, b""), ("3", "http://c/", bytes(range(256)))]
    records = list(archives.read_arc(archives.arc_bytes(pages, version, "t.arc", "19990102030405")))
    assert [r.body.partition(b"\r\n\r\n")[2] for r in records[1:]] == [p for _, _, p in pages]
    assert [r.opens for r in records] == [True, False, False, False]
    warcs = [archives.convert(r) for r in records]
    assert [w.headers["WARC-Type"] for w in warcs] == ["warcinfo", "response", "response", "response"]
    assert warcs[1].headers["WARC-Date"] == "1999-01-02T03:04:05Z"
    back = list(archives.read_warc(b"".join(map(archives.warc_bytes, warcs))))
    assert back == warcs


def test_bad_arcs():
    with pytest.raises(ValueError):
        list(archives.read_arc(b"no length here\nbody"))
    with pytest.raises(ValueError):
        list(archives.read_arc(archives.arc_bytes([], 1, "x").replace(b"1 0 ", b"9 0 ")))
    other = archives.ArcRecord({"URL": "dns:a", "IP-address": "0", "Archive-date": "199901", "Content-type": "text/dns"}, b"a IN A")
    assert archives.convert(other).headers["WARC-Type"] == "resource"
    assert archives.warc_date("199901") == "1999-01-01T00:00:00Z"


def test_archives_keep_every_page_row(spark):
    rows = [(1, "filedesc://x", "one"), (2, "http://a/", "two"), (2, "http://a/", "two"), (3, "http://b/", "two"), (4, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for gzipped in (True, False):
        path = scratch_path(spark, "warc")
        out = archives.archive_pages(df, path, gzipped=gzipped).collect()
        assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in out) == [
            (1, 3, "response", None), (2, 3, "response", None), (2, 3, "revisit", 2), (3, 3, "revisit", 2), (4, 0, "response", None)
        ]
        assert {r.payload_digest for r in out if r.payload_bytes} == {archives.base32_sha1(b"one"), archives.base32_sha1(b"two")}
        files = [bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()]
        ids = [r.headers["WARC-Record-ID"] for f in files for r in archives.read_warc(f) if r.headers["WARC-Type"] != "warcinfo"]
        assert len(ids) == len(set(ids)) == 5
        if gzipped:  # each record is a member of its own
            members = 0
            for rest in files:
                while rest:
                    unpack = zlib.decompressobj(31)
                    assert len(list(archives.read_warc(unpack.decompress(rest)))) == 1
                    members, rest = members + 1, unpack.unused_data
            assert members == 5 + len(files)


def test_a_changed_payload_is_found(spark):
    record = archives.convert(list(archives.read_arc(archives.arc_bytes([("1", "http://a/", b"abc")], 1, "t.arc")))[1])
    path = scratch_path(spark, "bad")
    spark.createDataFrame([(dict(record.headers), record.block.replace(b"abc", b"abd"), None)], "headers map<string,string>, block binary, refers_to_id string").createOrReplaceTempView("bad")
    archives.write_warcs(spark.table("bad"), path, True)
    with pytest.raises(Exception, match="declared"):
        archives.read_warcs(spark, path).collect()


def test_archive_tables_have_small_row_groups(spark, monkeypatch):
    """A row group, which a task holds whole, has one archive, or about as many bytes of records."""
    groups = {}

    def noting(df, name, *options):
        out = written(df, name, *options)
        groups[name] = [m.row_group(i).total_byte_size for p in out.inputFiles() for m in [pq.read_metadata(p.removeprefix("file://"))] for i in range(m.num_row_groups)]
        return out

    monkeypatch.setattr(archives, "written", noting)
    noise = F.expr("array_join(transform(sequence(1, 65536), i -> sha2(concat(id, '-', i), 256)), '')")
    pages = spark.range(0, 24, 1, 1).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), noise.alias("html"))
    out = archives.archive_pages(pages, scratch_path(spark, "groups"))
    assert sorted((r.page_id, r.payload_bytes) for r in out.collect()) == [(i, 4 << 20) for i in range(24)]
    assert sum(groups["arcs"]) > 24 * (4 << 20)
    assert all(x < 3 * archives.FILE_BYTES for sizes in groups.values() for x in sizes)


def test_arrow_batches_are_small_within(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    def largest():
        return spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("x")).mapInArrow(run, "n long").agg(F.max("n")).first()[0]

    before = largest()
    with small_batches(spark, 1 << 20):
        assert largest() < 1.3 * (1 << 20)
    assert largest() == before > 10 << 20


def test_spooled_batches_come_after_the_input():
    said = []

    def batches():
        for n in range(3):
            said.append(n)
            yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])
        said.append("end")

    out = []
    for b in spooled(lambda found: found)(batches()):
        assert said[-1] == "end"
        out += b.column(0).to_pylist()
    assert out == [0, 1, 2] and list(spooled(lambda found: found)(iter([]))) == []


def test_gzipped_archives_are_read_by_members():
    record = archives.WarcRecord({"WARC-Type": "resource"}, bytes(1 << 20))
    data = archives.packed(archives.warc_bytes(record)) * 40
    tracemalloc.start()
    read = sum(r == record for r in archives.read_warc(data))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert read == 40 and peak < 10 << 20
    few = [archives.WarcRecord({"WARC-Type": "resource", "n": str(n)}, b"a\r\n\r\nb" * n) for n in range(3)]
    plain = b"".join(map(archives.warc_bytes, few))
    for cut in range(len(plain) + 1):  # members that hold several records, or end within one
        assert list(archives.read_warc(archives.packed(plain[:cut]) + archives.packed(plain[cut:]))) == few
    with pytest.raises(ValueError):
        list(archives.read_warc(archives.packed(plain) + archives.packed(b"no record")))


# embeddings

def test_embedding_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 32))
    rows, labels = [], []
    for i in range(1500):
        c = centres[0 if i % 3 == 0 else rng.integers(30)]  # a third of all rows around one point
        v = c + rng.normal(size=32) * (0.05 if i % 2 else 0.6)
        rows.append((i, [float(x) for x in v], int(i % 2)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.98) & (np.array([r[2] for r in rows])[:, None] == np.array([r[2] for r in rows]))
    want = links.sum(axis=1) - 1
    got = {r.vec_id: r.n_links for r in embeddings.near_vectors(df, block_rows=64).collect()}
    assert all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= 0.97 * want.sum() > 0


# page text

def test_page_text_of_various_pages():
    page = pagetext.Page(
        "<html><body><header>Site</header><div class='cookie-notice'>We use cookies</div><aside>Side</aside><main><article><h1>T&eacute;st</h1>"
        "<p>First <b>bold</b>\n line.<ul><li>one<li>two</ul><form>Sign up</form><script>var a='<p>no</p>';</script><!-- no --><div class=ad-box>Buy</div></article>"
        "<section id='comments'><p>I agree</p></section></main><footer>End</footer></body></html>"
    )
    assert page.text_at(None) == "Tést\nFirst bold line.\none\ntwo"
    assert pagetext.Page("plain &lt;text&gt; 1 < 2").text_at(None) == "plain <text> 1 < 2"
    assert pagetext.Page("<a title='x>y'>" + "<b " * 5000).text_at(None)


@pytest.mark.parametrize("quote", ["'", '"'])
def test_long_attribute_values_are_not_text(quote):
    inner = "<p class=menu>x > y</p> " * 1000
    page = f"<body><div data-state={quote}{inner}{quote} class=ad-box>Buy</div><article data-x = {quote}{inner}{quote}><p>Text</article></body>"
    got = pagetext.Page(page)
    assert got.text_at(None) == "Text" and [n[5] for n in got.nodes] == ["", "body", "article"]
    for part in ('<x "="', "<x '=", "<x =\"' ", '<x ="', "=\"' ", 'a="" ', "a ", "a=' <x "):
        began = time.perf_counter()
        pagetext.Page("<a " + part * 20_000)
        assert time.perf_counter() - began < 5, part


def test_doubtful_words_are_judged_by_the_host(spark):
    story = "<p>" + "word " * 40 + "</p>"
    one = f'<article><h1>T</h1><div id="how-to-share-files">{story}</div><p class="notice-board">On the board</p><math>x</math><object>seen</object><p>End</p></article>'
    pages = [(1, "http://a.com/1", one)]
    # the same words on every page of a host, and words that are mostly links
    for i in range(3):
        pages.append((10 + i, f"http://b.com/{i}", f'<article><h1>T{i}</h1>{story}<div class="notice-board">Always this</div><div class="share-files"><a href=x>All {i} of it</a></div></article>'))
    out = {r.page_id: r.text for r in pagetext.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert out[1] == "\n".join(["T", ("word " * 40).strip(), "On the board", "xseen", "End"])
    assert [out[10 + i] for i in range(3)] == [f"T{i}\n{('word ' * 40).strip()}" for i in range(3)]


def test_expressions_without_sure_tokens_are_tried_on_every_url(spark):
    assert urls.sure_tokens(r"\Bfoo\B") == () and urls.sure_tokens(r"\bfoo\b") == ("foo",)
    assert urls.sure_tokens(r"\p{L}+foo") == urls.sure_tokens(r"(?<host>a.b)/foo/") == ()
    rules = [urls.expression_rule(r"\Bfoo\B"), urls.expression_rule(r"/\p{Lu}{3}/"), urls.expression_rule(r"(?<word>bar)baz")]
    rows = [(1, "http://a.b/xfoox"), (2, "http://a.b/foo"), (3, "http://a.b/ABC/"), (4, "http://a.b/barbaz"), (5, "http://a.b/abc/")]
    got = {r.page_id: r.verdict for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "allow"}


def test_copies_weigh_once_in_the_language_sample(spark):
    docs = spark.createDataFrame([("xx", "one and the same")] * 500 + [("xx", f"text {i}") for i in range(40)] + [("yy", "other")], "lang string, text string")
    got = [tuple(r) for r in language.sampled(docs, 1000).collect()]
    assert len(got) == len(set(got)) == 42
    assert language.sampled(docs, 5).filter("lang = 'xx'").count() < 20


def test_rows_without_ids_are_spread_over_the_mix(spark):
    docs = spark.createDataFrame([(None, f"some words of text {i}", "a") for i in range(200)], "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, block_tokens=100).toPandas()
    assert len(got) == 200 and got.groupby("block").size().max() <= 21


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ('<p class="cookie-notice">We use cookies.<br>Accept all of them.</p><p>Kept<br>too</p>', "Kept\ntoo"),
        ('<p class="advert">Buy<br>now cheap</p><p>Kept</p>', "Kept"),
        ("<p>One <a href='x'>two<br>three</a> four</p>", "One two\nthree four"),
        ("<p>The <label>word</label> stays</p><p>Kept</p>", "The word stays\nKept"),
        ('<p>Kept for long</p><form><label for="q">Find</label><p>Search here</p></form>', "Kept for long"),
        ("<p>Kept</p><!a <!b <p>and this", "Kept\nand this"),
        ("<p>Kept</p><!doctype x><p>and this", "Kept\nand this"),
        ("""<p title=it's>Kept</p><p>isn't lost</p>""", "Kept\nisn't lost"),
        ("<p>Kept</p><script>if (a</scripty>) b</script ><p>too</p>", "Kept\ntoo"),
    ],
)
def test_page_text_of_broken_and_odd_markup(body, text):
    assert pagetext.Page(f"<html><body><article>{body}</article></body></html>").text_at(None) == text


def test_a_form_around_the_page_is_read():
    menu = "<nav>Menu</nav><input value='x'><button>Go</button>"
    page = f'<body><form id="aspnetForm" class="form">{menu}<div id="content"><p>First part of it.</p><p>Second part.</p></div><label>Remember me</label></form></body>'
    assert pagetext.Page(page).text_at(None) == "First part of it.\nSecond part."
    assert pagetext.Page("<body><form><label for='a'>Name</label><div>Log in to go on</div></form></body>").text_at(None) == ""


@pytest.mark.parametrize("part", ["</script ", "<!a ", "<![CDATA[", "<!--", "<a b=\"", "<a b='", "<a \" ", "<p ' ", "<script>", "= \""])
def test_odd_markup_is_read_in_linear_time(part):
    began = time.perf_counter()
    for head in ("", "<script>", "<p>x"):
        pagetext.Page(head + part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 15


def plain_article(source):
    """Blocks of the article of a page that closes all of its tags: a stack, and a list of what goes."""
    out, stack, parts = [], [], []

    def flush():
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append(text)

    for token in re.findall(r"<[^>]*>|[^<]+", source):
        name = re.match(r"</?(\w+)", token)
        if not name:
            if "article" in [t for t, _ in stack] and not any(gone for _, gone in stack):
                parts.append(html.unescape(token))
        elif name[1] == "br":
            flush()
        elif token.startswith("</"):
            if name[1] in ("p", "div", "article", "h1", "ul", "li", "nav", "form", "aside"):
                flush()
            stack.pop()
        else:
            if name[1] in ("p", "div", "article", "h1", "ul", "li", "nav", "form", "aside"):
                flush()
            stack.append((name[1], name[1] in ("nav", "form", "aside", "script") or bool(re.search(r'class="(advert|cookie-notice|share|comments)"', token))))
    return "\n".join(out)


def test_page_text_with_boilerplate_inside_the_article(spark):
    rng = np.random.default_rng(8)
    word = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 999, n))
    odd = ['<p class="advert">Buy<br>now</p>', "<aside><p>more</p></aside>", '<div class="share"><a href="/s">share it</a></div>', "<form><p>sign up</p></form>", '<ul class="comments"><li>first!</li></ul>', "<script>var x</script>", '<p class="cookie-notice">We use<br>cookies</p>']
    rows = []
    for i in range(60):
        parts = [f"<p>{word(12)} <a href='/x'>{word(1)}</a> &amp; {word(8)}<br>{word(9)}</p>" for _ in range(4)]
        for x in rng.choice(odd, 3, replace=False):
            parts.insert(int(rng.integers(0, len(parts))), str(x))
        rows.append((i, f"http://h{i % 3}.org/{i}", f"<html><body><nav><a>Home</a></nav><article><h1>{word(4)}</h1>{''.join(parts)}</article></body></html>"))
    got = {r.page_id: r.text for r in pagetext.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: plain_article(source) for i, _, source in rows}


def test_deep_pages_are_linear():
    for source in ("<div>" * 30_000 + "x", "<div class=note-ad>" * 8000 + "x", "<b>" * 20_000 + "<p>y" * 2000, "</i>" * 20_000, "<p>x" * 30_000):
        began = time.perf_counter()
        pagetext.Page(source)
        assert time.perf_counter() - began < 5, source[:20]


# secrets

@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('a token = "abcdefghijkl" b', "assign:2:23"),
        ("Password:shortone", ""),
        ("password=token: abcdefghijklmnop", ""),
        ("AKIAABCDEFGHIJKLMN x 0123456789abcdef0", "access:0:18,hex:21:38"),
        ("a" * 16, "hex:0:16"),
        ("toKen=abcdefghijklm", ""),
        ('base = "Zx9kQ2mVw8Lp"\ndb_pwd = base', "named:8:20"),
        ('{"client_secret": "hUn7er-2x9!Q"}', "named:19:31"),
        ("the secret of : the garden = is old", ""),
        ("secretary: nobody12345x knows", ""),
        ('password = "changeme-please"', "assign:0:27"),
    ],
)
def test_spans(text, want):
    base, spans = secrets.all_spans(text)
    assert secrets._joined(spans) == want
    assert set(base) <= set(spans)


def test_constants_built_on_each_other_are_linear():
    chain = 'x0 = "Zx9kQ2mVw8Lp"\n' + "".join(f"x{i} = x{i - 1} + x{i - 1}\n" for i in range(1, 3000)) + "db_pwd = x2999"
    began = time.perf_counter()
    assert secrets._joined(secrets.all_spans(chain)[1]) == "named:6:18"
    grown = "".join(f'x{i} = x{i - 1} + "Zx9kQ2mVw8L{i}"\n' for i in range(1, 3000)) + "db_pwd = x2999\n" + 'token = "Zx9kQ2mVw8L"\n' * 3000
    assert len(secrets.all_spans(grown)[1]) == 5999
    assert time.perf_counter() - began < 5


def _plain_spans(text):
    """The contract's patterns, position by position."""
    kinds = [
        (0, re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), lambda m: len(m[2]) >= 12),
        (1, re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
        (2, re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
    ]
    out = []
    for kind, pattern, holds in kinds:
        at = 0
        while at < len(text):
            m = pattern.match(text, at)
            if m and holds(m):
                out.append((m.start(), kind, m.end()))
            at = m.end() if m else at + 1
    return sorted(out)


def test_base_spans_of_all_documents_equal_a_plain_scan(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in secrets.op9_secrets(spark, sf_dir).collect()}
    found = 0
    for i, text in texts.items():
        want = _plain_spans(text)
        found += len(want)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == kind for _, k, _ in want) for kind in range(3)]
        assert got[i].base_sha256 == hashlib.sha256(secrets._joined(want).encode()).hexdigest()
        assert set(filter(None, secrets._joined(want).split(","))) <= set(got[i].spans.split(","))
    assert found > 5


def test_redaction():
    assert secrets.redacted('x token = "abcdefghijkl" y') == 'x [SECRET]" y'
    assert secrets.base_spans(secrets.redacted("api_key=0123456789abcdef0123")) == []


def test_long_words_are_linear():
    secrets.all_spans("password " + "a" * 300_000 + "=" + "x" * 300_000)


# language

def test_language_accuracy_on_held_out_rows(spark, sf_dir):
    docs = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    out = language.op10_language(spark, sf_dir.replace("sf0.001", "sf0.01")).join(docs.select("doc_id", "lang"), "doc_id")
    right = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
    assert out.where("score < 0 or score > 1").isEmpty()


def test_language_equals_plain_sets(spark):
    """Without Bloom filters: sets of n-grams of each language, counted in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    texts = [(r.doc_id, r.text[:3000], r.lang) for r in docs if r.text and r.lang]

    def grams(text):
        padded = "".join(c if c.isalpha() else " " for c in f" {text.lower()} ")
        return [padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1) if " " not in padded[i + 1 : i + n - 1]]

    held, sizes = {}, {}
    for _, text, lang in texts:
        sizes[lang] = sizes.get(lang, 0) + 1
        for g in set(grams(text)):
            held.setdefault(g, {})[lang] = held.get(g, {}).get(lang, 0) + 1
    sets = {lang: set() for lang in sizes}
    for g, by in held.items():
        most = max(by[x] / sizes[x] for x in by if by[x] > 1) if any(n > 1 for n in by.values()) else 1
        for lang, n in by.items():
            if n > 1 and n / sizes[lang] >= max(0.002, 0.1 * most):
                sets[lang].add(g)
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    model = language.fit(df, per_language=10**9, bits=23)
    assert model.languages == sorted(sizes)
    alike = 0
    for r in language.identify(df, model).collect():
        text = next(t for i, t, _ in texts if i == r.doc_id)
        counts = {x: sum(g in sets[x] for g in grams(text)) for x in sizes}
        if not sum(counts.values()):
            continue
        best = max(counts.values())
        alike += counts[r.lang_pred] == best and abs(r.score - best / sum(counts.values())) < 0.02
    assert alike >= 0.99 * len(texts)  # the filters' false positives are corrected on average only


def test_pieces_of_a_long_text_count_like_the_whole(monkeypatch):
    model = language.Model(["x"], np.full((1, 1 << 8), 1, dtype=np.uint8), np.zeros(1), 0)
    text = "abc defg hi " * 40
    whole = language.language_counts(text, model, 8)
    monkeypatch.setattr(language, "CHUNK", 17)
    assert language.language_counts(text, model, 8)[1] == whole[1] == whole[0][0]
    pieces = language.held_grams(text)
    monkeypatch.setattr(language, "CHUNK", 1 << 20)
    assert (pieces == language.held_grams(text)).all()


# quality

def test_quality_keeps_good_and_rejects_bad(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary, 80)) + (" idiot scum" if i % 5 == 0 else ""), int(i % 5 == 0)) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows if i % 2], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.selected for r in quality.select_documents(docs, labels).collect()}
    good = [i for i, _, t in rows if not t]
    bad = [i for i, _, t in rows if t]
    assert sum(got[i] for i in good) >= 0.97 * len(good)
    assert sum(got[i] for i in bad) <= 0.05 * len(bad)


def test_importance_weights_and_top_k_equal_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    told = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    raw, target = {}, {}
    for i, text in docs:
        for f in quality.features(text).tolist():
            raw[f] = raw.get(f, 0) + 1
            target[f] = target.get(f, 0) + told.get(i, False)
    least = np.percentile(list(raw.values()), 75)
    common = sorted((target[f] / raw[f], raw[f]) for f in raw if raw[f] >= least)
    half, reached, share = sum(n for _, n in common) / 2, 0, 0.0
    for share, n in common:
        if (reached := reached + n) >= half:
            break
    weight = {}
    for f in raw:
        expected = raw[f] * share
        log = np.log((target[f] + 0.5) / (expected + 0.5))
        weight[f] = log if abs(target[f] - expected) >= 4 * np.sqrt(expected * (1 - share) + 1) and abs(log) > 2.3 else 0.0
    want = {i: sum(weight[f] for f in quality.features(text).tolist()) for i, text in docs}
    for keep in (None, 0.3, 1.0):
        got = quality.select_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=keep).collect()
        assert max(abs(r.log_weight - want[r.doc_id]) for r in got) < 1e-5
        cut = quality.best_cut(np.array([want[i] for i in told]).round(6), np.array(list(told.values())))
        k = sum(round(w, 6) >= cut for w in want.values()) if keep is None else round(keep * len(docs))
        best = sorted((r.gumbel_key for r in got), reverse=True)[:k]
        assert {r.doc_id for r in got if r.selected} == {r.doc_id for r in got if r.gumbel_key >= best[-1]}
    noise = np.array([(r.gumbel_key - r.log_weight) / 0.25 for r in got])
    assert abs(noise.mean() - 0.577) < 0.4 and abs(noise.std() - 1.28) < 0.4  # standard Gumbel


def test_top_k_threshold_is_exact(spark):
    rng = np.random.default_rng(9)
    values = np.round(np.concatenate([rng.normal(size=500), np.full(200, 0.25), [1e9, -1e9]]), 3)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    for k in (1, 2, 150, 300, 702):
        assert quality.top_k_threshold(df, "v", k, fan=16) == sorted(values, reverse=True)[k - 1]
    assert quality.top_k_threshold(df, "v", 0) is None


# pipeline

def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
    mixed = corpus_pipeline.run(spark, sf_dir).toPandas()
    assert len(mixed) and set(mixed["doc_id"]) <= {r[0] for r in docs.select("doc_id").collect()}
    hits = {r.doc_id for r in decontaminate.op7_winnowing(spark, sf_dir).where("contaminated").collect()}
    assert not hits & set(mixed["doc_id"])


# contamination

def test_pieces_of_a_text_count_like_the_whole(monkeypatch, spark, duck, sf_dir):
    monkeypatch.setattr(decontaminate, "PIECE", 7)
    same(QUERIES["op7_winnowing"](spark, sf_dir).toPandas(), duck.sql(ORACLES["op7_winnowing"]).df())


def test_contamination_is_linear_in_the_text(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    items = spark.createDataFrame([(1, passage), (2, "q q q")], "item_id long, text string")
    text = f"{passage} " + "a b c d e " * 60_000 + "q " * 5000 + passage
    took = []
    for copies in (1, 4):
        df = spark.createDataFrame([(1, " ".join([text] * copies))], "doc_id long, text string")
        began = time.perf_counter()
        row = decontaminate.contamination(df, items).first()
        took.append(time.perf_counter() - began)
        assert (row.n_words, row.n_hit, row.n_items) == (305_024 * copies, 5024 * copies, 2)
    assert took[1] < 4.5 * took[0] + 2


# URL rules

def test_rules_are_read_and_their_tokens_derived():
    rules = urls.read_rules("! note\n\n||Example.com/a/b\n@@||net\n/^[^/]*ads[0-9]+\\.x-(y|z)-track/\nfree*gift-card\n@@fine")
    assert [(r.verdict, r.name, r.tokens) for r in rules] == [
        ("block", "example.com/a/b", ("example", "com", "a")), ("allow", "net", ("net",)), ("block", None, ("x",)), ("block", None, ("gift", "card")[1:]), ("allow", None, ("fine",))
    ]
    for regex, tokens in ((r"a|b", ()), (r"/foo/", ("foo",)), (r"/foo", ()), (r"^foo[./-]bar+", ("foo",)), (r"(?:/x/)?y", ()), (r"-(ab)-", ("ab",)), (r"\bQ7\b", ("q7",))):
        assert urls.sure_tokens(regex) == tokens, regex


def test_thousands_of_rules_equal_brute_force(spark, sf_dir):
    rng = np.random.default_rng(11)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()
    seen = sorted({t for p in pages for t in urls.tokens_in(p.url.partition("://")[2])})
    lines = ["||com/en/", "@@||example.com/en/7", "/[0-9]{3}$/", "/-farm[.]/"]
    for i in range(3000):
        word = str(rng.choice(seen)) if i % 4 == 0 else f"absent{i}"
        lines.append(("@@" if i % 7 == 0 else "") + (f"||{word}.example.org/{rng.choice(['', 'en/', 'de/1'])}", word, f"/[/.]{word}[/.]/", f"{word[:2]}*{word[-1:]}")[i % 3 if i % 40 else 3])
    rules = urls.read_rules("\n".join(lines))
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(pages), rules, default="none").collect()}
    expressions = [(re.compile(r.regex), r) for r in rules]
    for page in pages:
        host, slash, path = re.match(r"([^/?#]*)(/?)([^?#]*)", page.url.partition("://")[2]).groups()
        fits = [(r.rank, r.name or "", r.verdict) for e, r in expressions if e.search(host.lower() + slash + path)]
        _, name, verdict = max(fits, default=(0, "", "none"))
        assert got[page.page_id] == (name or None, verdict), page.url
