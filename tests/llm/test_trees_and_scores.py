"""Merkle manifest, prefix trie and log-bilinear scores against plain versions, with nulls, ties and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratacast.llm import lm, merkle, trie
from stratacast.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def lower(text):
    return text.translate({i: i + 32 for i in range(65, 91)})


# Merkle manifest

def plain_tree(leaves):
    """The root, and for each leaf its (before, after) siblings level by level."""
    paths, held, now = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(now) > 1:
        ups, groups = [], []
        for a in range(0, len(now), 8):
            run = now[a : a + 8]
            for j in range(len(run)):
                for leaf in held[a + j]:
                    paths[leaf].append((run[:j], run[j + 1 :]))
            ups.append(sha(*run))
            groups.append([x for h in held[a : a + 8] for x in h])
        now, held = ups, groups
    return now[0], paths


def plain_manifest(rows):
    def leaf(r, text):
        fields = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
        return sha(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in fields])

    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        ordered = sorted(by_lang[lang], key=lambda x: x[:3])
        trees[lang] = (ordered, *plain_tree([x[2] for x in ordered]))
    root, tops = plain_tree([trees[x][1] for x in langs])
    out = []
    for lang, top in zip(langs, tops, strict=True):
        ordered, subroot, paths = trees[lang]
        for (_, _, digest, r), path in zip(ordered, paths, strict=True):
            path = path + top
            folded = digest
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                folded = leaf(r, None if r["text"] is None else lower(r["text"]))
            for before, after in path:
                folded = sha(*before, folded, *after)
            out.append((r["doc_id"], digest, subroot, root, sha(*[s for b, a in path for s in b + a]), folded, folded == root))
    return Counter(out)


def manifest_of(df):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r) for r in merkle.manifest(df).select(*names).collect())


@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_equals_plain_trees(monkeypatch, spark, sf_dir, levels):
    monkeypatch.setattr(merkle.rounds, "__defaults__", (levels,))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert manifest_of(docs) == plain_manifest([r.asDict() for r in docs.collect()])


def test_manifest_of_odd_rows(spark):
    rows = [(3, "Ünï CODE", "en", "a", 8), (3, "Ünï CODE", "en", "a", 8), (None, None, None, None, None), (None, "", "en", "", 0), (5, "x" * 200_000 + "Y", "fr", "b", 200_001), (9, "ABC", None, "c", 3)]
    rows += [(i, f"Text {i}", "de", "d", i) for i in range(65)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("tree", "digest", "number", "_range", "held", "path", "root")})
    assert manifest_of(docs) == plain_manifest([r.asDict() for r in docs.collect()])
    assert merkle.manifest(docs.limit(0)).count() == 0
    one = merkle.manifest(docs.filter("text = 'ABC'")).first()
    assert one["leaf"] == one["root"] == one["subroot"] and one["proof_sha256"] == sha()


# prefix trie

def plain_trie(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = {n for n in below if len(n) == len(node) + 1}
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) > len(n) for m in below)]
        saved = sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in below if n)
        ends = ",".join(str(c) for c in convs if len(built[c]) == len(node))
        out.append((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(kids), len(leaves), saved, sha(ends)))
    return Counter(out)


def trie_of(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(tuple(r) for r in trie.prefix_trie(df).select(*names).collect())


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("conv", "at", "digest", "node", "depth", "k", "name", "words")})


@pytest.mark.parametrize("piece", [2, 4096])
def test_trie_equals_plain_sequences(monkeypatch, spark, piece):
    monkeypatch.setattr(trie, "PIECE", piece)
    rng = np.random.default_rng(7)
    rows = [(int(c), int(t), "user" if t % 2 else "bot", f"say {rng.integers(0, 2)} now") for c in range(-25, 90) for t in range(int(rng.integers(1, 6)))]
    rows += [(200, t, "user", f"long {t % 3}") for t in range(37)] + [(220, t, "user", f"long {t % 3}") for t in range(45)]
    rows += [(301, None, None, None), (301, None, "b", "tie"), (301, None, "a", "tie"), (302, 1, "user", ""), (302, 1, "user", ""), (303, 0, "user", "w x \t y"), (None, 0, "user", "no one")]
    assert trie_of(conversations(spark, rows)) == plain_trie(rows)


def test_trie_of_copies_and_of_nothing(spark):
    rows = [(20 * i, t, "user", f"same {t}") for i in range(300) for t in range(3)]
    assert trie_of(conversations(spark, rows)) == plain_trie(rows)
    assert trie_of(conversations(spark, rows[:1])) == plain_trie(rows[:1])
    assert trie.prefix_trie(conversations(spark, rows).limit(0)).count() == 0


# log-bilinear scores

def plain_base(rows, held_out):
    counts = Counter()
    toks = [(i, [*WORD.findall(lower(t or "")), ""]) for i, t in rows]
    for i, w in toks:
        if not held_out(i):
            counts.update(w)
    total, kinds = sum(counts.values()), len(counts)
    return [(i, held_out(i), len(w), sum(x in counts for x in w), total, sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)) for i, w in toks]


def crc_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def same_base(got, want):
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    got, want = order(got), order(want)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want, strict=True))


COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]


def test_scores_of_all_documents(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_log_bilinear"](spark, sf_dir).collect()
    same_base([tuple(r[c] for c in COLUMNS) for r in got], plain_base(rows, crc_held))
    known = [r for r in got if not r.held_out]
    # 50,000 tokens teach little beyond frequencies
    assert sum(r.score for r in known) > 1.01 * sum(r.base_score for r in known)


@pytest.mark.parametrize("frequent", [lm.VOCABULARY, lm.FREQUENT])
def test_context_helps_on_held_out_texts(monkeypatch, spark, frequent):
    """Two kinds of texts over words of their own: after one word the model knows which."""
    rng = np.random.default_rng(1)
    words = [[f"{k}{i}" for i in range(40)] for k in "ab"]
    rows = [(i, " ".join(rng.choice(words[i % 2], 60))) for i in range(6000)]
    rows += [(None, None), (None, ""), (7001, "A0 a0 Ä unseen"), (7001, "A0 a0 Ä unseen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("row", "token", "n", "part", "rare", "known", "base")})
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    got = lm.score_texts(docs, held, frequent=frequent).collect()
    same_base([tuple(r[c] for c in COLUMNS) for r in got], plain_base(rows, crc_held))
    out = [r for r in got if r.held_out and r.n_tokens == 61]
    assert sum(r.score for r in out) > 0.95 * sum(r.base_score for r in out), (sum(r.score for r in out), sum(r.base_score for r in out))
    assert lm.score_texts(docs.limit(0), held).count() == 0
    nothing = lm.score_texts(docs, F.lit(True)).collect()
    assert all(r.n_known == r.train_tokens == 0 and abs(r.base_score) < 1e-9 for r in nothing) and len(nothing) == len(rows)


def test_rare_tokens_meet_their_counts_in_a_join(monkeypatch, spark):
    monkeypatch.setattr(lm, "VOCABULARY", 8)
    monkeypatch.setattr(lm, "CLASSES", 2)
    monkeypatch.setattr(lm, "WIDTH", 4)
    rows = [(i, f"common w{i % 30} w{i % 7} only{i}") for i in range(200)] + [(300, "b1 " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.score_texts(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, frequent=20).collect()
    same_base([tuple(r[c] for c in COLUMNS) for r in got], plain_base(rows, crc_held))


def test_probabilities_add_up_to_one():
    counts = np.zeros(lm.VOCABULARY, dtype=np.int64)
    counts[:700] = np.arange(700, 0, -1)
    trainer = lm.Trainer(lm.start_model(counts, 400_000), seed=1)
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 700, 20_000)
    trainer.learn(ids, lm.contexts(ids, np.arange(0, len(ids), 50)))
    every = np.arange(lm.VOCABULARY + 1)
    for before in ([3, 5], [lm.VOCABULARY, lm.VOCABULARY + 1]):
        found = lm.log_probs(trainer.model, every, np.array(before)[:, None].repeat(len(every), axis=1))
        assert abs(np.exp(found).sum() - 1) < 1e-4


def test_contexts_stop_at_the_start_of_a_text():
    before = lm.contexts(np.array([7, 8, 9, 4, 5]), np.array([0, 3]))
    start = lm.VOCABULARY + 1
    assert before.tolist() == [[start, 7, 8, start, 4], [start, start, 7, start, start]]
