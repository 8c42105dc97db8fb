"""Quality by importance resampling: hashed n-gram models of target and raw text.

The target is the text of labelled good documents, the raw model counts every
document; both count the documents that hold a feature, as a feature's repeats
within one text are no further evidence.  A feature's weight is the log ratio of the two models, kept where the
target count departs significantly from what the raw count leads to expect (so
rare features weigh nothing).  A document's log weight is the sum over its
features; documents are drawn without replacement by Gumbel top-k on the log
weights.  k is a share of the documents that is asked for, or else the number of documents on the good
side of the cut that tells good from bad labelled documents best.

Plain ratios of all n-gram counts, drawn at temperature 1, are not used: see the README for what they keep and reject.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import checkpointed, free_name, read_table, written

TOKEN = re.compile(r"\w+|[^\w\s]+")
BUCKETS = 1 << 19
#: Labelled rows that the target and the cut are fitted on, at most.
LABEL_ROWS = 20_000


def features(text: str | None) -> np.ndarray:
    """Buckets of the n-grams that ``text`` holds: words, pairs of words, and the first
    4 and 5 letters of longer words.  A word after itself is one feature, and so is each tenth
    that such repeats make up of all pairs.
    """
    tokens = TOKEN.findall((text or "").lower())
    if not tokens:
        return np.zeros(0, dtype=np.int32)
    crc = zlib.crc32
    ids = {t: crc(t.encode("utf-8", "surrogatepass")) for t in set(tokens)}
    one = np.fromiter(map(ids.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    same = one[:-1] == one[1:]
    two[same] = np.uint64(1)
    parts = {t[:n] for t in ids for n in (4, 5) if len(t) > n}
    heads = np.fromiter([crc(b"^" + p.encode("utf-8", "surrogatepass")) for p in parts], dtype=np.uint64, count=len(parts))
    tenths = np.arange(2, 2 + int(10 * same.mean()) if len(same) else 2, dtype=np.uint64)
    every = np.concatenate((one * np.uint64(0xD6E8FEB86659FD93), two, heads * np.uint64(0xA0761D6478BD642F), tenths))
    found = np.sort(((every ^ every >> np.uint64(32)) & np.uint64(BUCKETS - 1)).astype(np.int32))
    return found[np.append(True, found[1:] != found[:-1])]


def label_table(labels: DataFrame, rows: int = LABEL_ROWS) -> DataFrame:
    """``(label_id, good)`` of at most ``rows`` labelled ids, the first by a hash of the id: a bounded table."""
    some = (
        labels.filter("doc_id is not null and quality is not null and toxic is not null")
        .groupBy(F.col("doc_id").alias("label_id"))
        .agg(F.min((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(rows)
    )
    return checkpointed(some)


def count_features(texts: DataFrame) -> DataFrame:
    """``(bucket, raw, target)``: rows that hold a feature, over all rows ``(text, good)``; those with ``good`` are the target."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                found = features(text.as_py())
                raw[found] += 1
                if good:
                    target[found] += 1
        at = np.flatnonzero(raw)
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(raw[part]), pa.array(target[part])], names=["bucket", "raw", "target"])

    counts = texts.select("text", "good").mapInArrow(count, "bucket int, raw long, target long")
    return counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratio_table(counts: pa.Table, significance: float = 4.0, prior: float = 0.5, least: float = 2.3) -> np.ndarray:
    """Log ratio of the target's model to the raw one for each bucket, 0 where it is below ``least`` or not significant.

    The share of raw text that the target stands for is the median over
    features, weighted by raw counts, so that ordinary words weigh nothing.
    """
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = counts["bucket"].to_numpy()
    raw[at], target[at] = counts["raw"].to_numpy(), counts["target"].to_numpy()
    if not target.sum():
        return np.zeros(BUCKETS)
    ratio = np.divide(target, raw, out=np.zeros(BUCKETS), where=raw > 0)
    order = np.argsort(ratio, kind="stable")
    heavy = np.where(raw[order] >= np.percentile(raw[raw > 0], 75), raw[order], 0)
    share = ratio[order][np.searchsorted(np.cumsum(heavy), heavy.sum() / 2)]
    expected = raw * share
    table = np.log((target + prior) / (expected + prior))
    far = np.abs(target - expected) >= significance * np.sqrt(expected * max(1e-9, 1 - share) + 1)
    return np.where(far & (np.abs(table) > least), table, 0.0)


def log_weight(text: str | None, table: np.ndarray) -> float:
    return float(np.round(table[features(text)].sum(), 6))


def weighed(rows: DataFrame, text_col: str, labels: DataFrame, id_col: str, names: tuple[str, str], with_text: bool = True) -> tuple[DataFrame, float]:
    """``rows``, written with each row's label (null: none) and log weight as further columns ``names``, and the cut.

    Without ``with_text`` the text itself is not written.

    Texts are hashed twice, once for the counts and once for the weights.  The
    weights' table reaches the executors as a broadcast of fixed size, which is
    given up once the rows are written.
    """
    good, weight = names
    few = label_table(labels)
    told = rows.join(F.broadcast(few), rows[id_col] == few["label_id"], "left").select(*[rows[c] for c in rows.columns], few["good"].alias(good))
    counts = count_features(told.select(F.col(text_col).cast("string").alias("text"), F.col(good).alias("good")))
    table = ratio_table(counts.toArrow())  # at most BUCKETS rows of three numbers
    table_b = rows.sparkSession.sparkContext.broadcast(table)
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [log_weight(t.as_py(), table_b.value) for t in batch.column(at)]
            kept = [i for i in range(batch.num_columns) if with_text or i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(found, pa.float64())], names=[*(batch.schema.names[i] for i in kept), weight])

    schema = told.schema
    fields = [f for i, f in enumerate(schema) if with_text or i != at]
    held = written(told.mapInArrow(run, type(schema)(fields).add(weight, "double")), "weighed")
    table_b.destroy()
    # a row for each labelled id, however often it comes
    known = held.filter(F.col(good).isNotNull()).groupBy(id_col).agg(F.min(good).alias("good"), F.min(weight).alias("weight")).select("good", "weight").toArrow()
    return held, best_cut(known["weight"].to_numpy(), known["good"].to_numpy())


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The weight that tells good rows (at or above it) from the others with the largest sum of both rates.

    Among equal sums the lowest cut is taken, so that good documents stay.
    Without rows of both kinds the cut is minus infinity.
    """
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(-weights, kind="stable")
    w, g = weights[order], good[order]
    score = np.cumsum(g) / g.sum() - np.cumsum(~g) / (~g).sum()
    ends = np.append(w[1:] != w[:-1], True)
    score[~ends] = -np.inf
    best = np.flatnonzero(score >= score.max() - 1e-12)[-1]
    return float((w[best] + w[best + 1]) / 2) if best + 1 < len(w) else float(w[best])


def gumbel(seed: int, *cols: Column) -> Column:
    """A standard Gumbel variate that is a function of ``cols``."""
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11).cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(unit))


def top_k_threshold(keys: DataFrame, name: str, k: int, fan: int = 4096) -> float | None:
    """The ``k``-th largest value of ``name``, exactly: histograms narrow the range until one value is left.

    Each round is one aggregation with at most ``fan`` groups; None if k is 0 or
    there are fewer values than ``k``.
    """
    low, high, n = keys.agg(F.min(name), F.max(name), F.count(name)).first()
    if k <= 0 or n < k:
        return None
    while low < high:
        width = (high - low) / fan
        bins = (
            keys.filter(F.col(name).between(low, high))
            .groupBy(F.least(F.floor((F.col(name) - low) / (width or 1.0)), F.lit(fan - 1)).alias("bin"))
            .agg(F.count("*").alias("n"), F.min(name).alias("low"), F.max(name).alias("high"))
            .orderBy(F.desc("bin"))
            .collect()
        )
        for b in bins:
            if b["n"] >= k:
                if (b["low"], b["high"]) == (low, high):  # a range too narrow to cut: take its values one by one
                    rows = keys.filter(F.col(name).between(low, high)).groupBy(name).count().orderBy(F.desc(name)).collect()
                    for r in rows:
                        if r["count"] >= k:
                            return r[name]
                        k -= r["count"]
                low, high = b["low"], b["high"]
                break
            k -= b["n"]
    return low


def _selection(held: DataFrame, names: tuple[str, str], key: Column, cut: float, keep: float | None) -> float | None:
    """The least Gumbel key that is drawn; None if no row is."""
    weight = F.col(names[1])
    total, above = held.agg(F.count("*"), F.count(F.when(weight >= cut, 1))).first()
    k = above if keep is None else round(keep * total)
    return top_k_threshold(held.select(key.alias("gumbel_key")), "gumbel_key", k)


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def _key(id_col: str, text_hash: Column, weight: str, temperature: float, seed: int) -> Column:
    return F.round(F.col(weight) + gumbel(seed, F.col(id_col), text_hash) * temperature, 9)


def select_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", temperature: float = 0.25, seed: int = 7, keep: float | None = None
) -> DataFrame:
    """One row per document row: ``doc_id, log_weight, gumbel_key, selected``.

    selected: the key is among the k largest, k being ``keep`` times the number of rows or, without it,
    the number of rows whose log weight reaches the cut; rows equal to the k-th are all selected.
    ``temperature`` scales the Gumbel noise.  Null and empty texts have weight 0.
    Without labels of both kinds all documents are selected.  Labels with nulls
    are left out; a document labelled twice is good if all of its labels are.
    Repeated rows stay repeated; columns of any other name are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), _text_hash(text_col).alias("text_hash"))
    held, cut = weighed(rows, "text", labels, "doc_id", ("good", "log_weight"), with_text=False)
    key = _key("doc_id", F.col("text_hash"), "log_weight", temperature, seed)
    keys = checkpointed(held.select("doc_id", "log_weight", key.alias("gumbel_key")))
    least = _selection(keys, ("", "log_weight"), F.col("gumbel_key"), cut, keep)
    chosen = F.lit(False) if least is None else F.col("gumbel_key") >= least
    return keys.select("*", chosen.alias("selected"))


def keep_selected(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", temperature: float = 0.25, seed: int = 7, keep: float | None = None
) -> DataFrame:
    """The rows of ``docs`` that ``select_documents`` selects, all columns as they are.

    The rows are written once with their weights, so the texts meet the decision
    without being hashed again or joined to it.
    """
    names = free_name(docs, "good"), free_name(docs, "log_weight")
    held, cut = weighed(docs, text_col, labels, id_col, names)
    key = _key(id_col, _text_hash(text_col), names[1], temperature, seed)
    least = _selection(held, names, key, cut, keep)
    return held.filter(F.lit(False) if least is None else key >= least).select(*docs.columns)


def op8_importance(spark, sf_dir: str) -> DataFrame:
    """Importance resampling of all documents towards the labelled good ones."""
    return select_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
