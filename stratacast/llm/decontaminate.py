"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of each window of ``window`` words the least ``gram``-word hash is kept as a
fingerprint, on both sides, so a shared span of ``window`` words always shares a
fingerprint.  Training fingerprints meet the benchmark's in a hash join; each
hit is extended to the window texts around it and compared word for word, so
collisions cannot survive.

Neighbouring windows mostly share their least hash, so a document has one row for each
run of windows with one fingerprint, which carries the words of that run and no
others: the work is linear in the length of a text.  Documents are read once and never
shuffled: these rows go as far as the join, which is in the same stage; what leaves
it is one row per document plus its verified hits.  The benchmark side is
broadcast in blocks whose size is checked; a larger benchmark takes more passes
over the documents, with the same result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import checkpointed, read_table, written

#: Words are runs of lower-case ASCII letters, digits and all characters beyond ASCII; this is what lies between.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of benchmark windows that one broadcast may carry.
BLOCK_BYTES = 32 << 20
#: Windows of a text that are fingerprinted in one row; a longer text takes several.
PIECE = 4096


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; ``lower`` does the same where all characters are ASCII, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), BETWEEN), "")


def _over(values: str, width: int, f) -> Column:
    """``f`` of each run of ``width`` elements of the column ``values``."""
    if width == 1:
        return F.col(values)
    starts = F.slice(values, 1, F.greatest(F.size(values) - (width - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: f(x, *[F.get(values, i + j) for j in range(1, width)]))


def with_prints(df: DataFrame, window: int, gram: int, short: list[int]) -> DataFrame:
    """Add ``mins`` (least gram hash of each window) and, for each window length in ``short``,
    ``grams_<length>`` (hash of the gram at each word)."""
    df = df.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("grams", _over("hashes", gram, F.xxhash64))
    df = df.withColumn("mins", _over("grams", window - gram + 1, F.least))
    return df.withColumns({f"grams_{n}": _over("hashes", n, F.xxhash64) for n in short}).drop("hashes", "grams")


def _runs(words: Column, length: int) -> Column:
    """Text of each run of ``length`` words."""
    return F.when(
        F.size(words) >= length,
        F.transform(F.sequence(F.lit(1), F.size(words) - length + 1), lambda i: F.concat_ws(" ", F.slice(words, i, length))),
    ).otherwise(F.array().cast("array<string>"))


def _keyed(gram: Column, length: int) -> Column:
    """The fingerprint of an item of only ``length`` words, apart from those of whole windows."""
    return F.xxhash64(gram, F.lit(length))


def benchmark_windows(items: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> tuple[DataFrame, list[int]]:
    """``(print, windows)``, windows an array of ``(length, text, items)``; and the lengths below ``window``.

    An item of fewer than ``window`` words, but not none, is one window.
    """
    base = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).filter(
        F.size("words") > 0
    )
    short = sorted(r[0] for r in base.filter(F.size("words") < window).select(F.size("words")).distinct().collect())
    prints = with_prints(base, window, gram, short)
    parts = [
        prints.filter(F.size("words") >= window)
        .select("item", F.explode(F.arrays_zip(_runs(F.col("words"), window).alias("text"), F.col("mins").alias("print"))).alias("w"))
        .select("item", F.lit(window).alias("length"), "w.text", "w.print")
    ]
    for length in short:
        parts.append(
            prints.filter(F.size("words") == length).select(
                "item", F.lit(length).alias("length"), F.concat_ws(" ", "words").alias("text"), _keyed(F.col(f"grams_{length}")[0], length).alias("print")
            )
        )
    texts = reduce(DataFrame.unionByName, parts).groupBy("length", "print", "text").agg(F.collect_set("item").alias("items"))
    return texts.groupBy("print").agg(F.collect_list(F.struct("length", "text", "items")).alias("windows")), short


def _spans(window: int, short: list[int]) -> Column:
    """``(print, length, start, span)`` for each run of a row's windows with one fingerprint; span is the text of those windows."""

    def text(start: Column, words: Column) -> Column:
        return F.concat_ws(" ", F.slice("words", start + 1, words))

    def run(start: Column, nth: Column) -> Column:
        end = F.coalesce(F.get("starts", nth + 1), F.size("mins"))
        return F.struct(
            F.get("mins", start).alias("print"), F.lit(window).alias("length"), start.alias("start"), text(start, end - start + window - 1).alias("span")
        )

    def one(length: int) -> Column:
        return F.transform(
            f"grams_{length}",
            lambda h, i: F.struct(_keyed(h, length).alias("print"), F.lit(length).alias("length"), i.alias("start"), text(i, F.lit(length)).alias("span")),
        )

    return F.concat(F.transform("starts", run), *map(one, short))


def _hits() -> Column:
    """Of a run joined to its fingerprint's windows: ``(start, length, items)`` of each window text found in it."""
    words = F.split("span", " ")

    def at(i: Column) -> Column:
        text = F.concat_ws(" ", F.slice(words, i + 1, F.col("length")))
        return F.transform(
            F.filter("windows", lambda w: (w["length"] == F.col("length")) & (w["text"] == text)),
            lambda w: F.struct((F.col("start") + i).alias("start"), F.col("length").alias("length"), w["items"].alias("items")),
        )

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - F.col("length")), at))


def _covered(ranges: Column) -> Column:
    """Words in the union of ``(start, length)`` ranges."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def grown(state: Column, r: Column) -> Column:
        end = F.greatest(state["end"], r["start"] + r["length"])
        return F.struct((state["n"] + end - F.greatest(state["end"], F.least(r["start"], end))).alias("n"), end.alias("end"))

    return F.aggregate(F.array_sort(ranges), none, grown, lambda state: state["n"])


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    gram: int = 5,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A word is hit if it lies in an occurrence of an item's window.  Null and empty
    texts have no words; an item without words has no window; items with a null
    id make hits but are not counted as items; repeated document rows stay
    repeated; empty tables on either side give rows without hits, or none.
    """
    return _judged(docs, items, id_col, text_col, item_id_col, item_text_col, window, gram, block_bytes).drop("text_key")


def _judged(
    docs: DataFrame,
    items: DataFrame,
    id_col: str,
    text_col: str,
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    gram: int = 5,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``contamination`` with the key of each row's text."""
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    bench, short = benchmark_windows(items, item_id_col, item_text_col, window, gram)
    sized = bench.withColumn("bytes", F.expr("aggregate(windows, 64L, (s, w) -> s + 64 + octet_length(w.text) + aggregate(w.items, 0L, (t, i) -> t + 16 + octet_length(i)))"))
    bench = checkpointed(sized)
    blocks = max(1, math.ceil((bench.agg(F.sum("bytes")).first()[0] or 0) / block_bytes))

    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), words_of(F.col(text_col)).alias("words"))
    from_word = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(PIECE))
    pieces = texts.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), F.explode_outer(F.transform(from_word, lambda i: F.struct(i.alias("first"), F.slice("words", i + 1, PIECE + window - 1).alias("words")))).alias("piece"))
    pieces = with_prints(pieces.select("doc_id", "text_key", "n_words", "piece.*"), window, gram, short)
    changes = F.transform("mins", lambda x, i: F.when((i == 0) | (x != F.get("mins", i - 1)), i))
    pieces = pieces.withColumn("starts", F.array_compact(changes))
    # a row for the text itself, and one for each run; explode would have all this worked out twice, for a filter on the array's size
    itself = F.when(F.col("first") == 0, F.array(F.struct(F.lit(None).cast("long").alias("print"), F.lit(0).alias("length"), F.lit(0).alias("start"), F.lit("").alias("span"))))
    none = F.array().cast("array<struct<print:bigint,length:int,start:int,span:string>>")
    rows = pieces.select("doc_id", "text_key", "n_words", "first", F.explode_outer(F.concat(F.coalesce(itself, none), _spans(window, short))).alias("run"))
    rows = rows.select("doc_id", "text_key", "n_words", "run.print", "run.length", (F.col("first") + F.col("run.start")).cast("long").alias("start"), "run.span")

    passes = []
    for block in range(blocks):
        side = bench if blocks == 1 else bench.filter(F.pmod(F.xxhash64("print"), F.lit(blocks)) == block)
        # proven: a block holds about block_bytes of windows, whatever the benchmark's size
        joined = rows.join(F.broadcast(side.drop("bytes")), "print", "left")
        kept = F.col("windows").isNotNull() | (F.col("length") == 0) if block == 0 else F.col("windows").isNotNull()
        found = joined.filter(kept).select("doc_id", "text_key", "n_words", F.explode_outer(F.when(F.col("windows").isNotNull(), _hits())).alias("hit"), "length")
        passes.append(
            found.filter((F.col("length") == 0) | F.col("hit").isNotNull()).select(
                "doc_id", "text_key", F.when(F.col("length") == 0, F.col("n_words")).alias("n_words"), "hit.start", "hit.length", "hit.items"
            )
        )
    # repeated rows are counted before anything of theirs is gathered
    places = (
        reduce(DataFrame.unionByName, passes)
        .groupBy("doc_id", "text_key", "start", "length")
        .agg(F.max("n_words").alias("n_words"), F.count("n_words").alias("copies"), F.first("items").alias("items"))
    )
    merged = places.groupBy("doc_id", "text_key").agg(
        F.max("n_words").alias("n_words"),
        F.sum("copies").alias("copies"),
        F.collect_list(F.when(F.col("start").isNotNull(), F.struct("start", F.col("length").cast("long").alias("length")))).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    each = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(
        "doc_id",
        "text_key",
        "n_words",
        _covered(F.col("ranges")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("ranges") > 0).alias("contaminated"),
    )


def op7_winnowing(spark, sf_dir: str) -> DataFrame:
    """Contamination of all documents by all benchmark items, windows of 10 words."""
    return contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, dw.n AS n FROM dw JOIN bw USING (n, t)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; other columns as they are.

    Rows are told apart by id and text, so a clean text stays whatever other rows have its id.
    """
    found = _judged(docs, items, id_col, text_col, **options).filter("contaminated").select(F.col("doc_id").alias("_hit_id"), "text_key").distinct()
    hits = written(found, "contaminated")
    return docs.join(hits, docs[id_col].eqNullSafe(hits["_hit_id"]) & (F.xxhash64(docs[text_col]) == hits["text_key"]), "left_anti")
