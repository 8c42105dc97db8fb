"""Language identification with language-bitmask n-gram filters.

A Bloom filter whose slots hold one bit per language (bit-sliced: eight languages
a byte plane) returns, for an n-gram, all languages that contain it in one
lookup.  A text's n-grams are looked up as arrays; per-language popcounts, less
the false positives that a filter of that fill would give, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import broadcast_if_small, checkpointed, free_name, read_table, written
from .simhash import BYTE_BITS

SIZES = (3, 4, 5)
#: Characters that are looked up at once.
CHUNK = 1 << 20
UNDEFINED = "und"
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def code_points(text: str) -> np.ndarray:
    """Lower-case code points between two separators; everything but letters is the separator 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points = np.where(letters()[points], points, 0)
    return np.concatenate(([0], points, [0])).astype(np.uint64)


def gram_hashes(points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """``(position of first character, hash)`` arrays of each size of n-gram.

    An n-gram may begin or end with a separator and has none inside.
    """
    inside = points != 0
    for size in SIZES:
        n = len(points) - size + 1
        if n <= 0:
            continue
        keep = np.ones(n, dtype=bool)
        for j in range(1, size - 1):
            keep &= inside[j : n + j]
        at = np.flatnonzero(keep)
        value = np.full(len(at), size, dtype=np.uint64)
        for j in range(size):
            value = value * np.uint64(_MIX[0]) + points[at + j]
        value ^= value >> np.uint64(31)
        yield at, value * np.uint64(_MIX[1])


class Model(NamedTuple):
    languages: list[str]
    planes: np.ndarray  # (planes, slots) of uint8
    rate: np.ndarray  # false-positive rate of each language
    prior: int  # the language that decides when no n-gram does


def slots_of(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return hashes >> np.uint64(64 - bits), (hashes * np.uint64(_MIX[2])) >> np.uint64(64 - bits)


def sampled(docs: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` different texts of each language at most, of rows ``(lang, text)``, chosen by a hash of the text.

    A text counts once in its language however often it comes, so copies neither fill the sample nor weigh in it.
    """
    rows = docs.withColumn("code", F.xxhash64("text"))
    sizes = rows.groupBy(F.col("lang").alias("size_of")).agg(F.countDistinct("code").alias("size"))
    sizes = broadcast_if_small(written(sizes, "language_sizes"))  # a row for each language, so the texts are not shuffled
    rate = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("size"))
    chosen = rows.join(sizes, F.col("lang") == F.col("size_of")).filter(F.pmod(F.xxhash64("code"), F.lit(1 << 30)) < rate * (1 << 30))
    return chosen.groupBy("lang", "code").agg(F.any_value("text").alias("text")).select("lang", "text")


def held_grams(text: str) -> np.ndarray:
    """The distinct n-grams of ``text``, worked out ``CHUNK`` characters at a time."""
    found, points = np.zeros(0, dtype=np.uint64), code_points(text)
    for start in range(0, len(points), CHUNK):
        piece = points[start : start + CHUNK + max(SIZES) - 1]
        found = np.unique(np.concatenate([found, *(h[at < CHUNK] for at, h in gram_hashes(piece))]))
    return found


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 3000,
    min_share: float = 0.002,
    relative: float = 0.1,
    bits: int = 21,
) -> Model:
    """Fit on at most about ``per_language`` different texts of each language of ``docs``.

    An n-gram belongs to a language if at least ``min_share`` of its documents (and
    two of them) hold it, and at least ``relative`` times the share of the
    language that holds it most.  Rows with a null text or language are left out.
    Counts are compared in Spark; the driver gets the sizes of languages and the
    filter's slots that are not empty, a table no larger than the filter.
    """
    known = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    sample = sampled(known, per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                texts.setdefault(lang, []).append(held_grams(text.as_py()))
            for lang, held in texts.items():
                grams, n = np.unique(np.concatenate(held), return_counts=True)
                for i in range(0, len(grams), CHUNK):
                    part = grams[i : i + CHUNK].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part), pa.array(n[i : i + CHUNK])], names=["lang", "gram", "n"])
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([None], pa.int64()), pa.array([len(held)])], names=["lang", "gram", "n"])

    counts = checkpointed(sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter("n > 1 or gram is null"))
    sizes = {r["lang"]: r["n"] for r in counts.filter("gram is null").collect()}
    languages = sorted(sizes)
    planes = np.zeros((max(1, -(-len(languages) // 8)), 1 << bits), dtype=np.uint8)
    if languages:
        numbers = counts.sparkSession.createDataFrame([(x, i, sizes[x]) for i, x in enumerate(languages)], "lang string, number int, size long")
        shares = counts.filter("gram is not null").join(F.broadcast(numbers), "lang").withColumn("share", F.col("n") / F.col("size"))
        most = shares.groupBy("gram").agg(F.collect_list(F.struct("number", "share")).alias("held"), F.max("share").alias("most"))  # an entry for each language
        kept = most.select("gram", F.filter("held", lambda h: (h["share"] >= min_share) & (h["share"] >= relative * F.col("most"))).alias("held")).filter(F.size("held") > 0)
        for start in range(0, len(languages), 8):
            mask = F.aggregate("held", F.lit(0), lambda m, h: m.bitwiseOR(F.when(h["number"].between(start, start + 7), F.pow(F.lit(2), h["number"] - start).cast("int")).otherwise(0)))
            rows = kept.select("gram", mask.alias("mask")).filter("mask <> 0")

            def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    hashes = batch.column(0).to_numpy().view(np.uint64)
                    both = np.concatenate([x.astype(np.int32) for x in slots_of(hashes, bits)])
                    yield pa.RecordBatch.from_arrays([pa.array(both), pa.concat_arrays([batch.column(1), batch.column(1)])], names=["slot", "mask"])

            slots = rows.mapInArrow(place, "slot int, mask int").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
            planes[start // 8, slots["slot"].to_numpy()] = slots["mask"].to_numpy().astype(np.uint8)
    fill = np.array([(planes[i // 8] >> np.uint8(i % 8) & np.uint8(1)).mean() for i in range(len(languages))])
    first = max(range(len(languages)), key=lambda i: (sizes[languages[i]], -i), default=-1)
    return Model(languages, planes, fill**2, first)


def language_counts(text: str, model: Model, bits: int) -> tuple[np.ndarray, int]:
    """Per-language popcounts over all n-grams of ``text``, and the number of n-grams."""
    counts, total = np.zeros(8 * len(model.planes), dtype=np.int64), 0
    points = code_points(text)
    for start in range(0, len(points), CHUNK):
        piece = points[start : start + CHUNK + max(SIZES) - 1]
        for at, hashes in gram_hashes(piece):
            first, second = slots_of(hashes[at < CHUNK], bits)
            total += len(first)
            for p, plane in enumerate(model.planes):
                counts[8 * p : 8 * p + 8] += np.bincount(plane[first] & plane[second], minlength=256) @ BYTE_BITS
    return counts[: len(model.languages)], total


def decide(text: str | None, model: Model) -> tuple[str, float]:
    """The language of ``text`` and its share of the corrected counts."""
    if not text or not model.languages or not letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].any():
        return UNDEFINED, 0.0
    counts, total = language_counts(text, model, int(np.log2(model.planes.shape[1])))
    true = np.maximum(0.0, (counts - total * model.rate) / np.maximum(1e-9, 1 - model.rate))
    if not true.sum():
        return model.languages[model.prior], 0.0
    best = int(np.argmax(true))
    return model.languages[best], float(true[best] / true.sum())


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row, with ``lang_pred`` and ``score`` (0 to 1).

    ``und`` with score 0 if the text is null or has no letter, or if the model
    knows no language.  Equal counts go to the language that is first by name; a
    text with no known n-gram gets the language with most training documents and
    score 0.  Repeated rows stay repeated.
    """
    model_b = docs.sparkSession.sparkContext.broadcast(tuple(model))  # fixed size: planes x slots bytes
    cols = docs.select(*keep, F.col(text_col).cast("string").alias(free_name(docs.select(*keep), "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*model_b.value)
        for batch in batches:
            found = [decide(t.as_py(), own) for t in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    kinds = ", ".join(f"`{k}` {cols.schema[k].dataType.simpleString()}" for k in keep)
    return cols.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op10_language(spark, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those whose crc32 modulo 5 is not 0."""
    docs = read_table(spark, sf_dir, "documents").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    )
    model = fit(docs.filter("not held_out"))
    return identify(docs, model, keep=("doc_id", "held_out"))
