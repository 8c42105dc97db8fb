"""Near-duplicate documents by SimHash, verified on shingle sets.

Used where documents of similarity 0.8 or more must meet.  At that similarity a
64-bit fingerprint differs in some ten bits, too many for exact search by masks,
so each document has a 128-bit SimHash of its set of word shingles, and the
index draws masks of ``bits`` positions at random: fingerprints that agree on a
mask fall under one node, and inside a node those within ``radius`` differing
bits are linked by the Gray-order hierarchical index of ``simhash``.  ``bits`` grows with the logarithm of the number of
fingerprints, so nodes stay small, and the number of masks is what the wanted
recall at the similarity asks for.

Links between fingerprints give coarse groups.  In each, the shingle sets of its
distinct texts are compared exactly, block against block, and the verified links
give the final components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import broadcast_if_small, checkpointed, free_name, written
from .simhash import _settle, linked_within, majority, shingle_hashes

WORDS = 128
#: Rows of one node, or of a block of a larger one, that are compared in one piece.
NODE_ROWS = 4096
BLOCK_ROWS = 512
#: Shingles that a block of sets holds on average at most; a single longer set is a block of its own size.
BLOCK_SHINGLES = 1 << 20
#: Sets up to this size are compared by their shingles too, not by fingerprints alone.
SMALL = 20


def shingle_set(raw: bytes | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(raw, shingle))


def second_hash(values: np.ndarray) -> np.ndarray:
    """Another 64 bits for each hash (a finaliser of the splitmix kind)."""
    x = values + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that, with the id, tell rows of different texts apart."""
    return F.xxhash64(text.cast("string")), F.xxhash64(F.lit(1), text.cast("string"))


def described(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``(doc_id, t0, t1, s0, s1, f0, f1, n, short)``: the key of the text, 128 bits that name the shingle set, its fingerprint, its size, and a small set itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, small = np.zeros((batch.num_rows, 5), dtype=np.uint64), [None] * batch.num_rows
            for i, raw in enumerate(batch.column(1)):
                held = shingle_set(raw.as_py(), shingle)
                name = xxhash.xxh3_128_intdigest(held.tobytes())
                out[i] = name >> 64, name & (1 << 64) - 1, majority(held), majority(second_hash(held)), len(held)
                if 0 < len(held) <= SMALL:
                    small[i] = held.view(np.int64)
            cols = [pa.array(np.ascontiguousarray(out[:, j]).view(np.int64)) for j in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *cols, pa.array(small, pa.list_(pa.int64()))], names=["doc_id", "t0", "t1", "s0", "s1", "f0", "f1", "n", "short"])

    t0, t1 = text_key(F.col(text_col))
    cols = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"), t0.alias("t0"), t1.alias("t1"))
    return cols.mapInArrow(run, f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, t0 long, t1 long, s0 long, s1 long, f0 long, f1 long, n long, short array<long>")


def differing(similarity: float) -> float:
    """Expected share of differing bits of two sets of equal size with this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def small_set_links(classes: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` of the fingerprints of small sets that share one of their rarest shingles.

    Of two sets of this similarity, the least frequent ``n - ceil(similarity * n) + 1`` shingles of
    both hold a common one (prefix filter), so no such pair of small sets is missed, however few
    shingles it has: there a fingerprint's bits say little, as ties are frequent.
    """
    held = written(classes.filter("short is not null").select("s0", "s1", "fid", "n", F.explode("short").alias("code")), "small_sets")
    seen = written(held.groupBy("code").agg(F.count("*").alias("texts")), "small_counts")
    ranked = held.join(broadcast_if_small(seen), "code").groupBy("s0", "s1", "fid", "n").agg(F.array_sort(F.collect_list(F.struct("texts", "code"))).alias("codes"))  # SMALL entries at most
    first = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    nodes = written(ranked.select("fid", F.explode(F.slice("codes", F.lit(1), first.cast("int"))).alias("code")).select("fid", "code.code"), "small_nodes")
    least = written(nodes.groupBy("code").agg(F.min("fid").alias("low"), F.count("*").alias("texts")).filter("texts > 1").select("code", "low"), "small_heads")
    return nodes.join(broadcast_if_small(least), "code").filter("fid <> low").select(F.col("fid").alias("a"), F.col("low").alias("b")).distinct()


def plan_masks(size: int, apart: float, recall: float) -> tuple[int, int, int]:
    """Bits of a mask, number of masks, and radius, for ``size`` fingerprints of which pairs differ in a share ``apart`` of bits."""
    bits = max(6, math.ceil(math.log2(max(size, 2))) - 2)
    masks = math.ceil(math.log(1 - recall) / math.log(1 - (1 - apart) ** bits))
    radius = math.ceil(WORDS * apart + 3 * math.sqrt(WORDS * apart * (1 - apart)))
    return bits, masks, radius


def masked_nodes(prints: DataFrame, bits: int, masks: int) -> DataFrame:
    """``(node, fid, f0, f1)``: each fingerprint under each of its masks."""
    rng = np.random.default_rng(20)
    places = np.array([rng.permutation(WORDS)[:bits] for _ in range(masks)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                fid, f0, f1 = (c.to_numpy() for c in batch.slice(start, 2048).columns)
                both = np.ascontiguousarray(np.stack([f0, f1], axis=1)).view(np.uint8).reshape(len(fid), 16)
                on = np.unpackbits(both, axis=1, bitorder="little")
                nodes = np.empty((len(fid), masks), dtype=np.uint64)
                for t in range(masks):
                    packed = np.zeros((len(fid), 8), dtype=np.uint8)
                    part = np.packbits(on[:, places[t][:64]], axis=1, bitorder="little")
                    packed[:, : part.shape[1]] = part
                    nodes[:, t] = second_hash(packed.view(np.uint64).ravel() * np.uint64(masks + 1) + np.uint64(t))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes.ravel().view(np.int64)), *(pa.array(np.repeat(c, masks)) for c in (fid, f0, f1))], names=["node", "fid", "f0", "f1"]
                )

    return prints.select("fid", "f0", "f1").mapInArrow(run, "node long, fid long, f0 long, f1 long")


def node_links(nodes: DataFrame, radius: int) -> DataFrame:
    """Spanning links ``(a, b)`` of fingerprints under one node that differ in ``radius`` bits at most.

    A node is an upper node of ``simhash``'s hierarchical index: inside it fingerprints are searched by a tree over their Gray
    order (``gray_forest``).  A partition is read in node order.  A node that two pieces of ``NODE_ROWS`` rows hold is compared whole, wherever
    batches end; a larger one is passed on in blocks, and each two of its blocks are compared
    in a task of their own, so all pairs of a node are compared and memory is bounded.
    """

    def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, none, none], names=["a", "b", "node", "block", "f0", "f1"])

    def block_of(rows: np.ndarray, number: int) -> pa.RecordBatch:
        cols = [rows[:, 1], None, rows[:, 0], np.full(len(rows), number), rows[:, 2], rows[:, 3]]
        return pa.RecordBatch.from_arrays([pa.nulls(len(rows), pa.int64()) if c is None else pa.array(c) for c in cols], names=["a", "b", "node", "block", "f0", "f1"])

    def whole(rows: np.ndarray) -> pa.RecordBatch:
        """Links of nodes that are complete in ``rows``."""
        labels = linked_within(rows[:, 0], np.ascontiguousarray(rows[:, 2:4]).view(np.uint64), radius)
        moved = np.flatnonzero(labels != np.arange(len(rows)))
        return links(rows[moved, 1], rows[labels[moved], 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number = np.zeros((0, 4), dtype=np.int64), 0  # the last node's rows, and how many of its blocks went before
        for batch in batches:
            for i in range(0, batch.num_rows, NODE_ROWS):
                rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.slice(i, NODE_ROWS).columns], axis=1)])
                if number and rows[-1, 0] != rows[0, 0]:
                    end = int(np.argmax(rows[:, 0] != rows[0, 0]))
                    yield block_of(rows[:end], number)
                    rows, number = rows[end:], 0
                last = len(rows) - int(np.argmax(rows[::-1, 0] != rows[-1, 0])) if rows[0, 0] != rows[-1, 0] else 0
                if last:
                    # each of these nodes has twice NODE_ROWS rows at most: larger ones were cut when they filled a piece
                    yield whole(rows[:last])
                held = rows[last:]
                while len(held) > NODE_ROWS:
                    yield block_of(held[:NODE_ROWS], number)
                    held, number = held[NODE_ROWS:], number + 1
        if number:
            yield block_of(held, number)
        elif len(held):
            yield whole(held)

    kind = "a long, b long, node long, block long, f0 long, f1 long"
    found = checkpointed(nodes.repartition("node").sortWithinPartitions("node").mapInArrow(run, kind))
    small, large = found.filter("node is null").select("a", "b"), found.filter("node is not null").drop("b")
    if large.isEmpty():
        return small

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def compared() -> pa.RecordBatch:
            rows = np.concatenate(parts) if parts else np.zeros((0, 6), dtype=np.int64)
            labels = linked_within(np.zeros(len(rows), dtype=np.int64), np.ascontiguousarray(rows[:, 4:6]).view(np.uint64), radius)
            moved = np.flatnonzero(labels != np.arange(len(rows)))
            return pa.RecordBatch.from_arrays([pa.array(rows[moved, 3]), pa.array(rows[labels[moved], 3])], names=["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1) if batch.num_rows else np.zeros((0, 6), dtype=np.int64)
            cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            for part in np.split(rows, cuts) if len(rows) else []:
                if key != (now := tuple(part[0, :3])):
                    yield compared()
                    key, parts = now, []
                parts.append(part)
        yield compared()

    blocks = large.groupBy("node").agg((F.max("block") + 1).alias("blocks"))
    spread = (
        large.join(blocks, "node")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .filter("other <> block")
        .select("node", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.col("a").alias("fid"), "f0", "f1")
    )
    keys = ["node", "low", "high"]
    return small.unionByName(spread.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(both, "a long, b long"))


def block_links(members: DataFrame, similarity: float) -> DataFrame:
    """Verified spanning links ``(a, b)`` of classes, from ``(grp, blocks, cls, held)`` rows with their shingle sets.

    A class that comes twice in a block counts once.
    """
    own = F.pmod(F.xxhash64("cls"), F.col("blocks").cast("long")).cast("int")
    spread = (
        members.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("grp", "cls", "held", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    )

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, {}
        for batch in batches:
            for grp, low, high, c, s in zip(batch["grp"], batch["low"], batch["high"], batch["cls"], batch["held"], strict=True):
                if key != (grp, low, high):
                    yield exact_links(np.array(list(held), dtype=np.int64), list(held.values()), similarity)
                    key, held = (grp, low, high), {}
                held[c] = np.frombuffer(s, dtype=np.uint64)
        yield exact_links(np.array(list(held), dtype=np.int64), list(held.values()), similarity)

    keys = ["grp", "low", "high"]
    return spread.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(verify, "a long, b long")


def exact_links(cls: np.ndarray, sets: list[np.ndarray], similarity: float) -> pd.DataFrame:
    """Spanning links of the classes whose sets have this Jaccard similarity or more."""
    labels, sizes = np.arange(len(cls)), np.array([len(s) for s in sets], dtype=np.int64)
    if len(cls) > 1:
        every = np.concatenate(sets)
        values, codes, counts = np.unique(every, return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(cls)), sizes)
        shared = np.flatnonzero(counts > 1)
        overlap = np.zeros((len(cls), len(cls)), dtype=np.float32)
        at = np.full(len(values), -1)
        for i in range(0, len(shared), 8192):  # some columns of the incidence matrix at a time
            part = shared[i : i + 8192]
            at[:] = -1
            at[part] = np.arange(len(part))
            keep = at[codes] >= 0
            grid = np.zeros((len(cls), len(part)), dtype=np.float32)
            grid[rows[keep], at[codes[keep]]] = 1
            overlap += grid @ grid.T
        union = sizes[:, None] + sizes[None, :] - overlap
        a, b = np.nonzero(np.triu(overlap >= similarity * union - 1e-6, 1))
        labels = _settle(labels, a, b)
    moved = np.flatnonzero(labels != np.arange(len(cls)))
    return pd.DataFrame({"a": cls[moved], "b": cls[labels[moved]]}, dtype=np.int64)


def duplicate_classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, recall: float) -> DataFrame:
    """``(doc_id, t0, t1, first)`` for every row: whether its id and text are the least of its component, null ids last."""
    rows = checkpointed(described(docs, id_col, text_col, shingle))
    own = F.struct(F.col("doc_id").isNull().alias("anon"), "doc_id", "t0", "t1")
    classes = rows.groupBy("s0", "s1", "f0", "f1", "n").agg(F.min(own).alias("least"), F.any_value("short").alias("short"))
    classes = checkpointed(classes.withColumn("fid", F.xxhash64("f0", "f1")))
    prints = checkpointed(classes.select("f0", "f1", "fid").distinct())
    bits, masks, radius = plan_masks(prints.count(), differing(similarity), recall)
    near = node_links(masked_nodes(prints, bits, masks), radius).unionByName(small_set_links(classes, similarity))
    coarse = connected_components(near)
    grouped = classes.join(coarse, F.col("fid") == F.col("node"), "left").select("s0", "s1", "n", "least", F.coalesce("component", "fid").alias("grp"))
    grouped = checkpointed(grouped)
    # groups of one class need no comparison
    several = grouped.groupBy("grp").agg(F.count("*").alias("count"), F.sum("n").alias("n")).filter("count > 1")
    blocks = F.ceil(F.greatest(F.col("count") / float(BLOCK_ROWS), F.col("n") / float(BLOCK_SHINGLES))).cast("int")
    several = written(several.select("grp", blocks.alias("blocks")), "several")
    reps = grouped.join(broadcast_if_small(several), "grp").select("s0", "s1", "grp", "blocks", F.col("least.doc_id").alias("rep"), F.col("least.t0").alias("r0"), F.col("least.t1").alias("r1"))
    asked = written(reps, "asked")
    t0, t1 = text_key(F.col("text"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(broadcast_if_small(asked), F.col("id").eqNullSafe(F.col("rep")) & (t0 == F.col("r0")) & (t1 == F.col("r1")))
    texts = texts.select("s0", "s1", "grp", "blocks", F.col("text").cast("binary").alias("text"))
    if repeated(rows):  # one text for each class, however often its row comes
        texts = texts.groupBy("s0", "s1", "grp", "blocks").agg(F.first("text").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s0, s1, grp, blocks = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for i, raw in enumerate(batch.column(4)):
                held = shingle_set(raw.as_py(), shingle)
                name = xxhash.xxh3_128_intdigest(held.tobytes())
                if (name >> 64, name & (1 << 64) - 1) == (s0[i] % (1 << 64), s1[i] % (1 << 64)):
                    out.append((grp[i], blocks[i], s0[i], held.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[j] for r in out], k) for j, k in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["grp", "blocks", "cls", "held"]
            )

    members = texts.mapInArrow(sets, "grp long, blocks int, cls long, held binary")
    final = connected_components(block_links(members, similarity))
    named = classes.join(final, F.col("s0") == F.col("node"), "left").select("s0", "s1", "least", F.coalesce("component", "s0").alias("component"))
    named = written(named, "named")
    roots = written(named.groupBy("component").agg(F.min("least").alias("root")), "roots")  # a table of its own, so that a large component's rows can be split
    table = checkpointed(named.join(broadcast_if_small(roots), "component").select("s0", "s1", "root"))
    first = F.col("doc_id").eqNullSafe(F.col("root.doc_id")) & (F.col("t0") == F.col("root.t0")) & (F.col("t1") == F.col("root.t1"))
    return rows.join(table, ["s0", "s1"]).select("doc_id", "t0", "t1", first.alias("first"))


def repeated(rows: DataFrame) -> bool:
    """Whether two rows have the same id and text."""
    return not rows.groupBy("doc_id", "t0", "t1").count().filter("count > 1").isEmpty()


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.98
) -> DataFrame:
    """The rows of ``docs`` that are the first of their group of near duplicates.

    Texts are near duplicates if the Jaccard similarity of their sets of
    ``shingle``-word shingles is ``similarity`` or more, or by way of others.
    The row with the least id stays, null ids last; rows are told apart by id and text,
    so an id that comes with several texts is judged for each of them, and of rows that
    repeat both, one stays.  Texts without words (null ones too) are one group.
    ``recall`` is the expected share of pairs at exactly ``similarity`` that the index
    finds; closer pairs are found almost surely, and pairs of sets of ``SMALL`` shingles at most surely.
    """
    found = checkpointed(duplicate_classes(docs, id_col, text_col, shingle, similarity, recall))
    rest = written(found.filter(~F.col("first")).select("doc_id", "t0", "t1").distinct(), "dropped")
    t0, t1 = text_key(docs[text_col])
    kept = docs.join(broadcast_if_small(rest), docs[id_col].eqNullSafe(rest["doc_id"]) & (t0 == rest["t0"]) & (t1 == rest["t1"]), "left_anti")
    if not repeated(found.filter("first")):
        return kept
    # of rows that share id and text, one stays
    order = Window.partitionBy(id_col, *text_key(F.col(text_col))).orderBy(F.xxhash64(text_col))
    nth = free_name(docs, "nth")
    return kept.withColumn(nth, F.row_number().over(order)).filter(F.col(nth) == 1).select(*docs.columns)
