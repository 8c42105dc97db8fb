"""SimHash near-dedup over a Gray-order hierarchical index.

*Fingerprint*: every word shingle is hashed with XXH64 (seed 42); a fingerprint
bit is set where over half of the hashes have it.

*Index*: an upper node is a masked bit pattern ``(mask, pattern)``.  With radius
``r`` the 64 bits are cut into ``r + 1`` masks; two fingerprints within ``r``
differences agree on one mask at least, so they meet in a node with no
accumulated difference and all other nodes are pruned as wholes.  A node that
holds more than ``node_limit`` fingerprints is not searched in one task: it is
cut again by ``r + 1`` masks of its free bits, with the same guarantee, until
its free bits cannot hold more than the limit.  Inside a node, fingerprints are
sorted by Gray rank, so neighbours share long patterns; runs of them are
factored into a tree of ``(shared mask, pattern)`` nodes, which is searched
against itself, dropping a pair of nodes as soon as the differences accumulated
on bits that both share exceed the radius.

Copies collapse into one fingerprint before the search, a node hands on a
spanning set of its links rather than all of its pairs, and components are
found by joins (``components``), so no group is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import broadcast_if_small, checkpointed, read_table, written

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
FAN = 4
PAIR_CHUNK = 1 << 16
#: Pairs of tree nodes of many trees that are compared at once.
PAIRS_AT_ONCE = 1 << 14


def shingle_hashes(raw: bytes | None, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each ``size``-word shingle (A-Z lower-cased, ASCII white space).

    Fewer words than ``size`` make one shingle; no words (or null) make none.
    """
    words = (raw or b"").translate(LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], seed) for a, b in spans], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The integer whose bits are set in over half of ``hashes`` (none: 0)."""
    if not len(hashes):
        return 0
    octets = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)
    if len(hashes) < 192:
        counts = np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:
        counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ BYTE_BITS for i in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``; fp is the fingerprint's bits as a signed long, never null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [majority(shingle_hashes(x, shingle)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"]
            )

    cols = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return cols.mapInArrow(run, f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, fp long")


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each 64-bit pattern in the reflected Gray order."""
    rank = values.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


def _hierarchy(leaves: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels of (shared mask, pattern), leaves first; a node covers FAN below it."""
    ones, zeros = leaves, ~leaves
    levels = [(ones | zeros, leaves)]
    while len(ones) > FAN:
        cuts = np.arange(0, len(ones), FAN)
        ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
        levels.append((ones | zeros, ones))
    return levels


def _settle(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Merge the sets of each linked pair; labels are least members, before and after.

    Only labels of least members move, so what was one set before stays one.
    """
    while True:
        one, other = labels[a], labels[b]
        if (one == other).all():
            return labels
        np.minimum.at(labels, np.maximum(one, other), np.minimum(one, other))
        while not (labels == (up := labels[labels])).all():
            labels = up


def gray_components(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in Gray order and, for each, its component's first index."""
    values = np.unique(values.astype(np.uint64))
    values = values[np.argsort(gray_rank(values), kind="stable")]
    levels, labels = _hierarchy(values), np.arange(len(values))
    top = len(levels) - 1
    left, right = np.triu_indices(len(levels[top][0]))
    stack = [(top, left, right)]
    while stack:
        depth, left, right = stack.pop()
        if len(left) > PAIR_CHUNK:
            stack += [(depth, left[i : i + PAIR_CHUNK], right[i : i + PAIR_CHUNK]) for i in range(0, len(left), PAIR_CHUNK)]
            continue
        mask, pattern = levels[depth]
        apart = np.bitwise_count((pattern[left] ^ pattern[right]) & mask[left] & mask[right])
        left, right = left[apart <= radius], right[apart <= radius]
        if not len(left):
            continue
        if depth == 0:
            labels = _settle(labels, left, right)
            continue
        steps = np.arange(FAN)
        shape = (len(left), FAN, FAN)
        left = np.broadcast_to(left[:, None, None] * FAN + steps[None, :, None], shape).ravel()
        right = np.broadcast_to(right[:, None, None] * FAN + steps[None, None, :], shape).ravel()
        keep = (left <= right) & (right < len(levels[depth - 1][0]))
        stack.append((depth - 1, left[keep], right[keep]))
    return values, labels


def gray_order(nodes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places of the rows by node, and inside a node by Gray rank of their ``words`` (rows by 64-bit words, the first one counts most)."""
    ranks, flipped = [], np.zeros(len(words), dtype=bool)
    for word in words.T:
        rank = gray_rank(word)
        ranks.append(np.where(flipped, ~rank, rank))  # behind an odd number of set bits the order is reflected
        flipped ^= (np.bitwise_count(word) & 1).astype(bool)
    return np.lexsort([*ranks[::-1], nodes])


def _apart(words: np.ndarray, left: np.ndarray, right: np.ndarray, masks: np.ndarray | None = None) -> np.ndarray:
    """Bits in which two columns of ``words`` (64-bit words by rows) differ, where both ``masks`` have them."""
    total = np.zeros(len(left), dtype=np.int16)
    for i, word in enumerate(words):
        bits = word[left] ^ word[right]
        if masks is not None:
            bits &= masks[i][left] & masks[i][right]
        total += np.bitwise_count(bits)
    return total


def gray_forest(nodes: np.ndarray, words: np.ndarray, radius: int) -> np.ndarray:
    """For each row, the first row of its component under links of ``radius`` bits at most inside its node.

    Rows come in ``gray_order``.  Each node has a tree of its own; all trees are searched against themselves at once.
    A pair of tree nodes is dropped as soon as the differences accumulated on the bits that both share
    exceed the radius, or all rows under both are known to be of one component.  Rows beside each other in the order are
    linked first, so a dense group costs little more than its size.
    """
    n, words = len(nodes), np.ascontiguousarray(words.T)
    # levels of (shared mask, pattern, first row, first child, last child + 1), rows first
    at = np.arange(n)
    levels, owner, ones, zeros, first = [(None, words, at, at, at)], nodes, words, ~words, at
    while n and not (opens := np.append(True, owner[1:] != owner[:-1])).all():
        starts = np.flatnonzero(opens)
        place = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
        cuts = np.flatnonzero(place % FAN == 0)
        ones, zeros = np.bitwise_and.reduceat(ones, cuts, axis=1), np.bitwise_and.reduceat(zeros, cuts, axis=1)
        levels.append((ones | zeros, ones, first[cuts], cuts, np.append(cuts[1:], len(owner))))
        owner, first = owner[cuts], first[cuts]
    beside = np.flatnonzero(nodes[1:] == nodes[:-1])
    beside = beside[_apart(words, beside, beside + 1) <= radius]
    labels = _settle(np.arange(n), beside, beside + 1)

    def components() -> list[np.ndarray]:
        """The component of all rows under each tree node, -1 where there are several."""
        out = []
        for _, _, first, _, _ in levels:
            low = np.minimum.reduceat(labels, first) if n else first
            out.append(np.where(low == np.maximum.reduceat(labels, first), low, -1) if n else first)
        return out

    held, top, steps = components(), len(levels) - 1, np.arange(FAN)
    stack = [(top, np.arange(len(levels[top][2])), np.arange(len(levels[top][2])))]
    while stack:
        depth, left, right = stack.pop()
        if len(left) > PAIRS_AT_ONCE:
            stack += [(depth, left[i : i + PAIRS_AT_ONCE], right[i : i + PAIRS_AT_ONCE]) for i in range(0, len(left), PAIRS_AT_ONCE)]
            continue
        masks, pattern, _, child, child_end = levels[depth]
        open_ = (held[depth][left] < 0) | (held[depth][left] != held[depth][right])
        left, right = left[open_], right[open_]
        near = _apart(pattern, left, right, masks) <= radius
        left, right = left[near], right[near]
        if not len(left):
            continue
        if depth == 0:
            labels = _settle(labels, left, right)
            held = components()
            continue
        shape = (len(left), FAN, FAN)
        to_left = np.broadcast_to(child[left][:, None, None] + steps[None, :, None], shape)
        to_right = np.broadcast_to(child[right][:, None, None] + steps[None, None, :], shape)
        keep = (to_left < child_end[left][:, None, None]) & (to_right < child_end[right][:, None, None]) & (to_left <= to_right)
        stack.append((depth - 1, to_left[keep], to_right[keep]))
    return labels


def linked_within(nodes: np.ndarray, words: np.ndarray, radius: int) -> np.ndarray:
    """For each row, one row of its component (of all its rows the same) under links of ``radius`` bits at most inside its node, by ``gray_forest``."""
    order = gray_order(nodes, words)
    labels = np.empty(len(nodes), dtype=np.int64)
    labels[order] = order[gray_forest(nodes[order], words[order], radius)]
    return labels


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def mask_levels(radius: int, node_limit: int, bits: int = 64) -> list[list[int]]:
    """Masks of each level of upper nodes; mask ``m`` of a level has children ``m * (radius + 1) + j``."""

    def cut(free: list[int]) -> list[list[int]]:
        n = len(free)
        bounds = [n * j // (radius + 1) for j in range(radius + 2)]
        return [free[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    levels, masks = [], [0]
    while not levels or any(2 ** (bits - m.bit_count()) > node_limit for m in masks):
        masks = [m | sum(1 << i for i in part) for m in masks for part in cut([i for i in range(bits) if not m >> i & 1])]
        levels.append(masks)
    return levels


def hamming_links(prints: DataFrame, radius: int = 2, node_limit: int = 4096) -> DataFrame:
    """Spanning links ``(a, b)`` between distinct longs ``fp`` within ``radius`` differing bits.

    Two fingerprints are connected by the result's links exactly when they are
    connected by pairs within ``radius``.  ``node_limit`` bounds one search, not
    what is searched: larger nodes are cut by further masks.
    """
    if radius < 0 or node_limit < 2:
        raise ValueError("radius must be at least 0 and node_limit at least 2")
    levels, found = mask_levels(radius, node_limit), []
    rows = prints.select("fp", F.lit(0).alias("m"))
    for depth, masks in enumerate(levels):
        at = F.array([F.lit(_signed(m)) for m in masks])
        rows = (
            rows.select("fp", F.explode(F.array([F.col("m") * (radius + 1) + j for j in range(radius + 1)])).alias("m"))
            .withColumn("pattern", F.col("fp").bitwiseAND(F.element_at(at, F.col("m") + 1)))
        )
        shared = rows.groupBy("m", "pattern").agg(F.count("*").alias("held")).filter("held > 1")
        rows = checkpointed(rows.join(shared, ["m", "pattern"]))
        last = depth == len(levels) - 1
        nodes = rows if last else rows.filter(F.col("held") <= node_limit)
        found.append(nodes.groupBy("m", "pattern").agg(F.collect_list("fp").alias("fps")).select("fps"))
        rows = rows.filter(F.col("held") > node_limit).select("fp", "m")
        if last or rows.isEmpty():
            break

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for fps in batch["fps"]:
                values, labels = gray_components(np.asarray(fps, dtype=np.int64).view(np.uint64), radius)
                linked = np.flatnonzero(labels != np.arange(len(labels)))
                if len(linked):
                    yield pd.DataFrame({"a": values[linked].view(np.int64), "b": values[labels[linked]].view(np.int64)})

    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.mapInPandas(search, "a long, b long")


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2, node_limit: int = 4096
) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id, n_same``.

    fingerprint: 16 lower-case hex digits.  component_id: the least id reachable
    by links of at most ``radius`` differing bits, the row's own included.
    n_same: rows with the same fingerprint.  Null and empty texts have
    fingerprint zero and link like any other; rows with a null id get their
    component's least id (null if it has none); repeated rows stay repeated; an
    empty table gives an empty result; other columns are ignored.
    """
    prints = checkpointed(with_fingerprints(docs, id_col, text_col, shingle))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same")))
    parts = checkpointed(connected_components(hamming_links(classes.select("fp"), radius, node_limit)))
    members = parts.join(classes, parts.node == classes.fp)
    roots = written(members.groupBy("component").agg(F.min("least").alias("root")), "roots")
    linked = members.join(broadcast_if_small(roots), "component").select("fp", "root")
    table = checkpointed(
        classes.join(linked, "fp", "left").select(
            "fp", F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("root")).alias("component_id"), "n_same"
        )
    )
    return prints.join(table, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_same"
    )


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    """SimHash near-dedup of all documents: 3-word shingles, 2 bits."""
    return simhash_components(read_table(spark, sf_dir, "documents"), shingle=3, radius=2)
