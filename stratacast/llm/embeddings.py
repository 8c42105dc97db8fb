"""Embedding near-dedup over a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors.  A vector is
described by its ``depth`` nearest pivots in order, and filed in the inverted
lists of the first ``probes`` of them.  Vectors of one label that share a list
and at least ``min_shared`` pivots are candidates and are verified in double
precision.  A pair that shares several lists is looked at in one only, that of
its least shared pivot.

Equal vectors are one class before anything else.  A list longer than
``block_rows`` is cut into blocks that meet pairwise in tasks of their own.  A
task hands on link counts and a spanning set of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .runtime import broadcast_if_small, checkpointed, read_table, written
from .simhash import _settle

MAX_PIVOTS, PIVOT_BYTES = 4096, 64 << 20
#: No two pivots have a larger cosine.
APART = 0.8
CHUNK = 1 << 15


def units(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``(vec_id, label, unit)``; unit holds the normalised doubles, null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for v in batch.column(2):
                x = v.as_py()
                x = np.array([np.nan] if not x or None in x else x, dtype=np.float64)
                with np.errstate(all="ignore"):
                    x = x / np.abs(x).max() if np.isfinite(x).all() and x.any() else x * np.nan
                    x = x / np.sqrt(x @ x)
                found.append(x.tobytes() if np.isfinite(x).all() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["vec_id", "label", "unit"])

    cols = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    kinds = {f.name: f.dataType.simpleString() for f in cols.schema}
    rows = cols.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, unit binary")
    return rows.withColumn("unit", F.when(F.col("label").isNotNull(), F.col("unit")))


def choose_pivots(classes: DataFrame, size: int) -> list[np.ndarray]:
    """Of about ``4 * sqrt(size)`` vectors, at most ``MAX_PIVOTS`` and ``PIVOT_BYTES``, the first by a hash: those that lie apart.

    Without the last step a large group of near copies would give many pivots
    that its members cannot tell apart, and their permutations would be noise.
    """
    n = min(MAX_PIVOTS, max(32, int(4 * size**0.5)))
    rows = classes.select("unit").orderBy(F.xxhash64("unit"), "unit").limit(n).collect()
    chosen = [np.frombuffer(r["unit"], dtype=np.float64) for r in rows]
    held = np.cumsum([p.nbytes for p in chosen])
    chosen = [p for p, b in zip(chosen, held, strict=True) if b <= PIVOT_BYTES] or chosen[:1]
    width = max(map(len, chosen))
    grid = np.array([np.pad(p, (0, width - len(p))) for p in chosen])
    apart = np.ones(len(chosen), dtype=bool)
    for i in range(1, len(chosen)):
        apart[i] = not (grid[:i][apart[:i]] @ grid[i] >= APART).any()
    return [p for p, keep in zip(chosen, apart, strict=True) if keep]


def permutations(vectors: list[np.ndarray], pivots: list[np.ndarray], depth: int) -> np.ndarray:
    """The ``depth`` nearest pivots of each vector, nearest first; shorter vectors are compared over what they have."""
    width = max(len(p) for p in pivots)
    fitted = [np.pad(v[:width], (0, max(0, width - len(v)))) for v in vectors]
    grid = np.array([np.pad(p, (0, width - len(p))) for p in pivots])
    near = -(np.array(fitted) @ grid.T)
    depth = min(depth, len(pivots))
    top = np.argpartition(near, depth - 1, axis=1)[:, :depth]
    order = np.lexsort((top, np.take_along_axis(near, top, axis=1)), axis=1)
    return np.take_along_axis(top, order, axis=1).astype(np.int32)


def _candidates(perms: np.ndarray, pivot: int, probes: int, min_shared: int, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of ``first``, one of ``second``) that share enough pivots and whose list this is."""
    codes, inverse = np.unique(perms, return_inverse=True)
    held = np.zeros((len(perms), len(codes)), dtype=np.float32)
    held[np.arange(len(perms))[:, None], inverse.reshape(perms.shape)] = 1
    a, b = np.nonzero(held[first] @ held[second].T >= min_shared - 0.5)
    a, b = first[a], second[b]
    a, b = a[a != b], b[a != b]
    keep = np.zeros(len(a), dtype=bool)
    for i in range(0, len(a), CHUNK):
        left, right = perms[a[i : i + CHUNK], :probes], perms[b[i : i + CHUNK], :probes]
        shared = np.where((left[:, :, None] == right[:, None, :]).any(axis=2), left, np.iinfo(np.int32).max)
        keep[i : i + CHUNK] = shared.min(axis=1) == pivot
    return a[keep], b[keep]


def search_list(ids: np.ndarray, weights: np.ndarray, perms: np.ndarray, vectors: np.ndarray, side: np.ndarray, pivot: int, probes: int, min_shared: int, threshold: float):
    """Link counts and spanning links of one list, or of two of its blocks (``side`` 0 and 1)."""
    two = side.any()
    first, second = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if two else (np.arange(len(ids)),) * 2
    a, b = _candidates(perms, pivot, probes, min_shared, first, second)
    if not two:
        a, b = a[a < b], b[a < b]
    linked = np.zeros(len(a), dtype=bool)
    for i in range(0, len(a), CHUNK):
        linked[i : i + CHUNK] = np.einsum("ij,ij->i", vectors[a[i : i + CHUNK]], vectors[b[i : i + CHUNK]]) >= threshold
    a, b = a[linked], b[linked]
    counts = np.bincount(a, weights[b], len(ids)) + np.bincount(b, weights[a], len(ids))
    labels = _settle(np.arange(len(ids)), a, b)
    at, moved = np.flatnonzero(counts), np.flatnonzero(labels != np.arange(len(ids)))
    return (ids[at], counts[at].astype(np.int64)), (ids[moved], ids[labels[moved]])


def vector_links(classes: DataFrame, threshold: float, depth: int, probes: int, min_shared: int, block_rows: int) -> DataFrame:
    """``(kind, a, b)``: ``kind`` 0 has a class and linked rows, ``kind`` 1 a spanning link of two classes."""
    size = classes.count()
    if not size:
        return classes.sparkSession.createDataFrame([], "kind int, a long, b long")
    chosen = choose_pivots(classes, size)
    need = min(min_shared, len(chosen))  # with few pivots all vectors share all of them
    pivots = classes.sparkSession.sparkContext.broadcast(chosen)  # bounded by MAX_PIVOTS and PIVOT_BYTES

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                perms = permutations([np.frombuffer(u, dtype=np.float64) for u in part.column(3).to_pylist()], pivots.value, depth)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(perms.tolist(), pa.list_(pa.int32()))], names=[*part.schema.names, "perm"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in classes.select("cid", "n", "label", "unit").schema)
    described = checkpointed(classes.select("cid", "n", "label", "unit").mapInArrow(describe, f"{kinds}, perm array<int>"))
    entries = described.withColumn("pivot", F.explode(F.slice("perm", 1, probes))).withColumn("width", F.length("unit"))
    key = ["label", "width", "pivot"]
    lists = written(
        entries.groupBy(key).agg(F.count("*").alias("held")).withColumn("blocks", F.ceil(F.col("held") / float(block_rows)).cast("int")), "lists"
    )
    total = lists.agg(F.sum(F.col("held") * F.col("blocks"))).first()[0]
    own = F.pmod(F.xxhash64("cid"), F.col("blocks").cast("long")).cast("int")
    spread = (
        entries.join(lists, key)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("cid", "n", "perm", "unit", *key, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"))
        .withColumn("bucket", F.pmod(F.xxhash64(*key, "low", "high"), F.lit(max(1, -(-total // 10_000)))))
    )

    def search(group: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"kind": [], "a": [], "b": []}, dtype=np.int64)]
        for (_, width, pivot, *_), rows in group.groupby([*key, "low", "high"], sort=False):
            if len(rows) < 2:
                continue
            rows = rows.sort_values("cid")
            vectors = np.frombuffer(b"".join(rows["unit"]), dtype=np.float64).reshape(len(rows), width // 8)
            counts, links = search_list(
                rows["cid"].to_numpy(), rows["n"].to_numpy(), np.stack(rows["perm"]), vectors, rows["side"].to_numpy(), pivot, probes, need, threshold
            )
            out.append(pd.DataFrame({"kind": 0, "a": counts[0], "b": counts[1]}))
            out.append(pd.DataFrame({"kind": 1, "a": links[0], "b": links[1]}))
        return pd.concat(out)

    return spread.groupBy("bucket").applyInPandas(search, "kind int, a long, b long")


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    depth: int = 10,
    probes: int = 6,
    min_shared: int = 3,
    block_rows: int = 512,
) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Vectors link when their labels are equal and not null, their widths are equal
    and their cosine is ``threshold`` or more.  Null, empty and zero vectors, and
    those with null or non-finite components, link with nothing and are kept.
    Rows with a null id count as links and belong to components, whose id is the
    least that is not null.  Repeated rows link with each other; all rows that
    have the component's id are kept.  Extra columns are ignored.
    """
    rows = checkpointed(units(vectors, id_col, vector_col, label_col))
    grouped = checkpointed(rows.filter("unit is not null").groupBy("label", "unit").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")))
    classes = checkpointed(grouped.withColumn("cid", F.monotonically_increasing_id()))
    found = checkpointed(vector_links(classes, threshold, depth, probes, min_shared, block_rows))
    counts = found.filter("kind = 0").groupBy(F.col("a").alias("cid")).agg(F.sum("b").alias("links"))
    parts = connected_components(found.filter("kind = 1").select("a", "b")).withColumnRenamed("node", "cid")
    members = checkpointed(classes.select("cid", "least").join(parts, "cid"))
    roots = written(members.groupBy("component").agg(F.min("least").alias("root")), "roots")
    rooted = members.join(broadcast_if_small(roots), "component").select("cid", "root")
    table = checkpointed(
        classes.join(counts, "cid", "left")
        .join(rooted, "cid", "left")
        .select("label", "unit", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "least").alias("component_id"))
    )
    linked = rows.filter("unit is not null").join(table, ["label", "unit"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("unit is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op4_embeddings(spark, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings of each label, at cosine 0.98."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


OP4_SQL = r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND list_aggregate(list_transform(e, lambda x: (x IS NOT NULL AND isfinite(x))::INT), 'min') = 1
       AND list_aggregate(list_transform(e, lambda x: abs(x)), 'max') > 0),
l AS (SELECT a.r AS ra, b.r AS rb, a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT ra, rb, b FROM l UNION SELECT reach.ra, l.rb, l.b FROM reach JOIN l ON reach.rb = l.ra),
low AS (SELECT ra, min(b) AS b FROM reach GROUP BY 1),
n AS (SELECT ra, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(low.b, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low.b, vec_id)) AS kept
FROM v LEFT JOIN low ON v.r = low.ra LEFT JOIN n ON v.r = n.ra
"""
