"""Merkle manifest of a dataset: tree digests, and each row's proof.

Rows are leaves.  Leaves of a group ascend by id; every ``FAN`` consecutive nodes become
one, level by level, until one node is left.  The leaves are cut into aligned blocks of
``FAN ** LEVELS``: a block is a subtree, traversed in postorder by one task, which returns the
subtree's digest and appends siblings to the leaves that it holds while it unwinds.  The
blocks' digests are the leaves of the next, smaller traversal, so a tree of any size takes
a few rounds, each distributed.  Places come from ranges of the order (``numbered``), so a group
that holds most rows is split like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import numbered
from .runtime import broadcast_if_small, read_table, written

FAN = 8
#: Levels that a task traverses; a block holds ``FAN ** LEVELS`` leaves.
LEVELS = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def combined(digests: list[bytes]) -> bytes:
    """The digest of digests, which are hashed as hex text."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def traverse(nodes: list[bytes], levels: int) -> tuple[bytes, list[list[bytes]]]:
    """The digest of the subtree of ``levels`` levels over ``nodes``, and each node's siblings, level by level, left to right.

    Postorder: the sides below are visited first; a node's siblings are appended to the leaves
    below it on the way back up.
    """
    if not levels:
        return nodes[0], [[]]
    width = FAN ** (levels - 1)
    below = [traverse(nodes[i : i + width], levels - 1) for i in range(0, len(nodes), width)]
    roots = [root for root, _ in below]
    paths = []
    for i, (_, inner) in enumerate(below):
        siblings = roots[:i] + roots[i + 1 :]
        for path in inner:
            path.append(siblings)
            paths.append(path)
    return combined(roots), paths


def climb(leaf: bytes, number: int, path: list[list[bytes]]) -> bytes:
    """The root that ``leaf`` at place ``number`` and its siblings give."""
    for siblings in path:
        at = number % FAN
        leaf, number = combined([*siblings[:at], leaf, *siblings[at:]]), number // FAN
    return leaf


def rounds(leaves: DataFrame, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """Traverse trees from ``leaves`` (tree, number from 0, digest, and any further columns): ``leaves`` with ``path``, and ``(tree, root)``.

    ``path`` is the siblings of each level, concatenated (empty where a node is alone in its run).
    A tree's levels end where one node is left; a lone leaf is its tree's root and its path is empty.
    """
    sizes = written(leaves.groupBy("tree").agg(F.count("*").alias("held")), "tree_sizes")
    now, parts, width = leaves, [], FAN**levels

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("number")
        held, steps = rows["held"][0].as_py(), 0
        while steps < levels and held > 1:  # where the tree ends within this block
            held, steps = -(-held // FAN), steps + 1
        root, paths = traverse(rows["digest"].to_pylist(), steps)
        rows = rows.append_column("path", pa.array([[b"".join(s) for s in p] for p in paths], pa.list_(pa.binary())))
        return rows.append_column("root", pa.array([root] + [None] * (len(rows) - 1), pa.binary()))  # once for each block

    while True:
        ready = now.join(broadcast_if_small(sizes), "tree").withColumn("block", F.floor(F.col("number") / width))
        schema = T.StructType([*ready.schema.fields, T.StructField("path", T.ArrayType(T.BinaryType())), T.StructField("root", T.BinaryType())])
        done = written(ready.groupBy("tree", "block").applyInArrow(run, schema), "traversal")
        parts.append(done.select(*now.columns, "path"))
        blocks = done.filter(F.col("root").isNotNull())
        sizes = written(sizes.select("tree", F.ceil(F.col("held") / width).alias("held")), "tree_sizes")
        if sizes.filter("held > 1").isEmpty():
            break
        now = blocks.select("tree", F.col("block").alias("number"), F.col("root").alias("digest"))
    paths = parts.pop()
    while parts:  # an upper block's path belongs to all leaves below it
        above = written(paths.select(F.col("tree").alias("t"), F.col("number").alias("n"), F.col("path").alias("above")), "paths")
        low = parts.pop()
        match = (low["tree"] == F.col("t")) & (F.floor(low["number"] / width) == F.col("n"))
        kept = [c for c in low.columns if c != "path"]
        paths = low.join(broadcast_if_small(above), match).select(*kept, F.concat("path", "above").alias("path"))
    return paths, blocks.select("tree", "root")


def manifest(docs: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    A leaf is the digest of id, source, language, length and text; languages (null is one,
    and comes first) have a tree each, and their roots one more.  ``proof_sha256`` is the digest of
    the siblings from the leaf to the root, that of nothing where there are none.  Where 3 divides the
    CRC-32 of the id, the text is tampered with (A-Z lower-cased): ``folded_root`` is the root that the
    altered leaf gives with the original siblings.

    Leaves ascend by id, null ids first, and by digest among equal ids, so the root does not
    depend on the order of rows; repeated rows are leaves of their own, each with its own proof.  A null
    id is not tampered with.  Null and empty texts differ.  An empty table gives no row; other columns are ignored.
    """
    part = {c: F.col(c) for c in FIELDS}
    lower = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    leaf = F.sha2(F.concat(*[field(part[c]) for c in FIELDS]), 256)
    other = F.sha2(F.concat(*[field(lower if c == "text" else part[c]) for c in FIELDS]), 256)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("tree"),  # null first
        F.unhex(leaf).alias("digest"),
        F.when(tampered, F.unhex(other)).alias("other"),
    )
    ordered = numbered(rows.withColumn("_row", F.monotonically_increasing_id()), ["doc_id", "digest", "_row"], ["tree"])
    leaves, subroots = rounds(ordered.select("tree", "number", "doc_id", "digest", "other"))
    # one row for each language: their trees' roots are the leaves of one more
    tops, root = rounds(numbered(subroots, ["tree"]).select(F.lit("").alias("tree"), "number", F.col("root").alias("digest"), F.col("tree").alias("lang")))
    upper = tops.join(root, "tree").select(F.col("lang").alias("tree"), F.col("digest").alias("subroot"), F.col("number").alias("place"), F.col("path").alias("top"), "root")
    ready = leaves.join(broadcast_if_small(written(upper, "upper")), "tree").select("doc_id", "number", "digest", "other", "path", "subroot", "place", "top", "root")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, leaf, other, path, subroot, place, top, root in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                low, high = ([[s[i : i + 32] for i in range(0, len(s), 32)] for s in p] for p in (path, top))
                proof = sha256(b"".join(path + top).hex().encode()).hexdigest()
                folded = climb(climb(other or leaf, number, low), place, high)
                out.append((leaf.hex(), subroot.hex(), root.hex(), proof, folded.hex(), folded == root))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            arrays = [pa.array(c, pa.bool_() if i == 5 else pa.string()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    kind = ready.schema["doc_id"].dataType.simpleString()
    return ready.mapInArrow(fold, f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """The Merkle manifest of all documents."""
    return manifest(read_table(spark, sf_dir, "documents"))


def crc32_sql(text: str) -> str:
    """DuckDB's unsigned CRC-32 of an ASCII string: eight shifts for each byte."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_concat([CAST(ascii(substr({text}, i, 1)) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295)"


def _tree_sql(name: str, leaves: str, tree: str, depth: int) -> str:
    """CTEs of a tree over ``leaves`` (tree, number, digest): levels, and each leaf's siblings and places, for ``FAN ** depth`` leaves at most."""
    out = f"{name}0 AS (SELECT {tree} AS tree, number, digest, count(*) OVER (PARTITION BY {tree}) AS held FROM {leaves})"
    for i in range(1, depth + 1):
        out += f""",
{name}{i} AS MATERIALIZED (SELECT tree, number, digest, count(*) OVER (PARTITION BY tree) AS held FROM (
  SELECT tree, number // {FAN} AS number, CASE WHEN any_value(held) > 1 THEN sha256(string_agg(digest, '' ORDER BY number)) ELSE any_value(digest) END AS digest FROM {name}{i - 1} GROUP BY ALL))"""
    out += f""",
{name}_paths AS MATERIALIZED (SELECT a.tree, a.number, list(struct_pack(level := level, before := before, after := after) ORDER BY level) AS path FROM {name}0 a JOIN ("""
    out += " UNION ALL ".join(
        f"SELECT {i} AS level, x.tree, x.number, coalesce(string_agg(y.digest, '' ORDER BY y.number) FILTER (y.number < x.number), '') AS before, "
        f"coalesce(string_agg(y.digest, '' ORDER BY y.number) FILTER (y.number > x.number), '') AS after FROM {name}{i} x JOIN {name}{i} y ON x.tree = y.tree AND x.number // {FAN} = y.number // {FAN} WHERE x.held > 1 GROUP BY ALL"
        for i in range(depth)
    )
    return out + f""") s ON s.tree = a.tree AND s.number = CASE s.level {" ".join(f"WHEN {i} THEN a.number // {FAN**i}" for i in range(depth))} END GROUP BY ALL)"""


def _field_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode(CAST({x} AS VARCHAR))) || ':' || CAST({x} AS VARCHAR) END"


_LEAF = " || ".join(_field_sql(c) for c in FIELDS)
_FOLD = "list_reduce(list_prepend({leaf}, list_transform({path}, lambda p: p.before || chr(1) || p.after)), lambda s, x: sha256(split_part(x, chr(1), 1) || s || split_part(x, chr(1), 2)))"
OP11_SQL = f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256({_LEAF}) AS digest,
  sha256({_LEAF.replace("text", f"translate(text, '{UPPER}', '{LOWER}')")}) AS other, {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 AS tampered FROM documents),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS number FROM d),
{_tree_sql("a", "n", "tree", 9)},
u AS MATERIALIZED (SELECT tree AS lang, row_number() OVER (ORDER BY encode(tree)) - 1 AS number, digest FROM a9),
{_tree_sql("b", "u", "''", 4)},
r AS (SELECT n.*, u.digest AS subroot, b4.digest AS root, list_concat(coalesce(s.path, []), coalesce(t.path, [])) AS path
  FROM n JOIN u ON u.lang = n.tree CROSS JOIN b4 LEFT JOIN a_paths s ON s.tree = n.tree AND s.number = n.number LEFT JOIN b_paths t ON t.number = u.number)
SELECT doc_id, digest AS leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda p: p.before || p.after), '')) AS proof_sha256,
  {_FOLD.format(leaf="CASE WHEN tampered THEN other ELSE digest END", path="path")} AS folded_root,
  {_FOLD.format(leaf="CASE WHEN tampered THEN other ELSE digest END", path="path")} = root AS verified FROM r
"""
