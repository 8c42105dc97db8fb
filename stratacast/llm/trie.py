"""Prefix trie of conversations, by prefix doubling.

A turn's name is a dense number of its role and text.  In round ``k`` each aligned block of
``2 ** k`` turns gets a dense number of its two halves' names, so equal numbers are equal blocks; there
are as many rounds as the longest conversation has binary digits.  A prefix of ``d`` turns is the blocks of the binary digits
of ``d``, largest first, so its name is that short list; prefixes with one name are a
node.  Texts are hashed where they are read and not shuffled.

Sums over subtrees are sums over a node's members: a conversation's words after a turn are
a difference of two sums over its prefixes, and those of nodes that it stands for itself
(it is their least member) are counted once by leaving them out.  So no path of the trie is walked.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .merkle import crc32_sql
from .mixing import count_words
from .runtime import broadcast_if_small, read_table, written

GROUP, MOST_HEAD = 20, 4
#: Ids of one piece of a node's list.
PIECE = 4096
NOTHING = sha256(b"").hexdigest()


def head_length(conv: str = "conv_id"):
    """Turns that a conversation takes over from the first of its group of ``GROUP``."""
    return (F.crc32(F.col(conv).cast("string").cast("binary")) % MOST_HEAD).cast("long")


def turns_of(rows: DataFrame) -> DataFrame:
    """``(conv, at, digest, words)``: the turns of each conversation, numbered from 0 by turn (null first), equal turns by their digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    narrow = rows.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), count_words(text).alias("words"), F.monotonically_increasing_id().alias("row")
    )
    return written(numbered(narrow, ["turn", "digest", "row"], ["conv"], "at").select("conv", "at", "digest", "words"), "turns")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns ``(conv, at, digest, words)``, and ``(conv, length)`` of all of them, turnless ones too."""
    own = turns.groupBy("conv").agg(F.count("*").alias("n"))
    convs = own.select("conv", "n", head_length("conv").alias("head"), (F.col("conv") - F.col("conv") % GROUP).alias("base"))
    bases = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0))))
    convs = written(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("head"), F.lit(0))), "conversations")
    firsts = turns.filter((F.col("conv") % GROUP == 0) & (F.col("at") < MOST_HEAD - 1)).withColumnRenamed("conv", "base")
    heads = convs.select("conv", "base", "head").join(firsts, "base").filter("at < head").select("conv", "at", "digest", "words")
    tails = turns.join(convs.select("conv", "head", "taken"), "conv").filter("at >= head").withColumn("at", F.col("at") - F.col("head") + F.col("taken"))
    return written(heads.unionByName(tails.select("conv", "at", "digest", "words")), "rebuilt"), convs.select("conv", "length")


def named(rows: DataFrame, columns: list[str], name: str = "name", keep: list[str] | None = None) -> DataFrame:
    """``rows``, a written table, with a dense number of the values of ``columns`` in their place; those in ``keep`` stay."""
    names = written(numbered(rows.select(*columns).distinct(), columns, name=name), "names")
    return rows.join(broadcast_if_small(names), columns).drop(*(set(columns) - set(keep or [])))


def blocks_of(turns: DataFrame, longest: int) -> DataFrame:
    """``(k, conv, at, name, words)``: names and words of the aligned blocks of ``2 ** k`` turns; block ``at`` starts at turn ``at << k``."""
    level = written(named(turns.select("conv", "at", "digest", "words"), ["digest"]), "blocks")
    every, k = level.select(F.lit(0).alias("k"), "conv", "at", "name", "words"), 0
    while (1 << (k + 1)) <= longest:
        k += 1
        side = F.col("at") % 2 == 0
        halves = level.groupBy("conv", F.shiftright("at", 1).alias("at")).agg(
            F.max(F.when(side, F.col("name"))).alias("left"), F.max(F.when(~side, F.col("name"))).alias("right"), F.sum("words").alias("words")
        )
        halves = written(halves.filter("left is not null and right is not null"), "halves")
        level = written(named(halves, ["left", "right"]), "blocks")
        every = every.unionByName(level.select(F.lit(k).alias("k"), "conv", "at", "name", "words"))
    return every


def prefixes_of(blocks: DataFrame, lengths: DataFrame) -> DataFrame:
    """``(conv, depth, node, total, last)``: the prefixes of all conversations, the empty one too, with dense names of the nodes.

    ``total`` is the words of the whole prefix, ``last`` those of its last turn.  A block stands in
    the prefixes whose length has its digit, and the same digits above it.
    """
    ends = blocks.filter("k = 0").select("conv", (F.col("at") + 1).alias("depth"), F.lit(None).cast("long").alias("name"), F.lit(-1).alias("k"), F.lit(0).cast("long").alias("words"), F.col("words").alias("last"))
    width = F.expr("cast(shiftleft(cast(1 as bigint), k) as bigint)")
    held = blocks.filter("at % 2 = 0").join(lengths, "conv").withColumn("first", (F.col("at") + 1) * width)
    parts = held.select("conv", F.explode(F.sequence("first", F.least(F.col("first") + width - 1, "length"))).alias("depth"), "name", "k", "words", F.lit(0).cast("long").alias("last"))
    list_of = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") >= 0, F.struct((-F.col("k")).alias("k"), "name")))), lambda b: b["name"])  # an entry for each binary digit
    rows = parts.unionByName(ends).groupBy("conv", "depth").agg(list_of.alias("names"), F.sum("words").alias("total"), F.sum("last").alias("last"))
    none = lengths.select("conv", F.lit(0).cast("long").alias("depth"), F.array().cast("array<bigint>").alias("names"), F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("last"))
    prefixes = written(rows.unionByName(none), "prefixes")
    return written(named(prefixes, ["depth", "names"], "node", keep=["depth"]), "prefix_nodes")


def end_digests(ends: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` from ``(node, conv)``: SHA-256 of each node's ids, ascending, joined by commas.

    Ids are sorted in ranges of node and id, so a node with most of them is read by many tasks, which
    join pieces of ``PIECE`` ids; the pieces of a node are then fed to its digest one by one.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            texts = pc.cast(batch.column(1), pa.string()).to_pylist()
            cuts = [0, *(i for i in range(1, len(nodes)) if nodes[i] != nodes[i - 1]), len(nodes)]
            spans = [(i, min(i + PIECE, b)) for a, b in zip(cuts, cuts[1:], strict=False) for i in range(a, b, PIECE)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array([a for a, _ in spans], pa.int64())), batch.column(1).take(pa.array([a for a, _ in spans], pa.int64())), pa.array([",".join(texts[a:b]) for a, b in spans], pa.string())],
                names=["node", "first", "ids"],
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, done = None, None, []
        for batch in batches:
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                if n != node:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = n, sha256(ids.as_py().encode())
                else:
                    state.update(b"," + ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], names=["node", "ends_sha256"])
            done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    pieces = ends.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").mapInArrow(join, "node long, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digest, "node long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    The conversations are the rebuilt ones of ``rebuilt``; a node's ``conv_id`` is its least member.
    Turns are ordered by turn, null first; equal turns of one conversation by the SHA-256 of their role's
    length in bytes, role and text, so repeated rows are further turns.  A null role or text is an empty one; words are runs
    of anything but ASCII white space.  Rows with a null conversation id belong to no conversation and are left out.
    An empty table gives no row; other columns are ignored.
    """
    turns, lengths = rebuilt(turns_of(conversations))
    longest = lengths.agg(F.max("length")).first()[0] or 0
    rows = prefixes_of(blocks_of(turns, longest), lengths)
    nodes = written(rows.groupBy("node", "depth").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")), "node_members")
    # a conversation stands for its nodes from some depth to its end; the node above the first of these is of another one
    tops = nodes.groupBy(F.col("conv_id").alias("conv")).agg(F.min("depth").alias("top"))
    known = lengths.join(tops, "conv", "left").withColumn("cut", F.coalesce(F.col("top") - 1, "length"))
    known = written(known.join(rows.select("conv", F.col("depth").alias("cut"), F.col("total").alias("cut_total")), ["conv", "cut"], "left"), "known")
    above = nodes.join(rows.select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent")), ["conv_id", "depth"])
    above = written(above.select("node", "parent", "conv_id", "depth"), "parents")
    children = above.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    children = written(children, "children")
    leaves = nodes.join(children, "node", "left_anti").select(F.col("conv_id").alias("conv"), F.lit(1).alias("is_leaf"))  # a conversation stands for one leaf at most
    told = written(known.join(leaves, "conv", "left"), "told")
    spare = F.when(F.col("depth") <= F.col("cut"), F.col("cut_total") - F.col("total") + F.col("last")).otherwise(0)
    sums = rows.join(told, "conv").groupBy("node").agg(F.sum(spare).alias("saved_tokens"), F.sum(F.coalesce("is_leaf", F.lit(0))).alias("n_leaves"))
    ends = end_digests(rows.join(lengths, (rows["conv"] == lengths["conv"]) & (rows["depth"] == lengths["length"])).select("node", rows["conv"]))
    # within a conversation's own nodes the parent is its own; only the first needs a look at another's node
    least = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parents = above.join(least, "parent").select("node", "parent_conv_id")
    out = nodes.join(parents, "node", "left").join(children, "node", "left").join(sums, "node").join(ends, "node", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"),
        F.col("saved_tokens").cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def op12_trie(spark, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


OP12_SQL = f"""
WITH t AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % {MOST_HEAD} AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS MATERIALIZED (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base WHERE pos < h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos >= h),
s AS (SELECT conv_id, list(sha256(octet_length(encode(role)) || ':' || role || text) ORDER BY part, pos) AS turns,
  list(CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) ORDER BY part, pos) AS words FROM r GROUP BY 1),
p AS MATERIALIZED (
  SELECT conv_id, d, sha256(array_to_string(list_slice(turns, 1, d), ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(list_slice(turns, 1, d - 1), ',')) END AS parent,
    CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, d = len(turns) AS ended
  FROM (SELECT conv_id, coalesce(turns, []) AS turns, words, unnest(range(0, coalesce(len(turns), 0) + 1)) AS d FROM c LEFT JOIN s USING (conv_id))),
n AS MATERIALIZED (
  SELECT d, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ended), '')) AS ends FROM p GROUP BY d, node),
k AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, node)),
below AS (SELECT p.d, p.node, sum(m.saved) AS saved_tokens, count(*) FILTER (m.n_children = 0) AS n_leaves FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends AS ends_sha256
FROM m LEFT JOIN n q ON q.d = m.d - 1 AND q.node = m.parent JOIN below b ON b.d = m.d AND b.node = m.node
"""
