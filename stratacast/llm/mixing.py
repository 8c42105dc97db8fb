"""Temperature mixing of sources, realised as budgeted block permutations.

A source's weight is its token share to the power ``a``, normalised.  The
exponent is bisected: the largest one whose weights reach the target entropy,
raised as far as needed for no source to be repeated more often than allowed.

A source's documents form a stream: epoch after epoch, each in an order of its
own.  A source's budget, its weight's share of all tokens, is rounded once and
dealt evenly over the blocks, so the weights hold whatever the number of blocks: a
document's block is its start in the stream times the blocks, divided by the budget.
Starts are prefix sums over ``BUCKETS`` hash buckets of each source and epoch, so that no
source, however large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import checkpointed, read_table, written

#: The exponent is a multiple of one part in so many.
STEPS = 1 << 30
FAN = 64
TARGET_ENTROPY, MAX_REPEATS, BLOCK_TOKENS = 0.95, 4.0, 1_000_000


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def order_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"))


def bisect(shares: DataFrame, budget_over_total: float, target: float, repeats: float) -> int:
    """The exponent, in ``1 / STEPS``, for ``shares`` (column ``p``, positive, summing to 1).

    ``FAN`` exponents are tried in one aggregation, so a few rounds do.
    """

    def figures(grid: list[int]) -> list[tuple[int, float, float]]:
        rows = (
            shares.select("p", F.explode(F.array([F.lit(i) for i in grid])).alias("i"))
            .withColumn("x", F.pow("p", F.col("i") / float(STEPS)))
            .groupBy("i")
            .agg(F.sum("x").alias("z"), F.sum(F.col("x") * F.log("p")).alias("e"), F.max(F.col("x") / F.col("p")).alias("r"), F.count("*").alias("n"))
            .select("i", (F.log("z") - F.col("i") / float(STEPS) * F.col("e") / F.col("z") - target * F.log(F.col("n").cast("double"))).alias("spare"), (F.col("r") / F.col("z") * budget_over_total).alias("most"))
            .orderBy("i")
        )
        return [tuple(r) for r in rows.collect()]

    def last(holds) -> int:
        """The largest step at which ``holds``, which is true at 0 and then false from some step on."""
        low, high = 0, STEPS + 1
        while high - low > 1:
            grid = sorted({low + (high - low) * j // FAN for j in range(1, FAN)} - {low, high})
            for i, spare, most in figures(grid):
                if holds(spare, most):
                    low = max(low, i)
                else:
                    high = min(high, i)
                    break
        return low

    if shares.isEmpty():
        return STEPS
    by_entropy = last(lambda spare, most: spare >= -1e-12)
    most_now = figures([by_entropy])[0][2]
    if most_now <= repeats + 1e-12:
        return by_entropy
    return min(STEPS, last(lambda spare, most: most > repeats + 1e-12) + 1)


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    target_entropy: float = TARGET_ENTROPY,
    max_repeats: float = MAX_REPEATS,
    seed: int = 17,
) -> DataFrame:
    """The mix: ``doc_id, source, n_tokens, epoch, block, position``, a row per use of a document.

    Tokens are words.  ``budget`` (default: the corpus's tokens, never more than
    ``max_repeats`` times those) is dealt in blocks of about ``block_tokens``;
    ``target_entropy`` is a share of the largest entropy that the sources allow.
    A document is used in an epoch if its start lies within the source's budget;
    ``position`` is its place, from 1, in the block's permutation.  A null source
    counts as the source ``''``; documents without words take no tokens and follow
    the order like others, but a source without any word has no share and no rows.
    Repeated rows are documents of their own; an empty table gives an empty mix.
    """
    base = checkpointed(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
            count_words(F.col(text_col).cast("string")).alias("n_tokens"),
            F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")).alias("code"),  # spreads rows of one id, or none
        )
    )
    sources = checkpointed(base.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).filter("tokens > 0"))
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    budget = min(budget or total, int(max_repeats * total))
    blocks = max(1, -(-budget // block_tokens))
    shares = sources.select("source", "tokens", (F.col("tokens") / F.lit(float(max(total, 1)))).alias("p"))
    exponent = bisect(shares, budget / max(total, 1), target_entropy, max_repeats) / STEPS
    norm = shares.agg(F.sum(F.pow("p", F.lit(exponent)))).first()[0] or 1.0
    exact = F.greatest(F.lit(1), F.floor(F.round(F.pow("p", F.lit(exponent)) / F.lit(norm) * F.lit(float(budget)), 6))).cast("long")
    most = F.greatest(F.lit(1), F.floor(F.col("tokens") * F.lit(float(max_repeats)))).cast("long")
    quotas = shares.select("source", "tokens", F.least(exact, most).alias("quota"))
    quotas = quotas.withColumn("epochs", F.ceil(F.col("quota") / F.col("tokens").cast("double")).cast("int"))
    quotas = written(quotas, "quotas")

    uses = (
        base.join(quotas, "source")
        .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
        .withColumn("key", order_key(F.col("doc_id"), F.col("epoch"), F.lit(seed), F.col("code")))
        .withColumn("bucket", F.substring("key", 1, 3))
    )
    in_bucket = Window.partitionBy("source", "epoch", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source", "epoch").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = uses.groupBy("source", "epoch", "bucket").agg(F.sum("n_tokens").alias("held"))
    offsets = sums.select("source", "epoch", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("offset"))
    placed = (
        uses.withColumn("inside", F.coalesce(F.sum("n_tokens").over(in_bucket), F.lit(0)))
        .join(offsets, ["source", "epoch", "bucket"])
        .withColumn("start", F.col("epoch") * F.col("tokens") + F.col("offset") + F.col("inside"))
        .filter(F.col("start") < F.col("quota"))
        .withColumn("block", F.expr(f"cast(start as decimal(19, 0)) * cast({blocks} as decimal(18, 0)) div quota"))
    )
    in_block = Window.partitionBy("block").orderBy(order_key(F.col("doc_id"), F.col("epoch"), F.col("block"), F.col("code")), "doc_id", "source")
    return placed.select(
        "doc_id", "source", "n_tokens", F.col("epoch").cast("long").alias("epoch"), "block", F.row_number().over(in_block).cast("long").alias("position")
    )


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """The mix of all documents by source."""
    return mix_sources(read_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE base AS (
  SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens, md5(coalesce(text, '')) AS code FROM documents),
src AS (SELECT source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM base GROUP BY 1 HAVING sum(n_tokens) > 0),
tot AS (SELECT CAST(sum(tokens) AS BIGINT) AS t, count(*) AS n FROM src),
par AS (SELECT t AS budget, greatest(1, (t + 999999) // 1000000) AS blocks, n FROM tot),
shares AS (SELECT source, tokens, tokens / CAST(t AS DOUBLE) AS p FROM src, tot),
by_entropy(low, high) AS (
  SELECT 0::BIGINT, 1073741825::BIGINT
  UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END
  FROM (SELECT low, high, mid, (SELECT ln(sum(p ** (mid / 1073741824.0::DOUBLE))) - mid / 1073741824.0::DOUBLE * sum(p ** (mid / 1073741824.0::DOUBLE) * ln(p)) / sum(p ** (mid / 1073741824.0::DOUBLE)) - 0.95 * ln(count(*)) >= -1e-12 FROM shares) AS ok
        FROM (SELECT low, high, (low + high) // 2 AS mid FROM by_entropy WHERE high - low > 1))),
by_repeats(low, high) AS (
  SELECT 0::BIGINT, 1073741825::BIGINT
  UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END
  FROM (SELECT low, high, mid, (SELECT max(p ** (mid / 1073741824.0::DOUBLE) / p) / sum(p ** (mid / 1073741824.0::DOUBLE)) > 4.0 + 1e-12 FROM shares) AS ok
        FROM (SELECT low, high, (low + high) // 2 AS mid FROM by_repeats WHERE high - low > 1))),
start AS (SELECT max(low) AS i FROM by_entropy),
expo AS (
  SELECT (CASE WHEN (SELECT max(p ** (i / 1073741824.0::DOUBLE) / p) / sum(p ** (i / 1073741824.0::DOUBLE)) FROM shares) <= 4.0 + 1e-12 THEN i
          ELSE least(1073741824, (SELECT max(low) FROM by_repeats) + 1) END) / 1073741824.0::DOUBLE AS a FROM start),
norm AS (SELECT sum(p ** a) AS z FROM shares, expo),
quotas AS (
  SELECT source, tokens, blocks, least(greatest(1, CAST(floor(round(p ** a / z * CAST(budget AS DOUBLE), 6)) AS BIGINT)),
                                       greatest(1, CAST(floor(tokens * 4.0::DOUBLE) AS BIGINT))) AS quota
  FROM shares, expo, norm, par),
uses AS (
  SELECT doc_id, source, n_tokens, tokens, quota, blocks, epoch, code,
         md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(epoch AS VARCHAR), '17', code)) AS key
  FROM (SELECT *, unnest(range(0, CAST(ceil(quota / CAST(tokens AS DOUBLE)) AS BIGINT))) AS epoch FROM base JOIN quotas USING (source))),
placed AS (
  SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY key, doc_id
                                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM uses)
SELECT doc_id, source, n_tokens, epoch, block,
       row_number() OVER (PARTITION BY block ORDER BY md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(epoch AS VARCHAR), CAST(block AS VARCHAR), code)), doc_id, source) AS position
FROM (SELECT *, CAST(CAST(start AS HUGEINT) * blocks // quota AS BIGINT) AS block FROM placed WHERE start < quota)
"""
