"""Mixing sources to target weights: block quotas dealt down a splitting tree.

Every source's documents are hashed into blocks. A source's target asks for whole passes over its blocks and one
part pass, so its quota of block draws is exact. All draws stand at the root of a binary tree; each node deals its
draws to its two children without replacement in a seeded random order, half each, so the counts of each source at
a child follow the multivariate hypergeometric law. The leaves are the output shards. Inside a shard, rows are
ordered by a seeded hash (the local shuffle). Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise

BLOCKS = 256
WEIGHTS = (5, 2, 1)
MOST = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, source_size): adds weight and target.

    Sources in code point order, null last, take the weights in turn. A target is the source's weighted share of all
    sizes, at most `most` times the source's size; what a capped source cannot take is shared again by weight. That is
    one level lam with target = min(most * size, lam * weight): walking the sources by most * size / weight, a source
    is capped while its cap is below the share that those after and including it would get. One row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights)).cast("double")
    ranked = sizes.withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").asc_nulls_last())
    before, all_ = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    walked = ranked.select(
        "*",
        F.row_number().over(by_cap).alias("at"),
        ((F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))).alias("lam"),
    ).withColumn("capped", F.col("cap") <= F.col("lam") * F.col("weight"))
    level = F.min(F.when(~F.col("capped"), F.struct("at", "lam"))).over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return walked.withColumn("level", level).select("source", "source_size", "weight", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level.lam") * F.col("weight")).alias("target"))


def deal(draws: DataFrame, shards_log2: int, seed: int) -> DataFrame:
    """Send every draw (source, block, pass) down the tree: at each node the first half of a seeded order goes left.

    The draws are blocks x passes of each source, bounded by the sources and not by the rows of the corpus.
    """
    out = draws.withColumn("node", F.lit(0))
    for level in range(shards_log2):
        order = [F.xxhash64(F.lit(seed), F.lit(level), "source", "block", "pass"), F.col("source"), F.col("block"), F.col("pass")]
        at = Window.partitionBy("node").orderBy(*order)
        # Which child gets the odd draw alternates with the node, so no shard collects all of them.
        left = F.expr("cast(floor((n + node % 2) / 2) as int)")
        out = out.withColumn("rn", F.row_number().over(at)).withColumn("n", F.count("*").over(Window.partitionBy("node"))).withColumn("node", F.col("node") * 2 + F.when(F.col("rn") <= left, 0).otherwise(1)).drop("rn", "n")
    return out.withColumnRenamed("node", "shard")


def plan_mix(docs: DataFrame, shards_log2: int = 4, seed: int = 7, blocks: int = BLOCKS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: row (a struct of the carried columns), source, size, source_size, target, draws.

    draws is an array of (pass, shard, place), one entry per copy of the document that the mix takes, with its output
    shard and its place there (sort by it for the local shuffle). A null text has size 0; a null source is a source of
    its own, last in order; repeated rows are drawn separately; an empty table gives no rows; documents of size 0 come
    with whole passes; names of carried columns cannot clash with those used here. The key hashes id and text, so
    reruns agree whatever the partitioning. A hot source is split over its blocks.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")
    keyed = docs.select(row, F.col("source"), n_words(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("key")).withColumn("block", F.pmod("key", F.lit(blocks)).cast("int"))
    if set(carry) <= {"doc_id"}:
        keyed = materialise(keyed, "mix-keyed")
    per_block = materialise(keyed.groupBy("source", "block").agg(F.sum("size").alias("block_size")), "mix-blocks")
    aim = targets(per_block.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, most)
    aim = aim.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    aim = aim.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    aim = aim.withColumnRenamed("source", "a_source")
    laid = per_block.join(aim, F.col("source").eqNullSafe(F.col("a_source"))).drop("a_source")
    order = Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block"), "block").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("from", F.coalesce(F.sum("block_size").over(order), F.lit(0)))
    # Of the part pass: 1 a whole block, 0 no part of it, null the block in which it ends.
    edge = F.when(F.col("from") + F.col("block_size") <= F.col("rest"), 1).when(F.col("from") >= F.col("rest"), 0)
    laid = materialise(laid.withColumn("edge", edge), "mix-laid")
    n_copies = F.col("passes") + F.coalesce("edge", F.lit(1))
    copies = F.when(n_copies > 0, F.sequence(F.lit(0), n_copies - 1)).otherwise(F.array().cast("array<int>"))
    dealt = deal(laid.select("source", "block", F.explode(copies).alias("pass")), shards_log2, seed + 2)
    per_draw = dealt.groupBy(F.col("source").alias("d_source"), F.col("block").alias("d_block")).agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))
    same = F.col("source").eqNullSafe(F.col("d_source")) & (F.col("block") == F.col("d_block"))
    plan = laid.join(per_draw, same, "left").select(F.col("source").alias("p_source"), F.col("block").alias("p_block"), "source_size", "target", "passes", "rest", "from", "edge", F.coalesce("dealt", F.array().cast("array<struct<pass:int,shard:int>>")).alias("dealt"))
    plan = materialise(plan, "mix-plan")
    both = keyed.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("p_block")))
    cols = ["row", "source", "size", "key", "source_size", "target", "dealt"]
    whole = both.filter(F.col("edge").isNotNull()).select(*cols, (F.col("passes") + F.col("edge")).alias("times"))
    # The blocks in which a part pass ends, one of each source: a document comes if half of it lies before the end.
    inside = Window.partitionBy("p_source", "p_block").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    cut = both.filter(F.col("edge").isNull()).withColumn("start", F.col("from") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    cut = cut.select(*cols, (F.col("passes") + F.when(2 * F.col("start") + F.col("size") <= 2 * F.col("rest"), 1).otherwise(0)).alias("times"))
    placed = F.transform(F.slice("dealt", F.lit(1), F.col("times")), lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.xxhash64(F.lit(seed + 3), d["pass"], F.col("key")).alias("place")))
    return whole.unionByName(cut).select("row", "source", "size", "source_size", "target", placed.alias("draws"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document once per draw, with the columns of docs; mix_* columns tell pass, shard and place.

    mix_* columns of the input are replaced. Handles nulls, repeats and empty tables as plan_mix does.
    """
    names = [c for c in docs.columns if c not in ("mix_pass", "mix_shard", "mix_place")]
    drawn = plan_mix(docs, carry=tuple(names), **options).select("row", F.explode("draws").alias("draw"))
    return drawn.select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.col("draw.pass").alias("mix_pass"), F.col("draw.shard").alias("mix_shard"), F.col("draw.place").alias("mix_place"))


def resample(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all their columns as they are, each as often as the mix draws it.

    A null text has size 0 and comes with whole passes; repeated rows are drawn separately; no rows give none.
    """
    drawn = plan_mix(docs, carry=tuple(docs.columns), **options).select("row", F.explode("draws"))
    return drawn.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
