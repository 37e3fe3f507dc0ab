"""Chains to steps to the weighted graph, kinds of reports, facets and selections. All native array and join work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..sources.corpus import APEX, collector

#: How far a place within a generation reaches, and how near two places count as the same age.
SPREAD, SAME_AGE = 0.66, 0.02
#: A chain of so many links or fewer is short.
SHORT_CHAIN = 3
KIND_GROUPS = {"ruling": ["sahih", "hasan", "daif", "munkar", "mawdu"], "chain": ["backward", "peer", "high", "unreached"], "who": ["women"]}
KINDS = [k for g in KIND_GROUPS.values() for k in g]


def path(to_apex: Column, names_apex: Column, chain: Column, gaps: Column, slug: Column) -> Column:
    """The steps of a chain as array<struct<at, src, dst, gap>>; none of an empty chain.

    The step from the apex is there if the chain reaches it, or as a gap if the text only names it.
    """
    step = lambda at, src, dst, gap: F.struct(at.cast("int").alias("at"), src.alias("src"), dst.alias("dst"), gap.alias("gap"))
    n = F.size(chain)
    none = F.array().cast("array<struct<at:int,src:string,dst:string,gap:boolean>>")
    head = F.when(to_apex | names_apex, F.array(step(F.lit(0), F.lit(APEX), F.get(chain, F.lit(0)), ~to_apex))).otherwise(none)
    inner = F.transform(F.slice(chain, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda x, i: step(i + 1, x, F.get(chain, i + 1), F.array_contains(gaps, i)))
    tail = F.array(step(n, F.get(chain, n - 1), collector(slug), F.lit(False)))
    return F.when(n > 0, F.concat(head, inner, tail)).otherwise(none)


def with_path(reports: DataFrame) -> DataFrame:
    return reports.withColumn("path", path(*map(F.col, ("to_apex", "names_apex", "chain", "gaps", "slug"))))


def steps(reports: DataFrame) -> DataFrame:
    """id, at, src, dst, gap: one row a step."""
    return with_path(reports).select("id", F.explode("path").alias("p")).select("id", "p.*")


def nodes(reports: DataFrame) -> DataFrame:
    """id, weight: transmitters (apex and collectors too) with the number of reports through them."""
    p = with_path(reports).filter(F.size("chain") > 0)
    members = F.array_distinct(F.concat(F.array(F.get("path", F.lit(0))["src"]), F.transform("path", lambda s: s["dst"])))
    return p.select(F.explode(members).alias("node")).groupBy("node").agg(F.count("*").alias("weight"))


def edges(reports: DataFrame) -> DataFrame:
    """src, dst, weight, gap: occurrences of each step between two different ends; gap only if every occurrence is one."""
    return steps(reports).filter("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"), F.every("gap").alias("gap"))


def place(gen: Column, sub: Column) -> Column:
    return gen + SPREAD * F.coalesce(sub, F.lit(0.5))


def typed_edges(reports: DataFrame, registry: DataFrame) -> DataFrame:
    """edges with kind: peer, backward or forward by the difference of the ends' places, in single precision."""
    at = registry.select("id", place(F.col("gen"), F.col("sub")).cast("float").alias("place"))
    e = edges(reports).join(at.select(F.col("id").alias("src"), F.col("place").alias("a")), "src", "left").join(at.select(F.col("id").alias("dst"), F.col("place").alias("b")), "dst", "left")
    drop = F.col("b").cast("double") - F.col("a").cast("double")
    return e.select("src", "dst", "weight", "gap", F.when(F.abs(drop) <= SAME_AGE, "peer").when(drop < 0, "backward").otherwise("forward").alias("kind"))


def neighbours(reports: DataFrame, of: str) -> DataFrame:
    """other: everyone one step from a transmitter, in either direction."""
    e = edges(reports)
    return e.filter(F.col("src") == of).select(F.col("dst").alias("other")).union(e.filter(F.col("dst") == of).select("src")).distinct()


def passes_through(through: list[str], chain: Column, slug: Column) -> Column:
    """Whether a chain passes all of the transmitters; the apex and the report's own collector always count as passed."""
    wanted = F.array_except(F.array(*map(F.lit, through)) if through else F.array().cast("array<string>"), F.array(F.lit(APEX), collector(slug)))
    return F.forall(wanted, lambda x: F.array_contains(chain, x))


def kinds(reports: DataFrame, registry: DataFrame) -> DataFrame:
    """reports with kinds: rulings, unreached, women, and for those with a chain high, backward, peer."""
    at = registry.select("id", "woman", place(F.col("gen").cast("double"), F.col("sub")).alias("place"))
    walked = steps(reports).join(at.select(F.col("id").alias("src"), F.col("place").alias("a")), "src", "left").join(at.select(F.col("id").alias("dst"), F.col("place").alias("b"), "woman"), "dst", "left")
    drop = F.col("b") - F.col("a")
    per = walked.groupBy("id").agg(F.coalesce(F.bool_or((F.abs(drop) > SAME_AGE) & (drop < 0)), F.lit(False)).alias("backward"), F.coalesce(F.bool_or(F.abs(drop) <= SAME_AGE), F.lit(False)).alias("peer"))
    women = reports.select("id", F.explode("chain").alias("dst")).join(at.filter("woman").select(F.col("id").alias("dst")), "dst", "left_semi").select("id").distinct().withColumn("women", F.lit(True))
    joined = reports.join(per, "id", "left").join(women, "id", "left")
    has = F.size("chain") > 0
    shape = F.array_compact(F.array(F.when(~F.col("to_apex"), "unreached"), F.when(F.col("women"), "women"), F.when(has & (F.size("chain") <= SHORT_CHAIN), "high"), F.when(has & F.col("backward"), "backward"), F.when(has & F.col("peer"), "peer")))
    return joined.withColumn("kinds", F.concat(text.rulings(F.col("grade")), shape)).drop("backward", "peer", "women")


def matches_kinds(chosen: list[str], kinds: Column) -> Column:
    """Any choice inside a group, every group with a choice; nothing chosen matches all."""
    out = F.lit(True)
    for group in KIND_GROUPS.values():
        if wanted := [k for k in group if k in chosen]:
            out = out & F.arrays_overlap(kinds, F.array(*map(F.lit, wanted)))
    return out


def facets(with_kinds: DataFrame, chosen: list[str]) -> DataFrame:
    """kind, n: the reports that would be left if the kind were chosen too; one pass over the reports."""
    counts = with_kinds.agg(*[F.count_if(matches_kinds([*chosen, k], F.col("kinds"))).alias(k) for k in KINDS])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in KINDS])).alias("x")).select("x.*")


def percentile_floor(values: Column, q: float) -> Column:
    """The sorted array's element at floor(n * q): neither the discrete nor the continuous percentile of SQL."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(values) * q).cast("int"))


def percentile_by(df: DataFrame, key: str, value: str, q: float, least: int = 1) -> DataFrame:
    """key, p: percentile_floor of value for each key with `least` rows or more.

    Works on counts of distinct values, so a key that is in every row (the apex) gathers a histogram and not its rows.
    """
    from pyspark.sql import Window

    counts = df.groupBy(key, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(key)
    run = counts.withColumn("_to", F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    return run.filter((F.col("_all") >= least) & (F.col("_to") > F.floor(F.col("_all") * q))).groupBy(key).agg(F.min(value).alias("p"))
