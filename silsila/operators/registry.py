"""The dimension of people: everyone on a path, described once for all collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.corpus import APEX


def describe(appearances: DataFrame, placed: DataFrame, people: DataFrame, tally: DataFrame, surfaces: DataFrame) -> DataFrame:
    """id, ar, grade, gen, src, sub, died, n, resolved, ambiguous, woman for each id of appearances (id, n).

    The apex and the collectors are described by what they are; others by their profile (people: id, name, grade, died,
    woman) or, without one, by their commonest surface form. A reading is ambiguous if it was uncertain more often
    than clear (tally: id, clear, uncertain).
    """
    joined = appearances.join(placed.select("id", "gen", "src", "sub"), "id", "left").join(people.select("id", "name", "grade", "died", "woman"), "id", "left").join(tally, "id", "left").join(surfaces.select("id", "surface"), "id", "left")
    apex, compiler = F.col("id") == APEX, F.col("id").startswith("collector:")
    known = F.col("name").isNotNull()
    kind = lambda a, c, k, u: F.when(apex, a).when(compiler, c).when(known, k).otherwise(u)
    return joined.select(
        "id",
        kind(F.lit(APEX), F.expr("substring(id, 11)"), F.col("name"), F.coalesce("surface", "id")).alias("ar"),
        kind(F.lit("companion"), F.lit("reliable"), F.col("grade"), F.lit("unknown")).alias("grade"),
        F.when(apex, 0).otherwise(F.col("gen")).alias("gen"),
        F.when(apex, "chains").otherwise(F.coalesce("src", F.lit("position"))).alias("src"),
        F.when(apex, 0.0).otherwise(F.coalesce("sub", F.lit(0.5))).alias("sub"),
        F.when(~apex & ~compiler, F.col("died")).alias("died"),
        "n",
        (apex | compiler | known).alias("resolved"),
        F.when(~apex & ~compiler & known, F.coalesce(F.col("uncertain") > F.col("clear"), F.lit(False))).otherwise(False).alias("ambiguous"),
        F.coalesce(~apex & ~compiler & F.col("woman"), F.lit(False)).alias("woman"),
    )


def totals(summary: DataFrame) -> DataFrame:
    """One row of sums over a summary of collections (slug, reports, chains)."""
    return summary.agg(F.count("*").alias("books"), F.sum("reports").alias("reports"), F.sum("chains").alias("chains"))
