"""Finding a half-remembered name across scripts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

MIN_QUERY, MIN_BONES, TOP = 2, 2, 8


def search(people: DataFrame, query: str, top: int = TOP) -> DataFrame:
    """id, rank, score for the best matches among id, ar, en, n, pos.

    Ranks: the whole name, its start, inside it; then the same on consonants, if the query has enough of them. The
    weight of a name in chains leads and the rank is a penalty.
    """
    q = people.sparkSession.range(1).select(text.fold_name(F.lit(query)).alias("f")).select("f", text.skeleton(F.col("f")).alias("b")).first()
    if len(q.f) < MIN_QUERY:
        return people.limit(0).select("id", F.lit(0).alias("rank"), F.lit(0.0).alias("score"))
    folded = people.select("id", "n", "pos", text.fold_name(F.coalesce("ar", F.lit(""))).alias("a"), text.fold_name(F.coalesce("en", F.lit(""))).alias("e"))
    c = folded.withColumn("b", text.skeleton(F.col("a")))
    either = lambda test: test(F.col("a")) | test(F.col("e"))
    rank = F.when(either(lambda x: x == q.f), 0).when(either(lambda x: x.startswith(q.f)), 1).when(either(lambda x: x.contains(q.f)), 2)
    if len(q.b) >= MIN_BONES and len("".join(q.f.split())) >= 4:
        rank = rank.when(F.col("b") == q.b, 3).when(F.col("b").startswith(q.b), 4).when(F.col("b").contains(q.b), 5)
    found = c.withColumn("rank", rank).filter("rank is not null").withColumn("score", text.score_name(F.col("rank"), F.col("n")))
    return found.orderBy(F.col("score").desc(), "pos").limit(top).select("id", "rank", "score")
