"""Which generation everybody belongs to: chain depth, classes, neighbours, positions, dates, then rank by age.

Sweeps read the state of the sweep before (all updates at once), so the result does not depend on row order; each
sweep ends in a reliable checkpoint. Frames are keyed by transmitter; the small per-generation tables are windows over
a dozen rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.corpus import APEX, collector
from ..sources.store import materialise
from .chains import percentile_by, percentile_floor

MIN_ANCHORED, MIN_SAMPLES, MIN_DATED = 3, 5, 20
SHORT_END, LATE_END = 0.1, 0.9
CLASSES, SWEEPS = 12, 4


def depths(reports: DataFrame) -> DataFrame:
    """report, id, depth, anchored: every place on every non-empty path, the apex first and the collector last."""
    whole = F.concat(F.array(F.lit(APEX)), F.col("chain"), F.array(collector(F.col("slug"))))
    return reports.filter(F.size("chain") > 0).select(F.col("id").alias("report"), F.col("to_apex").alias("anchored"), F.posexplode(whole).alias("depth", "id"))


def from_chains(depth: DataFrame) -> DataFrame:
    """id, gen: the short end of the anchored depths of those with enough of them."""
    return percentile_by(depth.filter("anchored"), "id", "depth", SHORT_END, MIN_ANCHORED).withColumnRenamed("p", "gen")


def calibration(chains: DataFrame, people: DataFrame) -> DataFrame:
    """tabaqa 1-12, cal: the median generation of a class with enough samples; others borrow; never falling."""
    spark = chains.sparkSession
    v = percentile_by(chains.join(people.filter("tabaqa is not null").select("id", "tabaqa"), "id"), "tabaqa", "gen", 0.5, MIN_SAMPLES).withColumnRenamed("p", "v")
    order = Window.orderBy("tabaqa").rowsBetween(Window.unboundedPreceding, 0)
    return spark.range(1, CLASSES + 1).select(F.col("id").cast("int").alias("tabaqa")).join(v, "tabaqa", "left").select("tabaqa", F.greatest(F.lit(1), F.max("v").over(order)).cast("int").alias("cal"))


def with_classes(chains: DataFrame, people: DataFrame, cal: DataFrame) -> DataFrame:
    """id, gen, src: a class is a floor under what the chains say, and places those whom they do not."""
    floor = F.when(F.col("tabaqa") == 1, 1).otherwise(2)
    t = people.filter("tabaqa is not null").join(cal, "tabaqa").select("id", F.greatest("cal", floor).alias("value"))
    both = chains.join(t, "id", "full_outer")
    raised = F.col("gen").isNull() | (F.col("value") > F.col("gen"))
    return both.select("id", F.when(F.col("value").isNotNull() & raised, F.col("value")).otherwise(F.col("gen")).alias("gen"), F.when(F.col("value").isNotNull() & raised, "tabaqa").otherwise("chains").alias("src"))


def adjacency(depth: DataFrame) -> DataFrame:
    """earlier, later: distinct neighbours on a path, the earlier one nearer the apex."""
    a, b = depth.select("report", "id", "depth"), depth.select("report", F.col("id").alias("later"), (F.col("depth") - 1).alias("depth"))
    return a.withColumnRenamed("id", "earlier").join(b, ["report", "depth"]).filter("earlier <> later").select("earlier", "later").distinct()


def infer(placed: DataFrame, depth: DataFrame) -> DataFrame:
    """Place the rest between their neighbours: a generation behind those before them, one ahead of those after."""
    ids, near = depth.select("id").distinct(), materialise(adjacency(depth), "gen-near")
    placed = materialise(placed, "gen-placed")
    for _ in range(SWEEPS):
        todo = ids.join(placed, "id", "left_anti")
        up = near.join(placed.select(F.col("id").alias("earlier"), "gen"), "earlier").select(F.col("later").alias("id"), (F.col("gen") + 1).alias("implied"))
        down = near.join(placed.select(F.col("id").alias("later"), "gen"), "later").select(F.col("earlier").alias("id"), (F.col("gen") - 1).alias("implied"))
        new = percentile_by(todo.join(up.unionByName(down), "id"), "id", "implied", 0.5).select("id", F.greatest(F.lit(1), F.col("p")).alias("gen"), F.lit("inferred").alias("src"))
        new = materialise(new, "gen-sweep")
        if new.isEmpty():
            break
        placed = placed.unionByName(new)
    return placed


def by_position(placed: DataFrame, depth: DataFrame) -> DataFrame:
    rest = percentile_by(depth.join(placed, "id", "left_anti"), "id", "depth", SHORT_END).select("id", F.greatest(F.lit(1), F.col("p")).alias("gen"), F.lit("position").alias("src"))
    return placed.unionByName(rest)


def landmarks(placed: DataFrame, people: DataFrame) -> DataFrame:
    """gen, closes: the late end of the death years of those whom chains placed, never falling."""
    dated = placed.filter("src = 'chains'").join(people.filter("died is not null").select("id", "died"), "id")
    per = percentile_by(dated, "gen", "died", LATE_END, MIN_DATED).withColumnRenamed("p", "late")
    return per.select("gen", F.max("late").over(Window.orderBy("gen").rowsBetween(Window.unboundedPreceding, 0)).alias("closes"))


def by_dates(placed: DataFrame, people: DataFrame, marks: DataFrame) -> DataFrame:
    """Move down those who outlived their generation by a whole span; beyond all landmarks lies the late band."""
    gaps = marks.select((F.col("closes") - F.lag("closes").over(Window.orderBy("gen"))).alias("gap")).filter("gap is not null").agg(F.collect_list("gap").alias("g"))
    span = gaps.select(F.coalesce(F.when(F.size("g") > 0, percentile_floor(F.col("g"), 0.5)), F.lit(0)).alias("span"))
    facts = marks.agg(F.array_sort(F.collect_list(F.struct("gen", "closes"))).alias("marks")).crossJoin(span).crossJoin(placed.agg((F.max("gen") + 1).alias("late")))
    first = F.get(F.filter("marks", lambda m: F.col("died") <= m["closes"] + F.col("span")), F.lit(0))["gen"]
    joined = placed.join(people.select("id", "died"), "id", "left").crossJoin(F.broadcast(facts))  # one row
    moved = F.col("died").isNotNull() & (F.col("span") > 0) & (F.coalesce(first, F.col("late")) > F.col("gen"))
    return joined.select("id", F.when(moved, F.coalesce(first, F.col("late"))).otherwise(F.col("gen")).alias("gen"), F.when(moved, "dates").otherwise(F.col("src")).alias("src"))


def rank_in_generation(placed: DataFrame, people: DataFrame) -> DataFrame:
    """Adds sub: place by death year among the dated of a generation, from 0 to 1; a half for the undated and the only one."""
    dated = placed.join(people.filter("died is not null").select("id", "died"), "id")
    w = Window.partitionBy("gen")
    ranked = dated.select("id", F.when(F.count("*").over(w) == 1, 0.5).otherwise((F.row_number().over(w.orderBy("died", "id")) - 1) / (F.count("*").over(w) - 1)).alias("sub"))
    return placed.join(ranked, "id", "left").withColumn("sub", F.coalesce("sub", F.lit(0.5)))


def assign(reports: DataFrame, people: DataFrame) -> DataFrame:
    """id, gen, src, sub for everyone on a path or with a class; the apex stands at 0."""
    depth = materialise(depths(reports), "gen-depths")
    chains = materialise(from_chains(depth), "gen-chains")
    placed = with_classes(chains, people, calibration(chains, people))
    placed = materialise(by_position(infer(placed, depth), depth), "gen-placed")
    placed = rank_in_generation(materialise(by_dates(placed, people, landmarks(placed, people)), "gen-dated"), people)
    at_apex = F.col("id") == APEX
    return placed.select("id", F.when(at_apex, 0).otherwise(F.col("gen")).cast("int").alias("gen"), F.when(at_apex, "chains").otherwise(F.col("src")).alias("src"), "sub")
