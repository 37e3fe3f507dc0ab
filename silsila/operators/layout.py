"""Positions of the drawn graph: a sunflower seed in each generation, and relaxation by springs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .chains import place

LAYER_GAP, SPRING = 58, 0.12
GOLDEN_ANGLE = 2.399963229728653


def seed(registry: DataFrame) -> DataFrame:
    """id, gen, x, y, z, height: even cover of a disc per generation, y by the place within all generations."""
    w = Window.partitionBy("gen")
    height = registry.agg((F.max("gen") * LAYER_GAP).alias("height"))
    n = registry.select("id", "gen", place(F.col("gen"), F.col("sub")).alias("p"), (F.row_number().over(w.orderBy("id")) - 1).alias("i"), F.count("*").over(w).alias("c")).join(F.broadcast(height))  # one row
    t = F.when(F.col("c") == 1, 0.0).otherwise(F.sqrt((F.col("i") + 0.5) / F.col("c"))) * (18 + F.sqrt("c") * 5)
    return n.select("id", "gen", (F.cos(F.col("i") * GOLDEN_ANGLE) * t).alias("x"), (F.col("height") / 2 - F.col("p") * LAYER_GAP).alias("y"), (F.sin(F.col("i") * GOLDEN_ANGLE) * t).alias("z"), "height")


def bands(positions: DataFrame) -> DataFrame:
    """gen, y, radius, n: how far each generation reaches."""
    return positions.groupBy("gen").agg((F.first("height") / 2 - F.col("gen") * LAYER_GAP).alias("y"), F.max(F.hypot("x", "z")).alias("radius"), F.count("*").alias("n"))


def relax(view: DataFrame, edges: DataFrame, sweeps: int = 220) -> DataFrame:
    """view, id, x, y, z after `sweeps` of weighted springs with cooling, for each view's own nodes and edges.

    view: view, id, x, y, z; edges: view, src, dst, weight. A drawn view is what one screen shows, so each is one task.
    """
    import numpy as np
    import pandas as pd

    def run(key, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("id").reset_index(drop=True)
        at = {x: k for k, x in enumerate(nodes["id"])}
        links = links[links["src"].isin(at) & links["dst"].isin(at)]
        a, b = links["src"].map(at).to_numpy(int), links["dst"].map(at).to_numpy(int)
        w = np.sqrt(links["weight"].to_numpy(float))
        p, home = nodes[["x", "z"]].to_numpy(float), np.hypot(nodes["x"], nodes["z"]).max() if len(nodes) else 1.0
        total = np.maximum(np.bincount(a, w, len(p)) + np.bincount(b, w, len(p)), 1e-9)
        for k in range(sweeps):
            pull = np.zeros_like(p)
            step = (p[b] - p[a]) * w[:, None]
            np.add.at(pull, a, step)
            np.add.at(pull, b, -step)
            p = p + SPRING * (1 - k / sweeps) * pull / total[:, None]
            r = np.hypot(p[:, 0], p[:, 1])
            p *= np.minimum(1, home / np.maximum(r, 1e-9))[:, None]
        return nodes.assign(x=p[:, 0], z=p[:, 1])[["view", "id", "x", "y", "z"]]

    return view.groupBy("view").cogroup(edges.groupBy("view")).applyInPandas(run, "view string, id string, x double, y double, z double")
