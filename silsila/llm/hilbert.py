"""Approximate nearest neighbours by inner product over several shifted Hilbert orderings.

Equal vectors are one entry with the smallest ids of its rows. Entries are projected to a few dimensions by seeded
random rotations, shifted, and sorted by their place on a Hilbert curve; Spark range-partitions each ordering. The
sorted entries are numbered and cut into tiles, and each query is sent to all tiles that its window on either side
touches. Each tile reranks its queries by exact inner products, and the best of all orderings are merged.

How wide the window must be depends on the table: the true neighbours of SAMPLE queries are found by comparing them
with every entry, and the window grows from MARGIN until TARGET of them lie inside, up to the whole table. Tiles grow
with the window as far as TILE_NUMBERS allows; beyond that a query is sent to more tiles, so a task's memory is bounded.

Neighbours by inner product are found among vectors with one more coordinate, sqrt(longest**2 - length**2), which
turns the largest inner product into the smallest angle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialise

K = 20
ORDERINGS, DIMS, BITS = 12, 6, 10
#: Entries of the least tile, and of the least window on either side of a query.
BLOCK, MARGIN = 4096, 1536
#: Queries whose true neighbours settle the window, the share of them that must lie inside, and the steps of growth.
SAMPLE, TARGET, GROWTH = 256, 0.95, 1.25
#: Numbers in the vectors of a tile at most (but BLOCK entries), and scores held at once.
TILE_NUMBERS, SCORES = 1 << 22, 1 << 21


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer cells (n, dims): Gray code, rotations undone from the top bit down."""
    x = [cells[:, k].astype(np.int64).copy() for k in range(cells.shape[1])]
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(flip, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(len(cells), np.int64)
    q = top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | ((x[i] ^ t) >> b & 1)
    return out


def orderings(vectors: np.ndarray, longest: float, seed: int = 11) -> np.ndarray:
    """(len(vectors), ORDERINGS) Hilbert keys of unit vectors in projections that are shifted against one another."""
    length = np.linalg.norm(vectors, axis=1)
    lifted = np.concatenate([vectors, np.sqrt(np.maximum(longest**2 - length**2, 0))[:, None]], 1) / longest
    rng, keys = np.random.default_rng(seed), []
    d = lifted.shape[1]
    for _ in range(ORDERINGS):
        turn, _r = np.linalg.qr(rng.standard_normal((d, d)))
        y = lifted @ turn[:, : min(DIMS, d)]
        # A coordinate of a random unit vector has a deviation of 1 / sqrt(d); four of them each way and the shift fit.
        width = 4 / np.sqrt(d)
        shift = rng.random(y.shape[1]) * width / 2
        cells = np.clip((y + width + shift) / (2.5 * width) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        keys.append(hilbert_index(cells))
    return np.stack(keys, 1)


def entries(vectors: DataFrame, queries: int) -> DataFrame:
    """rep (its smallest vec_id), queried, dims, v (doubles), ids (its K + 1 smallest vec_id) per distinct vector that takes part."""
    usable = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    # Adding zero makes -0.0 the same as 0.0.
    v = vectors.filter(F.col("vec_id").isNotNull() & usable).select("vec_id", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    h = v.withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    # Few rows of a vector matter: the limit is applied before and after the shuffle.
    rank = Window.partitionBy("h1", "h2").orderBy("vec_id")
    least = h.select("vec_id", "h1", "h2").withColumn("r", F.row_number().over(rank)).filter(F.col("r") <= K + 1)
    ids = least.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    queried = h.groupBy("h1", "h2").agg(F.max(F.when(F.pmod("vec_id", F.lit(queries)) == 0, 1).otherwise(0)).alias("queried"), F.min("vec_id").alias("rep"))
    return h.join(queried.withColumnRenamed("h1", "g1").withColumnRenamed("h2", "g2"), (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2")) & (F.col("vec_id") == F.col("rep"))).select("h1", "h2", "rep", "queried", F.size("v").alias("dims"), "v").dropDuplicates(["rep"]).join(ids, ["h1", "h2"]).select("rep", "queried", "dims", "v", "ids")


def _numbers(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _spread(longest: dict[int, float]):
    """Each entry once per ordering, with its curve (dims * ORDERINGS + ordering) and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                keys = orderings(_numbers(part.column(2), int(d)), longest[int(d)])
                for k in range(ORDERINGS):
                    curve = pa.array(np.full(part.num_rows, int(d) * ORDERINGS + k, np.int64))
                    yield pa.RecordBatch.from_arrays([part.column(0), curve, pa.array(np.ascontiguousarray(keys[:, k]))], ["rep", "curve", "key"])

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the place inside it for each curve; rows come sorted by curve."""
    part, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        curves = batch.column(1).to_numpy()
        at = np.empty(len(curves), np.int64)
        for c in np.unique(curves):
            own = np.flatnonzero(curves == c)
            at[own] = np.arange(len(own)) + seen.get(int(c), 0)
            seen[int(c)] = seen.get(int(c), 0) + len(own)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(at), part, np.int32)), pa.array(at)], ["rep", "curve", "part", "at"])


def _best(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the K + 1 largest of each row, and of all that tie with the last place within rounding."""
    keep = min(K + 1, scores.shape[1])
    cut = np.partition(scores, scores.shape[1] - keep, axis=1)[:, scores.shape[1] - keep]
    return np.nonzero(scores >= (cut - 1e-9 * np.maximum(1, np.abs(cut)))[:, None])


def _search(key, pdf):
    """One tile of one curve: exact inner products of the queries that were sent to it with its entries."""
    import pandas as pd

    asks = pdf["asks"].to_numpy()
    mine, own = pdf[asks].sort_values("rep", kind="stable"), pdf[~asks].sort_values("rep", kind="stable")
    out_q, out_r, out_s = [], [], []
    if len(mine) and len(own):
        m, rep, query = np.stack(own["v"].to_numpy()).astype(np.float64), own["rep"].to_numpy(), mine["rep"].to_numpy()
        step = max(1, SCORES // len(m))
        for a in range(0, len(mine), step):
            scores = np.stack(mine["v"].to_numpy()[a : a + step]).astype(np.float64) @ m.T
            # The order among ties is settled on exact scores.
            qi, ri = _best(scores)
            out_q.append(query[a : a + step][qi])
            out_r.append(rep[ri])
            out_s.append(scores[qi, ri])
    cat = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return pd.DataFrame({"query": cat(out_q, np.int64), "rep": cat(out_r, np.int64), "near": cat(out_s, np.float64)})


def _compare(samples: dict[int, tuple[np.ndarray, np.ndarray]]):
    """The K + 1 best entries of each task (and ties) for every sampled query of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            dims, reps = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            for d in np.unique(dims):
                if int(d) not in samples:
                    continue
                query, asked = samples[int(d)]
                m, rep = _numbers(batch.filter(pa.array(dims == d)).column(2), int(d)), reps[dims == d]
                for a in range(0, len(m), max(1, SCORES // len(query))):
                    part = m[a : a + max(1, SCORES // len(query))]
                    scores = asked @ part.T
                    qi, ri = _best(scores)
                    rows = [query[qi], rep[a : a + len(part)][ri], scores[qi, ri]]
                    if int(d) in found:
                        rows = [np.concatenate(x) for x in zip(found[int(d)], rows, strict=True)]
                    order = np.lexsort((rows[1], -rows[2], rows[0]))
                    q = rows[0][order]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    found[int(d)] = [x[order][place <= K] for x in rows]
        for query, rep, near in found.values():
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(rep), pa.array(near)], ["query", "rep", "near"])

    return run


def tile_size(reach: int, dims: int) -> int:
    return max(BLOCK, min(2 * reach, TILE_NUMBERS // dims))


def seen(query: np.ndarray, entry: np.ndarray, total: int, reach: int, tile: int) -> np.ndarray:
    """Whether queries at some places of a curve meet the entries at other places of it."""
    first, last = np.maximum(query - reach, 0) // tile, np.minimum(query + reach, total - 1) // tile
    return (entry // tile >= first) & (entry // tile <= last)


def windows(usable: DataFrame, ranked: DataFrame, sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """For each length of vectors the window on either side and the size of a tile."""
    out = {d: (MARGIN, BLOCK) for d in sizes}
    large = [d for d, n in sizes.items() if n > BLOCK]
    if not large:
        return out
    first = Window.partitionBy("dims").orderBy(F.xxhash64("rep"), "rep")
    chosen = usable.filter((F.col("queried") == 1) & F.col("dims").isin(large)).select("rep", "dims", F.row_number().over(first).alias("r")).filter(F.col("r") <= SAMPLE).select("rep")
    rows = usable.join(F.broadcast(chosen), "rep").select("rep", "dims", "v").collect()
    samples = {d: (np.array([r.rep for r in rows if r.dims == d], np.int64), np.array([r.v for r in rows if r.dims == d], np.float64)) for d in {r.dims for r in rows}}
    if not samples:
        return out
    near = usable.filter(F.col("dims").isin(list(samples))).select("rep", "dims", "v").transform(map_arrow, _compare(samples), "query long, rep long, near double")
    best = Window.partitionBy("query").orderBy(F.col("near").desc(), "rep")
    truth = near.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= K + 1).select("query", "rep").filter("query <> rep").collect()
    reps = sorted({x for r in truth for x in r})
    wanted = usable.sparkSession.createDataFrame([(x,) for x in reps], "wanted long")
    place: dict[int, dict[int, int]] = {}
    for r in ranked.join(F.broadcast(wanted), F.col("rep") == F.col("wanted")).select("rep", "curve", "pos").collect():
        place.setdefault(r.curve, {})[r.rep] = r.pos
    for d, (query, _) in samples.items():
        own = set(query.tolist())
        pairs = [(r.query, r.rep) for r in truth if r.query in own]
        at = [(np.array([x[q] for q, _ in pairs]), np.array([x[r] for _, r in pairs])) for x in (place[d * ORDERINGS + k] for k in range(ORDERINGS))]
        reach = MARGIN
        while True:
            tile = tile_size(reach, d)
            met = np.any([seen(q, e, sizes[d], reach, tile) for q, e in at], axis=0)
            if met.mean() >= TARGET or reach >= sizes[d]:
                break
            reach = int(reach * GROWTH) + 1
        out[d] = (reach, tile)
    return out


def nearest(vectors: DataFrame, queries: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `queries`, the K nearest found.

    Vectors that are null, empty, zero or hold a null or non-finite component, and rows without a vec_id, take no
    part. Vectors of another length are not candidates. Equal vectors are searched once; ties go to smaller ids; rows
    that repeat a vec_id with different vectors are different entries. Tables of up to BLOCK entries are searched
    wholly; in larger ones the windows are as wide as TARGET of a sample's true neighbours need. An empty table gives
    no rows.
    """
    usable = materialise(entries(vectors, queries).withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))), "near-entries")
    kinds = usable.groupBy("dims").agg(F.max("length").alias("m"), F.count("*").alias("n")).collect()
    longest = {r.dims: r.m * (1 + 1e-9) for r in kinds}
    placed = usable.select("rep", "dims", "v").transform(map_arrow, _spread(longest), "rep long, curve long, key long")
    numbered = materialise(placed.repartitionByRange("curve", "key", "rep").sortWithinPartitions("curve", "key", "rep").select("rep", "curve").transform(map_arrow, _number, "rep long, curve long, part int, at long"), "near-order")
    sizes = numbered.groupBy("curve", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy("curve"))).select(F.col("curve").alias("c"), F.col("part").alias("p"), "base", "total")
    ranked = numbered.join(sizes, (F.col("curve") == F.col("c")) & (F.col("part") == F.col("p"))).select("rep", "curve", (F.col("base") + F.col("at")).alias("pos"), "total")
    reach, tile = F.lit(MARGIN), F.lit(BLOCK)
    for d, (w, t) in windows(usable, ranked, {r.dims: r.n for r in kinds}).items():
        if (w, t) != (MARGIN, BLOCK):
            reach, tile = (F.when(F.col("dims") == d, F.lit(x)).otherwise(y) for x, y in ((w, reach), (t, tile)))
    place = lambda x: F.floor(x / F.col("tile")).cast("long")
    touched = F.sequence(place(F.greatest(F.col("pos") - F.col("reach"), F.lit(0))), place(F.least(F.col("pos") + F.col("reach"), F.col("total") - 1)))
    asks = F.transform(F.when(F.col("queried") == 1, touched).otherwise(F.array().cast("array<bigint>")), lambda x: F.struct(x.alias("block"), F.lit(True).alias("asks")))
    to = F.concat(F.array(F.struct(place(F.col("pos")).alias("block"), F.lit(False).alias("asks"))), asks)
    # Each entry goes to its own tile; only queries go to several.
    sent = ranked.join(usable.select("rep", "dims", "v", "queried"), "rep").withColumn("reach", reach).withColumn("tile", tile).select("rep", "curve", "v", F.explode(to).alias("to")).select("rep", "curve", "to.block", "to.asks", "v")
    found = sent.groupBy("curve", "block").applyInPandas(_search, "query long, rep long, near double")
    pairs = found.groupBy("query", "rep").agg(F.max("near").alias("near"))
    # An entry stands for its smallest ids, so the K + 1 best entries hold the K best rows.
    order = Window.partitionBy("query").orderBy(F.col("near").desc(), "rep")
    best = pairs.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 4 * (K + 1)).select("query", "rep")
    scored = best.join(usable.select("rep", "ids", F.col("v").alias("theirs")), "rep").join(usable.select(F.col("rep").alias("query"), F.col("v").alias("ours")), "query")
    exact = F.aggregate(F.zip_with("ours", "theirs", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    rows = scored.select("query", F.explode("ids").alias("vec_id"), exact.alias("score"))
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"))).filter(F.col("r") <= K + 1)
    lists = materialise(top.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found")), "near-lists")
    asking = vectors.filter(F.pmod("vec_id", F.lit(queries)) == 0).select(F.col("vec_id").cast("long").alias("query_id"), "embedding")
    by_vector = asking.withColumn("v", F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))).select("query_id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    named = lists.join(usable.select(F.col("rep").alias("query"), F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")), "query")
    answers = by_vector.join(named, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, K)
    return answers.select("query_id", F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
