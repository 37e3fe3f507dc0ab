"""Interpolated modified Kneser-Ney models over characters, counted and estimated by Spark, kept as sorted hash arrays.

A character's n-gram is the character (a Unicode code point, nothing is folded) and the two before it in its text, 0
before the first. A trigram is one 63-bit number, so nothing collides; its last 42 and 21 bits are the lower orders.

Texts are cut to blocks of bounded bytes, and a table of blocks is stored in buckets by block: rows of texts, and rows
that hold what a block's n-grams are and how often they occur. The counts of all blocks make the models by joins and
sums of tables that grow with the corpus' n-grams. Each block then gets the scores of its own n-grams only, arrays
sorted by n-gram, so no task and no broadcast ever holds a model. Texts are written once and never shuffled.

Scores are whole millionths of natural logarithms: their sums do not depend on how rows are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket_count, chunks, map_arrow, materialise, stored_table

BITS = 21
ONE, TWO = (1 << BITS) - 1, (1 << 2 * BITS) - 1
#: Bytes of text in a block (a longer text is a block of its own), and n-grams in one of its rows of counts.
BLOCK, GRAMS_A_ROW = 8 << 20, 1 << 16
#: Alphabets of a block up to this size are counted in a dense array of its cube.
DENSE = 161
MICRO = 1e6


# ---- n-grams of a block -------------------------------------------------------------------------------------------
class Trigrams:
    """The trigrams of the texts of a block, numbered densely by its alphabet."""

    def __init__(self, raws: list[bytes | None]):
        texts = [(r or b"").decode("utf-8", "replace") for r in raws]
        self.offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.offsets[1:])
        chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        present = np.zeros(0x110000, bool)
        present[chars] = True
        present[0] = True
        self.alphabet = np.flatnonzero(present)
        self.size = len(self.alphabet)
        whole = np.int32 if self.size**3 < 1 << 31 else np.int64
        rank = np.zeros(0x110000, whole)
        rank[self.alphabet] = np.arange(self.size)
        self.at = rank[chars]
        starts = self.offsets[:-1][np.diff(self.offsets) > 0]
        seconds = self.offsets[:-1][np.diff(self.offsets) > 1] + 1
        one, two = np.zeros_like(self.at), np.zeros_like(self.at)
        one[1:], two[2:] = self.at[:-1], self.at[:-2]
        one[starts], two[starts], two[seconds] = 0, 0, 0
        two *= self.size
        two += one
        two *= self.size
        self.at += two

    def rows(self, which: np.ndarray) -> np.ndarray:
        """The trigrams of the marked rows."""
        return self.at[np.repeat(which, np.diff(self.offsets))]

    def distinct(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct trigrams by their dense numbers, and how often each occurs."""
        if self.size <= DENSE:
            n = np.bincount(at, minlength=self.size**3)
            found = np.flatnonzero(n)
            return found, n[found]
        return np.unique(at, return_counts=True)

    def codes(self, found: np.ndarray) -> np.ndarray:
        """Dense numbers to 63-bit ones; the order stays."""
        letters, found = self.alphabet.astype(np.int64), found.astype(np.int64)
        return (letters[found // self.size**2] << 2 * BITS) | (letters[found // self.size % self.size] << BITS) | letters[found % self.size]

    def looked_up(self, at: np.ndarray, codes: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """The score of each trigram, found in sorted arrays that hold all of them."""
        found, _ = self.distinct(at)
        own = scores[np.searchsorted(codes, self.codes(found))]
        if self.size <= DENSE:
            table = np.zeros(self.size**3, scores.dtype)
            table[found] = own
            return table[at]
        return own[np.searchsorted(found, at)]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Exact sums of whole numbers by row."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, dtype=np.int64, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


# ---- blocks -------------------------------------------------------------------------------------------------------
def block_table(rows: DataFrame, describe: Callable[[pa.RecordBatch], dict[str, pa.Array]], made: str, every: bool, spare: tuple[str, ...] = ()) -> DataFrame:
    """rows (with model string, raw binary) in blocks: block, place, the columns of rows, those that describe makes, counts.

    Rows with place >= 0 are those of rows. The others hold arrays codes and ns: for each model (not null) the trigrams
    of its texts in the block and how often they occur; with `every`, also all of the block's, under a null model.
    The spare columns of rows are read and not stored.
    """
    names, added = rows.columns, [x.split()[0] for x in made.split(", ")] if made else []
    own_names = [n for n in names if n not in spare]
    columns = ["block", "place", *own_names, *added, "codes", "ns"]
    schema = ", ".join(x for x in ("block long, place int", *(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in own_names), made, "codes array<long>, ns array<long>") if x)
    model, raw, longs = names.index("model"), names.index("raw"), pa.list_(pa.int64())

    def block(number: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: list[str | None] = []
        for b in held:
            own = describe(b)
            place = pa.array(np.arange(len(of), len(of) + b.num_rows, dtype=np.int32))
            cols = [pa.array(np.full(b.num_rows, number)), place, *(b.column(names.index(n)) for n in own_names), *(own[c] for c in added), *(pa.nulls(b.num_rows, longs) for _ in range(2))]
            yield pa.RecordBatch.from_arrays(cols, columns)
            of += b.column(model).to_pylist()
        grams = Trigrams([x for b in held for x in b.column(raw).to_pylist()])
        kinds: list[tuple[str | None, np.ndarray]] = [(m, grams.rows(np.array([x == m for x in of], bool))) for m in sorted({x for x in of if x is not None})]
        for m, at in [*kinds, (None, grams.at)] if every else kinds:
            found, n = grams.distinct(at)
            codes = grams.codes(found)
            for a in range(0, len(codes), GRAMS_A_ROW):
                rest = [pa.array([m], c.type) if k == own_names.index("model") else pa.nulls(1, c.type) for k, c in enumerate(cols[2:-2])]
                counts = [pa.array([x[a : a + GRAMS_A_ROW]], longs) for x in (codes, n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([-1], pa.int32()), *rest, *counts], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for whole in batches:
            for batch in chunks(whole, "raw", BLOCK // 4):
                held.append(batch)
                size += batch.column(raw).nbytes
                if size >= BLOCK:
                    yield from block(number, held)
                    number, held, size = number + 1, [], 0
        if held:
            yield from block(number, held)

    return stored_table(rows.transform(map_arrow, run, schema), "block", bucket_count(rows))


def counted(blocks: DataFrame) -> DataFrame:
    """model, code, n over all blocks."""
    rows = blocks.filter("place < 0 and model is not null").select("model", F.explode(F.arrays_zip("codes", "ns")).alias("x"))
    return materialise(rows.groupBy("model", F.col("x.codes").alias("code")).agg(F.sum("x.ns").alias("n")), "ngram-counts")


def named(blocks: DataFrame) -> DataFrame:
    """block, model, code of all rows of counts."""
    return blocks.filter("place < 0").select("block", "model", F.explode("codes").alias("code"))


# ---- estimation ---------------------------------------------------------------------------------------------------
def _last(code: Column, bits: int) -> Column:
    return code.bitwiseAND(F.lit(bits))


def _before(code: Column) -> Column:
    return F.shiftright(code, BITS)


def discounts(counts: DataFrame) -> DataFrame:
    """model, d1, d2, d3 of modified Kneser-Ney, from how many n-grams occur once to four times: all counts, unpruned."""
    times = [F.greatest(F.count(F.when(F.col("n") == k, 1)), F.lit(1)).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    n1, n2, n3, n4 = (F.col(f"n{k}") for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    held = lambda x, most: F.greatest(F.lit(0.1), F.least(x, F.lit(most)))
    return counts.groupBy("model").agg(*times).select("model", held(1 - 2 * y * n2 / n1, 0.95).alias("d1"), held(2 - 3 * y * n3 / n2, 1.9).alias("d2"), held(3 - 4 * y * n4 / n3, 2.85).alias("d3"))


def _contexts(counts: DataFrame, cut: DataFrame, least: int) -> DataFrame:
    """model, context, total, mass: a context's count, and the share of it that its n-grams leave to the order below.

    N-grams that occur less than `least` times keep nothing for themselves: all of their count goes below.
    """
    kept = lambda cond: F.count(F.when((F.col("n") >= least) & cond, 1))
    times = [kept(F.col("n") == 1).alias("k1"), kept(F.col("n") == 2).alias("k2"), kept(F.col("n") >= 3).alias("k3")]
    lost = F.sum(F.when(F.col("n") < least, F.col("n")).otherwise(0)).alias("lost")
    context = counts.groupBy("model", _before(F.col("code")).alias("context")).agg(F.sum("n").alias("total"), *times, lost).join(cut, "model")
    mass = (F.col("lost") + F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")) / F.col("total")
    return context.select("model", "context", "total", mass.alias("mass"))


def scores(counts: DataFrame, wanted: DataFrame, least: int = 1) -> DataFrame:
    """model, code, log: the score of each wanted (model, code) under its model, in millionths, whether it occurs there or not.

    counts: model, code, n of trigrams. Lower orders count distinct left neighbours. Every order is interpolated with
    the one below, the lowest with an equal share for each character of the model's alphabet and one for all others. A
    model that has learned nothing gives every n-gram the least score.
    """
    lower = lambda df, bits: df.groupBy("model", _last(F.col("code"), bits).alias("code")).agg(F.count("*").alias("n"))
    two = materialise(lower(counts, TWO), "ngram-bigrams")
    one = lower(two, ONE)
    want = lambda bits: wanted.select("model", _last(F.col("code"), bits).alias("code")).distinct()
    share = F.broadcast(one.groupBy("model").agg((1.0 / (F.count("*") + 1)).alias("q")))  # a row a language, like those of discounts
    below = None
    for own, asked, bits, few in ((one, want(ONE), 0, 1), (two, want(TWO), ONE, 1), (counts, wanted, TWO, least)):
        cut = F.broadcast(discounts(own))
        p = asked.select("model", "code", _before(F.col("code")).alias("context"), _last(F.col("code"), bits).alias("end"))
        p = p.join(own, ["model", "code"], "left").join(_contexts(own, cut, few), ["model", "context"], "left").join(cut, "model", "left")
        p = p.join(share, "model", "left") if below is None else p.join(below, ["model", "end"])
        less = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        kept = F.coalesce(F.when(F.col("n") >= few, (F.col("n") - less) / F.col("total")), F.lit(0.0))
        p = p.select("model", F.col("code").alias("end"), (kept + F.coalesce("mass", F.lit(1.0)) * F.coalesce("q", F.lit(0.0))).alias("q"))
        below = p
    return p.select("model", F.col("end").alias("code"), F.round(F.log(F.greatest("q", F.lit(1e-12))) * MICRO).cast("int").alias("log"))


def score_blocks(blocks: DataFrame, lookups: DataFrame, score: Callable[[pa.Table, pa.Table], pa.Table], columns: list[str], schema: str) -> DataFrame:
    """score(texts, lookups) of every block. The texts stay in their buckets; a block's lookups come to them."""
    texts = blocks.filter("place >= 0").select("block", *columns).groupBy("block")
    # Both come from one table: names of their own tell the columns apart.
    apart = lookups.select(*[F.col(c).alias(f"of_{c}") for c in lookups.columns]).groupBy("of_block")
    names = lookups.columns
    return texts.cogroup(apart).applyInArrow(lambda rows, found: score(rows, found.rename_columns(names)), schema)


# ---- quantiles ----------------------------------------------------------------------------------------------------
def quantiles(df: DataFrame, key: str, value: Column, points: list[float], weight: Column | None = None, grid: float = 1e-4) -> DataFrame:
    """key, q (array): exact quantiles, by weight, of the values rounded to the grid, from counts of distinct values."""
    bins = df.groupBy(key, F.round(value / grid).cast("long").alias("bin")).agg(F.sum(weight if weight is not None else F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    run = bins.select(key, "bin", upto.alias("upto"), F.sum("n").over(Window.partitionBy(key)).alias("total"))
    return run.groupBy(key).agg(F.array(*[F.min(F.when(F.col("upto") >= p * F.col("total"), F.col("bin"))) * grid for p in points]).alias("q"))


def languages_of(docs: DataFrame) -> list[str]:
    """All non-null values of lang by code point."""
    return [r.lang for r in docs.filter(F.col("lang").isNotNull()).select("lang").distinct().orderBy("lang").collect()]


def sorted_arrays(lookups: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a block's lookups in order, and the order."""
    codes = lookups.column("code").to_numpy()
    order = np.argsort(codes, kind="stable")
    return codes[order], order
