"""The inverted index over words and adjacent pairs, and loose and phrase search on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import shard_column, shard_for

#: A posting list is stored in blocks of so many ordinals, so no list grows with the corpus.
BLOCK = 1 << 20
#: Values in a delta-coded run.
RUN = 128
SHARDS, MIN_PAIR_DOCS, MAX_SHARE, LEAST_CEILING = 64, 3, 0.12, 200
MATCH_SHARE, MAX_RESULTS = 0.6, 2000


def ordinal_bases(docs: DataFrame) -> DataFrame:
    """slug, n, base: where each collection's run of ordinals starts; one row a collection."""
    per = docs.groupBy("slug").agg(F.count("*").alias("n"))
    before = Window.orderBy("slug").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("slug", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def ordinals(docs: DataFrame) -> DataFrame:
    """docs with ordinal: collection by collection, by id inside; numbered per collection, never in one global window."""
    local = F.row_number().over(Window.partitionBy("slug").orderBy("doc_id")) - 1
    return docs.withColumn("local", local).join(ordinal_bases(docs).select("slug", "base"), "slug").withColumn("ordinal", (F.col("base") + F.col("local")).cast("long")).drop("local", "base")


def locate(ordinal: DataFrame, bases: DataFrame) -> DataFrame:
    """ordinal, slug, offset: the collection with the largest base not beyond an ordinal, as a range join on a few rows."""
    ends = bases.select("slug", "base", F.lead("base").over(Window.orderBy("base")).alias("next"))
    return ordinal.join(ends, (F.col("ordinal") >= F.col("base")) & (F.col("next").isNull() | (F.col("ordinal") < F.col("next")))).select("ordinal", "slug", (F.col("ordinal") - F.col("base")).alias("offset"))


def terms_of(docs: DataFrame) -> DataFrame:
    """ordinal, term: the distinct words and pairs of each document."""
    words = docs.select("ordinal", text.tokenise(F.col("text")).alias("words"))
    return words.select("ordinal", F.explode(F.array_union("words", text.bigrams(F.col("words")))).alias("term"))


def ceiling(n: Column) -> Column:
    return F.greatest(F.lit(LEAST_CEILING), F.floor(n * MAX_SHARE))


def document_frequencies(docs: DataFrame) -> DataFrame:
    return terms_of(docs).groupBy("term").agg(F.count("*").alias("df"))


def kept_terms(docs: DataFrame) -> DataFrame:
    """term, df after retention: pairs need a few documents, and nothing may stand in too large a share of them."""
    top = docs.agg(ceiling(F.count("*")).alias("ceiling"))
    df = document_frequencies(docs).join(F.broadcast(top))  # one row
    return df.filter((F.col("df") <= F.col("ceiling")) & (~F.col("term").contains(" ") | (F.col("df") >= MIN_PAIR_DOCS))).select("term", "df")


def postings(docs: DataFrame) -> DataFrame:
    """shard, term, df, block, ordinals (ascending): a row for each BLOCK of ordinals in which a kept term occurs."""
    terms = terms_of(docs).join(kept_terms(docs), "term").withColumn("block", F.floor(F.col("ordinal") / BLOCK))
    return terms.groupBy("term", "df", "block").agg(F.array_sort(F.collect_list("ordinal")).alias("ordinals")).select(shard_column(F.col("term"), SHARDS).alias("shard"), "term", "df", "block", "ordinals")


def delta_encode(a: Column) -> Column:
    return F.transform(a, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get(a, i - 1)))


def delta_decode(a: Column) -> Column:
    """Running sums, by growing an array: for arrays of bounded length (RUN) only."""
    step = lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0))))
    return F.aggregate(a, F.array().cast("array<bigint>"), step)


def runs(a: Column) -> Column:
    """An ascending array as delta-coded pieces of RUN values, each with its first value whole."""
    starts = F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), F.lit(RUN))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: delta_encode(F.slice(a, at, RUN)))


def unrun(a: Column) -> Column:
    """The array of runs; work grows with its length."""
    return F.flatten(F.transform(a, delta_decode))


def write_index(index: DataFrame, path: str) -> None:
    """Postings by shard, and the vocabulary (term, df) beside them."""
    index.withColumn("deltas", runs(F.col("ordinals"))).drop("ordinals").repartitionByRange("shard", "term").sortWithinPartitions("shard", "term", "block").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/postings")
    read_index(index.sparkSession, path).select("term", "df").distinct().write.mode("overwrite").parquet(f"{path}/terms")


def read_index(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/postings")


def vocabulary(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/terms")


def query_terms(spark, query: str) -> tuple[list[str], list[str]]:
    """The distinct words and pairs of a query; a driver-side literal, so its shards prune the scan."""
    row = spark.range(1).select(text.tokenise(F.lit(query)).alias("w")).select("w", text.bigrams(F.col("w")).alias("p")).first()
    return list(dict.fromkeys(row.w)), list(dict.fromkeys(row.p))


def read_terms(spark, path: str, terms: list[str]) -> DataFrame:
    """The postings of some terms: only their shards are read."""
    shards = sorted({shard_for(t, SHARDS) for t in terms})
    found = read_index(spark, path).filter(F.col("shard").isin(shards) & F.col("term").isin(terms))
    return found.withColumn("ordinals", unrun(F.col("deltas"))).drop("deltas")


def search(index: DataFrame, words: list[str], pairs: list[str]) -> DataFrame:
    """ordinal, words, pairs, score: documents with most of the indexed words; pairs count double and mark a phrase."""
    hits = index.filter(F.col("term").isin(words + pairs)).select("term", F.explode("ordinals").alias("ordinal"))
    is_pair = F.col("term").contains(" ")
    found = hits.groupBy("ordinal").agg(F.count_if(~is_pair).alias("words"), F.count_if(is_pair).alias("pairs"))
    usable = index.filter(F.col("term").isin(words)).select("term").distinct().agg(F.greatest(F.lit(1), F.ceil(F.count("*") * MATCH_SHARE)).alias("need"))
    ok = found.join(F.broadcast(usable)).filter(F.col("words") >= F.col("need"))  # one row
    return ok.select("ordinal", "words", "pairs", (F.col("words") + 2 * F.col("pairs")).alias("score"))


def ranked(results: DataFrame) -> DataFrame:
    return results.orderBy(F.col("score").desc(), "ordinal").limit(MAX_RESULTS)
