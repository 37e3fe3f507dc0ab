"""Registered queries over the corpus binding, each with its SQL oracle."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import shard_column
from ..operators import chains, generations, index, names, records
from ..sources import corpus
from ..sources.store import forget_at_exit, shared_dir
from . import sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return index.ordinals(corpus.texts(spark, sf))


def _joined(c, sep: str = ",") -> F.Column:
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


# ---- text and index -------------------------------------------------------------------------------------------------
@query(f"WITH {sql.TOKENS} SELECT doc_id, len(words) AS n_terms, array_to_string(words, ' ') AS terms FROM tok")
def tokenise_docs(spark, sf):
    t = corpus.texts(spark, sf).select("doc_id", text.tokenise(F.col("text")).alias("w"))
    return t.select("doc_id", F.size("w").cast("long").alias("n_terms"), F.array_join("w", " ").alias("terms"))


@query(f"WITH {sql.TOKENS} SELECT doc_id, len(pairs) AS n_pairs, coalesce(pairs[1], '') AS first_pair, coalesce(pairs[len(pairs)], '') AS last_pair FROM tok")
def doc_bigrams(spark, sf):
    t = corpus.texts(spark, sf).select("doc_id", text.bigrams(text.tokenise(F.col("text"))).alias("p"))
    return t.select("doc_id", F.size("p").cast("long").alias("n_pairs"), F.coalesce(F.get("p", F.lit(0)), F.lit("")).alias("first_pair"), F.coalesce(F.get("p", F.size("p") - 1), F.lit("")).alias("last_pair"))


@query(f"WITH {sql.TOKENS} SELECT term, {sql.fnv('term', 64)} AS shard FROM (SELECT DISTINCT unnest(words) AS term FROM tok)")
def term_shards(spark, sf):
    terms = corpus.texts(spark, sf).select(F.explode(text.tokenise(F.col("text"))).alias("term")).distinct()
    return terms.select("term", shard_column(F.col("term"), index.SHARDS).alias("shard"))


@query(f"WITH {sql.POSTINGS} SELECT {sql.fnv('term', 64)} AS shard, term, df, string_agg(ordinal::VARCHAR, ',' ORDER BY ordinal) AS ordinals FROM post GROUP BY term, df")
def postings(spark, sf):
    return index.postings(_docs(spark, sf)).select("shard", "term", "df", _joined(F.col("ordinals")).alias("ordinals"))


@query(f"WITH {sql.POSTINGS}, dl AS (SELECT term, ordinal, ordinal - coalesce(lag(ordinal) OVER (PARTITION BY term ORDER BY ordinal), 0) AS delta FROM post) SELECT term, string_agg(delta::VARCHAR, ',' ORDER BY ordinal) AS deltas, true AS round_trip FROM dl GROUP BY term")
def postings_delta(spark, sf):
    p = index.postings(_docs(spark, sf)).withColumn("deltas", index.delta_encode(F.col("ordinals")))
    return p.select("term", _joined(F.col("deltas")).alias("deltas"), (index.unrun(index.runs(F.col("ordinals"))) == F.col("ordinals")).alias("round_trip"))


#: The needle is in the data at every scale: the pair of kept words that most documents have, and a word of none.
_SEARCH_SQL = sql.POSTINGS + """,
words AS (SELECT term FROM kept WHERE NOT contains(term, ' ')),
needle AS (SELECT term FROM kept WHERE contains(term, ' ') AND split_part(term, ' ', 1) IN (SELECT term FROM words) AND split_part(term, ' ', 2) IN (SELECT term FROM words) ORDER BY df DESC, term LIMIT 1),
q AS (SELECT unnest([split_part(term, ' ', 1), split_part(term, ' ', 2), 'zzzunknown']) AS term FROM needle),
qp AS (SELECT unnest([term, split_part(term, ' ', 2) || ' zzzunknown']) AS term FROM needle),
need AS (SELECT greatest(1, ceil(count(DISTINCT term) * CAST(0.6 AS DOUBLE))) AS need FROM post WHERE term IN (SELECT term FROM q)),
hit AS (SELECT ordinal, count(*) FILTER (WHERE term IN (SELECT term FROM q)) AS words, count(*) FILTER (WHERE term IN (SELECT term FROM qp)) AS pairs FROM post GROUP BY ordinal),
res AS (SELECT ordinal, words, pairs, words + 2 * pairs AS score FROM hit WHERE words > 0 AND words >= (SELECT need FROM need))"""
_INDEXES: dict[tuple[str, str], str] = {}


def stored_index(spark, sf) -> str:
    """Where the index of a corpus lies: written by the first search of a session, read by shards from then on."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        path = f"{shared_dir(spark)}/tables/index-{uuid.uuid4().hex}"
        index.write_index(index.postings(_docs(spark, sf)), path)
        forget_at_exit(spark, path)
        _INDEXES[key] = path
    return _INDEXES[key]


def _needle(spark, sf) -> str:
    terms = index.vocabulary(spark, stored_index(spark, sf))
    words = terms.filter(~F.col("term").contains(" ")).select("term")
    pairs = terms.filter(F.col("term").contains(" "))
    for k, side in enumerate(("first", "second")):
        pairs = pairs.join(words.withColumnRenamed("term", side), F.split("term", " ")[k] == F.col(side), "left_semi")
    best = pairs.orderBy(F.col("df").desc(), "term").select("term").first()
    return f"{best.term if best else ''} zzzunknown"


def _search(spark, sf) -> tuple[DataFrame, DataFrame, list[str]]:
    """Results, the postings of the query's terms, its words."""
    words, pairs = index.query_terms(spark, _needle(spark, sf))
    read = index.read_terms(spark, stored_index(spark, sf), words + pairs)
    return index.search(read, words, pairs), read, words


@query(f"WITH {_SEARCH_SQL} SELECT ordinal, words, pairs, score FROM res ORDER BY score DESC, ordinal LIMIT 2000")
def search_loose(spark, sf):
    return index.ranked(_search(spark, sf)[0])


@query(f"WITH {_SEARCH_SQL} SELECT ordinal, score FROM (SELECT * FROM res ORDER BY score DESC, ordinal LIMIT 2000) WHERE pairs > 0")
def search_phrase(spark, sf):
    return index.ranked(_search(spark, sf)[0]).filter("pairs > 0").select("ordinal", "score")


@query(f"WITH {_SEARCH_SQL} SELECT slug, count(*) AS n FROM (SELECT * FROM res ORDER BY score DESC, ordinal LIMIT 2000) JOIN tok USING (ordinal) GROUP BY slug")
def search_spread(spark, sf):
    found = index.ranked(_search(spark, sf)[0]).select("ordinal")
    return index.locate(found, index.ordinal_bases(corpus.texts(spark, sf))).groupBy("slug").agg(F.count("*").alias("n"))


@query(f"WITH {_SEARCH_SQL} SELECT count(*) AS total, count(*) FILTER (WHERE pairs > 0) AS phrase, (SELECT count(*) FROM q WHERE term NOT IN (SELECT term FROM post)) AS unindexed FROM res")
def search_totals(spark, sf):
    found, read, words = _search(spark, sf)
    counts = found.agg(F.count("*").alias("total"), F.count_if(F.col("pairs") > 0).alias("phrase"))
    have = read.filter(F.col("term").isin(words)).agg(F.count_distinct("term").alias("have"))
    return counts.crossJoin(have).select("total", "phrase", (F.lit(len(words)) - F.col("have")).alias("unindexed"))  # one row each


@query("SELECT source AS slug, count(*) AS n, coalesce(sum(count(*)) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM documents GROUP BY source")
def ordinal_bases(spark, sf):
    return index.ordinal_bases(corpus.texts(spark, sf))


@query(f"WITH {sql.TOKENS} SELECT ordinal, slug, ordinal - min(ordinal) OVER (PARTITION BY slug) AS \"offset\" FROM tok")
def ordinal_locate(spark, sf):
    docs = corpus.texts(spark, sf)
    return index.locate(_docs(spark, sf).select("ordinal"), index.ordinal_bases(docs))


@query(f"WITH {sql.TOKENS} SELECT doc_id, slug, floor((row_number() OVER (PARTITION BY slug ORDER BY doc_id) - 1) / 400)::BIGINT AS chunk FROM tok")
def chunking(spark, sf):
    at = F.row_number().over(Window.partitionBy("slug").orderBy("doc_id")) - 1
    return corpus.texts(spark, sf).select("doc_id", "slug", F.floor(at / 400).alias("chunk"))


# ---- chains and graph -------------------------------------------------------------------------------------------------
@query(f"WITH {sql.CORPUS} SELECT r.id, slug, coalesce(string_agg(nar, ' ' ORDER BY pos), '') AS chain, coalesce(string_agg(CASE WHEN f = 'R' AND pos < n - 1 THEN pos::VARCHAR END, ',' ORDER BY pos), '') AS gaps FROM r LEFT JOIN k ON r.id = k.id GROUP BY r.id, slug")
def chain_table(spark, sf):
    return corpus.reports(spark, sf).select("id", "slug", F.array_join("chain", " ").alias("chain"), _joined(F.col("gaps")).alias("gaps"))


@query(f"WITH {sql.CORPUS} SELECT id, CAST(\"at\" AS INT) AS \"at\", src, dst, gap FROM steps")
def chain_steps(spark, sf):
    return chains.steps(corpus.reports(spark, sf))


@query(f"WITH {sql.CORPUS} SELECT node, count(DISTINCT id) AS weight FROM (SELECT id, src AS node FROM steps UNION SELECT id, dst FROM steps) GROUP BY node")
def graph_nodes(spark, sf):
    return chains.nodes(corpus.reports(spark, sf))


@query(f"WITH {sql.CORPUS} SELECT src, dst, count(*) AS weight, bool_and(gap) AS gap FROM steps WHERE src <> dst GROUP BY src, dst")
def graph_edges(spark, sf):
    return chains.edges(corpus.reports(spark, sf))


def _registry(spark, sf) -> DataFrame:
    people = corpus.transmitters(spark, sf)
    placed = generations.assign(corpus.reports(spark, sf), people)
    return placed.join(people.select("id", "woman"), "id", "left").withColumn("woman", F.coalesce("woman", F.lit(False)))


_TYPED = """te AS (SELECT e.*, CASE WHEN abs(diff) <= CAST(0.02 AS DOUBLE) THEN 'peer' WHEN diff < 0 THEN 'backward' ELSE 'forward' END AS kind FROM (
  SELECT steps.src, dst, count(*) AS weight, bool_and(gap) AS gap, max(CAST(CAST(b.gen + CAST(0.66 AS DOUBLE) * b.sub AS FLOAT) AS DOUBLE) - CAST(CAST(a.gen + CAST(0.66 AS DOUBLE) * a.sub AS FLOAT) AS DOUBLE)) AS diff
  FROM steps JOIN reg a ON a.id = steps.src JOIN reg b ON b.id = dst WHERE steps.src <> dst GROUP BY steps.src, dst) e)"""


@query(f"WITH {sql.GENERATIONS}, {_TYPED} SELECT src, dst, weight, gap, kind FROM te")
def edge_kinds(spark, sf):
    return chains.typed_edges(corpus.reports(spark, sf), _registry(spark, sf))


@query(f"WITH {sql.GENERATIONS}, {_TYPED} SELECT count(*) FILTER (WHERE kind = 'peer') AS peer, count(*) FILTER (WHERE kind = 'backward') AS backward, count(*) FILTER (WHERE gap) AS gap, (SELECT count(DISTINCT id) FROM k) AS reports FROM te")
def link_counts(spark, sf):
    r = corpus.reports(spark, sf)
    e = chains.typed_edges(r, _registry(spark, sf)).agg(F.count_if(F.col("kind") == "peer").alias("peer"), F.count_if(F.col("kind") == "backward").alias("backward"), F.count_if("gap").alias("gap"))
    return e.crossJoin(r.agg(F.count_if(F.size("chain") > 0).alias("reports")))


@query(f"WITH {sql.CORPUS} SELECT DISTINCT CASE WHEN src = 'r1' THEN dst ELSE src END AS other FROM steps WHERE src <> dst AND (src = 'r1' OR dst = 'r1')")
def neighbours(spark, sf):
    return chains.neighbours(corpus.reports(spark, sf), "r1")


def _isolate(spark, sf, through):
    return corpus.reports(spark, sf).filter((F.size("chain") > 0) & chains.passes_through(through, F.col("chain"), F.col("slug"))).select("id")


@query(f"WITH {sql.CORPUS} SELECT DISTINCT id FROM k WHERE nar = 'r1'")
def isolate_one(spark, sf):
    return _isolate(spark, sf, ["r1", "prophet"])


@query(f"WITH {sql.CORPUS} SELECT id FROM k WHERE nar = 'r1' INTERSECT SELECT id FROM k WHERE nar = 'r2'")
def isolate_two(spark, sf):
    return _isolate(spark, sf, ["r1", "r2"])


@query(f"WITH {sql.CORPUS} SELECT id FROM k WHERE nar = 'r1' EXCEPT SELECT id FROM k WHERE nar = 'r2'")
def release(spark, sf):
    return _isolate(spark, sf, ["r1"]).exceptAll(_isolate(spark, sf, ["r1", "r2"]))


@query(f"WITH {sql.CORPUS} SELECT id, slug, chapter FROM r WHERE (slug = '1-URGENT' AND chapter IN (1994, 1995)) OR slug = '5-LOW'")
def selection_chapters(spark, sf):
    chosen = {"1-URGENT": [1994, 1995], "5-LOW": []}
    keep = F.lit(False)
    for slug, chapters in chosen.items():
        keep = keep | ((F.col("slug") == slug) & (F.col("chapter").isin(chapters) if chapters else F.lit(True)))
    return corpus.reports(spark, sf).filter(keep).select("id", "slug", "chapter")


@query(f"WITH {sql.KINDS} SELECT id, slug, array_to_string(list_sort(kinds), ',') AS kinds FROM kd")
def kinds(spark, sf):
    k = chains.kinds(corpus.reports(spark, sf), _registry(spark, sf))
    return k.select("id", "slug", F.array_join(F.array_sort("kinds"), ",").alias("kinds"))


_CHOSEN = ["sahih", "unreached"]


@query(f"WITH {sql.KINDS} " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n FROM kd WHERE {sql.matches([*_CHOSEN, k])}" for k in chains.KINDS))
def kind_facets(spark, sf):
    return chains.facets(chains.kinds(corpus.reports(spark, sf), _registry(spark, sf)), _CHOSEN)


@query(f"WITH {sql.KINDS} SELECT id FROM kd WHERE n > 0 AND {sql.matches(['sahih', 'hasan', 'high'])}")
def kinds_filter(spark, sf):
    k = chains.kinds(corpus.reports(spark, sf), _registry(spark, sf))
    return k.filter((F.size("chain") > 0) & chains.matches_kinds(["sahih", "hasan", "high"], F.col("kinds"))).select("id")


# ---- registry -----------------------------------------------------------------------------------------------------------
@query(f"WITH {sql.GENERATIONS} SELECT id, count(*) AS n, count(*) FILTER (WHERE anchored) AS anchored, {sql.pct('depth', 0.5)} AS median_depth FROM d GROUP BY id")
def registry_counts(spark, sf):
    d = generations.depths(corpus.reports(spark, sf))
    return d.groupBy("id").agg(F.count("*").alias("n"), F.count_if("anchored").alias("anchored")).join(chains.percentile_by(d, "id", "depth", 0.5).withColumnRenamed("p", "median_depth"), "id")


@query(f"WITH {sql.GENERATIONS} SELECT id, n FROM (SELECT id, count(*) AS n FROM d GROUP BY id) ORDER BY n DESC, id LIMIT 25")
def registry_top(spark, sf):
    return generations.depths(corpus.reports(spark, sf)).groupBy("id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "id").limit(25)


@query(f"WITH {sql.GENERATIONS} SELECT id, string_agg(report::VARCHAR, ',' ORDER BY report) AS reports FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY report, depth) AS k FROM d WHERE id <> 'prophet') WHERE k <= 500 GROUP BY id")
def registry_reports(spark, sf):
    d = generations.depths(corpus.reports(spark, sf)).filter(F.col("id") != corpus.APEX)
    first = d.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("report", "depth"))).filter("k <= 500")
    return first.groupBy("id").agg(_joined(F.array_sort(F.collect_list("report"))).alias("reports"))


@query(f"WITH {sql.CORPUS}, sf AS (SELECT nar AS id, grade AS surface, count(*) AS n, min(k.id) AS seen FROM k JOIN r USING (id) WHERE grade IS NOT NULL GROUP BY nar, grade) SELECT id, arg_max(surface, (n, length(surface), -seen)) AS surface, sum(n)::BIGINT AS total FROM sf GROUP BY id")
def commonest_surface(spark, sf):
    rows = corpus.reports(spark, sf).filter("grade is not null").select("id", "grade", F.explode("chain").alias("nar"))
    per = rows.groupBy("nar", "grade").agg(F.count("*").alias("n"), F.min("id").alias("seen"))
    return per.groupBy(F.col("nar").alias("id")).agg(F.max_by("grade", F.struct("n", F.length("grade"), -F.col("seen"))).alias("surface"), F.sum("n").alias("total"))


@query(f"WITH {sql.CORPUS} SELECT nar AS id, count(*) FILTER (WHERE f <> 'R') AS clear, count(*) FILTER (WHERE f = 'R') AS uncertain FROM k GROUP BY nar")
def identification_tally(spark, sf):
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    lines = corpus.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x"))
    kept = lines.select(F.explode(F.filter("x", lambda v, i: (i == 0) | (v["l_suppkey"] != F.get(F.col("x"), i - 1)["l_suppkey"]))).alias("v"))
    return kept.groupBy(F.concat(F.lit("r"), F.col("v.l_suppkey").cast("string")).alias("id")).agg(F.count_if(F.col("v.l_returnflag") != "R").alias("clear"), F.count_if(F.col("v.l_returnflag") == "R").alias("uncertain"))


@query(f"WITH {sql.CORPUS} SELECT slug, count(DISTINCT r.id) AS reports, count(DISTINCT k.id) AS chains, count(DISTINCT nar) AS transmitters FROM r LEFT JOIN k ON r.id = k.id GROUP BY slug")
def book_summary(spark, sf):
    r = corpus.reports(spark, sf)
    people = r.select("slug", F.explode("chain").alias("nar")).groupBy("slug").agg(F.count_distinct("nar").alias("transmitters"))
    return r.groupBy("slug").agg(F.count("*").alias("reports"), F.count_if(F.size("chain") > 0).alias("chains")).join(people, "slug")


@query(f"WITH {sql.CORPUS}, u AS (SELECT s.id FROM s SEMI JOIN k ON k.nar = s.id) SELECT id, {sql.fnv('id', '(SELECT greatest(1, ceil(count(*) / 400.0))::BIGINT FROM u)')} AS shard FROM u")
def bio_shards(spark, sf):
    """Four hundred profiles a shard, one shard at least."""
    used = corpus.reports(spark, sf).select(F.explode("chain").alias("id")).distinct()
    people = corpus.transmitters(spark, sf).join(used, "id", "left_semi").select("id")
    shards = people.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / 400)).alias("shards"))
    return people.crossJoin(F.broadcast(shards)).select("id", shard_column(F.col("id"), F.col("shards")).alias("shard"))  # one row


@query("SELECT l_suppkey AS id, list_sort(list(l_quantity))[floor(count(*) * CAST(0.9 AS DOUBLE))::BIGINT + 1] AS p90, list_sort(list(l_quantity))[floor(count(*) * CAST(0.5 AS DOUBLE))::BIGINT + 1] AS p50 FROM lineitem GROUP BY l_suppkey")
def percentile_floor(spark, sf):
    rows = corpus.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("id"), "l_quantity")
    return chains.percentile_by(rows, "id", "l_quantity", 0.9).withColumnRenamed("p", "p90").join(chains.percentile_by(rows, "id", "l_quantity", 0.5).withColumnRenamed("p", "p50"), "id")


# ---- generations ----------------------------------------------------------------------------------------------------------
def _gen(spark, sf):
    return corpus.reports(spark, sf), corpus.transmitters(spark, sf)


@query(f"WITH {sql.GENERATIONS} SELECT id, gen::INT AS gen FROM gc")
def gen_chains(spark, sf):
    return generations.from_chains(generations.depths(corpus.reports(spark, sf)))


@query(f"WITH {sql.GENERATIONS} SELECT tabaqa::INT AS tabaqa, cal::INT AS cal FROM cal")
def gen_calibration(spark, sf):
    r, people = _gen(spark, sf)
    return generations.calibration(generations.from_chains(generations.depths(r)), people)


def _classed(r, people):
    c = generations.from_chains(generations.depths(r))
    return generations.with_classes(c, people, generations.calibration(c, people))


@query(f"WITH {sql.GENERATIONS} SELECT id, gen::INT AS gen, src FROM g0")
def gen_classes(spark, sf):
    return _classed(*_gen(spark, sf))


@query(f"WITH {sql.GENERATIONS} SELECT id, gen::INT AS gen, src FROM g4")
def gen_infer(spark, sf):
    r, people = _gen(spark, sf)
    return generations.infer(_classed(r, people), generations.depths(r))


@query(f"WITH {sql.GENERATIONS} SELECT gen::INT AS gen, closes::INT AS closes FROM lm")
def gen_landmarks(spark, sf):
    r, people = _gen(spark, sf)
    return generations.landmarks(generations.by_position(generations.infer(_classed(r, people), generations.depths(r)), generations.depths(r)), people)


@query(f"WITH {sql.GENERATIONS} SELECT id, gen::INT AS gen, src, sub FROM reg")
def gen_assign(spark, sf):
    return generations.assign(*_gen(spark, sf))


@query(f"WITH {sql.GENERATIONS} SELECT src, count(reg.id) AS n FROM (SELECT unnest(['chains', 'tabaqa', 'inferred', 'position', 'dates']) AS src) LEFT JOIN reg USING (src) GROUP BY src")
def gen_counts(spark, sf):
    every = spark.range(1).select(F.explode(F.array(*map(F.lit, ("chains", "tabaqa", "inferred", "position", "dates")))).alias("src"))
    return every.join(generations.assign(*_gen(spark, sf)).select("src", "id"), "src", "left").groupBy("src").agg(F.count("id").alias("n"))


# ---- linkage, joins, readers ------------------------------------------------------------------------------------------------
@query("""WITH t AS (SELECT source AS grp, doc_id AS id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
u AS (SELECT grp, k, CASE WHEN grp = 'src3' AND id % 97 = (SELECT min(doc_id % 97) FROM documents WHERE source = 'src3') THEN t.text || 'x' ELSE t.text END AS text, lang FROM t JOIN documents ON doc_id = id WHERE NOT (grp = 'src5' AND k = 1)),
n AS (SELECT grp, k, text, lang, row_number() OVER (PARTITION BY grp ORDER BY k) AS k2 FROM u),
j AS (SELECT coalesce(t.grp, n.grp) AS grp, t.id, n.lang, coalesce(t.text = n.text, false) AS ok FROM t FULL JOIN n ON t.grp = n.grp AND t.k = n.k2)
SELECT id, lang AS value FROM j WHERE grp IN (SELECT grp FROM j GROUP BY grp HAVING bool_and(ok))""")
def grade_positional_join(spark, sf):
    d = corpus.read(spark, sf, "documents").select(F.col("source").alias("grp"), F.col("doc_id").alias("pos"), F.col("doc_id").alias("id"), "text", "lang")
    least = d.filter("grp = 'src3'").agg(F.min(F.col("id") % 97).alias("m"))
    first = d.groupBy("grp").agg(F.min("id").alias("first"))
    other = d.join(F.broadcast(least)).join(first, "grp").filter(~((F.col("grp") == "src5") & (F.col("id") == F.col("first"))))
    theirs = other.select("grp", "pos", F.when((F.col("grp") == "src3") & (F.col("id") % 97 == F.col("m")), F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"), F.col("lang").alias("value"))
    return records.positional_join(d.select("grp", "pos", "id", "text"), theirs, reading=lambda c: c)  # Latin texts


@query("""WITH p AS (SELECT p_partkey AS id, string_split(lower(p_name), ' ') AS words FROM part),
e AS (SELECT p_partkey AS entry, string_split(lower(p_name || ' ' || p_type), ' ') AS head FROM part),
ek AS (SELECT entry, unnest(list_transform(range(2, least(len(head), 12) + 1), lambda k: array_to_string(head[1:k], ' '))) AS key FROM e),
pk AS (SELECT id, k AS matched, array_to_string(words[1:k], ' ') AS key FROM (SELECT id, words, unnest(range(2, least(len(words), 12) + 1)) AS k FROM p)),
h AS (SELECT id, entry, matched, max(matched) OVER (PARTITION BY id) AS best FROM pk JOIN ek USING (key))
SELECT id, entry, matched::INT AS matched FROM h WHERE matched = best""")
def prefix_align(spark, sf):
    part = corpus.read(spark, sf, "part")
    entries = part.select(F.col("p_partkey").alias("entry"), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ").alias("head"))
    namings = part.select(F.col("p_partkey").alias("id"), F.lit(0).alias("naming"), F.split(F.lower("p_name"), " ").alias("words"))
    return records.prefix_candidates(entries, namings).select("id", "entry", "matched")


@query("""WITH w AS (SELECT DISTINCT p_partkey AS entry, unnest(string_split(lower(p_type || ' ' || p_brand || ' x' || p_size), ' ')) AS word FROM part),
t AS (SELECT a.p_partkey AS id, b.p_partkey AS entry FROM part a JOIN part b ON a.p_size = b.p_size AND a.p_brand = b.p_brand),
rare AS (SELECT word FROM w GROUP BY word HAVING count(*) <= 40),
m AS (SELECT DISTINCT p_partkey AS id, unnest(string_split(lower(p_type || ' x' || p_size), ' ')) AS mark FROM part),
c AS (SELECT t.id, mark, count(DISTINCT t.entry) AS k, min(t.entry) AS entry FROM t JOIN m ON m.id = t.id JOIN rare ON word = mark JOIN w ON w.entry = t.entry AND w.word = mark WHERE length(mark) >= 3 GROUP BY t.id, mark),
x AS (SELECT DISTINCT id, entry FROM c WHERE k = 1)
SELECT id, min(entry) AS entry FROM x GROUP BY id HAVING count(*) = 1""")
def tie_break(spark, sf):
    part = corpus.read(spark, sf, "part")
    bag = lambda *c: F.explode(F.split(F.lower(F.concat_ws(" ", *c)), " "))
    size = F.concat(F.lit("x"), F.col("p_size").cast("string"))
    words = part.select(F.col("p_partkey").alias("entry"), bag("p_type", "p_brand", size).alias("word")).distinct()
    marks = part.select(F.col("p_partkey").alias("id"), bag("p_type", size).alias("mark"))
    b = part.select(F.col("p_partkey").alias("entry"), "p_size", "p_brand")
    tied = part.select(F.col("p_partkey").alias("id"), "p_size", "p_brand").join(b, ["p_size", "p_brand"]).select("id", "entry")
    return records.discriminate(tied, marks, words)


@query("""WITH n AS (SELECT p_partkey AS name_id, string_split(lower(p_name), ' ') AS w FROM part),
i AS (SELECT key, min(p_partkey) AS id FROM (SELECT p_partkey, unnest([lower(p_name), array_to_string(string_split(lower(p_name), ' ')[1:2], ' '), array_to_string(string_split(lower(p_name), ' ')[2:3], ' ')]) AS key FROM part) GROUP BY key),
s AS (SELECT name_id, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS st FROM n), r AS (SELECT name_id, n, st, unnest(range(1, n - st + 2)) AS ln, w FROM s),
h AS (SELECT name_id, st, ln, key, id FROM (SELECT name_id, n, st, ln, array_to_string(w[st:st + ln - 1], ' ') AS key FROM r) JOIN i USING (key) WHERE n = 1 OR ln >= 2)
SELECT name_id, key, id FROM (SELECT *, row_number() OVER (PARTITION BY name_id ORDER BY ln DESC, st) AS o FROM h) WHERE o = 1""")
def longest_span(spark, sf):
    part = corpus.read(spark, sf, "part")
    w = F.split(F.lower("p_name"), " ")
    keys = part.select("p_partkey", F.explode(F.array(F.lower("p_name"), F.array_join(F.slice(w, 1, 2), " "), F.array_join(F.slice(w, 2, 2), " "))).alias("key"))
    found = records.longest_span(part.select(F.col("p_partkey").alias("name_id"), w.alias("words")), keys.groupBy("key").agg(F.min("p_partkey").alias("ids")))
    return found.select("name_id", "key", F.col("ids").alias("id"))


@query("""WITH f AS (SELECT s_nationkey AS id, s_name AS name, s_suppkey % 7 AS file, s_suppkey AS pos FROM supplier)
SELECT id, name, file FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file, pos) AS o FROM f) WHERE o = 1""")
def first_id_wins(spark, sf):
    s = corpus.read(spark, sf, "supplier").select(F.col("s_nationkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 7).alias("file"), F.col("s_suppkey").alias("pos"))
    return records.first_wins([s.filter(F.col("file") == k) for k in range(7)]).select("id", "name", "file")


@query("""SELECT coalesce(v.id, e.id) AS id, coalesce(v.work, e.work) AS work, grade, entry FROM
(SELECT DISTINCT l_suppkey AS id, year(l_shipdate)::VARCHAR AS work, 'g' || (l_suppkey % 3) AS grade FROM lineitem WHERE l_returnflag = 'R') v
FULL JOIN (SELECT s_suppkey AS id, '1994' AS work, s_name AS entry FROM supplier) e ON v.id = e.id AND v.work = e.work""")
def verdicts_with_entries(spark, sf):
    v = corpus.read(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_suppkey").alias("id"), F.year("l_shipdate").cast("string").alias("work"), F.concat(F.lit("g"), (F.col("l_suppkey") % 3).cast("string")).alias("grade")).distinct()
    e = corpus.read(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("1994").alias("work"), F.col("s_name").alias("entry"))
    return records.with_entries(v, e)


@query("""WITH m AS (SELECT n_nationkey AS pos, n_name AS slug, CASE WHEN n_nationkey % 4 <> 0 THEN 200 + n_nationkey * 13 % 90 END AS died, 'old' AS state FROM nation WHERE n_nationkey < 15),
n AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey % 4 <> 0 THEN 200 + n_nationkey * 13 % 90 END, 'new' FROM nation WHERE n_nationkey >= 10),
u AS (SELECT * FROM m WHERE slug NOT IN (SELECT n_name FROM n) UNION ALL SELECT * FROM n)
SELECT slug, state, died::INT AS died, row_number() OVER (ORDER BY coalesce(died, 9999), pos)::INT AS place FROM u""")
def upsert_manifest(spark, sf):
    n = corpus.read(spark, sf, "nation").select(F.col("n_nationkey").alias("pos"), F.col("n_name").alias("slug"), F.when(F.col("n_nationkey") % 4 != 0, 200 + F.col("n_nationkey") * 13 % 90).cast("int").alias("died"))
    both = records.upsert(n.filter("pos < 15").withColumn("state", F.lit("old")), n.filter("pos >= 10").withColumn("state", F.lit("new")))
    return both.select("slug", "state", "died", F.row_number().over(Window.orderBy(F.coalesce("died", F.lit(9999)), "pos")).alias("place"))


@query("""WITH p AS (SELECT p_partkey AS id, p_name AS name, lower(p_name) AS f, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey, p_name),
q AS (SELECT (SELECT lower(string_split(p_name, ' ')[1]) FROM part WHERE p_partkey = 1) AS q),
t AS (SELECT id, n, CASE WHEN f = q THEN 0 WHEN starts_with(f, q) THEN 1 WHEN contains(f, q) THEN 2 END AS rank FROM p, q)
SELECT id, rank::INT AS rank, round(log10(1 + n) - CASE rank WHEN 0 THEN 0e0 WHEN 1 THEN 3e-1 ELSE 8e-1 END, 9) AS score FROM t WHERE rank IS NOT NULL ORDER BY log10(1 + n) - CASE rank WHEN 0 THEN 0e0 WHEN 1 THEN 3e-1 ELSE 8e-1 END DESC, id LIMIT 8""")
def name_search(spark, sf):
    part, lines = corpus.read(spark, sf, "part"), corpus.read(spark, sf, "lineitem")
    n = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    people = part.join(n, "p_partkey", "left").select(F.col("p_partkey").alias("id"), F.lit(None).cast("string").alias("ar"), F.col("p_name").alias("en"), F.coalesce("n", F.lit(0)).alias("n"), F.col("p_partkey").alias("pos"))
    needle = part.filter("p_partkey = 1").select(F.split("p_name", " ")[0].alias("q")).first().q
    return names.search(people, needle).select("id", "rank", F.round("score", 9).alias("score"))


@query("""WITH a AS (SELECT c_custkey AS id, c_acctbal AS x, c_nationkey * 100.0 + c_custkey % 100 AS z FROM customer)
SELECT a.id AS a, b.id AS b, round(sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2), 6) AS distance FROM a JOIN a b ON a.id < b.id AND abs(a.x - b.x) < 25 AND sqrt((a.x - b.x) ** 2 + (a.z - b.z) ** 2) < 25""")
def grid_pairs(spark, sf):
    c = corpus.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 100.0 + F.col("c_custkey") % 100).alias("z"))
    return records.grid_pairs(c, 25.0).select("a", "b", F.round("distance", 6).alias("distance"))


@query("""WITH l AS (SELECT conv_id AS doc, turn AS line_no, CASE WHEN turn % 3 = 0 THEN '### $ ' || turn || ' ' || text WHEN turn % 7 = 5 THEN '### $$$ ' || text ELSE '~~' || text END AS line FROM conversations),
g AS (SELECT *, sum(CASE WHEN starts_with(line, '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS rec FROM (SELECT doc, line_no, replace(line, chr(10), ' ') AS line FROM l)),
b AS (SELECT doc, rec, line_no, regexp_matches(line, '^### \\$ \\d+') AS head, regexp_extract(line, '^### \\$ (\\d+)', 1) AS n, CASE WHEN regexp_matches(line, '^### \\$ \\d+') THEN regexp_extract(line, '^### \\$ \\d+\\s*(.*)$', 1) WHEN starts_with(line, '~~') THEN line[3:] END AS body FROM g)
SELECT doc, max(CASE WHEN head THEN n END)::INT AS n, trim(regexp_replace(string_agg(body, ' ' ORDER BY line_no), '\\s+', ' ', 'g')) AS entry FROM b WHERE body IS NOT NULL GROUP BY doc, rec HAVING bool_or(head) AND trim(regexp_replace(string_agg(body, ' ' ORDER BY line_no), '\\s+', ' ', 'g')) <> ''""".replace("\\\\", "\\"))
def record_reader(spark, sf):
    c = corpus.read(spark, sf, "conversations")
    t = F.col("turn")
    line = F.when(t % 3 == 0, F.concat(F.lit("### $ "), t.cast("string"), F.lit(" "), F.col("text"))).when(t % 7 == 5, F.concat(F.lit("### $$$ "), F.col("text"))).otherwise(F.concat(F.lit("~~"), F.col("text")))
    return records.read_records(c.select(F.col("conv_id").alias("doc"), t.alias("line_no"), F.translate(line, "\n", " ").alias("line")))



GOLDEN = 2.399963229728653  # the golden angle in radians


@query(f"""WITH {sql.GENERATIONS}, m AS (SELECT id, gen, gen + CAST(0.66 AS DOUBLE) * sub AS pl, row_number() OVER (PARTITION BY gen ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY gen) AS c, max(gen) OVER () * 58 AS h FROM reg)
SELECT id, round((18 + sqrt(c) * 5) * CASE WHEN c = 1 THEN 0 ELSE sqrt((i + 0.5) / c) END * cos(i * {GOLDEN}), 4) AS x, round(h / 2.0 - pl * 58, 4) AS y, round((18 + sqrt(c) * 5) * CASE WHEN c = 1 THEN 0 ELSE sqrt((i + 0.5) / c) END * sin(i * {GOLDEN}), 4) AS z FROM m""")
def layout_seed(spark, sf):
    from ..operators.layout import seed

    s = seed(_registry(spark, sf))
    return s.select("id", *[F.round(c, 4).alias(c) for c in "xyz"])


@query(f"""WITH {sql.GENERATIONS}, m AS (SELECT id, gen, row_number() OVER (PARTITION BY gen ORDER BY id) - 1 AS i, count(*) OVER (PARTITION BY gen) AS c, max(gen) OVER () * 58 AS h FROM reg)
SELECT gen::INT AS gen, round(max(h) / 2.0 - gen * 58, 4) AS y, round(max((18 + sqrt(c) * 5) * CASE WHEN c = 1 THEN 0 ELSE sqrt((i + 0.5) / c) END), 4) AS radius, count(*) AS n FROM m GROUP BY gen""")
def layout_bands(spark, sf):
    from ..operators.layout import bands, seed

    b = bands(seed(_registry(spark, sf)))
    return b.select("gen", F.round("y", 4).alias("y"), F.round("radius", 4).alias("radius"), "n")


# ---- views, catalogue, drawing ------------------------------------------------------------------------------------------------
_VIEW_SQL = "AND id IN (SELECT id FROM k WHERE nar = 'r1')"


@query(f"WITH {sql.KINDS} SELECT id FROM kd WHERE n > 0 AND slug IN ('1-URGENT', '2-HIGH') {_VIEW_SQL} AND {sql.matches(['unreached', 'women', 'backward', 'peer'])}")
def view_compiled(spark, sf):
    from .view import View, compile_view

    v = View().toggle_book("1-URGENT").toggle_book("2-HIGH").toggle_book("5-LOW").toggle_book("5-LOW").isolate("r1")
    for k in ("unreached", "women", "backward", "peer"):
        v = v.toggle_kind(k)
    return compile_view(View.load(v.save()), corpus.reports(spark, sf), _registry(spark, sf)).select("id")


@query(f"WITH {sql.CORPUS} SELECT id FROM r WHERE slug = '3-MEDIUM' AND chapter = 1995")
def view_falls_back(spark, sf):
    """A search without hits leaves the collections in scope."""
    from .view import View, select

    r = corpus.reports(spark, sf)
    return select(View().toggle_chapter("3-MEDIUM", 1995), r, r.limit(0)).select("id")


@query(f"WITH {sql.CORPUS} SELECT id FROM r WHERE id IN (1, 2, 3)")
def view_pinned(spark, sf):
    from .view import View, select

    r = corpus.reports(spark, sf)
    return select(View(books=("1-URGENT",)).pin(1, 2, 3), r, r).select("id")


@query(f"WITH {sql.CORPUS}, w AS (SELECT node, count(DISTINCT id) AS weight FROM (SELECT id, src AS node FROM steps UNION SELECT id, dst FROM steps) GROUP BY node) SELECT DISTINCT node, weight FROM (SELECT * FROM (SELECT * FROM w ORDER BY weight DESC, node LIMIT 12) UNION ALL SELECT * FROM w WHERE (SELECT count(*) FROM w) <= 60 UNION ALL SELECT * FROM w WHERE node = 'r3')")
def graph_labels(spark, sf):
    from .view import labels

    return labels(chains.nodes(corpus.reports(spark, sf)), also=("r3",))


@query(f"""WITH {sql.GENERATIONS}, {_TYPED}, c AS (SELECT least(1e0, greatest(22e-2, 5000e0 / count(*))) AS density FROM te)
SELECT src, dst, round(CASE WHEN kind = 'backward' OR gap THEN greatest(b, 26e-2) * greatest(density, 5e-1) ELSE b * density END, 9) AS intensity FROM (SELECT *, least(5e-2 + ln(1 + weight) * 75e-3, 42e-2) AS b FROM te), c""")
def edge_intensity(spark, sf):
    from .view import edge_intensity as bright

    e = chains.typed_edges(corpus.reports(spark, sf), _registry(spark, sf))
    pairs = e.agg(F.count("*").alias("pairs"))
    return e.crossJoin(pairs).select("src", "dst", F.round(bright(F.col("weight"), F.col("kind"), F.col("gap"), F.col("pairs")), 9).alias("intensity"))  # one row


@query(f"WITH {sql.CORPUS} SELECT slug, min(id) AS id FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY id) AS ref FROM r) WHERE ref = 7 AND starts_with(lower(slug), '1') GROUP BY slug")
def find_reference(spark, sf):
    from .view import find_reference as find

    r = corpus.reports(spark, sf).select("slug", "id", F.col("slug").alias("title"))
    return find(r.withColumn("ref", F.row_number().over(Window.partitionBy("slug").orderBy("id"))), "1:7")


@query("SELECT c_custkey AS id, c_name AS en FROM customer WHERE contains(lower(c_name), '12') ORDER BY id LIMIT 200")
def find_chapters(spark, sf):
    from .view import find_chapters as find

    c = corpus.read(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("en"), F.lit("").alias("ar"))
    return find(c, " 12 ").select("id", "en")


@query("SELECT slug, died::INT AS died, n IS NOT NULL AS ingested FROM (VALUES ('bukhari', 256), ('muslim', 261), ('abudawud', 275), ('tirmidhi', 279), ('nasai', 303), ('ibnmajah', 273), ('malik', 179), ('darimi', 255), ('ahmed', 241), ('aladab_almufrad', 256), ('shamail_muhammadiyah', 279)) b(slug, died) LEFT JOIN (VALUES ('malik', 3), ('ahmed', 5)) m(s, n) ON s = slug")
def catalogue(spark, sf):
    from ..sources.catalogue import catalogue as listing

    manifest = spark.createDataFrame([("malik", 3), ("ahmed", 5)], "slug string, reports int")
    return listing(spark, manifest).select("slug", F.col("author_died").alias("died"), "ingested")


@query("SELECT key, value FROM (VALUES ('هشام', 'عروه'), ('ابو بكر', 'c')) t(key, value)")
def relation_map(spark, sf):
    from ..sources.catalogue import relation_map as read

    given = spark.sql("""SELECT '{"_note": "x", "هشام": "عروه", "أبو بكر": "b", "ابو بكر": "c", "زيد": null}' AS j""")
    return given.select(F.explode(read(F.col("j"))).alias("e")).select("e.key", "e.value")


@query("""WITH b AS (SELECT l_suppkey AS id, l_returnflag AS slug, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT id, string_agg(slug || ':' || n, ',' ORDER BY n DESC, slug) AS books FROM b GROUP BY id""")
def books_of_transmitter(spark, sf):
    per = corpus.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("slug")).agg(F.count("*").alias("n"))
    as_map = per.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("slug", "n"))).alias("books"))
    ordered = F.array_sort(F.transform(F.map_entries("books"), lambda e: F.struct((-e["value"]).alias("k"), e["key"].alias("slug"))))
    return as_map.select("id", F.array_join(F.transform(ordered, lambda e: F.concat(e["slug"], F.lit(":"), (-e["k"]).cast("string"))), ",").alias("books"))


@query("""WITH x AS (SELECT l_suppkey AS s, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS t FROM lineitem), p AS (SELECT DISTINCT s, t FROM x WHERE s <> t)
SELECT 'r' || s AS id, string_agg('r' || t, ',' ORDER BY 'r' || t) AS teachers FROM p WHERE t IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY s""")
def present_teachers(spark, sf):
    """Those who stand next on an order as teachers, only the present ones; none is no row."""
    behind = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    claims = corpus.read(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.lead("l_suppkey").over(behind).alias("t")).filter("s <> t").distinct()
    present = corpus.read(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("t"))
    r = lambda c: F.concat(F.lit("r"), F.col(c).cast("string"))
    return records.present_only(claims.select(r("s").alias("id"), r("t").alias("other")), present.select(r("t").alias("id"))).select("id", F.array_join("others", ",").alias("teachers"))


@query("SELECT n_nationkey AS id, length(CAST('{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS VARCHAR))::INT AS bytes FROM nation")
def json_bytes(spark, sf):
    from ..sources.catalogue import json_bytes as size

    return corpus.read(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), size("n_name", "n_regionkey").alias("bytes"))


@query("""WITH t AS (SELECT p_partkey AS id, p_name AS ar, p_brand AS k FROM part), ku AS (SELECT p_brand AS k, min(p_type) AS en FROM part WHERE p_size < 10 GROUP BY p_brand), nm AS (SELECT p_name AS k, min(p_type) AS en FROM part WHERE p_size > 40 GROUP BY p_name)
SELECT id, coalesce(ku.en, nm.en) AS en FROM t LEFT JOIN ku ON ku.k = t.k LEFT JOIN nm ON nm.k = t.ar""")
def two_key_lookup(spark, sf):
    """A label by the surface, else by the full name."""
    part = corpus.read(spark, sf, "part")
    by_surface = part.filter("p_size < 10").groupBy("p_brand").agg(F.min("p_type").alias("e1"))
    by_name = part.filter("p_size > 40").groupBy("p_name").agg(F.min("p_type").alias("e2"))
    return part.join(by_surface, "p_brand", "left").join(by_name, "p_name", "left").select(F.col("p_partkey").alias("id"), F.coalesce("e1", "e2").alias("en"))


@query(f"""WITH {sql.GENERATIONS}, ap AS (SELECT id, count(*) AS n FROM d GROUP BY id), ta AS (SELECT nar AS id, count(*) FILTER (WHERE f <> 'R') AS clear, count(*) FILTER (WHERE f = 'R') AS uncertain FROM k GROUP BY nar),
pe AS (SELECT *, CASE WHEN tabaqa = 1 THEN 'companion' WHEN died > 250 THEN 'weak' ELSE 'reliable' END AS grade FROM s WHERE id <> 'r4')
SELECT ap.id, CASE WHEN ap.id = 'prophet' THEN 'prophet' WHEN starts_with(ap.id, 'collector:') THEN ap.id[11:] ELSE coalesce(name, ap.id) END AS ar,
  CASE WHEN ap.id = 'prophet' THEN 'companion' WHEN starts_with(ap.id, 'collector:') THEN 'reliable' ELSE coalesce(grade, 'unknown') END AS grade, CASE WHEN ap.id = 'prophet' THEN 0 ELSE gen END::INT AS gen,
  reg.src, CASE WHEN ap.id = 'prophet' THEN 0 ELSE reg.sub END AS sub, pe.died::INT AS died, n, ap.id = 'prophet' OR starts_with(ap.id, 'collector:') OR name IS NOT NULL AS resolved,
  coalesce(name IS NOT NULL AND uncertain > clear, false) AS ambiguous, coalesce(pe.woman, false) AS woman
FROM ap LEFT JOIN reg ON reg.id = ap.id LEFT JOIN pe ON pe.id = ap.id LEFT JOIN ta ON ta.id = ap.id""")
def registry_describe(spark, sf):
    from ..operators.registry import describe

    r, people = _gen(spark, sf)
    graded = people.filter("id <> 'r4'").withColumn("grade", F.when(F.col("tabaqa") == 1, "companion").when(F.col("died") > 250, "weak").otherwise("reliable"))
    n = generations.depths(r).groupBy("id").agg(F.count("*").alias("n"))
    none = spark.createDataFrame([], "id string, surface string")
    return describe(n, generations.assign(r, people), graded, QUERIES["identification_tally"](spark, sf), none)


@query(f"WITH {sql.CORPUS} SELECT count(DISTINCT slug) AS books, count(DISTINCT r.id) AS reports, count(DISTINCT k.id) AS chains FROM r LEFT JOIN k ON r.id = k.id")
def totals(spark, sf):
    from ..operators.registry import totals as add_up

    return add_up(QUERIES["book_summary"](spark, sf))


@query(f"WITH {sql.CORPUS} SELECT s.id, name FROM s WHERE id IN (SELECT nar FROM k WHERE f = 'A')")
def used_profiles(spark, sf):
    """Profiles that occur in a chain of a report that reaches the apex or not: a semi-join, never a broadcast by hint."""
    line = corpus.read(spark, sf, "lineitem")
    ordered = line.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag"))).alias("x"))
    kept = ordered.select(F.explode(F.filter("x", lambda v, i: (i == 0) | (v["l_suppkey"] != F.get(F.col("x"), i - 1)["l_suppkey"]))).alias("v")).filter("v.l_returnflag = 'A'")
    return corpus.transmitters(spark, sf).join(kept.select(F.concat(F.lit("r"), F.col("v.l_suppkey").cast("string")).alias("id")), "id", "left_semi").select("id", "name")
