"""A small corpus of literals that places people in every way: by chains, inference, position and dates, with landmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generations, resolve
from . import sql
from .corpus_queries import ORACLES, QUERIES, query

#: (slug, to_apex, chain) of each report; three of each anchored chain, since so many places a person.
REPORTS = [("m", True, [f"a{i}", f"b{i}", f"c{i}"]) for i in range(1, 25) for _ in range(3)]
REPORTS += [("m", True, [x]) for x in ("late", "old") for _ in range(3)]
REPORTS += [("q", False, [f"w{i}" for i in range(1, 11)]), ("q", False, ["b1", "x1", "y1"]), ("t", False, ["b2", "x1"]), ("t", False, ["c3", "y2", "b4"])]
#: (id, class, death year) of people; a later generation dies some fifty years after the one before.
PEOPLE = [(f"{g}{i}", None, 40 + 50 * k + i) for k, g in enumerate("abc") for i in range(1, 25)]
PEOPLE += [("late", None, 300), ("old", None, 150), ("x1", None, 120), ("w2", None, None), ("y2", 7, 180)]


def _rows(values: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() for x in row) + ")" for row in values)


_LINKS = [(k, x, "A", at, len(chain)) for k, (_, _, chain) in enumerate(REPORTS) for at, x in enumerate(chain)]
SMALL = f"""r AS (SELECT * FROM (VALUES {_rows([(k, slug, apex) for k, (slug, apex, _) in enumerate(REPORTS)])}) t(id, slug, to_apex)),
k AS (SELECT * FROM (VALUES {_rows(_LINKS)}) t(id, nar, f, pos, n)),
s AS (SELECT id, id AS name, tabaqa::INT AS tabaqa, died::INT AS died, false AS woman FROM (VALUES {_rows(PEOPLE)}) t(id, tabaqa, died))""" + sql.GENERATION_STEPS


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    reports = spark.createDataFrame([(k, slug, apex, chain) for k, (slug, apex, chain) in enumerate(REPORTS)], "id long, slug string, to_apex boolean, chain array<string>")
    return reports, spark.createDataFrame(PEOPLE, "id string, tabaqa int, died int")


def _inferred(spark: SparkSession) -> DataFrame:
    reports, people = _tables(spark)
    depth = generations.depths(reports)
    chains = generations.from_chains(depth)
    return generations.by_position(generations.infer(generations.with_classes(chains, people, generations.calibration(chains, people)), depth), depth)


@query(f"WITH {SMALL} SELECT id, gen::INT AS gen, src FROM gp")
def small_infer(spark, sf):
    """Sweeps that place people, and positions for those beyond their reach."""
    return _inferred(spark)


@query(f"WITH {SMALL} SELECT gen::INT AS gen, closes::INT AS closes FROM lm")
def small_landmarks(spark, sf):
    return generations.landmarks(_inferred(spark), _tables(spark)[1])


@query(f"WITH {SMALL} SELECT id, gen::INT AS gen, src, sub FROM reg")
def small_assign(spark, sf):
    return generations.assign(*_tables(spark))


@query(f"WITH {SMALL} SELECT src, count(*) AS n FROM reg GROUP BY src")
def small_counts(spark, sf):
    return generations.assign(*_tables(spark)).groupBy("src").agg(F.count("*").alias("n"))


# ---- profiles and verdicts --------------------------------------------------------------------------------------------
@query("SELECT * FROM (VALUES (1, 'taqrib', 'Taqrīb al-Tahdhīb', 'Ibn Ḥajar al-ʿAsqalānī (d. 852 AH)', 'reliable'), (1, 'dhahabi', 'al-Dhahabī', NULL, 'weak'), (2, 'kashif', 'al-Kāshif', 'al-Dhahabī (d. 748 AH)', 'weak'), (3, 'other', 'other', NULL, 'reliable')) t(id, key, work, author, grade_en)")
def verdict_works(spark, sf):
    """Verdicts with their works, and al-Dhahabi's own where there is none from the Kashif."""
    given = spark.sql("SELECT * FROM VALUES (1, 'taqrib', NULL, 'ثقة', 0), (2, 'kashif', 'weak', NULL, 0), (3, 'other', NULL, 'ثقة', 0) AS t(id, key, grade_en, grade_ar, pos)")
    own = spark.sql("SELECT * FROM VALUES (1, 'ضعيف'), (2, 'ثقة'), (3, '-') AS t(id, dhahabi)")
    return resolve.with_works(resolve.read_verdicts(given), own).select("id", "key", "work", "author", "grade_en")


@query("SELECT * FROM (VALUES (1, 5, 2.5::DOUBLE), (2, 12, 0::DOUBLE), (3, NULL, 1::DOUBLE)) t(id, tabaqa, weight)")
def profile_facts(spark, sf):
    """The numbered class before the worded one; verdicts and the source's own score as weight."""
    given = spark.sql("SELECT * FROM VALUES (1L, 5, 'الثانية', 50.0D), (2L, NULL, 'الثانية عشرة', NULL), (3L, NULL, NULL, 0D) AS t(id, generation, tabaqat, id_score)")
    verdicts = spark.sql("SELECT * FROM VALUES (1L), (1L), (3L) AS t(id)")
    return resolve.facts(given, verdicts).select("id", "tabaqa", "weight")


@query("SELECT * FROM (VALUES ('زيد بن ثابت', '1,3'), ('ابو هريره', '2')) t(key, ids)")
def name_index(spark, sf):
    """Ids by the lookup form of their names, without the spans that name nobody."""
    given = spark.sql("SELECT * FROM VALUES (1, 'زيد بن ثابت'), (2, 'أبو هريرة'), (3, 'زَيد بن ثابت'), (4, 'قوله') AS t(id, naming)")
    keyed = given.withColumn("key", resolve.text.normalise_key(F.col("naming")))
    return resolve.name_index(keyed).select("key", F.array_join("ids", ",").alias("ids"))


@query("SELECT * FROM (VALUES (1, 'a', 'g', 'x', true), (1, 'b', 'g', NULL, false), (2, 'a', NULL, 'y', true), (3, 'a', 'h', NULL, true)) t(id, work, grade, entry, read)")
def verdicts_read(spark, sf):
    """Verdicts with entries, and whether the work has been read at all."""
    from ..operators import records

    v = spark.sql("SELECT * FROM VALUES (1, 'a', 'g'), (1, 'b', 'g'), (3, 'a', 'h') AS t(id, work, grade)")
    e = spark.sql("SELECT * FROM VALUES (1, 'a', 'x'), (2, 'a', 'y') AS t(id, work, entry)")
    return records.with_entries(v, e, ["a"])


@query("SELECT * FROM (VALUES (1, 'sahih'), (2, 'hasan')) t(id, value)")
def grade_join_letters(spark, sf):
    """Chapters join by place if all their texts have the same letters, whatever their marks and stops."""
    from ..operators import records

    ours = spark.sql("SELECT * FROM VALUES ('1', 1, 1, 'قَالَ زيد'), ('1', 2, 2, 'قال عمرو.'), ('2', 1, 3, 'قال') AS t(grp, pos, id, text)")
    theirs = spark.sql("SELECT * FROM VALUES ('1', 1, 'قال زيد،', 'sahih'), ('1', 2, 'قال عَمرو', 'hasan'), ('2', 1, 'كان', 'daif') AS t(grp, pos, text, value)")
    return records.positional_join(ours, theirs)


@query(f"WITH {sql.GENERATIONS}, f AS (SELECT id, report, row_number() OVER (PARTITION BY id ORDER BY report, depth) AS k FROM d WHERE id <> 'prophet') SELECT id, string_agg(report::VARCHAR, ',' ORDER BY report) AS pins FROM f WHERE k <= 60 GROUP BY id")
def show_only_these(spark, sf):
    """The first sixty of a transmitter's reports, which become the pins."""
    from .view import first_pins

    reports = QUERIES["registry_reports"](spark, sf)
    return reports.select("id", F.array_join(first_pins(F.split("reports", ",")), ",").alias("pins"))


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderkey LIMIT 360")
def third_page(spark, sf):
    """What a list shows after two requests for more."""
    from ..sources import corpus
    from .view import page

    return page(corpus.read(spark, sf, "orders").select(F.col("o_orderkey").alias("id")).orderBy("id"), 2)


@query("WITH w AS (SELECT l_suppkey AS id, count(*) AS weight FROM lineitem GROUP BY l_suppkey) SELECT id, round(0.16::DOUBLE * (1 + ln(1 + weight) * 0.32::DOUBLE), 9) AS radius FROM w")
def node_radius(spark, sf):
    from ..sources import corpus
    from .view import node_radius as radius

    w = corpus.read(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("weight"))
    return w.select("id", F.round(radius(F.col("weight")), 9).alias("radius"))


__all__ = ["ORACLES", "QUERIES"]
