"""Who is meant: profiles, verdicts, companionship, and the scored choice among namesakes along a chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .parse import NON_NAME_SPANS

GRADES = ["reliable", "mostly_reliable", "weak", "abandoned", "fabricator"]
LAST_COMPANION, LINK_EVIDENCE, CLEAR_MARGIN, SWEEPS = 120, 10, 3, 2

#: A candidate for one place of a chain. Years, class and links are null or empty where the sources are silent.
CANDIDATE = "struct<id:bigint,grade:string,full:string,digits:boolean,verdicts:int,namings:int,words:int,tabaqa:int,died:int,weight:double,teachers:array<bigint>,students:array<bigint>>"


def read_verdicts(sources: DataFrame) -> DataFrame:
    """id, key, grade_en, grade_ar from id, key, grade_en, grade_ar, pos: empties away, a missing English grade read from Arabic."""
    ar, en = text.clean_value(F.col("grade_ar")), text.clean_value(F.col("grade_en"))
    silent = en.isNull() | (en == "unknown")
    kept = sources.withColumn("ar", ar).withColumn("en", en).withColumn("silent", silent).filter(F.col("ar").isNotNull() | ~F.col("silent"))
    read = F.when(F.col("silent"), F.coalesce(text.grade_from_arabic(F.col("ar")), F.col("en"))).otherwise(F.col("en"))
    return kept.select("id", "key", read.alias("grade_en"), F.col("ar").alias("grade_ar"), "pos")


# ---- fixed values: the works of criticism, by the keys of the sources ------------------------------------------------
_IBN_HAJAR, _DHAHABI = "Ibn Ḥajar al-ʿAsqalānī (d. 852 AH)", "al-Dhahabī (d. 748 AH)"
WORKS = [
    ("taqrib", "Taqrīb al-Tahdhīb", _IBN_HAJAR),
    ("tahdhib_tahdhib", "Tahdhīb al-Tahdhīb", _IBN_HAJAR),
    ("tahdhib_kamal", "Tahdhīb al-Kamāl", "al-Mizzī (d. 742 AH)"),
    ("isaba", "al-Iṣāba fī Tamyīz al-Ṣaḥāba", _IBN_HAJAR),
    ("lisan_mizan", "Lisān al-Mīzān", _IBN_HAJAR),
    ("durar_kamina", "al-Durar al-Kāmina", _IBN_HAJAR),
    ("jarh", "al-Jarḥ wa-l-Taʿdīl", "Ibn Abī Ḥātim al-Rāzī (d. 327 AH)"),
    ("thiqat", "al-Thiqāt", "Ibn Ḥibbān al-Bustī (d. 354 AH)"),
    ("kamil", "al-Kāmil fī Ḍuʿafāʾ al-Rijāl", "Ibn ʿAdī al-Jurjānī (d. 365 AH)"),
    ("tabaqat", "al-Ṭabaqāt al-Kubrā", "Ibn Saʿd (d. 230 AH)"),
    ("tarikh", "al-Tārīkh al-Kabīr", "al-Bukhārī (d. 256 AH)"),
    ("mizan", "Mīzān al-Iʿtidāl", _DHAHABI),
    ("kashif", "al-Kāshif", _DHAHABI),
    ("siyar", "Siyar Aʿlām al-Nubalāʾ", _DHAHABI),
    ("tarikh_islam", "Tārīkh al-Islām", _DHAHABI),
    ("tadhkirat_huffaz", "Tadhkirat al-Ḥuffāẓ", _DHAHABI),
    ("mughni_ducafa", "al-Mughnī fī al-Ḍuʿafāʾ", _DHAHABI),
    ("diwan_ducafa", "Dīwān al-Ḍuʿafāʾ", _DHAHABI),
    ("dhayl_diwan", "Dhayl Dīwān al-Ḍuʿafāʾ", _DHAHABI),
    ("mucin_tabaqat", "al-Muʿīn fī Ṭabaqāt al-Muḥaddithīn", _DHAHABI),
    ("mucjam_shuyukh", "Muʿjam al-Shuyūkh", _DHAHABI),
    ("macrifa_qurra", "Maʿrifat al-Qurrāʾ al-Kibār", _DHAHABI),
]


def with_works(verdicts: DataFrame, dhahabi: DataFrame) -> DataFrame:
    """Verdicts (id, key, grade_en, grade_ar, pos) and al-Dhahabi's own word (id, dhahabi) on those whom the Kashif leaves out; work, author."""
    word = text.clean_value(F.col("dhahabi"))
    own = dhahabi.select("id", word.alias("grade_ar")).filter("grade_ar is not null").join(verdicts.filter("key = 'kashif'").select("id"), "id", "left_anti")
    last = F.lit((1 << 31) - 1)
    every = verdicts.unionByName(own.select("id", F.lit("dhahabi").alias("key"), text.grade_from_arabic(F.col("grade_ar")).alias("grade_en"), "grade_ar", last.alias("pos")))
    works = verdicts.sparkSession.createDataFrame([*WORKS, ("dhahabi", "al-Dhahabī", None)], "key string, work string, author string")
    return every.join(F.broadcast(works), "key", "left").withColumn("work", F.coalesce("work", "key"))  # a fixed table


def facts(profiles: DataFrame, verdicts: DataFrame) -> DataFrame:
    """id, tabaqa, weight: the class by number, else by its wording; verdicts count one each, the source's score a hundredth."""
    n = verdicts.groupBy("id").agg(F.count("*").alias("n"))
    joined = profiles.join(n, "id", "left")
    return joined.select("id", F.coalesce("generation", text.parse_class(F.col("tabaqat"))).alias("tabaqa"), (F.coalesce("n", F.lit(0)) + F.coalesce("id_score", F.lit(0.0)) / 100).alias("weight"))


def name_index(namings: DataFrame) -> DataFrame:
    """key, ids (ascending) from id, key: whom a name may mean. Spans that name nobody are no keys."""
    return namings.filter(~F.col("key").isin(NON_NAME_SPANS)).groupBy("key").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def reconcile(grade: Column, tabaqa: Column, died: Column, verdicts: Column) -> Column:
    """The grade after companionship is checked against class and death; verdicts: array of English grades."""
    first = F.coalesce(*[F.when(F.array_contains(verdicts, g), g) for g in GRADES], F.lit("unknown"))
    impossible = F.coalesce(tabaqa > 1, F.lit(False)) | F.coalesce(died > LAST_COMPANION, F.lit(False))
    return F.when(grade == "companion", F.when(impossible, first).otherwise(grade)).when(tabaqa == 1, "companion").when(grade == "unknown", first).otherwise(grade)


def namings(profiles: DataFrame) -> DataFrame:
    """id, pos, naming, key: full name first, then its namings; one spelling a key."""
    listed = profiles.select("id", F.posexplode(F.concat(F.array("full_name"), F.coalesce("namings", F.array().cast("array<string>")))).alias("pos", "raw"))
    keyed = listed.select("id", "pos", text.clean_value(F.col("raw")).alias("naming")).withColumn("key", text.normalise_key(F.col("naming"))).filter("key <> ''")
    return keyed.groupBy("id", "key").agg(F.min(F.struct("pos", "naming")).alias("x")).select("id", "x.pos", "x.naming", "key")


def score(c: Column, earlier: Column, later: Column, key: Column, at_head: Column) -> Column:
    """How well a candidate fits between its neighbours. earlier stands nearer the apex and taught him."""
    pts = lambda cond, n, other=0.0: F.when(F.coalesce(cond, F.lit(False)), float(n)).otherwise(float(other))
    known = lambda a, b: a.isNotNull() & b.isNotNull()
    order = lambda a, b, good, bad, ok: F.when(F.coalesce(known(a, b), F.lit(False)), F.when(ok, float(good)).otherwise(float(bad))).otherwise(0.0)
    begins = lambda k: c["full"].startswith(F.concat(k, F.lit(" ")))
    father = F.substring(key, 5, 1 << 20)
    name = F.when(c["verdicts"] > 0, F.when(c["full"] == key, 8.0).when(begins(key), 6.0).otherwise(0.0)).otherwise(0.0)
    links = pts(F.array_contains(c["teachers"], earlier["id"]), LINK_EVIDENCE) + pts(F.array_contains(earlier["students"], c["id"]), LINK_EVIDENCE) + pts(F.array_contains(c["students"], later["id"]), LINK_EVIDENCE) + pts(F.array_contains(later["teachers"], c["id"]), LINK_EVIDENCE)
    times = order(c["tabaqa"], earlier["tabaqa"], 4, -6, c["tabaqa"] > earlier["tabaqa"]) + order(c["tabaqa"], later["tabaqa"], 4, -6, c["tabaqa"] < later["tabaqa"]) + order(c["died"], earlier["died"], 2, -4, c["died"] > earlier["died"]) + order(c["died"], later["died"], 2, -4, c["died"] < later["died"])
    head = pts(at_head & (c["grade"] == "companion"), 6) + pts(at_head & (c["died"] > LAST_COMPANION), -12)
    son = pts(key.startswith("ابن ") & ((c["full"] == father) | begins(father)), -14)
    own = pts(c["digits"], -10) + F.least(c["namings"], F.lit(20)) * 0.15 + pts(c["words"] >= 4, 2)
    return head + name + son + own + links + times + F.least(c["weight"], F.lit(8.0)) / 10


def resolve(chains: DataFrame) -> DataFrame:
    """chains with `resolved`: for each place struct<id, ambiguous>, by two sweeps in which earlier choices count.

    chains: reached, places: array<struct<key, candidates: array<CANDIDATE>>>, the compiler's teacher first; chains are
    short, so a sweep is one fold over the places. Ties keep the first candidate.
    """
    none = F.lit(None).cast(CANDIDATE)
    n = F.size("places")
    start = F.transform("places", lambda p: F.struct(F.when(F.size(p["candidates"]) == 1, F.get(p["candidates"], F.lit(0))).otherwise(none).alias("who"), F.lit(False).alias("amb")))

    def settle(state: Column, i: Column) -> Column:
        place = F.get(F.col("places"), i)
        at_head = F.col("reached") & (i == n - 1)
        scored = F.transform(place["candidates"], lambda c, k: F.struct(score(c, F.get(state, i + 1)["who"], F.get(state, i - 1)["who"], place["key"], at_head).alias("s"), (-k).alias("k"), c.alias("c")))
        best = F.aggregate(scored, F.struct(F.lit(float("-inf")).alias("s"), F.lit(float("-inf")).alias("second"), none.alias("c")), lambda a, x: F.when(x["s"] > a["s"], F.struct(x["s"].alias("s"), a["s"].alias("second"), x["c"].alias("c"))).otherwise(F.struct(a["s"].alias("s"), F.greatest(a["second"], x["s"]).alias("second"), a["c"].alias("c"))))
        new = F.struct(best["c"].alias("who"), (best["s"] - best["second"] < CLEAR_MARGIN).alias("amb"))
        return F.when(F.size(place["candidates"]) > 1, F.transform(state, lambda x, k: F.when(k == i, new).otherwise(x))).otherwise(state)

    order = F.when(n > 0, F.flatten(F.array_repeat(F.sequence(F.lit(0), n - 1), SWEEPS))).otherwise(F.array().cast("array<int>"))
    end = F.aggregate(order, start, settle)
    return chains.withColumn("resolved", F.transform(end, lambda x: F.struct(x["who"]["id"].alias("id"), x["amb"].alias("ambiguous"))))
