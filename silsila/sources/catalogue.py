"""The catalogue of collections, relation maps, and versioned artefacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text

# ---- fixed values: the collections -------------------------------------------------------------------------------
BOOKS = [
    ("bukhari", "Sahih al-Bukhari", "صحيح البخاري", "Muḥammad ibn Ismāʿīl al-Bukhārī", "محمد بن إسماعيل البخاري", 256, None),
    ("muslim", "Sahih Muslim", "صحيح مسلم", "Muslim ibn al-Ḥajjāj al-Naysābūrī", "مسلم بن الحجاج النيسابوري", 261, None),
    ("abudawud", "Sunan Abi Dawud", "سنن أبي داود", "Abū Dāwūd al-Sijistānī", "أبو داود السجستاني", 275, "abudawud"),
    ("tirmidhi", "Jami' at-Tirmidhi", "جامع الترمذي", "Abū ʿĪsā al-Tirmidhī", "أبو عيسى الترمذي", 279, "tirmidhi"),
    ("nasai", "Sunan an-Nasa'i", "سنن النسائي", "Aḥmad ibn Shuʿayb al-Nasāʾī", "أحمد بن شعيب النسائي", 303, "nasai"),
    ("ibnmajah", "Sunan Ibn Majah", "سنن ابن ماجه", "Ibn Mājah al-Qazwīnī", "ابن ماجه القزويني", 273, "ibnmajah"),
    ("malik", "Muwatta Malik", "موطأ مالك", "Mālik ibn Anas", "مالك بن أنس", 179, None),
    ("darimi", "Sunan ad-Darimi", "سنن الدارمي", "ʿAbd Allāh ibn ʿAbd al-Raḥmān al-Dārimī", "عبد الله بن عبد الرحمن الدارمي", 255, None),
    ("ahmed", "Musnad Ahmad", "مسند أحمد", "Aḥmad ibn Ḥanbal", "أحمد بن حنبل", 241, None),
    ("aladab_almufrad", "Al-Adab Al-Mufrad", "الأدب المفرد", "Muḥammad ibn Ismāʿīl al-Bukhārī", "محمد بن إسماعيل البخاري", 256, None),
    ("shamail_muhammadiyah", "Shamail al-Muhammadiyah", "الشمائل المحمدية", "Abū ʿĪsā al-Tirmidhī", "أبو عيسى الترمذي", 279, None),
]
BOOK_SCHEMA = "slug string, title_en string, title_ar string, author_en string, author_ar string, author_died int, grades_from string"


def books(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOOKS, BOOK_SCHEMA)


def find_book(slug: str) -> tuple:
    """A collection's row; an unknown slug is an error."""
    for row in BOOKS:
        if row[0] == slug:
            return row
    raise KeyError(f"no collection named {slug!r}; known: {', '.join(r[0] for r in BOOKS)}")


def catalogue(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every collection with its counts, and whether it has been ingested (is in the manifest)."""
    return books(spark).join(manifest, "slug", "left").withColumn("ingested", F.col("reports").isNotNull())


def relation_map(json: Column) -> Column:
    """A JSON object of strings as array<struct<key, value>>: keys in lookup form, '_' keys left out, the last of a key wins."""
    raw = F.transform(F.map_entries(F.from_json(json, "map<string,string>")), lambda e: F.struct(text.normalise_key(e["key"]).alias("key"), e["value"].alias("value"), e["key"].alias("raw")))
    kept = F.filter(raw, lambda e: ~e["raw"].startswith("_") & e["value"].isNotNull())
    last = F.filter(kept, lambda e, i: ~F.exists(F.slice(kept, i + 2, F.size(kept)), lambda later: later["key"] == e["key"]))
    return F.transform(last, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def read_whole_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON objects with a declared schema."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_json(df: DataFrame, path: str) -> None:
    """Compact JSON lines; overwriting also removes the files that an earlier, larger result left behind."""
    df.write.mode("overwrite").json(path)


def json_bytes(*columns: str) -> Column:
    """How many bytes a row takes as compact JSON."""
    return F.octet_length(F.to_json(F.struct(*columns)))


def write_versioned(df: DataFrame, path: str, version: str) -> None:
    df.withColumn("v", F.lit(version)).write.mode("append").partitionBy("v").parquet(path)


def read_version(spark: SparkSession, path: str, version: str) -> DataFrame:
    """One version of an artefact; the other versions' files are not read."""
    return spark.read.parquet(path).filter(F.col("v") == version).drop("v")


def replace_book(df: DataFrame, path: str) -> None:
    """Overwrite only the collections that df holds (dynamic partitions by slug)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slug").parquet(path)


MANIFEST = "slug string, reports long, chains long, author_died int"


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def read_manifest(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """The manifest, or an empty one where there is none yet."""
    fs, at = _folder(spark, path)
    return spark.read.schema(schema).json(path) if fs.exists(at) else spark.createDataFrame([], schema)


def prune_shards(spark: SparkSession, path: str, prefix: str, kept: int) -> int:
    """Remove the files '<prefix>-N...' of a folder with N of `kept` and more; how many there were."""
    import re

    fs, at = _folder(spark, path)
    gone = 0
    for status in fs.listStatus(at) if fs.exists(at) else []:
        m = re.match(rf"{re.escape(prefix)}-(\d+)(?:\D|$)", status.getPath().getName())
        if m and int(m[1]) >= kept:
            fs.delete(status.getPath(), True)
            gone += 1
    return gone
