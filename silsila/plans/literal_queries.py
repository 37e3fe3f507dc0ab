"""Registered queries over literal cases: functions of Arabic text, whose expected values the oracle states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import shard_column
from ..operators import chains, index, parse, records, resolve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _quoted(x) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def cases(name: str, build: Callable[..., Column], rows: list[tuple]) -> None:
    """Each row holds the inputs and, last, the expected result as text. The query returns k and result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        width = len(rows[0]) - 1
        values = ", ".join(f"({k}, {', '.join(_quoted(x) for x in r[:-1])})" for k, r in enumerate(rows))
        given = spark.sql(f"SELECT * FROM VALUES {values} AS t(k, {', '.join(f'x{i}' for i in range(width))})")
        return given.select("k", build(*[F.col(f"x{i}").cast("string") for i in range(width)]).cast("string").alias("result"))

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = "SELECT k::INT AS k, result FROM (VALUES " + ", ".join(f"({k}, CAST({_quoted(r[-1])} AS VARCHAR))" for k, r in enumerate(rows)) + ") t(k, result)"


_list = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), "|")

cases("strip_diacritics", text.strip_diacritics, [("مُحَمَّد", "محمد"), ("الرّحـــمن", "الرحمن"), ("abc", "abc")])
cases("normalise_key", text.normalise_key, [("أَبِي هُرَيْرَةَ", "ابي هريره"), ("ابن، وهب", "ابن وهب"), ("Abu 12 موسى", "موسي"), ("  مؤمن  شئ ", "مومن شي")])
cases("normalise_arabic", text.normalise_arabic, [("إِلَى", "الي"), ("الأعمال، 5", "الاعمال، 5")])
cases("strip_honorifics", text.strip_honorifics, [("رسول الله صلى الله عليه وسلم قال", "رسول الله قال"), ("عمر رضي الله عنهما", "عمر"), ("موسى عليه السلام", "موسى"), ("النبي ﷺ قال", "النبي قال")])
cases("strip_editorial", text.strip_editorial, [("قال «نعم» (كذا)", "قال نعم كذا"), ("زيد - عمرو؛ بكر", "زيد عمرو، بكر")])
cases("death_year", text.parse_death_year, [("سنة ٢٥٦", 256), ("11 AH", 11), ("0", None), ("1501", None), ("قديم", None), ("123.6", 124), (None, None)])
cases("normalise_grade", text.normalise_grade, [("Da’if", "Da'if"), ("Daif", "Da'if"), ("Da if", "Da'if"), ("daif jiddan", "da'if jiddan"), ("Mawdu'", "Maudu'"), ("Maudu", "Maudu'"), ("12", None), ("Sahih ,", "Sahih")])
cases("letters_only", text.letters_only, [("قَالَ: نَعَم ﷺ 3", "قالنعم")])
cases("tokenise_arabic", lambda c: _list(text.tokenise(c)), [("إنما الأعمال بالنيات", "انما|اعمال|نيات"), ("قال رسول الله وسلم", ""), ("page 12 والله الكتاب", "page|كتاب"), ("The the of Reading", "reading")])
cases("strip_prefixes", text.strip_prefixes, [("الاعمال", "اعمال"), ("بالنيات", "نيات"), ("والله", "الله"), ("كتاب", "كتاب")])
cases("bigrams", lambda c: _list(text.bigrams(F.split(c, " "))), [("a b c", "a b|b c"), ("a", ""), ("a a", "a a")])
cases("fold_name", text.fold_name, [("عَائِشَة", "عايشه"), ("Muḥammad ʿAbd", "muhammad abd"), ("al-Zuhrī", "alzuhri"), ("Ibrāhīm b. Yazīd", "ibrahim b yazid")])
cases("skeleton", lambda c: text.skeleton(text.fold_name(c)), [("abu hurayra", "bhr"), ("أبو هريرة", "bhrh"), ("Umm Salama", "mslm"), ("أم سلمة", "mslmh"), ("muslim", "mslm"), ("al-Zuhrī", "zhr"), ("الزهري", "zhr"), ("zuhri", "zhr")])
cases("grade_from_arabic", text.grade_from_arabic, [("ليس بثقة", "abandoned"), ("صدوق", "mostly_reliable"), ("ثقة حافظ", "reliable"), ("ضعيف", "weak"), ("كذاب", "fabricator"), ("مجهول", "unknown"), ("كلام", None)])
cases("clean_value", text.clean_value, [(" x ", "x"), ("-", None), ("NaN", None), ("None", None), ("", None), (None, None), ("null", None), ("نعم", "نعم")])
cases("parse_class", text.parse_class, [("الثانية عشرة", 12), ("الثانية", 2), ("صحابي", 1), ("مختلف في صحبته", None), ("الأولى", 1), ("من كبار العاشرة", 10), ("-", None)])
cases("named_as_woman", text.named_as_woman, [("يعلى بن منية بنت غزوان", None, None, None, "false"), ("عائشة بنت أبي بكر", None, None, None, "true"), ("هند", "أم سلمة", None, None, "true"), ("أم عطية", None, None, None, "true"), ("زينب", None, "صحابية", None, "true"), ("زيد بن ثابت", "أبو سعيد", None, "ثقة", "false")])
cases("year_in_words", text.year_in_words, [("سبع عشرة", 17), ("ثلاث وسبعين", 73), ("ست وأربعين", 46), ("خمس وعشرين", 25), ("اثنتين وقيل ثلاث وتسعين", 93), ("", None), ("خمس وعشرين ومائتين", 225), ("سبع وعشرة", 10)])
cases("same_year", lambda a, b: text.same_year(a.cast("int"), b.cast("int")), [(25, 125, "true"), (73, 74, "true"), (73, 80, "false"), (117, 17, "false")])
cases("years_in", lambda c: _list(text.years_in(c)), [("90 هـ ، أو 91 هـ", "90|91"), (None, ""), ("0 ثم 12", "12")])
cases("head_of", lambda c: F.array_join(text.head_of(c), " "), [("أنس بن مالك، خادم", "انس بن مالك خادم"), ("1 2 3 4 5 6 7 8 9 10 11 12 13 14", ""), ("ا ب ت ث ج ح خ د ذ ر ز س ش ص", "ا ب ت ث ج ح خ د ذ ر ز س")])
cases("clean_entry", text.clean_entry, [("أنس PageV01P123 بن ms239 مالك", "أنس بن مالك"), ("xms12 Page7", "xms12")])
cases("class_in_entry", text.class_in_entry, [("فلان من العاشرة مات", 10), ("فلان صحابي مشهور", 1), ("من رؤوس الطبقة السابعة", 7), ("فلان بن فلان", None)])
cases("death_in_entry", text.death_in_entry, [("ثقة مات سنة سبع عشرة وله ثمانون سنة", 17), ("مات سنة ست وأربعين", 46), ("ثقة", None)])
cases("display_name", text.display_name, [("الزهري", "محمد بن مسلم", "محمد بن مسلم"), ("عمر بن الخطاب", "عمر", "عمر بن الخطاب"), ("x", "", "x"), ("x", "a b c d e f g", "x")])
cases("settled_name", text.settled_name, [("عبد الرحمن بن صخر ، وقيل : عبد الرحمن بن غنم", "عبد الرحمن بن صخر"), ("زيد ويقال عمرو", "زيد"), ("زيد", "زيد")])
cases("non_name_spans", lambda c: F.array_contains(F.array(*map(F.lit, parse.NON_NAME_SPANS)), text.normalise_key(c)), [("قوله", "true"), ("رجل", "true"), ("زيد", "false"), ("امرأة", "true")])
cases("short_name", text.short_name, [("Muḥammad al-Bukhārī (d. 256 AH)", "al-Bukhārī"), ("Muslim", "Muslim")])
cases("kunya_variants", lambda c: _list(text.kunya_variants(c)), [("ابي هريره", "ابي هريره|ابو هريره"), ("انسا", "انسا|انس"), ("ابو بكر", "ابو بكر|ابي بكر"), ("عمر", "عمر")])
cases("strip_titles", lambda c: F.array_join(text.strip_titles(F.split(c, " ")), " "), [("امير المومنين عمر", "عمر"), ("الامام مالك", "مالك"), ("الامام", "الامام"), ("مالك الامام", "مالك الامام")])
cases("spans", lambda c: F.array_join(F.transform(text.spans(F.split(c, " ")), lambda s: F.array_join(s["run"], " ")), "|"), [("a b c", "a b c|a b|b c|a|b|c"), ("a", "a")])
cases("rulings", lambda c: _list(text.rulings(c)), [("Da'if Munkar", "munkar"), ("Hasan Sahih", "hasan|sahih"), ("Maudu'", "mawdu"), ("Da'if", "daif"), (None, "")])
cases("score_name", lambda r, n: F.round(text.score_name(r.cast("int"), n.cast("int")), 6), [(0, 9, "1.0"), (3, 99, "1.0"), (5, 999, "1.0")])
cases("shard_for", lambda c: shard_column(c, 64), [("bukhari", 41), ("الاعمال", 34), ("a b", 50)])
cases("delta_coding", lambda c: _list(index.delta_encode(F.transform(F.split(c, ","), lambda x: x.cast("bigint")))), [("3,5,9", "3|2|4"), ("7", "7")])
cases("delta_decoding", lambda c: _list(index.delta_decode(F.transform(F.split(c, ","), lambda x: x.cast("bigint")))), [("3,2,4", "3|5|9"), ("7", "7")])
cases("percentile_literal", lambda c, q: F.coalesce(*[F.when(q == str(x), chains.percentile_floor(F.transform(F.split(c, ","), lambda v: v.cast("int")), x)) for x in (0.1, 0.5, 0.9)]), [("1,2,3,4", "0.5", 3), ("7", "0.1", 7), ("1,2,3,4,5,6,7,8,9,10", "0.9", 10)])
cases("match_kinds", lambda chosen, have: F.coalesce(*[F.when(chosen == ",".join(c), chains.matches_kinds(c, F.split(have, ","))) for c in (["sahih", "hasan", "high"], ["women"], [])]), [("sahih,hasan,high", "hasan", "false"), ("sahih,hasan,high", "hasan,high", "true"), ("women", "high", "false"), ("", "high", "true")])
cases("chain_path", lambda c, a, n: F.array_join(F.transform(chains.path(a == "t", n == "t", F.split(c, " "), F.array().cast("array<int>"), F.lit("b")), lambda s: F.concat(s["src"], F.lit(">"), s["dst"], F.when(s["gap"], "!").otherwise(""))), " "), [("a b", "t", "f", "prophet>a a>b b>collector:b"), ("a b", "f", "t", "prophet>a! a>b b>collector:b"), ("a", "f", "f", "a>collector:b")])
cases("reconcile_companion", lambda g, t, d, v: resolve.reconcile(g, t.cast("int"), d.cast("int"), F.split(v, ",")), [("companion", None, None, "weak", "companion"), ("companion", 3, None, "weak,reliable", "reliable"), ("companion", None, 200, "", "unknown"), ("weak", 1, None, "", "companion"), ("unknown", 5, None, "weak", "weak"), ("weak", 5, 300, "reliable", "weak")])
cases("exclude_father", lambda k, ids: F.array_join(F.transform(records.exclude_father(F.transform(F.split(ids, ","), lambda x: F.struct(F.get(F.split(x, ":"), F.lit(0)).alias("id"), F.get(F.split(x, ":"), F.lit(1)).alias("full"))), k), lambda c: c["id"]), ","), [("ابن عمر", "1:عمر بن الخطاب,2:عبد الله بن عمر", "2"), ("ابن عمر", "1:عمر", "1"), ("عمر", "1:عمر,2:زيد", "1,2")])

_PARSED = [
    ("حدثنا عبد الله بن يوسف، قال أخبرنا مالك بن أنس، عن نافع مولى ابن عمر، عن عبد الله بن عمر، أن رسول الله صلى الله عليه وسلم قال كذا", "عبد الله بن يوسف|مالك بن أنس|نافع مولى ابن عمر|عبد الله بن عمر", "true", "true", ""),
    ("حدثنا زيد بن ثابت، عن أبي هريرة، عن النبي ﷺ قال", "زيد بن ثابت|أبي هريرة", "true", "true", ""),
    ("حدثنا زيد بن ثابت، عن أخيه، عن أبي هريرة قال", "زيد بن ثابت|أبي هريرة", "false", "false", "1"),
    ("حدثنا موسى بن، إسماعيل قال حدثنا وهيب بن خالد", "موسى بن إسماعيل|وهيب بن خالد", "false", "false", ""),
    ("", "", "false", "false", ""),
]


def parse_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({k}, {_quoted(r[0])})" for k, r in enumerate(_PARSED)) + " AS t(k, text)")
    p = parse.parse_chains(given)
    return p.select("k", F.array_join("parsed.names", "|").alias("names"), F.col("parsed.reached").cast("string").alias("reached"), F.col("parsed.names_apex").cast("string").alias("names_apex"), _list(F.col("parsed.gaps")).alias("gaps"))


QUERIES["parse_chains"] = parse_chains
ORACLES["parse_chains"] = "SELECT k::INT AS k, names, reached, names_apex, gaps FROM (VALUES " + ", ".join(f"({k}, {', '.join(map(_quoted, r[1:]))})" for k, r in enumerate(_PARSED)) + ") t(k, names, reached, names_apex, gaps)"


def transmission_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.sql("SELECT * FROM VALUES (0, 'c b a', array(1)), (1, 'b a a', array(2)), (2, 'x', array()) AS t(k, ids, gaps)")
    ids, gaps = parse.transmission_order(F.split("ids", " "), F.col("gaps").cast("array<int>"))
    return given.select("k", F.array_join(ids, " ").alias("chain"), _list(gaps).alias("gaps"))


QUERIES["transmission_order"] = transmission_order
ORACLES["transmission_order"] = "SELECT k::INT AS k, chain, gaps FROM (VALUES (0, 'a b c', '1'), (1, 'a b', '0'), (2, 'x', '')) t(k, chain, gaps)"


def resolve_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three places: the middle name fits two people; links and classes decide, and a bare pair stays ambiguous."""
    person = lambda i, grade, full, tabaqa, died, teachers="", students="", verdicts=1: f"named_struct('id', {i}L, 'grade', '{grade}', 'full', '{full}', 'digits', false, 'verdicts', {verdicts}, 'namings', 1, 'words', 2, 'tabaqa', {tabaqa}, 'died', {died}, 'weight', 1.0D, 'teachers', array({teachers}), 'students', array({students}))"
    a = person(1, "reliable", "a", 5, 150, "3L")
    b1, b2 = person(2, "weak", "b x", 7, 250), person(3, "reliable", "b y", 3, 100, "4L", "1L")
    c = person(4, "companion", "c", 1, 50)
    place = lambda key, *p: f"named_struct('key', '{key}', 'candidates', array({', '.join(p)}))"
    given = spark.sql(f"SELECT 0 AS k, true AS reached, array({place('a', a)}, {place('b', b1, b2)}, {place('c', c)}) AS places UNION ALL SELECT 1, false, array({place('z', person(8, 'weak', 'q', 'null', 'null'), person(9, 'weak', 'q', 'null', 'null'))})")
    given = given.withColumn("places", F.col("places").cast(f"array<struct<key:string,candidates:array<{resolve.CANDIDATE}>>>"))
    r = resolve.resolve(given)
    return r.select("k", F.array_join(F.transform("resolved", lambda x: F.concat(x["id"].cast("string"), F.when(x["ambiguous"], "?").otherwise(""))), " ").alias("resolved"))


QUERIES["resolve_chains"] = resolve_chains
ORACLES["resolve_chains"] = "SELECT k::INT AS k, resolved FROM (VALUES (0, '1 3 4'), (1, '8?')) t(k, resolved)"


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.sql("SELECT * FROM VALUES (1, 'taqrib', NULL, 'ثقة', 0), (1, 'isaba', 'unknown', '-', 1), (2, 'kamil', 'weak', NULL, 0), (2, 'mizan', 'unknown', 'كلام', 1) AS t(id, key, grade_en, grade_ar, pos)")
    return resolve.read_verdicts(given).select("id", "key", "grade_en")


QUERIES["verdicts"] = verdicts
ORACLES["verdicts"] = "SELECT id::INT AS id, key, grade_en FROM (VALUES (1, 'taqrib', 'reliable'), (2, 'kamil', 'weak'), (2, 'mizan', 'unknown')) t(id, key, grade_en)"


def namings(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.sql("SELECT 1 AS id, 'محمد بن مسلم' AS full_name, array('الزهري', 'محمّد بن مسلم', '-', 'ابن شهاب') AS namings UNION ALL SELECT 2, NULL, array('زيد')")
    return resolve.namings(given).select("id", "pos", "naming", "key")


QUERIES["namings"] = namings
ORACLES["namings"] = "SELECT id::INT AS id, pos::INT AS pos, naming, key FROM (VALUES (1, 0, 'محمد بن مسلم', 'محمد بن مسلم'), (1, 1, 'الزهري', 'الزهري'), (1, 4, 'ابن شهاب', 'ابن شهاب'), (2, 1, 'زيد', 'زيد')) t(id, pos, naming, key)"
