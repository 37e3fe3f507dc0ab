"""Record linkage, positional joins, lookups by longest span, upserts, record readers, grids and seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

MIN_PREFIX, HEAD_WORDS, LONE_NAME_WORDS = 2, 12, 5
MARK_MIN, MARK_MAX_ENTRIES = 3, 40
#: Rows of one key that are paired as a whole.
CHUNK = 4096
#: Of these, so many at a time meet a row of the other side. A page of Parquet holds 20,000 rows: many cycles, and long runs.
STRIPE = 256

# ---- fixed values: words that identify nobody -----------------------------------------------------------------------
MARK_NOISE = """بن ابن ابو ابي ابا ام الله عبد مولاهم مولي مولاه ويقال وقيل يقال وهو هو اسمه وكان ثم من في الحافظ القاضي الامام الشيخ
الامير الفقيه المحدث الزاهد العابد الكاتب الخليفه القارئ المقرئ""".split()


def first_wins(files: list[DataFrame], key: str = "id") -> DataFrame:
    """The union of files in order; of rows with one key the first file's first row stays (column pos orders a file)."""
    out = None
    for k, f in enumerate(files):
        part = f.withColumn("_file", F.lit(k))
        out = part if out is None else out.unionByName(part)
    first = Window.partitionBy(key).orderBy("_file", "pos")
    return out.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r", "_file")


def positional_join(ours: DataFrame, theirs: DataFrame, reading=text.letters_only) -> DataFrame:
    """id, value: pairs by place inside a group, only of groups that agree in length and in the reading of every text.

    ours: grp, pos, id, text; theirs: grp, pos, text, value. Groups hold the rows of one chapter.
    """
    number = lambda df: df.withColumn("k", F.row_number().over(Window.partitionBy("grp").orderBy("pos")))
    a = number(ours).select("grp", "k", "id", reading(F.col("text")).alias("ta"))
    b = number(theirs).select("grp", "k", reading(F.col("text")).alias("tb"), "value")
    both = a.join(b, ["grp", "k"], "full_outer")
    good = both.groupBy("grp").agg(F.bool_and(F.coalesce(F.col("ta") == F.col("tb"), F.lit(False))).alias("good")).filter("good")
    return both.join(good, "grp").select("id", "value")


def longest_span(names: DataFrame, index: DataFrame, variants=None) -> DataFrame:
    """name_id, key, ids: for each name's words the longest indexed run, the leftmost on ties, its variants in order.

    names: name_id, words (array); index: key, ids. One equi-join on the runs; longer names never fall back to one word.
    """
    runs = names.select("name_id", F.size("words").alias("n"), F.explode(text.spans(F.col("words"))).alias("s")).filter((F.col("n") == 1) | (F.col("s.len") >= 2))
    run = F.col("s.run")
    bounded = (F.get(run, F.lit(0)) != "بن") & (F.element_at(run, -1) != "بن") & ~((F.get(run, F.lit(0)) == "ابن") & (F.col("s.start") > 0))
    joined = F.array_join(run, " ")
    ways = variants(joined) if variants else F.array(joined)
    keyed = runs.filter(bounded).select("name_id", "s.start", "s.len", F.posexplode(ways).alias("way", "key"))
    best = keyed.join(index, "key").groupBy("name_id").agg(F.min(F.struct((-F.col("len")).alias("l"), "start", "way", "key", "ids")).alias("b"))
    return best.select("name_id", "b.key", "b.ids")


def exclude_father(ids: Column, key: Column) -> Column:
    """Of candidates struct<id, full> for 'son of X', those that are not X; all if none is left."""
    father = F.substring(key, 5, 1 << 20)
    kept = F.filter(ids, lambda c: (c["full"] != father) & ~c["full"].startswith(F.concat(father, F.lit(" "))))
    return F.when(key.startswith("ابن ") & (F.size(kept) > 0), kept).otherwise(ids)


def prefixes(words: Column, least: int = MIN_PREFIX, most: int = HEAD_WORDS) -> Column:
    """Leading runs of least..most words as strings."""
    n = F.least(F.size(words), F.lit(most))
    return F.when(n >= least, F.transform(F.sequence(F.lit(least), n), lambda k: F.array_join(F.slice(words, F.lit(1), k), " "))).otherwise(F.array().cast("array<string>"))


def prefix_candidates(entries: DataFrame, namings: DataFrame) -> DataFrame:
    """id, naming, entry, matched: each naming's longest leading run of words that opens an entry, with all such entries.

    entries: entry, head (words); namings: id, naming, words.
    """
    opened = entries.select("entry", F.explode(prefixes(F.col("head"))).alias("key"))
    asked = namings.select("id", "naming", F.posexplode(prefixes(F.col("words"))).alias("p", "key")).withColumn("matched", F.col("p") + MIN_PREFIX)
    # The longest is settled before any entry is joined, so what the join makes is the answer and is not sorted again.
    hits = asked.join(opened.select("key").distinct(), "key", "left_semi")
    longest = F.rank().over(Window.partitionBy("id", "naming").orderBy(F.col("matched").desc()))
    best = hits.withColumn("r", longest).filter("r = 1")
    return _all_pairs(best.select("key", "id", "naming", "matched"), opened).select("id", "naming", "entry", "matched")


def _all_pairs(left: DataFrame, right: DataFrame, key: str = "key") -> DataFrame:
    """The inner join on key for keys of many rows on both sides, whose result is much larger than its inputs.

    Both sides of a key are cut into chunks and each pair of chunks is a key of its own, so one key's pairs are spread
    over all tasks. A chunk is one array; a stripe of the right one meets each row of the left one in turn. So columns of
    left come in runs and those of right in short cycles, which a page of Parquet holds as runs and as copies: the
    result's size is what such a join leaves on the disk.
    """
    chunks = lambda df, name: df.groupBy(key).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias(name))
    dealt = lambda df, n: F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sizes = chunks(left, "_nl").join(chunks(right, "_nr"), key)
    values = lambda df: [c for c in df.columns if c != key]
    packed = lambda df, n, other: df.join(sizes, key).groupBy(key, other, dealt(df, n).alias("_own")).agg(F.collect_list(F.struct(*values(df))).alias("_rows"))
    a = packed(left, "_nl", "_nr").select(key, F.col("_own").alias("_l"), every("_nr").alias("_r"), F.col("_rows").alias("_left"))
    b = packed(right, "_nr", "_nl").select(key, every("_nl").alias("_l"), F.col("_own").alias("_r"), F.col("_rows").alias("_right"))
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is given is not lowered for the small inputs
    met = a.repartition(n, key, "_l", "_r").join(b, [key, "_l", "_r"])
    stripes = F.transform(F.sequence(F.lit(0), F.floor((F.size("_right") - 1) / STRIPE).cast("int")), lambda k: F.slice("_right", k * STRIPE + 1, STRIPE))
    striped = met.select(key, "_left", F.explode(stripes).alias("_stripe"))
    # transform() has no generated code. Generated code holds all that one row explodes to: so that is one stripe, not two chunks.
    rows = F.transform("_left", lambda x: F.struct(*[x[c].alias(c) for c in values(left)]))
    each = striped.select(key, F.explode(rows).alias("_a"), "_stripe").select(key, "_a", F.explode("_stripe").alias("_b"))
    return each.select(key, *[F.col(f"_a.{c}").alias(c) for c in values(left)], *[F.col(f"_b.{c}").alias(c) for c in values(right)])


def align(found: DataFrame, entries: DataFrame, people: DataFrame, marks: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """id, entry, matched: one entry a person, or none.

    found: prefix_candidates; entries: entry, tabaqa, death; people: id, tabaqa, years (array). A stated class or year
    that contradicts rules an entry out; the longest name wins; ties need a telling mark (discriminate); without a
    class or year that agrees only a long name counts.
    """
    e = entries.select("entry", F.col("tabaqa").alias("e_class"), F.col("death").alias("e_death"))
    both = found.join(e, "entry").join(people.select("id", F.col("tabaqa").alias("p_class"), "years"), "id")
    year = F.exists("years", lambda y: text.same_year(F.col("e_death"), y))
    against = (F.col("e_class") != F.col("p_class")) | (F.col("e_death").isNotNull() & (F.size("years") > 0) & ~year)
    agrees = F.coalesce(F.col("e_class") == F.col("p_class"), F.lit(False)) | F.coalesce(F.col("e_death").isNotNull() & year, F.lit(False))
    possible = both.filter(~F.coalesce(against, F.lit(False))).select("id", "entry", "matched", agrees.alias("agrees"))
    top = possible.withColumn("best", F.max("matched").over(Window.partitionBy("id"))).filter("matched = best").groupBy("id", "entry").agg(F.max("matched").alias("matched"), F.bool_or("agrees").alias("agrees"))
    n = F.count("*").over(Window.partitionBy("id"))
    single = top.withColumn("n", n)
    chosen = single.filter("n = 1").drop("n")
    if marks is not None and words is not None:
        tied = single.filter("n > 1").drop("n")
        chosen = chosen.unionByName(tied.join(discriminate(tied, marks, words), ["id", "entry"], "left_semi"))
    return chosen.filter(F.col("agrees") | (F.col("matched") >= LONE_NAME_WORDS)).select("id", "entry", "matched")


def discriminate(tied: DataFrame, marks: DataFrame, words: DataFrame) -> DataFrame:
    """id, entry: of tied entries the only one with a rare mark that none of its rivals carries.

    marks: id, mark; words: entry, word (distinct). A mark of too many entries decides nothing.
    """
    rare = words.groupBy("word").agg(F.count("*").alias("df")).filter(F.col("df") <= MARK_MAX_ENTRIES).select(F.col("word").alias("mark"))
    telling = marks.filter((F.length("mark") >= MARK_MIN) & ~F.col("mark").isin(MARK_NOISE)).distinct().join(rare, "mark")
    carried = tied.select("id", "entry").join(telling, "id").join(words.withColumnRenamed("word", "mark"), ["entry", "mark"])
    exclusive = carried.groupBy("id", "mark").agg(F.count_distinct("entry").alias("k"), F.min("entry").alias("entry")).filter("k = 1").select("id", "entry").distinct()
    only = exclusive.groupBy("id").agg(F.count("*").alias("k"), F.min("entry").alias("entry")).filter("k = 1")
    return only.select("id", "entry")


def with_entries(verdicts: DataFrame, entries: DataFrame, works: list[str] | None = None) -> DataFrame:
    """Verdicts (id, work, grade) with the entry of the same work, and entries without a verdict as rows of their own.

    With the list of works that were read, `read` tells which rows come from one of them, entry or not.
    """
    both = verdicts.join(entries, ["id", "work"], "full_outer")
    return both if works is None else both.withColumn("read", F.col("work").isin(*works) if works else F.lit(False))


def upsert(manifest: DataFrame, new: DataFrame) -> DataFrame:
    """The manifest with new's rows in place of those with the same slug, by death year of the author, undated last."""
    kept = manifest.join(new.select("slug"), "slug", "left_anti").unionByName(new)
    return kept.orderBy(F.coalesce("died", F.lit(9999)), "pos")


def read_records(lines: DataFrame) -> DataFrame:
    """n, entry from doc, line_no, line: '### $ N text' opens a record, '~~' continues it, any other '#' line ends it."""
    head = F.col("line").rlike(r"^### \$ \d+")
    ends = F.col("line").startswith("#")
    at = Window.partitionBy("doc").orderBy("line_no")
    marked = lines.withColumn("rec", F.sum(ends.cast("int")).over(at.rowsBetween(Window.unboundedPreceding, 0))).withColumn("head", head)
    body = F.when(head, F.regexp_extract("line", r"^### \$ \d+\s*(.*)$", 1)).when(F.col("line").startswith("~~"), F.substring("line", 3, 1 << 20))
    kept = marked.withColumn("body", body).filter("body is not null")
    # A group opens with a head, or its lines continue nothing.
    per = kept.groupBy("doc", "rec").agg(F.bool_or("head").alias("ok"), F.max(F.when(F.col("head"), F.regexp_extract("line", r"^### \$ (\d+)", 1).cast("int"))).alias("n"), F.array_sort(F.collect_list(F.struct("line_no", "body"))).alias("b"))
    entry = text.squeeze(F.array_join(F.transform("b", lambda x: x["body"]), " "))
    return per.filter("ok").select("doc", "n", entry.alias("entry")).filter("entry <> ''")


def grid_pairs(points: DataFrame, within: float) -> DataFrame:
    """a, b, distance of points (id, x, z) nearer than `within`: an equi-join on cells of that size and their neighbours."""
    cell = lambda c: F.floor(c / within)
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = points.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("z").alias("az"), F.explode(offsets).alias("o")).select("a", "ax", "az", (cell(F.col("ax")) + F.col("o.i")).alias("gx"), (cell(F.col("az")) + F.col("o.j")).alias("gz"))
    b = points.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("z").alias("bz"), cell(F.col("x")).alias("gx"), cell(F.col("z")).alias("gz"))
    distance = F.sqrt(F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("az") - F.col("bz"), 2))
    return a.join(b, ["gx", "gz"]).filter(F.col("a") < F.col("b")).select("a", "b", distance.alias("distance")).filter(F.col("distance") < within)


def present_only(claims: DataFrame, present: DataFrame) -> DataFrame:
    """id, others: of whom each id names (claims: id, other), those who are present (id), in order; none is no row."""
    kept = claims.join(present.select(F.col("id").alias("other")), "other", "left_semi")
    return kept.groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("others"))
