"""Invariants that hold at any scale, plans, and sources and sinks."""

import collections
import re

import pytest
from pyspark.sql import functions as F

from silsila.functions import hashing, text
from silsila.operators import chains, index, names, parse, records
from silsila.sources import corpus


@pytest.fixture(scope="module")
def reports(spark, sf_dir):
    return corpus.reports(spark, sf_dir).persist()


def test_edge_weights_are_steps(reports):
    steps = chains.steps(reports).filter("src <> dst").count()
    assert chains.edges(reports).agg(F.sum("weight")).first()[0] == steps


def test_gap_edges_have_only_gaps(reports):
    gaps = chains.edges(reports).filter("gap").select("src", "dst")
    assert chains.steps(reports).filter("not gap").join(gaps, ["src", "dst"], "left_semi").isEmpty()


def test_isolation_narrows(reports):
    count = lambda t: reports.filter(chains.passes_through(t, F.col("chain"), F.col("slug"))).count()
    assert count(["r1", "r2"]) <= count(["r1"]) <= count([]) == reports.count() == count(["prophet"])


def test_more_books_never_lose_edges(reports):
    one = chains.edges(reports.filter("slug = '1-URGENT'")).select("src", "dst")
    assert one.exceptAll(chains.edges(reports).select("src", "dst")).isEmpty()


def test_search_plan_prunes_shards(spark, sf_dir, tmp_path):
    docs = index.ordinals(corpus.texts(spark, sf_dir))
    index.write_index(index.postings(docs), str(tmp_path / "i"))
    words, pairs = index.query_terms(spark, "rights reserved")
    found = index.read_terms(spark, str(tmp_path / "i"), words + pairs)
    assert "PartitionFilters: [shard#" in found._jdf.queryExecution().toString()
    direct = index.search(index.postings(docs), words, pairs)
    assert sorted(map(tuple, index.search(found, words, pairs).collect())) == sorted(map(tuple, direct.collect()))


def test_phrases_are_hits(spark, sf_dir):
    docs = index.ordinals(corpus.texts(spark, sf_dir))
    words, pairs = index.query_terms(spark, "all rights reserved")
    hits = index.search(index.postings(docs), words, pairs)
    assert hits.filter("pairs > 0").select("ordinal").exceptAll(hits.select("ordinal")).isEmpty()
    assert index.search(index.postings(docs), ["zzzzzz"], []).isEmpty()


def test_shards_in_python_and_spark(spark):
    terms = ["bukhari", "الاعمال", "a b", "", "😀x", "é"]
    rows = spark.createDataFrame([(t,) for t in terms], "t string").select(hashing.shard_column(F.col("t"), 64).alias("s")).collect()
    assert [r.s for r in rows] == [hashing.shard_for(t, 64) for t in terms]


def test_name_search_across_scripts(spark):
    people = spark.createDataFrame([(1, "أبو هريرة", None, 4871, 0), (2, "أبو بحر", None, 7, 1), (3, "مسلم", "Muslim", 50, 2)], "id int, ar string, en string, n int, pos int")
    assert [r.id for r in names.search(people, "abu hurayra").collect()][0] == 1
    assert [r.id for r in names.search(people, "هريره").collect()] == [1]
    assert [r.id for r in names.search(people, "musl").collect()][0] == 3
    assert names.search(people, "x").count() == 0


def _parsed(spark, prose, kin=None, attested=None):
    return parse.parse_chains(spark.createDataFrame([(prose,)], "text string"), kin, attested).first().parsed


def test_chain_parser_limits(spark):
    many = "حدثنا " + " عن ".join(f"زيد بن {w}" for w in "عمرو بكر خالد صالح سالم نافع مالك سعيد هشام حماد شعبة وكيع قتيبة يونس معمر عقيل ثابت حميد".split())
    parsed = _parsed(spark, many)
    assert len(parsed.names) == parse.MAX_LINKS and not parsed.reached
    kin = {"father": {text.key_of("هشام بن عروة"): "عروة بن الزبير"}}
    assert _parsed(spark, "حدثنا هشام بن عروة، عن أبيه، عن عائشة قالت", kin).names == ["هشام بن عروة", "عروة بن الزبير", "عائشة"]
    assert _parsed(spark, None).names == []


def test_chain_parser_strangers(spark):
    """Beyond two names a stranger ends the chain unless it is attested or built like a name; what is told backward is turned."""
    text_ = "حدثنا زيد بن ثابت، عن هشام بن عروة، عن خالد، عن مالك بن أنس قال"
    known = spark.createDataFrame([("خالد",)], "key string")
    assert _parsed(spark, text_, attested=known).names == ["زيد بن ثابت", "هشام بن عروة", "خالد", "مالك بن أنس"]
    assert _parsed(spark, text_, attested=known.limit(0)).names == ["زيد بن ثابت", "هشام بن عروة"]
    assert _parsed(spark, "حدثنا زيد بن ثابت، أن هشام بن عروة أخبره، عن عائشة قالت").names == ["زيد بن ثابت", "هشام بن عروة", "عائشة"]


def test_alignment_vetoes_and_ties(spark):
    e = spark.createDataFrame([(1, 3, 100), (2, 5, None), (3, None, None)], "entry int, tabaqa int, death int")
    people = spark.createDataFrame([(10, 5, [100]), (11, None, [])], "id int, tabaqa int, years array<int>")
    found = spark.createDataFrame([(10, 0, 1, 4), (10, 0, 2, 3), (11, 0, 3, 4), (11, 0, 2, 4)], "id int, naming int, entry int, matched int")
    assert [tuple(r) for r in records.align(found, e, people).collect()] == [(10, 2, 3)]
    marks = spark.createDataFrame([(11, "نصري")], "id int, mark string")
    words = spark.createDataFrame([(3, "نصري"), (2, "مدني")], "entry int, word string")
    assert records.align(found, e, people, marks, words).filter("id = 11").count() == 0
    assert [r.entry for r in records.discriminate(spark.createDataFrame([(11, 3), (11, 2)], "id int, entry int"), marks, words).collect()] == [3]


def test_prefix_candidates_of_hot_names(spark, monkeypatch):
    monkeypatch.setattr(records, "CHUNK", 7, raising=False)
    heads = [(k, ["red", "ring"] + ["big"] * (k % 3)) for k in range(50)] + [(50, ["red", "ring"]), (50, ["red", "ring"]), (51, ["red"]), (None, ["red", "ring", "big"]), (52, None)]
    named = [(k, k % 2, ["red", "ring", *(["big"] if k % 2 else ["old", "one"])]) for k in range(40)] + [(7, 1, ["red", "ring", "big"]), (41, 0, ["blue", "ring"]), (None, 0, ["red", "ring"])]
    out = records.prefix_candidates(spark.createDataFrame(heads, "entry long, head array<string>"), spark.createDataFrame(named, "id long, naming int, words array<string>"))
    opens = collections.Counter((tuple(h[:k]), e) for e, h in heads for k in range(2, len(h or ()) + 1))
    best = {}
    for i, n, w in named:
        best[i, n] = max([best.get((i, n), 0), *(k for k in range(2, len(w) + 1) if any(o == tuple(w[:k]) for o, _ in opens))])
    want = collections.Counter()
    for i, n, w in named:
        for (o, e), c in opens.items():
            if len(o) == best[i, n] and o == tuple(w[: len(o)]):
                want[i, n, e, len(o)] += c
    assert collections.Counter(map(tuple, out.collect())) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")  # the rank is below the join: the pairs themselves are never sorted


def test_all_pairs_by_stripes(spark, monkeypatch):
    monkeypatch.setattr(records, "CHUNK", 20)
    monkeypatch.setattr(records, "STRIPE", 4, raising=False)
    left = [(k % 3 or 7, n) for n, k in enumerate(range(100))] + [(1, 3), (1, 3), (None, 1), (9, 1), (2, None)]
    right = [(k % 4 + 1, n, str(n % 2)) for n, k in enumerate(range(150))] + [(1, 0, "0"), (7, 1, "x"), (None, 2, "x"), (1, None, None)]
    out = records._all_pairs(spark.createDataFrame(left, "key int, a int"), spark.createDataFrame(right, "key int, b int, c string"))
    assert out.columns == ["key", "a", "b", "c"]
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter((k, a, b, c) for k, a in left for o, b, c in right if k == o and k is not None)


def test_prefix_candidates_are_small_on_disk(spark, tmp_path):
    entries = spark.range(3001).select(F.col("id").alias("entry"), F.array(F.lit("red"), F.lit("ring")).alias("head"))
    namings = spark.range(1001).select((F.col("id") * 7919).alias("id"), F.lit(0).alias("naming"), F.array(F.lit("red"), F.lit("ring")).alias("words"))
    out = records.prefix_candidates(entries, namings).select("id", "entry", "matched")
    out.write.parquet(str(tmp_path / "out"))
    n = 3001 * 1001
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.agg(F.count("*"), F.count_distinct("id", "entry")).first() == (n, n)
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < n / 4  # bytes; 1.5 a pair when each row met a whole chunk
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fused = re.findall(r"\*\((\d+)\) Generate explode\(_", out.select("*")._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert fused and len(fused) == len(set(fused))  # generated code holds what one row explodes to: never the pairs of two chunks


def test_no_import_of_llm():
    from pathlib import Path

    root = Path(corpus.__file__).resolve().parent.parent
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and ".llm" in p.read_text()]


def test_view_is_an_involution():
    from silsila.plans.view import View

    v = View(books=("a", "b"), pinned=(1,), kinds=("high",))
    assert v.toggle_book("c").toggle_book("c").books == v.books and v.toggle_book("c").pinned == ()
    assert v.toggle_kind("peer").toggle_kind("peer").kinds == v.kinds and v.toggle_kind("peer").pinned == (1,)
    assert v.isolate("x").isolate("y", also=True).release("x").isolated == ("y",)
    assert View.load(v.toggle_chapter("a", 3).save()) == v.toggle_chapter("a", 3)
    assert View.load(None) is None and View.load("{") is None and View.load('{"v": 1, "books": []}') is None
    assert v.prune({"a"}, set(), set()) == View(books=("a",), kinds=("high",))


def test_catalogue():
    from silsila.sources.catalogue import find_book

    assert find_book("malik")[5] == 179
    with pytest.raises(KeyError):
        find_book("nobody")


def test_versions_and_replacement(spark, tmp_path):
    from silsila.sources import catalogue

    d = spark.createDataFrame([("a", 1), ("b", 2)], "slug string, id int")
    catalogue.write_versioned(d, str(tmp_path / "v"), "1")
    catalogue.write_versioned(d.limit(0).union(spark.createDataFrame([("c", 3)], "slug string, id int")), str(tmp_path / "v"), "2")
    assert [r.id for r in catalogue.read_version(spark, str(tmp_path / "v"), "2").collect()] == [3]
    catalogue.replace_book(d, str(tmp_path / "b"))
    catalogue.replace_book(spark.createDataFrame([("a", 9)], "slug string, id int"), str(tmp_path / "b"))
    assert sorted((r.slug, r.id) for r in spark.read.parquet(str(tmp_path / "b")).collect()) == [("a", 9), ("b", 2)]


def test_streamed_ingest(spark, tmp_path):
    import json

    from silsila.streaming.ingest import ingest_texts

    (tmp_path / "in").mkdir()
    run = lambda: ingest_texts(spark, str(tmp_path / "in"), "slug string, id int, text string", str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    text_ = "حدثنا زيد بن ثابت، عن أبي هريرة، عن النبي ﷺ قال"
    (tmp_path / "in/1.json").write_text("\n".join(json.dumps({"slug": s, "id": i, "text": text_}) for i, s in enumerate("ab")))
    run()
    (tmp_path / "in/2.json").write_text(json.dumps({"slug": "a", "id": 7, "text": text_}))
    run()
    rows = sorted((r.slug, r.id, r.names, r.reached) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert rows == [("a", 7, ["زيد بن ثابت", "أبي هريرة"], True), ("b", 1, ["زيد بن ثابت", "أبي هريرة"], True)]


def test_layout_relaxes_inside_the_disc(spark):
    from silsila.operators.layout import relax

    nodes = spark.createDataFrame([("v", str(k), float(k), 0.0, float(-k)) for k in range(6)], "view string, id string, x double, y double, z double")
    links = spark.createDataFrame([("v", "0", "5", 4.0)], "view string, src string, dst string, weight double")
    out = {r.id: r for r in relax(nodes, links, 50).collect()}
    assert len(out) == 6 and abs(out["0"].x - out["5"].x) < 5 and out["3"].x == 3.0


def test_cache_retries_and_remembers(tmp_path):
    from silsila.sources.cache import NotFound, fetch_cached

    calls, waits = [], []

    def flaky(key):
        calls.append(key)
        if len(calls) < 3:
            raise OSError("later")
        return "body"

    assert fetch_cached("u", flaky, str(tmp_path), sleep=waits.append) == "body" and waits == [2.0, 4.0]
    assert fetch_cached("u", flaky, str(tmp_path)) == "body" and len(calls) == 3

    def gone(key):
        calls.append(key)
        raise NotFound(key)

    with pytest.raises(NotFound):
        fetch_cached("v", gone, str(tmp_path), sleep=waits.append)
    assert len(calls) == 4


def test_manifest_and_shards(spark, tmp_path):
    from silsila.sources import catalogue

    path = str(tmp_path / "manifest.json")
    assert catalogue.read_manifest(spark, path).count() == 0
    (tmp_path / "manifest.json").write_text('{"slug": "a", "reports": 3}')
    assert [(r.slug, r.reports) for r in catalogue.read_manifest(spark, path).collect()] == [("a", 3)]
    for k in (0, 1, 2, 10):
        (tmp_path / f"bio-{k}.json").write_text("{}")
    (tmp_path / "bio-x.json").write_text("{}")
    assert catalogue.prune_shards(spark, str(tmp_path), "bio", 2) == 2 and catalogue.prune_shards(spark, str(tmp_path), "bio", 2) == 0
    assert sorted(p.name for p in tmp_path.glob("bio-*.json")) == ["bio-0.json", "bio-1.json", "bio-x.json"]
