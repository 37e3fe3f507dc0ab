"""Each operator against brute force or an exact round trip, and on awkward rows."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from silsila.llm import bpe, hilbert, html_extract, langid, minhash, mixing, quality, sharding, suffix, toxicity

from . import helpers as h

TOKENIZERS = pytest.importorskip("public_tokenizers")
RANKS = TOKENIZERS.path("byte_bpe_multi_50k.tiktoken")


# ---- 1 sharding -----------------------------------------------------------------------------------------------------
def _check_shards(rows, shards, n):
    assert len(rows) == n
    places = collections.defaultdict(list)
    for r in rows:
        places[r["shard"]].append(r["slot"])
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert all(0 <= k < shards for k in places) and all(r["law"] == "bytes" and r["grown_shard"] is None for r in rows)


def test_shards_are_near_equal(spark, sf_dir):
    d = h.docs(spark, sf_dir)
    rows = sharding.shard(d, 8).collect()
    _check_shards(rows, 8, d.count())
    load = collections.Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    assert max(load.values()) - min(load.values()) <= max(r["size"] for r in rows)
    texts = dict(h.rows_of(d, "doc_id", "text"))
    assert all(r["size"] == len(texts[r["doc_id"]].encode()) + 8 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in rows)


def test_shards_awkward(spark):
    rows = sharding.shard(h.awkward(spark), 3).collect()
    _check_shards(rows, 3, 12)
    assert sorted(r["size"] for r in rows)[:3] == [8, 8, 8]
    assert sharding.shard(h.empty(spark), 3).count() == 0


def test_slot_map_versions(spark, tmp_path):
    sizes = {s: (100 + s % 7, 1) for s in range(sharding.SLOTS)}
    m = sharding.SlotMap.build(sizes, 8)
    m.save(spark, str(tmp_path))
    assert sharding.SlotMap.load(spark, str(tmp_path), 1).shard_of == m.shard_of
    same = m.rebalance(sizes)
    assert same.version == 2 and not same.moved
    grown = m.rebalance(sizes, 9)
    assert {grown.shard_of[s] for s in grown.moved} == {8}
    assert len(grown.moved) < sharding.SLOTS / 9 * 1.1
    few = sharding.SlotMap.build({1: (5, 1), 2: (6, 1), 3: (7, 1)}, 24)
    few.save(spark, str(tmp_path / "few"))
    assert sharding.SlotMap.load(spark, str(tmp_path / "few"), 1).shards == 24
    fewer = m.rebalance(sizes, 7)
    assert all(m.shard_of[s] == 7 for s in fewer.moved)


# ---- 2 suffix dedup ---------------------------------------------------------------------------------------------------
def _check_repeats(df, texts):
    want = h.without_repeats([(t or "").encode() for t in texts])
    got = collections.Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())
    assert got == collections.Counter((len((t or "").encode()), n, s, hashlib.sha256(k).hexdigest()) for t, (k, n, s) in zip(texts, want, strict=True))


def test_repeats_brute_force(spark, sf_dir):
    d = h.docs(spark, sf_dir)
    _check_repeats(suffix.remove_repeats(d), [t for (t,) in h.rows_of(d, "text")])


def test_repeats_awkward(spark):
    d = h.awkward(spark).filter("doc_id is null or doc_id not in (6, 7)")
    _check_repeats(suffix.remove_repeats(d), [t for (t,) in h.rows_of(d, "text")])
    out = suffix.without_repeats(h.awkward(spark))
    assert out.columns == h.awkward(spark).columns and out.count() == 12
    assert out.filter("doc_id = 1 and text is null").count() == 1
    assert suffix.remove_repeats(h.empty(spark)).count() == 0


def test_repeats_hot_passage(spark, monkeypatch):
    """A passage in very many texts: its anchors are split down to single windows."""
    monkeypatch.setattr(suffix, "BLOCK", 4096)
    rng = np.random.default_rng(3)
    noise = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = noise(900)
    texts = [noise(int(rng.integers(0, 300))) + passage[int(rng.integers(0, 300)) :] + noise(int(rng.integers(0, 300))) for _ in range(60)] + ["ab" * 700, noise(900), "x" * 1300]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    _check_repeats(suffix.remove_repeats(d), texts)


def test_interval_expansion():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(2, 5, 3000), 0).astype(np.uint16)
    order = np.array(sorted(range(len(text)), key=lambda i: text[i:].tolist()))
    for least in (1, 3, 6):
        border = suffix.long_borders(text, order, least)
        assert all(bool(border[k]) == (text[order[k - 1] :][:least].tolist() == text[order[k] :][:least].tolist()) for k in range(1, len(order)))


def test_long_text_segments(monkeypatch):
    monkeypatch.setattr(suffix, "SEGMENT", 1000)
    import pyarrow as pa

    rng = np.random.default_rng(2)
    raw = rng.integers(97, 120, 5000).astype(np.uint8).tobytes()
    found = list(suffix._units(iter([pa.RecordBatch.from_arrays([pa.array([7]), pa.array([raw])], ["rid", "raw"])])))
    starts = sorted((s, s + w) for b in found for s, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True))
    assert starts[0][0] == 0 and starts[-1][1] == 5000 - 399 and all(a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))


# ---- 3 quality rules ------------------------------------------------------------------------------------------------------
def _stats(text):
    words = h.WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for x in lines:
        if h.WORD.search(x):
            dup += x in seen
            seen.add(x)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often, covered = collections.Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 5))
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), failed


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_brute_force(spark, sf_dir):
    d = h.docs(spark, sf_dir)
    texts = dict(h.rows_of(d, "doc_id", "text"))
    out = quality.assess(d).select("row.doc_id", *STATS, "kept", "perplexity", "band_low", "band_high").collect()
    assert len(out) == len(texts)
    for r in out:
        assert tuple(r)[1:7] == _stats(texts[r.doc_id])
        assert not (r.kept and r.base_failed)
    good = {i for i, q in h.rows_of(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "quality") if q == 1}
    sound = [r for r in out if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in sound) >= 0.98 * len(sound)


def test_quality_rejects_outliers(spark, sf_dir):
    """A text in another language than its label says is too surprising for the label's model."""
    d = h.docs(spark, sf_dir).select("doc_id", "text", "lang")
    odd = d.filter("lang = 'fr' and length(text) between 1000 and 3000").orderBy("doc_id").limit(1).select(F.lit(-1).cast("long").alias("doc_id"), "text", F.lit("en").alias("lang"))
    r = quality.assess(d.union(odd)).filter("row.doc_id = -1").first()
    assert not r.base_failed and not r.kept and r.perplexity > r.band_high


def test_quality_judges_short_texts(spark, sf_dir):
    """Gibberish of ten words and more in under 200 bytes is rejected; short sentences labelled good stay."""
    d = h.docs(spark, sf_dir).select("doc_id", "text", "lang")
    rng = np.random.default_rng(4)
    junk = " ".join("".join(rng.choice(list("qxzjvkw"), 9)) for _ in range(14))
    out = quality.assess(d.union(spark.createDataFrame([(-1, junk, "en")], d.schema))).collect()
    odd = next(r for r in out if r.row.doc_id == -1)
    assert len(junk) < 200 and not odd.base_failed and not odd.kept and odd.perplexity > odd.band_high
    short = {i for i, t, q in h.rows_of(d.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id"), "doc_id", "text", "quality") if q == 1 and len((t or "").encode()) < 200}
    assert all(r.kept for r in out if r.row.doc_id in short and not r.base_failed)


@pytest.mark.parametrize("junk", [lambda w, k: w + ("***", "%%%", "&&&", "###")[k % 4], lambda w, k: w.upper() + "!!"])
def test_quality_rejects_junk(spark, sf_dir, junk):
    """A share of documents in symbols or capitals, enough of it to be learned, is too surprising; clean ones stay."""
    d = h.docs(spark, sf_dir).select("doc_id", "text", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = d.join(labels.filter("quality = 1"), "doc_id").select("doc_id", "text", "lang").filter("lang = 'en'")
    texts = [r for r in good.collect() if r.text and 300 < len(r.text) < 4000]
    made = [(-1 - i, " ".join(junk(w, k) for k, w in enumerate(r.text.split())), "en") for i, r in enumerate(texts[:3])]
    out = quality.assess(good.union(spark.createDataFrame(made, good.schema))).collect()
    assert texts and not any(r.kept for r in out if r.row.doc_id < 0)
    sound = [r for r in out if r.row.doc_id > 0 and not r.base_failed]
    assert sum(r.kept for r in sound) >= 0.95 * len(sound)


def test_quality_rejects_labelled_junk(spark, sf_dir):
    """Of documents that pass the base rules, most of those labelled junk go and nearly all of those labelled good stay."""
    larger = sf_dir.replace("sf0.001", "sf0.01")
    labels = dict(h.rows_of(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id", "quality"))
    sound = [(labels[r.row.doc_id], r.kept) for r in quality.assess(h.docs(spark, larger)).collect() if r.row.doc_id in labels and not r.base_failed]
    junk, good = [k for q, k in sound if q == 0], [k for q, k in sound if q == 1]
    assert sum(junk) <= 0.4 * len(junk) and sum(good) >= 0.97 * len(good)


def test_quality_awkward(spark):
    out = quality.assess(h.awkward(spark)).collect()
    assert len(out) == 12 and sum(r.n_words == 0 for r in out) == 4 and all(r.kept is not None for r in out)
    kept = quality.keep_good(h.awkward(spark))
    assert kept.columns == h.awkward(spark).columns and kept.filter("doc_id = 4").count() == 2
    assert quality.assess(h.empty(spark)).count() == 0


# ---- 4 neighbours ------------------------------------------------------------------------------------------------------------
def _recall(spark, vectors, every=20):
    """Against brute force; also checks order, ties and scores."""
    d = spark.createDataFrame([(i, v) for i, v in vectors], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in sorted(hilbert.nearest(d).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    m = np.array([v for _, v in vectors], np.float32).astype(float)
    ids, hits, total = np.array([i for i, _ in vectors]), 0, 0
    for k in np.flatnonzero(ids % every == 0):
        s = m @ m[k]
        order = [j for j in np.lexsort((ids, -np.round(s, 12))) if j != k][:20]
        mine = got[int(ids[k])]
        assert len(mine) == len(order) and [x[1] for x in mine] == sorted((x[1] for x in mine), reverse=True)
        hits += len({x[0] for x in mine} & {int(ids[j]) for j in order})
        total += len(order)
    return hits / total


def test_neighbours_recall(spark, monkeypatch):
    monkeypatch.setattr(hilbert, "BLOCK", 512)
    monkeypatch.setattr(hilbert, "MARGIN", 192)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((10, 32))
    v = centres[rng.integers(0, 10, 3000)] + 0.4 * rng.standard_normal((3000, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    assert _recall(spark, [(i, x.tolist()) for i, x in enumerate(v)]) >= 0.9


@pytest.mark.parametrize("n", [2000, 8000, 24000])
def test_neighbours_recall_follows_size(spark, monkeypatch, n):
    """Twelve of the least windows are 1.3, 0.34 and 0.11 times these tables; tiles are held small, so wide windows touch several."""
    monkeypatch.setattr(hilbert, "BLOCK", 128)
    monkeypatch.setattr(hilbert, "MARGIN", 48)
    monkeypatch.setattr(hilbert, "TILE_NUMBERS", 512 * 32, raising=False)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((10, 32))
    v = centres[rng.integers(0, 10, n)] + 0.4 * rng.standard_normal((n, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    assert _recall(spark, [(i, x.tolist()) for i, x in enumerate(v)]) >= 0.9


def test_neighbours_awkward(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [None, 1.0]), (5, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [0.5, 0.5]), (9, [2.0, 0.0]), (20, [0.0, 0.0]), (40, [1.0, 0.0]), (None, [1.0, 0.0]), (6, [float("inf"), 1.0]), (60, [1.0, 2.0, 3.0])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1))
    got = collections.defaultdict(list)
    for r in sorted(hilbert.nearest(d).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert got[0] == [(1, 9, 2.0), (2, 5, 1.0), (3, 7, 1.0), (4, 40, 1.0), (5, 8, 0.5)]
    assert got[40] == [(1, 9, 2.0), (2, 0, 1.0), (3, 5, 1.0), (4, 7, 1.0), (5, 8, 0.5)]
    assert set(got) == {0, 40}
    assert hilbert.nearest(d.limit(0)).count() == 0


def test_hilbert_curve_is_one_path():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    at = hilbert.hilbert_index(grid, 3)
    assert sorted(at) == list(range(512))
    path = grid[np.argsort(at)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


# ---- 5 main text ---------------------------------------------------------------------------------------------------------------
PAGE = """<html><head><title>t</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body>
<header class="site-header"><h2>Site</h2></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies &amp; more for the good of the people and the site in this way and that.</div>
<article><h1>The title of it</h1><p>It was the best of times, it was the worst of times, it was the age of wisdom&nbsp;and it was
the age <b>of</b> foolishness, it was the epoch of belief.<p>Short.</p><aside>Related: <a href=x>other</a></aside>
<div class="ad">Buy the thing that is in the shop on the corner of the street now.</div><p>a &lt;b&gt; c</p></article>
<section id="comments"><p>I think that it is one of the best of all the things that I have ever read on the site.</p></section>
<form><p>Send us the words that you have for the people who are in charge of it</p></form><footer>&copy; the owners of the site and all that is on it</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "The title of it\n\nIt was the best of times, it was the worst of times, it was the age of wisdom and it was the age of foolishness, it was the epoch of belief.\n\nShort.\n\na <b> c"
    assert html_extract.main_text("<nav><div><a href=x>menu</a><article><p>The cat is on the mat and it is in the house.</p>") == "The cat is on the mat and it is in the house."
    long = "It is the story of a man who was in the house by the sea and he had not the time for it. " * 4
    assert html_extract.main_text(f"<div><a href=a>Home</a> <a href=b>News</a></div><p>{long}</p><p>Yes.</p>") == f"{long.strip()}\n\nYes."
    for odd in ("", "<", "<p", "a < b", "<!-- x", "<script>", "&#xZZ; &amp", "<a><a></b></p>" * 50):
        html_extract.main_text(odd)


@pytest.mark.parametrize("piece", ['<a title="x y> ', "<p class='", "<", "<div><ul>", "<a b='c\" ", "<!-", "<article><div></ul>", '<script a="', "</div x='"])
def test_markup_in_linear_time(piece):
    """A megabyte of unclosed quotes, tags and elements; twice as much takes about twice as long."""
    import time

    def took(n):
        page = "<p>the house</p>" + piece * (n // len(piece)) + "<p>and the end"
        began = time.thread_time()
        html_extract.main_text(page)
        return time.thread_time() - began

    assert took(1_000_000) < 15 and took(400_000) < 3 * took(200_000) + 0.5


def test_tags():
    page = """a<b c="x>y" d='<'>e</b><!-- <p> --><script>"</p>"</script ><![CDATA[<i>]]><!DOCTYPE x><img src=q/>1 < 2<br/><p a="u>v"""
    found = list(html_extract.tags(page))
    assert [(x[3], x[4]) for x in found if x[4]] == [(False, "b"), (True, "b"), (False, "img"), (False, "br"), (False, "p")]
    assert found[0][5] == """ c="x>y" d='<'""" and [x[2] for x in found if x[2]] == ["<i>"]
    assert all(page[a] == "<" and b > a for a, b, *_ in found)


def _labels_by_definition(found):
    """The second pass, each undecided block by itself, by looking at all others."""
    first = [html_extract.decide(b) for b in found]

    def nearest(k, allowed):
        near = min((abs(k - j) for j in allowed), default=None)
        at = {j: first[j] for j in allowed if abs(k - j) == near}
        if len(set(at.values())) < 2:
            return next(iter(at.values()), None)
        return at[max(at)] if found[k].heading else True

    out = []
    for k, b in enumerate(found):
        decided = [j for j in range(len(found)) if first[j] is not None]
        own = nearest(k, [j for j in decided if found[j].region == b.region and found[j].decided is None])
        anywhere = nearest(k, decided)
        out.append(bool(first[k] if first[k] is not None else own if own is not None else True if b.article else anywhere))
    return out


def test_second_pass_by_definition():
    rng = np.random.default_rng(3)
    prose = "It is the house of a man who had not the time for it and it was in the way of all that is. "
    for _ in range(400):
        found = []
        for _ in range(int(rng.integers(0, 14))):
            text = [prose * 3, prose, "Home page", "zebra quartz lamp " * 6, "tags"][int(rng.integers(0, 5))].strip()
            region = int(rng.integers(0, 3))
            found.append(html_extract.Block(text, int(len(text) * rng.choice([0, 0, 0.3, 0.9])), region, region > 0, False if rng.random() < 0.15 else None, bool(rng.random() < 0.2)))
        assert html_extract.label(found) == _labels_by_definition(found)


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert len(out) == pages.count()
    for p in pages.collect():
        t = out[p.page_id]
        assert t.n_chars == len(t.text) and "track(" not in t.text and "©" not in t.text and t.text


def test_pages_awkward(spark):
    d = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (4, "u", "<p>" + "the and of it is " * 20000)], "page_id long, url string, html string").withColumn("raw", F.lit(1))
    out = {r.page_id: r for r in html_extract.extract(d).collect()}
    assert out[1].text == out[2].text == "" and out[4].n_chars == len(out[4].text) > 300_000
    assert html_extract.extract(d.limit(0)).count() == 0


# ---- 6 byte-level BPE -------------------------------------------------------------------------------------------------------------
def test_bpe_is_what_tiktoken_does(spark, sf_dir):
    import tiktoken

    ranks = bpe.read_ranks(RANKS)
    ours = bpe.Codec(ranks, TOKENIZERS.PATTERN)
    theirs = tiktoken.Encoding("own", pat_str=TOKENIZERS.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = ["", " ", "a  b", "x\x1cy\x85z\xa0w", "日本語 123४५½", "a" * 3000, "\n\n \t x", "it's we'll THEY'RE", "😀😀 ñandú", "<|endoftext|>", "​ ", "́a", "\x00\x01", " é"]
    for t in odd + [t for (t,) in h.rows_of(h.docs(spark, sf_dir), "text")]:
        ids = [i for m in ours.encode(t) for i in m]
        assert ids == theirs.encode_ordinary(t) and ours.decode(ids) == t.encode()


def test_bpe_documents(spark):
    out = bpe.encode_documents(h.awkward(spark), RANKS, TOKENIZERS.PATTERN).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert len(out) == 12 and sum(r.n_tokens == 0 and r.ids_sha256 == none and r.decoded_sha256 == none for r in out) == 3
    texts = collections.Counter(hashlib.sha256((t or "").encode()).hexdigest() for (t,) in h.rows_of(h.awkward(spark), "text"))
    assert collections.Counter(r.decoded_sha256 for r in out) == texts
    assert all(r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in out)
    back = bpe.decode_documents(bpe.encode_documents(h.awkward(spark), RANKS, TOKENIZERS.PATTERN), RANKS, TOKENIZERS.PATTERN)
    assert collections.Counter(t for (t,) in h.rows_of(back, "text")) == collections.Counter((t or "") for (t,) in h.rows_of(h.awkward(spark), "text"))
    assert bpe.encode_documents(h.empty(spark), RANKS, TOKENIZERS.PATTERN).count() == 0


# ---- 7 near duplicates -----------------------------------------------------------------------------------------------------------
def _check_near(df, rule=minhash.Rule(3, 85, 24, 6)):
    rows = h.rows_of(df, "doc_id", "text")
    want, sets = h.near_components(rows, rule.shingle, rule.percent)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, rule).collect())
    assert got == collections.Counter((i, len(s), c if s else i) for (i, _), c, s in zip(rows, want, sets, strict=True))


def test_near_brute_force(spark, sf_dir):
    _check_near(h.docs(spark, sf_dir))
    _check_near(h.docs(spark, sf_dir), minhash.Rule())


def test_near_families(spark):
    """Edited copies of one text, some of them linked only to others: exact components, whatever the centre."""
    rng = np.random.default_rng(9)
    base, texts = [f"w{k}" for k in range(120)], []
    for k in range(160):
        words = list(texts[int(rng.integers(0, k))].split()) if k % 3 == 2 else list(base)
        for j in rng.integers(0, 120, int(rng.integers(0, 9))):
            words[j] = f"n{rng.integers(0, 10**6)}"
        texts.append(" ".join(words))
    _check_near(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_near_large_family(spark, monkeypatch):
    """One family of many edited copies, most linked only through others: candidates stay far below its square."""
    rng = np.random.default_rng(11)
    base, texts, made = [f"w{k}" for k in range(150)], [], []
    for k in range(900):
        words = list(base)
        for j in rng.integers(0, 150, int(rng.integers(6, 16))):
            words[j] = f"n{rng.integers(0, 40)}"
        texts.append(" ".join(words))
    verify = minhash.verify
    monkeypatch.setattr(minhash, "verify", lambda pairs, *rest: made.append(pairs.count()) or verify(pairs, *rest))
    _check_near(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sum(made) < 900 * 900 / 20


def test_near_one_hub(spark, monkeypatch):
    """Lightly edited copies of one text share most buckets: they are compared with one hub, not with one in every bucket."""
    rng = np.random.default_rng(12)
    base, texts, made = [f"w{k}" for k in range(300)], [], []
    for _ in range(800):
        words = list(base)
        for j in rng.integers(0, 300, int(rng.integers(1, 9))):
            words[j] = f"n{rng.integers(0, 10**6)}"
        texts.append(" ".join(words))
    verify = minhash.verify
    monkeypatch.setattr(minhash, "verify", lambda pairs, *rest: made.append(pairs.count()) or verify(pairs, *rest))
    _check_near(spark.createDataFrame(list(enumerate([" ".join(base), *texts])), "doc_id long, text string"))
    assert sum(made) < 5 * len(texts)


@pytest.mark.parametrize("kind", ["path", "stars", "random", "none"])
def test_components(spark, monkeypatch, kind):
    """Exact components, and links that fall away as their ends meet: all rounds together read no more than twice what the first reads."""
    rng, n, read = np.random.default_rng(5), 700, []
    name = [b"%08d" % k for k in rng.permutation(n)]
    ends = {"path": [(k, k + 1) for k in range(n - 1)], "stars": [(k - k % 50, k) for k in range(n)], "random": rng.integers(0, n, (n // 2, 2)).tolist(), "none": []}[kind]
    parent = {name[k]: name[k] for e in ends if e[0] != e[1] for k in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in ends:
        if a != b:
            x, y = sorted((find(name[a]), find(name[b])))
            parent[y] = x
    keep = minhash.materialise
    monkeypatch.setattr(minhash, "materialise", lambda df, tag: (out := keep(df, tag), tag == "cc-edges" and read.append(out.count()))[0])
    links = spark.createDataFrame([(bytearray(name[a]), bytearray(name[b])) for a, b in ends], "a binary, b binary")
    got = {bytes(r.node): bytes(r.comp) for r in minhash.components(links).collect()}
    assert got == {x: find(x) for x in parent}
    assert sum(read) <= 2 * read[0] and read[-1] == 0


def test_near_awkward(spark):
    d = h.awkward(spark)
    _check_near(d)
    kept = minhash.keep_one(d)
    assert kept.columns == d.columns
    assert kept.filter("doc_id = 4").count() == 1 and kept.filter("doc_id = 5").count() == 0
    assert kept.filter("text is null or trim(text) in ('', '\t\n')").count() >= 2
    assert minhash.near_duplicates(h.empty(spark)).count() == 0 and minhash.keep_one(h.empty(spark)).count() == 0


def test_sketch_agreement():
    rng = np.random.default_rng(4)
    a = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
    b = np.unique(np.concatenate([a[:300], rng.integers(0, 1 << 62, 100).astype(np.uint64)]))
    small = a[:2]
    s = minhash.sketches([a, b, small, a[:0]], 2048)
    assert (s[:3] != minhash._NONE).all() and (s[3] == minhash._NONE).all()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.05


# ---- 8 language ---------------------------------------------------------------------------------------------------------------------
def test_language_held_out(spark, sf_dir):
    d = h.docs(spark, sf_dir)
    lang = dict(h.rows_of(d, "doc_id", "lang"))
    out = langid.identify(d).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_language_awkward(spark):
    out = langid.identify(h.awkward(spark)).collect()
    assert len(out) == 12 and sum(r.lang_pred == "und" for r in out) == 4 and {r.lang_pred for r in out} <= {"und", "en", "de", "nl"}
    nothing = langid.identify(h.awkward(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.identify(h.empty(spark)).count() == 0


def _many_languages(spark):
    """Ninety languages, each with an alphabet and words of its own."""
    rows = []
    for k in range(90):
        rng = np.random.default_rng(k)
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)]
        rows += [(k * 40 + i, " ".join(rng.choice(words, 40)), f"l{k:02d}") for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_of_over_64(spark):
    d = _many_languages(spark)
    out = langid.identify(d).join(d, "doc_id").filter("held_out").collect()
    late = [r for r in out if r.lang >= "l64"]
    assert len(late) > 20 and sum(r.lang == r.lang_pred for r in late) >= 0.95 * len(late)


def test_quality_bands_of_over_64(spark):
    d = _many_languages(spark)
    bands = {(r.lang, r.band_low, r.band_high) for r in quality.assess(d).collect()}
    assert len(bands) == 90 and len({b[1:] for b in bands}) > 80


def test_kneser_ney_by_dictionaries(spark):
    """Scores of seen and unseen n-grams of two models equal those by dictionaries, and those of a context add up to one."""
    from silsila.llm import ngram_lm

    texts = {"=a": ["the cat sat on the mat; the cat ran", "THE hat 12 times", "", "一二一二三"], "=b": ["¿que? sí", "la la la casa"]}
    rows = [(m, g) for m, ts in texts.items() for t in ts for g in h.trigrams(t)]
    code = lambda g: sum(ord(c) << 21 * (2 - k) for k, c in enumerate(g))
    counts = collections.Counter((m, code(g)) for m, g in rows)
    grams = {g for _, g in rows} | {"th\U0010ffff", "qqq", "zat"}
    df = spark.createDataFrame([(m, c, n) for (m, c), n in counts.items()], "model string, code long, n long")
    wanted = spark.createDataFrame([(m, code(g)) for m in [*texts, "=none"] for g in grams], "model string, code long")
    for least in (1, 2):
        got = {(r.model, r.code): r.log for r in ngram_lm.scores(df, wanted, least).collect()}
        assert len(got) == 3 * len(grams)
        for m in texts:
            twin = h.KneserNey(texts[m], least)
            assert all(abs(got[m, code(g)] - 1e6 * np.log(max(twin.p(g), 1e-12))) <= 1 for g in grams)
            letters = sorted({c for t in texts[m] for c in t})
            assert abs(sum(twin.p("th" + c) for c in letters) + twin.p("th\U0010ffff") - 1) < 1e-9
        assert {got["=none", code(g)] for g in grams} == {round(1e6 * np.log(1e-12))}


def _band(rows, sizes):
    """Weighted quartiles on a grid and the deviation of one character, as the operator words them."""
    grid = lambda x: round(x / 1e-4)
    def at(values, weights, p):
        upto = 0
        for v, w in sorted(zip(values, weights, strict=True)):
            upto += w
            if upto >= p * sum(weights):
                return v * 1e-4
    e = [grid(x) for x in rows]
    q = [at(e, sizes, p) for p in (0.25, 0.5, 0.75)]
    return q, at([grid(abs(x - q[1]) * n**0.5) for x, n in zip(rows, sizes, strict=True)], [1] * len(rows), 0.5) / 0.6745


def test_quality_by_dictionaries(spark, sf_dir):
    """Perplexity, band and verdict of every text equal those of models by dictionaries."""
    d = h.docs(spark, sf_dir).filter("length(text) < 900").orderBy("doc_id").limit(60).select("doc_id", "text", "lang")
    rows = {r.doc_id: r for r in d.collect()}
    out = quality.assess(d).collect()
    assert len(out) == len(rows)
    for lang in {r.lang for r in rows.values()}:
        own = [r for r in rows.values() if r.lang == lang]
        twin, cache = h.KneserNey([r.text or "" for r in own], 2), {}
        some = [r for r in own if r.text]
        total = {r.doc_id: sum(cache[g] if g in cache else cache.setdefault(g, round(1e6 * np.log(max(twin.p(g), 1e-12)))) for g in h.trigrams(r.text)) for r in some}
        entropy = {r.doc_id: -total[r.doc_id] / 1e6 / len(r.text) for r in some}
        q, one = _band([entropy[r.doc_id] for r in some], [len(r.text) for r in some])
        for r in out:
            if r.row.doc_id in entropy:
                e, n = entropy[r.row.doc_id], len(rows[r.row.doc_id].text)
                reach = quality.REACH * max(q[2] - q[0], quality.LEAST_RANGE) + quality.ERRORS * one * max(1 / n**0.5 - 1 / quality.SURE**0.5, 0)
                assert abs(np.log(r.perplexity) - e) < 1e-5 and abs(np.log(r.band_low) - q[0] + reach) < 3e-4 and abs(np.log(r.band_high) - q[2] - reach) < 3e-4
                if min(abs(e - q[0] + reach), abs(e - q[2] - reach)) > 1e-3:
                    assert r.kept == (not r.base_failed and q[0] - reach <= e <= q[2] + reach)


def test_language_by_dictionaries(spark, sf_dir):
    """Every prediction is the language whose model by dictionaries finds the text least surprising."""
    d = h.docs(spark, sf_dir).filter("length(text) < 500").orderBy("doc_id").limit(60).select("doc_id", "text", "lang")
    rows = {r.doc_id: r for r in d.collect()}
    learned = [r for r in rows.values() if r.lang and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    twins = {x: (h.KneserNey([r.text for r in learned if r.lang == x]), {}) for x in sorted({r.lang for r in learned})}
    for r in langid.identify(d).collect():
        text = rows[r.doc_id].text
        surprise = {x: -sum(c[g] if g in c else c.setdefault(g, np.log(max(m.p(g), 1e-12))) for g in h.trigrams(text)) / len(text) for x, (m, c) in twins.items()}
        best = min(surprise, key=surprise.get)
        assert abs(r.entropy - surprise[best]) < 1e-5 and (r.lang_pred == best or surprise[r.lang_pred] - surprise[best] < 1e-5)


def test_models_do_not_depend_on_partitions(spark, sf_dir):
    d = h.docs(spark, sf_dir)
    for run in (lambda x: quality.assess(x).select("row.doc_id", "kept", "perplexity", "band_low", "band_high"), langid.identify):
        assert sorted(map(tuple, run(d).collect())) == sorted(map(tuple, run(d.repartition(7)).collect()))


# ---- 9 toxicity ---------------------------------------------------------------------------------------------------------------------
def test_toxicity_gradient():
    rng = np.random.default_rng(0)
    net = toxicity.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    raw = b"one two three four five six seven eight nine ten two four"
    w = toxicity.Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    at, mask = toxicity._places(w, np.array([0, 3]), np.array([9, 7]))
    mask = mask.astype(float)
    x = net.inputs(w).astype(np.float64)
    keep = {}
    net.forward(x, at, mask, keep)
    g, dx = net.gradient(x, at, mask, keep, np.array([1.0, -0.5]))
    value = lambda: float(net.forward(x, at, mask) @ np.array([1.0, -0.5]))
    for name in ("uf", "ub", "xf", "attend", "choose", "out", "cb"):
        p = net.p[name]
        k = tuple(rng.integers(0, s) for s in p.shape)
        p[k] += 1e-5
        up = value()
        p[k] -= 2e-5
        down = value()
        p[k] += 1e-5
        assert abs((up - down) / 2e-5 - g[name][k]) < 1e-7
    x[2, 3] += 1e-5
    up = value()
    x[2, 3] -= 2e-5
    assert abs((up - value()) / 2e-5 - dx[2, 3]) < 1e-7


def test_toxicity_scores_every_window():
    """Batches and tiles against one window at a time; the windows overlap and leave no word out."""
    rng, net = np.random.default_rng(2), toxicity.Network(3)
    net.shift = 0.0
    words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(1, 7)))) for _ in range(90)]
    texts = [list(rng.choice(words, n)) for n in (1, 47, 48, 49, 80, 81, 300, 0, 1000)]
    raw = [" ".join(t).encode() for t in texts]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    got = toxicity.worst_windows(net, np.frombuffer(b"".join(raw), np.uint8), offsets)
    for t, score in zip(texts, got, strict=True):
        best, reached = -np.inf, 0
        while reached < len(t):
            start = 0 if not reached else reached - toxicity.WINDOW + toxicity.STRIDE
            part = " ".join(t[start : start + toxicity.WINDOW]).encode()
            w = toxicity.Words(np.frombuffer(part, np.uint8), np.array([0, len(part)]))
            at = w.which[None, :]
            best, reached = max(best, float(net.forward(net.inputs(w), at, np.ones(at.shape, np.float32))[0])), start + toxicity.WINDOW
        assert abs(score - (best if t else -3.0)) < 1e-4


def test_toxicity_held_out():
    """Documents that were not learned from."""
    import zlib

    import duckdb

    folder = "/root/testdata/sf0.1"
    sql = f"SELECT doc_id, text, max(toxic) FROM '{folder}/documents.parquet' JOIN '{folder}/labels.parquet' USING (doc_id) WHERE text IS NOT NULL AND toxic IN (0, 1) GROUP BY 1, 2 ORDER BY 1"
    rows = [(x.encode(), y, zlib.crc32(str(i).encode()) % 4 == 2) for i, x, y in duckdb.sql(sql).fetchall()]
    seen, held = [r for r in rows if not r[2]], [r for r in rows if r[2]]
    net = toxicity.train([r[0] for r in seen], np.array([r[1] for r in seen], float), float(np.mean([r[1] for r in seen])))
    raw = [r[0] for r in held]
    logits = toxicity.worst_windows(net, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    y, said = np.array([r[1] for r in held]), 1 / (1 + np.exp(-logits)) >= toxicity.THRESHOLD
    assert (said & (y == 1)).sum() >= 0.75 * y.sum() and (said & (y == 1)).sum() >= 0.85 * said.sum()


def test_toxicity_learns(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("aeioulnrst"), 5)) for _ in range(400)]
    rows = []
    for i in range(500):
        t = list(rng.choice(words, int(rng.integers(30, 200))))
        if i % 4 == 0:
            t[int(rng.integers(0, len(t)))] = ["idiot", "moron", "scum"][i % 3]
        rows.append((i, " ".join(t), int(i % 4 == 0)))
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    out = toxicity.score(d, d.select("doc_id", "toxic")).collect()
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out)


def test_toxicity_awkward(spark):
    d = h.awkward(spark)
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (6, None), (4, 0)], "doc_id long, toxic int")
    out = toxicity.score(d, labels).collect()
    assert len(out) == 12 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(d, labels.limit(0)).count() == 12 and toxicity.score(h.empty(spark), labels).count() == 0


# ---- 10 mixing ------------------------------------------------------------------------------------------------------------------------
def _targets(sizes):
    """By repeated sharing, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
        left -= sum(out[s] for s in over)
        free -= set(over)
    return out


def _check_mix(df):
    rows = mixing.plan_mix(df).select("row.doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws").collect()
    assert len(rows) == df.count()
    sizes, largest, taken = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r.source] += r["size"]
        largest[r.source] = max(largest[r.source], r["size"])
        taken[r.source] += r.taken
        assert r.taken <= 3 * r["size"]
    want = _targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) <= 1e-6 * max(1, r.target)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    return sorted((str(r.doc_id), r.taken, str(r.draws)) for r in rows)


def test_mix(spark, sf_dir):
    d = h.docs(spark, sf_dir)
    assert _check_mix(d) == _check_mix(d.repartition(5))


def test_mix_capped(spark):
    rows = [(i, "w " * (5 if s == "a" else 40), s) for i, s in enumerate(["a"] * 8 + ["b"] * 30 + ["c"] * 50 + [None] * 3 + ["d"] * 30)]
    _check_mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_mix_awkward(spark):
    _check_mix(h.awkward(spark))
    out = mixing.mix(h.awkward(spark))
    assert out.columns == [*h.awkward(spark).columns, "mix_pass", "mix_shard", "mix_place"]
    assert mixing.plan_mix(h.empty(spark)).count() == 0 and mixing.mix(h.empty(spark)).count() == 0


def test_mix_is_native(spark, sf_dir):
    plan = mixing.plan_mix(h.docs(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


def test_splitting_tree(spark):
    """Every draw reaches one leaf, leaves differ by little, and a node's halves hold sources at random."""
    draws = spark.range(600).select(F.when(F.col("id") < 400, "x").otherwise("y").alias("source"), (F.col("id") % 100).cast("int").alias("block"), (F.col("id") / 100).cast("int").alias("pass"))
    out = mixing.deal(draws, 3, 1).groupBy("shard", "source").count().collect()
    per = collections.Counter()
    for r in out:
        per[r.shard] += r["count"]
    assert sum(per.values()) == 600 and max(per.values()) - min(per.values()) <= 3 and len(per) == 8
    x = [r["count"] for r in out if r.source == "x"]
    assert 35 <= min(x) and max(x) <= 65 and len(set(x)) > 1
