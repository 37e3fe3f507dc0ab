"""The pipeline's stages against brute force, each on its own input."""

import collections
import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as cp
from silsila.llm import queries, suffix
from silsila.llm.common import materialise

from . import helpers as h


def test_stages(spark, sf_dir):
    docs = h.docs(spark, sf_dir)
    stages = dict(cp.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "suffix_dedup", "mix_sources", "byte_bpe"]
    good = materialise(stages["quality_rules"](spark, docs, sf_dir), "t")
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    assert good.exceptAll(docs).isEmpty()

    unique = materialise(stages["near_dedup"](spark, good, sf_dir), "t")
    rows = h.rows_of(good, "doc_id", "text")
    comp, _ = h.near_components(rows, 5, 80)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(set(comp)) and unique.columns == docs.columns

    cut = materialise(stages["suffix_dedup"](spark, unique, sf_dir), "t")
    before = h.rows_of(unique, "doc_id", "text")
    # Strings of 400 bytes and passages of 51 words go; a character that is partly covered stays whole.
    want = {i: b for (i, _), b in zip(before, _without_passages([t.encode() for _, t in before]), strict=True)}
    lengths = {i: len(t.encode()) for i, t in before}
    assert any(len(want[i]) < lengths[i] for i in want)
    for i, t, n in h.rows_of(cut, "doc_id", "text", "n_chars"):
        gone = lengths[i] - len(want[i])
        assert n == len(t) and 0 <= len(t.encode()) - len(want[i]) <= 6 * (gone > 0) + 6 * gone // 100
        assert gone or t.encode() == want[i]
    assert cut.columns == docs.columns and cut.count() == unique.count()

    mixed = materialise(stages["mix_sources"](spark, cut, sf_dir), "t")
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and max(copies.values()) <= 3 and mixed.distinct().exceptAll(cut.distinct()).isEmpty()

    out = stages["byte_bpe"](spark, mixed, sf_dir).collect()
    digests = collections.Counter((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in h.rows_of(mixed, "doc_id", "text"))
    assert collections.Counter((r.doc_id, r.decoded_sha256) for r in out) == digests
    assert sorted(map(tuple, out)) == sorted(map(tuple, cp.run(spark, sf_dir).collect()))


def test_stages_on_nothing(spark, sf_dir):
    docs = h.docs(spark, sf_dir).limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def _without_passages(raws, words=51, least=400):
    """Kept bytes by counting all strings of `least` bytes and all runs of `words` words."""
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in raws]
    runs = [[tuple(b[x:y] for x, y in s[i : i + words]) for i in range(len(s) - words + 1)] for b, s in zip(raws, spans, strict=True)]
    seen = collections.Counter(w for r in runs for w in r)
    strings = collections.Counter(b[a : a + least] for b in raws for a in range(len(b) - least + 1))
    out = []
    for b, s, r in zip(raws, spans, runs, strict=True):
        gone = [False] * len(b)
        cuts = [(s[i][0], s[i + words - 1][1]) for i, w in enumerate(r) if seen[w] > 1]
        cuts += [(a, a + least) for a in range(len(b) - least + 1) if strings[b[a : a + least]] > 1]
        for x, y in cuts:
            gone[x:y] = [True] * (y - x)
        out.append(bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


def test_passages_of_over_50_words(spark, sf_dir):
    """Planted passages of 51 words, of the shortest words and of common ones, and benchmark items; 50 words stay."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    noise = lambda n: " ".join(word() for _ in range(n))
    short, common, fifty = " ".join(rng.choices("abcdefghij", k=51)), noise(51), noise(50)
    items = [t for (t,) in h.rows_of(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "text") if len(t.split()) > 50][:3]
    assert items
    texts = [f"{noise(rng.randint(0, 60))} {p} {noise(rng.randint(0, 60))}" for p in [short, common, fifty, *items] for _ in range(3)]
    texts += [common.replace(" ", "\n"), f"{noise(30)} {common} {common} {noise(9)}", "x y " * 80, noise(40)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in dict(cp.STAGES)["suffix_dedup"](spark, docs, sf_dir).collect()}
    assert [got[i] for i in range(len(texts))] == [b.decode() for b in _without_passages([t.encode() for t in texts])]
    assert not any(p in t for t in got.values() for p in (short, common, *items)) and sum(fifty in t for t in got.values()) == 3


def _passage_figures(raws, words=51):
    """(maximal runs, bytes) of all runs of `words` words that also stand elsewhere, by counting."""
    spans = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in raws]
    runs = [[tuple(b[x:y] for x, y in s[i : i + words]) for i in range(len(s) - words + 1)] for b, s in zip(raws, spans, strict=True)]
    seen = collections.Counter(w for r in runs for w in r)
    out = []
    for b, s, r in zip(raws, spans, runs, strict=True):
        hit = bytearray(len(b))
        for i, w in enumerate(r):
            if seen[w] > 1:
                hit[s[i][0] : s[i + words - 1][1]] = b"\1" * (s[i + words - 1][1] - s[i][0])
        out.append((len(re.findall(rb"\x01+", hit)), sum(hit)))
    return out


def test_op2_reports_short_passages(spark, sf_dir, tmp_path):
    """Repeated passages of 51 words under 400 bytes show in columns of their own; the contract's columns stay as they are."""
    rng = random.Random(9)
    noise = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))
    planted, fifty, clean = noise(51), noise(50), [noise(90) for _ in range(3)]
    assert len(planted) < 400
    texts = [f"{noise(40)} {p} {noise(40)}" for p in (planted, planted, fifty, fifty)] + clean
    texts += [planted.replace(" ", "\n"), f"{planted} {noise(2)}", f"{noise(5)} {planted} {planted}", "x y " * 90, "x y " * 90, None, "", noise(120) + " é" * 60]
    texts += [t for (t,) in h.rows_of(h.docs(spark, sf_dir).limit(60), "text")]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op2_suffix_dedup(spark, str(tmp_path)).collect()}
    raws = [(t or "").encode() for t in texts]
    assert [(got[i].n_passages, got[i].passage_bytes) for i in range(len(texts))] == _passage_figures(raws)
    assert all(got[i].passage_bytes >= len(planted) for i in (0, 1)) and not any(got[i].passage_bytes for i in (2, 3, 4, 5, 6))
    assert [(got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in range(len(texts))] == [
        (len(b), n, s, hashlib.sha256(k).hexdigest()) for b, (k, n, s) in zip(raws, h.without_repeats(raws), strict=True)
    ]


def test_periodic_passages_are_one_row():
    """A line that repeats in one text makes a row for the whole run, not one for every few words."""
    raw = ("Is onhe. " * 3000).encode()
    units = [r for b in suffix._passage_units(51)(iter([pa.RecordBatch.from_arrays([pa.array([7, 8]), pa.array([raw, raw])], ["rid", "raw"])])) for r in b.to_pylist()]
    assert len(units) <= 6 and sum(u["occ"] for u in units) > 5000 and {u["rid"] for u in units} == {7, 8}


def test_stages_on_awkward_rows(spark, sf_dir):
    """Nulls, empty and very long texts, repeats and clashing names go through all stages in a row."""
    rows = h.awkward(spark).withColumn("mix_pass", F.lit("x")).withColumn("mix_shard", F.lit(None).cast("string"))
    docs = rows.unionByName(h.docs(spark, sf_dir).limit(40).select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"), *[F.lit("y").alias(c) for c in rows.columns[5:]]))
    for name, stage in cp.STAGES:
        out = materialise(stage(spark, docs, sf_dir), "t")
        if name != "byte_bpe":
            assert out.columns == docs.columns and set(r.mix_pass for r in out.select("mix_pass").distinct().collect()) <= {"x", "y"}
            docs = out
        assert out.count() > 0
    for name, stage in cp.STAGES:
        out = materialise(stage(spark, rows, sf_dir), "t")
        assert name == "byte_bpe" or out.columns == rows.columns
