"""Quality rules: counts over words and lines, and a perplexity band per language.

A modified Kneser-Ney model over characters per language is counted over all documents (ngram_lm). A document's
perplexity under its own language's model must lie between a lower and an upper bound of that language; the bounds lie
beyond the quartiles of log perplexity over all its documents, so they follow the corpus and reject outliers on either
side: repeated stock text below, character noise above.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, flat, materialise, mix64, release, span_hashes, utf8, word_spans
from .ngram_lm import MICRO, Trigrams, block_table, counted, named, quantiles, score_blocks, scores, sorted_arrays, sums

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MOST_REPEATED_PERCENT = 20
#: How many interquartile ranges of log perplexity a band reaches beyond the quartiles, and the least width of one.
REACH, LEAST_RANGE = 3.0, 0.02
#: N-grams that occur less often in a language back off when texts are scored: the scored text is itself part of the
#: corpus. The discounts are estimated from all of them.
LEAST_COUNT = 2
#: The mean over few characters is uncertain: bounds are wider by so many standard errors, as far as these exceed the
#: one of a text of so many characters.
ERRORS, SURE = 6.0, 2000

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
COUNTS = [c.split()[0] for c in STATS.split(", ")]


def text_stats(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five base counts for each row of a flat batch of texts."""
    starts, ends, first = word_spans(data, offsets)
    rows = len(offsets) - 1
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out = {
        "n_words": np.diff(first),
        "word_chars": sums(solid & ((data & 0xC0) != 0x80), offsets).astype(np.int64),
        "n_symbols": sums(symbol[data], offsets).astype(np.int64),
    }
    dup = np.zeros(rows, np.int64)
    has_line = sums(data == 10, offsets)
    for k in np.flatnonzero(has_line):
        seen: set[bytes] = set()
        for line in data[offsets[k] : offsets[k + 1]].tobytes().split(b"\n"):
            if line.strip():
                dup[k] += line in seen
                seen.add(line)
    out["n_dup_lines"] = dup
    covered = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= WINDOW:
        h = span_hashes(data, starts, ends)
        of = np.repeat(np.arange(rows), out["n_words"])
        n = len(h) - WINDOW + 1
        key = mix64(of[:n].astype(np.uint64) + np.uint64(1))
        for k in range(WINDOW):
            key = (key ^ h[k : k + n]) * np.uint64(0x9FB21C651E98DF25 + 2 * k)
            key ^= key >> np.uint64(32)
        at = np.flatnonzero(of[:n] == of[WINDOW - 1 :])
        key = key[at]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + WINDOW, -1)
    out["n_repeat_words"] = sums(np.cumsum(covered)[:-1] > 0, first).astype(np.int64)
    return out


def _counts(batch: pa.RecordBatch) -> dict[str, pa.Array]:
    """The base counts of a batch with texts in raw."""
    parts = [text_stats(*flat(part, "raw")) for part in chunks(batch, "raw")]
    return {c: pa.array(np.concatenate([p[c] for p in parts]), pa.int64()) for c in COUNTS}


def _surprise(texts: pa.Table, lookups: pa.Table) -> pa.Table:
    """The texts of a block with their characters and the sum of their n-grams' scores under their own language's model."""
    grams = Trigrams(texts.column("raw").to_pylist())
    n = np.diff(grams.offsets)
    total = np.zeros(len(n), np.int64)
    of, names = np.array(texts.column("model").to_pylist(), object), np.array(lookups.column("model").to_pylist(), object)
    for model in dict.fromkeys(names):
        codes, order = sorted_arrays(lookups.filter(pa.array(names == model)))
        logs = lookups.filter(pa.array(names == model)).column("log").to_numpy()[order].astype(np.int64)
        mine = np.flatnonzero(of == model)
        found = grams.looked_up(grams.rows(of == model), codes, logs)
        total[mine] = sums(found, np.concatenate([[0], np.cumsum(n[mine])]))
    out = texts.drop_columns(["block", "raw"])
    return out.append_column("n_chars", pa.array(n)).append_column("total", pa.array(total))


def assess(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (struct of the carried columns), lang, the base counts, base_failed, perplexity, band_low, band_high, kept.

    A null or empty text has no words and fails the base rules; a null lang is a language of its own; repeated rows are
    judged each; an empty table gives no rows. perplexity is per character. The quartiles are of characters: a text
    counts as often as it has some. Texts are read whole, twice; results do not depend on how rows are dealt.
    """
    kept = [F.col(f"`{c}`") for c in carry]
    rows = docs.select(F.struct(*kept).alias("row"), F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), "lang")).alias("model"), utf8("text").alias("raw"))
    stored = block_table(rows, _counts, STATS, every=False, spare=("raw",) if "text" in carry else ())
    blocks = stored.withColumn("raw", F.col("row.text").cast("binary")) if "text" in carry else stored  # a carried text is not stored twice
    counts = counted(blocks)
    logs = materialise(scores(counts, counts.select("model", "code"), LEAST_COUNT), "quality-scores")
    lookups = named(blocks).join(logs, ["model", "code"]).select("block", "model", "code", "log")
    kind = rows.schema["row"].dataType.simpleString()
    scored = score_blocks(blocks, lookups, _surprise, ["row", "model", *COUNTS, "raw"], f"row {kind}, model string, {STATS}, n_chars long, total long")
    scored = materialise(scored, "quality-scored")
    release(stored)
    return _judged(scored)


def _judged(scored: DataFrame) -> DataFrame:
    length = F.greatest("n_chars", F.lit(1))
    entropy, some = -F.col("total") / (MICRO * length), scored.filter("n_chars > 0")
    bands = materialise(quantiles(some, "model", entropy, [0.25, 0.5, 0.75], F.col("n_chars")), "quality-bands")
    # The deviation of one character's score, from the median distance: entropy is a mean over n_chars.
    spread = quantiles(some.join(F.broadcast(bands), "model"), "model", F.abs(entropy - F.col("q")[1]) * F.sqrt("n_chars"), [0.5])
    limits = materialise(bands.join(spread.select("model", (F.col("q")[0] / 0.6745).alias("one")), "model"), "quality-limits")
    scored = scored.join(F.broadcast(limits), "model", "left")  # a row a language
    width = F.greatest(F.col("q")[2] - F.col("q")[0], F.lit(LEAST_RANGE))
    more = ERRORS * F.col("one") * F.greatest(1 / F.sqrt(length) - 1 / SURE**0.5, F.lit(0.0))
    low, high = F.col("q")[0] - REACH * width - more, F.col("q")[2] + REACH * width + more
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    within = F.coalesce((entropy >= low) & (entropy <= high), F.lit(True))
    lang = F.when(F.col("model") != "", F.substring("model", 2, 1 << 30)).alias("lang")
    or_none = lambda x, name: F.when(F.col("n_chars") > 0, F.exp(x)).alias(name)
    return scored.select("row", lang, *COUNTS, failed.alias("base_failed"), (~failed & within).alias("kept"), or_none(entropy, "perplexity"), or_none(low, "band_low"), or_none(high, "band_high"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, that pass the base rules and their language's band.

    Null, empty and wordless texts go with the base rules; repeated rows stay or go together; no rows give none.
    """
    out = assess(docs, carry=tuple(docs.columns)).filter("kept")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
