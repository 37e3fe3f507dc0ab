"""Language identification with one Kneser-Ney character model per language.

The models (ngram_lm) are counted by Spark over all training documents. A text gets the language with the lowest
cross-entropy per character. The margin to the runner-up is calibrated on the training rows: `rejected` marks
predictions whose margin is below the 0.5% quantile of correct training predictions. The score is a softmax of the
entropies, each times TRUST and the square root of the text's length, since neighbouring n-grams are not independent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialise, release, utf8
from .ngram_lm import MICRO, Trigrams, block_table, counted, languages_of, named, quantiles, score_blocks, scores, sorted_arrays, sums

#: The share of correct training predictions that calibrated rejection may lose.
REJECT = 0.005
TRUST = 4.0


def _score(languages: list[str]):
    def run(texts: pa.Table, lookups: pa.Table) -> pa.Table:
        grams = Trigrams(texts.column("raw").to_pylist())
        n, letters = np.diff(grams.offsets), np.array(texts.column("letters").to_pylist(), bool)
        rows, known = len(n), len(languages)
        codes, order = sorted_arrays(lookups)
        logs = lookups.column("logs").combine_chunks().flatten().to_numpy().reshape(len(codes), -1)[order] if len(codes) else np.zeros((0, known), np.int32)
        entropy = np.zeros((rows, known))
        for j in range(known):
            entropy[:, j] = -sums(grams.looked_up(grams.at, codes, logs[:, j].astype(np.int64)), grams.offsets) / (MICRO * np.maximum(n, 1))
        letters &= known > 0
        least, margin, score, pred = np.zeros(rows), np.zeros(rows), np.zeros(rows), np.full(rows, "und", object)
        if known:
            best = entropy.argmin(1)
            least = entropy[np.arange(rows), best]
            margin = (np.partition(entropy, 1, axis=1)[:, 1] if known > 1 else least + 1.0) - least
            score = 1 / np.exp(-(entropy - least[:, None]) * (TRUST * np.sqrt(n))[:, None]).sum(1)
            pred = np.where(letters, np.array(languages, object)[best], "und")
        out = texts.select(["doc_id", "held_out", "lang"])
        new = {"lang_pred": pa.array(pred, pa.string()), "score": pa.array(np.where(letters, score, 0.0)), "entropy": pa.array(least), "margin": pa.array(np.where(letters, margin, 0.0))}
        for name, column in new.items():
            out = out.append_column(name, column)
        return out

    return run


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, margin, rejected for every row of docs.

    Trained on rows with non-null lang that are not held out; lang and doc_id serve training only. lang_pred is 'und'
    with score 0 where the text is null, empty or has no letter, and everywhere when nothing could be learned. Equal
    entropies go to the language that is first by code point. Repeated rows are scored each; an empty table gives no
    rows; a null id is not held out. Every language that occurs in a training row is learned. Results do not depend on
    how rows are dealt.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "lang", utf8("text").alias("raw"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    rows = rows.withColumn("model", F.when(~F.col("held_out"), F.col("lang")))
    blocks = block_table(rows, lambda batch: {}, "", every=True)
    languages = languages_of(blocks.filter("place >= 0 and not held_out"))
    counts, every = counted(blocks), named(blocks).filter("model is null").drop("model")
    each = every.select("code").distinct().select(F.explode(F.array(*map(F.lit, languages))).alias("model"), "code") if languages else counts.select("model", "code")
    logs = scores(counts, materialise(each, "langid-wanted")).groupBy("code").agg(F.array_sort(F.collect_list(F.struct("model", "log"))).alias("x"))
    lookups = every.join(logs.select("code", F.transform("x", lambda x: x["log"]).alias("logs")), "code").select("block", "code", "logs")
    scored = score_blocks(blocks, lookups, _score(languages), ["doc_id", "held_out", "lang", "letters", "raw"], "doc_id long, held_out boolean, lang string, lang_pred string, score double, entropy double, margin double")
    scored = materialise(scored, "langid-scored")
    release(blocks)
    right = scored.filter(~F.col("held_out") & (F.col("lang") == F.col("lang_pred"))).withColumn("all", F.lit(0))
    least = quantiles(right, "all", F.col("margin"), [REJECT]).first()
    return scored.select("doc_id", "held_out", "lang_pred", "score", "entropy", "margin", (F.col("margin") < F.lit(float(least.q[0]) if least else 0.0)).alias("rejected"))
