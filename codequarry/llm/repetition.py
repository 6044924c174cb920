"""Repetition inside a single text.

Words are maximal runs of letters, lower-cased. A word is repeated if it lies in a run of
``n`` words that already began at an earlier word of the same text. The share is repeated
words over all words. Thresholds adapt: per language and source a mergeable quantile sketch
of the shares gives the cutoff; groups with too few texts take the merged sketch of their
language, and those of too small languages the merged sketch of everything.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codequarry.session import cut

WORDS = re.compile(r"[^\W\d_]+")
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    words = WORDS.findall(text.lower())
    if text.isascii() or ("İ" not in text and all(map(str.isalpha, words))):
        return words
    # superscripts, fractions and the like are word characters, but neither digits nor letters
    return [w.lower() for w in WORDS.findall("".join(c if c.isalpha() else " " for c in text))]


def repeated_words(words: list[str], n: int) -> int:
    """How many words lie in a run of ``n`` words that began at an earlier word."""
    k = len(words) - n + 1
    if k < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    g = h[:k].copy()
    for i in range(1, n):
        g *= _P
        g += h[i : i + k]
    order = np.argsort(g, kind="stable")
    s = g[order]
    again = order[1:][s[1:] == s[:-1]]
    if not len(again):
        return 0
    mark = np.zeros(len(words) + 1, np.int32)
    np.add.at(mark, again, 1)
    np.add.at(mark, again + n, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def repetition(docs: DataFrame, id_col: str, text_col: str, keep: list[Column] | tuple = (), n: int = 5) -> DataFrame:
    """(id, *keep, n_words, n_repeated, share) of every row; ``keep`` columns are carried along.

    NULL, empty and wordless texts have a share of 0. Repeated rows stay repeated. Whole texts are read.
    """
    src = docs.select(F.col(f"`{id_col}`"), *keep, F.col(f"`{text_col}`").alias("_text"))
    rest = [c for c in src.columns if c != "_text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_text") + ", n_words long, n_repeated long, share double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, again = [], []
            for t in b.column("_text"):
                w = words_of(t.as_py() or "")
                total.append(len(w))
                again.append(repeated_words(w, n))
            share = [a / t if t else 0.0 for a, t in zip(again, total)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array(total, pa.int64()), pa.array(again, pa.int64()), pa.array(share, pa.float64())], [*rest, "n_words", "n_repeated", "share"])

    return src.mapInArrow(run, schema)


def thresholds(shares: DataFrame, lang: str, source: str, quantile: float | None, least: int, target: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cutoffs by (language, source), by language, and overall, from one pass of sketches that are merged upwards.

    A cutoff is the ``quantile`` of the shares, or the last percentile that the sketch puts at or
    below ``target`` (the least share, if all lie above), which is never above the target unless
    every share of the group is.
    """
    fine = shares.groupBy(lang, source).agg(F.kll_sketch_agg_double("share").alias("sketch"), F.count("share").alias("n"))
    by_lang = fine.groupBy(lang).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    top = by_lang.agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    if target is None:
        cut_at = F.kll_sketch_get_quantile_double("sketch", F.lit(quantile))
    else:
        ladder = F.kll_sketch_get_quantile_double("sketch", F.array(*(F.lit(i / 100) for i in range(101))))
        cut_at = F.coalesce(F.array_max(F.filter(ladder, lambda x: x <= target)), F.element_at(ladder, 1))
    at = lambda c, n: F.when(F.col("n") >= n, cut_at).alias(c)
    return fine.select(lang, source, at("cut_fine", least)), by_lang.select(F.col(lang).alias("l_lang"), at("cut_lang", least)), top.select(at("cut_all", 1))


def clean_label(c: str) -> Column:
    """Spellings of a language or source fall together: case, outer blanks, ``-`` for ``_``; NULL is ''."""
    return F.coalesce(F.translate(F.lower(F.trim(F.col(c))), "-", "_"), F.lit(""))


def flag_repetitive(shares: DataFrame, lang: str = "lang", source: str = "source", quantile: float = 0.95, floor: float = 0.0, ceiling: float = 1.0, least: int = 200, target: float | None = None) -> DataFrame:
    """Adds ``cutoff`` and ``repetitive`` (share >= cutoff) to shares with a language and a source.

    The cutoff is the group's quantile, held between ``floor`` and ``ceiling``. With ``target``
    it is instead the last percentile of the group at or below the target, so that the flag holds
    every text of the group at or above the target and few below; an exact check can follow.
    NULL and differently spelled languages and sources fall together. The group tables hold one
    row per language and source; the join on them is left to the optimizer, which broadcasts them
    by size or splits skewed keys.
    """
    s = cut(shares.withColumn("_lang", clean_label(lang)).withColumn("_source", clean_label(source)))  # texts are read once, not again for each sketch
    fine, by_lang, top = thresholds(s, "_lang", "_source", quantile, least, target)
    cuts = fine.join(by_lang, F.col("_lang") == F.col("l_lang")).crossJoin(F.broadcast(top)).select(F.col("_lang").alias("c_lang"), F.col("_source").alias("c_source"), F.coalesce("cut_fine", "cut_lang", "cut_all").alias("cutoff"), "cut_fine")
    joined = s.join(cuts, (F.col("_lang") == F.col("c_lang")) & (F.col("_source") == F.col("c_source")))
    if target is None:
        cutoff = F.least(F.greatest(F.col("cutoff"), F.lit(floor)), F.lit(ceiling))
    else:  # a wider group's shares may all lie above the target while some of this group don't
        cutoff = F.when(F.col("cut_fine").isNotNull(), F.col("cutoff")).otherwise(F.least(F.col("cutoff"), F.lit(target)))
    return joined.withColumn("cutoff", cutoff).withColumn("repetitive", F.col("share") >= F.col("cutoff")).drop("_lang", "_source", "c_lang", "c_source", "cut_fine")
