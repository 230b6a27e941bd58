"""Quality rules whose cutoffs come from labelled holdouts under a guaranteed risk.

Every rule scores a text. The documents labelled good, one of each class of near-duplicates so that
they are independent draws, are dealt into two parts by a hash of their class. The smaller part, over
all strata together, puts the rules on one scale: a score is as severe as it is rare among good
documents, so the severity of a text is that of its most unusual score. The larger part is the
holdout: per stratum, the false rejections of a candidate cutoff on severity are counted, and the
cutoff is certified when the exact (Clopper-Pearson) upper bound on its rejection probability is at
most `RISK`. Candidates are tested in a fixed order, from the loosest to the strictest, up to the
first that isn't certified, which needs no correction along the grid; across strata the level
`ERROR` is divided (Bonferroni). As all rules are rejected on together, they share one test.

With probability 1 - ERROR, no stratum therefore loses more than RISK of its good documents (those
that pass the base rule, counted by class) to the rules. A stratum with too few labels (220 at four strata)
has no cutoff, and nothing in it is rejected by rules.

Text features are one narrow pass. Calibration sees histograms per stratum, so their size doesn't
depend on the number of labels, and each stratum is calibrated in its own group.

Defined cases: a null or empty text has no words and fails the base rule; a null stratum is a
stratum of its own, other than the empty one; a score between two bins counts to the upper one, and a score equal to
the cutoff is kept; very long texts are measured whole; a document with conflicting labels counts as not good; labels of absent
documents and null labels are ignored; rows that repeat a doc_id are judged apart; an empty
labels table leaves the base rule alone; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.llm.common import map_batches, text_key
from lodegraph.llm.jaccard_join import near_duplicates
from lodegraph.runtime import broadcast_if_small, checkpoint, written

RISK = 0.02
ERROR = 0.05
BINS = 64
#: One in so many classes of good documents sets the scale; the others are the holdout.
SCALE_FOLDS = 4
WINDOW = 8
MIN_WORDS = 20
MOST_REPEATED = 30  # percent of words in repeated windows

#: Rule name to its score, an expression over the features, and the score of the last bin.
RULES: dict[str, tuple[str, float]] = {
    "symbols": ("n_symbols / greatest(n_words, 1)", 2.0),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", 1.0),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", 1.0),
    "no_letter": ("n_no_letter / greatest(n_words, 1)", 1.0),
    "shouting": ("n_upper / greatest(word_chars, 1)", 1.0),
    "marks": ("n_marks / greatest(n_words, 1)", 4.0),
}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_no_letter", "n_upper", "n_marks")

_ODD_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_WORD = re.compile("[^\x20\x09-\x0d]+")
_SYMBOL, _UPPER, _MARK = re.compile(r"[#*$%&|<>]"), re.compile(r"[A-Z]"), re.compile(r"[!?]")
_LETTERED = re.compile(r"[^\W\d_]")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text) if _ODD_SPACE.search(text) else text.split()


def repeated_words(words: Sequence[str], window: int = WINDOW) -> int:
    """Words covered by windows of `window` words that occur twice or more; exact, by rank doubling."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    rank = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    span = 1
    while span < window:
        step = min(span, window - span)
        pairs = rank[: len(rank) - step] * (len(words) + 1) + rank[step:]
        rank = np.unique(pairs, return_inverse=True)[1]
        span += step
    again = np.bincount(rank)[rank] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def features_of(text: str | None) -> tuple[int, ...]:
    """The values of FEATURES for one text."""
    if not text:
        return (0,) * len(FEATURES)
    words, lines = words_of(text), [x for x in text.split("\n") if _WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)), repeated_words(words), len(lines),
        sum(not w.isalpha() and not _LETTERED.search(w) for w in words), len(_UPPER.findall(text)), len(_MARK.findall(text)),
    )


def features(docs: DataFrame, stratum: str | None = "lang") -> DataFrame:
    """Per row: doc_id, row_key, stratum and FEATURES."""
    kind = dict(docs.dtypes)["doc_id"]

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features_of(t) for t in batch.column("text").to_pylist()]
        columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * len(FEATURES)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row_key", "stratum")), *columns], names=["doc_id", "row_key", "stratum", *FEATURES])

    held = F.col(stratum).cast("string") if stratum else F.lit("")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("row_key"), held.alias("stratum"), "text")
    return map_batches(rows, measure, ", ".join([f"doc_id {kind}, row_key long, stratum string", *(f"{c} long" for c in FEATURES)]))


def score_bin(rule: str, bins: int = BINS) -> Column:
    """The score of a rule, in equal steps up to its last bin."""
    score, top = RULES[rule]
    return F.least(F.ceil(F.expr(score) * (bins / top)), F.lit(bins)).cast("int")


def binomial_below(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial (n, p), through the incomplete beta function's continued fraction."""
    if k >= n or p <= 0:
        return 1.0
    if k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 100_000):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / (c if abs(c) > tiny else tiny)
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * fraction(a, b, x) / a)
    return max(0.0, 1 - front * fraction(b, a, 1 - x) / b)


def certified_bin(counts: Iterable[tuple[int, int]], n: int, risk: float, level: float, bins: int = BINS) -> int | None:
    """The strictest certified cutoff: texts of a higher bin are rejected. counts: (bin, good documents in it).

    The upper bound on the rejection probability at confidence 1 - level is at most `risk` exactly
    when so few rejections have a probability of at most `level` under `risk`.
    """
    held, rejected, best = dict(counts), 0, None
    for cut in range(bins - 1, -1, -1):
        rejected += held.get(cut + 1, 0)
        if binomial_below(rejected, n, risk) > level:
            break
        best = cut
    return best


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def good_classes(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row (_d, _k, scales) per class of near-duplicates among the documents labelled good."""
    good = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality")).where("_quality = 1").select("doc_id")
    rows = docs.select("doc_id", "text").join(broadcast_if_small(checkpoint(good)), "doc_id", "left_semi")
    one = near_duplicates(rows).where("stays").dropDuplicates(["doc_id", "row_key"])
    return one.select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k"), (F.pmod(F.crc32(F.col("class_id").cast("string")), F.lit(SCALE_FOLDS)) == 0).alias("scales"))


def severity_scale(scaling: DataFrame, bins: int = BINS) -> dict[str, list[int]] | None:
    """By rule, the severity (0 to `bins`) of each score bin: how rare it is that a good document scores as high."""
    stacked = scaling.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), score_bin(r, bins).alias("bin")) for r in RULES])).alias("s"))
    counts = {(r["rule"], r["bin"]): r["n"] for r in stacked.groupBy("s.rule", "s.bin").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per rule and bin at most
    total = sum(n for (rule, _), n in counts.items() if rule == next(iter(RULES)))
    if not total:
        return None
    out = {}
    for rule in RULES:
        levels, above = [0] * (bins + 1), 0
        for b in range(bins, -1, -1):
            above += counts.get((rule, b), 0)
            levels[b] = round(bins * math.log((total + 1) / (above + 1)) / math.log(total + 1))
        out[rule] = levels
    return out


def severity(rule: str, scale: dict[str, list[int]], bins: int = BINS) -> Column:
    return F.element_at(F.array(*map(F.lit, scale[rule])), score_bin(rule, bins) + 1)


def cutoffs(holdout: DataFrame, n_strata: int, scale: dict[str, list[int]], risk: float = RISK, error: float = ERROR, bins: int = BINS) -> DataFrame:
    """Per stratum, the severity above which a text is rejected, or null."""
    worst = F.greatest(*[severity(r, scale, bins) for r in RULES])
    histogram = holdout.groupBy("stratum", worst.alias("level")).agg(F.count(F.lit(1)).alias("n"))
    level = error / max(1, n_strata)

    def calibrate(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        cut = certified_bin(zip(table["level"], table["n"], strict=True), int(table["n"].sum()), risk, level, bins)
        return pd.DataFrame({"_stratum": pd.array([None if pd.isna(key[0]) else key[0]], dtype="string"), "cut": pd.array([cut], dtype="Int32")})

    return histogram.groupBy("stratum").applyInPandas(calibrate, "_stratum string, cut int")


def judge(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """Per row: doc_id, stratum, FEATURES, base_failed, failed_rules, kept."""
    measured = written(features(docs, stratum))
    good = good_classes(docs, labels)
    chosen = measured.where(~base_failed()).join(good, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("row_key") == F.col("_k")))
    chosen = checkpoint(chosen.dropDuplicates(["doc_id", "row_key"]))
    scale = severity_scale(chosen.where("scales"))
    failed = F.array().cast("array<string>")
    judged = measured
    if scale:
        limits = checkpoint(cutoffs(chosen.where("NOT scales"), measured.groupBy("stratum").count().count(), scale, risk, error))
        judged = measured.join(broadcast_if_small(limits), F.col("stratum").eqNullSafe(F.col("_stratum")), "left")
        failed = F.filter(F.array(*[F.when(severity(r, scale) > F.col("cut"), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    judged = judged.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    return judged.select("doc_id", "stratum", *FEATURES, "base_failed", "failed_rules", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"))
