"""Comparison of propositions in ten classes, and verdicts from signals.

A proposition has objects (an array of tokens), polarity, modality, scope, validity, the subject's term and
whether its referent is resolved. Propositions are compared inside buckets of a bounded size only; larger buckets
are returned by `oversize`, never silently left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.claims import BUCKET_CAP, bucket_sizes

CLASSES = (
    "equivalent_proposition", "compatible_partial", "direct_conflict", "scope_divergence", "temporal_divergence", "modality_divergence", "conformance_gap_candidate", "referent_ambiguity",
    "terminology_conflict", "incomparable",
)
FIELDS = ("polarity", "modality", "scope", "validity", "term", "resolved")
#: The polarity that opposes every other, and the two modalities of a documented requirement and a factual statement.
NEGATED, CONFORMANCE = "negated", ("normative", "descriptive")


def canonical(term: Column) -> Column:
    return F.regexp_replace(F.lower(term), "[^a-z0-9]+", "")


def initials(term: Column) -> Column:
    """First letters of a term of two word parts or more, else null."""
    parts = F.filter(F.split(F.lower(term), "[^a-z0-9]+"), lambda w: w != "")
    return F.when(F.size(parts) >= 2, F.array_join(F.transform(parts, lambda w: F.substring(w, 1, 1)), ""))


def variant_of(a: Column, fa: Column, ia: Column, b: Column, fb: Column, ib: Column) -> Column:
    """`term_variant` of terms that come with their canonical forms and initials, which a join would compute again for each pair."""
    prefix = (F.length(fa) >= 3) & (F.length(fb) >= 3) & (F.startswith(fa, fb) | F.startswith(fb, fa))
    acronym = F.coalesce(fa == ib, F.lit(False)) | F.coalesce(fb == ia, F.lit(False))
    return F.coalesce((a != b) & (fa != "") & (fb != "") & ((fa == fb) | prefix | acronym), F.lit(False))


def term_variant(a: Column, b: Column) -> Column:
    """Different terms for one thing: equal when only letters and digits count, one a prefix of the other (both of three or more), or the acronym of its word parts."""
    return variant_of(a, canonical(a), initials(a), b, canonical(b), initials(b))


def relation_class(left: str = "l_", right: str = "r_") -> Column:
    """The class of a pair of `prepared` propositions of one bucket; the first rule that holds decides."""
    c = lambda side, f: F.col(side + f)
    differ = lambda f: ~c(left, f).eqNullSafe(c(right, f))
    either = lambda f, value: F.coalesce(c(left, f) == value, F.lit(False)) | F.coalesce(c(right, f) == value, F.lit(False))
    lo, ro = c(left, "objects"), c(right, "objects")
    common, smaller = F.size(F.array_intersect(lo, ro)), F.least(F.size(lo), F.size(ro))
    equal = (common == F.size(lo)) & (common == F.size(ro))
    disjoint = ~equal & ((common == 0) | (common * 2 < smaller))
    unresolved = ~(F.coalesce(c(left, "resolved"), F.lit(False)) & F.coalesce(c(right, "resolved"), F.lit(False)))
    variant = unresolved & variant_of(*(c(side, f) for side in (left, right) for f in ("term", "canonical", "initials")))
    ambiguous = unresolved & differ("term")
    return (
        F.when(disjoint & ambiguous, "referent_ambiguity")
        .when(disjoint, "incomparable")
        .when(differ("polarity") & either("polarity", NEGATED), "direct_conflict")
        .when(equal & either("modality", CONFORMANCE[0]) & either("modality", CONFORMANCE[1]), "conformance_gap_candidate")
        .when(equal & differ("modality"), "modality_divergence")
        .when(equal & differ("scope"), "scope_divergence")
        .when(equal & differ("validity"), "temporal_divergence")
        .when(variant, "terminology_conflict")
        .when(ambiguous, "referent_ambiguity")
        .when(equal, "equivalent_proposition")
        .otherwise("compatible_partial")
    )


def prepared(propositions: DataFrame) -> DataFrame:
    return propositions.withColumn("objects", F.array_distinct("objects")).withColumn("canonical", canonical(F.col("term"))).withColumn("initials", initials(F.col("term")))


def compared(propositions: DataFrame, bucket: str, cap: int = BUCKET_CAP) -> DataFrame:
    """Rows (bucket, left_id, right_id, class) of the pairs inside buckets of at most `cap` propositions."""
    fit = prepared(propositions).join(bucket_sizes(propositions, [bucket]).where(F.col("n") <= cap).select(bucket), bucket, "left_semi")
    parts = int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fit = fit.repartition(parts, bucket)  # few rows make many pairs, so small partitions mustn't be coalesced
    side = lambda p: fit.select(bucket, F.col("id").alias(f"{p}id"), *[F.col(f).alias(p + f) for f in ("objects", "canonical", "initials", *FIELDS)])
    return side("l_").join(side("r_"), bucket).where("l_id < r_id").select(bucket, F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), relation_class().alias("class"))


def oversize(propositions: DataFrame, bucket: str, cap: int = BUCKET_CAP) -> DataFrame:
    """The buckets that `compared` leaves, with their propositions and the pairs they would take."""
    return bucket_sizes(propositions, [bucket]).where(F.col("n") > cap)


def combined_signal(supports: Column, refutes: Column) -> Column:
    """Two kinds of evidence to one of four signals."""
    s, r = F.coalesce(supports, F.lit(False)), F.coalesce(refutes, F.lit(False))
    return F.when(s & r, "conflict").when(s, "supported").when(r, "refuted").otherwise("underdetermined")


#: From the strongest on: one result of this kind decides the verdict of a claim.
VERDICTS = ("refuted", "unverifiable", "underdetermined", "supported")


def verdict(results: DataFrame, claim: str, result: str) -> DataFrame:
    """Rows (claim, verdict, n_results): the strongest result of each claim's obligations, by a map-side combined minimum."""
    rank = F.array_position(F.array(*map(F.lit, VERDICTS)), F.col(result))
    counted = results.groupBy(claim).agg(F.min(rank).alias("rank"), F.count(F.lit(1)).alias("n_results"))
    return counted.select(claim, F.element_at(F.array(*map(F.lit, VERDICTS)), F.col("rank").cast("int")).alias("verdict"), "n_results")


def realization(has_new: Column, has_old: Column, agrees: Column) -> Column:
    """What became of a plan: implemented, partial, diverged, not_started, removed or unknown."""
    return (
        F.when(has_new.isNull() | has_old.isNull(), "unknown").when(has_new & agrees, "implemented").when(has_new & has_old & ~agrees, "partial").when(has_new & ~agrees, "diverged").when(has_old, "removed").otherwise("not_started")
    )
