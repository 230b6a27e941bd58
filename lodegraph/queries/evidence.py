"""Text, claims, membership, evaluation and incremental queries over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import text
from lodegraph.operators import claims, delta, documents, evaluation
from lodegraph.runtime import broadcast_if_small, checkpoint, written
from lodegraph.sources.star import table
from lodegraph.streaming.ingest import ingest


def secret_withholding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.withheld(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(out, 256).alias("sha256"), (out != F.coalesce("text", F.lit(""))).alias("withheld"))


def language_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    return docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(lines).alias("n_lines"), F.sum(F.octet_length(F.coalesce("text", F.lit("")))).alias("n_bytes"))


def token_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.postings(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("n").alias("n_tokens"), F.max("n").alias("most"))


def doc_frequency_ambient(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return documents.document_frequency(documents.postings(docs), docs.count()).where("ambient").select("term", "df")


def _occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark terms that aren't ambient, with the documents that hold them; other terms are never posted."""
    docs = table(spark, sf_dir, "documents")
    surfaces = checkpoint(documents.postings(table(spark, sf_dir, "benchmark"), "item_id").select("item_id", "term"))
    terms = broadcast_if_small(checkpoint(surfaces.select("term").distinct()))
    posted = written(documents.postings(docs, only=terms).select("term", "doc_id"))
    frequency = documents.document_frequency(posted, docs.count()).where("NOT ambient")
    return surfaces.join(frequency, "term", "left_semi").join(posted, "term").select("item_id", "doc_id").distinct()


def occurrence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _occurrences(spark, sf_dir).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def hit_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id").join(occurrence_join(spark, sf_dir), "item_id", "left")
    return items.groupBy(documents.hit_bucket(F.coalesce("n_docs", F.lit(0))).alias("bucket")).agg(F.count(F.lit(1)).alias("n_items"))


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one to three words are headings; fewer words are a higher level."""
    lines = documents.numbered_lines(table(spark, sf_dir, "documents"))
    n = F.size(F.split(F.trim("content"), " +"))
    level = F.when((F.length(F.trim("content")) > 0) & (n <= 3), n)
    return documents.sections(lines, level, 3)


def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.byte_windows(table(spark, sf_dir, "documents"), most=4096, overlap=512)


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation is a claim: its role is the modality, its long words the objects."""
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", F.col("turn").alias("id"), text.negative(F.coalesce("text", F.lit(""))).alias("polarity"), F.col("role").alias("modality"), F.array_distinct(documents.words(F.col("text"), "[a-z]{3,}")).alias("objects"))


def proposition_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.bucket_sizes(_claims(spark, sf_dir), ["conv_id"])


def candidate_pair_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = claims.bucket_sizes(_claims(spark, sf_dir), ["conv_id"])
    total = F.sum("n")
    return sizes.agg(F.count(F.lit(1)).alias("n_buckets"), F.sum("pairs").alias("bucket_pairs"), (total * (total - 1) / 2).cast("long").alias("naive_pairs"))


def claim_pair_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.pair_classes(_claims(spark, sf_dir), ["conv_id"])


def ten_class_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.pair_class_counts(_claims(spark, sf_dir), ["conv_id"])


def modality_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that users and assistants share, or that one of them has alone, per conversation."""
    said = table(spark, sf_dir, "conversations").where("role IN ('user', 'assistant')").select("conv_id", "role", F.explode(documents.words(F.col("text"))).alias("term"))
    held = said.groupBy("conv_id", "term").agg(F.bool_or(F.col("role") == "user").alias("u"), F.bool_or(F.col("role") == "assistant").alias("a"))
    return held.groupBy("conv_id", F.when(F.col("u") & F.col("a"), "aligned").when(F.col("u"), "user_only").otherwise("assistant_only").alias("state")).agg(F.count(F.lit(1)).alias("n"))


def identity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one nation, segment and balance band are the same unless their orders' statuses forbid it."""
    band = F.concat_ws("/", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 500).cast("int"))
    keyed = table(spark, sf_dir, "customer").select("c_custkey", band.alias("band"))
    least = keyed.groupBy("band").agg(F.min("c_custkey").alias("left"))
    pairs = keyed.join(least, "band").where("c_custkey <> left").select("left", F.col("c_custkey").alias("right"))
    status = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("open"))
    joined = pairs.join(status.select(F.col("o_custkey").alias("left"), F.col("open").alias("lo")), "left").join(status.select(F.col("o_custkey").alias("right"), F.col("open").alias("ro")), "right")
    return claims.constrained_union(pairs, joined.where("lo <> ro").select("left", "right"))


def pattern_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that match: some urgent order, and a segment of the set. Customers without orders are not known."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.collect_set("o_orderstatus").alias("kinds"))
    joined = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left")
    holds = F.coalesce("urgent", F.lit(False)) & F.col("c_mktsegment").isin("BUILDING", "MACHINERY")
    kinds = F.coalesce("kinds", F.array().cast("array<string>"))
    return joined.select("c_custkey", claims.membership(holds, F.col("urgent").isNotNull(), True).alias("outcome"), claims.confidence(kinds, F.col("c_acctbal") < 0).alias("confidence"))


def membership_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_membership(spark, sf_dir).groupBy("outcome", "confidence").agg(F.count(F.lit(1)).alias("n"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents; a document is said to be bad when symbols are a fiftieth of it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (50 * F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^#*$%&|]", "")) > F.length(F.coalesce("text", F.lit("")))).alias("said"))
    return docs.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("truth")), "doc_id")


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_judged(spark, sf_dir), ["lang"], F.col("truth"), F.col("said"))


def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = evaluation.rates(evaluation.confusion(_judged(spark, sf_dir), ["lang"], F.col("truth"), F.col("said")))
    return counted.select("lang", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def wilson_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.agreement(_judged(spark, sf_dir), ["source"], F.col("truth") == F.col("said"))


def arm_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"), F.round(F.avg("value"), 6).alias("mean_value"))


def paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = evaluation.paired(table(spark, sf_dir, "events"), "user_id", "event_type", "value", "purchase", "view")
    return pairs.select("user_id", F.round("difference", 6).alias("difference"))


def bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.bootstrap_interval(evaluation.paired(table(spark, sf_dir, "events"), "user_id", "event_type", "value", "purchase", "view"), "user_id", "difference")


def unit_plan_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as units; the cache holds those that were labelled, with the text they would have in lower case."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "lang")
    units = docs.select("id", F.sha2("text", 256).alias("digest"), F.lit("v2").alias("contract"))
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality")
    cache = docs.join(labelled, "id").select("id", F.sha2(F.when(F.col("lang") == "de", F.lower("text")).otherwise(F.col("text")), 256).alias("digest"), F.when(F.col("quality") == 0, "v1").otherwise("v2").alias("contract"))
    return delta.unit_plan(units, cache)


def outcome_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership of customers by orders before and after 1998."""
    orders = table(spark, sf_dir, "orders")

    def generation(rows: DataFrame) -> DataFrame:
        n = F.count(F.lit(1))
        return rows.groupBy(F.col("o_custkey").alias("id")).agg(F.when(n >= 5, "member").otherwise("abstain").alias("outcome"), F.lit("d1").alias("definition"), n.cast("string").alias("evidence"))

    cut = F.lit("1998-01-01").cast("timestamp")
    return delta.drift(generation(orders.where(F.col("o_orderdate") < cut)), generation(orders.where(F.col("o_orderdate") >= cut)))


def stream_event_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event totals through a stream of partial aggregates."""
    def partial(batch: DataFrame) -> DataFrame:
        return batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"))

    parts = ingest(spark, f"{sf_dir}/events.parquet", "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string", partial)
    return parts.groupBy("event_type").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


QUERIES = {
    f.__name__: f
    for f in (
        secret_withholding, language_census, token_postings, doc_frequency_ambient, occurrence_join, hit_buckets, document_sections, line_windows,
        proposition_buckets, candidate_pair_count, claim_pair_classes, ten_class_histogram, modality_diff, identity_groups, pattern_membership, membership_outcomes,
        confusion, precision_recall, wilson_by_source, arm_effects, paired_difference, bootstrap_interval, unit_plan_reuse, outcome_drift, stream_event_totals,
    )
}

_POSTED = """
    posted AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{3,}')) AS term FROM documents) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
    bound AS (SELECT greatest(20, ceil(count(*) * 0.05)) AS most FROM documents)"""
_HITS = f"""{_POSTED}, items AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{{3,}}')) AS term FROM benchmark)),
    hits AS (SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM items JOIN df USING (term) JOIN posted USING (term) WHERE df <= (SELECT most FROM bound) GROUP BY item_id)"""
_CLAIMS = r"""
    claims AS (SELECT conv_id, turn AS id, regexp_matches(lower(coalesce(text, '')), '\b(cannot|must not|never|no|not|without)\b') AS polarity, role AS modality,
        list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}')) AS objects FROM conversations),
    sizes AS (SELECT conv_id, count(*) AS n, cast(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pairs FROM claims GROUP BY conv_id),
    compared AS (
        SELECT a.conv_id, a.id AS left_id, b.id AS right_id, a.polarity = b.polarity AS same_polarity, a.modality = b.modality AS same_modality, len(a.objects) AS nl, len(b.objects) AS nr, len(list_intersect(a.objects, b.objects)) AS common
        FROM claims a JOIN claims b ON a.conv_id = b.conv_id AND a.id < b.id WHERE a.conv_id IN (SELECT conv_id FROM sizes WHERE n <= 40)
    ), classed AS (
        SELECT conv_id, left_id, right_id, CASE WHEN common = 0 THEN 'incomparable' WHEN NOT same_polarity THEN 'direct_conflict' WHEN NOT same_modality THEN 'modality_divergence'
            WHEN common = nl AND common = nr THEN 'equivalent' WHEN common * 2 >= least(nl, nr) THEN 'compatible_partial' ELSE 'referent_ambiguity' END AS class FROM compared)"""
#: Pairs of all conversations: what the cut in `compared` above leaves out is left in. The SQL that only counts buckets keeps its text.
_PAIRS = _CLAIMS.replace(" WHERE a.conv_id IN (SELECT conv_id FROM sizes WHERE n <= 40)", "")
_MEMBERS = """
    o AS (SELECT o_custkey AS c_custkey, bool_or(o_orderpriority = '1-URGENT') AS urgent, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1),
    members AS (SELECT c_custkey, CASE WHEN coalesce(urgent, false) AND c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'member' WHEN urgent IS NOT NULL THEN 'not_member' ELSE 'abstain' END AS outcome,
        CASE WHEN c_acctbal < 0 THEN 'contested' WHEN coalesce(kinds, 0) >= 2 THEN 'certain' WHEN kinds = 1 THEN 'likely' ELSE 'plausible' END AS confidence FROM customer LEFT JOIN o USING (c_custkey))"""
_JUDGED = """
    judged AS (SELECT lang, source, quality = 0 AS truth, 50 * length(regexp_replace(coalesce(text, ''), '[^#*$%&|]', '', 'g')) > length(coalesce(text, '')) AS said FROM documents JOIN labels USING (doc_id)),
    counted AS (SELECT lang, count(*) FILTER (WHERE truth AND said) AS tp, count(*) FILTER (WHERE NOT truth AND said) AS fp, count(*) FILTER (WHERE truth AND NOT said) AS fn, count(*) FILTER (WHERE NOT truth AND NOT said) AS tn FROM judged GROUP BY lang)"""
_WILSON = "(p + 3.841458820694124 / (2 * n) {} 1.959963984540054 * sqrt(p * (1 - p) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n)"
_GENERATION = "SELECT o_custkey AS id, CASE WHEN count(*) >= 5 THEN 'member' ELSE 'abstain' END AS outcome, count(*) AS n FROM orders WHERE o_orderdate {} TIMESTAMP '1998-01-01' GROUP BY 1"

ORACLE_SQL = {
    "line_windows": """WITH RECURSIVE split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), lines AS (SELECT doc_id, i AS line, strlen(l[i]) + 1 AS n FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM split)),
            folded AS (SELECT doc_id, line, n, 0 AS w, n AS held FROM lines WHERE line = 1 UNION ALL SELECT l.doc_id, l.line, l.n, CASE WHEN held + l.n > 4096 THEN w + 1 ELSE w END, CASE WHEN held + l.n > 4096 THEN l.n ELSE held + l.n END FROM folded f JOIN lines l ON f.doc_id = l.doc_id AND l.line = f.line + 1),
            made AS (SELECT doc_id, w, min(line) AS line, max(line) AS line_end, sum(n)::BIGINT AS n_bytes FROM folded GROUP BY doc_id, w),
            upto AS (SELECT doc_id, line, sum(n) OVER (PARTITION BY doc_id ORDER BY line) - n AS before FROM lines),
            context AS (SELECT m.doc_id, w, max(c.line) FILTER (WHERE u.before - c.before >= 512) AS reached FROM made m JOIN upto u ON u.doc_id = m.doc_id AND u.line = m.line JOIN upto c ON c.doc_id = m.doc_id AND c.line < m.line GROUP BY ALL)
        SELECT m.doc_id, m.w::BIGINT AS "window", m.line, m.line_end, CASE WHEN m.w = 0 THEN 1 ELSE coalesce(reached, 1) END AS context_line, n_bytes FROM made m LEFT JOIN context USING (doc_id, w)""",
    "secret_withholding": r"""SELECT doc_id, sha256(out) AS sha256, out <> text AS withheld FROM (SELECT doc_id, text, regexp_replace(regexp_replace(marked, chr(64976) || '["''`]' || chr(64977) || '["''`]', '''[redacted]''', 'g'), chr(64976) || chr(64977), '', 'g') AS out
        FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '(?i)((?:password|passwd|secret|api[_-]?key|token)["'']?[ \t\x0b\f\r]*[=:][ \t\x0b\f\r]*)(?:(["''`])[^"''`\n]*(["''`])|([^ \t\x0b\f\r\n,;}]+))',
            '\1\4' || chr(64976) || '\2' || chr(64977) || '\3', 'g') AS marked FROM documents))""",
    "language_census": "SELECT lang, source, count(*) AS n_docs, cast(sum(len(string_split(coalesce(text, ''), chr(10)))) AS BIGINT) AS n_lines, cast(sum(strlen(coalesce(text, ''))) AS BIGINT) AS n_bytes FROM documents GROUP BY lang, source",
    "token_postings": f"WITH {_POSTED} SELECT doc_id, count(*) AS n_terms, cast(sum(n) AS BIGINT) AS n_tokens, max(n) AS most FROM posted GROUP BY doc_id",
    "doc_frequency_ambient": f"WITH {_POSTED} SELECT term, df FROM df WHERE df > (SELECT most FROM bound)",
    "occurrence_join": f"WITH {_HITS} SELECT item_id, n_docs FROM hits",
    "hit_buckets": f"""WITH {_HITS} SELECT CASE WHEN n = 0 THEN '0' WHEN n <= 5 THEN '1-5' WHEN n <= 25 THEN '6-25' WHEN n <= 100 THEN '26-100' ELSE '>100' END AS bucket, count(*) AS n_items
        FROM (SELECT item_id, coalesce(n_docs, 0) AS n FROM benchmark LEFT JOIN hits USING (item_id)) GROUP BY 1""",
    "document_sections": r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents),
            n AS (SELECT doc_id, line, regexp_matches(content, '^\s*(```|~~~)') AS fence, trim(content) AS t, len(regexp_split_to_array(trim(content), ' +')) AS w FROM l),
            m AS (SELECT doc_id, line, CASE WHEN NOT fence AND sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) % 2 = 0 AND t <> '' AND w <= 3 THEN w END AS level, max(line) OVER (PARTITION BY doc_id) AS last FROM n),
            s AS (SELECT doc_id, line, level, last, min(line) FILTER (WHERE level <= 1) OVER w AS a, min(line) FILTER (WHERE level <= 2) OVER w AS b, min(line) FILTER (WHERE level <= 3) OVER w AS c FROM m
                WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
        SELECT doc_id, cast(line AS INT) AS line, cast(level AS INT) AS level, cast(coalesce(CASE level WHEN 1 THEN a WHEN 2 THEN b ELSE c END - 1, last) AS INT) AS line_end FROM s WHERE level IS NOT NULL""",
    "proposition_buckets": f"WITH {_CLAIMS} SELECT conv_id, n, pairs FROM sizes",
    "candidate_pair_count": f"WITH {_CLAIMS} SELECT count(*) AS n_buckets, cast(sum(pairs) AS BIGINT) AS bucket_pairs, cast(sum(n) * (sum(n) - 1) / 2 AS BIGINT) AS naive_pairs FROM sizes",
    "claim_pair_classes": f"WITH {_PAIRS} SELECT * FROM classed",
    "ten_class_histogram": f"WITH {_PAIRS} SELECT class, count(*) AS n FROM classed GROUP BY class",
    "modality_diff": """WITH h AS (SELECT conv_id, term, bool_or(role = 'user') AS u, bool_or(role = 'assistant') AS a
            FROM (SELECT conv_id, role, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{3,}')) AS term FROM conversations WHERE role IN ('user', 'assistant')) GROUP BY ALL)
        SELECT conv_id, CASE WHEN u AND a THEN 'aligned' WHEN u THEN 'user_only' ELSE 'assistant_only' END AS state, count(*) AS n FROM h GROUP BY 1, 2""",
    "pattern_membership": f"WITH {_MEMBERS} SELECT * FROM members",
    "membership_outcomes": f"WITH {_MEMBERS} SELECT outcome, confidence, count(*) AS n FROM members GROUP BY outcome, confidence",
    "confusion": f"WITH {_JUDGED} SELECT * FROM counted",
    "precision_recall": f"""WITH {_JUDGED}, r AS (SELECT lang, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS r FROM counted)
        SELECT lang, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) END, 9) AS f1 FROM r""",
    "wilson_by_source": f"""WITH {_JUDGED}, a AS (SELECT source, count(*) FILTER (WHERE truth = said) AS k, count(*) AS n, count(*) FILTER (WHERE truth = said) / count(*) AS p FROM judged GROUP BY source)
        SELECT source, k, n, round(greatest({_WILSON.format('-')}, 0.0), 9) AS low, round(least({_WILSON.format('+')}, 1.0), 9) AS high FROM a""",
    "arm_effects": "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type",
    "paired_difference": """SELECT user_id, round(avg(value) FILTER (WHERE event_type = 'purchase') - avg(value) FILTER (WHERE event_type = 'view'), 6) AS difference FROM events GROUP BY user_id
        HAVING count(*) FILTER (WHERE event_type = 'purchase') > 0 AND count(*) FILTER (WHERE event_type = 'view') > 0""",
    "unit_plan_reuse": """WITH c AS (SELECT doc_id, CASE WHEN lang = 'de' THEN lower(text) ELSE text END AS old, CASE WHEN quality = 0 THEN 'v1' ELSE 'v2' END AS contract FROM documents JOIN labels USING (doc_id)),
            r AS (SELECT d.doc_id AS id, CASE WHEN c.doc_id IS NULL THEN 'new' WHEN contract <> 'v2' THEN 'contract_changed' WHEN old <> text THEN 'content_changed' ELSE 'hit' END AS reason FROM documents d LEFT JOIN c USING (doc_id))
        SELECT id, CASE WHEN reason = 'hit' THEN 'reuse' ELSE 'produce' END AS action, reason FROM r""",
    "outcome_drift": f"""WITH a AS ({_GENERATION.format('<')}), b AS ({_GENERATION.format('>=')})
        SELECT id, a.outcome AS old, b.outcome AS new, CASE WHEN a.id IS NULL THEN 'appeared' WHEN b.id IS NULL THEN 'vanished' WHEN a.n <> b.n THEN 'evidence' ELSE 'unexplained' END AS cause
        FROM a FULL JOIN b USING (id) WHERE a.outcome IS DISTINCT FROM b.outcome""",
    "stream_event_totals": "SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS greatest FROM events GROUP BY event_type",
}
