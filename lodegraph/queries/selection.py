"""Reading and selecting over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import text
from lodegraph.operators import reading, selection
from lodegraph.queries.ledgers import _PATH
from lodegraph.sources import star
from lodegraph.sources.star import GRAPH_SQL, table

GLOBS = ["/de/**", "/**/*2?", "/en/*.html", "/fr"]


def fact_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lines around the middle line of each document, and around one past its end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    facts = docs.select("doc_id", F.posexplode(F.array(F.floor((n + 1) / 2).cast("int"), n + 5)).alias("fact", "at"))
    found = reading.read_span(docs, facts, "doc_id", "fact", "at", 3, 3)
    return found.select("doc_id", "fact", "line", "line_end", F.sha2("span", 256).alias("span_sha256"), "clipped")


def quotes_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last line of each document, as it is, with wider blanks, marked up, or in other case, sought in the document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.substring_index("text", "\n", -1).alias("q"))
    upper = F.translate("q", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    quote = F.when(F.col("doc_id") % 4 == 0, F.col("q")).when(F.col("doc_id") % 4 == 1, F.replace(F.col("q"), F.lit(" "), F.lit("  "))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("**"), "q", F.lit("**"))).otherwise(upper)
    return reading.located(docs.withColumn("quote", quote), "text", "quote").select("doc_id", "method", "n_places", "place")


def screened_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "documents").select("source", F.array_join(reading.screened(F.col("text")), ",").alias("rules"))
    return hits.groupBy("source", "rules").agg(F.count(F.lit(1)).alias("n"))


def paths_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = text.url_path(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path"), reading.left_out(path, GLOBS).alias("left_out"))


def directory_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by folder, each folder wholly in design or held out."""
    folder = F.regexp_replace(F.concat(text.url_host(F.col("url")), text.url_path(F.col("url"))), "/[^/]*$", "")
    return table(spark, sf_dir, "pages").select(folder.alias("folder")).groupBy("folder", selection.directory_split(F.col("folder")).alias("side")).agg(F.count(F.lit(1)).alias("n"))


def trial_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.trial_order(table(spark, sf_dir, "benchmark"), "item_id", ["graph", "files", "both"], 2, "lode")


def copy_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents of the same text after document 20, whole groups up to 100 documents."""
    groups = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256)).agg(F.min("doc_id").alias("component"), F.count(F.lit(1)).alias("n"))
    return selection.component_batch(groups.select("component", "n"), "component", "n", 20, 100)


def supplier_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = star.nodes(spark, sf_dir).where("kind = 'Supplier'").select("node_id", "label")
    return selection.offset_page(suppliers, ["node_id"], 5, 25)


def evidence_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve labelled documents of each source: good ones first, then toxic ones, then by id."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    found = selection.previews(rows, "source", [F.desc_nulls_last("quality"), F.desc_nulls_last("toxic"), "doc_id"], 12)
    return found.select("source", "doc_id", "nth", "n")


def bounded_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and the busiest nodes, at most 60 nodes and 80 edges."""
    nodes = star.nodes(spark, sf_dir)
    return selection.bounded_view(nodes, star.edges(spark, sf_dir), nodes.where("kind = 'Region'"), 60, 80)


def nation_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations with their customers, suppliers and orders as communities."""
    of = lambda name, kind, key, nation: table(spark, sf_dir, name).select(star.node_id(kind, key).alias("node_id"), F.col(nation).alias("community"), F.lit(kind).alias("kind"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(star.node_id("Order", "o_orderkey").alias("node_id"), F.col("c_nationkey").alias("community"), F.lit("Order").alias("kind"))
    members = of("nation", "Nation", "n_nationkey", "n_nationkey").union(of("customer", "Customer", "c_custkey", "c_nationkey")).union(of("supplier", "Supplier", "s_suppkey", "s_nationkey")).union(orders)
    return selection.summaries(members, star.edges(spark, sf_dir))


def recall_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the good documents a screen for toxic ones would keep, from the labelled ones of each source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return selection.recall_estimate(table(spark, sf_dir, "labels").join(docs, "doc_id"), docs, "source", F.col("quality") == 1, F.col("toxic") == 0)


QUERIES = {f.__name__: f for f in (
    fact_spans, quotes_located, screened_texts, paths_left_out, directory_splits, trial_order, copy_batch, supplier_page, evidence_previews, bounded_view, nation_summaries, recall_estimate,
)}

_BLANKS = "trim(regexp_replace({}, '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_PLAIN = "trim(regexp_replace(regexp_replace({}, '[*_`~]+', '', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
_N = "CASE WHEN length({q}) > 0 THEN ((length({t}) - length(replace({t}, {q}, ''))) / length({q}))::BIGINT ELSE 0 END"

ORACLE_SQL = {
    "fact_spans": """
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), f AS (SELECT doc_id, l, len(l) AS n, 0 AS fact, (len(l) + 1) // 2 AS at_ FROM d UNION ALL SELECT doc_id, l, len(l), 1, len(l) + 5 FROM d),
        t AS (SELECT *, greatest(at_ - 3, 1) AS line, greatest(least(at_ + 3, n) - greatest(at_ - 3, 1) + 1, 0) AS wanted FROM f),
        u AS (SELECT *, CASE WHEN wanted = 0 THEN [] ELSE l[line:line + wanted - 1] END AS s FROM t),
        v AS (SELECT *, len(list_filter(range(1, wanted + 1), lambda i: i = 1 OR list_sum(list_transform(s[1:i], lambda x: strlen(x) + 1)) <= 65536)) AS k FROM u)
        SELECT doc_id, fact, CASE WHEN k > 0 THEN line END AS line, CASE WHEN k > 0 THEN line + k - 1 END AS line_end, CASE WHEN k > 0 THEN sha256(array_to_string(s[1:k], chr(10))) END AS span_sha256, k < wanted AS clipped FROM v""",
    "quotes_located": f"""
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10))[-1] AS q FROM documents),
        e AS (SELECT doc_id, text AS t0, CASE doc_id % 4 WHEN 0 THEN q WHEN 1 THEN replace(q, ' ', '  ') WHEN 2 THEN '**' || q || '**' ELSE translate(q, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') END AS q0 FROM d),
        g AS (SELECT doc_id, t0, q0, {_BLANKS.format("t0")} AS t1, {_BLANKS.format("q0")} AS q1, {_PLAIN.format("t0")} AS t2, {_PLAIN.format("q0")} AS q2 FROM e), h AS (SELECT *, lower(t2) AS t3, lower(q2) AS q3 FROM g),
        c AS (SELECT *, {", ".join(f"coalesce({_N.format(t=f't{i}', q=f'q{i}')}, 0) AS n{i}" for i in range(4))} FROM h)
        SELECT doc_id, CASE WHEN n0 > 0 THEN 'exact' WHEN n1 > 0 THEN 'whitespace' WHEN n2 > 0 THEN 'markup' WHEN n3 > 0 THEN 'case' ELSE 'missing' END AS method,
               CASE WHEN n0 > 0 THEN n0 WHEN n1 > 0 THEN n1 WHEN n2 > 0 THEN n2 ELSE n3 END AS n_places,
               CASE WHEN n0 > 0 THEN CASE WHEN n0 = 1 THEN strpos(t0, q0) END WHEN n1 > 0 THEN CASE WHEN n1 = 1 THEN strpos(t1, q1) END WHEN n2 > 0 THEN CASE WHEN n2 = 1 THEN strpos(t2, q2) END WHEN n3 = 1 THEN strpos(t3, q3) END AS place FROM c""",
    "screened_texts": """
        SELECT source, concat_ws(',', CASE WHEN regexp_matches(text, '(?i)(pass(word|phrase|wd)|secret|token|api[_-]?key)["'']?[ \\t]*[:=][ \\t]*["'']?[^ \\t\\n"'']{8,}') THEN 'credential' END,
            CASE WHEN regexp_matches(text, '(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}([^0-9]|$)') THEN 'identifier' END,
            CASE WHEN regexp_matches(text, '(^|[^0-9])[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}([^0-9]|$)') THEN 'payment' END) AS rules, count(*) AS n FROM documents GROUP BY 1, 2""",
    "paths_left_out": f"""
        WITH p AS (SELECT page_id, {_PATH} AS path FROM pages)
        SELECT page_id, path, path LIKE '/de/%' OR regexp_full_match(path, '/(.*/)?[^/]*2[^/]') OR regexp_full_match(path, '/en/[^/]*\\.html') OR path = '/fr' AS left_out FROM p""",
    "directory_splits": f"""
        WITH p AS (SELECT regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || {_PATH}, '/[^/]*$', '') AS folder FROM pages)
        SELECT folder, CASE WHEN strpos('02468ace', substr(sha256(folder), 2, 1)) > 0 THEN 'design' ELSE 'heldout' END AS side, count(*) AS n FROM p GROUP BY 1, 2""",
    "trial_order": """
        SELECT item_id, r AS repetition, row_number() OVER (PARTITION BY item_id, r ORDER BY sha256('lode:' || item_id || ':' || r || ':' || arm)) AS nth, arm
        FROM (SELECT DISTINCT item_id FROM benchmark), (VALUES (1), (2)) AS reps(r), (VALUES ('graph'), ('files'), ('both')) AS arms(arm)""",
    "copy_batch": """
        WITH g AS (SELECT min(doc_id) AS component, count(*) AS n FROM documents GROUP BY text), a AS (SELECT *, sum(n) OVER (ORDER BY component)::BIGINT AS upto, count(*) OVER () AS total FROM g WHERE component > 20)
        SELECT component, n, upto, total - count(*) OVER () AS n_deferred FROM a WHERE upto - n < 100""",
    "supplier_page": f"WITH {GRAPH_SQL} SELECT node_id, label FROM nodes WHERE kind = 'Supplier' ORDER BY node_id LIMIT 25 OFFSET 5",
    "evidence_previews": """
        SELECT source, doc_id, nth, n FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY quality DESC NULLS LAST, toxic DESC NULLS LAST, doc_id) AS nth, count(*) OVER (PARTITION BY source) AS n
            FROM labels JOIN documents USING (doc_id)) WHERE nth <= 12""",
    "bounded_view": f"""
        WITH {GRAPH_SQL}, d AS (SELECT node_id, count(*) AS degree FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1),
        s AS (SELECT node_id, row_number() OVER (ORDER BY CASE WHEN kind = 'Region' THEN 0 ELSE 1 END, coalesce(degree, 0) DESC, node_id) AS nth FROM nodes LEFT JOIN d USING (node_id) QUALIFY nth <= 60),
        e AS (SELECT edge_id, row_number() OVER (ORDER BY greatest(a.nth, b.nth), edge_id) AS place FROM edges JOIN s a ON src = a.node_id JOIN s b ON dst = b.node_id QUALIFY place <= 80)
        SELECT 'node' AS item, node_id AS id, nth, (SELECT count(*) FROM nodes) - (SELECT count(*) FROM s) AS omitted FROM s UNION ALL SELECT 'edge', edge_id, place, (SELECT count(*) FROM edges) - (SELECT count(*) FROM e) FROM e""",
    "nation_summaries": f"""
        WITH {GRAPH_SQL}, m AS (
            SELECT 'nation:' || n_nationkey AS node_id, n_nationkey AS community, 'Nation' AS kind FROM nation UNION ALL SELECT 'customer:' || c_custkey, c_nationkey, 'Customer' FROM customer
            UNION ALL SELECT 'supplier:' || s_suppkey, s_nationkey, 'Supplier' FROM supplier UNION ALL SELECT 'order:' || o_orderkey, c_nationkey, 'Order' FROM orders JOIN customer ON o_custkey = c_custkey),
        k AS (SELECT community, kind, count(*) AS n FROM m GROUP BY 1, 2), z AS (SELECT community, sum(n)::BIGINT AS n_members, string_agg(kind || '=' || n, ',' ORDER BY kind) AS kinds FROM k GROUP BY 1),
        p AS (SELECT a.community AS f, b.community AS t FROM edges LEFT JOIN m a ON src = a.node_id LEFT JOIN m b ON dst = b.node_id)
        SELECT community, n_members, kinds, (SELECT count(*) FROM p WHERE f = community AND t = community) AS n_internal, (SELECT count(*) FROM p WHERE f = community AND t IS DISTINCT FROM community) AS n_outbound,
               (SELECT count(*) FROM p WHERE t = community AND f IS DISTINCT FROM community) AS n_inbound FROM z""",
    "recall_estimate": """
        WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality = 1 AND toxic = 0) AS t FROM labels JOIN documents USING (doc_id) GROUP BY 1), z AS (SELECT source, count(*) AS size FROM documents GROUP BY 1)
        SELECT sum(n)::BIGINT AS n_sampled, round(sum(size * p / n), 6) AS positives, round(sum(size * t / n) / sum(size * p / n), 9) AS recall FROM s JOIN z USING (source)""",
}
