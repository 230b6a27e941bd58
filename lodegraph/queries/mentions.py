"""Mentions and claims over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import text
from lodegraph.operators import documents, mentions
from lodegraph.queries.ledgers import _PATH, _SLUG
from lodegraph.sources import star
from lodegraph.sources.star import GRAPH_SQL, table

RULES = [
    {"component": "en", "prefix": "/en/1", "reason": "first pages"}, {"component": "de", "name_prefix": "2", "reason": "second pages"}, {"component": "fr", "name": "3", "reason": "third page"}, {"component": "en", "name_prefix": "4", "reason": "fourth pages"},
]


def document_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mentions.surfaces(table(spark, sf_dir, "documents"))
    return found.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n_surfaces"), F.sum("n").alias("n"))


def part_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as entities; types of parts are the kinds of signals."""
    found = mentions.clustered_signals(table(spark, sf_dir, "part"), text.slug(F.col("p_name")), "p_type", "p_partkey")
    return found.select("entity", "p_type", "n", "n_subjects", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"), "n_kinds")


def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the lines of an answer: clicks declare relations, views are evidence."""
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "click", "rel").when(F.col("event_type") == "view", "ev").otherwise(F.col("event_type"))
    lines = events.select("user_id", "event_id", kind.alias("kind"), F.when(F.col("event_id") % 11 != 0, F.floor("value").cast("long") % 7).alias("i"))
    return mentions.relation_lines(lines, "user_id", "event_id", "kind", "i").groupBy("user_id", "disposition").agg(F.count(F.lit(1)).alias("n"))


def order_propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as claims about their part, counted by proposition."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    modality = F.when(F.col("l_linenumber") == 1, "MUST").when(F.col("l_linenumber") == 2, "may").when(F.col("l_linenumber") == 3, "often")
    until = F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))
    made = mentions.proposition(F.when(F.col("l_suppkey") % 5 == 0, "  ").otherwise(F.col("p_brand")), modality, F.col("l_linestatus"), F.lit(None).cast("timestamp"), until, F.concat_ws(" ", "p_name", "p_type", "p_name"))
    return lines.select(made.alias("p")).groupBy("p.neighbourhood", "p.modality_class", "p.scope_band", "p.validity_band", "p.object_key").agg(F.count(F.lit(1)).alias("n"))


def source_standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by their labels: good ones are code, toxic ones comments, others documents."""
    kind = F.when(F.col("quality") == 1, "code").when(F.col("toxic") == 1, "comment").otherwise("document")
    return mentions.standings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", kind.alias("kind")), "doc_id", "kind")


def excluded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = text.url_path(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", mentions.exclusion_reason(F.get(F.split(path, "/"), F.lit(1)), path, RULES).alias("reason"))


def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents read as ignore files."""
    lines = documents.numbered_lines(table(spark, sf_dir, "documents")).select("doc_id", mentions.ignore_rule(F.col("content")).alias("rule"))
    return lines.groupBy("doc_id").agg(F.count("rule").alias("n_rules"), F.min(F.sha2("rule", 256)).alias("least_sha256"))


def region_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that a region's name stands for, the region being known by its nations' names as well."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    aliases = nations.select(F.col("r_name").alias("alias"), star.node_id("Region", "r_regionkey").alias("node_id")).union(nations.select("r_name", star.node_id("Nation", "n_nationkey")))
    return mentions.subject(star.nodes(spark, sf_dir), star.edges(spark, sf_dir, ("contains",)), aliases, " asia ")


QUERIES = {f.__name__: f for f in (document_surfaces, part_signals, answer_lines, order_propositions, source_standings, excluded_pages, ignore_rules, region_subject)}

_SURFACES = " UNION ALL ".join(f"SELECT doc_id, '{kind}' AS kind, unnest(regexp_extract_all(coalesce(text, ''), '{shape}', 1)) AS surface FROM documents" for kind, shape in sorted(mentions.SURFACES.items()))
_SEGMENT = f"split_part({_PATH}, '/', 2)"
_NAME = f"regexp_extract({_PATH}, '([^/]*)$', 1)"

ORACLE_SQL = {
    "document_surfaces": f"SELECT doc_id, kind, count(DISTINCT surface) AS n_surfaces, count(*) AS n FROM ({_SURFACES}) GROUP BY 1, 2",
    "part_signals": f"""
        WITH s AS (SELECT {_SLUG.format("p_name")} AS entity, p_type, p_partkey FROM part), c AS (SELECT entity, p_type, count(*) AS n, count(DISTINCT p_partkey) AS n_subjects, array_to_string(list_sort(list(DISTINCT p_partkey))[1:8], ',') AS examples FROM s WHERE entity <> '' GROUP BY 1, 2)
        SELECT *, count(*) OVER (PARTITION BY entity) AS n_kinds FROM c""",
    "answer_lines": """
        WITH l AS (SELECT user_id, event_id, CASE event_type WHEN 'click' THEN 'rel' WHEN 'view' THEN 'ev' ELSE event_type END AS kind, CASE WHEN event_id % 11 <> 0 THEN floor(value)::BIGINT % 7 END AS i FROM events),
        d AS (SELECT *, coalesce(bool_or(kind = 'rel') OVER (PARTITION BY user_id, i ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS known FROM l)
        SELECT user_id, CASE WHEN i IS NULL THEN 'unindexed' WHEN kind = 'rel' AND known THEN 'duplicate' WHEN kind = 'rel' THEN 'relation' WHEN kind = 'ev' AND known THEN 'evidence' WHEN kind = 'ev' THEN 'orphan' ELSE 'unknown' END AS disposition, count(*) AS n FROM d GROUP BY 1, 2""",
    "order_propositions": """
        SELECT CASE WHEN l_suppkey % 5 = 0 THEN 'unassigned' ELSE lower(p_brand) END AS neighbourhood, CASE l_linenumber WHEN 1 THEN 'binding' WHEN 2 THEN 'advisory' ELSE 'stated' END AS modality_class, l_linestatus AS scope_band,
               CASE WHEN l_returnflag = 'R' THEN 'bounded' ELSE 'unbounded' END AS validity_band,
               array_to_string(list_sort(list_distinct(list_filter(string_split_regex(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda w: w <> ''))), ' ') AS object_key, count(*) AS n
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "source_standings": """
        WITH s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (quality = 1) AS code FROM labels GROUP BY 1)
        SELECT d.doc_id, CASE WHEN s.n IS NULL THEN 'held' ELSE 'proposed' END AS status, CASE WHEN s.code = 0 THEN 'claim' WHEN s.code = s.n THEN 'observed code' END AS evidence_class, coalesce(s.n, 0) AS n_rows FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN s USING (doc_id)""",
    "excluded_pages": f"""
        SELECT page_id, CASE WHEN {_SEGMENT} = 'en' AND starts_with({_PATH}, '/en/1') THEN 'first pages' WHEN {_SEGMENT} = 'de' AND starts_with({_NAME}, '2') THEN 'second pages' WHEN {_SEGMENT} = 'fr' AND {_NAME} = '3' THEN 'third page'
            WHEN {_SEGMENT} = 'en' AND starts_with({_NAME}, '4') THEN 'fourth pages' END AS reason FROM pages""",
    "ignore_rules": """
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS c FROM documents), b AS (SELECT doc_id, regexp_replace(regexp_replace(trim(c, ' '), '^(\\./)+', ''), '/+$', '') AS r FROM l),
        k AS (SELECT doc_id, CASE WHEN r <> '' AND NOT regexp_matches(r, '^[#/]') AND NOT regexp_matches(r, '^[A-Za-z]:') AND NOT regexp_matches(r, '(^|/)\\.\\.(/|$)') THEN r END AS rule FROM b)
        SELECT doc_id, count(rule) AS n_rules, min(sha256(rule)) AS least_sha256 FROM k GROUP BY 1""",
    "region_subject": f"""
        WITH {GRAPH_SQL}, own AS (SELECT 'region:' || r_regionkey AS node_id FROM region WHERE lower(r_name) = 'asia' AND r_regionkey IN (SELECT n_regionkey FROM nation) UNION SELECT 'nation:' || n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) = 'asia'),
        t AS (SELECT edge_id, src, dst FROM edges WHERE relation = 'contains' AND (src IN (FROM own) OR dst IN (FROM own)))
        SELECT 'node' AS item, node_id AS id FROM own UNION ALL SELECT 'edge', edge_id FROM t UNION ALL SELECT 'neighbour', id FROM (SELECT src AS id FROM t UNION SELECT dst FROM t) WHERE id NOT IN (FROM own)""",
}
