"""Extraction from pages, communities and bounded descents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import extract, text
from lodegraph.operators import communities, graph
from lodegraph.sources import star
from lodegraph.sources.artifacts import record_digest
from lodegraph.sources.star import GRAPH_SQL, table


def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, titles and script calls of pages, counted per page."""
    found = extract.facts(table(spark, sf_dir, "pages"), "page_id", "html", ("link", "title", "script_call"))
    return found.groupBy("page_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_distinct"))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link targets with the pages and hosts that point to them."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html", text.url_host(F.col("url")).alias("host"))
    found = pages.select("page_id", "host", F.explode(extract.extracted(F.col("html"), "link")).alias("target"))
    return found.groupBy("target").agg(F.countDistinct("page_id").alias("n_pages"), F.countDistinct("host").alias("n_hosts"))


def host_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of hosts that link to the same targets."""
    pages = table(spark, sf_dir, "pages").select("html", text.url_host(F.col("url")).alias("src"))
    links = pages.select("src", F.explode(F.array_distinct(extract.extracted(F.col("html"), "link"))).alias("dst"))
    return communities.label_propagation(links).where("node NOT LIKE '/%'").select(F.col("node").alias("host"), "label")


def overview_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every region, at most five children of a kind under each parent, three levels deep."""
    edges = star.edges(spark, sf_dir, ("contains", "member_of"))
    roots = star.nodes(spark, sf_dir).where("kind = 'Region'").select("node_id")
    return communities.bounded_descent(graph.structural_pairs(edges), star.nodes(spark, sf_dir), roots, 5, 3)


def region_closeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = star.edges(spark, sf_dir, ("contains", "member_of"))
    roots = star.nodes(spark, sf_dir).where("kind IN ('Region', 'Nation')").select("node_id")
    return communities.closeness(edges, roots, 3)


def node_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by the digest of their canonical JSON: how many records each content has."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_name", "p_size", "p_type")
    return record_digest(parts).groupBy("record_digest").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (page_facts, page_links, host_communities, overview_descent, region_closeness, node_digests)}

_LINKS = """SELECT page_id, url, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\\s[^>]*?href="([^"]*)"', 1)) AS target FROM pages"""
_PAIRS = """pairs AS (SELECT DISTINCT CASE parent_end WHEN 'from' THEN src ELSE dst END AS parent, CASE parent_end WHEN 'from' THEN dst ELSE src END AS child FROM edges WHERE role = 'structural')"""


def _level(front: str, depth: int) -> str:
    return f"""(SELECT root, child AS node, kind, {depth} AS depth, CASE WHEN rank = 1 THEN greatest(total - 5, 0) ELSE 0 END AS withheld FROM (
        SELECT f.root, child, n.kind, row_number() OVER (PARTITION BY f.root, parent, n.kind ORDER BY child) AS rank, count(*) OVER (PARTITION BY f.root, parent, n.kind) AS total
        FROM {front} f JOIN pairs ON f.node = parent JOIN nodes n ON child = n.node_id) WHERE rank <= 5)"""


ORACLE_SQL = {
    "page_facts": r"""WITH f AS (
            SELECT page_id, 'link' AS kind, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<a\s[^>]*?href="([^"]*)"', 1)) AS value FROM pages
            UNION ALL SELECT page_id, 'title', unnest(regexp_extract_all(coalesce(html, ''), '(?is)<title[^>]*>(.*?)</title>', 1)) FROM pages
            UNION ALL SELECT page_id, 'script_call', unnest(regexp_extract_all(coalesce(html, ''), '\b([A-Za-z_]\w*)\([^()]*\);', 1)) FROM pages)
        SELECT page_id, kind, count(*) AS n, count(DISTINCT value) AS n_distinct FROM f GROUP BY page_id, kind""",
    "page_links": f"SELECT target, count(DISTINCT page_id) AS n_pages, count(DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS n_hosts FROM ({_LINKS}) GROUP BY target",
    "overview_descent": f"""WITH {GRAPH_SQL}, {_PAIRS}, l0 AS (SELECT node_id AS root, node_id AS node FROM nodes WHERE kind = 'Region'), l1 AS {_level('l0', 1)}, l2 AS {_level('l1', 2)}, l3 AS {_level('l2', 3)}
        SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3""",
    "region_closeness": f"""WITH RECURSIVE {GRAPH_SQL}, step AS (SELECT src AS a, dst AS b FROM edges WHERE role = 'structural' UNION SELECT dst, src FROM edges WHERE role = 'structural'), walk AS (
            SELECT node_id AS source, node_id AS node, 0 AS depth FROM nodes WHERE kind IN ('Region', 'Nation') UNION SELECT source, b, depth + 1 FROM walk JOIN step ON node = a WHERE depth < 3),
            hops AS (SELECT source, node, min(depth) AS depth FROM walk GROUP BY ALL)
        SELECT source, count(*) AS reached, round(sum(1 / depth), 6) AS harmonic FROM hops WHERE depth > 0 GROUP BY source""",
    "node_digests": """SELECT sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || ',"p_type":"' || p_type || '"}') AS record_digest, count(*) AS n FROM part GROUP BY 1""",
}
