"""Joins, differences, samples and text functions over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.functions import text
from lodegraph.operators import joins, ranking, sets
from lodegraph.sources.star import table


def multiplicity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers refer to suppliers of their nation in the same thousand of balance."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("/", "c_nationkey", F.floor(F.col("c_acctbal") / 1000).cast("int")).alias("key"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws("/", "s_nationkey", F.floor(F.col("s_acctbal") / 1000).cast("int")).alias("supplier_key"))
    found = joins.resolve(customers, suppliers, "c_custkey", "key", "s_suppkey", "supplier_key")
    return found.select("c_custkey", "status", "target", "n_candidates", F.array_join("candidates", ",").alias("candidates"))


def tail_match_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page paths resolved to the longest tail among paths without their first segment."""
    paths = table(spark, sf_dir, "pages").select("page_id", text.url_path(F.col("url")).alias("path"))
    targets = paths.select(F.regexp_replace("path", "^/[^/]*/", "").alias("target_path")).distinct().withColumn("target", F.col("target_path"))
    return joins.longest_tail(paths, targets, "page_id", "path", "target", "target_path")


def wildcard_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types and names against the first words in use, as wildcard prefixes."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    prefixes = parts.select(F.substring_index("p_name", " ", 1).alias("prefix")).distinct()
    return joins.prefix_matches(parts, prefixes, "p_name", "prefix").groupBy("prefix").agg(F.count(F.lit(1)).alias("n_parts"), F.countDistinct("p_name").alias("n_names"))


def route_template_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page paths matched to route templates; numbers become a parameter, so that matching is an equi-join."""
    def template(path):
        return F.regexp_replace(path, "[0-9]+", "{n}")

    pages = table(spark, sf_dir, "pages").select("page_id", text.url_host(F.col("url")).alias("host"), template(text.url_path(F.col("url"))).alias("template"))
    routes = pages.groupBy("template").agg(F.countDistinct("host").alias("n_hosts"))
    return pages.join(routes, "template").select("page_id", "template", "n_hosts")


def url_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.url_host(url).alias("host"), text.url_path(url).alias("path"), text.safe_url(url).alias("safe"))


def provenance_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by provenance class and scope of their path."""
    path = text.url_path(F.col("url"))
    rows = table(spark, sf_dir, "pages").select(text.segment_class(path, text.PROVENANCE, "production").alias("provenance"), text.segment_class(path, text.SCOPES, "first_party").alias("scope"))
    return rows.groupBy("provenance", "scope").agg(F.count(F.lit(1)).alias("n"))


def interval_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user (an hour from each purchase) against the user's errors' half-hours, in minutes."""
    events = table(spark, sf_dir, "events").withColumn("minute", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000))
    bought = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("minute").alias("a0"), (F.col("minute") + 60).alias("a1"))
    failed = events.where("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("minute").alias("b0"), (F.col("minute") + 30).alias("b1"))
    return joins.overlapping(bought, failed, ["user_id"], ("a0", "a1"), ("b0", "b1"), 128).select("user_id", "purchase_id", "error_id")


def line_in_section_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations within the turn that holds them, when turns are laid end to end."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n_lines"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    spans = turns.withColumn("line_end", F.sum("n_lines").over(order)).withColumn("line", F.col("line_end") - F.col("n_lines") + 1)
    lines = spans.groupBy("conv_id").agg(F.max("line_end").alias("last")).select("conv_id", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("at"), F.col("at").alias("at_end"))
    return joins.overlapping(lines, spans.select("conv_id", "turn", "line", "line_end"), ["conv_id"], ("at", "at_end"), ("line", "line_end"), 64).select("conv_id", "at", "turn")


def dedupe_fact_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document of each text, in (lang, doc_id) order."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    return joins.first_by(docs, ["key"], ["lang", "doc_id"]).select("key", "lang", "doc_id")


def duplicate_declaration_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text no other document has; all members of a repeated text are skipped."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    once = docs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    return once.select("doc_id", "key")


def _moved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two inventories of the documents: French ones move, German ones change, Spanish ones go, pages come."""
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    parent = docs.select("path", F.sha2("text", 256).alias("digest"))
    path = F.when(F.col("lang") == "fr", F.concat(F.lit("moved/"), F.col("path"))).otherwise(F.col("path"))
    content = F.when(F.col("lang") == "de", F.lower("text")).otherwise(F.col("text"))
    current = docs.where("lang <> 'es'").select(path.alias("path"), F.sha2(content, 256).alias("digest"))
    return parent, current.union(table(spark, sf_dir, "pages").select(F.concat(F.lit("pages/"), F.col("page_id").cast("string")), F.sha2(F.coalesce("html", F.lit("")), 256)))


def inventory_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.inventory_diff(*_moved(spark, sf_dir))


def rename_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.inventory_diff(*_moved(spark, sf_dir)).where("renamed_from IS NOT NULL").select("path", "renamed_from")


def graph_diff_added_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer-part edges of open orders against those of finished ones, by status of change and segment."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    edges = lines.join(orders, "o_orderkey").select(F.concat_ws("-", "o_custkey", "l_partkey").alias("path"), "o_orderstatus").distinct()
    states = sets.inventory_diff(edges.where("o_orderstatus = 'F'").select("path", F.lit("e").alias("digest")), edges.where("o_orderstatus = 'O'").select("path", F.lit("e").alias("digest")))
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def record_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part prices as recorded against those that the lines imply, rounded to hundreds."""
    expected = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_retailprice") / 100).cast("long").alias("digest"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.floor(F.min(F.col("l_extendedprice") / F.col("l_quantity")) / 100).cast("long").alias("digest"))
    return sets.record_diff(expected, lines)


def multiset_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' part multisets of the two return flags."""
    lines = table(spark, sf_dir, "lineitem")
    left, right = (lines.where(F.col("l_returnflag") == f).select("l_suppkey", "l_linenumber") for f in ("A", "R"))
    return sets.multiset_difference(left, right, ["l_suppkey", "l_linenumber"])


def unit_totality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that don't have exactly one label."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return sets.totality(docs.select(F.col("doc_id").alias("id")), labels.select(F.col("doc_id").alias("id")))


def stratified_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.stratified_sample(table(spark, sf_dir, "labels"), ["quality", "toxic"], "doc_id", 10, "s1").select("quality", "toxic", "doc_id", "rank")


def round_robin_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.round_robin(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 50, "s2").select("doc_id", "lang", "rank")


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.keyset_page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 1000, 100)


def nearest_rank_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.distribution(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


def length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.distribution(table(spark, sf_dir, "documents").withColumn("chars", F.length("text")), ["lang"], "chars").withColumnsRenamed({"n": "n_docs"})


def name_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slug, folded surface and tokens of part names with their brand."""
    name = F.concat_ws(" ", "p_brand", "p_name", "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", text.slug(name).alias("slug"), text.surface_fold(name).alias("fold"), F.array_join(text.tokens(name), ",").alias("tokens"))


def json_props_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"))


def json_bad_to_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties, and event names, that aren't JSON become markers."""
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(F.array("props", "event_type")).alias("cell"))
    return rows.select("event_id", "cell", text.json_or_marker(F.col("cell")).alias("json")).select("event_id", "cell", (F.get_json_object("json", "$.unparsed") == "true").alias("bad")).select("event_id", "cell", F.coalesce("bad", F.lit(False)).alias("bad"))


QUERIES = {
    f.__name__: f
    for f in (
        multiplicity_join, tail_match_join, wildcard_prefix_join, route_template_join, url_normalise, provenance_class_counts, interval_overlap_join, line_in_section_join,
        dedupe_fact_key, duplicate_declaration_skip, inventory_diff, rename_candidates, graph_diff_added_removed, record_diff, multiset_equal, unit_totality,
        stratified_hash_sample, round_robin_sample, keyset_page, nearest_rank_p95, length_distribution, name_folds, json_props_extract, json_bad_to_marker,
    )
}

_PATH = "CASE WHEN length(bare) > 1 THEN regexp_replace(bare, '/+$', '') ELSE '/' END"
_PATHS = f"SELECT page_id, url, {_PATH} AS path FROM (SELECT *, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') AS bare FROM pages)"
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_MOVED = """
    docs AS (SELECT source || '/' || doc_id AS path, lang, coalesce(text, '') AS text FROM documents),
    parent AS (SELECT path, sha256(text) AS old FROM docs),
    cur AS (
        SELECT CASE WHEN lang = 'fr' THEN 'moved/' || path ELSE path END AS path, sha256(CASE WHEN lang = 'de' THEN lower(text) ELSE text END) AS new FROM docs WHERE lang <> 'es'
        UNION ALL SELECT 'pages/' || page_id, sha256(coalesce(html, '')) FROM pages
    ), joined AS (
        SELECT path, old, new, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'deleted' WHEN old = new THEN 'unchanged' ELSE 'modified' END AS state
        FROM parent FULL JOIN cur USING (path)
    ), renames AS (
        SELECT coalesce(new, old) AS digest, min(path) FILTER (WHERE state = 'deleted') AS renamed_from FROM joined GROUP BY 1
        HAVING count(*) FILTER (WHERE state = 'added') = 1 AND count(*) FILTER (WHERE state = 'deleted') = 1
    ), diff AS (SELECT path, state, renamed_from FROM joined LEFT JOIN renames ON state = 'added' AND new = digest)"""
_SEGMENT = "list_has_any(string_split(lower(path), '/'), {})"


def _quantiles(table_: str, by: str, value: str, n: str = "n") -> str:
    return f"""SELECT {by}, count(*) AS {n}, min({value}) AS least, (min({value}) FILTER (WHERE rank = (total + 1) // 2) + min({value}) FILTER (WHERE rank = (total + 2) // 2)) / 2 AS median,
            min({value}) FILTER (WHERE rank = ceil(total * 0.95)) AS p95, max({value}) AS greatest
        FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS rank, count(*) OVER (PARTITION BY {by}) AS total FROM {table_}) GROUP BY {by}"""


ORACLE_SQL = {
    "multiplicity_join": """WITH c AS (SELECT c_custkey, c_nationkey || '/' || cast(floor(c_acctbal / 1000) AS int) AS key FROM customer),
            s AS (SELECT s_nationkey || '/' || cast(floor(s_acctbal / 1000) AS int) AS key, count(*) AS n, list(s_suppkey ORDER BY s_suppkey) AS ids FROM supplier GROUP BY 1)
        SELECT c_custkey, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN ids[1] END AS target,
               coalesce(n, 0) AS n_candidates, CASE WHEN n > 1 THEN array_to_string(ids[1:25], ',') END AS candidates FROM c LEFT JOIN s USING (key)""",
    "tail_match_join": f"""WITH p AS ({_PATHS}), t AS (SELECT DISTINCT regexp_replace(path, '^/[^/]*/', '') AS target FROM p)
        SELECT page_id, target, target AS tail FROM (SELECT page_id, target, row_number() OVER (PARTITION BY page_id ORDER BY length(target) DESC) AS nth FROM p JOIN t ON path = target OR ends_with(path, '/' || target)) WHERE nth = 1""",
    "wildcard_prefix_join": """WITH x AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS prefix FROM part)
        SELECT prefix, count(*) AS n_parts, count(DISTINCT p_name) AS n_names FROM part JOIN x ON starts_with(p_name, prefix) GROUP BY prefix""",
    "route_template_join": f"""WITH p AS (SELECT page_id, {_HOST} AS host, regexp_replace(path, '[0-9]+', '{{n}}', 'g') AS template FROM ({_PATHS}))
        SELECT page_id, template, (SELECT count(DISTINCT host) FROM p q WHERE q.template = p.template) AS n_hosts FROM p""",
    "url_normalise": f"SELECT page_id, {_HOST} AS host, path, regexp_full_match(url, 'https?://[^/?#@]+(/[^?#]*)?') AS safe FROM ({_PATHS})",
    "provenance_class_counts": f"""SELECT CASE WHEN {_SEGMENT.format("['fixture', 'fixtures', 'mock', 'mocks']")} THEN 'fixture' WHEN {_SEGMENT.format("['spec', 'test', 'tests']")} THEN 'test'
            WHEN {_SEGMENT.format("['doc', 'docs', 'documentation']")} THEN 'docs' ELSE 'production' END AS provenance,
            CASE WHEN {_SEGMENT.format("['node_modules', 'third_party', 'vendor']")} THEN 'vendored' WHEN {_SEGMENT.format("['build', 'dist', 'target']")} THEN 'build_artifact' ELSE 'first_party' END AS scope, count(*) AS n
        FROM ({_PATHS}) GROUP BY ALL""",
    "interval_overlap_join": """WITH e AS (SELECT event_id, user_id, event_type, floor(epoch_us(ts) / 60000000) AS m FROM events)
        SELECT p.user_id, p.event_id AS purchase_id, f.event_id AS error_id FROM e p JOIN e f ON p.user_id = f.user_id AND p.m <= f.m + 30 AND f.m <= p.m + 60
        WHERE p.event_type = 'purchase' AND f.event_type = 'error'""",
    "line_in_section_join": """WITH t AS (SELECT conv_id, turn, len(string_split(coalesce(text, ''), chr(10))) AS n FROM conversations),
            s AS (SELECT conv_id, turn, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS line_end, n FROM t)
        SELECT conv_id, cast(unnest(range(line_end - n + 1, line_end + 1)) AS BIGINT) AS at, turn FROM (SELECT conv_id, turn, cast(line_end AS BIGINT) AS line_end, n FROM s)""",
    "dedupe_fact_key": "SELECT key, lang, doc_id FROM (SELECT sha256(coalesce(text, '')) AS key, lang, doc_id, row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY lang, doc_id) AS nth FROM documents) WHERE nth = 1",
    "duplicate_declaration_skip": "SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS key FROM documents GROUP BY 2 HAVING count(*) = 1",
    "inventory_diff": f"WITH {_MOVED} SELECT * FROM diff",
    "rename_candidates": f"WITH {_MOVED} SELECT path, renamed_from FROM diff WHERE renamed_from IS NOT NULL",
    "graph_diff_added_removed": """WITH e AS (SELECT DISTINCT o_custkey, l_partkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus IN ('F', 'O')),
            s AS (SELECT o_custkey, l_partkey, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'O') AS o FROM e GROUP BY ALL)
        SELECT CASE WHEN f AND o THEN 'unchanged' WHEN f THEN 'deleted' ELSE 'added' END AS state, count(*) AS n FROM s GROUP BY 1""",
    "record_diff": """WITH l AS (SELECT l_partkey AS id, cast(floor(min(l_extendedprice / l_quantity) / 100) AS BIGINT) AS have FROM lineitem GROUP BY 1), p AS (SELECT p_partkey AS id, cast(floor(p_retailprice / 100) AS BIGINT) AS want FROM part)
        SELECT id, CASE WHEN have IS NULL THEN 'missing' WHEN want IS NULL THEN 'extra' ELSE 'stale' END AS state FROM p FULL JOIN l USING (id) WHERE want IS DISTINCT FROM have""",
    "multiset_equal": """SELECT l_suppkey, l_linenumber, count(*) FILTER (WHERE l_returnflag = 'A') AS n_left, count(*) FILTER (WHERE l_returnflag = 'R') AS n_right FROM lineitem GROUP BY 1, 2
        HAVING count(*) FILTER (WHERE l_returnflag = 'A') <> count(*) FILTER (WHERE l_returnflag = 'R')""",
    "unit_totality": """SELECT id, coalesce(n, 0) AS n_receipts, e IS NOT NULL AS expected FROM (SELECT doc_id AS id, true AS e FROM documents) FULL JOIN (SELECT doc_id AS id, count(*) AS n FROM labels GROUP BY 1) USING (id)
        WHERE coalesce(n, 0) <> 1 OR e IS NULL""",
    "stratified_hash_sample": "SELECT quality, toxic, doc_id, rank FROM (SELECT *, cast(row_number() OVER (PARTITION BY quality, toxic ORDER BY sha256('s1:' || doc_id), doc_id) AS int) AS rank FROM labels) WHERE rank <= 10",
    "round_robin_sample": "SELECT doc_id, lang, rank FROM (SELECT *, cast(row_number() OVER (PARTITION BY lang ORDER BY sha256('s2:' || doc_id), doc_id) AS int) AS rank FROM documents) ORDER BY rank, lang, doc_id LIMIT 50",
    "keyset_page": "SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderkey > 1000) > 100 AS truncated FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 100",
    "nearest_rank_p95": _quantiles("lineitem", "l_returnflag, l_linestatus", "l_quantity"),
    "length_distribution": _quantiles("(SELECT lang, length(text) AS len FROM documents WHERE text IS NOT NULL)", "lang", "len", "n_docs"),
    "name_folds": r"""WITH n AS (SELECT p_partkey, p_brand || ' ' || p_name || ' ' || p_type AS name FROM part), s AS (SELECT *, lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1 \2', 'g')) AS low FROM n)
        SELECT p_partkey, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_replace(low, '[\s_-]+', '', 'g') AS fold,
               (SELECT string_agg(w, ',' ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(regexp_split_to_array(low, '[^a-z0-9]+')) AS w, generate_subscripts(regexp_split_to_array(low, '[^a-z0-9]+'), 1) AS i)
                   WHERE length(w) > 2 AND w NOT IN ('and', 'app', 'common', 'core', 'data', 'for', 'lib', 'main', 'service', 'src', 'the', 'with') GROUP BY w)) AS tokens FROM s""",
    "json_props_extract": "SELECT event_type, count(props->>'$.k') AS n, cast(sum(cast(props->>'$.k' AS BIGINT)) AS BIGINT) AS sum_k, max(cast(props->>'$.k' AS BIGINT)) AS max_k FROM events GROUP BY event_type",
    "json_bad_to_marker": "SELECT event_id, cell, NOT json_valid(cell) AS bad FROM (SELECT event_id, unnest([props, event_type]) AS cell FROM events)",
}
