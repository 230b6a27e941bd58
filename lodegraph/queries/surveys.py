"""Markdown, resolution joins, censuses, scores and name functions over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import names, text
from lodegraph.operators import censuses, documents, markdown, resolution
from lodegraph.runtime import dealt
from lodegraph.sources import star
from lodegraph.sources.star import GRAPH_SQL, table


def _marked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as Markdown: lines of one to three words become headings of that level."""
    lines = documents.numbered_lines(table(spark, sf_dir, "documents"))
    n = F.size(F.split(F.trim("content"), " +"))
    return lines.withColumn("content", F.when((F.trim("content") != "") & (n <= 3) & ~F.col("content").rlike(r"^\s*(```|~~~|#)"), F.concat(F.repeat(F.lit("#"), n), F.lit(" "), F.trim("content"))).otherwise(F.col("content")))


def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.headings(_marked_up(spark, sf_dir)).select("doc_id", "line", "level", F.sha2("path", 256).alias("path_sha256"))


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.blocks(_marked_up(spark, sf_dir))
    return found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("line_end") - F.col("line") + 1).alias("n_lines"), F.max("start").alias("last_start"))


def fact_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a digit, and the deepest section that each stands in."""
    lines = _marked_up(spark, sf_dir)
    level = F.when(F.col("content").rlike("^#{1,3} "), F.length(F.regexp_extract("content", "^(#+)", 1)))
    sections = documents.sections(lines, level, 3)
    facts = lines.where(F.col("content").rlike("[0-9]")).select("doc_id", F.col("line").alias("fact"), F.col("line").alias("at"))
    return resolution.deepest_container(facts, sections, "doc_id", "fact")


def client_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages call the routes of sites; a site's routes are its paths with numbers as parameters."""
    pages = table(spark, sf_dir, "pages").select("page_id", text.url_host(F.col("url")).alias("host"), text.url_path(F.col("url")).alias("path"))
    template = F.regexp_replace("path", "[0-9]+", ":id")
    routes = pages.where(~F.col("path").contains(".")).select(F.col("host").alias("repo"), "host", template.alias("template")).distinct()
    routes = routes.select(F.concat_ws(" ", "host", "template").alias("route_id"), "repo", F.lit("GET").alias("method"), "host", "template")
    clients = pages.where(~F.col("path").contains(".")).select(F.col("page_id").alias("client_id"), F.lit("crawler").alias("repo"), F.lit(None).cast("string").alias("method"), "host", "path", F.lit(False).alias("test"))
    return resolution.route_matches(clients, routes)


def dotted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts refer to type.brand.size; brands with an odd number are modules, types are packages."""
    brand = F.regexp_replace("p_brand", "[^A-Za-z0-9]", "")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", brand.alias("brand"), F.concat_ws(".", "p_type", brand, F.col("p_size").cast("string")).alias("name"))
    modules = parts.where(F.regexp_extract("brand", "([0-9]+)$", 1).cast("int") % 2 == 1).select(F.concat_ws(".", "p_type", "brand").alias("module"))
    modules = modules.union(parts.select("p_type")).distinct()
    return resolution.longest_head(parts, modules, "p_partkey", "name", "module", "module")


def scoped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers look for a supplier of their balance band in their own nation and in nation 0."""
    band = lambda c: F.floor(F.col(c) / 1000).cast("string")
    refs = table(spark, sf_dir, "customer").select("c_custkey", band("c_acctbal").alias("key"), F.array("c_nationkey", F.lit(0)).alias("scopes"))
    targets = table(spark, sf_dir, "supplier").select("s_suppkey", band("s_acctbal").alias("key"), "s_nationkey")
    return resolution.in_scope(refs, targets, "c_custkey", "key", "scopes", "s_suppkey", "key", "s_nationkey")


def exact_or_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' region/nation/segment paths read keys: some segments are declared exactly, every nation/segment pair as a tail."""
    place = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    refs = table(spark, sf_dir, "customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name", F.concat_ws("/", "r_name", "n_name", "c_mktsegment").alias("path"))
    targets = refs.where("c_mktsegment = 'BUILDING'").select("path").union(refs.select(F.concat_ws("/", "n_name", "c_mktsegment"))).union(refs.select("c_mktsegment")).distinct()
    return resolution.exact_then_tail(refs, targets.select("path", F.col("path").alias("key")), "c_custkey", "path", "key", "path")


def name_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names against type names and each other's words."""
    parts = table(spark, sf_dir, "part").select("p_name").distinct()
    return resolution.token_overlap(parts, parts.select(F.col("p_name").alias("other")), "p_name", "other", "p_name", "other").where("p_name < other")


def refusal_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by the tens of their code, with five of their users."""
    code = F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("int")
    found = censuses.with_examples(table(spark, sf_dir, "events").where("event_type = 'error'").select(code.alias("reason"), "user_id"), ["reason"], "user_id")
    return found.withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


def inventory_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return censuses.top_and_rest(table(spark, sf_dir, "documents").withColumn("size", F.octet_length(F.coalesce("text", F.lit("")))), "source", F.col("size"))


def spending_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priced lines by flag and status; lines without tax report no cost of their own."""
    lines = table(spark, sf_dir, "lineitem")
    return censuses.spending(lines, ["l_returnflag", "l_linenumber"], F.col("l_quantity") * F.lit(2.0), F.when((F.col("l_tax") > 0) | (F.col("l_linenumber") > 6), F.col("l_quantity")))


def model_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return censuses.usage(table(spark, sf_dir, "events"), "event_type", F.when(F.col("value") >= 1, F.floor("value").cast("double")))


def exact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: returned parts as the expected answer, parts of finished lines as the given one."""
    lines = table(spark, sf_dir, "lineitem")
    side = lambda test: lines.where(test).select(F.col("l_orderkey").alias("question"), F.col("l_partkey").alias("item"))
    return censuses.scored(side("l_returnflag = 'R'"), side("l_linestatus = 'F'"), "question", "item")


def majority_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order priority that most of a customer's orders have."""
    return censuses.majority_parent(table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority")


def connectivity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = star.nodes(spark, sf_dir).where("kind IN ('Customer', 'Order', 'Supplier')")
    return censuses.connectivity(star.edges(spark, sf_dir, ("member_of",)), nodes.count())


def label_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    state = F.when(F.col("quality").isNull(), "unreached").when(F.col("quality") == 1, "covered").otherwise("refused")
    return censuses.coverage(table(spark, sf_dir, "documents").join(labels, "doc_id", "left"), ["lang", "source"], state)


def contract_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days by the set of event types that they have; the set is as large as the vocabulary at most."""
    sets = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts")).agg(F.array_join(F.array_sort(F.collect_set("event_type")), "+").alias("slice"), F.count(F.lit(1)).alias("k"))
    return sets.groupBy("slice").agg(F.count(F.lit(1)).alias("n_users"), F.sum("k").alias("n_events"))


def projection_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per relation as a projection and kind of node: nodes with and without an edge of it."""
    edges = star.edges(spark, sf_dir)
    ends = edges.select("relation", F.col("src").alias("node_id")).union(edges.select("relation", "dst")).distinct()
    touched = ends.join(star.nodes(spark, sf_dir).select("node_id", "kind"), "node_id").groupBy("relation", "kind").agg(F.count(F.lit(1)).alias("touched"))
    totals = star.nodes(spark, sf_dir).groupBy("kind").agg(F.count(F.lit(1)).alias("total"))
    return touched.join(totals, "kind").select("relation", "kind", "touched", (F.col("total") - F.col("touched")).alias("orphans"))


def unit_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned units by action, reason and source."""
    from lodegraph.queries.evidence import unit_plan_reuse

    plan = unit_plan_reuse(spark, sf_dir).join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return plan.groupBy("source", "action", "reason").agg(F.count(F.lit(1)).alias("n"))


def concept_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four lists of ten: customers by orders, by distinct parts, by distinct suppliers, and parts by orders."""
    tasks = star.tasks(spark, sf_dir)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey"), tasks, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    def top(name, rows, key, measure):
        return rows.groupBy(F.col(key).cast("long").alias("id")).agg(measure.alias("n")).orderBy(F.desc("n"), "id").limit(10).select(F.lit(name).alias("list"), "id", "n")

    def distinct(name, key, value):
        return top(name, dealt(lines.select(key, value), tasks, key, value).distinct(), key, F.count(value))

    return (
        top("orders", orders, "o_custkey", F.count(F.lit(1))).union(distinct("parts", "o_custkey", "l_partkey"))
        .union(distinct("suppliers", "o_custkey", "l_suppkey")).union(distinct("ordered", "l_partkey", "l_orderkey"))
    )


def blob_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", names.blob_hash(content).alias("blob"), names.token_estimate(content).alias("n_tokens"), names.claim_budget(F.octet_length(content), 4.0, 2, 40).alias("budget"), F.sha2(names.folded_answer(content), 256).alias("answer_sha256"))


def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.initcap("p_name"), F.lit("Items_v"), (F.col("p_size") % 3).cast("string"))
    path = F.concat(F.lit("./a//"), F.lower("p_type"), F.lit("/../"), F.col("p_brand"), F.lit("\\x/."))
    template = F.concat(F.lit("s3://${"), "p_type", F.lit("}/"), F.when(F.col("p_size") > 25, F.concat_ws("/", "p_brand", "p_type")).otherwise(F.lit("short")))
    return table(spark, sf_dir, "part").select("p_partkey", names.entity_name(made).alias("entity"), names.folded_path(path).alias("path"), names.template_tail(template).alias("tail"), names.tree_bound((F.col("p_size") % 5).cast("int"), F.lit(3)).alias("bound"))


QUERIES = {
    f.__name__: f
    for f in (
        heading_paths, markdown_blocks, fact_containers, client_routes, dotted_names, scoped_names, exact_or_tail, name_overlap, refusal_census, inventory_summary, spending_rollup, model_usage,
        exact_scores, majority_parents, connectivity_report, label_coverage, contract_slices, projection_diagnostics, unit_telemetry, concept_lists, blob_hashes, name_forms,
    )
}

_LINES = r"""
    raw AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, cast(generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS INT) AS line FROM documents),
    w AS (SELECT *, len(regexp_split_to_array(trim(content), ' +')) AS n FROM raw),
    lines AS (SELECT doc_id, line, CASE WHEN trim(content) <> '' AND n <= 3 AND NOT regexp_matches(content, '^\s*(```|~~~|#)') THEN repeat('#', n) || ' ' || trim(content) ELSE content END AS content FROM w),
    f AS (SELECT *, regexp_matches(content, '^ {0,3}(```|~~~)') AS fence FROM lines),
    g AS (SELECT *, sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER o AS k, fence OR sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER o % 2 = 1 AS fenced, lead(content) OVER o AS under,
        coalesce(sum(strlen(content) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY line)),
    t AS (SELECT *, NOT fenced AND regexp_matches(content, '^ {0,3}#{1,6}([ \t].*)?$') AS atx,
        trim(content) <> '' AND NOT regexp_matches(content, '^ {0,3}([#>|*+-]|[0-9]+[.)])') AND NOT fenced AND coalesce(regexp_matches(under, '^ {0,3}(=+|-+)[ \t]*$'), false) AS setext FROM g),
    m AS (SELECT *, CASE WHEN atx THEN len(regexp_extract(content, '^ {0,3}(#{1,6})', 1)) WHEN setext THEN CASE WHEN contains(under, '=') THEN 1 ELSE 2 END END AS level,
        CASE WHEN atx THEN regexp_extract(content, '^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$', 2) WHEN setext THEN trim(content) END AS title FROM t)"""
_LEVELS = range(1, 7)

ORACLE_SQL = {
    "heading_paths": f"""WITH {_LINES}, h AS (SELECT doc_id, line, level, title, {', '.join(f"max(CASE WHEN level = {k} THEN line END) OVER u AS l{k}, max(CASE WHEN level < {k} THEN line END) OVER u AS a{k}, arg_max(title, line) FILTER (WHERE level = {k}) OVER u AS t{k}" for k in _LEVELS)}
            FROM m WHERE level IS NOT NULL WINDOW u AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT doc_id, line, cast(level AS INT) AS level, sha256(concat_ws(' / ', {', '.join(f"CASE WHEN {k} <= level AND l{k} > coalesce(a{k}, 0) THEN t{k} END" for k in _LEVELS)})) AS path_sha256 FROM h""",
    "markdown_blocks": rf"""WITH {_LINES}, b AS (SELECT *, fence AND k % 2 = 1 AS opens, CASE WHEN fenced THEN 'fence' WHEN level IS NOT NULL THEN 'heading' WHEN trim(content) = '' THEN 'blank' WHEN regexp_matches(content, '^ {{0,3}}([*+-]|[0-9]+[.)])[ \t]') THEN 'list'
            WHEN regexp_matches(content, '^ {{0,3}}>') THEN 'quote' WHEN regexp_matches(content, '^ {{0,3}}\|.*\|[ \t]*$') THEN 'table' ELSE 'paragraph' END AS kind FROM m),
            p AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM b),
            n AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> kind OR kind = 'heading' OR opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) AS block FROM p),
            x AS (SELECT doc_id, block, min(kind) AS kind, min(line) AS a, max(line) AS z, min(start) AS start, sum(strlen(content) + 1) AS n_bytes FROM n GROUP BY doc_id, block)
        SELECT kind, count(*) AS n, cast(sum(n_bytes) AS BIGINT) AS n_bytes, cast(sum(z - a + 1) AS BIGINT) AS n_lines, cast(max(start) AS BIGINT) AS last_start FROM x GROUP BY kind""",
    "fact_containers": rf"""WITH {_LINES}, v AS (SELECT doc_id, line, content, CASE WHEN NOT regexp_matches(content, '^\s*(```|~~~)') AND sum(CASE WHEN regexp_matches(content, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line) % 2 = 0
                AND regexp_matches(content, '^#{{1,3}} ') THEN len(regexp_extract(content, '^(#+)', 1)) END AS level, max(line) OVER (PARTITION BY doc_id) AS last FROM lines),
            s AS (SELECT a.doc_id, a.line, a.level, coalesce(min(b.line) - 1, any_value(a.last)) AS line_end FROM v a LEFT JOIN v b ON a.doc_id = b.doc_id AND b.line > a.line AND b.level <= a.level WHERE a.level IS NOT NULL GROUP BY ALL),
            c AS (SELECT v.doc_id, v.line AS fact, max({{'l': s.level, 'a': s.line}}) AS b FROM v LEFT JOIN s ON v.doc_id = s.doc_id AND v.line BETWEEN s.line AND s.line_end WHERE regexp_matches(content, '[0-9]') AND s.line IS NOT NULL GROUP BY ALL)
        SELECT v.doc_id, v.line AS fact, cast(b.a AS INT) AS line, cast(b.l AS INT) AS level FROM v LEFT JOIN c ON v.doc_id = c.doc_id AND v.line = c.fact WHERE regexp_matches(content, '[0-9]')""",
    "client_routes": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '') AS bare FROM pages),
            q AS (SELECT page_id, host, CASE WHEN length(bare) > 1 THEN regexp_replace(bare, '/+$', '') ELSE '/' END AS path FROM p),
            r AS (SELECT DISTINCT host, regexp_replace(path, '[0-9]+', ':id', 'g') AS template, list_filter(string_split(regexp_replace(path, '[0-9]+', ':id', 'g'), '/'), lambda s: s <> '') AS parts FROM q WHERE NOT contains(path, '.')),
            c AS (SELECT *, list_filter(string_split(path, '/'), lambda s: s <> '') AS own FROM q)
        SELECT DISTINCT page_id AS client_id, c.host || ' ' || template AS route_id, 3 AS score FROM c JOIN r ON c.host = r.host AND len(own) = len(parts) WHERE len(list_filter(range(1, len(own) + 1), lambda i: parts[i] NOT LIKE ':%' AND parts[i] <> own[i])) = 0 AND NOT contains(path, '.')""",
    "dotted_names": r"""WITH p AS (SELECT p_partkey, p_type, regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') AS brand FROM part)
        SELECT p_partkey, CASE WHEN odd THEN p_type || '.' || brand ELSE p_type END AS target, CASE WHEN odd THEN 1 ELSE 2 END AS dropped FROM (SELECT *, cast(regexp_extract(brand, '([0-9]+)$', 1) AS INT) % 2 = 1 AS odd FROM p)""",
    "scoped_names": """WITH h AS (SELECT c_custkey, count(DISTINCT s_suppkey) AS n, min(s_suppkey) AS first FROM customer JOIN supplier ON floor(c_acctbal / 1000) = floor(s_acctbal / 1000) AND (s_nationkey = c_nationkey OR s_nationkey = 0) GROUP BY 1)
        SELECT c_custkey, CASE WHEN n IS NULL THEN 'external' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN first END AS target, coalesce(n, 0) AS n_candidates FROM customer LEFT JOIN h USING (c_custkey)""",
    "exact_or_tail": """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN r_name || '/' ELSE '' END || n_name || '/' || c_mktsegment AS target, CASE WHEN c_mktsegment = 'BUILDING' THEN 'exact' ELSE 'tail' END AS basis
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "name_overlap": f"""WITH t AS (SELECT DISTINCT p_name, unnest(string_split(lower(p_name), ' ')) AS word FROM part)
        SELECT a.p_name, b.p_name AS other, count(*) AS n_shared FROM t a JOIN t b USING (word) WHERE a.p_name < b.p_name AND length(word) > 2 AND word NOT IN {text.COMMON_WORDS} GROUP BY 1, 2""",
    "refusal_census": """WITH e AS (SELECT cast(floor(cast(json_extract_string(props, '$.k') AS INT) / 10) AS INT) AS reason, user_id FROM events WHERE event_type = 'error')
        SELECT reason, count(*) AS n, count(DISTINCT user_id) AS n_subjects, array_to_string(list_sort(list(DISTINCT user_id))[1:5], ',') AS examples FROM e GROUP BY reason""",
    "inventory_summary": """WITH s AS (SELECT source, count(*) AS n, sum(strlen(coalesce(text, ''))) AS bytes FROM documents GROUP BY source), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS k FROM s)
        SELECT CASE WHEN k <= 14 THEN source ELSE 'other' END AS source, cast(sum(n) AS BIGINT) AS n, cast(sum(bytes) AS BIGINT) AS bytes FROM r GROUP BY 1""",
    "spending_rollup": """WITH l AS (SELECT l_returnflag, l_linenumber, l_quantity, CASE WHEN l_tax > 0 OR l_linenumber > 6 THEN l_quantity END AS own FROM lineitem)
        SELECT l_returnflag, l_linenumber, count(*) AS n, round(sum(l_quantity * 2.0), 2) AS estimated, round(coalesce(sum(own), 0.0), 2) AS known, CASE WHEN count(own) = count(*) THEN round(sum(own), 2) END AS actual FROM l GROUP BY 1, 2""",
    "model_usage": """WITH t AS (SELECT event_type, count(*) AS calls, sum(CASE WHEN value >= 1 THEN floor(value) END) AS cost, count(*) FILTER (WHERE value < 1 OR value IS NULL) AS unpriced FROM events GROUP BY 1)
        SELECT event_type, calls, round(cost, 2) AS cost, round(calls / sum(calls) OVER (), 6) AS call_share, round(cost / sum(cost) OVER (), 6) AS cost_share, sum(unpriced) OVER () > 0 AS partial FROM t""",
    "exact_scores": """WITH e AS (SELECT DISTINCT l_orderkey AS question, l_partkey AS item FROM lineitem WHERE l_returnflag = 'R'), a AS (SELECT DISTINCT l_orderkey AS question, l_partkey AS item FROM lineitem WHERE l_linestatus = 'F'),
            j AS (SELECT coalesce(e.question, a.question) AS question, e.item AS ei, a.item AS ai FROM e FULL JOIN a ON e.question = a.question AND e.item = a.item),
            c AS (SELECT question, count(ei) AS n_expected, count(ai) AS n_answered, count(*) FILTER (WHERE ei = ai) AS n_right FROM j GROUP BY question)
        SELECT *, CASE WHEN n_answered > 0 THEN round(n_right / n_answered, 9) END AS precision, CASE WHEN n_expected > 0 THEN round(n_right / n_expected, 9) END AS recall, n_right = n_expected AND n_right = n_answered AS exact FROM c""",
    "majority_parents": """WITH k AS (SELECT o_custkey, o_orderpriority, count(*) AS k FROM orders GROUP BY 1, 2)
        SELECT o_custkey, cast(sum(k) AS BIGINT) AS n, CASE WHEN 2 * max(k) > sum(k) THEN arg_max(o_orderpriority, k) END AS parent FROM k GROUP BY o_custkey""",
    "connectivity_report": """WITH k AS (SELECT o_custkey, count(*) + 1 AS n FROM orders GROUP BY 1), t AS (SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM supplier) AS n_nodes)
        SELECT n_nodes, count(*) AS n_components, cast(sum(n) AS BIGINT) AS connected, max(n) AS giant, round(max(n) / n_nodes, 9) AS giant_share, cast(n_nodes - sum(n) AS BIGINT) AS isolated FROM k, t GROUP BY n_nodes""",
    "label_coverage": """WITH l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1), s AS (SELECT lang, source, CASE WHEN quality IS NULL THEN 'unreached' WHEN quality = 1 THEN 'covered' ELSE 'refused' END AS disposition FROM documents LEFT JOIN l USING (doc_id))
        SELECT lang, source, disposition, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY lang, source), 9) AS share FROM s GROUP BY lang, source, disposition""",
    "contract_slices": """WITH s AS (SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), '+') AS slice, count(*) AS k FROM events GROUP BY user_id, ts::DATE) SELECT slice, count(*) AS n_users, cast(sum(k) AS BIGINT) AS n_events FROM s GROUP BY slice""",
    "projection_diagnostics": f"""WITH {GRAPH_SQL}, e AS (SELECT relation, src AS node_id FROM edges UNION SELECT relation, dst FROM edges), t AS (SELECT relation, kind, count(*) AS touched FROM e JOIN nodes USING (node_id) GROUP BY 1, 2), k AS (SELECT kind, count(*) AS total FROM nodes GROUP BY 1)
        SELECT relation, kind, touched, total - touched AS orphans FROM t JOIN k USING (kind)""",
    "unit_telemetry": """WITH c AS (SELECT doc_id, CASE WHEN lang = 'de' THEN lower(text) ELSE text END AS old, CASE WHEN quality = 0 THEN 'v1' ELSE 'v2' END AS contract FROM documents JOIN labels USING (doc_id)),
            r AS (SELECT source, CASE WHEN c.doc_id IS NULL THEN 'new' WHEN contract <> 'v2' THEN 'contract_changed' WHEN old <> text THEN 'content_changed' ELSE 'hit' END AS reason FROM documents d LEFT JOIN c USING (doc_id))
        SELECT source, CASE WHEN reason = 'hit' THEN 'reuse' ELSE 'produce' END AS action, reason, count(*) AS n FROM r GROUP BY ALL""",
    "concept_lists": """WITH l AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
            a AS (SELECT 'orders' AS list, o_custkey AS id, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'parts', o_custkey, count(DISTINCT l_partkey) FROM l GROUP BY 2
                UNION ALL SELECT 'suppliers', o_custkey, count(DISTINCT l_suppkey) FROM l GROUP BY 2 UNION ALL SELECT 'ordered', l_partkey, count(DISTINCT l_orderkey) FROM l GROUP BY 2)
        SELECT list, id, n FROM (SELECT *, row_number() OVER (PARTITION BY list ORDER BY n DESC, id) AS k FROM a) WHERE k <= 10""",
    "blob_hashes": r"""SELECT doc_id, sha1(encode('blob ' || strlen(t)) || '\x00'::BLOB || encode(t)) AS blob, cast(ceil(length(t) / 4) AS BIGINT) AS n_tokens, cast(least(greatest(ceil(strlen(t) / 1024 * 4.0), 2), 40) AS BIGINT) AS budget,
            sha256(trim(regexp_replace(t, '\r\n?', chr(10), 'g'))) AS answer_sha256 FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "name_forms": """WITH p AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS w, p_size, p_type, p_brand FROM part)
        SELECT p_partkey, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = len(w) THEN x || '_item' ELSE x END), '_') AS entity, 'a/' || p_brand || '/x' AS path,
            CASE WHEN p_size > 25 THEN p_brand || '/' || p_type END AS tail, cast(1 + p_size % 5 + (p_size % 5) ** 2 + (p_size % 5) ** 3 AS BIGINT) AS bound FROM p""",
}
