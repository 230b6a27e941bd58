"""Patterns, comparison, bounded walks, views and records over the supplied tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import comparison, graph, memberships, patterns, records, walks
from lodegraph.runtime import dealt
from lodegraph.sources import star
from lodegraph.sources.star import GRAPH_SQL, table

#: Concepts of customers, as a user would store them.
CONCEPTS = {
    "busy_builder": '{"and": [{"field_in": {"path": "segment", "values": ["BUILDING", "MACHINERY"]}}, {"edge_exists": {"direction": "in", "relation": "member_of", "kind": "Order"}}]}',
    "idle_or_asian": '{"or": [{"not": {"edge_exists": {"direction": "in", "relation": "member_of"}}}, {"field_equals": {"path": "place.region", "value": "ASIA"}}]}',
    "settled": '{"field_set_equals": {"path": "statuses", "values": ["O", "F"]}}',
}


def pattern_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer against every concept; customers without orders aren't known to be outside one."""
    placed = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.struct(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).alias("place"))
    statuses = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("statuses"))
    fields = table(spark, sf_dir, "customer").join(placed, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(statuses, F.col("c_custkey") == F.col("o_custkey"), "left")
    fields = fields.select(star.node_id("Customer", "c_custkey").alias("node_id"), F.col("c_mktsegment").alias("segment"), "place", "statuses")
    view = patterns.subject_view(star.nodes(spark, sf_dir), star.edges(spark, sf_dir, ("contains", "member_of")), fields)
    return patterns.evaluated(view, "node_id", {k: json.loads(v) for k, v in CONCEPTS.items()}, F.col("statuses").isNotNull(), True, frozenset({"statuses"}))


def _propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line of an order says something about its part."""
    terms = F.array(*map(F.lit, ("Net Price", "net_price", "NP", "gross")))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("bucket"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.array("l_returnflag", F.concat(F.lit("s"), "l_linestatus"), F.concat(F.lit("q"), F.floor(F.col("l_quantity") / 20).cast("string"))).alias("objects"),
        F.when(F.col("l_discount") >= 0.09, comparison.NEGATED).when(F.col("l_tax") >= 0.07, "hedged").otherwise("affirmed").alias("polarity"),
        F.when(F.col("l_linenumber") <= 3, comparison.CONFORMANCE[0]).when(F.col("l_linenumber") <= 5, comparison.CONFORMANCE[1]).otherwise("permissive").alias("modality"),
        F.floor(F.col("l_quantity") / 25).alias("scope"), F.year("l_shipdate").alias("validity"), F.get(terms, (F.col("l_suppkey") % 4).cast("int")).alias("term"), (F.col("l_suppkey") % 10 < 6).alias("resolved"),
    )


def comparison_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of propositions by class, over the buckets that are compared; `oversize_buckets` has the others."""
    return comparison.compared(_propositions(spark, sf_dir), "bucket").groupBy("class").agg(F.count(F.lit(1)).alias("n"))


def oversize_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.oversize(_propositions(spark, sf_dir), "bucket")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("lang", "source", comparison.combined_signal(F.col("good"), F.col("toxic")).alias("signal"))


def signal_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).groupBy("lang", "signal").agg(F.count(F.lit(1)).alias("n"))


def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source the verdict over its documents' signals; a conflict can't be verified."""
    results = _signals(spark, sf_dir).select("source", F.when(F.col("signal") == "conflict", "unverifiable").otherwise(F.col("signal")).alias("result"))
    return comparison.verdict(results, "source", "result")


def plan_realization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' order plans: an urgent order in the old and the new half, and whether the counts agree."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    cut = F.lit("1998-01-01").cast("timestamp")
    halves = orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderdate") >= cut).alias("new"), F.count_if(F.col("o_orderdate") < cut).alias("old"))
    joined = table(spark, sf_dir, "customer").join(halves, F.col("c_custkey") == F.col("o_custkey"), "left")
    state = comparison.realization(F.col("new") > 0, F.col("old") > 0, F.col("new") == F.col("old"))
    return joined.groupBy("c_mktsegment", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def provenance_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From every supplier the first orders that its parts lead to, within three bounded levels."""
    nodes, edges = star.nodes(spark, sf_dir), star.edges(spark, sf_dir, ("emits", "depends_on"))
    found = walks.provenance(nodes, edges, nodes.where("kind = 'Supplier'").select("node_id"), ("emits", "depends_on"), ("Order",), depth=3)
    return found.select("source", "target", "rank", "depth", F.array_join("path", " ").alias("path"), F.array_join("edges", " ").alias("edges"), "truncated")


def ownership_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far nodes stand below the nearest region."""
    pairs = graph.structural_pairs(star.edges(spark, sf_dir, ("contains", "member_of"))).select(F.col("parent").alias("src"), F.col("child").alias("dst"))
    found = walks.nearest_root(pairs, star.nodes(spark, sf_dir).where("kind = 'Region'"), 6)
    return found.join(star.nodes(spark, sf_dir).select(F.col("node_id").alias("node"), "kind"), "node").groupBy("kind", "depth").agg(F.count(F.lit(1)).alias("n"))


def recipe_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hops down from regions, not on from suppliers."""
    nodes = star.nodes(spark, sf_dir)
    found = walks.recipe(star.edges(spark, sf_dir, ("contains", "emits")), nodes, nodes.where("kind = 'Region'"), 3, "downstream", ("contains", "emits"), ("Supplier",))
    return found.groupBy("source", "depth").agg(F.count(F.lit(1)).alias("n"))


def grouped_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walks.grouped_view(star.nodes(spark, sf_dir), star.edges(spark, sf_dir), F.col("kind"))


def view_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer: its orders and their parts as a graph, and how it would be shown."""
    tasks = star.tasks(spark, sf_dir)
    placed = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey")).distinct()
    lines = dealt(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), tasks, "l_orderkey").distinct().join(placed, "l_orderkey")
    of = lambda rows, orders, parts, edges: rows.select("o_custkey", orders.alias("orders"), parts.alias("parts"), edges.alias("edges"))
    orders = of(lines.groupBy("o_custkey", "l_orderkey").agg(F.count(F.lit(1)).alias("n")), F.lit(1), F.lit(0), F.col("n"))
    parts = of(dealt(lines.select("o_custkey", "l_partkey"), tasks, "o_custkey", "l_partkey").distinct(), F.lit(0), F.col("l_partkey").isNotNull().cast("int"), F.lit(0))
    sized = orders.union(parts).groupBy("o_custkey").agg((F.sum("orders") + F.sum("parts")).alias("n_nodes"), F.sum("edges").alias("n_edges"))
    return sized.select("o_custkey", "n_nodes", "n_edges", walks.shape_of(F.col("n_nodes"), F.col("n_edges")).alias("shape"))


def frame_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as frames of what they contain; parts have no region and form a frame of their own."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = lambda kind, name, key, nation: table(spark, sf_dir, name).join(nations, F.col(nation) == F.col("n_nationkey")).select(star.node_id(kind, key).alias("node_id"), star.node_id("Region", "n_regionkey").alias("frame"))
    own = table(spark, sf_dir, "region").select(star.node_id("Region", "r_regionkey").alias("node_id"), star.node_id("Region", "r_regionkey").alias("frame"))
    nation = nations.select(star.node_id("Nation", "n_nationkey").alias("node_id"), star.node_id("Region", "n_regionkey").alias("frame"))
    parts = table(spark, sf_dir, "part").select(star.node_id("Part", "p_partkey").alias("node_id"), F.lit("none").alias("frame"))
    frames = own.union(nation).union(region("Customer", "customer", "c_custkey", "c_nationkey")).union(region("Supplier", "supplier", "s_suppkey", "s_nationkey")).union(parts)
    return walks.framed(frames, star.edges(spark, sf_dir, ("contains", "emits")))


def domain_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders take the type of their parts if all agree."""
    anchors = table(spark, sf_dir, "part").select(star.node_id("Part", "p_partkey").alias("node_id"), F.col("p_type").alias("domain"))
    found = walks.propagated(star.edges(spark, sf_dir, ("depends_on",)), anchors, star.nodes(spark, sf_dir).where("kind = 'Order'"), 2 * star.tasks(spark, sf_dir))
    return found.groupBy("state", "domain", "n_domains").agg(F.count(F.lit(1)).alias("n"))


def betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled betweenness of regions, nations, suppliers and parts; each line of an order is an edge from its supplier to its part."""
    nodes = star.nodes(spark, sf_dir).where("kind IN ('Region', 'Nation', 'Supplier', 'Part')")
    sold = table(spark, sf_dir, "lineitem").select(star.node_id("Supplier", "l_suppkey").alias("src"), star.node_id("Part", "l_partkey").alias("dst"))
    return walks.sampled_betweenness(nodes, star.edges(spark, sf_dir, ("contains",)).select("src", "dst").union(sold), 200)


def literal_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON literals with their lines: leaves by path."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.struct(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag")).alias("at"))).alias("lines"))
    literal = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"), "lines"))
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", literal.alias("json"))
    found = records.addressed(records.leaves(rows, "o_orderkey", "json"), "o_orderkey")
    return found.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("multiplicity").alias("most"), F.countDistinct("value").alias("n_values"))


def edge_storage_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey", "l_linenumber")
    made = records.storage_ids(lines, F.concat_ws(">", "l_orderkey", "l_suppkey"), F.concat_ws("|", "l_partkey", "l_linenumber"))
    return made.select("storage_id")


def evidence_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels, events and documents as evidence of one shape."""
    no = F.lit(False)
    families = {
        "label": (table(spark, sf_dir, "labels"), F.col("doc_id"), records.evidence_class(F.col("toxic") == 1, F.lit(True), no, no), F.col("quality")),
        "event": (table(spark, sf_dir, "events"), F.col("user_id"), records.evidence_class(F.col("event_type") == "error", no, F.col("event_type") == "purchase", no), F.col("event_type")),
        "document": (table(spark, sf_dir, "documents"), F.col("doc_id"), records.evidence_class(no, no, no, F.col("lang") == "en"), F.col("lang")),
    }
    return records.evidence(families).groupBy("family", "class").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("evidence_id").alias("n_ids"), F.min("evidence_id").alias("first_id"))


def claim_reduction(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.year("o_orderdate").alias("year"), F.concat_ws("/", "o_custkey", "o_orderpriority").alias("proposition"))
    return records.reduced(claims, "proposition", "o_orderkey", "o_orderstatus", "year")


def proposal_conservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are proposed; their first lines settle them."""
    return records.conserved(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id")), "id")


#: Concepts of parts and customers with what their absence means.
ROLES = {
    "sold": {"expression": {"and": [{"edge_exists": {"direction": "in", "relation": "emits", "kind": "Supplier"}}, {"field_in": {"path": "group", "values": ["STANDARD", "SMALL"]}}]}, "closed_world": False, "role": True},
    "unsold": {"expression": {"not": {"edge_exists": {"direction": "in", "relation": "emits"}}}, "closed_world": True},
    "asked": {"expression": {"or": [{"edge_exists": {"direction": "in", "relation": "member_of"}}, {"field_equals": {"path": "group", "value": "BUILDING"}}]}, "closed_world": False, "role": True},
    "builder": {"expression": {"field_equals": {"path": "group", "value": "BUILDING"}}, "closed_world": True},
}


def _memberships(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = star.nodes(spark, sf_dir)
    edges = star.edges(spark, sf_dir, ("emits", "member_of"))
    classes = F.when(F.endswith("src", F.lit("1")), "test").when(F.endswith("src", F.lit("2")), "fixture").when(F.endswith("src", F.lit("3")) | F.endswith("src", F.lit("4")), "docs").otherwise("production")
    parts = table(spark, sf_dir, "part").select(star.node_id("Part", "p_partkey").alias("node_id"), F.col("p_partkey").alias("claim_id"), F.col("p_type").alias("group"))
    subjects = parts.union(table(spark, sf_dir, "customer").select(star.node_id("Customer", "c_custkey"), F.col("c_custkey"), F.col("c_mktsegment")))
    return memberships.evaluated(subjects, nodes, edges.withColumn("provenance_class", classes), ROLES, tasks=2 * star.tasks(spark, sf_dir))


def witnessed_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part and customer in every concept, with what witnesses the outcome."""
    made, _ = _memberships(spark, sf_dir)
    return made


def membership_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, witnesses = _memberships(spark, sf_dir)
    return witnesses.groupBy("concept", "kind", F.coalesce("relation", F.lit("")).alias("relation"), F.coalesce("provenance_class", F.lit("")).alias("provenance_class")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node_id").alias("n_subjects"), F.min("witness").alias("first_witness"))


def concept_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of a concept, and those that a defeater contests: customers who owe."""
    made, _ = _memberships(spark, sf_dir)
    owing = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(star.node_id("Customer", "c_custkey").alias("node_id"), F.lit("asked").alias("concept"))
    judged = memberships.contested(made, owing)
    listed = memberships.members(judged, "asked", "likely", 300).withColumn("list", F.lit("members"))
    return listed.unionByName(memberships.conflicts(judged, "asked", 40).withColumn("list", F.lit("conflicts"))).select("list", "node_id", "confidence", "n_witnesses", "truncated")


QUERIES = {
    f.__name__: f
    for f in (
        pattern_concepts, comparison_histogram, oversize_buckets, signal_verdicts, claim_verdicts, plan_realization, provenance_walk, ownership_depth, recipe_traversal, grouped_view,
        view_shapes, frame_census, domain_propagation, betweenness, literal_leaves, edge_storage_ids, evidence_records, claim_reduction, proposal_conservation,
        witnessed_memberships, membership_witnesses, concept_members,
    )
}

_PROPOSITIONS = """
    p AS (SELECT l_partkey AS bucket, l_orderkey * 10 + l_linenumber AS id, [l_returnflag, 's' || l_linestatus, 'q' || cast(floor(l_quantity / 20) AS BIGINT)] AS objects,
        CASE WHEN l_discount >= 0.09 THEN 'negated' WHEN l_tax >= 0.07 THEN 'hedged' ELSE 'affirmed' END AS polarity, CASE WHEN l_linenumber <= 3 THEN 'normative' WHEN l_linenumber <= 5 THEN 'descriptive' ELSE 'permissive' END AS modality,
        floor(l_quantity / 25) AS scope, year(l_shipdate) AS validity, ['Net Price', 'net_price', 'NP', 'gross'][l_suppkey % 4 + 1] AS term, l_suppkey % 10 < 6 AS resolved FROM lineitem),
    sizes AS (SELECT bucket, count(*) AS n, cast(count(*) * (count(*) - 1) / 2 AS BIGINT) AS pairs FROM p GROUP BY bucket)"""
_SIGNALS = """
    l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
    s AS (SELECT lang, source, CASE WHEN coalesce(good, false) AND coalesce(toxic, false) THEN 'conflict' WHEN good THEN 'supported' WHEN toxic THEN 'refuted' ELSE 'underdetermined' END AS signal FROM documents LEFT JOIN l USING (doc_id))"""


def _walk_level(level: int) -> str:
    seen = " UNION ALL ".join(f"SELECT source, node FROM l{k}" for k in range(level))
    return f"""l{level} AS (SELECT source, node, row_number() OVER (PARTITION BY source ORDER BY place, nth) AS position, {level} AS depth, path || ' ' || node AS path, edges || CASE edges WHEN '' THEN '' ELSE ' ' END || edge_id AS edges,
            count(*) OVER (PARTITION BY source) > 32 AS cut FROM (
        SELECT source, other AS node, f.position AS place, nth, path, edges, edge_id, row_number() OVER (PARTITION BY source, other ORDER BY f.position, nth) AS again FROM l{level - 1} f JOIN listed g ON f.node = g.node
        WHERE f.position <= 32 AND (source, other) NOT IN ({seen})) WHERE again = 1)"""


def _identity(*parts: str) -> str:
    framed = ", ".join(f"coalesce(length(cast({p} AS VARCHAR)) || ':' || cast({p} AS VARCHAR), '-')" for p in parts)
    return f"sha256(concat_ws('|', {framed}))"


_WITNESSED = f"""{GRAPH_SQL}, subj AS (SELECT 'part:' || p_partkey AS node_id, p_partkey AS claim_id, p_type AS g FROM part UNION ALL SELECT 'customer:' || c_custkey, c_custkey, c_mktsegment FROM customer),
    w AS (SELECT dst AS node_id, edge_id, relation, src AS other, CASE right(src, 1) WHEN '1' THEN 'test' WHEN '2' THEN 'fixture' WHEN '3' THEN 'docs' WHEN '4' THEN 'docs' ELSE 'production' END AS class FROM edges WHERE relation IN ('emits', 'member_of')),
    rules AS (SELECT unnest(['sold', 'unsold', 'asked', 'builder']) AS concept, unnest(['emits', 'emits', 'member_of', NULL]) AS relation, unnest([true, false, true, false]) AS role, unnest([false, true, false, true]) AS closed),
    counted AS (SELECT s.node_id, claim_id, concept, role, closed, g, count(w.edge_id) AS n, count(*) FILTER (WHERE class = 'production') AS n_production, count(*) FILTER (WHERE class = 'test') AS n_test, count(*) FILTER (WHERE class = 'fixture') AS n_fixture, count(*) FILTER (WHERE class = 'docs') AS n_docs
        FROM subj s CROSS JOIN rules r LEFT JOIN w ON w.node_id = s.node_id AND w.relation = r.relation GROUP BY ALL),
    tested AS (SELECT *, CASE concept WHEN 'sold' THEN n > 0 AND g IN ('STANDARD', 'SMALL') WHEN 'unsold' THEN n = 0 WHEN 'asked' THEN n > 0 OR g = 'BUILDING' ELSE g = 'BUILDING' END AS matched FROM counted),
    out AS (SELECT *, matched AND role AND n_production = 0 AS excluded, CASE WHEN matched AND role AND n_production = 0 THEN 'not_member' WHEN matched THEN 'member' WHEN closed THEN 'not_member' ELSE 'abstain' END AS outcome FROM tested),
    made AS (SELECT node_id, concept, outcome, CASE WHEN excluded THEN 'matched_scope_excluded' WHEN matched THEN 'matched' WHEN closed THEN 'not_matched_closed_world' ELSE 'insufficient_evidence' END AS result,
        CASE WHEN excluded THEN 'TEST_OR_FIXTURE_ONLY' WHEN outcome = 'abstain' THEN 'INVENTORY_INCOMPLETE' END AS reason, CASE WHEN outcome <> 'abstain' THEN CASE WHEN n > 0 THEN 'certain' ELSE 'likely' END END AS confidence,
        CASE WHEN outcome = 'abstain' THEN 0 ELSE greatest(n, 1) END AS n_witnesses, CASE WHEN outcome = 'abstain' THEN 0 ELSE n_production END AS n_production, CASE WHEN outcome = 'abstain' THEN 0 ELSE n_test END AS n_test,
        CASE WHEN outcome = 'abstain' THEN 0 ELSE n_fixture END AS n_fixture, CASE WHEN outcome = 'abstain' THEN 0 ELSE n_docs END AS n_docs FROM out)"""

ORACLE_SQL = {
    "witnessed_memberships": f"WITH {_WITNESSED} SELECT * FROM made",
    "membership_witnesses": f"""WITH {_WITNESSED}, listed AS (SELECT concept, 'projected_edge' AS kind, relation, class, node_id, edge_id AS witness FROM out JOIN rules USING (concept) JOIN w USING (node_id, relation) WHERE outcome <> 'abstain'
            UNION ALL SELECT concept, 'claim', '', '', node_id, cast(claim_id AS VARCHAR) FROM out WHERE outcome <> 'abstain' AND n = 0)
        SELECT concept, kind, relation, class AS provenance_class, count(*) AS n, count(DISTINCT node_id) AS n_subjects, min(witness) AS first_witness FROM listed GROUP BY ALL""",
    "concept_members": f"""WITH {_WITNESSED}, owing AS (SELECT 'customer:' || c_custkey AS node_id FROM customer WHERE c_acctbal < 0),
            judged AS (SELECT node_id, outcome, n_witnesses, CASE WHEN outcome <> 'abstain' AND node_id IN (SELECT node_id FROM owing) THEN 'contested' ELSE confidence END AS confidence FROM made WHERE concept = 'asked'),
            m AS (SELECT *, row_number() OVER (ORDER BY node_id) AS nth, count(*) OVER () AS k FROM judged WHERE outcome = 'member'), c AS (SELECT *, row_number() OVER (ORDER BY node_id) AS nth, count(*) OVER () AS k FROM judged WHERE confidence = 'contested')
        SELECT 'members' AS list, node_id, confidence, n_witnesses, k > 300 AS truncated FROM m WHERE nth <= 300 AND confidence IN ('likely', 'certain') UNION ALL SELECT 'conflicts', node_id, confidence, n_witnesses, k > 40 FROM c WHERE nth <= 40""",
    "pattern_concepts": """WITH o AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderstatus)) AS statuses FROM orders GROUP BY 1),
        c AS (SELECT 'customer:' || c_custkey AS node_id, c_mktsegment, r_name, statuses FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN o ON c_custkey = o_custkey),
        e AS (SELECT node_id, statuses, 'busy_builder' AS concept, c_mktsegment IN ('BUILDING', 'MACHINERY') AND statuses IS NOT NULL AS holds FROM c
            UNION ALL SELECT node_id, statuses, 'idle_or_asian', statuses IS NULL OR coalesce(r_name = 'ASIA', false) FROM c UNION ALL SELECT node_id, statuses, 'settled', coalesce(statuses = ['F', 'O'], false) FROM c)
        SELECT node_id, concept, CASE WHEN holds THEN 'member' WHEN statuses IS NOT NULL THEN 'not_member' ELSE 'abstain' END AS outcome FROM e""",
    "comparison_histogram": f"""WITH {_PROPOSITIONS}, pairs AS (
            SELECT a.polarity <> b.polarity AND 'negated' IN (a.polarity, b.polarity) AS opposed, a.modality <> b.modality AS d_modality, 'permissive' NOT IN (a.modality, b.modality) AS factual, a.scope <> b.scope AS d_scope, a.validity <> b.validity AS d_validity,
                a.term <> b.term AS d_term, 'gross' NOT IN (a.term, b.term) AS alike, NOT a.resolved OR NOT b.resolved AS unresolved, len(list_intersect(a.objects, b.objects)) AS common
            FROM p a JOIN p b ON a.bucket = b.bucket AND a.id < b.id JOIN sizes s ON a.bucket = s.bucket WHERE s.n <= 40),
        classed AS (SELECT CASE WHEN common < 2 THEN CASE WHEN unresolved AND d_term THEN 'referent_ambiguity' ELSE 'incomparable' END WHEN opposed THEN 'direct_conflict'
            WHEN common = 3 AND d_modality THEN CASE WHEN factual THEN 'conformance_gap_candidate' ELSE 'modality_divergence' END WHEN common = 3 AND d_scope THEN 'scope_divergence' WHEN common = 3 AND d_validity THEN 'temporal_divergence'
            WHEN unresolved AND d_term THEN CASE WHEN alike THEN 'terminology_conflict' ELSE 'referent_ambiguity' END WHEN common = 3 THEN 'equivalent_proposition' ELSE 'compatible_partial' END AS class FROM pairs)
        SELECT class, count(*) AS n FROM classed GROUP BY class""",
    "oversize_buckets": f"WITH {_PROPOSITIONS} SELECT * FROM sizes WHERE n > 40",
    "signal_verdicts": f"WITH {_SIGNALS} SELECT lang, signal, count(*) AS n FROM s GROUP BY lang, signal",
    "claim_verdicts": f"""WITH {_SIGNALS}, r AS (SELECT source, CASE signal WHEN 'refuted' THEN 1 WHEN 'conflict' THEN 2 WHEN 'underdetermined' THEN 3 ELSE 4 END AS k FROM s)
        SELECT source, ['refuted', 'unverifiable', 'underdetermined', 'supported'][min(k)] AS verdict, count(*) AS n_results FROM r GROUP BY source""",
    "plan_realization": """WITH h AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS new, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS old FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
        SELECT c_mktsegment, CASE WHEN new IS NULL THEN 'unknown' WHEN new > 0 AND new = old THEN 'implemented' WHEN new > 0 AND old > 0 THEN 'partial' WHEN new > 0 THEN 'diverged' WHEN old > 0 THEN 'removed' ELSE 'not_started' END AS state, count(*) AS n
        FROM customer LEFT JOIN h ON c_custkey = o_custkey GROUP BY 1, 2""",
    "provenance_walk": f"""WITH {GRAPH_SQL}, w AS (SELECT * FROM edges WHERE relation IN ('emits', 'depends_on')), b AS (SELECT src AS node, dst AS other, relation, edge_id FROM w UNION ALL SELECT dst, src, relation, edge_id FROM w),
            degree AS (SELECT node AS other, count(*) AS degree FROM b GROUP BY 1), listed AS (
                SELECT * FROM (SELECT node, other, edge_id, row_number() OVER (PARTITION BY node ORDER BY degree, relation, other) AS nth FROM b JOIN degree USING (other)) WHERE nth <= 48),
            l0 AS (SELECT node_id AS source, node_id AS node, 1 AS position, 0 AS depth, node_id AS path, '' AS edges, false AS cut FROM nodes WHERE kind = 'Supplier'), {_walk_level(1)}, {_walk_level(2)}, {_walk_level(3)},
            walked AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3), flags AS (SELECT source, bool_or(cut) AS cut FROM walked GROUP BY source),
            ranked AS (SELECT source, node AS target, row_number() OVER (PARTITION BY source ORDER BY depth, position) AS rank, count(*) OVER (PARTITION BY source) AS n, depth, path, edges FROM walked WHERE node LIKE 'order:%')
        SELECT source, target, cast(rank AS INT) AS rank, depth, path, edges, n > 12 OR cut AS truncated FROM ranked JOIN flags USING (source) WHERE rank <= 12""",
    "ownership_depth": f"""WITH {GRAPH_SQL}, d AS (SELECT CASE kind WHEN 'Region' THEN 0 WHEN 'Nation' THEN 1 WHEN 'Customer' THEN 2 WHEN 'Supplier' THEN 2 WHEN 'Order' THEN 3 END AS depth, kind FROM nodes WHERE kind <> 'Part')
        SELECT kind, cast(depth AS INT) AS depth, count(*) AS n FROM d GROUP BY kind, depth""",
    "recipe_traversal": """WITH n AS (SELECT 'region:' || n_regionkey AS source, n_nationkey FROM nation)
        SELECT 'region:' || r_regionkey AS source, 0 AS depth, 1 AS n FROM region UNION ALL SELECT source, 1, count(*) FROM n GROUP BY source
        UNION ALL SELECT source, 2, count(*) FROM (SELECT source, c_custkey AS k FROM n JOIN customer ON c_nationkey = n_nationkey UNION ALL SELECT source, s_suppkey FROM n JOIN supplier ON s_nationkey = n_nationkey) GROUP BY source""",
    "grouped_view": f"""WITH {GRAPH_SQL} SELECT a.kind AS from_group, b.kind AS to_group, relation, count(*) AS n_edges, count(DISTINCT src) AS n_sources
        FROM edges JOIN nodes a ON src = a.node_id JOIN nodes b ON dst = b.node_id GROUP BY 1, 2, 3""",
    "view_shapes": """WITH l AS (SELECT DISTINCT o_custkey, l_orderkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
            g AS (SELECT o_custkey, count(DISTINCT l_orderkey) + count(DISTINCT l_partkey) AS n_nodes, count(*) AS n_edges FROM l GROUP BY 1)
        SELECT *, CASE WHEN n_nodes >= 8 AND (n_edges / (n_nodes * (n_nodes - 1)) >= 0.18 OR n_edges > 2 * n_nodes) THEN 'matrix' ELSE 'links' END AS shape FROM g""",
    "frame_census": f"""WITH {GRAPH_SQL}, place AS (SELECT 'nation:' || n_nationkey AS nation, 'region:' || n_regionkey AS frame FROM nation),
            f AS (SELECT node_id, node_id AS frame FROM nodes WHERE kind = 'Region' UNION ALL SELECT nation, frame FROM place UNION ALL SELECT dst, frame FROM edges JOIN place ON src = nation WHERE relation = 'contains' UNION ALL SELECT node_id, 'none' FROM nodes WHERE kind = 'Part'),
            j AS (SELECT a.frame AS x, b.frame AS y, src = dst AS loop FROM edges JOIN f a ON src = a.node_id JOIN f b ON dst = b.node_id WHERE relation IN ('contains', 'emits')),
            s AS (SELECT x AS frame, x = y AS own, loop FROM j UNION ALL SELECT y, false, loop FROM j WHERE x <> y),
            t AS (SELECT src AS node_id FROM edges WHERE relation IN ('contains', 'emits') UNION SELECT dst FROM edges WHERE relation IN ('contains', 'emits')),
            m AS (SELECT frame, count(*) AS n_nodes, count(*) FILTER (WHERE node_id NOT IN (SELECT node_id FROM t)) AS orphans FROM f GROUP BY frame)
        SELECT m.*, count(*) FILTER (WHERE own) AS internal, count(*) FILTER (WHERE NOT own) AS boundary, count(*) FILTER (WHERE loop) AS loops FROM m LEFT JOIN s USING (frame) GROUP BY ALL""",
    "domain_propagation": """WITH v AS (SELECT l_orderkey, min(p_type) AS domain, count(DISTINCT p_type) AS k FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
            s AS (SELECT coalesce(k, 0) AS n_domains, CASE WHEN k = 1 THEN domain END AS domain FROM orders LEFT JOIN v ON o_orderkey = l_orderkey)
        SELECT CASE WHEN n_domains = 1 THEN 'assigned' WHEN n_domains > 1 THEN 'ambiguous' ELSE 'no_anchor' END AS state, domain, n_domains, count(*) AS n FROM s GROUP BY ALL""",
    "betweenness": """WITH n AS (SELECT 'region:' || r_regionkey AS node FROM region UNION ALL SELECT 'nation:' || n_nationkey FROM nation UNION ALL SELECT 'supplier:' || s_suppkey FROM supplier UNION ALL SELECT 'part:' || p_partkey FROM part),
            e AS (SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
                UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey FROM lineitem), m AS (SELECT src, dst, count(*) AS times FROM e SEMI JOIN n ON src = n.node GROUP BY ALL),
            starts AS (SELECT node AS source FROM n ORDER BY node LIMIT 200),
            h1 AS (SELECT source, dst AS node, times AS paths FROM starts JOIN m ON source = src), h2 AS (SELECT source, dst AS node, sum(paths * times) AS paths FROM h1 JOIN m ON node = src GROUP BY ALL),
            h3 AS (SELECT source, dst AS node, sum(paths * times) AS paths FROM h2 JOIN m ON node = src GROUP BY ALL),
            d2 AS (SELECT h2.source, h2.node, h2.paths, coalesce(sum(h2.paths * times / h3.paths), 0) AS passed FROM h2 LEFT JOIN (m JOIN h3 ON dst = h3.node) ON src = h2.node AND h2.source = h3.source GROUP BY ALL),
            d1 AS (SELECT h1.source, h1.node, coalesce(sum(h1.paths * times / d2.paths * (1 + passed)), 0) AS passed FROM h1 LEFT JOIN (m JOIN d2 ON dst = d2.node) ON src = h1.node AND h1.source = d2.source GROUP BY ALL),
            s AS (SELECT node, sum(passed) AS score FROM (SELECT node, passed FROM d1 UNION ALL SELECT node, passed FROM d2) GROUP BY node)
        SELECT node, round(coalesce(score, 0) * (SELECT count(*) FROM n) / (SELECT count(*) FROM starts), 6) AS score FROM n LEFT JOIN s USING (node)""",
    "literal_leaves": """WITH l AS (SELECT l_orderkey AS k, l_partkey, l_linenumber, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
            v AS (SELECT o_orderkey AS k, 'status' AS path, o_orderstatus AS value FROM orders UNION ALL SELECT o_orderkey, 'customer', cast(o_custkey AS VARCHAR) FROM orders
                UNION ALL SELECT k, 'lines[].part', cast(l_partkey AS VARCHAR) FROM l UNION ALL SELECT k, 'lines[].at.line', cast(l_linenumber AS VARCHAR) FROM l UNION ALL SELECT k, 'lines[].at.flag', l_returnflag FROM l),
            c AS (SELECT path, value, count(*) OVER (PARTITION BY k, path) AS m FROM v)
        SELECT path, count(*) AS n, max(m) AS most, count(DISTINCT value) AS n_values FROM c GROUP BY path""",
    "edge_storage_ids": """WITH e AS (SELECT l_orderkey || '>' || l_suppkey AS id, left(sha256(l_partkey || '|' || l_linenumber), 16) AS digest FROM lineitem),
            c AS (SELECT *, count(*) OVER (PARTITION BY id) AS n, row_number() OVER (PARTITION BY id, digest) AS nth FROM e)
        SELECT CASE WHEN n = 1 THEN id ELSE id || '#' || digest || '#' || nth END AS storage_id FROM c""",
    "evidence_records": f"""WITH r AS (SELECT 'label' AS family, CASE WHEN toxic = 1 THEN 'refusal' ELSE 'interpretation' END AS class, cast(doc_id AS VARCHAR) AS subject, cast(quality AS VARCHAR) AS value FROM labels
            UNION ALL SELECT 'event', CASE event_type WHEN 'error' THEN 'refusal' WHEN 'purchase' THEN 'derived' ELSE 'extracted' END, cast(user_id AS VARCHAR), event_type FROM events
            UNION ALL SELECT 'document', CASE WHEN lang = 'en' THEN 'inferred' ELSE 'extracted' END, cast(doc_id AS VARCHAR), lang FROM documents),
            i AS (SELECT *, {_identity('family', 'subject', 'value')} AS evidence_id FROM r)
        SELECT family, class, count(*) AS n, count(DISTINCT evidence_id) AS n_ids, min(evidence_id) AS first_id FROM i GROUP BY family, class""",
    "claim_reduction": """SELECT o_custkey || '/' || o_orderpriority AS proposition, min(o_orderkey) AS canonical, count(*) AS n_claims, count(DISTINCT o_orderstatus) AS n_supports, count(DISTINCT year(o_orderdate)) AS n_sources FROM orders GROUP BY 1""",
    "proposal_conservation": """WITH o AS (SELECT l_orderkey AS id, count(*) AS k FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)
        SELECT CASE WHEN o_orderkey IS NULL THEN 'unproposed' WHEN k IS NULL THEN 'lost' WHEN k > 1 THEN 'repeated' ELSE 'settled' END AS state, count(*) AS n FROM orders FULL JOIN o ON o_orderkey = id GROUP BY 1""",
}
