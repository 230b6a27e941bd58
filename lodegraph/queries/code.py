"""Call sites, entity layers, claim obligations and identity closure over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import callsites, entities, identity, obligations, slices
from lodegraph.runtime import dealt, written
from lodegraph.sources import star
from lodegraph.sources.star import GRAPH_SQL, table

#: Suppliers as modules, ship days as places in them: a year of 360 days holds twelve months, and the module all years.
_YEAR, _MONTH, _MODULE = 360, 30, 3600


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return lines.select(
        F.concat(F.lit("m/"), (F.col("l_suppkey") % 7).cast("string"), F.lit("/f"), F.col("l_suppkey").cast("string"), F.lit(".js")).alias("file"), day.cast("long").alias("day"),
        F.concat(F.lit("n"), (F.col("l_partkey") % 60).cast("string")).alias("name"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("site"), "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_returnflag",
    )


def call_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as bindings, marks and calls of their supplier's module, counted by file, status and reason."""
    sites = _sites(spark, sf_dir)
    width = F.when(F.col("l_linenumber") == 1, _MODULE).when(F.col("l_linenumber") == 2, _YEAR).otherwise(_MONTH)
    opened = F.floor(F.col("day") / width) * width
    label = F.concat_ws("-", width.cast("string"), opened.cast("string"))
    declared = sites.where("l_linenumber <= 3")
    scopes = declared.select("file", label.alias("scope"), opened.alias("start"), (opened + width).alias("end")).distinct()
    kind = F.when(F.col("l_partkey") % 4 == 0, "import").when(F.col("l_partkey") % 4 == 1, "non_function").otherwise("function")
    plain = kind == "function"
    other = F.col("l_orderkey") % 100 + 1
    specifier = F.when(F.col("l_orderkey") % 5 == 0, "package").otherwise(F.concat(F.lit("../"), (other % 7).cast("string"), F.lit("/./f"), other.cast("string"), F.when(F.col("l_orderkey") % 3 == 0, ".js").otherwise("")))
    bindings = declared.select(
        "file", label.alias("scope"), "name", kind.alias("kind"), F.when(plain, F.when(F.col("l_quantity") < 10, "var").otherwise("function_declaration")).alias("source"), (plain & (F.col("l_tax") > 0.04)).alias("initialized"),
        F.when(kind == "import", specifier).alias("specifier"), F.when(kind == "import", F.when(F.col("l_quantity") > 45, "*").otherwise(F.concat(F.lit("n"), (F.col("l_orderkey") % 60).cast("string")))).alias("imported"), F.when(plain, F.col("site")).alias("declaration"),
    )
    marks = sites.where("l_linenumber = 4 AND l_returnflag = 'R'").select("file", F.col("day").alias("position"), "name", F.when(F.col("l_tax") > 0.06, "commonjs").otherwise("assigned").alias("mark"))
    callee = F.element_at(F.array(*map(F.lit, ("identifier",) * 6 + ("member", "subscript", "new", "call"))), (F.col("l_orderkey") % 10 + 1).cast("int"))
    calls = sites.where("l_linenumber >= 5").select("file", F.col("day").alias("start"), callee.alias("callee"), "name")
    exports = declared.where(plain & (F.col("l_linenumber") == 1)).select("file", F.col("name").alias("exported"), F.col("name").alias("local")).distinct()
    files = sites.select("file", "l_suppkey").distinct().select("file", (F.col("l_suppkey") % 23 != 0).alias("grammar"), (F.col("l_suppkey") % 19 == 0).alias("broken"), (F.col("l_suppkey") % 17 == 0).alias("reexports"))
    found = callsites.bind_calls(calls, scopes, bindings, marks, exports, files, 2 * star.tasks(spark, sf_dir))
    return found.groupBy("file", "status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("declaration").alias("n_declarations"), F.sum(F.coalesce(F.size("declarations"), F.lit(0))).alias("n_candidates"))


_NOUNS = ("order", "customer", "batch", "policy", "item", "status", "index", "vessel", "crew", "invoice", "berth", "bay")
_ENDS = ("s", "_items", "_summary", "_log", "_batches", "s_new", "_links", "_state")
_ROLES = ("", "parent_", "spawned_", "main_")


def _noun(n, words: tuple[str, ...] = _NOUNS):
    return F.element_at(F.array(*map(F.lit, words)), (F.pmod(n, F.lit(len(words))) + 1).cast("int"))


def _schema_facts(spark: SparkSession, sf_dir: str) -> entities.EntityLayer:
    """Suppliers declare tables; some of their order lines are identity columns; nations name the kinds of a model."""
    k = F.col("s_suppkey")
    name = lambda n: F.concat(_noun(n), _noun(F.floor(n / 12), _ENDS))
    made = table(spark, sf_dir, "supplier").select("s_suppkey", name(k).alias("table"), F.concat(F.lit("f"), (k % 9).cast("string")).alias("file"))
    own, following = F.concat(_noun(k), F.lit("_id")), F.concat(_noun(k + 1), F.lit("_id"))
    keyed = made.select("table", F.explode(F.when(k % 3 == 0, F.array(own)).when(k % 3 == 1, F.array(own, following)).otherwise(F.array(F.lit("seq")))).alias("column")).distinct()
    lines = table(spark, sf_dir, "lineitem").where("l_partkey % 50 = 0")
    listed = lines.select(
        name(F.col("l_suppkey")).alias("table"), F.concat(_noun(F.floor(F.col("l_orderkey") / 12), _ROLES), _noun(F.col("l_orderkey")), F.lit("_id")).alias("column"), (F.col("l_returnflag") == "A").alias("unique"),
        F.when(F.col("l_tax") > 0.05, name(F.floor(F.col("l_partkey") / 50))).alias("target"),
    )
    kinded = made.where(k % 4 == 0)
    columns = listed.union(keyed.where("column <> 'seq'").select("table", "column", F.lit(False), F.lit(None))).union(kinded.select("table", F.lit("item_id"), F.lit(False), F.lit(None)))
    enums = kinded.select("table", F.lit("item_kind").alias("column"), F.explode(F.array(_noun(k), F.concat(_noun(k + 3), F.lit("s")), F.lit("other"))).alias("value"))
    n = F.col("n_nationkey")
    kinds = table(spark, sf_dir, "nation").select(F.when(n < 5, _noun(n)).when(n < 8, F.concat(_noun(n), F.lit("s"))).when(n < 11, F.concat(F.lit("client_"), _noun(n))).otherwise(F.concat(F.lit("ghost"), n.cast("string"))).alias("kind"))
    signals = made.where(k % 12 < 10).select(_noun(k).alias("entity"), F.concat(F.lit("s"), (k % 2).cast("string")).alias("source"))
    return entities.entity_layer(made.select("table", "file"), columns, keyed, enums, kinds, signals, ("spawned",), {"bay": "berth"})


def entity_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with what became of them, and what each table backs."""
    layer = _schema_facts(spark, sf_dir)
    made = layer.decisions.select(F.lit("candidate").alias("family"), "entity", "root_table", "evidence", "n_sources", "refusal")
    return made.union(layer.audit.select(F.lit("table"), "entity", "table", F.lit(None), F.lit(0), "reason"))


def entity_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships between entities, identity columns and tables that give none, and where schema and model disagree."""
    layer = _schema_facts(spark, sf_dir)
    made = layer.relationships.select(F.lit("relationship").alias("family"), "via", F.concat_ws(" ", "from_entity", "relation", "to_entity", "cardinality").alias("about"), F.concat_ws(" ", "basis", "status").alias("reason"))
    return made.union(layer.refusals.select(F.lit("refusal"), "subject", F.lit(""), "reason")).union(layer.conflicts.select(F.lit("conflict"), "subject", "about", "reason"))


#: The kind of obligation that each line of an order stands for, by its number.
_KINDS = obligations.KINDS


def _tree_path(doc_id):
    return F.concat_ws("/", F.concat(F.lit("r"), (doc_id % 7).cast("string")), F.concat(F.lit("d"), (doc_id % 40).cast("string")), doc_id.cast("string"))


def _obligations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """Lines of orders oblige their order by kinds in turn; parts are symbols, documents the tree, events the runs of checks."""
    named = ["claim_id", "obligation_id"]
    k, n = F.col("l_partkey"), F.col("n")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("claim_id"), "l_partkey", F.col("l_quantity").cast("long").alias("n"), "l_linenumber")
    lines = dealt(lines, star.tasks(spark, sf_dir), "l_partkey").withColumn("obligation_id", (k * 100 + n) * 10 + F.col("l_linenumber")).dropDuplicates(["l_partkey", *named])
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type").dropDuplicates(["p_partkey"])
    of = lambda numbers, value: F.when(F.col("l_linenumber").isin(*numbers), value)
    made = lines.join(parts, k == F.col("p_partkey")).select(
        *named, F.element_at(F.array(*map(F.lit, _KINDS)), F.col("l_linenumber")).alias("kind"),
        of((1,), F.when(n == 1, "missing name").otherwise(F.col("p_name"))).alias("symbol"), of((1, 2), F.when(F.col("l_linenumber") == 2, _tree_path(k)).when(k % 2 == 0, F.col("p_brand"))).alias("path"), of((1,), F.when(k % 3 == 0, F.col("p_type"))).alias("declaration_kind"), of((1,), n % 4 != 0).alias("require_unique"),
        of((2,), n % 6).alias("line"), of((2,), F.element_at(F.array(*map(F.lit, ("e", "zq", "the", ""))), (k % 4 + 1).cast("int"))).alias("quote"), of((3,), F.concat(F.lit("r"), (k % 7).cast("string"), F.lit("/d"), (k % 40).cast("string"), F.when(k % 2 == 0, "/").otherwise(""))).alias("prefix"),
        of((3, 4, 5), F.when(F.col("l_linenumber") == 3, F.transform(F.sequence(F.lit(0), n % 5), lambda i: _tree_path(k % 280 + i.cast("long") * 280))).otherwise(F.array(_tree_path(k), _tree_path(k + 1), _tree_path(k)))).alias("paths"), of((5,), F.array(F.lit("qqq"), F.concat(F.lit("w"), (n % 10).cast("string")))).alias("needles"),
        of((6,), F.concat(F.lit("c"), (k % 300).cast("string"))).alias("command"),
    )
    symbols = table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.col("p_name").alias("name"), F.col("p_brand").alias("file"), F.col("p_type").alias("kind"))
    files = table(spark, sf_dir, "documents").select(_tree_path(F.col("doc_id")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    events = table(spark, sf_dir, "events").where("event_id % 20 = 0")
    runs = events.select(F.concat(F.lit("c"), (F.floor(F.col("event_id") / 20) % 400).cast("string")).alias("command"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"), (F.col("value") > 5).alias("matched"), F.when(F.col("user_id") % 30 == 0, "timeout").alias("error"))
    return made, symbols, files, runs


def obligation_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = obligations.evaluated(*_obligations(spark, sf_dir))
    return found.groupBy("kind", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("n_evidence").alias("n_evidence"))


def claim_adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ("accepted_design", "proposed_design", "historical_design", "statement"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("claim_id"), kinds.alias("claim_kind"))
    return obligations.adjudicated(obligations.evaluated(*_obligations(spark, sf_dir)), claims)


def _identities(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Events are declarations, documents mention places, labels link or forbid."""
    events, documents, labels = (table(spark, sf_dir, t) for t in ("events", "documents", "labels"))
    e, d = F.col("event_id"), F.col("doc_id")
    kinds = F.array(*map(F.lit, ("click", "view", "purchase", "signup", "error")))
    said = lambda c: F.concat(F.lit(c), d.cast("string"))
    candidates = events.select(
        F.concat(F.lit("c"), e.cast("string")).alias("mention_id"), F.col("event_type").alias("fact_kind"), F.when(e % 101 != 0, F.concat_ws("/", "user_id", "event_type", F.floor(F.col("value") / 4).cast("string"))).alias("basis"),
        (e % 200).alias("file"), (F.floor(e / 200) % 60).alias("line"), F.col("event_type").alias("surface"),
    )
    mention = lambda name, df: df.select(said(name).alias("mention_id"), (d % 200).alias("file"), F.floor(d / 200).alias("line"), F.element_at(kinds, (d % 5 + 1).cast("int")).alias("surface"))
    documentary = mention("d", documents).union(mention("e", documents.where("doc_id % 40 = 0")))
    pairs = labels.select(said("d").alias("left"), F.concat(F.lit("d"), (d - d % 7).cast("string")).alias("right"), F.when(F.col("toxic") == 1, "cannot_link").otherwise("must_link").alias("disposition"), F.when((F.col("quality") == 0) & (d % 5 == 0), "type").otherwise("reviewed").alias("kind"))
    return candidates, documentary, pairs


def identity_dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.join_receipts(*_identities(spark, sf_dir)).select("mention_id", "fact_kind", "component", "n_documentary", "disposition", "referent")


def traversable_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's event and the one numbered next relate; both ends must have a referent."""
    receipts = identity.join_receipts(*_identities(spark, sf_dir))
    e = F.col("event_id")
    relations = table(spark, sf_dir, "events").select(e.alias("relation_id"), F.col("event_type").alias("edge_kind"), F.concat(F.lit("c"), e.cast("string")).alias("from_mention"), F.concat(F.lit("c"), (e + 1).cast("string")).alias("to_mention"), F.when(F.col("value") > 3, "resolved").otherwise("ambiguous").alias("status"))
    return identity.traversable(relations, receipts)


def graph_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven enumerators over orders, customers, suppliers and parts; the members of a slice as one digest."""
    nodes = star.nodes(spark, sf_dir).where("kind IN ('Order', 'Customer', 'Supplier', 'Part')").select("node_id")
    edges = written(star.edges(spark, sf_dir, ("member_of", "emits")).where("relation = 'member_of' OR src LIKE '%7'").select("relation", "src", "dst"))  # read by four steps
    part, customer = table(spark, sf_dir, "part"), table(spark, sf_dir, "customer")
    seed = lambda name, node, hops: F.struct(F.lit(name).alias("enumerator"), node.alias("primary"), node.alias("node"), F.lit(hops).alias("hops"))
    flows = edges.where("relation = 'emits'").select(F.col("dst").alias("node")).distinct().select(seed("E1-flow", F.col("node"), 1).alias("s"))
    closures = customer.select(seed("E2-closure", star.node_id("Customer", "c_custkey"), 2).alias("s"))
    hubs = slices.top_hubs(edges, nodes, 12).select(seed("E6-hub", F.col("node"), 1).alias("s"))
    group = lambda name, df, primary, node: df.select(F.lit(name).alias("enumerator"), primary.alias("primary"), node.alias("node"))
    groups = (
        group("E3-members", part, F.col("p_brand"), star.node_id("Part", "p_partkey")).union(group("E4-group", customer, F.col("c_nationkey").cast("string"), star.node_id("Customer", "c_custkey")))
        .union(group("E5-family", part, F.concat_ws("/", "p_brand", "p_type"), star.node_id("Part", "p_partkey"))).union(group("E7-component", slices.lesser_components(edges, nodes), F.col("primary"), F.col("node")))
    )
    judged, members = slices.enumerated(flows.union(closures).union(hubs).select("s.*"), groups, edges)
    listed = members.groupBy("enumerator", "primary").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("node")), " "), 256).alias("members"))  # a slice is bounded
    return judged.join(listed, ["enumerator", "primary"], "left").select("enumerator", "primary", F.when(F.col("disposition") != "over_projection_bound", F.col("n_members")).alias("n_members"), "disposition", "members")


QUERIES = {f.__name__: f for f in (call_bindings, entity_decisions, entity_relationships, obligation_states, claim_adjudication, identity_dispositions, traversable_relations, graph_slices)}

def _sql_noun(n: str, words: tuple[str, ...] = _NOUNS) -> str:
    return f"[{', '.join(repr(w) for w in words)}][(({n}) % {len(words)}) + 1]"


def _sql_table(n: str) -> str:
    return f"{_sql_noun(n)} || {_sql_noun(f'({n}) // 12', _ENDS)}"


def _one(x: str) -> str:
    return f"CASE WHEN {x} SIMILAR TO '.*(ss|us|is)' THEN {x} WHEN {x} LIKE '%ies' THEN left({x}, -3) || 'y' WHEN {x} SIMILAR TO '.*(ch|sh|x|s)es' THEN left({x}, -2) WHEN {x} LIKE '%s' THEN left({x}, -1) ELSE {x} END"


_PLUMBING = "regexp_matches({}, '(_summary|_log|_state|_new)$')"
_SCHEMA = f"""
    made AS (SELECT s_suppkey AS k, {_sql_table('s_suppkey')} AS t, 'f' || s_suppkey % 9 AS file FROM supplier), known AS (SELECT t, min(file) AS file FROM made GROUP BY t),
    keyed AS (SELECT DISTINCT t, unnest(CASE k % 3 WHEN 0 THEN [{_sql_noun('k')} || '_id'] WHEN 1 THEN [{_sql_noun('k')} || '_id', {_sql_noun('k + 1')} || '_id'] ELSE ['seq'] END) AS c FROM made),
    raw AS (SELECT {_sql_table('l_suppkey')} AS t, {_sql_noun('l_orderkey // 12', _ROLES)} || {_sql_noun('l_orderkey')} || '_id' AS c, l_returnflag = 'A' AS u, CASE WHEN l_tax > 0.05 THEN {_sql_table('l_partkey // 50')} END AS target FROM lineitem WHERE l_partkey % 50 = 0
        UNION ALL SELECT t, c, false, NULL FROM keyed WHERE c <> 'seq' UNION ALL SELECT t, 'item_id', false, NULL FROM made WHERE k % 4 = 0),
    cols AS (SELECT t, c, bool_or(u) AS u, min(target) AS target, left(c, -3) AS stem FROM raw WHERE t IN (SELECT t FROM known) GROUP BY t, c),
    enums AS (SELECT DISTINCT t, unnest([{_sql_noun('k')}, {_sql_noun('k + 3')} || 's', 'other']) AS v FROM made WHERE k % 4 = 0),
    kinds AS (SELECT CASE WHEN n_nationkey < 5 THEN {_sql_noun('n_nationkey')} WHEN n_nationkey < 8 THEN {_sql_noun('n_nationkey')} || 's' WHEN n_nationkey < 11 THEN 'client_' || {_sql_noun('n_nationkey')} ELSE 'ghost' || n_nationkey END AS kind FROM nation),
    signals AS (SELECT {_sql_noun('k')} AS e, count(DISTINCT k % 2) AS n FROM made WHERE k % 12 < 10 GROUP BY 1),
    pk AS (SELECT t, count(*) AS n_pk, min(c) AS key FROM keyed GROUP BY t),
    roots AS (SELECT e, coalesce(max(t) FILTER (WHERE NOT keyed), max(t)) AS root FROM (SELECT {_one('t')} AS e, t, false AS keyed FROM known
        UNION ALL SELECT {_one('left(key, -3)')}, t, true FROM pk WHERE n_pk = 1 AND key LIKE '%_id' AND {_one('left(key, -3)')} <> {_one('t')} AND list_contains(list_transform(string_split(t, '_'), lambda w: {_one('w')}), {_one('left(key, -3)')})) GROUP BY e),
    tails AS (SELECT t, c, i AS start, array_to_string(string_split(stem, '_')[i:], '_') AS tail FROM (SELECT *, unnest(range(1, len(string_split(stem, '_')) + 1)) AS i FROM cols)),
    refs AS (SELECT CASE WHEN e = 'bay' THEN 'berth' ELSE e END AS e, count(DISTINCT t) >= 2 AND count(DISTINCT file) >= 2 AS often FROM (SELECT {_one('tail')} AS e, t, file FROM tails JOIN known USING (t)) GROUP BY 1),
    shipped AS (SELECT DISTINCT {_one('kind')} AS e, true AS has_kind FROM kinds),
    weighed AS (SELECT e, root, coalesce({_PLUMBING.format('root')}, false) AS plumbing, coalesce(often, false) AS often, coalesce(has_kind, false) AS has_kind, coalesce(n, 0) + CASE WHEN has_kind THEN 1 ELSE 0 END AS n_sources
        FROM roots FULL JOIN refs USING (e) FULL JOIN shipped USING (e) LEFT JOIN signals USING (e)),
    decisions AS (SELECT e, CASE WHEN NOT plumbing THEN root END AS root, CASE WHEN root IS NOT NULL AND NOT plumbing THEN 'root_table' WHEN often THEN 'referenced_id' END AS evidence, has_kind, n_sources,
        CASE WHEN plumbing AND NOT often THEN 'read_model_or_infrastructure_table' WHEN (root IS NULL OR plumbing) AND NOT often THEN CASE WHEN has_kind THEN 'model_kind_without_schema_evidence' ELSE 'insufficient_schema_evidence' END
            WHEN n_sources = 0 THEN 'single_source_uncorroborated' END AS refusal FROM weighed),
    good AS (SELECT e, root FROM decisions WHERE refusal IS NULL)"""
_PROJECTED = f"CASE WHEN {{0}} LIKE '%_summary' THEN {_one('left({0}, -8)')} END"

_PATH_SQL = "'r' || ({0}) % 7 || '/d' || ({0}) % 40 || '/' || ({0})"
_OBLIGATIONS = f"""
    files AS (SELECT {_PATH_SQL.format('doc_id')} AS path, 'r' || doc_id % 7 || '/d' || doc_id % 40 AS folder, coalesce(text, '') AS text FROM documents), sym AS (SELECT p_name, p_brand, p_type FROM part WHERE p_partkey % 5 <> 0),
    o AS (SELECT row_number() OVER () AS row, * FROM (SELECT DISTINCT l_orderkey AS claim_id, l_partkey AS k, l_quantity::BIGINT AS n, l_linenumber AS j, p_name, p_brand, p_type FROM lineitem JOIN part ON l_partkey = p_partkey)),
    o1 AS (SELECT row, claim_id, n % 4 <> 0 AS one, count(s.p_name) AS found FROM o LEFT JOIN sym s ON n <> 1 AND s.p_name = o.p_name AND (k % 2 <> 0 OR s.p_brand = o.p_brand) AND (k % 3 <> 0 OR s.p_type = o.p_type) WHERE j = 1 GROUP BY ALL),
    o2 AS (SELECT claim_id, text IS NULL OR n % 6 = 0 OR k % 4 = 3 AS lost, coalesce(contains(string_split(text, chr(10))[n % 6], ['e', 'zq', 'the', ''][k % 4 + 1]), false) AS held FROM o LEFT JOIN files ON path = {_PATH_SQL.format('k')} WHERE j = 2),
    o3 AS (SELECT row, claim_id, 'r' || k % 7 || '/d' || k % 40 AS folder, k % 280 + i * 280 AS doc FROM (SELECT *, unnest(range(0, n % 5 + 1)) AS i FROM o WHERE j = 3)),
    m3 AS (SELECT row, claim_id, o3.folder, count(*) AS n, count(*) FILTER (WHERE f.folder = o3.folder) AS met FROM o3 LEFT JOIN files f ON path = {_PATH_SQL.format('doc')} GROUP BY ALL),
    o4 AS (SELECT claim_id, (a.path IS NOT NULL)::INT + (b.path IS NOT NULL)::INT AS there FROM o LEFT JOIN files a ON a.path = {_PATH_SQL.format('k')} LEFT JOIN files b ON b.path = {_PATH_SQL.format('k + 1')} WHERE j = 4),
    o5 AS (SELECT claim_id, a.text IS NULL OR b.text IS NULL AS lost, coalesce(contains(a.text, 'qqq')::INT + contains(a.text, 'w' || n % 10)::INT, 0) + coalesce(contains(b.text, 'qqq')::INT + contains(b.text, 'w' || n % 10)::INT, 0) AS hits
        FROM o LEFT JOIN files a ON a.path = {_PATH_SQL.format('k')} LEFT JOIN files b ON b.path = {_PATH_SQL.format('k + 1')} WHERE j = 5),
    runs AS (SELECT event_id // 20 % 400 AS c, bool_and(event_type <> 'error' AND value > 5) AS passed, bool_or(user_id % 30 = 0) AS broken FROM events WHERE event_id % 20 = 0 GROUP BY 1),
    o6 AS (SELECT claim_id, passed, broken FROM o LEFT JOIN runs ON c = k % 300 WHERE j = 6),
    results AS (SELECT claim_id, 'code_symbol_declared' AS kind, CASE WHEN found = 0 THEN 'refuted' WHEN one AND found > 1 THEN 'underdetermined' ELSE 'supported' END AS state, found AS n_evidence FROM o1
        UNION ALL SELECT claim_id, 'source_text_present', CASE WHEN lost THEN 'unverifiable' WHEN held THEN 'supported' ELSE 'refuted' END, held::INT FROM o2
        UNION ALL SELECT claim_id, 'tree_paths_exact', CASE WHEN (SELECT count(*) FROM files f WHERE f.folder = m3.folder) = met AND n = met THEN 'supported' ELSE 'refuted' END, met FROM m3
        UNION ALL SELECT claim_id, 'tree_paths_present', CASE there WHEN 2 THEN 'supported' ELSE 'refuted' END, there FROM o4
        UNION ALL SELECT claim_id, 'tree_text_absent', CASE WHEN lost THEN 'unverifiable' WHEN hits > 0 THEN 'refuted' ELSE 'supported' END, hits FROM o5
        UNION ALL SELECT claim_id, 'verification_check_passed', CASE WHEN coalesce(broken, true) THEN 'unverifiable' WHEN passed THEN 'supported' ELSE 'refuted' END, (passed IS NOT NULL)::INT FROM o6
        UNION ALL SELECT claim_id, 'open_question', 'underdetermined', 0 FROM o WHERE j = 7)"""
_IDENTITY = """
    cand AS (SELECT 'c' || event_id AS id, event_type AS fact_kind, CASE WHEN event_id % 101 <> 0 THEN user_id || '/' || event_type || '/' || floor(value / 4)::BIGINT END AS basis, event_id % 200 AS file, event_id // 200 % 60 AS line FROM events),
    doc AS (SELECT 'd' || doc_id AS id, doc_id % 200 AS file, doc_id // 200 AS line, ['click', 'view', 'purchase', 'signup', 'error'][doc_id % 5 + 1] AS surface FROM documents
        UNION ALL SELECT 'e' || doc_id, doc_id % 200, doc_id // 200, ['click', 'view', 'purchase', 'signup', 'error'][doc_id % 5 + 1] FROM documents WHERE doc_id % 40 = 0),
    cons AS (SELECT 'd' || doc_id AS l, 'd' || (doc_id - doc_id % 7) AS r, CASE WHEN toxic = 1 THEN 'cannot_link' ELSE 'must_link' END AS disposition, quality = 0 AND doc_id % 5 = 0 AS typed FROM labels),
    places AS (SELECT c.id AS cid, c.basis, count(*) AS n, min(d.id) AS did FROM cand c JOIN doc d ON c.file = d.file AND c.line = d.line AND c.fact_kind = d.surface GROUP BY ALL),
    links AS (SELECT id AS a, min(id) OVER (PARTITION BY basis) AS b FROM cand WHERE basis IS NOT NULL UNION ALL SELECT cid, did FROM places WHERE n = 1 AND basis IS NOT NULL UNION ALL SELECT l, r FROM cons WHERE disposition = 'must_link'),
    both_ways AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) WHERE a <> b),
    walk AS (SELECT a AS x, b AS y FROM both_ways UNION SELECT x, b FROM walk JOIN both_ways ON y = a),
    least AS (SELECT x, least(x, min(y)) AS component FROM walk GROUP BY x),
    members AS (SELECT id, code, coalesce(component, id) AS component FROM (SELECT id, true AS code FROM cand WHERE basis IS NOT NULL UNION SELECT id, false FROM doc) LEFT JOIN least ON id = x),
    barred AS (SELECT DISTINCT a.component FROM cons JOIN members a ON l = a.id JOIN members b ON r = b.id WHERE (disposition <> 'must_link' OR typed) AND a.component = b.component),
    counts AS (SELECT component, count(*) FILTER (WHERE NOT code) AS n_documentary FROM members GROUP BY component),
    settled AS (SELECT c.id AS mention_id, fact_kind, component, coalesce(n_documentary, 0) AS n_documentary, CASE WHEN component IN (SELECT component FROM barred) THEN 'cannot_link'
            WHEN component IS NULL OR c.id IN (SELECT cid FROM places WHERE n > 1) THEN 'terminal_incomplete' WHEN n_documentary > 0 THEN 'joined' ELSE 'unresolved' END AS disposition FROM cand c LEFT JOIN members m ON c.id = m.id LEFT JOIN counts USING (component)),
    receipts AS (SELECT *, CASE WHEN disposition = 'joined' THEN component END AS referent FROM settled)"""

ORACLE_SQL = {
    "entity_decisions": f"""WITH {_SCHEMA}, owners AS (SELECT root AS t, max(e) AS entity FROM good WHERE root IS NOT NULL GROUP BY root)
        SELECT 'candidate' AS family, e AS entity, root AS root_table, evidence, n_sources, refusal FROM decisions
        UNION ALL SELECT 'table', entity, t, NULL, 0, CASE WHEN entity IS NOT NULL THEN NULL WHEN {_PLUMBING.format('t')} THEN 'read_model_or_infrastructure_table' ELSE coalesce(refusal, 'table_superseded_by_other_root_table') END
            FROM known LEFT JOIN owners USING (t) LEFT JOIN decisions ON e = {_one('t')}""",
    "entity_relationships": f"""WITH {_SCHEMA},
        subj AS (SELECT t, coalesce(n_pk, 0) AS n_pk, CASE WHEN a.root = t THEN a.e WHEN b.e IS NOT NULL THEN b.e ELSE c.e END AS subject, coalesce(a.root <> t, true) AND b.e IS NULL AND c.e IS NOT NULL AS weak
            FROM known LEFT JOIN pk USING (t) LEFT JOIN good a ON a.e = {_one('t')} LEFT JOIN good b ON n_pk = 1 AND b.e = {_one("regexp_replace(key, '_id$', '')")} LEFT JOIN good c ON c.e = {_PROJECTED.format('t')}),
        met AS (SELECT t, c, start, e, 0 AS via_alias FROM tails JOIN good ON e = tail UNION ALL SELECT t, c, start, e, 1 FROM tails JOIN good ON tail = 'bay' AND e = 'berth'),
        named AS (SELECT t, c, e, nullif(array_to_string(string_split(left(c, -3), '_')[:start - 1], '_'), '') AS role FROM (SELECT *, row_number() OVER (PARTITION BY t, c ORDER BY start, via_alias) AS nth FROM met) WHERE nth = 1),
        pointed AS (SELECT x.t, c, coalesce(a.e, b.e) AS declared FROM cols x JOIN known k ON target = k.t LEFT JOIN good a ON a.e = {_one('target')} LEFT JOIN good b ON b.e = {_PROJECTED.format('target')}),
        r AS (SELECT t, c, u, target IS NOT NULL AS is_declared, coalesce(declared, n.e) AS e, CASE WHEN declared IS NOT NULL THEN nullif(regexp_replace(regexp_replace(c, '_?id$', ''), '_?' || declared || '$', ''), '') ELSE role END AS role,
            (t, c) IN (SELECT t, c FROM keyed) AS in_pk, n_pk, subject, weak FROM cols LEFT JOIN named n USING (t, c) LEFT JOIN pointed USING (t, c) JOIN subj USING (t)),
        heads AS (SELECT t, min(c) AS head, arg_min(e, c) AS head_e, arg_min(u, c) AS head_u FROM r WHERE subject IS NULL AND e IS NOT NULL AND in_pk GROUP BY t),
        anchors AS (SELECT t, min(e) AS e FROM named WHERE c <> 'item_id' AND t IN (SELECT t FROM enums) GROUP BY t HAVING count(*) = 1),
        every AS (SELECT e AS f, subject AS g, CASE WHEN u THEN 'has_one' ELSE 'has_many' END AS relation, CASE WHEN u THEN '1..1' ELSE '1..N' END AS card, t || '.' || c AS via, CASE WHEN is_declared THEN 'declared_foreign_key' ELSE 'fk_shaped_column' END AS basis,
                CASE WHEN is_declared THEN 'schema_declared' WHEN weak THEN 'read_model_evidence' ELSE 'shape_only' END AS status, 1 AS turn FROM r WHERE e IS NOT NULL AND subject IS NOT NULL AND NOT (e = subject AND role IS NULL)
            UNION ALL SELECT e, head_e, CASE WHEN n_pk > 1 AND in_pk THEN 'relates_to' WHEN head_u THEN 'has_one' ELSE 'has_many' END, CASE WHEN n_pk > 1 AND in_pk THEN 'N..N' WHEN head_u THEN '1..1' ELSE '1..N' END, t || '.' || c,
                CASE WHEN is_declared THEN 'declared_foreign_key' ELSE 'link_table' END, CASE WHEN is_declared THEN 'schema_declared' ELSE 'shape_only' END, 2 FROM r JOIN heads USING (t) WHERE subject IS NULL AND e IS NOT NULL AND c <> head
            UNION ALL SELECT DISTINCT a.e, g.e, 'relates_to', 'N..N', t || '.item_id', 'polymorphic_check_enum', 'schema_declared', 3 FROM enums JOIN anchors a USING (t) JOIN good g ON g.e = CASE WHEN v IN (SELECT e FROM good) THEN v ELSE {_one('v')} END WHERE t NOT LIKE '%_new' AND a.e <> g.e),
        rel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY f, g, relation, via ORDER BY turn) AS nth FROM every WHERE NOT (f = g AND relation = 'has_one')) WHERE nth = 1),
        ends AS (SELECT kind, i, array_to_string(string_split(kind, '_')[i:], '_') AS tail FROM (SELECT *, unnest(range(2, len(string_split(kind, '_')) + 1)) AS i FROM kinds))
        SELECT 'relationship' AS family, via, concat_ws(' ', f, relation, g, card) AS about, basis || ' ' || status AS reason FROM rel
        UNION ALL SELECT 'refusal', t || '.' || c, '', CASE WHEN c LIKE '%_item_id' OR c = 'item_id' THEN 'polymorphic_reference_not_resolvable_from_schema' ELSE 'id_column_names_no_promoted_entity' END FROM r
            WHERE e IS NULL AND NOT in_pk AND (subject IS NOT NULL OR c LIKE '%_item_id' OR c = 'item_id')
        UNION ALL SELECT DISTINCT 'refusal', t, '', 'detail_table_without_entity_subject' FROM r WHERE subject IS NULL AND e IS NOT NULL AND t NOT IN (SELECT t FROM heads)
        UNION ALL SELECT 'conflict', kind, {_one('kind')}, 'entity_name_disagreement' FROM kinds WHERE {_one('kind')} <> kind AND {_one('kind')} IN (SELECT e FROM good)
        UNION ALL SELECT 'conflict', kind, arg_min({_one('tail')}, i), 'entity_name_disagreement' FROM ends WHERE {_one('tail')} IN (SELECT e FROM good) AND {_one('kind')} NOT IN (SELECT e FROM good) GROUP BY kind
        UNION ALL SELECT 'conflict', e, e, 'model_declares_entity_schema_has_no_table' FROM decisions WHERE refusal = 'model_kind_without_schema_evidence'
        UNION ALL SELECT 'conflict', e, e, 'schema_declares_entity_model_has_no_kind' FROM decisions WHERE refusal IS NULL AND NOT has_kind AND e NOT IN (SELECT tail FROM ends)
        UNION ALL SELECT 'conflict', via, f, 'schema_relationship_has_no_model_edge_kind' FROM rel WHERE f = g AND regexp_matches(via, 'spawn|lineage|parent|child') AND via NOT LIKE '%spawned%'""",
    "call_bindings": """WITH s AS (SELECT 'm/' || l_suppkey % 7 || '/f' || l_suppkey || '.js' AS file, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS day, 'n' || l_partkey % 60 AS name, l_orderkey || ':' || l_linenumber AS site, row_number() OVER () AS row, * FROM lineitem),
        d AS (SELECT *, CASE l_linenumber WHEN 1 THEN 3600 WHEN 2 THEN 360 ELSE 30 END AS width, CASE l_partkey % 4 WHEN 0 THEN 'import' WHEN 1 THEN 'non_function' ELSE 'function' END AS kind, l_orderkey % 100 + 1 AS other FROM s WHERE l_linenumber <= 3),
        b AS (SELECT file, width, day // width * width AS opened, name, kind, site, kind = 'function' AND l_quantity < 10 AS var, kind = 'function' AND l_quantity >= 10 AS fun, l_tax > 0.04 AS valued, l_linenumber,
            CASE WHEN kind = 'import' AND l_orderkey % 5 <> 0 THEN 'm/' || other % 7 || '/f' || other || '.js' END AS module, CASE WHEN kind = 'import' THEN CASE WHEN l_quantity > 45 THEN '*' ELSE 'n' || l_orderkey % 60 END END AS imported,
            CASE WHEN kind = 'import' THEN CASE WHEN l_orderkey % 5 = 0 THEN 'package' ELSE '../' || other % 7 || '/./f' || other || CASE WHEN l_orderkey % 3 = 0 THEN '.js' ELSE '' END END END AS specifier FROM d),
        w AS (SELECT *, bool_or(var) OVER k AND bool_or(fun) OVER k AS mixed, bool_or(var AND valued) OVER k AS filled FROM b WINDOW k AS (PARTITION BY file, width, opened, name)),
        kept AS (SELECT *, mixed AND filled AS spoiled FROM w WHERE NOT (mixed AND NOT filled AND var)),
        said AS (SELECT file, width, opened, name, count(*) AS n, min(kind) AS kind, min(specifier) AS specifier, min(imported) AS imported, bool_or(spoiled) AS spoiled, min(site) FILTER (WHERE kind = 'function') AS declaration, least(25, count(DISTINCT site) FILTER (WHERE kind = 'function')) AS n_declared FROM kept GROUP BY ALL),
        named AS (SELECT DISTINCT specifier, module FROM b WHERE specifier IS NOT NULL),
        m AS (SELECT *, CASE WHEN l_tax > 0.06 THEN 'commonjs' ELSE 'assigned' END AS mark FROM s WHERE l_linenumber = 4 AND l_returnflag = 'R'),
        met AS (SELECT m.*, width, opened, row_number() OVER (PARTITION BY m.row ORDER BY width) AS nth FROM m JOIN said USING (file, name) WHERE opened <= day AND day < opened + width),
        marked AS (SELECT file, width, opened, name, bool_or(mark = 'assigned') AS marked, bool_or(mark = 'commonjs') AS common FROM met WHERE nth = 1 GROUP BY ALL),
        full_said AS (SELECT said.*, spoiled OR coalesce(marked, false) AS assigned, coalesce(common, false) AS common FROM said LEFT JOIN marked USING (file, width, opened, name)),
        x AS (SELECT k.file AS module, k.name AS imported, count(DISTINCT k.site) AS n_exported, min(k.site) AS exported, bool_or(f.assigned) AS x_assigned FROM b k JOIN full_said f USING (file, width, opened, name)
            WHERE k.kind = 'function' AND (k.file, k.name) IN (SELECT file, name FROM b WHERE kind = 'function' AND l_linenumber = 1) GROUP BY ALL),
        c AS (SELECT file, day, row, name, ['identifier', 'identifier', 'identifier', 'identifier', 'identifier', 'identifier', 'member', 'subscript', 'new', 'call'][l_orderkey % 10 + 1] AS callee, l_suppkey FROM s WHERE l_linenumber >= 5),
        p AS (SELECT * FROM (SELECT c.*, f.* EXCLUDE (file, name), row_number() OVER (PARTITION BY row ORDER BY width) AS nth FROM c LEFT JOIN full_said f ON c.file = f.file AND c.name = f.name AND opened <= day AND day < opened + width) WHERE nth = 1),
        q AS (SELECT p.*, named.module, x.n_exported, x.exported, x.x_assigned, split_part(split_part(named.module, '/f', 2), '.', 1)::INT AS far FROM p LEFT JOIN named USING (specifier) LEFT JOIN x ON named.module = x.module AND p.imported = x.imported),
        r AS (SELECT *, CASE WHEN l_suppkey % 23 = 0 THEN CASE callee WHEN 'new' THEN 'new_expression' ELSE 'unsupported_grammar' END WHEN l_suppkey % 19 = 0 THEN 'parse_failed' WHEN callee = 'new' THEN 'new_expression' WHEN callee = 'subscript' THEN 'computed_member'
            WHEN callee = 'member' THEN CASE WHEN kind = 'import' AND imported = '*' THEN 'namespace_import' WHEN common THEN 'commonjs_interop' ELSE 'method_call_on_local' END WHEN callee = 'call' THEN 'dynamic_dispatch'
            WHEN n IS NULL THEN 'unbound_identifier' WHEN assigned THEN 'assigned_binding' WHEN common THEN 'commonjs_interop' WHEN n > 1 THEN NULL WHEN kind = 'non_function' THEN 'shadowed_by_non_function_binding'
            WHEN kind = 'import' THEN CASE WHEN imported = '*' THEN 'namespace_import' WHEN module IS NULL OR module NOT IN (SELECT file FROM s) THEN 'external_module' WHEN far % 23 = 0 THEN 'unsupported_grammar' WHEN far % 17 = 0 THEN 're_export_chain'
                WHEN x_assigned THEN 'assigned_binding' WHEN n_exported IS NULL THEN 'unbound_identifier' END END AS reason FROM q),
        t AS (SELECT *, CASE WHEN reason IS NOT NULL THEN 'unresolved' WHEN n > 1 OR kind = 'import' AND n_exported > 1 THEN 'ambiguous' ELSE 'resolved' END AS status FROM r)
        SELECT file, status, coalesce(reason, '') AS reason, count(*) AS n, count(DISTINCT CASE WHEN status = 'resolved' THEN CASE WHEN kind = 'import' THEN exported ELSE declaration END END) AS n_declarations,
            sum(CASE WHEN status = 'ambiguous' THEN CASE WHEN n = 1 THEN least(25, n_exported) ELSE coalesce(n_declared, 0) END ELSE 0 END)::BIGINT AS n_candidates FROM t GROUP BY ALL""",
    "obligation_states": f"WITH {_OBLIGATIONS} SELECT kind, state, count(*) AS n, sum(n_evidence)::BIGINT AS n_evidence FROM results GROUP BY kind, state",
    "claim_adjudication": f"""WITH {_OBLIGATIONS}, c AS (SELECT claim_id, bool_or(state = 'refuted') AS r, bool_or(state = 'unverifiable') AS v, bool_or(state = 'underdetermined') AS u, count(*) AS n_results,
            bool_or(state = 'supported' AND kind = 'verification_check_passed') AS executed, bool_or(state = 'supported' AND (kind LIKE 'tree%' OR kind = 'code_symbol_declared')) AS declared FROM results GROUP BY claim_id),
        w AS (SELECT o_orderkey AS claim_id, o_custkey % 4 AS k, c.* EXCLUDE (claim_id), CASE WHEN r THEN 'refuted' WHEN v THEN 'unverifiable' WHEN u OR r IS NULL THEN 'underdetermined' ELSE 'supported' END AS verdict FROM orders LEFT JOIN c ON o_orderkey = c.claim_id)
        SELECT claim_id, verdict, CASE WHEN verdict IN ('underdetermined', 'unverifiable') THEN 'unknown' WHEN k = 1 THEN CASE verdict WHEN 'supported' THEN 'not_started' ELSE 'diverged' END
            WHEN k = 2 THEN CASE WHEN verdict = 'refuted' THEN 'diverged' WHEN executed OR declared THEN 'unknown' ELSE 'removed' END WHEN verdict = 'refuted' THEN CASE k WHEN 0 THEN 'not_started' ELSE 'diverged' END
            WHEN executed THEN 'implemented' WHEN declared THEN 'partial' ELSE 'unknown' END AS realization, coalesce(n_results, 0) AS n_results FROM w""",
    "identity_dispositions": f"WITH RECURSIVE {_IDENTITY} SELECT * FROM receipts",
    "traversable_relations": f"""WITH RECURSIVE {_IDENTITY} SELECT event_id AS relation_id, event_type AS edge_kind, a.referent AS from_referent, b.referent AS to_referent
        FROM events JOIN receipts a ON a.mention_id = 'c' || event_id JOIN receipts b ON b.mention_id = 'c' || (event_id + 1) WHERE value > 3 AND a.referent IS NOT NULL AND b.referent IS NOT NULL""",
    "graph_slices": f"""WITH RECURSIVE {GRAPH_SQL}, n AS (SELECT node_id AS node FROM nodes WHERE kind IN ('Order', 'Customer', 'Supplier', 'Part')),
            e AS (SELECT src, dst, relation FROM edges WHERE relation = 'member_of' OR relation = 'emits' AND src LIKE '%7'), l AS (SELECT src AS node, dst AS other FROM e UNION SELECT dst, src FROM e),
            hubs AS (SELECT node FROM n LEFT JOIN l USING (node) GROUP BY node ORDER BY count(other) DESC, node LIMIT 12),
            hop1 AS (SELECT node AS seed, node FROM n UNION SELECT node, other FROM l), hop2 AS (SELECT seed, node FROM hop1 WHERE seed LIKE 'customer:%' UNION SELECT seed, other FROM hop1 JOIN l USING (node) WHERE seed LIKE 'customer:%'),
            small_links AS (SELECT * FROM l WHERE node NOT IN (SELECT node FROM l GROUP BY node HAVING count(*) > 1000)),
            reach AS (SELECT node, other FROM l WHERE node LIKE 'customer:%' OR other LIKE 'customer:%' UNION SELECT r.node, l.other FROM reach r JOIN l ON r.other = l.node),
            customers AS (SELECT node, least(node, min(other)) AS component FROM reach GROUP BY node), sold AS (SELECT DISTINCT node FROM l WHERE node LIKE 'part:%' OR node LIKE 'supplier:%'),
            components AS (SELECT node, coalesce(component, CASE WHEN s.node IS NOT NULL THEN (SELECT min(node) FROM sold) END, node) AS primary_ FROM n LEFT JOIN customers USING (node) LEFT JOIN sold s USING (node)),
            giant AS (SELECT primary_ FROM components GROUP BY primary_ ORDER BY count(*) DESC, primary_ LIMIT 1),
            m AS (SELECT 'E1-flow' AS enumerator, seed AS primary_, node FROM hop1 WHERE seed IN (SELECT dst FROM e WHERE relation = 'emits') UNION ALL SELECT 'E2-closure', seed, node FROM hop2 UNION ALL SELECT 'E6-hub', seed, node FROM hop1 WHERE seed IN (SELECT node FROM hubs)
                UNION ALL SELECT 'E3-members', p_brand, 'part:' || p_partkey FROM part UNION ALL SELECT 'E4-group', cast(c_nationkey AS VARCHAR), 'customer:' || c_custkey FROM customer UNION ALL SELECT 'E5-family', p_brand || '/' || p_type, 'part:' || p_partkey FROM part
                UNION ALL SELECT 'E7-component', primary_, node FROM components WHERE primary_ NOT IN (SELECT primary_ FROM giant)),
            s AS (SELECT enumerator, primary_, count(*) AS k, CASE WHEN count(*) <= 80 THEN string_agg(node, ' ' ORDER BY node) END AS listed FROM m GROUP BY ALL),
            d AS (SELECT *, row_number() OVER (PARTITION BY listed ORDER BY enumerator, primary_) AS nth FROM s),
            j AS (SELECT enumerator, primary_, k, listed, CASE WHEN k > 80 THEN 'over_projection_bound' WHEN k < 4 THEN 'below_minimum_members' WHEN nth > 1 THEN 'duplicate_member_set' ELSE 'slice' END AS disposition FROM d)
        SELECT enumerator, primary_ AS "primary", CASE WHEN k <= 80 THEN k END AS n_members, disposition, CASE disposition WHEN 'slice' THEN sha256(listed) END AS members FROM j""",
}
