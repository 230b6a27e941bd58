"""Ledgers, snapshots and bindings over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions import text
from lodegraph.operators import binding, documents, ledgers
from lodegraph.sources.star import table

CUT = "o_orderdate < TIMESTAMP '1997-01-01 00:00:00'"


def refusal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose orders are pending are refused; one with an open order in the new half is derived."""
    orders = table(spark, sf_dir, "orders").withColumn("observed", F.date_format("o_orderdate", "yyyy-MM-dd"))
    pending = orders.where("o_orderstatus = 'P'")
    return ledgers.reconciled(pending.where(CUT), pending.where(f"NOT {CUT}"), orders.where(f"o_orderstatus = 'O' AND NOT {CUT}"), "o_custkey", "observed")


def turn_ledgers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turns of conversations as earlier ledgers, all turns but those of the system as later ones."""
    turns = table(spark, sf_dir, "conversations")
    return ledgers.append_only(turns.where("turn < 4"), turns.where("role <> 'system'"), "conv_id", "turn", "text")


def order_class_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return ledgers.shared_keys({"large": orders.where("o_totalprice > 400000"), "open": orders.where("o_orderstatus = 'O'"), "urgent": orders.where("o_orderpriority = '1-URGENT'")}, "o_orderkey")


def windows_conserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents against the windows that are cut from them."""
    docs = table(spark, sf_dir, "documents")
    return ledgers.window_conservation(documents.numbered_lines(docs), documents.byte_windows(docs, 2048), "doc_id", "line", "line", "line_end")


def canon_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large parts are documented; parts of large lines are seen."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("name"))
    seen = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select("l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return ledgers.canon(seen, parts.where("p_size > 45"), "name")


def replacement_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders replace a near order, as the customer's number says."""
    step = F.col("o_custkey") % 8
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.when(step != 0, F.col("o_orderkey") - step + 2).alias("replaces"))
    return ledgers.replacement_faults(orders, "o_orderkey", "replaces")


def claim_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.claim_status(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderdate", F.col("o_orderstatus") == "O")


def answer_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document takes the label of a labelled document of the same text: not toxic ones first, then by id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    journals = table(spark, sf_dir, "labels").join(docs, "doc_id")
    return ledgers.answer_plan(docs, journals, "doc_id", "digest", "quality", ["toxic", "doc_id", "quality"])


def event_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledgers.latest_outcomes(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")


def active_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per language that no good label resolves."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return ledgers.active_vector(docs, docs.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi"), "lang", "doc_id")


def label_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents bound to a labelled one: itself, else one of the same text, else one of the same source."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest"))
    labelled = docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("label_id"), "source", "digest")
    return binding.resolve_in_order(docs, "doc_id", [("own", "doc_id", labelled, "label_id", "label_id"), ("copy", "digest", labelled, "label_id", "digest"), ("source", "source", labelled, "label_id", "source")])


def alias_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages under their site's aliases: some exact, one per first segment, one per first segment and last character."""
    pages = table(spark, sf_dir, "pages").select("page_id", text.url_host(F.col("url")).alias("scope"), F.substring(text.url_path(F.col("url")), 2, 1 << 20).alias("name")).where("name <> ''")
    head = F.split("name", "/")[0]
    exact = pages.where("page_id % 10 = 0").select("scope", F.col("name").alias("pattern"), F.concat(F.lit("exact/"), "name").alias("target"))
    wide = pages.select("scope", F.concat(head, F.lit("/*")).alias("pattern"), F.lit("src/*").alias("target"))
    ends = pages.where("page_id % 3 = 0").select("scope", F.concat(head, F.lit("/*"), F.right(F.col("name"), F.lit(1))).alias("pattern"), F.lit("end/*.x").alias("target"))
    return binding.alias_targets(pages.select(F.col("page_id").alias("ref_id"), "scope", "name"), exact.union(wide).union(ends).distinct())


def package_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by the package that their address would import."""
    pages = table(spark, sf_dir, "pages").select(binding.package_root(F.concat(text.url_host(F.col("url")), text.url_path(F.col("url")))).alias("package"))
    return pages.groupBy("package").agg(F.count(F.lit(1)).alias("n_pages"))


def part_wiring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts are declared by brand and bound by lines of full quantity; brands with a part of the largest size can't be read whole."""
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size")
    bound = table(spark, sf_dir, "lineitem").where("l_quantity >= 50").select("l_partkey").distinct().join(parts, F.col("l_partkey") == F.col("p_partkey")).select("p_brand", "p_partkey")
    return binding.wiring(parts, bound, parts.where("p_size = 50"), "p_brand", "p_partkey").groupBy("p_brand", "state").agg(F.count(F.lit(1)).alias("n"))


def anchor_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as anchors against the labelled documents of their source: the language is the pin, the length the path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("scope"), F.col("lang").alias("pin"), F.col("n_chars").alias("path"), F.sha2("text", 256).alias("blob"))
    return binding.bound_by_content(docs, docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi"), "doc_id")


QUERIES = {f.__name__: f for f in (
    refusal_states, turn_ledgers, order_class_overlaps, windows_conserved, canon_states, replacement_faults, claim_statuses, answer_reuse, event_verdicts, active_items,
    label_bases, alias_paths, package_roots, part_wiring, anchor_states,
)}

_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)"
_BARE = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*', '')"
_PATH = f"CASE WHEN length({_BARE}) > 1 THEN regexp_replace({_BARE}, '/+$', '') ELSE '/' END"
_DIGESTS = "docs AS (SELECT doc_id, source, lang, n_chars, sha256(text) AS digest FROM documents), held AS (SELECT * FROM docs WHERE doc_id IN (SELECT doc_id FROM labels))"

ORACLE_SQL = {
    "refusal_states": f"""
        WITH o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d, {CUT} AS old FROM orders),
        was AS (SELECT o_custkey, min(d) AS w FROM o WHERE o_orderstatus = 'P' AND old GROUP BY 1), cur AS (SELECT o_custkey, min(d) AS c FROM o WHERE o_orderstatus = 'P' AND NOT old GROUP BY 1)
        SELECT o_custkey, CASE WHEN c IS NOT NULL THEN 'refused' WHEN o_custkey IN (SELECT o_custkey FROM o WHERE o_orderstatus = 'O' AND NOT old) THEN 'superseded_by_derivation' ELSE 'withdrawn' END AS state, coalesce(w, c) AS first_observed
        FROM was FULL JOIN cur USING (o_custkey)""",
    "turn_ledgers": """
        WITH p AS (SELECT conv_id, turn, text AS was, 1 AS p FROM conversations WHERE turn < 4), f AS (SELECT conv_id, turn, text AS cur, 1 AS f FROM conversations WHERE role <> 'system')
        SELECT conv_id, count(p) AS n_previous, count(*) FILTER (p IS NULL) AS n_added, count(*) FILTER (p = 1 AND (f IS NULL OR was IS DISTINCT FROM cur)) AS n_broken,
               count(*) FILTER (p = 1 AND (f IS NULL OR was IS DISTINCT FROM cur)) = 0 AND coalesce(min(turn) FILTER (p IS NULL) > max(turn) FILTER (p = 1), true) AS append_only
        FROM p FULL JOIN f USING (conv_id, turn) GROUP BY conv_id""",
    "order_class_overlaps": """
        SELECT o_orderkey, string_agg(class, ',' ORDER BY class) AS classes FROM (
            SELECT DISTINCT o_orderkey, 'large' AS class FROM orders WHERE o_totalprice > 400000 UNION ALL SELECT DISTINCT o_orderkey, 'open' FROM orders WHERE o_orderstatus = 'O'
            UNION ALL SELECT DISTINCT o_orderkey, 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT') GROUP BY 1 HAVING count(*) > 1""",
    "windows_conserved": "SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n_blocks, 0::BIGINT AS n_missing, 0::BIGINT AS n_doubled, 0::BIGINT AS n_foreign, true AS conserved FROM documents",
    "canon_states": f"""
        WITH p AS (SELECT p_partkey, p_size, {_SLUG.format("p_name || ' ' || p_brand || ' ' || p_type")} AS entity FROM part), f AS (SELECT entity, count(*) AS w FROM lineitem JOIN p ON l_partkey = p_partkey WHERE l_quantity >= 49 GROUP BY 1),
        d AS (SELECT DISTINCT entity, 1 AS d FROM p WHERE p_size > 45)
        SELECT entity, CASE WHEN d IS NULL THEN 'discovered_undocumented' WHEN w IS NULL THEN 'documented_unwitnessed' ELSE 'matched' END AS state, coalesce(w, 0) AS n_witnesses FROM f FULL JOIN d USING (entity)""",
    "replacement_faults": """
        WITH RECURSIVE l AS (SELECT o_orderkey AS k, o_orderkey - o_custkey % 8 + 2 AS t FROM orders WHERE o_custkey % 8 <> 0),
        w(k, x) AS (SELECT k, t FROM l UNION SELECT w.k, l.t FROM w JOIN l ON w.x = l.k)
        SELECT k AS o_orderkey, 'missing' AS fault FROM l WHERE t NOT IN (SELECT o_orderkey FROM orders)
        UNION ALL SELECT k, 'fork' FROM l WHERE t IN (SELECT t FROM l GROUP BY t HAVING count(*) > 1)
        UNION ALL SELECT k, 'endless' FROM w GROUP BY k HAVING bool_and(x IN (SELECT k FROM l))""",
    "claim_statuses": """
        SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'current' ELSE 'historical' END AS status, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS first_version, count(*) AS n_versions FROM orders GROUP BY 1""",
    "answer_reuse": f"""
        WITH {_DIGESTS}, j AS (SELECT digest, first(quality ORDER BY toxic NULLS FIRST, doc_id NULLS FIRST, quality NULLS FIRST) AS answer FROM labels JOIN docs USING (doc_id) WHERE digest IS NOT NULL GROUP BY 1)
        SELECT doc_id, docs.digest, CASE WHEN j.digest IS NULL THEN 'ask' ELSE 'reused' END AS state, answer FROM docs LEFT JOIN j ON docs.digest = j.digest""",
    "event_verdicts": """
        WITH f AS (SELECT user_id, last(event_type ORDER BY ts, event_id) AS outcome FROM events GROUP BY 1)
        SELECT user_id, outcome, count(*) AS n_entries, count(*) FILTER (event_type <> outcome) AS n_repairs FROM events JOIN f USING (user_id) GROUP BY 1, 2""",
    "active_items": """
        SELECT lang, count(*) AS n, count(*) FILTER (r) AS n_resolved, count(*) FILTER (NOT r) AS n_active FROM (SELECT DISTINCT lang, doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS r FROM documents) GROUP BY 1""",
    "label_bases": f"""
        WITH {_DIGESTS}, c AS (SELECT digest, count(DISTINCT doc_id) AS n, min(doc_id) AS t FROM held GROUP BY 1), s AS (SELECT source, count(DISTINCT doc_id) AS n, min(doc_id) AS t FROM held GROUP BY 1),
        r AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM held) THEN 'own' WHEN c.n IS NOT NULL THEN 'copy' WHEN s.n IS NOT NULL THEN 'source' END AS basis, c.n AS cn, c.t AS ct, s.n AS sn, s.t AS st
              FROM docs LEFT JOIN c USING (digest) LEFT JOIN s USING (source)),
        b AS (SELECT doc_id, basis, CASE basis WHEN 'own' THEN 1 WHEN 'copy' THEN cn WHEN 'source' THEN sn ELSE 0 END AS n_candidates, CASE basis WHEN 'own' THEN doc_id WHEN 'copy' THEN ct WHEN 'source' THEN st END AS t FROM r)
        SELECT doc_id, basis, CASE n_candidates WHEN 0 THEN 'unresolved' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n_candidates = 1 THEN t::VARCHAR END AS target, n_candidates FROM b""",
    "alias_paths": f"""
        WITH p AS (SELECT page_id, {_HOST} AS scope, substr({_PATH}, 2) AS name FROM pages), q AS (SELECT *, split_part(name, '/', 1) AS h FROM p WHERE name <> ''),
        a AS (SELECT scope, name AS pattern, 'exact/' || name AS target FROM q WHERE page_id % 10 = 0 UNION SELECT scope, h || '/*', 'src/*' FROM q UNION SELECT scope, h || '/*' || right(name, 1), 'end/*.x' FROM q WHERE page_id % 3 = 0),
        m AS (SELECT scope, pattern, target, contains(pattern, '*') AS star, split_part(pattern, '*', 1) AS head, CASE WHEN contains(pattern, '*') THEN split_part(pattern, '*', 2) END AS tail FROM a),
        t AS (SELECT page_id, pattern, star, name, head, tail, target FROM q JOIN m USING (scope) WHERE CASE WHEN star THEN starts_with(name, head) AND ends_with(name, tail) AND length(name) >= length(head) + length(tail) ELSE name = head END)
        SELECT page_id AS ref_id, pattern, CASE WHEN star THEN replace(target, '*', substr(name, length(head) + 1, length(name) - length(head) - length(tail))) ELSE target END AS path
        FROM t QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY star, length(head) DESC, length(tail) DESC, pattern, target) = 1""",
    "package_roots": f"""
        WITH p AS (SELECT regexp_extract({_HOST} || {_PATH}, '^(@[^/]+/[^/]+|[^@./][^/]*)', 1) AS r FROM pages) SELECT CASE WHEN r <> '' THEN regexp_replace(lower(r), '[_.]', '-', 'g') END AS package, count(*) AS n_pages FROM p GROUP BY 1""",
    "part_wiring": """
        SELECT p_brand, CASE WHEN p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) THEN 'wired' WHEN p_brand IN (SELECT p_brand FROM part WHERE p_size = 50) THEN 'undeterminable' ELSE 'declared_unwired' END AS state, count(*) AS n
        FROM (SELECT DISTINCT p_brand, p_partkey FROM part) GROUP BY 1, 2""",
    "anchor_states": f"""
        WITH {_DIGESTS}, pins AS (SELECT source, min(lang) AS pin FROM held GROUP BY 1)
        SELECT doc_id, CASE WHEN pin IS NULL THEN 'not_in_graph' WHEN lang IS DISTINCT FROM pin THEN 'pin_differs' WHEN EXISTS (SELECT 1 FROM held h WHERE h.source = d.source AND h.n_chars = d.n_chars AND h.digest = d.digest) THEN 'bound'
            WHEN EXISTS (SELECT 1 FROM held h WHERE h.source = d.source AND h.n_chars = d.n_chars) THEN 'file_version_differs' WHEN EXISTS (SELECT 1 FROM held h WHERE h.source = d.source AND h.digest = d.digest) THEN 'same_content_other_path' ELSE 'not_in_graph' END AS state
        FROM docs d LEFT JOIN pins USING (source)""",
}
