"""Registered queries of the text operators, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import conversation_repair, decontamination, jaccard_join, language_id, line_dedup, packing, pii, quality_rules, run_detection, secret_scan, sharding, suffix_dedup, window_packing
from lodegraph.llm.common import documents


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(documents(spark, sf_dir))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = suffix_dedup.remove_repeats(documents(spark, sf_dir), length=400)
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links", "n_copies")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(documents(spark, sf_dir))
    return found.select("doc_id", F.coalesce(language_id.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = line_dedup.drop_lines(documents(spark, sf_dir).select("doc_id", "text"), min_docs=10)
    return dropped.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def _damaged(rows: DataFrame) -> DataFrame:
    """Drops, empties, cuts, repeats and reroles one row in twenty each, as the query's contract has it; a dropped row still names its conversation."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    gone, text, role = fate == 0, spaced("text"), spaced("role")
    return rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(gone | (fate == 1), "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(gone, 0).when(fate == 3, 2).otherwise(1).alias("copies"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _rewritten(docs: DataFrame) -> DataFrame:
    """Makes each tenth text periodic from some word on, as the query's contract has it; words without an id stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    docs = docs.select("doc_id", "text", h.alias("_h"), g.alias("_g"), F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("_words"))
    n = F.size("_words")
    a = F.pmod(F.col("_g"), F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + F.col("_g") % 8))).cast("int")
    block = F.slice("_words", a + 1, F.least(p, n - a))
    repeated = F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int")))
    words = F.slice(F.concat(F.slice("_words", F.lit(1), a), repeated), F.lit(1), n)
    return docs.select("doc_id", F.when((F.col("_h") % 10 == 0) & (n > 0), F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op12_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = run_detection.detect(_rewritten(documents(spark, sf_dir)))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"], F.lit("\n"))), "")
    listed = F.replace(listed, F.lit(",\n"), F.lit("\n"))
    best = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *best, milli, F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_window_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_packing.pack_windows(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_quality_rules, op3_sharding, op4_suffix_dedup, op5_jaccard_join, op6_language_id, op7_packing, op8_decontamination, op9_pii, op10_line_dedup, op11_conversation_repair, op12_run_detection, op13_window_packing)}

_SPACE = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

def _edit(state: str, cost: str, letter: str, line: str = "''", when: str = "true") -> str:
    return f"CASE WHEN {state} IS NOT NULL AND {when} THEN {{'cost': {state}.cost + {cost}, 'audit': {state}.audit || '{letter}', 'lines': {state}.lines || {line}}} END"


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _repair_sql() -> str:
    """The cheapest edits by a dynamic program that carries cost, audit and text of each state."""
    line, told = "chr(10) || role || ':' || text", lambda role: f"chr(10) || '{role}:' || text"
    keep = lambda s, initial: _edit(s, "more", "K", line, f"stays AND initial = '{initial}'")
    rerole = lambda s, role: _edit(s, "1 + more", "R", told(role), "stays")
    insert = lambda s, role: _edit(s, "5", "I", f"chr(10) || '{role}:'")
    dropped = [_edit(f"s{q}", "2", "D") for q in range(4)]
    n1 = _least(dropped[1], keep("s0", "s"))
    n2 = _least(dropped[2], *(f(s, x) for s in ("s0", "s1", "s3") for f, x in ((keep, "u"), (rerole, "user"))))
    n3 = _least(dropped[3], keep("s2", "a"), rerole("s2", "assistant"))
    return rf"""
        WITH RECURSIVE bits AS (
            SELECT i AS byte, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
            UNION ALL SELECT byte, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM bits WHERE k < 8
        ), crc AS (
            SELECT list(c ORDER BY byte) AS crcs FROM bits WHERE k = 8
        ), keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
        ), fated AS (
            SELECT keyed.*, xor(4294967295, list_reduce(list_transform(range(1, len(key) + 1), lambda i: ascii(key[i])::BIGINT), lambda c, b: xor(c >> 8, crcs[xor(c & 255, b) + 1]), 4294967295)) % 20 AS fate FROM keyed, crc
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                   CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
            FROM fated WHERE fate <> 0
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r,
                   rtrim(text, {_SPACE}) AS bare
            FROM damaged
        ), judged AS (
            SELECT conv_id, turn, role, text, r, left(role, 1) AS initial, bare = '' AS blank, bare <> '' AND min(r) OVER (PARTITION BY conv_id, role, text) < r AS duplicate,
                   right(bare, 1) NOT IN ('.', '!', '?') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY r) AS before
            FROM placed
        ), ready AS (
            SELECT *, NOT blank AND NOT duplicate AS stays, CASE WHEN cut THEN 5 ELSE 0 END AS more FROM judged
        ), counted AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
                   count(*) FILTER (WHERE stays AND cut) AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(r) AS n
            FROM ready GROUP BY conv_id
        ), steps AS (
            SELECT conv_id, 0::BIGINT AS r, {{'cost': 0, 'audit': '', 'lines': ''}} AS s0, NULL::STRUCT(cost INT, audit VARCHAR, lines VARCHAR) AS s1,
                   {{'cost': 5, 'audit': 'I', 'lines': chr(10) || 'user:'}} AS s2, {{'cost': 10, 'audit': 'II', 'lines': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3 FROM counted
            UNION ALL
            SELECT conv_id, r, s0, s1, s2, {_least("s3", insert("s2", "assistant"))} AS s3 FROM (
                SELECT conv_id, r, s0, s1, {_least("s2", insert("s0", "user"), insert("s1", "user"), insert("s3", "user"))} AS s2, s3 FROM (
                    SELECT s.conv_id, e.r, {dropped[0]} AS s0, {n1} AS s1, {n2} AS s2, {n3} AS s3
                    FROM steps s JOIN ready e ON s.conv_id IS NOT DISTINCT FROM e.conv_id AND e.r = s.r + 1
                )
            )
        ), ended AS (
            SELECT c.*, {_least("s0", "s3")} AS best FROM counted c JOIN steps s ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND c.n = s.r
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.lines, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN ended e ON o.conv_id IS NOT DISTINCT FROM e.conv_id
    """


ORACLE_SQL: dict[str, str] = {
    "op11_conversation_repair": _repair_sql(),
    "op5_jaccard_join": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\s\x0b]+'), lambda w: w <> '') AS w FROM documents
        ), grams AS (
            SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM words
        ), keyed AS (
            SELECT doc_id, g, CASE WHEN len(g) > 0 THEN md5(array_to_string(g, chr(10))) END AS set_id FROM grams
        ), sets AS (
            SELECT set_id, any_value(g) AS g, len(any_value(g)) AS n, min(doc_id) AS first, count(*) AS n_copies FROM keyed WHERE set_id IS NOT NULL GROUP BY set_id
        ), held AS (
            SELECT set_id, n, unnest(g) AS gram FROM sets
        ), links AS (
            SELECT a.set_id AS a, b.set_id AS b FROM held a JOIN held b ON a.gram = b.gram AND a.set_id <> b.set_id
            GROUP BY 1, 2 HAVING 9 * count(*) >= 4 * (any_value(a.n) + any_value(b.n))
        ), reached AS (
            SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a
        ), classes AS (
            SELECT s.set_id, least(s.first, min(t.first)) AS class_id FROM sets s JOIN reached ON s.set_id = a JOIN sets t ON b = t.set_id GROUP BY s.set_id, s.first
        ), counted AS (
            SELECT a AS set_id, count(*) AS n_links FROM links GROUP BY a
        )
        SELECT k.doc_id, CASE WHEN k.set_id IS NULL THEN k.doc_id ELSE coalesce(c.class_id, s.first) END AS class_id, coalesce(n.n_links, 0) AS n_links, coalesce(s.n_copies, 1) AS n_copies
        FROM keyed k LEFT JOIN sets s ON k.set_id = s.set_id LEFT JOIN classes c ON k.set_id = c.set_id LEFT JOIN counted n ON k.set_id = n.set_id
    """,
    "op10_line_dedup": f"""
        WITH split AS (
            SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
        ), keyed AS (
            SELECT doc_id, pos, lines[pos] AS line,
                   translate(trim(lines[pos], {_SPACE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM split)
        ), frequent AS (
            SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
        )
        SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
        FROM keyed k LEFT JOIN frequent f ON k.key = f.key
        GROUP BY doc_id
    """,
}
