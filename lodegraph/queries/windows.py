"""Windows, units and tiles over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import windows
from lodegraph.sources import canonical, star
from lodegraph.sources.star import table

_TILES = {"small": 400, "summary": 900, "standard": 8000}


def _headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, every seventh line that isn't blank made a heading of one of three levels."""
    heading = lambda line, i: F.when((i % 7 == 3) & (F.trim(line) != ""), F.concat(F.repeat(F.lit("#"), (1 + F.floor(i / 7) % 3).cast("int")), F.lit(" "), F.trim(line))).otherwise(line)
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), heading)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(lines, "\n").alias("text"))


def section_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.section_windows(_headed(spark, sf_dir), 1000)
    return found.withColumn("path", F.sha2("path", 256))


def overlap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.block_windows(_headed(spark, sf_dir), 2048)


def text_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.text_units(table(spark, sf_dir, "documents"))


def scope_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as scopes of their customers, under three budgets."""
    nations = table(spark, sf_dir, "nation").select(star.node_id("Nation", "n_nationkey").alias("scope"), F.col("n_name").alias("label"))
    scopes = nations.select("scope", F.concat(F.lit("view/"), "scope").alias("address"), F.to_json(F.struct(F.lit("tile").alias("record"), "scope", "label")).alias("json"))
    members = table(spark, sf_dir, "customer").where("c_nationkey % 6 <> 5").select(star.node_id("Nation", "c_nationkey").alias("scope"), star.node_id("Customer", "c_custkey").alias("member"))
    return windows.tiles(scopes, members, _TILES).select("scope", "profile", "included", "total", "n_bytes", F.sha2("tile", 256).alias("tile_sha256"))


def canonical_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as one canonical text: records, bytes and the digest of its chunks' digests."""
    return canonical.canonical_digest(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", F.array("c_mktsegment", "c_name").alias("tags")))


QUERIES = {f.__name__: f for f in (section_windows, overlap_windows, text_units, scope_tiles, canonical_table)}

#: Lines of `_headed`, with their bytes and level of heading.
_LINES = """
    split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
    raw AS (SELECT doc_id, i, l[i + 1] AS c FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM split)),
    lines AS (SELECT doc_id, i + 1 AS line, CASE WHEN head THEN repeat('#', (1 + i // 7 % 3)::INT) || ' ' || trim(c) ELSE c END AS c, CASE WHEN head THEN 1 + i // 7 % 3 END AS level, trim(c) AS title FROM (SELECT *, i % 7 = 3 AND trim(c) <> '' AS head FROM raw))"""


def _fold(name: str, source: str, key: str, most: int, joint: int) -> str:
    """Windows of ordered rows (key, r, n) of `source`, r from 1."""
    return f"""{name} AS (SELECT {key}, r, n, 0 AS w, n AS held FROM {source} WHERE r = 1
        UNION ALL SELECT {', '.join(f's.{k.strip()}' for k in key.split(','))}, s.r, s.n, CASE WHEN fresh THEN w + 1 ELSE w END, CASE WHEN fresh OR held = 0 THEN s.n ELSE held + {joint} + s.n END
            FROM (SELECT f.*, held, w, f.n > {most} OR held > {most} OR held > 0 AND held + {joint} + f.n > {most} AS fresh FROM {name} p JOIN {source} f ON {' AND '.join(f'p.{k.strip()} = f.{k.strip()}' for k in key.split(','))} AND f.r = p.r + 1) s)"""


ORACLE_SQL = {
    "section_windows": f"""WITH RECURSIVE {_LINES}, sized AS (SELECT *, strlen(c) AS n FROM lines), ends AS (SELECT doc_id, max(line) AS last FROM lines GROUP BY doc_id), heads AS (SELECT doc_id, line, level, title FROM lines WHERE level IS NOT NULL),
            paths AS (SELECT h.doc_id, h.line, string_agg(g.title, ' / ' ORDER BY g.line) AS path FROM heads h JOIN heads g ON h.doc_id = g.doc_id AND g.line <= h.line
                WHERE NOT EXISTS (SELECT 1 FROM heads x WHERE x.doc_id = h.doc_id AND x.line > g.line AND x.line <= h.line AND x.level <= g.level) GROUP BY ALL),
            begun AS (SELECT doc_id, line AS s, path FROM paths UNION ALL SELECT doc_id, 1, '(preamble)' FROM paths GROUP BY doc_id HAVING min(line) > 1 UNION ALL SELECT doc_id, 1, NULL FROM ends WHERE doc_id NOT IN (SELECT doc_id FROM heads)),
            segs AS (SELECT doc_id, s, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s) - 1, last) AS e, path FROM begun JOIN ends USING (doc_id)),
            owned AS (SELECT l.doc_id, s, line, l.n, path FROM segs g JOIN sized l ON l.doc_id = g.doc_id AND line BETWEEN s AND e),
            weighed AS (SELECT doc_id, s, max(line) AS e, any_value(path) AS path, sum(n)::BIGINT + count(*) - 1 AS n FROM owned GROUP BY doc_id, s),
            flow AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS r FROM weighed WHERE path IS NOT NULL), {_fold('folded', 'flow', 'doc_id', 1000, 1)},
            cut AS (SELECT o.doc_id, o.s, o.line, o.n + 1 AS n, row_number() OVER (PARTITION BY o.doc_id, o.s ORDER BY o.line) AS r FROM owned o JOIN weighed w ON o.doc_id = w.doc_id AND o.s = w.s WHERE w.path IS NULL OR w.n > 1000), {_fold('cutted', 'cut', 'doc_id, s', 1000, 0)},
            pieces AS (SELECT doc_id, s, w, min(line) AS line, max(line) AS line_end, sum(c.n)::BIGINT - 1 AS n_bytes FROM cutted JOIN cut c USING (doc_id, s, r) GROUP BY doc_id, s, w),
            whole AS (SELECT doc_id, w, min(s) AS line, max(e) AS line_end, count(*) AS n_sections, any_value(path) AS path, sum(f.n)::BIGINT + count(*) - 1 AS n_bytes FROM folded JOIN flow f USING (doc_id, r) GROUP BY doc_id, w)
        SELECT doc_id, line, line_end, n_sections, CASE WHEN n_sections = 1 THEN sha256(path) END AS path, NULL::BIGINT AS part, NULL::BIGINT AS parts, n_bytes FROM whole WHERE n_bytes <= 1000
        UNION ALL SELECT p.doc_id, p.line, p.line_end, CASE WHEN path IS NOT NULL THEN 1 END, sha256(path), CASE WHEN path IS NOT NULL THEN w + 1 END, CASE WHEN path IS NOT NULL THEN count(*) OVER (PARTITION BY p.doc_id, p.s) END, n_bytes FROM pieces p JOIN segs USING (doc_id, s)""",
    "overlap_windows": f"""WITH RECURSIVE {_LINES}, kinds AS (SELECT doc_id, line, strlen(c) + 1 AS n, CASE WHEN level IS NOT NULL THEN 'heading' WHEN trim(c) = '' THEN 'blank' WHEN regexp_matches(c, '^ {{0,3}}([*+-]|[0-9]+[.)])[ \\t]') THEN 'list' WHEN regexp_matches(c, '^ {{0,3}}>') THEN 'quote'
                WHEN regexp_matches(c, '^ {{0,3}}\\|.*\\|[ \\t]*$') THEN 'table' ELSE 'paragraph' END AS kind FROM lines),
            marked AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, kind = 'heading' OR kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY doc_id ORDER BY line) AS fresh FROM kinds),
            blocks AS (SELECT doc_id, r, min(start)::BIGINT AS start, sum(n)::BIGINT AS n FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY line) AS r FROM marked) GROUP BY doc_id, r),
            totals AS (SELECT doc_id, sum(n) AS total FROM blocks GROUP BY doc_id), flow AS (SELECT * FROM blocks WHERE doc_id IN (SELECT doc_id FROM totals WHERE total > 2048)), {_fold('folded', 'flow', 'doc_id', 2048, 0)},
            placed AS (SELECT f.doc_id, f.r, f.n, w, start, coalesce(sum(f.n) OVER (PARTITION BY f.doc_id, w ORDER BY f.r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS behind FROM folded f JOIN flow USING (doc_id, r)),
            context AS (SELECT doc_id, w + 1 AS w, min(start) AS context_start, sum(n)::BIGINT AS context_bytes FROM placed WHERE behind < 512 GROUP BY doc_id, w), made AS (SELECT doc_id, w, min(start) AS start, sum(n)::BIGINT AS n_bytes, count(*) AS n_blocks FROM placed GROUP BY doc_id, w)
        SELECT doc_id, w::BIGINT AS "window", 'overlapping_window' AS kind, start, n_bytes, n_blocks, CASE WHEN n_bytes <= 2048 THEN context_start END AS context_start, CASE WHEN n_bytes <= 2048 THEN coalesce(context_bytes, 0) ELSE 0 END AS context_bytes FROM made LEFT JOIN context USING (doc_id, w)
        UNION ALL SELECT doc_id, 0, 'whole_document', min(start), sum(n)::BIGINT, count(*), NULL, 0 FROM blocks WHERE doc_id IN (SELECT doc_id FROM totals WHERE total <= 2048) GROUP BY doc_id""",
    "text_units": r"""WITH RECURSIVE split AS (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM documents WHERE text <> ''),
            raw AS (SELECT doc_id, i, l[i + 1] AS c, CASE WHEN i > 0 THEN l[i] END AS p FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM split)),
            ranked AS (SELECT doc_id, i, c, sum(strlen(c) + 1) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS upto, CASE WHEN regexp_matches(c, '^(export\s|function\s|async\s|class\s|interface\s|type\s|enum\s|struct\s|extension\s|protocol\s|func\s|fun\s|object\s|def\s|public\s|private\s|internal\s|final\s|abstract\s|import\s|const\s|let\s|var\s|@\w|#\s|##\s|###\s|CREATE\s|ALTER\s|resource\s|module\s|package\s|\w[\w-]*:\s*$)')
                    AND (blank OR regexp_matches(c, '^#{1,3}\s')) THEN 3 WHEN blank AND regexp_matches(c, '^\S') THEN 2 WHEN blank THEN 1 ELSE 0 END AS rank FROM (SELECT *, coalesce(trim(p, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) = '', false) AS blank FROM raw)),
            steps AS (SELECT doc_id, -1::BIGINT AS i, 0::BIGINT AS start, 0::BIGINT AS base, NULL::BIGINT AS best, 0 AS best_rank, 0::BIGINT AS best_upto, NULL::BIGINT AS cut FROM split
                UNION ALL SELECT doc_id, i, coalesce(cut, start), CASE WHEN cut IS NULL THEN base WHEN cut = i + 1 THEN upto ELSE best_upto END, CASE WHEN cut IS NULL THEN best END, CASE WHEN cut IS NULL THEN best_rank ELSE 0 END, best_upto, cut FROM (
                    SELECT *, CASE WHEN upto - base >= 3500 AND best IS NOT NULL THEN best WHEN upto - base >= 6000 THEN i + 1 END AS cut FROM (
                        SELECT s.doc_id, r.i, start, base, upto, CASE WHEN good THEN r.i ELSE best END AS best, CASE WHEN good THEN rank ELSE best_rank END AS best_rank, CASE WHEN good THEN before ELSE best_upto END AS best_upto
                        FROM (SELECT s.*, r.i AS at, upto - strlen(c) - 1 AS before, rank > 0 AND 2 * (upto - strlen(c) - 1 - base) >= 3500 AND (best IS NULL OR rank >= best_rank) AS good FROM steps s JOIN ranked r ON s.doc_id = r.doc_id AND r.i = s.i + 1) s JOIN ranked r ON s.doc_id = r.doc_id AND r.i = s.at))),
            ends AS (SELECT doc_id, cut AS e FROM steps WHERE cut IS NOT NULL UNION SELECT doc_id, len(l) FROM split),
            units AS (SELECT doc_id, coalesce(lag(e) OVER w, 0) AS s, e, row_number() OVER w - 1 AS unit, count(*) OVER (PARTITION BY doc_id) AS n_units FROM ends WINDOW w AS (PARTITION BY doc_id ORDER BY e))
        SELECT doc_id, unit, n_units, s + 1 AS line, e AS line_end, strlen(t) AS n_bytes, sha256(t) AS sha256 FROM (SELECT *, array_to_string(l[s + 1:e], chr(10)) AS t FROM units JOIN split USING (doc_id)) WHERE e > 0""",
    "scope_tiles": """WITH s AS (SELECT 'nation:' || n_nationkey AS scope, '{"record":"tile","scope":"nation:' || n_nationkey || '","label":"' || n_name || '"' AS head, n_nationkey FROM nation),
            m AS (SELECT n_nationkey AS k, 'customer:' || c_custkey AS member FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey % 6 <> 5),
            r AS (SELECT k, row_number() OVER w AS nth, count(*) OVER (PARTITION BY k) AS total, string_agg('"' || member || '"', ',') OVER w AS rows FROM m WINDOW w AS (PARTITION BY k ORDER BY member)),
            p AS (SELECT unnest(['small', 'summary', 'standard']) AS profile, unnest([400, 900, 8000]) AS most),
            t AS (SELECT scope, head, profile, most, nth, total, rows, head || ',"node_rows":[' || rows || '],"node_rows_included":' || nth || ',"node_rows_total":' || total || ',"node_rows_omitted":' || total - nth || ',"continuation_address":' AS body FROM s JOIN r ON n_nationkey = k CROSS JOIN p),
            f AS (SELECT scope, profile, max(nth) AS nth FROM t WHERE strlen(body || '"view/' || scope || '/nodes?after=' || nth || '"}') <= most OR nth = 1 GROUP BY ALL),
            x AS (SELECT scope, profile, nth AS included, total, body || CASE WHEN nth < total THEN '"view/' || scope || '/nodes?after=' || nth || '"' ELSE 'null' END || '}' AS tile FROM f JOIN t USING (scope, profile, nth)
                UNION ALL SELECT scope, profile, 0, 0, head || ',"node_rows":[],"node_rows_included":0,"node_rows_total":0,"node_rows_omitted":0,"continuation_address":null}' FROM s CROSS JOIN p WHERE n_nationkey NOT IN (SELECT k FROM m))
        SELECT scope, profile, included, total, strlen(tile) AS n_bytes, sha256(tile) AS tile_sha256 FROM x""",
    "canonical_table": r"""WITH RECURSIVE t AS (SELECT '  {' || chr(10) || '    "c_custkey": ' || c_custkey || ',' || chr(10) || '    "c_name": "' || c_name || '",' || chr(10) || '    "c_nationkey": ' || c_nationkey || ',' || chr(10) || '    "tags": [' || chr(10) || '      "' || c_mktsegment || '",' || chr(10)
                || '      "' || c_name || '"' || chr(10) || '    ]' || chr(10) || '  }' AS text FROM customer),
            r AS (SELECT text, row_number() OVER (ORDER BY text) - 1 AS k FROM t), one AS (SELECT k // 4096 AS k, sha256(string_agg(text, ',' || chr(10) ORDER BY k)) AS text FROM r GROUP BY 1),
            two AS (SELECT CASE WHEN count(*) > 1 THEN sha256(string_agg(text, ',' || chr(10) ORDER BY k)) ELSE min(text) END AS digest FROM one)
        SELECT (SELECT count(*) FROM t) AS n, (SELECT sum(strlen(text) + 2)::BIGINT + 3 FROM t) AS n_bytes, digest FROM two""",
}
