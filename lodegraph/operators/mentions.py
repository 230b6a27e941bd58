"""Mentions and claims: surfaces of a text, signals of an entity, lines of an answer, propositions, standing, subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.operators.censuses import with_examples

#: What kinds of surfaces look like; group 1 is the surface.
SURFACES = {
    "acronym": r"(?:^|[^A-Za-z0-9])([A-Z]{2,8})(?:[^A-Za-z0-9]|$)",
    "code": r"`([^`\n]{1,200})`",
    "field": r"(?:^|\n)([A-Za-z][A-Za-z0-9_]{1,40}):",
    "symbol": r"([A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+)+)",
    "term": r"\*\*([^*\n]{1,200})\*\*",
}

MODALITIES = {"must": "binding", "shall": "binding", "should": "advisory", "may": "advisory", "planned": "future", "descriptive": "stated"}


def surfaces(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, kind, surface, n): what a text names, counted within it. Matches don't overlap; a null text names nothing."""

    def named(kind: str, shape: str) -> Column:
        matches = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(shape), F.lit(1))
        return F.transform(matches, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("surface")))

    found = F.concat(*[named(kind, shape) for kind, shape in sorted(SURFACES.items())])
    return docs.select(key, F.explode(found).alias("s")).groupBy(key, "s.kind", "s.surface").agg(F.count(F.lit(1)).alias("n"))


def clustered_signals(signals: DataFrame, entity: Column, kind: str, witness: str, most: int = 8) -> DataFrame:
    """Rows (entity, kind, n, n_subjects, examples, n_kinds): witnesses of each kind of signal, the first `most` listed, and how many kinds speak for the entity."""
    by_kind = with_examples(signals.withColumn("entity", entity).where("entity <> ''"), ["entity", kind], witness, most)
    return by_kind.withColumn("n_kinds", F.count(F.lit(1)).over(Window.partitionBy("entity")))


def relation_lines(lines: DataFrame, answer: str, position: str, kind: str, index: str) -> DataFrame:
    """Adds disposition to the lines of answers, one relation or piece of evidence per line.

    `relation`, `duplicate` (its index was declared before), `evidence` (for a relation declared before), `orphan` evidence, `unindexed`, `unknown` kind.
    One bad line leaves the others as they are.
    """
    before = Window.partitionBy(answer, index).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    declared = F.coalesce(F.max(F.when(F.col(kind) == "rel", True)).over(before), F.lit(False))
    disposition = (
        F.when(F.col(index).isNull(), "unindexed").when((F.col(kind) == "rel") & declared, "duplicate").when(F.col(kind) == "rel", "relation")
        .when((F.col(kind) == "ev") & declared, "evidence").when(F.col(kind) == "ev", "orphan").otherwise("unknown")
    )
    return lines.withColumn("disposition", disposition)


def proposition(subject: Column, modality: Column, scope: Column, valid_from: Column, valid_until: Column, statement: Column) -> Column:
    """A claim as a struct (neighbourhood, modality_class, scope_band, validity_band, object_key) that equal claims share.

    Blank subjects are `unassigned`, unknown modalities descriptive; the object is the set of its words in order.
    """
    classes = F.create_map(*[F.lit(x) for pair in sorted(MODALITIES.items()) for x in pair])
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower(statement), "[^a-z0-9]+"), lambda w: w != "")))
    return F.struct(
        F.coalesce(F.nullif(F.lower(F.trim(subject)), F.lit("")), F.lit("unassigned")).alias("neighbourhood"),
        F.coalesce(F.try_element_at(classes, F.lower(modality)), F.lit("stated")).alias("modality_class"), F.coalesce(scope, F.lit("any")).alias("scope_band"),
        F.when(valid_from.isNull() & valid_until.isNull(), "unbounded").otherwise("bounded").alias("validity_band"), F.coalesce(F.array_join(words, " "), F.lit("")).alias("object_key"),
    )


def standings(subjects: DataFrame, support: DataFrame, key: str, kind: str) -> DataFrame:
    """Rows (key, status, evidence_class, n_rows) of subjects by the kinds of their support: code, comment or document.

    Without support a subject is held, else proposed. Comments and documents alone are a claim, code alone is observed code, and a mixture is neither.
    """
    counted = support.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(kind) == "code").alias("_code"), F.count_if(F.col(kind).isin("comment", "document")).alias("_told"))
    joined = subjects.select(key).distinct().join(counted, key, "left")
    n = F.coalesce("n_rows", F.lit(0))
    evidence = F.when(F.col("_told") == n, "claim").when(F.col("_code") == n, "observed code")
    return joined.select(key, F.when(n == 0, "held").otherwise("proposed").alias("status"), F.when(n > 0, evidence).alias("evidence_class"), n.alias("n_rows"))


def exclusion_reason(component: Column, path: Column, rules: list[dict[str, str]]) -> Column:
    """The reason of the first rule (component, reason, and one of path, prefix, name, name_prefix) that holds; null if none does."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    tests = {"path": lambda v: path == v, "prefix": lambda v: F.startswith(path, F.lit(v)), "name": lambda v: name == v, "name_prefix": lambda v: F.startswith(name, F.lit(v))}
    found = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        how = [k for k in tests if k in rule]
        if len(how) != 1:
            raise ValueError(f"a rule takes one of {', '.join(tests)}: {rule}")
        found = found.when((component == rule["component"]) & tests[how[0]](rule[how[0]]), F.lit(rule["reason"]))
    return found


def ignore_rule(line: Column) -> Column:
    """A line of an ignore file as a prefix: trimmed, without `./` and closing slashes. Null for blanks, comments, absolute paths and paths with a parent segment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(line), r"^(\./)+", ""), "/+$", "")
    return F.when((bare != "") & ~bare.rlike("^[#/]") & ~bare.rlike(r"^[A-Za-z]:") & ~bare.rlike(r"(^|/)\.\.(/|$)"), bare)


def subject(nodes: DataFrame, edges: DataFrame, aliases: DataFrame, term: str) -> DataFrame:
    """Rows (item, id) of all that one alias of a term stands for: `node` itself, `edge` at it, `neighbour` beyond the edge.

    Aliases are rows (alias, node_id), compared without case. The nodes of a term may be many, so they are joined, not listed.
    """
    own = aliases.where(F.lower("alias") == term.strip().lower()).select("node_id").distinct().join(nodes.select("node_id"), "node_id", "left_semi")
    out = edges.select("edge_id", F.col("src").alias("node_id"), F.col("dst").alias("other")).union(edges.select("edge_id", "dst", "src")).join(own, "node_id", "left_semi")
    beyond = out.select(F.col("other").alias("node_id")).distinct().join(own, "node_id", "left_anti")
    row = lambda df, item, key: df.select(F.lit(item).alias("item"), F.col(key).alias("id"))
    return row(own, "node", "node_id").union(row(out.select("edge_id").distinct(), "edge", "edge_id")).union(row(beyond, "neighbour", "node_id"))
