"""Entities and their relationships derived from facts about database schemas, with a reason for all that isn't derived.

Facts: tables (table, file); columns (table, column, unique, target: the table of a declared reference or null), the identity columns only;
keys (table, column), all columns of primary keys; enums (table, column, value) of CHECK lists; kinds (kind) that a shipped model declares; signals
(entity, source) from code or event names. A name may be declared many times; all names are lower case.

Everything is an equi-join: the tails of a column's name become rows and meet the promoted names, so no column is tried against all entities.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodegraph.operators.joins import first_by
from lodegraph.runtime import checkpoint

#: Plural forms out of rule; endings and names of tables that are read models or plumbing; what projects another table.
IRREGULAR = {"criteria": "criterion", "indices": "index"}
READ_MODEL = r"(_summary|_index|_projection|_current|_meta|_cursor|_cursors|_inbox|_outbox|_dedupe|_log|_journal|_ledger|_state|_watermarks|_markers|_deliveries|_fences|_consumed|_new)$|^(outbox|inbox|dead_letter_queue|resource_leases)$"
PROJECTION = "^(.+?)_(summary|index|projection)$"
#: A table is an entity's root by its name or by its primary key.
LINEAGE = "spawn|lineage|parent|child"
LINEAGE_EDGES = ("parent", "nested_batch", "membership")


class EntityLayer(NamedTuple):
    decisions: DataFrame
    audit: DataFrame
    relationships: DataFrame
    refusals: DataFrame
    conflicts: DataFrame


def singular(name: Column) -> Column:
    """The singular of a name whose words are joined by underscores; only its last word has a plural."""
    out = F.when(name.rlike("(ss|us|is)$"), name).when(name.rlike("ies$"), F.regexp_replace(name, "ies$", "y")).when(name.rlike("(ch|sh|x|s)es$"), F.regexp_replace(name, "es$", "")).otherwise(F.regexp_replace(name, "s$", ""))
    for plural, one in IRREGULAR.items():
        out = F.when(name.rlike(f"(^|_){plural}$"), F.regexp_replace(name, f"{plural}$", one)).otherwise(out)
    return out


def tails(name: Column) -> Column:
    """Array of (start, tail): the name from each of its words on."""
    words = F.split(name, "_")
    return F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.struct(i.alias("start"), F.array_join(F.slice(words, i, F.size(words)), "_").alias("tail")))


def _aliased(name: Column, aliases: Mapping[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]), name), name) if aliases else name


def decided(tables: DataFrame, columns: DataFrame, keys: DataFrame, kinds: DataFrame, signals: DataFrame, aliases: Mapping[str, str] | None = None) -> DataFrame:
    """Rows (entity, root_table, evidence, has_kind, n_sources, refusal): every candidate; one without a refusal is promoted.

    A candidate is named by a table, a single-column key that the table's name holds, the tails of an identity column, or a model's kind. It needs a root table that is no read
    model, or references in two tables of two files, and one source besides the schema.
    """
    known = tables.groupBy("table").agg(F.min("file").alias("file"))
    single = keys.distinct().groupBy("table").agg(F.count(F.lit(1)).alias("n"), F.min("column").alias("key")).where("n = 1 AND key LIKE '%\\_id'")
    by_name = known.select(singular(F.col("table")).alias("entity"), F.col("table").alias("named"), F.lit(None).cast("string").alias("keyed"))
    stem = singular(F.regexp_replace("key", "_id$", ""))
    words = F.transform(F.split("table", "_"), singular)
    held = single.join(known, "table").where((stem != singular(F.col("table"))) & F.forall(F.split(stem, "_"), lambda w: F.array_contains(words, w)))
    roots = by_name.union(held.select(stem, F.lit(None), "table")).groupBy("entity").agg(F.coalesce(F.max("named"), F.max("keyed")).alias("root"))
    asked = columns.select("table", F.regexp_replace("column", "_id$", "").alias("stem")).distinct().where("stem NOT IN ('', 'id')").join(known, "table")
    named = asked.select("table", "file", F.explode(tails(F.col("stem"))).alias("t")).select("table", "file", _aliased(singular(F.col("t.tail")), aliases or {}).alias("entity"))
    referenced = named.groupBy("entity").agg((F.countDistinct("table") >= 2).alias("_tables"), (F.countDistinct("file") >= 2).alias("_files"))
    shipped = kinds.select(singular(F.col("kind")).alias("entity")).distinct().withColumn("has_kind", F.lit(True))
    more = signals.groupBy("entity").agg(F.countDistinct("source").alias("n_signals"))
    whole = roots.join(referenced, "entity", "full").join(shipped, "entity", "full").join(more, "entity", "left")
    plumbing, often, kind = F.coalesce(F.col("root").rlike(READ_MODEL), F.lit(False)), F.coalesce(F.col("_tables") & F.col("_files"), F.lit(False)), F.coalesce("has_kind", F.lit(False))
    root = F.when(~plumbing, F.col("root"))
    evidence = F.when(root.isNotNull(), "root_table").when(often, "referenced_id")
    sources = F.coalesce("n_signals", F.lit(0)) + kind.cast("int")
    refusal = (
        F.when(plumbing & ~often, "read_model_or_infrastructure_table").when(evidence.isNull() & kind, "model_kind_without_schema_evidence").when(evidence.isNull(), "insufficient_schema_evidence")
        .when(sources == 0, "single_source_uncorroborated")
    )
    return whole.select("entity", root.alias("root_table"), evidence.alias("evidence"), kind.alias("has_kind"), sources.alias("n_sources"), refusal.alias("refusal"))


def audited(tables: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows (table, entity, reason): each table is the root of an entity, or there is a reason why it isn't."""
    owners = decisions.where("refusal IS NULL AND root_table IS NOT NULL").groupBy(F.col("root_table").alias("table")).agg(F.max("entity").alias("entity"))
    named = decisions.select(F.col("entity").alias("_named"), F.col("refusal").alias("_refusal"))
    joined = tables.select("table").distinct().join(owners, "table", "left").withColumn("_named", singular(F.col("table"))).join(named, "_named", "left")
    reason = F.when(F.col("entity").isNotNull(), None).when(F.col("table").rlike(READ_MODEL), "read_model_or_infrastructure_table").otherwise(F.coalesce("_refusal", F.lit("table_superseded_by_other_root_table")))
    return joined.select("table", "entity", reason.alias("reason"))


def _resolved(columns: DataFrame, promoted: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """`columns` (table, column) with the promoted entity that the longest tail of an `_id` column names, and the words before it."""
    tried = columns.where("column LIKE '%\\_id' AND column <> 'id_id'").select("table", "column", F.explode(tails(F.regexp_replace("column", "_id$", ""))).alias("t"))
    direct = tried.withColumn("entity", F.col("t.tail")).withColumn("_rank", F.lit(0))
    if aliases:
        direct = direct.union(tried.withColumn("entity", _aliased(F.col("t.tail"), aliases)).where(F.col("entity") != F.col("t.tail")).withColumn("_rank", F.lit(1)))
    best = first_by(direct.join(promoted.select("entity"), "entity", "left_semi"), ["table", "column"], ["t.start", "_rank"])
    role = F.array_join(F.slice(F.split(F.regexp_replace("column", "_id$", ""), "_"), F.lit(1), F.col("t.start") - 1), "_")
    return best.select("table", "column", "entity", F.nullif(role, F.lit("")).alias("role"))


def related(tables: DataFrame, columns: DataFrame, keys: DataFrame, enums: DataFrame, decisions: DataFrame, aliases: Mapping[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(relationships, refusals): rows (from_entity, to_entity, relation, cardinality, via, basis, status) and rows (subject, reason).

    A table belongs to the entity it is the root of, that its single key names, or that it projects; its identity columns relate their entities to that one. A table of no
    entity links the entities of its columns to that of its first key column. A CHECK list of kinds beside an `_id` column relates the table's only other entity to each.
    Cardinality comes from uniqueness alone.
    """
    aliases = aliases or {}
    promoted = decisions.where("refusal IS NULL").select("entity", "root_table")
    known = tables.select("table").distinct()
    pk = keys.distinct()
    counted = pk.groupBy("table").agg(F.count(F.lit(1)).alias("n_pk"), F.min("column").alias("key"))
    projected = singular(F.regexp_extract("table", PROJECTION, 1))
    base = known.join(counted, "table", "left").select("table", F.coalesce("n_pk", F.lit(0)).alias("n_pk"), singular(F.col("table")).alias("_a"), F.when(F.col("n_pk") == 1, singular(F.regexp_replace("key", "_id$", ""))).alias("_b"), projected.alias("_c"))
    is_named = lambda c: promoted.select(F.col("entity").alias(c), F.lit(True).alias(f"{c}_is"))
    own = promoted.select(F.col("entity").alias("_a"), F.col("root_table").alias("_a_root"))
    told = base.join(own, "_a", "left").join(is_named("_b"), "_b", "left").join(is_named("_c"), "_c", "left")
    roots = F.coalesce(F.col("_a_root") == F.col("table"), F.lit(False))
    by_name = roots | F.col("_b_is").isNotNull()
    subjects = told.select("table", "n_pk", F.when(roots, F.col("_a")).when(F.col("_b_is"), F.col("_b")).when(F.col("_c_is"), F.col("_c")).alias("subject"), F.when(~by_name & F.col("_c_is"), F.lit(True)).otherwise(F.lit(False)).alias("read_model"))

    merged = columns.groupBy("table", "column").agg(F.bool_or("unique").alias("unique"), F.min("target").alias("target")).join(known, "table", "left_semi")
    named = checkpoint(_resolved(merged, promoted, aliases))
    pointed = merged.where("target IS NOT NULL").join(known.withColumnRenamed("table", "target"), "target", "left_semi")
    pointed = pointed.select("table", "column", singular(F.col("target")).alias("_a"), singular(F.regexp_extract("target", PROJECTION, 1)).alias("_c")).join(is_named("_a"), "_a", "left").join(is_named("_c"), "_c", "left")
    pointed = pointed.select("table", "column", F.when(F.col("_a_is"), F.col("_a")).when(F.col("_c_is"), F.col("_c")).alias("declared"))
    role = F.regexp_replace(F.regexp_replace("column", "_?id$", ""), F.concat(F.lit("_?"), F.col("declared"), F.lit("$")), F.lit(""))
    joined = merged.join(named, ["table", "column"], "left").join(pointed, ["table", "column"], "left").join(pk.withColumn("in_pk", F.lit(True)), ["table", "column"], "left").join(subjects, "table")
    rows = checkpoint(joined.select(
        "table", "column", "unique", F.col("target").isNotNull().alias("is_declared"), F.coalesce("declared", "entity").alias("entity"), F.when(F.col("declared").isNotNull(), F.nullif(role, F.lit(""))).otherwise(F.col("role")).alias("role"),
        F.coalesce("in_pk", F.lit(False)).alias("in_pk"), "n_pk", "subject", "read_model",
    ))
    via, status = F.concat_ws(".", "table", "column"), F.when(F.col("is_declared"), "schema_declared")
    many = lambda unique: (F.when(unique, "has_one").otherwise("has_many"), F.when(unique, "1..1").otherwise("1..N"))
    relation, cardinality = many(F.col("unique"))
    found = rows.where("entity IS NOT NULL")
    owned = found.where("subject IS NOT NULL AND NOT (entity = subject AND role IS NULL)").select(
        F.col("entity").alias("from_entity"), F.col("subject").alias("to_entity"), relation.alias("relation"), cardinality.alias("cardinality"), via.alias("via"), F.when(F.col("is_declared"), "declared_foreign_key").otherwise("fk_shaped_column").alias("basis"),
        F.coalesce(status, F.when(F.col("read_model"), "read_model_evidence").otherwise("shape_only")).alias("status"),
    )
    free = found.where("subject IS NULL")
    heads = first_by(free.where("in_pk"), ["table"], ["column"]).select("table", F.col("column").alias("_head"), F.col("entity").alias("_to"), F.col("unique").alias("_unique"))
    links = free.join(heads, "table").where(F.col("column") != F.col("_head"))
    both = (F.col("n_pk") > 1) & F.col("in_pk")
    relation, cardinality = many(F.col("_unique"))
    linked = links.select(
        "entity", "_to", F.when(both, "relates_to").otherwise(relation), F.when(both, "N..N").otherwise(cardinality), via, F.when(F.col("is_declared"), "declared_foreign_key").otherwise("link_table"), F.coalesce(status, F.lit("shape_only")),
    )
    lists = enums.where("column LIKE '%\\_kind' AND table NOT LIKE '%\\_new'").select("table", F.concat(F.regexp_replace("column", "_kind$", ""), F.lit("_id")).alias("column"), "value").distinct().join(merged.select("table", "column"), ["table", "column"], "left_semi")
    anchors = lists.select("table", F.col("column").alias("_id")).distinct().join(named, "table").where(F.col("column") != F.col("_id")).groupBy("table", "_id").agg(F.count(F.lit(1)).alias("n"), F.min("entity").alias("_from")).where("n = 1")
    valued = lists.withColumnRenamed("column", "_id").join(anchors, ["table", "_id"]).withColumn("_a", F.col("value")).withColumn("_c", singular(F.col("value"))).join(is_named("_a"), "_a", "left").join(is_named("_c"), "_c", "left")
    valued = valued.withColumn("_to", F.when(F.col("_a_is"), F.col("_a")).when(F.col("_c_is"), F.col("_c"))).where("_to IS NOT NULL AND _to <> _from")
    listed = valued.select("_from", "_to", F.lit("relates_to"), F.lit("N..N"), F.concat_ws(".", "table", "_id"), F.lit("polymorphic_check_enum"), F.lit("schema_declared")).distinct()
    relationships = owned.union(linked).union(listed).where("NOT (from_entity = to_entity AND relation = 'has_one')")
    basis = F.array_position(F.array(*map(F.lit, ("declared_foreign_key", "fk_shaped_column", "link_table", "polymorphic_check_enum"))), F.col("basis"))
    relationships = first_by(relationships, ["from_entity", "to_entity", "relation", "via"], [basis])

    polymorphic = F.col("column").rlike("^item_id$|_item_id$")
    lost = rows.where(F.col("entity").isNull() & (F.col("subject").isNotNull() | polymorphic) & (F.col("column") != "id") & ~F.col("in_pk"))
    lost = lost.select(via.alias("subject"), F.when(polymorphic, "polymorphic_reference_not_resolvable_from_schema").otherwise("id_column_names_no_promoted_entity").alias("reason"))
    loose = free.select("table").distinct().join(heads, "table", "left_anti").select(F.col("table").alias("subject"), F.lit("detail_table_without_entity_subject").alias("reason"))
    return relationships, lost.union(loose)


def conflicting(decisions: DataFrame, kinds: DataFrame, relationships: DataFrame, edge_kinds: Sequence[str]) -> DataFrame:
    """Rows (subject, about, reason): where schema and shipped model disagree about names, presence or lineage edges."""
    promoted = decisions.where("refusal IS NULL").select("entity")
    shipped = kinds.select("kind").distinct()
    one = shipped.withColumn("entity", singular(F.col("kind")))
    renamed = one.where("entity <> kind").join(promoted, "entity", "left_semi").select(F.col("kind").alias("subject"), F.col("entity").alias("about"))
    ends = one.join(promoted, "entity", "left_anti").select("kind", F.explode(tails(F.col("kind"))).alias("t")).where("t.start > 1").select("kind", "t.start", singular(F.col("t.tail")).alias("entity"))
    ended = first_by(ends.join(promoted, "entity", "left_semi"), ["kind"], ["start"]).select("kind", "entity")
    named = renamed.union(ended).withColumn("reason", F.lit("entity_name_disagreement"))
    ghosts = decisions.where("refusal = 'model_kind_without_schema_evidence'").select("entity", "entity", F.lit("model_declares_entity_schema_has_no_table"))
    covered = shipped.select(F.explode(tails(F.col("kind"))).alias("t")).where("t.start > 1").select(F.col("t.tail").alias("entity"))
    bare = decisions.where("refusal IS NULL AND NOT has_kind").join(covered, "entity", "left_anti").select("entity", "entity", F.lit("schema_declares_entity_model_has_no_kind")).join(shipped.limit(1).select(F.lit(True)), how="left_semi")
    lineage = relationships.where("from_entity = to_entity").where(F.col("via").rlike(LINEAGE))
    met = F.lit(False)
    for name in edge_kinds:
        met = met | F.contains("via", F.lit(name)) | (F.lit(name in LINEAGE_EDGES) & F.contains("via", F.lit("parent")))
    return named.union(ghosts).union(bare).union(lineage.where(~met).select("via", "from_entity", F.lit("schema_relationship_has_no_model_edge_kind")))


def entity_layer(tables: DataFrame, columns: DataFrame, keys: DataFrame, enums: DataFrame, kinds: DataFrame, signals: DataFrame, edge_kinds: Sequence[str] = (), aliases: Mapping[str, str] | None = None) -> EntityLayer:
    decisions = checkpoint(decided(tables, columns, keys, kinds, signals, aliases))
    relationships, refusals = related(tables, columns, keys, enums, decisions, aliases)
    return EntityLayer(decisions, audited(tables, decisions), relationships, refusals, conflicting(decisions, kinds, relationships, edge_kinds))
