"""A graph over a star schema: dimension and fact rows are nodes, keys are edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.plans.registry import parent_end_of, plane_of, role_of
from lodegraph.runtime import dealt, tasks_for

#: Code points that one part of a search text may have.
SEARCH_PART = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks the largest table takes; its row count comes from the files' footers."""
    return tasks_for(table(spark, sf_dir, "lineitem").count())


def node_id(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{kind.lower()}:"), (F.col(key) if isinstance(key, str) else key).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (node_id, kind, label, search_text, plane)."""
    labelled = {
        "Region": ("region", "r_regionkey", F.col("r_name")),
        "Nation": ("nation", "n_nationkey", F.col("n_name")),
        "Customer": ("customer", "c_custkey", F.col("c_name")),
        "Supplier": ("supplier", "s_suppkey", F.col("s_name")),
        "Part": ("part", "p_partkey", F.col("p_name")),
        "Order": ("orders", "o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"))),
    }
    out = None
    for kind, (name, key, label) in labelled.items():
        part = table(spark, sf_dir, name).select(node_id(kind, key).alias("node_id"), F.lit(kind).alias("kind"), label.alias("label"))
        out = part if out is None else out.union(part)
    search = F.lower(F.concat_ws(" ", F.substring("label", 1, SEARCH_PART), F.col("kind")))
    return out.withColumn("search_text", search).withColumn("plane", plane_of(F.col("kind")))


def edges(spark: SparkSession, sf_dir: str, relations: tuple[str, ...] = ("contains", "member_of", "depends_on", "emits")) -> DataFrame:
    """Rows (edge_id, relation, role, parent_end, src, dst); only the named relations are read. Lines of orders are dealt to tasks of bounded size before equal ones are dropped."""
    made: list[DataFrame] = []

    def add(relation: str, rows: DataFrame, src: Column, dst: Column) -> None:
        made.append(rows.select(F.lit(relation).alias("relation"), src.alias("src"), dst.alias("dst")))

    if "contains" in relations:
        for name, child, key, parent, parent_key in (("nation", "Nation", "n_nationkey", "Region", "n_regionkey"), ("customer", "Customer", "c_custkey", "Nation", "c_nationkey"), ("supplier", "Supplier", "s_suppkey", "Nation", "s_nationkey")):
            add("contains", table(spark, sf_dir, name), node_id(parent, parent_key), node_id(child, key))
    if "member_of" in relations:
        add("member_of", table(spark, sf_dir, "orders"), node_id("Order", "o_orderkey"), node_id("Customer", "o_custkey"))
    for relation, kind, key in (("depends_on", "Order", "l_orderkey"), ("emits", "Supplier", "l_suppkey")):
        if relation in relations:
            add(relation, dealt(table(spark, sf_dir, "lineitem").select(key, "l_partkey"), tasks(spark, sf_dir), key, "l_partkey").distinct(), node_id(kind, key), node_id("Part", "l_partkey"))
    out = made[0]
    for more in made[1:]:
        out = out.union(more)
    relation = F.col("relation")
    return out.select(F.concat_ws("|", "relation", "src", "dst").alias("edge_id"), "relation", role_of(relation).alias("role"), parent_end_of(relation).alias("parent_end"), "src", "dst")


#: The same two tables in SQL, as the start of a WITH clause.
GRAPH_SQL = """
    nodes AS (
        SELECT *, lower(left(label, 512) || ' ' || kind) AS search_text, CASE WHEN kind = 'Order' THEN 'observation' ELSE 'entity' END AS plane FROM (
            SELECT 'region:' || r_regionkey AS node_id, 'Region' AS kind, r_name AS label FROM region
            UNION ALL SELECT 'nation:' || n_nationkey, 'Nation', n_name FROM nation
            UNION ALL SELECT 'customer:' || c_custkey, 'Customer', c_name FROM customer
            UNION ALL SELECT 'supplier:' || s_suppkey, 'Supplier', s_name FROM supplier
            UNION ALL SELECT 'part:' || p_partkey, 'Part', p_name FROM part
            UNION ALL SELECT 'order:' || o_orderkey, 'Order', 'order ' || o_orderkey FROM orders
        )
    ), edges AS (
        SELECT relation || '|' || src || '|' || dst AS edge_id, relation,
               CASE WHEN relation IN ('contains', 'member_of') THEN 'structural' ELSE 'flow' END AS role,
               CASE relation WHEN 'contains' THEN 'from' WHEN 'member_of' THEN 'to' END AS parent_end, src, dst
        FROM (
            SELECT 'contains' AS relation, 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst FROM nation
            UNION ALL SELECT 'contains', 'nation:' || c_nationkey, 'customer:' || c_custkey FROM customer
            UNION ALL SELECT 'contains', 'nation:' || s_nationkey, 'supplier:' || s_suppkey FROM supplier
            UNION ALL SELECT 'member_of', 'order:' || o_orderkey, 'customer:' || o_custkey FROM orders
            UNION ALL SELECT DISTINCT 'depends_on', 'order:' || l_orderkey, 'part:' || l_partkey FROM lineitem
            UNION ALL SELECT DISTINCT 'emits', 'supplier:' || l_suppkey, 'part:' || l_partkey FROM lineitem
        )
    )"""
