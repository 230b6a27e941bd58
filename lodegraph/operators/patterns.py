"""Membership patterns: JSON expressions, validated and compiled to one Column.

Leaves are edge_exists, fact_kind_present, field_equals, field_in and field_set_equals; `and`,
`or` and `not` combine them to a depth of six. The logic has two values: a field or an edge that is
missing makes a leaf false. A compiled pattern is evaluated by one scan of the subject view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.graph import both_ways

MOST_DEPTH = 6
#: Leaf to its fields: those it must have, and those it may have.
LEAVES = {
    "edge_exists": ({"direction", "relation"}, {"kind"}),
    "fact_kind_present": ({"kind"}, set()),
    "field_equals": ({"path", "value"}, set()),
    "field_in": ({"path", "values"}, set()),
    "field_set_equals": ({"path", "values"}, set()),
}


class PatternError(ValueError):
    """A pattern of the wrong shape; `place` says where."""

    def __init__(self, place: str, reason: str):
        super().__init__(f"{place}: {reason}")
        self.place, self.reason = place, reason


def _scalar(value: object) -> bool:
    return value is None or isinstance(value, (str, int, float, bool))


def validate(pattern: object, depth: int = 1, place: str = "$") -> None:
    """Raise PatternError unless `pattern` is one operator with a body of its shape."""
    if depth > MOST_DEPTH:
        raise PatternError(place, f"deeper than {MOST_DEPTH}")
    if not isinstance(pattern, dict) or len(pattern) != 1:
        raise PatternError(place, "one operator expected")
    name, body = next(iter(pattern.items()))
    place = f"{place}.{name}"
    if name in ("and", "or"):
        if not isinstance(body, list) or not body:
            raise PatternError(place, "a list of patterns expected")
        for i, part in enumerate(body):
            validate(part, depth + 1, f"{place}[{i}]")
    elif name == "not":
        validate(body, depth + 1, place)
    elif name in LEAVES:
        must, may = LEAVES[name]
        if not isinstance(body, dict) or not must <= set(body) <= must | may:
            raise PatternError(place, f"fields {sorted(must)} expected")
        for field in ("direction", "relation", "kind", "path"):
            if field in body and not (isinstance(body[field], str) and body[field]):
                raise PatternError(f"{place}.{field}", "a name expected")
        if body.get("direction", "in") not in ("in", "out"):
            raise PatternError(f"{place}.direction", "in or out expected")
        if not _scalar(body.get("value")) or not (isinstance(body.get("values", []), list) and all(map(_scalar, body.get("values", [])))):
            raise PatternError(place, "scalar values expected")
    else:
        raise PatternError(place, "unknown operator")


def subject_view(nodes: DataFrame, edges: DataFrame, fields: DataFrame, key: str = "node_id") -> DataFrame:
    """`fields` with seen: the distinct (direction, relation, kind) of each subject's edges, as many as registries allow."""
    kinds = nodes.select(F.col("node_id").alias("other"), F.col("kind").alias("other_kind"))
    return viewed(both_ways(edges).join(kinds, "other").select(F.col("node").alias(key), "direction", "relation", F.col("other_kind").alias("kind")), fields, key)


def viewed(seen: DataFrame, fields: DataFrame, key: str = "node_id") -> DataFrame:
    """`fields` with seen, from rows (key, direction, relation, kind) of edges; they may leave out edges that no leaf asks for."""
    listed = seen.distinct().groupBy(key).agg(F.collect_list(F.struct("direction", "relation", "kind")).alias("seen"))
    return fields.join(listed, key, "left")


def _leaf(name: str, body: dict) -> Column:
    if name == "fact_kind_present":
        name, body = "edge_exists", {"direction": "out", "relation": "contains", **body}
    if name == "edge_exists":
        wanted = [(k, body[k]) for k in ("direction", "relation", "kind") if k in body]

        def fits(edge: Column) -> Column:
            out = F.lit(True)
            for field, value in wanted:
                out = out & (edge[field] == value)
            return out

        return F.exists("seen", fits)
    field = F.col(body["path"])
    if name == "field_equals":
        return field.eqNullSafe(F.lit(body["value"]))
    values = F.array(*map(F.lit, body["values"]))
    if name == "field_in":
        return F.arrays_overlap(F.array(field) if not body.get("_array") else field, values)
    return F.array_sort(F.array_distinct(field)) == F.array_sort(F.array_distinct(values))


def compiled(pattern: dict, arrays: frozenset[str] = frozenset()) -> Column:
    """The pattern as a boolean Column that is never null; `arrays` names the paths that hold arrays."""
    validate(pattern)

    def build(part: dict) -> Column:
        name, body = next(iter(part.items()))
        if name == "not":
            return ~build(body)
        if name in ("and", "or"):
            out = build(body[0])
            for more in body[1:]:
                out = (out & build(more)) if name == "and" else (out | build(more))
            return out
        return F.coalesce(_leaf(name, {**body, "_array": body.get("path") in arrays}), F.lit(False))

    return build(pattern)


def evaluated(subjects: DataFrame, key: str, concepts: dict[str, dict], known: Column, closed_world: bool, arrays: frozenset[str] = frozenset()) -> DataFrame:
    """Rows (key, concept, outcome) of every subject and concept, in one scan: member, not_member or abstain."""
    outcomes = [F.struct(F.lit(name).alias("concept"), F.when(compiled(p, arrays), "member").when(F.lit(closed_world) & known, "not_member").otherwise("abstain").alias("outcome")) for name, p in concepts.items()]
    return subjects.select(key, F.explode(F.array(*outcomes)).alias("o")).select(key, "o.*")
