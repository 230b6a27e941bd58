"""What relations and node kinds mean. Unknown ones are kept and counted as `unclassified`."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: relation -> (role, end that is the parent; None where the relation isn't structural)
RELATIONS: dict[str, tuple[str, str | None]] = {
    "contains": ("structural", "from"),
    "member_of": ("structural", "to"),
    "depends_on": ("flow", None),
    "emits": ("flow", None),
}
#: node kind -> plane
PLANES: dict[str, str] = {"Region": "entity", "Nation": "entity", "Customer": "entity", "Supplier": "entity", "Part": "entity", "Order": "observation"}
UNCLASSIFIED = "unclassified"


def looked_up(key: Column, table: dict[str, str | None], default: str | None) -> Column:
    """A registry lookup inside the expression, so that no join is needed."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def role_of(relation: Column) -> Column:
    return looked_up(relation, {k: v[0] for k, v in RELATIONS.items()}, UNCLASSIFIED)


def parent_end_of(relation: Column) -> Column:
    return looked_up(relation, {k: v[1] for k, v in RELATIONS.items() if v[1]}, None)


def plane_of(kind: Column) -> Column:
    return looked_up(kind, PLANES, UNCLASSIFIED)
