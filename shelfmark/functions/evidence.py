"""Canonical JSON text of evidence, and rank columns for closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_value(value: Column) -> Column:
    """JSON text of one value. ``to_json`` takes no scalars, so it is wrapped and unwrapped."""
    return F.coalesce(F.regexp_replace(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", "$1"), F.lit("null"))


def canonical_json(always: dict[str, Column] | None = None, optional: dict[str, Column] | None = None) -> Column:
    """Compact JSON object with sorted keys, or null when it would be empty.

    ``always`` keys are kept with a JSON null; ``optional`` keys are left out when null.
    """
    always, optional = always or {}, optional or {}
    members = []
    for key in sorted({*always, *optional}):
        if key in always:
            members.append(F.concat(F.lit(f'"{key}":'), json_value(always[key])))
        else:
            members.append(F.when(optional[key].isNotNull(), F.concat(F.lit(f'"{key}":'), json_value(optional[key]))))
    body = F.array_join(F.array_compact(F.array(*members)), ",")
    return F.when(body != "", F.concat(F.lit("{"), body, F.lit("}")))


def rank_in(value: Column, order) -> Column:
    """Position of the value in a declared order, for sorting; unknown values come last."""
    ranks = [F.lit(x) for i, v in enumerate(order) for x in (v, i)]
    return F.coalesce(F.try_element_at(F.create_map(*ranks), value), F.lit(len(order)))
