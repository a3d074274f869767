"""Attribute-value rows into one wide row per entity.

The entity-by-attribute grid is completed (each entity takes every attribute of
the dictionary, no cross join), the values are left joined, collected into one
array sorted by attribute position, and fixed indices of it are projected
through casts of each attribute's own type.

Cases: rows with a null entity key or attribute are left out, attributes not in
the dictionary too; a null or non-finite value counts as no value; repeated
values are one; of different values for one cell the first received wins and the
attribute is listed in ``conflicts``; values that do not fit the type give null;
attributes whose names clash with keys get the prefix ``attr_``; an empty input
gives an empty table with the dictionary's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ATTRIBUTES = 1000


def dictionary(rows: DataFrame, attribute: str = "attribute") -> list[str]:
    """The attributes that occur, sorted; more than a table can have as columns
    (``MAX_ATTRIBUTES``) is an error, so the driver gets a bounded list."""
    found = rows.select(attribute).filter(F.col(attribute).isNotNull()).distinct().limit(MAX_ATTRIBUTES + 1).collect()
    if len(found) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes: name the wanted ones")
    return sorted(r[0] for r in found)


def cells(rows: DataFrame, entity: list[str], received: list[str]) -> DataFrame:
    """(entity, attribute, cell, differing): one row per cell, from ``rows`` with
    entity, attribute, value and the order of receipt; map-side combined."""
    wanted = F.col("attribute").isNotNull() & F.col("value").isNotNull()
    for k in entity:
        wanted = wanted & F.col(k).isNotNull()
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    return (
        rows.filter(wanted & finite)
        .groupBy(*entity, "attribute")
        .agg(
            F.min(F.struct(*received, F.col("value").alias("_v"))).alias("_first"),
            (F.min("value") < F.max("value")).alias("differing"),
        )
        .select(*entity, "attribute", F.col("_first._v").alias("cell"), "differing")
    )


def wide(
    rows: DataFrame,
    entity: list[str],
    attributes: list[str],
    received: list[str],
    types: dict[str, str] | None = None,
) -> DataFrame:
    """One row per entity, a column per attribute, and ``conflicts``: the sorted
    attributes of the entity with two or more different values."""
    types = types or {}
    value = cells(rows, entity, received)
    if attributes:
        value = value.filter(F.col("attribute").isin(*attributes))
    else:
        value = value.limit(0)
    dictionary_rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(i).alias("i")) for i, a in enumerate(attributes)] or [
        F.struct(F.lit("").alias("a"), F.lit(0).alias("i"))
    ])
    grid = value.select(*entity).distinct().select(*entity, F.explode(dictionary_rows).alias("_g")).select(
        *entity, F.col("_g.a").alias("attribute"), F.col("_g.i").alias("position")
    )
    joined = grid.join(value, [*entity, "attribute"], "left")
    packed = joined.groupBy(*entity).agg(
        F.sort_array(F.collect_list(F.struct("position", "attribute", "cell", "differing"))).alias("_row")
    )
    taken = set(entity) | {"conflicts"}
    columns = []
    for i, a in enumerate(attributes):
        name = f"attr_{a}" if a in taken else a
        cell = F.col("_row")[i]["cell"]
        kind = types.get(a, "double")
        columns.append((cell if kind == "double" else cell.cast("string").try_cast("decimal(38,6)").try_cast(kind)).alias(name))
    conflicts = F.transform(F.filter("_row", lambda x: F.coalesce(x["differing"], F.lit(False))), lambda x: x["attribute"])
    return packed.select(*entity, *columns, F.array_sort(conflicts).alias("conflicts"))
