"""Reading and writing the open slots of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The metadata keys that belong to the running state.
RUNTIME_KEYS = ["depth", "visited_count", "status", "state", "flags", "source", "halt_reason"]


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def attr(key: str, default=None) -> Column:
    """An attribute; ``label``, ``node_type`` and ``relation`` live in their own columns."""
    if key in ("label", "node_type", "relation"):
        return F.coalesce(F.col(key), _col(default))
    return F.coalesce(F.try_element_at("attrs", F.lit(key)), _col(default))


def metric(key: str, default: float = 0.0) -> Column:
    return F.coalesce(F.try_element_at("metrics", F.lit(key)), _col(default))


def state(key: str, default=None) -> Column:
    """A state value; the key ``status`` reads the pipeline status."""
    if key == "status":
        return F.col("status")
    return F.coalesce(F.try_element_at("state", F.lit(key)), _col(default))


def meta(key: str, default=None) -> Column:
    return F.coalesce(F.try_element_at("meta", F.lit(key)), _col(default))


def put(slot: Column | str, kind: str = "string", **entries) -> Column:
    """``slot`` with ``entries`` set; an existing key is replaced, a null slot counts as empty."""
    slot = F.col(slot) if isinstance(slot, str) else slot
    names = list(entries)
    pairs = [part for name in names for part in (F.lit(name), _col(entries[name]).cast(kind))]
    slot = F.coalesce(slot, F.create_map().cast(f"map<string,{kind}>"))
    kept = F.map_filter(slot, lambda k, _v: ~k.isin(names))
    return F.map_concat(kept, F.create_map(*pairs))


def merge(slot: Column, other: Column) -> Column:
    """Both maps in one; keys of ``other`` win. A null map counts as empty, two give null."""
    kept = F.map_filter(slot, lambda k, _v: ~F.array_contains(F.map_keys(other), k))
    return F.coalesce(F.map_concat(kept, other), slot, other)


def put_state(df: DataFrame, values: Column) -> DataFrame:
    """Bulk state update: the key ``status`` never gets in this way."""
    clean = F.map_filter(values, lambda k, _v: k != "status")
    return df.withColumn("state", merge(F.col("state"), clean))


def flag(key: str, default: bool) -> Column:
    """A boolean kept as text in the state slot."""
    return F.coalesce(F.lower(F.try_element_at("state", F.lit(key))) == "true", F.lit(default))


def build_nodes(df: DataFrame) -> DataFrame:
    """Node defaults from loose columns.

    An empty label falls back to the id; a non-empty ``status`` inside ``state`` becomes
    the pipeline status; the rest of ``state`` stays.
    """
    inner = F.nullif(F.try_element_at("state", F.lit("status")), F.lit(""))
    return (
        df.withColumn("label", F.coalesce(F.nullif("label", F.lit("")), "node_id"))
        .withColumn("status", F.coalesce(inner, F.col("status"), F.lit("")))
        .withColumn("state", F.map_filter("state", lambda k, _v: k != "status"))
    )


def runtime_to_state(df: DataFrame) -> DataFrame:
    """Runtime keys move from the metadata slot to the state slot, where they win."""
    moving = F.map_filter("meta", lambda k, _v: k.isin(RUNTIME_KEYS))
    return df.withColumn("state", merge(F.col("state"), moving)).withColumn(
        "meta", F.map_filter("meta", lambda k, _v: ~k.isin(RUNTIME_KEYS))
    )


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def enrich(df: DataFrame, enrich_ts: Column | float) -> DataFrame:
    """Mark each node once: flag, time stamp, label prefix and score 0.7."""
    fresh = ~flag("enriched", False)
    return df.select(
        *[
            {
                "label": F.when(
                    fresh & ~F.col("label").startswith("[E] "), F.concat(F.lit("[E] "), "label")
                ).otherwise(F.col("label")),
                "state": F.when(fresh, put("state", enriched="true")).otherwise(F.col("state")),
                "attrs": F.when(fresh, put("attrs", enrich_ts=_col(enrich_ts), score="0.7")).otherwise(F.col("attrs")),
            }
            .get(name, F.col(name))
            .alias(name)
            for name in df.columns
        ]
    )
