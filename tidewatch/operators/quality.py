"""Guards the schema promises: enums, ranges, unique keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tidewatch.functions.scoring import enum_guard


def guard_enums(df: DataFrame, allowed: Mapping[str, Sequence[str]], defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Values outside the allowed set become NULL, or the column's default."""
    defaults = defaults or {}
    return df.withColumns({c: enum_guard(F.col(c), values, defaults.get(c)) for c, values in allowed.items()})


def enum_violations(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """One row: how many non-null values each guarded column would lose."""
    return df.agg(*[F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(*v)).alias(f"{c}_violations") for c, v in allowed.items()])


def range_violations(df: DataFrame, columns: Sequence[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    return df.agg(*[F.count_if(~F.col(c).between(low, high)).alias(f"{c}_out_of_range") for c in columns])


def duplicate_active_models(models: DataFrame) -> DataFrame:
    """Model names with more than one active row."""
    return (
        models.groupBy("name")
        .agg(F.count_if("is_active").alias("n_active"))
        .filter("n_active > 1")
    )


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str], order_by: str | Sequence[str]) -> DataFrame:
    """New rows whose key is not there yet; the first one per key wins, ties by all columns.

    Rows whose key is there are dropped first, so that Spark can move that join below the columns
    that are costly to make, and only what is new is folded.  The first row per key is a minimum,
    which combines on the map side, so a hot key that is new never gathers in one task; one that is
    there is left to Spark's skew handling.  Null parts of a key equal each other.  With map
    columns, which have no order, ``order_by`` alone decides.
    """
    cols = new.columns
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    ordered = not any(isinstance(f.dataType, MapType) for f in new.schema.fields)
    present = existing.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]).distinct()
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)])
    absent = new.join(present, same, "left_anti")
    rank = [F.col(c).alias(f"_order{i}") for i, c in enumerate(order)]
    row = F.struct(*cols).alias("_row")
    # With all columns in the rank the row need not travel beside it.
    first = F.min(F.struct(*rank, row))["_row"] if ordered else F.min_by(row, F.struct(*rank))
    return absent.groupBy(*keys).agg(first.alias("_row")).select("_row.*")
