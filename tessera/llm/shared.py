"""Id columns without nulls, and measures of texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..storage import new_folder, saved, shared_dir
from . import words as tw

__all__ = ["NO_ID", "map_arrow", "map_texts", "new_folder", "quoted", "saved", "shared_dir", "solid_id"]

#: Stands in for a null id inside joins and orderings, where it sorts first.
NO_ID = -(2**63)


def solid_id(name: str) -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def _array(values) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values)


def map_arrow(rows: DataFrame, value: Column, measure: Callable, columns: dict[str, str], keep: list[str] | None = None, cut: Callable | None = None) -> DataFrame:
    """The columns keep of rows (None: all) and new ones that measure computes from Arrow arrays of value.

    measure returns {column: values}. A kept column whose name is in columns is replaced.
    cut takes the batches (columns _row, _value) and returns them in other sizes.
    """
    keep = [c for c in (rows.columns if keep is None else keep) if c not in columns]
    row = F.struct(*(quoted(c) for c in keep)) if keep else F.struct(F.lit(None).alias("_none"))
    inside = rows.select(row.alias("_row"), value.alias("_value"))
    schema = StructType([inside.schema["_row"], *(StructField(c, _parse_datatype_string(k)) for c, k in columns.items())])

    def run(batches):
        for batch in cut(batches) if cut else batches:
            found = measure(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(_array(found[c]) for c in columns)], names=["_row", *columns])

    return inside.mapInArrow(run, schema).select(*(quoted("_row").getField(c).alias(c) for c in keep), *columns)


def map_texts(docs: DataFrame, text: str, measure: Callable, columns: dict[str, str], keep: list[str] | None = None, most: int = tw.PASS_BYTES) -> DataFrame:
    """As map_arrow, from blocks of texts of about that many bytes."""
    return map_arrow(docs, quoted(text).cast("string"), measure, columns, keep, lambda batches: tw.passes(batches, "_value", most))
