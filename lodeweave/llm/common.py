"""Helpers shared by the corpus operators: Arrow mapping, shared-folder tables, text units."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import stored  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def map_batches(df: DataFrame, schema: str, fn: Callable[..., dict | None]) -> DataFrame:
    """mapInArrow with fn(column lists...) -> {output column: list or array}; None or empty adds no rows."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            out = fn(*(c.to_pylist() for c in b.columns))
            if out:
                arrays = [pa.array(out[f.name], type=f.type) for f in arrow]
                if len(arrays[0]):
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, struct)


INVISIBLE = re.compile("[­​-‏ -‮⁠-⁤⁦-⁩﻿]")
