"""Order-dependent folds over groups, one group in memory at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def fold(df: DataFrame, by: list[str], order: list[str], of_group: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """of_group over the rows of each group in order. Groups are dealt by key and sorted by Spark; a worker streams
    through its partition, so many small groups cost no call each and a large one holds nothing but itself."""
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            out: list[tuple] = []
            for r in b.to_pylist():
                if held and any(r[c] != held[0][c] for c in by):
                    out += of_group(held)
                    held = []
                held.append(r)
            if out:
                yield packed(out)
        if held and (out := of_group(held)):
            yield packed(out)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)
