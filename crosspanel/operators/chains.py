"""Chains: what is chosen at a slot depends on what was chosen before.

Rows of a chain are sorted by Spark, which spills, and read once, in order, in Arrow batches; between
them only the chain's state is held, whatever the length of the calendar.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Takes the state (None at a chain's start) and a row; returns the new state and the rows to put out.
Step = Callable[[object, dict], tuple[object, list[tuple]]]


def carried(frame: DataFrame, by: list[str], order: list[str], step: Step, schema: str) -> DataFrame:
    """The rows that ``step`` puts out while it goes through each chain (the rows of one ``by``) in order.
    Without ``by`` all rows are one chain, and one task reads them."""
    dealt = frame.repartition(*by).sortWithinPartitions(*by, *order) if by else frame.repartition(1).sortWithinPartitions(*order)
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):  # noqa: ANN001, ANN202
        chain, state = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if (key := tuple(row[c] for c in by)) != chain:
                    chain, state = key, None
                state, more = step(state, row)
                out += more
            columns = zip(*out, strict=True) if out else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return dealt.mapInArrow(run, schema)
