"""Folds over each key's rows in order, for states that hang on the row before: rows stream through tasks, and a task holds one key's state only."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame


def folded(df: DataFrame, key: str, order: list[str], start: Callable[[], object], step: Callable, out: dict[str, str]) -> DataFrame:
    """df's columns and those of out (name -> "string" or "boolean"), row by row from step(state, row tuple) -> (state, values).

    Rows are dealt by key and sorted within tasks, never grouped, so that a key with very many rows costs time in its task but no memory.
    """
    names = df.columns
    kinds = {"string": pa.string(), "boolean": pa.bool_()}
    at = names.index(key)

    def run(batches):
        current, state = object(), None
        for batch in batches:
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[at] != current:
                    current, state = row[at], start()
                state, values = step(state, row)
                found.append(values)
            columns = [pa.array([v[k] for v in found], kinds[kind]) for k, kind in enumerate(out.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *out])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"`{n}` {kind}" for n, kind in out.items()])
    return df.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)
