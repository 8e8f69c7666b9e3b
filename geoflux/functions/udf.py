"""User-defined functions over Arrow arrays, scalar and aggregate, that ``Context.register`` takes."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ScalarUdf:
    def __init__(self, fn: Callable, return_type: Any, name: str, volatile: bool):
        self.name = name
        made = F.arrow_udf(fn, return_type)
        self.column_function = made.asNondeterministic() if volatile else made

    def __call__(self, *args: Any) -> Column:
        return self.column_function(*[F.col(a) if isinstance(a, str) else a for a in args])


def arrow_udf(return_type: Any, volatility: str = "immutable", name: str | None = None) -> Callable[[Callable], ScalarUdf]:
    """``@arrow_udf("double")`` over pyarrow arrays; volatile functions are kept from being folded or repeated."""
    if volatility not in ("immutable", "stable", "volatile"):
        raise ValueError(f"not a volatility: {volatility}")
    return lambda fn: ScalarUdf(fn, return_type, name or fn.__name__, volatility == "volatile")


class AggregateUdf:
    """A class with ``update(*arrays)``, ``merge(states)``, ``state()`` and ``evaluate()``; states are bytes.

    Aggregation is in two levels: each task folds its rows of a group into a
    state, and only states are shuffled and merged.
    """

    def __init__(self, cls: type, return_type: Any):
        self.cls, self.return_type = cls, return_type

    def over(self, df: DataFrame, keys: list[str], columns: list[str], out: str = "value") -> DataFrame:
        key_type = T.StructType([df.schema[k] for k in keys])
        states = T.StructType([*key_type.fields, T.StructField("_state", T.BinaryType())])
        make = self.cls

        def partial(batches):
            held: dict[tuple, Any] = {}
            for batch in batches:
                group = pa.Table.from_batches([batch])
                order: dict[tuple, list[int]] = {}
                for i, row in enumerate(zip(*[group[k].to_pylist() for k in keys], strict=True) if keys else [()] * batch.num_rows):
                    order.setdefault(row, []).append(i)
                for key, rows in order.items():
                    at = pa.array(rows)
                    held.setdefault(key, make()).update(*[batch.column(c).take(at) for c in columns])
                if len(held) > 100_000:
                    yield _states(held, keys, batch.schema)
                    held = {}
            if held:
                yield _states(held, keys, batch.schema)

        def final(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            acc = make()
            for s in table["_state"].to_pylist():
                acc.merge(s)
            return pa.table({**{k: pa.array([v.as_py()], v.type) for k, v in zip(keys, key, strict=True)}, out: [acc.evaluate()]})

        schema = T.StructType([*key_type.fields, T.StructField(out, T._parse_datatype_string(self.return_type) if isinstance(self.return_type, str) else self.return_type)])
        rows = df.select(*keys, *columns).mapInArrow(partial, states)
        if not keys:

            def whole(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
                return final((), table)

            return rows.withColumn("_k", F.lit(1)).groupBy("_k").applyInArrow(whole, schema)
        return rows.groupBy(*keys).applyInArrow(final, schema)


def _states(held: dict, keys: list[str], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([k[i] for k in held], schema.field(name).type) for i, name in enumerate(keys)]
    return pa.RecordBatch.from_arrays([*columns, pa.array([a.state() for a in held.values()], pa.binary())], names=[*keys, "_state"])


def arrow_aggregate_udf(return_type: Any) -> Callable[[type], AggregateUdf]:
    return lambda cls: AggregateUdf(cls, return_type)


class Fluent:
    """``geo(col).buffer(1).area`` style: names are functions with the prefix, called with the column first."""

    def __init__(self, column: Column | str, prefix: str):
        self._column, self._prefix = column, prefix

    def __getattr__(self, name: str) -> Callable[..., Column]:
        from . import EXPRESSIONS, FUNCTIONS, call

        full = self._prefix + name
        if full not in FUNCTIONS and full not in EXPRESSIONS:
            raise AttributeError(name)
        return lambda *args: call(full, self._column, *args)


def geo(column: Column | str) -> Fluent:
    return Fluent(column, "st_")


def rst(column: Column | str) -> Fluent:
    return Fluent(column, "rs_")
