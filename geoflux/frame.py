"""A lazy frame with strict, spatially aware verbs over a Spark DataFrame."""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import distance_join, knn_join, spatial_join

if TYPE_CHECKING:
    from .session import Context

JOINS = {
    "inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "left_semi": "left_semi", "semi": "left_semi",
    "left_anti": "left_anti", "anti": "left_anti", "right_semi": "right_semi", "right_anti": "right_anti",
}


class Frame:
    def __init__(self, ctx: Context, df: DataFrame):
        self.ctx, self.df = ctx, df

    # -- columns

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self):
        return self.df.schema

    def __getitem__(self, key: str | int) -> Column:
        if isinstance(key, bool) or not isinstance(key, (str, int)):
            raise TypeError("columns are picked by name or position")
        return self.df[self._known(key) if isinstance(key, str) else self.columns[key]]

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_") or name not in self.df.columns:
            raise AttributeError(name)
        return self.df[name]

    def _known(self, name: str) -> str:
        if name not in self.columns:
            raise KeyError(f"no column {name!r}; there are {', '.join(self.columns)}")
        return name

    def _col(self, c: Any) -> Column:
        return self.df[self._known(c)] if isinstance(c, str) else c

    def _new(self, df: DataFrame) -> Frame:
        return Frame(self.ctx, df)

    # -- rows and columns

    def select(self, *exprs: Any, **named: Any) -> Frame:
        if not exprs and not named:
            raise ValueError("select needs a column")
        return self._new(self.df.select(*map(self._col, exprs), *[self._value(v).alias(k) for k, v in named.items()]))

    def _value(self, v: Any) -> Column:
        return v if isinstance(v, Column) else self._col(v) if isinstance(v, str) else F.lit(v)

    def mutate(self, *exprs: Column, **named: Any) -> Frame:
        """All values see the input; known names are replaced in place, new ones follow. Positional ones are named by their alias."""
        own = dict(zip(self.df.select(*exprs).columns, exprs, strict=True)) if exprs else {}
        return self._new(self.df.withColumns(own | {k: self._value(v) for k, v in named.items()}))

    def rename(self, **new_from_old: str) -> Frame:
        return self._new(self.df.withColumnsRenamed({self._known(old): new for new, old in new_from_old.items()}))

    def drop(self, *names: str) -> Frame:
        return self._new(self.df.drop(*map(self._known, names)))

    def filter(self, *predicates: Column) -> Frame:
        if not predicates or not all(isinstance(p, Column) for p in predicates):
            raise TypeError("filter takes boolean columns")
        return self._new(self.df.filter(reduce(lambda a, b: a & b, predicates)))

    def alias(self, name: str) -> Frame:
        return self._new(self.df.alias(name))

    def unnest(self, *names: str) -> Frame:
        """Arrays to rows, several in parallel; shorter ones are filled with nulls."""
        zipped = F.explode(F.arrays_zip(*[F.col(self._known(n)) for n in names])).alias("_z")
        rows = self.df.select(*[c for c in self.columns if c not in names], zipped)
        return self._new(rows.select(*[F.col(f"_z.`{c}`").alias(c) if c in names else F.col(c) for c in self.columns]))

    def sort(self, *keys: Any) -> Frame:
        """Nulls last, unless a key says otherwise."""
        return self._new(self.df.orderBy(*[self._col(k).asc_nulls_last() if isinstance(k, str) or "ASC NULLS" not in str(k) and "DESC NULLS" not in str(k) else k for k in keys]))

    def limit(self, n: int, offset: int = 0) -> Frame:
        return self._new((self.df.offset(offset) if offset else self.df).limit(n))

    def head(self, n: int = 5) -> Frame:
        return self.limit(n)

    # -- groups

    def agg(self, *exprs: Column, **named: Column) -> Frame:
        if not exprs and not named:
            raise ValueError("agg needs an aggregate")
        return self._new(self.df.agg(*exprs, *[v.alias(k) for k, v in named.items()]))

    def group_by(self, *keys: Any) -> Grouped:
        return Grouped(self, [self._col(k) for k in keys])

    def distinct(self) -> Frame:
        return self._new(self.df.distinct())

    def distinct_on(self, *names: str) -> Frame:
        return self._new(self.df.dropDuplicates([self._known(n) for n in names]))

    # -- joins

    def join(self, other: Frame, on: Any, how: str = "inner") -> Frame:
        """Names merge their key columns (right keeps the right key, outer the first that is not null); expressions keep both sides."""
        if how not in JOINS:
            raise ValueError(f"not a kind of join: {how}")
        keys = on if isinstance(on, (list, tuple)) else [on]
        if len({isinstance(k, str) for k in keys}) != 1:
            raise TypeError("join keys are all names or all expressions")
        kind = JOINS[how]
        if kind.startswith("right_"):
            return other.join(self, on, "left_" + kind.removeprefix("right_"))
        cond = [self._known(k) and other._known(k) for k in keys] if isinstance(keys[0], str) else reduce(lambda a, b: a & b, keys)
        return self._new(self.df.join(other.df, cond, kind))

    def cross_join(self, other: Frame) -> Frame:
        return self._new(self.df.crossJoin(other.df))

    def spatial_join(self, other: Frame, predicate: str = "intersects", **how: Any) -> Frame:
        return self._new(spatial_join(self.df, other.df, predicate, **how))

    def distance_join(self, other: Frame, distance: Any, **how: Any) -> Frame:
        return self._new(distance_join(self.df, other.df, distance, **how))

    def knn_join(self, other: Frame, k: int = 1, **how: Any) -> Frame:
        return self._new(knn_join(self.df, other.df, k, **how))

    # -- sets

    def _same(self, other: Frame) -> DataFrame:
        if self.columns != other.columns:
            raise ValueError(f"set operations need the same columns in the same order: {self.columns} and {other.columns}")
        return other.df

    def union(self, other: Frame) -> Frame:
        return self._new(self.df.union(self._same(other)))

    def union_distinct(self, other: Frame) -> Frame:
        return self._new(self.df.union(self._same(other)).distinct())

    def intersect(self, other: Frame) -> Frame:
        return self._new(self.df.intersectAll(self._same(other)))

    def intersect_distinct(self, other: Frame) -> Frame:
        return self._new(self.df.intersect(self._same(other)))

    def except_distinct(self, other: Frame) -> Frame:
        return self._new(self.df.subtract(self._same(other)))

    # -- results

    def to_view(self, name: str, overwrite: bool = False) -> None:
        (self.df.createOrReplaceTempView if overwrite else self.df.createTempView)(name)

    def to_memtable(self) -> Frame:
        return self._new(self.df.persist())

    def count(self) -> int:
        return self.df.count()

    def execute(self) -> int:
        self.df.write.format("noop").mode("overwrite").save()
        return self.df.count()

    def collect(self) -> list:
        return self.df.collect()

    def show(self, n: int = 10, width: int = 40) -> None:
        """Binary geometries are shown as text."""
        from .functions import call

        shown = [call("st_astext", F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() == "binary" and f.name.lower().startswith("geo") else F.col(f"`{f.name}`") for f in self.schema]
        self.df.select(*shown).show(n, width)

    def explain(self, mode: str = "formatted") -> None:
        self.df.explain(mode)

    def to_pandas(self):
        return self.df.toPandas()

    def to_arrow_table(self):
        return self.df.toArrow()

    def to_arrow_reader(self):
        """Record batches, a partition at a time: the driver never holds all rows."""
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        def packed(batches):
            for batch in batches:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as w:
                    w.write_batch(batch)
                yield pa.RecordBatch.from_pydict({"b": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        schema = to_arrow_schema(self.df.schema)
        rows = self.df.mapInArrow(packed, "b binary").toLocalIterator()
        return pa.RecordBatchReader.from_batches(schema, (pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema, strict=True)], schema=schema) for r in rows for b in pa.ipc.open_stream(r.b)))

    def to_parquet(self, path: str, **options: Any) -> None:
        from .sources.geoparquet import write

        write(self.df, path, **options)

    def to_csv(self, path: str, has_header: bool = True, delimiter: str = ",") -> None:
        from .sources import text_geometries

        text_geometries(self.df).write.csv(path, header=has_header, sep=delimiter)

    def to_json(self, path: str) -> None:
        from .sources import text_geometries

        text_geometries(self.df).write.json(path)

    def to_geojson(self, path: str, geometry: str = "geometry") -> None:
        from .sources.geojson import write

        write(self.df, path, geometry)


class Prepared:
    """A query whose parameters are still to be given."""

    def __init__(self, ctx: Context, query: str):
        self.ctx, self.query = ctx, query

    def with_params(self, *values: Any, **named: Any) -> Frame:
        if values and named:
            raise ValueError("parameters are given by position or by name")
        return self.ctx.sql(self.query, named or list(values))


class Grouped:
    def __init__(self, frame: Frame, keys: list[Column]):
        self.frame, self.keys = frame, keys

    def agg(self, *exprs: Column, **named: Column) -> Frame:
        if not exprs and not named:
            raise ValueError("agg needs an aggregate")
        return self.frame._new(self.frame.df.groupBy(*self.keys).agg(*exprs, *[v.alias(k) for k, v in named.items()]))
