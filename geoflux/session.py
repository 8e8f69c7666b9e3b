"""The entry point: a session with spatial functions, readers and lazy frames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from . import functions as st
from . import jvm
from .frame import Frame, Prepared
from .ship import ship


class Context:
    """A thin view of a SparkSession. Frames are lazy; Catalyst plans all of it."""

    def __init__(self, spark: SparkSession | None = None):
        self.spark = spark or SparkSession.builder.getOrCreate()
        st.register(ship(self.spark))
        from .sources import Reader
        from .sources.random_geometry import register as register_random

        register_random(self.spark)
        self.read = Reader(self)
        self._udfs: dict[str, Any] = {}

    def sql(self, query: str, params: list | dict | tuple | None = None) -> Frame | Prepared:
        """SQL with ``?`` / ``:name`` parameters; ``$1`` and ``$name`` are understood as well. What else stands beside ST_KNN holds of
        the neighbours that it finds. With parameters ``$1`` or ``$name`` but no values the result waits for ``with_params``."""
        import re

        found = re.compile(r"'(?:[^']|'')*'|\$(\w+)")  # not in string literals
        if not params and any(m[1] for m in found.finditer(query)):
            return Prepared(self, query)
        if params:
            if isinstance(params, dict):
                query = found.sub(lambda m: f":{m[1]}" if m[1] else m[0], query)
            elif order := [int(m[1]) for m in found.finditer(query) if m[1]]:
                query, params = found.sub(lambda m: "?" if m[1] else m[0], query), [params[i - 1] for i in order]
        df = self.spark.sql(query, args=params or None)
        if "st_knn" in query.lower():
            df = DataFrame(jvm.static(self.spark, "geoflux.Plan", "rewritten", [df._jdf]), self.spark)
        return Frame(self, df)

    def frame(self, df: DataFrame) -> Frame:
        return Frame(self, df)

    def create_data_frame(self, data: Any, schema: Any = None) -> Frame:
        """From pandas, Arrow tables, record-batch readers, rows or a DataFrame; GeoSeries-like columns with to_wkb become WKB."""
        if isinstance(data, DataFrame):
            return Frame(self, data)
        if hasattr(data, "read_all"):
            data = data.read_all()
        if hasattr(data, "to_wkb") and hasattr(data, "columns"):
            data = data.to_wkb()
        return Frame(self, self.spark.createDataFrame(data, schema) if schema is not None else self.spark.createDataFrame(data))

    def view(self, name: str) -> Frame:
        return Frame(self, self.spark.table(name))

    table = view

    def drop_view(self, name: str) -> bool:
        return self.spark.catalog.dropTempView(name)

    def register(self, component: Any, name: str | None = None) -> None:
        """A scalar or aggregate UDF (see ``geoflux.functions.udf``), a Python data source, or a raster loader."""
        from pyspark.sql.datasource import DataSource

        if isinstance(component, type) and issubclass(component, DataSource):
            self.spark.dataSource.register(component)
        elif hasattr(component, "supports_format") and hasattr(component, "load"):
            from .sources import raster

            raster.LOADERS[getattr(component, "name", type(component).__name__)] = component
        else:
            self.spark.udf.register(name or getattr(component, "name", None) or component.__name__, getattr(component, "column_function", component))

    def __getattr__(self, name: str):
        if name.startswith(("read_",)):
            return getattr(self.read, name.removeprefix("read_"))
        raise AttributeError(name)


def connect(spark: SparkSession | None = None) -> Context:
    return Context(spark)
