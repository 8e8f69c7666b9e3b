"""Spatial functions as Columns: ``from geoflux import functions as st; st.st_area("geom")``.

Every registered function is here under its lower-case name. ``register``
makes the same names known to SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import AGGREGATES, DOCUMENTED, EXPRESSIONS, FUNCTIONS, RASTER_TYPE, register

__all__ = ["AGGREGATES", "DOCUMENTED", "EXPRESSIONS", "FUNCTIONS", "RASTER_TYPE", "call", "lit", "register"]


def _column(c) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


def lit(value, crs: str | int | None = None) -> Column:
    """A literal. Objects with ``wkb`` (or one-element series of them with ``to_wkb``) become geometries, with their ``crs`` if they have one."""
    if hasattr(value, "to_wkb"):
        crs = crs if crs is not None else getattr(value, "crs", None)
        value = value.to_wkb()
        value = bytes(value.iloc[0] if hasattr(value, "iloc") else value)
    elif hasattr(value, "wkb"):
        value = bytes(value.wkb)
    else:
        return F.lit(value)
    g = F.lit(value)
    if crs is None:
        return call("st_geomfromwkb", g)
    code = crs.to_authority() if hasattr(crs, "to_authority") else None
    return call("st_geomfromwkb", g, F.lit(":".join(code) if code else str(crs)))


def call(name: str, *args) -> Column:
    """A call by name. Strings are column names; other Python values are literals."""
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    if session is not None:
        register(session)
    return F.call_function(name, *map(_column, args))


def __getattr__(name: str):
    if name in FUNCTIONS or name in EXPRESSIONS or name in AGGREGATES:

        def function(*args) -> Column:
            return call(name, *args)

        function.__name__ = name
        return function
    raise AttributeError(name)


def __dir__() -> list[str]:
    return sorted([*__all__, *FUNCTIONS, *EXPRESSIONS, *AGGREGATES])
