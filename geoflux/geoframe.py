"""GeoFrame and GeoColumn: the habits of geometry tables in memory, over lazy frames."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .frame import Frame
from .functions import call


class GeoColumn:
    """A geometry column of a frame: measures are properties, operations give columns of the same frame."""

    def __init__(self, frame: Frame, column: Column):
        self.frame, self.column = frame, column

    def _geo(self, name: str, *args: Any) -> GeoColumn:
        return GeoColumn(self.frame, call(name, self.column, *[a.column if isinstance(a, GeoColumn) else F.lit(a) for a in args]))

    area = property(lambda self: call("st_area", self.column))
    length = property(lambda self: call("st_length", self.column))
    is_valid = property(lambda self: call("st_isvalid", self.column))
    is_empty = property(lambda self: call("st_isempty", self.column))
    geom_type = property(lambda self: call("st_geometrytype", self.column))
    x = property(lambda self: call("st_x", self.column))
    y = property(lambda self: call("st_y", self.column))
    crs = property(lambda self: call("st_crs", self.column))
    bounds = property(lambda self: call("geoflux_bounds", self.column))
    centroid = property(lambda self: self._geo("st_centroid"))
    envelope = property(lambda self: self._geo("st_envelope"))
    convex_hull = property(lambda self: self._geo("st_convexhull"))
    boundary = property(lambda self: self._geo("st_boundary"))

    def buffer(self, distance: float) -> GeoColumn:
        return self._geo("st_buffer", float(distance))

    def simplify(self, tolerance: float) -> GeoColumn:
        return self._geo("st_simplifypreservetopology", float(tolerance))

    def to_crs(self, crs: str | int) -> GeoColumn:
        return self._geo("st_transform", str(crs))

    def set_crs(self, crs: str | int) -> GeoColumn:
        return self._geo("st_setcrs", str(crs))

    def __getattr__(self, name: str):
        """intersects, contains, distance, intersection, ...: functions of two geometries."""
        full = {"difference": "st_difference", "symmetric_difference": "st_symdifference", "covered_by": "st_coveredby"}.get(name, "st_" + name)
        from .functions import FUNCTIONS

        if full not in FUNCTIONS:
            raise AttributeError(name)

        def function(*others: Any):
            made = self._geo(full, *others)
            return made if FUNCTIONS[full][0] == "binary" else made.column

        return function


class GeoFrame(Frame):
    """A frame with an active geometry column."""

    def __init__(self, frame: Frame, geometry: str = "geometry"):
        super().__init__(frame.ctx, frame.df)
        self._known(geometry)
        self._geometry = geometry

    @property
    def geometry(self) -> GeoColumn:
        return GeoColumn(self, self.df[self._geometry])

    def set_geometry(self, geometry: str | GeoColumn) -> GeoFrame:
        if isinstance(geometry, GeoColumn):
            return GeoFrame(self._new(self.df.withColumn(self._geometry, geometry.column)), self._geometry)
        return GeoFrame(self, geometry)

    def to_crs(self, crs: str | int) -> GeoFrame:
        return self.set_geometry(self.geometry.to_crs(crs))

    def sjoin(self, other: GeoFrame, how: str = "inner", predicate: str = "intersects") -> GeoFrame:
        return GeoFrame(self.spatial_join(other, predicate, left_geom=self._geometry, right_geom=other._geometry, how=how), self._geometry)

    def dissolve(self, by: str) -> GeoFrame:
        return GeoFrame(self.group_by(by).agg(**{self._geometry: call("st_union_agg", self.df[self._geometry])}), self._geometry)
