"""Readers by format, and what they share."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import call

if TYPE_CHECKING:
    from ..frame import Frame

# Fixed file extensions of the formats.
EXTENSIONS = {
    "parquet": "parquet", "geoparquet": "parquet", "csv": "csv", "tsv": "csv", "json": "json", "ndjson": "json", "jsonl": "json", "geojson": "geojson",
    "gpkg": "gpkg", "shp": "shapefile", "las": "las", "zarr": "zarr", "tif": "raster", "tiff": "raster", "orc": "orc",
}


def text_geometries(df: DataFrame) -> DataFrame:
    """Binary columns as WKT, for text formats."""
    return df.select(*[call("st_astext", F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() == "binary" else F.col(f"`{f.name}`") for f in df.schema])


class Reader:
    """``ctx.read(path)`` picks the format by extension; ``ctx.read.<format>(path)`` names it."""

    def __init__(self, ctx):
        self.ctx = ctx

    def __call__(self, paths: str | list[str], **options: Any) -> Frame:
        paths = [paths] if isinstance(paths, str) else list(paths)
        kinds = {p.rstrip("/").rpartition(".")[2].lower() if "." in p.rpartition("/")[2] else "" for p in paths}
        if len(kinds) != 1 or not kinds <= EXTENSIONS.keys():
            raise ValueError(f"the format cannot be told from the extensions {sorted(kinds)}")
        return getattr(self, EXTENSIONS[kinds.pop()])(paths, **options)

    def _frame(self, df: DataFrame) -> Frame:
        return self.ctx.frame(df)

    def parquet(self, paths: str | list[str], **options: Any) -> Frame:
        from .geoparquet import read

        return self._frame(read(self.ctx.spark, paths, **options))

    def csv(self, paths: str | list[str], has_header: bool = True, delimiter: str = ",", schema: Any = None, **options: Any) -> Frame:
        if len(delimiter.encode()) != 1:
            raise ValueError("the delimiter is one byte")
        r = self.ctx.spark.read.options(**options)
        r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
        return self._frame(r.csv(paths, header=has_header, sep=delimiter))

    def json(self, paths: str | list[str], schema: Any = None, **options: Any) -> Frame:
        return self._frame(self.ctx.spark.read.options(**options).json(paths, schema=schema))

    def orc(self, paths: str | list[str], **options: Any) -> Frame:
        return self._frame(self.ctx.spark.read.options(**options).orc(paths))

    def geojson(self, paths: str | list[str], **options: Any) -> Frame:
        from .geojson import read

        return self._frame(read(self.ctx.spark, paths, **options))

    def gpkg(self, paths: str | list[str], layer: str | None = None) -> Frame:
        from .files import geopackage

        return self._frame(geopackage(self.ctx.spark, paths, layer))

    def shapefile(self, paths: str | list[str]) -> Frame:
        from .files import shapefile

        return self._frame(shapefile(self.ctx.spark, paths))

    def las(self, paths: str | list[str]) -> Frame:
        from .files import las

        return self._frame(las(self.ctx.spark, paths))

    def zarr(self, paths: str | list[str], **options: Any) -> Frame:
        from .raster import zarr

        return self._frame(zarr(self.ctx.spark, paths, **options))

    def raster(self, paths: str | list[str], **options: Any) -> Frame:
        from .raster import read

        return self._frame(read(self.ctx.spark, paths, **options))
