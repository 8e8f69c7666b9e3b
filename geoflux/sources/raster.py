"""Rasters: GeoTIFF files as rows, Zarr arrays as a row for each chunk, and user loaders."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import jvm
from ..functions import call, register
from ..ship import ship

#: Loaders that users registered, by name: objects with ``supports_format(path)`` and ``load(content) -> raster dict``.
LOADERS: dict[str, Any] = {}


def read(spark: SparkSession, paths: str | list[str], lazy: bool = False) -> DataFrame:
    """(path, rast). ``lazy`` rasters hold the path alone until pixels are asked for."""
    register(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    for loader in LOADERS.values():
        if all(loader.supports_format(p) for p in paths):
            return _loaded(ship(spark), paths, loader)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select("path", (call("rs_frompath", "path") if lazy else call("rs_fromgdalraster", "content")).alias("rast"))


def _loaded(spark: SparkSession, paths: list[str], loader: Any) -> DataFrame:
    from ..functions import RASTER_TYPE

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select("path", "content")

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "rast": [loader.load(c) for c in pdf["content"]]})

    return files.mapInPandas(run, f"path string, rast {RASTER_TYPE}")


def _hidden(spark: SparkSession, path: str) -> dict[tuple[str, str], dict]:
    """The .zarray and .zattrs below a folder, which Spark's scans pass over: two small files an array."""
    out = {}
    for line in jvm.static(spark, "geoflux.Files", "texts", [spark._jsparkSession, path, ".zarray\n.zattrs"]):
        folder, name, text = line.split("\t", 2)
        out[folder, name] = json.loads(text)
    return out


def zarr(spark: SparkSession, paths: str | list[str], array: str | None = None) -> DataFrame:
    """(array, chunk, dims, shape, dtype, data): a row for each chunk of Zarr version 2 arrays, decoded to little-endian C order.

    Uncompressed, zlib and zstd chunks are read; dimensions come from ``_ARRAY_DIMENSIONS``.
    """
    ship(spark)
    paths = [paths] if isinstance(paths, str) else list(paths)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    folder, name = F.regexp_extract("path", r"^(.*)/([^/]+)$", 1), F.regexp_extract("path", r"^(.*)/([^/]+)$", 2)
    files = files.select(folder.alias("folder"), name.alias("name"), "content")
    meta = {k: v for p in paths for k, v in _hidden(spark, p).items()}
    arrays = {}
    for (where, kind), m in meta.items():
        if kind == ".zarray" and (array is None or where.rpartition("/")[2] == array):
            arrays[where] = {**m, "dims": meta.get((where, ".zattrs"), {}).get("_ARRAY_DIMENSIONS")}
    chunks = files.where(F.col("name").rlike(r"^\d+([./]\d+)*$") & F.col("folder").isin(list(arrays)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np
        import zstandard

        for batch in batches:
            for r in batch.to_pylist():
                m = arrays[r["folder"]]
                how, raw = m.get("compressor"), r["content"]
                if how and how["id"] == "zlib":
                    raw = zlib.decompress(raw)
                elif how and how["id"] == "zstd":
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                elif how:
                    raise ValueError(f"Zarr compressor {how['id']}")
                x = np.frombuffer(raw, np.dtype(m["dtype"])).reshape(m["chunks"], order=m.get("order", "C"))
                at = [int(i) for i in r["name"].split(m.get("dimension_separator", "."))]
                x = x[tuple(slice(0, min(c, s - i * c)) for i, c, s in zip(at, m["chunks"], m["shape"], strict=True))]
                yield pa.RecordBatch.from_pylist(
                    [{"array": r["folder"].rpartition("/")[2], "chunk": at, "dims": m["dims"], "shape": list(x.shape), "dtype": x.dtype.newbyteorder("=").name, "data": np.ascontiguousarray(x, x.dtype.newbyteorder("<")).tobytes()}],
                    pa.schema([("array", pa.string()), ("chunk", pa.list_(pa.int64())), ("dims", pa.list_(pa.string())), ("shape", pa.list_(pa.int64())), ("dtype", pa.string()), ("data", pa.binary())]),
                )

    return chunks.mapInArrow(run, "array string, chunk array<long>, dims array<string>, shape array<long>, dtype string, data binary")
