"""The functions by name, with their types, and how a session learns them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import jvm

BAND_TYPE = (
    "struct<name:string,dim_names:array<string>,source_shape:array<bigint>,data_type:int,nodata:binary,"
    "view:array<struct<source_axis:int,start:bigint,step:bigint,steps:bigint>>,outdb_uri:string,outdb_format:string,data:binary>"
)
RASTER_TYPE = f"struct<crs:string,transform:array<double>,spatial_dims:array<string>,spatial_shape:array<bigint>,bands:array<{BAND_TYPE}>>"
STATS_TYPE = "struct<count:bigint,sum:double,mean:double,median:double,mode:double,stddev:double,variance:double,min:double,max:double>"
TYPES = {
    "G": "binary", "D": "double", "I": "int", "L": "bigint", "B": "boolean", "S": "string", "R": RASTER_TYPE,
    "dump": "array<struct<path:array<int>,geom:binary>>", "cells": "array<bigint>", "bounds": "struct<xmin:double,ymin:double,xmax:double,ymax:double>",
    "doubles": "array<double>", "places": "array<struct<i:int,d:double>>", "stats": STATS_TYPE, "tiles": f"array<struct<x:int,y:int,tile:{RASTER_TYPE}>>", "polygons": "array<struct<geom:binary,value:double>>",
}

# Fixed names of the functions: type of the result, then names with the least and greatest number of arguments.
_TABLE = """
G st_geomfromwkb 1 2, st_geogfromwkb 1 1, st_geomfromwkt 1 2, st_geogfromwkt 1 2, st_geomfromtext 1 2, st_geometryfromtext 1 2, st_geogfromtext 1 2
G st_geomfromwkbunchecked 1 2, st_geomfromewkb 1 1, st_geomfromewkt 1 1, st_pointfromtext 1 2, st_linefromtext 1 2, st_linestringfromtext 1 2
G st_polygonfromtext 1 2, st_mpointfromtext 1 2, st_mlinefromtext 1 2, st_mpolyfromtext 1 2, st_geomcollfromtext 1 2
G st_point 2 3, st_geogpoint 2 2, st_pointz 3 4, st_pointm 3 4, st_pointzm 4 5, st_makeline 2 2
G st_asbinary 1 1, st_aswkb 1 1, st_asewkb 1 1
S st_astext 1 1, st_aswkt 1 1, st_asgeojson 1 1, st_geometrytype 1 1, st_isvalidreason 1 1, st_crs 1 1
D st_x 1 1, st_y 1 1, st_z 1 1, st_m 1 1, st_xmin 1 1, st_xmax 1 1, st_ymin 1 1, st_ymax 1 1, st_zmin 1 1, st_zmax 1 1, st_mmin 1 1, st_mmax 1 1
I st_dimension 1 1, st_numgeometries 1 1, st_npoints 1 1, st_numpoints 1 1, st_numinteriorrings 1 1, st_numinteriorring 1 1, st_nrings 1 1, st_zmflag 1 1, st_srid 1 1
G st_geometryn 2 2, st_points 1 1, st_pointn 2 2, st_startpoint 1 1, st_endpoint 1 1, st_exteriorring 1 1, st_interiorringn 2 2, st_envelope 1 1, st_boundary 1 1
B st_hasz 1 1, st_hasm 1 1, st_isempty 1 1, st_isclosed 1 1, st_iscollection 1 1, st_isring 1 1, st_issimple 1 1, st_isvalid 1 1
B st_intersects 2 2, st_contains 2 2, st_within 2 2, st_covers 2 2, st_coveredby 2 2, st_crosses 2 2, st_touches 2 2, st_overlaps 2 2, st_equals 2 2, st_disjoint 2 2
B st_dwithin 3 3, st_knn 2 4
dump st_dump 1 1
D st_area 1 1, st_length 1 1, st_perimeter 1 1, st_distance 2 2, st_maxdistance 2 2, st_hausdorffdistance 2 3, st_azimuth 2 2, st_minimumclearance 1 1, st_linelocatepoint 2 2
G st_minimumclearanceline 1 1, st_closestpoint 2 2, st_shortestline 2 2, st_longestline 2 2
G st_affine 7 13, st_buffer 2 3, st_buildarea 1 1, st_centroid 1 1, st_concavehull 2 3, st_convexhull 1 1, st_delaunaytriangles 1 3, st_difference 2 2, st_flipcoordinates 1 1
G st_force2d 1 1, st_force3d 1 2, st_force3dz 1 2, st_force3dm 1 2, st_force4d 1 3, st_intersection 2 2, st_lineinterpolatepoint 2 2, st_linemerge 1 2, st_linesubstring 3 3
G st_makevalid 1 2, st_normalize 1 1, st_pointonsurface 1 1, st_polygonize 1 1, st_reduceprecision 2 2, st_reverse 1 1, st_rotate 2 2, st_rotatex 2 2, st_rotatey 2 2
G st_scale 3 4, st_segmentize 2 2, st_setcrs 2 2, st_setsrid 2 2, st_simplify 2 2, st_simplifypreservetopology 2 2, st_snap 3 3, st_symdifference 2 2
G st_tessellategeog 2 2, st_tessellategeom 2 2, st_togeography 1 1, st_togeometry 1 1, st_transform 2 3, st_translate 3 4, st_unaryunion 1 1, st_union 2 2
L s2_cellidfrompoint 1 1, sd_order 1 1
S sd_format 1 2
G sd_simplifystorage 1 1, geoflux_fromgeojson 1 1, geoflux_covered 5 5, geoflux_pack 1 1
cells s2_coveringcellids 1 4, geoflux_cells 2 3, geoflux_keys 5 5
L geoflux_anchor 4 4
I geoflux_level 2 2, geoflux_floor 1 1
D geoflux_radius 3 3
places geoflux_nearest 5 5
bounds geoflux_bounds 1 1
R rs_example 0 0, rs_make 9 10, rs_setbandnodatavalue 2 3, rs_setcrs 2 2, rs_setsrid 2 2, rs_setgeoreference 2 3, rs_asraster 3 7, rs_clip 3 7, rs_resample 4 7
R rs_reprojectmatch 2 3, rs_slice 3 3, rs_slicerange 4 4, rs_bandtodim 2 2, rs_dimtoband 2 2, rs_fromgdalraster 1 1, rs_frompath 1 1, rs_ensureloaded 1 1
D rs_bandnodatavalue 1 2, rs_value 2 3, rs_zonalstats 3 7
S rs_georeference 1 2
G rs_convexhull 1 1, rs_envelope 1 1, rs_pixelaspoint 3 3, rs_pixelascentroid 3 3, rs_pixelaspolygon 3 3, rs_rastertoworldcoord 3 3, rs_worldtorastercoord 3 3, rs_asgeotiff 1 5
B rs_intersects 2 2, rs_contains 2 2, rs_within 2 2
I rs_worldtorastercoordx 3 3, rs_worldtorastercoordy 3 3
doubles rs_values 2 3
stats rs_zonalstatsall 2 6
tiles rs_tile 3 6
polygons rs_polygonize 2 2
"""
FUNCTIONS: dict[str, tuple[str, int, int]] = {}
for _line in _TABLE.strip().splitlines():
    _type, _, _names = _line.partition(" ")
    for _item in _names.split(", "):
        _name, _least, _most = _item.split()
        FUNCTIONS[_name] = (TYPES[_type], int(_least), int(_most))
FUNCTIONS["st_relate"] = ("string", 2, 3)
#: One number of arguments with a kernel and type of its own: (arguments, kernel, type).
FORMS = {"st_relate": (3, "st_relate_matches", "boolean")}

_band = "element_at(r.bands, band)"
# Fixed short names of the pixel types, by code.
_PIXELS = "array('UNSIGNED_8BITS','UNSIGNED_16BITS','SIGNED_16BITS','UNSIGNED_32BITS','SIGNED_32BITS','REAL_32BITS','REAL_64BITS','UNSIGNED_64BITS','SIGNED_64BITS','SIGNED_8BITS')"
_SRID = "case when r.crs is null then 0 when r.crs in ('OGC:CRS84', 'EPSG:4326') then 4326 when r.crs like 'EPSG:%' then cast(substr(r.crs, 6) as int) end"
#: Functions that are plain Catalyst expressions over the raster struct, so that a scan reads only the fields they use:
#: further arguments, type, expression.
EXPRESSIONS: dict[str, tuple[str, str, str]] = {
    "rs_width": ("", "bigint", "r.spatial_shape[0]"),
    "rs_height": ("", "bigint", "r.spatial_shape[1]"),
    "rs_numbands": ("", "bigint", "cast(size(r.bands) as bigint)"),
    "rs_upperleftx": ("", "double", "r.transform[0]"),
    "rs_scalex": ("", "double", "r.transform[1]"),
    "rs_skewx": ("", "double", "r.transform[2]"),
    "rs_upperlefty": ("", "double", "r.transform[3]"),
    "rs_skewy": ("", "double", "r.transform[4]"),
    "rs_scaley": ("", "double", "r.transform[5]"),
    "rs_rotation": ("", "double", "atan2(r.transform[4], r.transform[1])"),
    "rs_crs": ("", "string", "r.crs"),
    "rs_srid": ("", "int", _SRID),
    "rs_isempty": ("", "boolean", "exists(r.spatial_shape, x -> x = 0) or exists(r.bands, b -> exists(b.source_shape, x -> x = 0))"),
    "rs_bandpixeltype": ("band int default 1", "string", f"{_PIXELS}[{_band}.data_type - 1]"),
    "rs_bandpath": ("band int default 1", "string", f"split_part({_band}.outdb_uri, '#band=', 1)"),
    "rs_dimnames": ("band int default 1", "array<string>", f"{_band}.dim_names"),
    "rs_shape": ("band int default 1", "array<bigint>", f"{_band}.source_shape"),
    "rs_numdimensions": ("band int default 1", "int", f"size({_band}.dim_names)"),
    "rs_dimsize": ("dim string, band int default 1", "bigint", f"try_element_at({_band}.source_shape, cast(nullif(array_position({_band}.dim_names, dim), 0) as int))"),
    "rs_rastertoworldcoordx": ("x int, y int", "double", "r.transform[0] + x * r.transform[1] + y * r.transform[2]"),
    "rs_rastertoworldcoordy": ("x int, y int", "double", "r.transform[3] + x * r.transform[4] + y * r.transform[5]"),
    "rs_metadata": (
        "", "struct<upperLeftX:double,upperLeftY:double,gridWidth:bigint,gridHeight:bigint,scaleX:double,scaleY:double,skewX:double,skewY:double,srid:int,numSampleDimensions:int,tileWidth:bigint,tileHeight:bigint>",
        f"named_struct('upperLeftX', r.transform[0], 'upperLeftY', r.transform[3], 'gridWidth', r.spatial_shape[0], 'gridHeight', r.spatial_shape[1], 'scaleX', r.transform[1], 'scaleY', r.transform[5],"
        f" 'skewX', r.transform[2], 'skewY', r.transform[4], 'srid', coalesce({_SRID}, 0), 'numSampleDimensions', size(r.bands), 'tileWidth', if(size(r.bands) = 0, 0L, r.spatial_shape[0]), 'tileHeight', if(size(r.bands) = 0, 0L, r.spatial_shape[1]))",
    ),
}

ANALYZE_TYPE = (
    "struct<count:bigint,minx:double,miny:double,maxx:double,maxy:double,mean_size_in_bytes:bigint,mean_points_per_geometry:double,puntal_count:bigint,lineal_count:bigint,"
    "polygonal_count:bigint,geometrycollection_count:bigint,mean_envelope_width:double,mean_envelope_height:double,mean_envelope_area:double>"
)
#: Aggregates: the fold of the kernel, and the type where it is not a geometry.
AGGREGATES = {
    "st_envelope_agg": ("envelope", None),
    "st_collect_agg": ("collect", None),
    "st_union_agg": ("union", None),
    "st_intersection_agg": ("intersection", None),
    "st_convexhull_agg": ("hull", None),
    "st_polygonize_agg": ("polygonize", None),
    "st_analyze_agg": ("analyze", ANALYZE_TYPE),
}
#: Names that users call: helpers of this engine begin with its name.
DOCUMENTED = sorted(n for n in (*FUNCTIONS, *EXPRESSIONS, *AGGREGATES) if not n.startswith("geoflux_"))

_known: set[int] = set()


def register(spark: SparkSession) -> SparkSession:
    """Makes all functions known to the session, once."""
    jsession = spark._jsparkSession
    key = jsession.hashCode()
    if key in _known:
        return spark
    loader = jvm.loader(spark)
    spark.sparkContext._jvm.java.lang.Thread.currentThread().setContextClassLoader(loader)
    parsed: dict[str, object] = {}

    def kind(ddl: str):
        if ddl not in parsed:
            from pyspark.sql.types import _parse_datatype_string

            parsed[ddl] = jsession.parseDataType(_parse_datatype_string(ddl).json())
        return parsed[ddl]

    lines = []
    for name, (ddl, least, most) in FUNCTIONS.items():
        other = FORMS.get(name, (-1, name, ddl))
        lines.append("\t".join(map(str, (name, ddl, least, most, *other))))
    functions = jsession.sessionState().functionRegistry()
    jvm.static(spark, "geoflux.Udf", "register", [functions, "\n".join(lines)])
    for name, (fold, ddl) in AGGREGATES.items():
        made = jvm.static(spark, "geoflux.Agg", "udaf", [fold, kind(f"struct<v:{ddl}>") if ddl else None])
        jsession.udf().register(name, made)
        if ddl:
            jvm.static(spark, "geoflux.Udf", "unwrap", [functions, name])
    for name, (more, ddl, body) in EXPRESSIONS.items():
        spark.sql(f"create or replace temporary function {name}(r {RASTER_TYPE}{', ' + more if more else ''}) returns {ddl} return {body}")
    jvm.static(spark, "geoflux.Plan", "install", [jsession])
    _known.add(key)
    return spark
