"""Registered queries of single functions: each row of a table gives the arguments, and closed formulas give the answers."""

from __future__ import annotations

from .queries import functions_on

K = "n_nationkey"


def rows(name: str, frame: str, key: str, table: list[tuple[str, str, str]], **named: str) -> None:
    """``table``: (column, Spark expression, formula); ``named`` expressions stand in others as a word in braces."""

    def put(e: str) -> str:
        for k, v in named.items():
            e = e.replace("{" + k + "}", v)
        return e

    functions_on(name, frame, key, {c: put(e) for c, e, _ in table}, {c: f for c, _, f in table})


rows("fn_constructors", "z", K, [
    ("pt", "st_astext(st_pointfromtext(concat('POINT(', n_nationkey, ' ', n_nationkey + 1, ')')))", "'POINT(' || n_nationkey || ' ' || n_nationkey + 1 || ')'"),
    ("ln", "st_length(st_linefromtext(concat('LINESTRING(0 0,', n_nationkey, ' 0)')))", "n_nationkey::DOUBLE"),
    ("ls", "st_length(st_linestringfromtext(concat('LINESTRING(0 0,0 ', n_nationkey, ')')))", "n_nationkey::DOUBLE"),
    ("pg", "st_area(st_polygonfromtext(concat('POLYGON((0 0,', n_nationkey + 1, ' 0,', n_nationkey + 1, ' 2,0 2,0 0))')))", "2.0 * (n_nationkey + 1)"),
    ("mp", "st_xmax(st_mpointfromtext(concat('MULTIPOINT((0 0),(', n_nationkey, ' 1))')))", "n_nationkey::DOUBLE"),
    ("ml", "st_length(st_mlinefromtext(concat('MULTILINESTRING((0 0,3 4),(0 0,', n_nationkey, ' 0))')))", "5.0 + n_nationkey"),
    ("my", "st_area(st_mpolyfromtext(concat('MULTIPOLYGON(((0 0,1 0,1 1,0 1,0 0)),((5 5,', n_nationkey + 6, ' 5,', n_nationkey + 6, ' 6,5 6,5 5)))')))", "2.0 + n_nationkey"),
    ("gc", "st_numgeometries(st_geomcollfromtext(concat('GEOMETRYCOLLECTION(POINT(0 0),LINESTRING(0 0,', n_nationkey, ' 1))')))", "2"),
    ("gt", "st_x(st_geometryfromtext(concat('POINT(', n_nationkey, ' 1)')))", "n_nationkey::DOUBLE"),
    ("gw", "st_y(st_geomfromwkt(concat('POINT(1 ', n_nationkey, ')')))", "n_nationkey::DOUBLE"),
    ("gg", "st_x(st_geogfromtext(concat('POINT(', n_nationkey, ' 1)')))", "n_nationkey::DOUBLE"),
    ("gk", "st_y(st_geogfromwkt(concat('POINT(1 ', n_nationkey, ')')))", "n_nationkey::DOUBLE"),
    ("gb", "st_srid(st_geogfromwkb(st_asbinary(st_point(n_nationkey, 1))))", "4326"),
    ("un", "st_x(st_geomfromwkbunchecked(st_asbinary(st_point(n_nationkey, 1))))", "n_nationkey::DOUBLE"),
    ("pz", "st_z(st_pointz(0, 1, n_nationkey + 2))", "n_nationkey + 2.0"),
    ("pm", "st_m(st_pointm(0, 1, n_nationkey + 3))", "n_nationkey + 3.0"),
    ("zm", "st_astext(st_pointzm(n_nationkey, 1, 2, n_nationkey))", "'POINT ZM(' || n_nationkey || ' 1 2 ' || n_nationkey || ')'"),
    ("wb", "hex(st_aswkb(st_point(0, 0)))", "'010100000000000000000000000000000000000000'"),
    ("wt", "st_aswkt(st_point(n_nationkey, 7))", "'POINT(' || n_nationkey || ' 7)'"),
    ("fm", "sd_format(st_point(n_nationkey, 7))", "'POINT(' || n_nationkey || ' 7)'"),
    ("ss", "st_x(sd_simplifystorage(st_point(n_nationkey, 7)))", "n_nationkey::DOUBLE"),
])

rows("fn_accessors", "z", K, [
    ("zmin", "st_zmin({line})", "n_nationkey::DOUBLE"), ("zmax", "st_zmax({line})", "n_nationkey * 2.0 + 1"), ("mmin", "st_mmin({line})", "5.0"), ("mmax", "st_mmax({line})", "n_nationkey + 7.0"),
    ("ymin", "st_ymin({line})", "y0"), ("ex", "st_x(st_endpoint({line}))", "x1"), ("ez", "st_z(st_endpoint({line}))", "n_nationkey * 2.0 + 1"), ("np", "st_numpoints({line})", "2"), ("hz", "st_hasz({line})", "true"), ("hm", "st_hasm({line})", "true"),
    ("sm", "st_m(st_startpoint({line}))", "5.0"), ("gn", "st_x(st_geometryn(st_points({line}), 2))", "x1"), ("nh", "st_numinteriorrings({ring})", "1"), ("nh2", "st_numinteriorring({ring})", "1"),
    ("hl", "st_length(st_interiorringn({ring}, 1))", "4.0"), ("ra", "st_area({ring})", "(x1 - x0) * (y1 - y0) - 1"), ("nr", "st_nrings({ring})", "2"), ("co", "st_iscollection(st_points(geometry))", "true"), ("ri", "st_isring(st_exteriorring(geometry))", "true"),
    ("nri", "st_isring({line})", "false"), ("si", "st_issimple(geometry)", "true"), ("vr", "st_isvalidreason(geometry)", "'Valid Geometry'"), ("nv", "st_isvalidreason(st_geomfromtext('POLYGON((0 0,1 1,1 0,0 1,0 0))'))", "'Self-intersection[0.5 0.5]'"),
    ("sp", "st_x(st_startpoint(geometry))", "x0"), ("zf", "st_zmflag(st_geomfromtext('POINT M EMPTY'))", "1"), ("pn", "st_numpoints(geometry)", "5"),
], line="st_geomfromtext(format_string('LINESTRING ZM(%s %s %s 5,%s %s %s %s)', x0, y0, n_nationkey, x1, y1, n_nationkey * 2 + 1, n_nationkey + 7))",
    ring="st_difference(geometry, st_translate(st_geomfromtext('POLYGON((0 0,1 0,1 1,0 1,0 0))'), x0 + 10, y0 + 10))")

rows("fn_relations", "p", "id", [
    ("cr", "st_crosses(st_makeline(st_point(-2000, y), geometry), {box})", "x > 0 AND y > 0 AND y < 500"),
    ("cb", "st_coveredby(geometry, {box})", "x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 500"),
    ("cv", "st_covers({box}, geometry)", "x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 500"),
    ("wi", "st_within(geometry, {box})", "x > 0 AND x < 5000 AND y > 0 AND y < 500"),
    ("dj", "st_disjoint(geometry, {box})", "NOT (x BETWEEN 0 AND 5000 AND y BETWEEN 0 AND 500)"),
    ("ov", "st_overlaps(st_envelope(st_makeline(st_point(x, 100), st_point(x + 1000, 200))), {box})", "x > -1000 AND x < 0 OR x > 4000 AND x < 5000"),
    ("to", "st_touches(st_makeline(st_point(-2000, y), st_point(0, y)), {box})", "y <= 500"),
    ("cx", "round(st_x(st_closestpoint(st_geomfromtext('LINESTRING(0 0,5000 0)'), geometry)), 6)", "round(greatest(0.0, least(5000.0, x)), 6)"),
    ("sl", "round(st_length(st_shortestline(st_geomfromtext('LINESTRING(0 0,5000 0)'), geometry)), 5)", "round(sqrt(power(x - greatest(0.0, least(5000.0, x)), 2) + y * y), 5)"),
    ("ll", "round(st_length(st_longestline(st_geomfromtext('LINESTRING(0 0,5000 0)'), geometry)), 5)", "round(greatest(sqrt(x * x + y * y), sqrt((x - 5000) * (x - 5000) + y * y)), 5)"),
    ("hd", "round(st_hausdorffdistance(geometry, st_geomfromtext('LINESTRING(0 0,10 0)')), 5)", "round(greatest(sqrt(x * x + y * y), sqrt((x - 10) * (x - 10) + y * y)), 5)"),
], box="st_geomfromtext('POLYGON((0 0,5000 0,5000 500,0 500,0 0))')")

rows("fn_dimensions_and_turns", "p", "id", [
    ("z2", "st_z(st_force2d(st_pointz(x, y, 3)))", "NULL::DOUBLE"), ("m3", "st_m(st_force3dm(geometry, 4))", "4.0"), ("z3", "st_z(st_force3dz(geometry, 5))", "5.0"), ("zz", "st_z(st_force3d(geometry, 6))", "6.0"), ("f4", "st_zmflag(st_force4d(geometry, 1, 2))", "3"),
    ("xy", "round(st_y(st_rotatex(st_pointz(x, y, 3), 1.0)), 6)", "round(y * cos(1.0) - 3 * sin(1.0), 6)"), ("xz", "round(st_z(st_rotatex(st_pointz(x, y, 3), 1.0)), 6)", "round(y * sin(1.0) + 3 * cos(1.0), 6)"),
    ("yx", "round(st_x(st_rotatey(st_pointz(x, y, 3), 1.0)), 6)", "round(x * cos(1.0) + 3 * sin(1.0), 6)"), ("yz", "round(st_z(st_rotatey(st_pointz(x, y, 3), 1.0)), 6)", "round(3 * cos(1.0) - x * sin(1.0), 6)"),
    ("rp", "st_x(st_reduceprecision(geometry, 10))", "floor(x / 10 + 0.5) * 10"), ("sc", "st_crs(st_setcrs(geometry, 'EPSG:3857'))", "'EPSG:3857'"), ("hz", "st_hasz(st_pointz(x, y, 3))", "true"), ("hm", "st_hasm(geometry)", "false"),
    ("fx", "st_y(st_flipcoordinates(geometry))", "x"), ("no", "st_equals(st_normalize(geometry), geometry)", "true"), ("sn", "st_x(st_snap(st_point(id + 0.25, 0), st_point(id, 0), 0.5))", "id::DOUBLE"),
    ("face", "shiftrightunsigned(s2_cellidfrompoint(st_geogpoint(x / 60, y / 12)), 61)", "CASE WHEN abs(cos(radians(y / 12)) * cos(radians(x / 60))) >= greatest(abs(cos(radians(y / 12)) * sin(radians(x / 60))), abs(sin(radians(y / 12)))) THEN CASE WHEN cos(radians(x / 60)) < 0 THEN 3 ELSE 0 END WHEN abs(cos(radians(y / 12)) * sin(radians(x / 60))) >= abs(sin(radians(y / 12))) THEN CASE WHEN sin(radians(x / 60)) < 0 THEN 4 ELSE 1 END ELSE CASE WHEN y < 0 THEN 5 ELSE 2 END END::BIGINT"),
    ("own", "array_contains(s2_coveringcellids(st_geogpoint(x / 60, y / 12)), s2_cellidfrompoint(st_geogpoint(x / 60, y / 12)))", "true"), ("order", "sd_order(st_point(x / 60, y / 12)) = s2_cellidfrompoint(st_geogpoint(x / 60, y / 12))", "true"),
])

rows("fn_shapes_of_boxes", "z", K, [
    ("mc", "st_minimumclearance(geometry)", "least(x1 - x0, y1 - y0)"), ("ml", "st_length(st_minimumclearanceline(geometry))", "least(x1 - x0, y1 - y0)"), ("px", "st_x(st_pointonsurface(geometry))", "(x0 + x1) / 2"), ("py", "st_y(st_pointonsurface(geometry))", "(y0 + y1) / 2"),
    ("st", "st_npoints(st_simplifypreservetopology(st_geomfromtext('LINESTRING(0 0,1 0.001,2 0,3 0.001,4 0)'), 0.1))", "2"), ("ch", "st_area(st_concavehull(st_points(geometry), 1.0))", "(x1 - x0) * (y1 - y0)"), ("dt", "st_numgeometries(st_delaunaytriangles(st_points(geometry)))", "2"),
    ("da", "round(st_area(st_delaunaytriangles(st_points(geometry))), 6)", "(x1 - x0) * (y1 - y0)"), ("pz", "st_numgeometries(st_polygonize(st_boundary(geometry)))", "1"), ("pa", "st_area(st_polygonize(st_boundary(geometry)))", "(x1 - x0) * (y1 - y0)"),
    ("ba", "st_area(st_buildarea(st_union(st_boundary(geometry), st_boundary(st_envelope(st_makeline(st_point(x0 + 10, y0 + 10), st_point(x0 + 20, y0 + 20)))))))", "(x1 - x0) * (y1 - y0) - 100"), ("nl", "st_length(st_normalize(st_boundary(geometry)))", "2 * (x1 - x0 + y1 - y0)"),
    ("gl", "round(st_length(st_togeography({line})), 3)", "round(6371010 * radians(n_nationkey + 1.0), 3)"), ("pl", "st_length(st_togeometry(st_togeography({line})))", "n_nationkey + 1.0"), ("gx", "st_xmax(st_tessellategeom(st_togeography({line}), 1000))", "n_nationkey + 1.0"),
    ("gs", "round(st_length(st_tessellategeog({line}, 1000)), 2)", "round(6371010 * radians(n_nationkey + 1.0), 2)"), ("lm", "st_npoints(st_linemerge(st_geomfromtext(concat('MULTILINESTRING((0 0,1 1),(', n_nationkey + 2, ' 2,1 1))')), true))", "4"),
    ("md", "round(st_maxdistance(geometry, st_point(x0, y0)), 6)", "round(sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 6)"), ("id", "st_equals(st_geomfromewkb(st_asewkb(geometry)), geometry)", "true"),
], line="st_geomfromtext(concat('LINESTRING(0 0,', n_nationkey + 1, ' 0)'))", )

# A raster for each nation: four columns and three rows of k + 0 to k + 11, cells of 2 by 1 from (k, 30) downwards, -9 where nothing is.
RASTER = "rs_make(transform(sequence(0, 11), i -> cast(i + n_nationkey as double)), 4, 3, n_nationkey, 30, 2, -1, '', 'float64', -9)"

rows("rs_properties", "z", K, [
    ("ulx", "rs_upperleftx({r})", "n_nationkey::DOUBLE"), ("kx", "rs_skewx({r})", "0.0"), ("ky", "rs_skewy({r})", "0.0"), ("rot", "rs_rotation({r})", "0.0"), ("crs", "rs_crs(rs_setcrs({r}, 'EPSG:3857'))", "'EPSG:3857'"), ("nod", "rs_bandnodatavalue({r})", "-9.0"),
    ("set", "rs_bandnodatavalue(rs_setbandnodatavalue({r}, 1, n_nationkey))", "n_nationkey::DOUBLE"), ("path", "rs_bandpath({r})", "NULL::VARCHAR"), ("dims", "rs_dimnames({r})[1]", "'x'"), ("dx", "rs_dimsize({r}, 'x')", "4::BIGINT"), ("dn", "rs_dimsize({r}, 'time')", "NULL::BIGINT"),
    ("sh", "rs_shape({r})[0]", "3::BIGINT"), ("nd", "rs_numdimensions({r})", "2"), ("emp", "rs_isempty({r})", "false"), ("mw", "rs_metadata({r}).gridWidth", "4::BIGINT"), ("mx", "rs_metadata({r}).upperLeftX", "n_nationkey::DOUBLE"), ("mb", "rs_metadata({r}).numSampleDimensions", "1"),
    ("geo", "split(rs_georeference({r}), '\\\\s+')[4]", "n_nationkey || '.000000'"), ("sg", "rs_upperleftx(rs_setgeoreference({r}, concat('2 0 0 -1 ', n_nationkey + 5, ' 30')))", "n_nationkey + 5.0"), ("srid", "rs_srid(rs_setsrid({r}, 4326))", "4326"), ("ex", "rs_width(rs_example())", "64::BIGINT"),
], r=RASTER)

rows("rs_places", "z", K, [
    ("wx", "rs_rastertoworldcoordx({r}, 2, 1)", "n_nationkey + 4.0"), ("wy", "rs_rastertoworldcoordy({r}, 2, 1)", "29.0"), ("wp", "st_astext(rs_rastertoworldcoord({r}, 2, 1))", "'POINT(' || n_nationkey + 4 || ' 29)'"),
    ("rx", "rs_worldtorastercoordx({r}, n_nationkey + 5.5, 28.5)", "2"), ("ry", "rs_worldtorastercoordy({r}, n_nationkey + 5.5, 28.5)", "1"), ("rp", "st_astext(rs_worldtorastercoord({r}, n_nationkey + 5.5, 28.5))", "'POINT(2 1)'"),
    ("ea", "st_area(rs_envelope({r}))", "24.0"), ("ex", "st_xmin(rs_envelope({r}))", "n_nationkey::DOUBLE"), ("pa", "st_area(rs_pixelaspolygon({r}, 2, 3))", "2.0"), ("px", "st_xmin(rs_pixelaspolygon({r}, 2, 3))", "n_nationkey + 2.0"), ("py", "st_ymax(rs_pixelaspolygon({r}, 2, 3))", "28.0"),
    ("it", "rs_intersects({r}, st_point(12.5, 28.5))", "12.5 BETWEEN n_nationkey AND n_nationkey + 8"), ("ct", "rs_contains({r}, st_point(12.5, 28.5))", "12.5 > n_nationkey AND 12.5 < n_nationkey + 8"),
    ("wi", "rs_within({r}, st_geomfromtext('POLYGON((3 0,20 0,20 40,3 40,3 0))'))", "n_nationkey >= 3 AND n_nationkey + 8 <= 20"),
], r=RASTER)

rows("rs_values_and_bands", "z", K, [
    ("v0", "rs_values({r}, {two})[0]", "n_nationkey::DOUBLE"), ("v1", "rs_values({r}, {two})[1]", "n_nationkey + 11.0"), ("zs", "rs_zonalstats({r}, {left}, 'sum')", "6 * n_nationkey + 0.0 + 1 + 4 + 5 + 8 + 9"), ("zc", "rs_zonalstats({r}, {left}, 'count')", "6.0"),
    ("zm", "rs_zonalstats({r}, {left}, 'max')", "n_nationkey + 9.0"), ("as", "rs_zonalstats(rs_asraster({left}, {r}, 'uint8'), {left}, 'sum')", "6.0"), ("en", "rs_value(rs_ensureloaded({r}), st_point(n_nationkey + 3, 29.5))", "n_nationkey + 1.0"),
    ("bd", "rs_numdimensions(rs_bandtodim({r}, 'time'))", "3"), ("bs", "rs_dimsize(rs_bandtodim({r}, 'time'), 'time')", "1::BIGINT"), ("db", "rs_numbands(rs_dimtoband(rs_bandtodim({r}, 'time'), 'time'))", "1::BIGINT"),
    ("sl", "rs_numdimensions(rs_slice(rs_bandtodim({r}, 'time'), 'time', 0))", "2"), ("sr", "rs_shape(rs_slicerange(rs_bandtodim({r}, 'time'), 'time', 0, 1))[1]", "3::BIGINT"), ("sv", "rs_value(rs_dimtoband(rs_slicerange(rs_bandtodim({r}, 'time'), 'time', 0, 1), 'time'), st_point(n_nationkey + 3, 29.5))", "n_nationkey + 1.0"),
    ("rm", "rs_value(rs_reprojectmatch({r}, {r}), st_point(n_nationkey + 3, 29.5))", "n_nationkey + 1.0"), ("rw", "rs_value(rs_reprojectmatch({r}, rs_make(array(0D, 0D), 2, 1, n_nationkey + 2, 29, 2, -1, '', 'float64', -9)), st_point(n_nationkey + 5, 28.5))", "n_nationkey + 6.0"),
], r=RASTER, two="st_geomfromtext(concat('MULTIPOINT((', n_nationkey + 1, ' 29.5),(', n_nationkey + 7, ' 27.5))'))", left="st_envelope(st_makeline(st_point(n_nationkey, 27), st_point(n_nationkey + 4, 30)))")

E2, PHI, LAM = 0.0066943799901413165, "radians(y / 20)", "radians(x / 100)"
NORMAL = f"(6378137 / sqrt(1 - {E2} * sin({PHI}) * sin({PHI})))"
rows("fn_projections", "p", "id", [
    ("mx", "round(st_x(st_transform({g}, 'EPSG:3395')), 4)", f"round(6378137 * {LAM}, 4)"),
    ("my", "round(st_y(st_transform({g}, 'EPSG:3395')), 4)", f"round(6378137 * ln(tan(pi() / 4 + {PHI} / 2) * power((1 - sqrt({E2}) * sin({PHI})) / (1 + sqrt({E2}) * sin({PHI})), sqrt({E2}) / 2)), 4)"),
    ("gx", "round(st_x(st_transform({g}, 'EPSG:4978')), 4)", f"round({NORMAL} * cos({PHI}) * cos({LAM}), 4)"),
    ("gy", "round(st_y(st_transform({g}, 'EPSG:4978')), 4)", f"round({NORMAL} * cos({PHI}) * sin({LAM}), 4)"),
    ("gz", "round(st_z(st_transform({g}, 'EPSG:4978')), 4)", f"round({NORMAL} * (1 - {E2}) * sin({PHI}), 4)"),
    ("lon", "round(st_x(st_transform(st_transform({g}, 'EPSG:2154'), 'EPSG:4326')), 7)", "round(x / 100, 7)"), ("lat", "round(st_y(st_transform(st_transform({g}, 'EPSG:3035'), 'EPSG:4326')), 7)", "round(y / 20, 7)"),
], g="st_point(x / 100, y / 20, 4326)")
