"""Identifiers, coordinates, polygons, rules and plans against known values."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from volreg.functions import geodesy, idcode, polygons
from volreg.operators import cloud, hierarchy, raster, register, rules, scoring, spatial
from volreg.plans import plan2d
from volreg.schema import OBJECT_COLUMNS, TOLERANCES
from volreg.sources import files, pointfiles


def box(spark, *rows):
    """Objects from (id, kind, parent, x0, y0, x1, y1, z0, z1, extra columns)."""
    kinds = {"level": "int", "storeys_above_ground": "int", "storey_estimate_from_scan": "int", "seq": "bigint"} | dict.fromkeys(["confidence", "x0", "y0", "x1", "y1", "z_min", "z_max", "recorded_area_m2", "floor_height_m", "facade_periodicity"], "double")
    out = []
    for i, r in enumerate(rows):
        base = dict.fromkeys(OBJECT_COLUMNS) | {"seq": i, "owner": "", "name": "", "use": "", "level": 0, "stratum": "B", "provenance": "surveyed", "confidence": 1.0}
        base |= dict(zip(("object_id", "kind", "parent_id"), r[:3], strict=True)) | dict(zip(("x0", "y0", "x1", "y1", "z_min", "z_max"), map(float, r[3:9]), strict=True)) | (r[9] if len(r) > 9 else {})
        out.append(tuple(base[c] for c in OBJECT_COLUMNS))
    return spark.createDataFrame(out, ", ".join(f"{c} {kinds.get(c, 'string')}" for c in OBJECT_COLUMNS))


def one(df):
    return df.collect()[0]


def test_geohash_of_a_published_example(spark):
    d = spark.createDataFrame([(57.64911, 10.40744), (0.0, 0.0), (-90.0, -180.0)], "lat double, lon double")
    got = [r[0] for r in d.select(idcode.geohash_encode(F.col("lat"), F.col("lon"))).collect()]
    assert got == ["u4pruydqqv", "7zzzzzzzzz", "0000000000"]  # a middle goes to the lower half
    b = one(d.limit(1).select(idcode.geohash_bounds(F.lit("u4pruydqqv")).alias("b"), idcode.geohash_bounds(F.lit("ail")).alias("n")))
    assert b.b.lat_lo <= 57.64911 <= b.b.lat_hi and b.b.lon_lo <= 10.40744 <= b.b.lon_hi and b.n is None
    with pytest.raises(Exception, match="out of range"):
        d.select(idcode.geohash_encode(F.lit(91.0), F.lit(0.0))).collect()


def test_base36(spark):
    d = spark.range(1)
    assert one(d.select(idcode.base36(F.lit(1679615), 4), idcode.base36(F.lit(502), 4), idcode.unbase36(F.lit("ZZZZ")))) == ("ZZZZ", "00DY", 1679615)
    with pytest.raises(Exception, match="base 36"):
        d.select(idcode.base36(F.lit(1679616), 4)).collect()


def reference_check(payload):
    p = 36
    for c in payload:
        s = (p + idcode.BASE36.index(c)) % 36 or 36
        p = 2 * s % 37
    return idcode.BASE36[(37 - p) % 36]


def test_check_character_catches_every_substitution(spark):
    d = spark.range(1).select(idcode.compact(F.lit("27"), F.lit("25"), F.lit("4"), F.lit("tek3npz479"), F.lit("B"), F.lit(5), F.lit(207)).alias("c"))
    code = one(d).c
    assert code[:8] == "27025004" and code[25] == reference_check(code[:25])
    wrong = [(code[:i] + c + code[i + 1 :],) for i in range(26) for c in idcode.BASE36 if c != code[i]]
    assert spark.createDataFrame(wrong, "t string").where(idcode.problem(F.col("t")).isNull()).count() == 0
    parts = one(d.select(idcode.parsed(F.lower(idcode.punctuated(F.col("c")))).alias("p"))).p
    assert (parts.geohash, parts.stratum, parts.level, parts.unit) == ("tek3npz479", "B", 5, 207)


def test_minting_by_preference(spark):
    rows = spark.createDataFrame([("a", 1, 7), ("a", 2, 7), ("a", 3, None), ("a", 4, -1), ("a", 5, 7), ("b", 6, 7)], "cell string, seq long, preferred int")
    got = {r.seq: r.unit for r in idcode.mint_preferred(rows, ["cell"], "cell string, seq long, preferred int, unit int").collect()}
    assert got == {1: 7, 2: 8, 3: 0, 4: 1, 5: 9, 6: 7}


def test_local_frame_and_utm(spark):
    d = spark.createDataFrame([(18.52043, 73.856744, 560.0), (18.56, 73.9, 600.0), (-33.9, 151.2, 20.0), (89.9999, 10.0, 5.0)], "lat double, lon double, h double")
    origin = geodesy.Local(18.52043, 73.856744, 560.0)
    e, n, u = origin.forward(F.col("lat"), F.col("lon"), F.col("h"))
    lat, lon, h = origin.inverse(e, n, u)
    for r in d.select("lat", "lon", "h", lat.alias("a"), lon.alias("b"), h.alias("c"), e.alias("e"), u.alias("u")).collect():
        assert abs(r.lat - r.a) < 1e-8 and abs(r.lon - r.b) < 1e-8 and abs(r.h - r.c) < 1e-3
    far = one(d.select(origin.forward(F.lit(18.52043), F.lit(73.856744 + math.degrees(5000 / 6378137 / math.cos(math.radians(18.52043)))), F.lit(560.0))[2].alias("u")))
    assert abs(far.u + 5000**2 / 2 / 6378137) < 0.05  # the earth falls away
    zone = geodesy.utm_zone(F.col("lon"))
    x, y = geodesy.utm_forward(F.col("lat"), F.col("lon"))
    p = d.limit(3).withColumns({"z": zone, "x": x, "y": y, "epsg": geodesy.utm_epsg(F.col("lat"), F.col("lon"))})
    a, b = geodesy.utm_inverse(F.col("x"), F.col("y"), F.col("z"), F.col("lat") < 0)
    got = p.select("*", a.alias("a"), b.alias("b")).collect()
    assert (got[0].z, got[0].epsg, got[2].epsg) == (43, 32643, 32756)
    assert all(abs(r.lat - r.a) < 1e-7 and abs(r.lon - r.b) < 1e-7 for r in got)


def test_control_points_drop_the_blunder():
    random_ = np.random.default_rng(3)
    known = random_.uniform(-100, 100, (8, 3))
    turn = np.array([[0.8, -0.6, 0], [0.6, 0.8, 0], [0, 0, 1]])
    observed = (known - [5, 6, 7]) @ turn / 1.0001
    observed[5] += [0.75, 0, 0]
    fit = geodesy.fit_similarity(observed, known, np.full(8, 0.02))
    assert fit.active == [0, 1, 2, 3, 4, 6, 7] and fit.rms < 1e-6 and abs(fit.scale - 1.0001) < 1e-9
    assert np.allclose(fit.rotation @ turn.T, np.eye(3), atol=1e-6) or np.allclose(fit.rotation, turn, atol=1e-6)


def test_shared_area_of_polygons():
    r = np.random.default_rng(2)
    square = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)
    star = np.array([(0, 0), (2, 1), (4, 0), (3, 2), (4, 4), (2, 3), (0, 4), (1, 2)], float)
    for _ in range(5):
        moved = star + r.uniform(-1, 1, 2)
        points = r.uniform(0, 4, (40000, 2))

        def inside(ring, p):
            hit = np.zeros(len(p), bool)
            for a, b in zip(ring, np.roll(ring, -1, 0), strict=True):
                hit ^= ((a[1] > p[:, 1]) != (b[1] > p[:, 1])) & (p[:, 0] < (b[0] - a[0]) * (p[:, 1] - a[1]) / (b[1] - a[1] + 1e-300) + a[0])
            return hit

        assert abs(polygons.shared_area(square, moved) - 16 * inside(moved, points).mean()) < 0.2
    assert abs(polygons.shared_area(star, star) - abs(polygons._area(star))) < 1e-9


def test_boxes(spark):
    o = box(spark, ("a", "unit", None, 0, 0, 10, 10, 0, 3), ("b", "unit", None, 6, 5, 16, 15, 1, 6), ("c", "unit", None, 20, 0, 30, 10, 0, 3), ("d", "unit", None, 14, 13, 20, 20, 9, 11))
    pairs = {(r.a_object_id, r.b_object_id): r for r in spatial.box_pairs(o, o, 20.0).select("a_object_id", "b_object_id", spatial.shared_volume().alias("v"), spatial.clearance().alias("d")).collect()}
    assert pairs["a", "b"].v == 4 * 5 * 2 and pairs["a", "b"].d == 0 and pairs["b", "c"].d == 4
    assert pairs["a", "d"].d == pytest.approx(math.sqrt(4**2 + 3**2 + 6**2)) and len(pairs) == 16
    assert [r.object_id for r in spatial.column_at(o, 10.0, 10.0).collect()] == ["b", "a"]
    assert [r.object_id for r in spatial.at_point(o, 8.0, 8.0, 3.0005).collect()] == ["b", "a"]
    assert [r.object_id for r in spatial.at_point(o, 8.0, 8.0, 3.01).collect()] == ["b"]


def test_rules_fire_and_stay_silent(spark):
    good = [("P", "parcel", None, -5, -5, 25, 17, -6, 0), ("B", "building", "P", 0, 0, 20, 12, 0, 6), ("S0", "storey", "B", 0, 0, 20, 12, 0, 3), ("S1", "storey", "B", 0, 0, 20, 12, 3, 6, {"level": 1}),
            ("U0", "unit", "S0", 0, 0, 10, 12, 0, 3), ("U1", "unit", "S0", 10, 0, 20, 12, 0, 3), ("U2", "unit", "S1", 0, 0, 20, 12, 3, 6)]
    assert rules.validate(box(spark, *good)).collect() == []
    bad = [*good, ("U3", "unit", "S1", 19, 2, 23, 6, 3, 6.02), ("S2", "storey", "B", 0, 0, 20, 12, 8, 11, {"level": 2}), ("X", "unit", "gone", 100, 100, 101, 101, 0, 1),
           ("T", "infrastructure", None, -10, 5, 30, 7, -8, -2, {"corridor_kind": "metro"}), ("W", "infrastructure", None, -10, 20, 30, 21, 0, 1, {"corridor_kind": "water"}), ("F", "unit", None, 200, 0, 201, 1, 5, 5, {"recorded_area_m2": 2.0, "provenance": "assumed", "confidence": 0.2})]
    found = {(r.rule, r.object_a, r.object_b): r.measure for r in rules.validate(box(spark, *bad)).collect()}
    assert found["VERT_OVERLAP", "U2", "U3"] == 12 and found["STOREY_GAP", "S1", "S2"] == 2 and ("HIER_ORPHAN", "X", "gone") in found
    assert found["PLAN_CONTAINMENT", "U3", "S1"] == pytest.approx(4 * 2.95) and ("VERT_CONTAINMENT", "S2", "B") in found and ("VERT_CONTAINMENT", "U3", "S1") not in found
    assert found["INFRA_CLEARANCE", "B", "T"] == 2 and not any(k[2] == "W" for k in found if k[0] == "INFRA_CLEARANCE")
    assert ("GEOM_FLAT", "F", None) in found and found["AREA_MISMATCH", "F", None] == 50 and found["PROVENANCE_REVIEW", "F", None] == 1
    counts = {r.severity: r.n for r in rules.severity_counts(rules.validate(box(spark, *good))).collect()}
    assert counts == {"error": 0, "warning": 0, "info": 0}
    looser = TOLERANCES | {"clearance_m": TOLERANCES["clearance_m"] | {"metro": 2.0}}
    assert rules.corridor_clearance(box(spark, *bad), looser).count() == 0


def test_register_rejects_a_second_id(spark):
    o = box(spark, ("a", "unit", None, 0, 0, 1, 1, 0, 1))
    assert register.add(o, box(spark, ("b", "unit", None, 0, 0, 1, 1, 0, 1))).count() == 2
    with pytest.raises(Exception, match="already in the register"):
        register.add(o, o).collect()
    assert register.search(o, "  ").collect() == []
    assert [r.distance for r in hierarchy.ancestors(box(spark, ("a", "parcel", None, 0, 0, 1, 1, 0, 1), ("b", "building", "a", 0, 0, 1, 1, 0, 1))).collect()] == [1]


def test_raster_opening_equals_brute_force(spark):
    r = random.Random(1)
    grid = {(i, j): float(r.randrange(10)) for i in range(8) for j in range(9) if r.random() < 0.85}
    got = {(x.row, x.col): x.value for x in raster.opened(spark.createDataFrame([(i, j, v) for (i, j), v in grid.items()], "row int, col int, value double"), 1).collect()}

    def run(g, f, di, dj):
        return {(i, j): f(g[i + k * di, j + k * dj] for k in (-1, 0, 1) if (i + k * di, j + k * dj) in g) for i, j in g}

    want = grid
    for f in (min, max):
        want = run(run(want, f, 0, 1), f, 1, 0)
    assert got == want and raster.radii(6) == [1, 2, 4, 6] and raster.radii(1) == [1]


def test_ground_filter_on_a_flat_site(spark):
    rows = [(float(x), float(y), 0.1 if not (4 <= x < 10 and 4 <= y < 10) else 8.0) for x in range(16) for y in range(16)]
    p = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "pid long, x double, y double, z double")
    got = raster.classified(p, raster.ground(p, 0.0, 0.0, 1.0, 6), 0.0, 0.0, 1.0).withColumn("truth", F.col("z") < 1)
    s = one(scoring.confusion(got, "truth", "is_ground"))
    assert s.kappa == 1 and s.tp == 220 and s.tn == 36


def test_ground_below_a_wide_object(spark):
    cells = [(x, y) for x in range(60) for y in range(60)]
    wide = [8 <= x < 52 and 8 <= y < 52 for x, y in cells]  # its middle lies 22 cells from terrain
    p = spark.createDataFrame([(i, float(x), float(y), 8.0 if w else 0.1) for i, ((x, y), w) in enumerate(zip(cells, wide))], "pid long, x double, y double, z double")
    got = raster.classified(p, raster.ground(p, 0.0, 0.0, 1.0, 24), 0.0, 0.0, 1.0).collect()
    assert {r.pid: r.is_ground for r in got} == {i: not w for i, w in enumerate(wide)}


def test_clusters_planes_and_features(spark):
    r = random.Random(2)
    flat = [(i, r.uniform(0, 4), r.uniform(0, 4), 0.0) for i in range(300)]
    away = [(1000 + i, 20 + r.uniform(0, 1), r.uniform(0, 1), r.uniform(0, 1)) for i in range(60)]
    p = spark.createDataFrame([*flat, *away, (5000, 50.0, 50.0, 0.0)], "pid long, x double, y double, z double")
    label = {x.pid: x.cluster for x in cloud.dbscan(p, 0.8, 4).collect()}
    assert {label[i] for i, *_ in flat} == {0} and {label[i] for i, *_ in away} == {1} and label[5000] is None
    f = {x.pid: x for x in cloud.features(p, 0.9).collect()}
    xyz = {i: np.array(v) for i, *v in [*flat, *away]}
    near = sorted((np.sum((xyz[5] - v) ** 2), i) for i, v in xyz.items() if np.sum((xyz[5] - v) ** 2) <= 0.81)[:40]
    e = np.linalg.eigvalsh(np.cov(np.array([xyz[i] for _, i in near]).T, bias=True))[::-1]
    assert f[5].planarity == pytest.approx((e[1] - e[2]) / e[0], abs=1e-6) and f[5].linearity == pytest.approx((e[0] - e[1]) / e[0], abs=1e-6)
    assert f[5000].planarity == 0
    q = one(cloud.planes(p.where("pid < 1000").withColumn("b", F.lit(1)), "b"))
    assert q.nz == pytest.approx(1) and q.n_in == 300


def test_planes_in_turn(spark):
    r = random.Random(8)
    faces = [lambda x, y: 0.0, lambda x, y: 5 + x, lambda x, y: 30 - y]
    rows = [(g, x, y, f(x, y) + r.uniform(-0.02, 0.02)) for g in range(2) for f, n in zip(faces, (6000, 3000, 1500) if g == 0 else (200, 120, 90)) for x, y in ((r.uniform(0, 9), r.uniform(0, 9)) for _ in range(n))]
    p = spark.createDataFrame([(i, *v) for i, v in enumerate(rows)] + [(-1, None, 0.0, 0.0, 0.0)], "pid long, b int, x double, y double, z double").repartition(4)
    got = {(q.b, q.plane): q for q in cloud.planes(p, "b").collect()}
    assert set(got) == {(g, i) for g in range(2) for i in range(3)} | {(None, 0)} and got[None, 0].n_in == 0 and got[None, 0].n == 1
    for g, sizes in ((0, (6000, 3000, 1500)), (1, (200, 120, 90))):
        for i, (n, normal) in enumerate(zip(sizes, ((0, 0, 1), (-(0.5**0.5), 0, 0.5**0.5), (0, 0.5**0.5, 0.5**0.5)))):
            q = got[g, i]
            assert (q.nx, q.ny, q.nz) == pytest.approx(normal, abs=0.01) and q.n_in == pytest.approx(n, rel=0.05)


def test_greedy_matching(spark):
    r = random.Random(3)
    pairs = [(f"t{i}", f"p{j}", r.randrange(1, 6) / 10) for i in range(12) for j in range(12) if r.random() < 0.4]
    got = {(x.truth, x.predicted) for x in scoring.greedy_match(spark.createDataFrame(pairs, "truth string, predicted string, iou double")).collect()}
    want, left = set(), sorted(((v, t, p) for t, p, v in pairs), reverse=True)
    while left:
        _, t, p = left[0]
        want.add((t, p))
        left = [x for x in left if x[1] != t and x[2] != p]
    assert got == want


def test_plan_stacking_and_errors(spark):
    ring = [[0, 0], [13, 0], [13, 20], [0, 20]]
    floors = [{"level": 0, "height": 3.6, "units": [{"name": "Shop", "boundary": ring}]}, {"level": 1, "repeat_to": 3, "units": [{"name": "Flat {n}", "owner": "O{n}", "boundary": ring}]}, {"level": -1, "units": []}]
    good = json.dumps({"site": {"name": "s", "lat": 18.5, "lon": 73.8}, "parcels": [{"id": "P", "boundary": ring}], "buildings": [{"floors": floors}], "infrastructure": [{"alignment": [[0, 0], [0, 10]]}]})
    bad = json.dumps({"site": {"lat": 1, "lon": 2}, "parcels": [{"boundary": [[0, 0]]}]})
    p = plan2d.parse(spark.createDataFrame([(1, good), (2, bad), (3, json.dumps({"site": {"lat": 1, "lon": 2}}))], "k long, plan string"))
    assert {r.k: r.problem for r in p.collect()} == {1: None, 2: "parcel P-01: a boundary needs at least 3 corner points, got 1", 3: "needs parcels or buildings"}
    levels = plan2d.stacked(plan2d.expanded(plan2d.buildings(p, "k"), "k"), "k")
    z = {r.level: (round(r.z_min, 3), round(r.z_max, 3)) for r in levels.collect()}
    assert z == {-1: (-3.0, 0.0), 0: (0.0, 3.6), 1: (3.6, 6.6), 2: (6.6, 9.6), 3: (9.6, 12.6)}
    u = plan2d.units(levels, "k")
    assert {(r.name, r.owner, r.unit_no) for r in u.collect()} == {("Shop", "", 1), ("Flat 1", "O1", 101), ("Flat 2", "O2", 201), ("Flat 3", "O3", 301)}
    assert one(u.where("level = 1").select((F.abs(polygons.signed_area(F.col("ring"))) * (F.col("z_max") - F.col("z_min"))).alias("v"))).v == pytest.approx(13 * 20 * 3)
    c = one(polygons.sweep(plan2d.corridors(p, "k"), "k"))
    assert (c.length, c.z_min, c.z_max) == (10, -4.0, -2.5)
    assert "Flat 2" in one(plan2d.drawing(u, "k").where("level = 2")).svg


def test_files_round_trip(spark, tmp_path):
    import struct

    head = bytearray(227)
    head[:4], head[24:26], head[104] = b"LASF", bytes([1, 2]), 0
    head[96:100], head[105:107], head[107:111] = struct.pack("<I", 227), struct.pack("<H", 20), struct.pack("<I", 2)
    head[131:179] = struct.pack("<6d", 0.01, 0.01, 0.001, 100.0, 200.0, 0.0)
    body = b"".join(struct.pack("<iiiHBBbBH", x, y, z, 7, 0b010001, c, 0, 0, 0) for x, y, z, c in ((100, 200, 3000, 2), (-100, 0, 500, 6)))
    (tmp_path / "a.las").write_bytes(bytes(head) + body)
    got = pointfiles.read(spark, str(tmp_path / "a.las")).orderBy("z").collect()
    assert [(round(r.x, 3), round(r.y, 3), r.z, r.classification, r.return_number, r.intensity) for r in got] == [(99.0, 200.0, 0.5, 6, 1, 7), (101.0, 202.0, 3.0, 2, 1, 7)]
    o = box(spark, ("P&1", "parcel", None, 0, 0, 10, 10, 0, 3))
    files.save(o, str(tmp_path / "register"))
    assert files.load(spark, str(tmp_path / "register")).count() == 1
    place = ({"state": "27", "district": "025", "tehsil": "004"}, {"lat": 18.5, "lon": 73.8, "height": 0.0})
    files.save_document(o, str(tmp_path / "document"), "Site", *place)
    again, head = files.load_document(spark, str(tmp_path / "document"))
    assert again.count() == 1 and head["stats"]["by_kind"] == {"parcel": 1} and head["jurisdiction"] == place[0] and head["origin"] == place[1]
    with pytest.raises(Exception, match="already exists"):
        files.save_document(o, str(tmp_path / "document"), "Site", *place)
    files.save_document(o.union(o), str(tmp_path / "doubled"), "Site", *place)
    with pytest.raises(ValueError, match="more than once: object_id P&1"):
        files.load_document(spark, str(tmp_path / "doubled"))
    o.write.mode("append").partitionBy("kind").parquet(str(tmp_path / "document" / "objects"))
    with pytest.raises(ValueError, match="more than once"):
        files.load_document(spark, str(tmp_path / "document"))
    f = json.loads(one(files.geojson(o, geodesy.Local(18.5, 73.8))).feature)
    ring = f["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] == [73.8, 18.5] and f["properties"]["area_m2"] == 100
    assert 'id="P&amp;1"' in one(files.citygml(o, geodesy.Local(18.5, 73.8))).element
    (tmp_path / "p.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"properties": {"parcel_id": "P", "owner": "o", "land_use": "x"}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}))
    assert len(one(files.read_features(spark, str(tmp_path / "p.json"))).ring) == 5
    (tmp_path / "c.csv").write_text("x,y,z,classification,intensity,return_number\n1,2,3,2,5,1\n")
    assert one(files.read_points(spark, str(tmp_path / "c.csv"))).z == 3.0
