"""Steps whose work must not grow faster than their input: equal places, single files, parsed documents."""

from pyspark.sql import functions as F

from volreg.operators import cloud


def _copies(spark):
    # 3 places, of 40, 3 and 30 points; the last one out of reach of the first
    rows = [(i, *((0.0, 0.0, 0.0) if i % 73 < 40 else (0.5, 0.0, 0.0) if i % 73 < 43 else (1.25, 0.0, 0.0))) for i in range(73)]
    return spark.createDataFrame([(r[0] * 29 % 73, *r[1:]) for r in rows], "pid long, x double, y double, z double")


def test_nearest_of_equal_places_as_from_all_pairs(spark):
    p = _copies(spark)
    for k in (2, 8, 41, 100):
        want = {(r.pid, r.other, r.place) for r in cloud.nearest(cloud.neighbours(p, p, 1.0), k).collect()}
        near = cloud.nearest_within(p, p, 1.0, k)
        assert {(r.pid, r.other, r.place) for r in p.join(near, ["x", "y", "z"]).select("pid", "other", "place").collect()} == want
        # a place's neighbours are sought once, not once a point
        assert near.count() <= 3 * k


def test_clusters_of_equal_places(spark):
    p = _copies(spark)
    got = {r.pid: r.cluster for r in cloud.dbscan(p, 0.6, 42).collect()}
    # the first place reaches 43 points, the second too; the third has 30 and stays noise
    at = {r.pid: r.x for r in p.collect()}
    assert got == {pid: 0 if x < 1 else None for pid, x in at.items()}
    assert {(r.x, r.n) for r in cloud.places(p).select("x", F.col("n")).collect()} == {(0.0, 40), (0.5, 3), (1.25, 30)}


def test_documents_are_parsed_once(spark):
    from volreg.plans import plan2d

    d = spark.createDataFrame([(1, '{"site": {"lat": 1, "lon": 2}, "parcels": [{"boundary": [[0, 0], [1, 0], [1, 1]]}]}'), (2, "{")], "plan_id int, plan string")
    fine = plan2d.parse(d).where("problem is null").select("plan_id", "p.site.lat")
    assert [tuple(r) for r in fine.collect()] == [(1, 1.0)]
    # the filter would carry the parser to each of the places it judges
    assert "from_json" not in fine._jdf.queryExecution().optimizedPlan().toString()


def test_costly_rows_are_spread_over_the_cores(spark):
    from volreg import more_queries, solid_queries

    from .conftest import SMALL

    least = 4 * spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{SMALL}/part.parquet").rdd.getNumPartitions() < least
    for df in (solid_queries.sites(spark, SMALL), more_queries.plans(spark, SMALL)):
        assert df.rdd.getNumPartitions() >= least


def test_slabs_of_a_union_go_in_blocks(spark, monkeypatch):
    import numpy as np

    from volreg.functions import overlay

    box = lambda x, y, w: [np.array([(x, y), (x + w, y), (x + w, y + w), (x, y + w)], float)]
    shapes = [box(0, 0, 4), box(2, 2, 4), box(20, 0, 1)]
    whole = overlay.joined(shapes)
    assert overlay.area(whole) == 16 + 16 - 4 + 1
    monkeypatch.setattr(overlay, "_BLOCK", 1)
    assert np.array_equal(overlay.joined(shapes), whole)
    assert overlay.area(overlay.less(shapes[0], shapes[1])) == 12 and overlay.area(overlay.both(shapes[0], shapes[1])) == 4


def test_an_element_is_read_in_one_pass(spark):
    from volreg import more_queries

    from .conftest import SMALL

    plan = more_queries.citygml_export(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "xpath" not in plan


def _stars(n, seed):
    import numpy as np

    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        k = rng.integers(3, 9)
        a, r = np.sort(rng.uniform(0, 2 * np.pi, k)), rng.uniform(1, 5, k)
        out.append([rng.uniform(-3, 3, 2) + np.column_stack([r * np.cos(a), r * np.sin(a)])])
    # a shape with a hole, and one without corners
    out[1] = [np.array([(-4, -4), (4, -4), (4, 4), (-4, 4)], float), np.array([(-1, -1), (-1, 1), (1, 1), (1, -1)], float)]
    out[2] = []
    return out


def test_overlays_of_a_batch_as_of_each_pair(monkeypatch):
    import numpy as np

    from volreg.functions import overlay, overlays

    x, y = _stars(60, 1), _stars(60, 2)[::-1]
    a, b, n = overlays.read(overlays.write(x)), overlays.read(overlays.write(y)), 60
    same = lambda s, t: len(s) == len(t) and all(np.array_equal(p, q) for p, q in zip(s, t, strict=True))
    for pairs in (1 << 20, 50):
        # in one piece, and in many
        monkeypatch.setattr(overlays, "_PAIRS", pairs)
        for wanted, one in ((overlays.BOTH, overlay.both), (overlays.LESS, overlay.less), (overlays.JOINED, lambda p, q: overlay.joined([p, q]))):
            found = overlays.borders(*overlays.pairwise(a, b, n, wanted), n)
            assert all(same(found[i], overlay.rings(one(x[i], y[i]))) for i in range(n))
        assert np.allclose(overlays.shared(a, b, n), [overlay.area(overlay.both(p, q)) for p, q in zip(x, y, strict=True)])
        assert np.allclose(overlays.beyond(a, b, n, 0.05), [overlay.beyond(p, q, 0.05) for p, q in zip(x, y, strict=True)], atol=1e-5)
        assert np.allclose(overlays.apart(a, b, n), [overlay.distance(p, q) for p, q in zip(x, y, strict=True)])
        assert overlays.crossing(a, n).tolist() == [overlay.crosses_itself(s) for s in x]
    whole = overlays.pairwise(a, b, n, overlays.JOINED)
    # rows of very many edges go one by one
    monkeypatch.setattr(overlays, "_MANY", 5)
    assert all(np.array_equal(p, q) for p, q in zip(whole, overlays.pairwise(a, b, n, overlays.JOINED), strict=True))


def test_footprints_of_a_batch_are_laid_as_each_alone():
    import numpy as np

    from volreg.functions import overlay, overlays

    def one(s):
        if not s:
            return []
        v = np.roll(s[0], -1, 0) - s[0]
        n, turn = np.hypot(*v.T), np.arctan2(v[:, 1], v[:, 0])
        long = n > 0.3
        return [overlay.regular(s[0], np.arctan2((n * np.sin(4 * turn))[long].sum(), (n * np.cos(4 * turn))[long].sum()) / 4)]

    x = _stars(200, 3)
    found = overlays.regularised(overlays.read(overlays.write(x)), 200)
    for s, t in zip(found, map(one, x), strict=True):
        assert len(s) == len(t) and all(p.shape == q.shape and np.allclose(p, q) for p, q in zip(s, t, strict=True))


def test_parts_of_the_register_are_spread(spark):
    from volreg import fixtures

    from .conftest import SMALL

    least = 4 * spark.sparkContext.defaultParallelism
    for df in (fixtures.buildings(spark, SMALL), fixtures.storeys(spark, SMALL), fixtures.air_rights(spark, SMALL)):
        assert df.rdd.getNumPartitions() >= least


def test_a_position_is_computed_once(spark):
    from volreg import solid_queries
    from volreg.sources import files

    from .conftest import SMALL

    p, o = solid_queries.split(spark, SMALL)
    plan = files.plan_geojson(p, o.select("object_id", "kind"), solid_queries.ORIGIN)._jdf.queryExecution().optimizedPlan().toString()
    # longitude, the reduced latitude, the latitude
    assert plan.count("ATAN2(") == 3


class _Calls:
    def __init__(self):
        self.values, self.calls = {}, 0

    def getMapState(self, *_):
        return self

    def getValueState(self, *_):
        return self

    def containsKey(self, key):
        self.calls += 1
        return key in self.values

    def getValue(self, key):
        self.calls += 1
        return self.values[key]

    def updateValue(self, key, value):
        self.calls += 1
        self.values[key] = value

    def exists(self):
        return None in self.values

    def get(self):
        return self.values[None]

    def update(self, value):
        self.values[None] = value


def test_calls_of_the_state_grow_with_its_blocks_not_with_arrivals():
    from pyspark.sql import Row

    from volreg.streaming import mint

    state, numbers = _Calls(), mint.Numbers()
    numbers.init(state)
    numbers.handleInitialState(("c", "G", 0), Row(units=list(range(0, 64, 2)), holders=[f"o{u}" for u in range(0, 64, 2)]), None)
    rows = [Row(object_id=f"n{i}", preferred=None if i % 2 else 1000 + i % 7, claimed=None) for i in range(400)]
    got = list(numbers.handleInputRows(("c", "G", 0), iter(rows), None))
    low = [r.unit for r in got if r.unit < 1000]
    assert low == [*range(1, 64, 2), *range(64, 232)] and sorted(r.unit for r in got if r.unit >= 1000) == list(range(1000, 1200))
    # three calls for each block that is read and written
    assert state.calls <= 3 * 10
    # what is put back is found again, whatever is held
    claims = [Row(object_id="n1", preferred=None, claimed=1), Row(object_id="x", preferred=None, claimed=1), Row(object_id="x", preferred=None, claimed=10**6)]
    assert [r.verdict for r in numbers.handleInputRows(("c", "G", 0), iter(claims), None)] == ["held", "taken", "registered"]
    assert list(numbers.handleInputRows(("c", "G", 0), iter([Row(object_id="y", preferred=10**6, claimed=None)]), None))[0].unit == 10**6 + 1


def test_clusters_link_cubes_not_points(spark, monkeypatch):
    import random

    r = random.Random(4)
    # a winding strip through many cubes, a lump, and loose points, of which some lie at borders of clusters
    rows = [(i, i / 40 + r.uniform(-0.2, 0.2), 3 * ((i // 400) % 2) + r.uniform(-0.2, 0.2), 0.0) for i in range(1600)]
    rows += [(2000 + i, 60 + r.uniform(0, 2), -9 + r.uniform(0, 2), r.uniform(0, 2)) for i in range(300)] + [(3000 + i, r.uniform(-5, 70), r.uniform(-12, 6), 0.0) for i in range(200)]
    eps, least = 0.5, 6
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a[1:], b[1:], strict=True))
    near = {a[0]: [b for b in rows if d2(a, b) <= eps * eps] for a in rows}
    core = {i for i, found in near.items() if len(found) >= least}
    label = {}
    for i in sorted(core):
        stack = [] if i in label else [i]
        while stack:
            at = stack.pop()
            if at not in label:
                label[at] = i
                stack += [b[0] for b in near[at] if b[0] in core]
    for a in rows:
        homes = [(d2(a, b), b[0]) for b in near[a[0]] if b[0] in core]
        if a[0] not in core and homes:
            label[a[0]] = label[min(homes)[1]]
    sizes = {x: sum(y == x for y in label.values()) for x in label.values()}
    number = {x: i for i, x in enumerate(sorted(sizes, key=lambda x: (-sizes[x], x)))}
    links, whole = [], cloud.connected
    monkeypatch.setattr(cloud, "connected", lambda nodes, by: links.append(by.count()) or whole(nodes, by))
    got = {x.pid: x.cluster for x in cloud.dbscan(spark.createDataFrame(rows, "pid long, x double, y double, z double"), eps, least).collect()}
    assert got == {a[0]: number[label[a[0]]] if a[0] in label else None for a in rows}
    assert len(number) > 3 and 0 < sum(links) < 100  # thousands of pairs of points


def test_pairs_are_met_in_blocks(monkeypatch):
    import numpy as np

    from volreg.operators import near

    r = np.random.default_rng(3)
    a, b = r.uniform(-4, 4, (90, 3)), np.round(r.uniform(-4, 4, (140, 3)) * 2) / 2
    want = {(i, j) for i in range(90) for j in range(140) if ((a[i] - b[j]) ** 2).sum() <= 2.25}
    for most in (1 << 20, 7):
        monkeypatch.setattr(near, "BLOCK", most)
        found = list(near.pairs(a, b, 1.5))
        assert sorted((int(i), int(j)) for x, y, _ in found for i, j in zip(x, y, strict=True)) == sorted(want)
        # all of one point in one block
        assert sum(len(set(x.tolist())) for x, _, _ in found) == len({i for i, _ in want})


def test_borders_of_a_batch_are_chained_at_once(monkeypatch):
    import numpy as np

    from volreg.functions import overlay, overlays

    r = np.random.default_rng(6)

    def box():
        # on a lattice, so that sides are shared and rings touch at corners
        (x, y), (w, h) = r.integers(0, 4, 2), r.integers(1, 4, 2)
        return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)[:: r.choice([1, -1])]

    same = lambda s, t: len(s) == len(t) and all(p.shape == q.shape and np.allclose(p, q, rtol=0, atol=1e-12) for p, q in zip(s, t, strict=True))
    one, calls = overlay.rings, []
    for x, y in ((_stars(80, 3), _stars(80, 4)[::-1]), ([[box(), box()] for _ in range(80)], [[box()] for _ in range(80)])):
        a, b, n = overlays.read(overlays.write(x)), overlays.read(overlays.write(y)), 80
        united = [one(overlay.joined([p, q])) for p, q in zip(x, y, strict=True)]
        for pairs in (1 << 20, 900):
            monkeypatch.setattr(overlays, "_PAIRS", pairs)
            found = overlays.outlines(*overlays.pairwise(a, b, n, overlays.JOINED), n)
            assert all(same(*s) for s in zip(overlays.shapes(found, n), united, strict=True))
        assert all(same(s, [overlay.simplified(p, 0.3) for p in t]) for s, t in zip(overlays.shapes(overlays.simplified(found, 0.3), n), united, strict=True))
        assert all(same(s, overlay.buffered(t, 0.35)) for s, t in zip(overlays.shapes(overlays.buffered(a, n, 0.35), n), x, strict=True))
        assert all(same(s, overlay.clean(t)) for s, t in zip(overlays.cleaned(a, n), x, strict=True))
        assert overlays.write(overlays.shapes(found, n)).equals(overlays.arrow(found, n))
    # rows without rings that touch need no call of their own
    a, b, n = overlays.read(overlays.write(_stars(80, 3))), overlays.read(overlays.write(_stars(80, 4))), 80
    monkeypatch.setattr(overlay, "rings", lambda t: calls.append(1) or one(t))
    assert len(overlays.outlines(*overlays.pairwise(a, b, n, overlays.JOINED), n).size) >= 79 and len(calls) < 8


def test_tables_of_many_rows_are_not_broadcast(spark):
    from volreg.shared import stored

    # a few kilobytes of files that would be many megabytes in the driver
    many = stored(spark.range(400_000).select("id", F.lit(1.0).alias("v")), "many")
    few = stored(spark.range(100).select("id", F.lit("x").alias("w")), "few")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(spark.range(10**8).join(many.select("id", (F.col("v") + 1).alias("v")), "id"))
    assert "BroadcastHashJoin" in plan(spark.range(10**8).join(few, "id"))


def test_rasters_and_stages_are_not_broadcast(spark, tmp_path):
    from volreg.operators import raster, survey

    cells = spark.range(300).select((F.col("id") % 20).cast("int").alias("row"), F.floor(F.col("id") / 20).cast("int").alias("col"), F.lit(1.0).alias("value"))
    p = spark.range(50).select(F.col("id").alias("pid"), (F.col("id") % 7 / 2).alias("x"), (F.col("id") % 5 / 2).alias("y"), F.lit(3.0).alias("z"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for df in (raster.classified(p, cells, 0.0, 0.0, 1.0), raster.sample(cells, p, 0.0, 0.0, 1.0), raster.sample(cells, p, 0.0, 0.0, 1.0, "nearest")):
        assert df.count() == 50 and "BroadcastHashJoin" not in plan(df)
    stage = survey.Stages(spark, str(tmp_path)).run("many", lambda: spark.range(60_000).select("id", F.lit(1.0).alias("v")))
    assert "BroadcastHashJoin" not in plan(spark.range(10**8).join(stage, "id"))


def test_the_rules_on_parents_share_a_join(spark):
    from volreg.fixtures import register
    from volreg.operators import reports, rules
    from volreg.shared import stored

    from .conftest import SMALL

    o = stored(register(spark, SMALL), "register")
    each = rules.plan_containment(o).unionByName(rules.vertical_containment(o))
    both = rules.containment(o)
    assert sorted(map(repr, both.collect())) == sorted(map(repr, each.collect())) and both.count() > 0
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(both) == 1 and joins(each) == 2
    # texts are made of what the joins bring, not carried through them
    plan = reports.described(both, o)._jdf.queryExecution().optimizedPlan().toString()
    assert "replace(" not in plan[plan.index("Join ") :]
