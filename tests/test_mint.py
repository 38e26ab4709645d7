"""Numbers for objects that arrive as a stream: state, restarts, refusals."""

import pytest
from pyspark.sql import functions as F

from volreg.functions import idcode
from volreg.streaming import mint

ARRIVALS = "object_id string, lat double, lon double, stratum string, level int, preferred int, code string"
PLACE = (18.52, 73.85)


@pytest.fixture
def store(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, mint.STORE)
    yield
    spark.conf.set(name, before)


def code(spark, unit, district="25", level=1, stratum="B"):
    lit = F.lit
    made = idcode.compact(lit("27"), lit(district), lit("4"), idcode.geohash_encode(lit(PLACE[0]), lit(PLACE[1])), lit(stratum), lit(level), lit(unit))
    return spark.range(1).select(made.alias("c")).first().c


def feed(spark, at, rows, register=None):
    """Add rows to the source, run what is new through the stream, and give all that has come out so far."""
    spark.createDataFrame(rows, ARRIVALS).coalesce(1).write.mode("append").parquet(f"{at}/in")
    stream = spark.readStream.schema(ARRIVALS).parquet(f"{at}/in")
    out = mint.mint_stream(stream, "27", "25", "4", register)
    q = out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return {r.object_id: (r.unit, r.verdict, r.code) for r in spark.read.parquet(f"{at}/out").collect()}


def test_numbers_survive_restarts_and_follow_the_register(spark, store, tmp_path):
    register = spark.createDataFrame([("old0", code(spark, 0)), ("old1", code(spark, 1)), ("old1b", code(spark, 1)), ("far", code(spark, 2, district="99")), ("none", "x"), ("null", None)], "object_id string, code string")
    at = lambda name, preferred=None, code=None, level=1: (name, *PLACE, "B", level, preferred, code)
    first = feed(spark, tmp_path, [at("a"), at("b", 5), at("c", 5), at("d", 0), at("e", None, None, 2)], register)
    # 0 and 1 are issued; a code of another district takes no number here
    assert {k: v[0] for k, v in first.items()} == {"a": 2, "b": 5, "c": 6, "d": 3, "e": 0}
    assert first["a"][2] == code(spark, 2) and {v[1] for v in first.values()} == {"minted"}
    # a new query on the same folders goes on where the last one ended
    claims = [at("old1", None, code(spark, 1)), at("other", None, code(spark, 1)), at("new", None, code(spark, 7)), at("f", 5), at("g"), at("h", -3), at("i", idcode.MAX_UNIT + 1)]
    second = feed(spark, tmp_path, claims, register)
    got = {k: v[:2] for k, v in second.items() if k not in first}
    assert got["old1"] == (1, "held") and got["other"] == (None, "taken") and got["new"] == (7, "registered")
    assert got["f"] == (8, "minted") and sorted(got[x][0] for x in "ghi") == [4, 9, 10]
    assert {k: second[k] for k in first} == first
    issued = [v[2] for v in second.values() if v[1] in ("minted", "registered")]
    assert len(set(issued)) == len(issued)


def test_refusals_are_rows(spark, store, tmp_path):
    good = code(spark, 3)
    wrong = good[:-1] + ("A" if good[-1] != "A" else "B")
    rows = [
        ("ok", *PLACE, "B", 1, None, None), ("spelled", *PLACE, "B", 1, None, good[:8].lower() + "-" + good[8:]), ("check", *PLACE, "B", 1, None, wrong), ("short", *PLACE, "B", 1, None, ""),
        ("foreign", *PLACE, "B", 1, None, code(spark, 3, district="99")), ("nowhere", None, 1.0, "B", 1, None, None), ("pole", 91.0, 1.0, "B", 1, None, None), ("layerless", *PLACE, None, 1, None, None), ("deep", *PLACE, "U", -2, None, None),
    ]
    got = feed(spark, tmp_path, rows)
    assert {k: v[1] for k, v in got.items()} == {"ok": "minted", "spelled": "registered", "check": "invalid", "short": "invalid", "foreign": "foreign", "nowhere": "unplaced", "pole": "unplaced", "layerless": "unplaced", "deep": "minted"}
    assert all((v[0] is None) == (v[2] is None) == (v[1] not in ("minted", "registered")) for v in got.values())
    assert got["spelled"][2] == good and got["deep"][2] == code(spark, 0, level=2, stratum="U")


def test_a_cell_at_its_last_number(spark, store, tmp_path):
    last = idcode.MAX_UNIT
    got = feed(spark, tmp_path, [(x, *PLACE, "B", 1, last, None) for x in "ab"] + [("c", *PLACE, "B", 1, None, None)])
    assert sorted(got[x][1] for x in "ab") == ["exhausted", "minted"] and got["c"][:2] == (0, "minted")
