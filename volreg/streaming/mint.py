"""Identifiers and checks for objects that arrive as a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import idcode
from ..shared import on_workers

#: Where numbers are given: a geohash cell of about a square metre, a layer and a level.
CELL = ["geohash", "stratum", "level"]
#: The state of minting lives in this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NUMBERED = "object_id string, geohash string, stratum string, level int, unit int, verdict string"


#: Numbers that stand in one entry of the state, and entries that a task holds at once.
BLOCK, HELD = 64, 16


class Numbers(StatefulProcessor):
    """Unit numbers of one cell.

    ``blocks`` has the taken numbers by runs of ``BLOCK``: each number's holder (null if it
    is free) and a number above it from which the search for a free one may go on, so a long
    run of taken numbers is not walked again for each arrival; ``free`` is the least number
    that may be free. As each call of the state crosses to the JVM, a block is read once for
    all rows that need it and written once after them; ``HELD`` blocks are in memory at
    most, so no set of a cell's numbers is ever built.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.blocks = handle.getMapState("blocks", "block int", "holders array<string>, after array<int>")
        self.free = handle.getValueState("free", "unit int")
        self.held: dict[int, list] = {}

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:
        for unit, holder in zip(initialState.units, initialState.holders, strict=True):
            self.take(unit, holder)
        self.put_back()

    def block(self, unit: int) -> list:
        """[holders, after, whether changed] of a number's block, the latest used last."""
        k = unit // BLOCK
        b = self.held.pop(k, None)
        if b is None:
            if len(self.held) >= HELD:
                self.put_back(next(iter(self.held)))
            holders, after = self.blocks.getValue((k,)) if self.blocks.containsKey((k,)) else ([], [])
            b = [list(holders), list(after), False]
        self.held[k] = b
        return b

    def put_back(self, *which: int) -> None:
        for k in which or list(self.held):
            holders, after, changed = self.held.pop(k)
            if changed:
                self.blocks.updateValue((k,), (holders, after))

    def holder(self, unit: int) -> str | None:
        holders, i = self.block(unit)[0], unit % BLOCK
        return holders[i] if i < len(holders) else None

    def after(self, unit: int) -> int | None:
        """The number to go on with if ``unit`` is taken."""
        after, i = self.block(unit)[1], unit % BLOCK
        return after[i] if i < len(after) else None

    def go_on(self, unit: int, to: int) -> None:
        b = self.block(unit)
        b[1][unit % BLOCK], b[2] = to, True

    def take(self, unit: int, holder: str) -> None:
        b, i = self.block(unit), unit % BLOCK
        for values in b[:2]:
            values.extend([None] * (i + 1 - len(values)))
        b[0][i], b[1][i], b[2] = holder, unit + 1, True

    def first_free(self, unit: int) -> int:
        seen = []
        while (after := self.after(unit)) is not None:
            seen.append((unit, after))
            unit = after
        for at, after in seen:
            if after != unit:
                self.go_on(at, unit)
        return unit

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        was = free = self.free.get()[0] if self.free.exists() else None
        for r in rows:
            if r.claimed is not None:
                unit = r.claimed
                taken, holder = self.after(unit) is not None, self.holder(unit)
                verdict = "registered" if not taken else "held" if holder == r.object_id else "taken"
            else:
                wish = r.preferred if r.preferred is not None and 0 <= r.preferred <= idcode.MAX_UNIT else 0
                if wish == 0 and free is not None:
                    wish = free
                unit, verdict = self.first_free(wish), "minted"
                if r.preferred is None or r.preferred <= 0 or r.preferred > idcode.MAX_UNIT:
                    free = min(unit + 1, idcode.MAX_UNIT + 1)
                if unit > idcode.MAX_UNIT:
                    unit, verdict = None, "exhausted"
            if verdict in ("minted", "registered"):
                self.take(unit, r.object_id)
            yield Row(object_id=r.object_id, geohash=key[0], stratum=key[1], level=key[2], unit=unit if verdict != "taken" else None, verdict=verdict)
        if free != was:
            self.free.update((free,))
        self.put_back()

    def close(self) -> None:
        pass


def _own(fields: Column, state: str, district: str, tehsil: str) -> Column:
    return (fields["state"] == idcode.jurisdiction(F.lit(state), 2)) & (fields["district"] == idcode.jurisdiction(F.lit(district), 3)) & (fields["tehsil"] == idcode.jurisdiction(F.lit(tehsil), 3))


def mint_stream(arrivals: DataFrame, state: str, district: str, tehsil: str, register: DataFrame | None = None) -> DataFrame:
    """Streamed ``(object_id, lat, lon, stratum, level, preferred, code)`` with number, code and verdict.

    A row without a code is *minted*: the first free number of its cell at or above
    ``preferred`` (0 if null or out of range), in order of arrival; *exhausted* if there is
    none. A row with a code, in any spelling, claims it: *registered* if it was free,
    *held* if the same object has it, else *taken*. Codes that are no codes are *invalid*,
    those of another jurisdiction *foreign*, rows without a code and a position
    *unplaced*; they never reach the state. Refused rows have neither unit nor code.

    ``register`` has (object_id, code) of what was issued before the stream began; it is
    read with the first batch only. Its codes of other jurisdictions, and texts that are no
    codes, take no numbers. The session must keep state in ``STORE``.
    """
    on_workers(arrivals.sparkSession)
    known = arrivals.withColumn("_e", F.when(F.col("code").isNotNull(), idcode.examined(F.col("code"))))
    fields = F.col("_e.fields")
    there = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180) & F.col("stratum").isNotNull() & F.col("level").between(-idcode.MAX_LEVEL, idcode.MAX_LEVEL)
    refused = (
        F.when(F.col("code").isNull(), F.when(~F.coalesce(there, F.lit(False)), "unplaced"))
        .when(F.col("_e.problem").isNotNull(), "invalid").when(~_own(fields, state, district, tehsil), "foreign")
    )
    known = known.withColumn("verdict", refused)
    fine = known.where("verdict is null").select(
        "object_id", F.coalesce(fields["geohash"], F.when(fields.isNull(), idcode.geohash_encode(F.col("lat"), F.col("lon")))).alias("geohash"), F.coalesce(fields["stratum"], "stratum").alias("stratum"),
        F.coalesce(fields["level"], F.abs("level")).cast("int").alias("level"), F.col("preferred").cast("int").alias("preferred"), fields["unit"].alias("claimed"))
    before = None
    if register is not None:
        issued = register.select("object_id", idcode.parsed(F.col("code")).alias("f")).where(_own(F.col("f"), state, district, tehsil))
        # of several objects with one code the smallest holds it
        before = issued.groupBy(*(F.col(f"f.{c}").alias(c) for c in CELL), F.col("f.unit").alias("unit")).agg(F.min("object_id").alias("object_id"))
        # a block's numbers go into the state together
        before = before.groupBy(*CELL, F.expr(f"unit div {BLOCK}").alias("block")).agg(F.collect_list(F.struct("unit", "object_id")).alias("taken"))
        before = before.select(*CELL, F.col("taken.unit").alias("units"), F.col("taken.object_id").alias("holders")).groupBy(*CELL)
    numbered = fine.groupBy(*CELL).transformWithState(Numbers(), _NUMBERED, "Append", "None", initialState=before)
    code = idcode.compact(F.lit(state), F.lit(district), F.lit(tehsil), F.col("geohash"), F.col("stratum"), F.col("level"), F.col("unit"))
    numbered = numbered.withColumn("code", F.when(F.col("unit").isNotNull(), code))
    none = known.where("verdict is not null").select("object_id", F.lit(None).cast("string").alias("geohash"), "stratum", F.abs("level").cast("int").alias("level"), F.lit(None).cast("int").alias("unit"), "verdict", F.lit(None).cast("string").alias("code"))
    return numbered.union(none)


def activity(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums of ``(ts, event_type, value)`` by window; rows later than the watermark are left out of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
