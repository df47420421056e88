"""Sliding-window counts of failed logins on a stream, right in whatever order the failures arrive.

Failures are keyed by source and stretch of event time, so a source with a third of all failures is spread over
its stretches. A stretch is as long as the window or longer; a failure belongs to its own stretch and, if it lies within
a window of the next one, is context there. State holds each key's failures; a batch reads and
extends the keys that it touches and no others, so its cost follows what arrives.

Most keys have a failure or two, so what a key costs beyond its failures decides. A run that forgets nothing keeps its
failures as a streaming aggregate, one list per key, and counts the lists of many keys in one call. Only state that is
forgotten by time of arrival needs a processor, which asks for its keys one by one.

There is no watermark. A failure that comes late, however far other sources have got, is put in its
place in time, and the later failures within one window of it are reported again with their new
counts, under the same identity. A run that goes on bounds its state by time of arrival instead: a failure is forgotten
``keep`` seconds after it arrived, so failures that arrive within ``keep`` of each other are counted together. A run that
takes in what is there and stops (``keep`` of None) forgets nothing, as times of arrival mean little in it.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType, TimestampType

from duskwatch.operators.bruteforce import WINDOW_SECONDS

# the processor travels by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Seconds after its arrival for which a failure takes part in the counts of a run that goes on.
KEEP_SECONDS = 86400
#: Windows in a stretch of time.
STRETCH = 4
#: What identifies a counted failure, together with its source.
IDENTITY = ["stretch", "arrived", "number"]
#: Number of order columns, which follow time and ownership in a row of state.
_FIXED = ["_at", "_own"]
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FailureWindows(StatefulProcessor):
    """Counts within one (source, stretch). Rows of state are time, whether of this stretch, order, payload and identity."""

    def __init__(self, window: int, schema: StructType, order: int, keep: float | None, key: str):
        self.window, self.schema, self.order = window, schema, order
        self.ttl = int(keep * 1000) if keep else None
        self.names = [key, *schema.names, "before", "attempts"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        """Open the list of the key."""
        self.rows = handle.getListState("failures", self.schema, self.ttl)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Every failure of the stretch that is new or whose count has changed."""
        old = [tuple(r) for r in self.rows.get()]
        # numbers go on from the highest one known; the time of the batch keeps them apart from forgotten ones
        now = timerValues.getCurrentProcessingTimeInMs() if self.ttl else 0
        first = 1 + max((r[-1] for r in old), default=-1)
        new = [(*tuple(r)[2:], key[1], now, i) for i, r in enumerate(rows, first)]
        self.rows.appendList(new)
        before = attempts(old, self.window, self.order)
        held, counted = old + new, Row(*self.names)
        for place, count in enumerate(attempts(held, self.window, self.order)):
            last = before[place] if place < len(old) else None
            if held[place][1] and last != count:
                yield counted(key[0], *held[place], last, count)

    def close(self) -> None:
        """Nothing to release."""


def attempts(rows: list[tuple], window: int, order: int) -> list[int]:
    """Number of rows in the window that ends at each row. The window is open at its start, rows of one time count in order."""
    first, last = len(_FIXED), len(_FIXED) + order
    places = sorted(range(len(rows)), key=lambda i: (rows[i][0], [(x is not None, x) for x in rows[i][first:last]], rows[i][-2:]))
    times = [rows[i][0] for i in places]
    counts = [0] * len(rows)
    for n, place in enumerate(places):
        counts[place] = n + 1 - bisect_right(times, times[n] - window)
    return counts


def _list_counts(window: int):
    """Number in its batch, count before the last batch and count now of each failure of a key, for the lists of many keys.

    Lists are in order of arrival; ``places`` is their order in time, ``now`` the time of the last batch.
    """

    def run(at: pa.Array, arrived: pa.Array, places: pa.Array, now: pa.Array) -> pa.Array:
        edges = at.offsets.to_numpy()
        # lists of a slice need not begin at the first value
        times, came, order = (x.values.to_numpy()[x.offsets[0].as_py() : x.offsets[-1].as_py()] for x in (at, arrived, places))
        edges = edges - edges[0]
        sizes = np.diff(edges)
        new = came == np.repeat(now.to_numpy(), sizes)
        number, last, count = np.zeros(len(times), np.int64), np.ones(len(times), np.int64), np.ones(len(times), np.int64)

        def ending(of: np.ndarray) -> np.ndarray:
            return np.arange(1, len(of) + 1) - np.searchsorted(of, of - window, "right")

        for key in np.flatnonzero(sizes > 1).tolist():
            span = slice(edges[key], edges[key + 1])
            place = order[span]
            number[span] = np.arange(sizes[key]) - np.searchsorted(came[span], came[span])
            count[span][place] = ending(times[span][place])
            old = place[~new[span][place]]
            last[span][old] = ending(times[span][old])
        counted = pa.StructArray.from_arrays([pa.array(number), pa.array(last, mask=new), pa.array(count)], ["number", "before", "attempts"])
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), counted)

    return run


def _counted_lists(dealt: DataFrame, key: str, order: list[str], payload: list[str], window: int) -> DataFrame:
    """Failures of the keys that a batch touches whose count is new or has changed; state is one list per key."""
    # the time of a micro-batch stays the same when it runs again
    now = F.unix_micros(F.current_timestamp()).alias("_now")
    # equal failures can take each other's place, so numbers that follow from the content name the same failures in every batch
    tie = F.xxhash64(F.to_json(F.struct(F.lit(0).alias("_"), *payload))).alias("tie")
    row = F.struct(F.col("_now").alias("arrived"), F.struct("_at", *order, tie).alias("at"), F.struct("_own", *payload).alias("row"))
    listed = dealt.select("*", now).groupBy(key, "stretch").agg(F.collect_list(row).alias("_all"))

    def places(rows: str, *by: str) -> Column:
        """Positions of a list's rows in order; what a row carries need not have an order."""
        placed = F.transform(rows, lambda x, i: F.struct(*(x[c] for c in by), i.alias("i")))
        return F.transform(F.array_sort(placed), lambda x: x["i"])

    arrival = listed.withColumn("_places", places("_all", "arrived", "at"))
    rows = arrival.select(key, "stretch", F.transform("_places", lambda i: F.get("_all", i)).alias("_rows"), now)
    counts = F.arrow_udf(_list_counts(window), "array<struct<number: bigint, before: bigint, attempts: bigint>>")
    at, arrived = F.transform("_rows", lambda x: x["at"]["_at"]), F.transform("_rows", lambda x: x["arrived"])
    counted = rows.withColumn("_counts", counts(at, arrived, places("_rows", "at", "arrived"), "_now"))
    # outer, as an inner explode would be turned into a filter that counts once more
    single = counted.select(key, "stretch", F.inline_outer(F.arrays_zip("_rows", "_counts")))
    changed = single.where(F.col("_rows.row._own") & ~F.col("_counts.before").eqNullSafe(F.col("_counts.attempts")))
    return changed.select(
        key, "stretch", "_rows.arrived", "_rows.at._at", *(f"_rows.at.{c}" for c in order), *(f"_rows.row.{c}" for c in payload),
        "_counts.number", "_counts.before", "_counts.attempts",
    )


def live_counts(
    failures: DataFrame,
    order: list[str] | tuple[str, ...] = (),
    window_seconds: float = WINDOW_SECONDS,
    key: str = "source_ip",
    time: str = "event_ts",
    keep: float | None = None,
) -> DataFrame:
    """Stream of ``failures`` with ``attempts`` and the columns of IDENTITY.

    A failure whose count changes comes again, with the count it had in ``before``. ``order`` puts failures of one source and time in order. The last row of an identity holds its count.
    """
    spark = failures.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    window = int(window_seconds * 1_000_000)
    length = window * STRETCH
    at = F.unix_micros(F.col(time).cast("timestamp"))
    payload = [c for c in failures.columns if c not in {key, *order}]
    stamps = {f.name for f in failures.schema.fields if isinstance(f.dataType, TimestampType)}
    plain = failures.select(
        key, at.alias("_at"), *(F.unix_micros(c).alias(c) if c in stamps else F.col(c) for c in [*order, *payload])
    )
    number = ((F.col("_at") - F.pmod(F.col("_at"), F.lit(length))) / length).cast("long")
    own = F.struct(number.alias("stretch"), F.lit(True).alias("_own"))
    following = F.struct((number + 1).alias("stretch"), F.lit(False).alias("_own"))
    near = F.col("_at") > (number + 1) * length - window
    dealt = plain.select("*", F.inline(F.when(near, F.array(own, following)).otherwise(F.array(own))))
    # a failure is context for the stretch after its own with its time only
    dealt = dealt.select(
        key, "stretch", "_at", "_own", *order, *(F.when(F.col("_own"), F.col(c)).alias(c) for c in payload)
    )
    back = [F.timestamp_micros(c).alias(c) if c in stamps else F.col(c) for c in failures.columns]
    if not keep:
        return _counted_lists(dealt, key, order, payload, window).select(*back, *IDENTITY, "before", "attempts")
    identity = [StructField(c, LongType()) for c in IDENTITY]
    schema = StructType([StructField(f.name, f.dataType) for f in dealt.schema.fields[2:]] + identity)
    out = StructType([StructField(key, failures.schema[key].dataType), *schema.fields, StructField("before", LongType()), StructField("attempts", LongType())])
    counted = dealt.groupBy(key, "stretch").transformWithState(
        FailureWindows(window, schema, len(order), keep, key), out, "Update", "ProcessingTime"
    )
    return counted.select(*back, *IDENTITY, "before", "attempts")
