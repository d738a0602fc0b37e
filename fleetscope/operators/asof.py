"""As-of join without fan-out: the last and the next event of a row's key, after one shuffle.

Rows and events are put into one ordered set, range-partitioned by (key, time), so a key
with a third of all rows, or with very many events, spans as many partitions as it needs.
Each sorted partition is scanned forwards, which hands every row the last event before it,
and backwards for the next one. What lies beyond a partition's ends comes from a boundary
table with one row per partition (its first and last event of the keys that cross its ends),
stitched in order and broadcast: at most as many rows as there are shuffle partitions.
No row is ever joined with more than one event on either side, and nothing is grouped.

Edge cases: rows without any event get NULLs; of events with equal (key, time) the one with
the greatest hash of its columns is the last and the one with the least is the next; a null
key is a key of its own; rows and events with a null time come before all others; empty
sides are fine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetscope.operators.scan import _codes

#: Sort key of the ordered set: key, time, side (events before or after rows of the same time), hash.
ORDER = ("_k", "_t", "_side", "_h")


def _filled(batches: Iterator[pa.RecordBatch], name: str, mark_name: str, event_side: int, drop_events: bool) -> Iterator[pa.RecordBatch]:
    """Rows with the event seen last (``name``) and, where none was seen in the partition's first run, the partition's mark."""
    held, held_key, opening, mark = None, None, True, None
    for b in batches:
        if not b.num_rows:
            continue
        keys, events = b.column("_k"), b.column("_event")
        if mark is None:
            mark = pa.StructArray.from_arrays([b.column(c).slice(0, 1) for c in ORDER], list(ORDER))
            held, held_key = events.slice(0, 1).take(pa.array([None], pa.int64())), keys[0].as_py()
        code = _codes(keys)
        at = np.arange(b.num_rows)
        new = np.concatenate([[keys[0].as_py() != held_key], code[1:] != code[:-1]])
        start = np.maximum.accumulate(np.where(new, at, -1))  # -1: the run goes on from the batch before
        seen = np.maximum.accumulate(np.where(b.column("_side").to_numpy() == event_side, at, -1))
        inside = (seen >= 0) & (seen >= start)
        carried = ~inside & (start < 0)
        source = pa.array(np.where(inside, seen + 1, 0), mask=~(inside | carried))
        filled = pa.concat_arrays([held, events]).take(source)
        first = (start < 0) if opening else np.zeros(len(at), bool)
        lacks = first & np.asarray(filled.is_null())
        out = [*b.columns, filled, mark.take(pa.array(np.zeros(len(at), np.int64), mask=~lacks))]
        result = pa.RecordBatch.from_arrays(out, [*b.schema.names, name, mark_name])
        held, held_key, opening = filled.slice(b.num_rows - 1, 1), keys[b.num_rows - 1].as_py(), opening and bool(start[-1] < 0)
        yield result.filter(pa.array(b.column("_side").to_numpy() != event_side)) if drop_events else result


def _boundary_row(event_side: int):
    """Sorted batches of one partition -> its ends: marks, keys, first event of the first run, last event of the last run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = first_event = last_event = None
        first_key = last_key = None
        alone = True
        for b in batches:
            if not b.num_rows:
                continue
            keys, events = b.column("_k"), b.column("_event")
            none = events.slice(0, 1).take(pa.array([None], pa.int64()))
            mark = lambda i: pa.StructArray.from_arrays([b.column(c).slice(i, 1) for c in ORDER], list(ORDER))  # noqa: E731,B023
            if low is None:
                low, first_event, last_event = mark(0), none, none
                first_key = last_key = keys[0].as_py()
            code = _codes(keys)
            is_event = b.column("_side").to_numpy() == event_side
            cuts = np.flatnonzero(code[1:] != code[:-1]) + 1
            goes_on = keys[0].as_py() == last_key
            if alone and goes_on and first_event.null_count:
                hits = np.flatnonzero(is_event[:int(cuts[0]) if len(cuts) else None])
                first_event = events.slice(int(hits[0]), 1) if len(hits) else first_event
            begin = int(cuts[-1]) if len(cuts) else 0
            if len(cuts) or not goes_on:
                last_event = none
            hits = np.flatnonzero(is_event[begin:])
            last_event = events.slice(begin + int(hits[-1]), 1) if len(hits) else last_event
            alone = alone and goes_on and not len(cuts)
            last_key, high = keys[b.num_rows - 1].as_py(), mark(b.num_rows - 1)
            key_type = keys.type
        if low is not None:
            yield pa.RecordBatch.from_arrays([low, high, pa.array([first_key], key_type), pa.array([last_key], key_type), pa.array([alone]), first_event, last_event],
                                             ["_low", "_high", "_first_key", "_last_key", "_alone", "_first_event", "_last_event"])
    return run


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All boundary rows in order -> the event before and after each partition, for the keys that cross its ends."""
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    t = pa.Table.from_batches(table).combine_chunks()
    first_key, last_key, alone = (t.column(c).to_pylist() for c in ("_first_key", "_last_key", "_alone"))
    firsts, lasts = (t.column(c).combine_chunks() for c in ("_first_event", "_last_event"))
    n = t.num_rows
    before, after = [None] * n, [None] * n  # positions in ``lasts`` and ``firsts``
    key, at = object(), None
    for p in range(n):
        before[p] = at if first_key[p] == key else None
        own = p if lasts[p].is_valid else None
        key, at = (first_key[p], before[p] if own is None else own) if alone[p] else (last_key[p], own)
    key, at = object(), None
    for p in reversed(range(n)):
        after[p] = at if last_key[p] == key else None
        own = p if firsts[p].is_valid else None
        key, at = first_key[p], after[p] if alone[p] and own is None else own
    yield pa.RecordBatch.from_arrays([*[t.column(c).combine_chunks() for c in ("_low", "_high")], lasts.take(pa.array(before, pa.int64())), firsts.take(pa.array(after, pa.int64()))],
                                     ["_low", "_high", "_before", "_after"])


def asof_join(rows: DataFrame, events: DataFrame, time: Column | str = "time", event_time: Column | str = "time", key: str = "gpu_uuid",
              same_time_is_last: bool = True) -> DataFrame:
    """``rows`` with ``last_event`` and ``next_event``: structs of the columns of ``events``.

    An event at a row's own time is its last event if ``same_time_is_last``, else its next one.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    event_side, row_side = (0, 1) if same_time_is_last else (1, 0)
    row_type, event_type = T.StructType(rows.schema.fields), T.StructType(events.schema.fields)
    one = rows.select(F.col(key).alias("_k"), col(time).alias("_t"), F.lit(row_side).alias("_side"), F.xxhash64(*rows.columns).alias("_h"),
                      F.struct(*rows.columns).alias("_row"), F.lit(None).cast(event_type).alias("_event"))
    other = events.select(F.col(key).alias("_k"), col(event_time).alias("_t"), F.lit(event_side).alias("_side"), F.xxhash64(*events.columns).alias("_h"),
                          F.lit(None).cast(row_type).alias("_row"), F.struct(*events.columns).alias("_event"))
    both = one.union(other)
    ordered = both.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in ORDER]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in ORDER])

    nullable = lambda s: T.StructType([T.StructField(f.name, f.dataType, True) for f in s])
    base = nullable(both.schema)
    mark, event = T.StructType([f for f in base.fields if f.name in ORDER]), base["_event"].dataType
    fields = lambda *pairs: T.StructType([T.StructField(name, kind) for name, kind in pairs])
    forward = T.StructType([*base.fields, T.StructField("_last", event), T.StructField("_low", mark)])
    scanned = ordered.mapInArrow(lambda it: _filled(it, "_last", "_low", event_side, False), forward)
    back = scanned.sortWithinPartitions(*[F.col(c).desc_nulls_last() for c in ORDER])
    scanned = back.mapInArrow(lambda it: _filled(it, "_next", "_high", event_side, True), T.StructType([*forward.fields, T.StructField("_next", event), T.StructField("_high", mark)]))

    edge = ordered.mapInArrow(_boundary_row(event_side), fields(("_low", mark), ("_high", mark), ("_first_key", base["_k"].dataType), ("_last_key", base["_k"].dataType),
                                                                ("_alone", T.BooleanType()), ("_first_event", event), ("_last_event", event)))
    # one row per partition: small enough for one task, and for a broadcast
    in_order = edge.repartition(1).sortWithinPartitions(*[F.col(f"_low.{c}").asc_nulls_first() for c in ORDER])
    ends = in_order.mapInArrow(_stitched, fields(("_low", mark), ("_high", mark), ("_before", event), ("_after", event)))

    def met(d: DataFrame, side: str, found: str, out: str) -> DataFrame:
        e = ends.select(F.col(side).alias("_mark"), F.col(found).alias(out))
        on = (F.col(f"{side}._h") == F.col("_mark._h")) & (F.col(f"{side}._side") == F.col("_mark._side")) & F.col(f"{side}._k").eqNullSafe(F.col("_mark._k")) & \
            F.col(f"{side}._t").eqNullSafe(F.col("_mark._t"))
        return d.join(F.broadcast(e), on, "left").drop("_mark")

    scanned = met(met(scanned, "_low", "_before", "_from_before"), "_high", "_after", "_from_after")
    return scanned.select("_row.*", F.coalesce("_last", "_from_before").alias("last_event"), F.coalesce("_next", "_from_after").alias("next_event"))


def version_at(rows: DataFrame, versions: DataFrame, columns: list[str], time: str = "time", key: str = "gpu_uuid", valid_from: str = "valid_from",
               valid_to: str = "valid_to") -> DataFrame:
    """``rows`` with ``columns`` of the version of their key that is valid at their time (JON12).

    ``versions`` has one row per key and ``valid_from``; a version holds until the next one
    begins or its own ``valid_to`` (exclusive, NULL: open). Rows without a valid version get NULLs.
    """
    v = versions.select(key, F.col(valid_from).alias(time), F.col(valid_to).alias("_valid_to"), *columns)
    met = asof_join(rows, v, time=time, event_time=time, key=key)
    e = F.col("last_event")
    holds = e["_valid_to"].isNull() | (F.col(time) < e["_valid_to"])
    return met.select(*rows.columns, *[F.when(holds, e[c]).alias(c) for c in columns])
