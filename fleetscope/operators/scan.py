"""Ordered scan: each row's neighbours and index in its key's time order, after one shuffle.

Rows are range-partitioned by (key, time), so a key with a third of all rows spans as many
partitions as its rows need; nothing is grouped by key. Sorted partitions are scanned in
Arrow batches, which gives every neighbour that lies in the same partition and each row's
position in its run of equal keys. What a partition cannot know is small: the last rows
before its first row, the first rows after its last one, and how many rows of its first key
came earlier. A boundary table with one row per partition holds those rows and counts; it is
stitched in order of the partitions and broadcast (at most as many rows as there are shuffle
partitions). Both uses of the sorted rows read the same shuffle.

The number of partitions is given explicitly, as AQE must not merge partitions differently
for the two uses. Rows with equal (key, time) are ordered by a hash of all their columns, so
that both uses, and repeated tasks, see one order; only identical rows can change places.

Edge cases: null keys are a key of their own, null times come first, null values are
neighbours like any other; an empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: First row of a partition, which names the partition: its key, time and hash.
MARK = ("_k0", "_t0", "_h0")


def _whole(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _codes(keys: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Integers that differ between different neighbouring keys (null: -1)."""
    return _whole(keys).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _shift(column: pa.ChunkedArray, source: np.ndarray, ok: np.ndarray) -> pa.Array:
    """``column`` at ``source``, null where not ``ok``."""
    return _whole(column.take(pa.array(np.where(ok, source, 0), mask=~ok)))


def _scanner(key: str, time_col: str, cols: list[str], back: int, ahead: int):
    """Sorted batches of one partition -> the rows with in-partition neighbours.

    Added columns: ``_i`` (position in the run of its key within the partition), the
    neighbours, ``_first`` (the run is the partition's first), ``_left`` (rows of the run
    that follow, where the partition's end may hide neighbours) and the partition's mark on
    the rows that need the boundary table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = max(back, 1)
        held = None      # rows before the next one to return (at most ``keep``) and those not returned yet
        context = 0      # how many of ``held`` were returned already
        run0 = 0         # rows of the first run of ``held`` that came before it
        opening = True   # the first run of ``held`` is the partition's first
        mark = None

        def emit(t: pa.Table, upto: int, last: bool) -> pa.RecordBatch:
            nonlocal run0, opening
            n = t.num_rows
            code = _codes(t.column(key))
            starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            which = np.cumsum(np.concatenate([[0], (code[1:] != code[:-1]).astype(np.int64)]))
            at = np.arange(n)
            i = at - starts[which] + np.where(which == 0, run0, 0)
            first = (which == 0) & opening
            rows = at[context:upto]
            names = [c for c in t.column_names if c != "_h"]
            columns = [_whole(t.column(c).slice(context, upto - context)) for c in names]

            def add(name, values):
                names.append(name)
                columns.append(values)

            add("_i", pa.array(i[rows], pa.int64()))
            for c in cols:
                for k in range(1, back + 1):
                    source = rows - k
                    add(f"{c}_m{k}", _shift(t.column(c), source, (source >= 0) & (code[np.maximum(source, 0)] == code[rows])))
                for k in range(1, ahead + 1):
                    source = rows + k
                    add(f"{c}_p{k}", _shift(t.column(c), source, (source < n) & (code[np.minimum(source, n - 1)] == code[rows])))
            left = n - 1 - rows
            open_end = (left < ahead) & (which[rows] == which[-1]) if last else np.zeros(len(rows), bool)
            add("_first", pa.array(first[rows]))
            add("_left", pa.array(left, pa.int64(), mask=~open_end))
            for name, value in zip(MARK, mark):
                add(name, value.take(pa.array(np.zeros(len(rows), np.int64), mask=~(first[rows] | open_end))))
            # what stays: the last ``keep`` rows that were returned, and those that were not
            stay = max(0, upto - keep)
            run0, opening = int(i[stay]), bool(first[stay])
            return pa.RecordBatch.from_arrays(columns, names)

        for b in batches:
            if not b.num_rows:
                continue
            if mark is None:
                mark = [b.column(c).slice(0, 1) for c in (key, time_col, "_h")]
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            upto = t.num_rows - ahead
            if upto > context:
                yield emit(t, upto, False)
                stay = max(0, upto - keep)
                held, context = t.slice(stay), upto - stay
            else:
                held = t
        if held is not None and held.num_rows > context:
            yield emit(held, held.num_rows, True)
    return run


def _boundaries(key: str, time_col: str, cols: list[str], back: int, ahead: int):
    """Sorted batches of one partition -> its row of the boundary table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, head, tail, n_first, n_last, alone = None, [], [], 0, 0, True
        first_key = last_key = None
        kinds = None
        for b in batches:
            if not b.num_rows:
                continue
            code = _codes(b.column(b.schema.get_field_index(key)))
            keys = b.column(b.schema.get_field_index(key))
            values = b.select(cols)
            if mark is None:
                kinds = b.schema
                mark = [b.column(b.schema.get_field_index(c)).slice(0, 1) for c in (key, time_col, "_h")]
                first_key = last_key = keys[0].as_py()
            cuts = np.flatnonzero(code[1:] != code[:-1]) + 1
            same_as_before = keys[0].as_py() == last_key
            # the first run: goes on in this batch while nothing else was seen
            if alone and same_as_before:
                size = int(cuts[0]) if len(cuts) else b.num_rows
                head += values.slice(0, max(0, min(size, ahead - len(head)))).to_pylist()
                n_first += size
            # the last run
            begin = int(cuts[-1]) if len(cuts) else 0
            goes_on = same_as_before and not len(cuts)
            n_last = n_last + b.num_rows if goes_on else b.num_rows - begin
            rows = values.slice(max(begin, b.num_rows - back)).to_pylist() if back else []
            tail = ((tail if goes_on else []) + rows)[-back:] if back else []
            alone = alone and same_as_before and not len(cuts)
            last_key = keys[b.num_rows - 1].as_py()
        if mark is None:
            return
        item = pa.struct([kinds.field(c) for c in cols]) if cols else pa.struct([pa.field("_", pa.int8())])
        key_type = kinds.field(key).type
        yield pa.RecordBatch.from_arrays(
            [*mark, pa.array([last_key], key_type), pa.array([n_first], pa.int64()), pa.array([n_last], pa.int64()), pa.array([alone]),
             pa.array([head], pa.list_(item)), pa.array([tail], pa.list_(item))], [*MARK, "_last_key", "_n_first", "_n_last", "_alone", "_head", "_tail"])
    return run


def _stitch(back: int, ahead: int):
    """All boundary rows in order -> each partition's rows before and after it, and its offset."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = list(batches)
        if not any(b.num_rows for b in table):
            return
        t = pa.Table.from_batches(table).combine_chunks()
        first, last, n_first, n_last, alone, head, tail = (t.column(c).to_pylist() for c in (MARK[0], "_last_key", "_n_first", "_n_last", "_alone", "_head", "_tail"))
        n = t.num_rows
        offset, before, after = [0] * n, [[]] * n, [[]] * n
        open_key, count, rows = object(), 0, []
        for p in range(n):
            if first[p] == open_key:
                offset[p], before[p] = count, rows
            if alone[p]:
                open_key, count, rows = first[p], offset[p] + n_first[p], (before[p] + tail[p])[-back:] if back else []
            else:
                open_key, count, rows = last[p], n_last[p], tail[p]
        open_key, rows = object(), []
        for p in reversed(range(n)):
            if last[p] == open_key:
                after[p] = rows
            open_key, rows = first[p], (head[p] + after[p])[:ahead] if alone[p] else head[p]
        kind = t.schema.field("_head").type
        # nearest row first on either side
        yield pa.RecordBatch.from_arrays(
            [*[t.column(c).combine_chunks() for c in MARK], pa.array(offset, pa.int64()), pa.array([r[::-1] for r in before], kind), pa.array(after, kind)],
            [*MARK, "_offset", "_before", "_after"])
    return run


def _ddl(fields: list[T.StructField]) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in fields])


def with_neighbours(df: DataFrame, cols, back: int = 0, ahead: int = 0, key: str = "gpu_uuid", time_col: str = "time") -> DataFrame:
    """Each row with its 0-based ``row_index`` and the values of ``cols`` in the ``back``
    previous (``_m1``, ``_m2``, ...) and ``ahead`` following (``_p1``, ...) rows of its key."""
    cols = list(cols)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(key).asc_nulls_first(), F.col(time_col).asc_nulls_first(), F.col("_h").asc()]
    ordered = df.withColumn("_h", F.xxhash64(*df.columns)).repartitionByRange(n, *order).sortWithinPartitions(*order)

    mark = [T.StructField(a, kinds[b]) for a, b in zip(MARK[:2], (key, time_col))] + [T.StructField(MARK[2], T.LongType())]
    item = T.ArrayType(T.StructType([T.StructField(c, kinds[c]) for c in cols] or [T.StructField("_", T.ByteType())]))
    shifts = [(f"{c}_m{k}", c, -k) for c in cols for k in range(1, back + 1)] + [(f"{c}_p{k}", c, k) for c in cols for k in range(1, ahead + 1)]
    # the order of the added columns follows the scanner: per column the previous rows, then the following
    made = [T.StructField(name, kinds[c]) for c in cols for name, of, _ in shifts if of == c]
    scanned = ordered.mapInArrow(_scanner(key, time_col, cols, back, ahead), _ddl(
        [*df.schema.fields, T.StructField("_i", T.LongType()), *made, T.StructField("_first", T.BooleanType()), T.StructField("_left", T.LongType()), *mark]))
    edge = ordered.mapInArrow(_boundaries(key, time_col, cols, back, ahead), _ddl(
        [*mark, T.StructField("_last_key", kinds[key]), T.StructField("_n_first", T.LongType()), T.StructField("_n_last", T.LongType()),
         T.StructField("_alone", T.BooleanType()), T.StructField("_head", item), T.StructField("_tail", item)]))
    # one row per partition: small enough for one task, and for a broadcast
    in_order = edge.repartition(1).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in MARK])
    stitched = in_order.mapInArrow(_stitch(back, ahead), _ddl(
        [*mark, T.StructField("_offset", T.LongType()), T.StructField("_before", item), T.StructField("_after", item)]))
    s = stitched.select(*[F.col(c).alias(f"s{c}") for c in MARK], "_offset", "_before", "_after")
    # the hash is null only where no boundary is needed, key and time may be null themselves
    on = (F.col(MARK[2]) == F.col(f"s{MARK[2]}")) & F.col(MARK[0]).eqNullSafe(F.col(f"s{MARK[0]}")) & F.col(MARK[1]).eqNullSafe(F.col(f"s{MARK[1]}"))
    met = scanned.join(F.broadcast(s), on, "left")

    def neighbour(name: str, c: str, k: int):
        if k < 0:
            outside = F.when(F.col("_first"), F.get("_before", F.lit(-k - 1) - F.col("_i").cast("int"))[c])
            return F.when(F.col("_i") >= -k, F.col(name)).otherwise(outside).alias(name)
        outside = F.get("_after", F.lit(k - 1) - F.col("_left").cast("int"))[c]
        return F.when(F.col("_left") < k, outside).otherwise(F.col(name)).alias(name)

    index = F.col("_i") + F.when(F.col("_first"), F.coalesce("_offset", F.lit(0))).otherwise(F.lit(0))
    return met.select(*df.columns, index.alias("row_index"), *[neighbour(*x) for x in shifts])
