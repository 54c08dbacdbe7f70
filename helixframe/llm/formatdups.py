"""Records that are alike but for white space, case, punctuation and the order of fields.

Records are put in canonical form (letters a-z in any case and digits, the fields
in sorted order), range-partitioned on (key, id) and sorted with Spark's spilling
sort, so one key of many copies is split over partitions.  Each partition is then
scanned once: adjacent rows are compared by their full keys.  A run that goes on
from one partition into the next is settled by one summary row a partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.session import materialize, partitions_for

#: Bytes of canonical records for one partition of the sort.
PARTITION_BYTES = 32 << 20


def canonical(column: str) -> Column:
    """Only letters a-z, in lower case, and digits.

    Characters are dropped before the case is folded, so no other letter turns into one of these.
    """
    return F.lower(F.regexp_replace(F.col(f"`{column}`").cast("string"), "[^A-Za-z0-9]", ""))


def _edges(batch: pa.RecordBatch, width: int) -> np.ndarray:
    n = batch.num_rows
    new = np.zeros(n, bool)
    for c in batch.columns[:width]:
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return new


def _ordered(df: DataFrame, fields: list[str], row_id: str, partitions: int | None) -> DataFrame:
    """k0, k1, ..., id: canonical records, range-partitioned and sorted by (key, id)."""
    kind = df.schema[row_id].dataType
    if not isinstance(kind, (T.IntegralType, T.StringType)):
        raise TypeError(f"{row_id}: ids are whole numbers or strings, not {kind.simpleString()}")
    source = df.where(F.col(f"`{row_id}`").isNotNull())
    for c in fields:
        source = source.where(F.col(f"`{c}`").isNotNull())
    ids = F.col(f"`{row_id}`")
    source = source.select(F.array_sort(F.array(*[canonical(c) for c in fields])).alias("k"), (ids if isinstance(kind, T.StringType) else ids.cast("bigint")).alias("id"))
    keys = [f"k{i}" for i in range(len(fields))]
    source = source.select(*[F.col("k")[i].alias(k) for i, k in enumerate(keys)], "id")
    count = partitions or partitions_for(df.select(*[F.col(f"`{c}`") for c in fields]), PARTITION_BYTES)
    return source.repartitionByRange(count, *keys, "id").sortWithinPartitions(*keys, "id")


def _scan(ordered: DataFrame, width: int, runs: bool) -> DataFrame:
    """One pass over the sorted records, whose adjacent rows are compared by their full keys.

    A row a record: ``part``, ``first`` (id of its run's first record), ``id``; or, with ``runs``, a row a run: ``part``,
    ``first`` and its length ``n``.  ``leads`` marks what lies in the first run of a partition, which may go on from
    the one before.  A last row a partition has its first and last key (``a0``..., ``z0``...), the first record of its
    last run, and whether it is ``one`` run; there ``leads`` is null.
    """
    kind = ordered.schema["id"].dataType
    what = T.StructField("n", T.LongType()) if runs else T.StructField("id", kind)
    schema = T.StructType(
        [T.StructField("part", T.IntegerType()), T.StructField("first", kind), what, T.StructField("leads", T.BooleanType()),
         *[T.StructField(f"a{i}", T.StringType()) for i in range(width)], *[T.StructField(f"z{i}", T.StringType()) for i in range(width)], T.StructField("one", T.BooleanType())]
    )
    arrow_id = pa.string() if isinstance(kind, T.StringType) else pa.int64()
    arrow_what = pa.int64() if runs else arrow_id

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def rows(first: pa.Array, second: pa.Array, leads: pa.Array) -> pa.RecordBatch:
            n = len(first)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), first, second, leads, *[pa.nulls(n, pa.string())] * (2 * width), pa.nulls(n, pa.bool_())], names=schema.names)

        start = last = head = None  # first key, last key, first id of the open run
        one, length = True, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids = batch.column(width)
            new = _edges(batch, width)
            first_key = [c[0].as_py() for c in batch.columns[:width]]
            opened = last is not None and first_key != last
            if last is None:
                start, head = first_key, ids[0].as_py()
            elif opened:
                new[0] = True
            at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            begins = np.nonzero(new)[0]
            if runs:
                # the open run ends where the first new one begins; the last one stays open
                ends = np.append(begins, n)
                closed = [(head, length + int(ends[0]), one)] if len(begins) else []
                if len(begins):
                    own = ids.take(pa.array(begins)).to_pylist()
                    closed += [(i, int(k), False) for i, k in zip(own[:-1], np.diff(begins))]
                    head, length = own[-1], n - int(begins[-1])
                    yield rows(pa.array([c[0] for c in closed], arrow_id), pa.array([c[1] for c in closed], pa.int64()), pa.array([c[2] for c in closed]))
                else:
                    length += n
            else:
                taken = ids.take(pa.array(np.maximum(at, 0)))
                firsts = pc.if_else(pa.array(at < 0), pa.scalar(head, arrow_id), taken)
                yield rows(firsts, ids, pa.array((at < 0) & one))
                head = firsts[n - 1].as_py()
            one = one and not len(begins)
            last = [c[n - 1].as_py() for c in batch.columns[:width]]
        if last is not None:
            if runs:
                yield rows(pa.array([head], arrow_id), pa.array([length], pa.int64()), pa.array([one]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([head], arrow_id), pa.nulls(1, arrow_what), pa.nulls(1, pa.bool_()), *[pa.array([v], pa.string()) for v in [*start, *last]], pa.array([one])],
                names=schema.names,
            )

    return materialize(ordered.mapInArrow(scan, schema), "records")


def _heads(scanned: DataFrame, width: int) -> DataFrame:
    """``p`` and ``head`` of each partition whose first run goes on from the one before: where that run begins."""
    w = Window.orderBy("part")  # one row a partition
    summary = scanned.where("leads is null")
    goes_on = F.lit(True)
    for i in range(width):
        goes_on = goes_on & (F.col(f"a{i}") == F.lag(f"z{i}").over(w))
    summary = summary.withColumn("goes_on", F.coalesce(goes_on, F.lit(False)))
    # the last run of a partition begins there, unless the partition is one run that goes on from before
    begins = F.when(~(F.col("one") & F.col("goes_on")), F.col("first"))
    summary = summary.withColumn("tail", F.last(begins, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return summary.withColumn("head", F.lag("tail").over(w)).where("goes_on").select(F.col("part").alias("p"), "head")


def _settled(scanned: DataFrame, width: int) -> DataFrame:
    rows, heads = scanned.where("leads is not null"), _heads(scanned, width)
    joined = rows.join(F.broadcast(heads), (rows.part == heads.p) & rows.leads, "left")  # at most a row of two values a partition
    return joined.withColumn("first", F.coalesce("head", "first"))


def same_records(df: DataFrame, fields: list[str], row_id: str, partitions: int | None = None) -> DataFrame:
    """``first_id``, ``row_id`` of every record; ``first_id`` is the least id of its copies.

    Defined cases: records with a null among ``fields`` or a null id are left out;
    fields without any letter or digit are empty and may be alike; ties do not
    arise but for a repeated id, which is a copy; ids are whole numbers or strings,
    which compare by code point; an empty table gives none; further columns are
    ignored; fields may be of any length.  The rows are written once into the shared
    folder when this is called.
    """
    kind = df.schema[row_id].dataType
    settled = _settled(_scan(_ordered(df, fields, row_id, partitions), len(fields), runs=False), len(fields))
    return settled.select(F.col("first").cast(kind).alias("first_id"), F.col("id").cast(kind).alias(row_id))


def collapse(df: DataFrame, fields: list[str], row_id: str, partitions: int | None = None) -> DataFrame:
    """One row for each group of copies: ``first_id`` and ``copies``. Defined cases are those of ``same_records``.

    The scan gives the length of every run; only those that cross the border of a
    partition, at most two a partition, are added up.
    """
    kind = df.schema[row_id].dataType
    width = len(fields)
    scanned = _scan(_ordered(df, fields, row_id, partitions), width, runs=True)
    runs = _settled(scanned, width)
    going_on = F.broadcast(_heads(scanned, width).select("head").distinct())  # at most a value a partition
    over = runs.join(going_on, runs["first"] == going_on["head"], "left_semi").groupBy("first").agg(F.sum("n").alias("n"))
    within = runs.join(going_on, runs["first"] == going_on["head"], "left_anti").select("first", "n")
    return within.unionByName(over).select(F.col("first").cast(kind).alias("first_id"), F.col("n").alias("copies"))
