"""The N best rows of every group by merging sorted runs with a loser tree.

1.  Every input partition is sorted by (bucket, group, order) where it lies, by
    Spark's own spilling sort: one sorted run a partition and bucket.  Rows past
    the N-th of a group within a run cannot be among the N best, so a hot group
    leaves at most N rows a run before anything is shuffled.  Splits of a very large
    input are taken together, so that a run has enough rows for each bucket.
2.  Runs are packed into blocks of sorted rows, bare batches without their schema,
    and stored by bucket: the exchange moves a few binary rows instead of many small
    ones.  A partition of the exchange holds many buckets, in order.
3.  Runs of a bucket are merged with a loser tree, which writes N rows of a group
    and then has every run seek to the next group.  Whenever as many runs as a
    merge may take have come in, they are merged into one run, again of N rows a
    group at most; so neither the number of runs nor a group that all of them hold
    fills a task.

A bucket holds whole groups, and takes the same bytes of input whatever its size.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixframe.session import input_bytes, partitions_for

#: Bytes of input for one bucket, for one partition of the exchange and for one run; rows of a packed block.
BUCKET_BYTES, PARTITION_BYTES, RUN_BYTES, BLOCK_ROWS = 32 << 20, 256 << 20, 2 << 30, 4096
#: Runs of one merge.
FAN_IN = 256


class LoserTree:
    """Picks the least head of many cursors; a replay costs one comparison a level.

    A cursor has ``head``, its current key or None at its end.  Inner node i keeps
    the loser of the match there; node 0 keeps the winner.
    """

    def __init__(self, cursors: list[RunCursor]) -> None:
        self.cursors = cursors
        self.size = size = max(1, len(cursors))
        self.losers = [-1] * size
        winners = [-1] * size + list(range(size))
        for node in range(size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            if self._before(b, a):
                a, b = b, a
            winners[node], self.losers[node] = a, b
        self.winner = winners[1] if size > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.cursors[a].head, self.cursors[b].head
        if x is None:
            return False
        return y is None or x < y

    def replay(self) -> None:
        """After the winner's cursor has moved: play its matches anew up to the root."""
        cursors, losers = self.cursors, self.losers
        w = self.winner
        head = cursors[w].head
        node = (w + self.size) >> 1
        while node:
            other = losers[node]
            y = cursors[other].head
            if y is not None and (head is None or y < head):
                losers[node] = w
                w, head = other, y
            node >>= 1
        self.winner = w


def pack_rows(batch: pa.RecordBatch) -> bytes:
    """A block: a batch without its schema."""
    return batch.serialize().to_pybytes()


class RunCursor:
    """A sorted run: its packed blocks in order, of which one is unpacked at a time."""

    def __init__(self, blocks: list[bytes], group_width: int, schema: pa.Schema) -> None:
        self.blocks = blocks
        self.width = group_width
        self.schema = schema
        self.block = -1
        self.keys: list[tuple] = []
        self.at = 0
        self.head: tuple | None = None
        self._next_block()

    def _next_block(self) -> None:
        self.block += 1
        if self.block >= len(self.blocks):
            self.keys, self.head = [], None
            return
        batch = pa.ipc.read_record_batch(pa.py_buffer(self.blocks[self.block]), self.schema)
        self.blocks[self.block] = b""
        self.keys = list(zip(*[c.to_pylist() for c in batch.columns]))
        self.at, self.head = 0, self.keys[0]

    def advance(self) -> None:
        self.at += 1
        if self.at < len(self.keys):
            self.head = self.keys[self.at]
        else:
            self._next_block()

    def seek_past(self, group: tuple) -> None:
        """To the first row of a later group."""
        w = self.width
        while self.head is not None:
            if self.keys[-1][:w] > group:
                self.at = bisect_right(self.keys, group, lo=self.at, key=lambda k: k[:w])
                self.head = self.keys[self.at]
                return
            self._next_block()


def merge_runs(runs: list[RunCursor], width: int, n: int) -> Iterator[tuple[int, tuple]]:
    """(rank, key) of the ``n`` least rows of every group, groups in order."""
    runs = [r for r in runs if r.head is not None]
    if not runs:
        return
    tree = LoserTree(runs)
    group, rank = None, 0
    while True:
        run = runs[tree.winner]
        key = run.head
        if key is None:
            return
        own = key[:width]
        if own != group:
            group, rank = own, 0
        if rank < n:
            rank += 1
            yield rank, key
            run.advance()
        else:
            run.seek_past(group)
        tree.replay()


class BucketMerge:
    """Takes the runs of one bucket, one after the other, and gives the ``n`` least rows of every group.

    Runs wait by level; ``fan_in`` runs of a level become one of the next.
    """

    def __init__(self, width: int, n: int, schema: pa.Schema, fan_in: int = FAN_IN) -> None:
        self.width, self.n, self.schema, self.fan_in = width, n, schema, fan_in
        self.levels: list[list[list[bytes]]] = []

    def add(self, blocks: list[bytes], level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        waiting = self.levels[level]
        waiting.append(blocks)
        if len(waiting) == self.fan_in:
            self.levels[level] = []
            self.add(self._one_run(waiting), level + 1)

    def _merged(self, runs: list[list[bytes]]) -> Iterator[tuple[int, tuple]]:
        return merge_runs([RunCursor(blocks, self.width, self.schema) for blocks in runs], self.width, self.n)

    def _one_run(self, runs: list[list[bytes]]) -> list[bytes]:
        out, rows = [], []
        for _, key in self._merged(runs):
            rows.append(key)
            if len(rows) == BLOCK_ROWS:
                out.append(self._block(rows))
                rows = []
        if rows:
            out.append(self._block(rows))
        return out

    def _block(self, rows: list[tuple]) -> bytes:
        return pack_rows(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), self.schema)], schema=self.schema))

    def finish(self) -> Iterator[tuple[int, tuple]]:
        """(rank, key) of the rows; later levels go first, so what is left never exceeds one more merge a level."""
        while sum(map(len, self.levels)) > self.fan_in:
            lowest = next(i for i, runs in enumerate(self.levels) if runs)
            runs, self.levels[lowest] = self.levels[lowest], []
            self.add(self._one_run(runs), lowest + 1)
        return self._merged([blocks for runs in self.levels for blocks in runs])


def _group_columns(name: str) -> tuple[Column, Column]:
    c = F.col(f"`{name}`")
    return F.when(c.isNull(), 1).otherwise(0).cast("tinyint"), F.coalesce(c.cast("string"), F.lit(""))


def _order_columns(name: str, descending: bool, kind: T.DataType) -> tuple[Column, Column]:
    """A flag that puts null and NaN last, and the value, negated to descend."""
    c = F.col(f"`{name}`")
    fractional = isinstance(kind, (T.DoubleType, T.FloatType))
    if not fractional and not isinstance(kind, T.IntegralType):
        raise TypeError(f"{name}: rows are ordered by numbers, not by {kind.simpleString()}")
    missing = c.isNull() | F.isnan(c) if fractional else c.isNull()
    value = F.when(missing, 0).otherwise(c).cast("double" if fractional else "bigint")
    value = -value if descending else value
    return F.when(missing, 1).otherwise(0).cast("tinyint"), (value + 0.0 if fractional else value)


def _cut(batch: pa.RecordBatch, width: int, n: int, carry: list) -> pa.RecordBatch:
    """The rows of a sorted batch that are among the first ``n`` of their group; ``carry`` spans batches."""
    rows = batch.num_rows
    starts = np.zeros(rows, bool)
    for c in batch.columns[:width]:
        starts[1:] |= pc.not_equal(c.slice(1), c.slice(0, rows - 1)).to_numpy(zero_copy_only=False)
    first = tuple(c[0].as_py() for c in batch.columns[:width])
    at = np.arange(rows)
    begins = np.maximum.accumulate(np.where(starts, at, 0))
    place = at - begins
    if carry and carry[0] == first:
        place[begins == 0] += carry[1]
    carry[:] = [tuple(c[rows - 1].as_py() for c in batch.columns[:width]), int(place[-1]) + 1]
    return batch.filter(pa.array(place < n))


def _id_columns(name: str, kind: T.DataType) -> tuple[Column, Column]:
    """A flag that puts null last, and the id: a whole number or a string."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.IntegralType):
        value = F.coalesce(c.cast("bigint"), F.lit(0).cast("bigint"))
    elif isinstance(kind, T.StringType):
        value = F.coalesce(c, F.lit(""))
    else:
        raise TypeError(f"{name}: ids are whole numbers or strings, not {kind.simpleString()}")
    return F.when(c.isNull(), 1).otherwise(0).cast("tinyint"), value


def top_n(df: DataFrame, groups: list[str], order: list[tuple[str, bool]], row_id: str, n: int, buckets: int | None = None, fan_in: int = FAN_IN) -> DataFrame:
    """``groups`` + ``rank_no`` + ``row_id`` for the ``n`` best rows of every group.

    ``order`` lists (column, descending); then the lower ``row_id`` wins (strings by
    code point, null last), so the result is the same on every run.  Defined cases:
    null and NaN come after every number; a null group is a group of its own;
    repeated rows count as rows of their own (rows alike in ``row_id`` too tie in any
    order, being alike); a null ``row_id`` stays null; an empty table gives none;
    further columns, also of clashing names, are ignored.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    columns: list[Column] = []
    for i, g in enumerate(groups):
        flag, value = _group_columns(g)
        columns += [flag.alias(f"g{i}f"), value.alias(f"g{i}")]
    for i, (name, descending) in enumerate(order):
        flag, value = _order_columns(name, descending, kinds[name])
        columns += [flag.alias(f"o{i}f"), value.alias(f"o{i}")]
    flag, value = _id_columns(row_id, kinds[row_id])
    source = df.select(*columns, flag.alias("idf"), value.alias("id"))
    width = 2 * len(groups)
    size = input_bytes(source)
    count = buckets or max(1, math.ceil(size / BUCKET_BYTES), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = min(count, partitions_for(source, PARTITION_BYTES, size))
    key_columns = source.columns
    source = source.withColumn("bucket", F.pmod(F.xxhash64(*key_columns[:width]), F.lit(count)).cast("int")).select("bucket", *key_columns)
    if size > 64 * RUN_BYTES:
        source = source.coalesce(math.ceil(size / RUN_BYTES))  # takes splits together, without a shuffle

    arrow_of = {T.ByteType: pa.int8(), T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.StringType: pa.string()}
    schema = pa.schema([pa.field(f.name, arrow_of[type(f.dataType)]) for f in source.schema.fields[1:]])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        run = TaskContext.get().partitionId()
        carry: list = []
        number = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = _cut(batch, width + 1, n, carry)
            bucket = batch.column(0).to_numpy()
            edges = np.concatenate([[0], np.nonzero(np.diff(bucket))[0] + 1, [len(bucket)]])
            keys = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.columns[1:], schema)], schema=schema)
            rows, packed = [], []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                for at in range(lo, hi, BLOCK_ROWS):
                    rows.append(int(bucket[lo]))
                    packed.append(pack_rows(keys.slice(at, min(BLOCK_ROWS, hi - at))))
            numbers = list(range(number, number + len(rows)))
            number += len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), pa.array([run] * len(rows), pa.int32()), pa.array(numbers, pa.int64()), pa.array(packed, pa.binary())],
                names=["bucket", "run", "number", "block"],
            )

    runs = source.sortWithinPartitions(*source.columns).mapInArrow(pack, "bucket int, run int, number bigint, block binary")
    stored = runs.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket", "run", "number")
    id_type = source.schema["id"].dataType
    out_schema = T.StructType(
        [f for g in range(len(groups)) for f in (T.StructField(f"g{g}f", T.ByteType()), T.StructField(f"g{g}", T.StringType()))]
        + [T.StructField("rank_no", T.IntegerType()), T.StructField("idf", T.ByteType()), T.StructField("id", id_type)]
    )
    arrow = pa.schema([*[schema.field(i) for i in range(width)], pa.field("rank_no", pa.int32()), schema.field("idf"), schema.field("id")])

    def emit(merge_: BucketMerge) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for rank, key in merge_.finish():
            rows.append((*key[:width], rank, *key[-2:]))
            if len(rows) == 16384:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = run = None
        merged, held = BucketMerge(width, n, schema, fan_in), []
        for batch in batches:
            for b, r, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if held and (b, r) != (bucket, run):
                    merged.add(held)
                    held = []
                if b != bucket:
                    yield from emit(merged)
                    merged = BucketMerge(width, n, schema, fan_in)
                bucket, run = b, r
                held.append(block)
        if held:
            merged.add(held)
        yield from emit(merged)

    out = stored.mapInArrow(merge, out_schema)
    return out.select(
        *[F.when(F.col(f"g{i}f") == 0, F.col(f"g{i}")).cast(kinds[g]).alias(g) for i, g in enumerate(groups)],
        "rank_no", F.when(F.col("idf") == 0, F.col("id")).cast(kinds[row_id]).alias(row_id),
    )
