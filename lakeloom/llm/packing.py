"""Best-fit packing planned on the length histogram.

Texts become token pieces of at most ``capacity`` tokens. Only the number of pieces of each length
reaches the driver (at most ``capacity`` numbers). Best-fit decreasing runs over these counts: pieces
of one length go, many at a time, to the fullest open sequences that take them, so a plan entry stands
for many like sequences. A plan entry gives a range of ranks within one length their sequences and
offsets; each piece finds its entry by its rank within its length. Ranks are dealt without a window
over a length, however many pieces share it: a task numbers its own pieces of each length, and
offsets add up the counts of the tasks before it.

Cases: a null or empty text is the closing id alone; texts longer than ``capacity`` are cut into full
pieces and a rest, all other texts stay whole; repeated rows and null keys are pieces of their own; no
rows give no rows. The result has the columns listed at ``pack``; of the input's other columns those in
``keep`` are carried along, under their names; a name that clashes with a result column is an error.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .store import materialise

CAPACITY = 2048


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, closing_id: int = 0, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each piece: ``keep``, piece, start, length, ids (packed), and the task's number and rank of it within its length."""
    path = path or bpe.default_path()
    own = [("piece", pa.int32(), T.IntegerType()), ("start", pa.int64(), T.LongType()), ("length", pa.int64(), T.LongType()), ("ids", pa.binary(), T.BinaryType()), ("ids_crc32", pa.int64(), T.LongType()), ("task", pa.int32(), T.IntegerType()), ("task_rank", pa.int64(), T.LongType())]
    if clash := {n for n, _, _ in own} & set(keep):
        raise ValueError(f"columns clash with the result: {sorted(clash)}")
    schema = T.StructType([*(docs.schema[c] for c in keep), *(T.StructField(n, t) for n, _, t in own)])

    def run(batches):
        encoder, task, seen = bpe.load(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, end, texts in bpe.text_chunks(batch.column("text")):
                ids, bounds = encoder.encode(texts)
                n = end - first
                ids = np.insert(ids, bounds[1:], closing_id)
                bounds = bounds + np.arange(n + 1)
                cuts = -(-np.diff(bounds) // capacity)
                row = np.repeat(np.arange(n), cuts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(capacity, np.diff(bounds)[row] - start)
                order = np.argsort(length, kind="stable")
                rank = np.empty(len(row), np.int64)
                sizes, at = np.unique(length, return_counts=True)
                rank[order] = bpe.spread(seen[sizes], at)
                seen[sizes] += at
                data = ids.astype("<u4").tobytes()
                edge = np.append(bounds[row] + start, len(ids)) * 4
                view = memoryview(data)
                crc = [zlib.crc32(view[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
                values = {
                    "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(length, pa.int64()),
                    "ids": pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(edge.astype(np.int32).tobytes()), pa.py_buffer(data)]),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "task": pa.array(np.full(len(row), task), pa.int32()),
                    "task_rank": pa.array(rank, pa.int64()),
                }
                part = batch.slice(first, n)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in keep), *values.values()], names=[*keep, *values])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces, first sequence, offset): best-fit decreasing over counts of lengths.

    Open sequences are kept as groups (how many, what lies in them) under the room they have left.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    rooms: list[int] = []
    closed: list[tuple[int, tuple[int, ...]]] = []

    def put(left: int, many: int, inside: tuple[int, ...]) -> None:
        if not left:
            closed.append((many, inside))
            return
        if left not in room:
            room[left] = []
            bisect.insort(rooms, left)
        room[left].append((many, inside))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        filled = []  # put after all of this length are placed where they fit best, or at once if they fit again
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                fit = capacity // length
                if left >= fit:
                    filled.append((capacity - fit * length, left // fit, (length,) * fit))
                    left %= fit
                if left:
                    filled.append((capacity - left * length, 1, (length,) * left))
                break
            space = rooms[at]
            many, inside = room[space].pop()
            if not room[space]:
                del room[space]
                rooms.pop(at)
            fit = space // length
            whole = min(many, left // fit)
            if whole:
                put(space - fit * length, whole, inside + (length,) * fit)
            left -= whole * fit
            if whole < many:
                rest = many - whole
                if left:
                    put(space - left * length, 1, inside + (length,) * left)
                    left, rest = 0, rest - 1
                if rest:
                    put(space, rest, inside)
        for group in filled:
            put(*group)
    out, used, sequence = [], dict.fromkeys(counts, 0), 0
    for many, inside in closed + [group for groups in room.values() for group in groups]:
        offset = 0
        for length in inside:
            out.append((length, used[length], many, sequence, offset))
            used[length] += many
            offset += length
        sequence += many
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, closing_id: int = 0, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """``keep``, piece, start, length, ids (if ``with_ids``), ids_crc32, sequence_id, offset for every piece of ``docs``."""
    made = pieces(docs, path, capacity, closing_id, keep)
    made = materialise(made if with_ids else made.drop("ids"), "pieces")
    by_task = materialise(made.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = by_task.select("length", "task", before.alias("first_rank"))
    counts = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    entries = plan(counts, capacity)
    entries.sort()
    table = np.array(entries, np.int64).reshape(-1, 5)
    wide = docs.sparkSession.sparkContext.broadcast(table)  # bounded by the capacity, not by the data

    columns = [*keep, "piece", "start", "length", *(["ids"] if with_ids else []), "ids_crc32"]
    ranked = made.join(first, ["length", "task"]).select(*columns, (F.col("task_rank") + F.col("first_rank")).alias("_rank"))
    schema = T.StructType([*(ranked.schema[c] for c in columns), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches):
        plan_table = wide.value
        low = {int(k): int(v) for k, v in zip(*np.unique(plan_table[:, 0], return_index=True), strict=True)}
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("_rank").to_numpy(zero_copy_only=False)
            entry = np.empty(len(length), np.int64)
            for size in np.unique(length).tolist():
                begin = low[size]
                end = begin + int(np.searchsorted(plan_table[begin:, 0], size, "right"))
                mine = length == size
                entry[mine] = begin + np.searchsorted(plan_table[begin:end, 1], rank[mine], "right") - 1
            sequence = plan_table[entry, 3] + rank - plan_table[entry, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(plan_table[entry, 4])], names=schema.names)

    return ranked.mapInArrow(run, schema)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, with_ids=False)


QUERIES = {"op4_best_fit_packing": op4_best_fit_packing}
