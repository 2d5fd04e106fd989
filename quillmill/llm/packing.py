"""Operator 10: pack token sequences by best-two-fit.

A bin is filled greedily with the largest pieces that fit; then its smallest
piece is replaced by two unpacked pieces that fill the expanded gap more
tightly, as long as that gains.

Only lengths matter, and there are at most ``capacity`` of them. So the plan
is made from the histogram of lengths, whose size does not grow with the data:
each distinct filling is repeated as often as the remaining counts allow. The
pieces then look up their place by their rank among pieces of equal length.
Ranks are taken per (length, shard), so that a length shared by a third of all
pieces is spread over many tasks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillmill.llm.store import materialize
from quillmill.llm.tokens import ids_with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids and the end id, cut into pieces of ``capacity`` tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_with_end(text.as_py(), vocabulary, end_id)
                for k, at in enumerate(range(0, len(ids) // 4, capacity)):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append((doc_id, k, at, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def _largest(left: np.ndarray, bound: int) -> int:
    """The largest length <= bound of which one is left; 0 if none."""
    found = left[bound:0:-1] > 0
    at = int(found.argmax()) if bound > 0 else 0
    return bound - at if bound > 0 and found[at] else 0


def _best_two(left: np.ndarray, gap: int, beat: int) -> tuple[int, int]:
    """Two lengths whose sum is the largest that is over ``beat`` and within ``gap``; (0, 0) if none."""
    there = left[: gap + 1] > 0
    for total in range(gap, max(beat, 1), -1):
        low = (total + 1) // 2  # the larger of the two is at least half
        found = there[low:total] & there[total - low : 0 : -1]
        if 2 * low == total and left[low] < 2:
            found[0] = False
        if found.any():
            a = low + int(found.argmax())
            return a, total - a
    return 0, 0


def packing_plan(histogram: dict[int, int], capacity: int = 4096) -> list[tuple[list[int], int]]:
    """``(lengths of a bin, number of such bins)`` covering the histogram exactly."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan = []
    while True:
        items: list[int] = []
        room = capacity
        while length := _largest(left, room):
            n = int(min(left[length], room // length))
            items += [length] * n
            left[length] -= n
            room -= n * length
        if not items:
            return plan
        while room:
            smallest = items.pop()
            a, b = _best_two(left, room + smallest, smallest)
            if not a:
                items.append(smallest)
                break
            left[smallest] += 1
            left[a] -= 1
            left[b] -= 1
            items = sorted([*items, a, b], reverse=True)
            room += smallest - a - b
        used = Counter(items)
        more = int(min(left[length] // n for length, n in used.items()))
        for length, n in used.items():
            left[length] -= n * more
        plan.append((items, 1 + more))


def _slots(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first rank of each run of places, its first sequence, places per bin, offset of the first."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: Counter = Counter()
    sequence = 0
    for items, times in plan:
        offset = 0
        for length, n in sorted(Counter(items).items(), reverse=True):
            runs.setdefault(length, []).append((taken[length], sequence, n, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    return {length: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for length, rows in runs.items()}


def pack(pieces: DataFrame, capacity: int = 4096, rows_per_shard: int = 50_000) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    ``pieces`` has a column ``length`` of 1 to ``capacity``; it should be a
    written table, as it is read three times. Offsets of a sequence are gapless from
    0; equal lengths are interchangeable, so ties need no order. An empty table
    gives an empty result.
    """
    keep = pieces.columns
    total = pieces.count()
    shards = max(1, -(-total // rows_per_shard))
    # the row's own place in the written table decides its shard, so copies of a row spread as well
    rows = materialize(pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("int")), "pack-rows")
    counted = rows.groupBy("length", "shard").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    slots = _slots(packing_plan(histogram, capacity))
    starts = counted.withColumn("first", F.sum("n").over(W.partitionBy("length").orderBy("shard")) - F.col("n")).drop("n")
    rank = F.row_number().over(W.partitionBy("length", "shard").orderBy("doc_id", "piece")) - 1
    ranked = rows.withColumn("rank", rank).join(starts, ["length", "shard"]).withColumn("rank", (F.col("rank") + F.col("first")).cast("long"))
    sent = pieces.sparkSession.sparkContext.broadcast(slots)  # bounded by the capacity, not by the data

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for value in np.unique(length):
                mine = length == value
                first, at, per_bin, shift = sent.value[int(value)]
                run = np.searchsorted(first, rank[mine], side="right") - 1
                inside = rank[mine] - first[run]
                sequence[mine] = at[run] + inside // per_bin[run]
                offset[mine] = shift[run] + inside % per_bin[run] * value
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    schema = ranked.select(*keep).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema
    return ranked.select(*keep, "rank").mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Null text counts as empty and still gives its end id. Only documents over
    ``capacity`` tokens are cut. Repeated rows are packed each by itself. Other
    columns are ignored.
    """
    return pack(materialize(token_pieces(docs, vocabulary, capacity, end_id, id_col, text_col), "pieces"), capacity)
