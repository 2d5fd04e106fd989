"""Operator 3: remove every byte covered by a long substring that also starts earlier in the corpus.

What suffix arrays with common prefixes are used for, without sorting every
suffix (the README says why): a string of ``length`` bytes is found through
its anchor, the leftmost of its ``gram``-byte substrings with the least hash.
Equal strings have equal anchors at equal places, and one anchor serves a run of
neighbouring strings, so the corpus is described by about one row in 35 bytes.

1. Each row holds hashes of the anchor and of its context (all bytes of its
   run of strings). Among rows of equal context only the earliest can hold first
   occurrences; the others' bytes go as a whole. A task combines its own rows first.
2. Earliest rows whose anchor has further contexts are looked at string by string:
   their contexts are fetched from the texts, grouped by anchor, and all strings but the earliest
   of their kind go. Anchors with more than ``MOST_CONTEXTS`` contexts are dealt by
   string instead of by anchor.

Strings are compared by two 64-bit hashes over independent random numbers of the bytes, or by 128 bits of BLAKE2;
contexts by one such hash, of all their bytes, beside that of their anchor. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.store import drop, materialize

#: Contexts of one anchor that a single task compares.
MOST_CONTEXTS = 5_000
#: Bytes hashed at a time; longer texts are taken in overlapping parts.
_PART = 1 << 20
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two random odd numbers per byte, and the powers of a base and of its inverse modulo 2**64."""
    rng = np.random.default_rng(5)
    letters = np.stack([rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)])
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(_PART + 1, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return letters, out[0], out[1]


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = (x ^ np.uint64(seed) ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def prefix_sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    """sums[i] is the hash (of two) of the first i bytes; (sums[j] - sums[i]) * inverse**i that of bytes i to j."""
    letters, power, _ = _powers()
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(letters[which][data] * power[: len(data)], out=sums[1:])
    return sums


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Per anchor of one part: hash of the anchor, hash of its context, first and last start of its strings."""
    _, _, inverse = _powers()
    sums = prefix_sums(data)
    starts, width = len(data) - length + 1, length - gram + 1
    grams = _mix((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])
    value = ((grams >> np.uint64(24)) << np.uint64(24)) | np.arange(len(grams), dtype=np.uint64)
    # least value in each window: suffix minima of a block and prefix minima of the next
    rows = np.concatenate([value, np.full(-len(value) % width, 2**64 - 1, dtype=np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[:starts], ahead[width - 1 : width - 1 + starts])
    place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    lo = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    hi = np.concatenate([lo[1:], [starts]]) - 1
    at = place[lo]
    context = _mix((sums[hi + length] - sums[lo]) * inverse[lo], 77) + _mix(((at - lo) * 1000 + hi - lo).astype(np.uint64), 99)
    return grams[at].view(np.int64), context.view(np.int64), lo, hi


def text_anchors(data: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The same over a text of any size; parts overlap by length - 1 bytes, so each string is in one part."""
    for at in range(0, max(1, len(data) - length + 1), _PART - length + 1):
        part = data[at : at + _PART]
        if len(part) >= length:
            key, context, lo, hi = anchors(part, length, gram)
            yield key, context, lo + at, hi + at


def _bytes(text) -> np.ndarray:
    return np.frombuffer((text.as_py() or "").encode(), dtype=np.uint8)


def _merged(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Intervals [lo, hi) of rows, with touching ones of a row joined."""
    if not len(row):
        return row, lo, hi
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    shift = np.int64(1) << 40  # positions within a row stay far below
    rank = np.cumsum(np.concatenate([[0], row[1:] != row[:-1]]))
    reach = np.maximum.accumulate(hi + rank * shift)
    new = np.concatenate([[True], (lo + rank * shift)[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(row) - 1]])
    return row[new], lo[new], (reach - rank * shift)[last]


_ROWS = "kind int, key long, context long, ord long, row long, lo long, hi long"


def _record(kind: int, key, context, ord_, row, lo, hi) -> pa.RecordBatch:
    n = len(row)
    cols = [np.full(n, kind, np.int32), *(np.zeros(n, np.int64) if c is None else c for c in (key, context, ord_, row, lo, hi))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "key", "context", "ord", "row", "lo", "hi"])


def _first_of(*cols: np.ndarray) -> np.ndarray:
    """True where a row of sorted columns differs from the one before."""
    return np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in cols])])


ANCHOR, GONE, SEVERAL, MANY = 0, 1, 2, 3


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Anchor rows, after each batch's own later copies of a context have become intervals that go."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for row, order, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for key, context, lo, hi in text_anchors(_bytes(text), length, gram):
                    found.append((key, context, np.full(len(key), order, np.int64), np.full(len(key), row, np.int64), lo, hi))
            if not found:
                continue
            cols = [np.concatenate(c) for c in zip(*found)]
            sort = np.lexsort((cols[4], cols[3], cols[2], cols[1], cols[0]))
            key, context, ord_, row, lo, hi = (c[sort] for c in cols)
            first = _first_of(key, context)
            yield _record(ANCHOR, *(c[first] for c in (key, context, ord_, row, lo, hi)))
            gone = _merged(row[~first], lo[~first], hi[~first] + length)
            yield _record(GONE, gone[0], None, None, *gone)

    return docs.select("row", "ord", "text").mapInArrow(emit, _ROWS)


def split_contexts(rows: DataFrame, length: int, most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """Intervals that go (GONE), and the earliest rows of anchors with several contexts (SEVERAL, or MANY)."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the earliest rows of the last anchor, one per context

        def leaders(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            key = cols[0]
            if not len(key):
                return
            _, where, n = np.unique(key, return_inverse=True, return_counts=True)
            n = n[where]
            for kind, mine in ((SEVERAL, (n > 1) & (n <= most_contexts)), (MANY, n > most_contexts)):
                if mine.any():
                    yield _record(kind, *(c[mine] for c in cols))

        for batch in batches:
            kind, *cols = (batch.column(i).to_numpy() for i in range(7))
            gone = kind == GONE
            if gone.any():
                yield _record(GONE, *(c[gone] for c in cols))
                cols = [c[~gone] for c in cols]
            if not len(cols[0]):
                continue
            n_held = 0 if held is None else len(held[0])
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            first = _first_of(cols[0], cols[1])
            later = ~first
            if later.any():
                row, lo, hi = _merged(cols[3][later], cols[4][later], cols[5][later] + length)
                yield _record(GONE, row, None, None, row, lo, hi)
            lead = [c[first] for c in cols]
            last = lead[0] == cols[0][-1]
            yield from leaders([c[~last] for c in lead])
            held = [c[last] for c in lead]
        if held is not None:
            yield from leaders(held)

    dealt = rows.repartition(F.col("key")).sortWithinPartitions("key", "context", "ord", "row", "lo")
    return dealt.mapInArrow(settle, _ROWS)


def context_bytes(docs: DataFrame, leads: DataFrame, length: int) -> DataFrame:
    """``part, kind, ord, row, lo, data``: the contexts; of MANY, each string by itself, parted by its hash."""
    lists = leads.groupBy("row").agg(F.collect_list(F.struct("kind", "key", "lo", "hi")).alias("leads"))  # of one document
    both = docs.join(lists, "row").select("row", "ord", "text", "leads")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["part", "kind", "ord", "row", "lo", "data"]
        for batch in batches:
            out: list[tuple] = []
            for row, order, text, leads_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                data = (text.as_py() or "").encode()
                for x in leads_:
                    if x["kind"] == SEVERAL:
                        out.append((x["key"], SEVERAL, order, row, x["lo"], data[x["lo"] : x["hi"] + length]))
                    else:
                        for at in range(x["lo"], x["hi"] + 1):
                            digest = hashlib.blake2b(data[at : at + length], digest_size=16).digest()
                            out.append((int.from_bytes(digest[:8], "little", signed=True), MANY, order, row, at, digest))
                if len(out) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return both.mapInArrow(fetch, "part long, kind int, ord long, row long, lo long, data binary")


def later_strings(contexts: DataFrame, length: int) -> DataFrame:
    """``row, lo, hi``: intervals of all strings of the contexts but the earliest of their kind."""

    def compare(cols: list) -> pa.RecordBatch:
        """Whole groups, sorted by (part, ord, row, lo)."""
        part, row, lo, data = cols
        _, _, inverse = _powers()
        sizes = np.array([len(d) for d in data])
        hashes, checks, which, starts = [], [], [], []
        at = 0
        while at < len(data):  # as many contexts at a time as the powers reach
            n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), _PART)))
            mine = sizes[at : at + n]
            flat = np.frombuffer(b"".join(data[at : at + n]), dtype=np.uint8)
            sums, others = prefix_sums(flat), prefix_sums(flat, 1)
            begin = np.concatenate([[0], np.cumsum(mine)[:-1]])
            count = mine - length + 1
            who = np.repeat(np.arange(n), count)
            inside = np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            s = begin[who] + inside
            h = (sums[s + length] - sums[s]) * inverse[s]
            mixed = _mix(part[at + who].view(np.uint64), 3)
            hashes.append(_mix(h, 1) + mixed)
            checks.append((others[s + length] - others[s]) * inverse[s])
            which.append(at + who)
            starts.append(lo[at + who] + inside)
            at += n
        h, check, who, start = (np.concatenate(x) for x in (hashes, checks, which, starts))
        order = np.argsort(h, kind="stable")  # keeps the order of rows within equal strings
        again = np.zeros(len(h), dtype=bool)
        again[order[1:]] = (h[order][1:] == h[order][:-1]) & (check[order][1:] == check[order][:-1])
        # the contexts of a group are sorted by document and place, but neighbours may overlap: the earliest start counts
        r, a, b = _merged(row[who[again]], start[again], start[again] + length)
        return pa.RecordBatch.from_arrays([pa.array(r), pa.array(a), pa.array(b)], ["row", "lo", "hi"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        last_string: bytes | None = None
        for batch in batches:
            kind = batch.column(1).to_numpy()
            many = kind == MANY
            data = batch.column(5).to_pylist()
            cols = [batch.column(i).to_numpy() for i in (0, 3, 4)]
            if many.any():  # sorted by (kind, part, data, ...): all but the first of a run go
                idx = np.flatnonzero(many)
                strings = [data[i] for i in idx]
                again = np.array([s == t for s, t in zip(strings, [last_string, *strings[:-1]])])
                last_string = strings[-1]
                r, a = cols[1][idx][again], cols[2][idx][again]
                r, a, b = _merged(r, a, a + length)
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(a), pa.array(b)], ["row", "lo", "hi"])
                cols, data = [c[~many] for c in cols], [d for d, m in zip(data, many) if not m]
            if not data:
                continue
            if held is not None:
                cols, data = [np.concatenate([h, c]) for h, c in zip(held[:3], cols)], held[3] + data
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            held = [*(c[cut:] for c in cols), data[cut:]]
            if cut:
                yield compare([*(c[:cut] for c in cols), data[:cut]])
        if held is not None and len(held[3]):
            yield compare(held)

    dealt = contexts.repartition(F.col("part"), F.col("kind")).withColumn("string", F.when(F.col("kind") == MANY, F.col("data")))
    dealt = dealt.sortWithinPartitions("kind", "part", "string", "ord", "row", "lo").drop("string")
    return dealt.mapInArrow(settle, "row long, lo long, hi long")


def remove_repeats(docs: DataFrame, length: int = 100, gram: int = 24, id_col: str = "doc_id", text_col: str = "text", most_contexts: int = MOST_CONTEXTS) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes``.

    Texts count as UTF-8 bytes. A string starts earlier if its document has a
    smaller id (nulls are largest; rows of one id by their place in the scan) or, in one document, a
    smaller offset. What is left need not be valid UTF-8; ``kept_bytes`` holds it. Null text counts as
    empty, texts under ``length`` bytes lose nothing, an empty table gives an
    empty result; other columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("ord"), F.col(text_col).alias("text"))
    settled = materialize(split_contexts(anchor_rows(rows, length, gram), length, most_contexts), "substr-anchors")
    leads = settled.filter(F.col("kind").isin(SEVERAL, MANY))
    later = materialize(later_strings(context_bytes(rows, leads, length), length), "substr-later")
    gone = settled.filter(F.col("kind") == GONE).select("row", "lo", "hi").unionByName(later)
    lists = gone.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("gone"))  # of one document
    both = rows.join(lists, "row", "left").select("doc_id", "text", "gone")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, gone in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = (text.as_py() or "").encode()
                lo, hi = (np.array([g[k] for g in gone or ()], dtype=np.int64) for k in ("lo", "hi"))
                _, lo, hi = _merged(np.zeros(len(lo), np.int64), lo, hi)
                edges = [0, *(x for pair in zip(lo.tolist(), hi.tolist()) for x in pair), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                out.append((doc_id, len(data), len(data) - len(kept), len(lo), hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])

    return both.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
