"""Operator 6: SimHash near-duplicates by deletion-variant signatures.

A fingerprint is cut into two 32-bit segments, so few that of up to three
differing bits at least one segment holds at most one. Each segment is indexed
under its 32 one-wildcard variants (one bit deleted); fingerprints whose segment
differs in at most one bit share a variant, found by equality, and are then
verified over all 64 bits.

A pair is examined under one variant only: the one of the differing bit, or
the first if the segment is the same. So a variant needs work only if its deleted
bit takes both values among its members, and equal segments cost nothing
in the other 31. Variants with more than ``block`` members are dealt to tasks
as pairs of blocks; inside a block pair the links are reduced to a spanning
forest, which keeps every component while the rows stay linear.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.components import connected_components
from quillmill.llm.skew import bitmap, maybe_in
from quillmill.llm.store import drop, materialize

SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` words, repeats included; fewer words: of the whole sequence."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()  # bytes: only A-Z, only ASCII white space
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    if len(parts) < words:
        return np.array([xxh64_intdigest(b" ".join(parts), SEED)], dtype=np.uint64)
    runs = zip(*(parts[k:] for k in range(words)))
    return np.fromiter(map(xxh64_intdigest, map(b" ".join, runs), repeat(SEED)), dtype=np.uint64, count=len(parts) - words + 1)


def majority_bits(hashes: np.ndarray, chunk: int = 20_000) -> int:
    """Bit i is 1 if it is set in over half the hashes; no hashes: 0."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), chunk):
        part = hashes[at : at + chunk]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the 64 bits as a signed long. Null text has no words: 0."""

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority_bits(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64), pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(prints, "doc_id long, fp long")


def forest(left: np.ndarray, right: np.ndarray) -> list[int]:
    """Positions of the links (left[i], right[i]) that join two trees, taken in order."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    kept = []
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        if (a := root(a)) != (b := root(b)):
            parent[a] = b
            kept.append(i)
    return kept


def _close(left: np.ndarray, right: np.ndarray, distance: int, same: bool, rows: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs at most ``distance`` bits apart; same: left and right are one list."""
    a_all, b_all = [], []
    for at in range(0, len(left), rows):
        part = left[at : at + rows]
        near = np.bitwise_count(part[:, None] ^ right[None, :]) <= distance
        if same:
            near &= np.arange(at, at + len(part))[:, None] < np.arange(len(right))[None, :]
        i, j = np.nonzero(near)
        kept = forest(part[i], right[j])
        a_all.append(part[i[kept]])
        b_all.append(right[j[kept]])
    a, b = np.concatenate(a_all or [left[:0]]), np.concatenate(b_all or [left[:0]])
    kept = forest(a, b)
    return a[kept], b[kept]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Runs of rows with equal keys of sorted batches; a run may cross batches."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        cols = {f.name: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.schema)}
        if held is not None:
            cols = {k: np.concatenate([held[k], v]) for k, v in cols.items()}
        n = len(cols[keys[0]])
        if not n:
            continue
        cut = np.flatnonzero(np.logical_or.reduce([cols[k][1:] != cols[k][:-1] for k in keys])) + 1
        edges = [0, *cut.tolist()]
        for a, b in zip(edges, edges[1:]):
            yield {k: v[a:b] for k, v in cols.items()}
        held = {k: v[edges[-1] :] for k, v in cols.items()}
    if held is not None:
        yield held


def variants(prints: DataFrame) -> DataFrame:
    """``key, part, bit, fp``: key is the variant (part = 32 * segment + deleted position), bit what was deleted."""
    part = F.explode(F.expr("sequence(0, 63)")).alias("part")
    rows = prints.select("fp", part)
    segment = F.expr("(shiftrightunsigned(fp, 32 * (part div 32))) & 4294967295")
    rows = rows.withColumn("segment", segment).withColumn("place", F.expr("part % 32"))
    bit = F.expr("(shiftright(segment, cast(place as int)) & 1)").cast("int")
    masked = F.expr("segment & ~shiftleft(1L, cast(place as int))")
    return rows.select(F.expr("cast(part as long)").alias("part"), masked.alias("masked"), bit.alias("bit"), "fp").select(
        (F.shiftleft(F.col("part"), 32).bitwiseOR(F.col("masked"))).alias("key"), "part", "bit", "fp"
    )


def close_links(prints: DataFrame, distance: int = 3, block: int = 2048, *, every: bool = True) -> DataFrame:
    """``a, b``: links between distinct fingerprints of ``prints`` (column fp, unique) that keep all components.

    Without ``every``, links of more than three bits are allowed, of which only those in whose pair one segment differs in at most one bit are found.
    """
    if every and not 0 <= distance <= 3:
        raise ValueError("two segments with one wildcard find up to three differing bits")
    rows = variants(prints)
    sized = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("bit").alias("ones"), F.first("part").alias("part"))
    busy = sized.filter("n > 1 and (part % 32 = 0 or (ones > 0 and ones < n))").select("key", "n")
    # Spark takes the exploded rows for no larger than the fingerprints; without the hint the busy variants may be gathered in the driver
    members = rows.join(busy.hint("merge"), "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    members = members.withColumn("own", own)
    # block pair (i, j), i <= j, gets the members of i and j
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    members = members.select("key", "part", "bit", "fp", "own", other)
    members = members.select("key", "part", "bit", "fp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_a, out_b, size = [], [], 0
        for g in _groups(batches, ["key", "i", "j"]):
            fp, bit, own = g["fp"].view(np.uint64), g["bit"], g["own"]
            if len(fp) < 2:
                continue
            first = int(g["part"][0]) % 32 == 0
            pairs = []
            if g["i"][0] == g["j"][0]:
                if first:
                    pairs.append((fp, fp, True))
                else:
                    pairs.append((fp[bit == 0], fp[bit == 1], False))
            else:
                x, y = own == g["i"][0], own == g["j"][0]
                if first:
                    pairs.append((fp[x], fp[y], False))
                else:
                    pairs += [(fp[x & (bit == 0)], fp[y & (bit == 1)], False), (fp[y & (bit == 0)], fp[x & (bit == 1)], False)]
            for left, right, same in pairs:
                a, b = _close(left, right, distance, same)
                out_a.append(a.view(np.int64))
                out_b.append(b.view(np.int64))
                size += len(a)
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])
                out_a, out_b, size = [], [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    dealt = members.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(link, "a long, b long")


def simhash_components(docs: DataFrame, words: int = 3, distance: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id``.

    component_id is the smallest doc_id reachable over fingerprints at most
    ``distance`` bits apart, the row's own included. Documents without words have
    fingerprint 0 and link like any other. A null doc_id takes part in links
    but is no component id unless all of its component are null. An empty
    table gives an empty result; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, words, id_col, text_col), "simhash-fp")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "simhash-nodes")
    roots = connected_components(close_links(nodes.select("fp"), distance))
    labelled = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    labelled = materialize(labelled.select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    smallest = labelled.groupBy("root").agg(F.min("least_id").alias("component_id"))
    names = labelled.join(smallest, "root").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


# Near copies: sets of word shingles, found by their fingerprints and then by their rarest members.
#
# Fingerprints that share a deletion variant propose pairs, as above. Sets with a similarity of 0.8 differ in
# about ten bits, and often share none; an exact way finds those. In one order of all shingles, two sets with a
# Jaccard similarity of t or more share a member among the first n - ceil(t n) + 1 of each (n its own size). The order puts shingles that are common in a sample last, so
# groups stay small; any order gives the same result.

#: Texts whose shingles are counted to learn which are common, and the most shingles that are so kept.
SAMPLE, MOST_COMMON = 20_000, 200_000
#: Differing bits of a pair that is still compared. No result depends on it.
LOOSE_BITS = 16
#: As many links between near copies, or fewer, are solved in one task.
FEW_LINKS = 100_000
#: Bits of a set's sketch, and of one with many members: a multiple of the first.
BITS, LONG_BITS, MANY_MEMBERS = 1024, 8192, 1000


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def sketch(hashes: np.ndarray) -> bytes:
    """A bit per bucket of the hashes: whether it holds an odd number of them.

    Two sets differ by at least as many members as their sketches by bits. A long sketch
    folds into a short one by exclusive or of its parts.
    """
    bits = BITS if len(hashes) < MANY_MEMBERS else LONG_BITS
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


class Sketches:
    """Sketches of either length, compared by rows."""

    def __init__(self, rows: list[bytes]):
        wide = np.array([len(r) > BITS // 8 for r in rows], dtype=bool)
        self.at = np.where(wide, np.cumsum(wide) - 1, -1)
        self.wide = np.frombuffer(b"".join(r for r in rows if len(r) > BITS // 8), dtype=np.uint64).reshape(-1, LONG_BITS // 64)
        self.short = np.empty((len(rows), BITS // 64), dtype=np.uint64)
        self.short[~wide] = np.frombuffer(b"".join(r for r in rows if len(r) <= BITS // 8), dtype=np.uint64).reshape(-1, BITS // 64)
        self.short[wide] = np.bitwise_xor.reduce(self.wide.reshape(-1, LONG_BITS // BITS, BITS // 64), axis=1)

    def differing(self, x: np.ndarray, other: Sketches, y: np.ndarray) -> np.ndarray:
        """In how many bits rows x differ from rows y of the other."""
        n = np.bitwise_count(self.short[x] ^ other.short[y]).sum(axis=1, dtype=np.int64)
        both = np.flatnonzero((self.at[x] >= 0) & (other.at[y] >= 0))
        n[both] = np.bitwise_count(self.wide[self.at[x[both]]] ^ other.wide[other.at[y[both]]]).sum(axis=1, dtype=np.int64)
        return n


def admissible(n: np.ndarray, left: Sketches, x: np.ndarray, m: np.ndarray, right: Sketches, y: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of sets (rows x, y of sizes and sketches) may be similar, none that is similar being left out, and a bound on their similarity."""
    n, m = n[x], m[y]
    at = np.flatnonzero(np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6)
    differ = np.maximum(left.differing(x[at], right, y[at]), np.abs(n[at] - m[at]))
    both = n[at] + m[at]
    near = differ <= (1 - similarity) / (1 + similarity) * both + 1e-6
    at, differ, both = at[near], differ[near], both[near]
    return at, (both - differ) / np.maximum(both + differ, 1)


def common_shingles(docs: DataFrame, row_col: str, text_col: str, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of shingles in three or more texts of a sample, and in how many. They only order the shingles."""
    share = min(1.0, max(0.005, SAMPLE / max(1, docs.count())))

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t.as_py(), words)).view(np.int64))], ["key"])

    some = docs.filter(F.pmod(F.xxhash64(row_col), F.lit(10_000)) < round(10_000 * share)).select(F.col(text_col).alias("text"))
    counted = some.mapInArrow(shingles, "key long").groupBy("key").agg(F.count("*").alias("n")).filter("n > 2")
    found = counted.orderBy(F.desc("n"), "key").limit(MOST_COMMON).toArrow()  # rows of Python would take far more of the driver
    keys, n = (found.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(keys.view(np.uint64))
    return keys.view(np.uint64)[order], n[order]


def shingle_sets(docs: DataFrame, row_col: str, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """``row, doc_id, fp, bits, n, sketch, prefix``: fp is a hash of the whole set of shingles, bits its SimHash fingerprint, prefix its first members as bytes."""
    from xxhash import xxh64_intdigest

    sent = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, row_col, text_col, words))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, counts = sent.value
        for batch in batches:
            fps, bits, sizes, sketches, prefixes = [], [], [], [], []
            for t in batch.column(2):
                x = np.unique(shingle_hashes(t.as_py(), words))
                rank = np.zeros(len(x), dtype=np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
                    rank = np.where(common[at] == x, counts[at], 0)
                fps.append(xxh64_intdigest(x.tobytes(), SEED))
                bits.append(majority_bits(x))
                sizes.append(len(x))
                sketches.append(sketch(x))
                prefixes.append(x[np.argsort(rank, kind="stable")[: prefix_size(len(x), similarity)]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (fps, bits)), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(prefixes, pa.binary())],
                ["row", "doc_id", "fp", "bits", "n", "sketch", "prefix"],
            )

    rows = docs.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(prints, "row long, doc_id long, fp long, bits long, n long, sketch binary, prefix binary")


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """``a, b``: pairs of nodes (fp, bits) whose fingerprints share a deletion variant and differ in at most ``LOOSE_BITS`` bits, as many as join all that such pairs join.

    These include all pairs that differ in three bits or fewer. Nodes of one fingerprint are paired with the first of them, and the firsts of linked fingerprints with each other.
    """
    firsts = materialize(nodes.groupBy("bits").agg(F.min("fp").alias("first")), "near-bits")
    links = close_links(firsts.select(F.col("bits").alias("fp")), LOOSE_BITS, every=False)
    for end in "ab":
        links = links.join(firsts.select(F.col("bits").alias(end), F.col("first").alias(f"first_{end}")), end)
    same = nodes.select("fp", "bits").join(firsts, "bits").filter("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    return links.select(F.col("first_a").alias("a"), F.col("first_b").alias("b")).union(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def shared_shingles(nodes: DataFrame) -> DataFrame:
    """``key, fp``: each shingle of a prefix that is in the prefix of another node (fp, prefix), too."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = batch.column(1).to_pylist()
            keys = np.frombuffer(b"".join(prefixes), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.repeat(batch.column(0).to_numpy(), [len(p) // 8 for p in prefixes]))], ["key", "fp"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the last row waits for the next batch; whether it equals the one before is known
        key, fp, held = np.zeros(0, np.int64), np.zeros(0, np.int64), False
        for batch in batches:
            key, fp = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([fp, batch.column(1).to_numpy()])
            if not len(key):
                continue
            same = key[1:] == key[:-1]
            out = np.concatenate([[held], same])
            out[:-1] |= same
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][out[:-1]]), pa.array(fp[:-1][out[:-1]])], ["key", "fp"])
            key, fp, held = key[-1:], fp[-1:], bool(out[-1])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"])

    rows = nodes.select("fp", "prefix").mapInArrow(expand, "key long, fp long")
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(shared, "key long, fp long")


def lead_pairs(shared: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """``a, b``: each node with the first and the last member of its shingles' groups that it shares most shingles with, if the bounds allow."""
    ends = shared.groupBy("key").agg(F.min("fp").alias("first"), F.max("fp").alias("last"))
    rows = shared.join(ends, "key")
    picks = []
    for end in ("first", "last"):
        counted = rows.filter(F.col("fp") != F.col(end)).groupBy("fp", end).agg(F.count("*").alias("n"))
        picks.append(counted.groupBy("fp").agg(F.max_by(end, F.struct("n", end)).alias("lead")))
    both = picks[0].unionByName(picks[1])
    pairs = both.select(F.least("fp", "lead").alias("a"), F.greatest("fp", "lead").alias("b")).distinct()
    left, right = (nodes.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"s{k}")) for k in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb")

    def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.arange(batch.num_rows)
            n, m, left, right = batch.column(2).to_numpy(), batch.column(3).to_numpy(), Sketches(batch.column(4).to_pylist()), Sketches(batch.column(5).to_pylist())
            at, _ = admissible(n, left, every, m, right, every, similarity)
            yield batch.select(["a", "b"]).take(pa.array(at))

    return joined.mapInArrow(admit, "a long, b long")


def open_pairs(shared: DataFrame, nodes: DataFrame, labels: DataFrame, similarity: float, block: int = 2048, *, nearest: bool = False) -> DataFrame:
    """``a, b``: all pairs of nodes (fp, n, sketch) that share a shingle of ``shared``, whose ``labels`` (node, root)
    differ, and whose sizes and sketches allow the similarity. Both bounds are exact: no similar pair is above them.

    ``nearest``: of each node's pairs only the one with the highest bound, as a step on the way.
    Groups with more than ``block`` members are dealt to tasks as pairs of blocks.
    """
    rows = shared.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rows = materialize(rows, "near-labelled")
    sized = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    rows = rows.join(sized.select("key", F.ceil(F.col("m") / block).cast("int").alias("blocks")), "key")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "root").join(nodes.select("fp", "n", "sketch"), "fp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k in _whole_groups(batches, ["key", "i", "j"]):
            key, i, j, own, fp, root, n = (k[c] for c in ("key", "i", "j", "own", "fp", "root", "n"))
            sketches = Sketches(k["sketch"].tolist())
            found, bounds = [np.zeros((0, 2), dtype=np.int64)], [np.zeros(0)]
            at, d = np.arange(len(fp)), 0
            while len(at):
                d += 1
                at = at[at + d < len(fp)]
                at = at[(key[at] == key[at + d]) & (i[at] == i[at + d]) & (j[at] == j[at + d])]
                x = at[(root[at] != root[at + d]) & ((i[at] == j[at]) | (own[at] != own[at + d]))]
                near, bound = admissible(n, sketches, x, n, sketches, x + d, similarity)
                found.append(np.stack([fp[x[near]], fp[x[near] + d]], axis=1))
                bounds.append(bound)
            pairs, bound = np.concatenate(found), np.concatenate(bounds)
            if nearest:
                pairs, bound = np.concatenate([pairs, pairs[:, ::-1]]), np.concatenate([bound, bound])
                order = np.lexsort((pairs[:, 1], -bound, pairs[:, 0]))
                pairs, bound = pairs[order], bound[order]
                first = np.flatnonzero(np.diff(pairs[:, 0], prepend=pairs[:1, 0] - 1)) if len(pairs) else np.zeros(0, np.int64)
                pairs, bound = pairs[first], bound[first]
            else:
                pairs = np.unique(np.sort(pairs, axis=1), axis=0)
                bound = np.zeros(len(pairs))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), pa.array(bound)], ["a", "b", "bound"])

    dealt = rows.select("key", "i", "j", "own", "fp", "root", "n", "sketch").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = dealt.mapInArrow(link, "a long, b long, bound double")
    if nearest:
        found = found.groupBy("a").agg(F.max_by("b", F.struct("bound", -F.col("b"))).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return found.select("a", "b").distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted batches, cut so that runs of rows with equal keys stay together."""
    held: list[dict[str, np.ndarray]] = []
    for batch in batches:
        cols = {f.name: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.schema)}
        if not batch.num_rows:
            continue
        last = np.logical_and.reduce([cols[k] == cols[k][-1] for k in keys])
        cut = int(np.argmax(last))
        if held and not (cut == 0 and all(held[-1][k][-1] == cols[k][0] for k in keys)):
            head = {k: v[:cut] for k, v in cols.items()}
            yield {k: np.concatenate([h[k] for h in held] + [head[k]]) for k in cols}
            held = []
        elif not held and cut:
            yield {k: v[:cut] for k, v in cols.items()}
        held.append({k: v[cut:] for k, v in cols.items()})
    if held:
        yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}


def similar(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' shingle sets have a Jaccard similarity of at least ``similarity``. texts: fp, text."""
    left, right = (texts.select(F.col("fp").alias(k), F.col("text").alias(f"t{k}")) for k in "ab")
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for ta, tb in zip(batch.column(2), batch.column(3)):
                x, y = (np.unique(shingle_hashes(t.as_py(), words)) for t in (ta, tb))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return joined.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, row_col: str, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``row, doc_id, component, kept``; one row of each component is kept.

    Documents link if the Jaccard similarity of their sets of word shingles is ``similarity`` or
    more, whatever their lengths; the components are those of all such pairs. Pairs come from SimHash fingerprints of the sets that share
    a deletion variant, and each is compared exactly. Similar sets need not share one, so each document is also compared with up to two
    members of its shingles' groups, then with the one that may be most similar; what this joins needs no more comparisons, and all other
    pairs that share a shingle of their prefixes are looked at. ``row_col`` holds a unique
    long that every scan reads alike. The row with the smallest doc_id stays (nulls last, then the smallest row). Documents without words link with one another.
    An empty table gives an empty result.
    """
    prints = materialize(shingle_sets(docs, row_col, id_col, text_col, words, similarity), "near-sets")
    nodes = prints.groupBy("fp").agg(F.min_by(F.struct("bits", "n", "sketch", "prefix"), "row").alias("set"), F.min("row").alias("row"))
    wide = materialize(nodes.select("fp", "set.*", "row"), "near-wide")
    rows = materialize(prints.select("row", "doc_id", "fp"), "near-prints")
    drop(prints)
    shared = materialize(shared_shingles(wide), "near-shared")
    nodes = materialize(wide.drop("prefix"), "near-nodes")
    drop(wide)
    text = docs.select(F.col(row_col).alias("row"), F.col(text_col).alias("text"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = materialize(pairs, f"near-{name}-pairs")
        involved = materialize(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct().join(nodes.select("fp", "row"), "fp"), f"near-{name}-nodes")
        some = maybe_in(text, bitmap(involved, ["row"]), ["row"], "asked").filter("asked")  # other texts need not be shuffled
        texts = materialize(some.join(involved, "row").select("fp", "text"), f"near-{name}-texts")
        return materialize(similar(pairs, texts, words, similarity), f"near-{name}")

    first = verified(fingerprint_pairs(nodes).union(lead_pairs(shared, nodes, similarity)).distinct(), "first")
    # what is known is handed on as stars, whose components take few rounds
    known = materialize(connected_components(first, at_once=FEW_LINKS), "near-known")
    second = verified(open_pairs(shared, nodes, known, similarity, nearest=True), "second")
    known = materialize(connected_components(second.union(known.select("node", "root")), at_once=FEW_LINKS), "near-known")
    rest = verified(open_pairs(shared, nodes, known, similarity), "rest")
    roots = connected_components(rest.union(known.select("node", "root")), at_once=FEW_LINKS)
    rows = rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rows = materialize(rows.select("row", "doc_id", F.coalesce("root", "fp").alias("component")), "near-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    first_row = rows.groupBy("component").agg(F.min(order).alias("first"))
    return rows.join(first_row, "component").select("row", "doc_id", "component", (F.col("row") == F.col("first.row")).alias("kept"))
