"""Operator 5: secrets by pattern, and by a battery of randomness tests.

Three fixed patterns give the base spans. Besides them, every long token of
key-like characters is tested. Its encoding is inferred from the characters it
uses; then

* chi-squared uniformity over the encoding's alphabet,
* the runs test of symbols above and below the alphabet's middle, and
* lag-1 serial correlation of the symbols

ask whether it looks random. Their p-values are combined by Bonferroni and go
through Benjamini-Hochberg over all tokens of a length class, since the tests grow sharper with the length:
tokens that it rejects are not random. How sure one can be that
one of the others was *not* written by hand is given by a likelihood ratio against a model of written tokens,
in which characters tend to stay in one class; its inverse bounds that p-value and shrinks with the length.
A second Benjamini-Hochberg step over all tokens of a length class controls the share of
false discoveries. Both thresholds need only histograms of p-values per
length class, whose size is fixed.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm.store import materialize

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # leftmost matches begin where a run begins
_CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: Alphabets from the narrowest on; a token has the first one that holds all its characters.
ALPHABETS = (
    "0123456789abcdef",
    "0123456789ABCDEF",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "0123456789abcdefghijklmnopqrstuvwxyz",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
)
_SETS = [frozenset(a) for a in ALPHABETS]
#: Lower bounds of the length classes.
LENGTHS = (20, 24, 32, 40, 64, 128)
#: In the model of written tokens: the chance that a character stays in the class of the one before.
STAY = 0.9
#: Bins of the p-value histograms: floor(-ln p), or of the battery floor(-FINE ln p), at most this.
BINS, FINE = 300, 8


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(cue in low for cue in _CUES):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def encoding(token: str) -> str | None:
    """The alphabet of a token that has digits and letters; None for words and numbers."""
    used = frozenset(token)
    if not any(c.isdigit() for c in used) or not any(c.isalpha() for c in used):
        return None
    return next((a for a, s in zip(ALPHABETS, _SETS) if used <= s), None)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def p_random(token: str, alphabet: str) -> float:
    """Bonferroni of the three tests; small if the token is not uniform over its alphabet."""
    x = np.array([alphabet.index(c) for c in token], dtype=float)
    n, k = len(x), len(alphabet)
    chi = ((np.bincount(x.astype(int), minlength=k) - n / k) ** 2).sum() * k / n
    d = k - 1  # Wilson-Hilferty
    uniform = math.erfc(((chi / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d)) / math.sqrt(2)) / 2
    high = x >= k / 2
    a, b = int(high.sum()), int(n - high.sum())
    runs = 1.0
    if a and b:
        mean, var = 2 * a * b / n + 1, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        runs = _two_sided((1 + np.count_nonzero(high[1:] != high[:-1]) - mean) / math.sqrt(var)) if var > 0 else 1.0
    elif n:
        runs = 2.0 ** (1 - n)
    y = x - x.mean()
    serial = _two_sided((y[1:] * y[:-1]).sum() / max((y * y).sum(), 1e-9) * math.sqrt(n))
    return min(1.0, 3 * min(uniform, runs, serial))


def written_bound(token: str, alphabet: str) -> float:
    """-ln of a bound on the p-value of "written by hand": the log-likelihood ratio of uniform against the class model."""
    size = {"a": 26, "A": 26, "0": 10, "-": 4}
    kinds = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" for c in token]
    written = -math.log(4) + sum(-math.log(size[k]) for k in kinds)
    stay = sum(a == b for a, b in zip(kinds, kinds[1:]))
    written += stay * math.log(STAY) + (len(kinds) - 1 - stay) * math.log((1 - STAY) / 3)
    return -len(token) * math.log(len(alphabet)) - written


def candidates(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, end, length class, bin of the bound, bin of the battery) of each testable token."""
    out = []
    for m in TOKEN.finditer(text):
        token = m[0].rstrip("=")
        if alphabet := encoding(token):
            group = sum(len(token) >= n for n in LENGTHS) - 1
            battery = -FINE * math.log(max(p_random(token, alphabet), 1e-300))
            out.append((m.start(), m.end(), group, int(min(max(written_bound(token, alphabet), 0), BINS)), int(min(max(battery, 0), BINS))))
    return out


def bh_bins(histogram: dict[int, int], rate: float, fine: int = 1) -> int:
    """The least bin whose tokens Benjamini-Hochberg accepts at ``rate``; BINS + 1 if none.

    A bin b holds p-values of at most exp(-b / fine), which is taken for all of them.
    """
    total, found, least = sum(histogram.values()), 0, BINS + 1
    for b in sorted(histogram, reverse=True):
        found += histogram[b]
        if math.exp(-b / fine) <= rate * found / total:
            least = b
    return least


_SCAN = "doc_id long, base array<struct<start:long,kind:int,stop:long>>, tested array<struct<start:long,stop:long,grp:int,bin:int,fit:int>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base_t = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())]))
        test_t = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("grp", pa.int32()), ("bin", pa.int32()), ("fit", pa.int32())]))
        for batch in batches:
            base, tested = [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                base.append([dict(zip(("start", "kind", "stop"), x)) for x in base_spans(text)])
                tested.append([dict(zip(("start", "stop", "grp", "bin", "fit"), x)) for x in candidates(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, base_t), pa.array(tested, test_t)], ["doc_id", "base", "tested"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(find, _SCAN)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in sorted(spans))


def find_secrets(docs: DataFrame, rate: float = 0.01, random_rate: float = 0.01, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans``.

    ``random_rate`` is the false-discovery rate of the battery, whose discoveries are tokens that are not random, and
    ``rate`` that of the tokens added as random. Spans count code points, their ends are exclusive. A token that lies in a
    base span is not added again. Null text counts as empty and has no spans;
    an empty table gives an empty result; other columns are ignored.
    """
    found = materialize(scan(docs, id_col, text_col), "secrets-scan")
    tested = found.select(F.explode("tested").alias("t")).select("t.grp", F.explode(F.array(F.struct(F.lit("bin").alias("of"), "t.bin"), F.struct(F.lit("fit").alias("of"), F.col("t.fit").alias("bin")))).alias("b"))
    histograms: dict[tuple[str, int], dict[int, int]] = {}
    for r in tested.groupBy("b.of", "grp", "b.bin").agg(F.count("*").alias("n")).collect():  # two histograms per length class at most
        histograms.setdefault((r["of"], r["grp"]), {})[r["bin"]] = r["n"]
    least = {g: bh_bins(h, rate) for (of, g), h in histograms.items() if of == "bin"}
    unfit = {g: bh_bins(h, random_rate, FINE) for (of, g), h in histograms.items() if of == "fit"}

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, base, tested in zip(*(batch.column(i).to_pylist() for i in range(3))):
                base = [(s["start"], s["kind"], s["stop"]) for s in base]
                more = [(t["start"], 3, t["stop"]) for t in tested if t["bin"] >= least[t["grp"]] and t["fit"] < unfit[t["grp"]]]
                more = [x for x in more if not any(a <= x[0] and x[2] <= b for a, _, b in base)]
                n = [sum(k == kind for _, k, _ in base + more) for kind in range(4)]
                rows.append((doc_id, *n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more)))
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return found.mapInArrow(finish, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
