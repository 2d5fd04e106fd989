"""Operator 4: language identification by averaged hashed subword embeddings.

A text's features are the 2- to 4-character substrings of its lower-cased words
(runs of letters, with a boundary mark at both ends), hashed into ``buckets``.
Their embeddings are averaged and a linear softmax follows; both are trained by
mini-batch stochastic gradient descent in numpy on the driver, from a bounded
sample of labelled rows (``max_docs_per_lang`` whole texts per language, each
cut into training segments). The temperature of the softmax is then fitted on
labelled texts kept apart from training, so that a score reads as a probability
of being right, and a text is rejected if its score is below ``reject_below`` (Chow's rule).

As the average is linear, the embeddings and the softmax weights fold into one
table of buckets x languages, which is what executors get.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Buckets (a power of two), embedding size, longest substring.
BUCKETS, DIM, ORDERS = 1 << 16, 16, 4
UNKNOWN = "und"
#: Letters that a prediction takes in at a time; a text may have any number.
_CHUNK = 1 << 19


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point the code of its lower-cased form, 0 if it is no letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            table[code] = ord(c.lower()[0])
    return table


def letter_codes(text: str) -> np.ndarray:
    """Lower-cased letters as code points, words parted and surrounded by single zeros; empty if there is no letter."""
    codes = np.zeros(len(text) + 2, dtype=np.uint32)
    codes[1:-1] = _letters()[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")]
    keep = codes != 0
    keep[0] = True
    keep[1:] |= codes[:-1] != 0  # the first of several marks
    codes = codes[keep]
    return codes if len(codes) > 1 else codes[:0]


def features(codes: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of each substring of two to four characters; a mark may begin or end it, but none is inside.

    Substrings with a mark inside fall into bucket 0, which nothing else uses.
    """
    out, h, mark = [], codes, codes == 0
    inner = None
    for n in range(2, ORDERS + 1):
        size = len(codes) - n + 1
        if size < 1:
            break
        h = h[:size] * np.uint32(0x01000193) + codes[n - 1 :]
        ids = (h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1)
        ids >>= np.uint32(8)
        ids &= np.uint32(buckets - 1)
        ids |= np.uint32(1)
        if n > 2:
            inner = mark[1 : 1 + size].copy() if inner is None else inner[:size] | mark[n - 2 : n - 2 + size]
            ids[inner] = 0
        out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.5

    def logits(self, text: str) -> np.ndarray | None:
        """Mean of the table's rows over all subwords of the whole text; None if it has no letter."""
        total, n = np.zeros(len(self.langs)), 0
        codes = letter_codes(text)
        if not len(codes):
            return None
        at = 0
        while at < len(codes):
            end = min(at + _CHUNK, len(codes))
            while 0 < end < len(codes) and codes[end - 1] != 0 and end - at < 2 * _CHUNK:
                end += 1  # to a word's end; a longer word is cut there
            ids = features(codes[max(0, at - 1) : end], len(self.table))
            total += np.ones(len(ids), np.float32) @ self.table.take(ids, axis=0)
            n += np.count_nonzero(ids)
            at = end
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated score, rejected. Null or letterless: und, 0, rejected."""
        logits = self.logits(text) if text else None
        if logits is None or not self.langs:
            return UNKNOWN, 0.0, True
        p = softmax(logits / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.reject_below)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def segments(text: str, rng: np.random.Generator, mean_chars: int = 120) -> list[str]:
    """The whole text in pieces of varying length, so that short inputs are learnt as well."""
    out, at = [], 0
    while at < len(text):
        n = int(rng.exponential(mean_chars)) + 12
        out.append(text[at : at + n])
        at += n
    return out


def train(rows: list[tuple[str, str]], seed: int = 7, epochs: int = 3, batch: int = 256, rate: float = 1.0, reject_below: float = 0.5, buckets: int = BUCKETS) -> Model:
    """Fit on (text, lang); every tenth text calibrates the temperature instead."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return Model([], np.zeros((buckets, 0)), np.zeros(0))
    order = rng.permutation(len(rows))
    held = {int(i) for i in order[: len(rows) // 10]}
    x, y, cal = [], [], []
    for i, (text, lang) in enumerate(rows):
        for part in segments(text, rng):
            ids = features(letter_codes(part), buckets)
            ids = ids[ids > 0]
            if len(ids):
                (cal if i in held else x).append(ids if i not in held else (ids, langs.index(lang)))
                if i not in held:
                    y.append(langs.index(lang))
    emb = rng.uniform(-1 / DIM, 1 / DIM, (buckets, DIM)).astype(np.float32)
    weights, bias, y = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32), np.array(y, dtype=np.int64)
    share = np.bincount(y, minlength=len(langs)) if len(y) else np.ones(len(langs))
    balance = (share.sum() / np.maximum(share, 1) / len(langs)).astype(np.float32)
    steps, done = max(1, epochs * -(-len(x) // batch)), 0
    for _ in range(epochs):
        for at in range(0, len(x), batch):
            pick = rng.integers(0, len(x), batch)
            ids = np.concatenate([x[i] for i in pick])
            sizes = np.array([len(x[i]) for i in pick])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(emb[ids], starts, axis=0) / sizes[:, None]
            p = softmax(mean @ weights + bias)
            p[np.arange(batch), y[pick]] -= 1
            p *= balance[y[pick], None]
            lr = rate * (1 - done / steps)
            back = (p @ weights.T) / sizes[:, None]
            weights -= lr * mean.T @ p / batch * 8
            bias -= lr * p.mean(axis=0)
            spot, where = np.unique(ids, return_inverse=True)
            step = np.empty((len(spot), DIM), np.float32)
            each = np.repeat(np.arange(batch), sizes)
            for k in range(DIM):
                step[:, k] = np.bincount(where, weights=back[each, k], minlength=len(spot))
            emb[spot] -= lr * step
            done += 1
    table = (emb @ weights).astype(np.float32)
    table[0] = 0
    return Model(langs, table, bias.astype(np.float64), _temperature(table, bias, cal), reject_below)


def _temperature(table: np.ndarray, bias: np.ndarray, cal: list) -> float:
    """Least negative log-likelihood on the calibration segments over a grid."""
    if not cal:
        return 1.0
    z = np.array([table[ids].mean(axis=0) + bias for ids, _ in cal], dtype=np.float64)
    y = np.array([k for _, k in cal])
    loss = {t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in np.geomspace(0.05, 20, 60)}
    return float(min(loss, key=loss.get))


def training_sample(docs: DataFrame, usable: Column, max_docs_per_lang: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """At most about ``max_docs_per_lang`` whole texts of each language, chosen by a hash of the id, ties and all."""
    rows = docs.filter(usable & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.withColumn("u", (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, max_docs_per_lang / n)))])
    return sorted((r["text"], r["lang"]) for r in rows.filter(F.col("u") < share[F.col("lang")]).select("text", "lang").collect())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred, score, rejected``; only the text decides.

    Null text and texts without a letter get ``und``, 0 and rejected. Other
    columns stay, but for those of these three names, which are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, whatever the data

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(text):
        import pandas as pd

        return pd.DataFrame([sent.value.predict(t) for t in text], columns=["lang_pred", "score", "rejected"])

    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    found = docs.select(*keep, predict(F.col(text_col)).alias("_found"))
    return found.select(*keep, "_found.lang_pred", "_found.score", "_found.rejected")


def train_on(docs: DataFrame, usable: Column, max_docs_per_lang: int = 250, reject_below: float = 0.5, **cols) -> Model:
    return train(training_sample(docs, usable, max_docs_per_lang, **cols), reject_below=reject_below)
