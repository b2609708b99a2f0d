"""Word shingles, their corpus weights, and improved consistent weighted sampling.

A shingle is five successive words (lower-cased, split at the six ASCII white-space characters), as a 64-bit hash; a text of one to four words is one
shingle. Its weight in a document is tf * idf, where idf(df) = ln(1 + N / max(df, c)) / ln(1 + N / c) with c = max(FLOOR, N * SHARE):
1 up to a document frequency of c, and falling above, so that passages which many unlike documents share count less than a
document's own words. N and df count documents that have the same least shingle (by a second hash) once: copies of a text mostly
agree in it, so thousands of copies don't make their own words look like boilerplate, nor their few edits look weighty.

Only shingles above c need a stored frequency, and there are at most 1 / SHARE times as many of those as shingles in a mean
document, whatever the corpus' size. They are found exactly in two passes over all documents. First, every task counts its
shingles in 2^SLOT_BITS slots; the sums over all tasks are no less than the frequency of any shingle in the slot, so only shingles
in slots above c can be frequent. Second, the distinct pairs of such a shingle and its documents' least shingle are counted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS = 5
SHARE, FLOOR = 1 / 200, 10
CHUNK = 1_000_000
SLOT_BITS, RANGE_BITS = 20, 14

_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)


SPACES = b" \t\n\v\f\r"
_rng = np.random.default_rng(1)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_BYTE = np.where(_SPACE, 0, _rng.integers(1, 1 << 63, 256, dtype=np.int64)).astype(np.uint64)
BLOCK_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER, _INVERSE = _powers(_ODD, BLOCK_BYTES), _powers(pow(_ODD, -1, 1 << 64), BLOCK_BYTES)


def normal(text: str | None) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass") if text else b""


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of every word: a polynomial of its bytes' random values, read off prefix sums over the text."""
    data = normal(text)
    if len(data) <= BLOCK_BYTES:
        return _hash_words(data)
    parts, at = [], 0
    while at < len(data):  # blocks end at white space; a word longer than a block is hashed by its blocks
        end = min(len(data), at + BLOCK_BYTES)
        if end < len(data):
            cut = max(data.rfind(bytes([c]), at, end) for c in SPACES)
            end = cut if cut > at else end
        parts.append(_hash_words(data[at:end]))
        at = end
    return np.concatenate(parts)


def _hash_words(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    inside = ~_SPACE[data]
    change = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(data) and inside[0]:
        change = np.concatenate(([0], change))
    if len(change) % 2:
        change = np.append(change, len(data))
    if not len(change):
        return np.empty(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWER[: len(data)], out=sums[1:])
    starts, ends = change[::2], change[1::2]
    h = (sums[ends] - sums[starts]) * _INVERSE[starts]
    return h ^ (h >> np.uint64(32))


def shingle_hashes(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    m = len(words)
    if not m:
        return words
    k = min(n, m)
    h = np.full(m - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ words[i : m - k + 1 + i]) * _P
        h ^= h >> np.uint64(32)
    return h


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).view(np.int64)


def least_shingle(shingles: np.ndarray) -> int:
    """The least by a second hash: documents agree in it with the probability of their Jaccard similarity."""
    h = (shingles ^ _Q) * _P
    return int((h ^ (h >> np.uint64(29))).min().view(np.int64))


class Weights:
    """idf of frequent shingles; every other has 1."""

    def __init__(self, n_docs: int = 0, keys=(), dfs=()):
        order = np.argsort(np.asarray(keys, np.uint64))
        self.keys, dfs = np.asarray(keys, np.uint64)[order], np.asarray(dfs, float)[order]
        c = max(FLOOR, n_docs * SHARE)
        self.n_docs = n_docs
        self.idf = np.log1p(n_docs / np.maximum(dfs, c)) / math.log1p(n_docs / c) if n_docs else np.empty(0)

    def of(self, shingles: np.ndarray) -> np.ndarray:
        out = np.ones(len(shingles))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, shingles), len(self.keys) - 1)
            hit = self.keys[at] == shingles
            out[hit] = self.idf[at[hit]]
        return out

    def bag(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct shingles and their weights."""
        s, tf = np.unique(shingle_hashes(word_hashes(text)), return_counts=True)
        return s, tf * self.of(s)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two bags."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) or not len(kb):
        return 0.0
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    hit = kb[at] == ka
    shared = float(np.minimum(wa[hit], wb[at[hit]]).sum())
    return shared / (float(wa.sum()) + float(wb.sum()) - shared)


def _tally(batches):
    """Counts of shingles in slots, packed by ranges of slots, and the documents' least shingles."""
    counts, leasts, some, size = np.zeros(1 << SLOT_BITS, np.uint32), set(), [], 0

    def add():
        nonlocal some, size
        np.add(counts, np.bincount(_slots(np.concatenate(some)), minlength=len(counts)).astype(np.uint32), out=counts)
        some, size = [], 0

    for b in batches:
        for t in b.column(0).to_pylist():
            s = shingle_hashes(word_hashes(t))
            if len(s):
                leasts.add(least_shingle(s))
                some.append(s)
                size += len(s)
                if size >= CHUNK:
                    add()
        if len(leasts) >= CHUNK:
            yield _tallied([None], [None], [list(leasts)])
            leasts.clear()
    if some:
        add()
    pack = zstandard.ZstdCompressor(level=1).compress
    ranges = counts.reshape(-1, 1 << RANGE_BITS)
    full = np.flatnonzero(ranges.any(axis=1))
    yield _tallied(full, [pack(ranges[i].tobytes()) for i in full], [None] * len(full))
    yield _tallied([None], [None], [list(leasts)])


def _tallied(ranges, counts, leasts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(counts, pa.binary()), pa.array(leasts, pa.list_(pa.int64()))], names=["range", "counts", "leasts"])


def fit(docs: DataFrame) -> Weights:
    """Weights of the corpus docs(text)."""
    spark = docs.sparkSession
    texts = docs.select("text")
    with common.Scratch(spark) as keep:
        tallied = keep(texts.mapInArrow(_tally, "range int, counts binary, leasts array<bigint>"), "tallies")
        n_docs = tallied.select(F.explode("leasts").alias("least")).distinct().count()
        least = max(FLOOR, n_docs * SHARE)

        def hot(batches):
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for r, packed in zip(*(c.to_pylist() for c in b.columns)):
                    sums.setdefault(r, np.zeros(1 << RANGE_BITS, np.int64))
                    sums[r] += np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint32)
            for r, n in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array((r << RANGE_BITS) + np.flatnonzero(n > least), pa.int64())], names=["slot"])

        # At most 2^SLOT_BITS slots, and no more than shingles of all documents by the least frequency.
        slots = [r.slot for r in tallied.filter("range is not null").select("range", "counts").repartition("range").mapInArrow(hot, "slot bigint").collect()]
    if not slots:
        return Weights(n_docs)
    maybe = np.zeros(1 << SLOT_BITS, bool)
    maybe[slots] = True
    held = spark.sparkContext.broadcast(maybe)

    def witness(batches):
        found, size = [], 0

        def flush():
            pairs = np.concatenate(found)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["shingle", "least"])

        for b in batches:
            for t in b.column(0).to_pylist():
                every = shingle_hashes(word_hashes(t))
                s = np.unique(every[held.value[_slots(every)]])
                if len(s):
                    found.append(np.column_stack((s.view(np.int64), np.full(len(s), least_shingle(every)))))
                    size += len(s)
                    if size >= CHUNK:
                        yield flush()
                        found, size = [], 0
        if found:
            yield flush()

    pairs = texts.mapInArrow(witness, "shingle bigint, least bigint").distinct()
    exact = pairs.groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > least).collect()
    return Weights(n_docs, np.array([r.shingle for r in exact], np.int64).view(np.uint64), [r.n for r in exact])


class Sampler:
    """Improved consistent weighted sampling: `size` samples (shingle, level) of a weighted bag. Two bags agree in a sample with
    the probability of their weighted Jaccard similarity. r and c are Gamma(2, 1), beta uniform, drawn from quantile tables by
    bits of a hash of shingle and sample number."""

    BLOCK = 4096

    def __init__(self, size: int, seed: int = 1):
        self.seeds = np.random.default_rng(seed).integers(1, 1 << 63, size, dtype=np.uint64)
        self.r = self._gamma(16)
        self.log_c = np.log(self._gamma(18))

    @staticmethod
    def _gamma(bits: int) -> np.ndarray:
        """Quantiles of Gamma(2, 1), 1 - (1 + x) exp(-x) inverted by bisection."""
        u = (np.arange(1 << bits) + 0.5) / (1 << bits)
        lo, hi = np.zeros(len(u)), np.full(len(u), 60.0)
        for _ in range(60):
            mid = (lo + hi) / 2
            below = 1 - (1 + mid) * np.exp(-mid) < u
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        return ((lo + hi) / 2).astype(np.float32)

    def __call__(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        best, out = np.full(len(self.seeds), np.inf, np.float32), np.zeros(len(self.seeds), np.uint64)
        every = np.arange(len(self.seeds))
        for s in range(0, len(keys), self.BLOCK):
            k = keys[s : s + self.BLOCK]
            x = (k[None, :] ^ self.seeds[:, None]) * _P
            x ^= x >> np.uint64(32)
            x *= _Q
            x ^= x >> np.uint64(29)
            r = self.r[(x & np.uint64(0xFFFF)).view(np.int64)]
            beta = ((x >> np.uint64(34)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(1 / 65536)
            log_w = np.log(weights[s : s + self.BLOCK]).astype(np.float32)
            a = self.log_c[((x >> np.uint64(16)) & np.uint64(0x3FFFF)).view(np.int64)] - r * (1 - beta)
            level = np.zeros(a.shape, np.float32)
            if len(other := np.flatnonzero(log_w)):  # weight 1 has level 0
                level[:, other] = np.floor(log_w[other] / r[:, other] + beta[:, other])
                a[:, other] -= r[:, other] * level[:, other]
            at = a.argmin(axis=1)
            found = a[every, at]
            better = found < best
            picked = level[every, at].astype(np.int64).view(np.uint64)
            h = (k[at] ^ (picked * _Q)) * _P
            h ^= h >> np.uint64(31)
            out[better], best[better] = h[better], found[better]
        return out
