"""A stable bucket of a token that every engine can compute, and bag vectors over buckets."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(token: Column, dim: int) -> Column:
    """The first eight hex digits of the token's md5, modulo dim."""
    return F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(dim)).cast("int")


def bag_vector(tokens: Column, dim: int) -> Column:
    """Counts of the tokens' buckets, array<double> of length dim."""
    buckets = F.transform(tokens, lambda t: bucket(t, dim))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(buckets, lambda b: b == d)).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, empty: float = 0.0) -> Column:
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(empty))


def bucket_cosine(x: Column, y: Column, empty: float = 0.0) -> Column:
    """Cosine of the counts of two arrays of buckets. Pass columns, not expressions: they are read several times."""
    def times(v: Column, d: Column) -> Column:
        return F.size(F.filter(v, lambda e: e == d)).cast("double")

    def squares(v: Column) -> Column:
        return F.aggregate(F.array_distinct(v), F.lit(0.0), lambda s, d: s + times(v, d) * times(v, d))

    product = F.aggregate(F.array_intersect(x, y), F.lit(0.0), lambda s, d: s + times(x, d) * times(y, d))
    norm = F.sqrt(squares(x) * squares(y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), product / norm).otherwise(F.lit(empty))


class _Buckets(dict):
    """Buckets of tokens by a worker; forgotten when there are many."""

    def __init__(self, dim: int):
        super().__init__()
        self.dim = dim

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        found = self[token] = int(hashlib.md5(token.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % self.dim
        return found


def _cosine(x: Counter, y: Counter) -> float:
    if not x or not y:
        return 0.0
    return sum(n * y[d] for d, n in x.items()) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))


def token_cosine(a: Column, b: Column, dim: int) -> Column:
    """Cosine of the bucket counts of two arrays of tokens, 0 if one is empty: linear in their lengths, where comparing arrays element
    by element is quadratic. Whole Arrow batches go to Python."""
    buckets = _Buckets(dim)

    def score(left: pa.Array, right: pa.Array) -> pa.Array:
        count = lambda v: Counter(buckets[t] for t in v or ())
        return pa.array([_cosine(count(x), count(y)) for x, y in zip(left.to_pylist(), right.to_pylist())], pa.float64())

    return F.arrow_udf(score, "double")(a, b)


def _pair_score(a: tuple[set, Counter], b: tuple[set, Counter], share: float) -> float:
    both = len(a[0] & b[0])
    jaccard = both / (len(a[0]) + len(b[0]) - both) if a[0] or b[0] else 0.0
    return share * min(3.0 * jaccard, 1.0) + (1.0 - share) * _cosine(a[1], b[1])


def neighbour_cohesion(sets: Column, share: float, dim: int = 128) -> Column:
    """Of an array of arrays of distinct tokens, the mean over neighbours of share * min(3 Jaccard, 1) + (1 - share) * bucket cosine;
    null with fewer than two."""
    buckets = _Buckets(dim)

    def score(column: pa.Array) -> pa.Array:
        out = []
        for items in column.to_pylist():
            bags = [(set(t), Counter(buckets[x] for x in t)) for t in items or ()]
            out.append(sum(_pair_score(a, b, share) for a, b in zip(bags, bags[1:])) / (len(bags) - 1) if len(bags) > 1 else None)
        return pa.array(out, pa.float64())

    return F.arrow_udf(score, "double")(sets)


def resampled_cohesion(key: Column, sets: Column, draws: int, share: float, seed: int, dim: int = 128) -> Column:
    """The same of `draws` resamples of the array, each of its length: draw b takes for place i the element that the md5 of
    "seed|key|b|i" names. Pairs are scored once, however often they are drawn."""
    buckets = _Buckets(dim)

    def score(keys: pa.Array, column: pa.Array) -> pa.Array:
        out, many = [], zip(keys, column)
        while some := list(islice(many, 32)):
            lists = [items.as_py() for _, items in some]
            drawn = _draws([f"{seed}|{k.as_py()}|" for k, _ in some], list(map(len, lists)), draws)
            out += [_resampled(items, at, share, buckets) for items, at in zip(lists, drawn)]
        return pa.array(out, pa.list_(pa.float64()))

    return F.arrow_udf(score, "array<double>")(key, sets)


def _resampled(items: list[list[str]], at: np.ndarray, share: float, buckets: _Buckets) -> list[float]:
    """Mean pair scores of the draws at(draw, place). All pairs of few items are scored at once, of many items those that are drawn."""
    n = len(items)
    if n <= 256:
        number: dict[str, int] = {}
        held, kept = np.zeros((n, buckets.dim)), [[number.setdefault(t, len(number)) for t in x] for x in items]
        for row, x in zip(held, items):
            np.add.at(row, [buckets[t] for t in x], 1)
        has = np.zeros((n, max(len(number), 1)))
        for row, x in zip(has, kept):
            row[x] = 1
        both, size = has @ has.T, has.sum(axis=1)
        either = size[:, None] + size[None, :] - both
        norm = (held * held).sum(axis=1)
        norm = np.sqrt(norm[:, None] * norm[None, :])
        divide = lambda a, b: np.divide(a, b, out=np.zeros((n, n)), where=b > 0)
        scores = share * np.minimum(3.0 * divide(both, either), 1.0) + (1.0 - share) * divide(held @ held.T, norm)
        return (scores[at[:, :-1], at[:, 1:]].sum(axis=1) / (n - 1)).tolist()
    bags, known, row = [(set(t), Counter(buckets[x] for x in t)) for t in items], {}, []
    for line in at.tolist():
        total = 0.0
        for x, y in zip(line, line[1:]):
            if (x, y) not in known:
                if len(known) > 200_000:
                    known.clear()
                known[x, y] = _pair_score(bags[x], bags[y], share)
            total += known[x, y]
        row.append(total / (n - 1))
    return row


def _draws(prefixes: list[str], sizes: list[int], draws: int) -> list[np.ndarray]:
    """Of every prefix the array (draw, place) of md5(prefix + draw + "|" + place), its first eight hex digits, modulo the size. Digests
    of all texts of one block are computed side by side."""
    suffix = [_suffixes(draws, at, min(at + 256, n)) for n in sizes for at in range(0, n, 256)]
    owner = [p for p, n in zip(prefixes, sizes) for _ in range(0, n, 256)]
    blocks = []
    for prefix, (text, length) in zip(owner, suffix):
        head = np.frombuffer(prefix.encode(), np.uint8)
        block = np.zeros((len(text), 64), np.uint8)
        block[:, len(head) : len(head) + text.shape[1]] = text
        block[:, : len(head)] = head
        total = length + len(head)
        if len(head) + text.shape[1] > 55:
            raise ValueError("a key too long for one block")
        block[np.arange(len(text)), total] = 0x80
        block[:, 56:58] = (total * 8).astype("<u2").view(np.uint8).reshape(-1, 2)
        blocks.append(block)
    first = md5_heads(np.concatenate(blocks)) if blocks else np.zeros(0, np.uint32)
    out, a = [], 0
    for n in sizes:
        parts = []
        for at in range(0, n, 256):
            wide = min(at + 256, n) - at
            parts.append(first[a : a + draws * wide].reshape(draws, wide))
            a += draws * wide
        out.append((np.concatenate(parts, axis=1) % np.uint32(n)).astype(np.int64))
    return out


@lru_cache(64)
def _suffixes(draws: int, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and lengths of "draw|place" for draws from 1 on and places from first to end, by draw."""
    texts = np.array([f"{b}|{i}" for b in range(1, draws + 1) for i in range(first, end)], dtype="S")
    return texts.view(np.uint8).reshape(len(texts), -1), np.char.str_len(texts)


_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNS = [[7, 12, 17, 22], [5, 9, 14, 20], [4, 11, 16, 23], [6, 10, 15, 21]]


def md5_heads(blocks: np.ndarray, most: int = 8192) -> np.ndarray:
    """The first eight hex digits, as numbers, of the md5 of padded texts of one block each, bytes (n, 64)."""
    out = np.empty(len(blocks), np.uint32)
    for at in range(0, len(blocks), most):
        w = np.ascontiguousarray(blocks[at : at + most].view("<u4").T)
        used = [bool(x.any()) for x in w]
        a, b, c, d = (np.full(w.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        for i in range(64):
            k = i // 16
            g = (i, 5 * i + 1, 3 * i + 5, 7 * i)[k] % 16
            f = d ^ (b & (c ^ d)) if k == 0 else c ^ (d & (b ^ c)) if k == 1 else b ^ c ^ d if k == 2 else c ^ (b | ~d)
            f += a
            f += np.uint32(_SINES[i])
            if used[g]:
                f += w[g]
            turn = _TURNS[k][i % 4]
            a, d, c, b = d, c, b, b + ((f << np.uint32(turn)) | (f >> np.uint32(32 - turn)))
        out[at : at + most] = (a + np.uint32(0x67452301)).byteswap()
    return out
