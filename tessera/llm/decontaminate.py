"""Benchmark decontamination by spaced-seed hashing.

Texts are sequences of words (runs of letters and digits, lower-cased). A mask such as 111101111 hashes the words at its ones
and ignores the others, so a substituted word under a zero, or outside the mask, doesn't hide a copied passage. All masked
positions of all benchmark items form a hash table; every position of every document is looked up in it for every mask. Around
each hit, item and document are compared along the same offset, and the best-scoring segment (a match +1, a substitution
-`penalty`) must hold `min_words` matching words with a share of at least `min_identity`.

The benchmark is the bounded side: blocks of about BLOCK_WORDS words are hashed and sent to the executors one after the other, and
every block is held against all documents, so a benchmark of any size is covered exactly. Where there are several, a block's
results are written to the shared folder before the next is built, so that driver and executors hold one at a time. Documents are
scanned where they lie: no shuffle, memory bounded by an Arrow batch, and a hot passage costs its documents' own comparisons only.

Items shorter than the shortest mask are compared as a whole with an exact mask of their own length. Items of fewer than
`shortest` words are too common inside other texts to tell anything: they are found where a whole line of a document has their words.

Defined results: null and empty texts and items never overlap; repeated rows and ids give their own rows; an empty benchmark
leaves everything alone; an empty table gives an empty result. Columns named like the added ones are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BLOCK_WORDS = 1_000_000
TOKENS_AT_ONCE = 250_000
WORDS = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    masks: tuple[str, ...] = ("111101111", "110110110111", "1101011001011", "111001110111", "1110111", "1101011", "11011011", "111111")
    min_words: int = 10
    min_identity: float = 0.75
    penalty: float = 2.0
    shortest: int = 6


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def best_segment(match: np.ndarray, penalty: float) -> tuple[int, int, int]:
    """(start, end, matches) of the segment with the largest sum of +1 for a match and -penalty for a substitution."""
    sums = np.concatenate(([0.0], np.cumsum(np.where(match, 1.0, -penalty))))
    gain = sums - np.minimum.accumulate(sums)
    end = int(gain.argmax())
    start = int(sums[: end + 1].argmin()) if end else 0
    return start, end, int(match[start:end].sum())


class SeedIndex:
    """The hash table of one block of items."""

    def __init__(self, items: list[tuple[int, str]], settings: Settings = Settings()):
        self.settings = settings
        self.number: dict[str, int] = {}
        self.items = [(i, np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(t)], np.int64)) for i, t in items]
        rng = np.random.default_rng(11)
        shortest = min(map(len, settings.masks))
        own = sorted({len(w) for _, w in self.items if settings.shortest <= len(w) < shortest})
        self.offsets = [np.flatnonzero(np.array(list(m)) == "1") for m in (*settings.masks, *("1" * n for n in own))]
        self.spans = [len(m) for m in settings.masks] + own
        self.factors = [rng.integers(1, 1 << 62, len(o), dtype=np.int64) | 1 for o in self.offsets]
        keys, where = [], []
        for k, span in enumerate(self.spans):
            for j, (_, ids) in enumerate(self.items):
                if len(ids) < span or len(ids) < settings.shortest or (k >= len(settings.masks) and len(ids) != span):
                    continue
                h = self.hashes(ids, k)
                keys.append(h)
                where.append(np.column_stack((np.full(len(h), j), np.arange(len(h)))))
        self.keys = np.concatenate(keys) if keys else np.empty(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.where = self.keys[order], (np.concatenate(where)[order] if where else np.empty((0, 2), np.int64))
        self.short: dict[tuple[str, ...], list[int]] = {}
        for j, (_, t) in enumerate(items):
            if 0 < len(own_words := tuple(words(t))) < settings.shortest:
                self.short.setdefault(own_words, []).append(j)
        self.bits = int(np.clip(np.ceil(np.log2(64 * max(1, len(self.keys)))), 10, 24))
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[self._slot(self.keys)] = True

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) >> np.uint64(64 - self.bits)).view(np.int64)

    def hashes(self, ids: np.ndarray, k: int) -> np.ndarray:
        n = len(ids) - self.spans[k] + 1
        h = np.zeros(max(0, n), np.int64)
        for o, f in zip(self.offsets[k], self.factors[k]):
            h += ids[o : o + n] * f  # wraps around
        return h * np.int64(-7046029254386353131) + np.int64(k)

    def scan(self, texts: list[str | None]):
        """Yields (text's place, overlaps) in chunks of whole texts; an overlap is (item's place, matches, identity,
        document's first word and end, item's first word and end)."""
        chunk, size, first = [], 0, 0
        for i, t in enumerate(texts):
            get = self.number.get
            chunk.append([get(w, 0) for w in words(t)])
            size += len(chunk[-1])
            if size > TOKENS_AT_ONCE or i == len(texts) - 1:
                found = dict(self._scan(chunk, first))
                if self.short:
                    for k in range(first, i + 1):
                        for row in self._short_lines(texts[k]):
                            found.setdefault(k, []).append(row)
                yield from sorted(found.items())
                chunk, size, first = [], 0, i + 1

    def _short_lines(self, text: str | None):
        """Overlaps of whole lines with short items, the first line of each."""
        at, seen = 0, set()
        for line in (text or "").split("\n"):
            own = words(line)
            for j in self.short.get(tuple(own), ()) if len(own) < self.settings.shortest else ():
                if j not in seen:
                    seen.add(j)
                    yield j, len(own), 1.0, at, at + len(own), 0, len(own)
            at += len(own)

    def _scan(self, chunk: list[list[int]], first: int):
        gap = max(self.spans, default=0)
        lengths = np.array([len(x) for x in chunk])
        starts = np.concatenate(([0], np.cumsum(lengths + gap)[:-1]))
        ids = np.zeros(int((lengths + gap).sum()), np.int64)
        for s, x in zip(starts, chunk):
            ids[s : s + len(x)] = x
        diagonals = [np.empty((0, 3), np.int64)]
        for k in range(len(self.spans)):
            if len(ids) < self.spans[k]:
                continue
            h = self.hashes(ids, k)
            hit = np.flatnonzero(self.maybe[self._slot(h)])
            left, right = np.searchsorted(self.keys, h[hit], "left"), np.searchsorted(self.keys, h[hit], "right")
            real = right > left
            p, a, n = hit[real], left[real], (right - left)[real]
            at = np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else a
            p = np.repeat(p, n)
            d = np.searchsorted(starts, p, "right") - 1
            diagonals.append(np.unique(np.column_stack((d, self.where[at, 0], p - starts[d] - self.where[at, 1])), axis=0))
        found: dict[int, dict[int, tuple]] = {}
        s = self.settings
        for d, j, shift in np.unique(np.concatenate(diagonals), axis=0).tolist():
            doc, item = ids[starts[d] : starts[d] + lengths[d]], self.items[j][1]
            lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
            if hi <= lo:
                continue
            a, b, matches = best_segment(doc[lo + shift : hi + shift] == item[lo:hi], s.penalty)
            if matches < min(s.min_words, len(item)) or matches < s.min_identity * (b - a):
                continue
            a, b = a + lo, b + lo
            row = (j, matches, matches / (b - a), a + shift, b + shift, a, b)
            if row[1:] > found.setdefault(d, {}).get(j, (0, 0))[1:]:
                found[d][j] = row
        for d, by_item in found.items():
            yield first + d, list(by_item.values())


def blocks(benchmark: DataFrame, settings: Settings = Settings(), block_words: int = BLOCK_WORDS):
    """(index, whether it is the last) of the benchmark's blocks, one after the other; an index is broadcast. benchmark(item_id, text)."""
    kept = benchmark.select("item_id", "text").filter(F.length("text") > 0)
    chars = kept.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // (6 * block_words))
    for k in range(n):
        rows = kept.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()
        held = benchmark.sparkSession.sparkContext.broadcast(SeedIndex(sorted((r.item_id, r.text) for r in rows), settings))
        yield held, k == n - 1
        if k < n - 1:  # its results are written
            held.unpersist()


OVERLAP = "item_id bigint, matched_words int, identity double, doc_start int, doc_end int, item_start int, item_end int"


def overlaps(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row (doc_id, OVERLAP) for every document and benchmark item that overlap: their best segment, in words."""
    spark = docs.sparkSession
    base = docs.select("doc_id", "text")
    out = T.StructType([base.schema["doc_id"], *T._parse_datatype_string(OVERLAP).fields])
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("matched_words", pa.int32()), ("identity", pa.float64()), *((c, pa.int32()) for c in ("doc_start", "doc_end", "item_start", "item_end"))])

    def finder(held):
        def run(batches):
            index = held.value
            for b in batches:
                doc_ids, rows = b.column(0).to_pylist(), []
                for i, found in index.scan(b.column(1).to_pylist()):
                    rows += [(doc_ids[i], index.items[j][0], *rest) for j, *rest in found]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(schema), schema)], schema=schema)

        return run

    result = spark.createDataFrame([], out)
    for held, last in blocks(benchmark, settings, block_words):
        part = base.mapInArrow(finder(held), out)
        result = result.unionByName(part if last else common.materialize(part, "overlaps"))
    return result


def decontaminate(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that overlap with no item; all columns stay."""

    def keeper(held, at):
        def run(batches):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for i, _ in held.value.scan(b.column(at).to_pylist()):
                    keep[i] = False
                yield b.filter(pa.array(keep))

        return run

    at = docs.columns.index("text")
    for held, last in blocks(benchmark, settings, block_words):
        docs = docs.mapInArrow(keeper(held, at), docs.schema)
        docs = docs if last else common.materialize(docs, "decontaminated")
    return docs
