"""Subword lattice likelihood of texts.

The vocabulary and its initial weights exist already: the pieces of a public 32k sentence-piece model and their scores, which are
minus the merge ranks; rank r weighs 1 / (r + 2.7), Zipf's law. A word, marked at its front, is a lattice of all its segmentations
into pieces (characters that are no piece are spelled in byte pieces); the forward recursion in log space sums the probability of
all of them. Pieces never cross words, so a text's log-probability is the sum over its words plus the end piece.

The weights are refitted to the training texts by expectation-maximisation: forward and backward recursions over every distinct
word, times its count, give expected piece counts; the existing weights keep a share `prior` of the refitted ones. score is the
lattice's log-probability under these weights.

word_arc_score, beside it, is a lattice in which words of the training texts are arcs as well, from the front of a word to its end:
with counts c, N tokens and V distinct ones, such an arc weighs (c - D) / N, and the lattice of pieces gets the mass D * V / N that
this leaves (absolute discounting, D from the counts of ones and twos). What it gathers grows with the corpus, while the pieces' 32k
weights can't tell a frequent word from a rare one of the same pieces.

Distribution: texts are coded once into chunks of about CHUNK_TOKENS tokens, each with its own list of distinct words. Only
(chunk, word) rows are shuffled, never single tokens: counted by word, joined with every word's count and likelihood, and brought
back to their chunks, where numpy sums them per document. A frequent word has one row in a chunk, so no key is hot; every group
is bounded by the chunk. Tables between the steps lie in the shared folder.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK_TOKENS = 5_000_000
#: Tasks for every chunk when chunks meet their words.
SPREAD = 2
FRONT = "▁"
ROUNDS, PRIOR = 2, 0.1
WORDS_AT_ONCE = 20_000

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_P = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


class Vocabulary:
    """Pieces, their hashes and log weights. Piece 2 ends a text; pieces 3 to 258 are the bytes."""

    END, BYTES = 2, 3

    def __init__(self, pieces: list[str], scores: list[float]):
        self.pieces = pieces
        rank = np.array([-s if s < 0 else 0.0 for s in scores])
        plain = np.array([i > 258 and s > -1e8 and (FRONT not in p[1:]) for i, (p, s) in enumerate(zip(pieces, scores))])
        rank[~plain] = plain.sum()
        weight = 1.0 / (rank + 2.7)
        weight[~plain] = 0.0
        weight[[self.END, *range(self.BYTES, self.BYTES + 256)]] = 1.0 / (plain.sum() + 2.7)
        self.zipf = weight / weight.sum()
        self.longest = max(len(p) for p, k in zip(pieces, plain) if k)
        ids = np.flatnonzero(plain)
        keys = np.array([self._hash(pieces[i]) for i in ids], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        self.spelled = {pieces[i] for i in ids if len(pieces[i]) == 1}

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = ((h + ord(c) + 1) * int(_P)) & 0xFFFFFFFFFFFFFFFF
            h ^= h >> 29
        return h

    @classmethod
    def load(cls, path: str = VOCABULARY) -> "Vocabulary":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        return cls([model.id_to_piece(i) for i in range(n)], [model.get_score(i) for i in range(n)])

    def arcs(self, codes: np.ndarray) -> list[np.ndarray]:
        """For every length k, the piece (or -1) at every start of the words in the rows of codes."""
        found, h = [], np.zeros(codes.shape, np.uint64)
        for k in range(1, min(self.longest, codes.shape[1]) + 1):
            width = codes.shape[1] - k + 1
            h = (h[:, :width] + codes[:, k - 1 :] + np.uint64(1)) * _P
            h ^= h >> np.uint64(29)
            piece = np.full(h.shape, -1, np.int32)
            r, c = np.nonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            if len(r):
                asked = h[r, c]
                at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
                ok = self.keys[at] == asked
                piece[r[ok], c[ok]] = self.ids[at[ok]]
            found.append(piece)
        return found

    def spell(self, codes: np.ndarray, lp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log weight of spelling each character in bytes; -inf where the character is a piece."""
        chars, back = np.unique(codes, return_inverse=True)
        cost = np.full(len(chars), -np.inf)
        for i, c in enumerate(chars):
            if chr(int(c)) not in self.spelled:
                cost[i] = sum(lp[self.BYTES + b] for b in chr(int(c)).encode("utf-8", "surrogatepass"))
        return cost[back].reshape(codes.shape), chars


def _logsumexp(stack: np.ndarray) -> np.ndarray:
    top = stack.max(axis=0)
    top[np.isneginf(top)] = 0.0
    with np.errstate(divide="ignore"):
        return np.log(np.exp(stack - top).sum(axis=0)) + top


class Lattice:
    def __init__(self, vocabulary: Vocabulary, p: np.ndarray | None = None):
        self.v = vocabulary
        with np.errstate(divide="ignore"):
            self.lp = np.log(vocabulary.zipf if p is None else p)

    def _scores(self, codes):
        pieces = self.v.arcs(codes)
        lp = [np.where(x >= 0, self.lp[x], -np.inf) for x in pieces]
        spelled, _ = self.v.spell(codes, self.lp)
        return pieces, [np.logaddexp(lp[0], spelled), *lp[1:]], spelled

    def forward(self, codes: np.ndarray):
        """Log marginal probability of every row, a word of equal length, and what the backward recursion needs."""
        m, n = codes.shape
        pieces, lp, spelled = self._scores(codes)
        a = np.full((n + 1, m), -np.inf)
        a[0] = 0.0
        for j in range(1, n + 1):
            a[j] = _logsumexp(np.stack([a[j - k] + lp[k - 1][:, j - k] for k in range(1, min(j, len(lp)) + 1)]))
        return a[n], (a, pieces, lp, spelled)

    def expected(self, codes: np.ndarray, counts: np.ndarray, into: np.ndarray) -> None:
        """Adds the words' expected piece counts to into."""
        m, n = codes.shape
        total, (a, pieces, lp, spelled) = self.forward(codes)
        b = np.full((n + 1, m), -np.inf)
        b[n] = 0.0
        for i in range(n - 1, -1, -1):
            b[i] = _logsumexp(np.stack([b[i + k] + lp[k - 1][:, i] for k in range(1, min(n - i, len(lp)) + 1)]))
        for k in range(1, len(lp) + 1):
            r, i = np.nonzero(pieces[k - 1] >= 0)
            ids = pieces[k - 1][r, i]
            into += np.bincount(ids, counts[r] * np.exp(a[i, r] + self.lp[ids] + b[i + k, r] - total[r]), len(into))
        r, i = np.nonzero(~np.isneginf(spelled))
        for row, at, share in zip(r, i, counts[r] * np.exp(a[i, r] + spelled[r, i] + b[i + 1, r] - total[r])):
            for byte in chr(int(codes[row, at])).encode("utf-8", "surrogatepass"):
                into[self.v.BYTES + byte] += share

    def by_length(self, words: list[str]):
        """(places, codes) of the words, marked at the front, in groups of equal length."""
        lengths = np.array([len(w) for w in words])
        for n in np.unique(lengths):
            places = np.flatnonzero(lengths == n)
            step = max(1, min(len(places), WORDS_AT_ONCE * 12 // int(n + 1)))
            for s in range(0, len(places), step):
                some = places[s : s + step]
                flat = np.frombuffer("".join(FRONT + words[i] for i in some).encode("utf-32-le", "surrogatepass"), np.uint32)
                yield some, flat.reshape(len(some), n + 1).astype(np.uint64)

    def logs(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        for places, codes in self.by_length(words):
            out[places] = self.forward(codes)[0]
        return out


def _pack(codes: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(codes.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).ravel() if len(planes) else np.empty(0, np.uint32)


CHUNKS = "chunk bigint, doc_ids array<bigint>, held_out array<boolean>, sizes array<int>, codes binary, words array<string>, train_counts array<bigint>, train_docs bigint"


def encode(docs: DataFrame, held_out, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """CHUNKS of docs(doc_id, text); held_out is a boolean column, its documents aren't learned from."""
    schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int32())), ("codes", pa.binary()), ("words", pa.list_(pa.string())), ("train_counts", pa.list_(pa.int64())), ("train_docs", pa.int64())])

    def run(batches):
        base, number = TaskContext.get().partitionId() << 24, 0
        ids, outs, sizes, parts, known, size = [], [], [], [], {}, 0

        def flush():
            codes = np.concatenate([np.array(p, np.uint32) for p in parts]) if parts else np.empty(0, np.uint32)
            weight = np.repeat(~np.array(outs, bool), sizes)
            counts = np.bincount(codes, minlength=len(known))
            order = np.argsort(-counts, kind="stable")  # frequent words get small codes
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            train = np.bincount(codes[weight], minlength=len(known))[order]
            names = list(known)
            words = [names[i].decode("utf-8", "replace") for i in order]
            row = (base + number, ids, outs, sizes, _pack(place[codes] if len(codes) else codes), words, train, len(outs) - sum(outs))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for b in batches:
            for i, t, out in zip(*(c.to_pylist() for c in b.columns)):
                words = tokens(t)
                parts.append([known.setdefault(w, len(known)) for w in words])
                ids.append(i)
                outs.append(bool(out))
                sizes.append(len(words))
                size += len(words)
                if size >= chunk_tokens:
                    yield flush()
                    number += 1
                    ids, outs, sizes, parts, known, size = [], [], [], [], {}, 0
        if ids:
            yield flush()

    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInArrow(run, CHUNKS)


def refit(counts: DataFrame, vocabulary: Vocabulary, p: np.ndarray, n_ends: int, prior: float = PRIOR) -> np.ndarray:
    """One round of expectation-maximisation over counts(word, c): new piece probabilities."""
    held = counts.sparkSession.sparkContext.broadcast(Lattice(vocabulary, p))

    def run(batches):
        into = np.zeros(len(p))
        for b in batches:
            lattice = held.value
            c = np.array(b.column(1), np.float64)
            for places, codes in lattice.by_length(b.column(0).to_pylist()):
                lattice.expected(codes, c[places], into)
        used = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(into[used], pa.float64())], names=["piece", "n"])

    rows = counts.filter("c > 0").select("word", "c").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(len(p))
    for r in rows:  # at most one for each piece
        found[r.piece] = r.n
    found[Vocabulary.END] = n_ends
    total = found.sum()
    return (1 - prior) * found / total + prior * vocabulary.zipf if total else vocabulary.zipf


def score(docs: DataFrame, held_out, vocabulary: str = VOCABULARY, rounds: int = ROUNDS, prior: float = PRIOR, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, n_tokens, n_known, base_score, score, word_arc_score, train_tokens, train_types.

    Every text counts its words and one end. base_score is the add-one word model's log10 probability, score the lattice's of pieces,
    word_arc_score that of the lattice with words as arcs; all learn from the documents where held_out is false. rounds=0 keeps
    the existing weights.

    Defined results: null and empty texts are their end alone; repeated rows and ids are each scored; with nothing to learn from
    the existing weights score; an empty table gives an empty result; other columns are ignored. Texts are read whole."""
    v = Vocabulary.load(vocabulary)
    chunks = common.materialize(encode(docs, held_out, chunk_tokens), "chunks")
    rows = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "train_counts")).alias("place", "x")).select("chunk", "place", F.col("x.words").alias("word"), F.col("x.train_counts").alias("n"))
    counts = common.materialize(rows.groupBy("word").agg(F.sum("n").alias("c")), "words")
    n_ends = chunks.agg(F.sum("train_docs")).first()[0] or 0
    sums = counts.filter("c > 0").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("ones"), F.count_if(F.col("c") == 2).alias("twos")).first()
    total, types = (sums.n or 0) + n_ends, sums.v + (n_ends > 0)
    discount = min(0.95, max(0.05, sums.ones / max(1, sums.ones + 2 * sums.twos)))
    p = v.zipf
    for _ in range(rounds):
        p = refit(counts, v, p, n_ends, prior)
    held = docs.sparkSession.sparkContext.broadcast(Lattice(v, p))

    def likelihoods(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(held.value.logs(b.column(0).to_pylist()))], names=["word", "c", "lp"])

    scored = counts.select("word", "c").mapInArrow(likelihoods, "word string, c bigint, lp double")
    values = rows.join(scored, "word").select(F.col("chunk").alias("of_chunk"), "place", "c", "lp")
    end_c, end_lp = n_ends, float(math.log(p[Vocabulary.END]))
    level = math.log10(total + types + 1)

    def with_words(c, lp):
        """Log weight of words of training count c whose pieces weigh lp."""
        if not total:
            return lp
        with np.errstate(divide="ignore"):
            return np.logaddexp(np.log(np.maximum(c - discount, 0) / total), math.log(discount * types / total) + lp)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for row in left.to_pylist():
            n = right.num_rows
            at = right.column("place").to_numpy()
            c, lp = np.zeros(n, np.int64), np.zeros(n)
            c[at], lp[at] = right.column("c").to_numpy(), right.column("lp").to_numpy()
            codes, sizes = _unpack(row["codes"]), np.array(row["sizes"], np.int64)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            k = len(sizes)
            base = np.bincount(doc, np.log10(c + 1.0)[codes], k) + math.log10(end_c + 1) - (sizes + 1) * level
            known = np.bincount(doc, (c > 0)[codes], k).astype(np.int64) + (end_c > 0)
            mine = (np.bincount(doc, with_words(c, lp)[codes], k) + float(with_words(np.array(end_c), end_lp))) / math.log(10)
            alone = (np.bincount(doc, lp[codes], k) + end_lp) / math.log(10)
            parts.append(pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "held_out": pa.array(row["held_out"], pa.bool_()), "n_tokens": pa.array(sizes + 1), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(alone), "word_arc_score": pa.array(mine)}))
        return pa.concat_tables(parts) if parts else FINAL.empty_table()

    n = SPREAD * max(1, chunks.count())  # a task gets a few chunks, whatever the size of the input
    mine = chunks.select("chunk", "doc_ids", "held_out", "sizes", "codes").repartition(n, "chunk")
    sides = mine.groupBy("chunk").cogroup(values.repartition(n, "of_chunk").groupBy("of_chunk"))
    done = sides.applyInArrow(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, word_arc_score double")
    return done.withColumns({"train_tokens": F.lit(total).cast("long"), "train_types": F.lit(types).cast("long")})


FINAL = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("word_arc_score", pa.float64())])
