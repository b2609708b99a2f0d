"""Near-duplicate groups by consistent weighted sampling.

1. Weights of shingles over all documents (shingles.fit).
2. One pass gives every document a fingerprint of its words and BANDS * ROWS samples; ROWS samples make the key of a band.
   Documents of one fingerprint are one node from here on, so exact copies cost nothing more.
3. Inside every bucket, blocks of at most BLOCK members and BLOCK_WEIGHT of weight are held against each other: members whose
   samples agree often enough, and whose weights allow the threshold, are candidates. The components of the candidates, not the
   pairs, leave a block; one that several buckets or bands give is one unit.
4. The texts of a unit's members meet once. The weighted Jaccard similarities of all its pairs come from one product of its
   members' shingles; what leaves is a star for every group of verified links. So each pair of a bucket is decided exactly, no pair
   is written, and the rows of a step grow with memberships, whatever the size of a bucket.
5. Verified links give components.

A true pair of similarity 0.8 shares a bucket with probability 1 - (1 - 0.8^3)^10 = 0.999, and agrees in less than AGREE of 30
samples once in 4,000; agree=0 verifies every pair of a bucket. A bucket of n blocks is n^2 / 2 tasks' work, each of bounded size.

Defined results: texts without words are never linked, and each is its own class; texts equal up to case and white space are one
class; rows of one id are one document, so their classes are one; rows without an id join classes through their texts only; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, graph, shingles

BANDS, ROWS, THRESHOLD = 10, 3, 0.8
#: The share of samples that must agree before texts are compared: 16 of 30, where a pair at the threshold has 24 in the mean.
AGREE = 16 / 30
#: Members, and weight (words, mostly), of a bucket that are compared with as many others at once.
BLOCK, BLOCK_WEIGHT = 1024, 2_000_000


def fingerprints(docs: DataFrame, weights: shingles.Weights, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, digest (md5 of the text), node (fingerprint; null without words), keys array<bigint>,
    samples array<int>, total (weight)."""
    held = docs.sparkSession.sparkContext.broadcast((weights, shingles.Sampler(bands * rows)))
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.string()), ("node", pa.string()), ("keys", pa.list_(pa.int64())), ("samples", pa.list_(pa.int32())), ("total", pa.float64())])

    def run(batches):
        w, sampler = held.value
        for b in batches:
            nodes, keys, samples, totals = [], [], [], []
            for t in b.column(2).to_pylist():
                words = shingles.word_hashes(t)
                if not len(words):
                    nodes.append(None), keys.append([]), samples.append([]), totals.append(0.0)
                    continue
                nodes.append(hashlib.blake2b(b" ".join(shingles.normal(t).split()), digest_size=16).hexdigest())
                s, tf = np.unique(shingles.shingle_hashes(words), return_counts=True)
                weight = tf * w.of(s)
                found = sampler(s, weight)
                totals.append(float(weight.sum()))
                band = np.arange(1, bands + 1, dtype=np.uint64)
                for i in range(rows):
                    band = (band ^ found[i::rows]) * np.uint64(0x9E3779B97F4A7C15)
                    band ^= band >> np.uint64(32)
                keys.append(band.view(np.int64))
                samples.append((found >> np.uint64(32)).astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((b.column(0).to_pylist(), b.column(1).to_pylist(), nodes, keys, samples, totals), schema)], schema=schema)

    base = docs.select(F.col("doc_id").cast("long"), F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    return base.mapInArrow(run, "doc_id bigint, digest string, node string, keys array<bigint>, samples array<int>, total double")


def _runs(batches, columns: int):
    """Tables of the rows that agree in their first columns, from sorted batches."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        ids = [t.column(c).to_numpy() for c in range(columns)]
        cut = (np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1).tolist() if t.num_rows else []
        for a, z in zip([0, *cut], cut):
            yield t.slice(a, z - a)
        rest = t.slice(cut[-1]) if cut else t
    if rest is not None and rest.num_rows:
        yield rest


def _groups(linked: np.ndarray) -> list[np.ndarray]:
    """Connected components of two members or more of a symmetric matrix."""
    left, out = linked.any(axis=1), []
    while left.any():
        seen = np.zeros(len(linked), bool)
        front = np.flatnonzero(left)[:1]
        while len(front):
            seen[front] = True
            front = np.flatnonzero(linked[front].any(axis=0) & ~seen)
        left &= ~seen
        out.append(np.flatnonzero(seen))
    return out


def candidate_units(buckets: DataFrame, nodes: DataFrame, agree: float, threshold: float) -> DataFrame:
    """buckets(key, node), nodes(node, samples, total) -> unit, node: the components of candidates of every bucket, or of two blocks of one."""
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "node")).alias(f"mark{i}") for i in range(2)]
    filled = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("total").alias("weight"), *marks).filter("n > 1")
    # Buckets of the same members, as copies have them in many bands, are one.
    size = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / BLOCK_WEIGHT)).cast("int")
    chosen = filled.withColumn("blocks", size).groupBy("n", "mark0", "mark1").agg(F.min("key").alias("key"), F.max("blocks").alias("blocks")).select("key", "blocks")
    part = buckets.select("key", "node").join(chosen, "key").join(nodes.select("node", "samples", "total"), "node")
    part = part.withColumn("part", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    part = part.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = part.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "samples", "total")

    def units(t):
        m = t.num_rows
        samples = t.column(5).combine_chunks().flatten().to_numpy().reshape(m, -1)
        total, part = t.column(6).to_numpy(), t.column(3).to_numpy()
        same = np.zeros((m, m), np.uint16)
        for k in range(samples.shape[1]):
            same += samples[:, k, None] == samples[None, :, k]
        linked = (same >= agree * samples.shape[1] - 1e-9) & (np.minimum(total[:, None], total) >= (threshold - 1e-9) * np.maximum(total[:, None], total))
        if t.column(1)[0] != t.column(2)[0]:
            linked &= part[:, None] != part
        np.fill_diagonal(linked, False)
        node = t.column(4).to_pylist()
        for g in _groups(linked):
            names = sorted(node[x] for x in g)
            unit = hashlib.blake2b("".join(names).encode(), digest_size=16).hexdigest()
            for name in names:
                yield unit, name

    def run(batches):
        rows = []
        for t in _runs(batches, 3):
            if t.num_rows > 1:
                rows += units(t)
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["unit", "node"])
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["unit", "node"])

    return part.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "unit string, node string").distinct()


def similarities(bags: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarities of all pairs of bags (distinct shingles, counts, idf). A shingle that a text holds k times is k
    features, of one weight each, so what two texts share is the weight of their common features."""
    m = len(bags)
    keys, owner, weight = [], [], []
    for i, (s, tf, idf) in enumerate(bags):
        keys.append(s), weight.append(idf), owner.append(np.full(len(s), i))
        again = np.flatnonzero(tf > 1)
        if len(again):
            more = np.repeat(again, tf[again] - 1)
            first = np.concatenate(([0], np.cumsum(tf[again] - 1)[:-1]))
            level = np.arange(len(more)) - np.repeat(first, tf[again] - 1) + 1
            keys.append((s[more] + level.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)), weight.append(idf[more]), owner.append(np.full(len(more), i))
    total = np.array([float((tf * idf).sum()) for _, tf, idf in bags])
    keys, owner, weight = np.concatenate(keys), np.concatenate(owner), np.concatenate(weight)
    order = np.argsort(keys, kind="stable")
    keys, owner, weight = keys[order], owner[order], weight[order]
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    held_by = np.diff(np.concatenate((start, [len(keys)])))
    shared = np.zeros((m, m))
    for d in np.unique(held_by[held_by > 1]):
        first = start[held_by == d]
        if 8 * d < m or d == 2:  # few texts hold these: pair by pair
            who, w = owner[first[:, None] + np.arange(d)], weight[first]
            a, b = np.triu_indices(d, 1)
            for s in range(0, len(first), 1 + 4_000_000 // len(a)):
                some = who[s : s + 1 + 4_000_000 // len(a)]
                flat = some[:, a] * m + some[:, b]
                shared += np.bincount(flat.ravel(), np.repeat(w[s : s + len(some)], len(a)), m * m).reshape(m, m)
    common_keys = np.flatnonzero((8 * held_by >= m) & (held_by > 2))
    step = 1 + 4_000_000 // m
    pairs = np.zeros((m, m))
    for s in range(0, len(common_keys), step):
        some = common_keys[s : s + step]
        x = np.zeros((m, len(some)))
        column = np.repeat(np.arange(len(some)), held_by[some])
        at = np.repeat(start[some], held_by[some]) + np.arange(len(column)) - np.repeat(np.cumsum(held_by[some]) - held_by[some], held_by[some])
        x[owner[at], column] = 1.0
        pairs += (x * weight[start[some]]) @ x.T
    shared = shared + shared.T + pairs
    np.fill_diagonal(shared, total)
    return shared / (total[:, None] + total - shared)


def verified_links(units: DataFrame, texts: DataFrame, weights: shingles.Weights, threshold: float) -> DataFrame:
    """units(unit, node), texts(node, text) -> (u, v): stars that join what links of the threshold join."""
    held = units.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = held.value

        def bagged():
            """The batches with bags instead of texts, so that a unit's texts needn't be held."""
            for b in batches:
                names = [b.column(i).to_pylist() for i in (0, 1)]
                for unit, node, text in zip(*names, b.column(2)):
                    s, tf = np.unique(shingles.shingle_hashes(shingles.word_hashes(text.as_py())), return_counts=True)
                    yield unit, node, (s, tf, w.of(s))

        def links(members):
            linked = similarities([x[2] for x in members]) >= threshold - 1e-9
            np.fill_diagonal(linked, False)
            for g in _groups(linked):
                names = sorted(members[x][1] for x in g)
                yield from ((n, names[0]) for n in names[1:])

        rows, members = [], []
        for x in bagged():
            if members and members[0][0] != x[0]:
                rows += links(members)
                members = []
            members.append(x)
            if len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["u", "v"])
                rows = []
        if members:
            rows += links(members)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["u", "v"])

    return units.join(texts, "node").select("unit", "node", "text").repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "u string, v string")


def _named(docs: DataFrame, threshold: float, bands: int, rows: int, agree: float) -> DataFrame:
    """docs(doc_id, text) -> a row each, in the shared folder: doc_id, digest, class_id, class_size, n_texts, keeper (the least
    (doc_id, digest) of the class, rows without an id last)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    weights = shingles.fit(docs)
    with common.Scratch(docs.sparkSession) as keep:
        marked = keep(fingerprints(docs, weights, bands, rows), "fingerprints")
        nodes = marked.filter("node is not null").groupBy("node").agg(F.min("digest").alias("digest"), F.any_value("keys").alias("keys"), F.any_value("samples").alias("samples"), F.any_value("total").alias("total"))
        nodes = keep(nodes, "nodes")
        units = keep(candidate_units(nodes.select("node", "total", F.explode("keys").alias("key")), nodes, agree, threshold), "units")
        wanted = nodes.join(units.select("node").distinct(), "node", "left_semi").select("node", "digest")
        # Copies go before they are shuffled, one of each stays in a task: a text of very many copies fills no task.
        texts = docs.select(F.md5(F.col("text").cast("binary")).alias("digest"), "text").dropDuplicates(["digest"]).join(wanted, "digest").select("node", "text")
        links = verified_links(units, texts, weights, threshold)
        # Rows of one id are one document.
        by_id = marked.filter("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("v"), F.max("node").alias("hi")).filter("v <> hi").drop("hi")
        same_id = marked.join(by_id, "doc_id").filter("node <> v").select(F.col("node").alias("u"), "v")
        roots = graph.components(keep(links.unionByName(same_id).distinct(), "links"))

        own = marked.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("keeper"))
        own = own.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        sizes = own.groupBy("root").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.count(F.lit(1)).alias("n_texts"), F.min("keeper").alias("keeper"))
        named = own.select("node", "root").join(sizes, "root").drop("root")
        done = marked.select("doc_id", "digest", "node").join(named, "node", "left")
        return common.materialize(done.select(
            "doc_id", "digest", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"), F.coalesce("n_texts", F.lit(1)).cast("long").alias("n_texts"),
            F.struct(F.col("keeper.doc_id").alias("doc_id"), F.col("keeper.digest").alias("digest")).alias("keeper"), F.col("node").isNull().alias("empty"),
        ), "classes")


def classes(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, agree: float = AGREE) -> DataFrame:
    """docs(doc_id, text) -> one row each: doc_id, class_id (the least doc_id of its class), class_size (rows of the class),
    n_texts (different texts in it)."""
    return _named(docs, threshold, bands, rows, agree).drop("digest", "keeper", "empty")


def deduplicate(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, agree: float = AGREE) -> DataFrame:
    """One row of every class, that of the least id (rows without an id come last, then by the md5 of the text); all columns stay.
    Rows without words are classes of their own and all stay. Columns of any name may stand in docs."""
    found = _named(docs, threshold, bands, rows, agree)
    first = found.filter("not empty and doc_id <=> keeper.doc_id and digest = keeper.digest").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n"))
    row, key = "row_" + "_".join(docs.columns), "key_" + "_".join(docs.columns)  # no names of docs
    text = F.col(f"{row}.text").cast("binary")
    packed = docs.select(F.struct(*docs.columns).alias(row)).withColumn(key, F.struct(F.col(f"{row}.doc_id").cast("long").alias("doc_id"), F.md5(text).alias("digest")))
    matched = packed.join(first.select(F.struct("doc_id", "digest").alias("of"), "n"), F.col(key).eqNullSafe(F.col("of")))
    kept = matched.filter("n = 1").select(f"{row}.*").unionByName(matched.filter("n > 1").dropDuplicates([key]).select(f"{row}.*"))
    return kept.unionByName(docs.filter(F.coalesce(common.words_in(F.col("text")), F.lit(0)) == 0))
