"""Toxicity of whole texts: every overlapping window is scored by a bidirectional recurrent network, a text by its worst windows.

Learning uses a bounded sample of labelled documents: of each label the `SAMPLE` with the smallest hashes, with all of their
windows. The model (some 1.6 MB) is trained by the driver and sent to the executors. Scoring covers every window of every text and
moves no data.

Defined results: an id with both labels is toxic; of the texts of a repeated id the least one teaches; null and empty texts, and all texts where no label of both kinds is known, score the share of toxic labels;
repeated rows and ids score alike; an empty table gives an empty result; columns named like the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import bigru

SAMPLE = 1200
TOKENS_AT_ONCE, WINDOWS_AT_ONCE = 400_000, 2048


def text_windows(text: str | None) -> list[str]:
    words = [bigru.normalize(w) for w in text.split()] if text else []
    return [" ".join(words[s : s + bigru.WINDOW]) for s in bigru.windows(len(words))]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bigru.BiGRU:
    """labels(doc_id, toxic): those that may be learned from."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("_h", F.xxhash64(F.lit(17), F.col("doc_id")))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    picked = [r for y in (0, 1) for r in known.filter(F.col("toxic") == y).orderBy("_h", "doc_id").limit(sample).collect()]
    if not picked:
        return bigru.fit([], 0.0)
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in picked], "doc_id bigint, toxic int")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))

    def cut(batches):
        for b in batches:
            ids, text, toxic = (c.to_pylist() for c in b.columns)
            parts = [text_windows(t) for t in text]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.list_(pa.string())), pa.array(toxic, pa.int32())], names=["doc_id", "parts", "toxic"])

    rows = texts.mapInArrow(cut, "doc_id bigint, parts array<string>, toxic int").collect()
    return bigru.fit([(r.parts, r.toxic) for r in sorted(rows, key=lambda r: (r.doc_id, r.parts)) if r.parts and r.parts[0]], share)


def score_texts(net: bigru.BiGRU, texts: list[str | None]) -> np.ndarray:
    """Probabilities of the texts; the words of many texts are looked up together."""
    out = np.full(len(texts), net.prior)
    s = 0
    while s < len(texts):
        number: dict[str, int] = {}
        ids, sizes, e = [], [], s
        while e < len(texts) and len(ids) < TOKENS_AT_ONCE:
            words = texts[e].split() if texts[e] else []
            ids += [number.setdefault(w, len(number)) for w in words]
            sizes.append(len(words))
            e += 1
        if ids:
            out[s:e] = _score(net, list(number), np.array(ids), np.array(sizes))
        s = e
    return out


def _score(net, names, ids, sizes):
    known: dict[str, int] = {}
    same = np.array([known.setdefault(bigru.normalize(w), len(known)) for w in names])
    ids, proj, W = same[ids], net.projections(list(known)), bigru.WINDOW
    at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    long, short = np.flatnonzero(sizes >= W), np.flatnonzero((sizes > 0) & (sizes < W))
    starts = [bigru.windows(n) for n in sizes[long]]
    owner = np.repeat(long, [len(x) for x in starts]) if len(long) else long
    first = np.concatenate([x + at[k] for x, k in zip(starts, long)]) if len(long) else long
    owners, logits = [owner, short], []
    for b in range(0, len(first), WINDOWS_AT_ONCE):
        logits.append(net.logits(proj, ids[first[b : b + WINDOWS_AT_ONCE, None] + np.arange(W)], None))
    for b in range(0, len(short), WINDOWS_AT_ONCE):
        k = short[b : b + WINDOWS_AT_ONCE]
        mask = np.arange(W) < sizes[k][:, None]
        logits.append(net.logits(proj, ids[np.minimum(at[k][:, None] + np.arange(W), len(ids) - 1)], mask))
    x = bigru.summary(np.concatenate(owners), np.concatenate(logits), len(sizes))
    return np.where(sizes > 0, 1 / (1 + np.exp(-np.clip(x @ net.head, -30, 30))), net.prior)


def score(docs: DataFrame, net: bigru.BiGRU, least: float | None = None) -> DataFrame:
    """docs(text, ...) with score added; with `least`, only the documents that score below it, without the score."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    base = docs.drop("score") if least is None else docs
    out = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())]) if least is None else base.schema
    schema, at = to_arrow_schema(out), base.columns.index("text")

    def run(batches):
        for b in batches:
            found = score_texts(held.value, b.column(at).to_pylist())
            columns = [x.cast(schema.field(i).type) for i, x in enumerate(b.columns)]
            if least is None:
                yield pa.RecordBatch.from_arrays([*columns, pa.array(found)], schema=schema)
            else:
                yield pa.RecordBatch.from_arrays(columns, schema=schema).filter(pa.array(found < least))

    return base.mapInArrow(run, out)
