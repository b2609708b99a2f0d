"""Token counts: an exact histogram of encoded lengths, and what its suffix sums answer.

Every document is encoded with a public byte-level BPE vocabulary; the corpus is reduced to the number of documents for each
length (partial sums before the shuffle). Over the histogram, prefix and suffix sums give, for every length L that occurs, as a
context limit: documents and tokens at most and at least as long, the tokens left when every document is truncated at L, and the
share of documents that fit. Every limit between two lengths is answered from the rows around it, and quantiles from the counts.

The sums are made in two steps, within blocks of `BLOCK` lengths and over the blocks' totals, so no task sorts all lengths.

Defined results: null and empty texts have length 0; special tokens' strings in a text are ordinary text; repeated rows count each;
an empty table gives an empty result; other columns are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Where the public tokenizer's ranks lie; a parameter of every function that encodes.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
BLOCK = 1024


def encoder(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("lengths", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document: length bigint."""
    with open(vocabulary, "rb") as f:  # read by the driver, sent once to every executor: under 1 MB
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        encode = encoder(held.value).encode_ordinary
        for b in batches:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())], names=["length"])

    return docs.select("text").mapInArrow(run, "length bigint")


def histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    return token_lengths(docs, vocabulary).groupBy("length").agg(F.count(F.lit(1)).alias("n_docs"))


def with_sums(hist: DataFrame) -> DataFrame:
    """hist(length, n_docs) -> length, n_docs, tokens, docs_at_most, tokens_at_most, docs_at_least, tokens_at_least,
    truncated_tokens (total if documents are cut at length), share_at_most."""
    hist = common.materialize(hist, "lengths")  # read twice below, made once
    hist = hist.withColumn("tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK).cast("long"))
    inside = Window.partitionBy("block").orderBy("length")
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("bd").over(before), F.lit(0)).alias("d0"), F.coalesce(F.sum("bt").over(before), F.lit(0)).alias("t0"),
        F.sum("bd").over(whole).alias("d_all"), F.sum("bt").over(whole).alias("t_all"),
    )
    summed = hist.withColumns({"d": F.sum("n_docs").over(inside), "t": F.sum("tokens").over(inside)}).join(blocks, "block")
    docs, tokens = F.col("d0") + F.col("d"), F.col("t0") + F.col("t")
    return summed.select(
        "length", "n_docs", "tokens", docs.alias("docs_at_most"), tokens.alias("tokens_at_most"),
        (F.col("d_all") - docs + F.col("n_docs")).alias("docs_at_least"), (F.col("t_all") - tokens + F.col("tokens")).alias("tokens_at_least"),
        (tokens + (F.col("d_all") - docs) * F.col("length")).alias("truncated_tokens"), (docs / F.col("d_all")).alias("share_at_most"),
    )


def truncated_total(sums: DataFrame, limits) -> DataFrame:
    """Tokens of the corpus when documents are cut at each of the limits: from the last row at or below the limit."""
    spark: SparkSession = sums.sparkSession
    asked = spark.createDataFrame([(int(x),) for x in limits], "context_limit bigint")
    below = sums.join(F.broadcast(asked), F.col("length") <= F.col("context_limit")).groupBy("context_limit").agg(F.max(F.struct("length", "tokens_at_most", "docs_at_most")).alias("r"))
    total = sums.agg(F.sum("n_docs").alias("d_all"))
    return asked.join(below, "context_limit", "left").crossJoin(total).select(
        "context_limit",
        (F.coalesce("r.tokens_at_most", F.lit(0)) + (F.coalesce("d_all", F.lit(0)) - F.coalesce("r.docs_at_most", F.lit(0))) * F.col("context_limit")).alias("truncated_tokens"),
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """The smallest length that at least a share q of the documents doesn't exceed."""
    return sums.filter(F.col("share_at_most") >= q).agg(F.min("length").alias("length"))
