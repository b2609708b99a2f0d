"""Plug-in points for models: embeddings, perplexity, cross-encoders, entity recognition.

A model is a function from a list of texts (or of pairs) to a list of results. It is called by Arrow batch on the executors; `load`
makes it there once for every worker, so nothing large is sent. Where a model fails or is absent, the results are null and the
expressions that read them fall back to the lexical ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import embed, graph

DIM, SEED = 256, 42
# Weights of the models in an ensemble; others weigh 1.
MODEL_WEIGHTS = {"mxbai-embed-large": 3.0, "e5-large-v2": 3.0, "all-mpnet-base-v2": 2.0, "jina-embeddings-v2-base-en": 2.0, "all-MiniLM-L6-v2": 1.0, "bow_fallback": 0.5}


def apply(df: DataFrame, inputs: tuple[str, ...], load, result: str, kind: pa.DataType, ddl: str) -> DataFrame:
    """df with a column `result`: what the model made by load() returns for the inputs' texts (tuples, if there are several)."""
    held: dict[str, object] = {}

    def run(batches):
        if "model" not in held:
            held["model"] = load()
        for b in batches:
            columns = [b.column(b.schema.get_field_index(c)).to_pylist() for c in inputs]
            texts = columns[0] if len(columns) == 1 else list(zip(*columns))
            found = held["model"](texts) if texts else []
            values = [None if x is None else np.asarray(x, float).tolist() if isinstance(x, np.ndarray) else x for x in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, kind)], names=[*b.schema.names, result])

    base = df.drop(result)
    return base.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema) + f", `{result}` {ddl}")


def project(vector: np.ndarray, dim: int = DIM, seed: int = SEED) -> np.ndarray:
    """Into dim dimensions by a seeded Gaussian matrix, the same for every model; vectors of dim dimensions stay as they are."""
    vector = np.asarray(vector, np.float32)
    if vector.shape[-1] == dim:
        return vector
    return vector @ np.random.default_rng(seed).normal(0, 1.0 / np.sqrt(dim), size=(vector.shape[-1], dim)).astype(np.float32)


def embeddings(texts: DataFrame, encoders: dict[str, object], dim: int = DIM) -> DataFrame:
    """texts(doc_id, idx, input) -> doc_id, idx, vector, models: the weighted mean of the models' projected vectors; encoders are
    load functions by name. Texts for which no model answers get their bag of words."""
    def load():
        models = {}
        for name, make in encoders.items():
            try:
                models[name] = make()
            except Exception:  # a model that isn't there is left out
                continue

        def encode(batch):
            total, weight = np.zeros((len(batch), dim), np.float32), 0.0
            for name, model in models.items():
                w = MODEL_WEIGHTS.get(name, 1.0)
                total += w * project(np.stack([np.asarray(v, np.float32) for v in model(batch)]), dim)
                weight += w
            return list(total / weight) if weight else [None] * len(batch)

        return encode

    found = apply(texts.select("doc_id", "idx", F.coalesce("input", F.lit("")).alias("input")), ("input",), load, "vector", pa.list_(pa.float64()), "array<double>")
    bags = embed.dense(texts.select("doc_id", "idx", F.col("input").alias("text")), dim).withColumnRenamed("vector", "bag")
    joined = found.join(bags, ["doc_id", "idx"], "left")
    names = F.when(F.col("vector").isNull(), F.array(F.lit("bow_fallback"))).otherwise(F.array(*[F.lit(n) for n in encoders]).cast("array<string>"))
    return joined.select("doc_id", "idx", F.coalesce("vector", "bag").alias("vector"), names.alias("models"))


def cache_key(model: str, text: Column) -> Column:
    return F.sha2(F.concat_ws("||", F.lit(model), text), 256)


def cached(texts: DataFrame, model: str, load, path: str) -> DataFrame:
    """texts(input, ...) with vector. Vectors that the cache table at `path` lacks are made, once for equal texts, and appended to it."""
    spark, keyed = texts.sparkSession, texts.withColumn("cache_key", cache_key(model, F.col("input")))
    try:
        known = spark.read.schema("cache_key string, vector array<double>").parquet(path)
        known.isEmpty()
    except AnalysisException:
        known = spark.createDataFrame([], "cache_key string, vector array<double>")
    missing = keyed.select("cache_key", "input").dropDuplicates(["cache_key"]).join(known.select("cache_key"), "cache_key", "left_anti")
    fresh = apply(missing, ("input",), load, "vector", pa.list_(pa.float64()), "array<double>").filter("vector is not null").select("cache_key", "vector")
    fresh.write.mode("append").parquet(path)
    every = spark.read.schema("cache_key string, vector array<double>").parquet(path).dropDuplicates(["cache_key"])
    return keyed.join(every, "cache_key", "left").drop("cache_key")


def perplexities(pairs: DataFrame, load) -> DataFrame:
    """pairs(text, text_b, ...) with ppl_a, ppl_b and ppl_both of the texts and of both together; null below five words."""
    joined = pairs.withColumn("both", F.concat("text", F.lit("\n\n"), "text_b"))
    for source, name in (("text", "ppl_a"), ("text_b", "ppl_b"), ("both", "ppl_both")):
        joined = apply(joined, (source,), load, name, pa.float64(), "double")
        joined = joined.withColumn(name, F.when(F.size(F.split(F.trim(source), r"\s+")) >= 5, F.least(F.greatest(F.col(name), F.lit(1.0)), F.lit(10_000.0))))
    return joined.drop("both")


def cross_scores(pairs: DataFrame, load, most: int = 800) -> DataFrame:
    """pairs(text, text_b, ...) with cross_score: the model's for the first characters of both texts, as the method reads them."""
    cut = pairs.withColumns({"cut_a": F.substr("text", F.lit(1), F.lit(most)), "cut_b": F.substr("text_b", F.lit(1), F.lit(most))})
    return apply(cut, ("cut_a", "cut_b"), load, "cross_score", pa.float64(), "double").drop("cut_a", "cut_b")


def entities(chunks: DataFrame, load, most: int = 40, chars: int = 10_000) -> DataFrame:
    """chunks(doc_id, idx, text) -> the columns of graph.entities, by a model that gives (text, label) pairs for the first characters."""
    base = chunks.select("doc_id", "idx", F.substr("text", F.lit(1), F.lit(chars)).alias("text"))
    kind = pa.list_(pa.struct([("text", pa.string()), ("label", pa.string())]))
    wrapped = lambda: (lambda model: lambda texts: [[{"text": t, "label": k} for t, k in found] for found in model(texts)])(load())
    found = apply(base, ("text",), wrapped, "found", kind, "array<struct<text:string,label:string>>")
    rows = found.select("doc_id", "idx", F.posexplode(F.slice("found", 1, most)).alias("pos", "e"))
    return graph.canonical(rows.select("doc_id", "idx", (F.col("pos") + 1).cast("long").alias("pos"), "e.text", "e.label"))
