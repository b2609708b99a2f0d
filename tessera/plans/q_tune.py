"""Queries of the folds (chunking, refinement) and of the parameter search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunkers, evaluate, profile, refine, tune
from .catalog import register
from .q_evaluate import as_articles, joined_articles
from .q_profile import docs
from .q_signals import lists


def typed(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "text", profile.doc_type(F.col("text")).alias("type"))


def _strategy(name: str):
    @register(f"chunks_{name}")
    def query(spark, sf_dir):
        # The documents have no articles; the legal strategies run over their texts as articles.
        source = joined_articles(as_articles(spark, sf_dir)).withColumn("type", F.lit("prose")) if "legal" in name else typed(spark, sf_dir)
        return chunkers.chunk(source, (name,))

    return query


for _name in chunkers.STRATEGIES:
    _strategy(_name)


@register("strategy_winner")
def strategy_winner(spark, sf_dir):
    """The best strategy of every document by quality and its type's preference."""
    return evaluate.winners_of_documents(typed(spark, sf_dir), chunkers.PREFERENCE, chunkers.STRATEGIES, 80, 500)


@register("strategy_rank_all")
def strategy_rank_all(spark, sf_dir):
    """All chunkers ranked by the S2 score, with the chunks' own offsets."""
    return evaluate.rank_of_documents(typed(spark, sf_dir), chunkers.STRATEGIES)


@register("refined_chunks")
def refined_chunks(spark, sf_dir):
    return refine.refine(lists(spark, sf_dir).withColumn("strategy", F.lit("sliding_window")))


@register("merged_chunks")
def merged_chunks(spark, sf_dir):
    return refine.merge(lists(spark, sf_dir).withColumn("strategy", F.lit("sliding_window")))


@register("parameter_search")
def parameter_search(spark, sf_dir):
    """Trials of every tunable strategy; fitness is the mean reward after refinement and merging."""
    return tune.search(typed(spark, sf_dir))


# Seven numbers in [0, 1) from a document's id.
def _gene(d: int) -> str:
    return f"(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || '{d}'), 1, 6) AS BIGINT) / 16777216.0::DOUBLE)"


def _sql_gene(d: int) -> str:
    name, lo, hi, step = tune.GENES[d]
    value = f"({lo}::DOUBLE + {_gene(d)} * {hi - lo}::DOUBLE)"
    return f"least(greatest({f'round_even({value} / {step}::DOUBLE, 0) * {step}::DOUBLE' if step else value}, {lo}::DOUBLE), {hi}::DOUBLE) AS g{d}"


@register("gene_decode", f"""SELECT doc_id, g0 AS n_max, CASE WHEN g1 >= g0 - 50 THEN greatest(30.0::DOUBLE, g0 - 50) ELSE g1 END AS n_min, g2 AS tau_jsd_low,
  CASE WHEN g2 >= g3 - 0.08::DOUBLE THEN least(0.80::DOUBLE, g2 + 0.10::DOUBLE) ELSE g3 END AS tau_jsd_high, g4 AS tau_sem, g5 AS tau_percentile_low, g6 AS tau_percentile_high
FROM (SELECT doc_id, {', '.join(_sql_gene(d) for d in range(7))} FROM documents)""")
def gene_decode(spark, sf_dir):
    digits = [F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(str(d)))), 1, 6), 16, 10).cast("double") / 16777216.0 for d in range(7)]
    return docs(spark, sf_dir).select("doc_id", F.array(*digits).alias("genes")).select("doc_id", *[c.alias(n) for n, c in tune.decode(F.col("genes")).items()])
