"""Lexical boundary scores between neighbouring chunks (S4), coherence inside chunks.

Pair scores are column expressions over two texts; what is scored of whole chunk lists is measured where their document is (`measures`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import measures

# Weights of the composite score.
WEIGHTS = {"bleu": 0.25, "syntactic": 0.20, "token_type": 0.15, "structural": 0.20, "semantic": 0.20}
# Structural patterns of prose.
ARTICLE = r"(?imud)^\s*(?:ARTICLE|Art\.?|CHAPITRE|TITRE|SECTION)\s+[\p{L}\p{N}_]+"
NUMBERED = r"(?md)^\s*\d+\)\s"
CAPITALS = r"(?md)^[A-ZÉÀÈÙÂÊÎÔÛŒÆ][A-ZÉÀÈÙÂÊÎÔÛŒÆ\s]{4,}$"


def overlap_counts(a: Column, b: Column) -> Column:
    """Clipped count: for every distinct element of a, the lesser of its counts in a and b. Pass columns."""
    times = lambda v, d: F.size(F.filter(v, lambda e: e == d))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, d: s + F.least(times(a, d), times(b, d)))


def bigrams(toks: Column) -> Column:
    n = F.size(toks) - 1
    return F.when(n > 0, F.zip_with(F.slice(toks, 1, F.greatest(n, F.lit(0))), F.slice(toks, 2, F.greatest(n, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))).otherwise(F.array().cast("array<string>"))


def prepared(pairs: DataFrame) -> DataFrame:
    """pairs(text, text_b, ...) with the token arrays that the scores read: ta, tb, bigrams ga, gb, function words fa, fb."""
    words = list(dict.fromkeys(tx.FUNCTION_WORDS))
    step = pairs.withColumns({"ta": tx.tokens(F.col("text")), "tb": tx.tokens(F.col("text_b"))})
    return step.withColumns({
        "ga": bigrams(F.col("ta")), "gb": bigrams(F.col("tb")),
        "fa": F.filter("ta", lambda t: t.isin(*words)), "fb": F.filter("tb", lambda t: t.isin(*words)),
    })


def ngram_precision() -> Column:
    """Share of left bigrams that the right chunk covers; token Jaccard where a side has no bigram."""
    jac = tx.jaccard(F.array_distinct("ta"), F.array_distinct("tb"))
    return F.when((F.size("ta") < 2) | (F.size("tb") < 2), jac).otherwise(overlap_counts(F.col("ga"), F.col("gb")) / F.size("ga"))


def syntactic_overlap() -> Column:
    total = F.greatest(F.size("fa"), F.size("fb"))
    return F.when(total > 0, overlap_counts(F.col("fa"), F.col("fb")) / total).otherwise(0.0)


# Tokens of code.
CODE_TOKEN = r"[+\-*/%&|^~<>=!;:,.()\[\]{}]|[\p{L}\p{N}_]+"


def code_tokens(text: Column) -> Column:
    """Distinct words and operators."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(CODE_TOKEN), F.lit(0)))


def operator_overlap(a: Column, b: Column) -> Column:
    return tx.jaccard(code_tokens(a), code_tokens(b))


def token_types() -> Column:
    return tx.jaccard(F.array_distinct("ta"), F.array_distinct("tb"))


def lexical() -> Column:
    return 0.4 * ngram_precision() + 0.3 * syntactic_overlap() + 0.3 * token_types()


def structural_prose(a: Column, b: Column) -> Column:
    opening = F.substr(b, F.lit(1), F.lit(200))
    strength = F.when(opening.rlike(ARTICLE), 0.05).when(opening.rlike(CAPITALS), 0.10).when(opening.rlike(NUMBERED), 0.25).otherwise(0.50)
    article_a, article_b = a.rlike(ARTICLE), b.rlike(ARTICLE)
    same = F.when(article_a & article_b, 0.20).when(a.rlike(NUMBERED) & b.rlike(NUMBERED) & ~article_b, 0.65).when(~article_a & ~article_b, 0.55).otherwise(0.30)
    return tx.clip(0.60 * strength + 0.40 * same)


def structural_code(a: Column, b: Column) -> Column:
    off = lambda t: F.abs(tx.count_chars(t, "{") - tx.count_chars(t, "}"))
    heading = F.when(b.rlike(r"(?md)^#{1,6}\s"), 1.0).otherwise(0.6)
    markup = F.when(a.contains("<") & a.contains(">") & b.contains("<") & b.contains(">"), 0.8).otherwise(0.4)
    return tx.clip((1.0 - F.least(F.lit(1.0), (off(a) + off(b)) / 6.0) + heading + markup) / 3.0)


def multiscale(chunks: DataFrame, scales: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(doc_id, idx, multiscale) of the boundary on the left of every chunk but the first: the mean lexical score of the texts of
    one, two and three chunks on either side."""
    return measures.measure(chunks, ("multiscale",), "before", scales=scales)


PARTS = ("bleu", "syntactic", "token_type", "structural", "semantic", "multiscale")


def scores(chunks: DataFrame, merge_weight: float = 1.0, dim: int = 128) -> DataFrame:
    """The composite score and its parts, of the boundary on the left of every chunk but a document's first. Chunks of a type (code,
    table, mixed, prose; prose without that column) are held against each other as such."""
    found = measures.measure(chunks, (*PARTS, "boundary_score"), "before", wide=dim)
    return found.withColumn("boundary_score", tx.clip(F.col("boundary_score") * merge_weight))


def coherence(chunks: DataFrame) -> DataFrame:
    """(doc_id, idx, icc): mean Jaccard similarity of a chunk's successive units; 0.5 with fewer than two. Units are numbered paragraphs,
    else paragraphs, else sentences, of four words or more."""
    return measures.measure(chunks, ("icc",))


def semantic_score(pair: Column, embedding_cosine: Column | None = None, cross_encoder: Column | None = None) -> Column:
    """The first that is known: the embeddings' cosine, a cross-encoder's score s as (s + 1) / 2, the bags' cosine."""
    known = [c for c in (embedding_cosine, None if cross_encoder is None else (cross_encoder + 1.0) / 2.0) if c is not None]
    return tx.clip(F.coalesce(*known, pair))


def allowed_merge(left: Column, right: Column, both: Column, threshold: float = 1.1) -> Column:
    """Whether perplexities allow a merge: the joined text's is below the greater one's, times the threshold; true where they are unknown."""
    most = F.greatest(left, right)
    return F.coalesce(F.when(most > 0, both < most * threshold), F.lit(True))
