"""Evaluation of chunk sets (S2 and S8): size fit, spans, boundaries, cohesion, separation, strategy scores and ranks.

chunks(doc_id, strategy, idx, text, start, end); every aggregate is per (doc_id, strategy).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators.profile import is_heading
from . import measures

KEY = ("doc_id", "strategy")

# Stop words of the distinctness and separation scores.
STOP_DISTINCT = "the and for that with from this dans pour avec des les une sur par aux que est article titre chapitre section".split()
STOP_SEPARATION = "the a an and or but is are was were in on at to for of with by from as le la les de des du et en un une".split()


# Lines that begin a unit of a document, and how far from one a chunk may begin.
ANCHOR = (
    r"^\s*(?:(?:article|art\.?)\s+\d+(?:\s*(?:er|e|ème|bis|ter|quater))?"
    r"|(?:titre|chapitre|section|sous-section|paragraphe)\s+(?:[ivxlcdm]+|\d+|premier|première)"
    r"|#{1,6}\s+\S+|\d+(?:\.\d+){1,3}\s+\S+)"
)
TOLERANCE, UNIT_WORDS = 80, 420
# What legal strategies gain when a winner is picked.
LEGAL_BIAS = {"legal_articles": 0.06, "hybrid_legal_semantic": 0.10}


def order():
    return Window.partitionBy(*KEY).orderBy("idx")


def starts_well(text: Column) -> Column:
    return text.rlike(r"^(?:\p{Lu}|\d)")


def ends_well(text: Column) -> Column:
    return text.rlike(r"[.!?:;}\]`]$")


def boundary_quality(chunks: DataFrame) -> DataFrame:
    """0.55 for a start with a capital or digit, 0.45 for a closed end or fewer than 30 words; empty chunks count half."""
    t = tx.strip(F.col("text"))
    n = tx.n_words(t)
    each = F.when(n == 0, 0.5).otherwise(0.55 * starts_well(t).cast("double") + 0.45 * (ends_well(t) | (n < 30)).cast("double"))
    return chunks.groupBy(*KEY).agg(F.avg(each).alias("boundary_quality"))


def units(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, n_words) of every unit, from its anchor to the next one or the text's end. Spark tells no match's place, so a
    mark is put before every anchor; the lengths between marks give the places."""
    text = F.translate(F.coalesce("text", F.lit("")), "\x01", " ")
    parts = F.split(F.regexp_replace(text, F.lit("(?imud)" + ANCHOR), F.lit("\x01$0")), "\x01", -1)
    placed = docs.select("doc_id", F.posexplode(parts).alias("k", "part")).withColumn("n", F.length("part"))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    found = placed.withColumn("start", F.coalesce(before, F.lit(0)).cast("long")).filter("k > 0")
    return found.select("doc_id", "start", (F.col("start") + F.col("n")).alias("end"), F.greatest(tx.n_words(F.col("part")), F.lit(1)).alias("n_words"))


def structure_integrity(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """0.62 times the share of units that a chunk begins at, plus 0.38 times how rarely chunks begin inside units; boundary quality for
    texts without units. A document's starts are one array, which its units are held against."""
    starts = chunks.groupBy(*KEY).agg(F.collect_list(F.greatest(F.coalesce("start", F.lit(0)), F.lit(0)).cast("long")).alias("starts"))
    each = units(docs).join(starts, "doc_id")
    a, b = F.col("start"), F.col("end")
    inside = F.size(F.filter("starts", lambda s: (s > a + TOLERANCE) & (s < b - TOLERANCE)))
    expected = F.greatest(F.lit(1.0), F.bround(F.col("n_words") / float(UNIT_WORDS)))
    whole = 1.0 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), inside - expected) / expected)
    aligned = F.exists("starts", lambda s: F.abs(s - a) <= TOLERANCE).cast("double")
    found = each.groupBy(*KEY).agg(tx.clip(0.62 * F.avg(aligned) + 0.38 * F.avg(whole)).alias("found"))
    joined = boundary_quality(chunks).join(found, list(KEY), "left")
    return joined.select(*KEY, F.coalesce("found", "boundary_quality").alias("structure_integrity"))


def spans(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """coverage: spans' length over the text's, at most 1. non_redundancy: 1 minus the share of spans that earlier spans cover."""
    by_start = Window.partitionBy(*KEY).orderBy("start", "end")
    seen = F.coalesce(F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = chunks.withColumn("again", F.greatest(F.least(F.col("end"), seen) - F.col("start"), F.lit(0))).withColumn("span", F.greatest(F.col("end") - F.col("start"), F.lit(0)))
    sums = each.groupBy(*KEY).agg(F.sum("span").alias("total"), F.sum("again").alias("again"))
    sized = sums.join(docs.select("doc_id", F.length("text").alias("n_chars")), "doc_id")
    return sized.select(*KEY, F.least(F.lit(1.0), F.col("total") / F.col("n_chars")).alias("coverage"), (1.0 - F.least(F.lit(1.0), F.col("again") / F.greatest("total", F.lit(1)))).alias("non_redundancy"))


def distinctness(chunks: DataFrame) -> DataFrame:
    """1 minus the mean overlap coefficient of neighbours' content sets; 0.7 for a pair with an empty one, 1 for a single chunk."""
    kept = F.array_distinct(F.filter(tx.tokens(F.col("text"), 3), lambda t: ~t.isin(*STOP_DISTINCT) & ~t.rlike(r"^\p{N}+$")))
    pairs = chunks.select(*KEY, "idx", kept.alias("a")).withColumn("b", F.lead("a").over(order()))
    n = F.least(F.size("a"), F.size("b"))
    value = F.when(n == 0, 0.7).otherwise(1.0 - F.size(F.array_intersect("a", "b")) / n)
    return pairs.groupBy(*KEY).agg(F.coalesce(F.avg(F.when(F.col("b").isNotNull(), value)), F.lit(1.0)).alias("distinctness"))


def cohesion(chunks: DataFrame) -> DataFrame:
    """Mean over chunks of the mean Jaccard similarity of successive sentences; 0.55 for a chunk of one sentence."""
    parts = F.filter(F.transform(F.split("text", r"(?U)(?<=[.!?\n])\s+"), tx.strip), lambda x: x != "")
    placed = chunks.select(*KEY, "idx", F.posexplode_outer(parts).alias("pos", "s")).withColumn("a", F.array_distinct(tx.tokens(F.coalesce("s", F.lit("")))))
    pairs = placed.withColumn("b", F.lead("a").over(Window.partitionBy(*KEY, "idx").orderBy("pos")))
    value = F.when(F.col("b").isNotNull() & (F.size(F.array_union("a", "b")) > 0), tx.jaccard(F.col("a"), F.col("b")))
    each = pairs.groupBy(*KEY, "idx").agg(F.coalesce(F.avg(value), F.lit(0.55)).alias("c"))
    return each.groupBy(*KEY).agg(F.avg("c").alias("cohesion"))


def separation(chunks: DataFrame, dim: int = 128, stop=tuple(STOP_SEPARATION)) -> DataFrame:
    """Mean of 1 minus the cosine of neighbours' bags over buckets; 0.5 without a pair. chunks may be packed."""
    from . import scoring

    unwanted = frozenset(stop)
    rows = measures.pack(chunks, KEY)
    return measures.by_document(rows, (*KEY, "texts"), "doc_id bigint, strategy string, separation double", lambda doc_id, strategy, texts: [(doc_id, strategy, scoring.separation(list(map(measures.tokens, texts)), dim, unwanted))] if texts else [])


def sizes(chunks: DataFrame, n_min: int, n_max: int, share: float = 0.72) -> DataFrame:
    """Counts and fits of chunk sizes: n_chunks, mean_words, sd_words, in_range, avg_fit, oversize, tiny."""
    n = F.greatest(tx.n_words(F.col("text")), F.lit(1)).cast("double")
    target = max(float(n_min), float(n_max) * share)
    found = chunks.select(*KEY, n.alias("n")).groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.avg("n").alias("mean_words"), F.stddev_pop("n").alias("sd_words"),
        F.avg(F.col("n").between(n_min, n_max).cast("double")).alias("in_range"),
        F.avg(F.greatest(F.lit(0.0), (F.col("n") - n_max) / n_max)).alias("oversize"), F.avg(F.greatest(F.lit(0.0), (n_min - F.col("n")) / n_min)).alias("tiny"),
    )
    return found.withColumn("avg_fit", 1.0 - F.least(F.lit(1.0), F.abs(F.col("mean_words") - target) / target))


def quality(chunks: DataFrame, n_min: int = 100, n_max: int = 500) -> DataFrame:
    """The strategy quality that picks a winner (and is the tuner's fitness)."""
    sets = F.array_distinct(tx.content_tokens(F.col("text"), tx.STOP_CHUNKS))
    pairs = chunks.select(*KEY, "idx", sets.alias("a")).withColumn("b", F.lead("a").over(order()))
    div = pairs.groupBy(*KEY).agg(F.coalesce(F.avg(F.when(F.col("b").isNotNull(), 1.0 - tx.jaccard(F.col("a"), F.col("b")))), F.lit(0.5)).alias("divergence"))
    t = tx.strip(F.col("text"))
    first = F.coalesce(F.element_at(tx.lines(t), 1), F.lit(""))
    marks = chunks.groupBy(*KEY).agg(F.avg((is_heading(first) | starts_well(first)).cast("double")).alias("integrity"), F.avg(((t == "") | t.rlike(r"(?:[.!?:;}\]]|```)$")).cast("double")).alias("completion"))
    joined = sizes(chunks, n_min, n_max).join(div, list(KEY)).join(marks, list(KEY))
    stability = 1.0 - F.least(F.lit(1.0), F.col("sd_words") / F.greatest("mean_words", F.lit(1.0)))
    score = 0.24 * F.col("avg_fit") + 0.18 * stability + 0.18 * F.col("in_range") + 0.17 * F.col("divergence") + 0.13 * F.col("integrity") + 0.10 * F.col("completion")
    return joined.select(*KEY, "n_chunks", score.alias("quality"))


def candidate_scores(chunks: DataFrame, docs: DataFrame, n_min: int = 100, n_max: int = 500) -> DataFrame:
    """The S2 score of every strategy, without wall-clock time, ranked within the document."""
    total = docs.select("doc_id", F.greatest(tx.n_words(F.col("text")), F.lit(1)).alias("total_words"))
    j = sizes(chunks, n_min, n_max).join(total, "doc_id")
    for part in (boundary_quality(chunks), structure_integrity(chunks, docs), spans(chunks, docs), distinctness(chunks), cohesion(chunks)):
        j = j.join(part, list(KEY))
    target = max(float(n_min), min(float(n_max), float(n_max) * 0.72))
    expected = F.greatest(F.lit(1.0), F.col("total_words") / target)
    j = j.withColumn("size_fit", F.greatest(F.lit(0.0), 0.50 * F.col("in_range") + 0.35 * F.col("avg_fit") - 0.10 * F.col("oversize") - 0.05 * F.col("tiny")))
    j = j.withColumn("count_fit", 1.0 - F.least(F.lit(1.0), F.abs(F.col("n_chunks") - expected) / expected))
    score = 0.23 * F.col("size_fit") + 0.18 * F.col("count_fit") + 0.17 * F.col("boundary_quality") + 0.14 * F.col("structure_integrity") + 0.12 * F.col("cohesion") + 0.09 * (0.45 * F.col("non_redundancy") + 0.55 * F.col("distinctness")) + 0.04 * F.col("coverage")
    return ranked(j.withColumn("score", tx.clip(score)))


def ranked(scores: DataFrame) -> DataFrame:
    """rank and winner by score within the document; equal scores (to nine decimals) by name."""
    w = Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 9)), "strategy")
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("winner", F.col("rank") == 1)


def winners(quality_of: DataFrame, kinds: DataFrame, preference: dict[str, tuple[str, ...]], names: tuple[str, ...], forced: str | None = None) -> DataFrame:
    """quality_of(doc_id, strategy, quality, ...), kinds(doc_id, type) -> the row of every document's strategy, with score: its quality plus
    a bias by the type's order of preference and for legal strategies. Equal scores by the order of names; a forced strategy wins where it has chunks."""
    bias = F.lit(0.0)
    for kind, order_of in preference.items():
        for k, name in enumerate(order_of):
            bias = F.when((F.col("type") == kind) & (F.col("strategy") == name), F.lit(0.025 * (len(order_of) - k))).otherwise(bias)
    bias = bias + sum((F.when(F.col("strategy") == name, x).otherwise(0.0) for name, x in LEGAL_BIAS.items()), F.lit(0.0))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("strategy"))
    j = quality_of.join(kinds, "doc_id").withColumn("score", F.col("quality") + bias)
    w = Window.partitionBy("doc_id").orderBy((F.col("strategy") == F.lit(forced or "")).desc(), F.desc(F.round("score", 9)), place)
    return j.withColumn("rank", F.row_number().over(w)).filter("rank = 1").drop("rank", "type")


def boundary_hash(chunks: DataFrame) -> DataFrame:
    """(doc_id, strategy, boundary_md5, same_as): strategies of one document with equal spans; the first by name stands for all."""
    spans_text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "start", "end"))), lambda x: F.concat_ws(",", x["start"], x["end"])), "|")
    found = chunks.groupBy(*KEY).agg(F.md5(spans_text).alias("boundary_md5"))
    return found.withColumn("same_as", F.min("strategy").over(Window.partitionBy("doc_id", "boundary_md5")))


def final_scores(chunks: DataFrame, scored: DataFrame, n_min: int = 100, n_max: int = 500) -> DataFrame:
    """The S8 score: scored(doc_id, strategy, idx, icc, boundary_score, jsd); a document's last chunk is left out unless it is alone."""
    last = F.max("idx").over(Window.partitionBy(*KEY))
    real = chunks.withColumn("last", last).filter((F.col("idx") < F.col("last")) | (F.col("last") == 0)).drop("last")
    s = real.select(*KEY, "idx").join(scored, [*KEY, "idx"], "left")
    means = s.groupBy(*KEY).agg(F.avg(F.coalesce("icc", F.lit(0.5))).alias("icc"), F.avg(1.0 - F.coalesce("boundary_score", F.lit(0.5))).alias("distinct"), F.avg(F.least(F.coalesce("jsd", F.lit(0.0)) * 2.0, F.lit(1.0))).alias("entropy"))
    j = means.join(separation(real), list(KEY)).join(sizes(real, n_min, n_max, 0.70), list(KEY))
    score = 0.25 * F.col("icc") + 0.25 * F.col("distinct") + 0.20 * (0.65 * F.col("avg_fit") + 0.35 * F.col("in_range")) + 0.20 * F.col("separation") + 0.10 * F.col("entropy")
    return ranked(j.select(*KEY, tx.clip(score).alias("score")))


def final_of_documents(rows: DataFrame, n_min: int = 100, n_max: int = 500) -> DataFrame:
    """The same of packed rows (doc_id, strategy): signals and scores are measured and averaged where the document is."""
    from . import scoring

    return measures.by_document(rows, (*KEY, "texts"), "doc_id bigint, strategy string, score double", lambda doc_id, strategy, texts: [(doc_id, strategy, scoring.final(measures.Chunks(texts), n_min, n_max))] if texts else [])


def rank_of_documents(docs: DataFrame, strategies: tuple[str, ...], n_min: int = 100, n_max: int = 500) -> DataFrame:
    """docs(doc_id, text, type) -> (doc_id, strategy, n_chunks, score, rank, winner): the scores of candidate_scores over every strategy's
    chunks, made, scored and ranked where the document is."""
    from . import chunkers, scoring

    def work(doc_id, text, kind):
        units, total, known, found = None, max(measures.n_words(text or ""), 1), {}, []
        for name, chunks in chunkers.chunk_lists(text, strategies, kind or "prose"):
            units = scoring.anchors(text) if units is None else units
            score = scoring.candidate([c.text for c in chunks], [(c.start, c.end) for c in chunks], len(text), total, units, n_min, n_max, known)
            found.append((-round(score, 9), name, len(chunks), score))
        return [(doc_id, name, n, score, k, k == 1) for k, (_, name, n, score) in enumerate(sorted(found), 1)]

    return measures.by_document(docs, ("doc_id", "text", "type"), "doc_id bigint, strategy string, n_chunks bigint, score double, rank bigint, winner boolean", work)


def winners_of_documents(docs: DataFrame, preference: dict[str, tuple[str, ...]], names: tuple[str, ...], n_min: int = 100, n_max: int = 500, forced: str | None = None) -> DataFrame:
    """docs(doc_id, text, type) -> winners(quality(...)) over every strategy's chunks, made, scored and picked where the document is."""
    from . import chunkers, scoring

    def bias(kind: str | None, name: str) -> float:
        liked = preference.get(kind, ())
        return (0.025 * (len(liked) - liked.index(name)) if name in liked else 0.0) + LEGAL_BIAS.get(name, 0.0)

    def work(doc_id, text, kind):
        found = []
        for name, chunks in chunkers.chunk_lists(text, names, kind or "prose"):
            q = scoring.quality([c.text for c in chunks], n_min, n_max)
            score = q + bias(kind, name)
            found.append(((name != forced, -round(score, 9), names.index(name)), (doc_id, name, len(chunks), q, score)))
        return [min(found)[1]] if found else []

    return measures.by_document(docs, ("doc_id", "text", "type"), "doc_id bigint, strategy string, n_chunks bigint, quality double, score double", work)
