"""What a run reports: summaries and series of refined chunks, counts by stage, metric levels, graph exports, context headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import graph, profile

# What a chunk's header says first, by domain.
TEMPLATES = {
    "legal": "Legal context: section intent, obligations, governing terms, and enforceable clauses.",
    "medical": "Medical context: patient condition, clinical findings, interventions, and outcomes.",
    "technical": "Technical context: architecture, implementation details, interfaces, and constraints.",
    "financial": "Financial context: performance indicators, accounting treatment, and risk factors.",
    "academic": "Academic context: hypothesis, methods, evidence, and contribution claims.",
    "narrative": "Narrative context: storyline progression, actors, events, and thematic transitions.",
}
GENERAL = "General context: preserve semantics and continuity across chunks."

# What a metric's level means.
REASONS = {
    "RC": {
        "strong": "The document has clear anchors such as headings, sections, lists, tables, references, or code symbols.",
        "usable": "The document has some structural anchors, but not enough to rely on structure alone.",
        "weak": "Few reliable anchors were found, so semantic or paragraph-based chunking may be safer.",
    },
    "ICC": {
        "strong": "Nearby sentences stay on related topics.",
        "usable": "Sentence-to-sentence flow is mixed but still usable.",
        "weak": "Adjacent sentences share little topic signal, so aggressive merging should be avoided.",
    },
    "DCC": {
        "strong": "Adjacent paragraphs or sections connect consistently.",
        "usable": "Paragraph flow is partially coherent.",
        "weak": "Paragraphs or sections look weakly connected, so boundary detection should be conservative.",
    },
    "BI": {
        "strong": "The extracted text appears clean and structurally complete.",
        "usable": "The text is mostly usable but has some structural or extraction issues.",
        "weak": "The text may contain broken lines, malformed blocks, delimiter imbalance, or extraction noise.",
    },
    "SC": {
        "strong": "Natural document units are well sized for chunking.",
        "usable": "Natural units can be chunked, but size variance may need adjustment.",
        "weak": "Natural units are poorly sized for chunking, so Stage 2 should repack or split carefully.",
    },
}


def summary(chunks: DataFrame, most: int = 240) -> DataFrame:
    """chunks(doc_id, strategy, idx, text, boundary_type, signal, jsd) -> one line each: words, type, signals and a preview."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    preview = F.substr(tx.strip(F.regexp_replace("text", r"(?U)\s+", " ")), F.lit(1), F.lit(most))
    return chunks.select("doc_id", "strategy", "idx", tx.n_words(F.col("text")).cast("long").alias("n_words"), F.coalesce("boundary_type", F.lit("unknown")).alias("boundary_type"), zero("signal"), zero("jsd"), preview.alias("preview"))


def signal_series(chunks: DataFrame) -> DataFrame:
    """(doc_id, strategy, series): the boundary signals in order."""
    rows = F.array_sort(F.collect_list(F.struct("idx", F.coalesce("signal", F.lit(0.0)).alias("x"))))
    return chunks.groupBy("doc_id", "strategy").agg(F.transform(rows, lambda r: r["x"]).alias("series"))


def stage_stats(refined: DataFrame, initial: DataFrame) -> DataFrame:
    """Of refined(doc_id, strategy, boundary_type, n_merged, signal) and the chunks that went in: counts by type, mean signal, share of
    boundaries that were merged away."""
    before = initial.groupBy("doc_id", "strategy").agg(F.count(F.lit(1)).alias("initial_count"))
    kinds = [F.count_if(F.col("boundary_type") == k).alias(f"{k}_count") for k in ("hard", "soft", "end")]
    after = refined.groupBy("doc_id", "strategy").agg(
        F.count(F.lit(1)).alias("final_count"), F.sum("n_merged").alias("merged_count"), *kinds,
        F.coalesce(F.avg(F.when(F.col("boundary_type") != "end", F.col("signal"))), F.lit(0.0)).alias("mean_signal"),
    )
    return before.join(after, ["doc_id", "strategy"]).withColumn("merge_ratio", F.col("merged_count") / F.greatest(F.col("initial_count") - 1, F.lit(1)))


def run_details(chunks: DataFrame, ents: DataFrame | None = None) -> DataFrame:
    """Of final chunks(doc_id, strategy, idx, text, icc, boundary_score): means and the number of entities(doc_id, strategy, idx)."""
    found = chunks.groupBy("doc_id", "strategy").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.avg(tx.n_words(F.col("text"))).alias("mean_words"),
        F.avg(F.coalesce("boundary_score", F.lit(0.0))).alias("mean_boundary_score"), F.avg(F.coalesce("icc", F.lit(0.5))).alias("mean_icc"),
    )
    if ents is None:
        return found.withColumn("entity_count", F.lit(0).cast("long"))
    counted = ents.groupBy("doc_id", "strategy").agg(F.count(F.lit(1)).alias("entity_count"))
    return found.join(counted, ["doc_id", "strategy"], "left").fillna(0, ["entity_count"])


def reason(metric: Column, level: Column) -> Column:
    found = F.lit("Metric computed from document structure and content.")
    for m, levels in REASONS.items():
        for k, words in levels.items():
            found = F.when((metric == m) & (level == k), F.lit(words)).otherwise(found)
    return found


def metric_levels(profiles: DataFrame) -> DataFrame:
    """(doc_id, metric, score, level, reason) of a profile's metrics."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("score")) for m in profile.METRICS])).alias("x")
    return profiles.select("doc_id", rows).select("doc_id", "x.metric", "x.score").withColumn("level", profile.metric_level(F.col("score"))).withColumn("reason", reason(F.col("metric"), F.col("level")))


def metric_details(docs: DataFrame) -> DataFrame:
    """(doc_id, ...): the counts, means and deviations behind a profile's metrics, in one pass over the texts."""
    text = F.coalesce("text", F.lit(""))
    size = lambda parts: F.transform(parts, lambda x: F.size(tx.content_tokens(x, tx.STOP_PROFILE)).cast("double"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    mean = lambda c: F.when(F.size(c) > 0, total(F.col(c)) / F.size(c)).otherwise(0.0)
    base = docs.select("doc_id", text.alias("text")).withColumns({"s": size(tx.sentences(F.col("text"))), "b": size(tx.blocks(F.col("text")))})
    base = base.withColumn("block_mean", mean("b"))
    spread = F.sqrt(F.aggregate("b", F.lit(0.0), lambda a, x: a + (x - F.col("block_mean")) * (x - F.col("block_mean"))) / F.greatest(F.size("b"), F.lit(1)))
    t = F.col("text")
    short = F.size(F.filter(tx.full_lines(t), lambda x: F.length(x) <= 2))
    long = lambda c: c.cast("long")
    return base.select(
        "doc_id", *[long(c).alias(k) for k, c in profile.cue_counts(t).items()], long(F.size("b")).alias("block_count"), long(F.size("s")).alias("sentence_count"),
        mean("s").alias("mean_sentence_tokens"), F.col("block_mean").alias("mean_block_tokens"), spread.alias("sd_block_tokens"), profile.delimiter_balance(t).alias("balanced_delimiters"),
        long(short).alias("short_noise_lines"), long(tx.count_chars(t, "\x00", "�")).alias("replacement_chars"), long(F.regexp_count(t, F.lit(profile.STRUCTURAL.replace("(?iud)", "(?imud)")))).alias("structural_boundaries"),
        long(tx.n_words(t)).alias("document_words"),
    )


def graph_nodes(chunks: DataFrame, ents: DataFrame, rels: DataFrame) -> DataFrame:
    """(doc_id, id, label, entity_count, relation_count): a node for every chunk."""
    count = lambda df, name: df.groupBy("doc_id", "idx").agg(F.count(F.lit(1)).alias(name))
    joined = chunks.select("doc_id", "idx").join(count(ents, "entity_count"), ["doc_id", "idx"], "left").join(count(rels, "relation_count"), ["doc_id", "idx"], "left")
    return joined.select("doc_id", F.col("idx").alias("id"), F.concat(F.lit("C"), F.col("idx").cast("string")).alias("label"), F.coalesce("entity_count", F.lit(0)).alias("entity_count"), F.coalesce("relation_count", F.lit(0)).alias("relation_count"))


def context_header(domain: Column, kind: Column, topic: Column, first: Column) -> Column:
    """What stands before a chunk when it is embedded."""
    template = F.lit(GENERAL)
    for name, words in TEMPLATES.items():
        template = F.when(domain == name, F.lit(words)).otherwise(template)
    return F.concat(template, F.lit(" Document type: "), kind, F.lit(". Topic: "), topic, F.lit(". Chunk focus: "), first)


def first_sentence(text: Column, most: int = 120) -> Column:
    """Up to the first sentence end, at most so many characters."""
    return F.substr(F.element_at(F.split(tx.strip(text), r"(?U)(?<=[.!?])\s+", 2), 1), F.lit(1), F.lit(most))


def embedding_inputs(chunks: DataFrame, docs: DataFrame, domains: DataFrame) -> DataFrame:
    """chunks(doc_id, idx, text), docs(doc_id, text), domains(doc_id, domain) -> doc_id, idx, context_header, input: the text to embed,
    behind its header unless the document is short."""
    about = docs.select("doc_id", profile.doc_type(F.col("text")).alias("kind"), graph.topic(F.col("text")).alias("topic"), profile.length_bucket(tx.n_words(F.col("text"))).alias("bucket"))
    joined = chunks.select("doc_id", "idx", "text").join(about, "doc_id").join(domains.select("doc_id", "domain"), "doc_id")
    header = context_header(F.col("domain"), F.col("kind"), F.col("topic"), first_sentence(F.col("text")))
    full = F.when(F.col("bucket") == "short", F.col("text")).otherwise(F.concat(header, F.lit("\n\n"), "text"))
    return joined.select("doc_id", "idx", header.alias("context_header"), full.alias("input"))
