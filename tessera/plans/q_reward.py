"""Queries of the reward (S7) and of what a run reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import boundary, embed, graph, measures, profile, report, retrieval, reward, windows
from . import sql
from .catalog import register
from .q_evaluate import SQL_ARTICLES, _sql_separation, as_articles, joined_articles
from .q_graph import SQL_BOW, SQL_NAMED, SQL_RELATED, SQL_TOPIC
from .q_profile import SQL_BALANCE, SQL_CUES, SQL_DOMAIN, SQL_GATE_PARTS, SQL_PROFILE, SQL_SCORES, SQL_TYPE, docs
from .q_signals import SQL_DIST, SQL_ICC, SQL_PMI, SQL_THRESHOLDS, chunks, lists


def _sql_probes(source: str) -> str:
    """RE2 has no look-behind: the first sentence ends at the first mark behind . ! or ?."""
    found = lambda p, g: f"list_transform(regexp_extract_all(text, {sql.q(p)}, {g}), lambda x: {sql.strip('x')})"
    size = f"len({sql.words('x')})"
    legal = f"list_filter({found(reward.LEGAL_PROBE.replace('(?imud)', '(?im)'), 1)}, lambda x: {size} BETWEEN 3 AND 12)"
    heads = f"list_filter({found(reward.HEADING_PROBE.replace('(?md)', '(?m)'), 1)}, lambda x: {size} BETWEEN 2 AND 12)"
    numbered = reward.NUMBERED_PROBE.replace("(?md)", "(?m)")
    numbers = f"list_filter(list_transform(list_zip({found(numbered, 1)}, {found(numbered, 2)}), lambda z: z[1] || ' ' || z[2]), lambda x: {size} >= 3)"
    firsts = rf"list_filter(list_transform(regexp_split_to_array(text, '\n{{2,}}'), lambda p: string_split(regexp_replace({sql.strip('p')}, '([.!?])\s+', '\1' || chr(1)), chr(1))[1]), lambda x: {size} >= 8)"
    return f"SELECT doc_id, (list_concat(list_concat({legal}, {heads}), list_concat(list_transform({numbers}, lambda x: substr(x, 1, 100)), list_transform({firsts}, lambda x: substr(x, 1, 120)))))[1:8] AS ps FROM {source}"


SQL_PROBES = f"asked AS (SELECT doc_id, unnest(ps) AS probe, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS pos FROM ({_sql_probes('documents')}))"


@register("probes", f"WITH {SQL_ARTICLES}, both_texts AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, text FROM articles) SELECT doc_id, unnest(ps) AS probe, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS pos FROM ({_sql_probes('both_texts')})")
def probes(spark, sf_dir):
    """Of the documents, and of their texts as articles (with other ids)."""
    articles = joined_articles(as_articles(spark, sf_dir)).withColumn("doc_id", -1 - F.col("doc_id"))
    return reward.probes(docs(spark, sf_dir).select("doc_id", "text").unionByName(articles))


#: Chunks with what the reward reads; a document's last one ends it.
SQL_JUDGED = f"""{SQL_DIST}, {SQL_PMI}, {SQL_ICC}, {SQL_THRESHOLDS}, judged AS (SELECT c.doc_id, 'plain' AS strategy, c.idx, c.text, icc, coalesce(pmi_drop, 0.5::DOUBLE) AS pmi_drop,
  CASE WHEN d.jsd IS NULL THEN 'end' WHEN round(d.jsd, 9) > high THEN 'hard' WHEN round(d.jsd, 9) < low THEN 'merge' ELSE 'soft' END AS boundary_type
  FROM chunks c LEFT JOIN distances d USING (doc_id, idx) LEFT JOIN thresholds t ON c.doc_id = t.doc_id LEFT JOIN iccs USING (doc_id, idx) LEFT JOIN pmi USING (doc_id, idx)),
realj AS (SELECT * FROM (SELECT *, count(*) FILTER (WHERE boundary_type <> 'end') OVER (PARTITION BY doc_id) AS others FROM judged) WHERE boundary_type <> 'end' OR others = 0)"""
SQL_COVERED = f"""pterms AS (SELECT doc_id, pos, list_distinct(list_filter({sql.tokens('probe')}, lambda x: length(x) >= 3)) AS t FROM asked),
pmet AS (SELECT r.doc_id, r.idx, p.pos, len(any_value(p.t)) AS k, any_value(r.n) AS n, count(*) AS met FROM (SELECT doc_id, idx, greatest(len({sql.words('text')}), 1) AS n, unnest(list_distinct({sql.tokens('text')})) AS term FROM realj) r
  JOIN (SELECT doc_id, pos, t, unnest(t) AS term FROM pterms) p ON p.doc_id = r.doc_id AND p.term = r.term GROUP BY ALL),
pbest AS (SELECT doc_id, pos, max(met::DOUBLE / k * least(1.0::DOUBLE, 300.0::DOUBLE / n)) AS best FROM pmet GROUP BY ALL),
cov AS (SELECT d.doc_id, coalesce(c, 0.5::DOUBLE) AS coverage FROM (SELECT DISTINCT doc_id FROM realj) d LEFT JOIN
  (SELECT p.doc_id, avg(CASE WHEN len(t) = 0 THEN 0.5::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END) AS c FROM pterms p LEFT JOIN pbest b ON b.doc_id = p.doc_id AND b.pos = p.pos GROUP BY p.doc_id) USING (doc_id))"""


def windowed(spark, sf_dir, strategy):
    """(doc_id, strategy) of every window, without its text."""
    return windows.sliding_window(docs(spark, sf_dir)).select("doc_id", F.lit(strategy).alias("strategy"))


def _judged(spark, sf_dir):
    return measures.measure(lists(spark, sf_dir), ("text", "n_words", "icc", "pmi_drop", "jsd", "boundary_type")).withColumn("strategy", F.lit("plain"))


def _asked(spark, sf_dir):
    """The windows, packed, and their document's probes."""
    d = docs(spark, sf_dir).withColumns({"asked": reward.probes_of(F.col("text")), "strategy": F.lit("plain")})
    return windows.lists(d, keep=("strategy", "asked"))


@register("probe_coverage", f"WITH {sql.CHUNKS}, {SQL_PROBES}, {SQL_JUDGED}, {SQL_COVERED} SELECT doc_id, coverage FROM cov")
def probe_coverage(spark, sf_dir):
    return reward.coverage_of_documents(_asked(spark, sf_dir))


_RAW = "0.35::DOUBLE * quality + 0.25::DOUBLE * coverage + 0.20::DOUBLE * consistency + 0.20::DOUBLE * efficiency + 0.10::DOUBLE * structural - least(0.04::DOUBLE * broken, 0.30::DOUBLE)"


@register("reward", rf"""WITH {sql.CHUNKS}, {SQL_PROBES}, {SQL_JUDGED}, {SQL_COVERED}, {_sql_separation('realj', ())},
rsum AS (SELECT doc_id, strategy, avg(icc) AS icc, avg(pmi_drop) AS pmi, avg((boundary_type = 'hard')::INT) AS hard, count(*) FILTER (WHERE regexp_matches({sql.strip('text')}, '^\p{{Ll}}') AND NOT regexp_matches({sql.strip('text')}, '^[a-z]\)')) AS broken,
    avg((n BETWEEN 80 AND 500)::INT) AS in_range, count(*) AS k, sum(n) AS w, avg(n) AS mean, stddev_pop(n) AS sd FROM (SELECT *, greatest(len({sql.words('text')}), 1)::DOUBLE AS n FROM realj) GROUP BY ALL),
robj AS (SELECT doc_id, strategy, broken, in_range, coverage, {sql.clip('0.55::DOUBLE * separation + 0.45::DOUBLE * icc')} AS quality, {sql.clip('1.0::DOUBLE - sd / greatest(mean, 1.0::DOUBLE)')} AS consistency,
    {sql.clip('1.0::DOUBLE - abs(k - greatest(3.0::DOUBLE, w / 300)) / greatest(3.0::DOUBLE, w / 300)')} AS efficiency, {sql.clip('0.5::DOUBLE * hard + 0.5::DOUBLE * pmi')} AS structural
  FROM rsum JOIN sep USING (doc_id, strategy) JOIN cov USING (doc_id))
SELECT doc_id, strategy, quality, coverage, consistency, efficiency, structural, {sql.clip(f'CASE WHEN in_range <= 0.05 THEN least({_RAW}, 0.50::DOUBLE) ELSE {_RAW} END')} AS total FROM robj""")
def reward_components(spark, sf_dir):
    return reward.of_documents(_asked(spark, sf_dir))


@register("chunk_summary", rf"""WITH {sql.CHUNKS}, {SQL_JUDGED} SELECT j.doc_id, j.strategy, j.idx, c.n_words, boundary_type, 0.0::DOUBLE AS signal, coalesce(d.jsd, 0.0::DOUBLE) AS jsd,
  substr({sql.strip(r"regexp_replace(c.text, '\s+', ' ', 'g')")}, 1, 240) AS preview FROM judged j JOIN chunks c USING (doc_id, idx) LEFT JOIN distances d USING (doc_id, idx)""")
def chunk_summary(spark, sf_dir):
    return report.summary(_judged(spark, sf_dir).withColumn("signal", F.lit(None).cast("double")))


@register("signal_series", f"WITH {sql.CHUNKS}, {SQL_DIST} SELECT doc_id, 'plain' AS strategy, list(coalesce(round(jsd, 6), 0.0::DOUBLE) ORDER BY idx) AS series FROM chunks LEFT JOIN distances USING (doc_id, idx) GROUP BY doc_id")
def signal_series(spark, sf_dir):
    found = measures.series(lists(spark, sf_dir), "jsd")
    return found.select("doc_id", F.lit("plain").alias("strategy"), F.transform("series", lambda x: F.coalesce(F.round(x, 6), F.lit(0.0))).alias("series"))


@register("stage_stats", f"""WITH {sql.CHUNKS}, {SQL_JUDGED} SELECT j.doc_id, j.strategy, count(*) AS initial_count, count(*) AS final_count, CAST(0 AS BIGINT) AS merged_count, count(*) FILTER (WHERE boundary_type = 'hard') AS hard_count,
  count(*) FILTER (WHERE boundary_type = 'soft') AS soft_count, count(*) FILTER (WHERE boundary_type = 'end') AS end_count, coalesce(avg(jsd) FILTER (WHERE boundary_type <> 'end'), 0.0::DOUBLE) AS mean_signal, 0.0::DOUBLE AS merge_ratio
  FROM judged j LEFT JOIN distances d USING (doc_id, idx) GROUP BY j.doc_id, j.strategy""")
def stage_stats(spark, sf_dir):
    """Of the windows before refinement, none of which is merged; refined_stats has the others."""
    found = measures.measure(lists(spark, sf_dir), ("jsd", "boundary_type")).withColumns({"strategy": F.lit("plain"), "n_merged": F.lit(0)})
    return report.stage_stats(found.withColumnRenamed("jsd", "signal"), windowed(spark, sf_dir, "plain"))


@register("refined_stats")
def refined_stats(spark, sf_dir):
    from ..operators import refine

    refined = refine.refine(lists(spark, sf_dir).withColumn("strategy", F.lit("sliding_window")))
    return report.stage_stats(refined, windowed(spark, sf_dir, "sliding_window"))


@register("run_details", f"""WITH {sql.CHUNKS}, {SQL_ICC} SELECT doc_id, 'plain' AS strategy, count(*) AS chunk_count, avg(n_words) AS mean_words, 0.0::DOUBLE AS mean_boundary_score, avg(icc) AS mean_icc, CAST(0 AS BIGINT) AS entity_count FROM chunks JOIN iccs USING (doc_id, idx) GROUP BY doc_id""")
def run_details(spark, sf_dir):
    j = measures.measure(lists(spark, sf_dir), ("text", "icc")).withColumns({"strategy": F.lit("plain"), "boundary_score": F.lit(None).cast("double")})
    return report.run_details(j)


@register("entity_graph_nodes", f"""WITH {sql.CHUNKS}, {SQL_NAMED}, {SQL_RELATED}
SELECT doc_id, idx AS id, 'C' || idx AS label, (SELECT count(*) FROM ents e WHERE e.doc_id = c.doc_id AND e.idx = c.idx) AS entity_count, (SELECT count(*) FROM rels r WHERE r.doc_id = c.doc_id AND r.idx = c.idx) AS relation_count FROM chunks c""")
def entity_graph_nodes(spark, sf_dir):
    c = chunks(spark, sf_dir)
    ents = graph.entities(c)
    return report.graph_nodes(c, ents, graph.relations(c, ents))


_FIRST = rf"substr(string_split(regexp_replace({sql.strip('c.text')}, '([.!?])\s+', '\1' || chr(1)), chr(1))[1], 1, 120)"
_TEMPLATE = "CASE domain " + " ".join(f"WHEN {sql.q(k)} THEN {sql.q(v)}" for k, v in report.TEMPLATES.items()) + f" ELSE {sql.q(report.GENERAL)} END"


@register("embedding_inputs", f"""WITH {sql.CHUNKS}, {SQL_SCORES}, named AS ({SQL_DOMAIN}), about AS (SELECT doc_id, {SQL_TYPE} AS kind, {SQL_TOPIC} AS topic, len({sql.words('text')}) AS n FROM documents),
heads AS (SELECT c.doc_id, c.idx, c.text, n, {_TEMPLATE} || ' Document type: ' || kind || '. Topic: ' || topic || '. Chunk focus: ' || {_FIRST} AS context_header FROM chunks c JOIN about USING (doc_id) JOIN named USING (doc_id))
SELECT doc_id, idx, context_header, CASE WHEN n < 1000 THEN text ELSE context_header || chr(10) || chr(10) || text END AS input FROM heads""")
def embedding_inputs(spark, sf_dir):
    d = docs(spark, sf_dir)
    return report.embedding_inputs(chunks(spark, sf_dir), d, profile.domains(d, profile.domain_scores(d)))


@register("embedding_retrieval_metrics", f"""WITH {sql.CHUNKS}, {SQL_BOW}, sizes AS (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id HAVING count(*) >= 3),
es AS (SELECT a.doc_id, a.idx AS q, b.idx AS d, round(sum(a.v * b.v), 9) AS score FROM bow a JOIN bow b ON a.doc_id = b.doc_id AND a.d = b.d AND a.idx <> b.idx JOIN sizes ON a.doc_id = sizes.doc_id GROUP BY ALL),
epairs AS (SELECT a.doc_id, a.idx AS q, b.idx AS d, n FROM chunks a JOIN chunks b ON a.doc_id = b.doc_id AND a.idx <> b.idx JOIN sizes ON a.doc_id = sizes.doc_id),
ranks AS (SELECT p.*, row_number() OVER (PARTITION BY p.doc_id, p.q ORDER BY coalesce(score, 0.0) DESC, p.d) AS r FROM epairs p LEFT JOIN es USING (doc_id, q, d)),
each AS (SELECT doc_id, q, n, min(r) FILTER (WHERE abs(q - d) = 1) AS first, count(*) FILTER (WHERE abs(q - d) = 1) AS hits, coalesce(sum(1.0::DOUBLE / log2(r + 1)) FILTER (WHERE abs(q - d) = 1), 0.0::DOUBLE) AS dcg FROM ranks WHERE r <= 5 GROUP BY ALL)
SELECT doc_id, avg(coalesce(1.0::DOUBLE / first, 0.0::DOUBLE)) AS mrr, avg(dcg / CASE WHEN q = 0 OR q = n - 1 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE + 1.0::DOUBLE / log2(3) END) AS ndcg,
  avg(hits / 5.0::DOUBLE) AS precision, avg(hits::DOUBLE / CASE WHEN q = 0 OR q = n - 1 THEN 1 ELSE 2 END) AS recall, count(*) AS n_queries FROM each GROUP BY doc_id""")
def embedding_retrieval_metrics(spark, sf_dir):
    return retrieval.metrics_of_documents(lists(spark, sf_dir), embed.document_scores)


_LEVEL = "CASE WHEN score >= 0.70 THEN 'strong' WHEN score >= 0.40 THEN 'usable' ELSE 'weak' END"
_REASON = "CASE " + " ".join(f"WHEN metric = {sql.q(m)} AND level = {sql.q(k)} THEN {sql.q(v)}" for m, levels in report.REASONS.items() for k, v in levels.items()) + " ELSE 'Metric computed from document structure and content.' END"


@register("metric_levels", f"""WITH prof AS ({SQL_PROFILE}), each AS (SELECT doc_id, unnest([{", ".join(f"{{'metric': '{m}', 'score': {m}}}" for m in profile.METRICS)}]) AS x FROM prof),
judged AS (SELECT doc_id, x.metric AS metric, x.score AS score, {_LEVEL} AS level FROM each) SELECT *, {_REASON} AS reason FROM judged""")
def metric_levels(spark, sf_dir):
    return report.metric_levels(profile.profiles(docs(spark, sf_dir)))


@register("metric_details", rf"""WITH p AS ({SQL_GATE_PARTS}), n AS (SELECT *, list_transform(sentences, lambda x: len({sql.content('x', tx.STOP_PROFILE)})::DOUBLE) AS s, list_transform(blocks, lambda x: len({sql.content('x', tx.STOP_PROFILE)})::DOUBLE) AS b FROM p)
SELECT doc_id, {SQL_CUES}, len(b) AS block_count, len(s) AS sentence_count, coalesce(list_avg(s), 0.0::DOUBLE) AS mean_sentence_tokens, coalesce(list_avg(b), 0.0::DOUBLE) AS mean_block_tokens,
  coalesce(list_stddev_pop(b), 0.0::DOUBLE) AS sd_block_tokens, {SQL_BALANCE} AS balanced_delimiters, len(list_filter(ls, lambda x: length(x) <= 2)) AS short_noise_lines, {sql.chars('text', '�')} AS replacement_chars,
  {sql.count('text', profile.STRUCTURAL.replace('(?iud)', '(?im)'))} AS structural_boundaries, len({sql.words('text')}) AS document_words FROM n""")
def metric_details(spark, sf_dir):
    return report.metric_details(docs(spark, sf_dir))


_CODE = lambda t: f"list_distinct(regexp_extract_all({t}, {sql.q(boundary.CODE_TOKEN)}))"
_OFF = lambda t: f"abs({sql.chars(t, '{')} - {sql.chars(t, '}')})"


@register("code_continuity", f"""WITH {sql.CHUNKS}, lr AS (SELECT b.doc_id, b.idx, a.text AS a, b.text AS b FROM chunks a JOIN chunks b ON a.doc_id = b.doc_id AND a.idx + 1 = b.idx)
SELECT doc_id, idx, {sql.jaccard(_CODE('a'), _CODE('b'))} AS operators, {sql.clip(f"(1.0::DOUBLE - least(1.0::DOUBLE, ({_OFF('a')} + {_OFF('b')}) / 6.0::DOUBLE) + CASE WHEN regexp_matches(b, '(?m)^#{{1,6}}\\s') THEN 1.0::DOUBLE ELSE 0.6::DOUBLE END + CASE WHEN contains(a, '<') AND contains(a, '>') AND contains(b, '<') AND contains(b, '>') THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END) / 3.0::DOUBLE")} AS structural FROM lr""")
def code_continuity(spark, sf_dir):
    """The parts of the boundary score that texts of code have."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    pairs = chunks(spark, sf_dir).select("doc_id", "idx", F.lag("text").over(order).alias("a"), F.col("text").alias("b")).filter("a is not null")
    return pairs.select("doc_id", "idx", boundary.operator_overlap(F.col("a"), F.col("b")).alias("operators"), boundary.structural_code(F.col("a"), F.col("b")).alias("structural"))
