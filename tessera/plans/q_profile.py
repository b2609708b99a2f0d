"""Queries of the document profile (S1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text as tx
from ..operators import profile as pf
from . import sql
from .catalog import register


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def t():
    return F.col("text")

SQL_TYPE = f"""CASE WHEN len(list_filter(string_split(text, chr(10))[1:200], lambda x: {' OR '.join(f'regexp_matches(x, {sql.q(p)})' for p in pf.CODE_LINES)}))::DOUBLE / len(string_split(text, chr(10))) > 0.08 THEN 'code'
  WHEN len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {sql.q(pf.TABLE_LINE)})))::DOUBLE / len(string_split(text, chr(10))) > 0.08 THEN 'table'
  WHEN len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {sql.q(pf.HEADING_LINE)}))) >= 3
    OR (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {sql.q(pf.HEADING_LINE)}))) > 0
        AND len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {sql.q(pf.TABLE_LINE)}))) > 0) THEN 'mixed'
  ELSE 'prose' END"""


@register("word_tokens", f"""SELECT doc_id, len({sql.words('text')}) AS n_words, len({sql.tokens('text')}) AS n_tokens,
  len(list_distinct({sql.tokens('text')})) AS n_types, len({sql.content('text', tx.STOP_PROFILE)}) AS n_content FROM documents""")
def word_tokens(spark, sf_dir):
    toks = tx.tokens(t())
    return docs(spark, sf_dir).select("doc_id", tx.n_words(t()).cast("long").alias("n_words"), F.size(toks).cast("long").alias("n_tokens"), F.size(F.array_distinct(toks)).cast("long").alias("n_types"), F.size(tx.content_tokens(t(), tx.STOP_PROFILE)).cast("long").alias("n_content"))


@register("doc_type", f"SELECT doc_id, {SQL_TYPE} AS type FROM documents")
def doc_type(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", pf.doc_type(t()).alias("type"))


@register("length_bucket", f"""SELECT doc_id, len({sql.words('text')}) AS n_words,
  CASE WHEN len({sql.words('text')}) < 1000 THEN 'short' WHEN len({sql.words('text')}) <= 10000 THEN 'medium' ELSE 'long' END AS bucket FROM documents""")
def length_bucket(spark, sf_dir):
    n = tx.n_words(t()).cast("long")
    return docs(spark, sf_dir).select("doc_id", n.alias("n_words"), pf.length_bucket(n).alias("bucket"))


def _sql_keywords() -> str:
    rows = [(d, k, p) for p, d in enumerate(pf.DOMAINS) for k in pf.KEYWORDS[d]]
    return "kw(domain, keyword, priority) AS (VALUES " + ", ".join(f"({sql.q(d)}, {sql.q(k)}, {p})" for d, k, p in rows) + ")"


# RE2 has no lookaround: characters that aren't of words are doubled in text and keyword, so that neighbours don't share one.
SQL_SCORES = rf"""{_sql_keywords()}, toks AS (
  SELECT doc_id, unnest({sql.tokens('text')}) AS tok FROM documents
), singles AS (
  SELECT doc_id, domain, priority, count(*) AS n FROM toks JOIN kw ON tok = keyword GROUP BY ALL
), phrases AS (
  SELECT doc_id, domain, priority, sum(len(regexp_extract_all(' ' || regexp_replace(lower(text), '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || ' ',
    '[^\p{{L}}\p{{N}}_]' || regexp_replace(keyword, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g') || '[^\p{{L}}\p{{N}}_]'))) AS n
  FROM documents, kw WHERE regexp_matches(keyword, '[^\p{{L}}\p{{N}}_]') GROUP BY ALL
), scores AS (
  SELECT doc_id, domain, priority, CAST(sum(n) AS BIGINT) AS score FROM (SELECT * FROM singles UNION ALL SELECT * FROM phrases) GROUP BY ALL HAVING sum(n) > 0
)"""


@register("domain_scores", f"WITH {SQL_SCORES} SELECT doc_id, domain, score FROM scores")
def domain_scores(spark, sf_dir):
    return pf.domain_scores(docs(spark, sf_dir)).select("doc_id", "domain", F.col("score").cast("long").alias("score"))


SQL_DOMAIN = """SELECT d.doc_id, coalesce(arg_min(domain, priority), 'general') AS domain, coalesce(max(top), 0) AS top_score
FROM documents d LEFT JOIN (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY doc_id) AS top FROM scores) WHERE score >= top * 0.8) s ON d.doc_id = s.doc_id GROUP BY d.doc_id"""


@register("domain_label", f"WITH {SQL_SCORES} {SQL_DOMAIN}")
def domain_label(spark, sf_dir):
    d = docs(spark, sf_dir)
    return pf.domains(d, pf.domain_scores(d)).withColumn("top_score", F.col("top_score").cast("long"))


SQL_HEADING = f"length({sql.strip('x')}) <= 120 AND {sql.strip('x')} <> '' AND (regexp_matches({sql.strip('x')}, {sql.q('(?i)' + pf.HEADER)}) OR regexp_matches({sql.strip('x')}, {sql.q('(?i)' + pf.LEGAL)}))"


@register("structure_type", rf"""SELECT doc_id, CASE WHEN {SQL_TYPE} = 'code' THEN 'code' WHEN {sql.count('text', '(?im)' + pf.LEGAL)} >= 2 THEN 'legal_article'
  WHEN {SQL_TYPE} = 'table' OR {sql.count('text', pf.TABLE_ROW.replace('(?md)', '(?m)'))} >= 3 THEN 'table'
  WHEN len(list_filter(string_split(text, chr(10)), lambda x: {SQL_HEADING})) >= 2 THEN 'sectioned'
  WHEN len({sql.parts(r"regexp_split_to_array(text, '\n{2,}')")}) >= 3 THEN 'paragraph' ELSE 'plain' END AS structure FROM documents""")
def structure_type(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", pf.structure_type(t(), pf.doc_type(t())).alias("structure"))


def _re2(p: str) -> str:
    return p.replace("(?md)", "(?m)").replace("(?imud)", "(?im)").replace("(?iud)", "(?i)").replace("(?imd)", "(?im)")


SQL_CUES = ", ".join(f"{sql.count('text', _re2(p))} AS {k}" for k, p in pf.CUES.items())


@register("cue_counts", f"SELECT doc_id, {SQL_CUES} FROM documents")
def cue_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", *[c.cast("long").alias(k) for k, c in pf.cue_counts(t()).items()])


SQL_GATE_PARTS = rf"""SELECT doc_id, text, {SQL_TYPE} AS type, greatest(length(text), 1)::DOUBLE AS n_chars, {sql.full_lines('text')} AS ls, {sql.content('text', tx.STOP_PROFILE)} AS content,
  {sql.blocks('text')} AS blocks, {sql.sentences('text')} AS sentences FROM documents"""
SQL_GATE = rf"""CASE WHEN {sql.strip('text')} = '' THEN 0.0::DOUBLE ELSE {sql.clip(rf'''
  0.34::DOUBLE * {sql.clip(r"(len(regexp_extract_all(text, '[\p{L}\p{N}]')) / n_chars - 0.20::DOUBLE) / 0.45::DOUBLE")}
  + 0.26::DOUBLE * (CASE WHEN len(content) < 20 THEN 0.65::DOUBLE ELSE least(1.0::DOUBLE, len(list_distinct(content))::DOUBLE / greatest(len(content), 1) * 4.0::DOUBLE) END)
  + 0.22::DOUBLE * (1.0::DOUBLE - least(0.75::DOUBLE, len(list_filter(ls, lambda x: length(x) <= 2))::DOUBLE / greatest(len(ls), 1)))
  + 0.18::DOUBLE * (1.0::DOUBLE - least(0.95::DOUBLE, {sql.chars('text', '�')} / n_chars * 80.0::DOUBLE + len(regexp_extract_all(text, '[^\p{{L}}\p{{N}}_\s]{{4,}}'))::DOUBLE / greatest(len(ls), 1) * 0.18::DOUBLE))''')} END"""


@register("quality_gate", f"WITH p AS ({SQL_GATE_PARTS}) SELECT doc_id, {SQL_GATE} AS gate FROM p")
def quality_gate(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", pf.quality_gate(t(), tx.content_tokens(t(), tx.STOP_PROFILE)).alias("gate"))


def _sql_balance(a: str, b: str) -> str:
    x, y = sql.chars("text", a), sql.chars("text", b)
    return f"(CASE WHEN {x} + {y} > 0 THEN abs({x} - {y})::DOUBLE / ({x} + {y}) ELSE 0.0::DOUBLE END)"


SQL_BALANCE = sql.clip(f"1.0::DOUBLE - ({_sql_balance('(', ')')} + {_sql_balance('[', ']')} + {_sql_balance('{', '}')}) / 3.0::DOUBLE")


@register("delimiter_balance", f"SELECT doc_id, {SQL_BALANCE} AS balance FROM documents")
def delimiter_balance(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", pf.delimiter_balance(t()).alias("balance"))


SQL_CUE_SCORE = sql.clip(
    "greatest(1.0::DOUBLE - exp(-((" + " + ".join(f"{w}::DOUBLE * {sql.count('text', _re2(pf.CUES[k]))}" for k, w in pf.CUE_WEIGHTS.items()) + ") / greatest(len(blocks), 1))), "
    "CASE WHEN len(blocks) < 2 THEN 0.15::DOUBLE WHEN type IN ('code', 'table', 'mixed') THEN 0.35::DOUBLE ELSE 0.25::DOUBLE END)"
)


@register("retrieval_cue_score", f"WITH p AS ({SQL_GATE_PARTS}) SELECT doc_id, {SQL_CUE_SCORE} AS cue_score FROM p")
def retrieval_cue_score(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", pf.cue_score(pf.cue_counts(t()), F.size(tx.blocks(t())), pf.doc_type(t())).alias("cue_score"))


def _sql_cohesion(items: str, share: float) -> str:
    """A CTE body: mean pair score of neighbouring items by document, from p(doc_id, items)."""
    return rf"""SELECT doc_id, avg({share}::DOUBLE * least(3.0::DOUBLE * j, 1.0::DOUBLE) + {1.0 - share}::DOUBLE * c) AS raw FROM (
      SELECT doc_id, {sql.jaccard('a', 'b')} AS j,
        CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE
        list_sum(list_transform(list_distinct(ba), lambda d: len(list_filter(ba, lambda e: e = d))::DOUBLE * len(list_filter(bb, lambda e: e = d))))
        / sqrt(list_sum(list_transform(list_distinct(ba), lambda d: len(list_filter(ba, lambda e: e = d))::DOUBLE ** 2))
             * list_sum(list_transform(list_distinct(bb), lambda d: len(list_filter(bb, lambda e: e = d))::DOUBLE ** 2))) END AS c
      FROM (SELECT doc_id, s AS a, lead(s) OVER (PARTITION BY doc_id ORDER BY i) AS b,
          list_transform(s, lambda t: {sql.bucket('t', 128)}) AS ba, lead(list_transform(s, lambda t: {sql.bucket('t', 128)})) OVER (PARTITION BY doc_id ORDER BY i) AS bb
        FROM (SELECT doc_id, i, list_distinct({sql.content('x', tx.STOP_PROFILE)}) AS s
          FROM (SELECT doc_id, unnest({items}) AS x, generate_subscripts({items}, 1) AS i FROM p))) WHERE b IS NOT NULL) GROUP BY doc_id"""


SQL_ICC = f"icc AS ({_sql_cohesion('sentences', 0.35)})"
SQL_DCC = f"dcc AS ({_sql_cohesion('blocks', 0.40)})"


@register("sentence_cohesion", f"WITH p AS ({SQL_GATE_PARTS}), {SQL_ICC} SELECT p.doc_id, len(sentences) AS n_sentences, coalesce(raw, 0.6::DOUBLE) AS cohesion FROM p LEFT JOIN icc USING (doc_id)")
def sentence_cohesion(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", tx.sentences(t()).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_sentences")).join(pf.cohesion(pf.exploded(d, F.col("s")), 0.35), "doc_id", "left").select("doc_id", "n_sentences", F.coalesce("raw", F.lit(0.6)).alias("cohesion"))


@register("block_coherence", f"WITH p AS ({SQL_GATE_PARTS}), {SQL_DCC} SELECT p.doc_id, len(blocks) AS n_blocks, coalesce(raw, 0.6::DOUBLE) AS coherence FROM p LEFT JOIN dcc USING (doc_id)")
def block_coherence(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", tx.blocks(t()).alias("b"))
    return d.select("doc_id", F.size("b").cast("long").alias("n_blocks")).join(pf.cohesion(pf.exploded(d, F.col("b")), 0.40), "doc_id", "left").select("doc_id", "n_blocks", F.coalesce("raw", F.lit(0.6)).alias("coherence"))


SQL_INTEGRITY = rf"""CASE WHEN {sql.strip('text')} = '' THEN 0.0::DOUBLE ELSE {sql.clip(rf'''CASE WHEN type = 'code' THEN 0.30::DOUBLE ELSE 0.42::DOUBLE END
   * len(list_filter(CASE WHEN len(sentences) > 0 THEN sentences ELSE blocks END, lambda x: regexp_matches(x, '[.!?:;}}\]`]$') OR regexp_matches(x, {sql.q(_re2(pf.STRUCTURAL))})))::DOUBLE / greatest(len(CASE WHEN len(sentences) > 0 THEN sentences ELSE blocks END), 1)
   + CASE WHEN type = 'code' THEN 0.45::DOUBLE ELSE 0.28::DOUBLE END * {SQL_BALANCE}
   + CASE WHEN type = 'code' THEN 0.25::DOUBLE ELSE 0.20::DOUBLE END * (1.0::DOUBLE - least(0.45::DOUBLE, {sql.chars('text', '�')} / n_chars * 40.0::DOUBLE) - least(0.25::DOUBLE, len(list_filter(ls, lambda x: length(x) <= 2))::DOUBLE / greatest(len(ls), 1)))
   + CASE WHEN type = 'code' THEN 0.0::DOUBLE ELSE 0.10::DOUBLE END * least(1.0::DOUBLE, {sql.count('text', pf.STRUCTURAL.replace('(?iud)', '(?im)'))}::DOUBLE / greatest(2.0::DOUBLE, len(blocks) * 0.25::DOUBLE))''')} END"""


@register("block_integrity", f"WITH p AS ({SQL_GATE_PARTS}) SELECT doc_id, {SQL_INTEGRITY} AS integrity FROM p")
def block_integrity(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", pf.integrity(t(), tx.sentences(t()), tx.blocks(t()), pf.doc_type(t())).alias("integrity"))


SQL_SIZES = rf"""sizes AS (SELECT doc_id, any_value(type) AS type, any_value(total) AS total, count(*)::DOUBLE AS n, avg(k) AS mean, stddev_pop(k) AS sd,
    count(*) FILTER (WHERE k >= 4 AND k <= CASE type WHEN 'code' THEN 140 WHEN 'table' THEN 120 ELSE 180 END) AS packable
  FROM (SELECT doc_id, type, len(content) AS total, len({sql.content('b', tx.STOP_PROFILE)})::DOUBLE AS k FROM (SELECT doc_id, type, content, unnest(blocks) AS b FROM p)) GROUP BY doc_id)"""
SQL_TARGET = "CASE type WHEN 'code' THEN 80.0::DOUBLE WHEN 'table' THEN 67.5::DOUBLE ELSE 110.0::DOUBLE END"
SQL_SIZE = rf"""CASE WHEN len(p.content) = 0 THEN 0.0::DOUBLE WHEN len(p.content) < 80 THEN 0.75::DOUBLE WHEN n IS NULL THEN 0.5::DOUBLE ELSE {sql.clip(f'''0.34::DOUBLE * packable / n
   + 0.26::DOUBLE * (1.0::DOUBLE - least(1.0::DOUBLE, abs(mean - {SQL_TARGET.replace("type", "p.type")}) / {SQL_TARGET.replace("type", "p.type")}))
   + 0.20::DOUBLE * (1.0::DOUBLE - least(1.0::DOUBLE, sd / greatest(mean, 1.0::DOUBLE)))
   + 0.20::DOUBLE * least(1.0::DOUBLE, n / greatest(3.0::DOUBLE, len(p.content) / 450.0::DOUBLE))''')} END"""


@register("size_compliance", f"WITH p AS ({SQL_GATE_PARTS}), {SQL_SIZES} SELECT p.doc_id, {SQL_SIZE} AS compliance FROM p LEFT JOIN sizes USING (doc_id)")
def size_compliance(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", pf.doc_type(t()).alias("type"), tx.blocks(t()).alias("blocks"), F.size(tx.content_tokens(t(), tx.STOP_PROFILE)).alias("total"))
    found = pf.size_compliance(F.col("blocks_n"), F.col("size_mean"), F.col("size_sd"), F.col("packable"), F.col("total"), F.col("type"))
    return d.join(pf.block_sizes(d), "doc_id", "left").select("doc_id", found.alias("compliance"))


def _sql_language(variant: str) -> str:
    chars, fr, en = pf.MARKERS[variant]
    n = lambda ws: f"len(list_filter({sql.tokens(f'substr(text, 1, {chars})')}, lambda t: list_contains({sql.strings(ws.split())}, t)))"
    return f"CASE WHEN {n(fr)} > {n(en)} * 1.5 THEN 'fr' ELSE 'en' END"


@register("language_heuristic", f"SELECT doc_id, {_sql_language('signals')} AS lang_signals, {_sql_language('entities')} AS lang_entities FROM documents")
def language_heuristic(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", pf.language(t(), "signals").alias("lang_signals"), pf.language(t(), "entities").alias("lang_entities"))


SQL_METRICS = f"""metrics AS (SELECT p.doc_id, p.type, len({sql.words('text')}) AS n_tokens, g.gate,
  least({SQL_CUE_SCORE.replace('type IN', 'p.type IN')}, greatest(0.25::DOUBLE, g.gate)) AS RC,
  least({sql.clip("CASE WHEN len(sentences) >= 2 AND p.type IN ('code', 'table') THEN coalesce(icc.raw, 0.6::DOUBLE) * 0.75::DOUBLE + 0.15::DOUBLE ELSE coalesce(icc.raw, 0.6::DOUBLE) END")}, g.gate) AS ICC,
  least({sql.clip("CASE WHEN len(blocks) >= 2 AND p.type IN ('table', 'mixed') THEN coalesce(dcc.raw, 0.6::DOUBLE) * 0.80::DOUBLE + 0.10::DOUBLE ELSE coalesce(dcc.raw, 0.6::DOUBLE) END")}, g.gate) AS DCC,
  least({SQL_INTEGRITY.replace("type = 'code'", "p.type = 'code'")}, 0.35::DOUBLE + 0.65::DOUBLE * g.gate) AS BI, least({SQL_SIZE}, 0.30::DOUBLE + 0.70::DOUBLE * g.gate) AS SC
  FROM p JOIN (SELECT doc_id, {SQL_GATE} AS gate FROM p) g USING (doc_id) LEFT JOIN icc USING (doc_id) LEFT JOIN dcc USING (doc_id) LEFT JOIN sizes USING (doc_id))"""
SQL_WEIGHTED = " + ".join(f"{m} * (CASE domain " + " ".join(f"WHEN {sql.q(d)} THEN {w[i]}::DOUBLE" for d, w in pf.DOMAIN_WEIGHTS.items()) + f" ELSE {pf.DEFAULT_WEIGHTS[i]}::DOUBLE END)" for i, m in enumerate(pf.METRICS))


SQL_PROFILE = f"""WITH p AS ({SQL_GATE_PARTS}), {SQL_ICC}, {SQL_DCC}, {SQL_SIZES}, {SQL_METRICS}, {SQL_SCORES}, named AS ({SQL_DOMAIN})
SELECT doc_id, type, domain, n_tokens, RC, ICC, DCC, BI, SC, (RC + ICC + DCC + BI + SC) / 5.0::DOUBLE AS overall, {SQL_WEIGHTED} AS weighted_overall,
  CASE WHEN ICC >= 0.70 THEN 'strong' WHEN ICC >= 0.40 THEN 'usable' ELSE 'weak' END AS icc_level,
  CASE type WHEN 'code' THEN greatest(30, CASE WHEN n_tokens < 1000 THEN 50 WHEN n_tokens > 10000 THEN 150 ELSE 100 END - 30)
    WHEN 'table' THEN greatest(15, CASE WHEN n_tokens < 1000 THEN 50 WHEN n_tokens > 10000 THEN 150 ELSE 100 END // 2)
    ELSE CASE WHEN n_tokens < 1000 THEN 50 WHEN n_tokens > 10000 THEN 150 ELSE 100 END END AS sug_n_min,
  CASE WHEN type = 'code' THEN 300 - CASE WHEN n_tokens < 1000 THEN 50 ELSE 0 END WHEN n_tokens < 1000 THEN 250 WHEN n_tokens > 10000 THEN 600 ELSE 500 END AS sug_n_max,
  CASE WHEN ICC > 0.60 THEN 0.10::DOUBLE WHEN ICC < 0.30 THEN 0.20::DOUBLE ELSE 0.15::DOUBLE END AS sug_tau_low, CASE WHEN RC > 0.80 THEN 0.40::DOUBLE ELSE 0.45::DOUBLE END AS sug_tau_high
FROM metrics JOIN named USING (doc_id)"""


@register("document_profile", SQL_PROFILE)
def document_profile(spark, sf_dir):
    found = pf.profiles(docs(spark, sf_dir))
    return found.select("doc_id", "type", "domain", F.col("n_tokens").cast("long").alias("n_tokens"), *pf.METRICS, "overall", "weighted_overall", pf.metric_level(F.col("ICC")).alias("icc_level"), "sug_n_min", "sug_n_max", "sug_tau_low", "sug_tau_high")


@register("profile_bootstrap")
def profile_bootstrap(spark, sf_dir):
    return pf.bootstrap(docs(spark, sf_dir))
