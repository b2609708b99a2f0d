"""Queries of the boundary signals (S3) and scores (S4) over windows of 100 words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import boundary, measures, signals, windows
from . import sql
from .catalog import register
from .q_profile import docs


def chunks(spark, sf_dir):
    return windows.sliding_window(docs(spark, sf_dir))


def lists(spark, sf_dir, *keep):
    """The same chunks, a row a document."""
    return windows.lists(docs(spark, sf_dir), keep=keep)


SQL_DIST = f"""tf AS (SELECT doc_id, idx, tok, count(*)::DOUBLE / any_value(n) AS p FROM (
    SELECT doc_id, idx, len({sql.tokens('text')}) AS n, unnest({sql.tokens('text')}) AS tok FROM chunks) GROUP BY doc_id, idx, tok),
pairs AS (SELECT doc_id, idx FROM chunks SEMI JOIN (SELECT doc_id, idx - 1 AS idx FROM chunks) USING (doc_id, idx)),
sides AS (SELECT doc_id, idx, tok, p, 0.0::DOUBLE AS q FROM tf UNION ALL SELECT doc_id, idx - 1, tok, 0.0::DOUBLE, p FROM tf),
joint AS (SELECT doc_id, idx, tok, sum(p) AS p, sum(q) AS q FROM sides GROUP BY ALL),
dist AS (SELECT doc_id, idx, {sql.clip("sum(0.5::DOUBLE * (CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + 0.5::DOUBLE * (CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END))")} AS jsd,
    {sql.clip("sqrt(sum((sqrt(p) - sqrt(q)) ** 2)) / sqrt(2.0::DOUBLE)")} AS hellinger FROM joint GROUP BY ALL HAVING max(p) > 0 AND max(q) > 0),
distances AS (SELECT doc_id, idx, coalesce(jsd, 0.5::DOUBLE) AS jsd, coalesce(hellinger, 0.5::DOUBLE) AS hellinger FROM pairs LEFT JOIN dist USING (doc_id, idx))"""


@register("jsd_adjacent", f"WITH {sql.CHUNKS}, {SQL_DIST} SELECT doc_id, idx, jsd FROM distances")
def jsd_adjacent(spark, sf_dir):
    return signals.distances(lists(spark, sf_dir)).select("doc_id", "idx", "jsd")


@register("hellinger_adjacent", f"WITH {sql.CHUNKS}, {SQL_DIST} SELECT doc_id, idx, hellinger FROM distances")
def hellinger_adjacent(spark, sf_dir):
    return signals.distances(lists(spark, sf_dir)).select("doc_id", "idx", "hellinger")


SQL_PMI = f"""toks AS (SELECT doc_id, idx, unnest(c) AS tok, generate_subscripts(c, 1) AS pos FROM (SELECT doc_id, idx, {sql.content('text', tx.STOP_SIGNALS)} AS c FROM chunks)),
ranked AS (SELECT doc_id, idx, tok, row_number() OVER (PARTITION BY doc_id, idx ORDER BY count(*) DESC, min(pos)) AS r FROM toks GROUP BY doc_id, idx, tok),
tops AS (SELECT c.doc_id, c.idx, list(r.tok) FILTER (WHERE r.tok IS NOT NULL) AS terms FROM chunks c LEFT JOIN (SELECT * FROM ranked WHERE r <= 8) r ON c.doc_id = r.doc_id AND c.idx = r.idx GROUP BY ALL),
pmi AS (SELECT a.doc_id, a.idx, CASE WHEN a.terms IS NULL OR b.terms IS NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE - {sql.jaccard('a.terms', 'b.terms')} END AS pmi_drop
  FROM tops a JOIN tops b ON a.doc_id = b.doc_id AND a.idx + 1 = b.idx)"""


@register("pmi_drop", f"WITH {sql.CHUNKS}, {SQL_PMI} SELECT doc_id, idx, pmi_drop FROM pmi")
def pmi_drop(spark, sf_dir):
    return signals.pmi_drop(lists(spark, sf_dir))


SQL_DEPTH = "CASE " + " ".join(f"WHEN regexp_matches(trim(b.text), {sql.q('(?i)' + p)}) THEN {1.0 - (d - 1) / 6.0}::DOUBLE" for p, d in signals.DEPTHS) + " ELSE 0.0::DOUBLE END"
SQL_DEPTHS = f"depths AS (SELECT a.doc_id, a.idx, {SQL_DEPTH} AS depth_change FROM chunks a JOIN chunks b ON a.doc_id = b.doc_id AND a.idx + 1 = b.idx)"


@register("depth_change", f"WITH {sql.CHUNKS}, {SQL_DEPTHS} SELECT doc_id, idx, depth_change FROM depths")
def depth_change(spark, sf_dir):
    return windows.with_next(chunks(spark, sf_dir)).select("doc_id", "idx", signals.depth_change(F.col("text_b")).alias("depth_change"))


def _sql_cosine(x: str, y: str) -> str:
    times = lambda v: f"len(list_filter({v}, lambda e: e = d))::DOUBLE"
    squares = lambda v: f"list_sum(list_transform(list_distinct({v}), lambda d: {times(v)} ** 2))"
    return f"list_sum(list_transform(list_distinct({x}), lambda d: {times(x)} * {times(y)})) / sqrt({squares(x)} * {squares(y)})"


SQL_DRIFT = f"""bags AS (SELECT doc_id, idx, list_transform({sql.content('text', tx.STOP_SIGNALS)}, lambda t: {sql.bucket('t', 64)}) AS x FROM chunks),
drifts AS (SELECT a.doc_id, a.idx, CASE WHEN len(a.x) = 0 OR len(b.x) = 0 THEN 0.5::DOUBLE ELSE {sql.clip('1.0::DOUBLE - ' + _sql_cosine('a.x', 'b.x'))} END AS drift
  FROM bags a JOIN bags b ON a.doc_id = b.doc_id AND a.idx + 1 = b.idx)"""


@register("drift", f"WITH {sql.CHUNKS}, {SQL_DRIFT} SELECT doc_id, idx, drift FROM drifts")
def drift(spark, sf_dir):
    return signals.drift(lists(spark, sf_dir))


SQL_ENTROPY = rf"""both_texts AS (SELECT a.doc_id, a.idx AS boundary, a.text || chr(10) || chr(10) || b.text AS t FROM chunks a JOIN chunks b ON a.doc_id = b.doc_id AND a.idx + 1 = b.idx),
split AS (SELECT doc_id, boundary, list_filter({sql.parts(r"string_split(regexp_replace(t, '([.!?\n])\s+', '\1' || chr(1), 'g'), chr(1))")}, lambda x: len({sql.words('x')}) >= 3) AS s FROM both_texts),
sents AS (SELECT doc_id, boundary, unnest(s) AS x, generate_subscripts(s, 1) AS idx FROM split),
stf AS (SELECT doc_id, boundary, idx, tok, count(*)::DOUBLE / any_value(n) AS p FROM (SELECT doc_id, boundary, idx, len({sql.tokens('x')}) AS n, unnest({sql.tokens('x')}) AS tok FROM sents) GROUP BY ALL),
sjoint AS (SELECT doc_id, boundary, idx, tok, sum(p) AS p, sum(q) AS q FROM (SELECT doc_id, boundary, idx, tok, p, 0.0::DOUBLE AS q FROM stf UNION ALL SELECT doc_id, boundary, idx - 1, tok, 0.0::DOUBLE, p FROM stf) GROUP BY ALL),
sjsd AS (SELECT doc_id, boundary, idx, {sql.clip("sum(0.5::DOUBLE * (CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END) + 0.5::DOUBLE * (CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END))")} AS jsd
  FROM sjoint GROUP BY ALL HAVING max(p) > 0 AND max(q) > 0),
ssum AS (SELECT doc_id, boundary, sum(jsd) AS jsd, count(*) AS k FROM sjsd GROUP BY ALL),
rates AS (SELECT s.doc_id, s.boundary AS idx, CASE WHEN len(s.s) < 2 THEN 0.0::DOUBLE ELSE {sql.clip('(coalesce(jsd, 0.0::DOUBLE) + 0.5::DOUBLE * (len(s.s) - 1 - coalesce(k, 0))) / (len(s.s) - 1)')} END AS entropy_rate
  FROM split s LEFT JOIN ssum u ON s.doc_id = u.doc_id AND s.boundary = u.boundary)"""


@register("entropy_rate", f"WITH {sql.CHUNKS}, {SQL_ENTROPY} SELECT doc_id, idx, entropy_rate FROM rates")
def entropy_rate(spark, sf_dir):
    return signals.entropy_rate(lists(spark, sf_dir))


SQL_FEATURES = f"""{SQL_DIST}, {SQL_PMI}, {SQL_DEPTHS}, {SQL_DRIFT}, {SQL_ENTROPY}, features AS (
  SELECT *, {sql.clip(" + ".join(f"{w}::DOUBLE * {k}" for k, w in signals.HYBRID.items()))} AS hybrid
  FROM distances JOIN pmi USING (doc_id, idx) JOIN depths USING (doc_id, idx) JOIN drifts USING (doc_id, idx) JOIN rates USING (doc_id, idx))"""


@register("hybrid_signal", f"WITH {sql.CHUNKS}, {SQL_FEATURES} SELECT doc_id, idx, hybrid FROM features")
def hybrid_signal(spark, sf_dir):
    return signals.features(lists(spark, sf_dir)).select("doc_id", "idx", "hybrid")


SQL_THRESHOLDS = """thresholds AS (SELECT doc_id, low, CASE WHEN low >= high THEN low + 0.08::DOUBLE ELSE high END AS high FROM (
  SELECT doc_id, quantile_cont(round(jsd, 9), 0.25) AS low, quantile_cont(round(jsd, 9), 0.75) AS high FROM distances GROUP BY doc_id))"""


@register("percentile_thresholds", f"WITH {sql.CHUNKS}, {SQL_DIST}, {SQL_THRESHOLDS} SELECT doc_id, round(low, 6) AS low, round(high, 6) AS high FROM thresholds")
def percentile_thresholds(spark, sf_dir):
    return measures.limits(lists(spark, sf_dir), "jsd").select("doc_id", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@register("boundary_types", f"""WITH {sql.CHUNKS}, {SQL_DIST}, {SQL_THRESHOLDS}
SELECT c.doc_id, c.idx, CASE WHEN d.jsd IS NULL THEN 'end' WHEN round(d.jsd, 9) > high THEN 'hard' WHEN round(d.jsd, 9) < low THEN 'merge' ELSE 'soft' END AS boundary_type
FROM chunks c LEFT JOIN distances d USING (doc_id, idx) LEFT JOIN thresholds t ON c.doc_id = t.doc_id""")
def boundary_types(spark, sf_dir):
    return measures.measure(lists(spark, sf_dir), ("boundary_type",))


SQL_FLAGSHIP = f"""WITH {sql.CHUNKS}, {SQL_DIST}
SELECT * FROM (SELECT lang, doc_id, idx, round(jsd, 9) AS jsd, row_number() OVER (PARTITION BY lang ORDER BY round(jsd, 9) DESC, doc_id, idx) AS rank FROM distances JOIN documents USING (doc_id)) WHERE rank <= 10"""


@register("topic_shifts", SQL_FLAGSHIP)
def topic_shifts(spark, sf_dir):
    """The ten strongest shifts between neighbouring windows in every language."""
    found = measures.measure(lists(spark, sf_dir, "lang"), ("jsd",), "next", ("lang", "doc_id")).withColumn("jsd", F.round("jsd", 9))
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("jsd"), "doc_id", "idx"))).filter("r <= 10")
    return ranked.select("lang", "doc_id", "idx", "jsd", F.col("r").cast("long").alias("rank"))


SQL_LEX = rf"""CASE WHEN len(ta) < 2 OR len(tb) < 2 THEN {sql.jaccard('list_distinct(ta)', 'list_distinct(tb)')} ELSE
  coalesce(list_sum(list_transform(list_distinct(ga), lambda d: least(len(list_filter(ga, lambda e: e = d)), len(list_filter(gb, lambda e: e = d))))), 0)::DOUBLE / len(ga) END"""
SQL_SYN = r"""CASE WHEN greatest(len(fa), len(fb)) = 0 THEN 0.0::DOUBLE ELSE
  coalesce(list_sum(list_transform(list_distinct(fa), lambda d: least(len(list_filter(fa, lambda e: e = d)), len(list_filter(fb, lambda e: e = d))))), 0)::DOUBLE / greatest(len(fa), len(fb)) END"""
SQL_TYPES = sql.jaccard("list_distinct(ta)", "list_distinct(tb)")


def _sql_prepared(source: str) -> str:
    """Token arrays of source(doc_id, idx, a, b)."""
    pair = lambda t: f"list_transform(range(1, len({t})), lambda i: {t}[i] || ' ' || {t}[i + 1])"
    only = lambda t: f"list_filter({t}, lambda x: list_contains({sql.strings(tx.FUNCTION_WORDS)}, x))"
    return f"SELECT *, {pair('ta')} AS ga, {pair('tb')} AS gb, {only('ta')} AS fa, {only('tb')} AS fb FROM (SELECT *, {sql.tokens('a')} AS ta, {sql.tokens('b')} AS tb FROM {source})"


SQL_PAIRS = f"lr AS (SELECT b.doc_id, b.idx, a.text AS a, b.text AS b FROM chunks a JOIN chunks b ON a.doc_id = b.doc_id AND a.idx + 1 = b.idx), prep AS ({_sql_prepared('lr')})"


@register("bleu_bigram", f"WITH {sql.CHUNKS}, {SQL_PAIRS} SELECT doc_id, idx, {SQL_LEX} AS bleu FROM prep")
def bleu_bigram(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", "idx", boundary.ngram_precision().alias("bleu"))


def _pairs(spark, sf_dir):
    order = Window.partitionBy("doc_id").orderBy("idx")
    c = chunks(spark, sf_dir)
    return boundary.prepared(c.select("doc_id", "idx", F.lag("text").over(order).alias("text"), F.col("text").alias("text_b")).filter("text is not null"))


@register("function_word_overlap", f"WITH {sql.CHUNKS}, {SQL_PAIRS} SELECT doc_id, idx, {SQL_SYN} AS syntactic FROM prep")
def function_word_overlap(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", "idx", boundary.syntactic_overlap().alias("syntactic"))


@register("type_jaccard", f"WITH {sql.CHUNKS}, {SQL_PAIRS} SELECT doc_id, idx, {SQL_TYPES} AS token_type FROM prep")
def type_jaccard(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", "idx", boundary.token_types().alias("token_type"))


def _m(t: str, p: str) -> str:
    return f"regexp_matches({t}, {sql.q(p.replace('(?imud)', '(?im)').replace('(?md)', '(?m)'))})"


SQL_STRUCT = sql.clip(f"""0.60::DOUBLE * (CASE WHEN {_m('substr(b, 1, 200)', boundary.ARTICLE)} THEN 0.05::DOUBLE WHEN {_m('substr(b, 1, 200)', boundary.CAPITALS)} THEN 0.10::DOUBLE
  WHEN {_m('substr(b, 1, 200)', boundary.NUMBERED)} THEN 0.25::DOUBLE ELSE 0.50::DOUBLE END)
  + 0.40::DOUBLE * (CASE WHEN {_m('a', boundary.ARTICLE)} AND {_m('b', boundary.ARTICLE)} THEN 0.20::DOUBLE WHEN {_m('a', boundary.NUMBERED)} AND {_m('b', boundary.NUMBERED)} AND NOT {_m('b', boundary.ARTICLE)} THEN 0.65::DOUBLE
  WHEN NOT {_m('a', boundary.ARTICLE)} AND NOT {_m('b', boundary.ARTICLE)} THEN 0.55::DOUBLE ELSE 0.30::DOUBLE END)""")


@register("structural_continuity", f"WITH {sql.CHUNKS}, {SQL_PAIRS} SELECT doc_id, idx, {SQL_STRUCT} AS structural FROM lr")
def structural_continuity(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", "idx", boundary.structural_prose(F.col("text"), F.col("text_b")).alias("structural"))


SQL_MULTI = f"""scaled AS (SELECT doc_id, idx, k, (SELECT string_agg(c.text, ' ' ORDER BY c.idx) FROM chunks c WHERE c.doc_id = o.doc_id AND c.idx >= o.idx - k AND c.idx < o.idx) AS a,
    (SELECT string_agg(c.text, ' ' ORDER BY c.idx) FROM chunks c WHERE c.doc_id = o.doc_id AND c.idx >= o.idx AND c.idx < o.idx + k) AS b FROM chunks o, (VALUES (1), (2), (3)) AS s(k) WHERE idx > 0),
scaled_prep AS ({_sql_prepared('scaled')}),
multi AS (SELECT doc_id, idx, avg(0.4::DOUBLE * {SQL_LEX} + 0.3::DOUBLE * {SQL_SYN} + 0.3::DOUBLE * {SQL_TYPES}) AS multiscale FROM scaled_prep GROUP BY ALL)"""


@register("multiscale", f"WITH {sql.CHUNKS}, {SQL_MULTI} SELECT doc_id, idx, multiscale FROM multi")
def multiscale(spark, sf_dir):
    return boundary.multiscale(lists(spark, sf_dir))


SQL_COMPOSITE = f"""composite AS (SELECT doc_id, idx, {sql.clip(f"0.25::DOUBLE * {SQL_LEX} + 0.20::DOUBLE * {SQL_SYN} + 0.15::DOUBLE * {SQL_TYPES} + 0.20::DOUBLE * {SQL_STRUCT} + 0.20::DOUBLE * ((CASE WHEN len(ta) = 0 OR len(tb) = 0 THEN 0.0::DOUBLE ELSE {_sql_cosine(f'list_transform(ta, lambda t: {sql.bucket("t", 128)})', f'list_transform(tb, lambda t: {sql.bucket("t", 128)})')} END + multiscale) / 2.0::DOUBLE)")} AS boundary_score
  FROM prep JOIN multi USING (doc_id, idx))"""


@register("composite_boundary", f"WITH {sql.CHUNKS}, {SQL_PAIRS}, {SQL_MULTI}, {SQL_COMPOSITE} SELECT doc_id, idx, boundary_score FROM composite")
def composite_boundary(spark, sf_dir):
    return boundary.scores(lists(spark, sf_dir)).select("doc_id", "idx", "boundary_score")


SQL_ICC = rf"""unit_split AS (SELECT doc_id, idx, list_filter({sql.parts(r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))")}, lambda x: len({sql.words('x')}) >= 4) AS u FROM chunks),
unit_sets AS (SELECT doc_id, idx, pos, list_distinct({sql.tokens('x')}) AS a FROM (SELECT doc_id, idx, unnest(u) AS x, generate_subscripts(u, 1) AS pos FROM unit_split)),
unit_pairs AS (SELECT doc_id, idx, a, lead(a) OVER (PARTITION BY doc_id, idx ORDER BY pos) AS b FROM unit_sets),
iccs AS (SELECT c.doc_id, c.idx, coalesce(raw, 0.5::DOUBLE) AS icc FROM chunks c LEFT JOIN (SELECT doc_id, idx, avg({sql.jaccard('a', 'b')}) AS raw FROM unit_pairs WHERE b IS NOT NULL GROUP BY ALL) USING (doc_id, idx))"""


@register("icc", f"WITH {sql.CHUNKS}, {SQL_ICC} SELECT doc_id, idx, icc FROM iccs")
def icc(spark, sf_dir):
    return boundary.coherence(lists(spark, sf_dir))
