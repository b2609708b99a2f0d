"""Queries of the chunk evaluation (S2, S8), over windows of 100 words as two strategies: windows, and windows overlapping by 20."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluate, windows
from . import sql
from .catalog import register
from .q_profile import SQL_HEADING, docs
from .q_signals import SQL_COMPOSITE, SQL_DIST, SQL_ICC, SQL_MULTI, SQL_PAIRS, _sql_cosine


def candidates(spark, sf_dir):
    """chunks of both strategies; start and end count words, times ten."""
    d = docs(spark, sf_dir)
    a = windows.sliding_window(d).withColumns({"strategy": F.lit("plain"), "start": F.col("idx") * 1000})
    b = windows.sliding_window(d, 100, 20).withColumns({"strategy": F.lit("overlapping"), "start": F.col("idx") * 800})
    return a.unionByName(b).withColumn("end", F.col("start") + F.col("n_words") * 10).select("doc_id", "strategy", "idx", "text", "start", "end")


SQL_CAND = rf"""{sql.CHUNKS}, w20 AS (SELECT doc_id, w, unnest(range(0, CAST(greatest(ceil((len(w) - 100) / 80.0), 0) AS BIGINT) + 1)) AS i FROM (SELECT doc_id, {sql.words('text')} AS w FROM documents) WHERE len(w) > 0),
cand AS (SELECT doc_id, 'plain' AS strategy, idx, text, idx * 1000 AS start, idx * 1000 + n_words * 10 AS "end" FROM chunks
  UNION ALL SELECT doc_id, 'overlapping', CAST(i AS INTEGER), array_to_string(w[i * 80 + 1 : i * 80 + 100], ' '), i * 800, i * 800 + len(w[i * 80 + 1 : i * 80 + 100]) * 10 FROM w20)"""

S = sql.strip("text")
SQL_BQ = rf"""bq AS (SELECT doc_id, strategy, avg(CASE WHEN len({sql.words('text')}) = 0 THEN 0.5::DOUBLE ELSE 0.55::DOUBLE * regexp_matches({S}, '^(?:\p{{Lu}}|[0-9])')::INT
  + 0.45::DOUBLE * (regexp_matches({S}, '[.!?:;}}\]`]$') OR len({sql.words('text')}) < 30)::INT END) AS boundary_quality FROM cand GROUP BY ALL)"""


@register("boundary_quality", f"WITH {SQL_CAND}, {SQL_BQ} SELECT * FROM bq")
def boundary_quality(spark, sf_dir):
    return evaluate.boundary_quality(candidates(spark, sf_dir))


#: Of documents(doc_id, text) in `docs` and chunks in `cand`: RE2 has no look-around, so a mark is put before every anchor.
def _sql_structure(docs_table: str = "documents") -> str:
    marked = rf"regexp_replace(replace(text, chr(1), ' '), {sql.q('(?im)(' + evaluate.ANCHOR + ')')}, chr(1) || '\1', 'g')"
    return rf"""sparts AS (SELECT doc_id, unnest(p) AS part, generate_subscripts(p, 1) AS k FROM (SELECT doc_id, string_split({marked}, chr(1)) AS p FROM {docs_table})),
splaced AS (SELECT doc_id, k, part, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM sparts),
sunits AS (SELECT doc_id, k, a, a + length(part) AS b, round_even(greatest(len({sql.words('part')}), 1) / {evaluate.UNIT_WORDS}.0::DOUBLE, 0) AS e FROM splaced WHERE k > 1),
sheld AS (SELECT u.doc_id, c.strategy, u.k, greatest(any_value(e), 1.0::DOUBLE) AS e, max((abs(greatest(c.start, 0) - a) <= {evaluate.TOLERANCE})::INT) AS aligned,
    count(*) FILTER (WHERE greatest(c.start, 0) > a + {evaluate.TOLERANCE} AND greatest(c.start, 0) < b - {evaluate.TOLERANCE}) AS inside FROM sunits u JOIN cand c ON u.doc_id = c.doc_id GROUP BY u.doc_id, c.strategy, u.k),
sfound AS (SELECT doc_id, strategy, {sql.clip("0.62::DOUBLE * avg(aligned) + 0.38::DOUBLE * avg(1.0::DOUBLE - least(1.0::DOUBLE, greatest(0.0::DOUBLE, inside - e) / e))")} AS found FROM sheld GROUP BY ALL),
st AS (SELECT doc_id, strategy, coalesce(found, boundary_quality) AS structure_integrity FROM bq LEFT JOIN sfound USING (doc_id, strategy))"""


# The documents' texts as articles of 100 words, and chunks that begin at each, or behind every third, article's beginning.
SQL_ARTICLES = f"""{sql.CHUNKS}, arts AS (SELECT doc_id, idx, 'Article ' || (idx + 1) || chr(10) || text AS text FROM chunks),
articles AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS text FROM arts GROUP BY doc_id),
acand AS (SELECT doc_id, idx, text, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM arts),
cand AS (SELECT doc_id, 'articles' AS strategy, idx, text, start FROM acand UNION ALL SELECT doc_id, 'thirds', idx, text, start + 100 FROM acand WHERE idx % 3 = 0)"""


def as_articles(spark, sf_dir):
    """The documents' texts as articles of 100 words."""
    c = windows.sliding_window(docs(spark, sf_dir))
    return c.select("doc_id", "idx", F.concat(F.lit("Article "), F.col("idx") + 1, F.lit("\n"), "text").alias("text"))


def joined_articles(arts):
    rows = F.array_sort(F.collect_list(F.struct("idx", "text")))
    return arts.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("text"))


@register("structure_integrity", f"WITH {SQL_ARTICLES}, {SQL_BQ}, {_sql_structure('articles')} SELECT * FROM st")
def structure_integrity(spark, sf_dir):
    arts = as_articles(spark, sf_dir)
    before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    placed = arts.withColumn("start", F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)))
    thirds = placed.filter("idx % 3 = 0").withColumns({"strategy": F.lit("thirds"), "start": F.col("start") + 100})
    return evaluate.structure_integrity(placed.withColumn("strategy", F.lit("articles")).unionByName(thirds), joined_articles(arts))


SQL_SPANS = """sp AS (SELECT doc_id, strategy, least(1.0::DOUBLE, total::DOUBLE / n_chars) AS coverage, 1.0::DOUBLE - least(1.0::DOUBLE, again::DOUBLE / greatest(total, 1)) AS non_redundancy FROM (
  SELECT doc_id, strategy, sum("end" - start) AS total, sum(greatest(least("end", coalesce(seen, 0)) - start, 0)) AS again FROM (
    SELECT *, max("end") OVER (PARTITION BY doc_id, strategy ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM cand) GROUP BY ALL)
  JOIN (SELECT doc_id, length(text) AS n_chars FROM documents) USING (doc_id))"""


@register("span_coverage", f"WITH {SQL_CAND}, {SQL_SPANS} SELECT doc_id, strategy, coverage FROM sp")
def span_coverage(spark, sf_dir):
    return evaluate.spans(candidates(spark, sf_dir), docs(spark, sf_dir)).select("doc_id", "strategy", "coverage")


@register("span_non_redundancy", f"WITH {SQL_CAND}, {SQL_SPANS} SELECT doc_id, strategy, non_redundancy FROM sp")
def span_non_redundancy(spark, sf_dir):
    return evaluate.spans(candidates(spark, sf_dir), docs(spark, sf_dir)).select("doc_id", "strategy", "non_redundancy")


SQL_DISTINCT = rf"""dsets AS (SELECT doc_id, strategy, idx, list_distinct(list_filter({sql.tokens('text')}, lambda t: length(t) >= 3 AND NOT list_contains({sql.strings(evaluate.STOP_DISTINCT)}, t) AND NOT regexp_matches(t, '^\p{{N}}+$'))) AS a FROM cand),
dis AS (SELECT doc_id, strategy, coalesce(avg(CASE WHEN b IS NULL THEN NULL WHEN least(len(a), len(b)) = 0 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE - len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) END), 1.0::DOUBLE) AS distinctness
  FROM (SELECT *, lead(a) OVER (PARTITION BY doc_id, strategy ORDER BY idx) AS b FROM dsets) GROUP BY ALL)"""


@register("token_distinctness", f"WITH {SQL_CAND}, {SQL_DISTINCT} SELECT * FROM dis")
def token_distinctness(spark, sf_dir):
    return evaluate.distinctness(candidates(spark, sf_dir))


SQL_COHESION = rf"""csents AS (SELECT doc_id, strategy, idx, {sql.parts(r"string_split(regexp_replace(text, '([.!?\n])\s+', '\1' || chr(1), 'g'), chr(1))")} AS s FROM cand),
csets AS (SELECT doc_id, strategy, idx, pos, list_distinct({sql.tokens('x')}) AS a FROM (SELECT doc_id, strategy, idx, unnest(s) AS x, generate_subscripts(s, 1) AS pos FROM csents)),
ceach AS (SELECT doc_id, strategy, idx, avg(CASE WHEN b IS NOT NULL AND len(a) + len(b) > 0 THEN {sql.jaccard('a', 'b')} END) AS c FROM (SELECT *, lead(a) OVER (PARTITION BY doc_id, strategy, idx ORDER BY pos) AS b FROM csets) GROUP BY ALL),
coh AS (SELECT d.doc_id, d.strategy, avg(coalesce(c, 0.55::DOUBLE)) AS cohesion FROM cand d LEFT JOIN ceach e ON d.doc_id = e.doc_id AND d.strategy = e.strategy AND d.idx = e.idx GROUP BY ALL)"""


@register("chunk_cohesion", f"WITH {SQL_CAND}, {SQL_COHESION} SELECT * FROM coh")
def chunk_cohesion(spark, sf_dir):
    return evaluate.cohesion(candidates(spark, sf_dir))


def _sql_sizes(name: str, source: str, share: float) -> str:
    target = max(100.0, 500 * share)
    return f"""{name} AS (SELECT *, 1.0::DOUBLE - least(1.0::DOUBLE, abs(mean_words - {target}::DOUBLE) / {target}::DOUBLE) AS avg_fit FROM (SELECT doc_id, strategy, count(*) AS n_chunks, avg(n) AS mean_words, stddev_pop(n) AS sd_words,
  avg((n BETWEEN 100 AND 500)::INT) AS in_range, avg(greatest(0.0::DOUBLE, (n - 500) / 500)) AS oversize, avg(greatest(0.0::DOUBLE, (100 - n) / 100)) AS tiny
  FROM (SELECT doc_id, strategy, greatest(len({sql.words('text')}), 1)::DOUBLE AS n FROM {source}) GROUP BY ALL))"""


SQL_CANDIDATES = f"""{SQL_CAND}, {_sql_sizes('sz', 'cand', 0.72)}, {SQL_BQ}, {_sql_structure()}, {SQL_SPANS}, {SQL_DISTINCT}, {SQL_COHESION}, tot AS (SELECT doc_id, greatest(len({sql.words('text')}), 1) AS total_words FROM documents),
scored AS (SELECT doc_id, strategy, n_chunks, {sql.clip('''0.23::DOUBLE * greatest(0.0::DOUBLE, 0.50::DOUBLE * in_range + 0.35::DOUBLE * avg_fit - 0.10::DOUBLE * oversize - 0.05::DOUBLE * tiny)
  + 0.18::DOUBLE * (1.0::DOUBLE - least(1.0::DOUBLE, abs(n_chunks - greatest(1.0::DOUBLE, total_words / 360.0::DOUBLE)) / greatest(1.0::DOUBLE, total_words / 360.0::DOUBLE)))
  + 0.17::DOUBLE * boundary_quality + 0.14::DOUBLE * structure_integrity + 0.12::DOUBLE * cohesion + 0.09::DOUBLE * (0.45::DOUBLE * non_redundancy + 0.55::DOUBLE * distinctness) + 0.04::DOUBLE * coverage''')} AS score
  FROM sz JOIN tot USING (doc_id) JOIN bq USING (doc_id, strategy) JOIN st USING (doc_id, strategy) JOIN sp USING (doc_id, strategy) JOIN dis USING (doc_id, strategy) JOIN coh USING (doc_id, strategy))"""


@register("strategy_rank", f"""WITH {SQL_CANDIDATES} SELECT *, rank = 1 AS winner FROM (
  SELECT doc_id, strategy, n_chunks, score, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, strategy) AS rank FROM scored)""")
def strategy_rank(spark, sf_dir):
    return evaluate.candidate_scores(candidates(spark, sf_dir), docs(spark, sf_dir)).select("doc_id", "strategy", "n_chunks", "score", "rank", "winner")


SQL_QUALITY = rf"""qsets AS (SELECT doc_id, strategy, idx, list_distinct({sql.content('text', tx.STOP_CHUNKS)}) AS a FROM cand),
qdiv AS (SELECT doc_id, strategy, coalesce(avg(CASE WHEN b IS NOT NULL THEN 1.0::DOUBLE - ({sql.jaccard('a', 'b')}) END), 0.5::DOUBLE) AS divergence FROM (SELECT *, lead(a) OVER (PARTITION BY doc_id, strategy ORDER BY idx) AS b FROM qsets) GROUP BY ALL),
qmark AS (SELECT doc_id, strategy, avg((({SQL_HEADING}) OR regexp_matches(x, '^(?:\p{{Lu}}|[0-9])'))::INT) AS integrity, avg((t = '' OR regexp_matches(t, '(?:[.!?:;}}\]]|```)$'))::INT) AS completion
  FROM (SELECT doc_id, strategy, {S} AS t, string_split({S}, chr(10))[1] AS x FROM cand) GROUP BY ALL)"""


@register("strategy_quality", f"""WITH {SQL_CAND}, {_sql_sizes('sz', 'cand', 0.72)}, {SQL_QUALITY} SELECT doc_id, strategy, n_chunks,
  0.24::DOUBLE * avg_fit + 0.18::DOUBLE * (1.0::DOUBLE - least(1.0::DOUBLE, sd_words / greatest(mean_words, 1.0::DOUBLE))) + 0.18::DOUBLE * in_range + 0.17::DOUBLE * divergence + 0.13::DOUBLE * integrity + 0.10::DOUBLE * completion AS quality
FROM sz JOIN qdiv USING (doc_id, strategy) JOIN qmark USING (doc_id, strategy)""")
def strategy_quality(spark, sf_dir):
    return evaluate.quality(candidates(spark, sf_dir))


@register("boundary_hash_dedupe", f"""WITH {SQL_CAND}, h AS (SELECT doc_id, strategy, md5(string_agg(start || ',' || "end", '|' ORDER BY idx)) AS boundary_md5 FROM cand GROUP BY ALL)
SELECT *, min(strategy) OVER (PARTITION BY doc_id, boundary_md5) AS same_as FROM h""")
def boundary_hash_dedupe(spark, sf_dir):
    return evaluate.boundary_hash(candidates(spark, sf_dir))


def _sql_separation(source: str, stop=tuple(evaluate.STOP_SEPARATION)) -> str:
    unwanted = f" AND NOT list_contains({sql.strings(stop)}, t)" if stop else ""
    kept = f"list_filter({sql.tokens('text')}, lambda t: length(t) >= 3{unwanted})"
    return f"""sbags AS (SELECT doc_id, strategy, idx, list_transform({kept}, lambda t: {sql.bucket('t', 128)}) AS x FROM {source}),
sep AS (SELECT doc_id, strategy, coalesce(avg(CASE WHEN len(x) > 0 AND len(y) > 0 THEN {sql.clip('1.0::DOUBLE - coalesce(' + _sql_cosine('x', 'y') + ', 0.0::DOUBLE)')} END), 0.5::DOUBLE) AS separation
  FROM (SELECT *, lead(x) OVER (PARTITION BY doc_id, strategy ORDER BY idx) AS y FROM sbags) GROUP BY ALL)"""


@register("chunk_separation", f"WITH {SQL_CAND}, {_sql_separation('cand')} SELECT * FROM sep")
def chunk_separation(spark, sf_dir):
    d = docs(spark, sf_dir)
    both = [windows.lists(d, 100, k).withColumn("strategy", F.lit(name)) for name, k in (("plain", 0), ("overlapping", 20))]
    return evaluate.separation(both[0]).unionByName(evaluate.separation(both[1]))


@register("final_strategy_score", f"""WITH {SQL_CAND}, {SQL_DIST}, {SQL_PAIRS}, {SQL_MULTI}, {SQL_COMPOSITE}, {SQL_ICC},
plain AS (SELECT * FROM cand WHERE strategy = 'plain'), lastof AS (SELECT doc_id, max(idx) AS last FROM plain GROUP BY doc_id),
realc AS (SELECT p.* FROM plain p JOIN lastof USING (doc_id) WHERE idx < last OR last = 0),
means AS (SELECT r.doc_id, r.strategy, avg(coalesce(icc, 0.5::DOUBLE)) AS icc, avg(1.0::DOUBLE - coalesce(boundary_score, 0.5::DOUBLE)) AS dist, avg(least(coalesce(jsd, 0.0::DOUBLE) * 2.0::DOUBLE, 1.0::DOUBLE)) AS entropy
  FROM realc r LEFT JOIN iccs USING (doc_id, idx) LEFT JOIN composite USING (doc_id, idx) LEFT JOIN distances USING (doc_id, idx) GROUP BY ALL),
{_sql_separation('realc')}, {_sql_sizes('sz', 'realc', 0.70)}
SELECT doc_id, strategy, {sql.clip('0.25::DOUBLE * icc + 0.25::DOUBLE * dist + 0.20::DOUBLE * (0.65::DOUBLE * avg_fit + 0.35::DOUBLE * in_range) + 0.20::DOUBLE * separation + 0.10::DOUBLE * entropy')} AS score
FROM means JOIN sep USING (doc_id, strategy) JOIN sz USING (doc_id, strategy)""")
def final_strategy_score(spark, sf_dir):
    return evaluate.final_of_documents(windows.lists(docs(spark, sf_dir)).withColumn("strategy", F.lit("plain")))
