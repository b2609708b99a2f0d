"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations


def q(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strings(ws) -> str:
    return "[" + ", ".join(q(w) for w in dict.fromkeys(ws)) + "]"


def words(t: str) -> str:
    return rf"list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x <> '')"


def tokens(t: str) -> str:
    return rf"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+')"


def content(t: str, stop) -> str:
    kept = f"list_filter({tokens(t)}, lambda x: length(x) >= 2 AND NOT list_contains({strings(stop)}, x))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {tokens(t)} END"


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def parts(split: str) -> str:
    """Stripped non-empty elements of a list."""
    return f"list_filter(list_transform({split}, lambda x: {strip('x')}), lambda x: x <> '')"


def full_lines(t: str) -> str:
    return parts(f"string_split({t}, chr(10))")


def sentences(t: str) -> str:
    """RE2 has no lookbehind: marks are put behind the ends first, then the text is split at them."""
    marked = rf"regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g')"
    marked = rf"regexp_replace({marked}, '\n+(\s*(?:#{{1,6}}\s+|Article\s+\w+|[-*+]\s+|\d+[.)]\s+))', chr(1) || '\1', 'g')"
    return parts(f"string_split({marked}, chr(1))")


def blocks(t: str) -> str:
    paragraphs = parts(rf"regexp_split_to_array({t}, '\n{{2,}}')")
    return f"CASE WHEN len({paragraphs}) > 1 THEN {paragraphs} ELSE {full_lines(t)} END"


def count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, {q(pattern)}))"


def chars(t: str, *cs: str) -> str:
    return "(" + " + ".join(f"(length({t}) - length(replace({t}, {q(c)}, '')))" for c in cs) + ")"


def clip(x: str) -> str:
    return f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"


def jaccard(a: str, b: str) -> str:
    """Of two lists of distinct elements."""
    both = f"len(list_intersect({a}, {b}))"
    return f"CASE WHEN len({a}) + len({b}) > 0 THEN {both}::DOUBLE / (len({a}) + len({b}) - {both}) ELSE 0.0::DOUBLE END"


def bucket(t: str, dim: int) -> str:
    return f"(CAST('0x' || substr(md5({t}), 1, 8) AS BIGINT) % {dim})"


#: documents cut into windows of 100 words: chunks(doc_id, idx, text, n_words), idx from 0.
CHUNKS = rf"""chunks AS (
  SELECT doc_id, CAST(i AS INTEGER) AS idx, array_to_string(w[i * 100 + 1 : i * 100 + 100], ' ') AS text, least(100, len(w) - i * 100) AS n_words
  FROM (SELECT doc_id, w, unnest(range(0, CAST(ceil(len(w) / 100.0) AS BIGINT))) AS i FROM (SELECT doc_id, {words('text')} AS w FROM documents))
)"""
