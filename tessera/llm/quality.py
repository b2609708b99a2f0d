"""Line-first cleaning of documents.

Every line with a word is held against rules; failing lines are removed, and a document that loses more than `max_loss` of the
characters of its words is rejected. Beside them stand document statistics of the usual kind, two of which reject by themselves:
too few words, and too large a share of words in repeated three-word windows.

Line rules (the first that fails names the reason):
  boilerplate  licence, copyright, cookie, privacy and similar standard phrases
  navigation   at least three separators (| » › • ·) standing alone, and one for every four words or more
  symbols      more than one of `#*$%&|<>` for two words
  shouting     five words or more, and more than half of their characters are capitals
  repeated     equal to an earlier line of the document
  punctuation  fewer than `short_words` words and no closing punctuation at the end

Words are runs of other than the six ASCII white-space characters; all counts are over the whole text.

Defined results: a null or empty text has no words, fails the base rules and is rejected; its cleaned text is empty. Repeated
rows and ids are judged alike and all kept. An empty table gives an empty result. Columns named like the added ones are replaced.
Each document is handled by itself: no shuffle, and memory bounded by an Arrow batch.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Standard phrases, also read by the query's SQL.
BOILERPLATE = (
    r"(?i)(all rights reserved|licensed under|released under the|under the terms of the|is licensed|copyright (\(c\)|©|[0-9]{4})|^ *©|"
    r"terms of (use|service)|privacy policy|cookie policy|(uses|accept|enable) (all )?cookies|enable javascript|lorem ipsum|"
    r"subscribe to our|sign up for our|click here|back to top|skip to (main )?content)"
)
SEPARATOR = r"(^|[ \t])[|»›•·]([ \t]|$)"
CLOSED = r"[.!?:;…\"'”’»)\]}。！？][ \t\r\x0B\x0C]*$"
SYMBOLS = r"[#*$%&|<>]"
UPPER = r"\p{Lu}"


@dataclass(frozen=True)
class Limits:
    min_words: int = 50
    max_repeat_pct: int = 50
    max_loss_pct: int = 50
    short_words: int = 20


_BOILERPLATE, _SEPARATOR, _CLOSED = (regex.compile(x) for x in (BOILERPLATE, r"(?:^|(?<=[ \t]))[|»›•·](?=[ \t]|$)", CLOSED))
_UPPER = regex.compile(UPPER)
#: Every match of BOILERPLATE holds one of these once case is folded.
HINTS = (
    "all rights reserved", "licensed", "released under the", "under the terms of the", "copyright", "©", "terms of ", "privacy policy", "cookie",
    "enable javascript", "lorem ipsum", "subscribe to our", "sign up for our", "click here", "back to top", "skip to ",
)
#: Bytes of UTF-8: white space and all but the first of a character; A-Z and the first of characters beyond ASCII.
_NO_CHAR, _MAYBE_UPPER = b" \t\n\x0b\x0c\r" + bytes(range(0x80, 0xC0)), bytes(range(65, 91)) + bytes(range(0xC0, 0x100))

FIELDS = (("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("n_lines", "long"), ("n_removed_lines", "long"), ("lost_chars", "long"), ("cleaned", "string"))


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter(map(number.setdefault, words, count()), np.int64, n)  # a word's first place
    pair = ids[:-2] * n + ids[1:-1]
    if n > 2_000_000:  # three numbers no longer fit into one
        pair = np.unique(pair, return_inverse=True)[1]
    _, where, counts = np.unique(pair * n + ids[2:], return_inverse=True, return_counts=True)
    again = counts[where] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def folded(text: str) -> str:
    """The text as a case-insensitive pattern reads it."""
    found = text.casefold()
    return found if found.isascii() else found.replace("i\u0307", "i").replace("ı", "i")


def line_fault(line: str, raw: bytes, n_words: int, chars: int, seen: set[str], limits: Limits, hinted: bool = True) -> str | None:
    """raw: the line as UTF-8; hinted: whether one of HINTS may be in it."""
    if hinted and _BOILERPLATE.search(line):
        return "boilerplate"
    if sum(map(line.count, "|»›•·")) >= 3:
        separators = len(_SEPARATOR.findall(line))
        if separators >= 3 and 4 * separators >= n_words:
            return "navigation"
    if 2 * sum(map(raw.count, b"#*$%&|<>")) > n_words:
        return "symbols"
    if n_words >= 5 and 2 * (len(raw) - len(raw.translate(None, _MAYBE_UPPER))) > chars and 2 * len(_UPPER.findall(line)) > chars:
        return "shouting"
    if line in seen:
        return "repeated"
    if n_words < limits.short_words and not _CLOSED.search(line):
        return "punctuation"
    return None


def clean(text: str | None, limits: Limits = Limits()) -> tuple:
    """The values of FIELDS."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    low = folded(text)
    hints = [x for x in HINTS if x in low]
    seen: set[str] = set()
    words, kept_lines, lines, chars, lost, duplicates, removed = [], [], 0, 0, 0, 0, 0
    for line, part in zip(text.split("\n"), raw.split(b"\n")):
        found = part.split()
        if not found:
            continue
        words += found
        lines += 1
        c = len(part.translate(None, _NO_CHAR))
        chars += c
        duplicates += line in seen
        if line_fault(line, part, len(found), c, seen, limits, bool(hints)):
            lost += c
            removed += 1
        else:
            kept_lines.append(line)
        seen.add(line)
    n, repeated = len(words), repeat_words(words)
    failed = n < limits.min_words or 100 * repeated > limits.max_repeat_pct * n
    kept = not failed and 100 * lost <= limits.max_loss_pct * chars
    return n, chars, sum(map(raw.count, b"#*$%&|<>")), duplicates, repeated, failed, kept, lines, removed, lost, "\n".join(kept_lines)


def apply_rules(docs: DataFrame, limits: Limits = Limits(), cleaned: bool = True) -> DataFrame:
    """docs(text, ...) with FIELDS added; without the cleaned text if it isn't asked for."""
    fields = [f for f in FIELDS if cleaned or f[0] != "cleaned"]
    added = {f for f, _ in FIELDS}
    base = docs.select(*[c for c in docs.columns if c not in added])
    out = T.StructType([*base.schema.fields, *[T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]])
    schema = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            rows = [clean(t, limits) for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            columns = list(zip(*rows)) or [()] * len(FIELDS)
            new = [pa.array(columns[i], schema.field(f).type) for i, (f, _) in enumerate(FIELDS) if f in schema.names]
            yield pa.RecordBatch.from_arrays([*(x.cast(schema.field(i).type) for i, x in enumerate(b.columns)), *new], schema=schema)

    return base.mapInArrow(run, out)
