"""Column functions over texts: tokens, sentences, blocks, lines, counts.

Patterns are written for the JVM's regex engine: (?U) makes white space Unicode-aware, (?d) keeps newline the only line end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word character and its complement, Unicode letters, digits and the underscore.
W, NOT_W = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"

# Stop words of the profile (S1).
STOP_PROFILE = (
    "the a an and or but is are was were be been being have has had do does did will would could should may might must shall can "
    "to of in for on with at by from as into through during before after above below between out off over under again further "
    "then once here there when where why how all both each few more most other some such no nor not only own same so than too "
    "very just this that these those it its he she they we you i my your his her our their what which who whom about "
    "le la les de des du et en un une dans pour que est sur par avec au aux"
).split()

# Stop words of the chunkers (S2).
STOP_CHUNKS = (
    "the a an and or but is are was were be been being of to in for on with as by from at that this these those it its we you "
    "they he she not no if then than le la les de des du et en un une dans pour que est sur par avec au aux"
).split()

# Stop words of the boundary signals (S3).
STOP_SIGNALS = (
    "the a an and or but is are was were be been being have has had do does did will would could should may might must shall can "
    "to of in for on with at by from as into through during before after here there when where why how all both each few more "
    "most other some such no nor not only own same so than too very just this that these those it its he she they we you i my "
    "your his her our their what which who whom about le la les de des du et en un une dans pour que est sur par avec au aux ce "
    "se si ne pas lui leur ils elles nous vous dont où car mais ni donc comment quand comme tout tous toute"
).split()

# Function words of the syntactic overlap (S4).
FUNCTION_WORDS = (
    "the a an is was are were be been have has had do does did will would could should may might shall can of in on at by for "
    "with about as to le la les de des du et en un une dans pour que qui est sont sur par avec au aux ce se si ne pas ou dont "
    "leur leurs cette son ses tout tous toute toutes plus bien même ainsi comme selon sous entre après avant sans lors"
).split()


#: Unicode's white space.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(SPACES))


def words(text: Column) -> Column:
    """Runs of other than white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def tokens(text: Column, least: int = 1) -> Column:
    """Lower-cased runs of word characters, of at least `least` characters."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"{W}+"), F.lit(0))
    return found if least < 2 else F.filter(found, lambda x: F.length(x) >= least)


def content_tokens(text: Column, stop: list[str]) -> Column:
    """Tokens of two characters or more that aren't stop words; all tokens if none is left."""
    unwanted = list(dict.fromkeys(stop))  # a list of literals becomes a hash set
    both = F.transform(F.array(tokens(text)), lambda t: F.struct(t.alias("every"), F.filter(t, lambda x: (F.length(x) >= 2) & ~x.isin(*unwanted)).alias("kept")))
    return F.element_at(F.transform(both, lambda s: F.when(F.size(s["kept"]) > 0, s["kept"]).otherwise(s["every"])), 1)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def full_lines(text: Column) -> Column:
    """Stripped lines that hold something."""
    return F.filter(F.transform(lines(text), strip), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Split after . ! ? and white space, and at line ends before headings and list items."""
    parts = F.split(text, r"(?U)(?<=[.!?])\s+|\n+(?=\s*(?:#{1,6}\s+|Article\s+\w+|[-*+]\s+|\d+[.)]\s+))")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def signal_sentences(text: Column, least: int = 3) -> Column:
    """Split after . ! ? or a newline and white space; at least `least` words."""
    parts = F.transform(F.split(text, r"(?U)(?<=[.!?\n])\s+"), strip)
    return F.filter(parts, lambda x: F.size(words(x)) >= least)


def blocks(text: Column) -> Column:
    """Paragraphs between blank lines; if there is one at most, the lines."""
    parts = F.filter(F.transform(F.split(text, "\n{2,}"), strip), lambda x: x != "")
    return F.when(F.size(parts) > 1, parts).otherwise(full_lines(text))


def count_chars(text: Column, *chars: str) -> Column:
    """How often the characters occur."""
    return sum((F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in chars), F.lit(0))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(empty))


def clip(c: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
