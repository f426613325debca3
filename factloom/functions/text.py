"""Text functions: normal forms, keys, trigrams, citations, headings, furniture, tokens."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words of company registrations that don't distinguish names.
NOISE_WORDS = (
    "pvt", "private", "ltd", "limited", "inc", "incorporated", "llc", "llp", "plc", "co", "company", "corp", "corporation", "and", "the", "m", "s",
)

# Common English words that carry no topic.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)


def normalise_text(text: str | None) -> str | None:
    """Compatibility form without combining marks, case-folded, everything but a-z and 0-9 as single spaces."""
    if text is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", " ", plain.casefold()).strip()


@F.pandas_udf(T.StringType())
def normalised(texts: pd.Series) -> pd.Series:
    return texts.map(normalise_text, na_action="ignore")


def normalised_ascii(text: Column) -> Column:
    """The same for ASCII texts, without leaving the JVM."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def without_noise(text: Column) -> Column:
    """Registration words go from both ends; a text of nothing else stays."""
    words = "|".join(NOISE_WORDS)
    bare = F.regexp_replace(F.regexp_replace(text, rf"^((?:{words})(?: |$))+", ""), rf"((?:^| )(?:{words}))+$", "")
    return F.coalesce(F.nullif(F.trim(bare), F.lit("")), text)


def collapsed_runs(text: Column) -> Column:
    """Runs of one character become one."""
    return F.regexp_replace(text, r"(.)\1+", "$1")


def is_reference(key: Column) -> Column:
    """Whether a key has the shape of a reference: up to six letters, then three digits or more."""
    return key.rlike("^(?:[a-z]{2,6})?[0-9]{3,}$")


def trigrams(text: Column) -> Column:
    """Distinct 3-character pieces of the text between two spaces at each end."""
    padded = F.concat(F.lit("  "), text, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_jaccard(a: Column, b: Column) -> Column:
    """Overlap of the trigram sets; two empty texts are equal."""
    x, y = trigrams(a), trigrams(b)
    return F.when((a == "") & (b == ""), F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def content_hash(text: Column) -> Column:
    """SHA-256 of the text with every run of white space as one space and none at the ends."""
    return F.sha2(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 256)


def citations(text: Column) -> Column:
    """Ids of ``[E12]`` markers, distinct, in the order of their first appearance; leading zeros don't count."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[E([0-9]+)\]"), F.lit(1)), lambda d: F.concat(F.lit("E"), d.cast("decimal(38,0)").cast("string"))))


def malformed_citations(text: Column) -> Column:
    """Bracketed markers that begin with E or e, or single identifiers, and aren't citations."""
    found = F.regexp_extract_all(text, F.lit(r"(\[(?:[Ee][^\[\]\n]{0,12}|[A-Za-z_][A-Za-z0-9_]*)\])"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda m: ~m.rlike(r"^\[E[0-9]+\]$")))


def line_signature(line: Column) -> Column:
    """A line with digits as # and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, "[0-9]+", "#"), r"\s+", " "))


def terms(text: Column) -> Column:
    """Lower-case word tokens without stop words (not stemmed): letters, digits and _ of any script, with hyphens inside."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_](?:[\p{L}\p{N}_-]*[\p{L}\p{N}_])?)"), F.lit(1))
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; 0 where a norm is 0; arrays of different length are an error."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def file_reference(text: Column, prefix: str = "CLM") -> Column:
    """The first reference like CLM-1088 in a text, in upper case, or null."""
    return F.nullif(F.upper(F.regexp_extract(text, rf"(?i)({prefix}-[0-9]{{3,}})", 1)), F.lit(""))


def page_class(n_chars: Column, area: Column) -> Column:
    """'digital', 'scanned' or 'mixed' by characters per unit of area."""
    density = n_chars / area
    return F.when(area <= 0, "scanned").when(density >= 0.0002, "digital").when(density <= 1e-6, "scanned").otherwise("mixed")


def page_confidence(is_digital: Column, score: Column) -> Column:
    """1 for digital pages, else the recognition score within [0, 1]; unknown scores are 0."""
    odd = score.isNull() | F.isnan(score) | (score == float("inf")) | (score == float("-inf"))
    return F.when(is_digital, 1.0).when(odd, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


LABEL_CHARS = 80
_SIGN = r"(?:\s*[-–—:.]\s*.*|\s*)$"
# The forms of headings in policy wordings, with their depth; group 1 is the number.
HEADING_FORMS = (
    ("section", 2, "SECTION", r"(?i)^SECTION\s+([0-9]+|[IVXLC]+)\b" + _SIGN),
    ("cover", 3, "COVERAGE", r"(?i)^COVERAGE\s+([A-Z]|[0-9]+)\b" + _SIGN),
    ("cover", 3, "ENDORSEMENT", r"(?i)^ENDORSEMENT\s+([0-9]+|[A-Z])\b" + _SIGN),
    ("clause", 4, "", r"^([0-9]+(?:\.[0-9]+)+)\.?\s+.+$"),
)


def _form(line: Column, value) -> Column:
    """``value(kind, depth, clause id)`` of the first form that the line has, or null."""
    found = F.lit(None)
    for kind, depth, word, pattern in reversed(HEADING_FORMS):
        number = F.upper(F.regexp_extract(line, pattern, 1))
        found = F.when(line.rlike(pattern), value(kind, depth, F.concat(F.lit(f"{word} "), number) if word else number)).otherwise(found)
    return found


def heading(line: Column) -> Column:
    """struct(kind, depth, label, clause_id) of a heading line, or null.

    Markdown marks (whose label may have the id of another form), SECTION, COVERAGE and
    ENDORSEMENT titles, decimal clauses and lines in capitals count; a list mark before
    any of them but the first doesn't matter.  Dot leaders don't count; labels end after
    80 characters.
    """
    return F.get(F.transform(F.array(line), _heading), F.lit(0))  # the line is worked out once


def _heading(line: Column) -> Column:
    bare = F.trim(line)
    item = F.trim(F.regexp_replace(bare, r"^[-*o•]\s+", ""))
    markdown, capitals = r"^(#{1,6})\s+(.+)$", r"^[A-Z][A-Z0-9 &/,'()\-]{3,}$"
    label = F.trim(F.regexp_extract(bare, markdown, 2))
    made = lambda kind, depth, name, clause_id: F.struct(F.lit(kind).alias("kind"), depth.cast("int").alias("depth"), F.substring(name, 1, LABEL_CHARS).alias("label"), clause_id.cast("string").alias("clause_id"))
    return (
        F.when(F.contains(bare, F.lit("....")), F.lit(None))
        .when(bare.rlike(markdown), made("markdown", F.length(F.regexp_extract(bare, markdown, 1)), label, _form(label, lambda kind, depth, number: number)))
        .when(_form(item, lambda kind, depth, number: F.lit(True)), _form(item, lambda kind, depth, number: made(kind, F.lit(depth), item, number)))
        .when(item.rlike(capitals) & item.rlike("[A-Z]{2,}") & (F.length(item) <= LABEL_CHARS), made("capitals", F.lit(3), item, F.lit(None)))
    )


def normalise_page(text: str | None) -> str | None:
    """Compatibility form without soft hyphens, single spaces, none before a line end (indentation stays), at most one empty line in a row."""
    if text is None:
        return None
    plain = unicodedata.normalize("NFKC", text).replace("\u00ad", "")
    plain = re.sub(r"[ \t]+", " ", plain)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" +\n", "\n", plain)).strip()


@F.pandas_udf(T.StringType())
def normalised_page(texts: pd.Series) -> pd.Series:
    return texts.map(normalise_page, na_action="ignore")


def unmerged_clauses(text: Column) -> Column:
    """A line break before a decimal clause that stands after the end of a sentence."""
    return F.regexp_replace(text, r"(?<=[.;:])[ \t]+(?=[0-9]+(?:\.[0-9]+)+\.?[ \t]+[A-Z])", "\n")


def rendered_table(cells: Column) -> Column:
    """Rows of cells (array of arrays of texts) as lines with bars; blank rows and columns go, under two rows nothing is left."""
    filled = F.filter(F.transform(cells, lambda r: F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit(""))))), lambda r: F.exists(r, lambda c: c != ""))
    width = F.array_max(F.transform(filled, F.size))
    used = F.filter(F.sequence(F.lit(0), F.greatest(width, F.lit(1)) - 1), lambda i: F.exists(filled, lambda r: F.coalesce(F.get(r, i), F.lit("")) != ""))
    lines = F.transform(filled, lambda r: F.array_join(F.transform(used, lambda i: F.coalesce(F.get(r, i), F.lit(""))), " | "))
    return F.when(F.size(filled) < 2, F.lit("")).otherwise(F.array_join(lines, "\n"))


UNREADABLE = "[page could not be read]"


def scanned_page_text(text: Column, confidence: Column) -> tuple[Column, Column]:
    """(text, confidence) of a recognised page: lines without letters or digits go; a page without text is marked and has confidence 0."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x.rlike("[\\p{L}\\p{N}]"))
    blank = F.size(lines) == 0
    return F.when(blank, UNREADABLE).otherwise(F.array_join(lines, "\n")), F.when(blank, 0.0).otherwise(confidence)
