"""Text functions, Column to Column. Offsets count code points; intervals are half-open."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The token pattern, and the punctuation that is mapped one to one.
TOKEN = r"[a-z0-9]+(?:[.\-][a-z0-9]+)*"
PUNCT_FROM = "‑‒–—−－‘’“” "
PUNCT_TO = "------''\"\" "
# Lines that are only a page number, bullets, and the starts of a block.
PAGE_NUMBER = r"(?iU)^(page\s+)?\d+(\s+of\s+\d+)?$"
BULLET = "(?U)^[•▪◦·]\\s*"
BLOCK_START = r"(?U)^\d+(\.\d+)+\b|^-\s|^[A-Z][A-Za-z ,'&/()-]{2,60}$"
# White space that is stripped, and what ends a line.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_END = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
# A refusal's words, and the marks of errors that pass and that don't.
REFUSAL = "the provided guideline extracts do not state this."
LASTING = "400|404|INVALID_ARGUMENT|NOT_FOUND|PERMISSION_DENIED"
PASSING = "429|500|502|503|504|RESOURCE_EXHAUSTED|UNAVAILABLE|DEADLINE_EXCEEDED|timeout|Timeout"


def tokens(c: Column) -> Column:
    """Lower-cased alphanumeric runs; dots and hyphens inside them stay. Null for null."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def normalise_punctuation(c: Column) -> Column:
    """Length-preserving."""
    return F.translate(c, PUNCT_FROM, PUNCT_TO)


def normalise(c: Column) -> Column:
    """Line ends to LF; U+0002 and soft hyphens out; punctuation mapped; other C0 controls but TAB and LF out."""
    c = F.regexp_replace(c, "\r\n?", "\n")
    c = normalise_punctuation(F.regexp_replace(c, "[\u0002­]", ""))
    return F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")


def strip(c: Column) -> Column:
    """Without white space (of any kind) at the ends."""
    return F.btrim(c, F.lit(SPACES))


def lines(c: Column) -> Column:
    """The lines of a text, whatever ends them; a line end at the very end opens no further line."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, f"(?:{LINE_END})\\z", ""), LINE_END, -1))


def squeeze(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends. Single blanks are no match, which spares most of the work."""
    plain = F.regexp_replace(c, r"[\s\x1c-\x1f]{2,}|[\t\n\x0b\f\r\x1c-\x1f]", " ")
    wide = F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]{2,}|(?! )[\s\x1c-\x1f]", " ")
    return F.trim(F.when(F.octet_length(c) == F.length(c), plain).otherwise(wide))


def strip_blocks(c: Column, patterns: list[tuple[str, str]]) -> Column:
    """Replace each pattern in turn; patterns (regex, replacement) are the publisher's, given by the caller."""
    for pattern, replacement in patterns:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def count_blocks(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def join_hyphens(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")


def dated(c: Column, label: str) -> Column:
    """The date after a label such as 'Published:', in any case, or null."""
    return F.nullif(F.regexp_extract(c, rf"(?iU)\Q{label}\E\s*([0-9]{{1,2}}\s+\w+\s+[0-9]{{4}})", 1), F.lit(""))


def page_footers(lines_before: str, rights: str) -> list[tuple[str, str]]:
    """Patterns for strip_blocks: a footer from a line that matches lines_before and one that starts with `rights` to its
    'Page n of m'; what is left of the second; and page numbers alone. What they say is the publisher's."""
    return [(rf"(?is){lines_before}\s*\n{rights}.*?Page\s+\d+\s+of\s*\n?\s*\d+", "\n"), (rf"(?i){rights}[^\n]*", ""), (r"(?i)\bPage\s+\d+\s+of\s*\n?\s*\d+", "")]


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))


def locate_span(text: Column, passage: Column) -> Column:
    """struct(start, end) of the passage's leftmost place; failing that, of its words across any white space; else null."""
    words = F.split(squeeze(passage), " ")
    plain = F.transform(words, lambda w: F.regexp_replace(w, r"([^\p{L}\p{N}])", r"\\$1"))
    loose = F.array_join(plain, f"[{SPACES}]+")
    exact = F.position(passage, text)
    at = F.when(exact > 0, exact).otherwise(F.regexp_instr(text, loose))
    size = F.when(exact > 0, F.length(passage)).otherwise(F.length(F.regexp_substr(text, loose)))
    return F.when((at > 0) & (F.length(strip(passage)) > 0), F.struct((at - 1).alias("start"), (at - 1 + size).alias("end")))


def cache_key(*parts: Column, size: int = 20) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, size)


def chunk_id(doc: Column, strategy: str, ordinal: Column) -> Column:
    return F.format_string("%s:%s:%05d", doc.cast("string"), F.lit(strategy), ordinal.cast("int"))


def is_refusal(answer: Column) -> Column:
    return F.coalesce(F.lower(answer).contains(REFUSAL), F.lit(False))


def is_transient(message: Column) -> Column:
    """Marks that forbid a retry win over those that allow it."""
    return F.when(message.rlike(LASTING), False).otherwise(F.coalesce(message.rlike(PASSING), F.lit(False)))


def grounded_prompt(context: Column, question: Column) -> Column:
    """What a model is asked with extracts; wording is a caller's choice, this is the default."""
    return F.format_string("Numbered extracts:\n\n%s\n\nQuestion: %s\nUse the extracts alone and name their numbers.", context, question)


def bare_prompt(question: Column) -> Column:
    """What a model is asked without any."""
    return F.format_string("Question: %s\nAnswer in short.", question)


def utc_stamp(t: Column) -> Column:
    """ISO 8601 to the second, for a session in UTC."""
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
