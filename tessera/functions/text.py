"""Column expressions for text: whitespace, tokenising, chunking, keywords.

All of these are JVM-side expressions (regex, split, slice, transform), so
they stay inside whole-stage code generation -- no Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.stopwords import ENGLISH_STOP_WORDS

# ---- fixed values -----------------------------------------------------------
# Characters Python's str.split()/\s treats as whitespace (str.isspace()).
PY_WHITESPACE_CLASS = (
    "[\\t\\n\\x{0B}\\x{0C}\\r\\x{1C}-\\x{1F} \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
# Keras Tokenizer default filters: each becomes a separator.
KERAS_FILTERS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n'
# sklearn-style word token: two or more word characters (letters, digits, underscore).
WORD2_PATTERN = "[\\p{L}\\p{N}_]{2,}"
# Keyword tool: runs of at least five ASCII letters.
KEYWORD_PATTERN = "[a-zA-Z]{5,}"
NO_KEYWORDS = "(none found)"
# -----------------------------------------------------------------------------


def _class_of(chars: str) -> str:
    parts = []
    for ch in chars:
        if ch == "\t":
            parts.append("\\t")
        elif ch == "\n":
            parts.append("\\n")
        elif ch.isalnum():
            parts.append(ch)
        else:
            parts.append("\\" + ch)
    return "[" + "".join(parts) + "]"


KERAS_FILTER_CLASS = _class_of(KERAS_FILTERS)


def english_stop_words() -> tuple[str, ...]:
    """Spark MLlib's default English stop-word list (the oracle SQL is built from it too)."""
    return ENGLISH_STOP_WORDS


def collapse_ws(col: Column | str) -> Column:
    """Python ``re.sub(r"\\s+", " ", t).strip()``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(c, PY_WHITESPACE_CLASS + "+", " "))


def words(col: Column | str) -> Column:
    """Collapse whitespace, then split on single spaces ('' -> [''])."""
    return F.split(collapse_ws(col), " ")


def chunk_count(words_col: Column | str, size: int = 110, overlap: int = 25) -> Column:
    """1 + ceil(max(0, n - size) / step) chunks for an array of n words."""
    step = max(1, size - overlap)
    n = F.size(F.col(words_col) if isinstance(words_col, str) else words_col)
    return F.greatest(F.lit(1), F.ceil((n - F.lit(size)) / F.lit(step)).cast("int") + 1)


def chunks_of_words(words_col: str, size: int = 110, overlap: int = 25) -> Column:
    """Overlapping word windows over an existing word-array COLUMN.

    Takes a column name on purpose: higher-order functions do not share
    sub-expressions, so the word array must already be materialised by a
    projection below, or the whole text would be re-split once per chunk.
    """
    step = max(1, size - overlap)
    w = F.col(words_col)
    starts = F.sequence(F.lit(0), chunk_count(w, size, overlap) - 1)
    return F.transform(starts, lambda i: F.array_join(F.slice(w, i * step + 1, size), " "))


def keras_tokens(col: Column | str) -> Column:
    """Keras ``text_to_word_sequence``: lower, filters -> space, split, drop empties."""
    c = F.col(col) if isinstance(col, str) else col
    spaced = F.regexp_replace(F.lower(c), KERAS_FILTER_CLASS, " ")
    return F.filter(F.split(spaced, " "), lambda t: t != F.lit(""))


def word_tokens(col: Column | str) -> Column:
    """Lower-cased tokens of 2+ word characters (TF-IDF tokenizer)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(F.lower(c), F.lit(WORD2_PATTERN), 0)


def keywords(col: Column | str) -> Column:
    """Distinct 5+-letter ASCII words of the lower-cased text, sorted, joined by ', '."""
    c = F.col(col) if isinstance(col, str) else col
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(KEYWORD_PATTERN), 0)))
    return F.when(F.size(found) > 0, F.array_join(found, ", ")).otherwise(F.lit(NO_KEYWORDS))


def py_repr(col: Column | str) -> Column:
    """Python ``repr`` of a str: single quotes unless the text has a single quote and no double quote;
    backslashes, the chosen quote and ASCII control characters escaped.

    Non-ASCII characters that Python calls unprintable stay as they are.
    """
    c = F.col(col) if isinstance(col, str) else col
    esc = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for char, text in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        esc = F.replace(esc, F.lit(char), F.lit(text))
    rare = esc
    for code in [*range(9), 11, 12, *range(14, 32), 127]:
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    esc = F.when(c.rlike("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]"), rare).otherwise(esc)
    dq = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(dq, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(esc, F.lit("'"), F.lit("\\'")), F.lit("'")))
