"""Text cleaning and measuring as native column expressions.

Java's ``\\s`` is ASCII-only and ``trim`` removes U+0020 alone, so both are
spelled out here to agree with Python's notion of white space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points Python's str.isspace() accepts, the word
# pattern of the tokenizer, the tag pattern and the size units.
PYTHON_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Single spaces stay as they are: only longer runs and other characters match.
SPACE_RUN = r"(?U)[\s\x1c-\x1f]{2,}|[\s\x1c-\x1f&&[^ ]]"
SPACE_LIKE_RUN = r"(?U)[\s\x1c-\x1f\u200b\u00a0]{2,}|[\s\x1c-\x1f\u200b\u00a0&&[^ ]]"
# The two classes exclude each other, so the runs need no backtracking.
WORD = r"(?U)\w++|[^\w\s]++"
TAG = r"<[^>]+>"
MIN_CHARS = 32
MAX_PERPLEXITY = 400
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB")


def evaluate_once(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Set column ``name`` to a costly expression so that filters on it are not
    pushed down as a second copy of the expression: a generator of one row keeps
    them above."""
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.array(expr)).alias(name))


def as_text(value: Column, data_type: T.DataType | None = None) -> Column:
    """Any column as text: NULL becomes ``''``, nested values become JSON."""
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        value = F.to_json(value)
    return F.coalesce(value.cast("string"), F.lit(""))


def strip(text: Column) -> Column:
    """Remove Unicode white space from both ends, in linear time."""
    return F.btrim(text, F.lit(PYTHON_SPACES))


def collapse_spaces(text: Column) -> Column:
    """Every run of Unicode white space becomes one space."""
    return F.regexp_replace(text, SPACE_RUN, " ")


def clean_plain(text: Column) -> Column:
    """Plain-text cleaner: zero-width and no-break spaces count as spaces, runs
    collapse to one, ends are trimmed. One regular expression does the first two."""
    return F.trim(F.regexp_replace(text, SPACE_LIKE_RUN, " "))


def strip_tags(text: Column) -> Column:
    """Each ``<...>`` becomes one space, also across line breaks."""
    return F.regexp_replace(text, TAG, " ")


def flatten_lines(text: Column) -> Column:
    """Strip, then put the text on one line (only line feeds are replaced)."""
    return F.replace(strip(text), F.lit("\n"), F.lit(" "))


def line_bytes(text: Column) -> Column:
    """UTF-8 size of the text written as one line."""
    return F.octet_length(text).cast("bigint") + F.lit(1)


def split_words(text: Column) -> Column:
    """White-space words; blank text gives an empty array."""
    flat = F.trim(collapse_spaces(text))
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def tokens(text: Column) -> Column:
    """Words and punctuation runs, as the tokenizer sees them."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def count_tokens(text: Column) -> Column:
    """Number of words and punctuation runs."""
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def human_size(num_bytes: Column) -> Column:
    """Bytes as text with one decimal: 1536 -> ``1.5KB``."""
    size = num_bytes.cast("double")
    result = F.lit(None).cast("string")
    for power in reversed(range(len(SIZE_UNITS))):
        scaled = size / F.lit(float(1024**power))
        shown = F.format_string("%.1f%s", F.bround(scaled, 1), F.lit(SIZE_UNITS[power]))
        last = power == len(SIZE_UNITS) - 1
        result = shown if last else F.when(scaled < 1024, shown).otherwise(result)
    return result


def round4(value: Column) -> Column:
    """Half-even rounding to four decimals."""
    return F.bround(value, 4)


def preview(text: Column, width: int = 200) -> Column:
    """One line of at most ``width`` characters, marked when cut."""
    flat = F.replace(text, F.lit("\n"), F.lit(" "))
    cut = F.concat(F.substring(flat, 1, width), F.lit(" ...[truncated]"))
    return F.when(F.length(flat) > width, cut).otherwise(flat)
