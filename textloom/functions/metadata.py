"""Fields hidden in JSON columns of web-crawl rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import MAX_PERPLEXITY, MIN_CHARS, strip
from textloom.schemas import QUALITY_META, QUALITY_SIGNALS


def language(meta: Column, data_type: T.DataType | None = None) -> Column:
    """Language from a struct column or from its JSON text."""
    if isinstance(data_type, T.StructType):
        return meta["language"]
    if isinstance(data_type, T.MapType):
        return F.element_at(meta, F.lit("language"))
    return F.from_json(meta, QUALITY_META)["language"]


def perplexity(signals: Column) -> Column:
    """Third value of the first perplexity entry; NULL when it is missing."""
    entries = F.from_json(signals, QUALITY_SIGNALS)["ccnet_perplexity"]
    return F.get(F.get(entries, F.lit(0)), F.lit(2))


def accept(text: Column, ppl: Column, min_chars: int = MIN_CHARS,
           max_ppl: float = MAX_PERPLEXITY, on_missing: str = "drop") -> Column:
    """Keep rows that are long enough and not too surprising. NaN passes, as it
    compares false with any limit. A missing value drops the row or, with
    ``on_missing='error'``, ends the job."""
    long_enough = F.coalesce(F.length(strip(text)) >= min_chars, F.lit(False))
    if on_missing == "error":
        absent = F.raise_error(F.lit("quality signal is missing")).cast("boolean")
    elif on_missing == "drop":
        absent = F.lit(False)
    else:
        raise ValueError(f"on_missing: {on_missing}")
    calm = F.when(ppl.isNull(), absent).otherwise(F.isnan(ppl) | (ppl <= max_ppl))
    return F.when(long_enough, calm).otherwise(F.lit(False))
