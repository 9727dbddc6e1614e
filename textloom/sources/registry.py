"""Registry of document sources and the scans over it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.cleaners import HTML_KEY_PREFIX, clean_by_name
from textloom.functions.text import MIN_CHARS, as_text, evaluate_once
from textloom.operators.ordered import key_cutoffs, ordinals, prefix, take_prefix
from textloom.schemas import SOURCE_REGISTRY
from textloom.workspace import freeze


@dataclass(frozen=True)
class Source:
    """One named source: where it lives, which field holds the text. ``order_by``
    is a key of any sortable type; without it, or where the field is missing, rows
    come as they arrive, by file and place in it. ``percent`` keeps the first part only."""

    key: str
    path: str
    text_field: str = "text"
    lang: str = ""
    order_by: str | None = "doc_id"
    format: str = "parquet"
    cleaner: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    filter: str | None = None
    percent: float | None = None

    @property
    def cleaner_name(self) -> str:
        if self.cleaner:
            return self.cleaner
        return "html" if self.key.startswith(HTML_KEY_PREFIX) else "plain"


def registry_frame(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """The registry as a table with one row per source."""
    rows = [(s.key, s.path, s.format, s.text_field, s.lang, s.cleaner_name, i)
            for i, s in enumerate(sources)]
    return spark.createDataFrame(rows, SOURCE_REGISTRY)


def tag_sources(docs: DataFrame, registry: DataFrame, on: str = "source") -> DataFrame:
    """Look up language, cleaner and ordinal of each document's source. The
    registry has one row per configured source and is broadcast."""
    info = registry.select(F.col("source_key").alias(on), F.col("lang").alias("source_lang"),
                           "cleaner", "ordinal")
    return docs.join(F.broadcast(info), on)


def scan_source(spark: SparkSession, source: Source) -> DataFrame:
    """One source as ``(source, ord_key, text, lang)``; a missing or NULL text
    field becomes ``''``, other types become text. Only two columns are read. A whole
    number is the key itself; other keys are numbered from 1 in their order, equal
    ones by their place."""
    raw = spark.read.format(source.format).options(**source.options).load(source.path)
    by_row = source.format == "parquet"
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"),
                     (F.col("_metadata.row_index") if by_row else F.monotonically_increasing_id()).alias("_row"))
    if source.filter:
        raw = raw.where(source.filter)
    fields = {f.name: f.dataType for f in raw.schema}
    found = fields.get(source.text_field)
    text = F.lit("") if found is None else as_text(F.col(source.text_field), found)
    key = fields.get(source.order_by) if source.order_by else None
    named = [F.lit(source.key).alias("source"), text.alias("text"), F.lit(source.lang).alias("lang")]
    if isinstance(key, T.IntegralType):
        rows = raw.select(*named, F.col(source.order_by).cast("bigint").alias("ord_key"))
    else:
        own = [] if key is None else [F.col(source.order_by).alias("_key")]
        placed = raw.select(*named, *own, "_file", "_row")
        rows = ordinals(placed, [*(["_key"] if own else []), "_file", "_row"], name="ord_key").drop("_key", "_file", "_row")
    rows = rows.select("source", "ord_key", "text", "lang")
    return rows if source.percent is None else split_slice(rows, source.percent, ["ord_key"])


def scan_sources(spark: SparkSession, sources: Sequence[Source]) -> DataFrame:
    """All sources in one DataFrame, read in parallel."""
    return reduce(DataFrame.unionByName, [scan_source(spark, s) for s in sources])


def cleaned_sources(spark: SparkSession, sources: Sequence[Source],
                    min_chars: int = MIN_CHARS) -> DataFrame:
    """All sources cleaned and filtered; each branch carries its own cleaner, so
    plain sources never meet the HTML code."""
    parts = [
        clean_documents(scan_source(spark, s).withColumn("cleaner", F.lit(s.cleaner_name)), min_chars,
                        {s.cleaner_name})
        for s in sources
    ]
    return reduce(DataFrame.unionByName, parts)


def clean_documents(docs: DataFrame, min_chars: int = MIN_CHARS,
                    cleaners_used: set[str] | None = None) -> DataFrame:
    """Drop empty texts, clean the rest, keep those of ``min_chars`` code points
    or more. Needs the columns ``text`` and ``cleaner``; drops the latter."""
    from textloom.functions.cleaners import CLEANERS

    if cleaners_used and len(cleaners_used) == 1:
        cleaned = CLEANERS[next(iter(cleaners_used))](F.col("text"))
    else:
        names = {k: v for k, v in CLEANERS.items() if not cleaners_used or k in cleaners_used}
        cleaned = clean_by_name(F.col("text"), F.col("cleaner"), names)
    full = evaluate_once(docs.where(F.col("text") != ""), "text", cleaned)
    return full.where(F.length("text") >= min_chars).drop("cleaner")


def split_slice(docs: DataFrame, percent: float, order_by: Sequence[str],
                group_by: Sequence[str] = ()) -> DataFrame:
    """The first ``percent`` % of rows in source order, to the nearest row. The
    end of the slice is found on the key columns alone."""
    if not group_by:
        return prefix(docs, round(docs.count() * percent / 100.0), order_by)
    keys = docs.select(*group_by, *order_by)
    sizes = keys.groupBy(*group_by).agg(F.count(F.lit(1)).alias("_rows"))
    wanted = F.round(F.col("_rows") * (percent / 100.0)).cast("bigint")
    kept = ordinals(keys, order_by, group_by, "_ord").join(sizes, list(group_by)).where(F.col("_ord") <= wanted)
    return take_prefix(docs, freeze(key_cutoffs(kept, order_by, group_by), "cutoffs"), order_by, group_by)
