"""One-permutation MinHash fingerprints of documents, native expressions only.

Words are grouped into shingles of five, each shingle is hashed once, the top
bits of the hash choose one of ``BINS`` bins and each bin keeps its least hash. A
bin that stayed empty copies a filled one, found by probing bins in a random order
of its own (optimal densification: every filled bin is equally likely, and two
documents with the same filled bins choose alike). The fingerprint stores the
lowest ``BITS`` bits of each bin as one hexadecimal digit. Two unrelated bins agree
with probability 2^-BITS, which the likeness corrects for.

Least hashes come from a sort instead of ``BINS`` minima: one ceiling value per bin
joins the hashes, and after sorting the first value of each bin is its minimum,
or the ceiling where the bin is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.ordered import bisect_left

BINS = 256
BITS = 4
SHINGLE = 5
PROBES = 8
ROWS_PER_CELL = 2048
MOST_CELLS = 100_000
_SHIFT = 64 - (BINS.bit_length() - 1)
_CEILING = (1 << _SHIFT) - 1
_DIGITS = "0123456789abcdef"


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def add_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the fingerprint of the column ``text``. A text with fewer words than a
    shingle is one shingle; one without words has the fingerprint ``''``."""
    keep = [c for c in df.columns if c != name]
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    n = F.size("_words")
    ceilings = F.array(*[F.lit(_signed((b << _SHIFT) | _CEILING)) for b in range(BINS)])
    # Every array is a column of its own: it is read many times but made once.
    hashed = df.select(*keep, words.alias("_words")).select(
        *keep, F.when(n >= SHINGLE, F.transform("_words", lambda w: F.xxhash64(w)))
        .when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", "_words")))).otherwise(F.array().cast("array<bigint>")).alias("_h"),
        n.alias("_n"))
    run = F.transform(F.slice("_h", F.lit(1), F.greatest(F.col("_n") - (SHINGLE - 1), F.lit(0))), lambda h, i: F.xxhash64(
        h, *[F.get(F.col("_h"), i + k) for k in range(1, SHINGLE)]))
    shingles = F.when(F.col("_n") >= SHINGLE, run).otherwise(F.col("_h"))
    ordered = hashed.select(*keep, "_n", F.sort_array(F.concat(shingles, ceilings)).alias("_s"))
    bin_of = lambda h: F.shiftrightunsigned(h, _SHIFT)
    mins = F.filter("_s", lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(F.col("_s"), i - 1))))
    least = ordered.select(*keep, "_n", mins.alias("_m"))
    empty = lambda h: h.bitwiseAND(F.lit(_CEILING)) == _CEILING
    value = lambda p: F.get(F.col("_m"), p)
    # Probe bins in an order of the empty bin's own; if the first probes are all empty,
    # take the filled bin whose hash with this bin is least.
    probe = lambda j: F.get(F.filter(F.transform(F.sequence(F.lit(1), F.lit(PROBES)), lambda a: value(
        F.pmod(F.xxhash64(j, a), F.lit(BINS)).cast("int"))), lambda h: ~empty(h)), F.lit(0))
    least_hash = lambda j: F.array_min(F.transform(F.filter("_m", lambda h: ~empty(h)), lambda h: F.struct(
        F.xxhash64(j, bin_of(h)).alias("order"), h.alias("value"))))["value"]
    filled = F.transform("_m", lambda h, j: F.when(~empty(h), h).otherwise(F.coalesce(probe(j), least_hash(j))))
    digits = F.transform("_f", lambda h: F.get(
        F.lit(list(_DIGITS)), h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")))
    return least.select(*keep, "_n", F.when(F.col("_n") > 0, filled).alias("_f")).select(
        *keep, F.when(F.col("_n") > 0, F.array_join(digits, "")).otherwise("").alias(name))


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1, from two fingerprints: the
    share of equal digits less what chance makes equal."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda e: e)) / BINS
    chance = 2.0 ** -BITS
    corrected = F.greatest(F.lit(0.0), (same - chance) / (1 - chance))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(corrected)


def with_next(df: DataFrame, key: str, columns: list[str], prefix: str = "next_") -> DataFrame:
    """Add ``columns`` of the next row in descending order of the whole number
    ``key``; after the last row comes the first.

    Keys are cut into cells of about ``ROWS_PER_CELL`` rows (more once there would be
    over ``MOST_CELLS``), whose borders are keys with a hash of zero. Each cell also
    gets a copy of the first row of the cell after it, so all rows are shuffled once
    and no task sees more than one cell. Rows of one key follow each other in the order
    of ``columns``; a NULL key comes last."""
    ids = df.select(key)
    total, top = ids.agg(F.count(F.lit(1)), F.max(key)).first()
    per_cell = max(ROWS_PER_CELL, total // MOST_CELLS)
    picks = ids.where(F.pmod(F.xxhash64(key), F.lit(per_cell)) == 0).distinct().collect()
    heads = sorted({r[0] for r in picks if r[0] is not None} | ({top} if top is not None else set()))
    # Cell i holds the keys above heads[i - 1] up to heads[i], its first row's.
    bounds = F.lit(heads) if heads else F.array().cast("array<bigint>")
    place = bisect_left(bounds, F.col(key), len(heads)) if heads else F.lit(0)
    cell = F.coalesce(F.when(F.col(key).isNull(), 0).otherwise(place), F.lit(0))
    rows = df.select("*", cell.alias("_cell"), F.lit(0).alias("_copy"))
    firsts = df.where(F.col(key).isin(heads) if heads else F.lit(True))
    copies = firsts.select("*", F.pmod(cell + 1, F.lit(max(len(heads), 1))).alias("_cell"), F.lit(1).alias("_copy"))
    along = Window.partitionBy("_cell").orderBy("_copy", F.col(key).desc_nulls_last(), *columns)
    return (
        rows.unionByName(copies)
        .select("*", *[F.lead(c).over(along).alias(f"{prefix}{c}") for c in columns])
        .where(F.col("_copy") == 0)
        .drop("_cell", "_copy")
    )


def neighbour_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, whose last half (rounded down)
    gives way to as many first characters of the next document, by descending doc_id.

    Defined results: a NULL text is empty; an empty text has the fingerprint ``''``, which is
    like another empty one (1) and unlike all others (0); a table of one row is its own next;
    of rows with one doc_id the smaller text goes first; NULL ids come last; no rows give
    no rows. Only doc_id and text are read."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = with_next(add_fingerprint(plain, "text", "fingerprint"), "doc_id", ["text", "fingerprint"])
    half = F.call_function("div", F.length("text"), F.lit(2)).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    both = add_fingerprint(own.withColumn("edited", edited).withColumn("n_chars", F.length("text").cast("bigint"))
                           .drop("text", "next_text"), "edited", "edited_fingerprint")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
