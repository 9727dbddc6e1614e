"""Token ids: text -> ids, ids -> text.

Three ways to look words up, all with the same result:

* ``encode_column``: each task holds the model (a broadcast of bounded size; words as arrays, no dict) and
  encodes the distinct words of a batch once; no shuffle. The usual way.
* ``encode_by_join``: for vocabularies too large for a task, a join on the word for all but the most frequent ones.
* ``WordTable``: encode distinct words once, as a stored table that later corpora extend by what they have anew.
"""

from __future__ import annotations

import hashlib
import json
import pickle
from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import text as tx
from textloom.operators.vocab import EOS_ID, FIRST_ID, SPECIAL_TOKENS, UNK_ID
from textloom.workspace import Tables, committed, freeze

#: Words of a table that Spark broadcasts to a join.
MAX_BROADCAST_WORDS = 1 << 21
#: Words that a task holds as arrays, some 26 bytes each.
MAX_HELD_WORDS = 1 << 23
MAX_LITERAL_TOKENS = 1 << 16
#: Words that a task holds with the ids of their parts, some 50 bytes each.
MAX_HELD_LISTS = 1 << 22
#: Words that ``encode_by_join`` encodes without the join, unless told which.
FREQUENT_WORDS = 1 << 18
_CACHE_WORDS = 1 << 18
_GAP = -1
SPECIAL_IDS = {token: i for i, token in enumerate(SPECIAL_TOKENS)}
_SPECIAL = "|".join(rf"\Q{token}\E" for token in SPECIAL_TOKENS)
_WORD_OR_SPECIAL = rf"(?U){_SPECIAL}|\w++|(?:(?!{_SPECIAL})[^\w\s])++"


def tokens(text: Column, special: bool = True) -> Column:
    """Words and punctuation runs. With ``special`` a special token written out
    in a text is one piece and gets its own id; otherwise it is plain text."""
    plain = tx.tokens(text)
    if not special:
        return plain
    split = F.regexp_extract_all(text, F.lit(_WORD_OR_SPECIAL), F.lit(0))
    return F.when(text.rlike(_SPECIAL), split).otherwise(plain)


class Model(Protocol):
    """What encoding needs: the ids of one word."""

    def encode_word(self, word: str) -> list[int]: ...


def _hashes(words: pa.Array) -> np.ndarray:
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False)


class HeldWords:
    """Words in arrays in the order of a 64-bit hash. A word is found by bisection and compared itself, so equal hashes do no harm."""

    def __init__(self, words: pa.Array):
        hashes = _hashes(words)
        self.order = np.argsort(hashes, kind="stable")
        self._hashes, self._words = hashes[self.order], words.take(pa.array(self.order))
        starts = np.flatnonzero(np.concatenate(([True], self._hashes[1:] != self._hashes[:-1])))
        self._most = int(np.diff(np.concatenate((starts, [len(words)]))).max(initial=0))  # words of one hash

    def find(self, words: pa.Array) -> np.ndarray:
        """The place of each word here, of a repeated one the last; -1 where there is none."""
        hashes = _hashes(words)
        place, found = np.searchsorted(self._hashes, hashes), np.full(len(words), -1)
        for k in range(self._most):
            at = np.minimum(place + k, len(self._hashes) - 1)
            near = np.flatnonzero(self._hashes[at] == hashes)
            same = pc.equal(self._words.take(pa.array(at[near])), words.take(pa.array(near)))
            near = near[same.to_numpy(zero_copy_only=False)]
            found[near] = at[near]
        return found


class WordModel(HeldWords):
    """Whole words; anything else is one unknown token. Of a repeated word the last id counts."""

    def __init__(self, words: pa.Array, ids: np.ndarray):
        super().__init__(pa.concat_arrays([words, pa.array(SPECIAL_IDS, pa.string())]))
        self._ids = np.concatenate((ids, list(SPECIAL_IDS.values()))).astype(np.int32)[self.order]
        del self.order

    @property
    def ids(self) -> dict[str, int]:
        return dict(zip(self._words.to_pylist(), self._ids.tolist()))

    def encode_words(self, words: pa.Array) -> np.ndarray:
        """The id of each word."""
        place = self.find(words)
        return np.where(place < 0, UNK_ID, self._ids[place]).astype(np.int32)

    def encode_word(self, word: str) -> list[int]:
        return self.encode_words(pa.array([word])).tolist()

    @classmethod
    def from_table(cls, vocabulary: DataFrame, max_words: int = MAX_HELD_WORDS) -> WordModel:
        """Load a vocabulary after checking that it is small enough to ship."""
        size = vocabulary.count()
        if size > max_words:
            raise ValueError(f"{size} words; use encode_by_join beyond {max_words}")
        rows = vocabulary.where((F.col("id") >= FIRST_ID) & F.col("token").isNotNull()).select("id", "token").toArrow().combine_chunks()
        return cls(*(rows[c].combine_chunks() if c == "token" else rows[c].to_numpy() for c in ("token", "id")))


class WordLists(HeldWords):
    """Words with a list of ids each; ``missing`` stands for any other."""

    def __init__(self, words: pa.Array, ids: pa.Array, missing: int):
        super().__init__(words)
        self._lists = pa.concat_arrays([ids.take(pa.array(self.order)), pa.array([[missing]], ids.type)])
        del self.order

    def encode(self, words: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The ids of a list<string> array, every distinct word of the batch looked up once; which of its words are missing."""
        coded = words.flatten().dictionary_encode()
        place = self.find(coded.dictionary)
        of_word = coded.indices.to_numpy(zero_copy_only=False)
        lists = self._lists.take(pa.array(np.where(place < 0, len(self._lists) - 1, place)[of_word]))
        ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))))
        ids = pa.ListArray.from_arrays(pa.array(ends[_offsets(words)].astype(np.int32)), lists.flatten(), mask=_nulls(words))
        return ids, (place < 0)[of_word]


def _look_up(words: pa.Array, model: WordModel) -> pa.Array:
    """Encode a list<string> array with one id a word; every distinct word of the batch once."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    coded = words.flatten().dictionary_encode()
    ids = model.encode_words(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
    return pa.ListArray.from_arrays(pa.array(_offsets(words).astype(np.int32)), pa.array(ids, pa.int32()), mask=_nulls(words))


def _encode_lists(words: pa.Array, encode_word, cache: dict[str, list[int]]) -> pa.Array:
    """Encode a list<string> array; every distinct word of the batch once."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    coded = words.flatten().dictionary_encode()
    pieces = []
    for word in coded.dictionary.to_pylist():
        ids = cache.get(word)
        if ids is None:
            if len(cache) >= _CACHE_WORDS:
                cache.clear()
            ids = cache[word] = encode_word(word)
        pieces.append(ids)
    sizes = np.fromiter((len(p) for p in pieces), np.int64, len(pieces))
    starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    flat = np.fromiter((i for p in pieces for i in p), np.int32, int(sizes.sum()))
    use = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    length = sizes[use]
    ends = np.concatenate(([0], np.cumsum(length)))
    # Gather piece by piece: position within the output minus where its word
    # began there, plus where the word's ids begin in ``flat``.
    gather = np.arange(ends[-1]) - np.repeat(ends[:-1], length) + np.repeat(starts[use], length)
    per_row = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = ends[np.concatenate(([0], np.cumsum(per_row)))].astype(np.int32)
    mask = words.is_null() if words.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[gather], pa.int32()), mask=mask)


def encode_column(spark: SparkSession, model: Model, words: Column) -> Column:
    """Ids of an array of words as ``array<int>``."""
    shared = spark.sparkContext.broadcast(model)
    cache: dict[str, list[int]] = {}

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(batch: pa.Array) -> pa.Array:
        if isinstance(shared.value, WordModel):
            return _look_up(batch, shared.value)
        return _encode_lists(batch, shared.value.encode_word, cache)

    return encode(words)


def encode_text(spark: SparkSession, model: Model, text: Column, special: bool = True) -> Column:
    """Ids of a text; none are added."""
    return encode_column(spark, model, tokens(text, special))


def encode_documents(docs: DataFrame, model: Model | DataFrame, key: Sequence[str], text: Column,
                     max_broadcast: int = MAX_HELD_WORDS) -> DataFrame:
    """``(key, ids)`` with a model, or with a word vocabulary table ``(id,
    token)`` of any size: shipped to the tasks when its counted size allows it. Of a larger one the first ``max_broadcast`` ids, which are the
    frequent words, are shipped, and only the words behind them joined."""
    spark = docs.sparkSession
    if isinstance(model, DataFrame):
        if model.count() > max_broadcast:
            lookup = model.where(F.col("id") >= FIRST_ID).select(F.col("token").alias("word"), F.array("id").alias("ids"))
            near = lookup.where(F.col("ids")[0] < min(max_broadcast, MAX_HELD_LISTS))
            return encode_by_join(docs, lookup, key, text, min(max_broadcast, MAX_BROADCAST_WORDS), known=near)
        model = WordModel.from_table(model, max_broadcast)
    return docs.select(*key, encode_text(spark, model, text).alias("ids"))


def bpe_counter(spark: SparkSession, model: Model):
    """Token counter for the corpus plans."""
    return lambda text: F.size(encode_text(spark, model, text)).cast("bigint")


def word_ids(words: DataFrame, model: Model, *carried: str) -> DataFrame:
    """``(word, ids)`` for a table of distinct words, and its columns ``carried``."""
    shared = words.sparkSession.sparkContext.broadcast(model)
    rows = words.select("word", *carried)
    schema = T.StructType([rows.schema["word"], T.StructField("ids", T.ArrayType(T.IntegerType())), *(rows.schema[c] for c in carried)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_word = shared.value.encode_word
        for batch in batches:
            word = batch.column("word")
            ids = pa.array([encode_word(w) for w in word.to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([word, ids, *(batch.column(c) for c in carried)], ["word", "ids", *carried])

    return rows.mapInArrow(encode, schema)


def _bits(freq: str) -> Column:
    return F.length(F.bin(freq))


def _top(counts: DataFrame, freq: str, most: int) -> DataFrame:
    """At most ``most`` rows of ``counts``, those of the largest ``freq`` down to a power of two."""
    least, held = None, 0
    for bits, n in sorted(counts.groupBy(_bits(freq)).count().collect(), reverse=True):
        held += n
        if held > most:
            break
        least = 1 << (bits - 1) if bits > 1 else 0
    return counts.where(F.lit(False) if least is None else F.col(freq) >= least)


def frequent_words(docs: DataFrame, table: DataFrame, text: Column, most: int) -> dict[str, list[int]]:
    """Ids of at most ``most`` words, the most frequent ones of ``docs`` down to a power of two; words that ``table`` lacks are
    unknown. Only the words chosen reach the driver."""
    tables = Tables(docs.sparkSession)
    words = docs.select(F.explode(tokens(text)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    chosen = _top(tables.freeze(words, "word-counts"), "freq", most)
    rows = chosen.join(table, "word", "left").select("word", F.coalesce("ids", F.array(F.lit(UNK_ID))).alias("ids")).toArrow()
    tables.drop()
    return dict(zip(rows["word"].to_pylist(), rows["ids"].to_pylist()))


def word_lists(rows: pa.Table, missing: int) -> WordLists:
    """``(word, ids)`` as arrays."""
    word, ids = (rows[c].combine_chunks() for c in ("word", "ids"))
    return WordLists(word.cast(pa.string()), ids.cast(pa.list_(pa.int32())), missing)


def _offsets(lists: pa.Array) -> np.ndarray:
    """Where each row's entries begin in ``lists.flatten()``, and their end."""
    return np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))))


def _nulls(lists: pa.Array) -> pa.Array | None:
    return lists.is_null() if lists.null_count else None


def _encode_frequent(words: pa.Array, known: WordLists) -> pa.Array:
    """``ids`` of a list<string> array with ``_GAP`` for each word that is not known, and those words in order."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    ids, is_rare = known.encode(words)
    ends = np.concatenate(([0], np.cumsum(is_rare)))[_offsets(words)].astype(np.int32)
    gaps = pa.ListArray.from_arrays(pa.array(ends), words.flatten().filter(pa.array(is_rare)), mask=_nulls(words))
    return pa.StructArray.from_arrays([ids, gaps], ["ids", "gaps"])


def _with_special(table: DataFrame) -> DataFrame:
    """``(word, ids)`` with the ids that special tokens have everywhere."""
    special = table.sparkSession.createDataFrame([(t, [i]) for t, i in SPECIAL_IDS.items()], "word string, ids array<int>")
    return table.where(~F.col("word").isin(*SPECIAL_TOKENS)).select("word", "ids").unionByName(special)


def _fill_ids(ids: pa.Array, found: pa.Array) -> pa.Array:
    """``ids`` with the lists of ``found`` in place of the gaps."""
    flat, pieces = ids.flatten().to_numpy(zero_copy_only=False), found.flatten()
    gap = flat == _GAP
    sizes = np.ones(len(flat), np.int64)
    sizes[gap] = pieces.value_lengths().to_numpy(zero_copy_only=False)
    filled = np.repeat(gap, sizes)
    out = np.empty(len(filled), np.int32)
    out[filled], out[~filled] = pieces.flatten().to_numpy(zero_copy_only=False), flat[~gap]
    ends = np.concatenate(([0], np.cumsum(sizes)))[_offsets(ids)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out, pa.int32()))


def _looked_up(rows: DataFrame, column: str, item: str, value: Column, table: DataFrame) -> DataFrame:
    """``(_row, _found)``: ``value`` of each entry of ``column``, an array, in its order, by a join with ``table`` on ``item``."""
    places = rows.select("_row", F.posexplode(column).alias("_pos", item))
    met = places.join(table, item, "left").select("_row", F.struct("_pos", value.alias("value")).alias("p"))
    return met.groupBy("_row").agg(F.array_sort(F.collect_list("p")).alias("p")).select(
        "_row", F.transform("p", lambda p: p["value"]).alias("_found"))


def _parted(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """Rows with entries in ``column``, and the others."""
    some = F.coalesce(F.size(column), F.lit(0)) > 0
    return rows.where(some), rows.where(~some)


def encode_by_join(docs: DataFrame, table: DataFrame, key: Sequence[str], text: Column,
                   max_broadcast: int = MAX_BROADCAST_WORDS, most_frequent: int | None = None, known: DataFrame | None = None) -> DataFrame:
    """``(key, ids)`` by looking words up in ``table (word, ids)`` of any size; ids are not negative. The words of ``known``, rows of ``table``
    that tasks can hold, or else those that are frequent in ``docs`` (at most ``most_frequent``, ``FREQUENT_WORDS`` by default), are
    encoded in the tasks that read the texts. Only the others are shuffled,
    each occurrence as one row, and come back to their row; no key of that join is hot. The table is broadcast to it
    when its counted size allows it. A NULL text has NULL ids; rows that repeat a key and text stay as many rows."""
    spark = docs.sparkSession
    table = _with_special(table)
    if known is None:
        frequent = frequent_words(docs, table, text, FREQUENT_WORDS if most_frequent is None else most_frequent)
        rows = pa.table({"word": pa.array(frequent.keys(), pa.string()), "ids": pa.array(frequent.values(), pa.list_(pa.int32()))})
    else:
        rows = _with_special(known).toArrow()
    held = spark.sparkContext.broadcast(word_lists(rows, _GAP))

    @F.arrow_udf("ids array<int>, gaps array<string>")
    def encode(words: pa.Array) -> pa.Array:
        return _encode_frequent(words, held.value)

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def fill(ids: pa.Array, found: pa.Array) -> pa.Array:
        return _fill_ids(ids, found)

    coded = docs.select(*key, F.monotonically_increasing_id().alias("_row"), encode(tokens(text)).alias("_e"))
    stored = freeze(coded.select(*key, "_row", F.col("_e.ids").alias("ids"), F.col("_e.gaps").alias("_gaps")), "encoded")
    rest, whole = _parted(stored, "_gaps")
    lookup = F.broadcast(table) if table.count() <= max_broadcast else table
    found = _looked_up(rest, "_gaps", "word", F.coalesce("ids", F.array(F.lit(UNK_ID))), lookup)
    filled = rest.join(found, "_row").select(*key, fill("ids", "_found").alias("ids"))
    return whole.select(*key, "ids").unionByName(filled)


class WordTable:
    """Ids of words as a stored table that only grows: each word is encoded once, when a corpus first has it.

    ``path`` holds one folder per extension, ``part=n``, of ``(word, ids, docs)``, with the number of documents that had the word then;
    a folder counts once Spark has committed it. The folder ``model``
    names the model by a digest, so ids of two models do not mix. One run extends a table at a time."""

    def __init__(self, spark: SparkSession, path: str, model: Model):
        self._spark, self._path, self._model = spark, path.rstrip("/"), model
        digest = hashlib.sha256(pickle.dumps((sorted(model.ids.items()), getattr(model, "merges", None)))).hexdigest()
        if committed(spark, f"{self._path}/_model"):
            if spark.read.text(f"{self._path}/_model/name").first()[0] != digest:
                raise ValueError(f"{path} holds the words of another model")
        else:
            spark.createDataFrame([(digest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self._path}/_model/name")

    def _parts(self) -> list[str]:
        return [f"{self._path}/{name}" for name in committed(self._spark, self._path) if name.startswith("part=")]

    def _stored(self) -> DataFrame:
        parts, schema = self._parts(), "word string, ids array<int>, docs bigint"
        return self._spark.read.schema(schema).parquet(*parts) if parts else self._spark.createDataFrame([], schema)

    def words(self) -> DataFrame:
        """``(word, ids)`` of all words so far."""
        return self._stored().select("word", "ids")

    def extend(self, docs: DataFrame, text: Column) -> int:
        """Encode the words of ``docs`` that the table lacks; how many there were."""
        found = docs.select(F.explode(F.array_distinct(tokens(text))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
        place = f"{self._path}/part={len(self._parts()):06d}"
        word_ids(found.join(self.words(), "word", "left_anti"), self._model, "docs").write.mode("overwrite").parquet(place)
        return self._spark.read.parquet(place).count()

    def encode(self, docs: DataFrame, key: Sequence[str], text: Column, max_broadcast: int = MAX_BROADCAST_WORDS,
               max_held: int = MAX_HELD_LISTS) -> DataFrame:
        """``(key, ids)`` from the table alone; ``extend`` comes first. Tasks hold the words of most documents, at most ``max_held``;
        if these are not all, the other words are joined."""
        stored = self._stored().withColumn("docs", F.coalesce("docs", F.lit(0)))
        if stored.count() > max_held:
            return encode_by_join(docs, self.words(), key, text, max_broadcast, known=_top(stored, "docs", max_held))
        held = self._spark.sparkContext.broadcast(word_lists(_with_special(stored).toArrow(), UNK_ID))

        @F.arrow_udf(T.ArrayType(T.IntegerType()))
        def encode(words: pa.Array) -> pa.Array:
            return held.value.encode(words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words)[0]

        return docs.select(*key, encode(tokens(text)).alias("ids"))


def append_eos(ids: Column, eos_id: int | None = EOS_ID) -> Column:
    """End each document, when the tokenizer has an end token."""
    return ids if eos_id is None else F.concat(ids, F.array(F.lit(eos_id)))


def _spell(ids: pa.Array, found: pa.Array, near: pa.Array) -> pa.Array:
    """Tokens joined by spaces: those of ids below ``len(near)`` from there, the others from ``found`` in their order."""
    flat = ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    far = flat >= len(near)
    own = np.flatnonzero(far)
    every = pa.concat_arrays([near, found.flatten()])
    at = flat.copy()
    at[own] = len(near) + np.arange(len(own))
    names = every.take(pa.array(at))
    there = names.is_valid().to_numpy(zero_copy_only=False)
    ends = np.concatenate(([0], np.cumsum(there)))[_offsets(ids)].astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), names.drop_null(), mask=_nulls(ids)), " ")


def _by_id(rows: pa.Table, size: int) -> pa.Array:
    """The token of each id below ``size``, NULL where there is none."""
    at = np.full(size, -1)
    at[rows["id"].to_numpy()] = np.arange(len(rows))
    return rows["token"].combine_chunks().take(pa.array(at, mask=at < 0))


def decode(docs: DataFrame, vocabulary: DataFrame, key: Sequence[str], ids: str = "ids",
           skip_special: bool = True, max_literal: int = MAX_LITERAL_TOKENS, max_held: int = MAX_HELD_WORDS) -> DataFrame:
    """``(key, text)``: pieces joined by single spaces, special tokens and ids
    without a token left out; NULL ids have a NULL text. Tokens of up to ``max_literal`` ids are a literal array indexed by id, of up to
    ``max_held`` an array that the tasks hold; beyond, ids below ``max_literal``, which in a word vocabulary are the frequent ones,
    are looked up there and only the others joined."""
    spark = docs.sparkSession
    first = FIRST_ID if skip_special else 0
    size = (vocabulary.agg(F.max("id")).first()[0] or 0) + 1
    held = size if size <= max(max_literal, max_held) else max_literal
    rows = vocabulary.where(F.col("id").between(0, held - 1)).select("id", "token").toArrow()
    near = _by_id(rows, held)
    kept = F.filter(F.col(ids), lambda i: i >= first)

    def spelt(kept: Column) -> Column:
        names = F.from_json(F.lit(json.dumps(near.to_pylist())), "array<string>")
        return F.array_join(F.transform(kept, lambda i: F.get(names, i)), " ").alias("text")

    if size <= max_literal:
        return docs.select(*key, spelt(kept))
    shared = spark.sparkContext.broadcast(near)

    @F.arrow_udf(T.StringType())
    def spell_near(of: pa.Array) -> pa.Array:
        return _spell(of, pa.array([[]] * len(of), pa.list_(pa.string())), shared.value)

    if size <= max_held:
        return docs.select(*key, spell_near(F.filter(kept, lambda i: i < size)).alias("text"))

    @F.arrow_udf(T.StringType())
    def spell(of: pa.Array, found: pa.Array) -> pa.Array:
        return _spell(of, found, shared.value)

    stored = freeze(docs.select(*key, F.monotonically_increasing_id().alias("_row"), kept.alias("_ids"),
                                F.filter(kept, lambda i: i >= len(near)).alias("_far")), "ids")
    rest, whole = _parted(stored, "_far")
    found = _looked_up(rest, "_far", "id", F.col("token"), vocabulary.select("id", "token"))
    return whole.select(*key, spelt(F.col("_ids"))).unionByName(rest.join(found, "_row").select(*key, spell("_ids", "_found").alias("text")))
