"""Tokens, vocabularies, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import bpe, encode as enc, vocab
from textloom.queries import fragments as sql
from textloom.queries.registry import query, table, texts
from textloom.workspace import freeze, new_path

def words_table(spark: SparkSession, sf: str) -> DataFrame:
    return freeze(vocab.word_counts(texts(spark, sf, "text"), F.col("text")), "word-counts")


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return vocab.word_vocabulary(vocab.word_counts(texts(spark, sf, "text"), F.col("text")))


_PIECES = f"SELECT doc_id, text, regexp_extract_all(text, '{sql.WORD}') AS pieces FROM documents"


@query("N1", f"SELECT doc_id, len(pieces)::INTEGER AS n_pieces, array_to_string(pieces, ' ') AS pieces FROM ({_PIECES})")
def pre_tokenized(spark, sf):
    words = tx.tokens(F.col("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(words).alias("n_pieces"), F.array_join(words, " ").alias("pieces"))


@query("N2", f"WITH {sql.WORD_TOKENS} SELECT word, count(*) AS freq FROM toks GROUP BY word")
def word_frequencies(spark, sf):
    return vocab.word_counts(texts(spark, sf, "text"), F.col("text"))


@query("N7 N2", f"WITH {sql.WORD_VOCABULARY} SELECT id, token FROM specials UNION ALL SELECT id, word FROM vocab")
def word_vocabulary(spark, sf):
    return vocabulary(spark, sf)


@query("N5", f"SELECT doc_id, {sql.n_tokens('text')} AS n_tok FROM documents")
def word_token_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.count_tokens(F.col("text")).alias("n_tok"))


@query("N6 N4 F1", f"""WITH {sql.TOKEN_STREAM}
SELECT doc_id, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids, count(*)::INTEGER AS n FROM stream GROUP BY doc_id""")
def encoded_with_eos(spark, sf):
    rows = enc.encode_documents(texts(spark, sf, "doc_id", "text"), vocabulary(spark, sf), ["doc_id"], F.col("text"))
    rows = rows.withColumn("ids", enc.append_eos(F.col("ids")))
    return rows.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"),
                       F.size("ids").alias("n"))


@query("J4 N4", f"""WITH {sql.TOKEN_STREAM} SELECT doc_id, string_agg(id::VARCHAR, ' ' ORDER BY pos) AS ids
FROM stream WHERE pos < 1000000000 GROUP BY doc_id""")
def encoded_by_join(spark, sf):
    lookup = vocabulary(spark, sf).where(F.col("id") >= vocab.FIRST_ID).select(
        F.col("token").alias("word"), F.array("id").alias("ids"))
    rows = enc.encode_by_join(texts(spark, sf, "doc_id", "text"), lookup, ["doc_id"], F.col("text"))
    return rows.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("N9", f"SELECT doc_id, array_to_string(pieces, ' ') AS text FROM ({_PIECES})")
def decoded_text(spark, sf):
    words = vocabulary(spark, sf)
    ids = enc.encode_documents(texts(spark, sf, "doc_id", "text"), words, ["doc_id"], F.col("text"))
    return enc.decode(ids.withColumn("ids", enc.append_eos(F.col("ids"))), words, ["doc_id"])


@query("L3", f"""WITH {sql.WORD_TOKENS}, counts AS (SELECT word, count(*) AS freq FROM toks GROUP BY word),
pairs AS (SELECT substr(word, i::BIGINT, 2) AS pair, freq FROM counts, unnest(range(1, length(word))) AS r(i))
SELECT pair, sum(freq)::BIGINT AS pair_freq FROM pairs GROUP BY pair ORDER BY 2 DESC, 1 LIMIT 25""")
def top_character_pairs(spark, sf):
    return bpe.top_pairs(bpe.pair_counts(words_table(spark, sf)), 25)


@query("N3", f"""WITH RECURSIVE {sql.BPE_STATE}
SELECT * FROM (VALUES (0, '<unk>'), (1, '<pad>'), (2, '<|endoftext|>'), (3, '<|im_start|>'), (4, '<|im_end|>')) AS t(id, token)
UNION ALL SELECT n::INTEGER, s FROM state WHERE kind = 'v'""")
def bpe_vocabulary(spark, sf):
    return bpe.induce(words_table(spark, sf)).vocabulary(spark)


@query("N3", f"""WITH RECURSIVE {sql.BPE_STATE}
SELECT k::INTEGER AS rank, unicode(left(s, 1)) - 65536 AS id_a, unicode(right(s, 1)) - 65536 AS id_b, n::INTEGER AS id_merged
FROM state WHERE kind = 'm'""")
def bpe_merges(spark, sf):
    return bpe.induce(words_table(spark, sf)).merge_table(spark)


@query("N4", f"""WITH RECURSIVE {sql.BPE_STATE}
SELECT k AS word, array_to_string([unicode(ch) - 65536 FOR ch IN string_split(s, '')], ' ') AS ids FROM state WHERE kind = 'w'""")
def bpe_word_ids(spark, sf):
    counts = words_table(spark, sf)
    ids = enc.word_ids(counts, bpe.induce(counts))
    return ids.select("word", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query("N4 N5 N9", f"""SELECT doc_id, replace(array_to_string(pieces, ''), ' ', '') AS letters FROM ({_PIECES})""")
def bpe_round_trip(spark, sf):
    # Ids depend on the induced merges; their text without spaces does not.
    model = bpe.induce(words_table(spark, sf))
    ids = enc.encode_text(spark, model, F.col("text"))
    text = enc.decode(texts(spark, sf, "doc_id", "text").select("doc_id", ids.alias("ids")),
                      model.vocabulary(spark), ["doc_id"])
    return text.select("doc_id", F.replace("text", F.lit(" "), F.lit("")).alias("letters"))


@query("N4 N5 N9", f"""SELECT doc_id, replace(array_to_string(pieces, ''), ' ', '') AS letters FROM ({_PIECES})""")
def bpe_word_table(spark, sf):
    """Ids from a stored table of words: built from the documents of even number, extended by those that the others have anew."""
    docs = texts(spark, sf, "doc_id", "text")
    model = bpe.induce(words_table(spark, sf))
    known = enc.WordTable(spark, new_path(spark, "word-ids"), model)
    for some in ("doc_id % 2 = 0", "doc_id % 2 = 1"):
        known.extend(docs.where(some), F.col("text"))
    text = enc.decode(known.encode(docs, ["doc_id"], F.col("text")), model.vocabulary(spark), ["doc_id"])
    return text.select("doc_id", F.replace("text", F.lit(" "), F.lit("")).alias("letters"))
