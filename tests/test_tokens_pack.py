import os
import random
import re
from collections import Counter
from itertools import chain

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import bpe, encode as enc, ordered, pack, vocab
from textloom.sources import readers, sinks
from textloom.workspace import freeze

SAMPLE = ["low lower lowest newer wider", "aaa aaaa banana bandana", "naïve café 你好 世界 😀😀",
          "new newest low low low", "x", "", None, "don't stop! (really) étude"]


def docs(spark):
    return spark.createDataFrame(list(enumerate(SAMPLE)), "doc_id bigint, text string")


def library(texts, vocab_size):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer(tokenizers.models.BPE(unk_token="<unk>"))
    tok.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    trainer = tokenizers.trainers.BpeTrainer(vocab_size=vocab_size, min_frequency=2,
                                             special_tokens=list(vocab.SPECIAL_TOKENS), show_progress=False)
    tok.train_from_iterator([t for t in texts if t], trainer=trainer)
    return tok


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_bpe_equals_library(spark, seed):
    rnd = random.Random(seed)
    alphabet = "ab" if seed else "abcdeé"
    texts = SAMPLE + [" ".join("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(1, 9))) for _ in range(30))
                      for _ in range(6)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = bpe.induce(vocab.word_counts(frame, F.col("text")), vocab_size=85)
    tok = library(texts, 85)
    assert {t: i for i, t in enumerate(model.tokens)} == tok.get_vocab()
    extra = frame.unionByName(spark.createDataFrame([(100, "unseenZZ wörd aab banana"),
                                                  (101, "a..<|endoftext|>b <unk>>< <|im_end|>|> <|endoftext <pad")], frame.schema))
    got = {r.doc_id: r.ids for r in extra.select(
        "doc_id", enc.encode_text(spark, model, F.coalesce("text", F.lit(""))).alias("ids")).collect()}
    for r in extra.collect():
        assert got[r.doc_id] == tok.encode(r.text or "", add_special_tokens=False).ids
    table = freeze(enc.word_ids(vocab.word_counts(extra, F.col("text"), enc.tokens), model))
    for limit in (10**6, 0):
        joined = enc.encode_by_join(extra, table, ["doc_id"], F.coalesce("text", F.lit("")), limit)
        assert {r.doc_id: r.ids for r in joined.collect()} == got


def brute_merges(counts, vocab_size):
    """One merge at a time over all words; a token that is there already keeps its id."""
    letters = sorted({ch for w in counts for ch in w})
    tokens = [*vocab.SPECIAL_TOKENS, *letters]
    ids, merges = {t: i for i, t in enumerate(tokens)}, []
    words = [([ids[ch] for ch in w], n) for w, n in counts.items()]
    while len(tokens) < vocab_size:
        pairs = Counter()
        for own, n in words:
            for pair in zip(own, own[1:]):
                pairs[pair] += n
        a, b = best = min(pairs, key=lambda p: (-pairs[p], p), default=(0, 0))
        if pairs[best] < 2:
            break
        text = tokens[a] + tokens[b]
        if text not in ids:
            ids[text] = len(tokens)
            tokens.append(text)
        merges.append((a, b, ids[text]))
        for own, _ in words:
            i = 0
            while i + 1 < len(own):
                if (own[i], own[i + 1]) == best:
                    own[i:i + 2] = [ids[text]]
                i += 1
    return tokens, merges


@pytest.mark.parametrize("seed, letters, top, symbols", [
    (0, "ab", 1, 1 << 20), (1, "ab", 3, 1 << 20), (2, "abcdeé", 4, 40), (3, "a😀", 2, 1 << 20), (4, "abcdefgh", 16, 60)])
def test_bpe_rounds_equal_one_merge_at_a_time(spark, seed, letters, top, symbols):
    """Few pairs a round, and segments beyond the limit: the merges stay the same."""
    rnd = random.Random(seed)
    counts = Counter("".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 10))) for _ in range(60))
    size = len(vocab.SPECIAL_TOKENS) + len(letters) + 14
    frame = spark.createDataFrame(list(counts.items()), "word string, freq bigint")
    model = bpe.induce(frame, vocab_size=size, top=top, segment_symbols=symbols)
    assert (model.tokens, model.merges) == brute_merges(counts, size)


def test_bpe_merges_that_spell_a_special_token(spark):
    """The token has its small id, which breaks the order of ranks; the index is built anew."""
    counts = {"<unk>": 9, "x<unk>": 4, "<unk>x": 4, "y<unk>y": 4, "<pad>": 4, "kx": 4, "yk": 4, "a<pad>a": 4}
    want = brute_merges(counts, 45)
    assert len({c for _, _, c in want[1]} & {0, 1}) == 2
    frame = spark.createDataFrame(list(counts.items()), "word string, freq bigint")
    for top in (1, 4, 100):
        model = bpe.induce(frame, vocab_size=45, top=top)
        assert (model.tokens, model.merges) == want


def test_bpe_of_no_words(spark):
    empty = spark.createDataFrame([], "word string, freq bigint")
    assert bpe.induce(empty).tokens == list(vocab.SPECIAL_TOKENS)
    assert bpe.induce(spark.createDataFrame([("x", 9)], empty.schema)).merges == []


def test_decode_both_ways(spark):
    frame = docs(spark).where("text is not null")
    words = vocab.word_vocabulary(vocab.word_counts(frame, F.col("text")), rows_per_cell=5)
    ids = enc.encode_documents(frame, words, ["doc_id"], F.col("text"))
    joined = enc.encode_documents(frame, words, ["doc_id"], F.col("text"), max_broadcast=0)
    assert sorted(ids.collect()) == sorted(joined.collect())
    ids = ids.withColumn("ids", enc.append_eos(F.col("ids")))
    want = {r.doc_id: " ".join(r.w) for r in frame.select("doc_id", tx.tokens(F.col("text")).alias("w")).collect()}
    for limit in (1 << 16, 0):
        assert {r.doc_id: r.text for r in enc.decode(ids, words, ["doc_id"], max_literal=limit).collect()} == want


def slices(lists, length):
    """The whole line of ids cut at multiples of ``length``; a last slice of at least half of it is padded."""
    line = list(chain.from_iterable(lists))
    whole, rest = divmod(len(line), length)
    rows = [line[i * length:(i + 1) * length] for i in range(whole)]
    tail = line[whole * length:] + [0] * (length - rest)
    return rows + [tail] * (rest >= length // 2 and (rest > 0 or length < 2))


@pytest.mark.parametrize("cell", [1 << 25, 40, 3])
@pytest.mark.parametrize("length", [2, 3, 8, 50])
def test_pack_cuts_one_line(spark, length, cell):
    rnd = random.Random(length)
    data = [[rnd.randrange(0, 9) for _ in range(rnd.choice([0, 1, 2, 5, 30]))] for _ in range(50)]
    frame = spark.createDataFrame(list(enumerate(data)), "doc_id bigint, ids array<int>").withColumn("n", F.size("ids")).repartition(4)
    got = pack.finish_rows(pack.pack_rows(frame, ["doc_id"], length, tokens_per_cell=cell), length, 3 * length)
    rows = sorted(got.collect(), key=lambda r: r.row_idx)
    assert [r.input_ids for r in rows] == slices(data, length)
    assert [r.row_idx for r in rows] == list(range(len(rows)))
    assert all(r.attention_mask == [int(i != 0) for i in r.input_ids] and r.shard_id == r.row_idx // 3 for r in rows)


@pytest.mark.parametrize("extra", [0, 1, 2, 3])
def test_tail_rule_at_the_border(spark, extra):
    frame = spark.createDataFrame([(0, list(range(1, 15 + extra)), 14 + extra)],
                                  "doc_id bigint, ids array<int>, n int")
    got = pack.finish_rows(pack.pack_rows(frame, ["doc_id"], 11), 11, 100, mask="length").collect()
    tail = 3 + extra
    assert len(got) == (2 if tail >= 5 else 1)


def test_pack_shuffles_arrays_once(spark):
    frame = freeze(spark.range(200).select(
        F.col("id").alias("doc_id"), F.array_repeat(F.lit(1), 9).alias("ids"), F.lit(9).alias("n")))
    rows = pack.pack_rows(frame, ["doc_id"], 16, tokens_per_cell=200)
    rows.collect()
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    by_cell = [line for line in plan.split("\n") if "Exchange hashpartitioning(_cell" in line]
    assert sum("ReusedExchange" not in line for line in by_cell) == 1
    assert sum("ReusedExchange" in line for line in by_cell) == 1


def test_no_cell_beyond_twice_its_tokens(spark):
    """One giant document among tiny ones: it spans cells, and the rows stay the same."""
    sizes = [1, 3, 2] * 40 + [5000] + [2, 1] * 40 + [37, 0, 36]
    line = list(range(sum(sizes)))
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    frame = freeze(spark.createDataFrame([(i, line[a:a + n], n) for i, (a, n) in enumerate(zip(starts, sizes))],
                                         "doc_id bigint, ids array<int>, n int").repartition(5))
    got = {r.row_idx: r.ids for r in pack.pack_rows(frame, ["doc_id"], 16, tokens_per_cell=36).collect()}
    assert got == {i: line[16 * i:16 * i + 16] for i in range(-(-len(line) // 16))}
    parts = frame.where("n <= 36")
    cells = ordered.cells_by_weight(parts, ["doc_id"], "n", 36, rows_per_cell=10).groupBy(ordered.CELL).agg(
        F.sum("n").alias("held"), F.min("_before").alias("before"), F.max("_before").alias("same")).orderBy(ordered.CELL).collect()
    at = 0
    assert len(cells) > 5
    for r in cells:
        assert r.held < 72 and r.before == r.same == at
        at += r.held


def test_both_ways_to_encode_agree_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "low <pad> new zzz"), (3, "low <pad> new zzz"), (3, "low"), (4, "<unk>"), (None, "new")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = spark.createDataFrame([(5, "low"), (9, "new"), (12, "<pad>"), (13, "<unk>")], "id int, token string")
    shown = [sorted(map(repr, enc.encode_documents(odd, words, ["doc_id"], F.col("text"), max_broadcast=n).collect())) for n in (100, 0)]
    assert shown[0] == shown[1] and len(shown[0]) == len(rows)
    special = enc.SPECIAL_IDS
    assert repr([5, special["<pad>"], 9, vocab.UNK_ID]) in shown[0][1] + shown[0][2] + shown[0][3] + shown[0][4]
    ids = spark.createDataFrame([(1, None), (2, []), (3, [5, 7, 9, 1]), (3, [5, 7, 9, 1]), (4, [8])], "doc_id bigint, ids array<int>")
    texts = [sorted(map(repr, enc.decode(ids, words, ["doc_id"], max_literal=n).collect())) for n in (1 << 16, 0)]
    assert texts[0] == texts[1] and len(texts[0]) == 5 and texts[0][2] == "Row(doc_id=3, text='low new')"


def test_long_words_encode_in_order_n_log_n():
    import time

    letters = ["a", "b"]
    model = bpe.BpeModel([*vocab.SPECIAL_TOKENS, *letters, "ab", "abab", "ba", "aa"],
                         [(5, 6, 7), (7, 7, 8), (6, 5, 9), (5, 5, 10)])

    def slow(word):
        parts = [model.ids[ch] for ch in word]
        while True:
            ranked = [(model.ranks[pair][0], i) for i, pair in enumerate(zip(parts, parts[1:])) if pair in model.ranks]
            if not ranked:
                return parts
            _, i = min(ranked)
            parts[i:i + 2] = [model.ranks[(parts[i], parts[i + 1])][1]]

    rnd = random.Random(1)
    for n in (1, 2, 3, 7, 40, 90):
        word = "".join(rnd.choice(letters) for _ in range(n))
        assert model.encode_word(word) == slow(word)
    start = time.time()
    model.encode_word("ab" * 100_000)
    assert time.time() - start < 5


def test_packed_rerun_leaves_no_old_shards(spark, tmp_path):
    rows = spark.range(10).select(F.col("id").alias("row_idx"), (F.col("id") % 5).alias("shard_id"))
    for n in (10, 2):
        sinks.write_packed(rows.where(F.col("row_idx") < n), str(tmp_path / "p"))
    assert readers.read_packed(spark, str(tmp_path / "p")).count() == 2


def test_hot_words_are_spread(spark):
    """One word in nine places of ten, joined and not broadcast."""
    hot = spark.range(300).selectExpr("id AS doc_id", "concat(repeat('hot ', 90), 'w', id % 7, ' rare') AS text")
    words = spark.createDataFrame([(5, "hot"), (6, "rare"), (7, "w1")], "id int, token string")
    got, want = (sorted(enc.encode_documents(hot, words, ["doc_id"], F.col("text"), max_broadcast=n).collect()) for n in (0, 100))
    assert got == want


def test_ranks_come_from_the_files_and_are_verified(spark, tmp_path):
    rows = spark.range(50).select(F.col("id").alias("row_idx"), F.floor(F.col("id") / 7).alias("shard_id"), F.array(F.lit(1)).alias("input_ids"))
    a, b, c = (str(tmp_path / n) for n in "abc")
    sinks.write_packed(rows, a)
    sinks.write_packed(rows.where("row_idx % 2 = 1"), b)
    got = sorted((r.root, r.row_idx, r["rank"]) for r in readers.ranked_packed(spark, b, a).collect())
    assert got == [*((0, 2 * i + 1, i) for i in range(25)), *((1, i, 25 + i) for i in range(50))]
    swapped = rows.withColumn("row_idx", F.when(F.col("row_idx") == 3, 4).when(F.col("row_idx") == 4, 3).otherwise(F.col("row_idx")))
    swapped.coalesce(1).write.partitionBy("shard_id").parquet(c)
    with pytest.raises(Exception, match="is out of order in"):
        readers.ranked_packed(spark, a, c).collect()
    sinks.write_packed(rows.unionByName(rows.where("row_idx = 9")), c)
    with pytest.raises(Exception, match="two rows have the order key"):
        readers.ranked_packed(spark, c).collect()


def test_word_table_grows_by_unseen_words(spark, tmp_path):
    """A corpus encoded twice encodes its words once; a later one encodes what is new. All equal the direct way."""
    texts = ["low lower lowest low", "newer <unk> wider low", None, "", "naïve low 😀"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    model = bpe.induce(vocab.word_counts(frame, F.col("text")), vocab_size=40)
    more = frame.unionByName(spark.createDataFrame([(9, "low unseen wider"), (10, "unseen")], frame.schema))
    table = enc.WordTable(spark, str(tmp_path / "words"), model)
    show = lambda df: sorted(map(tuple, df.collect()), key=repr)
    for docs, new in ((frame, 8), (frame, 0), (more, 1), (more, 0)):
        direct = docs.select("doc_id", enc.encode_text(spark, model, F.col("text")).alias("ids"))
        assert table.extend(docs, F.col("text")) == new
        for limit in (10**6, 0):
            assert show(table.encode(docs, ["doc_id"], F.col("text"), limit)) == show(direct)
    words = [r.word for r in spark.read.parquet(str(tmp_path / "words")).collect()]
    assert len(words) == len(set(words)) == 9
    # An extension that was killed counts for nothing.
    spark.createDataFrame([("low", [0])], "word string, ids array<int>").write.parquet(str(tmp_path / "words" / "part=99"))
    os.remove(str(tmp_path / "words" / "part=99" / "_SUCCESS"))
    assert show(table.encode(more, ["doc_id"], F.col("text"))) == show(more.select("doc_id", enc.encode_text(spark, model, F.col("text")).alias("ids")))
    with pytest.raises(ValueError):
        enc.WordTable(spark, str(tmp_path / "words"), bpe.BpeModel([*vocab.SPECIAL_TOKENS, "a"], []))


def test_small_shards_share_files(spark, tmp_path):
    rows = spark.range(600).select(F.col("id").alias("row_idx"), F.floor(F.col("id") / 2).alias("shard_id"), F.array(F.lit(1)).alias("input_ids"))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    sinks.write_packed(rows, a, shards_a_file=sinks.together(sinks.FILE_TOKENS // 100))
    sinks.write_packed(rows.where("row_idx % 3 > 0"), b, shards_a_file=7)
    assert len(spark.read.parquet(a).inputFiles()) == 3 and sinks.together(sinks.FILE_TOKENS) == sinks.together(50_000_000) == 1
    back = readers.read_packed(spark, a, b)
    assert set(back.columns) == {"row_idx", "input_ids", "shard_id", "root"}
    assert {(r.root, r.shard_id, r.row_idx) for r in back.collect()} == {(k, i // 2, i) for k in (0, 1) for i in range(600) if not k or i % 3}
    got = sorted((r["rank"], r.root, r.row_idx) for r in readers.ranked_packed(spark, a, b).collect())
    want = [(0, i) for i in range(600)] + [(1, i) for i in range(600) if i % 3]
    assert got == [(n, *w) for n, w in enumerate(want)]


@pytest.mark.parametrize("most", [0, 2, 40])
def test_only_rare_words_and_far_ids_are_joined(spark, most):
    """Any division into frequent and rare words gives the ids of the plain lookup, rows repeated or empty included."""
    rows = [(i % 90, " ".join(["the"] * (i % 4) + ["of", f"w{i % 37}", "<pad>", f"x{i * i % 61}", "nowhere"][i % 3:])) for i in range(200)]
    rows += [(1, None), (2, ""), (None, "the w3"), (7, "the the"), (7, "the the")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    words = vocab.word_vocabulary(vocab.word_counts(frame.where("text NOT LIKE '%nowhere'"), F.col("text")), rows_per_cell=5)
    many = {f"w{i}": [100 + i] * (1 + i % 3) for i in range(30)} | {"the": [7, 8], "of": []}
    table = spark.createDataFrame(list(many.items()), "word string, ids array<int>")
    ids = lambda text: [n for w in re.findall(r"<pad>|\w+", text) for n in (many | {t: [i] for t, i in enc.SPECIAL_IDS.items()}).get(w, [vocab.UNK_ID])]
    for limit in (0, 100):
        got = enc.encode_by_join(frame, table, ["doc_id"], F.col("text"), limit, most)
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((k, None if t is None else ids(t))) for k, t in rows)
    known = enc.encode_documents(frame, words, ["doc_id"], F.col("text"))
    whole = sorted(map(repr, enc.decode(known, words, ["doc_id"]).collect()))
    assert sorted(map(repr, enc.decode(known, words, ["doc_id"], max_literal=most).collect())) == whole


def test_joined_rows_are_the_rare_words_alone(spark):
    """A word in nine places of ten is encoded where the text is read."""
    hot = spark.range(300).selectExpr("id AS doc_id", "concat(repeat('hot ', 90), 'w', id) AS text")
    table = spark.createDataFrame([("hot", [5])] + [(f"w{i}", [6 + i]) for i in range(300)], "word string, ids array<int>")
    assert enc.frequent_words(hot, table, F.col("text"), 10) == {"hot": [5]}
    got = {r.doc_id: r.ids for r in enc.encode_by_join(hot, table, ["doc_id"], F.col("text"), 0, 10).collect()}
    assert got == {i: [5] * 90 + [6 + i] for i in range(300)}


def test_word_cache_of_a_task_is_bounded():
    import pyarrow as pa

    cache, words = {}, [f"w{i}" for i in range(300_000)]
    for _ in range(2):
        got = enc._encode_lists(pa.array([words]), lambda word: [int(word[1:])], cache)
        assert got.to_pylist() == [list(range(300_000))] and len(cache) <= 1 << 18


def test_millions_of_words_need_no_shuffle(spark):
    """A vocabulary beyond what Spark broadcasts to a join is held by the tasks as arrays."""
    words = spark.range(5, (1 << 21) + 50).select(F.col("id").cast("int").alias("id"), F.concat(F.lit("w"), "id").alias("token"))
    frame = spark.createDataFrame([(1, "w2097200 w5 <pad> nowhere"), (2, None), (3, "")], "doc_id bigint, text string")
    ids = enc.encode_documents(frame, words, ["doc_id"], F.col("text"))
    text = enc.decode(ids, words, ["doc_id"])
    assert sorted(map(tuple, ids.collect())) == [(1, [2097200, 5, vocab.PAD_ID, vocab.UNK_ID]), (2, None), (3, [])]
    assert sorted(map(tuple, text.collect())) == [(1, "w2097200 w5"), (2, None), (3, "")]
    for df in (ids, text):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Exchange" not in plan


def test_words_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(enc, "_hashes", lambda words: np.array([len(w) for w in words.to_pylist()], np.uint64))
    model = enc.WordModel(pa.array(["ab", "cd", "ef", "cd", "x", "<pad>"]), np.array([7, 8, 9, 10, 11, 12]))
    assert model.encode_words(pa.array(["ef", "x", "cd", "ab", "zz", "y", "<pad>", "long"])).tolist() == [9, 11, 10, 7, 0, 0, vocab.PAD_ID, 0]
    assert model.encode_words(pa.array([], pa.string())).tolist() == [] and model.ids["ef"] == 9


@pytest.mark.parametrize("held", [0, 40])
def test_decode_holds_or_joins(spark, held):
    ids = spark.createDataFrame([(1, None), (2, []), (3, [5, 7, 39, 1]), (4, [5, 8, 900, 39])], "doc_id bigint, ids array<int>")
    words = spark.createDataFrame([(5, "low"), (8, "é"), (39, "new")], "id int, token string")
    got = enc.decode(ids, words, ["doc_id"], max_literal=6, max_held=held)
    assert sorted(map(tuple, got.collect())) == [(1, None), (2, ""), (3, "low new"), (4, "low é new")]


def test_held_words_and_joined_ones_agree(spark, tmp_path, monkeypatch):
    """However many words the tasks hold, the ids are the same; only words that are not held are joined."""
    docs = spark.createDataFrame([(1, "low low lower <|endoftext|>"), (2, "newest widest low"), (3, None), (4, ""), (4, ""), (5, "\u00e9t\u00e9 low!")], "doc_id int, text string")
    model = bpe.induce(vocab.word_counts(docs, F.col("text")), 40)
    show = lambda df: sorted(map(repr, df.collect()))
    table = enc.WordTable(spark, str(tmp_path / "words"), model)
    table.extend(docs, F.col("text"))
    more = docs.unionByName(spark.createDataFrame([(6, "unseen low")], docs.schema))
    shown = [show(table.encode(more, ["doc_id"], F.col("text"), 0, held)) for held in (1 << 20, 3, 0)]
    assert shown[0] == shown[1] == shown[2]
    assert show(table.encode(docs, ["doc_id"], F.col("text"))) == show(docs.select("doc_id", enc.encode_text(spark, model, F.col("text")).alias("ids")))
    words = vocab.word_vocabulary(vocab.word_counts(docs, F.col("text")))
    joined, found = [], enc._looked_up
    monkeypatch.setattr(enc, "_looked_up", lambda rows, column, *rest: joined.append(
        rows.agg(F.sum(F.size(column))).first()[0]) or found(rows, column, *rest))
    shown = [show(enc.encode_documents(docs, words, ["doc_id"], F.col("text"), n)) for n in (1000, 8, 0)]
    assert shown[0] == shown[1] == shown[2]
    every = docs.select(F.explode(enc.tokens(F.col("text"))).alias("token"))
    behind = every.join(words, "token").where((F.col("id") >= 8)).count()
    assert joined[0] == behind < every.count()
