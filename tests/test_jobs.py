import json

from pyspark.sql import functions as F

from textloom.__main__ import main
from textloom.operators import bpe
from textloom.sources import readers, sinks


def test_jobs_from_sources_to_batches(spark, sf, tmp_path):
    """Lines -> vocabulary -> corpus -> packed rows, each read from disk."""
    at = lambda name: str(tmp_path / name)
    sources = [
        dict(key="prose", path=f"{sf}/documents.parquet", lang="mul"),
        dict(key="stackoverflow_pages", path=f"{sf}/pages.parquet", text_field="html", order_by="page_id", lang="en"),
    ]
    (tmp_path / "sources.json").write_text(json.dumps(sources))
    main(["lines", "--sources", at("sources.json"), "--out", at("lines"), "--max_lines", "40"], spark)
    assert spark.read.text(at("lines")).count() == 40
    main(["tokenizer", "--input", at("lines"), "--out_dir", at("tok"), "--vocab_size", "130"], spark)
    model = bpe.load(spark, at("tok"))
    assert len(model.tokens) <= 130 and model.tokens[:3] == ["<unk>", "<pad>", "<|endoftext|>"]
    main(["corpus", "--sources", at("sources.json"), "--mix", "prose=3,stackoverflow_pages=1,none=4", "--total_tokens",
          "200000", "--shard_tokens", "30000", "--out_dir", at("corpus"), "--tokenizer_dir", at("tok")], spark)
    shards = spark.read.parquet(at("corpus"))
    assert {r.source for r in shards.select("source").distinct().collect()} == {"prose", "stackoverflow_pages"}
    main(["pack", "--shard_dir", at("corpus"), "--out_dir", at("packed"), "--tokenizer_dir", at("tok"), "--seq_len", "128",
          "--shard_tokens", "20000"], spark)
    rows = readers.read_packed(spark, at("packed"))
    assert rows.where(F.size("input_ids") != 128).count() == 0 and rows.count() > 500
    ends = rows.agg(F.sum(F.size(F.filter("input_ids", lambda i: i == 2)))).first()[0]
    # A tail of less than half a row is dropped; it may hold the last end token.
    assert shards.count() - ends in (0, 1)


def test_loss_and_perplexity_jobs(spark, sf, tmp_path, capsys):
    (tmp_path / "t.log").write_text("".join(f"step {i:7d} | loss {10 / (i + 1):.4f}\n" for i in range(50)))
    main(["loss", "--log", str(tmp_path / "t.log"), "--csv", str(tmp_path / "csv"), "--every", "5", "--ema", "0.9"], spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 10
    main(["perplexity", "--train", f"{sf}/documents.parquet", "--dataset", f"{sf}/benchmark.parquet", "--order_by",
          "item_id", "--block_size", "64"], spark)
    assert "perplexity" in capsys.readouterr().out


def test_batches_and_generations_jobs(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    rows = spark.range(23).select(F.col("id").alias("row_idx"), F.floor(F.col("id") / 5).alias("shard_id"),
                                  F.array(F.col("id").cast("int"), F.lit(7)).alias("input_ids"), F.lit([1, 1]).cast("array<smallint>").alias("attention_mask"))
    sinks.write_packed(rows, at("a"))
    sinks.write_packed(rows.where("row_idx < 4"), at("b"))
    main(["batches", "--packed_dir", at("a"), at("b"), "--out_dir", at("out"), "--batch_size", "4", "--workers", "2", "--seed", "3"], spark)
    got = spark.read.parquet(at("out"))
    assert got.schema["input_ids"].dataType.simpleString() == "array<array<bigint>>"
    ids = sorted(r[0] for b in got.collect() for r in b.input_ids)
    assert ids == sorted([*range(23), *range(4)]) and {r.worker for r in got.collect()} == {0, 1}
    (tmp_path / "records.jsonl").write_text(
        '{"prompt:": "é", "output": "a b a b", "sec": 1.23456}\n{"prompt": "q", "output": "", "sec": 2}\n')
    main(["generations", "--records", at("records.jsonl"), "--out_dir", at("gen")], spark)
    found = {r.prompt: (r.output, r.sec, r.distinct_1, r.distinct_2) for r in spark.read.json(at("gen")).collect()}
    assert found["é"] == ("a b a b", 1.2346, 0.5, 0.6667) and found["q"][:2] == ("", 2.0)
