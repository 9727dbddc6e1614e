"""Jobs for ``spark-submit``: python -m textloom <job> --help

``--sources`` names a JSON file: a list of objects with the fields of
``textloom.sources.registry.Source``.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as tx
from textloom.operators import bpe, encode as enc, epochs, evaluation as ev, series, vocab
from textloom.plans.corpus import Corpus, line_corpus, mixed_corpus, quality_subset
from textloom.plans.packing import packed_rows
from textloom.plans.training_log import loss_series
from textloom.session import build_session
from textloom.sources import readers, sinks
from textloom.sources.registry import Source, registry_frame, scan_sources, tag_sources
from textloom.workspace import drop_workspace, freeze


def _sources(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        sources = [Source(**entry) for entry in json.load(f)]
    return scan_sources(spark, sources), registry_frame(spark, sources)


def _counter(spark: SparkSession, tokenizer: str | None):
    return enc.bpe_counter(spark, bpe.load(spark, tokenizer)) if tokenizer else tx.count_tokens


def _write(built: Corpus, a: argparse.Namespace) -> None:
    if a.publish:
        sinks.publish_shards(built.documents, a.out_dir, built.shard_sizes()).groupBy("source").agg(
            F.sum("files").alias("files"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens")).show(100, False)
    else:
        sinks.write_shards(built.documents, a.out_dir, clean=a.clean)


def corpus(spark: SparkSession, a: argparse.Namespace) -> None:
    docs, registry = _sources(spark, a.sources)
    built = mixed_corpus(docs, registry, a.mix, a.total_tokens, int(a.shard_tokens), ["ord_key"], a.min_chars,
                         _counter(spark, a.tokenizer_dir), a.shard_mode)
    _write(built, a)
    built.summary().show(100, False)


def subset(spark: SparkSession, a: argparse.Namespace) -> None:
    crawl = spark.read.parquet(a.crawl_dir)
    built = quality_subset(crawl, a.target_tokens, int(a.shard_tokens), [a.order_by],
                           counter=_counter(spark, a.tokenizer_dir), on_missing=a.on_missing, shard_mode=a.shard_mode)
    _write(built, a)
    built.summary().show(100, False)


def lines(spark: SparkSession, a: argparse.Namespace) -> None:
    docs, registry = _sources(spark, a.sources)
    # Lines keep the text as it is; only line feeds go.
    taken = freeze(line_corpus(tag_sources(docs, registry), a.max_mb * 1024 * 1024, a.max_lines, "ord_key"), "lines")
    sinks.write_lines(taken, a.out, ["line_no"])
    taken.agg(F.count(F.lit(1)).alias("lines"), tx.human_size(F.sum(tx.line_bytes(F.col("line")))).alias("size")).show()


def tokenizer(spark: SparkSession, a: argparse.Namespace) -> None:
    texts = readers.spread(spark.read.text(a.input))
    model = bpe.induce(vocab.word_counts(texts, F.col("value")), a.vocab_size, a.min_frequency)
    bpe.save(model, spark, a.out_dir)


def pack(spark: SparkSession, a: argparse.Namespace) -> None:
    docs = sinks.read_shards(spark, a.shard_dir, None)
    rows = packed_rows(docs, bpe.load(spark, a.tokenizer_dir), a.order_by, a.seq_len, int(a.shard_tokens), a.max_rows)
    sinks.write_packed(rows, a.out_dir, shards_a_file=sinks.together(a.shard_tokens))


def loss(spark: SparkSession, a: argparse.Namespace) -> None:
    points = loss_series(readers.read_log(spark, a.log), a.every, a.ma, a.ema)
    points = series.clip(points, tuple(a.xlim) if a.xlim else None, tuple(a.ylim) if a.ylim else None)
    sinks.write_series(points.select("run", "point", "step", "loss", "smoothed"), a.csv, ["run", "point"])


def perplexity(spark: SparkSession, a: argparse.Namespace) -> None:
    bigrams = freeze(ev.bigram_counts(spark.read.parquet(a.train), tx.tokens(F.col("text"))), "bigrams")
    texts = readers.evaluation_set(spark.read.parquet(a.dataset), [a.order_by], max_samples=a.max_samples)
    blocks = ev.text_blocks(texts, [a.order_by], a.block_size)
    ev.perplexity(ev.block_losses(blocks, bigrams, [a.order_by])).show()


def batches(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = readers.read_packed(spark, *a.packed_dir)
    slots = epochs.batch_slots(rows, a.batch_size, a.workers, a.seed, a.epoch, not a.no_shuffle_files, a.shuffle_rows)
    epochs.batches(slots).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("worker").parquet(a.out_dir)


def generations(spark: SparkSession, a: argparse.Namespace) -> None:
    records = readers.generation_records(spark, a.records)
    scored = ev.diversity(records).select(
        "prompt", "output", *[tx.round4(F.col(c)).alias(c) for c in ("sec", "distinct_1", "distinct_2")])
    sinks.write_generations(scored, a.out_dir, literal_prompt_key=a.literal_prompt_key)
    scored.agg(F.count(F.lit(1)).alias("records"), *[F.avg(c).alias(c) for c in ("sec", "distinct_1", "distinct_2")]).show()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="textloom", description=__doc__)
    jobs = top.add_subparsers(required=True)

    def job(run, *options: tuple[str, dict]) -> None:
        sub = jobs.add_parser(run.__name__)
        for name, how in options:
            sub.add_argument(name, **how)
        sub.set_defaults(run=run)

    need, number, whole = dict(required=True), dict(type=float), dict(type=int)
    shards = (("--shard_tokens", {**number, "default": 1e8}), ("--out_dir", need), ("--tokenizer_dir", {}),
              ("--shard_mode", dict(default="greedy", choices=["greedy", "uniform"])), ("--clean", dict(action="store_true")),
              ("--publish", dict(action="store_true", help="write a set of its own and a manifest that names it")))
    job(corpus, ("--sources", need), ("--mix", need), ("--total_tokens", {**number, "default": 9e9}),
        ("--min_chars", {**whole, "default": tx.MIN_CHARS}), *shards)
    job(subset, ("--crawl_dir", need), ("--order_by", dict(default="doc_id")), ("--target_tokens", {**number, "default": 3e9}),
        ("--on_missing", dict(default="drop", choices=["drop", "error"])), *shards)
    job(lines, ("--sources", need), ("--out", need), ("--max_mb", {**whole, "default": 100}), ("--max_lines", whole))
    job(tokenizer, ("--input", need), ("--out_dir", need), ("--vocab_size", {**whole, "default": 32000}),
        ("--min_frequency", {**whole, "default": 2}))
    job(pack, ("--shard_dir", need), ("--out_dir", need), ("--tokenizer_dir", need), ("--seq_len", {**whole, "default": 2048}),
        ("--order_by", dict(nargs="+", default=["source", "shard_id", "ord_key"])),
        ("--shard_tokens", {**number, "default": 5e7}), ("--max_rows", {**whole, "default": 0}))
    job(loss, ("--log", need), ("--csv", need), ("--every", {**whole, "default": 1}), ("--ma", {**whole, "default": 0}),
        ("--ema", number), ("--xlim", {**whole, "nargs": 2}), ("--ylim", {**number, "nargs": 2}))
    job(perplexity, ("--train", need), ("--dataset", need), ("--order_by", dict(default="doc_id")),
        ("--max_samples", {**whole, "default": 2000}), ("--block_size", {**whole, "default": 2048}))
    job(batches, ("--packed_dir", dict(required=True, nargs="+")), ("--out_dir", need), ("--batch_size", {**whole, "default": 4}),
        ("--workers", {**whole, "default": 1}), ("--seed", {**whole, "default": 42}), ("--epoch", {**whole, "default": 0}),
        ("--no_shuffle_files", dict(action="store_true")), ("--shuffle_rows", dict(action="store_true")))
    job(generations, ("--records", need), ("--out_dir", need), ("--literal_prompt_key", dict(action="store_true")))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    own = spark is None
    spark = spark or build_session()
    args.run(spark, args)
    if own:
        drop_workspace(spark)
        spark.stop()


if __name__ == "__main__":
    main()
