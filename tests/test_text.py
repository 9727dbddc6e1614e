import html as stdlib_html
import random
import re
from html.entities import html5

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import cleaners, html, metadata, text as tx

SPACES = [chr(c) for c in range(0x3100) if chr(c).isspace()]
TEXTS = [
    "", " ", "plain", "  a  b ", "a\n\nb", "a\r\nb\r", "​zero​​width\xa0 nbsp\xa0",
    "tab\tand\x0bvt\x0cff", "　wide　", " \xa0 \n ", "end\n", "naïve café x", "a\x85b",
    *[f"{s}x{s}{s}y {s}" for s in SPACES],
]
HTML = [
    "&amp;lt;b&amp;gt;", "&ampx", "&#60;i&#62; it", "&notit;", "&nbsp;x&nbsp;", "a < b and c > d",
    "<p\nclass='x'>hi</p>", "Tom &amp; Jerry &copy; 2024 &quot;q&quot; &middot;", "a & b &c", "&lt;b&gt;bold",
    "&#x41;&#65;", "&hellip;&eacute;", "no entity", "", "<>", "&&amp;&", "​kept", "&#39;&#x27;", "&AMP;",
]


def column(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, v string")


def results(spark, values, expr):
    return [r.o for r in column(spark, values).select("i", expr.alias("o")).orderBy("i").collect()]


def test_space_table_is_complete():
    assert sorted(tx.PYTHON_SPACES) == sorted(chr(c) for c in range(0x110000) if chr(c).isspace())


def test_cleaning_equals_python(spark):
    v = F.col("v")
    assert results(spark, TEXTS, tx.collapse_spaces(v)) == [re.sub(r"\s+", " ", t) for t in TEXTS]
    assert results(spark, TEXTS, tx.strip(v)) == [t.strip() for t in TEXTS]
    assert results(spark, TEXTS, tx.flatten_lines(v)) == [" ".join(t.strip().split("\n")) for t in TEXTS]
    assert results(spark, TEXTS, tx.split_words(v)) == [t.split() for t in TEXTS]
    swapped = [re.sub("[​\xa0]", " ", t) for t in TEXTS]
    assert results(spark, TEXTS, tx.clean_plain(v)) == [" ".join(re.split(r"\s+", t)).strip() for t in swapped]
    assert results(spark, [None], tx.clean_plain(v)) == [None]


def test_every_name_and_number(spark):
    """All names with and without a semicolon, alone and glued to text, and numbers around every special range; no Python in the plan."""
    names = [n.rstrip(";") for n in html5]
    numbers = [*range(300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDCF, 0xFDD0, 0xFDEF, 0xFDF0, 0xFFFD, 0xFFFE, 0xFFFF, 0x10000, 0x1FFFE,
               0x1FFFF, 0x20000, 0x10FFFD, 0x10FFFF, 0x110000, 9999999, 10**8, 10**30, 0x1F600]
    rnd = random.Random(1)
    marks = ["&", "#", "x", "amp", ";", "lt", "not", "in", "a", "é", " ", "\n", "😀", "1", "&&", "&#", "&#x", "<", "AMP", "notit"]
    texts = ([f"a &{n}; b" for n in names] + [f"&{n}" for n in names] + [f"x&{n}z;&{n};&{n}" for n in names]
             + [f"&#{n};&#{n}&#x{n:x};&#X{n:X}q&#0{n};" for n in numbers]
             + ["".join(rnd.choice(marks) for _ in range(rnd.randrange(20))) for _ in range(1000)]
             + ["", "&", "&;", "&#;", "&#x;", "& amp;", "&" + "a" * 40 + ";", "&amp" + "b" * 40, "&\tx;"])
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", html.unescape(F.col("t")).alias("u"))
    assert {r.i: r.u for r in df.collect()} == {i: stdlib_html.unescape(t) for i, t in enumerate(texts)}
    plan = df.select(html.clean_html(F.col("u")))._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan


def test_html_equals_python(spark):
    v = F.col("v")
    plain = [stdlib_html.unescape(t) for t in HTML]
    assert results(spark, HTML, html.unescape(v)) == plain
    bare = [re.sub("<[^>]+>", " ", t) for t in plain]
    assert results(spark, HTML, html.clean_html(v)) == [" ".join(re.split(r"\s+", t)).strip() for t in bare]
    assert results(spark, [None], html.clean_html(v)) == [None]


def test_cleaner_by_source_key(spark):
    df = spark.createDataFrame([("stackoverflow_en", "<b>x</b>"), ("wiki", "<b>x</b>")], "source string, v string")
    got = df.select(cleaners.clean_by_name(F.col("v"), cleaners.cleaner_name(F.col("source"))).alias("o")).collect()
    assert [r.o for r in got] == ["x", "<b>x</b>"]


def test_tokens_equal_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    split = tokenizers.pre_tokenizers.Whitespace()
    words = TEXTS + HTML + ["don't (stop)!", "你好，世界", "éx", "x_1 ½ ²", "a‍b", "😀😀 ok"]
    got = results(spark, words, tx.tokens(F.col("v")))
    assert got == [[w for w, _ in split.pre_tokenize_str(t)] for t in words]
    assert results(spark, words, tx.count_tokens(F.col("v"))) == [len(w) for w in got]


def test_sizes(spark):
    want = {0: "0.0B", 1: "1.0B", 1023: "1023.0B", 1024: "1.0KB", 1280: "1.2KB", 1536: "1.5KB", 1048575: "1024.0KB", 1048576: "1.0MB",
            123456789: "117.7MB", 5 * 1024**3: "5.0GB", 3 * 1024**4: "3.0TB", 7 * 1024**5: "7168.0TB"}
    df = spark.createDataFrame([(v,) for v in want], "n bigint")
    assert {r.n: r.o for r in df.select("n", tx.human_size(F.col("n")).alias("o")).collect()} == want


def test_coercion_and_preview(spark):
    df = spark.createDataFrame([(None, 5, (1,), "x" * 201), ("t", None, None, "a\nb")],
                               "s string, n int, r struct<k:int>, long string")
    kinds = {f.name: f.dataType for f in df.schema}
    got = df.select(*[tx.as_text(F.col(c), kinds[c]).alias(c) for c in "snr"], tx.preview(F.col("long")).alias("p")).collect()
    assert tuple(got[0]) == ("", "5", '{"k":1}', "x" * 200 + " ...[truncated]")
    assert tuple(got[1]) == ("t", "", "", "a b")


QUALITY = [
    ('{"ccnet_perplexity": [[0, 9, 123.5]]}', True), ('{"ccnet_perplexity": [[0, 9, 400]]}', True),
    ('{"ccnet_perplexity": [[0, 9, 400.5]]}', False), ('{"ccnet_perplexity": [[0, 9, NaN]]}', True),
    ('{"ccnet_perplexity": []}', False), ("{}", False), ("oops", False), (None, False),
]


def test_quality_accept(spark):
    df = spark.createDataFrame([(i, "x" * 32, q) for i, (q, _) in enumerate(QUALITY)], "i int, t string, q string")
    ppl = metadata.perplexity(F.col("q"))
    kept = {r.i for r in df.where(metadata.accept(F.col("t"), ppl)).collect()}
    assert kept == {i for i, (_, keep) in enumerate(QUALITY) if keep}
    short = df.withColumn("t", F.lit("  " + "x" * 31 + "　"))
    assert short.where(metadata.accept(F.col("t"), ppl)).count() == 0
    with pytest.raises(Exception, match="quality signal is missing"):
        df.where(metadata.accept(F.col("t"), ppl, on_missing="error")).collect()


def test_language_from_text_struct_and_map(spark):
    df = spark.createDataFrame([('{"language": "fr"}', ("de",), {"language": "es"})],
                               "a string, b struct<language:string>, c map<string,string>")
    kinds = {f.name: f.dataType for f in df.schema}
    got = df.select(*[metadata.language(F.col(c), kinds[c]).alias(c) for c in "abc"]).first()
    assert tuple(got) == ("fr", "de", "es")
    assert isinstance(kinds["b"], T.StructType)


def test_distinct_ngrams_are_counted_in_parts_of_a_split(spark):
    from textloom.operators import evaluation as ev

    rows = [("a", "x y x y"), ("a", "x y z"), ("b", "one"), (None, "x y"), ("b", None), (None, "x y x")]
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    got = ev.corpus_distinct(frame, 2, ["lang"])
    assert f"RoundRobinPartitioning({2 * ev.TASKS_PER_SPLIT})" in got._jdf.queryExecution().executedPlan().toString()
    assert {r.lang: (r.ngrams, r.distinct_ngrams) for r in got.collect()} == {"a": (5, 3), None: (3, 2)}
