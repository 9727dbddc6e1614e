"""Shards, URL rules and fingerprints: definitions, odd rows, and no Python in the plans."""

import hashlib
import random
import re
import zlib

import brute
import pytest
import xxhash
from pyspark.sql import functions as F

from textloom.llm.fingerprints import BINS, PROBES, SHINGLE, add_fingerprint, likeness, neighbour_fingerprints, with_next
from textloom.llm.hilbert import as_number, curve_shards, hilbert_index
from textloom.llm.url_rules import judge_urls


@pytest.mark.parametrize("dims, bits", [(2, 3), (3, 2), (3, 3), (4, 2)])
def test_hilbert_curve_is_a_path_through_all_cells(spark, dims, bits):
    side = 1 << bits
    cells = spark.range(side ** dims).select(*[
        (F.col("id") / side ** i % side).cast("int").alias(f"x{i}") for i in range(dims)])
    got = cells.select("*", hilbert_index([F.col(f"x{i}") for i in range(dims)], bits).alias("at")).orderBy("at").collect()
    assert [r.at for r in got] == list(range(side ** dims))
    for a, b in zip(got, got[1:]):
        assert sum(abs(a[i] - b[i]) for i in range(dims)) == 1


def shards(df, n=16):
    dims = {"size": F.length("text").cast("double"), "key": as_number(F.col("id"), "string")}
    return curve_shards(df, "doc_id", dims, n)


def test_curve_shards(spark, docs_of):
    rng = random.Random(1)
    rows = [(i if i % 7 else None, "x" * rng.choice([0, 3, 3, 3, 9, 40])) for i in range(333)] + [(5, None)] * 3 + [(6, "same")] * 40
    got = shards(docs_of(rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    sizes = [len(v) for v in by.values()]
    assert set(by) == set(range(16)) and max(sizes) - min(sizes) <= 1 and sum(sizes) == len(rows)
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    ends = [(min(r.curve for r in by[s]), max(r.curve for r in by[s])) for s in range(16)]
    assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    few = shards(docs_of(rows[:3])).collect()
    assert len(few) == 3 and all(0 <= r.shard < 16 and r.slot == 0 for r in few)
    assert shards(docs_of([])).count() == 0


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("EXAMPLE.com", "/de/", "block"), ("org", "/fr/", "allow"),
         ("a.b", "/x", "block"), ("b", "/xyz", "allow"), ("c", "", "block"), (None, "/", "block"), ("tie.z", "/a", "allow"), ("z", "/a.tie"[:6], "block")]
URLS = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "ftp://x.example.net/en/1", "http://example.net/en", "http://notexample.net/en/",
        "http://example.com/de/?a#b", "http://www.example.com/DE/", "http://m.org/fr/", "http://org/fr/x://y", "http://x.a.b/xyzw", "http://a.b?x", "http://c", "http://..c#/",
        "http://net:80/", "a://b://c/d", "http://Übung.NET/ü", "http://x.tie.z/a.tie", "x" * 3000 + "://" + "s." * 500 + "net/" + "p" * 5000]


def parsed(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest[:min((rest + "/").find("/"), (rest + "?").find("?"), (rest + "#").find("#"))]
    tail = rest[len(host):]
    return host.translate(brute.LOWER), tail[:min((tail + "?").find("?"), (tail + "#").find("#"))]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(0, None, "h"), (4, "http://net", "h"), (None, "http://x.net/", "h")],
                                  "page_id bigint, url string, host string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = judge_urls(pages, rules).collect()
    assert len(got) == pages.count()
    urls = {**dict(enumerate(URLS)), None: "http://x.net/"}
    for r in got:
        host, path = parsed(urls[r.page_id])
        fits = [(len(h) + len(p), len(h), v == "block", h.translate(brute.LOWER) + p, v) for h, p, v in RULES
                if h and (host == h.translate(brute.LOWER) or host.endswith("." + h.translate(brute.LOWER))) and path.startswith(p)]
        best = max(fits, default=(0, 0, 0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[3], best[4]), r
    assert {r.verdict for r in judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}
    assert judge_urls(pages.limit(0), rules).count() == 0


def spark_hash(*values):
    """Spark's xxhash64: each value with the hash of those before as the seed; strings as UTF-8, j and a as 32 bits, hashes as 64."""
    seed = 42
    for kind, value in values:
        data = value.encode() if kind == "s" else value.to_bytes(4 if kind == "i" else 8, "little")
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    if not words:
        return ""
    hashes = [spark_hash(("s", w)) for w in words]
    if len(words) >= SHINGLE:
        shingles = [spark_hash(*(("l", h) for h in hashes[i:i + SHINGLE])) for i in range(len(words) - SHINGLE + 1)]
    else:
        shingles = [spark_hash(("s", " ".join(words)))]
    # Bins are numbered in the order of signed hashes: the upper half comes first.
    half = BINS // 2
    bin_of = lambda h: (h * BINS >> 64) ^ half
    least = {}
    for h in shingles:
        least[bin_of(h)] = min(h, least.get(bin_of(h), h))
    digits = []
    for j in range(BINS):
        h = least.get(j)
        if h is None:
            probes = [spark_hash(("i", j), ("i", a)) % BINS for a in range(1, PROBES + 1)]
            h = next((least[p] for p in probes if p in least), None)
        if h is None:
            signed = lambda v: v - (1 << 64) if v >> 63 else v
            h = min(least.items(), key=lambda e: signed(spark_hash(("i", j), ("l", e[0] ^ half))))[1]
        digits.append("0123456789abcdef"[h & 15])
    return "".join(digits)


def test_fingerprints_equal_bin_by_bin(spark):
    rng = random.Random(9)
    texts = [None, "", " ", "one", "one two three four", "a b c d e", "é ü\t🎉\nx  y z"] + [
        brute.random_text(rng, n, ["alpha", "beta", "gamma", "delta", "é", "zeta"] * 3 + [str(i) for i in range(200)]) for n in (5, 6, 9, 30, 300, 2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r.i: r.f for r in add_fingerprint(df, "t", "f").collect()} == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


def test_fingerprints_estimate_likeness(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        a = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        cut = rng.randint(0, 400)
        b = a[:cut] + [f"v{rng.randrange(10**6)}" for _ in range(400 - cut)]
        sa, sb = brute.shingles(" ".join(a)), brute.shingles(" ".join(b))
        rows.append((" ".join(a), " ".join(b), len(sa & sb) / len(sa | sb)))
    df = spark.createDataFrame(rows, "a string, b string, true double").repartition(4)
    got = add_fingerprint(add_fingerprint(df, "a", "fa"), "b", "fb").select("true", likeness(F.col("fa"), F.col("fb")).alias("got")).collect()
    errors = [r.got - r.true for r in got]
    assert abs(sum(errors) / len(errors)) < 0.015 and max(map(abs, errors)) < 0.15


def test_short_texts_have_unlike_fingerprints(spark):
    df = spark.createDataFrame([(t,) for t in ["", None, " \n", "one", "two", "one two", "one\ttwo", "a b c d e", "a b c d e f"]], "text string")
    got = [r.f for r in add_fingerprint(df, "text", "f").collect()]
    assert got[:3] == ["", "", ""] and got[5] == got[6] and len({*got}) == 6 and all(len(f) == 256 for f in got[3:])


@pytest.mark.parametrize("per_cell", [2, 5, 2048])
def test_next_row(spark, monkeypatch, per_cell):
    monkeypatch.setattr("textloom.llm.fingerprints.ROWS_PER_CELL", per_cell)
    rng = random.Random(per_cell)
    rows = [(d, f"t{i}") for i, d in enumerate(rng.sample(range(-500, 500), 70) + [3, 3, None, None])]
    got = with_next(spark.createDataFrame(rows, "k bigint, v string").repartition(5), "k", ["v"]).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted((r.v, r.next_v) for r in got) == sorted((a[1], b[1]) for a, b in zip(order, order[1:] + order[:1]))
    assert with_next(spark.createDataFrame([(1, "a")], "k bigint, v string"), "k", ["v"]).first().next_v == "a"
    assert with_next(spark.createDataFrame([], "k bigint, v string"), "k", ["v"]).count() == 0


def test_neighbour_fingerprints(spark, docs_of):
    rows = [(1, "a b c d e f g"), (2, None), (3, "🎉é 　x"), (9, "word " * 5000), (5, "a b c d e f g"), (None, "q")]
    got = {r.doc_id: r for r in neighbour_fingerprints(docs_of(rows)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    for (d, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after, half = text or "", after or "", len(text or "") // 2
        edited = text[:len(text) - half] + after[:half]
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[d].near_edited <= 1 and 0 <= got[d].near_next <= 1
        if edited == text:
            assert got[d].near_edited == 1
    assert got[1].fingerprint == got[5].fingerprint and got[2].fingerprint == ""


def test_native_plans(spark, docs_of):
    from textloom.llm import queries

    for name in ("op4_hilbert_shards", "op7_url_rules", "op8_document_fingerprints"):
        plan = queries.RUNS[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow")), name


def test_shard_query(spark, sf):
    from textloom.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.RUNS["op4_hilbert_shards"](spark, sf).collect():
        assert r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
