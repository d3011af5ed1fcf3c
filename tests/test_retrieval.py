"""Segmentation against all ways to cut, keyword ranking against a plain sum, in one pass and in several."""

import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from sedge.functions.segment import Lattice, dictionary_tokenizer
from sedge.operators import retrieval


def all_cuts(lattice, words, text):
    costs = {w: lattice._cost(n) for w, n in words}
    best = None
    for bits in itertools.product([0, 1], repeat=max(len(text) - 1, 0)):
        at = [0, *(k + 1 for k, b in enumerate(bits) if b), len(text)]
        parts = [text[a:b] for a, b in itertools.pairwise(at)]
        if all(p in costs or len(p) == 1 for p in parts):
            key = (sum(costs.get(p, lattice.alone) for p in parts), [-len(p) for p in parts])
            best = min(best or (key, parts), (key, parts))
    return best[1] if text else []


def test_cheapest_paths():
    rng = random.Random(1)
    for _ in range(500):
        words = list({"".join(rng.choice("甲乙丙") for _ in range(rng.randint(1, 4))): rng.randint(1, 9) for _ in range(rng.randint(1, 8))}.items())
        text = "".join(rng.choice("甲乙丙丁") for _ in range(rng.randint(0, 9)))
        assert Lattice(words).cut(text) == all_cuts(Lattice(words), words, text)


def test_dictionary_tokenizer(spark):
    words = spark.createDataFrame([("标准", 5), ("标准", 4), ("标准文档", 1), ("文档", 9), ("首行", 3), (None, 2), ("", 2), ("零", 0)], "word string, freq int")
    cut = dictionary_tokenizer(words)
    texts = ["标准文档。GB/T 9704首行缩进 abc", "", None, "丁零", " \n"]
    got = [r.t for r in spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", cut(F.col("text")).alias("t")).orderBy("k").collect()]
    assert got == [["标准", "文档", "。", "GB/T", "9704", "首行缩进", "abc"], [], [], ["丁", "零"], []]
    with pytest.raises(ValueError, match="more than 2 words"):
        dictionary_tokenizer(words, most=2)


def plain_bm25(chunks, asked, k):
    cut = {c: re.findall(r"[a-z]+", t or "") for c, t in chunks}
    n, mean = len(cut), sum(map(len, cut.values())) / len(cut)
    df = {t: sum(t in words for words in cut.values()) for words in cut.values() for t in words}
    raw = {t: math.log((n - x + 0.5) / (x + 0.5)) for t, x in df.items()}
    low = 0.25 * sum(raw.values()) / max(len(raw), 1)
    out = set()
    for q, text in asked:
        scores = []
        for c, words in cut.items():
            score = sum((raw[t] if raw[t] >= 0 else low) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(words) / mean)) for t in re.findall("[a-z]+", text) if (f := words.count(t)))
            scores.append((-round(score, 6) + 0.0, c))
        out |= {(q, r, c, round(-s, 5) + 0.0) for r, (s, c) in enumerate(sorted(scores)[:k], 1)}
    return out


@pytest.mark.parametrize("letters", ["abcdefghijklmnop", "ab"])
def test_keyword_ranking(spark, letters):
    """With two letters every term is common: their weights are below 0, and chunks without a match come first."""
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(letters) * rng.randint(1, 2) for _ in range(rng.randint(1, n)))
    chunks = [(k, text(12)) for k in range(1, 61)] + [(61, None), (62, ""), (0, "zz zz")]
    asked = [(k, text(4)) for k in range(12)] + [(99, "qqq")]
    c, q = spark.createDataFrame(chunks, "chunk_id long, text string"), spark.createDataFrame([*asked, (100, " \n")], "query_id long, text string")
    got = {(r.query_id, r.rank, r.chunk_id, round(r.score, 5) + 0.0) for r in retrieval.bm25_search(c, q, 7).collect()}
    assert got == plain_bm25(chunks, asked, 7)
    index = retrieval.Keywords(c)
    key = lambda f: sorted((r.query_id, r.chunk_id, round(r.score, 9)) for r in f.collect())
    assert key(index.best(q, 5)) == key(index.best(q, 5, most=4))


def test_tokenizer_as_argument(spark):
    words = spark.createDataFrame([("标准", 5), ("文档", 9)], "word string, freq int")
    chunks = spark.createDataFrame([(1, "标文准档"), (2, "标准"), (3, "文档标准"), (4, "准"), (5, "x"), (6, "y")], "chunk_id long, text string")
    asked = spark.createDataFrame([(1, "标准")], "query_id long, text string")
    best = lambda **more: [r.chunk_id for r in retrieval.bm25_search(chunks, asked, 2, **more).orderBy("rank").collect()]
    assert best(tokenizer=dictionary_tokenizer(words)) == [2, 3]
    scored = retrieval.bm25_search(chunks, asked, 6, tokenizer=dictionary_tokenizer(words)).where("score > 0")
    assert sorted(r.chunk_id for r in scored.collect()) == [2, 3]  # characters alone would find 1 and 4 as well


def test_queries_without_a_vector(spark):
    chunks = spark.createDataFrame([(1, "a b", "s", [1.0]), (2, "c", "s", None), (3, "d", "s", [2.0])], "chunk_id long, text string, source string, embedding array<double>")
    asked = spark.createDataFrame([(1, "c", None), (2, "c", [2.0])], "query_id long, text string, embedding array<double>")
    got = {(r.query_id, r.chunk_id): r.retrieval_method for r in retrieval.hybrid_search(chunks, asked, 3).collect()}
    assert got[1, 2] == "bm25" and got[2, 3] == "hybrid" and all(m == "bm25" for (q, _), m in got.items() if q == 1)


def test_partitions_follow_the_text(spark, monkeypatch):
    """More text makes more partitions, of the corpus and of the postings, not larger ones."""
    from sedge import workspace

    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(workspace.parts_for, "__defaults__", ("text", 10_000))
    chars = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("sum(length(text))").first()[0]
    parts = -(-chars // 10_000)
    assert parts > 8 and retrieval.corpus(spark, sf).rdd.getNumPartitions() == parts
    terms = retrieval.Keywords(retrieval.corpus(spark, sf)).terms
    assert len({r[0] for r in terms.select(F.regexp_extract(F.input_file_name(), r"_(\d{5})\.c", 1)).distinct().collect()}) > 8
