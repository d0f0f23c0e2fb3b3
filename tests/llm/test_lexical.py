"""Ranked lexical search against scoring every document."""

import collections
import math
import random
import re

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def slow(docs, items, k):
    parsed = [(i, collections.Counter(terms(t))) for i, t in docs]
    parsed = [(i, c, sum(c.values())) for i, c in parsed if c]
    count, length = len(parsed), sum(n for *_, n in parsed)
    df = collections.Counter(t for _, c, _ in parsed for t in c)
    out = collections.Counter()
    for item, text in items:
        scored = []
        for i, c, n in parsed:
            m = 25 + 75 * n * count // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        for rank, (score, missing, i) in enumerate(sorted(scored)[:k], 1):
            out[item, rank, None if missing else i, -score] += 1
    return out


def make(spark, docs, items, parts=4):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, q int").repartition(parts)
    return d, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")


def word(rng):
    return "".join(rng.choices("abcDEé漢1", k=rng.choice([1, 1, 2, 3])))


def test_equals_scoring_all(spark, monkeypatch):
    from wayfold.llm import lexical

    rng = random.Random(4)
    text = lambda n: "".join(word(rng) + rng.choice([" ", "\n", "-", "_", "\x00", ". "]) for _ in range(n))
    docs = [(i if i % 40 else None, text(rng.choice([0, 1, 5, 40, 300]))) for i in range(250)] + [(500 + i, t) for i in range(20) for t in ("same words here", None, "")]
    docs += [(7, "same words here"), (7, "same words here"), (999, "Word " * 50_000)]
    items = [(i, text(rng.choice([1, 3, 20]))) for i in range(25)] + [(3, "same here"), (3, "same here"), (None, "words word"), (90, None), (91, "..."), (92, "nowhere"), (93, "word word WORD same")]
    for blocks, query_bytes in ((2048, 1 << 20), (16, 300)):
        monkeypatch.setattr(lexical, "BLOCK", blocks)
        monkeypatch.setattr(lexical, "SHARD_POSTINGS", 100 * blocks)
        d, q = make(spark, docs, items)
        got = lexical.search(d, q, 10, query_bytes=query_bytes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert collections.Counter(map(tuple, got.collect())) == slow(docs, items, 10)


def test_empty(spark):
    from wayfold.llm import lexical

    d, q = make(spark, [(1, "a b")], [(1, "a")])
    assert lexical.search(d.where("false"), q).count() == 0 == lexical.search(d, q.where("false")).count()


def test_terms_are_cut_at_texts():
    import numpy as np

    from wayfold.llm.lexical import split_terms

    found, text = split_terms(np.frombuffer(b"abcDe f", np.uint8), np.array([0, 0, 3, 3, 5]), 7)
    assert found.to_pylist() == [b"abc", b"de", b"f"] and text.tolist() == [1, 3, 4]
