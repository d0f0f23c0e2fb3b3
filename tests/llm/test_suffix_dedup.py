"""Suffix sorting and the removal of repeated passages against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest


def slow_order(x, cap):
    x = x.tolist()
    order = sorted(range(len(x)), key=lambda i: x[i:])
    shared = [0] * len(x)
    for k in range(1, len(x)):
        a, b = x[order[k - 1] :], x[order[k] :]
        same = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
        shared[k] = min(same, cap)
    return order, shared


@pytest.mark.parametrize("seed", range(4))
def test_induced_order(seed, monkeypatch):
    from wayfold.llm import induced

    rng = random.Random(seed)
    monkeypatch.setattr(induced, "RANGE", rng.choice([4, 1 << 16]))
    monkeypatch.setattr(induced, "BASE", [0, 0, 10, 1 << 18][seed])
    for t in range(120):
        n, letters = rng.randint(1, 80), rng.choice([1, 2, 3, 5, 50])
        if t % 3:
            x = [rng.randint(1, letters) for _ in range(n)]
        else:
            x = ([rng.randint(1, letters) for _ in range(rng.randint(1, 6))] * 80)[:n]
        x, cap = np.array([*x, 0]), rng.choice([3, 100])
        space = induced.Space(held=rng.choice([1, 1 << 20]), mapped=rng.choice([8, 1 << 20]))  # all on disk, or nothing
        order, shared = induced.suffixes(x, cap, space, rng.choice([1, 4, 1 << 16]))
        space.close()
        assert (order.tolist(), shared.tolist()) == slow_order(x, cap)


def slow(rows, window=100):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - window + 1):
            own = data[k : k + window]
            if own in seen:
                gone[k : k + window] = True
            seen.add(own)
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        kept = bytes(b for b, g in zip(data, gone.tolist()) if not g)
        out.append((i, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


def word(rng):
    return "".join(rng.choices("abcdefghijkl", k=rng.randint(2, 7)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    passage = [" ".join(word(rng) for _ in range(n)) for n in (20, 60, 200)]
    line = " ".join(word(rng) for _ in range(10))  # shorter than a window, longer than a gram, in many contexts
    texts = [None, "", "a" * 99, "a" * 100, "a" * 101, "ab" * 700, "abc" * 900, "é漢" * 60, "=" * 3000]
    for k in range(120):
        parts = [" ".join(word(rng) for _ in range(rng.randint(0, 60))) for _ in range(4)]
        texts.append(f" {line if k % 2 else ''} {rng.choice(passage) if k % 3 == 0 else ''} ".join(parts))
    base = texts[30]
    for k in range(25):
        own = base.split(" ")
        own[rng.randrange(len(own))] = word(rng)
        texts.append(" ".join(own))
    texts += [base] * 6 + [base[:90] + "X" + base[90:], passage[2] + passage[2]]
    rng.shuffle(texts)
    return list(enumerate(texts))


def result(frame):
    return collections.Counter(map(tuple, frame.collect()))


def test_equals_brute_force(spark, rows):
    from wayfold.llm import suffix_dedup

    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in rows], "doc_id long, text string, key long, spans string").repartition(6)
    assert result(suffix_dedup.repeat_digests(docs)) == slow(rows)
    kept = {r.doc_id: hashlib.sha256(r.kept).hexdigest() for r in suffix_dedup.without_repeats(docs).collect()}
    assert kept == {r[0]: r[4] for r in slow(rows)}


def test_hot_hashes_and_small_parts(spark, rows, monkeypatch):
    from wayfold.llm import suffix_dedup

    for name, value in (("SAMPLE", 0.999), ("HOT_CONTENTS", 5), ("SHARD_BYTES", 4000), ("BUCKET_BYTES", 2000)):
        monkeypatch.setattr(suffix_dedup, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert len(suffix_dedup._hot(docs.selectExpr("doc_id AS key", "coalesce(text, '') AS text")))
    assert result(suffix_dedup.repeat_digests(docs)) == slow(rows)


def test_repeated_and_missing_ids(spark, rows):
    from wayfold.llm import suffix_dedup

    some = [(None if i % 7 == 0 else i % 20 - 3, t) for i, t in rows] + [(4, rows[3][1])] * 2
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(3)
    assert result(suffix_dedup.repeat_digests(docs)) == slow(some)


def test_long_text_and_empty(spark):
    from wayfold.llm import suffix_dedup

    rng = random.Random(2)
    own = " ".join(word(rng) for _ in range(150_000))
    rows = [(1, own), (2, "start " + own[200_000:700_000] + " end"), (3, "z" * 1_200_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.repeat_digests(docs).collect()}
    assert (got[1].n_removed, got[2].n_spans, got[3].n_removed) == (0, 1, 1_200_000 - 1)
    assert got[2].n_removed in range(500_000, 500_003)
    assert suffix_dedup.repeat_digests(docs.where("false")).count() == 0
