"""Token alignment against a slow reading of whole texts by both libraries."""

import collections
import hashlib
import random

import pytest

P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def slow_groups(texts):
    """Of each text: groups as (A ids, B ids), or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    from wayfold.llm.tokens import read_ranks

    byte_level = Tokenizer.from_file(A)
    byte_level.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    spelled = {i: t for t, i in read_ranks(A).items()}

    def piece(i):
        name = model.id_to_piece(i)
        return bytes([int(name[3:-1], 16)]) if model.is_byte(i) else name.replace("▁", " ").encode()

    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        whole = (" " + text).encode()
        a = [(i, spelled[i]) for i in byte_level.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, piece(i)) for i in model.encode(text, num_threads=1)]
        if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
            out.append(None)
            continue
        groups, x, y = [], [], []
        i = j = at = bt = 0
        while i < len(a) or j < len(b):
            if at <= bt and i < len(a):
                x.append(a[i][0])
                at += len(a[i][1])
                i += 1
            else:
                y.append(b[j][0])
                bt += len(b[j][1])
                j += 1
            if at == bt and x and y:
                groups.append((x, y))
                x, y = [], []
        out.append(groups)
    return out


def slow(rows):
    found = slow_groups([t for _, t in rows])
    held = collections.Counter()
    links = []
    for groups in found:
        links.append([(p, q) for x, y in groups or () for p in x for q in y])
        held.update(set(links[-1]))
    most = collections.Counter()
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    out = []
    for (doc, _), groups, own in zip(rows, found, links):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups or ())
        out.append((doc, sum(len(x) for x, _ in groups or ()), sum(len(y) for _, y in groups or ()), len(groups or ()), len(own), sum(held[p] == most[p[0]] for p in own), sum(held[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out, held


@pytest.fixture(scope="module")
def rows(sf):
    import duckdb

    rng = random.Random(5)
    letters = "ab e  \n\t.é漢😀́<>|x1　 ñ▁\x00'" + chr(0x85)
    texts = ["".join(rng.choices(letters.replace("▁", "") if k % 4 else letters, k=rng.randint(1, 60))) for k in range(150)]
    texts += [None, "", " ", "  ", "a ", " a", "a  ", "\n", "<|endoftext|> hi", "<s> x </s>", "<0x41>", "▁", "x" * 3000, "word " * 2000, "word " * 2000, "don't we'll 12345"]
    texts += [r[0] for r in duckdb.sql(f"SELECT text FROM '{sf}/documents.parquet' ORDER BY doc_id LIMIT 60").fetchall()]
    return [(i if i % 50 else None, t) for i, t in enumerate(texts)] + [(7, "twice"), (7, "twice")]


def test_equals_whole_texts(spark, rows):
    from wayfold.llm import alignment

    docs = spark.createDataFrame([(i, t, "other", 1) for i, t in rows], "doc_id long, text string, block string, pairs int").repartition(5)
    want, held = slow(rows)
    assert sum(w[7] == "" for w in want) > 10
    got = alignment.aligned(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert {(r.a_id, r.b_id): r.documents for r in alignment.pair_counts(docs, A, B).collect()} == dict(held)


def test_small_blocks_and_groups(spark, rows, monkeypatch):
    from wayfold.llm import alignment

    some = [(i, t) for i, (_, t) in enumerate(rows)]
    docs = spark.createDataFrame(some, "doc_id long, text string").repartition(2)
    groups = collections.defaultdict(list)
    for r in alignment.token_groups(docs, A, B).orderBy("doc_id", "group").collect():
        groups[r.doc_id].append((r.a_ids, r.b_ids))
        assert r.start < r.end
    for (i, _), want in zip(some, slow_groups([t for _, t in some])):
        assert groups.get(i) == (want or None)


def test_empty(spark):
    from wayfold.llm import alignment

    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(docs, A, B).count() == 0
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.aligned(none, A, B).collect())) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
