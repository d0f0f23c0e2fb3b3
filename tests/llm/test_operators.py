"""Every training-data operator on small awkward inputs, against brute force or a library."""

import collections
import hashlib
import html
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")

TRICKY = ["", " ", "a  b  c\n\n d \n", "x\x1c y\x1c\x1c  z", "don't  we'll \t\n  go 12 34!!! ", "a 　b", "<|endoftext|> hi", "x " * 5, "é ñ 漢字 😀", "à b", "a" * 999, "ab" * 300, "=== --- ...", "one two three four five six"]


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [words(rng, rng.choice([3, 40, 200, 900])) for _ in range(25)]
    near = [" ".join("changed" if i == 50 else w for i, w in enumerate(t.split())) for t in base if len(t.split()) > 150]
    texts = base + near + base[:8] + TRICKY + [None, None, "", base[0]]
    return [(i, t, rng.choice(["en", "de", None]), "hot" if i % 3 else None, len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_packing(spark, docs, rows, empty):
    from wayfold.llm import packing

    ids = {r[0]: x + [2] for r, x in zip(rows, reference_ids([r[1] for r in rows]))}
    got = packing.pack(docs, JSON, keep_ids=True).collect()
    for doc, own in itertools.groupby(sorted(got, key=lambda r: (r.doc_id, r.piece)), key=lambda r: r.doc_id):
        own = list(own)
        assert [i for r in own for i in r.ids] == ids[doc]
        assert all(r.length == 1024 for r in own[1:]) and [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in own)
    seqs = collections.defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for own in seqs.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(seqs) <= sum(map(len, ids.values())) // 1024 + 2
    assert {r.sequence_id for r in packing.sequences(packing.assign(docs.sparkSession.createDataFrame(got).drop("sequence_id", "offset"))).collect()}
    assert packing.pack(empty, JSON).count() == 0


def thue_morse(n, swap=0):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


@pytest.fixture(scope="module")
def long_texts(spark):
    """Texts that hashes by polynomials confuse, and words without a place to cut."""
    rng = random.Random(9)
    texts = [thue_morse(n, k) for n in (1024, 4096) for k in (0, 1)]
    texts += ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=200_000)), "=" * 700_001, "abc" * 300_001, "x1y2 " * 100_000, "".join(rng.choices("ab", k=3)) + "-=" * 2_500_000]
    return texts, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


def tiktoken_ids(texts):
    import tiktoken

    from wayfold.llm.tokens import read_ranks

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=read_ranks(RANKS), special_tokens={})
    return [enc.encode_ordinary(x or "") for x in texts]


def test_long_and_colliding_texts(spark, long_texts):
    from wayfold.llm import bpe, packing, token_counts

    texts, docs = long_texts
    ids = tiktoken_ids(texts)
    got = {r.doc_id: r for r in bpe.encoded_digests(docs, RANKS).collect()}
    for i, (t, own) in enumerate(zip(texts, ids)):
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    cut = collections.defaultdict(list)
    for r in sorted(packing.pieces(docs, JSON, keep_ids=True).collect(), key=lambda r: r.piece):
        cut[r.doc_id] += r.ids
    assert all(cut[i] == own + [2] for i, own in enumerate(ids))
    assert {r.doc_id: r.n_tokens for r in token_counts.lengths(docs, JSON).collect()} == {i: len(x) for i, x in enumerate(ids)}


def test_word_of_many_megabytes():
    from wayfold.llm.bpe import Merger

    rng = random.Random(1)
    merger = Merger(RANKS)
    word = "".join(rng.choices("abcdefgh", k=1000)) + "ab" * 2_500_000
    own, sizes = merger.merge([word.encode()])
    assert sizes.tolist() == [len(own)]
    assert merger.lengths[own].sum() == len(word)
    head = tiktoken_ids([word[:400_000]])[0]
    assert own[: len(head) - 50].tolist() == head[:-50]


@pytest.mark.parametrize("seed", range(3))
def test_plan_places_every_piece(seed):
    from wayfold.llm.packing import best_fit, plan

    rng = np.random.default_rng(seed)
    hist = np.bincount(np.minimum(rng.geometric(0.004, 3000), 1024), minlength=1025)
    got = plan(hist)
    again = np.zeros(1025, int)
    for lengths, n in got:
        assert sum(lengths) <= 1024
        for v in lengths:
            again[v] += n
    assert (again == hist).all()
    assert sum(n for _, n in got) <= sum(n for _, n in best_fit(hist.copy(), 1024)) + 2


def test_bpe(docs, rows, empty):
    from pyspark.sql import functions as F

    from wayfold.llm import bpe

    ids = reference_ids([r[1] for r in rows])
    got = {r.doc_id: r for r in bpe.encoded_digests(docs, RANKS).collect()}
    for r, own in zip(rows, ids):
        assert got[r[0]].n_tokens == len(own)
        assert got[r[0]].ids_sha256 == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()
        assert got[r[0]].decoded_sha256 == hashlib.sha256((r[1] or "").encode()).hexdigest()
    both = docs.select("text", bpe.encode_column(F.col("text"), RANKS).alias("ids")).select("text", bpe.decode_column(F.col("ids"), RANKS).alias("back"))
    assert all(bytes(r.back).decode() == (r.text or "") for r in both.collect())
    assert bpe.encoded_digests(empty, RANKS).count() == 0


def test_bpe_merges_a_word_once_while_it_is_remembered(rows, monkeypatch):
    from wayfold.llm import bpe
    from wayfold.llm.tokens import ChunkTable

    texts = [r[1] or "" for r in rows] + [t + "." for t in TRICKY] + [" \u3000x\u3000 y\u00a0 z", "é\u2028 ü\x85 ß", "  ", "\n a"]
    ids = tiktoken_ids(texts)
    merged, merge = [], bpe.Merger.merge
    monkeypatch.setattr(bpe.Merger, "merge", lambda self, words: merged.extend(words) or merge(self, words))
    for remembered in (1_000_000, 50):
        monkeypatch.setattr(bpe, "WORDS_REMEMBERED", remembered, raising=False)
        merger = bpe.Merger(RANKS)
        table = ChunkTable(merger.encode_chunks, block_bytes=200)
        merged.clear()
        got = [x.tolist() for x in table.texts(pa.array(texts))]
        assert got == ids
        assert len(merged) == len(set(merged)) or remembered == 50  # in other chunks and blocks as well
        assert len(merger.words) <= remembered + 200
    flat, sizes = merger.decode(np.array([i for x in ids for i in x]), np.array(list(map(len, ids))))
    assert flat.tobytes() == "".join(texts).encode() and sizes.tolist() == [len(t.encode()) for t in texts]
    with pytest.raises(ValueError):
        merger.decode(np.array([5, 1 << 30]), np.array([2]))


def test_chunks_start_at_spaces_after_other_characters():
    from wayfold.llm.tokens import SPACES, _chunk_starts, _spaced

    rng = random.Random(4)
    for _ in range(300):
        each = ["".join(rng.choices("ab   \n\u00a0\u3000\x85\u2028éàß漢😀\u0e25", k=rng.randint(0, 12))) for _ in range(rng.randint(1, 5))]
        data, limits = "".join(each).encode(), np.cumsum([0] + [len(t.encode()) for t in each])
        starts = _chunk_starts(np.frombuffer(data, np.uint8), limits).tolist()
        want = [int(a) + len(t[:i].encode()) for t, a in zip(each, limits) for i, c in enumerate(t) if i == 0 or c == " " and t[i - 1] not in SPACES]
        assert starts == want
        chunks = [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)])]
        if chunks:
            assert _spaced(chunks).tolist() == [len(c) > 1 and c[:1] == b" " and c[1] not in b"\t\n\v\f\r " and c.decode()[-1] not in SPACES for c in chunks]


def test_language(spark, sf, docs, empty):
    from wayfold.llm import language_id

    real = spark.read.parquet(f"{sf}/documents.parquet")
    got = language_id.identify(real).join(real.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.95 and got.score.between(0, 1).all()
    odd = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert len(odd) == docs.count()
    none = {r.doc_id for r in docs.where("text IS NULL OR trim(text) = ''").collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].rejected for i in none)
    assert language_id.identify(empty).count() == 0
    assert language_id.language_filter(real).columns == real.columns
    assert language_id.language_filter(real).count() >= 0.99 * real.count()


FOREIGN = [
    "De regering heeft vandaag besloten dat de nieuwe wet op het onderwijs volgend jaar van kracht wordt en dat alle scholen zich daaraan moeten houden, ook als zij daar nog niet klaar voor zijn. ",
    "O governo decidiu hoje que a nova lei sobre o ensino entra em vigor no próximo ano e que todas as escolas devem cumprir as regras, mesmo que ainda não estejam preparadas para isso. ",
    "Regeringen har i dag beslutat att den nya lagen om undervisning ska träda i kraft nästa år och att alla skolor måste följa den, även om de ännu inte är redo för det. ",
    "Il governo ha deciso oggi che la nuova legge sulla scuola entrerà in vigore il prossimo anno e che tutte le scuole dovranno rispettarla, anche se non sono ancora pronte. ",
    "Gallia est omnis divisa in partes tres, quarum unam incolunt Belgae, aliam Aquitani, tertiam qui ipsorum lingua Celtae, nostra Galli appellantur. ",
    "Hallitus on tänään päättänyt, että uusi koululaki tulee voimaan ensi vuonna ja että kaikkien koulujen on noudatettava sitä, vaikka ne eivät vielä olisi valmiita. ",
    "Hükümet bugün yeni eğitim yasasının gelecek yıl yürürlüğe gireceğine ve tüm okulların buna uyması gerektiğine karar verdi, henüz hazır olmasalar bile. ",
]


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_language_rejects_what_it_has_not_learned(spark, sf, size):
    import base64

    from pyspark.sql import functions as F

    from wayfold.llm import language_id

    rng = random.Random(4)
    odd = [t * n for t in FOREIGN for n in (1, 4)] + ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz    ", k=600)), base64.b64encode(rng.randbytes(600)).decode()]
    real = spark.read.parquet(f"{sf}/../{size}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(real)
    assert all(model.languages.count(x) >= 2 for x in model.languages)
    got = spark.createDataFrame([(t,) for t in odd], "text string").select("text", language_id.language_column(F.col("text"), model).alias("p")).collect()
    assert [r.text[:40] for r in got if not r.p.rejected] == []
    clean = real.where(language_id.held_out(F.col("doc_id")) & (F.length("text") > 0)).select("text", language_id.language_column(F.col("text"), model).alias("p")).toPandas()
    assert clean.p.map(lambda r: r["rejected"]).mean() <= 0.01


PAGE = '<html><head><title>T</title><script>var a="</p>";</script></head><body><nav><a href="/x">menu {i}</a></nav><div class="cookie-notice">We use cookies</div><article><h1>Head &amp; {i}</h1><p><b>One{i}<br><p>Two  <i>w</i>ord &lt;x&gt;</p><div class="comments">reader</div></article><footer>&copy; me</footer></body></html>'


def test_html(spark):
    from wayfold.llm import html_text

    pages = [(i, "http://a.example/x" if i < 6 else None, PAGE.replace("{i}", str(i))) for i in range(8)] + [(8, "bad", None), (9, None, ""), (10, "http://b.example", "plain <b>te</b>xt &am"), (11, "http://a.example/q", "<body><div class='sidebar'>x</div><div>main text</div><ul><li><a href='/'>link</a></li></ul>")]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i].text == f"Head & {i} One{i} Two word <x>"
    assert got[8].text == got[9].text == "" and got[10].text == "plain text &am" and got[11].text == "main text"
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), template_bytes=0).count() == len(pages)
    assert html.unescape("&copy;") not in got[0].text


def test_html_template_texts_inside_articles(spark):
    from wayfold.llm import html_text

    page = "<body><nav>menu</nav><article><h1>Title {i}</h1><p>First {i}</p><p>Write to us for <i>more</i></p><p>Second {i}</p><div>Terms hold</div></article></body>"
    bare = "<body><article><p>Write to us for <i>more</i></p></article></body>"
    pages = [(i, "http://a.example/x", page.replace("{i}", str(i))) for i in range(12)]  # one host has a template
    pages += [(20 + i, "http://b.example/x", page.replace("{i}", str(i))) for i in range(3)]  # one has too few pages
    pages += [(40 + i, "http://c.example/x", page.replace("{i}", "0")) for i in range(12)]  # and one has copies alone
    pages += [(60, "http://a.example/y", bare)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    whole = "Title {i} First {i} Write to us for more Second {i} Terms hold"
    for i in range(12):
        assert got[i] == f"Title {i} First {i} Second {i}"
        assert got[40 + i] == whole.replace("{i}", "0")
    for i in range(3):
        assert got[20 + i] == whole.replace("{i}", str(i))
    assert got[60] == "Write to us for more"


def extracted(spark, pages, **options):
    from wayfold.llm import html_text

    return {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string"), **options).collect()}


def test_html_template_decides_without_marks(spark):
    """No article, no telling names: what varies and isn't linked is the content; without a template more comes along."""
    rng = random.Random(1)
    body = [(words(rng, 6), words(rng, 50), words(rng, 40)) for _ in range(10)]
    page = "<body><div id='t'><div><a href='/'>Start</a> <a href='/b'>About</a></div></div><div class='w'><h2>{0}</h2><div><p>{1}</p><p hidden>{2}</p></div></div><div id='z'><p>All rights are ours</p><p>Ask us</p></div></body>"
    pages = [(i, "http://a.example/x", page.format(*b)) for i, b in enumerate(body)]
    for options in ({}, {"template_bytes": 0}):  # by broadcast, and by a salted join
        got = extracted(spark, pages, **options)
        assert [got[i] for i in range(10)] == [" ".join(b) for b in body]
    assert extracted(spark, pages[:1])[0] == " ".join(body[0]) + " All rights are ours Ask us"


def test_html_template_outranks_marks_elsewhere(spark):
    """An article that is a teaser in another slot isn't the content."""
    rng = random.Random(2)
    body = [words(rng, 80) for _ in range(10)]
    page = "<body><article><a href='/{1}'>Teaser {1}</a></article><div class='w'><p>{0}</p></div><div><p>One line</p><p>Two lines</p></div></body>"
    got = extracted(spark, [(i, "http://a.example/x", page.format(b, i)) for i, b in enumerate(body)])
    assert [got[i] for i in range(10)] == body


def test_html_keeps_what_articles_hold(spark):
    kept = "<article><h1>H</h1><p hidden>one</p><p aria-hidden='true'>two</p><p style='display: none'>three</p><p><math><mi>x</mi></math> four</p><div class='related share search login widget'>five</div><ul><li><a href='/'>six</a></li></ul><header>seven</header></article>"
    gone = "<article>H<div class='comments'>a</div><aside>b</aside><form>c</form><div class='ad'>d</div><nav>e</nav><script>f</script><footer>g</footer></article>"
    got = extracted(spark, [(0, None, kept), (1, "x", gone), (2, None, kept), (3, "http://a/", "<article>" + "<p>much text</p>" * 200_000 + "</article>")])
    assert got[0] == got[2] == "H one two three x four five six seven" and got[1] == "H"
    assert got[3] == " ".join(["much text"] * 200_000)


def test_html_passes_over_classes_out_of_order(spark):
    rng = random.Random(3)
    body = [words(rng, 60) for _ in range(12)]
    page = "<body><div class='w'><p class='x'>{0}</p></div><div><p>First line</p><p>Second line</p></div></body>"
    turned = page.replace("First", "@").replace("Second", "First").replace("@", "Second")
    pages = [(i, "http://a.example/x", page.format(b)) for i, b in enumerate(body)] + [(50, "http://a.example/x", turned.format(body[0]).replace("class='w'", "class='v'"))]
    got = extracted(spark, pages)
    assert [got[i] for i in range(12)] == body
    assert got[50] == f"{body[0]} Second line First line"


@pytest.mark.parametrize("limit", [1, 3000, 1 << 20])
def test_exact(docs, rows, empty, limit):
    from wayfold.llm import exact_dedup

    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = {r.doc_id: r for r in exact_dedup.exact_groups(docs, limit=limit).collect()}
    for text, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())
    kept = exact_dedup.exact_deduplicate(docs, limit=limit)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text, r.source) for r in kept.collect()} == {(r[0], r[1] or "", r[3]) for r in rows if r[0] == max(groups[r[1] or ""])}
    assert exact_dedup.exact_groups(empty).count() == 0
    twice = docs.where("doc_id = 3").unionByName(docs.where("doc_id = 3"))
    assert sorted(r.kept for r in exact_dedup.exact_groups(twice).collect()) == [False, True]


def test_exact_returns_columns_unchanged(spark):
    """Microseconds, maps with integer keys, nested and null values; names like those of the operator."""
    import datetime
    import decimal

    from wayfold.llm import exact_dedup

    when = datetime.datetime(2024, 5, 1, 10, 0, 0, 123456)
    rows = [(i, t, when, {7: "x", 8: None}, (i, [1.5, None]), decimal.Decimal("1.10"), bytearray(b"\0\xff"), None, float(i)) for i, t in enumerate(["a", "b", "a", None])]
    docs = spark.createDataFrame(rows, "payload long, text string, at timestamp_ntz, m map<int,string>, doc_id struct<a:int,b:array<double>>, d decimal(9,2), h binary, rid date, c0 double")
    got = exact_dedup.exact_deduplicate(docs, id_col="payload")
    assert got.schema == docs.schema or [f.dataType for f in got.schema] == [f.dataType for f in docs.schema] and got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.where("payload > 0").fillna("", "text").collect()))


def test_clashing_names(spark, sf):
    """Extra columns under the names that operators use come back unchanged, or don't matter."""
    from pyspark.sql import functions as F

    from wayfold.llm import bpe, exact_dedup, html_text, language_id, licenses, near_dedup, packing, quality_rules, site_quality, token_counts

    real, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    names = ["_p", "_q", "verdict", "row", "row_", "node", "payload", "_quality", "rid", "gid", "page_id", "html", "site", "section", "u", "length", "piece", "lines", "host", "hi", "lo", "bands", "key"]
    docs = real.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    for run in (language_id.language_filter, lambda d: quality_rules.quality_filter(d, labels), exact_dedup.exact_deduplicate, near_dedup.near_deduplicate):
        got = run(docs)
        assert got.columns == docs.columns
        assert {tuple(r)[5:] for r in got.collect()} <= {tuple(r)[5:] for r in docs.collect()}
        assert {r.doc_id for r in got.collect()} == {r.doc_id for r in run(real).collect()}
    runs = [lambda d: packing.pieces(d, JSON), lambda d: bpe.encoded_digests(d, RANKS), language_id.identify, exact_dedup.exact_groups, lambda d: token_counts.lengths(d, JSON), licenses.license_scan, lambda d: quality_rules.quality_rules(d, labels), lambda d: site_quality.site_quality(d, labels, F.col("source"), F.col("lang"))]
    for run in runs:
        assert sorted(map(str, run(docs).collect())) == sorted(map(str, run(real).collect()))
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = pages.select("*", *[F.lit(n).alias(n) for n in ("host", "tokens", "token", "salt", "text")])
    assert sorted(map(str, html_text.extract(odd).collect())) == sorted(map(str, html_text.extract(pages).collect()))


def test_site_posteriors_equal_sql(spark):
    """The grouping in SQL, each document's own evidence left out."""
    import duckdb

    from wayfold.llm.site_quality import UNIT, posteriors

    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", ""]), rng.choice(["x", "y", "z"]), rng.randint(0, UNIT)) for i in range(3000)] + [(3000, "alone", "x", UNIT // 2)]
    rows = [(i, a, f"{a}/{b}", u) for i, a, b, u in rows]
    got = {r.doc_id: r for r in posteriors(spark.createDataFrame(rows, "doc_id long, site string, section string, u long")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE e (doc_id BIGINT, site TEXT, section TEXT, u BIGINT)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?)", rows)
    want = con.execute(f"""
WITH d AS (SELECT *, u / {UNIT} AS p FROM e),
g AS (SELECT site, section, count(*) n, sum(p) s FROM d GROUP BY ALL),
h AS (SELECT site, sum(n) n, sum(s) s FROM g GROUP BY ALL),
w AS (SELECT count(*) n, avg(p) m, sum(p * p) q FROM d),
k AS (
    SELECT m, least(greatest(greatest((q - hs) / w.n, 1e-4) / greatest((hs - w.n * m * m - greatest((q - hs) / w.n, 1e-4) * hn) / w.n, 1e-6), 1), 1e6) AS hk,
           least(greatest(greatest((q - gs) / w.n, 1e-4) / greatest((gs - w.n * m * m - greatest((q - gs) / w.n, 1e-4) * gn) / w.n, 1e-6), 1), 1e6) AS gk
    FROM w, (SELECT sum(s * s / n) hs, count(*) hn FROM h), (SELECT sum(s * s / n) gs, count(*) gn FROM g))
SELECT doc_id, (h.s - p + hk * m) / (h.n - 1 + hk) AS site, (g.s - p + gk * (h.s - p + hk * m) / (h.n - 1 + hk)) / (g.n - 1 + gk) AS section, m
FROM d JOIN g USING (section) JOIN h ON h.site = d.site, k""").fetchall()
    assert len(want) == len(got) == 3001
    for i, site, section, m in want:
        assert abs(got[i].site_posterior - site) < 1e-5 and abs(got[i].section_posterior - section) < 1e-5
    assert abs(got[3000].site_posterior - want[0][3]) < 1e-6  # a document alone stays at the prior; its section is too small for the broadcast


def test_few_labels_are_fitted(spark, sf):
    from wayfold.llm import quality_rules, site_quality
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    few = labels.where("quality = 0").limit(3).unionByName(labels.where("quality = 1").limit(6))
    assert quality_rules.fit(docs, few) is not None and site_quality.fit(docs, few, "doc_id", "text") is not None
    assert quality_rules.quality_rules(docs, few).count() == docs.count()
    assert site_quality.site_quality(docs, few, F.col("source"), F.col("lang")).count() == docs.count()


def test_trees_walk_node_by_node():
    from wayfold.llm.quality_rules import fit_trees

    rng = np.random.default_rng(4)
    x = rng.random((300, 4))
    f = fit_trees(x, (x[:, 1] + 0.2 * rng.random(300) > 0.6).astype(float), [0, 1, 0, 0], rounds=12)
    for row in x[:40]:
        total = f.bias
        for at in f.roots.tolist():
            for _ in range(f.depth):
                at = int(f.left[at] if row[f.feature[at]] <= f.threshold[at] else f.right[at])
            total += f.value[at]
        assert abs(total - f.margin(row[None])[0]) < 1e-9


def test_language_prediction_by_hand(spark):
    """Cosines of TF-IDF vectors with every centroid, gram by gram."""
    from wayfold.llm import language_id as li

    rng = random.Random(3)
    texts = [words(rng, 30) for _ in range(8)] + ["über straße " * 9, "À bientôt, ça va? " * 4, "x"]
    counts = np.array([li.ngram_counts(t) for t in texts], np.float32)
    model = li.fit_counts(counts, ["aa"] * 6 + ["bb"] * 5)
    assert all(model.languages.count(x) >= 2 for x in ("aa", "bb"))
    best, score = model.predict(counts)
    for c, b, s in zip(counts, best, score):
        v = [np.sqrt(n) * w for n, w in zip(c, model.idf)]
        size = sum(z * z for z in v) ** 0.5
        sims = [sum(a * z for a, z in zip(v, centre)) / size for centre in model.centres]
        assert abs(max(sims) - s) < 1e-4 and abs(sims[b] - max(sims)) < 1e-4
    assert (li.ngram_counts("ab " * 700_000) == 700_000 * li.ngram_counts("ab")).all()  # in blocks


def test_token_counts(docs, rows, empty):
    from wayfold.llm import token_counts

    n = [len(x) for x in reference_ids([r[1] for r in rows])]
    got = {r.n_tokens: r for r in token_counts.token_counts(docs, JSON).collect()}
    assert set(got) == set(n)
    for limit, r in got.items():
        assert r.documents == n.count(limit) and r.documents_from == sum(x >= limit for x in n) and r.tokens_from == sum(x for x in n if x >= limit)
        assert r.tokens_cut_at == sum(min(x, limit) for x in n) and r.tokens_cut_at + r.tokens_lost_at == sum(n)
        assert abs(r.quantile - sum(x <= limit for x in n) / len(n)) < 1e-8
    assert token_counts.token_counts(empty, JSON).count() == 0
    plan = token_counts.token_counts(docs, JSON)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # texts were encoded once, before
    assert len(token_counts.limit_totals(token_counts.histogram(token_counts.lengths(docs, JSON)), width=2).collect()) == len(got)


def brute_classes(rows):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    text = {r[0]: r[1] or "" for r in rows}
    above = {i: i for i in sets}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if text[a] == text[b] or both and both / len(sets[a] | sets[b]) >= 0.8:
            above[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in sets}


def test_near(spark, docs, rows, empty):
    from wayfold.llm import near_dedup

    plain = [r for r in rows if not re.search("[\x1c-\x1f\x85\xa0　]", r[1] or "")]
    got = near_dedup.near_classes(docs.where(docs.doc_id.isin([r[0] for r in plain]))).collect()
    want = brute_classes(plain)
    named = collections.defaultdict(set)
    for i, c in want.items():
        named[c].add(i)
    assert {r.doc_id: r.class_id for r in got} == {i: min(named[c]) for i, c in want.items()}
    assert near_dedup.near_classes(empty).count() == 0
    kept = near_dedup.near_deduplicate(docs.where(docs.doc_id.isin([r[0] for r in plain])))
    assert {r.doc_id for r in kept.collect()} == {min(v) for v in named.values()}


def test_near_decides_by_row(spark):
    from wayfold.llm import near_dedup

    rng = random.Random(8)
    t = [words(rng, 60) for _ in range(4)]
    rows = [(1, t[0], 0), (1, t[0], 1), (None, t[0], 2), (None, t[1], 3), (None, t[1], 4), (5, t[2], 5), (5, t[2] + " more", 6), (5, t[3], 7), (None, None, 8), (9, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").repartition(3)
    got = near_dedup.near_classes(docs).collect()
    assert sorted((str(r.class_id), r.class_size) for r in got) == sorted([("1", 3)] * 3 + [("None", 2)] * 2 + [("5", 2)] * 2 + [("5", 1)] + [("9", 2)] * 2)
    assert sum(r.kept for r in got) == 5
    kept = near_dedup.near_deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept) == ["1", "5", "5", "9", "None"]


def test_near_links_unequal_repetition(spark):
    """Pairs at 0.8 or more of which one side repeats a passage."""
    from wayfold.llm import near_dedup

    rng = random.Random(6)
    rows = []
    for i in range(60):
        w = words(rng, 120).split()
        rows.append((2 * i, " ".join(w)))
        rows.append((2 * i + 1, " ".join(w + ["y", f"{i}"] + w[:30] * 9)))
    want = brute_classes(rows)
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(v != k for k, v in want.items()) == 60
    assert {r.doc_id: r.class_id for r in got.collect()} == want


def test_near_deals_out_hot_buckets(spark, monkeypatch):
    """Texts that share half of their words and, some of them, nearly all; one text of many megabytes."""
    from wayfold.llm import near_dedup

    rng = random.Random(12)
    passage, rows = words(rng, 60), []
    for i in range(90):
        own = words(rng, 40) if i % 3 else rows[-1][1][len(passage) + 1 :] + " end" if rows else words(rng, 40)
        rows.append((i, f"{passage} {own}"))
    rows.append((200, "many words here " * 300_000))
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == brute_classes(rows)


def test_near_tells_colliding_words_apart(long_texts):
    from wayfold.llm.near_dedup import shingles

    h, rows = shingles(pa.array([thue_morse(1024), thue_morse(1024, 1)]))
    assert len(set(h.tolist())) == 2 and rows.tolist() == [0, 1]


def test_near_settles_what_leaders_leave(spark, monkeypatch):
    from wayfold.llm import near_dedup

    rng = random.Random(5)
    base = words(rng, 120).split()
    rows = []
    for i in range(60):
        own = list(base)
        for k in rng.sample(range(120), 2):
            own[k] = f"z{i}{k}"
        rows.append((i, " ".join(own), None, None, 0))
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    got = near_dedup.near_classes(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    want = brute_classes(rows)
    assert {r.doc_id: r.class_id for r in got.collect()} == want


def test_sketch_estimates_similarity():
    from wayfold.llm.near_dedup import PLACES, shingles, sketches, weighted

    rng = random.Random(2)
    a = words(rng, 400).split()
    b = a[:300] + words(rng, 100).split()
    s = sketches(*weighted(*shingles(pa.array([" ".join(a), " ".join(b)]))), 2)
    agree = (s[0] == s[1]).sum() / PLACES
    assert abs(agree - 296 / 496) < 0.15


def test_quality_statistics():
    from wayfold.llm.quality_rules import BASE, statistics

    rng = random.Random(7)
    texts = TRICKY + ["many words of a long text " * 200_000, "a b c a b c d", "x\nx\ny\n \n x", "#a $b | c < d >"] + [" ".join(rng.choices("abc", k=60)) for _ in range(20)]
    got = statistics(texts)[BASE].to_numpy()
    for t, own in zip(texts, got):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        often = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if often[tuple(w[i : i + 3])] >= 2 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert own.tolist() == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)]


def test_trees_are_monotone():
    from wayfold.llm.quality_rules import fit_trees

    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] < 0.6) ^ (rng.random(800) < 0.1)).astype(float)
    f = fit_trees(x, y, [-1, 0, 0])
    line = np.column_stack([np.linspace(0, 1, 200), np.full(200, 0.5), np.full(200, 0.5)])
    assert (np.diff(f.score(line)) <= 1e-12).all()
    assert ((f.score(x) > 0.5) == (x[:, 0] < 0.6)).mean() > 0.9


def test_quality_queries(spark, sf, docs, empty):
    from pyspark.sql import functions as F

    from wayfold.llm import quality_rules, site_quality

    real, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_rules.quality_rules(real, labels).join(labels, "doc_id").where("NOT base_failed").toPandas()
    assert (got.kept == (got.quality > 0)).mean() > 0.95
    site = site_quality.site_quality(real, labels, F.col("source"), F.concat_ws("/", "source", "lang"))
    assert (lambda d: (d.kept == (d.quality > 0)).mean())(site.join(labels, "doc_id").toPandas()) > 0.95
    for rows in (docs, empty):
        assert quality_rules.quality_rules(rows, labels.where("false")).count() == rows.count()
        assert site_quality.site_quality(rows, labels.where("false"), F.col("source"), F.col("lang")).where("kept").count() == rows.count()
    assert quality_rules.quality_filter(docs, labels).columns == docs.columns


def test_licenses(spark, empty):
    from wayfold.llm import licenses

    texts = ["Some text.\nreleased under  the MIT License", licenses.TEXTS["MIT"].replace("MIT License\n", "MIT Licence\n\nCopyright (c) 2020 Somebody\n"), None, "", "Released under the MIT License, they say", "This work is licensed under CC BY-SA 4.0.\nThis work is licensed under CC BY-SA 4.0."]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: (r.license_ids, r.n_lines, r.whole_text) for i, r in got.items()} == {0: ("MIT", 1, False), 1: ("MIT", got[1].n_lines, True), 5: ("CC-BY-SA-4.0", 2, False)}
    assert licenses.license_scan(empty).count() == 0
    gnu = licenses.GNU_HEADER.format("program", *licenses.GNU[1][1:])
    texts = [licenses.TEXTS["BSD-3-Clause"], "a\n\n" + gnu.replace(" under ", "\nunder ").replace(", either", ",\n   either") + "\n\nb", gnu + " x"]
    got = {r.doc_id: (r.license_ids, r.n_lines, r.whole_text) for r in licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: ("BSD-3-Clause", 0, True), 1: ("GPL-3.0", 0, False)}


def test_pipeline(spark, sf):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "exact", "near", "packed"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf).cache()
        assert rows.columns == docs.columns
    texts = [(r.doc_id, r.text, None, None, 0) for r in rows.collect()]
    assert len({t for _, t, *_ in texts}) == len(texts) and len(set(brute_classes(texts).values())) == len(texts)
    ids = {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()}
    assert ids == {i for i, *_ in texts}


WRAPPERS = ["<div class='layout has-sidebar'>@</div>", "<div class='nav-open'>@</div>", "<article class='post has-comments'>@</article>", "<main class='no-ads'>@</main>", "<form id='aspnetForm'>@</form>", "<div id='modal'>@</div>", "<div class='menu'><article>@</article></div>"]


@pytest.mark.parametrize("hosted", [False, True])
def test_html_wrappers_keep_their_text(spark, hosted):
    """A page's own wrapper is never dropped by its name, role or tag, with a template or without."""
    rng = random.Random(6)
    pages, want = [], {}
    for k, wrapper in enumerate(WRAPPERS):
        for i in range(12 if hosted else 1):
            own = words(rng, 60)
            inner = f"<p>{own}</p><div class='comments'>a reader says</div><div class='ad-top'>buy</div>"
            pages.append((100 * k + i, f"http://h{k}.example/x", f"<body><nav><a href='/'>Start</a></nav>{wrapper.replace('@', inner)}<footer>me</footer></body>"))
            want[100 * k + i] = own
    assert extracted(spark, pages) == want


def test_html_long_comments_go(spark):
    """Reader comments longer than the article don't become the content, whether they are articles themselves or not."""
    for kind in ("div", "article"):
        page = f"<body><article><p>short text</p></article><{kind} class='comments'>{'much said ' * 50}</{kind}></body>"
        assert extracted(spark, [(1, None, page)]) == {1: "short text"}


def test_html_is_linear_in_nesting():
    import time

    from wayfold.llm import html_text

    began = time.time()
    n = 100_000
    for page in ("<div>x" * n, "<div>" * n + "</p>" * n + "x", "<b>" * n + "<p>y</p>" * 1000, "<div class='a'><b>" * n + "x" + "</div>" * n):
        read = html_text.read_page(page)
        assert "".join(f.text for f in read.found)
        assert html_text.main_text(read)
        html_text.page_tokens(read)
    rows = [{"token": i, "up": i - 1, "place": i, "chars": 5, "links": 0, "dropped": False, "text": False, "marked": False, "class": 1} for i in range(1, n)]
    assert html_text.Template(rows).region is not None
    assert time.time() - began < 40


def test_html_classes_equal_a_slow_reading(spark):
    """Occurrence vectors kept whole in a dictionary."""
    from wayfold.llm import html_text

    rng = random.Random(12)
    pages = []
    for i in range(60):
        parts = [f"<div class='{c}'><p>{rng.choice(['fixed words', words(rng, 5), words(rng, 9)])}</p></div>" for c in rng.sample("uvwxyz", rng.randint(2, 6))]
        if i % 3:
            parts.insert(0, "<header><h1>The site</h1><p>Its line</p></header>")
        pages.append((i, f"http://{'ab'[i % 2]}.example/", f"<body>{''.join(parts)}<article><p>{rng.choice(['Write to us', words(rng, 4)])}</p></article></body>"))
    pages += [(100 + i, "http://a.example/", pages[0][2]) for i in range(5)]
    vectors, seen = collections.defaultdict(collections.Counter), collections.defaultdict(list)
    for i, url, page in pages:
        seen[url].append((i, page))
        for token, _, n, *_ in html_text.page_tokens(html_text.read_page(page)):
            vectors[url, token][i] = n
    want = collections.defaultdict(set)
    for (url, token), v in vectors.items():
        texts = {i: page for i, page in seen[url]}
        kinds = lambda ids: len({texts[i] for i in ids})
        often = len(v) >= 4 and (kinds(v) >= max(8, 0.5 * kinds(texts)) if token < -1 else len(v) >= 0.5 * len(texts))
        if often:
            want[url, frozenset(v.items())].add(token)
    want = {(url.split("/")[2], frozenset(t)) for (url, _), t in want.items() if len(t) >= 2}
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = set()
    for r in html_text.templates(html_text._hosted(frame, "page_id", "url", "html")).collect():
        own = collections.defaultdict(set)
        for t in r.tokens:
            own[t["class"]].add(t["token"])
        got |= {(r.host, frozenset(x)) for x in own.values()}
    assert got == want and len(got) >= 3


def test_html_templates_matter_on_real_pages_without_marks(spark, sf):
    """The given pages with neutral names: the template finds what the marks told."""
    pages = spark.read.parquet(f"{sf}/../sf0.01/pages.parquet").collect()
    plain = re.compile(r"<(/?)(article|main|nav|aside|footer|header|form)\b")
    bare = [(r.page_id, r.url, plain.sub(r"<\1div", re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*')", "", r.html or ""))) for r in pages]
    marked = extracted(spark, [(r.page_id, r.url, r.html) for r in pages])
    alone = extracted(spark, [(i, f"http://h{i}/", h) for i, _, h in bare])
    hosted = extracted(spark, bare)
    assert sum(hosted[i] != alone[i] for i in hosted) > 0.5 * len(hosted)
    words_of = lambda t: collections.Counter(t.split())
    extra = [(sum((words_of(x[i]) - words_of(marked[i])).values()), sum((words_of(marked[i]) - words_of(x[i])).values())) for x in (alone, hosted) for i in hosted]
    n = len(hosted)
    print("words too many and too few: alone", sum(e[0] for e in extra[:n]), sum(e[1] for e in extra[:n]), "template", sum(e[0] for e in extra[n:]), sum(e[1] for e in extra[n:]))
    assert sum(e[0] for e in extra[n:]) < 0.5 * sum(e[0] for e in extra[:n])
