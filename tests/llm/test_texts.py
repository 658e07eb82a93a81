"""Tokens, scores, classes, packing, pages, urls and the pipeline against plain versions."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from frameloom.llm import bpe, hmm, html_extract, packing, quality, queries, url_filter, word_cache
from tests.llm import cases

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  ", "a" * 3000, "ab" * 1500, " x  y\n\nz \t q", "日本語 テキスト" * 30, "!?" * 900, "it's <|endoftext|> done", "\x1c a \xa0 b\u3000c", "x\n y", "end ", " start"]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def test_bpe(spark, reference):
    df = cases.documents(spark).union(spark.createDataFrame([(900 + i, t, "", "", 0, "", 0, "") for i, t in enumerate(ODD)], cases.SCHEMA))
    got = sorted(map(tuple, bpe.round_trip(df, RANKS, PATTERN).collect()))
    expected = []
    for i, t in cases.pairs(df):
        ids = reference.encode_ordinary(t)
        expected.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert got == sorted(expected)
    encoded = bpe.encode_texts(df, RANKS, PATTERN)
    decoded = bpe.decode_ids(encoded, RANKS, PATTERN)
    assert sorted((r.doc_id, r.decoded.decode()) for r in decoded.collect()) == sorted(cases.pairs(df))
    assert bpe.round_trip(cases.empty(spark), RANKS, PATTERN).count() == 0


def test_long_pieces_and_small_caches(reference):
    codec = bpe.Codec(RANKS, PATTERN)
    assert codec.merge_long(b"abcab" * 700) == reference.encode_ordinary("abcab" * 700)
    rng = random.Random(6)
    for piece in ("".join(rng.choice(letters) for _ in range(n)) for letters, n in (("ab", 900), ("etaoinshr", 700), ("日本é", 600), ("=-", 3000), ("a", 5001))):
        assert codec.merge_long(piece.encode()) == reference._encode_single_piece(piece.encode())
    codec.cache.limit = 3
    texts = [" ".join(t.split()[:20]) for t in ODD for _ in range(2)]
    for at in range(0, len(texts), 3):
        for t, (ids, raw) in zip(texts[at : at + 3], codec.round_trip(texts[at : at + 3]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t) and raw.decode() == t


def test_cuts_are_clean():
    for t in ODD:
        chunks = word_cache.cut(t)
        assert " ".join(chunks) == t and all(c == c.strip() or len(chunks) == 1 or c in (chunks[0], chunks[-1]) or "  " in t or "\n" in c for c in chunks)


def test_language_model(spark):
    df = cases.documents(spark)
    got = collections.Counter()
    rows = hmm.score(df, passes=1).collect()
    counts = collections.Counter()
    for i, t in cases.pairs(df):
        if cases.crc(i, 7) != 2:
            counts.update([*cases.words(t), b" "])
    n, v = sum(counts.values()), len(counts)
    expected = collections.Counter()
    for i, t in cases.pairs(df):
        w = [*cases.words(t), b" "]
        expected[i, cases.crc(i, 7) == 2, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)] += 1
    for r in rows:
        got[r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)] += 1
        assert np.isfinite(r.score) and r.score < 0
    assert got == expected
    assert hmm.score(cases.empty(spark)).count() == 0


def test_forward_and_counts_match_a_sum_over_paths():
    rng = np.random.default_rng(1)
    k = 3
    m = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(hmm.CLASSES), k).T)
    sequences = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 2, 5)]
    t = hmm.Trellis(sequences)
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros((hmm.CLASSES, k))
    for x, log in zip(sequences, t.log10(m), strict=True):
        total, paths = 0.0, []
        for path in np.ndindex(*([k] * len(x))):
            p = m.start[path[0]] * np.prod([m.emit[s, z] for s, z in zip(x, path, strict=True)]) * np.prod([m.move[a, b] for a, b in zip(path, path[1:], strict=False)])
            total += p
            paths.append((path, p))
        assert math.isclose(math.log10(total), log, rel_tol=1e-9)
        for path, p in paths:
            starts[path[0]] += p / total
            for a, b in zip(path, path[1:], strict=False):
                moves[a, b] += p / total
            for s, z in zip(x, path, strict=True):
                emits[s, z] += p / total
    got = t.expected(m)
    assert all(np.allclose(a, b, rtol=1e-3, atol=1e-5) for a, b in zip(got, (starts, moves, emits), strict=True))


def test_mixture_counts(monkeypatch):
    rng = np.random.default_rng(2)
    k = 3
    m = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(hmm.CLASSES), k).T)
    sequences = [rng.integers(0, 5, n).astype(np.uint16) for n in (1, 4, 17, 2, 5, 1)]
    starts, emits = np.zeros(k), np.zeros((hmm.CLASSES, k))
    for x in sequences:
        p = m.start * np.prod(m.emit[x], axis=0)
        starts += p / p.sum()
        for z in x:
            emits[z] += p / p.sum()
    for tokens in (100, 3, 5, 1):  # a text longer than a group is looked up in parts
        monkeypatch.setattr(hmm, "GROUP_TOKENS", tokens)
        got = hmm.mixture(sequences, m)
        assert np.allclose(got[0], starts) and not got[1].any() and np.allclose(got[2], emits)


def test_first_parameters_come_from_every_document(spark):
    rng = random.Random(4)
    text = lambda kind: " ".join(f"{kind}{rng.randint(1, 60)}" for _ in range(40))
    ids = [r.id for r in spark.range(2300).orderBy(F.xxhash64("id"), "id").collect()]
    train = [i for i in ids if cases.crc(i, 7) != 2]
    kind = {i: "a" if at < 1500 else "bcd"[at % 3] for at, i in enumerate(train)}  # no bounded sample by this hash sees b, c or d
    kind |= {i: "abcd"[at % 4] for at, i in enumerate(i for i in ids if i not in kind)}
    df = spark.createDataFrame([(i, text(x)) for i, x in kind.items()], "doc_id long, text string")
    gain = collections.defaultdict(list)
    for r in hmm.score(df, passes=0).where("held_out").collect():
        gain[kind[r.doc_id]].append((r.score - r.base_score) / r.n_tokens)
    assert {x: min(g) > 0 for x, g in gain.items()} == dict.fromkeys("abcd", True)


def test_passes_leave_no_shuffle_files(spark):
    df = cases.documents(spark)
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().length()
    encoded = hmm.encode(df, "doc_id", "text").where("kind = 0 AND n = 1").select("classes")
    before = files()
    hmm.first_model(encoded, np.ones(hmm.CLASSES), 2)
    assert files() <= before + 4


def test_a_pass_hands_on_few_rows_and_whole_sums(spark, monkeypatch):
    rng, frames, real = np.random.default_rng(5), [], hmm.map_arrow
    monkeypatch.setattr(hmm, "map_arrow", lambda *a: frames.append(real(*a)) or frames[-1])
    k = 3
    m = hmm.Model(rng.dirichlet(np.ones(k)), rng.dirichlet(np.ones(k), k), rng.dirichlet(np.ones(hmm.CLASSES), k).T)
    sequences = [rng.integers(0, hmm.CLASSES, n).astype(np.uint16) for n in (1, 4000, 20, 1)]
    df = spark.createDataFrame([(x.tobytes(),) for x in sequences], "classes binary")
    for expected in (hmm.mixture, hmm.forward_backward):
        got, whole = hmm.whole_pass(df.repartition(3), m, expected), expected(sequences, m)
        assert all(np.allclose(a, b, rtol=1e-3, atol=1e-5) for a, b in zip(got, whole, strict=True))
    frames.clear()
    hmm.whole_pass(df.coalesce(1), m, hmm.mixture)
    assert frames[0].count() <= 200  # what its only task makes; a row for each class seen would be over 3,000
    assert not any(x.any() for x in hmm.whole_pass(df.where("false"), m, hmm.mixture))


def test_encoded_words_are_those_of_plain_python(spark, monkeypatch):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    texts = [t.encode() for t in ODD] + [None, b"\xff\xc3 A\xfe", b"\t\n\v\f\r Zz\x1cQ\x85 \x00 z", "ÄÉ ß \u2003x".encode(), b"w" * 5000, b"A a A b"]
    df = spark.createDataFrame([(None if i == 3 else i, t) for i, t in enumerate(texts)], "doc_id long, text binary").coalesce(1)
    for tokens in (4_000_000, 20, 1):
        monkeypatch.setattr(hmm, "BLOCK_TOKENS", tokens)
        rows = hmm.encode(df, "doc_id", "text").collect()
        words = {(r.block, r.id): r.data for r in rows if r.kind == 1}
        got, counts = [], collections.Counter()
        for r in (r for r in rows if r.kind == 0):
            found = [words[r.block, x] for x in np.frombuffer(r.data, np.uint32).tolist()]
            assert np.frombuffer(r.classes, np.uint16).tolist() == [0 if w == b" " else 1 + zlib.crc32(w) % (hmm.CLASSES - 1) for w in found]
            counts.update((r.block, w) for w in found if r.n)
            got.append((str(r.id), r.n, found))
        expected = [(None if i == 3 else i, t) for i, t in enumerate(texts)]
        assert sorted(got) == sorted((str(i), int(i is None or cases.crc(i, 7) != 2), [*(t or b"").translate(lower).split(), b" "]) for i, t in expected)
        assert {(r.block, r.data): r.n for r in rows if r.kind == 1 and r.n} == counts
        assert len(words) == len({(b, w) for (b, _), w in words.items()}) and (tokens > 1 or len({b for b, _ in words}) == len(texts))


def test_quality(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = quality.score(docs, labels).join(labels, "doc_id").where("held_out")
    right, n, lost = scored.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count("*"), F.count_if((F.col("predicted") == 0) & (F.col("quality") == 1))).first()
    assert n > 50 and right / n > 0.9 and lost / n < 0.03
    odd = cases.documents(spark)
    assert quality.score(odd, labels).count() == odd.count() and quality.score(cases.empty(spark), labels.limit(0)).count() == 0
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns


def test_quality_gradients_and_long_texts(monkeypatch):
    m = {k: v.astype(np.float64) for k, v in quality.new_model().items()}
    rng = np.random.default_rng(2)
    texts = [bytes(rng.integers(97, 105, n).astype(np.uint8)) for n in (0, 3, 900, 1400)]
    y, w = np.array([0, 1, 1, 0], np.float32), np.ones(4, np.float32)
    loss = lambda: float(-(w * np.log(np.where(y == 1, p := quality.predict(m, texts), 1 - p))).mean())
    grads = quality._gradients(m, texts, y, w)
    for name in ("w1", "bias", "table"):
        at = np.unravel_index(np.argmax(np.abs(grads[name])), grads[name].shape)
        old = m[name][at]
        m[name][at] = old + 1e-5
        high = loss()
        m[name][at] = old - 1e-5
        low = loss()
        m[name][at] = old
        assert math.isclose((high - low) / 2e-5, grads[name][at], rel_tol=0.15, abs_tol=1e-4)
    whole = quality.predict(m, texts)
    monkeypatch.setattr(quality, "SCORE_BYTES", 512)
    assert np.allclose(whole, quality.predict(m, texts), atol=1e-5)


def test_packing(spark):
    df = cases.documents(spark).union(spark.createDataFrame([(900, "special <|endoftext|> text", "", "", 0, "", 0, "")], cases.SCHEMA)).repartition(3)
    pieces = packing.pack(df, JSON).collect()
    tok = Tokenizer.from_file(JSON)
    expected = collections.Counter()
    for i, t in cases.pairs(df):
        expected[i, tuple(tok.encode(t, add_special_tokens=False).ids + [1])] += 1
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append(p)
    for s in sequences.values():
        s.sort(key=lambda p: p.offset)
        at = 0
        for p in s:
            assert p.offset == at
            at += p.length
        assert at <= 2048
    padding = sum((2048 - n) for s in sequences.values() if (n := sum(p.length for p in s)) & (n - 1))
    assert padding == 0
    by_doc = collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
    for (i, ids), copies in expected.items():
        mine = [p for p in by_doc[i] if p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())]
        assert sum(p.length for p in mine) >= copies * len(ids)
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in expected.items())
    assert packing.pack(cases.empty(spark), JSON).count() == 0


def test_chunks_strung_together():
    tok = Tokenizer.from_file(JSON)
    rng = random.Random(8)
    words = ["it's", "x.\ny", "日本語", "a\u00a0b", "\u00a0b", "c\u3000", "<|endoftext|>", "Ġ", "!?", "12.5", "\n", "", "e\n", "\x1cf", "'s", "é\u0301", "👍🏽", "g  h", "i \n", "\x85"]
    words += ["".join(rng.choice("abcé日.,'1\n") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    encode = packing.ChunkEncoder(tok)
    chunks = [" " + w for w in words] + ["head", "", "two words", "\ta"]
    assert encode(chunks) == encode.single(chunks) and encode([]) == []
    encode.begins[:] = False  # of a tokenizer with other rules each chunk goes by itself
    assert encode(chunks) == encode.single(chunks)
    cache = word_cache.ChunkCache(packing.ChunkEncoder(tok), limit=40)
    texts = ODD + [" ".join(rng.choices(words, k=30)) for _ in range(40)]
    for at in range(0, len(texts), 3):
        for t, got in zip(texts[at : at + 3], cache.texts(texts[at : at + 3]), strict=True):
            assert np.frombuffer(b"".join(got), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_a_full_cache_is_looked_up_not_gone_through():
    class Filled(dict):
        def __iter__(self):
            raise AssertionError("every entry read for a few texts")

    cache = word_cache.ChunkCache(lambda chunks: [c.upper() for c in chunks])
    cache.inner = Filled({str(i): f" {i}" for i in range(1000)})
    assert cache.texts(["a 5 b", "c 6 b"]) == [["A", " 5", " B"], ["C", " 6", " B"]]
    assert len(cache.inner) == 1001


def test_balanced_costs():
    rng = random.Random(1)
    lengths = np.array([rng.randint(1, 2047) for _ in range(400)])
    pieces = packing.assign(lengths)
    placed = collections.Counter()
    for item, _, n, _ in pieces:
        placed[item] += n
    assert [placed[i] for i in range(len(lengths))] == lengths.tolist()
    assert len(pieces) < 2 * len(lengths)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var x="</p><article>";</script></head><body><header><h2>Site</h2></header>
<nav><ul><li><a href="/">{nav}</a></li></ul></nav><div class="cookie-notice">We use cookies</div><aside class="sidebar">{nav} more</aside><!-- note <article> -->
<article><h1>{title}</h1><p>{a} &amp; <b>bold</b>ly&nbsp;said<p>{b}<br>next</p><div class="ad">buy</div><form><input name=q> search</form><section class="comments"><p>nice!</p></section></article>
<footer>&copy; {nav}</footer></body></html>"""


def test_pages(spark):
    rows, expected = [], {}
    for i in range(70):
        a, b = f"alpha {i}", f"beta\n  {i * 7}"
        rows.append((i, "https://a.example.com/x" if i % 3 else f"https://h{i}.example.org/", PAGE.format(nav=f"n{i}", title=f"T{i}", a=a, b=b), "x"))
        expected[i] = f"T{i} alpha {i} & boldly said beta {i * 7} next"
    rows += [(100, None, None, "x"), (101, "", "", "x"), (102, "https://b.example.com/", "plain < text & more", "x"), (0, rows[0][1], rows[0][2], "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = html_extract.extract_pages(df).collect()
    expected |= {100: "", 101: "", 102: "plain < text & more"}
    assert len(got) == len(rows) and all(r.text == expected[r.page_id] and r.n_chars == len(r.text) for r in got)
    assert html_extract.extract_pages(df.limit(0)).count() == 0


def test_template_classes():
    pages = [html_extract.parse(PAGE.format(nav="n", title=f"t{i}", a="a" * i, b="b")) for i in range(4)]
    t = html_extract.deduce(pages)
    assert "<article>" in t.root and "</article>" in t.root and t.root.index("<article>") < t.root.index("</article>")
    assert t.main == (("<html>", "html"), ("<body>", "body"), ("<article>", "article"))
    listed = html_extract.deduce([html_extract.parse(unnamed_page(i)[0]) for i in range(4)])
    assert listed.menus and all(any("<a>" in c for c in listed.nested[slot]) for slot in listed.menus)


# No name here tells anything: where the text is follows from its amount, its change from page to page and the lists of links.
UNNAMED = """<html><body><div class="q1"><ul>{links}</ul></div><div class="q2"><div class="q5">{promo}</div><div class="q3"><h1>{title}</h1>{paragraphs}</div></div>
<div class="q4">All rights reserved by the owners of this place, who wrote a long line that every page repeats, again and again and again.</div></body></html>"""


def unnamed_page(i):
    paragraphs = [f"Paragraph {k} of page {i} tells something that no other page does." for k in range(3 + i % 3)]
    html = UNNAMED.format(
        links="".join(f'<li><a href="/{k}">A link to somewhere {k} {i}</a></li>' for k in range(5 + i % 2)), promo=f"Offer {i}", title=f"Title {i}", paragraphs="".join(f"<p>{x}</p>" for x in paragraphs))
    return html, " ".join([f"Title {i}", *paragraphs])


@pytest.mark.parametrize("n", [1, 2, 5, 32])
def test_template_decides_where_names_tell_nothing(n):
    pages = [html_extract.parse(unnamed_page(i)[0]) for i in range(n)]
    t = html_extract.deduce(pages)
    assert [html_extract.extract(p, t) for p in pages] == [unnamed_page(i)[1] for i in range(n)]
    nothing = html_extract.Template([], [[]], set(), set(), (), set())
    assert all(html_extract.extract(p, nothing) != unnamed_page(i)[1] for i, p in enumerate(pages))


def test_pages_of_a_hot_host_without_articles(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "PART_PAGES", 40)
    df = spark.createDataFrame([(i, "https://one.example.com/" if i < 150 else f"https://h{i}.example.org/", unnamed_page(i)[0]) for i in range(160)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_extract.extract_pages(df).collect()} == {i: unnamed_page(i)[1] for i in range(160)}


def test_very_long_page():
    long = "<p>" + "word " * 400_000
    for html in (f"<body><nav>m</nav><article>{long}</article></body>", "<div>" * 3000 + "deep" + "</div>" * 3000, "<" * 50_000, "<p " * 20_000):
        page = html_extract.parse(html)
        text = html_extract.extract(page, html_extract.deduce([page]))
        assert not html.startswith("<body") or text.split() == ["word"] * 400_000


@pytest.mark.parametrize("n", [1, 4])
def test_text_behind_a_dropped_element_is_kept(n):
    inside = '<article><div class="intro"><p>first {i}</p></div><div class="ad">buy</div><p>second {i}</p><div class="share"><div>x</div></div><p>third {i}</p></article><p>out</p>'
    plain = '<div class="menu"><div>m</div></div><div class="content"><p>body {i}</p><div class="notice">n</div><p>end {i}</p></div><div class="footer">f</div>'
    for html, expected in ((inside, "first {i} second {i} third {i}"), (plain, "body {i} end {i}")):
        pages = [html_extract.parse(html.format(i=i)) for i in range(n)]
        template = html_extract.deduce(pages)
        assert [html_extract.extract(p, template) for p in pages] == [expected.format(i=i) for i in range(n)]


def test_urls(spark):
    urls = ["http://net/", "http://a.net/x?y", "https://WWW.example.NET/en/1", "https://example.net/fr/1", "http://x.example.com/de/", "http://example.com/de", "ftp://q.org/fr/z#t",
            "http://planet/", "no-scheme.net/", None, "", "http://", "http://net", "http://net:80/", "http://a..net/?", "x://org/fr/http://net/", "https://net?/", "http://..../"]
    df = spark.createDataFrame([(i % 15, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x")], "page_id long, url string, rule string")
    rules = spark.createDataFrame([*queries.URL_RULES, ("net", "/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    got = collections.Counter(map(tuple, url_filter.judge_urls(df, rules).collect()))
    expected = collections.Counter()
    for r in df.collect():
        rest = r.url.split("://", 1)[1] if r.url and "://" in r.url else ""
        host = next((rest[:k] for k in range(len(rest)) if rest[k] in "/?#"), rest)
        path = rest[len(host) :]
        path = next((path[:k] for k in range(len(path)) if path[k] in "?#"), path)
        host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        expected[r.page_id, host, path, best[1], best[2]] += 1
    assert got == expected
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0 and url_filter.judge_urls(df, rules.limit(0)).where("rule IS NOT NULL").count() == 0


def test_native_queries_run_no_python(spark):
    plan = queries.op9_url_filter(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.count()
        docs = stage(spark, docs, folder).cache()
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns and 0.5 * before < docs.count() <= before
            texts = [t for _, t in cases.pairs(docs)]
    tok = Tokenizer.from_file(JSON)
    assert sum(r.length for r in docs.collect()) == sum(len(tok.encode(t, add_special_tokens=False).ids) + 1 for t in texts)
