"""Each operator against brute force, on odd rows and on none."""

import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from usage_audit.llm import common, dedup, html, mixing, neighbours, ngrams, packing, sharding, tokenfile, tokens, toxicity, urls

FOLDER = tokens.vocabulary_dir()


def rows(df):
    return [r.asDict() for r in df.collect()]


def texts_of(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


# --- packing --------------------------------------------------------------------------------------------------------


def check_pieces(spark, docs, window):
    tokenizer = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    expected = Counter()
    for i, t in texts_of(docs):
        expected[i, tuple(tokenizer.encode(t, add_special_tokens=False).ids + [0])] += 1
    pieces = rows(packing.pack(spark, docs, window, FOLDER))
    by_sequence = defaultdict(list)
    for p in pieces:
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] > 0
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for cuts in by_sequence.values():
        at = 0
        for offset, length in sorted(cuts):
            assert offset == at
            at += length
        assert at <= window
    # every document's pieces are all its ids, each once
    assert sum(p["length"] for p in pieces) == sum(len(k[1]) * n for k, n in expected.items())
    for (i, ids), n in expected.items():
        found = Counter()
        for p in pieces:
            if p["doc_id"] == i and p["doc_tokens"] == len(ids) and tuple(np.frombuffer(p["ids"], "<u4")) == ids[p["start"] : p["start"] + p["length"]]:
                for k in range(p["start"], p["start"] + p["length"]):
                    found[k] += 1
        assert all(found[k] >= n for k in range(len(ids)))
    return pieces, by_sequence


def test_packing_keeps_every_id_once(spark, odd_docs):
    pieces, sequences = check_pieces(spark, odd_docs, 64)
    assert sum(sum(n for _, n in c) < 64 for c in sequences.values()) <= 1  # the last of the only shard


def test_packing_puts_related_documents_together(spark):
    random.seed(3)
    topics = [[f"{t}{i}q" for i in range(40)] for t in ("alpha", "beta", "gamma", "delta")]
    docs = spark.createDataFrame([(i, " ".join(random.choices(topics[i % 4], k=30))) for i in range(80)], "doc_id long, text string")
    together = defaultdict(set)
    for p in rows(packing.pack(spark, docs, 512, FOLDER)):
        together[p["sequence_id"]].add(p["doc_id"] % 4)
    assert np.mean([len(t) for t in together.values()]) < 2.5  # four topics; by chance nearly all meet in each window


def test_packing_finds_related_documents_of_all_shards(spark, monkeypatch):
    random.seed(8)
    topics = [[f"{random.choice('bcdfgklm')}{random.choice('aeiou')}{random.choice('nprstvz')}{t}x{i}" for i in range(40)] for t in range(40)]
    for n in (400, 1600):
        docs = spark.createDataFrame([(i, " ".join(random.choices(topics[i % 40], k=20))) for i in range(n)], "doc_id long, text string").repartition(5)
        mean = []
        for size in (60, 10_000):
            monkeypatch.setattr(packing, "DOCS_PER_SHARD", size)
            together, shards = defaultdict(set), set()
            for p in rows(packing.pack(spark, docs, 512, FOLDER)):
                together[p["sequence_id"]].add(p["doc_id"] % 40)
                shards.add(p["sequence_id"] >> 32)
            assert (len(shards) > 3) == (size == 60)
            mean.append(np.mean([len(t) for t in together.values()]))
        assert mean[0] < 1.5 * mean[1]  # topics of a window: nearly as if all documents were in one index


def test_packing_asks_again():
    docs = [np.array([10 + i % 2, 100 + i % 2, 1000 + i, 0], np.uint16) for i in range(200)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=packing.VOCABULARY)
    first = [d for d, _, _, sequence, _ in packing.pack_shard(docs, packing._Index(docs, df, len(docs), 4.0), 320) if sequence == 0]
    assert len(first) == 80 and {d % 2 for d in first} == {0}  # five times as many as are asked for at once


def test_a_hot_cluster_is_split(monkeypatch):
    monkeypatch.setattr(packing, "DOCS_PER_SHARD", 10)
    weights = np.array([3, 3, 0, 2, 100, 1, 9, 9, 4, 4, 4, 0], float)
    first, number = packing.shards_of_cells(weights, 4)
    held = np.zeros((first + number).max())
    for w, f, n in zip(weights, first, number, strict=True):
        held[f : f + n] += w / n
    assert held.max() <= 15 and number.tolist() == [1, 1, 1, 1, 10, 1, 1, 1, 1, 1, 1, 1] and len(set(first[:4])) == len(set(first[8:])) == 1


def test_packing_of_nothing(spark, no_docs):
    assert rows(packing.pack(spark, no_docs, 64, FOLDER)) == []


# --- mixing ----------------------------------------------------------------------------------------------------------


def filled(sizes, weights, cap=3):
    total, open_, target = sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while True:
        left, w = total - sum(cap * sizes[i] for i in range(len(sizes)) if i not in open_), sum(weights[i] for i in open_)
        over = {i for i in open_ if weights[i] * left / w > cap * sizes[i]}
        if not over:
            return [weights[i] * left / w if i in open_ else cap * sizes[i] for i in range(len(sizes))]
        open_ -= over


def test_mixing_meets_targets(spark):
    random.seed(1)
    docs = [(i, "w " * random.randint(0, 60), random.choice(["a", "b", "b", "b", "b", "c", "ç", None])) for i in range(600)] + [(900, "w " * 9, "tiny")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = rows(mixing.mix(spark, df))
    assert len(got) == len(docs)
    names = sorted({d[2] for d in docs if d[2]}) + [None]
    sizes = [sum(len(t.split()) for _, t, s in docs if s == n) for n in names]
    want = filled(sizes, [(1, 2, 3)[k % 3] for k in range(len(names))])
    for n, size, target in zip(names, sizes, want, strict=True):
        of = [r for r in got if r["source"] == n]
        assert {r["source_size"] for r in of} == {size}
        assert all(abs(r["target"] - target) < 1e-6 for r in of)
        assert abs(sum(r["taken"] for r in of) - target) <= 30  # half of the longest document
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    assert sorted(map(str, got)) == sorted(map(str, rows(mixing.mix(spark, df.repartition(7)))))


def test_mixing_odd_and_none(spark, odd_docs, no_docs):
    got = rows(mixing.mix(spark, odd_docs))
    assert len(got) == 15 and all(r["taken"] == 0 for r in got if r["size"] == 0)
    out = mixing.repeated(spark, odd_docs)
    assert out.columns == odd_docs.columns and out.count() == sum(r["repeats"] for r in got)
    assert rows(mixing.mix(spark, no_docs)) == [] and rows(mixing.repeated(spark, no_docs)) == []


# --- sharding ---------------------------------------------------------------------------------------------------------


def jump(key, n):
    key &= 2**64 - 1
    b, j = -1, 0
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, odd_docs, no_docs):
    for docs in (odd_docs, spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))):
        got = rows(sharding.assign_shards(spark, docs, 5))
        for r in got:
            key = -1 if r["doc_id"] is None else r["doc_id"]
            assert (r["shard"], r["grown_shard"]) == (jump(key, 5), jump(key, 6))
            assert r["grown_shard"] in (r["shard"], 5)
        for s in range(5):
            assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    by_id = {r["doc_id"]: r for r in rows(sharding.assign_shards(spark, odd_docs, 5))}
    assert (by_id[4]["size"], by_id[4]["text_crc32"]) == (8, 0) and by_id[10]["text_crc32"] == zlib.crc32("ünï cödé 日本語 text".encode())
    assert rows(sharding.assign_shards(spark, no_docs, 5)) == []


def test_jump_hash_of_many_shards(spark):
    keys = spark.createDataFrame([(k,) for k in (-(2**63), -5, 0, 7, 2**63 - 1)], "k long")
    for r in keys.select("k", sharding.jump_hash(F.col("k"), 1000).alias("s")).collect():
        assert r["s"] == jump(r["k"], 1000)


# --- pages ------------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class="site"><h1>Site name</h1><nav><a href="/">Home</a></nav></header>
<div class="menu"><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></div><div class="cookie-notice"><p>We use cookies, of course, and we ask you to accept them all, please.</p></div>
<main><article><header><h2>Heading</h2><p class="byline">By someone</p></header><p>First paragraph, with caf&eacute;&nbsp;and   more; it goes
on, and on.</p><p><b>Second<br>paragraph, which has no end tag, and is long enough.<p>Short.</p><ul><li>one<li>two</ul><div class="ad">Buy this now</div><form><p>Subscribe</p><input></form>
<script>var a = "<p>no</p>";</script></article><section class="comments"><p>I do not agree, at all, with any of this, and I write a lot, really a lot, about it.</p></section></main>
<aside><p>Related things, which are long, and have commas, and would look like text, too.</p></aside><footer>&copy; Site</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Heading\nFirst paragraph, with café and more; it goes on, and on.\nSecond paragraph, which has no end tag, and is long enough.\nShort.\none\ntwo"


def test_main_text_without_landmarks():
    page = "<body><ul><li><a href=x>Home</a><li><a href=y>News</a></ul><div><h1>Title</h1><div>" + "<p>Some long text, with marks, and with more words than a menu has.</p>" * 5 + "</div></div><div>Copyright</div></body>"
    assert html.main_text(page).split("\n")[0] == "Title" and "Home" not in html.main_text(page) and "Copyright" not in html.main_text(page)


LONG = "<p>Some long text, with marks, and with more words than a menu has.</p>"


@pytest.mark.parametrize("page", [
    f"<body><div>{LONG * 17}</div><div>{LONG * 3}</div></body>",
    f"<body><p>A lead paragraph, which stands alone, and which says what follows, too.</p><div>{LONG * 17}</div></body>",
    f"<body><h1>Title</h1><div>{LONG * 9}</div></body>",
    f"<body><article><h2>One</h2>{LONG * 17}</article><article><h2>Two</h2>{LONG * 2}<p>Short.</p></article></body>",
])
def test_main_text_of_all_containers(page):
    page = page.replace("<body>", "<body><ul><li><a href=x>Home</a><li><a href=y>News</a></ul>").replace("</body>", "<div>Copyright</div></body>")
    want = re.sub(r"(<[^>]*>)+", "\n", page).strip().split("\n")
    assert html.main_text(page).split("\n") == want[2:-1]


@pytest.mark.parametrize(("page", "text"), [(None, ""), ("", ""), ("<p>", ""), ("<script>x</script>", ""), ("plain", "plain"), ("<span>" * 3000 + "deep", "deep")])
def test_main_text_of_odd_pages(page, text):
    assert html.main_text(page) == text


@pytest.mark.parametrize("wrapper", [
    '<div class="container sidebar-right">%s</div>', '<div id="page" class="navbar-fixed-top">%s</div>', '<form id="aspnetForm">%s</form>', '<article><section id="search">%s</section></article>',
    '<article><div class="share-price-report">%s</div></article>', '<div style="display:none">%s</div>', "<main>%s</main>", "<div><div>%s</div></div>", "%s",
])
def test_hints_never_empty_a_page(wrapper):
    page = "<body><nav><ul><li><a href=x>Home</a><li><a href=y>News, and more</a></ul></nav>" + wrapper % f"<h1>Title</h1>{LONG * 6}" + "<div class=ad>Buy this thing, now.</div><footer>Copyright, all rights.</footer></body>"
    assert html.main_text(page).split("\n") == ["Title"] + [LONG[3:-4]] * 6


def test_ratios_choose_the_nodes(monkeypatch):
    words = "word " * 60
    page = f"<body><div><p>{LONG * 5}</p></div><div><ul>{''.join(f'<li>{words}</li>{"<li>x</li>" * 25}' for _ in range(3))}</ul></div></body>"
    assert html.main_text(page).split("\n") == [LONG[3:-4]] * 5
    monkeypatch.setattr(html, "ratios", lambda path, chars, marks: np.ones(len(path)))
    assert words.strip() in html.main_text(page)  # long, but without marks, and among short ones of its path
    comments = f"<body><article><h1>Title</h1>{LONG * 4}<div class=comments>{'<p>I say, as a reader, that this, and that, is long. ' * 9}</div></article></body>"
    monkeypatch.undo()
    assert html.main_text(comments).split("\n") == ["Title"] + [LONG[3:-4]] * 4


@pytest.mark.parametrize("page", [
    f'<article><div class="article-body related-research">{LONG * 2}</div></article>', f'<main><p>First, as a start, some text.</p><section id="ad-hoc-networks">{LONG * 3}</section></main>',
    f'<article><p>First, as a start, some text.</p><div class="editor-comment">{LONG * 2}</div></article>', f'<header class="article-header"><h1>Headline</h1></header><article>{LONG * 4}</article>',
    f"<div>{LONG * 3}<p>Short.</p>{LONG}<p>The end</p></div>", f"<div><h1>Title</h1><p>By someone</p>{LONG * 3}</div>",
])
def test_text_that_names_or_lengths_might_hide(page):
    want = re.sub(r"(<[^>]*>)+", "\n", page).strip().split("\n")
    whole = f'<body><nav><ul><li><a href=x>Home</a><li><a href=y>News, and more</a></ul></nav>{page}<div class="comments"><p>I say so.</p></div><footer>Copyright, by us.</footer></body>'
    assert html.main_text(whole).split("\n") == want


def test_ratios_by_brute_force():
    r = random.Random(6)
    for _ in range(20):
        n = r.randint(1, 40)
        path, chars, marks = [r.randint(0, 5) for _ in range(n)], [r.randint(1, 300) for _ in range(n)], [r.randint(0, 9) for _ in range(n)]
        fused = []
        for p in path:
            same = [k for k in range(n) if path[k] == p]
            fused.append(sum(chars[k] for k in same) / len(same) * (1 + sum(marks[k] for k in same) / len(same)))
        assert np.allclose(html.ratios(*map(np.array, (path, chars, marks))), fused)
        weights = [np.exp(-d * d / 2) for d in (-2, -1, 0, 1, 2)]
        smooth = [sum(w * fused[min(max(k + d, 0), n - 1)] for w, d in zip(weights, (-2, -1, 0, 1, 2), strict=True)) / sum(weights) for k in range(n)]
        mean = {p: np.mean([min(smooth[k], 1.2 * fused[k]) for k in range(n) if path[k] == p]) for p in path}
        assert html.selected(np.array(path), np.array(fused)).tolist() == [bool(mean[p] >= 0.6 * max(mean.values())) for p in path]


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "deep", "<b><div>" * 50_000 + "deep" + "</b>" * 50_000, "<p><b>" * 50_000 + "deep", "<div>" * 50_000 + "</p></i>" * 50_000 + "deep"])
def test_deep_pages_take_linear_time(page):
    began = time.process_time()
    assert html.main_text(page) == "deep"
    assert time.process_time() - began < 10


def test_extract_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 2)], "page_id long, url string, html string, text long")
    got = rows(html.extract(pages))
    assert sorted(r["n_chars"] for r in got) == sorted(len(r["text"]) for r in got) and len(got) == 3
    assert rows(html.extract(pages.limit(0))) == []


# --- urls -------------------------------------------------------------------------------------------------------------


def judged(url):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url).groups()
        host = host.translate({k: k + 32 for k in range(65, 91)})
    fits = [(len(h + p), v == "block", h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None, max(fits)[3] if fits else "allow"


def test_urls(spark):
    given = [None, "", "no scheme", "http://a.org", "http://a.org/x", "HTTP://WWW.Example.ORG/es/1?q#f", "https://example.org/en/12", "https://notexample.org/es/", "ftp://x.com/fr/", "http://x.com/de/1", "http://com/de/", "http://ÄB.com/fr/#x", "a://b://c/d", "http://.org/", "http://x.com?/fr/", "http://x.com/fr/"]
    pages = spark.createDataFrame([(i % 9, u, "x") for i, u in enumerate(given * 2)], "page_id int, url string, host string")
    rules = spark.createDataFrame(list(urls.RULES), "verdict string, host string, path string")
    got = rows(urls.judge_urls(spark, pages, rules))
    assert len(got) == len(given) * 2
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(r["url"]), r
    assert rows(urls.judge_urls(spark, pages.limit(0), rules)) == []
    assert {r["verdict"] for r in rows(urls.judge_urls(spark, pages, rules.limit(0)))} == {"allow"}


def test_many_rules_and_hot_urls(spark):
    r = random.Random(3)
    listed = [(r.choice(["allow", "block"]), f"{r.choice('abcdef')}{r.randint(0, 9999)}.{r.choice(['com', 'org'])}", "/" + "x" * r.randint(0, 30)) for _ in range(100_000)] + [("block", "com", "/"), ("allow", "com", "/")]
    by_key = defaultdict(set)
    for v, h, p in listed:
        by_key[h + p].add(v)
    urls_ = [f"http://{r.choice(['', 'www.'])}{r.choice('abcdefg')}{r.randint(0, 9999)}.{r.choice(['com', 'org', 'net'])}/{'x' * r.randint(0, 35)}{r.choice(['', '?q', 'y'])}" for _ in range(1500)] + ["http://hot.com/x"] * 700 + [None] * 300
    pages = spark.createDataFrame(list(enumerate(urls_)), "page_id long, url string").repartition(5)
    got = rows(urls.judge_urls(spark, pages, spark.createDataFrame(listed, "verdict string, host string, path string")))
    assert len(got) == len(urls_)
    for x in got:
        want = None
        labels = x["host"].split(".")
        for k in range(len(labels)):
            for n in range(len(x["path"]) + 1):
                key = ".".join(labels[k:]) + x["path"][:n]
                if x["host"] and n and key in by_key and (want is None or len(key) > len(want)):
                    want = key
        assert x["rule"] == want and x["verdict"] == ("allow" if want is None or "block" not in by_key[want] else "block")


# --- token files --------------------------------------------------------------------------------------------------------


def test_file_format_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ids = r.integers(0, 65536, n).astype(np.uint16)
        order = tokenfile.by_frequency(np.bincount(ids, minlength=65536))
        counts = np.array([n // 2, 0, n - n // 2])
        d, c, back = tokenfile.decode(tokenfile.encode(np.array([-5, 0, 2**40]), counts, ids, order))
        assert (back == ids).all() and d.tolist() == [-5, 0, 2**40] and (c == counts).all()
    with pytest.raises(ValueError):
        tokenfile.decode(b"x" * 100)


def test_token_files(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(tokenfile, "IDS_PER_FILE", 30)
    tokenizer = Tokenizer.from_file(f"{FOLDER}/word_bpe_49k.json")
    path = common.shared_path(spark, "t")
    got = rows(tokenfile.read_files(spark, path, tokenfile.write_files(spark, odd_docs, path, FOLDER)))
    want = sorted(((i is None, i or 0), tuple(tokenizer.encode(t, add_special_tokens=False).ids + [1])) for i, t in texts_of(odd_docs))
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), tuple(np.frombuffer(r["ids"], "<u4"))) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))
    path = common.shared_path(spark, "t")
    assert rows(tokenfile.read_files(spark, path, tokenfile.write_files(spark, no_docs, path, FOLDER))) == []


def test_token_files_of_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(tokenfile, "IDS_PER_FILE", 500)
    docs = spark.range(3000).selectExpr("CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 7 ELSE id END AS doc_id", "concat('word ', id % 5) AS text").repartition(4)
    path = common.shared_path(spark, "t")
    written = tokenfile.write_files(spark, docs, path, FOLDER)
    got = rows(tokenfile.read_files(spark, path, written))
    files = rows(written)
    assert len(got) == 3000 and max(f["ids"] for f in files) <= 500 and len({f["part"] for f in files}) > 5
    assert max(sum(g["ids"] for g in files if g["part"] == p) for p in {f["part"] for f in files}) < 4000  # of 9000 and more
    order = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == sorted((r["doc_id"] for r in got), key=lambda i: (i is None, i or 0))
    assert [r["start"] for r in order] == np.cumsum([0] + [r["n_tokens"] for r in order])[:-1].tolist()


def test_encoders_equal_the_tokenizers():
    odd = ["", " ", "a  b\n\n c", "ΣΑΣ Σ. ΟΔΟΣ", "İstanbul", "don't we'll I'M", "x\x1cy\x85z\xa0w", "é ́x", "日本語 テスト", "<|endoftext|> hi", "a<|endoftext|>b <|ENDOFTEXT|>", "<|startoftext|>", "x \x01 y\x01", "a_b-c 12.5%", "ſ ẞ ŉ", "ab,cd 'S it's.", "À!? ÷×", "Ab" * 500, " \n x", "  \n x", "x\n \ny ", "x   y  ", "\x0b \x0b", "J̌ ǰ"]
    parts = [" ", "  ", "\n", "\t", " ", " ", "\x0b", "\x1c", "\x85", "a", "B", "é", "É", "'s", "'S", "1", "23", "!", "…", "<|endoftext|>", "日", "\x01", "é", "İ", "ß"]
    r = random.Random(1)
    odd += ["".join(r.choices(parts, k=r.randint(1, 14))) for _ in range(3000)]
    for name, encode in (("word_bpe_49k", tokens.word_encoder(FOLDER)), ("byte_bpe_50k", tokens.byte_encoder(FOLDER))):
        tokenizer = Tokenizer.from_file(f"{FOLDER}/{name}.json")
        for got in (encode(pa.array(odd)), [encode(pa.array([t]))[0] for t in odd[:40]]):
            for t, ids in zip(odd, got, strict=False):
                assert np.frombuffer(ids, np.uint16).tolist() == tokenizer.encode(t, add_special_tokens=False).ids, (name, t)


def test_pieces_are_forgotten_and_made_again(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 8)
    pieces = tokens._Pieces(lambda p: (np.array([int(x) for x in p.to_pylist() for _ in range(int(x) % 3)], np.uint16), np.array([int(x) % 3 for x in p.to_pylist()])))
    r = np.random.default_rng(4)
    for _ in range(50):
        given = r.integers(0, 30, 12).tolist()
        ids, sizes = pieces(pa.array(map(str, given)))
        assert ids.tolist() == [x for x in given for _ in range(x % 3)] and sizes.tolist() == [x % 3 for x in given]
        assert len(pieces.known) <= 20


# --- neighbours ------------------------------------------------------------------------------------------------------------


def test_neighbours(spark):
    r = np.random.default_rng(5)
    e = r.normal(size=(1500, 16)).astype(np.float32)
    e[100:140] = e[7]  # ties
    data = [(i, x.tolist()) for i, x in enumerate(e)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [float("inf")] + [1.0] * 15), (2080, [1.0, 2.0])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")).repartition(3)
    got = defaultdict(list)
    for x in rows(neighbours.nearest(spark, df, df.filter("vec_id % 20 = 0"), 10)):
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    product = e.astype(float) @ e.astype(float).T
    hits = 0
    assert set(got) == set(range(0, 1500, 20))
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11)) and q not in [f[1] for f in found]
        assert all(abs(s - product[q, v]) < 1e-9 for _, v, s in found)
        assert [(-round(s, 9), v) for _, v, s in found] == sorted((-round(s, 9), v) for _, v, s in found)
        best = sorted((-round(product[q, v], 9), v) for v in range(1500) if v != q)[:10]
        hits += len({v for _, v in best} & {v for _, v, _ in found})
    assert hits >= 0.9 * 10 * len(got)
    tied = [v for _, v, _ in got[100]]
    assert tied == [v for _, v in sorted((-round(product[100, v], 9), v) for v in range(1500) if v != 100)[:10]]


def test_fewer_are_scored_as_rows_grow():
    r = np.random.default_rng(2)
    centres = r.normal(size=(40, 24))
    share = []
    for n in (500, 4000, 40_000):
        x = centres[r.integers(0, 40, n)] + 0.2 * r.normal(size=(n, 24))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        hashes, probes = neighbours.fit(x[:4096], n, 10, 1.0)
        need = neighbours.first_probes(x, x[:50], hashes)
        share.append((need <= probes).mean())
        best = np.argsort(-(x[:50] @ x.T), axis=1)[:, :11]
        assert (np.take_along_axis(need, best, 1) <= probes).mean() > 0.9
    assert share[2] < share[1] < share[0] and share[2] < 0.3, share


def test_neighbours_of_uneven_lengths_are_whole(spark):
    r = np.random.default_rng(8)
    e = r.normal(size=(300, 8)) * np.exp(3 * r.normal(size=(300, 1)))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(e)], "vec_id long, embedding array<double>")
    got = rows(neighbours.nearest(spark, df, df.filter("vec_id % 20 = 0"), 20))
    assert len(got) == 15 * 20


def test_few_neighbours(spark):
    df = spark.createDataFrame([(i, [1.0 + i, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = rows(neighbours.nearest(spark, df, df.filter("vec_id = 0"), 20))
    assert [(r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 4), (2, 3), (3, 2), (4, 1)]
    assert rows(neighbours.nearest(spark, df.limit(0), df.limit(0), 20)) == []


# --- the n-gram join -----------------------------------------------------------------------------------------------------


def brute_classes(docs):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    linked = [[a != b and bool(x) and 10 * len(x & y) >= 8 * len(x | y) for b, y in enumerate(sets)] for a, x in enumerate(sets)]
    names = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(len(docs)):
            if linked[a][b] and names[a] != names[b]:
                names = [names[a] if n == names[b] else n for n in names]
    return [(docs[k][0], min(docs[m][0] for m in range(len(docs)) if names[m] == names[k]), sum(linked[k])) for k in range(len(docs))]


def test_ngram_join_is_whole(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(ngrams, "EXACT_BLOCK", 5)
    random.seed(2)
    vocabulary = [f"v{k}" for k in range(300)]
    docs, seeds = [], [random.choices(vocabulary, k=random.choice([4, 12, 60, 150])) for _ in range(12)]
    for k in range(220):
        words = list(random.choice(seeds))
        for _ in range(random.choice([0, 0, 1, 2, 5])):
            words[random.randrange(len(words))] = random.choice(vocabulary)
        docs.append((k, " ".join(words)))
    passage = " ".join(random.choices(vocabulary, k=60))
    docs += [(1000 + k, passage + " " + " ".join(random.choices(vocabulary, k=50))) for k in range(30)]
    got = rows(ngrams.jaccard_classes(spark, spark.createDataFrame(docs, "doc_id long, text string").repartition(5)))
    assert sorted((r["doc_id"], r["class_id"], r["links"]) for r in got) == brute_classes(docs)


def test_ngram_join_odd_and_none(spark, odd_docs, no_docs):
    got = rows(ngrams.jaccard_classes(spark, odd_docs))
    assert len(got) == 15
    of = {r["doc_id"]: r for r in got}
    assert {of[i]["class_id"] for i in (1, 2, 3, 11)} == {1} and of[11]["copies"] == 3 and of[11]["links"] == 3
    assert (of[7]["class_id"], of[8]["class_id"], of[8]["links"]) == (7, 7, 1)
    assert all((of[i]["class_id"], of[i]["links"]) == (i, 0) for i in (4, 5, 6)) and of[9]["links"] == 1 and of[None]["class_id"] is None
    assert rows(ngrams.jaccard_classes(spark, no_docs)) == []


def test_bayesian_bound():
    fewest = ngrams.fewest_matches()
    assert fewest[0] == 0 and all(b > a for a, b in zip(fewest, fewest[1:], strict=False)) and fewest[-1] < 0.8 * 128


# --- exact dedup ------------------------------------------------------------------------------------------------------------


def test_golomb_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 100, 5000):
        values = np.unique(r.integers(0, 1 << 50, n, np.uint64))
        assert (dedup.golomb_decode(len(values), *dedup.golomb_encode(values, 1 << 50)) == values).all()
    dense = np.arange(100, dtype=np.uint64)
    assert (dedup.golomb_decode(100, *dedup.golomb_encode(dense, 100)) == dense).all()


def test_exact_duplicates(spark, odd_docs, no_docs, monkeypatch):
    monkeypatch.setattr(dedup, "CHUNK", 2)
    groups = defaultdict(list)
    for i, t in texts_of(odd_docs):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    got = rows(dedup.exact_duplicates(spark, odd_docs))
    assert len(got) == 15
    for r in got:
        own = next(g for g in groups.values() if r["doc_id"] in g and len(g) == r["group_size"])
        assert r["keep_id"] == min((i for i in own if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert rows(dedup.exact_duplicates(spark, no_docs)) == []


def test_exact_duplicates_of_a_hot_text(spark, monkeypatch):
    monkeypatch.setattr(dedup, "HOT_SALTS", 4)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id") % 1700)).alias("text")).repartition(4)
    got = rows(dedup.exact_duplicates(spark, docs))
    assert sum(r["kept"] for r in got) == docs.select("text").distinct().count()
    assert {r["group_size"] for r in got if r["doc_id"] % 3 == 0} == {1000} and {r["keep_id"] for r in got if r["doc_id"] % 3 == 0} == {0}


# --- toxicity ---------------------------------------------------------------------------------------------------------------


def test_toxicity_finds_document_and_sentence(spark):
    random.seed(4)
    plain = [f"word{k}" for k in range(200)]
    docs, labels = [], []
    for i in range(1200):
        said = [" ".join(random.choices(plain, k=8)) for _ in range(random.randint(1, 12))]
        toxic = i % 6 == 0
        if toxic:
            said[random.randrange(len(said))] += " " + random.choice(["idiot", "scum", "trash"])
        docs.append((i, ". ".join(said) + "."))
        labels.append((i, int(toxic)))
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, y)
    out = rows(toxicity.scored(d.withColumn("held_out", toxicity.held_out(F.col("doc_id"))), model, where=True))
    held = [r for r in out if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert all(r["held_out"] for r in held) and 200 < len(held) < 400
    assert np.mean([(r["score"] >= toxicity.THRESHOLD) == (r["doc_id"] % 6 == 0) for r in held]) > 0.97
    caught = [r for r in held if r["doc_id"] % 6 == 0 and r["score"] >= toxicity.THRESHOLD]
    assert np.mean([bool(re.search("idiot|scum|trash", r["text"][r["worst_start"] : r["worst_end"]])) for r in caught]) > 0.95


def test_toxicity_odd_and_none(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels)
    out = rows(toxicity.scored(odd_docs, model, where=True))
    assert len(out) == 15 and all(0 <= r["score"] <= 1 for r in out) and "target" in out[0]
    assert all((r["worst_start"] is None) == (not (r["text"] or "").strip()) for r in out)
    assert rows(toxicity.scored(no_docs.select("doc_id", "text"), toxicity.fit(no_docs, labels))) == []


def test_scores_by_brute_force(spark):
    r = random.Random(9)
    model = {"": -3.0, "bad": 4.0, "worse": 6.5, "wors*": 0.5, "good": -2.0}
    texts = ["".join(r.choices(["bad", "worse", "good", "plain", " ", " ", ". ", "!? ", "\n", "Bad "], k=r.randint(0, 30))) for _ in range(200)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for row in rows(toxicity.scored(d, model, where=True)):
        rest, best = 1.0, None
        for m in re.finditer(r"[^.!?\n]+", row["text"]):
            if m[0].strip():
                words = set(re.findall(r"[^\W_]+", m[0].lower()))
                words |= {w[:4] + "*" for w in words if len(w) > 4}
                p = 1 / (1 + np.exp(-(model[""] + sum(model[w] for w in words if w in model))))
                rest *= 1 - p
                if best is None or p > best[0] + 1e-12:
                    best = (p, *m.span())
        assert abs(row["score"] - (1 - rest)) < 1e-9
        if best is None:
            assert row["worst_start"] is None and row["worst_score"] == 0
        else:
            assert abs(row["worst_score"] - best[0]) < 1e-9 and (row["worst_start"], row["worst_end"]) == best[1:]


def test_fit_by_brute_force():
    r = random.Random(2)
    texts = [". ".join(" ".join(r.choices(["a1", "b2", "c3", "d4"], k=3)) + (" vile" if i % 2 and k == 0 else "") for k in range(r.randint(1, 4))) for i in range(60)]
    y = np.arange(60) % 2 == 1
    got = toxicity.fit_bags(texts, y, rounds=12)
    names = [w for w in got if w]
    assert "vile" in names
    bags = [[[w for w in names if w in toxicity.features(s)] for s in toxicity.sentences(t)] for t in texts]

    def loss(theta):
        total = 0.0
        for bag, label in zip(bags, y, strict=True):
            clean = np.prod([1 / (1 + np.exp(theta[""] + sum(theta[w] for w in s))) for s in bag])
            total -= np.log(1 - clean if label else clean)
        return total / len(texts) + 0.5e-4 * sum(theta[w] ** 2 for w in names)

    theta = {"": -6.0} | dict.fromkeys(names, 0.0)
    m, v = dict.fromkeys(theta, 0.0), dict.fromkeys(theta, 0.0)
    for t in range(1, 13):  # Adam on numeric slopes
        slope = {w: (loss(theta | {w: theta[w] + 1e-5}) - loss(theta | {w: theta[w] - 1e-5})) / 2e-5 for w in theta}
        for w, g in slope.items():
            m[w], v[w] = 0.9 * m[w] + 0.1 * g, 0.99 * v[w] + 0.01 * g * g
            theta[w] -= 0.1 * (m[w] / (1 - 0.9**t)) / (np.sqrt(v[w] / (1 - 0.99**t)) + 1e-9)
    assert all(abs(theta[w] - got[w]) < 1e-3 for w in theta)


def test_fit_is_the_same_again(spark):
    docs = spark.createDataFrame([(i % 40, f"some text {i} " + "scum " * (i % 2)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.fit(docs.repartition(7), labels, 15) == toxicity.fit(docs.repartition(2), labels.repartition(3), 15)


# --- helpers ------------------------------------------------------------------------------------------------------------------


def test_components_of_hubs(spark):
    edges = [(i, 10_000) for i in range(1, 3000)] + [(20_000, i) for i in range(5000, 8000)] + [(10_000, 30_000), (30_000, 20_000), (40_000, 40_001)]
    got = {r["node"]: r["component"] for r in rows(common.components(spark.createDataFrame(edges, "a long, b long")))}
    assert set(got) == {x for e in edges for x in e} and all(c == (40_000 if n in (40_000, 40_001) else 1) for n, c in got.items())


def test_components(spark):
    random.seed(6)
    edges = [(k, k + 1) for k in range(60)] + [(100 + random.randrange(50), 100 + random.randrange(50)) for _ in range(40)] + [(7, 7)]
    names = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in names:
        for a, b in edges:
            if a != b:
                names[a] = names[b] = min(names[a], names[b])
    got = {r["node"]: r["component"] for r in rows(common.components(spark.createDataFrame(edges, "a long, b long")))}
    assert got == names


def test_bloom_misses_nothing(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("h"))
    for n in (3000, 5):  # also when more keys come than it is sized for
        marked = common.with_bloom_mark(spark.range(20_000), F.xxhash64("id"), keys, n)
        assert marked.filter("id < 3000 and not __maybe").count() == 0 and marked.count() == 20_000
