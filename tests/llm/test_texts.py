"""BPE, HTML extraction, license scans."""

import hashlib
import time
import tracemalloc

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyspan.llm import bpe, common, html, licenses
from tests.llm.conftest import random_texts

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(PATH), bpe.split_table(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


@settings(max_examples=200, deadline=None)
@given(text=st.one_of(st.text(max_size=200), st.text("abthe \n'sé中🙂1", max_size=400)))
def test_bpe_is_exact(codec, reference, text):
    text = text.encode(errors="ignore").decode()
    ids = codec.encode(text)
    assert ids == reference.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_bpe_on_long_pieces(codec, reference):
    for text in ("a" * 5000, "ab" * 3000, " " * 3000, "\n" * 500 + "x", "thethe" * 2000, "🙂" * 1000, "<|endoftext|>"):
        assert codec.encode(text) == reference.encode_ordinary(text)


def test_bpe_remembers_few_pieces(codec, reference, rng, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    for text in [*random_texts(rng, 20), "x" * 300, "añ" * 40]:
        got = list(map(codec.of, codec.find(text)))
        ids = reference.encode_ordinary(text)
        assert ",".join(g[0] for g in got if g[1]) == ",".join(map(str, ids)) and sum(g[1] for g in got) == len(ids)
        assert b"".join(g[2] for g in got) == text.encode()
    assert len(codec.seen) <= 3


def test_bpe_digests(docs, rng, reference):
    rows = list(enumerate([*random_texts(rng, 30), None, "", "x" * 30000])) + [(None, "a b"), (5, "again"), (5, "again")]
    got = bpe.encode_digests(docs(rows, ""), PATH, public_tokenizers.PATTERN).collect()
    want = []
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        want.append((str(i), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want)
    back = bpe.decode_column(bpe.encode_column(docs(rows), PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN).collect()
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in back) == sorted((str(i), (t or "").encode()) for i, t in rows)
    assert bpe.encode_digests(docs([]), PATH, public_tokenizers.PATTERN).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p><p>x";</script></head><body>
<header class="site-header"><a href="/">Home</a> Site</header><nav><ul><li><a href="/a">A</a></ul></nav>
<div class="cookie-notice">We use cookies, do you agree with all of them or not at all?</div>
<div class="layout-{n}"><aside class="sidebar"><p>Side text that is long enough to be taken for content by length alone, really.</aside>
<div class="story s{n}"><h1>Title &amp; more</h1><p>First&nbsp;part of   the <b>text {n}</b>,<br>with a break &lt;here&gt; and some words.
<p>Second paragraph with <a href="/x">one link</a> in it and many other words around.<ul><li>One<li>Two</ul>
<form><input name=q><button>Go</button> search</form><!-- <p>no --></div>
<section id="comments"><h2>Comments</h2><p>Reader comment {n}, a long one that says many things about the article above.</p></section></div>
<div class="ad">Buy this now.</div><footer>&copy; somebody</footer></body></html>"""


def text(n):
    return f"Title & more\n\nFirst part of the text {n}, with a break <here> and some words.\n\nSecond paragraph with one link in it and many other words around.\n\nOne\n\nTwo"


def test_html_extraction(spark):
    rows = [(n, f"https://h{n % 2}.example.org/{n}", PAGE.format(n=n)) for n in range(12)]
    rows += [(50, None, None), (51, "", ""), (52, "not a url", "plain words"), (53, "https://h0.example.org/x", "<p>cut off <b>in the"), (54, "http://[bad", "<div>ok &#233;</div>"), (50, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in html.extract(df).collect()]
    by = {x[0]: x for x in got}
    assert len(got) == len(rows)
    for n in range(12):
        assert by[n][2] == text(n)
    assert [by[n][2] for n in (50, 51, 52, 53, 54)] == ["", "", "plain words", "cut off in the", "ok é"]
    assert all(len(x[2]) == x[3] for x in got)
    assert html.extract(df.limit(0)).count() == 0


def test_winning_paths_are_by_host(spark):
    rows = [(n, f"https://h.example.org/{n}", PAGE.format(n=n)) for n in range(5)]
    got = html.winning_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r.host, r.path, r.votes) for r in got] == [("h.example.org", "body>div.layout-#>div.s#.story", 5)]
    hosts = {"HTTP://u:p@A.example:80/x": "a.example", "https://b?x": "b", "c/d": "", None: "", "http://[bad": "[bad"}
    df = spark.createDataFrame([(u, h) for u, h in hosts.items()], "url string, want string")
    assert df.where(html.host(F.col("url")) != F.col("want")).count() == 0


@pytest.mark.parametrize("rows", [200_000, -1])
def test_the_vote_of_a_host_corrects_a_page(spark, monkeypatch, rows):
    """On its own the page would take the long list beside its short story."""
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    page = "<body><div class=box><div class=story><p>{}</p></div><div class=listing><p>{}</p></div></div>".format
    short, long = "A short story.", "Many words of a list that is there on this page only. " * 9
    pages = [(n, f"http://one.example/{n}", page("Story number of some length that is told here. " * 5, "few words")) for n in range(5)]
    pages += [(10, "http://one.example/10", page(short, long)), (11, "http://other.example/", page(short, long)), (12, None, page(short, long)), (12, None, page(short, long))]
    pages += [(13, "http://one.example/13", "<body><section><p>A page of another kind.</p></section>"), (14, "http://one.example/14", None)]
    many = [(100 + n, f"http://one.example/{n}", f"<body><ul class='k{chr(97 + n // 2)}'><li>{'layout ' * 9}{n}</ul>") for n in range(40)]  # over five layouts
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages + many, "page_id long, url string, html string")).collect()}
    assert got[10] == short and got[11] == got[12] == long.strip() and got[13] == "A page of another kind." and got[14] == ""
    assert all(got[100 + n] == f"{'layout ' * 9}{n}" for n in range(40))


def whole(source):
    p = html.Page(source)
    return p.text(p.chosen({}))


def test_html_drops_no_text_of_an_article():
    assert whole("<p>one</p><svg/><p>two</p>") == "one\n\ntwo"
    assert whole("<p>one</p><svg><svg><text>no</text></svg>no</svg><math a='>'/><p>two</p>") == "one\n\ntwo"
    assert whole("<article><svg-icon name=x></svg-icon><title-bar>all</title-bar><p>two</p></article>") == "all\n\ntwo"
    assert whole('<article><div class="side-by-side"><p>left</p></div><p class="privacy">kept</p><p class="notice">too</p><div class="post-related"><p>and this</p></div></article>') == "left\n\nkept\n\ntoo\n\nand this"
    assert whole("<p>a<!-->b</p><!---><p>c</p><!-- x --!><p>d</p>") == "ab\n\nc\n\nd"
    inside = '<article><header><h1>T</h1></header><p>text</p><div class="ad-slot">buy</div><p class="ad">buy</p><div class="share-buttons">s</div><section id="comments"><p>c</p></section><div role="navigation">n</div><div hidden>h</div></article>'
    assert whole(inside) == "T\n\ntext"
    outside = '<div class="site-header">h</div><div class="cookie-notice">c</div><div class="side"><p>s</p></div><div class="story"><div class="story-header"><h1>T</h1></div><p>The text of the story.</p></div><a class="skip">k</a>'
    assert whole(outside) == "T\n\nThe text of the story."


def test_html_of_great_depth_takes_little_memory_and_time():
    started = time.perf_counter()
    tracemalloc.start()
    assert whole("<div>" * 100_000 + "deep") == "deep"
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    assert whole("<b>" * 20_000 + "x" + "</i>" * 20_000) == "x"
    assert whole("<p>" * 20_000 + "y" + "</div>" * 20_000) == "y"
    assert time.perf_counter() - started < 30


def test_html_survives_odd_markup():
    for source in ("<", "<<<p>a", '<a href="x>y', "</div></p>", "<p " * 2000, '<p a="' * 2000, "<div>" * 3000 + "deep", "<!--", "<script>", "a<b", "<!>", "</>", "<svg", "<title"):
        assert isinstance(whole(source), str)
    assert whole("<script>var a = '</p>';</script><p>x") == "x" and whole("a &amp; b &#233;") == "a & b é"


def brute_matches(a, b):
    """Longest common subsequence of two word lists."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
    return row[-1]


def test_alignment_agrees_with_the_full_one(rng):
    for _ in range(200):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randint(0, 1)] = [rng.choice("xyz")] * rng.randint(0, 1)
        n, first, last = licenses.align(a, b, 0, band=20)
        assert n == brute_matches(a, b)
        if n:
            assert brute_matches(a, b[first : last + 1]) == n


def test_license_scan(docs):
    mit = licenses.TEMPLATES["mit"]
    edited = mit.replace("free of charge", "for no money at all").replace("sublicense, ", "")
    rows = [(1, "words before. " + mit + " words after"), (2, edited), (3, "nothing here"), (4, None), (5, ""), (6, "x\nAll rights reserved.\ny"), (7, "Released under the MIT License."), (7, "Released under the MIT License."), (None, "İ released under the mit license")]
    got = licenses.scan(docs(rows)).collect()
    assert sorted((str(r.doc_id), r.license) for r in got) == sorted([("1", "mit"), ("2", "mit"), ("6", "all-rights-reserved"), ("7", "mit-notice"), ("7", "mit-notice"), ("None", "mit-notice")])
    one = next(r for r in got if r.doc_id == 1)
    assert one.coverage == 1 and rows[0][1][one.start_char : one.end_char] == mit.rstrip(".")
    assert 0.8 <= next(r for r in got if r.doc_id == 2).coverage < 1
    assert licenses.scan(docs([])).count() == 0


def test_winnowing_covers_each_window(rng):
    import numpy as np

    for _ in range(50):
        h = np.array([rng.randrange(20) for _ in range(rng.randint(1, 30))], np.uint64)
        places = licenses.winnow(h, 4)
        assert all(any(i <= p < i + 4 for p in places) for i in range(len(h) - 3))


def brute_occurrences(template, text):
    """(matched, first, end), from all spans by plain LCS: as many as fit by the earliest end, each the best of its place."""
    need, width = licenses.reach(template)
    spans = [(a, b, brute_matches(template, text[a:b])) for a in range(len(text)) for b in range(a + 1, min(len(text), a + width) + 1)]
    spans = [x for x in spans if x[2] >= need]
    least, end = [], 0
    while fit := [x for x in spans if x[0] >= end]:
        end = min(x[1] for x in fit)
        least.append(max(x[0] for x in fit if x[1] == end))
    out, low = [], 0
    for high in [*least[1:], len(text)] if least else []:
        n, _, a, b = max((n, a - b, -a, b) for a, b, n in spans if a >= low and b <= high)
        out.append((n, -a, b))
        low = b
    return out


def test_license_repeats_close_to_each_other(rng):
    spans = lambda text, s=licenses.Scanner(licenses.TEMPLATES): [(name, a, b) for name, _, a, b, _, _ in s.scan(text)]
    assert spans("All rights reserved. B All rights reserved.") == [("all-rights-reserved", 0, 3), ("all-rights-reserved", 4, 7)]
    for gap in range(8):
        text = (" x" * gap).join([" All rights reserved."] * 4)
        assert spans(text) == [("all-rights-reserved", k, k + 3) for k in range(0, 4 * (3 + gap), 3 + gap)]
        text = (" x" * gap).join([" Released under the MIT License."] * 4)
        assert spans(text) == [("mit-notice", k, k + 5) for k in range(0, 4 * (5 + gap), 5 + gap)]
    assert licenses.align(list("abc"), list("abcxabc"), 0, band=8) == (3, 4, 6)
    for _ in range(150):
        template = rng.choices("abcdefgh", k=rng.randint(3, 9))
        text = []
        for _ in range(rng.randint(1, 4)):
            text += [rng.choice("abcdefghxyz") if rng.random() < 0.1 else c for c in template if rng.random() > 0.05] + rng.choices("abxyz", k=rng.randint(0, 6))
        assert licenses.occurrences(template, text) == brute_occurrences(template, text)


def test_license_recall_on_edited_notices(rng):
    s = licenses.Scanner(licenses.TEMPLATES)
    spans = lambda text: [(name, a, b) for name, _, a, b, _, _ in s.scan(text)]
    assert ("apache-2.0-notice", 0, 6) in spans("Licensed under Apache License, Version 2.0")
    assert ("mit-notice", 1, 5) in spans("is Released under the MIT")
    for _ in range(150):
        text = rng.choices("the of license under this work version mit x y z".split(), k=rng.randint(0, 30))
        for w in rng.choices([w for w in s.words.values() if len(w) >= 5], k=2):
            edited = list(w)
            for k in rng.sample(range(len(w)), rng.randint(0, len(w) // 4)):
                edited[k] = rng.choice(["", "changed", "inserted " + w[k]])
            text += " ".join(edited).split() + rng.choices("the of license x y z".split(), k=rng.randint(0, 12))
        found = s.scan(" ".join(text))
        for name, w in s.words.items():
            full = licenses.occurrences(w, text)  # over the whole text, without candidates
            assert [(round(c * len(w)), a, b) for n, c, a, b, _, _ in found if n == name] == full
            assert all(brute_matches(w, text[a:b]) == n for n, a, b in full)
