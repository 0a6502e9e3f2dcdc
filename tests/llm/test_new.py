"""Page extraction, impact search and resampling against brute force."""

from __future__ import annotations

import hashlib
import html
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
from quillmend.llm import impact_search, line_resampling, site_templates

FOLDER = "/root/testdata/sf0.01"


def table(spark, name):
    return spark.read.parquet(f"{FOLDER}/{name}.parquet").collect()


# ---------------------------------------------------------------- pages

def test_pages_give_their_articles(spark):
    rows = {r.page_id: r for r in entry.queries()["op11_site_templates"](spark, FOLDER).collect()}
    pages = table(spark, "pages")
    assert len(rows) == len(pages)
    for page in pages:
        body = re.search(r"(?s)<article>(.*?)(?:</article>|$)", page.html).group(1)
        blocks = (" ".join(html.unescape(re.sub(r"</?(?:b|br)>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        expected = "\n".join(b for b in blocks if b)
        assert (rows[page.page_id].text, rows[page.page_id].n_chars, rows[page.page_id].url) == (expected, len(expected), page.url)


def test_markup_by_hand():
    text = lambda source: site_templates.main_text(source, {})[0]
    assert text("") == "" and text("<p>a<b>b</p>c <i>d") == "ab\nc d"
    assert text("1 < 2 &amp;&lt;b&gt; &eacute;&#x41;&nbsp;\n\t b<br>c <p") == "1 < 2 &<b> éA b c"
    assert text("<ul><li>one<li>two<ul><li>three</ul></ul><table><tr><td>a<td>b<tr><th>c</table>") == "one\ntwo\nthree\na b\nc"
    assert text("<p>x</p><nav>no</nav><header><h1>Site</h1></header><aside>no</aside><form>no</form><!-- no --><script>'</p>'</script><style>no</style>"
                "<div class='cookie-notice'>no</div><div id=sidebar-left>no</div><section class='post comments'>no</section><footer>no</footer>y") == "x\ny"
    assert text("<body class='has-sidebar'><div class='page sidebar-right'><main><h1>T</h1><p>not this</p><article><header><h2>S</h2></header>in"
                "<section id=comments><article class=comment>no</article></section></article></main></div>") == "T\nS\nin"
    assert text("<main>a<div class=share>no</div><p>b</main><p>no</p>") == "a\nb"
    assert text("<form id=aspnet><div><h1>T</h1>in<button>no</button></div></form>") == "T\nin"
    assert text("<div hidden>no</div><p style='display: none'>no</p><p data-id='menu'>yes</p><p title='a hidden menu'>too</p>") == "yes\ntoo"
    assert text("<ul><li><a href=1>One</a><li><a href=2>Two</a><li><a href=3>Three</a></ul><p>body <a>link</a>") == "body link"
    assert text("<div class='commentary'>yes</div>") == "yes"
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>" * 3000 + "end") == "deep\nend"


def test_templates_are_deleted_but_copies_stay(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(500)]
    said = lambda n: " ".join(rng.choices(words, k=n))
    copy = [said(30) for _ in range(4)]
    rows, expected = [], {}
    for k in range(90):
        blocks = copy if k % 3 == 0 else [said(20) for _ in range(4)]
        marks = "".join(f"<div class='x{b}'>{t}</div>" for b, t in enumerate(blocks))
        rows.append((k, "https://user@Big.example.org:80/x", f"<div><div>Welcome to us</div><div>Our long {'legal words ' * 30}</div></div>{marks}<div>Seen {k}</div><div>Call us</div>"))
        expected[k] = "\n".join([*blocks, f"Seen {k}"])
    rows += [(100 + k, f"http://small.example.org/{k}", f"<div>Welcome to us</div><p>{said(9)}</p>") for k in range(3)]
    rows += [(200, None, "<div>Welcome to us</div>"), (201, "no host", None), (202, "//big.example.org", ""), (202, "//big.example.org", "")]
    pages = spark.createDataFrame([(*r, "own", 7, "h") for r in rows], "page_id long, url string, html string, text string, c0 int, host string")
    got = site_templates.extract_pages(pages).collect()
    assert len(got) == len(rows) and got[0].c0 == 7 and got[0].host == "h"
    by = {r.page_id: r for r in got}
    assert {k: by[k].text for k in expected} == expected and by[0].n_templates == 2
    assert by[100].text.startswith("Welcome to us\n") and by[200].text == "Welcome to us" and by[201].text == "" and by[202].n_chars == 0
    assert site_templates.extract_pages(pages.limit(0)).count() == 0


# ---------------------------------------------------------------- search

def terms(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def ranking(docs, items, k=10):
    """Every document's score for every item, by definition."""
    cut = [(i, Counter(t), len(t)) for i, t in ((i, terms(x)) for i, x in docs) if t]
    big_n, big_l = len(cut), sum(n for _, _, n in cut)
    df = Counter(t for _, c, _ in cut for t in c)
    w = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * n + 1))) for t, n in df.items()}
    out = set()
    for item, text in items:
        scores = []
        for i, c, n in cut:
            m = 100 - 75 + (75 * n * big_n) // big_l
            s = sum(w[t] * ((10 ** 9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out |= {(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_search_equals_all_scores(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "documents")]
    items = [(r.item_id, r.text) for r in table(spark, "benchmark")]
    got = entry.queries()["op12_impact_search"](spark, FOLDER).collect()
    assert {(r.item_id, r["rank"], r.doc_id, r.score) for r in got} == ranking(docs, items)


@pytest.mark.parametrize("shard, group", [(7, 1 << 20), (10_000, 40)])
def test_search_in_shards_and_groups(spark, monkeypatch, shard, group):
    monkeypatch.setattr(impact_search, "SHARD_DOCS", shard)
    monkeypatch.setattr(impact_search, "ITEM_BYTES", group)
    monkeypatch.setattr(impact_search, "FIRST_DEPTH", 2)
    rng = random.Random(3)
    words = [f"W{int(rng.paretovariate(0.6)) % 60}" for _ in range(200)] + ["é", "x1"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 40)))) for k in range(150)]
    docs += [(500 + k, "same w1 w2, w3") for k in range(40)] + [(600, None), (601, ""), (602, "-!-"), (None, "same w1"), (None, "same w1"), (7, "w1 Same")]
    docs.append((700, "w1 rare " * 200_000))
    items = [(1, "w1 w2 W2 w3"), (2, "same"), (3, None), (4, ""), (5, "nothing here"), (6, "RARE é"), (7, "w1"), (8, " ".join(words))]
    given = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, item string, score int").repartition(5)
    asked = spark.createDataFrame([(i, t, 3) for i, t in [*items, items[0]]], "item_id long, text string, part int")
    got = impact_search.search(given, asked).collect()
    expected = ranking(docs, items)
    # Documents that repeat an id are told apart by nothing, so compare lists.
    assert sorted(map(str, ((r.item_id, r["rank"], r.doc_id, r.score) for r in got))) == sorted(map(str, expected))
    assert impact_search.search(given.limit(0), asked).count() == 0 and impact_search.search(given, asked.limit(0)).count() == 0


def test_intervals_close_before_the_lists_end():
    """Reading stops early where the best are far ahead, and on to the end where ties decide."""
    n = 20_000
    falling = np.arange(n, 0, -1)
    lists = [(np.arange(n), falling), (np.arange(n), falling)]
    found, scores, read = impact_search.resolve(lists, n, 10, 0)
    assert found.tolist()[:10] == list(range(10)) and scores[:10].tolist() == [2 * (n - k) for k in range(10)] and read < n
    even = [(np.arange(n), np.full(n, 5))]
    found, scores, read = impact_search.resolve(even, n, 10, 0)
    assert len(found) == n == read and set(scores.tolist()) == {5}


# ---------------------------------------------------------------- resampling

def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i:i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def drawn(docs, target, percent=5, least=20):
    cut = [(i, *features(t)) for i, t in docs]
    corpus = Counter(b for _, _, f in cut for b in f)
    aim = Counter(b for t in target for b in features(t)[1])
    s, t = sum(corpus.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + 10_000) / ((corpus[b] + 1) * (t + 10_000)))) for b in range(10_000)]
    rows = []
    for i, n, f in cut:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = k
    return sorted(str(tuple(r[:5])) for r in rows)


def shown(rows):
    return sorted(str((r.doc_id, r.n_features, r.weight, r.score, r["rank"])) for r in rows)


def test_resampling_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, "documents")]
    target = [r.text for r in table(spark, "benchmark")]
    assert shown(entry.queries()["op13_line_resampling"](spark, FOLDER).collect()) == drawn(docs, target)


def test_resampling_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(line_resampling, "PIECE_BYTES", 16)
    monkeypatch.setattr(line_resampling, "HELD_BYTES", 300)
    monkeypatch.setattr(line_resampling, "COMMON", 20)
    rng = random.Random(5)
    words = ["a", "B", "Ünï", "x1", "w_" * 9, "long" * 30, "z"]
    line = lambda: " ".join(rng.choices(words, k=rng.randrange(0, 30)))
    docs = [(k, "\n".join(["The same line", *(line() for _ in range(rng.randrange(0, 6)))])) for k in range(300)]
    docs += [(400, None), (401, ""), (402, "\n\n"), (403, "a\nb\nc\n\nd e\nf"), (None, "a b " * 20), (None, "a b " * 20), (5, docs[5][1]), (404, "one " * 20_000)]
    target = ["A b\nx1 z", None, ""]
    given = spark.createDataFrame([(i, t, "k", 2) for i, t in docs], "doc_id long, text string, key string, row int").repartition(4)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, id int")
    assert shown(line_resampling.resample(given, aim).collect()) == drawn(docs, target)
    assert shown(line_resampling.resample(given, aim.limit(0), percent=50).collect()) == drawn(docs, [], 50)
    assert line_resampling.resample(given.limit(0), aim).count() == 0


def test_checksums_of_joined_texts():
    parts = [(b"", b"x"), (b"abc", b""), (b"\xff" * 300, b"z" * 100_000), (b"1", b"22")]
    left, right = (np.array([zlib.crc32(p[k]) for p in parts], np.uint32) for k in (0, 1))
    got = line_resampling.joined(left, right, np.array([len(b) for _, b in parts]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in parts]
