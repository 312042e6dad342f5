import itertools
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Row

from silterra.llm import htmltemplate as ht


def site(host, n, rng, items=True):
    pages = []
    for i in range(n):
        word = lambda k: " ".join(f"w{x}" for x in rng.integers(0, 10_000, k))  # noqa: B023, E731
        title, body = word(3), [word(int(rng.integers(9, 40))) for _ in range(int(rng.integers(1, 4)))]
        prices = [str(p) for p in rng.integers(10_000, 99_999, int(rng.integers(2, 5)))] if items else []
        html = (
            f"<html><head><title>{title}</title><script>var x = '</p>';</script></head><body><div class='top'>Home About {host}</div><h1>{title}</h1><div id=main>"
            + "".join(f"<p>{p}<br>" for p in body)
            + "</div><ul>" + "".join(f"<li class=o>Price: <i>{p}</i> EUR</li>" for p in prices) + "</ul>"
            + "<footer>This notice is long enough to be one token of its own on all pages.</footer></body></html>"
        )
        pages.append((html, title, body, prices))
    return pages


def brute_classes(pages):
    """Token -> vector, by counting every page."""
    vectors = defaultdict(lambda: [0] * len(pages))
    for i, p in enumerate(pages):
        for t, n in Counter(t for t, _ in ht.tokens(p)).items():
            vectors[t][i] = n
    groups = defaultdict(set)
    for t, v in vectors.items():
        if sum(x > 0 for x in v) >= max(ht.PAGES, ht.SUPPORT * len(pages)):
            groups[tuple(v)].add(t)
    return {v: g for v, g in groups.items() if len(g) >= 2}


def test_classes_equal_brute_force_and_slots_are_the_data(spark):
    rng = np.random.default_rng(0)
    sites = {h: site(h, n, rng) for h, n in (("a.example.com", 30), ("b.example.com", 6), ("c.example.com", 2))}
    rows, i = [], 0
    truth = {}
    for h, pages in sites.items():
        for p in pages:
            rows.append((i, f"https://{h}/p/{i}", p[0]))
            truth[i] = (h, *p[1:])
            i += 1
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = ht.deduce(frame.selectExpr("regexp_extract(url, '//([^/]+)', 1) as host", "page_id", "html")).collect()
    for h in ("a.example.com", "b.example.com"):
        classes = brute_classes([p[0] for p in sites[h]])
        got = defaultdict(set)
        for r in found:
            if r.host == h:
                got[r.kind].add(r.token)
        root = max((v for v in classes if set(v) <= {0, 1}), key=lambda v: len(classes[v]) * sum(v))
        assert got[0] == {ht.key(t) for t in classes[root]}
        nested = {frozenset(ht.key(t) for t in g) for v, g in classes.items() if v != root and "Price:" in g}
        assert len(nested) == 1 and nested <= {frozenset(g) for g in got.values()}
    assert not any(r.host == "c.example.com" for r in found)
    for r in ht.extract(frame).collect():
        h, title, body, prices = truth[r.page_id]
        assert r.templated == (h != "c.example.com")
        if r.templated:
            assert [s.text for s in r.slots] == [title, title, *body, *prices]
            assert r.text == "\n".join(body)
        else:
            assert len(r.slots) == 1 and r.slots[0].slot == 0 and r.text == r.slots[0].text and "Home About" in r.text


def test_longest_run():
    rng = np.random.default_rng(1)
    for _ in range(60):
        x = list(rng.permutation(7))
        got = [x[i] for i in ht.longest(x)]
        assert got == sorted(got)
        assert len(got) == max(len(c) for n in range(8) for c in itertools.combinations(x, n) if list(c) == sorted(c))


def test_real_pages(spark, sf):
    pages = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet")
    got = {r.page_id: r for r in ht.extract(pages).collect()}
    assert len(got) == pages.count()
    share = []
    for p in pages.collect():
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)
        want = " ".join(ht.markup.unescape(re.sub(r"<[^>]*>", " ", article[1])).split()).split()[20:] if article else []
        if got[p.page_id].templated and len(want) > 40:
            have = Counter(got[p.page_id].text.split())
            share.append(sum((Counter(want) & have).values()) / len(want))
    assert np.mean(share) > 0.95


def test_awkward_rows(spark):
    long = "<p>" + "word " * 60_000 + "</p>"
    same = "<html><body><h1>same page</h1><p>x</p></body></html>"
    rows = [(1, "http://h.example.com/1", None), (2, "http://h.example.com/2", ""), (3, None, "<b>no host</b> at all <!-- c --> <"), (4, "odd", "plain &amp; text"), (5, "http://h.example.com/5", long), (None, "http://h.example.com/6", "<p>a</p>")]
    rows += [(7, "http://s.example.com/7", same)] * 5 + [(8, "http://S.example.com:80/8", same.replace("x", "<script>never closed"))]
    frame = spark.createDataFrame([Row(page_id=i, url=u, html=h, host="mine", token=1, slots=None) for i, u, h in rows], "page_id long, url string, html string, host string, token int, slots string")
    got = ht.extract(frame).collect()
    assert len(got) == 12
    by = {r.page_id: r for r in got}
    assert by[1].slots == [] and by[1].text == "" and by[1].main_slot is None and by[2].slots == []
    assert by[3].text == "no host at all <" and by[4].text == "plain & text"
    assert len(by[5].text.split()) == 60_000 and sum(r.page_id == 7 for r in got) == 5
    assert ht.extract(frame.limit(0)).count() == 0


def test_rare_layouts_of_a_large_host_keep_their_template(spark):
    """One common layout and eight rare ones, each on far less than a fifth of the pages; and authors, who aren't layout."""
    rng = np.random.default_rng(4)
    rows, truth = [], {}
    for kind, n in [(0, 240), *((k, 12) for k in range(1, 9))]:
        for _ in range(n):
            i = len(rows)
            body = " ".join(f"w{x}" for x in rng.integers(0, 10_000, 20))
            author = f"John{i % 40} Smith{i % 40}"
            html = f"<html><body><h1>Site</h1><div class=type{kind}><div class=l{kind}>Label{kind}</div>{body}<div class=k{kind}>By{kind}</div></div><div class=a>{author}</div><footer>End</footer></body></html>"
            rows.append((i, f"https://big.example.com/{i}", html))
            truth[i] = [body, author]
    got = ht.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: [s.text for s in r.slots] for r in got} == truth


def test_unclosed_marks_take_linear_time():
    import time

    from silterra.llm.langid import visible

    for bit in ("<a ", "<!--", "<script>", "<b><!-- <script>", "<!-- >", "</script>" + "<script "):
        page = "<p>x</p><!-- y -->" + bit * (1_000_000 // len(bit))
        began = time.process_time()
        ht.tokens(page)
        visible(page)
        assert time.process_time() - began < 4, bit


def test_pieces_are_those_of_one_regular_expression():
    from silterra.llm.markup import pieces

    one = re.compile(r"<!--.*?-->|<(script|style|noscript|template)\b.*?</\1\s*>|<(/?[a-zA-Z][^\s>/]*)([^>]*)>|<[!?][^>]*>|[^<]+|<", re.S | re.I)
    bits = ["<!--", "-->", "<script>", "</script >", "<style a>", "</STYLE>", "<a href=x>", "<b", "text &amp; more", "<", ">", "</p>", "<!doctype html>", "<template>", "<noscript>", "</noscript>", "  ", "<?x"]
    rng = np.random.default_rng(5)
    for _ in range(4000):
        page = "".join(rng.choice(bits, rng.integers(0, 14)))
        end = page.rfind(">") + 1
        want = [m.span() for m in one.finditer(page) if m.start() < end]
        rest = want[-1][1] if want else 0
        want += [(rest, len(page))] * (rest < len(page))
        assert [m.span() for m in pieces(page)] == want


def test_pages_joined_with_templates_by_host_have_the_same_slots(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = lambda: sorted(ht.extract(pages).collect(), key=lambda r: r.page_id)
    want = rows()
    monkeypatch.setattr(ht, "BROADCAST_TOKENS", 0)
    assert rows() == want
