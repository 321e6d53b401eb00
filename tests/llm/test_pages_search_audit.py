"""Page differencing, ball-tree search and the filter audit against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from innsight.llm import ball_tree, filter_audit, page_diff
from innsight.llm import html_text as ht
from tests.llm.helpers import LONG, edge_docs, empty_docs, prose

PAGES = "page_id long, url string, html string"


def _texts(page):
    return [t for t, s in ht.blocks(page) if s != ht.FURNITURE]


def test_blocks_of_a_page():
    page = ('<html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head>'
            '<body class="has-sidebar"><nav><ul><li><a>Home</a></ul></nav><!-- <p>ad</p> -->'
            '<div class="cookie-notice">We use</div><header><h2>Site</h2></header>'
            '<article class="post"><header><h1>Title &amp; more</h1></header>'
            '<p>A &lt; b<span class="share"> tweet</span>\n c<p><b>unclosed<br>next line'
            '<ul><li>x<li>y</ul><form>name<textarea><p>z</textarea></form><p>cut &am</article>'
            '<section id="comments"><article><p>me too</article></section><footer>&copy; host</footer>')
    assert _texts(page) == ["Title & more", "A < b c", "unclosed next line", "x", "y", "cut &am"]


def test_broken_pages():
    assert _texts("plain text, 1 < 2 & 3 > 2") == ["plain text, 1 < 2 & 3 > 2"]
    assert _texts("<p>cut <b") == ["cut"]
    assert _texts("</div></p><p>a</i></section>b") == ["a", "b"]
    assert _texts('<p title="x > y">in<p>out') == ["in", "out"]
    assert _texts("<script>never closed <p>x") == []
    assert _texts("") == [] and _texts(" \n ") == []


def test_attributes_that_name_furniture():
    keep = ['title="hidden ad menu"', 'data-id="menu"', "class='post no-sidebar'", 'class="reading download"', "id=main",
            'class="content-with-comments"', 'alt="a > b" lang=en', "class=\'\'"]
    drop = ["hidden", 'class="x AD"', "id='cookie-bar'", 'role="navigation"', 'aria-hidden="true"', "class=sidebar",
            'style="color:red; display: none"', 'data-x="1" class="share-buttons"', 'class="site-header"']
    for a in keep:
        assert _texts(f"<div {a}>text</div><p>after") == ["text", "after"], a
    for a in drop:
        assert _texts(f"<div {a}>text</div><p>after") == ["after"], a
    assert _texts('<article><div class="entry-header"><h1>T</h1></div></article>') == ["T"]


def _lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(5)
    for _ in range(400):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(15))] for _ in range(2))
        m = page_diff.shared_lines(a, b)
        assert len(m) == _lcs(a, b) and all(a[i] == b[j] for i, j in m)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(m, m[1:]))


def _page(i, body, extra=""):
    return f"<body><div><p>Welcome to our site</p><p>Menu of all</p></div><div>{body}</div>{extra}<div><p>The end</p></div>"


def _site(n=150):
    """A host whose furniture only differencing can tell, copies of one page in it, and other hosts."""
    rows = [(i, f"http://a.example/x/{i:04d}?q=1", _page(i, f"<p>{prose(i)}</p><p>{prose(i + 1000)}</p>"))
            for i in range(n)]
    copy = "<article><p>" + prose(77) + "</p><p>" + prose(78) + "</p></article>"
    rows += [(1000 + i, f"http://b.example/{i}.html", copy) for i in range(12)]
    rows += [(2000, "http://c.example/", "<p>alone</p>"), (2001, None, "<p>no url</p>"), (2002, "http://d.example/", None),
             (2003, "nonsense", ""), (None, "http://a.example/x/0003", "<p>Welcome to our site</p><p>own words</p>"),
             (5, "http://a.example/x/0005?q=1", rows[5][2])]
    return rows


def _brute_main(rows):
    """Texts by comparing every page with its neighbours in a plain sorted list."""
    def place(url):
        m = re.match(r"(?:[A-Za-z][\w+.-]*:)?//([^/?#]+)([^?#]*)", url or "")
        return (m[1].lower(), re.sub(r"(\.[A-Za-z]{3,5})?/*$", "", m[2])) if m else None
    hosts = defaultdict(set)
    for r in rows:
        if place(r[1]) and list(ht.blocks(r[2] or "")):
            hosts[place(r[1])[0]].add(r)
    out = {}
    for r in rows:
        found = list(ht.blocks(r[2] or ""))
        gone = set()
        if place(r[1]) and found:
            ordered = sorted(hosts[place(r[1])[0]], key=lambda x: (place(x[1]), x[0] is None, x[0] or 0))
            at = ordered.index(r)
            near = [ordered[j] for j in (at - 2, at - 1, at + 1, at + 2) if 0 <= j < len(ordered)]
            votes, voters = Counter(), 0
            for other in near:
                theirs = list(ht.blocks(other[2]))
                hit = [i for i, _ in page_diff.shared_lines([t for t, _ in found], [t for t, _ in theirs])]
                size = lambda b: sum(len(t) for t, s in b if s != ht.FURNITURE)
                if size([found[i] for i in hit]) * 2 > max(size(found), size(theirs)):
                    continue
                voters += 1
                votes.update(hit)
            article = any(s == ht.ARTICLE for _, s in found)
            for i, n in votes.items():
                if found[i][1] == ht.OUTSIDE and n >= (1 if article else max(1, math.ceil(voters / 2))) \
                        or found[i][1] == ht.ARTICLE and n == voters >= 3:
                    gone.add(i)
        out[r] = "\n\n".join(t for i, (t, s) in enumerate(found) if s != ht.FURNITURE and i not in gone)
    return out


def test_differencing_deletes_shared_lines_and_spares_copies(spark):
    rows = _site()
    df = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash")).withColumn("k1", F.lit(1))
    got = page_diff.extract_main_text(df)
    assert got.columns == ["page_id", "url", "html", "k1", "text", "n_chars", "n_shared"]
    want = _brute_main(rows)
    got = got.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["text"] == want[(r["page_id"], r["url"], r["html"])], r["url"]
        assert r["n_chars"] == len(r["text"])
    by_id = {r["page_id"]: r["text"] for r in got}
    assert by_id[7] == prose(7) + "\n\n" + prose(1007)                # furniture gone, text kept
    assert by_id[1003] == prose(77) + "\n\n" + prose(78)              # copies don't delete each other
    assert by_id[2002] == "" and by_id[2001] == "no url" and by_id[None] == "own words"
    assert sum(r["page_id"] == 5 for r in got) == 2


def test_pages_do_not_depend_on_partitions_and_may_be_long(spark):
    long = "<article>" + "".join(f"<p>{LONG[i:i + 90]}</p>" for i in range(0, len(LONG), 90)) + "</article>"
    rows = _site(40) + [(3000, "http://a.example/x/0007/a", long), (3001, "http://a.example/x/0007/b", long + "<p>tail")]
    a, b = (sorted((r["page_id"] or -1, r["text"]) for r in page_diff.extract_main_text(
        spark.createDataFrame(rows, PAGES).repartition(n)).collect()) for n in (3, 7))
    assert a == b
    assert page_diff.extract_main_text(spark.createDataFrame([], PAGES)).count() == 0


def _terms(text):
    fold = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", fold) if w]


def _brute_search(docs, items, k):
    counts = [(d, Counter(_terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(_terms(t))
    out = []
    for i, ws in asked.items():
        scored = []
        for d, c in counts:
            m = 100 - 90 + 90 * c.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m))
                    for w in ws if w in c)
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(i, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=lambda r: (r[0] is None, r))


def test_search_equals_brute_force(spark):
    docs = [(i, prose(i, 40 + i % 50, 60)) for i in range(300)]
    docs += [(1000 + i, prose(4, 40, 60)) for i in range(30)] + [(None, prose(4, 40, 60)), (None, None), (7, ""), (7, "ÄÖ x")]
    docs += [(2000, LONG), (5, prose(5, 45, 60)), (5, prose(5, 45, 60))]
    items = [(i, prose(i + 50, 25, 60)) for i in range(25)] + [(90, prose(4, 40, 60)), (90, "Extra Words"), (91, None),
                                                              (92, "nothing of this, ever"), (93, "äö ÄÖ"), (None, "word1x1 an")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    want = _brute_search(docs, items, 10)
    for kw in ({}, {"block_docs": 40, "leaf": 4}, {"block_items": 7, "block_docs": 300, "leaf": 1}):
        got = [tuple(r) for r in ball_tree.search(d, q, 10, **kw).collect()]
        assert sorted(got, key=lambda r: (r[0] is None, r)) == want, kw
    assert ball_tree.search(empty_docs(spark), q).count() == 0
    assert ball_tree.search(d, q.limit(0)).count() == 0


def test_tree_prunes_and_bounds_hold():
    rng = np.random.default_rng(3)
    n, v = 2000, 300
    rows = [np.sort(rng.choice(30, 8, replace=False)) + 30 * (i % 10) for i in range(n)]
    off = np.arange(n + 1) * 8
    term, value = np.concatenate(rows), rng.integers(1, 10**9, n * 8)
    items = [np.sort(rng.choice(30, 12, replace=False)) + 30 * i for i in range(10)]
    tree = ball_tree.BallTree(np.arange(n), off, term, value, items, v, leaf=16)
    for q, item in enumerate(items):
        exact = np.add.reduceat(np.where(np.isin(tree.term, item), tree.value, 0), tree.off[:-1])
        for node, (lo, hi) in enumerate(tree.range):
            assert tree.bounds[node, q] >= exact[lo:hi].max()
    best = []
    tree.search(0, best, 5)
    assert tree.opened < sum(c is None for c in tree.child) / 2      # subtrees of other topics are never opened
    exact = np.add.reduceat(np.where(np.isin(term, items[0]), value, 0), off[:-1])
    assert sorted(best, reverse=True) == sorted(((int(s), -i) for i, s in enumerate(exact)), reverse=True)[:5]


def test_long_text_is_counted_in_pieces():
    text = ("ÄB c-" * 500_000).encode()
    assert ball_tree.term_counts(text) == {"Äb".encode(): 500_000, b"c": 500_000}


def _brute_audit(docs, labels):
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[i] == 1} for i in (0, 1))
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    fails = []
    for d, t, lang in docs:
        t = t or ""
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        f = set()
        f |= {"A"} if len(ws) < 100 else set()
        f |= {"B"} if 100 * len(set(ws)) < 80 * len(ws) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t) else set()
        f |= {"D"} if re.search("[#$%&*|]", t) else set()
        f |= {"E"} if d is not None and d > first[t] else set()
        fails.append((lang or "", f, d in good, d in toxic))
    out = {}
    for part in {p for p, *_ in fails}:
        mine = [x[1:] for x in fails if x[0] == part]
        shapley = Counter()
        for o in permutations("ABCDE"):
            for i, f in enumerate(o):
                alive = [x for x in mine if not x[0] & set(o[:i])]
                gone = [x for x in alive if f in x[0]]
                shapley[f] += len(gone)
                out[part, "".join(o), i + 1] = [
                    len(alive) - len(gone), len(gone), sum(f in x[0] for x in mine) - len(gone),
                    sum(x[0] == {f} for x in mine), sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for (p, o, i), v in out.items():
            if p == part:
                v.append(shapley[o[i - 1]])
    return out


def test_audit_equals_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(120))
    docs = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long, "de"), (None, long, "en"), (None, None, None),
            (4, None, "en"), (5, "", "de"), (6, "SHOUT & MORE", "en"), (7, "a " * 150, None), (8, LONG, "en"),
            (9, "#" + long, "de"), (9, "x", "de"), (10, prose(1, 150), "en"), (11, long + " A" * 40, "")]
    docs += [(100 + i, prose(2, 130), "en") for i in range(20)]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, 1, 1), (4, None, 1), (None, 1, 1), (9, 1, 0), (105, 1, 1), (100, 1, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("mask", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS + ["shapley"]]
           for r in filter_audit.interaction_audit(d.repartition(4), lab).collect()}
    assert got == _brute_audit(docs, labels)
    assert len(got) == 3 * 600
    every = filter_audit.interaction_audit(edge_docs(spark), lab)
    assert every.agg(F.max("kept")).first()[0] > 0
    assert filter_audit.interaction_audit(empty_docs(spark), lab).count() == 0
    assert filter_audit.interaction_audit(d, lab.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
