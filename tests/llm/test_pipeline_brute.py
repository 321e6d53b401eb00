"""corpus_pipeline.run() against a plain Python version of its five stages, and recall of decontamination."""

import base64
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import tiktoken

import corpus_pipeline
from innsight.llm import decontaminate
from innsight.session import scratch_path
from tests.llm.helpers import classes, prose
from tests.llm.test_text import _edited, _near_links

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def _grams(words, n):
    return [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]


def _holds_an_item(text, items, n_items, df):
    words = _words(text)
    for item in items:
        own = _words(item)
        if not own or not words:
            continue
        n = min(5, len(own))
        bag = Counter(_grams(own, n))
        weight = {x: math.log(1 + n_items / df[x]) for x in bag}
        total = sum(weight[x] * c for x, c in bag.items())
        for s in range(max(1, len(words) - len(own) + 1)):
            window = Counter(_grams(words[s:s + len(own)], n))
            if sum(weight[x] * min(c, window[x]) for x, c in bag.items()) >= 0.8 * total:
                return True
    return False


def _brute_pipeline(docs, items):
    rows = [r for r in docs if any(c.isalpha() for c in r[1] or "")]                      # language ID
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(strip))
    holders = defaultdict(set)
    for d, t, *_ in rows:
        for line in t.split("\n"):
            holders[key(line)].add(d)
    rows = [(d, "\n".join(x for x in t.split("\n") if not (key(x) and len(holders[key(x)]) >= 10)), *rest)
            for d, t, *rest in rows]                                                      # line dedup
    root = classes(len(rows), _near_links([(d, t) for d, t, *_ in rows]))
    smallest = defaultdict(list)
    for i, c in enumerate(root):
        smallest[c].append(rows[i][0])
    rows = [r for i, r in enumerate(rows) if r[0] == min(smallest[root[i]])]              # near-dedup
    df = Counter(x for t in items for x in set(_grams(_words(t), max(1, min(5, len(_words(t)))))))
    rows = [r for r in rows if not _holds_an_item(r[1], items, len(items), df)]           # decontamination
    ranks = {base64.b64decode(a): int(b) for a, b in map(
        bytes.split, open(public_tokenizers.path(corpus_pipeline.RANKS), "rb").read().splitlines())}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for d, t, lang, source, _ in rows:                                                    # BPE
        ids = lib.encode_ordinary(t)
        out.append((d, lang, source, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out)


def test_run_equals_the_plain_version(spark):
    rng = random.Random(11)
    items = [prose(500 + i, 30) for i in range(12)] + ["four words of text", "", None]
    docs = []
    for i in range(60):
        docs.append([i, prose(i, 60 + i) + "\n" + prose(i + 200, 40)])
    for i in range(60, 90):                       # near and exact copies of earlier texts
        docs.append([i, _edited(docs[i - 60][1], 50, i) if i % 3 else docs[i % 7][1]])
    for i in range(90, 104):                      # a common line, in some spellings
        docs.append([i, rng.choice(["Common LINE here", "  common line here\t"]) + "\n" + prose(i + 900, 50)])
    docs += [[110 + i, "common line here"] for i in range(3)]
    for i in range(120, 132):                     # benchmark passages: whole, edited, cut in half, reworded
        p = items[i - 120].split()
        p = [p, p[:14] + ["new"] + p[15:], p[:15], p[::-1]][i % 4]
        docs.append([i, prose(i + 700, 25) + " " + " ".join(p) + " " + prose(i + 800, 25)])
    docs += [[140, None], [141, ""], [142, "12 34 !!"], [143, "x"], [144, "Four WORDS, of text"], [145, "ünï ßtr 日本語 " * 9],
             [146, "\n\n \n"], [147, prose(3, 4000)]]
    rows = [(d, t, rng.choice(["en", "de", None]), "s", len(t or "")) for d, t in docs]
    folder = scratch_path(spark, "small")
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, folder).collect())
    want = _brute_pipeline(rows, items)
    assert got == want
    kept = {r[0] for r in got}
    assert len(kept) < 105 and {143, 145, 147} <= kept and not {140, 141, 142, 146, 144} & kept


def test_decontamination_recall_on_shared_wording(spark):
    """Items that share a template, whose template half is reworded in the document: fingerprints within
    the radius find at least nine of ten pairs that an unlimited radius finds."""
    template = prose(900, 24)
    items = [(i, template + " " + prose(1000 + i, 26)) for i in range(200)]
    docs = []
    for i, t in items:
        w = t.split()
        for k in random.Random(i).sample(range(4, 22), 1 + i % 3):      # one to three words of the shared half change
            w[k] = f"other{k}"
        docs.append((i, prose(3000 + i, 30) + " " + " ".join(w) + " " + prose(4000 + i, 30)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    found, every = ({(r["doc_id"], r["item_id"]) for r in decontaminate.contamination(d, b, radius=radius)
                    .select("doc_id", "item_id").collect()} for radius in (23, 64))
    assert found <= every and len(every) >= 150
    recall = len(found) / len(every)
    print("recall", recall, len(every))
    assert recall >= 0.9
