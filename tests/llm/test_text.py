"""BPE, language ID, decontamination, near duplicates and substring dedup against brute force."""

import base64
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from innsight.llm import bpe, components, decontaminate, hash_exchange, language, near_dup, queries, substring
from innsight.llm import wordhash as wh
from innsight.llm.components import connected_components
from tests.llm.helpers import LONG, classes, edge_docs, empty_docs, prose

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)


def _library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _check_bpe(docs, **kw):
    lib = _library()
    got = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN, **kw), RANKS)
    rows = Counter((r["doc_id"], r["n_tokens"], tuple(np.frombuffer(r["ids"], "<u4").tolist()), bytes(r["decoded"]))
                   for r in got.collect())
    want = Counter()
    for r in docs.collect():
        ids = lib.encode_ordinary(r["text"] or "")
        want[(r["doc_id"], len(ids), tuple(ids), (r["text"] or "").encode())] += 1
    assert rows == want


def test_bpe_equals_the_library(spark):
    _check_bpe(edge_docs(spark))
    assert bpe.encode(empty_docs(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_stitches_chunks(spark):
    rng = random.Random(5)
    mixed = "".join(rng.choice([" ", "  ", "\n", "'re", "don't", "é", "日本", "12345", "!!", "word", "\t \n", "’"])
                    for _ in range(3000))
    texts = [LONG, mixed, "a" * 5000, " " * 3000 + "x", "x" * 700 + " y" * 900 + "z" * 1500 + " ok" * 400, mixed[::-1]]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1, mixed)], "doc_id long, text string")
    for chunk, overlap in ((500, 40), (997, 128), (64, 16)):
        _check_bpe(docs, chunk=chunk, overlap=overlap)


def test_pre_tokens_of_every_character_equal_the_library(spark):
    lib = _library()
    enc = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for lo in range(0, 0x30000, 0x400):
        t = "".join(f"a{chr(c)} {chr(c)}1" for c in range(lo, lo + 0x400) if not 0xD800 <= c < 0xE000)
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == lib.encode_ordinary(t), hex(lo)


def test_long_merges_equal_short_ones():
    ranks, _ = bpe._ranks(RANKS)
    for seed in range(60):
        rng = random.Random(seed)
        piece = bytes(rng.choice(b"abcde ") for _ in range(rng.randint(2, 60)))
        assert bpe._merge_long(piece, ranks) == bpe.merge(piece, ranks)


def test_language_id(spark):
    docs = edge_docs(spark)
    got = language.identify(docs).collect()
    for r in got:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and 0 <= r["score"] <= 1
    assert len(got) == docs.count()
    assert language.identify(empty_docs(spark)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = language.identify(docs).filter(language.held_out(F.col("doc_id"))).agg(
        F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r >= 0.98


def test_cross_parsing_counts_greedy_phrases():
    train = "banana bandana cabana"
    key = (("x", train),)
    symbol, n, _, _ = language._compiled(key)
    for text in ("banana", "cabanana", "zzz", "an ban cab", "n"):
        s = language._symbols(text.encode(), symbol)
        t = language._symbols(train.encode(), symbol)
        # greedy longest match, phrase by phrase; each step that can't go on starts a phrase
        known = {bytes(t[i:j]) for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        count, cur = 1, b""
        for c in s:
            nxt = cur + bytes([c])
            if nxt in known:
                cur = nxt
            else:
                count += 1
                cur = bytes([c]) if bytes([c]) in known else b""
        assert language.phrases([text.encode()], key)[0][0][0] == count


def test_lanes_do_not_cut_a_match():
    rng = random.Random(3)
    train = " ".join("".join(rng.choice("abcde") for _ in range(rng.randint(2, 7))) for _ in range(1200))
    key = (("x", train), ("y", train[::-1]))
    symbol, *_ = language._compiled(key)

    def greedy(text, corpus):
        nxt = language.suffix_automaton(language._symbols(corpus.encode(), symbol).tolist())
        s = language._symbols(text.encode(), symbol).tolist()
        count, state = 1 if s else 0, 0
        for c in s:
            count += c not in nxt[state]
            state = nxt[state][c] if c in nxt[state] else nxt[0].get(c, 0)
        return count
    texts = [train[100:3100], train[5:700] + "zzz" + train[900:3000], "", "a", train * 2, train[::-1][:2000],
             "".join(rng.choice("abcde ") for _ in range(5000)), train[40:40 + language.LANE], train[:language.LANE + 1]]
    got = language.phrases([t.encode() for t in texts], key)[0]
    assert got[0][0] == 1                          # 3,000 symbols of the training text are one phrase
    for j, t in enumerate(texts):
        assert [got[0][j], got[1][j]] == [greedy(t, c) for _, c in key]


def test_letters_beyond_250_are_symbols_of_their_own():
    rng = random.Random(5)
    chinese = [chr(0x4E00 + i) for i in range(3000)]
    text = "".join(rng.choice(chinese[:40] if rng.random() < 0.5 else chinese) for _ in range(4000))
    key = (("en", "the cat sat on the mat \u0130t"), ("zh", text))
    symbol, n, tables, _ = language._compiled(key)
    assert n > 1000 and all(isinstance(t, language.SparseTable) for t in tables)
    unseen = "".join(chr(0xAC00 + i) for i in range(120))       # a script that was never trained
    for t in (text[100:300], text[50:60] + "cat" + unseen[:5] + text[500:505], unseen, "the cats", text[::-1][:250],
              "".join(rng.choice(chinese) for _ in range(200))):
        s = language._symbols(t.encode(), symbol).tolist()
        got = language.phrases([t.encode()], key)[0][:, 0].tolist()
        for (_, train), n_phrases in zip(key, got, strict=True):
            own = ",".join(map(str, language._symbols(train.encode(), symbol).tolist())).join(",,")
            count, cur = 1, []
            for c in s:
                if f",{','.join(map(str, [*cur, c]))}," in own:
                    cur = [*cur, c]
                else:
                    count, cur = count + 1, [c] if f",{c}," in own else []
            assert n_phrases == count
    assert language.phrases([unseen.encode()], key)[0][:, 0].tolist() == [121, 121]


def test_dense_and_sparse_tables_parse_alike():
    rng = np.random.default_rng(2)
    train = rng.integers(0, 12, 3000).tolist()
    dense, sparse = language.parse_table(train, 13), language.SparseTable(train, 13)
    state, other = np.zeros(500, np.uint32), np.zeros(500, np.uint32)
    for _ in range(200):
        c = rng.integers(0, 13, 500).astype(np.uint32)
        state, other = dense.take(state * np.uint32(14) + c), sparse.step(other, c)
        assert (state == other).all()
        state, other = state & ~language.FLAG, other & ~language.FLAG


def _items(texts):
    return [(i, t) for i, t in enumerate(texts)]


def _containments(doc, item, weight):
    w, v = wh.hash_words([doc.lower().encode()], wh.ALNUM).h, wh.hash_words([item.lower().encode()], wh.ALNUM).h
    if not len(v) or not len(w):
        return 0.0
    n = min(5, len(v))
    g = Counter(wh.ngrams(v, n).tolist())
    total = sum(weight(x) * c for x, c in g.items())
    best = 0.0
    for s in range(max(1, len(w) - len(v) + 1)):
        have = Counter(wh.ngrams(w[s:s + len(v)], n).tolist())
        best = max(best, sum(weight(x) * min(c, have[x]) for x, c in g.items()) / total)
    return best


def test_decontamination_equals_brute_force(spark):
    items = _items([prose(50, 40), prose(51, 20), prose(52, 12), "only four words here", None, "", prose(50, 40)])
    p = prose(50, 40).split()
    swapped = " ".join(p[:20] + ["changed"] + p[21:])
    docs = [(1, prose(1) + " " + prose(50, 40) + " " + prose(2)), (2, prose(3) + " " + swapped),
            (3, prose(4)), (4, None), (5, " ".join(p[:15])), (6, "x only FOUR words, here y"), (7, prose(51, 20).upper()),
            (None, prose(52, 12)), (8, " ".join(p[::-1])), (9, prose(5) + " " + " ".join(p[:22] + ["in"] + p[22:]))]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contamination(d, b).collect()}
    rows = [(i, (t or "").lower().encode()) for i, t in items]
    of = decontaminate._weights(rows, len(items), 5)
    weight = lambda x: float(of(np.array([x], dtype=np.uint64))[0])
    want = {}
    for i, t in docs:
        for j, u in items:
            s = _containments(t or "", u or "", weight)
            if s >= 0.8:
                want[(i, j)] = s
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 1e-9 for k in got)
    # in blocks of two items the same pairs are found
    blocks = decontaminate.contamination(d, b, block_items=2).collect()
    assert {(r["doc_id"], r["item_id"]) for r in blocks} == set(want)
    assert decontaminate.contamination(empty_docs(spark), b).count() == 0
    assert decontaminate.contamination(d, b.limit(0)).count() == 0


def test_similarities_do_not_depend_on_the_blocks_of_the_benchmark(spark):
    template = prose(70, 14)
    items = [(i, template + " " + prose(100 + i, 12)) for i in range(30)]
    docs = [(i, prose(200 + i, 20) + " " + (" ".join(t.split()[2:]) if i % 2 else t) + " " + prose(300 + i, 9))
            for i, t in items]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    whole = {tuple(r) for r in decontaminate.contamination(d, b).collect()}
    assert len({r[0] for r in whole}) == 30 and {r[5] < 1 for r in whole} == {True, False}
    assert {tuple(r) for r in decontaminate.contamination(d, b, block_items=7).collect()} == whole


def test_multi_index_finds_everything_within_the_radius():
    rng = np.random.default_rng(3)
    rows = [(i, prose(i, 30).encode()) for i in range(50)]
    items = decontaminate.Items(rows, lambda g: np.ones(len(g)), 23, 5)
    for _ in range(300):
        p = int(items.fp[rng.integers(50)]) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 30), replace=False))
        near = {i for i, f in enumerate(items.fp.tolist()) if bin(f ^ p).count("1") <= 23}
        assert set(items.within_radius(p).tolist()) == near


def _edited(text, every, seed):
    rng = random.Random(seed)
    w = text.split()
    for i in range(rng.randrange(every), len(w), every):
        w[i] = f"edit{rng.randrange(10**6)}"
    return " ".join(w)


def _near_brute(docs, threshold=0.8):
    """Smallest id of the class of every id, on the words themselves."""
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    ids = sorted({i for i, _ in rows if i is not None})
    place = {x: i for i, x in enumerate(ids)}
    links = [(place[rows[a][0]], place[rows[b][0]]) for a, b in _near_links(rows, threshold)
             if rows[a][0] is not None and rows[b][0] is not None]
    return {ids[i]: ids[c] for i, c in enumerate(classes(len(ids), links))}


def test_near_duplicates_equal_brute_force(spark):
    rows, i = [], 0
    for base in range(12):
        text = prose(base, 150)
        for k in range(6):
            rows.append((1000 - i, _edited(text, [400, 60, 45, 30, 20][k % 5], i) if k else text))
            i += 1
    rows += [(2000 + j, rows[0][1]) for j in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _near_brute(docs)
    for block in (1000, 3):       # also with buckets cut into blocks of three documents
        got = near_dup.mark_near_duplicates(docs, block_docs=block).collect()
        assert {r["doc_id"]: r["class_id"] for r in got} == want
        assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got)


def _shingle_texts(text):
    words = re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower())
    return [tuple(words[i:i + 5]) for i in range(len(words) - 4)] or ([tuple(words)] if words else [])


def _near_links(rows, threshold=0.8):
    """Links by weights ln(1 + documents / document frequency), counted on the words themselves."""
    bags = [Counter(_shingle_texts(t)) for _, t in rows]
    df = Counter(x for b in bags for x in b)
    n = sum(map(bool, bags))
    vec = [{x: c * math.log(1 + n / df[x]) for x, c in b.items()} for b in bags]
    links = []
    for a in range(len(rows)):
        for b in range(a):
            shared = sum(min(v, vec[b][x]) for x, v in vec[a].items() if x in vec[b])
            if shared >= threshold * (sum(vec[a].values()) + sum(vec[b].values()) - shared) > 0:
                links.append((a, b))
    return links


def test_weights_are_of_exact_document_frequencies(spark):
    # 40 documents that are mostly one common passage, which weighs little, and groups of near copies
    passage = prose(900, 160)
    rows = [(i, passage + " " + prose(1000 + i, 14)) for i in range(40)]
    rows += [(100 + i, _edited(prose(2000 + i // 3, 150), 40 if i % 3 else 400, i)) for i in range(60)]
    rows += [(300, ""), (301, None), (302, "few words"), (303, "few words"), (302, "few words")]
    rows += [(None, prose(1, 20)), (None, prose(1, 20)), (310, prose(1000, 14))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _near_brute(docs)
    assert len(set(want.values())) < len(want)
    bags = [set(_shingle_texts(t or "")) for _, t in rows]
    df, n = Counter(x for b in bags for x in b), sum(map(bool, bags))
    total = {i: sum(c * math.log(1 + n / df[x]) for x, c in Counter(_shingle_texts(t or "")).items()) for i, t in rows}
    for chunk_bytes in (near_dup.CHUNK_BYTES, 100):      # texts in 64 chunks, and every text in one of its own
        sketches, copies = near_dup.document_sketches(
            docs.select(F.col("doc_id").alias("id"), F.lower("text").alias("text")).filter("text IS NOT NULL"),
            chunk_bytes=chunk_bytes)
        got = sketches.collect()
        assert {r["id"] for r in got} == {i for i, t in rows if t} - {None, 303}
        for r in got:
            assert math.isclose(r["total"], total[r["id"]])
            weights = Counter(round(math.log(1 + n / df[x]), 9) for x in _shingle_texts(dict(rows)[r["id"]]) if df[x] > 1)
            assert Counter(round(w, 9) for w in r["w"]) == weights
        assert [tuple(c) for c in copies.collect()] == [(303, 302)]
        marked = near_dup.mark_near_duplicates(docs, chunk_bytes=chunk_bytes).collect()
        assert {r["doc_id"]: r["class_id"] for r in marked if r["doc_id"] is not None} == want


def test_edited_copies_are_linked_in_large_groups(spark, tmp_path):
    # 150 copies of a text with one or two words changed, half of the changes copied on; and 40 texts that are mostly a passage
    rng, rows, base = random.Random(7), [], prose(3000, 150).split()
    edits = [(rng.randrange(10, 140), f"edit{i}") for i in range(200)]
    for i in range(150):
        w = list(base)
        for at, word in [edits[i // 2]] + ([edits[100 + i // 4]] if i % 3 == 0 else []):
            w[at] = word
        rows.append((i, " ".join(w)))
    passage = prose(900, 160)
    rows += [(1000 + i, passage + " " + prose(4000 + i, 14)) for i in range(40)]
    rows += [(2000 + i, prose(5000 + i, 40)) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["class_id"] for r in queries.QUERIES["op6_icws_near_dup"](spark, str(tmp_path)).collect()}
    assert {got[i] for i in range(150)} == {0}
    assert all(got[i] == i for i, _ in rows if i >= 1000)


@pytest.mark.parametrize("own, share", [([1, 1, 1, 1, 1], 1 / 5), ([0, 1, 1, 0, 1], 2 / 3), ([1] * 18, 14 / 18), ([0] * 4, 1)])
def test_runs_of_own_shingles_weigh_as_their_words(own, share):
    own = np.array(own, dtype=bool)
    less = near_dup._changed(own, np.full(len(own), 2.0), np.zeros(len(own), dtype=np.int64), 2)
    assert np.allclose(less, [2 * own.sum() * (1 - share) if own.any() else 0, 0])


def test_hashes_are_packed_and_unpacked():
    rng = np.random.default_rng(4)
    a = np.sort(rng.integers(0, 2**64, 1000, dtype=np.uint64))
    n = rng.integers(1, 2**40, 1000).astype(np.uint64)
    for k in (1, 2, 1000):
        got = hash_exchange.unpacked(hash_exchange.packed(np.diff(a[:k], prepend=np.uint64(0)), n[:k]), np.uint64, np.uint64)
        assert (np.cumsum(got[0], dtype=np.uint64) == a[:k]).all() and (got[1] == n[:k]).all()


def test_near_duplicate_edges(spark):
    docs = edge_docs(spark)
    got = near_dup.mark_near_duplicates(docs)
    assert got.columns.count("class_id") == 1 and "bucket" in got.columns
    rows = got.collect()
    assert len(rows) == docs.count()
    want = _near_brute(docs)
    assert all(r["class_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None) for r in rows)
    assert all(r["kept"] for r in rows if r["doc_id"] is None)
    assert {r["class_id"] for r in rows if r["doc_id"] in (2, 6)} == {2}
    assert near_dup.mark_near_duplicates(empty_docs(spark)).count() == 0


def test_both_texts_of_an_id_are_compared(spark):
    a, b = prose(50, 120), prose(51, 120)
    rows = [(1, a), (2, a), (2, b), (3, _edited(b, 100, 1)), (4, prose(52, 120))]   # 2 copies 1 and is near 3
    got = near_dup.mark_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_icws_agreement_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    h = np.sort(wh.mix(np.arange(1, 401, dtype=np.uint64)))
    w = rng.uniform(1, 10, 400)
    a, b = slice(0, 340), slice(60, 400)
    got = near_dup.icws_samples(np.concatenate([h[a], h[b]]), np.concatenate([w[a], w[b]]),
                                np.array([0, 340, 680]), 4000)
    true = w[60:340].sum() / w.sum()
    assert abs((got[:, 0] == got[:, 1]).mean() - true) < 0.03


@pytest.mark.parametrize("hub_edges", [components.HUB_EDGES, 10])
def test_components(spark, monkeypatch, hub_edges):
    monkeypatch.setattr(components, "HUB_EDGES", hub_edges)       # hubs joined by broadcast, too
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 430)]
    links += [(450, i) for i in range(451, 490)]                  # a hub
    want = classes(500, links)
    got = {r["id"]: r["component"] for r in connected_components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: want[i] for a, b in links if a != b for i in (a, b)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _substrings(docs, window):
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0))
    split = {k: [w.decode() for w in (docs[k][1] or "").encode().split()] for k in order}
    first, out = {}, []
    for k in order:
        for s in range(len(split[k]) - window + 1):
            first.setdefault(tuple(split[k][s:s + window]), (docs[k], s))
    # places of windows of each length: equal rows are one document, a later copy of a text takes no part
    one = {}
    for k in order:
        one.setdefault(docs[k][1] or "", k)
    longest, length = dict.fromkeys(one.values(), 0), window
    while True:
        places = defaultdict(set)
        for k in one.values():
            for s in range(len(split[k]) - length + 1):
                places[tuple(split[k][s:s + length])].add((k, s))
        again = {k for found in places.values() if len(found) > 1 for k, _ in found}
        if not again:
            break
        longest |= dict.fromkeys(again, length)
        length *= 2
    for k in order:
        w = split[k]
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s:s + window])] != (docs[k], s):
                gone.update(range(s, s + window))
        mine = one[docs[k][1] or ""]
        out.append((docs[k][0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone),
                    longest[mine] if docs[mine][0] == docs[k][0] else 0))
    return Counter(out)


def test_substring_dedup_equals_brute_force(spark):
    rng = random.Random(9)
    passages = [prose(300 + i, n).split() for i, n in enumerate((20, 21, 39, 60, 19, 81, 170))]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += prose(rng.randrange(10**6), rng.randint(1, 30)).split()
            if rng.random() < 0.6:
                words += rng.choice(passages)
        rows.append((i * 7 % 60, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(70, "is onhe " * 40), (71, "y " + "is onhe " * 33), (72, rows[5][1]), (73, rows[5][1]),
             (None, rows[6][1] + " tail"), (72, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash"))
    got = substring.dedup_substrings(docs, 20)
    want = _substrings(rows, 20)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"], r["longest_repeat"])
                   for r in got.collect()) == want
    assert {20, 40, 80, 160} <= {x[4] for x in want}       # the levels go on until none survive


def test_substring_edges(spark):
    docs = edge_docs(spark)
    got = substring.dedup_substrings(docs)
    rows = got.collect()
    assert len(rows) == docs.count() and got.columns.count("kept_text") == 1
    by = {r["doc_id"]: r for r in rows if r["doc_id"] not in (7, 8, None)}
    assert by[6]["n_removed"] == 60 and by[2]["n_removed"] == 0 and by[14]["n_removed"] == 120
    assert by[3]["n_words"] == 0 and by[9]["kept_text"] == ""
    assert all(r["n_removed"] == 0 for r in rows if r["doc_id"] in (7, 8))
    assert substring.dedup_substrings(empty_docs(spark)).count() == 0


def test_ngram_hashes_depend_on_the_words_only():
    a = wh.hash_words([b"alpha beta  gamma", b"x alpha beta gamma", b""], wh.NONSPACE)
    for n in (1, 2, 3):
        g = wh.ngrams(a.h, n)
        assert g[0] == g[4]
        assert len(set(g.tolist())) == len(g) - (4 - n)
    assert a.off.tolist() == [0, 3, 7, 7]
