"""Chat perspectives, license scan, line dedup and sharding against brute force."""

import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from innsight.llm import chat, licenses, line_dedup, sharding
from tests.llm.helpers import edge_docs, empty_docs, prose

TURNS = "conv_id long, turn long, role string, text string"


def _lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_every_participant_speaks_once_as_assistant(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None),
            (1, 2, "bob", None), (1, 3, None, "who?"), (1, 3, "ann", "a")]
    got = {r["participant"]: r for r in chat.rotate_perspectives(
        spark.createDataFrame(rows, TURNS).withColumn("part", F.lit("clash"))).collect()}
    assert set(got) == {"ann", "bob"}
    r = got["ann"]
    assert r["n_turns"] == 5 and r["n_target_turns"] == 2
    assert r["rendered"] == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n"
        "<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>user name=unknown\nwho?<|im_end|>\n"
        "<|im_start|>assistant\na<|im_end|>\n")
    # the mask covers the text, and its targets are the speaker's own bodies
    at, targets = 0, []
    for m in r["mask"]:
        if m["target"]:
            targets.append(r["rendered"][at:at + m["chars"]])
        at += m["chars"]
    assert at == len(r["rendered"])
    assert targets == ["hi < |im_end|><|im_end|>\n", "a<|im_end|>\n"]


def test_parts_of_a_long_dialogue_join_to_the_whole(spark):
    rows = [(5, t, ["ann", "bob"][t % 2], f"turn {t}") for t in range(23)]
    whole = chat.rotate_perspectives(spark.createDataFrame(rows, TURNS)).collect()
    parts = chat.rotate_perspectives(spark.createDataFrame(rows, TURNS), part_turns=4).collect()
    for w in whole:
        mine = sorted((p["part"], p["rendered"]) for p in parts if p["participant"] == w["participant"])
        assert "".join(t for _, t in mine) == w["rendered"] and len(mine) == 6


def test_dialogues_are_whole_whatever_their_turn_numbers(spark):
    rows = [(1, t * 1000, ["ann", "bob"][i % 2], f"turn {i}") for i, t in enumerate([0, 1, 2, 7, 10**9])]
    rows += [(2, -5, "cid", "before"), (2, 0, "dot", "zero")]
    rows += [(9, t, f"p{t % 3}", "x" * (t % 7)) for t in range(1500)]         # a hot conversation
    got = chat.rotate_perspectives(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted((r["conv_id"], r["participant"], r["n_turns"], r["part"]) for r in got) == [
        (1, "ann", 5, 0), (1, "bob", 5, 0), (2, "cid", 2, 0), (2, "dot", 2, 0),
        (9, "p0", 1500, 0), (9, "p1", 1500, 0), (9, "p2", 1500, 0)]
    parts = chat.rotate_perspectives(spark.createDataFrame(rows, TURNS), part_turns=2).filter("conv_id = 1").collect()
    assert sorted((r["participant"], r["part"], r["n_turns"]) for r in parts) == [
        (p, i, n) for p in ("ann", "bob") for i, n in ((0, 2), (1, 2), (2, 1))]


def test_turns_without_place_stand_alone_and_empty_table(spark):
    rows = [(None, 0, "ann", "x"), (None, 0, "bob", "y"), (3, None, "ann", "z"), (4, 0, "system", "only")]
    got = chat.rotate_perspectives(spark.createDataFrame(rows, TURNS)).collect()
    assert sorted((r["conv_id"] or 0, r["participant"], r["n_turns"], r["part"]) for r in got) == [
        (0, "ann", 1, -1), (0, "bob", 1, -1), (3, "ann", 1, -1)]
    assert chat.rotate_perspectives(spark.createDataFrame([], TURNS)).count() == 0


def _phrases(text):
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text)) if w]
    hits = []
    for label, phrase in licenses.PHRASES:
        p = phrase.split()
        hits += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return len(words), hits


def test_license_base_counts(spark):
    texts = ["MIT License mit-license MIT  LICENSES", "x general public license, General Public License",
             "the apache license. gnu general public general public license mit license", "mit", "license mit"]
    extra = spark.createDataFrame([(100 + i, t, "en", "s", 1) for i, t in enumerate(texts)],
                                  "doc_id long, text string, lang string, source string, n_chars long")
    docs = edge_docs(spark).select(*extra.columns).unionByName(extra).unionByName(extra.limit(1))
    got = licenses.label_documents(docs).collect()
    want = Counter()
    for d in docs.collect():
        n, hits = _phrases(d["text"])
        at = [i for i, _ in hits]
        want[(d["doc_id"], n, len(at), min(at, default=None), max(at, default=None),
              ",".join(sorted({x for _, x in hits})))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])
                   for r in got) == want
    assert all(set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) for r in got)
    assert licenses.label_documents(empty_docs(spark)).count() == 0


def test_license_notice_survives_an_inserted_word(spark):
    notice = licenses.NOTICES[0][1].split()
    changed = " ".join(notice[:8] + ["really"] + notice[8:])
    rows = [(1, prose(1) + " " + " ".join(notice)), (2, prose(2) + " " + changed), (3, " ".join(notice[:8])),
            (4, prose(4))]
    got = {r["doc_id"]: r for r in licenses.label_documents(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["labels"] for i in (1, 2, 3, 4)] == ["mit", "mit", "", ""]
    assert got[1]["score"] == 1.0 and 0.8 <= got[2]["score"] < 1.0 and got[4]["score"] == 0.0


def test_license_notice_survives_an_edit_at_every_place(spark):
    rows, want = [], {}

    def add(words, label, found):
        rows.append((len(rows), " ".join([prose(len(rows), 5), *words, prose(len(rows), 3)])))
        want[rows[-1][0]] = (label, found)
    for t in licenses.templates():
        if not t["slack"]:
            continue
        words, grams = t["words"], t["grams"]
        for i in range(1, len(words)):
            add(words[:i] + ["really"] + words[i:], t["label"], (grams - 1) / grams >= 0.8)
        for i in range(len(words)):
            lost = 1 if i in (0, len(words) - 1) else 2
            add(words[:i] + words[i + 1:], t["label"], (grams - lost) / grams >= 0.8)
    isc = dict(licenses.NOTICES)["isc"].replace("and or distribute", "and distribute").split()
    add(isc, "isc", True)
    # common words of the notice before and after it make one long run of neighbouring diagonals
    mit = licenses.NOTICES[1][1].split()
    add(["the", "software"] * 30 + mit[:4] + ["really"] + mit[4:] + ["the", "software"] * 30, "mit", True)
    got = {r["doc_id"]: r["labels"].split(",") for r in licenses.label_documents(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found for _, found in want.values()) > 300
    assert [i for i, (label, found) in want.items() if found and label not in got[i]] == []


def _line_dedup(docs, min_docs, min_chars=1):
    key = lambda x: _lower(x.strip(" \t\n\x0b\x0c\r"))
    seen = Counter()
    for _, t in docs:
        seen.update({key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or seen[key(x)] < min_docs]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


def test_license_repeated_word_pairs_end_before_any_row_is_exploded(spark):
    """A word pair of a template, repeated, makes a long run of diagonals that never holds the notice."""
    notice = dict((label, p) for label, p in licenses.NOTICES)["gpl"]
    rows = [(i, "of the " * 300 + "of") for i in range(20)]
    rows += [(100, "of the " * 200 + notice + " of the" * 200), (101, "free software " * 150 + notice)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.label_documents(df).collect()}
    assert all(got[i]["labels"] == "" for i in range(20))
    assert got[100]["labels"] == "gpl" and got[101]["labels"] == "gpl"
    spans = {r["doc_id"]: r["spans"] for r in licenses.scan(df).collect()}
    n = len(notice.split())
    long = max((s["coverage"], s["last"] - s["first"] + 1) for s in spans[100])
    assert long[0] == 1.0 and long[1] <= n + 6
    # what is left behind the filter on distinct positions: only the rows with the notice
    plan = licenses.scan(df.filter("doc_id < 100"))._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_count" in plan and "collect_set" not in plan
    assert licenses.scan(df.filter("doc_id < 100")).filter("size(spans) > 0").count() == 0


def test_line_dedup_matches_brute_force(spark):
    rows = [(i, "\n".join(["Shared  line ", f"own {i}", "\tshared  LINE\r", "", ["rare", "common\u0085"][i % 2]]))
            for i in range(24)]
    rows += [(100, None), (101, ""), (None, "shared  line\nx"), (102, "É\né\n\n"), (7, "again\nagain"),
             (7, "again\nagain")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    for min_docs, batches, fanout, heavy in ((10, 4, 2, 4000), (13, 3, 3, 2), (2, 5, 2, 1)):
        got = line_dedup.dedup_lines(docs, min_docs=min_docs, batches=batches, fanout=fanout, heavy_keys=heavy)
        assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()) \
            == _line_dedup(rows, min_docs)


def test_line_dedup_edges(spark):
    docs = edge_docs(spark)
    got = line_dedup.dedup_lines(docs)
    assert "bucket" in got.columns and got.columns.count("n_lines") == 1
    want = _line_dedup([(r["doc_id"], r["text"]) for r in docs.collect()], 10)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()) == want
    assert line_dedup.dedup_lines(empty_docs(spark)).count() == 0


def test_line_runs_are_compacted_in_levels(spark):
    runs = line_dedup.LineRuns(spark, min_docs=3, fanout=2)
    for b in range(5):
        runs.add(spark.createDataFrame([(1, 1, 1), (2, 2, 1), (b + 10, 0, 1)], line_dedup.RUN))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert {(r["h1"]) for r in runs.finish().collect()} == {1, 2}


def test_later_documents_are_added_to_the_runs_of_earlier_ones(spark):
    from innsight.session import scratch_path
    folder = scratch_path(spark, "kept-runs")
    first = [(i, f"common line\nown {i}\n{'twice' if i < 2 else i}") for i in range(6)]
    later = [(100 + i, f"Common LINE\nnew {i}\n{'twice' if i == 0 else 'later'}") for i in range(5)]
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    a = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(docs(first), min_docs=3, runs=folder).collect()}
    assert set(a.values()) == {1}
    b = {r["doc_id"]: r["kept_text"] for r in line_dedup.dedup_lines(docs(later), min_docs=3, runs=folder).collect()}
    # "twice" is in two earlier documents and a later one
    assert b == {100: "new 0", 101: "new 1", 102: "new 2", 103: "new 3", 104: "new 4"}
    alone = line_dedup.dedup_lines(docs(later), min_docs=3).filter("doc_id = 100").first()
    assert alone["kept_text"] == "new 0\ntwice"
    # a batch that broke off leaves files that no manifest names
    runs = line_dedup.LineRuns.open(spark, folder, 3)
    runs._write(spark.createDataFrame([(5, 5, 9)], line_dedup.RUN), "run")
    again = line_dedup.LineRuns.open(spark, folder, 3)
    assert again.levels == runs.levels and again.settled == runs.settled
    assert line_dedup.dedup_lines(docs([]), min_docs=3, runs=folder).count() == 0


def _check_shards(rows, got, n_shards):
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    total, largest = sum(size(t) for _, t in rows), max(size(t) for _, t in rows)
    for s in range(n_shards):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - total / n_shards) <= largest


def test_shards_are_even_also_with_a_hot_key(spark):
    rows = [(i, "x" * (i * 37 % 211)) for i in range(3000)]
    rows += [(77, "hot")] * 2000 + [(None, "nobody")] * 300 + [(-5, None), (2**62, "far")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("clash"))
    got = sharding.shard_by_bytes(docs, 16, min_ranges=32).collect()
    _check_shards(rows, got, 16)


def test_shards_depend_on_the_rows_alone(spark):
    rows = [(7, prose(i, 12)) for i in range(900)] + [(i, prose(i)) for i in range(2000, 2150)]
    rows += [(7, "same")] * 300 + [(None, "x")] * 40 + [(3, "big " * 30_000)]     # a hot key, equal rows, a large record
    got = []
    for parts in (3, 7):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        r = sharding.shard_by_bytes(df, 16, range_bytes=4000, min_ranges=8).collect()
        assert len(r) == len(rows)
        got.append(sorted(((x["doc_id"] or -1, x["text_crc32"], x["size"], x["shard"], x["slot"]) for x in r)))
    assert got[0] == got[1]
    slots = Counter((s, i) for *_, s, i in got[0])
    assert set(slots.values()) == {1}
    total = sum(x[2] for x in got[0])
    sizes = Counter()
    for _, _, size, shard, _ in got[0]:
        sizes[shard] += size
    assert max(sizes.values()) <= total / 16 + 2 * 120_001 and set(sizes) <= set(range(16))


def test_shards_edges(spark):
    docs = edge_docs(spark)
    _check_shards([(r["doc_id"], r["text"]) for r in docs.collect()], sharding.shard_by_bytes(docs, 4).collect(), 4)
    assert sharding.shard_by_bytes(empty_docs(spark), 4).count() == 0
