"""Line, substring, near-duplicate, decontamination and quality operators against brute force on hostile tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from statloom.llm import decontam, graph, jaccard, kernel, linededup, quality, substring

from .helpers import corpus, frame, lower, sha, words


def lines_by_hand(rows, least=10):
    key = lambda s: lower(s).strip(" \t\n\v\f\r")
    owner = {}
    for i, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= least:
                owner[key(s)] = min(owner.get(key(s), i), i)
    out = {}
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [s for s in ls if len(key(s)) < least or owner[key(s)] == i]
        out[i] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("batches", [1, 3, 7])
def test_lines(spark, seed, batches):
    rows = corpus(seed)
    got = linededup.dedup_lines(frame(spark, rows), batches=batches, fanout=2)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got.collect()} == lines_by_hand(rows)
    assert set(frame(spark, rows).columns) <= set(got.columns)


def test_lines_edge_rows(spark):
    rows = [(None, "a shared line of text"), (5, "a shared line of text"), (5, "a shared line of text"), (7, "A SHARED line of text \nnew")]
    got = sorted((str(r.doc_id), r.text, r.n_dropped) for r in linededup.dedup_lines(frame(spark, rows)).collect())
    assert got == [("5", "a shared line of text", 0)] * 2 + [("7", "new", 1), ("None", "a shared line of text", 0)]
    assert linededup.dedup_lines(frame(spark, rows).limit(0)).count() == 0


def test_lines_of_string_ids_and_leftovers(spark):
    """Ids of any order arrive in ranges; many rows without an id; no catalog entry stays; a very long text."""
    rows = [(f"k{i:03d}", t) for i, t in corpus(3) if i is not None] + [("zz", "a line of the long text\n" * 50_000)]
    docs = spark.createDataFrame([*rows, *[(None, "a line of the long text")] * 50], "doc_id string, text string").repartition(4)
    before = {t.name for t in spark.catalog.listTables()}
    got = linededup.dedup_lines(docs, batches=3, fanout=2)
    assert {t.name for t in spark.catalog.listTables()} == before
    expected = lines_by_hand(rows)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got.where("doc_id is not null").collect()} == expected
    assert got.where("doc_id is null and n_dropped = 0").count() == 50


def spans_by_hand(rows, span):
    first = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - span + 1):
            k = tuple(w[s : s + span])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - span + 1):
            if first[tuple(w[s : s + span])] < i:
                gone.update(range(s, s + span))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("seed,span,k,group", [(1, 50, 24, 100_000), (2, 50, 24, 1), (5, 50, 24, 400), (3, 20, 8, 2), (6, 20, 8, 90), (4, 12, 5, 100_000), (7, 12, 12, 1)])
def test_substrings(spark, monkeypatch, seed, span, k, group):
    """group = 1: every shared mark takes the path of longer prefixes."""
    monkeypatch.setattr(substring, "LIMIT", group)
    rows = [*corpus(seed, 50), (950, "x " * 400), (951, "x " * 300 + "y")]
    got = substring.dedup_substrings(frame(spark, rows), span=span, k=k)
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got.collect()} == spans_by_hand(rows, span)


def test_substrings_edge_rows(spark):
    p = " ".join(f"p{i}" for i in range(60))
    rows = [(None, p), (3, p), (3, p), (3, p + " tail"), (4, "head " + p)]
    got = sorted((str(r.doc_id), r.n_removed) for r in substring.dedup_substrings(frame(spark, rows)).collect())
    assert got == [("3", 0), ("3", 0), ("3", 0), ("4", 60), ("None", 0)]
    assert substring.dedup_substrings(frame(spark, rows).limit(0)).count() == 0


def test_substrings_many_copies(spark, monkeypatch):
    """A thousand rows of one id and text, long texts of one word, and a passage with different surroundings, over a low limit."""
    monkeypatch.setattr(substring, "LIMIT", 2000)
    r = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(80))
    own = lambda i, n: " ".join(f"d{i}x{r.randrange(10**6)}" for _ in range(n))
    rows = [(i, f"{own(i, 30)} {passage} {own(i, 30)}") for i in range(10, 150)] + [(2, "y " * 20_000), (5, "y " * 15_000 + "z"), (1, own(1, 30))]
    same = [(7, "head " + passage)] * 1000
    got = substring.dedup_substrings(frame(spark, [*rows, *same]))
    expected = spans_by_hand([*rows, same[0]], 50)
    found = got.collect()
    assert len(found) == len(rows) + 1000 and all((x.n_words, x.n_removed, x.text) == expected[x.doc_id] for x in found)


def shingles(t, k=5):
    w = words(lower(t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components_by_hand(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[a + 1 :]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("group,block", [(32, 2_000_000), (2, 300)])
def test_jaccard(spark, monkeypatch, seed, group, block):
    """The second setting makes almost every part hot and every block many chunks."""
    monkeypatch.setattr(jaccard, "GROUP", group)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    rows = corpus(seed, 110)
    got = jaccard.join(frame(spark, rows))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == components_by_hand(rows)


def test_jaccard_chain_of_borderline_pairs(spark, monkeypatch):
    """A long chain in which only neighbours are similar, around the threshold exactly."""
    monkeypatch.setattr(jaccard, "GROUP", 4)
    base = [f"t{i}" for i in range(200)]
    rows, w = [], list(base)
    for i in range(60):
        w[(i * 7) % 200] = f"u{i}"
        w[(i * 7 + 3) % 200] = f"v{i}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows)).collect()}
    assert got == components_by_hand(rows)


def test_jaccard_edge_rows(spark):
    t = " ".join(f"a{i}" for i in range(40))
    rows = [(None, t), (8, t), (8, t), (8, "other words here"), (9, t + " z")]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows)).collect())
    assert got == [("8", 1, 8), ("8", 36, 8), ("8", 36, 8), ("9", 37, 8), ("None", 36, 8)]
    assert jaccard.join(frame(spark, rows).limit(0)).count() == 0


def test_parts_meet_whenever_sets_are_similar():
    """The pigeonhole bound itself, over random pairs at the threshold."""
    rng, bands = np.random.RandomState(0), jaccard.Bands(80, 100)
    for n in [1, 2, 5, 9, 10, 23, 50, 117, 400, 1500]:
        for _ in range(30):
            both = np.unique(rng.randint(0, 2**63 - 1, 2 * n + 4, dtype=np.int64).astype(np.uint64))
            a = np.sort(both[:n])
            for cut in {0, n // 10, n // 9}:
                b = np.sort(np.concatenate((a[cut:], both[n : n + cut])))
                if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
                    continue
                keys, owner, slack = jaccard.part_keys(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), bands)
                common = len(np.intersect1d(keys[owner == 0], keys[owner == 1]))
                assert common >= max(slack.max() + 1, 1), (n, cut)


@pytest.mark.parametrize("most", [4_000_000, 300])
def test_packs_meet_like_single_keys(monkeypatch, most):
    """Keys by bucket give the pairs and hot links that all keys in order give; the small limit settles hot keys early."""
    monkeypatch.setattr(jaccard, "MEET", most)
    rng = np.random.RandomState(3)
    keys = rng.randint(-(2**63), 2**63 - 1, 400, dtype=np.int64)[np.minimum(rng.geometric(0.01, 6000), 400) - 1]
    keys[:1500] = keys[0]
    cls = rng.randint(0, 3000, 6000)
    parts = [b for i in range(0, 6000, 500) for b in jaccard._packed(keys[i : i + 500], cls[i : i + 500], 3)]
    assert sum(b.num_rows for b in parts) <= 12 * 8
    rows = sorted(((x["bucket"], x["pack"]) for b in parts for x in b.to_pylist()), key=lambda x: x[0])
    packs = [jaccard.pa.RecordBatch.from_pylist([{"bucket": b, "pack": p} for b, p in rows[i : i + 7]]) for i in range(0, len(rows), 7)]
    members = {}
    for key, c in zip(keys.tolist(), cls.tolist(), strict=True):
        members.setdefault(key, set()).add(c)
    pairs = Counter((a, b) for m in members.values() if len(m) <= jaccard.GROUP for a in m for b in m if a < b)
    found, linked = Counter(), Counter()
    for batch in jaccard._meet_packs(iter(packs)):
        for x in batch.to_pylist():
            if x["hot"]:
                linked[x["a"]] += 1
            else:
                found[x["a"], x["b"]] += x["n"]
    hot = Counter(c for m in members.values() if len(m) > jaccard.GROUP for c in m)
    assert found == pairs and set(linked) == set(hot) and all(linked[c] >= n for c, n in hot.items())
    assert most < 4_000_000 or linked == hot


def test_keys_travel_as_packs(spark):
    """No row per key is shuffled and sorted: at most one row for each bucket that a task packs."""
    docs = frame(spark, [(i, " ".join(f"d{i}w{j}" for j in range(400))) for i in range(30)]).select("doc_id", "text")
    got = jaccard._keys(docs, 5, 80, 100, 4).collect()
    assert len(got) <= 3 * 16 and sum(len(x.pack) // 16 for x in got) > 30 * 80


def test_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW_LINKS", 10)
    edges = [(i * 7919 % 1009, (i + 1) * 7919 % 1009) for i in range(300)] + [(5000, 5001), (7, 7)]
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len(set(got.values())) == 2 and len(got) == 303


def hits_by_hand(docs, items, span=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = {}
    for i, t in items:
        w = cut(t)
        m = min(len(w), span)
        for s in range(len(w) - m + 1) if m else []:
            windows.setdefault(tuple(w[s : s + m]), set()).add(str(i))
    sizes = {len(k) for k in windows}
    out = {}
    for i, t in docs:
        w, hit, found = cut(t), set(), set()
        for m in sizes:
            for s in range(len(w) - m + 1):
                k = tuple(w[s : s + m])
                if k in windows:
                    hit.update(range(s, s + m))
                    found |= windows[k]
        out[i] = (len(w), len(hit), sorted(found))
    return out


@pytest.mark.parametrize("block", [1 << 24, 40])
def test_decontamination(spark, block):
    """The small block size makes several passes."""
    docs = corpus(5, 40)
    items = [(1, " ".join(f"p{i}" for i in range(5, 30))), (2, "one TWO"), (3, None), (4, "..."), (5, "w1-w2 w3"), (10, "a shared line"), (11, docs[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.find_hits(frame(spark, docs), bench, block_bytes=block, keep=["key", "kept"])
    rows = got.collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in rows} == hits_by_hand(docs, items)
    assert all(r.kept["key"] == "x" and sum(s.end - s.start for s in r.spans) == r.n_hit for r in rows)


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_decontamination_of_nameless_items(spark, block):
    """Items without an id hit but are not listed, an item called None is; a very long text; no document at all."""
    text = " ".join(f"q{i}" for i in range(12))
    bench = spark.createDataFrame([(None, text), (None, text), ("None", "z1 z2 z3"), (None, "z2 z3 " * 30)], "item_id string, text string")
    docs = frame(spark, [(1, "a " + text), (2, "z1 z2 z3"), (3, "b " * 200_000 + text), (4, "z1 z3")])
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.find_hits(docs, bench, block_bytes=block).collect()}
    assert got == {1: (13, 12, []), 2: (3, 3, ["None"]), 3: (200_012, 12, []), 4: (2, 0, [])}
    assert decontam.find_hits(docs.limit(0), bench, block_bytes=block).count() == 0


def test_decontamination_without_benchmark(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    rows = decontam.find_hits(frame(spark, [(None, "a b"), (1, None)]), bench).collect()
    assert sorted((r.n_words, r.n_hit) for r in rows) == [(0, 0), (2, 0)]


def test_winnowing_guarantee():
    rng = np.random.RandomState(1)
    for _ in range(100):
        h = rng.randint(0, 2**60, 60).astype(np.uint64)
        s = rng.randint(0, 40)
        other = np.concatenate((rng.randint(0, 2**60, 13).astype(np.uint64), h[s : s + 10]))
        own = set(kernel.sliding_min(kernel.grams(h, 5), 6).tolist())
        assert kernel.sliding_min(kernel.grams(other, 5), 6)[-1] in own


def base_by_hand(t):
    w = words(t)
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = set()
    for i in range(len(w) - 4):
        if win[tuple(w[i : i + 5])] > 1:
            rep.update(range(i, i + 5))
    ls = [s for s in (t or "").split("\n") if words(s)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(ls) - len(set(ls)), len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def verdicts_by_hand(rows, trusted, threshold):
    import math

    import xxhash

    h = lambda x, seed: xxhash.xxh64_intdigest(x, seed)
    sign = lambda v: v - (1 << 64) if v >= 1 << 63 else v

    def buckets(t):
        w = [sign(h(x.encode(), 42)) for x in words(t)]
        one = [v % quality.BUCKETS for v in w]
        two = []
        for a, b in zip(w, w[1:]):  # noqa: B905
            first = h((a % (1 << 64)).to_bytes(8, "little"), 42)
            two.append(sign(h((b % (1 << 64)).to_bytes(8, "little"), first)) % quality.BUCKETS)
        return one + two

    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(buckets(t))
        if i in trusted:
            target.update(buckets(t))
    nr, nt = sum(raw.values()), sum(target.values())

    def weight(k):
        x = math.log((target[k] + quality.PSEUDO) / (raw[k] * nt / nr + quality.PSEUDO)) * 1_000_000
        return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)

    out = {}
    for i, t in rows:
        g = buckets(t)
        score = sum(map(weight, g)) / (1_000_000 * len(g)) if g else 0.0
        base = base_by_hand(t)
        out[i] = (*base, not base[-1] and score >= threshold)
    return out


@pytest.mark.parametrize("seed,most", [(1, 1000), (2, 1000), (3, 3)])
def test_quality(spark, monkeypatch, seed, most):
    """most = 3: trusted ids meet the documents in a merge join."""
    monkeypatch.setattr(quality, "BROADCAST_IDS", most)
    rows = [*corpus(seed, 50), (960, ("same five words in row " * 9).strip()), (961, "a b c d e f g h i j k\na b c d e\n\na b c d e\n <|#$>")]
    trusted = {i for i, _ in rows if i % 2}
    got = quality.rules(frame(spark, rows), spark.createDataFrame([(i,) for i in trusted], "doc_id long"), threshold=-0.005)
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in got.collect()}
    assert found == verdicts_by_hand(rows, trusted, -0.005)
    kept = quality.keep(frame(spark, rows), spark.createDataFrame([(i,) for i in trusted], "doc_id long"), threshold=-0.005)
    assert {r.doc_id for r in kept.collect()} == {i for i, v in found.items() if v[-1]} and kept.columns == frame(spark, rows).columns


def test_quality_edge_rows(spark):
    none = spark.createDataFrame([], "doc_id long")
    rows = [(None, "a b c d e f g h i j k"), (1, None), (1, "a b c d e f g h i j k")]
    got = sorted((str(r.doc_id), r.kept) for r in quality.rules(frame(spark, rows), none).collect())
    assert got == [("1", False), ("1", True), ("None", True)]
    assert quality.rules(frame(spark, rows).limit(0), none).count() == 0


def test_long_text(spark):
    """One text of a million characters goes through whole."""
    t = " ".join(f"k{i % 90_000}" for i in range(170_000))
    rows = [(1, t), (2, t + " end")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring.dedup_substrings(frame(spark, rows)).collect()}
    assert got == {1: (170_000, 0), 2: (170_001, 170_000)}
    assert {r.component_id for r in jaccard.join(frame(spark, rows)).collect()} == {1}
    assert sha("") == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
