"""Archives, licences, toxicity, tokens, language model and pipeline: brute force, round trips, held-out accuracy."""

import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statloom.llm import bpe, license_scan, maskedlm, toxicity, warc
from statloom.llm.queries import vocabulary_path

from .helpers import corpus, frame, lower, sha, words

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe(vocabulary_path())


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary_path())


def same(coder, library, text):
    ids, begin = coder.encode([text])
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert coder.decode(ids, begin) == [library.decode(ids.tolist(), skip_special_tokens=False)] == [text]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_bpe_any_text(coder, library, text):
    same(coder, library, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "é", "²", "½", "'s", "'S", "don't", "<|endoftext|>", "日本", "\x1c", "aaa", "....", "12", "٣", "\r\n", "ñ", "\x85", "Ⅷ", "_", "ingly", "er"]), max_size=20))
def test_bpe_mixed_text(coder, library, parts):
    same(coder, library, "".join(parts))


def test_bpe_pairs_agree_with_merging(coder):
    rng = np.random.RandomState(0)
    a, b = rng.randint(0, 50_000, 3000), rng.randint(0, 50_000, 3000)
    ok = coder.compatible(a, b)
    exact = [coder.merge(coder.bytes[x] + coder.bytes[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist())]  # noqa: B905
    assert ok.tolist() == exact and not all(exact)
    some = [bytes(rng.choice(list(b"aeinrst"), n)) for n in (*range(1, 30), 80, 300)]
    assert coder.merge_all(some) == [coder.merge(w) for w in some]


def test_bpe_frames(spark, library):
    rows = [*corpus(3, 30), (None, "null id"), (7, "again"), (7, "again"), (8, "x" * 300_000)]
    path = vocabulary_path()
    enc = bpe.encode(frame(spark, rows), path)
    got = sorted(((str(r.doc_id), list(r.ids)) for r in enc.collect()), key=str)
    assert got == sorted(((str(i), library.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=str)
    back = sorted((str(r.doc_id), r.text) for r in bpe.decode(enc, path).collect())
    assert back == sorted((str(i), t or "") for i, t in rows)
    assert bpe.encode(frame(spark, rows).limit(0), path).count() == 0


@pytest.mark.parametrize("least", [0, 4])
def test_warc_round_trip(spark, least):
    r = random.Random(1)
    bodies = ["", None, "é" * 3000, "<html>a</html>", "b", "\r\n\r\nWARC/1.1", "x" * 200_000]
    rows = [(k, None if k == 3 else f"http://h/{k} \r\n", r.choice(bodies), "n") for k in range(300)] + [(None, "u", "b", "n"), (5, "u", "b", "n"), (5, "u", "b", "n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    folder, index = warc.write_archives(pages, min_revisit_bytes=least)
    got = warc.read_records(folder, index).collect()
    first = {}
    for i, _, h, _ in rows:
        p = (h or "").encode()
        if i is not None and len(p) >= least:
            first[p] = min(first.get(p, i), i)
    want = []
    for i, _, h, _ in rows:
        p = (h or "").encode()
        again = i is not None and first.get(p, i) < i
        want.append((str(i), len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[p] if again else None))
    assert sorted(map(str, [(str(x.page_id), x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in got])) == sorted(map(str, want))
    payloads = {x.page_id: bytes(x.payload) for x in got if x.record_type == "response" and x.page_id is not None and x.page_id != 5}
    assert all(payloads[i] == (h or "").encode() for i, _, h, _ in rows if i in payloads)


def test_warc_selection_and_whole_archives(spark, tmp_path):
    import gzip

    pages = spark.range(500).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(cast(id as string), 50) as html")
    folder, index = warc.write_archives(pages.repartition(2), folder=f"file://{tmp_path}/w")
    some = warc.read_records(folder, index.where("page_id % 9 = 4")).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in some} == {i: str(i) * 50 for i in range(500) if i % 9 == 4}
    assert sum(gzip.open(p).read().count(b"WARC/1.1\r\n") for p in (tmp_path / "w").glob("*.gz")) == 500
    empty = pages.limit(0)
    assert warc.read_records(*warc.write_archives(empty)).count() == 0


def dice_by_hand(unit):
    import re

    w = re.sub(r"[^a-z0-9]+", " ", unit.lower()).split()
    own = set(zip(w, w[1:]))  # noqa: B905
    best = (0.0, 0)
    for k, (_, t) in enumerate(license_scan.TEMPLATES):
        g = set(license_scan.template_bigrams(t))
        d = 2 * len(own & g) / (len(own) + len(g)) if own else 0.0
        if d >= license_scan.THRESHOLD and d > best[0]:
            best = (d, k)
    return best


def test_licenses(spark):
    notes = [t for _, t in license_scan.TEMPLATES]
    rows = [(k, f"intro text\n{n.upper()}\nmore") for k, n in enumerate(notes)] + [(100, None), (101, ""), (102, notes[6] + " and so on"), (102, notes[6]), (None, "x\n" + notes[0]), (103, "license " * 50), (104, notes[0] + "\n" + notes[2])]
    got = sorted(map(str, [(r.doc_id, r.license, round(r.dice, 9), len(r.matches)) for r in license_scan.scan(frame(spark, rows)).collect()]))
    want = []
    for i, t in rows:
        t = t or ""
        units = [dice_by_hand(s) for s in [*t.split("\n"), t]]
        d, k = max(units, key=lambda u: (u[0], -u[1]))
        want.append((i, license_scan.TEMPLATES[k][0] if d else None, round(d, 9), sum(u[0] > 0 for u in units[:-1])))
    assert got == sorted(map(str, want))
    assert license_scan.scan(frame(spark, rows).limit(0)).count() == 0


def test_licenses_over_lines(spark):
    """Full licences and wrapped headers in the midst of other text, which no line and no whole text resembles."""
    import textwrap

    full = dict(license_scan.texts())
    notes = [t for _, t in license_scan.TEMPLATES]
    prose = " ".join("word%d" % x for x in random.Random(3).choices(range(50), k=80))
    rows = [
        (1, "MIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + full["MIT"], "MIT"),
        (2, prose + "\n" + "\n".join(textwrap.wrap(full["MIT"], 78)) + "\n" + prose, "MIT"),
        (3, prose + "\n" + "\n".join("# " + x for x in textwrap.wrap(notes[6], 70)) + "\n" + prose, "GPL-3.0"),
        (4, "Copyright 2020 Jane Doe. Licensed under CC BY 4.0.", "CC-BY-4.0"),
        (5, prose + "\n" + full["BSD-3-Clause"] + "\n" + prose, "BSD-3-Clause"),
        (6, "\n".join(textwrap.wrap(full["BSD-2-Clause"], 60)), "BSD-2-Clause"),
        (7, prose + "\n" + "\n".join(textwrap.wrap(dict(license_scan.HEADERS)["GPL-2.0"], 50)) + "\n" + prose, "GPL-2.0"),
        (8, prose + "\nfree of charge\n" + prose, None),
        (9, prose + "\n" + full["CC0-1.0"] + "\n" + prose, "CC0-1.0"),
    ]
    got = {r.doc_id: (r.license, r.dice) for r in license_scan.scan(frame(spark, [x[:2] for x in rows])).collect()}
    assert {i: got[i][0] for i, _, _ in rows} == {i: n for i, _, n in rows}
    assert all((got[i][1] >= 0.8) == (n is not None) for i, _, n in rows) and got[4][1] == 1.0


def test_every_span_is_tried(spark):
    """Against all spans by hand: a template of 450 bigrams, texts that hold parts of it, repeat it or end between its bigrams."""
    r = random.Random(8)
    words = ["w%d" % i for i in range(400)]
    template = r.choices(words, k=460)
    known = set(zip(template, template[1:]))  # noqa: B905
    noise = lambda n: r.choices(words + ["x%d" % i for i in range(300)], k=n)
    cut = [w for i, w in enumerate(template) if i % 23 or r.random() < 0.4]
    texts = [noise(7) + template[a:b] + noise(9) for a, b in ((0, 460), (3, 380), (90, 460), (71, 381), (0, 306), (0, 308), (0, 311))]
    texts += [noise(5) + cut[:400] + noise(5), template[:200] + noise(150) + template[200:] + noise(5), template[:150] * 3 + template[150:] + noise(3), template[300:] + template + template[:100]]
    got = {x.doc_id: x.dice for x in license_scan.scan(frame(spark, [(i, " ".join(t)) for i, t in enumerate(texts)]), more=[("Long", " ".join(template))]).collect()}
    for i, t in enumerate(texts):
        g, best = list(zip(t, t[1:])), 0.0  # noqa: B905
        for a in range(len(g)):
            span, hits = set(), 0
            for x in g[a:]:
                if x not in span:
                    span.add(x)
                    hits += x in known
                    best = max(best, 2 * hits / (len(span) + len(known)))
        assert got[i] == pytest.approx(best if best >= license_scan.THRESHOLD else 0, abs=1e-12), i
    assert sum(v > 0 for v in got.values()) >= 8 and min(got.values()) == 0


def test_toxicity_held_out(spark):
    r = random.Random(4)
    bad = ["zorgling", "flarnish"]
    rows, labels = [], []
    for i in range(1500):
        w = ["w%d" % r.randrange(400) for _ in range(r.randint(5, 120))]
        toxic = r.random() < 0.2
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", "s", ","]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    lab = spark.createDataFrame(labels[:900], "doc_id long, toxic int")
    docs = frame(spark, [*rows, (None, "zorgling"), (5000, None), (5001, "")])
    model = toxicity.fit(docs, lab)
    got = toxicity.score(docs, model).collect()
    scores = {x.doc_id: x.score for x in got}
    wrong = sum((scores[i] >= 0.3) != bool(t) for i, t in labels[900:])
    assert wrong <= 6 and all(0 <= x.score <= 1 for x in got) and scores[5000] == scores[5001] < 0.3
    again = toxicity.score(docs.repartition(5), toxicity.fit(docs.repartition(7), lab)).collect()
    assert max(abs(scores[x.doc_id] - x.score) for x in again) < 1e-9


def test_toxicity_features_sum_bytes_once(monkeypatch):
    """The hashes of words and of all beginnings come from one sum over the bytes; places of features as by a search."""
    texts = ["Abcdefghij abc, abcde", "", "xyzzy " * 50, "wörter über alles"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    want = []
    for i, t in enumerate(texts):
        low = np.frombuffer(t.lower().encode(), np.uint8)
        starts, ends, _ = toxicity.K.words(low, np.array([0, len(low)]), toxicity.K.NOT_ALNUM)
        for a, b in zip(starts, ends, strict=True):
            cuts = [b, *[a + n for n in toxicity.BEGINNINGS if b - a > n]]
            want += [(i, int(toxicity.K.spans(low, np.array([a]), np.array([c]))[0]) >> (64 - toxicity.SPACE_BITS)) for c in cuts]
    sums = []
    cumsum = np.cumsum
    monkeypatch.setattr(np, "cumsum", lambda *a, **k: (sums.append(1), cumsum(*a, **k))[1])
    hashed, of = toxicity.features(data, offs)
    assert len(sums) == 1 and sorted(zip(of.tolist(), hashed.tolist(), strict=True)) == sorted(want)
    for among in (np.unique(hashed)[::3], np.unique(hashed)[1:2]):
        got = toxicity.places(hashed, among)
        assert all((among[p] == h) if p >= 0 else h not in among for p, h in zip(got, hashed, strict=True))


def test_toxicity_without_data(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    docs = frame(spark, [(1, "a b"), (1, "a b"), (None, None)])
    assert [r.score < 1e-3 for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()] == [True] * 3
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), none)).count() == 0


def test_toxicity_risk_and_gradient():
    """The risk from its definition, one text at a time, and its gradient by differences, on both sides of the clamp."""
    rng = np.random.RandomState(5)
    xp, xu = (rng.rand(7, 4) < 0.6).astype(np.float32), (rng.rand(11, 4) < 0.3).astype(np.float32)
    sides = set()
    for prior in (0.1, 0.5, 0.95):
        for scale in (0.3, 3.0):
            w, bias = rng.normal(0, scale, 4), float(rng.normal(0, scale))
            good = lambda x, w, b: np.log(1 + np.exp(-(sum(a * c for a, c in zip(x, w, strict=True)) + b)))
            bad = lambda x, w, b: np.log(1 + np.exp(sum(a * c for a, c in zip(x, w, strict=True)) + b))
            positive = lambda w, b: prior * np.mean([good(x, w, b) for x in xp])  # noqa: B023, E731
            negative = lambda w, b: np.mean([bad(x, w, b) for x in xu]) - prior * np.mean([bad(x, w, b) for x in xp])  # noqa: B023, E731
            value, grad = toxicity.risk(xp, xu, prior, w, bias)
            n = negative(w, bias)
            assert abs(value - positive(w, bias) - max(0, n)) < 1e-6
            whole = (lambda w, b: positive(w, b) + negative(w, b)) if n >= 0 else (lambda w, b: -negative(w, b))  # noqa: B023
            sides.add(n >= 0)
            for k in range(4):
                e = np.eye(4)[k] * 1e-4
                assert abs((whole(w + e, bias) - whole(w - e, bias)) / 2e-4 - grad[k]) < 1e-5
            assert abs((whole(w, bias + 1e-4) - whole(w, bias - 1e-4)) / 2e-4 - grad[4]) < 1e-5
    assert sides == {True, False}


def test_toxicity_shards_average(spark, monkeypatch):
    """Many shards: their mean weights, computed apart; repeated rows count once; long texts and ties do no harm."""
    monkeypatch.setattr(toxicity, "SHARD", 40)
    r = random.Random(9)
    rows = [(i, " ".join([*(f"w{r.randrange(50)}" for _ in range(20)), *(["vile", "foul"] if i % 5 == 0 else [])])) for i in range(400)]
    lab = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 400, 2)], "doc_id long, toxic int")
    docs = frame(spark, [*rows, *rows[:30], (7000, "w1 " * 100_000), (None, "vile")])
    model = toxicity.fit(docs, lab, rounds=1)
    assert len(model.kept) >= 2
    code = lambda t: toxicity._distinct(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), model.kept)[1]
    every = [*rows, (7000, "w1 " * 100_000)]
    keys = {x.doc_id: x.k for x in docs.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("k")).distinct().collect()}
    shards = {}
    for i, t in every:
        n = round(431 / 40)
        shards.setdefault(int(toxicity.K.mix(np.array([keys[i]]).view(np.uint64))[0]) % n, []).append((keys[i], t))
    matrix = lambda ts: np.array([[k in code(t) for k in range(len(model.kept))] for t in ts], np.float32)
    xp = matrix([t for i, t in rows if i % 10 == 0])
    start = np.append(np.zeros(len(model.kept)), np.log(0.2 / 0.8))
    apart = [toxicity.descend(xp, matrix([t for _, t in sorted(s)]), 0.2, start, 0.2 / len(xp), steps=50) for s in shards.values()]
    assert len(apart) > 5 and np.allclose(np.mean(apart, axis=0), np.append(model.weight, model.bias), atol=1e-4)
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert min(got[i] for i, _ in rows if i % 5 == 0) > 0.3 > max(got[i] for i, _ in rows if i % 5)


SMALL = maskedlm.Shape(clusters=3, slots=4, tails=5, endings=16, reach=2, width=6)


def lm_brute(model, counts, total, text):
    """Sum of the log-probabilities of a text's words, one at a time in plain Python. counts: of all words of the corpus."""
    s, w = model.shape, model.shape.width
    code = lambda x, base, mod: int(maskedlm.K.spans(np.frombuffer(x.encode(), np.uint8), np.array([max(0, len(x.encode()) - base)]), np.array([len(x.encode())]))[0]) % mod
    full = lambda x: int(maskedlm.K.spans(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x.encode())])).view(np.int64)[0])
    rank = dict(zip(model.head.tolist(), model.rank.tolist(), strict=True))
    ws = [lower(x) for x in words(text)]
    row = [rank.get(full(x), s.head + code(x, 3, s.endings)) for x in ws]
    out = 0.0
    mix, first, second = (model.view(n).astype(float) for n in ("mix", "first", "second"))
    for i, x in enumerate(ws):
        around = [row[i + o] if 0 <= i + o < len(ws) else s.edge for o in (-2, -1, 1, 2)]
        h = np.tanh(sum(model.view("inputs")[r].astype(float) @ mix[p * w : (p + 1) * w] for p, r in enumerate(around)) + model.view("offset")[0])
        z = first @ h + model.bias("first")
        p1 = np.exp(z) / np.exp(z).sum()
        if full(x) in rank:
            c, k = divmod(rank[full(x)], s.slots)
            z = second[c * s.slots : (c + 1) * s.slots] @ h + model.bias("second")[c * s.slots : (c + 1) * s.slots]
            out += np.log(p1[c]) + np.log(np.exp(z) / np.exp(z).sum())[k]
        else:
            t = code(x, 2, s.tails)
            out += np.log(p1[s.clusters + t]) + np.log(counts.get(x, 1) / (total[t] + 1))
    return out


def test_language_model(spark):
    rows = [*corpus(6, 80), (None, "w1 w2 w3"), (948, "w1 w2"), (948, "w1 w2"), (949, "unheard of, \U0001f600"), (950, "w3 w5 w1 " * 40_000)]
    docs = frame(spark, rows)
    n = Counter(lower(w) for _, t in rows for w in words(t))
    for most in (maskedlm.HEAD, 20, 0):  # all counts broadcast, some, none
        model, known = maskedlm.fit(docs, shape=SMALL, rate=2, rounds=2, most=most)
        assert (known.rest is not None) == (most < 80)
        total = np.rint(np.exp(known.log_total) - 1)
        assert total.sum() + sum(c for _, c in sorted(n.items(), key=lambda x: -x[1])[: SMALL.head]) == sum(n.values())
        got = maskedlm.score(docs.repartition(5), model, known).collect()
        assert len(got) == len(rows) and all((r.mean_log_prob is None) == (r.n_tokens == 0) for r in got)
        by = {r.doc_id: r for r in got}
        for i, t in rows:
            if i is not None and i != 950:
                assert by[i].n_tokens == len(words(t)) and abs(by[i].log_prob - lm_brute(model, n, total, t)) < 1e-3 * (1 + len(words(t)))
        assert by[950].n_tokens == 120_000 and by[950].mean_log_prob > -6
        if most == maskedlm.HEAD:
            other, _ = maskedlm.fit(docs.repartition(7), shape=SMALL, rate=2, rounds=2)
            assert (other.head == model.head).all() and np.allclose(other.params, model.params, atol=1e-3)


def test_language_model_sums_to_one_and_learns(spark):
    r = random.Random(4)
    pairs = [("a", "b"), ("c", "d"), ("e", "f"), ("g", "h")]
    rows = [(i, " ".join(x for _ in range(60) for x in r.choice(pairs))) for i in range(150)]
    docs = frame(spark, rows)
    counts = maskedlm.word_counts(docs, tails=SMALL.tails)
    untrained, tail, total = maskedlm.unigram(counts, SMALL)
    trained, known = maskedlm.fit(docs, shape=SMALL, rate=2, rounds=4)
    assert total == 150 * 120 and tail.sum() == 0
    window = np.random.RandomState(0).randint(0, SMALL.edge + 1, (30, 4))
    for model in (untrained, trained):
        every = sum(np.exp(model.log_probs(window, np.full(30, t))) for t in [*range(8), *range(SMALL.head, SMALL.head + SMALL.tails)])
        assert np.allclose(every, 1, atol=1e-3)
    mean = lambda m: maskedlm.score(docs, m, known).agg(F.sum("log_prob") / F.sum("n_tokens")).first()[0]
    assert abs(mean(untrained) + np.log(8)) < 0.02 and mean(trained) > -1.6  # the neighbour tells which word it is, the pair is one of four


def test_gradient_of_the_network():
    """One step of plain Python differences against steps()."""
    s, rng = SMALL, np.random.RandomState(3)
    rows = s.parts()["second"].stop
    params = np.abs(rng.normal(0, 0.4, (rows, s.width + 2))).astype(np.float32)
    model = maskedlm.Model(s, np.arange(s.head), np.arange(s.head), params)
    windows = np.concatenate((rng.randint(0, s.edge + 1, (20, 4)), rng.randint(0, s.head + s.tails, (20, 1))), axis=1).astype(np.int32)
    after, touched = maskedlm.steps(model, windows, batch=20, rate=1e-3)
    assert (after[~touched] == params[~touched]).all()

    def loss(p):
        return -maskedlm.Model(s, model.head, model.rank, p).log_probs(windows[:, :-1], windows[:, -1]).astype(float).sum()

    for row in [*rng.choice(rows, 12, replace=False), s.parts()["offset"].start, s.parts()["first"].start + 1]:
        for col in (0, s.width):
            if col == s.width and row < s.parts()["first"].start:
                continue
            up, down = params.copy(), params.copy()
            up[row, col] += 0.02
            down[row, col] -= 0.02
            g = (loss(up) - loss(down)) / 0.04
            moved = -(after[row, col] - params[row, col]) * np.sqrt(after[row, -1]) / 1e-3
            assert abs(g - moved) < 0.02 + 0.05 * abs(g)


def test_language_model_of_nothing(spark):
    empty = frame(spark, [(1, "a")]).limit(0)
    assert maskedlm.fit_score(empty).count() == 0
    model, known = maskedlm.fit(empty, shape=SMALL)
    got = maskedlm.score(frame(spark, [(1, "x y"), (2, None)]), model, known).collect()
    assert sorted((r.doc_id, r.n_tokens, round(r.log_prob, 3)) for r in got) == [(1, 2, round(-2 * np.log(5), 3)), (2, 0, 0.0)]
    assert maskedlm.fit_score(frame(spark, [(1, None), (2, "")])).count() == 2

def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(9)
    good = [" ".join("g%d" % r.randrange(300) for _ in range(60)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good)] + [(100 + i, good[i] + " tail") for i in range(10)] + [(200, "too short"), (201, "rep eat rep eat " * 30)]
    leak = " ".join(f"b{i}" for i in range(15))
    rows += [(300, good[0][::-1] + " " + leak), (301, "\n".join([good[20], "a line that is in two documents"])), (302, "\n".join(["A line that is in two documents ", *(" ".join("h%d" % r.randrange(300) for _ in range(40)) for _ in range(2))]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at, ids = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path)).persist()
        ids.append({x.doc_id for x in at.select("doc_id").collect()})
        if name != "bpe":
            assert at.dtypes == docs.dtypes
    quality, lines, near, clean, tokens = ids
    assert not quality & {200, 201} and set(range(60)) <= quality and lines == quality
    assert not near & set(range(100, 110)) and set(range(60)) <= near
    assert near - clean == {300} & near and tokens == clean
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x.doc_id for x in out} == tokens
    one = next(x for x in out if x.doc_id == 3)
    assert one.decoded_sha256 == sha(good[3]) and one.n_tokens == len(one.ids)


def test_near_duplicate_stage_goes_by_row(spark):
    """Texts that share an id with a copy, rows without an id, nulls, repeated rows, an empty table."""
    import corpus_pipeline

    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, a), (2, a + " tail"), (2, b), (2, b), (3, None), (4, ""), (None, a), (5, b), (6, "c d")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    order = lambda rs: sorted(rs, key=str)
    assert order((r.doc_id, r.text) for r in kept.collect()) == order([(1, a), (2, b), (2, b), (3, None), (4, ""), (None, a), (6, "c d")])
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0
