"""Small hostile tables and brute-force versions."""

import hashlib
import random
import re

CLASHING = "doc_id long, text string, key string, cls string, n string, mark string, words string, kept string, owner string, h1 string, _rest string, digest string, score string, component_id string, t string"


def frame(spark, rows, partitions=3):
    """(doc_id, text) rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, *["x"] * 13) for i, t in rows], CLASHING).repartition(partitions)


def corpus(seed=0, n=60, vocabulary=80):
    """Random texts with exact and near copies, shared passages, shared lines, junk, nulls and empties."""
    r = random.Random(seed)
    word = lambda: "w%d" % int(r.paretovariate(0.6) % vocabulary)
    rows, passage = [], " ".join(f"p{i}" for i in range(70))
    shared = ["a shared line of text", "  Another SHARED line here ", "short"]
    for i in range(n):
        kind = r.random()
        base = [t for _, t in rows if t]
        if kind < 0.2 and base:
            text = r.choice(base)
        elif kind < 0.45 and base:
            w = r.choice(base).split(" ")
            for _ in range(r.randint(1, 3)):
                w[r.randrange(len(w))] = word()
            text = " ".join(w)
        else:
            text = " ".join(word() for _ in range(r.randint(1, 160)))
        if r.random() < 0.3:
            w = text.split(" ")
            w.insert(r.randrange(len(w) + 1), passage)
            text = " ".join(w)
        if r.random() < 0.4:
            text += "\n" + "\n".join(r.sample(shared, r.randint(1, 3)))
        rows.append((i * 3 % 101 if i % 7 else i, text))
    seen, out = set(), []
    for i, t in rows:
        if i not in seen:
            seen.add(i)
            out.append((i, t))
    return [*out, (900, None), (901, ""), (902, " \n\t "), (903, "one two"), (904, "one two"), (905, "é ß 日本 \U0001f600 é ß"), (906, "\x1f a\x0bb\x0cc\r\nd")]


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()
