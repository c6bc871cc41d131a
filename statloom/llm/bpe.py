"""Byte-level BPE encoding by speculation and verification, and decoding.

Texts are cut into pre-tokens. For every pre-token not met before, greedy longest match over the vocabulary
proposes tokens; then every adjacent pair of all proposals is tested at once in numpy: a pair of tokens is
compatible if merging their joined bytes in rank order never merges across the border between them, and a
sequence whose tokens each are their own encoding and whose pairs are all compatible is the BPE encoding. Only
pre-tokens with a failing pair undergo exact merging.

The vocabulary is a file in the format of the tokenizers library (model BPE, ByteLevel pre-tokenizer with its
pattern, no prefix space). Its path is a parameter and must exist on every executor; nothing is trained or copied.

Defined results: a null text counts as empty and gives no tokens; special tokens of the file that stand in a text
become their ids, as in that library; other columns are ignored; repeated rows are encoded each for itself.
"""

from __future__ import annotations

import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Pre-tokens remembered by one Python worker; beyond that it starts anew.
CACHE_WORDS = 200_000
#: Bytes of text handled at once.
CHUNK = 1 << 20

# Fixed values of the ByteLevel format: bytes that stand for themselves as characters.
VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

#: Letters, and all characters, of texts that the fast pattern splits: ASCII but for its separators, and common Latin text.
_LETTER = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_OTHER_TEXT = re.compile(f"[^\x00-\x1b\x20-\x7f¡-±´-¸º»¿-ɏ‐-‧€]")
#: The byte-level pattern for such texts, where digits are 0-9 and white space is ASCII.
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^ \t\n\v\f\r{_LETTER}0-9]+|[ \t\n\v\f\r]+(?![^ \t\n\v\f\r])|[ \t\n\v\f\r]+")


class Decoder:
    """The bytes of every token."""

    def __init__(self, path: str):
        self.spec(path)

    def spec(self, path: str) -> dict:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown, n = {}, 0
        for b in range(256):
            if b in VISIBLE:
                shown[chr(b)] = b
            else:
                shown[chr(256 + n)] = b
                n += 1
        vocab = spec["model"]["vocab"]
        as_bytes = {t: bytes(shown[c] for c in t) for t in vocab}
        self.ids = {as_bytes[t]: i for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.length)))
        self.flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        return spec

    def decode(self, ids: np.ndarray, begin: np.ndarray) -> list[str]:
        size = self.length[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.start[ids] - (ends - size), size)
        data = self.flat[at].tobytes()
        cuts = np.concatenate(([0], ends))[begin]
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


class ByteBpe(Decoder):
    """One vocabulary: greedy proposals, pair checks, exact merging."""

    def __init__(self, path: str):
        spec = self.spec(path)
        vocab, size = spec["model"]["vocab"], len(self.bytes)
        self.longest = max(map(len, self.ids))
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        made: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self.rank[a, b] = (r, whole)
            made.setdefault(whole, (a, b, r))
        self._borders(made, size)
        #: Tokens that merging never yields, which no proposal may use.
        self.never = {i for b, i in self.ids.items() if len(b) > 1 and self.merge(b) != [i]}
        self.proposals = {b: i for b, i in self.ids.items() if i not in self.never}
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.pair_whole = np.array([w for _, w in self.rank.values()], np.int64)[order]
        #: Ids of pre-tokens met before, as the bytes of 32-bit integers.
        self.cache: dict[str | int, bytes] = {}
        self.exact = 0

    def _borders(self, made: dict[int, tuple[int, int, int]], size: int) -> None:
        """Per token, from its last (first) byte up: the parts that end (start) it, and the rank at which each is merged away."""
        far = 1 << 30
        right: list[list[tuple[int, int]]] = [[(i, far)] for i in range(size)]
        left: list[list[tuple[int, int]]] = [[(i, far)] for i in range(size)]
        for whole in sorted(made, key=lambda w: made[w][2]):
            a, b, r = made[whole]
            right[whole] = [*right[b][:-1], (b, r), (whole, far)]
            left[whole] = [*left[a][:-1], (a, r), (whole, far)]
        depth = max(map(len, right + left))

        def table(chains, k, fill):
            out = np.full((size, depth), fill, np.int32)
            for i, c in enumerate(chains):
                out[i, : len(c)] = [x[k] for x in c]
            return out

        self.right, self.right_rank = table(right, 0, 0), table(right, 1, far)
        self.left, self.left_rank = table(left, 0, 0), table(left, 1, far)
        self.far = far

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the border between tokens a and b survives merging, for all pairs at once."""
        ok = np.ones(len(a), bool)
        live, i, j = np.arange(len(a)), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(live):
            x, y = a[live], b[live]
            ra, rb = self.right_rank[x, i], self.left_rank[y, j]
            key = self.right[x, i].astype(np.int64) << 32 | self.left[y, j]
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            across = np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.far)
            # of equal pairs the leftmost merges first: inside a before the border, the border before inside b
            bad = (across < ra) & (across <= rb) & (across < self.far)
            ok[live[bad]] = False
            go = ~bad & (np.minimum(ra, rb) < self.far)
            step_a = (ra <= rb)[go]
            live, i, j = live[go], i[go] + step_a, j[go] + ~step_a
        return ok

    def merge(self, word: bytes) -> list[int]:
        """Exact: the lowest rank, leftmost pair is merged until none is left."""
        parts = [self.ids[bytes([c])] for c in word]
        while len(parts) > 1:
            best = min(((self.rank[p][0], k) for k, p in enumerate(zip(parts, parts[1:])) if p in self.rank), default=None)  # noqa: B905
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [self.rank[parts[k], parts[k + 1]][1]]
        return parts

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """merge for many words: those of one length go step by step together."""
        out: list[list[int]] = [[]] * len(words)
        size = np.array([len(w) for w in words])
        single = np.array([self.ids[bytes([c])] for c in range(256)], np.int64)
        for n in np.unique(size).tolist():
            row = np.flatnonzero(size == n)
            if n > 48:
                for k in row.tolist():
                    out[k] = self.merge_long(words[k])
                continue
            parts = single[np.frombuffer(b"".join([words[k] for k in row.tolist()]), np.uint8).reshape(-1, n)]
            rank, whole = self._look(parts[:, :-1], parts[:, 1:])
            while len(row):
                best = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
                done = rank[np.arange(len(row)), best] >= self.far if rank.shape[1] else np.ones(len(row), bool)
                if done.any():
                    for k, p in zip(row[done].tolist(), parts[done].tolist(), strict=True):
                        out[k] = p
                    row, parts, rank, whole, best = row[~done], parts[~done], rank[~done], whole[~done], best[~done]
                    if not len(row):
                        break
                at = np.arange(len(row))
                parts[at, best] = whole[at, best]
                width = parts.shape[1]
                parts = parts[np.arange(width)[None, :] != best[:, None] + 1].reshape(-1, width - 1)
                gone = np.arange(width - 1)[None, :] != best[:, None]
                rank, whole = rank[gone].reshape(-1, width - 2), whole[gone].reshape(-1, width - 2)
                for k, some in ((best - 1, best > 0), (best, best < width - 2)):
                    r, c = at[some], k[some]
                    rank[r, c], whole[r, c] = self._look(parts[r, c], parts[r, c + 1])
        return out

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (far if none) and result of merging each pair."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        hit = self.pair_keys[at] == key
        return np.where(hit, self.pair_ranks[at], self.far), np.where(hit, self.pair_whole[at], 0)

    def merge_long(self, word: bytes) -> list[int]:
        """As merge, in n log n steps, for long pre-tokens."""
        import heapq

        n = len(word)
        part = [self.ids[bytes([c])] for c in word]
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(self.rank[p][0], k, *p) for k, p in enumerate(zip(part, part[1:])) if p in self.rank]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            _, k, x, y = heapq.heappop(heap)
            m = nxt[k]
            if m < 0 or part[k] != x or part[m] != y:
                continue
            part[k], part[m] = self.rank[x, y][1], -1
            nxt[k] = nxt[m]
            if nxt[m] >= 0:
                prv[nxt[m]] = k
            for q in (prv[k], k):
                if q >= 0 and nxt[q] >= 0 and (p := (part[q], part[nxt[q]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], q, *p))
        return [p for p in part if p >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        out, at, n, known, longest = [], 0, len(word), self.proposals, self.longest
        while at < n:
            for end in range(min(n, at + longest), at, -1):
                t = known.get(word[at:end])
                if t is not None:
                    break
            out.append(t)
            at = end
        return out

    def learn(self, new: list[str]) -> dict[str, bytes]:
        """Encodings of pre-tokens."""
        raw = [w.encode() for w in new]
        tried = [self.propose(w) for w in raw]
        size = np.array([len(t) for t in tried])
        flat = np.fromiter(chain.from_iterable(tried), np.int64, int(size.sum()))
        of = np.repeat(np.arange(len(tried)), size)
        inside = of[:-1] == of[1:]
        pairs, back = np.unique((flat[:-1] << 32 | flat[1:])[inside], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        failed = np.unique(of[:-1][inside][~good[back]])
        for k, ids in zip(failed.tolist(), self.merge_all([raw[k] for k in failed.tolist()]), strict=True):
            tried[k] = ids
        self.exact += len(failed)
        return {w: np.array(t, np.int32).tobytes() for w, t in zip(new, tried, strict=True)}

    def pieces(self, text: str) -> list[str | int]:
        """Pre-tokens of a text, and ids of special tokens in it."""
        parts = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]
        out: list[str | int] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.special[part])
            elif not _OTHER_TEXT.search(part):
                out += _FAST.findall(part)
            else:
                out += self._other(part)
        return out

    @staticmethod
    def _other(text: str) -> list[str]:
        """Texts of other scripts: the library's own splitter, for its Unicode tables."""
        from tokenizers.pre_tokenizers import ByteLevel

        return [text[a:b] for _, (a, b) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and per text where its ids begin (one entry more)."""
        split = [self.pieces(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        known = self.cache
        new = {w for ws in split for w in ws if w not in known}
        for w in [w for w in new if isinstance(w, int)]:
            known[w] = w.to_bytes(4, "little")
            new.discard(w)
        if new:
            known.update(self.learn(list(new)))
        rows = [b"".join(map(known.__getitem__, ws)) for ws in split]
        begin = np.concatenate(([0], np.cumsum([len(r) >> 2 for r in rows]))).astype(np.int64)
        return np.frombuffer(b"".join(rows), np.int32), begin


_loaded: dict[tuple, Decoder] = {}


def load(path: str, kind: type = ByteBpe):
    """One per Python worker and use."""
    if (path, kind) not in _loaded:
        _loaded[path, kind] = kind(path)
    return _loaded[path, kind]


def encode(docs: DataFrame, vocabulary: str, *, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, ids array<int> per row of docs; with ``decoded`` also text, those ids decoded by the same task."""
    kind = dict(docs.dtypes)[doc_id]

    def run(batches):
        bpe = load(vocabulary)
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            i, n = 0, batch.num_rows
            while i < n:
                base = size[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(size, base + CHUNK, "right")))
                ids, begin = bpe.encode(texts.slice(i, j - i).to_pylist())
                out = {"doc_id": batch.column("doc_id").slice(i, j - i), "ids": pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))}
                if decoded:
                    out["text"] = pa.array(bpe.decode(ids, begin), pa.string())
                yield pa.RecordBatch.from_pydict(out)
                i = j
        bpe.cache = {}

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>" + (", text string" if decoded else ""))


def decode(encoded: DataFrame, vocabulary: str, *, keep: list[str] = ["doc_id"], ids: str = "ids") -> DataFrame:  # noqa: B006
    """The ``keep`` columns and ``text`` per row; null ids give a null text."""
    types = dict(encoded.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep)

    def run(batches):
        bpe = load(vocabulary, Decoder)
        for batch in batches:
            i, n = 0, batch.num_rows
            col = batch.column(ids)
            size = np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))
            while i < n:
                base = size[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(size, base + (CHUNK >> 2), "right")))
                part = col.slice(i, j - i)
                begin = np.concatenate(([0], size[i:j] - base))
                texts = bpe.decode(part.flatten().to_numpy(zero_copy_only=False), begin)
                texts = pa.array(texts, pa.string())
                if part.null_count:
                    texts = pc.if_else(part.is_valid(), texts, None)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(i, j - i) for c in keep], texts], names=[*keep, "text"])
                i = j

    return encoded.mapInArrow(tidy(run), schema + ", text string")
