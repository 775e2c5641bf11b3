"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can be the last of its encoding: a token that ends there and fits the last token of
the prefix before it. A suffix automaton of the vocabulary gives the tokens that end at each place, from the longest on; whether
two tokens fit, so that merging their joined text yields just those two, is decided by walking back both of their merges across the seam. The
last tokens are stored for every prefix and followed back from the end. All words of a block that are not in the bounded cache of a
worker go through the program together, one place at a time.

Texts are prepared as the tokenizer file says (NFC, white space, lower case, split, byte symbols, word ends). Common texts take a short
way to the same words; others go through the library's own normaliser and splitter. Only words are ever encoded here.
"""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftwork.llm import _shared as S
from driftwork.llm import _text as T

#: Words that a worker keeps, and characters of text prepared together.
CACHE_WORDS, BLOCK_CHARS = 600_000, 3_000_000
#: Bytes of whole texts whose results make one Arrow batch.
BLOCK_BYTES = 1 << 20

#: Texts of these characters only take the short way: no compositions, no numbers beyond 0-9, no unusual blanks.
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-±´-¸º»¿-ɏ]*")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints, else one from 256 on."""
    out, more = [], 256
    for b in range(256):
        prints = 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b
        out.append(chr(b if prints else more))
        more += not prints
    return out


class Automaton:
    """A suffix automaton of many strings of symbols below 512, as sorted arrays."""

    def __init__(self, strings: list[list[int]]):
        go: list[dict[int, int]] = [{}]
        link, size = [-1], [0]
        for s in strings:
            last = 0
            for c in s:
                q = go[last].get(c)
                if q is not None and size[q] == size[last] + 1:
                    last = q
                    continue
                fresh = q is None
                if fresh:
                    now = len(go)
                    go.append({})
                    size.append(size[last] + 1)
                    link.append(0)
                p = last
                while fresh and p >= 0 and c not in go[p]:
                    go[p][c] = now
                    p = link[p]
                if p >= 0:
                    q = go[p][c]
                    if size[q] == size[p] + 1:
                        if fresh:
                            link[now] = q
                    else:
                        copy = len(go)
                        go.append(dict(go[q]))
                        size.append(size[p] + 1)
                        link.append(link[q])
                        while p >= 0 and go[p].get(c) == q:
                            go[p][c] = copy
                            p = link[p]
                        link[q] = copy
                        if fresh:
                            link[now] = copy
                        else:
                            now = copy
                last = now
        self.link, self.size = np.array(link, np.int32), np.array(size, np.int32)
        keys = np.array([s * 512 + c for s, g in enumerate(go) for c in g], np.int64)
        to = np.array([t for g in go for t in g.values()], np.int32)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]

    def step(self, state: np.ndarray, length: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest suffixes after one more symbol: states and their lengths."""
        state, length = state.copy(), length.copy()
        out, todo = np.zeros_like(state), np.arange(len(state))
        while len(todo):
            key = state[todo].astype(np.int64) * 512 + c[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            out[todo[there]] = self.to[at[there]]
            length[todo[there]] += 1
            todo = todo[~there]
            state[todo] = self.link[state[todo]]
            gone = state[todo] < 0
            length[todo[gone]] = 0
            todo = todo[~gone]
            length[todo] = self.size[state[todo]]
        return out, length


class Codec:
    """The vocabulary of a tokenizer file with its merges; travels to the workers as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.path = spec["model"], path
        self.end = model.get("end_of_word_suffix") or ""
        vocab = {t: i for t, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        n = max([*vocab.values(), *self.added.values()]) + 1
        self.text = [""] * n
        for t, i in [*vocab.items(), *self.added.items()]:
            self.text[i] = t
        # symbols: 0-255 bytes within a word, 256-511 bytes at its end
        self.base = np.full(512, -1, np.int32)
        for b, ch in enumerate(byte_symbols()):
            self.base[b], self.base[256 + b] = vocab.get(ch, -1), vocab.get(ch + self.end, -1)
        left, right, self.rank = np.full(n, -1, np.int32), np.full(n, -1, np.int32), np.full(n, -1, np.int64)
        keys, ranks = [], []
        spelled: dict[int, list[int]] = {int(t): [s] for s, t in enumerate(self.base) if t >= 0}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            t, a, b = vocab[a + b], vocab[a], vocab[b]
            keys.append((a << 20) | b)
            ranks.append(r)
            if self.rank[t] < 0 and t not in spelled:
                left[t], right[t], self.rank[t], spelled[t] = a, b, r, spelled[a] + spelled[b]
        order = np.argsort(np.array(keys, np.int64))
        self.pairs, self.pair_rank = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self._slot(self.pairs)] = True
        self.left, self.right = left, right
        tokens = np.array(sorted(spelled), np.int32)
        merged = tokens[self.rank[tokens] >= 0]
        whole = self.fits(left[merged], right[merged], self.rank[merged])
        broken = set(merged[~whole].tolist())  # tokens that no text is encoded to
        self.length = np.zeros(n, np.int32)
        for t in tokens.tolist():
            self.length[t] = len(spelled[t])
        self.automaton = Automaton([spelled[t] for t in tokens.tolist()])
        # tokens by the automaton's states; from each token, the next shorter one that ends at the same place
        a = self.automaton
        goto = dict(zip(a.keys.tolist(), a.to.tolist(), strict=True))
        at: dict[int, list[int]] = {}
        for t in tokens.tolist():
            if t not in broken:
                s = 0
                for c in spelled[t]:
                    s = goto[s * 512 + c]
                at.setdefault(s, []).append(t)
        self.head, self.shorter = np.full(len(a.link), -1, np.int32), np.full(n, -1, np.int32)
        for s in np.argsort(a.size, kind="stable").tolist():
            below = self.head[a.link[s]] if s else -1
            for t in sorted(at.get(s, []), key=lambda t: self.length[t]):
                self.shorter[t] = below
                below = t
            self.head[s] = below

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key * 0x9E3779B1) >> 7) & ((1 << 20) - 1)

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair; a large number where there is none."""
        key = (a.astype(np.int64) << 20) | b
        out = np.full(len(key), 1 << 40, np.int64)
        maybe = np.flatnonzero(self.sieve[self._slot(key)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.pairs, key[maybe]), len(self.pairs) - 1)
            out[maybe] = np.where(self.pairs[at] == key[maybe], self.pair_rank[at], 1 << 40)
        return out

    def fits(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether merging the joined text of a and b leaves the seam alone (up to the merge of rank until, which may join a and b).

        Back in time from the finished tokens: the later of the two pieces at the seam is taken apart. A merge across the seam
        would have come first if its rank is below that of the merge that used up the left piece, and not above that of the
        right piece's (equal ranks go from left to right).
        """
        a, b = a.copy(), b.copy()
        far = np.full(len(a), 1 << 39, np.int64) if until is None else until
        used_a, used_b = far.copy(), far.copy()
        good, todo, first = np.ones(len(a), bool), np.arange(len(a)), until is not None
        while len(todo):
            r = self.merge_rank(a[todo], b[todo])
            if not first:
                bad = (r < used_a[todo]) & (r <= used_b[todo])
                good[todo[bad]] = False
                todo = todo[~bad]
            first = False
            ra, rb = self.rank[a[todo]], self.rank[b[todo]]
            open_ = (ra >= 0) | (rb >= 0)
            todo, ra, rb = todo[open_], ra[open_], rb[open_]
            x, y = todo[ra > rb], todo[ra <= rb]
            used_a[x] = self.rank[a[x]]
            a[x] = self.right[a[x]]
            used_b[y] = self.rank[b[y]]
            b[y] = self.left[b[y]]
        return good

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, given as their UTF-8 bytes, one after the other, and the limits of each."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.concatenate([[0], np.cumsum(size)])
        symbol = np.frombuffer(b"".join(words), np.uint8).astype(np.int32)
        order = np.argsort(-size, kind="stable")
        symbol[start[1:][size > 0] - 1] += 256
        last = np.full(len(symbol), -1, np.int32)
        state, length = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        alive = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), "right")
        for p, k in enumerate(alive.tolist()):
            w = order[:k]
            at = start[w] + p
            state[w], length[w] = self.automaton.step(state[w], length[w], symbol[at])
            token, todo = self.head[state[w]], np.arange(k)
            while len(todo):
                t = token[todo]
                if (t < 0).any():
                    raise ValueError("a symbol is not in the vocabulary")
                span = self.length[t]
                ok = span <= length[w[todo]]
                whole = ok & (span == p + 1)
                check = np.flatnonzero(ok & ~whole)
                ok[check] = self.fits(last[at[todo[check]] - span[check]], t[check])
                last[at[todo[ok]]] = t[ok]
                todo = todo[~ok]
                token[todo] = self.shorter[token[todo]]
        # back from each word's end
        n, place, todo = np.zeros(len(words), np.int64), start[1:] - 1, np.flatnonzero(size)
        found = []
        while len(todo):
            t = last[place[todo]]
            found.append((todo, t))
            n[todo] += 1
            place[todo] -= self.length[t]
            todo = todo[place[todo] >= start[todo]]
        limit = np.concatenate([[0], np.cumsum(n)])
        ids = np.empty(limit[-1], np.uint32)
        slot = limit[1:].copy()
        for w, t in found:
            slot[w] -= 1
            ids[slot[w]] = t
        return ids, limit

    def decode(self, ids) -> str:
        """As the library's decode without a decoder and with special tokens kept: the tokens' texts, with blanks between."""
        return " ".join(self.text[i] for i in ids)


class Worker:
    """Encodes texts with a bounded cache of prepared words."""

    def __init__(self, codec: Codec):
        self.codec, self.ids, self.shown = codec, {}, {}
        self._library = None
        self._added = re.compile("|".join(map(re.escape, codec.added))) if codec.added else None

    def library(self):
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.codec.path)
            self._byte = {ch: b for b, ch in enumerate(byte_symbols())}
        return self._library

    def pieces(self, text: str) -> list:
        """The words of a text: strings, or, on the long way, bytes, and ids of added tokens."""
        if self._added is not None and "<" in text and self._added.search(text):
            out, at = [], 0
            for m in self._added.finditer(text):
                out += [*self.long(text[at : m.start()]), self.codec.added[m[0]]]
                at = m.end()
            return out + self.long(text[at:])
        return _SPLIT.findall(text.lower()) if _PLAIN.fullmatch(text) else self.long(text)

    def long(self, text: str) -> list:
        t = self.library()
        return [bytes(self._byte[ch] for ch in word) for word, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text))] if text else []

    def learn(self, texts: list[list]) -> None:
        """Encode the words that are not known yet, together."""
        every = set().union(*texts)
        new = list(every - self.ids.keys())
        if len(self.ids) + len(new) > CACHE_WORDS:  # only what this block needs stays
            self.ids, self.shown = ({w: d[w] for w in every if w in d} for d in (self.ids, self.shown))
        words = [w for w in new if not isinstance(w, int)]
        ids, limit = self.codec.encode_words([w.encode() if isinstance(w, str) else w for w in words])
        text, ids, limit = self.codec.text, ids.tolist(), limit.tolist()
        raw = np.array(ids, "<u4").tobytes()
        for w, i, j in zip(words, limit, limit[1:], strict=False):
            self.ids[w], self.shown[w] = raw[4 * i : 4 * j], " ".join([text[k] for k in ids[i:j]]).encode()
        for t in new:
            if isinstance(t, int):
                self.ids[t], self.shown[t] = t.to_bytes(4, "little"), text[t].encode()

    def run(self, texts: list[str]):
        """(ids as little-endian 32-bit integers, decoded text) of each text."""
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size < BLOCK_CHARS):
                size += len(texts[hi])
                hi += 1
            pieces = [self.pieces(t) for t in texts[lo:hi]]
            self.learn(pieces)
            for p in pieces:
                yield b"".join(map(self.ids.__getitem__, p)), b" ".join(map(self.shown.__getitem__, p))
            lo = hi


def encoded(docs: DataFrame, path: str, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns keep of docs (default: all) with bpe_ids (array of int) and bpe_text (its decoding), in one scan.

    Null and empty texts, and texts of blanks, have no ids. Strings of the file's special tokens in a text are those tokens, as in the library.
    Repeated rows give a row each; columns of docs named bpe_ids or bpe_text are replaced; an empty table gives no row. Texts are taken whole,
    a block of BLOCK_BYTES at a time; one longer text makes a block of its own.
    """
    return _scan(docs, path, keep, text_col, "bpe_ids array<int>, bpe_text string", lambda ids, text: (np.frombuffer(ids, "<i4"), text.decode()))


def digests(docs: DataFrame, path: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """As encoded(), with n_tokens and the SHA-256 of the ids' bytes and of the decoded text instead of the two."""
    return _scan(docs, path, keep, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda ids, text: (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()))


def _scan(docs, path, keep, text_col, more, what):
    shared = docs.sparkSession.sparkContext.broadcast(Codec(path))
    rows = S.Carried(docs, keep, text_col, more)
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    kinds = [kinds[x.split()[1]] for x in more.split(", ")]

    def run(batches):
        S.lean()
        worker = Worker(shared.value)
        for batch, _, _ in T.blocks(batches, rows.text, BLOCK_BYTES):
            found = [what(*x) for x in worker.run([t or "" for t in batch.column(batch.schema.get_field_index(rows.text)).to_pylist()])]
            yield rows.batch(batch, [pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)])

    return rows.scan(run)
