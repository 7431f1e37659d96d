"""Byte-level BPE encoding and decoding with a given vocabulary file.

A text is cut into pieces by the tokenizer's pattern; each piece starts as its bytes' tokens, and a segment
tree over the ranks of adjacent pairs holds at its root the leftmost pair of lowest rank. That pair is merged
and the three entries that change are put back in logarithmic time, until the root has no mergeable pair.
Short pieces take one merge each in lockstep, their trees being the rows of one array; long ones have a tree of
their own. Pieces seen before come from a bounded store.

Defined results: null counts as empty text, which has no tokens. Texts of any length are encoded whole. The
strings of special tokens in a text become those tokens, as the tokenizer's defaults have it. Decoding replaces
bytes that are no UTF-8. Repeated rows each get the same result; other columns pass through, and a column called
like an added one gives way to it.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from loomline.llm.sparkkit import add_columns

#: The cutting pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces kept from batch to batch; only short ones are, so that this bounds the bytes too. A task's end empties the store.
STORE = 200_000
LOCKSTEP = 64
NONE = np.int64(1) << 40


def byte_letters() -> dict[str, int]:
    """Letters of vocabulary entries to bytes: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        entries = [b""] * size
        for token, i in vocab.items():
            entries[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.specials.items():
            entries[i] = token.encode()
        self.flat = np.frombuffer(b"".join(entries), np.uint8)
        self.width = np.array([len(e) for e in entries], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.width)[:-1]])
        self.of_byte = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.of_byte[b] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        key = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        self.size, self.ranks = size, {int(k): r for r, k in reversed([*enumerate(key)])}
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._build_table(key)
        self.pattern = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.store: dict[str, bytes] = {}
        self.passing: list[str] = []

    def _build_table(self, key: np.ndarray) -> None:
        """Pair keys in an open hash table, so that whole arrays of pairs find their ranks together."""
        bits = max(4, int(len(key) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots, self.rank_at = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int64)
        self.reach = 1
        for r, k in enumerate(key):
            at, probes = ((int(k) * 0x9E3779B97F4A7C15) & (1 << 64) - 1) >> int(self.shift), 1
            while self.slots[at] >= 0 and self.slots[at] != k:
                at, probes = (at + 1) % len(self.slots), probes + 1
            if self.slots[at] < 0:
                self.slots[at], self.rank_at[at] = k, r
            self.reach = max(self.reach, probes)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where a pair isn't in the vocabulary or one side is -1."""
        key = left * self.size + right
        at = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        found = np.full(key.shape, NONE, np.int64)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        for _ in range(self.reach):
            here = self.slots[at[open_]]
            hit = here == key[open_]
            found[open_[hit]] = self.rank_at[at[open_[hit]]]
            open_ = open_[~hit & (here >= 0)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
        return found

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids, as little-endian unsigned 32-bit integers, of pieces of at most LOCKSTEP bytes."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces])
        for leaves in (4, 8, 16, 32, 64):
            chosen = np.flatnonzero((sizes <= leaves) & (sizes > (leaves // 2 if leaves > 4 else 0)))
            for lo in range(0, len(chosen), 1 << 14):
                rows = chosen[lo : lo + (1 << 14)]
                tokens = self._lockstep([pieces[i] for i in rows], sizes[rows], leaves)
                kept = tokens >= 0
                ends = np.cumsum(kept.sum(axis=1)) * 4
                ids = tokens[kept].astype("<u4").tobytes()
                for i, a, b in zip(rows, np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist(), strict=True):
                    out[i] = ids[a:b]
        return out

    def _lockstep(self, pieces: list[bytes], sizes: np.ndarray, leaves: int) -> np.ndarray:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(leaves, b"\0") for p in pieces), np.uint8).reshape(n, leaves)
        place = np.arange(leaves)
        token = np.where(place < sizes[:, None], self.of_byte[raw], -1)
        after = np.where(place + 1 < sizes[:, None], place + 1, leaves)
        before = np.broadcast_to(place - 1, (n, leaves)).copy()
        # Tree nodes hold rank * leaves + place, so that the least is the leftmost of the lowest rank.
        tree = np.full((n, 2 * leaves), NONE * leaves, np.int64)
        right = np.concatenate([token[:, 1:], np.full((n, 1), -1)], axis=1)
        tree[:, leaves:] = self.rank(token.ravel(), right.ravel()).reshape(n, leaves) * leaves + place
        width = leaves
        while width > 1:
            pair = tree[:, width : 2 * width]
            tree[:, width // 2 : width] = np.minimum(pair[:, ::2], pair[:, 1::2])
            width //= 2
        live = np.flatnonzero(tree[:, 1] < NONE * leaves)
        while len(live):
            root = tree[live, 1]
            i, rank = root % leaves, root // leaves
            j = after[live, i]
            k = after[live, j]
            token[live, i], token[live, j], after[live, i] = self.merged[rank], -1, k
            inner = k < leaves
            before[live[inner], k[inner]] = i[inner]
            h = before[live, i]
            self._put(tree, live, j, np.full(len(live), NONE, np.int64), leaves)
            follow = np.where(inner, token[live, np.minimum(k, leaves - 1)], -1)
            self._put(tree, live, i, self.rank(token[live, i], follow), leaves)
            led = h >= 0
            if led.any():
                rows, at = live[led], h[led]
                self._put(tree, rows, at, self.rank(token[rows, at], token[rows, i[led]]), leaves)
            live = live[tree[live, 1] < NONE * leaves]
        return token

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, place: np.ndarray, rank: np.ndarray, leaves: int) -> None:
        at = place + leaves
        tree[rows, at] = rank * leaves + place
        while leaves > 1:
            at = at >> 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            leaves >>= 1

    def merge_long(self, piece: bytes) -> bytes:
        """The same for one piece of any length, with a tree of its own."""
        n, none, ranks, size = len(piece), int(NONE), self.ranks, self.size
        leaves = 1 << max(1, (n - 1).bit_length())
        token = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        first = np.full(2 * leaves, none * leaves, np.int64)
        values = np.array(token)
        first[leaves : leaves + n - 1] = self.rank(values[:-1], values[1:]) * leaves + np.arange(n - 1)
        width = leaves
        while width > 1:
            first[width // 2 : width] = np.minimum(first[width : 2 * width : 2], first[width + 1 : 2 * width : 2])
            width //= 2
        tree, after, before, merged = first.tolist(), [*range(1, n + 1)], [*range(-1, n - 1)], self.merged.tolist()

        def put(place: int, rank: int) -> None:
            at = place + leaves
            tree[at] = rank * leaves + place
            at >>= 1
            while at:
                a, b = tree[2 * at], tree[2 * at + 1]
                least = a if a < b else b
                if tree[at] == least:
                    break
                tree[at] = least
                at >>= 1

        while tree[1] < none * leaves:
            rank, i = divmod(tree[1], leaves)
            j = after[i]
            k = after[j]
            token[i], token[j], after[i] = merged[rank], -1, k
            put(j, none)
            if k < n:
                before[k] = i
                put(i, ranks.get(token[i] * size + token[k], none))
            else:
                put(i, none)
            h = before[i]
            if h >= 0:
                put(h, ranks.get(token[h] * size + token[i], none))
        return np.array([t for t in token if t >= 0], "<u4").tobytes()

    def learn(self, pieces: set[str]) -> None:
        """Work out pieces that the store lacks; long ones stay until the next call."""
        for p in self.passing:
            self.store.pop(p, None)
        if len(self.store) + len(pieces) > STORE:
            kept = {p: self.store[p] for p in pieces if p in self.store}
            self.store.clear()
            self.store.update(kept)
        new = [p for p in pieces if p not in self.store]
        raw = [p.encode() for p in new]
        short = [i for i, r in enumerate(raw) if len(r) <= LOCKSTEP]
        for i, ids in zip(short, self.merge_many([raw[i] for i in short]), strict=True):
            self.store[new[i]] = ids
        self.passing = [new[i] for i, r in enumerate(raw) if len(r) > LOCKSTEP]
        for p in self.passing:
            self.store[p] = self.merge_long(p.encode())

    def encode_batch(self, texts: list[str], most: int = 1 << 20) -> list[bytes]:
        """Each text's token ids, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= most):
                size += len(texts[upto])
                upto += 1
            if size > most:
                out.append(self._encode_long(texts[at], most))
            else:
                cut = [self._pieces(t) for t in texts[at:upto]]
                known = set().union(*(p for parts in cut for p, _ in parts))
                self.learn(known)
                get = self.store.__getitem__
                out += [b"".join(map(get, parts[0][0])) if len(parts) == 1 else b"".join(b"".join(map(get, pieces)) + special for pieces, special in parts) for parts in cut]
            at = upto
        return out

    def _pieces(self, text: str) -> list[tuple[list[str], bytes]]:
        """(pieces, the special token after them) for each stretch between special tokens."""
        if self.split is None or not any(s in text for s in self.specials):
            return [(self.pattern.findall(text), b"")]
        parts = self.split.split(text)
        codes = [np.array([self.specials[s]], "<u4").tobytes() for s in parts[1::2]] + [b""]
        return [(self.pattern.findall(t), c) for t, c in zip(parts[::2], codes, strict=True)]

    def _encode_long(self, text: str, most: int) -> bytes:
        """A very long text, its pieces taken as they are found."""
        out, held = [], []
        parts = self.split.split(text) if self.split else [text]
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self._known(held) + np.array([self.specials[part]], "<u4").tobytes())
                held = []
                continue
            size = 0
            for m in self.pattern.finditer(part):
                held.append(m.group())
                size += len(held[-1])
                if size > most:
                    out.append(self._known(held))
                    held, size = [], 0
        return b"".join(out) + self._known(held)

    def _known(self, pieces: list[str]) -> bytes:
        self.learn(set(pieces))
        return b"".join(map(self.store.__getitem__, pieces))

    def decode(self, ids: bytes) -> str:
        """The text of token ids: their bytes on end, read as UTF-8."""
        token = np.frombuffer(ids, "<u4").astype(np.int64)
        out = []
        for at in range(0, len(token), 1 << 18):
            part = token[at : at + (1 << 18)]
            width = self.width[part]
            ends = np.cumsum(width)
            out.append(self.flat[np.repeat(self.start[part] - ends + width, width) + np.arange(ends[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


@lru_cache(2)
def codec(path: str) -> Codec:
    """The codec of a vocabulary file, made once in each Python process."""
    return Codec(path)


def tokenise(docs: DataFrame, path: str, text: str = "text", ids: str | None = "ids") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, and the ids themselves as binary unless ids is None.

    path: of the vocabulary file, at the same place on every machine.
    """
    kinds = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType()), *([(ids, T.BinaryType())] if ids else [])]

    def work():
        own = codec(path)

        def fn(column):
            texts = [t or "" for t in column.to_pylist()]
            coded = own.encode_batch(texts)
            hashed = [hashlib.sha256(c).hexdigest() for c in coded]
            decoded = [hashlib.sha256(own.decode(c).encode()).hexdigest() for c in coded]
            cols = [pa.array([len(c) // 4 for c in coded], pa.int64()), pa.array(hashed, pa.string()), pa.array(decoded, pa.string())]
            return cols + ([pa.array(coded, pa.binary())] if ids else [])

        fn.close = own.store.clear
        return fn

    return add_columns(docs, text, work, [T.StructField(n, k) for n, k in kinds])
