"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs.

The leaves of a word's tree are the pairs that begin at its symbols, each as rank * width + position; an inner node is
the smaller of its children. So the root is the leftmost pair of lowest rank. A merge changes three leaves (the pair
itself, the one before and the one that vanishes), and each change climbs to the root. The trees of many words are
rows of one array and take their steps together; a word beyond ``WIDE`` symbols has a tree of its own.

The tokenizer file says how texts are normalised and cut into words; no merge crosses white space, so a text is the
sequence of its pieces between white space, and a worker keeps the pieces it has met (a bounded number).

Nulls and edges: a null text is an empty one: no ids, empty decoded text. Repeated rows give equal results.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from flowloom.llm.columns import add_columns, groups, place_of

WIDE = 64
#: Pieces that a worker keeps of late (and as many of before), and the longest that it keeps.
KEPT_PIECES, KEPT_LENGTH = 300_000, 100
_NEVER = np.iinfo(np.int64).max
#: Python counts these as white space, the tokenizer does not.
_NOT_SPACE = re.compile("[\x1c-\x1f]")
_SPACE = re.compile(r"[^\S\x1c-\x1f]+")
#: The pattern by which the file cuts words, and the same for lower-case ASCII and Latin-1 letters.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_SIMPLE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^\sa-z0-9\u00df-\u00f6\u00f8-\u00ff]+|\t"
_LATIN_LETTERS = [chr(i) for i in range(0xDF, 0x100) if i != 0xF7]
_SIMPLE = re.compile("[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{1,60}")


class Merges:
    """Ranks and results of symbol pairs."""

    def __init__(self, vocab: dict[str, int], merges: list):
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order
        self.rank_of = dict(zip(keys.tolist(), range(len(keys)), strict=True))

    def leaves(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        keys = left << 32 | right
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[found] == keys, self.ranks[found] * width + at, _NEVER)


def merge_rows(symbols: np.ndarray, lengths: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Merge every row of ``symbols`` (a power of two wide) to its end; all rows step together.

    Returns the symbols of all rows in a line and the number that each row has left.
    """
    count, width = symbols.shape
    place = np.arange(width)
    tree = np.full((count, 2 * width), _NEVER, np.int64)
    if width > 1:
        leaves = merges.leaves(symbols[:, :-1], symbols[:, 1:], place[:-1], width)
        tree[:, width : 2 * width - 1] = np.where(place[1:] < lengths[:, None], leaves, _NEVER)
    size = width
    while size > 1:
        tree[:, size // 2 : size] = np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2])
        size //= 2
    symbols, tree = symbols.ravel(), tree.ravel()
    after, before = np.tile(place + 1, count), np.tile(place - 1, count)
    there = (place < lengths[:, None]).ravel()
    active = np.arange(count)
    while True:
        root = tree[active * 2 * width + 1]
        active, root = active[root != _NEVER], root[root != _NEVER]
        if not len(active):
            return symbols[there], there.reshape(count, width).sum(axis=1)
        base, top, end = active * width, active * 2 * width, lengths[active]
        at = root % width
        gone = after[base + at]
        follows = after[base + gone]
        symbols[base + at] = merges.made[root // width]
        there[base + gone] = False
        after[base + at] = follows
        inner = follows < end
        before[(base + follows)[inner]] = at[inner]
        ahead = before[base + at]
        led = ahead >= 0
        tree[top + width + gone] = _NEVER
        tree[top + width + at] = np.where(inner, merges.leaves(symbols[base + at], symbols[base + np.minimum(follows, width - 1)], at, width), _NEVER)
        tree[(top + width + ahead)[led]] = merges.leaves(symbols[(base + ahead)[led]], symbols[(base + at)[led]], ahead[led], width)
        for leaf, tops in ((gone, top), (at, top), (ahead[led], top[led])):
            node = (width + leaf) >> 1
            while node.size and node[0]:
                tree[tops + node] = np.minimum(tree[tops + 2 * node], tree[tops + 2 * node + 1])
                node >>= 1


def merge_long(row: list[int], merges: Merges) -> np.ndarray:
    """The same for one long word, with plain lists."""
    count, width = len(row), 1 << (len(row) - 1).bit_length()
    symbols, after, before = list(row), list(range(1, count + 1)), list(range(-1, count - 1))
    tree = [_NEVER] * (2 * width)
    rank_of = merges.rank_of

    def leaf(i: int, j: int) -> int:
        rank = rank_of.get(symbols[i] << 32 | symbols[j])
        return _NEVER if rank is None else rank * width + i

    tree[width : width + count - 1] = [leaf(i, i + 1) for i in range(count - 1)]
    for node in range(width - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(i: int, value: int) -> None:
        node = width + i
        tree[node] = value
        while node > 1:
            node >>= 1
            smaller = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == smaller:
                return
            tree[node] = smaller

    alive = [True] * count
    while tree[1] != _NEVER:
        rank, at = divmod(tree[1], width)
        gone = after[at]
        follows = after[gone]
        symbols[at], alive[gone], after[at] = int(merges.made[rank]), False, follows
        put(gone, _NEVER)
        put(at, leaf(at, follows) if follows < count else _NEVER)
        if follows < count:
            before[follows] = at
        if before[at] >= 0:
            put(before[at], leaf(before[at], at))
    return np.array([s for s, keep in zip(symbols, alive, strict=True) if keep], np.int64)


class Encoder:
    """Ids and decoded text by a tokenizers file whose model is byte-pair encoding over words."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.vocab = spec["model"]["vocab"]
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.merges = Merges(self.vocab, spec["model"]["merges"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.names = {i: t.encode() for t, i in self.vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.kept: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}
        # Ids of the single signs of the vocabulary, inside a word and at its end, by code point.
        signs = {c: i for c, i in self.vocab.items() if len(c) == 1}
        self.inner, self.last = (np.full(max(map(ord, signs)) + 1, -1, np.int64) for _ in range(2))
        for c, i in signs.items():
            self.inner[ord(c)], self.last[ord(c)] = i, self.vocab.get(c + self.suffix, -1)
        self.simple = self._simple_rules(spec)

    def _simple_rules(self, spec: dict) -> tuple[re.Pattern, dict] | None:
        """How to cut pieces of ASCII and Latin-1 letters without the library, if the file's pattern is the known one."""
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        if (steps[0].get("pattern") or {}).get("Regex") != _PATTERN or (spec.get("normalizer") or {}).get("normalizers", [{}])[-1].get("type") != "Lowercase":
            return None
        return re.compile(_SIMPLE_PATTERN), {ord(c): self.library.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in _LATIN_LETTERS}

    def _words(self, pieces: list[str]) -> list[list[str]]:
        """Words of each piece, in the alphabet of the vocabulary. Pieces hold no white space, so blanks part them."""
        line = " ".join(pieces)
        if self.library.normalizer:
            line = self.library.normalizer.normalize_str(line)
        blanks = np.array([i for i, c in enumerate(line) if c == " "], np.int64)
        if len(blanks) != len(pieces) - 1:
            return [self._words([p])[0] for p in pieces] if len(pieces) > 1 else [[w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(line)]]
        found = self.library.pre_tokenizer.pre_tokenize_str(line)
        out: list[list[str]] = [[] for _ in pieces]
        for at, (word, _) in zip(np.searchsorted(blanks, [span[0] for _, span in found]).tolist(), found, strict=True):
            out[at].append(word)
        return out

    def encode_words(self, words: list[str]) -> dict[str, tuple[bytes, bytes]]:
        """Ids (little-endian 32-bit) and decoded bytes of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes)
        known = np.where(points < len(self.inner), self.inner[np.minimum(points, len(self.inner) - 1)], -1)
        known[ends - 1] = np.where(points[ends - 1] < len(self.last), self.last[np.minimum(points[ends - 1], len(self.last) - 1)], -1)
        owner = np.repeat(np.arange(len(words)), sizes)[known >= 0]  # a sign that the vocabulary lacks is passed over
        known, sizes = known[known >= 0], np.bincount(owner, minlength=len(words))
        begins = np.cumsum(sizes) - sizes
        out, low = {}, -1
        for width in (1, 2, 4, 8, 16, 32, WIDE):
            chosen = np.flatnonzero((sizes > low) & (sizes <= width))
            for at in range(0, len(chosen), 20_000):
                part = chosen[at : at + 20_000]
                place = np.arange(width)
                inside = place < sizes[part, None]
                symbols = np.where(inside, known[np.minimum(begins[part, None] + place, max(0, len(known) - 1))], 0) if len(known) else np.zeros(inside.shape, np.int64)
                line, left = merge_rows(symbols, sizes[part], self.merges)
                self._name([words[i] for i in part.tolist()], line, np.cumsum(left).tolist(), out)
            low = max(width, 1)
        for i in np.flatnonzero(sizes > WIDE).tolist():
            line = merge_long(known[begins[i] : begins[i] + sizes[i]].tolist(), self.merges)
            self._name([words[i]], line, [len(line)], out)
        return out

    def _name(self, words: list[str], line: np.ndarray, ends: list[int], out: dict) -> None:
        data, tokens = line.astype("<u4").tobytes(), [self.names[i] for i in line.tolist()]
        start = 0
        for w, end in zip(words, ends, strict=True):
            out[w] = data[4 * start : 4 * end], b" ".join(tokens[start:end])
            start = end

    def _simple_words(self, pieces: list[str]) -> list[list[str]]:
        """As ``_words``, for pieces of printable ASCII and Latin-1 letters, which normalising only makes lower-case."""
        pattern, alphabet = self.simple
        out, words = [], []
        for w in "\n".join(pattern.findall("\t".join(pieces).lower())).translate(alphabet).split("\n"):
            if w == "\t":
                out.append(words)
                words = []
            else:
                words.append(w)
        return [*out, words]

    def encode_pieces(self, pieces: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids and decoded bytes of pieces without white space."""
        parts: dict[str, list] = {}
        if self.simple:
            simple = [p for p in pieces if _SIMPLE.fullmatch(p)]
            parts.update(zip(simple, self._simple_words(simple), strict=True)) if simple else None
        plain = [p for p in pieces if p not in parts and not (self.split_special and self.split_special.search(p))]
        parts.update(zip(plain, self._words(plain), strict=True)) if plain else None
        for p in pieces:
            if p not in parts:
                cut = [x for x in self.split_special.split(p) if x]
                parts[p] = [w for x in cut for w in ([self.special[x]] if x in self.special else self._words([x])[0])]
        words = self.encode_words(list({w for found in parts.values() for w in found if isinstance(w, str)}))
        for i in self.special.values():
            words[i] = np.array([i], "<u4").tobytes(), self.names[i]
        out = []
        for p in pieces:
            found = parts[p]
            if len(found) == 1:
                out.append(words[found[0]])
            else:
                out.append((b"".join([words[w][0] for w in found]), b" ".join([words[w][1] for w in found if words[w][0]])))
        return out

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids (little-endian 32-bit) and decoded UTF-8 of each text."""
        split = [(_SPACE.split(t) if _NOT_SPACE.search(t) else t.split()) if t else [] for t in texts]
        wanted = set().union(*split) - self.kept.keys()
        if len(self.kept) + len(wanted) > KEPT_PIECES:  # what is not met again until the next time is forgotten
            self.older, self.kept = self.kept, {}
            wanted = set().union(*split)
        again = wanted & self.older.keys()
        self.kept.update((p, self.older[p]) for p in again)
        wanted, long = sorted(wanted - again), {}
        for piece, found in zip(wanted, self.encode_pieces(wanted), strict=True):
            (self.kept if len(piece) <= KEPT_LENGTH else long)[piece] = found
        get = self.kept.__getitem__ if not long else lambda p: long[p] if p in long else self.kept[p]
        out = []
        for pieces in split:
            found = [get(p) for p in pieces]
            out.append((b"".join([x for x, _ in found]), b" ".join([d for x, d in found if x])))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(docs: DataFrame, path: str, text: str = "text", keep_ids: bool = True) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if wanted, ``ids`` and ``decoded``."""

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if keep_ids:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    place = place_of(docs, text, fields)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, coder, rows = batch.column(place), encoder(path), []
        for start, stop in groups(texts):
            for ids, decoded in coder.encode(texts.slice(start, stop - start).to_pylist()):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()) + ((np.frombuffer(ids, "<u4").astype(np.int32), decoded.decode()) if keep_ids else ()))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * (5 if keep_ids else 3)
        return [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()), strict=False)]

    return add_columns(docs, make, fields)
