"""Harmonic packing of token sequences into bins of one capacity.

A document is cut into whole bins, then halves, quarters and so on down to ``GRAIN`` tokens, then a tail. Lengths are
partitioned into reciprocal-capacity classes: class j holds lengths of more than capacity / (j + 1) and at most
capacity / j, and a bin of class j is closed when it has exactly j pieces. Cut pieces fill their bins exactly; only
bins of tails lose a little. Each worker packs its own rows and knows nothing of the others. At its end the pieces of
bins that are not yet closed are laid one after another, cut where a bin ends; the last of these bins is cut into
powers of two, which need no padding.

Nulls and edges: a null or empty text is the end token alone. Rows of one ``doc_id`` are packed each on its own. A null
``doc_id`` stays null. An empty table gives no piece.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from flowloom.llm.columns import groups

CAPACITY, GRAIN, END = 2048, 64, 1
KEPT_PIECES, KEPT_LENGTH = 300_000, 100
#: White space next to a blank: the tokenizer may then join blanks across the cut.
_JOINED_BLANK = re.compile(r"\s | \s")
#: Line feeds, printable ASCII without "<" (special tokens), and the letters of Latin-1.
_LATIN = re.compile("[\\n -;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
SCHEMA = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class BlankLedTokens:
    """Ids of a tokenizers file whose words may begin with one blank; pieces met before are kept (a bounded number).

    Given the same vocabulary as a rank file, pieces of Latin letters, digits and common signs are looked up by the
    faster rank encoder, which cuts and merges them alike; all else goes to the tokenizers library.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core already
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.ranked = None
        if ranks:
            with open(ranks, "rb") as file:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        if self.ranked is None:
            return self._encode(pieces)
        other = [p for p in pieces if not _LATIN.fullmatch(p)]
        found = dict(zip(other, self._encode(other), strict=True))
        ranked = self.ranked.encode_ordinary
        return [found[p] if p in found else array("I", ranked(p)).tobytes() for p in pieces]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text. A single blank between two other characters always begins a word."""
        texts = [t or "" for t in texts]
        cut = [None if _JOINED_BLANK.search(t) else t.split(" ") for t in texts]
        met = set().union(*(parts[1:] for parts in cut if parts))
        needed = met - self.kept.keys()
        if len(self.kept) + len(needed) > KEPT_PIECES:  # what is not met again until the next time is forgotten
            self.older, self.kept = self.kept, {}
            needed = met
        again = needed & self.older.keys()
        self.kept.update((p, self.older[p]) for p in again)
        needed = [*needed - again]
        long = {}
        for at in range(0, len(needed), 4096):
            part = needed[at : at + 4096]
            for p, ids in zip(part, self._encode_pieces([" " + p for p in part]), strict=True):
                (self.kept if len(p) <= KEPT_LENGTH else long)[p] = ids
        heads = iter(self._encode([t if parts is None else parts[0] for t, parts in zip(texts, cut, strict=True)]))
        get = self.kept.__getitem__ if not long else lambda p: long[p] if p in long else self.kept[p]
        return [next(heads) + b"".join(map(get, parts[1:] if parts else [])) for parts in cut]


@lru_cache(maxsize=2)
def blank_led(path: str, ranks: str | None = None) -> BlankLedTokens:
    return BlankLedTokens(path, ranks)


def _parts(length: int, largest: int, smallest: int = 1) -> Iterator[int]:
    """Whole ``largest`` parts, then falling powers of two down to ``smallest``, then what is left."""
    size = largest
    while length:
        if size < smallest:
            size = length
        if length >= size:
            yield size
            length -= size
        else:
            size //= 2


class Packer:
    """Open bins of one worker, by class; at most one bin a class is open."""

    def __init__(self, worker: int, capacity: int, grain: int):
        self.capacity, self.grain = capacity, grain
        self.next, self.rows = worker << 33, []
        self.open: dict[int, list[tuple]] = {}

    def add(self, doc_id, ids: np.ndarray) -> None:
        at = 0
        for size in _parts(len(ids), self.capacity, self.grain):
            kind = self.capacity // size
            bin_ = self.open.setdefault(kind, [])
            bin_.append((doc_id, at, ids[at : at + size], len(ids)))
            at += size
            if len(bin_) == kind:
                self._close(self.open.pop(kind))

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        pieces = [p for kind in sorted(self.open) for p in self.open[kind]]
        self.open = {}
        pieces.reverse()
        for size in _parts(sum(len(p[2]) for p in pieces), self.capacity):
            bin_, room = [], size
            while room:
                doc_id, start, ids, total = pieces.pop()
                if len(ids) > room:
                    pieces.append((doc_id, start + room, ids[room:], total))
                    ids = ids[:room]
                bin_.append((doc_id, start, ids, total))
                room -= len(ids)
            self._close(bin_)

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, path: str, ranks: str | None = None, capacity: int = CAPACITY, grain: int = GRAIN, end: int = END, forget: bool = False) -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence, and the crc32 of its ids.

    With ``forget`` a task leaves no pieces in the worker's memory for the next one.

    Sequence ids are the input partition's number and a count, so a task that runs again gives the same ids as long as
    its input partition is the same rows in the same order, which holds for a scan of files.
    """
    rows = docs.select("doc_id", "text")
    schema = SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString())
    tail = np.array([end], "<u4").tobytes()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer, kind = blank_led(path, ranks), Packer(TaskContext.get().partitionId(), capacity, grain), pa.int64()

        def out() -> Iterator[pa.RecordBatch]:
            if found := packer.take():
                columns = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for start, stop in groups(batch.column(1)):
                encoded = coder.encode(batch.column(1).slice(start, stop - start).to_pylist())
                for doc_id, ids in zip(batch.column(0).slice(start, stop - start).to_pylist(), encoded, strict=True):
                    packer.add(doc_id, np.frombuffer(ids + tail, "<u4"))
                yield from out()
        packer.finish()
        yield from out()
        if forget:
            coder.kept, coder.older = {}, {}

    return rows.mapInArrow(step, schema)
