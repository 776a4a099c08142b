"""Byte-level BPE: encoding by a public file of ranks, and decoding from ids and their byte offsets.

Pre-tokens come from :mod:`mensura.llm.pretokens`; each different one is merged once and its ids are kept, up to a bound after
which the table starts anew. Ids come with the byte at which each begins, so that a text, or a stretch of it, can be decoded
by placing the vocabulary's bytes. Null and empty texts have no ids; ill-formed UTF-8 becomes U+FFFD before encoding. Of pairs of one rank the
leftmost is merged first. Equal texts have equal ids, so repeated rows do too; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mensura.llm.batches import each_piece, lean
from mensura.llm.pretokens import sliced

CACHED = 400_000  # different pre-tokens that a worker keeps at once
CACHED_BYTES = 64 << 20
MOST_RANKS = 2_000_000  # the bound of what is broadcast


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of base-64 tokens and numbers."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    if len(ranks) > MOST_RANKS:
        raise ValueError(f"{path} has more than {MOST_RANKS} ranks")
    return ranks


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the pair of the lowest rank is merged, the leftmost first, until no pair has a rank.

    A heap of pairs over a linked list, so that a pre-token of a million bytes takes n log n steps.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # where the part that begins here ends; 0: it was merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, a, b, c = heapq.heappop(heap)
        if end[a] != b or b >= n or end[b] != c:
            continue  # a part has changed since
        end[a], end[b] = c, 0
        if c < n:
            before[c] = a
            if (r := ranks.get(piece[a : end[c]])) is not None:
                heapq.heappush(heap, (r, a, c, end[c]))
        if (p := before[a]) >= 0 and (r := ranks.get(piece[p:c])) is not None:
            heapq.heappush(heap, (r, p, a, c))
    out, at = [], 0
    while at < n:
        out.append(ranks[piece[at : end[at]]])
        at = end[at]
    return out


class _Places(dict):
    """Numbers pre-tokens in the order in which they are first asked for, and lists the new ones."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, piece: bytes) -> int:
        self.new.append(piece)
        self[piece] = at = len(self)
        return at


class Memory:
    """Ids of pre-tokens seen so far, laid out flat so that whole pieces are looked up at once.

    ``encode`` gets the new pre-tokens of a piece and returns (all their ids, how many each has).
    """

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = CACHED):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.place = _Places()
        self.flat, self.size, self.bytes = array("i"), array("i"), 0

    def ids(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in order, how many each pre-token has)."""
        if len(self.place) > self.most or self.bytes > CACHED_BYTES:
            self.clear()
        at = np.fromiter(map(self.place.__getitem__, slices), np.int64, len(slices))
        if not len(at):
            return np.zeros(0, np.int32), at
        if new := self.place.new:
            ids, sizes = self.encode(new)
            self.flat.frombytes(np.asarray(ids, np.int32).tobytes())
            self.size.frombytes(np.asarray(sizes, np.int32).tobytes())
            self.bytes += sum(map(len, new))
            self.place.new = []
        flat, size = np.frombuffer(self.flat, np.int32), np.frombuffer(self.size, np.int32).astype(np.int64)
        start = np.cumsum(size) - size
        sizes = size[at]
        return flat[ramps(start[at], sizes)], sizes  # copies: an array cannot grow while it is viewed


def ramps(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def summed(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over consecutive runs."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], np.cumsum(counts)])])


def encoded(memory: Memory, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, how many each text has)."""
    slices, counts = sliced(texts)
    ids, sizes = memory.ids(slices)
    return ids, summed(sizes, counts)


class Vocabulary:
    """The bytes of every id, one after another."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def offsets(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The byte of its text at which each id begins."""
        sizes = self.size[ids]
        begins = np.cumsum(sizes) - sizes
        ends = np.cumsum(counts)
        first = np.concatenate([begins, [int(sizes.sum())]])[ends - counts]
        return begins - np.repeat(first, counts)

    def decoded(self, ids: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all texts, how many each has): every id's bytes are put where its offset says."""
        sizes = self.size[ids]
        lengths = summed(sizes, counts)
        base = np.repeat(np.cumsum(lengths) - lengths, counts)
        out = np.zeros(int(lengths.sum()), np.uint8)
        out[ramps(base + offsets, sizes)] = self.data[ramps(self.start[ids], sizes)]
        return out, lengths


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.astype(np.int32), pa.int32()))


class _Coder:
    """What a Python worker builds once from the broadcast ranks."""

    kept: dict = {}

    def __init__(self, ranks: dict[bytes, int]):
        def encode(slices):
            ids = [merged(s, ranks) for s in slices]
            return np.fromiter(chain.from_iterable(ids), np.int32), np.fromiter(map(len, ids), np.int32)

        self.memory = Memory(encode)
        self.vocabulary = Vocabulary(ranks)

    @classmethod
    def of(cls, shared) -> _Coder:
        if shared.value is not cls.kept.get("ranks"):
            cls.kept = {"ranks": shared.value, "coder": cls(shared.value)}
        return cls.kept["coder"]


def encode(df: DataFrame, ranks_path: str, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``row``, ``ids`` and ``offsets`` (the byte of the text at which each id begins)."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def work(texts):
        coder = _Coder.of(shared)
        ids, counts = encoded(coder.memory, texts)
        return {"ids": _lists(ids, counts), "offsets": _lists(coder.vocabulary.offsets(ids, counts), counts)}

    return each_piece(df, work, "ids array<int>, offsets array<int>", text, keep)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]).astype(np.int64)
    return np.asarray(column.flatten()), counts


def decode(rows: DataFrame, ranks_path: str) -> DataFrame:
    """``row``, ``ids`` and the decoded ``bytes``, from rows with ``ids`` and ``offsets``."""
    shared = rows.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    rows = rows.select("row", "ids", "offsets")
    schema = T.StructType([rows.schema["row"], rows.schema["ids"], T.StructField("bytes", T.BinaryType())])

    def run(batches):
        vocabulary = _Coder.of(shared).vocabulary
        for batch in batches:
            all_ids = batch.column("ids")
            ends = np.frombuffer(all_ids.buffers()[1], np.int32)[all_ids.offset : all_ids.offset + len(all_ids) + 1].astype(np.int64)
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 18), side="right")) - 1)
                part = batch.slice(at, to - at)
                ids, counts = _flat(part.column("ids"))
                offsets, _ = _flat(part.column("offsets"))
                data, lengths = vocabulary.decoded(ids.astype(np.int64), offsets.astype(np.int64), counts)
                bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                made = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("ids"), made], ["row", "ids", "bytes"])
                at = to

    return rows.mapInArrow(lean(run), schema)
