"""Benchmark decontamination: passages of test items are found in documents by 13-word windows.

The windows of all items are normalised and hashed; the hash table is broadcast while it stays under ``MAX_WINDOWS`` and is
otherwise dealt over several passes, each with a table under that bound. Tasks roll the same hash over their documents'
words, look it up, and verify every hit against the item's own words.

Words are runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII. An item with fewer words than a window
is one window; an item without words matches nothing. Null and empty documents have no words and are clean. Repeated items
are reported under each of their ids; items whose id is null are left out of the id list but still mark words. Repeated documents are
judged alike, and their ids are not read. No documents give no rows; an empty benchmark marks nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mensura.llm.batches import each_piece, lean

WINDOW = 13
MAX_WINDOWS = 500_000  # words of the items in one broadcast: about 100 MB in a task
KEPT = frozenset([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Every byte as a word has it: A-Z lower-cased, what no word holds as a space.
FOLD = bytes(c if (c := b + 32 if 0x41 <= b <= 0x5A else b) in KEPT else 0x20 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)
SCAN = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    np.cumprod(np.full(n, BASE), out=out[1:])
    return out


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB)


def _rolled(mixed: np.ndarray, length: int, powers: np.ndarray) -> np.ndarray:
    """Hashes of all windows of ``length`` words."""
    out = np.zeros(len(mixed) - length + 1, np.uint64)
    for j in range(length):
        out += mixed[j : j + len(out)] * powers[length - 1 - j]
    return out


class Windows:
    """All windows of some items: word numbers, and for each length sorted hashes with their words and items."""

    def __init__(self, items: Sequence[tuple[object, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        for item, words in items:
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            length = min(window, len(ids))
            for i in range(len(ids) - length + 1):
                owners[tuple(ids[i : i + length])].add(item)
        self.powers = _powers(window)
        self.by_length = {}
        for length in sorted({len(k) for k in owners}):
            keys = [k for k in owners if len(k) == length]
            table = np.array(keys, np.int64)
            hashes = np.array([_rolled(_mixed(row), length, self.powers)[0] for row in table], np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.by_length[length] = (hashes[order], table[order], [sorted(str(x) for x in owners[keys[i]] if x is not None) for i in order])

    def matches(self, ids: np.ndarray) -> list[tuple[int, int, list[str]]]:
        """(position, length, items) of every verified window; 0 stands for words that no item has."""
        found = []
        mixed = _mixed(ids)
        unknown = np.concatenate([[0], np.cumsum(ids == 0)])
        for length, (hashes, table, owners) in self.by_length.items():
            if len(ids) < length:
                continue
            clear = np.flatnonzero(unknown[length:] == unknown[:-length])
            if not len(clear):
                continue
            rolled = _rolled(mixed, length, self.powers)[clear]
            low = np.searchsorted(hashes, rolled, "left")
            hit = np.flatnonzero((low < len(hashes)) & (hashes[np.minimum(low, len(hashes) - 1)] == rolled))
            for at, k, h in zip(clear[hit].tolist(), low[hit].tolist(), rolled[hit]):
                while k < len(hashes) and hashes[k] == h:
                    if np.array_equal(table[k], ids[at : at + length]):
                        found.append((at, length, owners[k]))
                    k += 1
        return found


def _scan(windows: Windows, texts: list[bytes | None]) -> dict[str, list]:
    lookup = windows.vocabulary.get
    words = [words_of(t) for t in texts]
    counts = [len(w) for w in words]
    # One gap (0) after each document keeps windows from running into the next.
    ids = np.fromiter((i for w in words for i in (*[lookup(x, 0) for x in w], 0)), np.int64, sum(counts) + len(words))
    starts = np.cumsum([0, *[c + 1 for c in counts]])
    hits: dict[int, list] = defaultdict(list)
    for at, length, owners in windows.matches(ids):
        doc = int(np.searchsorted(starts, at, "right")) - 1
        hits[doc].append((at - int(starts[doc]), length, owners))
    out: dict[str, list] = {"n_words": counts, "n_hit": [], "items": [], "spans": []}
    for doc in range(len(texts)):
        marked = np.zeros(counts[doc] + 2, np.int8) if doc in hits else None
        for at, length, _ in hits.get(doc, ()):
            marked[at + 1 : at + 1 + length] = 1
        edges = np.flatnonzero(np.diff(marked)) if marked is not None else np.zeros(0, np.int64)
        spans = [{"start": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])]
        out["n_hit"].append(sum(s["end"] - s["start"] for s in spans))
        out["spans"].append(spans)
        out["items"].append(sorted({i for h in hits.get(doc, ()) for i in h[2]}))
    return out


def _passes(benchmark: DataFrame, item: str, text: str, max_windows: int) -> list[list[tuple[object, list[bytes]]]]:
    """The items in groups whose windows fit one broadcast; an item of more windows is split, with its windows whole.

    Words are at least as many as windows, so the number of words bounds both. Items stream to the driver one by one.
    """
    groups: list[list] = [[]]
    room = max_windows
    for row in benchmark.select(F.col(item).alias("i"), F.col(text).cast("binary").alias("t")).toLocalIterator():
        words = words_of(row.t)
        for at in range(0, max(1, len(words) - WINDOW + 1), max_windows):
            part = words[at : at + max_windows + WINDOW - 1]
            if len(part) > room and groups[-1]:
                groups.append([])
                room = max_windows
            groups[-1].append((row.i, part))
            room -= len(part)
    return groups


def scan(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
         keep: Sequence[str] | None = None, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """``row``, ``n_words``, ``n_hit``, ``items`` (ids as text, sorted) and ``spans`` (word positions, end exclusive, merged)."""
    groups = _passes(benchmark, item, item_text, max_windows)

    def tables(group):
        """One broadcast of a bounded table; a task builds its hashes from it once."""
        return df.sparkSession.sparkContext.broadcast(Windows(group))

    def step(rows: DataFrame, shared, columns: str) -> DataFrame:
        return each_piece(rows, lambda texts: _scan(shared.value, texts), columns, text, keep)

    if len(groups) == 1:
        return step(df, tables(groups[0]), SCAN)
    found = step(df, tables(groups[0]), SCAN)
    for group in groups[1:]:  # later passes carry what the earlier ones found and add to it
        shared = tables(group)
        inner = df.columns if keep is None else list(keep)
        packed = found.select("row", F.struct("n_words", "n_hit", "items", "spans").alias("was"), F.col(f"row.`{text}`").alias(text)) \
            if text in inner else None
        if packed is None:
            raise ValueError("a benchmark of several passes needs the text among the kept columns")
        again = each_piece(packed, lambda texts, s=shared: _scan(s.value, texts), SCAN, text, ["row", "was"])
        joined = F.array_sort(F.concat("row.was.spans", "spans"))
        merged = F.aggregate(joined, F.array().cast("array<struct<start:int,end:int>>"), _merge)
        found = again.select(
            F.col("row.row").alias("row"), "n_words",
            F.array_sort(F.array_union("row.was.items", "items")).alias("items"), merged.alias("spans"),
        ).withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]))) \
            .select("row", "n_words", "n_hit", "items", "spans")
    return found


def _merge(spans: Column, span: Column) -> Column:
    """Append a span to sorted, separate spans; one that touches the last is joined to it."""
    last = F.try_element_at(spans, F.lit(-1))
    whole = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
    joined = F.concat(F.slice(spans, F.lit(1), F.greatest(F.size(spans) - 1, F.lit(0))), F.array(whole))
    return F.when((F.size(spans) > 0) & (last["end"] >= span["start"]), joined).otherwise(F.concat(spans, F.array(span)))


def contaminated(percent: int = 5) -> Column:
    """Some word is hit, and hit words are at least this share of all."""
    return (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))


def clean_documents(df: DataFrame, benchmark: DataFrame, text: str = "text", percent: int = 5) -> DataFrame:
    """The rows that are not contaminated, with their own columns only."""
    return scan(df, benchmark, text).filter(~contaminated(percent)).select("row.*")


def without_spans(text: bytes | None, spans: Sequence) -> bytes | None:
    """The text without its hit words and what stands between them."""
    if not text or not spans:
        return text
    edges = np.diff(np.concatenate([[0], np.frombuffer(text.translate(FOLD), np.uint8) != 0x20, [0]]).astype(np.int8))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    out, at = [], 0
    for s in spans:
        out.append(text[at : first[s["start"]]])
        at = int(last[s["end"] - 1])
    return b"".join([*out, text[at:]])


def cut_spans(df: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """All rows, with the hit spans taken out of their texts."""
    found = scan(df, benchmark, text)
    names = df.columns
    schema = df.schema

    def run(batches):
        for batch in batches:
            rows = batch.column("row")
            texts = rows.field(names.index(text)).to_pylist()
            spans = batch.column("spans").to_pylist()
            cleaned = [None if t is None else without_spans(t.encode(), s).decode("utf-8", "replace") for t, s in zip(texts, spans)]
            columns = [pa.array(cleaned, pa.string()) if n == text else rows.field(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names)

    return found.select("row", "spans").mapInArrow(lean(run), schema)
