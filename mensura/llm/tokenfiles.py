"""Token ids in binary files: every id in the fewest bits that the vocabulary needs.

A file holds blocks of ``BLOCK`` ids (the last may be shorter), each packed into whole bytes, most significant bit first; then
the byte offset of every block, and for every document its id and the place of its first token; then a trailer. Any stretch
of ids is read by the offsets of the blocks that hold it and unpacked by numpy. All numbers of the file are little-endian.

Documents lie in ascending order of their ids, null first, over all files: files hold consecutive ranges. Documents that share an
id stand in any order. Null texts count as empty; every document ends with one end id. Ids are those that the library gives to
the whole text with ``add_special_tokens=False``: the string of an added token, such as ``<|endoftext|>``, is that token. Repeated rows are
documents of their own. An empty table writes no file and reads back empty.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator, Sequence
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.llm.batches import lean, pieces, quoted
from mensura.llm.bpe import Memory, encoded
from mensura.llm.files import opened, written
from mensura.llm.pretokens import valid

MAGIC = b"IDPACK1\n"
BLOCK = 1 << 15
HEAD = np.dtype([("magic", "S8"), ("bits", "<u4"), ("block", "<u4")])
TAIL = np.dtype([("n_ids", "<u8"), ("n_docs", "<u8"), ("n_blocks", "<u8"), ("tables", "<u8"), ("magic", "S8")])
MANIFEST = "file string, place int, n_docs long, n_tokens long"


def width_of(vocabulary: int) -> int:
    """Bits of the largest id."""
    return max(1, int(vocabulary - 1).bit_length())


def packed(ids: np.ndarray, bits: int) -> bytes:
    planes = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(planes[:, 32 - bits :]).tobytes()


def unpacked(data: bytes, bits: int, count: int) -> np.ndarray:
    planes = np.zeros((count, 32), np.uint8)
    planes[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits)
    return np.packbits(planes).view(">u4").astype(np.uint32)


class Writer:
    """One file, from consecutive documents."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.waiting, self.held = [], 0
        self.n_ids = 0
        self.blocks, self.names, self.missing, self.starts = array("Q"), array("q"), bytearray(), array("Q")
        self.at = HEAD.itemsize
        out.write(np.array([(MAGIC, bits, block)], HEAD).tobytes())

    def add(self, names: Sequence[int | None], ids: np.ndarray, counts: np.ndarray) -> None:
        begins = self.n_ids + np.cumsum(counts) - counts
        self.starts.extend(begins.tolist())
        self.names.extend(0 if n is None else n for n in names)
        self.missing.extend(n is None for n in names)
        self.n_ids += len(ids)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            self._flush(self.held - self.held % self.block)

    def _flush(self, upto: int) -> None:
        ids = np.concatenate(self.waiting)
        for i in range(0, upto, self.block):
            data = packed(ids[i : min(i + self.block, upto)], self.bits)
            self.blocks.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.waiting, self.held = [ids[upto:]], len(ids) - upto

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        tables = self.at
        for t in (self.blocks, array("Q", [tables]), self.names, self.starts, array("Q", [self.n_ids])):
            self.out.write(t.tobytes())
        self.out.write(bytes(self.missing))
        tail = (self.n_ids, len(self.names), len(self.blocks), tables, MAGIC)
        self.out.write(np.array([tail], TAIL).tobytes())


class Reader:
    """Random access to one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        head = np.frombuffer(source.read_at(HEAD.itemsize, 0), HEAD)[0]
        tail = np.frombuffer(source.read_at(TAIL.itemsize, size - TAIL.itemsize), TAIL)[0]
        if head["magic"] != MAGIC.rstrip(b"\0") or tail["magic"] != MAGIC.rstrip(b"\0"):
            raise ValueError("not a whole file of packed ids")
        self.bits, self.block = int(head["bits"]), int(head["block"])
        self.n_ids, self.n_docs = int(tail["n_ids"]), int(tail["n_docs"])
        n, d, at = int(tail["n_blocks"]), self.n_docs, int(tail["tables"])
        tables = source.read_at(8 * (n + 1 + d + d + 1) + d, at)
        numbers = np.frombuffer(tables, "<u8", n + 1 + d + d + 1)
        self.offsets, self.names, self.starts = numbers[: n + 1], numbers[n + 1 : n + 1 + d].view("<i8"), numbers[n + 1 + d :]
        self.missing = np.frombuffer(tables, np.uint8, d, 8 * len(numbers))

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` (exclusive), from the blocks that hold them."""
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        begin = int(self.offsets[first])
        data = self.source.read_at(int(self.offsets[last + 1]) - begin, begin)
        out = []
        for b in range(first, last + 1):
            part = data[int(self.offsets[b]) - begin : int(self.offsets[b + 1]) - begin]
            out.append(unpacked(part, self.bits, min(self.block, self.n_ids - b * self.block)))
        return np.concatenate(out)[start - first * self.block : end - first * self.block]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first document, end, their ids) in stretches of about ``most`` ids, or one document."""
        at = 0
        while at < self.n_docs:
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + np.uint64(most), "right")) - 1)
            yield at, to, self.ids(int(self.starts[at]), int(self.starts[to]))
            at = to


# --- encoding by the tokenizers library ----------------------------------------------------------


def _byte_letters() -> dict[int, str]:
    """The letter that the byte-level alphabet has for each byte: visible Latin-1 stands for itself, the rest follows from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Library:
    """A worker's tokenizer.

    Where the file pre-tokenises by the plain byte-level rule, the library's model gets each different pre-token once, in the letters that
    stand for bytes. Otherwise whole texts go to the library. Strings of added tokens are looked for first, as the library does: a
    text is cut at them, unless a token also takes white space or wants to stand alone; such texts go to the library whole.
    """

    kept: dict = {}
    LETTERS = _byte_letters()

    def __init__(self, content: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work to the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content.encode(): i for i, t in added.items()}
        longest = sorted(self.added, key=len, reverse=True)  # the leftmost, and of those the longest
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, longest)) + b")") if longest else None
        self.simple = not any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values())
        rules = json.loads(content)
        step = rules.get("pre_tokenizer") or {}
        self.plain = (rules.get("normalizer") is None and step.get("type") == "ByteLevel" and not step.get("add_prefix_space") and step.get("use_regex", True)
                      and rules["model"].get("type") == "BPE" and not rules["model"].get("dropout") and rules.get("truncation") is None and rules.get("padding") is None)
        self.memory = Memory(self.encode, 1_000_000)

    def encode(self, slices: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pre-tokens, how many each has)."""
        model, letters = self.tokenizer.model, self.LETTERS
        found = [[t.id for t in model.tokenize(s.decode("latin-1").translate(letters))] for s in slices]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def whole(self, text: bytes | None) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([valid(text).decode()], add_special_tokens=False)[0].ids, np.int32)

    def texts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each text has)."""
        marked = [i for i, t in enumerate(texts) if t and self.cut and self.cut.search(t)]
        if self.plain and not marked:
            return encoded(self.memory, texts)
        alone = set(range(len(texts)) if not self.plain else [] if self.simple else marked)
        split = set(marked) - alone
        stretches, owner = [], []  # of texts that are cut, every other one is an added token
        for i, t in enumerate(texts):
            for part in self.cut.split(t) if i in split else [None if i in alone else t]:
                stretches.append(part)
                owner.append(i)
        tokens = {j for j, (p, i) in enumerate(zip(stretches, owner)) if i in split and p in self.added}
        ids, counts = encoded(self.memory, [None if j in tokens else p for j, p in enumerate(stretches)])
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for j in tokens:
            parts[j] = np.array([self.added[stretches[j]]], np.int32)
        for j, i in enumerate(owner):
            if i in alone:
                parts[j] = self.whole(texts[i])
        total = np.bincount(owner, list(map(len, parts)), len(texts)).astype(np.int64)
        return np.concatenate([*parts, np.zeros(0, np.int32)]), total

    @classmethod
    def of(cls, shared) -> _Library:
        if shared.value is not cls.kept.get("value"):
            cls.kept = {"value": shared.value, "library": cls(shared.value[0])}
        return cls.kept["library"]


def _content(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size()


def bounds_of(df: DataFrame, doc: str, files: int) -> tuple[int, np.ndarray]:
    """(ranges for null ids, document ids that part the rest): about ``files`` ranges of like many documents; only the ids are read."""
    column = F.col(quoted(doc)).cast("long")
    shares = [i / files for i in range(1, files)]
    wanted = F.percentile_approx(column, shares, max(10_000, 10 * files)) if shares else F.lit(None)
    found = df.select(F.count(column).alias("n"), F.count(F.lit(1)).alias("rows"), wanted.alias("q")).first()
    missing = max(1, round(files * (found.rows - found.n) / max(1, found.rows)))
    return missing, np.array(found.q or [], np.int64)


def _ranges(names: pa.Array, missing: int, bounds: np.ndarray, first: int, place: int) -> tuple[np.ndarray, np.ndarray]:
    """(range, salt) of documents; null ids, and an id that fills several ranges, are dealt over theirs in the order of the salt."""
    salt = np.random.default_rng([place, first]).random(len(names))
    ids = np.asarray(names.fill_null(0))
    low, high = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    spot = low + np.floor(salt * (high - low + 1)).astype(np.int64)
    return np.where(np.asarray(names.is_null()), np.floor(salt * missing), spot + missing).astype(np.int32), salt


def token_rows(df: DataFrame, path: str, bounds: tuple[int, np.ndarray], doc: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """(doc, ids as bytes of 2 or 4 each, range, salt): every text's ids with the end id; the first ranges are those of null ids."""
    shared = df.sparkSession.sparkContext.broadcast((_content(path), *bounds))
    kind = _kind(path)

    def run(batches):
        library, done, place = _Library.of(shared), 0, TaskContext.get().partitionId()
        for piece, texts in pieces(batches):
            ids, counts = library.texts(texts)
            ends = np.cumsum(counts + 1)
            whole = np.full(int(ends[-1]), end_id, kind)
            own = np.ones(len(whole), bool)
            own[ends - 1] = False
            whole[own] = ids
            edges = np.concatenate([[0], ends * kind.itemsize]).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), piece.num_rows, [None, pa.py_buffer(edges), pa.py_buffer(whole)])
            spot, salt = _ranges(piece.column("doc"), *shared.value[1:], done, place)
            done += piece.num_rows
            yield pa.RecordBatch.from_arrays([piece.column("doc"), data, pa.array(spot), pa.array(salt)], ["doc", "ids", "range", "salt"])

    rows = df.select(F.col(quoted(doc)).cast("long").alias("doc"), F.col(quoted(text)).cast("binary").alias("text"))
    return rows.mapInArrow(lean(run), "doc long, ids binary, range int, salt double")


def _kind(path: str) -> np.dtype:
    return np.dtype("<u2" if vocabulary_size(path) <= 1 << 16 else "<u4")


def write_tokens(df: DataFrame, path: str, folder: str, doc: str = "doc_id", text: str = "text", end_id: int = 0,
                 block: int = BLOCK, files: int | None = None) -> list[dict]:
    """Write the ids of all texts to ``folder`` in ascending order of documents; the manifest has a row for each file.

    Ranges of documents become files, a task for each, and about as many as the input has partitions; their bounds come from the ids
    alone, so texts are encoded once.
    """
    bits, kind = width_of(vocabulary_size(path)), _kind(path)
    bounds = bounds_of(df, doc, files or max(1, df.rdd.getNumPartitions()))
    rows = token_rows(df, path, bounds, doc, text, end_id)
    ranged = rows.repartitionById(bounds[0] + len(bounds[1]) + 1, "range").sortWithinPartitions("range", "doc", "salt").select("range", "doc", "ids")

    def parts(batches) -> Iterator[tuple[int, pa.RecordBatch]]:
        """Rows of one range, in stretches."""
        for batch in batches:
            spots = np.asarray(batch.column("range"))
            edges = [0, *(np.flatnonzero(np.diff(spots)) + 1).tolist(), len(spots)]
            for a, b in zip(edges, edges[1:]):
                if a < b:
                    yield int(spots[a]), batch.slice(a, b - a)

    def run(batches):
        for spot, group in groupby(parts(batches), key=lambda x: x[0]):
            name, docs = f"tokens-{spot:06d}.bin", 0
            with written(folder, name) as out:
                writer = Writer(out, bits, block)
                for _, part in group:
                    texts = part.column("ids")
                    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
                    data = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind)
                    writer.add(part.column("doc").to_pylist(), data, np.diff(ends).astype(np.int64) // kind.itemsize)
                    docs += part.num_rows
                writer.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "place": spot, "n_docs": docs, "n_tokens": writer.n_ids}], _MANIFEST)

    made = ranged.mapInArrow(lean(run), MANIFEST).collect()  # a row for each file
    return sorted((r.asDict() for r in made), key=lambda r: r["place"])


_MANIFEST = pa.schema([("file", pa.string()), ("place", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def read_documents(spark: SparkSession, folder: str, manifest: Sequence[dict]) -> DataFrame:
    """(doc_id, start: ids of all documents before it, n_tokens, ids_crc32) of every document, from the files; a task for each."""
    starts = np.concatenate([[0], np.cumsum([m["n_tokens"] for m in manifest])])
    files = [(m["file"], int(s)) for m, s in zip(manifest, starts)]
    if not files:
        return spark.createDataFrame([], READ)

    def run(batches):
        store, at = opened(folder)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                name, before = files[i]
                with store.open_input_file(f"{at}/{name}") as source:
                    reader = Reader(source)
                    for a, b, ids in reader.documents():
                        begins = reader.starts[a : b + 1].astype(np.int64)
                        data = memoryview(ids.astype("<u4")).cast("B")
                        edges = (4 * (begins - begins[0])).tolist()
                        yield pa.RecordBatch.from_arrays([
                            pa.array(reader.names[a:b], pa.int64(), mask=reader.missing[a:b].astype(bool)), pa.array(begins[:-1] + before),
                            pa.array(np.diff(begins)), pa.array([zlib.crc32(data[x:y]) for x, y in zip(edges, edges[1:])], pa.int64()),
                        ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(files), 1, len(files)).mapInArrow(lean(run), READ)


def read_slice(folder: str, manifest: Sequence[dict], start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end`` of the whole corpus, from the few files and blocks that hold them."""
    store, at = opened(folder)
    out, before = [], 0
    for m in manifest:
        a, b = max(start - before, 0), min(end - before, m["n_tokens"])
        if a < b:
            with store.open_input_file(f"{at}/{m['file']}") as source:
                out.append(Reader(source).ids(a, b))
        before += m["n_tokens"]
    return np.concatenate(out) if out else np.zeros(0, np.uint32)
