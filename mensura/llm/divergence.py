"""Source divergence audit: which sources of a language use other terms than the rest, by chunk factorization.

Texts are split at ASCII white space into chunks, which are counted for each document; a task hands on one row for each language and
chunk, with the occurrences by source. The rows of a chunk meet, and each globally distinct chunk is cut into terms once, whose
counts are then those of the chunk's rows, joined back. Terms are runs of ASCII letters and of code points from U+0080 on, with A-Z in lower
case; no term holds white space, so none is lost between chunks.

A language keeps the terms that are in at least ``least`` of its documents. For that, a chunk's row names its documents until there are
``least`` of them. A term is kept if one of its chunks is in enough documents; if all its chunks together are in too few, it is not;
between the two, its documents are counted, each once however many of its chunks hold the term. So nobody holds a long list of
documents, and the answer is exact.

Shares are whole numbers of ``UNIT`` parts, and all sums and quotients are exact. The divergence of two sources is summed over all kept
terms, in tasks that hold a square of at most ``SIDE`` by ``SIDE`` sources and share out the terms; terms that neither side has are counted,
not visited.

Null text, lang and source are read as empty; rows are documents, so repeated rows count again and doc_id is not read. A group without terms
gives its pairs; a language that keeps no term gives pairs of value 0; a language of one source has no pairs. Ties go by the bytes of
the item. An empty table gives an empty result. Only the named columns are read, so no other column can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.llm.batches import lean, pieces, quoted
from mensura.llm.bpe import ramps
from mensura.llm.files import new_folder
from mensura.llm.pretokens import valid
from mensura.session import cut

LEAST, TOP, UNIT = 10, 10, 1_000_000_000
SIDE = 256
HELD_WORDS, HELD_CHUNKS = 4_000_000, 1_000_000  # chunks that a task holds before it hands on its rows
SEGMENT = 1 << 20
_TERM = re.compile(rb"[A-Za-z\x80-\xFF]+")  # of UTF-8: bytes from 0x80 on are those of code points from U+0080 on
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
PACKED = "lang string, chunk binary, names binary, numbers binary"


def segments(text: bytes) -> Iterator[bytes]:
    """A long text in stretches that end at white space."""
    at = 0
    while len(text) - at > SEGMENT:
        found = _WHITE.search(text, at + SEGMENT)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:] if at else text


def terms_of(chunk: bytes) -> dict[bytes, int]:
    """The terms of a chunk and how often it holds them."""
    out: dict[bytes, int] = {}
    for t in _TERM.findall(chunk):
        t = t.lower()  # of bytes: A-Z
        out[t] = out.get(t, 0) + 1
    return out


class Numbers(dict):
    """Numbers things in the order in which they are first asked for."""

    def __missing__(self, thing) -> int:
        self[thing] = at = len(self)
        return at


class Counter:
    """Chunks of documents, handed on as one row for each language and chunk."""

    def __init__(self, place: int, least: int):
        self.least, self.next = least, place << 36
        self.clear()

    def clear(self) -> None:
        self.place, self.groups = Numbers(), Numbers()
        self.words, self.counts, self.group_of, self.held = [], [], [], 0

    def add(self, group: tuple[str, str], text: bytes) -> None:
        at = self.place.__getitem__
        n = 0
        for part in segments(text):
            words = part.split()
            self.words.append(np.fromiter(map(at, words), np.int32, len(words)))
            n += len(words)
        self.counts.append(n)
        self.group_of.append(self.groups[group])
        self.held += n

    def full(self) -> bool:
        return self.held >= HELD_WORDS or len(self.place) >= HELD_CHUNKS

    def rows(self) -> Iterator[pa.RecordBatch]:
        """All rows of what is held, which is then forgotten."""
        if self.held:
            yield from self._rows()
        self.next += len(self.counts)
        self.clear()

    def _rows(self) -> Iterator[pa.RecordBatch]:
        names = list(self.groups)
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(len(names))
        names = [names[i] for i in order]
        group = rank[np.array(self.group_of)]
        by_group = np.argsort(group, kind="stable")  # documents by language, then source
        place = np.empty(len(group), np.int64)
        place[by_group] = np.arange(len(group))
        n_docs = len(group)
        pairs = np.concatenate(self.words).astype(np.int64) * n_docs + np.repeat(place, self.counts)
        pairs, n = np.unique(pairs, return_counts=True)  # chunk, language, source, document
        chunk, doc = np.divmod(pairs, n_docs)
        doc = by_group[doc]
        which = group[doc]
        lang_of = np.unique(np.array([a for a, _ in names], object), return_inverse=True)[1]  # names ascend, so numbers do
        lang = lang_of[which]
        new_row = np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (lang[1:] != lang[:-1])])
        new_cell = new_row | np.concatenate([[True], which[1:] != which[:-1]])
        row_at, cell_at = np.flatnonzero(new_row), np.flatnonzero(new_cell)
        counts = np.add.reduceat(n, cell_at)
        sources = pa.array([s for _, s in names], pa.string()).take(pa.array(which[cell_at]))
        cell_edges = np.searchsorted(cell_at, np.concatenate([row_at, [len(n)]])).astype(np.int32)
        sizes = np.diff(np.concatenate([row_at, [len(n)]]))
        few = sizes < self.least
        docs = doc[ramps(row_at[few], sizes[few])] + self.next
        edges = np.concatenate([[0], np.cumsum(np.where(few, sizes, 0))])
        table = pa.table({
            "lang": pa.array([a for a, _ in names], pa.string()).take(pa.array(which[row_at])),
            "chunk": pa.array(list(self.place), pa.binary()).take(pa.array(chunk[row_at])),
            "sources": pa.ListArray.from_arrays(pa.array(cell_edges), sources),
            "counts": pa.ListArray.from_arrays(pa.array(cell_edges), pa.array(counts)),
            "docs": pa.ListArray.from_arrays(pa.array(edges.astype(np.int32), pa.int32()), pa.array(docs, pa.int64()), mask=pa.array(~few)),
        })
        yield from table.to_batches(max_chunksize=10_000)


def _values(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """(lengths, values) of lists; nulls have the length 0."""
    return np.diff(np.asarray(lists.offsets)), lists.flatten()


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, memoryview]:
    """(offsets, bytes) of binary or string values."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return offsets, memoryview(texts.buffers()[2] or b"")


def packed(rows: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, chunk, names, numbers) from (lang, chunk, sources, counts, docs): the lists in two values, which Spark moves faster.

    ``names`` joins the sources; ``numbers`` has how many there are, how many documents (-1: no list), the bytes of each name, the counts, the documents.
    """
    cells, sources = _values(rows.column("sources"))
    counts = np.asarray(rows.column("counts").flatten())
    sizes, docs = _values(rows.column("docs"))
    ends, data = _bytes_of(sources)
    edges = np.concatenate([[0], np.cumsum(cells)])
    width = 2 + 2 * cells + sizes
    begin = np.cumsum(width) - width
    flat = np.empty(int(width.sum()), np.int64)
    flat[begin], flat[begin + 1] = cells, np.where(np.asarray(rows.column("docs").is_null()), -1, sizes)
    flat[ramps(begin + 2, cells)] = np.diff(ends)
    flat[ramps(begin + 2 + cells, cells)] = counts
    flat[ramps(begin + 2 + 2 * cells, sizes)] = np.asarray(docs)
    at = (ends[edges] - ends[0]).tobytes()
    names = pa.Array.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer(at), pa.py_buffer(data[ends[0] : ends[-1]])])
    at = np.concatenate([begin, [len(flat)]]).astype(np.int32) * 8
    numbers = pa.Array.from_buffers(pa.binary(), len(cells), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(flat)])
    return pa.RecordBatch.from_arrays([rows.column("lang"), rows.column("chunk"), names, numbers], ["lang", "chunk", "names", "numbers"])


def unpacked(rows: pa.RecordBatch) -> tuple[pa.ListArray, pa.ListArray, pa.ListArray, np.ndarray]:
    """(sources, counts, docs, whether there is no list of documents) of ``packed`` rows."""
    def lists(sizes, values):
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)

    at, data = _bytes_of(rows.column("numbers"))
    flat, begin = np.frombuffer(data[at[0] : at[-1]], np.int64), (at[:-1] - at[0]) // 8
    cells, sizes = flat[begin], flat[begin + 1]
    held = np.maximum(sizes, 0)
    counts, docs = flat[ramps(begin + 2 + cells, cells)], flat[ramps(begin + 2 + 2 * cells, held)]
    lengths = flat[ramps(begin + 2, cells)]
    at, data = _bytes_of(rows.column("names"))
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    sources = pa.Array.from_buffers(pa.string(), len(lengths), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[at[0] : at[-1]])])
    return lists(cells, sources), lists(cells, pa.array(counts)), lists(held, pa.array(docs)), sizes < 0


def _changes(values: pa.Array) -> np.ndarray:
    """For each but the first, whether it differs from the one before."""
    return np.asarray(pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)))


def chunk_rows(docs: DataFrame, least: int) -> DataFrame:
    """``packed`` rows (lang, chunk, sources, counts, docs) from (lang, source, text); docs is null where there are ``least`` of them or more.

    A document is named by its partition and place there, so the table should give the same rows when it is read again.
    """
    def run(batches):
        counter = Counter(TaskContext.get().partitionId(), least)
        for piece, texts in pieces(batches):
            langs, sources = piece.column("lang").to_pylist(), piece.column("source").to_pylist()
            for lang, source, text in zip(langs, sources, texts):
                counter.add((lang, source), valid(text))
                if counter.full():
                    yield from map(packed, counter.rows())
        yield from map(packed, counter.rows())

    return docs.select("lang", "source", "text").mapInArrow(lean(run), PACKED)


def _joined(lists: pa.ListArray, edges: np.ndarray) -> pa.ListArray:
    """The lists of consecutive rows, from each edge to the next, as one list."""
    offsets = np.asarray(lists.offsets)
    return pa.ListArray.from_arrays(pa.array(offsets[edges], pa.int32()), lists.values)


def term_rows(chunks: DataFrame, least: int) -> DataFrame:
    """(lang, term, sources, counts, docs) from the rows of chunks: those of a chunk meet, and it is cut into terms once."""
    met = chunks.repartition("chunk").sortWithinPartitions("chunk", "lang")

    def run(batches):
        last, found = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(np.concatenate([[True], _changes(batch.column("chunk")) | _changes(batch.column("lang"))]))
            edges = np.concatenate([starts, [batch.num_rows]])
            sources, counts, docs, unlisted = unpacked(batch)
            sources, counts, docs = (_joined(x, edges) for x in (sources, counts, docs))
            lacking = np.add.reduceat(unlisted.astype(np.int64), starts) > 0
            enough = lacking | (np.diff(np.asarray(docs.offsets)) >= least)
            words, langs = batch.column("chunk").take(pa.array(starts)), batch.column("lang").take(pa.array(starts))
            spot, times, terms = [], [], []
            for k, word in enumerate(words.to_pylist()):
                if word != last:
                    last, found = word, terms_of(word)
                for term, n in found.items():
                    spot.append(k)
                    times.append(n)
                    terms.append(term)
            if not spot:
                continue
            take, times = pa.array(spot), np.array(times)
            counts = counts.take(take)
            sizes = np.diff(np.asarray(counts.offsets))
            values = np.asarray(counts.flatten()) * np.repeat(times, sizes)
            mask = enough[spot]
            docs = docs.take(take)
            yield pa.RecordBatch.from_arrays([
                langs.take(take), pa.array(terms, pa.binary()).cast(pa.string()), sources.take(take),
                pa.ListArray.from_arrays(counts.offsets, pa.array(values, pa.int64())),
                pa.ListArray.from_arrays(docs.offsets, docs.values, mask=pa.array(mask)),
            ], ["lang", "term", "sources", "counts", "docs"])

    return met.mapInArrow(lean(run), "lang string, term string, sources array<string>, counts array<long>, docs array<long>")


def kept_terms(rows: DataFrame, least: int) -> DataFrame:
    """(lang, term) of the terms in at least ``least`` documents of the language."""
    known = rows.groupBy("lang", "term").agg(F.max(F.col("docs").isNull()).alias("enough"), F.sum(F.size("docs")).alias("most"))
    known = cut(known.filter(F.col("enough") | (F.col("most") >= least)))
    named = rows.filter(F.col("docs").isNotNull()).join(known.filter(~F.col("enough")).select("lang", "term"), ["lang", "term"])
    counted = named.select("lang", "term", F.explode("docs").alias("doc")).distinct().groupBy("lang", "term").agg(F.count(F.lit(1)).alias("n"))
    return known.filter("enough").select("lang", "term").union(counted.filter(F.col("n") >= least).select("lang", "term"))


def share(count: Column, total: Column, unit: int = UNIT) -> Column:
    """1 + floor(unit * count / total) for count <= total, in whole numbers that stay far below 2 ** 63; ``unit`` is a power of 1000."""
    rest, out = count, F.lit(0).cast("long")
    while unit > 1:
        rest = rest * 1000
        out = out * 1000 + F.call_function("div", rest, total)
        rest = rest % total
        unit //= 1000
    return out + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _squares(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The divergence of every column of p from every column of q, summed over the rows."""
    out = np.zeros((p.shape[1], q.shape[1]), np.int64)
    for i in range(p.shape[1]):
        x = p[:, i : i + 1]
        apart = x - q
        out[i] = (apart * apart // (x + q)).sum(0)
    return out


class Square:
    """The sums of one square: sources of block ``x`` by those of block ``y`` of a language, over a share of its terms."""

    def __init__(self, lang: str, x: int, y: int, side: int):
        self.lang, self.x, self.y, self.side = lang, x, y, side
        self.lacking = np.zeros(2 * side, np.int64)  # the share of a term that the source lacks; 0: no such source
        self.total, self.seen, self.held = None, 0, []

    def places(self, s: np.ndarray) -> np.ndarray:
        return s % self.side + np.where(s // self.side == self.x, 0, self.side)

    def add(self, rows: pa.RecordBatch) -> None:
        heads = rows.column("term").null_count  # they come first
        if heads:
            self.lacking[self.places(np.asarray(rows.column("s").slice(0, heads)))] = np.asarray(rows.column("p").slice(0, heads))
        rows = rows.slice(heads)
        if not rows.num_rows:
            return
        if self.held and sum(r.num_rows for r in self.held) >= 4096 and rows.column("term")[0] != self.held[-1].column("term")[-1]:
            self.visit()  # no term goes on in the next rows
        self.held.append(rows)

    def visit(self) -> None:
        first, second = np.flatnonzero(self.lacking[: self.side]), np.flatnonzero(self.lacking[self.side :]) + self.side
        self.sides = (first, first if self.x == self.y else second)
        if self.total is None:
            self.total = np.zeros(tuple(map(len, self.sides)), np.int64)
        if not self.held:
            return
        rows = pa.Table.from_batches(self.held)
        self.held = []
        names = np.asarray(rows.column("term").combine_chunks().dictionary_encode().indices)
        row = np.concatenate([[0], np.cumsum(names[1:] != names[:-1])])
        shares = np.repeat(self.lacking[None, :], int(row[-1]) + 1, 0)
        shares[row, self.places(np.asarray(rows.column("s")))] = np.asarray(rows.column("p"))
        self.total += _squares(*(shares[:, at] for at in self.sides))
        self.seen += len(shares)

    def result(self) -> pa.RecordBatch:
        self.visit()
        i, j = (x.ravel() for x in np.indices(self.total.shape))
        a, b = self.sides[0][i] % self.side + self.x * self.side, self.sides[1][j] % self.side + self.y * self.side
        some = a < b
        n = int(some.sum())
        return pa.RecordBatch.from_arrays([
            pa.array([self.lang] * n, pa.string()), pa.array(a[some]), pa.array(b[some]), pa.array(self.total.ravel()[some]),
            pa.array(np.full(n, self.seen))], ["lang", "a", "b", "value", "seen"])


def pair_sums(terms: DataFrame, groups: DataFrame, shares: int, side: int = SIDE) -> DataFrame:
    """(lang, a, b, value) for sources a < b of a language, by their numbers.

    ``terms`` has (lang, term, s, p) for the terms that a source holds, ``groups`` (lang, s, p0, terms_kept, squares) for every source.
    Each task holds a square of sources and a share of the terms; the first rows of a square give its sources' shares of a term that
    they lack.
    """
    def placed(rows: DataFrame, salts: Column) -> DataFrame:
        block = F.floor(F.col("s") / side).cast("int")
        rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("squares") - 1)))
        return rows.select(
            "lang", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), salts.alias("salt"), "term", "s", "p")

    own = placed(terms.join(groups.select("lang", "s", "squares"), ["lang", "s"]), F.pmod(F.xxhash64("term"), F.lit(shares)))
    heads = groups.select("lang", "s", F.col("p0").alias("p"), "squares", F.lit(None).cast("string").alias("term"))
    rows = placed(heads, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))).union(own)
    key = ["lang", "x", "y", "salt"]
    dealt = rows.repartition(*key).sortWithinPartitions(*key, F.col("term").asc_nulls_first())

    def run(batches):
        square, at_key = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in key)))
            edges = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for at, to in zip(edges, edges[1:]):
                if at == to:
                    continue
                if keys[at] != at_key:
                    if square:
                        yield square.result()
                    at_key = keys[at]
                    square = Square(*at_key[:3], side)
                square.add(batch.slice(at, to - at))
        if square:
            yield square.result()

    found = dealt.mapInArrow(lean(run), "lang string, a long, b long, value long, seen long")
    summed = found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    one, two = (groups.select("lang", F.col("s").alias(n), F.col("p0").alias(f"p{n}"), "terms_kept") for n in "ab")
    whole = summed.join(one, ["lang", "a"]).join(two.drop("terms_kept"), ["lang", "b"])
    return whole.select("lang", "a", "b", (F.col("value") + (F.col("terms_kept") - F.col("seen")) * divergence(F.col("pa"), F.col("pb"))).alias("value"))


def audit(
    df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP, side: int = SIDE,
) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language by its divergence, part ``term`` the ``top``
    terms that set the source apart from its language."""
    spark = df.sparkSession
    docs = df.select(*[F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source))],
                     F.col(quoted(text)).cast("binary").alias("text"))
    folder = new_folder(spark, "terms")
    term_rows(chunk_rows(docs, least), least).write.parquet(folder)
    rows = spark.read.parquet(folder)
    kept = cut(kept_terms(rows, least))
    held = rows.join(kept, ["lang", "term"]).select("lang", "term", F.inline(F.arrays_zip("sources", "counts")))
    held = held.groupBy("lang", F.col("sources").alias("source"), "term").agg(F.sum("counts").alias("n"))
    held = cut(held)

    # A row for each (lang, source), and for each lang: few beside the documents.
    sizes = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = docs.select("lang").distinct().join(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v")), "lang", "left")
    langs = langs.join(sizes.groupBy("lang").agg(F.sum("total").alias("whole")), "lang", "left")
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(langs, "lang")
    number = Window.partitionBy("lang").orderBy("source")
    groups = groups.select(
        "lang", "source", (F.row_number().over(number) - 1).cast("long").alias("s"), F.coalesce("v", F.lit(0)).alias("terms_kept"),
        (F.coalesce("total", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("d"), (F.coalesce("whole", F.lit(0)) + 2 * F.coalesce("v", F.lit(0))).alias("dl"))
    p0 = F.when(F.col("d") > 0, share(F.lit(2).cast("long"), F.col("d"))).otherwise(1)
    squares = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / side).cast("int")
    groups = cut(groups.withColumn("p0", p0.cast("long")).withColumn("squares", squares))

    terms = held.join(groups, ["lang", "source"]).select("lang", "term", "source", "s", "n", share(F.col("n") + 2, F.col("d")).alias("p"), "dl")
    shares = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sums = cut(pair_sums(terms.select("lang", "term", "s", "p"), groups, shares, side))
    both = sums.union(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    one, two = (groups.select("lang", F.col("s").alias(n), F.col("source").alias(name)) for n, name in (("a", "source"), ("b", "item")))
    pairs = both.join(one, ["lang", "a"]).join(two, ["lang", "b"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")

    across = held.groupBy("lang", "term").agg(F.sum("n").alias("nl"))
    told = terms.join(across, ["lang", "term"]).withColumn("q", share(F.col("nl") + 2, F.col("dl"))).filter("p > q")
    told = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).union(told.withColumn("rank", rank).filter(F.col("rank") <= top))
