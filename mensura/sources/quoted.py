"""Records of delimited text with quoted fields, from files of any size, cut into many tasks.

A quoted field may hold line ends, so a line alone does not say whether it begins a record. What a stretch of lines does is a function
of the state before it, inside or outside a quoted field, to the state after it. Each task composes the functions of its
lines; the functions of all stretches, one row for each, are composed in the order of the file and give every stretch its first
state. Then each task cuts its stretch at the true ends of records. A record that goes on in the next stretch is put together from the
pieces of both, or of all that it spans.

Fields are parted by a comma. A field that begins with a quote ends with a quote that no other follows; two quotes stand for one. Quotes
elsewhere mean nothing. A quoted field that is never closed goes on to the end of its file.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator
from io import StringIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
CORRUPT = "_corrupt_record"
_PLACE = "file string, start long"


def goes_on(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at the end of the line, which begins inside one or at a field's start."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            inside = False
        elif line.startswith('"', at):
            inside = True
            at += 1
            continue
        at = line.find(",", at) + 1
        if not at:
            return False


def _stretches(batches) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """The lines of each batch, by the stretch of a file that they lie in."""
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, files = np.asarray(batch.column("start")), batch.column("file").dictionary_encode()
        kind = np.asarray(files.indices)
        edges = [0, *(np.flatnonzero((starts[1:] != starts[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(starts)]
        for a, b in zip(edges, edges[1:]):
            yield (files.dictionary[int(kind[a])].as_py(), int(starts[a])), batch.column("value").slice(a, b - a)


def _quoted(lines: pa.Array) -> list[int]:
    return np.flatnonzero(np.asarray(pc.match_substring(lines, '"'))).tolist()


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): the lines, and the stretch of the file that a task reads with them."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def first_states(lines: DataFrame) -> dict[tuple[str, int], bool]:
    """Whether each stretch (file, start) begins inside a quoted field; one row for each stretch comes to the driver."""
    def run(batches):
        at, ends = None, [False, True]
        for place, values in _stretches(batches):
            if place != at:
                if at:
                    yield row(at, ends)
                at, ends = place, [False, True]
            for i in _quoted(values):
                line = values[i].as_py()
                out, in_ = goes_on(line, False), goes_on(line, True)
                ends = [in_ if e else out for e in ends]
        if at:
            yield row(at, ends)

    def row(place, ends):
        return pa.RecordBatch.from_pylist([{"file": place[0], "start": place[1], "outside": ends[0], "inside": ends[1]}],
                                          pa.schema([("file", pa.string()), ("start", pa.int64()), ("outside", pa.bool_()), ("inside", pa.bool_())]))

    found = lines.mapInArrow(run, _PLACE + ", outside boolean, inside boolean").collect()
    states, file, state = {}, None, False
    for r in sorted(found, key=lambda r: (r.file, r.start)):
        state = state if r.file == file else False
        file = r.file
        states[r.file, r.start] = state
        state = r.inside if state else r.outside
    return states


def records_of(spark: SparkSession, path: str, header: bool = True, states: dict[tuple[str, int], bool] | None = None) -> DataFrame:
    """(record, start, nth): every record as it stands in its file, with line ends inside quotes, and its place; without empty lines.

    ``nth`` counts from 0 within a stretch. The first record of each file is left out with ``header``. ``states`` are those of
    :func:`first_states`, where they are known.
    """
    lines = lines_of(spark, path)
    shared = spark.sparkContext.broadcast(first_states(lines) if states is None else states)
    schema = pa.schema([("record", pa.string()), ("file", pa.string()), ("start", pa.int64()), ("nth", pa.int64()), ("head", pa.bool_()), ("open", pa.bool_())])

    def run(batches):
        at, state, n, first, waiting = None, False, 0, True, []

        def joined(lines: list[str]) -> pa.Array:
            nonlocal waiting
            record, waiting = "\n".join([*waiting, *lines]), []
            return pa.array([record], pa.string())

        def out(records: pa.Array, head: bool, opened: bool) -> pa.RecordBatch:
            nonlocal n
            k = len(records)
            n += k
            file = pa.array([at[0]] * k) if head or opened else pa.nulls(k, pa.string())  # only pieces are put together by file
            return pa.RecordBatch.from_arrays([
                records, file, pa.array([at[1]] * k, pa.int64()), pa.array(np.arange(n - k, n)), pa.array([head] * k), pa.array([opened] * k)], schema=schema)

        for place, values in _stretches(batches):
            if place != at:
                if waiting:
                    yield out(joined([]), first, True)
                at, state, n, waiting = place, shared.value[place], 0, []
                first = state  # what comes first belongs to a record of an earlier stretch
            ends = np.full(len(values), state)  # whether a record goes on after the line
            for i in _quoted(values):
                now = goes_on(values[i].as_py(), state)
                if now != state:
                    ends[i:] = state = now
            closing = np.flatnonzero(~ends)
            if not len(closing):
                waiting += values.to_pylist()
                continue
            begin = np.concatenate([[0], closing[:-1] + 1])
            several = np.flatnonzero(closing > begin).tolist()  # records of more than one line
            if (waiting or first) and several[:1] != [0]:
                several.insert(0, 0)
            done = 0
            for k in several:
                if done < begin[k]:
                    yield out(values.slice(done, begin[k] - done), False, False)
                yield out(joined(values.slice(begin[k], closing[k] + 1 - begin[k]).to_pylist()), first, False)
                first, done = False, closing[k] + 1
            if done <= closing[-1]:
                yield out(values.slice(done, closing[-1] + 1 - done), False, False)
            waiting = values.slice(closing[-1] + 1).to_pylist()
        if waiting:
            yield out(joined([]), first, True)

    pieces = lines.mapInArrow(run, "record string, file string, start long, nth long, head boolean, open boolean")
    whole = pieces.filter(~F.col("head") & ~F.col("open"))
    # Pieces of records that several stretches share: two for each stretch at most. A piece that does not go on from an earlier one begins a record.
    order = Window.partitionBy("file").orderBy("start", "nth")
    parts = pieces.filter("head OR open").withColumn("which", F.sum(F.when(F.col("head"), 0).otherwise(1)).over(order))
    joined = parts.groupBy("file", "which").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "nth", "record"))), lambda x: x["record"]), "\n").alias("record"),
        F.min(F.struct("start", "nth")).alias("place"))
    records = whole.select("record", "start", "nth").union(joined.select("record", "place.start", "place.nth"))
    records = records.withColumn("record", F.regexp_replace("record", r"\r$", ""))  # of a line end in two characters
    if header:
        records = records.filter((F.col("start") > 0) | (F.col("nth") > 0))
    return records.filter("record <> ''")


def header_of(spark: SparkSession, path: str, states: dict[tuple[str, int], bool]) -> list[str]:
    """The column names: the fields of the first record of the first file that begins with one; only its lines come to the driver."""
    lines = lines_of(spark, path)
    for file in sorted({file for file, _ in states}):
        record, inside = [], False
        for start in sorted(start for name, start in states if name == file):  # a record may span stretches
            at = F.when(F.col("value").isNotNull(), F.struct("file", "start"))  # not of the place alone: fewer files would be cut into other stretches
            here, most = lines.filter((at["file"] == file) & (at["start"] == start)).select("value"), 1
            while True:
                head, found, state = here.take(most), [], inside
                for r in head:
                    found.append(r.value)
                    state = goes_on(r.value, state)
                    if not state:
                        break
                if (found and not state) or len(head) < most:
                    break
                most *= 16
            record, inside = record + found, state
            if not inside:
                break
        if text := "\n".join(record).removesuffix("\r"):
            return next(csv.reader(StringIO(text, newline="")))
    return []


def parsed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The record column as ``schema``'s columns and ``_corrupt_record``: the record itself where it does not fit, else null."""
    full = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in full.fields)
    return records.select(F.from_csv("record", F.lit(ddl), OPTIONS | {"columnNameOfCorruptRecord": CORRUPT}).alias("_r")).select("_r.*")


KINDS = ["int", "bigint", "double", "date", "timestamp", "boolean"]


def _fits(column: str, kind: str):
    value = F.col(f"`{column}`")
    plain = value.try_cast(kind).isNotNull() & (value == F.trim(value))
    return value.isNull() | (plain & value.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") if kind == "date" else plain)


def inferred(texts: DataFrame) -> T.StructType:
    """For each column of texts the first of ``KINDS`` that all its values fit, else text; one pass, one row."""
    some = [F.count(F.col(f"`{c}`")) for c in texts.columns]
    row = texts.agg(*some, *[F.bool_and(_fits(c, k)) for c in texts.columns for k in KINDS]).first()
    n = len(texts.columns)
    kinds = [next((k for j, k in enumerate(KINDS) if row[i] and row[n + i * len(KINDS) + j]), "string") for i in range(n)]
    return T.StructType([T.StructField(c, T.StructType.fromDDL(f"x {k}")[0].dataType) for c, k in zip(texts.columns, kinds)])
