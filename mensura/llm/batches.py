"""Whole texts in bounded pieces, for the operators that work on Arrow batches.

An operator gets its rows as ``row`` (a struct of the caller's columns, whatever their names are) and ``text`` (UTF-8
bytes), and returns ``row`` with its own columns beside it, so that no name of the input can clash with one of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PIECE_BYTES = 1 << 20  # texts that are worked on at once; a longer text is a piece of its own


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(df: DataFrame, text: str, keep: Sequence[str] | None = None) -> DataFrame:
    """(row, text): the kept columns (all, unless named) as one struct, and the text as bytes; no text where the row has it."""
    keep = df.columns if keep is None else list(keep)
    row = F.struct(*[F.col(quoted(c)) for c in keep]).alias("row")
    if text in keep and df.schema[text].dataType in (T.StringType(), T.BinaryType()):
        return df.select(row)
    return df.select(row, F.col(quoted(text)).cast("binary").alias("text"))


def text_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The texts of a batch of ``carried``, as bytes."""
    if "text" in batch.schema.names:
        return batch.column("text")
    row = batch.column("row")
    return row.field(row.type.get_field_index(name)).cast(pa.binary())


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same work; what it used goes back to the system, as the worker process waits for other tasks afterwards."""
    def ran(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # not every C library can
            ctypes.CDLL(None).malloc_trim(0)

    return ran


def pieces(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = PIECE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """The batches in slices of at most ``limit`` bytes of text, or one row, with the texts.

    ``column`` names the text within ``row`` where there is no column of texts.
    """
    for batch in batches:
        texts = text_of(batch, column)
        if not len(texts):
            continue
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at), texts.slice(at, to - at).to_pylist()
            at = to
        del batch, texts  # before the next one is read


def each_piece(df: DataFrame, work: Callable[[list], dict], columns: str, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``row`` and the columns that ``work`` makes of a piece's texts (a list of bytes or None), by Arrow batches.

    ``columns`` declares them in Spark's DDL; ``work`` returns a list, numpy or Arrow array for each name.
    """
    rows = carried(df, text, keep)
    schema = T.StructType([rows.schema["row"], *T.StructType.fromDDL(columns).fields])
    names = [f.name for f in schema.fields[1:]]
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[1:]]

    def run(batches):
        for piece, texts in pieces(batches, text):
            made = work(texts)
            arrays = [made[n] if isinstance(made[n], pa.Array) else pa.array(made[n], kind) for n, kind in zip(names, kinds)]
            yield pa.RecordBatch.from_arrays([piece.column("row"), *arrays], ["row", *names])
            del piece, texts, made, arrays

    return rows.mapInArrow(lean(run), schema)


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary lies, by the package that holds them; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
