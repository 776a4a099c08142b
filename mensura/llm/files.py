"""Files in a folder that all executors share, written so that a lost executor leaves nothing half done.

Folders are named as Spark names them (``file:/...``, ``hdfs://...``, ``s3a://...``).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession

from mensura.session import shared_folder


def new_folder(spark: SparkSession, kind: str) -> str:
    """The name of a folder of its own below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    folder = re.sub(r"^file:/*", "file:///", folder)
    folder = re.sub(r"^s3[an]:", "s3:", folder)
    return fs.FileSystem.from_uri(folder if re.match(r"^\w+:", folder) else f"file://{folder}")


@contextmanager
def written(folder: str, name: str) -> Iterator:
    """A stream to a new file, which gets its name once it is whole. Attempts of one task write the same bytes."""
    store, at = opened(folder)
    store.create_dir(at, recursive=True)
    task = TaskContext.get()
    trial = f"{at}/.{name}.{task.taskAttemptId() if task else uuid.uuid4().hex}"
    with store.open_output_stream(trial, compression=None) as out:
        yield out
    store.move(trial, f"{at}/{name}")
