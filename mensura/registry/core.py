"""Registration, table access and derived views shared by queries and their SQL oracles."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mensura.registry.views import VIEWS
from mensura.session import cut
from mensura.sources.records import spread

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

WORDY = {"documents", "pages", "conversations", "events"}  # costly per row
KEPT = {"graph_edges"}  # views of several joins that a query reads more than once

REGISTRY: dict[str, tuple[Callable[["Tables"], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with the SQL that must give the same rows."""
    def register(fn: Callable[["Tables"], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = (fn, sql)
        return fn
    return register


def _mentioned(text: str, names) -> list[str]:
    words = set(re.findall(r"\b(?:FROM|JOIN)\s+([A-Za-z_][A-Za-z_0-9]*)", text))
    return [n for n in names if n in words]


class Tables:
    """Driver tables and derived views of one data folder, read lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._seen: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return os.path.join(self.folder, f"{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BASE and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._seen:
            if name in BASE:
                table = self.spark.read.parquet(self.path(name))
                self._seen[name] = spread(table) if name in WORDY else table
            else:
                view = self.sql(VIEWS[name])
                self._seen[name] = cut(view) if name in KEPT else view
        return self._seen[name]

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over base tables and views, named in braces for Spark and plainly for the oracle."""
        names = _mentioned(text, [*BASE, *VIEWS])
        for n in names:
            text = re.sub(rf"(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", text)
        used = {n: getattr(self, n) for n in names if "{" + n + "}" in text}
        return self.spark.sql(text, **used)


def with_views(text: str) -> str:
    """Prefix an oracle text with the views it uses, in dependency order."""
    chosen: list[str] = []

    def need(body: str) -> None:
        for name in _mentioned(body, VIEWS):
            if name not in chosen and body is not VIEWS[name]:
                need(VIEWS[name])
                if name not in chosen:
                    chosen.append(name)

    need(text)
    if not chosen:
        return text
    ctes = ",\n".join(f"{n} AS MATERIALIZED (\n{VIEWS[n].strip()}\n)" for n in chosen)
    body = text.strip()
    if re.match(r"WITH RECURSIVE\b", body, re.I):
        return f"WITH RECURSIVE {ctes},\n{body[len('WITH RECURSIVE'):].strip()}"
    if re.match(r"WITH\b", body, re.I):
        return f"WITH {ctes},\n{body[4:].strip()}"
    return f"WITH {ctes}\n{body}"


def oracle_texts() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in REGISTRY.items() if sql}


def r(c: Column | str, digits: int = 6) -> Column:
    """Round a double for comparison; adding zero turns -0.0 into 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: r(n, digits) for n in names})


def big(df: DataFrame, *names: str) -> DataFrame:
    """Counts as BIGINT, the type the oracles use."""
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})
