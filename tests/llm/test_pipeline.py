"""The registered queries of this folder against SQL, and the pipeline against a brute-force version."""

import hashlib
import os

import duckdb
import public_tokenizers
import pytest
import tiktoken
from awkward import AWKWARD, documents
from pyspark.sql import functions as F
from test_decontaminate import words
from test_jaccard import brute as components
from test_quality import brute as measured

import corpus_pipeline
from mensura.llm import bpe, queries, secrets

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in os.listdir(DATA):
        db.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{t}'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = db.execute(queries.SQL[name])
    head = [d[0] for d in cursor.description]
    assert sorted(head) == columns
    theirs = sorted(repr(tuple(r[head.index(c)] for c in columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == theirs


def redacted(text):
    import re

    spans = sorted((m.start(), m.end()) for r in secrets.RULES for m in re.finditer(r.pattern, text) if len(m[r.group]) >= r.least)
    out, at = "", 0
    for a, b in spans:
        out += text[at : max(a, at)] + ("[SECRET]" if a >= at else "")
        at = max(at, b)
    return out + text[at:]


def test_pipeline_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    items = [words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + min(13, len(w))]) for w in items if w for i in range(len(w) - min(13, len(w)) + 1)}
    sizes = {len(w) for w in windows}

    def good(text):
        n, chars, symbols, lines, dup, repeated = measured(text)
        return not (n < 50 or 100 * repeated > 50 * n or symbols > n or chars < 2 * n or chars > 20 * n or 10 * dup > 7 * lines)

    def clean(text):
        ws = words(text)
        hit = {i + j for n in sizes for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in windows for j in range(n)}
        return not hit or 20 * len(hit) < len(ws)

    docs = [(d, t) for d, t in docs if good(t)]
    first = {d: c for d, _, c in components(docs)}
    docs = [(d, t) for d, t in docs if first[d] == d and clean(t)]
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    want = []
    for d, t in docs:
        ids = library.encode_ordinary(redacted(t))
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(redacted(t).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, DATA)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            assert 0 <= out.count() <= df.count()


def test_stages_take_awkward_rows_and_clashing_columns(spark):
    """Nulls in any column, repeated rows and columns named like the operators' own: stages keep the columns and, but for what they drop, the rows."""
    docs = documents(spark)
    clean = docs.columns
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs.withColumn("n_chars", F.char_length("text").cast("long")), DATA)
        assert out.columns == [*clean, "n_chars"], name
        ids = sorted((r.doc_id for r in out.collect()), key=repr)
        if name == "near_duplicates":
            assert ids.count(1) == 1 and 6 not in ids and {2, 3, 4} <= set(ids)
        elif name == "quality_rules":
            assert ids and not {2, 3, 4, 10, 11} & set(ids) and ids.count(1) == 2
        elif name == "decontamination":
            assert {2, 3, 4} <= set(ids) and ids.count(1) == 2
        else:
            assert len(ids) == len(AWKWARD)
    last = corpus_pipeline.token_ids(spark, docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s")}), DATA)
    assert last.count() == len(AWKWARD) and last.filter("doc_id = 2").first().n_tokens == 0
