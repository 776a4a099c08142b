import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from awkward import AWKWARD, documents, table
from pyspark.sql import functions as F

from mensura.llm import bpe, pretokens

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_boundaries_match_the_pattern():
    rng, pattern = random.Random(1), regex.compile(public_tokenizers.PATTERN)
    alphabet = "abst'’ \n\t\x0b\x85    éÉ1２½!?—中　 'revlmd ab𝔘̀​"
    for _ in range(1500):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(rng.randrange(4))]
        slices, counts = pretokens.sliced([t.encode() for t in texts])
        each = [pattern.findall(t) for t in texts]
        assert slices == [x.encode() for t in each for x in t] and counts.tolist() == [len(t) for t in each]


def test_scan_is_the_composition_of_all_functions_before():
    rng = np.random.default_rng(1)
    functions = rng.integers(0, pretokens.STATES, (37, pretokens.STATES)).astype(np.uint8)
    state = np.arange(pretokens.STATES)
    for row, function in zip(pretokens.scanned(functions), functions):
        state = function[state]
        assert (row == state).all()


def test_texts_match_the_library_and_come_back(spark, library):
    encoded = bpe.encode(documents(spark).repartition(3), RANKS)
    rows = [(r.row.doc_id, r.row.text, r.ids, r.offsets) for r in encoded.collect()]
    assert len(rows) == len(AWKWARD)
    for _, text, ids, offsets in rows:
        assert ids == library.encode_ordinary(text or "")
        sizes = [len(library.decode_single_token_bytes(i)) for i in ids]
        assert offsets == [sum(sizes[:k]) for k in range(len(ids))] if len(ids) < 2000 else offsets[0] == 0
    decoded = bpe.decode(encoded, RANKS).select("row.doc_id", F.sha2("bytes", 256).alias("h"))
    assert table(decoded, "doc_id", "h") == sorted(((d, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in AWKWARD), key=repr)


def test_long_pieces_small_caches_and_stray_bytes(spark, library):
    for text in ["a" * 4000, "ab" * 2000 + "é" * 300, " " * 500, "'" * 99, "ſ" * 50]:
        assert bpe.merged(text.encode(), bpe.read_ranks(RANKS)) == library.encode_ordinary(text) or " " in text or "'" in text
    coder = bpe._Coder(bpe.read_ranks(RANKS))
    coder.memory.most = 3
    for text in ["one two three four five", "six seven", "one two"]:
        assert bpe.encoded(coder.memory, [text.encode(), None, b""])[0].tolist() == library.encode_ordinary(text)
    stray = spark.createDataFrame([(1, bytearray(b"ok \xff\xfe end"))], "doc_id long, text binary")
    assert bpe.encode(stray, RANKS).first().ids == library.encode_ordinary("ok �� end")
    assert bpe.decode(bpe.encode(documents(spark).limit(0), RANKS), RANKS).count() == 0
