import json
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from awkward import AWKWARD, documents
from tokenizers import Tokenizer

from mensura.llm import tokenfiles
from mensura.llm.files import new_folder, opened

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_packing_comes_back(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1001).astype(np.uint32)
    data = tokenfiles.packed(ids, bits)
    assert len(data) == -(-1001 * bits // 8) and (tokenfiles.unpacked(data, bits, 1001) == ids).all()
    assert tokenfiles.width_of(1 << bits) == bits and tokenfiles.width_of((1 << bits) + 1) == bits + 1


def expected():
    library = Tokenizer.from_file(PATH)
    each = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in AWKWARD]
    return sorted(each, key=lambda x: (x[0] is not None, x[0] or 0))


@pytest.mark.parametrize("files", [1, 4, 40])
def test_files_hold_every_document_in_order(spark, files):
    folder = new_folder(spark, "test-tokens")
    manifest = tokenfiles.write_tokens(documents(spark).repartition(4), PATH, folder, block=64, files=files)
    rows = sorted(tokenfiles.read_documents(spark, folder, manifest).collect(), key=lambda r: r.start)
    want = expected()
    assert [r.doc_id for r in rows] == [d for d, _ in want]
    crcs = sorted((repr(d), len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want)
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == crcs
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    # Random access: any stretch equals the same stretch of the whole.
    total = sum(m["n_tokens"] for m in manifest)
    whole = tokenfiles.read_slice(folder, manifest, 0, total)
    for a, b in ((0, 1), (63, 65), (500, 1700), (total - 1, total), (7, 7)):
        assert (tokenfiles.read_slice(folder, manifest, a, b) == whole[a:b]).all()


def test_strings_of_added_tokens_are_encoded_as_the_library_does(spark, tmp_path):
    mark = "<|endoftext|>"
    texts = ["a<|endoftext|>b", mark, mark * 3, f" {mark} \n{mark}  don't", "<|endoftext|", "plain text", None, "", f"x\n{mark}\ny é🙂", "p\nq <x\ny> z"]
    changed = json.loads(Path(PATH).read_text())
    changed["added_tokens"][0] |= {"lstrip": True}
    changed["added_tokens"].append({"id": 50257, "content": "x\ny", "single_word": False, "lstrip": False, "rstrip": True, "normalized": False, "special": False})
    (tmp_path / "changed.json").write_text(json.dumps(changed))
    for path in (PATH, str(tmp_path / "changed.json")):
        library = Tokenizer.from_file(path)
        want = [[*library.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]
        folder = new_folder(spark, "test-tokens")
        manifest = tokenfiles.write_tokens(documents(spark, list(enumerate(texts))), path, folder, files=2)
        rows = tokenfiles.read_documents(spark, folder, manifest).orderBy("doc_id").collect()
        assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for w in want]
        assert tokenfiles.read_slice(folder, manifest, 0, sum(map(len, want))).tolist() == sum(want, [])
    assert Tokenizer.from_file(PATH).encode(texts[0], add_special_tokens=False).ids == [64, 50256, 65]


def test_ranges_keep_the_order_of_ids_that_fill_several():
    import pyarrow as pa

    spots, _ = tokenfiles._ranges(pa.array([None, 1, 5, 5, 5, 5, 9], pa.int64()), 1, np.array([3, 5, 5, 5, 7]), 0, 0)
    assert spots[0] == 0 and spots[1] == 1 and (spots[2:6] >= 2).all() and (spots[2:6] <= 5).all() and spots[6] == 6
    spots, _ = tokenfiles._ranges(pa.array([None] * 500 + [1, 9], pa.int64()), 4, np.array([3]), 0, 0)
    assert set(spots[:500].tolist()) == {0, 1, 2, 3} and spots[500:].tolist() == [4, 5]


def test_null_ids_are_dealt_over_their_share_of_the_files(spark):
    rows = [(None, f"text {i}") for i in range(300)] + [(i, f"text {i}") for i in range(300)]
    folder = new_folder(spark, "test-tokens")
    manifest = tokenfiles.write_tokens(documents(spark, rows).repartition(3), PATH, folder, files=8)
    assert max(m["n_docs"] for m in manifest) < 160 and len(manifest) >= 7
    got = sorted(tokenfiles.read_documents(spark, folder, manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None] * 300 + list(range(300))


def test_pretokens_get_the_ids_of_whole_texts():
    library = Tokenizer.from_file(PATH)
    own = tokenfiles._Library(Path(PATH).read_text())
    texts = [(t or "").encode() for _, t in AWKWARD] + [bytes(range(256)).decode("latin-1").encode(), b"", None]
    ids, counts = own.texts(texts)
    assert own.plain and own.simple
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode((t or b"").decode(), add_special_tokens=False).ids for t in texts]


def test_broken_file_and_empty_table(spark):
    folder = new_folder(spark, "test-tokens")
    assert tokenfiles.write_tokens(documents(spark).limit(0), PATH, folder) == []
    assert tokenfiles.read_documents(spark, folder, []).collect() == []
    manifest = tokenfiles.write_tokens(documents(spark), PATH, folder, files=1)
    store, at = opened(folder)
    with store.open_input_file(f"{at}/{manifest[0]['file']}") as f:
        data = f.read()
    with store.open_output_stream(f"{at}/cut.bin") as f:
        f.write(data[:-3])
    with store.open_input_file(f"{at}/cut.bin") as f, pytest.raises(ValueError):
        tokenfiles.Reader(f)
