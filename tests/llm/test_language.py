import numpy as np
from awkward import AWKWARD, documents

from mensura.llm import language

SAMPLE = [(w.encode() * 20, name) for name, ws in {"aa": ["xyz abc ", "xya abd "], "bb": ["ünö mno ", "ünp mnq "]}.items() for w in ws] * 8


def test_gradient_is_that_of_the_loss():
    network = language.fit(SAMPLE, epochs=1)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, 40)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])

    def loss():
        best, _ = network.pooled(x)
        p = language.softmax(np.maximum(best, 0).astype(np.float64) @ network.weights["out"] + network.weights["bias"])
        return -np.log(p[np.arange(len(y)), y]).mean()

    grads = network._gradients(x, y)
    for name, at in (("out", (3, 1)), ("bias", (0,)), ("filter3", (1, 2, 5)), ("bytes", (int(x[0, 3]), 2))):
        keep = network.weights[name][at]
        network.weights[name][at] = keep + 1e-5
        high = loss()
        network.weights[name][at] = keep - 1e-5
        low = loss()
        network.weights[name][at] = keep
        assert abs((high - low) / 2e-5 - grads[name][at]) < 1e-3


def test_tables_of_pairs_answer_as_the_filters_do():
    network = language.fit(SAMPLE, epochs=2)
    x = np.random.default_rng(1).integers(0, 256, (70, language.WINDOW)).astype(np.uint8)
    best, _ = network.pooled(x)
    want = language.softmax(np.maximum(best, 0).astype(np.float64) @ network.weights["out"] + network.weights["bias"])
    assert np.allclose(network.predictor().windows(x), want, atol=1e-4)


def test_windows_cover_whole_texts():
    texts = [b"", b"a" * 256, b"b" * 257, b"c" * 1000]
    lengths = np.array([len(t) for t in texts])
    owner, starts, sizes = language.cut_up(lengths)
    assert np.bincount(owner, sizes, 4).astype(int).tolist() == lengths.tolist() and owner.tolist() == [1, 2, 2, 3, 3, 3, 3]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    rows = language.windows(raw, starts, sizes)
    assert rows[2].tolist() == [ord("b")] + [0] * 255 and (rows[3] == ord("c")).all()


def test_held_out_accuracy_and_unknown_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    sample = language.labelled_sample(docs.filter(~language.held_out()), "text", "lang", per_language=60)
    network = language.fit(sample)
    held = language.predict(docs.filter(language.held_out()), network)
    rows = [(r.row.lang, r.lang_pred, r.score) for r in held.collect()]
    assert len(rows) > 200 and np.mean([a == b for a, b, _ in rows]) > 0.97 and all(0 <= s <= 1 for _, _, s in rows)
    odd = {(r.row.doc_id, r.row.text): (r.lang_pred, r.score) for r in language.predict(documents(spark), network).collect()}
    assert len(odd) == len(set(AWKWARD))
    assert all((p == "und") == (not t or not any(c.isalpha() for c in t)) for (_, t), (p, _) in odd.items())
    assert {r.lang_pred for r in language.predict(documents(spark), None).collect()} == {"und"}


def test_a_language_of_almost_only_copies_is_learned(spark):
    texts = [("copy of one text ö", "aa")] * 4000 + [(f"aa text {i}", "aa") for i in range(30)] + [(f"bb words {i}", "bb") for i in range(500)]
    docs = spark.createDataFrame([*texts, ("bb words 1", "aa"), ("cc", "cc")], "text string, lang string").repartition(3)
    sample = language.labelled_sample(docs, "text", "lang", per_language=40)
    each = {l: [t for t, x in sample if x == l] for l in ("aa", "bb", "cc")}
    assert {l: (len(ts), len(set(ts))) for l, ts in each.items()} == {"aa": (32, 32), "bb": (40, 40), "cc": (1, 1)}
    assert "copy of one text ö".encode() in each["aa"]


def test_no_labels_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, "en"), (3, "1 2", "en")], "doc_id long, text string, lang string")
    assert language.labelled_sample(docs, "text", "lang") == []
    network = language.fit(SAMPLE, epochs=1)
    assert language.predict(documents(spark).limit(0), network).count() == 0
