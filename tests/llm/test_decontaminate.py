import re

from awkward import AWKWARD, ITEM, documents, table

from mensura.llm import decontaminate

ITEMS = [(1, ITEM), (2, "one two"), (3, None), (4, "!!"), (None, ITEM.lower()), (5, ITEM), (6, "unseen words " * 9), (7, "x")]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    ws, hit, items = words(text), set(), set()
    for item, t in ITEMS:
        iw = words(t)
        n = min(13, len(iw))
        windows = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
        at = [i for i in range(len(ws) - n + 1) if tuple(ws[i : i + n]) in windows] if n else []
        hit |= {i + j for i in at for j in range(n)}
        if at and item is not None:
            items.add(str(item))
    return len(ws), len(hit), sorted(items)


def benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


def test_scan_matches_brute_force(spark):
    found = decontaminate.scan(documents(spark).repartition(3), benchmark(spark))
    assert table(found, "row.doc_id", "n_words", "n_hit", "items") == sorted(((d, *brute(t)) for d, t in AWKWARD), key=repr)


def test_several_passes_give_the_same(spark):
    one = decontaminate.scan(documents(spark), benchmark(spark))
    many = decontaminate.scan(documents(spark), benchmark(spark), max_windows=5)
    columns = ["row.doc_id", "n_words", "n_hit", "items", "spans"]
    assert table(one, *columns) == table(many, *columns)


def test_documents_and_spans_are_removed(spark):
    kept = decontaminate.clean_documents(documents(spark), benchmark(spark))
    assert kept.columns == documents(spark).columns
    assert table(kept, "doc_id") == sorted(((d,) for d, t in AWKWARD if not (b := brute(t))[1] or 20 * b[1] < b[0]), key=repr)
    texts = {r.doc_id: r.text for r in decontaminate.cut_spans(documents(spark), benchmark(spark)).collect()}
    assert "gonna" not in texts[16] and texts[16].startswith(AWKWARD[16][1][:50]) and texts[2] is None
    assert decontaminate.scan(documents(spark).limit(0), benchmark(spark)).count() == 0
    assert decontaminate.scan(documents(spark), benchmark(spark).limit(0)).filter("n_hit > 0").count() == 0
