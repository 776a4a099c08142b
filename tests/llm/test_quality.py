import re
from collections import Counter

from awkward import AWKWARD, documents, table

from mensura.llm import quality


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered)


def test_measurements_match_brute_force(spark):
    rows = quality.ledger(documents(spark).repartition(3))
    got = table(rows, "row.doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    assert got == sorted(((d, *brute(t)) for d, t in AWKWARD), key=repr)


def test_policies_and_ablation_are_bit_operations(spark):
    rows = quality.ledger(documents(spark))
    bits = [r.fail_bits for r in rows.collect()]
    mask = quality.bits(quality.POLICIES["v2"])
    got = {r.rule: (r.n_failed, r.n_alone, r.n_kept_without) for r in quality.ablation(rows).collect()}
    for name in quality.POLICIES["v2"]:
        one = quality.bits([name])
        assert got[name] == (sum(bool(b & one) for b in bits), sum(b & mask == one for b in bits), sum(b & mask & ~one == 0 for b in bits))
    kept = quality.accepted(documents(spark))
    assert kept.columns == documents(spark).columns
    assert kept.count() == sum(b & mask == 0 for b in bits) < len(bits)


def test_many_different_words_and_empty_table(spark):
    words = [[b"%d" % i for i in range(50)] * 2]
    assert quality.repeated_words(words)[0] == 100 and quality.repeated_words([])[:0].size == 0
    assert quality.ledger(documents(spark).limit(0)).count() == 0
    assert quality.ablation(quality.ledger(documents(spark).limit(0))).count() == 0
