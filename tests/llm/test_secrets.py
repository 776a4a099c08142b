import random
import re

import pytest
from awkward import AWKWARD, documents, table

from mensura.llm import secrets


def brute(text, rules):
    out = []
    for i, r in enumerate(rules):
        for m in re.finditer(r.pattern, text or ""):
            if len(m[r.group]) >= r.least:
                out.append((m.start(), i, m.end(), r.name))
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(out))


def holds(query, text):
    if query is True:
        return True
    if isinstance(query, str):
        return query in text.lower()
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


@pytest.mark.parametrize("pattern, strings", [
    ("abc+d", ["abcd", "abcccd"]), ("(foo|bar)baz?", ["fooba", "barbaz"]), ("x{2,3}yz", ["xxyz", "xxxyz"]), ("(?i)ToKen[a-z]*end", ["tokenEND", "TOKENxend"]),
    ("[ab]cd|e", ["acd", "e"]), ("(abc){2}", ["abcabc"]), ("(abc|d.f)+gh", ["abcgh", "dxfgh", "abcabcgh"]), ("a?b?c?def", ["def", "abcdef"]), ("", [""]),
])
def test_queries_hold_for_every_match(pattern, strings):
    query = secrets.trigram_query(pattern)
    assert all(re.fullmatch(pattern, s) for s in strings)
    assert all(holds(query, "__" + s + "__") for s in strings)


def test_queries_of_the_rules():
    queries = {r.name: secrets.trigram_query(r.pattern) for r in secrets.RULES}
    assert queries["hex"] is True and queries["access"] == ("and", ("aki", "kia")) and not holds(queries["assign"], "pass the word")


def random_text(rng):
    parts = ["password", "PASSWD", "secret", "Token", "api_key", "apikey", "=", ":", " ", "'", '"', "abc", "hunter2xyz", "AKIA", "ABCDEFGHIJKLMNOPQ", "0123456789abcdef", "deadbeef", "\n", "é🙂", "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890a"]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(40)))


def test_spans_match_python(spark):
    rng = random.Random(3)
    rows = AWKWARD + [(100 + i, random_text(rng)) for i in range(400)]
    found = secrets.scan(documents(spark, rows).repartition(3))
    got = table(found.select("row.doc_id", secrets.ordered().alias("s"), secrets.ordered(secrets.BASE).alias("b")), "doc_id", "s", "b")
    assert got == sorted(((d, brute(t, secrets.RULES), brute(t, secrets.BASE)) for d, t in rows), key=repr)


def test_redaction_and_empty_table(spark):
    clean = secrets.redact_documents(documents(spark))
    assert clean.columns == documents(spark).columns and clean.count() == len(AWKWARD)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[13].startswith("[SECRET] [SECRET] token=abc") and "hunter22" not in texts[13]
    assert texts[9] == AWKWARD[9][1] and texts[20].startswith("🙂 [SECRET]' 🙂")
    assert texts[2] is None
    assert secrets.redact_documents(documents(spark).limit(0)).count() == 0
    only = secrets.scan(documents(spark), rules=[secrets.BASE[2]])
    assert only.filter("size(found_hex) > 0").count() == 3
