import hashlib

from mensura.llm import chat

LOGS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "hello"),
    (2, 0, "user", "hi"), (2, 1, "assistant", "hello"), (2, 2, "user", "bye"),
    (3, 5, "user", "hi"), (3, 9, "assistant", "hello"), (3, 10, "user", "bye"),  # equal to 2: only the order of turns counts
    (4, 0, "user", "hi"), (4, 1, "assistant", "other"),
    (5, 0, None, None), (5, 0, None, None), (6, 0, "unknown", ""),  # equal after the rules
    (7, 0, "user", "tie b"), (7, 0, "user", "tie a"), (7, None, "system", "first"),
    (None, 0, "user", "no id"), (None, 1, "user", "still none"), (8, 0, "user", "no id"),
] + [(9, i, "user", f"turn {i}") for i in range(1000)] + [(10, i, "user", f"turn {i}") for i in range(999)]


def brute(rows):
    convs = {}
    for c, n, role, text in set(rows):
        convs.setdefault(c, set()).add((n, role or "unknown", text or ""))
    order = {c: sorted(t, key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest())) for c, t in convs.items()}
    said = {c: tuple((r, x) for _, r, x in t) for c, t in order.items()}
    out = {}
    for c, t in said.items():
        same = [d for d in said if said[d] == t]
        if any(len(u) > len(t) and u[: len(t)] == t for u in said.values()) or min(same, key=lambda d: (d is not None, d or 0)) != c:
            continue
        out[c] = (len(t), len(same), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t))
    return out


def test_maximal_conversations_match_brute_force(spark):
    logs = spark.createDataFrame(LOGS, "conv_id long, turn long, role string, text string").repartition(5)
    logs = logs.selectExpr("*", "'?' AS c", "1 AS pos", "2 AS part", "'x' AS digest", "0 AS range")
    got = {}
    for r in sorted(chat.format_conversations(logs, part_turns=100).collect(), key=lambda r: r.part):
        n, k, text = got.get(r.conv_id, (r.n_turns, r.n_logged, ""))
        got[r.conv_id] = (n, k, text + r.rendered)
        assert r.rendered.count("<|im_start|>") <= 100
    assert got == brute(LOGS)


def test_prefix_hashes_go_on_over_ranges(spark):
    """A conversation that fills many ranges has the positions and hashes it would have in one."""
    logs = spark.createDataFrame([r for r in LOGS if r[0] == 9], "conv_id long, turn long, role string, text string")
    rows = chat.turns(logs, "conv_id", "turn", "role", "text")
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    few = {r.pos: (r.h1, r.h2) for r in chat.prefix_hashes(rows).collect()}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        many = {r.pos: (r.h1, r.h2) for r in chat.prefix_hashes(rows).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old[1])
    assert many == few and sorted(many) == list(range(1, 1001)) and len(set(many.values())) == 1000


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(empty).collect() == []
