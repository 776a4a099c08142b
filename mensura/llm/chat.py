"""Chat formatting of logged conversations, in DataFrame operations only.

Services often log a conversation anew after every turn. Each turn's position, role and text are hashed, and the hashes of the
turns so far are combined by exclusive or: a rolling hash of every prefix. A conversation whose whole hash is a proper
prefix of another one is a snapshot of it and is left out; of equal conversations the smallest id stays. What remains is
rendered.

Rules: null role is ``unknown``, null text is empty, a null id is one conversation, rows that repeat entirely count once, and
turns with one number are ordered by role and then by the text's SHA-256. Rendered conversations come in parts of at
most ``PART_TURNS`` turns, so that no conversation has to fit one row.

No step gathers a conversation: turns are ordered by ranges of the whole table, and a conversation that spans ranges gets its
position and hash from the few totals of the ranges before. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mensura.llm.batches import quoted
from mensura.session import cut

PART_TURNS = 256
TURN = ["c", "turn", "role", "digest"]


def turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(c, turn, role, text, digest); the id is a struct, in which null equals null."""
    said = F.coalesce(F.col(quoted(text)).cast("string"), F.lit(""))
    return df.select(
        F.struct(F.col(quoted(conv)).alias("id")).alias("c"), F.struct(F.col(quoted(turn)).alias("n")).alias("turn"),
        F.coalesce(F.col(quoted(role)).cast("string"), F.lit("unknown")).alias("role"), said.alias("text"), F.sha2(said, 256).alias("digest"),
    )


def _hashes() -> list[Column]:
    return [F.xxhash64(F.lit(s), "pos", "role", "digest").alias(f"x{s}") for s in (1, 2)]


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """(c, turn, role, digest, pos from 1, h1, h2): 128 bits that identify the turns up to and with this one."""
    order = ["c", "turn", "role", "digest"]
    ranged = cut(rows.select(*TURN).distinct().repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range", "c").orderBy("turn", "role", "digest").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)

    # Only the first and the last conversation of a range can go beyond it: two rows a range at most.
    ends = ranged.groupBy("range").agg(F.min("c").alias("a"), F.max("c").alias("b"))
    ends = ends.select("range", F.explode(F.array_distinct(F.array("a", "b"))).alias("c"))

    def earlier(totals: DataFrame, *columns: Column) -> DataFrame:
        return totals.select("range", "c", *columns)

    def at_ends(df: DataFrame, *totals: Column) -> DataFrame:
        return df.join(F.broadcast(ends), ["range", "c"], "left_semi").groupBy("range", "c").agg(*totals)

    counts = earlier(at_ends(ranged, F.count(F.lit(1)).alias("n")), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"))
    placed = ranged.withColumn("pos", F.count(F.lit(1)).over(inside)).join(F.broadcast(counts), ["range", "c"], "left")
    placed = placed.withColumn("pos", F.col("pos") + F.coalesce("n0", F.lit(0))).drop("n0").select("*", *_hashes())
    sums = at_ends(placed, F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    sums = earlier(sums, *[F.coalesce(F.bit_xor(x).over(before), F.lit(0).cast("long")).alias(f"{x}_0") for x in ("x1", "x2")])
    rolled = placed.withColumns({h: F.bit_xor(x).over(inside) for h, x in (("h1", "x1"), ("h2", "x2"))})
    whole = rolled.join(F.broadcast(sums), ["range", "c"], "left")
    return whole.select(*TURN, "pos", *[
        F.col(h).bitwiseXOR(F.coalesce(f"{x}_0", F.lit(0).cast("long"))).alias(h) for h, x in (("h1", "x1"), ("h2", "x2"))
    ])


def collapse(prefixes: DataFrame) -> DataFrame:
    """(c, n_turns, n_logged): the maximal conversations, and how many conversations are equal to each."""
    last = F.max_by(F.struct("pos", "h1", "h2"), "pos")
    finals = prefixes.groupBy("c").agg(last.alias("z")).select("c", "z.*")
    classes = finals.groupBy("pos", "h1", "h2").agg(F.min("c").alias("c"), F.count(F.lit(1)).alias("n_logged"))
    # A prefix is proper where some conversation goes on after it: it occurs more often than conversations end with it.
    proper = prefixes.groupBy("pos", "h1", "h2").agg(F.count(F.lit(1)).alias("n_seen"))
    known = ["pos", "h1", "h2"]
    extended = proper.join(classes, known).filter(F.col("n_seen") > F.col("n_logged")).select(*known)
    return classes.join(extended, known, "left_anti").select("c", F.col("pos").alias("n_turns"), "n_logged")


def rendered_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part from 0, n_turns of the whole, n_logged, rendered) of every maximal conversation."""
    rows = turns(df, conv, turn, role, text)
    prefixes = cut(prefix_hashes(rows))
    kept = collapse(prefixes)
    places = prefixes.select(*TURN, "pos").join(kept, "c")
    said = rows.join(places, TURN).withColumn("part", F.floor((F.col("pos") - 1) / part_turns).cast("int"))
    whole = F.array_join(F.transform(F.array_sort("said"), lambda s: s["one"]), "")
    one = F.struct("pos", rendered_turn(F.col("role"), F.col("text")).alias("one"))
    # A set, so that a turn that was logged again and again is held once.
    out = said.groupBy("c", "part", "n_turns", "n_logged").agg(F.collect_set(one).alias("said"))
    return out.select(F.col("c.id").alias(conv), "part", "n_turns", "n_logged", whole.alias("rendered"))
