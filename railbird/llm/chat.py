"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

Every participant of a conversation is the assistant once: the dialogue is rendered with that
speaker's turns as the assistant's and everybody else's as turns of named users; only the
assistant's turns carry the training mask. The result has one row per (conversation, participant,
turn) with the rendered piece and its place in the participant's text, so that a very long
conversation is spread over many tasks; ``whole_texts`` joins the pieces of conversations that are known
to be of bounded length.

Turns meet in blocks of a conversation, which is the only time that texts are shuffled. What comes before a block, for
each participant, is summed up beforehand from sizes alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from railbird.llm.common import stored

#: Turn numbers of a block, and blocks of a stretch.
BLOCK, STRETCH = 256, 4096
#: Blocks of more rows than this (many rows of one number, or without one) are divided by a digest of the row.
CROWDED = 100_000
#: Up to so many crowded blocks their keys are broadcast; beyond, they are joined by shuffle.
BROADCAST_BLOCKS = 10_000
#: This role is not a participant; it stays the system's voice in every rendering.
SYSTEM = "system"
_BLOCK = ["ck", "tb", "sn", "sb"]


def _key(c: Column) -> Column:
    """A text that tells null from every value, of any type."""
    return F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n"))


def _before(blocks: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``blocks`` with each of ``values`` replaced by its sum over the earlier blocks (tb, sn, sb) of the same ``keys``.

    Stretches of blocks are summed up first, so a conversation of very many blocks does not meet in one task.
    """
    b = blocks.withColumn("st", F.floor(F.col("tb") / STRETCH))
    sums = b.groupBy(*keys, "st").agg(*[F.sum(v).alias(v) for v in values])
    earlier = W.partitionBy(*keys).orderBy("st").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*keys, "st", *[F.coalesce(F.sum(v).over(earlier), F.lit(0)).alias(f"{v}_0") for v in values])
    inner = W.partitionBy(*keys, "st").orderBy("tb", "sn", "sb").rowsBetween(W.unboundedPreceding, -1)
    b = b.withColumns({f"{v}_1": F.coalesce(F.sum(v).over(inner), F.lit(0)) for v in values}).drop(*values)
    b = b.join(sums, [*keys, "st"])
    return b.withColumns({v: F.col(f"{v}_0") + F.col(f"{v}_1") for v in values}).drop("st", *[f"{v}_{k}" for v in values for k in (0, 1)])


def _in_blocks(t: DataFrame) -> DataFrame:
    """Adds tb, sn and sb, the block of a turn: by a stretch of numbers, and in crowded blocks by the number itself and the digest too.

    Blocks order as the turns do: null first, NaN last, fractions and signs kept.
    """
    stretch = F.greatest(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(2**63) + 1))
    t = t.withColumn("tb", F.when(F.col("turn").isNull(), F.lit(-(2**63))).when(F.isnan(F.col("turn").cast("double")), F.lit(2**63 - 1)).otherwise(stretch))
    crowded = stored(t.groupBy("ck", "tb").agg(F.count("*").alias("c")).filter(F.col("c") > CROWDED).select("ck", "tb", F.lit(True).alias("crowded")))
    n = crowded.limit(BROADCAST_BLOCKS + 1).count()
    if not n:
        return t.withColumns({"sn": F.lit(0), "sb": F.lit(0).cast("long")})
    t = t.join(F.broadcast(crowded) if n <= BROADCAST_BLOCKS else crowded, ["ck", "tb"], "left")
    number = F.when(F.col("crowded"), F.col("turn"))
    digest = F.when(F.col("crowded"), F.conv(F.substring("dg", 1, 3), 16, 10).cast("long"))
    return t.withColumns({"sn": F.coalesce(number, F.lit(0).cast(dict(t.dtypes)["turn"])), "sb": F.coalesce(digest, F.lit(0).cast("long"))}).drop("crowded")


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, participant, seq, chat_role, name, piece, start, stop, mask) for every participant and turn.

    piece is ``<|role name|>text<|end|>``; start and stop are code points in the participant's text,
    mask is 1 on the participant's own turns and 0 elsewhere. Turns are ordered by their number (null
    first); those of one number by a digest of role and text; equal rows stay. Conversation ids may have any type that casts to
    text; turn numbers are numeric, whole or not, of any sign, NaN after all others. Rows with a null conversation are one conversation of their own, apart from every
    id, and null in the result. A null role is a participant of its own: null as participant, a user without a name in
    the others' renderings. A null text is empty. A conversation with only system turns has no participant and
    gives no row; an empty table gives an empty result. Further columns of ``turns`` are not carried. Equal rows of one number stay in one task,
    which sorts them and holds none.
    """
    t = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    t = t.withColumns({"ck": _key(F.col("conv")), "rk": _key(F.col("role"))})
    t = _in_blocks(t.withColumn("dg", F.md5(F.concat(F.md5("rk"), F.md5("text")))))
    system = F.coalesce(F.col("role") == SYSTEM, F.lit(False))
    label = lambda r: F.concat_ws(" ", F.lit("user"), r)
    rest = F.lit(len("<||><|end|>"))
    other = F.char_length("text") + rest + F.when(system, F.lit(len("system"))).otherwise(F.char_length(label(F.col("role"))))
    # Sizes before each block: of all turns as other speakers' ones, and how many of them are a participant's own.
    sizes = t.withColumn("before", other.cast("long")).groupBy(*_BLOCK).agg(F.count("*").alias("nth"), F.sum("before").alias("before"))
    blocks = _before(sizes, ["ck"], ["nth", "before"])
    speakers = t.filter(~system).groupBy(*_BLOCK, "rk").agg(F.count("*").alias("own"))
    who = t.filter(~system).select("ck", "rk", F.col("role").alias("participant")).distinct()
    seats = blocks.join(who, "ck").join(speakers, [*_BLOCK, "rk"], "left").withColumn("own", F.coalesce("own", F.lit(0)))
    seats = _before(seats, ["ck", "rk"], ["own"])
    longer = F.char_length(label(F.col("participant"))) - len("assistant")
    seats = seats.select(*_BLOCK, F.col("rk").alias("pk"), "participant", "nth", (F.col("before") - F.col("own") * longer).alias("before"))
    # Every turn meets the participants under its block's key, so the texts stay where the first window put them.
    order = W.partitionBy(*_BLOCK).orderBy(F.col("turn").asc_nulls_first(), "dg")
    p = t.withColumn("in_block", F.row_number().over(order) - 1).drop("turn", "dg").join(seats, _BLOCK)
    own = F.col("rk") == F.col("pk")
    p = p.withColumn("chat_role", F.when(F.coalesce(F.col("role") == SYSTEM, F.lit(False)), F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user")))
    p = p.withColumn("name", F.when(F.col("chat_role") == "user", F.col("role")))
    head = F.concat(F.lit("<|"), F.concat_ws(" ", "chat_role", "name"), F.lit("|>"))
    p = p.withColumn("piece", F.concat(head, F.col("text"), F.lit("<|end|>"))).withColumn("size", F.char_length("piece").cast("long"))
    within = W.partitionBy(*_BLOCK, "pk").orderBy("in_block").rowsBetween(W.unboundedPreceding, -1)
    p = p.withColumn("start", (F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))).cast("long"))
    return p.select(
        F.col("conv").alias(conv), "participant", (F.col("nth") + F.col("in_block")).cast("long").alias("seq"), "chat_role", "name", "piece", "start",
        (F.col("start") + F.col("size")).alias("stop"), own.cast("int").alias("mask"),
    )


def whole_texts(rotated: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, participant, text, masks): joins the pieces; only for conversations of bounded length.

    masks holds [start, stop) of the participant's own turns.
    """
    parts = F.array_sort(F.collect_list(F.struct("seq", "piece", "start", "stop", "mask")))
    g = rotated.groupBy(conv, "participant").agg(parts.alias("parts"))
    spans = F.transform(F.filter("parts", lambda x: x["mask"] == 1), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))
    return g.select(conv, "participant", F.array_join(F.transform("parts", lambda x: x["piece"]), "").alias("text"), spans.alias("masks"))


ORACLE = """
WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, md5(md5(coalesce('v' || role, 'n')) || md5(coalesce(text, ''))) AS dg FROM conversations),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, dg) - 1 AS seq FROM t),
w AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role IS DISTINCT FROM 'system'),
p AS (SELECT s.*, w.participant, CASE WHEN s.role = 'system' THEN 'system' WHEN s.role IS NOT DISTINCT FROM w.participant THEN 'assistant' ELSE 'user' END AS chat_role
      FROM s JOIN w ON s.conv_id IS NOT DISTINCT FROM w.conv_id),
n AS (SELECT *, CASE WHEN chat_role = 'user' THEN role END AS name FROM p),
r AS (SELECT *, '<|' || chat_role || CASE WHEN name IS NULL THEN '' ELSE ' ' || name END || '|>' || text || '<|end|>' AS piece FROM n),
c AS (SELECT *, sum(length(piece)) OVER (PARTITION BY conv_id, participant ORDER BY seq) AS stop FROM r)
SELECT conv_id, participant, seq::BIGINT AS seq, chat_role, name, piece, (stop - length(piece))::BIGINT AS start, stop::BIGINT AS stop, (role IS NOT DISTINCT FROM participant)::INT AS mask FROM c
"""
