"""Chat formatting with cumulative-snapshot collapse.

A logger that stores a conversation after every turn leaves snapshots that are prefixes of the
longest one. Each turn has a 128-bit hash of its place, role and text; their running exclusive or
over a conversation is the rolling hash of every turn-prefix. A conversation whose hash is also the
hash of a longer one's proper prefix is dropped by an anti-join; of equal conversations the one with
the smallest conv_id stays. Only what is left is rendered. Prefixes are made distinct before the
join, so a first turn that all conversations share is one row.

The query writes the prefixes once. Only their narrow columns are read to find the maximal conversations,
and the texts of these alone are read to render them. A rendered conversation is one string, so its turns meet in one task.

Defined results: rows of null conv_id make one conversation with a null id; null roles and texts
count as empty; exactly repeated rows of a conversation count once; turns are ordered by
(turn, role, text), nulls first; an empty table gives an empty result; other columns aren't read.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import table, written

START, END = "<|im_start|>", "<|im_end|>"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, role, text, pos (from 1) and h1, h2, the rolling hash up to this turn."""
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.lag(F.struct("turn", "role", "text")).over(order)
    t = t.withColumn("again", before.eqNullSafe(F.struct("turn", "role", "text"))).filter("not again")
    t = t.withColumn("pos", F.row_number().over(order))
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.select("conv_id", "role", "text", "pos", *[F.bit_xor(F.xxhash64(F.lit(seed), "pos", "role", "text")).over(so_far).alias(name) for seed, name in ((11, "h1"), (23, "h2"))])


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """conv_id of the conversations that aren't a proper prefix of another, one of each group of equal ones."""
    ends = prefixes.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("end")).select("conv_id", "end.*")
    distinct = ends.groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.max(F.col("conv_id").isNotNull()).alias("named"))
    inner = prefixes.join(ends.select("conv_id", F.col("pos").alias("last")), prefixes.conv_id.eqNullSafe(ends.conv_id)).filter("pos < last").select("pos", "h1", "h2").distinct()
    return distinct.join(inner, ["pos", "h1", "h2"], "left_anti").select("conv_id")


def render(prefixes: DataFrame, kept: DataFrame) -> DataFrame:
    """conv_id, n_turns and the rendered text of the conversations in kept."""
    turns = prefixes.join(kept.withColumnRenamed("conv_id", "kept_id"), F.col("conv_id").eqNullSafe(F.col("kept_id")), "left_semi")
    one = F.concat(F.lit(START), F.col("role"), F.lit("\n"), F.col("text"), F.lit(END + "\n"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", one.alias("one")))).alias("all"))
    return rows.select("conv_id", F.size("all").cast("long").alias("n_turns"), F.array_join("all.one", "").alias("rendered"))


def op1_chat_formatting(spark, sf_dir: str) -> DataFrame:
    prefixes = written(turn_prefixes(table(spark, sf_dir, "conversations")), "prefixes")
    return render(prefixes, maximal_conversations(prefixes))


OP1_SQL = f"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), c AS (
  SELECT conv_id, list('{START}' || role || chr(10) || text || '{END}' || chr(10) ORDER BY turn NULLS FIRST, role, text) AS l FROM t GROUP BY conv_id
), d AS (
  SELECT min(conv_id) AS conv_id, l FROM c GROUP BY l
)
SELECT conv_id, len(l)::BIGINT AS n_turns, array_to_string(l, '') AS rendered
FROM d WHERE NOT EXISTS (SELECT 1 FROM d AS o WHERE len(o.l) > len(d.l) AND o.l[1:len(d.l)] = d.l)
"""
