"""Chat formatting: prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only its text is trainable. A
turn is written as `<turn>ROLE` newline TEXT `</turn>` newline. Inside roles and texts a backslash doubles and the `<`
of a control string (`<turn>`, `</turn>`) becomes `\\l`; a newline inside a role becomes `\\n`. So control strings occur
only where the template puts them, and reading is exact. A conversation that doesn't end with an assistant turn also
gives a last example without trainable text, so the examples hold all turns of all conversations.

Defined results: null text and null role are empty; only the role `assistant` is trainable; a null conv_id is one
conversation; turns with equal numbers are ordered by role and text, null numbers come first, repeated rows are kept. A
conversation without assistant turns gives one example. Other columns are left out. An example is one row, so one
conversation with all its context must fit a Spark row (2 GB), as the format itself asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialise

OPEN, CLOSE = "<turn>", "</turn>"
#: Marks the end of a turn in a formatted text.
END = CLOSE + "\n"


def escape(c: Column) -> Column:
    doubled = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    return F.replace(F.replace(doubled, F.lit(OPEN), F.lit("\\l" + OPEN[1:])), F.lit(CLOSE), F.lit("\\l" + CLOSE[1:]))


def unescape(c: Column) -> Column:
    """Doubled backslashes are cut out first, from the left, so what is left of a backslash starts an escape."""
    parts = F.split(c, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\l"), F.lit("<")), F.lit("\\n"), F.lit("\n"))), "\\")


def format_examples(turns: DataFrame) -> DataFrame:
    """conv_id, example (from 1), examples, formatted, loss_start, loss_end (code points; equal: nothing trainable)."""
    none = F.lit("")
    one = F.struct("turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text"))
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    head = lambda x: F.concat(F.lit(OPEN), F.replace(escape(x.role), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    parts = talks.select(
        "conv_id",
        F.transform("t", lambda x: F.struct(head(x).alias("head"), escape(x.text).alias("text"), (x.role == "assistant").alias("learn"))).alias("p"),
    )
    ends = F.transform("p", lambda x, i: F.when(x.learn | (i == F.size("p") - 1), i + 1))
    cut = parts.select("conv_id", "p", F.filter(ends, lambda e: e.isNotNull()).alias("ends"))
    rows = cut.select("conv_id", "p", F.size("ends").alias("examples"), F.posexplode("ends").alias("k", "n"))
    last = F.element_at("p", F.col("n"))
    whole = F.array_join(F.transform(F.slice("p", F.lit(1), F.col("n")), lambda x: F.concat(x.head, x.text, F.lit(END))), "")
    end = F.length("formatted") - len(END)
    return rows.select("conv_id", (F.col("k") + 1).alias("example"), "examples", whole.alias("formatted"), F.length(last.text).alias("size"), last.learn.alias("learn")).select(
        "conv_id", "example", "examples", "formatted", F.when(F.col("learn"), end - F.col("size")).otherwise(end).alias("loss_start"), end.alias("loss_end")
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted text."""
    pieces = F.filter(F.split(formatted, END, -1), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(unescape(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), "\n", 1)).alias("role"), unescape(F.substr(x, F.instr(x, "\n") + 1)).alias("text")))


def loss_text(examples: DataFrame) -> Column:
    return unescape(F.substr(examples["formatted"], examples["loss_start"] + 1, examples["loss_end"] - examples["loss_start"]))


def op3_chat(spark, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(own)
    examples = materialise(format_examples(turns), "chat")
    told = F.when(F.col("example") == F.col("examples"), read_turns(F.col("formatted")))
    line = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    read = examples.select("conv_id", "example", F.length("formatted").alias("chars"), loss_text(examples).alias("loss"), told.alias("turns"))
    read = read.select("conv_id", "example", "chars", "loss", F.size("turns").alias("n"), F.sha2(line, 256).alias("sha"))
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x.loss), "")
    out = read.groupBy("conv_id").agg(F.max(F.when(F.col("sha").isNotNull(), F.col("n"))).cast("long").alias("n_turns"), F.max("sha").alias("turns_sha256"), loss.alias("loss"), F.sum("chars").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP3_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), f AS (
  SELECT *, length(replace(replace(replace(role, '\\', '\\\\'), '<turn>', '\\lturn>'), '</turn>', '\\l/turn>'))
            + length(regexp_replace(role, '[^\\n]', '', 'g'))
            + length(replace(replace(replace(text, '\\', '\\\\'), '<turn>', '\\lturn>'), '</turn>', '\\l/turn>')) + 15 AS size
  FROM t
), s AS (
  SELECT *, sum(size) OVER w AS upto, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  length(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), ''))::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR k = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
