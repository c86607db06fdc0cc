"""Chat formatting by relational means: turns are gathered and sorted, neighbours of one role merged, and a template filled, all in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def format_chats(turns: DataFrame, open_tag: str = "<|im_start|>", close_tag: str = "<|im_end|>", joiner: str = "\n\n") -> DataFrame:
    """One row for each conv_id of conversations(conv_id, turn, role, text): conv_id, n_turns, n_messages, chat.

    Turns are in the order of turn, then role, then text; neighbours of one role become one message, their
    texts joined by `joiner`. A message is open_tag, role, newline, text, close_tag, newline.

    Nulls: a null text is as "", a null role as "user", a null turn sorts first, and rows of a null conv_id
    make a conversation of their own. Empty texts stay as empty messages. Repeated rows count once each
    (a repeated turn repeats its text). An empty table gives no rows; other columns are ignored; a
    conversation's length is bounded only by what one row can hold."""
    piece = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("turns"))

    # neighbours are looked up by place, so a long conversation takes time in proportion to its turns
    turn = F.col("turns")
    opens = lambda x, i: (i == 0) | (F.get(turn, i - 1)["role"] != x["role"])
    closes = lambda x, i: (i == F.size(turn) - 1) | (F.get(turn, i + 1)["role"] != x["role"])

    def piece_of(x: Column, i: Column) -> Column:
        head = F.when(opens(x, i), F.concat(F.lit(open_tag), x["role"], F.lit("\n"))).otherwise(F.lit(joiner))
        return F.concat(head, x["text"], F.when(closes(x, i), F.lit(close_tag + "\n")).otherwise(F.lit("")))

    first = F.transform(turn, lambda x, i: opens(x, i).cast("int"))
    n_messages = F.aggregate(first, F.lit(0), lambda n, one: n + one)
    return gathered.select("conv_id", F.size(turn).alias("n_turns"), n_messages.alias("n_messages"), F.array_join(F.transform(turn, piece_of), "").alias("chat"))


ORACLE = """
WITH t AS (SELECT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'user'), coalesce(text, '')) AS i
           FROM conversations),
     s AS (SELECT *, i - row_number() OVER (PARTITION BY conv_id, role ORDER BY i) AS island FROM t),
     m AS (SELECT conv_id, role, island, min(i) AS i, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY i) AS text
           FROM s GROUP BY conv_id, role, island)
SELECT conv_id, CAST(sum(n) AS INTEGER) AS n_turns, CAST(count(*) AS INTEGER) AS n_messages,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY i) AS chat
FROM m GROUP BY conv_id
"""
