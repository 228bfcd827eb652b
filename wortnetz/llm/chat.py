"""Operator 3, chat formatting: conversations rendered by a compiled template, with generation markers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, table, text_of
from .templates import compile_template, unescape

#: Marks each turn; roles and texts are escaped, and what an assistant says is under the loss mask.
TEMPLATE = "{% for m in messages %}<turn>{{ m.role | line }}\n{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}"
#: One turn of this template, read back. Inside role and text every control string is escaped. Possessive, and an escape at a
#: time: the matcher keeps no place to go back to, however long a turn is.
TURN = re.compile(r"<turn>([^\\<\n]*+(?:\\.[^\\<\n]*+)*+)\n([^\\<]*+(?:\\.[^\\<]*+)*+)</turn>\n", re.S)


def _rows(parts: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    for part in parts:
        yield from zip(part["no_id"], part["id"], part["role"], part["text"])


def _renderer(template: str, id_col: str):
    def render(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One row per message, or more if a template puts text outside its loop: rows of a conversation follow each other."""
        program = compile_template(template)
        rows = _rows(parts)
        ahead = next(rows, None)
        out: list[tuple] = []
        while ahead is not None:
            key = ahead[:2]

            def messages() -> Iterator[dict]:
                nonlocal ahead
                while ahead is not None and ahead[:2] == key:
                    now, ahead = ahead, next(rows, None)
                    yield {"role": now[2], "text": now[3]}

            text, spans, seq, size = [], [], 0, 0
            for piece in chain(program(messages()), [None]):
                if piece is not None:
                    t, marked = piece
                    if marked and t:
                        spans.append({"start": size, "end": size + len(t)})
                    text.append(t)
                    size += len(t)
                elif text:
                    out.append((None if key[0] else key[1], seq, "".join(text), spans))
                    text, spans, seq, size = [], [], seq + 1, 0
                    if len(out) >= 512:
                        yield _frame(out, id_col)
                        out = []
            while ahead is not None and ahead[:2] == key:  # a template may not read its messages
                ahead = next(rows, None)
        yield _frame(out, id_col)

    return render


def _frame(out: list[tuple], id_col: str) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[id_col, "seq", "formatted", "loss"]).astype({id_col: "Int64"})


def format_conversations(df: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, seq, formatted, loss): the conversation's output in order of seq, a row per message; loss are the spans
    (start, end) of a row's text, in code points, that lie in generation blocks.

    Messages are ordered by turn, then role, then text, so that ties and repeated rows have one order; null turns come
    first, null roles and texts are empty, and rows with a null id are one conversation. A table without rows gives
    none; other columns are not read. A conversation is sorted and streamed, never held: one with a third of all rows
    takes a task of its own but no more memory than a few copies of its longest message.
    """
    bound_batches(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.col(id_col).isNull().alias("no_id"), F.col(turn_col).cast("long").alias("turn"), text_of(role_col).alias("role"), text_of(text_col).alias("text"))
    ordered = slim.repartition(n, "no_id", "id").sortWithinPartitions("no_id", "id", "turn", "role", "text")
    return ordered.mapInPandas(_renderer(template, id_col), f"`{id_col}` long, seq long, formatted string, loss array<struct<start:int,end:int>>")


def _read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of what the output says, conversation by conversation; only running digests are held."""
    out: list[tuple] = []
    key, state = None, None

    def close() -> None:
        if state is not None:
            out.append((None if key[0] else key[1], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    for part in parts:
        ids = part["id"]
        for no_id, i, formatted, loss in zip(part["no_id"], ids, part["formatted"], part["loss"]):
            if key != (no_id, i):
                close()
                key, state = (no_id, i), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            at = 0
            for m in TURN.finditer(formatted):
                if m.start() != at:
                    raise ValueError("output between turns")
                at = m.end()
                state[0] += 1
                state[1].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            if at != len(formatted):
                raise ValueError("output after the last turn")
            for span in loss:
                said = unescape(formatted[span["start"] : span["end"]])
                state[2] += len(said)
                state[3].update(said.encode())
            state[4] += len(formatted)
        yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})
        out = []
    close()
    yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]).astype({"conv_id": "Int64"})


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its output says, by parsing it: number and digest of turns, length and digest of the text
    under the loss mask, and the output's length. Reads the rows in the order in which they were formatted."""
    rows = formatted.select(F.coalesce("conv_id", F.lit(0)).alias("id"), F.col("conv_id").isNull().alias("no_id"), "formatted", "loss")
    return rows.mapInPandas(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The contract's extra conversation (fixed values).
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the contract's extra one, formatted and read back; nulls, ties, repeated rows and a table without
    rows as format_conversations has them."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.union(probe)))


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn></turn>') + 2 + length(role) + length(text) + length(role || text) - length(replace(replace(role || text, '\', ''), '<', ''))
    + length(role) - length(replace(role, chr(10), ''))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
