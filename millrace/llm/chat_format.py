"""Chat formatting by prefix-target expansion.

Every assistant turn becomes one example: all turns before it as context, that reply as the only trainable part. Turns after the
last reply form a last example without a trainable part, so no turn is lost. A turn is written
``### Role: text</turn>\\n``; control strings inside a text (or a role) are escaped, so any text comes back exactly: ``\\`` as
``\\\\``, ``###`` as ``\\h``, ``</turn>`` as ``\\t``, and in roles also ``:`` as ``\\c``.

A conversation is gathered in one row, as the training example it is. Its examples together are longer, by the square of its
turns: they are written one by one, in batches of about CHUNK characters, so a task holds a batch and one example beyond.

Defined results: null texts and roles are empty; turns are ordered by turn number (null first), then role, then text, and repeated
rows are repeated turns; rows with a null conversation are one conversation; roles other than ``assistant`` are context; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._spark import table

END = "</turn>"
CHUNK = 4 << 20
_TURN = re.compile(r"### ((?:[^:\\]|\\.)*): (.*?)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_BACK = {"\\": "\\", "h": "###", "t": END, "c": ":"}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\h").replace(END, "\\t")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: _BACK[m.group(1)], text)


def expand(turns: Iterable[tuple[str, str]]) -> Iterator[tuple[str, int, int]]:
    """(formatted text, start and end of the trainable part) of every example, one by one; (n, n) of one without."""
    text, loose = "", False
    for role, said in turns:
        body = escape(said)
        head = f"### {escape(role).replace(':', chr(92) + 'c')}: "
        start = len(text) + len(head)
        text += f"{head}{body}{END}\n"
        loose = role != "assistant"
        if not loose:
            yield text, start, start + len(body)
    if loose:
        yield text, len(text), len(text)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted example."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)]


def examples(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, example, formatted, loss_start, loss_end): offsets in code points of the only part to train on.

    A conversation's examples stand one after another in one partition, in order."""
    kind = conversations.schema[key].dataType.simpleString()
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = conversations.select(F.col(key).alias("key"), F.struct(F.col(turn).alias("n"), empty(role).alias("role"), empty(text).alias("text")).alias("t"))
    whole = rows.groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    names = ("key", "example", "formatted", "loss_start", "loss_end")

    def go(batches):
        got, room = [], 0
        for batch in batches:
            types = (batch.schema.field("key").type, pa.int32(), pa.large_string(), pa.int64(), pa.int64())
            keys, lists = batch.column("key"), batch.column("turns")
            for row in range(batch.num_rows):
                turns = ((t["role"], t["text"]) for t in lists[row].as_py())
                for i, x in enumerate(expand(turns)):
                    got.append((keys[row].as_py(), i, *x))
                    room += len(x[0])
                    if room >= CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True)], names)
                        got, room = [], 0
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), types, strict=True)], names)
                got, room = [], 0

    return whole.mapInArrow(go, f"key {kind}, example int, formatted string, loss_start long, loss_end long").withColumnRenamed("key", key)


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    made = examples(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))

    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples")
    types = [pa.string() if "sha" in n else pa.int64() for n in names]

    def go(batches):
        """Conversation by conversation, holding its last example and running digests."""
        key = last = None
        loss, n_loss, chars, n = sha256(), 0, 0, 0

        def digest() -> tuple:
            turns = parse(last)
            return (key, len(turns), sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), n_loss, loss.hexdigest(), chars, n)

        for batch in batches:
            out = []
            for k, i, text, a, b in zip(*(batch.column(c) for c in ("conv_id", "example", "formatted", "loss_start", "loss_end")), strict=True):
                if i.as_py() == 0:
                    if n:
                        out.append(digest())
                    key, loss, n_loss, chars, n = k.as_py(), sha256(), 0, 0, 0
                last = text.as_py()
                said = unescape(last[a.as_py() : b.as_py()])
                loss.update(said.encode())
                n_loss, chars, n = n_loss + len(said), chars + len(last), n + 1
            yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate(types)], names)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(digest(), types, strict=True)], names)

    return made.mapInArrow(go, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")


_E = r"replace(replace(replace({}, '\', '\\'), '###', '\h'), '</turn>', '\t')"
ORACLE_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
o AS (SELECT *, row_number() OVER w AS i, sum(length({_E.format('text')}) + length(replace({_E.format('role')}, ':', '\c')) + 14) OVER w AS upto, count(*) OVER (PARTITION BY conv_id) AS n FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars, count(*) FILTER (WHERE role = 'assistant' OR i = n)::BIGINT AS n_examples FROM o GROUP BY 1
"""
