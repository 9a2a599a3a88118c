"""Chat formatting from event logs: final messages are folded from events, then rendered.

A log row is an event (conv_id, message, seq, kind, role, text). `message` names
a message and orders the messages of its conversation; `seq` orders its events.
Both are of any type that sorts. Kinds:

    open        the message begins, with its role and perhaps some text
    delta       a streamed piece, appended
    edit        the text so far is replaced
    regenerate  the text so far is dropped; what follows is a new attempt

Logs are dealt by conversation and message and sorted by sequence, and a task
folds the events as they stream by. It holds the text of one message, so a
conversation with a third of all rows is many tasks. Messages are rendered one
by one; a conversation's text is its messages' in order.

Template: `<|im_start|>role\\ntext<|im_end|>\\n`. Control strings inside texts get
a backslash after their first character, and those that have backslashes there
one more, so no text holds a control string and taking one backslash away gives
the text back. In roles a line feed is written `\\n` and a backslash twice.
The loss mask of a message is a span of code points: an assistant's text.

Defined results: null text or role is empty; a message whose events name no role
has an empty one, and the last role named counts; an event that is there several
times (same message, seq, kind, role and text) happens once; events of one seq go by
kind, role and text; null messages and seqs come first; other kinds change
nothing; a null conv_id is a conversation of its own; other columns are not read;
an empty log gives an empty table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Control strings of common chat templates.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"
#: Pieces of a streamed text: characters of each, and how many at most.
PIECE, PIECES = 512, 16


def _pattern(backslashes: str) -> str:
    """A control string's first character and the backslashes after it, before the rest."""
    by_first: dict[str, list[str]] = {}
    for c in CONTROLS:
        by_first.setdefault(c[0], []).append(re.sub(r"([\[\]|/])", r"\\\1", c[1:]))
    return "|".join(rf"\{first}{backslashes}(?={'|'.join(rest)})" for first, rest in by_first.items())


PLAIN, ESCAPED = _pattern(r"\\*"), _pattern(r"\\+")
_ESCAPED = re.compile(ESCAPED)
_TURN = re.compile(rf"{re.escape(START)}(.*?)\n(.*){re.escape(END)}", re.DOTALL)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, r"$0\\")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][:-1], text)


def fold(log: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of `log`."""
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    event = ["seq", "kind", "role", "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, role, parts, last = None, "", [], None
        for batch in batches:
            out: list[int] = []
            done: list[tuple[str, str]] = []
            names = pa.StructArray.from_arrays([batch.column("conv_id"), batch.column("message")], ["conv_id", "message"])
            for name, *now in zip(names.to_pylist(), *(batch.column(c).to_pylist() for c in event)):
                if at is not None and name != at[1]:
                    done.append((role, "".join(parts)))
                    out.append(at[0])
                    at = None
                if at is None:
                    at, role, parts, last = (name, name), "", [], None
                if now == last:
                    continue
                last = now
                _, kind, who, text = now
                role = who if who is not None else role
                if kind in ("edit", "regenerate"):
                    parts = []
                if kind in ("open", "delta", "edit") and text:
                    parts.append(text)
            yield _messages(out, done, names.type)
        if at is not None:
            yield _messages([at[0]], [(role, "".join(parts))], names.type)

    order = ["conv_id", "message", *event]
    dealt = log.select(*order).repartition("conv_id", "message").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, f"conv_id {kinds['conv_id']}, message {kinds['message']}, role string, text string")


def _messages(names: list[dict], done: list[tuple[str, str]], kind: pa.StructType) -> pa.RecordBatch:
    named = pa.array(names, kind)
    role, text = zip(*done) if done else ((), ())
    return pa.RecordBatch.from_arrays([*named.flatten(), pa.array(role, pa.string()), pa.array(text, pa.string())], ["conv_id", "message", "role", "text"])


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, message, formatted, loss_start, loss_end): each message by the template; the span is null unless it is the assistant's."""
    role = escape(F.replace(F.replace("role", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))
    head, body = F.concat(F.lit(START), role, F.lit("\n")), escape(F.col("text"))
    mine = F.col("role") == ASSISTANT
    start = F.when(mine, F.length("head")).cast("long")
    return messages.select("conv_id", "message", "role", head.alias("head"), body.alias("body")).select(
        "conv_id", "message", F.concat("head", "body", F.lit(END)).alias("formatted"), start.alias("loss_start"), (start + F.length("body")).alias("loss_end"))


def format_log(log: DataFrame) -> DataFrame:
    """The rendered final messages of `log`."""
    return render(fold(log))


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a rendered message."""
    role, text = _TURN.fullmatch(formatted).groups()
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)), unescape(text)


def digests(rendered: DataFrame) -> DataFrame:
    """What a reader of `rendered` finds in each conversation: turns, their digest, the text under the loss mask.

    A digest goes through a conversation from its first turn to its last, so one
    conversation is one task's, which holds one message at a time.
    """
    kind = rendered.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = turns = loss = n = chars = length = None

        def row() -> tuple:
            return (at[0], n, turns.hexdigest(), chars, loss.hexdigest(), length)

        def table(rows: list[tuple], conv: pa.DataType) -> pa.RecordBatch:
            kinds = [conv, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, kinds)], names)

        for batch in batches:
            done = []
            for conv, formatted, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if at is not None and at[0] != conv:
                    done.append(row())
                    at = None
                if at is None:
                    at, turns, loss, n, chars, length = (conv,), hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                turns.update("".join(f"{v}\n" for v in read_turn(formatted)).encode())
                n, length = n + 1, length + len(formatted)
                if start is not None:
                    learnt = unescape(formatted[start:end])
                    loss.update(learnt.encode())
                    chars += len(learnt)
            yield table(done, batch.schema.field("conv_id").type)
        if at is not None:
            yield table([row()], batch.schema.field("conv_id").type)

    dealt = rendered.repartition("conv_id").sortWithinPartitions("conv_id", "message")
    return dealt.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(run, schema)


def as_log(conversations: DataFrame) -> DataFrame:
    """The log a chat server would have written for `conversations(conv_id, turn, role, text)`.

    Texts come in pieces. One assistant turn in four was broken off and
    regenerated, one other turn in four was edited. Turns of one number are in
    order of role and text hashes; repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    message = F.struct("turn", F.col("role").alias("who"), F.xxhash64("text").alias("what"), "row").alias("message")
    size = F.greatest(F.lit(PIECE), F.ceil(F.length("text") / PIECES).cast("int"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / size).cast("int")), lambda i: F.substring(F.col("text"), i * size + 1, size))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("text"))
    draft = F.upper(F.substring("text", 1, 64))
    chance, mine = F.pmod(F.xxhash64("role", "text"), F.lit(4)) == 0, F.col("role") == ASSISTANT
    stream = F.transform(pieces, lambda p: event("delta", p))
    events = F.when(chance & mine, F.concat(F.array(event("delta", draft), event("regenerate", F.lit(None))), stream)).when(
        chance, F.array(event("delta", draft), event("edit", F.col("text")))).otherwise(stream)
    opened = F.concat(F.array(event("open", F.lit(None))), events)
    return rows.select("conv_id", message, "role", F.posexplode(opened).alias("seq", "event")).select(
        "conv_id", "message", "seq", "event.kind", F.when(F.col("seq") == 0, F.col("role")).alias("role"), "event.text")


#: DuckDB: straight from the turns; control strings are escaped by the same rule, written without looking ahead.
ORACLE = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, k, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(k, r)),
written as (
  select *, regexp_replace(regexp_replace(text, '<(\\*)(\|(im_start|im_end|endoftext|system|user|assistant)\|>|/?s>|</?SYS>>)', '<\1\\\2', 'g'),
    '\[(\\*)(/?INST\])', '[\1\\\2', 'g') as body from turns)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length('<|im_start|>') + length(role) + 1 + length(body) + length('<|im_end|>') + 1)::bigint as formatted_chars
from written group by conv_id
"""
