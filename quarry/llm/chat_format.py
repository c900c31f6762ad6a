r"""Chat formatting with a grammar round trip (operator 10).

A turn is rendered as ``<s>[INST] role [/INST]\ntext</s>\n`` and a conversation is the turns one after
the other. The deterministic parser reads that grammar back and always unescapes. A turn is rendered
with its text as it is, reparsed, and compared with the source; only where the recovered turn differs
(the text holds a control string, or something that looks like an escaped one) the conflicting content
is escaped and the check repeated until it is identical. Escaping puts one backslash behind the first
character of a control string (``<\s>``, ``[\/INST]``) and one more where there are some already, so it is
reversible for every text.

Turns are rendered where they lie (no shuffle); their order within a conversation comes from a sort
inside hash partitions of ``conv_id``, and the read-back streams over the sorted pieces with
incremental digests, so a conversation of any length takes constant memory.

Edge cases: NULL text and NULL role are empty strings; repeated rows are turns of their own; ties of
``turn`` are ordered by role, then text; NULL ``turn`` sorts first; rows of NULL ``conv_id`` form one
conversation; unknown roles are kept; the loss mask covers the role ``assistant`` only; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready

BEGIN, END, HEAD, BODY = "<s>", "</s>", "[INST]", "[/INST]"
LOSS_ROLE = "assistant"
#: A control string, possibly with backslashes behind its first character.
CONTROL = re.compile(r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])")
_ESCAPED = re.compile(r"(<)\\(\\*)(/?s>)|(\[)\\(\\*)(/?INST\])")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: f"{m[1] or m[4]}\\{m[2] if m[1] else m[5]}{m[3] or m[6]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"{m[1] or m[4]}{m[2] if m[1] else m[5]}{m[3] or m[6]}", text)


class ParseError(ValueError):
    """The text is not a sentence of the grammar."""


class Parser:
    """Incremental parser: feed formatted text in any pieces, get the turns that are complete."""

    def __init__(self):
        self.rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        self.rest += text
        while True:
            stop = self.rest.find(END + "\n")
            if stop < 0:
                return
            turn, self.rest = self.rest[:stop], self.rest[stop + len(END) + 1:]
            head = f"{BEGIN}{HEAD} "
            middle = turn.find(f" {BODY}\n")
            if not turn.startswith(head) or middle < len(head) - 1:
                raise ParseError("a turn does not begin with its header")
            role, body = turn[len(head):middle], turn[middle + len(BODY) + 2:]
            for part in (role, body):
                if any(s in part for s in (BEGIN, END, HEAD, BODY)):
                    raise ParseError("a control string stands inside a turn")
            yield unescape(role), unescape(body)

    def close(self) -> None:
        if self.rest:
            raise ParseError("the text ends inside a turn")


def parse(text: str) -> list[tuple[str, str]]:
    """All turns of a formatted text."""
    parser = Parser()
    turns = list(parser.feed(text))
    parser.close()
    return turns


def _rendered(role: str, text: str) -> str:
    return f"{BEGIN}{HEAD} {role} {BODY}\n{text}{END}\n"


def render(role: str, text: str) -> str:
    """The formatted turn; content is escaped only as far as the round trip needs."""
    source = [(role, text)]
    parts = [role, text]
    for k in (None, 1, 0):  # as it is, then with the text escaped, then the role too
        if k is not None:
            parts[k] = escape(source[0][k])
        out = _rendered(*parts)
        try:
            if parse(out) == source:
                return out
        except ParseError:
            pass
    raise ParseError(f"no round trip for {source!r}")


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, formatted, loss_start, loss_end`` of every turn row.

    ``formatted`` holds the turn's part of the training text; the conversation's text is their
    concatenation in order. ``loss_start`` and ``loss_end`` delimit the (escaped) text under the loss mask
    inside ``formatted`` (NULL outside assistant turns).
    """
    ready(conversations.sparkSession)
    out = T.StructType([
        T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
        T.StructField("role", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("formatted", T.StringType()), T.StructField("loss_start", T.LongType()),
        T.StructField("loss_end", T.LongType())])

    def run(batches):
        for batch in batches:
            role, text = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            formatted = [render(r or "", t or "") for r, t in zip(role, text)]
            end = [len(f) - len(END) - 1 if r == LOSS_ROLE else None for r, f in zip(role, formatted)]
            start = [f.index(f" {BODY}\n") + len(BODY) + 2 if r == LOSS_ROLE else None
                     for r, f in zip(role, formatted)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(role, pa.string()),
                 pa.array(text, pa.string()), pa.array(formatted, pa.string()),
                 pa.array(start, pa.int64()), pa.array(end, pa.int64())],
                names=out.fieldNames())

    c = conversations
    return c.select(c["conv_id"].cast("long"), c["turn"].cast("long"), c["role"].cast("string"),
                    c["text"].cast("string")).mapInArrow(run, out)


class _Reading:
    """Digests of one conversation, read back from its formatted text."""

    def __init__(self):
        self.parser = Parser()
        self.turns = self.loss = self.chars = 0
        self.all, self.masked = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str) -> None:
        self.chars += len(piece)
        for role, text in self.parser.feed(piece):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == LOSS_ROLE:
                self.loss += len(text)
                self.masked.update(text.encode("utf-8", "surrogatepass"))

    def row(self, conv_id) -> tuple:
        self.parser.close()
        return (conv_id, self.turns, self.all.hexdigest(), self.loss, self.masked.hexdigest(), self.chars)


def read_back(turns: DataFrame) -> DataFrame:
    """One row per conversation, computed by parsing its formatted text."""
    out = T.StructType([
        T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
                        ("formatted_chars", pa.int64())])

    def run(batches):
        current, reading, begun = None, _Reading(), False
        for batch in batches:
            rows = []
            for conv, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
                if begun and conv != current:
                    rows.append(reading.row(current))
                    reading = _Reading()
                current, begun = conv, True
                reading.feed(piece.as_py())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)],
                                                 schema=schema)
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(reading.row(current), schema)],
                                             schema=schema)

    ordered = (turns.select("conv_id", "turn", "role", "text", "formatted")
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text"))
    return ordered.select("conv_id", "formatted").mapInArrow(run, out)


def probe(spark) -> DataFrame:
    """The contract's extra conversation whose texts look like the template itself."""
    text = "</s>[INST] ok [/INST]"
    return spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LOSS_ROLE).alias("role"), F.lit(text).alias("text"))
