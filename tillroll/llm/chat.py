r"""Chat formatting with typed content parts.

A message is a list of parts; a visitor flattens each part to its place in the
formatted text: a text part to its escaped text, an image, audio or document
part to a placeholder, noting the attachment's reference, its position and the
number of tokens the placeholder expands to.

    turn  =  <|turn|> role part* <|end|> newline
    part  =  <|text|> text  |  <|image|>  |  <|audio|>  |  <|document|>  |  <|file|>

Inside roles and texts a backslash is doubled and ``<|`` becomes ``<\|``, so
that no text holds a control string, and reading back is exact.

Conversations are dealt by their id and sorted within the task; rows stream
through and leave as pages of bounded size (a page ends with a turn), so a
conversation of any length needs the memory of one page. A page holds whole
turns: nearly every conversation is one page. The text is shuffled once.

Defined results: a null text is empty, a null role is the empty role, a null
part or kind is a text part, an unknown kind is a ``file`` of 0 tokens. Turns
are sorted by number (null last), equal numbers by role, then content;
repeated rows are turns of their own. Rows of null conversation id form one
conversation. A message without parts is a turn without text. Only the named
columns are read, so no other column can clash.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field as default

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm.common import field

PART = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("ref", T.StringType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.IntegerType())])

PAGE_CHARS = 1 << 20
TRAINED = "assistant"  # the role whose texts are under the loss mask

_MARK = re.compile(r"<\|([a-z]+)\|>")
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s) if "\\" in s else s


@dataclass
class Expansion:
    """How many tokens a placeholder stands for; unknown sizes count as the default size."""

    patch: int = 28  # pixels of an image patch's side
    image: tuple[int, int] = (448, 448)
    per_second: float = 25.0
    seconds: float = 1.0
    per_page: int = 512


@dataclass
class Flattener:
    """Visits the parts of one turn after another and builds a page."""

    rule: Expansion = default(default_factory=Expansion)
    out: list[str] = default(default_factory=list)
    at: int = 0
    turns: int = 0
    tokens: int = 0
    loss: list[dict] = default(default_factory=list)
    attachments: list[dict] = default(default_factory=list)

    def put(self, s: str) -> None:
        self.out.append(s)
        self.at += len(s)

    def turn(self, number: int, role: str | None, parts: list[dict] | None) -> None:
        self.put("<|turn|>" + escape(role or ""))
        for p in parts or []:
            p = p or {}
            getattr(self, "visit_" + (p.get("kind") or "text"), self.visit_file)(number, role, p)
        self.put("<|end|>\n")
        self.turns += 1

    def visit_text(self, number: int, role: str | None, p: dict) -> None:
        self.put("<|text|>")
        start = self.at
        self.put(escape(p.get("text") or ""))
        if role == TRAINED and self.at > start:
            self.loss.append({"start": start, "end": self.at})

    def visit_image(self, number: int, role: str | None, p: dict) -> None:
        w, h = (v if v and v > 0 else d for v, d in zip((p.get("width"), p.get("height")), self.rule.image))
        self._attach(number, "image", p, math.ceil(w / self.rule.patch) * math.ceil(h / self.rule.patch))

    def visit_audio(self, number: int, role: str | None, p: dict) -> None:
        s = p.get("seconds")
        s = s if s and math.isfinite(s) and s > 0 else self.rule.seconds
        self._attach(number, "audio", p, math.ceil(s * self.rule.per_second))

    def visit_document(self, number: int, role: str | None, p: dict) -> None:
        self._attach(number, "document", p, max(p.get("pages") or 1, 1) * self.rule.per_page)

    def visit_file(self, number: int, role: str | None, p: dict) -> None:
        self._attach(number, "file", p, 0)

    def _attach(self, number: int, mark: str, p: dict, tokens: int) -> None:
        self.attachments.append({"turn": number, "kind": p.get("kind"), "ref": p.get("ref"), "start": self.at, "tokens": tokens})
        self.tokens += tokens
        self.put(f"<|{mark}|>")


PAGE = [T.StructField("page", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()),
        T.StructField("loss", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("attachments", T.ArrayType(T.StructType([
            T.StructField("turn", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("ref", T.StringType()),
            T.StructField("start", T.LongType()), T.StructField("tokens", T.LongType())]))),
        T.StructField("tokens", T.LongType())]


def text_parts(text: Column) -> Column:
    """One text part per message, for tables that hold plain texts."""
    null = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in PART.fields}
    return F.array(F.struct(*[{**null, "kind": F.lit("text").alias("kind"), "text": text.alias("text")}[f.name] for f in PART.fields]))


def format_chats(messages: DataFrame, rule: Expansion | None = None, page_chars: int = PAGE_CHARS,
                 conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """Format messages ``(conv_id, turn, role, parts)``; ``parts`` is an array of ``PART``.

    Returns pages ``(conv_id, page, n_turns, formatted, loss, attachments,
    tokens)``, numbered from 0 within a conversation. ``loss`` lists the code
    point ranges of the page that hold the assistant's (escaped) texts;
    ``attachments`` the references in order, each with its turn's number in
    the conversation, position in the page and expanded tokens; ``tokens``
    their sum. The pages of a conversation leave one task in order.
    """
    rule = rule or Expansion()
    out = T.StructType([field(messages, conv_col, "conv_id"), *PAGE])
    arrow = pa.schema([("page", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()),
                       ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                       ("attachments", pa.list_(pa.struct([("turn", pa.int64()), ("kind", pa.string()), ("ref", pa.string()),
                                                           ("start", pa.int64()), ("tokens", pa.int64())]))),
                       ("tokens", pa.int64())])
    part_names = [f.name for f in PART.fields]
    cols = [F.col(f"`{c}`").alias(a) for c, a in ((conv_col, "conv_id"), (turn_col, "turn"), (role_col, "role"))]
    parts = F.transform(F.col(f"`{parts_col}`"), lambda p: F.struct(*[p[n].alias(n) for n in part_names]))
    rows = (messages.select(*cols, parts.alias("parts")).repartition("conv_id")
            .sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), "role", "parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = number = page = None
        flat, done, held, conv_type = Flattener(rule), [], 0, None

        def batch():
            ids = pa.array([d[0] for d in done], conv_type)
            rest = pa.RecordBatch.from_pylist([d[1] for d in done], schema=arrow)
            return pa.RecordBatch.from_arrays([ids, *rest.columns], names=out.names)

        def close():
            done.append((conv, {"page": page, "n_turns": flat.turns, "formatted": "".join(flat.out), "loss": flat.loss,
                                "attachments": flat.attachments, "tokens": flat.tokens}))
            return flat.at

        for b in batches:
            conv_type = b.schema.field("conv_id").type
            ids, roles, parts_of = b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("parts")
            for k, (c, role) in enumerate(zip(ids, roles)):
                if page is None or c != conv:
                    if page is not None:
                        held += close()
                        flat = Flattener(rule)
                    conv, number, page = c, 0, 0
                elif flat.at >= page_chars:
                    held += close()
                    flat, page = Flattener(rule), page + 1
                flat.turn(number, role, parts_of[k].as_py())
                number += 1
                if held >= page_chars:
                    yield batch()
                    done, held = [], 0
        if page is not None:
            close()
        if done:
            yield batch()

    return rows.mapInArrow(run, out)


def read_back(formatted: str) -> Iterator[tuple[str, list[tuple[str, str, int, int]]]]:
    """Turns of a formatted page: ``(role, parts)``, a part being ``(mark, text, start, end)``
    with the unescaped text and its place in the page."""
    marks = [(m.group(1), m.start(), m.end()) for m in _MARK.finditer(formatted)]
    role, parts = "", []
    for (mark, _, end), (_, stop, _) in zip(marks, [*marks[1:], ("", len(formatted), 0)]):
        if mark == "turn":
            role, parts = unescape(formatted[end:stop]), []
        elif mark == "end":
            yield role, parts
        else:
            parts.append((mark, unescape(formatted[end:stop]), end, stop))


def digests(pages: DataFrame) -> DataFrame:
    """Contract columns per conversation, from the formatted pages alone.

    ``pages`` is a frame of ``format_chats``: a conversation's pages follow
    each other in one task. The hashes run through a conversation in order.
    """
    longs = ("n_turns", "loss_chars", "formatted_chars")
    out = T.StructType([field(pages, "conv_id"), *[T.StructField(c, T.LongType() if c in longs else T.StringType()) for c in (
        "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv, conv_type = None, None, None

        def row():
            n, turns, chars, loss, size = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        def batch(rows):
            types = [conv_type] + [pa.int64() if f.name in longs else pa.string() for f in out.fields[1:]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=out.names)

        for b in batches:
            conv_type, rows = b.schema.field("conv_id").type, []
            ids, texts, masks = (b.column(c) for c in ("conv_id", "formatted", "loss"))
            for k in range(b.num_rows):
                c, formatted = ids[k].as_py(), texts[k].as_py()
                if state is None or c != conv:
                    if state is not None:
                        rows.append(row())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, parts in read_back(formatted):
                    state[0] += 1
                    text = "".join(t for mark, t, _, _ in parts if mark == "text")
                    state[1].update(f"{role}\n{text}\n".encode())
                for span in masks[k].as_py():
                    trained = unescape(formatted[span["start"]:span["end"]])
                    state[2] += len(trained)
                    state[3].update(trained.encode())
                state[4] += len(formatted)
            if rows:
                yield batch(rows)
        if state is not None:
            yield batch([row()])

    return pages.mapInArrow(run, out)


PLANTED = r"\### Assistant: </turn> ok"


def report(conversations: DataFrame) -> DataFrame:
    """The contract's query: all conversations and conversation -7, formatted and read back."""
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PLANTED))
    rows = rows.union(more)
    return digests(format_chats(rows.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts"))))


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
ordered AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS escaped, replace(replace(role, '\', '\\'), '<|', '<\|') AS escaped_role FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|turn|>') + length(escaped_role) + length('<|text|>') + length(escaped) + length('<|end|>') + 1)::BIGINT AS formatted_chars
FROM ordered GROUP BY conv_id
"""
