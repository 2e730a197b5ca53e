"""Chat formatting by grammar round trip: render, reparse, compare, escape until the same turns come back.

The template: a turn is ``<|turn|>ROLE<|says|>TEXT<|done|>``.  The control strings start with ``<|``; inside roles and
texts every ``<``, backslashes, ``|`` run gets one more backslash, which no control string has, so the parser finds the turns
whatever the texts say and takes one backslash off again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_batches

OPEN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
_ESCAPE = re.compile(r"<(\\*)\|")
_UNESCAPE = re.compile(r"<\\(\\*)\|")
_CONTROL = re.compile(r"<\|(turn|says|done)\|>")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render_turn(role: str, text: str) -> str:
    return f"{OPEN}{role}{SAYS}{text}{DONE}"


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns of a formatted text: role, text, and where the (still escaped) text starts and ends.  Raises ValueError on other input."""
    turns, at = [], 0
    while at < len(formatted):
        found = [_CONTROL.search(formatted, at)]
        for _ in range(2):
            found.append(_CONTROL.search(formatted, found[-1].end()) if found[-1] else None)
        if not all(found) or [m[0] for m in found] != [OPEN, SAYS, DONE] or found[0].start() != at:
            raise ValueError(f"no turn at {at}")
        start, says, done = found
        turns.append((unescape(formatted[start.end() : says.start()]), unescape(formatted[says.end() : done.start()]), says.end(), done.start()))
        at = done.end()
    return turns


def format_turn(role: str, text: str) -> str:
    """The turn's rendered text, its contents escaped only as often as the round trip needs."""
    r, t = role, text
    for _ in range(3):
        piece = render_turn(r, t)
        try:
            if [x[:2] for x in parse(piece)] == [(role, text)]:
                return piece
        except ValueError:
            pass
        r, t = escape(role), escape(text)
    raise AssertionError("escaping is reversible")


RENDERED = "conv_id long, turn long, piece string, loss_start long, loss_end long"


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, at = object(), 0
    for b in batches:
        cols = {k: b.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text")}
        out: dict[str, list] = {k: [] for k in ("conv_id", "turn", "piece", "loss_start", "loss_end")}
        for c, turn, role, text in zip(*cols.values()):
            if c != conv:
                conv, at = c, 0
            piece = format_turn(role or "", text or "")
            (_, _, start, end), = parse(piece)
            learn = role == "assistant"
            for k, v in zip(out, (c, turn, piece, at + start if learn else None, at + end if learn else None)):
                out[k].append(v)
            at += len(piece)
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("piece", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())]))


def format_conversations(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, piece, loss_start, loss_end): a conversation's formatted text is its pieces in this order.

    ``loss_start`` and ``loss_end`` are the places (code points in the whole formatted text) that an assistant's turn puts under the
    loss.  Null role or text: empty.  A null turn comes first; equal turns are ordered by role and text; repeated rows are
    repeated turns.  Rows without conv_id form one conversation without id.  An empty table gives an empty result.  Rows stream through sorted
    partitions, so that no conversation is held whole, however long it is; its turns follow one another, so one task writes it.
    """
    text_batches(turns.sparkSession)
    t = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(_render, RENDERED)


class _Reader:
    """Reads one conversation back from its formatted pieces, as a stream."""

    def __init__(self, conv):
        self.conv, self.rest, self.n, self.chars, self.loss = conv, "", 0, 0, 0
        self.turns, self.learned = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, start, end) -> None:
        at = self.chars
        self.chars += len(piece)
        for role, text, _, _ in parse(piece):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
        if start is not None:
            text = unescape(piece[start - at : end - at])
            self.loss += len(text)
            self.learned.update(text.encode())

    def row(self) -> tuple:
        return (self.conv, self.n, self.turns.hexdigest(), self.loss, self.learned.hexdigest(), self.chars)


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = None
    for b in batches:
        rows = []
        for c, piece, start, end in zip(*(b.column(k).to_pylist() for k in ("conv_id", "piece", "loss_start", "loss_end"))):
            if reader is None or reader.conv != c:
                rows += [reader.row()] if reader else []
                reader = _Reader(c)
            reader.feed(piece, start, end)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(DIGEST), DIGEST)], schema=DIGEST)
    if reader:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(reader.row(), DIGEST)], schema=DIGEST)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what a parser finds in the formatted pieces, which must still be in their order."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted text."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    trial = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", trial), (-1, 1, "assistant", trial)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(added)))


OP3_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  -- one more character for every run of <, backslashes, | where a turn has a control string, or a run that reading back would shorten
  select *, case when regexp_matches(role || chr(10) || text, '<\|(turn|says|done)\|>|<\\+\|') then len(regexp_extract_all(role || chr(10) || text, '<\\*\|')) else 0 end as escapes from t)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(24 + length(role) + length(text) + escapes)::bigint as formatted_chars
from e group by conv_id
"""
