r"""Chat formatting with a grammar that is read back and compared.

A turn is ``### Role: body</turn>`` and a line break. In a body, a backslash makes the next character plain; an
unescaped ``</turn>`` ends it and an unescaped turn mark is an error. The parser follows this grammar and nothing else.
A turn is first rendered with its text as it is and parsed; only if that does not give back the same turn is its
conflicting content escaped, and the result is parsed and compared again. Turns that come back alone also come back in
a row, as each ends at its own first unescaped end mark, so conversations of any length are formatted turn by turn.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import small_batches

ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
END = "</turn>"
_NAMES = {v: k for k, v in ROLES.items()}
_HEAD = re.compile(r'### (?:(System|User|Assistant)|role=("(?:[^"\\]|\\.)*"|null)): ')
_MARK = r"### (?:System|User|Assistant|role=)"
_TOKEN = re.compile(rf"\\.|{END}|{_MARK}", re.DOTALL)
_CONFLICT = re.compile(rf"\\|{END}|{_MARK}")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


class GrammarError(ValueError):
    """The text is not a sequence of turns."""


def parse(text: str) -> list[tuple[str | None, str]]:
    """Turns of a formatted text, as (role, text)."""
    turns, at = [], 0
    while at < len(text):
        head = _HEAD.match(text, at)
        if not head:
            raise GrammarError(f"no turn begins at character {at}")
        role = _NAMES[head[1]] if head[1] else json.loads(head[2])
        parts, last = [], head.end()
        for m in _TOKEN.finditer(text, head.end()):
            if m[0][0] == "\\":
                parts += [text[last : m.start()], m[0][1]]
                last = m.end()
                continue
            break
        else:
            raise GrammarError("a turn has no end")
        if m[0] != END or text[m.end() : m.end() + 1] != "\n":
            raise GrammarError(f"unescaped {m[0]!r} at character {m.start()}")
        turns.append((role, "".join([*parts, text[last : m.start()]])))
        at = m.end() + 1
    return turns


def unescaped(body: str) -> str:
    """A body without its escapes."""
    return _ESCAPED.sub(r"\1", body) if "\\" in body else body


def head_of(role: str | None) -> str:
    name = ROLES.get(role)
    return f"### {name}: " if name else f"### role={json.dumps(role)}: "


def render(role: str | None, text: str) -> tuple[str, int, int]:
    """A turn that parses back to itself, and where its body begins and ends."""
    head = head_of(role)
    for body in (text, _CONFLICT.sub(lambda m: "\\" + m[0], text)):
        whole = f"{head}{body}{END}\n"
        try:
            if parse(whole) == [(role, text)]:
                return whole, len(head), len(head) + len(body)
        except GrammarError:
            pass
    raise GrammarError("escaping did not make the turn readable")


_TURNS = "conv_id bigint, turn bigint, role string, segment string, body_start int, body_end int, loss boolean"


def format_turns(turns: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` to one formatted segment per row.

    ``loss`` marks segments whose body (``body_start`` to ``body_end``, code points) is trained on: those of the
    assistant. A conversation is its segments in the order of :func:`in_order`, joined by nothing. Null texts are empty;
    any role, null included, is kept; other columns are not read. One output row per input row, nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roles = b.column(2).to_pylist()
            made = [render(r, t or "") for r, t in zip(roles, b.column(3).to_pylist(), strict=True)]
            columns = [
                b.column(0), b.column(1), b.column(2),
                pa.array([m[0] for m in made], type=pa.string()),
                pa.array([m[1] for m in made], type=pa.int32()),
                pa.array([m[2] for m in made], type=pa.int32()),
                pa.array([r == "assistant" for r in roles], type=pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "segment", "body_start", "body_end", "loss"])

    small_batches(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").alias("role"), F.col("text").alias("text")
    )
    return rows.mapInArrow(run, _TURNS)


def in_order(segments: DataFrame) -> DataFrame:
    """Conversations whole and in order in each partition: by turn (null first), then segment where turns are equal."""
    return segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of conversations, from the formatted text and its loss mask alone.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``. The turns are what the parser finds, the
    loss text is what the mask covers, without its escapes. The segments of a conversation are streamed in order through
    the parser and the hashes: no conversation is held in memory, however long; one conversation is one task's, as a
    digest is taken in order. Rows with a null ``conv_id`` form one conversation, a null role is written as none. Repeated
    rows are turns each. An empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, done = None, []

        def close() -> None:
            if state:
                done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def flush() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            columns = [pa.array([d[k] for d in done], type=t) for k, t in enumerate(kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            masks = zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)
            for conv, segment, (start, end, loss) in zip(b.column(0).to_pylist(), b.column(1), masks, strict=True):
                if state is None or state[0] != conv:
                    close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                formatted = segment.as_py()
                state[5] += len(formatted)
                for role, text in parse(formatted):
                    state[1] += 1
                    state[2].update(f"{role or ''}\n{text}\n".encode())
                if loss:
                    text = unescaped(formatted[start:end])
                    state[3] += len(text)
                    state[4].update(text.encode())
            yield flush()
        close()
        yield flush()

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    small_batches(segments.sparkSession)
    return in_order(segments).select("conv_id", "segment", "body_start", "body_end", "loss").mapInArrow(run, schema)
