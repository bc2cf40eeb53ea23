"""Conversations rendered by a compiled template, and read back from the rendered text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tableproof.llm.chat_template import Piece, compile_template

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that a text must not show unescaped, those of other chat formats included.
CONTROLS = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]")

TEMPLATE = (
    "{% for message in messages %}" + TURN + "{{ message.role | escape }}" + TEXT
    + "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}" + END + "{% endfor %}"
)

# First characters of controls, so that overlapping controls are all broken.
_BEGINS = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))


def escape(text: str) -> str:
    """Text in which no control string is left: backslashes doubled, one set after each control's first character."""
    return _BEGINS.sub(r"\g<0>\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """Inverse of ``escape``."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def read_back(pieces: Iterable[Piece]) -> Iterator[tuple[str, str, str, int]]:
    """(role, text, text under the loss mask, characters) of each turn, from the rendered text alone.

    Holds one turn at a time. The mask's text is unescaped after its pieces are joined.
    """
    text, spans, length = "", [], 0
    for piece, generated in pieces:
        if generated:
            spans.append((length, length + len(piece)))
        text, length = text + piece, length + len(piece)
        while (end := text.find(END)) >= 0:
            cut = end + len(END)
            turn, text = text[:cut], text[cut:]
            learned = unescape("".join(turn[max(a, 0) : b] for a, b in spans if a < cut))
            spans = [(a - cut, b - cut) for a, b in spans if b > cut]
            length -= cut
            if not turn.startswith(TURN):
                raise ValueError("a turn does not begin where the last one ended")
            role, mark, body = turn[len(TURN) : -len(END)].partition(TEXT)
            if not mark:
                raise ValueError("a turn has no text")
            yield unescape(role), unescape(body), learned, cut
    if text:
        raise ValueError("the last turn does not end")


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): the rendering's digest columns.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the
    rendered text. Rows are sorted by conversation, turn, role and text in the shuffle and streamed
    through the template, so of a conversation of any length one turn is held. Null roles and texts
    count as empty, null turns come first, a null conv_id is a conversation of its own, repeated
    rows are turns each, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template, {"escape": escape})
        stream = (
            (conv, {"role": role or "", "text": text or ""})
            for batch in batches
            for conv, role, text in zip(*[batch.column(i).to_pylist() for i in (0, 2, 3)])
        )
        out = []
        for conv, messages in groupby(stream, key=lambda r: r[0]):
            turns, learned = hashlib.sha256(), hashlib.sha256()
            n = learned_chars = chars = 0
            for role, text, loss, size in read_back(render({"messages": (m for _, m in messages)})):
                turns.update(f"{role}\n{text}\n".encode())
                learned.update(loss.encode())
                n, learned_chars, chars = n + 1, learned_chars + len(loss), chars + size
            out.append((conv, n, turns.hexdigest(), learned_chars, learned.hexdigest(), chars))
            if len(out) == 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    sorted_rows = (
        rows.select(
            F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string")
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return sorted_rows.mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def format_sql() -> str:
    """DuckDB SQL for the registered query: the template and the escapes written out by hand."""
    safe = lambda c: f"""regexp_replace(regexp_replace(regexp_replace(replace({c}, '\\', '\\\\'),
        '<(\\|turn\\|>|\\|text\\|>|\\|end\\|>|s>|/s>)', '<\\\\\\1', 'g'), '\\[INST\\]', '[\\\\INST]', 'g'), '\\[/INST\\]', '[\\\\/INST]', 'g')"""  # noqa: E731
    return f"""
    WITH c AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
        sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
        sum({len(TURN + TEXT + END)} + length({safe('role')}) + length({safe('text')}))::BIGINT AS formatted_chars
    FROM c GROUP BY conv_id"""
