"""Chat formatting, checked by a grammar round trip.

A conversation is rendered as

    conversation = { turn }
    turn         = "<|im_start|>" role "\\n" text "<|im_end|>" "\\n"

Turns are rendered plain first. The rendered text is parsed again by the deterministic parser of this grammar, and the turns found
are compared with the source; where they differ, the content that conflicts is escaped, and the text is parsed again, until both
are identical. Escaping puts one more backslash between "<" and "|" wherever only backslashes stand there, and the parser takes
one away; in roles, backslashes, line breaks and < become letters behind a backslash. So control strings never stand inside content, and text that
looks escaped comes back as it was.

The text of assistant turns is under the loss mask: spans of the rendered text, without control strings.

A conversation comes out as segments in order, each of whole turns and about `segment` characters, so that one with very many turns
is never held at once; their concatenation is the formatted conversation. Turns stand in the order of turn, then role, then text,
nulls first. Null roles and texts are empty; a null conv_id is a conversation of its own; a turn number may repeat, and so may whole rows,
all of which are kept. A turn is never cut, so a very long text makes a segment of its own. Empty tables give empty tables. Only conv_id,
turn, role and text are read, so further columns may have any names."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.llm.common import parallelism

START, END = "<|im_start|>", "<|im_end|>"
_OPEN = re.compile(r"<(\\*)\|")
_SHUT = re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("\n", "\\n").replace("<", "\\l")


def unescape_role(role: str) -> str:
    return _ROLE.sub(lambda m: {"n": "\n", "l": "<"}.get(m[1], m[1]), role)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, begin, end) of each turn, begin:end being where its escaped text stands. Raises ValueError where the grammar ends."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError(f"no turn begins at {at}")
        head = text.find("\n", at + len(START))
        end = text.find("<|", head + 1)
        if head < 0 or "<|" in text[at + len(START) : head] or not text.startswith(END + "\n", end):
            raise ValueError(f"the turn at {at} has no end")
        out.append((unescape_role(text[at + len(START) : head]), unescape(text[head + 1 : end]), head + 1, end))
        at = end + len(END) + 1
    return out


def render_turn(role: str, text: str) -> str:
    """A turn, escaped where it would not be read back as it is."""
    for form in ((role, text), (role, escape(text)), (escape_role(role), text), (escape_role(role), escape(text))):
        out = f"{START}{form[0]}\n{form[1]}{END}\n"
        try:
            if [x[:2] for x in parse(out)] == [(role, text)]:
                return out
        except ValueError:
            pass
    raise AssertionError("escaped content is always read back")


def render(turns: list[tuple[str, str]]) -> str:
    """Turns as one text that is read back as they are."""
    out = "".join(f"{START}{r}\n{t}{END}\n" for r, t in turns)
    try:
        if [x[:2] for x in parse(out)] == turns:
            return out
    except ValueError:
        pass
    out = "".join(render_turn(r, t) for r, t in turns)
    assert [x[:2] for x in parse(out)] == turns
    return out


def format_conversations(rows: DataFrame, segment: int = 1 << 20, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, segment, formatted, loss array<struct<begin, end>>) of rows (conv_id, turn, role, text)."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, segment long, formatted string, loss array<struct<begin: long, end: long>>"
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: list[tuple[str, str]] = []
        done: list[tuple] = []
        of, number, size, held = None, 0, 0, 0

        def close() -> None:
            text = render(turns)
            done.append((of[0], number, text, [{"begin": a, "end": b} for r, _, a, b in parse(text) if r == loss_role]))

        def flush() -> pa.RecordBatch:
            ids, numbers, texts, loss = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(numbers, pa.int64()), pa.array(texts, pa.string()), pa.array(loss, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))], names=["conv_id", "segment", "formatted", "loss"])

        for b in batches:
            id_type = b.schema.field(0).type
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if of is not None and (of != (conv,) or size > segment):
                    close()
                    held += size
                    number = number + 1 if of == (conv,) else 0
                    turns, size = [], 0
                    if held > 4 * segment:
                        yield flush()
                        done, held = [], 0
                of = (conv,)
                turns.append((role or "", text or ""))
                size += len(turns[-1][1])
        if turns:
            close()
        if done:
            yield flush()

    dealt = rows.select("conv_id", "turn", "role", "text").repartition(parallelism(rows.sparkSession), "conv_id").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, schema)


def read_conversations(formatted: DataFrame) -> DataFrame:
    """Read back from the segments: conv_id, n_turns, turns_sha256 (of role, line break, text, line break for each turn), loss_chars,
    loss_sha256 (of the unescaped text under the mask) and formatted_chars."""
    kind = formatted.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        of = None

        def close() -> None:
            done.append((of[0], n, turns.hexdigest(), chars, loss.hexdigest(), size))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, id_type if i == 0 else None) for i, c in enumerate(cols)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            id_type = b.schema.field(0).type
            for conv, _, text, mask in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of != (conv,):
                    if of is not None:
                        close()
                    of, n, chars, size, turns, loss = (conv,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, said, _, _ in parse(text):
                    n += 1
                    turns.update(f"{role}\n{said}\n".encode())
                for span in mask:
                    said = unescape(text[span["begin"] : span["end"]])
                    chars += len(said)
                    loss.update(said.encode())
                size += len(text)
            if len(done) > 10_000:
                yield flush()
                done = []
        if of is not None:
            close()
        if done:
            yield flush()

    dealt = formatted.select("conv_id", "segment", "formatted", "loss").repartition(parallelism(formatted.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "segment")
    return dealt.mapInArrow(run, schema)
