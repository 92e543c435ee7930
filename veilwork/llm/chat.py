"""Chat formatting with a grammar round trip.

Every turn is rendered by a template that marks its role. The rendered text is
parsed again by a deterministic parser; where a turn doesn't come back as it
was, its control strings are escaped, and it is rendered and parsed again.

Grammar: chat = { turn "\\n" };
turn = "[INST] " text " [/INST]" | "<s> " text " </s>" | "[SYS] " text " [/SYS]"
     | "[ROLE " quoted role "] " text " [/ROLE]"
for user, assistant, system and other roles. Inside a text, a control string
has backslashes after its first character, one more than in the source."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import ship

MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("[SYS] ", " [/SYS]")}
ROLE_OPEN, ROLE_CLOSE = "[ROLE ", " [/ROLE]"
#: Characters after which a turn's first mark is known.
LONGEST = 8
_CONTROL = r"(?=/?(?:INST|SYS)\]|/?ROLE|/?s>)"
ESCAPE = re.compile(r"([\[<])(\\*)" + _CONTROL)
UNESCAPE = re.compile(r"([\[<])\\(\\*)" + _CONTROL)


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2", text)


def render(role: str, text: str, escaped: bool) -> str:
    if role in MARKS:
        head, tail = MARKS[role]
    else:
        head, tail = f"{ROLE_OPEN}{quote(role, safe='')}] ", ROLE_CLOSE
    return f"{head}{escape(text) if escaped else text}{tail}\n"


class ParseError(ValueError):
    pass


def parse(formatted: str, at: int = 0, whole: bool = True) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound its text in
    `formatted`, where it is still escaped. If more text may follow (not
    `whole`), a turn that has no end yet is left for later."""
    while at < len(formatted):
        for role, (head, tail) in MARKS.items():
            if formatted.startswith(head, at):
                start = at + len(head)
                break
        else:
            stop = formatted.find("] ", at)
            if not whole and (stop < 0 or len(formatted) - at < LONGEST):
                return
            if not formatted.startswith(ROLE_OPEN, at) or stop < 0:
                raise ParseError(at)
            role, tail, start = unquote(formatted[at + len(ROLE_OPEN) : stop]), ROLE_CLOSE, stop + 2
        end = formatted.find(f"{tail}\n", start)
        if end < 0:
            if not whole:
                return
            raise ParseError(at)
        # a mark inside a text is always escaped; one that isn't ends the parse
        inside = formatted[start:end]
        if any(m.group(2) == "" for m in ESCAPE.finditer(inside)):
            raise ParseError(at)
        yield role, unescape(inside), start, end
        at = end + len(tail) + 1


def format_turn(role: str, text: str) -> str:
    """The turn as it is if it then parses to itself, else escaped."""
    for escaped in (False, True):
        out = render(role, text, escaped)
        try:
            if [(r, t) for r, t, _, _ in parse(out)] == [(role, text)]:
                return out
        except ParseError:
            pass
    raise ParseError(f"{role!r} turn has no form that can be read back")


class _Reader:
    """Reads one conversation's formatted text back, as a stream that may be
    cut anywhere: where turns begin and end is for the parser to find."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.waiting, self.held, self.tried = [], 0, 0

    def feed(self, formatted: str) -> list[tuple[int, int]]:
        """The spans under the loss mask, in the whole conversation's text."""
        self.waiting.append(formatted)
        self.held += len(formatted)
        # a long turn isn't looked through again for every piece
        if self.held < 2 * self.tried:
            return []
        return self._read(False)

    def close(self) -> list[tuple[int, int]]:
        return self._read(True)

    def _read(self, whole: bool) -> list[tuple[int, int]]:
        spans, done = [], 0
        formatted = "".join(self.waiting)
        for role, text, start, end in parse(formatted, 0, whole):
            self.n_turns += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == "assistant":
                self.loss.update(text.encode("utf-8", "surrogatepass"))
                self.loss_chars += len(text)
                spans.append((self.formatted_chars + start, self.formatted_chars + end))
            done = end + len(MARKS[role][1] if role in MARKS else ROLE_CLOSE) + 1
        self.formatted_chars += done
        self.waiting, self.held = [formatted[done:]], len(formatted) - done
        self.tried = self.held
        return spans


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per row: conv, turn, formatted (the turn's part of the
    conversation's text). Null roles and texts count as empty. Turns are
    rendered where they are, before any shuffle."""
    ship(df.sparkSession)
    src = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [format_turn(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.string())], names=["conv", "turn", "formatted"])

    kinds = dict(src.dtypes)
    return src.mapInArrow(run, f"conv {kinds['conv']}, turn {kinds['turn']}, formatted string")


def read_back(turns: DataFrame) -> DataFrame:
    """One row per conversation of format_turns(), read back from the
    formatted text alone: conv, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars, loss_spans (bounds of the assistant's texts
    in the conversation's formatted text, code points).

    Turns come by number, null first; equal numbers by their formatted text;
    repeated rows are turns of their own. A null conversation is one of its
    own. Each task reads its conversations in order, as one text each, and
    keeps two running digests, the spans and the turn that is open, so a
    conversation with a third of all turns needs no more memory than its spans
    and its longest turn do."""
    ship(turns.sparkSession)
    kind = dict(turns.dtypes)["conv"]
    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, loss_spans array<struct<start:long,end:long>>"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader, spans, done = None, None, [], []
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def row():
            return now, reader.n_turns, reader.turns.hexdigest(), reader.loss_chars, reader.loss.hexdigest(), reader.formatted_chars, [{"start": a, "end": b} for a, b in spans]

        def out(key_type):
            cols = list(zip(*done))
            types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), spans_type]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

        key_type = None
        for b in batches:
            key_type = b.schema.field(0).type
            rows = zip(b.column(0).to_pylist(), b.column(2).to_pylist())
            for key, own in groupby(rows, key=lambda r: r[0]):
                if reader is None or key != now:
                    if reader:
                        spans += reader.close()
                        done.append(row())
                    now, reader, spans = key, _Reader(), []
                # the rows' borders go: what follows is one text
                spans += reader.feed("".join(text for _, text in own))
            if done:
                yield out(key_type)
                done = []
        if reader:
            spans += reader.close()
            done.append(row())
            yield out(key_type)

    return turns.repartition("conv").sortWithinPartitions("conv", "turn", "formatted").mapInArrow(run, schema)
