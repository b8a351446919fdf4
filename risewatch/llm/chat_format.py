"""Conversations as training texts with loss masks, by a compiled template, and the way back.

Turns are sorted by conversation and turn and rendered as a stream: a task holds one message, the one after it and the
part it is writing. A conversation longer than ``PART`` characters comes as several rows whose texts follow each other.
Texts are escaped so that the format's control strings mean turns only where the template wrote them: a backslash goes
before every backslash, every control string, and every ending of a text that could grow into one. No unescaped
control string can therefore begin inside a text, and dropping the backslashes gives the text back.

Nulls: a null role or text is empty, a null turn comes first, rows without a conversation id are one conversation.
Equal turns of a conversation are ordered by role, then text; repeated rows are further turns. An empty table gives no
rows. Columns other than the four named are ignored, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risewatch.llm.chat_template import compiled
from risewatch.llm.common import slices

#: Characters after which a formatted conversation goes on in another row.
PART = 1 << 20
#: The marks of the default format.
CONTROLS = ("[INST]", "[/INST]", "<s>", "</s>", "<<ROLE>>", "<<SYS>>", "<</SYS>>")
#: Users ask between [INST] marks, assistants answer between <s> marks, others speak in a <<SYS>> block that names them.
TEMPLATE = """
{%- for turn in messages -%}
{%- if turn.role == 'user' %}[INST] {{ turn.text | shield }} [/INST]
{%- elif turn.role == 'assistant' %}<s>{% generation %}{{ turn.text | shield }}{% endgeneration %}</s>
{%- else -%}
{%- if turn.role != 'system' %}<<ROLE>>{{ turn.role | shield }}{% endif %}<<SYS>>{{ turn.text | shield }}<</SYS>>
{%- endif -%}
{%- endfor -%}
"""


@dataclass(frozen=True)
class Shield:
    """Escapes and unescapes texts against a set of control strings."""

    controls: tuple[str, ...] = CONTROLS

    def __post_init__(self):
        if any(not c or "\\" in c for c in self.controls):
            raise ValueError("a control string is not empty and has no backslash")
        whole = "|".join(map(re.escape, self.controls))
        starts = sorted({c[:n] for c in self.controls for n in range(1, len(c))}, key=len)
        object.__setattr__(self, "risky", re.compile(r"(?=\\|" + whole + "|(?:" + "|".join(map(re.escape, starts)) + r")\Z)"))
        object.__setattr__(self, "marks", re.compile(r"\\.|" + "|".join(map(re.escape, sorted(self.controls, key=len, reverse=True))), re.DOTALL))

    def escape(self, text: str) -> str:
        return self.risky.sub(r"\\", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


def format_conversations(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: str = TEMPLATE, shield: Shield | None = None, part: int = PART
) -> DataFrame:
    """``conv``, ``part`` (from 0), ``formatted`` and ``loss`` (spans of ``formatted`` to learn), the parts of a conversation in order in one task."""
    shield = shield or Shield()
    render = lambda: compiled(template, {"shield": shield.escape})
    render()  # a wrong template fails here
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), word(role).alias("role"), word(text).alias("text"))
    ordered = turns.repartition("conv").sortWithinPartitions(F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), "role", "text").select("conv", "role", "text")
    kind, limit = ordered.schema["conv"].dataType.simpleString(), part

    def run(batches):
        write, arrow = render(), None

        def rows():
            nonlocal arrow
            for batch in batches:
                arrow = batch.schema.field(0).type
                for some, texts in slices(batch, "text"):
                    yield from zip(some.column(0).to_pylist(), some.column(1).to_pylist(), texts)

        def parts() -> Iterator[tuple]:
            for key, turns in groupby(rows(), itemgetter(0)):
                number, size, texts, spans = 0, 0, [], []
                for piece, learned in write({"role": r, "text": t} for _, r, t in turns):
                    if size >= limit:
                        yield key, number, "".join(texts), spans
                        number, size, texts, spans = number + 1, 0, [], []
                    if learned and piece:
                        spans.append({"start": size, "end": size + len(piece)})
                    texts.append(piece)
                    size += len(piece)
                yield key, number, "".join(texts), spans

        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

        def batch_of(held):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held), (arrow, pa.int32(), pa.string(), spans_type))], ["conv", "part", "formatted", "loss"])

        held, chars = [], 0
        for row in parts():
            held.append(row)
            chars += len(row[2])
            if chars >= limit:
                yield batch_of(held)
                held, chars = [], 0
        if held:
            yield batch_of(held)

    return ordered.mapInArrow(run, f"conv {kind}, part int, formatted string, loss array<struct<start: bigint, end: bigint>>")


class Conversation:
    """What the default format's text says, gathered part by part: digests of the turns and of the text under the mask."""

    def __init__(self, shield: Shield):
        self.shield, self.buffer, self.role, self.state, self.named = shield, "", None, None, ""
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        self.longest = max(map(len, shield.controls))

    def add(self, formatted: str, spans) -> None:
        self.chars += len(formatted)
        for span in spans:
            text = self.shield.unescape(formatted[span["start"] : span["end"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())
        self.buffer += formatted
        self.scan(len(self.buffer) - self.longest - 1)

    def scan(self, until: int) -> None:
        """Read marks that begin before ``until``; what follows may still grow."""
        at = 0
        while m := self.shield.marks.search(self.buffer, at):
            if m.start() >= until:
                break
            self.said(self.buffer[at : m.start()])
            if m[0][0] == "\\":
                self.said(m[0][1:])
            else:
                self.mark(m[0])
            at = m.end()
        upto = max(at, until)
        self.said(self.buffer[at:upto])
        self.buffer = self.buffer[upto:]

    def said(self, text: str) -> None:
        if self.state == "role":
            self.named += text
        elif self.state == "user":
            # One space follows the opening mark and one precedes the closing mark; the latter waits in `held`.
            text = self.held + text
            if self.fresh and text:
                text, self.fresh = text[1:], False
            self.held = text[-1:] if not self.fresh else ""
            self.turns.update(text[: len(text) - len(self.held)].encode())
        elif self.state == "text":
            self.turns.update(text.encode())

    def open(self, role: str, state: str) -> None:
        self.turns.update(f"{role}\n".encode())
        self.state, self.n_turns, self.held, self.fresh = state, self.n_turns + 1, "", True

    def mark(self, control: str) -> None:
        match control:
            case "[INST]":
                self.open("user", "user")
            case "<s>":
                self.open("assistant", "text")
            case "<<ROLE>>":
                self.state, self.named = "role", ""
            case "<<SYS>>":
                self.open(self.named if self.state == "role" else "system", "text")
            case _:
                self.turns.update(b"\n")
                self.state = None

    def result(self) -> tuple:
        self.scan(len(self.buffer))
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame, shield: Shield | None = None) -> DataFrame:
    """Turns and learned text of conversations in the default format, read from ``format_conversations`` and nothing else.

    Returns ``conv``, ``n_turns``, ``turns_sha256`` (role, newline, text, newline for each turn), ``loss_chars``,
    ``loss_sha256``, ``formatted_chars``. The parts of a conversation follow each other, as they were written.
    """
    shield = shield or Shield()
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        reading, now, out = None, None, []
        for batch in batches:
            types[0] = batch.schema.field(0).type
            for some, texts in slices(batch, "formatted"):
                for key, number, text, spans in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), texts, some.column(3).to_pylist()):
                    if number == 0:
                        if reading:
                            out.append((now, *reading.result()))
                        reading, now = Conversation(shield), key
                    reading.add(text, spans)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
                out = []
        if reading:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((now, *reading.result()), types)], names)

    kind = formatted.schema["conv"].dataType.simpleString()
    return formatted.mapInArrow(run, f"conv {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
