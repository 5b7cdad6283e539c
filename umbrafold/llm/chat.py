"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. Its output is not trusted to have any
form: the turns' spans are found by rendering successive prefixes and comparing consecutive outputs, and the part of a
span that is the turn's text by rendering the same turn with two probe texts. A template whose longer output
does not start with the shorter one rewrites history, which is reported; there the texts' spans are found again in the whole output, by probes of each turn in it.
What a turn costs beside the template is comparing outputs as memory; the default template keeps the turns it has rendered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

# The default template's control strings. In texts and roles a backslash goes before each of them and each backslash.
HEADER, END = "### ", "</turn>"
CONTROL = re.compile(r"\\|### |</turn>")
ESCAPED = re.compile(r"\\(\\|### |</turn>)")
TURN = re.compile(r"(?<!\\)(?:\\\\)*</turn>")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


class _Rendered(dict):
    """Rendered turns, dropped when they hold more than `room` characters."""

    room = 8_000_000

    def __init__(self):
        self.chars = 0

    def __missing__(self, turn: Turn) -> str:
        if self.chars > self.room:
            self.clear()
            self.chars = 0
        role, text = turn
        out = self[turn] = f"{HEADER}{escape(role)}{END}\n{escape(text)}{END}\n"
        self.chars += len(out) + len(text)
        return out


_rendered = _Rendered()


def marked_turns(turns: list[Turn]) -> str:
    """The default template: for each turn a header with its role, an end mark, its text and an end mark."""
    return "".join(map(_rendered.__getitem__, turns))


def read_turns(formatted: str) -> list[Turn]:
    """The turns of the default template's output."""
    parts, at = [], 0
    while at < len(formatted):
        m = TURN.search(formatted, at)
        if m is None:
            raise ValueError("not a formatted conversation")
        parts.append(formatted[at : m.end() - len(END)])
        at = m.end() + 1
    return [(unescape(head[len(HEADER) :]), unescape(text)) for head, text in zip(parts[::2], parts[1::2], strict=True)]


def _common(x: str, y: str, hint: int = 0) -> int:
    """Length of the common prefix, sought from `hint` on if the strings agree so far; halves are compared as memory."""
    low = hint if x[:hint] == y[:hint] else 0
    high, step = min(len(x), len(y)), 64
    low = min(low, high)
    while low < high:
        to = min(high, low + step)
        if x[low:to] == y[low:to]:
            low, step = to, step * 2
        elif to - low == 1:
            return low
        else:
            step = (to - low) // 2
            high = to
    return low


def _text_span(x: str, y: str, size: int, hint: int) -> tuple[int, int]:
    """Where the text stands in an output of `size`; x and y: the same with the probes a and b instead. Outputs without the text give an empty span."""
    if x == y:
        return 0, 0
    head = _common(x, y, hint)
    tail = _common(x[: head - len(x) - 1 : -1], y[: head - len(y) - 1 : -1])
    return head, max(head, size - tail)


def locate_turns(turns: list[Turn], template: Template) -> tuple[str, list[tuple[int, int, int, int]], bool]:
    """The whole rendering; for each turn its span and its text's span (start, end, text_start, text_end); whether the template rewrites history.

    A prefix's rendering counts as kept if the next one starts with it. Where a template rewrites history, a prefix's offsets say nothing about the whole
    output, so each turn is probed there once more and its span is that of its text; a turn that is not shown has an empty one.
    """
    before, spans, rewrites = template([]), [], False
    for k, (role, _) in enumerate(turns):
        now = template(turns[: k + 1])
        kept = len(before) if now.startswith(before) else _common(before, now)
        rewrites |= kept < len(before)
        x, y = template([*turns[:k], (role, "a")]), template([*turns[:k], (role, "b")])
        start, end = _text_span(x, y, len(now), kept)
        spans.append((min(kept, start), len(now), start, end))
        before = now
    if rewrites:
        spans = []
        for k, (role, _) in enumerate(turns):
            x, y = (template([*turns[:k], (role, probe), *turns[k + 1 :]]) for probe in "ab")
            start, end = _text_span(x, y, len(before), 0)
            spans.append((start, end, start, end))
    return before, spans, rewrites


def format_conversations(conversations: DataFrame, template: Template = marked_turns, trained: frozenset[str] = frozenset({"assistant"})) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...) to (conv_id, formatted, spans, rewrites).

    spans has for each turn (start, end, text_start, text_end, in_loss), in code points; in_loss is whether the role is
    one of `trained`, and the loss mask is the text spans of these turns. Turns stand by turn, then role, then text; a null turn comes first; null roles and texts are empty;
    repeated rows are turns of their own; each row with a null conv_id is a conversation of its own. Other columns are ignored. A conversation is one value of its
    result, so it has to fit into a task's memory, as any single text does.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = F.col("conv_id").cast("long").alias("conv_id")
    alone = conversations.where("conv_id IS NULL").select(conv, F.array(turn).alias("turns"))
    whole = conversations.where("conv_id IS NOT NULL").groupBy(conv).agg(F.sort_array(F.collect_list(turn)).alias("turns")).union(alone)  # a conversation's turns

    def run(batches):
        kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("in_loss", pa.bool_())])
        for batch in batches:
            formatted, spans, rewrites = [], [], []
            for turns in batch.column("turns").to_pylist():
                own = [(t["role"], t["text"]) for t in turns]
                text, found, changed = locate_turns(own, template)
                formatted.append(text)
                spans.append([{"start": a, "end": b, "text_start": c, "text_end": d, "in_loss": role in trained} for (a, b, c, d), (role, _) in zip(found, own, strict=True)])
                rewrites.append(changed)
            yield pa.record_batch([batch.column("conv_id"), pa.array(formatted, pa.string()), pa.array(spans, pa.list_(kind)), pa.array(rewrites, pa.bool_())], ["conv_id", "formatted", "spans", "rewrites"])

    return whole.mapInArrow(run, "conv_id long, formatted string, spans array<struct<start:long,end:long,text_start:long,text_end:long,in_loss:boolean>>, rewrites boolean")


def read_back(formatted: DataFrame) -> DataFrame:
    """The columns of op2, read from format_conversations()' output alone."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                turns = read_turns(text)
                loss = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in spans if s["in_loss"])
                told = "".join(f"{role}\n{said}\n" for role, said in turns)
                rows.append((len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.record_batch([batch.column("conv_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], batch.column("rewrites")], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")
