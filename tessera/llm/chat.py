"""Chat formatting in budgeted windows.

The turns of a conversation are written with a template of control strings; control strings inside texts
are escaped, so the output can be read back exactly.  Prefix sums of turn tokens choose turn-aligned
windows within a token budget: each window opens with the system turn, repeats a limited run of the latest
turns as history, and goes on with as many new turns as fit.  The loss mask covers each assistant text
once, where it is new; repeats are masked out.

Turn tokens are counted where the rows lie.  Rows are then dealt by conversation and sorted by turn, and pass
through a task as a stream: what a task holds is one window and its history, however long the conversation, and
the costly part, the tokenizer, does not wait for a hot conversation's task.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import arrow_schema
from .text import slices

#: tokens per window, and tokens of repeated history in it
BUDGET = 2048
HISTORY = 512

OPEN, BODY, CLOSE = "<s>[", "] ", "</s>"
ESCAPE = "\\"


def escape(text: str) -> str:
    """Reversible: no control string is left.  Every one of them holds '<s>', '</s>', '[' or ']'."""
    return (text.replace(ESCAPE, ESCAPE + "e").replace("<", ESCAPE + "l").replace("[", ESCAPE + "o").replace("]", ESCAPE + "c"))


def unescape(text: str) -> str:
    if ESCAPE not in text:
        return text
    first, *rest = text.split(ESCAPE)
    return first + "".join({"e": ESCAPE, "l": "<", "o": "[", "c": "]"}[part[0]] + part[1:] for part in rest)


def format_turn(role: str | None, text: str | None) -> tuple[str, int]:
    """(formatted turn, where its text starts)."""
    head = OPEN + ("" if role is None else escape(role)) + BODY
    return head + escape(text or "") + CLOSE, len(head)


def parse_window(formatted: str) -> list[tuple[str, str, int]]:
    """(role, text, start of the escaped text) of the turns of a window."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(OPEN, at):
            raise ValueError("a window is a sequence of turns")
        body = formatted.index(BODY, at)
        end = formatted.index(CLOSE, body)
        turns.append((unescape(formatted[at + len(OPEN):body]), unescape(formatted[body + len(BODY):end]), body + len(BODY)))
        at = end + len(CLOSE)
    return turns


class Windows:
    """Cuts a stream of turns into windows; holds the open window only."""

    def __init__(self, budget: int, history: int, emit: Callable[[dict], None]):
        self.budget, self.history, self.emit = budget, history, emit
        self.system: tuple | None = None
        self.turns: list[tuple] = []  # (formatted, text start, text end, is target, tokens)
        self.old = self.used = 0  # turns repeated, tokens so far
        self.seen = 0

    def add(self, role: str | None, text: str | None, tokens: int) -> None:
        formatted, start = format_turn(role, text)
        turn = (formatted, start, len(formatted) - len(CLOSE), role == "assistant", tokens)
        if len(self.turns) > self.old and self.used + tokens > self.budget:
            self._close(tokens)
        self.turns.append(turn)
        self.used += tokens
        if role == "system" and self.system is None and not self.seen:
            self.system = turn
        self.seen += 1

    def _close(self, room: int) -> None:
        """Emit the open window and start the next: system turn, then the latest turns within the history budget."""
        self.flush()
        keep, size, left = [], 0, self.budget - room - (self.system[4] if self.system else 0)
        for turn in reversed(self.turns):
            size += turn[4]
            if turn is self.system or size > min(self.history, left):
                break
            keep.append(turn)
        self.turns = ([self.system] if self.system else []) + keep[::-1]
        self.old, self.used = len(self.turns), sum(t[4] for t in self.turns)

    def flush(self) -> None:
        if len(self.turns) == self.old:
            return
        at, spans = 0, []
        for k, (formatted, start, end, target, _) in enumerate(self.turns):
            if target and k >= self.old:
                spans.append({"start": at + start, "end": at + end})
            at += len(formatted)
        self.emit({"formatted": "".join(t[0] for t in self.turns), "repeated": self.old,
                   "turns": len(self.turns), "loss_spans": spans})


def token_counter(path: str | None) -> Callable[[list[str]], list[int]]:
    """Token counts of texts; without a vocabulary file, four bytes count as a token."""
    if path is None:
        return lambda texts: [len(t.encode()) // 4 + 1 for t in texts]
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


_WINDOW = "window bigint, formatted string, repeated bigint, turns bigint, loss_spans array<struct<start:bigint,end:bigint>>"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def with_tokens(turns: DataFrame, path: str | None) -> DataFrame:
    """(conv_id, turn, role, text) with ``tokens``, the tokens of the formatted turn."""
    order = ["conv_id", "turn", "role", "text"]
    kinds = ", ".join(f"{c} {turns.schema[c].dataType.simpleString()}" for c in order)
    schema = f"{kinds}, tokens int"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(path)
        for part in slices(batches, 256):
            role, text = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("role", "text"))
            tokens = count([format_turn(r, t)[0] for r, t in zip(role, text)])
            columns = [part.column(part.schema.get_field_index(c)).cast(out.field(c).type) for c in order]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tokens, pa.int32())], schema=out)

    return turns.select(*order).mapInArrow(run, schema)


def format_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str | None = None) -> DataFrame:
    """(conv_id, window, formatted, repeated, turns, loss_spans) of the rows (conv_id, turn, role, text).

    Windows are numbered from 0 in turn order; ``repeated`` turns at the front were in an earlier window.
    A turn longer than the budget has a window of its own, uncut.  Null text and role are empty, null
    conv_ids are one conversation, equal turn numbers go by role and text, null turns come first.  A very long
    text is one turn.  Other columns are not read; an empty table gives no windows."""
    path = vocabulary or default_vocabulary()
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, {_WINDOW}"
    out = arrow_schema(schema)
    order = ["conv_id", "turn", "role", "text"]
    dealt = with_tokens(turns, path).repartition("conv_id").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, cutter, rows = object(), None, []
        number = 0

        def emit(window: dict) -> None:
            nonlocal number
            rows.append({"conv_id": current, "window": number, **window})
            number += 1

        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                conv, role, text, tokens = (part.column(part.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "role", "text", "tokens"))
                for c, r, t, n in zip(conv, role, text, tokens):
                    if cutter is None or c != current:
                        if cutter is not None:
                            cutter.flush()
                        current, cutter, number = c, Windows(budget, history, emit), 0
                    cutter.add(r, t, n)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)
                    rows.clear()
        if cutter is not None:
            cutter.flush()
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=out)

    return dealt.mapInArrow(run, schema)


def read_back(windows: DataFrame, in_order: bool = False) -> DataFrame:
    """Per conversation, from formatted windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A stream again: windows in order, each turn counted where it is new, digests carried along.  ``in_order``
    windows (as :func:`format_windows` leaves them) are not dealt and sorted once more."""
    kind = windows.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint")
    out = arrow_schema(schema)
    dealt = windows.select("conv_id", "window", "formatted", "repeated", "loss_spans")
    if not in_order:
        dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows = None, []

        def close() -> None:
            conv, n, turns, chars, loss, total = state
            rows.append({"conv_id": conv, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars,
                         "loss_sha256": loss.hexdigest(), "formatted_chars": total})

        for batch in batches:
            for x in batch.to_pylist():
                if state is None or state[0] != x["conv_id"]:
                    if state is not None:
                        close()
                    state = [x["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = x["formatted"]
                for role, body, _ in parse_window(text)[x["repeated"]:]:
                    state[1] += 1
                    state[2].update(f"{role}\n{body}\n".encode())
                for span in x["loss_spans"]:
                    target = unescape(text[span["start"]:span["end"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=out)
                rows = []
        if state is not None:
            close()
            yield pa.RecordBatch.from_pylist(rows, schema=out)

    return dealt.mapInArrow(run, schema)


def digest(turns: DataFrame) -> DataFrame:
    """All conversations and conversation -1, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    extra = turns.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                               "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_windows(turns.select("conv_id", "turn", "role", "text").unionByName(extra)), in_order=True)
