"""Chat formatting with a grammar round trip.

    conversation = { turn }
    turn         = opener body closer            of one of ROLES, or
                   "<|turn " body "|>" body "<|end|>"   for any other role
    body         = { character | "\\" character }      up to the first closer outside an escape

Each turn is rendered, parsed again and compared to its source; content that conflicts is escaped until
both are identical. A turn ends at its own closer whatever follows, so a conversation can be rendered and
read turn by turn.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>")}
TURN, NAMED, END = "<|turn ", "|>", "<|end|>"
#: Strings that steer the model or the parser; none of them stays whole inside a text.
CONTROL = re.compile(r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|turn |\|>|<\|end\|>")
LEARNED = "assistant"


def escape(text: str) -> str:
    """A backslash before each backslash and after the first character of each control string."""
    text = text.replace("\\", "\\\\")
    while True:  # what follows the first character may hold another one
        new = CONTROL.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text)
        if new == text:
            return text
        text = new


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def body(text: str, at: int, closer: str) -> tuple[str, int]:
    """The raw body from ``at`` and the place after ``closer``."""
    k = at
    while True:
        end = text.find(closer, k)
        if end < 0:
            raise ValueError("a turn has no end")
        back = text.find("\\", k, end)
        if back < 0:
            return text[at:end], end + len(closer)
        k = back + 2


def parse(text: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """Role, text, bounds of the raw text and place after the turn that begins at ``at``."""
    if text.startswith(TURN, at):
        role, k = body(text, at + len(TURN), NAMED)
        raw, end = body(text, k, END)
        return unescape(role), unescape(raw), k, k + len(raw), end
    for role, (opener, closer) in ROLES.items():
        if text.startswith(opener, at):
            k = at + len(opener)
            raw, end = body(text, k, closer)
            return role, unescape(raw), k, k + len(raw), end
    raise ValueError("no turn begins here")


def parse_conversation(text: str) -> list[tuple[str, str]]:
    turns, at = [], 0
    while at < len(text):
        role, said, _, _, at = parse(text, at)
        turns.append((role, said))
    return turns


def render(role: str, text: str) -> str:
    """The turn as it is if it reads back identically and holds no control string, else escaped."""
    for change in (lambda x: x, escape):
        name, said = change(role), change(text)
        opener, closer = ROLES.get(role, (TURN + name + NAMED, END))
        out = opener + said + closer
        if CONTROL.search(said) or (role not in ROLES and CONTROL.search(name)):
            continue
        try:
            got = parse(out)
        except ValueError:
            continue
        if got[:2] == (role, text) and got[4] == len(out):
            return out
    raise AssertionError("an escaped turn reads back identically")


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, piece, loss_start, loss_length``: each row rendered for itself.

    The loss mask covers ``loss_length`` code points of ``piece`` from ``loss_start``; none but for assistants.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pieces, starts, lengths = [], [], []
            for role, text in zip(b["role"].to_pylist(), b["text"].to_pylist(), strict=True):
                pieces.append(render(role, text))
                _, _, start, end, _ = parse(pieces[-1])
                starts.append(start if role == LEARNED else 0)
                lengths.append(end - start if role == LEARNED else 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pieces, pa.string()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64())],
                                             names=[*b.schema.names, "piece", "loss_start", "loss_length"])

    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, piece string, loss_start long, loss_length long")


def read_back(pieces: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of conversations read from their pieces.

    A conversation's digest is a chain over its turns, so its pieces pass one task in order; that task
    holds a batch of them and the state of two digests, however long the conversation is.
    """
    class Reader:
        def __init__(self, conv: int | None):
            self.conv, self.n, self.loss, self.size = conv, 0, 0, 0
            self.turns, self.learned = hashlib.sha256(), hashlib.sha256()

        def add(self, piece: str, start: int, length: int) -> None:
            role, text, _, _, end = parse(piece)
            if end != len(piece):
                raise ValueError("a piece is more than one turn")
            self.turns.update(f"{role}\n{text}\n".encode())
            masked = unescape(piece[start:start + length])
            self.learned.update(masked.encode())
            self.n, self.loss, self.size = self.n + 1, self.loss + len(masked), self.size + len(piece)

        def row(self) -> tuple:
            return self.conv, self.n, self.turns.hexdigest(), self.loss, self.learned.hexdigest(), self.size

    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            done = []
            for conv, piece, start, length in zip(*(b[c].to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_length")), strict=True):
                if now is None or now.conv != conv:
                    done += [now.row()] if now else []
                    now = Reader(conv)
                now.add(piece, start, length)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(now.row(), schema, strict=True)], schema=schema)

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "piece", "loss_start", "loss_length")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted(conversations: DataFrame) -> DataFrame:
    """Formats every conversation and reads it back.

    Turns go by ``turn`` (null first); rows of one turn by role, then text, so repeated rows stand side by
    side and all count. Null texts and roles are empty; any role may occur. A null ``conv_id`` is a
    conversation of its own. Extra columns are ignored; an empty table gives an empty result.
    """
    return read_back(turns(conversations))
