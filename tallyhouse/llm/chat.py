"""Chat formatting: a finite-state machine over roles checks the turn order, a declarative template gives the text.

A conversation becomes segments, in order, each with a loss flag; their texts, joined, are the formatted conversation.
Control strings inside a turn's text are escaped, so that the formatted text can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, projected


@dataclass(frozen=True)
class Template:
    """Strings around turns, roles with loss, and the order of roles as ``state -> role -> next state``.

    ``headers`` open the turns of known roles; other roles are opened by ``other`` with the escaped role and ``colon``.
    The machine starts in ``start``; a role without a transition breaks the order, as does an end outside ``final``.
    """

    headers: dict[str, str] = field(
        default_factory=lambda: {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
    )
    other: str = "### Role "
    colon: str = ": "
    close: str = " </turn>\n"
    escape: str = "\\"
    #: What is escaped inside texts, besides the escape itself.
    control: tuple[str, ...] = ("### ", "</turn>")
    loss_roles: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    order: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "asked", "user": "user"},
            "asked": {"user": "user"},
            "user": {"assistant": "assistant"},
            "assistant": {"user": "user"},
        }
    )
    final: frozenset[str] = frozenset({"assistant"})

    def __post_init__(self) -> None:
        stop = self.close.strip()
        if len(self.escape) != 1 or not any(c in self.close for c in self.control):
            raise ValueError("the escape is one character, and the turn's end holds a control string")
        if any(stop.startswith(stop[-n:]) for n in range(1, len(stop))):
            raise ValueError("no end of the closing string may be one of its beginnings")

    @cached_property
    def _inside(self) -> re.Pattern:
        return re.compile("(?=" + "|".join(map(re.escape, (self.escape, *self.control))) + ")")

    @cached_property
    def _in_role(self) -> re.Pattern:
        return re.compile("(?=" + "|".join(map(re.escape, (self.escape, self.colon, *self.control))) + ")")

    @cached_property
    def _escaped(self) -> re.Pattern:
        return re.compile(re.escape(self.escape) + "(.)", re.DOTALL)

    @cached_property
    def _end(self) -> re.Pattern:
        """The first unescaped end of a turn: any escaped characters and others before it."""
        e = re.escape(self.escape)
        return re.compile(f"(?:{e}.|(?!{re.escape(self.close)})[^{e}])*+", re.DOTALL)

    def escaped(self, text: str) -> str:
        return self._inside.sub(lambda _: self.escape, text)

    def unescaped(self, text: str) -> str:
        return self._escaped.sub(r"\1", text)

    def header(self, role: str) -> str:
        if role in self.headers:
            return self.headers[role]
        return self.other + self._in_role.sub(lambda _: self.escape, role) + self.colon

    def turns(self, formatted: str) -> Iterator[tuple[str, str]]:
        """``(role, escaped text)`` of a formatted conversation, or of some of its whole turns."""
        at = 0
        while at < len(formatted):
            for role, opening in self.headers.items():
                if formatted.startswith(opening, at):
                    at += len(opening)
                    break
            else:
                if not formatted.startswith(self.other, at):
                    raise ValueError("no turn starts here")
                at += len(self.other)
                stop = at
                while not formatted.startswith(self.colon, stop):
                    stop += 1 + formatted.startswith(self.escape, stop)
                role, at = self.unescaped(formatted[at:stop]), stop + len(self.colon)
            stop = self._end.match(formatted, at).end()
            if not formatted.startswith(self.close, stop):
                raise ValueError("a turn does not end")
            yield role, formatted[at:stop]
            at = stop + len(self.close)


DEFAULT = Template()


def segments(
    conversations: DataFrame,
    template: Template = DEFAULT,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """``conv_id, segment, role, text, loss, state, valid`` in order within each partition, whole conversations together.

    Each turn gives three segments: header, text, end. ``loss`` marks the texts of the template's roles. ``state`` is the
    machine's state after the turn, or null from the first turn on that breaks the order; ``valid``, on a conversation's
    last segment only, tells whether order and end are right. Null roles and texts are empty; an empty or unknown role is
    formatted, though it breaks the order. Turns are ordered by turn (null first), role and text; repeated rows are
    turns of their own. A null id is a conversation. Rows are streamed in sorted partitions: a conversation of any length
    needs the memory of one batch. Other columns are ignored; an empty table gives no rows.
    """
    kind = dict(conversations.dtypes)[id_column]
    given = projected(conversations, conv_id=id_column, turn=turn_column, role=role_column, text=text_column)
    ordered = (
        given.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )

    def rows(turns: Iterator[tuple]) -> Iterator[tuple]:
        before: list = []
        number, state, held = 0, template.start, None
        for conv_id, role, text in turns:
            if not before or before[0] != conv_id:
                if held:
                    yield (*held, state in template.final)
                before, number, state, held = [conv_id], 0, template.start, None
            if held:
                yield (*held, None)
            state = template.order.get(state, {}).get(role)
            yield conv_id, number, role, template.header(role), False, state, None
            yield conv_id, number + 1, role, template.escaped(text), role in template.loss_roles, state, None
            held = (conv_id, number + 2, role, template.close, False, state)
            number += 3
        if held:
            yield (*held, state in template.final)

    return map_rows(
        ordered, rows, f"conv_id {kind}, segment bigint, role string, text string, loss boolean, state string, valid boolean"
    )


def read_back(formatted: DataFrame, template: Template = DEFAULT) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid`` read from :func:`segments`.

    Roles and texts come from parsing the formatted text, turn by turn, and the loss from the flags. Rows are to be as
    ``segments`` gives them: in order, without a shuffle between. Digests are updated as the rows come.
    """
    kind = dict(formatted.dtypes)["conv_id"]

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        before: list = []
        for conv_id, text, loss, valid in given:
            if not before:
                before = [conv_id]
                n_turns, loss_chars, chars, pending = 0, 0, 0, ""
                turns, under_loss = hashlib.sha256(), hashlib.sha256()
            pending += text
            chars += len(text)
            if loss:
                plain = template.unescaped(text)
                loss_chars += len(plain)
                under_loss.update(plain.encode())
            if text == template.close and not loss:
                for role, body in template.turns(pending):
                    n_turns += 1
                    turns.update(f"{role}\n{template.unescaped(body)}\n".encode())
                pending = ""
            if valid is not None:
                yield conv_id, n_turns, turns.hexdigest(), loss_chars, under_loss.hexdigest(), chars, valid
                before = []

    return map_rows(
        formatted.select("conv_id", "text", "loss", "valid"),
        rows,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint, valid boolean",
    )
