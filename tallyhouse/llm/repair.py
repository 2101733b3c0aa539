"""Conversation repair: the cheapest edits that give a conversation the turn order ``(s?(ua)+)?``.

A dynamic program reads the rows of a conversation in order and keeps, for each state of the turn order, the cheapest
edits so far. Edit strings are linked nodes that share prefixes; each node knows its ancestors at distances 1, 2, 4, ...
and the rolling hash of its string. Of two equally cheap strings the smaller one is kept: they are compared behind their
longest common prefix, found by lifting both to the first ancestors that differ.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, projected

#: What is no text, and ends of a sentence.
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Rolling hash of edit strings.
BASE = 1_000_003
MODULUS = (1 << 61) - 1
#: Rows after which edits that all states share are given out.
STEP = 64
#: Costs of an edit; a truncated row that stays costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

START, SYSTEM, USER, ASSISTANT = range(4)
#: By state: initials that may be kept, and the state after them.
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: By state: the state after an inserted or re-roled turn, whose role the order fixes.
FORCED = (USER, USER, ASSISTANT, USER)
#: Initials of neighbouring turns in order.
LEGAL = {"su", "ua", "au"}
ROLES = {USER: "user", ASSISTANT: "assistant"}


class Node:
    """An edit string: its last letter, length, rolling hash, and the nodes 1, 2, 4, ... letters before."""

    __slots__ = ("letter", "length", "hash", "up", "state")

    def __init__(self, parent: Node | None, letter: str, state: int, length: int = 0) -> None:
        self.letter, self.state = letter, state
        if parent is None:
            self.length, self.hash, self.up = length, 0, ()
            return
        self.length = parent.length + 1
        self.hash = (parent.hash * BASE + ord(letter)) % MODULUS
        up = [parent]
        while len(up[-1].up) >= len(up):
            up.append(up[-1].up[len(up) - 1])
        self.up = tuple(up)

    def at(self, length: int) -> Node:
        """The ancestor of that length."""
        node = self
        while node.length > length:
            node = node.up[(node.length - length).bit_length() - 1]
        return node

    def letters(self, root: Node) -> Iterator[Node]:
        """Nodes from behind ``root`` to this one."""
        path, node = [], self
        while node is not root:
            path.append(node)
            node = node.up[0]
        return reversed(path)


def _equal(a: Node, b: Node) -> bool:
    """Letter by letter until both are one node."""
    while a is not b:
        if a.letter != b.letter:
            return False
        a, b = a.up[0], b.up[0]
    return True


def less(a: Node, b: Node) -> bool:
    """Whether ``a`` spells a string before ``b`` in ASCII order; both descend from one root.

    Equal hashes are taken as equal strings while lifting, then what was taken is verified letter by letter; after a
    collision the strings are compared as a whole.
    """
    short = min(a.length, b.length)
    x, y = a.at(short), b.at(short)
    if x.hash == y.hash:
        if _equal(x, y):
            return a.length < b.length
    else:
        for k in range(len(x.up) - 1, -1, -1):
            if k < len(x.up) and x.up[k].hash != y.up[k].hash:
                x, y = x.up[k], y.up[k]
        if _equal(x.up[0], y.up[0]):
            return x.letter < y.letter
    return _spelled(a) < _spelled(b)


def _spelled(node: Node) -> list[str]:
    path = []
    while node.up:
        path.append(node.letter)
        node = node.up[0]
    return path[::-1]


def _joint(nodes: list[Node]) -> Node:
    """The last node that all descend from or are."""
    short = min(n.length for n in nodes)
    nodes = [n.at(short) for n in nodes]
    first = nodes[0]
    for other in nodes[1:]:
        a, b = first.at(min(first.length, other.length)), other.at(min(first.length, other.length))
        if a is not b:
            for k in range(len(a.up) - 1, -1, -1):
                if k < len(a.up) and a.up[k] is not b.up[k]:
                    a, b = a.up[k], b.up[k]
            a = a.up[0]
        first = a
    return first


class Audit:
    """The program over one conversation: :meth:`row` for each row, then :meth:`end`; both give decided edits in order.

    An edit is (letter, state after it). Edits that all states share are given out and forgotten every ``STEP`` rows, and
    states that can no longer win are dropped, so that memory follows the undecided rows, not the conversation.
    """

    def __init__(self) -> None:
        self.root = Node(None, "", START)
        self.best: dict[int, tuple[int, Node]] = {START: (0, self.root)}
        self.rows = 0
        self._insert()

    @staticmethod
    def _offer(best: dict[int, tuple[int, Node]], state: int, cost: int, parent: Node, letter: str) -> bool:
        known = best.get(state)
        if known and known[0] < cost:
            return False
        node = Node(parent, letter, state)
        if known and known[0] == cost and not less(node, known[1]):
            return False
        best[state] = (cost, node)
        return True

    def _insert(self) -> None:
        """Two turns may be inserted at one place; more are never cheapest."""
        best = self.best
        for _ in range(2):
            for state, (cost, node) in sorted(best.items()):
                self._offer(best, FORCED[state], cost + INSERT, node, "I")

    def row(self, initial: str, fault: str | None) -> Iterator[tuple[str, int]]:
        best: dict[int, tuple[int, Node]] = {}
        more = TRUNCATED if fault == "truncated" else 0
        for state, (cost, node) in self.best.items():
            self._offer(best, state, cost + DELETE, node, "D")
            if fault in ("blank", "duplicate"):
                continue
            if initial in KEPT[state]:
                self._offer(best, KEPT[state][initial], cost + more, node, "K")
            self._offer(best, FORCED[state], cost + REROLE + more, node, "R")
        self.best = best
        self._insert()
        # From an assistant's turn on, all that may follow the system's turn may follow, and all that may follow the start
        # for at most the deletion of a system's turn.
        if ASSISTANT in best:
            for state, margin in ((START, DELETE), (SYSTEM, 0)):
                if state in best and best[state][0] > best[ASSISTANT][0] + margin:
                    del best[state]
        self.rows += 1
        if self.rows % STEP == 0:
            yield from self._decided()

    def _decided(self) -> Iterator[tuple[str, int]]:
        joint = _joint([node for _, node in self.best.values()])
        # One edit is always left to the end.
        if joint is self.root or joint.up[0] is self.root:
            return
        joint = joint.up[0]
        yield from self._given(joint)
        # The rest is built anew on the joint node, without what lies before it.
        self.root = Node(None, "", joint.state, joint.length)
        copies = {id(joint): self.root}
        for state, (cost, node) in self.best.items():
            parent = self.root
            for old in node.letters(joint):
                if id(old) not in copies:
                    copies[id(old)] = Node(parent, old.letter, old.state)
                parent = copies[id(old)]
            self.best[state] = (cost, parent)

    def _given(self, node: Node) -> Iterator[tuple[str, int]]:
        for n in node.letters(self.root):
            yield n.letter, n.state

    def end(self) -> tuple[int, Iterator[tuple[str, int]]]:
        """The cost, and the edits not given out before."""
        ends = [self.best[s] for s in (START, ASSISTANT) if s in self.best]
        cost, node = ends[0]
        for other_cost, other in ends[1:]:
            if other_cost < cost or (other_cost == cost and less(other, node)):
                cost, node = other_cost, other
        return cost, self._given(node)


def edits(
    conversations: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """``conv_id, edit, turn, given_role, role, text, fault, cost``: the edits of each conversation, in order.

    One row for each edit: ``K`` keeps a row, ``R`` gives it another role, ``D`` deletes it (role and text after the edit
    are null), ``I`` inserts an empty turn (turn, given_role and fault are null). ``fault`` is the row's first of blank,
    duplicate, truncated. ``cost``, on the last row of a conversation only, is that of all its edits. Rows are ordered by
    turn (null first), role and digest of the text. Null roles and texts are empty; a null id is a conversation; repeated
    rows are duplicates; other columns are ignored; an empty table gives no rows.

    Duplicates are marked by their digests first, in groups of equal role and text of a conversation. Then conversations
    are streamed in sorted partitions: a conversation of any length is one task's stream, with the memory of its undecided
    rows.
    """
    kinds = dict(conversations.dtypes)
    given = projected(conversations, conv_id=id_column, turn=turn_column, role=role_column, text=text_column).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    given = given.withColumn("digest", F.unhex(F.sha2("text", 256)))
    said = ["conv_id", "role", "digest"]
    # Repeated rows are folded in the tasks; only turns of texts said at several turns go on, as marks before the rows.
    turns = given.groupBy(*said, "turn").agg(F.lit(1).alias("one"))
    first = turns.groupBy(*said).agg(
        F.count(F.lit(1)).alias("turns"), F.min(F.struct("turn")).getField("turn").alias("first")
    )
    marks = (
        turns.join(
            first.where("turns > 1").withColumnsRenamed({c: f"_{c}" for c in said}),
            F.col("conv_id").eqNullSafe(F.col("_conv_id"))
            & (F.col("role") == F.col("_role"))
            & (F.col("digest") == F.col("_digest"))
            & ~F.col("turn").eqNullSafe(F.col("first")),
        ).select("conv_id", "turn", "role", "digest", F.lit(None).cast("string").alias("text"))
    )
    ordered = (
        given.select("conv_id", "turn", "role", "digest", "text")
        .unionByName(marks)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "digest", "text")
    )

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        before: list = []
        audit, waiting, said = Audit(), deque(), None

        def shown(decided) -> Iterator[tuple]:
            for letter, state in decided:
                if letter == "I":
                    yield before[0], "I", None, None, ROLES[state], "", None, None
                    continue
                turn, role, text, fault = waiting.popleft()
                if letter == "D":
                    yield before[0], "D", turn, role, None, None, fault, None
                else:
                    yield before[0], letter, turn, role, ROLES[state] if letter == "R" else role, text, fault, None

        def ended() -> Iterator[tuple]:
            cost, rest = audit.end()
            last = None
            for row in shown(rest):
                if last:
                    yield last
                last = row
            yield (*last[:-1], cost)

        for conv_id, turn, role, digest, text in given:
            if not before or before[0] != conv_id:
                if before:
                    yield from ended()
                before, audit, waiting, said = [conv_id], Audit(), deque(), None
            own = (turn, role, digest)
            if text is None:
                said = own
                continue
            full = text.rstrip(SPACE)
            if not full:
                fault = "blank"
            elif said == own:
                fault = "duplicate"
            else:
                fault = None if full[-1] in ENDS else "truncated"
            said = own
            waiting.append((turn, role, text, fault))
            yield from shown(audit.row(role[:1], fault))
        if before:
            yield from ended()

    kind, turn = kinds[id_column], kinds[turn_column]
    return map_rows(
        ordered,
        rows,
        f"conv_id {kind}, edit string, turn {turn}, given_role string, role string, text string, fault string, cost bigint",
    )


def summary(edited: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` read from :func:`edits`.

    ``gaps`` are the turns missing between the least and the greatest, ``illegal`` the neighbouring rows whose roles'
    initials are not su, ua or au, both before the repair. The digest is of the repaired ``role:text``, joined by newlines.
    Rows are to be as ``edits`` gives them: in order, without a shuffle between.
    """
    kind = dict(edited.dtypes)["conv_id"]

    def rows(given: Iterator[tuple]) -> Iterator[tuple]:
        first = True
        for conv_id, edit, turn, given_role, role, text, fault, cost in given:
            if first:
                faults = {"blank": 0, "duplicate": 0, "truncated": 0}
                low = high = last = None
                illegal, distinct, audit, sha, joined, first = 0, 0, [], hashlib.sha256(), False, False
            audit.append(edit)
            if edit != "I":
                if fault:
                    faults[fault] += 1
                if last is not None and last + given_role[:1] not in LEGAL:
                    illegal += 1
                last = given_role[:1]
                if turn is not None and turn != high:
                    low, high, distinct = turn if low is None else low, turn, distinct + 1
            if edit != "D":
                sha.update(f"{chr(10) if joined else ''}{role}:{text}".encode())
                joined = True
            if cost is not None:
                gaps = high - low + 1 - distinct if distinct else 0
                yield conv_id, gaps, *faults.values(), illegal, cost, "".join(audit), sha.hexdigest()
                first = True

    return map_rows(
        edited,
        rows,
        f"conv_id {kind}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, "
        "audit string, repaired_sha256 string",
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conv_id, turn, role, text`` with faults planted by the checksum of ``conv_id:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes the user say it. Null roles and
    texts become one space, and nulls are one space in the checksum.
    """
    space = F.lit(" ")
    conv_id, turn = (F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn"))
    key = F.concat(conv_id, F.lit(":"), turn)
    text = F.coalesce("text", space)
    fault = F.col("fault")
    return (
        conversations.select("conv_id", "turn", "role", "text", (F.crc32(key) % 20).alias("fault"))
        .where(fault != 0)
        .select(
            "conv_id",
            "turn",
            F.when(fault == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
            F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.explode(F.array_repeat(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )
