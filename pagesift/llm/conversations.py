"""Conversation repair by a survivor-coalescence Viterbi search.

A repaired conversation has roles `(system? (user assistant)+)?`, told by their first letters. Each row is kept (0), given
the role that fits (3) or deleted (4; blank and repeated rows must go); rows without text are inserted (3); a row whose
text ends without `.`, `!` or `?` costs 3 more unless it is deleted. Of the cheapest edits the ASCII-least string wins.

A search state is where in that pattern the repaired rows stand, so there are at most four survivors. Each survivor is a
leaf of a tree of back pointers; a node counts its references and goes when none is left. Once all survivors share an
ancestor, the edits up to it are final: they are emitted with their rows and forgotten, so only rows that are still
undecided are held. Of equally cheap ways into a state the lesser string of edits survives. Unresolved suffixes of two survivors
always differ within their length (both have used up the same rows, and each ends with a row's edit), so their order
decides every later comparison of the longer strings; it is kept as the survivors' rank. A survivor goes when another
is cheaper by more than what the other needs to do all the first could still do.

Rows are dealt by conv_id, put in order in Spark (by turn with nulls first, role, text) and pass a task as a stream, the
largest conversation too; a task holds a batch and the undecided rows.

Null roles and texts are one blank (so such a text is blank); null conv_ids are a conversation; repeated rows are
repeated turns, an empty role fits nowhere, and ties of turn are read in order of role and text; texts of any length pass whole; empty tables give
no rows. Only conv_id, turn, role and text are read, so extra columns can't clash.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagesift.llm.common import arrow

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a row of this first letter leads from each state.
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that fits into each state, where one of user and assistant does.
FITS = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
#: Inserted rows that end a conversation in each state.
CLOSING = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}
RENAME, DELETE, INSERT, CUT = 3, 4, 3, 3
#: What [x][y] costs at most, beyond what x's best end costs, to end from y instead.
DETOUR = {
    START: {SYSTEM: 6, USER: 7, ASSISTANT: 4}, SYSTEM: {START: 0, USER: 3, ASSISTANT: 0}, USER: {START: 3, SYSTEM: 3, ASSISTANT: 3},
    ASSISTANT: {START: 0, SYSTEM: 6, USER: 3}
}


class Node:
    """Edits (some inserts and one of the row, or closing inserts) after those of the parent; refs counts children and survivors."""

    __slots__ = ("edits", "kids", "parent", "refs", "row")

    def __init__(self, parent, edits: str, row):
        self.parent, self.edits, self.row, self.refs, self.kids = parent, edits, row, 0, []
        if parent is not None:
            parent.refs += 1
            parent.kids.append(self)


class Search:
    """One conversation: rows go in, edits come out as (edit, role, row) as soon as they are sure; row is None for an insert."""

    def __init__(self):
        self.root = Node(None, "", None)
        self.root.refs = 1
        self.at = START  # the state behind what was emitted
        self.alive = [(START, 0, self.root)]  # in ASCII order of their edits

    def held(self) -> int:
        """Nodes of the tree."""
        return sum(1 for _ in self._below(self.root))

    def _below(self, node):
        stack = [node]
        while stack:
            node = stack.pop()
            stack += node.kids
            yield node

    def _release(self, node) -> None:
        node.refs -= 1
        while not node.refs and node.parent is not None:
            parent = node.parent
            parent.kids.remove(node)
            parent.refs -= 1
            node = parent

    def add(self, initial: str, fault: str | None, row):
        best: dict[int, tuple] = {}
        for rank, (state, cost, _) in enumerate(self.alive):
            seen, inserts = set(), ""
            while state not in seen:
                seen.add(state)
                options = [("D", state, DELETE)]
                if fault not in ("blank", "duplicate"):
                    more = CUT if fault == "truncated" else 0
                    options.append(("R", STEP[state, FITS[state][0]], RENAME + more))
                    if (state, initial) in STEP:
                        options.append(("K", STEP[state, initial], more))
                for edit, to, price in options:
                    way = (cost + price, rank, inserts + edit)
                    if to not in best or way < best[to]:
                        best[to] = way
                state, cost, inserts = STEP[state, FITS[state][0]], cost + INSERT, inserts + "I"
        costs = {state: way[0] for state, way in best.items()}
        kept = [(way[1], way[2], state) for state, way in best.items() if not any(y != state and costs[state] > costs[y] + DETOUR[state][y] for y in costs)]
        before, self.alive = self.alive, []
        for rank, edits, state in sorted(kept):
            node = Node(before[rank][2], edits, row)
            node.refs += 1
            self.alive.append((state, costs[state], node))
        for _, _, node in before:
            self._release(node)
        return self._settled()

    def _settled(self):
        """What is sure by now: while the root leads to one node alone, that node's edits are."""
        out = []
        while len(self.root.kids) == 1 and self.root.refs == 1:
            child = self.root.kids[0]
            out += self._played(child.edits, child.row)
            child.parent, self.root = None, child
        return out

    def _played(self, edits: str, row):
        for edit in edits:
            role = row[1] if edit in "KD" else FITS[self.at]
            if edit != "D":
                self.at = STEP[self.at, role[:1]]
            yield edit, role, None if edit == "I" else row

    def end(self):
        ends = [(cost + INSERT * CLOSING[state], rank, "I" * CLOSING[state]) for rank, (state, cost, _) in enumerate(self.alive)]
        _, rank, edits = min(ends)
        path, node = [], self.alive[rank][2]
        while node is not self.root:
            path.append(node)
            node = node.parent
        out = [x for n in reversed(path) for x in self._played(n.edits, n.row)]
        return [*out, *self._played(edits, None)]


ROWS = "conv_id long, turn long, edit string, fault string, role string, text string, was string"


def _searched(batches, shape: pa.Schema):
    """Repaired rows of rows in order. A conversation without rows (copies is 0) gives one row without an edit."""
    key, search, out = (), None, []

    def told(edits):
        for edit, role, row in edits:
            turn, was, text, fault = row if row else (None, None, "", None)
            out.append((key[0], turn, edit, fault, role, text, was))

    def batch():
        columns = zip(*out, strict=True) if out else [()] * len(shape)
        made = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, shape.types, strict=True)], schema=shape)
        out.clear()
        return made

    def closed():
        if search:
            told(search.end())
        elif key:
            out.append((key[0], *[None] * 6))

    for table in batches:
        for conv, turn, role, text, fault, copies in zip(*(table.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "copies")), strict=True):
            if (conv,) != key:
                closed()
                key, search = (conv,), None
            if copies:
                search = search or Search()
                told(search.add(role[:1], fault, (turn, role, text, fault)))
        yield batch()
    closed()
    yield batch()


def _plain(rows: DataFrame) -> DataFrame:
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" ")).alias(name)
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), *(["copies"] if "copies" in rows.columns else []))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies, damaged by the check sum of `conv_id:turn` modulo 20.

    0 drops a row (copies is 0), 1 empties its text, 2 takes its end signs, 3 repeats it, 4 makes its role user.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")), F.lit(20))
    rows = _plain(conversations.select("conv_id", "turn", "role", "text")).withColumn("h", h)
    return rows.select(
        "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("h") == 0, 0).when(F.col("h") == 3, 2).otherwise(1).alias("copies")
    )


def repaired(conversations: DataFrame) -> DataFrame:
    """Edits of conversations(conv_id, turn, role, text) in order: turn, edit (K, R, D, I), fault, role (the repaired one; of
    deleted rows their own), text and the role that was there (null for inserts).

    copies, where it is there, is how often a row stands there; conversations of 0 alone give a row without an edit.
    Rows come conversation by conversation, each in one partition.
    """
    rows = _plain(conversations)
    rows = rows.withColumn("copies", F.coalesce("copies", F.lit(1)) if "copies" in rows.columns else F.lit(1)).repartition("conv_id")
    rows = rows.withColumn("copies", F.explode(F.when(F.col("copies") > 1, F.array_repeat(F.lit(1), F.col("copies"))).otherwise(F.array("copies"))))
    earlier = F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy(F.desc("copies"), F.asc_nulls_first("turn"))) > 1
    kept = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(kept == "", "blank").when(earlier, "duplicate").when(~F.right(kept, F.lit(1)).isin(".", "!", "?"), "truncated")
    rows = rows.withColumn("fault", F.when(F.col("copies") > 0, fault))
    again = F.coalesce(F.col("fault") == "duplicate", F.lit(False))
    rows = rows.sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", again)
    shape = arrow(ROWS, rows.sparkSession)
    return rows.mapInArrow(lambda batches: _searched(batches, shape), ROWS)


_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Tally:
    def __init__(self, conv):
        self.conv, self.turns, self.last, self.first, self.before = conv, 0, None, None, None
        self.faults, self.illegal, self.cost, self.audit, self.sha, self.any = dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0, [], hashlib.sha256(), False

    def add(self, turn, edit, fault, role, text, was):
        if edit is None:
            return
        if edit != "I":
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.turns, self.last = self.turns + 1, turn
            if self.before is not None and self.before + was[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = was[:1]
            if fault:
                self.faults[fault] += 1
        self.cost += {"K": 0, "R": RENAME, "D": DELETE, "I": INSERT}[edit] + CUT * (fault == "truncated" and edit != "D")
        self.audit.append(edit)
        if edit != "D":
            self.sha.update(f"{chr(10) if self.any else ''}{role}:{text}".encode())
            self.any = True

    def row(self):
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def summary(edits: DataFrame) -> DataFrame:
    """A row for each conversation of repaired(): gaps between turns, faults, illegal neighbours, cost, edits and the digest of
    the repaired `role:text` lines. It reads the edits as they come, in the task that makes them."""
    shape = arrow(_SUMMARY, edits.sparkSession)

    def run(batches):
        now = None
        for table in batches:
            done = []
            for conv, *rest in zip(*(table.column(c).to_pylist() for c in ("conv_id", "turn", "edit", "fault", "role", "text", "was")), strict=True):
                if now is None or now.conv != conv:
                    if now:
                        done.append(now.row())
                    now = _Tally(conv)
                now.add(*rest)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*done, strict=True), shape.types, strict=True)], schema=shape)
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now.row(), shape.types, strict=True)], schema=shape)

    return edits.mapInArrow(run, _SUMMARY)
