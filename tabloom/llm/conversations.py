"""Repair of the structure of conversations: Viterbi decoding that emits as survivors coalesce."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
BEGUN, SYSTEM, USER, ASSISTANT = range(4)  # how far a conversation has come: the initial read last
ROLE = {"u": "user", "a": "assistant"}
#: What reading an initial does: roles must spell ``(s?(ua)+)?``.
NEXT = {(BEGUN, "s"): SYSTEM, (BEGUN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (BEGUN, ASSISTANT)
FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _inserts(state: int) -> list[tuple[int, str]]:
    """States reached by inserted turns, with their initials. More than two are never
    cheapest: a user and an assistant turn after an assistant's lead nowhere new."""
    out, made = [(state, "")], ""
    for _ in range(2):
        initial = next(i for i in "ua" if (state, i) in NEXT)
        state, made = NEXT[(state, initial)], made + initial
        if state != out[0][0]:
            out.append((state, made))
    return out


def _moves() -> dict[tuple, list[tuple]]:
    """``(state, initial, must go, is truncated)``: the ways to deal with a row, each as
    ``(edits, state after, cost, inserted initials, role initial or none if deleted)``; the
    ASCII-least of equal cost to each state, since the others cannot win."""
    out = {}
    for state in range(4):
        for initial in "sua?":
            for gone in (False, True):
                for cut in (False, True):
                    best: dict[int, tuple] = {}
                    for here, made in _inserts(state):
                        ways = [("D", here, DELETE, None)]
                        if not gone:
                            extra = TRUNCATED if cut else 0
                            ways += [("K", NEXT[(here, initial)], KEEP + extra, initial)] if (here, initial) in NEXT else []
                            ways += [("R", NEXT[(here, x)], REROLE + extra, x) for x in "ua" if (here, x) in NEXT]
                        for edit, after, cost, role in ways:
                            way = ("I" * len(made) + edit, after, cost + INSERT * len(made), made, role if edit == "R" else "" if edit == "K" else None)
                            if after not in best or (way[2], way[0]) < (best[after][2], best[after][0]):
                                best[after] = way
                    out[(state, initial, gone, cut)] = list(best.values())
    return out


MOVES = _moves()
#: What a survivor in the first state pays at most to do as well as one in the second: it
#: inserts turns to get to where the other is, and deletes a system turn where it may not begin.
CATCH_UP = {
    (BEGUN, SYSTEM): 0, (BEGUN, USER): 3, (BEGUN, ASSISTANT): 0, (SYSTEM, BEGUN): 6, (SYSTEM, USER): 3, (SYSTEM, ASSISTANT): 6,
    (USER, BEGUN): 7, (USER, SYSTEM): 3, (USER, ASSISTANT): 3, (ASSISTANT, BEGUN): 4, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): 3,
}


class Edits:
    """A node of the backpointer tree: the edits since its parent. Its children, or the one
    survivor of a leaf, are what refers to it; without any it goes, and with a single child
    it becomes one with that child, so the tree has fewer inner nodes than survivors."""

    __slots__ = ("parent", "edits", "kids")

    def __init__(self, parent: Edits | None, edits: str = ""):
        self.parent, self.edits, self.kids = parent, [edits] if edits else [], []
        if parent is not None:
            parent.kids.append(self)


class Survivor:
    """The cheapest way to a state: its node, its cost and the hash of what it has repaired."""

    __slots__ = ("node", "cost", "hash", "empty")

    def __init__(self, node: Edits, cost: int, done, empty: bool):
        self.node, self.cost, self.hash, self.empty = node, cost, done, empty

    def append(self, role: str, text: bytes) -> None:
        if not self.empty:
            self.hash.update(b"\n")
        self.hash.update(role.encode() + b":")
        self.hash.update(text)
        self.empty = False


class Decoder:
    """Cheapest edits of one conversation, row by row.

    There is at most one survivor a state. Survivors are kept in the ASCII order of their
    whole unresolved edits: no such string begins another (each has one letter other than
    I for each row, and ends with it), so the order of two continuations is that of what
    they continue, and equal costs are told apart by complete suffixes without reading
    them again. Once all survivors descend from one child of the root, its edits are
    emitted. A survivor that another can catch up with for less than it costs more is
    dropped; without that the way of deleting everything would hold the tree for good.

    What is unresolved is a letter or so for each row and state, and no texts: each
    survivor carries the hash of its repaired rows along."""

    def __init__(self):
        self.root = Edits(None)
        self.alive: dict[int, Survivor] = {BEGUN: Survivor(self.root, 0, hashlib.sha256(), True)}  # in the order of their edits
        self.emitted: list[str] = []

    def row(self, role: str, text: bytes, gone: bool, truncated: bool) -> None:
        initial = role[:1]
        initial = initial if initial and initial in "sua" else "?"
        best: dict[int, tuple] = {}
        for rank, (state, s) in enumerate(self.alive.items()):
            for edits, after, cost, made, own in MOVES[(state, initial, gone, truncated)]:
                key = (s.cost + cost, rank, edits)
                if after not in best or key < best[after][0]:
                    best[after] = (key, s, made, own)
        least = {state: found[0][0] for state, found in best.items()}
        best = {state: found for state, found in best.items() if not any(t != state and least[state] > least[t] + CATCH_UP[(t, state)] for t in best)}
        refs: dict[int, int] = {}
        for _, s, _, _ in best.values():
            refs[id(s)] = refs.get(id(s), 0) + 1
        left, alive = dict(refs), {}
        for state, ((cost, _, edits), s, made, own) in sorted(best.items(), key=lambda x: x[1][0][1:]):
            left[id(s)] -= 1
            node = s.node
            if refs[id(s)] > 1:
                node = Edits(node, edits)
            else:
                node.edits.append(edits)
            alive[state] = new = Survivor(node, cost, s.hash.copy() if left[id(s)] else s.hash, s.empty)
            for x in made:
                new.append(ROLE[x], b"")
            if own is not None:
                new.append(ROLE[own] if own else role, text)
        for s in self.alive.values():
            if id(s) not in refs:
                self._drop(s.node)
        self.alive = alive
        if self.root.edits:
            self.emitted.append("".join(self.root.edits))
            self.root.edits = []

    def _drop(self, node: Edits) -> None:
        """Takes out a leaf that no survivor refers to; its parent, if left with one child,
        goes up in that child. What ends up in the root is common to all survivors."""
        up = node.parent
        up.kids.remove(node)
        if len(up.kids) == 1:
            (kid,) = up.kids
            up.edits += kid.edits
            kid.edits, kid.parent = up.edits, up.parent
            if up.parent is None:
                self.root = kid
            else:
                up.parent.kids[up.parent.kids.index(up)] = kid

    def finish(self) -> tuple[int, str, str]:
        """Cost, all edits, and the hash of the repaired conversation."""
        found = []
        for rank, (state, s) in enumerate(self.alive.items()):
            for here, made in _inserts(state):
                if here in ENDS:
                    found.append((s.cost + INSERT * len(made), rank, len(made), made, s))
        cost, _, _, made, s = min(found, key=lambda x: x[:3])
        path, node = [], s.node
        while node is not None:
            path.append("".join(node.edits))
            node = node.parent
        for x in made:
            s.append(ROLE[x], b"")
        return cost, "".join([*self.emitted, *reversed(path), "I" * len(made)]), s.hash.hexdigest()


class _Conversation:
    """Counts and decodes the rows of one conversation, in order."""

    def __init__(self):
        self.decoder = Decoder()
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.low = self.turn = self.last = self.before = None
        self.earlier: set[bytes] = set()

    def mark(self, turn, digest: bytes) -> None:
        """A row of this turn whose role and text an earlier turn has."""
        self._at(turn)
        self.earlier.add(digest)

    def _at(self, turn) -> None:
        if turn != self.turn:
            self.earlier = set()
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.turn = turn

    def row(self, turn, role: str, text: str, digest: bytes) -> None:
        self._at(turn)
        shown = text.rstrip(SPACES)
        blank, copy = not shown, digest in self.earlier or self.last == digest
        cut = not (blank or copy) and shown[-1] not in ".!?"
        self.blank += blank
        self.duplicate += copy and not blank
        self.truncated += cut
        if self.before is not None and self.before + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.before, self.last = role[:1], digest
        self.decoder.row(role, text.encode(), blank or copy, cut)

    def result(self) -> tuple:
        gaps = 0 if self.turn is None else self.turn - self.low + 1 - self.turns
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.decoder.finish())


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text, copies``: each row as a rule of its conversation and turn
    damages it; dropped rows have no copies, repeated ones two. Nulls become one space."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat(own(conv_col), F.lit(":"), own(turn_col)).cast("binary")), F.lit(20))
    out = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), own(role_col).alias("role"), own(text_col).alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1)
    return out.select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``conv, turn, role, text, copies`` (see ``damage``):
    ``conv``, counts of what is wrong, and the cheapest edits that make its roles spell
    ``(s?(ua)+)?``: their cost, their initials in order (``audit``, of equal cost the
    ASCII-least) and the hash of the repaired ``role:text`` lines.

    A row's first fault counts: ``blank`` (nothing but white space), ``duplicate`` (role and
    text met before), ``truncated`` (no ``.!?`` at the end). Blank and duplicate rows must
    go. Keeping costs 0, another role 3, deleting 4, an inserted empty turn 3, a truncated
    row that stays 3 more. An empty role, like any that begins with another letter, cannot be
    kept. ``gaps`` are turns missing between the least and the greatest.

    Rows come by turn (nulls first), then role, then text, so repeated rows stand together;
    a null conversation is one of its own; one without rows has zeros and the hash of
    nothing. An empty table gives an empty result.

    Texts are dealt once, by conversation, and sorted, which may spill; a task then streams
    its conversations, one after the other, however long they are (``Decoder``). What a row
    must know of far earlier ones, that it repeats them, comes in as marks, found by a join
    of digests that can split a common text. The result itself, a letter an edit and a hash
    that runs over all rows, wants each conversation read in order by one task.
    """
    work = Workspace(rows.sparkSession, "conversations")
    kind = rows.schema["conv"].dataType.simpleString()
    place = F.struct(F.col("turn").isNotNull(), F.col("turn").alias("turn"))  # nulls first
    narrow = work.table(rows.where("copies > 0").groupBy("conv", _digest().alias("digest"), "turn").agg(F.count(F.lit(1)).alias("n")).select("conv", "digest", "turn"), "digests")
    first = narrow.groupBy("conv", "digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = work.table(first.select(F.col("conv").alias("__conv"), F.col("digest").alias("__digest"), F.col("first.turn").alias("first")), "first")
    later = narrow.join(first, F.col("digest").eqNullSafe(F.col("__digest")) & F.col("conv").eqNullSafe(F.col("__conv")))
    marks = later.where(F.col("turn").isNotNull() & (F.col("first").isNull() | (F.col("turn") > F.col("first"))))
    none = F.lit(None).cast("string")
    marks = marks.select("conv", "turn", F.lit(0).alias("copies"), none.alias("role"), none.alias("text"), "digest")
    every = rows.select("conv", "turn", "copies", "role", "text", F.when(F.col("copies") > 0, _digest()).alias("digest"))
    every = every.withColumns({c: F.when(F.col("copies") > 0, F.col(c)) for c in ("turn", "role", "text")})
    dealt = every.unionByName(marks).repartition("conv").sortWithinPartitions("conv", "turn", F.col("role").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, here, done = False, None, None, []

        def out():
            cols = [[x[0] for x in done], *zip(*(x[1] for x in done))] if done else [[] for _ in range(9)]
            kinds = [kind_of, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv", *(f.split()[0] for f in FIELDS.split(", "))])

        kind_of = None
        for b in batches:
            kind_of = b.schema.field(0).type
            for at in range(0, b.num_rows, 512):
                for c, turn, copies, role, text, digest in zip(*(x.slice(at, 512).to_pylist() for x in b.columns)):
                    if not begun or c != conv:
                        if begun:
                            done.append((conv, here.result()))
                        begun, conv, here = True, c, _Conversation()
                    if copies:
                        for _ in range(copies):
                            here.row(turn, role, text, digest)
                    elif digest is not None:
                        here.mark(turn, digest)
                if len(done) >= 256 or sum(len(x[1][6]) for x in done) > 1 << 22:
                    yield out()
                    done.clear()
        if begun:
            done.append((conv, here.result()))
        if done:
            yield out()

    return dealt.mapInArrow(run, f"conv {kind}, {FIELDS}")


def damaged_and_repaired(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The audit of all conversations of a table, damaged by rule and repaired: see
    ``damage`` and ``repair``. Other columns are not read."""
    return repair(damage(rows, conv_col, turn_col, role_col, text_col)).withColumnRenamed("conv", conv_col)
