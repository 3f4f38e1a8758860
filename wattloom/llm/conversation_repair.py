"""Repair of conversations: the cheapest edits that give a legal order of roles, and which they are.

A conversation's rows, in the order of turn (nulls first; then role and text), are repaired by Keep (K, cost 0),
Rerole to user or assistant (R, 2), Delete (D, 3) and Insert of an empty user or assistant message (I, 2), so
that the initials of the roles read (s?(ua)+)?: perhaps a system message, then user and assistant in turn. Blank rows and
rows whose role and text came earlier must be deleted; rows that end without one of .!? cost 1 more if they
stay. Of all cheapest edits the audit is the one that comes first in ASCII order.

1. Equal rows are counted before the shuffle; the earliest turn of each role and text tells what came earlier.
2. Rows are dealt into ranges of (conv_id, turn, ...), so a long conversation lies in several tasks, and each
   task cuts its rows into segments of a bounded number. For a segment, a dynamic program over the four states of the
   legal order gives the cheapest edits from each state at its start to each at its end. Edits are nodes linked to
   the one before (Trail), so states share what they have in common. Costs that tie are decided by the longest common prefix of
   the two lists of edits: found by binary lifting over ancestors and rolling hashes, verified node by node.
3. A task gets the segments of whole conversations, first the edits of all (a few bytes per row), then the messages, in order. The first are joined
   by the same program, a node being a segment's list of edits; the messages are repaired as they come by and are not held.

Given the audit, the repaired messages follow: the first kept or made message is a system one if so kept, else user, then they take turns.

Nulls: null role and text count as one space, a null turn comes first, a null conv_id is a conversation of its own. Rows that are the same in
all four columns are repeats of each other. A role with another initial (or none) cannot be kept. A conversation without rows has an empty audit.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, write_table

SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1
#: States: nothing yet, after a system message, after user, after assistant; and where an initial leads.
STATES, LEGAL_ENDS = range(4), (0, 3)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The state and role that Rerole and Insert lead to.
MADE = [(2, "user"), (2, "user"), (3, "assistant"), (2, "user")]
#: Rows and characters of a segment.
ROWS, CHARS = 2048, 1 << 18


class Trail:
    """Lists of labels that share their beginnings: a node holds its parent, its label, and of the way to it the length, a rolling hash and the ancestors 1, 2, 4, ... nodes above."""

    def __init__(self, prime: int = (1 << 61) - 1, base: int = 1_000_003):
        self.prime, self.base = prime, base
        self.up, self.label, self.depth, self.size, self.hash = [[]], [""], [0], [0], [0]

    def add(self, parent: int, label: str) -> int:
        up, k = [parent], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        known = self.hash[parent]
        for c in label:
            known = (known * self.base + ord(c)) % self.prime
        self.up.append(up)
        self.label.append(label)
        self.depth.append(self.depth[parent] + 1)
        self.size.append(self.size[parent] + len(label))
        self.hash.append(known)
        return len(self.up) - 1

    def lift(self, node: int, depth: int) -> int:
        while (above := self.depth[node] - depth) > 0:
            node = self.up[node][above.bit_length() - 1]
        return node

    def same(self, u: int, v: int) -> bool:
        return u == v or self.hash[u] == self.hash[v] and self.size[u] == self.size[v]

    def common(self, u: int, v: int) -> tuple[int, int]:
        """The deepest ancestors (or selves) of equal depth that seem to be the same."""
        least = min(self.depth[u], self.depth[v])
        u, v = self.lift(u, least), self.lift(v, least)
        if self.same(u, v):
            return u, v
        for k in reversed(range(len(self.up[u]))):
            if k < len(self.up[u]) and not self.same(self.up[u][k], self.up[v][k]):
                u, v = self.up[u][k], self.up[v][k]
        return self.up[u][0], self.up[v][0]

    def verified(self, u: int, v: int) -> bool:
        """Whether the ways to two nodes have the same labels, compared up to the node that they share."""
        while u != v:
            if self.label[u] != self.label[v]:
                return False
            u, v = self.up[u][0], self.up[v][0]
        return True

    def text(self, node: int, below: int = 0) -> str:
        """The labels on the way to a node, those at depths up to `below` left out."""
        parts = []
        while self.depth[node] > below:
            parts.append(self.label[node])
            node = self.up[node][0]
        return "".join(reversed(parts))

    def less(self, u: int, v: int) -> bool:
        """Whether the text of u comes before that of v."""
        x, y = self.common(u, v)
        if not self.verified(x, y):
            return self.text(u) < self.text(v)
        depth = self.depth[x]
        if x == u or y == v:
            return self.size[u] < self.size[v]
        a, b = self.label[self.lift(u, depth + 1)], self.label[self.lift(v, depth + 1)]
        n = min(len(a), len(b))
        if a[:n] != b[:n]:
            return a[:n] < b[:n]
        return self.text(u, depth) < self.text(v, depth)


class Heads:
    """For each state the cheapest way to it: (cost, node)."""

    def __init__(self, trail: Trail, start: dict[int, tuple[int, int]]):
        self.trail, self.at = trail, start

    def _offer(self, at: dict, state: int, cost: int, node: int, label: str) -> None:
        held = at.get(state)
        if held and held[0] < cost:
            return
        new = self.trail.add(node, label) if label else node
        if not held or cost < held[0] or self.trail.less(new, held[1]):
            at[state] = (cost, new)

    def inserted(self) -> None:
        """A message may be inserted here, or two."""
        for froms, to in (((0, 1, 3), 2), ((2,), 3)):
            for state in froms:
                if state in self.at:
                    cost, node = self.at[state]
                    self._offer(self.at, to, cost + INSERT_COST, node, INSERT)

    def row(self, initial: str, forced: bool, truncated: bool) -> None:
        out: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in self.at.items():
            self._offer(out, state, cost + DELETE_COST, node, DELETE)
            if not forced:
                stays = cost + TRUNCATED_COST * truncated
                if (state, initial) in NEXT:
                    self._offer(out, NEXT[state, initial], stays + KEEP_COST, node, KEEP)
                self._offer(out, MADE[state][0], stays + REROLE_COST, node, REROLE)
        self.at = out
        self.inserted()

    def segment(self, edits: list[tuple[int, int, int, str]]) -> None:
        """Rows whose cheapest edits between states are known: (from, to, cost, edits)."""
        out: dict[int, tuple[int, int]] = {}
        for start, end, cost, label in edits:
            if start in self.at:
                self._offer(out, end, self.at[start][0] + cost, self.at[start][1], label)
        self.at = out

    def best(self) -> tuple[int, str]:
        ends = [self.at[s] for s in LEGAL_ENDS if s in self.at]
        best = ends[0]
        for cost, node in ends[1:]:
            if cost < best[0] or cost == best[0] and self.trail.less(node, best[1]):
                best = cost, node
        return best[0], self.trail.text(best[1])


def cheapest(rows: list[tuple[str, bool, bool]], starts: tuple[int, ...], prime: int = (1 << 61) - 1) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, edits) for rows of (initial, forced to go, truncated)."""
    out = []
    for start in starts:
        heads = Heads(Trail(prime), {start: (0, 0)})
        heads.inserted()
        for row in rows:
            heads.row(*row)
        out += [(start, end, cost, heads.trail.text(node)) for end, (cost, node) in sorted(heads.at.items())]
    return out


class Repair:
    """Messages as they are repaired, given all edits of their conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.row, self.state = audit, 0, 0, 0

    def _insert(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == INSERT:
            self.at += 1
            self.state, role = MADE[self.state]
            yield role, ""

    def message(self, row: int, role: str, text: str) -> Iterator[tuple[str, str]]:
        """What stands from the last message up to this one, the row-th; rows between were deleted."""
        yield from self._insert()
        while self.row < row:
            self.at, self.row = self.at + 1, self.row + 1
            yield from self._insert()
        edit = self.audit[self.at]
        self.at, self.row = self.at + 1, self.row + 1
        if edit == KEEP:
            self.state = NEXT[self.state, role[:1]]
            yield role, text
        elif edit == REROLE:
            self.state, role = MADE[self.state]
            yield role, text

    def rest(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit):
            yield from self._insert()
            self.at += 1


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of conversations with faults by crc32 of conv_id:turn modulo 20: 0 a row goes, 1 its text is emptied, 2 it loses its .!?, 3 it comes twice, 4 its role is user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fault.alias("_fault")).where("_fault <> 0")
    role = F.when(F.col("_fault") == 4, "user").otherwise(F.col("role"))
    left = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), left.alias("text"), F.explode(F.sequence(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1))).alias("_n")).drop("_n")


def _marked(rows: DataFrame, of: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n, fresh): different rows with their number, and whether none of an earlier turn has their role and text; a row without role for every conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    given = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), F.lit(1).cast("long").alias("n"))
    empty = F.lit(None).cast("string")
    ids = of.select("conv_id", F.lit(None).cast("long").alias("turn"), empty.alias("role"), empty.alias("text"), F.lit(0).cast("long").alias("n"))
    counts = given.unionByName(ids).groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("_key", F.unhex(F.sha2("text", 256)))
    counts = write_table(counts, "messages")
    order: Column = F.struct(F.col("turn").isNotNull(), "turn")
    spread = counts.where("role is not null").groupBy("conv_id", "role", "_key").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_turns")).where("_turns > 1")
    again = spread.select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("_key").alias("_text"), "_first")
    both = counts.join(again, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_key") == F.col("_text")), "left")
    return both.select("conv_id", "turn", "role", "text", "n", (F.col("_first").isNull() | (F.col("_first") == order)).alias("fresh"))


COUNTS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns"]
SEGMENT = "part int, no int, kind int, counts array<long>, first_turn long, last_turn long, first string, last string, starts array<int>, ends array<int>, costs array<long>, edits array<string>, places array<int>, roles array<string>, texts array<string>"
LEGAL_PAIRS = {"su", "ua", "au"}


def _cells(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _segments(marked: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    """SEGMENT rows with conv_id: of each segment its edits (kind 0), and its messages that may stay (kind 1)."""
    kind = dict(marked.dtypes)["conv_id"]
    names = ["conv_id", *[c.split()[0] for c in SEGMENT.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, schema = TaskContext.get().partitionId(), None
        held, no, key, starts, ready = [], 0, (), (0, 1, 2, 3), []  # rows before the first may be in another task
        messages, chars = ([], [], []), 0
        counts, turns, initials = dict.fromkeys(COUNTS, 0), [None, None], ["", ""]

        def cut() -> None:
            """The segment as rows of the result."""
            nonlocal held, no, starts, messages, chars, counts, turns, initials
            known = cheapest(held, starts)
            ready.append((key[0], part, no, 0, list(counts.values()), *turns, *initials, *map(list, zip(*known, strict=True)), None, None, None))
            if messages[0]:
                ready.append((key[0], part, no, 1, None, None, None, None, None, None, None, None, None, *messages))
            no, starts, held, messages, chars = no + 1, (0, 1, 2, 3), [], ([], [], []), 0
            counts, turns, initials = dict.fromkeys(COUNTS, 0), [None, None], ["", ""]

        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(0), *_arrow_fields(SEGMENT)])
            for conv, turn, role, text, n, fresh in _cells(batch):
                if (conv,) != key:
                    if key:
                        cut()
                        starts = (0,)
                    key = (conv,)
                if role is None:
                    continue
                stripped = text.strip(SPACE)
                for copy in range(n):
                    fault = "blank" if not stripped else "duplicate" if copy or not fresh else "truncated" if stripped[-1] not in ".!?" else ""
                    if fault:
                        counts[fault] += 1
                    if turn is not None and turn != turns[1]:
                        counts["turns"] += 1
                        turns = [turn if turns[0] is None else turns[0], turn]
                    if held:
                        counts["illegal"] += initials[1] + role[:1] not in LEGAL_PAIRS
                    else:
                        initials[0] = role[:1]
                    initials[1] = role[:1]
                    if fault in ("", "truncated"):
                        for cell, x in zip(messages, (len(held), role, text), strict=True):
                            cell.append(x)
                        chars += len(text)
                    held.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
                    counts["rows"] += 1
                    if len(held) >= most_rows or chars >= most_chars:
                        cut()
                if len(ready) >= 256:
                    yield _batch(ready, schema, names)
                    ready.clear()
        if key:
            cut()
            yield _batch(ready, schema, names)

    order = ["conv_id", "turn", "role", F.substring("text", 1, 64)]
    ranged = marked.repartitionByRange(partitions(marked.sparkSession), *order).sortWithinPartitions("conv_id", "turn", "role", "text")
    return ranged.mapInArrow(run, f"conv_id {kind}, {SEGMENT}")


def _arrow_fields(schema: str) -> list[pa.Field]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    of = lambda x: pa.list_(kinds[x[6:-1]]) if x.startswith("array") else kinds[x]
    return [pa.field(*(f(x) for f, x in zip((str, of), c.split(), strict=True))) for c in schema.split(", ")]


def _batch(rows: list[tuple], schema: pa.Schema, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], schema.field(k).type) for k in range(len(names))], names)


class _Conversation:
    """Of one conversation, its segments in order and then its messages in order."""

    def __init__(self, conv):
        self.conv, self.heads, self.offsets, self.made = conv, Heads(Trail(), {0: (0, 0)}), {}, None
        self.counts, self.first_turn, self.last_turn, self.last, self.n_messages = dict.fromkeys(COUNTS, 0), None, None, "", 0
        self.hash = hashlib.sha256()

    def segment(self, part: int, no: int, counts: list[int], first_turn, last_turn, first: str, last: str, edits: list[tuple]) -> None:
        self.offsets[part, no] = self.counts["rows"]
        if not counts[0]:
            return
        if self.counts["rows"]:
            self.counts["illegal"] += self.last + first not in LEGAL_PAIRS
        if first_turn is not None:
            self.counts["turns"] -= first_turn == self.last_turn
            self.first_turn, self.last_turn = first_turn if self.first_turn is None else self.first_turn, last_turn
        for name, n in zip(COUNTS, counts, strict=True):
            self.counts[name] += n
        self.last = last
        self.heads.segment(edits)

    def settle(self) -> None:
        if self.made is None:
            self.cost, self.audit = self.heads.best()
            self.made, self.heads = Repair(self.audit), None

    def hashed(self, messages: Iterator[tuple[str, str]]) -> Iterator[tuple[int, str, str]]:
        for role, text in messages:
            self.hash.update(f"{chr(10) if self.n_messages else ''}{role}:{text}".encode())
            yield self.n_messages, role, text
            self.n_messages += 1

    def messages(self, part: int, no: int, places: list[int], roles: list[str], texts: list[str]) -> Iterator[tuple[int, str, str]]:
        self.settle()
        for place, role, text in zip(places, roles, texts, strict=True):
            yield from self.hashed(self.made.message(self.offsets[part, no] + place, role, text))

    def end(self) -> Iterator[tuple[int, str, str]]:
        self.settle()
        yield from self.hashed(self.made.rest())

    def summary(self) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.counts["turns"]
        return self.conv, gaps, *(self.counts[c] for c in ("blank", "duplicate", "truncated", "illegal")), self.cost, self.audit, self.hash.hexdigest()


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGE = "place long, role string, text string"


def _walked(rows: DataFrame, of: DataFrame | None, messages: bool, most_rows: int, most_chars: int) -> DataFrame:
    kind, schema = dict(rows.dtypes)["conv_id"], MESSAGE if messages else SUMMARY
    names = ["conv_id", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready, chars, fields = None, [], 0, None

        def ended() -> None:
            left = [(now.conv, *m) for m in now.end()]
            ready.extend(left if messages else [now.summary()])

        for batch in batches:
            fields = fields or pa.schema([batch.schema.field(0), *_arrow_fields(schema)])
            for conv, part, no, sort, counts, first_turn, last_turn, first, last, starts, ends, costs, edits, places, roles, texts in _cells(batch):
                if now is None or now.conv != conv:
                    if now:
                        ended()
                    now = _Conversation(conv)
                if sort == 0:
                    now.segment(part, no, counts, first_turn, last_turn, first, last, list(zip(starts, ends, costs, edits, strict=True)))
                else:
                    for m in now.messages(part, no, places, roles, texts):
                        if messages:
                            ready.append((conv, *m))
                            chars += len(m[2])
                if len(ready) >= 2048 or chars >= 1 << 22:
                    yield _batch(ready, fields, names)
                    ready, chars = [], 0
        if now:
            ended()
            yield _batch(ready, fields, names)

    segments = _segments(_marked(rows, rows.select("conv_id") if of is None else of), most_rows, most_chars)
    whole = segments.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "no")
    return whole.mapInArrow(run, f"conv_id {kind}, {schema}")


def audits(rows: DataFrame, of: DataFrame | None = None, most_rows: int = ROWS, most_chars: int = CHARS) -> DataFrame:
    """A row per conversation of `rows` (conv_id, turn, role, text) and of `of` (conv_id): SUMMARY.

    gaps: turns missing between the first and the last. blank, duplicate, truncated: rows by their first fault. illegal: neighbours whose
    initials are not su, ua or au. repaired_sha256: of the repaired role:text, joined by newlines.
    """
    return _walked(rows, of, False, most_rows, most_chars)


def repaired(rows: DataFrame, most_rows: int = ROWS, most_chars: int = CHARS) -> DataFrame:
    """(conv_id, place, role, text): the repaired messages, places from 0."""
    return _walked(rows, None, True, most_rows, most_chars)
