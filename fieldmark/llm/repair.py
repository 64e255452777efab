r"""Conversation structure repair: the cheapest edits that make a conversation's roles fit a grammar.

Three machines are composed lazily: an acceptor of the conversation's rows, a transducer with one state that keeps,
reroles, deletes or inserts turns, and an acceptor of role initials. A node of the composition is (rows read, turns
inserted since, grammar state), which is a topological order, as a chain of more inserted turns than the grammar has
steps without a repeated state costs more than it brings. Weights are pairs (cost, labels of the edits), the least
wins: cost first, then the labels in ASCII order. Labels determine the repaired roles, and two paths between the same
two nodes at one cost never have labels of which one begins the other (the further ones would be insertions, which
cost), so that weights of parts may be multiplied in any grouping. That makes the search parallel: rows are dealt by
ranges of (conversation, turn, role, text), each task multiplies the weights of what it has of a conversation (pairwise,
so that labels are copied a logarithm of times), and the few products of a conversation that spans tasks are multiplied
in their order. Texts take no part in that; they meet the edits afterwards, in a stream that holds one row at a time.

Equal rows of a conversation (same turn, role and text) travel as one with a count, and the first of equal role and
text is found by an aggregate, so neither a conversation nor a text with a third of all rows is gathered in a task. Only
``digest`` reads a conversation by one task, as a hash over its text takes its turns in order; it holds one turn.

Defined cases: a null role or text is one space, which is a role that no grammar knows and a blank text; an empty role
has no initial and can't be kept; a null conversation id is a conversation of its own; null turns come first; rows with
the same turn are ordered by role and text; repeated rows all count, those after the first as duplicates; very long
texts are read whole, in the JVM but for the rows that are kept; an empty table gives an empty result; further columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fieldmark.llm.common import bind, drop_table, materialize

SPACES = " \t\n\x0b\x0c\r"
ENDS = (".", "!", "?")
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)


@dataclass(frozen=True)
class RoleGrammar:
    """An acceptor of role initials; the default accepts ``(s?(ua)+)?``. Adjacent pairs outside ``pairs`` are illegal."""

    steps: tuple = ((0, "s", 1), (0, "u", 2), (1, "u", 2), (2, "a", 3), (3, "u", 2))
    start: int = 0
    final: frozenset = frozenset({0, 3})
    pairs: frozenset = frozenset({"su", "ua", "au"})

    def __post_init__(self):
        object.__setattr__(self, "to", {(q, x): r for q, x, r in self.steps})
        object.__setattr__(self, "states", sorted({self.start, *self.final, *(q for q, _, _ in self.steps), *(r for _, _, r in self.steps)}))


@dataclass(frozen=True)
class Edits:
    """What the transducer may do, with what it costs; ``truncated`` is added for each truncated row that isn't deleted.

    Insertions must cost something, else there is no least number of them.
    """

    keep: int = 0
    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3
    #: The roles that turns are given or inserted with; their initials must differ.
    roles: tuple = ("user", "assistant")

    def __post_init__(self):
        if self.insert <= 0 or len({r[:1] for r in self.roles}) < len(self.roles):
            raise ValueError("an insertion must cost something, and roles need initials of their own")


#: state -> state -> (cost, labels): the least weights between grammar states over some rows.
Weights = dict


@dataclass(frozen=True)
class Machine:
    """The composition, expanded where it is reached."""

    grammar: RoleGrammar = field(default_factory=RoleGrammar)
    edits: Edits = field(default_factory=Edits)

    def arcs(self, node: tuple, row: tuple | None):
        """(node, cost, label) after a node (rows read, turns inserted, state), where row (initial, fault) is next."""
        read, inserted, q = node
        if inserted + 1 < len(self.grammar.states):
            for role in self.edits.roles:
                if (r := self.grammar.to.get((q, role[0]))) is not None:
                    yield (read, inserted + 1, r), self.edits.insert, "I"
        if row is None or read:
            return
        initial, fault = row
        yield (1, 0, q), self.edits.delete, "D"
        if fault in (BLANK, DUPLICATE):
            return
        more = self.edits.truncated if fault == TRUNCATED else 0
        if (r := self.grammar.to.get((q, initial))) is not None:
            yield (1, 0, r), self.edits.keep + more, "K"
        for role in self.edits.roles:
            if (r := self.grammar.to.get((q, role[0]))) is not None:
                yield (1, 0, r), self.edits.rerole + more, "R"

    def shortest(self, q: int, row: tuple | None) -> dict:
        """state -> least weight from state q: over a row, with insertions before it, or over insertions alone if row is None."""
        layer, ends = {(0, 0, q): (0, "")}, {}
        while layer:
            after: dict = {}
            for node, (cost, label) in layer.items():
                if row is None:
                    ends[node[2]] = min(ends.get(node[2], (cost, label)), (cost, label))
                for (read, k, r), c, x in self.arcs(node, row):
                    place, key, got = (ends, r, (cost + c, label + x)) if read else (after, (read, k, r), (cost + c, label + x))
                    place[key] = min(place.get(key, got), got)
            layer = after
        return ends

    @lru_cache(maxsize=4096)  # noqa: B019  a few kinds of rows for each machine
    def weights(self, row: tuple | None) -> Weights:
        return {q: self.shortest(q, row) for q in self.grammar.states}

    def over(self, row: tuple, copies: int) -> Weights:
        """Weights of a row with copies behind it, which are all deleted."""
        first = self.weights(row)
        if copies == 1:
            return first
        more = ((copies - 1) * self.edits.delete, "D" * (copies - 1))
        return {q: {r: (c + more[0], x + more[1]) for r, (c, x) in to.items()} for q, to in first.items()}

    def best(self, over: Weights) -> tuple[int, str]:
        """The least weight of a whole conversation, given the weights of its rows."""
        ended = multiplied({self.grammar.start: over[self.grammar.start]}, self.weights(None))[self.grammar.start]
        return min(w for q, w in ended.items() if q in self.grammar.final)

    def replay(self):
        """A function of an edit's label and the row's role to the role of the turn that it leaves, or None; it keeps the state."""
        q = self.grammar.start
        by_initial = {r[0]: r for r in self.edits.roles}

        def step(label: str, role: str | None = None) -> str | None:
            nonlocal q
            if label == "D":
                return None
            if label != "K":
                # of the roles to give, one leads on, as a grammar whose labels tell the roles has one
                role = by_initial[next(x for x in by_initial if (q, x) in self.grammar.to)]
            q = self.grammar.to[q, role[:1]]
            return role

        return step


def multiplied(a: Weights, b: Weights) -> Weights:
    """The least weights over the rows of a and then those of b."""
    out: Weights = {}
    for q, to in a.items():
        best: dict = {}
        for r, (c, x) in to.items():
            for s, (d, y) in b[r].items():
                known = best.get(s)
                if known is None or c + d < known[0] or (c + d == known[0] and x + y < known[1]):
                    best[s] = (c + d, x + y)
        out[q] = best
    return out


class Product:
    """The weights of a run of rows, multiplied as they come: runs of like lengths meet, so labels are copied a logarithm of times."""

    RUN = 64

    def __init__(self, machine: Machine, starts: list[int]):
        self.unit = {q: {q: (0, "")} for q in machine.grammar.states}
        self.whole: list[tuple[int, Weights]] = []
        self.starts, self.now, self.length = starts, {q: self.unit[q] for q in starts}, 0

    def add(self, weights: Weights) -> None:
        self.now, self.length = multiplied(self.now, weights), self.length + 1
        if self.length == self.RUN:
            n, run = self.length, self.now
            while self.whole and self.whole[-1][0] <= n:
                m, before = self.whole.pop()
                n, run = n + m, multiplied(before, run)
            self.whole.append((n, run))
            self.now, self.length = self.unit, 0

    def result(self) -> Weights:
        out = self.now
        for _, before in reversed(self.whole):
            out = multiplied(before, out)
        return out


def _map_stream(df: DataFrame, schema: str, make) -> DataFrame:
    """mapInArrow where make() gives a step from a row's values to output rows, called with None at the end; outputs go out in batches."""
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches):
        step, rows, size = make(), [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                for row in step(values):
                    rows.append(row)
                    size += sum(len(x) for x in row if isinstance(x, str))
                if len(rows) >= 5000 or size > 8 << 20:
                    yield made()
                    rows, size = [], 0
        rows += step(None)
        if rows:
            yield made()

    return df.mapInArrow(run, out)


def _faults(df: DataFrame, copies: str | None) -> DataFrame:
    """conv_id, turn, role, text, n (how often the row stands there) and fault of the first of them, once for each of equal rows."""
    space = F.lit(" ")
    times = F.col(copies) if copies else F.lit(1)
    said = df.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), times.cast("long").alias("n"))
    rows = said.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("same", F.unhex(F.sha2(F.col("text"), 256)))
    first = rows.where("n > 0").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("same").alias("s")).agg(F.min(F.struct("turn")).alias("t"))
    # both sides have a key once, so that no key is hot
    met = rows.join(first, rows.conv_id.eqNullSafe(first.c) & (rows.role == first.r) & (rows.same == first.s) & rows.turn.eqNullSafe(first.t["turn"]), "left")
    end = F.rtrim(F.col("text"), F.lit(SPACES))
    kind = lambda e: F.when(e == "", BLANK).when(F.col("r").isNull(), DUPLICATE).when(~F.right(e, F.lit(1)).isin(*ENDS), TRUNCATED).otherwise(FINE)
    return met.select("conv_id", "turn", "role", "text", "n", bind(end, kind).alias("fault"))


_PART = "conv_id long, part int, pos long, turn long, role string, text string, n long, fault int, seg struct<w:array<struct<q:int,r:int,cost:long,label:string>>,count:array<long>,ends:array<string>,turns:array<long>>"


def _parts(machine: Machine, rows: DataFrame) -> DataFrame:
    """Rows with their places (part, pos), and behind the rows of each part of a conversation its findings (seg)."""
    order = ["conv_id", "turn", "role", "text"]

    def make():
        part = TaskContext.get().partitionId()
        first, conv, pos, now = True, object(), 0, None

        def ended():
            product, count, ends, turns = now
            w = [{"q": q, "r": r, "cost": c, "label": x} for q, to in product.result().items() for r, (c, x) in to.items()]
            return (conv, part, pos, None, None, None, 0, 0, {"w": w, "count": count, "ends": ends, "turns": turns})

        def step(row):
            nonlocal first, conv, pos, now
            if now is not None and (row is None or row[0] != conv):
                yield ended()
            if row is None:
                return
            c, turn, role, text, n, fault = row
            if now is None or c != conv:
                # what a task begins with may go on from another task's rows, in any state
                starts = machine.grammar.states if first else [machine.grammar.start]
                first, conv, pos, now = False, c, 0, (Product(machine, starts), [0] * 5, [], [])
            if not n:
                return
            product, count, ends, turns = now
            initial = role[:1]
            product.add(machine.over((initial, fault), n))
            count[0] += n if fault == BLANK else 0
            count[1] += n if fault == DUPLICATE else n - 1 if fault != BLANK else 0
            count[2] += fault == TRUNCATED
            count[3] += (n - 1) * (initial + initial not in machine.grammar.pairs) + (bool(ends) and ends[1] + initial not in machine.grammar.pairs)
            ends[:] = [ends[0] if ends else initial, initial]
            if turn is not None:
                count[4] += not turns or turns[1] != turn
                turns[:] = [turns[0] if turns else turn, turn]
            yield (c, part, pos, turn, role, text if fault in (FINE, TRUNCATED) else None, n, fault, None)
            pos += 1

        return step

    return _map_stream(rows.repartitionByRange(*order).sortWithinPartitions(*order), _PART, make)


FOUND = "gaps:long,blank:long,duplicate:long,truncated:long,illegal:long,cost:long,audit:string"


def _findings(machine: Machine, parts: DataFrame) -> DataFrame:
    """conv_id and found of each conversation: the findings of its parts put together in their order."""

    def make():
        conv, now = object(), None

        def ended():
            weights, (blank, duplicate, truncated, illegal, distinct), _, turns = now
            cost, audit = machine.best(weights)
            return (conv, {"gaps": turns[1] - turns[0] + 1 - distinct if turns else 0, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "cost": cost, "audit": audit})

        def step(row):
            nonlocal conv, now
            if now is not None and (row is None or row[0] != conv):
                yield ended()
            if row is None:
                return
            c, _, seg = row
            weights: Weights = {}
            for x in seg["w"]:
                weights.setdefault(x["q"], {})[x["r"]] = (x["cost"], x["label"])
            count, ends, turns = seg["count"], seg["ends"], seg["turns"]
            if now is None or c != conv:
                conv, now = c, ({machine.grammar.start: weights[machine.grammar.start]}, count, ends, turns)
                return
            before, sums, was, at = now
            sums = [x + y for x, y in zip(sums, count)]
            sums[3] += bool(was and ends) and was[1] + ends[0] not in machine.grammar.pairs
            sums[4] -= bool(at and turns) and at[1] == turns[0]
            join = lambda a, b: [a[0], b[1]] if a and b else a or b
            now = (multiplied(before, weights), sums, join(was, ends), join(at, turns))

        return step

    segments = parts.where("seg IS NOT NULL").select("conv_id", "part", "seg")
    return _map_stream(segments.repartition("conv_id").sortWithinPartitions("conv_id", "part"), f"conv_id long, found struct<{FOUND}>", make)


REPAIRED = f"conv_id long, position long, role string, text string, edit string, found struct<{FOUND}>"


def repair(df: DataFrame, machine: Machine | None = None, copies: str | None = None) -> DataFrame:
    """The repaired turns of each conversation in order, dealt by conversation: conv_id, position, role, text, edit (its label).

    Before them stands a row at position -1 with ``found``: gaps, faults, illegal pairs, cost and all edits' labels. df:
    conv_id, turn, role, text and, if it is named, a column of copies: how often a row stands there; one without only names its conversation.
    """
    machine = machine or Machine()
    faults = materialize(_faults(df, copies), "faults")
    parts = materialize(_parts(machine, faults), "parts")
    drop_table(faults)
    lines = parts.where("seg IS NULL").select("conv_id", "part", "pos", "role", "text", "n", F.lit(None).cast(f"struct<{FOUND}>").alias("found"))
    heads = _findings(machine, parts).select("conv_id", F.lit(-1).alias("part"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("n"), "found")
    both = heads.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")

    def make():
        audit, at, position, play, conv = "", 0, 0, None, object()

        def inserted():
            nonlocal at, position
            while at < len(audit) and audit[at] == "I":
                yield (conv, position, play("I"), "", "I", None)
                at, position = at + 1, position + 1

        def step(row):
            nonlocal audit, at, position, play, conv
            if row is None or row[6] is not None:
                if play:
                    yield from inserted()
                if row is None:
                    return
                conv, audit, at, position, play = row[0], row[6]["audit"], 0, 0, machine.replay()
                yield (conv, -1, None, None, None, row[6])
                return
            _, _, _, role, text, n, _ = row
            yield from inserted()
            if (left := play(audit[at], role)) is not None:
                yield (conv, position, left, text, audit[at], None)
                position += 1
            at += n

        return step

    return _map_stream(both, REPAIRED, make)


def digest(repaired: DataFrame) -> DataFrame:
    """One row for each conversation: its findings, n_turns and repaired_sha256 (``role:text`` of the repaired turns, joined by newlines).

    repaired: as repair() left it, a conversation's rows in order in one partition.
    """

    def make():
        conv, found, n, sha = None, None, 0, None

        def ended():
            return (conv, *found.values(), n, sha.hexdigest())

        def step(row):
            nonlocal conv, found, n, sha
            if found and (row is None or row[5]):
                yield ended()
            if row is None:
                return
            if row[5]:
                conv, found, n, sha = row[0], row[5], 0, hashlib.sha256()
                return
            sha.update(f"{chr(10) if n else ''}{row[2]}:{row[3]}".encode())
            n += 1

        return step

    names = ", ".join(f.replace(":", " ") for f in FOUND.split(","))
    return _map_stream(repaired, f"conv_id long, {names}, n_turns long, repaired_sha256 string", make)


def damaged(df: DataFrame) -> DataFrame:
    """Rows as a careless export leaves them, by a hash of conversation and turn: some lost, emptied, cut off, repeated or of another role.

    Nulls are one space. A lost row stays with no copies, so that its conversation is still known.
    """
    text_of = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(text_of(F.col("conv_id")), F.lit(":"), text_of(F.col("turn"))).cast("binary")), F.lit(20))
    lost = F.col("kind") == 0

    def but(c: Column, gone: Column, other: Column) -> Column:
        return F.when(lost, gone).otherwise(other).alias(c)

    text, role = text_of(F.col("text")), text_of(F.col("role"))
    cut = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate(text, "".join(ENDS), "")).otherwise(text)
    return df.withColumn("kind", kind).select(
        "conv_id", but("turn", F.lit(None).cast("long"), F.col("turn").cast("long")), but("role", F.lit(""), F.when(F.col("kind") == 4, "user").otherwise(role)), but("text", F.lit(""), cut),
        F.when(lost, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )
