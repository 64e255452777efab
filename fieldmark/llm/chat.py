r"""Chat formatting: a finite-state machine over roles and a declarative template.

``format_turns`` turns (conversation, turn, role, text) rows into one row per turn holding the formatted
string, its segments as (length, loss) pairs, the machine's state after the turn and whether the step was
allowed. A conversation is dealt to one task by its id and streamed in turn order, so that memory doesn't
grow with its length; a conversation's digest needs its turns in order anyway.

Texts keep no control string of the template: a backslash is put after a control string's first character
and backslashes are doubled, which ``unescape`` reverses. ``read_back`` parses formatted turns alone.

Defined cases: null text is empty; a null role is the empty role; a role that the template doesn't name gets
the general marker and an invalid step, and later steps are judged from the last known state; rows with the
same turn number are ordered by role and text, and repeated rows all stay; a null conversation id is a
conversation of its own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ChatTemplate:
    """Markers around each role's text, roles under the loss, and the allowed steps between states."""

    turns: dict = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<a> ", " </s>")})
    other: tuple = ("[ROLE] ", " [/ROLE] ", " [/TURN]")
    loss: frozenset = frozenset({"assistant"})
    #: state -> roles that may follow; the state is the last role, "" before the first turn.
    steps: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: frozenset = frozenset({"assistant"})
    #: Further control strings that no text may hold.
    reserved: tuple = ("<s>",)

    def controls(self) -> list[str]:
        marks = [m.strip() for pair in self.turns.values() for m in pair] + [m.strip() for m in self.other] + list(self.reserved)
        return sorted({m for m in marks if m}, key=lambda m: (-len(m), m))


def codec(template: ChatTemplate):
    """(escape, unescape) for texts under the template."""
    controls = template.controls()
    if any(len(c) < 2 or "\\" in c for c in controls):
        raise ValueError("control strings need two characters or more and no backslash")
    special = re.compile("|".join(re.escape(c) for c in ["\\", *controls]))
    back = re.compile(r"\\(.)", re.S)

    def escape(text: str) -> str:
        return special.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)

    def unescape(text: str) -> str:
        return back.sub(r"\1", text) if "\\" in text else text

    return escape, unescape


def segments_of(template: ChatTemplate, escape, role: str, text: str) -> list[tuple[str, bool]]:
    if role in template.turns:
        before, after = template.turns[role]
    else:
        before, after = template.other[0] + escape(role) + template.other[1], template.other[2]
    return [(before, False), (escape(text), role in template.loss), (after, False)]


def parse_turns(template: ChatTemplate, unescape, formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a formatted string."""
    starts = {pair[0]: role for role, pair in template.turns.items()} | {template.other[0]: None}
    start = re.compile("|".join(re.escape(s) for s in sorted(starts, key=len, reverse=True)))
    turns, at = [], 0
    while at < len(formatted):
        m = start.match(formatted, at)
        if not m:
            raise ValueError(f"no turn marker at {at}")
        role, at = starts[m[0]], m.end()
        if role is None:
            # an escaped role holds no control string, so the first one ends it
            end = formatted.index(template.other[1], at)
            role, at, after = unescape(formatted[at:end]), end + len(template.other[1]), template.other[2]
        else:
            after = template.turns[role][1]
        end = formatted.index(after, at)
        turns.append((role, unescape(formatted[at:end])))
        at = end + len(after)
    return turns


TURN_SCHEMA = "conv_id long, position long, role string, state string, valid boolean, formatted string, segments array<struct<length:long,loss:boolean>>"


def format_turns(df: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per turn, dealt by conv_id and in turn order within each conversation."""
    dealt = df.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = dealt.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        escape, _ = codec(template)
        conv, state, position = object(), "", 0
        for batch in batches:
            out = {n: [] for n in ("conv_id", "position", "role", "state", "valid", "formatted", "segments")}
            for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
                if c != conv:
                    conv, state, position = c, "", 0
                valid = role in template.steps.get(state, ())
                state = role if role in template.turns else state
                parts = segments_of(template, escape, role, text)
                row = (c, position, role, state, valid, "".join(p for p, _ in parts), [{"length": len(p), "loss": k} for p, k in parts])
                for n, v in zip(out, row):
                    out[n].append(v)
                position += 1
            seg = pa.list_(pa.struct([("length", pa.int64()), ("loss", pa.bool_())]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.string(), seg]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], names=list(out))

    return dealt.mapInArrow(run, TURN_SCHEMA)


def format_conversations(df: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conversation: its text, its segments in order, whether the machine accepted it.

    For conversations that fit in a row; ``format_turns`` has no such bound.
    """
    turn = F.struct("position", "formatted", "segments", "valid", "state")
    grouped = format_turns(df, template).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    last = F.element_at("t", -1)["state"]
    return grouped.select(
        "conv_id",
        F.array_join(F.col("t.formatted"), "").alias("text"),
        F.flatten(F.col("t.segments")).alias("segments"),
        (F.forall(F.col("t.valid"), lambda v: v) & last.isin(list(template.final))).alias("accepted"),
    )


def read_back(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Digests of what formatted turns say, from their strings and loss segments only; order as format_turns left it."""

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, accepted boolean, first_invalid long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        _, unescape = codec(template)
        conv, now, out = object(), None, []

        def ended():
            n, turns_sha, loss_n, loss_sha, chars, bad, last = now
            return (conv, n, turns_sha.hexdigest(), loss_n, loss_sha.hexdigest(), chars, bad is None and last in template.final, bad)

        def batch_of(rows):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for c, at, state, valid, text, segs in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "position", "state", "valid", "formatted", "segments"))):
                if c != conv or now is None:
                    if now is not None:
                        out.append(ended())
                    conv, now = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, None, ""]
                for role, said in parse_turns(template, unescape, text):
                    now[0] += 1
                    now[1].update(f"{role}\n{said}\n".encode())
                start = 0
                for s in segs:
                    if s["loss"]:
                        said = unescape(text[start : start + s["length"]])
                        now[2] += len(said)
                        now[3].update(said.encode())
                    start += s["length"]
                now[4] += len(text)
                now[5] = at if now[5] is None and not valid else now[5]
                now[6] = state
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        if now is not None:
            out.append(ended())
        if out:
            yield batch_of(out)

    return turns.mapInArrow(run, schema)
