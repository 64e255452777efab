"""Arabic for renderers that neither join letters nor turn lines: letters in their joined forms, in visual order.

Joining is an automaton over a letter's neighbours: a letter joins the one before if that joins onwards and this one has
a final form. Which forms a letter has follows from Unicode's compatibility decompositions. Order is that of one line
without embedded directions: runs of Arabic are reversed, runs of Latin letters and of numbers stay as they are, and what
stands between belongs to its neighbours where they agree and else to the line, whose direction is its first letter's.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARABIC = "[\\u0600-\\u06FF\\u0750-\\u077F]"
# The ranges of presentation forms.
FORMS = ((0xFB50, 0xFC00), (0xFE70, 0xFEFD))


@cache
def letter_forms() -> dict[str, dict[str, str]]:
    """letter (or the two letters of a ligature) -> form (isolated, final, initial, medial) -> character."""
    found: dict[str, dict[str, str]] = {}
    for code in (c for a, b in FORMS for c in range(a, b)):
        kind, *base = unicodedata.decomposition(chr(code)).split() or [""]
        letters = "".join(chr(int(x, 16)) for x in base)
        # of two letters only lam with an alef is a ligature that every text has
        if kind in ("<isolated>", "<final>", "<initial>", "<medial>") and (len(letters) == 1 or len(letters) == 2 and letters[0] == "ل"):
            found.setdefault(letters, {}).setdefault(kind.strip("<>"), chr(code))
    return found


def joined(text: str) -> str:
    """Letters in the forms that their neighbours give them; marks stay behind their letters."""
    forms, units = letter_forms(), []
    for c in unicodedata.normalize("NFC", text):
        if units and unicodedata.combining(c):
            units[-1][1] += c
        elif units and units[-1][0] + c in forms and not units[-1][1] and units[-1][0] == "ل":
            units[-1][0] += c
        else:
            units.append([c, ""])
    onwards = lambda u: "initial" in forms.get(u[0], ())
    back = lambda u: "final" in forms.get(u[0], ())
    out = []
    for i, u in enumerate(units):
        before = i > 0 and onwards(units[i - 1]) and back(u)
        after = i + 1 < len(units) and onwards(u) and back(units[i + 1])
        form = ("medial" if after else "final") if before else "initial" if after else "isolated"
        out.append(forms.get(u[0], {}).get(form, u[0]) + u[1])
    return "".join(out)


def _direction(c: str) -> str:
    kind = unicodedata.bidirectional(c)
    return "R" if kind in ("R", "AL") else "L" if kind in ("L", "EN", "AN") else "M" if kind == "NSM" else ""


def visual(text: str) -> str:
    """A line in the order in which it is seen from left to right."""
    sides = [_direction(c) for c in text]
    line = next((s for c, s in zip(text, sides) if s == "R" or unicodedata.bidirectional(c) == "L"), "L")
    at = 0
    while at < len(sides):
        if sides[at] == "M":
            sides[at] = sides[at - 1] if at else line
        if sides[at]:
            at += 1
            continue
        end = next((k for k in range(at, len(sides)) if sides[k] and sides[k] != "M"), len(sides))
        around = {sides[at - 1] if at else line, sides[end] if end < len(sides) else line}
        sides[at:end] = [around.pop() if len(around) == 1 else line] * (end - at)
    runs: list[tuple[str, list[str]]] = []
    for c, side in zip(text, sides):
        if not runs or runs[-1][0] != side:
            runs.append((side, []))
        runs[-1][1].append(c)
    turned = ["".join(_mirrored(c) for c in _marks_behind(run)) if side == "R" else "".join(run) for side, run in runs]
    return "".join(reversed(turned) if line == "R" else turned)


def _marks_behind(run: list[str]) -> list[str]:
    """A run from right to left, each letter's marks still behind it."""
    letters: list[list[str]] = []
    for c in run:
        if letters and unicodedata.combining(c):
            letters[-1].append(c)
        else:
            letters.append([c])
    return [c for letter in reversed(letters) for c in letter]


# Brackets that are seen as their counterparts from right to left.
BRACKETS = "()[]{}<>«»"


def _mirrored(c: str) -> str:
    at = BRACKETS.find(c)
    return BRACKETS[at ^ 1] if at >= 0 else c


@F.pandas_udf(T.StringType())
def _shaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: None if x is None else "\n".join(visual(joined(line)) for line in x.split("\n")))


def shaped(text: Column) -> Column:
    """Lines with Arabic joined and in visual order; strings without Arabic stay in the JVM, as they are."""
    return F.coalesce(_shaped(F.when(text.rlike(ARABIC), text)), text)
