r"""Personal data in texts: patterns propose spans, checks confirm them, context words adjust their score.

Base kinds, each leftmost and non-overlapping: email, ip (parts at most 255), card (13 to 19 digits that pass
Luhn) and phone (9 to 15 digits). A base span that passes its check stays whatever its context; the score only
grades it. The method adds two kinds that depend on checks or context: iban (a country's length and mod-97)
and ssn (three, two and four digits whose score reaches the threshold only beside a word such as "ssn").

Scans are linear in the text: an email is sought from its "@", digits only where a run of digits begins.
Offsets count code points.

Defined cases: a null text is the empty text and has no spans; very long texts are scanned whole; repeated rows stay;
further columns are ignored by ``digest`` and kept by ``redact_column``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from fieldmark.llm.common import map_rows

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
#: Added spans need this score. Context adds or takes off so much, within so many characters.
THRESHOLD, BOOST, PENALTY, REACH = 0.5, 0.35, 0.2, 48

# The number of characters of an IBAN in each country (ISO 13616 registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21,
    "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24,
    "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "XK": 20,
}

CONTEXT = {
    "email": ("mail", "contact", "correo", "kontakt"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "social-security"),
}
AGAINST = ("version", "example", "order", "isbn", "serial", "part no")
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.2}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_REST = {c: re.compile(rf"(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for c, n in IBAN_LENGTHS.items()}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    ended = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > ended and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            ended = m.end()
            yield start, ended


def _ibans(text: str):
    ended = 0
    for m in _IBAN.finditer(text):
        rest = _IBAN_REST.get(m[0][:2])
        whole = rest.match(text, m.end()) if rest and m.start() >= ended else None
        if whole and mod97((m[0] + whole[0]).replace(" ", "")):
            ended = whole.end()
            yield m.start(), ended


def _scored(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - REACH) : start] + " " + text[end : end + REACH]).lower()
    score = SCORES[kind] + BOOST * any(w in near for w in CONTEXT[kind]) - PENALTY * any(w in near for w in AGAINST)
    return min(1.0, max(0.0, score))


def find_spans(text: str) -> list[Span]:
    """All spans, by kind in the order of KINDS and then by start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *x) for x in _emails(text)]
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    found += [("iban", *x) for x in _ibans(text)]
    found += [("ssn", *m.span()) for m in _SSN.finditer(text)]
    spans = [Span(k, s, e, _scored(text, k, s, e)) for k, s, e in found]
    return [x for x in spans if x.kind in BASE or x.score >= THRESHOLD]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Each span replaced by its kind in angle brackets; spans that overlap are replaced as one, by the earliest's kind."""
    out, at = [], 0
    merged: list[list] = []
    for x in sorted(spans, key=lambda x: (x.start, -x.end)):
        if merged and x.start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], x.end)
        else:
            merged.append([x.start, x.end, x.kind])
    for start, end, kind in merged:
        out += [text[at:start], f"<{kind.upper()}>"]
        at = end
    return "".join([*out, text[at:]])


def span_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its spans with kind, offsets and score."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            spans = [[x._asdict() for x in find_spans(t.as_py() or "")] for t in batch.column(text)]
            return {key: batch.column(key), "spans": spans}

        return work

    return map_rows(df, [key, text], f"{key} long, spans array<struct<kind:string,start:long,end:long,score:double>>", make, text)


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out: dict = {key: batch.column(key)} | {f"n_{k}": [] for k in BASE} | {"base_sha256": [], "spans": []}
            for t in batch.column(text):
                spans = find_spans(t.as_py() or "")
                for k in BASE:
                    out[f"n_{k}"].append(sum(x.kind == k for x in spans))
                out["base_sha256"].append(hashlib.sha256(joined([x for x in spans if x.kind in BASE]).encode()).hexdigest())
                out["spans"].append(joined(spans))
            return out

        return work

    return map_rows(df, [key, text], f"{key} long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", make, text)


def redact_column(df: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """df with its texts redacted, all columns and nulls as they were; length: the column that counts their characters."""
    names = df.columns

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = {n: batch.column(n) for n in names}
            said = [t.as_py() for t in batch.column(text)]
            new = [t if t is None else redact(t, find_spans(t)) for t in said]
            out[text] = new
            if length in names:
                out[length] = [n if a == b else len(b) for n, a, b in zip(batch.column(length).to_pylist(), said, new)]
            return out

        return work

    return map_rows(df, names, df.schema, make, text)
