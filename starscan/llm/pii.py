"""Personal data in texts: anchors found by an Aho-Corasick automaton, then local parsers.

Anchors are at-signs, digits, plus signs, ``://`` and cues such as ``account`` or ``iban``. From
each anchor a deterministic parser walks to the boundaries and validates. Base kinds, each leftmost
and non-overlapping by itself; what a parser rejects is dropped and not tried again from inside:

- email: local part, at-sign, at least two dotted labels
- ip: four dotted numbers up to 255
- card: 14 to 19 digits, single spaces or hyphens between, that pass Luhn
- phone: plus sign, 10 to 15 digits with spaces, dots, hyphens and brackets between

Further kinds, which never replace the base ones: ``account`` (an identifier behind a cue; and a
run of 14 to 19 digits that passes Luhn inside a longer row of numbers, which as a whole is no card)
and ``login`` (an address with user information, ``scheme://user:word@host``).

Defined results. Null text: empty for ``find``, left null by ``redact``. Empty and very long texts:
as any other. Null doc_id, repeated rows: each for itself. Empty table: no row. ``redact`` keeps all
columns; ``find`` ignores all but doc_id and text.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starscan.llm.common import text_chunks

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "login")
# fixed values: words that announce an identifier
CUES = (
    "account", "acct", "iban", "konto", "kontonummer", "compte", "cuenta", "passport", "ssn",
    "customer id", "user id", "token", "api_key", "apikey", "api key", "secret", "password",
)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_PHONE = re.compile(r"[0-9][ ().0-9-]+")
_DIGITS = re.compile(r"[0-9]+")
_LEAD = re.compile(
    r"(?:[ \t]*+(?:number|nummer|no\.?|nr\.?|id|#))?+[ \t]*+[:=#]?+[ \t]*+[\"']?+",
    re.I,
)
_GROUPS = re.compile(r"[0-9]+(?:[ -][0-9]+)*(?!-?[A-Za-z0-9])")
_IBAN = re.compile(
    r"[A-Z]{2}[0-9]{2}(?:[ -][A-Z0-9]{4}){2,7}(?:[ -][A-Z0-9]{1,3})?"
    r"|[a-z]{2}[0-9]{2}(?:[ -][a-z0-9]{4}){2,7}(?:[ -][a-z0-9]{1,3})?"
)
_WORD = re.compile(r"[A-Za-z0-9]++(?:-[A-Za-z0-9]++)*+")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*$")
_LOGIN = re.compile(r"[^\s/@:]+(?::[^\s/@]*)?@[A-Za-z0-9.-]+")

Span = tuple[str, int, int]


@functools.cache
def _automaton():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for sign in ("@", "+", "://", *"0123456789", *CUES):
        automaton.add_word(sign, sign)
    automaton.make_automaton()
    return automaton


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) << (place & 1)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _emails(text: str, at_signs: list[int]) -> Iterator[Span]:
    done = 0
    for at in at_signs:
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield "email", start, done


def _chains(runs: list[tuple[int, int]], text: str, glue: str) -> Iterator[list[tuple[int, int]]]:
    """Runs of digits that single characters of ``glue`` hold together."""
    chain: list[tuple[int, int]] = []
    for run in runs:
        if chain and (run[0] != chain[-1][1] + 1 or text[chain[-1][1]] not in glue):
            yield chain
            chain = []
        chain.append(run)
    if chain:
        yield chain


def _small(text: str, start: int, end: int) -> bool:
    value = text[start:end].lstrip("0")
    return len(value) <= 3 and int(value or 0) <= 255


def _ips(text: str, runs: list[tuple[int, int]]) -> Iterator[Span]:
    for chain in _chains(runs, text, "."):
        for i in range(0, len(chain) - 3, 4):
            parts = chain[i : i + 4]
            if all(_small(text, a, b) for a, b in parts):
                yield "ip", parts[0][0], parts[-1][1]


def _cards(text: str, runs: list[tuple[int, int]]) -> Iterator[Span]:
    for chain in _chains(runs, text, " -"):
        count = sum(b - a for a, b in chain)
        if 14 <= count <= 19 and luhn("".join(text[a:b] for a, b in chain)):
            yield "card", chain[0][0], chain[-1][1]
        elif len(chain) > 1:
            for a, b in chain:
                if 14 <= b - a <= 19 and luhn(text[a:b]):
                    yield "account", a, b


def _phones(text: str, plus_signs: list[int]) -> Iterator[Span]:
    done = 0
    for plus in plus_signs:
        if plus < done or not (row := _PHONE.match(text, plus + 1)):
            continue
        end = row.end()
        while not "0" <= text[end - 1] <= "9":
            end -= 1
        if end < plus + 4:
            continue
        done = end
        if 10 <= sum("0" <= c <= "9" for c in text[plus:end]) <= 15:
            yield "phone", plus, end


def _iban_end(text: str, start: int) -> int:
    """Where a grouped IBAN ends, the longest row of groups that passes mod 97; ``start`` if none does."""
    row = _IBAN.match(text, start)
    groups = list(re.finditer("[A-Za-z0-9]+", row.group())) if row else []
    while groups:
        value = "".join(g.group() for g in groups)
        end = start + groups.pop().end()
        whole = not (text[end : end + 1].isascii() and text[end : end + 1].isalnum())
        if whole and 15 <= len(value) <= 34:
            if int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1:
                return end
    return start


def _accounts(text: str, cues: list[tuple[int, int]]) -> Iterator[Span]:
    done = rejected = 0
    for start, end in cues:
        if start < done or (start and text[start - 1].isalnum()):
            continue
        a = _LEAD.match(text, end).end()
        # the rest of a rejected identifier is rejected as well
        if a < rejected:
            continue
        # digits and IBANs may be grouped by spaces, anything else ends at the first space
        if (b := _iban_end(text, a)) == a:
            value = _GROUPS.match(text, a) or _WORD.match(text, a)
            if not value:
                continue
            b = value.end()
        if b - a >= 8 and sum("0" <= c <= "9" for c in text[a:b]) >= 4:
            done = b
            yield "account", a, b
        else:
            rejected = b


def _logins(text: str, ends: list[int]) -> Iterator[Span]:
    for end in ends:
        scheme = _SCHEME.search(text, max(0, end - 35), end - 3)
        if scheme and (login := _LOGIN.match(text, end)):
            yield "login", scheme.start(), login.end()


def find_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, end exclusive, by start, then kind as in ``KINDS``."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c.lower() if c.isascii() else c for c in text)
    at_signs, plus_signs, schemes, cues, digits = [], [], [], [], -2
    runs: list[list[int]] = []
    for end, sign in _automaton().iter(lower):
        if sign == "@":
            at_signs.append(end)
        elif sign == "+":
            plus_signs.append(end)
        elif sign == "://":
            schemes.append(end + 1)
        elif len(sign) == 1:
            if end == digits + 1:
                runs[-1][1] = end + 1
            else:
                runs.append([end, end + 1])
            digits = end
        else:
            cues.append((end + 1 - len(sign), end + 1))
    spans = list(_emails(text, at_signs)) if at_signs else []
    if runs:
        spans += _ips(text, runs)
        spans += _cards(text, runs)
    if plus_signs:
        spans += _phones(text, plus_signs)
    if cues:
        spans += _accounts(text, sorted(cues))
    if schemes:
        spans += _logins(text, schemes)
    if len(spans) > 1:
        spans = sorted(set(spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return spans


def mask(text: str) -> str:
    """The text with ``[KIND]`` in place of each stretch of overlapping spans (kind of its first)."""
    out, done = [], 0
    for kind, start, end in find_spans(text):
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def find(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, spans: array of (kind, start, end)) of documents (doc_id, text)."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            cells = [
                [{"kind": k, "start": a, "end": b} for k, a, b in find_spans(text.as_py() or "")]
                for text in chunk.column("text")
            ]
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), pa.array(cells, schema[1].type)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(found, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data masked in ``text``; ``n_chars`` of changed texts follows."""

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in text_chunks(batches):
            at = chunk.schema.get_field_index("text")
            cells = [None if (t := cell.as_py()) is None else mask(t) for cell in chunk.column(at)]
            yield chunk.set_column(at, chunk.schema.field(at), pa.array(cells, chunk.schema.field(at).type))

    out = docs.withColumn("__before", F.length("text")).mapInArrow(
        masked, docs.withColumn("__before", F.length("text")).schema
    )
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.length("text") != F.col("__before")
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
