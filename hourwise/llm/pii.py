"""Personal data by anchor expansion.

One Aho-Corasick automaton over the lower-cased text finds anchors: ``@``, ``+``, ``://``, the ten digits and cue words
of identifiers.  Each anchor hands its place to a local parser that expands to both sides and validates:

* ``email``: local part to the left of an ``@``, dotted labels to its right;
* ``ip``: four dotted numbers up to 255; ``card``: 16 to 19 digits that pass Luhn; ``phone``: after a ``+``, 8 to 15 digits;
* added by the method: ``url`` (user:password@ between a scheme and the host) and ``account`` (the value behind a cue such
  as ``password=``, and access key ids).

The first four are exactly the leftmost non-overlapping matches of the base patterns, per kind; matches that fail the
validation are dropped without another try.  Offsets are code points, ends exclusive.

Edge cases: null and empty texts have no spans; repeated rows get the same result each; texts of any length are parsed
whole, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re
import string

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hourwise.llm.common import parts

KINDS = ("email", "ip", "card", "phone")
ADDED = ("url", "account")
#: Cue words in lower case.
CUES = ("password", "passwd", "token", "api_key", "apikey", "secret", "akia")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_LABEL = frozenset(string.ascii_letters + string.digits + "-")
_DIGIT = frozenset(string.digits)
_PHONE = frozenset(string.digits + " ().-")
_VALUE = re.compile(r"""[ \t]*[:=][ \t]*(["']?)([^\s"',;<>]{6,})""")
_AKIA = re.compile(r"AKIA[A-Z0-9]{16}(?![A-Za-z0-9])")
_USERINFO = re.compile(r"[^\s/?#@:<>\"']+:[^\s/?#@<>\"']+(?=@)")


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in ("@", "+", "://", *string.digits, *CUES):
        a.add_word(w, w)
    a.make_automaton()
    return a


def _run(text: str, at: int, chars: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    end = _run(text, at + 1, _LABEL)
    if start == at or end == at + 1:
        return None
    dots = 0
    while end < len(text) and text[end] == ".":
        more = _run(text, end + 1, _LABEL)
        if more == end + 1:
            break
        end, dots = more, dots + 1
    return (start, end) if dots else None


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    for d in digits[-2::-2]:
        x = 2 * int(d)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _small(part: str) -> bool:
    p = part.lstrip("0")
    return len(p) <= 3 and int(p or "0") <= 255


def _digits(text: str, at: int, ip_from: int, card_from: int):
    """The dotted chain and the spaced chain of digit groups that begin at ``at``: (ips, end), (card, end).

    A chain is skipped when ``at`` lies before where that kind's last one ended."""
    ips, card = [], None
    end = _run(text, at, _DIGIT)
    if at >= ip_from:
        groups, stop = [(at, end)], end
        while stop + 1 < len(text) and text[stop] == "." and text[stop + 1] in _DIGIT:
            nxt = _run(text, stop + 1, _DIGIT)
            groups.append((stop + 1, nxt))
            stop = nxt
        for i in range(0, len(groups) - 3, 4):
            four = groups[i : i + 4]
            if all(_small(text[a:b]) for a, b in four):
                ips.append((four[0][0], four[3][1]))
        ip_from = stop
    if at >= card_from:
        stop, found = end, [text[at:end]]
        while stop + 1 < len(text) and text[stop] in " -" and text[stop + 1] in _DIGIT:
            nxt = _run(text, stop + 1, _DIGIT)
            found.append(text[stop + 1 : nxt])
            stop = nxt
        number = "".join(found)
        if 16 <= len(number) <= 19 and _luhn(number):
            card = (at, stop)
        card_from = stop
    return ips, card, ip_from, card_from


def find(text: str | None, machine) -> dict[str, list[tuple[int, int]]]:
    """Spans of every kind, in order."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in (*KINDS, *ADDED)}
    if not text:
        return out
    low = text if text.islower() else re.sub("[A-Z]", lambda m: m[0].lower(), text)
    email_from = digit_from = ip_from = card_from = phone_from = account_from = 0
    for last, word in machine.iter(low):
        if word == "@":
            if span := _email(text, last, email_from):
                out["email"].append(span)
                email_from = span[1]
        elif word == "+":
            if last >= phone_from and last + 1 < len(text) and text[last + 1] in _DIGIT:
                end = _run(text, last + 2, _PHONE)
                while end > last + 2 and text[end - 1] not in _DIGIT:
                    end -= 1
                if end > last + 3:  # a character between the first and the last digit, at least
                    phone_from = end
                    if 8 <= sum(c in _DIGIT for c in text[last:end]) <= 15:
                        out["phone"].append((last, end))
        elif word == "://":
            if m := _USERINFO.match(text, last + 1):
                out["url"].append(m.span())
        elif len(word) == 1:
            if last >= digit_from:
                ips, card, ip_from, card_from = _digits(text, last, ip_from, card_from)
                out["ip"] += ips
                if card:
                    out["card"].append(card)
                digit_from = _run(text, last, _DIGIT)
        elif last >= account_from:
            if word == "akia":
                span = (m := _AKIA.match(text, last - 3)) and m.span()
            else:
                span = (m := _VALUE.match(text, last + 1)) and m.span(2)
            if span:
                out["account"].append(span)
                account_from = span[1]
    return out


def _spell(found: dict, kinds) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def _scan(batches):
    machine = automaton()
    for b in parts(batches):
        found = [find(t, machine) for t in b.column("text").to_pylist()]
        base = [hashlib.sha256(_spell(f, KINDS).encode()).hexdigest() for f in found]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), *[pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS], pa.array(base, pa.string()),
             pa.array([_spell(f, (*KINDS, *ADDED)) for f in found], pa.string())],
            ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
        )


def redact(text: str, found: dict) -> str:
    """``text`` with every span replaced by ``<KIND>``; where spans overlap, the one that begins first stands for both."""
    out, at = [], 0
    for a, b, k in sorted((a, -b, k) for k, spans in found.items() for a, b in spans):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (``kind:start:end``, joined)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def redacted(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with the spans of ``column`` replaced, all columns kept; null stays null."""
    names = docs.columns

    def run(batches):
        machine = automaton()
        for b in parts(batches, column):
            at = b.schema.get_field_index(column)
            texts = [t if t is None else redact(t, find(t, machine)) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    assert column in names
    return docs.mapInArrow(run, docs.schema)
