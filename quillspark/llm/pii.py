"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, URL schemes and
identifier cues. Local parsers go left and right from an anchor only as far as the kind's grammar
lets them and validate what they get (octets, Luhn, digit counts, host labels). Matches of one kind
don't overlap and the leftmost wins, so base spans equal those of the four base patterns. On top
come, whatever the case of scheme or cue, `url` (scheme://host...), `secret` values after a cue (token,
password, api key) and `account` values after one: an IBAN of 15 to 34 signs whose checksum holds, a
social security number that can be one, and account or passport numbers of 6 to 34 letters,
digits and hyphens, four digits at least, that end where the word ends.

Spans are in code points, end exclusive. Defined cases: a null text counts as empty and has no
span; equal texts have equal spans and repeated rows each keep their row; texts are read whole, in time
in proportion to their length; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "secret", "account")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
HOST = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-")
DIGIT = frozenset("0123456789")
PHONE = frozenset(" ().0123456789-")
SCHEMES = ("http://", "https://", "ftp://")
#: Words before a value that identify it.
CUES = {"secret": ("token", "password", "passwd", "api_key", "apikey", "api key", "secret", "access_key"), "account": ("iban", "account", "ssn", "passport")}
Span = tuple[int, int]


@lru_cache(maxsize=1)
def automaton():
    a = ahocorasick.Automaton()
    for c in "@+0123456789":
        a.add_word(c, (c if c in "@+" else "0", 1))
    for s in SCHEMES:
        a.add_word(s, ("url", len(s)))
    for kind, cues in CUES.items():
        for c in cues:
            a.add_word(c, (kind, len(c)))
    a.make_automaton()
    return a


def email(t: str, at: int, least: int) -> Span | None:
    """local@label(.label)+ around the at-sign; the local part starts no earlier than `least`."""
    s = at
    while s > least and t[s - 1] in LOCAL:
        s -= 1
    e, n, dots = at + 1, len(t), 0
    while e < n and t[e] in HOST:
        e += 1
    if s == at or e == at + 1:
        return None
    while e + 1 < n and t[e] == "." and t[e + 1] in HOST:
        e, dots = e + 2, dots + 1
        while e < n and t[e] in HOST:
            e += 1
    return (s, e) if dots else None


def digits_to(t: str, s: int) -> int:
    n = len(t)
    while s < n and t[s] in DIGIT:
        s += 1
    return s


def address(t: str, s: int) -> tuple[Span | None, int]:
    """Four dotted numbers from the start of a digit run: the span, or None if it isn't valid, and
    where to look on."""
    e = digits_to(t, s)
    first, parts = e, [t[s:e]]
    for _ in range(3):
        if e + 1 < len(t) and t[e] == "." and t[e + 1] in DIGIT:
            f = digits_to(t, e + 1)
            parts.append(t[e + 1 : f])
            e = f
        else:
            return None, first
    return ((s, e) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts) else None), e


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def card(t: str, s: int) -> tuple[Span | None, int]:
    """Digits with single blanks or hyphens between, as far as they go."""
    e, n = s + 1, len(t)
    while e < n:
        if t[e] in DIGIT:
            e += 1
        elif t[e] in " -" and e + 1 < n and t[e + 1] in DIGIT:
            e += 2
        else:
            break
    d = t[s:e].replace(" ", "").replace("-", "")
    return ((s, e) if 16 <= len(d) <= 19 and luhn(d) else None), e


def phone(t: str, s: int) -> tuple[Span | None, int]:
    """+, a digit, then phone signs up to the last digit, with one sign between at least."""
    n = len(t)
    if s + 1 >= n or t[s + 1] not in DIGIT:
        return None, s + 1
    e = s + 2
    while e < n and t[e] in PHONE:
        e += 1
    while e > s + 2 and t[e - 1] not in DIGIT:
        e -= 1
    if e - (s + 2) < 2:
        return None, s + 1
    return ((s, e) if 8 <= sum(c in DIGIT for c in t[s:e]) <= 15 else None), e


#: After a cue; the runs of blanks give nothing back, so that long ones cost their length once.
GAP = re.compile(r"""["']?+[ \t]*+[:=#]?+[ \t]*+["']?+""")
SECRET = re.compile(r"[A-Za-z0-9][A-Za-z0-9_./+-]{6,}[A-Za-z0-9]")
NUMBER = re.compile(r"[A-Za-z0-9](?:-?[A-Za-z0-9]){5,33}(?![A-Za-z0-9])(?!-[A-Za-z0-9])")
SSN = re.compile(r"([0-9]{3})([- ]?)([0-9]{2})\2([0-9]{4})(?![A-Za-z0-9])")
IBAN = re.compile(r"[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}(?![A-Za-z0-9])")
URL = re.compile(r"[^\s\"'<>]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}


def iban(t: str, at: int) -> Span | None:
    """The longest run of blank-separated groups from here whose checksum modulo 97 is 1."""
    m = IBAN.match(t, at)
    if not m:
        return None
    end, groups = m.end(), m[0].split(" ")
    while groups:
        sign = "".join(groups).upper()
        if 15 <= len(sign) <= 34 and int("".join(str(int(c, 36)) for c in sign[4:] + sign[:4])) % 97 == 1:
            return at, end
        end -= len(groups.pop()) + 1
    return None


def account(t: str, cue: str, at: int) -> Span | None:
    if span := iban(t, at):
        return span
    if cue == "ssn":
        m = SSN.match(t, at)
        return m.span() if m and m[1] not in ("000", "666") and m[1] < "900" and m[3] != "00" and m[4] != "0000" else None
    m = None if cue == "iban" else NUMBER.match(t, at)
    return m.span() if m and sum(c in DIGIT for c in m[0]) >= 4 else None


def value(t: str, kind: str, s: int, e: int) -> Span | None:
    """The value after the cue word t[s:e]."""
    if s and (t[s - 1].isalnum()) or e < len(t) and t[e].isalnum():
        return None
    gap = GAP.match(t, e).end()
    if kind == "account":
        return account(t, t[s:e].lower(), gap)
    m = SECRET.match(t, gap)
    return m.span() if m and any(c in DIGIT for c in m[0]) and re.search("[:=]", t[e:gap]) else None


def folded(text: str) -> str:
    """text with letters A-Z, or more where that keeps all places, in lower case."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(A_TO_Z)


def find(text: str | None) -> dict[str, list[Span]]:
    """Spans by kind, in order."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not text:
        return out
    free = dict.fromkeys(KINDS, 0)  # where the next match of a kind may start
    for end, (what, size) in automaton().iter(folded(text)):
        s = end - size + 1
        if what == "0":
            if s >= free["ip"]:
                span, free["ip"] = address(text, s)
                if span:
                    out["ip"].append(span)
            if s >= free["card"]:
                span, free["card"] = card(text, s)
                if span:
                    out["card"].append(span)
        elif what == "@":
            span = email(text, s, free["email"])
            if span:
                out["email"].append(span)
                free["email"] = span[1]
        elif what == "+":
            if s >= free["phone"]:
                span, free["phone"] = phone(text, s)
                if span:
                    out["phone"].append(span)
        elif what == "url":
            if s >= free["url"] and (m := URL.match(text, end + 1)):
                out["url"].append((s, m.end()))
                free["url"] = m.end()
        elif s >= free[what] and (span := value(text, what, s, end + 1)):
            out[what].append(span)
            free[what] = span[1]
    return out


def listed(spans: dict[str, list[Span]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in spans[k])


def redact(text: str | None) -> str | None:
    """text with each span, joined where spans touch or overlap, replaced by its first kind in brackets."""
    if not text:
        return text
    found = sorted((s, -e, KINDS.index(k)) for k, x in find(text).items() for s, e in x)
    out, at = [], 0
    for s, e, k in found:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = max(at, -e)
    return "".join([*out, text[at:]]) if found else text


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row of docs."""

    def run(batches):
        for b in batches:
            found = [find(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE), pa.array([hashlib.sha256(listed(f, BASE).encode()).hexdigest() for f in found], pa.string()), pa.array([listed(f, KINDS) for f in found], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with redacted texts; n_chars, where docs has it, counts the new text."""

    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([redact(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out
