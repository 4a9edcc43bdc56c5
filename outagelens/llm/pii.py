"""Personal data as format-preserving pseudonyms from a keyed Feistel permutation.

Numbers and dates are found by pattern and validated (Luhn, mod 97, calendar, octets, ...); a value is numbered
within its format, permuted by a Feistel network under the key (walking on until it lands inside the format), and
written back in the same shape. The permutation depends on kind and value only, so equal values stay linked across
documents and distinct ones stay distinct. Whole texts, row by row; there is no shuffle.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

ROUNDS = 8
KINDS = ("email", "secret", "iban", "card", "ssn", "ip", "phone", "date")


class Feistel:
    """Keyed permutations of range(n) for any n, one for each kind."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, kind: str, n: int, k: int, x: int, size: int) -> int:
        data = f"{kind}|{n}|{k}|{x}".encode()
        width = min(64, (size.bit_length() + 7) // 8 + 8)
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=width).digest(), "big") % size

    def permute(self, kind: str, x: int, n: int) -> int:
        if n < 2:
            return x
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            left, right = divmod(x, b)
            for k in range(0, ROUNDS, 2):
                left = (left + self._round(kind, n, k, right, a)) % a
                right = (right + self._round(kind, n, k + 1, left, b)) % b
            x = left * b + right
            if x < n:  # else outside the format: walk on
                return x


def luhn(digits: str) -> int:
    """The check digit that goes behind ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _shaped(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _card(f: Feistel, m: re.Match) -> str | None:
    d = _digits(m[0])
    if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    body = str(f.permute("card", int(d[:-1]), 10 ** (len(d) - 1))).zfill(len(d) - 1)
    return _shaped(m[0], body + str(luhn(body)))


def _ssn(f: Feistel, m: re.Match) -> str | None:
    area, group, serial = int(m[1]), int(m[2]), int(m[3])
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    at = area - 1 - (area > 666)
    x = f.permute("ssn", (at * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999)
    x, serial = divmod(x, 9999)
    at, group = divmod(x, 99)
    return f"{at + 1 + (at >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(f: Feistel, m: re.Match) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if any(x > 255 for x in parts) or any(len(x) > 1 and x[0] == "0" for x in m[0].split(".")):
        return None
    x = f.permute("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _phone(f: Feistel, m: re.Match) -> str | None:
    d = _digits(m["rest"])
    if not 7 <= len(d) <= 12:
        return None
    return m["code"] + _shaped(m["rest"], str(f.permute("phone", int(d), 10 ** len(d))).zfill(len(d)))


_FIRST, _LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def _date(f: Feistel, m: re.Match) -> str | None:
    """Year first, or day and month in either order (day first where both fit), from 1900 to 2099."""
    a, sep, b, c = m.groups()
    forms = [("ymd", a, b, c)] if len(a) == 4 else [("dmy", c, b, a), ("mdy", c, a, b)]
    for form, y, mo, d in forms:
        try:
            day = dt.date(int(y), int(mo), int(d)).toordinal()
        except ValueError:
            continue
        if not _FIRST <= day <= _LAST:
            return None
        new = dt.date.fromordinal(_FIRST + f.permute("date", day - _FIRST, _LAST - _FIRST + 1))
        parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return sep.join(parts[k] for k in form)
    return None


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban(f: Feistel, m: re.Match) -> str | None:
    groups = m[0].split(" ")
    for k in range(len(groups), 0, -1):  # words in capitals may follow
        shape = " ".join(groups[:k])
        flat = shape.replace(" ", "")
        country, check, body = flat[:2], flat[2:4], flat[4:]
        if 11 <= len(body) <= 30 and _iban_check(country, body) == int(check):
            new = permute_text(f, "iban", body)
            letters = iter(f"{country}{_iban_check(country, new):02d}{new}")
            return "".join(c if c == " " else next(letters) for c in shape) + m[0][len(shape):]
    return None


#: Alphabets within which a character stays.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
_PLACE = {c: (alphabet, i) for alphabet in ALPHABETS for i, c in enumerate(alphabet)}
_HEX = {True: "0123456789abcdef", False: "0123456789ABCDEF"}


#: Characters that are permuted together; longer values are permuted block by block.
BLOCK = 64


def permute_text(f: Feistel, kind: str, text: str) -> str:
    """Each letter or digit stays in its alphabet, other characters stay; long hexadecimal strings stay hexadecimal.

    Beyond ``BLOCK`` characters each block is permuted under the digest of all before it: values that agree up to a block
    and differ there get different blocks there, so distinct values stay distinct, and the work is linear.
    """
    hexadecimal = next((h for h in _HEX.values() if len(text) >= 16 and set(text) <= set(h)), None)
    if len(text) <= BLOCK:
        return _permute_block(f, kind, text, hexadecimal)
    before, out = hashlib.blake2b(digest_size=16), []
    for at in range(0, len(text), BLOCK):
        block = text[at : at + BLOCK]
        out.append(_permute_block(f, f"{kind}:{before.hexdigest()}", block, hexadecimal))
        before.update(block.encode())
    return "".join(out)


def _permute_block(f: Feistel, kind: str, text: str, hexadecimal: str | None) -> str:
    places = [(hexadecimal, hexadecimal.index(c)) if hexadecimal else _PLACE.get(c) for c in text]
    x, n = 0, 1
    for p in places:
        if p:
            x, n = x * len(p[0]) + p[1], n * len(p[0])
    shape = "".join(str(ALPHABETS.index(p[0])) if p and not hexadecimal else "h" if p else c for p, c in zip(places, text))
    x = f.permute(f"{kind}:{shape}", x, n)
    out = []
    for p, c in zip(reversed(places), reversed(text)):
        if p:
            x, i = divmod(x, len(p[0]))
            c = p[0][i]
        out.append(c)
    return "".join(reversed(out))


_DOMAIN = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")


class _Email:
    """What a match is to the other kinds: its span, and the parts before and after the @."""

    def __init__(self, text: str, start: int, at: int, end: int):
        self._span, self._parts = (start, end), (text[start:end], text[start:at], text[at + 1 : end])

    def span(self) -> tuple[int, int]:
        return self._span

    def __getitem__(self, k: int) -> str:
        return self._parts[k]


def _emails(text: str) -> Iterator[_Email]:
    """From each @ that a domain follows, back over the characters of a name to the first letter or digit among them.

    Each character is passed once: a name cannot reach beyond the @ or the address before it.
    """
    low, at = 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            start, begin = at, None
            while start > low and (text[start - 1].isalnum() or text[start - 1] in "_.+%-"):
                start -= 1
                if text[start].isalnum():
                    begin = start
            if begin is not None:
                yield _Email(text, begin, at, domain.end())
                low = domain.end()
                at = text.find("@", low)
                continue
        low = at + 1
        at = text.find("@", low)


def _email(f: Feistel, m: _Email) -> str | None:
    return permute_text(f, "email", m[1]) + "@" + m[2]


def _secret(f: Feistel, m: re.Match) -> str | None:
    return m[1] + permute_text(f, "secret", m[2])


#: Kind, what a text must hold for it to be searched, the search and the pseudonym (null: not valid, stays).
FINDERS: tuple[tuple[str, str, Callable, Callable], ...] = (
    ("email", "@", _emails, _email),
    ("secret", "=:", re.compile(r"(?i)(\b(?:token|secret|password|passwd|api[_-]?key)\s*[=:]\s*[\"']?)([A-Za-z0-9+/_-]{12,})").finditer, _secret),
    ("iban", "0123456789", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b").finditer, _iban),
    ("card", "0123456789", re.compile(r"(?<!\w)(?:\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{4,5}|\d{13,19})(?!\w)").finditer, _card),
    ("ssn", "-", re.compile(r"(?<![\w-])(\d{3})-(\d{2})-(\d{4})(?![\w-])").finditer, _ssn),
    ("ip", ".", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)").finditer, _ip),
    ("phone", "+(", re.compile(r"(?P<code>\+\d{1,3}[ .-]?|(?<![\w+])(?=\(\d{3}\)))(?P<rest>\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\w)|\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\w))").finditer, _phone),
    ("date", "-/.", re.compile(r"(?<![\w/.-])(\d{4}|\d{2})([-/.])(\d{2})\2(\d{4}|\d{2})(?![\w/-])").finditer, _date),
)


def pseudonymise(f: Feistel, text: str) -> tuple[str, Counter]:
    """The text with its values replaced, and how many of each kind. A replaced stretch is not looked at again."""
    spans: list[tuple[int, int, str]] = []
    found: Counter = Counter()
    taken = bytearray(len(text))
    for kind, need, search, make in FINDERS:
        if not any(c in text for c in need):
            continue
        for m in search(text):
            start, end = m.span()
            if taken.find(1, start, end) >= 0:
                continue
            if kind == "date" and len(m[1]) == len(m[4]):
                continue
            new = make(f, m)
            if new is not None:
                spans.append((start, end, new))
                taken[start:end] = b"\1" * (end - start)
                found[kind] += 1
    out, at = [], 0
    for start, end, new in sorted(spans):
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]]), found


def pseudonyms(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, text (pseudonymised; null stays null), n_found, and n_<kind> for each kind.

    The same key gives the same pseudonyms in every run and document. Repeated rows are treated row by row; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(secret)
        for batch in batches:
            done = [(t, Counter()) if t is None else pseudonymise(f, t) for t in batch.column("text").to_pylist()]
            counts = [pa.array([c[k] for _, c in done], pa.int64()) for k in KINDS]
            total = pa.array([sum(c.values()) for _, c in done], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t for t, _ in done], pa.string()), total, *counts],
                                             ["doc_id", "text", "n_found", *(f"n_{k}" for k in KINDS)])

    kinds = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string, n_found long, {kinds}")
