"""Format-preserving pseudonyms for personal data.

Values are found in the whole text and validated: payment card numbers by their check digit, IBANs by theirs, IPv4
addresses and dates by range, US social security numbers by their blocked areas, phone numbers by a country code, e-mail
addresses by their shape, and keys after words such as ``token =``. The characters of a valid value are read as a number
in a mixed-radix system that its format fixes, and that number is permuted by a keyed Feistel network over exactly that
range. Equal values so get equal pseudonyms in every document, different values different ones, and the owner of the key
can invert them. Conjugating a step of one by the network makes the permutation free of fixed points, so no value stays.

Digits of any script count; a pseudonym is written in the script of its value. Dates are read day first, and month first
where only that is a date; the two kinds are permuted among themselves. Keys and local parts of any length are replaced
whole, in blocks of BLOCK characters.

Letters of any script are permuted within their block and category. A value without a letter or digit to permute stays, and
is not counted. Keys of more than 64 bytes are hashed to 64.

Numbers that do not validate are left alone. Defined cases: null stays null and empty stays empty; rows of equal id are
treated each; every place and every length that a format admits is tried, and of valid values that overlap those are
replaced that together replace most characters, then the first, the longest and the kind in the order of KINDS. A phone
number does not end inside a valid IPv4 address. A key has no default but in the registered query.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as X
from .common import documents

KINDS = ("email", "iban", "card", "ssn", "date", "ip", "phone", "secret")
ROUNDS = 8
#: The key of the registered query, which is public; a production run passes its own.
QUERY_KEY = b"a key for tests; a production run passes its own"
#: Characters that are permuted together: the range of more would be too wide for a hash.
BLOCK = 32


class Permutation:
    """Keyed permutation of range(n) by an unbalanced Feistel network on a grid that covers it, walked until inside."""

    def __init__(self, n: int, key: bytes, tweak: str):
        self.n, self.key, self.tweak = n, key if len(key) <= 64 else hashlib.blake2b(key).digest(), tweak.encode()
        self.a = max(1, math.isqrt(n - 1) + 1)
        self.b = -(-n // self.a)

    def _f(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d:%d:%d:%s" % (self.n, i, x, self.tweak), key=self.key, digest_size=max(16, self.n.bit_length() // 8 + 9)).digest(), "big")

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(0, ROUNDS, 2):
            left = (left + self._f(i, right)) % self.a
            right = (right + self._f(i + 1, left)) % self.b
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS - 2, -1, -2):
            right = (right - self._f(i + 1, left)) % self.b
            left = (left - self._f(i, right)) % self.a
        return left * self.b + right

    def _inside(self, step, x: int) -> int:
        x = step(x)
        while x >= self.n:
            x = step(x)
        return x

    def forward(self, x: int) -> int:
        return self._inside(self._back, (self._inside(self._once, x) + 1) % self.n)

    def inverse(self, x: int) -> int:
        return self._inside(self._back, (self._inside(self._once, x) - 1) % self.n)


_ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŒ"]
_RADIX = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}
_HEX = ["0123456789abcdef", "0123456789ABCDEF"]


@lru_cache(maxsize=1 << 16)
def _radix(c: str) -> tuple[str, int] | None:
    """The alphabet of a character and its place in it. Letters, marks and numbers of other scripts have for an alphabet
    those of their own 256 code points that are of their category; what has none stays in place."""
    if c in _RADIX:
        return _RADIX[c]
    kind = unicodedata.category(c)
    if c.isascii() or kind[0] not in "LMN":
        return None
    low = ord(c) & ~0xFF
    same = "".join(x for x in map(chr, range(low, low + 256)) if x not in _RADIX and unicodedata.category(x) == kind)
    return (same, same.index(c)) if len(same) > 1 else None


def _permute(chars: str, key: bytes, tweak: str, back: bool, alphabet: str | None = None) -> str:
    """Permute the characters that have an alphabet, block by block; the others stay in place."""
    if len(chars) > BLOCK:
        return "".join(_permute(chars[i : i + BLOCK], key, f"{tweak}:{len(chars)}:{i}", back, alphabet) for i in range(0, len(chars), BLOCK))
    of = (lambda c: (alphabet, alphabet.index(c)) if c in alphabet else None) if alphabet else _radix
    spots = [(i, r) for i, c in enumerate(chars) if (r := of(c))]
    n = math.prod(len(a) for _, (a, _) in spots)
    if n < 2:
        return chars
    x = 0
    for _, (a, v) in spots:
        x = x * len(a) + v
    p = Permutation(n, key, tweak)
    x = p.inverse(x) if back else p.forward(x)
    out = list(chars)
    for i, (a, _) in reversed(spots):
        x, v = divmod(x, len(a))
        out[i] = a[v]
    return "".join(out)


def _refill(value: str, chars: str) -> str:
    """Put the letters and digits of chars in the places of those of value."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in value)


def luhn(digits: str) -> int:
    """The sum whose remainder by 10 is 0 for a valid number."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)


def _iban_rest(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def _days() -> int:
    return (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def _code(phone: str) -> str:
    return re.match(r"\+\d{1,3}(?=[ .(-])|\+\d|", phone).group()


_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()


def _date(value: str) -> tuple[datetime.date, bool]:
    """The date, and whether it can only be one with the month first."""
    a, b, c = (int(x) for x in re.split(r"[-/.]", value))
    if value[:4].isdigit():
        return datetime.date(a, b, c), False
    try:
        return datetime.date(c, b, a), False
    except ValueError:
        return datetime.date(c, a, b), True


@lru_cache(maxsize=1)
def _late_days() -> list[int]:
    """Days above the twelfth of a month, from the first day on: those that are read with the month first."""
    return [i for i in range(_days()) if datetime.date.fromordinal(_FIRST_DAY + i).day > 12]


def valid(kind: str, value: str) -> bool:
    """Whether a value of a format is one: by check digit, range or length."""
    chars = "".join(c for c in value if c.isalnum())
    if kind == "ip":
        return all(int(p) <= 255 and (len(p) == 1 or p[0] != "0") for p in value.split("."))
    if kind == "date":
        try:
            return 0 <= _date(value)[0].toordinal() - _FIRST_DAY < _days()
        except ValueError:
            return False
    if kind == "card":
        return 13 <= len(chars) <= 19 and luhn(chars) % 10 == 0 and len(set(chars)) > 1
    if kind == "iban":
        return 15 <= len(chars) <= 34 and _iban_rest(chars) == 1
    if kind == "ssn":
        return 0 < int(chars[:3]) < 900 and int(chars[:3]) != 666 and int(chars[3:5]) > 0 and int(chars[5:]) > 0
    return kind != "phone" or 7 <= sum(c.isdigit() for c in value[len(_code(value)) :]) <= 14


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value, or with ``back`` the value of a pseudonym; None where the value is not valid."""
    if not valid(kind, value):
        return None
    if kind == "email":
        local, _, domain = value.partition("@")
        return f"{_permute(local, key, kind, back)}@{domain}"
    if kind == "secret":
        for alphabet in _HEX:
            if all(c in alphabet for c in value):
                return _permute(value, key, kind, back, alphabet)
        return _permute(value, key, kind, back)
    if kind == "ip":
        p, x = Permutation(1 << 32, key, kind), int.from_bytes(bytes(map(int, value.split("."))), "big")
        return ".".join(map(str, (p.inverse(x) if back else p.forward(x)).to_bytes(4, "big")))
    if kind == "date":
        day, month_first = _date(value)
        x = day.toordinal() - _FIRST_DAY
        if month_first:
            late = _late_days()
            p, x = Permutation(len(late), key, "late " + kind), bisect_left(late, x)
            new = datetime.date.fromordinal(_FIRST_DAY + late[p.inverse(x) if back else p.forward(x)])
            return value[2].join([f"{new.month:02}", f"{new.day:02}", f"{new.year:04}"])
        p = Permutation(_days(), key, kind)
        new = datetime.date.fromordinal(_FIRST_DAY + (p.inverse(x) if back else p.forward(x)))
        made = [f"{new.year:04}", f"{new.month:02}", f"{new.day:02}"]
        return value[4].join(made) if value[:4].isdigit() else value[2].join(reversed(made))
    chars = "".join(c for c in value if c.isalnum())
    if kind == "card":
        body = _permute(chars[:-1], key, kind, back)
        return _refill(value, body + str(-luhn(body + "0") % 10))
    if kind == "iban":
        body = _permute(chars[4:], key, kind + chars[:2], back)
        return _refill(value, f"{chars[:2]}{98 - _iban_rest(chars[:2] + '00' + body):02}{body}")
    if kind == "ssn":
        area, group, serial = int(chars[:3]), int(chars[3:5]), int(chars[5:])
        areas = [a for a in range(1, 900) if a != 666]
        p, x = Permutation(len(areas) * 99 * 9999, key, kind), (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
        x = p.inverse(x) if back else p.forward(x)
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        return f"{areas[area]:03}-{group + 1:02}-{serial + 1:04}"
    if kind == "phone":
        code = _code(value)
        rest = value[len(code) :]
        digits = "".join(c for c in rest if c.isdigit())
        return code + _refill(rest, _permute(digits, key, kind, back))
    raise ValueError(kind)


#: All repeats are bounded, so a text costs time in proportion to its length.
_FORMS = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
    "card": r"(?<![\d+.])\d(?:[ -]?\d){12,18}(?![\d])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<!\d)(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?!\d)",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "phone": r"(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d))",
}
_FORM = {kind: re.compile(form) for kind, form in _FORMS.items()}
#: Where any of them begins. The date comes first, as its groups are numbered.
_PLACE = re.compile("(?=" + "|".join([_FORMS["date"], *[form for kind, form in _FORMS.items() if kind != "date"]]) + ")")
#: Formats of several lengths: the shortest, the longest, and what may not follow the end.
_LENGTHS = {"iban": (12, 44, re.compile(r"[A-Za-z0-9]")), "card": (13, 37, re.compile(r"\d")), "phone": (6, 31, re.compile(r"\d"))}
_AFTER = re.compile(r"(?i)(?<![a-z])(?:token|secret|passwd|password|api[_ -]?key|access[_ -]?key|auth)\s{0,4}[=:]\s{0,4}[\"']?([A-Za-z0-9+/_.~-]{12,}+)")
_TRIGGERS = ("token", "secret", "passw", "key", "auth")
_LOCAL = re.compile(r"[\w.+%-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}")


def _at(text: str, start: int) -> Iterator[tuple[int, int, str]]:
    """Start, end and kind of all that the formats admit at a place, each length of them."""
    for kind, form in _FORM.items():
        m = form.match(text, start)
        if m and kind in _LENGTHS:
            least, most, more = _LENGTHS[kind]
            for end in range(min(len(text), start + most), start + least - 1, -1):
                if not more.match(text, end) and form.fullmatch(text, start, end):
                    yield start, end, kind
        elif m:
            yield start, m.end(), kind


def find(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of the valid values, first the earlier, then the longer; they may overlap."""
    found = []
    at = text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain and domain.group().rpartition(".")[2].isalpha():
            start = at
            while start and _LOCAL.match(text[start - 1]):
                start -= 1
            start = at - len(text[start:at].lstrip(".+%-"))
            if start < at:
                found.append((start, domain.end(), "email"))
        at = text.find("@", at + 1)
    low = text.lower() if "=" in text or ":" in text else ""
    if any(w in low for w in _TRIGGERS):
        found += [(m.start(1), m.end(1), "secret") for m in _AFTER.finditer(text)]
    found += [f for m in _PLACE.finditer(text) for f in _at(text, m.start()) if valid(f[2], text[f[0] : f[1]])]
    quads = sorted(f[:2] for f in found if f[2] == "ip")

    def cuts(end: int) -> bool:
        i = bisect_left(quads, (end,)) - 1
        return i >= 0 and quads[i][0] < end < quads[i][1]

    found = [f for f in found if f[2] != "phone" or not cuts(f[1])] if quads else found
    found.sort(key=lambda f: (f[0], -f[1], KINDS.index(f[2])))
    return found


def choose(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Of sorted values those that do not overlap and replace most characters; of an e-mail address the local part is."""
    if all(a[1] <= b[0] for a, b in pairwise(found)):
        return found
    starts, best = [f[0] for f in found], [0] * (len(found) + 1)
    after = [bisect_left(starts, f[1]) for f in found]
    size = [(text.index("@", a) if kind == "email" else b) - a for a, b, kind in found]
    for i in range(len(found) - 1, -1, -1):
        best[i] = max(best[i + 1], size[i] + best[after[i]])
    chosen, i = [], 0
    while i < len(found):
        take = best[i] > best[i + 1] or best[i] == size[i] + best[after[i]]
        if take:
            chosen.append(found[i])
        i = after[i] if take else i + 1
    return chosen


_DIGIT, _OTHER_DIGIT = re.compile(r"\d"), re.compile(r"(?![0-9])\d")


def _zero(c: str) -> int:
    """The zero of the script of a digit: the ten of a script follow each other."""
    return ord(c) - unicodedata.decimal(c)


def _written_as(new: str, old: str) -> str:
    """A new value in the digits of the old one's scripts, place by place; in those of its first where lengths differ."""
    if old.isascii():
        return new
    if len(new) == len(old):
        return "".join(chr(_zero(o) + int(c)) if c.isdecimal() and o.isdecimal() else c for c, o in zip(new, old, strict=True))
    first = _OTHER_DIGIT.search(old)
    return "".join(chr(_zero(first.group()) + int(c)) if c.isdecimal() else c for c in new) if first else new


def hide(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind there were."""
    counts = dict.fromkeys(KINDS, 0)
    if not text or not ("@" in text or _DIGIT.search(text) or "=" in text or ":" in text):
        return text, counts
    plain = _OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m.group())), text)
    out, upto = [], 0
    for a, b, kind in choose(plain, find(plain)):
        new = _written_as(pseudonym(kind, plain[a:b], key, back), text[a:b])
        out += [text[upto:a], new]
        upto = b
        counts[kind] += new != text[a:b]
    out.append(text[upto:])
    return "".join(out), counts


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, n_values and one count for each kind."""
    names = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in X.blocks(batches):
            got = [hide(t, key) for t in block.column("text").to_pylist()]
            counts = [pa.array([c[k] for _, c in got], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([t for t, _ in got], pa.string()), pa.array([sum(c.values()) for _, c in got], pa.int64()), *counts], names=["doc_id", "text", "n_values", *names])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, text string, n_values bigint, " + ", ".join(f"{n} bigint" for n in names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(documents(spark, sf_dir), QUERY_KEY)
