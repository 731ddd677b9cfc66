"""PII pseudonyms by keyed Feistel permutations within each value's format.

Numbers and dates that pass their kind's check are mapped by a keyed bijection of
the kind's domain onto itself: cards keep Luhn's check, IBANs their check digits,
dates stay dates, addresses stay addresses, separators and letter case stay as they
are. The map depends on the key, the kind and the value alone, so equal values
keep one pseudonym across documents, whatever their separators and, for dates, the order
of day, month and year (unpadded parts come back with two digits). Dates are permuted among those
with a day up to 12 or among the others, so no order of theirs becomes readable in another way.

Defined cases: null text stays null; empty text and text without PII stay as they
are; values that fail their check stay; of overlapping finds the first kind of KINDS
holds; cards are runs of 13 to 19 digits, or groups of 4 or of 4, 6 and 5; phones have a
plus sign, an area code in brackets, a trunk zero with pairs of digits, or the groups and first digits of the North American plan (223-456-7890);
version numbers of four parts (10.0.0.1) pass as addresses; texts of any length are handled whole; rows and ids may repeat; an empty
table gives no rows; other columns are ignored. Left as they are, for want of a check: runs of
digits without separators that are no card (phones, social security numbers), years outside 1000
to 2999, names of months, IPv6 and street addresses.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator
from math import isqrt

from pyspark.sql import DataFrame


ROUNDS, CACHED = 10, 200_000
_ORDINAL = lambda year: dt.date(year, 1, 1).toordinal()
#: Dates of these years are permuted among themselves, the others of LEAST_YEAR to MOST_YEAR - 1 likewise.
NEAR_YEARS, LEAST_YEAR, MOST_YEAR = (1900, 2200), 1000, 3000


def permute(value: int, domain: int, key: bytes, tweak: str, holds: Callable[[int], bool] = lambda _: True) -> int:
    """A keyed bijection of range(domain), or of those of its values for which holds() is true; value must be one."""
    a = isqrt(max(domain, 1) - 1) + 1 if domain > 1 else 1
    while True:
        left, right = divmod(value, a)
        for i in range(ROUNDS):
            half = left if i % 2 else right
            digest = hashlib.blake2b(f"{tweak}|{domain}|{i}|{half}".encode(), key=key, digest_size=16).digest()
            if i % 2:
                right = (right + int.from_bytes(digest, "big")) % a
            else:
                left = (left + int.from_bytes(digest, "big")) % a
        value = left * a + right
        if value < domain and holds(value):
            return value


def luhn(digits: str) -> int:
    """The check digit that follows digits."""
    return -sum(d if i % 2 else d // 5 + d % 5 * 2 for i, d in enumerate(map(int, reversed(digits)))) % 10


def _fill(shape: str, digits: str) -> str:
    """shape with its ASCII digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if "0" <= c <= "9" else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def card(text: str, key: bytes) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
        return None
    n = len(digits) - 1
    body = f"{permute(int(digits[:-1]), 10**n, key, f'card{n}', lambda v: len(set(d := f'{v:0{n}d}') | {str(luhn(d))}) > 1):0{n}d}"
    return _fill(text, body + str(luhn(body)))


def phone(text: str, key: bytes) -> str | None:
    digits = _digits(text)
    code = re.match(r"\+([0-9]{1,3})(?![0-9])", text)
    keep = len(code[1]) if code else 0
    n = len(digits) - keep
    if not 7 <= n <= 15 or not 9 <= len(digits) <= 15:
        return None
    first = lambda v: f"{v:0{n}d}"[0] > "1"
    value = int(digits[keep:])
    return _fill(text, digits[:keep] + f"{permute(value, 10**n, key, f'phone{n}', first if first(value) else lambda v: not first(v)):0{n}d}")


def ssn(text: str, key: bytes) -> str | None:
    def real(v: int) -> bool:
        return v // 10**6 not in (0, 666) and v // 10**6 < 900 and v // 10**4 % 100 > 0 and v % 10**4 > 0

    value = int(_digits(text))
    return _fill(text, f"{permute(value, 10**9, key, 'ssn', real):09d}") if real(value) else None


def date(text: str, key: bytes) -> str | None:
    parts = [int(p) for p in re.split(r"[-/.]", text)]
    orders = [(0, 1, 2)] if len(re.split(r"[-/.]", text)[0]) == 4 else [(2, 1, 0), (2, 0, 1)]
    for y, m, d in orders:
        try:
            day = dt.date(parts[y], parts[m], parts[d])
        except ValueError:
            continue
        if not LEAST_YEAR <= day.year < MOST_YEAR:
            return None
        near = NEAR_YEARS[0] <= day.year < NEAR_YEARS[1]
        zero, end = (_ORDINAL(NEAR_YEARS[0]), _ORDINAL(NEAR_YEARS[1])) if near else (_ORDINAL(LEAST_YEAR), _ORDINAL(MOST_YEAR))

        def alike(v: int) -> bool:
            other = dt.date.fromordinal(zero + v)
            return (other.day <= 12) == (day.day <= 12) and (NEAR_YEARS[0] <= other.year < NEAR_YEARS[1]) == near

        new = dt.date.fromordinal(zero + permute(day.toordinal() - zero, end - zero, key, "date", alike))
        values = {y: f"{new.year:04d}", m: f"{new.month:02d}", d: f"{new.day:02d}"}
        seps = re.findall(r"[-/.]", text)
        return values[0] + seps[0] + values[1] + seps[1] + values[2]
    return None


def ip(text: str, key: bytes) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or not 1 <= parts[0] <= 223:
        return None
    value = int.from_bytes(bytes(parts), "big")
    new = permute(value, 1 << 32, key, "ip", lambda v: 1 <= v >> 24 <= 223)
    return ".".join(map(str, new.to_bytes(4, "big")))


def iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = plain[4:]
    digits = _digits(body)
    body = _fill(body, f"{permute(int(digits), 10 ** len(digits), key, f'iban{len(digits)}'):0{len(digits)}d}") if digits else body
    check = 98 - number(body + plain[:2] + "00") % 97
    new = iter(plain[:2] + f"{check:02d}" + body)
    return "".join(" " if c == " " else next(new) for c in text)


def email(text: str, key: bytes) -> str | None:
    local, _, domain = text.partition("@")
    value, size = 0, 1
    for c in local.lower():
        base = 26 if "a" <= c <= "z" else 10 if "0" <= c <= "9" else 1
        value, size = value * base + (ord(c) - ord("a" if base == 26 else "0") if base > 1 else 0), size * base
    shape = re.sub("[0-9]", "9", re.sub("[a-z]", "a", local.lower()))
    value, out = permute(value, size, key, f"email{shape}"), []
    for c in reversed(local):
        base = 26 if c.isascii() and c.isalpha() else 10 if "0" <= c <= "9" else 1
        value, d = divmod(value, base)
        new = chr(ord("a") + d) if base == 26 else str(d) if base == 10 else c
        out.append(new.upper() if c.isupper() else new)
    return "".join(reversed(out)) + "@" + domain


#: Kinds in order: pattern and map; a map gives None for a value that fails its check.
KINDS: list[tuple[str, re.Pattern, Callable[[str, bytes], str | None]]] = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}(?![A-Za-z0-9-])"), email),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), iban),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"), ip),
    ("date", re.compile(r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9A-SU-Za-z]|T(?![0-9])|[-/][0-9])"), date),
    ("ssn", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])"), ssn),
    ("card", re.compile(r"(?<![0-9A-Za-z+])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1(?:[0-9]{4}\1[0-9]{1,3}|[0-9]{1,4})|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9A-Za-z])"), card),
    ("phone", re.compile(r"(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?\([0-9]{1,4}\))?([ .-])[0-9]{1,4}(?:\1[0-9]{1,4}){1,5}(?![0-9A-Za-z]|\.[0-9])|(?<![0-9A-Za-z.,-])0[1-9](?:([ .-])[0-9]{2})(?:\2[0-9]{2}){3}(?![0-9A-Za-z]|[.,-][0-9])|(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\((?:0[0-9]{1,4}|[0-9]{2,3})\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z]|[.,-][0-9])|(?<![0-9A-Za-z.,+-])[2-9][0-9]{2}([.-])[2-9][0-9]{2}\3[0-9]{4}(?![0-9A-Za-z]|[.,-][0-9])|(?<![0-9A-Za-z])\+[0-9]{9,15}(?![0-9A-Za-z])"), phone),
]
_TOKEN = re.compile("[0-9A-Za-z]+")
_ANY = re.compile(r"[0-9@]")


class Pseudonyms:
    def __init__(self, key: bytes):
        self.key, self.known = key[:64], {}

    def _new(self, kind: str, change: Callable, text: str) -> str | None:
        if (kind, text) not in self.known:
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[kind, text] = change(text, self.key)
        return self.known[kind, text]

    def __call__(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with all finds replaced, and how many of each kind changed (an address whose local part has no letter or digit stays)."""
        count = dict.fromkeys((k[0] for k in KINDS), 0)
        if not _ANY.search(text):
            return text, count
        taken: list[tuple[int, int, str]] = []
        for kind, pattern, change in KINDS:
            if kind == "email" and "@" not in text:
                continue
            held = sorted(taken)
            k = at = 0
            while m := pattern.search(text, at):
                start, end = m.span()
                at = end
                while k < len(held) and held[k][1] <= start:
                    k += 1
                if k < len(held) and held[k][0] < end:
                    continue
                new = self._new(kind, change, m[0])
                if new is None and kind == "card" and (cut := max(m[0].rfind(" "), m[0].rfind("-"))) > 0 and (m := pattern.match(text, start, start + cut)):
                    end = at = m.end()
                    new = self._new(kind, change, m[0])
                if new is None:  # what fails its check uses up its first token only
                    first = _TOKEN.match(text, start)
                    at = first.end() if first else start + 1
                else:
                    taken.append((start, end, new))
                    count[kind] += new != m[0]
        out, at = [], 0
        for start, end, new in sorted(taken):
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]]), count


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with pseudonyms, and n_<kind> for each kind. No shuffle."""
    names = [k[0] for k in KINDS]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        change = Pseudonyms(key)
        for batch in batches:
            texts, counts = [], {k: [] for k in names}
            for value in batch.column(1):
                text = value.as_py()
                new, n = change(text or "")
                texts.append(None if text is None else new)
                for k in names:
                    counts[k].append(n[k])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *(pa.array(counts[k], pa.int64()) for k in names)], ["doc_id", "text", *(f"n_{k}" for k in names)])

    schema = "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in names)
    return docs.selectExpr("cast(doc_id as long) as doc_id", "cast(text as string) as text").mapInArrow(run, schema)
