"""Format-preserving pseudonyms for personal data.

Each kind has a pattern, a check that the match is a real value of its kind (Luhn sum, calendar, octets, IBAN modulus
and so on), and a bijection between its values and the numbers below some N. A keyed Feistel network permutes those
numbers, so a value becomes another valid one in the same format, equal values get equal pseudonyms in every document,
and whoever holds the key can invert them. Separators, letter case and layout stay.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ROUNDS = 8
#: Used where a caller brings no key of their own: good for tests, not for secrecy.
SAMPLE_KEY = b"palate sample key, bring your own"
FIRST_DAY, LAST_DAY = datetime.date.min, datetime.date.max


class Feistel:
    """A keyed permutation of range(n) for any n: two digits of radixes a * b >= n take turns in being shifted by a
    keyed hash of the other, and numbers outside the range walk on until they fall in."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _shift(self, tweak: bytes, i: int, value: int, size: int) -> int:
        width = (size.bit_length() + 7) // 8 + 8
        text = tweak + bytes((i,)) + value.to_bytes((value.bit_length() + 7) // 8 or 1, "big")
        out = b""
        while len(out) < width:
            out += hashlib.blake2b(text + bytes((len(out) & 255,)), key=self.key, digest_size=64).digest()
        return int.from_bytes(out[:width], "big") % size

    def permute(self, x: int, n: int, tweak: bytes) -> int:
        return self._walk(x, n, tweak, range(ROUNDS), 1)

    def invert(self, x: int, n: int, tweak: bytes) -> int:
        return self._walk(x, n, tweak, range(ROUNDS - 1, -1, -1), -1)

    def _walk(self, x: int, n: int, tweak: bytes, rounds: range, sign: int) -> int:
        if n < 2:
            return x
        a = isqrt(n - 1) + 1
        b = -(-n // a)
        while True:
            high, low = divmod(x, b)
            for i in rounds:
                if i % 2:
                    low = (low + sign * self._shift(tweak, i, high, b)) % b
                else:
                    high = (high + sign * self._shift(tweak, i, low, a)) % a
            x = high * b + low
            if x < n:
                return x


# --- values as numbers ----------------------------------------------------------------------------


def _alphabets(text: str) -> list[str]:
    """The class each character may vary in; a character outside the classes stays as it is."""
    out = []
    for c in text:
        if "0" <= c <= "9":
            out.append("0123456789")
        elif "a" <= c <= "z":
            out.append("abcdefghijklmnopqrstuvwxyz")
        elif "A" <= c <= "Z":
            out.append("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        else:
            out.append(c)
    return out


def _to_number(text: str, alphabets: list[str]) -> tuple[int, int]:
    x, n = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        x, n = x * len(a) + a.index(c), n * len(a)
    return x, n


def _to_text(x: int, alphabets: list[str]) -> str:
    out = []
    for a in reversed(alphabets):
        x, k = divmod(x, len(a))
        out.append(a[k])
    return "".join(reversed(out))


def luhn_sum(digits: str) -> int:
    return sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, digits[::-1]), 1))


def luhn_digit(digits: str) -> str:
    """The digit that makes ``digits`` plus itself pass."""
    return str(-luhn_sum(digits + "0") % 10)


def _refill(layout: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in layout)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


class Pseudonyms:
    """Replaces every valid value in a text. ``back`` inverts instead."""

    #: Candidates, tried in this order at each place.
    PATTERN = re.compile(
        r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-]))"
        r"|(?P<phone>(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9]))"
        r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
        r"|(?P<secret>(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9]))"
        r"|(?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9]))"
        r"|(?P<date>(?<![0-9])(?:[0-9]{4}([-/.])[0-9]{2}\7[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\8[0-9]{4})(?![0-9]))"
        r"|(?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
        r"|(?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\11[0-9]{4}\11[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\12[0-9]{5})(?![0-9]))"
    )
    NEED = re.compile("[0-9@]")

    def __init__(self, key: bytes = SAMPLE_KEY, back: bool = False):
        feistel = Feistel(key)
        self.turn = feistel.invert if back else feistel.permute
        self.seen: dict[tuple[str, str], str | None] = {}

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many values of each kind it had."""
        if not self.NEED.search(text):
            return text, {}
        found: dict[str, int] = {}

        def one(m: re.Match) -> str:
            kind, value = next((k, v) for k, v in m.groupdict().items() if v is not None)
            new = self.pseudonym(kind, value)
            if new is None and kind != "card" and (digits := re.fullmatch("[0-9]{13,19}", value)):
                kind, new = "card", self.pseudonym("card", digits[0])
            if new is None:
                return value
            found[kind] = found.get(kind, 0) + 1
            return new

        lines = text.split("\n")
        for i, line in enumerate(lines):
            if self.NEED.search(line):
                lines[i] = self.PATTERN.sub(one, line)
        return "\n".join(lines), found

    def pseudonym(self, kind: str, value: str) -> str | None:
        """None where the value fails its kind's check."""
        at = (kind, value)
        if at not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[at] = getattr(self, f"_{kind}")(value)
        return self.seen[at]

    def _by_class(self, text: str, tweak: bytes) -> str:
        alphabets = _alphabets(text)
        x, n = _to_number(text, alphabets)
        return _to_text(self.turn(x, n, tweak), alphabets)

    def _email(self, value: str) -> str:
        head, dot, top = value.rpartition(".")
        return self._by_class(head, b"email") + dot + top

    def _phone(self, value: str) -> str | None:
        digits = "".join(c for c in value if c.isdigit())
        if not 7 <= len(digits) <= 15:
            return None
        # the country code is the digits before the first separator of an international number
        code = re.match(r"\+([0-9]{1,3})(?=[ .(-])", value)
        keep = len(code[1]) if code else 0
        rest = digits[keep:]
        return _refill(value, digits[:keep] + str(self.turn(int(rest), 10 ** len(rest), b"phone")).zfill(len(rest)))

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
            return None
        body = self._by_class(plain[4:], b"iban" + plain[:2].encode())
        new = iter(plain[:2] + f"{98 - _mod97(body + plain[:2] + '00'):02d}" + body)
        return "".join(c if c == " " else next(new) for c in value)

    def _secret(self, value: str) -> str | None:
        if len(set(value)) < 6:
            return None
        x = self.turn(int(value, 16), 16 ** len(value), b"secret%d" % len(value))
        new = format(x, "x").zfill(len(value))
        return new.upper() if value.upper() == value and value.lower() != value else new

    def _ip(self, value: str) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        return str(ipaddress.IPv4Address(self.turn(int(ipaddress.IPv4Address(value)), 1 << 32, b"ip")))

    def _date(self, value: str) -> str | None:
        first = value[4] in "-/."
        y, a, b = (value[:4], value[5:7], value[8:]) if first else (value[6:], value[3:5], value[:2])
        swapped = not first and int(a) > 12
        month, day = (b, a) if swapped else (a, b)
        try:
            date = datetime.date(int(y), int(month), int(day))
        except ValueError:
            return None
        n = (LAST_DAY - FIRST_DAY).days + 1
        # a day over 12 tells day-first and month-first apart, so such dates get such a pseudonym, and the others another
        # one, in every layout: the same date is the same one however it is written
        new, late = date, date.day > 12
        while True:
            new = FIRST_DAY + datetime.timedelta(self.turn((new - FIRST_DAY).days, n, b"date"))
            if (new.day > 12) == late:
                break
        y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
        digits = y + m + d if first else m + d + y if swapped else d + m + y
        return _refill(value, digits)

    def _ssn(self, value: str) -> str | None:
        area, group, serial = (int(p) for p in value.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        area -= 1 + (area > 666)
        x = self.turn((area * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, b"ssn")
        x, serial = divmod(x, 9999)
        area, group = divmod(x, 99)
        area += 1 + (area >= 665)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _card(self, value: str) -> str | None:
        digits = "".join(c for c in value if c.isdigit())
        if luhn_sum(digits) % 10 or len(set(digits)) == 1:
            return None
        body = digits[1:-1]
        new = digits[0] + str(self.turn(int(body), 10 ** len(body), b"card" + digits[:1].encode())).zfill(len(body))
        return _refill(value, new + luhn_digit(new))


def pseudonymise(docs: DataFrame, key: bytes = SAMPLE_KEY, text_col: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with valid values in ``text_col`` replaced, plus ``pii_found``: kinds and counts like
    ``card:2,email:1``, empty where nothing was found. An existing ``pii_found`` column is replaced.

    Dates are those of the calendar from year 1 to 9999, and become any other of them; one date is linked in all layouts.
    Null texts stay null; empty texts, empty tables, repeated rows and other columns pass through. Dates whose day and
    month could be swapped are read day first. Values that fail their check stay as they are.
    """
    docs = docs.drop("pii_found")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("pii_found", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pseudonyms = Pseudonyms(key, back)
        for batch in batches:
            texts, found = [], []
            for text in batch.column(at):
                text = text.as_py()
                new, kinds = pseudonyms.replace(text) if text else (text, {})
                texts.append(new)
                found.append(",".join(f"{k}:{n}" for k, n in sorted(kinds.items())))
            columns = batch.columns
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found, pa.string())], names=[*batch.schema.names, "pii_found"]
            )

    return docs.mapInArrow(run, schema)
