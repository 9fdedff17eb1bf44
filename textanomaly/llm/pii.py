"""Format-preserving pseudonyms: personal numbers, dates and mail names permuted by a keyed Feistel network.

A value keeps its length, separators, letter case and validity (check digits, calendar, octets); equal values get
equal pseudonyms in every document, however they are written, and the key alone gives them back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from hashlib import blake2b
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from textanomaly.llm.common import pieces

ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
KINDS = ("mail", "card", "number", "phone", "ip", "iban", "social", "date")

# value patterns: fixed formats
MAIL_DOMAIN = re.compile(r"[\w-]+(?:\.[\w-]+)+")
MAIL_NAME = re.compile(r"[\w.%+-]")
NUMBERS = re.compile(
    r"(?<![\w.])(?P<iban>[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30})(?!\w)"
    r"|(?<![0-9.])(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9]|\.[0-9])"
    r"|(?<![0-9])(?P<long>[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}"
    r"|[0-9]{4}(?P<gap15>[ -])[0-9]{6}(?P=gap15)[0-9]{5})(?![0-9])"
    r"|(?<![0-9])(?P<ymd>[0-9]{4}(?P<dash>[-/])[0-9]{2}(?P=dash)[0-9]{2})(?![0-9]|[-/][0-9])"
    r"|(?<![0-9])(?P<dmy>[0-9]{2}(?P<dot>[/.])[0-9]{2}(?P=dot)[0-9]{4})(?![0-9]|[/.][0-9])"
    r"|(?<![0-9-])(?P<social>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"
    r"|(?<![\w+])(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}"
    r"|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])"
)


# parts of a phone match: the whole of a number that starts with a country, its runs of digits, and what doesn't belong
INTERNATIONAL = re.compile(
    r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}"
)
RUN = re.compile(r"[0-9]+")
OTHER = re.compile(
    r" (?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
    r"|[0-9]{4}(?P<gap>[ -])[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}(?![0-9]|(?P=gap)[0-9]{4}(?![0-9]))"
    r"|[0-9]{4}(?P<gap15>[ -])[0-9]{6}(?P=gap15)[0-9]{5}(?![0-9])"
    r"|[0-9]{4}(?P<dash>[-/])[0-9]{2}(?P=dash)[0-9]{2}(?![0-9]|[-/][0-9])"
    r"|[0-9]{2}(?P<dot>[/.])[0-9]{2}(?P=dot)[0-9]{4}(?![0-9]|[/.][0-9])"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-]))"
)
FOUR = re.compile(r" [0-9]{4}(?![0-9])")


def phone_end(text: str, start: int, end: int) -> int:
    """Where the phone number at ``start`` ends, at the latest at ``end``; ``start`` if it has too few or many digits.

    Another value's format after a space ends it, and so does a space and four digits after ten or more. After
    "+1" and a separator a number has eleven digits. Only places of digits are looked at, so that a pseudonym ends
    where its value does.
    """
    if text[start] != "+":
        return end
    best, digits = start, 0
    for run in RUN.finditer(text, start, end):
        at = run.end()
        digits += at - run.start()
        if not 8 <= digits <= 15 or not INTERNATIONAL.fullmatch(text, start, at):
            continue
        best = at
        american = digits == 11 and text[start + 1] == "1" and text[start + 2] in " .(-"
        if american or OTHER.match(text, at) or (digits >= 10 and FOUR.match(text, at)):
            break
    return best


def mails(text: str) -> Iterator[tuple[int, int]]:
    """Places of mail addresses; every character is looked at a bounded number of times."""
    end, sign = 0, text.find("@")
    while sign >= 0:
        domain = MAIL_DOMAIN.match(text, sign + 1)
        start = sign
        if domain and sign > end and re.match(r"\w", text[sign - 1]):
            while start > end and MAIL_NAME.match(text, start - 1):
                start -= 1
            end = domain.end()
            yield start, end
        sign = text.find("@", max(sign + 1, end))


def social_valid(digits: str) -> bool:
    """Whether the parts of a social number are ones that are given out."""
    return digits[:3] not in ("000", "666") and digits[0] != "9" and digits[3:5] != "00" and digits[5:] != "0000"


class Feistel:
    """Keyed permutations of 0 .. size - 1, another one for every tweak."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: str, turn: int, value: int, size: int) -> int:
        data = f"{tweak}|{turn}|{value}".encode()
        return int.from_bytes(blake2b(data, key=self.key, digest_size=32).digest(), "big") % size

    def _once(self, value: int, a: int, b: int, tweak: str, back: bool) -> int:
        left, right = divmod(value, b)
        turns = range(ROUNDS)
        for turn in reversed(turns) if back else turns:
            sign = -1 if back else 1
            if turn % 2:
                right = (right + sign * self._round(tweak, turn, left, b)) % b
            else:
                left = (left + sign * self._round(tweak, turn, right, a)) % a
        return left * b + right

    def permute(self, value: int, size: int, tweak: str, back: bool = False) -> int:
        """Walk the permutation of the next larger rectangle until it comes back below ``size``."""
        a = max(1, isqrt(size))
        b = -(-size // a)
        value = self._once(value, a, b, tweak, back)
        while value >= size:
            value = self._once(value, a, b, tweak, back)
        return value

    def digits(self, digits: str, tweak: str, back: bool = False) -> str:
        count = len(digits)
        return str(self.permute(int(digits), 10**count, f"{tweak}|{count}", back)).zfill(count)


def luhn_digit(body: str) -> str:
    """The check digit that makes ``body`` a valid card number."""
    total = 0
    for i, d in enumerate(reversed(body)):
        doubled = int(d) * (2 if i % 2 == 0 else 1)
        total += doubled - 9 if doubled > 9 else doubled
    return str(-total % 10)


def _iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def _written(pattern: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``pattern``."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in pattern)


class Pseudonyms:
    """Replaces the personal values of texts; ``back`` gives the values again."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back

    def mail(self, value: str) -> str:
        """The letters a-z and digits before the @ change, in their case; others and the domain stay."""
        name, at, domain = value.rpartition("@")
        symbols = [c for c in name if c.isascii() and c.isalnum()]
        number, size, radixes = 0, 1, []
        for c in symbols:
            radix = 10 if c.isdigit() else 26
            number, size = number * radix + (int(c) if radix == 10 else ord(c.lower()) - 97), size * radix
            radixes.append(radix)
        shape = "".join("0" if c.isdigit() else "a" if c.isascii() and c.isalpha() else c for c in name)
        number = self.feistel.permute(number, size, f"mail|{shape}|{domain.lower()}", self.back)
        changed = []
        for radix in reversed(radixes):
            number, place = divmod(number, radix)
            changed.append(str(place) if radix == 10 else chr(97 + place))
        left = iter(reversed(changed))
        swapped = (next(left) if c.isascii() and c.isalnum() else c for c in name)
        return "".join(n.upper() if c.isupper() and n.isascii() else n for c, n in zip(name, swapped)) + at + domain

    def _long(self, value: str) -> tuple[str, str]:
        digits = re.sub(r"[^0-9]", "", value)
        body = digits[:-1]
        if luhn_digit(body) == digits[-1]:
            body = self.feistel.digits(body, "card", self.back)
            return "card", _written(value, body + luhn_digit(body))
        # a permutation of the numbers that are no cards: walk on over those that are
        digits = self.feistel.digits(digits, "number", self.back)
        while luhn_digit(digits[:-1]) == digits[-1]:
            digits = self.feistel.digits(digits, "number", self.back)
        return "number", _written(value, digits)

    def _date(self, value: str, order: str) -> str | None:
        """``order`` is ymd, dmy or mdy; dates that can be read as dmy are never taken for mdy, nor become such."""
        parts = re.split(r"[^0-9]", value)
        year, month, day = (int(parts[order.index(c)]) for c in "ymd")
        try:
            found = date(year, month, day)
        except ValueError:
            return None
        if not FIRST_DAY <= found <= LAST_DAY:
            return None
        span = (LAST_DAY - FIRST_DAY).days + 1
        moved = found
        while moved is found or (order == "mdy" and moved.day <= 12):
            moved = FIRST_DAY + timedelta(self.feistel.permute((moved - FIRST_DAY).days, span, "date", self.back))
        told = {"y": f"{moved.year:04d}", "m": f"{moved.month:02d}", "d": f"{moved.day:02d}"}
        return _written(value, "".join(told[c] for c in order))

    def _social(self, digits: str) -> str | None:
        """A permutation of the valid numbers: walk on over those that no one can have."""
        if not social_valid(digits):
            return None
        digits = self.feistel.digits(digits, "social", self.back)
        while not social_valid(digits):
            digits = self.feistel.digits(digits, "social", self.back)
        return digits

    def number(self, found: re.Match, value: str) -> tuple[str | None, str]:
        """(kind, pseudonym) of ``value``, or None and the text itself if it isn't valid."""
        kind = found.lastgroup
        if found["long"]:
            return self._long(value)
        if found["ip"]:
            octets = [int(x) for x in value.split(".")]
            if max(octets) > 255:
                return None, value
            moved = self.feistel.permute(int.from_bytes(bytes(octets), "big"), 1 << 32, "ip", self.back)
            return "ip", ".".join(str(x) for x in moved.to_bytes(4, "big"))
        if found["iban"]:
            country, account = value[:2], value[4:]
            if _iban_check(country, account) != value[2:4] or not any(c.isdigit() for c in account):
                return None, value
            digits = re.sub(r"[^0-9]", "", account)
            shape = re.sub(r"[0-9]", "0", country + account)
            account = _written(account, self.feistel.digits(digits, f"iban|{shape}", self.back))
            return "iban", country + _iban_check(country, account) + account
        if found["ymd"] or found["dmy"]:
            moved = self._date(value, "ymd") if found["ymd"] else self._date(value, "dmy") or self._date(value, "mdy")
            return ("date", moved) if moved else (None, value)
        digits = re.sub(r"[^0-9]", "", value)
        if found["social"]:
            moved = self._social(digits)
            return ("social", _written(value, moved)) if moved else (None, value)
        if found["phone"]:
            if not 8 <= len(digits) <= 15:
                return None, value
            country = re.match(r"\+[0-9]{1,3}(?=[ .(-])", value)
            fixed = len(country[0]) - 1 if country else 0
            local = self.feistel.digits(digits[fixed:], "phone", self.back)
            return "phone", _written(value, digits[:fixed] + local)
        raise AssertionError(kind)

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        counts: dict[str, int] = {}

        def around(part: str) -> str:
            if not _DIGITS.search(part):
                return part
            done, at = [], 0
            found = NUMBERS.search(part)
            while found:
                start, end = found.span()
                if found["phone"]:
                    end = phone_end(part, start, end)
                if end == start:  # no phone number: other values may begin inside
                    found = NUMBERS.search(part, start + 1)
                    continue
                kind, moved = self.number(found, part[start:end])
                if kind:
                    counts[kind] = counts.get(kind, 0) + 1
                done += [part[at:start], moved]
                at = end
                found = NUMBERS.search(part, end)
            return "".join([*done, part[at:]])

        if "@" not in text:
            return around(text), counts
        parts, at = [], 0
        for start, end in mails(text):
            parts += [around(text[at:start]), self.mail(text[start:end])]
            counts["mail"] = counts.get("mail", 0) + 1
            at = end
        return "".join([*parts, around(text[at:])]), counts


# every number has two digits in a row, or an address of single ones
_DIGITS = re.compile(r"[0-9]\.?[0-9]")


def _replacer(key: bytes, back: bool, columns: list[str], column: str) -> Callable:
    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        for batch in pieces(batches, column):
            done = [(None, {}) if t is None else names.replace(t) for t in batch.column(columns.index(column)).to_pylist()]
            arrays = list(batch.columns)
            arrays[columns.index(column)] = pa.array([t for t, _ in done], pa.string())
            counts = pa.array([list(c.items()) for _, c in done], pa.map_(pa.string(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*arrays, counts], [*columns, "__found"])

    return replace


def session_key(spark: SparkSession) -> str:
    """The key that the setting ``spark.textanomaly.pii.key`` names. Without it a well-known one, which links equal values
    but protects none: set one of your own before the pseudonyms leave your hands."""
    return spark.conf.get("spark.textanomaly.pii.key", "key")


def pseudonymise(docs: DataFrame, key: str, column: str = "text", found: str | None = None, back: bool = False) -> DataFrame:
    """``docs`` with the personal values of ``column`` replaced; ``found`` names a column for their counts by kind.

    Numbers are valid cards (Luhn), other numbers of 13 to 19 digits, phone numbers, IPv4 addresses, IBANs, social
    numbers and dates from 1900 to 2099, year first, day first or, where that is no date, month first; invalid ones stay
    as they are. Null texts stay null. Rows are changed one by
    one, without a shuffle; all other columns stay.
    """
    kinds = docs.schema
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds.fields)
    changed = docs.mapInArrow(_replacer(key.encode(), back, docs.columns, column), f"{schema}, `__found` map<string,bigint>")
    return changed.withColumnRenamed("__found", found) if found else changed.drop("__found")
