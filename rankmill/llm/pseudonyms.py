"""Format-preserving pseudonyms for personal numbers, dates and addresses, by keyed Feistel permutations.

What looks like a card number, telephone number, IPv4 address, calendar date or e-mail address is validated and
written as a mixed-radix number in the range of all values of its format; a keyed Feistel network, walked
until it stays in range, permutes that range, and the result is written back in the same form with the same
separators. Card numbers keep a valid check digit, dates stay dates between 1900 and 2099. The permutation depends on key and kind
alone, so equal values, however punctuated, get equal pseudonyms in all documents, different ones different
ones, and the key's holder can turn them back. The places found go with the text: next to other digits, a
pseudonym may look like part of a longer valid card number, and only with the places is it told apart.

Telephone numbers are those of ten digits with the area code in brackets or all three groups apart, with or without 1 or +1,
and international ones, + and 7 to 15 digits. Country codes and a (0) behind them stay, the other digits are permuted; whether
a national number begins with 0 stays too, except that of country code 1. Ten digits in one piece, national forms of other
countries and 00 for + are not told from other numbers and stay. A form that would
cut a valid card written in one piece or in usual groups gives way to a shorter one.

Defined results: a missing text stays missing, an empty one empty; texts are read whole. Of overlapping
valid values the leftmost counts, then the kind listed first, then the longest; what fails validation stays
and hides no other value. Each row is treated by
itself, repeated keys included. An empty table gives an empty result. Other columns are passed through.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from rankmill.llm.common import tidy

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

#: Formats, in order of precedence.
KINDS = ("card", "phone", "ip", "date", "email")
CARD = r"(?<![\w.-])\d(?:[ -]?\d){%s}(?![\w-])"
AREA = r"(?<!\w)(?:\+?1[ .-]?)?\(\d{3}\)[ -]?\d{3}[ .-]\d{4}(?!\w)"
GROUPS = r"(?<![\w+])(?<!\d[.-])(?:\+?1[ .-]?)?\d{3}(?:-\d{3}-| \d{3} |\.\d{3}\.)\d{4}(?!\w|[.-]\d)"
ABROAD = r"(?<![\w+])\+[1-9](?:(?:[ -]?\(|\)[ -]?|[ ./-])?\d){%s}(?!\w|[./-]\d)"
IP = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?![\w/-]|\.\d)"
EMAIL = r"(?<![\w.+-])[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: Where some form begins; the forms tried there, in order of precedence.
PATTERN = re.compile(f"(?=[0-9(+])(?:{CARD % '12,18'}|{AREA}|{GROUPS}|{ABROAD % '6,14'}|{IP}|{DATE})|{EMAIL}", re.ASCII)
CARDS = [("card", re.compile(CARD % n, re.ASCII)) for n in range(18, 11, -1)]
USUAL = re.compile(r"\d+|(?:\d{4}[ -]){3}\d{1,4}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{4,5}", re.ASCII)
PHONES = [("phone", re.compile(form, re.ASCII)) for form in (AREA, GROUPS, *(ABROAD % n for n in range(14, 5, -1)))]
FORMS = [*CARDS, *PHONES, *((kind, re.compile(form, re.ASCII)) for kind, form in zip(KINDS[2:], (IP, DATE, EMAIL), strict=True))]
#: Country codes; all others have three digits.
SHORT_CODES = re.compile("1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")


class Permutation:
    """A keyed permutation of the numbers below ``size``, one for each kind of value."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, i: int, kind: str, size: int, half: int, width: int) -> int:
        seed = f"{kind}:{size}:{i}:{half}".encode()
        return int.from_bytes(hashlib.blake2b(seed, key=self.key, digest_size=64).digest(), "big") % (1 << width)

    def _walk(self, value: int, size: int, kind: str, rounds: list[int]) -> int:
        if not 0 <= value < size:
            raise ValueError("value out of range")
        width = max(1, -(-(size - 1).bit_length() // 2))
        mask = (1 << width) - 1
        back = rounds[0] != 0
        while True:
            left, right = value >> width, value & mask
            for i in rounds:
                if back:
                    left, right = right ^ self._round(i, kind, size, left, width), left
                else:
                    left, right = right, left ^ self._round(i, kind, size, right, width)
            value = left << width | right
            if value < size:
                return value

    def apply(self, value: int, size: int, kind: str) -> int:
        return self._walk(value, size, kind, list(range(ROUNDS)))

    def invert(self, value: int, size: int, kind: str) -> int:
        return self._walk(value, size, kind, list(range(ROUNDS))[::-1])


def check_digit(digits: str) -> int:
    """The digit that makes a number valid when it is put behind ``digits``."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _with_digits(value: str, digits: str) -> str:
    """``value`` with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in value)


def _card(value: str, turn) -> str | None:
    digits = re.sub(r"\D", "", value)
    if check_digit(digits[:-1]) != int(digits[-1]):
        return None
    body = str(turn(int(digits[:-1]), 10 ** (len(digits) - 1))).zfill(len(digits) - 1)
    return _with_digits(value, f"{body}{check_digit(body)}")


def _phone(value: str, turn) -> str | None:
    """Country code, (0) and signs stay; brackets, if any, open right behind the country code."""
    digits = re.sub(r"\D", "", value)
    if value[0] == "+":
        code = m.group() if (m := SHORT_CODES.match(digits)) else digits[:3]
    else:
        code = digits[:-10]
    home = code in ("", "1")
    parts = re.fullmatch(rf"(\+?{code}{'' if home else r'(?:[ -]?[(]0[)])?'})([ .-]?(?:\([^()]+\))?[^()]*)", value)
    if not parts:
        return None
    head, rest = parts.groups()
    number = re.sub(r"\D", "", rest)
    n = len(number)
    if home and n != 10:
        return None
    low = 0 if home or number[0] == "0" else 10 ** (n - 1)
    size = 10**n if home else 9 * low or 10 ** (n - 1)
    return head + _with_digits(rest, str(low + turn(int(number) - low, size)).zfill(n))


def _ip(value: str, turn) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    number = turn(int.from_bytes(map(int, parts), "big"), 1 << 32)
    return ".".join(map(str, number.to_bytes(4, "big")))


def _date(value: str, turn) -> str | None:
    """Years lead in ISO dates, days before dots, months before strokes."""
    sign = re.sub(r"\d", "", value)[0]
    parts = value.split(sign)
    order = {"-": (0, 1, 2), ".": (2, 1, 0), "/": (2, 0, 1)}[sign]
    try:
        day = datetime.date(*(int(parts[i]) for i in order)).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + turn(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1))
    out = list(parts)
    for i, n in zip(order, (new.year, new.month, new.day), strict=True):
        out[i] = str(n).zfill(4 if n > 99 else 2)
    return sign.join(out)


def _email(value: str, turn) -> str | None:
    """Letters and digits before the @, each by one of its sort; capitals keep their places."""
    name, at, domain = value.partition("@")
    number, size = 0, 1
    for c in name.lower():
        if c.isalnum():
            base, digit = (10, int(c)) if c.isdigit() else (26, ord(c) - 97)
            number, size = number * base + digit, size * base
    if size == 1:
        return None
    number, out = turn(number, size), []
    for c in reversed(name):
        if c.isalnum():
            number, digit = divmod(number, 10 if c.isdigit() else 26)
            new = str(digit) if c.isdigit() else chr(97 + digit)
            c = new.upper() if c.isupper() else new
        out.append(c)
    return "".join(reversed(out)) + at + domain


_FORMATS = {"card": _card, "phone": _phone, "ip": _ip, "date": _date, "email": _email}


def _shape(kind: str, value: str) -> str:
    """E-mail addresses of different shape have ranges of their own; other kinds have one for each length."""
    return kind + ":" + re.sub("[A-Za-z]", "a", re.sub("[0-9]", "9", value.partition("@")[0])) if kind == "email" else kind


def pseudonym(kind: str, value: str, permutation: Permutation, back: bool = False) -> str | None:
    """The pseudonym of a value (or, ``back``, the value of a pseudonym); None if the value is not valid."""
    turn = permutation.invert if back else permutation.apply
    return _FORMATS[kind](value, lambda number, size: turn(number, size, _shape(kind, value)))


Place = tuple[str, int, int]  # kind, start, end


def _found(text: str, permutation: Permutation, back: bool) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, pseudonym) of each valid value; behind an invalid one the search goes on at its second sign."""
    at = 0
    while m := PATTERN.search(text, at):
        at = m.start() + 1
        for kind, form in FORMS:
            one = form.match(text, m.start())
            new = pseudonym(kind, one.group(), permutation, back) if one else None
            if new is not None and not (kind == "phone" and _cuts_card(text, *one.span())):
                yield kind, one.start(), one.end(), new
                at = one.end()
                break


def _cuts_card(text: str, start: int, end: int) -> bool:
    """Whether a valid card number in usual groups begins inside and ends behind."""
    ones = (form.match(text, at) for at in range(start + 1, end) for _, form in CARDS)
    return any(m and m.end() > end and USUAL.fullmatch(m.group()) and _card(m.group(), lambda number, _: str(number)) for m in ones)


def _given(text: str, permutation: Permutation, back: bool, places: list[Place]) -> Iterator[tuple[str, int, int, str]]:
    """The same for the pseudonyms of values at known places; only those of addresses and dates may differ in length."""
    shift = 0
    for kind, start, end in places:
        ones = (form.match(text, start + shift) for own, form in FORMS if own == kind)
        one = next(m for m in ones if m and (kind in ("ip", "date") or m.end() - m.start() == end - start))
        shift = one.end() - end
        yield kind, one.start(), one.end(), pseudonym(kind, one.group(), permutation, back) or one.group()


def replace(text: str, permutation: Permutation, back: bool = False, places: list[Place] | None = None) -> tuple[str, list[Place]]:
    """Text with pseudonyms, and (kind, start, end) of each place in the text given.

    With the ``places`` that were returned when the text was made, exactly those are turned.
    """
    out, spans, at = [], [], 0
    for kind, start, end, new in _found(text, permutation, back) if places is None else _given(text, permutation, back, places):
        out += text[at:start], new
        spans.append((kind, start, end))
        at = end
    return "".join([*out, text[at:]]), spans


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", spans: str = "pii_spans", back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and a column ``spans``, (kind, start, end) in code points of the old text.

    On the way ``back``, a column ``spans`` that came with the pseudonyms says where they are; without it they are searched.
    """
    permutation = Permutation(key)
    known = back and spans in docs.columns
    rows = docs.select(*(c for c in docs.columns if c != spans), *([spans] if known else []))
    at = rows.columns.index(text)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, names = list(batch.columns), list(batch.schema.names)
            given = [s and [(p["kind"], p["start"], p["end"]) for p in s] for s in columns.pop().to_pylist()] if known else [None] * len(batch)
            names = names[: len(columns)]
            found = [(None, []) if t is None else replace(t, permutation, back, g) for t, g in zip(columns[at].to_pylist(), given, strict=True)]
            columns[at] = pa.array([t for t, _ in found], pa.string())
            places = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in all_] for _, all_ in found]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(places, kind)], [*names, spans])

    from pyspark.sql import types as T

    place = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    fields = [f for f in docs.schema.fields if f.name != spans]
    return rows.mapInArrow(tidy(replaced), T.StructType([*fields, T.StructField(spans, T.ArrayType(place))]))
