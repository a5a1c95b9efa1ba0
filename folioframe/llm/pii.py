"""Format-preserving pseudonyms for personal data.

Card numbers (Luhn), phone numbers, IPv4 addresses, IBANs (mod 97), social
security numbers and calendar dates are validated, then permuted by a keyed
Feistel network within their own format: the result is valid again, and equal
values get equal pseudonyms in every document. The letters and digits of e-mail
addresses are permuted class by class.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.base import bounded_batches, tidy

ROUNDS = 10


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """Keyed permutation of ``0 … size - 1``: a balanced Feistel network, walked until it ends inside.

    The network works on ``a * side + b``; ``side ** 2`` is below four times
    ``size``, so a walk takes few steps.
    """
    if size < 2:
        return value
    side = 1
    while side * side < size:
        side *= 2
    while True:
        a, b = divmod(value, side)
        for turn in range(ROUNDS):
            mac = hashlib.blake2b(b"%d|%d|" % (turn, size) + tweak + b"|" + str(b).encode(), key=key, digest_size=24).digest()
            a, b = b, a ^ (int.from_bytes(mac, "big") % side) if side < 1 << 160 else a ^ (int.from_bytes(_long(mac, side), "big") % side)
        value = a * side + b
        if value < size:
            return value


def _long(seed: bytes, side: int) -> bytes:
    return hashlib.shake_256(seed).digest(side.bit_length() // 8 + 16)


def _classes(text: str) -> list[tuple[int, str]]:
    """Places of the letters and digits of ``text`` with their alphabet."""
    return [(i, "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
            for i, c in enumerate(text) if c.isascii() and c.isalnum()]


def permute_text(text: str, key: bytes, tweak: bytes) -> str:
    """Permutes letters and digits within their class; everything else stays in place."""
    places = _classes(text)
    value, size = 0, 1
    for i, alphabet in places:
        value, size = value * len(alphabet) + alphabet.index(text[i]), size * len(alphabet)
    value = permute(value, size, key, tweak + b"|" + "".join(a[0] for _, a in places).encode())
    out = list(text)
    for i, alphabet in reversed(places):
        value, out[i] = value // len(alphabet), alphabet[value % len(alphabet)]
    return "".join(out)


def _put_digits(text: str, digits: str) -> str:
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in text)


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def _card(text: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
        return None
    body = f"{permute(int(digits[:-1]), 10 ** (len(digits) - 1), key, b'card%d' % len(digits)):0{len(digits) - 1}d}"
    return _put_digits(text, body + luhn_digit(body))


def _phone(text: str, key: bytes) -> str | None:
    """Country code stays, the national digits change."""
    digits = re.sub(r"\D", "", text)
    if not 7 <= len(digits) <= 15:
        return None
    country = re.match(r"\+(\d{1,3})(?=\D)", text)
    fixed = country[1] if country else ""
    rest = digits[len(fixed):]
    new = f"{permute(int(rest), 10 ** len(rest), key, b'phone%d|' % len(rest) + fixed.encode()):0{len(rest)}d}"
    return _put_digits(text, fixed + new)


def _ip(text: str, key: bytes) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, b"ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _ssn(text: str, key: bytes) -> str | None:
    area, group, serial = text.split("-")
    if area in ("000", "666") or area >= "900" or group == "00" or serial == "0000":
        return None
    areas = 898  # 001 to 899 without 666
    at = int(area) - 1 - (int(area) > 666)
    value = permute((at * 99 + int(group) - 1) * 9999 + int(serial) - 1, areas * 99 * 9999, key, b"ssn")
    value, serial_at = divmod(value, 9999)
    at, group_at = divmod(value, 99)
    return f"{at + 1 + (at >= 665):03d}-{group_at + 1:02d}-{serial_at + 1:04d}"


def _iban_check(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(number) % 97:02d}"


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_check(plain[:2], plain[4:]) != plain[2:4]:
        return None
    body = permute_text(plain[4:], key, b"iban" + plain[:2].encode())
    new = iter(plain[:2] + _iban_check(plain[:2], body) + body)
    return "".join(next(new) if c != " " else c for c in text)


FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
DAYS = datetime.date(2100, 1, 1).toordinal() - FIRST_DAY


def _date(text: str, key: bytes) -> str | None:
    """Dates of 1900 to 2099, year first or last; an ambiguous day and month is read day first."""
    a, sep, b, c = re.fullmatch(r"(\d+)([-/.])(\d+)[-/.](\d+)", text).groups()
    forms = [(a, b, c, "ymd")] if len(a) == 4 else [(c, b, a, "dmy"), (c, a, b, "mdy")]
    for year, month, day, order in forms:
        try:
            at = datetime.date(int(year), int(month), int(day)).toordinal() - FIRST_DAY
        except ValueError:
            continue
        if not 0 <= at < DAYS:
            continue
        new = datetime.date.fromordinal(FIRST_DAY + permute(at, DAYS, key, b"date"))
        parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return sep.join(parts[p] for p in order)
    return None


def _email(text: str, key: bytes) -> str | None:
    """Everything before the last label of the domain changes."""
    head, dot, last = text.rpartition(".")
    return permute_text(head, key, b"email") + dot + last


# In this order; what an earlier kind took is not looked at again. A look-behind keeps parts of longer words and numbers out.
KINDS = (
    ("email", "@", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9])", re.A), _email),
    ("iban", None, re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?=(?: ?[A-Z0-9]){11})", re.A), _iban),  # its first four signs, see _iban_ends
    ("ip", ".", re.compile(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", re.A), _ip),
    ("date", None, re.compile(r"(?<![\d./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\d/-]|\.\d)", re.A), _date),
    ("ssn", "-", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", re.A), _ssn),
    ("card", None, re.compile(r"(?<![\dA-Za-z])\d(?:[ -]?\d){12,}(?![\dA-Za-z])", re.A), _card),  # a run of digit groups, see _card_spans
    ("phone", None, re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w|[.-]\d)", re.A), _phone),
)
NAMES = tuple(kind for kind, *_ in KINDS)
_DIGIT = re.compile(r"\d", re.A)
_GROUP = re.compile(r"\d+", re.A)
#: What is printed on cards: first digit of an issuer, and the usual groups or none.
_PRINTED = re.compile(r"(?=[3-6]|2[2-7])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3})?|\d{4}([ -])\d{6}\2\d{4,5}|\d{4}([ -])\d{3}\3\d{3}\3\d{3})", re.A)


def _clear(taken: bytearray, start: int, end: int) -> bool:
    return taken.find(1, start, end) < 0


def _card_spans(run: re.Match, taken: bytearray) -> list[tuple[int, int]]:
    """Card numbers in a run of digit groups that single blanks or hyphens separate.

    Every part of 13 to 19 digits that begins and ends at a border of groups is
    tried, the leftmost and longest first. Parts that look as printed on a card
    go before the others, or a number in front of a card could pass together
    with its first digits and leave the last ones.
    """
    text, groups = run.string, [m.span() for m in _GROUP.finditer(run.string, *run.span())]
    ends, sums = [0], ([0], [0])  # digits up to each group; Luhn sums over them with even or odd places as they are
    for a, b in groups:
        for c in text[a:b]:
            n = int(c)
            parity = (len(sums[0]) - 1) % 2
            sums[parity].append(sums[parity][-1] + n)
            sums[1 - parity].append(sums[1 - parity][-1] + sum(divmod(2 * n, 10)))
        ends.append(ends[-1] + b - a)
    valid = []
    for first, (start, _) in enumerate(groups):
        for last in range(first, len(groups)):
            low, high = ends[first], ends[last + 1]
            if high - low > 19 or not _clear(taken, *groups[last]):
                break
            luhn = sums[(high - 1) % 2]
            end = groups[last][1]
            if high - low >= 13 and (luhn[high] - luhn[low]) % 10 == 0 and len(set(_DIGIT.findall(text, start, end))) > 1:
                valid.append((not _PRINTED.fullmatch(text, start, end), start, -end))
    found, used = [], bytearray(run.end() - run.start())
    for _, start, end in sorted(valid):
        here = slice(start - run.start(), -end - run.start())
        if not any(used[here]):
            used[here] = b"\1" * (-end - start)
            found.append((start, -end))
    return found


# Characters of an IBAN by country.
IBAN_LENGTHS = {country: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BF BI BJ CG CI CM DJ FR GA GQ IR IT KM MC MG ML MR NE SM SN TD TF TG YT",
    28: "AL AZ BY CY DO GT HN HU LB MA NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for country in countries.split()}
_IBAN_SIGNS = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}", re.A)
_WORD_END = re.compile(r"[A-Z0-9](?![A-Za-z0-9])", re.A)


def _iban_ends(head: re.Match, taken: bytearray) -> list[int]:
    """Places where an IBAN that begins here may end: ends of words, that of its country's length first, then the farthest."""
    text, start = head.string, head.start()
    ends, signs, at = [], 0, start
    for m in _WORD_END.finditer(text, head.end(), _IBAN_SIGNS.match(text, start).end()):
        if m.end() < len(text) and text[m.end()].isascii() and text[m.end()].isalnum():
            continue  # the look-ahead saw only up to the last place searched
        signs, at = signs + m.end() - at - text.count(" ", at, m.end()), m.end()
        if signs >= 15:
            ends.append((signs != IBAN_LENGTHS.get(head[0][:2]), -m.end()))
    return [-end for _, end in sorted(ends) if _clear(taken, start, -end)]


def _spans(kind: str, pattern: re.Pattern, text: str, taken: bytearray):
    """Places where a value of the kind may be."""
    for m in pattern.finditer(text):
        if kind == "iban":
            yield from ((m.start(), end) for end in _iban_ends(m, taken) if _clear(taken, m.start(), end))
        elif kind == "card":
            yield from _card_spans(m, taken)
        elif _clear(taken, *m.span()):
            yield m.span()


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with every validated value replaced, and (kind, start, end) of the values in the input."""
    digit = _DIGIT.search(text)
    if not digit and "@" not in text:
        return text, []
    found: list[tuple[int, int, str, str]] = []
    taken = bytearray(len(text))
    for kind, mark, pattern, _ in KINDS:
        if (kind != "email" and not digit) or (mark and mark not in text):
            continue
        for a, b in _spans(kind, pattern, text, taken):
            new = _changed(kind, text[a:b], key)
            if new is not None:
                found.append((a, b, kind, new))
                taken[a:b] = b"\1" * (b - a)
    if not found:
        return text, []
    found.sort()
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(kind, a, b) for a, b, kind, _ in found]


_CHANGE = {kind: change for kind, _, _, change in KINDS}


@lru_cache(maxsize=20_000)
def _changed(kind: str, value: str, key: bytes) -> str | None:
    return _CHANGE[kind](value, key)


def derived_key(secret: str) -> bytes:
    """The permutation key of a pass phrase; the same phrase links values over runs and tables."""
    return hmac.new(b"format-preserving pseudonyms", secret.encode(), hashlib.sha256).digest()


def pseudonymised(docs: DataFrame, secret: str, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs`` with the text replaced and a column ``pii_spans`` (kind, start, end in the former text).

    All other columns stay; ``chars_col``, if given, gets the length of a changed
    text. A null text stays null and an empty one empty, both without spans;
    texts are searched whole; rows that repeat stay and change alike. An
    existing column ``pii_spans`` is replaced.
    """
    bounded_batches(docs.sparkSession)
    key = derived_key(secret)
    columns = [c for c in docs.columns if c != "pii_spans"]
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    place = columns.index(text_col)

    def run(batches):
        for batch in batches:
            done = [(None, []) if t is None else pseudonymise(t, key) for t in batch.column(place).to_pylist()]
            arrays = list(batch.columns)
            arrays[place] = pa.array([t for t, _ in done], pa.string())
            spans = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in s] for _, s in done], pa.list_(span))
            yield pa.RecordBatch.from_arrays([*arrays, spans], names=[*columns, "pii_spans"])

    schema = T.StructType(docs.select(*columns).schema.fields).add("pii_spans", T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")))
    out = docs.select(*columns).mapInArrow(tidy(run), schema)
    if chars_col is None:
        return out
    length = F.length(text_col).cast(docs.schema[chars_col].dataType)
    return out.withColumn(chars_col, F.when(F.size("pii_spans") > 0, length).otherwise(F.col(chars_col)))
