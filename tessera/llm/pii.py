"""PII: format-preserving Feistel pseudonyms.

Values are found by pattern, validated (check digits, ranges, calendar), and permuted by a keyed Feistel network over the
integers that their format can write: a card number becomes another valid card number with the same separators, a date
another date in the same notation. The permutation acts on the canonical value (digits without separators, a day's number,
lower-case letters), so a value has one pseudonym in every document and notation, and different values have different ones.

One narrow stage; no lookup table is built or shuffled.

A run of digits or of IBAN characters may hold more than the value: all its parts at separators are tried. Phones are 3-3-4
digits with separators, ten digits from 2-9 or eleven from 1 without, or 8-15 digits after a plus sign. Dates stay among those
with as many digits in day and month and on the same side of day 12, so that their length stays and so does which order they
can be read in; a date that can be read in both orders is read day first. Groups of an IP address keep their number of digits, and
zero groups of IPv6 stay zero, so that every notation of it still can be written. Whatever is replaced is found again, so
`back` undoes it, up to the capitals of IPv6 addresses.

Cases: a null text stays null; text without values is returned as it is; overlapping finds are settled by rank (phones and
IBANs of another length than their country's after all others, cards in odd groups last), then from left to right with the
order of KINDS at one place; a null doc_id is kept; repeated rows are treated alike; the other columns of the table are returned
untouched, whatever their names (the column of kinds takes another name where the table has one of its name); an empty table
gives no rows; a text of any length is one value of one block and takes time in proportion to it.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import ipaddress
import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from tessera.llm.common import Memo, slices

ROUNDS = 10
BLOCK_BYTES = 8 << 20
MEMO_ENTRIES = 200_000
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Days that dates are permuted among.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutations of range(n) for any n, by cycle walking on an a * b grid."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, k: int, value: int, size: int) -> int:
        raw = value.to_bytes((value.bit_length() + 7) // 8 or 1, "big")
        mac = hashlib.blake2b(tweak + bytes([k]) + raw, key=self.key, digest_size=min(64, (size.bit_length() + 7) // 8 + 8))
        return int.from_bytes(mac.digest(), "big") % size

    def permute(self, value: int, n: int, tweak: bytes, back: bool = False) -> int:
        """The image of `value`, or with `back` what `value` is the image of."""
        if n < 2:
            return value
        a = max(2, int(n**0.5) if n < 1 << 52 else 1 << (n.bit_length() // 2))
        b = -(-n // a)
        tweak = tweak + b"/" + str(n).encode() + b"/"
        while True:
            left, right = divmod(value, b)
            for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if k % 2:
                    right = (right + sign * self._round(tweak, k, left, b)) % b
                else:
                    left = (left + sign * self._round(tweak, k, right, a)) % a
            value = left * b + right
            if value < n:
                return value


def luhn(digits: str) -> bool:
    return _luhn_sum(digits) % 10 == 0


def _luhn_sum(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total


def _refill(shape: str, digits: str) -> str:
    """`shape` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isascii() and c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def _number(f: Feistel, digits: str, tweak: bytes, back: bool) -> str:
    return str(f.permute(int(digits), 10 ** len(digits), tweak, back)).zfill(len(digits))


def _card(f: Feistel, found: str, back: bool) -> str | None:
    digits = _digits(found)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None
    body = _number(f, digits[:-1], b"card", back)
    if len(set(body)) == 1:  # the validation above must hold for the pseudonym as well
        body = _number(f, body, b"card", back)
    return _refill(found, body + str(-_luhn_sum(body + "0") % 10))


def _iban(f: Feistel, found: str, back: bool) -> str | None:
    plain = found.replace(" ", "")
    as_number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or as_number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _mixed(f, plain[4:], b"iban", back)
    check = 98 - as_number(body + plain[:2] + "00") % 97
    it = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(it) for c in found)


def _country_digits(digits: str) -> int:
    """Digits of the country code that an international number starts with."""
    return 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGIT_COUNTRIES else 3


def _phone(f: Feistel, found: str, back: bool) -> str | None:
    digits = _digits(found)
    plus = found.startswith("+")
    country = _country_digits(digits) if plus else len(digits) - 10
    size = len(digits) - country
    if digits[0] == "0" and plus or len(digits) > 15 or size < 5 or size != 10 and (not plus or digits[0] in "17"):
        return None
    new = _number(f, digits[country:], b"phone", back)
    while (new[0] in "01") != (digits[country] in "01"):  # so that ten digits without separators stay a number that is found
        new = _number(f, new, b"phone", back)
    return _refill(found, digits[:country] + new)


def _ssn(f: Feistel, found: str, back: bool) -> str | None:
    area, group, serial = map(int, found.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    place = lambda a: a - 1 - (a > 666)
    value = f.permute((place(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, b"ssn", back)
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


def _in_widths(f: Feistel, values: list[int], lows: list[int], sizes: list[int], tweak: bytes, back: bool) -> list[int]:
    """Values permuted together, each of them within `lows` and the `sizes` values from there on."""
    n, value = 1, 0
    for v, low, size in zip(values, lows, sizes, strict=True):
        n, value = n * size, value * size + v - low
    value, new = f.permute(value, n, tweak + repr(lows).encode(), back), []
    for low, size in zip(reversed(lows), reversed(sizes), strict=True):
        value, v = divmod(value, size)
        new.append(v + low)
    return new[::-1]


def _ip(f: Feistel, found: str, back: bool) -> str | None:
    parts = found.split(".")
    values = list(map(int, parts))
    if max(values) > 255:
        return None
    lows = [0 if v < 10 else 10 if v < 100 else 100 for v in values]
    new = _in_widths(f, values, lows, [{0: 10, 10: 90, 100: 156}[low] for low in lows], b"ip", back)
    return ".".join(f"{v:0{len(p)}d}" for v, p in zip(new, parts, strict=True))


def _mixed(f: Feistel, text: str, tweak: bytes, back: bool) -> str:
    """Letters a-z and digits permuted together within their classes; other characters stay, capitals too."""
    low = text.lower()
    if len(low) != len(text):
        return text
    sizes = [10 if c in DIGITS else 26 if c in LOWER else 1 for c in low]
    n, value = 1, 0
    for c, size in zip(low, sizes, strict=True):
        if size > 1:
            value = value * size + (ord(c) - (48 if size == 10 else 97))
            n *= size
    shape = "".join("0" if s == 10 else "a" if s == 26 else c for c, s in zip(low, sizes, strict=True))
    value = f.permute(value, n, tweak + shape.encode(), back)
    out = []
    for c, was, size in zip(reversed(low), reversed(text), reversed(sizes), strict=True):
        if size > 1:
            value, digit = divmod(value, size)
            c = chr(digit + (48 if size == 10 else 97))
        out.append(c.upper() if was != was.lower() else c)
    return "".join(reversed(out))


def _email(f: Feistel, found: str, back: bool) -> str | None:
    local, _, domain = found.partition("@")
    host, _, top = domain.rpartition(".")
    return f"{_mixed(f, local, b'mail', back)}@{_mixed(f, host, b'host', back)}.{top}"


def _cased(text: str, like: str) -> str:
    """`text` in lower case with the capitals of `like`: of its letters, and elsewhere of the last letter before."""
    upper, out = next((c.isupper() for c in like if c.isalpha()), False), []
    for c, was in zip(text, like, strict=True):
        upper = was.isupper() if was.isalpha() else upper
        out.append(c.upper() if upper else c)
    return "".join(out)


def _secret(f: Feistel, found: str, back: bool) -> str | None:
    if not any(c in DIGITS for c in found) or not any(c.isalpha() for c in found):
        return None
    if found in (found.lower(), found.upper()) and all(c in "0123456789abcdefABCDEF" for c in found):
        value = f.permute(int(found, 16), 16 ** len(found), b"hex", back)
        return _cased(f"{value:0{len(found)}x}", found)
    return _mixed(f, found, b"secret", back)


def _prefixed(f: Feistel, found: str, back: bool) -> str | None:
    """A key whose kind its first letters tell; they stay."""
    prefix = next(p for p in KEY_PREFIXES if found.startswith(p))
    return prefix + _mixed(f, found[len(prefix) :], b"key", back)


def _ip6(f: Feistel, found: str, back: bool) -> str | None:
    try:
        address = ipaddress.IPv6Address(found)
    except ValueError:
        return None
    if address.is_loopback or address.is_unspecified or not any(c in DIGITS for c in found):
        return None
    groups = [int(g, 16) for g in address.exploded.split(":")]
    lows = [16 ** ((g.bit_length() - 1) // 4) if g else 0 for g in groups]
    new = _in_widths(f, groups, lows, [15 * low or 1 for low in lows], b"ip6", back)
    head, _, tail = found.partition("::")
    written = [g for g in head.split(":") if g] + [g for g in tail.split(":") if g]
    n_head = len([g for g in head.split(":") if g])
    kept = iter(new[:n_head] + new[8 - (len(written) - n_head) :])
    return re.sub(r"[0-9A-Fa-f]+", lambda m: _cased(f"{next(kept):0{len(m[0])}x}", m[0]), found)


def _day_class(day: datetime.date) -> tuple[bool, bool, bool]:
    return day.day < 10, day.day > 12, day.month < 10


@functools.cache
def _days() -> dict[tuple[bool, bool, bool], list[int]]:
    """Days by class, in order."""
    out: dict[tuple[bool, bool, bool], list[int]] = {}
    for n in range(FIRST_DAY, LAST_DAY + 1):
        out.setdefault(_day_class(datetime.date.fromordinal(n)), []).append(n)
    return out


def _date(order: str) -> Callable[[Feistel, str, bool], str | None]:
    def act(f: Feistel, found: str, back: bool) -> str | None:
        parts = dict(zip(order, re.split(r"\D", found), strict=True))
        try:
            day = datetime.date(int(parts["y"]), int(parts["m"]), int(parts["d"]))
        except ValueError:
            return None
        if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
            return None
        kind = _day_class(day)
        days = _days()[kind]
        at = f.permute(bisect.bisect_left(days, day.toordinal()), len(days), b"date" + bytes(kind), back)
        new = datetime.date.fromordinal(days[at])
        values = {"y": new.year, "m": new.month, "d": new.day}
        return _refill(found, "".join(f"{values[c]:0{len(parts[c])}d}" for c in order))

    return act


def _emails(text: str) -> Iterator[tuple[int, str]]:
    """Start and text of what looks like an address, from each @ to both sides: every character is passed once or twice."""
    for m in re.finditer(r"@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", text):
        start = m.start()
        while start and (text[start - 1].isalnum() or text[start - 1] in "_.%+-"):
            start -= 1
        if start < m.start():
            yield start, text[start : m.end()]


def _ends(found: str, tokens: re.Pattern) -> list[tuple[int, int, int]]:
    """Start, end and number of letters and digits of the pieces between separators."""
    return [(m.start(), m.end(), sum(c.isalnum() for c in m[0])) for m in tokens.finditer(found)]


def _card_parts(found: str) -> Iterator[tuple[int, int, int]]:
    """Start, end and rank of the parts of 13-19 digits at separators: cards in odd groups come last."""
    pieces = _ends(found, re.compile(r"\d+"))
    for i, (start, _, _) in enumerate(pieces):
        total, sizes = 0, []
        for _, end, n in pieces[i : i + 19]:
            total, sizes = total + n, [*sizes, n]
            if total > 19:
                break
            if total >= 13:
                yield start, end, 0 if len(sizes) == 1 or tuple(sizes) in CARD_GROUPS else 2


def _iban_parts(found: str) -> Iterator[tuple[int, int, int]]:
    """Start, end and rank: the part of the country's length, and after all others the longest first."""
    parts, total = [], 0
    for _, end, n in _ends(found, re.compile(r"[A-Z0-9]+")):
        total += n
        if 15 <= total <= 34:
            parts.append((total != IBAN_LENGTHS.get(found[:2]), -end))
    for other, end in sorted(parts):
        yield 0, -end, 1 if other else 0


def _phone_parts(found: str) -> Iterator[tuple[int, int, int]]:
    """Start, end and rank of the parts of 8-15 digits, the longest first."""
    ends, total = [], 0
    for _, end, n in _ends(found, re.compile(r"\(?\d+\)?")):
        total += n
        if 8 <= total <= 15:
            ends.append(end)
    for end in reversed(ends):
        yield 0, end, 1


#: Country codes of two digits; 1 and 7 have one and the rest have three (fixed values).
TWO_DIGIT_COUNTRIES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: How cards are printed (fixed values).
CARD_GROUPS = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 1), (4, 4, 4, 3), (4, 4, 4, 4, 3), (4, 4, 5), (6, 13)}
#: Letters and digits of an IBAN by country (fixed values).
IBAN_LENGTHS = {
    c: int(n)
    for n, names in (x.split(":") for x in "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,CR,HR,LI,LV 22:BG,BH,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,TL,OM,SO 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU".split())
    for c in names.split(",")
}
#: How keys of well-known services begin (fixed values).
KEY_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "sk-", "xoxb-", "xoxp-")
#: Of a match of these kinds, the parts to try: start, end and rank, best first.
PARTS: dict[str, Callable[[str], Iterator[tuple[int, int, int]]]] = {"iban": _iban_parts, "phone_plus": _phone_parts, "card": _card_parts}
#: Rank of the other kinds, where it is not 0.
RANKS = {"phone": 1}
#: Kinds of values, their patterns and what validates and permutes them. At one place and rank the first that is valid wins.
KINDS: tuple[tuple[str, str | Callable[[str], Iterator[tuple[int, str]]], Callable[[Feistel, str, bool], str | None]], ...] = (
    ("email", _emails, _email),
    ("key", rf"(?<![A-Za-z0-9])(?:{'|'.join(KEY_PREFIXES)})[A-Za-z0-9]{{16,128}}(?![A-Za-z0-9])", _prefixed),
    ("secret", r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,128}(?![A-Za-z0-9])", _secret),
    ("iban", r"(?<![A-Za-z0-9])(?=([A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])))", _iban),
    ("date_ymd", r"(?<!\d)\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?!\d)", _date("ymd")),
    ("date_dmy", r"(?<!\d)\d{1,2}[-/.]\d{1,2}[-/.]\d{4}(?!\d)", _date("dmy")),
    ("date_mdy", r"(?<!\d)\d{1,2}/\d{1,2}/\d{4}(?!\d)", _date("mdy")),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    ("ip6", r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|:(?=:))[0-9A-Fa-f:]{1,38}(?![\w:]|\.\d)", _ip6),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)", _ip),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)", _phone),
    ("phone", r"(?<![\w+])(?<!\d[.,])1?[2-9]\d{9}(?!\w|[.,]\d)", _phone),
    ("phone_plus", r"(?<![\w+])\+\(?\d\)?(?:[ .-]?\(?\d\)?){7,}", _phone),
    ("card", r"(?<!\d)\d(?:[ -]?\d){12,}(?!\d)", _card),
)
HINT = re.compile(r"\d|@")


def _finder(pattern: re.Pattern) -> Callable[[str], Iterator[tuple[int, str]]]:
    return lambda text: ((m.start(), m[m.lastindex or 0]) for m in pattern.finditer(text))


class Pseudonyms:
    """Replaces the values of texts under a key, or with `back` pseudonyms by the values that they stand for."""

    def __init__(self, key: bytes, back: bool = False):
        self.feistel, self.back = Feistel(key), back
        self.patterns = [(name, pattern if callable(pattern) else _finder(re.compile(pattern)), act) for name, pattern, act in KINDS]
        self.memo = Memo(self._of, MEMO_ENTRIES)

    def _of(self, kind_and_value: tuple[int, str]) -> str | None:
        kind, value = kind_and_value
        return self.patterns[kind][2](self.feistel, value, self.back)

    def found(self, text: str) -> list[tuple[int, int, str, str]]:
        """start, end, kind and pseudonym of the valid values of a text, in order and apart from each other."""
        if not HINT.search(text):
            return []
        finds = []
        for k, (name, finder, _) in enumerate(self.patterns):
            parts = PARTS.get(name)
            for place, found in finder(text):
                for order, (start, end, rank) in enumerate(parts(found) if parts else [(0, len(found), RANKS.get(name, 0))]):
                    new = self.memo[k, found[start:end]]
                    if new is not None:
                        finds.append((rank, place + start, k, order, place + end, name.removesuffix("_plus"), new))
        starts, out = [], []
        for _, start, _, _, end, name, new in sorted(finds):
            i = bisect.bisect_left(starts, start)
            if (i == 0 or out[i - 1][1] <= start) and (i == len(out) or end <= starts[i]):
                starts.insert(i, start)
                out.insert(i, (start, end, name, new))
        return out

    def replace(self, text: str) -> tuple[str, list[str]]:
        finds = self.found(text)
        if not finds:
            return text, []
        pieces, last = [], 0
        for start, end, _, new in finds:
            pieces += (text[last:start], new)
            last = end
        return "".join([*pieces, text[last:]]), [name for _, _, name, _ in finds]


def pseudonymise(docs: DataFrame, key: bytes, counts: bool = True, back: bool = False) -> DataFrame:
    """`docs` with `text` replaced and, with `counts`, an array `pii_kinds` of the kinds found, in order.

    key: whoever has it can undo the permutations, by `back`; without it the pseudonyms don't lead back. Where `docs` has a
    column pii_kinds, the new one is named pii_kinds_2 (or _3, ...).
    """
    names = docs.columns
    place = names.index("text")
    taken = {n.lower() for n in names}
    extra = [next(n for n in itertools.chain(["pii_kinds"], (f"pii_kinds_{k}" for k in itertools.count(2))) if n not in taken)] if counts else []
    text = StructField("text", StringType())
    schema = StructType([text if i == place else f for i, f in enumerate(docs.schema)] + [StructField(n, ArrayType(StringType())) for n in extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key, back)
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                done = [(None, []) if x is None else own.replace(x) for x in part.column(place).cast(pa.string()).to_pylist()]
                columns = list(part.columns)
                columns[place] = pa.array([t for t, _ in done], pa.string())
                if counts:
                    columns.append(pa.array([k for _, k in done], pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(columns, names + extra)

    return docs.mapInArrow(run, schema)
