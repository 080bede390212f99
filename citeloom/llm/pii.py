"""Format-preserving pseudonyms for personal data.

Found values are permuted with a keyed Feistel network inside their own format: the
digits of a number stay as many digits, separators stay where they are, a card number
keeps a right check digit, a date stays a date. The permutation depends on the key, the
kind and the format only, so equal values get equal pseudonyms in all documents, and two
different values of a format never get the same one.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY


def feistel(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. size-1.

    An unbalanced network over two radices a * b >= size; values that leave the range are
    walked on until they are back in it, which keeps the map one to one.
    """
    if size < 2:
        return value
    a = 1 << ((size - 1).bit_length() + 1) // 2
    b = -(-size // a)
    head = f"{tweak}|{size}|".encode()
    while True:
        left, right = divmod(value, b)
        for i in range(ROUNDS):
            told = hmac.digest(key, head + f"{i}|{right if i % 2 == 0 else left}".encode(), "sha256")
            number = int.from_bytes(told[:16], "big")
            if i % 2 == 0:
                left = (left + number) % a
            else:
                right = (right + number) % b
        value = left * b + right
        if value < size:
            return value


def permute_digits(text: str, key: bytes, kind: str) -> str:
    """The digits of ``text`` permuted as one number; all else stays."""
    digits = re.sub(r"\D", "", text)
    shape = re.sub(r"\d", "9", text)
    new = iter(str(feistel(int(digits), 10 ** len(digits), key, f"{kind}|{shape}")).zfill(len(digits)))
    return re.sub(r"\d", lambda _: next(new), text)


def luhn_digit(body: str) -> str:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def luhn_valid(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def card_pseudonym(text: str, key: bytes) -> str:
    """A long number. With a right check digit it gets a new one that is right as well;
    one with a wrong digit keeps being wrong, by the same distance."""
    digits = re.sub(r"\D", "", text)
    off = (int(digits[-1]) - int(luhn_digit(digits[:-1]))) % 10
    body = permute_digits(digits[:-1], key, f"card{off}")
    new = iter(body + str((int(luhn_digit(body)) + off) % 10))
    return re.sub(r"\d", lambda _: next(new), text)


def address_pseudonym(text: str, key: bytes) -> str:
    """An IPv4 address: its 32 bits are permuted."""
    number = 0
    for part in text.split("."):
        number = number * 256 + int(part)
    number = feistel(number, 1 << 32, key, "ipv4")
    return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))


def date_pseudonym(text: str, key: bytes) -> str:
    """An ISO or day-first date between 1900 and 2099: its day is permuted in that range."""
    a, sep, b, _, c = re.split(r"([-/.])", text)
    iso = len(a) == 4
    day = datetime.date(*map(int, (a, b, c) if iso else (c, b, a)))
    new = datetime.date.fromordinal(_FIRST_DAY + feistel(day.toordinal() - _FIRST_DAY, _DAYS, key, f"date{sep}{iso}"))
    parts = (f"{new.year:04}", f"{new.month:02}", f"{new.day:02}")
    return sep.join(parts if iso else parts[::-1])


def is_date(text: str) -> bool:
    a, _, b, _, c = re.split(r"([-/.])", text)
    try:
        return 1900 <= datetime.date(*map(int, (a, b, c) if len(a) == 4 else (c, b, a))).year < 2100
    except ValueError:
        return False


#: Characters that are permuted among themselves, lower case.
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "0123456789", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ")
HEX = ("0123456789abcdef",)


def word_pseudonym(text: str, key: bytes, kind: str, alphabets: tuple[str, ...] = ALPHABETS) -> str:
    """Letters and digits permuted as one number in mixed radix, each inside its own
    alphabet; capitals and all else stay. An alphabet of both is upper case as a whole."""
    places = [(i, a) for i, c in enumerate(text) for a in alphabets if c.lower() in a]
    shape, number, size = list(text.lower()), 0, 1
    for i, alphabet in places:
        shape[i] = alphabet[0]
        number, size = number * len(alphabet) + alphabet.index(text[i].lower()), size * len(alphabet)
    number = feistel(number, size, key, f"{kind}|{''.join(shape)}")
    out, capitals = list(text), text.isupper()
    for i, alphabet in reversed(places):
        number, at = divmod(number, len(alphabet))
        out[i] = alphabet[at].upper() if capitals or text[i].isupper() and alphabets is not HEX else alphabet[at]
    return "".join(out)


def email_pseudonym(text: str, key: bytes) -> str:
    """The part before the @ permuted; the domain stays. Capitals do not make a new value:
    the same address in other capitals gets the same letters."""
    local, _, domain = text.partition("@")
    return f"{word_pseudonym(local, key, 'email|' + domain.lower())}@{domain}"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    replace: object
    valid: object = None


def _octets(text: str) -> bool:
    return all(int(p) < 256 and (p == "0" or p[0] != "0") for p in text.split("."))


def _card(text: str) -> bool:
    """Any 13 to 19 digits in a row; with separators, only with a right check digit."""
    return text.isdigit() or luhn_valid(re.sub(r"\D", "", text))


def _phone(text: str) -> bool:
    return 7 <= len(re.sub(r"\D", "", text)) <= 15


#: An area in brackets; one separator throughout; digits alone.
PHONE = r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}[ .-]\d{2,4}|(?P<sep>[ .-])\d{2,4}(?:(?P=sep)\d{2,4}){1,3}|\d{7,12})(?!\d)"

#: Longer formats first: what one kind has taken is not looked at again.
KINDS = (
    Kind("secret", r"""(?:(?<=token = ")|(?<=TOKEN = ")|(?<=key = ")|(?<=secret = "))[0-9A-Fa-f]{16,128}(?=")""", lambda t, k: word_pseudonym(t, k, "secret", HEX)),
    Kind("email", r"(?<![\w.+%-])[\w.+%-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])", email_pseudonym),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", None, lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1),
    Kind("date", r"(?<![\d./-])(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4})(?![\d/-]|\.\d)", date_pseudonym, is_date),
    Kind("ipv4", r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)", address_pseudonym, _octets),
    Kind("phone", PHONE, lambda t, k: phone_pseudonym(t, k), _phone),
    Kind("ssn", r"(?<![\d-])(?!000|666|9\d\d)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])", lambda t, k: ssn_pseudonym(t, k)),
    Kind("card", r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d|\.\d)", card_pseudonym, _card),
)


def phone_pseudonym(text: str, key: bytes) -> str:
    """The country code stays, the digits after it are permuted."""
    country = re.match(r"\+\d{1,3}", text)[0]
    return country + permute_digits(text[len(country) :], key, "phone" + country)


def ssn_pseudonym(text: str, key: bytes) -> str:
    """A valid number stays valid: areas 001-899 without 666, groups and serials above 0."""
    area, group, serial = map(int, text.split("-"))
    number = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    number, serial = divmod(feistel(number, 898 * 99 * 9999, key, "ssn"), 9999)
    area, group = divmod(number, 99)
    return f"{area + 1 + (area >= 665):03}-{group + 1:02}-{serial + 1:04}"


def iban_pseudonym(text: str, key: bytes) -> str:
    """The account part permuted, the check digits set right."""
    body = word_pseudonym(text[4:], key, "iban|" + text[:2])
    check = 98 - int("".join(str(int(c, 36)) for c in body + text[:2] + "00")) % 97
    return f"{text[:2]}{check:02}{body}"


_REPLACE = {k.name: k.replace or iban_pseudonym for k in KINDS}
_VALID = {k.name: k.valid for k in KINDS}
_ANY = re.compile("|".join(f"(?P<{k.name}>{k.pattern})" for k in KINDS))
# Every kind has a digit or an @; a text without both is left at once.
_HINT = re.compile(r"[0-9@]")


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind it had."""
    if text is None or not _HINT.search(text):
        return text, {}
    found: Counter[str] = Counter()

    def new(match: re.Match) -> str:
        kind, value = match.lastgroup, match[0]
        if _VALID[kind] and not _VALID[kind](value):
            return value
        found[kind] += 1
        return _REPLACE[kind](value, key)

    return _ANY.sub(new, text), dict(found)


def pseudonymise_texts(df: DataFrame, key: bytes, text: str = "text", counts: str | None = "pii_counts") -> DataFrame:
    """``df`` with personal data in ``text`` replaced, and ``counts``: a map from the kind to
    how many values were replaced (none of these columns for ``counts=None``).

    Row-local: no shuffle; all other columns stay as they are. A null text stays null, an
    empty one empty; repeated rows get equal results; an empty table stays empty. A column
    of ``df`` with the name ``counts`` is an error.
    """
    if counts in df.columns:
        raise ValueError(f"the table has a column {counts} already")
    schema = df.schema if counts is None else df.withColumn(counts, F.lit(None).cast("map<string,int>")).schema
    at = df.columns.index(text)

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [pseudonymise(t, key) for t in batch.column(at).to_pylist()]
            arrays = list(batch.columns)
            arrays[at] = pa.array([t for t, _ in done], pa.string())
            names = list(batch.schema.names)
            if counts is not None:
                arrays.append(pa.array([list(c.items()) for _, c in done], pa.map_(pa.string(), pa.int32())))
                names.append(counts)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.mapInArrow(replace, schema)
