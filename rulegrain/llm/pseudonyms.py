"""Personal data: format-preserving pseudonyms from a keyed Feistel permutation.

A value that passes its kind's validation is mapped to a number, the number is permuted within the
kind's range, and the result is written in the value's own format. The permutation is a Feistel network
over the smallest even number of bits that holds the range, walked until it lands in the range and
passes the validation again. So equal values have equal pseudonyms in all documents, different ones
have different ones, and a value written in two formats stays linked.

A card is looked for among all rows of whole digit groups in a run of digits, as other numbers may stand
beside it, and an account number ends where its country's length does.

Everything happens in a document's row; no shuffle.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import prepare_workers, quoted, slices, without

ROUNDS = 8
DEMO_KEY = b"replace with a secret"
_FIRST_DAY, _DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()
#: Addresses of each of these blocks keep their block.
_BLOCKS = [(0x0A000000, 8), (0x7F000000, 8), (0xA9FE0000, 16), (0xAC100000, 12), (0xC0A80000, 16), (0xE0000000, 3), (0, 8)]
#: Lengths of account numbers by country, as published in the registry of the format.
_IBAN = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}


class Permutation:
    """A keyed permutation of range(size) for each name."""

    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _mask(self, name: str, size: int, half: int, i: int, value: int) -> int:
        digest = hashlib.blake2b(f"{name}:{size}:{i}:{value}".encode(), key=self.key, digest_size=64).digest()
        while len(digest) * 8 < half:
            digest += hashlib.blake2b(digest, key=self.key, digest_size=64).digest()
        return int.from_bytes(digest, "big") & ((1 << half) - 1)

    def _once(self, name: str, size: int, value: int) -> int:
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        left, right = value >> half, value & ((1 << half) - 1)
        for i in range(ROUNDS):
            left, right = right, left ^ self._mask(name, size, half, i, right)
        return left << half | right

    def _back(self, name: str, size: int, value: int) -> int:
        half = max(1, ((size - 1).bit_length() + 1) // 2)
        left, right = value >> half, value & ((1 << half) - 1)
        for i in reversed(range(ROUNDS)):
            left, right = right ^ self._mask(name, size, half, i, left), left
        return left << half | right

    def moved(self, name: str, size: int, value: int) -> int:
        """The image of a value under a permutation of range(size) that leaves no value where it is.

        It steps along a circle of all values whose order the key gives.
        """
        value = (self.of(name, size, value) + 1) % size
        value = self._back(name, size, value)
        while value >= size:
            value = self._back(name, size, value)
        return value

    def of(self, name: str, size: int, value: int, fits: Callable[[int], bool] = lambda _: True) -> int:
        """The image of a value that fits, among the numbers below ``size`` that fit."""
        value = self._once(name, size, value)
        while value >= size or not fits(value):
            value = self._once(name, size, value)
        return value


def luhn_digit(digits: str) -> int:
    """The check digit that goes after ``digits``."""
    total = sum(sum(divmod(int(d) * (1 + (i % 2 == 0)), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _refill(text: str, digits: str) -> str:
    """``text`` with its digits replaced in order."""
    following = iter(digits)
    return "".join(next(following) if "0" <= c <= "9" else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _card(text: str, p: Permutation) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or digits[0] not in "23456" or luhn_digit(digits[:-1]) != int(digits[-1]):
        return None
    inner = p.of("card", 10 ** (len(digits) - 2), int(digits[1:-1]))
    body = digits[0] + str(inner).zfill(len(digits) - 2)
    return _refill(text, body + str(luhn_digit(body)))


def _phone(text: str, p: Permutation) -> str | None:
    digits = _digits(text)
    north_american = not text.startswith("+") or digits[0] == "1" and len(digits) == 11
    if north_american:
        valid = lambda n: str(n).zfill(10)[0] > "1" and str(n).zfill(10)[3] > "1"
        head, body = digits[:-10], digits[-10:]
        if len(digits) not in (10, 11) or head not in ("", "1"):
            return None
        like = valid(int(body))  # a number that can't be dialled counts only if it is plainly written as a phone number
        if not like and not {"+", "("} & set(text):
            return None
        return _refill(text, head + str(p.of("phone", 10**10, int(body), lambda n: valid(n) == like)).zfill(10))
    head, body = digits[:2], digits[2:]
    if not 8 <= len(digits) <= 15:
        return None
    return _refill(text, head + str(p.of("phone+" + head, 10 ** len(body), int(body))).zfill(len(body)))


def _ssn(text: str, p: Permutation) -> str | None:
    def valid(n: int) -> bool:
        s = str(n).zfill(9)
        return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

    number = int(_digits(text))
    return _refill(text, str(p.of("ssn", 10**9, number, valid)).zfill(9)) if valid(number) else None


def _block(number: int) -> int:
    return next((i for i, (base, bits) in enumerate(_BLOCKS) if number >> (32 - bits) == base >> (32 - bits)), -1)


def _address(text: str, p: Permutation) -> str | None:
    parts = [int(x) for x in text.split(".")]
    if max(parts) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    number = int.from_bytes(bytes(parts), "big")
    block = _block(number)
    if block < 0:
        found = p.of("ip", 1 << 32, number, lambda n: _block(n) < 0)
    else:
        base, bits = _BLOCKS[block]
        found = base | p.of(f"ip{block}", 1 << (32 - bits), number & ((1 << (32 - bits)) - 1), lambda n: _block(base | n) == block)
    return ".".join(map(str, found.to_bytes(4, "big")))


def _date(text: str, p: Permutation) -> str | None:
    parts = re.split(r"[-/.]", text)
    year_first = len(parts[0]) == 4
    numbers = [int(x) for x in parts]
    orders = [(0, 1, 2)] if year_first else [(2, 1, 0), (2, 0, 1)]  # day first, else month first
    for order in orders:
        try:
            day = datetime.date(*(numbers[i] for i in order)).toordinal() - _FIRST_DAY
        except ValueError:
            continue
        if not 0 <= day < _DAYS:
            continue
        short = any(len(parts[i]) == 1 for i in order[1:])

        def written(n: int) -> str:
            date = datetime.date.fromordinal(_FIRST_DAY + n)
            values = dict(zip(order, (f"{date.year:04d}", f"{date.month}" if short else f"{date.month:02d}", f"{date.day}" if short else f"{date.day:02d}")))
            sign = text[len(parts[0])]
            return sign.join(values[i] for i in range(3))

        fits = lambda n: order != (2, 0, 1) or datetime.date.fromordinal(_FIRST_DAY + n).day > 12
        return written(p.of("date", _DAYS, day, lambda n: n < _DAYS and fits(n)))
    return None


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _iban(text: str, p: Permutation) -> str | None:
    plain = text.replace(" ", "")
    if _IBAN.get(plain[:2]) != len(plain) or _iban_rest(plain) != 1:
        return None
    body = _permuted(plain[4:], "iban" + plain[:2], p)
    whole = plain[:2] + f"{98 - _iban_rest(plain[:2] + '00' + body):02d}" + body
    following = iter(whole)
    return "".join(" " if c == " " else next(following) for c in text)


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _permuted(text: str, name: str, p: Permutation, moved: bool = False) -> str:
    """Letters and digits permuted within their classes at each place; other characters stay.

    With ``moved`` no text that has any of them is its own image.
    """
    classes = [next((c for c in _CLASSES if x in c), None) for x in text]
    size, number = 1, 0
    for x, c in zip(text, classes):
        if c:
            size, number = size * len(c), number * len(c) + c.index(x)
    shape = "".join("-" if c is None else c[0] for c in classes)
    if size > 1:
        number = (p.moved if moved else p.of)(f"{name}:{shape}", size, number)
    found = []
    for x, c in zip(reversed(text), reversed(classes)):
        if c:
            number, at = divmod(number, len(c))
            x = c[at]
        found.append(x)
    return "".join(reversed(found))


def _email(text: str, p: Permutation) -> str | None:
    local, _, domain = text.rpartition("@")
    hidden = _permuted(local, "email@" + domain.lower(), p, moved=True)
    if hidden == local:  # neither letters nor digits: all such names stay, so the domain's first label hides them
        label, dot, rest = domain.partition(".")
        return f"{hidden}@{_permuted(label, 'domain', p, moved=True)}{dot}{rest}"
    return f"{hidden}@{domain}"


def _account(country: str) -> str:
    """The pattern of a country's account numbers, which ends where the number does, whatever follows."""
    fours, rest = divmod(_IBAN[country] - 4, 4)
    return f"{country}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


#: Kinds in order of precedence: where a text must have which character, the pattern, the validation and rewriting.
KINDS: tuple[tuple[str, str, re.Pattern, Callable[[str, Permutation], str | None]], ...] = (
    ("email", "@", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), _email),
    ("iban", "", re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(map(_account, _IBAN))})(?![A-Za-z0-9])"), _iban),
    ("card", "", re.compile("[0-9]+(?:[ -][0-9]+)*"), _card),
    ("date", "", re.compile(r"(?<![0-9.])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?!\.?[0-9])"), _date),
    ("ssn", "-", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), _ssn),
    ("ip", ".", re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"), _address),
    (
        "phone", "",
        re.compile(r"(?<![0-9+])(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5})(?![0-9])"),
        _phone,
    ),
)
_DIGIT = re.compile("[0-9]")
_GROUP = re.compile("[0-9]+")
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
#: Kinds whose values beside each other look like oddly grouped cards.
_GROUPED = ("date", "ssn", "phone")


def _card_rank(sizes: tuple[int, ...], signs: set[str], digits: str) -> tuple[bool, bool, int]:
    """Smaller for numbers written as cards are, then for the issuer's usual length, then for longer ones."""
    written = len(signs) < 2 and (set(sizes[:-1]) <= {4} and (len(sizes) == 1 or sizes[-1] <= 4) or sizes in ((4, 6, 5), (4, 6, 4)))
    usual = {"34": 15, "37": 15, "30": 14, "36": 14, "38": 14}.get(digits[:2], 16)
    return not written, len(digits) != usual, -len(digits)


def _runs_of_groups(run: re.Match) -> Iterator[tuple[tuple[bool, bool, int], int, int]]:
    """Rank and place of each row of whole digit groups in a run that has a card's length, first digit and check digit."""
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(run.string, run.start(), run.end())]
    digits = _digits(run[0])
    # the sums to each place, with the digits at even and at odd places doubled
    sums = [list(accumulate((_DOUBLED[int(d)] if i % 2 == odd else int(d) for i, d in enumerate(digits)), initial=0)) for odd in (0, 1)]
    places = list(accumulate((b - a for a, b in groups), initial=0))
    for i, (start, _) in enumerate(groups):
        at = places[i]
        if digits[at] not in "23456":
            continue
        for j in range(i, len(groups)):
            end = places[j + 1]
            if end - at > 19:
                break
            if end - at >= 13 and (sums[end % 2][end] - sums[end % 2][at]) % 10 == 0:
                sizes = tuple(b - a for a, b in groups[i : j + 1])
                signs = {run.string[b] for _, b in groups[i:j]}
                yield _card_rank(sizes, signs, digits[at:end]), start, groups[j][1]


class _Places:
    """Places (start, end) that do not overlap, in any order."""

    def __init__(self, places: Iterator[tuple[int, int]]) -> None:
        self.places = sorted(places)

    def touch(self, start: int, end: int) -> bool:
        at = bisect_left(self.places, (end, end))
        return at > 0 and self.places[at - 1][1] > start


def _cards(text: str, pattern: re.Pattern, taken: list[tuple[int, int]], others: Callable[[], list[Iterator[tuple[int, int]]]]) -> list[tuple[int, int]]:
    """Places of cards among the digit groups of each run, whatever other numbers stand beside them.

    A row of groups that is not written as cards are does not count where it would cut a value of ``others``.
    Of rows that overlap the one with the smallest rank counts, then the first.
    """
    rows = []
    for run in pattern.finditer(text):
        if run.end() - run.start() >= 13:
            rows += _runs_of_groups(run)
    if not rows:
        return []
    held = _Places(iter(taken))
    rows = sorted(row for row in rows if not held.touch(*row[1:]))
    if any(rank[0] for rank, _, _ in rows):
        other = [_Places(places) for places in others()]
        rows = [row for row in rows if not row[0][0] or not any(o.touch(*row[1:]) for o in other)]
    used, found = bytearray(len(text)), []
    for _, start, end in rows:
        if not any(used[start:end]):
            used[start:end] = b"\1" * (end - start)
            found.append((start, end))
    return sorted(found)


def _next_after_failure(text: str, pattern: re.Pattern, fits: Callable[[str], bool]) -> Iterator[tuple[int, int]]:
    """Places of the matches that fit; after one that does not, the search goes on inside it."""
    at = 0
    while match := pattern.search(text, at):
        good = fits(match[0])
        if good:
            yield match.span()
        at = match.end() if good else match.start() + 1


def hide(text: str, p: Permutation, known: dict[tuple[str, str], str | None] | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with pseudonyms, and the spans (start, end, kind) of the values, in characters of the original."""
    known = {} if known is None else known
    if "@" not in text and not _DIGIT.search(text):
        return text, []

    def image(kind: str, value: str, rewrite: Callable[[str, Permutation], str | None]) -> str | None:
        if (kind, value) not in known:
            if len(known) > 100_000:
                known.clear()
            known[kind, value] = rewrite(value, p)
        return known[kind, value]

    def plain(kind: str, pattern: re.Pattern, rewrite: Callable[[str, Permutation], str | None]) -> Iterator[tuple[int, int]]:
        return (m.span() for m in pattern.finditer(text) if image(kind, m[0], rewrite) is not None)

    found: list[tuple[int, int, str, str]] = []
    for kind, needed, pattern, rewrite in KINDS:
        if needed not in text:
            continue
        if kind == "card":
            grouped = lambda: [plain(k, q, r) for k, _, q, r in KINDS if k in _GROUPED]
            places = _cards(text, pattern, [row[:2] for row in found], grouped)
        elif kind == "iban":
            places = _next_after_failure(text, pattern, lambda value: image("iban", value, _iban) is not None)
        else:
            places = plain(kind, pattern, rewrite)
        found = _without_overlap(found, [(a, b, kind, image(kind, text[a:b], rewrite)) for a, b in places])
    parts, at = [], 0
    for start, end, _, value in found:
        parts += [text[at:start], value]
        at = end
    return "".join([*parts, text[at:]]), [(s, e, k) for s, e, k, _ in found]


def _without_overlap(found: list[tuple], new: list[tuple]) -> list[tuple]:
    """Both lists in order, without those of ``new`` that overlap one of ``found``."""
    merged, i = [], 0
    for row in new:
        while i < len(found) and found[i][1] <= row[0]:
            merged.append(found[i])
            i += 1
        if i == len(found) or row[1] <= found[i][0]:
            merged.append(row)
    return merged + found[i:]


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """``docs`` with the text rewritten and the column pii_spans (array of start, end, kind), which replaces one of that name.

    Defined results: a null text stays null and has no spans; all other columns stay as they are, and a
    text without values stays as it is. Spans are in characters of the original text; where kinds
    overlap, the one listed first in KINDS counts. Whole texts are read; rows stay where they are.
    """
    prepare_workers(docs.sparkSession)

    def rewritten(text: pa.Array) -> pa.Array:
        p, known, rows = Permutation(key), {}, []
        for part in slices([pa.RecordBatch.from_arrays([text], ["text"])], "text"):
            for body in part.column("text").to_pylist():
                new, spans = (None, []) if body is None else hide(body, p, known)
                rows.append({"text": new, "spans": [{"start": s, "end": e, "kind": k} for s, e, k in spans]})
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        return pa.array(rows, pa.struct([("text", pa.string()), ("spans", spans)]))

    udf = F.arrow_udf(rewritten, "text string, spans array<struct<start:int,end:int,kind:string>>")
    others = without(docs, "pii_spans")
    found = docs.select(*others, udf(quoted(text_col)).alias("__hidden"))
    kept = [F.col("__hidden.text").alias(c) if c == text_col else quoted(c) for c in docs.columns if c.lower() != "pii_spans"]
    return found.select(*kept, F.col("__hidden.spans").alias("pii_spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its values hidden, and which kinds of values stood where."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    place = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    found = pseudonymise(docs, DEMO_KEY)
    return found.select(
        "doc_id", "text", F.size("pii_spans").cast("bigint").alias("n_pii"), F.array_join(F.transform("pii_spans", place), ",").alias("spans")
    )
