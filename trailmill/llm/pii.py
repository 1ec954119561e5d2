"""Format-preserving pseudonyms for personal data.

Every value found is checked (Luhn, mod 97, calendar, number-plan and range rules),
ranked within the set of all valid values of its format, moved to another rank by a keyed
Feistel permutation, and written back in the same format.  The permutation depends on the
key and the kind only, so equal values stay equal across documents and different values
stay different; the separators, the length and the validity of a value are kept (the
length of a date without leading zeros may change).

Kinds: payment card, IBAN, US social security number, phone number, IPv4 address, date,
e-mail address, and credential-shaped strings (access keys, assigned secrets).  Numbers
that fail their check, version numbers and other text are left alone, as are dates before
1900 or after 2099 and months of languages other than those in `MONTH_NAMES`; what is written
`+1 (ddd) ddd-dddd`, with the `+1` or the brackets, is a phone number whether the number
plan has it or not, and every address but 0.0.0.0 and 127.0.0.1 is moved.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmill.llm.textkeys import lean
from trailmill.session import bounded_batches

KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email", "secret")
ROUNDS = 8


class Permuter:
    """A keyed permutation of range(size) for any size, by a Feistel network on bits.

    Values outside range(size), and those that `valid` refuses, are walked through again,
    so the result is a permutation of the valid values alone.
    """

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.known: dict[tuple, int] = {}

    def _once(self, value: int, half: int, tweak: bytes) -> int:
        mask = (1 << half) - 1
        left, right = value >> half, value & mask
        wide = (half + 7) // 8
        for k in range(ROUNDS):
            part = b""
            while len(part) < wide:
                part += hashlib.blake2b(
                    right.to_bytes(wide, "big"), key=self.key, digest_size=min(64, max(wide, 8)),
                    salt=k.to_bytes(8, "big") + len(part).to_bytes(8, "big"), person=tweak[:16],
                ).digest()
            left, right = right, left ^ (int.from_bytes(part[:wide], "big") & mask)
        return (left << half) | right

    def __call__(self, value: int, size: int, tweak: str, valid: Callable[[int], bool] | None = None) -> int:
        at = (value, size, tweak)
        if at not in self.known:
            half = max(1, ((size - 1).bit_length() + 1) // 2)
            label = hashlib.blake2b(f"{tweak}/{size}".encode(), digest_size=16).digest()
            new = self._once(value, half, label)
            while new >= size or (valid is not None and not valid(new)):
                new = self._once(new, half, label)
            if len(self.known) > 100_000:  # a cache of work, not of results
                self.known.clear()
            self.known[at] = new
        return self.known[at]


def luhn_digit(digits: str) -> str:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def fill(pattern: str, digits: str) -> str:
    """The digits of `pattern` replaced, one by one; the rest as it is."""
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), pattern)


CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
HEX = "0123456789abcdef"


def spelled(text: str, permute: Permuter, tweak: str) -> str:
    """A string moved within the strings of the same character classes, place by place."""
    used = [next((c for c in CLASSES if ch in c), "") for ch in text]
    rank, size = 0, 1
    for ch, c in zip(text, used):
        if c:
            rank, size = rank * len(c) + c.index(ch), size * len(c)
    if size == 1:
        return text
    shape = re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", text)))
    rank, out = permute(rank, size, f"{tweak}:{shape}"), []
    for ch, c in zip(reversed(text), reversed(used)):
        if c:
            rank, k = divmod(rank, len(c))
            ch = c[k]
        out.append(ch)
    return "".join(reversed(out))


def hexadecimal(text: str, permute: Permuter, tweak: str) -> str:
    """The same within lower-case hexadecimal strings that have both digits and letters."""
    mixed = lambda n: not (s := f"{n:0{len(text)}x}").isdigit() and not s.isalpha()
    return f"{permute(int(text, 16), 16 ** len(text), f'{tweak}:hex', mixed):0{len(text)}x}"


def card(text: str, permute: Permuter) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or digits[0] not in "23456" or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = digits[1:-1]
    body = digits[0] + str(permute(int(body), 10 ** len(body), f"card{digits[0]}{len(digits)}")).zfill(len(body))
    return fill(text, body + luhn_digit(body))


def iban(text: str, permute: Permuter) -> str | None:
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return None
    number = lambda s: int("".join(str(int(ch, 36)) for ch in s))
    if number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = spelled(plain[4:], permute, f"iban{plain[:2]}")
    new = iter(f"{plain[:2]}{98 - number(body + plain[:2] + '00') % 97:02d}{body}")
    return "".join(ch if ch == " " else next(new) for ch in text)


def _valid_ssn(n: int) -> bool:
    area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def ssn(text: str, permute: Permuter) -> str | None:
    value = int(re.sub(r"\D", "", text))
    return fill(text, f"{permute(value, 10**9, 'ssn', _valid_ssn):09d}") if _valid_ssn(value) else None


def _valid_phone(n: int) -> bool:
    return n // 10**9 >= 2 and n // 10**6 % 10 >= 2


def phone(text: str, permute: Permuter) -> str | None:
    """North American numbers, those of the number plan among themselves and the others among
    themselves; other international ones keep the first two digits."""
    digits = re.sub(r"\D", "", text)
    if text.startswith("+") and not digits.startswith("1"):
        if not 8 <= len(digits) <= 15:
            return None
        rest = digits[2:]
        return fill(text, digits[:2] + str(permute(int(rest), 10 ** len(rest), f"phone{digits[:2]}{len(rest)}")).zfill(len(rest)))
    lead, local = digits[:-10], digits[-10:]
    if lead not in ("", "1") or len(local) != 10:
        return None
    if _valid_phone(int(local)):
        return fill(text, lead + str(permute(int(local), 10**10, "phone", _valid_phone)))
    return fill(text, lead + str(permute(int(local), 10**10, "phone-other", lambda n: not _valid_phone(n))).zfill(10))


#: Blocks whose addresses stay within the block: its first address and the bits that vary.
BLOCKS = [
    (int.from_bytes(bytes(net), "big"), bits)
    for net, bits in [((10, 0, 0, 0), 24), ((172, 16, 0, 0), 20), ((192, 168, 0, 0), 16), ((169, 254, 0, 0), 16), ((0, 0, 0, 0), 24), ((127, 0, 0, 0), 24), ((224, 0, 0, 0), 28), ((240, 0, 0, 0), 28)]
]


STILL = {0, 0x7F000001}


def _ip_block(n: int) -> tuple[int, int] | None:
    return next((x for x in BLOCKS if n >> x[1] == x[0] >> x[1]), None)


def ip(text: str, permute: Permuter) -> str | None:
    """Public addresses stay public, others in their block; 127.0.0.1 and 0.0.0.0 are left alone."""
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(p != str(int(p)) for p in text.split(".")):
        return None
    value = int.from_bytes(bytes(parts), "big")
    if value in STILL:
        return None
    if block := _ip_block(value):  # walking through all addresses would be long: the block's part alone
        first, bits = block
        low = permute(value - first, 1 << bits, f"ip{first >> 24}/{bits}", lambda n: first | n not in STILL)
        return ".".join(str(x) for x in (first | low).to_bytes(4, "big"))
    new = permute(value, 1 << 32, "ip", lambda n: _ip_block(n) is None)
    return ".".join(str(x) for x in new.to_bytes(4, "big"))


FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
# Months of the corpora's languages, whole and short, January first.
MONTH_NAMES = [
    ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"],
    ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"],
    ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"],
    ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"],
    ["enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"],
]
_MONTH = "(?:" + "|".join(sorted({re.escape(m) for names in MONTH_NAMES for m in names}, key=lambda m: (-len(m), m))) + ")"
#: name in lower case -> (list it is from, month); the first list that has a name wins.
MONTHS = {name.lower(): (names, k + 1) for names in reversed(MONTH_NAMES) for k, name in enumerate(names)}


def _late(n: int) -> bool:
    return datetime.date.fromordinal(FIRST + n).day > 12


def _moved_day(year: int, month: int, day: int, permute: Permuter) -> datetime.date | None:
    """Another day from 1900 to 2099.

    Days after the twelfth are moved among themselves, as are the others: the pseudonym
    of a date that can only be read day first, or of one that can't, is then read the same
    way, and a date has one pseudonym in whatever format it is written.
    """
    try:
        value = datetime.date(year, month, day).toordinal() - FIRST
    except ValueError:
        return None
    size = LAST - FIRST + 1
    if not 0 <= value < size:
        return None
    late = day > 12
    return datetime.date.fromordinal(FIRST + permute(value, size, "date13" if late else "date12", lambda n: _late(n) == late))


def date(text: str, permute: Permuter) -> str | None:
    """Numeric dates, year first or last; the first number is the day where it can't be a month.

    Days and months stay without leading zeros where one of them has a single digit.
    """
    numbers = re.findall(r"\d+", text)
    wide = 1 if min(map(len, numbers)) == 1 else 2
    one, two, three = map(int, numbers)
    if len(numbers[0]) == 4:
        new = _moved_day(one, two, three, permute)
        parts = new and (f"{new.year:04d}", f"{new.month:0{wide}d}", f"{new.day:0{wide}d}")
    elif one > 12:
        new = _moved_day(three, two, one, permute)
        parts = new and (f"{new.day:0{wide}d}", f"{new.month:0{wide}d}", f"{new.year:04d}")
    else:
        new = _moved_day(three, one, two, permute)
        parts = new and (f"{new.month:0{wide}d}", f"{new.day:0{wide}d}", f"{new.year:04d}")
    if new is None:
        return None
    it = iter(parts)
    return re.sub(r"\d+", lambda _: next(it), text)


def named_date(text: str, permute: Permuter) -> str | None:
    """Dates with a month's name: `4 March 2021`, `March 4, 2021`, `14. März 2021`, `4 de marzo de 2021`.

    The month keeps its language, its length (whole or short) and its case; a day that is
    written with two digits stays so.
    """
    word = re.search(_MONTH, text, re.I)[0]
    day, year = re.findall(r"\d+", text)
    names, month = MONTHS[word.lower()]
    new = _moved_day(int(year), month, int(day), permute)
    if new is None:
        return None
    name = names[new.month - 1]
    name = name.upper() if word.isupper() else name.lower() if word.islower() else name[0].upper() + name[1:]
    numbers = iter([f"{new.day:0{2 if day.startswith('0') else 1}d}", f"{new.year:04d}"])
    return re.sub(r"\d+", lambda _: next(numbers), text).replace(word, name, 1)


def email(text: str, permute: Permuter) -> str | None:
    """Local part and all domain labels but the last."""
    local, _, domain = text.partition("@")
    labels = domain.split(".")
    return f"{spelled(local, permute, 'mail')}@{'.'.join([*(spelled(x, permute, 'host') for x in labels[:-1]), labels[-1]])}"


def secret(text: str, permute: Permuter) -> str | None:
    head = re.match(r"(?:AKIA|ASIA|ghp_|gho_|sk-|xox[bp]-)", text)
    keep = head[0] if head else ""
    rest = text[len(keep) :]
    if not set(rest) - set(HEX) and not rest.isdigit() and not rest.isalpha():
        return keep + hexadecimal(rest, permute, f"secret{keep}")
    return keep + spelled(rest, permute, f"secret{keep}")


#: kind, pattern, function; earlier kinds win where spans meet.  A group marks the part to change.
RULES: list[tuple[str, re.Pattern, Callable[[str, Permuter], str | None]]] = [
    ("email", re.compile(r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w@])", re.A), email),
    ("secret", re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[po]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[bp]-[A-Za-z0-9-]{20,})(?![A-Za-z0-9])"), secret),
    ("secret", re.compile(r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?([A-Za-z0-9+/_-]{12,})"), secret),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), iban),
    ("date", re.compile(r"(?<![\w./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?!(?!T\d)[\w/-]|\.\d)"), date),
    ("date", re.compile(rf"(?<!\w)(?:\d{{1,2}}(?:\.? | de ){_MONTH}(?: | de |, )\d{{4}}|{_MONTH} \d{{1,2}}, \d{{4}})(?!\w)", re.I), named_date),
    ("card", re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:([ -])\d{4})(?:\1\d{4}){2}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{5})(?![\w-])"), card),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), ssn),
    ("phone", re.compile(r"(?<![\w.+-])(?:(?:\+?1[ .-]?)?\(\d{3}\) ?\d{3}|\+1[ .-]?\d{3}[ .-]\d{3}|(?:1[ .-]?)?[2-9]\d{2}[ .-][2-9]\d{2})[ .-]\d{4}(?![\w-])"), phone),
    ("phone", re.compile(r"(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?![\w-])"), phone),
    ("ip", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"), ip),
]


def pseudonymise(text: str, permute: Permuter) -> tuple[str, dict[str, int]]:
    """The text with every value replaced, and how many of each kind."""
    taken: list[tuple[int, int, str, str]] = []
    digits = re.search(r"\d", text) is not None
    for kind, pattern, change in RULES:
        if kind == "email" and "@" not in text or kind != "secret" and kind != "email" and not digits:
            continue
        for match in pattern.finditer(text):
            group = match.lastindex if kind == "secret" and match.lastindex else 0
            a, b = match.span(group)
            if any(a < y and x < b for x, y, _, _ in taken):
                continue
            if (new := change(match.group(group), permute)) is not None:
                taken.append((a, b, kind, new))
    if not taken:
        return text, {}
    counts: dict[str, int] = {}
    out, at = [], 0
    for a, b, kind, new in sorted(taken):
        out += [text[at:a], new]
        at = b
        counts[kind] = counts.get(kind, 0) + 1
    return "".join([*out, text[at:]]), counts


#: A cheap sign, searched by the JVM, that a text can hold any of the above.
SIGN = r"[0-9@]|(?i)(?:password|passwd|pwd|secret|token|api[_-]?key)|sk-|xox|AKIA|ASIA|gh[po]_"


def _replace(key: bytes):
    def run(batches):
        permute = Permuter(key)
        for batch in batches:
            names = batch.schema.names
            new, kinds = [], []
            for text, look in zip(batch.column("text").to_pylist(), batch.column("_look").to_pylist()):
                out, counts = pseudonymise(text, permute) if look else (text, {})
                new.append(out)
                kinds.append(sorted(counts.items()))
            columns = [pa.array(new, pa.string()) if c == "text" else batch.column(c) for c in names if c != "_look"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kinds, pa.map_(pa.string(), pa.int32()))], names=[*(c for c in names if c != "_look"), "pii"])

    return run


def pseudonymise_documents(docs: DataFrame, key: bytes = b"trailmill") -> DataFrame:
    """`docs` with `text` pseudonymised and `pii`, a map of kind to number of values.

    A production run passes its own secret `key`; the same key links values across runs.
    A null text stays null with an empty map; a column named `pii` or `_look` in the input
    is replaced.  Work is by row, so nothing is shuffled.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("pii", "_look")
    ready = docs.withColumn("_look", F.coalesce(F.col("text").rlike(SIGN), F.lit(False)))
    schema = T.StructType([*docs.schema.fields, T.StructField("pii", T.MapType(T.StringType(), T.IntegerType()))])
    return ready.mapInArrow(lean(_replace(key)), schema)
