"""PII: format-preserving Feistel pseudonyms.

Validated numbers, dates and names of mailboxes are permuted, by a key, within their own format: equal values get equal
pseudonyms in every document, different ones different pseudonyms, and checks (Luhn, IBAN, calendar) hold again.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from brevispark.llm.common import map_rows, named

ROUNDS = 10
#: Numbers of more bits are written in hexadecimal (Python writes no long decimals), texts of more bytes enter a round by
#: their digest, and remainders by powers of two are masks, so the work grows as the length of a value.
LONG_NUMBER, LONG_TEXT = 4096, 4096
_DIGITS, _HEX = "0123456789", "0123456789abcdef"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _mod(x: int, n: int) -> int:
    return x % n if n & (n - 1) else x & (n - 1)


class Feistel:
    """Keyed permutations of [0, n), alternating unbalanced Feistel rounds over two factors that cover n, with cycle walking."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a key is needed")
        self.key = key if len(key) <= 64 else hashlib.blake2b(key).digest()

    def _round(self, tweak: bytes, i: int, x: int, n: int) -> int:
        """Pseudo-random, with 128 bits more than n needs, however large n is. Long texts enter by their digest."""
        text, size, out, made = tweak + b"|%d|%x" % (i, x), n.bit_length() + 128, [], 0
        if len(text) > LONG_TEXT:
            text = hashlib.blake2b(text, key=self.key, digest_size=64).digest()
        while 8 * made < size:
            out.append(hashlib.blake2b(b"%d|" % made + text, key=self.key, digest_size=64).digest())
            made += 64
        return _mod(int.from_bytes(b"".join(out), "big"), n)

    def permute(self, value: int, n: int, tweak: str) -> int:
        return self._walk(value, n, tweak, self._once)

    def invert(self, value: int, n: int, tweak: str) -> int:
        return self._walk(value, n, tweak, self._back)

    @staticmethod
    def _walk(value: int, n: int, tweak: str, step) -> int:
        if not 0 <= value < n:
            raise ValueError("value outside its domain")
        half = ((n - 1).bit_length() + 1) // 2
        b = -(-n >> half)
        size = b"%d" % n if n.bit_length() <= LONG_NUMBER else b"0x%x" % n
        while True:
            value = step(value, half, b, tweak.encode() + b"|" + size)
            if value < n:
                return value

    def _once(self, x: int, half: int, b: int, tweak: bytes) -> int:
        a = 1 << half
        left, right = _mod(x, a), x >> half
        for i in range(0, ROUNDS, 2):
            left = _mod(left + self._round(tweak, i, right, a), a)
            right = _mod(right + self._round(tweak, i + 1, left, b), b)
        return right << half | left

    def _back(self, x: int, half: int, b: int, tweak: bytes) -> int:
        a = 1 << half
        left, right = _mod(x, a), x >> half
        for i in reversed(range(0, ROUNDS, 2)):
            right = _mod(right - self._round(tweak, i + 1, left, b), b)
            left = _mod(left - self._round(tweak, i, right, a), a)
        return right << half | left


def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return -total % 10


def is_card(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == int(digits[-1]) and len(set(digits)) > 1


def iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97


# The digits of each kind: (pattern, name). The first that matches at a place is taken.
KINDS = [
    ("email", r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,63}(?![\w-])"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("secret", r"(?i:(?:token|secret|password|passwd|api[_-]?key|key)[\"']?\s*[=:]\s*[\"']?)(?P<hex>[0-9A-Fa-f]{24,})(?![0-9A-Za-z])"),
    ("access", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("date", r"(?<![\d.-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d./-])\d{2}([./])\d{2}\1\d{4}(?![\d/])"),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\w+])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?![\d-])|(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?![\d-])|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?![\d-])"
     r"|(?<![\w.+-])[2-9]\d{2}([ .-])[2-9]\d{2}\2\d{4}(?![\w-])|(?<![\w.+-])0\d{2,4}[ /-]\d{6,8}(?![\w-])"),
    ("card", r"(?<![\d.])(?<!\D-)\d(?:[ -]?\d){12,18}(?!\d|-(?!\d))"),
]
_MARKS = {r"([./])": r"(?P<sep>[./])", r"\1": r"(?P=sep)", r"([ .-])": r"(?P<gap>[ .-])", r"\2": r"(?P=gap)"}


def _joined() -> re.Pattern:
    """All kinds in one pattern, each in a group of its name; numbered groups within them get names."""
    parts = []
    for kind, pattern in KINDS:
        for old, new in _MARKS.items():
            pattern = pattern.replace(old, new)
        parts.append(f"(?P<{kind}>{pattern})")
    return re.compile("|".join(parts))


_ANY = _joined()
_NAMES = [k for k, _ in KINDS]
_MAYBE = re.compile(r"[\d@]")
_RUN = re.compile(r"\d(?:[ -]?\d)*")
#: How cards are written, the likeliest first; one group is a card of 13 to 19 digits without separators.
LAYOUTS = [(4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 4, 4, 3)]
ISSUERS = re.compile(r"4|5|3[0-9]|6|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)")
IBAN_LENGTHS = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FO,GL,NL,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV,SD "
    "29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
).split()) for c in cs.split(",")}


def _refill(shape: str, new: str, alphabet: str = _DIGITS) -> str:
    """shape with its characters of alphabet replaced, in order, by those of new."""
    it = iter(new)
    return "".join(next(it) if c in alphabet else c for c in shape)


def _days(text: str) -> tuple[datetime.date, str]:
    """The date and its format: year-month-day, else day-month-year, and month-day-year only where the other is no date."""
    if text[4] == "-":
        return datetime.date(int(text[:4]), int(text[5:7]), int(text[8:])), "%Y-%m-%d"
    a, b, year, mark = int(text[:2]), int(text[3:5]), int(text[6:]), text[2]
    if b > 12:
        return datetime.date(year, a, b), f"%m{mark}%d{mark}%Y"
    return datetime.date(year, b, a), f"%d{mark}%m{mark}%Y"


class Pseudonyms:
    """pseudonym(kind, value) is the permuted value, or None if the value fails its kind's check."""

    FIRST, DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days

    def __init__(self, key: bytes, invert: bool = False):
        f = Feistel(key)
        self.p = f.invert if invert else f.permute

    def _number(self, digits: str, tweak: str) -> str:
        return str(self.p(int(digits), 10 ** len(digits), f"{tweak}{len(digits)}")).zfill(len(digits))

    def pseudonym(self, kind: str, value: str) -> str | None:
        """Digits of other scripts count, and are written, as 0 to 9."""
        if not value.isascii():
            value = "".join(str(unicodedata.decimal(c, c)) for c in value)
        return getattr(self, kind)(value)

    def card(self, value: str) -> str | None:
        d = re.sub(r"\D", "", value)
        if not is_card(d):
            return None
        new = self._number(d[:-1], "card")
        return _refill(value, new + str(luhn_digit(new)))

    def iban(self, value: str) -> str | None:
        s = value.replace(" ", "")
        if not 15 <= len(s) <= 34 or int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 != 1:
            return None
        body, n, x = s[4:], 1, 0
        for c in body:  # digits stay digits and letters stay letters
            base = 10 if c.isdigit() else 26
            x, n = x * base + (int(c) if c.isdigit() else ord(c) - 65), n * base
        x, new = self.p(x, n, "iban" + s[:2] + re.sub("[A-Z]", "A", re.sub(r"\d", "0", body))), []
        for c in reversed(body):
            x, d = divmod(x, 10 if c.isdigit() else 26)
            new.append(str(d) if c.isdigit() else chr(65 + d))
        rest = "".join(reversed(new))
        return _refill(value, f"{s[:2]}{iban_check(s[:2], rest):02d}{rest}", "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + _DIGITS)

    def date(self, value: str) -> str | None:
        try:
            day, shape = _days(value)
        except ValueError:
            return None
        at = (day - self.FIRST).days
        if not 0 <= at < self.DAYS:
            return None
        while True:  # month before day: walk on to a day that cannot be a month, so that it is read alike again
            at = self.p(at, self.DAYS, "date")
            new = self.FIRST + datetime.timedelta(at)
            if shape[1] != "m" or new.day > 12:
                return f"{new.year:04d}-{new.month:02d}-{new.day:02d}" if shape[1] == "Y" else new.strftime(shape)

    def ip(self, value: str) -> str | None:
        parts = [int(x) for x in value.split(".")]
        if max(parts) > 255:
            return None
        x = self.p(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
        return ".".join(map(str, x.to_bytes(4, "big")))

    def ssn(self, value: str) -> str | None:
        a, g, s = map(int, value.split("-"))
        if a in (0, 666) or a >= 900 or not g or not s:
            return None
        a -= 1 + (a > 666)  # 898 areas, 99 groups, 9999 serials
        x = self.p((a * 99 + g - 1) * 9999 + s - 1, 898 * 99 * 9999, "ssn")
        x, s = divmod(x, 9999)
        a, g = divmod(x, 99)
        return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"

    def phone(self, value: str) -> str | None:
        """A country's prefix or a leading 0 stays; a number of 3-3-4 digits keeps area and exchange from 2 to 9."""
        head = re.match(r"\+\d{1,3}(?=\D)|\+\d|0", value)
        head = head.group() if head else ""
        d = re.sub(r"\D", "", value[len(head) :])
        if not 7 <= len(d) + len(head) - bool(head) <= 15:
            return None
        if head or value[0] == "(":
            return head + _refill(value[len(head) :], self._number(d, "phone"))
        x, n, new = 0, 1, []
        low = [2 if i in (0, 3) else 0 for i in range(len(d))]
        for c, least in zip(d, low):
            x, n = x * (10 - least) + int(c) - least, n * (10 - least)
        x = self.p(x, n, "exchange")
        for least in reversed(low):
            x, c = divmod(x, 10 - least)
            new.append(str(c + least))
        return _refill(value, "".join(reversed(new)))

    def secret(self, value: str) -> str | None:
        """Hexadecimal digits of any number; upper case stays upper case."""
        new = f"{self.p(int(value, 16), 16 ** len(value), f'hex{len(value)}'):0{len(value)}x}"
        return new.upper() if value.isupper() else new

    def access(self, value: str) -> str | None:
        """The part of a cloud access key behind its four letters, in letters and digits."""
        x, out = self.p(int(value[4:], 36), 36**16, "access" + value[:4]), []
        for _ in range(16):
            x, d = divmod(x, 36)
            out.append("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"[d])
        return value[:4] + "".join(reversed(out))

    def email(self, value: str) -> str | None:
        """Letters and digits of the mailbox name are permuted together; case, marks and the domain stay."""
        name, _, domain = value.partition("@")
        x, n = 0, 1
        kinds = [10 if c in _DIGITS else 26 if c.lower() in _LETTERS else 0 for c in name]
        for c, base in zip(name, kinds):
            if base:
                x, n = x * base + (int(c) if base == 10 else ord(c.lower()) - 97), n * base
        x, out = self.p(x, n, "email" + "".join("0a."[(10, 26, 0).index(k)] for k in kinds) + domain.lower()), []
        for c, base in zip(reversed(name), reversed(kinds)):
            d = c
            if base:
                x, d = divmod(x, base)
                d = str(d) if base == 10 else chr((65 if c.isupper() else 97) + d)
            out.append(d)
        return "".join(reversed(out)) + "@" + domain


def cards(text: str, start: int) -> tuple[list[tuple[int, int]], int]:
    """(spans, end): the cards among the digit groups of the run of digits at start, which ends at end.

    A span covers whole groups, so neighbours (an expiry, a check number, a year, a count) are left out. Where several overlap
    the usual layouts win, then known issuers, longer spans and earlier ones. Groups of an unusual layout are taken if they
    are the longest span at the start of the run, or begin as a known issuer's do and have three digits or more on average
    (a list of small numbers has a valid span at nearly every place).
    """
    run = _RUN.match(text, start)
    groups = [(m.start() + start, m.end() + start) for m in re.finditer(r"\d+", run.group())]
    found = []
    for a in range(len(groups)):
        sizes: list[int] = []
        for b in range(a, len(groups)):
            sizes.append(groups[b][1] - groups[b][0])
            if sum(sizes) > 19:
                break
            n, start, end = sum(sizes), groups[a][0], groups[b][1]
            rank = 0 if len(sizes) == 1 else 1 + LAYOUTS.index(tuple(sizes)) if tuple(sizes) in LAYOUTS else 9
            longest = a == 0 and (b + 1 == len(groups) or n + groups[b + 1][1] - groups[b + 1][0] > 19)
            if n < 13 or rank == 9 and not longest and n < 3 * len(sizes):
                continue
            digits = re.sub(r"\D", "", text[start:end])
            known = bool(ISSUERS.match(digits))
            if (rank < 9 or known or longest) and is_card(digits):
                found.append((rank, not known, -n, start, end))
    taken: list[tuple[int, int]] = []
    for *_, a, b in sorted(found):
        k = bisect.bisect(taken, (a, b))
        if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
            taken.insert(k, (a, b))
    return taken, run.end()


def iban_span(text: str, start: int, end: int, names: Pseudonyms) -> int | None:
    """The end of the IBAN at start, within a match that ends at end: at its country's length, else the longest that holds."""
    ends = [
        m.end() + start
        for m in re.finditer(r"[A-Z0-9](?![A-Za-z0-9])", text[start : end + 1])
        if m.end() + start <= end
    ]
    size = lambda e: e - start - text.count(" ", start, e)
    own = IBAN_LENGTHS.get(text[start : start + 2])
    return next(
        (e for e in sorted(ends, key=lambda e: (size(e) != own, -e)) if names.iban(text[start:e]) is not None), None
    )


def replace(text: str | None, names: Pseudonyms) -> tuple[str | None, list[tuple[str, int, int, str]]]:
    """(text with pseudonyms, found): found has (kind, start, length, pseudonym), in characters of the old text.

    The scan goes on inside a match that fails its check, as a valid value may begin there.
    """
    if not text or not _MAYBE.search(text) and not re.search("(?i)token|secret|passw|key|akia|asia", text):
        return text, []
    out, found, last, at = [], [], 0, 0
    due: list[tuple[int, int]] = []  # cards of the run of digits that ends at known
    known = 0
    while True:
        m = _ANY.search(text, at)
        if due and (m is None or m.start() >= due[0][0] or m.end() > due[0][0]):
            kind, (start, end) = "card", due.pop(0)
        elif m is None:
            break
        else:
            kind = next(k for k in _NAMES if m.start(k) >= 0)
            start, end = m.span("hex" if kind == "secret" else kind)
            if kind == "card":
                if start >= known:
                    due, known = cards(text, start)
                at = start + 1
                continue
            end = iban_span(text, start, end, names) if kind == "iban" else end
        new = None if end is None else names.pseudonym(kind, text[start:end])
        if new is None:
            at = start + 1
            continue
        found.append((kind, start, end - start, new))
        out += [text[last:start], new]
        last = at = end
    return "".join([*out, text[last:]]), found


ITEM = pa.list_(
    pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("pseudonym", pa.string())])
)
ITEMS = "items array<struct<kind:string,start:bigint,length:bigint,pseudonym:string>>"


def pseudonymise(docs: DataFrame, *, key: bytes, text_col: str = "text") -> DataFrame:
    """docs with the text replaced and the column items (kind, start, length, pseudonym) appended (replacing one of that name).

    Null texts stay null with no items. Values that fail their check (Luhn, mod 97, calendar from 1900 to 2099, octets,
    issued numbers) are left alone. Each row is treated by itself, repeated ones alike; texts of any length are scanned
    whole; nothing is shuffled; an empty table gives no row. The same key and value always give the same pseudonym, and
    Pseudonyms(key, invert=True) gives the value back, so the key is a secret of the caller. Equal values are linked where
    they are written alike: 25.03.1985 and 1985-03-25 too, 03/25/1985 only among dates with the month first.
    """
    rest = [c for c in docs.columns if c.lower() != "items"]
    place = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                new = [replace(t.as_py(), names) for t in part.column(place)]
                items = [[dict(zip(("kind", "start", "length", "pseudonym"), f)) for f in found] for _, found in new]
                cols = list(part.columns)
                cols[place] = pa.array([t for t, _ in new], pa.string())
                yield pa.RecordBatch.from_arrays([*cols, pa.array(items, ITEM)], [*part.schema.names, "items"])

    return map_rows(docs.select(*map(named, rest)), run, list(StructType.fromDDL(ITEMS)))


#: Only for this query over invented documents.
DEMONSTRATION_KEY = b"brevispark demonstration key"


def op10_pseudonyms(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pseudonymise(docs, key=DEMONSTRATION_KEY).where(F.size("items") > 0)
    return out.select(
        "doc_id",
        F.size("items").cast("long").alias("n_items"),
        "items",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )
