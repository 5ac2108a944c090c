"""Personal data as format-preserving pseudonyms.

Values that pass the check of their kind are replaced by other values of the same format: a
Feistel network, keyed and tweaked by kind and format, permutes the numbers 0 to N-1 that the
format can hold; what falls outside is walked on until it falls inside. A value becomes what the
permutation's cycle has next to it, so none stays as it is, equal values stay equal across
documents, different ones stay different, and whoever holds the key can go back.

| kind | check | kept |
|---|---|---|
| card | 13 to 19 digits, Luhn | first digit, separators, a right check digit |
| iban | its country's length, mod 97; what follows it is read anew | country, letters' and digits' places, right check digits |
| ssn | area, group and serial in use | dashes |
| phone | North American form, with area and exchange in use unless +1 or brackets mark it; other numbers with + and 8 to 15 digits | separators, country code or first two digits, in use or not |
| ipv4 | four octets of 0 to 255 | private, loopback and link-local ranges |
| date | a day of 1900 to 2099; year first (a time may follow after T), or day and month in either order | separators, order, zeros in front |
| email | local part and domain | domain, signs, letters' and digits' places of the local part |

Digits inside longer runs of letters or digits are left alone. Where a check fails, reading goes on
one character later, so a value behind or inside a failed one is found. Null texts stay null, empty ones
empty. Rows are independent; other columns pass through unchanged.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, steps

ROUNDS = 8
KINDS = ("email", "iban", "date", "ssn", "phone", "ipv4", "card")

# National lengths of account numbers, all of the IBAN registry.
IBAN_LENGTHS = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 "
        "GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 "
        "MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30 "
    ).split()
}
# Address ranges that stay within themselves (first address, size).
IPV4_RANGES = ((10 << 24, 1 << 24), (172 << 24 | 16 << 16, 1 << 20), (192 << 24 | 168 << 16, 1 << 16), (127 << 24, 1 << 24), (169 << 24 | 254 << 16, 1 << 16))

FIRST_DAY = datetime.date(1900, 1, 1)
DAYS = (datetime.date(2100, 1, 1) - FIRST_DAY).days

FIND = re.compile(
    r"""(?P<email>(?<![\w.+%-])[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}(?![\w-]))
      |(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9]))
      |(?P<date>(?<![\w./-])(?:\d{4}-\d\d-\d\d(?=[Tt]\d\d)|(?:\d{4}(?P<s>[-/.])\d{1,2}(?P=s)\d{1,2}|\d{1,2}(?P<t>[-/.])\d{1,2}(?P=t)\d{4})(?![\w/-]|\.\d)))
      |(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))
      |(?P<phone>(?<![\w+(])(?:\+1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])
               |(?<!\w)\+\d(?:[ .()-]{0,2}\d){7,14}(?!\w))
      |(?P<ipv4>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))
      |(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?P<u>[ -])\d{4}(?P=u)\d{4}(?P=u)\d{1,7}|\d{4}(?P<v>[ -])\d{6}(?P=v)\d{4,5})(?![\w-]))""",
    re.X | re.ASCII,
)
MAY_HOLD = re.compile(r"[0-9@]")


class Permutation:
    """Keyed permutation of 0 to size-1, an alternating Feistel network with cycle walking."""

    def __init__(self, key: bytes, tweak: str, size: int) -> None:
        self.size = size
        self.left = math.isqrt(size - 1) + 1 if size > 1 else 1
        self.right = -(-size // self.left)
        self.base = hashlib.blake2b(tweak.encode(), key=key, digest_size=16)

    def _round(self, i: int, half: int) -> int:
        h = self.base.copy()
        h.update(b"%d:%d" % (i, half))
        return int.from_bytes(h.digest(), "big")

    def _once(self, x: int, forward: bool) -> int:
        a, b = divmod(x, self.right)
        for i in range(ROUNDS) if forward else reversed(range(ROUNDS)):
            sign = 1 if forward else -1
            if i % 2:
                b = (b + sign * self._round(i, a)) % self.right
            else:
                a = (a + sign * self._round(i, b)) % self.left
        return a * self.right + b

    def _walk(self, x: int, forward: bool) -> int:
        x = self._once(x, forward)
        while x >= self.size:
            x = self._once(x, forward)
        return x

    def other(self, x: int, back: bool = False) -> int:
        """The value next to ``x`` on the permuted cycle; never ``x`` where there are two values."""
        return self._walk((self._walk(x, False) + (-1 if back else 1)) % self.size, True)


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _national(text: str, match: re.Match) -> str | None:
    """The start of an account number's match that has its country's length, if it ends there."""
    left = IBAN_LENGTHS.get(match[0][:2], 0)
    for end in range(match.start(), match.end()):
        left -= text[end] != " "
        if left == 0:
            after = text[end + 1 : end + 2]
            return None if after.isascii() and after.isalnum() else text[match.start() : end + 1]
    return None


def _refill(shape: str, symbols: str) -> str:
    """``shape`` with its letters and digits replaced, in order, by ``symbols``."""
    own = iter(symbols)
    return "".join(next(own) if c.isascii() and c.isalnum() else c for c in shape)


class Pseudonyms:
    """Pseudonym of a checked value (None: the check fails). ``back`` gives the original."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.key, self.back = key, back
        self.permutations = Memo(lambda k: Permutation(key, *k), 10_000)
        self.known = Memo(lambda kv: getattr(self, kv[0])(kv[1]), 100_000)

    def _other(self, tweak: str, x: int, size: int) -> int:
        return self.permutations[tweak, size].other(x, self.back)

    def _mixed(self, tweak: str, value: str) -> str:
        """Letters to letters of their case, digits to digits, the rest kept."""
        sizes = [10 if c.isdigit() else 26 for c in value if c.isascii() and c.isalnum()]
        own = [c for c in value if c.isascii() and c.isalnum()]
        x = 0
        for c, n in zip(own, sizes):
            x = x * n + (int(c) if n == 10 else ord(c.lower()) - 97)
        y = self._other(f"{tweak}:{sizes}", x, math.prod(sizes))
        out = []
        for c, n in zip(reversed(own), reversed(sizes)):
            y, d = divmod(y, n)
            out.append(str(d) if n == 10 else chr(d + (65 if c.isupper() else 97)))
        return _refill(value, "".join(reversed(out)))

    def email(self, value: str) -> str | None:
        local, _, domain = value.rpartition("@")
        if not any(c.isalnum() for c in local):
            return None
        return f"{self._mixed('email', local)}@{domain}"

    def card(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        if not luhn(digits) or len(set(digits)) == 1:
            return None
        n = len(digits) - 2
        body = digits[0] + str(self._other(f"card:{digits[0]}", int(digits[1:-1]), 10**n)).zfill(n)
        return _refill(value, next(body + c for c in "0123456789" if luhn(body + c)))

    def iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        if IBAN_LENGTHS.get(plain[:2]) != len(plain) or _mod97(plain) != 1:
            return None
        body = self._mixed(f"iban:{plain[:2]}", plain[4:])
        return _refill(value, f"{plain[:2]}{98 - _mod97(plain[:2] + '00' + body):02d}{body}")

    def ssn(self, value: str) -> str | None:
        area, group, serial = map(int, value.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self._other("ssn", x, 898 * 99 * 9999), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area + 1 >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"

    def phone(self, value: str) -> str | None:
        digits = re.sub(r"\D", "", value)
        code = "1" if value.startswith("+1") and len(digits) == 11 else ""
        if not value.startswith("+") or code:
            n = digits[len(code) :]
            marked = bool(code) or "(" in value
            if n[0] < "2" or n[3] < "2":
                if not marked:
                    return None
                x = int(n)
                while True:  # the cycle leads back to a number out of use
                    x = self._other("phone:unused", x, 10**10)
                    new = f"{x:010d}"
                    if new[0] < "2" or new[3] < "2":
                        return _refill(value, code + new)
            x = ((int(n[:3]) - 200) * 800 + int(n[3:6]) - 200) * 10_000 + int(n[6:])
            x, line = divmod(self._other("phone", x, 800 * 800 * 10_000), 10_000)
            area, exchange = divmod(x, 800)
            return _refill(value, f"{code}{area + 200}{exchange + 200}{line:04d}")
        if not 8 <= len(digits) <= 15:
            return None
        n = len(digits) - 2
        return _refill(value, digits[:2] + str(self._other(f"phone:{digits[:2]}", int(digits[2:]), 10**n)).zfill(n))

    def ipv4(self, value: str) -> str | None:
        parts = list(map(int, value.split(".")))
        if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in value.split(".")):
            return None
        x = int.from_bytes(bytes(parts), "big")
        for first, size in IPV4_RANGES:
            if first <= x < first + size:
                x = first + self._other(f"ipv4:{first}", x - first, size)
                break
        else:
            special = True
            while special:  # the cycle leads back to an address of no range
                x = self._other("ipv4", x, 1 << 32)
                special = any(first <= x < first + size for first, size in IPV4_RANGES)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def date(self, value: str) -> str | None:
        sign = re.search(r"[-/.]", value)[0]
        a, b, c = value.split(sign)
        for order in ("ymd",) if len(a) == 4 else ("dmy", "mdy"):
            at = dict(zip(order, (a, b, c)))
            try:
                day = datetime.date(int(at["y"]), int(at["m"]), int(at["d"]))
            except ValueError:
                continue
            x = (day - FIRST_DAY).days
            if not 0 <= x < DAYS:
                return None
            # day and month stay readable in one order only if that was so before
            wide = any(len(at[k]) == 2 and at[k][0] == "0" for k in "md")
            plain = any(len(at[k]) == 1 for k in "md")
            clear = order == "ymd" or int(a) > 12 or int(b) > 12
            tweak = f"date:{order}:{clear}"
            while True:
                x = self._other(tweak, x, DAYS)
                new = FIRST_DAY + datetime.timedelta(days=x)
                if order == "ymd" or clear == (new.day > 12):
                    break
            width = 1 if plain and not wide else 2
            parts = {"y": f"{new.year:04d}", "m": str(new.month).zfill(width), "d": str(new.day).zfill(width)}
            return sign.join(parts[k] for k in order)
        return None

    def replace(self, text: str) -> tuple[str, Counter]:
        """``text`` with pseudonyms, and how many of each kind."""
        counts: Counter = Counter()
        if not MAY_HOLD.search(text):
            return text, counts

        out, done, at = [], 0, 0
        while match := FIND.search(text, at):
            kind = match.lastgroup
            value = _national(text, match) if kind == "iban" else match[0]
            new = self.known[kind, value] if value else None
            if new is None:  # what is inside the match, or behind its first value, may pass
                at = match.start() + 1
                continue
            counts[kind] += 1
            out += text[done : match.start()], new
            done = at = match.start() + len(value)
        return "".join(out) + text[done:], counts


def pseudonymise(df: DataFrame, key: bytes, text_col: str = "text", counts_col: str = "replaced") -> DataFrame:
    """``df`` with pseudonyms in ``text_col``, and ``counts_col`` (kind to number) added."""
    rows = df.drop(counts_col)
    at = rows.columns.index(text_col)
    names = [f"c{i}" for i in range(len(rows.columns))]
    inner = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, rows.schema.fields))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        for step in steps(batches, names[at]):
            out = [None if t is None else own.replace(t) for t in step.column(at).to_pylist()]
            columns = list(step.columns)
            columns[at] = pa.array([x and x[0] for x in out], pa.string())
            counts = pa.array([list(x[1].items()) if x else [] for x in out], pa.map_(pa.string(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*columns, counts], [*names, "counts"])

    found = rows.toDF(*names).mapInArrow(scan, f"{inner}, counts map<string, int>")
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, rows.columns)], F.col("counts").alias(counts_col))
