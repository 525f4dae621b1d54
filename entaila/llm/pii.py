"""Personal data replaced by format-preserving Feistel pseudonyms.

Detectors find candidates and validators confirm them: e-mail addresses, phone
numbers, card numbers (Luhn), IBANs (mod 97), social security numbers, IPv4
addresses, dates, and secrets (long hexadecimal strings).  A value is mapped by
a keyed Feistel permutation of its own format: digits stay digits, letters keep
their case and place, check digits are worked out anew, and values outside the
format are walked past (cycle walking).  The map is a bijection for a key, so
equal values stay linked across documents and different ones stay apart.

The format of a number is no part of the permutation: a phone number or a date
gets the same pseudonym however it is written.  A phone number's country code is
found by the table of codes, with or without a separator behind it, after `+` or
`00`, and stays; so does a `(0)` behind it.  Values of more than `BLOCK`
letters and digits are permuted block by block, each block under the one before.

The key is the caller's secret and has no default.  `report` and the pipeline take
it from the session's setting `KEY_SETTING`; where that is unset they use a
published key, which is good for tests only.

Null texts stay null; texts without candidates are returned as they are, and every
row is returned, repeated ones too.  Where candidates overlap, the one that begins
first stays, then the longer one.  The time is linear in a text's length, whatever
stands in it.  A match that fails its validator, because another
number stands next to the value, is tried again from and to every border of a group
of digits inside it.  An empty table gives none; other columns are passed on, and the
name for a further column must be new.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, arrow_schema

#: The session's setting with the key, and the key of the tests.
KEY_SETTING, TEST_KEY = "spark.entaila.pseudonym.key", b"pseudonym-key"
ROUNDS = 10
#: Letters and digits permuted at once.
BLOCK = 64
_LOWER, _UPPER, _DIGIT, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"
_HEX_UPPER, _AF_LOWER, _AF_UPPER = "0123456789ABCDEF", "abcdef", "ABCDEF"
_MARK = {"": "", _DIGIT: "9", _LOWER: "a", _UPPER: "A", _HEX: "x", _HEX_UPPER: "X", _AF_LOWER: "f", _AF_UPPER: "F"}


class Feistel:
    """Keyed permutation of 0..m1*m2-1 with alternating additions (any m1, m2)."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _f(self, r: int, tweak: bytes, x: int, m: int) -> int:
        size = (m.bit_length() + 71) // 8
        out = b""
        while len(out) < size:
            out += hashlib.blake2b(b"%b|%d|%d|%d" % (tweak, r, x, len(out)), key=self.key).digest()
        return int.from_bytes(out[:size], "big") % m

    def __call__(self, x: int, m1: int, m2: int, tweak: bytes, back: bool = False) -> int:
        a, b = divmod(x, m2)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if r % 2:
                b = (b + sign * self._f(r, tweak, a, m2)) % m2
            else:
                a = (a + sign * self._f(r, tweak, b, m1)) % m1
        return a * m2 + b

    def symbols(self, text: str, tweak: bytes, ok: Callable[[str], bool] | None = None, back: bool = False, alphabets: tuple[str, ...] = (_DIGIT, _LOWER, _UPPER)) -> str:
        """Permute the letters and digits of a string, each within its own alphabet.

        `ok` says which strings are valid; the permutation walks on to the next
        valid one, which is a bijection of the valid strings.
        """
        sets = [next((s for s in alphabets if c in s), "") for c in text]
        live = [k for k, s in enumerate(sets) if s]
        if not live:
            return text
        shape = tweak + b"|" + hashlib.blake2b("".join(_MARK[s] or c for c, s in zip(text, sets, strict=True)).encode(), digest_size=16).digest()
        blocks = [live[k : k + BLOCK] for k in range(0, len(live), BLOCK)]
        chars = list(text)
        while True:
            under = b""  # the pseudonym of the block before
            for n, block in enumerate(blocks):
                half, before = len(block) // 2, "".join(chars[k] for k in block).encode()
                m1 = m2 = 1
                for k in block[:half]:
                    m1 *= len(sets[k])
                for k in block[half:]:
                    m2 *= len(sets[k])
                x = 0
                for k in block:
                    x = x * len(sets[k]) + sets[k].index(chars[k])
                y = self(x, m1, m2, b"%b|%d|%b" % (shape, n, under), back)
                for k in reversed(block):
                    y, d = divmod(y, len(sets[k]))
                    chars[k] = sets[k][d]
                under = before if back else "".join(chars[k] for k in block).encode()
            out = "".join(chars)
            if ok is None or ok(out):
                return out

    def digits(self, text: str, tweak: bytes, ok: Callable[[str], bool] | None = None, back: bool = False) -> str:
        """Permute the digits of a string, whatever stands between them."""
        new = iter(self.symbols("".join(c for c in text if c in _DIGIT), tweak, ok, back))
        return "".join(next(new) if c in _DIGIT else c for c in text)


# -- validators ---------------------------------------------------------------
def luhn_digit(body: str) -> str:
    total = sum(d if k % 2 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(body))))
    return str(-total % 10)


def is_card(text: str) -> bool:
    d = re.sub(r"[ -]", "", text)
    return d.isdigit() and 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn_digit(d[:-1]) == d[-1]


def is_iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def is_ip(text: str) -> bool:
    return all(int(x) < 256 and str(int(x)) == x for x in text.split("."))


#: The calling codes of one and two digits; all others have three.
_CODES_1, _CODES_2 = "1 7".split(), "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def country_end(text: str) -> int:
    """Where the country code of a phone number ends, whatever follows it; 0 if the number has none."""
    lead = 1 if text[:1] == "+" else 2 if text[:2] == "00" else 0
    return lead and lead + (1 if text[lead : lead + 1] in _CODES_1 else 2 if text[lead : lead + 2] in _CODES_2 else 3)


def is_ssn(text: str) -> bool:
    a, b, c = text.split("-")
    return a not in ("000", "666") and a[0] != "9" and b != "00" and c != "0000"


def is_phone(text: str) -> bool:
    d = re.sub(r"\D", "", text)
    return 7 <= len(d) <= 15 and len(set(d)) > 1


_DATE_FORMS = (
    (re.compile(r"(\d{4})-(\d\d)-(\d\d)\Z"), "{y:04d}-{m:02d}-{d:02d}", (0, 1, 2)),
    (re.compile(r"(\d{4})/(\d\d)/(\d\d)\Z"), "{y:04d}/{m:02d}/{d:02d}", (0, 1, 2)),
    (re.compile(r"(\d\d)\.(\d\d)\.(\d{4})\Z"), "{d:02d}.{m:02d}.{y:04d}", (2, 1, 0)),
    (re.compile(r"(\d\d)/(\d\d)/(\d{4})\Z"), "{m:02d}/{d:02d}/{y:04d}", (2, 0, 1)),
    (re.compile(r"(\d\d)/(\d\d)/(\d{4})\Z"), "{d:02d}/{m:02d}/{y:04d}", (2, 1, 0)),  # where the one above gives no date
)
_DAY0, _DAYS = dt.date(1900, 1, 1), (dt.date(2100, 1, 1) - dt.date(1900, 1, 1)).days


def parse_date(text: str) -> tuple[dt.date, str] | None:
    for form, shape, (y, m, d) in _DATE_FORMS:
        if got := form.match(text):
            try:
                day = dt.date(int(got[y + 1]), int(got[m + 1]), int(got[d + 1]))
            except ValueError:
                continue
            return (day, shape) if 0 <= (day - _DAY0).days < _DAYS else None
    return None


# -- detectors, in order of preference ------------------------------------------
_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}")
_DATE = r"\d{4}-\d\d-\d\d(?=[Tt]\d\d)|(?:\d{4}-\d\d-\d\d|\d{4}/\d\d/\d\d|\d\d\.\d\d\.\d{4}|\d\d/\d\d/\d{4})(?![\w/-]|\.\d)"
_CARD = r"\d(?:[ -]?\d){12,18}(?!\w)"
_PHONE = r"(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|00\d{2}(?:[ ./-]?\d{2,4}){2,5})(?!\w)"
_NUMBER = re.compile(
    r"(?<![\w.+])(?:"
    rf"(?P<date>{_DATE})"
    r"|(?P<ssn>\d{3}-\d\d-\d{4})(?![\w-])"
    r"|(?P<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?!\w|\.\d)"
    rf"|(?P<card>{_CARD})"
    rf"|(?P<phone>{_PHONE})"
    r")"
)
_CARD_AT, _PHONE_AT = re.compile(_CARD), re.compile(_PHONE)
_FIXED = re.compile(rf"(?<![\w.+])(?:(?P<date>{_DATE})|(?P<ssn>\d{{3}}-\d\d-\d{{4}})(?![\w-])|(?P<ip>\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}})(?!\w|\.\d)|(?P<phone>\d{{3}}-\d{{3}}-\d{{4}})(?!\w|-\d))")
_RUN, _GROUP, _LAST = re.compile(r"\d(?:[ -]?\d)*"), re.compile(r"\d+"), re.compile(r"[^\dA-Z]*[\dA-Z]+\Z")
_CARD_FORMS = {(4, 4, 4, 4), (4, 4, 4, 4, 3), (4, 6, 5), (4, 6, 4)}
_VALID: dict[str, Callable[[str], bool]] = {"date": lambda v: parse_date(v) is not None, "ssn": is_ssn, "ip": is_ip, "card": is_card, "phone": is_phone}
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_SECRET = re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,}(?![0-9A-Za-z])")
_PREFIXED = re.compile(r"(?<!\w)(?P<head>AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abprs]-|sk-|sk_live_|pk_live_|AIza)(?P<body>[A-Za-z0-9_-]{12,})")


_DOUBLED = bytes(d * 2 - 9 * (d > 4) if d < 10 else 0 for d in range(256))
_VALUE = bytes(b - 48 if 48 <= b <= 57 else 0 for b in range(256))


def cards(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """(begin, end) of the card numbers in a run of digit groups, apart from each other, in order.

    Every row of whole groups with 13 to 19 digits is tried: those grouped as on
    cards first, then the one that begins first, then the longer one.  Dates, addresses,
    dashed phone and social security numbers in the run are no part of a card.
    """
    fixed = [m.span() for m in _FIXED.finditer(text, begin, min(end + 20, len(text))) if _VALID[m.lastgroup](m[0])]
    groups = [m.span() for m in _GROUP.finditer(text, begin, end)]
    inside, k = [], 0
    for a, b in groups:
        while k < len(fixed) and fixed[k][1] <= a:
            k += 1
        inside.append(k < len(fixed) and fixed[k][0] < b)
    sizes = [b - a for a, b in groups]
    value = "".join(text[a:b] for a, b in groups).encode().translate(_VALUE)
    double = value.translate(_DOUBLED)
    found, at = [], 0
    for i, (a, _) in enumerate(groups):
        first, at = at, at + sizes[i]
        if a and (text[a - 1] in ".+_" or text[a - 1].isalnum()) or text.startswith("00", a):  # 00 dials abroad
            continue
        n = 0
        for j in range(i, len(groups)):
            n += sizes[j]
            if n > 19 or inside[j]:
                break
            if n < 13:
                continue
            to = first + n
            if (sum(value[first + (n - 1) % 2 : to : 2]) + sum(double[first + n % 2 : to : 2])) % 10:  # Luhn
                continue
            b = groups[j][1]
            if not (b < len(text) and (text[b] == "_" or text[b].isalnum())) and value.count(value[first], first, to) < n:
                form = tuple(sizes[i : j + 1])
                found.append((len(form) > 1 and form not in _CARD_FORMS, a, -b))
    out, used = [], bytearray(end - begin)
    for _, a, b in sorted(found):
        if not any(used[a - begin : -b - begin]):
            used[a - begin : -b - begin] = b"\1" * (-b - a)
            out.append((a, -b))
    return sorted(out)


def shorter(pattern: re.Pattern, ok: Callable[[str], bool], text: str, at: int, end: int) -> int:
    """The end of the longest valid match at a place, whole groups before `end`; 0 if there is none."""
    while m := pattern.match(text, at, end):
        if ok(m[0]):
            return m.end()
        end = at + _LAST.search(m[0]).start()
    return 0


def numbers(text: str) -> Iterator[tuple[int, int, str]]:
    at = known = 0
    held: list[tuple[int, int]] = []  # cards of the runs up to `known`, the next one last
    while m := _NUMBER.search(text, at):
        a, b = m.span()
        kind = m.lastgroup
        if kind in ("date", "ssn", "ip") and _VALID[kind](m[0]):
            yield a, b, kind
            at = b
            continue
        if b > known:
            new = []
            for run in _RUN.finditer(text, max(a, known)):
                if run.start() >= b:
                    break
                known = run.end()
                new += cards(text, run.start(), known)
            held = [*new[::-1], *held]
        while held and held[-1][0] < a:
            held.pop()
        if held and held[-1][0] == a:
            at = held.pop()[1]
            yield a, at, "card"
            continue
        if not (_PHONE_AT.match(text, a) or text.startswith("00", a) and _CARD_AT.match(text, a)):
            at = _GROUP.search(text, a).end()
            continue
        end = held[-1][0] if held else len(text)
        near = next((d.start() for d in _FIXED.finditer(text, a + 1, min(end, b + 20)) if d.lastgroup in ("date", "ip") and _VALID[d.lastgroup](d[0])), end)
        to = 0
        for stop in (near, end):  # a date or address after the number is no part of it
            if not to and text.startswith("00", a):
                to = shorter(_CARD_AT, is_phone, text, a, stop)
            to = to or shorter(_PHONE_AT, is_phone, text, a, stop)
        if to:
            yield a, to, "phone"
        at = to or _GROUP.search(text, a).end()


def ibans(text: str) -> Iterator[tuple[int, int, str]]:
    at = 0
    while m := _IBAN.search(text, at):
        at = shorter(_IBAN, is_iban, text, m.start(), m.end())
        if at:
            yield m.start(), at, "iban"
        at = at or m.start() + 4


def candidates(text: str) -> Iterator[tuple[int, int, str]]:
    at = text.find("@")
    while at > 0:
        left = at
        while left and (text[left - 1].isascii() and (text[left - 1].isalnum() or text[left - 1] in "._%+-")):
            left -= 1
        while left < at and not text[left].isalnum():
            left += 1
        if left < at and _EMAIL.match(text[left:at]) and (dom := _DOMAIN.match(text, at + 1)):
            yield left, dom.end(), "email"
        at = text.find("@", at + 1)
    yield from numbers(text)
    yield from ibans(text)
    for m in _SECRET.finditer(text):
        yield m.start(), m.end(), "secret"
    for m in _PREFIXED.finditer(text):
        yield m.start("body"), m.end(), "token"


def spans(text: str) -> list[tuple[int, int, str]]:
    """Confirmed, non-overlapping (begin, end, kind), in order."""
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(candidates(text), key=lambda s: (s[0], -s[1])):
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
    return out


class Pseudonyms:
    def __init__(self, key: bytes):
        self.f = Feistel(key)
        self.cache: dict[tuple[str, str], str] = {}

    def __call__(self, kind: str, value: str, back: bool = False) -> str:
        if back:
            return getattr(self, f"_{kind}")(value, True)
        if (kind, value) not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            self.cache[kind, value] = getattr(self, f"_{kind}")(value, False)
        return self.cache[kind, value]

    def _email(self, v, back):
        local, domain = v.rsplit("@", 1)
        host, dot, top = domain.rpartition(".")
        return f"{self.f.symbols(local, b'local', None, back)}@{self.f.symbols(host, b'host', None, back)}{dot}{top}"

    def _phone(self, v, back):
        head = v[: country_end(v)]
        rest = v[len(head) :]
        trunk = re.match(r"[ ./-]*\(0\)", rest)  # written between country and area, not dialled
        head, rest = (head + trunk[0], rest[trunk.end() :]) if trunk and head else (head, rest)
        area = next((c for c in rest if c.isdigit()), "0") >= "2"  # subscriber numbers that don't begin with 0 or 1 keep this
        return head + self.f.digits(rest, b"phone", lambda s: (s[0] >= "2") == area, back)

    def _ssn(self, v, back):
        return self.f.digits(v, b"ssn", lambda s: is_ssn(f"{s[:3]}-{s[3:5]}-{s[5:]}"), back)

    def _card(self, v, back):
        places = [k for k, c in enumerate(v) if c.isdigit()]
        body = "".join(v[k] for k in places[:-1])
        keep = body[0]  # the scheme
        body = keep + self.f.symbols(body[1:], b"card" + keep.encode(), lambda s: len(set(keep + s)) > 1, back)
        out = list(v)
        for k, c in zip(places, body + luhn_digit(body), strict=True):
            out[k] = c
        return "".join(out)

    def _iban(self, v, back):
        s = v.replace(" ", "")
        body = self.f.symbols(s[4:], b"iban" + s[:2].encode(), None, back)
        check = 98 - int("".join(str(int(c, 36)) for c in body + s[:2] + "00")) % 97
        new = iter(f"{s[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(new) for c in v)

    def _ip(self, v, back):
        x = 0
        for part in v.split("."):
            x = x * 256 + int(part)
        x = self.f(x, 1 << 16, 1 << 16, b"ip", back)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))

    def _date(self, v, back):
        day, shape = parse_date(v)
        x = (day - _DAY0).days
        m = 271  # 271 * 270 places hold all days; the walk stays below _DAYS
        while True:
            x = self.f(x, m, 270, b"date", back)
            if x < _DAYS:
                new = _DAY0 + dt.timedelta(days=x)
                if (new.day > 12) == (day.day > 12):  # others would be read with the month first in some formats
                    break
        return shape.format(y=new.year, m=new.month, d=new.day)

    def _secret(self, v, back):
        lower, upper = any(c in _AF_LOWER for c in v), any(c in _AF_UPPER for c in v)
        if lower and upper:
            return self.f.symbols(v, b"secret", None, back, (_DIGIT, _AF_LOWER, _AF_UPPER))
        if upper:  # one letter at least, so that the alphabet is known again
            return self.f.symbols(v, b"secret", lambda s: not s.isdigit(), back, (_HEX_UPPER,))
        return self.f.symbols(v, b"secret", None, back, (_HEX,))

    def _token(self, v, back):
        return self.f.symbols(v, b"token", None, back)

    def text(self, text: str) -> tuple[str, list[str]]:
        found = spans(text)
        if not found:
            return text, []
        out, at = [], 0
        for a, b, kind in found:
            out += [text[at:a], self(kind, text[a:b])]
            at = b
        return "".join([*out, text[at:]]), [k for _, _, k in found]


def session_key(spark: SparkSession) -> bytes:
    return spark.conf.get(KEY_SETTING, TEST_KEY.decode()).encode()


def pseudonymise(df: DataFrame, key: bytes, text_col: str = "text", kinds_col: str | None = None) -> DataFrame:
    """`df` with the personal data of its text column replaced; other columns stay.

    With `kinds_col`, an array of the kinds found, in order, is added under this name.
    """
    if not key:
        raise ValueError("a key is needed")
    if kinds_col in df.columns:
        raise ValueError(f"there is a column {kinds_col} already")
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    names, types = df.columns, dict(df.dtypes)
    place = names.index(text_col)
    ddl = ", ".join(f"`{c}` {types[c]}" for c in names) + (f", `{kinds_col}` array<string>" if kinds_col else "")
    schema = arrow_schema(ddl)

    def run(batches):
        p = Pseudonyms(key)
        for b in batches:
            got = [(None, []) if t is None else p.text(t) for t in b.column(place).to_pylist()]
            cols = list(b.columns)
            cols[place] = pa.array([t for t, _ in got], schema.field(place).type)
            if kinds_col:
                cols.append(pa.array([k for _, k in got], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return df.mapInArrow(run, ddl)


def report(docs: DataFrame) -> DataFrame:
    """Every document with its text pseudonymised, and what was found."""
    got = pseudonymise(docs.select("doc_id", "text"), session_key(docs.sparkSession), kinds_col="kinds")
    return got.select("doc_id", "text", F.size("kinds").cast("long").alias("n_found"), F.concat_ws(",", F.array_sort(F.array_distinct("kinds"))).alias("kinds"))
