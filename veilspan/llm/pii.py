"""Personal information in free text: places, kinds, and typed pseudonymous placeholders.

E-mail addresses, phone, social security, national insurance and employee numbers, postal
addresses and calendar dates are found by shape.  Names are found by a small model fitted on labelled rows: which
words are given or family names, which endings family names share, and how often a word is a name
where it is written with a capital.  The grammar of full, partial, inverted and initialled names
then decides; ordinary words that are also names need a neighbour that makes them one.

A placeholder names the kind and carries a pseudonym.  Numbers and dates are validated and
keyed-permuted within their format by a Feistel network over their digits or days, walked until the
result is valid if the value was (and is not if it was not): separators, prefixes, letters, month
names' language and padding stay, so does the length, the same value gives the same pseudonym in
every document and spelling, and whoever has the key gets the value back (``back=True``).
Addresses, names and mailboxes get a keyed tag.  There is no default key.

The model is collected to the driver: it is fitted on at most ``FIT_SPANS`` name spans and
``FIT_TEXTS`` texts of labelled rows (chosen by hash), which bounds its words; it only ever
describes spelling, every text is scanned in full.  Scanning is row by row, without a shuffle.

Offsets are code points, end exclusive.  Defined results: null and empty texts have no spans; null
ids stay null; repeated rows give equal spans (``found`` is distinct); without labelled rows only
names after a title are found; overlapping finds resolve by kind in the order of KINDS, then to
the earlier, then to the longer one.
"""

from __future__ import annotations

import hashlib
import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from datetime import date, timedelta
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_kind, spread

KINDS = ("email", "address", "national_id", "ssn", "phone", "employee_id", "person", "date")
RECORDED = KINDS[:-1]  # the kinds that annotations record
FIT_SPANS, FIT_TEXTS = 20_000, 5_000

# ---------------------------------------------------------------- shapes
_LABEL = r"[^\W_](?:[^\W_]|-(?=[^\W_]))*"
_LOCAL = r"[^\W_](?:[\w.+%'\-]*[\w+])?"
_B = "[ \\u00a0]"
_AT = rf"(?:@|{_B}@{_B}|{_B}?[\[({{]{_B}?at{_B}?[\])}}]{_B}?|{_B}AT{_B}|{_B}at{_B}(?=[\w\-]+{_B}(?:dot|DOT){_B}))"
_DOT = rf"(?:\.|{_B}?[\[({{]{_B}?dot{_B}?[\])}}]{_B}?|{_B}(?:DOT|dot){_B})"
EMAIL = re.compile(rf"(?<![\w.+%\-])(?:mailto:)?(?P<v>{_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}})(?![\w\-]*@)(?![\w])")

_SEP = r"[-. /\u2010-\u2015\u00a0\u202f]"
_EXT = r"(?:,?\s?(?:ext\.?|extension|x|Durchwahl|poste)\s?\.?\d{1,5})?"
_NANP = rf"(?:(?:\+\s?1|001|1){_SEP}?)?(?:\([2-9]\d\d\){_SEP}?|[2-9]\d\d{_SEP}?)[2-9]\d\d{_SEP}?\d{{4}}"
_ABROAD = rf"(?:\+|00)\s?(?!1{_SEP})[1-9]\d{{0,2}}{_SEP}?(?:\(0\){_SEP}?)?\d(?:{_SEP}?\d){{6,11}}"
_TRUNK = rf"0\d(?:{_SEP}\d\d){{4}}|0\d{{2,4}}{_SEP}\d{{3,5}}{_SEP}\d{{3,4}}|0\d{{4}}{_SEP}\d{{5,6}}|\(0\d{{2,4}}\){_SEP}?\d{{3,4}}{_SEP}?\d{{3,4}}|0\d{{10}}"
PHONE = re.compile(rf"(?<![\w.+@#=])(?<!\w-)(?<!\d[,/–])(?:{_NANP}|{_ABROAD}|{_TRUNK}){_EXT}(?![\w@])(?!-\w)(?!\.\d)")
_BARE = re.compile(r"\d+")
# a bare run of digits after one of these words is a counter, not a number to call
_COUNTER = re.compile(r"(?i)(?:build|ticket|order|release|version|invoice|ref|id|number of|port|sku|item|limit|max_\w+)[\s.:#=]*$")

SSN = re.compile(r"(?<![\w.\-])(?<!\d[,/–])(?:\d{3}(?P<s>-|\.|\s|–|—|‑|\s-\s|\s–\s)\d\d(?P=s)\d{4}|(?:000|666|9\d\d)\d{6})(?![\w\-])(?!\.\d)")
NATIONAL = re.compile(r"(?i)(?<![\w\-])[A-Z]{2}(?P<s>[\s\-.]?)\d\d(?P=s)\d\d(?P=s)\d\d(?P=s)[A-D](?![\w\-])")
EMPLOYEE = re.compile(r"(?i)(?<![\w\-⟨])EMP[\-_#\s.:]{0,2}\d{3,8}(?![\w\-])")

# fixed values: month names by language
MONTHS = {
    "en": ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"),
    "short": ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"),
    "de": ("Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"),
    "es": ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
}
_MONTH = "|".join(sorted({m for names in MONTHS.values() for m in names}, key=lambda m: (-len(m), m)))
_MONTH_NAME = re.compile(rf"(?i)\b(?:{_MONTH})\b")
_YEAR = re.compile(r"(?<!\d)(?:19|20)\d\d(?!\d)")  # every date has one
_DATE_END = r"(?![\w\-/])(?![.,]\d)(?!T\d|[ ,]{1,2}\d{1,2}:\d\d)"  # a time stamp is no date of somebody
DATES = [
    re.compile(r"(?<![\w.\-/])(?P<y>\d{4})(?P<s>[\-/.])(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})" + _DATE_END),
    re.compile(r"(?<![\w.\-/])(?P<a>\d{1,2})(?P<s>[\-/.])(?P<b>\d{1,2})(?P=s)(?P<y>\d{4})" + _DATE_END),
    re.compile(
        rf"(?i)(?<![\w.\-/])(?P<d>\d{{1,2}})(?:\.|st|nd|rd|th)?\s(?:de\s|of\s)?(?P<month>{_MONTH})\.?,?\s(?:de\s|del\s)?(?P<y>\d{{4}})" + _DATE_END
    ),
    re.compile(rf"(?i)(?<![\w.\-/])(?P<month>{_MONTH})\.?\s(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s(?P<y>\d{{4}})" + _DATE_END),
]

_W = r"[^\W\d_][^\W\d_'’]*"
_CITY = rf"{_W}(?:[\-\s]{_W}){{0,2}}"
_TOWN = rf"{_W}(?:-{_W})*"
# fixed values: street words
_STREET = r"(?:street|st|road|rd|avenue|ave|boulevard|blvd|lane|ln|drive|dr|court|ct|close|way|place|pl|square|sq|terrace|crescent|row|walk|parkway|pkwy|highway|hwy)"
_UNIT = r"(?:,?\s(?:apt|apartment|flat|unit|suite|ste|room|floor|#)\.?\s?[\w\-]+)?"
_POSTAL = r"(?:(?:,?\s[A-Z]{2})?,?\s\d{5}(?:-\d{4})?|,?\s[A-Z]{1,2}\d[A-Z\d]?\s\d[A-Z]{2})"
ADDRESS = [
    re.compile(
        rf"(?i)(?<![\w\-])(?:(?:apt|flat|unit|suite)\.?\s?\w+,\s)?\d{{1,5}}[a-z]?\s(?:{_W}\s){{1,4}}?{_STREET}\.?{_UNIT},?\s(?:{_CITY}){_POSTAL}(?!\w)"
    ),
    re.compile(rf"(?i)(?<![\w\-])(?:p\.?\s?o\.?\s?box|postfach|apartado|bp)\s\d{{1,6}},?\s(?:\d{{4,5}}\s{_TOWN}|{_CITY}{_POSTAL})(?!\w)"),
    re.compile(
        rf"(?i)(?<![\w\-])\d{{1,4}}(?:\s(?:bis|ter))?,?\s(?:rue|avenue|boulevard|place|chemin|allée|quai|impasse)\s(?:(?:du|de\sla|de\sl['’]|des|de)\s?)?{_W}(?:[\-\s]{_W}){{0,3}}?,?\s\d{{5}}\s{_TOWN}(?!\w)"
    ),
    re.compile(
        rf"(?<![\w\-])(?:(?:{_W}-){{0,3}}{_W}(?:weg|straße|strasse|str\.|gasse|platz|allee|ring|ufer)|(?:[A-ZÄÖÜ]{_W}[\- ]){{1,3}}(?:Weg|Straße|Strasse|Str\.|Gasse|Platz|Allee|Ring|Ufer)) \d{{1,4}}\s?[a-z]?,?\s\d{{5}}\s{_TOWN}(?!\w)"
    ),
    re.compile(
        rf"(?i)(?<![\w\-])(?:calle|avenida|plaza|paseo|camino|c/)\s(?:(?:de|del|de\sla)\s)?{_W}(?:\s{_W}){{0,3}}?,?\s\d{{1,4}}(?:,?\s\d+[ºª°]\s?\w?)?,?\s\d{{5}}\s{_TOWN}(?!\w)"
    ),
]

# ---------------------------------------------------------------- names
TITLE = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Mx|Miss|Dr|Prof|Sir|Herr|Frau|Madame|Monsieur|Mme|Mlle|Señora|Señor|Sra|Sr|Don|Doña)\.?[\s ]+)$")
TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_GAP = re.compile(r"[  \t]{1,2}")
_COMMA = re.compile(r",[  ]{1,2}")
_CAPITAL_BEFORE = re.compile(r"[A-ZÀ-Þ][\w'’\-]* $")
_CAPITAL_AFTER = re.compile(r" [A-ZÀ-Þ]")
_ORDINARY = "Mr Mrs Ms Dr Madame The This That Hi Dear Call Ask Tell Patient Regards Best Thanks".split()


class Names(NamedTuple):
    given: frozenset
    family: frozenset
    endings: tuple
    sure: frozenset  # names that a capital alone makes certain


def _folded(word: str) -> str:
    return unicodedata.normalize("NFC", word).replace("’", "'").lower()


def fit_names(spans: list[str], texts: list[tuple[str, list[str]]]) -> Names:
    """spans: labelled names; texts: labelled texts with the names marked in each."""
    given, family = Counter(), Counter()
    for s in spans:
        words = [_folded(w) for w in TOKEN.findall(s)]
        if "," in s and len(words) >= 2:
            family[words[0]] += 1
            given[words[-1]] += 1
        elif len(words) >= 2 and not s.split()[0].isupper():
            family[words[-1]] += 1
            if len(words[0]) > 1:
                given[words[0]] += 1
    for w in list(given):
        if family[w] > given[w]:
            del given[w]
    for w in list(family):
        if given[w] > family[w]:
            del family[w]
    for w in [w for w, n in given.items() if n < 2 and "-" not in w]:
        del given[w]
    tails: dict[str, set] = {}
    for w in family:
        for k in (4, 5, 6, 7):
            if len(w) > k + 1:
                tails.setdefault(w[-k:], set()).add(w[:-k])
    endings = tuple(sorted(t for t, heads in tails.items() if len(heads) >= 8))
    inside, outside = Counter(), Counter()
    for text, names in texts:
        marked = Counter(_folded(w) for n in names for w in TOKEN.findall(n))
        seen = Counter(_folded(m) for m in TOKEN.findall(text) if m[0].isupper())
        for w in seen:
            inside[w] += min(marked[w], seen[w])
            outside[w] += max(0, seen[w] - marked[w])
    known = set(given) | set(family)
    sure = frozenset(w for w in known if inside[w] > outside[w] or not outside[w])
    return Names(frozenset(given), frozenset(family), endings, sure)


EMPTY = Names(frozenset(), frozenset(), (), frozenset())


def _glued(text: str, a: int, b: int) -> bool:
    """Whether a word is part of an identifier, address or path."""
    before, after = text[a - 1 : a], text[b : b + 1]
    if before and before in "_@/\\#$.+-%=&⟨" and (before not in ".-=/#" or (a > 1 and text[a - 2].isalnum()) or before in "_@\\#$%&⟨"):
        return True
    if before.isdigit():
        return True
    return bool(after) and (after in "_@\\⟩=" or after.isdigit() or (after in ".-+/:(" and text[b + 1 : b + 2].isalnum()))


def find_names(text: str, names: Names) -> list[tuple[int, int]]:
    words = []
    for m in TOKEN.finditer(text):
        w = m.group()
        f = _folded(w)
        parts = f.split("-")
        is_given = f in names.given or (len(parts) == 2 and all(p in names.given for p in parts))
        is_family = f in names.family or (not is_given and len(f) > 6 and len(parts) == 1 and bool(names.endings) and f.endswith(names.endings))
        initial = len(w) == 1 and w.isupper() and text[m.end() : m.end() + 1] == "."
        if not (is_given or is_family or initial):
            after_title = w[0].isupper() and TITLE.search(text, max(0, m.start() - 12), m.start())
            if not after_title or w in _ORDINARY:
                continue
            is_family = True
        if _glued(text, m.start(), m.end() + initial):
            continue
        words.append((m.start(), m.end() + initial, f, is_given, is_family, initial, w))
    out, i = [], 0
    joined = lambda x, y, p: p.fullmatch(text, x[1], y[0]) is not None
    while i < len(words):
        x = words[i]
        y = words[i + 1] if i + 1 < len(words) else None
        z = words[i + 2] if i + 2 < len(words) else None
        cap = x[6][0].isupper()
        if x[5]:
            # a family name begins with a capital, or with particles that are joined to it
            if y and y[4] and (y[6][0].isupper() or any(p[:1].isupper() for p in y[6].split("-")[1:])) and joined(x, y, _GAP):
                out.append((x[0], y[1]))
                i += 2
            else:
                i += 1
            continue
        same = bool(y) and cap == (y[6][0].isupper() or "-" in y[6] or "'" in y[6] and cap)
        if x[3] and y and z and y[5] and z[4] and joined(x, y, _GAP) and joined(y, z, _GAP):
            out.append((x[0], z[1]))
            i += 3
        elif x[3] and y and y[4] and (same or not cap) and joined(x, y, _GAP):
            out.append((x[0], y[1]))
            i += 2
        elif x[4] and y and (y[3] or y[5]) and (cap or "-" in x[6]) and y[6][0].isupper() and joined(x, y, _COMMA) and not (x[3] and not x[4]):
            out.append((x[0], y[1]))
            i += 2
        elif x[4] and y and y[3] and x[6].isupper() and len(x[6]) > 2 and joined(x, y, _GAP):
            out.append((x[0], y[1]))
            i += 2
        else:
            titled = TITLE.search(text, max(0, x[0] - 12), x[0]) is not None
            particle = "-" in x[6] and any(p[:1].isupper() for p in x[6].split("-")[1:])
            if titled or ((cap or particle) and x[2] in names.sure) or (cap and x[4] and x[2] not in names.family and not x[3]):
                out.append((x[0], x[1]))
            i += 1
    # a family name that stands in a full name of the text is a name where it stands alone, too
    told = {w[2] for w in words if w[4] for a, b in out if a <= w[0] and w[1] <= b and b - a > w[1] - w[0]} - names.sure
    for w in words if told else ():
        lone = w[2] in told and w[6][0].isupper() and all(w[1] <= a or w[0] >= b for a, b in out)
        if lone and not _CAPITAL_BEFORE.search(text, max(0, w[0] - 24), w[0]) and not _CAPITAL_AFTER.match(text, w[1]):
            out.append((w[0], w[1]))
    return out


# ---------------------------------------------------------------- all kinds
def _in_login(text: str, at: int) -> bool:
    """Whether a place is in the login of a URL: its secret is no mailbox."""
    start = text.rfind("://", 0, at)
    return start >= 0 and not re.search(r"[\s/@]", text[start + 3 : at])


def find_pii(text: str | None, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order and disjoint."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    if "@" in text or re.search(r"(?i)\bat\b", text):
        found += [(*m.span("v"), "email") for m in EMAIL.finditer(text) if not _in_login(text, m.start("v"))]
    if any(c.isdigit() for c in text):
        for p in ADDRESS:
            found += [(m.start(), m.end(), "address") for m in p.finditer(text)]
        found += [(m.start(), m.end(), "national_id") for m in NATIONAL.finditer(text)]
        for kind, p in (("ssn", SSN), ("phone", PHONE)):
            for m in p.finditer(text):
                if not (_BARE.fullmatch(m.group()) and _COUNTER.search(text, max(0, m.start() - 16), m.start())):
                    found.append((m.start(), m.end(), kind))
        found += [(m.start(), m.end(), "employee_id") for m in EMPLOYEE.finditer(text)]
        if _YEAR.search(text):
            dates = DATES if _MONTH_NAME.search(text) else DATES[:2]
            found += [(m.start(), m.end(), "date") for p in dates for m in p.finditer(text) if read_date(m.group()) is not None]
    found += [(a, b, "person") for a, b in find_names(text, names)]
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found, key=lambda s: (KINDS.index(s[2]), s[0], -s[1])):
        if all(b <= x or a >= y for x, y, _ in out):
            out.append((a, b, kind))
    return sorted(out)


# ---------------------------------------------------------------- pseudonyms
ROUNDS = 10


def _round(key: bytes, tweak: str, i: int, digits: str, width: int) -> int:
    mac = hashlib.blake2b(f"{tweak}|{width}|{i}|{digits}".encode(), key=key, digest_size=16)
    return int(mac.hexdigest(), 16) % 10**width


def permute_digits(digits: str, key: bytes, tweak: str = "", back: bool = False) -> str:
    """A keyed permutation of the strings of len(digits) decimal digits."""
    n = len(digits)
    if n == 0:
        return ""
    if n == 1:
        shift = _round(key, tweak, 0, "", 1)
        return str((int(digits) + (-shift if back else shift)) % 10)
    u = n // 2
    a, b = digits[:u], digits[u:]
    for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if back:
            c = (int(b) - _round(key, tweak, i, a, len(b))) % 10 ** len(b)
            a, b = str(c).zfill(len(b)), a
        else:
            c = (int(a) + _round(key, tweak, i, b, len(a))) % 10 ** len(a)
            a, b = b, str(c).zfill(len(a))
    return a + b


def valid_digits(kind: str, digits: str, national: bool = False) -> bool:
    """Whether digits can be a number of the kind: social security numbers have no area 000 or 666,
    no group 00 and no serial 0000; area and exchange of a North American phone begin with 2 to 9."""
    if kind == "ssn":
        return len(digits) == 9 and digits[:3] not in ("000", "666") and digits[3:5] != "00" and digits[5:] != "0000"
    if kind == "phone":
        return not national or (len(digits) == 10 and digits[0] > "1" and digits[3] > "1")
    return True


def permute_number(digits: str, kind: str, key: bytes, national: bool = False, back: bool = False) -> str:
    """permute_digits walked along its cycle to the next number that is as valid as this one.  An area
    that makes a number invalid is kept: few numbers have one, and the walk to the next is long."""
    if kind == "ssn" and digits[:3] in ("000", "666"):
        return digits[:3] + permute_digits(digits[3:], key, kind, back)
    want, now = valid_digits(kind, digits, national), digits
    while True:
        now = permute_digits(now, key, kind, back)
        if valid_digits(kind, now, national) == want:
            return now


_EPOCH, _DAYS = date(1900, 1, 1), (date(2100, 1, 1) - date(1900, 1, 1)).days


def permute_date(day: date, key: bytes, back: bool = False) -> date:
    """A keyed permutation of the days of 1900 to 2099, by walking the cycle of a five-digit one."""
    if not 0 <= (n := (day - _EPOCH).days) < _DAYS:
        raise ValueError("only days of 1900 to 2099")
    while True:
        n = int(permute_digits(str(n).zfill(5), key, "date", back))
        if n < _DAYS:
            return _EPOCH + timedelta(n)


def read_date(value: str) -> tuple[date, tuple] | None:
    """The day that a text names and the form in which it does, if there is such a day in 1900 to 2099."""
    for i, p in enumerate(DATES):
        if m := p.fullmatch(value):
            break
    else:
        return None
    g, language = m.groupdict(), None
    if i == 1:
        # the day comes first unless the second number can be no month
        first = int(g["b"]) <= 12
        day, month = ("a", "b") if first else ("b", "a")
        language = "dm" if first else "md"
    else:
        day, month = "d", "m" if i == 0 else "month"
    if month == "month":
        told = g["month"]
        language = next((n for n, names in MONTHS.items() if told in names), None) or next(
            n for n, names in MONTHS.items() if told.lower() in [x.lower() for x in names]
        )
        number = [x.lower() for x in MONTHS[language]].index(told.lower()) + 1
    else:
        number = int(g[month])
    try:
        at = date(int(g["y"]), number, int(g[day]))
    except ValueError:
        return None
    if not 0 <= (at - _EPOCH).days < _DAYS:
        return None
    case = (str.upper if g["month"].isupper() else str.lower if g["month"].islower() else str.title) if month == "month" else None
    parts = sorted((m.start(x), m.end(x), what) for x, what in (("y", "y"), (month, "m"), (day, "d")))
    between, pos = [], 0
    for a, b, what in parts:
        between += [value[pos:a], what]
        pos = b
    widths = tuple(b - a for a, b, what in parts if what != "m" or month != "month")
    return at, (i, language, case.__name__ if case else None, tuple([*between, value[pos:]]), widths)


def _written(at: date, form: tuple) -> str:
    i, language, case, parts, widths = form
    width = iter(widths)
    out = []
    for n, part in enumerate(parts):
        if n % 2 == 0:
            out.append(part)
        elif part == "m" and i >= 2:
            out.append(getattr(str, case)(MONTHS[language][at.month - 1]))
        else:
            out.append(str({"y": at.year, "m": at.month, "d": at.day}[part]).zfill(next(width)))
    return "".join(out)


def permute_written_date(value: str, key: bytes, back: bool = False) -> str | None:
    """The keyed permutation of a date as it is written, walked to the next day that reads in the same form."""
    told = read_date(value)
    if told is None:
        return None
    at, form = told
    while True:
        at = permute_date(at, key, back)
        new = _written(at, form)
        if read_date(new) == (at, form):
            return new


def _fixed_digits(value: str, kind: str) -> tuple[int, int]:
    """How many digits of a number stay: in front (country and trunk prefix) and at the end (extension)."""
    if kind != "phone":
        return 0, 0
    ext = re.search(r"(?i)(?:ext|x|extension|durchwahl|poste)[\s.]*(\d{1,5})$", value)
    digits = sum(c.isdigit() for c in value) - (len(ext.group(1)) if ext else 0)
    head = value.lstrip("( ")
    if head.startswith(("+1", "001")) or (digits == 11 and head.startswith("1")) or digits == 10 and not head.startswith(("0", "+")):
        front = digits - 10
    elif head.startswith(("+", "00")):
        # fixed values: country codes of one and three digits are rare here; two is the rule
        front = 2 + 2 * head.startswith("00") + ("(0)" in head)
    else:
        front = 1 if head.startswith("0") else 0
    return max(front, 0), len(ext.group(1)) if ext else 0


def pseudonym(value: str, kind: str, key: bytes, back: bool = False) -> str:
    """What stands for a value in its placeholder; ``back``: the value of a number's or date's pseudonym."""
    if kind == "date":
        return permute_written_date(value, key, back) or value
    if kind in ("phone", "ssn", "national_id", "employee_id"):
        digits = "".join(c for c in value if c.isdigit())
        front, rear = _fixed_digits(value, kind)
        core = digits[front : len(digits) - rear]
        national = kind == "phone" and len(core) == 10 and not value.lstrip("( ").startswith(("0", "+")) or value.lstrip("( ").startswith(("+1", "001"))
        new = iter(digits[:front] + permute_number(core, kind, key, national, back) + digits[len(digits) - rear :])
        return "".join(next(new) if c.isdigit() else c for c in value)
    if back:
        raise ValueError(f"a tag of kind {kind} does not tell its value")
    plain = unicodedata.normalize("NFKC", value).lower()
    if kind == "email":
        plain = re.sub(r"\s*[\[({]?\s*\bdot\b\s*[\])}]?\s*", ".", re.sub(r"\s*[\[({]?\s*\bat\b\s*[\])}]?\s*|\s*@\s*", "@", plain))
    elif kind == "person" and "," in plain:
        plain = " ".join(reversed([p.strip() for p in plain.split(",", 1)]))
    plain = " ".join(re.findall(r"[\w@+]+", plain))
    return hashlib.blake2b(f"{kind}|{plain}".encode(), key=key, digest_size=5).hexdigest()


def _checked(key: bytes) -> bytes:
    if not isinstance(key, bytes) or not 16 <= len(key) <= 64:
        raise ValueError("pseudonyms need a secret key of 16 to 64 bytes")
    return key


class Redaction(NamedTuple):
    text: str | None
    spans: list[tuple[int, int, str, str]]  # start, end, kind, pseudonym


def redaction(text: str | None, names: Names, key: bytes, made: dict | None = None) -> Redaction:
    """The text with typed placeholders, otherwise unchanged, and what was replaced.  ``made``
    remembers pseudonyms."""
    if text is None:
        return Redaction(None, [])
    made = {} if made is None else made
    parts, at, spans = [], 0, []
    for a, b, kind in find_pii(text, names):
        value = text[a:b]
        if (name := made.get((kind, value))) is None:
            name = made[(kind, value)] = pseudonym(value, kind, key)
        parts += [text[at:a], f"⟨{kind.upper()} {name}⟩"]
        spans.append((a, b, kind, name))
        at = b
    return Redaction("".join([*parts, text[at:]]), spans)


# ---------------------------------------------------------------- tables
def fitted_names(samples: DataFrame, annotations: DataFrame, spans: int = FIT_SPANS, texts: int = FIT_TEXTS) -> Names:
    """The model, from at most ``spans`` labelled names and ``texts`` labelled texts."""
    marks = annotations.filter(
        (fold_kind(F.col("kind")) == "person") & F.col("text").isNotNull() & F.col("sample_id").isNotNull()
    ).select("sample_id", F.col("text").alias("name")).distinct()
    known = marks.orderBy(F.xxhash64("sample_id", "name"), "name").limit(spans).collect()
    few = samples.filter((F.col("split") == "labelled") & F.col("text").isNotNull()).select("id", "text").orderBy(F.xxhash64("id"), "id").limit(texts)
    rows = few.join(marks, few["id"] == marks["sample_id"]).groupBy("id").agg(
        F.first("text").alias("text"), F.collect_set("name").alias("names"),
    ).collect()
    return fit_names([r["name"] for r in known], [(r["text"], r["names"]) for r in rows])


REDACTED = "id string, redacted string, starts array<int>, ends array<int>, kinds array<string>, pseudonyms array<string>"
REMEMBER = 50_000  # pseudonyms per Python worker; the memory is emptied beyond that


def redactions(samples: DataFrame, names: Names, key: bytes) -> DataFrame:
    """(id, redacted, starts, ends, kinds, pseudonyms): see ``redaction``."""
    _checked(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict = {}
        for batch in batches:
            if len(made) > REMEMBER:
                made.clear()
            done = [redaction(t, names, key, made) for t in batch.column("text").to_pylist()]
            spans = [list(zip(*r.spans)) or [(), (), (), ()] for r in done]
            lists = [
                pa.array([list(x[i]) for x in spans], pa.list_(kind)) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string(), pa.string()))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.string()), pa.array([r.text for r in done], pa.string()), *lists],
                names=["id", "redacted", "starts", "ends", "kinds", "pseudonyms"],
            )

    return spread(samples.select(F.col("id").cast("string").alias("id"), "text")).mapInArrow(run, REDACTED)


def redacted_samples(samples: DataFrame, names: Names, key: bytes) -> DataFrame:
    """(id, redacted, spans): the text with typed placeholders, otherwise unchanged."""
    return redactions(samples, names, key).select("id", "redacted", F.size("starts").alias("spans"))


def found(samples: DataFrame, annotations: DataFrame, key: bytes) -> DataFrame:
    """(id, span_start, span_end, kind): what the redaction of the blind samples replaces, of the
    kinds that annotations record, by a model fitted on the labelled ones."""
    blind = redactions(samples.filter((F.col("split") == "blind") & F.col("text").isNotNull()), fitted_names(samples, annotations), key)
    spans = blind.select("id", F.explode(F.arrays_zip("starts", "ends", "kinds")).alias("s"))
    spans = spans.select("id", F.col("s.starts").alias("span_start"), F.col("s.ends").alias("span_end"), F.col("s.kinds").alias("kind"))
    return spans.filter(F.col("kind").isin(*RECORDED)).distinct()


def session_key(spark: SparkSession) -> bytes:
    """The key that ``spark.veilspan.key`` holds in hexadecimal digits; a session without one gets
    a random key, so that its pseudonyms are of no use to anyone."""
    told = spark.conf.get("spark.veilspan.key", None)
    if told is None:
        told = os.urandom(32).hex()
        spark.conf.set("spark.veilspan.key", told)
    return _checked(bytes.fromhex(told))
