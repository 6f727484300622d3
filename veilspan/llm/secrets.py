"""Credentials in source code and configuration files.

Every text is read by the parsers of ``formats`` (YAML, properties, env and INI files; JSON,
literals, assignments and call arguments; XML) and by small ones for connection strings, URLs,
command lines, HTTP headers, SQL, and sentences that hand a login over.  A parser yields key paths
with the offsets of their values.  A value is a secret if its path has a sensitive name (or its own
shape is that of a known key format) and its shape is that of a literal: not a reference,
placeholder, mask, call, type or flag.  A name further up the path counts where the names below it
only hold values (``value``, list items) or where it is a plural, and then the value must look like
a key, too.  The redaction is spliced into the original text, so that everything around the
values stays as it was, byte for byte.

Offsets are code points, end exclusive.  Texts are processed whole, one at a time; there is no
shuffle.

Defined results: null and empty texts have no secrets; a null id is kept as null; repeated rows
give the same spans (``found`` is distinct); overlapping finds resolve to the earliest, then the
longest.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import formats
from .common import spread

# fixed values: published key formats
SHAPES = [
    ("aws_access_key", re.compile(r"(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA)[A-Z0-9]{16}")),
    (
        "token",
        re.compile(
            r"gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,}|gl(?:pat|ptt|dt|rt|at)-[A-Za-z0-9_\-]{16,}|npm_[A-Za-z0-9]{30,}|pypi-[A-Za-z0-9_\-]{30,}|xox[abprs]-[A-Za-z0-9\-]{10,}|eyJ[A-Za-z0-9_\-]{6,}\.eyJ[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]{8,}"
        ),
    ),
    (
        "api_key",
        re.compile(
            r"sk-(?:proj-|ant-)?[A-Za-z0-9_\-]{20,}|AIza[A-Za-z0-9_\-]{30,}|[rs]k_(?:live|test)_[A-Za-z0-9]{16,}|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|key-[A-Za-z0-9]{32}|SK[0-9a-f]{32}"
        ),
    ),
]
_ANY_SHAPE = re.compile("(?<![A-Za-z0-9_/+.\\-])(?:" + "|".join(f"(?P<{k}>{p.pattern})" for k, p in SHAPES) + ")(?![A-Za-z0-9_])")

_PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----.*?-----END \1-----", re.S)

# sensitive names, by the last parts of the key path
_NAMES = [
    ("aws_secret_key", re.compile(r"aws_?secret(?:_?access)?_?key$|secret_?access_?key$")),
    ("aws_access_key", re.compile(r"aws_?access_?key(?:_?id)?$|^access_?key_?id$")),
    (
        "api_key",
        re.compile(
            r"(?:^|_)(?:x_?)?(?:api_?key|apikey|client_?secret|secret_?key|app_?secret|consumer_?secret|signing_?key|signing_?secret|encryption_?key|webhook_?secret|subscription_?key|account_?key|service_?key)$"
        ),
    ),
    (
        "token",
        re.compile(r"(?:^|_)(?:token|auth_?token|access_?token|refresh_?token|session_?token|bearer|bearer_?token|api_?token|pat|sid|session_?id)$"),
    ),
    ("password", re.compile(r"(?:^|_)(?:[a-z]*password|passwd|passwort|[a-z]*pass|pwd|pw|passphrase|contraseña)$")),
    ("private_key", re.compile(r"(?:^|_)private_?key(?:_?(?:hex|pem|base64|b64|data))?$")),
    ("api_key", re.compile(r"(?:^|_)secret$")),
]

_PLURALS = [
    ("password", re.compile(r"(?:^|_)(?:[a-z]*passwords|passphrases)$")),
    ("token", re.compile(r"(?:^|_)(?:tokens)$")),
    ("api_key", re.compile(r"(?:^|_)(?:api_?keys|secret_?keys|signing_?keys|client_?secrets|secrets)$")),
]
_HELD = [("password", re.compile(r"(?:^|_)(?:credentials?|login)$"))]
_HOLDERS = frozenset("value val values default content plain plaintext plain_text raw literal current previous old new string_value data".split())
# a value that is told by a name further up has letters and digits, and no look of a word, path or name
_TELLING = re.compile(r"^(?=\S*[^\W\d_])(?=\S*\d)[^\s/\\]{8,}$")

_NOT_LITERAL = re.compile(
    r"""^(?:
        [$%]?[({<\[⟨«].*                     # ${X}, $(x), {{x}}, <x>, [x], ⟨X_1⟩
      | \$[A-Za-z_]\w*$ | %[A-Za-z_]\w*%$     # $X, %X%
      | (.)\1*$ | [*•xX.\-_]+$                # ****, xxxx
      | (?:none|null|nil|true|false|yes|no|on|off|str|string|int|bytes|bool|undefined|optional|secret|required|password|token|changeme|change_me|change-me|redacted|masked|hidden|example|todo|tbd|n/?a)$
      | .*(?:your[_\-\s]|[_\-]here$|example[_\-]?(?:key|token|password|secret)|placeholder|redacted|dummy)
      | (?:os\.|process\.env|env\.|getenv|getpass|vault|config\.|settings\.|self\.|ENV\[|ref:|file:|arn:|vault:|ssm:|secretsmanager|projects/).*
      | (?:sha\d{1,3}|md5)[:\-].*             # digests
    )""",
    re.X | re.I | re.S,
)
# a key without its BEGIN line: hexadecimal or base 64, over lines or not
_KEY_MATERIAL = re.compile(r"(?=.*\d)(?=.*[A-Za-z])[A-Za-z0-9+/=_\-](?:[A-Za-z0-9+/=_\-]|\\n|\s+(?=\S)){15,}$", re.S)
_CALL = re.compile(r"[\w.\]]+[(\[].*[)\]]|^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+$")

_URL_LOGIN = re.compile(r"""\b[a-z][a-z0-9+.\-]*://(?P<user>[^\s:/@"'<>]*):(?P<value>[^\s@"'<>]+)@(?=[\w\[])""", re.I)
_QUERY = re.compile(r"""[?&;](?P<key>[A-Za-z_][\w.\-]*)=(?P<value>[^\s&;"'<>`]+)""")
_CONNECTION = re.compile(r"""(?<![\w])(?P<key>Pwd|Password|AccountKey|SharedAccessKey|Secret)\s*=\s*(?P<value>[^;"'\n]+?)(?=[;"'\n]|$)""", re.I)
_COOKIE = re.compile(r"""(?i)\bcookie:?\s[^\n"']*?""")
_COOKIE_PART = re.compile(r"""(?:(?<=[;\s])|^)(?P<key>[A-Za-z_][\w.\-]*)=(?P<value>[^;\s"']+)""")
_BEARER = re.compile(r"""\b(?P<key>Bearer|Token)\s+(?P<value>[A-Za-z0-9_\-.~+/]{16,}=*)""")
_BASIC = re.compile(r"""\bBasic\s+(?P<value>[A-Za-z0-9+/]{8,}={0,2})""")
_FLAG = re.compile(r"""(?<!\S)--?(?P<key>[A-Za-z][\w\-]*)(?:=|\s+)(?:"(?P<dq>[^"\n]*)"|'(?P<sq>[^'\n]*)'|(?P<value>[^\s"']+))""")
_USER_FLAG = re.compile(r"""(?<!\S)(?:-u|--user|-U)\s+["']?(?P<user>[^\s:"']+):(?P<value>[^\s"']+)""")
_GLUED_P = re.compile(r"""\bmysql\w*\b[^\n]*?\s-p(?:"(?P<dq>[^"\n]+)"|'(?P<sq>[^'\n]+)'|(?P<value>[^\s"'-][^\s"']*))""")
_NETRC = re.compile(r"""\blogin\s+\S+\s+password\s+(?P<value>\S+)""")
_SQL = re.compile(r"""(?i)\b(?:identified\s+by|with\s+password|password\s+for\s+\S+\s+is|set\s+password\s*(?:=|to)?)\s+(?:password\s*)?\(?\s*'(?P<value>(?:''|[^'\n])+)'""")
# sentences; each with the kind its wording names
_SAID = [
    ("password", re.compile(r"""(?i)\b(?:password|passwd|pwd|pw|passphrase|passwort|kennwort)(?:\s+(?:for|of|to|für)\s+[^\n:.]{1,40}?)?(?:\s+(?:is|was|ist|war)(?:\s+now)?\s*:?|:)\s+(?P<value>[^\s"'⟨<{$]\S*)""")),
    ("password", re.compile(r"""(?i)\b(?:old|new|temp(?:orary)?|shared)\s+login\s+(?:for|of|to)\s+[^\n:]{1,60}:\s+(?P<value>\S+)""")),
    ("token", re.compile(r"""(?i)\b(?:use|with|the|new|old)\s+(?:\w+\s+)?token\s+(?:is\s+|was\s+)?(?P<value>[A-Za-z0-9_\-.]{16,})""")),
    ("api_key", re.compile(r"""(?i)\b(?:api\s+)?key\b[^\n.;:]{0,40}?(?:,\s*it\s+(?:was|is)|\s+(?:is|was)|:)\s+(?P<value>[A-Za-z0-9_\-.]{16,})""")),
]
_END = ".,;:!?)]}»”\"'"
_WORDY = re.compile(r"[^\W\d_]+$")


def _plain_name(name: str) -> str:
    """The last part of a name in lower case, its words joined by underscores."""
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", re.split(r"[./:]", name.strip("/:"))[-1])
    return re.sub(r"[\-\s]+", "_", name).lower().strip("_")


def name_kind(path: Sequence[str]) -> tuple[str | None, bool]:
    """What a key path says about its value, and whether the value's own name says it.  A name that
    only holds a value, or an item of a list, passes the question to the name above it; a name in
    the plural answers for all that is in it."""
    if not path:
        return None, False
    name = _plain_name(path[-1])
    for kind, p in _NAMES:
        if p.search(name):
            return kind, True
    holder = name in _HOLDERS or name.isdigit()
    for up in reversed(path[:-1]):
        name = _plain_name(up)
        if kind := next((kind for kind, p in _PLURALS if p.search(name)), None):
            return kind, False
        if not holder:
            return None, False
        if kind := next((kind for kind, p in (*_NAMES, *_HELD) if p.search(name)), None):
            return kind, False
        holder = name in _HOLDERS or name.isdigit()
    return None, False


def shape_kind(value: str) -> str | None:
    return next((kind for kind, p in SHAPES if p.fullmatch(value)), None)


def literal(value: str, quoted: bool) -> bool:
    if len(value) < 4 or _NOT_LITERAL.match(value):
        return False
    return quoted or not _CALL.search(value)


def _judged(kind: str | None, value: str, quoted: bool) -> str | None:
    if not literal(value, quoted):
        return None
    shape = shape_kind(value)
    if kind is None or shape == "aws_access_key":
        return shape
    if kind == "aws_access_key":
        return None if len(value) < 16 else kind
    if kind == "aws_secret_key":
        return kind if len(value) >= 30 else None
    if kind == "private_key":
        return kind if _KEY_MATERIAL.match(value) else None
    if kind in ("api_key", "token"):
        if value.isdigit() or len(value) < 12 or " " in value or _WORDY.match(value):
            return None
        return shape if shape and kind == "api_key" and shape == "api_key" else kind
    return shape if shape and kind == "password" and shape == "token" else kind


def _group(m: re.Match) -> tuple[str, int, int, bool]:
    for g, quoted in (("dq", True), ("sq", True), ("value", False)):
        if g in m.re.groupindex and m.group(g) is not None:
            return m.group(g), m.start(g), m.end(g), quoted
    return "", 0, 0, False


def settings(text: str) -> Iterator[formats.Setting]:
    """Every setting that a parser sees.  A parser is left out where a character that all its
    settings contain is not in the text."""
    if '"' in text or "'" in text:
        yield from formats.nested(text)
    if "=" in text or ":" in text or "- " in text:
        yield from formats.lines(text)
    if "<" in text:
        yield from formats.elements(text)
    one = lambda m, quoted: formats.Setting((m.group("key"),), m.group("value"), m.start("value"), m.end("value"), quoted)
    if "-" in text:
        for m in _FLAG.finditer(text):
            yield formats.Setting((m.group("key"),), *_group(m))
    if "=" in text:
        for m in _QUERY.finditer(text):
            yield one(m, False)
        for m in _CONNECTION.finditer(text):
            yield one(m, True)
        for line in _COOKIE.finditer(text):
            stop = text.find("\n", line.end())
            for m in _COOKIE_PART.finditer(text, line.end(), stop if stop >= 0 else len(text)):
                yield one(m, False)


def _decoded(value: str) -> str | None:
    """The text that a value encodes in base 64, if it does."""
    if len(value) < 8 or len(value) % 4 or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", value):
        return None
    try:
        plain = base64.b64decode(value, validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError):
        return None
    return plain if plain.isprintable() else None


def find_secrets(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the literal secrets of a text, in order and disjoint."""
    if not text:
        return []
    found = [(m.start(), m.end(), "private_key") for m in _PEM.finditer(text)]
    blocks = list(found)
    inside = lambda a: any(s <= a < e for s, e, _ in blocks)
    for path, value, a, b, quoted in settings(text):
        kind, own = name_kind(path)
        if kind is not None and not own and not _TELLING.search(value):
            kind = None
        if (kind or shape_kind(value)) and not inside(a) and (judged := _judged(kind, value, quoted)):
            found.append((a, b, judged))
    low = text.lower()
    for needed, p in ((":", _URL_LOGIN), (":", _USER_FLAG), ("mysql", _GLUED_P), ("login", _NETRC), ("'", _SQL)):
        for m in p.finditer(text) if needed in low else ():
            value, a, b, quoted = _group(m)
            if literal(value, True):
                found.append((a, b, shape_kind(value) or "password"))
    for m in _BEARER.finditer(text) if "bearer" in low or "token" in low else ():
        if literal(m.group("value"), True):
            found.append((*m.span("value"), "token"))
    for m in _BASIC.finditer(text) if "basic" in low else ():
        if ":" in (_decoded(m.group("value")) or ""):
            found.append((*m.span("value"), "password"))
    for kind, p in _SAID:
        for m in p.finditer(text):
            value, a = m.group("value").rstrip(_END), m.start("value")
            # what ends in a colon is the name of a setting below
            plain = _WORDY.match(value) is not None or value.isdigit() or m.group("value").endswith(":")
            if literal(value, False) and not plain and not inside(a):
                found.append((a, a + len(value), shape_kind(value) or kind))
    for m in _ANY_SHAPE.finditer(text):
        if not inside(m.start()) and literal(m.group(), True):
            found.append((m.start(), m.end(), m.lastgroup))
    out: list[tuple[int, int, str]] = []
    for s in sorted(found, key=lambda s: (s[0], -s[1])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def redact_secrets(text: str | None, spans: list[tuple[int, int, str]] | None = None) -> str | None:
    """The text with only the secret values replaced by ⟨KIND⟩."""
    if text is None:
        return None
    parts, at = [], 0
    for a, b, kind in find_secrets(text) if spans is None else spans:
        parts += [text[at:a], f"⟨{kind.upper()}⟩"]
        at = b
    return "".join([*parts, text[at:]])


SPANS = "id string, span_start int, span_end int, kind string"


def secret_spans(samples: DataFrame) -> DataFrame:
    """(id, span_start, span_end, kind)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(i, a, b, k) for i, t in zip(pdf["id"], pdf["text"]) for a, b, k in find_secrets(t)]
            yield pd.DataFrame(rows, columns=["id", "span_start", "span_end", "kind"])

    rows = samples.select(F.col("id").cast("string").alias("id"), "text").filter("text IS NOT NULL")
    return spread(rows).mapInPandas(run, SPANS)


def redacted_samples(samples: DataFrame) -> DataFrame:
    """(id, text with the secrets replaced, number of secrets)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            spans = [find_secrets(t) for t in pdf["text"]]
            yield pd.DataFrame(
                {"id": pdf["id"], "redacted": [redact_secrets(t, s) for t, s in zip(pdf["text"], spans)], "secrets": [len(s) for s in spans]}
            )

    rows = samples.select(F.col("id").cast("string").alias("id"), "text")
    return spread(rows).mapInPandas(run, "id string, redacted string, secrets int")


def found(samples: DataFrame) -> DataFrame:
    """Secrets of the blind samples."""
    return secret_spans(samples.filter(F.col("split") == "blind")).distinct()
