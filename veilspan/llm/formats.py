"""Parsers of setting formats: each yields key paths with the offsets of their values.

* ``nested``: JSON, dictionary and list literals, TOML and inline YAML values, keyword and positional
  call arguments, assignments in code, with strings of one or three quotes.  A stack of open
  brackets gives the path; text inside a string is read again as settings of its own.
* ``lines``: YAML, properties, env and INI files.  Indentation gives the path; list items, section
  headers and block scalars are followed.
* ``elements``: XML elements and attributes.

In all three an entry that gives a name in one field and a value in another (container
environments, ``add key= value=``) yields the path that ends in the given name.

Offsets are those of the characters of the value alone, without its quotes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple


class Setting(NamedTuple):
    path: tuple[str, ...]
    value: str
    start: int
    end: int
    quoted: bool


NAME_FIELDS, VALUE_FIELDS = ("name", "key", "variable"), ("value", "default", "val")

_KEY = r"[A-Za-z_À-ÿ][\w.\-]*+"
_MARK = r"(?:(?<!\w)[bfruBFRU]{1,2})?"
_STRINGS = r'''(?:"""(?P<td>.*?)"""|\'\'\'(?P<ts>.*?)\'\'\'|"(?P<dq>(?:\\.|[^"\\\n])*+)"|'(?P<sq>(?:\\.|[^'\\\n])*+)')'''
_TOKEN = re.compile(
    rf"""(?P<oq>["']?)(?<![\w.\-])(?P<okey>{_KEY})(?P=oq)\s*+(?:=>|:=|[:=])(?!=)\s*+(?:[\w.]++\s*+)?(?P<kopen>[{{\[(])"""
    rf"""|(?:(?P<kq>["']?)(?<![\w.\-])(?P<key>{_KEY})(?P=kq)\s*+(?:=>|:=|[:=])(?!=)\s*+)?(?<![\w\\]){_MARK}{_STRINGS}"""
    rf"""|(?<![\w.\-])(?P<call>{_KEY})(?P<copen>\()"""
    r"""|(?P<open>[{\[(])|(?P<close>[}\])])""",
    re.S,
)
_INNER = re.compile(r"""[=:]\s*[bfru]?\\?["']|\w\(\s*["']""")
_SETTER = re.compile(r"(?:set|with|use)_?(?=[A-Za-z])", re.I)
_PAIRS = {"}": "{", "]": "[", ")": "("}


class _Open:
    __slots__ = ("bracket", "key", "count", "name", "kept", "first")

    def __init__(self, bracket: str, key: str | None) -> None:
        self.bracket, self.key, self.count, self.name, self.kept, self.first = bracket, key, 0, None, None, None


def _string(m: re.Match) -> tuple[str, int, int] | None:
    for g in ("dq", "sq", "td", "ts"):
        if m.group(g) is not None:
            return m.group(g), m.start(g), m.end(g)
    return None


def nested(text: str, begin: int = 0, end: int | None = None, depth: int = 0) -> Iterator[Setting]:
    stack: list[_Open] = []
    path = lambda *last: (*[o.key for o in stack if o.key is not None], *last)
    for m in _TOKEN.finditer(text, begin, len(text) if end is None else end):
        top = stack[-1] if stack else None
        if (found := _string(m)) is not None:
            value, a, b = found
            key = m.group("key")
            if depth < 3 and len(value) > 8 and _INNER.search(value):
                yield from nested(text, a, b, depth + 1)
            if key is not None:
                yield Setting(path(key), value, a, b, True)
                if top is not None and top.bracket == "{":
                    low = key.lower()
                    if low in NAME_FIELDS:
                        top.name = value
                        if top.kept is not None:
                            yield Setting(path(value), *top.kept, True)
                    elif low in VALUE_FIELDS:
                        top.kept = (value, a, b)
                        if top.name is not None:
                            yield Setting(path(top.name), value, a, b, True)
            elif top is not None:
                if top.bracket == "[":
                    yield Setting(path(str(top.count)), value, a, b, True)
                elif top.bracket == "(" and top.key is not None:
                    if top.count == 0:
                        top.first = value
                        if _SETTER.match(top.key.rsplit(".", 1)[-1]):
                            yield Setting(path(_SETTER.sub("", top.key.rsplit(".", 1)[-1], count=1)), value, a, b, True)
                    elif top.count == 1 and top.first and re.fullmatch(_KEY, top.first):
                        yield Setting(path(top.first), value, a, b, True)
                top.count += 1
        elif m.group("close"):
            want = _PAIRS[m.group("close")]
            if any(o.bracket == want for o in stack[-3:]):
                while stack.pop().bracket != want:
                    pass
        else:
            bracket = m.group("kopen") or m.group("copen") or m.group("open")
            key = m.group("okey") or m.group("call")
            if key is None and top is not None and top.bracket == "[":
                key = str(top.count)
            if top is not None:
                top.count += 1
            stack.append(_Open(bracket, key))


_LINE = re.compile(
    r"""^(?P<indent>[ \t]*)(?P<dash>-[ \t]+)?(?:(?:export|set|ENV|ARG)[ \t]+)*"""
    r"""(?P<key>(?://)?[A-Za-z_][\w.\-/:]*?)[ \t]*(?P<sign>=|:(?=[ \t]|$))[ \t]*"""
    r"""(?:"(?P<dq>[^"\n]*)"|'(?P<sq>[^'\n]*)'|(?P<value>[^\s"'#|>][^\s#]*(?:[ \t]+\#\S*)?))?[ \t]*(?P<tail>.*)$"""
    r"""|^(?P<iindent>[ \t]*)-[ \t]+(?:"(?P<idq>[^"\n]*)"|'(?P<isq>[^'\n]*)'|(?P<item>[^\s"'#|>{\[][^\s#]*))[ \t]*(?:\#.*)?$"""
    r"""|^[ \t]*\[+(?P<section>[A-Za-z_][\w. :"\-]*)\]+[ \t]*$""",
    re.M,
)
_BLOCK = re.compile(r"[|>][+\-\d]*[ \t]*(?:#.*)?$")


def _block(text: str, at: int, depth: int) -> tuple[int, int] | None:
    """The lines after ``at`` that are indented deeper than ``depth``."""
    start, stop, pos = None, at, at + 1
    while pos < len(text):
        end = text.find("\n", pos)
        end = len(text) if end < 0 else end
        line = text[pos:end]
        if line.strip():
            if len(line.expandtabs(2)) - len(line.lstrip()) <= depth and line[:1] not in " \t" or len(line) - len(line.lstrip()) <= depth:
                break
            if start is None:
                start = pos + len(line) - len(line.lstrip())
            stop = pos + len(line.rstrip())
        pos = end + 1
    return (start, stop) if start is not None else None


def lines(text: str) -> Iterator[Setting]:
    section: tuple[str, ...] = ()
    path: list[tuple[int, str]] = []
    names: dict[int, str] = {}
    items = 0
    for m in _LINE.finditer(text):
        if m.group("section"):
            section, path, names = (m.group("section").strip('" '),), [], {}
            continue
        if m.group("key") is None:
            depth = len(m.group("iindent").expandtabs(2))
            while path and path[-1][0] > depth:
                path.pop()
            g = next(g for g in ("idq", "isq", "item") if m.group(g) is not None)
            items += 1
            yield Setting((*section, *[k for _, k in path], str(items)), m.group(g), m.start(g), m.end(g), g != "item")
            continue
        depth = len(m.group("indent").expandtabs(2)) + (2 if m.group("dash") else 0)
        while path and path[-1][0] >= depth:
            path.pop()
        for d in [d for d in names if d > depth or (d == depth and m.group("dash"))]:
            del names[d]
        key, tail = m.group("key"), m.group("tail")
        above = (*section, *[k for _, k in path])
        g = next((g for g in ("dq", "sq", "value") if m.group(g) is not None), None)
        if g is None:
            items = 0
            path.append((depth, key))
            if tail and _BLOCK.match(tail) and (span := _block(text, m.end(), depth - (2 if m.group("dash") else 0))):
                yield Setting((*above, key), text[span[0] : span[1]], *span, True)
            continue
        if tail and tail[0] not in "#," and not (g != "value" and tail[0] in ";)]}"):
            continue
        value = (m.group(g), m.start(g), m.end(g))
        if g == "value" or m.group("sign") == ":":
            yield Setting((*above, key), *value, g != "value")
        if key.lower() in NAME_FIELDS:
            names[depth] = m.group(g)
        elif key.lower() in VALUE_FIELDS and depth in names:
            yield Setting((*above, names[depth]), *value, g != "value")


_TAG = re.compile(r"""<(?P<end>/)?(?P<tag>[A-Za-z_][\w:.\-]*)(?P<attributes>(?:\s+[\w:.\-]+\s*=\s*(?:"[^"<>]*"|'[^'<>]*'))*)\s*(?P<empty>/)?>""")
_ATTRIBUTE = re.compile(r"""(?P<key>[\w:.\-]+)\s*=\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)')""")
_CDATA = re.compile(r"\s*<!\[CDATA\[(.*?)\]\]>\s*$", re.S)


def elements(text: str) -> Iterator[Setting]:
    stack: list[tuple[str, str | None, int]] = []  # tag, the name it gives, where its content begins
    path = lambda: [p for tag, name, _ in stack for p in (tag, name) if p is not None]
    for m in _TAG.finditer(text):
        if m.group("end"):
            if any(tag == m.group("tag") for tag, _, _ in stack[-8:]):
                while stack and stack[-1][0] != m.group("tag"):
                    stack.pop()
                a, b = stack[-1][2], m.start()
                inner = text[a:b]
                if "<" not in inner or _CDATA.match(inner):
                    if c := _CDATA.match(inner):
                        a, b = a + c.start(1), a + c.end(1)
                    value = text[a:b].strip()
                    if value:
                        a += len(text[a:b]) - len(text[a:b].lstrip())
                        yield Setting(tuple(path()), value, a, a + len(value), True)
                stack.pop()
            continue
        given, kept = None, None
        for x in _ATTRIBUTE.finditer(text, *m.span("attributes")):
            g = "dq" if x.group("dq") is not None else "sq"
            if x.group("key").lower() in NAME_FIELDS:
                given = x.group(g)
            elif x.group("key").lower() in VALUE_FIELDS:
                kept = (x.group(g), x.start(g), x.end(g))
        if given is not None and kept is not None:
            yield Setting((*path(), m.group("tag"), given), *kept, True)
        if not m.group("empty"):
            stack.append((m.group("tag"), given, m.end()))
            if len(stack) > 64:
                del stack[0]
