"""Line counts from bytes, for content that is read inside Python workers and need not return to the JVM.

The same tokens as loomline.functions.lexing, over bytes. Content is scanned token by token with the flags of the current
line carried along."""

from __future__ import annotations

import re

from .catalogue import NONE, XML, C
from .lexing import PREFIX

_BLANK = rb" \t\f\x0b"
_QUOTED = rb"\"[^\"\\]*+(?:\\\n*+[^\n]?+[^\"\\]*+)*+(?:\"|\Z)|'[^'\\]*+(?:\\\n*+[^\n]?+[^'\\]*+)*+(?:'|\Z)"


def _compiled(family: str) -> re.Pattern:
    if family == XML:
        return re.compile(rb"(?P<block><!--.*?(?:-->|\Z))|(?P<end>\n)|(?P<code>[^\n" + _BLANK + rb"<]++|<)|[" + _BLANK + rb"]++", re.S)
    if family == NONE:
        return re.compile(rb"(?P<end>\n)|(?P<code>[^\n" + _BLANK + rb"]++)|[" + _BLANK + rb"]++")
    start = re.escape(PREFIX[family].encode())
    block = rb"(?P<block>/\*.*?(?:\*/|\Z))|" if family == C else b""
    first = re.escape(PREFIX[family][:1].encode())
    return re.compile(rb"(?P<line>" + start + rb"[^\n]*+)|" + block + rb"(?P<string>" + _QUOTED + rb")|(?P<end>\n)|(?P<code>[^\n\"'" + first + _BLANK + rb"]++|" + first + rb")|[" + _BLANK + rb"]++", re.S)


_patterns: dict[str, re.Pattern] = {}


def count_lines(data: bytes, family: str) -> tuple[int, int, int]:
    """(total, blank, comment) of text bytes under a comment style."""
    if family not in _patterns:
        _patterns[family] = _compiled(family if family in PREFIX or family in (XML, NONE) else C)
    total = blank = comments = 0
    code = comment = False

    def end() -> None:
        nonlocal total, blank, comments, code, comment
        total += 1
        blank += not code and not comment
        comments += comment and not code
        code = comment = False

    if b"\r" in data:
        data = re.sub(rb"\r\n?+", b"\n", data)
    for m in _patterns[family].finditer(data):
        kind = m.lastgroup
        if kind == "end":
            end()
        elif kind == "code":
            code = True
        elif kind == "line":
            comment = True
        elif kind == "block":
            for _ in range(m.group().count(b"\n")):
                comment = True
                end()
            comment = True
        elif kind == "string":
            parts = m.group().split(b"\n")
            for p in parts[:-1]:
                code |= bool(p)
                end()
            code |= bool(parts[-1])
    if code or comment:
        end()
    return total, blank, comments
