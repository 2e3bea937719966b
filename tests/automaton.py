"""Line counts from spans: a text is cut into comments, strings and the rest by searching for what opens and closes them, and
each line is judged by the spans that it touches. The engines are held against this."""

import re

LINE_END = re.compile(rb"\r\n|\r|\n")
INK = re.compile(rb"[^ \t\n\r\f\x0b]")
LINE_COMMENT = {"c": b"//", "#": b"#", "--": b"--", ";": b";", "%": b"%"}
BLOCKS = {"c": (b"/*", b"*/"), "xml": (b"<!--", b"-->")}


def nearest(data: bytes, marks: list[bytes], at: int) -> tuple[int, bytes]:
    """Where the first of the marks stands from `at` on, and which it is; the end if none does."""
    return min(((p, m) for m in marks if (p := data.find(m, at)) >= 0), default=(len(data), b""))


def string_end(data: bytes, at: int) -> int:
    """Behind the closing quote of the string that opens at `at`. A backslash covers the next character that ends no line."""
    quote, i = data[at : at + 1], at + 1
    while True:
        i, mark = nearest(data, [quote, b"\\"], i)
        if mark != b"\\":
            return min(i + 1, len(data))
        i += 1
        while i < len(data) and data[i : i + 1] in (b"\r", b"\n"):
            i += 1
        i += 1


def spans(data: bytes, family: str) -> list[tuple[str, int, int]]:
    """(kind, start, stop) one after the other; a block that nothing closes stops beyond the text."""
    line, block = LINE_COMMENT.get(family), BLOCKS.get(family)
    openers = ([line, b'"', b"'"] if line else []) + ([block[0]] if block else [])
    out, at = [], 0
    while at < len(data):
        start, opener = nearest(data, openers, at)
        out.append(("plain", at, start))
        if not opener:
            break
        if opener == line:
            end = LINE_END.search(data, start)
            at = end.start() if end else len(data)
            out.append(("comment", start, at))
        elif block and opener == block[0]:
            close = data.find(block[1], start + len(opener))
            at = close + len(block[1]) if close >= 0 else len(data) + 1
            out.append(("block", start, at))
        else:
            at = string_end(data, start)
            out.append(("string", start, at))
    return out


def count(data: bytes, family: str) -> tuple[int, int, int]:
    """(total, blank, comment) lines."""
    cuts = [0, *(x for m in LINE_END.finditer(data) for x in m.span()), len(data)]
    lines = list(zip(cuts[::2], cuts[1::2]))
    kinds: list[set] = [set() for _ in lines]
    first = 0
    for kind, start, stop in spans(data, family):
        while first < len(lines) - 1 and lines[first + 1][0] <= start:
            first += 1
        for i in range(first, len(lines)):
            a, b = lines[i]
            if a >= stop and not (kind == "block" and a < stop):
                break
            touched = data[max(a, start) : min(b, stop)]
            if kind in ("comment", "block"):
                kinds[i].add("comment")
            elif touched if kind == "string" else INK.search(touched):
                kinds[i].add("code")
    if not kinds[-1]:
        kinds.pop()  # what follows the last line end counts if there is something
    return len(kinds), sum(not k for k in kinds), sum(k == {"comment"} for k in kinds)
