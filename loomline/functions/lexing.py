"""Blank, comment and code lines of a text, as column expressions.

A text is cut into tokens by one flat pattern (comments, strings, all else); each token becomes a short mask that keeps its
line ends and says what its lines hold, and the lines of the joined mask are counted. There is no loop over characters:
everything runs on built-in expressions inside the JVM.

In a mask, `c` marks comment and `x` marks code, nothing marks white space; line ends are LF (CR, LF and CRLF all end one
line). A line of no mark is blank, of `c` alone a comment, any other code. What follows the last line end counts as a line if
it has a mark. A block comment marks each of its lines, empty ones too, and one more if the text ends inside it; a string
marks lines on which it has a character, white space included, so an empty line inside a string is blank."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalogue import DASH, HASH, NONE, PERCENT, SEMICOLON, XML, C

#: ASCII white space but line ends, spelled out: engines differ on \s.
BLANK = r" \t\f\x0B"
STRING = r"\"[^\"\\]*+(?:\\\n*+[^\n]?+[^\"\\]*+)*+(?:\"|\z)|'[^'\\]*+(?:\\\n*+[^\n]?+[^'\\]*+)*+(?:'|\z)"
BLOCK = r"(?s:/\*.*?(?:\*/|\z))"
MARKUP = r"(?s:<!--.*?(?:-->|\z))"
PREFIX = {C: "//", HASH: "#", DASH: "--", SEMICOLON: ";", PERCENT: "%"}
#: First characters of tokens, and so what a plain run leaves out.
SPECIAL = {C: "\"'/", HASH: "\"'#", DASH: "\"'\\-", SEMICOLON: "\"';", PERCENT: "\"'%", XML: "<"}


def pattern(family: str) -> str:
    """Tokens of a family; earlier alternatives first, each character in exactly one token."""
    special = SPECIAL[family]
    if family == XML:
        return rf"{MARKUP}|[^{special}]++|<"
    block = BLOCK + "|" if family == C else ""
    return rf"{PREFIX[family]}[^\n]*+|{block}{STRING}|[^{special}]++|[{special}]"


def line_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?+", "\n")


def _plain(t: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(t, rf"[^\n{BLANK}]++", "x"), rf"[{BLANK}]++", "")


def mask(text: Column, family: str) -> Column:
    """Of a text with LF line ends."""
    if family == NONE:
        return _plain(text)

    def one(t: Column) -> Column:
        block = F.concat(F.replace(F.regexp_replace(t, r"[^\n]++", ""), F.lit("\n"), F.lit("c\n")), F.lit("c"))
        if family == XML:
            return F.when(F.startswith(t, F.lit("<!--")), block).otherwise(_plain(t))
        line = F.when(F.startswith(t, F.lit(PREFIX[family])), F.lit("c"))
        if family == C:
            line = line.when(F.startswith(t, F.lit("/*")), block)
        quoted = F.regexp_replace(t, r"[^\n]++", "x")
        return line.when(F.startswith(t, F.lit('"')) | F.startswith(t, F.lit("'")), quoted).otherwise(_plain(t))

    tokens = F.regexp_extract_all(text, F.lit(f"({pattern(family)})"), F.lit(1))
    return F.array_join(F.transform(tokens, one), "")


def _counts(m: Column) -> Column:
    ends = F.length(m) - F.length(F.replace(m, F.lit("\n"), F.lit("")))
    open_ = F.when((m != "") & ~F.endswith(m, F.lit("\n")), 1).otherwise(0)
    blank = F.regexp_count(m, F.lit(r"(?<![^\n])\n"))
    comment = F.regexp_count(m, F.lit(r"(?<![^\n])c++(?![^\n])"))
    total, blank, comment = ((ends + open_).cast("long"), blank.cast("long"), comment.cast("long"))
    return F.struct(total.alias("total"), blank.alias("blank"), comment.alias("comment"), code(total, blank, comment).alias("code"))


def code(total: Column, blank: Column, comment: Column) -> Column:
    """Lines that are neither blank nor comment, at least none."""
    return F.greatest(total - blank - comment, F.lit(0).cast("long"))


def line_stats(text: Column | str, family: Column | str) -> Column:
    """struct<total, blank, comment, code> of a text under a comment style.

    family: one of the styles as text, or a column of them; other and null styles count as C. Null text counts as empty.
    The mask is computed once: it goes through a one-element array, so its counts share it."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    text = line_ends(text)
    if isinstance(family, str):
        masked = mask(text, family)
    else:
        masked = None
        for style in (HASH, DASH, SEMICOLON, PERCENT, XML, NONE):
            masked = F.when(family == style, mask(text, style)) if masked is None else masked.when(family == style, mask(text, style))
        masked = masked.otherwise(mask(text, C))
    return F.transform(F.array(masked), _counts)[0]


def lines(text: Column | str, family: str) -> Column:
    """array<struct<line_no, kind>>: kind is blank, comment or code for each counted line."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    parts = F.split(mask(line_ends(text), family), "\n")
    kind = lambda x: F.when(x == "", "blank").when(F.contains(x, F.lit("x")), "code").otherwise("comment")
    counted = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(counted, lambda x, i: F.struct((i + 1).cast("long").alias("line_no"), kind(x).alias("kind")))
