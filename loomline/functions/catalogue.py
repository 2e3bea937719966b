"""File-name keys, the languages they stand for, and the comment style of each language.

The table of keys is a parameter: rows in order, or a Markdown table; the default is data/catalogue.md of this package. Keys are compared with ASCII case folded, and of equal keys the first row counts. The style of a language is a
rule over its name."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

DEFAULT = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "data", "catalogue.md")

C, HASH, DASH, SEMICOLON, PERCENT, XML, NONE = "c", "#", "--", ";", "%", "xml", "none"
STYLES = (C, HASH, DASH, SEMICOLON, PERCENT, XML, NONE)

#: A language whose name holds the text (case counts) has the style; the first that fits counts, else C.
STYLE_RULES = (
    ("Python", HASH),
    ("Ruby", HASH),
    ("Perl", HASH),
    ("Shell", HASH),
    ("bash", HASH),
    ("make", HASH),
    ("Make", HASH),
    ("PowerShell", HASH),
    ("Raku", HASH),
    ("awk", HASH),
    ("SQL", DASH),
    ("Haskell", DASH),
    ("Lisp", SEMICOLON),
    ("Scheme", SEMICOLON),
    ("Assembly", SEMICOLON),
    ("TeX", PERCENT),
    ("LaTeX", PERCENT),
    ("MATLAB", PERCENT),
    ("Octave", PERCENT),
    ("PostScript", PERCENT),
    ("XML", XML),
    ("HTML", XML),
    ("XHTML", XML),
    ("XAML", XML),
    ("XSLT", XML),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


def fold(text: str) -> str:
    """Lower case of A-Z alone."""
    return text.translate(_FOLD)


def style_of(language: str) -> str:
    return next((style for part, style in STYLE_RULES if part in language), C)


@dataclass(frozen=True)
class Catalogue:
    """keys: folded key (with its leading dot) to language."""

    keys: dict[str, str]

    @classmethod
    def from_rows(cls, rows: Iterable[tuple[str, str]]) -> Catalogue:
        """From (key, language) in order; the first of equal keys counts."""
        keys: dict[str, str] = {}
        for key, language in rows:
            keys.setdefault(fold(key), language)
        return cls(keys)

    @classmethod
    def from_markdown(cls, path: str = DEFAULT) -> Catalogue:
        """From table rows: | `language` | style | `.key`:order `.key`:order ... |"""
        rows: list[tuple[int, str, str]] = []
        with open(path, encoding="utf-8") as f:
            for line in f:
                m = re.fullmatch(r"\| `([^`]+)` \| [^|]+ \| ((?:`\.[^`]+`:\d+ ?)+)\|\s*", line)
                if m:
                    rows += [(int(order), key, m[1]) for key, order in re.findall(r"`(\.[^`]+)`:(\d+)", m[2])]
        if not rows:
            raise ValueError(f"no table of keys in {path}")
        return cls.from_rows((key, language) for _, key, language in sorted(rows))

    @property
    def dots(self) -> int:
        """The most dots that a key has."""
        return max((k.count(".") for k in self.keys), default=0)

    def resolve(self, name: str) -> str | None:
        """Language of a file name: the whole name as a key, else the longest suffix that is one."""
        name = fold(name)
        for candidate in ("." + name, *(name[i:] for i, c in enumerate(name) if c == ".")):
            if candidate in self.keys:
                return self.keys[candidate]
        return None

    def frame(self, spark: SparkSession) -> DataFrame:
        """(ext_key, language, family); its size is that of the catalogue, not of the data."""
        return spark.createDataFrame([(k, v, style_of(v)) for k, v in sorted(self.keys.items())], "ext_key string, language string, family string")


_default: dict[str, Catalogue] = {}


def default() -> Catalogue:
    path = os.environ.get("LOOMLINE_CATALOGUE", DEFAULT)
    if path not in _default:
        _default[path] = Catalogue.from_markdown(path)
    return _default[path]
