"""Bytes of a file to text: byte-order marks, UTF-16, and the test for binary content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SNIFF = 4096  # bytes of text that are searched for a NUL


def bom(content: Column | str) -> Column:
    """utf-8, utf-16-le, utf-16-be or none."""
    content = F.col(content) if isinstance(content, str) else content
    head = F.hex(F.substring(content, 1, 3))
    return F.when(head == "EFBBBF", "utf-8").when(head.startswith("FFFE"), "utf-16-le").when(head.startswith("FEFF"), "utf-16-be").otherwise("none")


def decoded(content: Column | str) -> Column:
    """struct<text, is_text> of contents without UTF-16: one character for each byte (Latin-1), so every ASCII rule
    holds on invalid UTF-8 too. Rows with a UTF-16 mark have null text here; loomline.functions.scan decodes them."""
    content = F.col(content) if isinstance(content, str) else content
    mark = bom(content)
    body = F.when(mark == "utf-8", F.substring(content, 4, 2147483647)).otherwise(content)
    text = F.when(~mark.startswith("utf-16"), F.decode(body, "ISO-8859-1"))
    nul = F.decode(F.unhex(F.lit("00")), "ISO-8859-1")
    is_text = ~F.contains(F.substring(text, 1, SNIFF), nul)
    return F.struct(F.when(is_text, text).alias("text"), is_text.alias("is_text"))


def to_text(data: bytes) -> bytes | None:
    """Content after its mark, as UTF-8; None if it is not text."""
    if data[:3] == b"\xef\xbb\xbf":
        data = data[3:]
    elif data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        kind, data = ("utf-16-le" if data[0] == 255 else "utf-16-be"), data[2:]
        if len(data) % 2:
            return None
        data = data.decode(kind, "replace").encode("utf-8", "replace")
    return None if b"\0" in data[:SNIFF] else data
