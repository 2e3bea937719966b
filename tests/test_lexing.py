import random

import pytest
from automaton import count
from pyspark.sql import functions as F

from loomline.functions import catalogue, lexing
from loomline.functions.scan import count_lines

C, HASH, DASH, SEMI, PERCENT, XML = "c", "#", "--", ";", "%", "xml"

#: text, total, blank, comment, code
VECTORS = {
    C: [
        ("int a;\n", 1, 0, 0, 1), ("", 0, 0, 0, 0), ("\n", 1, 1, 0, 0), ("   ", 0, 0, 0, 0), ("   \n", 1, 1, 0, 0), ("// x\n", 1, 0, 1, 0),
        ("a // x\n", 1, 0, 0, 1), ("/* a\n\nb */\n", 3, 0, 3, 0), ("/* a */ x\n", 1, 0, 0, 1), ("x /* a\nb */ y\n", 2, 0, 0, 2), ("/*\n", 2, 0, 2, 0),
        ("/*", 1, 0, 1, 0), ('"/* not */"\n', 1, 0, 0, 1), ('"a\n\n  \n// still\n"\n', 5, 1, 0, 4), ("it's\n// c\n", 2, 0, 0, 2), ('"\\\n"x\n// c\n', 3, 0, 0, 3),
        ("a\r\nb\rc\n", 3, 0, 0, 3), ("\r\r\n\n", 3, 3, 0, 0), ("/*/ x */\n", 1, 0, 1, 0), ("/*/\nx\n", 3, 0, 3, 0), ("//*\nx\n", 2, 0, 1, 1), ("*/\n", 1, 0, 0, 1),
        ("*/* a\nb */\n", 2, 0, 1, 1), ("/* a /*/\nx\n", 2, 0, 1, 1), ("/* a */ // b\n", 1, 0, 1, 0), ("x\n   ", 1, 0, 0, 1), ("/* a\n   ", 2, 0, 2, 0),
        ("\xa0\n", 1, 0, 0, 1), ("\x0b\x0c\t \n", 1, 1, 0, 0), ("http://x\n", 1, 0, 0, 1),
    ],
    HASH: [
        ("# x\n", 1, 0, 1, 0), ("x = 1 # c\n", 1, 0, 0, 1), ('"# no"\n', 1, 0, 0, 1), ('"""doc\n# in\n"""\n', 3, 0, 0, 3), ("don't\n# c\n", 2, 0, 0, 2),
        ("# don't\n# c\n", 2, 0, 2, 0), (" \n#", 2, 1, 1, 0),
    ],
    DASH: [("-- x\n- y\na--b\n", 3, 0, 1, 2), ("--", 1, 0, 1, 0), ("/* x */\n", 1, 0, 0, 1)],
    SEMI: [("; x\n(a) ; y\n// z\n", 3, 0, 1, 2)],
    PERCENT: [("% x\n\\% y\n", 2, 0, 1, 1)],
    XML: [
        ("<!-- a -->\n", 1, 0, 1, 0), ("<a><!-- b -->\n", 1, 0, 0, 1), ("<!-- a\n\nb -->\n", 3, 0, 3, 0), ("<!-->\nx\n", 3, 0, 3, 0), ("<!--->\nx\n", 3, 0, 3, 0),
        ("<!---->\n", 1, 0, 1, 0), ('"<!-- "\n', 2, 0, 1, 1), ("-->\n", 1, 0, 0, 1), ("<!-- a --> <b/>\n", 1, 0, 0, 1),
    ],
}


def native(spark, rows, family):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", lexing.line_stats("t", family).alias("s")).select("i", "s.*")
    return [tuple(r)[1:] for r in sorted(df.collect())]


@pytest.mark.parametrize("family", VECTORS)
def test_vectors(spark, family):
    want = [v[1:] for v in VECTORS[family]]
    assert native(spark, [v[0] for v in VECTORS[family]], family) == want
    for text, total, blank, comment, _ in VECTORS[family]:
        raw = text.encode("latin-1")
        assert count(raw, family) == count_lines(raw, family) == (total, blank, comment), text


@pytest.mark.parametrize("family", [*VECTORS, "none"])
def test_engines_agree_on_random_texts(spark, family):
    r = random.Random(family)
    texts = ["".join(r.choice("/*\"'\\#-;%<!>\r\n \t\x0ba\x80") for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(r.choice(["<!--", "-->", "/*", "*/", "//", "--", "\n", "\r\n", "x", " ", '"', "\\"]) for _ in range(r.randint(0, 25))) for _ in range(1500)]
    want = [count(t.encode("latin-1"), family) for t in texts]
    assert [count_lines(t.encode("latin-1"), family) for t in texts] == want
    assert [x[:3] for x in native(spark, texts, family)] == want
    for t, (total, blank, comment) in zip(texts, want):
        assert blank + comment <= total
        assert count(t.replace("\r\n", "\r").replace("\r", "\n").encode("latin-1"), family) == (total, blank, comment)


def test_long_texts_do_not_overflow(spark):
    for t in ('"' + "a\\\\" * 300_000, "/*" + "*" * 900_000, "a/" * 400_000, "'" * 400_001, "x\n" * 400_000):
        assert native(spark, [t], C)[0][:3] == count(t.encode(), C)


def test_family_column_null_text_and_other_family(spark):
    df = spark.createDataFrame([(0, None, C), (1, "# a\n", HASH), (2, "// a\n", "other"), (3, "// a\n", None), (4, "a\n", "none")], "i int, t string, f string")
    got = {r["i"]: (r["s"]["total"], r["s"]["comment"]) for r in df.select("i", lexing.line_stats("t", F.col("f")).alias("s")).collect()}
    assert got == {0: (0, 0), 1: (1, 1), 2: (1, 1), 3: (1, 1), 4: (1, 0)}


def test_lines_list_each_line_with_its_kind(spark):
    t = "int a;\n\n// c\n/* d\n\n*/ e\n  "
    got = spark.createDataFrame([(t,), (None,), ("/*\n",)], "t string").select(lexing.lines("t", C).alias("l")).collect()
    assert [[(x["line_no"], x["kind"]) for x in r["l"]] for r in got] == [[(1, "code"), (2, "blank"), (3, "comment"), (4, "comment"), (5, "comment"), (6, "code")], [], [(1, "comment"), (2, "comment")]]


def test_styles():
    assert {x: catalogue.style_of(x) for x in ("WebAssembly", "Snakemake", "YAML", "zsh", "Oracle PL/SQL", "MATLAB/Objective-C", "FXML", "Ruby HTML", "sql")} == {
        "WebAssembly": ";", "Snakemake": "#", "YAML": "c", "zsh": "c", "Oracle PL/SQL": "--", "MATLAB/Objective-C": "%", "FXML": "xml", "Ruby HTML": "#", "sql": "c",
    }
