import json
import os

import pytest
from pyspark.sql import functions as F

from loomline import cli
from loomline.functions import catalogue, decoding, naming
from loomline.operators import sinks, stats
from loomline.sources import files

NAMES = {
    "a.c": "C", "A.C": "C", "x.F": "Fortran 77/Forth", "x.for": "Fortran 77/Forth", "x.FOR": "Fortran 77/Forth", "x.p": "Prolog", "x.build": "Bazel", "BUILD": "Bazel",
    "CMakeLists.txt": "CMake", "cmakelists.TXT": "CMake", "Makefile": "make", "GNUmakefile": "make", "Makefile.am": "make", "Makefile.inc": "PHP/Pascal/Fortran",
    "Dockerfile": "Dockerfile", "Dockerfile.dev": None, "java": "Java", "c": "C", "do": "Stata", "go": "Go", "text": "Text", "Gemfile": "Ruby", "notes.rst.txt": "reStructuredText",
    "notes.txt": "Text", "pom.xml": "Maven", "my.pom.xml": "Maven", "build.xml": "Ant", "x.build.xml": "Ant", "web.config": "XML", "foo.blade.php": "Blade",
    "foo.designer.cs": "C# Designer", "index.html.erb": "ERB", "x.d.ts": "TypeScript/Qt Linguist", "a.b.c": "C", "x.config.js": "JavaScript", "jquery.min.js": "JavaScript",
    "composer.lock": "JSON", ".editorconfig": "INI", ".clang-format": "YAML", "__init__.py": "Python", "x.asl": "ACPI Machine Language ", "README": None, ".gitignore": None,
    ".bashrc": None, "x.": None, "x.tar.gz": None, "Cargo.lock": None, "": None, "İ.K": None, "x.ʕ◔ϖ◔ʔ": "Go",
}

CONTENTS = [
    (b"\xef\xbb\xbfx\n", 1), (b"\xef\xbb\xbf", 0), (b"\xef\xbb", 1), (b"\xff\xfe", 0), (b"\xff\xfea\0\n\0", 1), (b"\xfe\xff\0a\0\n", 1), (b"\xff\xfea", 0), (b"a\0b\n", 0),
    (b"a" * 4095 + b"\0\n", 0), (b"a" * 4096 + b"\0\n", 1), (b"\xef\xbb\xbf" + b"a" * 4096 + b"\0\n", 1), (b"a\0\n\0", 0), (b"\xff\xfe\0\0a\0\0\0", 0), (b"\xff\xfe\x00\xd8\n\0", 1),
]


@pytest.fixture
def tree(tmp_path):
    for name in ("a.c", "__init__.py", ".editorconfig", "README", "sub/b.py", "sub/C.PY", "sub/.hid/x.c", "_und/y.c"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x\n")
    (tmp_path / "sub/empty.c").write_text("")
    (tmp_path / "lnk").symlink_to(tmp_path / "sub")
    return tmp_path


def test_names(spark):
    known = catalogue.default()
    assert {n: known.resolve(n) for n in NAMES} == NAMES
    got = naming.resolve(spark.createDataFrame([(n,) for n in NAMES], "name string"))
    assert {r["name"]: r["language"] for r in got.collect()} == NAMES
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().toString()


def test_catalogue_size_and_first_row_wins():
    known = catalogue.default()
    assert len(known.keys) == 895 and len(set(known.keys.values())) == 336 and known.dots == 3
    assert catalogue.Catalogue.from_rows([(".X", "a"), (".x", "b")]).keys == {".x": "a"}


def test_null_names_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "old"), ("a.py", "old")], "name string, language string")
    assert sorted((r["name"] or "", r["language"]) for r in naming.resolve(df).collect()) == sorted([("", None), ("a.py", "Python")], key=str)


def test_base_names(spark):
    paths = {"a/b.c": "b.c", "a\\b.c": "b.c", "a/b\\c.d": "c.d", "b.c": "b.c", "a/": "a/"}
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", naming.base_name("p").alias("n")).collect()
    assert {r["p"]: r["n"] for r in got} == paths


def test_contents(spark, tmp_path):
    rows = [(i, f"{i}.txt", bytearray(c)) for i, (c, _) in enumerate(CONTENTS)] + [(99, "n.txt", None)]
    got = {r["i"]: r["total"] for r in stats.content_stats(spark.createDataFrame(rows, "i int, name string, content binary")).collect()}
    assert got == {i: n for i, (_, n) in enumerate(CONTENTS)} | {99: 0}
    for i, (c, _) in enumerate(CONTENTS):
        (tmp_path / f"{i}.txt").write_bytes(c)
    read = stats.file_stats(files.list_files(spark, str(tmp_path))).collect()
    assert {int(os.path.basename(r["path"])[:-4]): r["total"] for r in read} == {i: n for i, (_, n) in enumerate(CONTENTS)}
    assert decoding.to_text(b"\xff\xfe\x00\xd8") == "\ufffd".encode()


def totals(report):
    return {r["language"]: (r["files"], r["total"], r["code"]) for r in report.collect()}


def test_tree(spark, tree):
    listed = files.list_files(spark, str(tree))
    assert listed.count() == 9
    assert totals(stats.report(stats.file_stats(listed))) == {"C": (4, 3, 3), "Python": (3, 3, 3), "INI": (1, 1, 1), "Total:": (8, 7, 7)}
    assert stats.ignored_count(listed).first()["ignored"] == 1
    flat = files.list_files(spark, str(tree), recursive=False)
    assert totals(stats.report(stats.file_stats(flat)))["Total:"] == (3, 3, 3)
    assert totals(stats.report(stats.file_stats(files.list_files(spark, str(tree / "a.c"))))) == {"C": (1, 1, 1), "Total:": (1, 1, 1)}
    # a link as the root is entered, and dots in the path are taken out
    assert files.list_files(spark, str(tree / "x/../lnk")).count() == 4


def test_unreadable_files_count_without_lines(spark, tree):
    listed = files.list_files(spark, str(tree))
    (tree / "a.c").unlink()
    assert totals(stats.report(stats.file_stats(listed)))["C"] == (4, 2, 2)
    with pytest.raises(Exception, match="FILE_OPEN_FAILED"):
        stats.file_stats(listed, failfast=True).collect()
    got = {r["name"]: (r["content"], r["status"]) for r in files.read_contents(listed).collect()}
    assert got["a.c"] == (None, "FILE_OPEN_FAILED") and bytes(got["b.py"][0]) == b"x\n"


def test_bad_roots(spark, tmp_path):
    for root in ("", str(tmp_path / "none"), str(tmp_path / "*")):
        with pytest.raises(files.ScanError):
            files.list_files(spark, root)


def test_reports(spark):
    rows = spark.createDataFrame([("Python", 5, 1, 1), ("C", 4, 0, 2)], "language string, total long, blank long, comment long")
    report = stats.report(rows)
    table = sinks.text_table(report).splitlines()
    assert len(table) == 8 and table[0] == "-" * 109
    assert table[3] == f"{'C':<25}{1:>10}{0:>15}{2:>15}{2:>15}{4:>15}" and table[6].split() == ["Total:", "2", "1", "3", "5", "9"]
    document = json.loads(sinks.json_report(report).first()["report"])
    assert document["Totals"] == {"CountOfFiles": 2, "CountOfLinesBlank": 1, "CountOfLinesComment": 3, "CountOfLinesCode": 5, "CountOfLinesTotal": 9}
    assert [x["Language"] for x in document["languages"]] == ["C", "Python"]
    empty = stats.report(rows.where("total < 0"))
    assert totals(empty) == {"Total:": (0, 0, 0)}
    assert json.loads(sinks.json_report(empty).first()["report"])["languages"] == []


def test_report_file(spark, tmp_path):
    rows = spark.createDataFrame([("C", 4, 0, 2)], "language string, total long, blank long, comment long")
    sinks.write_report(stats.report(rows), str(tmp_path / "r"), "json")
    assert spark.read.json(str(tmp_path / "r")).count() == 2


def test_command_line(spark, tree, capsys):
    assert cli.main([], spark) == 0 and cli.main(["-h"], spark) == 0
    for bad in (["-b"], ["-b", "Auto"], ["-threads", "0"], ["-threads", "-1"], ["-threads", "x"], ["-threads"], ["-threads", "99999999999"]):
        assert cli.main([str(tree), *bad], spark) == 4
    assert cli.main([str(tree / "none")], spark) == 12  # cannot be opened
    capsys.readouterr()
    assert cli.main([str(tree), "-json", "-nr", "-odd", "-b", "tp", "-threads", "2"], spark) == 0
    out = capsys.readouterr().out
    assert "Ignored 1 files" in out and json.loads(out.splitlines()[-1])["Totals"]["CountOfFiles"] == 3


def test_stream(spark, tmp_path):
    from loomline.streaming import rescan

    source = str(tmp_path / "in")
    spark.createDataFrame([("a.py", "# x\ny\n"), ("b.zzz", "y")], "name string, text string").write.parquet(source)
    q = rescan.running_stats(rescan.arriving(spark, source)).writeStream.outputMode("complete").format("memory").queryName("lines").start()
    try:
        q.processAllAvailable()
        assert [tuple(r) for r in spark.table("lines").collect()] == [("Python", 1, 0, 1, 1, 2)]
        spark.createDataFrame([("c.py", "z\n")], "name string, text string").write.mode("append").parquet(source)
        q.processAllAvailable()
        assert [tuple(r) for r in spark.table("lines").collect()] == [("Python", 2, 0, 1, 2, 3)]
    finally:
        q.stop()


def test_only_text_and_name_are_read(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    df = stats.report(stats.text_stats(pages.select(F.lit("a.html").alias("name"), F.col("html").alias("text"))))
    assert "ReadSchema: struct<html:string>" in df._jdf.queryExecution().toString()


def test_deep_and_narrow_trees_are_listed(spark, tmp_path):
    """One top folder, and more levels than Python recurses."""
    deep = tmp_path
    for i in range(60):
        deep = deep / "d"
        deep.mkdir()
        (deep / f"f{i}.c").write_text("x\n")
    wide = tmp_path / "d" / "w"
    wide.mkdir()
    for i in range(300):
        (wide / f"s{i}").mkdir()
        (wide / f"s{i}" / "g.py").write_text("")
    assert files.list_files(spark, str(tmp_path)).count() == 360


def test_contents_replace_columns_of_the_same_name(spark, tmp_path):
    (tmp_path / "a.c").write_text("one")
    df = spark.createDataFrame([(str(tmp_path / "a.c"), "old"), (str(tmp_path / "none"), "old")], "path string, content string")
    got = sorted((r["status"], r["content"]) for r in files.read_contents(df).collect())
    assert got == [("FILE_OPEN_FAILED", None), ("SUCCESS", bytearray(b"one"))]


def test_exit_codes_name_the_status():
    from loomline import cli

    assert [cli.status_of(Exception(f"{x}: /a")) for x in ("PATH_NORMALIZATION", "DIR_ENUM_FAILED", "FILE_READ_FAILED", "other")] == [5, 16, 15, 19]
