"""Queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import catalogue, decoding, lexing, naming
from ..operators import sinks, stats
from ..sources import files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- SQL that counts lines another way: tokens, masks and lists in the other engine -----------------------------------

_BLANK = r" \t\f\x0B"
_STRING = r"\"[^\"\\]*(?:\\\n*[^\n]?[^\"\\]*)*(?:\"|\z)|''[^''\\]*(?:\\\n*[^\n]?[^''\\]*)*(?:''|\z)"
_TOKENS = {
    "c": rf"//[^\n]*|(?s:/\*.*?(?:\*/|\z))|{_STRING}|[^\"''/]+|/",
    "#": rf"#[^\n]*|{_STRING}|[^\"''#]+",
    "--": rf"--[^\n]*|{_STRING}|[^\"''\-]+|-",
    ";": rf";[^\n]*|{_STRING}|[^\"'';]+",
    "%": rf"%[^\n]*|{_STRING}|[^\"''%]+",
    "xml": r"(?s:<!--.*?(?:-->|\z))|[^<]+|<",
}


def sql_lines(text: str, family: str) -> str:
    """SQL for the list of line marks of a text: '' blank, only c comment, else code; an open last line included."""
    plain = rf"regexp_replace(regexp_replace(t, '[^\n{_BLANK}]+', 'x', 'g'), '[{_BLANK}]+', '', 'g')"
    block = r"replace(regexp_replace(t, '[^\n]+', '', 'g'), chr(10), 'c' || chr(10)) || 'c'"
    if family == "xml":
        one = f"CASE WHEN starts_with(t, '<!--') THEN {block} ELSE {plain} END"
    else:
        start = {"c": "//"}.get(family, family)
        one = rf"""CASE WHEN starts_with(t, '{start}') THEN 'c' {"WHEN starts_with(t, '/*') THEN " + block if family == "c" else ""}
                   WHEN starts_with(t, '"') OR starts_with(t, '''') THEN regexp_replace(t, '[^\n]+', 'x', 'g') ELSE {plain} END"""
    clean = rf"regexp_replace(coalesce({text}, ''), '\r\n?', chr(10), 'g')"
    return f"string_split(array_to_string(list_transform(regexp_extract_all({clean}, '{_TOKENS[family]}'), lambda t: {one}), ''), chr(10))"


def sql_stats(key: str, source: str, text: str, family: str) -> str:
    return f"""
SELECT {key}, total, blank, comment, greatest(total - blank - comment, 0) AS code FROM (
  SELECT {key}, CAST(len(m) - (m[-1] = '')::INT AS BIGINT) AS total,
         CAST(len(list_filter(m, lambda x: x = '')) - (m[-1] = '')::INT AS BIGINT) AS blank,
         CAST(len(list_filter(m, lambda x: x <> '' AND NOT contains(x, 'x'))) AS BIGINT) AS comment
  FROM (SELECT {key}, {sql_lines(text, family)} AS m FROM {source}))"""


def _totalled(rows: str) -> str:
    """SQL of a report from SQL with language, total, blank and comment for each file."""
    return f"""
SELECT language, files, blank, comment, greatest(total - blank - comment, 0) AS code, total FROM (
  SELECT CASE WHEN grouping(language) = 1 THEN 'Total:' ELSE language END AS language, count(*) AS files,
         CAST(coalesce(sum(blank), 0) AS BIGINT) AS blank, CAST(coalesce(sum(comment), 0) AS BIGINT) AS comment, CAST(coalesce(sum(total), 0) AS BIGINT) AS total
  FROM ({rows}) GROUP BY GROUPING SETS ((language), ()))"""


# --- line statistics of the tables' texts ---------------------------------------------------------------------------


def _named(df: DataFrame, key: str, ending: str, text: str) -> DataFrame:
    return df.select(key, F.concat(F.lit("f"), F.col(key).cast("string"), F.lit(ending)).alias("name"), F.col(text).alias("text"))


_PAGES = sql_stats("page_id", "pages", "html", "xml")


@query(_totalled(f"SELECT 'HTML' AS language, * FROM ({_PAGES})"))
def xml_page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the pages as .html files; lines by language and in total."""
    return stats.report(stats.text_stats(_named(table(spark, sf_dir, "pages"), "page_id", ".html", "html")))


@query(f"SELECT page_id, 'HTML' AS language, total, blank, comment, code FROM ({_PAGES})")
def xml_lines_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.text_stats(_named(table(spark, sf_dir, "pages"), "page_id", ".html", "html")).select("page_id", "language", "total", "blank", "comment", "code")


def _by_document(ending: str, language: str, family: str, source: str, key: str, text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return stats.text_stats(_named(table(spark, sf_dir, source), key, ending, text)).select(key, "language", "total", "blank", "comment", "code")

    return run, f"SELECT {key}, '{language}' AS language, total, blank, comment, code FROM ({sql_stats(key, source, text, family)})"


for _name, _args in {
    "cstyle_doc_lines": (".c", "C", "c", "documents", "doc_id", "text"),
    "hash_doc_lines": (".py", "Python", "#", "documents", "doc_id", "text"),
    "percent_doc_lines": (".tex", "TeX", "%", "documents", "doc_id", "text"),
    "dash_doc_lines": (".sql", "SQL", "--", "documents", "doc_id", "text"),
    "semicolon_doc_lines": (".asm", "Assembly", ";", "documents", "doc_id", "text"),
    "benchmark_lines": (".txt", "Text", "c", "benchmark", "item_id", "text"),
    "props_lines": (".json", "JSON", "c", "events", "event_id", "props"),
}.items():
    QUERIES[_name], ORACLE[_name] = _by_document(*_args)


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN x = '' THEN 'blank' WHEN contains(x, 'x') THEN 'code' ELSE 'comment' END AS kind FROM (SELECT unnest(CASE WHEN m[-1] = '' THEN m[:-2] ELSE m END) AS x FROM (SELECT {sql_lines('html', 'xml')} AS m FROM pages))) GROUP BY kind")
def page_line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with its kind, then counted."""
    each = table(spark, sf_dir, "pages").select(F.explode(lexing.lines("html", catalogue.XML)).alias("line"))
    return each.groupBy(F.col("line.kind").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# --- sources written from table columns: the counts follow from how they are written ------------------------------------


def _rep(text: str, n):
    return F.repeat(F.lit(text), n.cast("int"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file for each order: C, Python, SQL, HTML, Assembly or TeX by its key, or a name without a language."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = k % 7
    blanks, comments = k % 4, c % 3
    words = F.col("o_orderpriority")
    endings = F.when(kind == 0, ".c").when(kind == 1, ".PY").when(kind == 2, ".sql").when(kind == 3, ".html").when(kind == 4, ".asm").when(kind == 5, ".tex").otherwise(".unknown")
    body = (
        F.when(kind == 0, F.concat(F.lit("/* head\n\n   tail */\n"), _rep("// note\r\n", comments), F.lit("int a = '\"'; // "), words, F.lit("\nchar *s = \"/* "), words, F.lit("\n\n */\";\n")))
        .when(kind == 1, F.concat(_rep("  # note\n", comments), F.lit("a = '# "), words, F.lit("'  # x\n")))
        .when(kind == 2, F.concat(_rep("-- note\r", comments), F.lit("select 1 - 2 -- "), words, F.lit("\n")))
        .when(kind == 3, F.concat(_rep("<!-- note -->\n", comments), F.lit("<p>"), words, F.lit("</p><!--\n\n-->\n")))
        .when(kind == 4, F.concat(_rep("; note\n", comments), F.lit("mov ax, bx ; "), words, F.lit("\n")))
        .otherwise(F.concat(_rep("% note\n", comments), words, F.lit(" 50\\% of it\n")))
    )
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("order"), k.cast("string"), endings).alias("name"), F.concat(_rep(" \t\n", blanks), body, F.lit("   ")).alias("text"))


_WRITTEN = """
SELECT id, CASE kind WHEN 0 THEN 'C' WHEN 1 THEN 'Python' WHEN 2 THEN 'SQL' WHEN 3 THEN 'HTML' WHEN 4 THEN 'Assembly' WHEN 5 THEN 'TeX' END AS language,
       blanks + comments + CASE kind WHEN 0 THEN 7 WHEN 3 THEN 3 ELSE 1 END AS total,
       blanks + CASE kind WHEN 0 THEN 1 ELSE 0 END AS blank,
       comments + CASE kind WHEN 0 THEN 3 WHEN 3 THEN 2 ELSE 0 END AS comment
FROM (SELECT o_orderkey AS id, o_orderkey % 7 AS kind, o_orderkey % 4 AS blanks, o_custkey % 3 AS comments FROM orders) WHERE kind < 6"""


@query(f"SELECT id, language, total, blank, comment, total - blank - comment AS code FROM ({_WRITTEN})")
def written_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.text_stats(_sources(spark, sf_dir)).select("id", "language", "total", "blank", "comment", "code")


@query(f"SELECT language, files, blank, comment, code, total FROM ({_totalled(_WRITTEN)}) WHERE language <> 'Total:'")
def lang_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.language_stats(stats.text_stats(_sources(spark, sf_dir)))


@query(_totalled(_WRITTEN))
def report_with_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.report(stats.text_stats(_sources(spark, sf_dir)))


@query(f"SELECT files, blank, comment, code, total, language FROM ({_totalled(_WRITTEN)}) WHERE language = 'Total:'")
def grand_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.grand_total(stats.text_stats(_sources(spark, sf_dir)))


@query(_totalled(f"SELECT * FROM ({_WRITTEN}) WHERE id < 0"))
def empty_input_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.report(stats.text_stats(_sources(spark, sf_dir).where("id < 0")))


@query("SELECT count(*) AS ignored FROM orders WHERE o_orderkey % 7 = 6")
def ignored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ignored_count(_sources(spark, sf_dir))


@query("SELECT o_orderkey AS id, 'order' || o_orderkey || '.unknown' AS name FROM orders WHERE o_orderkey % 7 = 6")
def ignored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ignored(_sources(spark, sf_dir)).select("id", "name")


_FIELDS = ", ".join(f"'{name}': {column}" for name, column in sinks.FIELDS.items())


@query(f"SELECT CAST(to_json({{'Totals': max(CASE WHEN language = 'Total:' THEN {{{_FIELDS}}} END), 'languages': list({{'Language': language, {_FIELDS}}} ORDER BY language) FILTER (WHERE language <> 'Total:')}}) AS VARCHAR) AS report FROM ({_totalled(_WRITTEN)})")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.json_report(QUERIES["report_with_total"](spark, sf_dir))


_PADDED = "rpad(language, CAST(greatest(25, length(language)) AS INT), ' ') || lpad(CAST(files AS VARCHAR), 10, ' ') || " + " || ".join(f"lpad(CAST({c} AS VARCHAR), 15, ' ')" for c in ("blank", "comment", "code", "total"))


@query(f"""
WITH r AS (SELECT language, {_PADDED} AS line FROM ({_totalled(_WRITTEN)})), rule AS (SELECT repeat('-', 109) AS line),
parts AS (SELECT 0 AS part, '' AS language, line FROM rule UNION ALL SELECT 1, '', 'File Type' || repeat(' ', 21) || 'Files' || lpad('Blank', 15, ' ') || lpad('Comment', 15, ' ') || lpad('Code', 15, ' ') || lpad('Total', 15, ' ')
          UNION ALL SELECT 2, '', line FROM rule UNION ALL SELECT 3, language, line FROM r WHERE language <> 'Total:'
          UNION ALL SELECT 4, '', line FROM rule UNION ALL SELECT 5, '', line FROM r WHERE language = 'Total:' UNION ALL SELECT 6, '', line FROM rule)
SELECT row_number() OVER (ORDER BY part, language) AS line_no, line FROM parts""")
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text table, a row for each of its lines."""
    text = sinks.text_table(QUERIES["report_with_total"](spark, sf_dir))
    return spark.createDataFrame([(i, x) for i, x in enumerate(text.splitlines(), 1)], "line_no long, line string")


@query(f"SELECT id, language, total, blank, comment, total - blank - comment AS code FROM ({_WRITTEN})")
def written_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sources as bytes: UTF-8, with a mark, and as UTF-16 of both orders."""
    written = _sources(spark, sf_dir)
    k = F.col("id") % 4
    wide = F.encode("text", "UTF-16LE")
    content = F.when(k == 0, F.encode("text", "UTF-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8"))).when(k == 2, F.concat(F.unhex(F.lit("FFFE")), wide)).otherwise(F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
    return stats.content_stats(written.select("id", "name", content.alias("content"))).select("id", "language", "total", "blank", "comment", "code")


# --- names, styles, encodings ---------------------------------------------------------------------------------------

#: Endings and the languages of names that end so.
ENDINGS = (
    (".c", "C"),
    (".C", "C"),
    (".F", "Fortran 77/Forth"),
    (".FOR", "Fortran 77/Forth"),
    (".p", "Prolog"),
    (".build", "Bazel"),
    (".am", "make"),
    (".inc", "PHP/Pascal/Fortran"),
    (".rst.txt", "reStructuredText"),
    (".txt", "Text"),
    (".pom.xml", "Maven"),
    (".build.xml", "Ant"),
    (".web.config", "XML"),
    (".blade.php", "Blade"),
    (".designer.cs", "C# Designer"),
    (".html.erb", "ERB"),
    (".d.ts", "TypeScript/Qt Linguist"),
    (".config.js", "JavaScript"),
    (".b.c", "C"),
    (".asl", "ACPI Machine Language "),
    (".web.release.config", "XML"),
    (".tar.gz", None),
    (".", None),
    ("", None),
)


def _literal(x: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else "'" + x.replace("'", "''") + "'"


_CASES = "CASE p_partkey % {n} {whens} END".format(n=len(ENDINGS), whens=" ".join(f"WHEN {i} THEN {{{i}}}" for i in range(len(ENDINGS))))


@query(f"SELECT p_partkey, {_CASES.format(*(_literal(x) for _, x in ENDINGS))} AS language FROM part")
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each part; every ending in turn, in a folder with either separator."""
    k = F.col("p_partkey")
    ending = F.element_at(F.array(*[F.lit(e) for e, _ in ENDINGS]), (k % len(ENDINGS) + 1).cast("int"))
    path = F.concat(F.when(k % 2 == 0, "src/v1.c/").otherwise("src\\v1.c\\"), F.lit("part"), k.cast("string"), ending)
    return naming.resolve(table(spark, sf_dir, "part").select("p_partkey", naming.base_name(path).alias("name"))).select("p_partkey", "language")


@query("SELECT language, CASE WHEN regexp_matches(language, 'Python|Ruby|Perl|Shell|bash|[mM]ake|Raku|awk') THEN '#' WHEN regexp_matches(language, 'SQL|Haskell') THEN '--' WHEN regexp_matches(language, 'Lisp|Scheme|Assembly') THEN ';' WHEN regexp_matches(language, 'TeX|MATLAB|Octave|PostScript') THEN '%' WHEN regexp_matches(language, 'XML|HTML|XAML|XSLT') THEN 'xml' ELSE 'c' END AS family, count(*) AS n FROM (SELECT ['WebAssembly', 'Snakemake', 'YAML', 'R', 'zsh', 'Dockerfile', 'Visual Basic/TeX/Apex Class', 'Ruby HTML', 'FXML', 'Oracle PL/SQL', 'sql', 'CMake'][CAST(p_partkey % 12 AS INT) + 1] AS language FROM part) GROUP BY language")
def family_of_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("WebAssembly", "Snakemake", "YAML", "R", "zsh", "Dockerfile", "Visual Basic/TeX/Apex Class", "Ruby HTML", "FXML", "Oracle PL/SQL", "sql", "CMake")
    language = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("p_partkey") % len(names) + 1).cast("int"))
    parts = table(spark, sf_dir, "part").select(language.alias("language"))
    return parts.select("language", naming.style("language").alias("family")).groupBy("language", "family").agg(F.count(F.lit(1)).alias("n"))


#: Contents in hexadecimal, their mark, whether they are text, and their lines.
CONTENTS = (
    ("EFBBBF780A", "utf-8", True, 1),
    ("EFBBBF", "utf-8", True, 0),
    ("EFBB", "none", True, 1),
    ("FFFE", "utf-16-le", True, 0),
    ("FFFE61000A00", "utf-16-le", True, 1),
    ("FEFF0061000A", "utf-16-be", True, 1),
    ("FFFE61", "utf-16-le", False, 0),
    ("6100620A", "none", False, 0),
    ("61000A00", "none", False, 0),
    ("FFFE000061000000", "utf-16-le", False, 0),
    ("", "none", True, 0),
    ("FF0A80", "none", True, 2),
)


@query("SELECT s_suppkey, mark, n FROM supplier JOIN (VALUES " + ", ".join(f"({i}, '{m}', CAST({n} AS BIGINT))" for i, (_, m, _, n) in enumerate(CONTENTS)) + f") AS v(i, mark, n) ON s_suppkey % {len(CONTENTS)} = i")
def bom_and_binary_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = (F.col("s_suppkey") % len(CONTENTS) + 1).cast("int")
    content = F.unhex(F.element_at(F.array(*[F.lit(c[0]) for c in CONTENTS]), k))
    named = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.col("s_suppkey").cast("string"), F.lit(".txt")).alias("name"), content.alias("content"))
    marked = named.withColumn("mark", decoding.bom("content"))
    return stats.content_stats(marked).select("s_suppkey", "mark", F.col("total").alias("n"))


#: Texts with special line ends, their style, and total, blank and comment lines.
TEXTS = (
    ("a\r\nb\rc\n", "c", 3, 0, 0),
    ("\r\r\n\n", "c", 3, 3, 0),
    ("/*\n", "c", 2, 0, 2),
    ("/*", "c", 1, 0, 1),
    ("/*/\nx\n", "c", 3, 0, 3),
    ("/* a /*/\nx\n", "c", 2, 0, 1),
    ("*/* a\nb */\n", "c", 2, 0, 1),
    ('"a\n\n  \n// still\n"\n', "c", 5, 1, 0),
    ("it's\n// c\n", "c", 2, 0, 0),
    ('"\\\n"x\n// c\n', "c", 3, 0, 0),
    ("/* a\n   ", "c", 2, 0, 2),
    ("   ", "c", 0, 0, 0),
    ("<!-->\nx\n", "xml", 3, 0, 3),
    ("<!---->\n", "xml", 1, 0, 1),
    ("# don't\n# c\n", "#", 2, 0, 2),
    ("-- x\n- y\na--b\n", "--", 3, 0, 1),
    ("% x\n\\% y\n", "%", 2, 0, 1),
    ("; x\n(a) ; y\n// z\n", ";", 3, 0, 1),
)


@query("SELECT c_custkey, total, blank, comment FROM customer JOIN (VALUES " + ", ".join(f"({i}, CAST({t} AS BIGINT), CAST({b} AS BIGINT), CAST({c} AS BIGINT))" for i, (_, _, t, b, c) in enumerate(TEXTS)) + f") AS v(i, total, blank, comment) ON c_custkey % {len(TEXTS)} = i")
def newline_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends, open comments at the end, strings over lines: one text for each customer, in turn."""
    k = (F.col("c_custkey") % len(TEXTS) + 1).cast("int")
    text, family = (F.element_at(F.array(*[F.lit(t[i]) for t in TEXTS]), k) for i in (0, 1))
    found = table(spark, sf_dir, "customer").select("c_custkey", lexing.line_stats(text, family).alias("s"))
    return found.select("c_custkey", "s.total", "s.blank", "s.comment")


# --- a tree of files: one for each customer, in folders by nation, a hidden one among them --------------------------------


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """Write the tree to the folder that driver and executors share, and return its root; it is deleted when the driver ends."""
    k = F.col("c_custkey")
    ending = F.when(k % 3 == 0, ".c").when(k % 3 == 1, ".py").otherwise(".unknown")
    folder = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat(F.lit(".n"), F.col("c_nationkey").cast("string"), F.lit("/"))).otherwise(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("/sub/")))
    mark = F.when(k % 3 == 0, "// ").otherwise("# ")
    text = F.concat(F.repeat(F.concat(mark, F.col("c_name"), F.lit("\n")), (k % 3).cast("int") + 1), F.repeat(F.lit("x = 1\r\n"), (k % 4).cast("int")), F.repeat(F.lit("\n"), (k % 2).cast("int")))
    root = files.shared_tree(spark)
    paths = table(spark, sf_dir, "customer").select(F.concat(folder, F.lit("f"), k.cast("string"), ending).alias("path"), F.encode(text, "UTF-8").alias("content"))
    files.write_files(paths, root)
    return root


_TREE = """
SELECT c_custkey AS k, 'f' || c_custkey || CASE c_custkey % 3 WHEN 0 THEN '.c' WHEN 1 THEN '.py' ELSE '.unknown' END AS name,
       repeat(CASE c_custkey % 3 WHEN 0 THEN '// ' ELSE '# ' END || c_name || chr(10), CAST(c_custkey % 3 + 1 AS INT)) || repeat('x = 1' || chr(13) || chr(10), CAST(c_custkey % 4 AS INT)) || repeat(chr(10), CAST(c_custkey % 2 AS INT)) AS text
FROM customer"""
_TREE_LINES = f"SELECT CASE k % 3 WHEN 0 THEN 'C' ELSE 'Python' END AS language, k % 3 + 1 + k % 4 + k % 2 AS total, k % 2 AS blank, k % 3 + 1 AS comment FROM ({_TREE}) WHERE k % 3 < 2"


@query(_totalled(_TREE_LINES))
def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory tree, listed, opened and counted on executors."""
    return stats.report(stats.file_stats(files.list_files(spark, _tree(spark, sf_dir))))


@query(f"SELECT name, CAST(octet_length(encode(text)) AS BIGINT) AS size FROM ({_TREE})")
def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and sizes of all files, hidden folders included."""
    return files.list_files(spark, _tree(spark, sf_dir)).select("name", "size")


@query(f"SELECT name FROM ({_TREE}) WHERE k % 5 = 0")
def flat_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without recursion: the files of the root alone."""
    return files.list_files(spark, _tree(spark, sf_dir), recursive=False).select("name")


@query(f"SELECT name, sha256(text) AS content_sha256, 'SUCCESS' AS status FROM ({_TREE})")
def tree_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole contents of all files."""
    return files.read_contents(files.list_files(spark, _tree(spark, sf_dir))).select("name", F.sha2("content", 256).alias("content_sha256"), "status")


@query(f"SELECT count(*) AS ignored FROM ({_TREE}) WHERE k % 3 = 2")
def ignored_in_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.ignored_count(files.list_files(spark, _tree(spark, sf_dir)))


#: Arguments of the command line and the exit code or the options they stand for.
ARGUMENTS = (
    ("", "exit 0"),
    ("-help", "exit 0"),
    ("-?", "exit 0"),
    ("x", "x plain recursive"),
    ("x -json", "x json recursive"),
    ("x -nr", "x plain flat"),
    ("x -norecurse -json", "x json flat"),
    ("x -b sync", "x plain recursive failfast"),
    ("x -backend synchronous", "x plain recursive failfast"),
    ("x -b tp -threads 7", "x plain recursive threads=7"),
    ("x -b auto", "x plain recursive"),
    ("x -b other", "exit 4"),
    ("x -b", "exit 4"),
    ("x -threads 0", "exit 4"),
    ("x -threads 4097", "exit 4"),
    ("x -threads -1", "exit 4"),
    ("x -threads", "exit 4"),
    ("x -odd -v", "x plain recursive verbose"),
)


@query("SELECT n_nationkey, a AS arguments, o AS outcome FROM nation JOIN (VALUES " + ", ".join(f"({i}, '{a}', '{o}')" for i, (a, o) in enumerate(ARGUMENTS)) + ") AS v(i, a, o) ON n_nationkey = i")
def command_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line makes of its arguments: one line of them for each nation, as far as they go."""
    from .. import cli

    def outcome(arguments: str) -> str:
        o = cli.parse(arguments.split())
        if isinstance(o, int):
            return f"exit {o}"
        words = [o["root"], "json" if o["json"] else "plain", "recursive" if o["recursive"] else "flat", *(["failfast"] if o["failfast"] else []), *([f"threads={o['threads']}"] if o["threads"] else []), *(["verbose"] if o["verbose"] else [])]
        return " ".join(words)

    outcomes = spark.createDataFrame([(i, a, outcome(a)) for i, (a, _) in enumerate(ARGUMENTS)], "n_nationkey int, arguments string, outcome string")
    return table(spark, sf_dir, "nation").select("n_nationkey").join(F.broadcast(outcomes), "n_nationkey")
