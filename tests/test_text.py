import fnmatch
import html
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codequarry.functions import paths, text
from codequarry.sources import files

few = settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
# no lone surrogates, no NUL: neither can stand in a UTF-8 text column
plain = st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=40)


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in sorted(df.select("i", expression(F.col("v"))).collect())]


@pytest.mark.parametrize("given_text, expected", [
    ("a\nb", "   1: a\n   2: b"),
    ("a\nb\n", "   1: a\n   2: b"),
    ("a\n\nb", "   1: a\n   2: \n   3: b"),
    ("", ""),
])
def test_number_lines(spark, given_text, expected):
    assert column(spark, [given_text], text.number_lines) == [expected]


def test_number_lines_wide(spark):
    assert column(spark, ["x\n" * 10001], text.number_lines)[0].split("\n")[9998:10000] == ["9999: x", "10000: x"]


@few
@given(st.lists(st.text(st.sampled_from("ab\r\n\v\f\x1c\x1d\x1e\x85\u2028\u2029"), max_size=12), min_size=60, max_size=100))
def test_split_lines_like_splitlines(spark, values):
    assert column(spark, values, text.split_lines) == [v.splitlines() for v in values]


@few
@given(st.lists(st.lists(st.sampled_from(["if", "for", "or", "x", " ", "  ", "\n", "elif", "and"]), max_size=14).map("".join), min_size=60, max_size=100))
def test_complexity_counts(spark, values):
    want = [1 + sum(v.count(f" {k} ") + v.count(f"\n{k} ") for k in text.DECISION_KEYWORDS) for v in values]
    assert column(spark, values, text.complexity) == want


@few
@given(st.lists(st.lists(st.sampled_from(["f", "g", "(", " (", "\u00e9t\u00e9", ".", "h1", "\n", " "]), max_size=20).map("".join), min_size=60, max_size=100))
def test_called_names_in_order(spark, values):
    want = [list(dict.fromkeys(n for n in re.findall(r"(\w+)\s*\(", v) if n != "f")) for v in values]
    assert column(spark, values, lambda c: text.called_names(c, F.lit("f"))) == want


def test_called_names_limit(spark):
    body = " ".join(f"n{i}()" for i in range(20))
    assert column(spark, [body], lambda c: text.called_names(c, F.lit("n0"))) == [[f"n{i}" for i in range(1, 20)]]
    assert column(spark, [body], lambda c: text.called_names(c, F.lit("n0"), 10)) == [[f"n{i}" for i in range(1, 11)]]


@few
@given(st.lists(plain, min_size=60, max_size=100))
def test_title_case(spark, values):
    simple = ["".join(c for c in v if c.isascii()) for v in values]
    assert column(spark, simple, text.title_case) == [v.title() for v in simple]


@few
@given(st.lists(plain, min_size=60, max_size=100))
def test_clean_markup(spark, values):
    marked = [f"<p a='{v[:2]}'>{v} &amp; &#x27;&eacute; \n" for v in values]
    want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", v))).strip() for v in marked]
    assert column(spark, marked, text.clean_markup) == want


def test_clean_markup_missing(spark):
    assert column(spark, [None], text.clean_markup) == [""]


@few
@given(st.lists(st.text("ab./-_x", max_size=10), min_size=60, max_size=100),
       st.lists(st.text("ab./*?[]!x", min_size=1, max_size=6), min_size=1, max_size=4))
def test_globs_like_fnmatch(spark, names, patterns):
    got = column(spark, names, lambda c: paths.matches_glob(c, patterns))
    assert got == [any(fnmatch.fnmatchcase(n, p) for p in patterns) for n in names]


def test_glob_modes(spark, rows):
    df = spark.createDataFrame([("src/a.py",), ("tests/b.py",), ("src/c.js",)], "path string")
    assert rows(files.glob_filter(df, ["*.py"], ["tests/*"])) == [("src/a.py",)]
    assert rows(files.glob_filter(df, ["src/*"], [], mode="remote")) == []
    assert rows(files.glob_filter(df, [], ["*.py"])) == [("src/c.js",)]


def test_prune_dirs(spark, rows):
    names = ["a.py", ".git/x.py", "p/.h/x.py", "p/node_modules/q/x.py", "p/q/x.py", "p/build/x.py", "deep/gen/x.py", ".hidden.py"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    kept = {r[0] for r in rows(files.prune_dirs(df, patterns=["build", "deep/g*"]))}
    assert kept == {"a.py", "p/q/x.py", ".hidden.py"}


def test_source_url(spark):
    cases = [
        ("https://github.com/o/r.git", 3, 9, "https://github.com/o/r/blob/main/a.py#L3C1-L9C5"),
        ("https://github.com/o/r", 3, 3, "https://github.com/o/r/blob/main/a.py#L3C1-L3C5"),
        ("git@github.com:o/r", 3, 3, ""), ("https://elsewhere.org/o/r", 3, 3, ""), (None, 3, 3, ""),
    ]
    df = spark.createDataFrame(cases, "repo string, a int, b int, want string")
    link = paths.source_url(F.col("repo"), F.lit("main"), F.lit("a.py"), F.col("a"), F.col("b"), F.lit(1), F.lit(5))
    assert all(r[0] == r[1] for r in df.select(link, "want").collect())


def test_suffix_is_stripped_not_letters(spark):
    assert column(spark, ["https://h/digit.git"], paths.repo_root) == ["https://h/digit"]


def test_paths(spark):
    values = ["a/b/c.tar.gz", "noext", "x/.env", "d/stem.py"]
    assert column(spark, values, paths.extension) == ["gz", "", "env", "py"]
    assert column(spark, values, paths.suffix) == [".gz", "", "", ".py"]
    assert column(spark, values, paths.directory) == ["a/b", "", "x", "d"]
    assert column(spark, values, paths.stem) == ["c", "noext", "", "stem"]
    assert column(spark, ["a/b.pyi", "w\\x.py"], paths.module_path) == ["a.bi", "w.x"]


def test_absolute_links(spark):
    base = "https://h.org/a/b.html?q=1#t"
    hrefs = ["/x", "y.html", "//cdn.org/z", "http://e.org", "mailto:me", "#top", "?p=2", "", "../c", "../../../c/.", "./d/../e?x=../y", "/r/../s/..", "../h.html#a/../b"]
    got = column(spark, hrefs, lambda c: paths.absolute_link(F.lit(base), c))
    assert got == ["https://h.org/x", "https://h.org/a/y.html", "https://cdn.org/z", "http://e.org", "mailto:me", "https://h.org/a/b.html?q=1#top", "https://h.org/a/b.html?p=2", "https://h.org/a/b.html?q=1",
                   "https://h.org/c", "https://h.org/c/", "https://h.org/a/e?x=../y", "https://h.org/", "https://h.org/h.html#a/../b"]


def test_safe_file_name(spark):
    name = column(spark, ["Hello: W\u00f6rld/2_x-y   "], lambda c: paths.safe_file_name(c, F.lit("u")))[0]
    assert re.fullmatch(r"Hello W\u00f6rld2_x-y_\d{1,4}\.md", name)


def test_tokens(spark):
    assert column(spark, ["", "a", "abcdefghijkl", None], text.estimate_tokens) == [0, 1, 2, 0]


def test_references_alone_go_to_python(spark):
    """The texts between references stay out of Python, whose memory would grow with them."""
    values = ["&amp;&lt;x &copy y &#38; &#x26;amp; &nosuch; &", "plain", "", "\u00e9&#128512;&&amp;", "&" + "q" * 40 + ";&gt"]
    assert column(spark, values, text.decode_references) == [html.unescape(v) for v in values]
    plan = spark.createDataFrame([("a",)], "v string").select(text.clean_markup(F.col("v")))._jdf.queryExecution().optimizedPlan().toString()
    sent = next(line for line in plan.splitlines() if "unescape" in line)
    assert "unescape_all(regexp_extract_all(" in sent or "unescape_all(_" in sent or "unescape_all(found" in sent, sent


def test_complexity_in_one_pass(spark):
    values = ["x and and y", "x and and and y", "\nand and and y", "\nif if x", " if if\n", " elif  if or or or or x", "if x", ""]

    def counted(value):
        return 1 + sum(value.count(lead + k + " ") for k in text.DECISION_KEYWORDS for lead in " \n")

    assert column(spark, values, text.complexity) == [counted(v) for v in values]
    # keywords of several words are looked for one by one, as they may share words with others
    assert column(spark, ["a not in b in c"], lambda t: text.complexity(t, ["not in", "in"])) == [4]
    plan = spark.range(1).select(text.complexity(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "replace" not in plan
