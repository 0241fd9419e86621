import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import languages, paths
from lodestone.functions import query as fq
from lodestone.functions import text as ft


def values(spark, data, *columns):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, x string")
    return [tuple(r) for r in df.orderBy("i").select(*[c.alias(str(k)) for k, c in enumerate(columns)]).collect()]


SEGMENTS = {
    "calculateTax": ["calculate", "tax"], "snake_case_name": ["snake", "case", "name"], "HTTPServer2Go": ["httpserver", "2", "go"], "getURLFor": ["get", "urlfor"],
    "v2": ["v", "2"], "": [], "__": [], "äÖü abC": ["ab", "c"], "X": ["x"], "src/main.rs": ["src", "main", "rs"], "kebab-case 99x": ["kebab", "case", "99", "x"],
}


def test_segments(spark):
    assert [r[0] for r in values(spark, list(SEGMENTS), ft.segments("x"))] == list(SEGMENTS.values())


def walked(s):
    """Brute force: walk over the characters."""
    out, word = [], ""
    for c in s:
        if not (c.isascii() and c.isalnum()):
            out.append(word)
            word = ""
            continue
        if word:
            p = word[-1]
            if (p.islower() and c.isupper()) or (p.isalpha() != c.isalpha()):
                out.append(word)
                word = ""
        word += c
    return [w.lower() for w in [*out, word] if w]


def test_segments_of_random_strings(spark):
    import random

    rng = random.Random(1)
    data = ["".join(rng.choice("abAB12_ é-") for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    assert [r[0] for r in values(spark, data, ft.segments("x"))] == [walked(s) for s in data]


def test_long_tokens_are_left_out(spark):
    assert values(spark, ["a" * 79 + " " + "b" * 80], ft.tokens("x"))[0][0] == ["a" * 79]


@pytest.mark.parametrize(("plural", "one"), [("taxes", "tax"), ("limits", "limit"), ("queries", "query"), ("classes", "class"), ("class", "class"), ("status", "status"), ("analysis", "analysis"), ("children", "child"), ("bus", "bus"), ("its", "its"), ("data", "data"), ("matches", "match"), ("b2bs", "b2bs"), ("boxes", "box")])
def test_singular(spark, plural, one):
    assert values(spark, [plural], ft.singular("x"))[0][0] == one


def test_lines_and_previews(spark):
    data = ["", "\n", "a", "a\n", "a\r\nb", "// c\n\n  # d\nfn e"]
    got = values(spark, data, ft.lines("x"), ft.preview_line("x"), ft.signature_line("x"))
    assert [g[0] for g in got] == [[], [""], ["a"], ["a"], ["a", "b"], ["// c", "", "  # d", "fn e"]]
    assert got[5][1:] == ("# d", "fn e") and got[0][1:] == ("", "")


QUERIES = {
    "where is the tax calculated?": (["tax", "calculated"], True),
    "command line arguments": (["command", "line", "argument"], False),
    "find the files": ([], True),
    "getUserNames": (["get", "user", "name"], False),
}


def test_query_tokens_and_variants(spark):
    df = spark.createDataFrame([(i, q) for i, q in enumerate(QUERIES)], "query_id bigint, query string")
    rows = sorted(fq.prepared(df).collect(), key=lambda r: r["query_id"])
    assert [(r["tokens"], r["intent"]) for r in rows] == list(QUERIES.values())
    assert rows[1]["expanded"] == ["command", "line", "argument", "cli", "flag", "option"]
    assert rows[1]["variants"] == sorted(["command line arguments", "command line argument", "commandlineargument", "command_line_argument", "commandLineArgument", "cli", "flag", "option"])
    assert rows[2]["variants"] == ["find the files"]


LANGUAGES = {"a/b.rs": "rust", "x.PY": "python", "Makefile": "makefile", "sub/Dockerfile.dev": "dockerfile", "Gemfile": "ruby", "noext": "text", "a.tar.gz": "text", ".env": "text", "q.Tsx": "typescript", "h.h": "c", "w.hpp": "cpp"}


def test_languages(spark):
    assert [r[0] for r in values(spark, list(LANGUAGES), languages.language("x"))] == list(LANGUAGES.values())
    names = ["RS", ".py", "c++", "C#", "nothing", "shell", "zsh", "yml"]
    want = ["rust", "python", "cpp", "csharp", None, "shell", "shell", "config"]
    assert [r[0] for r in values(spark, names, languages.resolve("x"))] == want == [languages.resolve_name(n) for n in names]


DEFINITIONS = [
    ("rust", "pub fn a() {", "Function"), ("rust", "  impl X for Y {", "Module"), ("rust", "pub enum E {", "Class"), ("rust", "let fn_ = 1", None), ("python", "async def f():", "Function"),
    ("python", "    class A:", "Class"), ("go", "func main() {", "Function"), ("c", "int main(void) {", "Function"), ("c", "if (x) {", None), ("c", "struct s {", "Class"), ("cpp", "namespace a {", "Module"),
    ("java", "public class A {", "Class"), ("java", "void f() {", "Function"), ("javascript", "const f = (a) => a", "Function"), ("typescript", "export abstract class B {", "Class"), ("shell", "run() {", "Function"),
    ("sql", "CREATE OR REPLACE FUNCTION f()", "Function"), ("sql", "create table t (", "Class"), ("haskell", "main :: IO ()", "Function"), ("erlang", "add(A, B) -> A + B.", "Function"), ("terraform", 'resource "a" "b" {', "Module"),
    ("r", "f <- function(x) x", "Function"), ("elixir", "defmodule M do", "Module"), ("markdown", "# def", None), ("objc", "- (void)f;", "Function"), ("zig", "pub const S = struct {", "Class"),
]


def test_definitions(spark):
    df = spark.createDataFrame([(i, *d[:2]) for i, d in enumerate(DEFINITIONS)], "i int, lang string, line string")
    got = [r[0] for r in df.orderBy("i").select(languages.definition_kind(F.col("lang"), F.col("line"))).collect()]
    assert got == [d[2] for d in DEFINITIONS]


TESTS = {"tests/a.rs": True, "src/a_test.go": True, "src/test_a.py": True, "a/spec/b.rb": True, "src/contest.rs": False, "src/a.test.ts": True, "lib/testing.rs": False, "x/__mocks__/y.js": True}
AUTHORITY = {"vendor/a.rs": 0.2, "x/yarn.lock": 0.2, "a/fixtures/b.rs": 0.35, "a/b.json": 0.4, "tests/b.md": 0.6, "docs/b.md": 0.5, "src/a.rs": 1.0}


def test_paths(spark):
    assert [r[0] for r in values(spark, list(TESTS), paths.is_test("x"))] == list(TESTS.values())
    assert [r[0] for r in values(spark, list(AUTHORITY), paths.authority("x"))] == list(AUTHORITY.values())


def test_globs_and_scopes(spark):
    data = ["src/a.rs", "src/b/c.rs", "docs/x.md", "src_x/a.rs", "sr%/a.rs"]
    one = lambda include, exclude=(): [p for p, (ok,) in zip(data, values(spark, data, paths.glob_match("x", list(include), list(exclude))), strict=True) if ok]
    assert one([]) == data and one(["*.rs"], ["src/**"]) == ["src_x/a.rs", "sr%/a.rs"] and one(["**/c.rs"]) == ["src/b/c.rs"] and one(["{docs,src}/?.*"]) == ["src/a.rs", "docs/x.md"]
    with pytest.raises(ValueError, match="unclosed"):
        paths.glob_regex("[a")
    scope = lambda s: [p for p, (ok,) in zip(data, values(spark, data, paths.in_scope("x", s)), strict=True) if ok]
    assert scope("src") == ["src/a.rs", "src/b/c.rs"] and scope("sr%") == ["sr%/a.rs"] and scope(None) == data
    assert paths.globs_of(" *.rs, ,a ") == ["*.rs", "a"]


def test_ignore_rules(spark):
    rules = paths.ignore_rules("# c\n*.log\n/build\ntmp/\n!keep.log\na/**/z\n")
    want = {"x.log": True, "d/keep.log": False, "build/x": True, "d/build": False, "d/tmp/q": True, "tmp": False, "a/b/c/z": True, "src/a.rs": False}
    assert [r[0] for r in values(spark, list(want), paths.ignored("x", rules))] == list(want.values())
    back = paths.ignore_rules("build/\n!build/x\nout/*\n!out/x\ngen/**\n!gen/x\n")  # only a folder that isn't hidden itself gives files back
    want = {"build/x": True, "out/x": False, "out/y": True, "out/y/x": True, "gen/x": False, "gen/d/x": True, "d/build/x": True, "x": False}
    assert [r[0] for r in values(spark, list(want), paths.ignored("x", back))] == list(want.values())


@settings(max_examples=60, deadline=None)
@given(st.text("ab/.*?", max_size=8))
def test_globs_compile(glob):
    import re

    re.compile(paths.glob_regex(glob))
