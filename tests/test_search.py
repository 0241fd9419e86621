import pytest

from lodestone.operators import candidates as cand
from lodestone.operators import chunking, fusion, index
from lodestone.plans import search

FILES = "workspace_id string, file_path string, text string"


def repo(spark, files):
    return spark.createDataFrame([("w", p, t) for p, t in files.items()], FILES)


def names(spark, files, query, **options):
    got = search.search(repo(spark, files), [query], search.Options(with_ignored=True, **options)).collect()
    return [r["file_path"] for r in sorted(got, key=lambda r: (-r["total_score"], r["file_path"]))]


RUST = "pub fn calculate_tax(amount: f64) -> f64 {\n    amount * 0.2\n}\n\npub fn format_name(first: &str) -> String {\n    first.to_string()\n}\n\npub fn total_with_tax(amount: f64) -> f64 {\n    amount + calculate_tax(amount)\n}\n"


def test_rust_functions(spark):
    got = search.search(repo(spark, {"src/lib.rs": RUST}), ["where is the tax calculated?"], search.Options(with_ignored=True)).collect()
    assert len(got) == 1 and got[0]["file_path"] == "src/lib.rs"
    hits = got[0]["hits"]
    assert "calculate_tax" in hits[0]["preview"] and {"lexical", "semantic"} <= set(hits[0]["sources"])


@pytest.mark.parametrize(("path", "text", "query"), [
    ("app/payments.py", "def calculate_tax(amount):\n    return amount * 0.2\n\ndef refund(amount):\n    return -amount\n", "tax function"),
    ("src/tax.ts", "export function calculateTax(a: number) {\n  return a * 0.2;\n}\nexport function calculateTotal(a: number) {\n  return a + calculateTax(a);\n}\n", "calculate total with tax"),
    ("Total.java", "public class Total {\n    int calculateTotal(int a) {\n        return a;\n    }\n}\n", "where is calculate total in java"),
    ("total.rb", "class Total\n  def calculate_total(a)\n    a\n  end\nend\n", "where is calculate total in ruby"),
])
def test_languages(spark, path, text, query):
    other = {"docs/notes.md": "unrelated notes about the weather and other things", "src/other.rs": "fn walk() {\n    step();\n}\n"}
    assert names(spark, {path: text, **other}, query)[0] == path


def test_definition_before_use_and_source_before_tests(spark):
    files = {"src/mcp.rs": "pub fn start_mcp_server() {\n    serve();\n}\n", "tests/mcp_e2e.rs": "fn check_mcp() {\n    start_mcp_server();\n}\n"}
    assert names(spark, files, "where is mcp implemented")[0] == "src/mcp.rs"
    files = {"src/parse.rs": "pub fn parse_config(path: &str) -> Config {\n    read(path)\n}\n", "src/main.rs": "fn main() {\n    let c = parse_config(\"a\");\n    run(c);\n}\n"}
    assert names(spark, files, "parse_config")[0] == "src/parse.rs"


def test_scope_with_special_names(spark):
    files = {"a_b/x.rs": RUST, "acb/x.rs": RUST, "a%b/x.rs": RUST}
    assert names(spark, files, "calculate_tax", scope="a_b") == ["a_b/x.rs"]
    assert names(spark, files, "calculate_tax", include=["acb/**"]) == ["acb/x.rs"]
    assert names(spark, files, "calculate_tax", type_filter="py") == []


def test_literal_search_is_exact(spark):
    files = {"src/plugin.ts": 'const KEY = "my-plugin:state";\nlet other = 1;\n', "docs/a.md": "nothing"}
    got = search.literal_search(repo(spark, files), "PLUGIN:st").collect()
    assert [(r["file_path"], r["line_no"]) for r in got] == [("src/plugin.ts", 1)]
    assert search.literal_search(repo(spark, files), "  ").count() == 0


def test_regex(spark):
    df = repo(spark, {"a.rs": "fn alpha()\nfn beta()\nlet x = ALPHA;\n", "b.rs": "none\n"})
    got = {(r["file_path"], r["line_no"]) for r in cand.regex_lines(df, r"alpha|be.a").collect()}
    assert got == {("a.rs", 1), ("a.rs", 2), ("a.rs", 3)}
    assert {r["line_no"] for r in cand.regex_lines(df, "fn alpha").collect()} == {1}


@pytest.mark.parametrize(("pattern", "want"), [("hello.*world", ["hello", "world"]), (r"foo\(bar", ["foo(bar"]), (r"\bmain\b", ["main"]), ("ab|abc", ["abc"]), ("a.b", [])])
def test_fragments(pattern, want):
    assert cand.fragments(pattern) == want


def test_regex_folds_case_beyond_ascii(spark):
    df = spark.createDataFrame([("w", "a.md", "Äpfel\nmäßig"), ("w", "b.md", "\u212aelvin task")], "workspace_id string, file_path string, text string")
    assert [r["line"] for r in cand.regex_lines(df, "äpfel").collect()] == ["Äpfel"]
    assert cand.regex_lines(df, "kelvin tas").count() == 1


def test_required_fragments_lose_no_match():
    assert cand.required_fragments("alpha|beta") == [] and cand.required_fragments("colou?r") == [] and cand.required_fragments("fn main") == ["fn main"]


def test_phrase(spark):
    chunks = chunking.chunk_files(repo(spark, {"a.txt": "calculate tax now, tax calculate", "b.txt": "calculate the tax"}))
    fields = index.tokenized(chunks)
    paths = {r["chunk_id"]: r["file_path"] for r in chunks.collect()}
    assert [paths[r["chunk_id"]] for r in cand.phrase(fields, ["calculate", "tax"]).collect()] == ["a.txt"]


def test_hash_vectors(spark):
    df = spark.createDataFrame([("a", "calculate taxes"), ("b", "calc tax"), ("c", "walk the dog"), ("d", "")], "chunk_id string, text string")
    dense = {r["chunk_id"]: r["embedding"] for r in index.dense(index.hash_vectors(df)).collect()}
    assert "d" not in dense and all(abs(sum(x * x for x in v) - 1) < 1e-9 and len(v) == 256 for v in dense.values())
    dot = lambda a, b: sum(x * y for x, y in zip(dense[a], dense[b], strict=True))
    assert dot("a", "b") > 0.2 > dot("a", "c")


def cut(spark, rows):
    df = spark.createDataFrame([(1, f"f{i}", i, i, f"c{i}", float(s), src) for i, (s, src) in enumerate(rows)], "query_id int, file_path string, start_line long, end_line long, chunk_id string, score double, sources array<string>")
    return sorted(r["chunk_id"] for r in fusion.cutoff(df).collect())


def test_cutoff(spark):
    lex = ["lexical"]
    assert cut(spark, [(0.001, lex)]) == ["c0"]
    assert cut(spark, [(1.0, lex), (0.9, lex), (0.2, lex)]) == ["c0", "c1"]
    assert cut(spark, [(1.0, lex), (0.01, ["literal"])]) == ["c0", "c1"]
    assert cut(spark, [(0.005, lex), (0.004, lex)]) == ["c0"]


def test_decay_by_file(spark):
    rows = [(1, "w", "a", i, i, f"c{i}", 1.0 - i / 100) for i in range(6)]
    df = spark.createDataFrame(rows, "query_id int, workspace_id string, file_path string, start_line long, end_line long, chunk_id string, score double")
    got = {r["chunk_id"]: r["score"] for r in fusion.decay(df).collect()}
    assert [round(got[f"c{i}"] / (1 - i / 100), 3) for i in range(6)] == [1, 1, 0.4, 0.4, 0.1, 0.1]


def test_windows_and_preamble(spark):
    text = "\n".join(f"line {i}" for i in range(1, 201))
    got = [(r["start_line"], r["end_line"]) for r in chunking.chunk_files(repo(spark, {"a.txt": text})).orderBy("start_line").collect()]
    assert got == [(1, 80), (61, 140), (121, 200)]
    code = chunking.chunk_files(repo(spark, {"a.rs": "use x;\n\nfn a() {\n}\nfn b() {\n}\n", "e.rs": ""})).orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"], r["kind"]) for r in code] == [(3, 4, "Function"), (5, 6, "Function")]
    assert code[0]["text"] == "// a.rs\n\nfn a() {\n}" and code[0]["signature"] == "fn a() {"


def test_syntax_chunks_fill_gaps(spark):
    text = "import os\n\nclass A:\n    def f(self):\n        return 1\n\nX = 2\n"
    got = [(r["start_line"], r["end_line"], r["kind"]) for r in chunking.syntax_chunks(repo(spark, {"a.py": text})).collect()]
    assert sorted(got) == [(1, 1, "Module"), (3, 5, "Class"), (4, 5, "Function"), (7, 7, "Module")]
    broken = chunking.syntax_chunks(repo(spark, {"a.py": "def f(:\n  x\n"})).collect()
    assert [r["kind"] for r in broken] == ["Function"]


def test_index_on_disk_gives_the_same_ranking(spark, tmp_path):
    files = repo(spark, {"src/lib.rs": RUST, "docs/a.md": "tax notes", "src/b.py": "def total(x):\n    return x\n"})
    ix = search.Index(spark, f"file://{tmp_path}/index").build(files)
    got = {(r["file_path"], r["start_line"], round(r["score"], 9)) for r in ix.search(["total tax"], search.Options(with_ignored=True)).collect()}
    chunks = chunking.chunk_files(files)
    want = {(r["file_path"], r["start_line"], round(r["score"], 9)) for r in search.ranked(chunks, search.query_table(spark, ["total tax"]), search.Options()).collect()}
    assert got == want and got


def test_budgets_grow_with_the_limit_and_end_without_one(spark):
    files = repo(spark, {f"f{i:04}.txt": f"needle number {i}" for i in range(520)})
    chunks, queries = chunking.chunk_files(files, ("workspace_id", "file_path")).localCheckpoint(), search.query_table(spark, ["needle"])
    for o, n in ((search.Options(), 500), (search.Options(limit=52), 520), (search.Options(limit=None), 520), (search.Options(file_names=True), 520)):
        got = search.candidate_lists(chunks, queries, o)
        assert (got.literal.count(), got.lexical.count()) == (n, n)
