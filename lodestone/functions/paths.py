"""Path rules: tests, authority, globs and scopes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, col

# Patterns of test paths, over the lower-cased path.
TEST_PATH = r"/(tests|test|__tests__|spec|specs|mocks|mock|__mocks__)/|/test_|^(tests/|test/|spec/|test_)|[_.](test|spec|mock)\."
# Authority of a path, the first rule that matches; else 1.
AUTHORITY = (
    (r"vendor/|node_modules/|__pycache__/|\.git/|target/|dist/|build/", 0.2),
    (r"(\.lock|\.min\.js|\.min\.css|\.map|\.sum)$", 0.2),
    (r"generated/|__snapshots__/|fixtures/|testdata/|test_data/", 0.35),
    (r"\.(json|csv|yaml|yml|xml|toml|ini|env|sql)$", 0.4),
    (TEST_PATH, 0.6),
    (r"\.(md|txt|rst)$", 0.5),
)
# Factors by kind of chunk.
KIND_FACTORS = {
    "Function": 1.35, "Class": 1.4, "Struct": 1.4, "Trait": 1.4, "Interface": 1.4, "Impl": 1.25, "Enum": 1.25, "Comment": 0.6, "Import": 0.65,
    "Use": 0.65, "Block": 0.75,
}
# Kinds that are definitions.
DEFINITIONS = ("Function", "Class", "Struct", "Trait", "Interface", "Impl", "Enum", "Module")


def is_test(path: Column | str) -> Column:
    return ascii_lower(path).rlike(TEST_PATH)


def authority(path: Column | str) -> Column:
    p, out = ascii_lower(path), None
    for rule, value in AUTHORITY:
        out = F.when(p.rlike(rule), F.lit(value)) if out is None else out.when(p.rlike(rule), F.lit(value))
    return out.otherwise(F.lit(1.0))


def kind_factor(kind: Column | str) -> Column:
    k, out = F.initcap(col(kind)), None
    for name, value in KIND_FACTORS.items():
        out = F.when(k == name, F.lit(value)) if out is None else out.when(k == name, F.lit(value))
    return out.otherwise(F.lit(1.0))


def is_definition(kind: Column | str) -> Column:
    return F.initcap(col(kind)).isin(*DEFINITIONS)


def glob_regex(glob: str) -> str:
    """A regular expression for a glob: * and ? match any characters, ** too; [..], {a,b} and escapes are known."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            if glob.startswith("**/", i):
                out.append("(.*/)?")
                i += 2
            else:
                while glob.startswith("**", i):
                    i += 1
                out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed class in glob: {glob}")
            inner = glob[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("\\", "\\\\") + "]")
            i = end
        elif c == "{":
            out.append("(")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"unclosed group in glob: {glob}")
    return "^" + "".join(out) + "$"


def globs_of(csv: str) -> list[str]:
    """Globs of a comma-separated list, trimmed, empty ones dropped."""
    return [g for g in (x.strip() for x in csv.split(",")) if g]


def glob_match(path: Column | str, include: list[str], exclude: list[str]) -> Column:
    """Included (or nothing is asked to be) and not excluded."""
    p, yes, no = col(path), F.lit(not include), F.lit(False)
    for g in include:
        yes = yes | p.rlike(glob_regex(g))
    for g in exclude:
        no = no | p.rlike(glob_regex(g))
    return yes & ~no


def in_scope(path: Column | str, scope: str | None, is_file: bool = False) -> Column:
    """The file itself, or any path below the folder (whole path components)."""
    if scope is None:
        return F.lit(True)
    return col(path) == scope if is_file else (col(path) == scope) | F.startswith(col(path), F.lit(scope.rstrip("/") + "/"))


def ignore_rules(text: str) -> list[tuple[bool, str]]:
    """(negated, regex) of an ignore file's lines, over paths relative to it; a folder's path ends with a slash."""
    out = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[1:] if negated else line
        below = line.endswith("/")
        anchored = "/" in line.rstrip("/")
        body = _segmented(line.strip("/"))
        out.append((negated, ("^" if anchored else "(^|.*/)") + body + ("/$" if below else "/?$")))
    return out


def _segmented(glob: str) -> str:
    """A glob's expression in which only ** crosses a slash."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(.*/)?")
            i += 3
            continue
        if glob.startswith("**", i):
            out.append(".+" if i + 2 == len(glob) and glob[:i].endswith("/") else ".*")
            i += 2
            continue
        c = glob[i]
        if c == "*":
            whole = glob[:i][-1:] in ("", "/") and glob[i + 1 : i + 2] in ("", "/")
            out.append("[^/]+" if whole else "[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            inner = glob[i + 1 : end]
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def ignored(path: Column | str, rules: list[tuple[bool, str]]) -> Column:
    """Whether an ignore file hides a path: of the file or a folder above it, the last rule that matches hides it.

    So nothing below a hidden folder comes back.
    """
    p = col(path)

    def hidden(i: Column) -> Column:
        part = F.call_function("substring_index", p, F.lit("/"), i)
        at = F.when(F.length(part) < F.length(p), F.concat(part, F.lit("/"))).otherwise(part)
        out = F.lit(False)
        for negated, rule in rules:
            out = F.when(at.rlike(rule), F.lit(not negated)).otherwise(out)
        return out

    return F.exists(F.sequence(F.lit(1), F.size(F.split(p, "/"))), hidden)
