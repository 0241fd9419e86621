"""File languages, their aliases and the line rules that mark definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, col

# Languages with their extensions, in order; the first match wins.
EXTENSIONS = {
    "rust": "rs", "go": "go", "c": "c h", "cpp": "cpp cc cxx hpp hxx hh", "zig": "zig", "nim": "nim nims", "java": "java", "kotlin": "kt kts",
    "scala": "scala sc", "groovy": "groovy gvy", "csharp": "cs", "python": "py pyi", "typescript": "ts tsx mts cts", "javascript": "js jsx mjs cjs",
    "ruby": "rb rake", "php": "php", "perl": "pl pm", "lua": "lua", "swift": "swift", "dart": "dart", "objc": "m mm", "elixir": "ex exs",
    "erlang": "erl hrl", "haskell": "hs", "ocaml": "ml mli", "clojure": "clj cljs cljc edn", "r": "r", "julia": "jl", "shell": "sh bash zsh fish",
    "powershell": "ps1 psm1 psd1", "sql": "sql", "protobuf": "proto", "thrift": "thrift", "graphql": "graphql gql", "terraform": "tf tfvars hcl",
    "makefile": "mk", "markdown": "md mdx", "html": "html htm xhtml", "css": "css scss sass less", "xml": "xml xsl xslt svg plist",
    "config": "toml yaml yml ini cfg env", "json": "json jsonl json5 geojson", "text": "txt log csv tsv rst adoc",
}
# Whole file names (or such a name and a dot).
FILENAMES = {"ruby": "Rakefile Gemfile", "dockerfile": "Dockerfile", "makefile": "Makefile makefile GNUmakefile"}
# Further names of languages.
ALIASES = {"c++": "cpp", "cplusplus": "cpp", "c#": "csharp", "objective-c": "objc", "objective_c": "objc", "objectivec": "objc"}

NAMES = tuple(dict.fromkeys([*EXTENSIONS, *FILENAMES]))
BY_EXTENSION = {e: name for name, found in reversed(EXTENSIONS.items()) for e in found.split()}


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """What follows the last dot of the file name, in lower case; empty without one or if nothing precedes it."""
    return ascii_lower(F.regexp_extract(file_name(path), r"^.+\.([^.]*)$", 1))


def language(path: Column | str) -> Column:
    """Language of a path: by file name, then by extension, else text. One lookup, so that filters on it stay small plans."""
    name, named = file_name(path), None
    for lang, found in FILENAMES.items():
        test = name.rlike(f"^({'|'.join(found.split())})(\\..*)?$")
        named = F.when(test, F.lit(lang)) if named is None else named.when(test, F.lit(lang))
    table = F.create_map(*[F.lit(x) for e, lang in BY_EXTENSION.items() for x in (e, lang)])
    return F.coalesce(named, F.element_at(table, extension(path)), F.lit("text"))


def resolve_name(alias: str) -> str | None:
    """``resolve`` for one string."""
    a = alias.lower().lstrip(".")
    return a if a in NAMES else BY_EXTENSION.get(a, ALIASES.get(a))


def resolve(alias: Column | str) -> Column:
    """Language for a name, extension or alias, whatever its case and leading dots; null if unknown."""
    a = F.regexp_replace(ascii_lower(alias), r"^\.+", "")
    out = F.when(a.isin(*NAMES), a)
    for lang, found in EXTENSIONS.items():
        out = out.when(a.isin(*found.split()), F.lit(lang))
    for other, lang in ALIASES.items():
        out = out.when(a == other, F.lit(lang))
    return out


# What a C-like function line may not begin with. Such a line
# holds a parenthesis and ends with a brace.
NOT_A_FUNCTION = r"^(if[ (]|else|for[ (]|while[ (]|switch[ (]|do[ {]|\} else|\} catch|return[ (]|#|//|/\*|case )"
C_LIKE = "<c-like>"

# Line rules by language, in order, over the line without leading
# blanks; the first that matches gives the kind.
FUNCTION, CLASS, MODULE = "Function", "Class", "Module"
RULES: dict[str, list[tuple[str, str]]] = {
    "rust": [(FUNCTION, r"^(fn |pub fn |pub\(crate\) fn |pub\(super\) fn |async fn |pub async fn )"), (CLASS, r"^(pub )?(struct|enum|trait|union) "), (MODULE, r"^(impl |mod |pub mod |pub\(crate\) mod )")],
    "go": [(FUNCTION, r"^func "), (CLASS, r"^type ")],
    "c": [(CLASS, r"^(struct|union|enum|typedef) "), (FUNCTION, C_LIKE)],
    "cpp": [(CLASS, r"^(class|struct|enum|union|typedef) "), (MODULE, r"^namespace "), (CLASS, r"^template "), (FUNCTION, C_LIKE)],
    "zig": [(FUNCTION, r"^(fn |pub fn |export fn )"), (CLASS, r"^(pub )?(const|var) .*struct")],
    "nim": [(FUNCTION, r"^(proc|func|method|iterator) "), (CLASS, r"^type ")],
    "java": [(CLASS, r" class |^class |^((public|protected) )?interface "), (FUNCTION, C_LIKE)],
    "kotlin": [(FUNCTION, r"^((suspend|private|override|internal) )?fun "), (CLASS, r"^((data|sealed|enum|abstract|open|annotation) )?class |^interface |^object ")],
    "scala": [(FUNCTION, r"^((private|override|protected) )?def "), (CLASS, r"^((case|abstract) )?class |^(sealed )?trait |^object ")],
    "groovy": [(FUNCTION, r"^((private|static) )?def "), (CLASS, r"^(class|interface|enum) "), (FUNCTION, C_LIKE)],
    "csharp": [(CLASS, r"^((public|internal|abstract|static|sealed|partial) )?class |^(public )?(interface|struct|enum|record) "), (MODULE, r"^namespace "), (FUNCTION, C_LIKE)],
    "python": [(FUNCTION, r"^(async )?def "), (CLASS, r"^class ")],
    "typescript": [(FUNCTION, r"^(export )?(async )?function | => "), (CLASS, r"^(export )?(abstract )?class |^(export )?(interface|type) ")],
    "javascript": [(FUNCTION, r"^(export )?(async )?function | => "), (CLASS, r"^(export )?(abstract )?class |^(export )?(interface|type) ")],
    "ruby": [(FUNCTION, r"^def "), (CLASS, r"^class "), (MODULE, r"^module ")],
    "php": [(FUNCTION, r"^((public|private|protected|static|public static) )?function "), (CLASS, r"^((abstract|final) )?class |^(interface|trait|enum) "), (MODULE, r"^namespace ")],
    "perl": [(FUNCTION, r"^sub "), (MODULE, r"^package ")],
    "lua": [(FUNCTION, r"^(local )?function ")],
    "swift": [(FUNCTION, r"^((private|public|internal|static|override|mutating) )?func |^init\(|^deinit "), (CLASS, r"^(public )?(class|struct|enum) |^(private|final) class |^(protocol|extension) ")],
    "dart": [(CLASS, r"^(abstract )?class |^(mixin|extension) "), (FUNCTION, C_LIKE)],
    "objc": [(CLASS, r"^@(interface|implementation|protocol) "), (FUNCTION, r"^[-+] \("), (FUNCTION, C_LIKE)],
    "elixir": [(FUNCTION, r"^(def|defp|defmacro|defmacrop) "), (MODULE, r"^(defmodule|defprotocol|defimpl) ")],
    "erlang": [(MODULE, r"^-module\("), (FUNCTION, r"^(-export\(|-spec )|^[a-z].*\(.*->|^[a-z].*->.*\(")],
    "haskell": [(MODULE, r"^module "), (FUNCTION, r"^[^ \-{].* :: |^ :: "), (CLASS, r"^(data|newtype|class|instance|type) ")],
    "ocaml": [(FUNCTION, r"^let "), (CLASS, r"^type "), (MODULE, r"^module ")],
    "clojure": [(FUNCTION, r"^\((defn|defn-|defmacro|defmethod) "), (CLASS, r"^\((deftype|defrecord|defprotocol) "), (MODULE, r"^\(ns ")],
    "r": [(FUNCTION, r"<- function|= function\(")],
    "julia": [(FUNCTION, r"^(function|macro) "), (CLASS, r"^(mutable )?struct |^abstract type "), (MODULE, r"^module ")],
    "shell": [(FUNCTION, r"^function |\(\).*\{$")],
    "powershell": [(FUNCTION, r"(?i)^(function|filter) "), (CLASS, r"(?i)^class ")],
    "sql": [(FUNCTION, r"(?i)^create (or replace )?(function|procedure)"), (CLASS, r"(?i)^create (table|view|index|type|or replace view)")],
    "protobuf": [(FUNCTION, r"^rpc "), (CLASS, r"^(message|enum|service) ")],
    "thrift": [(FUNCTION, r"^rpc "), (CLASS, r"^(message|enum|service) ")],
    "graphql": [(CLASS, r"^(type|input|enum|interface|union|scalar) "), (FUNCTION, r"^(query|mutation|subscription) ")],
    "terraform": [(MODULE, r"^(resource|data|module|provider|variable|output|locals) ")],
}


def _matches(line: Column, rule: str) -> Column:
    if rule == C_LIKE:
        return F.contains(line, F.lit("(")) & F.endswith(line, F.lit("{")) & ~line.rlike(NOT_A_FUNCTION)
    return line.rlike(rule)


def definition_kind(lang: Column, line: Column) -> Column:
    """Function, Class or Module if the line begins a definition in its language, else null."""
    t = F.ltrim(F.translate(line, "\t", " "))
    out = None
    for name, rules in RULES.items():
        own = None
        for kind, rule in rules:
            own = F.when(_matches(t, rule), F.lit(kind)) if own is None else own.when(_matches(t, rule), F.lit(kind))
        out = F.when(lang == name, own) if out is None else out.when(lang == name, own)
    return out
