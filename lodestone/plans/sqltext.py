"""DuckDB SQL for the column functions, from the same tables of fixed values."""

from __future__ import annotations

from lodestone.functions import languages, paths, query, text


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]" if values else "CAST([] AS VARCHAR[])"


def lower(e: str) -> str:
    return f"translate({e}, '{text.UPPER}', '{text.LOWER}')"


def lines(e: str) -> str:
    every = f"list_transform(string_split({e}, chr(10)), lambda l: regexp_replace(l, chr(13) || '$', ''))"
    return f"(CASE WHEN {every}[-1] = '' THEN {every}[1:len({every}) - 1] ELSE {every} END)"


def segments(e: str) -> str:
    for p in ("([a-z])([A-Z])", "([A-Za-z])([0-9])", "([0-9])([A-Za-z])"):
        e = f"regexp_replace({e}, '{p}', '\\1 \\2', 'g')"
    return f"list_filter(regexp_split_to_array({lower(e)}, '[^a-z0-9]+'), lambda t: t <> '')"


def tokens(e: str) -> str:
    return f"list_filter({segments(e)}, lambda t: length(t) < {text.LONG_TOKEN})"


def singular(t: str) -> str:
    rules = [f"WHEN length({t}) <= 3 OR NOT regexp_matches({t}, '^[a-z]+$') OR {t} IN ({', '.join(map(q, text.UNCOUNTABLE))}) THEN {t}"]
    rules += [f"WHEN {t} = {q(a)} THEN {q(b)}" for a, b in text.IRREGULAR.items()]
    rules.append(f"WHEN regexp_matches({t}, {q(text.UNCHANGED_ENDING)}) THEN {t}")
    rules += [f"WHEN regexp_matches({t}, {q(p)}) THEN {t}[1:length({t}) - {n}] || {q(a)}" for p, n, a in text.PLURAL_RULES]
    return f"(CASE {' '.join(rules)} ELSE {t} END)"


def compact(e: str) -> str:
    return lower(f"regexp_replace({e}, '[^A-Za-z0-9]', '', 'g')")


def raw_words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, '[^A-Za-z0-9]+'), lambda t: t <> '')"


def variants(t: str) -> str:
    return f"list_sort(list_distinct(list_concat([{lower(t)}], {segments(t)})))"


def embedding_term(t: str) -> str:
    one = singular(t)
    return f"(CASE {one} {' '.join(f'WHEN {q(a)} THEN {q(b)}' for a, b in text.EMBEDDING_ALIASES.items())} ELSE {one} END)"


def ordered_distinct(e: str) -> str:
    return f"list_filter({e}, lambda d, i: list_position({e}, d) = i)"


def _first(e: str, test: str) -> str:
    return f"coalesce(list_filter({lines(e)}, lambda l: trim(l) <> '' AND {test})[1], '')"


def preview_line(e: str) -> str:
    return f"trim({_first(e, 'NOT starts_with(trim(l), ' + q('//') + ')')})"


def signature_line(e: str) -> str:
    return _first(e, "NOT regexp_matches(trim(l), '^(//|#)')")


def truncated(e: str) -> str:
    n = text.REASON_LENGTH
    return f"(CASE WHEN length({e}) > {n} THEN {e}[1:{n}] || '...' ELSE {e} END)"


def md5_number(e: str) -> str:
    return f"CAST(('0x' || substr(md5({e}), 1, 8)) AS BIGINT)"


def vector_key(e: str) -> str:
    return f"CAST(('0x' || substr(md5({e}), 1, 15)) AS BIGINT)"


def file_name(p: str) -> str:
    return f"string_split({p}, '/')[-1]"


def language(p: str) -> str:
    name, ext = file_name(p), lower(f"regexp_extract({file_name(p)}, '^.+\\.([^.]*)$', 1)")
    rules = [f"WHEN regexp_matches({name}, {q('^(' + '|'.join(n.split()) + ')(' + chr(92) + '..*)?$')}) THEN {q(lang)}" for lang, n in languages.FILENAMES.items()]
    rules += [f"WHEN {ext} IN ({', '.join(map(q, e.split()))}) THEN {q(lang)}" for lang, e in languages.EXTENSIONS.items()]
    return f"(CASE {' '.join(rules)} ELSE 'text' END)"


def resolve(a: str) -> str:
    t = f"regexp_replace({lower(a)}, '^\\.+', '')"
    rules = [f"WHEN {t} IN ({', '.join(map(q, languages.NAMES))}) THEN {t}"]
    rules += [f"WHEN {t} IN ({', '.join(map(q, e.split()))}) THEN {q(lang)}" for lang, e in languages.EXTENSIONS.items()]
    rules += [f"WHEN {t} = {q(o)} THEN {q(lang)}" for o, lang in languages.ALIASES.items()]
    return f"(CASE {' '.join(rules)} END)"


def definition_kind(lang: str, line: str) -> str:
    t = f"ltrim(translate({line}, chr(9), ' '))"
    out = []
    for name, rules in languages.RULES.items():
        own = []
        for kind, rule in rules:
            test = f"contains({t}, '(') AND ends_with({t}, '{{') AND NOT regexp_matches({t}, {q(languages.NOT_A_FUNCTION)})" if rule == languages.C_LIKE else f"regexp_matches({t}, {q(rule)})"
            out_kind = f"WHEN {test} THEN {q(kind)}"
            own.append(out_kind)
        out.append(f"WHEN {q(name)} THEN (CASE {' '.join(own)} END)")
    return f"(CASE {lang} {' '.join(out)} END)"


def is_test(p: str) -> str:
    return f"regexp_matches({lower(p)}, {q(paths.TEST_PATH)})"


def authority(p: str) -> str:
    return f"(CASE {' '.join(f'WHEN regexp_matches({lower(p)}, {q(r)}) THEN CAST({v} AS DOUBLE)' for r, v in paths.AUTHORITY)} ELSE CAST(1 AS DOUBLE) END)"


def kind_factor(k: str) -> str:
    return f"(CASE {k} {' '.join(f'WHEN {q(n)} THEN CAST({v} AS DOUBLE)' for n, v in paths.KIND_FACTORS.items())} ELSE CAST(1 AS DOUBLE) END)"


def is_definition(k: str) -> str:
    return f"({k} IN ({', '.join(map(q, paths.DEFINITIONS))}))"


def ignored(p: str, rules) -> str:
    out = "FALSE"
    for negated, rule in rules:
        out = f"(CASE WHEN regexp_matches(part, {q(rule)}) THEN {'FALSE' if negated else 'TRUE'} ELSE {out} END)"
    parts = f"string_split({p}, '/')"
    above = f"list_transform(range(1, len({parts}) + 1), lambda i: array_to_string({parts}[1:i], '/') || CASE WHEN i < len({parts}) THEN '/' ELSE '' END)"
    return f"(len(list_filter({above}, lambda part: {out})) > 0)"


def glob_match(p: str, include, exclude) -> str:
    test = lambda g: f"regexp_matches({p}, {q(paths.glob_regex(g))})"
    yes = "(" + " OR ".join(map(test, include)) + ")" if include else "TRUE"
    return yes + "".join(f" AND NOT {test(g)}" for g in exclude)


def query_tokens(e: str) -> str:
    parts = f"list_transform({segments(e)}, lambda s: {singular('s')})"
    return ordered_distinct(f"list_filter({parts}, lambda w: length(w) >= 2 AND NOT list_contains({words(query.STOPWORDS)}, w))")


def expanded(t: str) -> str:
    alias = "CASE a " + " ".join(f"WHEN {q(k)} THEN {words(v)}" for k, v in query.TOKEN_ALIASES.items()) + " ELSE CAST([] AS VARCHAR[]) END"
    out = f"list_concat({t}, flatten(list_transform({t}, lambda a: {alias})))"
    for a, b, c in query.PHRASE_ALIASES:
        out = f"list_concat({out}, CASE WHEN list_contains({t}, {q(a)}) AND list_contains({t}, {q(b)}) THEN [{q(c)}] ELSE CAST([] AS VARCHAR[]) END)"
    return ordered_distinct(out)


def query_variants(e: str, t: str, x: str) -> str:
    none = "CAST([] AS VARCHAR[])"
    spaced, joined = f"array_to_string({t}, ' ')", f"array_to_string({t}, '')"
    camel = f"{t}[1] || array_to_string(list_transform({t}[2:], lambda w: upper(w[1:1]) || w[2:]), '')"
    one = lambda test, value: f"CASE WHEN {test} THEN [{value}] ELSE {none} END"
    parts = [
        f"[trim({e})]", one(f"len({t}) > 0 AND {spaced} <> {lower(f'trim({e})')}", spaced), one(f"length({joined}) >= 4 AND {joined} <> {lower(f'trim({e})')}", joined),
        one(f"len({t}) >= 2", f"array_to_string({t}, '_')"), one(f"len({t}) >= 2", camel), f"list_filter({x}, lambda w: NOT list_contains({t}, w))",
    ]
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return f"(CASE WHEN trim({e}) = '' THEN {none} ELSE list_sort(list_distinct({out})) END)"


def location_intent(e: str) -> str:
    return f"list_has_any(regexp_split_to_array({lower(e)}, '[^a-z0-9]+'), {words(query.LOCATION_WORDS)})"
