"""The registered queries of the retrieval engine, each over its whole tables, with DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import languages, paths
from lodestone.functions import query as fq
from lodestone.functions import text as ft
from lodestone.operators import candidates as cand
from lodestone.operators import chunking, fusion, index, maintain, present
from lodestone.plans import search
from lodestone.plans import sqltext as s
from lodestone.session import spread, table
from lodestone.sources import files as source_files
from lodestone.sources import tables as adapters
from lodestone.storage import cut

#: Query strings that the search queries run as a batch.
QUERIES = (
    "where is customer_000000007 defined", "total balance", "All rights reserved", "MIT License", "command line output format",
    "nation_3 part_2", "calculateTotal", "return total",
)
IGNORE = "vendor/\n# generated\n*.json\n!config/src1/**\n"
INCLUDE, EXCLUDE = ["src/**", "docs/*.md", "lib/src?/*"], ["*_1*.rs", "src/{nation_4,src2}/**"]
PATTERN = r"rights reserved|return total \+ [0-9]*7;?$"
LITERAL = "License"
PHRASE = ["rights", "reserved"]
TOP = 10

#: name → (query, SQL or None)
REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None):
    def add(f):
        REGISTRY[name] = (f, sql)
        return f

    return add


def _batch(spark: SparkSession) -> DataFrame:
    return search.query_table(spark, list(QUERIES))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_files(adapters.corpus(spark, d))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages and the batch as (query_id, query)."""
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    return bench.unionByName(_batch(spark).select((-F.col("query_id")).alias("query_id"), "query"))


# ---- SQL of the corpus, chunks, fields and queries; a query uses the parts it needs ----

_TURN = lambda values: "[" + ", ".join(s.q(v) for v in values) + f"][1 + doc_id % {len(adapters.FOLDERS)}]"
_NAME = "'customer_' || lpad(CAST(c_custkey AS VARCHAR), 9, '0')"
_K = "CAST(c_custkey AS VARCHAR)"
FILES = f"""
docs AS (
  SELECT source AS workspace_id,
         {_TURN(adapters.FOLDERS)} || '/' || source || '/' || lang || '_' || doc_id || {_TURN(adapters.EXTENSIONS)} AS file_path,
         coalesce(text, '') AS text FROM documents),
code AS (
  SELECT 'src/nation_' || c_nationkey || '/part_' || CAST(floor(c_custkey / {adapters.FUNCTIONS}) AS BIGINT)
           || ['.rs', '.py', '.go', '.java', '.ts'][1 + c_nationkey % 5] AS file_path,
         c_custkey AS k,
         CASE c_nationkey % 5
           WHEN 0 THEN 'pub fn ' || {_NAME} || '(total: u64) -> u64 {{' || chr(10) || '    // adds the key' || chr(10) || '    total + ' || {_K} || chr(10) || '}}' || chr(10)
           WHEN 1 THEN 'def ' || {_NAME} || '(total):' || chr(10) || '    return total + ' || {_K} || chr(10) || chr(10)
           WHEN 2 THEN 'func ' || {_NAME} || '(total int) int {{' || chr(10) || chr(9) || 'return total + ' || {_K} || chr(10) || '}}' || chr(10)
           WHEN 3 THEN 'class Customer' || {_K} || ' {{' || chr(10) || '    int balance(int total) {{' || chr(10) || '        return total + ' || {_K} || ';' || chr(10) || '    }}' || chr(10) || '}}' || chr(10)
           ELSE 'export function calculateTotal' || {_K} || '(total) {{' || chr(10) || '  return total + ' || {_K} || ';' || chr(10) || '}}' || chr(10) END AS body
  FROM customer),
files AS (
  SELECT workspace_id, file_path, text, starts_with(file_path, 'vendor/') AS is_ignored FROM docs
  UNION ALL
  SELECT 'code', file_path, '# generated from customers' || chr(10) || chr(10) || string_agg(body, '' ORDER BY k), FALSE FROM code GROUP BY file_path)"""
CHUNKS = f"""{FILES},
fl AS (SELECT workspace_id, file_path, text, is_ignored, {s.language('file_path')} AS language, {s.lines('text')} AS lines FROM files),
ln AS (SELECT workspace_id, file_path, language, unnest(lines) AS line, generate_subscripts(lines, 1) AS no FROM fl),
sg AS (SELECT * FROM (SELECT *, {s.definition_kind('language', 'line')} AS kind FROM ln) WHERE kind IS NOT NULL),
wi AS (
  SELECT workspace_id, file_path, language, lines, b AS start_line, least(b + {chunking.WINDOW - 1}, len(lines)) AS end_line, 'Text' AS kind
  FROM fl, generate_series(1, greatest((SELECT max(len(lines)) FROM fl), 1), {chunking.WINDOW - chunking.OVERLAP}) g(b)
  WHERE b <= len(lines) AND (b = 1 OR b + {chunking.OVERLAP - 1} < len(lines))),
sp AS (
  SELECT sg.workspace_id, sg.file_path, sg.language, lines, no AS start_line,
         coalesce(lead(no) OVER (PARTITION BY sg.workspace_id, sg.file_path ORDER BY no) - 1, len(lines)) AS end_line, kind
  FROM sg JOIN fl ON sg.workspace_id = fl.workspace_id AND sg.file_path = fl.file_path
  UNION ALL
  SELECT * FROM wi WHERE NOT EXISTS (SELECT 1 FROM sg WHERE sg.workspace_id = wi.workspace_id AND sg.file_path = wi.file_path)),
ct AS (SELECT workspace_id, file_path, language, start_line, end_line, kind, '// ' || file_path || chr(10) || chr(10) || array_to_string(lines[start_line:end_line], chr(10)) AS text FROM sp),
ci AS (SELECT *, md5(concat_ws('|', file_path, CAST(start_line AS VARCHAR), CAST(end_line AS VARCHAR), text)) AS chunk_id FROM ct),
chunks AS (SELECT *, {s.vector_key('chunk_id')} AS vector_key, CASE WHEN kind IN ('Function', 'Class', 'Module') THEN {s.signature_line('text')} ELSE '' END AS signature FROM ci),
fields AS (
  SELECT chunk_id, 'text' AS field, {s.tokens('text')} AS tokens FROM chunks
  UNION ALL SELECT chunk_id, 'file_path', {s.tokens('file_path')} FROM chunks
  UNION ALL SELECT chunk_id, 'signature', {s.tokens('signature')} FROM chunks),
oc AS (SELECT chunk_id, field, len(tokens) AS length, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS position FROM fields)"""
_BATCH = "SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), {s.q(t)})" for i, t in enumerate(QUERIES, 1)) + ") b(query_id, query)"


def _prepared(source: str) -> str:
    return f"""
qa AS ({source}),
qb AS (SELECT *, {s.query_tokens('query')} AS tokens FROM qa),
qc AS (SELECT *, {s.expanded('tokens')} AS expanded FROM qb),
qq AS (SELECT *, {s.query_variants('query', 'tokens', 'expanded')} AS variants, {s.location_intent('query')} AS intent, {s.lower('trim(query)')} AS low, {s.compact('trim(query)')} AS compact FROM qc),
vv AS (SELECT query_id, unnest(variants) AS variant FROM qq),
vt AS (SELECT query_id, variant, unnest(list_distinct({s.tokens('variant')})) AS term FROM vv)"""


def _bm25(weights: dict[str, float]) -> str:
    factor = "CASE m.field " + " ".join(f"WHEN {s.q(f)} THEN CAST({w} AS DOUBLE)" for f, w in weights.items()) + " END"
    fields = ", ".join(map(s.q, weights))
    return f"""
tf AS (SELECT field, term, chunk_id, length, count(*) AS tf FROM oc WHERE field IN ({fields}) AND term IN (SELECT term FROM vt) GROUP BY ALL),
st AS (SELECT field, count(*) AS n, avg(len(tokens)) AS mean_length FROM fields WHERE field IN ({fields}) GROUP BY field),
dt AS (SELECT field, term, count(*) AS df FROM tf GROUP BY ALL),
sc AS (
  SELECT m.term, m.chunk_id, {factor} * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {cand.K1 + 1} / (tf + {cand.K1} * ({1 - cand.B} + {cand.B} * length / mean_length)) AS s
  FROM tf m JOIN dt ON m.field = dt.field AND m.term = dt.term JOIN st ON m.field = st.field),
bv AS (SELECT query_id, variant, chunk_id, sum(s) AS score FROM sc JOIN vt USING (term) GROUP BY ALL)"""


LEXICAL = f"""{CHUNKS},{_prepared(_BATCH)},{_bm25(index.FIELDS)},
bq AS (SELECT query_id, chunk_id, max(score) AS score FROM bv GROUP BY ALL),
bk AS (SELECT query_id, b.chunk_id, score * CASE WHEN {s.is_definition('kind')} THEN {index.DEFINITION_BOOST} ELSE 1.0 END AS score FROM bq b JOIN chunks c ON b.chunk_id = c.chunk_id),
lx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bk) WHERE rank <= 500)"""

_HASH = lambda key, text, source: f"""SELECT {key}, md5n % {index.DIMENSIONS} AS bucket, sum(CASE WHEN (md5n >> 16) & 1 = 0 THEN 1 ELSE -1 END) AS total
  FROM (SELECT {key}, {s.md5_number('term')} AS md5n FROM (SELECT {key}, unnest(list_transform(flatten(list_transform({s.raw_words(text)}, lambda r: {s.variants('r')})), lambda v: {s.embedding_term('v')})) AS term FROM {source}))
  GROUP BY ALL HAVING total <> 0"""  # noqa: E731


def _vectors(name: str, key: str, text: str, source: str) -> str:
    return f"""
{name}_t AS ({_HASH(key, text, source)}),
{name} AS (SELECT {key}, bucket, total / sqrt(CAST(sum(total * total) OVER (PARTITION BY {key}) AS DOUBLE)) AS weight FROM {name}_t)"""


_c, _e = "c.text", "expanded"
_frac = lambda test: f"(CASE WHEN len(expanded) > 0 THEN CAST(len(list_filter(expanded, lambda t: {test})) AS DOUBLE) / len(expanded) ELSE 0.0 END)"
COVER = _frac(f"contains({s.lower('text')}, t)")
SEGMENT = _frac(f"len(list_filter(string_split({s.lower('file_path')}, '/'), lambda p: contains(p, t))) > 0")
_FORMS = "[low, replace(low, ' ', '-'), replace(low, ' ', '_'), replace(low, ' ', '')]"
_PART = "list_filter(list_transform(" + _FORMS + ", lambda c: CASE WHEN p = c THEN 1.0 WHEN length(p) > length(c) AND (starts_with(p, c) OR ends_with(p, c)) THEN 0.7 END), lambda x: x IS NOT NULL)"
EXACT = f"""CAST(CASE WHEN low = '' THEN 0.0
  WHEN len(flatten(list_transform(string_split({s.lower('file_path')}, '/'), lambda p: {_PART}))) > 0 THEN flatten(list_transform(string_split({s.lower('file_path')}, '/'), lambda p: {_PART}))[1]
  WHEN len(list_filter({_FORMS}, lambda c: length(c) >= 4 AND contains({s.lower('file_path')}, c))) > 0 THEN 0.4 ELSE 0.0 END AS DOUBLE)"""
_STEM = s.lower(f"regexp_replace({s.file_name('file_path')}, '^(.+)\\.[^.]*$', '\\1')")
STEM = f"""CAST(CASE WHEN len(list_filter(expanded, lambda t: {_STEM} = t OR {s.compact(_STEM)} = {s.compact('t')})) > 0 THEN 1.0
  WHEN len(list_filter(expanded, lambda t: contains({_STEM}, t))) > 0 THEN 0.5 ELSE 0.0 END AS DOUBLE)"""
_LINE = s.lower(s.signature_line("text"))
DEFINED = f"(CASE WHEN {_LINE} = '' THEN 0.0 ELSE {_frac(f'contains({_LINE}, t)')} END)"
BOOST = f"""CAST(CASE WHEN low = '' THEN 0.0 WHEN contains({s.lower('text')}, low) OR contains({s.lower('file_path')}, low) THEN 0.20
  WHEN compact <> '' AND (contains({s.compact('text')}, compact) OR contains({s.compact('file_path')}, compact)) THEN 0.10 ELSE 0.0 END AS DOUBLE)"""
PLACE = f"""CAST(greatest(0.0, CASE WHEN {s.is_definition('kind')} THEN 0.7 ELSE 0.0 END + CASE WHEN kind = 'Module' THEN 0.5 ELSE 0.0 END
  + CASE WHEN regexp_matches({s.lower('file_path')}, '^(src|app|lib|pkg)/') THEN 0.35 ELSE 0.0 END - CASE WHEN {s.is_test('file_path')} THEN 0.35 ELSE 0.0 END) AS DOUBLE)"""

LISTS = f"""{LEXICAL},{_vectors('hv', 'chunk_id', 'text', 'chunks')},{_vectors('qv', 'query_id', 'query', 'qq')},
vn AS (SELECT query_id, variant, count(*) AS n_terms FROM vt GROUP BY ALL),
ph AS (SELECT query_id, variant, chunk_id, count(*) AS n FROM (SELECT DISTINCT chunk_id, term FROM oc WHERE field = 'file_path') JOIN vt USING (term) GROUP BY ALL),
pm AS (SELECT DISTINCT query_id, chunk_id FROM ph JOIN vn USING (query_id, variant) WHERE n = n_terms),
pa AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS nth FROM pm ANTI JOIN lx USING (query_id, chunk_id)),
lp AS (SELECT query_id, chunk_id, score, 0 AS part FROM lx UNION ALL SELECT query_id, chunk_id, CAST({cand.PATH_SCORE} AS DOUBLE), 1 FROM pa WHERE nth <= 100),
l1 AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY part, round(score, 9) DESC, chunk_id) AS rank FROM lp),
sv AS (SELECT query_id, chunk_id, sum(hv.weight * qv.weight) AS score FROM hv JOIN qv USING (bucket) GROUP BY ALL HAVING round(score, 9) > 0),
l2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM sv) WHERE rank <= 200),
li AS (SELECT DISTINCT query_id, chunk_id, file_path, start_line FROM chunks c JOIN vv ON contains({s.lower('c.text')}, {s.lower('variant')})),
l3 AS (SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY file_path, start_line, chunk_id) AS rank FROM li) WHERE rank <= 500),
al AS (
  SELECT query_id, chunk_id, {fusion.LIST_WEIGHTS['lexical']} / ({fusion.RANK_OFFSET} + rank) + CASE WHEN score > 0 THEN ln(1 + score) ELSE 0 END * {fusion.LEXICAL_SCORE} AS s, 'lexical' AS source FROM l1
  UNION ALL SELECT query_id, chunk_id, {fusion.LIST_WEIGHTS['semantic']} / ({fusion.RANK_OFFSET} + rank) + ln(2 * least(1.0, greatest(0.0, score)) + 1) * {fusion.SEMANTIC_SCORE}, 'semantic' FROM l2
  UNION ALL SELECT query_id, chunk_id, {fusion.LIST_WEIGHTS['literal']} / ({fusion.RANK_OFFSET} + rank), 'literal' FROM l3),
mg AS (SELECT query_id, chunk_id, sum(s) AS base, list_sort(list_distinct(list(source))) AS sources FROM al GROUP BY ALL)"""

RANKED = f"""{LISTS},
cd AS (
  SELECT m.*, c.workspace_id, c.file_path, c.start_line, c.end_line, c.kind, c.text, expanded, low, compact, intent,
         count(*) OVER (PARTITION BY m.query_id, workspace_id, file_path) AS n_file
  FROM mg m JOIN chunks c ON m.chunk_id = c.chunk_id JOIN qq ON m.query_id = qq.query_id),
fe AS (
  SELECT *, {COVER} AS cover, {SEGMENT} AS f_segment, {EXACT} AS f_exact, {STEM} AS f_stem, {DEFINED} AS f_defined, {BOOST} AS f_literal, {PLACE} AS f_place FROM cd),
fs AS (
  SELECT *, (base + f_literal + cover * {fusion.COVERAGE} + f_segment * {fusion.PATH_SEGMENT} + f_exact * {fusion.PATH_EXACT} + f_stem * {fusion.FILE_STEM} + f_defined * {fusion.DEFINITION}
      + CASE WHEN intent THEN f_place * {fusion.LOCATION} ELSE 0.0 END)
    * CASE WHEN list_has_any(sources, ['lexical', 'literal']) THEN 1.0 ELSE {fusion.SEMANTIC_ONLY} END
    * CASE WHEN len(expanded) > 0 AND cover = 0 AND NOT list_contains(sources, 'literal') THEN {fusion.NO_COVERAGE} ELSE 1.0 END
    * {s.kind_factor('kind')} * {s.authority('file_path')} / pow(n_file, {fusion.FILE_POWER}) AS raw FROM fe),
dn AS (SELECT *, row_number() OVER (PARTITION BY query_id, workspace_id, file_path ORDER BY round(raw, 9) DESC, file_path, start_line, end_line, chunk_id) AS nth FROM fs),
rk AS (SELECT *, raw * CASE WHEN nth <= 2 THEN 1.0 WHEN nth <= 4 THEN 0.4 ELSE {fusion.DECAY_REST} END AS score FROM dn),
fx AS (SELECT query_id, avg(score) AS mean, stddev_pop(score) AS dev, max(score) AS best, count(*) AS n FROM rk GROUP BY query_id),
mk AS (
  SELECT rk.*, n <= 1 OR round(score, 9) >= round(greatest(mean - dev, best * {fusion.CUTOFF_SHARE}, {fusion.CUTOFF_LEAST}), 9) OR list_contains(sources, 'literal') AS passes,
         row_number() OVER (PARTITION BY rk.query_id ORDER BY round(score, 9) DESC, file_path, start_line, end_line, chunk_id) AS place
  FROM rk JOIN fx ON rk.query_id = fx.query_id),
rf AS (SELECT * FROM (SELECT *, max(CAST(passes AS INTEGER)) OVER (PARTITION BY query_id) AS any_passes FROM mk) WHERE passes OR (any_passes = 0 AND place = 1))"""

_LOWLINE = s.lower("line")
HITS = f"""{RANKED},
hl AS (
  SELECT r.query_id, r.chunk_id, fl.lines, unnest(fl.lines[r.start_line:r.end_line]) AS line, generate_subscripts(fl.lines[r.start_line:r.end_line], 1) + r.start_line - 1 AS no,
         trim(qq.query) AS query, qq.low, qq.expanded, {s.singular('qq.compact')} AS squeezed
  FROM rf r JOIN fl ON r.workspace_id = fl.workspace_id AND r.file_path = fl.file_path JOIN qq ON r.query_id = qq.query_id),
hs AS (
  SELECT *, CASE WHEN contains(line, query) THEN {present.EXACT} WHEN contains({_LOWLINE}, low) THEN {present.ANY_CASE} ELSE 0.0 END
    + len(list_filter(expanded, lambda t: contains({_LOWLINE}, t))) * {present.TOKEN}
    + CASE WHEN squeezed <> '' AND contains({s.compact('line')}, squeezed) THEN {present.SQUEEZED} ELSE 0.0 END AS points FROM hl),
fo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY points DESC, no) AS nth FROM hs) WHERE nth = 1),
hn AS (SELECT *, greatest(1, no - {present.CONTEXT}) AS lo, least(len(lines), no + {present.CONTEXT}) AS hi, trim(line) AS focus,
         list_filter(expanded, lambda t: contains({s.lower('trim(line)')}, t))[1] AS token FROM fo),
hits AS (
  SELECT r.query_id, r.workspace_id, r.file_path, r.chunk_id, lo AS start_line, hi AS end_line, array_to_string(lines[lo:hi], chr(10)) AS preview,
         CASE WHEN focus = '' THEN 'top hybrid relevance in this file'
              WHEN contains(focus, query) OR contains({s.lower('focus')}, h.low) THEN 'line contains query terms: ' || {s.truncated('focus')}
              WHEN token IS NOT NULL THEN 'line matches token `' || token || '`: ' || {s.truncated('focus')}
              ELSE 'top-ranked pointer: ' || {s.truncated('focus')} END AS reason,
         r.score, r.sources, no AS focus_line
  FROM rf r JOIN hn h ON r.query_id = h.query_id AND r.chunk_id = h.chunk_id),
gf AS (SELECT query_id, workspace_id, file_path, sum(score) AS total_score, count(*) AS hit_count FROM hits GROUP BY ALL),
gr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(total_score, 9) DESC, file_path) AS nth FROM gf) WHERE nth <= 50)"""


def sel(prelude: str, body: str) -> str:
    return f"WITH {prelude.strip()}\n{body}"


# ---- text functions ----


@register("split_identifiers", sel(FILES, f"SELECT file_path, len({s.segments('text')}) AS n, md5(array_to_string({s.segments('text')}, ' ')) AS parts_md5 FROM files"))
def split_identifiers(spark, d):
    return adapters.corpus(spark, d).select("file_path", F.size(ft.segments("text")).cast("bigint").alias("n"), F.md5(F.array_join(ft.segments("text"), " ")).alias("parts_md5"))


@register("code_tokenize", sel(FILES, f"SELECT file_path, generate_subscripts({s.tokens('file_path')}, 1) - 1 AS position, unnest({s.tokens('file_path')}) AS token FROM files"))
def code_tokenize(spark, d):
    return adapters.corpus(spark, d).select("file_path", F.posexplode(ft.tokens("file_path")).alias("position", "token")).withColumn("position", F.col("position").cast("bigint"))


@register("singularize", f"SELECT token, {s.singular('token')} AS one FROM (SELECT DISTINCT unnest({s.segments('text')}) AS token FROM documents)")
def singularize(spark, d):
    words = table(spark, d, "documents").select(F.explode(ft.segments("text")).alias("token")).distinct()
    return words.select("token", ft.singular("token").alias("one"))


@register("token_variants", sel(FILES, f"SELECT word, array_to_string({s.variants('word')}, ' ') AS variants FROM (SELECT DISTINCT unnest({s.raw_words('text')}) AS word FROM files)"))
def token_variants(spark, d):
    words = adapters.corpus(spark, d).select(F.explode(ft.raw_words("text")).alias("word")).distinct()
    return words.select("word", F.array_join(ft.variants(F.col("word")), " ").alias("variants"))


@register("compact_identifier", sel(FILES, f"SELECT file_path, {s.compact('file_path')} AS path_compact, md5({s.compact('text')}) AS text_md5 FROM files"))
def compact_identifier(spark, d):
    return adapters.corpus(spark, d).select("file_path", ft.compact("file_path").alias("path_compact"), F.md5(ft.compact("text")).alias("text_md5"))


_ASKED = "SELECT item_id AS query_id, coalesce(text, '') AS query FROM benchmark UNION ALL SELECT -query_id, query FROM (" + _BATCH + ")"


def _words_of(name: str, field: str, expression: str):
    @register(name, sel(_prepared(_ASKED), f"SELECT query_id, {expression} AS {field} FROM qq"))
    def run(spark, d):
        got = fq.prepared(_asked(spark, d))
        return got.select("query_id", F.col(field) if field == "intent" else F.array_join(field, "|").alias(field))

    return run


_words_of("query_tokens", "tokens", "array_to_string(tokens, '|')")
_words_of("query_expand", "expanded", "array_to_string(expanded, '|')")
_words_of("query_variants", "variants", "array_to_string(variants, '|')")
_words_of("location_intent", "intent", "intent")

_ALIASES = sorted({*languages.NAMES, *languages.BY_EXTENSION, *languages.ALIASES, "RS", ".py", "..TS", "C++", "unknown", ""})


@register("type_alias", "SELECT alias, " + s.resolve("alias") + " AS language FROM (VALUES " + ", ".join(f"({s.q(a)})" for a in _ALIASES) + ") t(alias)")
def type_alias(spark, d):
    return spark.createDataFrame([(a,) for a in _ALIASES], "alias string").select("alias", languages.resolve("alias").alias("language"))


# ---- scanning ----


@register("scan_files", sel(FILES, f"SELECT workspace_id, file_path, strlen(text) AS length FROM files WHERE strlen(text) <= {source_files.MOST_BYTES} AND NOT {s.ignored('file_path', paths.ignore_rules(IGNORE))}"))
def scan_files(spark, d):
    got = adapters.corpus(spark, d).withColumn("length", F.octet_length("text").cast("bigint"))
    return got.where((F.col("length") <= source_files.MOST_BYTES) & ~paths.ignored("file_path", paths.ignore_rules(IGNORE))).select("workspace_id", "file_path", "length")


@register("ignore_flag", sel(FILES, f"SELECT file_path, {s.ignored('file_path', paths.ignore_rules(IGNORE))} AS is_ignored FROM files"))
def ignore_flag(spark, d):
    return adapters.corpus(spark, d).select("file_path", paths.ignored("file_path", paths.ignore_rules(IGNORE)).alias("is_ignored"))


_PRINTABLE = "['09', '0A', '0C', '0D']"


@register("text_sniff", f"""
WITH b AS (
  SELECT 'd' || doc_id AS id, encode(text) AS content FROM documents
  UNION ALL SELECT 'c' || c_custkey, unhex(md5(c_name)) FROM customer
  UNION ALL SELECT 'n' || n_nationkey, encode(n_name || chr(0)) FROM nation
  UNION ALL SELECT 'r' || r_regionkey, encode('') FROM region),
h AS (SELECT id, content[1:{source_files.SNIFFED}] AS head, regexp_extract_all(hex(content[1:{source_files.SNIFFED}]), '..') AS bytes FROM b)
SELECT id, CASE WHEN len(bytes) = 0 THEN FALSE WHEN list_contains(bytes, '00') THEN FALSE WHEN TRY(decode(head)) IS NOT NULL THEN TRUE
  ELSE len(list_filter(bytes, lambda x: list_contains({_PRINTABLE}, x) OR (x >= '20' AND x <= '7E'))) >= {source_files.PRINTABLE_SHARE} * len(bytes) END AS is_text FROM h""")
def text_sniff(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.encode("text", "UTF-8").alias("content"))
    for name, key, mark, content in (
        ("customer", "c_custkey", "c", F.unhex(F.md5("c_name"))), ("nation", "n_nationkey", "n", F.encode(F.concat("n_name", F.lit("\x00")), "UTF-8")), ("region", "r_regionkey", "r", F.encode(F.lit(""), "UTF-8")),
    ):
        rows = rows.unionByName(table(spark, d, name).select(F.concat(F.lit(mark), key).alias("id"), content.alias("content")))
    return rows.select("id", source_files.is_text("content").alias("is_text"))


@register("language_detect", sel(FILES, f"""SELECT file_path, {s.language('file_path')} AS language FROM (
  SELECT file_path FROM files UNION ALL SELECT 'a/' || n_name || '.' || ext FROM nation, (SELECT unnest({s.words(sorted(languages.BY_EXTENSION))}) AS ext)
  UNION ALL SELECT r_name || '/' || f FROM region, (SELECT unnest(['Makefile', 'Makefile.in', 'Dockerfile.dev', 'Gemfile', 'README', 'x.RS', '.env', 'a.b.Tsx']) AS f))"""))
def language_detect(spark, d):
    of = lambda values: F.explode(F.array(*[F.lit(v) for v in values]))
    more = table(spark, d, "nation").select("n_name", of(sorted(languages.BY_EXTENSION)).alias("x")).select(F.concat(F.lit("a/"), "n_name", F.lit("."), "x").alias("file_path"))
    named = table(spark, d, "region").select("r_name", of(["Makefile", "Makefile.in", "Dockerfile.dev", "Gemfile", "README", "x.RS", ".env", "a.b.Tsx"]).alias("x")).select(F.concat("r_name", F.lit("/"), "x").alias("file_path"))
    return adapters.corpus(spark, d).select("file_path").unionByName(more).unionByName(named).select("file_path", languages.language("file_path").alias("language"))


@register("preview_line", sel(CHUNKS, f"SELECT chunk_id, {s.preview_line('text')} AS preview FROM chunks"))
def preview_line(spark, d):
    return _chunks(spark, d).select("chunk_id", ft.preview_line("text").alias("preview"))


# ---- chunking ----


@register("chunk_fixed_window", sel(CHUNKS, "SELECT file_path, start_line, end_line, md5(array_to_string(lines[start_line:end_line], chr(10))) AS body_md5 FROM wi"))
def chunk_fixed_window(spark, d):
    cut_ = chunking.chunk_windows(adapters.corpus(spark, d))
    body = F.expr("substring(text, length(file_path) + 6)")
    return cut_.select("file_path", "start_line", "end_line", F.md5(body).alias("body_md5"))


@register("chunk_heuristic", sel(CHUNKS, "SELECT file_path, language, start_line, end_line, kind, md5(text) AS text_md5 FROM chunks"))
def chunk_heuristic(spark, d):
    return _chunks(spark, d).select("file_path", "language", "start_line", "end_line", "kind", F.md5("text").alias("text_md5"))


@register("signature_scan", sel(CHUNKS, "SELECT file_path, no AS line, kind FROM sg"))
def signature_scan(spark, d):
    return chunking.signatures(chunking.with_lines(adapters.corpus(spark, d))).select("file_path", F.explode("sigs").alias("g")).select("file_path", "g.line", "g.kind")


@register("chunk_gap_fill", sel(CHUNKS, """, cv AS (SELECT DISTINCT workspace_id, file_path, no + k AS no FROM sg, (SELECT unnest([0, 1, 2]) AS k)),
op AS (SELECT workspace_id, file_path, no, no - row_number() OVER (PARTITION BY workspace_id, file_path ORDER BY no) AS island
       FROM ln ANTI JOIN cv USING (workspace_id, file_path, no) WHERE trim(translate(line, chr(9), ' ')) <> '')
SELECT file_path, min(no) AS start_line, max(no) AS end_line FROM op GROUP BY workspace_id, file_path, island"""))
def chunk_gap_fill(spark, d):
    df = chunking.signatures(chunking.with_lines(adapters.corpus(spark, d)))
    spans = F.transform("sigs", lambda g: F.struct(g["line"].alias("start"), (g["line"] + 2).alias("end"), g["kind"].alias("kind")))
    return df.select("file_path", F.explode(chunking.gaps(spans, F.col("lines"))).alias("g")).select("file_path", F.col("g.start").alias("start_line"), F.col("g.end").alias("end_line"))


@register("content_hash", sel(CHUNKS, "SELECT file_path, start_line, chunk_id, vector_key FROM chunks"))
def content_hash(spark, d):
    return _chunks(spark, d).select("file_path", "start_line", "chunk_id", "vector_key")


@register("signature_extract", sel(CHUNKS, "SELECT chunk_id, kind, signature FROM chunks"))
def signature_extract(spark, d):
    return _chunks(spark, d).select("chunk_id", "kind", "signature")


@register("syntax_chunks")
def syntax_chunks(spark, d):
    return chunking.syntax_chunks(adapters.code_files(spark, d)).select("file_path", "start_line", "end_line", "kind", "chunk_id")


# ---- index and vectors ----


@register("postings_build", sel(CHUNKS, """SELECT field, term, count(*) AS n_chunks, CAST(sum(tf) AS BIGINT) AS n_tokens, CAST(sum(""" + s.md5_number("chunk_id || ':' || places") + """) AS BIGINT) AS mark
FROM (SELECT field, term, chunk_id, count(*) AS tf, string_agg(position - 1, ',' ORDER BY position) AS places FROM oc GROUP BY ALL) GROUP BY ALL"""))
def postings_build(spark, d):
    posted = index.postings(index.tokenized(_chunks(spark, d)))
    one = F.concat("chunk_id", F.lit(":"), F.array_join(F.col("positions").cast("array<string>"), ","))
    return posted.groupBy("field", "term").agg(F.count("*").alias("n_chunks"), F.sum("tf").alias("n_tokens"), F.sum(ft.md5_number(one)).alias("mark"))


@register("hash_embed", sel(CHUNKS + "," + _vectors("hv", "chunk_id", "text", "chunks"), "SELECT chunk_id, count(*) AS n_buckets, round(sum(weight * (bucket + 1)), 6) AS mark, round(max(weight), 6) AS most FROM hv GROUP BY chunk_id"))
def hash_embed(spark, d):
    v = index.hash_vectors(_chunks(spark, d))
    return v.groupBy("chunk_id").agg(F.count("*").alias("n_buckets"), F.round(F.sum(F.col("weight") * (F.col("bucket") + 1)), 6).alias("mark"), F.round(F.max("weight"), 6).alias("most"))


def _vecs(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("vector_key"), "embedding", F.col("label").cast("bigint").alias("label"))


@register("vector_store_upsert", """SELECT vec_id AS vector_key, CASE WHEN label >= 3 THEN 'new' ELSE 'old' END AS origin, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings""")
def vector_store_upsert(spark, d):
    v = _vecs(spark, d)
    old, new = v.where("label <= 6").withColumn("origin", F.lit("old")), v.where("label >= 3").withColumn("origin", F.lit("new"))
    return index.store_upsert(old, new.unionByName(new)).select("vector_key", "origin", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))


@register("vector_key_lookup", sel(CHUNKS, "SELECT vector_key, file_path, start_line FROM chunks WHERE kind = 'Function'"))
def vector_key_lookup(spark, d):
    c = cut(_chunks(spark, d).select("vector_key", "file_path", "start_line", "kind"))
    return c.join(c.where("kind = 'Function'").select("vector_key").distinct(), "vector_key", "left_semi").select("vector_key", "file_path", "start_line")


_COS = "list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))))"
_FIRSTS = "f AS (SELECT min(vec_id) AS vec_id FROM embeddings GROUP BY label), a AS (SELECT e.* FROM embeddings e SEMI JOIN f USING (vec_id))"


def _label_queries(v: DataFrame) -> DataFrame:
    """The vector of smallest id of each label: as many queries as there are labels."""
    return v.groupBy("label").agg(F.min_by("embedding", "vector_key").alias("q"), F.min("vector_key").alias("query_id")).select("query_id", "q", F.col("label").alias("query_label"))


_KNN = lambda test: f"""WITH {_FIRSTS}, p AS (SELECT a.vec_id AS query_id, b.vec_id AS vector_key, {_COS} AS score FROM a JOIN embeddings b ON a.vec_id <> b.vec_id{test})
SELECT query_id, vector_key, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vector_key) AS rank FROM p) WHERE rank <= {TOP}"""  # noqa: E731


@register("knn_cosine", _KNN(""))
def knn_cosine(spark, d):
    v = _vecs(spark, d)
    return cand.knn(_label_queries(v).drop("query_label"), v.drop("label"), TOP).select("query_id", "vector_key", "rank", F.round("score", 6).alias("score"))


@register("knn_filtered", _KNN(" AND a.label = b.label"))
def knn_filtered(spark, d):
    v = _vecs(spark, d)
    own = v.join(_label_queries(v), F.col("label") == F.col("query_label")).where("vector_key <> query_id")
    score = cand.dot("q", "embedding") / (cand.norm("q") * cand.norm("embedding"))
    w = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "vector_key")
    return own.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP).select("query_id", "vector_key", "rank", F.round("score", 6).alias("score"))


@register("vector_score", f"WITH {_FIRSTS} SELECT b.vec_id AS vector_key, round({_COS}, 6) AS score FROM a JOIN embeddings b ON a.label = b.label")
def vector_score(spark, d):
    v = _vecs(spark, d)
    return v.join(_label_queries(v), F.col("label") == F.col("query_label")).select("vector_key", F.round(cand.dot("q", "embedding") / (cand.norm("q") * cand.norm("embedding")), 6).alias("score"))


_HALF = lambda lo, hi: _COS.replace("a.embedding", f"a.embedding[{lo}:{hi}]").replace("b.embedding", f"b.embedding[{lo}:{hi}]")


@register("semantic_merge", f"""WITH {_FIRSTS}, t AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vector_key, {_HALF(1, 32)} AS score FROM a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label
  UNION ALL SELECT a.vec_id, b.vec_id, {cand.NEURAL_FACTOR} * {_HALF(33, 64)} FROM a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label)
SELECT query_id, vector_key, round(max(score), 6) AS score FROM t GROUP BY ALL""")
def semantic_merge(spark, d):
    v = _vecs(spark, d)
    own = v.join(_label_queries(v), F.col("label") == F.col("query_label")).where("vector_key <> query_id")

    def tier(first: int) -> DataFrame:
        a, b = F.slice("q", first, 32), F.slice("embedding", first, 32)
        return own.select("query_id", "vector_key", (cand.dot(a, b) / (cand.norm(a) * cand.norm(b))).alias("score"))

    return cand.merge_semantic(tier(1), tier(33), "vector_key").select("query_id", "vector_key", F.round("score", 6).alias("score"))


@register("enhance_pending", sel(CHUNKS, "SELECT chunk_id, vector_key, kind FROM chunks WHERE vector_key NOT IN (SELECT vector_key FROM chunks WHERE kind = 'Function')"))
def enhance_pending(spark, d):
    c = cut(_chunks(spark, d).select("chunk_id", "vector_key", "kind"))
    return index.pending(c, c.where("kind = 'Function'").select("vector_key")).select("chunk_id", "vector_key", "kind")


# ---- candidates ----


@register("bm25_topk", sel(f"""fields AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, 'text' AS field, {s.tokens("coalesce(text, '')")} AS tokens FROM documents),
oc AS (SELECT chunk_id, field, len(tokens) AS length, unnest(tokens) AS term FROM fields),
vt AS (SELECT item_id AS query_id, '' AS variant, unnest(list_distinct({s.tokens("coalesce(text, '')")})) AS term FROM benchmark),{_bm25({'text': 1.0})}""",
f"SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM bv) WHERE rank <= {TOP}"))
def bm25_topk(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").cast("string").alias("chunk_id"), F.lit(1.0).alias("boost"), F.lit("text").alias("field"), ft.tokens(F.coalesce("text", F.lit(""))).alias("tokens"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit("").alias("variant"), F.explode(F.array_distinct(ft.tokens(F.coalesce("text", F.lit(""))))).alias("term"))
    return cand.first(cand.bm25(cut(docs), asked, {"text": 1.0}), TOP).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def _lexical(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    chunks, queries = cut(_chunks(spark, d)), _batch(spark)
    return cand.lexical(cut(index.tokenized(chunks)), queries), chunks, queries


@register("bm25f_topk", sel(LEXICAL, f"SELECT query_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM lx WHERE rank <= {TOP}"))
def bm25f_topk(spark, d):
    return _lexical(spark, d)[0].where(F.col("rank") <= TOP).select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


@register("phrase_match", sel(CHUNKS, f"SELECT a.chunk_id, a.position - 1 AS position FROM oc a JOIN oc b ON a.chunk_id = b.chunk_id AND a.field = b.field AND b.position = a.position + 1 WHERE a.field = 'text' AND a.term = {s.q(PHRASE[0])} AND b.term = {s.q(PHRASE[1])}"))
def phrase_match(spark, d):
    return cand.phrase(index.tokenized(_chunks(spark, d)), PHRASE).select("chunk_id", F.col("position").cast("bigint").alias("position"))


@register("path_match", sel(LISTS, "SELECT query_id, chunk_id FROM pm"))
def path_match(spark, d):
    return cand.by_path(index.tokenized(_chunks(spark, d)), _batch(spark))


@register("literal_chunks", sel(LISTS, "SELECT query_id, chunk_id FROM li"))
def literal_chunks(spark, d):
    return cand.literal_chunks(_chunks(spark, d), _batch(spark))


@register("literal_search", sel(CHUNKS, f"""SELECT l.workspace_id, l.file_path, no AS line_no, array_to_string(lines[greatest(1, no - 2):least(len(lines), no + 2)], chr(10)) AS preview, CAST(1.0 AS DOUBLE) AS score
FROM ln l JOIN fl ON l.workspace_id = fl.workspace_id AND l.file_path = fl.file_path WHERE contains({s.lower('line')}, {s.q(LITERAL.lower())})"""))
def literal_search(spark, d):
    return search.literal_search(adapters.corpus(spark, d), LITERAL)


@register("regex_search", sel(CHUNKS, f"SELECT workspace_id, file_path, no AS line_no, trim(line) AS preview FROM ln WHERE regexp_matches(line, {s.q('(?i)' + PATTERN)})"))
def regex_search(spark, d):
    return cand.regex_lines(adapters.corpus(spark, d), PATTERN).select("workspace_id", "file_path", "line_no", F.trim("line").alias("preview"))


@register("regex_prefilter", sel(FILES, f"SELECT file_path FROM files WHERE contains({s.lower('text')}, 'return total') AND contains({s.lower('text')}, 'customer')"))
def regex_prefilter(spark, d):
    got = adapters.corpus(spark, d)
    for fragment in sorted({*cand.required_fragments(r"return total"), *cand.required_fragments("customer")}):
        got = got.where(F.contains(ft.ascii_lower("text"), F.lit(fragment)))
    return got.select("file_path")


# ---- filters and features ----


@register("glob_filter", sel(FILES, f"SELECT file_path FROM files WHERE {s.glob_match('file_path', INCLUDE, EXCLUDE)}"))
def glob_filter(spark, d):
    return adapters.corpus(spark, d).where(paths.glob_match("file_path", INCLUDE, EXCLUDE)).select("file_path")


@register("type_filter", sel(CHUNKS, "SELECT chunk_id, language FROM chunks WHERE language = 'rust'"))
def type_filter(spark, d):
    return search.restricted(_chunks(spark, d), search.Options(type_filter="RS")).select("chunk_id", "language")


@register("scope_filter", sel(FILES, "SELECT file_path FROM files WHERE file_path = 'src/nation_1' OR starts_with(file_path, 'src/nation_1/')"))
def scope_filter(spark, d):
    return search.restricted(adapters.corpus(spark, d), search.Options(scope="src/nation_1/", with_ignored=True)).select("file_path")


@register("definition_filter", sel(CHUNKS, f"SELECT chunk_id, kind FROM chunks WHERE {s.is_definition('kind')}"))
def definition_filter(spark, d):
    return _chunks(spark, d).where(paths.is_definition("kind")).select("chunk_id", "kind")


@register("test_path", sel(FILES, f"SELECT file_path, {s.is_test('file_path')} AS is_test FROM files"))
def test_path(spark, d):
    return adapters.corpus(spark, d).select("file_path", paths.is_test("file_path").alias("is_test"))


@register("file_authority", sel(FILES, f"SELECT file_path, {s.authority('file_path')} AS authority FROM files"))
def file_authority(spark, d):
    return adapters.corpus(spark, d).select("file_path", paths.authority("file_path").alias("authority"))


@register("kind_boost", sel(CHUNKS, f"SELECT chunk_id, {s.kind_factor('kind')} AS factor FROM chunks"))
def kind_boost(spark, d):
    return _chunks(spark, d).select("chunk_id", paths.kind_factor("kind").alias("factor"))


_PAIRS = ", pr AS (SELECT l.query_id, l.chunk_id, c.text, c.file_path, c.kind, expanded, low, compact, intent FROM lx l JOIN chunks c ON l.chunk_id = c.chunk_id JOIN qq ON l.query_id = qq.query_id)\n"


def _pairs(spark, d) -> DataFrame:
    lex, chunks, queries = _lexical(spark, d)
    return lex.select("query_id", "chunk_id").join(chunks, "chunk_id").join(queries.select("query_id", "expanded", "low", "compact", "intent"), "query_id")


def _feature(name: str, sql: dict[str, str], columns: dict) -> None:
    @register(name, sel(LEXICAL, _PAIRS + "SELECT query_id, chunk_id, " + ", ".join(f"round({e}, 6) AS {k}" for k, e in sql.items()) + " FROM pr"))
    def run(spark, d):
        return _pairs(spark, d).select("query_id", "chunk_id", *[F.round(c(), 6).alias(k) for k, c in columns.items()])


_col = F.col
_feature("term_coverage", {"coverage": COVER}, {"coverage": lambda: fusion.term_coverage(_col("text"), _col("expanded"))})
_feature("path_features", {"segment": SEGMENT, "exact": EXACT, "stem": STEM}, {"segment": lambda: fusion.path_segments(_col("file_path"), _col("expanded")), "exact": lambda: fusion.path_exact(_col("file_path"), _col("low")), "stem": lambda: fusion.file_stem(_col("file_path"), _col("expanded"))})
_feature("definition_boost", {"boost": DEFINED}, {"boost": lambda: fusion.definition_name(_col("text"), _col("expanded"))})
_feature("literal_boost", {"boost": BOOST}, {"boost": lambda: fusion.literal(_col("text"), _col("file_path"), _col("low"), _col("compact"))})
_feature("intent_boost", {"boost": f"CASE WHEN intent THEN {PLACE} ELSE 0.0 END"}, {"boost": lambda: F.when(_col("intent"), fusion.location(_col("kind"), _col("file_path"))).otherwise(0.0)})


# ---- fusion and presentation ----


@register("rrf_fusion", sel(LISTS, "SELECT query_id, chunk_id, round(base, 6) AS base, array_to_string(sources, '+') AS sources FROM mg"))
def rrf_fusion(spark, d):
    chunks, queries = cut(_chunks(spark, d)), _batch(spark)
    got = search.candidate_lists(chunks, queries, search.Options())
    return fusion.merge_lists(got.lexical, got.semantic, got.literal).select("query_id", "chunk_id", F.round("base", 6).alias("base"), F.array_join("sources", "+").alias("sources"))


@register("adaptive_cutoff", sel(LEXICAL, f""", fx AS (SELECT query_id, avg(score) AS mean, stddev_pop(score) AS dev, max(score) AS best, count(*) AS n FROM lx GROUP BY query_id)
SELECT lx.query_id, chunk_id, round(score, 6) AS score FROM lx JOIN fx ON lx.query_id = fx.query_id
WHERE n <= 1 OR round(score, 9) >= round(greatest(mean - dev, best * {fusion.CUTOFF_SHARE}, {fusion.CUTOFF_LEAST}), 9)"""))
def adaptive_cutoff(spark, d):
    lex = _lexical(spark, d)[0].select("query_id", "chunk_id", "score").withColumn("sources", F.array(F.lit("lexical")))
    return fusion.cutoff(lex).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def _ranked(spark, d, o: search.Options | None = None) -> DataFrame:
    return search.ranked(cut(_chunks(spark, d)), _batch(spark), o or search.Options())


@register("ranked_chunks", sel(RANKED, "SELECT query_id, chunk_id, file_path, start_line, round(score, 6) AS score, array_to_string(sources, '+') AS sources FROM rf"))
def ranked_chunks(spark, d):
    return _ranked(spark, d).select("query_id", "chunk_id", "file_path", "start_line", F.round("score", 6).alias("score"), F.array_join("sources", "+").alias("sources"))


def _hits(spark, d) -> DataFrame:
    return search.search_hits(adapters.corpus(spark, d).drop("is_ignored"), _batch(spark))


@register("focus_line", sel(HITS, "SELECT query_id, chunk_id, focus_line FROM hits"))
def focus_line(spark, d):
    got, files, q = _ranked(spark, d), adapters.corpus(spark, d).select("workspace_id", "file_path", ft.lines("text").alias("lines")), _batch(spark)
    j = got.join(files, ["workspace_id", "file_path"]).join(q.select("query_id", F.trim("query").alias("q"), "low", "expanded", ft.singular(F.col("compact")).alias("sq")), "query_id")
    return j.select("query_id", "chunk_id", present.focus_line(F.col("lines"), F.col("start_line"), F.col("end_line"), F.col("q"), F.col("low"), F.col("expanded"), F.col("sq")).alias("focus_line"))


@register("snippet", sel(HITS, "SELECT query_id, chunk_id, start_line, end_line, md5(preview) AS preview_md5 FROM hits"))
def snippet(spark, d):
    return _hits(spark, d).select("query_id", "chunk_id", "start_line", "end_line", F.md5("preview").alias("preview_md5"))


@register("explain_hits", sel(HITS, "SELECT query_id, chunk_id, reason, round(score, 6) AS score FROM hits"))
def explain_hits(spark, d):
    return _hits(spark, d).select("query_id", "chunk_id", "reason", F.round("score", 6).alias("score"))


@register("group_by_file", sel(HITS, "SELECT query_id, workspace_id, file_path, round(total_score, 6) AS total_score, hit_count FROM gf"))
def group_by_file(spark, d):
    return present.group_by_file(_hits(spark, d)).select("query_id", "workspace_id", "file_path", F.round("total_score", 6).alias("total_score"), "hit_count")


@register("file_name_only", sel(HITS, "SELECT DISTINCT query_id, workspace_id, file_path FROM hits"))
def file_name_only(spark, d):
    return present.file_names(_hits(spark, d))


@register("first_line_only", sel(HITS, "SELECT query_id, chunk_id, string_split(preview, chr(10))[1] AS preview FROM hits"))
def first_line_only(spark, d):
    return present.first_line_only(_hits(spark, d)).select("query_id", "chunk_id", "preview")


@register("multi_workspace", sel(HITS, "SELECT query_id, workspace_id, count(*) AS n, round(max(score), 6) AS best FROM hits GROUP BY ALL"))
def multi_workspace(spark, d):
    return _hits(spark, d).groupBy("query_id", "workspace_id").agg(F.count("*").alias("n"), F.round(F.max("score"), 6).alias("best"))


@register("hybrid_search", sel(HITS, "SELECT query_id, workspace_id, file_path, CAST(nth AS INTEGER) AS place, round(total_score, 6) AS total_score, hit_count FROM gr"))
def hybrid_search(spark, d):
    got = present.group_by_file(_hits(spark, d), search.Options().limit)
    w = Window.partitionBy("query_id").orderBy(F.round("total_score", 9).desc(), "file_path")
    return got.withColumn("place", F.row_number().over(w)).select("query_id", "workspace_id", "file_path", "place", F.round("total_score", 6).alias("total_score"), "hit_count")


# ---- maintenance ----

_HASH_FILE = "md5(file_path || '|' || text) || CASE WHEN is_ignored THEN '-1' ELSE '-0' END"
# The older snapshot has all documents; the newer one has lost those of low
# quality, holds the toxic ones in lower case, and has gained the pages.
SNAPSHOTS = f"""{FILES},
lb AS (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
pg AS (
  SELECT 'pages' AS workspace_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[^A-Za-z0-9./_-]', '_', 'g') || '_' || page_id || '.html' AS file_path, coalesce(html, '') AS text, FALSE AS is_ignored FROM pages),
nd AS (
  SELECT source AS workspace_id, {_TURN(adapters.FOLDERS)} || '/' || source || '/' || lang || '_' || doc_id || {_TURN(adapters.EXTENSIONS)} AS file_path,
         CASE WHEN toxic = 1 THEN {s.lower('text')} ELSE text END AS text
  FROM documents LEFT JOIN lb USING (doc_id) WHERE coalesce(quality, 1) <> 0),
newer AS (SELECT workspace_id, file_path, text, starts_with(file_path, 'vendor/') AS is_ignored FROM nd UNION ALL SELECT * FROM pg),
older AS (SELECT workspace_id, file_path, text, starts_with(file_path, 'vendor/') AS is_ignored FROM docs),
s1 AS (SELECT *, {_HASH_FILE} AS file_hash FROM older),
s2 AS (SELECT *, {_HASH_FILE} AS file_hash FROM newer),
df AS (
  SELECT coalesce(a.workspace_id, b.workspace_id) AS workspace_id, coalesce(a.file_path, b.file_path) AS file_path, coalesce(b.is_ignored, FALSE) AS is_ignored,
         CASE WHEN a.file_hash IS NULL THEN 'added' WHEN b.file_hash IS NULL THEN 'deleted' WHEN a.file_hash <> b.file_hash THEN 'modified' END AS change
  FROM s1 a FULL JOIN s2 b ON a.workspace_id = b.workspace_id AND a.file_path = b.file_path)"""


def _older(spark, d) -> DataFrame:
    return adapters.document_files(spark, d)


def _newer(spark, d) -> DataFrame:
    marks = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marked = _older(spark, d).withColumn("doc_id", F.regexp_extract("file_path", r"_([0-9]+)\.[a-z]+$", 1).cast("bigint")).join(marks, "doc_id", "left").where(F.coalesce("quality", F.lit(1)) != 0)
    changed = marked.select("workspace_id", "file_path", F.when(F.col("toxic") == 1, ft.ascii_lower("text")).otherwise(F.col("text")).alias("text"), "is_ignored")
    return changed.unionByName(adapters.page_files(spark, d))


@register("merkle_snapshot", sel(SNAPSHOTS, "SELECT workspace_id, file_path, is_ignored, file_hash FROM s1"))
def merkle_snapshot(spark, d):
    return maintain.snapshot(_older(spark, d))


@register("merkle_root", sel(SNAPSHOTS, """, lf AS (SELECT workspace_id, substr(md5(file_path), 1, 4) AS part, md5(string_agg(file_path || file_hash, '' ORDER BY file_path || file_hash)) AS h, count(*) AS n FROM s1 GROUP BY ALL),
lm AS (SELECT workspace_id, substr(part, 1, 2) AS part, md5(string_agg(part || h, '' ORDER BY part || h)) AS h, sum(n) AS n FROM lf GROUP BY workspace_id, substr(part, 1, 2))
SELECT workspace_id, md5(string_agg(part || h, '' ORDER BY part || h)) AS root_hash, CAST(sum(n) AS BIGINT) AS n_files FROM lm GROUP BY workspace_id"""))
def merkle_root(spark, d):
    return maintain.root_hash(maintain.snapshot(_older(spark, d)))


@register("merkle_diff", sel(SNAPSHOTS, "SELECT workspace_id, file_path, change, is_ignored FROM df WHERE change IS NOT NULL"))
def merkle_diff(spark, d):
    return maintain.diff(maintain.snapshot(_older(spark, d)), maintain.snapshot(_newer(spark, d)))


@register("apply_delta", sel(SNAPSHOTS, "SELECT workspace_id, file_path, md5(text) AS text_md5 FROM newer"))
def apply_delta(spark, d):
    old, new = _older(spark, d), _newer(spark, d)
    changed = cut(maintain.diff(maintain.snapshot(old), maintain.snapshot(new)))
    fresh = new.join(changed.where("change <> 'deleted'").select(*maintain.KEY), list(maintain.KEY), "left_semi")
    return maintain.apply_delta(old, changed, fresh).select("workspace_id", "file_path", F.md5("text").alias("text_md5"))


@register("overlay_merge", sel(SNAPSHOTS, """SELECT workspace_id, file_path, 'overlay' AS layer FROM df WHERE change IN ('added', 'modified')
UNION ALL SELECT workspace_id, file_path, 'base' FROM df WHERE change IS NULL"""))
def overlay_merge(spark, d):
    old, new = maintain.snapshot(_older(spark, d)), maintain.snapshot(_newer(spark, d))
    changed = cut(maintain.diff(old, new))
    over = changed.where("change <> 'deleted'").select(*maintain.KEY, F.lit("overlay").alias("layer"))
    return maintain.overlay(old.select(*maintain.KEY, F.lit("base").alias("layer")), over, changed.where("change = 'deleted'"))


@register("nested_roots", sel(FILES, """, ro AS (SELECT DISTINCT regexp_replace(file_path, '/[^/]*$', '') AS root FROM files UNION SELECT DISTINCT string_split(file_path, '/')[1] FROM files)
SELECT a.root AS parent, b.root AS child FROM ro a JOIN ro b ON starts_with(b.root, a.root || '/')"""))
def nested_roots(spark, d):
    files = adapters.corpus(spark, d)
    roots = files.select(F.regexp_replace("file_path", "/[^/]*$", "").alias("root")).union(files.select(F.split("file_path", "/").getItem(0))).distinct()
    return maintain.nested_roots(roots)


@register("index_stats", sel(CHUNKS, "SELECT workspace_id, count(*) AS n_chunks, count(DISTINCT file_path) AS n_files FROM chunks GROUP BY workspace_id"))
def index_stats(spark, d):
    return maintain.index_stats(_chunks(spark, d))


@register("index_health", sel(SNAPSHOTS.replace(FILES, CHUNKS), """, hv AS (SELECT workspace_id, file_path, count(*) AS n FROM chunks GROUP BY ALL),
ff AS (SELECT workspace_id, file_path, text FROM newer UNION ALL SELECT workspace_id, file_path, text FROM files WHERE workspace_id = 'code'),
bt AS (SELECT coalesce(f.workspace_id, h.workspace_id) AS workspace_id, f.file_path AS there, h.n, length(f.text) > 0 AS has_text FROM ff f FULL JOIN hv h ON f.workspace_id = h.workspace_id AND f.file_path = h.file_path),
fa AS (SELECT workspace_id, count(there) AS n_files, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_chunks, count(*) FILTER (n IS NULL AND has_text) AS files_without_chunks, count(*) FILTER (there IS NULL) AS orphan_files FROM bt GROUP BY workspace_id)
SELECT *, CASE WHEN orphan_files > 0 OR files_without_chunks > 0 THEN 'Unhealthy' WHEN n_files = 0 THEN 'NotIndexed' WHEN n_chunks = 0 THEN 'HealthyEmpty' ELSE 'Healthy' END AS state FROM fa"""))
def index_health(spark, d):
    now = _newer(spark, d).unionByName(adapters.code_files(spark, d))
    return maintain.health(now, _chunks(spark, d))


@register("workspace_status", sel(CHUNKS, """, fb AS (SELECT workspace_id, count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM files GROUP BY ALL),
cb AS (SELECT workspace_id, count(*) AS n_chunks, count(*) FILTER (kind = 'Text') AS n_vectors FROM chunks GROUP BY ALL)
SELECT workspace_id, n_files, n_bytes, coalesce(n_chunks, 0) AS n_chunks, coalesce(n_vectors, 0) AS n_vectors, coalesce(n_vectors, 0) < coalesce(n_chunks, 0) AS needs_vectors FROM fb LEFT JOIN cb USING (workspace_id)"""))
def workspace_status(spark, d):
    c = cut(_chunks(spark, d).select("workspace_id", "vector_key", "kind"))
    return maintain.status(adapters.corpus(spark, d), c.select("workspace_id", "vector_key"), c.where("kind = 'Text'"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
