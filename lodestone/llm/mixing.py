"""Mixing to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Token totals of the cells (source, language, topic) are raked: over and over,
the cells' weights are scaled so that each marginal in turn meets its targets.
A cell's probability is its weight over its tokens, times a factor, one at
most; the factor is calibrated so that the expected tokens meet the budget
(cells at one are held there, the rest share what is left). A document is
sampled if a hash of its id falls below its cell's probability.

Cells are counted with map-side combining. Up to ``DRIVER_CELLS`` of them, by a
count of them, are raked on the driver and broadcast back; beyond that the same
rounds run as DataFrame operations. Defined results: a null source, language or
topic is a category of its own, ``<null>``; documents without tokens have the
probability of their cell; in a cell without tokens it is one. Repeated rows
are sampled alike; very long texts are counted whole; an empty table gives an empty
one. Categories without a target have none of the weight. If the categories that
have some hold fewer tokens than the budget, they are kept whole, and a warning
tells the budget missed; another one if the marginals are further from their
targets than ``TOLERANCE`` after the rounds. Extra columns are kept, clashing
result columns replaced.
"""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.storage import cut

ROUNDS = 20
#: Cells that the driver rakes and broadcasts at most.
DRIVER_CELLS = 200_000
#: Exponents that flatten the marginals' own shares into targets.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.9}
#: Share of the tokens that the sample is to have.
BUDGET = 0.6
#: Share of all tokens by which a category may miss its target before a warning says so.
TOLERANCE = 0.01
SEED = "mix"
DIMS = ("source", "lang", "topic")
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str) -> Column:
    """Number of white-space separated words; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def form(text: str) -> Column:
    """A topic by form, where documents have none of their own."""
    t = F.col(text)
    return (
        F.when(t.isNull(), F.lit("<null>")).when(F.contains(t, F.lit("|")), "table").when(F.contains(t, F.lit("!!")), "shout")
        .when(F.contains(t, F.lit("###")), "symbols").when(F.char_length(t) >= 6000, "long").otherwise("prose")
    )


def uniform(doc_id: str, seed: str = SEED) -> Column:
    """A number in [0, 1) by the id: 52 bits of an MD5."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rake(keys: list[np.ndarray], tokens: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Cell weights after ``rounds``; keys: the category number of each cell in each dimension."""
    w, total = tokens.astype(np.float64), float(tokens.sum())
    for _ in range(rounds):
        for key, target in zip(keys, targets, strict=True):
            have = np.bincount(key, w, minlength=len(target))
            w = w * np.where(have > 0, target * total / np.where(have > 0, have, 1), 1.0)[key]
    return w


def calibrated(w: np.ndarray, tokens: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities in proportion to w / tokens, one at most, of which the expected tokens are ``budget`` of all."""
    ratio = np.where(tokens > 0, w / np.where(tokens > 0, tokens, 1), np.inf)
    order = np.argsort(-ratio, kind="stable")
    t, v = tokens[order].astype(np.float64), np.where(tokens > 0, w, 0)[order]
    held = np.concatenate([[0], np.cumsum(t)])
    rest = np.concatenate([[0], np.cumsum(v)])[-1] - np.concatenate([[0], np.cumsum(v)])
    goal = budget * tokens.sum()
    factor = 0.0
    for j in range(len(t)):
        if ratio[order[j]] == 0:  # no weight is left before the goal is met: all that has some is held at one
            return np.where(ratio > 0, 1.0, 0.0)
        factor = (goal - held[j]) / rest[j] if rest[j] > 0 else 0.0
        if ratio[order[j]] * factor <= 1:
            break
    return np.minimum(1.0, np.where(np.isinf(ratio), 1.0, ratio * factor))


def _report(miss: float, expected: float, budget: float) -> None:
    """Warn of targets that can't all be met."""
    if miss > TOLERANCE:
        warnings.warn(f"a marginal is {miss:.3f} of all tokens off its target after the last round", stacklevel=3)
    if expected < budget - 1e-6:
        warnings.warn(f"the categories with a target hold {expected:.3f} of all tokens, below the budget of {budget:.3f}", stacklevel=3)


def tempered(shares: np.ndarray, power: float) -> np.ndarray:
    out = np.where(shares > 0, np.power(np.maximum(shares, 1e-300), power), 0)
    return out / out.sum() if out.sum() > 0 else out


def _driver(cells: DataFrame, temper: dict, targets: dict, budget: float, rounds: int) -> DataFrame:
    got = cells.toPandas().sort_values(list(DIMS), kind="stable").reset_index(drop=True)
    tokens = got["tokens"].to_numpy().astype(np.float64)
    keys, goals = [], []
    for d in DIMS:
        names, key = np.unique(got[d].to_numpy().astype(str), return_inverse=True)
        share = np.bincount(key, tokens, minlength=len(names)) / max(1.0, tokens.sum())
        goal = np.array([targets[d].get(n, 0.0) for n in names]) if d in targets else tempered(share, temper[d])
        keys.append(key)
        goals.append(goal / goal.sum() if goal.sum() > 0 else goal)
    w, total = rake(keys, tokens, goals, rounds), max(1.0, tokens.sum())
    got["probability"] = calibrated(w, tokens, budget)
    if tokens.sum() > 0:
        miss = max(float(np.abs(np.bincount(k, w, minlength=len(g)) / total - g).max()) for k, g in zip(keys, goals, strict=True))
        _report(miss, float((got["probability"] * tokens).sum() / total), budget)
    spark = cells.sparkSession
    return spark.createDataFrame(got[[*DIMS, "probability"]], "source string, lang string, topic string, probability double") if len(got) else spark.createDataFrame([], "source string, lang string, topic string, probability double")


def _frames(cells: DataFrame, temper: dict, targets: dict, budget: float, rounds: int) -> DataFrame:
    """The same over DataFrames, for cells in any number; each round is cut."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    goals = {}
    for d in DIMS:
        if d in targets:
            goal = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"{d} string, g double")
        else:
            goal = cells.groupBy(d).agg(F.sum("tokens").alias("t")).select(d, F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(float(max(1, total))), F.lit(temper[d]))).otherwise(0.0).alias("g"))
        goal = cut(goal)
        goals[d] = (goal, goal.agg(F.sum("g")).first()[0] or 1.0)
    now = cells.withColumn("w", F.col("tokens").cast("double"))
    for _ in range(rounds):
        for d in DIMS:
            goal, norm = goals[d]
            have = now.groupBy(d).agg(F.sum("w").alias("have"))
            factor = have.join(goal, d, "left").select(d, F.when(F.col("have") > 0, F.coalesce("g", F.lit(0.0)) / F.lit(norm) * float(total) / F.col("have")).otherwise(1.0).alias("f"))
            now = now.join(factor, d).withColumn("w", F.col("w") * F.col("f")).drop("f")
        now = cut(now)
    miss = 0.0
    for d in DIMS:
        goal, norm = goals[d]
        off = F.abs(F.col("have") / F.lit(float(max(1, total))) - F.coalesce("g", F.lit(0.0)) / F.lit(norm))
        miss = max(miss, now.groupBy(d).agg(F.sum("w").alias("have")).join(goal, d, "left").agg(F.max(off)).first()[0] or 0.0)
    ratio = F.when(F.col("tokens") > 0, F.col("w") / F.col("tokens"))
    now = cut(now.withColumn("ratio", ratio))
    # the factor grows monotonically with the tokens expected: bisect on it
    low, high = 0.0, float((now.agg(F.max(F.when(F.col("ratio") > 0, F.try_divide(F.lit(1.0), F.col("ratio"))))).first()[0] or 1.0))
    for _ in range(60):
        mid = (low + high) / 2
        expected = now.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("ratio") * F.lit(mid)))).first()[0] or 0.0
        low, high = (mid, high) if expected < budget * total else (low, mid)
    if total:
        _report(miss, float(now.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("ratio") * F.lit(high)))).first()[0] or 0.0) / total, budget)
    return now.select(*DIMS, F.coalesce(F.least(F.lit(1.0), F.col("ratio") * F.lit(high)), F.lit(1.0)).alias("probability"))


def mix(df: DataFrame, source: str = "source", lang: str = "lang", topic: Column | None = None, text: str = "text", doc_id: str = "doc_id", targets: dict[str, dict[str, float]] | None = None, temper: dict[str, float] = TEMPER, budget: float = BUDGET, rounds: int = ROUNDS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """Add topic, tokens, probability and sampled to every row. ``targets``: weights by dimension and category;
    a dimension without them gets its own shares to the power ``temper``."""
    null = F.lit("<null>")
    topic = form(text) if topic is None else topic
    new = ("topic", "tokens", "probability", "sampled")
    others = [c for c in df.columns if c.lower() not in new]
    keys = {"source": F.coalesce(F.col(source).cast("string"), null), "lang": F.coalesce(F.col(lang).cast("string"), null), "topic": F.coalesce(topic, null)}
    cells = cut(df.select(*[k.alias(d) for d, k in keys.items()], words(text).alias("tokens")).groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")))
    small = cells.count() <= driver_cells
    found = (_driver if small else _frames)(cells, temper, targets or {}, budget, rounds)
    found = found.select(*[F.col(d).alias(f"__{d}") for d in DIMS], "probability")
    if small:
        found = F.broadcast(found)  # as many rows as were just counted
    rows = df.select(*[F.col(f"`{c}`") for c in others], *[k.alias(f"__{d}") for d, k in keys.items()], words(text).alias("tokens"))
    joined = rows.join(found, [f"__{d}" for d in DIMS])
    return joined.select(*[F.col(f"`{c}`") for c in others], F.col("__topic").alias("topic"), "tokens", "probability", (uniform(doc_id) < F.col("probability")).alias("sampled"))


def sql(rounds: int = ROUNDS, budget: float = BUDGET) -> str:
    """The operator over ``documents``, with its default parameters, in DuckDB's SQL."""
    steps, before = [], "w0"
    for r in range(rounds):
        for d in DIMS:
            name = f"w{r}_{d}"
            steps.append(f"{name} AS (SELECT * EXCLUDE (w), w * g_{d} * total / sum(w) OVER (PARTITION BY {d}) AS w FROM {before})")
            before = name
    goals = ", ".join(f"pow(sum(tokens) OVER (PARTITION BY {d}) / total, {TEMPER[d]}) AS u_{d}, count(*) OVER (PARTITION BY {d}) AS n_{d}" for d in DIMS)
    norms = ", ".join(f"u_{d} / sum(u_{d} / n_{d}) OVER () AS g_{d}" for d in DIMS)
    return f"""
WITH d AS (
  SELECT doc_id, coalesce(source, '<null>') AS source, coalesce(lang, '<null>') AS lang,
         CASE WHEN text IS NULL THEN '<null>' WHEN contains(text, '|') THEN 'table' WHEN contains(text, '!!') THEN 'shout'
              WHEN contains(text, '###') THEN 'symbols' WHEN length(text) >= 6000 THEN 'long' ELSE 'prose' END AS topic,
         CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS tokens
  FROM documents),
c AS (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
t AS (SELECT *, sum(tokens) OVER () AS total FROM c),
g AS (SELECT *, {goals} FROM t),
w0 AS (SELECT source, lang, topic, tokens, total, tokens AS w, {norms} FROM g),
{", ".join(steps)},
r AS (SELECT *, w / tokens AS ratio FROM {before}),
h AS (
  SELECT *, coalesce(sum(tokens) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(w) OVER (ORDER BY ratio DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
f AS (SELECT *, ({budget} * total - held) / rest AS factor FROM h),
k AS (SELECT arg_max(factor, ratio) AS factor FROM f WHERE ratio * factor <= 1),
p AS (SELECT source, lang, topic, least(1.0, ratio * k.factor) AS probability FROM f CROSS JOIN k)
SELECT d.doc_id, d.topic, d.tokens, round(p.probability, 6) AS probability,
       CAST(('0x' || substr(md5('{SEED}|' || d.doc_id), 1, 13)) AS BIGINT) / 4503599627370496.0 < p.probability AS sampled
FROM d JOIN p USING (source, lang, topic)
"""
