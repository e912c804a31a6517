"""Mixing sources to target weights by iterative proportional fitting (operator 4).

The corpus is a table of cells (one for each source, language and topic) of tokens.  Raking scales
the cells to the target share of each source, then of each language, then of each topic, and again, in
``sweeps`` rounds (a parameter, as SQL engines have no loop until a fit); ``off_target`` tells how far the
marginals still are from their targets, and more than ``CLOSE_ENOUGH`` gives a warning.  A document's expected number of copies is its cell's raked by its
actual tokens, times the share of tokens to keep.  Documents are drawn without replacement by that
probability, at most 1; what a capped probability lacks is the document's ``weight`` (1 elsewhere),
so the weighted sample has the target mixture.  The draw is a hash of seed and id: the same whatever
the partitions, and executors that are lost draw again alike.

Cells are counted with partial sums.  Up to ``few_cells`` cells the raking is done on the driver
and the result is broadcast (a checked, bounded size); beyond, sweeps run as aggregates over written
tables, whose sums meet the cells by value and share, and the cells are joined to documents in the same
way, with equal results.

With ``capped`` no probability exceeds 1 in the first place, so the drawn tokens have the target mixture
without weights: cells are scaled in the same way but never beyond their tokens, and what a cell lacks
goes to the other cells.  A value that has fewer tokens than its target is taken whole, and the other
values of its dimension share what it lacks (``reachable``).

Targets: shares by value, or an exponent: a value's share is then its own share to that power (0:
equal shares, 1: as it is).  Values without a target get none.  Null values are the value ''.
Documents without tokens (null, empty, blank) have no weight and are never drawn.  The topic is a rule on
the shape of a text, which SQL engines share; ``topic`` may be replaced by any labelling.

Rows with a null id share one draw, and so do rows with one id: they are drawn together where their
probabilities allow.  Repeated rows are separate documents, an empty table gives an empty result, very long
texts are counted whole.  Result columns start with _v_; input columns of such names are replaced.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._frames import spread, table, with_facts, written

DIMS = ("source", "lang", "topic")
#: Production targets: exponents of the present shares.
TARGETS: dict[str, float] = {"source": 0.5, "lang": 0.7, "topic": 0.8}
KEEP, SWEEPS, SEED = 0.7, 10, 4
#: Sweeps with caps end when none of the cells moves by this share of all tokens, or after so many.
CLOSE, CAPPED_SWEEPS = 1e-8, 300
#: Relative error of a marginal after the sweeps that is worth a warning.
CLOSE_ENOUGH = 0.01

WORD = r"[^\x20\x09-\x0D]+"


def topic(text: Column) -> Column:
    """A coarse topic by the shape of a text."""
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.contains(text, F.lit("!!")), "shouting")
        .when(F.contains(text, F.lit("@")) | F.contains(text, F.lit("http")), "contact")
        .when(F.length(text) > 4000, "long")
        .otherwise("prose")
    )


def described(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with _v_source, _v_lang, _v_topic and _v_tokens (words)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns(
        {
            "_v_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "_v_lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
            "_v_topic": topic(text),
            "_v_tokens": F.regexp_count(text, F.lit(WORD)).cast("long"),
        }
    )


def _shares(sums: Mapping[str, float], target: float | Mapping[str, float]) -> dict[str, float]:
    raw = {k: (v**target if v > 0 else 0.0) if isinstance(target, int | float) else float(target.get(k, 0.0)) for k, v in sums.items()}
    total = sum(raw.values())
    return {k: v / total if total else 0.0 for k, v in raw.items()}


def rake(keys: list[tuple[str, ...]], tokens: np.ndarray, targets: list[float | Mapping[str, float]], sweeps: int) -> np.ndarray:
    """Raked tokens of the cells ``keys``, whose sum stays that of ``tokens``."""
    total, fitted = tokens.sum(), tokens.astype(float)
    codes, wanted = [], []
    for d, target in enumerate(targets):
        names = sorted({k[d] for k in keys})
        at = {n: i for i, n in enumerate(names)}
        code = np.array([at[k[d]] for k in keys], np.int64)
        sums = np.bincount(code, tokens, len(names))
        share = _shares({n: sums[i] / total if total else 0.0 for n, i in at.items()}, target)
        codes.append(code)
        wanted.append(np.array([share[n] for n in names]) * total)
    for _ in range(sweeps):
        for code, want in zip(codes, wanted):
            have = np.bincount(code, fitted, len(want))
            fitted = fitted * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[code]
    return fitted


def off_target(keys: list[tuple[str, ...]], tokens: np.ndarray, fitted: np.ndarray, targets: list[float | Mapping[str, float]]) -> float:
    """The largest relative error of a marginal against its target (of targets that aren't 0)."""
    total, worst = float(tokens.sum()), 0.0
    for d, target in enumerate(targets):
        names, code = np.unique([k[d] for k in keys], return_inverse=True)
        own = np.bincount(code, tokens, len(names))
        share = _shares({str(n): x / total for n, x in zip(names, own)}, target)
        want = np.array([share[str(n)] for n in names]) * total
        have = np.bincount(code, fitted, len(names))
        worst = max(worst, np.abs(have[want > 0] / want[want > 0] - 1).max(initial=0.0))
    return worst


def reachable(want: np.ndarray, most: np.ndarray) -> np.ndarray:
    """``want`` (tokens by value) with what exceeds ``most`` dealt to the other values in proportion."""
    total, full = want.sum(), np.zeros(len(want), bool)
    out = want.astype(float)
    while (over := (out > most) & ~full).any():
        full |= over
        rest, free = max(total - most[full].sum(), 0.0), want[~full].sum()
        out = np.where(full, most, want * (rest / free if free else 0.0))
    return out


def rake_capped(keys: list[tuple[str, ...]], tokens: np.ndarray, targets: list[float | Mapping[str, float]], keep: float, sweeps: int = CAPPED_SWEEPS) -> np.ndarray:
    """Tokens to draw of each cell: at most its own, with the target shares of ``keep`` of all tokens."""
    most, dims = tokens.astype(float), []
    drawn = most * keep
    for d, target in enumerate(targets):
        names, code = np.unique([k[d] for k in keys], return_inverse=True)
        sums = np.bincount(code, most, len(names))
        share = _shares({str(n): x / most.sum() for n, x in zip(names, sums)}, target)
        able = np.array([share[str(n)] for n in names])
        dims.append((code, reachable(able * most.sum() * keep, sums)))
    for _ in range(sweeps):
        last = drawn
        for code, want in dims:
            have = np.bincount(code, drawn, len(want))
            by = np.divide(want, have, out=np.zeros_like(want), where=have > 0)
            drawn = np.minimum(drawn * by[code], most)
        if np.abs(drawn - last).max() < CLOSE * most.sum():
            break
    return drawn


def _capped_tables(cells: DataFrame, names: list[str], targets: list[float | Mapping[str, float]], keep: float, sweeps: int = CAPPED_SWEEPS) -> DataFrame:
    """The same for any number of cells: aggregates over written tables, ``reachable`` too."""
    spark = cells.sparkSession
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    now = cells.withColumn("fitted", F.col("tokens") * F.lit(float(keep)))
    for name, target in zip(names, targets):
        sums = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("own"))
        if isinstance(target, int | float):
            sums = sums.withColumn("raw", F.pow(F.col("own") / F.lit(total or 1.0), F.lit(float(target))))
        else:
            given = spark.createDataFrame([(k, float(v)) for k, v in target.items()], "value string, raw double")
            sums = sums.join(given, F.col(name) == F.col("value"), "left").select(name, "own", F.coalesce("raw", F.lit(0.0)).alias("raw"))
        every = sums.agg(F.sum("raw")).first()[0] or 1.0
        sums = written(sums.select(name, "own", (F.col("raw") / every * total * float(keep)).alias("ask")), "wants")
        by, goal = 1.0, sums.agg(F.sum("ask")).first()[0] or 0.0
        while True:  # values that are taken whole grow in number until the rest can take what they lack
            full = F.col("ask") * F.lit(by) > F.col("own")
            whole, free = sums.agg(F.sum(F.when(full, F.col("own")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("ask")))).first()
            new = max(goal - (whole or 0.0), 0.0) / free if free else 0.0
            if new <= by * (1 + 1e-12):
                break
            by = new
        now = now.join(sums.select(name, F.least(F.col("ask") * F.lit(by), F.col("own")).alias(f"want_{name}")), name)
    now = written(now, "cells")
    for _ in range(sweeps):
        now = now.withColumn("last", F.col("fitted"))
        for name in names:
            want = F.col(f"want_{name}")
            now = _with_sums(now, name, names)
            now = now.withColumn("fitted", F.when(F.col("_have") > 0, F.least(F.col("fitted") * want / F.col("_have"), F.col("tokens").cast("double"))).otherwise(0.0)).drop("_have")
        now = written(now, "cells")
        if (now.agg(F.max(F.abs(F.col("fitted") - F.col("last")))).first()[0] or 0.0) < CLOSE * total or not total:
            break
        now = now.drop("last")
    return now.select(*names, "tokens", "fitted")


def _with_sums(cells: DataFrame, name: str, names: list[str]) -> DataFrame:
    """The cells with _have: the fitted tokens of their value of a dimension."""
    sums = written(cells.groupBy(name).agg(F.sum("fitted").alias("_have")), "sums")
    return with_facts(cells, sums, [name], [n for n in names if n != name])


def _rake_tables(cells: DataFrame, names: list[str], targets: list[float | Mapping[str, float]], sweeps: int) -> DataFrame:
    """The same for any number of cells: aggregates over written tables."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cells.withColumn("fitted", F.col("tokens").cast("double"))
    for name, target in zip(names, targets):
        sums = cells.groupBy(name).agg(F.sum("tokens").alias("own"))
        if isinstance(target, int | float):
            raw = F.when(F.col("own") > 0, F.pow(F.col("own") / F.lit(float(total or 1)), F.lit(float(target)))).otherwise(0.0)
            sums = sums.select(name, raw.alias("raw"))
        else:
            given = spark.createDataFrame([(k, float(v)) for k, v in target.items()], "value string, raw double")
            sums = sums.join(given, F.col(name) == F.col("value"), "left").select(name, F.coalesce("raw", F.lit(0.0)).alias("raw"))
        every = sums.agg(F.sum("raw")).first()[0] or 1.0
        now = now.join(sums.select(name, (F.col("raw") / every * float(total)).alias(f"want_{name}")), name)
    now = written(now, "cells")
    for _ in range(sweeps):
        for name in names:
            now = _with_sums(now, name, names)
            now = now.withColumn("fitted", F.when(F.col("_have") > 0, F.col("fitted") * F.col(f"want_{name}") / F.col("_have")).otherwise(0.0)).drop("_have")
        now = written(now, "cells")
    return now.select(*names, "tokens", "fitted")


def draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 (which SQL engines share)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def calibrated(
    docs: DataFrame,
    targets: Mapping[str, float | Mapping[str, float]] = TARGETS,
    keep: float = KEEP,
    sweeps: int = SWEEPS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    few_cells: int = 100_000,
    capped: bool = False,
) -> DataFrame:
    """``docs`` with _v_source, _v_lang, _v_topic, _v_tokens, _v_probability, _v_weight and _v_drawn."""
    spark = docs.sparkSession
    names = [f"_v_{d}" for d in DIMS]
    wanted = [targets[d] for d in DIMS]
    told = described(docs, text_col)
    cells = written(told.groupBy(*names).agg(F.sum("_v_tokens").alias("tokens")).filter("tokens > 0"), "cells")
    rows = cells.limit(few_cells + 1).collect()
    if len(rows) <= few_cells:
        rows.sort()
        keys = [tuple(r[n] for n in names) for r in rows]
        tokens = np.array([r["tokens"] for r in rows], np.int64)
        fitted = tokens
        if rows:
            fitted = rake_capped(keys, tokens, wanted, keep) / keep if capped else rake(keys, tokens, wanted, sweeps)
            if not capped and (off := off_target(keys, tokens, fitted, wanted)) > CLOSE_ENOUGH:
                warnings.warn(f"a marginal is {off:.1%} off its target after {sweeps} sweeps", stacklevel=2)
        schema = ", ".join(f"{n} string" for n in names) + ", _v_copies double"
        small = spark.createDataFrame([(*k, float(f / t) * keep) for k, f, t in zip(keys, fitted, tokens)], schema)
        met = told.join(F.broadcast(small), names, "left")
    else:
        if capped:
            large = _capped_tables(cells, names, wanted, keep).select(*names, (F.col("fitted") / F.col("tokens")).alias("_v_copies"))
        else:
            large = _rake_tables(cells, names, wanted, sweeps).select(*names, (F.col("fitted") / F.col("tokens") * keep).alias("_v_copies"))
        met = spread(told, large, names, [id_col], "left")
    copies = F.when(F.col("_v_tokens") > 0, F.coalesce("_v_copies", F.lit(0.0))).otherwise(0.0)
    chance = F.round(F.least(F.lit(1.0), copies), 6)
    met = met.withColumn("_v_probability", chance).withColumn("_v_weight", F.round(F.greatest(F.lit(1.0), copies), 6))
    return met.withColumn("_v_drawn", draw(id_col, seed) < F.col("_v_probability")).drop("_v_copies")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op4_mixing``: the documents drawn for the production mixture."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = calibrated(docs).filter("_v_drawn")
    return found.select(
        "doc_id", F.col("_v_source").alias("source"), F.col("_v_lang").alias("lang"), F.col("_v_topic").alias("topic"), F.col("_v_tokens").alias("n_tokens"), F.col("_v_probability").alias("probability"), F.col("_v_weight").alias("weight")
    )


def _oracle() -> str:
    steps, last = [], "f0"
    for n in range(SWEEPS):
        for d in DIMS:
            now = f"f{n + 1}{d}"
            steps.append(f"{now} AS (SELECT * REPLACE (fitted * w_{d} / sum(fitted) OVER (PARTITION BY {d}) AS fitted) FROM {last})")
            last = now
    wants = "".join(
        f"want_{d} AS (SELECT {d}, pow(sum(tokens) / any_value(total), {TARGETS[d]}) AS raw FROM cells, total GROUP BY {d}), share_{d} AS (SELECT {d}, raw / sum(raw) OVER () * total AS w_{d} FROM want_{d}, total), "
        for d in DIMS
    )
    return f"""
WITH told AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang,
    CASE WHEN contains(t, ' | ') THEN 'table' WHEN contains(t, '!!') THEN 'shouting'
      WHEN contains(t, '@') OR contains(t, 'http') THEN 'contact' WHEN length(t) > 4000 THEN 'long' ELSE 'prose' END AS topic,
    CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens
  FROM (SELECT *, coalesce(text, '') AS t FROM documents)),
cells AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM told GROUP BY ALL HAVING sum(n_tokens) > 0),
total AS (SELECT sum(tokens) AS total FROM cells),
{wants}
f0 AS (SELECT c.*, c.tokens AS fitted, w_source, w_lang, w_topic FROM cells c
  JOIN share_source USING (source) JOIN share_lang USING (lang) JOIN share_topic USING (topic)),
{", ".join(steps)},
met AS (
  SELECT t.*, CASE WHEN n_tokens > 0 THEN coalesce(fitted / tokens * {KEEP}, 0) ELSE 0 END AS copies
  FROM told t LEFT JOIN {last} f ON t.source = f.source AND t.lang = f.lang AND t.topic = f.topic)
SELECT doc_id, source, lang, topic, n_tokens, round(least(1.0, copies), 6) AS probability, round(greatest(1.0, copies), 6) AS weight
FROM met
WHERE CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) / 4294967296.0 < round(least(1.0, copies), 6)"""


ORACLE = _oracle()
