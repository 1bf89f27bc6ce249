"""Aggregates kept as partial states by short steps and merged into any range (O12.14).

A rule that is asked for every half minute over the last minutes, hours and weeks would read the same rows again and again. Here
rows are read once: each step keeps counts, sums and largest values, a HyperLogLog sketch for distinct values and a KLL sketch for
quantiles. All of them can be merged, so a range of any length, and any coarser step, comes from the states alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sizes of the sketches: a distinct count is off by 1.04 / sqrt(2 ** 12) = 1.6 % (one deviation), a quantile's rank by 1.33 % (99 of 100 times).
HLL, KLL = 12, 200


def states(rows: DataFrame, ts: str, step: str, keys: list[str], counts: dict[str, Column], sums: dict[str, Column] = {}, distinct: dict[str, Column] = {}, quantiles: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """step (start), keys, and a state for each name: one row a step and key, combined in each task first. Rows without a time have no step."""
    made = [F.count_if(c).alias(f"count_{n}") for n, c in counts.items()]
    made += [F.sum(c).alias(f"sum_{n}") for n, c in sums.items()] + [F.max(c).alias(f"max_{n}") for n, c in sums.items()]
    made += [F.hll_sketch_agg(c, HLL).alias(f"hll_{n}") for n, c in distinct.items()]
    made += [F.kll_sketch_agg_double(c.cast("double"), KLL).alias(f"kll_{n}") for n, c in quantiles.items()]
    out = rows.groupBy(F.window(ts, step).alias("w"), *keys).agg(*made)
    return out.select(F.col("w.start").alias("step"), *keys, *[c for c in out.columns if c not in ("w", *keys)])


def refresh(rows: DataFrame, path: str, ts: str, since: Column | None, **how) -> None:
    """Write the states of ``rows`` to ``path``, by day; days from ``since`` on are made anew, older ones stay as they are."""
    rows = rows if since is None else rows.where(F.col(ts) >= F.date_trunc("day", since))
    made = states(rows, ts, **how).withColumn("day", F.to_date("step"))
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def merged(made: DataFrame, keys: list[str], width: str, every: str | None = None) -> DataFrame:
    """States of windows of ``width``, one ``every`` so often (else side by side), by keys: start, keys, states. Steps must divide both."""
    w = F.window("step", width, every).alias("w") if every else F.window("step", width).alias("w")
    return _merge(made.select(w, *[c for c in made.columns if c not in ("step", "day")]), ["w", *keys]).select(F.col("w.start").alias("start"), *keys, *_states(made))


def over(made: DataFrame, keys: list[str], start: Column, end: Column) -> DataFrame:
    """The states of one range, start <= step < end, by keys."""
    return _merge(made.where((F.col("step") >= start) & (F.col("step") < end)), keys).select(*keys, *_states(made))


def _states(made: DataFrame) -> list[str]:
    return [c for c in made.columns if c.startswith(("count_", "sum_", "max_", "hll_", "kll_"))]


def _merge(made: DataFrame, keys: list[str]) -> DataFrame:
    how = {"count": F.sum, "sum": F.sum, "max": F.max, "hll": F.hll_union_agg, "kll": F.kll_merge_agg_double}
    return made.groupBy(*keys).agg(*[how[c.split("_")[0]](c).alias(c) for c in _states(made)])


def estimate(name: str) -> Column:
    """How many distinct values a state stands for."""
    return F.hll_sketch_estimate(f"hll_{name}")


def quantile(name: str, q: float) -> Column:
    """A quantile of a state's values, by rank; null without any."""
    return F.when(F.kll_sketch_get_n_double(f"kll_{name}") > 0, F.kll_sketch_get_quantile_double(f"kll_{name}", F.lit(q)))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
