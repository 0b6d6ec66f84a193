"""Evaluation of result rows: medians by group, summaries of variants, weighted selection, verdicts, and counters.

A result row is one sample under one variant.  Summaries shuffle partial
aggregates; medians never gather a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ngrams import skyline


def grouped_medians(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., upper_median, true_median) of the values that are not null; no group is gathered.

    A sketch brackets the middle of each group within a thousandth of its rows,
    with a tenth of that as its error bound; the bracket's distinct values are
    counted, and only these are ranked.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    low, high = 0.499, 0.501
    bracket = F.percentile_approx("_v", [low, high], 10_000)
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), bracket.alias("_b"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    near = rows.alias("r").join(sizes.alias("s"), same).select(*(F.col(f"s.{k}").alias(k) for k in keys), "_v", "_n", "_b")
    # Everything below a bracket counts as one value.
    spot = F.when(F.col("_v") >= F.col("_b")[0], F.col("_v"))
    counted = near.where(F.col("_v") <= F.col("_b")[1]).groupBy(*keys, spot.alias("_v")).agg(F.count(F.lit(1)).alias("_k"), F.first("_n").alias("_n"))
    order = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_upto", F.sum("_k").over(order))
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    upper, lower = at(F.floor(F.col("_n") / 2)), at(F.floor((F.col("_n") - 1) / 2))
    return ranked.groupBy(*keys).agg(upper.alias("upper_median"), ((upper + lower) / 2.0).alias("true_median"))


def _mean(column: Column | str, digits: int = 4) -> Column:
    return F.round(F.avg(column), digits)


def variant_summary(rows: DataFrame) -> DataFrame:
    """One row for each variant of result rows.

    rows has variant; before_pos, after_pos, cleared, robust_cleared and noop
    (boolean); score_before, score_after, margin, seconds, attempts, usd and
    ai_style_score; quality (a struct of lexical_divergence, semantic_divergence,
    length_ratio, numbers_preserved, tokens_in and tokens_out); and notes.  Rates
    are of the rows that were positive before, null without any; means are of
    the values there are.  The notes are the distinct ones, sorted.
    """
    q = lambda name: F.col(f"quality.{name}")
    positive, cleared, robust = (F.count_if(F.col(c)) for c in ("before_pos", "cleared", "robust_cleared"))
    rate = lambda n: F.round(F.try_divide(n, positive), 4)
    delta = F.col("score_before") - F.col("score_after")
    out = rows.groupBy("variant").agg(
        F.count(F.lit(1)).alias("n"), positive.alias("before_positive"), F.count_if(F.col("after_pos")).alias("after_positive"),
        cleared.alias("cleared"), rate(cleared).alias("clear_rate"), robust.alias("robust_cleared"), rate(robust).alias("robust_clear_rate"), F.count_if(F.col("noop")).alias("noop_n"),
        F.count("ai_style_score").alias("human_n"), _mean("ai_style_score").alias("mean_ai_style_score"), _mean("score_before").alias("mean_score_before"), _mean("score_after").alias("mean_score_after"), _mean("margin").alias("mean_margin"),
        _mean(delta).alias("mean_score_delta"), _mean(q("lexical_divergence")).alias("mean_lexical_divergence"), F.count(q("semantic_divergence")).alias("semantic_n"), _mean(q("semantic_divergence")).alias("mean_semantic_divergence"),
        _mean(q("length_ratio")).alias("mean_length_ratio"), _mean(q("numbers_preserved")).alias("mean_numbers_preserved"), F.bround(F.avg(q("tokens_in"))).alias("mean_tokens_in"), F.bround(F.avg(q("tokens_out"))).alias("mean_tokens_out"),
        _mean("attempts", 2).alias("mean_attempts"), _mean("seconds", 2).alias("mean_seconds"), F.round(F.sum(F.coalesce("usd", F.lit(0.0))), 6).alias("est_usd"),
        F.round(F.try_divide(F.try_divide(cleared, positive), F.avg(q("tokens_out")) / 1e6), 2).alias("clears_per_mtok_out"),
    )
    medians = grouped_medians(rows.select("variant", delta.alias("delta")), ["variant"], "delta").select(F.col("variant").alias("_m"), F.round("upper_median", 4).alias("median_score_delta"))
    told = rows.select("variant", F.explode("notes").alias("note")).where("note is not null").distinct()
    told = told.groupBy(F.col("variant").alias("_t")).agg(F.sort_array(F.collect_list("note")).alias("notes"))
    out = out.join(medians, F.col("variant").eqNullSafe(F.col("_m")), "left").drop("_m").join(told, F.col("variant").eqNullSafe(F.col("_t")), "left").drop("_t")
    return out.withColumn("notes", F.coalesce("notes", F.array().cast("array<string>")))


def minimal_summary(rows: DataFrame) -> DataFrame:
    """One row on a search for the least level that is enough.

    rows has cleared (null: not evaluated), level, semantic_divergence,
    lexical_divergence, margin, attempts and notes.  Means, medians and the
    histogram of levels are of cleared rows; rows that were not evaluated and had
    no attempt are excluded, their notes counted as reasons.
    """
    done, ok = F.col("cleared").isNotNull(), F.coalesce(F.col("cleared"), F.lit(False))
    out_of = ~done & (F.coalesce("attempts", F.lit(0)) == 0)
    when = lambda name: F.when(ok, F.col(name))
    repeats = F.size(F.filter(F.coalesce("notes", F.array().cast("array<string>")), lambda n: n.startswith("identical watermarked generation")))
    main = rows.agg(
        F.count_if(done).alias("n_samples"), F.count_if(ok).alias("n_cleared"), F.round(F.try_divide(F.count_if(ok), F.count_if(done)), 4).alias("clear_rate"), F.count_if(out_of).alias("n_excluded"),
        F.coalesce(F.sum(repeats), F.lit(0)).alias("n_duplicate_generations"), _mean(when("level")).alias("mean_min_level"), _mean(when("semantic_divergence")).alias("mean_min_semantic_divergence"),
        _mean(when("lexical_divergence")).alias("mean_min_lexical_divergence"), _mean(when("margin")).alias("mean_min_margin"),
    )
    # Small parts of one row each, put side by side.
    parts = [main]
    cleared = rows.where(ok).withColumn("_all", F.lit(1))
    for name, column in (("median_min_level", "level"), ("median_min_semantic_divergence", "semantic_divergence")):
        parts.append(grouped_medians(cleared, ["_all"], column).agg(F.round(F.max("true_median"), 4).alias(name)))
    histogram = lambda x, key, name: x.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, "n")))).alias(name))
    parts.append(histogram(cleared.where("level is not null"), "level", "level_usage"))
    parts.append(histogram(rows.where(out_of).select(F.explode("notes").alias("note")), "note", "excluded_reasons"))
    out = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def weighted(gain: Column, loss: Column, other: Column, weights: tuple[float, float, float]) -> Column:
    """One score of three axes, the second turned round; null if an axis is."""
    return weights[0] * gain + weights[1] * (1.0 - loss) + weights[2] * other


def ranked_on_frontier(candidates: DataFrame, key: str, weights: tuple[float, float, float], *, coverage_floor: float = 0.0, prefer_holdout: bool = False) -> DataFrame:
    """Candidates of the frontier (all, if it is empty) that reach the floor, with their score, best first.

    candidates has robust_clear_rate, sem_div and human_like, and
    holdout_robust_clear_rate, which is the coverage if prefer_holdout: without
    one a candidate is out.  Ties go to the smaller key.
    """
    front = skyline(candidates, key, ["robust_clear_rate", "human_like"], ["sem_div"])
    coverage = F.col("holdout_robust_clear_rate" if prefer_holdout else "robust_clear_rate")
    score = weighted(F.col("robust_clear_rate"), F.col("sem_div"), F.col("human_like"), weights)
    # The frontier is empty only if no candidate has all axes; then none has a score either.
    return front.where(coverage >= coverage_floor - 1e-9).withColumn("weighted_score", score).where("weighted_score is not null").orderBy(F.desc("weighted_score"), key)


def verdict(best: Column, full: float = 1.0, none: float = 0.0) -> Column:
    """undetermined, resists, partial or removable from the best rate there is."""
    return F.when(best.isNull(), "undetermined").when(best <= none, "resists").when(best < full, "partial").otherwise("removable")


# Pairs of texts.


def token_estimate(text: Column, chars_per_token: float = 4.0) -> Column:
    """Tokens by length, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / max(chars_per_token, 1.0)).cast("int"))


def length_ratio(before: Column, after: Column) -> Column:
    return F.length(after) / F.greatest(F.length(before), F.lit(1))


def semantic_divergence(a: Column, b: Column) -> Column:
    """1 - cosine of two vectors; null if one is zero or their lengths differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return F.when(F.size(a) == F.size(b), 1.0 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


# Counters.


def batch_counters(reports: DataFrame, report_col: str = "report") -> DataFrame:
    """(files, errors, partial, with_carriers, carriers) of inspected files."""
    r = F.col(report_col)
    return reports.agg(F.count(F.lit(1)).alias("files"), F.count_if(r.error.isNotNull()).alias("errors"), F.count_if(r.partial).alias("partial"), F.count_if(r.suspicious_total > 0).alias("with_carriers"), F.coalesce(F.sum(r.suspicious_total), F.lit(0)).alias("carriers"))


def dangling(references: DataFrame, members: DataFrame, keys: list[str], target: str, name: str) -> DataFrame:
    """References (keys..., target) to what is not among the members (keys..., name) of the same group."""
    known = members.select(*keys, F.col(name).alias(target)).distinct()
    return references.join(known, [*keys, target], "left_anti")
