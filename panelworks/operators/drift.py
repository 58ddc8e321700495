"""Population drift: PSI per feature, overall and by segment.

All features are melted to (feature, value) and counted once per side; edges,
bins and means come from those counts, so the number of features does not change
the number of jobs. For many cycles the counts are kept per half-year as a cube:
both sides of any cycle are sums over its half-years, and the panel is read once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.functions import periods as P
from panelworks.functions.numeric import ratio
from panelworks.operators.ordered import null_safe_join, quantiles_of_counts, value_counts
from panelworks.operators.splits import embargo_bounds
from panelworks.session import materialise


def drift_level(psi: Column) -> Column:
    return F.when(psi < K.PSI_LOW, "none").when(psi < K.PSI_HIGH, "moderate").otherwise("high")


def _sides(side: str) -> dict[str, Column]:
    return {"n_ref": (F.col(side) == "ref").cast("long"), "n_cur": (F.col(side) == "cur").cast("long")}


def _is_feature_keyed(by: Sequence[str]) -> bool:
    return list(by) == ["feature"]


def _join_small(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join a table of one row per group; per-feature tables are bounded by the column list."""
    return null_safe_join(left, F.broadcast(right) if _is_feature_keyed(by) else right, by)


def _edge_list(counts: DataFrame, by: Sequence[str], value: str, bins: int, open_ends: bool) -> DataFrame:
    """Distinct bin edges per group from the reference percentiles."""
    names = {f"q{i}": i / bins for i in range(bins + 1)}
    q = quantiles_of_counts(counts, by, value, "n_ref", names)
    points = [F.col(f"q{i}") for i in range(bins + 1)]
    if open_ends:
        edges = F.array_sort(F.array_distinct(F.array(*points)))
        n = F.size(edges)
        ends = F.concat(F.array(F.lit(float("-inf"))), F.slice(edges, 2, F.greatest(n - 2, F.lit(0))),
                        F.array(F.lit(float("inf"))))
        return q.select(*by, F.when(n >= 3, ends).otherwise(edges).alias("edges"))
    points[0], points[-1] = points[0] - K.PSI_FLOOR, points[-1] + K.PSI_FLOOR
    return q.select(*by, F.array_sort(F.array_distinct(F.array(*points))).alias("edges"))


def psi_bins(counts: DataFrame, by: Sequence[str], value: str = "value", bins: int = K.PSI_BINS,
             open_ends: bool = False) -> DataFrame:
    """Per-bin detail: bounds, counts, shares and contribution.

    Shares divide by all values of a side, so current values outside the
    reference range are in no bin but still in the denominator.
    """
    by = list(by)
    edges = _edge_list(counts, by, value, bins, open_ends)
    totals = counts.groupBy(*by).agg(F.sum("n_ref").alias("all_ref"), F.sum("n_cur").alias("all_cur"))
    at = _join_small(counts, edges, by)
    v = F.col(value).cast("double")
    last = F.element_at("edges", -1)
    place = F.when(v == last, F.size("edges") - 2).when(
        (v >= F.col("edges")[0]) & (v < last), F.size(F.filter("edges", lambda e: e <= v)) - 1)
    binned = at.select(*by, place.alias("bin"), "n_ref", "n_cur").where(F.col("bin").isNotNull()).groupBy(
        *by, "bin").agg(F.sum("n_ref").alias("ref_count"), F.sum("n_cur").alias("cur_count"))
    cells = edges.where(F.size("edges") >= 3).select(
        *by, F.posexplode(F.arrays_zip(F.slice("edges", 1, F.size("edges") - 1).alias("low"),
                                       F.slice("edges", 2, F.size("edges") - 1).alias("high"))).alias("bin", "_e"))
    cells = cells.select(*by, "bin", F.col("_e.low").alias("bin_low"), F.col("_e.high").alias("bin_high"))
    # by the bin grid first: at most ``bins`` rows per group, then the totals of the group
    full = null_safe_join(_join_small(cells, totals, by), binned, [*by, "bin"], "left")

    def share(count: str, total: str) -> Column:
        return F.when(F.coalesce(count, F.lit(0)) == 0, F.lit(K.PSI_FLOOR)).otherwise(
            ratio(F.col(count), F.col(total)))

    out = full.select(
        *by, "bin", "bin_low", "bin_high", F.coalesce("ref_count", F.lit(0)).alias("ref_count"),
        F.coalesce("cur_count", F.lit(0)).alias("cur_count"), share("ref_count", "all_ref").alias("ref_pct"),
        share("cur_count", "all_cur").alias("cur_pct"), "all_ref", "all_cur",
    ).where((F.col("all_ref") > 0) & (F.col("all_cur") > 0))
    if open_ends:
        out = out.withColumns({c: F.greatest(c, F.lit(K.PSI_FLOOR)) for c in ("ref_pct", "cur_pct")})
    gap = F.col("cur_pct") - F.col("ref_pct")
    return out.withColumn("psi_bin", gap * F.ln(F.col("cur_pct") / F.col("ref_pct")))


def psi_numeric(rows: DataFrame, by: Sequence[str], value: str = "value", side: str = "side",
                bins: int = K.PSI_BINS, segment_rules: bool = False, least: int = 50) -> DataFrame:
    """PSI per group with the counts and means of both sides.

    Degenerate references give 0; under the segment rules they, and sides with
    fewer than ``least`` values, give NULL.
    """
    return psi_of_counts(value_counts(rows, by, value, **_sides(side)), by, value, bins, segment_rules, least)


def psi_of_counts(counts: DataFrame, by: Sequence[str], value: str = "value", bins: int = K.PSI_BINS,
                  segment_rules: bool = False, least: int = 50) -> DataFrame:
    """``psi_numeric`` from (group, value, n_ref, n_cur) rows without null values."""
    by = list(by)
    v = F.col(value).cast("double")
    base = counts.groupBy(*by).agg(
        F.sum("n_ref").alias("n_reference"), F.sum("n_cur").alias("n_current"),
        ratio(F.sum(v * F.col("n_ref")), F.sum("n_ref")).alias("mean_reference"),
        ratio(F.sum(v * F.col("n_cur")), F.sum("n_cur")).alias("mean_current"),
    )
    total = psi_bins(counts, by, value, bins, segment_rules).groupBy(*by).agg(F.sum("psi_bin").alias("_psi"))
    out = null_safe_join(base, total, by, "left")
    if segment_rules:
        enough = (F.col("n_reference") >= least) & (F.col("n_current") >= least)
        return out.withColumn("psi_value", F.when(enough, F.col("_psi"))).drop("_psi")
    return out.withColumn("psi_value", F.coalesce("_psi", F.lit(0.0))).drop("_psi")


def psi_categorical(rows: DataFrame, by: Sequence[str], value: str = "value", side: str = "side") -> DataFrame:
    """PSI over the union of categories per group; an empty side gives 0."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(
        *[F.sum(c).alias(n) for n, c in _sides(side).items()])
    return psi_of_classes(counts, by)


def psi_of_classes(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """``psi_categorical`` from (group, category, n_ref, n_cur) rows."""
    by = list(by)
    totals = counts.groupBy(*by).agg(F.sum("n_ref").alias("n_reference"), F.sum("n_cur").alias("n_current"))
    at = _join_small(counts, totals, by)
    floor = F.lit(K.PSI_FLOOR)
    r = F.greatest(ratio(F.col("n_ref"), F.col("n_reference")), floor)
    c = F.greatest(ratio(F.col("n_cur"), F.col("n_current")), floor)
    both = (F.col("n_reference") > 0) & (F.col("n_current") > 0)
    return at.groupBy(*by).agg(
        F.max("n_reference").alias("n_reference"), F.max("n_current").alias("n_current"),
        F.coalesce(F.sum(F.when(both, (c - r) * F.ln(c / r))), F.lit(0.0)).alias("psi_value"))


def _rates() -> dict[str, Column]:
    return {
        "promo_rate_period": ratio(F.col("promo_en_periodo"), F.col("materias_en_periodo")),
        "promo_rate_win3": ratio(F.col("promo_win3"), F.col("materias_win3")),
    }


def _risk_rows(panel: DataFrame, unique: bool) -> DataFrame:
    rows = panel.where(F.col("at_risk") == 1)
    return rows if unique else rows.distinct()


def drift_rows(panel: DataFrame, horizon: int = K.LABEL_HORIZON, unique: bool = False) -> DataFrame:
    """At-risk rows, censored ones included, with ``side`` by the embargoed cutoff.

    Everything after the cutoff is current, the embargo gap too; promotion rates
    are recomputed from their counts. ``unique``: (student, half-year) is a key,
    so there are no duplicates to remove.
    """
    rows = _risk_rows(panel, unique)
    cutoff = embargo_bounds(rows, horizon).select("train_cutoff").scalar()
    side = F.when(F.col("academic_period") <= cutoff, "ref").otherwise("cur")
    return rows.withColumns(_rates()).withColumn("side", side)


def _melted(numeric: Sequence[str], texts: Sequence[str]) -> Column:
    """Columns as (feature, number, text) rows: numbers as double, others as text."""
    none_n, none_t = F.lit(None).cast("double"), F.lit(None).cast("string")
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("number"), none_t.alias("text")) for c in numeric]
    pairs += [F.struct(F.lit(c).alias("feature"), none_n.alias("number"), F.col(c).cast("string").alias("text")) for c in texts]
    return F.inline(F.array(*pairs))


def _with_value(kinds: Column) -> Column:
    return (kinds & F.col("number").isNotNull() & ~F.isnan("number")) | (~kinds & F.col("text").isNotNull())


def drift_of_counts(counts: DataFrame, by: Sequence[str], numeric: Sequence[str], label: str | None) -> DataFrame:
    """Drift table from (group, feature, number, text, n_ref, n_cur) rows without null values."""
    by = list(by)
    keys = [*by, "feature"]
    columns = [*by, "feature_name", "feature_type", "psi_value", "drift_level", "mean_reference",
               "mean_current", "n_reference", "n_current"]

    def shaped(df: DataFrame, kind: Column) -> DataFrame:
        return df.select(
            *by, F.col("feature").alias("feature_name"), kind.alias("feature_type"),
            F.round("psi_value", 6).alias("psi_value"), drift_level(F.col("psi_value")).alias("drift_level"),
            F.col("mean_reference"), F.col("mean_current"), "n_reference", "n_current",
        ).select(*columns)

    is_number = F.col("feature").isin(*numeric)
    numbers = psi_of_counts(counts.where(is_number).select(*keys, F.col("number").alias("value"), "n_ref", "n_cur"), keys)
    coded = counts.where(~is_number).select(*keys, F.col("text").alias("value"), "n_ref", "n_cur")
    classes = psi_of_classes(coded, keys)
    if label:
        v = F.col("value").cast("double")
        means = coded.where(F.col("feature") == label).groupBy(*keys).agg(
            ratio(F.sum(v * F.col("n_ref")), F.sum("n_ref")).alias("mean_reference"),
            ratio(F.sum(v * F.col("n_cur")), F.sum("n_cur")).alias("mean_current"))
        classes = null_safe_join(classes, means, keys, "left")
    else:
        classes = classes.withColumns({c: F.lit(None).cast("double") for c in ("mean_reference", "mean_current")})
    kind = F.when(F.col("feature") == (label or ""), "label").otherwise("categorical")
    return shaped(numbers, F.lit("numeric")).unionByName(shaped(classes, kind)).orderBy(
        *by, F.desc("psi_value"), "feature_name")


def feature_drift(rows: DataFrame, by: Sequence[str] = (), numeric: Sequence[str] = K.DRIFT_FEATURES,
                  categorical: Sequence[str] = (K.CATEGORY_FEATURE,), label: str | None = "dropout_next",
                  side: str = "side") -> DataFrame:
    """PSI, level, means and counts per feature; NULL labels are no category.

    The level follows the unrounded PSI. One pass counts all features; the counts
    are stored and everything else is read from them.
    """
    by = list(by)
    texts = [*categorical, *([label] if label else [])]
    long = rows.select(*by, side, _melted(numeric, texts)).where(_with_value(F.col("feature").isin(*numeric)))
    counts = long.groupBy(*by, "feature", "number", "text").agg(*[F.sum(c).alias(n) for n, c in _sides(side).items()])
    return drift_of_counts(materialise(counts, "drift-counts"), by, numeric, label)


def drift_cube(panel: DataFrame, numeric: Sequence[str] = K.DRIFT_FEATURES, categorical: Sequence[str] = (K.CATEGORY_FEATURE,),
               label: str | None = "dropout_next", unique: bool = False) -> DataFrame:
    """Rows per (feature, value, half-year) of the at-risk rows: all that the drift of any cycle needs.

    Promotion rates are recomputed from their counts, as in ``drift_rows``.
    """
    rows = _risk_rows(panel, unique).withColumns(_rates())
    texts = [*categorical, *([label] if label else [])]
    long = rows.select("academic_period", _melted(numeric, texts)).where(_with_value(F.col("feature").isin(*numeric)))
    return long.groupBy("feature", "number", "text", "academic_period").agg(F.count(F.lit(1)).alias("n"))


def cube_drift(cube: DataFrame, cycles: Sequence[tuple[str, str]], numeric: Sequence[str] = K.DRIFT_FEATURES,
               label: str | None = "dropout_next") -> DataFrame:
    """Drift table of several (cycle, cutoff) pairs from a stored cube; the panel is not read."""
    by = ["cycle_period", "reference_period"]
    period = F.col("academic_period")
    tags = F.array(*[F.when(period <= c, F.struct(
        F.lit(c).alias("cycle_period"), F.lit(cut).alias("reference_period"),
        F.when(period <= cut, F.col("n")).otherwise(0).alias("n_ref"), F.when(period > cut, F.col("n")).otherwise(0).alias("n_cur")))
        for c, cut in cycles])
    sides = cube.select("feature", "number", "text", F.inline(F.filter(tags, lambda t: t.isNotNull())))
    counts = sides.groupBy(*by, "feature", "number", "text").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))
    return drift_of_counts(materialise(counts, "drift-counts"), by, numeric, label)


def drift_summary(drift: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Worst level, highest PSI, counts per level and the three worst features of a drift table."""
    by = list(by)
    level = F.col("drift_level")
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("psi_value")).alias("k"), "feature_name", "drift_level")))
    # a drift table has one row per feature
    out = drift.groupBy(*by).agg(
        F.max("psi_value").alias("max_psi"), F.count_if(level == "high").alias("n_features_high"),
        F.count_if(level == "moderate").alias("n_features_mod"), F.count_if(level == "none").alias("n_features_none"),
        F.count(F.lit(1)).alias("n_features"), F.slice(ranked, 1, 3).alias("_top"),
    )
    overall = F.when(F.col("n_features") == 0, "unknown").when(F.col("n_features_high") > 0, "high").when(
        F.col("n_features_mod") > 0, "moderate").otherwise("none")
    return out.select(
        *by, overall.alias("overall_level"), F.coalesce("max_psi", F.lit(0.0)).alias("max_psi"), "n_features_high",
        "n_features_mod", "n_features_none", "n_features",
        F.transform("_top", lambda t: t["feature_name"]).alias("top3_features"),
    )


def stamped(drift: DataFrame, cycle: Column, reference: Column) -> DataFrame:
    """Drift rows ready to be stored per (cycle, reference)."""
    return drift.select(cycle.alias("cycle_period"), reference.alias("reference_period"), *drift.columns)


def segment_drift(rows: DataFrame, segments: Sequence[str], numeric: Sequence[str], label: str = "dropout_next",
                  side: str = "side", least_rows: int = 200) -> DataFrame:
    """PSI of some features and the label by segment value; small segments are left out."""
    named = F.array(*[F.struct(F.concat(F.lit(f"{c}="), F.col(c)).alias("segmento")) for c in segments])
    long = rows.select(side, label, *numeric, F.inline(named)).where(F.col("segmento").isNotNull())
    # one pass: the label's counts keep its nulls, so they hold the number of rows as well
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in (*numeric, label)])
    counts = materialise(long.select("segmento", side, F.inline(pairs)).groupBy("segmento", "feature", "value").agg(
        *[F.sum(c).alias(n) for n, c in _sides(side).items()]), "segment-counts")
    of_label, v = counts.where(F.col("feature") == label), F.col("value")

    def mean(n: str) -> Column:
        return ratio(F.sum(v * F.col(n)), F.sum(F.when(v.isNotNull(), F.col(n))))

    sizes = of_label.groupBy("segmento").agg(
        F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_act"), mean("n_ref").alias("_r"), mean("n_cur").alias("_c"),
    ).where((F.col("n_ref") >= least_rows) & (F.col("n_act") >= least_rows))
    floor = F.lit(K.PSI_FLOOR)

    def part(r: Column, c: Column) -> Column:
        r, c = F.greatest(r, floor), F.greatest(c, floor)
        return (c - r) * F.ln(c / r)

    known = F.col("_r").isNotNull() & F.col("_c").isNotNull()
    binary = F.when(known, part(1 - F.col("_r"), 1 - F.col("_c")) + part(F.col("_r"), F.col("_c")))
    known_values = counts.where(F.col("feature").isin(*numeric) & v.isNotNull() & ~F.isnan(v))
    psi = psi_of_counts(known_values, ["segmento", "feature"], segment_rules=True)
    wide = psi.groupBy("segmento").agg(*[
        F.max(F.when(F.col("feature") == c, F.col("psi_value"))).alias(f"psi_{c}") for c in numeric])
    return sizes.join(wide, "segmento", "left").select(
        "segmento", "n_ref", "n_act", *[f"psi_{c}" for c in numeric], binary.alias(f"psi_{label}"))


def shifted_cycles(cycles: Sequence[str], horizon: int = K.LABEL_HORIZON) -> list[tuple[str, str]]:
    return [(c, P.shift_label(c, horizon)) for c in cycles]
