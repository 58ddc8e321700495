"""Metrics of a scored table: label ``y`` (0/1), score ``p``, any grouping.

Ordered metrics work on one row per (group, distinct score) with running class
totals; the others are plain aggregates. Global, per-period and per-subgroup
runs are the same job with another ``by``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.functions.numeric import ratio
from panelworks.operators.ordered import exact_quantiles, null_safe_join, running_totals, value_counts
from panelworks.session import materialise

STEPS_AT_ONCE = 3  # steps of an iterative fit that one job takes


def score_counts(scored: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p",
                 weight: str | None = None) -> DataFrame:
    """Positives and negatives per (group, distinct score)."""
    w = F.col(weight) if weight else F.lit(1)
    return value_counts(scored, by, p, pos=F.col(y) * w, neg=(1 - F.col(y)) * w)


def ranked_scores(scored: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p",
                  weight: str | None = None) -> DataFrame:
    """Score counts with the classes strictly below and in the whole group."""
    return running_totals(score_counts(scored, by, y, p, weight), by, p, ["pos", "neg"])


def _above(column: str) -> Column:
    """Class total at or above a score."""
    return (F.col(f"all_{column}") - F.col(f"before_{column}")).cast("double")


def _beyond(column: str) -> Column:
    """Class total strictly above a score."""
    return _above(column) - F.col(column)


def _precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(ratio(tp, tp + fp), F.lit(1.0))


def auc_of_ranked(ranked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC, ties one half; NULL when a group has one class only."""
    wins = F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") * 0.5)
    out = ranked.groupBy(*by).agg(
        F.sum(wins).alias("_wins"), F.max("all_pos").alias("_p"), F.max("all_neg").alias("_n"))
    return out.select(*by, ratio(F.col("_wins"), F.col("_p").cast("double") * F.col("_n")).alias("auc"))


def roc_auc(scored: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p",
            weight: str | None = None) -> DataFrame:
    return auc_of_ranked(ranked_scores(scored, by, y, p, weight), by)


def ranking_metrics(scored: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """AUC, average precision, precision–recall area and KS, in one ordered pass."""
    ranked = ranked_scores(scored, by, y, p)
    tp, fp, tp0, fp0 = _above("pos"), _above("neg"), _beyond("pos"), _beyond("neg")
    total_p, total_n = F.col("all_pos").cast("double"), F.col("all_neg").cast("double")
    step = ratio(F.col("pos"), total_p)
    below_p = ratio(F.col("before_pos") + F.col("pos"), total_p)
    below_n = ratio(F.col("before_neg") + F.col("neg"), total_n)
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    out = ranked.groupBy(*by).agg(
        F.sum(F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") * 0.5)).alias("_wins"),
        F.sum(step * _precision(tp, fp)).alias("average_precision"),
        F.sum(step * (_precision(tp, fp) + _precision(tp0, fp0)) / 2).alias("pr_auc"),
        F.max(F.abs(below_p - below_n)).alias("_ks"),
        F.max("all_pos").alias("_p"), F.max("all_neg").alias("_n"),
    )
    return out.select(
        *by, F.col("_p").cast("long").alias("n_pos"), F.col("_n").cast("long").alias("n_neg"),
        ratio(F.col("_wins"), F.col("_p").cast("double") * F.col("_n")).alias("roc_auc"),
        "average_precision", "pr_auc", F.when(both, F.col("_ks")).alias("ks_statistic"),
    )


def roc_points(scored: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, fpr, tpr) per distinct score; the origin has a NULL threshold."""
    ranked = ranked_scores(scored, by, y, p)
    points = ranked.select(
        *by, F.col(p).alias("threshold"), ratio(_above("neg"), F.col("all_neg")).alias("fpr"),
        ratio(_above("pos"), F.col("all_pos")).alias("tpr"),
    )
    origin = scored.select(*by).distinct() if by else scored.limit(1).select()
    return points.unionByName(origin.select(
        *by, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def pr_points(scored: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, precision, recall) per distinct score; the closing point is left to the reader."""
    ranked = ranked_scores(scored, by, y, p)
    tp, fp = _above("pos"), _above("neg")
    return ranked.select(
        *by, F.col(p).alias("threshold"), _precision(tp, fp).alias("precision"),
        ratio(tp, F.col("all_pos")).alias("recall"),
    )


def _bin_from(p: str, bins: int, closed_left: bool) -> Column:
    """Equal-width bin on [0, 1] against the floating-point edges ``i / bins`` of a linear grid."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    test = (lambda e: F.col(p) >= e) if closed_left else (lambda e: F.col(p) > e)
    return sum((test(F.lit(e)).cast("int") for e in edges), F.lit(0))


def threshold_metrics(scored: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p",
                      threshold: float = 0.5, bins: int = 10) -> DataFrame:
    """Brier, skill, calibration error and the confusion counts with their rates."""
    yes, hit = F.col(y) == 1, F.col(p) >= threshold
    binned = scored.groupBy(*by, _bin_from(p, bins, True).alias("_bin")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("double")).alias("_y"), F.sum(p).alias("_s"),
        F.sum((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("_sq"),
        F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"),
        F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"),
    )
    out = binned.groupBy(*by).agg(
        F.sum("_n").alias("n"), F.sum("_y").alias("_y"), F.sum("_sq").alias("_sq"),
        F.sum(F.abs(F.col("_y") - F.col("_s"))).alias("_gap"),
        *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")],
    )
    n, tp, fp, fn, tn = (F.col(c) for c in ("n", "tp", "fp", "fn", "tn"))
    prevalence, brier = ratio(F.col("_y"), n), ratio(F.col("_sq"), n)
    return out.select(
        *by, "n", prevalence.alias("prevalence"), brier.alias("brier_score"),
        (1 - ratio(brier, prevalence * (1 - prevalence))).alias("brier_skill_score"),
        ratio(F.col("_gap"), n).alias("ece"), "tp", "fp", "fn", "tn",
        ratio(tp, tp + fn).alias("tpr"), ratio(fp, fp + tn).alias("fpr"), ratio(tp, tp + fp).alias("precision"),
        F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1"),
        ratio(tp + tn, n).alias("accuracy"), ratio(tp + fp, n).alias("predicted_rate"),
    )


def confusion_rows(scored: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p",
                   threshold: float = 0.5) -> DataFrame:
    """Confusion matrix in long form with the share of its true class."""
    m = threshold_metrics(scored, by, y, p, threshold)
    cells = F.array(*[
        F.struct(F.lit(t).alias("actual"), F.lit(q).alias("predicted"), F.col(c).alias("n"),
                 ratio(F.col(c), F.col(c) + F.col(o)).alias("row_share"))
        for t, q, c, o in ((0, 0, "tn", "fp"), (0, 1, "fp", "tn"), (1, 0, "fn", "tp"), (1, 1, "tp", "fn"))
    ])
    return m.select(*by, F.inline(cells))


def class_report(scored: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p",
                 threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per class, macro and weighted; accuracy on every row.

    An undefined rate counts as zero.
    """
    m = threshold_metrics(scored, by, y, p, threshold)
    zero = F.lit(0.0)

    def rates(hit: str, false: str, missed: str):
        h, f, s = F.col(hit), F.col(false), F.col(missed)
        return (F.coalesce(ratio(h, h + f), zero), F.coalesce(ratio(h, h + s), zero),
                F.coalesce(ratio(2 * h, 2 * h + f + s), zero), h + s)

    neg, pos = rates("tn", "fn", "fp"), rates("tp", "fp", "fn")
    total = (neg[3] + pos[3]).cast("double")
    rows = [("0", neg), ("1", pos)]
    rows.append(("macro avg", tuple((a + b) / 2 for a, b in zip(neg[:3], pos[:3])) + (neg[3] + pos[3],)))
    weighted = tuple((a * neg[3] + b * pos[3]) / total for a, b in zip(neg[:3], pos[:3]))
    rows.append(("weighted avg", weighted + (neg[3] + pos[3],)))
    cells = F.array(*[
        F.struct(F.lit(name).alias("class"), r[0].alias("precision"), r[1].alias("recall"),
                 r[2].alias("f1_score"), r[3].alias("support")) for name, r in rows
    ])
    return m.select(*by, "accuracy", F.inline(cells))


def top_share(scored: DataFrame, by: Sequence[str] = (), key: str = "id", y: str = "y", p: str = "p",
              shares: Sequence[int] = K.TOP_SHARES, at_least_one: bool = False) -> DataFrame:
    """Precision and recall among the top K % of scores, in long form.

    Equal scores are ordered by the md5 of the key. Rows are counted per (score,
    digest prefix); whole cells above the cut are summed and only the cells the
    cut falls into are looked at row by row, so heavy ties stay spread out.
    """
    by = list(by)
    digest = F.md5(F.col(key).cast("string"))
    rows = scored.select(*by, F.col(key).alias("_id"), F.col(y).alias("_y"), (-F.col(p)).alias("_s"),
                         digest.alias("_h"), F.substring(digest, 1, 3).alias("_tie"))
    cells = rows.groupBy(*by, "_s", "_tie").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"))
    ranked = running_totals(cells, by, "_s", ["n", "pos"], within=["_tie"])
    cuts = F.array(*[F.struct(
        F.lit(share).alias("top_pct"),
        F.greatest(F.floor(F.col("all_n") * share / 100), F.lit(1 if at_least_one else 0)).cast("long").alias("k"),
    ) for share in shares])
    cut = ranked.select("*", F.inline(cuts))
    whole = F.when(F.col("before_n") + F.col("n") <= F.col("k"), F.col("pos")).otherwise(0)
    split = (F.col("before_n") < F.col("k")) & (F.col("before_n") + F.col("n") > F.col("k"))
    full = cut.groupBy(*by, "top_pct").agg(
        F.sum(whole).alias("hits"), F.max("k").alias("k"), F.max("all_pos").alias("all_pos"))
    partly = null_safe_join(
        rows, cut.where(split).select(*by, "_s", "_tie", "top_pct", (F.col("k") - F.col("before_n")).alias("_need")),
        [*by, "_s", "_tie"],
    )
    place = Window.partitionBy(*by, "top_pct", "_s", "_tie").orderBy("_h", "_id")
    taken = partly.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= F.col("_need"))
    rest = taken.groupBy(*by, "top_pct").agg(
        F.sum("_y").alias("hits"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("long").alias("all_pos"))
    summed = full.unionByName(rest).groupBy(*by, "top_pct").agg(
        F.sum("hits").alias("hits"), F.max("k").alias("k"), F.max("all_pos").alias("all_pos"))
    return summed.select(
        *by, "top_pct", "k", ratio(F.col("hits"), F.col("k")).alias("precision_at"),
        ratio(F.col("hits"), F.col("all_pos")).alias("recall_at"),
    )


def calibration_curve(scored: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p",
                      bins: int = 10) -> DataFrame:
    """Mean score and share of positives per non-empty uniform bin (bins closed on the right)."""
    return scored.groupBy(*by, _bin_from(p, bins, False).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted"),
        F.avg(F.col(y).cast("double")).alias("fraction_positive"))


def calibration_fit(scored: DataFrame, by: Sequence[str] = (), y: str = "y", p: str = "p",
                    tolerance: float = 1e-9, clip: float = 1e-6, most_steps: int = 200) -> DataFrame:
    """Slope and intercept of a logistic fit on the logit of the score (L2 on the slope, C = 1).

    Newton steps over all groups at once, until the gradient of every group is
    below ``tolerance`` per row; a step that raises the loss is halved. Each step
    is an aggregate of a few sums over the distinct scores, so no group is ever
    fitted in a single task; ``STEPS_AT_ONCE`` of them make one stored table, and a
    settled group stays where it is. A group with one class has no fit. Raises when
    ``most_steps`` do not suffice.
    """
    keys = list(by) or ["_all"]
    base = scored if by else scored.withColumn("_all", F.lit(0))
    counts = score_counts(base, keys, y, p)
    bounded = F.least(F.greatest(F.col(p), F.lit(clip)), F.lit(1 - clip))
    points = materialise(
        counts.select(*keys, F.ln(bounded / (1 - bounded)).alias("_x"), "pos", "neg"), "calibration_points")
    groups = points.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    zero = F.lit(0.0)
    # slope, intercept: where the sums are taken; w0, b0, loss0: the best place so far; dw, db: the step from there
    trial = materialise(groups.where((F.col("_p") > 0) & (F.col("_n") > 0)).select(
        *keys, *[zero.alias(c) for c in ("slope", "intercept", "w0", "b0", "dw", "db")],
        F.lit(float("inf")).alias("loss0")), "calibration_step")
    w, b, x = F.col("slope"), F.col("intercept"), F.col("_x")

    def advanced(trial: DataFrame) -> DataFrame:
        # the parameters are one row per group; without groups that is a single row
        at = null_safe_join(points, trial if by else F.broadcast(trial), keys)
        z = w * x + b
        n, mu = F.col("pos") + F.col("neg"), 1 / (1 + F.exp(-z))
        s, err = n * mu * (1 - mu), n * mu - F.col("pos")
        # log(1 + exp(z)) without overflow
        loss = n * (F.greatest(z, zero) + F.log1p(F.exp(-F.abs(z)))) - F.col("pos") * z
        kept = ("slope", "intercept", "w0", "b0", "dw", "db", "loss0")
        sums = at.groupBy(*keys).agg(
            *[F.max(c).alias(c) for c in kept], F.sum(n).alias("_rows"), F.sum(loss).alias("_loss"),
            F.sum(err * x).alias("_gw"), F.sum(err).alias("_gb"),
            F.sum(s * x * x).alias("_ww"), F.sum(s * x).alias("_wb"), F.sum(s).alias("_bb"),
        )
        gw, gb = F.col("_gw") + w, F.col("_gb")
        ww, wb, bb = F.col("_ww") + 1, F.col("_wb"), F.col("_bb")
        det = ww * bb - wb * wb
        total = F.col("_loss") + w * w / 2
        better = total <= F.col("loss0") * (1 + 1e-12)
        done = F.greatest(F.abs(gw), F.abs(gb)) <= tolerance * F.col("_rows")
        judged = sums.select(
            *keys, done.alias("done"), F.when(better, w).otherwise(F.col("w0")).alias("w0"),
            F.when(better, b).otherwise(F.col("b0")).alias("b0"), F.when(better, total).otherwise(F.col("loss0")).alias("loss0"),
            F.when(done, 0.0).when(better, -ratio(bb * gw - wb * gb, det)).otherwise(F.col("dw") / 2).alias("dw"),
            F.when(done, 0.0).when(better, -ratio(ww * gb - wb * gw, det)).otherwise(F.col("db") / 2).alias("db"),
            F.when(done, w).alias("_w"), F.when(done, b).alias("_b"),
        )
        return judged.select(
            *keys, "w0", "b0", "dw", "db", "loss0", "done", F.coalesce("_w", F.col("w0") + F.col("dw")).alias("slope"),
            F.coalesce("_b", F.col("b0") + F.col("db")).alias("intercept"))

    for _ in range(-(-most_steps // STEPS_AT_ONCE)):
        for _ in range(STEPS_AT_ONCE):
            trial = advanced(trial)
        trial = materialise(trial, "calibration_step")
        if not trial.where(~F.col("done")).limit(1).count():
            break
    else:
        raise RuntimeError(f"the calibration fit did not settle in {most_steps} steps")
    every = null_safe_join(groups.select(*keys), trial.select(*keys, "slope", "intercept"), keys, "left")
    return every.select(*by, F.col("slope").alias("calib_slope"), F.col("intercept").alias("calib_intercept"))


def recency_scores(rows: DataFrame, recency: str = K.RECENCY_FEATURE, out: str = "p") -> DataFrame:
    """Days since last activity as the score; a missing value takes the median."""
    middle = exact_quantiles(rows, [], recency, {"m": 0.5}).scalar()
    return rows.withColumn(out, F.coalesce(F.col(recency).cast("double"), middle))


def metrics_by(scored: DataFrame, by: Sequence[str], least: int = 50, y: str = "y", p: str = "p") -> DataFrame:
    """AUC with actual and predicted rates per group of at least ``least`` rows; one-class groups have no AUC."""
    flat = threshold_metrics(scored, by, y, p).where(F.col("n") >= least)
    joined = null_safe_join(flat, roc_auc(scored, by, y, p), list(by))
    return joined.select(
        *by, "n", F.col("auc"), F.col("prevalence").alias("actual_rate"), "predicted_rate")


def value_histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = (), spread: Sequence[str] = ()
                    ) -> DataFrame:
    """Equal-width histogram between a group's minimum and maximum, last bin closed.

    ``spread`` are the columns the range is taken over (default ``by``).
    """
    over = list(spread) or list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    counts = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n"))
    limits = rows.groupBy(*over).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if over:
        at = null_safe_join(counts, limits, over)
    else:
        both = limits.select(F.struct("_lo", "_hi")).scalar()
        at = counts.withColumn("_lim", both).select(*counts.columns, "_lim._lo", "_lim._hi")
    # a constant sample is binned on a unit range around it
    lo = F.when(F.col("_lo") == F.col("_hi"), F.col("_lo") - 0.5).otherwise(F.col("_lo"))
    hi = F.when(F.col("_lo") == F.col("_hi"), F.col("_hi") + 0.5).otherwise(F.col("_hi"))
    width = (hi - lo) / bins
    guess = F.least(F.floor((F.col("_v") - lo) / (hi - lo) * bins), F.lit(bins - 1))
    placed = at.select(*by, "_n", lo.alias("_lo"), hi.alias("_hi"), width.alias("_w"), guess.alias("_g"), "_v")
    low, up = F.col("_lo") + F.col("_g") * F.col("_w"), F.col("_lo") + (F.col("_g") + 1) * F.col("_w")
    index = (F.when(F.col("_v") < low, F.col("_g") - 1)
             .when((F.col("_v") >= up) & (F.col("_g") < bins - 1), F.col("_g") + 1).otherwise(F.col("_g")))
    binned = placed.groupBy(*by, index.cast("long").alias("bin")).agg(
        F.sum("_n").alias("n"), F.max("_lo").alias("_lo"), F.max("_w").alias("_w"))
    whole = Window.partitionBy(*by)  # at most ``bins`` rows
    return binned.select(
        *by, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_low"), "n",
        (F.col("n") / F.sum("n").over(whole) / F.col("_w")).alias("density"),
    )
