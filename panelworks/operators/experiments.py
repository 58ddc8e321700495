"""Backtests and model studies. Every fit is scored into one table, then measured in grouped jobs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.functions import periods as P
from panelworks.functions.numeric import ratio, rounded
from panelworks.operators import metrics as ME
from panelworks.operators import modeling as MO
from panelworks.operators import resample as RS
from panelworks.operators import splits as SP
from panelworks.operators.evaluation import several_scores
from panelworks.operators.ordered import exact_quantiles, null_safe_join, running_totals
from panelworks.session import concurrently, fan_out, materialise

Fit = Callable[[DataFrame, str], PipelineModel]
PERIOD = SP.PERIOD


def trainer(spec: MO.TrainSpec = MO.TrainSpec(), name: str = "GradientBoosting") -> Fit:
    """A fit function of (training rows, tag); callers may wrap it to reuse models by tag."""
    return lambda train, tag: MO.fit(train, name, spec)


def _upto(rows: DataFrame, cutoff: str) -> DataFrame:
    return rows.where(F.col(PERIOD) <= cutoff)


def _at(rows: DataFrame, period: str) -> DataFrame:
    return rows.where(F.col(PERIOD) == period)


def scored_pairs(rows: DataFrame, pairs: Sequence[tuple[str, str]], fit: Fit) -> DataFrame:
    """Test rows of each (cutoff, test period) scored by the model of that cutoff, as one stored table."""
    models = concurrently(rows.sparkSession, {c: partial(fit, _upto(rows, c), c) for c, _ in pairs})
    out = None
    for cutoff, test in pairs:
        part = MO.score(models[cutoff], _at(rows, test)).select(
            F.lit(cutoff).alias("origin"), F.lit(test).alias("test_period"), F.col("legajo").alias("id"),
            F.col("dropout_next").alias("y"), "p", F.col(K.RECENCY_FEATURE).alias("days"))
        out = part if out is None else out.unionByName(part)
    return materialise(out, "scored_pairs")


def train_sizes(rows: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    tagged = SP.tagged_splits(rows, pairs).where("split = 'train'")
    return tagged.groupBy("origin", "test_period").agg(F.count(F.lit(1)).alias("n_train"))


def rolling_backtest(rows: DataFrame, tests: Sequence[str], fit: Fit, replicates: int = K.BOOTSTRAP_REPLICATES
                     ) -> DataFrame:
    """One row of ranking, calibration and top-share metrics per origin."""
    pairs = SP.origins(tests)
    return backtest_table(scored_pairs(rows, pairs, fit), rows, pairs, replicates)


def backtest_table(scored: DataFrame, rows: DataFrame, pairs: Sequence[tuple[str, str]], replicates: int = K.BOOTSTRAP_REPLICATES
                   ) -> DataFrame:
    """``rolling_backtest`` from the stored scores of every origin."""
    by = ["origin", "test_period"]

    def baseline() -> DataFrame:
        middle = exact_quantiles(scored, by, "days", {"_m": 0.5})
        based = null_safe_join(scored, middle, by, "left").withColumn("base", F.coalesce(F.col("days").cast("double"), "_m"))
        return ME.roc_auc(based, by, p="base").withColumnRenamed("auc", "baseline_recency_auc")

    # each stores tables on its way; the many small jobs of some run beside the bootstrap
    jobs = {
        "interval": partial(RS.bootstrap_interval, scored, replicates, by=by), "ranking": partial(ME.ranking_metrics, scored, by),
        "calibration": partial(ME.calibration_fit, scored, by), "shares": partial(ME.top_share, scored, by), "baseline": baseline}
    parts = concurrently(scored.sparkSession, jobs, at_once=len(jobs))
    out = null_safe_join(ME.threshold_metrics(scored, by), parts["ranking"], by)
    out = null_safe_join(out, train_sizes(rows, pairs), by)
    out = null_safe_join(out, parts["interval"], by)
    out = null_safe_join(out, parts["baseline"], by)
    out = null_safe_join(out, parts["calibration"], by)
    tops = parts["shares"].groupBy(*by).agg(*[
        F.max(F.when(F.col("top_pct") == k, F.col(c))).alias(f"{s}_at_{k}")
        for s, c in (("p", "precision_at"), ("r", "recall_at")) for k in K.TOP_SHARES])
    out = null_safe_join(out, tops, by)

    def four(name: str, alias: str | None = None):
        return rounded(F.col(name), 4).alias(alias or name)

    return out.select(
        *by, "n_train", F.col("n").alias("n_test"), four("prevalence"), four("roc_auc", "auc"), four("auc_ci_low"),
        four("auc_ci_high"), four("baseline_recency_auc"), four("brier_score", "brier"), four("brier_skill_score"),
        four("ks_statistic", "ks"), four("f1"), four("precision"), four("tpr", "recall"),
        rounded(F.col("calib_slope"), 3).alias("calib_slope"), rounded(F.col("calib_intercept"), 3).alias("calib_intercept"),
        four("ece"), *[four(f"{s}_at_{k}") for s in ("p", "r") for k in K.TOP_SHARES],
    ).orderBy("test_period")


def incremental_training(rows: DataFrame, cutoffs: Sequence[str], test: str, fit: Fit,
                         replicates: int = K.BOOTSTRAP_REPLICATES) -> DataFrame:
    """AUC with interval on one test period as the training history grows."""
    pairs = [(c, test) for c in cutoffs]
    return incremental_table(scored_pairs(rows, pairs, fit), rows, pairs, replicates)


def incremental_table(scored: DataFrame, rows: DataFrame, pairs: Sequence[tuple[str, str]],
                      replicates: int = K.BOOTSTRAP_REPLICATES) -> DataFrame:
    """``incremental_training`` from the stored scores of every cutoff."""
    by = ["origin", "test_period"]
    out = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("n_test"))
    out = null_safe_join(out, train_sizes(rows, pairs), by)
    out = null_safe_join(out, ME.roc_auc(scored, by), by)
    out = null_safe_join(out, RS.bootstrap_interval(scored, replicates, by=by), by)
    return out.select(
        F.col("origin").alias("train_cutoff"), "test_period", "n_train", "n_test",
        *[rounded(F.col(c), 4).alias(c) for c in ("auc", "auc_ci_low", "auc_ci_high")]).orderBy("train_cutoff")


def unseen_students(rows: DataFrame, test: str, fit: Fit, horizon: int = K.LABEL_HORIZON,
                    replicates: int = K.BOOTSTRAP_REPLICATES) -> DataFrame:
    """AUC on known and new students, and with the test students removed from training."""
    return unseen_table(unseen_scores(rows, test, fit, horizon), rows, test, horizon, replicates)


def unseen_scores(rows: DataFrame, test: str, fit: Fit, horizon: int = K.LABEL_HORIZON) -> DataFrame:
    """Test rows scored by the model of all training rows (full) and of other students only (grouped), stored."""
    cutoff = P.shift_label(test, horizon)
    train, tested = _upto(rows, cutoff), _at(rows, test)
    strict = SP.without_students_of(train, tested)
    tags = {cutoff: train, f"{cutoff}-strict": strict}
    models = concurrently(rows.sparkSession, {tag: partial(fit, part, tag) for tag, part in tags.items()})
    full = MO.score(models[cutoff], SP.mark_seen(tested, train))
    apart = MO.score(models[f"{cutoff}-strict"], SP.mark_seen(tested, train))
    columns = [F.col("legajo").alias("id"), F.col("dropout_next").alias("y"), "p", "seen"]
    both = full.select(F.lit("full").alias("kind"), *columns).unionByName(
        apart.select(F.lit("grouped").alias("kind"), *columns))
    return materialise(both, "unseen")


def unseen_table(stored: DataFrame, rows: DataFrame, test: str, horizon: int = K.LABEL_HORIZON,
                 replicates: int = K.BOOTSTRAP_REPLICATES) -> DataFrame:
    """``unseen_students`` from the stored scores."""
    cutoff = P.shift_label(test, horizon)
    train = _upto(rows, cutoff)
    strict = SP.without_students_of(train, _at(rows, test))
    whole = ME.roc_auc(stored, ["kind"])
    parts = ME.roc_auc(stored.where("kind = 'full'"), ["seen"]).select(
        F.when(F.col("seen"), "seen").otherwise("new").alias("kind"), "auc")
    ci = RS.bootstrap_interval(stored.where("kind = 'grouped'"), replicates).select(F.struct("*").alias("s")).scalar()
    pick = lambda k: F.max(F.when(F.col("kind") == k, F.col("auc")))
    aucs = whole.unionByName(parts).agg(*[pick(k).alias(f"auc_{k}") for k in ("full", "seen", "new", "grouped")])
    sizes = stored.where("kind = 'full'").agg(
        F.count(F.lit(1)).alias("n_test"), F.count_if("seen").alias("n_test_seen"),
        F.count_if(~F.col("seen")).alias("n_test_new")).select(F.struct("*").alias("s")).scalar()
    n_full = train.agg(F.count(F.lit(1))).scalar()
    n_strict = strict.agg(F.count(F.lit(1))).scalar()
    wide = aucs.select("*", sizes.alias("_s"), ci.alias("_c"), n_full.alias("n_train_full"),
                       n_strict.alias("n_train_grouped"))
    four = lambda c, a: rounded(c, 4).alias(a)
    return wide.select(
        F.lit(test).alias("test_period"), F.lit(cutoff).alias("train_cutoff"), "_s.n_test", "_s.n_test_seen",
        "_s.n_test_new", *[four(F.col(f"auc_{k}"), f"auc_{k}") for k in ("full", "seen", "new")], "n_train_full",
        "n_train_grouped", four(F.col("auc_grouped"), "auc_grouped"),
        four(F.col("_c.auc_ci_low"), "auc_grouped_ci_low"), four(F.col("_c.auc_ci_high"), "auc_grouped_ci_high"))


ABLATIONS = {
    "completo": K.NUMERIC_FEATURES,
    "sin dias_desde_ult_actividad": tuple(c for c in K.NUMERIC_FEATURES if c != K.RECENCY_FEATURE),
    "sin recencia inmediata": tuple(c for c in K.NUMERIC_FEATURES if c not in K.IMMEDIATE_RECENCY),
}


BASELINE = "baseline recencia (solo dias)"
ABLATION_SCORES = dict(zip([*ABLATIONS, BASELINE], ["p_full", "p_no_days", "p_no_recency", "p_base"]))


def ablation_scores(train: DataFrame, test: DataFrame, fit_with: Callable[[DataFrame, tuple[str, ...], str], PipelineModel]
                    ) -> DataFrame:
    """Test rows with one score column per variant, the recency baseline and the linear model."""
    rows = fan_out(ME.recency_scores(test, out="p_base"))  # spread once for all models
    jobs = {ABLATION_SCORES[v]: partial(fit_with, train, f, "GradientBoosting") for v, f in ABLATIONS.items()}
    jobs["p_linear"] = partial(fit_with, train, K.NUMERIC_FEATURES, "LogisticRegression")
    return materialise(MO.scored(rows, concurrently(train.sparkSession, jobs)).select(
        F.col("legajo").alias("id"), F.col("dropout_next").alias("y"), *jobs, "p_base"), "ablation")


def ablation_table(scores: DataFrame) -> DataFrame:
    """AUC and precision among the top tenth per variant."""
    long = several_scores(scores.drop("p_linear"), ABLATION_SCORES, "variante")
    n = F.when(F.col("variante") == BASELINE, 1)
    for v, f in ABLATIONS.items():
        n = n.when(F.col("variante") == v, len(f) + 1)
    top = ME.top_share(long, ["variante"], shares=(10,), at_least_one=True)
    return ME.roc_auc(long, ["variante"]).join(top, "variante").select(
        "variante", n.alias("n_features"), rounded(F.col("auc"), 4).alias("auc"),
        rounded(F.col("precision_at"), 4).alias("p_at_10"))


PAIRS = (("completo  −  baseline recencia", "p_full", "p_base"),
         ("completo  −  sin recencia inmediata", "p_full", "p_no_recency"),
         ("GBM completo  −  LogisticRegression", "p_full", "p_linear"))


def paired_table(scores: DataFrame, replicates: int = K.PAIRED_REPLICATES) -> DataFrame:
    """Paired bootstrap of the three published comparisons."""
    out = None
    for name, first, second in PAIRS:
        row = RS.paired_difference(scores, first, second, replicates).select(
            F.lit(name).alias("comparacion"), *[rounded(F.col(c), 4).alias(c) for c in ("delta", "ci_low", "ci_high", "p_gt_0")])
        out = row if out is None else out.unionByName(row)
    return out


def permutation_importance(model: PipelineModel, test: DataFrame, features: Sequence[str], repeats: int = K.PERMUTATION_REPEATS,
                           key: str = "legajo", label: str = "dropout_next", seed: int = K.SEED) -> DataFrame:
    """Mean and deviation of the AUC drop when one feature is shuffled over the rows.

    Rows are numbered once and once more per repeat in another hash order; equal
    numbers exchange values. All (feature, repeat) copies are scored in one job.
    """
    return permutation_table(permuted_scores(model, test, features, repeats, key, label, seed))


def permuted_scores(model: PipelineModel, test: DataFrame, features: Sequence[str], repeats: int = K.PERMUTATION_REPEATS,
                    key: str = "legajo", label: str = "dropout_next", seed: int = K.SEED) -> DataFrame:
    """(feature, repeat, y, p, n) of all shuffled copies, stored; the untouched rows have an empty feature.

    ``n`` copies with equal features and label are scored once, over all repeats of a feature.
    """
    features = list(features)
    rows = test.select(F.col(key).alias("_id"), F.col(label).alias("_y"), *features)
    bucket = F.conv(F.substring("_h", 1, 4), 16, 10).cast("int")

    def placed(df: DataFrame, by: list[str], salt) -> DataFrame:
        keyed = df.select("*", F.md5(F.concat_ws("|", salt, F.col("_id").cast("string"))).alias("_h"), F.lit(1).alias("_n"))
        return running_totals(keyed, by, "_h", ["_n"], within=["_id"], bucket=bucket).withColumnRenamed("before__n", "_place")

    base = placed(rows, [], F.lit(str(seed))).select("_place", "_y", *features)
    repeated = rows.select(*["_id", *features], F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat"))
    donors = placed(repeated, ["repeat"], F.concat_ws("-", F.lit(str(seed)), F.col("repeat").cast("string"))).select(
        "_place", "repeat", *[F.col(f).alias(f"d_{f}") for f in features])
    met = fan_out(base.join(donors, "_place"))  # each row turns into one per feature
    copies = F.array(*[
        F.struct(F.lit(f).alias("feature"), *[F.col(f"d_{g}" if g == f else g).alias(g) for g in features]) for f in features
    ])
    shuffled = met.select("repeat", F.col("_y").alias("y"), F.inline(copies))
    untouched = base.select(F.lit(0).alias("repeat"), F.col("_y").alias("y"), F.lit("").alias("feature"), *features)
    turns = range(repeats + 1)
    equal = shuffled.unionByName(untouched).groupBy("feature", "y", *features).agg(
        *[F.count_if(F.col("repeat") == r).alias(f"_n{r}") for r in turns])
    scored = MO.score(model, equal)
    counts = F.filter(F.array(*[F.struct(F.lit(r).alias("repeat"), F.col(f"_n{r}").alias("n")) for r in turns]), lambda c: c["n"] > 0)
    return materialise(scored.select("feature", "y", "p", F.inline(counts)), "permuted")


def permutation_table(scored: DataFrame) -> DataFrame:
    """``permutation_importance`` from the stored scores."""
    aucs = ME.roc_auc(scored, ["feature", "repeat"], weight="n")
    whole = aucs.where("feature = ''").select("auc").scalar()
    return aucs.where("feature <> ''").withColumn("_drop", whole - F.col("auc")).groupBy("feature").agg(
        rounded(F.avg("_drop"), 4).alias("caida_auc_media"), rounded(F.stddev_pop("_drop"), 4).alias("std"),
    ).orderBy(F.desc("caida_auc_media"), "feature")


def versions_scored(models: dict[str, PipelineModel], val: DataFrame) -> DataFrame:
    """The same validation rows scored by several stored models."""
    out = None
    for version, model in models.items():
        part = MO.score(model, val).select(
            F.lit(version).alias("version"), PERIOD, F.col("legajo").alias("id"), F.col("dropout_next").alias("y"), "p")
        out = part if out is None else out.unionByName(part)
    return materialise(out, "versions")


def version_sizes(rows: DataFrame, cutoffs: Sequence[str]) -> DataFrame:
    """Training rows of each version, which is named by its cutoff: one pass for all versions."""
    tags = F.array(*[F.when(F.col(PERIOD) <= c, F.lit(c)) for c in cutoffs])
    return rows.select(F.explode(F.array_compact(tags)).alias("version")).groupBy("version").agg(
        F.count(F.lit(1)).alias("train_size"))


def version_summary(scored: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Ranking, the figures of both classes, sizes and validation periods per model version."""
    by, zero = ["version"], F.lit(0.0)
    flat = ME.threshold_metrics(scored, by)
    periods = scored.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_set(PERIOD)), ", ").alias("val_periods"))
    both = null_safe_join(null_safe_join(ME.ranking_metrics(scored, by), flat, by), periods, by)
    if sizes is not None:
        both = null_safe_join(both, sizes, by, "left")
    tn, fn, fp = F.col("tn"), F.col("fn"), F.col("fp")
    f1_0 = F.coalesce(ratio(2 * tn, 2 * tn + fn + fp), zero)
    return both.select(
        "version", "n", "prevalence", "roc_auc", "pr_auc", "average_precision", "accuracy", "f1", "precision",
        F.col("tpr").alias("recall"), f1_0.alias("f1_0"), F.coalesce(ratio(tn, tn + fn), zero).alias("precision_0"),
        F.coalesce(ratio(tn, tn + fp), zero).alias("recall_0"), ((F.col("f1") + f1_0) / 2).alias("f1_macro"),
        (F.col("train_size") if sizes is not None else F.lit(None).cast("long")).alias("train_size"), "val_periods").orderBy("version")


def labelled_rows(rows: DataFrame, label: str) -> DataFrame:
    """At-risk rows with a value of one label definition, which becomes the label."""
    return rows.where((F.col("at_risk") == 1) & F.col(label).isNotNull()).withColumn("dropout_next", F.col(label))


def label_evaluation(rows: DataFrame, label: str, cutoff: str, test: str, fit: Fit) -> DataFrame:
    """Size, prevalence and quality of a model trained and tested on one label definition."""
    known = labelled_rows(rows, label)
    return label_table(label_scores(known, label, cutoff, test, fit), known, cutoff)


def label_scores(known: DataFrame, label: str, cutoff: str, test: str, fit: Fit) -> DataFrame:
    """Test rows scored by the model of one label definition, stored."""
    model = fit(_upto(known, cutoff), f"{cutoff}-{label}")
    return materialise(MO.score(model, _at(known, test)).select(
        F.lit(label).alias("etiqueta"), F.col("legajo").alias("id"), F.col("dropout_next").alias("y"), "p"), "label_eval")


def label_table(scored: DataFrame, known: DataFrame, cutoff: str) -> DataFrame:
    """``label_evaluation`` from the stored scores of one label definition."""
    sizes = known.agg(
        F.count(F.lit(1)).alias("n_filas_etiquetadas"), F.count_if(F.col(PERIOD) <= cutoff).alias("n_train"),
        F.avg("dropout_next").alias("prevalencia_global")).select(F.struct("*").alias("s")).scalar()
    by = ["etiqueta"]
    flat = ME.threshold_metrics(scored, by).join(ME.roc_auc(scored, by), by).join(
        ME.top_share(scored, by, shares=(10,), at_least_one=True), by).withColumn("_s", sizes)
    return flat.select(
        "etiqueta", "_s.n_filas_etiquetadas", "_s.n_train", F.col("n").alias("n_test"),
        rounded(F.col("_s.prevalencia_global"), 4).alias("prevalencia_global"),
        rounded(F.col("prevalence"), 4).alias("prevalencia_test"), rounded(F.col("auc"), 4).alias("auc"),
        rounded(F.col("brier_score"), 4).alias("brier"), rounded(F.col("precision_at"), 4).alias("p_at_10"))
