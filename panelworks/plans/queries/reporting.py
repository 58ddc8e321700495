"""Splits, features, scoring, subgroups and the reporting queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelworks import constants as K
from panelworks.operators import evaluation as EV
from panelworks.operators import fairness as FA
from panelworks.operators import features as FE
from panelworks.operators import metrics as ME
from panelworks.operators import reports as RP
from panelworks.operators import scoring as SC
from panelworks.operators import splits as SP
from panelworks.plans import fixtures as X
from panelworks.plans import marts as M
from panelworks.plans import scores as S
from panelworks.plans.oracle import with_ctes
from panelworks.plans.queries.common import r6
from panelworks.plans.queries.metrics import _BIN_LEFT, _CONF, _RANK, histogram_sql, newton_ctes, top_sql
from panelworks.plans.queries.monitor import CYCLES, DRIFT_SELECT, cycle_drift_sql, stored_drift
from panelworks.session import scratch_path
from panelworks.sources import sinks as SK

TESTS = ("1997_2C", "1998_1C", "1998_2C", "1999_1C")
_FEATS = K.NUMERIC_FEATURES


# splits

def spl_01(s, d):
    rows = SP.modelling_rows(M.panel(s, d).unionByName(M.panel(s, d)))
    return r6(rows.select("legajo", "academic_period", "nota_win3", "promo_rate_win3", "dropout_next"),
              ["nota_win3", "promo_rate_win3"])


def spl_02(s, d):
    return SP.embargo_split(M.modelled(s, d)).select("legajo", "academic_period", "split")


def spl_02_bounds(s, d):
    return SP.embargo_bounds(M.modelled(s, d))


def spl_03(s, d):
    train = SP.embargo_split(M.modelled(s, d)).where("split = 'train'")
    return SP.stratified_sample(train, 0.15).select("legajo", "academic_period", "dropout_next")


def spl_04(s, d):
    rows = SP.tagged_splits(M.modelled(s, d), SP.origins(TESTS))
    return r6(rows.groupBy("origin", "test_period", "split").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dropout_next").alias("prevalence")), ["prevalence"])


def spl_05(s, d):
    pairs = [(o, TESTS[-1]) for o, _ in SP.origins(TESTS)]
    rows = SP.tagged_splits(M.modelled(s, d), pairs)
    return rows.groupBy("origin", "test_period", "split").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("legajo").alias("n_students"))


def _train_test(s, d):
    rows = M.modelled(s, d)
    return rows.where(F.col("academic_period") <= X.CUTOFF), rows.where(F.col("academic_period") == TESTS[-1])


def spl_06(s, d):
    train, test = _train_test(s, d)
    seen = SP.mark_seen(test, train).groupBy(F.lit("test").alias("part"), "seen").agg(F.count(F.lit(1)).alias("n"))
    strict = SP.without_students_of(train, test).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("strict_train").alias("part"), F.lit(False).alias("seen"), "n")
    return seen.unionByName(strict)


def spl_07(s, d):
    latest = M.history(s, d).agg(F.max("academic_period").alias("academic_period")).select(
        F.lit("cycle").alias("kind"), "academic_period")
    staged = SP.distinct_periods(X.history(s, d)).select(F.lit("staged").alias("kind"), "academic_period")
    train, _ = _train_test(s, d)
    trained = SP.distinct_periods(train).select(F.lit("train").alias("kind"), "academic_period")
    return latest.unionByName(staged).unionByName(trained)


# features

def fea_01(s, d):
    train, _ = _train_test(s, d)
    return r6(FE.numeric_parameters(train).select("feature", "n", "n_known", "median"), ["median"])


def fea_02(s, d):
    train, _ = _train_test(s, d)
    return r6(FE.numeric_parameters(train).select("feature", "mean", "scale"), ["mean", "scale"])


def fea_03(s, d):
    return FE.most_frequent(_train_test(s, d)[0])


def fea_apply(s, d):
    """Test rows imputed and scaled with parameters fitted on the training rows."""
    train, test = _train_test(s, d)
    names = ("nota_win3", "promo_rate_win3", "dias_desde_ult_actividad")
    out = FE.Preparation.fit(train, names).apply(test)
    return r6(out.select("legajo", "x_category", *[f"x_{n}" for n in names]), [f"x_{n}" for n in names])


# scoring

def sco_01(s, d):
    return SC.active_students(M.status(s, d))


def sco_02(s, d):
    rows = SC.latest_risk_rows(M.panel(s, d), SC.active_students(M.status(s, d)))
    return r6(rows, ["nota_media_en_periodo", "nota_win3", "promo_rate_period", "promo_rate_win3"])


def sco_04(s, d):
    return r6(SC.scoring_summary(S.predictions(s, d)), ["dropout_rate", "avg_dropout_probability"])


def sco_05(s, d):
    return SC.latest_predictions(S.predictions(s, d))


def mod_05(s, d):
    return r6(EV.evaluations(S.model_scores(s, d)),
              ["roc_auc", "brier_score", "average_precision", "ks_statistic", "f1_dropout", "precision_dropout",
               "recall_dropout"])


# subgroups

def fai_01(s, d):
    return FA.demographics(M.students(s, d), X.COHORTS)


def _subgroups(s, d):
    demo = FA.demographics(M.students(s, d), X.COHORTS).withColumnRenamed("legajo", "id")
    rows = S.panel_scores(s, d).join(demo, "id", "left")
    return FA.by_attribute(rows, {"sexo": "Sexo", "cohorte": "Cohorte de ingreso", "grupo_edad": "Edad al ingreso",
                                  "cod_carrera": "Carrera"})


def fai_02(s, d):
    return FA.subgroup_metrics(_subgroups(s, d))


def _programme_auc(s, d):
    return r6(ME.metrics_by(S.panel_scores(s, d), ["cod_carrera"]).select(
        F.col("cod_carrera").alias("valor"), "n", "auc"), ["auc"])


def fai_03_spread(s, d):
    return r6(FA.auc_spread(_programme_auc(s, d)), ["auc_min", "auc_max", "auc_range"])


def fai_03_extremes(s, d):
    return FA.auc_extremes(_programme_auc(s, d))


# reports

def rep_01(s, d):
    return RP.table_counts(s, {
        "history": M.history(s, d), "students": M.students(s, d), "progress": M.progress(s, d),
        "status": M.status(s, d), "panel": M.panel(s, d), "predictions": "absent_table_of_predictions"})


def rep_08(s, d):
    return r6(RP.completions_by_programme(M.status(s, d), M.progress(s, d)), ["avance_promedio"])


def rep_15(s, d):
    out = RP.score_bands(S.predictions(s, d))
    return r6(out, [c for c in out.columns if not c.startswith("n_")])


def rep_18(s, d):
    """Against the raw deliveries, so the last delivery of a student differs."""
    return RP.completed_activity(X.history(s, d), M.progress(s, d), 60, X.ACTIVITY_BUCKETS)


def rep_24(s, d):
    return r6(RP.listwise_correlation(M.modelled(s, d)), ["corr"])


_STATS = ["media", "mediana", "std", "p90", "corr"]


def rep_22(s, d):
    rows = M.modelled(s, d).where(F.col("academic_period") > X.CUTOFF)
    return r6(RP.feature_statistics(rows), _STATS)


def rep_23(s, d):
    return r6(RP.feature_statistics(M.modelled(s, d), positive_only=True).drop("corr"), _STATS[:-1])


def rep_26(s, d):
    rows = RP.melt(M.modelled(s, d), [], K.REPORT_FEATURES).where(F.col("value") > 0)
    return r6(ME.value_histogram(rows, "value", 28, ["feature"]), ["bin_low", "density"])


_EVAL = ["roc_auc", "brier_score", "average_precision", "ks_statistic", "f1_dropout", "precision_dropout", "recall_dropout"]


def rep_27_leaderboard(s, d):
    return r6(RP.leaderboard(EV.evaluations(S.model_scores(s, d)), "1998_2C"), _EVAL)


def rep_27_winners(s, d):
    return r6(RP.winners(EV.evaluations(S.model_scores(s, d))).select("cycle_period", "model_name", "roc_auc"), ["roc_auc"])


def rep_28(s, d):
    return r6(RP.drift_report(stored_drift(s, d), CYCLES[-1]), ["psi_value", "mean_reference", "mean_current"])


def rep_29(s, d):
    return RP.cycles(stored_drift(s, d))


def drf_10(s, d):
    return r6(RP.psi_evolution(stored_drift(s, d)), ["psi_max"])


def rep_30_models(s, d):
    evals = r6(EV.evaluations(S.model_scores(s, d)), _EVAL)
    out = RP.selection_summary(evals)
    return out.select("cycle_period", "winner", "winner_auc", "winner_ks", F.concat_ws(
        ";", F.transform("candidates", lambda c: F.concat_ws(":", c["model_name"], c["val_size"].cast("string"))),
    ).alias("candidates"))


def rep_30_drift(s, d):
    out = r6(RP.drift_summary_nested(stored_drift(s, d)), ["psi_max"])
    return out.withColumn("features", F.concat_ws(",", F.transform("features", lambda f: f["feature_name"])))


_CANDIDATE = ("model_name", "roc_auc", "brier_score", "ks_statistic", "f1_dropout", "precision_dropout", "recall_dropout",
              "val_size", "is_selected_model")


def rep_30_model_documents(s, d):
    """One JSON document per cycle, written, read back with its schema, and taken apart again."""
    evals = r6(EV.evaluations(S.model_scores(s, d)), _EVAL).select("cycle_period", *_CANDIDATE)
    summary = RP.selection_summary(evals)
    path = scratch_path(s, "model-documents")
    SK.write_documents(summary, path, "cycle_period")
    back = SK.read_documents(s, path, T.StructType([*summary.schema.fields, T.StructField("version", T.StringType())]))
    return back.select("version", "cycle_period", "winner", "winner_auc", "winner_ks", F.posexplode("candidates").alias("place", "c")).select(
        "version", "cycle_period", "winner", "winner_auc", "winner_ks", F.col("place").cast("long").alias("place"),
        *[F.col(f"c.{c}").alias(c) for c in _CANDIDATE])


def rep_30_drift_documents(s, d):
    """The same for the drift of every cycle."""
    summary = RP.drift_summary_nested(stored_drift(s, d))
    path = scratch_path(s, "drift-documents")
    SK.write_documents(summary, path, "cycle_period")
    back = SK.read_documents(s, path, T.StructType([*summary.schema.fields, T.StructField("version", T.StringType())]))
    rows = back.select("version", "psi_max", "n_high", "n_moderate", "n_none", F.posexplode("features").alias("place", "f"))
    out = rows.select("version", "psi_max", "n_high", "n_moderate", "n_none", F.col("place").cast("long").alias("place"), "f.*")
    return r6(out, ["psi_max", "psi_value", "mean_reference", "mean_current"])


def _simple(fn, *tables, doubles=(), raw=False):
    def query(s, d):
        source = {"history": M.history, "students": M.students, "progress": M.progress, "status": M.status,
                  "panel": M.panel, "raw_history": X.history, "preds": S.predictions}
        out = fn(*[source[t](s, d) for t in tables])
        return r6(out, doubles) if doubles else out

    return query


# SQL
_SPLIT = "CASE WHEN academic_period <= '1997_1C' THEN 'train' ELSE 'val' END"
_PAIRS = "(VALUES ('1995_2C', '1997_2C'), ('1996_1C', '1998_1C'), ('1996_2C', '1998_2C'), ('1997_1C', '1999_1C'))"
_FIXED = "(VALUES ('1995_2C', '1999_1C'), ('1996_1C', '1999_1C'), ('1996_2C', '1999_1C'), ('1997_1C', '1999_1C'))"
_TRAIN = {"tr": "SELECT * FROM modelled WHERE academic_period <= '1997_1C'",
          "te": "SELECT * FROM modelled WHERE academic_period = '1999_1C'"}


def _each(template: str, names) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in names)


_MED = "(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM tr)"
_STAT = """
    SELECT '{c}' AS feature, count(*) AS n, round(avg(v), 6) AS media, round(stddev_samp(v), 6) AS std,
      round(quantile_cont(v, 0.5), 6) AS mediana, round(quantile_cont(v, 0.9), 6) AS p90
      #CORR# FROM (SELECT CAST({c} AS DOUBLE) AS v, CAST(dropout_next AS DOUBLE) AS y FROM modelled WHERE #COND#) z
    WHERE v IS NOT NULL"""
_EVALS = {
    "hist": "SELECT cycle_period, model_name, p, sum(y) AS pos, sum(1 - y) AS neg FROM model_scores GROUP BY 1, 2, 3",
    "cum": """
        SELECT *, sum(pos) OVER g AS ap, sum(neg) OVER g AS an, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM hist
        WINDOW g AS (PARTITION BY cycle_period, model_name), w AS (PARTITION BY cycle_period, model_name ORDER BY p DESC
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "rank_m": """
        SELECT cycle_period, model_name, sum(pos * (an - fp + neg / 2.0)) / nullif(max(ap)::DOUBLE * max(an), 0) AS roc_auc,
          sum(pos::DOUBLE / ap * tp / (tp + fp)) AS average_precision,
          max(abs(tp::DOUBLE / ap - fp::DOUBLE / an)) AS ks_statistic FROM cum GROUP BY 1, 2""",
    "conf": _CONF.format(g="cycle_period, model_name", t="model_scores"),
    "evals": """
        SELECT r.cycle_period, r.model_name, round(roc_auc, 6) AS roc_auc, round(brier, 6) AS brier_score,
          round(average_precision, 6) AS average_precision, round(ks_statistic, 6) AS ks_statistic,
          round(coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_dropout,
          round(coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0), 6) AS precision_dropout,
          round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0), 6) AS recall_dropout, n AS val_size,
          row_number() OVER (PARTITION BY r.cycle_period ORDER BY roc_auc DESC NULLS LAST, r.model_name) = 1
            AS is_selected_model
        FROM rank_m r JOIN conf c ON c.cycle_period = r.cycle_period AND c.model_name = r.model_name""",
}
_SUB = {
    "lng": _each("SELECT s.id, s.y, s.p, '{c}' AS attr, CAST(s.{c} AS VARCHAR) AS valor FROM sd s WHERE {c} IS NOT NULL",
                 ("sexo", "cohorte", "grupo_edad", "cod_carrera")),
    "keyed": """SELECT id, y, p, valor, CASE attr WHEN 'sexo' THEN 'Sexo' WHEN 'cohorte' THEN 'Cohorte de ingreso'
        WHEN 'grupo_edad' THEN 'Edad al ingreso' ELSE 'Carrera' END AS atributo,
        attr || '|' || valor AS grp FROM lng""",
    "conf": _CONF.format(g="atributo, valor, grp", t="keyed"),
    "auc": _RANK.format(t="keyed"),
    "tops": top_sql("keyed", "grp", "(10)", 1),
    "ecal": f"""SELECT grp, sum(gap) / sum(n) AS ece FROM (SELECT grp, {_BIN_LEFT} AS b, count(*) AS n,
        abs(avg(y) - avg(p)) * count(*) AS gap FROM keyed GROUP BY 1, 2) z GROUP BY 1""",
    **newton_ctes("keyed", "grp"),
}
_BANDS = """
    SELECT count(*) AS n_total, count(*) FILTER (WHERE p >= 0.7) AS n_high, count(*) FILTER (WHERE p >= 0.5 AND p < 0.7) AS n_med,
      count(*) FILTER (WHERE p < 0.5) AS n_low, avg(p) AS media, stddev_samp(p) AS std, quantile_cont(p, 0.5) AS mediana,
      quantile_cont(p, 0.1) AS p10, quantile_cont(p, 0.25) AS p25, quantile_cont(p, 0.75) AS p75, quantile_cont(p, 0.9) AS p90
    FROM (SELECT dropout_probability AS p FROM preds) z"""
_LOOSE = r"regexp_matches(porcentaje_avance, '^[0-9,\.]+$')"
_NUM = "try_cast(replace(porcentaje_avance, ',', '.') AS DOUBLE)"
_BEST = f"SELECT legajo, max({_NUM}) AS v FROM progress WHERE {_LOOSE} GROUP BY 1"


def _pivot_sql(key: str, source: str) -> str:
    return f"""
        SELECT {key}, a AS "abandonó", e AS estudiando, f AS finalizacion_estimada, a + e + f AS total,
          round(a * 100.0::DOUBLE / nullif(a + e + f, 0), 6) AS "pct_abandonó",
          round(e * 100.0::DOUBLE / nullif(a + e + f, 0), 6) AS pct_estudiando,
          round(f * 100.0::DOUBLE / nullif(a + e + f, 0), 6) AS pct_finalizacion_estimada
        FROM (SELECT {key}, count(*) FILTER (WHERE status = 'abandonó') AS a,
                count(*) FILTER (WHERE status = 'estudiando') AS e,
                count(*) FILTER (WHERE status = 'finalizacion_estimada') AS f FROM ({source}) q GROUP BY 1) z"""


_PCTS = tuple(f"pct_{c}" for c in (K.STATUS_LEFT, K.STATUS_ACTIVE, K.STATUS_DONE))


def _by_programme_sql(least: int, top: int) -> str:
    return with_ctes(f"""
        SELECT cod_carrera, n AS total, CAST(a AS BIGINT) AS abandonos, round(a * 100.0::DOUBLE / n, 6) AS tasa FROM (
          SELECT cod_carrera, count(*) AS n, sum(dropout_next) AS a FROM (
            SELECT *, row_number() OVER (PARTITION BY legajo, cod_carrera ORDER BY academic_period DESC) AS r
            FROM modelled WHERE cod_carrera IS NOT NULL) z WHERE r = 1 GROUP BY 1 HAVING count(*) >= {least}
          ORDER BY n DESC, cod_carrera LIMIT {top}) q""")


def _anomaly_sql(least: int) -> str:
    return with_ctes(f"""
        SELECT coalesce(status, 'total') AS status, count(*) AS n FROM status JOIN progress USING (legajo)
        WHERE {_LOOSE} AND {_NUM} >= {least} AND status <> 'finalizacion_estimada' GROUP BY ROLLUP (status)""")


QUERIES = {
    "spl_01_modelling_rows": (spl_01, with_ctes("""
        SELECT legajo, academic_period, round(nota_win3, 6) AS nota_win3, round(promo_rate_win3, 6) AS promo_rate_win3,
          dropout_next FROM modelled""")),
    "spl_02_embargo_split": (spl_02, with_ctes("""
        SELECT legajo, academic_period, CASE WHEN academic_period = val_period THEN 'val' ELSE 'train' END AS split
        FROM modelled, cut WHERE academic_period = val_period OR academic_period <= train_cutoff""")),
    "spl_02_embargo_bounds": (spl_02_bounds, with_ctes("SELECT val_period, train_cutoff FROM cut")),
    "spl_03_stratified_sample": (spl_03, with_ctes("""
        SELECT legajo, academic_period, dropout_next FROM (
          SELECT *, row_number() OVER (PARTITION BY dropout_next ORDER BY md5('42|' || legajo || '|' || academic_period)) AS r,
            count(*) OVER (PARTITION BY dropout_next) AS n FROM modelled, cut WHERE academic_period <= train_cutoff) z
        WHERE r <= floor(n * 0.15 + 0.5)""")),
    "spl_04_rolling_origin": (spl_04, with_ctes(f"""
        SELECT origin, test_period, CASE WHEN academic_period = test_period THEN 'test' ELSE 'train' END AS split,
          count(*) AS n, round(avg(dropout_next), 6) AS prevalence
        FROM modelled, {_PAIRS} v(origin, test_period)
        WHERE academic_period = test_period OR academic_period <= origin GROUP BY 1, 2, 3""")),
    "spl_05_incremental": (spl_05, with_ctes(f"""
        SELECT origin, test_period, CASE WHEN academic_period = test_period THEN 'test' ELSE 'train' END AS split,
          count(*) AS n, count(DISTINCT legajo) AS n_students FROM modelled, {_FIXED} v(origin, test_period)
        WHERE academic_period = test_period OR academic_period <= origin GROUP BY 1, 2, 3""")),
    "spl_06_seen_new": (spl_06, with_ctes("""
        SELECT 'test' AS part, legajo IN (SELECT legajo FROM tr) AS seen, count(*) AS n FROM te GROUP BY 1, 2
        UNION ALL SELECT 'strict_train', false, count(*) FROM tr WHERE legajo NOT IN (SELECT legajo FROM te)""", **_TRAIN)),
    "spl_07_versions": (spl_07, with_ctes("""
        SELECT 'cycle' AS kind, max(academic_period) AS academic_period FROM history
        UNION ALL SELECT 'staged', academic_period FROM (SELECT DISTINCT academic_period FROM fx_history) a
        UNION ALL SELECT 'train', academic_period FROM (SELECT DISTINCT academic_period FROM tr) b""", **_TRAIN)),
    "fea_01_median": (fea_01, with_ctes(_each(
        "SELECT '{c}' AS feature, count(*) AS n, count({c}) AS n_known, "
        "round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS median FROM tr", _FEATS), **_TRAIN)),
    "fea_02_scale": (fea_02, with_ctes(_each(
        "SELECT '{c}' AS feature, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS scale FROM ("
        "SELECT coalesce(CAST({c} AS DOUBLE), " + _MED + ") AS v FROM tr) z", _FEATS), **_TRAIN)),
    "fea_03_most_frequent": (fea_03, with_ctes("""
        SELECT cod_carrera, count(*) AS n FROM tr WHERE cod_carrera IS NOT NULL GROUP BY 1
        ORDER BY n DESC, cod_carrera LIMIT 1""", **_TRAIN)),
    "fea_prepared_rows": (fea_apply, with_ctes("SELECT legajo, x_category, " + ", ".join(
        f"round((coalesce(CAST({c} AS DOUBLE), {_MED.format(c=c)}) - m_{c}) / s_{c}, 6) + 0.0 AS x_{c}"
        for c in ("nota_win3", "promo_rate_win3", "dias_desde_ult_actividad")) + """
        FROM (SELECT *, coalesce(cod_carrera, (SELECT cod_carrera FROM tr GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))
                AS x_category FROM te) t, pars""", **_TRAIN, pars="SELECT " + ", ".join(
        f"avg(coalesce(CAST({c} AS DOUBLE), {_MED.format(c=c)})) AS m_{c}, "
        f"stddev_pop(coalesce(CAST({c} AS DOUBLE), {_MED.format(c=c)})) AS s_{c}"
        for c in ("nota_win3", "promo_rate_win3", "dias_desde_ult_actividad")) + " FROM tr")),
    "sco_01_active": (sco_01, with_ctes("SELECT legajo FROM status WHERE status = 'estudiando'")),
    "sco_02_latest_rows": (sco_02, with_ctes("""
        SELECT * REPLACE (round(nota_media_en_periodo, 6) AS nota_media_en_periodo, round(nota_win3, 6) AS nota_win3,
          round(promo_rate_period, 6) AS promo_rate_period, round(promo_rate_win3, 6) AS promo_rate_win3)
        FROM latest_rows""")),
    "sco_04_summary": (sco_04, with_ctes("""
        SELECT count(*) AS total_students, CAST(sum(dropout_prediction) AS BIGINT) AS predicted_dropouts,
          round(avg(dropout_prediction), 6) AS dropout_rate, round(avg(dropout_probability), 6) AS avg_dropout_probability
        FROM preds""")),
    "sco_05_latest_predictions": (sco_05, with_ctes("""
        SELECT legajo, academic_period, cod_carrera, dropout_prediction, dropout_probability,
          CASE WHEN dropout_probability >= 0.8 THEN 'Muy Alto' WHEN dropout_probability >= 0.6 THEN 'Alto'
               WHEN dropout_probability >= 0.4 THEN 'Medio' WHEN dropout_probability >= 0.2 THEN 'Bajo'
               ELSE 'Muy Bajo' END AS risk_level, prediction_date, model_version
        FROM preds p WHERE prediction_date = (SELECT max(q.prediction_date) FROM preds q WHERE q.legajo = p.legajo)""")),
    "mod_05_evaluations": (mod_05, with_ctes("SELECT * FROM evals", **_EVALS)),
    "fai_01_demographics": (fai_01, with_ctes(
        "SELECT legajo, sexo, anio_nac, anio_ing, edad_ingreso, cohorte, grupo_edad FROM demo")),
    "fai_02_subgroups": (fai_02, with_ctes("""
        SELECT atributo, valor, c.n, round(prevalence, 4) AS prevalencia, round(a.auc, 4) AS auc,
          round(tp::DOUBLE / nullif(tp + fn, 0), 4) AS tpr, round(fp::DOUBLE / nullif(fp + tn, 0), 4) AS fpr,
          round(tp::DOUBLE / nullif(tp + fp, 0), 4) AS precision, round(w, 3) + 0.0 AS calib_slope, round(ece, 4) AS ece,
          round(brier, 4) AS brier, round(precision_at, 4) AS p_at_10
        FROM conf c JOIN auc a ON a.grp = c.grp JOIN st10 n ON n.k = c.grp JOIN ecal e ON e.grp = c.grp
        JOIN tops t ON t.grp = c.grp WHERE c.n >= 150 AND prevalence > 0 AND prevalence < 1""",
        sd="SELECT s.*, d.sexo, d.cohorte, d.grupo_edad FROM panel_scores s LEFT JOIN demo d ON d.legajo = s.id", **_SUB)),
    "fai_03_auc_spread": (fai_03_spread, with_ctes("""
        SELECT min(x) AS auc_min, max(x) AS auc_max, round(max(x) - min(x), 6) AS auc_range FROM (
          SELECT round(auc, 6) AS x FROM auc JOIN (SELECT cod_carrera, count(*) AS n FROM panel_scores GROUP BY 1) c
            ON c.cod_carrera = auc.grp WHERE n >= 50) z""",
        keyed="SELECT cod_carrera AS grp, y, p FROM panel_scores", auc=_RANK.format(t="keyed"))),
    "fai_03_auc_extremes": (fai_03_extremes, with_ctes("""
        (SELECT *, 'peor' AS extremo FROM prog ORDER BY auc, valor LIMIT 5)
        UNION ALL (SELECT *, 'mejor' AS extremo FROM prog ORDER BY auc DESC, valor DESC LIMIT 5)""",
        keyed="SELECT cod_carrera AS grp, y, p FROM panel_scores", auc=_RANK.format(t="keyed"),
        prog="""SELECT cod_carrera AS valor, n, round(auc, 6) AS auc FROM auc
          JOIN (SELECT cod_carrera, count(*) AS n FROM panel_scores GROUP BY 1) c ON c.cod_carrera = auc.grp WHERE n >= 50""")),
    "rep_01_table_counts": (rep_01, with_ctes(_each(
        "SELECT '{c}' AS table_name, count(*) AS n_rows FROM {c}", ("history", "students", "progress", "status", "panel"))
        + " UNION ALL SELECT 'predictions', CAST(-1 AS BIGINT)")),
    "rep_02_rows_per_delivery": (_simple(RP.rows_per_delivery, "raw_history"), with_ctes(
        "SELECT academic_period, count(*) AS n FROM fx_history GROUP BY 1")),
    "rep_03_history_quality": (_simple(RP.history_quality, "raw_history"), with_ctes("""
        SELECT count(*) AS total_filas, count(DISTINCT legajo) AS legajos_unicos, count(DISTINCT cod_carrera) AS carreras,
          min(academic_period) AS primer_periodo, max(academic_period) AS ultimo_periodo,
          count(*) FILTER (WHERE nota IS NULL OR nota = '') AS nulos_nota FROM fx_history""")),
    "rep_04_students_quality": (_simple(RP.students_quality, "students"), with_ctes("""
        SELECT count(*) AS total, count(DISTINCT legajo) AS legajos_unicos,
          count(*) FILTER (WHERE sexo IS NULL OR sexo = '') AS nulos_sexo,
          count(*) FILTER (WHERE fecha_nacimiento IS NULL OR fecha_nacimiento = '') AS nulos_fnac FROM students""")),
    "rep_05_progress_quality": (
        _simple(RP.progress_quality, "progress", doubles=("promedio_avance", "minimo", "maximo")), with_ctes(f"""
        SELECT count(*) AS total, count(DISTINCT legajo) AS legajos_unicos, round(avg({_NUM}), 6) AS promedio_avance,
          round(min({_NUM}), 6) AS minimo, round(max({_NUM}), 6) AS maximo, count(*) FILTER (WHERE {_NUM} >= 90) AS sobre_90,
          count(*) FILTER (WHERE {_NUM} >= 100) AS sobre_100,
          count(*) FILTER (WHERE porcentaje_avance IS NULL OR porcentaje_avance = '') AS nulos
        FROM progress WHERE {_LOOSE}""")),
    "rep_06_progress_deciles": (_simple(RP.progress_deciles, "progress"), with_ctes(f"""
        SELECT CAST(floor({_NUM} / 10) * 10 AS BIGINT) AS decil_inicio, count(*) AS n FROM progress WHERE {_LOOSE} GROUP BY 1""")),
    "rep_07_status_distribution": (_simple(RP.status_distribution, "status", doubles=("pct",)), with_ctes("""
        SELECT status, count(*) AS n, count(DISTINCT legajo) AS legajos_unicos,
          round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM status), 6) AS pct FROM status GROUP BY 1""")),
    "rep_08_completions": (rep_08, with_ctes(f"""
        SELECT cod_carrera, count(DISTINCT s.legajo) AS n_finalizacion, round(avg({_NUM}), 6) AS avance_promedio
        FROM status s LEFT JOIN progress p ON p.legajo = s.legajo
        WHERE status = 'finalizacion_estimada' AND (porcentaje_avance IS NULL OR {_LOOSE})
        GROUP BY 1 ORDER BY n_finalizacion DESC, cod_carrera LIMIT 15""")),
    "rep_09_anomalies": (_simple(RP.completion_anomalies, "status", "progress"), _anomaly_sql(90)),
    "rep_09_anomalies_at_50": (_simple(lambda a, b: RP.completion_anomalies(a, b, 50), "status", "progress"),
                               _anomaly_sql(50)),
    "rep_10_panel_composition": (_simple(RP.panel_composition, "panel"), with_ctes("""
        SELECT count(*) AS total_filas, count(*) FILTER (WHERE at_risk = 1) AS filas_at_risk,
          count(*) FILTER (WHERE at_risk = 1 AND dropout_next IS NOT NULL) AS filas_modelado,
          count(*) FILTER (WHERE dropout_next IS NULL) AS filas_censuradas FROM panel""")),
    "rep_11_overview": (_simple(RP.modelling_overview, "panel", doubles=("tasa_dropout_global",)), with_ctes("""
        SELECT count(*) AS total_filas, count(DISTINCT legajo) AS legajos_unicos, count(DISTINCT cod_carrera) AS carreras,
          count(DISTINCT academic_period) AS periodos, round(avg(dropout_next), 6) AS tasa_dropout_global,
          count(*) FILTER (WHERE dropout_next = 1) AS filas_abandono, count(*) FILTER (WHERE dropout_next = 0) AS filas_activo
        FROM modelled""")),
    "rep_12_split_summary": (_simple(lambda p: RP.split_summary(p, X.CUTOFF), "panel", doubles=("tasa_dropout",)),
                             with_ctes(f"""
        SELECT {_SPLIT} AS split, count(*) AS n, round(avg(dropout_next), 6) AS tasa_dropout,
          count(*) FILTER (WHERE dropout_next = 1) AS n_abandono, count(*) FILTER (WHERE dropout_next = 0) AS n_activo
        FROM modelled GROUP BY 1""")),
    "rep_13_periods": (_simple(lambda p: RP.period_summary(p, X.CUTOFF), "panel", doubles=("tasa_dropout",)),
                       with_ctes(f"""
        SELECT academic_period, count(*) AS n, count(DISTINCT legajo) AS legajos, round(avg(dropout_next), 6) AS tasa_dropout,
          {_SPLIT} AS split FROM modelled GROUP BY academic_period""")),
    "rep_14_label_pivot": (_simple(RP.label_pivot, "panel", doubles=("pct_abandono",)), with_ctes("""
        SELECT academic_period, count(*) FILTER (WHERE dropout_next = 0) AS activo,
          count(*) FILTER (WHERE dropout_next = 1) AS abandono, count(*) AS total,
          round(avg(dropout_next) * 100, 6) AS pct_abandono FROM modelled GROUP BY 1""")),
    "rep_15_score_bands": (rep_15, with_ctes("SELECT n_total, n_high, n_med, n_low, " + ", ".join(
        f"round({c}, 6) AS {c}" for c in ("media", "std", "mediana", "p10", "p25", "p75", "p90")) + ", " + ", ".join(
        f"round(n_{k} * 100.0::DOUBLE / n_total, 6) AS pct_{k}" for k in ("high", "med", "low")) + f" FROM ({_BANDS}) b")),
    "rep_16_risk_by_programme": (_simple(RP.risk_by_programme, "preds", doubles=("riesgo_promedio",)), with_ctes("""
        SELECT cod_carrera, count(*) AS n, round(avg(dropout_probability), 6) AS riesgo_promedio,
          count(*) FILTER (WHERE dropout_probability >= 0.7) AS alto_riesgo FROM preds GROUP BY 1""")),
    "rep_17_progress_by_status": (
        _simple(RP.progress_by_status, "status", "progress",
                doubles=("avance_promedio", "avance_mediana", "avance_min", "avance_max_val")), with_ctes(f"""
        SELECT status, count(*) AS n, round(avg(v), 2) AS avance_promedio, round(quantile_cont(v, 0.5), 2) AS avance_mediana,
          min(v) AS avance_min, max(v) AS avance_max_val, count(*) FILTER (WHERE v IS NULL) AS sin_avance
        FROM status LEFT JOIN ({_BEST}) b USING (legajo) GROUP BY 1""")),
    "rep_18_completed_activity": (rep_18, with_ctes(f"""
        SELECT CASE WHEN u IS NULL THEN 'Sin cursadas registradas' WHEN u < '2024_2C' THEN 'before 2024_2C'
                    WHEN u < '2025_2C' THEN '2024_2C-2025_1C' ELSE 'Último período >= 2024' END AS actividad, count(*) AS n
        FROM ({_BEST}) b LEFT JOIN (SELECT legajo, max(academic_period) AS u FROM fx_history GROUP BY 1) h USING (legajo)
        WHERE v >= 60 GROUP BY 1""")),
    "rep_19_cohort_retention": (_simple(lambda a, b: RP.cohort_retention(a, b, "1995"), "status", "students", doubles=_PCTS),
                                with_ctes(_pivot_sql("cohorte", """
        SELECT DISTINCT s.legajo, s.status, a.anio_academico AS cohorte FROM status s JOIN students a ON a.legajo = s.legajo
        WHERE a.anio_academico >= '1995'"""))),
    "rep_20_status_by_sex": (_simple(RP.status_by_sex, "status", "students", doubles=_PCTS), with_ctes(_pivot_sql(
        "sexo", "SELECT s.status, a.sexo FROM status s JOIN students a ON a.legajo = s.legajo WHERE a.sexo <> ''"))),
    "rep_21_top_values": (_simple(lambda a: RP.top_values(a, "codigo_carrera"), "students", doubles=("pct",)), with_ctes("""
        SELECT codigo_carrera, n, round(n * 100.0::DOUBLE / (sum(n) OVER ())::DOUBLE, 6) AS pct FROM (
          SELECT codigo_carrera, count(*) AS n FROM students WHERE codigo_carrera <> '' GROUP BY 1
          ORDER BY n DESC, codigo_carrera LIMIT 10) z""")),
    "rep_22_feature_stats": (rep_22, with_ctes(_each(
        _STAT.replace("#CORR#", ", round(corr(v, y), 6) AS corr").replace("#COND#", "academic_period > '1997_1C'"),
        K.REPORT_FEATURES))),
    "rep_23_positive_stats": (rep_23, with_ctes(_each(
        _STAT.replace("#CORR#", "").replace("#COND#", "{c} > 0"), K.REPORT_FEATURES))),
    "rep_24_listwise_correlation": (rep_24, with_ctes(_each(
        "SELECT '{c}' AS feature, round(corr(CAST({c} AS DOUBLE), CAST(dropout_next AS DOUBLE)), 6) AS corr FROM whole",
        K.REPORT_FEATURES), whole="SELECT * FROM modelled WHERE " + " AND ".join(
        f"{c} IS NOT NULL" for c in K.REPORT_FEATURES))),
    "rep_25_dropout_top20": (_simple(RP.dropout_by_programme, "panel", doubles=("tasa",)), _by_programme_sql(100, 20)),
    "rep_25_dropout_top15": (_simple(lambda p: RP.dropout_by_programme(p, 50, 15, False), "panel", doubles=("tasa",)),
                             _by_programme_sql(50, 15)),
    "rep_26_feature_histograms": (rep_26, with_ctes(
        histogram_sql("posv", "value", 28, "feature"),
        posv=_each("SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM modelled WHERE {c} > 0", K.REPORT_FEATURES))),
    "rep_27_leaderboard": (rep_27_leaderboard, with_ctes("SELECT * FROM evals WHERE cycle_period = '1998_2C'", **_EVALS)),
    "rep_27_winners": (rep_27_winners, with_ctes(
        "SELECT cycle_period, model_name, roc_auc FROM evals WHERE is_selected_model", **_EVALS)),
    "rep_28_drift_report": (rep_28, cycle_drift_sql(
        f"SELECT cycle_period, reference_period, {DRIFT_SELECT} FROM drift WHERE cycle_period = '1999_1C'")),
    "rep_29_cycles": (rep_29, cycle_drift_sql("SELECT DISTINCT cycle_period FROM drift")),
    "drf_10_psi_evolution": (drf_10, cycle_drift_sql("""
        SELECT cycle_period, round(max(psi), 6) AS psi_max, count(*) FILTER (WHERE psi >= 0.25) AS n_high,
          count(*) FILTER (WHERE psi >= 0.10 AND psi < 0.25) AS n_moderate, count(*) FILTER (WHERE psi < 0.10) AS n_none
        FROM drift GROUP BY 1""")),
    "rep_30_model_summary": (rep_30_models, with_ctes("""
        SELECT cycle_period, max(model_name) FILTER (WHERE is_selected_model) AS winner,
          max(roc_auc) FILTER (WHERE is_selected_model) AS winner_auc,
          max(ks_statistic) FILTER (WHERE is_selected_model) AS winner_ks,
          string_agg(model_name || ':' || val_size, ';' ORDER BY roc_auc DESC, model_name) AS candidates
        FROM evals GROUP BY 1""", **_EVALS)),
    "rep_30_model_documents": (rep_30_model_documents, with_ctes("""
        SELECT cycle_period AS version, cycle_period, max(model_name) FILTER (WHERE is_selected_model) OVER c AS winner,
          max(roc_auc) FILTER (WHERE is_selected_model) OVER c AS winner_auc,
          max(ks_statistic) FILTER (WHERE is_selected_model) OVER c AS winner_ks,
          row_number() OVER (PARTITION BY cycle_period ORDER BY roc_auc DESC, model_name) - 1 AS place,
          model_name, roc_auc, brier_score, ks_statistic, f1_dropout, precision_dropout, recall_dropout, val_size, is_selected_model
        FROM evals WINDOW c AS (PARTITION BY cycle_period)""", **_EVALS)),
    "rep_30_drift_documents": (rep_30_drift_documents, cycle_drift_sql(f"""
        SELECT version, psi_max, n_high, n_moderate, n_none, place, feature_name, psi_value, drift_level, mean_reference, mean_current,
          n_reference, n_current FROM (
          SELECT cycle_period AS version, round(max(psi) OVER c, 6) AS psi_max, count(*) FILTER (WHERE psi >= 0.25) OVER c AS n_high,
            count(*) FILTER (WHERE psi >= 0.10 AND psi < 0.25) OVER c AS n_moderate, count(*) FILTER (WHERE psi < 0.10) OVER c AS n_none,
            row_number() OVER (PARTITION BY cycle_period ORDER BY round(psi, 6) DESC, feature_name) - 1 AS place, {DRIFT_SELECT}
          FROM drift WINDOW c AS (PARTITION BY cycle_period)) z""")),
    "rep_30_drift_summary": (rep_30_drift, cycle_drift_sql("""
        SELECT cycle_period, round(max(psi), 6) AS psi_max, count(*) FILTER (WHERE psi >= 0.25) AS n_high,
          count(*) FILTER (WHERE psi >= 0.10 AND psi < 0.25) AS n_moderate, count(*) FILTER (WHERE psi < 0.10) AS n_none,
          string_agg(feature_name, ',' ORDER BY round(psi, 6) DESC, feature_name) AS features FROM drift GROUP BY 1""")),
}
