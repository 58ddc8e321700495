"""Evaluation metrics and the grouped bootstrap on deterministic score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.operators import metrics as ME
from panelworks.operators import resample as RS
from panelworks.plans import scores as S
from panelworks.plans.oracle import with_ctes
from panelworks.plans.queries.common import as_long, r6

_G = ["grp"]


def met_01(s, d):
    return r6(ME.roc_auc(S.all_scores(s, d), _G), ["auc"])


def met_01_one_class(s, d):
    """A group with one class has no AUC; equal scores give one half."""
    rows = S.all_scores(s, d)
    one = rows.where("y = 1").withColumn("grp", F.lit("one_class"))
    flat = rows.withColumn("p", F.lit(0.5)).withColumn("grp", F.lit("flat"))
    return r6(ME.roc_auc(one.unionByName(flat), _G), ["auc"])


def met_02(s, d):
    return r6(ME.roc_points(S.all_scores(s, d), _G), ["threshold", "fpr", "tpr"])


def met_03(s, d):
    return r6(ME.pr_points(S.all_scores(s, d), _G), ["threshold", "precision", "recall"])


def met_ranking(s, d):
    return r6(ME.ranking_metrics(S.all_scores(s, d), _G),
              ["roc_auc", "average_precision", "pr_auc", "ks_statistic"])


def _ranking_column(column):
    def query(s, d):
        return r6(ME.ranking_metrics(S.all_scores(s, d), _G).select("grp", column), [column])

    return query


def met_05(s, d):
    out = ME.threshold_metrics(S.all_scores(s, d), _G)
    return r6(out.select("grp", "n", "brier_score", "brier_skill_score"), ["brier_score", "brier_skill_score"])


def met_07(s, d):
    return r6(ME.confusion_rows(S.all_scores(s, d), _G), ["row_share"])


def met_08(s, d):
    return r6(ME.class_report(S.all_scores(s, d), _G), ["precision", "recall", "f1_score", "accuracy"])


def met_09(s, d):
    out = ME.threshold_metrics(S.panel_scores(s, d), ["cod_carrera"])
    return r6(out.select("cod_carrera", "n", "tpr", "fpr", "precision"), ["tpr", "fpr", "precision"])


def met_10(s, d):
    return r6(ME.top_share(S.all_scores(s, d), _G), ["precision_at", "recall_at"])


def met_10_at_least_one(s, d):
    rows = S.document_scores(s, d)
    out = ME.top_share(rows, ["lang", "source"], shares=(10,), at_least_one=True)
    return r6(out, ["precision_at", "recall_at"])


def met_11(s, d):
    return r6(ME.threshold_metrics(S.all_scores(s, d), _G).select("grp", "ece"), ["ece"])


def met_12(s, d):
    out = as_long(ME.calibration_curve(S.all_scores(s, d), _G), "bin")
    return r6(out, ["mean_predicted", "fraction_positive"])


def met_13(s, d):
    return r6(ME.calibration_fit(S.all_scores(s, d), _G), ["calib_slope", "calib_intercept"], 4)


def met_13_global(s, d):
    return r6(ME.calibration_fit(S.document_scores(s, d)), ["calib_slope", "calib_intercept"], 4)


def met_14(s, d):
    return r6(RS.bootstrap_interval(S.panel_scores(s, d)), ["auc_ci_low", "auc_ci_high"])


def met_14_draws(s, d):
    """How often each student is drawn, summarised per replicate."""
    weights = RS.draw_weights(S.panel_scores(s, d), "id", 300)
    return weights.groupBy("replicate").agg(
        F.count(F.lit(1)).alias("n_students"), F.sum("weight").alias("n_draws"), F.max("weight").alias("max_weight"))


def met_15(s, d):
    rows = S.panel_scores(s, d).withColumn("p2", 1 - F.coalesce("alt", F.lit(0.0)))
    return r6(RS.paired_difference(rows, "p", "p2"), ["delta", "ci_low", "ci_high", "p_gt_0"])


def met_16(s, d):
    return r6(ME.roc_auc(ME.recency_scores(S.panel_scores(s, d), "days"), ["academic_period"]), ["auc"])


def met_17(s, d):
    out = ME.metrics_by(S.panel_scores(s, d), ["academic_period"])
    return r6(out, ["auc", "actual_rate", "predicted_rate"])


def met_17_programme(s, d):
    out = ME.metrics_by(S.panel_scores(s, d), ["cod_carrera"])
    return r6(out, ["auc", "actual_rate", "predicted_rate"])


def met_18(s, d):
    """By class, each class on its own range."""
    return r6(ME.value_histogram(S.document_scores(s, d), "p", 35, ["y"]), ["bin_low", "density"])


def met_18_overall(s, d):
    return r6(ME.value_histogram(S.document_scores(s, d), "p", 40), ["bin_low", "density"])


# SQL: running sums over distinct scores, per group
_HIST = "SELECT grp, p, sum(y) AS pos, sum(1 - y) AS neg FROM all_scores GROUP BY 1, 2"
_CUM = """
    SELECT *, sum(pos) OVER (PARTITION BY grp) AS ap, sum(neg) OVER (PARTITION BY grp) AS an,
      sum(pos) OVER (PARTITION BY grp ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
      sum(neg) OVER (PARTITION BY grp ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp
    FROM hist"""
_PREV = """
    SELECT *, coalesce(lag(tp::DOUBLE / (tp + fp)) OVER (PARTITION BY grp ORDER BY p DESC), 1.0) AS prev_precision,
      tp::DOUBLE / (tp + fp) AS prec FROM cum"""
_RANK = """
    SELECT grp, (sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0)
        / nullif(sum(y)::DOUBLE * sum(1 - y), 0) AS auc
    FROM (SELECT grp, y, rank() OVER (PARTITION BY grp ORDER BY p)
            + (count(*) OVER (PARTITION BY grp, p) - 1) / 2.0 AS r FROM {t}) z GROUP BY 1"""
_CONF = """
    SELECT {g}, count(*) AS n, avg(y) AS prevalence, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp,
      count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn,
      count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn, avg((p - y) * (p - y)) AS brier
    FROM {t} GROUP BY {g}"""
_EDGES = [i * (1.0 / 10) for i in range(1, 10)]
_BIN_LEFT = " + ".join(f"CAST(p >= {e!r}::DOUBLE AS INT)" for e in _EDGES)
_BIN_RIGHT = " + ".join(f"CAST(p > {e!r}::DOUBLE AS INT)" for e in _EDGES)


def ranked_sql(body: str) -> str:
    return with_ctes(body, hist=_HIST, cum=_CUM, prev=_PREV)


def bootstrap_ctes(table: str, replicates: int, seed: int = K.SEED) -> dict[str, str]:
    return {
        "places": f"""
            SELECT id, row_number() OVER (ORDER BY md5(id), id) - 1 AS place, count(*) OVER () AS size
            FROM (SELECT DISTINCT id FROM {table}) z""",
        "draws": f"""
            SELECT r AS replicate, ('0x' || substr(md5('{seed}|' || (r // 4) || '|' || place), (r % 4) * 8 + 1, 8))::BIGINT
                % size AS place
            FROM places, generate_series(0, {replicates - 1}) t(r)""",
        "weights": """
            SELECT d.replicate, p.id, count(*) AS weight FROM draws d JOIN places p ON p.place = d.place GROUP BY 1, 2""",
    }


def weighted_auc(rows: str, keys: str) -> str:
    """AUC per key from (keys, y, p, weight) rows."""
    return f"""
        SELECT {keys}, sum(pos * (below + neg / 2.0)) / nullif(sum(pos)::DOUBLE * sum(neg), 0) AS auc FROM (
          SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY p
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
          FROM (SELECT {keys}, p, sum(y * weight) AS pos, sum((1 - y) * weight) AS neg
                FROM ({rows}) q GROUP BY {keys}, p) h) c
        GROUP BY {keys}"""


def newton_ctes(table: str, key: str, steps: int = 30) -> dict[str, str]:
    ctes = {
        "pts": f"""SELECT {key} AS k, ln(c / (1 - c)) AS x, sum(y) AS pos, count(*) AS n FROM (
            SELECT {key}, y, least(greatest(p, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) AS c FROM {table}) z GROUP BY 1, 2""",
        "st0": """SELECT k, 0.0::DOUBLE AS w, 0.0::DOUBLE AS b FROM pts GROUP BY k
            HAVING sum(pos) > 0 AND sum(pos) < sum(n)""",
    }
    for i in range(steps):
        ctes[f"st{i + 1}"] = f"""
            SELECT k, w - (bb * gw - wb * gb) / (ww * bb - wb * wb) AS w, b - (ww * gb - wb * gw) / (ww * bb - wb * wb) AS b
            FROM (SELECT k, max(w) AS w, max(b) AS b, sum((n * mu - pos) * x) + max(w) AS gw, sum(n * mu - pos) AS gb,
                    sum(n * mu * (1 - mu) * x * x) + 1 AS ww, sum(n * mu * (1 - mu) * x) AS wb,
                    sum(n * mu * (1 - mu)) AS bb
                  FROM (SELECT pts.*, s.w, s.b, 1 / (1 + exp(-(s.w * x + s.b))) AS mu
                        FROM pts JOIN st{i} s ON s.k = pts.k) q GROUP BY k) z"""
    return ctes


def top_sql(table: str, keys: str, shares: str, least: int = 0) -> str:
    return f"""
        SELECT {keys}, top_pct, k, hits::DOUBLE / nullif(k, 0) AS precision_at,
          hits::DOUBLE / nullif(total, 0) AS recall_at FROM (
          SELECT {keys}, top_pct, CAST(greatest(max(n) * top_pct // 100, {least}) AS BIGINT) AS k, sum(y) AS total,
            sum(CASE WHEN r <= greatest(n * top_pct // 100, {least}) THEN y ELSE 0 END) AS hits
          FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY p DESC, md5(CAST(id AS VARCHAR)), id) AS r,
                  count(*) OVER (PARTITION BY {keys}) AS n FROM {table}) z, (VALUES {shares}) v(top_pct)
          GROUP BY {keys}, top_pct) q"""


def histogram_sql(table: str, value: str, bins: int, keys: str = "", where: str = "true") -> str:
    """numpy-style equal-width bins between the minimum and maximum of each group."""
    k, part = (f"{keys}, ", f"PARTITION BY {keys}") if keys else ("", "")
    return f"""
        SELECT {k}CAST(b AS BIGINT) AS bin, round(lo + b * w, 6) AS bin_low, count(*) AS n,
          round(count(*) / (sum(count(*)) OVER ({part}))::DOUBLE / w, 6) AS density
        FROM (SELECT *, CASE WHEN v < lo + g * w THEN g - 1 WHEN v >= lo + (g + 1) * w AND g < {bins - 1} THEN g + 1
                        ELSE g END AS b
              FROM (SELECT *, (hi - lo) / {bins} AS w, least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1}) AS g
                    FROM (SELECT {k}v, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo,
                            CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi
                          FROM (SELECT {k}CAST({value} AS DOUBLE) AS v, min(CAST({value} AS DOUBLE)) OVER ({part}) AS mn,
                                  max(CAST({value} AS DOUBLE)) OVER ({part}) AS mx
                                FROM {table} WHERE {value} IS NOT NULL AND {where}) a) b1) c) e
        GROUP BY {k}b, lo, w"""


_REPORT = """
    SELECT *, tn::DOUBLE / nullif(tn + fn, 0) AS p0, tn::DOUBLE / nullif(tn + fp, 0) AS r0,
      2 * tn::DOUBLE / nullif(2 * tn + fn + fp, 0) AS f0, tn + fp AS s0, tp::DOUBLE / nullif(tp + fp, 0) AS p1,
      tp::DOUBLE / nullif(tp + fn, 0) AS r1, 2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0) AS f1, tp + fn AS s1,
      (tp + tn)::DOUBLE / n AS acc FROM conf"""
_Z = "coalesce({}, 0)"


def _avg(a: str, b: str, weighted: bool) -> str:
    a, b = _Z.format(a), _Z.format(b)
    return f"({a} * s0 + {b} * s1) / (s0 + s1)" if weighted else f"({a} + {b}) / 2"


def _report_row(name: str, p: str, r: str, f: str, s: str) -> str:
    return (f"SELECT grp, '{name}' AS class, round({p}, 6) AS precision, round({r}, 6) AS recall, "
            f"round({f}, 6) AS f1_score, {s} AS support, round(acc, 6) AS accuracy FROM rep")


_METRICS_BY = """
    SELECT c.{g}, c.n, round(a.auc, 6) AS auc, round(c.prevalence, 6) AS actual_rate,
      round((c.tp + c.fp)::DOUBLE / c.n, 6) AS predicted_rate
    FROM conf c JOIN auc a ON a.grp IS NOT DISTINCT FROM c.{g} WHERE c.n >= 50"""

QUERIES = {
    "met_01_roc_auc": (met_01, with_ctes(
        "SELECT grp, round(auc, 6) AS auc FROM auc", auc=_RANK.format(t="all_scores"))),
    "met_01_edge_groups": (met_01_one_class, with_ctes("""
        SELECT 'one_class' AS grp, CAST(NULL AS DOUBLE) AS auc WHERE EXISTS (SELECT 1 FROM all_scores)
        UNION ALL SELECT 'flat', 0.5::DOUBLE""")),
    "met_02_roc_points": (met_02, ranked_sql("""
        SELECT grp, round(p, 6) AS threshold, round(fp::DOUBLE / an, 6) AS fpr, round(tp::DOUBLE / ap, 6) AS tpr FROM cum
        UNION ALL SELECT DISTINCT grp, CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM hist""")),
    "met_03_pr_points": (met_03, ranked_sql("""
        SELECT grp, round(p, 6) AS threshold, round(prec, 6) AS precision, round(tp::DOUBLE / ap, 6) AS recall
        FROM prev""")),
    "met_03_pr_auc": (_ranking_column("pr_auc"), ranked_sql("""
        SELECT grp, round(sum(pos::DOUBLE / ap * (prec + prev_precision) / 2), 6) AS pr_auc FROM prev GROUP BY 1""")),
    "met_04_average_precision": (_ranking_column("average_precision"), ranked_sql("""
        SELECT grp, round(sum(pos::DOUBLE / ap * prec), 6) AS average_precision FROM prev GROUP BY 1""")),
    "met_05_brier": (met_05, with_ctes("""
        SELECT grp, n, round(brier, 6) AS brier_score,
          round(1 - brier / nullif(prevalence * (1 - prevalence), 0), 6) AS brier_skill_score FROM conf""",
                     conf=_CONF.format(g="grp", t="all_scores"))),
    "met_06_ks": (_ranking_column("ks_statistic"), ranked_sql("""
        SELECT grp, round(max(abs(tp::DOUBLE / ap - fp::DOUBLE / an)), 6) AS ks_statistic FROM cum GROUP BY 1""")),
    "met_01_to_06_ranking": (met_ranking, ranked_sql("""
        SELECT p.grp, CAST(max(ap) AS BIGINT) AS n_pos, CAST(max(an) AS BIGINT) AS n_neg,
          round(sum(pos * (an - fp + neg / 2.0)) / (max(ap)::DOUBLE * max(an)), 6) AS roc_auc,
          round(sum(pos::DOUBLE / ap * prec), 6) AS average_precision,
          round(sum(pos::DOUBLE / ap * (prec + prev_precision) / 2), 6) AS pr_auc,
          round(max(abs(tp::DOUBLE / ap - fp::DOUBLE / an)), 6) AS ks_statistic FROM prev p GROUP BY 1""")),
    "met_07_confusion": (met_07, with_ctes("""
        SELECT grp, 0 AS actual, 0 AS predicted, tn AS n, round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS row_share FROM conf
        UNION ALL SELECT grp, 0, 1, fp, round(fp::DOUBLE / nullif(tn + fp, 0), 6) FROM conf
        UNION ALL SELECT grp, 1, 0, fn, round(fn::DOUBLE / nullif(tp + fn, 0), 6) FROM conf
        UNION ALL SELECT grp, 1, 1, tp, round(tp::DOUBLE / nullif(tp + fn, 0), 6) FROM conf""",
                         conf=_CONF.format(g="grp", t="all_scores"))),
    "met_08_class_report": (met_08, with_ctes(" UNION ALL ".join([
        _report_row("0", _Z.format("p0"), _Z.format("r0"), _Z.format("f0"), "s0"),
        _report_row("1", _Z.format("p1"), _Z.format("r1"), _Z.format("f1"), "s1"),
        _report_row("macro avg", _avg("p0", "p1", False), _avg("r0", "r1", False), _avg("f0", "f1", False), "n"),
        _report_row("weighted avg", _avg("p0", "p1", True), _avg("r0", "r1", True), _avg("f0", "f1", True), "n"),
    ]), conf=_CONF.format(g="grp", t="all_scores"), rep=_REPORT)),
    "met_09_group_rates": (met_09, with_ctes("""
        SELECT cod_carrera, n, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS tpr,
          round(fp::DOUBLE / nullif(fp + tn, 0), 6) AS fpr, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision
        FROM conf""", conf=_CONF.format(g="cod_carrera", t="panel_scores"))),
    "met_10_top_share": (met_10, with_ctes(
        "SELECT grp, top_pct, k, round(precision_at, 6) AS precision_at, round(recall_at, 6) AS recall_at FROM tops",
        tops=top_sql("all_scores", "grp", "(5), (10), (20), (30)"))),
    "met_10_top_share_min_one": (met_10_at_least_one, with_ctes(
        "SELECT lang, source, top_pct, k, round(precision_at, 6) AS precision_at, round(recall_at, 6) AS recall_at FROM tops",
        tops=top_sql("doc_scores", "lang, source", "(10)", 1))),
    "met_11_ece": (met_11, with_ctes(f"""
        SELECT grp, round(sum(gap) / sum(n), 6) AS ece FROM (
          SELECT grp, {_BIN_LEFT} AS b, count(*) AS n, abs(avg(y) - avg(p)) * count(*) AS gap
          FROM all_scores GROUP BY 1, 2) z GROUP BY 1""")),
    "met_12_calibration_curve": (met_12, with_ctes(f"""
        SELECT grp, CAST({_BIN_RIGHT} AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_predicted,
          round(avg(y), 6) AS fraction_positive FROM all_scores GROUP BY 1, 2""")),
    "met_13_calibration_fit": (met_13, with_ctes(
        "SELECT g.k AS grp, round(w, 4) + 0.0 AS calib_slope, round(b, 4) + 0.0 AS calib_intercept "
        "FROM (SELECT DISTINCT k FROM pts) g LEFT JOIN st10 s ON s.k = g.k",
        **newton_ctes("all_scores", "grp"))),
    "met_13_calibration_fit_all": (met_13_global, with_ctes(
        "SELECT round(w, 4) + 0.0 AS calib_slope, round(b, 4) + 0.0 AS calib_intercept FROM st10",
        **newton_ctes("doc_scores", "1"))),
    "met_14_bootstrap_draws": (met_14_draws, with_ctes("""
        SELECT replicate, count(*) AS n_students, CAST(sum(weight) AS BIGINT) AS n_draws, max(weight) AS max_weight
        FROM weights GROUP BY 1""", **bootstrap_ctes("panel_scores", 300))),
    "met_14_bootstrap_auc": (met_14, with_ctes(f"""
        SELECT round(quantile_cont(auc, 0.025), 6) AS auc_ci_low, round(quantile_cont(auc, 0.975), 6) AS auc_ci_high,
          count(*) AS n_replicates FROM ({weighted_auc(
            'SELECT w.replicate, s.y, s.p, w.weight FROM panel_scores s JOIN weights w ON w.id = s.id', 'replicate')}) z
        WHERE auc IS NOT NULL""", **bootstrap_ctes("panel_scores", 300))),
    "met_15_paired_delta": (met_15, with_ctes(f"""
        SELECT round(avg(x), 6) AS delta, round(quantile_cont(x, 0.025), 6) AS ci_low,
          round(quantile_cont(x, 0.975), 6) AS ci_high, round(avg(CAST(x > 0 AS INT)), 6) AS p_gt_0,
          count(*) AS n_replicates FROM (
          SELECT replicate, sum(CASE WHEN score = 'a' THEN auc ELSE -auc END) AS x FROM ({weighted_auc(
            "SELECT w.replicate, 'a' AS score, s.y, s.p, w.weight FROM panel_scores s JOIN weights w ON w.id = s.id "
            "UNION ALL SELECT w.replicate, 'b', s.y, 1 - coalesce(s.alt, 0.0::DOUBLE), w.weight "
            "FROM panel_scores s JOIN weights w ON w.id = s.id", 'replicate, score')}) q
          WHERE auc IS NOT NULL GROUP BY 1) z""", **bootstrap_ctes("panel_scores", 500))),
    "met_16_recency_baseline": (met_16, with_ctes(
        "SELECT grp AS academic_period, round(auc, 6) AS auc FROM auc",
        base="""SELECT academic_period AS grp, y,
            coalesce(days, (SELECT quantile_cont(days, 0.5) FROM panel_scores)) AS p FROM panel_scores""",
        auc=_RANK.format(t="base"))),
    "met_17_by_period": (met_17, with_ctes(
        _METRICS_BY.format(g="academic_period"), conf=_CONF.format(g="academic_period", t="panel_scores"),
        keyed="SELECT academic_period AS grp, y, p FROM panel_scores", auc=_RANK.format(t="keyed"))),
    "met_17_by_programme": (met_17_programme, with_ctes(
        _METRICS_BY.format(g="cod_carrera"), conf=_CONF.format(g="cod_carrera", t="panel_scores"),
        keyed="SELECT cod_carrera AS grp, y, p FROM panel_scores", auc=_RANK.format(t="keyed"))),
    "met_18_class_histogram": (met_18, with_ctes(histogram_sql("doc_scores", "p", 35, "y"))),
    "met_18_histogram": (met_18_overall, with_ctes(histogram_sql("doc_scores", "p", 40))),
}
