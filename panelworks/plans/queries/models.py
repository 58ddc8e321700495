"""Model training, scoring and the model studies.

Iterative fits have no SQL twin. Beside every study stands a query that recomputes
its figures by other means from the scores it stored; its SQL says that all agree.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelworks import constants as K
from panelworks.functions import periods as P
from panelworks.operators import audit as AU
from panelworks.operators import evaluation as EV
from panelworks.operators import experiments as EX
from panelworks.operators import fairness as FA
from panelworks.operators import metrics as ME
from panelworks.operators import modeling as MO
from panelworks.operators import panel as PN
from panelworks.operators import scoring as SC
from panelworks.operators import sensitivity as SN
from panelworks.operators import splits as SP
from panelworks.operators import status as ST
from panelworks.plans import fixtures as X
from panelworks.plans import marts as M
from panelworks.plans.oracle import with_ctes
from panelworks.plans.queries.reporting import TESTS
from panelworks.session import concurrently, scratch_path

# the full size of the candidates
TREES = 100
SPEC = MO.TrainSpec(trees=TREES, parts=8)
TEST = TESTS[-1]
CUTOFFS = ["1995_2C", "1996_1C", "1996_2C", "1997_1C"]
VERSIONS = ("1995_2C", "1996_2C", "1997_1C")

_fitted: dict[tuple, object] = {}


def _fit(s, d):
    """Fit function that keeps a model per (application, folder, tag) for the studies that share it."""
    def fit(train, tag):
        key = (s.sparkContext.applicationId, d, tag)
        if key not in _fitted:
            _fitted[key] = MO.fit(train, "GradientBoosting", SPEC)
        return _fitted[key]

    return fit


def _train(s, d):
    return M.modelled(s, d).where(F.col("academic_period") <= X.CUTOFF)


def _test(s, d):
    return M.modelled(s, d).where(F.col("academic_period") == TEST)


def fea_04(s, d):
    """One-hot width and non-zero entries of test rows; unseen programmes are all zero."""
    train = MO.training_table(_train(s, d).where(F.col("cod_carrera") != "Brand#7"), SPEC)
    prepared = MO.Preparation.fit(train, SPEC.numeric, SPEC.category, MO.WEIGHT)
    fitted = MO.Pipeline(stages=MO.preparation_stages(prepared, SPEC)).fit(train)
    codes = F.aggregate(MO.vector_to_array("x_codes"), F.lit(0.0), lambda a, x: a + x)
    return fitted.transform(_test(s, d)).groupBy("cod_carrera").agg(
        F.max(F.size(MO.vector_to_array("x_codes"))).cast("long").alias("width"), F.max(codes).alias("ones"))


def _candidate(name):
    def query(s, d):
        model = MO.fit(_train(s, d), name, SPEC) if name != "GradientBoosting" else _fit(s, d)(_train(s, d), X.CUTOFF)
        return MO.score(model, _test(s, d)).select("legajo", "academic_period", "dropout_next", F.round("p", 6).alias("p"))

    return query


def _kept(s, d, name, build):
    """Something that is no table, kept per (application, folder)."""
    key = (s.sparkContext.applicationId, d, name)
    if key not in _fitted:
        _fitted[key] = build()
    return _fitted[key]


def _competition(s, d):
    """Stored scores of all candidates, the models and their facts: one training table, fits side by side."""
    return _kept(s, d, "compete", lambda: MO.compete_scores(_train(s, d), _test(s, d), X.LATEST, SPEC))


def mod_04(s, d):
    stacked, _, facts = _competition(s, d)
    return M._once(s, d, "mod_04", lambda: EV.evaluations(stacked).join(F.broadcast(facts), "model_name"))


def _flags(s, rows):
    return s.createDataFrame(rows, "study string, part string, figure string, agrees boolean")


def _agrees(published, other, part, digits):
    return AU.close(published, other(part), digits)


def _side_by_side(s, jobs):
    """Results of independent checks, named by (part, figure)."""
    done = concurrently(s, {"-".join(at): job for at, job in jobs.items()})
    return {at: done["-".join(at)] for at in jobs}


def _values(s, study, scored, by, published, figures):
    """Whether the published figures of each part are what other means find in its stored scores."""
    means = {"auc": AU.area, "brier": AU.squared_error, "p_at_10": AU.top_hits}
    jobs = {}
    for row in published.collect():  # one row per part of a study
        part = scored.where(F.col(by) == row[by])
        jobs |= {(row[by], f): partial(_agrees, row[c], means[f], part, digits) for f, (c, digits) in figures.items()}
    return _flags(s, [(study, *at, agrees) for at, agrees in _side_by_side(s, jobs).items()])


def mod_04_values(s, d):
    scored, models, _ = _competition(s, d)
    out = _values(s, "mod_04", scored, "model_name", EV.evaluations(scored), {"auc": ("roc_auc", 9), "brier": ("brier_score", 9)})
    steep = AU.logistic_gradient(models["LogisticRegression"], _train(s, d)).agg(F.max(F.abs("gradient"))).first()[0]
    return out.unionByName(_flags(s, [("mod_03", "LogisticRegression", "gradient", steep < 1e-5)]))


def mod_06_values(s, d):
    """Importances next to the gains in the stored nodes of the trees."""
    model = _fit(s, d)(_train(s, d), X.CUTOFF)
    both = MO.importances(model, SPEC, s).join(AU.stored_importances(model, SPEC).withColumnRenamed("importance", "other"), "feature", "left")
    return both.select("feature", (F.abs(F.col("importance") - F.coalesce("other", F.lit(0.0))) < 1e-9).alias("agrees"))


def _backtest_scores(s, d):
    return M._once(s, d, "bkt_01_scores", lambda: EX.scored_pairs(M.modelled(s, d), SP.origins(TESTS), _fit(s, d)))


def bkt_01_values(s, d):
    return _values(s, "bkt_01", _backtest_scores(s, d), "test_period", bkt_01(s, d),
                   {"auc": ("auc", 4), "brier": ("brier", 4), "p_at_10": ("p_at_10", 4)})


def _incremental_scores(s, d):
    pairs = [(c, TEST) for c in CUTOFFS]
    return M._once(s, d, "bkt_02_scores", lambda: EX.scored_pairs(M.modelled(s, d), pairs, _fit(s, d)))


def bkt_02_values(s, d):
    scored = _incremental_scores(s, d).withColumnRenamed("origin", "train_cutoff")
    return _values(s, "bkt_02", scored, "train_cutoff", bkt_02(s, d), {"auc": ("auc", 4)})


def _unseen_scores(s, d):
    return M._once(s, d, "bkt_03_scores", lambda: EX.unseen_scores(M.modelled(s, d), TEST, _fit(s, d)))


def bkt_03_values(s, d):
    scored = _unseen_scores(s, d)
    full = scored.where("kind = 'full'").withColumn("kind", F.when(F.col("seen"), "seen").otherwise("new"))
    row = bkt_03(s, d).first()
    published = s.createDataFrame([(k, row[f"auc_{k}"]) for k in ("full", "grouped", "seen", "new")], "kind string, auc double")
    # a part without both classes has no area
    some = scored.unionByName(full).groupBy("kind").agg(F.count_distinct("y").alias("n")).where("n = 2")
    return _values(s, "bkt_03", scored.unionByName(full), "kind", published.join(some, "kind"), {"auc": ("auc", 4)})


def abl_01_values(s, d):
    long = EV.several_scores(_ablation(s, d).drop("p_linear"), EX.ABLATION_SCORES, "variante")
    return _values(s, "abl_01", long, "variante", abl_01(s, d), {"auc": ("auc", 4), "p_at_10": ("p_at_10", 4)})


def abl_paired_values(s, d):
    """The mean difference lies in its interval and near the difference on the whole sample, by their own areas."""
    scores, rows = _ablation(s, d), []
    names = {name: (first, second) for name, first, second in EX.PAIRS}
    for row in abl_paired(s, d).collect():
        first, second = names[row["comparacion"]]
        gap = AU.area(scores, p=first) - AU.area(scores, p=second)
        rows.append(("abl_01", row["comparacion"], "delta", row["ci_low"] - 1e-4 <= row["delta"] <= row["ci_high"] + 1e-4 and abs(row["delta"] - gap) < 0.02))
    return _flags(s, rows)


def prm_01_values(s, d):
    """Drop and deviation of one feature over all repeats."""
    scored, name = _permuted(s, d), K.RECENCY_FEATURE
    whole = AU.area(scored.where("feature = ''"), weight="n")
    repeats = [r[0] for r in scored.where(F.col("feature") == name).select("repeat").distinct().collect()]
    drops = [whole - AU.area(scored.where((F.col("feature") == name) & (F.col("repeat") == r)), weight="n") for r in repeats]
    row = prm_01(s, d).where(F.col("feature") == name).first()
    mean = sum(drops) / len(drops)
    spread = (sum((x - mean) ** 2 for x in drops) / len(drops)) ** 0.5
    return _flags(s, [("prm_01", name, "drop", AU.close(row["caida_auc_media"], mean, 4)), ("prm_01", name, "deviation", AU.close(row["std"], spread, 4))])


def scm_01_values(s, d):
    scored = _versions(s, d)
    out = _values(s, "scm_01", scored, "version", EX.version_summary(scored), {"auc": ("roc_auc", 9)})
    # the ROC points of a version enclose its area
    points = ME.roc_points(scored, ["version"])
    order = Window.partitionBy("version").orderBy("fpr", "tpr")  # a point per distinct score of one half-year's rows
    steps = points.withColumns({"x": F.lag("fpr").over(order), "h": F.lag("tpr").over(order)})
    areas = steps.groupBy("version").agg(F.sum((F.col("fpr") - F.col("x")) * (F.col("tpr") + F.col("h")) / 2).alias("area"))
    rows = [("scm_01", r["version"], "curve", AU.close(r["area"], AU.area(scored.where(F.col("version") == r["version"])), 9)) for r in areas.collect()]
    return out.unionByName(_flags(s, rows))


def sen_08_values(s, d):
    scored = None
    for label, part in _label_scores(s, d).items():
        scored = part if scored is None else scored.unionByName(part)
    return _values(s, "sen_08", scored, "etiqueta", M._once(s, d, "sen_08", lambda: sen_08(s, d)),
                   {"auc": ("auc", 4), "brier": ("brier", 4), "p_at_10": ("p_at_10", 4)})


def fai_model_values(s, d):
    """Two attributes of the subgroup table on model scores."""
    stored, jobs = _fairness_scores(s, d), {}
    for row in fai_model(s, d).where("atributo in ('Sexo', 'Carrera')").collect():  # one row per group of 150 rows or more
        column = {"Sexo": "sexo", "Carrera": "cod_carrera"}[row["atributo"]]
        part = stored.where(F.col(column) == row["valor"])
        for figure, other in (("auc", AU.area), ("brier", AU.squared_error)):
            jobs[row["valor"], figure] = partial(_agrees, row[figure], other, part, 4)
    return _flags(s, [("fai_02", *at, agrees) for at, agrees in _side_by_side(s, jobs).items()]).where("not agrees")


def mod_04_sizes(s, d):
    """Candidates, their training rows, and whether one is selected and all areas lie in [0, 1]."""
    return mod_04(s, d).select(
        "model_name", "train_size", F.col("roc_auc").between(0, 1).alias("auc_in_range"),
        (F.sum(F.col("is_selected_model").cast("int")).over(Window.partitionBy(F.lit(1))) == 1).alias("one_selected"))


def mod_scored(s, d):
    """Size of the test rows each candidate has scored: rows, positives and valid probabilities per half-year."""
    return _competition(s, d)[0].groupBy("model_name", "academic_period").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") == 1).alias("n_pos"),
        F.count_if(F.col("p").between(0, 1)).alias("n_valid"))


def mod_06(s, d):
    return MO.importances(_fit(s, d)(_train(s, d), X.CUTOFF), SPEC, s)


def mod_06_features(s, d):
    """Every input has an importance of its own and they add up to one."""
    whole = Window.partitionBy(F.lit(1))
    return mod_06(s, d).select("feature", (F.round(F.sum("importance").over(whole), 6) == 1).alias("adds_up"))


def mod_07(s, d):
    """Save two versions, load the newest, score: version and rows per period."""
    path = scratch_path(s, "models")
    fit = _fit(s, d)
    parts = {"1996_2C": M.modelled(s, d).where(F.col("academic_period") <= "1996_2C"), X.CUTOFF: _train(s, d)}
    for model in concurrently(s, {cutoff: partial(fit, part, cutoff) for cutoff, part in parts.items()}).values():
        MO.save_model(model, path)
    model, version = MO.load_model(path)
    return MO.score(model, _test(s, d)).groupBy("academic_period").agg(
        F.lit(version).alias("version"), F.count("p").alias("n"), F.avg("p").alias("mean_p"))


def mod_07_versions(s, d):
    return mod_07(s, d).select("academic_period", F.col("version").cast("long").alias("version"), "n")


def sco_03(s, d):
    """Whole scoring run: latest rows of studying students, class and probability."""
    rows = SC.latest_risk_rows(M.panel(s, d), SC.active_students(M.status(s, d)))
    scored = MO.score(_fit(s, d)(_train(s, d), X.CUTOFF), rows)
    return SC.predictions(scored, F.col("p"), F.current_timestamp(), F.lit("1"))


def sco_03_keys(s, d):
    """Who is scored on which row, and whether the class follows from the probability."""
    p = F.col("dropout_probability")
    return sco_03(s, d).select(
        "legajo", "academic_period", p.between(0, 1).alias("valid"),
        ((p >= 0.5).cast("int") == F.col("dropout_prediction")).alias("class_ok"))


def bkt_01(s, d):
    return M._once(s, d, "bkt_01", lambda: EX.backtest_table(_backtest_scores(s, d), M.modelled(s, d), SP.origins(TESTS)))


def bkt_01_sizes(s, d):
    return bkt_01(s, d).select("origin", "test_period", "n_train", "n_test", "prevalence")


def bkt_02(s, d):
    return M._once(s, d, "bkt_02", lambda: EX.incremental_table(
        _incremental_scores(s, d), M.modelled(s, d), [(c, TEST) for c in CUTOFFS]))


def bkt_02_sizes(s, d):
    return bkt_02(s, d).select("train_cutoff", "test_period", "n_train", "n_test")


def bkt_03(s, d):
    return M._once(s, d, "bkt_03", lambda: EX.unseen_table(_unseen_scores(s, d), M.modelled(s, d), TEST))


def bkt_03_sizes(s, d):
    return bkt_03(s, d).select(
        "test_period", "train_cutoff", "n_test", "n_test_seen", "n_test_new", "n_train_full", "n_train_grouped")


def _ablation(s, d):
    key = (s.sparkContext.applicationId, d, "ablation")
    if key not in _fitted:
        def fit_with(train, features, name):
            if features == K.NUMERIC_FEATURES and name == "GradientBoosting":
                return _fit(s, d)(train, X.CUTOFF)
            return MO.fit(train, name, MO.TrainSpec(trees=TREES, parts=8, numeric=features))

        _fitted[key] = EX.ablation_scores(_train(s, d), _test(s, d), fit_with)
    return _fitted[key]


def abl_01(s, d):
    return EX.ablation_table(_ablation(s, d))


def abl_01_features(s, d):
    return abl_01(s, d).select("variante", F.col("n_features").cast("long").alias("n_features"), F.col("auc").between(0, 1).alias("valid"))


def abl_paired(s, d):
    return EX.paired_table(_ablation(s, d))


def prm_01(s, d):
    return M._once(s, d, "prm_01", lambda: EX.permutation_table(_permuted(s, d)))


def _permuted(s, d):
    features = [*K.NUMERIC_FEATURES, K.CATEGORY_FEATURE]
    return M._once(s, d, "prm_01_scores", lambda: EX.permuted_scores(_fit(s, d)(_train(s, d), X.CUTOFF), _test(s, d), features))


def prm_01_features(s, d):
    return prm_01(s, d).select("feature", F.col("caida_auc_media").between(-1, 1).alias("valid"))


def _versions(s, d):
    fit, rows = _fit(s, d), M.modelled(s, d)

    def build():
        jobs = {c: partial(fit, rows.where(F.col("academic_period") <= c), c) for c in VERSIONS}
        return EX.versions_scored(concurrently(s, jobs), _test(s, d))

    return M._once(s, d, "scm_01_scores", build)


def scm_01(s, d):
    return EX.version_summary(_versions(s, d), EX.version_sizes(M.modelled(s, d), VERSIONS))


def scm_01_periods(s, d):
    return scm_01(s, d).select("version", "train_size", F.col("n").alias("val_size"), "val_periods")


def scm_01_sizes(s, d):
    return scm_01(s, d).select("version", "n", F.round("prevalence", 6).alias("prevalence"))


def scm_01_roc(s, d):
    return ME.roc_points(_versions(s, d), ["version"])


def scm_01_pr(s, d):
    return ME.pr_points(_versions(s, d), ["version"])


def _fairness_scores(s, d):
    demo = FA.demographics(M.students(s, d), X.COHORTS).withColumnRenamed("legajo", "id")
    # stored with the attributes: the table and its checks read it once per subgroup
    return M._once(s, d, "fairness_scores", lambda: MO.score(_fit(s, d)(_train(s, d), X.CUTOFF), _test(s, d)).select(
        F.col("legajo").alias("id"), F.col("dropout_next").alias("y"), "p", "cod_carrera").join(demo, "id", "left"))


def fai_model(s, d):
    """Subgroup table on model scores."""
    return FA.subgroup_metrics(FA.by_attribute(_fairness_scores(s, d), {
        "sexo": "Sexo", "cohorte": "Cohorte de ingreso", "grupo_edad": "Edad al ingreso", "cod_carrera": "Carrera"}))


def sen_08(s, d):
    """Model quality with and without the completion rule in the label."""
    known = _label_rows(s, d)
    parts = [EX.label_table(scored, known[label], X.CUTOFF) for label, scored in _label_scores(s, d).items()]
    return parts[0].unionByName(parts[1])


def _label_rows(s, d):
    # stored: two fits, two scorings and both tables read it
    rows = M._once(s, d, "relabelled", lambda: SN.relabelled(
        M.panel(s, d), PN.activity(M.history(s, d)), ST.completed_students(M.progress(s, d))))
    return {label: EX.labelled_rows(rows, label) for label in ("lab_con_grad", "lab_sin_grad")}


def _label_scores(s, d):
    return _kept(s, d, "label_scores", lambda: concurrently(s, {
        label: partial(EX.label_scores, rows, label, X.CUTOFF, TEST, _fit(s, d)) for label, rows in _label_rows(s, d).items()}))


def sen_08_sizes(s, d):
    return M._once(s, d, "sen_08", lambda: sen_08(s, d)).select(
        "etiqueta", "n_filas_etiquetadas", "n_train", "n_test", "prevalencia_global", "prevalencia_test")


_ORIGINS = " UNION ALL ".join(f"SELECT '{c}' AS origin, '{t}' AS test_period" for c, t in SP.origins(TESTS))
_NAMES = " UNION ALL ".join(f"SELECT '{n}' AS model_name" for n in MO.TrainSpec().candidates)
_FEATURES = " UNION ALL ".join(f"SELECT '{f}' AS feature" for f in [*K.NUMERIC_FEATURES, K.CATEGORY_FEATURE])
_N = len(K.NUMERIC_FEATURES)
_HELD = P.shift_label(TEST, K.LABEL_HORIZON)
# both label definitions from the activity alone
_RELABELLED = """
    SELECT p.legajo, p.academic_period, p.at_risk,
      CASE WHEN p.n_ahead < 4 THEN NULL WHEN coalesce(p.max_ahead, 0) = 1 THEN 0
           WHEN c.legajo IS NOT NULL THEN 0 ELSE 1 END AS lab_con_grad,
      CASE WHEN p.n_ahead < 4 THEN NULL WHEN coalesce(p.max_ahead, 0) = 1 THEN 0 ELSE 1 END AS lab_sin_grad
    FROM panel_raw p LEFT JOIN completed c ON c.legajo = p.legajo"""
_LABEL_SIZES = " UNION ALL ".join(f"""
    SELECT '{lab}' AS etiqueta, count(*) AS n_filas_etiquetadas, count(*) FILTER (WHERE academic_period <= '{X.CUTOFF}') AS n_train,
      count(*) FILTER (WHERE academic_period = '{TEST}') AS n_test, round(avg({lab}), 4) AS prevalencia_global,
      round(avg({lab}) FILTER (WHERE academic_period = '{TEST}'), 4) AS prevalencia_test
    FROM relabelled WHERE at_risk = 1 AND {lab} IS NOT NULL""" for lab in ("lab_con_grad", "lab_sin_grad"))

QUERIES = {
    "fea_04_one_hot": (fea_04, with_ctes(f"""
        SELECT cod_carrera, (SELECT count(DISTINCT cod_carrera) FROM known) AS width,
          max(CASE WHEN cod_carrera IN (SELECT cod_carrera FROM known) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ones
        FROM modelled WHERE academic_period = '{TEST}' GROUP BY 1""", known=f"""
        SELECT cod_carrera FROM modelled WHERE academic_period <= '{X.CUTOFF}' AND cod_carrera <> 'Brand#7'""")),
    "mod_01_to_03_scored": (mod_scored, with_ctes(f"""
        SELECT model_name, academic_period, count(*) AS n, count(*) FILTER (WHERE dropout_next = 1) AS n_pos, count(*) AS n_valid
        FROM modelled, ({_NAMES}) m WHERE academic_period = '{TEST}' GROUP BY 1, 2""")),
    "mod_04_sizes": (mod_04_sizes, with_ctes(f"""
        SELECT model_name, (SELECT count(*) FROM modelled WHERE academic_period <= '{X.CUTOFF}') AS train_size,
          true AS auc_in_range, true AS one_selected FROM ({_NAMES}) m""")),
    "mod_06_features": (mod_06_features, f"SELECT feature, true AS adds_up FROM ({_FEATURES}) f"),
    "mod_07_versions": (mod_07_versions, with_ctes(f"""
        SELECT academic_period, 2::BIGINT AS version, count(*) AS n FROM modelled WHERE academic_period = '{TEST}' GROUP BY 1""")),
    "sco_03_keys": (sco_03_keys, with_ctes("""
        SELECT legajo, max(academic_period) AS academic_period, true AS valid, true AS class_ok FROM panel
        WHERE at_risk = 1 AND legajo IN (SELECT legajo FROM status WHERE status = 'estudiando') GROUP BY 1""")),
    "bkt_01_sizes": (bkt_01_sizes, with_ctes(f"""
        SELECT origin, test_period, count(*) FILTER (WHERE academic_period <= origin) AS n_train,
          count(*) FILTER (WHERE academic_period = test_period) AS n_test,
          round(avg(dropout_next) FILTER (WHERE academic_period = test_period), 4) AS prevalence
        FROM modelled, ({_ORIGINS}) o GROUP BY 1, 2""")),
    "bkt_02_sizes": (bkt_02_sizes, with_ctes(f"""
        SELECT c AS train_cutoff, '{TEST}' AS test_period, count(*) FILTER (WHERE academic_period <= c) AS n_train,
          count(*) FILTER (WHERE academic_period = '{TEST}') AS n_test
        FROM modelled, (SELECT unnest({CUTOFFS!r}) AS c) o GROUP BY 1""")),
    "bkt_03_sizes": (bkt_03_sizes, with_ctes(f"""
        SELECT '{TEST}' AS test_period, '{_HELD}' AS train_cutoff, (SELECT count(*) FROM tested) AS n_test,
          (SELECT count(*) FROM tested WHERE legajo IN (SELECT legajo FROM trained)) AS n_test_seen,
          (SELECT count(*) FROM tested WHERE legajo NOT IN (SELECT legajo FROM trained)) AS n_test_new,
          (SELECT count(*) FROM trained) AS n_train_full,
          (SELECT count(*) FROM trained WHERE legajo NOT IN (SELECT legajo FROM tested)) AS n_train_grouped""",
        trained=f"SELECT * FROM modelled WHERE academic_period <= '{_HELD}'",
        tested=f"SELECT * FROM modelled WHERE academic_period = '{TEST}'")),
    "abl_01_features": (abl_01_features, " UNION ALL ".join(
        f"SELECT '{v}' AS variante, {len(f) + 1}::BIGINT AS n_features, true AS valid" for v, f in EX.ABLATIONS.items())
        + " UNION ALL SELECT 'baseline recencia (solo dias)', 1::BIGINT, true"),
    "prm_01_features": (prm_01_features, f"SELECT feature, true AS valid FROM ({_FEATURES}) f"),
    "scm_01_sizes": (scm_01_sizes, with_ctes(f"""
        SELECT v AS version, count(*) AS n, round(avg(dropout_next), 6) AS prevalence
        FROM modelled, (SELECT unnest(['1995_2C', '1996_2C', '1997_1C']) AS v) o WHERE academic_period = '{TEST}' GROUP BY 1""")),
    "sen_08_sizes": (sen_08_sizes, with_ctes(_LABEL_SIZES, relabelled=_RELABELLED)),
    "scm_01_periods": (scm_01_periods, with_ctes(f"""
        SELECT v AS version, (SELECT count(*) FROM modelled WHERE academic_period <= v) AS train_size,
          (SELECT count(*) FROM modelled WHERE academic_period = '{TEST}') AS val_size, '{TEST}' AS val_periods
        FROM (SELECT unnest({list(VERSIONS)!r}) AS v) o""")),
    "mod_04_values": (mod_04_values, f"""
        SELECT 'mod_04' AS study, model_name AS part, unnest(['auc', 'brier']) AS figure, true AS agrees FROM ({_NAMES}) m
        UNION ALL SELECT 'mod_03', 'LogisticRegression', 'gradient', true"""),
    "mod_06_values": (mod_06_values, f"SELECT feature, true AS agrees FROM ({_FEATURES}) f"),
    "bkt_01_values": (bkt_01_values, f"""
        SELECT 'bkt_01' AS study, test_period AS part, unnest(['auc', 'brier', 'p_at_10']) AS figure, true AS agrees FROM ({_ORIGINS}) o"""),
    "bkt_02_values": (bkt_02_values, f"SELECT 'bkt_02' AS study, unnest({CUTOFFS!r}) AS part, 'auc' AS figure, true AS agrees"),
    "bkt_03_values": (bkt_03_values, with_ctes(f"""
        SELECT 'bkt_03' AS study, kind AS part, 'auc' AS figure, true AS agrees FROM (
          SELECT unnest(['full', 'grouped', CASE WHEN seen THEN 'seen' ELSE 'new' END]) AS kind, dropout_next FROM (
            SELECT dropout_next, legajo IN (SELECT legajo FROM modelled WHERE academic_period <= '{_HELD}') AS seen
            FROM modelled WHERE academic_period = '{TEST}') a) b
        GROUP BY kind HAVING count(DISTINCT dropout_next) = 2""")),
    "abl_01_values": (abl_01_values, "SELECT 'abl_01' AS study, part, figure, true AS agrees FROM (SELECT unnest([" + ", ".join(
        f"'{v}'" for v in EX.ABLATION_SCORES) + "]) AS part), (SELECT unnest(['auc', 'p_at_10']) AS figure)"),
    "abl_01_paired_values": (abl_paired_values, "SELECT 'abl_01' AS study, unnest([" + ", ".join(
        f"'{p[0]}'" for p in EX.PAIRS) + "]) AS part, 'delta' AS figure, true AS agrees"),
    "prm_01_values": (prm_01_values, f"""
        SELECT 'prm_01' AS study, '{K.RECENCY_FEATURE}' AS part, unnest(['drop', 'deviation']) AS figure, true AS agrees"""),
    "scm_01_values": (scm_01_values, f"""
        SELECT 'scm_01' AS study, part, figure, true AS agrees
        FROM (SELECT unnest({list(VERSIONS)!r}) AS part), (SELECT unnest(['auc', 'curve']) AS figure)"""),
    "sen_08_values": (sen_08_values, """
        SELECT 'sen_08' AS study, part, figure, true AS agrees
        FROM (SELECT unnest(['lab_con_grad', 'lab_sin_grad']) AS part), (SELECT unnest(['auc', 'brier', 'p_at_10']) AS figure)"""),
    "fai_02_model_values": (fai_model_values, "SELECT study, part, figure, agrees FROM (SELECT '' AS study, '' AS part, '' AS figure, true AS agrees) z WHERE false"),
    "mod_01_gradient_boosting": (_candidate("GradientBoosting"), None),
    "mod_02_random_forest": (_candidate("RandomForest"), None),
    "mod_03_logistic_regression": (_candidate("LogisticRegression"), None),
    "mod_04_competition": (mod_04, None),
    "mod_06_importances": (mod_06, None),
    "mod_07_save_load": (mod_07, None),
    "sco_03_score": (sco_03, None),
    "bkt_01_rolling_backtest": (bkt_01, None),
    "bkt_02_incremental": (bkt_02, None),
    "bkt_03_unseen_students": (bkt_03, None),
    "abl_01_ablation": (abl_01, None),
    "abl_01_paired": (abl_paired, None),
    "prm_01_permutation": (prm_01, None),
    "scm_01_versions": (scm_01, None),
    "scm_01_roc_curves": (scm_01_roc, None),
    "scm_01_pr_curves": (scm_01_pr, None),
    "fai_02_model_subgroups": (fai_model, None),
    "sen_08_label_models": (sen_08, None),
}
