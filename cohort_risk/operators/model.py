"""Risk model with Spark ML.

* split: stratified 80/20 by an exact per-class cut on a seeded row hash, found by
  histograms that narrow it (grouped partial aggregates, skew safe), so no window
  runs over a whole class.
* scaling: population standard deviation (scikit-learn semantics), fitted on
  the training rows and stored *inside* the PipelineModel as a
  ``SQLTransformer`` with the fitted constants, so a saved model carries its
  scaler and feature list.
* classifiers: RandomForest (100 trees, depth 10) natively; gradient boosting
  (100 rounds, depth 6, step 0.1) with the softmax objective (``boosting``).
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import rules as R
from ..session import scratch_path
from . import boosting as B
from . import quality as Q

LABEL = "risk_score"
DEFAULT_MODEL = "gbt"
READ_ROWS = 10_000
#: Rows of a partition at least when training rows are dealt out to more cores.
DEALT_ROWS = 50_000


# ------------------------------------------------------------------ split ----


def _unit_hash(id_col: str, seed: int):
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit(seed))
    return (F.pmod(h, F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30)))


def _class_cuts(tagged: DataFrame, label: str, probs: list[float], accuracy: int) -> dict:
    """Per class, the quantiles of the row hash ``_u``: one grouped partial
    aggregate, one row per class (three risk classes)."""
    cuts = tagged.filter(F.col(label).isNotNull()).groupBy(label).agg(F.percentile_approx("_u", probs, accuracy).alias("_cuts"))
    return {r[label]: list(r["_cuts"]) for r in cuts.collect()}


def test_counts(sizes: dict, fraction: float = S.TEST_FRACTION) -> dict:
    """Test rows per class: the whole test side is ceil(fraction * rows), shared out in
    proportion, what rounding leaves over going to the largest remainders (ties: the
    smaller class)."""
    total = sum(sizes.values())
    drawn = math.ceil(fraction * total)
    out = {k: n * drawn // total for k, n in sizes.items()}
    order = sorted(sizes, key=lambda k: (-(sizes[k] * drawn % total), k))
    for k in order[: drawn - sum(out.values())]:
        out[k] += 1
    return out


def nth_rows(tagged: DataFrame, label: str, id_col: str, wanted: dict) -> dict:
    """Per class the (hash, id) of its n-th row in the order of (``_h``, id), n > 0.
    Passes narrow the hash by 12 bits each, with one histogram of at most 4096 bins per
    class, until a class's bin is small enough to be read."""
    found, prefix = {}, {k: None for k in wanted}
    left = dict(wanted)
    for shift in (52, 40, 28, 16, 4):
        still = [k for k in prefix if k not in found]
        if not still:
            break
        inside = None
        for k in still:
            cond = F.col(label) == k
            if prefix[k] is not None:
                cond = cond & (F.shiftright("_h", shift + 12) == prefix[k])
            inside = cond if inside is None else inside | cond
        bins: dict = {k: {} for k in still}
        for r in tagged.filter(inside).groupBy(F.col(label).alias("k"), F.shiftright("_h", shift).alias("b")).count().collect():
            bins[r["k"]][r["b"]] = r["count"]
        for k in still:
            for b in sorted(bins[k]):
                if left[k] <= bins[k][b]:
                    break
                left[k] -= bins[k][b]
            prefix[k] = b
            if bins[k][b] <= READ_ROWS:
                rows = tagged.filter((F.col(label) == k) & (F.shiftright("_h", shift) == b)).select("_h", id_col).collect()
                found[k] = sorted((r[0], r[1]) for r in rows)[left[k] - 1]
    for k in prefix:
        if k not in found:  # 16 hashes with many rows: repeated ids, which are not parted
            near = tagged.filter((F.col(label) == k) & (F.shiftright("_h", 4) == prefix[k])).groupBy("_h").agg(F.count("*").alias("n"), F.max(id_col).alias("id"))
            for h, n, last in sorted(tuple(r) for r in near.collect()):
                found[k] = (h, last)
                if left[k] <= n:
                    break
                left[k] -= n
    return found


def split_flag(df: DataFrame, label: str = LABEL, id_col: str = "student_id", test_fraction: float = S.TEST_FRACTION,
               seed: int = S.SEED) -> DataFrame:
    """Adds ``is_test``: stratified 80/20 assignment (H1), exact: the rows of a class
    are ordered by a seeded hash of their id (then the id) and the first
    ``test_counts`` of them are the test side. The cuts enter the plan as literals, so
    the table isn't moved. Rows that share an id fall on the same side."""
    name = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    tagged = df.filter(F.col(label).isNotNull()).withColumns({"_i": name, "_h": F.xxhash64(name, F.lit(seed))})
    sizes = {r["k"]: r["count"] for r in tagged.groupBy(F.col(label).alias("k")).count().collect()}
    wanted = {k: n for k, n in test_counts(sizes, test_fraction).items() if n} if sizes else {}
    test = F.lit(False)
    for k, (h, last) in nth_rows(tagged, label, "_i", wanted).items():
        test = test | ((F.col(label) == k) & ((F.col("_h") < h) | ((F.col("_h") == h) & (F.col("_i") <= last))))
    return tagged.withColumn("is_test", test).drop("_h", "_i")


def stratified_split(df: DataFrame, label: str = LABEL, id_col: str = "student_id", test_fraction: float = S.TEST_FRACTION,
                     seed: int = S.SEED) -> tuple[DataFrame, DataFrame]:
    """(train, test) from ``split_flag``."""
    flagged = split_flag(df, label, id_col, test_fraction, seed)
    return flagged.filter(~F.col("is_test")).drop("is_test"), flagged.filter(F.col("is_test")).drop("is_test")


def fold_column(df: DataFrame, k: int = S.CV_FOLDS, id_col: str = "student_id", seed: int = S.SEED, label: str = LABEL,
                accuracy: int = 100000) -> DataFrame:
    """Stratified fold number 0..k-1: each class is cut into k equal parts of a
    seeded row hash (cuts as literals)."""
    tagged = df.filter(F.col(label).isNotNull()).withColumn("_u", _unit_hash(id_col, seed + 1))
    fold = None
    for y, cuts in _class_cuts(tagged, label, [i / k for i in range(1, k)], accuracy).items():
        number = F.lit(0)
        for c in cuts:
            number = number + (F.col("_u") > F.lit(c)).cast("int")
        fold = F.when(F.col(label) == y, number) if fold is None else fold.when(F.col(label) == y, number)
    return tagged.withColumn("fold", F.lit(0) if fold is None else fold).drop("_u")


# ---------------------------------------------------------------- scaling ----


def standardize_exprs(train: DataFrame, features: list[str], with_medians: bool = False) -> dict[str, str]:
    """Fit (mean, population std) on the training rows in one aggregate and
    return the SQL expressions (x - mean) / std, std 0 -> 1 (H2, T9). Medians are exact
    (the lower one of an even number of values) and selected in bounded memory."""
    aggs = []
    for c in features:
        aggs += [F.avg(F.col(c).cast("double")).alias(f"m_{c}"), F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}")]
    stats = train.agg(*aggs).first()  # one row of 2 x #features numbers
    medians = Q.column_medians(train, features, missing_only=False, lower=True) if with_medians else {}
    exprs = {}
    for c in features:
        m = stats[f"m_{c}"] or 0.0
        s = stats[f"s_{c}"] or 0.0
        s = s if s > 0 else 1.0
        value = f"CAST({c} AS DOUBLE)"
        if with_medians:  # the training median travels with the saved model (T22)
            value = f"coalesce(nanvl({value}, NULL), {float(medians[c] or 0.0)!r})"
        exprs[c] = f"({value} - {m!r}) / {s!r}"
    return exprs


def standardize(df: DataFrame, features: list[str]) -> DataFrame:
    """Standardise on the table's own statistics (used by the SQL-checked query)."""
    return df.withColumns({c: F.expr(e) for c, e in standardize_exprs(df, features).items()})


# ------------------------------------------------------------------ model ----


@dataclass
class TrainResult:
    model: PipelineModel
    features: list[str]
    model_type: str
    accuracy: float | None = None


def _scaler(train: DataFrame, features: list[str]) -> SQLTransformer:
    exprs = standardize_exprs(train, features, with_medians=True)
    cols = ", ".join(f"{e} AS scaled_{c}" for c, e in exprs.items())
    return SQLTransformer(statement=f"SELECT *, {cols} FROM __THIS__")


def _boost(scaled: DataFrame, features: list[str], **folds) -> tuple:
    p = S.GBT_PARAMS
    return B.fit(scaled, [f"scaled_{c}" for c in features], LABEL, rounds=p["maxIter"], depth=p["maxDepth"], eta=p["stepSize"], **folds)


def fit_model(train: DataFrame, features: list[str], model_type: str) -> PipelineModel:
    """Scaler and classifier fitted on all rows of ``train``."""
    scaler = _scaler(train, features)
    if model_type == "gbt":
        (rounds,), _ = _boost(scaler.transform(train), features)
        scaled = [f"scaled_{c}" for c in features]
        return PipelineModel([scaler, B.BoostedTrees(B.node_rows(rounds, scaled), scaled)])
    assembler = VectorAssembler(inputCols=[f"scaled_{c}" for c in features], outputCol="features", handleInvalid="error")
    # cacheNodeIds: same trees, fewer passes for deep trees (node ids are
    # checkpointed to the shared checkpoint folder every 10 iterations).
    forest = RandomForestClassifier(labelCol=LABEL, featuresCol="features", seed=S.SEED, cacheNodeIds=True, **S.RF_PARAMS)
    return Pipeline(stages=[scaler, assembler, forest]).fit(train)


def check_classes(df: DataFrame, label: str = LABEL) -> None:
    """Classes 0, 1, 2 must all occur in the training rows."""
    present = df.agg(*[F.max((F.col(label) == k).cast("int")).alias(f"k{k}") for k in (0, 1, 2)]).first()
    missing = [k for k in (0, 1, 2) if not present[f"k{k}"]]
    if missing:
        raise ValueError(f"training rows lack risk classes {missing}; all of 0, 1, 2 are required")


def _narrow(prepared: DataFrame, features: list[str]) -> DataFrame:
    """Id, label and features only: what a fit has to keep in memory."""
    return prepared.select("student_id", F.col(LABEL).cast("double").alias(LABEL), *features)


def dealt_out(rows: DataFrame) -> DataFrame:
    """``rows`` in about equal parts for all cores where their files put them into few (a
    large row group is one task in every pass of a fit, however many cores there are). A part
    has ``B.MANY_ROWS`` rows at most then: a forest's fit holds some 900 bytes of each at once."""
    held = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    cores, total = rows.sparkSession.sparkContext.defaultParallelism, sum(held)
    wanted = min(cores * -(-total // (cores * B.MANY_ROWS)), total // DEALT_ROWS)
    return rows.repartition(wanted) if wanted > 1 and max(held) * wanted > 2 * total else rows


def train(prepared: DataFrame, model_type: str = DEFAULT_MODEL) -> tuple[TrainResult, DataFrame]:
    """Split, fit, and score the held-out rows (H1-H5). Returns the result
    and the scored test rows."""
    features = Q.usable_features(prepared)
    tr, te = stratified_split(_narrow(prepared, features))
    # The training rows are read by the scaler fit, the class check and the
    # classifier; keep them instead of recomputing the split each time
    # (a lost cached block is recomputed from lineage).
    tr = dealt_out(tr).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        check_classes(tr)
        model = fit_model(tr, features, model_type)
    finally:
        tr.unpersist()
    scored_test = score(model, te)
    acc = scored_test.agg(F.avg((F.col("prediction") == F.col(LABEL)).cast("double"))).first()[0]
    return TrainResult(model, features, model_type, acc), scored_test


def score(model: PipelineModel, prepared: DataFrame) -> DataFrame:
    """Predictions with category and predicted-class probability."""
    out = model.transform(prepared)
    probs = vector_to_array(F.col("probability"))
    return out.withColumns(
        {
            "prediction_score": F.col("prediction").cast("int"),
            "predicted_category": R.model_category(F.col("prediction").cast("int")),
            "risk_probability_model": F.element_at(probs, F.col("prediction").cast("int") + 1) * 100,
            "p_high_risk": F.element_at(probs, 3) * 100,
        }
    ).drop("features", *[c for c in out.columns if c.startswith("scaled_")])


def feature_importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """(feature, importance) sorted descending, summing to 1 (H10): impurity decrease
    of the forest, mean gain per split of the boosted trees."""
    clf = model.stages[-1]
    if isinstance(clf, B.BoostedTrees):
        return [(f.removeprefix("scaled_"), v) for f, v in clf.importances()]
    imp = clf.featureImportances.toArray().tolist()
    total = sum(imp) or 1.0
    return sorted(((f, v / total) for f, v in zip(features, imp)), key=lambda x: (-x[1], x[0]))


def node_relation(spark, model: PipelineModel) -> DataFrame:
    """The trees as a relation: a row per node with feature, gain, number of rows and
    children. ``gain`` is the impurity decrease of a forest's split and the gain in the
    objective of a boosted one."""
    clf = model.stages[-1]
    if isinstance(clf, B.BoostedTrees):
        nodes = clf.node_frame(spark)
        return nodes.select((F.col("round") * clf.classes + F.col("class")).alias("tree"), "node", F.regexp_replace("feature", "^scaled_", "").alias("feature"), "threshold", "gain", F.col("n").cast("double").alias("n"), "left", "right", "value")
    path = scratch_path(spark, f"nodes/{uuid.uuid4().hex[:12]}")
    clf.write().save(path)  # the forest's own format is a relation of nodes
    name = F.array(*[F.lit(f) for f in model_features(model)])
    nodes = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    inner = F.col("leftChild") >= 0
    counts = F.aggregate("impurityStats", F.lit(0.0), lambda a, x: a + x)
    return nodes.select(
        "tree", F.col("id").alias("node"), F.when(inner, F.get(name, F.col("split.featureIndex"))).alias("feature"),
        F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"), F.when(inner, F.col("gain")).alias("gain"), counts.alias("n"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"), F.when(~inner, F.col("prediction")).alias("value"),
    )


def importance_by_nodes(nodes: DataFrame, features: list[str], boosted: bool) -> DataFrame:
    """Importances computed from the node relation: per tree the gains weighted by rows, as
    shares, averaged over the trees (forest); mean gain per split (boosting)."""
    splits = nodes.filter("feature IS NOT NULL")
    if boosted:
        found = splits.groupBy("feature").agg(F.avg("gain").alias("v"))
    else:
        per_tree = splits.groupBy("tree", "feature").agg(F.sum(F.col("gain") * F.col("n")).alias("v"))
        whole = per_tree.groupBy("tree").agg(F.sum("v").alias("whole"))
        found = per_tree.join(whole, "tree").filter("whole > 0").groupBy("feature").agg(F.sum(F.col("v") / F.col("whole")).alias("v"))
    every = nodes.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    both = every.join(found, "feature", "left").na.fill(0.0, ["v"])
    total = both.agg(F.sum("v").alias("total"))
    return both.join(F.broadcast(total)).select("feature", (F.col("v") / F.greatest("total", F.lit(1e-300))).alias("importance"))  # one row


def importance_frame(spark, model: PipelineModel, features: list[str]) -> DataFrame:
    rows = feature_importance(model, features)
    return spark.createDataFrame([(i + 1, f, float(v)) for i, (f, v) in enumerate(rows)], "rank int, feature string, importance double")


def explanation(df: DataFrame, importances: list[tuple[str, float]]) -> DataFrame:
    """Per student: feature values, the global top-5 importances and the top-3
    features above 0.1 (H11; global importance, not a per-student
    attribution). The ranking is a literal of at most #features entries."""
    top5 = F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(v).alias("importance")) for f, v in importances[:5]])
    factors = F.array(*[F.lit(f) for f, v in importances[:3] if v > 0.1]) if any(v > 0.1 for _, v in importances[:3]) else F.array().cast("array<string>")
    feats = [f for f, _ in importances]
    values = F.map_from_arrays(F.array(*[F.lit(f) for f in feats]), F.array(*[F.col(f).cast("double") for f in feats]))
    return df.select("student_id", values.alias("feature_values"), top5.alias("top_features"), factors.alias("risk_factors"))


def cross_validate(prepared: DataFrame, model_type: str = DEFAULT_MODEL, k: int = S.CV_FOLDS) -> dict:
    """k-fold accuracy on the training rows: mean and population std (H6).
    The k fits are independent Spark jobs and are submitted concurrently
    (the scheduler interleaves their tasks); results do not depend on it."""
    from concurrent.futures import ThreadPoolExecutor

    features = Q.usable_features(prepared)
    data = fold_column(_narrow(prepared, features)).persist(StorageLevel.MEMORY_AND_DISK)
    if model_type == "gbt":  # all folds are boosted in the same jobs, on features scaled as the training rows
        try:
            _, held = _boost(_scaler(data, features).transform(data), features, fold="fold", folds=k)
        finally:
            data.unpersist()
        return _cv_summary([right / n if n else None for n, right in held])

    def fold(i: int) -> float:
        tr = data.filter(F.col("fold") != i)
        te = data.filter(F.col("fold") == i)
        m = fit_model(tr, features, model_type)
        return m.transform(te).agg(F.avg((F.col("prediction") == F.col(LABEL)).cast("double"))).first()[0]

    try:
        with ThreadPoolExecutor(max_workers=k) as pool:
            accs = list(pool.map(fold, range(k)))
    finally:
        data.unpersist()
    return _cv_summary(accs)


def _cv_summary(scores: list[float | None]) -> dict:
    """Mean and population std over the folds that hold rows."""
    known = [a for a in scores if a is not None]
    mean = sum(known) / len(known)
    return {"cv_scores": scores, "cv_mean": mean, "cv_std": (sum((a - mean) ** 2 for a in known) / len(known)) ** 0.5}


# ------------------------------------------------------------ persistence ----


def save(result: TrainResult, path: str) -> None:
    """Model, scaler and feature list in one PipelineModel directory."""
    result.model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_features(model: PipelineModel) -> list[str]:
    last = model.stages[-1]
    columns = last.features if isinstance(last, B.BoostedTrees) else model.stages[1].getInputCols()
    return [c.removeprefix("scaled_") for c in columns]


def model_type_of(model: PipelineModel) -> str:
    return "gbt" if isinstance(model.stages[-1], B.BoostedTrees) else "random_forest"


def load_or_train(spark, path: str, training: DataFrame, model_type: str = DEFAULT_MODEL) -> PipelineModel:
    """Load the saved model, or train on ``training`` and save when there is none
    (H12). A saved model that can't be read, or is of another type, is an
    error and stays as it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/metadata")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        result, _ = train(training, model_type)
        save(result, path)
        return result.model
    model = load(path)
    if model_type_of(model) != model_type:
        raise ValueError(f"the model saved at {path} is {model_type_of(model)}, not {model_type}")
    return model


def training_report(prepared: DataFrame, model_type: str = DEFAULT_MODEL, k: int = S.CV_FOLDS) -> dict:
    """What training prints (H6-H10): held-out accuracy, cross-validation mean
    and deviation on the training rows, the classification report and the
    confusion matrix of the held-out rows, and the importances."""
    from . import evaluation as EV

    result, test = train(prepared, model_type)
    pairs = test.select(F.col(LABEL).cast("int").alias("label"), F.col("prediction_score").alias("prediction"))
    cv = cross_validate(stratified_split(_narrow(prepared, result.features))[0], model_type, k)
    return {
        "model": result, "accuracy": result.accuracy, "cv_mean": cv["cv_mean"], "cv_std": cv["cv_std"],
        "report": EV.classification_report(pairs), "confusion": EV.confusion_matrix(pairs),
        "importances": feature_importance(result.model, result.features),
    }


def score_new(model: PipelineModel, raw: DataFrame, medians: dict[str, float] | None = None) -> DataFrame:
    """Score new rows with the model's own feature list (T22): absent features
    become typed NULLs; NULLs take the training medians saved with the model
    (or the given ones)."""
    feats = model_features(model)
    df = R.nan_to_null(raw)
    for c in feats:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("double"))
    if medians:
        df = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(medians.get(c))) for c in feats})
    return score(model, df)


def score_for_dashboard(model: PipelineModel, prepared: DataFrame) -> DataFrame:
    """The table the dashboards read: the rule label is replaced by the model
    prediction, ``risk_category`` follows it and ``risk_probability`` is the
    predicted class's probability x 100, as in the application (survey fact
    3); ``p_high_risk`` is kept as its own, clearly named column."""
    out = score_new(model, prepared)
    return out.withColumns(
        {
            "risk_score": F.col("prediction_score"),
            "risk_category": F.col("predicted_category"),
            "risk_probability": F.col("risk_probability_model"),
        }
    ).drop("prediction", "rawPrediction", "probability", "prediction_score", "predicted_category", "risk_probability_model")
