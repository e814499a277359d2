"""Supervised classification and regression, clustering, and classes over years."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlore.functions import vectors as V
from gridlore.operators import labels as L
from gridlore.operators import models as M

SILHOUETTE_CAP = 5_000


@dataclass
class Fitted:
    """What a supervised operator learnt, with its reports."""

    bundle: M.Bundle
    report: str = ""
    warnings: list[str] = field(default_factory=list)
    balance: dict[str, Any] | None = None
    accuracy: Any = None
    search: dict[str, Any] | None = None


def _numbered(samples: DataFrame) -> DataFrame:
    return samples if "sample_id" in samples.columns else samples.withColumn("sample_id", F.xxhash64(*(F.col(c) for c in samples.columns if c != "embedding"), F.to_json(F.struct("embedding"))))


def cross_validate_classes(samples: DataFrame, classes: Sequence[Any], folds: int, seed: int, algorithm: str, n_estimators: int, **params: Any) -> DataFrame:
    """sample_id, code and prediction of every sample, by a model that has not seen it; folds are cut within classes."""
    dealt = L.folds(_numbered(samples), folds, seed, within="code")

    def fit(train: DataFrame, test: DataFrame) -> DataFrame:
        model = M.estimator("classifier", algorithm, n_estimators, seed, len(classes), **params).fit(M.features(train))
        return model.transform(M.features(test)).select("sample_id", "code", "fold", F.col("prediction").cast("int").alias("prediction"))

    return L.out_of_fold(dealt, folds, fit)


def cross_validate_values(samples: DataFrame, folds: int, seed: int, algorithm: str, n_estimators: int, **params: Any) -> DataFrame:
    """sample_id, label, fold and prediction; plain folds."""
    dealt = L.folds(_numbered(samples), folds, seed)

    def fit(train: DataFrame, test: DataFrame) -> DataFrame:
        model = M.estimator("regressor", algorithm, n_estimators, seed, **params).fit(M.features(train))
        return model.transform(M.features(test)).select("sample_id", "label", "fold", "prediction")

    return L.out_of_fold(dealt, folds, fit)


def _bands(samples: DataFrame) -> int:
    first = samples.select(F.size("embedding").alias("n")).first()
    if first is None:
        raise ValueError("no training samples")
    return first["n"]


def fit_classifier(samples: DataFrame, label: str = "label", algorithm: str = "rf", n_estimators: int = 200, seed: int = 42, accuracy_folds: int = 0, tune: bool = False, tune_iters: int = 10, load: str | None = None, save: str | None = None, **params: Any) -> Fitted:
    """Labels to codes, balance, optional search and accuracy report, then the fit; or a saved model."""
    if load:
        first = samples.select(F.size("embedding").alias("n")).first() if samples is not None else None
        saved = M.load_model(load)
        bundle, warnings = M.reuse_model(load, first["n"] if first else saved.n_bands, "classifier")
        return Fitted(bundle, warnings=list(warnings))
    bands = _bands(samples)
    coded, classes = L.encode(samples, label)
    if len(classes) < 2:
        raise ValueError("two classes or more are needed")
    counts = L.class_counts(coded, len(classes))
    balance = L.class_balance(counts, classes)
    sections, warnings, found, accuracy = [L.balance_text(balance, classes)], [], None, None
    if balance["imbalanced"]:
        warnings.append("the classes are lopsided")
    estimators = n_estimators
    if tune:

        def score(p: dict[str, Any]) -> float | None:
            p = dict(p)
            try:
                out = cross_validate_classes(coded, classes, L.tuning_folds(accuracy_folds), seed, algorithm, p.pop("n_estimators"), **p)
                return L.metrics(L.confusion(out, len(classes), "code")).first()["accuracy"]
            except Exception as e:  # a class too small for the folds: the trial has no score
                if "fewer than" not in str(e):
                    raise
                return None

        found = L.randomised_search(M.tuning_grid(algorithm), score, tune_iters, seed)
        if found:
            best = dict(found["params"])
            estimators, params = best.pop("n_estimators"), {**params, **best}
            sections.append(L.search_text(found))
        else:
            warnings.append("no parameters could be scored")
    folds = L.resolve_folds(accuracy_folds, min(balance["counts"]))
    if folds:
        table = L.confusion(cross_validate_classes(coded, classes, folds, seed, algorithm, estimators, **params), len(classes), "code")
        table = table.sparkSession.createDataFrame(table.collect(), table.schema)  # classes squared rows; the folds' models run once
        accuracy = L.metrics(table).first().asDict()
        per_class = [r.asDict() for r in L.class_metrics(table).orderBy("code").collect()]
        sections.append(L.accuracy_text(per_class, accuracy, L.confusion_matrix(table), classes))
    elif accuracy_folds > 0:
        warnings.append("too few samples for an accuracy report")
    model = M.estimator("classifier", algorithm, estimators, seed, len(classes), **params).fit(M.features(coded))
    bundle = M.Bundle(model, "classifier", bands, algorithm, list(classes))
    if save:
        try:
            M.save_model(bundle, save)
        except Exception as e:  # a map is worth more than its model's copy
            warnings.append(f"the model was not saved: {e}")
    return Fitted(bundle, "\n\n".join(sections), warnings, balance, accuracy, found)


def classify(pixels: DataFrame, fitted: Fitted, nodata: float | None = None, confidence: bool = False) -> DataFrame:
    """The pixels with code, label and, if asked for, confidence."""
    out = M.predict_classes(fitted.bundle.model, pixels, nodata, confidence)
    names = F.create_map(*(F.lit(x) for i, c in enumerate(fitted.bundle.classes or []) for x in (i, c))) if fitted.bundle.classes else None
    return out if names is None else out.withColumn("label", names[F.col("code")])


def fit_regressor(samples: DataFrame, target: str = "label", algorithm: str = "rf", n_estimators: int = 200, seed: int = 42, accuracy_folds: int = 0, tune: bool = False, tune_iters: int = 10, load: str | None = None, save: str | None = None, **params: Any) -> Fitted:
    """As fit_classifier, for a numeric target; a target that is no number is an error."""
    if load:
        saved = M.load_model(load)
        first = samples.select(F.size("embedding").alias("n")).first() if samples is not None else None
        bundle, warnings = M.reuse_model(load, first["n"] if first else saved.n_bands, "regressor")
        return Fitted(bundle, warnings=list(warnings))
    bands = _bands(samples)
    if samples.filter(V.finite_or_null(F.col(target).try_cast("double")).isNull()).limit(1).count():
        raise ValueError(f"{target} has values that are no numbers")
    numeric = samples.withColumn("label", F.col(target).cast("double"))
    sections, warnings, found, accuracy, estimators = [], [], None, None, n_estimators
    if tune:

        def score(p: dict[str, Any]) -> float | None:
            p = dict(p)
            return L.regression_metrics(cross_validate_values(numeric, L.tuning_folds(accuracy_folds), seed, algorithm, p.pop("n_estimators"), **p)).first()["r2"]

        found = L.randomised_search(M.tuning_grid(algorithm), score, tune_iters, seed)
        if found:
            best = dict(found["params"])
            estimators, params = best.pop("n_estimators"), {**params, **best}
            sections.append(L.search_text(found))
    folds = L.resolve_folds(accuracy_folds, numeric.count())
    if folds:
        out = cross_validate_values(numeric, folds, seed, algorithm, estimators, **params).persist()
        accuracy = L.regression_metrics(out).first().asDict()
        per_fold = [L.regression_metrics(out.filter(F.col("fold") == i)).first().asDict() for i in range(folds)]
        out.unpersist()
        sections.append(L.regression_text(accuracy, per_fold))
    elif accuracy_folds > 0:
        warnings.append("too few samples for an accuracy report")
    model = M.estimator("regressor", algorithm, estimators, seed, **params).fit(M.features(numeric))
    bundle = M.Bundle(model, "regressor", bands, algorithm)
    if save:
        try:
            M.save_model(bundle, save)
        except Exception as e:  # as above
            warnings.append(f"the model was not saved: {e}")
    return Fitted(bundle, "\n\n".join(sections), warnings, None, accuracy, found)


def regress(pixels: DataFrame, fitted: Fitted, nodata: float | None = None) -> DataFrame:
    return M.predict_values(fitted.bundle.model, pixels, nodata)


# ------------------------------------------------------------------ clusters


def subsample(df: DataFrame, n: int, seed: int = 42, keys: Sequence[str] = ("grid_id", "row", "col")) -> DataFrame:
    """The n rows of the least keyed hash, without replacement, the same ones every time.

    Of a large table only rows below a bound that leaves a little more than n of
    them are sorted, not n of every partition.
    """
    h = F.xxhash64(*keys, F.lit(seed))
    total = df.count()
    if total > 4 * n:
        bound = int(-(1 << 63) + (1 << 64) * min(1.0, (1.2 * n + 1000) / total))
        fewer = df.filter(h < F.lit(bound).cast("long")) if bound < (1 << 63) - 1 else df
        df = fewer if fewer.count() >= n else df
    return df.orderBy(h, *keys).limit(n)


def kmeans(sample: DataFrame, k: int, seed: int = 42, restarts: int = 10):
    """The model of least cost of several seeds."""
    rows = M.features(sample).select("features").persist()
    fit = lambda i: KMeans(k=k, seed=seed + i, featuresCol="features", predictionCol="code").fit(rows)
    tasks = [inheritable_thread_target(partial(fit, i)) for i in range(restarts)]  # each with its own copy of the local properties
    with ThreadPoolExecutor(4) as pool:  # the fits of small samples are mostly waiting for jobs
        fits = [t.result() for t in [pool.submit(task) for task in tasks]]
    rows.unpersist()
    return min(fits, key=lambda m: m.summary.trainingCost)


def silhouette(sample: DataFrame, block: int = 512) -> float:
    """The mean Euclidean silhouette of (embedding, code), exact over a sample of SILHOUETTE_CAP rows at most: blocks of rows against all."""
    held = sample.select(V.as_double("embedding").alias("e"), "code").limit(SILHOUETTE_CAP).toArrow()
    x, code = np.array(held.column("e").to_pylist()), held.column("code").to_numpy().astype(int)
    if len(np.unique(code)) < 2:
        raise ValueError("two clusters or more are needed")
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast((x, code))

    def part(batches):
        x, code = shared.value
        kinds, which = np.unique(code, return_inverse=True)
        member = np.eye(len(kinds))[which]
        size = member.sum(axis=0)
        square = (x * x).sum(axis=1)
        for batch in batches:
            for a in batch.column("id").to_pylist():
                rows = slice(a * block, (a + 1) * block)
                d = np.sqrt(np.maximum(square[rows, None] + square[None, :] - 2 * x[rows] @ x.T, 0))
                d[np.arange(len(d)), np.arange(a * block, a * block + len(d))] = 0
                sums, own = d @ member, which[rows]
                at = np.arange(len(own))
                inner = sums[at, own] / np.maximum(size[own] - 1, 1)
                mean = sums / size
                mean[at, own] = np.inf
                outer = mean.min(axis=1)
                s = np.where(size[own] > 1, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300), 0.0)
                yield pa.RecordBatch.from_pydict({"s": [float(s.sum())]})

    blocks = -(-len(x) // block)
    return spark.range(blocks).repartition(blocks).mapInArrow(part, "s double").agg(F.sum("s")).first()[0] / len(x)


def choose_k(sample: DataFrame, k_min: int = 2, k_max: int = 10, seed: int = 42, keys: Sequence[str] = ("grid_id", "row", "col"), restarts: int = 10) -> tuple[int, list[tuple[int, float]]]:
    """The k of the best silhouette (the first of equals) and all scores."""
    held = subsample(sample, SILHOUETTE_CAP, seed, keys).persist()
    n, scores = held.count(), []
    for k in range(max(2, k_min), min(k_max, n - 1) + 1):
        coded = kmeans(held, k, seed, restarts).transform(M.features(held))
        if coded.select("code").distinct().count() > 1:
            scores.append((k, silhouette(coded.select("embedding", "code"))))
    held.unpersist()
    if not scores:
        raise ValueError("no number of clusters could be scored")
    return max(scores, key=lambda s: (s[1], -s[0]))[0], scores


def cluster(pixels: DataFrame, n_clusters: int = 6, max_samples: int = 100_000, seed: int = 42, tune_k: bool = False, k_min: int = 2, k_max: int = 10, nodata: float | None = None, keys: Sequence[str] = ("grid_id", "row", "col"), restarts: int = 10) -> tuple[DataFrame, Any]:
    """The pixels with code (NULL where invalid), and the model, fitted on max_samples valid pixels at most."""
    good = pixels.filter(V.valid("embedding", nodata))
    sample = subsample(good, max_samples, seed, keys).persist()
    n = sample.count()
    k = choose_k(sample, k_min, k_max, seed, keys, restarts)[0] if tune_k else n_clusters
    if n < k:
        raise ValueError("fewer valid pixels than clusters")
    model = kmeans(sample, k, seed, restarts)
    sample.unpersist()
    coded = model.transform(M.features(good)).select(*pixels.columns, "code")
    rest = pixels.filter(~V.valid("embedding", nodata)).withColumn("code", F.lit(None).cast("int"))
    return coded.unionByName(rest), model


# ------------------------------------------------------------------ classes over years


def classify_years(pixels: DataFrame, years: Sequence[int], samples: DataFrame | None, nodata: float | None = None, confidence: bool = False, transition: bool = False, changed: bool = False, keys: Sequence[str] = ("grid_id", "row", "col"), **options: Any) -> dict[str, Any]:
    """One model, of samples from the latest year, on every year; and what changed from the first year to the last.

    samples: embedding and label of the latest year's pixels.  Returns fitted,
    classes (with year), and on request transition, changed and legend.
    """
    wanted = sorted(set(years))
    if len(wanted) < 2:
        raise ValueError("two years or more are needed")
    fitted = fit_classifier(samples, **options)
    used = pixels.filter(F.col("year").isin(wanted))
    classes = classify(used, fitted, nodata, confidence)
    out: dict[str, Any] = {"fitted": fitted, "classes": classes}
    if transition or changed:
        # of that year's pixels alone: no filter gets below a prediction
        of = lambda y: classify(pixels.filter(F.col("year") == y), fitted, nodata).select(*keys, F.coalesce("code", F.lit(L.NO_CLASS)).alias("code"))
        first, last = of(wanted[0]), of(wanted[-1])
        if transition:
            out["transition"] = L.transition_codes(first, last, len(fitted.bundle.classes), keys=keys)
            out["legend"] = L.transition_labels(fitted.bundle.classes)
        if changed:
            out["changed"] = L.changed_mask(first, last, keys=keys)
    return out
