"""Labels, folds, metrics, transitions and parameter search."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

IMBALANCE = 10.0
NO_CLASS = -1


def encode(samples: DataFrame, label: str = "label") -> tuple[DataFrame, list[Any]]:
    """code 0..k-1 by the sorted order of the labels, and the labels; NULL labels and empty tables are errors."""
    rows = samples.select(label).distinct().collect()  # one row a class
    names = [r[0] for r in rows]
    if not names:
        raise ValueError("no labels")
    if any(n is None for n in names):
        raise ValueError("a label is NULL")
    names.sort()
    table = samples.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], samples.select(F.col(label).alias("_label")).schema.add("code", T.IntegerType()))
    return samples.join(F.broadcast(table), F.col(label) == F.col("_label")).drop("_label"), names


def class_counts(samples: DataFrame, classes: int, code: str = "code") -> DataFrame:
    """code and n for every class, 0 for empty ones; a code outside 0..classes-1 is an error."""
    bad = (F.col(code) < 0) | (F.col(code) >= classes)
    checked = samples.select(F.when(bad, F.raise_error(F.lit("a class code is out of range")).cast("int")).otherwise(F.col(code)).cast("int").alias("code"))
    known = samples.sparkSession.range(classes).select(F.col("id").cast("int").alias("code"))
    return known.join(checked.groupBy("code").count(), "code", "left").select("code", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def class_balance(counts: DataFrame, classes: Sequence[Any]) -> dict[str, Any]:
    """Total, fractions, rarest and commonest class (the first of equals), empty classes, their ratio and whether it is lopsided."""
    n = [r["n"] for r in counts.orderBy("code").collect()]
    total = sum(n)
    if not total:
        raise ValueError("no samples")
    low, high = min(range(len(n)), key=lambda i: (n[i], i)), min(range(len(n)), key=lambda i: (-n[i], i))
    empty = [classes[i] for i, x in enumerate(n) if x == 0]
    ratio = float("inf") if empty else n[high] / n[low]
    return {"total": total, "counts": n, "fractions": [x / total for x in n], "rarest": classes[low], "commonest": classes[high], "empty": empty, "ratio": ratio, "imbalanced": ratio >= IMBALANCE}


def folds(samples: DataFrame, k: int, seed: int | None = 42, key: str = "sample_id", within: str | None = None) -> DataFrame:
    """fold 0..k-1, contiguous pieces of a keyed shuffle (of the order of `key` for seed None), the first n mod k one row larger.

    within: the class column of a stratified split, which cuts each class on its
    own; a class of fewer than k rows is an error.
    """
    if k < 2:
        raise ValueError("two folds or more")
    if seed is not None:
        order = [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)]
        part = F.shiftright(order[0], 54)  # 1,024 ranges of the hash
    else:
        order, part = [F.col(key)], _ranges(samples, key)
    group = F.lit(0) if within is None else F.col(within)
    parted = samples.withColumns({"_group": group, "_part": part})
    held = parted.groupBy("_group", "_part").count().collect()  # 1,024 rows a class at most
    total: dict[Any, int] = {}
    rows = []
    for r in sorted(held, key=lambda r: r["_part"]):
        rows.append((r["_group"], r["_part"], total.get(r["_group"], 0)))
        total[r["_group"]] = total.get(r["_group"], 0) + r["count"]
    if not total or min(total.values()) < k:
        raise ValueError(f"a class has fewer than {k} samples" if within is not None else "fewer samples than folds")
    before = samples.sparkSession.createDataFrame([(*r, total[r[0]]) for r in rows], parted.select(F.col("_group").alias("_g"), F.col("_part").alias("_p")).schema.add("_before", T.LongType()).add("_n", T.LongType()))
    placed = parted.join(F.broadcast(before), F.col("_group").eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_group", "_part").orderBy(*order)) - 1
    big, small = F.col("_n") % k, F.floor(F.col("_n") / k)
    edge = big * (small + 1)
    fold = F.when(place < edge, F.floor(place / (small + 1))).otherwise(big + F.floor((place - edge) / small))
    return placed.withColumn("fold", fold.cast("int")).drop("_group", "_part", "_g", "_p", "_before", "_n")


def _ranges(samples: DataFrame, key: str):
    """A number for ranges of a column in its order: bounds are constants, so every run deals the rows alike."""
    if not isinstance(samples.schema[key].dataType, T.NumericType):
        return F.lit(0)
    shares = [i / 64 for i in range(1, 64)]
    bounds = samples.agg(F.percentile_approx(F.col(key), shares, 1000)).first()[0] or []
    return F.size(F.filter(F.lit([float(b) for b in sorted(set(bounds))]).cast("array<double>"), lambda b: b < F.col(key))) if bounds else F.lit(0)


def out_of_fold(samples: DataFrame, k: int, fit_predict: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Predictions of every fold by what fit_predict learns from the others; each row once."""
    out = None
    for i in range(k):
        part = fit_predict(samples.filter(F.col("fold") != i), samples.filter(F.col("fold") == i))
        out = part if out is None else out.unionByName(part)
    return out


def confusion(predictions: DataFrame, classes: int, truth: str = "label", predicted: str = "prediction") -> DataFrame:
    """truth, predicted and n for every pair of classes; a code out of range or NULL is an error."""
    ok = lambda c: F.coalesce((F.col(c) >= 0) & (F.col(c) < classes), F.lit(False))
    checked = lambda c, name: F.when(~ok(c), F.raise_error(F.lit("a class code is out of range")).cast("int")).otherwise(F.col(c)).cast("int").alias(name)
    counted = predictions.select(checked(truth, "truth"), checked(predicted, "predicted")).groupBy("truth", "predicted").count()
    every = predictions.sparkSession.range(classes * classes).select((F.col("id") / classes).cast("int").alias("truth"), (F.col("id") % classes).cast("int").alias("predicted"))
    return every.join(counted, ["truth", "predicted"], "left").select("truth", "predicted", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def confusion_matrix(table: DataFrame) -> list[list[int]]:
    rows = table.collect()
    k = 1 + max(r["truth"] for r in rows)
    out = [[0] * k for _ in range(k)]
    for r in rows:
        out[r["truth"]][r["predicted"]] = r["n"]
    return out


def class_metrics(table: DataFrame) -> DataFrame:
    """code, support, precision, recall and f1 from a confusion table; 0 where a divisor is 0."""
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    by_truth = table.groupBy(F.col("truth").alias("code")).agg(F.sum("n").alias("support"), F.sum(hit).alias("hits"))
    by_guess = table.groupBy(F.col("predicted").alias("code")).agg(F.sum("n").alias("guessed"))
    both = by_truth.join(by_guess, "code").withColumns({"precision": share(F.col("hits"), F.col("guessed")), "recall": share(F.col("hits"), F.col("support"))})
    return both.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("code", "support", "precision", "recall", "f1")


def metrics(table: DataFrame) -> DataFrame:
    """One row: accuracy, and macro and support-weighted precision, recall and f1."""
    names = ("precision", "recall", "f1")
    total = F.sum("support")
    macro = [F.avg(c).alias(f"macro_{c}") for c in names]
    weighted = [F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), total), F.lit(0.0)).alias(f"weighted_{c}") for c in names]
    accuracy = F.coalesce(F.try_divide(F.sum(F.col("recall") * F.col("support")), total), F.lit(0.0)).alias("accuracy")
    return class_metrics(table).agg(accuracy, *macro, *weighted)


def regression_metrics(predictions: DataFrame, truth: str = "label", predicted: str = "prediction") -> DataFrame:
    """One row: n, r2 (0 where the truth does not vary), rmse and mae; an empty table is an error."""
    y, p = F.col(truth).cast("double"), F.col(predicted).cast("double")
    got = predictions.agg(
        F.count("*").alias("n"), F.sum(F.pow(y - p, F.lit(2.0))).alias("_res"), (F.var_pop(y) * F.count("*")).alias("_tot"), F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg(F.pow(y - p, F.lit(2.0)))).alias("rmse")
    )
    n = F.when(F.col("n") == 0, F.raise_error(F.lit("no predictions")).cast("long")).otherwise(F.col("n"))
    return got.select(n.alias("n"), F.when(F.col("_tot") > 0, 1 - F.col("_res") / F.col("_tot")).otherwise(0.0).alias("r2"), "rmse", "mae")


def transition_codes(first: DataFrame, last: DataFrame, classes: int, nodata: int = NO_CLASS, keys: Sequence[str] = ("grid_id", "row", "col"), code: str = "code") -> DataFrame:
    """keys and transition = first * classes + last, nodata where either is; other codes out of range are errors."""
    joined = first.select(*keys, F.col(code).alias("a")).join(last.select(*keys, F.col(code).alias("b")), list(keys))
    bad = lambda c: (F.col(c) < 0) | (F.col(c) >= classes)
    value = F.when((F.col("a") == nodata) | (F.col("b") == nodata), F.lit(nodata)).when(bad("a") | bad("b"), F.raise_error(F.lit("a class code is out of range")).cast("int")).otherwise(F.col("a") * classes + F.col("b"))
    return joined.select(*keys, value.cast("int").alias("transition"))


def changed_mask(first: DataFrame, last: DataFrame, nodata: int = NO_CLASS, keys: Sequence[str] = ("grid_id", "row", "col"), code: str = "code") -> DataFrame:
    """keys and changed: 1, 0, or -1 where either has no class."""
    joined = first.select(*keys, F.col(code).alias("a")).join(last.select(*keys, F.col(code).alias("b")), list(keys))
    return joined.select(*keys, F.when((F.col("a") == nodata) | (F.col("b") == nodata), -1).otherwise((F.col("a") != F.col("b")).cast("int")).cast("int").alias("changed"))


def transition_labels(classes: Sequence[Any]) -> list[str]:
    return [f"{a} -> {b}" for a in classes for b in classes]


def nearest_centroid(train: DataFrame, test: DataFrame, keep: Sequence[str] = ("sample_id", "code")) -> DataFrame:
    """A plain classifier: the class whose mean vector is nearest (Euclidean, the smallest code of equals)."""
    from gridlore.functions import vectors as V
    from gridlore.operators.similarity import literal

    rows = train.select("code", F.posexplode(V.as_double("embedding")).alias("band", "v")).groupBy("code", "band").agg(F.avg("v").alias("v")).collect()
    centres: dict[int, dict[int, float]] = {}
    for r in rows:
        centres.setdefault(r["code"], {})[r["band"]] = r["v"]
    choices = [F.struct(V.euclidean_distance("embedding", literal([v for _, v in sorted(c.items())])).alias("d"), F.lit(code).alias("code")) for code, c in sorted(centres.items())]
    return test.select(*keep, F.array_min(F.array(*choices))["code"].alias("prediction"))


def parameter_grid(grid: Mapping[str, Sequence[Any]], n_iter: int | None = None, seed: int = 42) -> list[dict[str, Any]]:
    """All combinations, or the first n_iter of a seeded permutation of them."""
    names = list(grid)
    every = [dict(zip(names, values)) for values in itertools.product(*grid.values())]
    if n_iter is None:
        return every
    if n_iter < 1:
        raise ValueError("one trial or more")
    return [every[i] for i in np.random.default_rng(seed).permutation(len(every))[:n_iter]]


def best_trial(results: DataFrame, maximise: bool = True) -> DataFrame:
    """The trial of the best score, the first of equals; trials without a score do not count."""
    return results.filter("score IS NOT NULL").orderBy(F.desc("score") if maximise else F.asc("score"), "trial").limit(1)


def randomised_search(grid: Mapping[str, Sequence[Any]], score: Callable[[dict[str, Any]], float | None], n_iter: int = 10, seed: int = 42, maximise: bool = True) -> dict[str, Any] | None:
    """The best parameters, score and all trials; None if nothing could be scored."""
    trials = [(p, s) for p in parameter_grid(grid, n_iter, seed) if (s := score(dict(p))) is not None]
    if not trials:
        return None
    sign = 1 if maximise else -1
    best = max(range(len(trials)), key=lambda i: (sign * trials[i][1], -i))
    return {"params": dict(trials[best][0]), "score": trials[best][1], "best": best, "trials": trials}


def resolve_folds(asked: int, samples: int) -> int | None:
    """Folds of an accuracy report: none for 0 or fewer, at least two, none if there are not enough samples."""
    if asked <= 0:
        return None
    return max(2, asked) if samples >= max(2, asked) else None


def tuning_folds(asked: int) -> int:
    return asked if asked >= 2 else 3


# ------------------------------------------------------------------ texts


def balance_text(balance: Mapping[str, Any], classes: Sequence[Any]) -> str:
    lines = ["Class balance", f"samples: {balance['total']}"]
    lines += [f"{c}: {n} ({f:.1%})" for c, n, f in zip(classes, balance["counts"], balance["fractions"])]
    if balance["imbalanced"]:
        lines.append("no samples of " + ", ".join(map(str, balance["empty"])) if balance["empty"] else f"{balance['commonest']} has {balance['ratio']:.1f} times the samples of {balance['rarest']}")
    return "\n".join(lines)


def accuracy_text(per_class: Sequence[Mapping[str, Any]], overall: Mapping[str, Any], matrix: Sequence[Sequence[int]], classes: Sequence[Any]) -> str:
    wide = max(9, *(len(str(c)) for c in classes))
    lines = ["Cross-validated accuracy", f"accuracy {overall['accuracy']:.4f}", f"{'class':<{wide}} precision  recall      f1  support"]
    lines += [f"{str(c):<{wide}} {r['precision']:9.3f} {r['recall']:7.3f} {r['f1']:7.3f} {r['support']:8d}" for c, r in zip(classes, per_class)]
    lines += [f"{k:<{wide}} {overall[k + '_precision']:9.3f} {overall[k + '_recall']:7.3f} {overall[k + '_f1']:7.3f}" for k in ("macro", "weighted")]
    lines += ["", "Confusion matrix (rows: truth)"] + [f"{str(c):<{wide}} " + " ".join(f"{n:7d}" for n in row) for c, row in zip(classes, matrix)]
    return "\n".join(lines)


def regression_text(overall: Mapping[str, Any], per_fold: Sequence[Mapping[str, Any]] = ()) -> str:
    line = lambda name, m: f"{name}: n {m['n']}, R2 {m['r2']:.4f}, RMSE {m['rmse']:.6g}, MAE {m['mae']:.6g}"
    return "\n".join(["Cross-validated regression", line("all", overall), *(line(f"fold {i + 1}", m) for i, m in enumerate(per_fold))])


def search_text(found: Mapping[str, Any]) -> str:
    lines = [f"{'*' if i == found['best'] else ' '} {s:.6g}  " + ", ".join(f"{k}={v}" for k, v in p.items()) for i, (p, s) in enumerate(found["trials"])]
    return "\n".join(["Parameter search", *lines])
