"""Estimators, prediction, and saved models with what is needed to check them."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime
from typing import Any

import pyspark
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.functions import vectors as V
from gridlore.operators.forest import Boosted, Forest, TreesModel

MAGIC, FORMAT = "gridlore-model", 1
ALGORITHMS = ("rf", "gb")
KINDS = ("classifier", "regressor")
#: Spark's deepest tree, for an unlimited depth
UNLIMITED = 30
# The parameter grids that a search draws from.
TUNING = {
    "rf": {"n_estimators": [100, 200, 400], "max_depth": [None, 10, 20], "max_features": ["sqrt", "log2", 0.5], "min_samples_leaf": [1, 2, 5]},
    "gb": {"n_estimators": [100, 200, 400], "learning_rate": [0.03, 0.1, 0.3], "max_depth": [2, 3, 4]},
}


def tuning_grid(algorithm: str) -> dict[str, list[Any]] | None:
    """A fresh copy of the algorithm's grid, or none."""
    found = TUNING.get(algorithm)
    return None if found is None else {k: list(v) for k, v in found.items()}


def estimator(kind: str, algorithm: str = "rf", n_estimators: int = 200, seed: int = 42, classes: int = 2, **params: Any):
    """A forest or boosted trees by their usual parameters; max_depth None is no limit to a forest that forest.py grows, and as deep as Spark goes elsewhere."""
    if kind not in KINDS or algorithm not in ALGORITHMS:
        raise ValueError(f"unknown estimator {kind}/{algorithm}")
    common = {"featuresCol": "features", "seed": seed, "maxBins": 128}
    if algorithm == "rf":
        depth, features = params.get("max_depth"), params.get("max_features", "sqrt" if kind == "classifier" else "all")
        own = {"numTrees": n_estimators, "maxDepth": UNLIMITED if depth is None else depth, "featureSubsetStrategy": str(features), "minInstancesPerNode": params.get("min_samples_leaf", 1)}
        sparks = RandomForestClassifier(labelCol="code", **common, **own) if kind == "classifier" else RandomForestRegressor(labelCol="label", **common, **own)
        return Forest(classes if kind == "classifier" else 0, n_estimators, seed, depth, features, own["minInstancesPerNode"], sparks)
    own = {"maxIter": n_estimators, "maxDepth": params.get("max_depth", 3), "stepSize": params.get("learning_rate", 0.1)}
    if kind == "regressor":
        sparks = GBTRegressor(labelCol="label", **common, **own)
    else:
        one = GBTClassifier(labelCol="code", **common, **own)
        sparks = one if classes <= 2 else OneVsRest(classifier=one, labelCol="code", featuresCol="features", rawPredictionCol="rawPrediction")
    return Boosted(classes if kind == "classifier" else 0, n_estimators, seed, own["maxDepth"], own["stepSize"], sparks)


def features(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector(V.as_double("embedding")))


def predict_classes(model, pixels: DataFrame, nodata: float | None = None, confidence: bool = False) -> DataFrame:
    """The table with code (NULL where a pixel is invalid) and, if asked for, the winner's probability.

    Several boosted classes have no probabilities; their scores' softmax stands in.
    """
    ok = V.valid("embedding", nodata)
    got = model.transform(features(pixels.filter(ok)))
    out = got.withColumn("code", F.col("prediction").cast("int"))
    if confidence:
        if "probability" in got.columns:
            out = out.withColumn("confidence", F.array_max(vector_to_array("probability")).cast("float"))
        else:
            raw = vector_to_array("rawPrediction")
            top = F.array_max(raw)
            total = F.aggregate(raw, F.lit(0.0), lambda s, x: s + F.exp(x - top))
            out = out.withColumn("confidence", (1 / total).cast("float"))
    names = [*pixels.columns, "code", *(["confidence"] if confidence else [])]
    rest = pixels.filter(~ok).withColumn("code", F.lit(None).cast("int"))
    rest = rest.withColumn("confidence", F.lit(None).cast("float")) if confidence else rest
    return out.select(*names).unionByName(rest.select(*names))


def predict_values(model, pixels: DataFrame, nodata: float | None = None) -> DataFrame:
    """The table with value (float; NULL where a pixel is invalid)."""
    ok = V.valid("embedding", nodata)
    good = model.transform(features(pixels.filter(ok))).withColumn("value", F.col("prediction").cast("float")).select(*pixels.columns, "value")
    return good.unionByName(pixels.filter(~ok).withColumn("value", F.lit(None).cast("float")))


@dataclass
class Bundle:
    """A fitted model and what it was fitted on."""

    model: Any
    kind: str
    n_bands: int
    algorithm: str
    classes: list[Any] | None = None
    spark_version: str = pyspark.__version__
    created: str = field(default_factory=lambda: datetime.now(UTC).isoformat())
    magic: str = MAGIC
    format_version: int = FORMAT


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save_model(bundle: Bundle, path: str) -> None:
    """Write the model and its description, wherever Spark can write."""
    if bundle.kind not in KINDS:
        raise ValueError(f"unknown kind {bundle.kind!r}")
    if bundle.n_bands <= 0:
        raise ValueError("a model needs one band or more")
    spark = SparkSession.getActiveSession()
    if isinstance(bundle.model, TreesModel):
        where, fs = _files(spark, f"{path}/model")
        fs.delete(where, True)  # of an earlier model
        bundle.model.frame(spark).repartition(8).write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame([(json.dumps(bundle.model.about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/joined")
    else:
        where, fs = _files(spark, f"{path}/trees")
        fs.delete(where, True)
        PipelineModel([bundle.model]).write().overwrite().save(f"{path}/model")
    about = {k: v for k, v in asdict(Bundle(None, *(getattr(bundle, n) for n in ("kind", "n_bands", "algorithm", "classes", "spark_version", "created", "magic", "format_version")))).items() if k != "model"}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load_model(path: str) -> Bundle:
    """Read a saved model; anything else, or another format, is an error."""
    spark = SparkSession.getActiveSession()
    where, fs = _files(spark, f"{path}/about")
    if not fs.exists(where):
        raise FileNotFoundError(f"no saved model at {path}")
    try:
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
    except (ValueError, TypeError) as e:
        raise ValueError(f"not a saved model: {path}") from e
    if about.get("magic") != MAGIC:
        raise ValueError(f"not a saved model: {path}")
    if about.get("format_version") != FORMAT:
        raise ValueError(f"saved in format {about.get('format_version')}, this is {FORMAT}")
    where, fs = _files(spark, f"{path}/trees")
    if fs.exists(where):
        rows = [tuple(r.values()) for r in spark.read.parquet(f"{path}/trees").orderBy("tree").toArrow().to_pylist()]
        return Bundle(TreesModel(spark, rows, json.loads(spark.read.text(f"{path}/joined").first()["value"])), **about)
    return Bundle(PipelineModel.load(f"{path}/model").stages[0], **about)


def version_pair(text: str | None) -> tuple[int, int] | None:
    """Major and minor of a version, or none."""
    try:
        a, b = (text or "").split(".")[:2]
        return int(a), int(b)
    except ValueError:
        return None


@dataclass(frozen=True)
class Compatibility:
    errors: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()

    @property
    def ok(self) -> bool:
        return not self.errors


def check_compatibility(about: Bundle | Mapping[str, Any], n_bands: int, kind: str, current: str | None = pyspark.__version__) -> Compatibility:
    """Another kind, band count or major.minor version is an error; another patch or an unknown version a warning."""
    get = about.get if isinstance(about, Mapping) else lambda k: getattr(about, k)
    errors, warnings = [], []
    if get("kind") != kind:
        errors.append(f"the model is a {get('kind')}, not a {kind}")
    if get("n_bands") != n_bands:
        errors.append(f"the model was fitted on {get('n_bands')} bands, the data has {n_bands}")
    saved, now = version_pair(get("spark_version")), version_pair(current)
    if saved is None or now is None:
        warnings.append("the versions cannot be compared")
    elif saved != now:
        errors.append(f"saved with {get('spark_version')}, running {current}")
    elif get("spark_version") != current:
        warnings.append(f"saved with {get('spark_version')}, running {current}")
    return Compatibility(tuple(errors), tuple(warnings))


def reuse_model(path: str, n_bands: int, kind: str) -> tuple[Bundle, tuple[str, ...]]:
    """A saved model and its warnings, or an error if it does not fit."""
    bundle = load_model(path)
    found = check_compatibility(bundle, n_bands, kind)
    if not found.ok:
        raise ValueError("; ".join(found.errors))
    return bundle, found.warnings
