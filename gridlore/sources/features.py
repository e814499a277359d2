"""Points, lines and polygons with attributes, from CSV, GeoJSON or Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlore.operators.sampling import RINGS, point_features


def read_points(spark: SparkSession, path: str, x: str = "x", y: str = "y", schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", "true")
    df = (reader.schema(schema) if schema else reader.option("inferSchema", "true")).csv(path)
    if "feature_id" not in df.columns:
        df = df.withColumn("feature_id", F.xxhash64(*df.columns))
    return point_features(df, x, y)


def read_geojson(spark: SparkSession, path: str, properties: str = "") -> DataFrame:
    """Features of a GeoJSON collection, one feature a line or one document; properties: their schema, as DDL."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "features array<struct<type:string,id:string,geometry:string,properties:string>>").alias("c")).select(F.posexplode("c.features").alias("n", "f"))
    shape = F.from_json("f.geometry", "type string, coordinates string")
    flat = raw.withColumn("g", shape)
    pair = "array<double>"
    parse = lambda kind: F.from_json("g.coordinates", kind)
    ring = lambda ps: F.transform(ps, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    rings = (
        F.when(F.col("g.type") == "Point", F.array(ring(F.array(parse(pair)))))
        .when(F.col("g.type").isin("MultiPoint", "LineString"), F.array(ring(parse(f"array<{pair}>"))))
        .when(F.col("g.type").isin("Polygon", "MultiLineString"), F.transform(parse(f"array<array<{pair}>>"), ring))
        .when(F.col("g.type") == "MultiPolygon", F.transform(F.flatten(parse(f"array<array<array<{pair}>>>")), ring))
    )
    kind = F.when(F.col("g.type").isin("Point", "MultiPoint"), "point").when(F.col("g.type").isin("Polygon", "MultiPolygon"), "polygon").otherwise("line")
    out = flat.select(F.coalesce(F.col("f.id").try_cast("long"), F.col("n").cast("long")).alias("feature_id"), kind.alias("geom_type"), rings.cast(RINGS).alias("rings"), *([F.from_json("f.properties", properties).alias("_p")] if properties else []))
    out = out.filter(F.col("rings").isNotNull())
    return out.select("feature_id", "geom_type", "rings", "_p.*") if properties else out
