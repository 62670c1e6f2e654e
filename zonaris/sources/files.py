"""Files in and out: GeoJSON features, address XML, validated parcels, content-addressed artifacts and their manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of parcel files and the columns they become.
PARCEL_FIELDS = {"ID_DZIALKI": "parcel_identifier", "NUMER_DZIALKI": "number", "NAZWA_OBREBU": "precinct", "NAZWA_GMINY": "cadastral_unit", "POLE_EWIDENCYJNE": "reported_area_sqm"}

_GEOJSON = "type string, crs struct<type:string, properties:map<string,string>>, features array<struct<id:string, properties:map<string,string>, geometry:struct<type:string, coordinates:string>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(crs, id, properties, kind, rings) of every feature of the GeoJSON collections at `path`.

    One file is one JSON value, so files are the unit of parallel reading. `rings` are the rings of polygons and
    multi-polygons, each an array of (x, y) arrays, else null; a feature without a geometry has null kind and rings.
    """
    one = spark.read.schema(_GEOJSON).option("multiLine", True).json(path)
    f = one.select(F.col("crs.properties")["name"].alias("crs"), F.inline("features"))
    text = F.col("geometry.coordinates")
    ring = "array<array<array<double>>>"
    rings = F.when(F.col("geometry.type") == "Polygon", F.from_json(text, ring)).when(F.col("geometry.type") == "MultiPolygon", F.flatten(F.from_json(text, f"array<{ring}>")))
    return f.select("crs", "id", "properties", F.col("geometry.type").alias("kind"), rings.alias("rings"))


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring by the shoelace rule, counter-clockwise positive."""
    sides = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda p, q: p[0] * q[1] - q[0] * p[1])
    return F.when(F.size(ring) > 1, F.aggregate(sides, F.lit(0.0), lambda s, x: s + x) / 2).otherwise(0.0)


def with_extent(features: DataFrame, rings: str = "rings") -> DataFrame:
    """Adds x0, y0, x1, y1 and `area`: outer rings count positive and holes negative, whatever way they run."""
    points = F.flatten(F.col(rings))
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    area = F.abs(F.aggregate(F.transform(F.col(rings), ring_area), F.lit(0.0), lambda s, a: s + a))
    return features.withColumns({"x0": F.array_min(xs), "y0": F.array_min(ys), "x1": F.array_max(xs), "y1": F.array_max(ys), "area": area})


def read_parcels(spark: SparkSession, path: str, fields: dict[str, str] = PARCEL_FIELDS, tolerance: float = 0.02) -> DataFrame:
    """Parcels of GeoJSON files by a field mapping, with `reject_reason` (null: accepted).

    Reasons: missing_id, blank_in_id, no_geometry, area_mismatch (reported area known and off by more than `tolerance`),
    duplicate_id (a second row of an identifier; the one with the greatest area stays).
    """
    from pyspark.sql import Window

    d = with_extent(read_geojson(spark, path)).select(*(F.col("properties")[a].alias(b) for a, b in fields.items()), "crs", "rings", "x0", "y0", "x1", "y1", "area")
    d = d.withColumn("reported_area_sqm", F.expr("try_cast(replace(reported_area_sqm, ',', '.') as double)"))
    name = F.trim("parcel_identifier")
    d = d.withColumn("_n", F.row_number().over(Window.partitionBy(name).orderBy(F.desc_nulls_last("area"), "number")))
    off = F.coalesce(F.abs(F.col("reported_area_sqm") - F.col("area")) > tolerance * F.col("reported_area_sqm"), F.lit(False))
    reason = F.when(F.coalesce(name, F.lit("")) == "", "missing_id").when(name.rlike(r"\s"), "blank_in_id").when(F.col("rings").isNull(), "no_geometry").when(off, "area_mismatch").when(F.col("_n") > 1, "duplicate_id")
    return d.withColumn("reject_reason", reason).drop("_n")


def write_geojson(features: DataFrame, path: str, key: str, rings: str = "rings") -> None:
    """One GeoJSON feature a line; every column but `key` and `rings` is a property."""
    rest = [c for c in features.columns if c not in (key, rings)]
    geometry = F.struct(F.lit("Polygon").alias("type"), F.col(rings).alias("coordinates"))
    features.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.col(key).alias("id"), F.struct(*rest).alias("properties"), geometry.alias("geometry"))).alias("value")).write.text(path)


def read_rows_xml(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """One row for each element `tag` of XML files, read as a stream of elements."""
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def save_artifacts(df: DataFrame, content: str, path: str) -> DataFrame:
    """Write each distinct content once under the first byte of its SHA-256; returns its manifest (sha256, n_bytes)."""
    d = df.select(F.col(content).cast("binary").alias("content")).where("content is not null").withColumn("sha256", F.sha2("content", 256))
    d = d.dropDuplicates(["sha256"]).withColumns({"n_bytes": F.octet_length("content").cast("bigint"), "shard": F.substring("sha256", 1, 2)})
    d.repartition("shard").write.mode("append").partitionBy("shard").parquet(path)
    return df.sparkSession.read.parquet(path).select("sha256", "n_bytes").distinct()


def verify_manifest(manifest: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """(sha256, problem) of what differs: missing, unexpected or damaged; no rows when all is as the manifest says."""
    held = spark.read.parquet(path).select(F.col("sha256").alias("h"), (F.sha2("content", 256) == F.col("sha256")).alias("sound")).groupBy("h").agg(F.min("sound").alias("sound"))
    d = manifest.select("sha256").distinct().join(held, F.col("sha256") == F.col("h"), "full")
    problem = F.when(F.col("h").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(~F.col("sound"), "damaged")
    return d.select(F.coalesce("sha256", "h").alias("sha256"), problem.alias("problem")).where("problem is not null")
