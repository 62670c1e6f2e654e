"""Files in and out, and streams that take more than one batch."""

import json

from pyspark.sql import functions as F

from zonaris.operators import evaluation as E
from zonaris.operators import raster as R
from zonaris.sources import files
from zonaris.streaming import windows as W


def feature(name, ring, **more):
    return {"type": "Feature", "properties": {"ID_DZIALKI": name, "NUMER_DZIALKI": "1", **more}, "geometry": ring and {"type": "Polygon", "coordinates": [ring]}}


def square(x, y, side):
    return [[x, y], [x + side, y], [x + side, y + side], [x, y + side], [x, y]]


def test_parcels_from_geojson(spark, tmp_path):
    rows = [feature("a.1", square(0, 0, 10), POLE_EWIDENCYJNE="100,5"), feature("a.1", square(0, 0, 5)), feature("b 2", square(0, 0, 1)), feature(None, square(0, 0, 1)), feature("c.3", None), feature("d.4", square(5, 5, 10), POLE_EWIDENCYJNE="150")]
    (tmp_path / "in.geojson").write_text(json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:2180"}}, "features": rows}))
    d = files.read_parcels(spark, str(tmp_path / "in.geojson"))
    got = sorted(((r["parcel_identifier"] or "", r["area"] or 0.0, r["reject_reason"] or "", r["crs"]) for r in d.collect()))
    assert got == [("", 1.0, "missing_id", "EPSG:2180"), ("a.1", 25.0, "duplicate_id", "EPSG:2180"), ("a.1", 100.0, "", "EPSG:2180"), ("b 2", 1.0, "blank_in_id", "EPSG:2180"), ("c.3", 0.0, "no_geometry", "EPSG:2180"), ("d.4", 100.0, "area_mismatch", "EPSG:2180")]
    good = d.where("reject_reason is null").select("parcel_identifier", "number", "rings")
    files.write_geojson(good, str(tmp_path / "out"), "parcel_identifier")
    back = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert back == {"type": "Feature", "id": "a.1", "properties": {"number": "1"}, "geometry": {"type": "Polygon", "coordinates": [square(0.0, 0.0, 10.0)]}}


def test_rows_of_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<all><adr><city>Łódź</city><no>5a</no></adr><adr><city>Kutno</city></adr></all>", encoding="utf-8")
    assert sorted(map(tuple, files.read_rows_xml(spark, str(tmp_path / "a.xml"), "adr", "city string, no string").collect())) == [("Kutno", None), ("Łódź", "5a")]


def test_artifacts_and_manifest(spark, tmp_path):
    d = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "c string")
    manifest = files.save_artifacts(d, "c", str(tmp_path / "store"))
    assert manifest.count() == 2 and files.verify_manifest(manifest, spark, str(tmp_path / "store")).collect() == []
    other = manifest.where(F.col("sha256") != F.sha2(F.lit("x").cast("binary"), 256)).unionByName(spark.createDataFrame([("0" * 64, 1)], "sha256 string, n_bytes bigint"))
    assert sorted(r["problem"] for r in files.verify_manifest(other, spark, str(tmp_path / "store")).collect()) == ["missing", "unexpected"]


def test_stream_in_several_batches(spark, tmp_path):
    d = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    d.repartition(10).write.parquet(str(tmp_path / "in"))
    s = W.file_stream(spark, str(tmp_path / "in"), files_per_batch=3)
    got = {r["k"]: r["n"] for r in W.latest_by_batch(s.groupBy("k").agg(F.count("*").alias("n")), ["k"]).collect()}
    assert got == {r["k"]: r["n"] for r in d.groupBy("k").agg(F.count("*").alias("n")).collect()}


def test_gradient_of_a_plane_and_mcnemar(spark):
    g = spark.range(25).select((F.col("id") / 5).cast("int").alias("i"), (F.col("id") % 5).alias("j")).withColumn("z", F.col("j") * 1.0)
    got = {(r["i"], r["j"]): (r["slope"], r["aspect"]) for r in R.gradient(g, "i", "j", "z").collect()}
    assert len(got) == 25 and got[0, 0] == (None, None) and abs(got[2, 2][0] - 45) < 1e-9 and abs(got[2, 2][1] - 270) < 1e-9
    p = spark.createDataFrame([(0, 0), (1, 9), (5, 5), (0, 3000)], "b bigint, c bigint").select(E.mcnemar(F.col("b"), F.col("c"))).collect()
    assert [round(r[0], 6) for r in p] == [1.0, 0.021484, 1.0, 0.0]
