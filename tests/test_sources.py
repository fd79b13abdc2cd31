"""Scans and sinks: round trips, layouts, and the errors that bad tables raise."""

import json

import pytest
from pyspark.sql import functions as F

from chronolens.sources import tables as S


def test_scores_round_trip_into_a_wide_table(spark, tmp_path):
    for d in ("one", "two"):
        (tmp_path / f"{d}.csv").write_text("image_id,raw_score\na/1,0.5\nb,-1\n" if d == "one" else "image_id,raw_score\na/1,2\nb,3\n")
    scores = S.read_scores(spark, *(str(tmp_path / f"{d}.csv") for d in ("one", "two")))
    manifest = spark.createDataFrame([("a/1",), ("b",), ("c",)], "image_id string")
    got = {r.image_id: (r.one, r.two) for r in S.join_scores(manifest, scores, ["one", "two"]).collect()}
    assert got == {"a/1": (0.5, 2.0), "b": (-1.0, 3.0), "c": (None, None)}
    with pytest.raises(ValueError, match="two scores"):
        S.join_scores(manifest, scores.union(scores), ["one", "two"])
    S.write_scores(scores.where("detector = 'one'"), str(tmp_path / "out"))
    assert S.read_scores(spark, str(tmp_path / "out")).count() == 2


def test_both_manifest_layouts_become_one(spark, tmp_path):
    (tmp_path / "m.csv").write_text("image_id,path,label,release_date,generator,split\nx,p.png,1,2020-01-02,g,validation\ny,q.png,0,never,,train\n")
    rows = {r.image_id: r for r in S.read_manifest(spark, str(tmp_path / "m.csv")).collect()}
    assert (rows["x"].split, str(rows["x"].release_date), rows["x"].file) == ("val", "2020-01-02", "p.png")
    assert rows["y"].release_date is None and rows["y"].generator is None and rows["y"].crop_width is None
    (tmp_path / "d.csv").write_text("image_id,path,label\nx,p,1\nx,q,0\n")
    with pytest.raises(ValueError, match="repeats"):
        S.read_manifest(spark, str(tmp_path / "d.csv"))


def test_halves_payload_shards_and_composition(spark, tmp_path):
    a = spark.createDataFrame([("a", 1, bytearray(b"x")), ("b", 1, bytearray(b"y"))], "file_id string, label int, blob binary")
    b = spark.createDataFrame([("c", 0, "val")], "file_id string, label int, split string")
    S.write_manifest(a, str(tmp_path), "one")
    b.write.parquet(str(tmp_path / "two.parquet"))
    both = S.read_halves(spark, str(tmp_path / "one.parquet"), str(tmp_path / "two.parquet"))
    assert both.count() == 3 and both.where("split = 'val'").count() == 1
    index = S.read_index(spark, str(tmp_path / "one.parquet"), ["blob"])
    assert index.columns == ["file_id", "label"]
    got = S.fetch_payload(spark, str(tmp_path / "one.parquet"), index.where("file_id = 'b'"), "file_id", ["blob"]).collect()
    assert [(r.file_id, bytes(r.blob)) for r in got] == [("b", b"y")]
    assert S.shard_index(spark, str(tmp_path / "one.parquet"), "file_id").where("shard LIKE 'part-%'").count() == 2
    assert {(r.axis, r.value, r.n) for r in S.composition(both, ["label", "split"]).collect()} == {("label", "1", 2), ("label", "0", 1), ("split", None, 2), ("split", "val", 1)}
    assert S.write_tables({"full": a, "none": a.where("false")}, str(tmp_path / "t")) == ["full"]
    assert S.enrich(index, b.select("file_id", "split"), spark.createDataFrame([("a", "train")], "file_id string, split string")).where("split = 'train'").count() == 1


def test_sidecars_configs_and_lineage(spark, tmp_path):
    (tmp_path / "K1").mkdir()
    (tmp_path / "K1/meta.json").write_text(json.dumps({"detector": "d", "manifest": {"rows": 3, "sha256": "h"}, "weights": [{"path": "w", "sha256": "s"}], "elapsed_s": 1.5, "extra": 1}, indent=1))
    (r,) = S.read_sidecars(spark, str(tmp_path / "K1/meta.json")).collect()
    assert (r.detector, r.manifest_rows, r.n_weights, r.elapsed_s) == ("d", 3, 1, 1.5)
    assert [r.config for r in S.finished_configs(spark, str(tmp_path / "*/meta.json")).collect()] == ["K1"]
    (tmp_path / "l.csv").write_text("generator,family,stage,stage_detail,codebase,evidence,note\ng,f,s,,c,e,\n")
    assert S.read_lineage(spark, str(tmp_path / "l.csv")).first().stage == "s"


def test_features_and_shards_are_checked(spark):
    index = spark.createDataFrame([("a",), ("b",)], "image_id string")
    good = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "image_id string, x array<float>")
    assert S.load_features(index, good, "image_id").count() == 2
    with pytest.raises(ValueError, match="NaN"):
        S.load_features(index, good.withColumn("x", F.array(F.lit(float("nan")).cast("float"))), "image_id")
    with pytest.raises(ValueError, match="without a vector"):
        S.load_features(index, good.where("image_id = 'a'"), "image_id")
    rows = S.with_shards(spark.range(10).withColumnRenamed("id", "row"), "row", 4)
    assert [r.row for r in S.assemble_shards(rows, 3, "row").collect()] == list(range(10))
    with pytest.raises(ValueError, match="missing"):
        S.assemble_shards(rows.where("shard <> 1"), 3, "row")
