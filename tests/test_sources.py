import datetime as dt

import pytest
from pyspark.sql import functions as F

from heliogale.operators import grid
from heliogale.sources import readers, sinks


def test_reanalysis_reads_only_needed_columns_and_wraps_longitude(spark, tmp_path, rows):
    data = [(dt.datetime(2023, 1, 1, h), 10.0, lon, 3.0, 4.0, float("nan"), 1.0) for h in (0, 23) for lon in (359.75, 0.0, 90.0)]
    data.append((dt.datetime(2022, 12, 31, 23), 10.0, 0.0, 1.0, 1.0, 1.0, 1.0))
    schema = "valid_time timestamp, latitude double, longitude double, u100 float, v100 float, ssrd float, t2m float"
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "hourly"))
    out = readers.read_reanalysis(spark, str(tmp_path / "hourly"), ["ws100", "ssrd"], (-1, 0, 1, 20), (2023, 2023))
    assert rows(out.groupBy("longitude").count()) == [(-0.25, 2), (0.0, 2)]
    assert out.filter("ssrd is not null").count() == 0 and "t2m" not in out.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    schema_line = plan.split("ReadSchema")[1]
    assert "t2m" not in schema_line and "u100" in schema_line and "PushedFilters: [IsNotNull(valid_time)" in plan
    none = readers.read_reanalysis(spark, str(tmp_path / "hourly"), ["ws100"], (20, 40, 30, 50))
    assert none.isEmpty()


def test_raster_nodata(spark, tmp_path, rows):
    spark.createDataFrame([(0.0, 0.0, -99.0), (1.0, 0.0, float("nan")), (2.0, 0.0, 5.0)], "x double, y double, value float").write.parquet(str(tmp_path / "r"))
    assert rows(readers.read_raster(spark, str(tmp_path / "r"), -99.0), "value") == [(None,), (None,), (5.0,)]


def test_stitched_cells_reject_repeats(spark, tmp_path, rows):
    a = spark.createDataFrame([(0, 0, 1.0)], "lat_i int, lon_i int, v double")
    b = spark.createDataFrame([(0, 1, 2.0)], "lat_i int, lon_i int, v double")
    a.write.parquet(str(tmp_path / "a"))
    b.write.parquet(str(tmp_path / "b"))
    a.write.parquet(str(tmp_path / "again"))
    paths = [str(tmp_path / p) for p in ("a", "b", "again")]
    assert rows(readers.read_cells(spark, paths[:2])) == [(0, 0, 1.0), (0, 1, 2.0)]
    with pytest.raises(Exception, match="occurs 2 times"):
        readers.read_cells(spark, paths).collect()


def test_regions_lookup_surface_and_preference(spark, tmp_path, rows):
    spark.createDataFrame([("A", "Aland", "land"), ("A", "Aland", "maritime"), ("B", "Beland", "land")],
                          "country_id string, parent_name string, shape_class string").write.parquet(str(tmp_path / "s"))
    allowed = spark.createDataFrame([("A",), ("A",)], "country_id string")
    assert rows(readers.read_regions(spark, str(tmp_path / "s"), "land"), "country_id") == [("A",), ("B",)]
    assert readers.read_regions(spark, str(tmp_path / "s"), None, allowed).count() == 2
    (tmp_path / "codes.csv").write_text("gridcode,class name\n11,Af\n21,BSh\n")
    assert rows(readers.read_gridcodes(spark, str(tmp_path / "codes.csv"))) == [(11, "Af"), (21, "BSh")]
    steps = [(dt.datetime(2020, 1, d), 1.0, 200.0, float(d)) for d in (1, 2)]
    spark.createDataFrame(steps, "valid_time timestamp, latitude double, longitude double, z double").write.parquet(str(tmp_path / "z"))
    assert rows(readers.read_surface(spark, str(tmp_path / "z"), "z")) == [(1.0, -160.0, 1.0)]
    assert readers.read_preferred(spark, str(tmp_path / "none"), str(tmp_path / "z")).count() == 2
    assert readers.read_preferred(spark, str(tmp_path / "s"), str(tmp_path / "z")).count() == 3


def test_tile_sink_replaces_only_its_tiles(spark, tmp_path, rows):
    path = str(tmp_path / "tiles")
    one = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0)], "tile_lon int, tile_lat int, v double")
    sinks.write_tiles(one, path)
    sinks.write_tiles(one.filter("tile_lon = 1").withColumn("v", F.lit(9.0)), path)
    assert rows(spark.read.parquet(path), "tile_lon", "v") == [(0, 1.0), (1, 9.0)]


def test_tile_files_follow_their_rows(spark, tmp_path, rows):
    path = str(tmp_path / "sized")
    hot = spark.range(4000).select(F.lit(0).alias("tile_lon"), F.lit(0).alias("tile_lat"), (F.col("id") % 64).cast("int").alias("lon_i"),
                                   (F.col("id") / 64).cast("int").alias("lat_i"), F.col("id").cast("double").alias("v"))
    cold = spark.range(60).select((F.col("id") % 6 + 1).cast("int").alias("tile_lon"), F.lit(0).alias("tile_lat"),
                                  F.lit(0).alias("lon_i"), F.col("id").cast("int").alias("lat_i"), F.lit(1.0).alias("v"))
    piled = spark.range(2000).select(F.lit(9).alias("tile_lon"), F.lit(0).alias("tile_lat"), F.lit(5).alias("lon_i"), F.lit(5).alias("lat_i"), F.col("id").cast("double").alias("v"))
    every = hot.unionByName(cold).unionByName(piled)
    sinks.write_tiles(every, path, file_bytes=16 * 250)
    files = {int(d.name.split("=")[1]): len(list(d.rglob("*.parquet"))) for d in (tmp_path / "sized").glob("tile_lon=*")}
    assert all(files[t] == 1 for t in range(1, 7)) and 10 <= files[0] <= 24 and files[9] >= 4
    back = spark.read.parquet(path)
    assert rows(back.groupBy("tile_lon").agg(F.count("*"), F.sum("v"))) == rows(every.groupBy("tile_lon").agg(F.count("*"), F.sum("v")))
    # Each file of the crowded tile is a compact part of it.
    spans = back.filter("tile_lon = 0").groupBy(F.input_file_name()).agg((F.max("lon_i") - F.min("lon_i")).alias("w"), (F.max("lat_i") - F.min("lat_i")).alias("h"))
    assert spans.agg(F.avg(F.col("w") * F.col("h"))).first()[0] < 64 * 63 / 4


def test_many_small_tiles_are_written_by_many_tasks(spark, tmp_path):
    path = str(tmp_path / "many")
    df = spark.range(600).select((F.col("id") % 10).cast("int").alias("tile_lon"), (F.col("id") % 200).cast("int").alias("tile_lat"), "id")
    sinks.write_tiles(df, path)
    names = [f.name for f in (tmp_path / "many").rglob("*.parquet")]
    # One file a tile; a file's name begins with the number of the task that wrote it.
    assert len(names) == 200 and len({n.split("-")[1] for n in names}) >= 5
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(600))


def test_a_box_reads_only_its_tiles(spark, tmp_path):
    path = str(tmp_path / "world")
    df = spark.range(40 * 40).select((F.col("id") % 40 * 0.5).alias("longitude"), (F.floor(F.col("id") / 40) * 0.5 + 0.5).alias("latitude"))
    df = df.withColumns({"tile_lon": F.floor(F.col("longitude") / 5).cast("int"), "tile_lat": (F.ceil(F.col("latitude") / 5) - 1).cast("int")})
    sinks.write_tiles(df, path)
    box = (5.0, 5.0, 10.0, 15.0)
    out = readers.read_tiles(spark, path, box, (0.0, 0.0), 5.0)
    assert out.count() == df.filter("longitude >= 5 and longitude < 10 and latitude > 5 and latitude <= 15").count() == 200
    assert out.select(F.input_file_name()).distinct().count() == 2 and len(list((tmp_path / "world").rglob("*.parquet"))) == 16
    assert "PartitionFilters: [isnotnull(tile_lon" in out._jdf.queryExecution().executedPlan().toString()
    sinks.write_tiles(df.limit(0), str(tmp_path / "none"))


def test_bad_tiles_are_found_by_halving(spark, tmp_path, monkeypatch):
    tiles = spark.range(64).select(F.col("id").cast("int").alias("tile_lon"), F.lit(0).alias("tile_lat"))
    jobs, keep = [], sinks.write_tiles
    monkeypatch.setattr(sinks, "write_tiles", lambda *a, **k: jobs.append(1) or keep(*a, **k))

    def build(some):
        bad = F.col("tile_lon").isin(7, 40)
        return some.withColumn("v", F.when(bad, F.raise_error(F.lit("bad")).cast("int")).otherwise(F.col("tile_lon")))

    path, manifest = str(tmp_path / "out"), str(tmp_path / "done")
    assert sorted(sinks.run_tiles(spark, tiles, build, path, manifest)) == [(7, 0), (40, 0)]
    assert len(jobs) <= 4 * 6 + 3 and spark.read.parquet(path).count() == 62
    assert sorted(r[0] for r in sinks.pending(spark, tiles, manifest).collect()) == [7, 40]

    def wrong(some):
        return some.select("no_such_column")

    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        sinks.run_tiles(spark, tiles, wrong, path, manifest)


def test_report_is_sorted_rounded_and_cut(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.234), ("b", 9.999), ("c", 5.0)], "k string, v double")
    sinks.write_report(df, str(tmp_path / "csv"), [F.desc("v")], n=2)
    text = next((tmp_path / "csv").glob("*.csv")).read_text()
    assert text == "k,v\nb,10.0\nc,5.0\n"


def test_computed_once(spark, tmp_path):
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.computed_once(spark, str(tmp_path / "once"), build).count() == 3
    assert len(calls) == 1


def test_tile_job_resumes_and_isolates_a_bad_tile(spark, tmp_path, rows):
    tiles = grid.tiles(grid.domain(spark, (0, 0, 3, 1)), 1.0)
    path, manifest = str(tmp_path / "out"), str(tmp_path / "done")
    broken = {"on": True}

    def build(some):
        v = F.col("minx") * 10
        if broken["on"]:
            v = F.when(F.col("tile_lon") == 1, F.raise_error(F.lit("bad tile")).cast("double")).otherwise(v)
        return some.select("tile_lon", "tile_lat", v.alias("v"))

    assert sinks.run_tiles(spark, tiles, build, path, manifest) == [(1, 0)]
    assert rows(spark.read.parquet(path), "tile_lon", "v") == [(0, 0.0), (2, 20.0)]
    assert rows(sinks.pending(spark, tiles, manifest), "tile_lon") == [(1,)]
    broken["on"] = False
    assert sinks.run_tiles(spark, tiles, build, path, manifest) == []
    assert rows(spark.read.parquet(path), "tile_lon", "v") == [(0, 0.0), (1, 10.0), (2, 20.0)]
    assert sinks.run_tiles(spark, tiles, build, path, manifest) == []


def test_bucketed_table_survives_a_lost_catalog_entry(spark, tmp_path):
    path = str(tmp_path / "b")
    build = lambda: spark.range(100).select((F.col("id") % 7).alias("k"), "id")
    sinks.bucketed_once(spark, path, build, ["k"], 3)
    assert len(list((tmp_path / "b").glob("*.parquet"))) <= 3
    for t in spark.catalog.listTables():
        if t.name.startswith("bucketed_"):
            spark.sql(f"DROP TABLE {t.name}")
    again = sinks.bucketed_once(spark, path, lambda: None, ["k"])
    counts = again.groupBy("k").count()
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {r["k"]: r["count"] for r in counts.collect()} == {k: 15 if k < 2 else 14 for k in range(7)}
