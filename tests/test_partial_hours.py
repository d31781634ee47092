import datetime

from heliogale.config import Grid
from heliogale.plans import jobs


def test_first_hour_lacks_a_latitude_row(spark, tmp_path):
    area = Grid.from_bounds((0.0, 0.0, 2.0, 2.0), 1.0)
    day = datetime.datetime(2023, 1, 1)
    hours = [(day + datetime.timedelta(hours=h), lat, lon, 273.15 + 10 * lat)
             for h in range(48) for lat in (1.0, 2.0) for lon in (0.0, 1.0) if h or lat == 1.0]
    path = str(tmp_path / "hourly")
    spark.createDataFrame(hours, "valid_time timestamp, latitude double, longitude double, t2m double").write.parquet(path)
    daily = jobs.build_daily(spark, jobs.Places(str(tmp_path / "run")), path, area, ["t2m"], years=(2023, 2023))
    values = {}
    for r in daily.collect():
        values.setdefault(r["lat_i"], set()).add(round(r["t2m"], 6))
    assert len(values) == 2 and all(len(v) == 1 for v in values.values()) and len(set.union(*values.values())) == 2
