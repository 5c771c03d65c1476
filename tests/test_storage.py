"""Round trips through the native store and NetCDF files, appends, and streams."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.sources import netcdf, store
from cellweave.sources.build import from_dict

TIMES = [dt.datetime(2000, 1, 1) + dt.timedelta(hours=6 * i) for i in range(12)]


def data(spark, n=8, start=0):
    rng = np.random.default_rng(77)
    pr = rng.normal(size=(12, 3, 2))
    pr[0, 0, 0] = np.nan
    cut = slice(start, start + n)
    return from_dict(
        spark, {"pr": (["time", "lat", "lon"], pr[cut]), "count": (["time", "lat", "lon"], np.arange(72, dtype="i4").reshape(12, 3, 2)[cut]), "clim": (["lat", "lon"], pr[1])},
        coords={"time": TIMES[cut], "lat": [0.0, 1.5, 3.0]}, attrs={"title": "x"},
    ), pr


def test_native_store(spark, tmp_path):
    x, pr = data(spark)
    path = f"file://{tmp_path}/a"
    store.write(x, path, unlimited=["time"], partitions=3)
    y = store.read(spark, path)
    assert y.sizes == x.sizes and y.attrs == {"title": "x"}
    np.testing.assert_array_equal(y["pr"].to_numpy(), pr[:8])
    np.testing.assert_array_equal(y["clim"].to_numpy(), pr[1])
    more, _ = data(spark, 4, 8)
    store.append(more, path, "time")
    z = store.read(spark, path)
    assert z.sizes["time"] == 12
    np.testing.assert_array_equal(z["pr"].to_numpy(), pr)
    assert [r[1] for r in z.coordinate("time").orderBy("__pos_time").collect()] == TIMES
    with pytest.raises(ValueError):
        store.append(more, path, "lat")
    with pytest.raises(ValueError):
        store.append(more["pr"], path, "time")


@pytest.mark.parametrize("version", [1, 2, 5])
@pytest.mark.parametrize("unlimited", [None, "time"])
def test_netcdf(spark, tmp_path, version, unlimited):
    x, pr = data(spark)
    path = f"file://{tmp_path}/a.nc"
    netcdf.write(x, path, unlimited_dim=unlimited, version=version, encoding={"time": {"dtype": "i4", "units": "hours since 1999-12-31"}})
    y = netcdf.open_dataset(spark, path, partitions=3)
    assert y.sizes == x.sizes and y.attrs["title"] == "x"
    np.testing.assert_array_equal(y["pr"].to_numpy(), pr[:8])
    np.testing.assert_array_equal(y["count"].to_numpy(), np.arange(48).reshape(8, 3, 2))
    np.testing.assert_array_equal(y["clim"].to_numpy(), pr[1])
    assert [r[1] for r in y.coordinate("time").orderBy("__pos_time").collect()] == TIMES[:8]
    if unlimited:
        netcdf.append(data(spark, 4, 8)[0], path)
        np.testing.assert_array_equal(netcdf.open_dataset(spark, path)["pr"].to_numpy(), pr)
    else:
        with pytest.raises(ValueError):
            netcdf.append(x, path)


def test_netcdf_packing_and_files(spark, tmp_path):
    x, pr = data(spark)
    pack = {"pr": {"dtype": "i2", "scale_factor": 0.01, "add_offset": 1.0, "_FillValue": -999}}
    netcdf.write(x["pr"], f"file://{tmp_path}/p0.nc", encoding=pack)
    got = netcdf.open_dataset(spark, f"file://{tmp_path}/p0.nc")["pr"].to_numpy()
    np.testing.assert_allclose(got, pr[:8], atol=0.0051)
    assert np.isnan(got[0, 0, 0])
    with pytest.raises(netcdf.NetCDFError, match="pr"):
        netcdf.write((x["pr"] * 1e9), f"file://{tmp_path}/bad", encoding=pack)
    netcdf.write(data(spark, 4, 8)[0]["pr"], f"file://{tmp_path}/p1.nc", encoding=pack)
    both = netcdf.open_dataset(spark, f"file://{tmp_path}/p*.nc")
    assert both.sizes["time"] == 12
    np.testing.assert_allclose(both.to_numpy(), pr, atol=0.0051)
    with pytest.raises(netcdf.NetCDFError):
        netcdf.parse_header(b"\x89HDF\r\n\x1a\n")


def test_stream(spark, tmp_path):
    from cellweave import Lattice
    from cellweave.streaming import append_records, resample_stream

    rows = spark.createDataFrame([(t, float(i)) for i, t in enumerate(TIMES)], "time timestamp_ntz, v double").coalesce(1)
    first = Lattice.from_frame(rows.where(F.col("time") < TIMES[4]), ["time"], ["v"])
    store.write(first, f"file://{tmp_path}/s", unlimited=["time"])
    rows.where(F.col("time") >= TIMES[4]).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("time timestamp_ntz, v double").parquet(f"{tmp_path}/in")
    q = append_records(stream, f"file://{tmp_path}/s", ["time"], ["v"], "time").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    np.testing.assert_array_equal(store.read(spark, f"file://{tmp_path}/s").to_numpy(), np.arange(12.0))
    events = spark.readStream.schema("time timestamp_ntz, v double").parquet(f"{tmp_path}/in").withColumn("time", F.col("time").cast("timestamp"))
    q = resample_stream(events, "time", "1D", "v", "0 seconds").writeStream.outputMode("complete").format("memory").queryName("bins").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("bins").agg(F.sum("sum")).first()[0] == sum(range(4, 12))
