"""Images, arrays, tables, taps, external functions, frames and streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions.expr import GridError
from gridloom.functions.types import Float, Int, UInt
from gridloom.operators import extern
from gridloom.plans.func import Func, RDom, Var, sum_
from gridloom.plans.short import param
from gridloom.sources import images, tables
from gridloom.streaming import frames

x, y = Var("x"), Var("y")


@pytest.mark.parametrize("kind", ["png", "ppm"])
@pytest.mark.parametrize("bits", [8, 16])
def test_image_files(spark, tmp_path, kind, bits):
    rng = np.random.default_rng(1)
    image = rng.integers(0, 1 << bits, (5, 7, 3)).astype(np.uint16 if bits == 16 else np.uint8)
    (tmp_path / f"a.{kind}").write_bytes(images.encode_png(image) if kind == "png" else images.encode_ppm(image))
    rows = images.load(spark, f"file://{tmp_path}/a.{kind}")
    got = {(r.y, r.x, r.c): r.v for r in rows.collect()}
    assert got == {(j, i, k): int(image[j, i, k]) for j in range(5) for i in range(7) for k in range(3)}
    back = images.encoded(rows, kind, bits).first()
    assert (images.decode(bytes(back.content)) == image).all()


def test_png_filters():
    import zlib

    image = np.arange(60, dtype=np.uint8).reshape(4, 5, 3) * 3
    raw, rows = image.reshape(4, 15).astype(int), []
    for j in range(4):
        left = np.concatenate([[0, 0, 0], raw[j][:-3]])
        above = raw[j - 1] if j else np.zeros(15, int)
        corner = np.concatenate([[0, 0, 0], above[:-3]])
        guess = left + above - corner
        paeth = np.where((abs(guess - left) <= abs(guess - above)) & (abs(guess - left) <= abs(guess - corner)), left, np.where(abs(guess - above) <= abs(guess - corner), above, corner))
        rows.append(bytes([j + 1]) + bytes(((raw[j] - [left, above, (left + above) // 2, paeth][j]) & 255).astype(np.uint8)))
    plain = images.encode_png(image)
    at = plain.index(b"IDAT")
    n = int.from_bytes(plain[at - 4 : at], "big")
    body = zlib.compress(b"".join(rows))
    filtered = plain[: at - 4] + len(body).to_bytes(4, "big") + b"IDAT" + body + plain[at + 4 + n :]
    assert (images.decode_png(filtered) == image).all()


def test_rescaling(spark):
    row = spark.range(1).select(images.rescaled(F.lit(65535), UInt(16), UInt(8)).alias("a"), images.rescaled(F.lit(3), UInt(8), UInt(16)).alias("b"), images.rescaled(F.lit(0.999), Float(32), UInt(8)).alias("c")).first()
    assert tuple(row) == (255, 768, 254)


def test_arrays(spark):
    a = np.arange(12, dtype=np.int32).reshape(3, 4)
    f = Func("f")
    source = tables.from_numpy(spark, a, ("x", "y"))
    f[x, y] = source[x, y] * 2
    assert (tables.to_numpy(f.realize(spark, 4, 3), ("x", "y"), "f") == a * 2).all()


def test_tables(spark, tmp_path):
    df = spark.range(20).select((F.col("id") - 5).alias("x"), (F.col("id") * 2).alias("v"))
    source = tables.from_table(df, ("x",), {"v": Int(32)})
    assert source.box == {"x": (-5, 20)}
    f = Func("f")
    f[x] = source[x] + 1
    at = f"file://{tmp_path}/f"
    assert tables.realize_into(f, spark, at, (-5, 20)).count() == 20
    g = Func("f")
    g[x] = x * 0
    got = {r.x: r.f for r in tables.update_box(spark, g, at, (0, 2)).collect()}
    assert got[0] == got[1] == 0 and got[2] == 15 and len(got) == 20
    assert tables.tap(df, f"file://{tmp_path}/tap").count() == 20
    assert tables.watched(df, "seen", "v > 10", "v").count() == 20


def test_external_functions(spark):
    twice = extern.vectorized(lambda a, b: a * 2 + b, Int(32), Int(32), Int(32))
    f = Func("f")
    f[x, y] = twice(x, y)
    assert {(r.x, r.y): r.f for r in f.realize(spark, 3, 2).collect()} == {(a, b): 2 * a + b for a in range(3) for b in range(2)}
    with pytest.raises(GridError):
        twice(x)
    sums = extern.stage(f.realize(spark, 3, 2), "y", lambda p: pd.DataFrame({"y": [p["y"].iloc[0]], "s": [p["f"].sum()]}), "y bigint, s bigint")
    assert {r.y: r.s for r in sums.collect()} == {0: 6, 1: 9}


def test_param_range():
    with pytest.raises(GridError):
        param(Int(32), 11, 0, 10)


def test_frames(spark):
    start = spark.range(4).select("id", F.lit(1).alias("v"))
    assert [r.v for r in frames.frames(start, lambda df, k: df.withColumn("v", F.col("v") * 2 + k), 5).orderBy("id").collect()] == [58] * 4


def test_stream_equals_table(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    table.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = frames.hourly(stream, "60 days").writeStream.outputMode("complete").format("memory").queryName("hours").option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("hours").collect())) == sorted(map(tuple, frames.hourly(table).collect()))


def test_plan_of_a_stencil(spark, sf_dir):
    """All taps of a stencil share one aggregation and one join."""
    from gridloom.programs.arrays import grid

    f, g, r = Func("f"), grid(spark, sf_dir), RDom((0, 2))
    f[x, y] = g[x, y] + g[x + 1, y] + g[x, y + 1] + sum_(g[x + r.x, y] * 0)
    plan = f.realize(spark, 10, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2
