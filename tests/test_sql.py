from lattiq.functions import sql
from lattiq.model import frames, pixels, rounded
from lattiq.operators import cube
from lattiq.operators import peaks as P

SF = "/root/testdata/sf0.001"


def test_views_and_table_functions(spark):
    sql.create_views(spark, SF)
    sql.register(spark)
    got = {(r["rx"], r["ry"]): r["v"] for r in spark.sql("select rx, ry, round(sum(i), 6) as v from pixels where (qx - 3.5) * (qx - 3.5) + (qy - 3.5) * (qy - 3.5) < 4 group by rx, ry").collect()}
    want = {(r["rx"], r["ry"]): r["v"] for r in cube.virtual_image(frames(spark, SF), cube.circle(3.5, 3.5, 2)).select("rx", "ry", rounded("value").alias("v")).collect()}
    assert got == want
    found = sorted((r["rx"], r["ry"], round(r["qx"], 6), round(r["qy"], 6)) for r in spark.sql("select f.rx, f.ry, t.qx, t.qy from frames f, lateral find_peaks(f.data, 8, 8) t").collect())
    plain = sorted((r["rx"], r["ry"], round(r["qx"], 6), round(r["qy"], 6)) for r in P.maxima(pixels(frames(spark, SF)), ["rx", "ry"], subpixel=True).collect())
    assert found == plain
    n = spark.sql("select sum(t.n) as n from frames f, lateral radial_profile(f.data, 8, 8, 3.5, 3.5) t where f.rx = 0 and f.ry = 0").first()["n"]
    assert n == 64
