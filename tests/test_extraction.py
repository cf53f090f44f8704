from pyspark.sql import functions as F

from citeflow.operators import extraction as ex


def test_typing(spark):
    df = spark.createDataFrame([(" Yes ", "a, b;c ;", "2022", "295 (187 contemporary + 108 historical)", "maybe")],
                               "sweeps string, genes string, year string, samples string, polygenic string")
    (r,) = ex.typed(df).collect()
    assert r["sweeps"] is True and r["polygenic"] is None
    assert r["genes"] == ["a", "b", "c"]
    assert r["year"] == 2022 and r["samples_n"] == 295


def test_quantity_bounds(spark):
    vals = ["~0.01-0.16", "0.06–0.20 per year", "Varies, range ~0.01-0.16", "295 (187 + 108)", "0.5", None]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    lo, hi = ex.quantity_bounds(F.col("v"))
    got = [tuple(r) for r in df.select(lo, hi).collect()]
    assert got == [(0.01, 0.16), (0.06, 0.2), (0.01, 0.16), (295.0, 295.0), (0.5, 0.5), (None, None)]


def test_union_and_frequencies(spark):
    a = spark.createDataFrame([(True, 1)], "sweeps boolean, pmid long")
    b = spark.createDataFrame([(False,), (None,)], "sweeps boolean")
    u = ex.union_layouts(a, b)
    assert u.count() == 3 and u.where(F.col("pmid").isNull()).count() == 2
    (f,) = ex.category_frequency(u, ["sweeps"]).collect()
    assert (f["yes"], f["answered"], f["share"]) == (1, 2, 0.5)
    ent = spark.createDataFrame([(1, ["x", "y", "x"]), (2, ["x"])], "k long, e array<string>")
    got = {r["entity"]: r["papers"] for r in ex.entity_frequency(ent, "e", "k").collect()}
    assert got == {"x": 2, "y": 1}


def test_quantities_with_exponents_thousands_and_signs(spark):
    cells = {"1e-4": (1e-4, 1e-4), "1,024": (1024.0, 1024.0), "2 loci, 0.01-0.16": (0.01, 0.16), "-0.05": (-0.05, -0.05),
             "~0.01-0.16": (0.01, 0.16), "0.06\u20130.20 per year": (0.06, 0.20), "1e-4 - 1e-3": (1e-4, 1e-3), "1,000-2,500": (1000.0, 2500.0),
             "295 (187 contemporary + 108 historical)": (295.0, 295.0), "none": (None, None), "-0.2--0.1": (-0.2, -0.2), "s=3.5E2x": (350.0, 350.0)}
    df = spark.createDataFrame([(c,) for c in cells], "c string")
    lo, hi = ex.quantity_bounds(F.col("c"))
    assert {r["c"]: (r["lo"], r["hi"]) for r in df.select("c", lo.alias("lo"), hi.alias("hi")).collect()} == cells
