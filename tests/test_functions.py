"""Column helpers: strings (X2, X3, P6), maps (X8), versions."""

from pyspark.sql import functions as F

from migrakit.functions.maps import drop_keys, set_key
from migrakit.functions.strings import basename, bounded_text, is_blank, quote_ident, quote_name
from migrakit.functions.versions import version_number, version_suffix


def test_string_helpers(spark):
    df = spark.createDataFrame([("/Workspace/a/b/init.sh", "/Volumes/x///", "x" * 40000)], "p string, b string, e string")
    r = df.select(basename(F.col("p")).alias("n"),
                  F.length(bounded_text(F.col("e"))).alias("e")).first()
    assert (r.n, r.e) == ("init.sh", 32000)
    assert quote_ident("a`b") == "`a``b`" and quote_name("s", "t") == "`s`.`t`"
    assert is_blank("  ") and is_blank(None) and not is_blank("x")


def test_version_parts(spark):
    df = spark.createDataFrame([("13.10.x-cpu-ml-scala2.12",), ("1.x.x-y",), ("nightly",)], "v string")
    got = [(r.n, r.s) for r in df.select(version_number(F.col("v")).alias("n"), version_suffix(F.col("v")).alias("s")).collect()]
    assert got == [("13.10", "-cpu-ml-scala2.12"), ("1", "-y"), ("nightly", "nightly")]


def test_map_helpers(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},), (None,)], "m map<string,string>")
    rows = df.select(drop_keys(F.col("m"), ["a", "zz"]).alias("d"), set_key(F.col("m"), "a", "9").alias("s")).collect()
    assert rows[0].d == {"b": "2"} and rows[0].s == {"b": "2", "a": "9"}
    assert rows[1].d is None and rows[1].s == {"a": "9"}
