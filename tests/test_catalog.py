"""Inventory from a live catalog, then the copy plan and sync over it."""

import uuid

from pyspark.sql import functions as F

from migrakit.operators.copying import copy_table, needs_copy
from migrakit.operators.sync import plan_sync
from migrakit.session import work_dir
from migrakit.sources import tables
from migrakit.sources.catalog import described, inventory_from_catalog, list_extended, list_tables
from migrakit.sources.tables import TableRef, count_tables, footer_session, read_table, records
from tests.conftest import SF_SMALL


def test_inventory_from_catalog(spark):
    db = "inv_" + uuid.uuid4().hex[:8]
    base = work_dir(spark, "tests", db)
    spark.sql(f"CREATE DATABASE {db} LOCATION '{base}/db'")
    spark.catalog.createTable(f"{db}.region", path=f"{SF_SMALL}/region.parquet", source="parquet")
    src = TableRef("x", "orders", "parquet", f"{SF_SMALL}/orders.parquet", ("o_orderstatus",))
    assert copy_table(spark, src, f"{base}/orders", target_name=f"{db}.orders")["copied_successfully"]
    spark.sql(f"CREATE VIEW {db}.v AS SELECT r_name FROM {db}.region")
    inv = {r.table_name: r for r in inventory_from_catalog(spark, [db, "no_such_db"]).collect()}
    assert set(inv) == {"region", "orders", "v", None}
    assert inv[None].database == "no_such_db" and inv[None].error and inv["v"].error is None
    assert inv["region"].provider == "parquet" and inv["region"].location.endswith("region.parquet")
    assert inv["orders"].partition_columns == ["o_orderstatus"]
    assert inv["v"].table_type == "VIEW" and "r_name" in inv["v"].view_text
    assert [r.table_name for r in list_tables(spark, ["no_such_db"]).collect()] == [None]
    full = inventory_from_catalog(spark, [db])
    chosen = {r.table_name for r in needs_copy(full, prefix="file:").collect()}
    assert chosen == set()                                  # both tables are on "external" storage
    empty = records(spark, [], "database string, table_name string, provider string")
    codes = {r.source_name: r.status_code for r in plan_sync(full, empty, prefix="file:").collect()}
    assert codes == {"region": "TO_CREATE", "orders": "TO_CREATE", "v": "VIEWS_NOT_SUPPORTED"}


def test_bulk_listing_equals_describe(spark):
    """The bulk listing gives what the describe of every table gives; texts that hold
    lines like those of the listing are described one by one."""
    db = "inv_" + uuid.uuid4().hex[:8]
    spark.sql(f"CREATE DATABASE {db} LOCATION '{work_dir(spark, 'tests', db)}/db'")
    spark.sql(f"CREATE TABLE {db}.plain (a INT, Type STRING, Location STRING) USING orc")
    spark.sql(f"CREATE TABLE {db}.parts (a INT, `b x` INT, `c``q` INT) USING parquet PARTITIONED BY (`b x`, `c``q`)")
    spark.sql(f"CREATE TABLE {db}.odd (a INT) USING parquet COMMENT 'x\nLocation: s3://no\nProvider: delta\nOwner: nobody'")
    spark.sql(f"CREATE TABLE {db}.told (a INT) USING parquet COMMENT 'x\nPartition Columns: [`a`]\nProvider: delta'")
    spark.sql(f"CREATE VIEW {db}.lines AS SELECT a,\n '-- b' AS b\n FROM {db}.plain")
    spark.sql(f"CREATE VIEW {db}.odd_view AS SELECT a, '\nView Original Text: x\nLocation: y' AS b FROM {db}.plain")
    keys = ["provider", "location", "owner", "table_type", "view_text", "partition_columns", "is_temporary", "error"]
    want = {r.table_name: [r[k] for k in keys] for r in described(spark, list_tables(spark, [db])).collect()}
    got = {r.table_name: [r[k] for k in keys] for r in inventory_from_catalog(spark, [db]).collect()}
    for name, row in want.items():
        row[3] = "VIEW" if row[3] == "VIEW" else "TABLE"
    assert got == want and set(got) == {"plain", "parts", "odd", "told", "lines", "odd_view"}
    assert got["parts"][5] == ["b x", "c`q"] and got["lines"][4].count("\n") == 2 and got["told"][5] == []
    bulk, unlisted = list_extended(spark, [db, "no_such_db"])
    assert unlisted == ["no_such_db"]
    assert {r.table_name for r in bulk.where("plain").collect()} >= {"plain", "parts", "lines"}
    assert {r.table_name for r in bulk.where("NOT plain").collect()} == {"odd", "told", "odd_view"}
    assert inventory_from_catalog(spark, []).count() == 0


def test_counts_come_from_footers(spark, tmp_path, monkeypatch):
    """Counts read footers only; a block with a broken table is halved until it stands alone."""
    monkeypatch.setattr(tables, "COUNT_BLOCK", 4)
    own = footer_session(spark)
    ref = TableRef("x", "orders", "parquet", f"{SF_SMALL}/orders.parquet")
    plan = read_table(own, ref).groupBy().count()._jdf.queryExecution().toString()
    assert "PushedAggregation: [COUNT(*)]" in plan
    assert "useV1SourceList" not in spark.conf.getAll or "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")
    refs, want = [], {}
    for i in range(7):
        kind = "orc" if i % 2 else "parquet"
        spark.range(i * 10).withColumn("p", F.col("id") % 3).write.format(kind).partitionBy(*(["p"] if i == 4 else [])).save(f"{tmp_path}/t{i}")
        refs.append(TableRef("x", f"t{i}", kind, f"{tmp_path}/t{i}"))
        want[f"t{i}"] = i * 10
    spark.range(5).write.parquet(f"{tmp_path}/broken")
    for f in (tmp_path / "broken").glob("*.parquet"):
        f.write_bytes(b"PAR1 no footer")
    spark.range(5).write.json(f"{tmp_path}/text")
    refs += [TableRef("x", "broken", "parquet", f"{tmp_path}/broken"), TableRef("x", "gone", "parquet", f"{tmp_path}/gone"),
             TableRef("x", "text", "json", f"{tmp_path}/text")]
    want |= {"broken": None, "gone": None, "text": 5}
    got = {r.table_name: r for r in count_tables(spark, refs, reasons=True).collect()}
    assert {k: r.n for k, r in got.items()} == want
    assert got["broken"].error and got["gone"].error and got["t3"].error is None
    assert count_tables(spark, []).count() == 0
