"""Sinks by round trip: copy, count, compare full-row hashes, a second run
changes nothing, failures are reported and do not stop the rest."""

import uuid

from pyspark.sql import functions as F

from migrakit.operators.copying import copy_table, copy_tables, plan_copy
from migrakit.operators.journal import file_system, read_journal
from migrakit.operators.sync import SYNC_COLUMNS, apply_sync, plan_sync
from migrakit.operators.verify import verify_copies
from migrakit.session import work_dir
from migrakit.sources.tables import TableRef, count_tables, read_table, records
from migrakit.streaming.resumable_copy import copy_resumable
from tests.conftest import SF_SMALL


def _ref(t, parts=()):
    return TableRef("db", t, "parquet", f"{SF_SMALL}/{t}.parquet", tuple(parts))


def test_partitioned_copy_round_trip_and_skip(spark):
    base = work_dir(spark, "tests", "copy")
    src = _ref("lineitem", ["l_returnflag"])
    out = copy_table(spark, src, f"{base}/lineitem")
    assert out["copied_successfully"] and out["format"] == "parquet"
    dst = src.at(f"{base}/lineitem")
    v = verify_copies(spark, [(src, dst)]).first()
    assert v.verdict == "match" and v.source_count == v.target_count > 0
    flags = {r[0] for r in spark.read.parquet(f"{base}/lineitem").select("l_returnflag").distinct().collect()}
    files = spark.read.parquet(f"{base}/lineitem").inputFiles()
    assert all("l_returnflag=" in f for f in files) and flags
    # Second run with if_exists='skip' leaves the target as it is; only the same source is a success.
    assert copy_table(spark, src, f"{base}/lineitem")["action"] == "skipped"
    again = copy_table(spark, _ref("orders"), f"{base}/lineitem")
    assert again["action"] == "skipped_unverified" and not again["copied_successfully"] and again["error"]
    assert verify_copies(spark, [(src, dst)]).first().verdict == "match"


def test_hash_catches_a_changed_row(spark):
    base = work_dir(spark, "tests", "tamper")
    src = _ref("region")
    df = read_table(spark, src)
    df.withColumn("r_name", F.when(F.col("r_regionkey") == 0, "X").otherwise(F.col("r_name"))) \
      .write.parquet(f"{base}/region")
    v = verify_copies(spark, [(src, src.at(f"{base}/region"))]).first()
    assert v.source_count == v.target_count and v.verdict == "mismatch"


def test_bulk_copy_reports_failures_and_continues(spark):
    base = work_dir(spark, "tests", "bulk")
    tasks = [(_ref("nation"), f"{base}/nation"),
             (TableRef("db", "gone", "parquet", f"{SF_SMALL}/nope.parquet"), f"{base}/gone"),
             (TableRef("db", "d", "delta", f"{SF_SMALL}/region.parquet"), f"{base}/d")]
    out = {r.table_name: r for r in copy_tables(spark, tasks).collect()}
    assert out["nation"].copied_successfully and out["nation"].error is None
    assert not out["gone"].copied_successfully and out["gone"].error
    assert not out["d"].copied_successfully and out["d"].format == "delta"   # no delta jar here
    assert copy_tables(spark, []).count() == 0


def test_converting_copy_keeps_partitions_and_table_name(spark):
    base = work_dir(spark, "tests", "convert")
    db = "c_" + uuid.uuid4().hex[:8]
    spark.sql(f"CREATE DATABASE {db} LOCATION '{base}/db'")
    csv_dir = f"{base}/csv"
    read_table(spark, _ref("orders")).write.option("header", True).csv(csv_dir)
    src = TableRef("db", "orders_csv", "csv", csv_dir, ("o_orderstatus",), options=(("header", "true"),))
    out = copy_table(spark, src, f"{base}/orders", target_name=f"{db}.orders")
    assert out["copied_successfully"] and out["format"] == "parquet"
    assert spark.table(f"{db}.orders").count() == read_table(spark, src).count()
    parts = [c.name for c in spark.catalog.listColumns(f"{db}.orders") if c.isPartition]
    assert parts == ["o_orderstatus"]


def test_counts_with_unreadable_table(spark):
    refs = [_ref("region"), TableRef("db", "gone", "parquet", "/nonexistent/x.parquet")]
    got = {r.table_name: r.n for r in count_tables(spark, refs).collect()}
    assert got == {"region": 5, "gone": None}
    got = {r.table_name: r.n for r in count_tables(spark, refs, isolate=True).collect()}
    assert got == {"region": 5, "gone": None}


def test_plan_copy_and_apply_sync(spark):
    inv = records(spark, [("db", "region", "parquet", f"{SF_SMALL}/region.parquet", "TABLE", False),
                          ("db", "nation", "hive", "dbfs:/x", "TABLE", False)],
                  "database string, table_name string, provider string, location string, "
                  "table_type string, is_temporary boolean")
    counts = records(spark, [("db", "nation", 25)], "database string, table_name string, n long")
    plan = plan_copy(inv, counts, "s3://t/", prefix="/root/testdata").collect()
    assert [(r.table_name, r.source_count, r.ext_loc) for r in plan] == [("nation", 25, "s3://t/db/nation")]
    db = "s_" + uuid.uuid4().hex[:8]
    spark.sql(f"CREATE DATABASE {db} LOCATION '{work_dir(spark, 'tests', db)}'")
    empty = records(spark, [], "database string, table_name string, provider string")
    sync = plan_sync(inv, empty, prefix="/root/testdata")
    out = {r.source_name: r.status for r in apply_sync(spark, sync, db).collect()}
    assert out == {"region": "success"}
    assert spark.table(f"{db}.region").count() == 5


def test_resumable_copy_resumes(spark):
    base = work_dir(spark, "tests", "stream")
    src = _ref("orders", ["o_orderstatus"])
    first = copy_resumable(spark, src, f"{base}/data", checkpoint=f"{base}/ckpt")
    assert first["rows"] == read_table(spark, src).count()
    second = copy_resumable(spark, src, f"{base}/data", checkpoint=f"{base}/ckpt")
    assert second["rows"] == 0
    assert verify_copies(spark, [(src, src.at(f"{base}/data"))]).first().verdict == "match"


def test_skip_never_overwrites_and_tells_what_it_found(spark):
    base = work_dir(spark, "tests", "resume")
    src = _ref("nation")
    # Files of somebody else: left as they are; a copy only if they hold the same rows.
    read_table(spark, _ref("region")).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{base}/nation")
    out = copy_table(spark, src, f"{base}/nation")
    assert out["action"] == "skipped_unverified" and not out["copied_successfully"]
    assert spark.read.parquet(f"{base}/nation").count() == 5
    read_table(spark, src).repartition(3).write.parquet(f"{base}/same")
    assert copy_table(spark, src, f"{base}/same")["action"] == "skipped"
    steps = [r.step for r in read_journal(spark, [f"{base}/same"]).orderBy("at").collect()]
    assert steps == ["verified"]
    # Files that changed after our copy are not what the journal says.
    assert copy_table(spark, src, f"{base}/ours")["action"] == "copied"
    assert copy_table(spark, src, f"{base}/ours")["action"] == "skipped"
    read_table(spark, src).limit(3).write.mode("append").parquet(f"{base}/ours")
    assert copy_table(spark, src, f"{base}/ours")["action"] == "skipped_unverified"


def test_a_broken_overwrite_leaves_the_old_target(spark):
    base = work_dir(spark, "tests", "broken")
    assert copy_table(spark, _ref("supplier"), f"{base}/t")["action"] == "copied"
    spark.createDataFrame([(i,) for i in range(100)], "id long").write.parquet(f"{base}/ids")
    spark.sql(f"CREATE OR REPLACE TEMP VIEW breaks AS SELECT id, IF(id = 99, raise_error('half way'), id) AS x FROM parquet.`{base}/ids`")
    out = copy_table(spark, TableRef("d", "t", name="breaks", provider="parquet"), f"{base}/t", if_exists="overwrite")
    spark.catalog.dropTempView("breaks")
    assert out["action"] == "failed" and "half way" in out["error"]
    assert verify_copies(spark, [(_ref("supplier"), _ref("supplier").at(f"{base}/t"))]).first().verdict == "match"
    steps = [r.step for r in read_journal(spark, [f"{base}/t"]).orderBy("at").collect()]
    assert steps == ["started", "staged", "published", "started", "failed"]
    # A crash between the two moves of a publish: the old target comes back.
    fs, path = file_system(spark, f"{base}/t")
    assert fs.rename(path, file_system(spark, f"{base}/_old.t.x")[1])
    assert copy_table(spark, _ref("supplier"), f"{base}/t")["action"] == "skipped"


def test_a_lost_registration_is_made_again_and_drift_is_told(spark):
    base, db = work_dir(spark, "tests", "names"), "t_" + uuid.uuid4().hex[:8]
    spark.sql(f"CREATE DATABASE {db} LOCATION '{base}/db'")
    src, name = _ref("lineitem", ["l_returnflag"]), f"{db}.lineitem"
    assert copy_table(spark, src, f"{base}/lineitem", target_name=name)["action"] == "copied"
    n = spark.table(name).count()
    assert n == read_table(spark, src).count()
    spark.sql(f"DROP TABLE {name}")
    assert copy_table(spark, src, f"{base}/lineitem", target_name=name)["action"] == "registered"
    assert spark.table(name).count() == n and copy_table(spark, src, f"{base}/lineitem", target_name=name)["action"] == "skipped"
    out = copy_table(spark, src, f"{base}/elsewhere", target_name=name)
    assert out["action"] == "drift" and not out["copied_successfully"] and spark.table(name).count() == n
    sync = spark.createDataFrame([("s", "nation", "TABLE", "parquet", None, f"{SF_SMALL}/nation.parquet", "TO_CREATE")],
                                 ", ".join(f"{c} string" for c in SYNC_COLUMNS))
    assert [apply_sync(spark, sync, db).first().status for _ in range(2)] == ["success", "success"]
    moved = sync.withColumn("location", F.lit(f"{SF_SMALL}/region.parquet"))
    assert apply_sync(spark, moved, db).first().status == "drift"


def test_tables_with_one_target_are_refused(spark):
    base = work_dir(spark, "tests", "clash")
    tasks = [(_ref("nation"), f"{base}/t"), (_ref("region"), f"{base}/t/"), (_ref("supplier"), f"{base}/s")]
    out = {r.table_name: (r.action, r.copied_successfully) for r in copy_tables(spark, tasks).collect()}
    assert out == {"nation": ("refused", False), "region": ("refused", False), "supplier": ("copied", True)}


def test_map_columns_are_copied_and_hashed(spark):
    base = work_dir(spark, "tests", "maps")
    df = spark.sql("SELECT id, map('b', id, 'a', CAST(NULL AS BIGINT)) AS m, array(map(id, struct('x' AS k))) AS deep FROM range(50)")
    df.write.parquet(f"{base}/src")
    src = TableRef("d", "m", "parquet", f"{base}/src")
    out = copy_table(spark, src, f"{base}/dst")
    assert out["action"] == "copied" and out["source_rows"] == 50 and out["source_hash"] is not None
    assert verify_copies(spark, [(src, src.at(f"{base}/dst"))]).first().verdict == "match"


def test_content_hash_tells_nulls_apart(spark):
    from migrakit.sources.tables import table_fingerprint
    h = lambda rows, t: table_fingerprint(spark.createDataFrame(rows, t)).first()["content_hash"]
    assert h([(None, "x")], "a string, b string") != h([("x", None)], "a string, b string")
    t = "a struct<x:string,y:string>, b array<string>"
    assert h([((None, "x"), ["p"])], t) != h([(("x", None), ["p"])], t)
    assert h([(("x", "y"), [None, "p"])], t) != h([(("x", "y"), ["p", None])], t)
    m = "a map<string,int>"
    assert h([({"p": 1, "q": 2},)], m) == h([({"q": 2, "p": 1},)], m) != h([({"p": 2, "q": 1},)], m)


def test_copy_from_plan_and_count_only_check(spark):
    from migrakit.operators.copying import copy_from_plan
    base = work_dir(spark, "tests", "fromplan")
    plan = records(spark, [("db", "region", f"{SF_SMALL}/region.parquet", "parquet", f"{base}/region", None),
                           ("db", "orders", f"{SF_SMALL}/orders.parquet", "parquet", f"{base}/orders",
                            ["o_orderstatus"])],
                   "database string, table_name string, curr_loc string, provider string, ext_loc string, "
                   "partition_col_list array<string>")
    out = {r.table_name: r.action for r in copy_from_plan(spark, plan).collect()}
    assert out == {"region": "copied", "orders": "copied"}
    pairs = [(_ref("region"), _ref("region").at(f"{base}/region")),
             (_ref("orders", ["o_orderstatus"]), _ref("orders").at(f"{base}/orders"))]
    got = {r.table_name: r.verdict for r in verify_copies(spark, pairs, content=False).collect()}
    assert got == {"region": "match", "orders": "match"}


def test_count_is_null_for_a_table_that_fails_while_read(spark):
    base = work_dir(spark, "tests", "corrupt")
    read_table(spark, _ref("region")).write.parquet(f"{base}/t")
    with open(f"{base}/t/part-99999-garbage.parquet".replace("file:", ""), "wb") as f:
        f.write(b"PAR1" + b"\x00" * 64 + b"PAR1")
    refs = [_ref("nation"), TableRef("db", "t", "parquet", f"{base}/t")]
    got = {r.table_name: r.n for r in count_tables(spark, refs).collect()}
    assert got == {"nation": 25, "t": None}


def test_new_layout_is_rebalanced_and_existing_layout_is_kept(spark):
    from migrakit.operators.copying import existing_layout
    base = work_dir(spark, "tests", "layout")
    src = _ref("lineitem", ["l_returnflag"])
    assert existing_layout(spark, src, read_table(spark, src)) == set()
    assert copy_table(spark, src, f"{base}/a")["copied_successfully"]
    part = src.at(f"{base}/a")
    assert existing_layout(spark, part, read_table(spark, part)) == {"l_returnflag"}
    # Copy the partitioned copy again: layout kept, rows and content equal.
    assert copy_table(spark, part, f"{base}/b")["copied_successfully"]
    assert verify_copies(spark, [(src, part.at(f"{base}/b"))]).first().verdict == "match"
    files = read_table(spark, part.at(f"{base}/b")).inputFiles()
    assert len({f.rsplit("/", 2)[-2] for f in files}) == 3


def test_apply_sync_by_copy(spark):
    db = "sc_" + uuid.uuid4().hex[:8]
    base = work_dir(spark, "tests", db)
    spark.sql(f"CREATE DATABASE {db} LOCATION '{base}/db'")
    inv = records(spark, [("db", "orders", "parquet", f"{SF_SMALL}/orders.parquet", "TABLE", False)],
                  "database string, table_name string, provider string, location string, "
                  "table_type string, is_temporary boolean")
    empty = records(spark, [], "database string, table_name string, provider string")
    sync = plan_sync(inv, empty, prefix="/root/testdata")
    out = apply_sync(spark, sync, db, mode="copy", base=f"{base}/data").collect()
    assert [(r.source_name, r.status) for r in out] == [("orders", "success")]
    assert spark.table(f"{db}.orders").count() == read_table(spark, _ref("orders")).count()
    assert spark.catalog.getTable(f"{db}.orders").tableType == "EXTERNAL"


def test_fingerprint_observed_during_copy_equals_a_read_of_the_source(spark):
    from migrakit.sources.tables import table_fingerprint
    base = work_dir(spark, "tests", "observe")
    for src in (_ref("lineitem", ["l_returnflag"]), _ref("documents")):
        out = copy_table(spark, src, f"{base}/{src.table}")
        fp = table_fingerprint(read_table(spark, src)).first()
        assert (out["source_rows"], out["source_hash"]) == (fp.n, fp.content_hash)
        known = {(src.database, src.table): (out["source_rows"], out["source_hash"])}
        v = verify_copies(spark, [(src, src.at(f"{base}/{src.table}"))], known_sources=known).first()
        assert v.verdict == "match" and v.source_count == fp.n


def test_resumable_copy_counts_every_batch(spark):
    base = work_dir(spark, "tests", "many")
    spark.range(0, 240, 1, 120).write.parquet(f"{base}/src")
    out = copy_resumable(spark, TableRef("d", "many", "parquet", f"{base}/src"), f"{base}/data",
                         checkpoint=f"{base}/ckpt", max_files_per_trigger=1)
    assert (out["batches"], out["rows"], out["source_rows"]) == (120, 240, 240)
    from migrakit.sources.tables import table_fingerprint
    assert out["source_hash"] == table_fingerprint(spark.read.parquet(f"{base}/src")).first()["content_hash"]


def test_a_provider_that_cannot_be_read_is_a_failed_outcome(spark):
    base = work_dir(spark, "tests", "hive")
    out = copy_table(spark, TableRef("d", "h", "hive", f"{SF_SMALL}/nation.parquet"), f"{base}/h")
    assert out["action"] == "failed" and not out["copied_successfully"] and "Hive" in out["error"]


def test_an_unreadable_side_tells_why(spark, tmp_path):
    records(spark, [(1,), (2,)], "a int").write.parquet(f"{tmp_path}/src")
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_text("no parquet")
    src = TableRef("d", "t", "parquet", f"{tmp_path}/src")
    for content in (True, False):
        r, = verify_copies(spark, [(src, src.at(str(broken)))], content=content, reasons=True).collect()
        assert (r["verdict"], r["source_count"], r["source_error"]) == ("unknown", 2, None) and "part-0" in r["target_error"]
        r, = verify_copies(spark, [(src, src)], content=content, reasons=True).collect()
        assert (r["verdict"], r["source_error"], r["target_error"]) == ("match", None, None)
    for isolate in (True, False):
        r, = count_tables(spark, [src.at(f"{tmp_path}/nowhere")], isolate=isolate, reasons=True).collect()
        assert r["n"] is None and r["error"].startswith("[PATH_NOT_FOUND]")
