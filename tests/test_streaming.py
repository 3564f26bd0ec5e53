"""Quarterly history renewal as a stream: two uploads, last row wins."""
import os

import pytest
from pyspark.sql import functions as F

from churnlens.streaming import history_stream


def test_history_stream_upsert(spark, tmp_dir):
    from churnlens.plans.catalog import quarterly_fixture
    hist, new = quarterly_fixture(spark, "/root/testdata/sf0.001")
    cols = ["account_id", "as_of_quarter", "usage_count_total", "ticket_count"]
    src = os.path.join(tmp_dir, "in")
    hist.select(*cols).write.parquet(os.path.join(src, "a"))
    schema = spark.read.parquet(os.path.join(src, "a")).schema
    q = history_stream.start(spark, src + "/*", schema, os.path.join(tmp_dir, "table"), os.path.join(tmp_dir, "ck"))
    q.awaitTermination()
    new.select(*cols).withColumn("ticket_count", F.col("ticket_count") + 100).write.parquet(os.path.join(src, "b"))
    hist.select(*cols).where(F.col("as_of_quarter") == hist.agg(F.max("as_of_quarter")).first()[0]) \
        .withColumn("ticket_count", F.lit(-1).cast("long")).write.parquet(os.path.join(src, "c"))
    q = history_stream.start(spark, src + "/*", schema, os.path.join(tmp_dir, "table"), os.path.join(tmp_dir, "ck"))
    q.awaitTermination()
    out = history_stream.read_history(spark, os.path.join(tmp_dir, "table"))
    n_keys = hist.select("account_id", "as_of_quarter").union(new.select("account_id", "as_of_quarter")).distinct().count()
    assert out.count() == n_keys
    assert out.where(F.col("ticket_count") == -1).count() > 0          # later upload overrides history rows
    assert out.where(F.col("ticket_count") >= 100).count() == new.count()


def test_history_survives_a_new_checkpoint_and_a_replay(spark, tmp_dir):
    import datetime as dt
    q1, table, ddl = dt.date(2024, 1, 1), os.path.join(tmp_dir, "t"), "account_id string, as_of_quarter date, ticket_count long"
    for k, account in enumerate(("a", "b")):
        src, ck = os.path.join(tmp_dir, f"in{k}"), os.path.join(tmp_dir, f"ck{k}")
        df = spark.createDataFrame([(account, q1, k)], ddl)
        df.write.parquet(src)
        history_stream.start(spark, src, df.schema, table, ck).awaitTermination()
    assert {r.account_id for r in history_stream.read_history(spark, table).collect()} == {"a", "b"}
    again = history_stream.upsert_batch(table, os.path.join(tmp_dir, "ck1"))
    again(spark.createDataFrame([("b", q1, 9)], ddl), 0)  # batch 0 of that stream is committed
    got = {(r.account_id, r.ticket_count) for r in history_stream.read_history(spark, table).collect()}
    assert got == {("a", 0), ("b", 1)}
    with open(os.path.join(table, history_stream.LATEST, "part-bad.json.gz"), "w") as f:
        f.write("not gzip")
    with pytest.raises(Exception):  # an unreadable log is not "no history"
        again(spark.createDataFrame([("c", q1, 1)], ddl), 1)


def test_empty_history_is_no_history(spark):
    import datetime as dt
    from churnlens.operators import upload
    new = spark.createDataFrame([("a", dt.date(2024, 1, 1), 5, 10.0), ("b", dt.date(2024, 1, 1), 7, 30.0)],
                                "account_id string, as_of_quarter date, seats int, arr_amount double")
    day = dt.date(2024, 6, 30)
    a, b = (sorted(map(str, upload.build_from_quarterly(h, new, day).collect())) for h in (None, new.limit(0)))
    assert a == b


def test_a_batch_rewrites_its_own_quarters_only(spark, tmp_dir):
    import datetime as dt
    table, ck, ddl = os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "ck"), "account_id string, as_of_quarter date, ticket_count long"
    os.makedirs(ck)
    with open(os.path.join(ck, "metadata"), "w") as f:
        f.write('{"id":"s"}')
    run = history_stream.upsert_batch(table, ck)
    run(spark.createDataFrame([(a, dt.date(2023, m, 5), m) for a in "abc" for m in (1, 4, 7)] + [("z", None, 0)], ddl), 0)
    before = {q: sorted(os.listdir(f"{table}/v=0/q={q}")) for q in ("2023-01-01", "2023-04-01", "2023-07-01", "none")}
    run(spark.createDataFrame([("a", dt.date(2023, 5, 1), 50), ("d", dt.date(2023, 4, 1), 60)], ddl), 1)
    assert os.listdir(f"{table}/v=1") and [q for q in sorted(os.listdir(f"{table}/v=1")) if q.startswith("q=")] == ["q=2023-04-01"]
    assert before == {q: sorted(os.listdir(f"{table}/v=0/q={q}")) for q in before}
    assert history_stream.manifest(spark, table) == {"2023-01-01": 0, "2023-04-01": 1, "2023-07-01": 0, "none": 0}
    got = {(r.account_id, str(r.as_of_quarter)): r.ticket_count for r in history_stream.read_history(spark, table).collect()}
    assert len(got) == 11 and got[("a", "2023-04-01")] == 50 and got[("b", "2023-04-01")] == 4 and got[("z", "None")] == 0


def test_a_crash_before_the_commit_is_written_again(spark, tmp_dir, monkeypatch):
    import datetime as dt
    table, ck, ddl = os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "ck"), "account_id string, as_of_quarter date, ticket_count long"
    os.makedirs(ck)
    with open(os.path.join(ck, "metadata"), "w") as f:
        f.write('{"id":"s"}')
    run = history_stream.upsert_batch(table, ck)
    q1, q2 = dt.date(2024, 1, 1), dt.date(2024, 4, 1)
    run(spark.createDataFrame([("a", q1, 1)], ddl), 0)
    spark.createDataFrame([("torn", q1, 9)], ddl).write.parquet(f"{table}/v=1/q=2024-01-01")  # files without a log row
    assert [r.account_id for r in history_stream.read_history(spark, table).collect()] == ["a"]
    run(spark.createDataFrame([("b", q2, 2)], ddl), 1)
    assert {(r.account_id, r.ticket_count) for r in history_stream.read_history(spark, table).collect()} == {("a", 1), ("b", 2)}


def test_the_last_row_of_the_last_file_wins(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    for name, n in (("b.csv", 2), ("a.csv", 1)):
        with open(os.path.join(src, name), "w") as f:
            f.write(f"account_id,as_of_quarter,ticket_count\nx,2024-01-01,{n}0\nx,2024-02-01,{n}1\n")
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL("account_id string, as_of_quarter string, ticket_count int")
    history_stream.start(spark, src, schema, os.path.join(tmp_dir, "t"), os.path.join(tmp_dir, "ck"), fmt="csv").awaitTermination()
    assert [r.ticket_count for r in history_stream.read_history(spark, os.path.join(tmp_dir, "t")).collect()] == [21]
