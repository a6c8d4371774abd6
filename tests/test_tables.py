"""Dedup, merge, maintenance and sequencing on hand-made rows."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from bellwire import fixtures as fx
from bellwire.operators import dedup, maintenance as mt, sequence as sq


def table(spark, rows, schema="id long, url string"):
    return spark.createDataFrame(rows, schema)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keep_first_treats_null_keys_as_one_group(spark):
    df = table(spark, [(3, None), (1, None), (2, "a"), (5, "a"), (4, "A")])
    kept = dedup.keep_first(df, ["url"])
    assert sorted(r.id for r in kept.collect()) == [1, 2, 4]
    assert sorted(r.id for r in dedup.keep_first(kept, ["url"]).collect()) == [1, 2, 4]
    with pytest.raises(ValueError):
        dedup.keep_first(df, [])


def test_keep_first_limits_hot_keys_before_the_shuffle(spark, sf_dir):
    text = plan(dedup.keep_first(fx.news(spark, sf_dir), ["title"]))
    assert text.index("Partial") > text.index("Exchange hashpartitioning")


def test_insert_or_ignore_lets_null_keys_through(spark):
    target = table(spark, [(1, "a"), (2, None)])
    batch = table(spark, [(10, "a"), (11, "b"), (12, "b"), (13, None), (14, None)])
    fresh = dedup.insert_or_ignore(target, batch, ["url"], "id")
    assert sorted(r.id for r in fresh.collect()) == [11, 13, 14]


MERGE_CASES = [
    ([(1, "a")], [[(10, "a"), (11, "b"), (12, "b"), (13, None)], [(20, "b"), (21, "c")]]),
    ([(1, None)], [[(10, "a")], [(20, "b")]]),
    ([], [[(10, "a"), (11, "a"), (12, None)], [(20, "b")]]),
    ([], [[], [(20, "b"), (21, "b")], [(30, "b"), (31, None), (32, "c")]]),
    ([(1, "a")], [[(10, None)], [(20, None), (21, "z")]]),
]


def sqlite_merge(target, sources):
    """The same INSERT ... WHERE url NOT IN (...) sequence in SQLite, as the yardstick."""
    con = sqlite3.connect(":memory:")
    con.execute("create table target (id, url)")
    con.executemany("insert into target values (?, ?)", target)
    for i, rows in enumerate(sources):
        con.execute(f"create table s{i} (id, url)")
        con.executemany(f"insert into s{i} values (?, ?)", rows)
        con.execute(f"insert into target select id, url from s{i} where url not in (select url from target)")
    before = {r[0] for r in target}
    return sorted(r[0] for r in con.execute("select id from target") if r[0] not in before)


@pytest.mark.parametrize("target, sources", MERGE_CASES)
def test_merge_sources_sql_mode_equals_not_in(spark, target, sources):
    named = {f"s{i}": table(spark, rows) for i, rows in enumerate(sources)}
    tagged = dedup.tag_sources(named, ["id", "url"])
    got = dedup.merge_sources(table(spark, target), tagged, null_mode="sql")
    assert sorted(r.id for r in got.collect()) == sqlite_merge(target, sources)


@pytest.mark.parametrize("target, sources", MERGE_CASES)
def test_merge_not_in_sql_mode_equals_not_in(spark, target, sources):
    for rows in sources:
        got = dedup.merge_not_in(table(spark, target), table(spark, rows), null_mode="sql")
        assert sorted(r.id for r in got.collect()) == sqlite_merge(target, [rows])


def test_merge_with_a_hot_url_and_many_nulls_equals_not_in(spark):
    """A third of the rows share one url and a third have none."""
    def make(start, n, offset):
        return [(start + i, ["hot", None, f"u{(i * 7 + offset) % 500}"][i % 3]) for i in range(n)]

    target = [(i, f"u{i}") for i in range(50)]
    sources = [make(1000, 900, 0), make(5000, 900, 3), make(9000, 900, 11)]
    named = {f"s{i}": table(spark, rows).repartition(6) for i, rows in enumerate(sources)}
    got = dedup.merge_sources(table(spark, target), dedup.tag_sources(named, ["id", "url"]), null_mode="sql")
    assert sorted(r.id for r in got.collect()) == sqlite_merge(target, sources)


def test_merge_safe_mode_keeps_null_urls_and_first_source_wins(spark):
    tagged = dedup.tag_sources(
        {"x": table(spark, [(10, "b"), (11, "b"), (12, None)]), "y": table(spark, [(20, "b"), (21, "c"), (22, "a")])}, ["id", "url"]
    )
    got = dedup.merge_sources(table(spark, [(1, "a"), (2, None)]), tagged)
    assert sorted(r.id for r in got.collect()) == [10, 11, 12, 21]


def test_assigned_ids_follow_the_target(spark):
    fresh = table(spark, [(7, "b"), (3, "c")]).withColumn("source_rank", F.lit(1))
    out = dedup.assign_ids(fresh.withColumnRenamed("id", "row_no"), table(spark, [(41, "a")]), ["source_rank", "row_no"])
    assert {(r.id, r.url) for r in out.collect()} == {(42, "c"), (43, "b")}


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_row_numbers_are_dense_whatever_the_partitioning(spark, parts):
    """A third of the rows share one key; ids stay 1..N in (key, id) order."""
    df = spark.range(3000).select("id", F.expr("if(id % 3 = 0, 7, id % 50)").alias("k")).repartition(7)
    out = sq.number_rows(df.withColumnRenamed("id", "row"), ["k", "row"], num_partitions=parts).orderBy("id").collect()
    assert [r.id for r in out] == list(range(1, 3001))
    assert [(r.k, r.row) for r in out] == sorted((7 if i % 3 == 0 else i % 50, i) for i in range(3000))


def test_row_numbers_use_no_single_partition_for_the_rows(spark, sf_dir):
    """Only the per-partition totals may meet in one task: they come after an aggregate."""
    text = plan(sq.reindex_by_column(fx.news_large(spark, sf_dir), "score"))
    for piece in text.split("Exchange SinglePartition")[1:]:
        assert "HashAggregate" in piece.split("FileScan")[0]


def test_reindex_needs_the_column(spark):
    with pytest.raises(ValueError):
        sq.reindex_by_column(table(spark, [(1, "a")]), "nope")


def test_running_sums(spark):
    df = spark.range(100).select("id", (F.col("id") % 5).alias("v")).repartition(6)
    out = {r.id: r.before for r in sq.running_sums(df, ["id"], {"before": "v"}, num_partitions=4).collect()}
    assert out == {i: sum(j % 5 for j in range(i)) for i in range(100)}


def test_folds_never_train_on_later_rows(spark):
    df = spark.range(23).select(F.expr("date_add(date'2024-01-01', cast(id as int))").alias("trade_date"))
    rows = sq.time_series_folds(df, "trade_date", 5).collect()
    for fold in range(1, 6):
        train = [r.row_no for r in rows if r.fold == fold and r.role == "train"]
        test = [r.row_no for r in rows if r.fold == fold and r.role == "test"]
        assert len(test) == 3 and max(train) < min(test) and len(train) == 23 - (6 - fold) * 3


def test_filter_rows_keeps_null(spark):
    assert sorted(r.id for r in mt.filter_rows_in(table(spark, [(1, "a"), (2, None), (3, "b")]), "url", ["a"]).collect()) == [1, 2]


def test_keyed_update_overwrites_only_matches(spark):
    out = mt.keyed_update(table(spark, [(1, "a"), (2, "b"), (3, "c")]), table(spark, [(1, None), (2, "z"), (9, "q")]), "id", ["url"])
    assert sorted(map(tuple, out.select("id", "url").collect()), key=str) == sorted([(1, None), (2, "z"), (3, "c")], key=str)


def test_change_report(spark):
    before, after = table(spark, [(1, "a"), (2, "b"), (3, None)]), table(spark, [(2, "x"), (3, None), (4, "n")])
    assert tuple(mt.change_report(before, after, "id", ["url"]).first()) == (1, 1, 1, 1)


def test_columns(spark):
    df = table(spark, [(1, "a")])
    assert mt.drop_column(df, "nope").columns == df.columns
    assert mt.rename_column(df, "url", "link").columns == ["id", "link"]
    assert mt.ensure_column(df, "s").dtypes[-1] == ("s", "double")
    twice = df.select("id", "url", F.col("id").alias("url"))
    assert mt.dedup_column_names(twice).first().asDict() == {"id": 1, "url": "a"}
    with pytest.raises(ValueError):
        mt.require_columns(df, ["id", "zzz"])


def test_filter_by_date_bounds_are_inclusive_and_optional(spark):
    df = table(spark, [(1, "2024-01-01T23:30:00-05:00"), (2, "2024-01-02"), (3, "junk"), (4, None), (5, "2024-01-03T00:00:00Z")])
    pick = lambda *a: sorted(r.id for r in mt.filter_by_date(df, "url", *a).collect())
    assert pick("2024-01-02", "2024-01-02") == [1, 2]
    assert pick(None, "2024-01-02") == [1, 2]
    assert pick("2024-01-03") == [5]
    assert pick() == [1, 2, 3, 4, 5]


def test_typed_date_filter_reaches_the_scan(spark, sf_dir):
    df = mt.filter_by_date(fx.table(spark, sf_dir, "events"), "ts", "2024-01-05", "2024-01-06").select("event_id")
    pushed = plan(df)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed


def test_pending_rules_differ_by_scorer(spark):
    df = spark.createDataFrame([(1, "t", None), (2, "", None), (3, None, None), (4, "t", 0.5)], "id long, title string, s double")
    assert sorted(r.id for r in mt.pending(df, "title", "s").collect()) == [1]
    assert sorted(r.id for r in mt.pending(df, "title", "s", skip_blank_text=False).collect()) == [1, 2, 3]


def test_keyed_update_never_repeats_a_row(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "id int, v string")
    updates = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (2, None, 1), (None, "z", 1)], "id int, v string, at int")
    assert sorted(mt.keyed_update(table, updates, "id", ["v"], order="at").collect(), key=str) == [(1, "x"), (2, None), (None, "c")]
    assert mt.keyed_update(table, updates, "id", ["v"]).count() == 3
