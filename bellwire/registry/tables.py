"""Scans, sinks, catalog tables and table maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from bellwire import fixtures as fx
from bellwire.operators import maintenance as mt
from bellwire.operators.dedup import keep_first
from bellwire.operators.sequence import reindex_by_column, resolve_row_id
from bellwire.functions.timez import standardize_text
from bellwire.registry.base import entry, plain, r6, sql_r6
from bellwire.schemas import HEADLINES
from bellwire.session import materialise, work_path
from bellwire.sources import prices as px
from bellwire.sources import tables as tb

_NEWS_COLS = [f.name for f in HEADLINES.fields]


def _name(label: str) -> str:
    return f"bw_{label}_{uuid.uuid4().hex[:12]}"


def _stored(df, label):
    """Save as a catalog table under the work folder and return its name."""
    name = _name(label)
    df.write.option("path", work_path(df.sparkSession, label)).saveAsTable(name)
    return name


def scan_full(spark, sf):
    return plain(tb.scan(spark, f"{sf}/orders.parquet"))


def scan_pruned_notnull(spark, sf):
    return tb.scan_not_null(fx.news(spark, sf), ["id", "source", "score"], ["score"])


def scan_parse_dates(spark, sf):
    orders = fx.table(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("string"))
    return plain(tb.scan_dates(orders, ["o_orderkey", "o_orderdate", "o_totalprice"], "o_orderdate"))


def table_info(spark, sf):
    """Position, name and type of the columns of the scored headlines, with each column's null count."""
    df = fx.news(spark, sf)
    nulls = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    long = nulls.unpivot([], df.columns, "name", "n_nulls")
    return mt.table_info(df).join(F.broadcast(long), "name")


def row_id_resolve(spark, sf):
    """lineitem has no id: rows are numbered in key order. orders keeps its own key."""
    lines = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]
    return plain(resolve_row_id(lines, "id", order))


def create_if_absent(spark, sf):
    """An empty table is created once; a second call leaves the rows in place."""
    name = _name("headlines")
    path = work_path(spark, "headlines")
    tb.create_if_absent(spark, name, HEADLINES, path)
    tb.append_table(fx.news(spark, sf).select(*_NEWS_COLS), name, path)
    return tb.create_if_absent(spark, name, HEADLINES, path).select("id", "source", "url")


def replace_table(spark, sf):
    orders = fx.table(spark, sf, "orders")
    first = tb.replace_table(orders, "orders")
    return plain(tb.replace_table(first.where("o_orderstatus <> 'F'"), "orders"))


def keyed_update(spark, sf):
    """Returned lines replace the order total; other orders keep theirs."""
    returned = (
        fx.table(spark, sf, "lineitem")
        .where("l_returnflag = 'R'")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice"))
    )
    out = mt.keyed_update(fx.table(spark, sf, "orders"), returned, "o_orderkey", ["o_totalprice"])
    return out.select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


def ensure_column(spark, sf):
    events = fx.news_large(spark, sf).select("id", "source")
    return mt.ensure_column(mt.ensure_column(events, "lm_sentiment_score"), "source", "string")


def delete_by_id(spark, sf):
    returned = fx.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return plain(mt.delete_by_id(fx.table(spark, sf, "orders"), returned, "o_orderkey"))


def change_report(spark, sf):
    before = fx.news(spark, sf).select("id", "title", "published_at")
    after = keep_first(before, ["title"]).withColumn("published_at", standardize_text("published_at"))
    return mt.change_report(before, after, "id", ["published_at"])


def sample_first10(spark, sf):
    return plain(mt.sample_first(fx.bars_long(spark, sf), "trade_date"))


def drop_table(spark, sf):
    name = _stored(fx.table(spark, sf, "orders"), "orders")
    rows = materialise(mt.count_rows(spark.table(name)), "count")
    return rows.withColumn("dropped", F.lit(tb.drop_table(spark, name)))


def rename_table(spark, sf):
    return plain(tb.rename_table(spark, _stored(fx.bars_long(spark, sf), "bars"), _name("renamed")))


def copy_table(spark, sf):
    source = _stored(fx.table(spark, sf, "customer"), "customer")
    return tb.copy_table(spark, source, _name("copy"), work_path(spark, "copy"))


def copy_between(spark, sf):
    return tb.copy_between(spark, f"{sf}/supplier.parquet", work_path(spark, "supplier"))


def drop_column(spark, sf):
    df = mt.drop_column(fx.table(spark, sf, "orders"), "o_totalprice")
    return plain(mt.drop_column(df, "no_such_column"))


def rename_column(spark, sf):
    df = mt.rename_column(fx.table(spark, sf, "orders"), "o_totalprice", "total")
    return plain(mt.rename_column(df, "no_such_column", "x"))


def reindex(spark, sf):
    return reindex_by_column(fx.news_large(spark, sf).select("id", "score", "source"), "score")


def filter_by_date(spark, sf):
    kept = mt.filter_by_date(fx.news(spark, sf), "published_at", "2024-01-05", "2024-01-20")
    return kept.select("id", "published_at")


def filter_rows_in(spark, sf):
    orders = fx.table(spark, sf, "orders").withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '5-LOW')"))
    return plain(mt.filter_rows_in(orders, "o_orderpriority", ["1-URGENT", "2-HIGH"]))


def reorder_by_date(spark, sf):
    return plain(tb.replace_table(mt.reorder_by(fx.bars_long(spark, sf), "trade_date"), "bars"))


def prices_with_returns(spark, sf):
    """Late batch of all bars onto a table that holds the first half year; known dates are ignored."""
    long = fx.bars_long(spark, sf)
    target = long.where("trade_date < date'1998-01-01'")
    out = px.store_prices(target, long)
    return plain(out.withColumn("daily_return", r6("daily_return")))


def load_prices(spark, sf):
    raw = fx.bars_long(spark, sf).select(
        F.date_format("trade_date", "yyyy-MM-dd").alias("Date"),
        F.col("open_price").alias("Open"),
        F.col("close_price").alias("Close"),
        F.col("high_price").alias("High"),
        F.col("low_price").alias("Low"),
        F.col("volume").alias("Volume"),
    )
    return plain(px.load_prices(spark, tb.write_csv(raw, work_path(spark, "prices-csv"))))


def dropna_subset(spark, sf):
    return mt.drop_incomplete(fx.news(spark, sf).select("id", "published_at", "url", "score"), ["published_at", "score"])


def dedup_columns(spark, sf):
    bars = fx.bars_long(spark, sf)
    twice = bars.select("trade_date", "open_price", "close_price", bars["close_price"] * 2, bars["volume"])
    return plain(mt.dedup_column_names(twice.toDF("trade_date", "open_price", "close_price", "open_price", "volume")))


_ORDERS = "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, cast(o_orderdate as varchar) as o_orderdate, o_orderpriority from orders"
_BARS = "select cast(trade_date as varchar) as trade_date, open_price, close_price, high_price, low_price, volume"
_NULLS = ["id", "source", "lang", "n_chars", "title", "ts", "published_at", "url", "score"]

ENTRIES = {
    "scan_full": entry(scan_full, _ORDERS),
    "scan_pruned_notnull": entry(scan_pruned_notnull, "select id, source, score from fx_news where score is not null"),
    "scan_parse_dates": entry(
        scan_parse_dates,
        "select o_orderkey, cast(cast(o_orderdate as date) as varchar) as o_orderdate, o_totalprice from orders",
    ),
    "table_info": entry(
        table_info,
        " union all ".join(
            f"""select {i} as cid, '{c}' as name, count(*) filter (where {c} is null) as n_nulls,
                  case any_value(typeof({c})) when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double'
                    when 'TIMESTAMP' then 'timestamp_ntz' end as type from fx_news"""
            for i, c in enumerate(_NULLS)
        ),
    ),
    "row_id_resolve": entry(
        row_id_resolve,
        """select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_shipdate as varchar) as l_shipdate, l_extendedprice,
             row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as rid
           from lineitem""",
    ),
    "create_if_absent": entry(create_if_absent, "select id, source, url from fx_news"),
    "replace_table": entry(replace_table, f"select * from ({_ORDERS}) where o_orderstatus <> 'F'"),
    "keyed_update": entry(
        keyed_update,
        """select o_orderkey, round(coalesce(u.total, o_totalprice), 2) as o_totalprice from orders left join (
             select l_orderkey, round(sum(l_extendedprice), 2) as total from lineitem
             where l_returnflag = 'R' group by 1) u on l_orderkey = o_orderkey""",
    ),
    "ensure_column": entry(
        ensure_column, "select id, source, cast(null as double) as lm_sentiment_score from fx_news_large"
    ),
    "delete_by_id": entry(
        delete_by_id,
        f"select * from ({_ORDERS}) where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')",
    ),
    "change_report": entry(
        change_report,
        """with a as (select *, row_number() over (partition by title order by id) as rn from fx_news)
           select count(*) filter (where rn > 1) as removed, cast(0 as bigint) as added,
             count(*) filter (where rn = 1 and published_at is distinct from standard_at) as updated,
             count(*) filter (where rn = 1 and published_at is not distinct from standard_at) as kept from a""",
    ),
    "sample_first10": entry(sample_first10, f"{_BARS} from fx_bars_long order by trade_date limit 10"),
    "drop_table": entry(drop_table, "select count(*) as n_rows, true as dropped from orders"),
    "rename_table": entry(rename_table, f"{_BARS} from fx_bars_long"),
    "copy_table": entry(copy_table, "select * from customer"),
    "copy_between": entry(copy_between, "select * from supplier"),
    "drop_column": entry(drop_column, f"select * exclude (o_totalprice) from ({_ORDERS})"),
    "rename_column": entry(rename_column, f"select * rename (o_totalprice as total) from ({_ORDERS})"),
    "reindex_by_column": entry(
        reindex, "select row_number() over (order by score, id) as id, score, source from fx_news_large"
    ),
    "filter_by_date": entry(
        filter_by_date,
        """select id, published_at from fx_news
           where cast(pub_ts as date) between date '2024-01-05' and date '2024-01-20'""",
    ),
    "count_nulls": entry(
        lambda spark, sf: mt.count_nulls(fx.news(spark, sf), "url"),
        "select count(*) as n_nulls from fx_news where url is null",
    ),
    "count_rows": entry(
        lambda spark, sf: mt.count_rows(fx.table(spark, sf, "lineitem")), "select count(*) as n_rows from lineitem"
    ),
    "filter_rows_in": entry(
        filter_rows_in,
        f"""select * replace (nullif(o_orderpriority, '5-LOW') as o_orderpriority) from ({_ORDERS})
            where o_orderpriority in ('1-URGENT', '2-HIGH', '5-LOW')""",
    ),
    "reorder_by_date": entry(reorder_by_date, f"{_BARS} from fx_bars_long"),
    "load_prices": entry(load_prices, f"{_BARS} from fx_bars_long"),
    "prices_with_returns": entry(
        prices_with_returns,
        f"""{_BARS}, increase, {sql_r6('daily_return')} as daily_return from fx_returns_long""",
    ),
    "dropna_subset": entry(
        dropna_subset,
        "select id, published_at, url, score from fx_news where published_at is not null and score is not null",
    ),
    "dedup_columns": entry(
        dedup_columns, "select cast(trade_date as varchar) as trade_date, open_price, close_price, volume from fx_bars_long"
    ),
}
