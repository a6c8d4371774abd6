"""Shared parts of the registered queries: the stand-in tables as SQL, and output helpers."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bellwire.fixtures import NEGATIVE_WORDS, POSITIVE_WORDS, PRIORITIES
from bellwire.functions.replies import source_column
from bellwire.functions.text import BLANKS, WORD
from bellwire.session import configure


class Entry(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


def entry(run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> Entry:
    def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(configure(spark), sf_dir)

    return Entry(configured, None if sql is None else with_views(sql))


def plain(df: DataFrame) -> DataFrame:
    """Dates and timestamps as text, so both engines print them alike."""
    temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, temporal) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def r6(col: Column | str) -> Column:
    """Round half up to 6 digits, as a double.

    Going through a decimal with 9 digits makes exact halves fall the same way in both engines;
    adding 0.0 turns a negative zero into zero.
    """
    col = F.col(col) if isinstance(col, str) else col
    return F.round(col.cast("decimal(38,9)"), 6).cast("double") + F.lit(0.0)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(F.col(f"`{c}`")) for c in columns})


def sql_r6(expr: str) -> str:
    return f"(cast(round(cast({expr} as decimal(38,9)), 6) as double) + 0.0::double)"


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_list(values) -> str:
    return ", ".join(sql_text(v) for v in values)


NY = "'America/New_York'"

_priority_cols = ",\n".join(
    f"max(case when source = '{p}' then sentiment end) as {source_column('avg_sentiment', p)}" for p in PRIORITIES
)

VIEWS = {
    "fx_news0": """
        select doc_id as id, source, lang, n_chars, text as title,
               timestamp '2024-01-01 00:00:00' + to_seconds(doc_id * 7919 % 2592000) as ts
        from documents""",
    "fx_news": """
        select id, source, lang, n_chars, title, ts,
          case when n_chars < 100 then 'date unknown'
               when n_chars < 200 then null
               when n_chars % 6 = 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00:00'
               when n_chars % 6 = 1 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'
               when n_chars % 6 = 2 then strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.250Z'
               when n_chars % 6 = 3 then strftime(ts - interval 5 hour, '%Y-%m-%d %H:%M:%S') || '-05:00'
               when n_chars % 6 = 4 then strftime(ts, '%Y-%m-%d %H:%M:%S')
               else strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' end as published_at,
          case when n_chars < 200 then null
               when n_chars % 6 = 2 then ts + interval 250 millisecond else ts end as pub_ts,
          case when n_chars < 100 then 'date unknown' when n_chars < 200 then null
               else strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00:00' end as standard_at,
          case when n_chars % 97 <> 0 then 'https://example.com/' ||
               cast((id // 10) * 9 + least(id % 10, 8) as varchar) end as url,
          case when n_chars % 13 <> 0 then (id * 37 % 201 - 100) / 100.0::double end as score
        from fx_news0""",
    "fx_news_large": "select event_id as id, event_type as source, ts, value as score from events",
    "fx_days": """
        select distinct cast(ts as date) as trade_date from events
        where isodow(ts) < 6 and cast(ts as date) not in (date '2024-01-01', date '2024-01-15')""",
    "fx_bars": """
        select cast(ts as date) as trade_date, min_by(value, ts) as open_price, max_by(value, ts) as close_price,
               max(value) as high_price, min(value) as low_price, count(*) as volume
        from events where cast(ts as date) in (select trade_date from fx_days) group by 1""",
    "fx_bars_long": """
        select cast(o_orderdate as date) as trade_date, min_by(o_totalprice, o_orderkey) as open_price,
               max_by(o_totalprice, o_orderkey) as close_price, max(o_totalprice) as high_price,
               min(o_totalprice) as low_price, count(*) as volume
        from orders group by 1""",
    "fx_bars_symbol": """
        select o_orderpriority as symbol, cast(o_orderdate as date) as trade_date,
               min_by(o_totalprice, o_orderkey) as open_price, max_by(o_totalprice, o_orderkey) as close_price,
               max(o_totalprice) as high_price, min(o_totalprice) as low_price, count(*) as volume
        from orders group by 1, 2""",
    "fx_day_source": """
        select cast(o_orderdate as date) as trade_date, o_orderpriority as source,
               avg(o_totalprice) / 500000 as sentiment
        from orders group by 1, 2""",
    "fx_returns_long": """
        select *, cast(close_price > open_price as integer) as increase,
               (close_price - open_price) / nullif(open_price, 0) as daily_return from fx_bars_long""",
    "fx_returns_symbol": """
        select *, cast(close_price > open_price as integer) as increase,
               (close_price - open_price) / nullif(open_price, 0) as daily_return from fx_bars_symbol""",
    "fx_market": f"""
        select r.*, s.* exclude (trade_date) from fx_returns_long r left join (
          select trade_date, avg(sentiment) as avg_sentiment, {_priority_cols}
          from fx_day_source group by 1) s on s.trade_date = r.trade_date""",
    "fx_scored": """
        select doc_id as id, quality as label, cast((doc_id * 37) % 101 as double) / 100 as proba from labels""",
    "fx_vectors": """
        select vec_id as id, date '2024-01-02' + cast(vec_id % 20 as integer) as trade_date, embedding, label
        from embeddings""",
    "fx_lexicon": "select * from (values "
    + ", ".join([f"('{w}', 1)" for w in POSITIVE_WORDS] + [f"('{w}', -1)" for w in NEGATIVE_WORDS])
    + ") t(word, polarity)",
    "fx_clean": f"""
        select *, lower(trim(regexp_replace(regexp_replace(title, '[^{WORD}{BLANKS}]', '', 'g'),
                 '[{BLANKS}]+', ' ', 'g'))) as title_clean from fx_news""",
    "fx_tokens": f"""
        select id, unnest(regexp_extract_all(lower(title_clean), '[{WORD}]+')) as token from fx_clean""",
    "fx_vocabulary": f"""
        select distinct unnest(regexp_extract_all(lower(text), '[{WORD}]+')) as w from documents""",
    "fx_gaps": f"""
        select trade_date, prev_date,
               (prev_date + interval 16 hour) at time zone {NY} at time zone 'UTC' as window_start,
               (trade_date + interval 9 hour + interval 30 minute) at time zone {NY} at time zone 'UTC' as window_end
        from (select trade_date, lag(trade_date) over (order by trade_date) as prev_date from fx_days)
        where prev_date is not null""",
    "fx_pre_market": f"""
        select trade_date,
               (trade_date + interval 9 hour + interval 30 minute) at time zone {NY} at time zone 'UTC'
                 - interval 12 hour as window_start,
               (trade_date + interval 9 hour + interval 30 minute) at time zone {NY} at time zone 'UTC' as window_end
        from fx_days""",
    "fx_matched": """
        select n.*, g.trade_date from fx_news_large n
        join fx_gaps g on n.ts >= g.window_start and n.ts <= g.window_end""",
    "fx_pages": """
        select upper(source[1:1]) || source[2:] || '.example.com' as domain,
               date '2024-01-01' + cast(7 * (id // 500) as integer) as slice_start,
               cast(id % 500 // 100 + 1 as integer) as page, source, id, n_chars, title, standard_at, pub_ts, url
        from fx_news""",
    "fx_page_status": """
        select domain, slice_start, page, min(n_chars) < 10 as failed, max(n_chars) > 25000 as broken
        from fx_pages group by all""",
    "fx_page_limits": """
        select domain, slice_start, min(case when failed or broken then page end) as first_bad
        from fx_page_status group by all""",
    "fx_articles": f"""
        select p.source, regexp_replace(p.title, '\\A[{BLANKS}]+|[{BLANKS}]+\\z', '', 'g') as title,
               p.standard_at as published_at, p.url, p.domain, p.slice_start, p.page, p.id
        from fx_pages p join fx_page_limits l on l.domain = p.domain and l.slice_start = p.slice_start
        where (l.first_bad is null or p.page < l.first_bad)
          and exists (select 1 from fx_page_status s where s.domain = p.domain and s.slice_start = p.slice_start
                      and s.page = 1 and not s.failed and not s.broken)
          and p.pub_ts is not null and p.url is not null
          and regexp_replace(p.title, '\\A[{BLANKS}]+|[{BLANKS}]+\\z', '', 'g') <> ''""",
}


def with_views(sql: str) -> str:
    """Prefix the query with the views it names, and the views those name, in order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in re.findall(r"\bfx_\w+\b", text):
            if name in VIEWS and name not in needed:
                needed.add(name)
                visit(VIEWS[name])

    visit(sql)
    if not needed:
        return sql.strip()
    # VIEWS lists a view after the views it reads.
    parts = ",\n".join(f"{name} as ({VIEWS[name].strip()})" for name in VIEWS if name in needed)
    body = sql.strip()
    if body.lower().startswith("with "):
        return f"with {parts},\n{body[5:]}"
    return f"with {parts}\n{body}"
