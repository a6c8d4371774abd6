"""Headline text, sessions, ingest, merging and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from bellwire import fixtures as fx
from bellwire.functions import replies, text, timez
from bellwire.functions.numbers import integer_id, numeric
from bellwire.operators import dedup, maintenance as mt, scoring as sc, sessions as ss
from bellwire.operators.ledger import lexicon_job
from bellwire.plans.prepare import prepare_headlines
from bellwire.registry.base import NY, entry, plain, r6, sql_r6, sql_text
from bellwire.functions.text import BLANKS, WORD
from bellwire.session import dealt_evenly, materialise, work_path
from bellwire.sources import articles as ar
from bellwire.sources import lexicon as lx


def _at():
    return timez.parse_utc("published_at")


def _news(spark, sf):
    return fx.news(spark, sf)


def _clean(spark, sf):
    # Cleaning whole texts costs far more than moving them once.
    return dealt_evenly(_news(spark, sf)).withColumn("title_clean", text.clean_title("title"))


# -- time ---------------------------------------------------------------------------------------
def standardize_ts(spark, sf):
    return _news(spark, sf).select("id", timez.standardize_text("published_at").alias("published_at"))


def local_time_parts(spark, sf):
    """New York date and clock of every order, spread over all seasons by its order number."""
    at = F.expr("cast(o_orderdate as timestamp_ntz) + make_dt_interval(0, 0, cast(o_orderkey % 1440 as int))")
    return fx.table(spark, sf, "orders").select(
        "o_orderkey",
        timez.local_date(at).cast("string").alias("local_date"),
        timez.local_time(at).alias("local_time"),
        F.date_format(timez.at_local_time(F.to_date(at), *ss.OPEN), "yyyy-MM-dd HH:mm").alias("open_utc"),
    )


def id_coerce(spark, sf):
    """Ids read as text: plain, as a float column would print them, and broken."""
    raw = F.expr("case when n_chars < 200 then concat('n', id) when lang = 'en' then concat(id, '.0') else cast(id as string) end")
    return _news(spark, sf).select("title", integer_id(raw).alias("new_id"), "id").drop("title")


def numeric_coerce(spark, sf):
    raw = F.expr("case when n_chars < 200 then 'n/a' when lang = 'de' then 'NaN' else cast(score as string) end")
    return _news(spark, sf).select("id", numeric(raw).alias("score"))


# -- text ---------------------------------------------------------------------------------------
def clean_titles(spark, sf):
    return _clean(spark, sf).select("id", "title_clean")


def tokenize(spark, sf):
    words = _clean(spark, sf).select("id", F.explode(text.tokens("title_clean")).alias("token"))
    return words.groupBy("id", "token").agg(F.count("*").alias("n"))


def valid_titles(spark, sf):
    return _news(spark, sf).where(text.is_valid_title("title")).select("id", "title")


def pending_rows(spark, sf):
    """Half-cleaned table: only titles still without a cleaned form are pending."""
    half = _clean(spark, sf).withColumn(
        "title_clean", F.expr("case when lang = 'en' then title_clean when lang = 'fr' then '' end")
    )
    return mt.pending(half, "title", "title_clean", blank_is_pending=True).select("id", "lang")


def source_from_domain(spark, sf):
    domain = F.concat(F.initcap("source"), F.lit(".Example.co.uk"))
    return _news(spark, sf).select("id", text.source_from_domain(domain).alias("source"))


def dedup_keep_first(spark, sf):
    return dedup.keep_first(_news(spark, sf), ["title"]).select("id", "title")


# -- sessions -----------------------------------------------------------------------------------
def trading_days_strict(spark, sf):
    return plain(ss.trading_days(fx.days(spark, sf), strict_weekdays=True))


def session_windows(spark, sf):
    return plain(ss.session_windows(fx.days(spark, sf)))


def exclude_market_hours(spark, sf):
    kept = ss.exclude_market_hours(_news(spark, sf), _at(), fx.days(spark, sf))
    return kept.select("id", "published_at")


def market_hours_postcheck(spark, sf):
    days = fx.days(spark, sf)
    large = fx.news_large(spark, sf)
    kept = ss.exclude_market_hours(large, F.col("ts"), days)
    bad = ss.only_market_hours(kept, F.col("ts"), days).select(F.count("*")).scalar()
    return kept.agg(F.count("*").alias("n_kept"), F.first(bad).alias("n_in_session"))


def pre_market_filter(spark, sf):
    return ss.keep_pre_market(fx.news_large(spark, sf), F.col("ts"), fx.days(spark, sf)).select("id", "source")


def pre_market_strict(spark, sf):
    kept = ss.keep_pre_market(_news(spark, sf), _at(), fx.days(spark, sf), strict_weekdays=True)
    return kept.select("id", "published_at")


def session_gap_join(spark, sf):
    return plain(ss.session_gap_join(fx.news_large(spark, sf), F.col("ts"), fx.days(spark, sf)).select("id", "trade_date"))


def join_same_date(spark, sf):
    out = ss.join_same_date(fx.news_large(spark, sf), F.col("ts"), fx.bars(spark, sf).select("trade_date", "open_price", "close_price"))
    return plain(out.select("id", "trade_date", "open_price", "close_price"))


# -- ingest and merge ---------------------------------------------------------------------------
def ingest_articles(spark, sf):
    articles = ar.ingest_articles(fx.article_responses(spark, sf))
    target = _news(spark, sf).where("1 = 0").select("source", "title", "published_at", "url")
    return ar.store_articles(target, articles).select("source", "title", "published_at", "url")


def ingest_status(spark, sf):
    return plain(ar.accepted_status(fx.article_responses(spark, sf)))


def fetch_plan(spark, sf):
    week = F.date_add(F.lit("2024-01-01").cast("date"), (F.floor(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) / 7) * 7).cast("int"))
    rows = fx.news_large(spark, sf).select(
        F.concat("source", F.lit(".com")).alias("domain"), week.cast("timestamp_ntz").alias("slice_start"), "ts"
    )
    totals = rows.groupBy("domain", "slice_start").agg(F.count("*").alias("total"))
    bounds = rows.agg(F.lit("2024-01-01").cast("date").alias("start"), F.date_add(F.max(F.to_date("ts")), 1).alias("end"))
    domains = ["click.com", "error.com", "purchase.com", "signup.com", "view.com", "unused.com"]
    return ar.fetch_plan(ar.fetch_slices(bounds, domains), totals)


def insert_or_ignore(spark, sf):
    news = _news(spark, sf).select("id", "url", "lang")
    return dedup.insert_or_ignore(news.where("lang = 'en'"), news.where("lang <> 'en'"), ["url"], "id").select("id", "url")


def _merge_parts(spark, sf):
    """Target: English headlines with a url. Sources: one table per other language."""
    news = _news(spark, sf).select("id", "title", "published_at", "url", "lang")
    target = news.where("lang = 'en' and url is not null")
    return target, {lang: news.where(F.col("lang") == lang) for lang in ("de", "es", "fr")}


def merge_not_in(spark, sf):
    """Both null rules against a clean target, and the SQL rule against one holding a NULL url."""
    target, sources = _merge_parts(spark, sf)
    with_null = _news(spark, sf).where("lang = 'en'").select("url")
    cases = {
        "safe": dedup.merge_not_in(target, sources["fr"]),
        "sql": dedup.merge_not_in(target, sources["fr"], null_mode="sql"),
        "sql_null_target": dedup.merge_not_in(with_null, sources["fr"], null_mode="sql"),
        "sql_empty_target": dedup.merge_not_in(target.where("1 = 0"), sources["fr"], null_mode="sql"),
    }
    parts = [df.select(F.lit(name).alias("rule"), "id", "url") for name, df in cases.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def merge_sources(spark, sf):
    """The three language tables merged one after the other, numbered after the target's ids."""
    target, sources = _merge_parts(spark, sf)
    tagged = dedup.tag_sources(sources, ["id", "title", "published_at", "url"]).withColumnRenamed("id", "row_no")
    fresh = dedup.merge_sources(target, tagged)
    out = dedup.assign_ids(fresh, target, ["source_rank", "row_no"])
    return out.select("id", "source", "published_at", "url", "row_no")


def prepare(spark, sf):
    out = prepare_headlines(_news(spark, sf).select("id", "source", "title", "published_at", "url"), fx.days(spark, sf))
    return out.select("id", "source", "published_at", "title_clean", "url")


# -- lexicon and scoring ------------------------------------------------------------------------
def lexicon_build(spark, sf):
    return lx.build_lexicon(fx.lexicon_flags(spark, sf))


def lexicon_load(spark, sf):
    built = lx.build_lexicon(fx.lexicon_flags(spark, sf))
    paths = [lx.write_word_list(built, sign, work_path(spark, "words")) for sign in (1, -1)]
    return lx.read_lexicon(spark, *paths)


def lm_sentiment(spark, sf):
    return sc.score_lexicon(_clean(spark, sf), fx.lexicon(spark))


def resume_scoring(spark, sf):
    """A first run over the English headlines commits its chunks; the restart scores only the others."""
    news, words = _clean(spark, sf), fx.lexicon(spark)
    folder = work_path(spark, "lexicon-job")
    done = lexicon_job(news.where("lang = 'en'"), words, folder)
    todo = mt.pending(sc.unscored(news, done).withColumn("lm_sentiment_score", F.lit(None).cast("double")), "title_clean", "lm_sentiment_score")
    return lexicon_job(todo, words, folder).select("id", "run", "lm_sentiment_score")


def score_batches(spark, sf):
    scored = sc.net_sentiment(sc.score_batches(_clean(spark, sf)))
    return scored.select("id", *[r6(c).alias(c) for c in scored.columns if c != "id"])


def net_sentiment(spark, sf):
    """Net score where both sides are set; a headline without one keeps its old final score."""
    base = _news(spark, sf).select(
        "id",
        "score",
        F.expr("if(lang = 'fr', null, (n_chars % 11) / 10d)").alias("finbert_sentiment_pos"),
        F.expr("(n_chars % 7) / 10d").alias("finbert_sentiment_neg"),
        F.col("score").alias("finbert_sentiment_final"),
    )
    return sc.net_sentiment(base).select("id", r6("finbert_sentiment_final").alias("finbert_sentiment_final"))


def class_softmax(spark, sf):
    """Probabilities of one label, picked by name, from three logits per headline."""
    from bellwire.functions.vectors import pick_by_label, softmax

    logits = F.expr("array(id % 7 / 2d, id % 5 / 3d, cast(n_chars % 3 as double))")
    labels = {0: "Neutral", 1: "Positive", 2: "Negative"}
    probs = softmax(logits)
    return _news(spark, sf).select(
        "id", *[r6(pick_by_label(probs, labels, name)).alias(name) for name in ("positive", "neutral", "negative")]
    )


def format_prompt(spark, sf):
    return _clean(spark, sf).select("id", replies.format_prompt("title_clean", "zero_shot").alias("prompt"))


def parse_score_reply(spark, sf):
    """Replies of many shapes, one per headline."""
    reply = F.expr(_REPLY_SPARK)
    return _news(spark, sf).select("id", reply.alias("raw")).select("id", "raw", replies.parse_score("raw").alias("score"))


def score_remote(spark, sf):
    scored = sc.score_remote(_clean(spark, sf), prompt="zero_shot", backoff=0.0)
    return scored.select("id", "raw", r6("score").alias("score"), "error")


def dead_letter(spark, sf):
    news = _clean(spark, sf)
    scored = materialise(sc.score_remote(news, prompt="zero_shot", backoff=0.0), "replies")
    _, dead = sc.split_dead_letters(scored)
    return dead.join(news.select("id", "title_clean"), "id").select("id", F.col("title_clean").alias("headline"), F.col("raw").alias("response"))


def embed_titles(spark, sf):
    vectors = sc.embed_titles(_clean(spark, sf), dim=16)
    return vectors.select("id", F.posexplode("embedding").alias("pos", "value")).withColumn("value", r6("value"))


def column_naming(spark, sf):
    """Column names for every source and model in the data."""
    names = fx.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("source")).distinct()
    return names.select(
        "source",
        F.concat(F.lit("avg_sentiment_lm_"), replies.source_suffix("source")).alias("column"),
        F.lit(replies.score_column("gpt-4.1-mini", "zero_shot")).alias("score_column"),
    )


_REPLY_SPARK = """
  case id % 9 when 0 then cast(cast((id * 7 % 401 - 200) / 100d as decimal(5,2)) as string)
    when 1 then concat('+.', id % 10) when 2 then concat('-', id % 3, '.')
    when 3 then '1e-3' when 4 then concat('0.', id % 10, ' ok')
    when 5 then '' when 6 then concat(' 0.', id % 10, '\\n') when 7 then concat('−0.', id % 10) else concat(id % 5, '.2') end"""
_REPLY_SQL = """
  case id % 9 when 0 then cast(cast((id * 7 % 401 - 200) / 100.0::double as decimal(5,2)) as varchar)
    when 1 then '+.' || (id % 10) when 2 then '-' || (id % 3) || '.'
    when 3 then '1e-3' when 4 then '0.' || (id % 10) || ' ok'
    when 5 then '' when 6 then ' 0.' || (id % 10) || chr(10) when 7 then '−0.' || (id % 10) else (id % 5) || '.2' end"""

_CLEAN_LEN = "length(replace({p}, '{{headline}}', title_clean))".format(p=sql_text(replies.PROMPTS["zero_shot"]))
_REMOTE = f"""
  select id, title_clean, case when n % 10 = 0 then 'not sure'
      when n % 10 = 1 then (n * 13 % 301 - 150) || 'e-2'
      else cast(cast((n * 13 % 301 - 150) / 100.0::double as decimal(5, 2)) as varchar) end as raw,
    case when n % 10 > 1 then greatest(-1.0::double, least(1.0::double, (n * 13 % 301 - 150) / 100.0::double)) end as score
  from (select id, title_clean, {_CLEAN_LEN} as n from fx_clean)"""

_PROBS = """
  select id, a / (a + b + c) as finbert_sentiment_pos, b / (a + b + c) as finbert_sentiment_neutral, c / (a + b + c) as finbert_sentiment_neg
  from (select id, exp(n_a * 8.0 / n) as a, exp(n_s * 8.0 / n) as b, exp(n_e * 8.0 / n) as c from (
    select id, greatest(length(title_clean), 1)::double as n,
      length(title_clean) - length(replace(title_clean, 'a', '')) as n_a,
      length(title_clean) - length(replace(title_clean, ' ', '')) as n_s,
      length(title_clean) - length(replace(title_clean, 'e', '')) as n_e from fx_clean))"""

LM_SQL = """
  select n.id, coalesce(p, 0) as n_pos, coalesce(q, 0) as n_neg,
    case when n.title_clean <> '' then
      cast(coalesce(round_even((p - q) / nullif(p + q, 0)::double, 4), 0) as double) end as lm_sentiment_score
  from fx_clean n left join (
    select id, count(*) filter (where polarity > 0) as p, count(*) filter (where polarity < 0) as q
    from fx_tokens join fx_lexicon on word = token group by id) h on h.id = n.id"""

_FRESH = "not exists (select 1 from fx_news t where t.lang = 'en' and t.url = f.url)"
_SESSION = f"""
  cast({{at}} at time zone 'UTC' at time zone {NY} as date) in (select trade_date from fx_days)
  and cast({{at}} at time zone 'UTC' at time zone {NY} as time) >= time '09:30:00'
  and cast({{at}} at time zone 'UTC' at time zone {NY} as time) < time '16:00:00'"""
_ASCII = r"[\x20-\x7E\t\n\x0B\f\r]*"

ENTRIES = {
    "standardize_ts": entry(standardize_ts, "select id, standard_at as published_at from fx_news"),
    "local_time_parts": entry(
        local_time_parts,
        f"""with t as (select o_orderkey, o_orderdate + to_minutes(o_orderkey % 1440) as utc from orders),
            l as (select *, utc at time zone 'UTC' at time zone {NY} as loc from t)
            select o_orderkey, cast(cast(loc as date) as varchar) as local_date, strftime(loc, '%H:%M:%S') as local_time,
              strftime((cast(utc as date) + interval 9 hour + interval 30 minute) at time zone {NY} at time zone 'UTC',
                       '%Y-%m-%d %H:%M') as open_utc from l""",
    ),
    "id_coerce": entry(id_coerce, "select id, case when n_chars >= 200 then id end as new_id from fx_news"),
    "numeric_coerce": entry(
        numeric_coerce, "select id, case when n_chars >= 200 and lang <> 'de' then score end as score from fx_news"
    ),
    "clean_titles": entry(clean_titles, "select id, title_clean from fx_clean"),
    "tokenize": entry(tokenize, "select id, token, count(*) as n from fx_tokens group by all"),
    "valid_titles": entry(
        valid_titles,
        f"select id, title from fx_news where regexp_full_match(title, '{_ASCII}') and regexp_matches(title, '[A-Za-z0-9]')",
    ),
    "pending_rows": entry(pending_rows, "select id, lang from fx_clean where lang <> 'en' or title_clean = ''"),
    "source_from_domain": entry(source_from_domain, "select id, source from fx_news"),
    "dedup_keep_first": entry(dedup_keep_first, "select min(id) as id, title from fx_news group by title"),
    "trading_days_strict": entry(
        trading_days_strict,
        """select distinct cast(d as varchar) as trade_date from (
             select trade_date as d from fx_days union
             select cast(unnest(range(lo, hi + interval 1 day, interval 1 day)) as date) from (
               select min(trade_date) as lo, max(trade_date) as hi from fx_days))
           where isodow(d) < 6""",
    ),
    "session_windows": entry(
        session_windows,
        """select cast(trade_date as varchar) as trade_date, cast(prev_date as varchar) as prev_date,
             cast(window_start as varchar) as window_start, cast(window_end as varchar) as window_end from fx_gaps""",
    ),
    "exclude_market_hours": entry(
        exclude_market_hours,
        f"select id, published_at from fx_news where pub_ts is null or not ({_SESSION.format(at='pub_ts')})",
    ),
    "market_hours_postcheck": entry(
        market_hours_postcheck,
        f"""select count(*) as n_kept, cast(0 as bigint) as n_in_session from fx_news_large
            where not ({_SESSION.format(at='ts')})""",
    ),
    "pre_market_filter": entry(
        pre_market_filter,
        """select id, source from fx_news_large n where exists (
             select 1 from fx_pre_market w where n.ts >= w.window_start and n.ts < w.window_end)""",
    ),
    "pre_market_strict": entry(
        pre_market_strict,
        f"""with b as (select min(trade_date) as lo, max(trade_date) as hi from fx_days),
            l as (select *, pub_ts at time zone 'UTC' at time zone {NY} + interval 150 minute as s from fx_news)
            select id, published_at from l, b where hour(s) < 12 and isodow(s) < 6 and cast(s as date) between lo and hi""",
    ),
    "session_gap_join": entry(session_gap_join, "select id, cast(trade_date as varchar) as trade_date from fx_matched"),
    "join_same_date": entry(
        join_same_date,
        """select id, cast(trade_date as varchar) as trade_date, open_price, close_price
           from fx_news_large join fx_bars on trade_date = cast(ts as date)""",
    ),
    "ingest_articles": entry(
        ingest_articles,
        """select source, title, published_at, url from (
             select *, row_number() over (partition by source, url order by slice_start, page, id) as rn from fx_articles)
           where rn = 1""",
    ),
    "ingest_status": entry(
        ingest_status,
        """select domain, cast(slice_start as varchar) as slice_start, page, cast(500 as bigint) as total_results
           from fx_page_status where not failed and not broken""",
    ),
    "fetch_plan": entry(
        fetch_plan,
        """with t as (select source || '.com' as domain, date '2024-01-01' + cast(7 * (date_diff('day', date '2024-01-01', cast(ts as date)) // 7) as integer) as d,
               count(*) as n from fx_news_large group by all),
             e as (select max(cast(ts as date)) + 1 as hi from fx_news_large)
           select domain, strftime(d, '%Y-%m-%dT%H:%M:%SZ') as from_iso, strftime(least(d + 7, hi), '%Y-%m-%dT%H:%M:%SZ') as to_iso,
             cast(unnest(range(1, (n + 99) // 100 + 1)) as integer) as page from t, e""",
    ),
    "insert_or_ignore": entry(
        insert_or_ignore,
        f"""with f as (select *, row_number() over (partition by url order by id) as rn from fx_news where lang <> 'en')
            select id, url from f where url is null or (rn = 1 and {_FRESH})""",
    ),
    "merge_not_in": entry(
        merge_not_in,
        f"""with f as (select id, url from fx_news where lang = 'fr'),
            t as (select url from fx_news where lang = 'en' and url is not null),
            tn as (select url from fx_news where lang = 'en'), te as (select url from t where 1 = 0)
            select 'safe' as rule, id, url from f where not exists (select 1 from t where t.url = f.url)
            union all select 'sql', id, url from f where url not in (select url from t)
            union all select 'sql_null_target', id, url from f where url not in (select url from tn)
            union all select 'sql_empty_target', id, url from f where url not in (select url from te)""",
    ),
    "merge_sources": entry(
        merge_sources,
        f"""with f as (select *, case lang when 'de' then 1 when 'es' then 2 else 3 end as rank from fx_news where lang <> 'en'),
            g as (select *, min(rank) over (partition by url) as first_rank from f),
            k as (select * from g f where url is null or (rank = first_rank and {_FRESH}))
            select (select max(id) from fx_news where lang = 'en' and url is not null) + row_number() over (order by rank, id) as id,
              lang as source, published_at, url, id as row_no from k""",
    ),
    "prepare_headlines": entry(
        prepare,
        f"""with p as (select * from fx_clean n where exists (select 1 from fx_pre_market w
                 where n.pub_ts >= w.window_start and n.pub_ts < w.window_end)),
            d as (select *, row_number() over (partition by title order by id) as rn from p)
            select row_number() over (order by standard_at, id) as id, source, standard_at as published_at, title_clean, url
            from d where rn = 1 and (title = '' or (regexp_full_match(title, '{_ASCII}') and regexp_matches(title, '[A-Za-z0-9]')))""",
    ),
    "lexicon_build": entry(
        lexicon_build,
        """select w as word, 1 as polarity from fx_vocabulary where w like '%e'
           union all select w, -1 from fx_vocabulary where w like 'a%'""",
    ),
    "lexicon_load": entry(
        lexicon_load,
        """select w as word, case when w like '%e' then 1 else -1 end as polarity from fx_vocabulary
           where w like '%e' or w like 'a%'""",
    ),
    "lm_sentiment": entry(lm_sentiment, LM_SQL),
    "resume_scoring": entry(
        resume_scoring,
        f"""select s.id, case when c.lang = 'en' then 1 else 2 end as run, lm_sentiment_score
            from ({LM_SQL}) s join fx_clean c on c.id = s.id where c.lang = 'en' or c.title_clean <> ''""",
    ),
    "score_batches": entry(
        score_batches,
        f"""select id, {sql_r6('finbert_sentiment_pos')} as finbert_sentiment_pos,
              {sql_r6('finbert_sentiment_neutral')} as finbert_sentiment_neutral,
              {sql_r6('finbert_sentiment_neg')} as finbert_sentiment_neg,
              {sql_r6('finbert_sentiment_pos - finbert_sentiment_neg')} as finbert_sentiment_final from ({_PROBS})""",
    ),
    "net_sentiment": entry(
        net_sentiment,
        f"""select id, {sql_r6("case when lang <> 'fr' then (n_chars % 11) / 10.0::double - (n_chars % 7) / 10.0::double else score end")}
              as finbert_sentiment_final from fx_news""",
    ),
    "class_softmax": entry(
        class_softmax,
        f"""with e as (select id, exp(id % 7 / 2.0::double) as a, exp(id % 5 / 3.0::double) as b, exp(n_chars % 3) as c from fx_news)
            select id, {sql_r6('b / (a + b + c)')} as positive, {sql_r6('a / (a + b + c)')} as neutral,
              {sql_r6('c / (a + b + c)')} as negative from e""",
    ),
    "format_prompt": entry(
        format_prompt,
        f"select id, replace({sql_text(replies.PROMPTS['zero_shot'])}, '{{headline}}', title_clean) as prompt from fx_clean",
    ),
    "parse_score_reply": entry(
        parse_score_reply,
        f"""with r as (select id, {_REPLY_SQL} as raw from fx_news)
            select id, raw, case when regexp_full_match(trim(raw, ' ' || chr(10)), '[-+]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)')
              then greatest(-1.0::double, least(1.0::double, cast(trim(raw, ' ' || chr(10)) as double))) end as score from r""",
    ),
    "score_remote": entry(
        score_remote, f"select id, raw, {sql_r6('score')} as score, cast(null as varchar) as error from ({_REMOTE})"
    ),
    "dead_letter": entry(
        dead_letter, f"select id, title_clean as headline, raw as response from ({_REMOTE}) where score is null"
    ),
    "embed_titles": entry(
        embed_titles,
        f"""with b as (select id, cast(('0x' || substr(md5(token), 1, 4)) as bigint) % 16 as pos, count(*)::double as c from fx_tokens group by all),
            s as (select id, sqrt(sum(c * c)) as norm from b group by id)
            select n.id, cast(p.pos as integer) as pos, {sql_r6('coalesce(b.c / s.norm, 0.0)')} as value
            from fx_news n cross join (select unnest(range(16)) as pos) p
            left join b on b.id = n.id and b.pos = p.pos left join s on s.id = n.id""",
    ),
    "column_naming": entry(
        column_naming,
        """select distinct o_orderpriority as source,
             'avg_sentiment_lm_' || replace(replace(replace(o_orderpriority, '-', '_'), '.', '_'), ' ', '_') as column,
             'llm_sentiment_score_gpt41mini_zero_shot' as score_column from orders""",
    ),
}
