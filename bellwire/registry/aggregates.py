"""Day aggregation, vectors, windows, statistics and feature engineering."""

from __future__ import annotations

from pyspark.sql import functions as F

from bellwire import fixtures as fx
from bellwire.functions.numbers import relu, sigmoid
from bellwire.functions.replies import source_column
from bellwire.functions.vectors import append_scalars, l2_norm, linear, relu_all, split_vector
from bellwire.operators import aggregates as ag
from bellwire.operators import features as ft
from bellwire.operators import maintenance as mt
from bellwire.operators import sequence as sq
from bellwire.operators import sessions as ss
from bellwire.operators import stats as st
from bellwire.registry.base import entry, plain, r6, rounded, sql_r6
from bellwire.sources import prices as px

#: Score columns aggregated together, as SQL over the scored headlines.
SCORES = {
    "lm": "score",
    "finbert": "score * 0.5 - 3",
    "gpt4o": "case when score > 20 then score end",
    "gpt41mini": "case when id % 3 = 0 then score end",
    "gpt41mini_market": "score * score",
}
SOURCES = ("click", "error", "purchase", "signup", "view")


def _matched(spark, sf):
    return ss.session_gap_join(fx.news_large(spark, sf), F.col("ts"), fx.days(spark, sf))


# -- day sentiment ------------------------------------------------------------------------------
def daily_sentiment(spark, sf):
    out = ag.aggregate_daily(
        fx.bars(spark, sf), fx.news_large(spark, sf), F.col("ts"), {"score": "avg_sentiment_lm"}, by_source=False
    )
    return plain(rounded(out.select("trade_date", "avg_sentiment_lm"), "avg_sentiment_lm"))


def _null_source(news):
    """Some headlines have no source: they count in the day mean only."""
    return news.withColumn("source", F.expr("case when score < 90 then source end"))


def daily_sentiment_by_source(spark, sf):
    out = ag.aggregate_daily(
        fx.bars(spark, sf), _null_source(fx.news_large(spark, sf)), F.col("ts"), {"score": "avg_sentiment_lm"}
    )
    return plain(rounded(out, *[c for c in out.columns if c.startswith("avg_")]))


def aggregate_daily(spark, sf):
    """All five score columns, overall and per source, from one join and one pass."""
    news = fx.news_large(spark, sf)
    news = news.select("id", "source", "ts", *[F.expr(e).alias(f"{n}_score") for n, e in SCORES.items()])
    labels = {f"{n}_score": f"avg_sentiment_{n}" for n in SCORES}
    out = ag.aggregate_daily(fx.bars(spark, sf), news, F.col("ts"), labels, SOURCES)
    return plain(rounded(out, *[c for c in out.columns if c.startswith("avg_")]))


def distinct_sources(spark, sf):
    return ag.distinct_sources(fx.news_large(spark, sf))


def select_source_columns(spark, sf):
    """The per-source columns that exist for the wanted sources; an unknown source is skipped."""
    market = fx.market(spark, sf)
    names = ft.select_source_columns(market.columns, "avg_sentiment", ["1-URGENT", "no-such", "5-LOW"])
    return plain(rounded(market.select("trade_date", *names), *names))


def group_mean_multi(spark, sf):
    days = fx.table(spark, sf, "lineitem").withColumn("trade_date", F.to_date("l_shipdate"))
    cols = ["l_quantity", "l_extendedprice", "l_discount"]
    return plain(rounded(ag.group_means(days, "trade_date", cols), *cols))


def collect_by_day(spark, sf):
    """Scores per day in id order, in chunks of 100."""
    rows = fx.news_large(spark, sf).withColumn("trade_date", F.to_date("ts"))
    bags = ag.bag_by_group(rows, "trade_date", "id", "score", max_items=100)
    ids = F.array_join(F.transform("items.id", lambda x: x.cast("string")), ",")
    return plain(bags.select("trade_date", "chunk", "n_items", ids.alias("ids"), r6(F.aggregate("items.value", F.lit(0.0), lambda a, x: a + x)).alias("total")))


def daily_rejoin(spark, sf):
    """Day bags of same-date headlines joined back onto the prices."""
    bars = fx.bars(spark, sf).select("trade_date", "open_price", "close_price")
    rows = ss.join_same_date(fx.news_large(spark, sf), F.col("ts"), bars.select("trade_date"))
    bags = ag.bag_by_group(rows, "trade_date", "id", "score", max_items=200)
    out = bags.join(bars, "trade_date")
    return plain(out.select("trade_date", "chunk", "n_items", "open_price", "close_price"))


def left_join_features(spark, sf):
    """Day means onto all prices, incomplete days dropped."""
    means = ag.group_means(_matched(spark, sf), "trade_date", ["score"])
    joined = fx.bars(spark, sf).select("trade_date", "open_price").join(means, "trade_date", "left")
    return plain(rounded(mt.drop_incomplete(joined, ["score"]), "score"))


def score_summary(spark, sf):
    return rounded(st.score_summary(fx.news(spark, sf), ["score", "n_chars"]), "avg_score", "avg_n_chars")


# -- vectors ------------------------------------------------------------------------------------
def vector_pool(spark, sf):
    pooled = ag.pool_vectors(fx.vectors(spark, sf), "trade_date", "embedding")
    zipped = F.arrays_zip("vec_mean", "vec_max", "vec_min")
    rows = pooled.select("trade_date", F.posexplode(zipped).alias("pos", "v")).select("trade_date", "pos", "v.*")
    return plain(rounded(rows, "vec_mean", "vec_max", "vec_min"))


def topn_norms(spark, sf):
    """Three largest norms per day; days of a class with fewer vectors are padded."""
    rows = fx.vectors(spark, sf).withColumn("trade_date", F.expr("date_add(trade_date, label * 40 + cast(id % 400 as int))"))
    top = ag.top_norms(rows, "trade_date", "id", "embedding")
    return plain(top.select("trade_date", F.posexplode("top_norms").alias("pos", "norm")).withColumn("norm", r6("norm")))


def vector_ops(spark, sf):
    vec = F.col("embedding")
    extended = append_scalars(vec, [F.col("label"), F.col("id") / 1000])
    head, tail = split_vector(extended, 2)
    return fx.vectors(spark, sf).select(
        "id",
        r6(l2_norm(vec)).alias("norm"),
        F.size(head).alias("head_size"),
        r6(tail[0]).alias("label"),
        r6(tail[1]).alias("scaled_id"),
        r6(l2_norm(head)).alias("head_norm"),
    )


_WEIGHTS = [[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(64)] for i in range(3)]
_BIAS = [0.1, -0.2, 0.0]


def project_activate(spark, sf):
    """64 -> 3 dense layer with ReLU, then a sigmoid over the sum."""
    hidden = relu_all(linear(F.col("embedding"), _WEIGHTS, _BIAS))
    total = F.aggregate("h", F.lit(0.0), lambda a, x: a + x)
    out = fx.vectors(spark, sf).select("id", hidden.alias("h"))
    return out.select("id", *[r6(F.col("h")[i]).alias(f"h{i}") for i in range(3)], r6(sigmoid(total - relu(F.lit(-1.0)))).alias("p"))


def _scored_vectors(spark, sf):
    return fx.vectors(spark, sf).withColumn("att", F.col("embedding")[0].cast("double") * 4)


def softmax_weights(spark, sf):
    out = ag.softmax_weights(_scored_vectors(spark, sf), "trade_date", "att")
    return plain(out.select("id", "trade_date", r6("weight").alias("weight")))


def attention_pool(spark, sf):
    pooled = ag.attention_pool(_scored_vectors(spark, sf), "trade_date", "att", "embedding")
    rows = pooled.select("trade_date", F.posexplode("pooled").alias("pos", "value"))
    return plain(rounded(rows, "value"))


# -- daily series -------------------------------------------------------------------------------
def _series(spark, sf):
    return px.add_returns(fx.bars_long(spark, sf, by_symbol=True))


def daily_returns(spark, sf):
    out = _series(spark, sf).select("symbol", "trade_date", "increase", "daily_return")
    return plain(rounded(out, "daily_return"))


def _lags(df):
    names = ft.lag_names(3)
    return plain(df.select("symbol", "trade_date", *[r6(F.col(f"`{n}`")).alias(f"lag_{k}") for k, n in enumerate(names, 1)]))


def lag_returns(spark, sf):
    return _lags(ft.lag_returns(_series(spark, sf), 3, "symbol"))


def lag_returns_prices(spark, sf):
    return _lags(ft.lag_returns_from_prices(fx.bars_long(spark, sf, by_symbol=True), 3, "symbol"))


def pct_change_close(spark, sf):
    out = px.pct_change_close(fx.bars_long(spark, sf, by_symbol=True), "symbol")
    return plain(rounded(out.select("symbol", "trade_date", "percent_change_close"), "percent_change_close"))


def expanding_stats(spark, sf):
    out = ag.expanding_stats(_series(spark, sf), "daily_return", symbol="symbol")
    keep = out.select("symbol", "trade_date", "n_before", "mean_before", "std_before")
    return plain(rounded(keep, "mean_before", "std_before"))


def interactions(spark, sf):
    df = ft.lag_returns(_series(spark, sf), 2, "symbol").withColumn("sent", F.col("volume") / 7)
    out, names = ft.interactions(df, ["sent"], ft.lag_names(2))
    return plain(out.select("symbol", "trade_date", *[r6(F.col(f"`{n}`")).alias(f"x{i}") for i, n in enumerate(names)]))


def train_test_split_dates(spark, sf):
    out = ft.split_by_dates(fx.bars_long(spark, sf), ("1996-01-01", "1998-12-31"), ("1999-01-01", "1999-12-31"))
    return plain(out.select("trade_date", "split"))


def ts_folds(spark, sf):
    return plain(sq.time_series_folds(fx.bars_long(spark, sf).select("trade_date"), "trade_date", 5))


_TRAIN, _TEST = ("1995-01-01", "1999-12-31"), ("2000-01-01", "2001-12-31")
_SENT = source_column("avg_sentiment", "3-MEDIUM")


def impute_mean(spark, sf):
    df = ft.split_by_dates(fx.market(spark, sf), _TRAIN, _TEST)
    train = ft.fit_imputation(df, [_SENT], F.col("split") == "train").transform(df)
    both = ft.fit_imputation(df, [_SENT]).transform(df)
    a = train.select(F.lit("train").alias("scope"), "trade_date", r6(_SENT).alias("sentiment"))
    b = both.select(F.lit("all").alias("scope"), "trade_date", r6(_SENT).alias("sentiment"))
    return plain(a.unionByName(b))


def standardize(spark, sf):
    df = ft.split_by_dates(fx.market(spark, sf), _TRAIN, _TEST).withColumn("flat", F.lit(3.0))
    cols = ["avg_sentiment", "volume", "flat"]
    out = ft.fit_scaling(df, cols, F.col("split") == "train").transform(df)
    return plain(rounded(out.select("trade_date", *cols), *cols))


def feature_frame(spark, sf):
    spec = ft.FeatureSpec(sentiment=(_SENT,), n_lags=2, train=_TRAIN, test=_TEST)
    out, names = ft.feature_frame(fx.market(spark, sf), spec)
    return plain(
        out.select("trade_date", "increase", "split", *[r6(F.col(f"`{n}`")).alias(f"f{i}") for i, n in enumerate(names)])
    )


# -- statistics ---------------------------------------------------------------------------------
_CORR = ["l_quantity", "l_extendedprice", "l_discount", "taxed", "late", "flat"]


def corr_matrix(spark, sf):
    lines = fx.table(spark, sf, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        F.expr("nullif(l_tax, 0d)").alias("taxed"),
        F.expr("case when l_returnflag <> 'R' then l_quantity * l_discount end").alias("late"),
        F.lit(1.0).alias("flat"),
    )
    return rounded(st.corr_matrix(lines, _CORR), "corr")


def linregress(spark, sf):
    out = st.linregress(fx.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return rounded(out, *[c for c in out.columns if c != "n"])


def linregress_points(spark, sf):
    days = px.pct_change_close(fx.market(spark, sf))
    out = st.regression_points(days, "avg_sentiment", "percent_change_close", ["trade_date"])
    return plain(rounded(out, "x", "y", "fitted"))


def linregress_p_value(spark, sf):
    """Slope test of sentiment against price change."""
    days = px.pct_change_close(fx.market(spark, sf))
    out = st.linregress_test(days, "avg_sentiment", "percent_change_close")
    return rounded(out, *[c for c in out.columns if c != "n"])


def class_weights(spark, sf):
    weighted = st.with_class_weights(fx.scored(spark, sf), "label")
    return weighted.groupBy("label").agg(F.count("*").alias("n"), r6(F.max("class_weight")).alias("weight"))


def class_ratio(spark, sf):
    return rounded(st.class_ratio(fx.scored(spark, sf), "label"), "ratio")


def metrics_binary(spark, sf):
    a = st.metrics_binary(fx.scored(spark, sf), "label", "proba").withColumn("rule", F.lit("threshold"))
    b = st.metrics_binary(fx.scored(spark, sf), "label", "proba", "round").withColumn("rule", F.lit("round"))
    return rounded(a.unionByName(b), "accuracy", "log_loss")


def auc_rank(spark, sf):
    return rounded(st.auc_by_rank(fx.scored(spark, sf), "label", "proba"), "auc")


def classification_report(spark, sf):
    rows = fx.scored(spark, sf).withColumn("predicted", st.predicted_label(F.col("proba")))
    return rounded(st.classification_report(rows, "label", "predicted"), "precision", "recall", "f1")


# -- SQL twins ----------------------------------------------------------------------------------
def _avg_cols(name: str, expr: str, src: str = "source") -> list[str]:
    base = f"avg_sentiment_{name}"
    cols = [f"{sql_r6(f'avg({expr})')} as {base}"]
    for s in SOURCES:
        cols.append(f"{sql_r6(f'''avg(case when {src} = '{s}' then {expr} end)''')} as {base}_{s}")
    return cols


def _daily_sql(cols: list[str]) -> str:
    return f"""select cast(b.trade_date as varchar) as trade_date, b.* exclude (trade_date), m.* exclude (trade_date)
      from fx_bars b left join (select trade_date, {', '.join(cols)} from fx_matched group by trade_date) m
      on m.trade_date = b.trade_date"""


def _dot(i: int) -> str:
    terms = ", ".join(f"{w}::double" for w in _WEIGHTS[i])
    return f"greatest(0.0, list_sum([embedding[j]::double * ([{terms}])[j] for j in range(1, 65)]) + {_BIAS[i]})"


_LAG = "lag({c}, {k}) over (partition by symbol order by trade_date)"
_LAG_SQL = ", ".join(f"{sql_r6(_LAG.format(c='daily_return', k=k))} as lag_{k}" for k in (1, 2, 3))
_CORR_VIEW = """select l_quantity, l_extendedprice, l_discount, nullif(l_tax, 0) as taxed,
  case when l_returnflag <> 'R' then l_quantity * l_discount end as late, 1.0::double as flat from lineitem"""


def _corr_cell(a: str, b: str) -> str:
    both = f"filter (where {a} is not null and {b} is not null)"
    den = f"nullif(stddev_pop({a}) {both} * stddev_pop({b}) {both}, 0)"
    return f"select '{a}' as col_a, '{b}' as col_b, {sql_r6(f'covar_pop({a}, {b}) {both} / {den}')} as corr from ({_CORR_VIEW})"


_SPLIT = f"""case when trade_date between date '{_TRAIN[0]}' and date '{_TRAIN[1]}' then 'train'
  when trade_date between date '{_TEST[0]}' and date '{_TEST[1]}' then 'test' end"""
_REPORT = """
  with c as (select count(*) filter (where label = 0 and proba < 0.5)::double as c00, count(*) filter (where label = 0 and proba >= 0.5)::double as c01,
      count(*) filter (where label = 1 and proba < 0.5)::double as c10, count(*) filter (where label = 1 and proba >= 0.5)::double as c11 from fx_scored),
  k as (select '0' as class, c00 / (c00 + c10) as p, c00 / (c00 + c01) as r, c00 + c01 as s from c
        union all select '1', c11 / (c11 + c01), c11 / (c11 + c10), c11 + c10 from c),
  l as (select class, p as precision, r as recall, 2 * p * r / (p + r) as f1, s from k),
  t as (select * from l union all select 'accuracy', a, a, a, n from (select (c00 + c11) / (c00 + c01 + c10 + c11) as a, c00 + c01 + c10 + c11 as n from c)
        union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(s) from l
        union all select 'weighted avg', sum(precision * s) / sum(s), sum(recall * s) / sum(s), sum(f1 * s) / sum(s), sum(s) from l)
"""

ENTRIES = {
    "daily_sentiment": entry(
        daily_sentiment,
        f"""select cast(b.trade_date as varchar) as trade_date, {sql_r6('avg(score)')} as avg_sentiment_lm
            from fx_bars b left join fx_matched m on m.trade_date = b.trade_date group by 1""",
    ),
    "daily_sentiment_by_source": entry(
        daily_sentiment_by_source, _daily_sql(_avg_cols("lm", "score", "(case when score < 90 then source end)"))
    ),
    "aggregate_daily": entry(aggregate_daily, _daily_sql([c for n, e in SCORES.items() for c in _avg_cols(n, f"({e})")])),
    "distinct_sources": entry(distinct_sources, "select distinct source from fx_news_large"),
    "select_source_columns": entry(
        select_source_columns,
        f"""select cast(trade_date as varchar) as trade_date, {sql_r6('avg_sentiment_1_URGENT')} as avg_sentiment_1_URGENT,
              {sql_r6('avg_sentiment_5_LOW')} as avg_sentiment_5_LOW from fx_market""",
    ),
    "group_mean_multi": entry(
        group_mean_multi,
        f"""select cast(cast(l_shipdate as date) as varchar) as trade_date, {sql_r6('avg(l_quantity)')} as l_quantity,
              {sql_r6('avg(l_extendedprice)')} as l_extendedprice, {sql_r6('avg(l_discount)')} as l_discount from lineitem group by 1""",
    ),
    "collect_by_day": entry(
        collect_by_day,
        f"""with p as (select *, cast(ts as date) as d, (row_number() over (partition by cast(ts as date) order by id) - 1) // 100 as chunk from fx_news_large)
            select cast(d as varchar) as trade_date, chunk, count(*) as n_items, string_agg(cast(id as varchar), ',' order by id) as ids,
              {sql_r6('sum(score)')} as total from p group by d, chunk""",
    ),
    "daily_rejoin": entry(
        daily_rejoin,
        """with p as (select n.id, b.*, (row_number() over (partition by b.trade_date order by id) - 1) // 200 as chunk
             from fx_news_large n join fx_bars b on b.trade_date = cast(n.ts as date))
           select cast(trade_date as varchar) as trade_date, chunk, count(*) as n_items, any_value(open_price) as open_price,
             any_value(close_price) as close_price from p group by trade_date, chunk""",
    ),
    "left_join_features": entry(
        left_join_features,
        f"""select cast(b.trade_date as varchar) as trade_date, open_price, {sql_r6('score')} as score from fx_bars b
            join (select trade_date, avg(score) as score from fx_matched group by 1) m on m.trade_date = b.trade_date""",
    ),
    "score_summary": entry(
        score_summary,
        f"""select {sql_r6('avg(score)')} as avg_score, count(score) as n_score, {sql_r6('avg(n_chars)')} as avg_n_chars,
              count(n_chars) as n_n_chars from fx_news""",
    ),
    "vector_pool": entry(
        vector_pool,
        f"""select cast(trade_date as varchar) as trade_date, cast(pos as integer) as pos, {sql_r6('avg(x)')} as vec_mean,
              {sql_r6('max(x)')} as vec_max, {sql_r6('min(x)')} as vec_min
            from (select trade_date, unnest(range(64)) as pos, unnest(embedding)::double as x from fx_vectors) group by all""",
    ),
    "topn_norms": entry(
        topn_norms,
        f"""with n as (select id, trade_date + cast(label * 40 + id % 400 as integer) as d,
               sqrt(list_sum([x::double * x::double for x in embedding])) as norm from fx_vectors),
            r as (select *, row_number() over (partition by d order by norm desc, id) as rn from n),
            s as (select d, rn, norm from r where rn <= 3),
            f as (select distinct d from r), a as (select f.d, g.rn from f, (select unnest(range(1, 4)) as rn) g)
            select cast(a.d as varchar) as trade_date, cast(3 - a.rn as integer) as pos, {sql_r6('coalesce(s.norm, 0.0)')} as norm
            from a left join s on s.d = a.d and s.rn = a.rn""",
    ),
    "vector_ops": entry(
        vector_ops,
        f"""with n as (select *, sqrt(list_sum([x::double * x::double for x in embedding])) as norm from fx_vectors)
            select id, {sql_r6('norm')} as norm, 64::integer as head_size, {sql_r6('label::double')} as label,
              {sql_r6('id / 1000.0::double')} as scaled_id, {sql_r6('norm')} as head_norm from n""",
    ),
    "project_activate": entry(
        project_activate,
        f"""with h as (select id, {_dot(0)} as h0, {_dot(1)} as h1, {_dot(2)} as h2 from fx_vectors)
            select id, {sql_r6('h0')} as h0, {sql_r6('h1')} as h1, {sql_r6('h2')} as h2,
              {sql_r6('1 / (1 + exp(-(h0 + h1 + h2)))')} as p from h""",
    ),
    "softmax_weights": entry(
        softmax_weights,
        f"""with v as (select *, exp(embedding[1]::double * 4) as e from fx_vectors)
            select id, cast(trade_date as varchar) as trade_date, {sql_r6('e / sum(e) over (partition by trade_date)')} as weight from v""",
    ),
    "attention_pool": entry(
        attention_pool,
        f"""with v as (select trade_date, exp(embedding[1]::double * 4) as e, unnest(range(64)) as pos, unnest(embedding)::double as x from fx_vectors)
            select cast(trade_date as varchar) as trade_date, cast(pos as integer) as pos, {sql_r6('sum(e * x) / sum(e)')} as value from v group by all""",
    ),
    "daily_returns": entry(
        daily_returns,
        f"""select symbol, cast(trade_date as varchar) as trade_date, increase, {sql_r6('daily_return')} as daily_return
            from fx_returns_symbol""",
    ),
    "lag_returns": entry(
        lag_returns, f"select symbol, cast(trade_date as varchar) as trade_date, {_LAG_SQL} from fx_returns_symbol"
    ),
    "lag_returns_prices": entry(
        lag_returns_prices, f"select symbol, cast(trade_date as varchar) as trade_date, {_LAG_SQL} from fx_returns_symbol"
    ),
    "pct_change_close": entry(
        pct_change_close,
        f"""with p as (select *, {_LAG.format(c='close_price', k=1)} as prev from fx_bars_symbol)
            select symbol, cast(trade_date as varchar) as trade_date, {sql_r6('(close_price - prev) / prev * 100')} as percent_change_close from p""",
    ),
    "expanding_stats": entry(
        expanding_stats,
        f"""select symbol, cast(trade_date as varchar) as trade_date, count(daily_return) over w as n_before,
              {sql_r6('avg(daily_return) over w')} as mean_before, {sql_r6('stddev_pop(daily_return) over w')} as std_before
            from fx_returns_symbol window w as (partition by symbol order by trade_date rows between unbounded preceding and 1 preceding)""",
    ),
    "interactions": entry(
        interactions,
        f"""with l as (select *, volume / 7.0::double as sent, {_LAG.format(c='daily_return', k=1)} as a,
              {_LAG.format(c='daily_return', k=2)} as b from fx_returns_symbol)
            select symbol, cast(trade_date as varchar) as trade_date, {sql_r6('sent * a')} as x0, {sql_r6('sent * b')} as x1,
              {sql_r6('a * b')} as x2 from l""",
    ),
    "train_test_split_dates": entry(
        train_test_split_dates,
        """select cast(trade_date as varchar) as trade_date, case when year(trade_date) between 1996 and 1998 then 'train'
             when year(trade_date) = 1999 then 'test' end as split from fx_bars_long""",
    ),
    "ts_folds": entry(
        ts_folds,
        """with s as (select trade_date, row_number() over (order by trade_date) as row_no, count(*) over () as n from fx_bars_long),
             f as (select *, unnest([1, 2, 3, 4, 5]) as fold from s),
             g as (select *, n // 6 as t, n - (6 - fold) * (n // 6) as start from f)
           select row_no, cast(trade_date as varchar) as trade_date, fold, case when row_no <= start then 'train' else 'test' end as role
           from g where row_no <= start + t""",
    ),
    "impute_mean": entry(
        impute_mean,
        f"""with m as (select *, {_SPLIT} as split from fx_market)
            select 'train' as scope, cast(trade_date as varchar) as trade_date,
              {sql_r6(f"coalesce({_SENT}, (select avg({_SENT}) from m where split = 'train'))")} as sentiment from m
            union all select 'all', cast(trade_date as varchar), {sql_r6(f"coalesce({_SENT}, (select avg({_SENT}) from m))")} from m""",
    ),
    "standardize": entry(
        standardize,
        f"""with m as (select *, {_SPLIT} as split from fx_market),
            f as (select avg(avg_sentiment) as ma, stddev_pop(avg_sentiment) as sa, avg(volume) as mv, stddev_pop(volume) as sv from m where split = 'train')
            select cast(trade_date as varchar) as trade_date, {sql_r6('(avg_sentiment - ma) / sa')} as avg_sentiment,
              {sql_r6('(volume - mv) / sv')} as volume, 0.0::double as flat from m, f""",
    ),
    "feature_frame": entry(
        feature_frame,
        f"""with r as (select *, lag(daily_return, 1) over (order by trade_date) as a, lag(daily_return, 2) over (order by trade_date) as b,
               {_SPLIT} as split from fx_market where daily_return is not null),
            k as (select * from r where a is not null and b is not null),
            s as (select *, coalesce({_SENT}, (select avg({_SENT}) from k where split = 'train')) as f from k)
            select cast(trade_date as varchar) as trade_date, increase, split, {sql_r6('f')} as f0, {sql_r6('a')} as f1, {sql_r6('b')} as f2,
              {sql_r6('f * a')} as f3, {sql_r6('f * b')} as f4, {sql_r6('a * b')} as f5 from s""",
    ),
    "corr_matrix": entry(corr_matrix, " union all ".join(_corr_cell(a, b) for a in _CORR for b in _CORR)),
    "linregress": entry(
        linregress,
        f"""with m as (select count(*) as n, regr_slope(l_extendedprice, l_quantity) as slope, regr_intercept(l_extendedprice, l_quantity) as intercept,
              corr(l_extendedprice, l_quantity) as r, var_pop(l_quantity) as vx, var_pop(l_extendedprice) as vy from lineitem)
            select n, {sql_r6('slope')} as slope, {sql_r6('intercept')} as intercept, {sql_r6('r')} as r_value, {sql_r6('r * r')} as r_squared,
              {sql_r6('sqrt((1 - r * r) * vy / vx / (n - 2))')} as stderr from m""",
    ),
    "linregress_points": entry(
        linregress_points,
        f"""with p as (select trade_date, avg_sentiment as x, (close_price - lag(close_price) over (order by trade_date))
               / lag(close_price) over (order by trade_date) * 100 as y from fx_market),
            q as (select * from p where x is not null and y is not null),
            f as (select regr_slope(y, x) as a, regr_intercept(y, x) as b from q)
            select cast(trade_date as varchar) as trade_date, {sql_r6('x')} as x, {sql_r6('y')} as y, {sql_r6('a * x + b')} as fitted from q, f""",
    ),
    # The tail of Student's t by Simpson's rule over the angle atan(t / sqrt(v)), without gamma functions.
    "linregress_p_value": entry(
        linregress_p_value,
        f"""with p as (select avg_sentiment as x, (close_price - lag(close_price) over (order by trade_date))
               / lag(close_price) over (order by trade_date) * 100 as y from fx_market),
            q as (select * from p where x is not null and y is not null),
            m as (select count(*) as n, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept, corr(y, x) as r,
              var_pop(x) as vx, var_pop(y) as vy from q),
            e as (select *, sqrt((1 - r * r) * vy / vx / (n - 2)) as se, n - 2 as v from m),
            a as (select v, atan(abs(slope / se) / sqrt(v)) as lo, pi() / 2 as hi, i,
              case when i in (0, 40000) then 1 when i % 2 = 1 then 4 else 2 end as w from e, range(0, 40001) g(i)),
            s as (select sum(w * pow(greatest(cos(lo + (hi - lo) * i / 40000), 0), v - 1)) * any_value(hi - lo)
              / (sum(w * pow(greatest(cos(hi * i / 40000), 0), v - 1)) * any_value(hi)) as p_value from a)
            select n, {sql_r6('slope')} as slope, {sql_r6('intercept')} as intercept, {sql_r6('r')} as r_value, {sql_r6('r * r')} as r_squared,
              {sql_r6('se')} as stderr, {sql_r6('p_value')} as p_value from e, s""",
    ),
    "class_weights": entry(
        class_weights,
        f"""select label, count(*) as n, {sql_r6('(select count(*) from fx_scored) / (2.0::double * count(*))')} as weight
            from fx_scored group by label""",
    ),
    "class_ratio": entry(
        class_ratio,
        f"""select count(*) filter (where label = 0) as n_neg, count(*) filter (where label = 1) as n_pos,
              {sql_r6('count(*) filter (where label = 0) / (count(*) filter (where label = 1))::double')} as ratio from fx_scored""",
    ),
    "metrics_binary": entry(
        metrics_binary,
        f"""with p as (select label, proba, greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, proba)) as c from fx_scored),
            l as (select *, -case when label = 1 then ln(c) else ln(1 - c) end as loss from p)
            select count(*) as n, {sql_r6('avg(case when (proba >= 0.5) = (label = 1) then 1.0::double else 0 end)')} as accuracy,
              {sql_r6('avg(loss)')} as log_loss, 'threshold' as rule from l
            union all select count(*), {sql_r6('avg(case when (proba > 0.5) = (label = 1) then 1.0::double else 0 end)')},
              {sql_r6('avg(loss)')}, 'round' from l""",
    ),
    "auc_rank": entry(
        auc_rank,
        f"""with r as (select label, rank() over (order by proba) + (count(*) over (partition by proba) - 1) / 2.0::double as rk from fx_scored),
            s as (select count(*) filter (where label = 1) as p, count(*) filter (where label = 0) as q, sum(rk) filter (where label = 1) as rs from r)
            select p as n_pos, q as n_neg, {sql_r6('(rs - p * (p + 1) / 2.0::double) / (p::double * q)')} as auc from s""",
    ),
    "classification_report": entry(
        classification_report,
        f"""{_REPORT} select class, {sql_r6('precision')} as precision, {sql_r6('recall')} as recall, {sql_r6('f1')} as f1,
              cast(s as bigint) as support from t""",
    ),
}
