"""Article ingest, lexicon, scoring jobs and resumption."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from bellwire import fixtures as fx
from bellwire.functions.text import clean_title, tokens
from bellwire.operators import scoring as sc
from bellwire.sources import articles as ar, lexicon as lx, prices as px, tables as tb

SLICE = date(2024, 1, 1)


def page(n, articles, status="ok", total=350, domain="Wsj.com", body=None):
    payload = {"status": status, "totalResults": total, "articles": articles}
    return (domain, SLICE, n, json.dumps(payload) if body is None else body)


def art(title, at="2024-01-01T10:00:00Z", url="u"):
    return {"title": title, "publishedAt": at, "url": url}


def responses(spark, rows):
    return spark.createDataFrame(rows, "domain string, slice_start date, page int, body string")


def test_ingest_keeps_complete_articles_only(spark):
    rows = [page(1, [art("  A \n", url="1"), art(None), art("   ", url="2"), art("B", at="x", url="3"), art("C", url=None), art("D", at="2024-01-01T10:00:00-05:00", url="4")])]
    got = sorted((r.source, r.title, r.published_at, r.url) for r in ar.ingest_articles(responses(spark, rows)).collect())
    assert got == [("wsj", "A", "2024-01-01 10:00:00+00:00", "1"), ("wsj", "D", "2024-01-01 15:00:00+00:00", "4")]


@pytest.mark.parametrize(
    "bad", [page(2, [], "ok"), page(2, [art("x")], "error"), page(2, [], body='{"status": "ok", "articles": [{"ti')]
)
def test_a_fetch_stops_before_its_first_bad_page(spark, bad):
    rows = [page(1, [art("A", url="1")]), bad, page(3, [art("C", url="3")]), page(1, [art("Z", url="9")], domain="b.com")]
    assert sorted(r.url for r in ar.ingest_articles(responses(spark, rows)).collect()) == ["1", "9"]


def test_pages_beyond_the_announced_total_are_not_fetched(spark):
    rows = [page(1, [art("A", url="1")], total=150), page(2, [art("B", url="2")]), page(3, [art("C", url="3")])]
    assert sorted(r.url for r in ar.ingest_articles(responses(spark, rows)).collect()) == ["1", "2"]
    assert ar.ingest_articles(responses(spark, [page(2, [art("B")])])).count() == 0


def test_store_is_unique_by_source_and_url_first_fetched_wins(spark):
    rows = [page(1, [art("A", url="1"), art("A2", url="1")]), page(2, [art("A3", url="1"), art("B", url="2")]), page(1, [art("O", url="1")], domain="b.com")]
    target = spark.createDataFrame([("wsj", "old", "t", "2")], "source string, title string, published_at string, url string")
    got = ar.store_articles(target, ar.ingest_articles(responses(spark, rows))).collect()
    assert sorted((r.source, r.title) for r in got) == [("b", "O"), ("wsj", "A")]


def test_fetch_plan_clips_the_last_slice_and_skips_empty_ones(spark):
    bounds = spark.createDataFrame([(date(2024, 1, 1), date(2024, 1, 17))], "start date, end date")
    slices = ar.fetch_slices(bounds, ["a.com", "b.com"])
    assert slices.count() == 6
    totals = slices.select("domain", "slice_start", F.expr("case when domain = 'a.com' then 101 else 0 end").alias("total"))
    got = sorted((r.from_iso, r.to_iso, r.page) for r in ar.fetch_plan(slices, totals).collect())
    assert got[-1] == ("2024-01-15T00:00:00Z", "2024-01-17T00:00:00Z", 2) and len(got) == 6


def test_lexicon_files_round_trip(spark, tmp_path):
    flags = spark.createDataFrame([("Good", 2009.0, 0.0), ("GOOD", 1.0, 0.0), ("Bad", 0.0, 2011.0), ("Both", 1.0, 1.0), ("None", 0.0, -1.0)], "Word string, Positive double, Negative double")
    built = lx.build_lexicon(flags)
    paths = [lx.write_word_list(built, sign, str(tmp_path / name)) for sign, name in ((1, "p"), (-1, "n"))]
    assert {(r.word, r.polarity) for r in lx.read_lexicon(spark, *paths).collect()} == {("good", 1), ("bad", -1), ("both", 1)}


def lexicon_score(text, pos, neg):
    p = sum(w in pos for w in text.split())
    n = sum(w in neg and w not in pos for w in text.split())
    return p, n


def test_lexicon_scores(spark):
    texts = ["good good bad", "bad", "nothing here", "", "both good " * 16, "good " * 2 + "bad"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, title_clean string")
    words = spark.createDataFrame([("good", 1), ("both", 1), ("both", -1), ("bad", -1)], "word string, polarity int")
    got = {r.id: r for r in sc.score_lexicon(df, words).collect()}
    for i, t in enumerate(texts):
        assert (got[i].n_pos, got[i].n_neg) == lexicon_score(t, {"good", "both"}, {"bad"})
    assert [got[i].lm_sentiment_score for i in range(6)] == [0.3333, -1.0, 0.0, None, 1.0, 0.3333]


def test_lexicon_score_rounds_half_to_even(spark):
    # 17 good and 15 bad give 2 / 32 = 0.0625; 33 and 31 give 2 / 64 = 0.03125, half between 4 decimals.
    df = spark.createDataFrame([(1, "g " * 33 + "b " * 31)], "id long, title_clean string")
    words = spark.createDataFrame([("g", 1), ("b", -1)], "word string, polarity int")
    assert sc.score_lexicon(df, words).first().lm_sentiment_score == round(2 / 64, 4) == 0.0312


def test_large_lexicon_joins_without_broadcast_to_the_same_scores(spark, sf_dir, monkeypatch):
    news = fx.news(spark, sf_dir).withColumn("title_clean", clean_title("title"))
    words = fx.lexicon(spark)
    small = sorted(map(tuple, sc.score_lexicon(news, words).collect()))
    monkeypatch.setattr(sc, "broadcast_if_small", lambda df: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(tuple, sc.score_lexicon(news, words).collect())) == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def titles(spark, n=40):
    return spark.range(n).select("id", F.expr("if(id % 7 = 0, null, concat('head line ', repeat('a', cast(id as int))))").alias("title_clean"))


@pytest.mark.parametrize("batch_size, parts", [(1, 1), (256, 5)])
def test_classifier_scores_do_not_depend_on_batching(spark, batch_size, parts):
    got = sorted(map(tuple, sc.score_batches(titles(spark).repartition(parts), batch_size=batch_size).collect()))
    want = sorted(map(tuple, sc.score_batches(titles(spark)).collect()))
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(abs(a - b) < 1e-12 for r, s in zip(got, want) for a, b in zip(r[1:], s[1:]))
    assert all(abs(sum(r[1:]) - 1) < 1e-9 for r in got)


def test_remote_scoring_retries_and_reports(spark):
    def flaky_client():
        seen = {}

        def ask(prompt):
            n = seen[prompt] = seen.get(prompt, 0) + 1
            if "aaaaa" in prompt:
                raise RuntimeError("always down")
            if n < 3:
                raise RuntimeError("try again")
            return " 2.5 "

        return ask

    scored = sc.score_remote(titles(spark, 20), flaky_client, backoff=0.0)
    rows = {r.id: r for r in scored.collect()}
    assert len(rows) == 20
    assert rows[1].score == 1.0 and rows[1].error is None
    assert rows[6].score is None and rows[6].error == "ERROR: always down"
    good, dead = sc.split_dead_letters(scored)
    assert good.count() + dead.count() == 20


def test_unknown_prompt_is_refused(spark):
    with pytest.raises(ValueError):
        sc.score_remote(titles(spark), prompt="nope")


def test_resume_scores_only_what_is_missing(spark):
    news = titles(spark)
    done = news.where("id < 30").select("id", F.lit(1.0).alias("score"))
    assert sorted(r.id for r in sc.unscored(news, done).collect()) == list(range(30, 40))
    assert sc.unscored(news, news.select("id")).count() == 0


def test_net_sentiment_keeps_old_value_without_both_sides(spark):
    df = spark.createDataFrame([(0.7, 0.2, 9.0), (None, 0.2, 9.0)], "finbert_sentiment_pos double, finbert_sentiment_neg double, finbert_sentiment_final double")
    assert [round(r.finbert_sentiment_final, 6) for r in sc.net_sentiment(df).collect()] == [0.5, 9.0]


def test_embedding_is_unit_length_and_zero_for_no_tokens(spark):
    got = {r.id: r.embedding for r in sc.embed_titles(titles(spark), dim=8).collect()}
    assert got[0] == [0.0] * 8 and abs(sum(x * x for x in got[1]) - 1) < 1e-12 and len(got) == 40


def test_token_counts_use_whole_texts(spark, sf_dir):
    docs = fx.table(spark, sf_dir, "documents")
    n = docs.select(F.sum(F.size(tokens("text")))).first()[0]
    assert n == docs.select(F.explode(tokens("text"))).count()


def test_prices_csv(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-02", "1.5", "2", "3", "1", "1000"), ("bad", "x", "", "3", "1", "7.0")], px.RAW_PRICES)
    got = px.load_prices(spark, tb.write_csv(df, str(tmp_path / "p"))).orderBy("trade_date").collect()
    assert got[0].trade_date is None and got[0].open_price is None and got[0].volume == 7
    assert got[1].volume == 1000 and got[1].close_price == 2.0
