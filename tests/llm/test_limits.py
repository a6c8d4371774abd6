"""Long texts, rare characters, clashing names and stray tags; mixing against plain least squares."""

import time
import tracemalloc
import warnings

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from bellwire.llm import language, mixing, neardup, pages, shingles  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def test_long_runs_of_rare_letters_have_finite_scores():
    vocabulary = language.vocabulary(PIECES)
    counts = {"a": {"the": 6_000_000, "and": 4_000_000}, "b": {"der": 50, "die": 50, "q" * 40: 1}}
    model = language.fit(counts, vocabulary)
    assert np.isfinite(model.probs).all() and (model.probs > 0).all()
    logs = model.log_probs(["ꙮ" * 40, "q" * 40, "the", "der", "ꙮ" * 500])
    assert np.isfinite(logs).all()
    # Sums in logarithms, one segmentation at a time, for characters outside the vocabulary.
    assert "ꙮ" not in vocabulary and "▁ꙮ" not in vocabulary
    mark = model.probs[vocabulary.get("▁", 0)]
    assert logs[0] == pytest.approx(40 * np.log(model.probs[0]) + np.log(mark), rel=1e-6)
    assert logs[1].argmax() == 1 and logs[2].argmax() == 0 and logs[3].argmax() == 1


def test_languages_of_empty_and_odd_tables(spark):
    rows = [(i, ("the thing and other words" if i % 2 else "der die das und zeile") + f" {i}", "en" if i % 2 else "de", 1, "z") for i in range(60)]
    rows += [(70, "the thing and other words", None, 1, "z")] * 2 + [(71, "the der", None, 1, "z")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, lang_pred string")
    got = language.predict(table, PIECES, carry=("score", "lang_pred")).where("doc_id >= 70").collect()
    assert [r.lang_pred for r in got if r.doc_id == 70] == ["en", "en"] and all(r._x1 == "z" for r in got)
    assert language.predict(table.where("false"), PIECES).count() == 0


@pytest.mark.parametrize(
    "page", ["<b>" * 40_000 + "</i>" * 40_000 + "x", "<i><table><tr><td>" + "<b>" * 40_000 + "</i>" * 40_000 + "x", "<b>" * 40_000 + "<p>x" * 20_000, "<b>" * 30_000 + "<li>x" * 30_000]
)
def test_stray_tags_take_linear_time(page):
    start = time.process_time()
    pages.build(page)
    assert time.process_time() - start < 5


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("E = <math><mi>m</mi><annotation>tex</annotation></math>!", "E = m!"),
        ("<svg><defs/><title>t</title><desc>d</desc><path d='M0'/><text>label</text></svg> end", "label end"),
        ("<select><option>one<option>two</select>", "one\ntwo"),
        ("a<noscript>b</noscript>c", "abc"),
        ("<table><tr><td>a<p>b</td></tr></p><tr><td>c</table>d", "a b\nc\n\nd"),
        ("<p>a<b>b</p>c", "ab\n\nc"),
    ],
)
def test_visible_text_of_foreign_and_nested_parts(page, text):
    got = pages.visible_text(page)
    assert [line.strip() for line in got.split("\n") if line.strip()] == [line for line in text.split("\n") if line], got


def test_pages_of_odd_tables(spark):
    rows = [(1, "<p>a", 5, "q"), (1, "<p>a", 5, "q"), (None, "x" * 300_000, 5, "q")]
    table = spark.createDataFrame(rows, "page_id long, html string, n_chars int, text string")
    assert sorted(r.n_chars for r in pages.extract(table).collect()) == [1, 1, 300_000]
    assert pages.extract(table.where("false")).count() == 0


def test_signatures_in_slices_equal_whole_ones(monkeypatch):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (1, 300, 5000, 700)]
    whole = neardup.super_minhash(sets)
    monkeypatch.setattr(neardup, "_DRAW", 64)
    assert (neardup.super_minhash(sets) == whole).all()


def test_long_texts_in_slices(monkeypatch):
    words = [f"w{i * i % 9973}" for i in range(60_000)] + ["x" * 9000, "End"]
    text = pa.array([" ".join(words) + " \n"])
    whole = list(shingles.shingle_sets(text))[0]
    monkeypatch.setattr(shingles, "BLOCK_BYTES", 4096)
    assert (list(shingles.shingle_sets(text))[0] == whole).all()


def test_memory_of_a_very_long_text():
    text = pa.array([" ".join(f"w{i * 7919 % 1_000_003}" for i in range(1_000_000))])
    tracemalloc.start()
    found = list(shingles.shingle_sets(text))
    neardup.super_minhash(found)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 8 MB of text and 8 of hashes; 256 places of 2 bytes for every shingle at once would be 512 MB.
    assert peak < 150e6


def mixing_rows(n=240):
    return [(i, " ".join(f"{'abc'[i % 10 // 4]}{(i * k) % 30}" for k in range(1, 5 + i % 30)), "abc"[i % 10 // 4]) for i in range(n)]


def test_rates_equal_plain_least_squares(spark):
    docs = spark.createDataFrame(mixing_rows(), "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i,) for i in range(150)], "doc_id long")
    got = mixing.mix(docs, labels, targets={"a": 1, "b": 3, "c": 2}).collect()
    t = np.array([r.n_tokens for r in got], float)
    m = t[:, None] * np.array([[r.posterior[d] for d in "abc"] for r in got])
    mass, target = m.sum(axis=0), t.sum() * np.array([1, 3, 2]) / 6

    def cost(r):
        return ((r @ m - target) ** 2 / (2 * mass)).sum() + mixing.RIDGE / 2 * (t * (r - 1) ** 2).sum()

    best = np.ones(len(t))
    for _ in range(20_000):
        best = np.maximum(0, best - 0.3 * ((m / t[:, None]) @ ((best @ m - target) / mass) + mixing.RIDGE * (best - 1)))
    rate = np.array([r.rate for r in got])
    assert cost(rate) <= cost(best) * 1.01 + 1e-3 * t.sum() * 1e-3
    assert np.abs(rate @ m - target).max() <= 0.01 * t.sum()


def test_mixing_learns_every_domain_and_names_what_it_cannot_reach(spark):
    rows = [(i, f"only{i % 40} word{i % 40}", f"d{i % 40:02}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i,) for i in range(400)], "doc_id long")
    assert len(mixing.mix(docs, labels).first().posterior) == 40
    with pytest.raises(ValueError, match="fr"):
        mixing.mix(docs, labels, targets={"d01": 1, "fr": 9})
    same = spark.createDataFrame([(i, "same words", "ab"[i % 2]) for i in range(40)], "doc_id long, text string, lang string")
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        mixing.mix(same, labels, targets={"a": 9, "b": 1}).collect()
    assert any("target" in str(w.message) for w in caught)


def test_mixing_of_odd_tables(spark):
    docs = spark.createDataFrame(mixing_rows(60) + [(3, "a1 a2", "a")] * 3 + [(None, None, None), (90, "b1 " * 200_000, "b")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    got = mixing.mix(docs, labels).collect()
    assert len(got) == 65 and len({r.rate for r in got if r.doc_id == 3 and r.n_tokens == 2}) == 1
    assert mixing.mix(docs.where("false"), labels).count() == 0


INNER = ["n_tokens", "rate", "copies", "posterior", "_tokens", "_b", "_n", "_x0", "_id", "_text", "score", "predicted", "lang_pred", "held_out", "kept", "component_id", "n_shingles", "_nth", "_p0", "_u", "toxic", "quality"]


def test_pipeline_passes_columns_of_any_name(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    text = {"en": "the thing with other words and then some more of the same kind", "de": "der die das und einer weiteren zeile aus dem langen buch von gestern"}
    rows = [(i, " ".join([text[k], *(f"{k}{c}" for c in str(i * 7919))]) + (" vile vilest" if i % 6 == 0 else ""), k) for i, k in enumerate(["en", "en", "de"] * 30)]
    docs = spark.createDataFrame([(i, t, k, "s", len(t)) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in INNER})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    assert all(r[c] == f"{c}{r.doc_id}" for r in at.collect() for c in INNER)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 60


def test_pipeline_of_an_empty_table(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_send_small_batches_and_let_go_of_tables(spark, monkeypatch):
    import corpus_pipeline
    from bellwire.llm.state import lean, per_worker

    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {k: spark.conf.get(k) for k in keys}
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"), F.lit("en").alias("lang")).coalesce(1)
    try:
        corpus_pipeline.encode(spark, docs.limit(1), "")
        sent = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n long, size long").collect()
        assert sum(r.n for r in sent) == 6000
        assert max(r.n for r in sent) <= 1000 and max(r["size"] for r in sent) <= 5 << 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    per_worker("old tables", list, "tables")
    assert list(lean(iter([1, 2]), "tables")) == [1, 2]
    made = []
    per_worker("old tables", lambda: made.append(1), "tables")
    assert made == [1]
