import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from bellwire.llm import components, language, mixing, neardup, pages, quality, toxicity  # noqa: E402
from bellwire.llm.shingles import shingle_sets  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, id string, rep int, n int, t string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", "x", 1, 2, "y") for r in rows], SCHEMA)


def word_set(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def groups(sets, num, den):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    rows, i = [], 100
    for base in range(6):
        text = [words[k] for k in rng.integers(0, 400, 60 + 20 * base)]
        for copy in range(40):
            mine = list(text)
            for at in rng.integers(0, len(mine), rng.integers(0, 8)):
                mine[at] = words[rng.integers(0, 400)]
            rows.append((i, " ".join(mine).title() if copy % 5 == 0 else "\n".join(mine), "en"))
            i += 1
    rows += [(1, None, "en"), (2, "", "en"), (3, " \t", "en"), (4, "one", "en"), (5, "ONE", "en"), (6, "one two", "en"), (7, "x " * 30000, "en"), (8, "x x x", "en")]
    sets = {r[0]: word_set(r[1]) for r in rows}
    want = groups(sets, 85, 100)
    got = {r.doc_id: r for r in neardup.near_duplicates(frame(spark, rows), width=3).collect()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.n_shingles == len(sets[k]) and r.kept == (k == r.component_id) for k, r in got.items())
    assert len(set(want.values())) > 8


@pytest.mark.parametrize("half", [6, 8, 32])
def test_near_duplicates_in_small_clusters_of_many_blocks(spark, monkeypatch, half):
    """Text k is near only to text k + half, blocks away, and all are alike enough for one cluster."""
    rng = np.random.default_rng(7)
    text, rows = [f"w{i}" for i in range(400)], []
    for k in range(half):
        mine = list(text)
        for at in rng.choice(400, 7, replace=False):
            mine[at] = f"v{k}x{at}"
        rows += [(k, " ".join(mine), "en"), (k + half, " ".join([*mine[:-1], f"u{k}"]), "en")]
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", 1600)
    want = groups({r[0]: word_set(r[1]) for r in rows}, 85, 100)
    assert want == {k: k % half for k in range(2 * half)}
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(frame(spark, rows), width=3).collect()}
    assert got == want


def test_near_duplicates_of_nothing_and_null_ids(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    got = neardup.near_duplicates(frame(spark, [(None, "a b c d e f", "en"), (9, "a b c d e f", "en"), (9, "a b c d e f", "en")])).collect()
    assert sorted((str(r.doc_id), r.kept) for r in got if r.doc_id is not None) == [("9", True), ("9", True)]


def test_signature_agreement_estimates_similarity():
    import pyarrow as pa

    a = [f"t{i}" for i in range(300)]
    texts = pa.array([" ".join(a), " ".join(a[:270] + [f"u{i}" for i in range(30)])])
    sets = list(shingle_sets(texts))
    signs = neardup.super_minhash(sets)
    true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
    assert abs((signs[0] == signs[1]).mean() - true) < 0.1
    # One element fills every slot once, a level each.
    alone = neardup.super_minhash([sets[0][:1]])[0] >> np.uint64(32)
    assert sorted(alone.tolist()) == list(range(neardup.SLOTS))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(5, 5), (200, None)]
    got = dict(components.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 140)}


def plain_counts(text):
    text = text or ""
    w = [x for x in re.split("[ \t-\r]+", text) if x]
    lines = [x for x in text.split("\n") if re.sub("[ \t-\r]", "", x)]
    seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_quality_counts_and_verdicts(spark):
    good = [" ".join(f"good{(i * k) % 40}" for i in range(60)) for k in range(1, 15)]
    junk = [" ".join(f"junk{(i * k) % 40}" for i in range(60)) for k in range(1, 15)]
    odd = [None, "", "a\n\na\na", "#*$ <x>|&%", "r e p e a t e d " * 40, "one two three four five six seven eight " * 2, "é" * 50000 + " ü"]
    rows = [(i, t, "en") for i, t in enumerate(good + junk + odd)]
    labels = spark.createDataFrame([(i, 1) for i in range(7)] + [(None, 1), (3, 1), (20, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality(frame(spark, rows), labels).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_counts(t), t
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert min(got[i].score for i in range(14)) > max(got[i].score for i in range(14, 28))
    assert not any(got[i].kept for i in range(14, 28))
    none = labels.where("quality = 7")
    assert {r.score for r in quality.quality(frame(spark, rows), none).collect()} == {0.0}


def test_quality_stays_in_the_jvm(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    plan = quality.quality(frame(spark, [(1, "a b", "en")]), labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("Scan ExistingRDD", "") and "Arrow" not in plan


def test_mixing_reaches_its_targets(spark):
    rows = [(i, " ".join(f"{'abc'[i % 10 // 4]}{(i * k) % 30}" for k in range(1, 21)), "abc"[i % 10 // 4]) for i in range(400)]
    rows += [(1000, None, None), (1001, "", "a")]
    labels = spark.createDataFrame([(i,) for i in range(200)], "doc_id long")
    mixed = mixing.mix(frame(spark, rows), labels, targets={"a": 1, "b": 1, "c": 2}).collect()
    held = Counter()
    for r in mixed:
        for d, p in r.posterior.items():
            held[d] += r.n_tokens * p * r.rate
    whole = sum(r.n_tokens for r in mixed)
    assert [round(held[d] / whole, 2) for d in "abc"] == [0.25, 0.25, 0.5]
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in mixed)
    grown = mixing.mix(frame(spark, rows), labels, at_least=1).collect()
    assert min(r.copies for r in grown) == 1
    alone = mixing.mix(frame(spark, rows), labels.where("doc_id < 0")).collect()
    assert {(r.rate, r.copies) for r in alone} == {(1.0, 1)}


def test_language_forward_sums_all_segmentations():
    pieces = {"▁a": 1, "▁ab": 2, "b": 3, "bc": 4, "c": 5}
    probs = np.array([[0.01], [0.2], [0.3], [0.1], [0.25], [0.14]])
    model = language.PieceModel(pieces, ["x"], probs)
    # The mark alone is no piece, so it counts as an unknown character before an unknown a.
    want = 0.2 * 0.1 * 0.14 + 0.2 * 0.25 + 0.3 * 0.14 + 0.01 * 0.01 * (0.1 * 0.14 + 0.25)
    assert np.exp(model.log_probs(["abc"]))[0, 0] == pytest.approx(want)


def test_language_grid_finds_every_piece():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcé𝒜"), 9)) for _ in range(200)]
    for pieces in ({}, {"a": 1}, {p: k + 1 for k, p in enumerate(sorted({w[a : a + n] for w in words[:30] for a in range(5) for n in range(1, 5)}))}):
        model = language.PieceModel(pieces, ["x"], np.full((len(pieces) + 1, 1), 0.1))
        want = np.full((10, min(model.longest, 9), len(words)), -1)
        for w, word in enumerate(words):
            for end in range(1, 10):
                for length in range(1, min(model.longest, end) + 1):
                    want[end, length - 1, w] = pieces.get(word[end - length : end], 0 if length == 1 else -1)
        assert (model._grid(words, 9) == want).all()


def test_language_sums_a_word_once(monkeypatch):
    model = language.PieceModel({"a": 1, "ab": 2}, ["x", "y"], np.array([[0.1, 0.2], [0.3, 0.4], [0.6, 0.4]]))
    asked, inner = [], model.log_probs
    model.log_probs = lambda words: asked.extend(words) or inner(words)
    texts = ["Ab ba, ab!", None, "12", "ba abba"]
    first = model.texts(texts)
    assert sorted(asked) == ["ab", "abba", "ba"] and first[1] is first[2] is None
    assert np.allclose(first[0], 2 * inner(["ab"])[0] + inner(["ba"])[0])
    monkeypatch.setattr(language, "KNOWN", 2)
    for _ in range(3):
        assert all((a is b is None) or (a == b).all() for a, b in zip(model.texts(texts), first))
    assert len(asked) == 12 and len(model.numbers) == 3


def test_language_learns_and_names_und(spark):
    texts = {"en": "the thing with other words and then some", "de": "der die das und einer weiteren zeile", "fr": "les choses que nous avons dans une ville"}
    rows = [(i, texts[k] + f" {i}", k) for i, k in enumerate(list(texts) * 20)] + [(900, None, "en"), (901, "123 !", "de"), (902, "Die Zeile und der Rest " * 20000, None)]
    got = {r.doc_id: r for r in language.predict(frame(spark, rows), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert all(got[i].lang_pred == k for i, _, k in rows[:60])
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und", "und", "de"] and got[900].score == 0.0
    untaught = language.predict(frame(spark, [(1, "words", None)]), public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert untaught[0].lang_pred == "und"


def test_toxicity_learns_from_rows_that_are_not_held_out(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        words = [f"word{k}x" for k in rng.integers(0, 60, 30)]
        if i % 5 == 0:
            words[3:5] = ["vile", "vilest"]
        rows.append((i, " ".join(words), "en"))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (5000, 1)], "doc_id long, toxic int")
    rows += [(900, None, "en"), (901, "", "en")]
    got = {r.doc_id: r for r in toxicity.toxicity(frame(spark, rows), labels).collect()}
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(300))
    assert got[900].predicted == 0 and 0 <= got[901].score < 0.5
    none = toxicity.toxicity(frame(spark, rows), labels.where("toxic = 0")).collect()
    assert {r.score for r in none} == {0.0}


def test_capitals_count_at_every_length():
    for n in (100, (1 << 20) - 1, 1 << 20, (1 << 20) + 1):
        assert toxicity.patterns("A" * n)[0] == 1.0 and toxicity.patterns("a" * n)[0] == 0.0
    text = "SHOUTED WORDS " * (1 << 17)
    scorer = toxicity.Scorer([], np.array([0.0, 0.0, 0.0, 3.0, 0.0, 0.0]), -1.0)
    assert len(text) > 1 << 20 and scorer.score(text) == scorer.score(text[:1400]) > 0.5


def test_label_model_discounts_voters_that_repeat_each_other():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    a, b = (rng.random(4000) < np.where(y, 0.8, 0.1) for _ in range(2))
    noise = rng.random(4000) < np.where(y, 0.6, 0.2)
    post, about = toxicity.label_model(np.stack([a, b, noise, noise, noise, y], axis=1).astype(float))
    assert ((post > 0.5) == y).mean() > 0.95
    assert about["discount"][2] < about["discount"][0]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        (None, None),
        ("<title>x</title><p>Hello <b>b</b>old<p>two &amp; 3<br>line", "Hello bold\n\ntwo & 3\nline"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
        ("<table><tr><th>Name<th>N<tr><td>apple<td>1</table>", "Name   N\napple  1"),
        ("<div hidden>no</div><i style='DISPLAY : none'>no</i>yes<script>if (a<b) '</p>'</script>", "yes"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("a</div></p>b < c <!-- x", "ab < c"),
        ("<div>" * 3000 + "deep", "deep"),
    ],
)
def test_visible_text(page, text):
    assert pages.visible_text(page) == text


def test_extract(spark):
    got = pages.extract(spark.createDataFrame([(1, None, "t"), (2, "<p>a<p>b", "t")], "page_id long, html string, text string")).orderBy("page_id").collect()
    assert [tuple(r) for r in got] == [(1, None, None), (2, "a\n\nb", 4)]


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    texts = {"en": "the thing with other words and then some more of the same kind", "de": "der die das und einer weiteren zeile aus dem langen buch von gestern"}
    rows = [(i, " ".join([texts[k], *(f"{k}{c}" for c in str(i * 7919))]), k) for i, k in enumerate(["en", "en", "de"] * 40)]
    rows = [(i, t + (" vile vilest" if i % 6 == 0 else ""), k) for i, t, k in rows]
    rows += [(500, rows[1][1], "en"), (501, None, "en"), (502, "12 34", "en")]
    docs = spark.createDataFrame([(i, t, k, "s", len(t or "")) for i, t, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.count("*").alias("k")).collect()
    clean = {i for i, t, _ in rows if t and "vile" not in t and i < 500}
    want = {min(j for j, u, _ in rows if u and j in clean and c[j] == c[i]) for c in [groups({j: word_set(u, 5) for j, u, _ in rows if j in clean}, 80, 100)] for i in clean}
    assert {r.doc_id for r in out} == want and all(r.k >= 1 for r in out)
