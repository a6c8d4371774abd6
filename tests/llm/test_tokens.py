import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from bellwire.llm import bpe, counts, repair  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
CASES = [
    None, "", "  \n", "Hello world's 'street !'s 12ab ''ll'm", "<|endoftext|>foo<|startoftext|> <|endof", "É é ΑΣ Σ. İstanbul ﬁ",
    "a\x1cb \x1d c\x85d　e\xa0f", "日本語 123 🙂👍🏽", "한" * 3000, "x" * 5000, "ab'" * 3000, "!'" * 4000, "é" * 5000 + "'re", "pichampi" * 900,
    "a" * 2047 + "'s" + "b" * 4000 + "!!'" + "s" * 3000, "word " * 40000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_codec_equals_the_library(library):
    own = bpe.codec(PATH)
    rng = random.Random(3)
    texts = [t or "" for t in CASES] + ["".join(rng.choice("abcdefghin'!.1é ß中") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    texts += ["".join(rng.choice("aoeinthrs'") for _ in range(rng.randint(500, 5000))) for _ in range(20)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids, text[:60]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_batches_encode_as_the_library_does(library, monkeypatch):
    rng = random.Random(5)
    signs = [chr(c) for c in range(0x20, 0x250)] + list("\n\t\r\x0b  'é") + ["'s", "'ll", "\u0307"]
    texts = CASES + ["<|ENDOFTEXT|> a", " a ", "İİ ǅ Ⱥ Ɔ ² 1²a ½", "ab" * 1500] + [chr(c) + " a" + chr(c) + "b" for c in range(0x21, 0x250)]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    own = bpe.codec(PATH, library_merges=True)
    for known in (bpe.KNOWN_WORDS, 20):
        monkeypatch.setattr(bpe, "KNOWN_WORDS", known)
        parts = list(bpe.runs_by_bytes(pa.array(texts, pa.string()), 2000))
        assert len(parts) > 10
        got = [ids for part in parts for ids in own.encode_batch(part)]
        assert [x.tolist() for x in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert own.encode_batch(pa.array([], pa.string())) == [] == list(bpe.runs_by_bytes(pa.array([], pa.string())))


def test_a_piece_goes_to_the_library_once():
    own, asked = bpe.BpeCodec.from_file(PATH, library_merges=True), []
    ids_of = own.ids_of
    own.ids_of = lambda symbols: asked.append(symbols) or ids_of(symbols)
    for text in ("Street, street. STREET!", "(street) ***street, world's"):
        own.encode_batch(pa.array([text] * 3))
    assert len(asked) == len(set(asked)) == 9


def test_letters_with_signs_need_no_pattern(library):
    own, asked = bpe.BpeCodec.from_file(PATH, library_merges=True), []
    split = own.plain_split
    own.plain_split = SimpleNamespace(findall=lambda text: asked.append(text) or split.findall(text))
    texts = ["Street, street. ÉA!? ***", "(b) x1 word's İa café#*", "street"]
    got = own.encode_batch(pa.array(texts))
    assert [x.tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sorted("".join(asked).split()) == sorted(["***", "(b)", "x1", "word's", "i\u0307a"])


def test_stream_holds_a_bounded_window():
    t = bpe.codec(PATH).transducer
    run, most, out = bpe.PieceRun(t), 0, []
    for _ in range(200):
        out += run.feed("thinerst" * 16)
        most = max(most, len(run.held))
    out += run.finish()
    assert most <= t.lookahead + 2 * t.step
    assert out == t.piece("thinerst" * 3200)


def test_lookahead_is_a_longest_chain():
    # 1: bc, 2: ab only if no c follows; nothing else reaches back.
    t = bpe.MergeTransducer({"a": 0, "b": 1, "c": 2, "bc": 3, "ab": 4}, [("b", "c"), ("a", "b")], "")
    assert t.lookahead == 2
    assert t.merged(list("abc")) == ["a", "bc"] and t.merged(list("abab")) == ["ab", "ab"]


def test_byte_level_decoding_holds_back_half_a_character():
    own = bpe.codec(PATH)
    own_decoder = own.decoder()
    machine = own_decoder.machine
    assert machine.decode("é".encode()[:1]) == "" and machine.decode("é".encode()[1:]) == "é"


def test_unsupported_layout_is_refused():
    with pytest.raises(ValueError):
        bpe.BpeCodec({"model": {"type": "WordPiece", "vocab": {}}})


def frame(spark, rows, schema="doc_id long, text string, n_tokens int, id string"):
    return spark.createDataFrame([(i, t, 0, "x") for i, t in rows], schema)


def test_round_trip_query(spark, library):
    import hashlib

    rows = list(enumerate(CASES)) + [(None, "null id"), (3, CASES[3])]
    got = bpe.round_trip(frame(spark, rows), PATH, with_text=True).collect()
    assert len(got) == len(rows)
    texts = {(i, hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for i, t in rows}
    assert {(r.doc_id, r.ids_sha256) for r in got} == texts
    for r in got:
        assert r.n_tokens == len(r.ids) and r.decoded == library.decode(r.ids, skip_special_tokens=False)
        assert hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256
    assert bpe.round_trip(frame(spark, []), PATH).count() == 0


def test_token_counts(spark, library):
    rows = list(enumerate(CASES)) + [(None, "null id")]
    for r in counts.token_counts(frame(spark, rows), PATH, limit=100).collect():
        text = dict(rows)[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_token_counts_of_other_layouts(name):
    path = public_tokenizers.path(name)
    own = counts.TokenCounter(path)
    text = "Some text, with  blanks <s> and more. "
    if name.endswith(".model"):
        import sentencepiece

        want = len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))
    else:
        want = len(Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    assert not own.by_word and own.count(text) == want


def test_batches_by_bytes():
    assert list(counts.batches_by_bytes(["aa", "b", "cccc", "d"], 3)) == [["aa", "b"], ["cccc"], ["d"]]


def test_repair_round_trip_and_windows():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 6, n).astype(np.uint32) for n in (0, 1, 5, 400, 3000)] + [np.full(999, 5, np.uint32)]
    shard = repair.Shard(repair.pack_shard([1, 2, None, 4, 5, 6], texts, 2))
    assert shard.doc_ids == [1, 2, None, 4, 5, 6] and len(shard.grammar.rules)
    whole = np.concatenate([np.append(t, 2) for t in texts])
    for k, t in enumerate(texts):
        assert (shard.ids(k) == np.append(t, 2)).all()
    for start in (0, 7, 500, 4000):
        assert (shard.window(start, 50) == whole[start : start + 50]).all()
    # One symbol in six is the end id, which rules never cross, so random ids shrink to about 0.55.
    assert len(shard.grammar.sequence) < 0.6 * len(whole)
    with pytest.raises(ValueError):
        repair.Shard(b"no" * 20)
    assert repair.Shard(repair.pack_shard([], [], 2)).doc_ids == []


def test_repair_leaves_no_pair_twice():
    rng = np.random.default_rng(3)
    passage = rng.permutation(np.arange(3, 45003))[:40000]
    often = np.concatenate([np.append(p, rng.integers(3, 2000)) for p in [rng.integers(3, 2000, 2)] * 3000])
    texts = [passage, rng.integers(3, 2000, 30000), often, passage, passage[5000:5600], np.full(4097, 7)]
    texts = [t.astype(np.uint32) for t in texts]
    shard = repair.Shard(repair.pack_shard(list(range(len(texts))), texts, 2))
    for k, t in enumerate(texts):
        assert (shard.ids(k) == np.append(t, 2)).all()
    seen = {}
    seq = shard.grammar.sequence.tolist()
    for at, pair in enumerate(zip(seq, seq[1:])):
        if 2 not in pair:
            assert at - seen.setdefault(pair, at) < 2
    # The second copy and the part of it are a few symbols each, however rare their ids are.
    starts = shard.starts
    assert starts[4] - starts[3] == 2 and starts[5] - starts[4] < 60
    assert shard.grammar.lengths.max() >= 40000


def plain_repair(ids, end_id):
    """Rules and sequence with all pairs counted anew in each round, in plain Python."""
    seq, base, rules = list(ids), max([*ids, end_id]) + 1, []
    while True:
        places, at = {}, 0
        for at, pair in enumerate(zip(seq, seq[1:])):
            held = places.setdefault(pair, [])
            if end_id not in pair and (pair[0] != pair[1] or not held or held[-1] != at - 1):
                held.append(at)
        most = max(map(len, places.values()), default=0)
        if most < 2:
            return rules, seq
        often = sorted((p for p in places if len(places[p]) >= max(2, -(-most // 2))), key=lambda p: (-len(places[p]), p))
        starts, ends, twins, put = set(), set(), set(), {}
        for a, b in often:
            if a == b and a not in starts | ends | twins:
                twins.add(a)
            elif a != b and a not in ends | twins and b not in starts | twins:
                starts.add(a)
                ends.add(b)
            else:
                continue
            put |= dict.fromkeys(places[a, b], base + len(rules))
            rules.append((a, b))
        seq = [put.get(at, x) for at, x in enumerate(seq) if at - 1 not in put]


def test_repair_counts_every_pair_in_every_round():
    rng = np.random.default_rng(7)
    for k in range(150):
        ids = rng.integers(0, rng.integers(2, 9), rng.integers(0, 250)).astype(np.uint32)
        if k % 3 == 0:
            ids = np.repeat(ids, rng.integers(1, 7, len(ids)))
        for high in (0, 1 << 22):
            grammar = repair.compress(ids + np.uint32(high) * (ids > 4), 2)
            rules, seq = plain_repair((ids + np.uint32(high) * (ids > 4)).tolist(), 2)
            assert list(map(tuple, grammar.rules.tolist())) == rules and grammar.sequence.tolist() == seq
            if k > 10:
                break


def test_repair_lists_each_place_few_times(monkeypatch):
    listed, inner = [], repair._listed
    monkeypatch.setattr(repair, "_listed", lambda *x: listed.append(len(x[2])) or inner(*x))
    words = [np.random.default_rng(k).integers(3, 900, 4) for k in range(400)]
    ids = np.concatenate([words[k] for k in np.random.default_rng(1).zipf(1.3, 20000) % 400]).astype(np.uint32)
    repair.compress(ids, 2)
    assert len(listed) > 20 and sum(listed) <= 3 * len(ids)


def test_repair_looks_at_rare_runs_once(monkeypatch):
    looked, inner = [], repair._odd
    monkeypatch.setattr(repair, "_odd", lambda twins, after: looked.append(len(twins)) or inner(twins, after))
    words = [np.random.default_rng(k).permutation(np.arange(3, 900))[:4] for k in range(400)]
    often = [words[k] for k in np.random.default_rng(1).zipf(1.3, 5000) % 400]
    rare = [np.array([k, k]) for k in range(1000, 4000)]
    repair.compress(np.concatenate([x for pair in zip(often, rare) for x in pair]).astype(np.uint32), 2)
    assert len(looked) > 20 and sum(looked) < 2 * len(rare)


def test_shards_are_read_through(monkeypatch):
    monkeypatch.setattr(repair, "_TOGETHER", 3)
    passage = np.random.default_rng(2).permutation(np.arange(3, 900)).astype(np.uint32)
    texts = [passage, passage[:0], passage, passage[100:300], np.full(700, 7, np.uint32), passage[:5], passage]
    shard = repair.Shard(repair.pack_shard(list(range(7)), texts, 2))
    assert shard.grammar.lengths.max() > repair._SHORT
    assert [x.tolist() for x in shard.all_ids()] == [[*t.tolist(), 2] for t in texts]


def test_token_shards(spark, library):
    rows = [(i * 7 % 31, t) for i, t in enumerate(CASES + ["shared words again and again"] * 12)]
    got = repair.token_shards(frame(spark, rows), PATH, shard_ids=2000, partitions=3).collect()
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got)) == want
    assert repair.token_shards(frame(spark, []), PATH).count() == 0
