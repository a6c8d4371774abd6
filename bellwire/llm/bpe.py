"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoder.

Merges are applied by rank inside a sliding window. A token at the left end of the window is final
once the text to its right is longer than the *sufficient lookahead* of the merge list: the longest
stretch of text whose merges can still reach back across a token boundary. That bound is computed
from the list alone, so the working memory is constant whatever the length of a word:

* a merge ``s = (a, b)`` can undo the right edge of a token ``t`` only if ``a`` lies on the right
  spine of ``t`` (``t``, its right part, the right part of that, ...);
* the merge needs ``b``, whose own right edge only merges of a lower rank than ``s`` can undo.

Going through the merges in rank order, ``reach[a] = max(len(b) + reach of b's right spine)`` is a
longest path in a graph without cycles, and the largest reach of any token is the bound.

Text is handled in stretches cut at white space, and words met before are looked up: two
generations of a bounded dictionary, so this memory is constant as well.

Supported files: ``tokenizers`` JSON files with a BPE model and an end-of-word suffix, normalised
by NFC, white-space folding and lower-casing, split by one regular expression that drops white
space. Anything else raises ``ValueError``.

Null texts count as empty. Empty or blank texts have no tokens. Special tokens inside a text become
their ids, as the library does by default.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import struct
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwire.llm.state import Numbers, per_worker

_NO_RANK = 1 << 30
#: Characters of one stretch of text.
STRETCH = 1 << 16
#: Words kept per generation of the dictionary.
KNOWN_WORDS = 1 << 18
#: A word longer than this is streamed and not remembered.
LONG_WORD = 2048

#: Bytes of the texts that are cut into words together.
RUN_BYTES = 1 << 23

# str.split() also cuts at these four; the pattern of the file does not.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SPACE = regex.compile(r"[\s--\x1c-\x1f]+", regex.V1)
_PLAIN = regex.compile("[\x21-\x7e\xa1-ɏ]*")
#: Texts, as Arrow matches them, that hold other characters, other white space or perhaps a special token.
_NOT_PLAIN = r"[^\t\n\r\x20-\x7e\x{a1}-\x{24f}]|<\|"
#: Plain words, as Arrow matches them, of letters with ASCII signs behind them: two pieces. An apostrophe may begin one
#: more, and one letter (U+0130) becomes two characters in lower case.
_LETTERS_SIGNS = r"^(?P<letters>[a-z\x{aa}\x{b5}\x{ba}\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others for the characters from 256 on.
    """
    out, extra = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


def joining() -> frozenset[str]:
    """Characters that may compose with the one before them: second halves, and Hangul vowels and finals."""
    return per_worker("joining", _joining)


def _joining() -> frozenset[str]:
    halves = (unicodedata.decomposition(chr(c)).split() for c in range(sys.maxunicode + 1))
    return frozenset(chr(int(h[1], 16)) for h in halves if len(h) == 2 and h[0][0] != "<") | {chr(c) for c in range(0x1160, 0x1200)}


def _class_of(category: str) -> str:
    """What stands for \\p{L} or \\p{N} in a class of the plain library: the characters that lower-cased plain words may hold."""
    return "".join(f"\\u{c:04x}" for c in range(0x21, 0x3000) if unicodedata.category(chr(c))[0] == category)


def stretches(text: str) -> Iterator[list[str]]:
    """The words between white space, for one stretch of text after another."""
    at = 0
    while at < len(text):
        end = at + STRETCH
        if end < len(text):
            space = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end))
            if space < 0:
                found = _SPACE.search(text, end)
                space = found.start() if found else len(text)
            end = space
        part = text[at:end]
        yield part.split() if not _ODD_SPACE.search(part) else [w for w in _SPACE.split(part) if w]
        at = end


def runs_by_bytes(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[pa.Array]:
    """Parts of a string array with about ``limit`` bytes each, and at least one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield texts.slice(at, end - at)
        at = end


def packed_ids(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    ids = list(ids)
    return struct.pack(f"<{len(ids)}I", *ids)


class Known(dict):
    """word -> value, computed on a miss; at most two generations of ``size`` words are held."""

    def __init__(self, make, size: int = KNOWN_WORDS):
        super().__init__()
        self._make, self._size, self._old = make, size, {}

    def __missing__(self, word):
        value = self._old.get(word)
        if value is None:
            value = self._make(word)
        if len(self) >= self._size:
            self._old = dict(self)
            self.clear()
        if len(word) <= LONG_WORD:
            self[word] = value
        return value


class MergeTransducer:
    """Symbols in, token ids out; holds at most ``lookahead + step`` symbols."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str, step: int = 512):
        merges = [tuple(m) for m in merges]
        self.vocab, self.suffix, self.step = vocab, suffix, step
        self.rank = {m: i for i, m in enumerate(merges)}
        self.lookahead = self._sufficient_lookahead(merges)

    def _sufficient_lookahead(self, merges: list[tuple[str, str]]) -> int:
        def length(token: str) -> int:
            return len(token.removesuffix(self.suffix)) if self.suffix else len(token)

        right: dict[str, str] = {}
        reach: dict[str, int] = {}

        def spine_reach(token: str) -> int:
            most = reach.get(token, 0)
            while token in right:
                token = right[token]
                most = max(most, reach.get(token, 0))
            return most

        for a, b in merges:
            right.setdefault(a + b, b)
            reach[a] = max(reach.get(a, 0), length(b) + spine_reach(b))
        return max((spine_reach(t) for t in self.vocab), default=0)

    def merged(self, symbols: list[str]) -> list[str]:
        """Tokens of one window, by rank and from left to right; consumes ``symbols``."""
        rank = self.rank.get
        ranks = [rank(p, _NO_RANK) for p in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == _NO_RANK:
                break
            i = ranks.index(best)
            symbols[i] += symbols.pop(i + 1)
            ranks.pop(i)
            if i:
                ranks[i - 1] = rank((symbols[i - 1], symbols[i]), _NO_RANK)
            if i < len(ranks):
                ranks[i] = rank((symbols[i], symbols[i + 1]), _NO_RANK)
        return symbols

    def piece(self, symbols: str) -> list[int]:
        """Ids of a whole piece that fits the window."""
        if len(symbols) > self.lookahead + self.step:
            run = PieceRun(self)
            return [*run.feed(symbols), *run.finish()]
        parts = list(symbols)
        parts[-1] += self.suffix
        return [self.vocab[t] for t in self.merged(parts)]


class PieceRun:
    """The state of one piece that is still being read."""

    def __init__(self, transducer: MergeTransducer):
        self.t, self.held = transducer, ""

    def feed(self, symbols: str) -> Iterator[int]:
        t, window = self.t, self.t.lookahead + self.t.step
        for at in range(0, len(symbols), t.step):
            self.held += symbols[at : at + t.step]
            while len(self.held) > window:
                done = 0
                for token in t.merged(list(self.held[:window])):
                    if done + len(token) > window - t.lookahead:
                        break
                    done += len(token)
                    yield t.vocab[token]
                self.held = self.held[done:]

    def finish(self) -> list[int]:
        if not self.held:
            return []
        parts, self.held = list(self.held), ""
        parts[-1] += self.t.suffix
        return [self.t.vocab[x] for x in self.t.merged(parts)]


class BpeCodec:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, spec: dict, library=None, library_merges: bool = False):
        model = spec["model"]
        kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if (
            model["type"] != "BPE"
            or not model.get("end_of_word_suffix")
            or kinds != ["NFC", "Replace", "Lowercase"]
            or [s["type"] for s in splits] != ["Split", "ByteLevel"]
            or splits[1]["use_regex"]
        ):
            raise ValueError("unsupported tokenizer layout")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.bytes = byte_alphabet()
        self.transducer = MergeTransducer(model["vocab"], merges, model["end_of_word_suffix"])
        self.split = regex.compile(splits[0]["pattern"]["Regex"])
        self.plain_split = re.compile("\n|" + splits[0]["pattern"]["Regex"].replace(r"\p{L}", _class_of("L")).replace(r"\p{N}", _class_of("N")))
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or "(?!)")
        self.token_text = {i: t for t, i in {**model["vocab"], **self.specials}.items()}
        self.bytewise = (spec.get("decoder") or {}).get("type") == "ByteLevel"
        if library_merges:
            tokenize = library.model.tokenize
            self.ids_of = lambda symbols: [t.id for t in tokenize(symbols)]
        else:
            self.ids_of = self.transducer.piece
        self.pieces = Known(lambda symbols: packed_ids(self.ids_of(symbols)))
        self._forget()
        self.words = Known(self._word)
        self.latin = {b: c for b, c in enumerate(self.bytes) if chr(b) != c}
        self.spelling = self._spellings()
        self.library = library

    @classmethod
    def from_file(cls, path: str, library_merges: bool = False) -> BpeCodec:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            return cls(json.load(f), Tokenizer.from_file(path), library_merges)

    # Encoding

    def _symbols(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece
        return piece.encode().decode("latin-1").translate(self.latin)

    def _normal(self, text: str) -> str:
        # One character at a time: a final sigma stays a plain one.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def _word(self, word: str) -> bytes:
        """Packed ids of a stretch without white space."""
        if word.isascii():
            # Letters with at most one sign behind them need no pattern.
            if word.isalpha():
                return self.pieces[word.lower()] if len(word) <= LONG_WORD else self._plain(word)
            if word[:-1].isalpha() and word[-1] in ".,;:!?" and len(word) <= LONG_WORD:
                return self.pieces[word[:-1].lower()] + self.pieces[word[-1]]
        parts, at = [], 0
        if "<|" in word:
            for m in self.special_at.finditer(word):
                parts += [self._plain(word[at : m.start()]), packed_ids([self.specials[m.group()]])]
                at = m.end()
        parts.append(self._plain(word[at:]))
        return b"".join(parts)

    def _plain(self, word: str) -> bytes:
        if not word:
            return b""
        if len(word) > LONG_WORD:
            return b"".join(self._long(word))
        if not _PLAIN.fullmatch(word) and self.library is not None:
            # The library's own tables decide about rare characters.
            normal = self.library.normalizer.normalize_str(word)
            return b"".join([self.pieces[p] for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)])
        normal = self._normal(word)
        symbols = [normal] if normal.isalpha() else self.split.findall(normal)
        return b"".join([self.pieces[self._symbols(p)] for p in symbols])

    def _long(self, word: str) -> Iterator[bytes]:
        """A very long stretch, read in parts; a run of letters or signs may span parts."""
        run, kind, rest = None, "", ""
        for part, last in self._parts(word):
            text = rest + self._normal(part)
            rest = ""
            for m in self.split.finditer(text):
                piece, at_end = m.group(), m.end() == len(text) and not last
                now = "L" if regex.match(r"\p{L}", piece) else "N" if regex.match(r"\p{N}", piece) else "O"
                whole = now == "N" or len(piece) > 1 and piece[0] == "'" and piece[1].isalpha()
                if run is not None and m.start() == 0 and now == kind and not whole:
                    yield packed_ids(run.feed(self._symbols(piece)))
                elif run is not None and m.start() == 0 and kind == "O" and piece[0] == "'":
                    # Inside a run of signs an apostrophe is one more sign.
                    yield packed_ids(run.feed("'"))
                    yield packed_ids(run.finish())
                    run = None
                    yield from (self.pieces[self._symbols(p)] for p in self.split.findall(piece[1:]))
                    continue
                else:
                    if run is not None:
                        yield packed_ids(run.finish())
                        run = None
                    if at_end and piece[0] == "'" and len(piece) < 3:
                        rest = piece
                        break
                    if whole:
                        yield self.pieces[self._symbols(piece)]
                        continue
                    run, kind = PieceRun(self.transducer), now
                    yield packed_ids(run.feed(self._symbols(piece)))
                if not at_end:
                    yield packed_ids(run.finish())
                    run = None
        if run is not None:
            yield packed_ids(run.finish())

    def _parts(self, word: str) -> Iterator[tuple[str, bool]]:
        """Parts that normalise alone: each but the first starts with a letter that joins nothing."""
        at = 0
        while at < len(word):
            end = at + LONG_WORD
            while end < len(word) and not word[end].isascii() and (
                word[end] in joining() or unicodedata.combining(word[end]) or unicodedata.decomposition(word[end])
            ):
                end += 1
            yield word[at:end], end >= len(word)
            at = end

    def chunks(self, text: str) -> Iterator[list[bytes]]:
        """Packed ids of each word, stretch by stretch."""
        for words in stretches(text):
            yield list(map(self.words.__getitem__, words))

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join([b"".join(c) for c in self.chunks(text or "")]), "<u4")

    def encode_batch(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a string array.

        Plain texts are cut into words by Arrow, and each different word of the batch is split into pieces
        once; pieces are remembered, up to a bound. All other texts go the way of :meth:`encode`.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = pc.invert(pc.match_substring_regex(texts, _NOT_PLAIN))
        cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.filter(plain)))
        words = cut.flatten().dictionary_encode()
        if (pc.max(pc.binary_length(words.dictionary)).as_py() or 0) > LONG_WORD:
            return [self.encode(t) for t in texts.to_pylist()]
        ids, ends = self._ids_of_words(words.dictionary)
        numbers = words.indices.to_numpy()
        each = np.diff(ends, prepend=0)
        sizes = each.take(numbers)
        word_ends = np.append(0, np.cumsum(sizes))
        at = np.repeat((ends - each).take(numbers) - word_ends[:-1], sizes)
        at += np.arange(word_ends[-1])
        flat = ids.take(at)
        ends, out, n = word_ends[cut.offsets.to_numpy()].tolist(), [], 0
        for k, easy in enumerate(plain.to_pylist()):
            out.append(flat[ends[n] : ends[n + 1]] if easy else self.encode(texts[k].as_py()))
            n += easy
        return out

    def _ids_of_words(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain words of moderate length, without special tokens, one word after another, and where each word's end.

        Letters with signs behind them need no pattern, and the same letters are looked up once.
        """
        if len(self.numbers) > 2 * KNOWN_WORDS:
            self._forget()
        known, cut = len(self.numbers), pc.extract_regex(words, _LETTERS_SIGNS)
        easy = cut.is_valid().to_numpy(zero_copy_only=False)
        letters, signs = (cut.field(k).filter(cut.is_valid()).dictionary_encode() for k in (0, 1))
        of_letters = self._numbers(self._normal("\n".join(letters.dictionary.to_numpy(zero_copy_only=False))).split("\n") if len(letters) else [])
        of_signs = self._numbers([x or "\n" for x in signs.dictionary.to_pylist()])
        of_others = self._numbers(self.plain_split.findall(self._normal("\n".join([*words.filter(pc.invert(cut.is_valid())).to_pylist(), ""]))))
        if len(self.numbers) > known:
            new = "\n".join(islice(self.numbers, known, None)).encode()
            for symbols in codecs.charmap_decode(new, "strict", "".join(self.bytes))[0].split(self.bytes[10]):
                self.piece_ids.extend(self.ids_of(symbols))
                self.piece_ends.append(len(self.piece_ids))
        # Pieces of a word: two, or all up to a line end.
        pieces = np.full(len(words), 2)
        pieces[~easy] = np.diff(np.flatnonzero(of_others == 0), prepend=-1)
        others = np.repeat(~easy, pieces)
        numbers = np.empty(len(others), np.int64)
        numbers[others] = of_others
        numbers[~others] = np.stack([of_letters.take(letters.indices), of_signs.take(signs.indices)], axis=1).ravel()
        ids = pa.LargeListArray.from_arrays(pa.array(np.array(self.piece_ends)), pa.array(np.array(self.piece_ids))).take(pa.array(numbers))
        return ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()[np.cumsum(pieces)]

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, pieces), np.int64, len(pieces))

    def _forget(self) -> None:
        # Piece number 0 is the line end behind each word; it has no ids.
        self.numbers, self.piece_ids, self.piece_ends = Numbers({"\n": 0}), array("I"), array("q", [0, 0])

    # Decoding

    def _spellings(self) -> list[bytes]:
        """By id: the UTF-8 of the token's text, or the bytes that it stands for."""
        back = {c: b for b, c in enumerate(self.bytes)}
        out = [b""] * (max(self.token_text) + 1)
        for i, t in self.token_text.items():
            out[i] = bytes(back[c] for c in t) if self.bytewise and t not in self.specials else t.encode()
        return out

    def decoder(self) -> BpeDecoder:
        return BpeDecoder(self)

    def decode(self, ids) -> str:
        out = self.decoder()
        return out.feed(np.asarray(ids, "<u4").tobytes()) + out.finish()


class BpeDecoder:
    """Ids in, text out: an incremental byte-to-text machine that holds at most three bytes."""

    def __init__(self, codec: BpeCodec):
        self.codec, self.started = codec, False
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed_bytes(self, packed: bytes) -> bytes:
        """Bytes of the next ids; token texts get blanks between them unless they are plain bytes."""
        spelled = map(self.codec.spelling.__getitem__, memoryview(packed).cast("I"))
        if self.codec.bytewise:
            return b"".join(spelled)
        data = b" ".join(spelled)
        if data and self.started:
            data = b" " + data
        self.started = self.started or bool(data)
        return data

    def feed(self, packed: bytes) -> str:
        return self.machine.decode(self.feed_bytes(packed))

    def finish(self) -> str:
        return self.machine.decode(b"", True)


def codec(path: str, library_merges: bool = False) -> BpeCodec:
    """The codec of a file on this worker; loaded once per Python process.

    With ``library_merges`` the library's model merges the pieces of words up to ``LONG_WORD``
    characters; the transducer still streams longer words.
    """
    return per_worker(("codec", path, library_merges), lambda: BpeCodec.from_file(path, library_merges), "tables")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Encode and decode every text; per row the id, ``n_tokens`` and digests of ids and decoded text.

    ``with_text`` adds ``ids`` (array of int) and ``decoded`` (string), which then hold the whole
    document; without it nothing longer than one stretch is kept. Other columns are not read. Null
    ids stay null; repeated rows give repeated results.
    """
    schema = f"{id_col} bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_text:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                n, ids_sha, text_sha, decoder = 0, hashlib.sha256(), hashlib.sha256(), own.decoder()
                all_ids, all_text = [], []
                for packed in own.chunks(text):
                    data = b"".join(packed)
                    n += len(data) // 4
                    ids_sha.update(data)
                    spelled = decoder.feed(data)
                    text_sha.update(spelled.encode())
                    if with_text:
                        all_ids.append(data)
                        all_text.append(spelled)
                end = decoder.finish()
                text_sha.update(end.encode())
                row = [n, ids_sha.hexdigest(), text_sha.hexdigest()]
                if with_text:
                    row += [np.frombuffer(b"".join(all_ids), "<u4").astype(np.int32), "".join(all_text) + end]
                rows.append(row)
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            cols = list(zip(*rows)) or [[] for _ in range(5 if with_text else 3)]
            arrays = [pa.array(c, t) for c, t in zip(cols, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *arrays], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: len(arrays) + 1])

    return docs.select(F.col(id_col).cast("bigint").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)
