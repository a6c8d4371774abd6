"""Language of a text by unigram piece models, summed over all segmentations.

Each language has a probability for every piece of one fixed public vocabulary. A word's
probability is the sum over all ways to cut it into pieces of the product of their probabilities
(forward algorithm); a text's is the product over its words. The piece probabilities are fitted by
expectation maximisation with the same sums forwards and backwards, on the words of a bounded
sample of labelled rows: at most ``PER_LANGUAGE`` rows of each language.

Words are lower-cased runs of letters with the word-start mark of the vocabulary in front. Single
characters outside the vocabulary are pieces too: one shared class per language. Stretches of more than
``LONGEST`` characters are cut, so sums stay in range.

Null texts and texts without a letter are ``und`` with score 0. Without labelled rows every text
is ``und``. Ties go to the language that sorts first. Repeated rows give repeated results, very long texts are
scored whole, an empty table gives no rows. Other columns are not read; those carried along get names of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwire.llm.sample import carried, remainder, sample_ids
from bellwire.llm.state import Numbers, lean, per_worker
from bellwire.session import broadcast_if_small

LETTERS = re.compile(r"[^\W\d_]+")
PER_LANGUAGE, ROUNDS = 150, 4
LONGEST, KNOWN = 40, 1 << 19
_START = "▁"
#: Sums are kept times this to the power of the characters behind them: a stretch of LONGEST rare characters
#: stays above the smallest double, and one long piece below the largest.
_LIFT = 2.0**20


def vocabulary(path: str) -> dict[str, int]:
    """Lower-case pieces of letters with their numbers; number 0 is any other single character."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    good = sorted(p for p in pieces if p == p.lower() and (p == _START or LETTERS.fullmatch(p.removeprefix(_START))) and len(p) <= 16)
    return {p: i + 1 for i, p in enumerate(good)}


class PieceModel:
    """Piece probabilities per language (pieces x languages)."""

    def __init__(self, pieces: dict[str, int], languages: list[str], probs: np.ndarray):
        self.pieces, self.languages = pieces, languages
        sizes = np.ones(len(probs))
        sizes[list(pieces.values())] = [len(p) for p in pieces]
        self.lift = _LIFT ** sizes[:, None]
        self.teach(probs)
        self.longest = max(map(len, pieces), default=1)
        # Every beginning of a piece is a node, the empty one number 0, with the number of the piece or -1.
        nodes = {b: k for k, b in enumerate(dict.fromkeys(["", *(p[:n] for p in pieces for n in range(1, len(p) + 1))]))}
        self.piece_of = np.array([pieces.get(b, -1) for b in nodes], np.int32)
        self.letters = np.array(sorted({ord(c) for p in pieces for c in p}), np.uint32)
        # A step from a node by a letter is one number; steps are sorted, with the node behind each.
        ends = list(nodes)[1:]
        steps = np.array([nodes[b[:-1]] for b in ends], np.int64) * len(self.letters) + np.searchsorted(self.letters, np.array([ord(b[-1]) for b in ends], np.uint32))
        self.nodes = np.argsort(steps) + 1
        self.steps = steps[self.nodes - 1]
        self.numbers = Numbers()
        self.table = np.zeros((1024, len(languages)))

    def teach(self, probs: np.ndarray) -> None:
        self.probs, self.lifted = probs, probs * self.lift

    def _grid(self, words: list[str], size: int) -> np.ndarray:
        """Piece number of every stretch (end, length - 1, word); -1 where there is none."""
        grid = np.full((size + 1, min(self.longest, size), len(words)), -1, np.int32)
        if len(self.letters) and words:
            chars = np.array(words, f"<U{size}").view(np.uint32).reshape(len(words), size)
            letters = np.minimum(np.searchsorted(self.letters, chars), len(self.letters) - 1)
            letters[self.letters[letters] != chars] = -1
            # All stretches grow by one letter at a time, as long as they begin a piece.
            owner, start = (x.ravel() for x in np.indices(chars.shape))
            node = np.zeros(len(owner), np.int64)
            for length in range(1, grid.shape[1] + 1):
                inside = start + length <= size
                owner, start, node = owner[inside], start[inside], node[inside]
                letter = letters[owner, start + length - 1]
                step = node * len(self.letters) + letter
                at = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
                hit = (self.steps[at] == step) & (letter >= 0)
                owner, start, node = owner[hit], start[hit], self.nodes[at[hit]]
                number = self.piece_of[node]
                has = number >= 0
                grid[start[has] + length, length - 1, owner[has]] = number[has]
        grid[1:, 0] = np.maximum(grid[1:, 0], 0)
        return grid

    def forward(self, grid: np.ndarray) -> np.ndarray:
        """(size + 1, words, languages): summed probability of each beginning, lifted by its length."""
        ends, span, n = grid.shape
        out = np.zeros((ends, n, len(self.languages)))
        out[0] = 1.0
        for end in range(1, ends):
            for length in range(1, min(span, end) + 1):
                at = grid[end, length - 1]
                has = np.flatnonzero(at >= 0)
                if len(has):
                    out[end, has] += out[end - length, has] * self.lifted[at[has]]
        return out

    def expected(self, grid: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts of weighted words (words x languages), by forward and backward sums."""
        ends, span, n = grid.shape
        ahead = self.forward(grid)
        back = np.zeros_like(ahead)
        back[-1] = 1.0
        for end in range(ends - 1, 0, -1):
            for length in range(1, min(span, end) + 1):
                at = grid[end, length - 1]
                has = np.flatnonzero(at >= 0)
                if len(has):
                    back[end - length, has] += back[end, has] * self.lifted[at[has]]
        share = weight / ahead[-1]
        out = np.zeros_like(self.probs)
        for end in range(1, ends):
            for length in range(1, min(span, end) + 1):
                at = grid[end, length - 1]
                has = np.flatnonzero(at >= 0)
                if len(has):
                    np.add.at(out, at[has], ahead[end - length, has] * self.lifted[at[has]] * back[end, has] * share[has])
        return out

    def log_probs(self, words: list[str]) -> np.ndarray:
        """Log probability of each word under each language."""
        out = np.zeros((len(words), len(self.languages)))
        sizes: dict[int, list[tuple[int, str]]] = {}
        for i, word in enumerate(words):
            for at in range(0, len(word), LONGEST):
                part = (_START if at == 0 else "") + word[at : at + LONGEST]
                sizes.setdefault(len(part), []).append((i, part))
        for size, held in sizes.items():
            for lo in range(0, len(held), 4096):
                some = held[lo : lo + 4096]
                total = self.forward(self._grid([p for _, p in some], size))[-1]
                np.add.at(out, [i for i, _ in some], np.log(total) - size * np.log(_LIFT))
        return out

    def texts(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Summed log probabilities of each text, or None for one without a letter."""
        words = [LETTERS.findall((t or "").lower()) for t in texts]
        if len(self.numbers) > KNOWN:
            self.numbers = Numbers()
        known, ends = len(self.numbers), np.cumsum([0, *map(len, words)]).tolist()
        rows = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(words)), np.int64, ends[-1])
        self._learn(list(islice(self.numbers, known, None)))
        return [self.table[rows[lo:hi]].sum(axis=0) if hi > lo else None for lo, hi in zip(ends, ends[1:])]

    def _learn(self, new: list[str]) -> None:
        """Puts the words numbered last into the table."""
        at = len(self.numbers) - len(new)
        if len(self.numbers) > len(self.table):
            grown = np.zeros((max(2 * len(self.table), len(self.numbers)), len(self.languages)))
            grown[:at] = self.table[:at]
            self.table = grown
        self.table[at : at + len(new)] = self.log_probs(new)


def groups_by_size(texts: list[str | None], limit: int = 1 << 20) -> Iterator[list[str | None]]:
    """Runs of texts of about ``limit`` characters, so that new words are met many at a time."""
    held: list[str | None] = []
    size = 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def fit(counts: dict[str, dict[str, int]], pieces: dict[str, int], rounds: int = ROUNDS) -> PieceModel:
    """Expectation maximisation from equal probabilities; ``counts``: language -> word -> times."""
    languages = sorted(counts)
    start = np.full((len(pieces) + 1, len(languages)), 1.0 / (len(pieces) + 1))
    model = PieceModel(pieces, languages, start)
    sizes: dict[int, dict[str, np.ndarray]] = {}
    for k, language in enumerate(languages):
        for word, n in counts[language].items():
            for at in range(0, len(word), LONGEST):
                part = (_START if at == 0 else "") + word[at : at + LONGEST]
                sizes.setdefault(len(part), {}).setdefault(part, np.zeros(len(languages)))[k] += n
    grids = [(model._grid(list(w), size), np.array(list(w.values()))) for size, w in sizes.items()]
    for _ in range(rounds):
        seen = sum((model.expected(g, weight) for g, weight in grids), np.zeros_like(start)) + 0.01
        model.teach(seen / seen.sum(axis=0))
    return model


def training_words(docs: DataFrame, lang_col: str, id_col: str, text_col: str, per_language: int) -> dict[str, dict[str, int]]:
    """Word counts per language of the bounded sample; rows with remainder 1 of 3 are never read here."""
    labelled = docs.where(F.col(lang_col).isNotNull() & (remainder(id_col, 3) != 1))
    ids = sample_ids(labelled.select(id_col, lang_col), lang_col, per_language, None, id_col)
    # At most per_language ids of each language.
    rows = labelled.join(broadcast_if_small(ids.select(id_col)), id_col).select(F.col(lang_col).alias("lang"), F.lower(F.col(text_col)).alias("t"))
    words = rows.select("lang", F.explode(F.regexp_extract_all("t", F.lit(r"(\p{L}+)"), F.lit(1))).alias("w"))
    out: dict[str, dict[str, int]] = {}
    for lang, word, n in words.groupBy("lang", "w").count().toLocalIterator():
        out.setdefault(lang, {})[word] = n
    return out


def predict(
    docs: DataFrame,
    vocabulary_path: str,
    lang_col: str = "lang",
    id_col: str = "doc_id",
    text_col: str = "text",
    per_language: int = PER_LANGUAGE,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Per row: id, ``held_out`` (crc32 of the id modulo 3 is 1), ``lang_pred`` and its posterior ``score``.

    ``carry`` adds these columns unchanged, as ``_x0``, ``_x1``, ...
    """
    counts = training_words(docs, lang_col, id_col, text_col, per_language)
    model = fit(counts, vocabulary(vocabulary_path))
    languages = model.languages
    # Only pieces seen in some language differ from the rest; the model travels as one small array.
    shared = docs.sparkSession.sparkContext.broadcast((sorted(model.pieces, key=model.pieces.get), model.probs.astype(np.float32)))

    def load() -> PieceModel:
        pieces, probs = shared.value
        return PieceModel({p: i + 1 for i, p in enumerate(pieces)}, languages, probs.astype(np.float64))

    key = ("language", shared.id if hasattr(shared, "id") else id(shared), tuple(languages), float(model.probs.sum()), float((model.probs**2).sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = per_worker(key, load, "tables")
        for batch in batches:
            langs, scores = [], []
            totals = [x for group in groups_by_size(batch.column(2).to_pylist()) for x in own.texts(group)]
            for total in totals:
                if total is None or not languages:
                    langs.append("und")
                    scores.append(0.0)
                else:
                    best = int(total.argmax())
                    langs.append(languages[best])
                    scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            more = batch.columns[3:]
            names = [id_col, "held_out", "lang_pred", "score", *(f"_x{i}" for i in range(len(more)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *more], names=names)

    more, more_schema = carried(docs, list(carry))
    rows = docs.select(F.col(id_col).cast("bigint").alias(id_col), (remainder(id_col, 3) == 1).alias("held_out"), F.col(text_col).cast("string").alias(text_col), *more)
    return rows.mapInArrow(lambda batches: lean(run(batches)), f"{id_col} bigint, held_out boolean, lang_pred string, score double{more_schema}")
