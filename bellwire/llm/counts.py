"""Token counts: the library encodes batches inside Arrow functions, only lengths come back.

Texts are cut at white space, which this family of tokenizers drops, so the count of a text is the
sum over its words. Words met before are looked up in a bounded dictionary; the others go to the
library in batches of about equal bytes. Files of another layout get whole texts instead, packed
into batches by bytes.

Null texts count as empty: 0 bytes, 0 tokens. Other columns are not read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwire.llm.bpe import KNOWN_WORDS, LONG_WORD, BpeCodec, stretches
from bellwire.llm.state import per_worker

#: Bytes that go to the library at once.
BATCH_BYTES = 1 << 18


def batches_by_bytes(texts: Iterable[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Lists of texts with at most about ``limit`` bytes each; a longer text stands alone."""
    held, size = [], 0
    for text in texts:
        n = len(text) * (1 if text.isascii() else 3)
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append(text)
        size += n
    if held:
        yield held


class TokenCounter:
    """Lengths by the library, of whole texts."""

    def __init__(self, path: str):
        # The executor's cores are already shared out among its tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known: dict[str, int] = {}
        self.older: dict[str, int] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode, self.by_word = lambda texts: map(len, model.encode(texts, num_threads=1)), False
            return
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self._encode = lambda texts: map(len, tokenizer.encode_batch_fast(texts, add_special_tokens=False))
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        try:
            BpeCodec(spec)
            self.by_word = True
        except ValueError:
            self.by_word = False

    def lengths(self, texts: Iterable[str]) -> list[int]:
        return [n for batch in batches_by_bytes(texts) for n in self._encode(batch)]

    def count(self, text: str) -> int:
        if not self.by_word:
            return self.lengths([text])[0]
        return sum(self._sum(words) for words in stretches(text))

    def _sum(self, words: list[str]) -> int:
        known = self.known
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            missing = [w for w in set(words) if w not in known]
        if len(known) + len(missing) > KNOWN_WORDS:
            self.older, self.known = known, {}
            known, missing = self.known, list(set(words))
        older = [w for w in missing if w in self.older]
        known.update(zip(older, map(self.older.__getitem__, older)))
        new = [w for w in missing if w not in known]
        known.update(zip(new, self.lengths(new)))
        total = sum(map(known.__getitem__, words))
        for w in new:
            if len(w) > LONG_WORD:
                del known[w]
        return total


def counter(path: str) -> TokenCounter:
    return per_worker(("counter", path), lambda: TokenCounter(path), "tables")


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, ``n_bytes`` of UTF-8, ``n_tokens``, and ``over_limit`` (more than ``limit`` tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            n = pa.array([own.count(t.as_py() or "") for t in batch.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n], names=[id_col, "n_bytes", "n_tokens"])

    texts = docs.select(
        F.col(id_col).cast("bigint").alias(id_col),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes"),
        F.col(text_col).cast("string").alias(text_col),
    )
    counted = texts.mapInArrow(run, f"{id_col} bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
