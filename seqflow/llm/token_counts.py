"""Token counts by the whole-token shortcut.

Ahead of the job, every vocabulary string is encoded by itself; those that give
exactly one token are proved whole. In a text, a pre-token that is a whole token
counts one without any merging; only the others are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqflow.llm.bpe import Merger, Vocabulary
from seqflow.llm.texts import Memo, kept_in_worker, map_texts, utf8

COUNTS = "doc_id bigint, n_bytes bigint, n_tokens bigint"
CHUNKS = 200_000


class Costs(dict):
    """Tokens of a pre-token: 1 for whole tokens, a merged count for the rest."""

    def __init__(self, merger: Merger, whole: set[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.rest = Memo(lambda w: len(merger.encode_word(w)))

    def __missing__(self, word: str) -> int:
        return self.rest[word]


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row; null text counts as empty (no tokens).

    Special strings inside a text are special tokens.
    """
    merger = Merger(Vocabulary.read(vocabulary))
    # A vocabulary's size is fixed: some 50,000 strings.
    shared = docs.sparkSession.sparkContext.broadcast((merger.vocab, merger.whole_tokens()))

    def tools():
        vocab, whole = shared.value
        own = Merger(vocab)
        cost = Costs(own, whole)
        return own, Memo(lambda c: sum(map(cost.__getitem__, own.pre_tokens(c))), limit=CHUNKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunk_cost = kept_in_worker(("count", vocabulary), tools)
        for b in batches:
            texts = utf8(b.column(1))
            totals = [sum(1 if special else sum(map(chunk_cost.__getitem__, own.chunks(piece)))
                          for piece, special in own.pieces(t.decode())) for t in texts]
            yield pa.RecordBatch.from_arrays([
                b.column(0).cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array(totals, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_texts(source, ["doc_id", "text"], run, COUNTS)
