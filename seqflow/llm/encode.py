"""Encoding texts into token ids, and ids back into text."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from seqflow.llm.bpe import Merger, Vocabulary
from seqflow.llm.texts import RecentMemo, kept_in_worker, list_array, map_texts, slices, utf8

#: Words and chunks that a worker remembers, twice over.
WORDS, CHUNKS = 200_000, 100_000


def _names(vocab: Vocabulary) -> dict[int, str]:
    return {i: t for t, i in (vocab.tokens | vocab.special).items()}


def _text(name: dict[int, str], ids: list[int] | None) -> str | None:
    try:
        return None if ids is None else " ".join(map(name.__getitem__, ids))
    except KeyError:
        return " ".join(name[i] for i in ids if i in name)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """``doc_id, ids``: the token ids of every row; null and empty texts give an empty list.

    Special strings inside a text are special tokens. ``decoded`` adds what ``decode`` makes of the ids, in the
    same pass and the same Python worker.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(vocabulary))  # of fixed size

    def tools():
        own = Merger(shared.value)
        special = {t: np.int32(i).tobytes() for t, i in own.vocab.special.items()}
        words = RecentMemo(lambda w: array("i", own.encode_word(w)).tobytes(), limit=WORDS)
        return own, special, RecentMemo(lambda c: b"".join(map(words.__getitem__, own.pre_tokens(c))), limit=CHUNKS), _names(own.vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, special, parts, name = kept_in_worker(("encode", vocabulary), tools)
        for b in batches:
            texts = [b"".join([special[piece] if is_special else b"".join(map(parts.__getitem__, own.chunks(piece)))
                               for piece, is_special in own.pieces(t.decode())]) for t in utf8(b.column(1))]
            ids = list_array(np.array([len(t) // 4 for t in texts]), pa.array(np.frombuffer(b"".join(texts), np.int32)))
            out = pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), ids], ["doc_id", "ids"])
            yield out.append_column("decoded", pa.array([
                _text(name, np.frombuffer(t, np.int32).tolist()) for t in texts], pa.string())) if decoded else out

    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return map_texts(source, ["doc_id", "text"], run, "doc_id bigint, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids: vocabulary strings one after another, special tokens included.

    A vocabulary file without a decoding rule sets one space between token strings, as the files with
    word ends do. Unknown and null ids give nothing; a null list gives a null text.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(_names(Vocabulary.read(vocabulary)))  # of fixed size
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield b.append_column(out, pa.array([_text(shared.value, i) for i in b.column(at).to_pylist()], pa.string()))

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(out, StringType())]))
