"""Scoring texts with a bigram model kept in Elias-Fano tries.

Counts come from the training documents only. The model is cut into shards by a hash of the
word or of the word pair, so no word, however frequent, gathers in one task. A shard is one
byte string: level 1 has the shard's words; level 2 the contexts (half their hash, enough within a shard), monotone pointers to their
successors, and the successors as numbers relative to the words of the shard; each level is Elias-Fano coded,
with 8-bit quantised log probabilities. Its reader maps it into memory and looks up a successor
between the two pointers of its context.

A text's log probability is a sum over tokens of ``log p1(w)``, plus ``log a(context)`` for the
weight that the context leaves to unseen successors, plus, for a pair that was seen, what the pair
adds to that (absolute discounting, interpolated). Every term belongs to one shard: slices of texts send each
shard their words and pairs, counted per document, and get back the documents' sums in one row.
"""

from __future__ import annotations

import mmap
import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from seqflow.llm.elias_fano import EliasFano, gaps, squeeze, unsqueeze
from seqflow.llm.ngram_join import mix
from seqflow.llm.rows import release, stored
from seqflow.llm.texts import map_texts, offsets, plain_words, utf8

DISCOUNT = 0.75
SHARD_BYTES = 12 << 20
MERGE_PAIRS = 1 << 18  # that are added up at once, at least
LEVELS = 256  # of quantised log probabilities
#: The end of a text, which is also the context of its first word. No word hashes from an empty string.
END = np.uint64(xxhash.xxh3_64_intdigest(b""))
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)  # bits of a hash that pairs of one shard go without


def token_hashes(text: bytes) -> np.ndarray:
    """The hash of each word, then the end. Hashing costs less than remembering the hashes of words."""
    words = plain_words(text)
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes: sorted hashes have sorted shards."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def pair_key(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(first * _PAIR + second)


def _parts(sorted_hashes: np.ndarray, shards: int) -> dict[int, slice]:
    """Where the part of each shard that has any lies in sorted hashes."""
    shard = shard_of(sorted_hashes, shards)
    at = np.append(_new(shard), len(shard))
    return {int(shard[x]): slice(x, y) for x, y in zip(at, at[1:])}


def _new(*sorted_columns: np.ndarray) -> np.ndarray:
    """Places where a sorted run of equal rows begins."""
    if not len(sorted_columns[0]):
        return np.empty(0, np.int64)
    change = np.zeros(len(sorted_columns[0]), bool)
    change[0] = True
    for c in sorted_columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _slice_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens of each text, text, context, token) of all tokens of a slice. Each text ends, and the next begins, with END."""
    parts = [token_hashes(t) for t in texts]
    sizes = np.array([len(p) for p in parts])
    second = np.concatenate(parts)
    return sizes, np.repeat(np.arange(len(parts)), sizes), np.concatenate([[END], second[:-1]]), second


def _pairs(shards: int):
    """Pair counts of training texts, added up within slices: one row for each shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, _, first, second = _slice_tokens(utf8(b.column(0)))
            key, first, second, n = _add_up(first, second)
            parts = _parts(key, shards)
            yield pa.RecordBatch.from_arrays([
                pa.array(list(parts), pa.int32()), pa.array([_pair_blob(first[o], second[o], n[o]) for o in parts.values()], pa.binary())],
                ["shard", "blob"])
    return run


def _add_up(first: np.ndarray, second: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(key, first, second, count) of distinct pairs, by key. A pair counts ``n`` times, or once."""
    key = pair_key(first, second)
    order = np.argsort(key)
    at = _new(key[order])
    total = np.diff(np.append(at, len(key))) if n is None or not len(at) else np.add.reduceat(n[order], at)
    one = order[at]
    return key[one], first[one], second[one], total


def _pair_blob(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> bytes:
    order = np.argsort(first)
    return squeeze(gaps(first[order]), second[order], n[order])


def _joined(blobs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of all blobs, added up whenever as many have come as are held: copies don't stay."""
    held = [np.empty(0, np.uint64)] * 3
    come: list[tuple[np.ndarray, ...]] = []
    for blob in blobs:
        first, second, n = unsqueeze(blob.as_buffer())
        come.append((np.cumsum(first, dtype=np.uint64), second, n))
        if sum(len(p[0]) for p in come) > max(len(held[0]), MERGE_PAIRS):
            held, come = list(_together(held, come)), []
    return _together(held, come) if come else tuple(held)


def _together(held: list[np.ndarray], come: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    columns = [np.concatenate(c) for c in zip(held, *come)]
    come.clear()
    return _add_up(*columns)[1:]


def _merge(table: pa.Table) -> pa.Table:
    """All rows of a shard as one: distinct pairs in order of context."""
    first, second, n = _joined(table.column("blob"))
    return pa.table({"shard": table.column("shard")[:1],
                     "blob": pa.array([_pair_blob(first, second, n)], pa.binary())})


def _read_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, second, n = unsqueeze(blob)
    return np.cumsum(first, dtype=np.uint64), second, n.astype(np.int64)


def _tell_words(shards: int):
    """What each shard's pairs say about words, sent to the shard that a word belongs to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for source, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                first, second, n = _read_pairs(blob)
                words, at = np.unique(np.concatenate([first, second]), return_inverse=True)
                successors = np.bincount(at[:len(first)], minlength=len(words))
                counts = np.bincount(at[len(first):], weights=n, minlength=len(words)).astype(np.int64)
                parts = _parts(words, shards)
                yield pa.RecordBatch.from_arrays([
                    pa.array(list(parts), pa.int32()), pa.array(np.full(len(parts), source, np.int32)), pa.array(
                        [squeeze(gaps(words[o]), counts[o], successors[o]) for o in parts.values()], pa.binary())],
                    ["owner", "source", "blob"])
    return run


def _total_words(told: pa.Table) -> pa.Table:
    """Totals of a shard's words: one row to keep, and one back to every shard that told of them."""
    parts = [_read_pairs(x) for x in told.column("blob").to_pylist()]
    sizes = np.array([len(p[0]) for p in parts])
    words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([p[1].astype(np.int64) for p in parts])).astype(np.int64)
    t = np.bincount(at, weights=np.concatenate([p[2] for p in parts])).astype(np.int64)
    ends = offsets(sizes)
    blobs = [squeeze(gaps(p[0]), n[o], t[o]) for p, o in zip(parts, (at[x:y] for x, y in zip(ends, ends[1:])))]
    back = len(parts)
    return pa.table({
        "shard": pa.concat_arrays([*told.column("source").chunks, *told.column("owner")[:1].chunks]),
        "own": pa.array([False] * back + [True]), "blob": pa.array([*blobs, squeeze(gaps(words), n, t)], pa.binary()),
        "tokens": pa.array([0] * back + [int(n.sum())], pa.int64()), "words": pa.array([0] * back + [len(words)], pa.int64())})


def _lexicon(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words in order with their counts and numbers of successors."""
    parts = [_read_pairs(x) for x in rows.column("blob").to_pylist()] or [(np.empty(0, np.uint64),) * 3]
    words, n, t = (np.concatenate([p[k] for p in parts]) for k in range(3))
    order = np.argsort(words)
    return words[order], n[order].astype(np.int64), t[order].astype(np.int64)


def quantise(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each value, value of each code): codes at equal shares of the values."""
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(1)
    edges = np.unique(np.quantile(values, np.linspace(0, 1, LEVELS)))
    code = np.clip(np.searchsorted(edges, values, side="right") - 1, 0, len(edges) - 1)
    sums, n = np.bincount(code, weights=values, minlength=len(edges)), np.bincount(code, minlength=len(edges))
    return code.astype(np.uint8), np.where(n > 0, sums / np.maximum(n, 1), edges)


def build_shard(pairs: pa.Table, replies: pa.Table, own: pa.Table, tokens: int, vocabulary: int) -> bytes:
    """The byte string of a shard from its pairs, the totals of all words in them, and the words that belong to it."""
    known, count, successors = _lexicon(replies)
    if pairs.num_rows:
        first, second, n = _read_pairs(pairs.column("blob")[0].as_py())
    else:
        first = second = np.empty(0, np.uint64)
        n = np.empty(0, np.int64)
    a, b = np.searchsorted(known, first), np.searchsorted(known, second)
    p1 = (count[b] + 1) / (tokens + vocabulary + 1)
    gain = np.log10(1 + (n - DISCOUNT) / (DISCOUNT * successors[a] * p1))
    # Half hashes tell the pairs of one shard apart: its size is bounded, so a clash has odds of about 1 in 2**44.
    known = np.unique(known >> _HALF)
    contexts, own_context, each = np.unique(first >> _HALF, return_inverse=True, return_counts=True)
    pointers = offsets(each)
    # Successors rise within a context; a step of one universe per context makes the whole level rise.
    universe = np.uint64(max(1, len(known)))
    level = np.searchsorted(known, second >> _HALF).astype(np.uint64) + own_context.astype(np.uint64) * universe
    order = np.argsort(level)
    level = level[order]
    code, book = quantise(gain[order])
    own_words, own_n, own_t = _lexicon(own)
    parts = [EliasFano.encode(own_words), own_n.tobytes(), own_t.tobytes(),
             EliasFano.encode(known), EliasFano.encode(contexts), EliasFano.encode(pointers), EliasFano.encode(level),
             code.tobytes(), book.astype(np.float64).tobytes()]
    return struct.pack(f"<{len(parts)}Q", *map(len, parts)) + b"".join(parts)


class Shard:
    """Reads one shard from a memory map of its bytes."""

    PARTS = 9

    def __init__(self, blob: bytes | memoryview):
        self.file = tempfile.TemporaryFile()  # has no name, and goes with the task
        self.file.write(blob)
        self.file.flush()
        data = np.frombuffer(mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
        head = struct.calcsize(f"<{self.PARTS}Q")
        sizes = struct.unpack(f"<{self.PARTS}Q", data[:head].tobytes())
        ends = head + offsets(np.array(sizes))
        cut = [data[ends[k]:ends[k + 1]] for k in range(self.PARTS)]
        self.words, self.n, self.t = EliasFano(cut[0]), np.frombuffer(cut[1], np.int64), np.frombuffer(cut[2], np.int64)
        self.known, self.contexts, self.pointers, self.level = map(EliasFano, cut[3:7])
        self.code, self.book = cut[7], np.frombuffer(cut[8], np.float64)

    @staticmethod
    def _find(where: EliasFano, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, found) of each wanted number in a whole level."""
        if not where.n:
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = where.search(wanted, np.zeros(len(wanted), np.int64), np.full(len(wanted), where.n))
        at_in = np.minimum(at, where.n - 1)
        return at_in, (at < where.n) & (where[at_in] == wanted)

    def counts(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, number of successors) of words that belong to this shard; 0 if unknown."""
        at, found = self._find(self.words, words)
        if not self.words.n:
            return np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        return np.where(found, self.n[at], 0), np.where(found, self.t[at], 0)

    def gains(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """What a seen pair (of half hashes) adds to its text's log probability; 0 for others."""
        c, has = self._find(self.contexts, first)
        w, is_known = self._find(self.known, second)
        out = np.zeros(len(first))
        ask = np.flatnonzero(has & is_known)
        if len(ask):
            wanted = w[ask].astype(np.uint64) + c[ask].astype(np.uint64) * np.uint64(max(1, self.known.n))
            lo, hi = (self.pointers[c[ask] + k].astype(np.int64) for k in (0, 1))
            at = self.level.search(wanted, lo, hi)
            inside = at < hi
            hit = inside & (self.level[np.minimum(at, self.level.n - 1)] == wanted)
            out[ask[hit]] = self.book[self.code[at[hit]]]
        return out


def _ask(shards: int):
    """What each shard is asked about a slice of texts: words and pairs, with texts and numbers of times.

    A slice is named by its task and first row. Its ids and sizes travel with the questions to one of the shards.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        none = np.empty(0, np.uint64)
        for b in batches:
            sizes, doc, first, second = _slice_tokens(utf8(b.column(1)))
            asked = []
            for key in (second, pair_key(first, second)):
                order = np.argsort(key, kind="stable")  # by key, then text
                at = _new(key[order], doc[order])
                one = order[at]
                asked.append((key[one], one, np.diff(np.append(at, len(key))), _parts(key[one], shards)))
            (word, w, wn, in_w), (key, p, pn, in_p) = asked
            home = int(mix(np.uint64([row]))[0]) % shards
            ids = b.column(0)
            own = [ids.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64),
                   ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint64), sizes]
            to = sorted({home, *in_w, *in_p})
            blobs = []
            for s in to:
                part = in_w.get(s, slice(0, 0))
                start = _new(word[part])
                words = [gaps(word[part][start]), np.diff(np.append(start, len(word[part]))), doc[w[part]], wn[part]]
                part = in_p.get(s, slice(0, 0))
                start = _new(key[part])
                reach, one = np.diff(np.append(start, len(key[part]))), p[part][start]
                by = np.argsort(first[one], kind="stable")
                # The texts of a pair stay together while pairs are put in order of context.
                at = np.repeat(start[by] - offsets(reach[by])[:-1], reach[by]) + np.arange(len(key[part]))
                pairs = [gaps(first[one[by]] >> _HALF), second[one[by]] >> _HALF, reach[by], doc[p[part][at]], pn[part][at]]
                blobs.append(squeeze(*words, *pairs, *(own if s == home else [none] * 3)))
            yield pa.RecordBatch.from_arrays([
                pa.array(to, pa.int32()), pa.array(np.full(len(to), row)), pa.array(blobs, pa.binary())], ["shard", "row", "blob"])
            row += b.num_rows
    return run


def answer(model: pa.Table, asked: pa.Table, tokens: int, vocabulary: int) -> pa.Table:
    """One shard's share of the score, summed for each text of a slice; ids and sizes that came along go with it."""
    blobs = []
    shard = Shard(model.column("blob")[0].as_buffer()) if model.num_rows and asked.num_rows else None
    for blob in asked.column("blob").to_pylist():
        word, reach, at, times, first, second, reach2, at2, times2, *own = unsqueeze(blob)
        word, first = np.cumsum(word, dtype=np.uint64), np.cumsum(first, dtype=np.uint64)
        at, at2 = at.astype(np.int64), at2.astype(np.int64)
        n, t = shard.counts(word) if shard else (np.zeros(len(word), np.int64),) * 2
        base = np.log10((n + 1) / (tokens + vocabulary + 1))
        left = np.where(n > 0, np.log10(DISCOUNT * np.maximum(t, 1) / np.maximum(n, 1)), 0.0)
        gain = shard.gains(first, second) if shard else np.zeros(len(first))
        each, reach, reach2 = np.repeat, reach.astype(np.int64), reach2.astype(np.int64)
        docs = int(max(at.max(initial=-1), at2.max(initial=-1))) + 1
        told = np.flatnonzero(np.bincount(np.concatenate([at, at2]), minlength=docs))
        base_sum, known, score = (
            np.bincount(at, weights=each(base, reach) * times, minlength=docs)[told],
            np.bincount(at, weights=each(n > 0, reach) * times, minlength=docs)[told],
            (np.bincount(at, weights=each(base + left, reach) * times, minlength=docs)
             + np.bincount(at2, weights=each(gain, reach2) * times2, minlength=docs))[told])
        blobs.append(squeeze(told, *(c.astype(np.float64).view(np.uint64) for c in (base_sum, score)), known, *own))
    return pa.table({"row": asked.column("row"), "blob": pa.array(blobs, pa.binary())})


SCORES = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def _sum_slice(told: pa.Table) -> pa.Table:
    """The scores of one slice of texts from what its shards told."""
    parts = [unsqueeze(x) for x in told.column("blob").to_pylist()]
    ids, null, sizes = next(p[4:] for p in parts if len(p[6]))
    base, score, known = np.zeros((3, len(ids)))
    for p in parts:
        at = p[0].astype(np.int64)  # distinct
        base[at] += p[1].view(np.float64)
        score[at] += p[2].view(np.float64)
        known[at] += p[3]
    return pa.table({"doc_id": pa.array(ids.view(np.int64), mask=null.astype(bool)), "n_tokens": pa.array(sizes.astype(np.int64)),
                     "n_known": pa.array(known.astype(np.int64)), "base_score": pa.array(base), "score": pa.array(score)})


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 7; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Trained on the rows that are not held out. A null or empty text is one token, its end. Rows that
    repeat an id are scored one by one; without training rows, no token is known.
    """
    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, -(-size // shard_bytes))
    train = source.where(~held_out(F.col("doc_id")))
    counted = map_texts(train, ["text"], _pairs(shards), "shard int, blob binary")
    pairs = stored(counted.groupBy("shard").applyInArrow(_merge, "shard int, blob binary"), "pair-counts")
    told = pairs.mapInArrow(_tell_words(shards), "owner int, source int, blob binary")
    words = stored(told.groupBy("owner").applyInArrow(
        _total_words, "shard int, own boolean, blob binary, tokens bigint, words bigint"), "words")
    tokens, vocabulary = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()

    def build(p: pa.Table, w: pa.Table) -> pa.Table:
        mask = w.column("own")
        shard = (w if w.num_rows else p).column("shard")[:1]
        blob = build_shard(p, w.filter(pc.invert(mask)), w.filter(mask), tokens, vocabulary)
        return pa.table({"shard": shard, "blob": pa.array([blob], pa.binary())})

    model = stored(pairs.groupBy("shard").cogroup(words.groupBy("shard")).applyInArrow(
        build, "shard int, blob binary"), "trie")
    release(pairs, words)
    asked = map_texts(source, ["doc_id", "text"], _ask(shards), "shard int, row bigint, blob binary")
    told = model.groupBy("shard").cogroup(asked.groupBy("shard")).applyInArrow(
        lambda m, a: answer(m, a, tokens, vocabulary), "row bigint, blob binary")
    return told.groupBy("row").applyInArrow(_sum_slice, SCORES).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(tokens).cast("bigint").alias("train_tokens"), "base_score", "score")
