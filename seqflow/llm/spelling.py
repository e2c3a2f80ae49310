"""Spelling variants by finite-state composition.

Two words are near if one inserted, deleted or replaced letter turns one into the
other: the pair is accepted by ``vocabulary o one-edit transducer o vocabulary``.
The composition is run in partitions, each with an initial state of its own: the
state that the acceptor has after a shared head. With the edit behind the first
three letters, both words have the same three letters ahead of it and meet in the
partition of that head. With the edit within them, both have the same rest and
meet in the partition of that tail. A partition builds the minimal acceptor of its
middles, composes it with the transducer and itself and enumerates what is accepted.

A partition with too many letters is split, as often as needed: the edit lies in
the first half of the middle, and then its second half is shared, or the other way
round. Middles shrink to one letter, where a partition holds no more words than the
alphabet has letters, so no head however frequent fills a task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqflow.llm.rows import stored
from seqflow.llm.texts import map_texts, utf8

_RUN = re.compile("[a-zÀ-ÿ]+")
HEAD = 3                    # letters that a first partition shares
PARTITION_LETTERS = 200_000  # a partition with more letters in its middles is split
HELD_WORDS = 200_000        # counts a task holds before it passes them on
_PARTITION = ["ell", "head", "tail"]


# Words ------------------------------------------------------------------------------------------

def text_words(doc_id: int | None, text: bytes, slip: int) -> Counter:
    """Words of a text with their counts; a run whose checksum ``slip`` divides loses one letter."""
    runs = Counter(_RUN.findall(text.lower().decode("utf-8", "replace")))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % slip == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1:]
        out[run] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 6,
               occurrences: int = 5, slip: int = 199) -> DataFrame:
    """``word, n``: the words of at least that many letters and occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                for w, n in text_words(i, t, slip).items():
                    if len(w) >= letters:
                        held[w] += n
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    source = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    counts = map_texts(source, ["doc_id", "text"], run, "word string, n bigint")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


# Automata ---------------------------------------------------------------------------------------

class Acceptor:
    """The minimal acyclic automaton of sorted distinct words.

    ``arcs[s]`` leads from state ``s`` by letter, ``final[s]`` tells whether a word ends there, and
    ``span[s]`` is the least and largest number of letters from there to an end.
    """

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = [{}]
        self.final = [False]
        self.span: list[tuple[int, int]] = [(0, 0)]
        known: dict[tuple, int] = {}
        path = [0]   # states of the latest word, not merged yet
        last = ""
        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            self._merge(path, last, same, known)
            for c in word[same:]:
                self.arcs.append({}), self.final.append(False), self.span.append((0, 0))
                self.arcs[path[-1]][c] = len(self.arcs) - 1
                path.append(len(self.arcs) - 1)
            self.final[path[-1]] = True
            last = word
        self._merge(path, last, 0, known)
        self._measure(0)

    def _measure(self, s: int) -> None:
        spans = [self.span[t] for t in self.arcs[s].values()]
        shortest = min([a + 1 for a, _ in spans] + [0] * self.final[s], default=0)
        self.span[s] = (shortest, max([b + 1 for _, b in spans], default=0))

    def _merge(self, path: list[int], word: str, keep: int, known: dict[tuple, int]) -> None:
        """States of ``path`` beyond ``keep`` get no further arcs: equal ones become one."""
        while len(path) > keep + 1:
            s = path.pop()
            mark = (self.final[s], tuple(self.arcs[s].items()))
            if mark in known:
                self.arcs[path[-1]][word[len(path) - 1]] = known[mark]
            else:
                known[mark] = s
                self._measure(s)


def _shared_ends(m: Acceptor, p: int, q: int) -> Iterator[str]:
    """Every string that leads to an end from ``p`` and from ``q``."""
    stack, path = [(p, q, 0, "")], []
    while stack:
        p, q, depth, c = stack.pop()
        if m.span[p][0] > m.span[q][1] or m.span[q][0] > m.span[p][1]:
            continue
        if depth:
            del path[depth - 1:]
            path.append(c)
        if m.final[p] and m.final[q]:
            yield "".join(path)
        few, many = (m.arcs[p], m.arcs[q]) if len(m.arcs[p]) <= len(m.arcs[q]) else (m.arcs[q], m.arcs[p])
        for c in few:
            if c in many:
                stack.append((m.arcs[p][c], m.arcs[q][c], depth + 1, c))


def compose_one_edit(m: Acceptor) -> Iterator[tuple[str, str]]:
    """Pairs accepted by ``m o one edit o m``, each once: letters match up to the edit and behind it.

    Ahead of the edit both sides are in one state, as ``m`` is deterministic. Where a letter repeats,
    the first one counts as the deleted one.
    """
    stack, path = [(0, 0, "")], []
    while stack:
        s, depth, c = stack.pop()
        if depth:
            del path[depth - 1:]
            path.append(c)
        arcs = m.arcs[s]
        for (a, p), (b, q) in combinations(arcs.items(), 2):      # one letter replaced
            for end in _shared_ends(m, p, q):
                head = "".join(path)
                yield head + a + end, head + b + end
        for a, p in arcs.items():                                 # one letter deleted
            if not depth or a != c:
                for end in _shared_ends(m, p, s):
                    head = "".join(path)
                    yield head + a + end, head + end
        stack += [(t, depth + 1, a) for a, t in arcs.items()]


def _compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by partition and middle: one composition for each partition of two words or more."""
    found: list[tuple] = []
    key, members = None, {}

    def close() -> None:
        if len(members) > 1:
            _, head, tail = key
            for x, y in compose_one_edit(Acceptor(sorted(members))):
                one, other = sorted([(head + x + tail, members[x]), (head + y + tail, members[y])])
                found.append((*one, *other))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*found)) or [(), (), (), ()]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, [pa.string(), pa.int64()] * 2)], ["a", "n_a", "b", "n_b"])

    for b in batches:
        ell, head, tail, middle, n = (c.to_pylist() for c in b.columns)
        for k, m, count in zip(zip(ell, head, tail), middle, n):
            if k != key:
                close()
                key, members = k, {}
            members[m] = count
        if len(found) >= 10_000:
            yield flush()
    if key is not None:
        close()
    yield flush()


# Partitions -------------------------------------------------------------------------------------

def _part(ell: Column, head: Column, tail: Column, middle: Column) -> Column:
    return F.struct(ell.cast("int").alias("ell"), head.alias("head"), tail.alias("tail"), middle.alias("middle"))


def _first(text: Column, n: Column) -> Column:
    return text.substr(F.lit(1), n)


def _rest(text: Column, skip: Column) -> Column:
    return text.substr(skip + 1, F.length(text))


def _initial(words: DataFrame, head: int) -> DataFrame:
    """Each word by its head, and by its tail as the longer and as the shorter word of a pair.

    ``ell`` is the length of a pair's longer word, 0 where any length may meet.
    """
    w, none, size = F.col("word"), F.lit(""), F.length("word")
    at, less = F.lit(head), F.lit(head - 1)
    parts = F.array(_part(F.lit(0), _first(w, at), none, _rest(w, at)),
                    _part(size, none, _rest(w, at), _first(w, at)),
                    _part(size + 1, none, _rest(w, less), _first(w, less)))
    return words.select(F.explode(parts).alias("p"), "n").select("p.*", "n")


def _halved(rows: DataFrame) -> DataFrame:
    """The same words in partitions of half their middle, once for the edit in either half."""
    size = F.length("head") + F.length("middle") + F.length("tail")
    lengths = F.when(F.col("ell") == 0, F.array(size, size + 1)).otherwise(F.array("ell"))
    rows = rows.withColumn("ell", F.explode(lengths))
    piece = F.col("ell") - F.length("head") - F.length("tail")
    rows = rows.withColumn("behind", piece - F.floor(piece / 2)).withColumn("ahead", F.floor(piece / 2).cast("int"))
    middle, kept = F.col("middle"), (F.length("middle") - F.col("behind")).cast("int")
    parts = F.array(_part(F.col("ell"), F.col("head"), F.concat(_rest(middle, kept), F.col("tail")), _first(middle, kept)),
                    _part(F.col("ell"), F.concat(F.col("head"), _first(middle, F.col("ahead"))), F.col("tail"), _rest(middle, F.col("ahead"))))
    return rows.select(F.explode(parts).alias("p"), "n").select("p.*", "n")


def near_words(words: DataFrame, partition_letters: int = PARTITION_LETTERS, head: int = HEAD) -> DataFrame:
    """``a, n_a, b, n_b``: every unordered pair of words (``word, n``) one edit apart, once.

    Words are distinct and have at least ``2 * head`` letters.
    """
    rows = _initial(words, head)
    ready = []
    while True:
        letters = rows.groupBy(*_PARTITION).agg(
            F.sum(F.length("middle") + 1).alias("letters"), F.max(F.length("middle")).alias("longest"))
        large = stored(letters.where((F.col("letters") > partition_letters) & (F.col("longest") > 1)).select(*_PARTITION), "large-partitions")
        if large.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(large, _PARTITION, "left_anti"))
        rows = stored(_halved(rows.join(large, _PARTITION, "left_semi")), "halved-partitions")
    pairs = []
    for part in ready:
        dealt = part.select(*_PARTITION, "middle", "n").repartition(*_PARTITION).sortWithinPartitions(*_PARTITION, "middle")
        pairs.append(dealt.mapInArrow(_compose, "a string, n_a bigint, b string, n_b bigint"))
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root``: follow forms to the last. Every round doubles the steps taken.

    Counts rise fivefold with every form, so chains are short and have no loops.
    """
    far = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = far.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(far.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        far = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return far


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = 6, occurrences: int = 5,
                    times: int = 5, slip: int = 199, partition_letters: int = PARTITION_LETTERS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the texts' vocabulary.

    A word's form is its most frequent near word (ties: the smallest in code-point order) if that has
    at least ``times`` (two or more) its occurrences. Null and empty texts have no words, invalid UTF-8 separates
    words, a null id counts as an empty one in the checksum, repeated rows count as often as they
    occur. Other columns are not read; an empty table gives no rows. A text is held whole in one task.
    """
    if letters < 2 * HEAD or times < 2:
        raise ValueError(f"letters must be {2 * HEAD} or more, times 2 or more")
    words = stored(vocabulary(docs, id_col, text_col, letters, occurrences, slip), "vocabulary")
    pairs = stored(near_words(words, partition_letters), "near-words")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b")))
    near = both.groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("near"))).alias("top"))
    near = stored(near, "nearest-words")
    out = words.join(near, "word", "left")
    has_form = -F.col("top.less") >= times * F.col("n")
    out = stored(out.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has_form, F.col("top.near")).alias("form"),
                            F.when(has_form, -F.col("top.less")).alias("form_n")), "word-forms")
    roots = _roots(out.where("form IS NOT NULL"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
