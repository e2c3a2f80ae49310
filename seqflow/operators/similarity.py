"""Similarity search as a shared-word join, and scores from its hits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from seqflow.functions import sequences as S
from seqflow.operators.ordered import join_on
from seqflow.operators.wordscan import shared_words, small_side
from seqflow.session import materialize

DEFAULT_K = 7
BROADCAST_WORDS = 1_000_000
CLASS = ["c1", "c2", "c3"]


def _repeated(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of more than one row."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*keys)


class WordIndex:
    """The words of a target set: ``targets(by..., target, seq)`` and ``postings(by..., word, target)``, distinct.

    Postings are made where they are used, in the plan that uses them; what is stored is the texts, whose
    words take several times their room.
    """

    def __init__(self, targets: DataFrame, k: int, by: Sequence[str] = ()):
        self.targets, self.k, self.by = targets, k, list(by)
        self._repeated: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        return self._postings(self.targets)

    def _postings(self, targets: DataFrame) -> DataFrame:
        """``explode_outer`` keeps the optimizer from adding a filter that would evaluate the word extraction a second time."""
        rows = targets.select(*self.by, "target", F.explode_outer(S.kmers("seq", self.k)).alias("word"))
        return rows.where(F.col("word").isNotNull()).distinct()

    def _parts(self) -> tuple[DataFrame, DataFrame | None]:
        """The targets of one row, and, if there are any, the rows of targets of several, whose words are merged."""
        keys = [*self.by, "target"]
        if self._repeated is None:
            self._repeated = materialize(_repeated(self.targets, keys), "repeated-targets")
        if self._repeated.isEmpty():
            return self.targets, None
        return (join_on(self.targets, self._repeated, keys, "left_anti"),
                join_on(self.targets, self._repeated, keys, "left_semi"))

    def classes(self) -> tuple[DataFrame, DataFrame]:
        """Words grouped into classes with equal target lists.

        ``words(by..., word, c1, c2, c3)`` has one row per distinct word;
        ``members(by..., c1, c2, c3, target)`` says which targets a class stands
        for. A class is named by the number of its targets and an order-free
        128-bit fingerprint of them (xor of two independent hashes; the postings
        are distinct, so none cancels), which partial aggregation can build, so
        no target list is ever collected. A word that every target holds is still
        one row of ``words``.
        """
        t = F.col("target")
        keys = [*self.by, "word"]
        words = self.postings.groupBy(*keys).agg(F.bit_xor(F.xxhash64(t)).alias("c1"),
                                                 F.bit_xor(F.xxhash64(F.lit(1), t)).alias("c2"),
                                                 F.count(F.lit(1)).alias("c3"))
        members = self.postings.join(words, keys).select(*self.by, *CLASS, "target").distinct()
        return words, members


def build_index(targets: DataFrame, id_col: str = "id", seq_col: str = "seq", k: int = DEFAULT_K,
                by: Sequence[str] = (), store: bool = False) -> WordIndex:
    """Build once, search many times; ``by`` keeps several target sets apart.

    ``store`` writes the targets out, for use by more than one search.
    """
    rows = targets.select(*by, F.col(id_col).alias("target"), F.col(seq_col).alias("seq"))
    return WordIndex(materialize(rows, "index") if store else rows, k, by)


def _residues(rows: DataFrame, seq_col: str) -> int:
    return rows.agg(F.sum(F.length(seq_col))).first()[0] or 0


def search(queries: DataFrame, index: WordIndex, id_col: str = "id", seq_col: str = "seq",
           few_queries: bool = False) -> DataFrame:
    """``(by..., query, target, shared, fident)`` for every pair sharing a word.

    ``shared`` counts distinct common words, ``fident`` divides it by the query's distinct words.
    If the targets have at most ``BROADCAST_WORDS`` residues, their words are broadcast and a task looks
    up the words of its queries; words are never rows then. ``few_queries`` says the queries may be the
    small side: their residues are counted, and their words travel to the targets.

    Otherwise each query word matches at most one class row; hits are counted per (query, class) before
    classes open up to targets, so words common to many targets do not multiply rows early.
    """
    by = index.by
    if few_queries and _residues(queries, seq_col) <= BROADCAST_WORDS:
        hits = _search_targets(queries, index, id_col, seq_col)
    elif _residues(index.targets, "seq") <= BROADCAST_WORDS:
        hits = _search_queries(queries, index, id_col, seq_col)
    else:
        hits = _search_classes(queries, index, id_col, seq_col)
    return hits.select(*by, "query", "target", "shared", (F.col("shared") / F.col("n_words")).alias("fident"))


def _query_words(queries: DataFrame, index: WordIndex, id_col: str, seq_col: str) -> DataFrame:
    words = queries.select(*index.by, F.col(id_col).alias("query"), S.kmers(seq_col, index.k).alias("_w"))
    # The size is taken before the explode, or each word row would carry the array.
    sized = words.select(*index.by, "query", F.size("_w").alias("n_words"), "_w")
    return sized.select(*index.by, "query", "n_words", F.explode_outer("_w").alias("word"))


def _search_targets(queries: DataFrame, index: WordIndex, id_col: str, seq_col: str) -> DataFrame:
    """Few queries: their words travel to the targets."""
    keys = [*index.by, "query", "target"]

    def joined(targets: DataFrame) -> DataFrame:
        words = F.broadcast(_query_words(queries, index, id_col, seq_col))
        found = index._postings(targets).join(words, [*index.by, "word"])
        return found.groupBy(*keys).agg(F.count(F.lit(1)).alias("shared"), F.max("n_words").alias("n_words"))

    side = small_side(queries, index.by, id_col, seq_col, index.k)
    if side is None:
        return joined(index.targets)
    once, more = index._parts()
    hits = shared_words(once, index.by, "target", "seq", side, "query", "target",
                        queries.schema[id_col].dataType.simpleString(), count_large=False)
    if side.repeated:
        hits = _one_per_pair(hits, index.by)
    return hits if more is None else hits.unionByName(joined(more))


def _search_queries(queries: DataFrame, index: WordIndex, id_col: str, seq_col: str) -> DataFrame:
    """Few targets: their words travel to the queries."""
    by = index.by
    words = index._parts()[1]
    side = None if words is not None else small_side(index.targets, by, "target", "seq", index.k)
    if side is None:
        return _search_classes(queries, index, id_col, seq_col)
    found = shared_words(queries, by, id_col, seq_col, side, "target", "query",
                         index.targets.schema["target"].dataType.simpleString(), count_large=True)
    if materialize(_repeated(queries, [*by, id_col]), "repeated-queries").isEmpty():
        return found
    return _one_per_pair(found, by)


def _one_per_pair(hits: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows of one query id count together."""
    return hits.groupBy(*by, "query", "target").agg(F.sum("shared").alias("shared"), F.max("n_words").alias("n_words"))


def _search_classes(queries: DataFrame, index: WordIndex, id_col: str, seq_col: str) -> DataFrame:
    """Two large sides: an equi-join of words with classes of words."""
    by = index.by
    class_words, members = index.classes()
    exploded = _query_words(queries, index, id_col, seq_col)
    per_class = (exploded.join(class_words, [*by, "word"]).groupBy(*by, "query", *CLASS)
                 .agg(F.count(F.lit(1)).alias("n"), F.max("n_words").alias("n_words")))
    found = per_class.join(members, [*by, *CLASS])
    return found.groupBy(*by, "query", "target").agg(F.sum("n").cast("bigint").alias("shared"), F.max("n_words").alias("n_words"))


def top_hits(queries: DataFrame, index: WordIndex, n: int, shares: Sequence[float] = (0.8, 0.5, 0.3),
             id_col: str = "id", seq_col: str = "seq") -> DataFrame:
    """``(by..., query, target, shared, fident, pos)``: the ``n`` targets that share most words with each query.

    Only targets with at least the last of ``shares`` of the query's distinct words count; ties go by
    target. Queries of at most ``BROADCAST_WORDS`` residues travel to the targets, as in ``search``, and
    only pairs with that share leave the task. With more queries, the others are never paired: a target
    that shares ``t`` of a query's ``w`` words holds one of any ``w - t + 1`` of them, so only the postings
    of that many of its rarest words are looked up, and what they name is counted exactly. It starts with the highest share, where few and rare
    words do; a query that has ``n`` targets at one share is complete and leaves the search.
    """
    by = index.by
    keys = [*by, "query"]
    if _residues(queries, seq_col) <= BROADCAST_WORDS:
        least = F.greatest(F.lit(1), F.ceil(F.col("n_words") * F.lit(shares[-1])))
        found = _search_targets(queries, index, id_col, seq_col).where(F.col("shared") >= least)
        return _best_hits(found, n, keys)
    words = _query_words(queries, index, id_col, seq_col)
    words = materialize(words.where(F.col("word").isNotNull()), "query-words")
    # Only postings of the queries' words are kept; the join reaches below the index's own aggregation.
    postings = materialize(index.postings.join(words.select(*by, "word").distinct(), [*by, "word"], "left_semi"), "postings")
    spread = postings.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("df"))
    rarity = W.partitionBy(*keys).orderBy(F.coalesce("df", F.lit(0)), "word")
    words = materialize(words.join(spread, [*by, "word"], "left").withColumn("rank", F.row_number().over(rarity)), "ranked-words")
    found = None
    left = words
    for share in shares:
        least = F.greatest(F.lit(1), F.ceil(F.col("n_words") * F.lit(share)))
        rare = left.where((F.col("rank") <= F.col("n_words") - least + 1) & F.col("df").isNotNull())
        pairs = rare.select(*keys, "word").join(postings, [*by, "word"]).select(*keys, "target").distinct()
        asked = left.where("df IS NOT NULL").select(*keys, "word", "n_words", least.alias("least"))
        counted = pairs.join(asked, keys).join(postings, [*by, "word", "target"], "left_semi")
        hits = counted.groupBy(*keys, "target").agg(F.count(F.lit(1)).alias("shared"), F.first("n_words").alias("n_words"),
                                                    F.first("least").alias("least"))
        hits = materialize(hits.where(F.col("shared") >= F.col("least")).drop("least"), "hits")
        full = materialize(hits.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= n).select(*keys), "complete")
        last = share == shares[-1]
        kept = hits if last else hits.join(full, keys, "left_semi")
        found = kept if found is None else found.unionByName(kept)
        left = left.join(full, keys, "left_anti")
    return _best_hits(found, n, keys)


def _best_hits(found: DataFrame, n: int, keys: list[str]) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.col("shared").desc(), "target")
    ranked = found.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= n)
    return ranked.select(*keys, "target", "shared", (F.col("shared") / F.col("n_words")).alias("fident"), "pos")


def mean_scores(hits: DataFrame, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean score per query."""
    return hits.groupBy(*by, "query").agg(F.avg(score).alias("avg_score"))


def attach_scores(cand: DataFrame, scores: DataFrame, id_col: str = "id", default: float = 0.0,
                  by: Sequence[str] = ()) -> DataFrame:
    """Add ``reward`` (float); a candidate without a score gets the default."""
    right = scores.select(*by, F.col("query").alias(id_col), "avg_score")
    joined = cand.join(right, [*by, id_col], "left")
    return joined.withColumn("reward", F.coalesce("avg_score", F.lit(default)).cast("float")).drop("avg_score")


def best_average_scores(hits: DataFrame, seqs: DataFrame, score: str, id_col: str = "id",
                        seq_col: str = "seq") -> DataFrame:
    """Sequences with their mean hit score, highest first, ties by id."""
    scores = mean_scores(hits, score).withColumnRenamed("query", id_col)
    return (scores.join(seqs.select(id_col, seq_col), id_col)
            .orderBy(F.col("avg_score").desc(), id_col))


def score_stats(hits: DataFrame, score: str, by: Sequence[str] = (), owners: DataFrame | None = None) -> DataFrame:
    """min / max / mean hit score of a round.

    ``owners`` gives queries (``query``, once or more) the ``by`` columns that the hits lack. The hits of
    a query become one row ahead of that join, which would sort every hit otherwise.
    """
    if owners is None:
        return hits.groupBy(*by).agg(F.min(score).alias("min"), F.max(score).alias("max"),
                                     F.avg(score).alias("mean"))
    each = hits.groupBy("query").agg(F.min(score).alias("_min"), F.max(score).alias("_max"), F.sum(score).alias("_sum"),
                                     F.count(score).alias("_n"))
    return each.join(owners.select("query", *by), "query").groupBy(*by).agg(
        F.min("_min").alias("min"), F.max("_max").alias("max"), (F.sum("_sum") / F.nullif(F.sum("_n"), F.lit(0))).alias("mean"))


def keep_listed(records: DataFrame, ids: DataFrame, id_col: str = "id", by: Sequence[str] = ()) -> DataFrame:
    """Records whose id is in the list."""
    keys = [*by, id_col]
    return records.join(ids.select(*keys), keys, "left_semi")


def round_records(seqs: DataFrame, distances: DataFrame, hits: DataFrame, wild_type: Column,
                  score: str, round_no: int, id_col: str = "id", seq_col: str = "seq",
                  by: Sequence[str] = ()) -> DataFrame:
    """One record per sequence: mean hit score, distances to the inputs,
    substitutions against the wild type."""
    keys = [*by, id_col]
    scores = mean_scores(hits, score, by).withColumnRenamed("query", id_col)
    # What is taken from the sequence is taken ahead of the joins: it travels only if the caller keeps it.
    own = seqs.select(*keys, seq_col).withColumn("_wt", wild_type).select(
        *keys, seq_col, F.length(seq_col).alias("length"), S.substitutions(seq_col, "_wt").alias("substitutions"))
    rows = own.join(distances.select(*keys, "min_cos", "min_l2"), keys, "left").join(scores, keys, "left")
    return rows.select(F.lit(round_no).alias("round"), *keys, seq_col, "length",
                       F.col("avg_score").alias("mean_score"), "min_cos", "min_l2", "substitutions")
