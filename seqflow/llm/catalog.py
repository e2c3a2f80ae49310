"""The queries of this package over the driver's tables, with SQL where it can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from seqflow.catalog.registry import Query
from seqflow.llm.decontaminate import contamination
from seqflow.llm.encode import encode
from seqflow.llm.exact_dedup import exact_dedup
from seqflow.llm.importance import resample
from seqflow.llm.licenses import license_report
from seqflow.llm.line_templates import drop_recurring_lines
from seqflow.llm.lm_trie import score_texts
from seqflow.llm.ngram_join import ngram_components
from seqflow.llm.periodic_runs import periodic_runs, repeated_tail
from seqflow.llm.secret_scan import count_kind, find_secrets, spans_text
from seqflow.llm.simhash import simhash_groups
from seqflow.llm.spelling import spelling_groups
from seqflow.llm.token_counts import count_tokens

LONG_TOKENS = 1024
#: Part of all documents that op6 samples.
SAMPLED_SHARE = 0.5

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        _queries[name] = fn
        if sql is not None:
            _sql[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LONG_TOKENS)


@query("op2_encode_decode")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), decoded=True)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[count_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
                        F.sha2(spans_text("base"), 256).alias("base_sha256"), spans_text("spans").alias("spans"))


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_PLAIN = (r"list_filter(regexp_split_to_array(" + LOWER + r", '[\x20\x09-\x0D]+'), lambda w: w != '')")

@query("op4_ngram_jaccard", f"""WITH RECURSIVE d AS (SELECT doc_id, {_PLAIN.format('text')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(b) AS component_id FROM n JOIN reach ON n.doc_id = reach.a GROUP BY 1, 2""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


@query("op6_importance")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), sharpness=None, share=SAMPLED_SHARE)


@query("op7_line_templates", r"""WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, regexp_replace(trim(regexp_replace(ls[i], '[ \t\r]+', ' ', 'g'), ' '),
    '[^ ]*[0-9][^ ]*', '<*>', 'g') AS shape FROM raw, LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
s AS (SELECT DISTINCT doc_id, shape, string_split(shape, ' ') AS w FROM l WHERE shape <> ''),
leaf AS (SELECT *, len(w) AS words, array_to_string(w[1:3], ' ') AS lead FROM s),
big AS (SELECT words, lead FROM leaf GROUP BY 1, 2 HAVING count(*) >= 10),
shapes AS (SELECT shape, w, words, lead, count(*) AS n FROM leaf JOIN big USING (words, lead) GROUP BY 1, 2, 3, 4),
tok AS (SELECT shape, words, lead, n, p, w[p] AS word FROM shapes, LATERAL (SELECT unnest(range(1, words + 1)) AS p)),
fixed AS (SELECT words, lead, p, word FROM tok GROUP BY 1, 2, 3, 4 HAVING sum(n) >= 10),
made AS (SELECT t.shape, t.n, t.words, string_agg(CASE WHEN f.word IS NOT NULL THEN t.word ELSE '<*>' END, ' ' ORDER BY t.p) AS tpl,
    sum(CASE WHEN f.word IS NOT NULL AND t.word <> '<*>' THEN 1 ELSE 0 END) AS constants,
    sum(CASE WHEN f.word IS NOT NULL AND t.word <> '<*>' AND t.p > 3 THEN 1 ELSE 0 END) AS behind
  FROM tok t LEFT JOIN fixed f USING (words, lead, p, word) GROUP BY 1, 2, 3),
good AS (SELECT shape, tpl FROM made WHERE constants >= words * 0.5 AND behind >= greatest(words - 3, 0) * 0.5),
often AS (SELECT tpl FROM good JOIN s USING (shape) GROUP BY tpl HAVING count(DISTINCT doc_id) >= 10),
gone AS (SELECT shape FROM good JOIN often USING (tpl)
  UNION SELECT shape FROM leaf WHERE words > 50 GROUP BY shape HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (shape IN (FROM gone)))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (shape NOT IN (FROM gone)), '')) AS kept_sha256
FROM l GROUP BY doc_id""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_recurring_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op8_lm_score")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


@query("op9_exact_dedup", f"""WITH t AS (SELECT doc_id, {LOWER.format('text')} AS norm FROM documents), g AS (
  SELECT doc_id, norm, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS n FROM t)
SELECT doc_id, keep_id, n::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


_WORDS = (r"list_filter(regexp_split_to_array(regexp_replace(" + LOWER + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'),"
          " ' '), lambda w: w != '')")

@query("op10_contamination", f"""WITH d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, unnest(list_transform(
    range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + least(13, len(w)) - 1], ' '))) AS gram
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM pos),
hits AS (SELECT g.doc_id, g.i, g.n, win.item FROM grams g JOIN win USING (gram, n)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (
  SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=repeated_tail)
    by_length = F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"),
                                                       (-r["period"]).alias("shorter")))
    top = found.withColumn("top", F.array_max(by_length))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                                                  r["period"].cast("string"), F.lit("\n")))
    return top.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("top.before")).alias("start"), F.col("top.length").alias("length"),
        (-F.col("top.shorter")).alias("period"), F.expr("1000 * top.length div -top.shorter").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_simhash")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


@query("op13_spelling")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
