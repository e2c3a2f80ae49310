"""Cleaning, encoding and statistics over ``documents`` and ``conversations``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqflow.catalog.registry import query, table
from seqflow.catalog.selection import r6
from seqflow.functions import sequences as S
from seqflow.operators import stats
from seqflow.operators.ordered import ordinal
from seqflow.sources.tables import spread

FIXED = 512
BUDGET = 4000

# JVM upper-casing maps the sharp s to SS; DuckDB leaves it alone.
CLEAN = f"regexp_replace(upper(replace(text, 'ß', 'ss')), '[^{S.ALPHABET}]', '', 'g')"
SEQS = f"seqs AS (SELECT doc_id, lang, source, {CLEAN} AS seq FROM documents)"
CODES = f"list_transform(range(1, length(seq) + 1), lambda i: strpos('{S.ALPHABET}', substr(seq, i, 1)) - 1)"


def seqs(spark: SparkSession, sf_dir: str, keep_empty: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    if not keep_empty:
        docs = docs.where(S.has_residue("text"))
    return spread(docs, "doc_id").select("doc_id", "lang", "source", S.clean("text").alias("seq"))


@query("seq_clean", f"WITH {SEQS} SELECT doc_id, seq FROM seqs WHERE length(seq) > 0")
def seq_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seqs(spark, sf_dir).select("doc_id", "seq")


@query("seq_fixed_len", f"""WITH {SEQS}
SELECT doc_id, rpad(substr(seq, 1, {FIXED}), {FIXED}, '{S.PAD}') AS seq FROM seqs WHERE length(seq) > 0""")
def seq_fixed_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq_clean(spark, sf_dir).select("doc_id", S.fixed_length("seq", FIXED).alias("seq"))


@query("seq_encode", f"""WITH {SEQS}, enc AS (SELECT doc_id, {CODES} AS ids FROM seqs WHERE length(seq) > 0)
SELECT doc_id, md5(array_to_string(ids, ',')) AS ids_md5, len(ids)::INTEGER AS n, list_sum(ids)::BIGINT AS id_sum
FROM enc""")
def seq_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = seq_clean(spark, sf_dir).select("doc_id", S.encode("seq").alias("ids"))
    total = F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return ids.select("doc_id", F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"),
                      F.size("ids").alias("n"), total.alias("id_sum"))


@query("seq_decode", f"""WITH {SEQS} SELECT doc_id, seq FROM seqs WHERE length(seq) > 0""")
def seq_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, then decode: the cleaned text must come back."""
    return seq_clean(spark, sf_dir).select("doc_id", S.decode(S.encode("seq")).alias("seq"))


@query("seq_headers", f"""WITH {SEQS}, o AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM seqs WHERE length(seq) > 0)
SELECT doc_id, ord, 'cand_t1_' || ord AS seq_id, 'gen_r1_' || ord AS gen_id FROM o""")
def seq_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordinal(seq_clean(spark, sf_dir).select("doc_id"), "doc_id")
    return rows.select("doc_id", "ord", F.format_string("cand_%s_%d", F.lit("t1"), "ord").alias("seq_id"),
                       F.format_string("gen_r%d_%d", F.lit(1), "ord").alias("gen_id"))


@query("token_lengths", f"""WITH {SEQS}, t AS (
  SELECT doc_id, seq, least(length(seq) + 2, {S.MAX_TOKENS}) AS n FROM seqs WHERE length(seq) > 0)
SELECT doc_id, n::INTEGER AS n_tokens,
  md5('{S.START_ID},' || array_to_string({CODES.replace('length(seq) + 1', 'n - 1')}, ',') || ',{S.END_ID}') AS ids_md5
FROM t""")
def token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq_clean(spark, sf_dir).select(
        "doc_id", S.n_tokens("seq").alias("n_tokens"),
        F.md5(F.array_join(S.tokenize("seq").cast("array<string>"), ",")).alias("ids_md5"))


@query("strip_special", f"""WITH c AS (
  SELECT conv_id, turn, regexp_replace(upper(replace(text, 'ß', 'ss')), '[^{S.ALPHABET}]', '', 'g') AS seq
  FROM conversations),
t AS (SELECT conv_id, turn, list_transform(range(1, least(length(seq), {S.MAX_TOKENS - 2}) + 1),
        lambda i: strpos('{S.ALPHABET}', substr(seq, i, 1)) - 1) AS ids FROM c)
SELECT conv_id, turn, array_to_string(list_append(ids, {S.END_ID}), ',') AS kept,
       array_to_string(ids, ',') AS residues FROM t""")
def strip_special(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", S.tokenize(S.clean("text")).alias("tokens"))
    kept, residues = S.strip_special("tokens"), S.strip_special("tokens", both=True)
    return turns.select("conv_id", "turn",
                        F.array_join(kept.cast("array<string>"), ",").alias("kept"),
                        F.array_join(residues.cast("array<string>"), ",").alias("residues"))


@query("seq_truncate_median", f"""WITH {SEQS}, s AS (SELECT * FROM seqs WHERE length(seq) > 0),
m AS (SELECT floor(quantile_cont(length(seq), 0.5))::INTEGER AS median FROM s)
SELECT doc_id, substr(seq, 1, median) AS seq FROM s, m""")
def seq_truncate_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seq_clean(spark, sf_dir)
    return stats.truncate_to(rows, stats.median_length(rows).scalar())


@query("drop_oversize", f"WITH {SEQS} SELECT doc_id, length(seq)::INTEGER AS n FROM seqs WHERE length(seq) <= {BUDGET}")
def drop_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.drop_oversize(seqs(spark, sf_dir, keep_empty=True), BUDGET).select("doc_id", F.length("seq").alias("n"))


WORDS = "regexp_replace(upper(replace(text, 'ß', 'ss')), '[\\s.,]', '', 'g')"


@query("drop_invalid", f"""WITH w AS (SELECT doc_id, {WORDS} AS seq FROM documents)
SELECT doc_id, seq FROM w WHERE NOT regexp_matches(seq, '[^{S.ALPHABET}]')""")
def drop_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without blanks, stops and commas, which texts are pure sequences?"""
    docs = table(spark, sf_dir, "documents")
    joined = docs.select("doc_id", F.regexp_replace(F.upper("text"), "[\\s.,]", "").alias("seq"))
    return stats.drop_invalid(joined)


@query("clean_count", f"""WITH {SEQS} SELECT count(*) AS n_clean, sum(length(seq))::BIGINT AS residues
FROM seqs WHERE length(seq) > 0""")
def clean_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq_clean(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_clean"),
                                        F.sum(F.length("seq")).cast("bigint").alias("residues"))


@query("seq_stats", f"""WITH {SEQS}, s AS (SELECT lang, length(seq) AS len FROM seqs WHERE length(seq) > 0),
run AS (SELECT lang, len, sum(len) OVER (PARTITION BY lang ORDER BY len DESC) AS r,
               sum(len) OVER (PARTITION BY lang) AS total FROM s)
SELECT lang, count(*) AS num_seqs, sum(len)::BIGINT AS sum_len, min(len)::INTEGER AS min_len,
       round(avg(len), 6) AS avg_len, max(len)::INTEGER AS max_len,
       round(quantile_cont(len, 0.25), 6) AS q1, round(quantile_cont(len, 0.5), 6) AS q2,
       round(quantile_cont(len, 0.75), 6) AS q3,
       max(CASE WHEN r * 2 >= total THEN len END)::INTEGER AS n50
FROM run GROUP BY lang""")
def seq_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = seqs(spark, sf_dir)
    s = stats.length_stats(rows, ["lang"])
    return s.select("lang", "num_seqs", "sum_len", "min_len", r6("avg_len", "avg_len"), "max_len",
                    r6("q1", "q1"), r6("q2", "q2"), r6("q3", "q3"), "n50")


COMP_SQL = ", ".join(
    f"(length(seq) - length(replace(seq, '{a}', ''))) / length(seq)" for a in S.ALPHABET)


@query("embed_composition", f"""WITH {SEQS},
e AS (SELECT doc_id, [{COMP_SQL}] AS v FROM seqs WHERE length(seq) > 0)
SELECT doc_id, {", ".join(f"round(v[{i + 1}], 6) AS e{i}" for i in range(20))} FROM e""")
def embed_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = seq_clean(spark, sf_dir).select("doc_id", S.composition("seq").alias("v"))
    return emb.select("doc_id", *[r6(F.col("v")[i], f"e{i}") for i in range(20)])


@query("head_n", f"""WITH {SEQS} SELECT doc_id, seq FROM seqs WHERE length(seq) > 0 ORDER BY doc_id LIMIT 25""")
def head_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq_clean(spark, sf_dir).orderBy("doc_id").limit(25)


@query("scalar_pack", """WITH e AS (SELECT *, (props->>'k')::INTEGER AS k FROM events)
SELECT event_id, trim('  ' || event_type || ' ') AS name, upper(event_type) AS code,
  starts_with(event_type, 'e') AS is_e, ends_with(event_type, 'w') AS is_w,
  rpad(substr(event_type, 1, 3), 5, '_') AS short, event_type || '_' || user_id AS tag,
  printf('r%d_%s', k, event_type) AS title, strftime(ts, '%Y%m%d-%H%M%S') AS stamp,
  epoch_us(ts) AS ts_us, floor(value)::BIGINT AS whole, (user_id % 8)::INTEGER AS device,
  round(0.5 * pow(2, k % 5), 6) AS backoff, value / nullif(k, 0) AS rate,
  k, [user_id, event_id, k][2] AS second, coalesce(map {'click': 1, 'view': 2}[event_type], 0) AS weight,
  '{"batch_id":' || event_id || ',"ok":' || CASE WHEN event_type <> 'error' THEN 'true' ELSE 'false' END || '}' AS payload,
  CASE WHEN event_type = 'error' THEN 'own' WHEN k > 50 THEN 'shared' ELSE 'none' END AS source_kind
FROM e""")
def scalar_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scalar functions of the data model, on every event."""
    k = F.get_json_object("props", "$.k").cast("int")
    ev = table(spark, sf_dir, "events").withColumn("k", k)
    weights = F.create_map(F.lit("click"), F.lit(1), F.lit("view"), F.lit(2))
    kind = (F.when(F.col("event_type") == "error", "own").when(F.col("k") > 50, "shared")
            .otherwise("none"))
    return ev.select(
        "event_id", F.trim(F.concat(F.lit("  "), "event_type", F.lit(" "))).alias("name"),
        F.upper("event_type").alias("code"), F.startswith("event_type", F.lit("e")).alias("is_e"),
        F.endswith("event_type", F.lit("w")).alias("is_w"),
        F.rpad(F.substring("event_type", 1, 3), 5, "_").alias("short"),
        F.concat_ws("_", "event_type", "user_id").alias("tag"),
        F.format_string("r%d_%s", "k", "event_type").alias("title"),
        F.date_format("ts", "yyyyMMdd-HHmmss").alias("stamp"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.floor("value").alias("whole"), (F.col("user_id") % 8).cast("int").alias("device"),
        r6(0.5 * F.pow(F.lit(2), F.col("k") % 5), "backoff"),
        F.try_divide(F.col("value"), F.col("k")).alias("rate"), "k",
        F.element_at(F.array("user_id", "event_id", F.col("k").cast("bigint")), 2).alias("second"),
        F.coalesce(weights[F.col("event_type")], F.lit(0)).alias("weight"),
        F.to_json(F.struct(F.col("event_id").alias("batch_id"),
                           (F.col("event_type") != "error").alias("ok"))).alias("payload"),
        kind.alias("source_kind"))
