"""The queries of the training-text operators and what SQL can state of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from factloom.llm import bpe

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    out = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep_ids=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from factloom.llm import tokencount

    docs = _documents(spark, sf_dir).select("doc_id", "text")
    out = tokencount.count_tokens(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_words", "n_tokens")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import exactdedup

    return exactdedup.dedup(_documents(spark, sf_dir))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import media

    return media.media_columns(_documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import linededup

    out = linededup.dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    # which earlier line a near copy was met with is left out: it isn't canonical
    return out.select("doc_id", "n_lines", "n_exact", "n_near", F.transform("near_lines", lambda x: x["line"]).alias("near_lines"), "text")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import mixing

    docs = _documents(spark, sf_dir)
    out = mixing.mix(docs, mixing.rates(docs))
    return out.select("doc_id", "source", "copy", F.round("rate", 9).alias("rate"), "text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import simhash

    return simhash.near_duplicates(_documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import quality

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("good"))
    out = quality.classify(_documents(spark, sf_dir).select("doc_id", "source", "lang", "text"), labels)
    return out.select("doc_id", "source", "lang", "llr", "site_rate", "path_rate", "posterior", "keep")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import langid

    docs = _documents(spark, sf_dir)
    learned = langid.learn(docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    return langid.identify(docs, learned).select("doc_id", langid.held_out(docs).alias("held_out"), "lang_pred", "score")


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import urlfilter

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return urlfilter.judge(pages, urlfilter.mine(pages, labels))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import merkle

    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    cut = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in fields]
    docs = _documents(spark, sf_dir).withColumn("tampered", F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.unhex(merkle.leaf(*cut))))
    out = merkle.manifest(docs, fields, "source", "doc_id", ["doc_id", "tampered"])
    folded = merkle.fold(F.coalesce(F.lower(F.hex("tampered")), "leaf"), F.col("path"))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"), (folded == F.col("root")).alias("verified"))


def op12_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from factloom.llm import tokenstore

    shards = tokenstore.write(_documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenstore.read(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm import fillmiddle

    out = fillmiddle.transform(_documents(spark, sf_dir).select("doc_id", "text"))
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fillmiddle.restored()).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_bpe, op2_token_counts, op3_exact_dedup, op4_media, op5_line_dedup, op6_mixing, op7_simhash, op8_quality, op9_langid, op10_urlfilter, op11_merkle, op12_token_store, op13_fill_in_middle)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op6_mixing": OP6_SQL, "op11_merkle": OP11_SQL, "op13_fill_in_middle": OP13_SQL}


OP3_SQL = """
WITH d AS (
  SELECT doc_id, sha256(encode(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS h,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, h AS text_sha256
FROM d"""

OP6_SQL = """
WITH sizes AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents GROUP BY source HAVING sum(length(coalesce(text, ''))) > 0),
rated AS (SELECT source, CAST(1.0 AS DOUBLE) / CAST(count(*) OVER () AS DOUBLE) * CAST(sum(size) OVER () AS DOUBLE) / size AS rate FROM sizes),
parts AS (SELECT source, rate, CAST(ceil(rate / 16) AS INTEGER) AS draws, rate / ceil(rate / 16) AS mean FROM rated),
cdf AS (SELECT source, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS p
        FROM parts, LATERAL (SELECT unnest(range(CAST(ceil(mean + 12 * sqrt(mean) + 12) AS BIGINT) + 1)) AS k)),
named AS (SELECT *, CASE WHEN doc_id IS NOT NULL THEN CAST(doc_id AS VARCHAR) ELSE
                 'null:' || sha256(coalesce(text, '')) || ':' || row_number() OVER (PARTITION BY doc_id, text, lang, source, n_chars) END AS name FROM documents),
drawn AS (SELECT d.name, d.doc_id, d.source, d.text, p.rate,
                 ('0x' || substr(sha256('17:' || d.name || ':' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
          FROM named d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, LATERAL (SELECT unnest(range(1, p.draws + 1)) AS j)),
counted AS (SELECT w.name, w.doc_id, w.source, w.text, w.rate, w.u, count(c.k) AS n
            FROM drawn w LEFT JOIN cdf c ON c.source IS NOT DISTINCT FROM w.source AND c.p <= w.u GROUP BY ALL),
total AS (SELECT name, doc_id, source, text, rate, sum(n) AS n FROM counted GROUP BY ALL)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, round(rate, 9) AS rate, text
FROM total, LATERAL (SELECT unnest(range(1, CAST(n AS BIGINT) + 1)) AS copy)"""

#: DuckDB has no crc32: a checksum takes a byte, then shifts eight bits out, each of which may add the polynomial.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length({0}) + 1), lambda i: [CAST(ascii(substr({0}, CAST(i AS BIGINT), 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
         lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END))"""


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP11_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS g, {_leaf("text")} AS leaf,
         CASE WHEN {CRC32.format("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS tampered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY g) AS n FROM leaves),
tree AS (SELECT 0 AS lvl, g, idx, n, leaf AS d FROM placed
  UNION ALL SELECT lvl + 1, g, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY lvl, g, idx // 3, n),
tops AS (SELECT g, d, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
high AS (SELECT 0 AS lvl, idx, n, d FROM tops
  UNION ALL SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(d, '' ORDER BY idx)) FROM high WHERE n > 1 GROUP BY lvl, idx // 3, n),
sides AS (SELECT 0 AS part, lvl, g, idx, coalesce(lag(d, 2) OVER w, '') || coalesce(lag(d, 1) OVER w, '') AS l, coalesce(lead(d, 1) OVER w, '') || coalesce(lead(d, 2) OVER w, '') AS r
          FROM tree WHERE n > 1 WINDOW w AS (PARTITION BY lvl, g, idx // 3 ORDER BY idx)),
high_sides AS (SELECT 1 AS part, lvl, idx, coalesce(lag(d, 2) OVER w, '') || coalesce(lag(d, 1) OVER w, '') AS l, coalesce(lead(d, 1) OVER w, '') || coalesce(lead(d, 2) OVER w, '') AS r
          FROM high WHERE n > 1 WINDOW w AS (PARTITION BY lvl, idx // 3 ORDER BY idx)),
steps AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY part, lvl) - 1 AS k, l, r FROM (
  SELECT p.rid, s.part, s.lvl, s.l, s.r FROM placed p JOIN sides s ON s.g IS NOT DISTINCT FROM p.g AND s.idx = p.idx // CAST(pow(3, s.lvl) AS BIGINT)
  UNION ALL
  SELECT p.rid, s.part, s.lvl, s.l, s.r FROM placed p JOIN tops t ON t.g IS NOT DISTINCT FROM p.g JOIN high_sides s ON s.idx = t.idx // CAST(pow(3, s.lvl) AS BIGINT))),
folded AS (SELECT rid, 0 AS k, coalesce(tampered, leaf) AS h FROM placed
  UNION ALL SELECT f.rid, f.k + 1, sha256(s.l || f.h || s.r) FROM folded f JOIN steps s ON s.rid = f.rid AND s.k = f.k),
ends AS (SELECT rid, arg_max(h, k) AS folded_root FROM folded GROUP BY rid),
proofs AS (SELECT rid, sha256(string_agg(l || r, '' ORDER BY k)) AS proof FROM steps GROUP BY rid)
SELECT p.doc_id, p.leaf, t.d AS subroot, h.d AS root, coalesce(q.proof, sha256('')) AS proof_sha256, e.folded_root, e.folded_root = h.d AS verified
FROM placed p JOIN tops t ON t.g IS NOT DISTINCT FROM p.g JOIN high h ON h.n = 1 JOIN ends e ON e.rid = p.rid LEFT JOIN proofs q ON q.rid = p.rid"""

OP13_SQL = """
WITH units AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS b,
                 text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 AS plain,
                 ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 AS spm FROM units),
cut AS (SELECT *, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS s FROM drawn)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
       sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cut"""
