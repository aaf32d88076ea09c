"""The registered queries of the operators in this subpackage, with DuckDB SQL where that can express them."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path
from typing import NamedTuple

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import bpe, importance, infill, langid, licenses, lines, minhash, packing, rules, spots, token_groups, toolcalls, toxicity
from clickloom.llm.components import reliable

PACKAGE = Path(__file__).resolve().parents[1]


class Query(NamedTuple):
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers unless they find it by their search path or working folder."""
    root = PACKAGE.parent
    known = [Path(part).resolve() for part in [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)] if part]
    if any((folder / PACKAGE.name).is_dir() for folder in [*known]) or getattr(spark, "_clickloom_shipped", False):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), PACKAGE.name), "zip", root, PACKAGE.name)
    spark.sparkContext.addPyFile(archive)
    spark._clickloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


TOOLS = {
    "reply": {"chars": toolcalls.Field("integer"), "text": toolcalls.Field("string", max_length=400)},
    "configure": {"chars": toolcalls.Field("integer"), "strict": toolcalls.Field("boolean", required=False), "text": toolcalls.Field("string")},
}


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and system turns as calls of two tools, each reply depending on the call two turns before; an assistant's turn
    is the result of the call one turn before."""
    turns = table(spark, sf_dir, "conversations")
    back = lambda n: F.concat(F.lit("call_"), (F.col("turn") - n).cast("string"))
    user = F.col("role") == "user"
    calls = turns.where(F.col("role").isin("user", "system")).select(
        "conv_id", "turn", back(0).alias("call_id"), F.when(user, "reply").otherwise("configure").alias("name"),
        F.to_json(F.struct("text", F.char_length("text").alias("chars"))).alias("arguments"),
        F.when(user, F.array(back(2))).alias("after"))
    results = turns.where(F.col("role") == "assistant").select("conv_id", "turn", back(1).alias("call_id"), F.col("text").alias("content"))
    linked = toolcalls.link(calls, results, TOOLS)
    return linked.select("conv_id", "call_id", "kind", "turn", "level", "name", "result_turn", "n_calls", "n_results",
                         F.array_join("errors", ",").alias("errors"), "valid", F.sha2("json", 256).alias("json_sha256"))


OP2_SQL = """
WITH calls AS (
  SELECT conv_id, 'call_' || turn AS call_id, min(turn) AS turn, count(*) AS n_calls,
         min(struct_pack(name := CASE WHEN role = 'user' THEN 'reply' ELSE 'configure' END,
             a := '{' || coalesce('"text":' || to_json(text) || ',"chars":' || length(text), '') || '}',
             text := text)) AS c
  FROM conversations WHERE role IN ('user', 'system') AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), results AS (
  SELECT conv_id, 'call_' || (turn - 1) AS call_id, min(turn) AS result_turn, min(text) AS content, count(*) AS n_results
  FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), both_of AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, c.turn, c.c.name AS name,
         c.c.text AS text, n_calls, result_turn, content, n_results
  FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.call_id = r.call_id
), checked AS (
  SELECT *, CASE WHEN n_calls IS NULL THEN 'no_call' WHEN text IS NULL THEN 'missing:chars,missing:text'
                 WHEN name = 'reply' AND length(text) > 400 THEN 'too_long:text' ELSE '' END AS errors
  FROM both_of
)
SELECT conv_id, call_id,
       CASE WHEN n_calls IS NULL THEN 'orphan' WHEN n_results IS NULL THEN 'unanswered' ELSE 'linked' END AS kind,
       coalesce(turn, result_turn) AS turn, 0 AS level, name, result_turn, coalesce(n_calls, 0) AS n_calls,
       coalesce(n_results, 0) AS n_results, errors, errors = '' AND coalesce(n_calls, 0) = 1 AS valid,
       sha256('{"arguments":' || CASE WHEN n_calls IS NULL THEN 'null' WHEN text IS NULL THEN '{}'
                ELSE '{"chars":' || length(text) || ',"text":' || to_json(text) || '}' END
              || ',"id":' || to_json(call_id) || ',"name":' || coalesce(to_json(name)::VARCHAR, 'null')
              || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}') AS json_sha256
FROM checked
"""


def toxicity_chain(docs: DataFrame, labels: DataFrame) -> toxicity.Chain:
    """The chain of the given labels: poor text, toxic text, and toxic text that is otherwise fit."""
    return toxicity.fit(docs, labels, {
        "low_quality": F.col("quality") == 0,
        "toxic": F.col("toxic") == 1,
        "toxic_prose": (F.col("toxic") == 1) & (F.col("quality") == 1),
    })


def op3_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_chain(docs, table(spark, sf_dir, "labels")))
    toxic = F.col("p_toxic") >= toxicity.THRESHOLD
    return scored.withColumns({"toxic": toxic, "kept": ~toxic})


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.deduplicate_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "removed_lines", F.char_length("text").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


OP5_SQL = """
WITH lines AS (
  SELECT doc_id, source, i, trim(line) AS line,
         CASE WHEN len(list_filter(regexp_split_to_array(trim(line), '[\\x20\\x09-\\x0D]+'), lambda x : x <> '')) < 4 THEN 8 ELSE 4 END AS needed
  FROM (SELECT doc_id, coalesce(source, '') AS source, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
), spread AS (
  SELECT line, min(struct_pack(doc_id := doc_id, i := i)) AS first FROM lines GROUP BY line HAVING count(DISTINCT source) >= min(needed)
), gone AS (
  SELECT l.doc_id, l.i FROM lines l JOIN spread s USING (line) WHERE NOT (l.doc_id = s.first.doc_id AND l.i = s.first.i)
), cut AS (
  SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
), texts AS (
  SELECT d.doc_id, coalesce(len(gone), 0)::INT AS removed_lines,
         CASE WHEN gone IS NULL THEN text
              ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, k : NOT list_contains(gone, k)), chr(10)) END AS text
  FROM documents d LEFT JOIN cut c ON d.doc_id = c.doc_id
)
SELECT doc_id, removed_lines, length(text)::INT AS n_chars_left, sha256(text) AS text_sha256 FROM texts
"""


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def quality_rules(docs: DataFrame, labels: DataFrame) -> list[rules.Rule]:
    return rules.learn(reliable(rules.labelled_features(docs, labels, F.col("quality") == 0)))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, quality_rules(docs, table(spark, sf_dir, "labels")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs = docs.withColumn("held_out", held_out)
    known = docs.where(~F.col("held_out") & F.col("doc_id").isNotNull())
    model = langid.fit(known, public_tokenizers.path("piece_bpe_32k.model"))
    return langid.predict(docs, model, keep=("held_out",))


def op9_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots.edited_likeness(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of their source's folder, with a folder for each thousand ids and in it one for each hundred. By a
    hash of the id, a tenth are license files by name in the source's folder and three tenths in that of the thousand. One
    that states a license speaks for its folder and those below it."""
    path = ("CASE WHEN crc32(CAST(doc_id AS STRING)) % 10 = 0 THEN concat(source, '/LICENSE-', doc_id) "
            "WHEN crc32(CAST(doc_id AS STRING)) % 10 < 4 THEN concat(source, '/', doc_id div 1000, '/LICENSE-', doc_id) "
            "ELSE concat(source, '/', doc_id div 1000, '/', doc_id div 100, '/', doc_id, '.txt') END")
    return licenses.scan(table(spark, sf_dir, "documents"), path, is_license_sql="license IS NOT NULL")


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_groups.join_by_groups(table(spark, sf_dir, "documents"), width=4, percent=85)


OP11_SQL = """
WITH RECURSIVE sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [w]
                      ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i : w[i:i + 3])) END AS members
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x20\x09-\x0D]+') AS w FROM documents)
), entries AS (
  SELECT doc_id, len(members) AS n, unnest(members) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a
)
SELECT doc_id, len(members)::BIGINT AS n_shingles, component_id
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


# The CRC-32 of each distinct word is worked out from its bytes by the table of remainders.
OP12_SQL = """
WITH crc_table AS (
  SELECT list(r ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_concat([b::UBIGINT], list_transform(range(8), lambda i : 0::UBIGINT)),
      lambda c, z : CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS r
    FROM (SELECT unnest(range(256)) AS b))
), words AS (
  SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 'b', NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), hashed AS (
  SELECT word, xor(4294967295::UBIGINT, list_reduce(
      list_concat([4294967295::UBIGINT], list_transform(range(len(hex(word)) // 2), lambda i : ('0x' || substr(hex(word), (2 * i + 1)::INT, 2))::UBIGINT)),
      lambda c, b : xor(c >> 8, t[(xor(c, b) & 255::UBIGINT)::INT + 1]))) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM words), crc_table
), counts AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM words JOIN hashed USING (word) GROUP BY bucket
), gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sa + 10000) / ((s + 1)::DOUBLE * (ta + 10000))))::BIGINT AS gain
  FROM counts, (SELECT sum(s)::BIGINT AS sa, sum(t)::BIGINT AS ta FROM counts)
), weights AS (
  SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS w FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(w, 0) AS weight, coalesce(w, 0) + floor(-1000 * ln(-ln(
    (('0x' || substr(sha256('2024:' || doc_id), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS wanted FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= wanted THEN place END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = infill.restored(infill.fill_in_middle(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
         list_transform(range(4), lambda i : ('0x' || substr(sha256('1:' || doc_id), (8 * i + 1)::INT, 8))::UBIGINT) AS h
  FROM documents
), placed AS (
  SELECT *, len(tokens) AS n, least(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1))::BIGINT AS low,
         greatest(h[1] % (len(tokens) + 1), h[2] % (len(tokens) + 1))::BIGINT AS high,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
              WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT *, array_to_string(tokens[1:low], '') AS p, array_to_string(tokens[low + 1:high], '') AS m, array_to_string(tokens[high + 1:], '') AS s
  FROM placed
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": Query(op1_byte_bpe),
    "op2_tool_calls": Query(op2_tool_calls, OP2_SQL),
    "op3_toxicity_chain": Query(op3_toxicity_chain),
    "op4_minhash_near_dedup": Query(op4_minhash_near_dedup),
    "op5_line_dedup": Query(op5_line_dedup, OP5_SQL),
    "op6_best_fit_packing": Query(op6_best_fit_packing),
    "op7_quality_rules": Query(op7_quality_rules),
    "op8_language_id": Query(op8_language_id),
    "op9_spot_signatures": Query(op9_spot_signatures),
    "op10_license_scan": Query(op10_license_scan),
    "op11_ngram_jaccard_join": Query(op11_ngram_jaccard_join, OP11_SQL),
    "op12_importance_resampling": Query(op12_importance_resampling, OP12_SQL),
    "op13_fill_in_middle": Query(op13_fill_in_middle, OP13_SQL),
    "pipeline": Query(pipeline),
}
