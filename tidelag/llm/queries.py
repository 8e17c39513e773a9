"""Queries of the operators on the given tables: op<N>_<name> applies operator N, with its
production parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from ..staging import shared_folder
from . import coordinate_join, cover_dedup, digest_index, golay_simhash, letter_vectors, middle_fill, pair_grammar, piece_lattice, rule_forest, run_index, secret_tests, soft_mixing, turn_repair
from .shared import tokenizer_file


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = soft_mixing.domains(_table(spark, sf_dir, "labels"))
    return soft_mixing.mix_rates(_documents(spark, sf_dir), labels, soft_mixing.TARGETS)


def op2_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = run_index.remove_later(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_digest_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    decided = digest_index.deduplicate(_documents(spark, sf_dir))
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op4_rule_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rule_forest.judge(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op5_pair_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    pair_grammar.write_ids(_documents(spark, sf_dir), path, tokenizer_file("word_bpe_49k.json"))
    return pair_grammar.digests(spark, path)


def op6_letter_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return letter_vectors.identify(docs, letter_vectors.learn(docs))


def op7_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = golay_simhash.near_duplicates(_documents(spark, sf_dir))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_cover_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = cover_dedup.remove_repeats(_documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, and the text that they decode to, as counts and digests."""
    model = tokenizer_file("piece_bpe_32k.model")
    both = piece_lattice.decode(piece_lattice.encode(_documents(spark, sf_dir), model), model)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.crc32(F.array_join("ids", ",")).alias("ids_crc32"),
        F.sha2("text", 256).alias("text_sha256"),
    )


def op10_secret_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_tests.find_secrets(_documents(spark, sf_dir))
    count = lambda kind: F.expr(f"CAST(size(filter(base, s -> s.kind = '{kind}')) AS BIGINT)").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.expr(secret_tests.as_text("base")), 256).alias("base_sha256"), F.expr(secret_tests.as_text("found")).alias("spans"),
    )


def op11_coordinate_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coordinate_join.near_duplicates(_documents(spark, sf_dir))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.with_digests(turn_repair.repair(turn_repair.damage(_table(spark, sf_dir, "conversations"))))


def op13_middle_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = middle_fill.transform(_documents(spark, sf_dir))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle_fill.restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_soft_mixing": op1_soft_mixing,
        "op2_run_index": op2_run_index,
        "op3_digest_index": op3_digest_index,
        "op4_rule_forest": op4_rule_forest,
        "op5_pair_grammar": op5_pair_grammar,
        "op6_letter_vectors": op6_letter_vectors,
        "op7_golay_simhash": op7_golay_simhash,
        "op8_cover_dedup": op8_cover_dedup,
        "op9_piece_lattice": op9_piece_lattice,
        "op10_secret_tests": op10_secret_tests,
        "op11_coordinate_join": op11_coordinate_join,
        "op12_turn_repair": op12_turn_repair,
        "op13_middle_fill": op13_middle_fill,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_digest_index": """WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
            sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents)
            SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
                count(*) OVER (PARTITION BY text_sha256) AS group_size,
                doc_id = first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS kept, text_sha256 FROM d""",
        "op13_middle_fill": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h,
                regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS units FROM documents),
            e AS (SELECT *, CAST(len(units) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
            c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                     WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM e),
            p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle,
                array_to_string(units[b + 1:n], '') AS suffix FROM c)
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
                CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
                sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    }
