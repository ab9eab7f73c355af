"""The operators' registered queries, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from terrapane.llm import audio, bpe, chat, classifier, collocations, jaccard, licenses, linededup, mixing, oracles, quality, secrets, spelling, tokencount
from terrapane.llm.common import table


def op1_audio_fingerprints(spark, sf_dir):
    printed = audio.fingerprints(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", audio.tones)
    text = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["class_id"].cast("string"), m["shift"].cast("string"), m["votes"].cast("string"))), ",")
    return audio.search(printed).select(F.col("id").alias("vec_id"), "class_id", "n_prints", "is_query", "n_matches", text.alias("matches"))


def op2_quality_classifier(spark, sf_dir):
    found = classifier.posteriors(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", *(F.round(c, 6).alias(c) for c in ("p_document", "p_host", "p_path", "p_quality")), "kept")


def op3_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.bpe_digest(bpe.encode_and_decode(table(spark, sf_dir, "documents"), path))


def op4_jaccard_join(spark, sf_dir):
    return jaccard.link_documents(table(spark, sf_dir, "documents"))


def op5_secret_scan(spark, sf_dir):
    return secrets.secret_digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op6_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.sql("SELECT -1L AS conv_id, CAST(i AS BIGINT) AS turn, IF(i = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0), (1) AS t(i)")
    return chat.chat_digest(chat.format_chats(chat.log_of_turns(turns.unionByName(control))))


def op7_license_scan(spark, sf_dir):
    return licenses.license_digest(licenses.scan_licenses(table(spark, sf_dir, "documents")))


def op8_token_counts(spark, sf_dir):
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_mixing(spark, sf_dir):
    return mixing.mix_digest(mixing.mix(table(spark, sf_dir, "documents")))


def op10_quality_rules(spark, sf_dir):
    return quality.quality_digest(quality.judge(table(spark, sf_dir, "documents")))


def op11_line_dedup(spark, sf_dir):
    return linededup.line_digest(linededup.with_kept_lines(table(spark, sf_dir, "documents")))


def op12_spelling_variants(spark, sf_dir):
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


def op13_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


_ALL = (
    op1_audio_fingerprints,
    op2_quality_classifier,
    op3_bpe,
    op4_jaccard_join,
    op5_secret_scan,
    op6_chat_format,
    op7_license_scan,
    op8_token_counts,
    op9_mixing,
    op10_quality_rules,
    op11_line_dedup,
    op12_spelling_variants,
    op13_collocations,
)
QUERIES = {f.__name__: f for f in _ALL}
ORACLES = oracles.ORACLES
