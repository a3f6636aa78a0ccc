"""The registered queries of this subpackage and the SQL that states the same results."""

from __future__ import annotations

import public_tokenizers

from . import bitpack, bpe, chat, merkle, minhash, pii, quality, suffix_tree, toxicity, winnow
from .common import table


def op1_near_duplicates(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op2_quality(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_format(spark, sf_dir):
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op4_byte_bpe(spark, sf_dir):
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.parse_ranks(f.read())
    return bpe.report(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op5_suffix_tree_scores(spark, sf_dir):
    return suffix_tree.score(table(spark, sf_dir, "documents"))


def op6_fingerprints(spark, sf_dir):
    return merkle.edit_report(table(spark, sf_dir, "documents"))


def op7_toxicity(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_personal_data(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op9_token_ids(spark, sf_dir):
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        model = f.read()
    return bitpack.report(table(spark, sf_dir, "documents"), model, end_id=2, vocabulary=50_257)


def op10_decontamination(spark, sf_dir):
    return winnow.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_near_duplicates, op2_quality, op3_chat_format, op4_byte_bpe, op5_suffix_tree_scores, op6_fingerprints, op7_toxicity, op8_personal_data, op9_token_ids, op10_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": minhash.REPORT_SQL, "op6_fingerprints": merkle.REPORT_SQL, "op10_decontamination": winnow.REPORT_SQL}
