"""Queries of this subpackage, one per operator, over its whole table."""

from __future__ import annotations

from auditlake.llm import (bpe, chat, credentials, mixing, neighbours, pii, quality, resampling, simhash, substring, suffix,
                           voting, whitening)
from auditlake.llm.common import table
from auditlake.llm.oracles import ORACLES  # noqa: F401

VOCABULARY = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    """Path of the vocabulary file on the driver; its content is broadcast."""
    import public_tokenizers
    return public_tokenizers.path(VOCABULARY)


QUERIES = {
    "op1_mixing": lambda spark, sf: mixing.op1(table(spark, sf, "documents")),
    "op2_simhash": lambda spark, sf: simhash.op2(table(spark, sf, "documents")),
    "op3_substring": lambda spark, sf: substring.op3(table(spark, sf, "documents")),
    "op4_bpe": lambda spark, sf: bpe.op4(table(spark, sf, "documents"), tokenizer_path()),
    "op5_suffix": lambda spark, sf: suffix.op5(table(spark, sf, "documents")),
    "op6_tool_calls": lambda spark, sf: chat.op6(table(spark, sf, "conversations")),
    "op7_secrets": lambda spark, sf: credentials.op7(table(spark, sf, "documents")),
    "op8_pii": lambda spark, sf: pii.op8(table(spark, sf, "documents")),
    "op9_quality": lambda spark, sf: quality.op9(table(spark, sf, "documents")),
    "op10_neighbours": lambda spark, sf: neighbours.op10(table(spark, sf, "embeddings")),
    "op11_whitening": lambda spark, sf: whitening.op11(table(spark, sf, "embeddings")),
    "op12_voting": lambda spark, sf: voting.op12(table(spark, sf, "documents"), table(spark, sf, "labels")),
    "op13_resampling": lambda spark, sf: resampling.op13(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
}
