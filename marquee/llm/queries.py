"""The registered queries of the text operators, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marquee.llm import bpe, edit_sketch, hilbert, katz, pii, piece_lm, ranked, simhash, tiling, toxicity, urls, variants, wordpiece

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_order_minhash": edit_sketch.op1,
    "op2_byte_bpe": bpe.op2,
    "op3_simhash": simhash.op3,
    "op4_personal_data": pii.op4,
    "op5_url_filters": urls.op5,
    "op6_token_counts": wordpiece.op6,
    "op7_katz": katz.op7,
    "op8_toxicity": toxicity.op8,
    "op9_decontamination": tiling.op9,
    "op10_hilbert_shards": hilbert.op10,
    "op11_piece_language": piece_lm.op11,
    "op12_spelling_variants": variants.op12,
    "op13_ranked_search": ranked.op13,
}

ORACLES: dict[str, str] = {"op5_url_filters": urls.ORACLE, "op13_ranked_search": ranked.ORACLE}
