"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from touchline.llm import bpe, chat, decontaminate, jaccard, quality, sharding, suffixes, toxicity, vafile, warc

QUERIES = {
    "op1_chat_rotation": chat.op1_chat_rotation,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_bpe": bpe.op3_bpe,
    "op4_vafile": vafile.op4_vafile,
    "op5_suffix_dedup": suffixes.op5_suffix_dedup,
    "op6_sharding": sharding.op6_sharding,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_warc": warc.op8_warc,
    "op9_quality": quality.op9_quality,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_rotation": chat.OP1_SQL,
    "op4_vafile": vafile.OP4_SQL,
    "op6_sharding": sharding.OP6_SQL,
    "op7_jaccard": jaccard.OP7_SQL,
    "op8_warc": warc.OP8_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
}
