"""The queries of this subpackage and, where SQL expresses them, their DuckDB counterparts."""

from __future__ import annotations

from . import chat, decontamination, embedding_dedup, merkle, mixing, packing, quality_classifier, quality_rules, simhash, spelling, suffix_dedup, token_files, warc

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_packing": packing.op2_packing,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_warc": warc.op4_warc,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_token_files": token_files.op6_token_files,
    "op7_simhash": simhash.op7_simhash,
    "op8_chat": chat.op8_chat,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_spelling": spelling.op11_spelling,
    "op12_decontamination": decontamination.op12_decontamination,
    "op13_merkle": merkle.op13_merkle,
}
ORACLES = {
    "op1_mixing": mixing.OP1_SQL,
    "op4_warc": warc.OP4_SQL,
    "op5_embedding_dedup": embedding_dedup.OP5_SQL,
    "op8_chat": chat.OP8_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op10_suffix_dedup": suffix_dedup.OP10_SQL,
    "op11_spelling": spelling.OP11_SQL,
    "op12_decontamination": decontamination.OP12_SQL,
    "op13_merkle": merkle.OP13_SQL,
}
