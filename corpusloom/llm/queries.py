"""The registered queries of this subpackage."""

from corpusloom.llm import bpe, decontamination, htmltext, linededup, media, minhash, recompression, sharding, tokencount, toxicity

QUERIES = {
    "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
    "op2_bpe": bpe.op2_bpe,
    "op3_token_counts": tokencount.op3_token_counts,
    "op4_sharding": sharding.op4_sharding,
    "op5_substring_dedup": recompression.op5_substring_dedup,
    "op6_line_dedup": linededup.op6_line_dedup,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_html_extraction": htmltext.op9_html_extraction,
    "op10_media_columns": media.op10_media_columns,
}

ORACLE_SQL = {
    "op1_minhash_near_dedup": minhash.SQL,
    "op4_sharding": sharding.SQL,
    "op5_substring_dedup": recompression.SQL,
    "op7_decontamination": decontamination.SQL,
}
