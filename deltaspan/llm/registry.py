"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from deltaspan.llm import ann, dedup, language, lm, mixing, pieces, quality, token_output, topk, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_language": language.op2_language,
    "op3_token_output": token_output.op3_token_output,
    "op4_mixing": mixing.op4_mixing,
    "op5_quality": quality.op5_quality,
    "op6_topk": topk.op6_topk,
    "op7_pieces": pieces.op7_pieces,
    "op8_ann": ann.op8_ann,
    "op9_lm": lm.op9_lm,
    "op10_dedup": dedup.op10_dedup,
}

ORACLES: dict[str, str] = {
    "op4_mixing": mixing.ORACLE,
    "op6_topk": topk.ORACLE,
}
