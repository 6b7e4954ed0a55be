"""The subpackage's queries and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from . import chat, html_extract, language, line_dedup, minhash, mixing, packing, spotsigs, token_files, topk


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_token_files": token_files.op2_token_files,
    "op3_language_id": language.op3_language_id,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_spotsigs": spotsigs.op5_spotsigs,
    "op6_top_k": topk.op6_top_k,
    "op7_near_dedup": minhash.op7_near_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_html_extract": html_extract.op9_html_extract,
    "op10_packing": packing.op10_packing,
    "pipeline": pipeline,
}

ORACLES = {
    "op4_line_dedup": line_dedup.ORACLE,
    "op6_top_k": topk.ORACLE,
    "op7_near_dedup": minhash.ORACLE,
    "op8_mixing": mixing.ORACLE,
}
