"""Queries of this subpackage for __spark_entry__.py, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontaminate, html_text, jaccard, licenses, quality, secrets, substrings, toxicity


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_secrets": secrets.op2_secrets,
        "op3_html": html_text.op3_html,
        "op4_chat": chat.op4_chat,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_jaccard": jaccard.op6_jaccard,
        "op7_substrings": substrings.op7_substrings,
        "op8_quality": quality.op8_quality,
        "op9_bpe": bpe.op9_bpe,
        "op10_licenses": licenses.op10_licenses,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_chat": chat.OP4_SQL,
        "op5_decontaminate": decontaminate.OP5_SQL,
    }
