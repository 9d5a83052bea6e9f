"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from veritrail.llm import ctw, langid, lines, mixing, packing, quality, quantiles, resampling, rollups, simhash, superminhash, topk, toxicity


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_ctw": ctw.op2_ctw,
        "op3_langid": langid.op3_langid,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_simhash": simhash.op5_simhash,
        "op6_quality": quality.op6_quality,
        "op7_packing": packing.op7_packing,
        "op8_topk": topk.op8_topk,
        "op9_rollup": rollups.op9_rollup,
        "op10_lines": lines.op10_lines,
        "op11_superminhash": superminhash.op11_superminhash,
        "op12_quantiles": quantiles.op12_quantiles,
        "op13_resampling": resampling.op13_resampling,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.ORACLE, "op8_topk": topk.ORACLE, "op13_resampling": resampling.ORACLE}
