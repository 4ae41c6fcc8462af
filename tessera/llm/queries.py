"""The queries of this subpackage, and their SQL where SQL expresses them."""

from __future__ import annotations

from . import bytebpe, langid, maxscore, media, neardups, packing, planes, preference, quality, repair, secrets, simhash, whitening


def pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_maxscore_topk": maxscore.op1_maxscore_topk,
        "op2_golay_simhash": simhash.op2_golay_simhash,
        "op3_interleaved_media": media.op3_interleaved_media,
        "op4_hyperdimensional_langid": langid.op4_hyperdimensional_langid,
        "op5_min_bin_slack": packing.op5_min_bin_slack,
        "op6_bit_planes": planes.op6_bit_planes,
        "op7_bradley_terry_quality": quality.op7_bradley_terry_quality,
        "op8_checked_secrets": secrets.op8_checked_secrets,
        "op9_overlapping_bpe": bytebpe.op9_overlapping_bpe,
        "op10_preference_pairs": preference.op10_preference_pairs,
        "op11_spherical_neardups": neardups.op11_spherical_neardups,
        "op12_four_russians_repair": repair.op12_four_russians_repair,
        "op13_refined_whitening": whitening.op13_refined_whitening,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_maxscore_topk": maxscore.OP1_SQL,
        "op10_preference_pairs": preference.OP10_SQL,
        "op11_spherical_neardups": neardups.OP11_SQL,
        "op12_four_russians_repair": repair.OP12_SQL,
    }
