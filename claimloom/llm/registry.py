"""Queries of the training-data operators, and their SQL where SQL can express them."""

from . import (
    centroid_clustering, decontamination, itq_neardup, language_id, license_scan, quality_rules, rlz_dedup, secret_scan, sentencepiece_sampling, simhash_neardup, toxicity, warc,
    whitening,
)

QUERIES = {
    "op1_license_scan": license_scan.query,
    "op2_warc_transactions": warc.query,
    "op3_itq_neardup": itq_neardup.query,
    "op4_secret_scan": secret_scan.query,
    "op5_language_id": language_id.query,
    "op6_toxicity": toxicity.query,
    "op7_sentencepiece": sentencepiece_sampling.query,
    "op8_rlz_dedup": rlz_dedup.query,
    "op9_simhash_bktree": simhash_neardup.query,
    "op10_decontamination": decontamination.query,
    "op11_centroid_clustering": centroid_clustering.query,
    "op12_whitening": whitening.query,
    "op13_quality_rules": quality_rules.query,
}

ORACLE = {
    "op1_license_scan": license_scan.SQL,
    "op2_warc_transactions": warc.SQL,
    "op3_itq_neardup": itq_neardup.SQL,
    "op8_rlz_dedup": rlz_dedup.SQL,
    "op11_centroid_clustering": centroid_clustering.SQL,
    "op13_quality_rules": quality_rules.SQL,
}
