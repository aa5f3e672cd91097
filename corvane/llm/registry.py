"""The queries of this package, by name, and the SQL that gives the same rows where SQL can."""

from . import byte_bpe, decontaminate, knn_quality, language_id, license_scan, ngram_lm, passage_dedup, quality_rules, simhash, suffix_dedup

QUERIES = {
    "op1_quality_rules": quality_rules.verdicts,
    "op2_decontaminate": decontaminate.query,
    "op3_simhash": simhash.query,
    "op4_license_scan": license_scan.query,
    "op5_ngram_lm": ngram_lm.query,
    "op6_language_id": language_id.predicted,
    "op7_suffix_dedup": suffix_dedup.query,
    "op8_passage_dedup": passage_dedup.query,
    "op9_byte_bpe": byte_bpe.digests,
    "op10_knn_quality": knn_quality.query,
}
#: Fingerprints, alignments, chains, merges and models that are fitted have no SQL; their queries are tested against brute force.
ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.oracle(),
    "op4_license_scan": license_scan.oracle(),
    "op5_ngram_lm": ngram_lm.oracle(),
    "op7_suffix_dedup": suffix_dedup.oracle(),
}
