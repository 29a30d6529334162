"""The subpackage's queries, and the SQL that states their rows where SQL can."""

from . import flac, language_id, lm_score, mixing, ngram_join, packing, quality_rules, secrets, warc, weak_labels

QUERIES = {
    f.__name__: f
    for f in (
        warc.op1_warc, language_id.op2_language_id, ngram_join.op3_ngram_join, weak_labels.op4_quality_classifier, quality_rules.op5_quality_rules,
        flac.op6_flac, lm_score.op7_lm_score, secrets.op8_secrets, mixing.op9_mixing, packing.op10_packing,
    )
}
ORACLES = {"op1_warc": warc.SQL, "op3_ngram_join": ngram_join.SQL, "op9_mixing": mixing.SQL}
