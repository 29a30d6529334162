"""A corpus pipeline: documents in, packed training sequences out.

Each stage works on all that the one before has kept: language ID drops texts without a
language, the n-gram join leaves one document of each component of near duplicates, secrets are
redacted in place, sources are mixed to their target weights (documents repeat), and the mix is
packed. The last stage gives pieces of sequences, the others rows like those of `documents`.
"""

from wardweave.llm import language_id, mixing, ngram_join, packing, secrets
from wardweave.llm.common import materialize, table

STAGES = [
    ("language_id", lambda spark, docs, sf_dir: language_id.keep_known(docs)),
    ("ngram_join", lambda spark, docs, sf_dir: ngram_join.keep_one(docs)),
    ("secrets", lambda spark, docs, sf_dir: secrets.redact(docs)),
    ("mixing", lambda spark, docs, sf_dir: mixing.emit(docs)),
    ("packing", lambda spark, docs, sf_dir: packing.pack_documents(docs)),
]
#: Tokens cannot be had in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
