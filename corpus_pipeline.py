"""Corpus cleaning in five stages: toxicity, near-duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept; :func:`run` writes each result as Parquet and reads it again as the next
one's docs.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from quarry.llm import decontam, neardup, packing, pii, toxicity
from quarry.llm.stage import read_table, staged


def toxic(spark, docs, sf_dir):
    """Rows scored at or above their language's threshold go."""
    return toxicity.reject(docs, read_table(spark, sf_dir, "labels"))


def duplicates(spark, docs, sf_dir):
    """One row of each near-duplicate group stays, the one with the smallest doc_id."""
    return neardup.keep_one(docs)


def leaks(spark, docs, sf_dir):
    """Benchmark passages are cut out; a document of which they are over half goes."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def private(spark, docs, sf_dir):
    """Identifiers and disclosive terms are replaced by their kind; no row goes."""
    return pii.sanitise(docs)


def sequences(spark, docs, sf_dir):
    """Pieces of tokenised documents, their ids (4 bytes each, little-endian) with sequence and offset."""
    return packing.pack(docs, packing.tokenizer_path(), keep_ids=True)


STAGES = [("toxicity", toxic), ("near_duplicates", duplicates), ("decontamination", leaks), ("personal_data", private), ("packing", sequences)]

#: Trained scores and tokenizer ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """Apply the stages to the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}", texts=True)
    return docs
