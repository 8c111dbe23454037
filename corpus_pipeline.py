"""Corpus pipeline: stages over documents, each written as Parquet and read again by the next.

The stages, in order: drop toxic documents, keep one document of each group of near copies,
redact secrets, mix the sources to their target weights, pack token sequences. All but the last
return the columns of ``documents``. No SQL expresses them (learned scores, MinHash, tokens), so
``ORACLE_SQL`` is None; tests hold each stage against a plain version of its rule.
"""

from __future__ import annotations

from stratalog.llm.minhash import dedup_stage
from stratalog.llm.mixing import mix_stage
from stratalog.llm.packing import pack_stage
from stratalog.llm.secrets import redact_stage
from stratalog.llm.staging import new_path, removed
from stratalog.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", dedup_stage),
    ("secrets", redact_stage),
    ("mixing", mix_stage),
    ("packing", pack_stage),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    """The pieces of the packed sequences, from the documents table of ``sf_dir``.

    Each stage's documents go once the next stage's are written; the last ones are read by the result.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        done, path = stage(spark, docs, sf_dir), new_path(spark, name)
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
        if before is not None:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
