"""A training-text pipeline over ``documents``: each stage works on all that the one before it kept.

quality      documents that the line rules reject go; failed lines of the others go
near_dup     of documents whose 5-word shingles link them, the smallest doc_id stays
leaks        documents that hold a passage of a benchmark item go
secrets      credentials that look live are masked
packing      token ids are packed into sequences; the result has a row for each piece

The last stage has other columns; the others keep those of ``documents``.
"""

from __future__ import annotations

from volreg.llm.common import stored
from volreg.llm.decontaminate import decontaminated
from volreg.llm.jaccard_join import one_of_each
from volreg.llm.packing import pack_documents
from volreg.llm.quality_rules import clean_documents
from volreg.llm.secret_scan import by_source, redact


def quality(spark, docs, sf_dir):
    return clean_documents(docs)


def near_dup(spark, docs, sf_dir):
    return one_of_each(docs)


def leaks(spark, docs, sf_dir):
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark, docs, sf_dir):
    return redact(docs, *by_source())


def packing(spark, docs, sf_dir):
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).drop("worker")


STAGES = [("quality", quality), ("near_dup", near_dup), ("leaks", leaks), ("secrets", secrets), ("packing", packing)]

#: Shingle links, alignments and tokenizers are beyond SQL; tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
