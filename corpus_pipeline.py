"""Corpus pipeline: STAGES over ``documents``, each written as Parquet and read again for the next.

1. toxicity: rows scored 0.3 or more go;
2. simhash: one row of each group of near-duplicates stays;
3. decontamination: rows that hold a passage of the benchmark go;
4. pii: personal data and terms that give it away are replaced in the texts;
5. byte_bpe: ids of what is left, decoded again and hashed.

Stages 1 to 4 return the columns of ``documents``. Empty tables pass through;
null texts count as empty; repeated rows are copies of each other.
"""

from __future__ import annotations

from spanpref.llm import bpe, decontaminate, pii, simhash, toxicity
from spanpref.llm.common import staged, table


def drop_toxic(spark, docs, sf_dir):
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark, docs, sf_dir):
    return simhash.deduplicate(docs, simhash.SHINGLE, simhash.MAX_BITS)


def drop_contaminated(spark, docs, sf_dir):
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark, docs, sf_dir):
    return pii.sanitise(docs)


def encode(spark, docs, sf_dir):
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("byte_bpe", encode),
]

#: Trained models, graph components and banded alignment are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
