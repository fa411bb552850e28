"""The training-data pipeline: stages over documents, each written as Parquet and read again by the next one."""

from __future__ import annotations

from ledgerloom.llm import stages
from ledgerloom.llm.common import stored, table

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("line dedup", stages.drop_boilerplate_lines),
    ("n-gram Jaccard join", stages.keep_one_of_a_class),
    ("mixing sources to target weights", stages.mix_sources),
    ("SentencePiece encoding and decoding", stages.encode_pieces),
]

#: Not expressible in SQL: boosted trees, Newton iterations and sampled segmentations.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows over the documents in sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
