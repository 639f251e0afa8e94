"""The training-data pipeline: five operators of orograph.llm one after the other over the documents table.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it works on all that the stage before kept, and its decisions take
effect. All but the last return the columns of documents. The mix takes a document up to twice, so ids may repeat in what it and
the encoder return."""

from orograph.llm import bpe, exact_dedup, mixing, near_dedup, quality
from orograph.llm.shared import scratch_dir


def quality_rules(spark, docs, sf_dir):
    """Documents that a rule rejects go."""
    return quality.filter_quality(docs)


def exact_copies(spark, docs, sf_dir):
    """Of equal texts the largest id stays."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark, docs, sf_dir):
    """Of each class of near copies the smallest id stays."""
    return near_dedup.drop_near(docs)


def source_mix(spark, docs, sf_dir):
    """Sources at their target weights: rows go, stay or come twice."""
    return mixing.take_rows(docs, mixing.decide(docs))


def encode(spark, docs, sf_dir):
    """``doc_id, source, n_tokens, ids_sha256, decoded_sha256`` of every row."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("doc_id", "source"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("minhash near-dedup", near_copies),
    ("source mixing", source_mix),
    ("bpe encoding", encode),
]

#: Near copies can't be found in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows; what each stage returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = scratch_dir(spark, "stage-" + name.replace(" ", "-"))
        out.write.parquet(path)
        docs = spark.read.parquet(path)
