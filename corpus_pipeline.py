"""The corpus pipeline: quality filter, near-dedup, decontamination, PII surrogates, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns the documents that go on. run() applies
them to `documents`, each stage's rows written to shared storage and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import queries
from tallyloom.llm.bpe import encode
from tallyloom.llm.decontaminate import find_contamination
from tallyloom.llm.pii import replace_checked
from tallyloom.llm.quality import held_out, score, train
from tallyloom.llm.simhash import near_copies
from tallyloom.storage import Workspace


def _apart(docs: DataFrame) -> tuple[DataFrame, list]:
    """(docs whose further columns have names that no operator gives, the expressions that name them as before)."""
    own = {c: c if c in ("doc_id", "text") else f"further_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*own.values()), [F.col(new).alias(old) for old, new in own.items()]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier accepts (score >= 0.3); null texts are judged as empty ones."""
    rows, back = _apart(docs)
    model = train(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out())
    return score(rows, model).where("predicted = 1").select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, Jaccard 0.8): the one with the smallest id, once.

    Null and blank texts are copies of each other; rows without an id stay; of rows with one id and one text, one stays, and of rows with one id and
    different texts those that are copies of no smaller id's.
    """
    groups = near_copies(docs)
    gone = groups.where("doc_id <> component_id").select("doc_id", "mark").distinct()
    kept = docs.join(gone, (docs.doc_id == gone.doc_id) & (F.xxhash64(docs.text) == gone.mark), "left_anti")
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():  # else no text has to move for this
        kept = kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))
    return kept.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents in which a benchmark window of 10 words occurs."""
    rows, back = _apart(docs)
    found = find_contamination(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), size=10)
    return found.where(F.size("hit_spans") == 0).select(*back)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; n_chars, where there is such a column, follows the new text."""
    rows, back = _apart(docs)
    out = replace_checked(rows, queries.PII_KEY).select(*back)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Add the token ids of every text (null: none) as token_ids."""
    import public_tokenizers

    return encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII surrogates", surrogates),
    ("BPE encoding", tokens),
]

#: SQL can express neither the classifier nor the transducer; tests/llm/test_pipeline.py compares run() with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        new = ws.cut(stage(spark, docs, sf_dir))
        ws.drop(docs)
        docs = new
    return docs
