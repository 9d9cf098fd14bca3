"""A corpus pipeline: toxicity, near duplicates, personal data, mixing, packing. Each stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import stored, table
from tidemill.llm.mixing import mix_sources
from tidemill.llm.packing import pack_documents
from tidemill.llm.pii import find_pii, sanitised
from tidemill.llm.signature_tree import jaccard_components
from tidemill.llm.toxicity import score_toxicity, trained


def keyed(df: DataFrame) -> DataFrame:
    """One row per doc_id, so that joins on the id add no rows."""
    return df.dropDuplicates(["doc_id"])


#: Ids up to which documents are dropped by a broadcast; beyond, by a shuffled join.
BROADCAST_IDS = 2_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is not in ids."""
    ids = stored(ids.select("doc_id").distinct(), "ids")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(docs.columns)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine, trained on the labelled documents of sf_dir, does not call toxic.

    Null, empty and wordless texts are not toxic and stay, as do rows without a doc_id; texts of any length are read whole.
    Repeated rows are judged alike; rows of one doc_id go if one of their texts is toxic. An empty table stays empty, and
    without labels of both kinds nothing goes. Columns of any name pass through.
    """
    return without(docs, score_toxicity(docs, trained(spark, sf_dir)).where("predicted = 1"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of texts with similar sets of five-word shingles (0.8 or more).

    The smallest doc_id of a component stays, so there are no ties; null, empty and blank texts are alike to nothing and
    stay, as do rows without a doc_id. Repeated rows of one doc_id stay or go together. Texts of any length are read
    whole; an empty table stays empty. Columns of any name pass through.
    """
    return without(docs, jaccard_components(docs, width=5, percent=80).where("doc_id <> component_id"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced and revealing terms removed or generalised; n_chars follows a changed text.

    Every row stays. Null texts stay null, empty ones empty; texts of any length are read whole. Repeated rows give
    evidence once and change alike; of overlapping spans the first, then the shorter one counts. An empty table stays
    empty. Columns of any name pass through.
    """
    found = find_pii(docs, keep=[c for c in docs.columns if c != "text"])
    # named apart from `text`, as expressions of one select may see each other's names
    made = found.select("kept", F.col("text").alias("old"), (F.size("spans") > 0).alias("changed"), sanitised(F.col("text"), F.col("spans")).alias("new"))
    new = {"text": F.when(F.col("changed"), F.col("new")).otherwise(F.col("old")), "n_chars": F.when(F.col("changed"), F.length("new").cast("long")).otherwise(F.col("kept.n_chars"))}
    return made.select(*[(new[c] if c in new else F.col(f"kept.`{c}`")).alias(c) for c in docs.columns])


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each selected document as often as its epochs say.

    Null languages and sources are leaves of their own ('unknown'); null and empty texts count as one token. Documents are
    taken in the order of a seeded hash, ties by doc_id; repeated rows of one doc_id are taken as often as the first of
    them, rows without a doc_id never. A text of any length is taken whole. An empty table stays empty. Columns of any
    name pass through.
    """
    chosen = keyed(mix_sources(docs)).select("doc_id", "epochs").withColumnsRenamed({"doc_id": "_id", "epochs": "_epochs"})
    taken = docs.join(chosen, F.col("doc_id") == F.col("_id"))
    return taken.withColumn("_epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_epochs")))).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training bins: bin_id, start, doc_id, piece, n_tokens and first_token of every piece.

    Null and empty texts take one token, their end; very long ones are cut into pieces. Copies by the text (the
    epochs of a document and repeated rows) share no bin, nor do documents of one source; null sources conflict with
    nothing. Ties go by doc_id, then piece. An empty table gives no bins; further columns are left out.
    """
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
