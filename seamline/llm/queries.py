"""One query per operator of this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import seamline as sl
from seamline.llm import dialogues, language, merkle, quality, toxicity
from seamline.llm.common import remainder, table
from seamline.llm.mixing import mix
from seamline.llm.minhash import near_duplicates
from seamline.llm.packing import pack, pieces
from seamline.llm.pii import replace_entities
from seamline.llm.slack import pack_tightly
from seamline.llm.urls import filter_urls
from seamline.llm.vectors import similar_vectors
from seamline.llm.warc import read_archives, with_originals, write_archives
from seamline.storage import new_path, store


#: The key of the registered queries; a real corpus has a secret one of its own.
SURROGATE_KEY = b"registered query"


def tokenizer_path() -> str:
    """Where the public tokenizer lies on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _op1(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack(pieces(table(spark, folder, "documents"), tokenizer_path(), digest=True))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _held_out(modulus: int, value: int) -> Column:
    """Whether the crc32 of the id has this remainder; a null id is not held out."""
    return F.coalesce(remainder("doc_id", modulus) == value, F.lit(False)).alias("held_out")


def _op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs.where(remainder("doc_id", 4) != 2))
    rows = docs.select("doc_id", _held_out(4, 2), "text")
    return language.identify(rows, model)


def _op3(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"))


def _op4(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents")).select("doc_id", "_mix.*")


def _op5(spark: SparkSession, folder: str) -> DataFrame:
    return similar_vectors(table(spark, folder, "embeddings"))


def _op6(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return judged.select("doc_id", *[f"_measured.{c}" for c in quality.COUNTS], "base_failed", "kept")


def _op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return replace_entities(docs, SURROGATE_KEY, count_column="n_replaced")


def _op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").where(remainder("doc_id", 5) != 0)
    network = toxicity.fit(docs, labels)
    return toxicity.score(docs.select("doc_id", _held_out(5, 0), "text"), network)


def _op9(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def _op10(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "archives")
    write_archives(table(spark, folder, "pages"), path)
    records = with_originals(store(read_archives(spark, path, payloads=False), "records"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with a fault put into one row in four, by a checksum of its place."""
    place = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(place[0], F.lit(":"), place[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    unended = F.translate(text, "".join(dialogues.ENDINGS), "")
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault"))
    return rows.where("fault <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, unended).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")


def _op11(spark: SparkSession, folder: str) -> DataFrame:
    conversations = table(spark, folder, "conversations")
    done = dialogues.repair_conversations(damaged(conversations))
    report = done.report.withColumnRenamed("conv_id", "of")
    digests = dialogues.line_digests(done.lines).withColumnRenamed("conv_id", "lines_of")
    found = (
        conversations.select("conv_id")
        .distinct()
        .join(report, F.col("conv_id").eqNullSafe(F.col("of")), "left")
        .join(digests, F.col("conv_id").eqNullSafe(F.col("lines_of")), "left")
    )
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return found.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def _op12(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack_tightly(table(spark, folder, "documents"), tokenizer_path())
    digest = F.crc32("ids").alias("ids_crc32")
    return packed.select("doc_id", "start", "length", digest, "doc_tokens", "sequence_id", "offset")


def _op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every document proved; the n_chars of one in seven are altered in the copy that is checked."""
    docs = table(spark, folder, "documents")
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    more = F.when(remainder("doc_id", 7) == 0, 1).otherwise(0)
    altered = [F.col(c) + more if c == "n_chars" else F.col(c) for c in fields]
    tree = merkle.manifest(docs, fields, "doc_id", "lang", altered)
    return merkle.prove(tree).select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_QUERIES = {
    "op1_packing": _op1,
    "op2_language": _op2,
    "op3_urls": _op3,
    "op4_mixing": _op4,
    "op5_vectors": _op5,
    "op6_quality": _op6,
    "op7_pii": _op7,
    "op8_toxicity": _op8,
    "op9_minhash": _op9,
    "op10_warc": _op10,
    "op11_repair": _op11,
    "op12_slack": _op12,
    "op13_merkle": _op13,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(query):
        def run(spark, folder):
            sl.ship(spark)
            return query(spark, folder)

        return run

    return {name: shipped(query) for name, query in _QUERIES.items()}
