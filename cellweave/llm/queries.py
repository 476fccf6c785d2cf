"""The operators as queries over the shared test tables, with SQL where SQL can tell the answer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table
from .turn_repair_sql import SQL as OP12_SQL

TOXIC = 0.3


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"), 200).drop("kept")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=1, length=2048, with_ids=False)


def op3_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrase_dedup import phrase_dedup

    return phrase_dedup(table(spark, sf_dir, "documents"), 50).drop("kept")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), k=5, percent=75)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_tokens, write_tokens

    path = f"{shared_dir(spark)}/cellweave-token-files-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), path, end_id=2)
    return read_tokens(spark, path, with_ids=False)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS norm FROM documents)
WINDOW w AS (PARTITION BY norm)
"""


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item of which the document holds half or more."""
    from .decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("fp")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model, TOXIC).select("doc_id", "held_out", "score", "predicted")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as the file source/lang/doc_id."""
    from .licenses import license_scan

    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return license_scan(files).select("doc_id", "path", "license", "score", "found_in", "license_from")


def op11_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .contextual_pii import find_pii

    return find_pii(table(spark, sf_dir, "documents"))[0]


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, by a checksum of conversation and turn; a dropped turn stays as a row with `gone`."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn"))) % 20
    text = F.when(how == 1, F.lit("")).when(how == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    copies = F.explode(F.when(how == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return conversations.select("conv_id", "turn", F.when(how == 4, F.lit("user")).otherwise(blank("role")).alias("role"), text.alias("text"), (how == 0).alias("gone"), copies.alias("copy")).drop("copy")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turn_repair import repair

    return repair(damaged(table(spark, sf_dir, "conversations")), gone="gone")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_alignment import cross_tokenizer

    return cross_tokenizer(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_packing, op3_phrase_dedup, op4_minhash, op5_token_files, op6_exact_dedup, op7_html_extract, op8_decontaminate, op9_toxicity, op10_licenses, op11_contextual_pii, op12_turn_repair, op13_token_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op12_turn_repair": OP12_SQL}
