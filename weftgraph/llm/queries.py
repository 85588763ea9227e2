"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import digests, remove_repeats

    return digests(remove_repeats(table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold
    from .toxicity import classify, train

    docs = table(spark, sf_dir, "documents")
    net = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs, net).select("doc_id", (fold() == 2).alias("held_out"), "score", "predicted")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .quality import classify, train

    docs = table(spark, sf_dir, "documents")
    weights = train(docs, table(spark, sf_dir, "labels"))
    scored = classify(docs.select("doc_id", "text", "lang", "source"), weights, F.col("source"), F.concat_ws("/", "source", "lang"))
    return scored.select("doc_id", "host", "path", "evidence", "host_mean", "path_mean", "quality_score", "keep")


def op5_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold
    from .langid import identify, train

    docs = table(spark, sf_dir, "documents")
    return identify(docs, *train(docs)).select("doc_id", (fold() == 2).alias("held_out"), "lang_pred", "score")


#: The key of the registered query's surrogates; in production it comes from a secret store.
PII_KEY = "weftgraph"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pseudonymise

    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secrets, train

    return secrets(table(spark, sf_dir, "documents"), train())


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests, encode

    return digests(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path()))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op11_oneperm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .oneperm import half_edited

    return half_edited(table(spark, sf_dir, "documents"))


def op12_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turns import digests, reassembled

    return digests(reassembled(table(spark, sf_dir, "conversations")))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import by_component

    return by_component(table(spark, sf_dir, "embeddings"))


def tokenizer_path() -> str:
    """The byte-level BPE file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}
