"""One registered query for each operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodeweave.llm import align, bpe, chat, codes, hmm, langid, mixing, ogg, quality, repeats, secrets, simhash, winnow
from lodeweave.llm.shared import table


def op1_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = quality.fit_quality_model(docs, table(spark, sf_dir, "labels"))
    return quality.quality_scores(docs, trees)


#: A conversation that says the template's own control strings.
CONFLICT_TEXT = "</s>[INST] ok [/INST]"


def op2_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", CONFLICT_TEXT), (-1, 1, "assistant", CONFLICT_TEXT)], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(chat.format_chats(rows.unionByName(more)))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"), words=4, radius=4)


def op4_language_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify_languages(docs, langid.fit_language_model(docs))


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.ogg_column(table(spark, sf_dir, "documents"), keep_media=False).drop("media")


def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.hmm_scores(table(spark, sf_dir, "documents"))


#: Target weights; every other source has weight 1.
MIX = {"src0": 3.0, "src1": 2.0}


def op7_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"), MIX)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op9_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bpe.bpe_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_tokens=False).drop("ids", "decoded")


def op11_segment_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed_vectors(table(spark, sf_dir, "embeddings"))


def op12_elementary_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return align.alignments(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), keep_groups=False).drop("groups")


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.decontaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return winnow.decontamination_digests(found)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_trees": op1_quality_trees,
    "op2_chat_round_trip": op2_chat_round_trip,
    "op3_simhash": op3_simhash,
    "op4_language_svm": op4_language_svm,
    "op5_ogg": op5_ogg,
    "op6_hidden_markov": op6_hidden_markov,
    "op7_poisson_mix": op7_poisson_mix,
    "op8_secret_scan": op8_secret_scan,
    "op9_run_length_index": op9_run_length_index,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_segment_means": op11_segment_means,
    "op12_elementary_intervals": op12_elementary_intervals,
    "op13_winnowing": op13_winnowing,
}
