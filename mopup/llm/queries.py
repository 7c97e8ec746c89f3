"""The registered queries of the training-data operators (one ``opN_<name>`` each)."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import format_chats
from .decontaminate import find_items
from .mixing import mix
from .ngram_join import near_duplicates
from .oracles import ORACLES  # noqa: F401 - read by the entry point
from .periodic_runs import collapse_runs, longest_exponent
from .pii import KINDS as PII_KINDS
from .pii import key_of, pseudonymize
from .quality_rules import quality_rules
from .secrets import scan_secrets
from .sharding import shard_documents
from .substring_dedup import remove_repeats
from .toxicity import score_texts, train
from .url_filter import filter_urls
from .whitening import whiten


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, whatever folder they start
    in; on a cluster, install the package or ship it with --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"),
                        "spans", "n_layers", "n_streamed")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), with_text=False)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return score_texts(docs, train(docs, _table(spark, sf_dir, "labels")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), with_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "lost_chars")


def op8_pseudonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymize(_table(spark, sf_dir, "documents").select("doc_id", "text"), key=key_of(spark), counts="pii")
    return out.select("doc_id", "text", *[F.col(f"pii.{k}").alias(f"n_{k}") for k in PII_KINDS])


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: Tools of the calls that ``tool_view`` makes.
TOOLS = {
    "measure": {"type": "object", "required": ["chars", "role"], "additionalProperties": False, "properties": {
        "chars": {"type": "integer", "minimum": 1}, "role": {"type": "string", "enum": ["user"]}}},
    "answer": {"type": "object", "required": ["after"], "properties": {"after": {"type": "object"}, "turn": {
        "type": "integer", "maximum": 6}}},
}


def tool_view(conversations: DataFrame) -> DataFrame:
    """The conversations with tool traffic made from them: each user turn is followed by an assistant
    message with two calls, the second named first and waiting for the other's result, and each
    assistant turn is followed by the result of the turn before it.  All given rows stay."""
    base = conversations.select("conv_id", (F.col("turn") * 3).alias("turn"), "role", "text")
    name = F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"))
    first, second = F.concat(name, F.col("turn"), F.lit("a")), F.concat(name, F.col("turn"), F.lit("b"))
    calls = F.concat(
        F.lit('{"tool_calls":[{"id":"'), second, F.lit('","name":"answer","arguments":{"turn":'), F.col("turn"),
        F.lit(',"after":{"$ref":"'), first, F.lit('"}}},{"id":"'), first,
        F.lit('","name":"measure","arguments":{"role":"user","chars":'),
        F.coalesce(F.length("text"), F.lit(0)), F.lit("}}]}"))
    result = F.concat(F.lit('{"tool_call_id":"'), name, F.col("turn") - 1, F.lit('b","content":'),
                      F.coalesce(F.length("text"), F.lit(0)), F.lit("}"))
    made = conversations.filter("role = 'user'").select(
        "conv_id", (F.col("turn") * 3 + 1).alias("turn"), F.lit("assistant").alias("role"), calls.alias("text"))
    answers = conversations.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") * 3 + 1).alias("turn"), F.lit("tool").alias("role"), result.alias("text"))
    return base.unionByName(made).unionByName(answers)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(tool_view(_table(spark, sf_dir, "conversations")), TOOLS)


def period_view(documents: DataFrame) -> DataFrame:
    """The documents, a tenth of them (chosen by a hash of the id) with a tail that repeats a few words."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, n = F.floor(h / 10), F.size("w")
    a = F.pmod(F.col("g"), F.col("n")).cast("int")
    p = (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int")
    turned = F.transform(F.col("w"), lambda x, i: F.when(i < F.col("a"), x).otherwise(
        F.get(F.col("w"), F.col("a") + F.pmod(i - F.col("a"), F.col("p")))))
    plain = documents.select("doc_id", "text", h.alias("h"), g.alias("g"))
    tailed = F.coalesce(F.col("h") % 10 == 0, F.lit(False)) & F.col("text").isNotNull()
    # only the chosen rows are split into words
    return plain.select("doc_id", "text", "g", F.when(tailed, words).alias("w")).select(
        "*", F.when(n > 0, n).alias("n")).select("*", a.alias("a")).select("*", p.alias("p")).select(
        "doc_id", F.when(F.col("n").isNotNull(), F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(period_view(_table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest_exponent(F.col("runs")).alias("best"),
                        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed_text", 256).alias("collapsed_sha256"))
    b = F.col("best")
    return best.select(
        "doc_id", "n_runs", b["start"].alias("start"), b["length"].alias("length"), b["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op12_shard_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(_table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_ngram_join, op2_secret_scan, op3_decontaminate, op4_substring_dedup, op5_mix_sources, op6_toxicity, op7_quality_rules,
        op8_pseudonymize, op9_url_filter, op10_chat_format, op11_periodic_runs, op12_shard_packing, op13_embedding_whitening)
}
