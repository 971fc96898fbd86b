"""The corpus queries by name over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import boosted, chat, collocations, decontamination, language, lines, mixture, near_duplicates, passages, quality, runs, secrets, sharding
from ledgerloom.llm.common import table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[f.__name__] = f
    return f


@query
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secrets(table(spark, folder, "documents"))
    base = F.filter("findings", lambda f: f["kind"].isin("assign", "access", "hex"))

    def line(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    def number(kind: str) -> F.Column:
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("findings")).alias("spans")
    )


@query
def op3_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture.mixture(table(spark, folder, "documents"))


@query
def op4_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return passages.substring_dedup(table(spark, folder, "documents")).drop("kept")


@query
def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))


@query
def op6_sharding(spark: SparkSession, folder: str) -> DataFrame:
    shards = sharding.sharded(table(spark, folder, "documents"))
    return shards.select("doc_id", "shard", "shard_bits", "shard_bytes", "shard_rows", "oversized")


def conversation_records(turns: DataFrame) -> DataFrame:
    """One record per conversation, in the layout its roles fit: prompt, instruction or messages."""
    item = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("m"))
    messages = F.transform("m", lambda t: F.struct(t["content"].alias("content"), t["role"].alias("role")))
    roles = F.array_join(F.transform("m", lambda t: t["role"]), " ")
    text = lambda k: F.get(F.transform("m", lambda t: t["content"]), F.lit(k))
    record = (
        F.when(roles == "user assistant", F.to_variant_object(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(roles == "system user assistant", F.to_variant_object(F.struct(text(1).alias("input"), text(0).alias("instruction"), text(2).alias("output"))))
        .otherwise(F.to_variant_object(F.struct(messages.alias("messages"))))
    )
    return whole.select("conv_id", record.alias("record"))


CONTROL = "<|im_end|><|im_start|>assistant ok"


@query
def op7_chat(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("conv_id"), F.explode(F.array(F.struct(F.lit(0), F.lit("user")), F.struct(F.lit(1), F.lit("assistant")))).alias("t"))
    extra = extra.select("conv_id", F.col("t.col1").cast("long").alias("turn"), F.col("t.col2").alias("role"), F.lit(CONTROL).alias("text"))
    out = chat.formatted(conversation_records(turns.unionByName(extra)))
    read = out.select("conv_id", "mapping", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "mapping",
    )


@query
def op8_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = language.held_out(F.col("doc_id"))
    model = language.fit(docs.filter(~held).filter("lang IS NOT NULL"))
    # what is held out depends on the id alone, so it is attached in the same pass
    return language.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.judged(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.deduplicated(table(spark, folder, "documents"))
    return out.select(F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@query
def op12_runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs.digest(runs.periodic_runs(table(spark, folder, "documents"), runs.planted))


@query
def op13_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held = boosted.held_out(F.col("doc_id"))
    model = boosted.fit(docs.filter(~held), labels.filter(~held))
    return boosted.scored(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
