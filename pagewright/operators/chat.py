"""Messages, prompts, citations and model fields as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Default models of a deployment, each with its context and how many results it gets.
PROFILES = {"": ("chat-model", 12288, 8), "fast": ("chat-model", 12288, 8), "deep": ("chat-model-deep", 16384, 15)}

# Models that need a larger context, and that context.
WIDE_MODEL, WIDE_CONTEXT = r"(?i)^qwen3\.6:", 24576


def last_user_message(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turn, text of the last turn of role user."""
    return messages.where("role = 'user'").groupBy(key).agg(F.max("turn").alias("turn"), F.max_by("text", "turn").alias("text"))


def source_label(file: Column, page: Column, section: Column) -> Column:
    """Page 0 and empty sections count as unknown."""
    return F.concat(F.coalesce(F.when(file != "", file), F.lit("unknown")), F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit(" — p."), page.cast("string"))).otherwise(""), F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit(", §"), section)).otherwise(""))


def collections_of(models: DataFrame, others: tuple[str, ...] = ("rag-active",)) -> DataFrame:
    """name: what models (model_id) stand for, without profiles and handles, sorted and once each."""
    return models.where(~F.col("model_id").endswith("!deep") & ~F.col("model_id").isin(*others)).select(F.col("model_id").alias("name")).distinct().orderBy("name")


def reshaped(matches: DataFrame) -> DataFrame:
    """text, score (else the distance), file, section, page of matches, in which score may be null."""
    return matches.select("query_id", "text", F.coalesce("score", "distance").alias("score"), "file", "section", "page")


def allowed(*lists: Column) -> Column:
    """The union of allow-lists, without repeats."""
    out = F.array().cast("array<string>")
    for x in lists:
        out = F.array_union(out, F.coalesce(x, F.array().cast("array<string>")))
    return out


def stream_lines(deltas: DataFrame, sources: DataFrame, model: str, key: str = "conv_id") -> DataFrame:
    """key, n, line of a chat stream: deltas (key, n from 0, content, done), then the sources (key, sources) as a last delta, then the end mark."""
    fields = lambda delta, stop: F.struct(F.col(key).cast("string").alias("id"), F.lit("chat.completion.chunk").alias("object"), F.lit(model).alias("model"), F.array(F.struct(F.lit(0).alias("index"), delta.alias("delta"), stop.alias("finish_reason"))).alias("choices"))
    line = lambda delta, stop: F.concat(F.lit("data: "), F.to_json(fields(delta, stop), {"ignoreNullFields": "false"}), F.lit("\n\n"))
    some = F.struct(F.lit("assistant").alias("role"), F.col("content"))
    said = deltas.where("content <> ''").select(key, "n", line(some, F.when(F.col("done"), "stop")).alias("line"))
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    silent = deltas.where("coalesce(content, '') = ''").select(key, "n", line(empty, F.when(F.col("done"), "stop")).alias("line"))
    ends = deltas.groupBy(key).agg((F.max("n") + 1).alias("n"))
    cited = ends.join(sources.where("sources <> ''"), key).select(key, "n", line(F.struct(F.col("sources").alias("content")), F.lit(None).cast("string")).alias("line"))
    return said.unionByName(silent).unionByName(cited).unionByName(ends.select(key, (F.col("n") + 1).alias("n"), F.lit("data: [DONE]\n\n").alias("line")))


def citations(matches: DataFrame, key: str = "query_id", rank: str = "rank") -> DataFrame:
    """key, n, file, page, section, label, snippet of matches (file, page, section, text), numbered from 1."""
    label = source_label(F.col("file"), F.col("page"), F.col("section"))
    return matches.select(key, F.col(rank).alias("n"), "file", "page", F.coalesce("section", F.lit("")).alias("section"), label.alias("label"), F.substring("text", 1, 240).alias("snippet"), "text")


def numbered(cited: DataFrame, what: Column, between: str, key: str = "query_id") -> DataFrame:
    """key, block: `[n] what` of each citation in order."""
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), what)
    return cited.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))).alias("x")).select(key, F.array_join("x.line", between).alias("block"))


def prompts(questions: DataFrame, cited: DataFrame, rule: str, abstain: str, key: str = "query_id") -> DataFrame:
    """key, prompt, sources, answer: a system prompt with the numbered context; without matches the abstaining answer instead."""
    context = numbered(cited, F.concat(F.col("label"), F.lit("\n"), F.col("text")), "\n\n", key).withColumnRenamed("block", "context")
    sources = numbered(cited, F.col("label"), "\n", key).withColumnRenamed("block", "sources")
    rows = questions.join(context, key, "left").join(sources, key, "left")
    prompt = F.concat(F.lit(rule + "\n\nContext:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("question"))
    return rows.select(key, prompt.alias("prompt"), F.concat(F.lit("\n\n---\n**Sources**\n"), F.col("sources")).alias("sources"), F.when(F.col("context").isNull(), abstain).alias("answer"))


def resolved_model(field: Column) -> list[Column]:
    """collection, model, context and top_k of `collection[!profile]`; an unknown profile names a model."""
    raw = F.trim(F.coalesce(field, F.lit("")))
    at = F.instr(raw, "!")
    base = F.trim(F.when(at > 0, F.substring(raw, F.lit(1), at - 1)).otherwise(raw))
    profile = F.lower(F.trim(F.when(at > 0, F.substring(raw, at + 1, F.length(raw))).otherwise("")))
    pick = lambda i, other: F.when(profile == "deep", PROFILES["deep"][i]).when((profile == "") | (profile == "fast"), PROFILES[""][i]).otherwise(other)
    model = pick(0, profile)
    context = F.when(model.rlike(WIDE_MODEL), F.greatest(pick(1, F.lit(PROFILES[""][1])), F.lit(WIDE_CONTEXT))).otherwise(pick(1, F.lit(PROFILES[""][1])))
    return [base.alias("collection"), model.alias("model"), context.alias("context"), pick(2, F.lit(PROFILES[""][2])).alias("top_k")]


def model_catalog(collections: DataFrame, name: str = "collection") -> DataFrame:
    """Every collection bare and with !deep."""
    return collections.select(name).distinct().select(F.explode(F.array(F.col(name), F.concat(F.col(name), F.lit("!deep")))).alias("model_id"))


def sub_queries(question: Column, reply: Column, most: int = 5) -> Column:
    """The question, then the strings of the first JSON array in a reply but for copies of the question."""
    from ..functions.text import json_strings

    found = F.filter(F.transform(F.coalesce(json_strings(reply), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return F.concat(F.array(question), F.filter(F.slice(found, 1, most), lambda x: F.lower(x) != F.lower(question)))
