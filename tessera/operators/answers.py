"""Classification of comments by a provider: prompts, label lists, checks of the answers, resumed runs.

An answer counts only if every field that has a list holds a value of that list; other answers are
asked again as failures are, and in the end give nulls and an error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from . import providers

# The dimensions of a review comment, the relations of an answer to it, and degrees of confidence.
DIMENSIONS = ("Conceptual & Novelty", "Technical Soundness", "Empirical Rigor", "Data & Reproducibility", "Presentation & Writing", "Deployment & Impact", "Other")
RELATIONS = ("corrective", "explanatory", "other_or_unclear")
CONFIDENCE = ("high", "medium", "low")
GROUNDING = ("future_changes", "new_experiments", "external_references", "grounded_in_paper")


def profile(model: Column) -> Column:
    """The family of a model by its name, which decides how it is asked."""
    low = F.lower(model)
    return (
        F.when(low.contains("gpt-oss"), "gpt-oss").when(low.contains("gemma-3"), "gemma3").when(low.contains("qwen3") & low.contains("thinking"), "qwen3-thinking")
        .when(low.startswith("gpt-5"), "openai-gpt5").otherwise("standard")
    )


def message_content(text: Column, family: Column) -> Column:
    """The content field of a message as JSON text: a list of typed parts for gemma3, else a string."""
    part = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"))))
    plain = F.regexp_extract(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    return F.when(family == "gemma3", part).otherwise(plain)


def message_text(content: Column) -> Column:
    """The text of a content field given as JSON: a string, or the texts of a list of strings and parts, joined; '' for others."""
    parts = F.transform(F.from_json(content, "array<string>"), lambda p: F.when(p.rlike(r"(?s)^\s*\{"), F.coalesce(F.get_json_object(p, "$.text"), F.lit(""))).otherwise(p))
    one = F.from_json(F.concat(F.lit('{"t":'), content, F.lit("}")), "t string")["t"]
    return F.coalesce(F.when(content.rlike(r"(?s)^\s*\["), F.array_join(parts, "")).when(content.rlike(r'(?s)^\s*"'), one), F.lit(""))


def content_types(answer: Column, mode: str = "four") -> Column:
    """The labels that an answer names, each once: its JSON's content_types (list or one), else known labels among its words."""
    body = F.from_json(tx.salvage_json(answer), "content_types string, content_type string")
    said = F.coalesce(body["content_types"], body["content_type"])
    listed = F.coalesce(F.when(said.rlike(r"^\s*\["), F.from_json(said, "array<string>")).otherwise(F.array(said)), F.array().cast("array<string>"))
    listed = F.filter(listed, lambda x: x.isNotNull())
    known = F.array(*map(F.lit, tx.LABELS[mode]))
    words = F.filter(known, lambda x: F.array_contains(F.split(F.lower(F.coalesce(answer, F.lit(""))), r"\W+"), x))
    low = F.transform(listed, lambda x: F.lower(F.trim(x)))
    return F.when(F.size(listed) > 0, F.array_distinct(F.filter(low, lambda x: F.array_contains(known, x)))).otherwise(words)


def grounding(answer: Column) -> Column:
    """An answer's four booleans and filter_out as a struct; null unless all four are JSON booleans."""
    body = tx.salvage_json(answer)
    said = {k: F.get_json_object(body, f"$.{k}") for k in GROUNDING}
    # from_json takes no quoted "true" for a boolean; get_json_object would
    strict = F.from_json(body, ", ".join(f"{k} boolean" for k in GROUNDING))
    flags = {k: F.when(said[k].isin("true", "false"), strict[k]) for k in GROUNDING}
    whole = F.struct(*(v.alias(k) for k, v in flags.items()), tx.filter_out(*flags.values()).alias("filter_out"))
    return F.when(F.forall(F.array(*flags.values()), lambda x: x.isNotNull()), whole)


def dimension_prompt(comment: Column) -> Column:
    """Asks for the dominant dimension of a reviewer's comment."""
    return F.concat(F.lit(f"Name the one dimension that this review comment is mainly about, as JSON {{\"category\": ...}}. Dimensions: {'; '.join(DIMENSIONS)}.\nComment:\n"), F.coalesce(comment, F.lit("")))


def relation_prompt(comment: Column, sentence: Column, references: Column) -> Column:
    """Asks how an author's sentence, with the places it names, answers a reviewer's comment."""
    ask = f"How does the author's sentence answer the comment? Say corrective if it shows the reviewer to be mistaken about the paper, explanatory if it explains or justifies, else other_or_unclear; give JSON with relation ({', '.join(RELATIONS)}), rationale (one sentence) and confidence ({', '.join(CONFIDENCE)})."
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit(ask + "\nComment:\n"), text(comment), F.lit("\nSentence:\n"), text(sentence), F.lit("\nReferences:\n"), text(references))


def classified(rows: DataFrame, keys: Sequence[str], prompt: str, provider: providers.Provider, allowed: Mapping[str, Sequence[str]], extra: Sequence[str] = (), done: DataFrame | None = None, **options) -> DataFrame:
    """rows with a string column for each field of allowed and extra, and error.

    done(keys, fields) is an earlier run: its rows whose listed fields are all valid are taken over (the
    least of repeated ones, as a whole) and not asked again. Rows with equal keys get the same earlier answer.
    """
    fields = [*allowed, *extra]
    schema = ", ".join(f"`{f}` string" for f in fields)
    ask = lambda df: providers.answered(df, prompt, provider, schema, allowed=allowed, **options)
    if done is None:
        return ask(rows)
    valid = done
    for f, known in allowed.items():
        valid = valid.where(F.col(f).isin(*known))
    valid = valid.groupBy(*keys).agg(F.min(F.struct(*(F.col(f).cast("string").alias(f) for f in fields))).alias("_a"))
    old = rows.join(valid, list(keys)).select(*rows.columns, *(F.col("_a")[f].alias(f) for f in fields), F.lit(None).cast("string").alias("error"))
    return old.unionByName(ask(rows.join(valid, list(keys), "left_anti").select(*rows.columns)))


def shares(rows: DataFrame, field: str, known: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, field, n, percentage of its group, 6 digits) for every value of known, those without rows too."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("_all"), *(F.count_if(F.col(field) == v).alias(f"_{k}") for k, v in enumerate(known)))
    each = F.explode(F.array(*(F.struct(F.lit(v).alias(field), F.col(f"_{k}").alias("n")) for k, v in enumerate(known)))).alias("_e")
    percent = F.round(100 * F.coalesce(F.try_divide("_e.n", "_all"), F.lit(0.0)), 6).alias("percentage")
    return counts.select(*by, "_all", each).select(*by, "_e.*", percent)
