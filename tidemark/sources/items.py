"""Benchmark rows as evaluation items: one projection for each source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T

_LETTERS = "ABCDEFGHIJ"


def _options(question: Column, options: Column, key: Column) -> tuple[Column, Column]:
    """Prompt and answer letter of options of which the first is right, turned by a stable offset."""
    offset = T.rotation(key, 4)
    return T.choice_prompt(question, T.rotated(options, offset)), T.rotated_letter(offset)


def _gpqa(d: DataFrame) -> tuple[Column, Column]:
    wrong = [F.col(f"Incorrect Answer {k}") for k in (1, 2, 3)]
    return _options(F.col("Question"), F.array(F.col("Correct Answer"), *wrong), F.concat(F.lit("gpqa_"), F.col("Record ID").cast("string")))


def _arc(d: DataFrame) -> tuple[Column, Column]:
    listed = F.zip_with("choices.label", "choices.text", lambda a, b: F.concat(a, F.lit(". "), b))
    return F.array_join(F.concat(F.array(F.col("question"), F.lit("")), listed, F.array(F.lit(""), F.lit("Answer with one choice letter."))), "\n"), F.col("answerKey")


#: Category, and prompt and reference of each source's rows.
SOURCES: dict[str, tuple[str, Callable[[DataFrame], tuple[Column, Column]]]] = {
    "gsm8k": ("math", lambda d: (F.col("question"), F.col("answer"))),
    "svamp": ("math", lambda d: (F.concat_ws(" ", "Body", "Question"), F.col("Answer").cast("string"))),
    "math_500": ("math", lambda d: (F.col("problem"), F.coalesce(F.nullif(F.col("answer"), F.lit("")), F.col("solution")))),
    "arc_challenge": ("logic", _arc),
    "mmlu_pro": ("logic", lambda d: (T.choice_prompt(F.col("question"), F.col("options")), F.col("answer"))),
    "gpqa_diamond": ("logic", _gpqa),
    "mbpp": ("code", lambda d: (F.col("text"), F.col("code"))),
    "aime2024": ("math", lambda d: (F.col("problem"), F.col("solution"))),
    "aime2025": ("math", lambda d: (F.col("problem"), F.col("answer").cast("string"))),
    "humaneval": ("code", lambda d: (F.col("prompt"), F.col("canonical_solution"))),
}


def eval_items(rows: DataFrame, source: str, problem_id: Column, split: str = "test") -> DataFrame:
    """``dataset, problem_id, prompt, reference, category, split``."""
    category, shape = SOURCES[source]
    prompt, reference = shape(rows)
    return rows.select(F.lit(source).alias("dataset"), problem_id.cast("string").alias("problem_id"), prompt.alias("prompt"), reference.alias("reference"), F.lit(category).alias("category"), F.lit(split).alias("split"))


def render_template(template: str, values: dict[str, Column]) -> Column:
    """A template with ``{name}`` fields filled in."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out
