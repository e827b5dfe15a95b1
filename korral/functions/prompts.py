"""Prompt rendering as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from korral.functions.ids import content_sha

#: Fixed value: the instruction that follows a question in chat.
CHAT_SUFFIX = "\n\nPlease reason step by step, and put your final answer within \\boxed{}."
#: Templates by variant; ``{question}`` and ``{exemplars}`` are filled in. Native chat goes to the model's own template.
TEMPLATES = {
    "plain": "Question: {question}\n\nReason step by step and put the final answer within \\boxed{}.\n\nSolution:",
    "fewshot": "{exemplars}Question: {question}\n\nSolution:",
}
NATIVE = "native_chat"


def exemplars(rows: list[dict[str, str]]) -> str:
    return "".join(f"Question: {r['question']}\n\nSolution: {r['solution']} The answer is \\boxed{{{r['answer']}}}.\n\n" for r in rows)


def permitted(model: Column, variant: str, variants: Column) -> Column:
    """The variant, failing for a model that doesn't permit it."""
    return F.when(F.array_contains(variants, variant), F.lit(variant)).otherwise(F.raise_error(F.concat_ws(" ", model, F.lit("doesn't permit"), F.lit(variant))))


def render(question: Column, model: Column, variant: str, shots: list[dict[str, str]] | None = None) -> Column:
    """A struct of the prompt text, or the chat messages, and the prompt's hash."""
    if variant == NATIVE:
        content = F.concat(question, F.lit(CHAT_SUFFIX))
        messages = F.array(F.create_map(F.lit("role"), F.lit("user"), F.lit("content"), content))
        return F.struct(F.lit(None).cast("string").alias("text"), messages.alias("messages"), content_sha(F.concat_ws("|", F.lit(NATIVE), model, content)).alias("prompt_sha"))
    if variant not in TEMPLATES:
        raise ValueError(f"unknown prompt variant {variant!r}")
    before, after = TEMPLATES[variant].replace("{exemplars}", exemplars(shots or [])).split("{question}")
    text = F.concat(F.lit(before), question, F.lit(after))
    return F.struct(text.alias("text"), F.lit(None).cast("array<map<string,string>>").alias("messages"), content_sha(text).alias("prompt_sha"))
