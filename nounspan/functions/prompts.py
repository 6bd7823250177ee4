"""Prompt texts for translation and for judging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording is part of the experiment and must not change.
# Each entry is the text before and after the passage.
TEMPLATES = {
    "instruction": (
        "Translate the following sentence into German. "
        'Reply only with the translation. Sentence: "',
        '"',
    ),
    "flan": ("", "\n\nTranslate this to German?"),
}
JUDGE_HEAD = (
    "\nIf the following sentence contains the German translation for the English word '"
)
JUDGE_MIDDLE = (
    "', tell me which overt gender it displays among Masculine, Feminine, Gender-Neutral, "
    "or Gender-Inclusive. If no translation is found, reply with None.\nSentence: '"
)
JUDGE_TAIL = "'\n"
# The words a judge may answer with.
INCLUSIVE, FEMININE, NEUTRAL, MASCULINE, NONE = (
    "Gender-Inclusive",
    "Feminine",
    "Gender-Neutral",
    "Masculine",
    "None",
)
NOT_JUDGED = "N/A"
# Name parts of models that want a chat message.
CHAT_MODELS = ("mixtral", "llama")


def fill_template(text: Column, template_id: str | None) -> Column:
    """Prompt for a passage; no template leaves the passage as it is."""
    if template_id is None:
        return text
    if template_id not in TEMPLATES:
        raise NotImplementedError(f"unknown prompt template {template_id!r}")
    head, tail = TEMPLATES[template_id]
    return F.concat(F.lit(head), text, F.lit(tail))


def build_prompt(seed_noun: Column, translation: Column) -> Column:
    """Question put to the judge about one translation."""
    return F.concat(
        F.lit(JUDGE_HEAD), seed_noun, F.lit(JUDGE_MIDDLE), translation, F.lit(JUDGE_TAIL)
    )


def wants_chat(model_id: str) -> bool:
    return any(part in model_id.lower() for part in CHAT_MODELS)
