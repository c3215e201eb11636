"""Chat records: pairs to messages and back, and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import lexicon as L
from corpuslake.functions.text import normalize_for_scoring, source_of_prompt

# Prompt texts.
CORRECTION_SYSTEM = "You are an expert in the Urdu language."
CORRECTION_USER = "Please correct all the spelling and grammatical errors in the following text:\n"
GENERATION_SYSTEM = "You are an Urdu grammar error generation expert. Generate controlled Urdu error sentences for NLP research. Keep Urdu script. Do not translate. Return valid JSON only."
GENERATION_HEAD = "Original Urdu sentence:\n"
GENERATION_RULES = (
    "Return JSON only. Do not output markdown or extra explanation.",
    "The JSON must contain exactly 6 objects.",
    "The order must match the 6 target error types.",
    "Each object must contain:\n   - error_type\n   - error_sentence\n   - changed_part",
    "The error_sentence must still be Urdu.",
    "Do not copy the original sentence as the error sentence.",
    "Each error sentence should contain only the target error type.",
    "Make the minimum necessary edit.",
)

MESSAGES = "messages array<struct<role:string,content:string>>"


def error_type_text() -> str:
    return "\n".join(f"{i}. error_type: {t}\n   instruction: {text}" for i, (t, _, _, text) in enumerate(L.ERROR_TYPES, 1))


def generation_tail() -> str:
    """What follows the sentence in the prompt for six error samples."""
    rules = "\n".join(f"{i}. {r}" for i, r in enumerate(GENERATION_RULES, 1))
    shape = ",\n".join(f'    {{"error_type": "{t}", "error_sentence": "...", "changed_part": "..."}}' for t, *_ in L.ERROR_TYPES)
    return f"\n\nGenerate exactly 6 error samples for the original sentence.\n\nTarget error types, in this exact order:\n{error_type_text()}\n\nStrict requirements:\n{rules}\n\nJSON format:\n{{\n  \"errors\": [\n{shape}\n  ]\n}}\n\n/no_think"


def generation_prompt(sentence: Column) -> Column:
    """The user prompt that asks for six error samples of a sentence."""
    return F.concat(F.lit(GENERATION_HEAD), sentence, F.lit(generation_tail()))


def correction_messages(sentence: Column) -> Column:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(message("system", F.lit(CORRECTION_SYSTEM)), message("user", F.concat(F.lit(CORRECTION_USER), sentence)))


def generation_messages(sentence: Column) -> Column:
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(message("system", F.lit(GENERATION_SYSTEM)), message("user", generation_prompt(sentence)))


def merged_user_text(messages: Column) -> Column:
    """The last system text, a blank line and the last user text, for templates without a system role."""
    last = lambda role: F.trim(F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == role), F.lit(-1))["content"], F.lit("")))
    return F.when(last("system") != "", F.concat_ws("\n\n", last("system"), last("user"))).otherwise(last("user"))


def plain_prompt(messages: Column) -> Column:
    """The prompt for a generator without any template."""
    return F.concat(merged_user_text(messages), F.lit("\n\nCorrected sentence:"))


def render(tokenizer, messages: list[dict[str, str]]) -> str:
    """A tokenizer's own template: as it is, else without the thinking flag, else without the system role, else plain text."""
    system = next((m["content"].strip() for m in reversed(messages) if m["role"] == "system"), "")
    user = next((m["content"].strip() for m in reversed(messages) if m["role"] == "user"), "")
    merged = f"{system}\n\n{user}" if system else user
    for own, flags in ((messages, {"enable_thinking": False}), (messages, {}), ([{"role": "user", "content": merged}], {})):
        try:
            return tokenizer.apply_chat_template(own, tokenize=False, add_generation_prompt=True, **flags)
        except Exception:  # templates raise errors of many kinds for what they don't support
            continue
    return f"{merged}\n\nCorrected sentence:"


def chat_json(bad: Column, good: Column) -> Column:
    """The JSON line of a pair: system, user and assistant messages."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(message("system", F.lit(CORRECTION_SYSTEM)), message("user", F.concat(F.lit(CORRECTION_USER), bad)), message("assistant", good))
    return F.to_json(F.struct(messages.alias("messages")))


def to_chat_json(df: DataFrame) -> DataFrame:
    """value: a JSON line for each pair of incorrect_sentence and correct_sentence."""
    return df.select(chat_json(F.col("incorrect_sentence"), F.col("correct_sentence")).alias("value"))


def pair_of_line(line: Column) -> Column:
    """struct(error_sentence, correct_sentence) of a JSON line: the last user and last assistant message, or the first of the known
    keys that isn't empty. Fields are null where the line is no JSON object."""
    fields = [f"`{k}` string" for k in dict.fromkeys((*L.SOURCE_KEYS, *L.TARGET_KEYS))]
    o = F.from_json(line, ", ".join([MESSAGES, *fields, "_corrupt string"]), {"allowSingleQuotes": "false", "columnNameOfCorruptRecord": "_corrupt"})
    last = lambda role: F.try_element_at(F.filter(o["messages"], lambda m: m["role"] == role), F.lit(-1))["content"]
    first = lambda keys: F.coalesce(*[F.nullif(o[k], F.lit("")) for k in keys], F.lit(""))
    chat = o["messages"].isNotNull()
    bad = F.when(chat, source_of_prompt(F.coalesce(last("user"), F.lit("")))).otherwise(first(L.SOURCE_KEYS))
    good = F.when(chat, F.coalesce(last("assistant"), F.lit(""))).otherwise(first(L.TARGET_KEYS))
    ok = line.rlike(r"(?s)^\s*\{.*\}\s*$") & o["_corrupt"].isNull()
    return F.when(ok, F.struct(normalize_for_scoring(bad).alias("error_sentence"), normalize_for_scoring(good).alias("correct_sentence")))
