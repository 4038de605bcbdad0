"""Requests to language and speech models: inputs, prompts and their guards."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from turnstream.functions.markers import MARKER, short_time, stripped, without_special_tokens
from turnstream.functions.scalars import spaced_alpha_num

# The frame around tool descriptions, and what stands for a refused conversation.
TOOLS_BEFORE = "Below is functions provided to convert user input into function parameters,\n<FUNCTION>\n"
TOOLS_BEHIND = "\n</FUNCTION>\nSometime user input is not able to convert to function parameters, so please ignore it and reply as normal chatbot."
REFUSAL = "the user is trying to access you with unapproriate way, please generate refusal response"


def language_field(language: Column) -> Column:
    """The language as a request states it: null where it is empty or the word null."""
    return F.nullif(F.nullif(language, F.lit("null")), F.lit(""))


@pandas_udf(StringType())
def pretty_json(text: pd.Series) -> pd.Series:
    """JSON with an indent of four; null where the text is none."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(json.loads(x), indent=4)
        except ValueError:
            return None

    return text.map(one)


def tools_prompt(tools: Column) -> Column:
    """The system text for an array of tool descriptions; empty if they have less than five characters."""
    joined = F.array_join(tools, "\n\n")
    return F.when(F.length(joined) < 5, "").otherwise(F.concat(F.lit(TOOLS_BEFORE), joined, F.lit(TOOLS_BEHIND)))


def with_system(messages: Column, prompt: Column) -> Column:
    """Messages (array<struct<role, content>>) with the prompt added to a leading system message, or as one; an empty one goes."""
    first = F.get(messages, F.lit(0))
    leads = F.coalesce(first["role"] == "system", F.lit(False))
    content = F.when(leads, F.concat(first["content"], F.lit("\n\n"), prompt)).otherwise(prompt)
    rest = F.when(leads, F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    head = F.array(F.struct(F.lit("system").alias("role"), content.alias("content")))
    return F.when(stripped(content) == "", rest).otherwise(F.concat(head, rest))


def guarded(messages: Column, tokens: Column, special: list) -> Column:
    """The messages, or one refusal in their place if their tokens include a special one."""
    refusal = F.array(F.struct(F.lit("user").alias("role"), F.lit(REFUSAL).alias("content")))
    return F.when(F.arrays_overlap(tokens, F.array(*map(F.lit, special))), refusal).otherwise(messages)


def input_strings(value: Column, words: Column) -> Column:
    """Texts of an embedding request's input: a text, texts, ids, or lists of ids, as JSON; ids become words of ``words``."""
    decode = lambda ids: F.array_join(F.transform(ids, lambda i: F.get(words, i)), " ")
    nested, ids, texts = F.from_json(value, "array<array<int>>"), F.from_json(value, "array<int>"), F.from_json(value, "array<string>")
    plain = F.get_json_object(F.concat(F.lit('{"x":'), value, F.lit("}")), "$.x")
    kind = lambda start: value.rlike(rf"^\s*{start}")
    return F.when(kind(r"\[\s*\["), F.transform(nested, decode)).when(kind(r"\[\s*-?[0-9]"), F.array(decode(ids))).when(kind(r"\["), texts).otherwise(F.array(plain))


def alias(df, names, key: str):
    """``key`` replaced by what ``names`` (alias, name) says; what it does not know stays."""
    return df.join(names, F.col(key) == F.col("alias"), "left").withColumn(key, F.coalesce("name", key)).drop("alias", "name")


def with_speaker_tag(text: Column, speaker: Column) -> Column:
    """The speaker put in as a token before the first token; behind the text if it has none."""
    at = F.instr(text, "<|")
    return F.when(at == 0, F.concat(text, F.lit("<|"), speaker, F.lit("|>"))).otherwise(F.concat(F.substring(text, F.lit(1), at + 1), speaker, F.lit("|>"), F.substring(text, at, F.length(text))))


def spoken(text: Column, maps: dict[str, str] | None = None, contractions: dict[str, str] | None = None, to: str = "to") -> Column:
    """Text for speech: one line, literal replacements, contractions, ranges of numbers, letters and digits parted.

    Numbers stay digits: the word tables of the original were never published.
    """
    text = F.trim(F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), " +", " "))
    for old, new in (maps or {}).items():
        text = F.replace(text, F.lit(old), F.lit(new))
    for old, new in (contractions or {}).items():
        text = F.regexp_replace(text, rf"(?i)\b{old}\b", new)
    text = F.regexp_replace(text, r"\b(\d+)-(\d+) (\p{L}+)", f"$1 {to} $2 $3")
    return spaced_alpha_num(text)


def response_text(body: Column, offset: Column) -> Column:
    """Marker text of an upstream answer, moved by ``offset`` seconds: its segments, else its text, else empty.

    Segments without text are left out, missing times are 0; special tokens are taken out of a text.
    """
    schema = "struct<segments:array<struct<start:double,end:double,text:string>>,text:string>"
    answer = F.from_json(body, schema)
    show = lambda c: F.concat(F.lit("<|"), short_time(F.coalesce(c, F.lit(0.0)) + offset), F.lit("|>"))
    named = F.transform(answer["segments"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), stripped(F.coalesce(s["text"], F.lit(""))).alias("text")))
    segments = F.array_join(F.transform(F.filter(named, lambda s: s["text"] != ""), lambda s: F.concat(show(s["start"]), s["text"], show(s["end"]))), "")
    plain = without_special_tokens(answer["text"])
    times, parts = F.regexp_extract_all(plain, F.lit(MARKER), F.lit(0)), F.split(plain, MARKER, -1)
    moved = F.transform(times, lambda m: show(F.regexp_replace(m, r"[<|>]", "").cast("double")))
    marked = F.concat(F.array_join(F.flatten(F.zip_with(F.slice(parts, 1, F.size(times)), moved, lambda t, m: F.array(t, m))), ""), F.element_at(parts, -1))
    return F.when(answer["segments"].isNotNull(), segments).when(answer["text"].isNotNull(), marked).otherwise("")
