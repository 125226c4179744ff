"""Structured answers in noisy text, provider errors, and bibliographic metadata, as columns."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ANSWER = "struct<answer: string, evidence_ids: array<string>, sufficient_evidence: boolean>"
# How errors of providers are told apart.
CATEGORIES = [
    ("authentication", [401, 403], r"api_key_invalid|api_key_expired|api_key_service_blocked|api key not valid|invalid api key|api key expired"),
    ("model_configuration", [404], None),
    ("quota_exhausted", [], r"(?s)(?=.*(?:quota|resource_exhausted|429|rate limit)).*(?:perday|per_day|per day|daily|\"?limit\"?: 0|quotavalue['\"]?\s*:\s*['\"]?0\b)"),
    ("rate_limit", [429], r"quota|resource_exhausted|rate limit"),
    ("invalid_input", [400], None),
    ("timeout", [408], r"timeout"),
    ("network", [], r"connection|network"),
    ("service", [500, 502, 503, 504], None),
]
TRANSIENT = ["rate_limit", "timeout", "network", "service"]
BAD_MODEL = r"model not found|unsupported model|not supported for generatecontent|invalid model|unexpected model name|invalid model name"


def first_object(text: Column) -> Column:
    """The first complete JSON object in a text (fences and prose around it are passed over), or null."""

    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        decoder = json.JSONDecoder()

        def one(text):
            at = -1 if text is None else text.find("{")
            while at >= 0:
                try:
                    return text[at : decoder.raw_decode(text, at)[1]]
                except (json.JSONDecodeError, RecursionError):
                    at = text.find("{", at + 1)
            return None

        return texts.map(one)

    return found(text)


def answer_of(text: Column) -> Column:
    """The answer struct of a response: parsed, else put together from the fields that were closed."""
    whole = F.from_json(first_object(text), ANSWER)
    return F.when(whole["answer"].isNotNull(), whole).otherwise(recovered(text))


def recovered(text: Column) -> Column:
    """Closed fields of a truncated answer object; without an id list, the ids standing in the answer.
    Null without an answer or without any id."""
    literal = F.regexp_extract(text, r'"answer"\s*:\s*("(?:[^"\\]|\\.)*")', 1)
    answer = F.get_json_object(F.concat(F.lit('{"a":'), F.nullif(literal, F.lit("")), F.lit("}")), "$.a")
    listed = F.from_json(F.nullif(F.regexp_extract(text, r'"evidence_ids"\s*:\s*(\[[^\]]*\])', 1), F.lit("")), "array<string>")
    ids = F.coalesce(listed, F.array_distinct(F.regexp_extract_all(F.upper(answer), F.lit(r"\bE\d+\b"), F.lit(0))))
    enough = F.nullif(F.regexp_extract(text, r'"sufficient_evidence"\s*:\s*(true|false)\b', 1), F.lit("")).cast("boolean")
    return F.when((F.trim(answer) != "") & (F.size(ids) > 0), F.struct(answer.alias("answer"), ids.alias("evidence_ids"), enough.alias("sufficient_evidence")))


def finished_at_limit(reason: Column) -> Column:
    """Whether a response ended because it was long enough."""
    return F.coalesce(F.upper(reason).contains("MAX_TOKENS"), F.lit(False))


def response_state(reason: Column, text: Column) -> Column:
    """Complete, truncated, blocked or empty."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.when(F.upper(reason).rlike("SAFETY|BLOCK|RECITATION|PROHIBITED"), "blocked").otherwise("empty")).when(finished_at_limit(reason), "truncated").otherwise("complete")


def error_category(status: Column, message: Column) -> Column:
    """What kind of failure a status and message mean."""
    low = F.lower(F.coalesce(message, F.lit("")))
    out = F.lit("unknown")
    for name, codes, pattern in reversed(CATEGORIES):
        hit = F.coalesce(status.isin(codes), F.lit(False)) if codes else F.lit(False)
        if name == "model_configuration":
            hit = hit | (F.coalesce(status == 400, F.lit(False)) & low.rlike(BAD_MODEL))
        elif pattern:
            hit = hit | low.rlike(pattern)
        out = F.when(hit, name).otherwise(out)
    return out


def is_transient(category: Column) -> Column:
    return category.isin(TRANSIENT)


def retry_after(header: Column, message: Column, most: float = 5.0) -> Column:
    """Seconds to wait: of the header, else of the message, at most `most`."""
    told = F.coalesce(header.try_cast("double"), F.nullif(F.regexp_extract(message, r"retryDelay['\"]?\s*:\s*['\"]([0-9.]+)s", 1), F.lit("")).try_cast("double"), F.lit(0.0))
    return F.least(F.greatest(told, F.lit(0.0)), F.lit(most))


def sanitized(message: Column, limit: int = 300) -> Column:
    """A message without keys, tokens, addresses and long numbers."""
    out = F.regexp_replace(message, r"(?i)(api[_-]?key|token|authorization|bearer)(['\"]?\s*[:=]?\s*['\"]?)[^\s'\",&]+", "$1$2[redacted]")
    out = F.regexp_replace(F.regexp_replace(out, r"https?://\S+", "[link]"), r"[A-Za-z0-9_\-]{32,}", "[redacted]")
    return F.substring(F.regexp_replace(out, r"\s+", " "), 1, limit)


WORK = "struct<title: array<string>, author: array<struct<given: string, family: string>>, published: struct<`date-parts`: array<array<int>>>, issued: struct<`date-parts`: array<array<int>>>, DOI: string>"


def work_metadata(item: Column) -> Column:
    """Title, authors, year, DOI and link of a bibliographic record in JSON."""
    from lectern.functions.text import doi_link

    w = F.from_json(item, WORK)
    authors = F.array_join(F.filter(F.transform(w["author"], lambda a: F.concat_ws(" ", F.nullif(a["given"], F.lit("")), F.nullif(a["family"], F.lit("")))), lambda x: x != ""), ", ")
    parts = F.coalesce(w["published"]["date-parts"], w["issued"]["date-parts"])
    doi = F.lower(F.coalesce(w["DOI"], F.lit("")))
    return F.struct(F.coalesce(F.get(w["title"], F.lit(0)), F.lit("")).alias("title"), F.coalesce(authors, F.lit("")).alias("authors"), F.coalesce(F.get(F.get(parts, F.lit(0)), F.lit(0)).cast("string"), F.lit("")).alias("year"), doi.alias("doi"), doi_link(doi).alias("link"))


def prompt_block(evidence_id: Column, filename: Column, page: Column, chunk_id: Column, text: Column) -> Column:
    """One piece of evidence wrapped as untrusted input, with tags of its own escaped."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)</?evidence", "&lt;evidence")
    return F.concat(F.lit('<evidence id="'), evidence_id, F.lit('" file="'), F.replace(filename, F.lit('"'), F.lit("'")), F.lit('" page="'), page.cast("string"), F.lit('" chunk="'), chunk_id, F.lit('">\n'), inner, F.lit("\n</evidence>"))
