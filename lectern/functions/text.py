"""Column functions over text. All stay inside the JVM; none is a Python UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Results must agree with other implementations of the same analyses.
TOKEN = r"[A-Za-z0-9]+(?:[./-][A-Za-z0-9]+)*"
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "in", "is", "it", "of", "on", "or",
    "the", "these", "this", "to", "was", "were", "what", "when", "where", "which", "who", "with",
]
POSITIVE_MODALITIES = ["must", "shall", "required", "mandatory", "permitted", "allowed"]
NEGATIVE_PHRASES = ["must not", "shall not", "not permitted", "not allowed", "prohibited", "forbidden"]
DOI = r"\b10\.\d{4,9}/[^\s<>\"]+"
YEAR = r"\b((?:18|19|20)\d{2}[a-z]?)\b"
TOPICS = {
    "Eligibility / Thresholds": ["applicant", "eligible", "eligibility", "threshold", "minimum", "maximum", "qualify", "years of service"],
    "Dates / Deadlines": ["date", "deadline", "effective", "expires", "applications close", "days", "month", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"],
    "Financial / Monetary Amounts": ["budget", "fund", "cost", "amount", "payment", "million", "billion", "$"],
    "Authorities / Responsibilities": ["authority", "agency", "department", "minister", "responsible", "administer"],
    "Definitions": ["means", "defined", "definition", "refers to"],
    "Requirements / Restrictions": ["must", "shall", "required", "prohibited", "restricted", "permitted", "may not"],
}
OTHER_TOPIC = "General Provisions"
EVENT_TYPES = {
    "Publication": ["publish", "publication", "issued", "issuance"],
    "Effective date": ["effective", "takes effect", "commences"],
    "Application deadline": ["application", "apply", "submission", "deadline", "submit"],
    "Review date": ["review", "assessment", "evaluate"],
    "Implementation milestone": ["implement", "milestone", "phase", "rollout"],
    "Amendment": ["amend", "revision", "revised"],
    "Expiration": ["expire", "expiration", "sunset", "valid until"],
}
OTHER_EVENT = "Other dated event"
DEFENCE_WORDS = ["defence", "defense", "armed", "army", "navy", "air force", "command"]


def _contains_any(text: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | text.contains(phrase)
    return out


def lexical_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits joined by single . / or -, lower-cased after matching."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def evidence_terms(text: Column) -> Column:
    """Distinct tokens of three characters or with a digit that are no stop words."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    keep = F.filter(lexical_tokens(text), lambda t: ~F.array_contains(stop, t) & ((F.length(t) >= 3) | t.rlike("[0-9]")))
    return F.array_distinct(keep)


def sentences(text: Column, newlines: bool = True) -> Column:
    """T4: cut after . ! ? and white space, and at newlines unless `newlines` is off."""
    return F.split(text, r"(?<=[.!?])\s+|\n+" if newlines else r"(?<=[.!?])\s+")


def collapsed(text: Column, limit: int | None = None) -> Column:
    """White space runs as one space, stripped, at most `limit` characters."""
    out = F.trim(F.regexp_replace(text, r"\s+", " "))
    return out if limit is None else F.substring(out, 1, limit)


def event_type(text: Column) -> Column:
    """First type of which a key word stands in the text."""
    low, out = F.lower(text), F.lit(OTHER_EVENT)
    for label, words in reversed(EVENT_TYPES.items()):
        out = F.when(_contains_any(low, words), label).otherwise(out)
    return out


def clean_entity(value: Column) -> Column:
    """Spaces collapsed, outer punctuation and a leading "The " dropped."""
    stripped = F.regexp_replace(F.regexp_replace(value, r"\s+", " "), r"^[ \t\n,.;:()\[\]]+|[ \t\n,.;:()\[\]]+$", "")
    return F.regexp_replace(stripped, r"^The\s+", "")


def canonical(value: Column) -> Column:
    """Lower case, everything but ASCII letters and digits as single spaces."""
    return F.trim(F.regexp_replace(F.lower(value), "[^a-z0-9]+", " "))


def refined_category(category: Column, entity: Column) -> Column:
    """Organizations named after the armed forces are defence organizations."""
    return F.when((category == "Organizations") & _contains_any(F.lower(entity), DEFENCE_WORDS), "Defence organizations").otherwise(category)


def negative_modality(text: Column) -> Column:
    return _contains_any(F.lower(text), NEGATIVE_PHRASES)


def positive_modality(text: Column) -> Column:
    """A permitting or obliging word, and no forbidding phrase."""
    terms = evidence_terms(F.lower(text))
    return F.arrays_overlap(terms, F.array(*map(F.lit, POSITIVE_MODALITIES))) & ~negative_modality(text)


def topics(text: Column) -> Column:
    """Every topic of which a key word stands in the text, else the general one."""
    low = F.lower(text)
    hit = F.filter(F.array(*[F.when(_contains_any(low, words), F.lit(topic)) for topic, words in TOPICS.items()]), lambda t: t.isNotNull())
    return F.when(F.size(hit) > 0, hit).otherwise(F.array(F.lit(OTHER_TOPIC)))


def dois(text: Column) -> Column:
    """Distinct DOIs in lower case, closing punctuation dropped."""
    found = F.regexp_extract_all(text, F.lit(f"(?i){DOI}"), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"[.,;:)\]}]+$", ""))))


def doi_link(doi: Column) -> Column:
    """A link for a DOI; characters outside the URL set are percent-encoded, slashes kept."""
    return F.when(doi.isNull() | (doi == ""), "").otherwise(F.concat(F.lit("https://doi.org/"), F.replace(F.replace(F.url_encode(doi), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))))


def year(text: Column) -> Column:
    """The first year from 1800 on, with its letter."""
    return F.regexp_extract(text, YEAR, 1)


def cited_numbers(text: Column) -> Column:
    """Numbers of bracketed citations of one text; ranges of at most 100 steps are spelled out."""
    groups = F.regexp_extract_all(text, F.lit(r"\[(\d{1,9}(?:\s*[,;–\-]\s*\d{1,9})*)\]"), F.lit(1))
    return F.transform(groups, number_group)


def number_group(group: Column) -> Column:
    """The distinct numbers of one bracket, e.g. "1, 3–5"."""

    def spelled(part: Column) -> Column:
        ends = F.transform(F.split(F.trim(part), r"[–\-]"), lambda x: F.trim(x).cast("bigint"))
        first, last = ends[0], F.element_at(ends, -1)
        ranged = F.when((last >= first) & (last - first <= 100), F.sequence(first, F.greatest(first, F.least(last, first + 100)))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(ends) == 2, ranged).otherwise(F.array(first))

    return F.array_distinct(F.flatten(F.transform(F.split(group, "[,;]"), spelled)))


def utf8_cost(text: Column) -> Column:
    """Bytes of the text in UTF-8."""
    return F.octet_length(text)


def readable(text: Column) -> Column:
    """holds a letter or digit of any script."""
    return text.isNotNull() & text.rlike(r"[\p{L}\p{N}]")


def document_hash(value: Column) -> Column:
    """64 lower-case hexadecimal digits."""
    return value.isNotNull() & value.rlike("^[0-9a-f]{64}$")


def safe_link(value: Column) -> Column:
    """the link if it is http(s) with a host and without credentials or control characters, else ''."""
    host = F.try_parse_url(value, F.lit("HOST"))
    user = F.try_parse_url(value, F.lit("USERINFO"))
    fine = F.lower(value).rlike("^https?://") & ~value.rlike(r"[\x00-\x1f]") & host.isNotNull() & (host != "") & (user.isNull() | (user == ""))
    return F.when(fine, value).otherwise("")


def cited_ids(answer: Column, prefix: str = "E") -> Column:
    """Evidence ids standing in an answer, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(F.upper(answer), F.lit(rf"\b{prefix}\d+\b"), F.lit(0)))


def allowed_ids(proposed: Column, allowed: Column) -> Column:
    """F8: proposed ids, stripped and in upper case, that are allowed; in order, each once."""
    return F.array_intersect(F.array_distinct(F.transform(proposed, lambda x: F.upper(F.trim(x)))), allowed)


def marked_html(text: Column, flagged: Column) -> Column:
    """HTML-escaped, and marked if flagged."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.when(F.coalesce(flagged, F.lit(False)), F.concat(F.lit("<mark>"), out, F.lit("</mark>"))).otherwise(out)


def excerpt(text: Column, limit: int) -> Column:
    """At most `limit` characters, cut back to the last white space if there is any."""
    head = F.substring(text, 1, limit)
    back = F.regexp_extract(head, r"(?s)^(.*)\s\S*$", 1)
    return F.when(F.length(text) <= limit, text).when(F.trim(back) != "", back).otherwise(head)


def half_even(value: Column, places: int) -> Column:
    """Rounded half to even."""
    return F.bround(value, places)


def embedding_batch(chunks: Column) -> Column:
    """How many chunks to encode at a time."""
    return F.when(chunks > 2000, 4).when(chunks > 500, 8).otherwise(16)


def raster_dpi(width: Column, height: Column, dpi: int = 200, most_pixels: int = 20_000_000) -> Column:
    """S3: resolution at which a page of this size (in points) stays below `most_pixels`, at least 100."""
    pixels = (width / 72 * dpi) * (height / 72 * dpi)
    return F.when(pixels <= most_pixels, F.lit(dpi)).otherwise(F.greatest(F.lit(100), F.floor(dpi * F.sqrt(most_pixels / pixels)))).cast("int")


def table_cell(value: Column, limit: int = 96) -> Column:
    """K6: one line, pipes escaped, long values cut with an ellipsis."""
    flat = F.replace(collapsed(value.cast("string")), F.lit("|"), F.lit("\\|"))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)
