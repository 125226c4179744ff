"""Recognisers that need match offsets or look-behind state: run on Arrow batches, one list of matches a row.

Each takes a text and yields tuples; `matches` turns a recogniser into a column of structs.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Results must agree with other implementations of the same analyses.
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec"
ISO_DATE = r"(?:19|20)\d{2}[-/]\d{1,2}[-/]\d{1,2}"
DAY_FIRST = rf"\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{MONTHS})[,]?\s+(?:19|20)\d{{2}}"
MONTH_FIRST = rf"(?:{MONTHS})\s+\d{{1,2}}(?:st|nd|rd|th)?[,]?\s+(?:19|20)\d{{2}}"
FISCAL = r"(?:FY|Fiscal Year)\s*(?:19|20)\d{2}(?:\s*[-–/]\s*\d{2,4})?"
MONTH_YEAR = rf"(?:{MONTHS})\s+(?:19|20)\d{{2}}"
RELATIVE = r"(?:within|no later than|not later than)\s+\d+\s+(?:calendar\s+|business\s+|working\s+)?(?:day|days|week|weeks|month|months|year|years)"
PHRASE = r"[A-Z][A-Za-z0-9&'’.-]*(?:\s+(?:[A-Z][A-Za-z0-9&'’.-]*|of|the|and|for|to|in)){0,8}"
WORD = re.compile(r"\b\w+(?:['’\-]\w+)*\b")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
QUOTE = re.compile(r"“[^”]+”|\"[^\"\n]+\"|«[^»]+»|(?m:^\s*>[^\n]+)")
NUMERIC = re.compile(r"\[(\d+(?:\s*[,;–\-]\s*\d+)*)\]")
AUTHOR_YEAR = re.compile(r"\b([A-ZÀ-ÖØ-Þ][\w’'\-]+)(?:\s+et\s+al\.?)?(?:\s+(?:and|&)\s+[A-ZÀ-ÖØ-Þ][\w’'\-]+)?\s*,?\s*\(?((?:18|19|20)\d{2}[a-z]?)\)?")
DOI = re.compile(r"\b10\.\d{4,9}/[^\s<>\"]+", re.I)
DATE_KINDS = [
    ("exact", re.compile(rf"\b{ISO_DATE}\b")),
    ("exact", re.compile(rf"\b{DAY_FIRST}\b", re.I)),
    ("exact", re.compile(rf"\b{MONTH_FIRST}\b", re.I)),
    ("fiscal", re.compile(rf"\b{FISCAL}\b", re.I)),
    ("month", re.compile(rf"\b{MONTH_YEAR}\b", re.I)),
    ("relative", re.compile(rf"\b{RELATIVE}\b", re.I)),
]
ENTITY_KINDS = [
    ("Dates", re.compile(rf"\b(?:{ISO_DATE}|{DAY_FIRST}|{MONTH_FIRST}|{MONTH_YEAR}|{FISCAL}|{RELATIVE})\b", re.I)),
    ("Monetary amounts", re.compile(r"(?<!\w)(?:₹|Rs\.?|INR|US\$|USD|\$|£|€)\s*\d[\d,]*(?:\.\d+)?(?:\s*(?:thousand|million|billion|crore|lakh))?\b|\b\d[\d,]*(?:\.\d+)?\s*(?:thousand|million|billion|crore|lakh)\s*(?:rupees?|dollars?|USD|INR|pounds?|euros?)\b", re.I)),
    ("Percentages", re.compile(r"\b\d+(?:\.\d+)?\s*(?:%|percent|per cent)\b", re.I)),
    ("Ministries", re.compile(rf"\bMinistry\s+(?:of\s+)?{PHRASE}\b")),
    ("Government departments", re.compile(rf"\bDepartment\s+(?:of\s+)?{PHRASE}\b")),
    ("Agencies", re.compile(rf"\b(?:National\s+)?Agency\s+(?:for\s+|of\s+)?{PHRASE}\b")),
    ("Agencies", re.compile(rf"\b{PHRASE}\s+Agency\b")),
    ("Committees", re.compile(rf"\b{PHRASE}\s+Committee\b")),
    ("Acts", re.compile(rf"\b{PHRASE}\s+Act(?:,?\s+(?:19|20)\d{{2}})?\b")),
    ("Rules/regulations", re.compile(rf"\b{PHRASE}\s+(?:Rules?|Regulations?)(?:,?\s+(?:19|20)\d{{2}})?\b")),
    ("Policies", re.compile(rf"\b{PHRASE}\s+(?:Policy|Directive|Doctrine|Strategy)\b")),
    ("Programs/schemes", re.compile(rf"\b{PHRASE}\s+(?:Programme|Program|Scheme|Initiative|Mission)\b")),
    ("Defence organizations", re.compile(rf"\b{PHRASE}\s+(?:Command|Army|Navy|Air Force|Armed Forces)\b")),
    ("Equipment/platform names", re.compile(rf"\b{PHRASE}\s+(?:Aircraft|Platform|System|Tank|Missile|Radar|Drone|UAV|Vessel|Ship|Helicopter|Rifle|Satellite)\b")),
    ("People/designations", re.compile(rf"\b(?:Minister|Secretary|Chief|Director|General|Admiral|Marshal|Commander|Chairperson|Chairman|Chairwoman)\s+(?:of\s+)?{PHRASE}\b")),
    ("Locations", re.compile(r"\b(?:located|based|headquartered|deployed)\s+(?:in|at)\s+([A-Z][A-Za-z'’-]*(?:\s+[A-Z][A-Za-z'’-]*){0,4})\b")),
    ("Organizations", re.compile(rf"\b{PHRASE}\s+(?:Authority|Commission|Council|Board|Organisation|Organization|Directorate|Secretariat)\b")),
]
# End of the fixed values.

# A text without one of these cannot match the kind; a plain search is far cheaper than the pattern.
TRIGGERS = {
    "Ministries": ("Ministry",), "Government departments": ("Department",), "Agencies": ("Agency",), "Committees": ("Committee",), "Acts": ("Act",),
    "Rules/regulations": ("Rule", "Regulation"), "Policies": ("Policy", "Directive", "Doctrine", "Strategy"), "Programs/schemes": ("Program", "Scheme", "Initiative", "Mission"),
    "Defence organizations": ("Command", "Army", "Navy", "Air Force", "Armed Forces"), "Locations": ("located", "based", "headquartered", "deployed"),
}


def sentence_spans(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the sentences between the boundaries."""
    a = 0
    for m in SENTENCE.finditer(text):
        yield a, m.start()
        a = m.end()
    yield a, len(text)


def around(text: str, start: int, end: int, spans: list[tuple[int, int]], limit: int) -> str:
    """T5: the sentence holding a match whole, else the whole text; spaces collapsed, cut at `limit`."""
    inside = next(((a, b) for a, b in spans if a <= start and end <= b), (0, len(text)))
    return " ".join(text[inside[0] : inside[1]].split())[:limit]


def dates(text: str) -> Iterator[tuple[str, str, str]]:
    """(date, precision, sentence); a match overlapping one of an earlier kind is dropped."""
    taken: list[tuple[int, int]] = []
    spans = None
    for precision, pattern in DATE_KINDS:
        for m in pattern.finditer(text):
            if not any(m.start() < b and a < m.end() for a, b in taken):
                taken.append(m.span())
                spans = spans or list(sentence_spans(text))
                yield m.group(), precision, around(text, m.start(), m.end(), spans, 900)


def entities(text: str) -> Iterator[tuple[int, int, int, str, str, str]]:
    """(pattern number, start, end, category, matched text, sentence) in the order of patterns."""
    spans = None
    for n, (category, pattern) in enumerate(ENTITY_KINDS):
        triggers = TRIGGERS.get(category)
        if triggers and not any(t in text for t in triggers):
            continue
        for m in pattern.finditer(text):
            spans = spans or list(sentence_spans(text))
            yield n, m.start(), m.end(), category, m.group(1) if category == "Locations" else m.group(), around(text, m.start(), m.end(), spans, 700)


def words(text: str) -> Iterator[tuple[str, int, int]]:
    """(NFKC, case-folded word, start, end)."""
    for m in WORD.finditer(text):
        yield unicodedata.normalize("NFKC", m.group()).casefold(), m.start(), m.end()


def plain_words(text: str) -> Iterator[str]:
    """T3 without offsets, which are most of the cost of moving words to Spark."""
    ascii_text = text.isascii()
    for w in WORD.findall(text):
        yield w.lower() if ascii_text else unicodedata.normalize("NFKC", w).casefold()


def quotes(text: str) -> Iterator[tuple[int, int]]:
    """Spans of quotations and quoted lines."""
    for m in QUOTE.finditer(text):
        yield m.span()


def citations(text: str) -> Iterator[tuple[str, str, str, str, int, int]]:
    """(style, marker text, surname or label or DOI, year, start, end)."""
    for m in NUMERIC.finditer(text):
        labels: dict[int, None] = {}
        for part in re.split("[,;]", m.group(1)):
            ends = [int(x) for x in re.split(r"[–\-]", part)]
            if len(ends) == 2:
                if 0 <= ends[1] - ends[0] <= 100:
                    labels.update(dict.fromkeys(range(ends[0], ends[1] + 1)))
            else:
                labels[ends[0]] = None
        for label in labels:
            yield "numeric", f"[{label}]", str(label), "", m.start(), m.end()
    opened, at = 0, 0  # whether the last bracket before the match opens
    for m in AUTHOR_YEAR.finditer(text):
        a, b = text.rfind("(", at, m.start()), text.rfind(")", at, m.start())
        if a >= 0 or b >= 0:
            opened, at = a > b, m.start()
        if opened or "," in m.group() or "(" in m.group():
            yield "author-year", m.group(), m.group(1).casefold(), m.group(2), m.start(), m.end()
    for m in DOI.finditer(text):
        yield "DOI", m.group(), m.group().rstrip(".,;:)]}").lower(), "", m.start(), m.end()


RECOGNISERS: dict[str, tuple[Callable, str]] = {
    "dates": (dates, "array<struct<date: string, date_precision: string, event: string>>"),
    "entities": (entities, "array<struct<pattern: int, start: int, `end`: int, category: string, raw: string, context: string>>"),
    "words": (words, "array<struct<word: string, start: int, `end`: int>>"),
    "plain_words": (plain_words, "array<string>"),
    "quotes": (quotes, "array<struct<start: int, `end`: int>>"),
    "citations": (citations, "array<struct<style: string, marker: string, target: string, year: string, start: int, `end`: int>>"),
}


def matches(name: str, text: Column) -> Column:
    """All matches of a recogniser in a text column; a null text has none."""
    recognise, shape = RECOGNISERS[name]

    @F.pandas_udf(shape)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else list(recognise(t)))

    return found(text)
