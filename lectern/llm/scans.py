"""Problem 4: noise in the text of scanned pages, whatever the stated extraction method.

1. One pass counts the words of all pages (words divided at a line break are put together).
2. Character q-gram inverted joins retrieve, for every word, more frequent words from which it may have been
   misread. An edit of up to two neighbouring characters leaves the first or the last part of a word untouched,
   so in longer words both parts, as long as they can be, are the join keys. In words of up to `GAPPED` letters
   these parts are too short to tell words apart: there the key is the word with a gap of up to two characters.
3. Boosted trees rank the candidates by how much more frequent they are, how often the same edit is met among
   all pairs, where it stands, and so on. They learn from pairs that need no label: words holding a sign no word
   has are misread, words that are frequent themselves are not.
4. A second pass looks at pairs of lines: a line ending in a hyphen and the line that goes on are judged by
   trees trained on divided and on hyphenated words of the vocabulary; running headers and page numbers are
   known by the document's title, the page's number and their place. Tokens outside the trusted vocabulary are
   joined with the corrections.

Tasks hold the trusted vocabulary: words that are more than `TRUSTED` of all, so never more than 1 / `TRUSTED`. The
corrections themselves are joined as rows. The publishers' own lines are held as (publisher, line) while they are
few; beyond, every page gets its own joined. Both ways say the same.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm import boilerplate
from lectern.llm.boosting import Boosted
from lectern.session import cut, spread

HYPHENS = "-­‐‑¬"
STRAY = "·*^~`¦•°|¬"
OUTER = "\"'“”‘’«».,;:!?()[]{}<>…"
EDGE_LINES = 6
TRUSTED = 5e-6
GAPPED = 9
SET_APART = re.compile(r"(?<!\S)(?:[^\W\d_] ){2,}[^\W\d_](?=$|[\s.,;:!?)])")
NUMBERED = re.compile(r"^\W*(?:(page|p|pg|seite|página|pag)\W*)?(\d{1,6}|[ivxlc]{1,8})(?:\W*(?:of|/|von|de|sur)\W*\d{1,6})?\W*$")
BLANK = re.compile(r"[ \t]+")
DIGITS = re.compile("[0-9]+")
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100}


def roman(text: str) -> int:
    values = [ROMAN[c] for c in text]
    return sum(-v if v < max(values[k + 1 :], default=0) else v for k, v in enumerate(values))


def word_of(token: str) -> str | None:
    """The token as a word in lower case, or null for numbers, codes and single letters."""
    word = token.strip(OUTER)
    letters = sum(c.isalpha() for c in word)
    digits = sum(c.isdigit() for c in word)
    if letters < 2 or len(word) < 3 or len(word) > 40 or digits > 2 or letters <= 2 * digits or ord(max(word)) >= 0x2E80:
        return None
    if "/" in word or (digits and not word[0].isalpha() and letters < 4) or (digits and word.upper() == word and letters < 5):
        return None
    return word.lower()


def line_key(line: str) -> int:
    """The hash `boilerplate.page_lines` gives the line."""
    import xxhash

    text = line.strip().lower()
    if "  " in text or "\t" in text:
        text = BLANK.sub(" ", text)
    if DIGITS.search(text):
        text = DIGITS.sub("#", text)
    x = xxhash.xxh64_intdigest(text.encode(), 42)
    return x - (1 << 64) if x >= 1 << 63 else x


def title_words(filename: str | None) -> list[str]:
    """Words of the title a file is named after; a year at the end is not part of it."""
    words = re.findall("[a-z0-9]+", (filename or "").lower().rsplit(".", 1)[0])
    return words[:-1] if len(words) > 1 and re.fullmatch(r"\d{4}", words[-1]) else words


def near(a: str, b: str) -> bool:
    """Equal, or longer words within two neighbouring wrong characters."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 2:
        return False
    x, y, _, _ = edit(a, b)
    return len(x) <= 2 and len(y) <= 2


def edit(wrong: str, right: str) -> tuple[str, str, int, int]:
    """(what stands there, what should, where, characters after it) for words that differ in one place."""
    n = min(len(wrong), len(right))
    a = 0
    while a < n and wrong[a] == right[a]:
        a += 1
    b = 0
    while b < n - a and wrong[-1 - b] == right[-1 - b]:
        b += 1
    return wrong[a : len(wrong) - b], right[a : len(right) - b], a, b


@dataclass
class Page:
    """The lines of a page and what stands outside the text."""

    lines: list[str]
    number: int | None
    title: list[str]
    added: set[int]
    headers: set[int] = field(default_factory=set)
    numbers: set[int] = field(default_factory=set)

    def __post_init__(self):
        self.spaced = SET_APART.search("\n".join(self.lines)) is not None
        solid = [k for k, x in enumerate(self.lines) if x.strip()]
        edge = [k for k in solid[:EDGE_LINES] + solid[-EDGE_LINES:] if k not in self.added]
        for k in edge:
            if self._is_header(self.lines[k]):
                self.headers.add(k)
            elif self._is_number(self.lines[k], k in solid[:1] + solid[-1:]):
                self.numbers.add(k)

    def _is_header(self, line: str) -> bool:
        if self.spaced:
            line = SET_APART.sub(lambda m: m.group().replace(" ", ""), line)
        low = line.lower()
        if sum(w in low for w in self.title) * 3 < len(self.title):  # two thirds of its words misread: no title
            return False
        words = re.findall(r"[^\W_]+(?:[·*^~|][^\W_]+)*", low)
        if len(self.title) < 2 or not len(self.title) <= len(words) <= len(self.title) + 8:
            return False
        at = 0
        for wanted in self.title:  # in this order, whatever stands between
            while at < len(words) and not near(words[at], wanted):
                at += 1
            if at == len(words):
                return False
            at += 1
        return True

    def _is_number(self, line: str, outermost: bool) -> bool:
        found = NUMBERED.match(line.strip().lower())
        if not found:
            return False
        text = found.group(2)
        value = int(text) if text.isdigit() else roman(text)
        if value == self.number and not (text.isdigit() and line.strip().endswith(".")):
            return True
        return outermost and (found.group(1) is not None or re.fullmatch(r"\W*[-–\[]\W*\d+\W*[-–\]]\W*", line.strip()) is not None)

    def outside(self, k: int) -> bool:
        return k in self.added or k in self.headers or k in self.numbers or not self.lines[k].strip()

    def following(self, k: int) -> int | None:
        """The line of text after line k."""
        for j in range(k + 1, len(self.lines)):
            if not self.outside(j):
                return j
        return None

    def divided(self):
        """(line, its last token, the line that goes on, its first token) where a line ends in a hyphen."""
        for k, line in enumerate(self.lines):
            end = line.rstrip()
            if self.outside(k) or len(end) < 2 or end[-1] not in HYPHENS or not end[-2].isalpha():
                continue
            last = end.split()[-1]
            j = self.following(k)
            first = self.lines[j].split()[0] if j is not None else ""
            yield k, last, j, first

    def tokens(self):
        """(line, its whole tokens, null or (its last token, the token that goes on, the line of that))."""
        tails = {k: (last, first, j) for k, last, j, first in self.divided() if j is not None and first[:1].isalpha()}
        taken = {j for _, _, j in tails.values()}
        for k, line in enumerate(self.lines):
            if k in self.added:
                continue
            tokens = (SET_APART.sub(" ", line) if self.spaced else line).split()
            if k in taken:
                del tokens[:1]
            tail = tails.get(k) if tokens else None
            if tail:
                tokens.pop()
            yield k, tokens, tail


def _page(text, number, filename, added, publisher, publisher_lines):
    lines = [x.rstrip("\r") for x in text.split("\n")]
    own = publisher_lines.get(publisher, ())
    known = {x - 1 for x in added} if added is not None else {k for k, x in enumerate(lines) if x.strip() and line_key(x) in own} if own else set()
    return Page(lines, number, title_words(filename), known)


def _joined(last: str, first: str, vocabulary) -> list[tuple[str, int]]:
    """Words a divided word may be, without and with its hyphen, and the length of the first part in each; none if
    one of them is known."""
    left, right = last.lstrip(OUTER), first.rstrip(OUTER)
    forms = [(word_of(left[:-1] + right), len(left) - 1), (word_of(left[:-1] + "-" + right), len(left))]
    return [] if any(w in vocabulary for w, _ in forms) else [(w, n) for w, n in forms if w]


def _counted(batches):
    """Words of all lines; parts of words divided at a line's end are left out. What stands outside the text is
    words too, and need not be told apart to count them."""
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column(0).to_pylist():
            cut = False
            for line in text.split("\n"):
                tokens = line.split()
                if not tokens:
                    continue
                if cut:
                    del tokens[0]
                cut = bool(tokens) and tokens[-1][-1] in HYPHENS
                if cut:
                    tokens.pop()
                counts.update(tokens)
        words: Counter = Counter()
        for token, n in counts.items():
            word = word_of(token)
            if word:
                words[word] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["word", "n"])


def candidate_pairs(words: DataFrame, times: int = 4) -> DataFrame:
    """(wrong, n, right, m): words and words at least `times` as frequent within two neighbouring characters."""

    def ends(df, word, lengths):
        part = F.floor((F.col("length") - 2) / 2).cast("int")
        sized = df.where(F.length(word) > GAPPED - 1).withColumn("length", F.explode(lengths)).where(F.col("length") > GAPPED).withColumn("q", part)
        both = F.array(F.struct(F.lit("first").alias("side"), F.substring(word, F.lit(1), F.col("q")).alias("gram")), F.struct(F.lit("last").alias("side"), F.expr(f"right({word}, q)").alias("gram")))
        return sized.withColumn("key", F.explode(both)).select(*df.columns, "q", "key.side", "key.gram").distinct()

    def gapped(df, word, least):
        # two letters in a row are left on one side at least: what shares less looks like nothing
        starts = f"filter(sequence(0, greatest(0, length({word}) - g)), i -> i >= 2 or length({word}) - i - g >= 2)"
        places = f"flatten(transform(sequence({least}, 2), g -> transform({starts}, i -> concat(substring({word}, 1, i), '\u0001', substring({word}, i + g + 1)))))"
        return df.withColumn("gram", F.explode(F.array_distinct(F.expr(places))))

    usual = words.where((F.length("word") >= 3) & F.col("word").rlike("^[\\p{L}'’-]+$")).select(F.col("word").alias("right"), F.col("n").alias("m")).where("m >= 4")
    asked = words.select(F.col("word").alias("wrong"), "n")
    left = ends(asked, "wrong", F.array(F.length("wrong")))
    right = ends(usual, "right", F.array(F.length("right") - 1, F.length("right"), F.length("right") + 1))
    fits = (F.col("m") >= F.col("n") * times) & (F.col("wrong") != F.col("right"))
    long = left.join(right.hint("merge"), ["side", "q", "gram"]).where(fits).select("wrong", "n", "right", "m")
    short = gapped(asked.where(F.length("wrong") <= GAPPED), "wrong", 1).join(gapped(usual.where(F.length("right") <= GAPPED + 1), "right", 0).hint("merge"), "gram").where(fits).select("wrong", "n", "right", "m")
    return long.unionByName(short).distinct().where((F.levenshtein("wrong", "right", 2) >= 0) & (F.abs(F.length("wrong") - F.length("right")) <= 1))


EDIT = "wrong string, n bigint, right string, m bigint, stands string, should string, at int, after int"


def _edits(batches):
    for batch in batches:
        rows = [(k, *edit(a, b)) for k, (a, b) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True))]
        rows = [r for r in rows if 1 <= len(r[1]) <= 2 and len(r[2]) <= 2]
        take = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([*(c.take(take) for c in batch.columns), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.int32())], ["wrong", "n", "right", "m", "stands", "should", "at", "after"])


def features(n, m, support) -> np.ndarray:
    """How much more frequent the candidate is, and how common its edit is among all pairs. Counts themselves grow
    with the collection, and place and length tell the words with odd signs apart from others; both are left out."""
    return np.stack([np.log(m / n), np.log1p(support)], axis=1).astype(np.float64)


def train_ranker(pairs: DataFrame, usual: float, most: int = 40_000) -> Boosted:
    """Trees over candidate pairs, from at most `most` pairs of each kind in the order of a hash.

    Misread for sure: a word with a sign that no word has; of its candidates the one with the commonest edit is
    taken for right and the others for wrong. Never misread: a frequent word without such a sign, held against
    words not far more frequent.
    """
    sign = f"[0-9{re.escape(STRAY)}ſ]"
    best = Window.partitionBy("wrong").orderBy(F.desc("support"), F.desc("m"), "right")
    sure = pairs.where(F.col("wrong").rlike(sign)).withColumn("label", (F.row_number().over(best) == 1).cast("double"))
    never = pairs.where(~F.col("wrong").rlike(sign) & (F.col("n") >= usual) & (F.col("m") < F.col("n") * 50)).withColumn("label", F.lit(0.0))
    x, y = [], []
    for rows in (sure.where("label = 1"), sure.where("label = 0"), never):
        few = rows.orderBy(F.xxhash64("wrong", "right"), "wrong", "right").limit(most)
        t = few.select("n", "m", "support", "label").toPandas()
        x.append(features(*(t[c].to_numpy(np.float64) for c in ("n", "m", "support"))))
        y.append(t["label"].to_numpy(np.float64))
    x, y = np.concatenate(x), np.concatenate(y)
    if len(np.unique(y)) < 2:
        return Boosted()
    return Boosted().fit(x, y, np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum()) * len(y))


def hyphen_features(left: str, right: str, sign: str, count) -> list[float]:
    """`count` gives a word's frequency, 0 for words not trusted."""
    return [np.log1p(count(left + right)), np.log1p(count(f"{left}-{right}")), np.log1p(count(left)), np.log1p(count(right)), len(left), len(right), float(sign != "-")]


def train_hyphens(vocabulary: dict[str, int], most: int = 4000, seed: int = 5) -> Boosted:
    """Trees telling a word divided for the line break from one ending the line at its own hyphen.

    Made from the vocabulary: words cut anywhere, and hyphenated words cut at their hyphen; a part of either is
    hidden from the counts, as words may be rare.
    """
    rng = np.random.RandomState(seed)
    words = sorted(w for w in vocabulary if len(w) >= 4 and w.isalpha())
    compounds = sorted(w for w in vocabulary if w.count("-") == 1 and min(map(len, w.split("-"))) >= 2)
    x, y = [], []
    for label, kind in ((1.0, words), (0.0, compounds)):
        for k in rng.permutation(len(kind))[:most]:
            word = kind[k]
            hidden = {word} if rng.rand() < 0.3 else set()
            if label:
                at = rng.randint(2, len(word) - 1)
                left, right = word[:at], word[at:]
            else:
                left, right = word.split("-")
            x.append(hyphen_features(left, right, "-", lambda w, h=hidden: 0 if w in h else vocabulary.get(w, 0)))
            y.append(label)
    y = np.array(y)
    if len(np.unique(y)) < 2:
        return Boosted()
    return Boosted(rounds=40).fit(np.array(x), y, np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum()) * len(y))


@dataclass
class Reader:
    """What a task needs to read a page."""

    vocabulary: dict[str, int]
    hyphens: Boosted
    publisher_lines: dict[str, set[int]]

    def divided_words(self, ends: list[tuple[str, str]]) -> list[bool]:
        """For each (last token, first token) whether the line break, and not the word's own hyphen, divides."""
        out, asked, rows = [False] * len(ends), [], []
        count = self.vocabulary.get
        for n, (last, first) in enumerate(ends):
            left, right = last.lstrip(OUTER)[:-1].lower(), first.rstrip(OUTER).lower()
            right = right.split("'")[0].split("\u2019")[0]
            if last[-1] in "¬\u00ad":
                out[n] = True  # a sign for division only
            elif right[:1].isalpha() and left[-1:].isalpha():
                if self.hyphens.trees:
                    asked.append(n)
                    rows.append(hyphen_features(left, right, last[-1], lambda w: count(w, 0)))
                else:
                    out[n] = f"{left}-{right}" not in self.vocabulary
        if asked:
            for n, score in zip(asked, self.hyphens.score(np.array(rows)).tolist(), strict=True):
                out[n] = score > 0
        return out


FOUND = "doc string, page int, line_no int, kind string, word string, other_line int, part int"


def _read(reader):
    """Rows of damage: lines with a kind, and (kind null) words to be looked up among the corrections."""

    def work(batches):
        r = reader.value
        names = ["doc", "page", "line_no", "kind", "word", "other_line", "part"]
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32())
        plain: set[str] = set()  # tokens already seen to be nothing to report

        def judged(token):
            """(word to be looked up, strayed), both false for most tokens."""
            word = word_of(token)
            seen = (word if word and word not in r.vocabulary else None, _strayed(token.strip(OUTER)))
            if seen == (None, False):
                plain.add(token)
            return seen

        for batch in batches:
            out: list[tuple] = []
            ends, places = [], []
            if len(plain) > 500_000:
                plain.clear()
            for doc, number, filename, text, added, publisher in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = _page(text, number, filename, added, publisher, r.publisher_lines)
                out += [(doc, number, k + 1, "running_header", None, None, None) for k in page.headers]
                out += [(doc, number, k + 1, "page_number", None, None, None) for k in page.numbers]
                for k, last, _, first in page.divided():
                    ends.append((last, first))
                    places.append((doc, number, k + 1))
                for k, line in enumerate(page.lines if page.spaced else ()):
                    if k not in page.added and SET_APART.search(line):
                        out.append((doc, number, k + 1, "misread", None, None, None))
                for k, tokens, tail in page.tokens():
                    for token in tokens:
                        if token not in plain:
                            word, strayed = judged(token)
                            if strayed:
                                out.append((doc, number, k + 1, "misread", None, None, None))
                            if word:
                                out.append((doc, number, k + 1, None, word, None, None))
                    if tail:
                        last, first, j = tail
                        for line, half in ((k, last[:-1]), (j, first)):
                            if _strayed(half.strip(OUTER)):
                                out.append((doc, number, line + 1, "misread", None, None, None))
                        out += [(doc, number, k + 1, None, word, j + 1, size) for word, size in _joined(last, first, r.vocabulary)]
            out += [(*place, "hyphenation", None, None, None) for place, yes in zip(places, r.divided_words(ends), strict=True) if yes]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ([],) * 7, kinds, strict=True)], names)

    return work


def _strayed(bare: str) -> bool:
    """A mark between two letters, or the long s."""
    return "ſ" in bare or any(c in STRAY and bare[i - 1].isalpha() and bare[i + 1].isalpha() for i, c in enumerate(bare[:-1]) if i)


class Scans:
    """Damage of scanning on the pages of `pages`, and the pages without it.

    Pages are distinct (doc, page, text); null ids and null texts give no rows, empty texts no damage. Lines are
    the text cut at newlines, from 1. Lines that `boilerplate.frequent_lines` finds in the publisher's documents
    are neither damage nor text. An empty table gives an empty result.
    """

    def __init__(self, pages: DataFrame, records: DataFrame, *, doc: str = "document_id", page: str = "page_number", text: str = "page_text", filename: str = "source_filename", most_lines: int = 200_000, most_documents: int = 200_000):
        self.spark = pages.sparkSession
        self.names = (doc, page, text)
        self.rows = spread(pages).where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(page).cast("int").alias("page"), F.col(filename).alias("filename"), F.col(text).alias("text"))
        frequent = boilerplate.frequent_lines(pages, records, doc=doc, page=page, text=text)
        held: dict[str, set[int]] = {}
        pairs = [tuple(r) for r in frequent.select("source", "line_hash").distinct().limit(most_lines + 1).collect()]
        if len(pairs) <= most_lines:
            for source, line in pairs:
                held.setdefault(source, set()).add(line)
            known = boilerplate.publishers(records, doc=doc)
            self.rows = self.rows.join(F.broadcast(known) if known.count() <= most_documents else known.hint("merge"), "doc", "left").select("doc", "page", "filename", "text", F.lit(None).cast("array<int>").alias("added"), F.col("source").alias("publisher"))
        else:  # too many to hold: each page gets its own
            own = boilerplate.boilerplate_lines(pages, records, doc=doc, page=page, text=text).groupBy(F.col(doc).alias("doc"), F.col(page).cast("int").alias("page")).agg(F.collect_set("line_no").alias("_added"))
            self.rows = self.rows.join(own.hint("merge"), ["doc", "page"], "left").select("doc", "page", "filename", "text", F.coalesce("_added", F.array().cast("array<int>")).alias("added"), F.lit(None).cast("string").alias("publisher"))
        words = cut(self.rows.select("text").mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
        total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        usual = max(4.0, total * 1e-5)
        pairs = cut(candidate_pairs(words).mapInArrow(_edits, EDIT))
        support = pairs.where(F.col("m") >= 20 * F.col("n")).groupBy("stands", "should").agg(F.count_distinct("wrong").alias("support"))
        pairs = pairs.join(support.hint("merge"), ["stands", "should"], "left").withColumn("support", F.coalesce("support", F.lit(0)))
        ranker = self.spark.sparkContext.broadcast(train_ranker(pairs, usual))
        scored = pairs.mapInArrow(_ranked(ranker), "wrong string, right string, at int, score double")
        # Parts of divided words look like short misread words; these must be surer.
        sure = F.col("score") > F.when(F.length("wrong") <= 4, 1.2).otherwise(0.0)
        best = scored.where(sure).groupBy("wrong").agg(F.max_by(F.struct("right", "at", "score"), F.struct("score", "right")).alias("b"))
        self.corrections = cut(best.select("wrong", "b.right", "b.at", "b.score"))
        trusted = words.where(F.col("n") >= max(4, total * TRUSTED)).join(self.corrections.hint("merge"), F.col("word") == F.col("wrong"), "left_anti")
        vocabulary = {r[0]: r[1] for r in trusted.select("word", "n").collect()}
        self.reader = self.spark.sparkContext.broadcast(Reader(vocabulary, train_hyphens(vocabulary), held))
        self.found = cut(self.rows.mapInArrow(_read(self.reader), FOUND))

    def wrong_words(self) -> DataFrame:
        """(doc, page, line_no, wrong, right): the misread words of every page and what they should be."""
        asked = self.found.where("word IS NOT NULL")
        met = asked.join(self.corrections.hint("merge"), F.col("word") == F.col("wrong"))
        second = F.col("other_line").isNotNull() & (F.col("at") >= F.col("part"))
        return met.select("doc", "page", F.when(second, F.col("other_line")).otherwise(F.col("line_no")).alias("line_no"), "wrong", "right").distinct()

    def damage(self) -> DataFrame:
        """(doc, page, line_no, kind), each once."""
        doc, page, _ = self.names
        known = self.found.where("kind IS NOT NULL").select("doc", "page", "line_no", "kind")
        misread = self.wrong_words().select("doc", "page", "line_no", F.lit("misread").alias("kind"))
        return known.unionByName(misread).distinct().select(F.col("doc").alias(doc), F.col("page").alias(page), "line_no", "kind")

    def repaired(self) -> DataFrame:
        """(doc, page, text): every page as paragraphs, without furniture, with words mended and put together."""
        doc, page, text = self.names
        wrong = self.wrong_words().groupBy("doc", "page").agg(F.map_from_entries(F.collect_set(F.struct("wrong", "right"))).alias("mend"))
        rows = self.rows.dropDuplicates(["doc", "page"]).join(wrong.hint("merge"), ["doc", "page"], "left")
        return rows.mapInArrow(_repaired(self.reader), "doc string, page int, text string").select(F.col("doc").alias(doc), F.col("page").alias(page), F.col("text").alias(text))


def _ranked(ranker):
    def work(batches):
        for batch in batches:
            t = batch.to_pandas()
            x = features(*(t[c].to_numpy(np.float64) for c in ("n", "m", "support")))
            score = ranker.value.score(x) if ranker.value.trees else np.full(len(t), -1.0)
            yield pa.RecordBatch.from_arrays([pa.array(t["wrong"], pa.string()), pa.array(t["right"], pa.string()), pa.array(t["at"], pa.int32()), pa.array(score, pa.float64())], ["wrong", "right", "at", "score"])

    return work


def _cased(right: str, like: str) -> str:
    if len(like) > 1 and like.upper() == like and like.lower() != like:
        return right.upper()
    return right[:1].upper() + right[1:] if like[:1].isupper() else right


def repair(page: Page, mend: dict[str, str], reader: Reader) -> str:
    """The page's text: furniture dropped, divided words joined, misread words replaced, lines made paragraphs."""

    def mended(token: str) -> str:
        bare = token.strip(OUTER)
        for c in STRAY + "ſ":
            if c in bare[1:-1] and (bare.lower() not in mend):
                bare_new = bare.replace(c, "s" if c == "ſ" else "")
                return token.replace(bare, bare_new) if bare_new else token
        right = mend.get(word_of(bare) or "")
        return token.replace(bare, _cased(right, bare)) if right else token

    ends = [x for x in page.divided() if x[2] is not None]
    whole = reader.divided_words([(last, first) for _, last, _, first in ends])
    broken = {k: (j, first, yes) for (k, _, j, first), yes in zip(ends, whole, strict=True)}
    skip_first: set[int] = set()
    paragraphs: list[list[str]] = [[]]
    for k, line in enumerate(page.lines):
        if not line.strip():
            if not paragraphs[-1] or k in skip_first:
                continue
            paragraphs.append([])
            continue
        if page.outside(k):
            continue
        line = SET_APART.sub(lambda m: m.group().replace(" ", ""), line)
        tokens = line.split()
        if k in skip_first:
            tokens = tokens[1:]
        if k in broken and tokens:
            j, first, yes = broken[k]
            tokens[-1] = tokens[-1][:-1] + first if yes else tokens[-1] + first
            skip_first.add(j)
        paragraphs[-1] += [mended(t) for t in tokens]
    return "\n\n".join(" ".join(p) for p in paragraphs if p)


def _repaired(reader):
    def work(batches):
        r = reader.value
        for batch in batches:
            docs, pages, texts = [], [], []
            for doc, number, filename, text, added, publisher, mend in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                docs.append(doc)
                pages.append(number)
                texts.append(repair(_page(text, number, filename, added, publisher, r.publisher_lines), dict(mend or ()), r))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(pages, pa.int32()), pa.array(texts, pa.string())], ["doc", "page", "text"])

    return work
