"""Problem 10: the subject areas of each document.

One linear classifier per area, against the rest, over hashed word uni- and bigrams. The training rows are the
labelled documents (a bounded sample, `most_labelled`) and weak labels: the areas' own descriptions, documents
whose address (source) or section name holds a word of exactly one area's key or title, and, as neither may say
anything, documents the classifiers of the round before find clearly about one area. A first round over the hand
labels takes every feature that leans to an area; the `ROUNDS` after it, with many more documents, only features
that chance does not explain. The weights judge single sentences: a sentence is about the area whose classifier is
surest, if it clears the margin, and a document has every area that enough of its sentences are about. Margin and share are
calibrated per area on labelled documents held out of the training.

Only the labelled sample and an equally bounded one without labels (`most_unlabelled`) reach the driver; every
document is scored whole, where it lies, without a shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.hashing import WordIds, mix
from lectern.session import spread

FEATURES = 1 << 22
ROUNDS, CLEAR, LEANING = 3, 0.6, 6.0  # rounds of weak labels, an area's part in the scores of a clear document, the first round's bound
TOKENS = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
SENTENCES = re.compile(r"(?<=[.!?])(?<!\bNo\.)(?<!\bal\.)\s+(?=[^\Wa-zß-ÿ]|[¿¡\"“«(])|\n\s*\n")


def sentence_tokens(text: str) -> list[list[str]]:
    """Words of each sentence that has any."""
    return [w for w in map(TOKENS.findall, SENTENCES.split(text.lower() if text.isupper() else text)) if w]


class Hashed:
    """Word ids below FEATURES of many sentences, and the bigrams made of them."""

    def __init__(self):
        self.ids = WordIds()

    def words(self, words: list[str]) -> np.ndarray:
        return (mix(self.ids([w.lower() for w in words])) & np.uint64(FEATURES - 1)).astype(np.int32)


def with_bigrams(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, position of its sentence) for the words of sentences that begin at `starts`."""
    sentence = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(words))))
    pairs = (mix(words[:-1].astype(np.uint64) * np.uint64(FEATURES) + words[1:].astype(np.uint64) + np.uint64(1 << 40)) & np.uint64(FEATURES - 1)).astype(np.int32)
    inside = sentence[:-1] == sentence[1:]
    return np.concatenate((words, pairs[inside])), np.concatenate((sentence, sentence[:-1][inside]))


def telling(rows: np.ndarray, columns: np.ndarray, targets: np.ndarray, bound: float | None = None) -> np.ndarray:
    """Which (row, feature) pairs are of features that come with some area more often than chance explains.

    Most of its rows are the area's, and the log-likelihood ratio of the area's part in them against its part
    overall is above `bound`, or one that about one feature of all would pass by chance.
    """
    used, columns = np.unique(columns, return_inverse=True)
    held = np.bincount(columns).astype(np.float64)
    areas = targets.shape[1]
    bound = bound or 2 * np.log(max(2, (held > 1).sum() * areas))
    keep = np.zeros(len(used), bool)
    for k in range(areas):
        part = min(max(targets[:, k].mean(), 1e-9), 1 - 1e-9)
        inside = np.bincount(columns, weights=targets[rows, k], minlength=len(used))
        share = inside / np.maximum(held, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(inside > 0, inside * np.log(share / part), 0) + np.where(inside < held, (held - inside) * np.log((1 - share) / (1 - part)), 0))
        keep |= (share > max(part, 0.5)) & (ratio > bound)
    return keep[columns]


def fit(rows: np.ndarray, columns: np.ndarray, targets: np.ndarray, weights: np.ndarray, bound: float | None = None, steps: int = 60, rate: float = 0.2, decay: float = 1.5e-3) -> tuple[np.ndarray, np.ndarray]:
    """(place of every feature, weights [places, areas]; place 0 has weight 0) of one-versus-rest logistic regressions; (row, column) pairs are distinct.

    Full-gradient Adam over the telling features, on rows scaled to unit length.
    """
    keep = telling(rows, columns, targets, bound)
    rows, columns = rows[keep], columns[keep]
    place = np.zeros(FEATURES, np.int32)
    if not len(rows):
        return place, np.zeros((1, targets.shape[1]), np.float32)
    used, columns = np.unique(columns, return_inverse=True)
    order = np.argsort(rows, kind="stable")
    rows, columns = rows[order], columns[order]
    n, areas = targets.shape
    scale = (1 / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))).astype(np.float32)[:, None]
    present, starts = np.unique(rows, return_index=True)
    back = np.argsort(columns, kind="stable")
    rows_back, starts_back = rows[back], np.flatnonzero(np.diff(columns[back], prepend=-1))
    w, bias = np.zeros((len(used), areas), np.float32), np.zeros(areas, np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.zeros((n, areas), np.float32)
        z[present] = np.add.reduceat(w[columns], starts, axis=0)
        error = (1 / (1 + np.exp(-np.clip(z * scale + bias, -30, 30))) - targets) * weights[:, None]
        bias -= error.sum(axis=0) / weights.sum()
        gradient = np.add.reduceat((error * scale)[rows_back], starts_back, axis=0) / weights.sum() + decay * w
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    place[used] = np.arange(1, len(used) + 1)
    return place, np.concatenate((np.zeros((1, areas), np.float32), w))


@dataclass
class Model:
    areas: list[str]
    place: np.ndarray
    weights: np.ndarray
    margin: float
    shares: np.ndarray

    def scores(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Score of every sentence (rows) for its best area, 0 for the others: a sentence is about one area at most."""
        features, sentence = with_bigrams(words, starts)
        order = np.argsort(sentence, kind="stable")
        firsts = np.flatnonzero(np.diff(sentence[order], prepend=-1))
        every = np.add.reduceat(self.weights[self.place[features[order]]], firsts, axis=0)
        best = every.argmax(axis=1)
        out = np.zeros_like(every)
        rows = np.arange(len(best))
        out[rows, best] = np.maximum(every[rows, best], 0)
        return out


def _features(shape_names):
    def work(batches):
        hashed = Hashed()
        for batch in batches:
            words, starts = [], []
            for text in batch.column(1).to_pylist():
                sentences = sentence_tokens(text)
                words.append(hashed.words([w for s in sentences for w in s]).tolist())
                starts.append(np.cumsum([0, *map(len, sentences)])[:-1].tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int32()))], shape_names)

    return work


def weak_labels(documents: DataFrame, areas: list[tuple], doc: str, address: list[str]) -> DataFrame:
    """(doc, subject): documents whose address or section names hold words of exactly one area's key or title."""
    found = F.array(*[F.when(F.arrays_overlap(F.split(F.lower(F.concat_ws(" ", *address)), "[^a-z]+"), F.array(*map(F.lit, sorted(_own_words(key, title))))), F.lit(key)) for key, title, _ in areas])
    return documents.select(F.col(doc).alias("doc"), F.filter(found, lambda x: x.isNotNull()).alias("s")).where("size(s) = 1").select("doc", F.col("s")[0].alias("subject"))


def _own_words(key: str, title: str | None) -> set[str]:
    return {w for w in re.findall("[a-z]+", f"{key} {title or ''}".lower()) if len(w) > 3} - {"public", "information"}


def train(documents: DataFrame, areas: DataFrame, labels: DataFrame, *, doc: str = "doc_id", text: str = "text", address: tuple[str, ...] = ("source", "doc_kind"), most_labelled: int = 20_000, most_unlabelled: int = 4_000) -> Model:
    """Fit and calibrate on at most `most_labelled` labelled documents and `most_unlabelled` others, taken in the order of a hash of the id."""
    known = sorted((tuple(r) for r in areas.select("subject", "title", "description").where("subject is not null").distinct().collect()), key=lambda r: r[0])
    names = list(dict.fromkeys(r[0] for r in known))
    texts = documents.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    sample = labels.select(F.col(doc).cast("bigint").alias("doc"), "subject").where(F.col("doc").isNotNull() & F.col("subject").isin(names)).distinct()
    chosen = sample.select("doc").distinct().orderBy(F.xxhash64("doc"), "doc").limit(most_labelled)
    hand = {r[0]: r[1] for r in sample.join(chosen, "doc", "left_semi").groupBy("doc").agg(F.collect_set("subject")).collect()}
    weak = {r[0]: [r[1]] for r in weak_labels(documents, known, doc, list(address)).orderBy(F.xxhash64("doc"), "doc").limit(most_labelled // 4).collect()} if address else {}
    others = [r[0] for r in texts.select("doc").distinct().orderBy(F.xxhash64("doc", F.lit(1)), "doc").limit(most_unlabelled).collect()]
    ids = sorted({*hand, *weak, *others})  # bounded by the parameters
    if not hand and not weak:
        return Model(names, np.zeros(FEATURES, np.int32), np.zeros((1, max(1, len(names))), np.float32), np.inf, np.full(max(1, len(names)), 2.0))
    wanted = documents.sparkSession.createDataFrame([(x,) for x in ids], "doc bigint")
    used = texts.join(F.broadcast(wanted), "doc", "left_semi").mapInArrow(_features(["doc", "words", "starts"]), "doc bigint, words array<int>, starts array<int>").toArrow()

    def bag(words, starts):
        """(words, where sentences start, distinct features) of a text."""
        return words, starts, np.unique(with_bigrams(words, starts)[0]) if len(words) else words

    bags = {}
    for d, words, starts in zip(used.column("doc").to_pylist(), used.column("words").combine_chunks(), used.column("starts").combine_chunks(), strict=True):
        if len(words):
            bags[d] = bag(words.values.to_numpy().astype(np.int32), starts.values.to_numpy().astype(np.int64))
    hashed = Hashed()
    own = [bag(hashed.words(TOKENS.findall(f"{title or ''} {description or ''}")), np.zeros(1, np.int64)) for _, title, description in known]

    def targets(subjects: list[list[str]]) -> np.ndarray:
        return np.array([[a in x for a in names] for x in subjects], np.float32).reshape(-1, len(names))

    def fitted(rows: list[tuple], bound: float | None) -> Model:
        """`rows` are (bag, subjects, weight)."""
        rows = [*rows, *((b, [r[0]], 0.3) for b, r in zip(own, known, strict=True))]
        features = [b[2] for b, _, _ in rows]
        places = np.repeat(np.arange(len(rows)), [len(f) for f in features])
        return Model(names, *fit(places, np.concatenate(features), targets([x for _, x, _ in rows]), np.array([w for _, _, w in rows], np.float32), bound), 0.0, np.full(len(names), 0.25))

    def clear(model: Model) -> list[tuple]:
        """Documents without a hand label that are about one area, beyond what they say of all others."""
        out = []
        for d, b in bags.items():
            if d not in hand:
                scores = model.scores(*b[:2])
                part = np.maximum(scores, 0).sum(axis=0)
                k = int(part.argmax())
                if part[k] > 0 and part[k] >= CLEAR * part.sum() and (scores[:, k] > model.margin).mean() >= 0.25:
                    out.append((b, [names[k]], 0.3))
        return out

    held_out = {d for d in hand if int(mix(np.array([d], np.int64).view(np.uint64))[0] % np.uint64(5)) == 0}
    taught = [(b, hand[d], 1.0) for d, b in bags.items() if d in hand and d not in held_out]
    checked = [(b, hand[d], 1.0) for d, b in bags.items() if d in held_out] or taught
    by_address = [(b, weak[d], 0.3) for d, b in bags.items() if d in weak and d not in hand]
    if not checked:  # no labelled text has a word
        return Model(names, np.zeros(FEATURES, np.int32), np.zeros((1, max(1, len(names))), np.float32), np.inf, np.full(max(1, len(names)), 2.0))
    model = fitted(taught + by_address, LEANING)
    calibrate(model, [b for b, _, _ in checked], targets([x for _, x, _ in checked]))
    for last in range(ROUNDS):
        found = clear(model)
        model = fitted(taught + by_address + found, None)
        calibrate(model, [b for b, _, _ in checked], targets([x for _, x, _ in checked]))
        if last == ROUNDS - 1:  # what was held out has served, and is taught as well
            whole = fitted(taught + (checked if held_out else []) + by_address + found, None)
            model.place, model.weights = whole.place, whole.weights
    return model


def calibrate(model: Model, bags: list, truth: np.ndarray) -> None:
    """Choose the margin by F1 over all areas, then for each area the share of sentences.

    Of all that do as well as the best, but for a standard error, the least margin and the share nearest a quarter."""
    y, sizes = truth > 0.5, np.array([len(b[1]) for b in bags])
    offsets = np.cumsum([0, *(len(b[0]) for b in bags)])[:-1]
    every = model.scores(np.concatenate([b[0] for b in bags]), np.concatenate([b[1] + o for b, o in zip(bags, offsets, strict=True)]))
    firsts, scores = np.cumsum(sizes) - sizes, every.max(axis=1)
    grid = np.linspace(0.05, 0.45, 41)

    def shares(margin):
        return np.add.reduceat((every > margin).astype(np.float64), firsts, axis=0) / sizes[:, None]

    def f1(hit, truth):
        return 2 * (hit & truth).sum(axis=0) / np.maximum(1, hit.sum(axis=0) + truth.sum(axis=0))

    def error(best, cases):
        """A standard error of F1 `best` over so many cases: what is nearer is as good."""
        best = (best * cases + 1) / (cases + 2)
        return max(0.002, (best * (1 - best) / max(1, cases)) ** 0.5)

    top = -1.0
    for margin in np.unique([0.0, *np.quantile(scores[scores > 0], np.linspace(0, 0.5, 26))]) if (scores > 0).any() else [0.0]:
        table = shares(margin)
        got = max(f1((table >= g).ravel(), y.ravel()) for g in (0.15, 0.2, 0.25))
        if top < 0 or got > top + error(top, y.sum()):  # a wider margin must earn it
            top, model.margin = got, float(margin)
    table = shares(model.margin)

    def nearest_quarter(values, cases):
        good = grid[values >= values.max() - error(values.max(), cases)]
        return float(good[np.abs(good - 0.25).argmin()])

    overall = nearest_quarter(np.array([f1((table >= g).ravel(), y.ravel()) for g in grid]), y.sum())
    for k in range(len(model.areas)):
        per = np.array([f1(table[:, k] >= g, y[:, k]) for g in grid])
        # few held-out cases say little about one area: stay at the pooled share if it is among the best
        best = per.max()
        model.shares[k] = overall if per[np.abs(grid - overall).argmin()] >= best - error(best, y[:, k].sum()) else nearest_quarter(per, y[:, k].sum())


def _scored(model):
    def work(batches):
        m, hashed = model.value, Hashed()
        for batch in batches:
            docs, subjects, shares = [], [], []
            ids, sizes, flat, owner = batch.column(0).to_pylist(), [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                for words in sentence_tokens(text):
                    flat += words
                    sizes.append(len(words))
                    owner.append(row)
            if flat:
                about = m.scores(hashed.words(flat), np.cumsum([0, *sizes])[:-1]) > m.margin
                count = np.bincount(owner, minlength=len(ids))
                table = np.stack([np.bincount(owner, weights=about[:, k], minlength=len(ids)) for k in range(len(m.areas))], axis=1) / np.maximum(1, count)[:, None]
                for row, k in zip(*np.nonzero(table >= m.shares), strict=True):
                    docs.append(ids[row])
                    subjects.append(m.areas[k])
                    shares.append(float(table[row, k]))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(subjects, pa.string()), pa.array(shares, pa.float64())], ["doc", "subject", "share"])

    return work


def subjects(documents: DataFrame, model: Model, *, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, subject, share): every area that enough of the document's sentences are about.

    Null ids and texts, and texts without words, have no subject; a document may have several. A row sent twice
    gives its rows twice. The model's size is bounded by the hash space, so it goes to every task.
    """
    texts = spread(documents).select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    held = documents.sparkSession.sparkContext.broadcast(model)
    return texts.mapInArrow(_scored(held), "doc bigint, subject string, share double").withColumnRenamed("doc", doc)
