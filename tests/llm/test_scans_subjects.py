import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import scans, subjects
from lectern.llm.boosting import Boosted

NAMES = "river licence harbour ministry estimate forward public agency inter-agency measure condition protocol wetland forest project interim statement deliver guideline respect".split()


def test_boosting_learns_an_interaction():
    rng = np.random.RandomState(0)
    x = rng.rand(2000, 3)
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    model = Boosted(rounds=40).fit(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.97


def test_edits_words_and_furniture():
    assert scans.edit("schcme", "scheme") == ("c", "e", 3, 2)
    assert scans.near("praernouth", "praemouth") and not scans.near("river", "rivet wide")
    assert [scans.word_of(x) for x in ("(River),", "17-B", "p0licy", "XA223", "a", "…")] == ["river", None, "p0licy", None, None, None]
    assert scans.roman("xiv") == 14
    page = scans.Page(["2  Remote habitat inspection", "Text of the page.", "More text", "302.", "- 2 -"], 2, ["remote", "habitat", "inspection"], set())
    assert page.headers == {0} and page.numbers == {4}
    assert scans.title_words("remote-habitat-2021.pdf") == ["remote", "habitat"]
    assert scans.title_words(None) == []


@pytest.fixture(scope="module")
def book(spark):
    rng = np.random.RandomState(3)
    words = [*NAMES, *["".join(rng.choice(list("bdglmnprs"), 1)[0] + v for v in rng.choice(list("aiou"), 4)) for _ in range(60)]]
    rows, damage = [], set()
    swap = {"e": "c", "t": "f", "a": "ä", "l": "1", "o": "0"}
    for n in range(120):
        lines = []
        for k in range(12):
            line = [words[i] for i in rng.randint(0, len(words), 8)]
            if n % 2 and k % 4 == 1:
                w = rng.randint(8)
                letters = [i for i, c in enumerate(line[w]) if c in swap and i]
                if letters:
                    i = letters[rng.randint(len(letters))]
                    line[w] = line[w][:i] + swap[line[w][i]] + line[w][i + 1 :]
                    damage.add((f"d{n}", 1, k + 2, "misread"))
            lines.append(" ".join(line))
        if n % 3 == 0:
            lines[3], lines[4] = lines[3] + " proto-", "col " + lines[4]
            damage.add((f"d{n}", 1, 5, "hyphenation"))
        if n % 3 == 1:
            lines[3], lines[4] = lines[3] + " inter-", "agency " + lines[4]
        rows.append((f"d{n}", 1, f"old-port-plan-{n % 7}x-2020.pdf", "Old port plan {}x\n".format(n % 7) + "\n".join(lines) + "\n- 1 -"))
        damage |= {(f"d{n}", 1, 1, "running_header"), (f"d{n}", 1, 14, "page_number")}
    extra = [("e1", 1, None, ""), ("e2", 1, None, None), (None, 1, None, "x"), ("e3", None, None, "a\r\nb"), rows[0]]
    shape = "document_id string, page_number int, source_filename string, page_text string"
    pages = spark.createDataFrame([*rows, *extra], shape).withColumn("word", F.lit("clash"))
    records = spark.createDataFrame([("d0", "P", dt.datetime(2024, 1, 1))], "document_id string, publisher string, uploaded_at timestamp")
    return scans.Scans(pages, records), damage, pages, records


def test_damage_is_found(book):
    found = {tuple(r) for r in book[0].damage().collect()}
    for kind in ("running_header", "page_number", "hyphenation", "misread"):
        got, want = ({x for x in s if x[3] == kind} for s in (found, book[1]))
        least = 1.0 if kind in ("running_header", "page_number") else 0.9
        assert len(got & want) >= least * len(want), kind
        assert len(got & want) >= least * len(got), kind


def test_pages_are_repaired(book):
    text = {r.document_id: r.page_text for r in book[0].repaired().collect()}
    assert "protocol" in text["d0"] and "proto-" not in text["d0"] and "- 1 -" not in text["d0"] and "\n" not in text["d0"]
    assert "inter-agency" in text["d4"]
    assert text["e1"] == "" and "e2" not in text


def test_an_empty_book(book):
    pages, records = book[2], book[3]
    assert scans.Scans(pages.limit(0), records.limit(0)).damage().count() == 0


@pytest.fixture(scope="module")
def library(spark):
    rng = np.random.RandomState(5)
    topics = {"health": ["nurse", "clinic", "vaccine", "klinik", "patient"], "energy": ["grid", "turbine", "fuel", "netz", "reactor"], "sport": ["match", "goal", "league", "pokal", "coach"]}
    plain = "the plan was sent to members who asked for more time before they decided on it again".split()
    docs, truth = [], {}
    for n in range(1, 601):
        own = [list(topics)[i] for i in rng.choice(3, 1 + (n % 5 == 0), replace=False)]
        sentences = [" ".join([*rng.choice(plain, 6), rng.choice(topics[own[k % len(own)]]), *rng.choice(plain, 4)]).capitalize() + "." for k in range(8)]
        if n % 4 == 0:
            other = [x for x in topics if x not in own][0]
            sentences[-1] = " ".join([*rng.choice(plain, 6), topics[other][0]]).capitalize() + "."
        docs.append((n, " ".join(sentences)))
        truth[n] = set(own)
    labels = [(n, s) for n in range(1, 401) for s in truth[n]] + [(1, "energy"), (None, "energy"), (2, "unknown area"), (9999, "health")]
    docs += [(700, None), (701, ""), (702, "!!! 123")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("source", F.lit("misc")).withColumn("doc_kind", F.lit(None).cast("string")).withColumn("subject", F.lit("clash"))
    areas = spark.createDataFrame([(k, k, None) for k in topics], "subject string, title string, description string")
    return df, areas, spark.createDataFrame(labels, "doc_id bigint, subject string"), truth


def test_held_out_documents_get_their_subjects(library):
    df, areas, labels, truth = library
    model = subjects.train(df, areas, labels)
    got = {}
    for r in subjects.subjects(df, model).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held = range(401, 601)
    hit = sum(len(got.get(n, set()) & truth[n]) for n in held)
    assert hit >= 0.95 * sum(len(truth[n]) for n in held) and hit >= 0.95 * sum(len(got.get(n, set())) for n in held)
    assert not set(got) & {700, 701, 702}


def test_without_labels_nothing_is_assigned(library):
    df, areas, labels, _ = library
    model = subjects.train(df, areas, labels.limit(0))
    assert subjects.subjects(df, model).count() == 0
    assert subjects.subjects(df.limit(0), model).count() == 0


def test_sentences_and_bigrams_stay_apart():
    assert subjects.sentence_tokens("See Act No. 5 now. Glisk et al. report it. Übung folgt") == [["See", "Act", "No", "now"], ["Glisk", "et", "al", "report", "it"], ["Übung", "folgt"]]
    features, sentence = subjects.with_bigrams(np.array([1, 2, 3], np.int32), np.array([0, 2]))
    assert len(features) == 4 and sentence.tolist() == [0, 0, 1, 0]
