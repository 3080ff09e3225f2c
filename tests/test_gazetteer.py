"""Names of the corpus by hand, and the automaton against a naive matcher."""

import random

import pyarrow as pa
import regex

from corpuslake.operators import entities, gazetteer
from corpuslake.operators.gazetteer import Name


def naive(text, listed):
    """Mentions by trying, at each word, every name from the longest on."""
    dated = [(m.start(), m.end(), m[0].strip(), m.lastgroup) for m in gazetteer._DATED.finditer(text)]
    words = [(m.start(), m.end(), m[0]) for m in regex.finditer(gazetteer.WORD, text)]
    free = [not any(a < e and s < b for a, b, *_ in dated) for s, e, _ in words]
    label = {n.text: n.label for n in listed}
    out, k = [(a, t, kind) for a, _, t, kind in dated], 0
    while k < len(words):
        step = 1
        for n in range(min(gazetteer.LONGEST, len(words) - k), 0, -1):
            part = words[k : k + n]
            together = all(text[part[i][1] : part[i + 1][0]] == " " for i in range(n - 1))
            name = " ".join(w for _, _, w in part)
            if together and all(free[k : k + n]) and name in label:
                out.append((part[0][0], name, label[name]))
                step = n
                break
        k += step
    return sorted(out)


def test_the_automaton_equals_a_naive_matcher():
    rnd = random.Random(1)
    vocabulary = ["Ann", "Lee", "Ohio", "New", "York", "York's", "of", "May", "in", "é", "Éire"]
    for _ in range(400):
        listed = [Name(t, rnd.choice(gazetteer.LABELS)) for t in {" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 3))) for _ in range(rnd.randint(0, 8))}]
        text = "".join(rnd.choice([*vocabulary, "May 3, 2015", "10:30 pm", "1999", "Monday"]) + rnd.choice([" ", " ", " ", ", ", "  ", ". ", "-"]) for _ in range(rnd.randint(0, 25)))
        assert gazetteer.found_in(text, gazetteer.automaton(listed)) == naive(text, listed), (text, listed)


def test_dates_and_times_apart():
    got = gazetteer.found_in("On Monday, June 16, 2015 at 3 p.m. and 10:30:05 AM; 2015-06-16, 4 July 1999, May 2001, noon, in 1984 but not 12345.", gazetteer.automaton([]))
    assert [(t, k) for _, t, k in got] == [
        *(("Monday, June 16, 2015", "DATE"), ("3 p.m.", "TIME"), ("10:30:05 AM", "TIME"), ("2015-06-16", "DATE"), ("4 July 1999", "DATE"), ("May 2001", "DATE"), ("noon", "TIME"), ("1984", "DATE"))
    ]


def test_names_and_labels_of_a_corpus(spark):
    texts = ["We met Mr Abel Stone in Ohio. The Romans came from Ohio with Abel Stone.", "Then Abel Stone spoke at Harrow University in Ohio on May 3, 2015. He thanked the Romans.", "Many of the Romans left Harrow University. But the stone in Ohio stayed. Stones and a stone.", None, ""]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts * 3)], "doc_id long, text string")
    listed = gazetteer.fit(docs, least=2)
    labels = {n.text: n.label for n in listed}
    assert labels["Ohio"] == "GPE" and labels["Romans"] == "NORP" and labels["Harrow University"] == "ORG" and "The" not in labels and "Then" not in labels and "Stones" not in labels
    assert labels.get("Abel Stone", "PERSON") == "PERSON"
    rows = gazetteer.mentions(docs, listed)
    first = {(r.text, r.label) for r in rows.where("doc_id = 1").collect()}
    assert {("Ohio", "GPE"), ("Harrow University", "ORG"), ("May 3, 2015", "DATE"), ("Romans", "NORP")} <= first
    groups = {(r.grp, r.text): r.cnt for r in entities.grouped(rows).where("doc_id = 0").collect()}
    assert groups["locations", "Ohio"] == 2 and groups["groups", "Romans"] == 1
    assert gazetteer.mentions(docs.limit(0), listed).count() == 0 and rows.where("doc_id in (3, 4)").count() == 0


def test_dates_are_tried_only_where_one_may_start(monkeypatch):
    rnd = random.Random(2)
    parts = ["May", "march", "March 3", "Monday", "Monday, ", "mİdnight", "NOON", "noon", "Midnight", "12", "1999", "2015-06-16", "10:30", "10:30:05 AM", "3 p.m.", "4 July 1999", "٣", "١٢:٣٠", "é", "e", "_", "́", "²", "\n", " ", " ", ", ", "-", ".", "nth", "st", "Sunday", "x"]
    for _ in range(5000):
        text = "".join(rnd.choices(parts, k=rnd.randint(1, 12)))
        assert [(m.span(), m.lastgroup) for m in gazetteer.dated(text)] == [(m.span(), m.lastgroup) for m in gazetteer._DATED.finditer(text)], repr(text)

    class Tried:
        def __init__(self):
            self.n = 0

        def match(self, text, at):
            self.n += 1

        def finditer(self, text):
            raise AssertionError("every place is tried")

    tried = Tried()
    monkeypatch.setattr(gazetteer, "_DATED", tried)
    gazetteer.found_in("words of no date, a number or none 5 and many more " * 100, gazetteer.automaton([]))
    assert tried.n == 100


def test_words_and_names_leave_a_task_counted(spark, monkeypatch):
    rnd = random.Random(3)
    vocabulary = ["Ann", "ann", "Lee", "Ohio", "York's", "of", "in", "é", "Éire", "éire", "mr", "x-y", "12"]
    texts = ["".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", ". ", "! ", ", ", "\n"]) for _ in range(rnd.randint(0, 60))) for _ in range(200)] + [None, "", "  "]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    want, votes = {}, {}
    known = frozenset(["ann", "lee", "ohio", "éire"])
    for t in texts:
        for s in regex.split(r"(?<=[.!?])[ \t\n\v\f\r]+", (t or "").strip(" ")):
            for w in regex.findall(gazetteer.WORD, s)[1:]:
                c = want.setdefault(w.lower(), [0, 0])
                c[not w[0].isupper()] += 1
            for name, before in gazetteer.runs(s, known):
                votes.setdefault(name, []).append(gazetteer.vote(name, before))
    for piece in (gazetteer.PIECE, 50):
        monkeypatch.setattr(gazetteer, "PIECE", piece)
        rows = gazetteer.name_words(docs)
        assert {r.word: [r.capital, r.plain] for r in rows.collect()} == want
        assert {(r["name"], r.n) for r in gazetteer.names(docs, known, least=1).collect()} == {(k, len(v)) for k, v in votes.items()}
    assert "Generate" not in rows._jdf.queryExecution().toString()  # no row for each word


def test_texts_passed_over_hold_nothing(monkeypatch):
    rnd = random.Random(4)
    vocabulary = ["Ann", "ann", "(Ann", "Lee.", "x-Lee", "Lee", "Ohio,", "New", "York", "of", "May", "May 3", "mid", "noon", "7", "a7", "é7", "1999", "Éire"]
    texts = ["".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", ", ", "\u2003", "\x1c", "\n", "-"]) for _ in range(rnd.randint(0, 6))) for _ in range(3000)]
    listed = [Name("Ann Lee", "PERSON"), Name("Ohio", "GPE"), Name("New York", "GPE"), Name("of", "ORG")]
    machine, first = gazetteer.automaton(listed), frozenset(["Ann", "Ohio", "New", "of"])
    want = [gazetteer.found_in(t, machine) for t in texts]
    tried, kept = [], gazetteer.found_in
    monkeypatch.setattr(gazetteer, "found_in", lambda t, m: tried.append(t) or kept(t, m))
    got = {at + k: f for at in range(0, 3000, 10) for k, f in gazetteer.found_in_all(pa.array(texts[at : at + 10]), machine, first)}
    assert [got.get(k, []) for k in range(3000)] == want and len(tried) < 2700
    known = frozenset(["ann", "lee", "éire"])
    for at in range(0, 3000, 10):
        votes = [(n, gazetteer.vote(n, b)) for t in texts[at : at + 10] for n, b in gazetteer.runs(t, known)]
        rows = gazetteer.votes_in(pa.array(texts[at : at + 10]), known).to_pylist()
        assert {(r["name"], r["vote"]): r["n"] for r in rows} == gazetteer.Counter(votes)
