"""Mentions by lists of names that the corpus itself gives, and by a grammar of dates and times.

1. Case statistics: a word that stands within sentences mostly with a capital is a word of names. One partial aggregate by word.
2. Runs of such words are the names; what stands around them over the whole corpus votes for their label (a title before, a
   preposition of place, an ending, a word of organisations). One partial aggregate by name.
3. An Aho-Corasick automaton of all names runs over each text's words: at each place the leftmost, longest name counts. Dates
   and times come from patterns and go before names that they overlap.

The lists are the model's size: the MOST commonest words and names of those that are there LEAST times. Counts are over all texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import text as T

#: Entries of a list at most, the least number of occurrences, the least share with a capital, the longest name in words.
MOST, LEAST, SHARE, LONGEST = 200_000, 3, 0.8, 5
WORD = r"\p{L}+(?:['’-]\p{L}+)*"
#: Bytes of text that a task takes at a time.
PIECE = 1 << 24

# What stands before or in a name of each kind, the order in which equal votes count, months and days.
TITLES = frozenset("mr mrs ms dr president senator governor secretary judge general professor king queen sir".split())
PLACES = frozenset("in at from near to across throughout".split())
ORGANISED = frozenset("inc corp company university department committee party bank association agency council court institute".split())
PEOPLE = ("ans", "ists", "crats", "ese", "ish")
LABELS = ("PERSON", "ORG", "NORP", "GPE")
_MONTH = r"(?:January|February|March|April|May|June|July|August|September|October|November|December)"
_DAY = r"(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"
TIMES = r"\b\d{1,2}:\d{2}(?::\d{2})?(?:\s?[ap]\.?m\b\.?)?|\b\d{1,2}\s?[ap]\.?m\b\.?|\b(?:noon|midnight)\b"
DATES = rf"\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b(?:{_DAY},? )?{_MONTH} \d{{1,2}}(?:st|nd|rd|th)?(?:, \d{{4}})?\b|\b\d{{1,2}} {_MONTH}(?: \d{{4}})?\b|\b{_MONTH} \d{{4}}\b|\b{_DAY}\b|\b(?:19|20)\d{{2}}\b"
_DATED = regex.compile(rf"(?P<TIME>(?i:{TIMES}))|(?P<DATE>{DATES})")
#: Where a date or time may start: a digit or the first word of one, no ASCII letter or digit before it. It is tried there only.
_START = regex.compile(
    r"[\dJFMASONDTWNnm](?<![A-Za-z0-9_].)(?:(?<=\d)|anuary|ebruary|arch|pril|ay|une|uly|ugust|eptember|ctober|ovember|ecember|onday|uesday|ednesday|hursday|riday|aturday|unday|(?i:oon|idnight))"
)
#: What a word that _START fits in begins with, and some more.
_STARTS = "^[JFMASONDTWNnm](?:anuary|ebruary|arch|pril|ay|une|uly|ugust|eptember|ctober|ovember|ecember|onday|uesday|ednesday|hursday|riday|aturday|unday|[oO]|[iIİı])"
_WORD = regex.compile(WORD)
#: What may stand around a word and is neither letter nor digit.
_MARKS = ".,;:!?()[]\"'’“”„«»…-–—"


class Name(NamedTuple):
    """A name as it is written, and its label."""

    text: str
    label: str


def pieces(values: pa.Array) -> Iterator[pa.Array]:
    """The strings in order, some PIECE bytes at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(ends // PIECE)) + 1).tolist(), len(values)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield values.slice(a, b - a)


def counted(docs: DataFrame, of: Callable[[pa.Array], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``of`` counts in the sentences of the texts, piece by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from map(of, pieces(batch.column(0).flatten()))

    return docs.select(T.sentences("text").alias("s")).mapInArrow(run, schema)


def words_of(parts: pa.Array) -> tuple[pa.Array, list[tuple[int, list[str]]]]:
    """The words of strings without white space: mostly one with marks around it (null where not), and the others by their places."""
    core = pc.utf8_trim(parts, characters=_MARKS)
    one = pc.utf8_is_alpha(core)
    others = pc.indices_nonzero(pc.invert(one))
    found = zip(others.to_pylist(), (_WORD.findall(p) for p in parts.take(others).to_pylist()))
    return pc.if_else(one, core, None), list(found)


def later_words(sentences: pa.Array) -> pa.RecordBatch:
    """w, n: how often words stand in sentences, less how often they come first. White space ends a word, so words are looked for once in equal strings."""
    every = pc.value_counts(pc.utf8_split_whitespace(sentences).flatten())
    start = pc.list_element(pc.utf8_split_whitespace(sentences, max_splits=1), 0)
    starts = pc.value_counts(start)
    words, times = [], []
    one, others = words_of(every.field(0))
    more, n = Counter(), every.field(1).to_numpy()
    for at, found in others:
        for w in found:
            more[w] += int(n[at])
    words.append(one.drop_null())
    times.append(every.field(1).filter(pc.is_valid(one)))
    one, others = words_of(starts.field(0))
    n = starts.field(1).to_numpy()
    for at, found in others:
        if found:
            more[found[0]] -= int(n[at])
    words.append(one.drop_null())
    times.append(pc.negate(starts.field(1).filter(pc.is_valid(one))))
    bare = starts.field(0).take(pa.array([at for at, found in others if not found], pa.int64()))  # the first word stands further on
    for s in sentences.filter(pc.is_in(start, value_set=bare)).to_pylist():
        if first := _WORD.search(s):
            more[first[0]] -= 1
    words.append(pa.array(list(more), pa.string()))
    times.append(pa.array(list(more.values()), pa.int64()))
    summed = pa.table({"w": pa.chunked_array(words), "n": pa.chunked_array(times)}).group_by("w").aggregate([("n", "sum")])
    return pa.RecordBatch.from_arrays([summed.column("w").combine_chunks(), summed.column("n_sum").combine_chunks()], ["w", "n"])


def holding(texts: pa.Array, marked: Callable[[pa.Array], list[list[str]]]) -> list[pa.Array]:
    """For each list of strings without white space that ``marked`` takes from their distinct ones, the places of the texts that hold one of them."""
    lists = pc.utf8_split_whitespace(texts)
    parts, place = lists.flatten(), pc.list_parent_indices(lists)
    return [pc.unique(place.filter(pc.is_in(parts, value_set=pa.array(some, pa.string())))) for some in marked(pc.unique(parts))]


def votes_in(sentences: pa.Array, known: frozenset[str]) -> pa.RecordBatch:
    """name, vote, n: how often each name has each vote. Most sentences hold no word of names with a capital and are passed over."""

    def marked(parts: pa.Array) -> list[list[str]]:
        cased = parts.filter(pc.match_substring_regex(parts, r"\p{Lu}"))
        one, others = words_of(cased)
        fits = lambda w: w[0].isupper() and w.lower() in known
        out = [p for p, w in zip(cased.to_pylist(), one.to_pylist()) if w and fits(w)]
        return [out + [cased[at].as_py() for at, found in others if any(map(fits, found))]]

    some = sentences.take(holding(sentences, marked)[0]).to_pylist()
    votes = Counter((name, vote(name, before)) for s in some for name, before in runs(s, known))
    return pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], ["name", "vote", "n"])


def name_words(docs: DataFrame) -> DataFrame:
    """word (lower case), capital, plain: how often a word stands with and without a capital behind a sentence's first word."""
    rows = counted(docs, later_words, "w string, n long")
    rows = rows.select(F.lower("w").alias("word"), F.rlike("w", F.lit(r"^\p{Lu}")).alias("c"), "n")
    rows = rows.where("n > 0")  # 0: first words only
    return rows.groupBy("word").agg(F.sum(F.when(F.col("c"), F.col("n")).otherwise(0)).alias("capital"), F.sum(F.when(F.col("c"), 0).otherwise(F.col("n"))).alias("plain"))


def chosen_words(counts: DataFrame, most: int = MOST, least: int = LEAST, share: float = SHARE) -> DataFrame:
    """word, capital of the words of names."""
    rows = counts.where((F.col("capital") >= least) & (F.col("capital") >= share * (F.col("capital") + F.col("plain"))))
    return rows.orderBy(F.desc("capital"), "word").limit(most).select("word", "capital")


def runs(sentence: str, known: frozenset[str]) -> Iterator[tuple[str, str]]:
    """(name, the word before it in lower case) for each run of capitalised words of names that are a space apart."""
    before, held, end = "", [], -1
    for m in _WORD.finditer(sentence):
        w = m[0]
        fits = w[0].isupper() and w.lower() in known
        if held and (not fits or m.start() != end + 1 or sentence[end] != " " or len(held) == LONGEST):
            yield " ".join(held), before
            before, held = held[-1].lower(), []
        if fits:
            held.append(w)
        else:
            before = w.lower()
        end = m.end()
    if held:
        yield " ".join(held), before


def vote(name: str, before: str) -> str:
    """The label that one occurrence speaks for."""
    words = name.lower().split(" ")
    if words[-1] in ORGANISED or words[0] in ORGANISED:
        return "ORG"
    if before in TITLES or words[0] in TITLES:
        return "PERSON"
    if len(words) == 1 and words[0].endswith(PEOPLE):
        return "NORP"
    return "GPE" if before in PLACES else "PERSON" if len(words) > 1 else ""


def names(docs: DataFrame, words: frozenset[str], most: int = MOST, least: int = LEAST) -> DataFrame:
    """name, n, label: the names of the corpus, commonest first; the label with most votes (GPE where none speaks)."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    votes = counted(docs, lambda sentences: votes_in(sentences, shared.value), "name string, vote string, n long")
    counts = votes.groupBy("name").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("vote") == k, F.col("n")).otherwise(0)).alias(k) for k in LABELS])
    best = F.array_max(F.array(*[F.struct(F.col(k).alias("n"), F.lit(-i).alias("i"), F.lit(k).alias("label")) for i, k in enumerate(LABELS)]))
    rows = counts.where(F.col("n") >= least).select("name", "n", F.when(best["n"] > 0, best["label"]).otherwise("GPE").alias("label"))
    return rows.orderBy(F.desc("n"), "name").limit(most)


def wrapped(words: list[str]) -> str:
    """Words with marks of their own around them, so that a name matches whole words only."""
    return "".join(f"\x01{w}\x02" for w in words)


def automaton(listed: list[Name]):  # noqa: ANN201
    """The automaton of all names."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for name in listed:
        words = name.text.split(" ")
        out.add_word(wrapped(words), (len(words), name.label))
    if listed:
        out.make_automaton()
    return out


def dated(text: str) -> Iterator[regex.Match]:
    """The dates and times of a text, as _DATED.finditer() gives them."""
    end = 0
    for at in _START.finditer(text):
        if at.start() >= end and (m := _DATED.match(text, at.start())):
            yield m
            end = m.end()


def found_in(text: str, machine) -> list[tuple[int, str, str]]:  # noqa: ANN001
    """(place, text, label) of the mentions of a text, by place; dates and times before names that they overlap."""
    dates = list(dated(text))
    out = [(m.start(), m[0].strip(), m.lastgroup) for m in dates]
    taken = [(m.start(), m.end()) for m in dates]
    words = list(_WORD.finditer(text)) if len(machine) else []
    if words:
        # words that are not a space apart, or that a date holds, are kept apart by a mark that no name has
        parts, index, at = [], {}, 0
        t = 0
        for k, m in enumerate(words):
            while t < len(taken) and taken[t][1] <= m.start():
                t += 1
            inside = t < len(taken) and taken[t][0] < m.end()
            if k and not (m.start() == words[k - 1].end() + 1 and text[m.start() - 1] == " "):
                parts.append("\x03")
                at += 1
            piece = "\x03" if inside else f"\x01{m[0]}\x02"
            parts.append(piece)
            at += len(piece)
            index[at - 1] = k
        for end, (n, label) in machine.iter_long("".join(parts)):
            last = index[end]
            a, b = words[last - n + 1].start(), words[last].end()
            out.append((a, text[a:b], label))
    return sorted(out)


def found_in_all(texts: pa.Array, machine, first: frozenset[str]) -> Iterator[tuple[int, list[tuple[int, str, str]]]]:  # noqa: ANN001
    """(place, found_in()) of the texts that may hold something; ``first`` are the first words of the names. Texts without one and without a start of a date are passed over."""

    def marked(parts: pa.Array) -> list[list[str]]:
        one, others = words_of(parts)
        others = [(parts[at].as_py(), found) for at, found in others]
        named = parts.filter(pc.is_in(one, value_set=pa.array(first, pa.string()))).to_pylist()
        timed = parts.filter(pc.fill_null(pc.match_substring_regex(one, _STARTS), False)).to_pylist()  # no digit is a letter
        return [named + [p for p, found in others if not first.isdisjoint(found)], [p for p in [*timed, *[p for p, _ in others]] if _START.search(p)]]

    named, timed = (frozenset(places.to_pylist()) for places in holding(texts, marked))
    none = automaton([])
    for k in sorted(named | timed):
        yield k, found_in(texts[k].as_py(), machine if k in named else none)


def mentions(docs: DataFrame, listed: list[Name]) -> DataFrame:
    """doc_id, pos, text, label of every text's mentions; pos counts them in order. Row by row; entities.grouped() and payload() take it."""
    shared = docs.sparkSession.sparkContext.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared.value)
        first = frozenset(n.text.split(" ")[0] for n in shared.value)
        for batch in batches:
            rows, before = [], 0
            for texts in pieces(batch.column(1)):
                rows += [(before + k, p, text, label) for k, found in found_in_all(texts, machine, first) for p, (_, text, label) in enumerate(found)]
                before += len(texts)
            columns = [pa.array([r[c] for r in rows], kind) for c, kind in ((1, pa.int64()), (2, pa.string()), (3, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), *columns], ["doc_id", "pos", "text", "label"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, pos long, text string, label string")


def fit(docs: DataFrame, most: int = MOST, least: int = LEAST) -> list[Name]:
    """The names of ``docs``: at most ``most``."""
    words = frozenset(r["word"] for r in chosen_words(name_words(docs), most, least).collect())
    return [Name(r["name"], r["label"]) for r in names(docs, words, most, least).collect()]


def mentions_of_corpus(docs: DataFrame) -> DataFrame:
    """As mentions(), by the names of the same texts."""
    return mentions(docs, fit(docs))
