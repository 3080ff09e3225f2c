"""Syntactic metrics over tagged tokens, and a rule-based tagger that stands in for a model.

Any tagger that gives array<struct<text, lower, lemma, tag, is_alpha, sent>> in a column
``doc`` can be used; modality(), pos_distribution() and verb_tense() read that column only.

The tagger here works over Arrow batches: what white space sets apart (an atom) is split, looked up and classified
once for each distinct atom that a worker meets; tags that depend on the words before are array operations over a batch's
tokens. measured() counts what the metrics need in the same pass, so that no token leaves the worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.functions import text as T

DOC_TYPE = "array<struct<text:string,lower:string,lemma:string,tag:string,is_alpha:boolean,sent:int>>"

# Modality markers by lemma, modality phrases, coarse part-of-speech buckets.
MODAL_MARKERS = {
    "obligation_modality": ("must", "should", "ought", "shall"),
    "possibility_modality": ("can", "could", "may", "might", "possibly", "perhaps", "maybe"),
    "certainty_modality": ("will", "definitely", "certainly", "surely", "undoubtedly", "clearly", "obviously", "always", "never"),
}
MODAL_PHRASES = {"obligation_modality": (("have", "to"), ("need", "to"), ("require", "to"))}
POS_BUCKETS = {
    "noun": ("NN", "NNS", "NNP", "NNPS"),
    "verb": ("VB", "VBD", "VBG", "VBN", "VBP", "VBZ"),
    "adjective": ("JJ", "JJR", "JJS"),
    "adverb": ("RB", "RBR", "RBS"),
    "pronoun": ("PRP", "PRP$"),
    "determiner": ("DT",),
    "preposition": ("IN",),
    "conjunction": ("CC",),
    "modal": ("MD",),
}

#: Words of one tag, contractions among them.
CLOSED = {
    "DT": "a an the this that these those each every no some any all both",
    "IN": "of in on at by for with from into through during before after above below about against between under over without within if because while as than since until",
    "CC": "and or but nor yet so",
    "MD": "can could may might must shall should will would ought 'll 'd wo ca sha",
    "PRP": "i you he she it we they me him us them myself yourself himself herself itself ourselves themselves",
    "PRP$": "my your his her its our their",
    "RB": "not never always now then here there very also just only perhaps maybe too again n't",
    "TO": "to",
    "WP": "who whom what",
    "WDT": "which",
    "WRB": "when where why how",
    "VBZ": "is has does",
    "VBP": "am are have do 're 've 'm",
    "VBD": "was were had did said made went took came",
    "VB": "be",
    "VBN": "been done gone taken",
    "VBG": "being having doing",
    "POS": "'s",
}
#: Forms and the lemma that modality goes by; any other form is its own.
LEMMAS = {
    "have": "has had having 've",
    "need": "needs needed needing",
    "require": "requires required requiring",
    "will": "'ll wo",
    "can": "ca",
    "shall": "sha",
}
#: Endings of words of over two letters more, in the order in which they are tried.
SUFFIXES = (("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("est", "JJS"), ("ous", "JJ"), ("ful", "JJ"), ("able", "JJ"), ("ible", "JJ"), ("ive", "JJ"), ("al", "JJ"), ("s", "NNS"))
PARTS = ("n't", "'re", "'ve", "'ll", "'d", "'s", "'m")
#: A word and the part that is cut off its end; the pieces of what holds no such part.
CONTRACTION = r"(?i)^(.*\p{L})(n['’]t|['’](?:re|ve|ll|d|s|m))([^\p{L}\p{N}]*)$"
PIECE = r"\p{L}+|[0-9][0-9.,]*|[^\s\p{L}\p{N}]"


#: Tokens that a worker remembers (beyond, it starts over), rows and atoms that are tagged together: they bound a worker's memory whatever the table holds.
REMEMBERED = 50_000
_ROWS, _ATOMS = 1000, 100_000
_CONTRACTION, _PIECE = regex.compile(CONTRACTION), regex.compile(PIECE.replace(r"\s", r" \t\n\x0b\f\r"))
_SOLID, _MARKS = regex.compile(r"[\p{L}\p{N}]"), frozenset(".,;:!?")
_OWN = {w: tag for tag, words in reversed(CLOSED.items()) for w in words.split()}
_LEMMA = {form: word for word, forms in reversed(LEMMAS.items()) for form in forms.split()}


def _lower(text: str) -> str:
    return text.replace("’", "'").lower()


def pieces_of(atom: str) -> list[str]:
    """The tokens of what white space sets apart: contractions are split in two, punctuation stands alone."""
    if atom.isalpha():
        return [atom]
    if atom[-1:] in _MARKS and atom[:-1].isalpha():
        return [atom[:-1], atom[-1]]
    out: list[str] = []
    for part in _CONTRACTION.sub(r"\1 \2 \3", atom).split(" "):
        out += [part] if _lower(part) in PARTS else _PIECE.findall(part)
    return out


def _own_tag(text: str, low: str) -> str | None:
    """The tag that a token has whatever stands before it; None for open words."""
    if not _SOLID.search(text) and low not in PARTS:
        return text if text in ",;:()" else "." if text in ".!?" else ":"
    return "CD" if "0" <= text[0] <= "9" else _OWN.get(low)


_BY_LAST: dict[str, list[tuple[str, str]]] = {}
for _end, _tag in SUFFIXES:
    _BY_LAST.setdefault(_end[-1], []).append((_end, _tag))


def _ending_tag(low: str) -> str:
    for end, tag in _BY_LAST.get(low[-1:], ()):
        if len(low) > len(end) + 2 and low.endswith(end):
            return tag
    return "NN"


class _Lexicon:
    """What is known of each distinct token and atom that this worker has met."""

    def __init__(self) -> None:
        self.tags: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.atoms: dict[str, tuple[int, ...]] = {}
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        self.low: list[str] = []
        self.lemma: list[str] = []
        self.own: list[int] = []  # -1 for open words
        self.first: list[int] = []  # an open word's tag where it begins a sentence, and elsewhere
        self.later: list[int] = []
        self.alpha: list[bool] = []

    def tag(self, name: str) -> int:
        return self.tags.setdefault(name, len(self.tags))

    def token(self, text: str) -> int:
        got = self.number.get(text)
        if got is None:
            got = self.number[text] = len(self.text)
            low, letters = _lower(text), text.isalpha()
            own, ending = _OWN.get(low) if letters else _own_tag(text, low), _ending_tag(low)
            self.text.append(text)
            self.low.append(low)
            self.lemma.append(_LEMMA.get(low, low))
            self.own.append(-1 if own is None else self.tag(own))
            self.first.append(self.tag(ending))
            self.later.append(self.tag("NNP" if text[0].isupper() and text[0].isalpha() else ending))
            self.alpha.append(letters)
        return got

    def of(self, atom: str) -> tuple[int, ...]:
        got = self.atoms.get(atom)
        if got is None:
            got = self.atoms[atom] = tuple(self.token(t) for t in pieces_of(atom))
        return got


class _Tokens(NamedTuple):
    """The tokens of a batch: the distinct ones by their numbers in the lexicon, and for each token which of them it is, its row, sentence (over the batch) and tag."""

    distinct: list[int]
    token: np.ndarray
    row: np.ndarray
    sentence: np.ndarray
    tag: np.ndarray

    def of(self, values: list, kind: type) -> np.ndarray:
        """A property of the lexicon's tokens, for each token."""
        return np.array([values[k] for k in self.distinct], kind)[self.token]


_LEXICON = _Lexicon()


def _tagged(column: pa.ListArray, known: _Lexicon) -> _Tokens:
    """Tokens of rows of sentences of atoms, tagged."""
    sentences = column.flatten()
    atoms = sentences.flatten().dictionary_encode()
    of = [known.of(a) for a in atoms.dictionary.to_pylist()]
    size = np.array([len(x) for x in of], np.int64)
    flat = np.array([x for y in of for x in y], np.int64)
    start = np.cumsum(size) - size
    code = atoms.indices.to_numpy()
    n = size[code]
    token = flat[np.repeat(start[code] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))] if len(code) else np.zeros(0, np.int64)
    atom_sentence = np.repeat(np.arange(len(sentences)), sentences.value_lengths().to_numpy())
    sentence = np.repeat(atom_sentence, n)
    row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())[sentence] if len(sentences) else np.zeros(0, np.int64)
    distinct, token = np.unique(token, return_inverse=True)
    t = _Tokens(distinct.tolist(), token, row, sentence, row)
    own = t.of(known.own, np.int64)
    before = np.full((2, len(token)), -1)
    for k in (1, 2):
        same = sentence[k:] == sentence[:-k]
        before[k - 1, k:][same] = own[:-k][same]
    modal, adverb = known.tag("MD"), known.tag("RB")
    after_modal = (before[0] == modal) | (before[0] == known.tag("TO")) | ((before[0] == adverb) & (before[1] == modal))
    begins = np.append(True, sentence[1:] != sentence[:-1])[: len(token)]
    guess = np.where(begins, t.of(known.first, np.int64), t.of(known.later, np.int64))
    return t._replace(tag=np.where(own >= 0, own, np.where(after_modal, known.tag("VB"), guess)))


def _atoms(docs: DataFrame, *keep: Column | str) -> DataFrame:
    """doc_id, the atoms of each sentence, and whatever else is kept."""
    atoms = F.transform(T.sentences("text"), lambda s: F.split(F.trim(s), r"\s+"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), atoms.alias("atoms"), *keep)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        sentences = np.append(0, np.cumsum(whole.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        atoms = np.append(0, np.cumsum(whole.column(1).flatten().value_lengths().to_numpy()))[sentences]  # before each row
        at = 0
        while at < whole.num_rows:
            stop = max(at + 1, min(at + _ROWS, int(np.searchsorted(atoms, atoms[at] + _ATOMS, side="right")) - 1))
            if len(_LEXICON.text) > REMEMBERED or len(_LEXICON.atoms) > REMEMBERED:
                _LEXICON.clear()
            yield whole.slice(at, stop - at)
            at = stop


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text, doc: every text tagged once (N1); a null text has no tokens.

    An open word behind a modal or "to", or behind a modal and an adverb, is a verb's base form. Row by row, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _LEXICON
        for batch in _batches(batches):
            t = _tagged(batch.column(1), known)
            names = list(known.tags)
            pick = pa.array(t.token)
            starts = np.searchsorted(t.row, np.arange(batch.num_rows + 1))
            first = np.cumsum(batch.column(1).value_lengths().to_numpy()) - batch.column(1).value_lengths().to_numpy()  # of the rows' sentences
            columns = [pa.array([x[k] for k in t.distinct], pa.string()).take(pick) for x in (known.text, known.low, known.lemma)]
            columns += [pa.array(names, pa.string()).take(pa.array(t.tag)), pa.array(t.of(known.alpha, bool)), pa.array((t.sentence - first[t.row]).astype(np.int32))]
            items = pa.StructArray.from_arrays(columns, ["text", "lower", "lemma", "tag", "is_alpha", "sent"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), items)], ["doc_id", "text", "doc"])

    return _atoms(docs, F.col("text").cast("string")).mapInArrow(run, f"doc_id long, text string, doc {DOC_TYPE}")


_COUNTS = ("tokens", "alpha", *MODAL_MARKERS, *POS_BUCKETS, "past", "present", "future", "non_finite")


def _counted(t: _Tokens, known: _Lexicon, rows: int) -> list[np.ndarray]:
    """The numbers of _COUNTS for each row."""
    per_row = lambda hit: np.bincount(t.row[hit], minlength=rows)
    among = lambda values, words: np.array([values[k] in words for k in t.distinct], bool)[t.token]
    tagged_as = lambda *names: np.isin(t.tag, [known.tag(x) for x in names])
    next_same = np.append(t.row[1:] == t.row[:-1], False)[: len(t.row)]
    out = [np.bincount(t.row, minlength=rows), per_row(t.of(known.alpha, bool))]
    for name, lemmas in MODAL_MARKERS.items():
        hits = per_row(among(known.lemma, lemmas))
        for first, second in MODAL_PHRASES.get(name, ()):
            follows = np.append(among(known.low, (second,))[1:], False)[: len(t.row)] & next_same
            hits = hits + per_row(among(known.lemma, (first,)) & follows)
        out.append(hits)
    out += [per_row(tagged_as(*tags)) for tags in POS_BUCKETS.values()]
    verb, mark = tagged_as(*POS_BUCKETS["verb"]), tagged_as(".", ",", "?", "!")
    open_, ahead = np.ones(len(t.row), bool), np.zeros(len(t.row), bool)
    for k in range(1, 5):  # a verb among the next four tokens, no mark before it
        inside = np.zeros(len(t.row), bool)
        inside[:-k] = t.row[k:] == t.row[:-k]
        shift = lambda flags, k=k, inside=inside: np.concatenate([flags[k:], np.zeros(min(k, len(flags)), bool)]) & inside
        ahead |= open_ & shift(verb)
        open_ &= ~shift(mark)
    will = tagged_as("MD") & among(known.low, ("will", "shall"))
    return [*out, per_row(tagged_as("VBD")), per_row(tagged_as("VBP", "VBZ")), per_row(will & ahead), per_row(tagged_as("VBG", "VBN", "VB"))]


def measured(docs: DataFrame, *keep: Column) -> DataFrame:
    """doc_id, what else is kept, and the counts that the metrics are made of, one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            counts = _counted(_tagged(batch.column(1), _LEXICON), _LEXICON, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], *(pa.array(c.astype(np.int64)) for c in counts)], ["doc_id", *batch.schema.names[2:], *(f"n_{c}" for c in _COUNTS)])

    rows = _atoms(docs, *keep)
    kept = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[2:])
    return rows.mapInArrow(run, "doc_id long, " + (kept + ", " if kept else "") + ", ".join(f"n_{c} long" for c in _COUNTS))


def modality_counts() -> list[Column]:
    """The columns of modality() over measured()."""
    return [F.when(F.col("n_alpha") > 0, F.round(F.col(f"n_{name}") * 1000 / F.col("n_alpha"), 2)).otherwise(F.lit(0.0)).alias(name) for name in MODAL_MARKERS]


def pos_counts() -> list[Column]:
    """The columns of pos_distribution() over measured(), but the last."""
    return [_percent(F.col(f"n_{name}"), F.col("n_tokens")).alias(name) for name in POS_BUCKETS]


def tense_counts() -> list[Column]:
    """The columns of verb_tense() over measured()."""
    return [_percent(F.col(f"n_{name}"), F.col("n_verb")).alias(name) for name in ("past", "present", "future", "non_finite")]


def _stats_columns() -> list[Column]:
    n = F.size(T.sentences("text"))
    t = T.tokens("text")
    return [
        n.cast("long").alias("sentence_count"),
        F.when(n > 0, F.round(F.size(t) / n, 2)).otherwise(F.lit(0.0)).alias("avg_sentence_length"),
        T.average_word_length(t).alias("avg_word_length"),
        T.count_of("text", "?").alias("question_count"),
        T.count_of("text", "!").alias("exclamation_count"),
    ]


def speech_stats(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_count, avg_sentence_length, avg_word_length, question_count, exclamation_count."""
    return docs.select("doc_id", *_stats_columns())


def _modality_columns() -> list[Column]:
    n = F.size(F.filter("doc", lambda t: t["is_alpha"]))
    out = []
    for name, lemmas in MODAL_MARKERS.items():
        hits = F.size(F.expr(f"filter(doc, t -> t.lemma in ({', '.join(repr(x) for x in lemmas)}))"))
        for first, second in MODAL_PHRASES.get(name, ()):
            phrase = F.expr(f"filter(doc, (t, k) -> t.lemma = '{first}' and coalesce(get(doc, k + 1).lower = '{second}', false))")
            hits = hits + F.size(phrase)
        out.append(F.when(n > 0, F.round(hits * 1000 / n, 2)).otherwise(F.lit(0.0)).alias(name))
    return out


def modality(rows: DataFrame) -> DataFrame:
    """doc_id and markers per 1000 alphabetic tokens in three categories, by lemma, plus phrases."""
    return rows.select("doc_id", *_modality_columns())


def _count(*tags: str) -> Column:
    return F.size(F.filter("doc", lambda t: t["tag"].isin(*tags)))


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part * 100 / whole, 2)).otherwise(F.lit(0.0))


def _pos_columns() -> list[Column]:
    return [_percent(_count(*tags), F.size("doc")).alias(name) for name, tags in POS_BUCKETS.items()]


def pos_distribution(rows: DataFrame) -> DataFrame:
    """doc_id, the percentage of all tokens in each coarse bucket (two decimals), total_tagged_tokens."""
    return rows.select("doc_id", *_pos_columns(), F.size("doc").cast("long").alias("total_tagged_tokens"))


def _tense_columns() -> list[Column]:
    verbs = _count(*POS_BUCKETS["verb"])
    future = F.size(
        F.expr(
            """filter(doc, (t, k) -> t.tag = 'MD' and t.lower in ('will', 'shall')
            and array_join(transform(slice(doc, k + 2, 4), x -> case when x.tag like 'VB%' then 'v' when x.tag in ('.', ',', '?', '!') then 'x' else '-' end), '') rlike '^-*v')"""
        )
    )
    return [
        _percent(_count("VBD"), verbs).alias("past"),
        _percent(_count("VBP", "VBZ"), verbs).alias("present"),
        _percent(future, verbs).alias("future"),
        _percent(_count("VBG", "VBN", "VB"), verbs).alias("non_finite"),
    ]


def verb_tense(rows: DataFrame) -> DataFrame:
    """doc_id, past, present, future, non_finite as percentages of verb tokens.

    Future counts will/shall with a verb among the next four tokens and no comma or
    sentence mark before it; the shares need not come to 100.
    """
    return rows.select("doc_id", *_tense_columns())


def payload(docs: DataFrame) -> DataFrame:
    """doc_id, syntactic_metrics: the syntactic payload as one struct (N15), from one pass over the texts."""

    def as_map(names, columns: list[Column]) -> Column:  # noqa: ANN001
        return F.create_map(*[x for name, c in zip(names, columns, strict=True) for x in (F.lit(name), c)])

    fields = [
        "speech_stats",
        as_map(MODAL_MARKERS, modality_counts()).alias("modality"),
        as_map(POS_BUCKETS, pos_counts()).alias("pos_distribution"),
        as_map(("past", "present", "future", "non_finite"), tense_counts()).alias("verb_tense"),
    ]
    return measured(docs, F.struct(*_stats_columns()).alias("speech_stats")).select("doc_id", F.struct(*fields, F.col("n_tokens").alias("total_tagged_tokens")).alias("syntactic_metrics"))
