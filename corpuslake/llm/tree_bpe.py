"""BPE by tree concatenation, as the tokenizers library encodes, and decoding back.

What the pre-tokenizer leaves unsplit (a pre-token) and is longer than LEAF bytes is cut into leaves; each leaf is
encoded by itself, and neighbours are joined pairwise, level by level, up to the root. A
join encodes the bytes of the last tokens of the left half and the first tokens of the
right half again, and takes twice as many until both ends of the window agree: its first
token is the left half's at that place, its last the right half's. That is exact. A
sequence is the BPE encoding of its bytes if and only if each two neighbours in it are
the encoding of their own bytes: the first merge that would cross a border depends on the two tokens
beside it only. After an agreement every two neighbours stood beside each other in one of three encodings.

Texts of up to PART characters are encoded in the task that reads them. A longer text is cut into
parts that other tasks encode in parallel: at ends of words where there are any, else by
its pre-tokens, and a pre-token longer than a part by leaves of that size, which are joined by
the same tree where the ids of the text meet again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm import _buffers as B
from corpuslake.llm._rows import without
from corpuslake.llm.byte_bpe import ByteTable, _lists, _slices, _texts
from corpuslake.llm.segments import SegmentEncoder, byte_characters, quiet_library

#: Bytes of a leaf, and tokens on either side of a join that are encoded again at first.
LEAF, WINDOW = 16, 2
#: Characters of a text, and bytes of its parts, beyond which it is dealt to several tasks.
PART = 1 << 16
#: Kinds of parts: plain text, whole pre-tokens (spaces between), the first and the further leaves of one pre-token.
PLAIN, PRETOKENS, FIRST_LEAF, NEXT_LEAF = range(4)
_WORDS_REMEMBERED = 200_000

Encode = Callable[[str], list[int]]


def joined(left: list[int], right: list[int], spell: Callable[[list[int]], str], encode: Encode) -> list[int]:
    """The encoding of two halves of one pre-token, from the encodings of both."""
    w = WINDOW
    while True:
        a, b = left[-w:], right[:w]
        window = encode(spell(a) + spell(b))
        if (w >= len(left) or window[0] == a[0]) and (w >= len(right) or window[-1] == b[-1]):
            return [*left[: max(0, len(left) - w)], *window, *right[w:]]
        w *= 2


def concatenated(parts: list[list[int]], spell: Callable[[list[int]], str], encode: Encode) -> list[int]:
    """The encoding of a pre-token from those of its consecutive leaves, joined as a binary tree."""
    while len(parts) > 1:
        pairs = [joined(parts[k], parts[k + 1], spell, encode) for k in range(0, len(parts) - 1, 2)]
        parts = pairs + parts[len(pairs) * 2 :]
    return parts[0] if parts else []


class TreeEncoder(SegmentEncoder):
    """Encodes texts as a byte-level tokenizer with add_special_tokens=False does, long pre-tokens by trees.

    Added tokens' contents in a text are read as those tokens. ``joins`` counts the joins made so far.
    """

    def __init__(self, tokenizer, leaf: int = LEAF):  # noqa: ANN001
        super().__init__(tokenizer, spaced=True)
        self.leaf, self.joins = leaf, 0
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        self._spelling = [""] * (max(vocabulary.values(), default=-1) + 1)
        for t, i in vocabulary.items():
            self._spelling[i] = t
        self._special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self._words: dict[str, list[int]] = {}

    def spell(self, ids: list[int]) -> str:
        """The byte-level characters of ``ids``."""
        return "".join([self._spelling[i] for i in ids])

    def _short(self, spelled: str) -> list[int]:
        return [x.id for x in self.model.tokenize(spelled)]

    def pretoken(self, spelled: str) -> list[int]:
        """Ids of one pre-token in byte-level characters."""
        if len(spelled) <= self.leaf:
            return self._short(spelled)
        leaves = [self._short(spelled[at : at + self.leaf]) for at in range(0, len(spelled), self.leaf)]
        self.joins += len(leaves) - 1
        return concatenated(leaves, self.spell, self._short)

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens of a text without added tokens, in byte-level characters."""
        return [t for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def remembered(self, spelled: str) -> list[int]:
        got = self._words.get(spelled)
        if got is None:
            got = self.pretoken(spelled)
            if len(spelled) <= 64:
                if len(self._words) >= _WORDS_REMEMBERED:
                    self._words.clear()
                self._words[spelled] = got
        return got

    def pieces(self, text: str) -> list[tuple[str, int | None]]:
        """``text`` cut at the contents of added tokens, leftmost first: (stretch, the id of the token that it is)."""
        out, at = [], 0
        while True:
            found = min(((k, -len(s), s) for s in self._special if (k := text.find(s, at)) >= 0), default=None)
            end = found[0] if found else len(text)
            if end > at:
                out.append((text[at:end], None))
            if not found:
                return out
            out.append((found[2], self._special[found[2]]))
            at = end + len(found[2])

    def _whole(self, texts: list[str]) -> list[list[int]]:
        out = []
        for text in texts:
            ids: list[int] = []
            for stretch, special in self.pieces(text):
                if special is not None:
                    ids.append(special)
                else:
                    for t in self.pretokens(stretch):
                        ids.extend(self.remembered(t))
            out.append(ids)
        return out

    def _encode_segments(self, segments: list[bytes]) -> list[list[int]]:
        table, out = self._table, []
        for s in segments:
            t = s.decode("utf-8", "replace")
            body = t[1:] if t[:1] == " " else t
            if body.isalpha() and max(body) <= "ÿ":  # one pre-token
                out.append(self.pretoken(s.decode("latin-1").translate(table)))
            else:
                out.append(self._whole([t])[0])
        return out


def token_bytes(tokenizer) -> dict[bytes, int]:  # noqa: ANN001
    """The bytes that each id stands for: the byte table reversed; an added token stands for its content."""
    back = {ord(c): b for b, c in byte_characters().items()}
    out = {t.translate(back).encode("latin-1"): i for t, i in tokenizer.get_vocab(with_added_tokens=False).items()}
    return out | {t.content.encode(): i for i, t in tokenizer.get_added_tokens_decoder().items()}


_ENCODERS: dict[tuple[str, int], TreeEncoder] = {}
_TABLES: dict[str, ByteTable] = {}


def encoder(path: str, leaf: int = LEAF) -> TreeEncoder:
    """This worker's encoder for a tokenizer file, loaded once; the file's truncation and padding are not used."""
    if (path, leaf) not in _ENCODERS:
        quiet_library()
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _ENCODERS[path, leaf] = TreeEncoder(tokenizer, leaf)
    return _ENCODERS[path, leaf]


def _table(path: str) -> ByteTable:
    if path not in _TABLES:
        _TABLES[path] = ByteTable(token_bytes(encoder(path).tokenizer))
    return _TABLES[path]


# -- long texts in parts --------------------------------------------------
def _word_ends(data: np.ndarray) -> np.ndarray:
    """Places where an ASCII letter stands before ASCII white space: no pre-token reaches across."""
    space = B.ASCII_SPACE[data]
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    return np.flatnonzero(letter[:-1] & space[1:]) + 1


def parts_of(text: str, enc: TreeEncoder, most: int = PART) -> Iterator[tuple[int, str]]:
    """(kind, content) of consecutive parts of about ``most`` bytes; their encodings in a row are the text's."""
    for stretch, special in enc.pieces(text):
        if special is not None:
            yield PLAIN, stretch
            continue
        raw = stretch.encode()
        data = np.frombuffer(raw, np.uint8)
        ends = _word_ends(data)
        at = 0
        while at < len(raw):
            k = int(np.searchsorted(ends, at + most, side="right"))
            if len(raw) - at <= most:
                end = len(raw)
            elif k and ends[k - 1] > at:
                end = int(ends[k - 1])
            else:
                end = int(ends[k]) if k < len(ends) else len(raw)
            content = raw[at:end].decode()
            at = end
            if end and len(content.encode()) <= most:
                yield PLAIN, content
                continue
            held: list[str] = []
            size = 0
            for t in enc.pretokens(content):
                if held and size + len(t) > most:
                    yield PRETOKENS, " ".join(held)
                    held, size = [], 0
                if len(t) <= most:
                    held.append(t)
                    size += len(t)
                else:
                    for b in range(0, len(t), most):
                        yield (NEXT_LEAF if b else FIRST_LEAF), t[b : b + most]
            if held:
                yield PRETOKENS, " ".join(held)


def part_ids(kind: int, content: str, enc: TreeEncoder) -> list[int]:
    """Ids of one part."""
    if kind == PLAIN:
        return enc._whole([content])[0]
    if kind == PRETOKENS:
        return [i for t in content.split(" ") for i in enc.remembered(t)]
    return enc.pretoken(content)


def whole_ids(kinds: list[int], ids: list[list[int]], enc: TreeEncoder) -> list[int]:
    """The ids of a text from those of its parts in order; the leaves of one pre-token are joined by a tree."""
    out: list[int] = []
    leaves: list[list[int]] = []
    for kind, part in zip([*kinds, PLAIN], [*ids, []], strict=True):
        if leaves and kind != NEXT_LEAF:
            out.extend(concatenated(leaves, enc.spell, enc._short))
            leaves = []
        if kind in (FIRST_LEAF, NEXT_LEAF):
            leaves.append(part)
        else:
            out.extend(part)
    return out


_PARTS = "row long, doc_id long, part int, kind int, content string"


def _cut(batches: Iterator[pa.RecordBatch], path: str, leaf: int, part: int) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text) batches to a row for each part, a text at a time."""
    enc = encoder(path, leaf)
    for batch in batches:
        for row, doc_id, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            parts = list(parts_of(text.as_py(), enc, part))
            n = len(parts)
            arrays = [pa.array([row.as_py()] * n, pa.int64()), pa.array([doc_id.as_py()] * n, pa.int64()), pa.array(range(n), pa.int32())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.string())], ["row", "doc_id", "part", "kind", "content"])


def _encoded_parts(batches: Iterator[pa.RecordBatch], path: str, leaf: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path, leaf)
    for batch in batches:
        for k in range(batch.num_rows):
            kind, content = batch.column(3)[k].as_py(), batch.column(4)[k].as_py()
            if kind == PLAIN:  # by the segments that this worker knows already
                data = np.frombuffer(content.encode(), np.uint8)
                ids = enc.encode(data, np.array([0, len(data)]))[0]
            else:
                ids = np.array(part_ids(kind, content, enc), np.uint32)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(k, 1) for c in range(4)), _lists(ids, np.array([len(ids)]))], ["row", "doc_id", "part", "kind", "ids"])


def _met(batches: Iterator[pa.RecordBatch], path: str, leaf: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, parts) batches to (doc_id, ids)."""
    enc = encoder(path, leaf)
    for batch in batches:
        for k in range(batch.num_rows):
            parts = batch.column(1).slice(k, 1).flatten()
            kinds, ids = parts.field("kind").to_pylist(), parts.field("ids")
            if set(kinds) <= {PLAIN, PRETOKENS}:
                whole = ids.flatten().to_numpy(zero_copy_only=False)
            else:
                whole = np.array(whole_ids(kinds, ids.to_pylist(), enc), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), _lists(whole, np.array([len(whole)]))], ["doc_id", "ids"])


def _encoded(batches: Iterator[pa.RecordBatch], path: str, leaf: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(path, leaf)
    for batch in B.row_slices(batches, 1):
        yield pa.RecordBatch.from_arrays([batch.column(0), _lists(*enc.encode(*B.text_buffer(batch.column(1))))], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str, ids_col: str) -> Iterator[pa.RecordBatch]:
    """Batches with an ids column, with the column decoded added."""
    table = _table(path)
    for batch in _slices(batches):
        texts = []
        for ids in batch.column(batch.schema.get_field_index(ids_col)):
            if not ids.is_valid:
                texts.append(None)
                continue
            known = ids.values.drop_null().to_numpy()
            known = known[(known >= 0) & (known < len(table.length))]
            texts.append(table.decode(known).tobytes().decode("utf-8", "replace"))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def _rows(docs: DataFrame, path: str, id_col: str, text_col: str, leaf: int, part: int, decoded: bool) -> DataFrame:
    schema = "doc_id long, ids array<int>" + ", decoded string" * decoded
    last = (lambda b: _decoded(b, path, "ids")) if decoded else (lambda b: b)  # in the worker that has the ids
    rows = _texts(docs, id_col, text_col)
    near = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= part).mapInArrow(lambda b: last(_encoded(b, path, leaf)), schema)
    long = rows.where(F.length("text") > part).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    parts = long.mapInArrow(lambda b: _cut(b, path, leaf, part), _PARTS).repartition("row", "part")
    parts = parts.mapInArrow(lambda b: _encoded_parts(b, path, leaf), "row long, doc_id long, part int, kind int, ids array<int>")
    met = parts.groupBy("row", "doc_id").agg(F.sort_array(F.collect_list(F.struct("part", "kind", "ids"))).alias("parts")).select("doc_id", "parts")
    return near.unionByName(met.mapInArrow(lambda b: last(_met(b, path, leaf)), schema))


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, part: int = PART) -> DataFrame:
    """doc_id and ids of every whole text, as ``path``'s byte-level tokenizer gives them; null counts as empty.

    Each row is encoded for itself, whether its id is null or repeated; other columns are ignored; an empty table gives
    no rows. Texts of more than ``part`` characters are shuffled as parts of that size; rows are numbered
    as they are read for that, so an input whose order is not stable should be cut first.
    """
    return _rows(docs, path, id_col, text_col, leaf, part, False)


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of their ids with special tokens (null ids: null), as the library's decode() gives it.

    Bytes are put in a row before they are read as UTF-8, so characters that tokens split come out whole; what is no
    UTF-8 becomes U+FFFD, ids outside the vocabulary become nothing. A column of ``rows`` called decoded gives way.
    """
    rows = rows.select(*[F.col(f"`{c}`") for c in without(rows.columns, "decoded")])
    return rows.mapInArrow(lambda b: _decoded(b, path, ids_col), ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "decoded string"]))


def round_trip(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, part: int = PART) -> DataFrame:
    """doc_id, ids, decoded: encode() and decode() in one Python worker, so that a task holds one of them."""
    return _rows(docs, path, id_col, text_col, leaf, part, True)
