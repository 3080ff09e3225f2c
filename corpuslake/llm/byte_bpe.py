"""Byte-level BPE with the tokenizers library, from a file of ranks.

The library's model takes pairs in an order of merges; the ranks give that order: any
two tokens that make a third may merge, at the third's rank. Bytes are mapped to the
byte-level alphabet on the way in and back on the way out. Offsets count characters:
a token that holds only part of a character's bytes spans that character, so the
tokens that split a character all cover it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslake.llm import _buffers as B
from corpuslake.llm._rows import without
from corpuslake.llm.segments import SegmentEncoder, byte_characters, quiet_library


def read_ranks(path: str) -> dict[bytes, int]:
    """token bytes -> rank of a rank file (base64 and rank a line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def rank_tokenizer(ranks: dict[bytes, int], pattern: str):  # noqa: ANN201
    """A tokenizers.Tokenizer that splits by ``pattern`` and merges by ``ranks``, without special tokens."""
    quiet_library()
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    table = byte_characters()
    names = {t: t.decode("latin-1").translate(table) for t in ranks}
    merges = [(names[t[:k]], names[t[k:]]) for t in sorted(ranks, key=ranks.get) for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    out = Tokenizer(models.BPE(vocab={names[t]: r for t, r in ranks.items()}, merges=merges))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


class ByteTable:
    """Bytes of each id, for decoding by array indexing."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.length = np.zeros(size, np.int64)
        for t, r in ranks.items():
            self.length[r] = len(t)
        self.start = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(sorted(ranks, key=ranks.get)), np.uint8)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids`` in a row; an id outside the table is an error."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.length)):
            raise ValueError("an id is not in the vocabulary")
        n = self.length[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(n) - n), n)
        return self.data[at + np.arange(len(at))]


def character_offsets(text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) in characters of tokens of ``lengths`` bytes that make up the UTF-8 bytes ``text``."""
    number = np.cumsum((text & 0xC0) != 0x80)  # 1-based number of the character that each byte belongs to
    end = np.cumsum(lengths)
    return number[end - lengths] - 1, number[end - 1]


_TOKENIZERS: dict[tuple[str, str], SegmentEncoder] = {}
_TABLES: dict[str, ByteTable] = {}


def _tokenizer(path: str, pattern: str) -> SegmentEncoder:
    if (path, pattern) not in _TOKENIZERS:
        _TOKENIZERS[path, pattern] = SegmentEncoder(rank_tokenizer(read_ranks(path), pattern), spaced=True)
    return _TOKENIZERS[path, pattern]


def _table(path: str) -> ByteTable:
    if path not in _TABLES:
        _TABLES[path] = ByteTable(read_ranks(path))
    return _TABLES[path]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches whose lists have offsets of 32 bits already."""
    for whole in batches:
        for at in range(0, whole.num_rows, B.SLICE_ROWS):
            yield whole.slice(at, B.SLICE_ROWS)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, pattern: str, offsets: bool) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) batches to (doc_id, ids[, starts, ends])."""
    tokenizer = _tokenizer(path, pattern)
    for batch in B.row_slices(batches, 1):
        data, offs = B.text_buffer(batch.column(1))
        ids, counts = tokenizer.encode(data, offs)
        out, names = [batch.column(0), _lists(ids, counts)], ["doc_id", "ids"]
        if offsets:
            length, ends = _table(path).length, np.cumsum(counts)
            spans = [character_offsets(data[offs[r] : offs[r + 1]], length[ids[ends[r] - counts[r] : ends[r]]]) for r in range(len(counts))]
            none = np.zeros(0, np.int64)
            out += [_lists(np.concatenate([none, *(s[k] for s in spans)]), counts) for k in (0, 1)]
            names += ["starts", "ends"]
        yield pa.RecordBatch.from_arrays(out, names)


def _decoded(batches: Iterator[pa.RecordBatch], path: str, ids_col: str) -> Iterator[pa.RecordBatch]:
    """Batches with an ids column, with the column decoded added."""
    table = _table(path)
    for batch in _slices(batches):
        column = batch.column(batch.schema.get_field_index(ids_col))
        ids = column.flatten().to_numpy(zero_copy_only=False)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        counts = np.zeros(len(column), np.int64)
        counts[valid] = column.value_lengths().drop_null().to_numpy()
        ends = np.concatenate([[0], np.cumsum(table.length[ids])])[np.concatenate([[0], np.cumsum(counts)])]
        texts = pa.Array.from_buffers(pa.large_binary(), len(column), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(table.decode(ids).tobytes())]).cast(pa.binary())
        if not valid.all():
            texts = pc.if_else(pa.array(valid), texts, pa.scalar(None, pa.binary()))
        yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, *, offsets: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (with ``offsets`` also starts, ends in characters) of every whole text; null counts as empty.

    ``pattern`` is the byte-level pattern whose tokens begin with at most one space. Each row is encoded
    for itself, whether its id is null or repeated; other columns are ignored; an empty table gives no rows. Texts of
    any length are encoded whole.
    """
    schema = "doc_id long, ids array<int>" + ", starts array<int>, ends array<int>" * offsets
    return _texts(docs, id_col, text_col).mapInArrow(lambda b: _encoded(b, ranks_path, pattern, offsets), schema)


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the bytes of their ids (null ids: null).

    Characters that tokens split come out whole, since bytes are joined before anything
    reads them as UTF-8. A column of ``rows`` called decoded gives way to the result.
    """
    rows = rows.select(*[F.col(f"`{c}`") for c in without(rows.columns, "decoded")])
    return rows.mapInArrow(lambda b: _decoded(b, ranks_path, ids_col), ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes), "decoded binary"]))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, decoded: encode() and decode() in one Python worker, so that a task holds one of them."""
    return _texts(docs, id_col, text_col).mapInArrow(lambda b: _decoded(_encoded(b, ranks_path, pattern, False), ranks_path, "ids"), "doc_id long, ids array<int>, decoded binary")
