"""Fast whole-text encoding with the tokenizers library, one distinct segment at a time.

A text is cut where no token of its pre-tokenizer can reach across, so that the ids
of a text are the ids of its segments in a row. numpy finds and hashes the segments
of a batch in its byte buffer; only segments that this worker has not met are
given to the library, and the ids of all are gathered by array indexing. A text that
holds white space beyond ASCII (or the separators 0x1C to 0x1F), or the content of an
added token such as <|endoftext|>, goes to the library as a whole, as does a segment of
more than LONG bytes.

Segments are told apart by two independent 64-bit hashes; if one of them ever
disagrees with the other, that chunk of texts is encoded without the cache.
"""

from __future__ import annotations

import os

import numpy as np

from corpuslake.llm import _buffers as B

LONG = 64
#: Segments that a worker remembers (about 40 bytes each); beyond, it starts over.
REMEMBERED = 2_500_000
_RECENT = 150_000
_BASE2 = 0xC2B2AE3D27D4EB4F

_PUNCT = np.zeros(256, bool)
_PUNCT[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_CONTROL = np.zeros(256, bool)
_CONTROL[0x1C:0x20] = True


def byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256 and up, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = {}, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


def odd_space(data: np.ndarray) -> np.ndarray:
    """Positions of white space beyond ASCII, and of the ASCII separators, in UTF-8 bytes."""
    control = np.flatnonzero(_CONTROL[data])
    lead = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
    if not len(lead):
        return control
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b, c = padded[lead], padded[lead + 1], padded[lead + 2]
    hit = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    hit |= (a == 0xE1) & (b == 0x9A) & (c == 0x80)
    hit |= (a == 0xE2) & (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
    hit |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
    hit |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    return np.concatenate([control, lead[hit]])


def rows_with(data: np.ndarray, offsets: np.ndarray, contents: list[bytes]) -> np.ndarray:
    """Rows whose text holds one of ``contents``, in order."""
    raw, out = data.tobytes(), set()
    for content in contents:
        at = raw.find(content)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, side="right")) - 1
            if at + len(content) <= offsets[row + 1]:
                out.add(row)
                at = raw.find(content, int(offsets[row + 1]))
            else:  # across two texts
                at = raw.find(content, at + 1)
    return np.array(sorted(out), np.int64)


class SegmentEncoder:
    """Encodes texts as ``tokenizer`` (a tokenizers.Tokenizer) does with add_special_tokens=False.

    Added tokens' contents in a text are read as those tokens, as the library does;
    they have to be matched before normalisation (``normalized`` is false).

    ``spaced``: the pre-tokenizer is byte-level BPE's, whose tokens may begin with one
    space. Otherwise it drops white space and lower-cases after NFC.
    """

    def __init__(self, tokenizer, spaced: bool):  # noqa: ANN001
        self.tokenizer, self.spaced = tokenizer, spaced
        self.model = tokenizer.model
        added = tokenizer.get_added_tokens_decoder().values()
        if any(t.normalized for t in added):
            raise ValueError("added tokens that are matched after normalisation are not supported")
        self._added = [t.content.encode() for t in added]
        self._table = {b: c for b, c in byte_characters().items()}
        self._clear()

    def _clear(self) -> None:
        self._ids = np.zeros(1 << 16, np.uint32)
        self._used = 0
        none = np.zeros(0, np.uint64)
        self._levels = [(none, none, np.zeros(0, np.int64), np.zeros(0, np.int32)) for _ in range(2)]

    # -- the library ------------------------------------------------------
    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_segments(self, segments: list[bytes]) -> list[list[int]]:
        """Ids of segments; one run of Latin letters needs the merges only."""
        out: list[list[int] | None] = []
        rest, at = [], []
        table, tokenize = self._table, self.model.tokenize
        for k, s in enumerate(segments):
            t = s.decode("utf-8", "replace")
            body = t[1:] if self.spaced and t[:1] == " " else t
            if body.isalpha() and max(body) <= "ÿ":
                word = s if self.spaced else t.lower().encode()
                out.append([x.id for x in tokenize(word.decode("latin-1").translate(table))])
            else:
                out.append(None)
                rest.append(t)
                at.append(k)
        for k, ids in zip(at, self._whole(rest) if rest else [], strict=True):
            out[k] = ids
        return out

    # -- cutting ----------------------------------------------------------
    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        space = B.ASCII_SPACE[data]
        first = offsets[:-1][offsets[:-1] < n]
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = space[:-1]
        before[first] = False
        cut = space & ~before
        cut[1:] |= _ASCII_LETTER[data[:-1]] & _PUNCT[data[1:]]
        if self.spaced:
            # after a lone white-space byte other than a space, before anything else
            lone = space & ~before & (data != 32)
            cut[1:] |= lone[:-1] & ~space[1:]
        else:
            cut |= before & ~space
        cut[first] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        if not self.spaced:
            solid = ~space[starts]
            starts, ends = starts[solid], ends[solid]
        return starts, ends

    # -- lookup -----------------------------------------------------------
    def _find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, start, length) in the id store for each key."""
        known = np.zeros(len(key), bool)
        start, length = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        for keys, checks, starts, lengths in self._levels:
            if len(keys):
                at = np.searchsorted(keys, key)
                at[at == len(keys)] = 0
                hit = (keys[at] == key) & (checks[at] == check)
                start[hit], length[hit] = starts[at[hit]], lengths[at[hit]]
                known |= hit
        return known, start, length

    def _remember(self, key: np.ndarray, check: np.ndarray, ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        total = int(length.sum())
        if self._used + total > len(self._ids):
            grown = np.zeros(max(2 * len(self._ids), self._used + total), np.uint32)
            grown[: self._used] = self._ids[: self._used]
            self._ids = grown
        self._ids[self._used : self._used + total] = np.fromiter((x for y in ids for x in y), np.uint32, total)
        start = self._used + np.cumsum(length) - length
        self._used += total
        old, recent = self._levels
        recent = self._merge(recent, (key, check, start, length.astype(np.int32)))
        if len(recent[0]) > _RECENT:
            old, recent = self._merge(old, recent), tuple(x[:0] for x in recent)
        self._levels = [old, recent]
        return start, length

    @staticmethod
    def _merge(a: tuple, b: tuple) -> tuple:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))

    # -- encoding ---------------------------------------------------------
    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids per text) for UTF-8 texts in one buffer."""
        ids, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i, j in B.chunks(offsets):
            a, b = self._chunk(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ids.append(a)
            counts.append(b)
        return np.concatenate(ids), np.concatenate(counts)

    def _direct(self, data: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> list[list[int]]:
        return self._whole([data[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace") for r in rows])

    def _chunk(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        if sum(len(x[0]) for x in self._levels) > REMEMBERED or self._used > 12 * REMEMBERED:
            self._clear()
        odd = odd_space(data)
        whole = np.unique(np.searchsorted(offsets, odd, side="right") - 1) if len(odd) else np.zeros(0, np.int64)
        whole = np.union1d(whole, rows_with(data, offsets, self._added))
        starts, ends = self._cut(data, offsets)
        row = np.searchsorted(offsets, starts, side="right") - 1
        if len(whole):
            keep = ~np.isin(row, whole)
            starts, ends, row = starts[keep], ends[keep], row[keep]
        seg_start, seg_len = self._segment_ids(data, starts, ends)
        if seg_start is None:
            got = self._direct(data, offsets, np.arange(n))
            return np.fromiter((x for y in got for x in y), np.uint32), np.fromiter(map(len, got), np.int64, n)
        if len(whole):
            got = self._direct(data, offsets, whole)
            s, c = self._loose(got)
            row = np.concatenate([row, whole])
            seg_start, seg_len = np.concatenate([seg_start, s]), np.concatenate([seg_len, c])
            order = np.argsort(row, kind="stable")
            row, seg_start, seg_len = row[order], seg_start[order], seg_len[order]
        total = int(seg_len.sum())
        base = np.repeat(seg_start - (np.cumsum(seg_len) - seg_len), seg_len)
        return self._ids[base + np.arange(total)], np.bincount(row, weights=seg_len, minlength=n).astype(np.int64)

    def _loose(self, got: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Stores ids that are not looked up again."""
        none = np.zeros(0, np.uint64)
        length = np.fromiter(map(len, got), np.int64, len(got))
        at = self._used
        self._remember(none, none, [])
        total = int(length.sum())
        if at + total > len(self._ids):
            self._ids = np.concatenate([self._ids[:at], np.zeros(max(at, total), np.uint32)])
        self._ids[at : at + total] = np.fromiter((x for y in got for x in y), np.uint32, total)
        self._used = at + total
        return at + np.cumsum(length) - length, length

    def _segment_ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):  # noqa: ANN202
        m = len(starts)
        seg_start, seg_len = np.zeros(m, np.int64), np.zeros(m, np.int64)
        if not m:
            return seg_start, seg_len
        short = (ends - starts) <= LONG
        at = np.flatnonzero(short)
        if len(at):
            s, e = starts[at], ends[at]
            key, check = B.spans_hash(data, s, e), B.spans_hash(data, s, e, _BASE2)
            uniq, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            if (check[first][inverse] != check).any():
                return None, None
            known, us, ul = self._find(uniq, check[first])
            new = np.flatnonzero(~known)
            if len(new):
                raw = data.tobytes()
                got = self._encode_segments([raw[s[k] : e[k]] for k in first[new]])
                us[new], ul[new] = self._remember(uniq[new], check[first[new]], got)
            seg_start[at], seg_len[at] = us[inverse], ul[inverse]
        long = np.flatnonzero(~short)
        if len(long):
            seg_start[long], seg_len[long] = self._loose(self._encode_segments([data[starts[k] : ends[k]].tobytes() for k in long]))
        return seg_start, seg_len


_ENCODERS: dict[tuple[str, bool], SegmentEncoder] = {}


def quiet_library() -> None:
    """One thread a worker: Spark's tasks are the parallelism."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


def encoder(path: str, spaced: bool) -> SegmentEncoder:
    """This worker's encoder for a tokenizer file, loaded once."""
    got = _ENCODERS.get((path, spaced))
    if got is None:
        quiet_library()
        from tokenizers import Tokenizer

        got = _ENCODERS[path, spaced] = SegmentEncoder(Tokenizer.from_file(path), spaced)
    return got
