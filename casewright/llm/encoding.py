"""Token ids of many texts with a byte-level BPE tokenizer.

The tokenizer cuts a text before every blank that follows a non-blank, and what stands
between two such cuts gets the same ids wherever it stands. So a batch is cut at those
blanks, each distinct piece is encoded once, and the ids of the texts are gathered. It also
cuts between a letter and a mark, so a piece that ends with a letter and one mark is that of
the letters and that of the mark.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHED_PIECES = 150_000    # distinct pieces a worker remembers, about 40 MB
SLICE_BYTES = 1 << 20      # text worked on at a time; a worker needs about forty times as much
JOINED_CHARS = 20_000      # distinct pieces are handed to the tokenizer in texts of this length
GATHERED = 20_000          # pieces whose ids are gathered at a time
HELD_CHARS = 40_000        # characters, and
HELD_TEXTS = 256           # texts, whose encodings are held at a time

# Letters in every version of Unicode; others are left with their marks.
_LETTERS = frozenset(c for c in map(chr, range(256)) if c.isalpha() and c not in "\xaa\xba\xb5")
_MARKS = ".,;:!?"

_AFTER_SPACE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes lists of texts; one per Python worker."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        # A token is spelt with one character for each byte.
        size = self.tokenizer.get_vocab_size()
        self.token_bytes = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self.known: dict[str, bytes] = {}
        self.marks = dict(zip(_MARKS, self._each(list(_MARKS))))

    def _each(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; an encoding takes a hundred times its ids, so few are held at a time."""
        found, start = [], 0
        while start < len(texts):
            stop, chars = start, 0
            while stop < len(texts) and chars < HELD_CHARS and stop - start < HELD_TEXTS:
                chars += len(texts[stop])
                stop += 1
            encoded = self.tokenizer.encode_batch_fast(texts[start:stop], add_special_tokens=False)
            found += [np.array(e.ids, "<u4").tobytes() for e in encoded]
            start = stop
        return found

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that each begin with a blank and end with a non-blank."""
        texts, current, length = [], [], 0
        for p in pieces:
            current.append(p)
            length += len(p)
            if length > JOINED_CHARS:
                texts.append("".join(current))
                current, length = [], 0
        texts.append("".join(current))
        ids = np.frombuffer(b"".join(self._each(texts)), "<u4")
        token_ends = np.cumsum(self.token_bytes[ids])
        piece_ends = np.cumsum(np.fromiter((len(p.encode()) for p in pieces), np.int64, len(pieces)))
        ends = np.searchsorted(token_ends, piece_ends) + 1
        if len(token_ends) == 0 or not np.array_equal(token_ends[ends - 1], piece_ends):
            return self._each(pieces)
        raw, ends = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        known = self.known
        cut = [p[:-1] if p[-1] in _MARKS and p[-2] in _LETTERS else p for p in pieces]
        new = [p for p in dict.fromkeys(cut) if p not in known]
        whole = [p for p in new if not p[-1].isspace()]
        found = dict(zip(whole, self._joined(whole))) if whole else {}
        rest = [p for p in new if p[-1].isspace()]
        found.update(zip(rest, self._each(rest)) if rest else ())
        ids = [known[p] if p in known else found[p] for p in cut]
        room = CACHED_PIECES - len(known)
        if room > 0:
            known.update(list(found.items())[:room])
        return [i if c is p else i + self.marks[p[-1]] for i, c, p in zip(ids, cut, pieces)]

    def encode(self, texts: list[str], last: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``last``, and the bounds of the texts in them."""
        first, rows = [], []
        for t in texts:
            parts = _CUT.split(t) if _AFTER_SPACE.search(t) else t.split(" ")
            first.append(parts[0])
            rows.append(parts[1:])
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        coded = pa.array([w for r in rows for w in r], pa.string()).dictionary_encode()
        rows.clear()
        distinct = [" " + w for w in coded.dictionary.to_pylist()]
        # Beyond the distinct pieces: the first piece of each text, and the closing id.
        ids = [*self._pieces(distinct), *self._each(first), np.array([last], "<u4").tobytes()]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(ids), "<u4")
        n, alone = len(texts), len(distinct)
        del ids, distinct
        begins = np.cumsum(counts + 2) - (counts + 2)
        order = np.full(int(counts.sum()) + 2 * n, alone + n, np.int32)
        order[begins] = alone + np.arange(n)
        inner = np.ones(len(order), bool)
        inner[begins] = inner[begins + counts + 1] = False
        order[inner] = coded.indices.to_numpy()
        ends = np.cumsum(sizes[order])
        bounds = np.concatenate([[0], ends[begins + counts + 1]]) if n else np.zeros(1, np.int64)
        out = np.empty(int(bounds[-1]), "<u4")
        for a in range(0, len(order), GATHERED):
            part = order[a : a + GATHERED]
            lengths, stops = sizes[part], ends[a : a + GATHERED]
            low = int(stops[0] - lengths[0])
            place = np.arange(low, int(stops[-1])) + np.repeat(starts[part] - (stops - lengths), lengths)
            out[low : int(stops[-1])] = flat[place]
        return out, bounds


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(texts: pa.Array, most: int = SLICE_BYTES):
    """Row ranges of about ``most`` bytes of text; a longer text is a range of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop
        start = stop
