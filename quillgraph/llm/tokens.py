"""Token ids of whole texts by the tokenizers library, with the work done once a distinct chunk.

Ids are those of ``Tokenizer.encode(text, add_special_tokens=False)`` with special tokens' strings as ordinary
text. Two common kinds of file are taken apart at places where no token can reach across, a batch's distinct
chunks are found by Arrow, and only those are encoded:

* byte-level BPE that splits as ``' ?letters| ?digits|...'``: before each space between two non-spaces, and between
  plain Latin letters, digits and signs other than the apostrophe;
* BPE on words that drops white space: at ASCII white space, and between plain Latin letters, digits and signs.

A chunk of plain Latin characters is split by an equal pattern and goes straight to the file's BPE model; any
other goes to the library as it is. Other kinds of file are encoded text by text.

A worker keeps an encoder between tasks, so what it holds counts in every later step: texts are cut into chunks two
megabytes at a time, and of what was encoded only what was met lately is kept, ``MOST_BYTES`` at most and the chunks
of one cut, without a change of results.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa

from .arrow import slices

MOST_BYTES, ENTRY_BYTES = 64 << 20, 110  # of what was encoded; an entry's share of its dictionary, its number and its place
SLICE, BLOCK = 2 << 20, 1 << 16  # bytes of texts that are cut together, characters that are classed together
LATIN = re.compile(r"[\x20-\x7e\n\t\r\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
SPACED = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
UNSPACED = re.compile(r"'(?:[stmd]|re|ve|ll)|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Fixed by the two files' kind: their pre-tokenizers' patterns.
SPACED_KIND = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
UNSPACED_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


ODD, SPACE, WHITE, LETTER, DIGIT, SIGN = range(6)  # classes of characters; ODD: no cut beside it but for a space's


def _classes() -> np.ndarray:
    """The class of each character up to U+3000, and of those beyond."""
    out = np.zeros(0x3002, np.uint8)
    for c in map(chr, range(0x3001)):
        if c.isspace():
            out[ord(c)] = SPACE if c == " " else WHITE
        elif "!" <= c <= "~" or "\u00c0" <= c <= "\u00ff":
            out[ord(c)] = ODD if c in "'\u00d7\u00f7" else LETTER if c.isalpha() else DIGIT if c.isdigit() else SIGN
    return out


CLASSES = _classes()
#: The class of each UTF-8 byte where white space is dropped; after the lead byte of U+00C0 to U+00FF, a letter as well.
LATIN_LEAD = 0xC3
BYTE_CLASSES = bytes(LETTER if b == LATIN_LEAD else ODD if b >= 0x80 else WHITE if b in b" \t\n\v\f\r" else CLASSES[b] if b > 32 else ODD for b in range(256))


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class TextEncoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model, self.kind = self.tokenizer.model, self._kind(json.loads(self.tokenizer.to_str()))
        letters = _byte_letters()
        self.spelt, self.space = str.maketrans({chr(c): "".join(letters[b] for b in chr(c).encode()) for c in range(256)}), letters[32]
        self.forget()

    @staticmethod
    def _kind(spec: dict) -> str:
        pre, norm = spec["pre_tokenizer"] or {}, spec["normalizer"] or {}
        if spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
            return "whole"
        if not norm and SPACED_KIND.items() <= pre.items():
            return "spaced"
        steps = pre.get("pretokenizers", [])
        if [x["type"] for x in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in steps] == ["Split", "ByteLevel"]:
            if steps[0]["pattern"].get("Regex") == UNSPACED_PATTERN and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]:
                return "unspaced"
        return "whole"

    def forget(self) -> None:
        """Let go of what was encoded; results do not change."""
        self.known, self.pieces, self.flat, self.starts = {}, {}, array("i"), array("q", [0])
        self._begin()

    def _begin(self) -> None:
        """Hold nothing, and what was held till now as what was held before: it is asked once more, then let go."""
        self.before = self.known, self.pieces, self.flat, self.starts
        self.known: dict[str, int] = {}
        self.pieces: dict[str, int] = {}
        self.flat, self.starts, self.held = array("i"), array("q", [0]), 0

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order, ids of each) of a large_string column without nulls."""
        done = [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        done += [self._encode(part.column(0)) for part in slices(pa.RecordBatch.from_arrays([column], ["text"]), 0, SLICE)]
        return np.concatenate([flat for flat, _ in done]), np.concatenate([counts for _, counts in done])

    def _encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.held > MOST_BYTES // 2:
            self._begin()
        if self.kind == "whole":
            each = [e.ids for e in self.tokenizer.encode_batch(column.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in each for i in ids], np.int32), np.array([len(ids) for ids in each], np.int64)
        bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        edges, found = (self._unspaced if self.kind == "unspaced" else self._spaced)(data, bounds - bounds[0])
        coded = found.dictionary_encode()
        code, at = coded.indices.to_numpy(zero_copy_only=False), self._indexes(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        starts = np.frombuffer(self.starts, np.int64)
        lengths = (starts[at + 1] - starts[at])[code]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.frombuffer(self.flat, np.int32)[np.arange(ends[-1]) + np.repeat(starts[at][code] - ends[:-1], lengths)] if ends[-1] else np.zeros(0, np.int32)
        return flat, np.diff(ends[edges])

    @staticmethod
    def _unspaced(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """(first chunk of each text and their number, chunks): letters in lower case, signs, single digits, or what has an odd character."""
        raw = data.tobytes()
        kind, low = np.frombuffer(bytearray(raw.translate(BYTE_CLASSES)), np.uint8), np.frombuffer(bytearray(raw.lower()), np.uint8)
        lead = np.flatnonzero(data == LATIN_LEAD)
        if len(lead):
            second = data[lead + 1]
            sign = (second == 0x97) | (second == 0xB7)
            kind[lead + 1] = np.where(sign, ODD, LETTER)
            kind[lead[sign]] = ODD
            low[lead + 1] += np.where((second < 0x9F) & ~sign, 0x20, 0).astype(np.uint8)
        heads = np.ones(len(data), bool)
        heads[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        odd = np.flatnonzero(kind == ODD)
        beside = odd + 1
        heads[odd] = False
        heads[beside[beside < len(data)]] = False
        kept = kind != WHITE
        heads[1:] |= kept[1:] & ~kept[:-1]
        starts = bounds[:-1]
        heads[starts[starts < len(data)]] = True
        heads &= kept
        first = np.flatnonzero(heads[kept])
        body, size = low[kept], int(np.count_nonzero(kept))
        edges = np.searchsorted(np.flatnonzero(heads), bounds)
        offsets = np.append(first, size)
        if len(odd):  # keep their letters' case, which normalization may see
            own = data[kept]
            has = np.unique(np.searchsorted(first, np.flatnonzero(kind[kept] == ODD), side="right") - 1)
            for a, b in zip(offsets[has].tolist(), offsets[has + 1].tolist(), strict=True):
                body[a:b] = own[a:b]
        return edges, pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(body))

    @staticmethod
    def _spaced(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """(first chunk of each text and their number, chunks)."""
        cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind = np.empty(len(cp), np.uint8)
        for at in range(0, len(cp), BLOCK):
            kind[at : at + BLOCK] = CLASSES[np.minimum(cp[at : at + BLOCK], len(CLASSES) - 1)]
        white = (kind == SPACE) | (kind == WHITE)
        heads = np.ones(len(cp), bool)
        heads[1:] = (kind[:-1] >= LETTER) & (kind[1:] >= LETTER) & (kind[:-1] != kind[1:])
        heads[1:-1] |= (kind[1:-1] == SPACE) & ~white[:-2] & ~white[2:]
        begins = np.zeros(len(data), bool)
        begins[(data & 0xC0) != 0x80] = heads
        starts = bounds[:-1]
        begins[starts[starts < len(data)]] = True
        first = np.flatnonzero(begins)
        offsets = np.append(first, len(data))
        return np.searchsorted(first, bounds), pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(data))

    def _indexes(self, chunks: list[str]) -> np.ndarray:
        """The place of each of these distinct chunks among those encoded; new ones are encoded first."""
        known = self.known
        out = np.fromiter(map(known.get, chunks, repeat(-1)), np.int64, len(chunks))
        for k in np.flatnonzero(out < 0).tolist():
            chunk = chunks[k]
            known[chunk] = out[k] = self._hold(chunk, self._earlier(0, chunk) or self._ids(chunk))
        return out

    def _earlier(self, kind: int, chunk: str) -> array | None:
        """The ids of a chunk (0) or of a piece (1) that was held before."""
        at = self.before[kind].get(chunk)
        return None if at is None else self.before[2][self.before[3][at] : self.before[3][at + 1]]

    def _hold(self, chunk: str, ids: list[int] | array) -> int:
        """Keep these ids; their place."""
        self.flat.extend(ids)
        self.starts.append(len(self.flat))
        self.held += sys.getsizeof(chunk) + 4 * len(ids) + ENTRY_BYTES
        return len(self.starts) - 2

    def _ids(self, chunk: str) -> list[int]:
        if chunk.isalpha() and chunk.isascii():
            return self._model_ids(chunk if self.kind == "spaced" else chunk.lower())
        if self.kind == "spaced" and chunk.isascii() and chunk[0] == " " and chunk[1:].isalpha():
            return self._model_ids(self.space + chunk[1:])
        if not LATIN.fullmatch(chunk):
            return self.tokenizer.encode(chunk, add_special_tokens=False).ids
        if self.kind == "unspaced":
            chunk = chunk.lower()
            if chunk.isalpha():
                return self._model_ids(chunk.translate(self.spelt))
        found = []
        for piece in (SPACED if self.kind == "spaced" else UNSPACED).findall(chunk):
            at = self.pieces.get(piece)
            if at is None:
                at = self.pieces[piece] = self._hold(piece, self._earlier(1, piece) or self._model_ids(piece.translate(self.spelt)))
            found += self.flat[self.starts[at] : self.starts[at + 1]]
        return found

    def _model_ids(self, spelt: str) -> list[int]:
        return [t.id for t in self.model.tokenize(spelt)]


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One encoder a worker process."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def with_end(flat: np.ndarray, counts: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Append ``end_id`` to each text's ids."""
    if end_id is None:
        return flat, counts
    return np.insert(flat, np.cumsum(counts), end_id), counts + 1


def binary_rows(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A large_binary row of little-endian ids for each count."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * flat.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
