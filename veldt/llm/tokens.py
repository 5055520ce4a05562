"""Batch tokenising with a `tokenizers` file, each distinct piece of text encoded once.

The tokenizer's white space only separates, so a text's ids are those of its chunks between ASCII white
space. An ASCII chunk without `'` or `<` splits further, exactly as the file's pattern does, into runs of
letters, single digits and runs of other characters. Every distinct run or chunk goes through the library
once; numpy then lays the ids of a whole batch out, and compares the bytes of every piece with those it was learned
from. A block where a hash stood for other bytes goes through the library as whole texts, and so does every text under
a file whose rules are not the ones above. The tests hold this against the library on whole texts.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np

SPACE, LETTER, DIGIT, OTHER, WHOLE = range(5)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[list(b"\t\n\v\f\r ")] = SPACE
_CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[128:] = WHOLE
_CLASS[list(b"'<")] = WHOLE
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: U+00C0 to U+00FF are two bytes, C3 and one of 80 to BF; all but the signs of times and division are letters.
_LATIN, _SIGNS = 0xC3, (0x97, 0xB7)
_CODE = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

#: Bytes tokenised at once, and distinct pieces remembered before the memory starts anew.
BLOCK = 1 << 20
MEMORY = 500_000

#: The rules of a tokenizer file that the splitting above follows.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def follows_rules(path: str) -> bool:
    """Whether pieces may be encoded one by one: the file's rules are those above, added tokens begin with `<`."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    same = told["normalizer"] == NORMALIZER and told["pre_tokenizer"] == SPLITTER and told["post_processor"] is None and told["model"]["type"] == "BPE"
    return same and not told["model"].get("dropout") and all(t["content"].startswith("<") for t in told["added_tokens"])


class Growing:
    """An array that grows at its end."""

    def __init__(self, kind):
        self.data, self.n = np.empty(1024, kind), 0

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.empty(self.n + len(more), self.data.dtype)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.empty(n, np.uint64)
    out[0] = 1
    have = 1
    step = np.uint64(base & _MASK)
    with np.errstate(over="ignore"):
        while have < n:
            take = min(have, n - have)
            out[have : have + take] = out[:take] * step
            have += take
            step = step * step
    return out


def _byte_alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ..."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_ALPHABET = _byte_alphabet()


class Encoder:
    """ids(texts) -> flat int32 ids and a length for each text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_piece = follows_rules(path)
        self.up = powers(_BASE, 1 << 16)
        self.down = powers(pow(_BASE, -1, 1 << 64), 1 << 16)
        self._reset()

    def _reset(self) -> None:
        self.known = np.empty(0, np.uint64)
        self.slot = np.empty(0, np.int64)
        # of each learned piece: where its ids and its bytes end, after a leading 0
        self.id_ends, self.byte_ends = Growing(np.int64), Growing(np.int64)
        self.id_ends.add(np.zeros(1, np.int64))
        self.byte_ends.add(np.zeros(1, np.int64))
        self.store, self.bytes = Growing(np.int32), Growing(np.uint8)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            self.up = powers(_BASE, 2 * n)
            self.down = powers(pow(_BASE, -1, 1 << 64), 2 * n)

    def _learn(self, hashes: np.ndarray, pieces: list[tuple[bytes, bool]]) -> None:
        """pieces: runs of lower-case letters, which are the model's own units, or anything else."""
        ids, ends = [], []
        tokenize, encode = self.model.tokenize, self.tokenizer.encode
        for piece, letters in pieces:
            if letters:
                ids.extend([t.id for t in tokenize(piece.decode("latin-1").translate(_ALPHABET))])
            else:
                ids.extend(encode(piece.decode("utf-8"), add_special_tokens=False).ids)
            ends.append(len(ids))
        slots = np.arange(len(pieces)) + self.id_ends.n - 1
        self.id_ends.add(np.asarray(ends, np.int64) + self.store.n)
        self.byte_ends.add(np.cumsum([len(x) for x, _ in pieces]) + self.bytes.n)
        self.store.add(np.asarray(ids, np.int32))
        self.bytes.add(np.frombuffer(b"".join(x for x, _ in pieces), np.uint8))
        at = np.searchsorted(self.known, hashes)
        self.known = np.insert(self.known, at, hashes)
        self.slot = np.insert(self.slot, at, slots)

    def block(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """raw: the bytes of whole texts; starts: where each begins. Gives flat ids, ids of each text."""
        n, texts = len(raw), len(starts)
        if not n:
            return np.empty(0, np.int32), np.zeros(texts, np.int64)
        self._grow(n + 1)
        kind = _CLASS[raw]
        lower = _LOWER[raw]
        lead = np.flatnonzero(raw[:-1] == _LATIN)
        if len(lead):
            second = raw[lead + 1]
            lead = lead[~np.isin(second, _SIGNS)]
            second = raw[lead + 1]
            kind[lead] = kind[lead + 1] = LETTER
            lower[lead + 1] = np.where(second < 0x9F, second + 0x20, second)
        solid = kind != SPACE
        text_start = np.zeros(n, bool)
        text_start[starts[starts < n]] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = solid[:-1]
        chunk = solid & (~before | text_start)
        if not chunk.any():
            return np.empty(0, np.int32), np.zeros(texts, np.int64)
        number = np.cumsum(chunk, dtype=np.int32)
        whole = np.zeros(number[-1] + 1, bool)
        whole[number[(kind == WHOLE) & solid]] = True
        change = np.empty(n, bool)
        change[0] = True
        change[1:] = kind[1:] != kind[:-1]
        change |= kind == DIGIT
        change &= ~whole[number]
        start = chunk | (solid & change)
        begin = np.flatnonzero(start)
        event = np.flatnonzero(start | (~solid & before) | text_start)
        after = np.searchsorted(event, begin, side="right")
        end = np.where(after < len(event), event[np.minimum(after, len(event) - 1)], n)
        is_whole = whole[number[begin]]
        low = np.where(whole[number], raw, lower)
        with np.errstate(over="ignore"):
            total = np.empty(n + 1, np.uint64)
            total[0] = 0
            np.cumsum(_CODE[low] * self.up[:n], out=total[1:])
            hashes = (total[end] - total[begin]) * self.down[begin]
            hashes ^= (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + is_whole
        uniq, at, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.known) > MEMORY:
            self._reset()
        place = np.searchsorted(self.known, uniq)
        new = np.ones(len(uniq), bool)
        inside = place < len(self.known)
        new[inside] = self.known[place[inside]] != uniq[inside]
        if new.any():
            flat = low.tobytes()
            todo = at[new]
            letters = (kind[begin[todo]] == LETTER) & ~is_whole[todo]
            pieces = [(flat[b:e], p) for b, e, p in zip(begin[todo].tolist(), end[todo].tolist(), letters.tolist(), strict=True)]
            self._learn(uniq[new], pieces)
            place = np.searchsorted(self.known, uniq)
        slot = self.slot[place][inverse]
        size, told = end - begin, self.byte_ends.data
        if (size != told[slot + 1] - told[slot]).any():
            return self.whole(raw, starts)
        upto = np.cumsum(size)
        inside = np.arange(upto[-1]) - np.repeat(upto - size, size)
        if (low[np.repeat(begin, size) + inside] != self.bytes.data[np.repeat(told[slot], size) + inside]).any():
            return self.whole(raw, starts)
        place = self.id_ends.data
        counts = place[slot + 1] - place[slot]
        ends = np.cumsum(counts)
        ids = self.store.data[np.repeat(place[slot] - (ends - counts), counts) + np.arange(ends[-1])]
        bound = np.searchsorted(begin, np.append(starts, n))
        upto = np.concatenate([[0], ends])
        return ids, np.diff(upto[bound])

    def whole(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same through the library, text by text."""
        data, bounds = raw.tobytes(), [*starts.tolist(), len(raw)]
        got = self.tokenizer.encode_batch([data[a:b].decode("utf-8") for a, b in zip(bounds, bounds[1:])], add_special_tokens=False)
        return np.array([i for x in got for i in x.ids], np.int32), np.array([len(x.ids) for x in got], np.int64)

    def ids(self, column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """column: an Arrow string array. Yields (index of the first text, flat ids, ids of each text)."""
        raw, offsets = text_bytes(column)
        i, n = 0, len(offsets) - 1
        while i < n:
            j = int(np.searchsorted(offsets, offsets[i] + BLOCK, side="right")) - 1
            j = min(max(j, i + 1), n)
            encode = self.block if self.by_piece else self.whole
            ids, counts = encode(raw[offsets[i] : offsets[j]], offsets[i:j] - offsets[i])
            yield i, ids, counts
            i = j


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and offsets of an Arrow string array; a null text is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))
