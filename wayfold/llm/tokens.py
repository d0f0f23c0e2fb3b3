"""Token ids of whole texts, with each distinct chunk encoded once.

The pattern that splits text before merging never lets a match run from a character that isn't white space into white
space that follows. A text can thus be cut before every run of white space, and the chunks encoded apart: chunks repeat,
so a worker looks most of them up. A look-up compares whole chunks, never hashes of them alone.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Unicode's White_Space, on which both tokenizer libraries agree. str.isspace() holds four control characters more.
SPACES = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Chunks, and bytes of chunks, that a worker remembers; then it starts anew.
REMEMBERED, REMEMBERED_BYTES = 400_000, 24 << 20
#: Bytes of text that are taken apart at once, in whole texts.
BLOCK_BYTES = 1 << 19

_WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: White space beyond ASCII, by its last three bytes (two-byte characters: 0 first).
_WIDE_WHITE = np.array([int.from_bytes(c.encode().rjust(3, b"\0"), "big") for c in SPACES if ord(c) > 127])


class ChunkTable:
    """Rows of numbers for the chunks of texts. Each distinct chunk is made once and then looked up by its bytes, whole.

    ``make(chunks, joined)`` gives the numbers of a list of chunks, flat, and how many each has. ``joined`` says that each
    chunk begins with a space and has no white space at its end, so that all can be encoded as one text."""

    def __init__(self, make: Callable[[list[bytes], bool], tuple[np.ndarray, np.ndarray]], dtype: str = "<u4", block_bytes: int = BLOCK_BYTES) -> None:
        self.make, self.dtype, self.block_bytes = make, dtype, block_bytes
        self.clear()

    def clear(self) -> None:
        self.epoch = object()  # another one whenever rows are numbered anew
        self.index: dict[bytes, int] = {}  # the row of each chunk
        self.held = 0
        self.flat = np.zeros(0, self.dtype)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def _rows(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The rows of chunks, which lie one after another; new ones are made."""
        offsets = np.append(starts, len(data)).astype(np.int64)
        chunks = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        index, own = self.index, chunks.dictionary.to_pylist()  # the block's distinct chunks
        rows = list(map(index.get, own))
        fresh = [c for c, row in zip(own, rows) if row is None]
        if fresh:
            spaced = _spaced(fresh)
            flat, sizes = [], np.zeros(len(fresh), np.int64)
            for joined in (True, False):
                some = np.flatnonzero(spaced == joined)
                if len(some):
                    values, sizes[some] = self.make([fresh[i] for i in some.tolist()], joined)
                    flat.append((some, values))
            order = np.concatenate([o for o, _ in flat])
            begin = np.zeros(len(fresh), np.int64)
            begin[order] = len(self.flat) + np.cumsum(sizes[order]) - sizes[order]
            index.update(zip(fresh, range(len(self.starts), len(self.starts) + len(fresh))))
            self.held += sum(map(len, fresh))
            self.flat = np.concatenate([self.flat, *[v for _, v in flat]])
            self.starts, self.sizes = np.concatenate([self.starts, begin]), np.concatenate([self.sizes, sizes])
            rows = list(map(index.__getitem__, own))
        return np.array(rows, np.int64)[chunks.indices.to_numpy(zero_copy_only=False)]

    def blocks(self, column) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Of an Arrow string column: the first text of a block, the rows of its chunks, where each text's chunks end, and
        the block's bytes."""
        texts = column.cast("large_string")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        everything = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(texts):
            if len(self.index) > REMEMBERED or self.held > REMEMBERED_BYTES:
                self.clear()
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + self.block_bytes, "right")) - 1)
            data = everything[offsets[i] : offsets[j]]
            limits = offsets[i : j + 1] - offsets[i]
            starts = _chunk_starts(data, limits)
            yield i, self._rows(data, starts) if len(starts) else np.zeros(0, np.int64), np.searchsorted(starts, limits[1:]), data
            i = j

    def spread(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of rows one after another, and where each row's end."""
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[rows] - ends + sizes, sizes) + np.arange(total)], ends

    def texts(self, column) -> Iterator[np.ndarray]:
        """The numbers of each text of an Arrow string column."""
        for _, rows, last, _ in self.blocks(column):
            flat, ends = self.spread(rows)
            ends = np.concatenate([[0], ends])[np.concatenate([[0], last])].tolist()
            for a, b in zip(ends, ends[1:]):
                yield flat[a:b]


def _spaced(chunks: list[bytes]) -> np.ndarray:
    """Which chunks begin with one space and have no white space at their end; none is empty."""
    data = np.frombuffer(b"".join(chunks), np.uint8)
    sizes = np.array(list(map(len, chunks)), np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    second = data[np.minimum(starts + 1, len(data) - 1)]
    return (sizes > 1) & (data[starts] == 32) & ~_WHITE[second] & ~_ends_white(data, ends)


def _ends_white(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether white space stands before each place."""
    last = data[np.maximum(ends - 1, 0)]
    white = _WHITE[last]
    for k in np.flatnonzero(_WIDE_LAST[last]).tolist():
        e = int(ends[k])
        tail = bytes(data[max(0, e - 3) : e]).rjust(3, b"\0")
        white[k] = int.from_bytes(tail, "big") in _WIDE_SET or int.from_bytes(b"\0" + tail[1:], "big") in _WIDE_SET
    return white & (ends > 0)


_WIDE_SET = frozenset(_WIDE_WHITE.tolist())
#: The last bytes of white space beyond ASCII; few other characters end in one.
_WIDE_LAST = np.isin(np.arange(256), _WIDE_WHITE & 255)


def _chunk_starts(data: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """Where chunks start: at each text, and at each space that doesn't follow white space."""
    spaces = np.flatnonzero(data == 32)
    if len(spaces):
        before = data[np.maximum(spaces - 1, 0)]
        good = ~_WHITE[before]
        maybe = np.flatnonzero(_WIDE_LAST[before])
        if len(maybe):
            good[maybe] = ~_ends_white(data, spaces[maybe])
        spaces = spaces[good]
    first = np.zeros(len(data), bool)
    first[spaces] = True
    first[limits[:-1][limits[1:] > limits[:-1]]] = True
    return np.flatnonzero(first)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in byte-level vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ids of a byte-level BPE vocabulary: a rank file, or a ``tokenizers`` JSON file, whose ids are in the
    order of its merges. Special tokens are left out."""
    if path.endswith(".json"):
        import json

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"] for x in model["added_tokens"]}
        letters = _byte_letters()
        return {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@functools.cache
def id_table(vocabulary: str) -> ChunkTable:
    """Ids of a byte-level BPE vocabulary file, unsigned 32-bit; strings of special tokens are plain text.

    The ``tokenizers`` library gives the same ids, but spends tens of microseconds on each call, so chunks are merged by
    ``tiktoken`` under the file's ranks; the tests hold one against the other."""
    import public_tokenizers
    import tiktoken

    ranks = read_ranks(vocabulary)
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    size[list(ranks.values())] = list(map(len, ranks))

    def make(chunks: list[bytes], joined: bool) -> tuple[np.ndarray, np.ndarray]:
        if not joined:
            each = [encoding.encode_ordinary(x.decode()) for x in chunks]
            return np.array([i for x in each for i in x], "<u4"), np.array(list(map(len, each)), np.int64)
        ids = np.asarray(encoding.encode_to_numpy(b"".join(chunks).decode(), disallowed_special=()), "<u4")
        ends = np.cumsum(size[ids])
        chunk_ends = np.cumsum(list(map(len, chunks)))
        at = np.searchsorted(ends, chunk_ends)  # where a chunk's ids end follows from the bytes they stand for
        assert (ends[at] == chunk_ends).all()
        return ids, np.diff(at, prepend=-1)

    return ChunkTable(make)
