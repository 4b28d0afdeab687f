"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file gives the vocabulary; its merges are every split of a token into two tokens, in rank order,
which is what rank-ordered merging of bytes does. The library works on characters, so each byte is mapped
to a printable character and back. Texts are cut into pieces with array operations, the distinct pieces
of a slice are encoded once, and a worker keeps the encodings it has met, since a corpus repeats its words.

Defined results: null and empty texts have no tokens; any text round-trips to the same UTF-8 bytes; ids cut
inside a character decode to its bytes, and ``decode_text`` shows U+FFFD for bytes that are no character.
Null ids decode to no bytes, an unknown id is an error. Other columns pass through, a column named like an
output is replaced. Repeated rows are encoded each.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of pieces, about, that a worker remembers within a partition, and the longest piece it remembers;
#: others are encoded anew. EACH is what a remembered piece costs beside its bytes.
MEMORY, LONGEST, EACH = 32 << 20, 64, 240
#: Pieces that the library encodes in a call.
BATCH = 8192
#: A stretch of bytes, again, and its first byte a third time.
REPEATS = re.compile(rb"((.).*?)\1\2", re.DOTALL)
#: The split rule that ``boundaries`` follows; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LETTER, NUMBER, SPACE, OTHER, UNKNOWN = range(5)
SLICE = 1 << 20


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte: itself where printable, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def boundaries(chars: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the matches of PATTERN begin. ``chars``: code points of rows end to end; ``first``: whether one begins a row."""
    begin = first.copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # Of white space before something else, the last character stands alone, or leads the next match if it is a blank.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:])
    begin[last] = True
    begin[last[chars[last] == ord(" ")] + 1] = False
    # A contraction is one match where its apostrophe begins a match.
    quote = np.flatnonzero((chars == ord("'")) & begin)
    at = lambda step: np.where(quote + step < len(chars), chars[np.minimum(quote + step, len(chars) - 1)], 0)
    starts = lambda step: first[np.minimum(quote + step, len(chars) - 1)]
    one, two = np.where(starts(1), 0, at(1)), np.where(starts(1) | starts(2), 0, at(2))
    short = np.isin(one, [*map(ord, "stmd")])
    long = np.isin(one * 0x200000 + two, [ord(a) * 0x200000 + ord(b) for a, b in ("re", "ve", "ll")])
    inner = quote[short | long]
    begin[inner + 1] = False
    begin[quote[long] + 2] = False
    after = np.concatenate([quote[short] + 2, quote[long] + 3])
    begin[after[after < len(chars)]] = True
    return begin


class Codec:
    """Encoder and decoder of one rank file; ``pattern`` splits a text into the pieces that are encoded apart."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

        self.table = table = ranks(path)
        shown = byte_characters()
        show = lambda token: "".join(map(shown.__getitem__, token))
        merges = sorted(
            (rank, table[token[:i]], table[token[i:]], token[:i], token[i:])
            for token, rank in table.items()
            for i in range(1, len(token))
            if token[:i] in table and token[i:] in table
        )
        model = models.BPE(vocab={show(t): r for t, r in table.items()}, merges=[(show(a), show(b)) for *_, a, b in merges], ignore_merges=True, cache_capacity=0)
        self.tokenizer = Tokenizer(model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.tokenizer.decoder = decoders.ByteLevel()
        self.splitter = pre_tokenizers.Split(Regex(pattern), "isolated")
        self.plain = pattern == PATTERN
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self.size = np.zeros(max(table.values()) + 1, np.int64)
        self.size[list(table.values())] = [len(t) for t in table]
        self.longest = max(map(len, table))
        self.known: dict[str, bytes] = {}
        self.held = 0

    def forget(self) -> None:
        self.known.clear()
        self.held = 0

    def kind(self, chars: np.ndarray) -> np.ndarray:
        """The classes of code points, by how the library's own splitter joins each to a letter, a digit or a sign."""
        found = self.kinds[chars]
        if (found == UNKNOWN).any():
            joins = lambda pair: len(self.splitter.pre_tokenize_str(pair)) == 1
            for c in np.unique(chars[found == UNKNOWN]).tolist():
                self.kinds[c] = next((k for k, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "=")) if joins(x + chr(c))), SPACE)
            found = self.kinds[chars]
        return found

    def repeats(self, piece: bytes) -> bool:
        """Whether a stretch that may lie in a token comes again at once, with its first byte a third time."""
        if len(piece) <= LONGEST:
            return bool(REPEATS.search(piece))
        raw = np.frombuffer(piece, np.uint8)
        for lag in range(1, min(self.longest, len(raw) // 2 + 1)):
            apart = np.flatnonzero(raw[lag:] != raw[:-lag])  # between two of these the bytes repeat after ``lag``
            if np.diff(apart, prepend=-1, append=len(raw) - lag).max() > lag + 1:
                return True
        return False

    def merge(self, piece: bytes) -> list[int]:
        """Merge neighbours by rank, the leftmost of equal rank first."""
        if piece in self.table:
            return [self.table[piece]]
        n, rank = len(piece), self.table.get
        part = [piece[i : i + 1] for i in range(n)]
        left, right = array("q", range(-1, n - 1)), array("q", range(1, n + 1))
        ready = [r * n + i for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapify(ready)
        while ready:
            r, i = divmod(heappop(ready), n)
            j = right[i]
            if not part[i] or j >= n or rank(part[i] + part[j]) != r:
                continue  # one of the two has merged since
            part[i], part[j], right[i] = part[i] + part[j], b"", right[j]
            if right[j] < n:
                left[right[j]] = i
            for k in (left[i], i):
                if k >= 0 and right[k] < n and (r := rank(part[k] + part[right[k]])) is not None:
                    heappush(ready, r * n + k)
        return [self.table[x] for x in part if x]

    def fresh(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces, four bytes each, by the library.

        Among overlapping pairs of equal rank the library takes the first listed, not the leftmost. Those need
        a repeating stretch of bytes, so pieces that have one are merged here.
        """
        out = {}
        for at in range(0, len(pieces), BATCH):
            some = pieces[at : at + BATCH]
            (e,) = self.tokenizer.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(e.ids, np.int32)
            ends = 4 * (np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(p.encode()) for p in some])) + 1)
            ids = ids.tobytes()
            out.update(zip(some, (ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)), strict=True))
        for piece in pieces:
            raw = piece.encode()
            if self.repeats(raw):
                out[piece] = np.array(self.merge(raw), np.int32).tobytes()
        return out

    def pieces(self, texts: pa.LargeStringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The pieces of a slice end to end, and how many each row has."""
        rows = texts.to_pylist()
        if not self.plain:
            split = [[p for p, _ in self.splitter.pre_tokenize_str(t)] for t in rows]
            return pa.array([p for s in split for p in s], pa.string()), np.array([len(s) for s in split], np.int64)
        whole = "".join(rows)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32).astype(np.int64)
        if not len(chars):
            return pa.array([], pa.string()), np.zeros(len(rows), np.int64)
        row = np.cumsum([0, *map(len, rows)])
        first = np.zeros(len(chars), bool)
        first[row[:-1][row[:-1] < len(chars)]] = True
        begin = np.flatnonzero(boundaries(chars, self.kind(chars), first))
        raw = whole.encode()
        place = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        offsets = np.append(place[begin], len(raw)).astype(np.int32)
        return pa.StringArray.from_buffers(len(begin), pa.py_buffer(offsets), pa.py_buffer(raw)), np.diff(np.searchsorted(begin, row))

    def encode(self, texts: pa.LargeStringArray) -> pa.ListArray:
        """The ids of each row of a slice."""
        pieces, counts = self.pieces(texts)
        coded = pieces.dictionary_encode()
        distinct, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        found = self.known
        codes = self.fresh([p for p in distinct if p not in found])
        ids = [found[p] if p in found else codes[p] for p in distinct]
        short = {p: c for p, c in codes.items() if len(p) <= LONGEST}
        more = sum(EACH + len(p) + len(c) for p, c in short.items())
        if self.held + more > MEMORY:
            self.forget()
        if more <= MEMORY:
            found.update(short)
            self.held += more
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.int32)
        start = np.cumsum(size) - size
        many = size[which]
        end = np.cumsum(many)
        total = int(end[-1]) if len(end) else 0
        flat = flat[np.repeat(start[which] - (end - many), many) + np.arange(total)]
        by_row = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(by_row.astype(np.int32), flat)

    def starts(self, texts: pa.LargeStringArray, ids: pa.ListArray) -> pa.ListArray:
        """The character of its row that each id's first byte belongs to."""
        long = self.size[ids.flatten().to_numpy()]
        raw = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1
        at = character[np.cumsum(long) - long] if len(long) else long
        per_row = np.diff(ids.offsets.to_numpy())
        before = np.cumsum([0, *map(len, texts.to_pylist())])[:-1]
        return pa.ListArray.from_arrays(ids.offsets, (at - np.repeat(before, per_row)).astype(np.int32))


@lru_cache(maxsize=2)
def byte_table(path: str) -> pa.BinaryArray:
    """The bytes of each id, by reversing the characters of its token."""
    shown = byte_characters()
    back = {c: b for b, c in shown.items()}
    tokens = {rank: "".join(map(shown.__getitem__, token)) for token, rank in ranks(path).items()}
    return pa.array([bytes(map(back.__getitem__, tokens[i])) if i in tokens else None for i in range(max(tokens) + 1)], pa.binary())


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _replaced(df: DataFrame, *fields: T.StructField) -> T.StructType:
    """The schema of ``df`` with ``fields`` at its end, in place of columns of those names."""
    names = {f.name.lower() for f in fields}
    return T.StructType([f for f in df.schema if f.name.lower() not in names] + list(fields))


def _slices(texts: pa.Array) -> Iterator[tuple[int, pa.LargeStringArray]]:
    """(first row, rows) of about SLICE bytes of text; null becomes empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    ends = np.cumsum(np.concatenate([[0], pa.compute.binary_length(texts).to_numpy()]))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE, "right")) - 1)
        yield at, texts.slice(at, to - at)
        at = to


def encode(df: DataFrame, path: str, pattern: str = PATTERN, text: str = "text", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """Add ``ids`` array<int>, and if named ``offsets`` array<int>: the first character (code point) of each id's bytes.

    ``path``: a file of base64 tokens and ranks that every executor can open.
    """
    element = T.ArrayType(T.IntegerType(), False)
    fields = [T.StructField(name, element, False) for name in (ids, offsets) if name]
    schema = _replaced(df, *fields)
    kept = [f.name for f in schema][: -len(fields)]
    source = df.columns[[c.lower() for c in df.columns].index(text.lower())]
    at = len(kept)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in parts:
            for first, texts in _slices(part.column(at)):
                made = [own.encode(texts)]
                if offsets:
                    made.append(own.starts(texts, made[0]))
                columns = part.slice(first, len(texts)).columns[:at]
                yield pa.RecordBatch.from_arrays([*columns, *made], schema.names)
        own.forget()

    return df.select(*(df[f"`{c}`"] for c in kept), df[f"`{source}`"].alias("_source")).mapInArrow(batches, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded`` binary: the bytes of the ids."""
    schema = _replaced(df, T.StructField(decoded, T.BinaryType(), False))
    kept = schema.names[:-1]
    source = df.columns[[c.lower() for c in df.columns].index(ids.lower())]
    at = len(kept)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = byte_table(path)
        size = pa.compute.binary_length(names).to_numpy()
        for whole in parts:
            for first in range(0, whole.num_rows, 512):
                part = whole.slice(first, 512)
                rows = part.column(at).fill_null([]) if part.column(at).null_count else part.column(at)
                ids = rows.flatten()
                token = names.take(ids)  # the bytes of all rows end to end
                ends = np.cumsum(np.concatenate([[0], size[ids.to_numpy()]]))
                offsets = ends[rows.offsets.to_numpy() - rows.offsets[0].as_py()].astype(np.int32)
                made = pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), token.buffers()[2] or pa.py_buffer(b"")])
                yield pa.RecordBatch.from_arrays([*part.columns[:at], made], schema.names)

    return df.select(*(df[f"`{c}`"] for c in kept), df[f"`{source}`"].alias("_source")).mapInArrow(batches, schema)


def decode_text(decoded: str = "decoded"):
    """The bytes as text, with U+FFFD for what is not UTF-8."""
    return F.make_valid_utf8(F.col(decoded).cast("string"))
