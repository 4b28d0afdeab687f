"""Benchmark decontamination by suffix arrays over the training texts.

Each Arrow batch is a shard. Its words become ranks in the test vocabulary; stretches of words that no test
suffix can match over a whole window are left out, the rest is sorted as a suffix array, and the windows of all
test suffixes, equal ones once, are binary-searched in it, word by word for all at once. Where a window occurs
the match is followed to its end: the place is searched among the sorted test suffixes, with prefix hashes, so
that a match of n words costs the logarithm of n.

Test items are read in blocks of bounded size, so any number of them works: each block is one pass over the
texts, and the driver holds one block at a time, the results of a pass being written before the next.

Defined results: null and empty texts have no words and match nothing, and an item without words has no
window. ``longest`` is the longest verbatim match that begins with a whole window; without one it is 0 and
``longest_at`` null. Of matches of one length the first counts. Repeated items count as items of their own;
repeated documents are each judged. No items: nothing is contaminated. Keys are of any type. Other columns pass
through; columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlark.llm.common import release, stash
from fieldlark.llm.textkernel import ALPHANUMERIC, _powers, mixed, slices, words

WINDOW = 13
#: Bytes of test text that one pass searches for.
BLOCK = 4 << 20
SHARD = 1 << 20


class Prefixes:
    """Hashes of every stretch of ``text``, from sums over its prefixes."""

    def __init__(self, text: np.ndarray):
        up, self.down = _powers(len(text) + 1)
        self.total = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(mixed(text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=self.total[1:])

    def __call__(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (self.total[at + n] - self.total[at]) * self.down[at]


class Items:
    """The test items of a block: their vocabulary, sorted suffixes and distinct windows."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        self.ids = ids
        found = words(next((t for _, t in slices(pa.array(texts, pa.large_string()), 1 << 40)), pa.array([], pa.large_string())), ALPHANUMERIC)
        self.vocabulary = np.unique(found.hash)
        many = np.diff(found.offset)
        item = np.repeat(np.arange(len(many)), many)
        left = np.repeat(found.offset[1:], many) - np.arange(len(item))  # words to the item's end
        # The items end to end, a 0 after each: no test word has rank 0.
        self.text = np.zeros(len(item) + len(many), np.int32)
        place = np.arange(len(item)) + item
        self.text[place] = np.searchsorted(self.vocabulary, found.hash) + 1
        self.left = np.zeros(len(self.text), np.int32)
        self.left[place] = left
        self.order = suffix_array(self.text).astype(np.int32) if len(self.text) else np.empty(0, np.int32)
        # Windows: the first ``window`` words of a suffix, or a whole item that has fewer.
        whole = many[item] if len(item) else left
        size = np.where(left >= window, window, np.where((whole < window) & (left == whole), whole, 0))
        use = np.flatnonzero(size)
        _, first, which = np.unique(mixed(Prefixes(self.text)(place[use], size[use]) + size[use].astype(np.uint64)), return_index=True, return_inverse=True)
        self.start, self.size = place[use][first], size[use][first]
        self.least = int(self.size.min()) if len(self.size) else 0
        # Items by window: those of window w are ``owner[offset[w]:offset[w + 1]]``.
        pair = np.unique(which * max(1, len(ids)) + item[use])
        self.owner = pair % max(1, len(ids))
        self.offset = np.searchsorted(pair // max(1, len(ids)), np.arange(len(first) + 1))


def suffix_array(text: np.ndarray) -> np.ndarray:
    """The order of all suffixes of ``text``, by doubling the sorted length until all ranks differ."""
    n = len(text)
    if n < 2:
        return np.arange(n)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        rank = fresh
        step *= 2
        if step >= n or rank[order[-1]] == n - 1:
            return order


def search(text: np.ndarray, order: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct test window the range of the suffix array that begins with it.

    All ranges narrow together: round k keeps the windows whose word k is found.
    """
    n = len(items.start)
    low, high = np.zeros(n, np.int64), np.full(n, len(text), np.int64)
    active = np.arange(n)
    for k in range(int(items.size.max())):
        done = items.size[active] <= k
        active = active[~done]
        wanted = items.text[items.start[active] + k]
        left = _bisect(text, order, low[active], high[active], wanted, k, right=False)
        right = _bisect(text, order, left, high[active], wanted, k, right=True)
        low[active], high[active] = left, right
        active = active[right > left]
    return low, high


def extents(text: np.ndarray, place: np.ndarray, items: Items) -> np.ndarray:
    """How many words from each place of ``text`` (a 0 ends a run) the test suffix that goes on longest has in common."""
    own, other = Prefixes(text), Prefixes(items.text)
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, place)] - place

    def common(suffix: np.ndarray) -> np.ndarray:
        most = np.minimum(left, items.left[suffix])
        n = np.zeros(len(place), np.int64)
        for bit in reversed(range(int(most.max(initial=0)).bit_length())):
            more = n + (1 << bit)
            fits = np.flatnonzero(more <= most)
            same = fits[own(place[fits], more[fits]) == other(suffix[fits], more[fits])]
            n[same] = more[same]
        return n

    lo, hi = np.zeros(len(place), np.int64), np.full(len(place), len(items.order), np.int64)
    best = np.zeros(len(place), np.int64)
    while (open_ := lo < hi).any():
        mid = np.minimum((lo + hi) >> 1, len(items.order) - 1)
        suffix = items.order[mid].astype(np.int64)
        n = common(suffix)  # the nearest suffixes on both sides are among those looked at
        best = np.maximum(best, np.where(open_, n, 0))
        less = items.text[suffix + n] <= text[place + n]
        lo = np.where(open_ & less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    return best


def _bisect(text: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: np.ndarray, k: int, right: bool) -> np.ndarray:
    """In each range [lo, hi), the first place whose word k is not below (with ``right``: above) the wanted one."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        place = order[np.minimum(mid, len(order) - 1)] + k
        word = np.where(place < len(text), text[np.minimum(place, len(text) - 1)], -1)
        less = (word <= wanted) if right else (word < wanted)
        lo = np.where(open_ & less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    return lo


def matches(df: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW, block: int = BLOCK, returns: list[str] | None = None) -> DataFrame:
    """Add n_words, n_hit (long), items (the ids whose windows occur, as strings), longest (words) and longest_at (the word it begins at).

    ``returns``: the columns of ``df`` that are kept, by default all.
    """
    made = [T.StructField("n_words", T.LongType()), T.StructField("_hits", T.BinaryType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("longest", T.LongType()), T.StructField("longest_at", T.LongType())]
    names = {"n_words", "n_hit", *(f.name for f in made)}
    kept = [c for c in (returns or df.columns) if c.lower() not in names]
    base = df.select(*(df[f"`{c}`"] for c in kept), df[f"`{text}`"].alias("_text"))
    schema = T.StructType(base.schema.fields + made)
    out, before = base, None
    blocks = _blocks(items, key, text, block)
    now = next(blocks, ([], []))
    while now:
        held = df.sparkSession.sparkContext.broadcast(Items(*now, window))
        out = out.mapInArrow(_searcher(held, len(kept), before is not None, schema.names), schema)
        if now := next(blocks, None):
            out = stash(out)
            held.destroy()
            if before is not None:
                release(before)
            before = out
    n_hit = (F.octet_length("_hits") / 4).cast("long")  # four bytes for the place of each
    return out.select(*(F.col(f"`{c}`") for c in kept), "n_words", n_hit.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), "longest", "longest_at")


def _blocks(items: DataFrame, key: str, text: str, block: int) -> Iterator[tuple[list, list]]:
    """The items in runs of at most ``block`` bytes of text, or one item."""
    ids, texts, n = [], [], 0
    for row in items.select(key, text).where(F.col(text).isNotNull()).orderBy(key, text).toLocalIterator():
        size = len(row[1].encode())
        if ids and n + size > block:
            yield ids, texts
            ids, texts, n = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        n += size
    if ids:
        yield ids, texts


def _searcher(held, column: int, again: bool, names: list[str]):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        for part in parts:
            for first, texts in slices(part.column(column), SHARD):
                rows = part.slice(first, len(texts))
                n_words, hits, found, longest, at = shard(texts, items)
                if again:  # what earlier blocks have found
                    places, ids, length, spot = (rows.column(column + i).to_pylist() for i in range(2, 6))
                    hits = [np.union1d(np.frombuffer(a, np.int32), b).astype(np.int32) for a, b in zip(places, hits, strict=True)]
                    found = [a + b for a, b in zip(ids, found, strict=True)]
                    longest, at = zip(*[(a, x) if a > b or (a == b and (x or 0) <= (y or 0)) else (b, y) for a, b, x, y in zip(length, longest, spot, at, strict=True)], strict=True)
                made = [pa.array(n_words, pa.int64()), pa.array([h.tobytes() for h in hits], pa.binary()), pa.array(found, pa.list_(pa.string())), pa.array(longest, pa.int64()), pa.array(at, pa.int64())]
                yield pa.RecordBatch.from_arrays([*rows.columns[: column + 1], *made], names)

    return batches


def shard(texts: pa.Array, items: Items) -> tuple[np.ndarray, list[np.ndarray], list[list], list[int], list[int | None]]:
    """Of each row: words, the places of hit words, the ids of items found, the longest match and where it begins."""
    own = words(texts, ALPHANUMERIC)
    n_words = np.diff(own.offset)
    hits, found = [np.empty(0, np.int32)] * len(texts), [[] for _ in range(len(texts))]
    longest, at = [0] * len(texts), [None] * len(texts)
    none = n_words, hits, found, longest, at
    if not items.least or not len(own.hash):
        return none
    place = np.minimum(np.searchsorted(items.vocabulary, own.hash), len(items.vocabulary) - 1)
    rank = np.where(items.vocabulary[place] == own.hash, place + 1, 0)
    row = np.repeat(np.arange(len(texts)), n_words)
    # Runs of test words within a row that are long enough for the shortest window.
    edge = np.ones(len(rank), bool)
    edge[1:] = (row[1:] != row[:-1]) | ((rank[1:] > 0) != (rank[:-1] > 0))
    begin = np.flatnonzero(edge)
    size = np.diff(np.append(begin, len(rank)))
    use = (rank[begin] > 0) & (size >= items.least)
    begin, size = begin[use], size[use]
    if not len(begin):
        return none
    # The runs end to end, a 0 after each.
    gaps = size + 1
    where = np.repeat(begin - (np.cumsum(gaps) - gaps), gaps) + np.arange(gaps.sum())
    text = rank[np.minimum(where, len(rank) - 1)]
    text[np.cumsum(gaps) - 1] = 0
    order = suffix_array(text)
    low, high = search(text, order, items)
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return none
    many = high[hit] - low[hit]
    occurrence = order[np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    window = np.repeat(hit, many)
    start = where[occurrence]
    # The windows of each row, and their items.
    r, w = np.divmod(np.unique(row[start] * len(items.start) + window), len(items.start))
    many = np.diff(items.offset)[w]
    owner = items.owner[np.repeat(items.offset[w] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    for r, i in zip(*np.divmod(np.unique(np.repeat(r, many) * len(items.ids) + owner), len(items.ids)), strict=True):
        found[r].append(str(items.ids[i]))
    mark = np.zeros(len(rank) + 1, np.int64)
    np.add.at(mark, start, 1)
    np.add.at(mark, start + items.size[window], -1)
    place = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    for r, a, b in zip(*_runs(row[place]), strict=True):
        hits[r] = (place[a:b] - own.offset[r]).astype(np.int32)
    occurrence = np.unique(occurrence)
    start, depth = where[occurrence], extents(text, occurrence, items)
    best = np.lexsort((start, -depth, row[start]))  # of each row the longest, the first of equal ones
    x, first = np.unique(row[start[best]], return_index=True)
    for r, i in zip(x.tolist(), best[first].tolist(), strict=True):
        longest[r], at[r] = int(depth[i]), int(start[i] - own.offset[r])
    return n_words, hits, found, longest, at


def _runs(keys: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(key, from, to) of each run of equal keys."""
    begin = np.flatnonzero(np.diff(keys, prepend=-1) != 0)
    return keys[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(keys)]


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def remove(df: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``df`` that are not contaminated, its columns."""
    whole = F.struct(*(df[f"`{c}`"] for c in df.columns)).alias("_row")  # no column of it clashes with what is added
    found = matches(df.select(whole, df[f"`{text}`"].alias(text)), items, key, text, window, returns=["_row"])
    return found.where(~contaminated()).select("_row.*")
