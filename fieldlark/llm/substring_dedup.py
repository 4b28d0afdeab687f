"""Substring deduplication: paragraph MinHash banding, and verbatim windows for passages inside paragraphs.

A paragraph is a line of at least ``least_words`` words (five at least, a shingle). Equal paragraphs are one; the others are banded on their
MinHash signatures, those that meet in a band are verified by exact Jaccard similarity of five-word shingles, and
the linked ones form components. A passage set into the middle of a line is no paragraph, so windows of WORDS
words are compared too: each text posts the windows whose hash is least among ROUND neighbours, which two texts
that share WORDS + ROUND - 1 words in a row (49) always do at the same place. From there each match with the first
text that posts the window is followed both ways as far as words are equal. The first occurrence, by key and
place, of each component and window stays, the others are removed, further ones in the same text too; overlapping
windows join into spans.

Defined results: null and empty texts have no paragraph; a repeat inside one text alone is no repeat across
texts and stays; a window that overlaps its own first occurrence (a word said over and over) is none; rows with one key are one text
each, and what they share with another key goes from all of them; rows with a null key stay as they are. Short lines and passages, fewer
words than a window, always stay. Very long texts are read whole. Other columns pass through ``remove``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlark.llm.common import joined_groups, release, stash, unused, with_groups
from fieldlark.llm.near_dedup import KEYS, both_ends, link_lists, signatures, spread
from fieldlark.llm.textkernel import SPACED, _powers, mixed, shingles, slices, words

#: Words of the shortest line that is a paragraph by default, and of a shingle.
LEAST_WORDS, SHINGLE = 50, 5
WORDS, ROUND = 32, 18
#: Bands of two coordinates: a pair at 0.8 meets in one of eight with odds of 0.9997; of sixteen coordinates it
#: shares six with odds of 0.9998.
BANDS, LEAST = 8, 6
#: Spans that are broadcast at most, in rows of about 40 bytes; beyond, the join shuffles.
SPANS = 1_000_000


def _slide(x: np.ndarray, n: int, f) -> np.ndarray:
    """``f`` (minimum or maximum) over each run of n, by doubling."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = f(x[: len(x) - step], x[step:])
        done += step
    return x


def windows(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the windows that a row of words posts, each at every place that it has."""
    n = len(hashes) - WORDS + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    up, down = _powers(len(hashes))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])
    value = mixed((total[WORDS:] - total[:-WORDS]) * down[:n])
    if n > ROUND:
        least = _slide(value, ROUND, np.minimum)  # of windows i..i+ROUND-1
        edge = np.zeros(ROUND - 1, np.uint64)
        place = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), ROUND, np.maximum)[:n] == value)
    else:
        place = np.flatnonzero(value == value.min())
    return place, value[place].view(np.int64)


def paragraphs(texts: pa.Array, least_words: int) -> Iterator[tuple[int, int, int, int, np.ndarray]]:
    """(row, first word, words, hash, set of shingles) of each paragraph of a slice."""
    own = words(texts, SPACED)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[: offsets[-1]]
    breaks = np.flatnonzero(data[offsets[0] :] == 10)
    row = np.repeat(np.arange(len(texts)), np.diff(own.offset))
    line = np.searchsorted(breaks, own.start + (offsets[:-1] - offsets[0])[row]) + row * 1_000_003  # a row's end ends a line
    begin = np.flatnonzero(np.diff(line, prepend=-1) != 0)
    end = np.append(begin[1:], len(line))[: len(begin)]
    grams = shingles(own.hash, SHINGLE).view(np.int64)
    up, _ = _powers(int((end - begin).max(initial=0)) + 1)
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        if b - a >= max(least_words, SHINGLE):
            found = np.sort(grams[a : b - SHINGLE + 1])
            found = found[np.concatenate([[True], found[1:] != found[:-1]])]
            content = mixed(np.array([(own.hash[a:b] * up[: b - a]).sum() + np.uint64(b - a)], np.uint64)).view(np.int64)
            yield int(row[a]), a - int(own.offset[row[a]]), b - a, int(content[0]), found


def _units(least_words: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "place", "n_words", "hash", "signature"]
        for part in parts:
            for first, texts in slices(part.column(1)):
                ids = part.column(0).slice(first, len(texts))
                own = words(texts, SPACED)
                posted = [windows(own.hash[a:b]) for a, b in zip(own.offset, own.offset[1:], strict=False)]
                many = [len(p) for p, _ in posted]
                n = sum(many)
                place, value = (np.concatenate(x) for x in zip(*posted, strict=True))
                rows = pa.array(np.repeat(np.arange(len(texts)), many))
                yield pa.RecordBatch.from_arrays([ids.take(rows), pa.array(place.astype(np.int32)), pa.array(np.full(n, WORDS, np.int32)), pa.array(value), pa.nulls(n, pa.list_(pa.int32()))], names)
                if found := list(paragraphs(texts, least_words)):
                    row, place, size, value, held = zip(*found, strict=True)
                    signed = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * 2 * BANDS, signatures(list(held), 2 * BANDS).ravel())
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(place, pa.int32()), pa.array(size, pa.int32()), pa.array(value, pa.int64()), signed], names)

    return batches


def _sets(least_words: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, texts in slices(part.column(0)):
                found = list(paragraphs(texts, least_words))
                ends = np.cumsum([0, *(len(f[4]) for f in found)], dtype=np.int32)
                flat = np.concatenate([f[4] for f in found]) if found else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([f[3] for f in found], pa.int64()), pa.ListArray.from_arrays(ends, flat)], ["id", "hashes"])

    return batches


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """How many words two rows of one length have in common from their start."""
    at, step = 0, 64
    while at < len(a):
        differ = a[at : at + step] != b[at : at + step]
        if differ.any():
            return at + int(differ.argmax())
        at += step
        step *= 2
    return len(a)


def _extended(x: np.ndarray, y: np.ndarray, anchors: list[dict], same: bool) -> Iterator[tuple[int, int, int]]:
    """(place in x, place in y, words) of the matches that the anchors lie in, both ways as far as words are equal.

    With ``same`` both are one text, and a match ends before it runs into its copy.
    """
    diagonal, end = None, 0
    for d, p in sorted((a["place"] - a["first_place"], a["place"]) for a in anchors):
        q = p - d
        if d == diagonal and p + WORDS <= end:
            continue
        most = min(len(x) - p, len(y) - q, d if same else len(x))
        n = _common(x[p : p + most], y[q : q + most]) if most >= WORDS else 0
        if n < WORDS:  # of another row with this key
            continue
        back = min(p, q, d - n if same else p)
        back = _common(x[p - back : p][::-1], y[q - back : q][::-1])
        diagonal, end = d, p + n
        yield p - back, q - back, back + n


def _alike(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in parts:
        key = part.schema.field(0).type
        for first, texts in slices(part.column(3)):
            for second, others in slices(part.column(4).slice(first, len(texts))):
                rows = part.slice(first + second, len(others))
                coded = [t.dictionary_encode() for t in (texts.slice(second, len(others)), others)]
                own = [words(c.dictionary, SPACED) for c in coded]
                row = lambda k, i: own[k].hash[own[k].offset[i] : own[k].offset[i + 1]]  # noqa: B023, E731
                out = []
                for id_, first_id, anchors, i, j in zip(*(rows.column(k).to_pylist() for k in range(3)), *(c.indices.to_pylist() for c in coded), strict=True):
                    for at, there, n in _extended(row(0, i), row(1, j), anchors, id_ == first_id):
                        out += [(id_, True, at, n, first_id), (first_id, False, there, n, first_id)]
                columns = zip(*out, strict=True) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (key, pa.bool_(), pa.int32(), pa.int32(), key), strict=True)], ["id", "removed", "place", "n_words", "first_id"])


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = 80, least_words: int = LEAST_WORDS) -> DataFrame:
    """The spans that repeat across texts: (key, first_word, n_words, kind, first_id, removed).

    ``kind`` is paragraph or window; ``first_id`` the key of the text that keeps the passage (of a joined span,
    the smallest such key). Spans that stay, as the first of their kind, have ``removed`` false. Keys are of
    any type that has an order.
    """
    source = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).where("id IS NOT NULL")
    kind = source.schema["id"].dataType
    unit = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.IntegerType()) for c in ("place", "n_words")), T.StructField("hash", T.LongType()), T.StructField("signature", T.ArrayType(T.IntegerType()))])
    match = T.StructType([T.StructField("id", kind), T.StructField("removed", T.BooleanType()), *(T.StructField(c, T.IntegerType()) for c in ("place", "n_words")), T.StructField("first_id", kind)])
    units = stash(source.mapInArrow(_units(least_words), unit))
    first, last = F.min(F.struct("id", "place")).alias("first"), F.max("id").alias("last")
    across = "n > 1 AND first.id <> last"

    posted = units.where("signature IS NULL").select("id", "place", "n_words", "hash")
    found, groups = with_groups(posted, ["hash"], first, last, where=across)
    found = found.where((F.col("id") != F.col("first.id")) | (F.col("place") == F.col("first.place")) | (F.col("place") >= F.col("first.place") + WORDS))
    found = found.where(F.struct("id", "place") != F.col("first")).groupBy("id", F.col("first.id").alias("first_id"))
    found = stash(found.agg(F.collect_set(F.struct("place", F.col("first.place").alias("first_place"))).alias("anchors")))
    lines = stash(units.where("signature IS NOT NULL"))
    release(groups, units)
    rows = found.count()
    pairs = found.withColumn("bucket", spread(F.col("id"), rows))
    ends = stash(found.select("id").union(found.select("first_id")).distinct())
    ends = F.broadcast(ends) if ends.count() <= KEYS else ends
    both = both_ends(pairs, source.join(ends, "id", "left_semi"), "first_id", "text")
    alike = both.select("id", "first_id", "anchors", "own", "other").mapInArrow(_alike, match)
    # One row a word at most, so that a text that keeps a very common passage stays small.
    alike = alike.groupBy("id", "removed", "place").agg(F.max("n_words").alias("n_words"), F.min("first_id").alias("first_id"))
    by = Window.partitionBy("id", "removed").orderBy("place")
    before = F.max(F.col("place") + F.col("n_words")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = alike.withColumn("_apart", F.coalesce(F.col("place") > before, F.lit(True)).cast("int")).withColumn("_span", F.sum("_apart").over(by)).groupBy("id", "removed", "_span")
    spans = spans.agg(F.min("place").alias("first_word"), F.max(F.col("place") + F.col("n_words")).alias("_end"), F.min("first_id").alias("first_id"))
    spans = spans.select("id", "first_word", (F.col("_end") - F.col("first_word")).alias("n_words"), F.lit("window").alias("kind"), "first_id", "removed")

    distinct = lines.groupBy(F.col("hash").alias("id")).agg(F.count("*").alias("n"), F.min("id").alias("doc"), F.min_by("signature", "id").alias("signature"))
    distinct = stash(distinct)
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.get("signature", 2 * i), F.get("signature", 2 * i + 1)))
    banded, groups = with_groups(distinct.select("id", F.explode(F.array_distinct(bands)).alias("key")), ["key"])
    met = banded.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
    met = stash(met.select("id", F.transform("keys", lambda k: k["key"]).alias("prefix"), F.aggregate("keys", F.lit(0).cast("long"), lambda t, k: t + k["n"]).alias("centrality")))
    release(groups)
    wanted = met.join(distinct, "id").select(F.col("doc").alias("id")).distinct()
    wanted = F.broadcast(wanted) if met.count() <= KEYS else wanted
    sets = source.join(wanted, "id", "left_semi").select("text").mapInArrow(_sets(least_words), "id long, hashes array<long>").join(met.select("id"), "id", "left_semi")
    hashes = stash(sets.groupBy("id").agg(F.first("hashes").alias("hashes")))
    joined = link_lists(met, distinct.select("id", "signature"), hashes, LEAST, share)
    release(met, hashes)
    classes = distinct.select("id", "n").join(joined.withColumnRenamed("node", "id"), "id", "left")
    classes = stash(classes.select(F.col("id").alias("hash"), "n", F.coalesce("component", "id").alias("class")))
    release(distinct)
    placed = joined_groups(lines.select("id", "place", "n_words", "hash"), classes, ["hash"]).select("id", "place", "n_words", "class")
    same, _ = with_groups(placed, ["class"], first, last, where=across)
    same = same.select("id", F.col("place").alias("first_word"), "n_words", F.lit("paragraph").alias("kind"), F.col("first.id").alias("first_id"), (F.struct("id", "place") != F.col("first")).alias("removed"))
    return spans.unionByName(same).withColumnRenamed("id", key)


def _cut(spans: list, text: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    out, at = [], 0
    for first, n in sorted((s["first_word"], s["n_words"]) for s in spans):
        a, b = int(start[first]), int(end[min(first + n, len(end)) - 1])
        if a > at:
            out.append(text[at:a])
        at = max(at, b)
    return b"".join(out) + text[at:]


def remove(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the removed spans of ``repeats``; a text may become empty, and a null one stays null."""
    held = unused(docs, "_spans")
    gone = spans.where("removed").groupBy(key).agg(F.collect_list(F.struct("first_word", "n_words")).alias(held))
    gone = stash(gone)
    gone = F.broadcast(gone) if gone.agg(F.coalesce(F.sum(F.size(held)), F.lit(0))).first()[0] <= SPANS else gone
    names = docs.columns
    at = next(i for i, n in enumerate(names) if n.lower() == text.lower())

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, texts in slices(part.column(at)):
                rows = part.slice(first, len(texts))
                spans = rows.column(len(names)).to_pylist()
                column = rows.column(at)
                if any(spans):
                    own = words(texts, SPACED)
                    new = rows.column(at).to_pylist()
                    for i, found in enumerate(spans):
                        if found:
                            a, b = own.offset[i], own.offset[i + 1]
                            new[i] = _cut(found, new[i].encode(), own.start[a:b], own.end[a:b]).decode()
                    column = pa.array(new, column.type)
                yield pa.RecordBatch.from_arrays([*rows.columns[:at], column, *rows.columns[at + 1 : len(names)]], names)

    return docs.join(gone, key, "left").select(*(f"`{c}`" for c in names), held).mapInArrow(batches, T.StructType(docs.schema.fields))
