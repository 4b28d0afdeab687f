"""MinHash near-duplicates by an inverted join on signature coordinates.

Texts with the same words fall together first. Of the rest, each signature is posted under its (coordinate,
value) pairs. A partner must share ``least`` of the pairs, so a text that shares fewer with anybody is done,
and otherwise it is posted only under its rarest shared pairs, as many as leave ``least - 1`` out (prefix).
Long posting lists are not multiplied out: each list's most central text is compared with the whole list, first
by signature and then by set; what that links is one component, and lists that hold one component only are
skipped (skip). Of a list that is still open, the rows outside its largest component are compared with all its
rows, in blocks of bounded size. Where even those rows are many, the texts of the list are posted anew under
the rarest shingles that a partner must share one of, which texts with a passage in common and nothing else do
not. Pairs at or above ``least`` are confirmed on the full sets, and only links that join components come out.

Defined results: null texts and texts without words have an empty set and are linked with nothing; a text with
fewer words than a shingle is one shingle. Of a component the smallest key stays. Equal texts are one class,
however many; repeated rows of one key are judged each by its own text. Rows with a null key are linked with
nothing. Keys are of any type that has an order. Only key and text are read, so other columns do not matter.
``least`` misses a pair at exactly the threshold with odds of 3e-5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlark.llm.common import components, joined_groups, release, stash, with_groups
from fieldlark.llm.textkernel import SPACED, _powers, mixed, shingles, slices, words

COORDINATES, LEAST = 64, 38
#: Keys that are broadcast at most; beyond, the join shuffles.
KEYS = 500_000
#: Rows, and hashes of their sets, that each side of a block of a posting list holds, about; rows of a block of signatures alone.
BLOCK_ROWS, BLOCK_HASHES, BLOCK_SIGNED = 512, 1 << 18, 2048
_STEP = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(hash of the row's words, its distinct shingles in order) of each row of a slice."""
    own = words(texts, SPACED)
    up, _ = _powers(int(np.diff(own.offset).max(initial=0)) + 1)
    all_shingles = shingles(own.hash, n).view(np.int64)
    for a, b in zip(own.offset[:-1].tolist(), own.offset[1:].tolist(), strict=True):
        if a == b:
            yield 0, np.empty(0, np.int64)
            continue
        line = mixed(np.array([(own.hash[a:b] * up[: b - a]).sum() + np.uint64(b - a)], np.uint64)).view(np.int64)
        found = line if b - a < n else np.sort(all_shingles[a : b - n + 1])
        if len(found) > 1:
            found = found[np.concatenate([[True], found[1:] != found[:-1]])]
        yield int(line[0]), found


def signatures(rows: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """A matrix of one signature a row, 31 bits a coordinate; no row may be empty."""
    size = np.array([len(r) for r in rows])
    begin = np.cumsum(size) - size
    flat = np.concatenate(rows).view(np.uint64)
    out = np.empty((len(rows), coordinates), np.int32)
    for j, step in enumerate(_STEP[:coordinates]):
        out[:, j] = np.minimum.reduceat(((flat * step) >> np.uint64(33)).astype(np.int32), begin)
    return out


def _sign(n: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, texts in slices(part.column(1)):
                found = list(sets(texts, n))
                filled = [i for i, (_, s) in enumerate(found) if len(s)]
                signed = signatures([found[i][1] for i in filled]) if filled else np.empty((0, COORDINATES), np.int32)
                ends = np.zeros(len(found) + 1, np.int32)
                ends[np.array(filled, np.int64) + 1] = COORDINATES
                made = pa.ListArray.from_arrays(np.cumsum(ends, dtype=np.int32), signed.ravel())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(first, len(texts)), pa.array([h for h, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64()), made], ["id", "line", "n_shingles", "signature"]
                )

    return batches


def _full(n: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for _, texts in slices(part.column(0)):
                lines, found = zip(*sets(texts, n), strict=True)
                ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.int64()), pa.ListArray.from_arrays(ends, np.concatenate(found))], ["id", "hashes"])

    return batches


class _Block:
    """The rows of a block: ``first`` ones, which are compared with the ``others``; ``prefix``, the lists each is in."""

    def __init__(self, group: pa.Table):
        self.here = group.column("key")[0].as_py()
        self.ids, self.whole, first = (group.column(c).to_numpy() for c in ("id", "component", "first"))
        self.prefix = group.column("prefix").to_pylist()
        self.among = [set(p) for p in self.prefix]
        self.signature = group.column("signature").combine_chunks().flatten().to_numpy().reshape(len(self.ids), -1)
        self.first, self.others = np.flatnonzero(first).tolist(), np.flatnonzero(~first)

    def alike(self, i: int, least: int) -> Iterator[int]:
        """Rows of other components that share ``least`` coordinates with row ``i`` and first meet it in this list."""
        others = self.others[self.whole[self.others] != self.whole[i]]
        others = others[(self.signature[others] == self.signature[i]).sum(axis=1) >= least]
        return (j for j in others.tolist() if next(k for k in self.prefix[i] if k in self.among[j]) == self.here)


def _likely(least: int):
    def block(group: pa.Table) -> pa.Table:
        """The rows of a block whose signature is close to another's."""
        rows = _Block(group)
        found: set[int] = set()
        for i in rows.first:
            if near := list(rows.alike(i, least)):
                found.update([i, *near])
        ids = rows.ids[sorted(found)]
        return pa.table({"id": pa.array(ids), "key": pa.array(np.full(len(ids), rows.here, np.int64))})

    return block


def _compare(least: int, share: int):
    def block(group: pa.Table) -> pa.Table:
        """The links of a block that join components, a forest."""
        rows = _Block(group)
        ids, whole = rows.ids, rows.whole
        full = group.column("hashes").combine_chunks()
        flat, ends = full.flatten().to_numpy(), full.offsets.to_numpy() - full.offsets[0].as_py()
        minor = {*ids[rows.first].tolist()}
        parent = {c: c for c in whole.tolist()}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        links = []
        for i in rows.first:
            for j in rows.alike(i, least):
                if root(int(whole[i])) == root(int(whole[j])) or (ids[j] < ids[i] and int(ids[j]) in minor):
                    continue
                a, b = flat[ends[i] : ends[i + 1]], flat[ends[j] : ends[j + 1]]
                both = len(np.intersect1d(a, b, assume_unique=True))
                if 100 * both >= share * (len(a) + len(b) - both):
                    parent[root(int(whole[i]))] = root(int(whole[j]))
                    links.append((int(ids[i]), int(ids[j])))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return block


def spread(key: Column, rows: int) -> Column:
    """A number in as many as the square root of ``rows`` that depends on ``key``."""
    return F.pmod(F.xxhash64(F.lit("spread"), key), F.lit(max(1, int(rows**0.5)))).cast("int")


def both_ends(pairs: DataFrame, values: DataFrame, end: str, name: str) -> DataFrame:
    """``pairs`` (id, ``end``, bucket) with ``name`` of both as own and other, from ``values`` (id, name).

    Many pairs may have one ``end``: its value is sent once a bucket, not once a pair, and its pairs go to as many tasks.
    """
    ends = pairs.select(end, "bucket").distinct().join(values.select(F.col("id").alias(end), F.col(name).alias("other")), end)
    return pairs.join(values.select("id", F.col(name).alias("own")), "id").join(ends, [end, "bucket"])


def _open(lists: DataFrame) -> DataFrame:
    """Of each list that holds several components: its rows (n), its largest component (major), and the others' rows and hashes."""
    cells = lists.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    held = cells.groupBy("key").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max_by(F.struct("component", "n", "size"), F.struct("n", "component")).alias("m"))
    return held.where(F.col("n") > F.col("m.n")).select("key", "n", "size", F.col("m.component").alias("major"), (F.col("n") - F.col("m.n")).alias("minor"), (F.col("size") - F.col("m.size")).alias("minor_size"))


def _paired(lists: DataFrame, open_: DataFrame, placed: DataFrame, values: DataFrame, rows: int, size: int | None):
    """The blocks (key, x, y) of open lists, with ``values`` of each row: the rows outside the largest component against all."""
    chunks = lambda n, of: F.greatest(F.ceil(F.col(n) / rows), *([F.ceil(F.col(of) / size)] if size else []), F.lit(1)).cast("int")
    open_ = stash(open_.select("key", "n", "major", chunks("minor", "minor_size").alias("few"), chunks("n", "size").alias("all")))
    met = joined_groups(lists.select("id", "key"), open_, ["key"]).join(placed, "id").join(values, "id")
    own = lambda parts: F.pmod(F.xxhash64("id"), F.col(parts)).cast("int")
    upto = lambda parts: F.sequence(F.lit(0), F.col(parts) - 1)
    columns = ["id", "component", "prefix", *values.columns[1:], "key"]
    each = met.select(*columns, own("all").alias("y"), F.explode(upto("few")).alias("x"), F.lit(False).alias("first"))
    few = met.where(F.col("component") != F.col("major")).select(*columns, own("few").alias("x"), F.explode(upto("all")).alias("y"), F.lit(True).alias("first"))
    return each.unionByName(few).groupBy("key", "x", "y"), open_


def _blocks(lists: DataFrame, open_: DataFrame, placed: DataFrame, signatures: DataFrame, hashes: DataFrame, least: int, share: int) -> tuple[DataFrame, list[DataFrame]]:
    """(links between the rows of open lists that join components, tables to release after).

    Signatures alone are compared first; then the rows that are close to another's go into blocks of their own, with their sets.
    """
    signed, held = _paired(lists, open_, placed, signatures, BLOCK_SIGNED, None)
    likely = stash(signed.applyInArrow(_likely(least), "id long, key long").distinct())
    release(held)
    again = likely.join(placed.select("id", "component", "size"), "id")
    full, held = _paired(again, _open(again), placed, signatures.join(hashes, "id"), BLOCK_ROWS, BLOCK_HASHES)
    return full.applyInArrow(_compare(least, share), "a long, b long"), [likely, held]


def link_lists(prefixes: DataFrame, signatures: DataFrame, hashes: DataFrame, least: int, share: int) -> DataFrame:
    """Components (node, component) of the ids whose sets are similar, among ids that meet in a posting list.

    ``prefixes``: id, prefix (the ids' lists in one global order) and centrality; ``signatures``: id, signature;
    ``hashes``: id, hashes (its set, in order).
    """
    lists = prefixes.select("id", "centrality", F.explode("prefix").alias("key"))
    central, groups = with_groups(lists, ["key"], F.max_by("id", F.struct("centrality", F.bitwise_not("id"))).alias("centre"))
    rows = groups.agg(F.sum("n")).first()[0] or 0
    pairs = stash(central.where("id <> centre").select("id", "centre", spread(F.col("id"), rows).alias("bucket")).distinct())
    alike = F.size(F.filter(F.zip_with("own", "other", lambda x, y: x == y), lambda same: same))
    near = stash(both_ends(pairs, signatures, "centre", "signature").where(alike >= least).select("id", "centre", "bucket"))
    sized = both_ends(near, hashes, "centre", "hashes").select("id", "centre", F.size(F.array_intersect("own", "other")).alias("both"), (F.size("own") + F.size("other")).alias("total"))
    links = stash(sized.where(100 * F.col("both") >= share * (F.col("total") - F.col("both"))).select(F.col("id").alias("a"), F.col("centre").alias("b")))
    release(groups, pairs, near)

    joined = components(links)
    placed = prefixes.select("id", "prefix").join(joined.withColumnRenamed("node", "id"), "id", "left").join(hashes.select("id", F.size("hashes").alias("size")), "id")
    placed = stash(placed.select("id", "prefix", "size", F.coalesce("component", "id").alias("component")))
    lists = placed.select("id", "component", "size", F.explode("prefix").alias("key"))
    open_ = stash(_open(lists))
    more, held = _blocks(lists, open_.where(F.col("minor") <= BLOCK_ROWS), placed, signatures, hashes, least, share)
    more = links.unionByName(more)
    if not open_.where(F.col("minor") > BLOCK_ROWS).isEmpty():
        rest, also = _by_shingles(lists, open_.where(F.col("minor") > BLOCK_ROWS), placed, signatures, hashes, least, share)
        more, held = more.unionByName(rest), held + also
    more = stash(more)
    release(links, placed, open_, *held)
    out = components(more)
    release(more)
    return out


def _by_shingles(lists: DataFrame, heavy: DataFrame, placed: DataFrame, signatures: DataFrame, hashes: DataFrame, least: int, share: int) -> tuple[DataFrame, list[DataFrame]]:
    """As ``_blocks``: links among the texts of heavy lists, posted under the shingles of which similar sets must share one.

    Similar sets have ``share`` % of the larger in common, so each is posted under all but that many of its
    shingles less one, the rarest; those that no other text has find nobody and are left out.
    """
    heavy = stash(heavy.select("key", "n"))
    ids = stash(joined_groups(lists.select("id", "key"), heavy, ["key"]).select("id").distinct())
    few = F.broadcast(ids) if ids.count() <= KEYS else ids
    posted = hashes.join(few, "id", "left_semi").select("id", F.size("hashes").alias("size"), F.explode("hashes").alias("key"))
    shared, groups = with_groups(posted, ["key"])
    keys = shared.groupBy("id").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys"))
    length = F.size("keys") - F.ceil(F.col("size") * (share / 100) - 1e-9).cast("int") + 1
    again = keys.where(length > 0).select("id", F.transform(F.slice("keys", F.lit(1), length), lambda k: k["key"]).alias("prefix"))
    again = stash(again.join(placed.drop("prefix"), "id"))
    lists = again.select("id", "component", "size", F.explode("prefix").alias("key"))
    release(heavy, ids, groups)
    links, held = _blocks(lists, _open(lists), again, signatures, hashes, least, share)
    return links, [again, *held]


def _classes(docs: DataFrame, key: str, text: str, n: int, share: int, least: int) -> DataFrame:
    """(id, line, n_shingles, component, component_id) of every row; ``line`` is a hash of its words."""
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = source.schema["id"].dataType
    made = T.StructType([T.StructField("id", kind), T.StructField("line", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("signature", T.ArrayType(T.IntegerType()))])
    signed = stash(source.mapInArrow(_sign(n), made))
    rows = stash(signed.select("id", "line", "n_shingles"))
    usable = (F.col("n_shingles") > 0) & F.col("id").isNotNull()
    lines = stash(signed.where(usable).groupBy(F.col("line").alias("id")).agg(F.count("*").alias("n"), F.min("id").alias("doc"), F.min_by("signature", "id").alias("signature")))
    release(signed)
    posted = lines.select("id", F.posexplode("signature").alias("i", "v")).select("id", (F.shiftleft(F.col("i").cast("long"), 32) + F.col("v")).alias("key"))
    met, frequent = with_groups(posted, ["key"])
    shared = met.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys")).where(F.size("keys") >= least)
    first = F.slice("keys", F.lit(1), F.size("keys") - (least - 1))
    prefixes = stash(shared.select("id", F.transform(first, lambda k: k["key"]).alias("prefix"), F.aggregate("keys", F.lit(0).cast("long"), lambda t, k: t + k["n"]).alias("centrality")))
    release(frequent)
    wanted = stash(prefixes.select("id").join(lines.select("id", "doc"), "id"))
    small = F.broadcast if wanted.count() <= KEYS else (lambda df: df)
    texts = source.join(small(wanted.select(F.col("doc").alias("id")).distinct()), "id", "left_semi").select("text")
    hashes = texts.mapInArrow(_full(n), "id long, hashes array<long>").join(small(wanted.select("id")), "id", "left_semi")
    hashes = stash(hashes.groupBy("id").agg(F.first("hashes").alias("hashes")))

    joined = link_lists(prefixes, lines.select("id", "signature"), hashes, least, share)
    release(prefixes, wanted, hashes)
    linked, groups = with_groups(lines.select("id", "doc").join(joined.withColumnRenamed("node", "id"), "id"), ["component"], F.min("doc").alias("component_id"))
    named = lines.select("id", "n", "doc").join(linked.select("id", "component", "component_id"), "id", "left")
    named = stash(named.select(F.col("id").alias("line"), "n", F.coalesce("component", "id").alias("component"), F.coalesce("component_id", "doc").alias("component_id")))
    release(lines, groups)
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("*", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id"))
    return joined_groups(rows.where(usable), named, ["line"]).drop("n").unionByName(alone)


def cluster(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, share: int = 80, least: int = LEAST) -> DataFrame:
    """(key, n_shingles, component_id, kept) of every row: pairs of sets with 100 * intersection >= share * union are linked.

    ``least`` is the number of coordinates out of COORDINATES that a pair must share to be looked at.
    """
    out = _classes(docs, key, text, n, share, least).select(F.col("id").alias(key), "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def survivors(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, share: int = 80, least: int = LEAST) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component one row stays, with the smallest key.

    Where rows share that key, the one stays whose words' hash, text and other columns come first. Rows
    without words and rows with a null key all stay.
    """
    found = stash(_classes(docs, key, text, n, share, least))
    stays = stash(found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("id", "line")).alias("s")).select("s.*"))
    keys = found.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n"), F.count("component").alias("linked"))
    gone = keys.where("n = linked").join(stays.select("id").distinct(), "id", "left_anti").select("id")
    repeated = stash(keys.where("n > 1").select("id").join(gone, "id", "left_anti"))
    gone = stash(gone)
    small = lambda df, rows: F.broadcast(df) if rows <= KEYS else df
    names = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.join(small(gone, gone.count()).withColumnRenamed("id", key), key, "left_anti").select(*names)
    if many := repeated.count():
        again = small(repeated, many).withColumnRenamed("id", key)
        rows = out.join(again, key, "left_semi").select(F.struct(*names).alias("row"))
        made = T.StructType([*rows.schema.fields, T.StructField("line", T.LongType()), T.StructField("n_shingles", T.LongType())])
        hashed = rows.select("row", F.col(f"row.`{text}`").alias("text")).mapInArrow(_lines(n), made)
        own = hashed.select("row", "line", "n_shingles", F.col(f"row.`{key}`").alias("id"))
        first = own.where("n_shingles > 0").join(stays, ["id", "line"]).groupBy("id", "line").agg(F.min_by("row", F.struct(F.col(f"row.`{text}`"), F.to_json("row"))).alias("row"))
        out = out.join(again, key, "left_anti").select(*names).unionByName(first.select("row.*")).unionByName(own.where("n_shingles = 0").select("row.*"))
    return out


def _lines(n: int):
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, texts in slices(part.column(1)):
                found = list(sets(texts, n))
                yield pa.RecordBatch.from_arrays([part.column(0).slice(first, len(texts)), pa.array([h for h, _ in found], pa.int64()), pa.array([len(s) for _, s in found], pa.int64())], ["row", "line", "n_shingles"])

    return batches
