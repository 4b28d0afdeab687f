"""Source divergence audit: how far each source's use of a language's terms is from the language's other sources.

Terms are counted by an Arrow compute pipeline in ``mapInArrow`` (ascii_lower, split_pattern_regex, dictionary_encode,
hash group_by), which yields partial counts; Spark merges them into (lang, source, term) counts, and columnar shards
of a language's terms, one table of sources by terms each, give partial divergences that are summed.
All arithmetic is on integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlark.llm.common import release, stash
from fieldlark.llm.textkernel import slices

#: What stands between terms: everything in ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that are split at once, rows of partial counts that a task holds before it hands them on, least cells of a shard.
SPLIT, HELD, CELLS = 2 << 20, 400_000, 50_000
#: Terms that are reported of each group, and what shares are counted in.
TOP, SCALE = 10, 1_000_000_000


def _tokens(texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(row, term) of every term of the texts, in order."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), BETWEEN)
    rows, terms = pc.list_parent_indices(parts), pc.list_flatten(parts)
    some = pc.not_equal(terms, "")
    return rows.filter(some), terms.filter(some)


def _pieces(text: str, size: int) -> Iterator[str]:
    """A long text cut into pieces of about ``size`` characters, none within a term."""
    at = 0
    while at < len(text):
        to = at + size
        while to < len(text) and (text[to] > "\x7f" or text[to].isalpha()):
            to += 1
        yield text[at:to]
        at = to


def _counted(texts: pa.Array) -> pa.Table:
    """(row, term, n): how often each term is in each text."""
    rows, terms = _tokens(texts)
    coded = terms.dictionary_encode()
    found = pa.table({"row": rows, "term": coded.indices}).group_by(["row", "term"]).aggregate([([], "count_all")]).rename_columns(["row", "term", "n"])
    return found.set_column(1, "term", coded.dictionary.take(found["term"].combine_chunks()))


def _by_document(texts: pa.Array) -> pa.Table:
    """As ``_counted``; a text that is longer than a slice in pieces, merged as they come."""
    if len(texts) > 1 or texts.nbytes <= 2 * SPLIT:
        return _counted(texts)
    held: list[pa.Table] = []
    for piece in _pieces(texts[0].as_py(), SPLIT):
        held.append(_counted(pa.array([piece], texts.type)))
        if len(held) > 8:
            held = [_summed(held, ["row", "term"], ["n"])]
    return _summed(held, ["row", "term"], ["n"])


def _summed(tables: list[pa.Table], keys: list[str], sums: list[str]) -> pa.Table:
    return pa.concat_tables(tables).group_by(keys).aggregate([(c, "sum") for c in sums]).rename_columns([*keys, *sums])


def _merged(tables: list[pa.Table]) -> pa.Table:
    return _summed(tables, ["lang", "source", "term"], ["n", "docs"])


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents that have it.

    A term is a run of letters and of characters beyond ASCII; only A-Z is lower-cased. Nulls count as empty strings, in
    each of the three columns. Each group also has a row of a null term, with the group's documents in docs and
    0 in n, so that groups without terms are seen. Repeated rows count as often as they are there. A task holds
    HELD counts at most before it hands them on; texts of any length are read whole, in pieces. No documents: no rows.
    """
    given = lambda c, n: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for part in parts:
            for first, texts in slices(part.column(0), SPLIT):
                groups = [part.column(k).slice(first, len(texts)).cast(pa.string()) for k in (1, 2)]
                found = _by_document(texts.cast(pa.large_string()))
                rows = found["row"].combine_chunks()
                ones = pa.array(np.ones(len(found), np.int64))
                held.append(pa.table({"lang": groups[0].take(rows), "source": groups[1].take(rows), "term": found["term"].cast(pa.string()), "n": found["n"].cast(pa.int64()), "docs": ones}))
                none = pa.nulls(len(texts), pa.string())
                held.append(pa.table({"lang": groups[0], "source": groups[1], "term": none, "n": pa.array(np.zeros(len(texts), np.int64)), "docs": pa.array(np.ones(len(texts), np.int64))}))
                if sum(map(len, held)) > HELD:
                    held = [_merged(held)]
                    if len(held[0]) > HELD // 2:
                        yield from held.pop().combine_chunks().to_batches(max_chunksize=65_536)
        if held:
            yield from _merged(held).combine_chunks().to_batches(max_chunksize=65_536)

    read = docs.select(given(text, "_t"), given(lang, "_l"), given(source, "_s"))
    partial = read.mapInArrow(batches, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * n / total) by long division, so that no product leaves 64 bits. ``total`` is below 2 ** 53."""
    out, rest = n // total, n % total
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return out + 1


_OUT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _shard(rows: pa.Table) -> pa.Table:
    """Partial divergences of one shard: rows (source, part, item, value) of a language.

    ``rows`` holds the language's groups (null term; n is N, v is V) and the shard's counts.
    """
    is_group = pc.is_null(rows["term"])
    groups, cells = rows.filter(is_group).sort_by("source"), rows.filter(pc.invert(is_group))
    lang, sources = groups["lang"][0].as_py(), groups["source"].combine_chunks()
    v = int(groups["v"][0].as_py())
    coded = cells["term"].combine_chunks().dictionary_encode()
    at_source = pc.index_in(cells["source"], sources).to_numpy()
    n = np.zeros((len(sources), len(coded.dictionary)), np.int64)
    n[at_source, coded.indices.to_numpy()] = cells["n"].to_numpy()
    totals = groups["n"].to_numpy().astype(np.int64)
    out: list[tuple] = []
    names, terms = sources.to_pylist(), coded.dictionary.to_pylist()
    if v:
        p = _share(n + 2, (totals + 2 * v)[:, None])
        q = _share(n.sum(axis=0) + 2, totals.sum() + 2 * v)
    for a, name in enumerate(names):
        values = ((p[a] - p) ** 2 // (p[a] + p)).sum(axis=1).tolist() if v else [0] * len(names)
        out += [(lang, name, "pair", names[b], values[b]) for b in range(len(names)) if b != a]
        if v:
            more = np.flatnonzero((n[a] > 0) & (p[a] > q))
            f = (p[a][more] - q[more]) ** 2 // (p[a][more] + q[more])
            best = sorted(zip((-f).tolist(), (terms[k].encode() for k in more), strict=True))[:TOP]
            out += [(lang, name, "term", t.decode(), -x) for x, t in best]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OUT.types, strict=True)], schema=_OUT) if out else _OUT.empty_table()


def audit(docs: DataFrame, least: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): divergences of each (lang, source) group.

    A language keeps the V terms that ``least`` of its documents have. A group, or the whole language, gives a kept term
    of n occurrences p = 1 + floor(1e9 * (n + 2) / (N + 2 V)), with N the sum of n over kept terms, and two of these differ
    by f = floor((p - q)^2 / (p + q)). Part ``pair`` has the sum of f over the kept terms for each other source
    of the language, 0 where it keeps none; part ``term`` has the TOP terms that the group uses more than the language does. Ranks
    from 1 by value, the largest first, equal ones in the byte order of the item. A language of one source has no pairs. Nulls count
    as empty strings. No documents: no rows. A shard has about as many cells (terms times sources) as the
    language has pairs of sources, CELLS at least, so that its partial sums are no more than what it reads.
    """
    found = stash(counts(docs, text, lang, source))
    kept = stash(found.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("docs").alias("d")).where(F.col("d") >= least).select("lang", "term"))
    cells = stash(found.join(kept, ["lang", "term"]).select("lang", "source", "term", "n"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = found.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = stash(groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v")))
    shards = stash(groups.groupBy("lang").agg(F.ceil(F.max("v") * F.count("*") / F.greatest(F.count("*") * F.count("*"), F.lit(CELLS))).cast("int").alias("k")).select("lang", F.greatest("k", F.lit(1)).alias("k")))
    meta = groups.join(shards, "lang").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    none = F.lit(None).cast("string")
    rows = meta.select("lang", "shard", "source", none.alias("term"), "n", "v").unionByName(
        cells.join(shards, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("k")).cast("int").alias("shard"), "source", "term", "n", F.lit(0).cast("long").alias("v"))
    )
    parts = rows.groupBy("lang", "shard").applyInArrow(_shard, "lang string, source string, part string, item string, value long")
    whole = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    out = stash(whole.withColumn("rank", F.row_number().over(order)).where(f"part = 'pair' OR rank <= {TOP}"))
    release(found, kept, cells, groups, shards)
    return out
