"""URL filters: rules and banned words as a sorted array of 64-bit digests that each executor memory-maps.

``build`` sorts the list by digest on Spark and writes it to the shared folder in files of about SHARD_BYTES; every
executor fetches the files with ``SparkContext.addFile``, turns each into an Arrow file once, and its workers map that
one copy: a list larger than a worker's memory costs no memory, and nothing of it passes through the driver. ``judge``
hashes each url's candidates, probes the mapped arrays with a vectorised binary search, and compares the stored strings
of every digest that is met, so that a collision decides nothing.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlark.llm.common import release, stash

#: Bytes of list entries in a file, about; the seed of Spark's xxhash64; what begins a word's text, and no rule's that fits.
SHARD_BYTES, SEED, WORD = 64 << 20, 42, "#"
#: Words that block a host no rule fits; fixed values.
WORDS = ("adult", "bet", "casino", "escort", "gambling", "hentai", "jackpot", "malware", "nude", "phishing", "pills", "poker", "porn", "sex", "spam", "torrent", "viagra", "warez", "webcam", "xxx")

_URL = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` and for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


@dataclass(frozen=True)
class Index:
    """The names of a list's files, the lengths of its rules' paths by that of their hosts, and whether it has words."""

    files: tuple[str, ...]
    lengths: dict[int, tuple[int, ...]]
    words: bool


def build(rules: DataFrame, words: DataFrame | None = None) -> Index:
    """The digest array of ``rules`` (host, path, verdict) and of banned ``words`` (word).

    A rule's text is its host, A-Z lower-cased, and its path; of rules with one text, block wins. Rules that fit no url
    (a null, ``/?#`` in the host, a path that does not start with ``/`` or has ``?#``), those with a verdict other than
    allow and block, and null or empty words are left out. Other columns are not read. The driver gets the
    different pairs of lengths alone. An empty list is a list without files.
    """
    text = F.concat(F.translate("host", UPPER, LOWER), F.col("path"))
    known = rules.where(r"host NOT RLIKE '[/?#]' AND path RLIKE '^(/[^?#]*)?$' AND verdict IN ('allow', 'block')")
    listed = known.groupBy(text.alias("text"), F.length("host").alias("h"), F.length("path").alias("p")).agg(F.max(F.col("verdict") == "block").alias("block"))
    if words is not None:
        word = F.concat(F.lit(WORD), F.translate("word", UPPER, LOWER))
        listed = listed.unionByName(words.where("word <> ''").select(word.alias("text"), F.lit(True).alias("block")).distinct(), allowMissingColumns=True)
    listed = stash(listed.withColumn("key", F.xxhash64("text")))
    lengths: dict[int, list[int]] = {}
    for h, p in listed.select("h", "p").where("h IS NOT NULL").distinct().sort("h", "p").collect():  # lengths of names and paths, not rules
        lengths.setdefault(h, []).append(p)
    size = listed.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    files = stash(listed.select("key", "text", "block").repartitionByRange(1 + size // SHARD_BYTES, "key", "text").sortWithinPartitions("key", "text"))
    out = Index(tuple(_shared(files)) if size else (), {h: tuple(p) for h, p in lengths.items()}, not listed.where("h IS NULL").isEmpty())
    release(listed)
    return out


def _shared(written: DataFrame) -> Iterator[str]:
    """The names under which executors fetch the files of a stashed table."""
    sc = written.sparkSession.sparkContext
    for file in written.inputFiles():
        sc.addFile(unquote(file))
        yield os.path.basename(file)


class _Mapped:
    """One file of the list: the sorted digests, a view of the mapped file, with their strings and verdicts."""

    def __init__(self, name: str):
        fetched = SparkFiles.get(name)
        arrow = f"{fetched}.arrow"
        if not os.path.exists(arrow):  # the executor's first worker to come here makes it for all
            table = pq.read_table(fetched, columns=["key", "text", "block"]).combine_chunks()
            own = f"{arrow}-{uuid.uuid4().hex}"
            with pa.OSFile(own, "wb") as f, pa.ipc.new_file(f, table.schema) as out:
                out.write_table(table)
            os.replace(own, arrow)
        self.table = pa.ipc.open_file(pa.memory_map(arrow)).read_all()
        self.keys = self.table["key"].chunk(0).to_numpy(zero_copy_only=True) if len(self.table) else np.zeros(0, np.int64)

    def found(self, digests: np.ndarray, texts: list[str]) -> dict[int, bool]:
        """Places of ``texts`` that the file holds, with block or not."""
        first, last = np.searchsorted(self.keys, digests, "left"), np.searchsorted(self.keys, digests, "right")
        out = {}
        for k in np.flatnonzero(first < last):
            for at in range(first[k], last[k]):  # one, but for collisions
                if self.table["text"][at].as_py() == texts[k]:
                    out[int(k)] = self.table["block"][at].as_py()
        return out


def digest(text: str) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), SEED)
    return h - (1 << 64) if h >> 63 else h


def _candidates(name: str, where: str, index: Index) -> list[str]:
    """Texts of rules that would fit, of lengths that the list has, and the host's words."""
    ends = (n for n in (len(name), *(len(name) - m.end() for m in re.finditer(r"\.", name))) if n in index.lengths)
    fit = [name[len(name) - n :] + where[:p] for n in ends for p in index.lengths[n] if p <= len(where)]
    return fit + ([WORD + w for w in re.split(r"[^a-z0-9]+", name) if w] if index.words else [])


def judge(pages: DataFrame, index: Index, url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(``keep``, host, path, rule, verdict, word) of each row, repeated ones included.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest text wins, of
    equally long ones that of the longer host. Where none fits, the verdict is block if a part of the host between characters
    other than a-z and 0-9 is a banned word (``word``, the first), else allow. A null url, or one without ``://``, has
    an empty host and path; only a rule of an empty host fits it. Urls of any length are read whole. Columns beside
    ``keep`` are not read; ``keep`` must not hold a name of a result. An empty table gives no rows.
    """
    if clash := {"host", "path", "rule", "verdict", "word"} & {k.lower() for k in keep}:
        raise ValueError(f"keep holds names of results: {sorted(clash)}")
    column = lambda c: F.col(f"`{c}`")
    read = pages.select(*(column(k).alias(k) for k in keep), host(column(url)).alias("host"), path(column(url)).alias("path"))
    kept = len(keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema.fields), "rule string", "verdict string", "word string"])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [_Mapped(f) for f in index.files]
        for whole in parts:
            for at in range(0, whole.num_rows, 2048):
                part = whole.slice(at, 2048)
                each = [_candidates(h, p, index) for h, p in zip(part.column(kept).to_pylist(), part.column(kept + 1).to_pylist(), strict=True)]
                texts = list(dict.fromkeys(t for c in each for t in c))
                digests = np.fromiter((digest(t) for t in texts), np.int64, len(texts))
                known: dict[str, bool] = {}
                for s in shards:
                    known |= {texts[k]: block for k, block in s.found(digests, texts).items()}
                rules, verdicts, words = [], [], []
                for c in each:
                    fits = [t for t in c if t in known]
                    rule = max((t for t in fits if not t.startswith(WORD)), key=len, default=None)
                    word = next((t for t in fits if t.startswith(WORD)), None) if rule is None else None
                    rules.append(rule)
                    verdicts.append("block" if (known[rule] if rule is not None else word) else "allow")
                    words.append(word and word[len(WORD) :])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rules, pa.string()), pa.array(verdicts, pa.string()), pa.array(words, pa.string())], [*part.schema.names, "rule", "verdict", "word"])

    return read.mapInArrow(batches, schema)
