"""Language identification by compression with zstandard and one raw-content dictionary per language.

A text is reduced to lower-case letters and single blanks, and compressed with each language's dictionary; the
dictionary that leaves the fewest bytes names the language. The score is the margin to the runner-up as a
share of the runner-up's size; below ``reject`` the operator's own verdict is null.

Learned is a bounded sample: of each of at most LANGUAGES languages, the most frequent ones, about TEXTS texts
chosen by a hash of the key among those that fill at most an eighth of a dictionary, whole ones in the order of
that hash until the dictionary's DICTIONARY bytes are full.

Defined results: a null text, or one without letters (Unicode category L), is ``und`` with score 0. Ties are compressed
anew at the highest level, and then go to the language with more labelled texts. Very long texts are compressed whole
in linear time. With no labelled text at all every text is ``und``. Repeated rows are scored alike; other
columns pass through, and columns named like an output are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled texts a language is learned from, about; bytes of a dictionary, and of all together; compression level.
TEXTS, DICTIONARY, ALL, LEVEL = 400, 1 << 18, 64 << 20, 6
UNKNOWN = "und"


NOT_LETTERS = re.compile(r"[\W\d_]+")


@lru_cache(maxsize=1)
def numbers() -> frozenset[str]:
    """What ``\\w`` takes for a letter and is a number, such as superscripts."""
    return frozenset(c for c in map(chr, range(0x80, 0x110000)) if c.isalnum() and not c.isalpha())


def letters(text: str | None) -> bytes:
    if not text:
        return b""
    if not text.isascii() and not numbers().isdisjoint(text):
        text = text.translate(dict.fromkeys(map(ord, numbers().intersection(text)), " "))
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode()


def chance(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(1 << 30)) / float(1 << 30)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", texts: int = TEXTS, size: int = DICTIONARY) -> dict[str, bytes]:
    """A dictionary per language, from about ``texts`` of its rows: at most ``texts`` times an eighth of ``size`` bytes a language reach the driver, one text at a time.

    Every language that has a text gets one; of more than ALL / ``size`` languages each is smaller, so that all together stay within ALL. A long text
    is learned from by its first eighth of ``size`` characters, up to a space.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}  # one row a language
    if not counts:
        return {}
    size = min(size, ALL // len(counts))
    whole = F.col(text)
    learned = F.when(F.length(whole) <= size // 8, whole).otherwise(F.regexp_replace(F.substring(whole, 1, size // 8), r"\s\S*$", ""))
    share = F.element_at(F.create_map(*(F.lit(x) for name, n in counts.items() for x in (name, min(1.0, texts / n)))), F.col(lang))
    drawn = rows.where(chance(F.col(key)) < F.coalesce(share, F.lit(0.0))).select(F.col(lang).alias("_lang"), chance(F.col(key)).alias("_at"), learned.alias("_text"))
    out: dict[str, list[bytes]] = {name: [] for name in counts}
    held, met = dict.fromkeys(counts, 0), set()
    for name, _, whole in drawn.orderBy("_at", "_lang", "_text").toLocalIterator():
        raw = letters(whole)
        if raw and raw not in met and held[name] + len(raw) <= size:
            met.add(raw)
            out[name].append(raw)
            held[name] += len(raw) + 1
    return {name: b" ".join(found) for name, found in out.items() if found}


class Judge:
    def __init__(self, model: tuple[tuple[str, bytes], ...]):
        import zstandard as z

        self.names = [name for name, _ in model]
        self.by, self.hard = [[self.compressor(z, level, content) for _, content in model] for level in (LEVEL, 19)]

    @staticmethod
    def compressor(z, level: int, content: bytes):
        options = z.ZstdCompressionParameters.from_level(level, write_checksum=0, write_content_size=0, write_dict_id=0)
        d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=options)
        return z.ZstdCompressor(compression_params=options, dict_data=d).compress

    def __call__(self, text: str | None) -> tuple[str, float]:
        raw = letters(text)
        if not raw or not self.by:
            return UNKNOWN, 0.0
        sizes = [len(c(raw)) for c in self.by]
        if sizes.count(min(sizes)) > 1:
            sizes = [len(c(raw)) for c in self.hard]
        best = min(sizes)
        at = sizes.index(best)
        rest = min((s for i, s in enumerate(sizes) if i != at), default=len(raw) + best)
        return self.names[at], min(1.0, max(0.0, (rest - best) / rest))


@lru_cache(maxsize=2)
def judge(model: tuple[tuple[str, bytes], ...]) -> Judge:
    return Judge(model)


def identify(df: DataFrame, model: dict[str, bytes], text: str = "text", reject: float = 0.02) -> DataFrame:
    """Add ``lang_pred`` (the closest language), ``score`` (the margin) and ``lang_accepted`` (null below ``reject``)."""
    made = T.StructType([T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("lang_accepted", T.StringType())])
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in made.names}]
    schema = T.StructType([df.schema[c] for c in kept] + made.fields)
    packed = df.sparkSession.sparkContext.broadcast(tuple(model.items()))  # at most DICTIONARY bytes a language

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = judge(packed.value)
        for whole in parts:
            for first in range(0, whole.num_rows, 512):
                part = whole.slice(first, 512)
                said = [own(t.as_py()) for t in part.column(len(kept))]
                accepted = [name if score >= reject and name != UNKNOWN else None for name, score in said]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array([n for n, _ in said], pa.string()), pa.array([s for _, s in said], pa.float64()), pa.array(accepted, pa.string())], schema.names
                )

    return df.select(*(df[f"`{c}`"] for c in kept), F.col(text).alias("_text")).mapInArrow(batches, schema)
