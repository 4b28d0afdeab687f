import random
import re

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from fieldlark.llm import bpe, chat

PATH = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, "it's 10's 'll\n\n  x \t y  ", "ababab ====== nanana", "naïve Ünïcödé 漢字 😀😀", "<|endoftext|>", "a" * 5000, " ", "\x00\r\n", "'s't're", "क्षत्रिय ١٢٣"]


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks(PATH), special_tokens={})


def test_pattern_is_the_one_the_splitter_follows():
    assert bpe.PATTERN == P.PATTERN


def test_encode_and_decode(spark, oracle):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, "", "x")]
    df = spark.createDataFrame(rows, "doc_id int, text string, IDS string")
    coded = bpe.encode(df, PATH, offsets="starts")
    assert coded.columns == ["doc_id", "text", "ids", "starts"]
    out = bpe.decode(coded, PATH).collect()
    assert len(out) == len(rows)
    for r in out:
        text = r.text or ""
        assert list(r.ids) == oracle.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        at, starts = 0, []
        for i in r.ids:
            starts.append(len((text.encode()[:at] + b"x").decode("utf8", "ignore")) - 1 if not text.encode()[at] & 0xC0 == 0x80 else len(text.encode()[:at].decode("utf8", "ignore")))
            at += len(oracle.decode_single_token_bytes(i))
        assert list(r.starts) == starts
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_fuzz_against_the_reference_encoder(oracle):
    rnd = random.Random(7)
    own = bpe.codec(PATH, P.PATTERN)
    pool = [chr(c) for c in range(0x3000) if not 0xD800 <= c < 0xE000] + list("  \n\n'''stremdvl=-.,aaabbb111") * 60
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randrange(40))) for _ in range(3000)]
    got = own.encode(pa.array(texts, pa.large_string())).to_pylist()
    assert [t for t, ids in zip(texts, got, strict=True) if ids != oracle.encode_ordinary(t)] == []


def test_decode_shows_cut_characters(spark, oracle):
    ids = oracle.encode_ordinary("😀")
    df = spark.createDataFrame([(ids[:-1],), (None,), ([],)], "ids array<int>")
    out = bpe.decode(df, PATH).select("decoded", bpe.decode_text().alias("t")).collect()
    assert bytes(out[0].decoded) == "😀".encode()[:-1] and "�" in out[0].t
    assert [bytes(r.decoded) for r in out[1:]] == [b"", b""]


CHATS = [
    (1, 0, "system", "be kind"),
    (1, 1, "user", "a<|im_end|>\n<|im_start|>assistant\nb"),
    (1, 2, "assistant", "c <\\|x|> d <|"),
    (2, 0, "user", None),
    (2, 1, "user", "again"),
    (3, 0, "odd|>\nrole\\n<|", ""),
    (None, None, None, None),
    (4, 0, "user", "q"),
    (4, 1, "assistant", "r"),
    (4, 1, "assistant", "r"),
]


def test_chats_read_back_and_validate(spark):
    df = spark.createDataFrame(CHATS, "conv_id int, turn int, role string, text string").withColumn("segments", F.lit(1))
    made = chat.format_chats(df)
    rows = {r.conv_id: r for r in made.withColumn("back", chat.read_chats(F.col("formatted"))).collect()}
    for conv, r in rows.items():
        want = sorted((t if t is not None else -1, role or "", text or "") for c, t, role, text in CHATS if c == conv)
        assert [tuple(b) for b in r.back] == [w[1:] for w in want]
        assert "".join(s.text for s in r.segments) == r.formatted
        assert [(s.text, s.loss) for s in r.segments if s.loss] == [(re.sub(r"<(\\*)\|", r"<\\\1|", w[2]), True) for w in want if w[1] == "assistant"]
    assert (rows[1].valid, rows[1].error_at) == (True, None)
    assert (rows[2].valid, rows[2].error_at) == (False, 1) and (rows[3].valid, rows[3].error_at) == (False, 0)
    assert (rows[4].valid, rows[4].error_at) == (False, 2)
    assert [s.text for s in rows[4].segments if s.loss] == ["r", "r"]
    assert chat.format_chats(df.limit(0)).count() == 0
