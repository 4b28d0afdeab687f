import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldlark.llm import divergence, url_filter, whitening

# Urls


def brute_verdict(url, rules, words):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        *_, text, v = max(fits)
        return host, path, text, v, None
    word = next((w for w in re.findall("[a-z0-9]+", host) if w in words), None)
    return host, path, None, "block" if word else "allow", word


def judged(spark, urls, rules, words, **more):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumns({"host": F.lit("clash"), "rule": F.lit(1)})
    listed = spark.createDataFrame(rules, "host string, path string, verdict string").withColumn("text", F.lit("clash"))
    index = url_filter.build(listed, spark.createDataFrame([(w,) for w in words], "word string"))
    return {r.page_id: tuple(r)[1:] for r in url_filter.judge(df, index, **more).collect()}


def test_urls_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(11)
    part = lambda: rnd.choice(["a", "b", "cc", "spam", "x-bet", "É"])
    name = lambda: ".".join(part() for _ in range(rnd.randrange(1, 5)))
    where = lambda: "".join("/" + part() for _ in range(rnd.randrange(4))) + rnd.choice(["", "/"])
    rules = list({(h, p): (h, p, rnd.choice(["allow", "block"])) for h, p in ((name(), where()) for _ in range(300))}.values())
    urls = [f"{rnd.choice(['http://', 'HTTPS://', ''])}{name().upper() if k % 7 == 0 else name()}{where()}{rnd.choice(['', '?q=/a', '#://b'])}" for k in range(3000)]
    urls += [None, "", "://", "a://b://c/d", "http://" + "a." * 50_000 + "b/" + "cc/" * 50_000, "http://a\nb/cc", "mailto:x", *urls[:50]]
    monkeypatch.setattr(url_filter, "SHARD_BYTES", 2000)  # so that the list takes several files
    got = judged(spark, urls, rules + [(None, "/", "block"), ("a", None, "allow"), ("a", "b", "block"), ("a/b", "", "block"), ("b", "/", "?")], {"spam", "bet"})
    assert got == {i: brute_verdict(u, rules, {"spam", "bet"}) for i, u in enumerate(urls)}
    assert len({v[3] for v in got.values()}) == 2 and sum(v[2] is not None for v in got.values()) > 500


def test_urls_with_equal_rules_colliding_digests_and_empty_tables(spark, monkeypatch):
    rules = [("a.b", "/", "allow"), ("A.b", "/", "block"), ("b", "", "allow")]
    assert judged(spark, ["http://x.a.b/y", "http://b", "http://a.b"], rules, [None, ""]) == {0: ("x.a.b", "/y", "a.b/", "block", None), 1: ("b", "", "b", "allow", None), 2: ("a.b", "", "b", "allow", None)}
    assert judged(spark, [], rules, []) == {} and judged(spark, ["http://spam.c"], [], [])[0] == ("spam.c", "", None, "allow", None)
    assert judged(spark, ["http://spam.c"], [], ["Spam"])[0] == ("spam.c", "", None, "block", "spam")
    texts = ["", "a", "com/", "é" * 40, "#spam"]
    assert [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("h")).collect()] == list(map(url_filter.digest, texts))
    shard = object.__new__(url_filter._Mapped)
    shard.table, shard.keys = pa.table({"text": pa.chunked_array([["p", "q", "r"]]), "block": pa.chunked_array([[False, True, False]])}), np.array([5, 5, 9])
    assert shard.found(np.array([5, 5, 9, 7]), ["q", "other", "s", "r"]) == {0: True}  # equal digests, other strings
    with pytest.raises(ValueError, match="rule"):
        judged(spark, ["x"], rules, [], keep=("page_id", "rule"))


# Terms


def brute_audit(rows, least, top=10):
    docs = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or "")))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        kept = sorted(t for t, n in Counter(t for d in own for t in d[2]).items() if n >= least)
        counts = {s: sum((Counter({t: n for t, n in d[2].items() if t in set(kept)}) for d in own if d[1] == s), Counter()) for s in {d[1] for d in own}}
        p = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // (a + b)
        q, each = p(sum(counts.values(), Counter())), {s: p(c) for s, c in counts.items()}
        for s in counts:
            pairs = [(-sum(f(each[s][t], each[o][t]) for t in kept), o.encode(), "pair") for o in counts if o != s]
            terms = [(-f(each[s][t], q[t]), t.encode(), "term") for t in kept if counts[s][t] > 0 and each[s][t] > q[t]]
            for found in (sorted(pairs), sorted(terms)[:top]):
                out += [(lang, s, part, item.decode(), -x, i + 1) for i, (x, item, part) in enumerate(found)]
    return sorted(out)


def audited(spark, rows, **more):
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"n": F.lit("x"), "term": F.lit(1), "v": F.lit(None), "shard": F.lit(0)})
    return sorted(tuple(r) for r in divergence.audit(df.repartition(5), **more).select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergences_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(12)
    words = ["The", "the", "Äb", "äb", "x1y", "naïve", "z", "\x7f", "don't", "日本", "_a_", "w", *(f"t{chr(97 + k)}" for k in range(20))]
    rows = [(" ".join(rnd.choice(words) for _ in range(rnd.randrange(40))), rnd.choice(["en", "fr", None]), rnd.choice(["s1", "s2", "ß", None])) for _ in range(400)]
    rows += [(None, "en", "quiet"), ("", "lone", "only"), ("rare words here", "few", "a"), (None, "few", "b")] + rows[:30]
    assert audited(spark, rows) == brute_audit(rows, 10)
    monkeypatch.setattr(divergence, "CELLS", 7)  # many shards
    monkeypatch.setattr(divergence, "SPLIT", 64)  # slices and pieces of texts
    monkeypatch.setattr(divergence, "HELD", 50)
    rows.append(("über " * 2000 + "x" * 3000 + " the" * 500, "en", "long"))
    # Functions in a worker read the module anew, so the pieces are tested here.
    tables = pa.concat_tables([divergence._by_document(pa.array([t], pa.large_string())) for t in (rows[-1][0], "a" * 500)])
    assert Counter(dict(zip(tables["term"].to_pylist(), tables["n"].to_pylist(), strict=True))) == Counter({"über": 2000, "x" * 3000: 1, "the": 500, "a" * 500: 1})
    assert audited(spark, rows, least=3) == brute_audit(rows, 3)


def test_divergences_of_no_rows_and_of_large_counts(spark):
    assert audited(spark, []) == []
    n, total = np.array([3 * 10**14, 2]), np.array([9 * 10**14, 7])
    assert divergence._share(n, total).tolist() == [1 + 10**9 * int(a) // int(b) for a, b in zip(n, total, strict=True)]


# Vectors


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({"n": F.lit("x"), "component": F.lit(0)})


def brute_white(rows):
    rows = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(np.array([v for _, v in rows], np.float64) * 64).astype(np.int64) + 1_000_000
    s = x.sum(axis=0)
    z = (x - 1_000_000) - (s - len(x) * 1_000_000) / len(x)
    e, w = np.linalg.eigh(z.T @ z / len(x))
    return [i for i, _ in rows], len(x), ((len(x) * x - s) ** 2).sum(axis=1), e[::-1], z @ w[:, ::-1]


def test_whitening_equals_numpy(spark):
    rnd = np.random.default_rng(13)
    rows = [(i, (rnd.standard_normal(40) * np.linspace(0.5, 5, 40)).astype(np.float32).tolist(), 0) for i in range(500)]
    odd = [(900, None, 1), (901, [float("nan")] * 40, 1), (902, [None] + [0.0] * 39, 1), (903, [float("inf")] + [0.0] * 39, None), (904, [], 1), (905, [1.0] * 39, 1), (906, [1e30] * 40, 1), (None, [0.25] * 40, None), rows[3]]
    df = vectors(spark, rows + odd).repartition(7)
    model = whitening.fit(df)
    got = whitening.whiten(df, model).toPandas()
    ids, n, deviation, e, z = brute_white([(i, v) for i, v, _ in rows] + [(None, [0.25] * 40), (3, rows[3][1])])
    assert len(got) == 32 * n == 32 * 502 and set(got.n) == {n} and got.identity_error.max() < 1e-9
    assert np.abs(model.values / e[:32] - 1).max() < 1e-12
    assert np.abs(got.groupby("component").explained.first().to_numpy() / (e[:32] / e.sum()) - 1).max() < 1e-9
    once = {i: (d, w) for i, d, w in zip(ids, deviation, z[:, :32] / np.sqrt(e[:32]), strict=True)}
    for i, part in got.sort_values("component").drop_duplicates(["vec_id", "component"]).groupby("vec_id", dropna=False):
        d, w = once[None if np.isnan(i) else i]
        assert set(part.deviation) == {d} and np.abs(np.abs(part.whitened) - np.abs(w)).max() < 1e-8
    signs = np.sign(got[got.vec_id == 5].sort_values("component").whitened.to_numpy() * once[5][1])
    other = np.sign(got[got.vec_id == 6].sort_values("component").whitened.to_numpy() * once[6][1])
    assert (signs == other).all()


def test_whitening_of_odd_tables(spark):
    for rows in ([], [(1, None, 0)], [(1, [0.5, 0.25], 0)] * 9, [(1, [], 0)]):
        df = vectors(spark, rows)
        assert whitening.whiten(df, whitening.fit(df)).count() == 0
    flat = [(i, [float(i % 7), 2.0 * (i % 7), 1.0], 0) for i in range(70)]
    df = vectors(spark, flat, "double")
    model = whitening.fit(df)
    assert len(model.values) == 1 and whitening.whiten(df, model).count() == 70 and model.error < 1e-9  # one direction alone varies
    large = [(i, [2.0**40 * (i % 5), -(2.0**30) * (i % 3)], 0) for i in range(2000)]
    df = vectors(spark, large, "double")
    model = whitening.fit(df)
    got = whitening.whiten(df, model).where("component = 1").toPandas().set_index("vec_id")
    assert list(model.sums) == [sum(int(64 * v[k]) + 1_000_000 for _, v, _ in large) for k in range(2)] and model.error < 1e-6
    assert got.deviation.isna().all()  # no long holds it


def test_spectrum_slicing(spark):
    rnd = np.random.default_rng(14)
    q = np.linalg.qr(rnd.standard_normal((30, 30)))[0]
    for spectrum in ([5, 5, 5, 3, 3, 1], [5, 5 - 1e-9, 5 - 2e-9, 3, 1 + 1e-12, 1, *[0.5] * 23], [1] * 30, [1e6, 1, 1e-3], []):
        want = np.array([*spectrum, *[0] * (30 - len(spectrum))], float)
        m = q * want @ q.T
        m = (m + m.T) / 2
        e, v = whitening.leading(m, 20)
        assert len(e) == min(20, len(spectrum)) and (np.diff(e) <= 1e-9).all()
        assert np.abs(e - want[: len(e)]).max(initial=0) < 1e-9 and np.abs(v.T @ v - np.eye(len(e))).max(initial=0) < 1e-12 and np.abs(m @ v - v * e).max(initial=0) < 1e-9
        for x in (-1.0, 0.7, 2.0, 4.0):
            assert whitening.inertia(m, x)[::2] == (int((want > x).sum()), int((want < x).sum()))
    assert whitening.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == (1, 0, 1)
