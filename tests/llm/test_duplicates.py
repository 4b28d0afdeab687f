import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from fieldlark.llm import decontaminate, near_dedup, sharding, substring_dedup
from fieldlark.llm.common import components, ordinal

lower = lambda t: re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
spaced = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t))


def corpus(n=120, seed=5):
    """Texts with exact and near copies at many distances."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 7)))
    texts = []
    for _ in range(n):
        if texts and rnd.random() < 0.6:
            w = rnd.choice(texts).split(" ")
            for _ in range(rnd.randrange(6)):
                w[rnd.randrange(len(w))] = word()
            texts.append(" ".join(w))
        else:
            texts.append(" ".join(word() for _ in range(rnd.randrange(1, 90))))
    return texts + [None, "", " \n", texts[0], texts[0].upper(), "a b", "A  b", "q " * 3000]


def test_components_and_ordinals(spark):
    edges = [(1, 2), (2, 3), (10, 11), (3, 3), (5, 4), (2, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 4: 4, 5: 4} | {100 + i: 100 for i in range(41)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    df = spark.range(50).selectExpr("id", "id % 2 AS k", "id % 7 AS w", "CAST(pmod(xxhash64(id), 3) AS INT) AS b")
    rows = ordinal(df, ["k"], ["id"], "at", "b", "w").collect()
    for k in (0, 1):
        total = 0
        for r in sorted((r for r in rows if r.k == k), key=lambda r: (r.b, r.id)):
            assert r.at == total
            total += r.w


def test_near_duplicates_equal_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i * 3, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, signature string")
    got = {r.doc_id // 3: r for r in near_dedup.cluster(df, n=4).collect()}
    sets = []
    for t in texts:
        w = spaced(t)
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    for i in range(len(texts)):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(sets[i]), root(i) * 3, root(i) == i)
    assert near_dedup.cluster(df.limit(0)).count() == 0


def test_blocks_of_long_lists_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    test_near_duplicates_equal_brute_force(spark)


def contamination(doc, items):
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, hit, found = alnum(doc), set(), set()
    for key, t in items:
        v = alnum(t)
        n = min(13, len(v))
        windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add(str(key))
    return len(w), len(hit), sorted(found)


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(6)
    word = lambda: rnd.choice("the of ab12 cd é-é x".split())
    items = [(i, " ".join(word() for _ in range(rnd.randrange(40)))) for i in range(12)] + [(20, None), (21, ""), (22, "zz"), (23, "zz")]
    docs = [" ".join(word() for _ in range(rnd.randrange(120))) + (f" {lower(rnd.choice(items)[1])} " if rnd.random() < 0.5 else "") for _ in range(60)]
    docs += [None, "", "zz", "Zz zz", items[3][1].upper(), "the " * 4000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, n_hit int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: contamination(t, items) for i, t in enumerate(docs)}
    for block in (decontaminate.BLOCK, 100):  # one pass, and many
        got = {r.doc_id: (r.n_words, r.n_hit, list(r.items)) for r in decontaminate.matches(df, bench, block=block).collect()}
        assert got == want
    kept = {r.doc_id for r in decontaminate.remove(df, bench).collect()}
    assert kept == {i for i, (n, h, _) in want.items() if not (h and 20 * h >= n)}
    assert decontaminate.remove(df, bench).columns == df.columns
    assert decontaminate.matches(df, bench.limit(0)).agg(F.sum("n_hit")).first()[0] == 0


def test_longest_match_and_place(spark):
    df = spark.createDataFrame([(1, "x y one two three four z")], "doc_id long, text string")
    r = decontaminate.matches(df, spark.createDataFrame([(1, "zero one two three four five")], "item_id long, text string"), window=3).first()
    assert (r.longest, r.longest_at, r.n_hit) == (4, 2, 4)


def test_longest_match_of_each_copy(spark):
    texts = ["x y one two three four z", "one two three four", "y two three four", "q q", "x one two three", "one two three x one two three four five"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.longest, r.longest_at) for r in decontaminate.matches(df, spark.createDataFrame([(1, "zero one two three four five")], "item_id long, text string"), window=3).collect()}
    assert got == {0: (4, 2), 1: (4, 0), 2: (3, 1), 3: (0, None), 4: (3, 1), 5: (5, 4)}


def shared(rows, n):
    own = defaultdict(set)
    for i, t in rows:
        w = spaced(t)
        for k in range(len(w) - n + 1):
            own[tuple(w[k : k + n])].add(i)
    return {w: s for w, s in own.items() if len(s) > 1}


def test_substrings_leave_one_copy(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    passage, line = say(55), say(60).split(" ")
    near = list(line)
    near[5], near[50] = "changed", "twice"
    texts = [f"{say(9)} {passage} {say(9)}\n{say(12)}" for _ in range(5)] + [" ".join(line), f"{say(9)}\n{' '.join(near)}"]
    texts += [say(70), f"{say(4)} short shared words {say(30)}", f"{say(4)} short shared words {say(30)}", None, "", f"é {passage} ü", say(40)]
    twice = say(56)
    texts.append(f"{twice}\n{twice}")  # repeats within itself alone
    rows = [(i, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    spans = substring_dedup.repeats(df)
    found = spans.collect()
    assert {r.doc_id for r in found if r.removed} == {1, 2, 3, 4, 6, 12} and {r.doc_id for r in found if not r.removed} == {0, 5}
    out = {r.doc_id: r.text for r in substring_dedup.remove(df, spans).collect()}
    assert shared(out.items(), 50) == {} and len(out) == len(rows)
    untouched = [i for i in range(len(texts)) if i not in (1, 2, 3, 4, 6, 12)]
    assert [out[i] for i in untouched] == [texts[i] for i in untouched]
    assert substring_dedup.repeats(df.limit(0)).count() == 0


def speaker(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(3, 8)))
    return lambda n: " ".join(word() for _ in range(n))


def test_every_occurrence_of_a_shared_passage_goes(spark):
    say = speaker(11)
    passage = say(70)
    texts = [f"{say(9)} {passage} {say(9)}", f"{say(5)} {passage} {say(20)} {passage} {say(8)} {passage} {say(6)}", f"{say(60)}", "q " * 400, "q " * 300]
    texts[0] += f" {passage} {say(3)}"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = substring_dedup.repeats(df)
    out = {r.doc_id: r.text for r in substring_dedup.remove(df, spans).collect()}
    middle = passage.split(" ")[20:50]
    times = lambda t: sum(t.split()[i : i + 30] == middle for i in range(len(t.split())))
    assert [times(out[i]) for i in range(3)] == [1, 0, 0] and out[2] == texts[2]
    assert 32 <= len(out[3].split()) < 400 and len(out[4].split()) < 32


def test_spans_reach_the_ends_of_a_passage(spark):
    say = speaker(12)
    sizes = [51, 60, 120, 300] * 5
    passages = [say(n) for n in sizes]
    edges = [(say(7), say(6)) for _ in sizes]
    texts = [f"{say(8)} {p} {say(9)}" for p in passages] + [f"{a} {p} {b}" for (a, b), p in zip(edges, passages, strict=True)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = substring_dedup.repeats(df).where("kind = 'window'")
    got = {(r.doc_id, r.first_word, r.n_words, r.first_id, r.removed) for r in spans.collect()}
    n = len(sizes)
    assert got == {(i, 8, s, i, False) for i, s in enumerate(sizes)} | {(n + i, 7, s, i, True) for i, s in enumerate(sizes)}
    out = {r.doc_id: r.text.split() for r in substring_dedup.remove(df, spans).collect()}
    assert [out[n + i] for i in range(n)] == [f"{a} {b}".split() for a, b in edges]


def _shards(spark, texts):
    rows = sharding.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sizes, held = Counter(r.shard for r in rows), defaultdict(set)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sorted(r.doc_id for r in rows) == list(range(len(texts)))
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n)) for s, n in sizes.items())
    for r in rows:
        held[texts[r.doc_id] or ""].add(r.shard)
    return held


def test_shards_are_even_and_groups_together(spark):
    rnd = random.Random(9)
    texts = [rnd.choice(["x", "y", None, ""]) if rnd.random() < 0.1 else f"t{rnd.randrange(90)}" if rnd.random() < 0.2 else f"u{i}" for i in range(700)]
    held = _shards(spark, [*texts, *["hot"] * 350])
    assert len(held["hot"]) <= 14 and sum(len(s) > 1 for t, s in held.items() if t != "hot") <= 15


def test_shards_are_even_when_every_text_has_a_twin(spark):
    rnd = random.Random(9)
    held = _shards(spark, [f"t{rnd.randrange(40)}" for _ in range(300)] + ["hot"] * 100)
    assert sum(map(len, held.values())) < 300


def test_shards_of_few_rows(spark):
    held = _shards(spark, ["same"] * 5)
    assert len(held["same"]) == 5
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def longest_by_force(doc, items, window):
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    w, best = alnum(doc), (0, None)
    for _, t in items:
        v = alnum(t)
        for p in range(len(w)):
            for q in range(len(v)):
                n = 0
                while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                    n += 1
                if n >= window or (q == 0 and len(v) < window and n == len(v)):
                    best = min(best, (n, p), key=lambda x: (-x[0], -1 if x[1] is None else x[1]))
    return best


def test_longest_matches_equal_brute_force(spark):
    rnd = random.Random(16)
    say = lambda n: " ".join(rnd.choice("abcd") for _ in range(n))
    items = [(i, say(rnd.randrange(1, 30))) for i in range(8)]
    docs = [say(rnd.randrange(40)) for _ in range(60)] + [t for _, t in items]
    df = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(docs)], "doc_id string, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK, 40):
        got = {r.doc_id: (r.longest, r.longest_at) for r in decontaminate.matches(df, bench, window=5, block=block).collect()}
        assert got == {f"k{i}": longest_by_force(t, items, 5) for i, t in enumerate(docs)}


def test_long_and_repeated_items_stay_cheap():
    import time

    import pyarrow as pa

    long = " ".join(f"w{i % 4999}" for i in range(50_000))
    began = time.perf_counter()
    items = decontaminate.Items(list(range(1001)), [long] + ["zz"] * 1000, 13)
    n_words, hits, found, longest, at = decontaminate.shard(pa.array([f"x {long} y", "zz " * 3000], pa.large_string()), items)
    assert [len(h) for h in hits] == [50_000, 3000] and found[0] == ["0"] and len(found[1]) == 1000
    assert longest == [50_000, 1] and at == [1, 0] and time.perf_counter() - began < 20


def test_components_of_many_edges(spark, monkeypatch):
    from fieldlark.llm import common

    monkeypatch.setattr(common, "EDGES", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    test_components_and_ordinals(spark)


def test_texts_with_a_passage_in_common_alone(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 4)
    say = speaker(21)
    passage = say(120)
    texts = [f"{passage} {say(45)}" for _ in range(30)]
    near = texts[3].split(" ")
    near[-1] = "other"
    texts += [" ".join(near), texts[5].upper()]
    df = spark.createDataFrame([(f"k{i:02}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.cluster(df, n=4).collect()}
    assert got == {f"k{i:02}": {30: "k03", 31: "k05"}.get(i, f"k{i:02}") for i in range(32)}


def test_words_of_pieces_equal_words_of_the_whole(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from fieldlark.llm import textkernel

    rnd = random.Random(15)
    for _ in range(40):
        rows = ["".join(rnd.choice("aB é\n.1  ") for _ in range(rnd.randrange(150))) for _ in range(rnd.randrange(9))] + ["x" * 300, ""]
        texts = pa.array(rows, pa.large_string()).slice(rnd.randrange(2))
        for letters in (textkernel.SPACED, textkernel.ALPHANUMERIC):
            monkeypatch.setattr(textkernel, "_SPLIT", 1 << 18)
            whole = textkernel.words(texts, letters)
            for size in (5, 64):
                monkeypatch.setattr(textkernel, "_SPLIT", size)
                assert all(map(np.array_equal, textkernel.words(texts, letters), whole))
