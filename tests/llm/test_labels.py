import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldlark.llm import langid, license_scan, quality, toxicity

ODD = ["", None, "  \n\t ", "a b c d e a b c d e f", "x\nx\n \nx y\n", "#$ <| a|b", "w " * 3000, "Ünï cödé z", "a b c d e " * 3]


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    inside = {i for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for i in range(k, k + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)


def test_statistics_equal_brute_force(spark):
    rnd = random.Random(1)
    texts = ODD + [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(60))) for _ in range(60)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id int, text string, n_words int")
    got = {r.doc_id: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for r in quality.statistics(df).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}
    plan = quality.statistics(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert quality.statistics(df.limit(0)).count() == 0


def test_covering_learns_the_planted_rules(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8)))
    rows = []
    for i in range(400):
        text = " ".join(word() for _ in range(rnd.randrange(20, 60)))
        kind = i % 4
        rows.append((i, text.replace(" ", "## ") if kind == 0 else text.upper() if kind == 1 else text, int(kind > 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = df.select("doc_id", "quality").union(spark.createDataFrame([(None, 0), (5000, None)], "doc_id long, quality int"))
    rules = quality.learn(df, labels)
    got = {r.doc_id: r.kept for r in quality.statistics(df).select("doc_id", quality.verdict(rules).alias("kept")).collect()}
    assert sum(got[i] == bool(q) for i, _, q in rows) >= 396 and 1 <= len(rules) <= 6
    assert quality.learn(df, labels.where("quality = 1")) == [] and quality.learn(df, labels.limit(0)) == []


def toxic_rows(n=600, seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("etaoinsh") for _ in range(rnd.randrange(2, 9)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rnd.randrange(5, 60))]
        bad = i % 4 == 0
        if bad:
            w.insert(rnd.randrange(len(w)), rnd.choice(["vorpalgit", "snarkface"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(df.select("doc_id", "text"), df.where("doc_id < 400").select("doc_id", "toxic"))
    more = df.union(spark.createDataFrame([(900, None, 0), (901, "", 0), (902, "Snarkface!" * 2000, 1)], "doc_id long, text string, toxic int")).withColumn("score", F.lit("old"))
    got = {r.doc_id: r.score for r in toxicity.score(more, model).collect()}
    held = [(got[i] >= 0.3) == bool(y) for i, _, y in rows if i >= 400]
    assert sum(held) >= 0.98 * len(held)
    assert got[900] == got[901] and all(0 <= s <= 1 for s in got.values()) and got[902] > 0.3
    again = toxicity.learn(df.repartition(7).select("doc_id", "text"), df.where("doc_id < 400").select("doc_id", "toxic"))
    assert (again.weight == model.weight).all() and again.bias == model.bias
    one = toxicity.learn(df, df.where("toxic = 0").select("doc_id", "toxic"))
    assert toxicity.score(df.limit(1), one).first().score < 0.05


def test_languages_on_held_out_rows(spark):
    rnd = random.Random(4)
    sounds = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ter"], "cc": ["ció", "ñe", "que"]}
    make = lambda k, n: " ".join("".join(rnd.choice(sounds[k]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))
    rows = [(i, make(k := "aabbcc"[i % 3 * 2 : i % 3 * 2 + 2], rnd.randrange(8, 60)), k) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df.where("doc_id < 200").union(spark.createDataFrame([(999, "x", None), (998, None, "aa")], df.schema)))
    more = df.union(spark.createDataFrame([(900, None, None), (901, " 12 ?", None), (902, "", None)], df.schema)).withColumn("SCORE", F.lit(1))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(more, model).collect()}
    assert sum(got[i][0] == k for i, _, k in rows if i >= 200) >= 98
    assert [got[i] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert langid.identify(df, langid.learn(df.limit(0))).select("lang_pred").distinct().first()[0] == "und"


@pytest.mark.parametrize(
    ("text", "ids", "names"),
    [
        ("Hi.\nReleased under the MIT License.", "mit_ref", "MIT"),
        ("Licensed under the Apache Licence, Version 2.0. You may obtain a copy of the License at", "apache2_ref apache2_copy", "Apache-2.0"),
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "fsf_free gpl_terms", "GPL"),
        ("all rights reserved\nReleased under the MIT license", "reserved mit_ref", "MIT"),
        ("All rights reserved.", "reserved", "Proprietary"),
        ("Unlicensed under the moon.", "", ""),
        (None, "", ""),
        ("", "", ""),
    ],
)
def test_licences(spark, text, ids, names):
    df = spark.createDataFrame([(text, "old")], "text string, licenses string")
    r = license_scan.scan(df).first()
    assert (r.sentence_ids, r.licenses, r.n_known) == (ids, names, len(ids.split()))


def test_licence_sentences_need_no_anchor(spark):
    texts = ["All  rights reserved", "All rights\u00a0reserved", "ALL RIGHTS-RESERVED", "This program is free  software", "Made by\nhand."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: (r.sentence_ids, r.n_known) for r in license_scan.scan(df).collect()}
    assert got == {0: ("reserved", 1), 1: ("reserved", 1), 2: ("reserved", 1), 3: ("fsf_free", 1), 4: ("", 0)}
    own = license_scan.scan(df, sentences={"made by": "made", "hand": "hand"}, rules=((("Hand", ("made", "hand")),),))
    assert {r.doc_id: r.licenses for r in own.collect()} == {0: "", 1: "", 2: "", 3: "", 4: "Hand"}


MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD2 = """Copyright (c) 2020, Somebody. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
"""
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 *
 * Unless required by applicable law or agreed to in writing, software
 * distributed under the License is distributed on an "AS IS" BASIS,
 * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
 * See the License for the specific language governing permissions and
 * limitations under the License.
 */
"""
GPL3 = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.
#
# This program is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
# GNU General Public License for more details.
"""
LGPL = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Copyright 2020 Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled
binary, for any purpose, commercial or non-commercial, and by any
means.
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
"""


def test_whole_licence_texts(spark):
    gpl2 = GPL3.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
    texts = {
        "MIT": MIT,
        "BSD-2-Clause": BSD2 + WARRANTY,
        "BSD-3-Clause": BSD2 + NAMES + WARRANTY,
        "Apache-2.0": APACHE,
        "GPL-3.0": GPL3,
        "GPL-2.0": gpl2,
        "AGPL-3.0": GPL3.replace("GNU General", "GNU Affero General"),
        "LGPL-2.1": LGPL,
        "MPL-2.0": MPL,
        "ISC": ISC,
        "Unlicense": UNLICENSE,
        "Zlib": ZLIB,
        "MIT,Apache-2.0": "// SPDX-License-Identifier: (MIT OR Apache-2.0)\nfn main() {}",
        "CC0-1.0": "x = 1\n# SPDX-License-Identifier: CC0-1.0\n",
        "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    }
    mixed = MIT.replace("\n", "\r\n")
    rows = [(k, t) for k, t in texts.items()] + [("MIT", mixed), ("MIT", f"{'other words. ' * 100_000}\n\n{MIT}"), ("MIT", MIT)]
    df = spark.createDataFrame(rows, "want string, text string")
    assert [(r.want, r.licenses) for r in license_scan.scan(df).where("want <> licenses").collect()] == []
    assert license_scan.scan(df).count() == len(rows) and license_scan.scan(df.limit(0)).count() == 0


def test_sequences_of_hash_and_place_apart(spark, monkeypatch):
    monkeypatch.setattr(quality, "PLACE", 4)
    test_statistics_equal_brute_force(spark)


def test_only_letters_make_a_language(spark):
    df = spark.createDataFrame([(1, "\u00b2\u00bd \u2167 12_"), (2, "\u00e9"), (3, "\u6f22\u5b57")], "doc_id long, text string")
    model = langid.learn(spark.createDataFrame([(1, "words of a kind", "xx"), (2, "andere worte", "yy")], "doc_id long, text string, lang string"))
    got = {r.doc_id: r.lang_pred for r in langid.identify(df, model).collect()}
    assert got[1] == "und" and got[2] != "und" and got[3] != "und"
    assert langid.identify(df.limit(0), model).count() == 0
    near = langid.identify(df, model, reject=1.1).collect()
    assert all(r.lang_accepted is None for r in near)


def test_toxicity_of_odd_labels_and_tables(spark):
    rows = toxic_rows(200)
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic")
    more = labels.union(labels.limit(20)).union(spark.createDataFrame([(1, None), (None, 1), (9999, 1)], labels.schema))
    model = toxicity.learn(df.select("doc_id", "text"), more)
    assert toxicity.score(df.limit(0), model).count() == 0
    scores = [r.score for r in toxicity.score(df.union(df), model).collect()]
    assert len(scores) == 400 and all(0 <= s <= 1 for s in scores)


def test_statistics_and_removal_keep_columns_of_any_name(spark):
    from fieldlark.llm import substring_dedup

    rows = [(1, "one two three " * 30, "a", 1.0, 2), (2, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, Text string, _more string, _upper double, _n_lines int")
    got = {r.doc_id: r for r in quality.statistics(df).collect()}
    assert (got[1]._more, got[1]._upper, got[1].n_words, got[1].upper_share, got[2].n_words) == ("a", 1.0, 90, 0.0, 0)
    spans = spark.createDataFrame([(1, 3, 87, True)], "doc_id long, first_word int, n_words int, removed boolean")
    out = {r.doc_id: r for r in substring_dedup.remove(df.withColumn("_spans", F.lit("mine")).withColumn("_spans_", F.lit(3)), spans).collect()}
    assert out[1].Text.split() == ["one", "two", "three"] and (out[1]._spans, out[1]._spans_, out[2].Text) == ("mine", 3, None)


def test_toxicity_reads_no_more_rows_than_it_says(spark, monkeypatch):
    rows = toxic_rows(60)
    df = spark.createDataFrame([r for r in rows for _ in range(20)], "doc_id long, text string, toxic int")
    held = []
    fit = toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda y, *more: held.append(len(y)) or fit(y, *more))
    toxicity.learn(df, df.select("doc_id", "toxic"), rows=100)
    assert held in ([100], [])  # not fitted where the sample is of one label


def test_every_language_is_learned(spark):
    rows = [(i, f"{chr(0x430 + i % 30) * 3} {chr(0x430 + i // 30) * 2} sound{i} " * 4, f"l{i:03}") for i in range(260)] + [(900, "klang wort " * 20_000, "long")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df, size=1 << 12)
    assert len(model) == 261 and 400 < len(model["long"]) <= 512 and model["long"].endswith((b"klang", b"wort"))
    assert langid.identify(df.where("lang = 'long'"), model).first().lang_pred == "long"


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Neither the name of Google Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause"),
        ("* Neither the name of The Example\n  Project, Ltd. nor the names of its\n  contributors may be used to endorse or promote products derived from\n  this software without specific prior written permission.", "BSD-3-Clause"),
        ("", "BSD-2-Clause"),
    ],
)
def test_bsd_with_a_holders_name(spark, text, names):
    body = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
    df = spark.createDataFrame([(body + "\n" + text,)], "text string")
    assert license_scan.scan(df).first().licenses == names


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "MIT,Apache-2.0"),
        ("Licensed under either of\n\n * Apache License, Version 2.0\n   (LICENSE-APACHE or http://www.apache.org/licenses/LICENSE-2.0)\n * MIT license\n\nat your option.", "MIT,Apache-2.0"),
        ("The project is licensed under the MIT License.", "MIT"),
        ("This software is released under the Apache License, Version 2.0.", "Apache-2.0"),
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"),
        ("Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");", "EUPL-1.2"),
        ("The Artistic License 2.0\n\nCopyright (c) 2000-2006", "Artistic-2.0"),
        ("PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2\n", "PSF-2.0"),
        ("Neither the name of the game nor the rules of it were known.", ""),
    ],
)
def test_licence_references(spark, text, names):
    assert license_scan.scan(spark.createDataFrame([(text,)], "text string")).first().licenses == names


def test_licence_scan_of_odd_tables(spark):
    df = spark.createDataFrame([(1, "MIT License. " * 40_000, "x", "y"), (2, None, "x", "y"), (2, None, "x", "y"), (3, "", None, None)], "doc_id long, text string, Licenses string, other string")
    got = license_scan.scan(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.licenses, r.n_known) for r in got] == [(1, "MIT", 40_000), (2, "", 0), (2, "", 0), (3, "", 0)] and got[0].other == "y"
    assert license_scan.scan(df.limit(0)).count() == 0
