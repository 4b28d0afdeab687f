"""Licence scans: normalised sentences become known sentence identifiers, whose sequence ordered rules match.

Comment marks at the begin of a line are left out, and an SPDX line is a sentence of its own. A sentence ends after
. ! ? ; : and white space, and at a blank line. A single line's end may be a wrapped line or an end: each paragraph
is read both ways, and the way that knows more sentences counts. A sentence is normalised to lower-case letters,
digits and single blanks. A rule is a sequence of identifiers that must occur in this order, others may lie
between. Rules come in families, tried in order, and each family names its first rule that matches; the last
family is tried only where no other names a licence.

Defined results: null and empty texts and texts without a known sentence name no licence (empty strings); a
sentence said again counts again; very long texts are read whole, repeated rows each. Other columns pass
through, and columns named like an output are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: SPDX names that an SPDX line may give; fixed values.
SPDX = (
    "MIT Apache-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later "
    "LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause ISC 0BSD MPL-2.0 Unlicense "
    "EPL-2.0 CC0-1.0 Zlib BSL-1.0 WTFPL CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 Artistic-2.0 PSF-2.0 EUPL-1.2"
).split()
#: Known sentences, normalised; fixed values.
SENTENCES = {
    # MIT
    "released under the mit license": "mit_ref",
    "licensed under the mit license": "mit_ref",
    "mit license": "mit_title",
    "the mit license": "mit_title",
    "the mit license mit": "mit_title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit_grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit_grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "the software is provided as is without warranty of any kind express or implied": "as_is",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as_is",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit_liable",
    # Apache
    "licensed under the apache license version 2 0": "apache2_ref",
    "licensed under the apache license version 2 0 the license": "apache2_ref",
    "licensed under either of apache license version 2 0": "apache2_ref",
    "licensed under either of the apache license version 2 0": "apache2_ref",
    "released under the apache license version 2 0": "apache2_ref",
    "you may not use this file except in compliance with the license": "apache2_use",
    "you may obtain a copy of the license at": "apache2_copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2_copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache2_copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2_as_is",
    "apache license version 2 0": "apache2_title",
    "apache license version 2 0 january 2004": "apache2_title",
    "apache license version 2 0 january 2004 http www apache org licenses": "apache2_title",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form": "apache2_copyright",
    "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document": "apache2_definition",
    # GPL, LGPL, AGPL
    "licensed under the gnu general public license version 3": "gpl3_ref",
    "licensed under the gnu general public license version 2": "gpl2_ref",
    "gnu general public license version 3 29 june 2007": "gpl3_title",
    "gnu general public license version 2 june 1991": "gpl2_title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3_title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21_title",
    "gnu affero general public license version 3 19 november 2007": "agpl3_title",
    "this program is free software": "fsf_free",
    "this library is free software": "fsf_free",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl_terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl_terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2_terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3_terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl_terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3_terms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3_terms",
    "either version 2 of the license or at your option any later version": "version_2",
    "either version 2 1 of the license or at your option any later version": "version_2_1",
    "either version 3 of the license or at your option any later version": "version_3",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "fsf_warranty",
    # BSD, ISC, zlib, Boost
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd_grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice": "bsd_source",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd_source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd_binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd_names",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd_as_is",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "zerobsd_grant",
    "this software is provided as is without any express or implied warranty": "zlib_as_is",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "distributed under the boost software license version 1 0": "boost_ref",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost_grant",
    # MPL, EPL, public domain, Creative Commons
    "mozilla public license version 2 0": "mpl2_title",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2_form",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2_copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2_copy",
    "eclipse public license v 2 0": "epl2_title",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2_terms",
    "this is free and unencumbered software released into the public domain": "unlicense_domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense_anyone",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0_dedicated",
    "cc0 1 0 universal": "cc0_title",
    "do what the fuck you want to public license": "wtfpl_title",
    "you just do what the fuck you want to": "wtfpl_terms",
    "licensed under cc by nc 4 0": "ccbync4_ref",
    "licensed under cc by 4 0": "ccby4_ref",
    "licensed under cc by sa 4 0": "ccbysa4_ref",
    "licensed under a creative commons attribution 4 0 international license": "ccby4_ref",
    "licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4_ref",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "ccbync4_ref",
    # Artistic, Python, European Union
    "the artistic license 2 0": "artistic2_title",
    "artistic license 2 0": "artistic2_title",
    "licensed under the artistic license 2 0": "artistic2_title",
    "psf license agreement for python": "psf_title",
    "python software foundation license version 2": "psf_title",
    "this license agreement is between the python software foundation psf and the individual or organization licensee accessing and otherwise using this software python in source or binary form and its associated documentation": "psf_between",
    "european union public license v 1 2": "eupl12_title",
    "licensed under the eupl": "eupl12_ref",
    "licensed under the eupl version 1 2": "eupl12_ref",
    "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl the license": "eupl12_ref",
    "all rights reserved": "reserved",
} | {f"spdx license identifier {re.sub('[^a-z0-9]+', ' ', name.lower())}": f"spdx_{re.sub('[^a-z0-9]+', '_', name.lower())}" for name in SPDX}
#: Families of (licence, identifiers in order), each tried from the top; fixed values.
RULES = (
    (
        ("MIT", ("mit_grant", "mit_notice", "as_is")),
        ("MIT", ("mit_grant", "mit_notice")),
        ("MIT", ("mit_ref",)),
        ("MIT", ("mit_title",)),
        ("MIT", ("spdx_mit",)),
    ),
    (
        ("Apache-2.0", ("apache2_ref", "apache2_use", "apache2_copy")),
        ("Apache-2.0", ("apache2_ref",)),
        ("Apache-2.0", ("apache2_title",)),
        ("Apache-2.0", ("apache2_definition",)),
        ("Apache-2.0", ("apache2_copyright",)),
        ("Apache-2.0", ("spdx_apache_2_0",)),
    ),
    (
        ("AGPL-3.0", ("fsf_free", "agpl3_terms")),
        ("AGPL-3.0", ("agpl3_title",)),
        ("AGPL-3.0", ("spdx_agpl_3_0",)),
        ("AGPL-3.0", ("spdx_agpl_3_0_only",)),
        ("AGPL-3.0", ("spdx_agpl_3_0_or_later",)),
    ),
    (
        ("LGPL-3.0", ("fsf_free", "lgpl3_terms")),
        ("LGPL-3.0", ("lgpl3_title",)),
        ("LGPL-3.0", ("spdx_lgpl_3_0",)),
        ("LGPL-3.0", ("spdx_lgpl_3_0_only",)),
        ("LGPL-3.0", ("spdx_lgpl_3_0_or_later",)),
        ("LGPL-2.1", ("fsf_free", "lgpl_terms", "version_2_1")),
        ("LGPL-2.1", ("lgpl21_title",)),
        ("LGPL-2.1", ("spdx_lgpl_2_1",)),
        ("LGPL-2.1", ("spdx_lgpl_2_1_only",)),
        ("LGPL-2.1", ("spdx_lgpl_2_1_or_later",)),
    ),
    (
        ("GPL-3.0", ("gpl3_ref",)),
        ("GPL-3.0", ("fsf_free", "gpl3_terms")),
        ("GPL-3.0", ("fsf_free", "gpl_terms", "version_3")),
        ("GPL-3.0", ("gpl3_title",)),
        ("GPL-3.0", ("spdx_gpl_3_0",)),
        ("GPL-3.0", ("spdx_gpl_3_0_only",)),
        ("GPL-3.0", ("spdx_gpl_3_0_or_later",)),
        ("GPL-2.0", ("gpl2_ref",)),
        ("GPL-2.0", ("fsf_free", "gpl2_terms")),
        ("GPL-2.0", ("fsf_free", "gpl_terms", "version_2")),
        ("GPL-2.0", ("gpl2_title",)),
        ("GPL-2.0", ("spdx_gpl_2_0",)),
        ("GPL-2.0", ("spdx_gpl_2_0_only",)),
        ("GPL-2.0", ("spdx_gpl_2_0_or_later",)),
        ("GPL", ("fsf_free", "gpl_terms")),
    ),
    (("CC-BY-NC-4.0", ("ccbync4_ref",)), ("CC-BY-NC-4.0", ("spdx_cc_by_nc_4_0",))),
    (("CC-BY-4.0", ("ccby4_ref",)), ("CC-BY-4.0", ("spdx_cc_by_4_0",))),
    (("CC-BY-SA-4.0", ("ccbysa4_ref",)), ("CC-BY-SA-4.0", ("spdx_cc_by_sa_4_0",))),
    (
        ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
        ("BSD-3-Clause", ("spdx_bsd_3_clause",)),
        ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
        ("BSD-2-Clause", ("spdx_bsd_2_clause",)),
        ("BSD", ("bsd_grant", "bsd_source")),
    ),
    (("ISC", ("isc_grant",)), ("ISC", ("spdx_isc",))),
    (("0BSD", ("zerobsd_grant",)), ("0BSD", ("spdx_0bsd",))),
    (("Zlib", ("zlib_as_is", "zlib_grant")), ("Zlib", ("spdx_zlib",))),
    (("BSL-1.0", ("boost_grant",)), ("BSL-1.0", ("boost_ref",)), ("BSL-1.0", ("spdx_bsl_1_0",))),
    (("MPL-2.0", ("mpl2_form", "mpl2_copy")), ("MPL-2.0", ("mpl2_title",)), ("MPL-2.0", ("spdx_mpl_2_0",))),
    (("EPL-2.0", ("epl2_terms",)), ("EPL-2.0", ("epl2_title",)), ("EPL-2.0", ("spdx_epl_2_0",))),
    (("Unlicense", ("unlicense_domain", "unlicense_anyone")), ("Unlicense", ("unlicense_domain",)), ("Unlicense", ("spdx_unlicense",))),
    (("CC0-1.0", ("cc0_dedicated",)), ("CC0-1.0", ("cc0_title",)), ("CC0-1.0", ("spdx_cc0_1_0",))),
    (("WTFPL", ("wtfpl_title",)), ("WTFPL", ("wtfpl_terms",)), ("WTFPL", ("spdx_wtfpl",))),
    (("Artistic-2.0", ("artistic2_title",)), ("Artistic-2.0", ("spdx_artistic_2_0",))),
    (("PSF-2.0", ("psf_between",)), ("PSF-2.0", ("psf_title",)), ("PSF-2.0", ("spdx_psf_2_0",))),
    (("EUPL-1.2", ("eupl12_ref",)), ("EUPL-1.2", ("eupl12_title",)), ("EUPL-1.2", ("spdx_eupl_1_2",))),
    (("Proprietary", ("reserved",)),),
)


def _spaced(pattern: str) -> str:
    """The pattern with each blank standing for blanks and a line's end."""
    return pattern.replace(" ?", "[ \\t\\n]*").replace(" ", "[ \\t\\n]+")


#: What is done to a text, in order, before it is cut at blank lines: (pattern, what replaces it).
PREPARED = (
    (r"(^|\n)[ \t\r]*(?:/\*+|\*+/?|#+|//+|--+|;+)[ \t]*", r"\1"),
    *[(r"(?i)(spdx-licen[cs]e-identifier:[^\n]*?)[ \t]+(?:or|and)[ \t]+", "\\1\nspdx-license-identifier: ")] * 3,
    (r"(?i)spdx-licen[cs]e-identifier:[ \t]*\(?([a-z0-9.+-]+)", "\n\nspdx-license-identifier-\\1\n\n"),
    # A holder's name, which may have full stops and be wrapped, stands where a sentence has a placeholder.
    (_spaced(r"(?i)neither the names? of [^\n]{0,200}(?:\n[^\n]{1,200})? nor the names? of (?:its|their|the|other|any) contributors"), "Neither the name of the copyright holder nor the names of its contributors"),
    (_spaced(r"(?i)(?:this|the) (?:project|software|library|package|program|work|code|repository|crate|module) is (licen[cs]ed|released) under"), "\\1 under"),
    (_spaced(r"(?i)(apache license,? version 2\.0)(?: ?\([^)\n]{0,200}\))? or (?:the )?(mit license),? at your option"), "\\1.\n\\2."),
)
BLANK_LINE, SENTENCE_END = r"\n[ \t\f\r\n]*\n", r"([.!?;:])[ \t\n\f\r]+"


def identifiers(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The identifiers of a text's known sentences, in order."""
    known = F.create_map(*(F.lit(x) for pair in sentences.items() for x in pair))
    for pattern, new in PREPARED:
        text = F.regexp_replace(text, pattern, re.sub(r"\\(\d)", r"$\1", new))

    def named(paragraph: Column) -> Column:
        parts = F.split(F.regexp_replace(paragraph, SENTENCE_END, "$1\n"), "\n")
        plain = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.replace(F.lower(s), F.lit("licence"), F.lit("license")), "[^a-z0-9]+", " ")))
        told = F.filter(plain, lambda s: s.isin(*sentences))  # a hash set: few sentences get as far as the map, which is searched from its front
        return F.transform(told, lambda s: F.get(F.array(known), F.lit(0))[s])

    def best(paragraph: Column) -> Column:
        joined = F.when(F.contains(paragraph, F.lit("\n")), named(F.replace(paragraph, F.lit("\n"), F.lit(" "))))
        both = F.array(F.struct(named(paragraph).alias("by_line"), joined.alias("joined")))
        return F.get(F.transform(both, lambda b: F.when(F.size(b["joined"]) > F.size(b["by_line"]), b["joined"]).otherwise(b["by_line"])), F.lit(0))

    return F.flatten(F.transform(F.split(text, BLANK_LINE), best))


def scan(df: DataFrame, text: str = "text", sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """Add ``sentence_ids`` (blank-separated), ``licenses`` (comma-separated, in rule order) and ``n_known`` (long)."""
    names = ("sentence_ids", "licenses", "n_known")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    source = F.coalesce(F.col(text), F.lit(""))
    found = identifiers(source, sentences)
    # A generator, so that no filter on the result is moved below it.
    out = df.select(*kept, F.inline(F.transform(F.array(found), lambda ids: F.struct(F.array_join(ids, " ").alias("sentence_ids"), F.size(ids).cast("long").alias("n_known")))))

    def named(family: tuple) -> Column:
        return F.coalesce(*(F.when(F.col("sentence_ids").rlike(r"(^| )" + r"( \S+)* ".join(ids) + r"( |$)"), F.lit(name)) for name, ids in family))

    first, last = F.array_join(F.array_compact(F.array(*map(named, rules[:-1]))) if rules[1:] else F.array().cast("array<string>"), ","), named(rules[-1])
    return out.withColumn("licenses", F.when(F.col("n_known") == 0, "").when(first != "", first).otherwise(F.coalesce(last, F.lit(""))))
