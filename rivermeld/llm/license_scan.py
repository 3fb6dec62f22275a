"""Licence recognition by sentences: normalised sentences become identifiers, identifier sequences meet ordered rules.

All in column expressions in the row of a document; the tables of sentences and rules are fixed and small. A rule is an
ordered list of sentence identifiers; it holds where they follow one another among the known sentences of the text, with
at most `gap` other known sentences between two of them.

Defined cases: a null or empty text has no sentences and no licence; repeated rows get a result each; a very long text is
read whole, in time that grows as n log n with its n sentences; an empty table gives an empty result; columns other than
identifier and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivermeld.llm.shared import bound, query, running_sums, table, whole

# Normalised sentences of published licences and notices.
SENTENCES = {
    "released under the mit license": "mit-name",
    "licensed under the mit license": "mit-name",
    "this project is licensed under the mit license": "mit-name",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2 0": "apache2-name",
    "licensed under the apache license version 2 0 the license": "apache2-name",
    "you may not use this file except in compliance with the license": "apache2-use",
    "you may obtain a copy of the license at": "apache2-copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "this work is licensed under the gnu general public license version 3": "gpl3-name",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gnu-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-name",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "this work is licensed under a creative commons attribution 4 0 international license": "ccby4-name",
    "this work is licensed under the creative commons attribution 4 0 license": "ccby4-name",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "ccbysa4-name",
    "all rights reserved": "reserved",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-name",  # a sentence ends behind 'v.'
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl1-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "bsd0-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "epl1-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-grant",
    "this font software is licensed under the sil open font license version 1 1": "ofl11-name",
}
#: Grants of the GNU licences, as whole sentences and, for the reading in which a colon ends one, without their first words.
SENTENCES |= {
    f"{first}you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation {which}": f"{short}-grant"
    for short, name, version in (("gpl3", "gnu general public license", "3"), ("gpl2", "gnu general public license", "2"),
                                 ("lgpl3", "gnu lesser general public license", "3"), ("lgpl21", "gnu lesser general public license", "2 1"),
                                 ("agpl3", "gnu affero general public license", "3"))
    for first in ("", "this program is free software ", "this library is free software ")
    for which in (f"either version {version} of the license or at your option any later version", f"version {version} of the license",
                  f"either version {version} of the license")
}


# Names that a notice can give a licence, normalised and without article; identifier, licence, names.
_GNU = {"gpl": "gnu general public license", "lgpl": "gnu lesser general public license", "agpl": "gnu affero general public license"}


def _gnu(short: str, version: str) -> tuple[str, ...]:
    """Names of a version ('3', '2 1') of a GNU licence."""
    full = _GNU[short]
    exact = version if " " in version else f"{version} 0"
    brief = [f"{n}{v}" for n in (short, f"gnu {short}") for v in (f"v{version}", f" v{version}", f" version {version}", f" {version}", f" {exact}", f" v{exact}")]
    long = [f"{full} {v}" for v in (f"v{version}", f"version {version}", version, exact, f"v{exact}", f"version {exact}")]
    return tuple(dict.fromkeys([f + e for f in brief for e in ("", " only", " or later")] + [f + e for f in long for e in ("", " or later", " or any later version")]))


def _cc(kind: str, version: str) -> tuple[str, ...]:
    """Names of a Creative Commons licence ('by nc', '4 0'); without a version too."""
    words = {"by": ("attribution",), "nc": ("noncommercial", "non commercial"), "sa": ("sharealike", "share alike"),
             "nd": ("noderivatives", "noderivs", "no derivatives")}
    full = [""]
    for k in kind.split():
        full = [f"{f} {w}" for f in full for w in words[k]]
    forms = [f"cc {kind}", f"creative commons {kind}", *["creative commons" + f for f in full]]
    ends = {"4 0": ("", " international"), "3 0": ("", " unported")}.get(version, ("",))
    return tuple(f"{f} {version}{e}".replace("  ", " ").rstrip() for f in forms for e in ends)


NAMES = (
    ("mit-name", "MIT", ("mit", "expat")),
    ("apache2-name", "Apache-2.0", ("apache 2 0", "apache 2", "apache license 2 0", "apache license version 2 0", "apache license v2 0",
                                    "apache software license 2 0", "apache software license version 2 0", "asl 2 0")),
    ("gpl3-name", "GPL-3.0", _gnu("gpl", "3")), ("gpl2-name", "GPL-2.0", _gnu("gpl", "2")),
    ("lgpl3-name", "LGPL-3.0", _gnu("lgpl", "3")), ("lgpl21-name", "LGPL-2.1", _gnu("lgpl", "2 1")),
    ("agpl3-name", "AGPL-3.0", _gnu("agpl", "3")),
    ("bsd2-name", "BSD-2-Clause", ("bsd 2 clause", "2 clause bsd", "simplified bsd", "freebsd")),
    ("bsd3-name", "BSD-3-Clause", ("bsd 3 clause", "3 clause bsd", "new bsd", "modified bsd", "revised bsd")),
    ("bsd0-name", "0BSD", ("0bsd", "zero clause bsd", "bsd zero clause")),
    ("isc-name", "ISC", ("isc",)),
    ("mpl2-name", "MPL-2.0", ("mpl 2 0", "mpl v2 0", "mozilla public license 2 0", "mozilla public license version 2 0", "mozilla public license v2 0")),
    ("epl1-name", "EPL-1.0", ("epl 1 0", "epl v1 0", "eclipse public license 1 0", "eclipse public license version 1 0", "eclipse public license v1 0")),
    ("epl2-name", "EPL-2.0", ("epl 2 0", "epl v2 0", "eclipse public license 2 0", "eclipse public license version 2 0", "eclipse public license v2 0")),
    ("cddl1-name", "CDDL-1.0", ("cddl 1 0", "common development and distribution license 1 0", "common development and distribution license version 1 0")),
    ("eupl12-name", "EUPL-1.2", ("eupl 1 2", "eupl v1 2", "european union public licence 1 2", "european union public licence v 1 2")),
    ("artistic2-name", "Artistic-2.0", ("artistic 2 0", "artistic license 2 0", "artistic license version 2 0")),
    ("unlicense-name", "Unlicense", ("unlicense",)),
    ("zlib-name", "Zlib", ("zlib", "zlib libpng")),
    ("bsl1-name", "BSL-1.0", ("bsl 1 0", "boost 1 0", "boost software license 1 0", "boost software license version 1 0")),
    ("busl11-name", "BUSL-1.1", ("busl 1 1", "business source license 1 1", "business source license version 1 1")),
    ("wtfpl-name", "WTFPL", ("wtfpl", "do what the fuck you want to public")),
    ("ofl11-name", "OFL-1.1", ("ofl 1 1", "sil ofl 1 1", "sil open font license 1 1", "sil open font license version 1 1")),
    ("gfdl13-name", "GFDL-1.3", ("gfdl 1 3", "gnu fdl 1 3", "gnu free documentation license 1 3", "gnu free documentation license version 1 3")),
    ("odbl1-name", "ODbL-1.0", ("odbl 1 0", "odbl v1 0", "open database license 1 0", "open database license v1 0")),
    ("cc0-name", "CC0-1.0", ("cc0", "cc0 1 0", "cc0 1 0 universal", "cc zero", "creative commons cc0", "creative commons cc0 1 0", "creative commons zero",
                             "creative commons zero v1 0 universal", "creative commons cc0 1 0 universal", "cc0 1 0 universal public domain dedication")),
    *((f"cc{k.replace(' ', '')}{v.removesuffix(' 0').replace(' ', '')}-name", "-".join(["CC", *k.upper().split(), *([v.replace(" ", ".")] if v else [])]), _cc(k, v))
      for k in ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd") for v in ("4 0", "3 0", "2 5", "2 0", "")),
)

#: What stands before a name in a notice.
BEFORE = ("licensed under", "released under", "distributed under", "published under", "available under", "this work is licensed under",
          "this project is licensed under", "this software is licensed under", "spdx license identifier")


def _notices(name: str) -> list[str]:
    """The notices that give a licence by one of its names."""
    ends = ("",) if " license" in name or " licence" in name else ("", " license") if name.startswith(("cc ", "creative")) else ("", " license", " licence")
    articles = ("", " the", " a") if name.startswith("creative") else ("", " the")
    return [f"{b}{a} {name}{e}" for b in BEFORE for a in articles for e in ends if not (b.startswith("spdx") and (a or e))]


SENTENCES = {n: i for i, _, names in NAMES for name in names for n in _notices(name)} | SENTENCES

#: Ordered rules: licence, then sentence identifiers in the order they must have.
RULES = (
    ("MIT", ("mit-name",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache2-name",)),
    ("Apache-2.0", ("apache2-use", "apache2-copy")),
    ("GPL-3.0", ("gpl3-name",)),
    ("GPL-3.0", ("gpl3-grant",)),
    ("GPL-2.0", ("gpl2-grant",)),
    ("LGPL-2.1", ("lgpl21-grant",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("LGPL-3.0", ("lgpl3-grant",)),
    ("AGPL-3.0", ("agpl3-grant",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("bsl1-grant",)),
    ("0BSD", ("bsd0-grant",)),
    ("Unlicense", ("unlicense-grant",)),
    ("CC0-1.0", ("cc0-grant",)),
    ("EPL-1.0", ("epl1-grant",)),
    ("EPL-2.0", ("epl2-grant",)),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2-name",)),
    ("CC-BY-4.0", ("ccby4-name",)),
    ("CC-BY-SA-4.0", ("ccbysa4-name",)),
    ("proprietary", ("reserved",)),
)
RULES += tuple((name, (i,)) for i, name, _ in NAMES if (name, (i,)) not in RULES)

#: A sentence ends at a mark that white space follows, and either at every line end or, for wrapped lines, at empty lines.
ENDS = (r"\n+|(?<=[.!?])[\x20\t\r]+", r"\n[\x20\t\r]*\n\s*|(?<=[.!?:])[\x20\t\r\n]+")
HINT = (r"(?i)licen[sc]|permission|redistribut|warrant|rights[^a-z0-9]+reserved|copyright|distributed|free[^a-z0-9]+software|subject[^a-z0-9]+to"
        r"|(?:released|published|available)[^a-z0-9]+under|public[^a-z0-9]+domain")


def rule_pattern(ids: tuple[str, ...], gap: int = 2) -> str:
    """A rule as a pattern over ',id,id,id,'."""
    between = r",(?:[^,]+,){0,%d}" % gap
    return "," + between.join(re.escape(x).replace(r"\-", "-") for x in ids) + ","


def normal(sentence: Column) -> Column:
    """Lower case; everything but letters and digits becomes one space."""
    return F.btrim(F.regexp_replace(F.lower(sentence), "[^a-z0-9]+", " "))


def letters(plain: Column) -> Column:
    """How many letters and digits a normalised sentence has."""
    return F.length(F.replace(plain, F.lit(" "))).cast("long")


BUCKETS = 256  # a map is searched key by key, so sentences are dealt over many


def constant_map(entries: dict[str, str]) -> Column:
    """A map of fixed words, folded into a literal."""
    return F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in entries.items())), F.lit(";"), F.lit("="))


def known_sentences() -> Callable[[Column], Column]:
    """Gives the identifier of a normalised sentence, or null."""
    dealt: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for s, i in SENTENCES.items():
        dealt[zlib.crc32(s.encode()) % BUCKETS][s] = i
    maps = F.array(*[constant_map(d) for d in dealt])
    return lambda s: F.try_element_at(F.get(maps, F.crc32(s.cast("binary")) % BUCKETS), s)


def recognised(docs: DataFrame, text: str = "text", gap: int = 2) -> DataFrame:
    """doc_id, n_sentences (known ones), sentence_ids (in order) and licenses (names in ascending order).

    A text is read by lines and as wrapped text; the known sentences of both readings count, each once, in the order of
    their places.
    """
    known = known_sentences()

    def found(ends: str) -> Column:
        def placed(parts: Column) -> Column:
            plain = F.transform(parts, normal)
            stops = running_sums(F.transform(plain, letters))
            named = F.zip_with(parts, plain, lambda x, y: F.struct(F.when(x.rlike(HINT), known(y)).alias("id"), letters(y).alias("n")))
            return F.filter(F.zip_with(named, stops, lambda x, stop: F.struct(
                (stop - x["n"]).alias("start"), stop.alias("stop"), x["id"].alias("id"))), lambda x: x["id"].isNotNull())

        return bound(F.split(whole(text), ends, -1), placed)

    # Both readings leave the same letters and digits out of no sentence, so their count is one scale of places.
    hinted = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    both = F.sort_array(F.concat(*[found(e) for e in ENDS]))
    once = bound(both, lambda xs: F.filter(xs, lambda x, i: (i == 0) | (F.get(xs, i - 1) != x)))
    none = F.array().cast("array<string>")
    ids = docs.select("doc_id", F.when(hinted, F.transform(once, lambda x: x["id"])).otherwise(none).alias("ids"))
    chained = ids.select("doc_id", "ids", F.concat(F.lit(","), F.array_join("ids", ","), F.lit(",")).alias("chain"))
    single = constant_map({r[0]: name for name, r in RULES if len(r) == 1})  # such a rule holds where its sentence is
    ordered = F.array(*[F.when(F.col("chain").rlike(rule_pattern(r, gap)), F.lit(name)) for name, r in RULES if len(r) > 1])
    licences = F.array_sort(F.array_distinct(F.array_compact(
        F.concat(F.transform("ids", lambda x: F.try_element_at(single, x)), ordered))))
    return chained.select("doc_id", F.size("ids").cast("long").alias("n_sentences"),
                          F.array_join("ids", ",").alias("sentence_ids"), F.array_join(licences, ",").alias("licenses"))


ORACLE = r"""
WITH known AS (SELECT * FROM (VALUES SENTENCES) AS t(s, id)),
rules AS (SELECT * FROM (VALUES RULES) AS t(name, p)),
d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_replace(coalesce(text, ''), '([.!?])[\x20\t\r]+', '\1' || chr(10), 'g') AS t,
           regexp_replace(regexp_replace(coalesce(text, ''), '\n[\x20\t\r]*\n\s*', chr(1), 'g'), '([.!?:])[\x20\t\r\n]+', '\1' || chr(1), 'g') AS u
    FROM documents
), s AS (
    SELECT r, way, i, trim(regexp_replace(lower(ls[i]), '[^a-z0-9]+', ' ', 'g')) AS s
    FROM (SELECT r, way, ls, unnest(range(1, len(ls) + 1)) AS i
          FROM (SELECT r, 0 AS way, string_split(t, chr(10)) AS ls FROM d UNION ALL SELECT r, 1, string_split(u, chr(1)) FROM d))
), placed AS (
    SELECT r, s, sum(length(replace(s, ' ', ''))) OVER (PARTITION BY r, way ORDER BY i) AS stop FROM s
), once AS (
    SELECT DISTINCT r, stop - length(replace(s, ' ', '')) AS start, stop, id FROM placed JOIN known USING (s)
), c AS (
    SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY start, stop, id) AS ids FROM once GROUP BY r
), m AS (
    SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM c, rules
    WHERE regexp_matches(',' || ids || ',', p) GROUP BY r
)
SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentence_ids, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
""".replace("SENTENCES", ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())).replace(
    "RULES", ", ".join(f"('{n}', '{rule_pattern(r)}')" for n, r in RULES))


@query("op8_license_scan", ORACLE)
def op8(spark, sf_dir):
    return recognised(table(spark, sf_dir, "documents").select("doc_id", "text"))
