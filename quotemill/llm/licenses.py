"""Licence recognition by sentence rules, in DataFrame expressions alone.

A text is cut into sentences as licences are set: comment marks go, blank lines, line ends after a colon, list marks and full stops before a capital end
a sentence, all other line ends are blanks.  Each sentence is normalised to lower-case letters, digits and single spaces, and looked up among known licence
sentences; one that is not known is cut again, at stops, colons and semicolons, and what is still not known by its lines.  The identifiers found, in order, form a
sequence; a licence is recognised where all identifiers of one of its rules occur in it in the rule's order.  Everything
happens within a row: nothing is shuffled and no text leaves the JVM.

Defined results: null and empty texts hold nothing; an identifier that repeats is listed each time; rules of one licence count
once; rules that a more special one contains (``supersedes``) are dropped where the special one holds; repeated rows are each reported.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences of well-known public licences and notices, by identifier.
SENTENCES = {
    "apache2-short": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "this project is licensed under the apache license 2 0", "licensed under apache 2 0"],
    "apache2-comply": ["you may not use this file except in compliance with the license"],
    "apache2-copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2 0"],
    "apache2-asis": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "mit-short": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license", "distributed under the mit license", "mit license"],
    "mit-grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-asis": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "gpl3-short": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "licensed under the gpl version 3", "licensed under gplv3"],
    "gpl2-short": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "licensed under gplv2"],
    "gpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl-hope": ["this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl-copy": ["you should have received a copy of the gnu general public license along with this program"],
    "lgpl-short": ["licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 2 1"],
    "agpl-short": ["licensed under the gnu affero general public license version 3", "licensed under agplv3"],
    "ccbync-short": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "ccby-short": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "ccbysa-short": ["licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc0-short": ["licensed under cc0 1 0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "bsd-redistribute": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-names": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd-short": ["licensed under the bsd license", "licensed under the bsd 3 clause license"],
    "mpl2-terms": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "isc-grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense-public": ["this is free and unencumbered software released into the public domain"],
    "all-rights": ["all rights reserved"],
    "apache2-whole": ["apache license version 2 0 january 2004", "apache license version 2 0 january 2004 http www apache org licenses", "spdx license identifier apache 2 0"],
    "epl2-id": ["spdx license identifier epl 2 0"], "epl1-id": ["spdx license identifier epl 1 0"], "cc0-id": ["spdx license identifier cc0 1 0"], "unlicense-id": ["spdx license identifier unlicense"], "zlib-id": ["spdx license identifier zlib"],
    "mit-id": ["spdx license identifier mit"], "gpl3-id": ["spdx license identifier gpl 3 0", "spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0 or later", "gnu general public license version 3 29 june 2007"],
    "gpl2-id": ["spdx license identifier gpl 2 0", "spdx license identifier gpl 2 0 only", "spdx license identifier gpl 2 0 or later", "gnu general public license version 2 june 1991"],
    "gpl2-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"],
    "lgpl-free": [f"this {what} is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version {v} of the license or at your option any later version" for what in ("library", "program") for v in ("2 1", "3")],
    "lgpl-id": ["spdx license identifier lgpl 2 1 only", "spdx license identifier lgpl 2 1 or later", "spdx license identifier lgpl 3 0 only", "spdx license identifier lgpl 3 0 or later", "gnu lesser general public license version 3 29 june 2007"],
    "agpl-free": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "agpl-id": ["spdx license identifier agpl 3 0 only", "spdx license identifier agpl 3 0 or later", "gnu affero general public license version 3 19 november 2007"],
    "bsd-asis": ["this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"],
    "bsd2-id": ["spdx license identifier bsd 2 clause"], "bsd3-id": ["spdx license identifier bsd 3 clause"], "mpl2-copy": ["if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"],
    "mpl2-id": ["spdx license identifier mpl 2 0", "mozilla public license version 2 0"], "isc-asis": ["the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "isc-id": ["spdx license identifier isc", "isc license"], "zlib-grant": ["permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"],
    "boost-short": ["distributed under the boost software license version 1 0", "boost software license version 1 0 august 17th 2003", "spdx license identifier bsl 1 0"], "unlicense-free": ["anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"],
}

#: Fixed values: (licence, sentence identifiers in order).
RULES = [
    ("Apache-2.0", ["apache2-short"]), ("Apache-2.0", ["apache2-comply", "apache2-asis"]), ("MIT", ["mit-short"]), ("MIT", ["mit-grant", "mit-notice"]),
    ("GPL-3.0", ["gpl3-short"]), ("GPL-3.0", ["gpl-free", "gpl-hope"]), ("GPL-2.0", ["gpl2-short"]), ("LGPL", ["lgpl-short"]), ("AGPL-3.0", ["agpl-short"]),
    ("CC-BY-NC-4.0", ["ccbync-short"]), ("CC-BY-4.0", ["ccby-short"]), ("CC-BY-SA-4.0", ["ccbysa-short"]), ("CC0-1.0", ["cc0-short"]),
    ("Apache-2.0", ["apache2-whole"]), ("MIT", ["mit-id"]), ("GPL-3.0", ["gpl3-id"]), ("GPL-2.0", ["gpl2-id"]), ("GPL-2.0", ["gpl2-free", "gpl-hope"]), ("LGPL", ["lgpl-free"]), ("LGPL", ["lgpl-id"]), ("AGPL-3.0", ["agpl-free"]), ("AGPL-3.0", ["agpl-id"]),
    ("BSD-2-Clause", ["bsd2-id"]), ("BSD-3-Clause", ["bsd3-id"]), ("MPL-2.0", ["mpl2-id"]), ("ISC", ["isc-id"]), ("Zlib", ["zlib-grant"]), ("BSL-1.0", ["boost-short"]),
    ("BSD-2-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary"]), ("BSD-3-Clause", ["bsd-redistribute", "bsd-source", "bsd-binary", "bsd-names"]),
    ("EPL-2.0", ["epl2-id"]), ("EPL-1.0", ["epl1-id"]), ("EUPL", ["eupl-id"]), ("CC0-1.0", ["cc0-id"]), ("Unlicense", ["unlicense-id"]), ("Zlib", ["zlib-id"]), ("BSD", ["bsd-short"]), ("MPL-2.0", ["mpl2-terms"]), ("ISC", ["isc-grant"]), ("Unlicense", ["unlicense-public"]), ("Proprietary", ["all-rights"]),
]
#: Licence -> licences that it contains.
SUPERSEDES = {"BSD-3-Clause": ["BSD-2-Clause", "BSD"], "BSD-2-Clause": ["BSD"]}
#: Fixed value: what a text without any other licence is under; ``All rights reserved.`` stands in permissive ones too.
LAST = "Proprietary"
#: Fixed values: (pattern of a normalised sentence, identifier), for sentences that hold names.
_UNDER = r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?"
PATTERNS = [
    ("^neither the name of .+ nor the names? of .+ may be used to endorse or promote products derived from this software without specific prior written permission$", "bsd-names"),
    (rf"\b{_UNDER}mit licen[cs]e\b|^(?:the )?mit licen[cs]e(?: mit)?$", "mit-short"),
    (rf"\b{_UNDER}apache (?:software )?(?:licen[cs]e )?(?:version |v )?2(?: 0)?\b", "apache2-short"),
    (rf"\b{_UNDER}(?:simplified |new |modified )?bsd (?:[23] clause )?licen[cs]e\b", "bsd-short"),
    (r"\beclipse public licen[cs]e (?:version |v )?2 0\b", "epl2-id"), (r"\beclipse public licen[cs]e (?:version |v )?1 0\b", "epl1-id"),
    (r"\beuropean union public licen[cs]e (?:version |v )?1 [0-2]\b|\beupl (?:version |v )?1 [0-2]\b", "eupl-id"),
]
#: Every known sentence holds one of these words; other sentences are not looked up.
CUES = "licen|permission|software|warrant|redistribut|copyright|gpl|mpl|rights|law|copies|copy"
#: What ends sentences, as (pattern, replacement) in turn; \x02 is the end.  Classes are spelt out: engines differ in theirs.
_MARK = r"(?:[0-9]{1,2}[.)]|\([0-9a-z]\)|[-*•])"
_SPDX = r"(?:Apache-|A?GPL-|LGPL-|BSD-|MPL-|BSL-|CC0-|EPL-|EUPL-)"
_CUTS = [
    # each part of a choice of SPDX identifiers is one of its own
    (rf"[ \t]+(?:OR|AND)[ \t]+\(*({_SPDX}[A-Za-z0-9.+-]*|MIT|ISC|Zlib|Unlicense)", "\x02SPDX-License-Identifier: <1>"),
    (r"\r\n?", r"\n"), (r"\n[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--|>+)?[ \t]*", r"\n"), (r"\n\n+", "\x02"), (r":[ \t]*\n", ":\x02"), (rf"\n({_MARK}[ \t])", "\x02<1>"),
    (r"([.!?][\"')\]]*)[ \t\n]+([\"'(\[]?[A-Z]|[0-9]{1,2}\.[ \t])", "<1>\x02<2>"),
]
_LEAD = rf"^[ \t\n]*{_MARK}[ \t]+"
_INNER = r"([.!?;:])[ \t\n]+"


def _said(n):
    """The identifier of a normalised sentence, or null."""
    known = _known()
    lookup = F.map_from_arrays(F.array(*(F.lit(s) for s, _ in known)), F.array(*(F.lit(i) for _, i in known)))
    out = lookup[n]
    for pattern, name in PATTERNS:
        out = F.coalesce(out, F.when(n.rlike(pattern), F.lit(name)))
    return out


def _normal(s):
    return F.trim(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")))


def _known() -> list[tuple[str, str]]:
    return [(sentence, name) for name, sentences in SENTENCES.items() for sentence in sentences]


def sentence_ids(text):
    """Identifiers of the licence sentences of a text, in order."""
    cut = F.concat(F.lit("\n"), F.coalesce(text, F.lit("")))
    for pattern, new in _CUTS:
        cut = F.regexp_replace(cut, pattern, new.replace("<", "$").replace(">", "").replace(r"\n", "\n"))
    cue = lambda s: s.rlike("(?i)" + CUES)
    lines = lambda p: F.transform(F.filter(F.split(p, "\n"), cue), lambda x: _said(_normal(x)))
    parts = lambda s: F.flatten(F.transform(F.filter(F.split(F.regexp_replace(s, _INNER, "$1\x02"), "\x02"), cue), lambda p: F.coalesce(_one(_said(_normal(p))), lines(p))))
    whole = F.filter(F.split(cut, "\x02"), cue)
    ids = F.flatten(F.transform(whole, lambda s: F.coalesce(_one(_said(_normal(F.regexp_replace(s, _LEAD, "")))), parts(s))))
    return F.filter(ids, lambda i: i.isNotNull())


def _one(i):
    return F.when(i.isNotNull(), F.array(i))


def scan_licenses(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, sentence_ids and licenses, both comma-joined in order, n_sentences, of every row."""
    found = docs.select(docs[key].alias(key), F.concat_ws(",", sentence_ids(docs[text])).alias("sentence_ids"))
    return found.select(key, "sentence_ids", F.concat_ws(",", F.array_sort(_licenses(F.col("sentence_ids")))).alias("licenses"), _count("sentence_ids").alias("n_sentences"))


def _count(joined: str):
    return F.when(F.col(joined) == "", 0).otherwise(F.size(F.split(joined, ","))).cast("long")


def _like(ids: list[str]) -> str:
    return "%" + "%".join(f",{i}," for i in ids) + "%"


def _licenses(joined):
    """Licences whose rules match the comma-joined identifiers as an ordered subsequence."""
    doubled = F.concat(F.lit(","), F.replace(joined, F.lit(","), F.lit(",,")), F.lit(","))
    holds: dict[str, Column] = {}
    for name, ids in RULES:
        hit = doubled.like(_like(ids))
        holds[name] = holds[name] | hit if name in holds else hit
    for special, general in SUPERSEDES.items():
        for name in general:
            holds[name] = holds[name] & ~holds[special]
    holds[LAST] = holds[LAST] & ~functools.reduce(Column.__or__, (hit for name, hit in holds.items() if name != LAST))
    return F.filter(F.array(*(F.when(hit, F.lit(name)) for name, hit in holds.items())), lambda x: x.isNotNull())


def oracle() -> str:
    """The same in DuckDB SQL."""
    values = ", ".join(f"('{s}', '{i}')" for s, i in _known())
    cases: dict[str, str] = {}
    for name, ids in RULES:
        hit = f"d like '{_like(ids)}'"
        cases[name] = f"{cases[name]} or {hit}" if name in cases else hit
    for special, general in SUPERSEDES.items():
        for name in general:
            cases[name] = f"({cases[name]}) and not ({cases[special]})"
    cases[LAST] = f"({cases[LAST]}) and not ({' or '.join(f'({hit})' for name, hit in cases.items() if name != LAST)})"
    names = ", ".join(f"case when {hit} then '{name}' end" for name, hit in cases.items())
    cut = "chr(10) || coalesce(text, '')"
    for pattern, new in _CUTS:
        new = " || ".join(f"'{x}'" for x in new.replace("<", "\\").replace(">", "").replace(r"\n", "\n").replace("\x02", "'||chr(2)||'").split("'||'")).replace("'||chr(2)||'", "' || chr(2) || '")
        cut = f"regexp_replace({cut}, '{pattern.replace(chr(39), chr(39) * 2)}', {new}, 'g')"
    normal = lambda x: f"trim(lower(regexp_replace({x}, '[^A-Za-z0-9]+', ' ', 'g')))"
    said = lambda x: "coalesce((select id from known where sentence = " + normal(x) + "), case " + " ".join(f"when regexp_matches({normal(x)}, '{p}') then '{i}'" for p, i in PATTERNS) + " end)"
    return rf"""
with known(sentence, id) as (values {values}),
cut as (select doc_id, string_split({cut}, chr(2)) as parts, row_number() over () as r from documents),
l1 as (select * from (select r, unnest(parts) as s, generate_subscripts(parts, 1) as a from cut) where regexp_matches(s, '(?i){CUES}')),
i1 as (select r, a, s, {said(f"regexp_replace(s, '{_LEAD}', '')")} as id from l1),
l2 as (select r, a, string_split(regexp_replace(s, '{_INNER}', '\1' || chr(2), 'g'), chr(2)) as parts from i1 where id is null),
i2 as (select r, a, b, s, {said("s")} as id from (select r, a, unnest(parts) as s, generate_subscripts(parts, 1) as b from l2) where regexp_matches(s, '(?i){CUES}')),
l3 as (select r, a, b, string_split(s, chr(10)) as parts from i2 where id is null),
i3 as (select r, a, b, c, {said("s")} as id from (select r, a, b, unnest(parts) as s, generate_subscripts(parts, 1) as c from l3) where regexp_matches(s, '(?i){CUES}')),
hit as (select r, a, 0 as b, 0 as c, id from i1 union all select r, a, b, 0, id from i2 union all select r, a, b, c, id from i3),
seq as (select r, string_agg(id, ',' order by a, b, c) as ids, count(*) as n from hit where id is not null group by r),
every as (select doc_id, coalesce(ids, '') as sentence_ids, coalesce(n, 0) as n_sentences, ',' || replace(coalesce(ids, ''), ',', ',,') || ',' as d from cut left join seq using (r))
select doc_id, sentence_ids, n_sentences, array_to_string(list_sort([x for x in [{names}] if x is not null]), ',') as licenses from every
"""
