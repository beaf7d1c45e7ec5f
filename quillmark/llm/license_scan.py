"""License scans with ordered signature rules, in DataFrame and SQL expressions only.

Texts are reduced to lower-case words with single spaces.  A prefilter of literal roots decides which texts are looked
at by signatures at all, and each signature names the words that a text needs for it.  Signatures are regular
expressions over words, some hundreds: sentences of license texts and notices and names written by hand, and their
versions and identifiers; each has a priority (1 best).  Detections are intervals of words.  One that lies inside
another of a better priority, or inside a longer one of the same priority, is suppressed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm import kernels as K

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Families: stem, its short name, its long name before "license", versions, the word that a text needs for the long name.
FAMILIES = [
    ("apache", "asl", r"apache(?: software)?", ("1 0", "1 1", "2"), "apache"),
    ("gpl", "gpl", r"(?:gnu )?general public", ("1", "2", "3"), "general public"),
    ("lgpl", "lgpl", r"(?:gnu )?(?:lesser|library) general public", ("2", "2 1", "3"), "general public"),
    ("agpl", "agpl", r"(?:gnu )?affero general public", ("1", "3"), "affero"),
    ("gfdl", "gfdl", r"(?:gnu )?free documentation", ("1 1", "1 2", "1 3"), "free documentation"),
    ("mpl", "mpl", r"mozilla public", ("1 0", "1 1", "2"), "mozilla"),
    ("epl", "epl", r"eclipse public", ("1 0", "2"), "eclipse"),
    ("eupl", "eupl", r"european union public", ("1 0", "1 1", "1 2"), "european union"),
    ("cddl", "cddl", r"common development and distribution", ("1 0", "1 1"), "common development"),
    ("cpl", "cpl", r"common public", ("1 0",), "common public"),
    ("boost", "bsl", r"boost software", ("1 0",), "boost"),
    ("artistic", "perl artistic", r"artistic", ("1 0", "2"), "artistic"),
    ("ofl", "ofl", r"(?:sil )?open font", ("1 0", "1 1"), "open font"),
    ("odbl", "odbl", r"(?:odc )?open database", ("1 0",), "open database"),
    ("odc-by", "odc by", r"open data commons attribution", ("1 0",), "open data commons"),
    ("python", "psf", r"python(?: software foundation)?", ("2",), "python"),
    ("afl", "afl", r"academic free", ("2 1", "3"), "academic free"),
    ("osl", "osl", r"open software", ("2 1", "3"), "open software"),
    ("cecill", "cecill", r"cecill", ("1 1", "2 1"), "cecill"),
    ("ecl", "ecl", r"educational community", ("1 0", "2"), "educational community"),
    ("zpl", "zpl", r"zope public", ("2 0", "2 1"), "zope"),
    ("ms-pl", "ms pl", r"microsoft public", (), "microsoft public"),
    ("ms-rl", "ms rl", r"microsoft reciprocal", (), "microsoft reciprocal"),
    ("sspl", "sspl", r"server side public", ("1",), "server side public"),
    ("busl", "busl", r"business source", ("1 1",), "business source"),
    ("elastic", "elv2", r"elastic", ("1", "2"), "elastic"),
    ("wtfpl", "wtfpl", r"do what the fuck you want to public", ("2",), "do what the fuck"),
    ("upl", "upl", r"universal permissive", ("1 0",), "universal permissive"),
    ("ogl", "ogl", r"open government", ("1 0", "2 0", "3 0"), "open government"),
    ("mulan", "mulanpsl", r"mulan (?:permissive software|psl)", ("1", "2"), "mulan"),
]
#: Names without versions: label, how it is written, the word that a text needs for it.
NAMES = [
    ("mit", r"mit(?: x11| expat)? licen[sc]ed?", "mit"), ("mit", r"(?:x11|expat) licen[sc]e", "licen"), ("mit", r"mit style licen[sc]e", "mit style"), ("mit-0", r"mit no attribution(?: licen[sc]e)?", "mit no attribution"),
    ("bsd-2-clause", r"(?:simplified|freebsd) (?:bsd )?licen[sc]e", "licen"), ("bsd-3-clause", r"(?:new|modified|revised) bsd licen[sc]e", "bsd"), ("bsd-4-clause", r"(?:original|old) bsd licen[sc]e", "bsd"),
    ("bsd-2-clause", r"bsd 2 clause(?: licen[sc]e)?", "bsd 2"), ("bsd-2-clause", r"2 clause bsd(?: licen[sc]e)?", "2 clause"), ("bsd-3-clause", r"bsd 3 clause(?: licen[sc]e)?", "bsd 3"), ("bsd-3-clause", r"3 clause bsd(?: licen[sc]e)?", "3 clause"),
    ("bsd-4-clause", r"bsd 4 clause(?: licen[sc]e)?", "bsd 4"), ("0bsd", r"0bsd(?: licen[sc]e)?", "0bsd"), ("0bsd", r"zero clause bsd(?: licen[sc]e)?", "zero clause"), ("bsd", r"bsd(?: style)? licen[sc]ed?", "bsd"), ("bsd", r"berkeley software distribution licen[sc]e", "berkeley software"),
    ("isc", r"isc licen[sc]e", "isc"), ("zlib", r"zlib(?: libpng)? licen[sc]e", "zlib"), ("libpng", r"libpng licen[sc]e", "libpng"), ("libpng", r"png reference library licen[sc]e", "png reference"), ("unlicense", r"the unlicense", "unlicense"), ("openssl", r"openssl licen[sc]e", "openssl"),
    ("postgresql", r"postgresql licen[sc]e", "postgresql"), ("ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[sc]e", "ncsa"), ("ruby", r"ruby licen[sc]e", "ruby"), ("php", r"php licen[sc]e", "php"), ("vim", r"vim licen[sc]e", "vim"),
    ("unicode", r"unicode(?: data files and software)? licen[sc]e", "unicode"), ("w3c", r"w3c(?: software)?(?: notice and)? licen[sc]e", "w3c"), ("beerware", r"beer ?ware licen[sc]e", "beer"), ("json", r"json licen[sc]e", "json"), ("qpl", r"q public licen[sc]e", "q public"),
    ("sleepycat", r"sleepycat licen[sc]e", "sleepycat"), ("ibm-pl", r"ibm public licen[sc]e", "ibm public"), ("blue-oak", r"blue oak model licen[sc]e", "blue oak"), ("hippocratic", r"hippocratic licen[sc]e", "hippocratic"), ("commons-clause", r"commons clause", "commons clause"),
    ("polyform", r"polyform (?:noncommercial|small business|shield|strict) licen[sc]e", "polyform"), ("openrail", r"(?:creativeml )?openrail(?: m)?(?: licen[sc]e)?", "openrail"), ("openrail", r"open rail(?: m)? licen[sc]e", "open rail"), ("llama", r"llama (?:2 |3 )?community licen[sc]e", "llama"), ("etalab", r"licence ouverte|etalab open licen[sc]e", "licen"),
    ("cc0", r"(?:cc0|cc zero)(?: 1 0)?(?: universal)?", "cc"), ("cc0", r"creativecommons org publicdomain zero 1 0", "creativecommons"), ("public-domain", r"(?:in|into) the public domain", "public domain"), ("public-domain", r"public domain dedication", "public domain"),
]
#: Sentences of the license texts and of the notices that files carry: label, wording, the words that a text needs for it.
BODIES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall"),
    ("mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "the software is provided as is"),
    ("mit", r"permission is hereby granted free of charge", "permission is hereby granted"),
    ("boost-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "permission is hereby granted"),
    ("ofl", r"permission is hereby granted free of charge to any person obtaining a copy of the font software", "permission is hereby granted"),
    ("x11", r"except as contained in this notice the name of (?:\S+ ){1,8}?shall not be used in advertising or otherwise to promote the sale", "except as contained in this notice"),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy"),
    ("0bsd", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", "permission to use copy"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "permission to use copy"),
    ("bsd", r"redistribution and use in source and binary forms(?: with or without modification)?(?: are permitted)?(?: provided that the following conditions are met)?", "redistribution and use"),
    ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions of source"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in binary"),
    ("bsd-3-clause", r"neither the names? of (?:\S+ ){1,14}?may be used to endorse or promote products derived from this software", "endorse or promote products"),
    ("bsd-4-clause", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment", "all advertising materials"),
    ("apache-2", r"licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "licensed under the apache"),
    ("apache-2", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "unless required by applicable law"),
    ("apache-2", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "each contributor hereby grants"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", "this product includes software"),
    ("openssl", r"this product includes software developed by the openssl project", "this product includes software"),
    ("bsd-4-clause", r"this product includes software developed by the university of california berkeley", "this product includes software"),
    ("php", r"this product includes php software", "this product includes php"),
    ("gpl-2", r"under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "free software foundation either version 2"),
    ("gpl-3", r"under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "free software foundation either version 3"),
    ("gpl-2", r"under the terms of the gnu general public license version 2(?: only)? as published by the free software foundation", "as published by the free software"),
    ("gpl-3", r"under the terms of the gnu general public license version 3(?: only)? as published by the free software foundation", "as published by the free software"),
    ("lgpl-2.1", r"under the terms of the gnu (?:lesser|library) general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "free software foundation either version 2"),
    ("lgpl-3", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", "free software foundation either version 3"),
    ("agpl-3", r"under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "free software foundation either version 3"),
    ("gpl", r"you should have received a copy of the gnu general public license", "you should have received a copy"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license", "you should have received a copy"),
    ("agpl", r"you should have received a copy of the gnu affero general public license", "you should have received a copy"),
    ("gpl", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license", "without even the implied"),
    ("gpl-2", r"the licenses for most software are designed to take away your freedom to share and change it", "take away your freedom"),
    ("gpl-3", r"the gnu general public license is a free copyleft license for software and other kinds of works", "free copyleft license"),
    ("agpl-3", r"the gnu affero general public license is a free copyleft license for software and other kinds of works", "free copyleft license"),
    ("lgpl-3", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3", "this version of the gnu lesser"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "permission is granted to copy"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license v 2 0", "source code form is subject"),
    ("mpl-2", r"this source code form is incompatible with secondary licenses", "source code form is incompatible"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", "contents of this file are subject"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", "contents of this file are subject"),
    ("epl-1.0", r"this program and the accompanying materials are made available under the terms of the eclipse public license v(?:ersion)? ?1 0", "the accompanying materials"),
    ("epl-2", r"this program and the accompanying materials are made available under the terms of the eclipse public license(?: v(?:ersion)?)? ?2 0", "the accompanying materials"),
    ("eupl", r"licensed under the eupl", "under the eupl"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", "anyone is free to copy"),
    ("wtfpl", r"you just do what the fuck you want to", "do what the fuck"),
    ("zlib", r"in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors"),
    ("zlib", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software", "must not be misrepresented"),
    ("artistic-1.0", r"the intent of this document is to state the conditions under which a package may be copied", "the intent of this document"),
    ("artistic-2", r"this license establishes the terms under which a given free software package may be copied", "this license establishes"),
    ("python", r"psf hereby grants licensee a nonexclusive royalty free world wide license", "psf hereby grants"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group", "the independent jpeg group"),
    ("w3c", r"by obtaining using and or copying this work you the licensee agree that you have read", "by obtaining using and or"),
    ("json", r"the software shall be used for good not evil", "used for good not evil"),
    ("beerware", r"as long as you retain this notice you can do whatever you want with this stuff", "as long as you retain this notice"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", "with this deed"),
    ("cc0", r"to the extent possible under law (?:\S+ ){1,20}?waived all copyright and related or neighboring rights", "to the extent possible under law"),
    ("cc", r"this work is licensed under a creative commons", "under a creative commons"),
    ("commons-clause", r"the software is provided to you by the licensor under the license as defined below subject to the following condition", "provided to you by the licensor"),
    ("llama", r"is licensed under the llama (?:2 |3 )?community license", "under the llama"),
]
#: Claims that no license is given.
RESERVED = [
    ("proprietary", r"all rights reserved", "all rights reserved"),
    ("proprietary", r"unauthorized copying of this file via any medium is strictly prohibited", "unauthorized copying"),
    ("proprietary", r"proprietary and confidential|confidential and proprietary", "proprietary"),
    ("proprietary", r"no part of this (?:publication|book|document|work) may be reproduced", "no part of this"),
    ("proprietary", r"may not be (?:copied|reproduced) (?:\S+ ){0,4}?without (?:the )?(?:prior |express )?written permission", "written permission"),
]
#: Identifiers in use after the SPDX mark.
SPDX = (
    "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 Beerware BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 "
    "CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 curl ECL-2.0 Elastic-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 GFDL-1.3-or-later GPL-1.0-only GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later "
    "HPND ICU IJG ISC JSON LGPL-2.0-only LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later Libpng LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OpenSSL OSL-3.0 "
    "PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby Sleepycat SSPL-1.0 Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zlib ZPL-2.1"
).split()
CC_PARTS = ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
CC_NAMES = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative|ative work)?s?", "nc": "non ?commercial"}
LICENSE, UNDER = "licen[sc]e", "(?:licensed|released|distributed|available|published) under (?:the terms of )?(?:the |a )?"
LATER = "(?: only| or later| or any later version|\\+)?"
#: A text without any of these holds no signature: each is part of the wording or of the gate of every rule.
ROOTS = ("licen", "pl ", "plv", "pl1", "pl2", "pl3", "sl ", "fl ", " ogl ", " ecl ", "bsd", "apache", "spdx", "creativ", " cc ", " cc0", "public domain", "copyright", "permission", "redistribut", "software", "rights reserved", "propriet", "commons clause", "openrail", "artistic", "odbl", " odc by ", " psf ", "cecill", "elv2", "gfdl", "cddl", "mit no", " ms rl ", "intent of this document", "what the fuck", "no part of this", "unauthorized", "mozilla", "not evil", "this notice", "eclipse", "accompanying", "this deed", "extent possible")
#: Short names that a version may be glued to; others need a space, as they begin common words.
GLUED = ("gpl", "lgpl", "agpl", "mpl", "epl", "eupl", "cddl", "odbl", "sspl", "gfdl", "wtfpl", "cecill")


def _words(name: str) -> str:
    return re.sub("[^a-z0-9]+", " ", name.lower()).strip()


def signatures() -> list[tuple[str, str, str, int]]:
    """(label, regular expression over words, words that a text needs for it, priority) of every rule, some hundreds."""
    out = [(label, rx, gate, 2) for label, rx, gate in BODIES]
    out += [(label, rx, gate, 5) for label, rx, gate in NAMES] + [(label, rx, gate, 7) for label, rx, gate in RESERVED]
    for name in SPDX:
        label = re.sub("-(?:only|or-later)$", "", name.lower())
        label = label.removesuffix(".0") if label.split("-")[0] in ("gpl", "lgpl", "agpl", "apache", "mpl", "epl") and not label.startswith(("apache-1", "epl-1", "mpl-1")) else label
        out.append((label, f"spdx license identifier {_words(name)}", "spdx", 1))
    for stem, short, long, versions, gate in FAMILIES:
        key = short if short in GLUED else f"{short} "
        for v in versions:
            label = f"{stem}-{v.replace(' ', '.')}"
            number = v if " " in v else f"{v}(?: 0)?"
            near = "(?: version | v ?| ?v| )?" if short in GLUED else "(?: version| v)? "
            out.append((label, f"(?:{UNDER})?(?:gnu )?{short}(?: {LICENSE})?{near}{number}{LATER}", key, 4))
            out.append((label, f"(?:{UNDER})?{long} {LICENSE}(?: {short})?(?: version| v)? ?{number}{LATER}", gate, 4))
            out.append((label, f"{long}(?: version| v)? ?{number} {LICENSE}", gate, 4))
            out.append((label, f"version {number} of the {long} {LICENSE}", gate, 4))
        out.append((stem, f"(?:{UNDER})?{long} {LICENSE}", gate, 6))
        out.append((stem, f"(?:{UNDER})?(?:gnu )?{short} {LICENSE}", key, 6))
        out.append((stem, f"{UNDER}{short}", key, 6))
    for part in CC_PARTS:
        label, long = "cc-" + part.replace(" ", "-"), " ".join(CC_NAMES[x] for x in part.split())
        for v in CC_VERSIONS:
            own = f"{label}-{v.replace(' ', '.')}"
            out.append((own, f"(?:{UNDER})?cc {part} {v}", "cc by", 3))
            out.append((own, f"(?:{UNDER})?creative commons {long}(?: {LICENSE})?(?: version| v)? ?{v}", "creative commons", 3))
            out.append((own, f"creativecommons org licenses {part} {v}", "creativecommons", 3))
            out.append((own, f"spdx license identifier cc {part} {v}", "spdx", 1))
        out += [(label, f"cc {part}", "cc by", 6), (label, f"creative commons {long}", "creative commons", 6)]
    return out


#: Confidence of a kept detection by priority; the score of a document is the best.
SCORES = {1: 1.0, 2: 0.97, 3: 0.95, 4: 0.9, 5: 0.8, 6: 0.7, 7: 0.4}


def words_column(text: str | Column) -> Column:
    """' w1 w2 ... wn ', or one space without words."""
    text = F.col(text) if isinstance(text, str) else text
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, NO_WORD, " ")), F.lit(" "))


def count_words(w: Column) -> Column:
    return F.when(F.length(w) <= 2, F.when(F.trim(w) == "", 0).otherwise(1)).otherwise(F.length(w) - F.length(F.replace(w, F.lit(" "), F.lit(""))) - 1).cast("long")


def _found(w: Column) -> Column:
    """All places of all signatures in ' w1 ... wn ', as an array of (label, priority, gaps, found).

    Every pattern is a literal, so it is compiled once; a rule is looked at only if its gate's words are there."""
    gates: dict[str, list] = {}
    for label, rx, gate, priority in signatures():
        at = F.lit(f" (?:{rx})(?= )")
        hit = F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.split(w, at, -1).alias("gaps"), F.regexp_extract_all(w, at, F.lit(0)).alias("found"))
        gates.setdefault(gate, []).append(F.when(F.rlike(w, at), hit))
    return F.flatten(F.array_compact(F.array(*[F.when(w.contains(f" {gate}"), F.array_compact(F.array(*hits))) for gate, hits in gates.items()])))


_IN = "length({0}) - length(replace({0}, ' ', ''))"
#: The match starts with a space, so words before it = spaces before it.
_PLACES = (
    "transform({0}, d -> struct(d.label as label, d.priority as priority, "
    "aggregate(sequence(0, size(d.found) - 1), cast(struct(0L as at, array() as out) as struct<at:bigint, out:array<struct<first:bigint, last:bigint>>>), (s, i) -> "
    f"cast(struct(s.at + {_IN.format('d.gaps[i]')} + {_IN.format('d.found[i]')} as at, "
    f"array_append(s.out, struct(s.at + {_IN.format('d.gaps[i]')} as first, s.at + {_IN.format('d.gaps[i]')} + {_IN.format('d.found[i]')} as last)) as out) "
    "as struct<at:bigint, out:array<struct<first:bigint, last:bigint>>>), s -> s.out) as places))"
)


def _detections(w: str) -> Column:
    """Of a words column: array of (label, priority, places); null without a root."""
    any_root = F.lit(False)
    for root in ROOTS:
        any_root = any_root | F.col(w).contains(root)
    return F.when(any_root, _found(F.col(w)))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Detections: doc_id, label, priority, first (word, from 0), last (word after), kept (false: suppressed).

    A detection's places are all non-overlapping matches of its rule.  Null texts have none.  A doc_id must be unique.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), words_column(text).alias("w")).select("doc_id", _detections("w").alias("raw")).where("size(raw) > 0")
    return suppress(_exploded(rows.select("doc_id", F.expr(_PLACES.format("raw")).alias("made"))))


def _exploded(rows: DataFrame) -> DataFrame:
    one = rows.select("doc_id", F.explode("made").alias("d")).select("doc_id", "d.label", "d.priority", F.explode("d.places").alias("p"))
    return one.select("doc_id", "label", "priority", "p.first", "p.last")


def suppress(found: DataFrame) -> DataFrame:
    """Marks detections inside another of a better priority, or inside a longer one of the same priority.

    For each priority the farthest end among detections that start no later is kept as a running maximum, so a document
    with many detections costs their number times its logarithm, never all pairs.  Equal intervals: the better priority
    wins; of one priority all stay.
    """
    rows = found.distinct()
    by_start = Window.partitionBy("doc_id").orderBy("first").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own_before = Window.partitionBy("doc_id", "priority").orderBy("first").rangeBetween(Window.unboundedPreceding, -1)
    own_start = Window.partitionBy("doc_id", "priority", "first")
    farthest = [F.coalesce(F.max(F.when(F.col("priority") == p, F.col("last"))).over(by_start), F.lit(-1)).alias(f"end{p}") for p in sorted(SCORES)]
    ends = rows.select("*", *farthest, F.coalesce(F.max("last").over(own_before), F.lit(-1)).alias("own"), F.max("last").over(own_start).alias("start"))
    inside = (F.col("own") >= F.col("last")) | (F.col("start") > F.col("last"))
    for p in sorted(SCORES):
        inside = inside | ((F.col("priority") > p) & (F.col(f"end{p}") >= F.col("last")))
    return ends.select("doc_id", "label", "priority", "first", "last", (~inside).alias("kept"))


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document: doc_id, n_words, n_base (places of the base phrases), first_word, last_word (their smallest and
    largest start; else null), base_labels, labels (kept detections' and the base ones; distinct, sorted, comma-joined,
    empty if none) and score (0 to 1: the best confidence of a kept detection or 1 for a base phrase).

    Null and empty texts have no words.  Each row is a document, also those with a null id or one that others have.
    Other columns are ignored.  Texts are read once: rows and raw detections are written to the shared folder.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), words_column(text).alias("w"))
    any_base = F.lit(False)
    for phrase in BASE:
        any_base = any_base | F.col("w").contains(f" {phrase} ")
    either = "|".join(BASE)
    # Every place is followed by the rest of the text; splitting before the places leaves the words in between.
    parts = F.split("w", f" (?=(?:{either}) )", -1)
    count = "length({0}) - length(replace({0}, ' ', ''))"
    starts = F.expr(f"aggregate(slice(parts, 1, size(parts) - 1), cast(struct(0L as at, -1L as first) as struct<at:bigint, first:bigint>), (s, x) -> cast(struct(s.at + {count.format('x')} + 1 as at, if(s.first < 0, s.at + {count.format('x')}, s.first) as first) as struct<at:bigint, first:bigint>))")
    own = [F.when(F.col("hit") & F.col("w").contains(f" {p} "), F.lit(label)) for p, label in BASE.items()]
    rows = base.select("doc_id", count_words(F.col("w")).alias("n_words"), any_base.alias("hit"), F.when(any_base, parts).alias("parts"), "w", _detections("w").alias("raw"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row_"), "doc_id", "n_words", "hit", F.when(F.col("hit"), F.size("parts") - 1).otherwise(0).cast("long").alias("n_base"),
        F.when(F.col("hit"), starts).alias("s"), F.array_sort(F.array_compact(F.array(*own))).alias("base"), F.when(F.size("raw") > 0, F.expr(_PLACES.format("raw"))).alias("made"),
    )
    rows = K.stored(rows, "license-rows")
    made = suppress(_exploded(rows.where("made is not null").select(F.col("row_").alias("doc_id"), "made"))).where("kept")
    made = made.groupBy(F.col("doc_id").alias("row_")).agg(F.collect_set("label").alias("own"), F.max(F.create_map(*[F.lit(x) for kv in SCORES.items() for x in kv])[F.col("priority")]).alias("best"))
    out = rows.drop("made").join(made, "row_", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("own", F.array().cast("array<string>"))))
    return out.select(
        "doc_id", "n_words", "n_base", F.col("s.first").alias("first_word"), F.when(F.col("hit"), F.col("s.at") - 1).alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
