"""Operator 10: licence detection by ordered signature rules.

The text is brought to a normal form in which every word stands between two spaces of its own, so a signature is a
regular expression over whole words. Signatures come in groups behind a keyword: a group's expressions run only on
texts that contain the keyword. Where one fits, it runs again over the text with each word's number before it, so a hit
brings its own place. Each hit is an interval of words with the priority of its rule. From the surest priority to the
least, those hits stay that overlap none that stays already, less those that another of the same priority contains.

The rules are data, one literal array of groups that is built once for a plan. All of it is built-in expressions over
one row, so the operator is a map over the scan without exchange or state; work is a sort of a text's hits and linear
passes over words and hits.

Defined results
* null or empty text, or one without words: no words, no hits, empty label strings, null positions, score 0;
* ties (hits on one interval by rules of one priority): the rule that comes first in the table stays;
* very long texts are scanned whole; rows without a doc_id keep their null id; repeated rows give repeated results; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let

#: What parts words in the lower-cased text, and the base phrases with their labels.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Signature:
    """A rule: words of the pattern are parted by one space; ( | )? and [ ] work as in regular expressions.

    key: a piece of a word, or two words, that any text has which the pattern fits.
    """

    pattern: str
    label: str
    priority: int
    confidence: float
    key: str
    base: bool = False


#: Kinds of signatures with priority (smaller is surer) and confidence: machine-readable tags, sentences of a licence's own
#: text, notices that put something under it, its full name, short forms, and statements that name no licence. The
#: contract's phrases always count; among overlapping hits any signature that says more goes before them.
KINDS = {"tag": (1, 1.0), "body": (2, 0.98), "notice": (3, 0.95), "name": (4, 0.85), "short": (5, 0.6), "hint": (6, 0.4), "base": (7, 1.0)}

#: The signatures by key: label, kind, pattern. Within a kind the longer hit wins, so order only settles equal ones.
TABLE = """
# licens
mit tag spdx license identifier mit
mit notice (licensed|released|distributed|published|provided|available) under (the )?(terms of (the )?)?(mit|expat|x11) license
mit notice use of this source code is governed by an mit style license
mit notice subject to (the )?terms of (the )?(mit|expat|x11) license
mit notice see (the )?mit license( for details)?
mit name (the )?(mit|expat|x11) license( mit)?
mit short license( is)? mit
mit short mit licensed
apache-2 tag spdx license identifier apache 2 0
apache-2 notice licensed under (the )?apache license version 2 0( the license)?
apache-2 notice licensed to the apache software foundation asf under one or more contributor license agreements
apache-2 body you may not use this file except in compliance with the license
apache-2 body you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2 notice (released|distributed|published|available) under (the )?(terms of (the )?)?apache( software)? license( version)? 2( 0)?
apache-2 name apache( software)? license( version)? 2( 0)?
apache-2 short license( is)? apache( version)? 2( 0)?
apache-2 short apache 2( 0)? licensed?
apache-1 tag spdx license identifier apache 1 [01]
apache-1 name apache( software)? license( version)? 1 [01]
apache short (the )?apache( software)? license
bsd-2 tag spdx license identifier bsd 2 clause
bsd-2 notice (licensed|released|distributed) under (the )?(terms of (the )?)?(2|two) clause bsd license
bsd-2 name (bsd 2 clause|simplified bsd|freebsd|two clause bsd) license
bsd-3 tag spdx license identifier bsd 3 clause
bsd-3 notice (licensed|released|distributed) under (the )?(terms of (the )?)?(3|three) clause bsd license
bsd-3 notice use of this source code is governed by a bsd style license that can be found in the license file
bsd-3 name (bsd 3 clause|new bsd|revised bsd|modified bsd|three clause bsd) license
bsd-4 tag spdx license identifier bsd 4 clause
bsd-4 name (bsd 4 clause|original bsd|four clause bsd|old bsd) license
bsd-0 tag spdx license identifier 0bsd
bsd-0 name (zero clause bsd|bsd zero clause) license
bsd notice (licensed|released|distributed|available) under (the |a )?(terms of (the )?)?bsd( style)? license
bsd short bsd( style)? licensed?
gpl-1 tag spdx license identifier gpl 1 0( only| or later)?
gpl-2 tag spdx license identifier gpl 2 0( only| or later)?
gpl-3 tag spdx license identifier gpl 3 0( only| or later)?
gpl-2 notice under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or
gpl-3 notice under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or
gpl notice you should have received a copy of the gnu general public license along with this (program|software|file)
gpl notice may be used under the terms of the gnu general public license
gpl-2 notice (licensed|released|distributed|available) under (the )?(terms of (the )?)?(gnu )?general public license( version)? v?2
gpl-3 notice (licensed|released|distributed|available) under (the )?(terms of (the )?)?(gnu )?general public license( version)? v?3
gpl-1 name (gnu )?general public license( version)? v?1
gpl-2 name (gnu )?general public license( version)? v?2
gpl-3 name (gnu )?general public license( version)? v?3
gpl-2 name version 2 of the gnu general public license
gpl-3 name version 3 of the gnu general public license
gpl short (gnu )?general public license
gpl short gnu gpl licensed?
gpl short licensed under (the )?(gnu )?gpl
lgpl-2 tag spdx license identifier lgpl 2 [01]( only| or later)?
lgpl-3 tag spdx license identifier lgpl 3 0( only| or later)?
lgpl-2 notice under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or
lgpl-2 notice under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or
lgpl-3 notice under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or
lgpl-2 name (gnu )?(lesser|library) general public license( version)? v?2( [01])?
lgpl-3 name (gnu )?lesser general public license( version)? v?3
lgpl short (gnu )?(lesser|library) general public license
agpl-3 tag spdx license identifier agpl 3 0( only| or later)?
agpl-3 notice under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or
agpl-3 name (gnu )?affero general public license( version)? v?3
agpl short (gnu )?affero general public license
gfdl tag spdx license identifier gfdl 1 [123]
gfdl notice permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl name (gnu )?free documentation license( version 1 [123])?
mpl-1 name mozilla public license( version)? 1 [01]
mpl-1 notice the contents of this file are subject to the mozilla public license version 1 1
mpl-2 tag spdx license identifier mpl 2 0
mpl-2 notice this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2 name mozilla public license( version| v)? 2( 0)?
mpl short mozilla public license
epl-1 tag spdx license identifier epl 1 0
epl-2 tag spdx license identifier epl 2 0
epl-1 name eclipse public license( version| v)? 1( 0)?
epl-2 name eclipse public license( version| v)? 2( 0)?
epl-2 notice this program and the accompanying materials are made available under the terms of the eclipse public license 2 0
epl-1 notice this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl short eclipse public license
edl name eclipse distribution license( version| v)? 1( 0)?
cpl-1 name common public license( version| v)? 1( 0)?
ipl-1 name ibm public license( version| v)? 1( 0)?
cddl-1 tag spdx license identifier cddl 1 [01]
cddl-1 notice subject to the terms of the common development and distribution license
cddl-1 name common development and distribution license( version 1 [01])?
isc tag spdx license identifier isc
isc notice (licensed|released|distributed) under (the )?(terms of (the )?)?isc license
isc name (the )?isc license
zlib tag spdx license identifier zlib
zlib notice (licensed|released|distributed) under (the )?(terms of (the )?)?zlib license
zlib name (zlib|libpng|zlib libpng) license
boost-1 tag spdx license identifier bsl 1 0
boost-1 notice distributed under the boost software license version 1 0
boost-1 name boost software license( version 1 0)?
artistic-1 tag spdx license identifier artistic 1 0
artistic-2 tag spdx license identifier artistic 2 0
artistic-2 name artistic license( version)? 2( 0)?
artistic-1 name artistic license( version)? 1( 0)?
artistic short (the )?(perl )?artistic license
perl notice same terms as perl itself either the artistic license
unlicense tag spdx license identifier unlicense
unlicense notice (released|dedicated|placed) (into|to|under) the (public domain under the )?unlicense
unlicense name the unlicense
wtfpl name do what the fuck you want to public license
postgresql name (the )?postgresql license
psf-2 tag spdx license identifier psf 2 0
psf-2 name python software foundation license( version 2)?
psf-2 name python license( 2 0)?
ruby name (the )?ruby license
php-3 name (the )?php license( version 3( 01?)?)?
openssl name openssl license
ssleay name (original )?ssleay license
w3c name w3c software( notice and)? license
ncsa name university of illinois( ncsa)? open source license
afl-3 name academic free license( version| v)? 3( 0)?
osl-3 name open software license( version| v)? 3( 0)?
ms-pl name microsoft public license
ms-rl name microsoft reciprocal license
apsl-2 name apple public source license( version)? 2( 0)?
nasa-1 name nasa open source license agreement
upl-1 name universal permissive license( version| v)? 1( 0)?
ecl-2 name educational community license( version)? 2( 0)?
bsl-1 name business source license( version)? 1 1
sspl-1 name server side public license( version 1)?
elastic-2 name elastic license( version)? 2( 0)?
commons-clause name commons clause license condition( v1 0)?
ofl-1 tag spdx license identifier ofl 1 1
ofl-1 notice this font software is licensed under the sil open font license version 1 1
ofl-1 name (sil )?open font license( version)?( 1 1)?
odbl-1 name (odc )?open database license
odc-by-1 name (odc )?open data commons attribution license
pddl-1 name (open data commons )?public domain dedication and license
cc0 tag spdx license identifier cc0 1 0
cc-by tag spdx license identifier cc by [1-4] [05]
cc-by-sa tag spdx license identifier cc by sa [1-4] [05]
cc-by-nc tag spdx license identifier cc by nc [1-4] [05]
cc-by-nd tag spdx license identifier cc by nd [1-4] [05]
cc-by-nc-sa tag spdx license identifier cc by nc sa [1-4] [05]
cc-by-nc-nd tag spdx license identifier cc by nc nd [1-4] [05]
creative-commons notice licensed under a creative commons license
multiple notice dual licensed under
multiple notice licensed under (either|both) of
commercial notice (this is|requires) a commercial license
commercial notice a commercial license (is )?(required|available)
proprietary notice (not|without) (a )?license to use copy modify
proprietary name proprietary license
terms-of-use name end user license agreement
terms-of-use notice by using this software you (agree|accept) (to )?the license
see-license hint see (the )?(accompanying )?license( file)? for (details|more information|the full text)
see-license hint see license in the project root for license information
see-license hint license terms (are|may be) found in
unknown-license hint all license terms apply
# licenc
mit name (mit|expat|x11) licence
apache-2 name apache( software)? licence( version)? 2( 0)?
bsd short bsd( style)? licence
gpl-2 name (gnu )?general public licence( version)? v?2
gpl-3 name (gnu )?general public licence( version)? v?3
gpl short (gnu )?general public licence
lgpl short (gnu )?(lesser|library) general public licence
eupl-1 name european union public licence( version| v)? 1 [012]
eupl-1 notice licensed under the eupl version 1 [012] or as soon they will be approved by the european commission subsequent versions of the eupl the licence
ogl-3 name open government licence( version| v)?( 3 0)?
isc name isc licence
ofl-1 name (sil )?open font licence
creative-commons short creative commons licence
# gpl
gpl-2 short gpl( version)? v?2( 0)?( only| or later)?
gpl-2 short gplv2
gpl-3 short gpl( version)? v?3( 0)?( only| or later)?
gpl-3 short gplv3
gpl short (the )?gnu gpl
lgpl-2 short lgpl( version)? v?2( [01])?
lgpl-2 short lgplv2( 1)?
lgpl-3 short lgpl( version)? v?3( 0)?
lgpl-3 short lgplv3
lgpl short (the )?gnu lgpl
agpl-3 short agpl( version)? v?3( 0)?
agpl-3 short agplv3
# mpl
mpl-2 short mpl v?2( 0)?
mpl-1 short mpl v?1( [01])?
# epl
epl-1 short epl v?1( 0)?
epl-2 short epl v?2( 0)?
# eupl
eupl-1 short eupl( version| v)? 1 [012]
# apache
apache-2 short (under )?apache v?2( 0)?
# bsd
bsd-2 short bsd 2 clause
bsd-3 short bsd 3 clause
bsd-4 short bsd 4 clause
bsd-2 short (2|two) clause bsd
bsd-3 short (3|three) clause bsd
# commons
cc0 name creative commons (zero|cc0)( 1 0)?( universal)?
cc-by-nc-nd name creative commons attribution non ?commercial no ?derivatives?( works)?( [1-4] [05])?
cc-by-nc-sa name creative commons attribution non ?commercial share ?alike( [1-4] [05])?
cc-by-nc name creative commons attribution non ?commercial( [1-4] [05])?
cc-by-nd name creative commons attribution no ?derivatives?( works)?( [1-4] [05])?
cc-by-sa name creative commons attribution share ?alike( [1-4] [05])?
cc-by name creative commons attribution( [1-4] [05])?
odc-by-1 short open data commons attribution
# cc0
cc0 short cc0( 1 0)?( universal)?
# cc by
cc-by-nc-nd short cc by nc nd( [1-4] [05])?
cc-by-nc-sa short cc by nc sa( [1-4] [05])?
cc-by-nc short cc by nc( [1-4] [05])?
cc-by-nd short cc by nd( [1-4] [05])?
cc-by-sa short cc by sa( [1-4] [05])?
cc-by short cc by( [1-4] [05])?
# hereby
mit body permission is hereby granted free of charge to any person obtaining a copy( of this software)?
boost-1 body permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
postgresql body permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
ncsa body permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
public-domain body i hereby (release|place|dedicate) this (work|code|file|software) (in|into|to) the public domain
hpnd body permission to use copy modify (and )?distribute (and sell )?this software and its documentation for any purpose is hereby granted without fee
# permission
isc body permission to use copy modify and or distribute this software for any purpose with or without fee( is hereby granted)?
zlib body permission is granted to anyone to use this software for any purpose including commercial applications
fsf-all body copying and distribution of this file with or without modification are permitted in any medium without royalty provided the copyright notice and this permission
mit body the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
proprietary notice reproduced or (distributed|transmitted) without (the )?(prior )?(express )?written permission
restricted notice without (the )?(prior )?(express )?written permission of the (author|authors|publisher|owner)
# redistribution
bsd body redistribution and use in source and binary forms with or without modification are permitted
bsd-3 body redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name
bsd body redistributions of source code must retain the above copyright notice
restricted notice (no|not for) redistribution
# acknowledg
bsd-4 body all advertising materials mentioning features or use of this software must display the following acknowledge?ment
openssl body redistributions of any form whatsoever must retain the following acknowledge?ment
# reserved
all-rights-reserved hint all rights reserved
all-rights-reserved hint some rights reserved
# domain
public-domain notice (dedicated to|released into|released to|placed in|placed into) the public domain
public-domain short (is|are) in the public domain
unlicense body this is free and unencumbered software released into the public domain
# confidential
confidential hint (strictly )?(proprietary and )?confidential
confidential hint confidential and proprietary
# commercial
restricted hint not for commercial use
non-commercial hint (for )?non ?commercial use only
non-commercial hint (for )?personal (and )?non ?commercial use
# service
terms-of-use hint terms of service
terms-of-use hint terms of use and service
# wtfpl
wtfpl short (the )?wtfpl( version 2)?
# cddl
cddl-1 short cddl( version| v)?( 1 [01])?
# psf
psf-2 short psf( 2 0)?
# ofl
ofl-1 short (sil )?ofl( 1 1)?
# odbl
odbl-1 short odbl( 1 0)?
# beerware
beerware body this beerware
beerware short beerware
# copyleft
copyleft hint copyleft
# eula
terms-of-use hint eula
"""


def signatures() -> tuple[Signature, ...]:
    """The base phrases and the signatures of TABLE, in its order."""
    rules = [Signature(p, label, *KINDS["base"], p, True) for p, label in BASE.items()]
    key = ""
    for line in filter(None, TABLE.split("\n")):
        if line.startswith("# "):
            key = line[2:]
            continue
        label, kind, pattern = line.split(" ", 2)
        rules.append(Signature(pattern, label, *KINDS[kind], key))
    return tuple(rules)


#: What a word's number looks like in the numbered form.
NUMBER = "[0-9]+:"


def compiled(pattern: str, number: str = "") -> str:
    """A signature over the normal form: each word there has a space before and after it.

    In a pattern every word, with the space that follows it inside the pattern, becomes ' word '; a joint of words
    is then two spaces. number: what stands ahead of each word.
    """
    out, word = [], ""

    def flush() -> None:
        nonlocal word
        if word:
            out.append(f" {number}{word} ")
            word = ""

    k, depth_class = 0, False
    while k < len(pattern):
        ch = pattern[k]
        if depth_class or ch == "[":
            depth_class = ch != "]"
            word += ch
        elif ch == " " and pattern[k + 1 : k + 2] == "?":
            word += f"(?:  {number})?"
            k += 1
        elif ch in "()|?" and not (ch == "?" and word):
            flush()
            out.append("(?:" if ch == "(" else ch)
        elif ch == " ":
            flush()
        else:
            word += ch
        k += 1
    flush()
    return "".join(out)


def normal_form(text: Column) -> Column:
    """Words between spaces of their own (' a  b '); empty for a text without words."""
    spaced = F.btrim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD, "  "))
    return let(spaced, lambda s: F.when(s == "", F.lit("")).otherwise(F.concat(F.lit(" "), s, F.lit(" "))))


def _n_words(normal: Column) -> Column:
    return F.floor((F.length(normal) - F.length(F.replace(normal, F.lit(" "), F.lit("")))) / 2).cast("long")


HIT = "start:bigint,back:bigint,order:int,priority:int,label:string,confidence:double,base:boolean"
HITS = f"array<struct<{HIT}>>"
_NONE = f"cast(array() as {HITS})"
_RULE = "plain:string,numbered:string,order:int,priority:int,label:string,confidence:double,base:boolean"


def _groups(rules: tuple[Signature, ...]) -> Column:
    """The rules as one literal: an array of (key, rules)."""
    groups: dict[str, list[dict]] = {}
    for order, r in enumerate(rules):
        rule = {"plain": compiled(r.pattern), "numbered": compiled(r.pattern, NUMBER), "order": order, "priority": r.priority, "label": r.label, "confidence": r.confidence, "base": r.base}
        groups.setdefault(r.key.replace(" ", "  "), []).append(rule)
    text = json.dumps([{"key": k, "rules": g} for k, g in groups.items()])
    return F.from_json(F.lit(text), f"array<struct<key:string,rules:array<struct<{_RULE}>>>>")


def _numbered(normal: Column) -> Column:
    """The normal form with its number, from 0, before each word."""
    words = F.split(F.btrim(normal), "  ")
    return F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w, i: F.concat(i.cast("string"), F.lit(":"), w)), "  "), F.lit(" "))


def _hits(numbered: Column, rule: Column) -> Column:
    """The hits of one rule: array of (start, back = -end, order, ...), in words from 0."""

    def hit(x: Column) -> Column:
        start = F.regexp_extract(x, "^ ([0-9]+)", 1).cast("long")
        n_words = F.length(x) - F.length(F.replace(x, F.lit(":"), F.lit("")))
        return F.struct(
            start.alias("start"), (-start - n_words).alias("back"), rule["order"].alias("order"), rule["priority"].alias("priority"), rule["label"].alias("label"),
            rule["confidence"].alias("confidence"), rule["base"].alias("base"),
        )

    return F.transform(F.regexp_extract_all(numbered, rule["numbered"], F.lit(0)), hit)


def _furthest(ends: Column) -> Column:
    """The largest of each entry and those before it, in passes that look twice as far back each."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(ends) + 1)).cast("int"))
    return F.aggregate(rounds, ends, lambda m, r: F.transform(m, lambda x, j: F.greatest(x, F.get(m, j - F.call_function("shiftleft", F.lit(1), r)))))


def resolved(hits: Column) -> Column:
    """The hits that stay, of hits sorted by start, longest first.

    Hits that stay lie in order of their starts and of their ends, as none contains another; so the words they cover
    come one after the other, and a hit sees whether its own are among them.
    """

    def covered(kept: Column) -> Column:
        def part(h: Column, j: Column) -> Column:
            ahead = F.coalesce(-F.get(kept, j - 1)["back"], F.lit(0))
            start = F.greatest(h["start"], ahead)
            return F.concat(F.array_repeat(F.lit(False), (start - ahead).cast("int")), F.array_repeat(F.lit(True), (-h["back"] - start).cast("int")))

        return F.flatten(F.transform(kept, part))

    def step(kept: Column, priority: Column) -> Column:
        def free(cover: Column) -> Column:
            taken = lambda h: F.exists(F.sequence(h["start"], -h["back"] - 1), lambda i: F.coalesce(F.get(cover, i.cast("int")), F.lit(False)))
            return F.filter(hits, lambda h: (h["priority"] == priority) & ~taken(h))

        def outer(own: Column) -> Column:
            ends = F.transform(own, lambda h: -h["back"])
            return let(_furthest(ends), lambda m: F.filter(own, lambda h, j: F.coalesce(F.get(m, j - 1) < -h["back"], F.lit(True))))

        return F.array_sort(F.concat(kept, let(let(covered(kept), free), outer)))

    priorities = F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["priority"])))
    return F.aggregate(priorities, F.expr(_NONE), step)


def detect(df: DataFrame, text: str = "text", rules: tuple[Signature, ...] | None = None) -> DataFrame:
    """df with the struct `licence`: n_words, hits (all, sorted), kept (those that stay), their labels (sorted) and score.

    A column named licence in df is replaced. Texts without any key, most of them, end at the keys; a key opens its
    group of expressions.
    """
    groups = _groups(signatures() if rules is None else rules)

    def found(normal: Column) -> Column:
        opened = F.filter(groups, lambda g: F.contains(normal, g["key"]))
        fitting = F.flatten(F.transform(opened, lambda g: F.filter(g["rules"], lambda r: F.rlike(normal, r["plain"]))))
        placed = let(fitting, lambda f: F.when(F.size(f) > 0, let(_numbered(normal), lambda t: F.array_sort(F.flatten(F.transform(f, lambda r: _hits(t, r)))))).otherwise(F.expr(_NONE)))
        return let(
            placed,
            lambda h: let(
                resolved(h),
                lambda kept: F.struct(
                    _n_words(normal).alias("n_words"), h.alias("hits"), kept.alias("kept"), F.sort_array(F.array_distinct(F.transform(kept, lambda x: x["label"]))).alias("labels"),
                    F.coalesce(F.array_max(F.transform(kept, lambda x: x["confidence"])), F.lit(0.0)).alias("score"),
                ),
            ),
        )

    return df.drop("licence").withColumn("licence", let(normal_form(F.col(text)), found))


def op10_license_scans(df: DataFrame) -> DataFrame:
    """The contract's digest: one row for each document."""
    out = detect(df.select("doc_id", "text"))
    base = F.filter("licence.hits", lambda h: h["base"])
    base_labels = F.array_distinct(F.transform(base, lambda h: h["label"]))
    return out.withColumn("b", base).select(
        "doc_id",
        "licence.n_words",
        F.size("b").cast("long").alias("n_base"),
        F.array_min(F.transform("b", lambda h: h["start"])).alias("first_word"),
        F.array_max(F.transform("b", lambda h: h["start"])).alias("last_word"),
        F.array_join(F.sort_array(base_labels), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(F.col("licence.labels"), base_labels)), ",").alias("labels"),
        "licence.score",
    )


def oracle() -> str:
    """DuckDB SQL for `op10_license_scans`: the patterns as they are written, between word boundaries of a plain text.

    Characters beyond ASCII are made to count as word characters; priorities follow each other as one step each.
    """
    rules = ", ".join(f"('{r.pattern}', '{r.label}', {k}, {r.priority}, {r.confidence}::double, {r.base})" for k, r in enumerate(signatures()))
    levels = sorted({r.priority for r in signatures()})
    steps, kept = [], "(select * from p where false)"
    for n in levels:
        steps.append(f"""
o{n} as (select * from p where priority = {n} and not exists (select 1 from {kept} k where k.rid = p.rid and k.s < p.s + p.w and k.s + k.w > p.s)),
k{n} as (select * from o{n} a where not exists (select 1 from o{n} b where b.rid = a.rid and b.s <= a.s and b.s + b.w >= a.s + a.w
         and (b.s < a.s or b.s + b.w > a.s + a.w or b.ord < a.ord)))""")
        kept = "(" + " union all ".join(f"select * from k{m}" for m in levels if m <= n) + ")"
    return rf"""
with rules(pattern, label, ord, priority, confidence, base) as (values {rules}),
d as (select row_number() over () as rid, doc_id,
             trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) as s from documents),
n as (select rid, doc_id, regexp_replace(s, '[^a-z0-9 ]', '_', 'g') as t from d),
m as (select rid, label, ord, priority, confidence, base, regexp_extract_all(t, '\b(?:' || pattern || ')\b') as found,
             regexp_split_to_array(t, '\b(?:' || pattern || ')\b') as gaps from n, rules where regexp_matches(t, '\b(?:' || pattern || ')\b')),
h as (select rid, label, ord, priority, confidence, base, unnest(range(1, len(found) + 1)) as k, found, gaps from m),
p as (select rid, label, ord, priority, confidence, base,
             list_sum(list_transform(gaps[1:k], lambda x: len(regexp_extract_all(x, '[^ ]+'))))
             + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: len(regexp_extract_all(x, '[^ ]+')))), 0) as s,
             len(regexp_extract_all(found[k], '[^ ]+')) as w from h),{",".join(steps)},
b as (select rid, count(*) as n_base, min(s) as first_word, max(s) as last_word, list_distinct(list(label)) as b from p where base group by rid),
l as (select rid, list_distinct(list(label)) as l, max(confidence) as score from {kept} group by rid)
select doc_id, len(regexp_extract_all(t, '[^ ]+'))::bigint as n_words, coalesce(n_base, 0) as n_base,
       cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
       coalesce(array_to_string(list_sort(b), ','), '') as base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b, []), coalesce(l, [])))), ','), '') as labels, coalesce(score, 0.0) as score
from n left join b using (rid) left join l using (rid)
"""
