"""License scans by ordered signature rules (operator 11).

A text is reduced to its words, joined by single spaces. Rules are regular expressions over
that string, each behind words that a match must hold: only rules whose words all occur are
run. Rules are ordered. Where one place lies inside another, the earlier rule's stays (of
one rule, the longer place); places that overlap otherwise both stay. The three base
phrases are rules that stand apart: they neither suppress nor are suppressed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import id_and_text

#: A word's bytes: digits, ASCII letters, lower-cased, and everything beyond ASCII; others end it.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

#: The base phrases and their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))


class License(NamedTuple):
    """Regular expressions over words: how a license is called, its short identifiers, and parts of
    addresses. Each of them holds one of the words ``keys``."""

    label: str
    name: str
    ids: str
    url: str
    keys: str


V = r"(?:version |v )?"
LIC = r"(?:public )?licen[cs]e"
#: From the special to the general: a name inside a longer one belongs to the license before it.
LICENSES = (
    License("agpl-3", rf"(?:gnu )?affero general {LIC} {V}v?3(?: 0)?(?: or (?:any )?later(?: version)?| only)?|gnu agpl ?v?3", r"agpl ?v?3(?: 0)?(?: or later| only)?", "gnu org licenses agpl 3 0", "affero agpl agpl3 agplv3"),
    License("agpl", rf"(?:gnu )?affero general {LIC}", "agpl", "gnu org licenses agpl", "affero agpl"),
    License("lgpl-2.1", rf"(?:gnu )?lesser general {LIC} {V}v?2 1(?: or (?:any )?later(?: version)?| only)?|gnu lgpl ?v?2 1", r"lgpl ?v?2 1(?: or later| only| plus)?", "gnu org licenses (?:old licenses )?lgpl 2 1", "lesser lgpl lgpl2 lgplv2"),
    License("lgpl-2", rf"(?:gnu )?library general {LIC} {V}v?2(?: 0)?|gnu lgpl ?v?2(?: 0)?", r"lgpl ?v?2(?: 0)?(?: or later| only| plus)?", "gnu org licenses (?:old licenses )?lgpl 2 0", "library lgpl lgpl2 lgplv2"),
    License("lgpl-3", rf"(?:gnu )?lesser general {LIC} {V}v?3(?: 0)?(?: or (?:any )?later(?: version)?| only)?|gnu lgpl ?v?3", r"lgpl ?v?3(?: 0)?(?: or later| only| plus)?", "gnu org licenses lgpl 3 0", "lesser lgpl lgpl3 lgplv3"),
    License("lgpl", rf"(?:gnu )?(?:lesser|library) general {LIC}", "lgpl", "gnu org (?:licenses|copyleft) lgpl", "lesser library lgpl"),
    License("gfdl-1.3", rf"(?:gnu )?free documentation licen[cs]e {V}1 3", r"gfdl ?1 3(?: or later| only)?", "gnu org licenses fdl 1 3", "documentation gfdl gfdl1 fdl"),
    License("gfdl", r"(?:gnu )?free documentation licen[cs]e", "gfdl", "gnu org (?:licenses|copyleft) fdl", "documentation gfdl fdl"),
    License("gpl-1", rf"gnu general {LIC} {V}v?1(?: 0)?", r"gpl ?v?1(?: 0)?(?: or later| only| plus)?", "gnu org licenses (?:old licenses )?gpl 1 0", "gnu gpl gpl1 gplv1"),
    License("gpl-2", rf"gnu general {LIC}(?: gpl)? {V}v?2(?: 0)?(?: or (?:any )?later(?: version)?| only)?|gnu gpl ?v?2", r"gpl ?v?2(?: 0)?(?: or later| only| plus)?", "gnu org licenses (?:old licenses )?gpl 2 0", "gnu gpl gpl2 gplv2"),
    License("gpl-3", rf"gnu general {LIC}(?: gpl)? {V}v?3(?: 0)?(?: or (?:any )?later(?: version)?| only)?|gnu gpl ?v?3", r"gpl ?v?3(?: 0)?(?: or later| only| plus)?", "gnu org licenses gpl 3 0", "gnu gpl gpl3 gplv3"),
    License("gpl", rf"gnu general {LIC}|gnu gpl", "gpl", "gnu org (?:licenses|copyleft) gpl", "gnu gpl"),
    License("mit-0", r"mit no attribution(?: licen[cs]e)?", "mit 0", "", "mit"),
    License("mit", r"mit (?:x11 |expat )?licen[cs]e|(?:x11|expat) licen[cs]e", "mit", "opensource org licen[cs]es? mit", "mit x11 expat"),
    License("apache-2", rf"apache (?:software )?licen[cs]e {V}v?2(?: 0)?|apache licen[cs]e 2 0", "apache(?: license)? 2(?: 0)?", "apache org licen[cs]es license 2 0", "apache"),
    License("apache-1.1", rf"apache (?:software )?licen[cs]e {V}1 1", "apache 1 1", "apache org licen[cs]es license 1 1", "apache"),
    License("apache-1", rf"apache (?:software )?licen[cs]e {V}1 0", "apache 1 0", "apache org licen[cs]es license 1 0", "apache"),
    License("apache", r"apache (?:software )?licen[cs]e", "apache", "apache org licen[cs]es", "apache"),
    License("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|four clause bsd|original bsd)(?: licen[cs]e)?", "bsd 4 clause", "", "bsd"),
    License("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)?", "bsd 3 clause(?: clear)?", "opensource org licen[cs]es? bsd 3 clause", "bsd"),
    License("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)(?: licen[cs]e)", "bsd 2 clause(?: patent| views)?", "opensource org licen[cs]es? bsd 2 clause", "bsd freebsd"),
    License("0bsd", r"(?:zero clause bsd|0 clause bsd|bsd zero clause)(?: licen[cs]e)?", "0bsd", "opensource org licen[cs]es? 0bsd", "bsd 0bsd"),
    License("bsd", r"bsd (?:style )?licen[cs]e", "bsd", "opensource org licen[cs]es? bsd", "bsd"),
    License("isc", r"isc licen[cs]e", "isc", "opensource org licen[cs]es? isc", "isc"),
    License("mpl-2", rf"mozilla {LIC} {V}v?2(?: 0)?", r"mpl v?2(?: 0)?(?: no copyleft exception)?", "mozilla org mpl 2 0", "mozilla mpl"),
    License("mpl-1.1", rf"mozilla {LIC} {V}v?1 1", r"mpl v?1 1", "mozilla org mpl 1 1", "mozilla mpl"),
    License("mpl", rf"mozilla {LIC}", "mpl", "mozilla org mpl", "mozilla mpl"),
    License("epl-2", rf"eclipse {LIC} {V}v?2(?: 0)?", "epl v?2(?: 0)?", "eclipse org legal epl (?:v20|2 0)", "eclipse epl"),
    License("epl-1", rf"eclipse {LIC} {V}v?1(?: 0)?", "epl v?1(?: 0)?", "eclipse org legal epl v10", "eclipse epl"),
    License("epl", rf"eclipse {LIC}", "epl", "eclipse org legal epl", "eclipse epl"),
    License("edl-1", rf"eclipse distribution licen[cs]e(?: {V}v?1(?: 0)?)?", "edl 1(?: 0)?", "eclipse org org documents edl", "eclipse edl"),
    License("cddl-1.1", rf"common development and distribution licen[cs]e(?: cddl)? {V}v?1 1", "cddl 1 1", "", "development cddl"),
    License("cddl-1", rf"common development and distribution licen[cs]e(?: cddl)?(?: {V}v?1(?: 0)?)?", "cddl(?: 1(?: 0)?)?", "opensource org licen[cs]es? cddl", "development cddl"),
    License("cpl-1", rf"common {LIC} {V}v?1(?: 0)?", "cpl 1(?: 0)?", "opensource org licen[cs]es? cpl", "common cpl"),
    License("cpal-1", r"common public attribution licen[cs]e(?: version)?(?: 1(?: 0)?)?", "cpal 1(?: 0)?", "", "attribution cpal"),
    License("eupl-1.2", rf"european union {LIC}(?: eupl)? {V}v?1 2", r"eupl v?1 2", "", "european eupl"),
    License("eupl", rf"european union {LIC}(?: eupl)?", "eupl", "joinup ec europa eu [^ ]+ eupl", "european eupl"),
    License("artistic-2", r"(?:perl )?artistic licen[cs]e (?:version |v )?2(?: 0)?", "artistic 2(?: 0)?", "perlfoundation org artistic license 2 0", "artistic"),
    License("artistic-1", r"(?:perl )?artistic licen[cs]e(?: (?:version |v )?1(?: 0)?)?", "artistic 1(?: 0)?(?: perl| cl8)?", "opensource org licen[cs]es? artistic license", "artistic"),
    License("boost-1", r"boost software licen[cs]e(?: (?:version |v )?1(?: 0)?)?", "bsl 1(?: 0)?", "boost org license 1 0", "boost bsl"),
    License("busl-1.1", r"business source licen[cs]e(?: (?:version )?1 1)?", "busl 1 1", "mariadb com bsl11", "business busl bsl11"),
    License("sspl-1", rf"server side {LIC}(?: {V}v?1)?", "sspl(?: 1(?: 0)?)?", "mongodb com licensing server side public license", "server sspl"),
    License("elastic-2", r"elastic licen[cs]e(?: (?:version |v )?2(?: 0)?)?", "elastic 2(?: 0)?", "elastic co licensing elastic license", "elastic"),
    License("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib", "zlib net zlib license", "zlib"),
    License("libpng", r"libpng licen[cs]e", "libpng(?: 2 0)?", "libpng org pub png src libpng license", "libpng"),
    License("unlicense", r"the unlicense|unlicense org", "unlicense", "unlicense org", "unlicense"),
    License("wtfpl", rf"do what the fuck you want to {LIC}", "wtfpl", "wtfpl net", "fuck wtfpl"),
    License("cc0-1", r"cc0(?: 1 0)?(?: universal)?|creative commons zero(?: v?1 0)?(?: universal)?", "cc0(?: 1 0)?", "creativecommons org publicdomain zero 1 0", "cc0 zero publicdomain"),
    License("cc-by-nc-sa", r"cc by nc sa(?: [1-4](?: [05])?)?|creative commons attribution non ?commercial share ?alike(?: [1-4](?: [05])?)?", "cc by nc sa(?: [1-4](?: [05])?)?", "creativecommons org licenses by nc sa", "cc creative creativecommons"),
    License("cc-by-nc-nd", r"cc by nc nd(?: [1-4](?: [05])?)?|creative commons attribution non ?commercial no ?deriv(?:atives|s)?(?: [1-4](?: [05])?)?", "cc by nc nd(?: [1-4](?: [05])?)?", "creativecommons org licenses by nc nd", "cc creative creativecommons"),
    License("cc-by-nc", r"cc by nc(?: [1-4](?: [05])?)?|creative commons attribution non ?commercial(?: [1-4](?: [05])?)?", "cc by nc(?: [1-4](?: [05])?)?", "creativecommons org licenses by nc", "cc creative creativecommons"),
    License("cc-by-sa", r"cc by sa(?: [1-4](?: [05])?)?|creative commons attribution share ?alike(?: [1-4](?: [05])?)?", "cc by sa(?: [1-4](?: [05])?)?", "creativecommons org licenses by sa", "cc creative creativecommons"),
    License("cc-by-nd", r"cc by nd(?: [1-4](?: [05])?)?|creative commons attribution no ?deriv(?:atives|s)?(?: [1-4](?: [05])?)?", "cc by nd(?: [1-4](?: [05])?)?", "creativecommons org licenses by nd", "cc creative creativecommons"),
    License("cc-by", r"cc by [1-4] [05]|creative commons attribution(?: [1-4] [05])?(?: international| generic| unported)?", "cc by(?: [1-4] [05])?", "creativecommons org licenses by", "cc creative creativecommons"),
    License("odbl-1", r"open database licen[cs]e(?: (?:version |v )?1(?: 0)?)?", "odbl(?: 1 0)?", "opendatacommons org licenses odbl", "database odbl"),
    License("odc-by-1", r"open data commons attribution licen[cs]e", "odc by(?: 1 0)?", "opendatacommons org licenses by", "commons odc opendatacommons"),
    License("pddl-1", r"(?:open data commons )?public domain dedication and licen[cs]e", "pddl(?: 1 0)?", "opendatacommons org licenses pddl", "dedication pddl"),
    License("ofl-1.1", r"sil open font licen[cs]e(?: (?:version )?1 1)?", "ofl(?: 1 1)?", "scripts sil org ofl", "sil ofl"),
    License("psf-2", r"python software foundation licen[cs]e(?: (?:version )?2)?", "(?:psf|python) 2 0", "docs python org [^ ]+ license", "python psf"),
    License("php-3", r"php licen[cs]e(?: (?:version |v )?3(?: 0(?:1)?)?)?", "php 3(?: 0| 01)?", "php net license 3", "php"),
    License("ruby", r"ruby licen[cs]e", "ruby", "ruby lang org [^ ]+ license", "ruby"),
    License("openssl", r"openssl(?: and ssleay| ssleay)? licen[cs]e", "openssl", "openssl org source license", "openssl"),
    License("postgresql", r"postgresql licen[cs]e", "postgresql", "opensource org licen[cs]es? postgresql", "postgresql"),
    License("ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", "ncsa", "opensource org licen[cs]es? uoi ncsa", "ncsa"),
    License("w3c", r"w3c software(?: notice)?(?: and)?(?: document)? licen[cs]e", "w3c(?: 2015\\d+)?", "w3 org consortium legal", "w3c w3"),
    License("ms-pl", rf"microsoft {LIC}(?: ms pl)?", "ms pl", "opensource org licen[cs]es? ms pl", "microsoft ms"),
    License("ms-rl", r"microsoft reciprocal licen[cs]e", "ms rl", "opensource org licen[cs]es? ms rl", "microsoft ms"),
    License("osl-3", r"open software licen[cs]e(?: (?:version |v )?3(?: 0)?)?", "osl 3(?: 0)?", "opensource org licen[cs]es? osl 3 0", "open osl"),
    License("afl-3", r"academic free licen[cs]e(?: (?:version |v )?3(?: 0)?)?", "afl 3(?: 0)?", "opensource org licen[cs]es? afl 3 0", "academic afl"),
    License("upl-1", r"universal permissive licen[cs]e(?: (?:version |v )?1(?: 0)?)?", "upl 1(?: 0)?", "oss oracle com licenses upl", "universal upl"),
    License("cecill-2.1", r"cecill (?:free software )?licen[cs]e(?: agreement)?", "cecill(?: [bc])?(?: 2(?: [01])?)?", "cecill info licences", "cecill"),
    License("mulan-2", rf"mulan (?:permissive software|psl) licen[cs]e(?: {V}v?2)?|mulan psl v2", "mulanpsl 2(?: 0)?", "license coscl org cn mulanpsl2", "mulan mulanpsl mulanpsl2"),
    License("hippocratic", r"hippocratic licen[cs]e", "hippocratic 2 1", "firstdonoharm dev", "hippocratic firstdonoharm"),
    License("openrail", r"(?:creativeml |bigscience |bigcode )?open ?rail(?: m)? licen[cs]e", "(?:creativeml |bigscience |bigcode )?openrail(?: m)?", "huggingface co spaces [^ ]+ license", "openrail rail huggingface"),
    License("llama", r"llama(?: [234](?: [123])?)? community licen[cs]e(?: agreement)?", "llama[234](?: [123])?", "llama meta com license", "llama llama2 llama3 llama4"),
)

#: Sentences of license texts: label, words that must occur, expression.
SENTENCES = (
    ("mit", "permission granted charge obtaining", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "copyright permission substantial portions", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission modify granted distribute", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution binary source permitted", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse promote derived", r"neither the name of [^ ]+(?: [^ ]+){0,12} nor the names of its contributors may be used to endorse or promote products derived from"),
    ("bsd-4-clause", "advertising acknowledgement", r"all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("apache-2", "writing applicable agreed basis", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", "file compliance license", r"you may not use this file except in compliance with the license"),
    ("gpl-3", "redistribute modify gnu general 3", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2", "redistribute modify gnu general 2", r"you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2"),
    ("gpl", "warranty merchantability gnu", r"without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("lgpl-2.1", "redistribute modify lesser 2 1", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3", "redistribute modify lesser 3", r"you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3"),
    ("agpl-3", "affero redistribute modify 3", r"you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3"),
    ("gfdl", "documentation permission granted document", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "source form mozilla subject", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "contents file mozilla subject", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2", "accompanying eclipse materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl-1", "accompanying eclipse materials", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("cddl-1", "contents file common development", r"the contents of this file are subject to the terms of (?:either the gnu general public license version 2 only gpl or )?the common development and distribution license"),
    ("boost-1", "boost distributed software", r"distributed under the boost software license version 1 0"),
    ("zlib", "misrepresented origin software", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered versions plainly misrepresented", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", "unencumbered public domain", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "fuck want", r"you just do what the fuck you want to"),
    ("cc0-1", "waived copyright neighboring extent", r"to the extent possible under law [^ ]+(?: [^ ]+){0,12} waived all copyright and related or neighboring rights"),
    ("ofl-1.1", "font sil licensed", r"this font software is licensed under the sil open font license"),
    ("ofl-1.1", "font reserved modified", r"no modified version of the font software may use the reserved font name"),
    ("artistic-2", "permitted standard version", r"you are permitted to use the standard version and create and use modified versions for any purpose without restriction"),
    ("psf-2", "psf python making available", r"psf is making python available to licensee on an as is basis"),
    ("openssl", "openssl toolkit product includes", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("postgresql", "permission modify documentation agreement", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("sspl-1", "service functionality program third", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("busl-1.1", "change date anniversary", r"effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("ms-pl", "patent claim contributor infringed", r"if you bring a patent claim against any contributor over patents that you claim are infringed by the software"),
    ("cc-by", "appropriate credit indicate", r"you must give appropriate credit provide a link to the license and indicate if changes were made"),
    ("cc-by-nc", "material commercial purposes", r"you may not use the material for commercial purposes"),
    ("cc-by-sa", "remix transform build contributions", r"if you remix transform or build upon the material you must distribute your contributions under the same license"),
    ("cc-by-nd", "remix transform distribute modified", r"if you remix transform or build upon the material you may not distribute the modified material"),
    ("public-domain", "dedicated public domain", r"(?:has been|is|are|hereby) dedicated to the public domain"),
    ("public-domain", "placed public domain", r"(?:has been|is|are|hereby) placed (?:in|into) the public domain"),
    ("public-domain", "released public domain", r"(?:has been|is|are|hereby) released (?:in|into|to) the public domain"),
    ("proprietary", "unauthorized copying prohibited", r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", "proprietary confidential", r"proprietary and confidential"),
)

TERMS = r"(?:the )?(?:terms (?:and conditions )?of )?(?:the )?"
GRANTS = ("licensed", "licenced", "relicensed", "released", "distributed", "redistributed", "available", "published", "provided", "offered", "covered", "governed", "shared", "used")
POINTERS = ("see", "read", "accept", "accepts", "accepting", "agree to", "subject to", "compliance with", "copy of", "conditions of", "according to", "refer to", "governed by")
#: How a license is named: form, expression around the name (N), identifier (I) or address (U), sets of words of which one each must occur besides, weight.
FORMS = (
    ("identifier", "spdx license identifier (?:I)", ("spdx", "identifier"), 0.99),
    ("notice", rf"(?:{'|'.join(GRANTS)})(?: [^ ]+){{0,4}}? (?:under|by) {TERMS}(?:N|I)", (" ".join(GRANTS), "under by"), 0.95),
    ("address", "U", (), 0.9),
    ("field", r"licen[cs]e(?: (?:type|name|id|text|spdx|expression))? (?:I)(?: licen[cs]e)?", ("license licence",), 0.8),
    ("reference", rf"(?:{'|'.join(POINTERS)}) {TERMS}(?:N)", (" ".join(p.split()[0] for p in POINTERS),), 0.75),
    ("name", "N", (), 0.6),
)
BASE_WEIGHT, SENTENCE_WEIGHT = 0.97, 0.98


@dataclass(frozen=True)
class Rule:
    """``needs``: sets of words; a match holds one word of each."""

    label: str
    form: str
    needs: tuple[frozenset[bytes], ...]
    pattern: re.Pattern
    weight: float
    base: bool = False


def rule(label: str, form: str, needs: tuple[str, ...], pattern: str, weight: float, base: bool = False) -> Rule:
    # the space before a match belongs to it and the one after does not, so matches stand on whole words
    return Rule(label, form, tuple(frozenset(n.encode().split()) for n in needs), re.compile(f" (?:{pattern})(?= )".encode()), weight, base)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in order: base phrases, sentences, then each form of every license."""
    out = [rule(label, "base", tuple(phrase.split()), phrase, BASE_WEIGHT, True) for label, phrase in BASE]
    out += [rule(label, "sentence", tuple(needs.split()), pattern, SENTENCE_WEIGHT) for label, needs, pattern in SENTENCES]
    for form, shape, besides, weight in FORMS:
        for x in LICENSES:
            if x.url or form != "address":
                own = re.sub(r"\b[NIU]\b", lambda m: {"N": x.name, "I": x.ids, "U": x.url}[m[0]], shape)
                out.append(rule(x.label, form, (*besides, x.keys), own, weight))
    return tuple(out)


class Place(NamedTuple):
    first: int
    end: int
    order: int


def settled(places: list[Place], longest: int) -> list[Place]:
    """Places left after suppression, in rule order, longer ones first.

    A place goes if one taken before lies inside it or around it. Places are at most
    ``longest`` words long, so only those that start near it are looked at.
    """
    by_start = sorted(set(places))
    starts = [p.first for p in by_start]
    taken = [False] * len(by_start)
    out = []
    for k in sorted(range(len(by_start)), key=lambda k: (by_start[k].order, by_start[k].first - by_start[k].end, by_start[k].first)):
        p, clash = by_start[k], False
        j = bisect_left(starts, p.first - longest)
        while j < len(by_start) and starts[j] < p.end and not clash:
            q = by_start[j]
            clash = taken[j] and (q.first <= p.first and p.end <= q.end or p.first <= q.first and q.end <= p.end)
            j += 1
        if not clash:
            taken[k] = True
            out.append(p)
    return out


def scan(text: bytes) -> tuple[int, list[Place], list[Place]]:
    """Number of words, the places of base phrases, and the places left of all rules."""
    words = text.translate(WORD_BYTES).split()
    known = rules()
    met = keywords().intersection(words)
    gated = [k for k, r in enumerate(known) if all(not n.isdisjoint(met) for n in r.needs)] if met else []
    found: list[tuple[int, int, int]] = []
    if gated:
        line = b" " + b" ".join(words) + b" "
        for k in gated:
            found += [(m.start(), m.end(), k) for m in known[k].pattern.finditer(line)]
    if not found:
        return len(words), [], []
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    firsts, ends = np.searchsorted(gaps, [f[0] for f in found]).tolist(), np.searchsorted(gaps, [f[1] for f in found]).tolist()
    places = [Place(a, b, k) for a, b, (_, _, k) in zip(firsts, ends, found)]
    base = [p for p in places if known[p.order].base]
    return len(words), base, base + settled([p for p in places if not known[p.order].base], max(p.end - p.first for p in places))


@lru_cache(maxsize=1)
def keywords() -> frozenset[bytes]:
    return frozenset(w for r in rules() for n in r.needs for w in n)


DETECTION = pa.struct([("label", pa.string()), ("form", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("weight", pa.float64())])
SCAN_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("base", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))), ("detections", pa.list_(DETECTION)),
])
SCAN_DDL = "doc_id bigint, n_words bigint, base array<struct<label:string,first_word:bigint>>, detections array<struct<label:string,form:string,first_word:bigint,last_word:bigint,weight:double>>"
BATCH = 2048


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, base, detections): where licenses are named in every whole text.

    ``base`` has all places of the base phrases; ``detections`` what suppression leaves, base
    places among it, by first word. One row per row of ``docs``, nothing is shuffled: null ids
    and repeated rows pass through, a null text is empty and has no words, an empty table gives
    no rows, other columns are not read. A text is held whole with its words, one at a time.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rules()
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                some = batch.slice(at, BATCH)
                columns: tuple[list, list, list] = ([], [], [])
                for text in some.column(1).cast(pa.binary()):
                    n, base, places = scan(text.as_py())
                    columns[0].append(n)
                    columns[1].append([{"label": known[p.order].label, "first_word": p.first} for p in sorted(base)])
                    columns[2].append([{"label": known[p.order].label, "form": known[p.order].form, "first_word": p.first, "last_word": p.end - 1, "weight": known[p.order].weight} for p in sorted(places)])
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(SCAN_ARROW)[1:]))], schema=SCAN_ARROW)

    return id_and_text(docs, id_col, text_col).mapInArrow(scanned, SCAN_DDL)


def license_digest(scanned: DataFrame) -> DataFrame:
    """Counts, labels and a score of each scanned text.

    The score is the chance that not all of its labels are mistaken, each label weighed by its
    surest place: 0 without one.
    """
    label = lambda column: F.array_sort(F.array_distinct(F.transform(column, lambda d: d["label"])))
    first = F.transform("base", lambda d: d["first_word"])
    doubt = lambda name: 1 - F.array_max(F.transform(F.filter("detections", lambda d: d["label"] == name), lambda d: d["weight"]))
    score = 1 - F.aggregate(F.transform(label("detections"), doubt), F.lit(1.0), lambda s, x: s * x)
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        F.array_join(label("base"), ",").alias("base_labels"), F.array_join(label("detections"), ",").alias("labels"), score.alias("score"), F.size("detections").cast("long").alias("n_detections"),
    )
