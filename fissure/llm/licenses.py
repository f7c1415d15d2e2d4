"""License scans: ordered signature rules with keyword gates, priorities and containment."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fissure.llm.shared import kept_in_process, small_batches, table
from fissure.llm.words import ALNUM, spans

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Licenses with the versions that exist. Label, full names (a regular expression on words), short names,
#: versions, and words of which every text with one of the names holds one, divided by |.
LICENSES = [
    ("gpl", r"gnu general public licen[sc]e", r"gnu gpl|gpl", "1 2 3", b"gnu|gpl"),
    ("lgpl", r"gnu (?:lesser|library) general public licen[sc]e", r"gnu lgpl|lgpl", "2 2.1 3", b"gnu|lgpl"),
    ("agpl", r"gnu affero general public licen[sc]e|affero general public licen[sc]e", r"affero gpl|agpl", "1 3", b"affero|agpl"),
    ("gfdl", r"gnu free documentation licen[sc]e", r"gfdl|gnu fdl", "1.1 1.2 1.3", b"gnu|gfdl"),
    ("apache", r"apache (?:software )?licen[sc]e", r"", "1 1.1 2", b"apache"),
    ("mpl", r"mozilla public licen[sc]e", r"mpl", "1 1.1 2", b"mozilla|mpl"),
    ("epl", r"eclipse public licen[sc]e", r"epl", "1 2", b"eclipse|epl"),
    ("cddl", r"common development and distribution licen[sc]e", r"cddl", "1 1.1", b"common development|cddl"),
    ("cpl", r"common public licen[sc]e", r"", "1", b"common public"),
    ("cpal", r"common public attribution licen[sc]e", r"cpal", "1", b"attribution|cpal"),
    ("eupl", r"european union public licen[sc]e", r"eupl", "1 1.1 1.2", b"european|eupl"),
    ("afl", r"academic free licen[sc]e", r"", "1.1 1.2 2 2.1 3", b"academic"),
    ("osl", r"open software licen[sc]e", r"", "1 1.1 2 2.1 3", b"open software"),
    ("artistic", r"artistic licen[sc]e", r"", "1 2", b"artistic"),
    ("ofl", r"sil open font licen[sc]e|open font licen[sc]e", r"sil ofl|ofl", "1 1.1", b"font|ofl"),
    ("lppl", r"latex project public licen[sc]e", r"lppl", "1 1.1 1.2 1.3 1.3a 1.3c", b"latex|lppl"),
    ("zpl", r"zope public licen[sc]e", r"zpl", "1.1 2 2.1", b"zope|zpl"),
    ("psf", r"python software foundation licen[sc]e|psf licen[sc]e", r"", "2", b"python|psf"),
    ("python", r"python licen[sc]e", r"", "2", b"python"),
    ("php", r"php licen[sc]e", r"", "3 3.01", b"php"),
    ("boost", r"boost software licen[sc]e", r"", "1", b"boost"),
    ("cecill", r"cecill(?: free software)? licen[sc]e", r"cecill", "1 1.1 2 2.1", b"cecill"),
    ("odbl", r"open (?:data commons open )?database licen[sc]e", r"odbl", "1", b"database|odbl"),
    ("odc-by", r"open data commons attribution licen[sc]e", r"odc by", "1", b"open data|odc"),
    ("pddl", r"(?:open data commons )?public domain dedication and licen[sc]e", r"pddl", "1", b"dedication|pddl"),
    ("ms-pl", r"microsoft public licen[sc]e", r"ms pl", "", b"microsoft|ms pl"),
    ("ms-rl", r"microsoft reciprocal licen[sc]e", r"ms rl", "", b"microsoft|ms rl"),
    ("ncsa", r"(?:university of illinois )?ncsa open source licen[sc]e", r"", "", b"ncsa"),
    ("postgresql", r"postgresql licen[sc]e", r"", "", b"postgresql"),
    ("openssl", r"openssl licen[sc]e", r"", "", b"openssl"),
    ("unicode", r"unicode licen[sc]e(?: agreement)?", r"", "3", b"unicode"),
    ("w3c", r"w3c (?:software )?(?:notice and )?licen[sc]e", r"", "", b"w3c"),
    ("mit", r"mit licen[sc]e|expat licen[sc]e|mit x11 licen[sc]e", r"", "", b"mit|expat"),
    ("x11", r"x11 licen[sc]e", r"", "", b"x11"),
    ("isc", r"isc licen[sc]e", r"", "", b"isc"),
    ("zlib", r"zlib(?: libpng)? licen[sc]e", r"", "", b"zlib"),
    ("libpng", r"libpng licen[sc]e", r"", "2", b"libpng"),
    ("ijg", r"independent jpeg group licen[sc]e", r"", "", b"jpeg"),
    ("ftl", r"freetype (?:project )?licen[sc]e", r"", "", b"freetype"),
    ("vim", r"vim licen[sc]e", r"", "", b"vim"),
    ("curl", r"curl licen[sc]e", r"", "", b"curl"),
    ("ruby", r"ruby licen[sc]e", r"", "", b"ruby"),
    ("sleepycat", r"sleepycat licen[sc]e", r"", "", b"sleepycat"),
    ("ipl", r"ibm public licen[sc]e", r"", "1", b"ibm"),
    ("apsl", r"apple public source licen[sc]e", r"apsl", "1 1.1 1.2 2", b"apple|apsl"),
    ("upl", r"universal permissive licen[sc]e", r"", "1", b"permissive"),
    ("blueoak", r"blue oak model licen[sc]e", r"", "1", b"blue oak"),
    ("mulan", r"mulan (?:permissive software )?(?:psl|licen[sc]e)", r"mulanpsl", "1 2", b"mulan|mulanpsl"),
    ("busl", r"business source licen[sc]e", r"busl", "1.1", b"business source|busl"),
    ("sspl", r"server side public licen[sc]e", r"sspl", "1", b"server side|sspl"),
    ("elastic", r"elastic licen[sc]e", r"", "2", b"elastic"),
    ("openrail", r"(?:bigscience |creativeml )?open ?rail(?: m)? licen[sc]e|(?:bigscience|creativeml) open ?rail(?: m)?|openrail(?: m)?", r"", "", b"openrail|rail"),
    ("wtfpl", r"do what the fuck you want to public licen[sc]e", r"wtfpl", "2", b"you want to|wtfpl"),
    ("unlicense", r"the unlicense|unlicense org", r"", "", b"unlicense"),
]
#: Licenses whose full names are everyday words too: they count where a text refers to them, not by themselves.
EVERYDAY = {"artistic", "python", "elastic", "ruby", "curl", "vim", "unicode", "php"}
#: Short names whose versions need a point or the word version, as bare numbers follow such letters elsewhere.
STRICT = {"epl", "zpl", "psf", "upl"}
#: Identifiers as tags and short references spell them, by label; a word that all spellings hold.
IDENTIFIERS = [
    ("mit", "mit", "mit"), ("isc", "isc", "isc"), ("zlib", "zlib", "zlib"), ("bsd", "bsd", "bsd"), ("bsd-2", "bsd 2 clause", "bsd"), ("bsd-3", "bsd 3 clause", "bsd"), ("bsd-4", "bsd 4 clause", "bsd"), ("bsd-0", "0bsd", "0bsd"),
    ("apache-2", "apache (?:version |v ?)?2(?: 0)?", "apache"), ("apache-2", "asl (?:version |v ?)?2(?: 0)?", "asl"), ("apache-1.1", "apache 1 1", "apache"), ("gpl-2", "gpl 2(?: 0)?(?: only| or later)?", "gpl"), ("gpl-3", "gpl 3(?: 0)?(?: only| or later)?", "gpl"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", "lgpl"), ("lgpl-3", "lgpl 3(?: 0)?(?: only| or later)?", "lgpl"), ("agpl-3", "agpl 3(?: 0)?(?: only| or later)?", "agpl"), ("mpl-1.1", "mpl 1 1", "mpl"), ("mpl-2", "mpl 2(?: 0)?", "mpl"),
    ("epl-1", "epl 1 0", "epl"), ("epl-2", "epl 2 0", "epl"), ("cc0", "cc0(?: 1 0)?(?: universal)?", "cc0"), ("unlicense", "unlicense", "unlicense"), ("boost-1", "bsl 1 0", "bsl"), ("cc-by-4.0", "cc by 4 0", "cc"),
    ("cc-by-sa-4.0", "cc by sa 4 0", "cc"), ("cc-by-nc-4.0", "cc by nc 4 0", "cc"), ("wtfpl", "wtfpl", "wtfpl"), ("artistic-2", "artistic 2 0", "artistic"), ("ofl-1.1", "ofl 1 1", "ofl"), ("eupl-1.2", "eupl 1 2", "eupl"),
    ("ncsa", "ncsa", "ncsa"), ("psf-2", "psf 2 0", "psf"), ("python-2", "python 2 0", "python"), ("zpl-2.1", "zpl 2 1", "zpl"), ("ms-pl", "ms pl", "pl"), ("cddl-1", "cddl 1 0", "cddl"), ("busl-1.1", "busl 1 1", "busl"), ("postgresql", "postgresql", "postgresql"),
]
#: Short references: pattern around an identifier, words of which a text holds one besides, priority, weight.
REFERENCES = [
    ("(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{id})", "licensed licenced released distributed available published", 3, 0.9),
    ("(?:{id}) licen[sc]ed", "licensed licenced", 3, 0.9),
    ("licen[sc]e (?:is )?(?:the )?(?:{id})", "license licence", 2, 0.8),
    ("(?:{id}) licen[sc]e", "license licence", 2, 0.8),
]
#: An identifier anywhere in the expression behind a tag; what counts as found is the identifier.
EXPRESSION = "spdx licen[sc]e identifier (?:(?:{any}) (?:or|and|with) ){{0,8}}({id})"
#: Creative Commons: element letters with their words.
CC_ELEMENTS = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative|ativework|atives|s)?(?: works)?"}
CC_KINDS = ["by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
#: Sentences of licenses, which need not name themselves. Label, words, keyword.
SENTENCES = [
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy of this software", b"hereby granted"),
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", b"hereby granted"),
    ("mit", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", b"substantial portions"),
    ("mit", r"the software is provided as is without warranty of any kind express or implied", b"warranty"),
    ("x11", r"except as contained in this notice the name of the x consortium shall not be used", b"x consortium"),
    ("isc", r"permission to use copy modify and or distribute this software for any purpose", b"permission to use"),
    ("isc", r"the software is provided as is and the author disclaims all warranties with regard to this software", b"disclaims all"),
    ("hpnd", r"permission to use copy modify and distribute this software and its documentation for any purpose", b"permission to use"),
    ("postgresql", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement", b"written agreement"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification", b"redistribution"),
    ("bsd", r"redistributions of source code must retain the above copyright notice", b"redistributions"),
    ("bsd", r"redistributions in binary form must reproduce the above copyright notice", b"redistributions"),
    ("bsd", r"this software is provided by the copyright holders and contributors as is", b"copyright holders"),
    ("bsd-3", r"neither the name of [^ ]+(?: [^ ]+){0,12} nor the names of its contributors", b"neither the name"),
    ("bsd-3", r"the name of the author may not be used to endorse or promote products derived from this software", b"endorse"),
    ("bsd-4", r"all advertising materials mentioning features or use of this software", b"advertising"),
    ("bsd-0", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided", b"permission to use"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event", b"in no event"),
    ("zlib", r"the origin of this software must not be misrepresented", b"misrepresented"),
    ("zlib", r"altered source versions must be plainly marked as such", b"plainly marked"),
    ("apache", r"unless required by applicable law or agreed to in writing software", b"applicable law"),
    ("apache-2", r"you may obtain a copy of the license at https? www apache org licenses license 2 0", b"apache"),
    ("apache-1.1", r"this product includes software developed by the apache software foundation", b"apache"),
    ("apache-2", r"licensed to the apache software foundation asf under one or more contributor license agreements", b"apache"),
    ("gpl", r"this program is free software you can redistribute it and or modify it", b"free software"),
    ("gpl", r"you should have received a copy of the gnu general public license along with this", b"should have received"),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", b"verbatim copies"),
    ("gpl-2", r"gnu general public license as published by the free software foundation (?:either )?version 2", b"free software foundation"),
    ("gpl-3", r"gnu general public license as published by the free software foundation (?:either )?version 3", b"free software foundation"),
    ("gpl-2", r"the licenses for most software are designed to take away your freedom to share and change it by contrast", b"take away your freedom"),
    ("gpl-3", r"the gnu general public license is a free copyleft license for software and other kinds of works", b"copyleft"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it", b"free software"),
    ("lgpl", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this", b"should have received"),
    ("lgpl-2.1", r"gnu lesser general public license as published by the free software foundation (?:either )?version 2 1", b"free software foundation"),
    ("lgpl-2", r"gnu library general public license as published by the free software foundation (?:either )?version 2", b"free software foundation"),
    ("lgpl-3", r"gnu lesser general public license as published by the free software foundation (?:either )?version 3", b"free software foundation"),
    ("agpl-3", r"gnu affero general public license as published by the free software foundation (?:either )?version 3", b"free software foundation"),
    ("agpl", r"you should have received a copy of the gnu affero general public license along with this", b"should have received"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", b"free documentation"),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts", b"invariant sections"),
    ("mpl-2", r"this source code form is subject to the terms of the mozilla public license v 2 0", b"mozilla"),
    ("mpl-1.1", r"the contents of this file are subject to the mozilla public license version 1 1", b"mozilla"),
    ("mpl", r"if a copy of the mpl was not distributed with this file you can obtain one at", b"mpl"),
    ("epl-1", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1 0", b"eclipse"),
    ("epl-2", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0", b"eclipse"),
    ("cddl", r"the contents of this file are subject to the terms of the common development and distribution license", b"common development"),
    ("artistic", r"the intent of this document is to state the conditions under which a package may be copied", b"state the conditions"),
    ("ofl", r"this font software is licensed under the sil open font license", b"font software"),
    ("ofl", r"the font software may be sold as part of a larger software package", b"font software"),
    ("lppl", r"this work may be distributed and or modified under the conditions of the latex project public license", b"latex"),
    ("php", r"this source file is subject to version 3 0?1? ?(?:1 )?of the php license", b"php"),
    ("boost", r"permission is hereby granted free of charge to any person or organization", b"hereby granted"),
    ("boost-1", r"distributed under the boost software license version 1 0", b"boost"),
    ("ncsa", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimers", b"disclaimers"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", b"unencumbered"),
    ("unlicense", r"anyone is free to copy modify publish use compile sell or distribute this software", b"anyone is free"),
    ("wtfpl", r"you just do what the fuck you want to", b"you want to"),
    ("cc0", r"the person who associated a work with this deed has dedicated the work to the public domain", b"this deed"),
    ("cc0", r"to the extent possible under law (?:[^ ]+ ){1,10}waived all copyright and related or neighboring rights", b"waived all copyright"),
    ("cc", r"licensed under a creative commons licen[sc]e", b"creative commons"),
    ("cc-by", r"you must give appropriate credit provide a link to the license and indicate if changes were made", b"appropriate credit"),
    ("cc-sa", r"if you remix transform or build upon the material you must distribute your contributions under the same license as the original", b"build upon the material"),
    ("cc-nc", r"you may not use the material for commercial purposes", b"commercial purposes"),
    ("cc-nd", r"if you remix transform or build upon the material you may not distribute the modified material", b"build upon the material"),
    ("busl", r"the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work", b"non production"),
    ("openrail", r"use based restrictions as referenced in paragraph", b"restrictions"),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", b"public domain"),
    ("public-domain", r"this (?:work|file|software|text) is in the public domain", b"public domain"),
    ("all-rights-reserved", r"all rights reserved", b"rights reserved"),
    ("all-rights-reserved", r"no part of this (?:publication|book|document|work) may be reproduced", b"no part of this"),
    ("proprietary", r"proprietary and confidential", b"confidential"),
    ("proprietary", r"unauthorized (?:copying|reproduction) of this", b"unauthorized"),
    ("proprietary", r"this software is the confidential and proprietary information of", b"confidential"),
    ("non-commercial", r"for (?:personal|academic|non ?commercial) (?:and non ?commercial )?use only", b"use only"),
    ("non-commercial", r"may not be used for commercial purposes", b"commercial purposes"),
    ("research-only", r"for (?:non ?commercial )?research (?:and educational )?purposes only", b"purposes only"),
]
BSD_CLAUSES = {"0": "zero|0", "1": "one|1", "2": "two|2|simplified|freebsd", "3": "three|3|new|revised|modified", "4": "four|4|original"}
#: How a text refers to a license: pattern around the name, priority, weight.
FORMS = [
    ("(?:{name}) ?(?:version |v ?|ver ?)?{version}(?: or (?:any )?later(?: version)?)?", 3, 0.95),
    ("(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{name}) ?(?:version |v ?|ver ?)?{version}", 4, 1.0),
    ("spdx licen[sc]e identifier {label} {version}(?: 0)?(?: only| or later)?", 5, 1.0),
]
STRICT_FORM = "(?:{short}) (?:(?:version |v ?|ver ?){version}|{pointed})"
UNVERSIONED = [
    ("(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?(?:{name})", 2, 0.9),
    ("(?:under|terms of) the (?:{name})", 1, 0.7),
    ("{full}", 0, 0.5),
    ("spdx licen[sc]e identifier {label}", 4, 1.0),
]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: bytes  # what every match holds, alternatives divided by |: all words of one of them
    priority: int
    weight: float


def _keyword(form: str, keyword: bytes) -> bytes:
    """Forms that spell the label need not hold a word of the name."""
    return b"spdx" if "{label}" in form else keyword


def rules() -> list[Rule]:
    """All signature rules, highest priority first: a pattern for each license, version and way to refer to it, and for each sentence."""
    out = []
    for label, full, short, versions, keyword in LICENSES:
        strict, spelt = label in STRICT and bool(short), label.replace("-", " ")
        # Versions may be glued to a short name.
        glued = {f"{s.split()[-1]}{v}{n.split('.')[0]}" for s in short.split("|") if s for n in versions.split() for v in ("", "v", "ver")}
        keyword = b"|".join([keyword, *sorted(g.encode() for g in glued)])
        name = f"{full}|{short}" if short and not strict else full
        for version in versions.split():
            exact = version.replace(".", " ") + (r"(?: 0)?" if "." not in version else "")
            for form, priority, weight in FORMS:
                out.append(Rule(f"{label}-{version}", form.format(name=name, version=exact, label=spelt), _keyword(form, keyword), priority + ("." in version), weight))
            if strict:
                pointed = version.replace(".", " ") if "." in version else f"{version} 0"
                out.append(Rule(f"{label}-{version}", STRICT_FORM.format(short=short, version=exact, pointed=pointed), keyword, 3 + ("." in version), 0.9))
        out += [Rule(label, form.format(name=f"{full}|{short}" if short else full, full=full, label=spelt), _keyword(form, keyword), priority, weight) for form, priority, weight in UNVERSIONED if form != "{full}" or label not in EVERYDAY]
    every = "|".join(pattern for _, pattern, _ in IDENTIFIERS)
    for label, pattern, word in IDENTIFIERS:
        out.append(Rule(label, EXPRESSION.format(any=every, id=pattern), f"spdx {word}".encode(), 4 if pattern != word else 3, 1.0))
        for form, context, priority, weight in REFERENCES:
            out.append(Rule(label, form.format(id=pattern), "|".join(f"{word} {c}" for c in context.split()).encode(), priority, weight))
    out += [Rule("apache-2", "apache 2 0", b"apache", 2, 0.8), Rule("cc0", "cc0", b"cc0", 1, 0.7), Rule("bsd", "bsd licen[sc]e", b"bsd", 1, 0.7)]
    for clauses, spelt in BSD_CLAUSES.items():
        out.append(Rule(f"bsd-{clauses}", rf"(?:{spelt}) clause bsd(?: licen[sc]e)?|bsd (?:{spelt}) clause(?: licen[sc]e)?", b"bsd", 3, 0.95))
        out.append(Rule(f"bsd-{clauses}", rf"(?:under|terms of) (?:the |a )?(?:{spelt}) (?:clause )?bsd licen[sc]e", b"bsd", 4, 1.0))
    out.append(Rule("bsd", r"(?:under|terms of) (?:the |a )?bsd licen[sc]e", b"bsd", 1, 0.7))
    for kind in CC_KINDS:
        label, spelt = "cc-" + kind.replace(" ", "-"), " ".join(f"(?:{CC_ELEMENTS[e]})" for e in kind.split())
        for version in CC_VERSIONS:
            out.append(Rule(f"{label}-{version.replace(' ', '.')}", rf"creative commons {spelt}(?: [0-9])?(?: licen[sc]e)?(?: version)? {version}", b"commons", 4, 1.0))
            out.append(Rule(f"{label}-{version.replace(' ', '.')}", rf"cc {kind} (?:licen[sc]e )?{version}", b"cc by", 4, 1.0))
        out.append(Rule(label, rf"creative commons {spelt} licen[sc]e", b"commons", 2, 0.9))
        out.append(Rule(label, rf"cc {kind} licen[sc]e", b"cc by", 2, 0.8))
    out.append(Rule("cc0", r"creative commons (?:zero|cc0)|cc0 1 0(?: universal)?", b"cc0|creative commons zero", 3, 0.95))
    out += [Rule(label, pattern, keyword, 2, 0.85) for label, pattern, keyword in SENTENCES]
    return sorted(out, key=lambda r: (-r.priority, -r.weight, r.label, r.pattern))


class Scanner:
    """Compiled rules; works on lower-cased UTF-8 bytes."""

    def __init__(self):
        self.rules = [(r, re.compile(rb"(?<![^ ])(?:" + r.pattern.encode() + rb")(?![^ ])")) for r in rules()]
        # What a text's words must include for rules to run, and which rules those are.
        gates: dict[frozenset[bytes], list[int]] = {}
        for i, (r, _) in enumerate(self.rules):
            for some in r.keyword.split(b"|"):
                gates.setdefault(frozenset(some.split()), []).append(i)
        self.gates, self.words = list(gates.items()), frozenset().union(*gates)
        self.letters = bytes(c if c >= 0x80 or chr(c) in "0123456789abcdefghijklmnopqrstuvwxyz" else 0x20 for c in range(256))
        gap = rb"[^0-9a-z\x80-\xff]+"
        self.base = [(label, phrase.encode().split(), re.compile(rb"(?<![0-9a-z\x80-\xff])" + gap.join(phrase.encode().split()) + rb"(?![0-9a-z\x80-\xff])")) for phrase, label in BASE.items()]

    def scan(self, text: bytes) -> tuple:
        """n_words, n_base, first_word, last_word, base labels, all labels, score."""
        low = text.lower()
        starts, _ = spans(np.frombuffer(low, np.uint8), ALNUM)
        places, base = [], set()
        for label, words, pattern in self.base:
            if all(w in low for w in words):
                at = [m.start() for m in pattern.finditer(low)]
                places += at
                base |= {label} if at else set()
        labels, score = set(base), 1.0 if base else 0.0
        for label, weight in self._detect(low):
            labels.add(label)
            score = max(score, weight)
        ends = [int(np.searchsorted(starts, p)) for p in (min(places), max(places))] if places else [None, None]
        return len(starts), len(places), *ends, ",".join(sorted(base)), ",".join(sorted(labels)), score

    def _detect(self, low: bytes) -> list[tuple[str, float]]:
        """Rules in order of priority; a detection inside one that was kept before it is suppressed."""
        apart = low.translate(self.letters).split()
        here = self.words.intersection(apart)
        run = sorted({i for gate, some in self.gates if gate <= here for i in some}) if here else []
        if not run:
            return []
        words = b" ".join(apart)
        found: list[tuple[str, float]] = []
        # Starts and ends of the kept intervals that no other holds: both ascend, so one place tells whether any holds a further one.
        starts: list[int] = []
        ends: list[int] = []
        for i in run:
            rule, pattern = self.rules[i]
            for m in pattern.finditer(words):
                start, end = m.span(pattern.groups and 1)
                at = bisect_right(starts, start)
                if at and ends[at - 1] >= end:
                    continue
                found.append((rule.label, rule.weight))
                first = at - (at > 0 and starts[at - 1] == start)
                last = bisect_right(ends, end)
                starts[first : max(first, last)] = [start]
                ends[first : max(first, last)] = [end]
        return found


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = kept_in_process("license scanner", Scanner)
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    for batch in batches:
        rows = [(key, *scanner.scan(text or b"")) for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: words, places of base phrases, labels, and the surest detection's score.

    Each row is scanned by itself, so nothing is shuffled. A null text is empty: no words, no labels, score 0. Null
    doc_ids and repeated rows each give a row; an empty table gives none; other columns are ignored.
    """
    return small_batches(docs).selectExpr("cast(doc_id as long) doc_id", "cast(cast(text as string) as binary) text").mapInArrow(_scan, SCHEMA)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
