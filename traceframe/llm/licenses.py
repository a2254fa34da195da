"""License scans: ordered signature rules over normalised words, gated by keywords, overlaps resolved by priority and containment.

A text becomes its lower-cased words with one space between them; every rule is a pattern over that line. The keywords of all
rules are looked for at once; only rules whose keyword is there are run. A detection inside another one of the same or a better
priority is suppressed; what is left names the licenses.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache, partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from traceframe.llm.common import pieces_of, text_bytes

#: Bytes that words are made of, A-Z lower-cased; all others become a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

# Priorities: a smaller number wins.
TAG, GRANT, VERSIONED, NAME, HINT = range(5)
CONFIDENCE = {TAG: 1.0, GRANT: 0.95, VERSIONED: 0.9, NAME: 0.75, HINT: 0.4}


@dataclass(frozen=True)
class Rule:
    """`pattern` stands between word borders; every match of it holds `keyword`, which begins a word."""

    label: str
    priority: int
    keyword: str
    pattern: str


# The phrases of the contract and their labels.
BASE = (
    Rule("gpl", NAME, "gnu general public license", "gnu general public license"),
    Rule("apache", NAME, "apache license", "apache license"),
    Rule("cc-by", NAME, "cc by", "cc by"),
    Rule("mit", NAME, "mit license", "mit license"),
)

_V = "(?: (?:version|v|ver))? ?v?"
_THE = "(?: the)?(?: terms of)?(?: the)?"
_UNDER = f"(?:licen[sc]ed|released|distributed|available|published|provided|made available|covered) (?:under|by|with){_THE}"

# (label, keyword, name of the license in words, versions that it has)
_FAMILIES = (
    ("gpl", "general public licen", "(?:gnu )?(?:gpl|general public licen[sc]e)", ("1.0", "2.0", "3.0")),
    ("gpl", "gpl", "gnu gpl|gpl", ("1.0", "2.0", "3.0")),
    ("lgpl", "lesser general public licen", "(?:gnu )?lesser general public licen[sc]e", ("2.1", "3.0")),
    ("lgpl", "library general public licen", "(?:gnu )?library general public licen[sc]e", ("2.0",)),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ("2.0", "2.1", "3.0")),
    ("agpl", "affero general public licen", "(?:gnu )?affero general public licen[sc]e", ("1.0", "3.0")),
    ("agpl", "agpl", "(?:gnu )?agpl", ("1.0", "3.0")),
    ("gfdl", "free documentation licen", "(?:gnu )?free documentation licen[sc]e", ("1.1", "1.2", "1.3")),
    ("gfdl", "gfdl", "gfdl|gnu fdl", ("1.1", "1.2", "1.3")),
    ("apache", "apache", "apache(?: software)?(?: licen[sc]e)?", ("1.0", "1.1", "2.0")),
    ("mpl", "mozilla public licen", "mozilla public licen[sc]e", ("1.0", "1.1", "2.0")),
    ("mpl", "mpl", "mpl", ("1.0", "1.1", "2.0")),
    ("epl", "eclipse public licen", "eclipse public licen[sc]e", ("1.0", "2.0")),
    ("cddl", "common development and distribution licen", "common development and distribution licen[sc]e", ("1.0", "1.1")),
    ("cddl", "cddl", "cddl", ("1.0", "1.1")),
    ("cpl", "common public licen", "common public licen[sc]e", ("1.0",)),
    ("eupl", "european union public licen", "european union public licen[sc]e", ("1.0", "1.1", "1.2")),
    ("eupl", "eupl", "eupl", ("1.0", "1.1", "1.2")),
    ("osl", "open software licen", "open software licen[sc]e", ("1.0", "2.0", "2.1", "3.0")),
    ("afl", "academic free licen", "academic free licen[sc]e", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("artistic", "artistic licen", "artistic licen[sc]e", ("1.0", "2.0")),
    ("bsl", "boost software licen", "boost software licen[sc]e", ("1.0",)),
    ("ofl", "open font licen", "(?:sil )?open font licen[sc]e", ("1.0", "1.1")),
    ("odbl", "open database licen", "open database licen[sc]e", ("1.0",)),
    ("odc-by", "open data commons attribution", "open data commons attribution licen[sc]e", ("1.0",)),
    ("lppl", "latex project public licen", "latex project public licen[sc]e", ("1.0", "1.1", "1.2", "1.3")),
    ("php", "php licen", "php licen[sc]e", ("3.0",)),
    ("qpl", "q public licen", "q public licen[sc]e", ("1.0",)),
    ("zpl", "zope public licen", "zope public licen[sc]e", ("2.0", "2.1")),
    ("apsl", "apple public source licen", "apple public source licen[sc]e", ("1.0", "1.1", "1.2", "2.0")),
    ("cpal", "common public attribution licen", "common public attribution licen[sc]e", ("1.0",)),
    ("cecill", "cecill", "cecill(?: licen[sc]e)?", ("1.0", "1.1", "2.0", "2.1")),
    ("mulan", "mulan permissive software licen", "mulan permissive software licen[sc]e", ("1.0", "2.0")),
    ("ecl", "educational community licen", "educational community licen[sc]e", ("1.0", "2.0")),
    ("openrail", "openrail", "(?:bigscience |creativeml )?openrail(?: m)?", ("1.0",)),
    ("cdla", "community data licen", "community data licen[sc]e agreement", ("1.0", "2.0")),
    ("etalab", "etalab", "etalab(?: open)?(?: licen[sc]e)?", ("1.0", "2.0")),
    ("dl-de-by", "datenlizenz deutschland", "datenlizenz deutschland namensnennung", ("1.0", "2.0")),
    ("ogl", "open government licen", "open government licen[sc]e", ("1.0", "2.0", "3.0")),
)

#: (label, words of the parts) of the Creative Commons, in the order in which a name lists them.
_COMMONS = (
    ("cc-by", ("by",)),
    ("cc-by-sa", ("by", "sa")),
    ("cc-by-nd", ("by", "nd")),
    ("cc-by-nc", ("by", "nc")),
    ("cc-by-nc-sa", ("by", "nc", "sa")),
    ("cc-by-nc-nd", ("by", "nc", "nd")),
)
_PARTS = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:s|atives)?", "nc": "non ?commercial"}
_COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Signatures of their own: (label, priority, keyword, pattern).
_SINGLE = (
    ("mit", GRANT, "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", VERSIONED, "expat", "(?:expat|mit expat) licen[sc]e"),
    ("mit", HINT, "under mit", "(?:licen[sc]ed|released|distributed) under mit"),
    ("mit", HINT, "under the mit", "(?:licen[sc]ed|released|distributed) under the mit"),
    ("mit", HINT, "terms of the mit", "(?:licen[sc]ed|released|distributed) under the terms of the mit"),
    ("mit", TAG, "opensource org", "opensource org licenses mit(?: license)?"),
    ("mit-0", VERSIONED, "mit no attribution", "mit no attribution(?: licen[sc]e)?"),
    ("x11", VERSIONED, "x11 licen", "x11 licen[sc]e"),
    ("isc", GRANT, "permission to use copy modify", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", VERSIONED, "isc licen", "isc licen[sc]e"),
    ("bsd", GRANT, "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", NAME, "bsd licen", "bsd(?: style)? licen[sc]e"),
    ("bsd", NAME, "bsd style", "bsd style licen[sc]e"),
    ("bsd-0-clause", VERSIONED, "0bsd", "0bsd|zero clause bsd(?: licen[sc]e)?"),
    ("bsd-0-clause", VERSIONED, "zero clause bsd", "zero clause bsd(?: licen[sc]e)?"),
    ("bsd-1-clause", VERSIONED, "1 clause bsd", "(?:the )?1 clause bsd(?: licen[sc]e)?"),
    ("bsd-2-clause", VERSIONED, "2 clause", "bsd 2 clause(?: licen[sc]e)?|2 clause bsd(?: licen[sc]e)?"),
    ("bsd-2-clause", VERSIONED, "simplified bsd", "simplified bsd licen[sc]e"),
    ("bsd-2-clause", VERSIONED, "freebsd licen", "freebsd licen[sc]e"),
    ("bsd-3-clause", VERSIONED, "3 clause", "bsd 3 clause(?: licen[sc]e)?|3 clause bsd(?: licen[sc]e)?"),
    ("bsd-3-clause", VERSIONED, "new bsd", "new bsd licen[sc]e"),
    ("bsd-3-clause", VERSIONED, "modified bsd", "modified bsd licen[sc]e"),
    ("bsd-3-clause", GRANT, "neither the name of", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", VERSIONED, "4 clause", "bsd 4 clause(?: licen[sc]e)?|4 clause bsd(?: licen[sc]e)?"),
    ("bsd-4-clause", GRANT, "all advertising materials mentioning", "all advertising materials mentioning features or use of this software must display"),
    ("gpl", GRANT, "this program is free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", GRANT, "this library is free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", GRANT, "this program is free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", TAG, "gnu org licenses", "(?:www )?gnu org licenses gpl(?: (?:html|txt))?"),
    ("lgpl", TAG, "gnu org licenses", "(?:www )?gnu org licenses lgpl(?: (?:html|txt))?"),
    ("agpl", TAG, "gnu org licenses", "(?:www )?gnu org licenses agpl(?: (?:html|txt))?"),
    ("gfdl", TAG, "gnu org licenses", "(?:www )?gnu org licenses fdl(?: (?:html|txt))?"),
    ("apache-2.0", GRANT, "licensed under the apache license", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", TAG, "apache org licenses", "(?:www )?apache org licenses license 2 0(?: (?:html|txt))?"),
    ("apache", HINT, "apache", f"{_UNDER} apache"),
    ("mpl-2.0", GRANT, "this source code form is subject to the terms", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", TAG, "mozilla org mpl", "mozilla org mpl 2 0"),
    ("unlicense", GRANT, "this is free and unencumbered software", "this is free and unencumbered software released into the public domain"),
    ("unlicense", VERSIONED, "unlicense", "(?:the )?unlicense(?: org)?"),
    ("wtfpl", GRANT, "do what the fuck you want", "do what the fuck you want to(?: public licen[sc]e)?"),
    ("wtfpl", VERSIONED, "wtfpl", "wtfpl"),
    ("zlib", GRANT, "provided as is without any express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", VERSIONED, "zlib licen", "zlib licen[sc]e"),
    ("libpng", VERSIONED, "libpng licen", "libpng licen[sc]e"),
    ("bsl-1.0", GRANT, "boost software license", "distributed under the boost software license version 1 0"),
    ("ncsa", VERSIONED, "ncsa", "(?:university of illinois )?ncsa open source licen[sc]e"),
    ("postgresql", VERSIONED, "postgresql licen", "postgresql licen[sc]e"),
    ("psf", VERSIONED, "python software foundation licen", "python software foundation licen[sc]e(?: version 2)?"),
    ("ruby", VERSIONED, "ruby licen", "ruby licen[sc]e"),
    ("perl", VERSIONED, "same terms as perl", "(?:under the )?same terms as perl(?: itself)?"),
    ("openssl", VERSIONED, "openssl licen", "openssl licen[sc]e"),
    ("openssl", GRANT, "this product includes software developed by the openssl project", "this product includes software developed by the openssl project"),
    ("curl", VERSIONED, "curl licen", "curl licen[sc]e"),
    ("ms-pl", VERSIONED, "microsoft public licen", "microsoft public licen[sc]e"),
    ("ms-rl", VERSIONED, "microsoft reciprocal licen", "microsoft reciprocal licen[sc]e"),
    ("upl", VERSIONED, "universal permissive licen", "universal permissive licen[sc]e"),
    ("vim", VERSIONED, "vim licen", "vim licen[sc]e"),
    ("beerware", VERSIONED, "beer ware", "(?:the )?beer ware licen[sc]e"),
    ("json", GRANT, "shall be used for good not evil", "the software shall be used for good not evil"),
    ("sspl", VERSIONED, "server side public licen", "server side public licen[sc]e"),
    ("busl", VERSIONED, "business source licen", "business source licen[sc]e"),
    ("elastic", VERSIONED, "elastic licen", "elastic licen[sc]e"),
    ("commons-clause", VERSIONED, "commons clause", "commons clause(?: licen[sc]e)?"),
    ("ipl", VERSIONED, "ibm public licen", "ibm public licen[sc]e"),
    ("npl", VERSIONED, "netscape public licen", "netscape public licen[sc]e"),
    ("spl", VERSIONED, "sun public licen", "sun public licen[sc]e"),
    ("sleepycat", VERSIONED, "sleepycat licen", "sleepycat licen[sc]e"),
    ("w3c", VERSIONED, "w3c software", "w3c software(?: notice)?(?: and)?(?: document)? licen[sc]e"),
    ("unicode", VERSIONED, "unicode licen", "unicode licen[sc]e(?: agreement)?"),
    ("cc0", GRANT, "cc0", "cc0 1 0(?: universal)?(?: public domain dedication)?"),
    ("cc0", VERSIONED, "cc0", "cc0|cc zero"),
    ("cc0", VERSIONED, "creative commons zero", "creative commons zero"),
    ("cc0", TAG, "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", TAG, "creativecommons org publicdomain mark", "creativecommons org publicdomain mark 1 0"),
    ("public-domain", NAME, "public domain", "(?:released |dedicated |placed )?(?:in|into|to) the public domain"),
    ("pddl", VERSIONED, "public domain dedication and licen", "(?:open data commons )?public domain dedication and licen[sc]e"),
    ("creative-commons", HINT, "creative commons", "creative commons(?: licen[sc]e)?"),
    ("creative-commons", HINT, "creativecommons org", "creativecommons org licenses"),
    ("open-source", HINT, "open source licen", "open source licen[sc]e"),
    ("free-software", HINT, "free software licen", "free software licen[sc]e"),
    ("proprietary", NAME, "proprietary and confidential", "proprietary and confidential"),
    ("proprietary", NAME, "proprietary licen", "proprietary licen[sc]e"),
    ("proprietary", NAME, "commercial licen", "commercial licen[sc]e"),
    ("proprietary", HINT, "end user licen", "end user licen[sc]e agreement"),
    ("proprietary", GRANT, "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("all-rights-reserved", NAME, "all rights reserved", "all rights reserved"),
    ("all-rights-reserved", NAME, "alle rechte vorbehalten", "alle rechte vorbehalten"),
    ("all-rights-reserved", NAME, "tous droits réservés", "tous droits réservés"),
    ("all-rights-reserved", NAME, "todos los derechos reservados", "todos los derechos reservados"),
    ("non-commercial", NAME, "non commercial use only", "(?:for )?non commercial use only"),
    ("non-commercial", NAME, "noncommercial use only", "(?:for )?noncommercial use only"),
    ("research-only", NAME, "research purposes only", "(?:for )?research purposes only"),
    ("copyleft", HINT, "copyleft", "copyleft"),
)


def _version(v: str) -> str:
    """Words of a version: 2.0 is found as `2 0` and as `2`, 2.1 as `2 1`."""
    major, minor = v.split(".")
    return f"{major}(?: 0)?(?! \\d)" if minor == "0" else f"{major} {minor}"


@cache
def signatures() -> tuple[Rule, ...]:
    """All rules in the order of their priority: base phrases, families with each version and form, single signatures."""
    rules = list(BASE)
    for label, keyword, name, versions in _FAMILIES:
        rules.append(Rule(label, NAME if " " in keyword else HINT, keyword, f"(?:{name})"))
        for v in versions:
            rules.append(Rule(f"{label}-{v}", VERSIONED, keyword, f"(?:{name}){_V}{_version(v)}"))
            rules.append(Rule(f"{label}-{v}-or-later", GRANT, keyword, f"(?:{name}){_V}{_version(v)} or (?:at your option )?(?:any )?(?:later|newer)(?: version)?"))
        if keyword == label:
            rules.append(Rule(label, TAG, "spdx", f"spdx licen[sc]e identifier {label}"))
            rules += [Rule(f"{label}-{v}", TAG, "spdx", f"spdx licen[sc]e identifier {label} {_version(v)}(?: only| or later)?") for v in versions]
    for label, parts in _COMMONS:
        short, long = " ".join(parts), " ".join(_PARTS[p] for p in parts)
        rules.append(Rule(label, NAME, f"cc {parts[0]}", f"cc {short}"))
        rules.append(Rule(label, NAME, "creative commons", f"creative commons {long}(?: international)?(?: licen[sc]e)?"))
        rules.append(Rule(label, TAG, "creativecommons org", f"creativecommons org licenses {short}"))
        rules.append(Rule(label, TAG, "spdx", f"spdx licen[sc]e identifier cc {short}"))
        for v in _COMMONS_VERSIONS:
            at = _version(v)
            rules.append(Rule(f"{label}-{v}", VERSIONED, f"cc {parts[0]}", f"cc {short}{_V}{at}"))
            rules.append(Rule(f"{label}-{v}", VERSIONED, "creative commons", f"creative commons {long}(?: licen[sc]e)?{_V}{at}(?: international| unported| generic)?(?: licen[sc]e)?"))
            rules.append(Rule(f"{label}-{v}", TAG, "creativecommons org", f"creativecommons org licenses {short} {at}"))
            rules.append(Rule(f"{label}-{v}", TAG, "spdx", f"spdx licen[sc]e identifier cc {short} {at}"))
    rules += [Rule(*s) for s in _SINGLE]
    tags = {"mit": "mit", "isc": "isc", "bsd-2-clause": "bsd 2 clause", "bsd-3-clause": "bsd 3 clause", "unlicense": "unlicense", "zlib": "zlib", "cc0": "cc0 1 0", "wtfpl": "wtfpl", "bsl-1.0": "bsl 1 0", "ncsa": "ncsa", "x11": "x11", "upl": "upl 1 0", "apache-2.0": "apache 2 0"}
    rules += [Rule(label, TAG, "spdx", f"spdx licen[sc]e identifier {words}") for label, words in tags.items()]
    return tuple(sorted(dict.fromkeys(rules), key=lambda r: r.priority))


@cache
def _compiled(rules: tuple[Rule, ...]) -> tuple[ahocorasick.Automaton, list[re.Pattern[str]]]:
    gate = ahocorasick.Automaton()
    by_keyword: dict[str, list[int]] = {}
    for i, rule in enumerate(rules):
        by_keyword.setdefault(rule.keyword, []).append(i)
    for keyword, ids in by_keyword.items():
        gate.add_word(f" {keyword}", (keyword, tuple(ids)))
    gate.make_automaton()
    return gate, [re.compile(f"(?<![^ ])(?=((?:{r.pattern}))(?![^ ]))") for r in rules]


@dataclass(frozen=True)
class Detection:
    """Words `first` to `last` of a text, both included."""

    rule: int
    first: int
    last: int


def detections(line: str, rules: tuple[Rule, ...]) -> list[Detection]:
    """Every place of every rule in a line of words, overlapping ones too."""
    gate, patterns = _compiled(rules)
    todo: set[int] = set()
    found_words: set[str] = set()
    for _, (keyword, ids) in gate.iter(f" {line}"):
        if keyword not in found_words:
            found_words.add(keyword)
            todo.update(ids)
    if not todo:
        return []
    spaces = np.flatnonzero(np.frombuffer(line.encode("utf-32-le"), dtype="<u4") == 32)
    out = []
    for i in sorted(todo):
        ends = [(m.start(1), m.end(1)) for m in patterns[i].finditer(line)]
        if ends:
            at = np.searchsorted(spaces, np.array(ends))
            out += [Detection(i, int(a), int(b)) for a, b in at]
    return out


def unsuppressed(found: Sequence[Detection], rules: Sequence[Rule]) -> list[Detection]:
    """Detections that lie in no other one of a better priority, nor in a longer one (or an earlier rule) of the same."""
    kept: list[Detection] = []
    by_priority: dict[int, list[Detection]] = {}
    for d in found:
        by_priority.setdefault(rules[d.rule].priority, []).append(d)
    starts, reach = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    for priority in sorted(by_priority):
        end = -1
        new = []
        for d in sorted(by_priority[priority], key=lambda d: (d.first, -d.last, d.rule)):
            at = np.searchsorted(starts, d.first, side="right") - 1
            if d.last <= end or (at >= 0 and reach[at] >= d.last):
                continue
            end = d.last
            new.append(d)
        kept += new
        both = sorted((d.first, d.last) for d in kept)
        starts = np.array([f for f, _ in both], dtype=np.int64)
        reach = np.maximum.accumulate(np.array([e for _, e in both], dtype=np.int64)) if both else starts
    return sorted(kept, key=lambda d: (d.first, d.last))


FIELDS = (
    ("n_words", pa.int64(), "bigint"), ("n_base", pa.int64(), "bigint"), ("first_word", pa.int64(), "bigint"), ("last_word", pa.int64(), "bigint"),
    ("base_labels", pa.list_(pa.string()), "array<string>"), ("license_labels", pa.list_(pa.string()), "array<string>"),
    ("license_score", pa.float64(), "double"),
    ("license_spans", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("confidence", pa.float64())])),
     "array<struct<label: string, first_word: bigint, last_word: bigint, confidence: double>>"),
)


def scanned(words: bytes, rules: tuple[Rule, ...]) -> tuple:
    """The outputs for one text, given as bytes in which only words and spaces are left."""
    parts = words.split()
    found = detections(b" ".join(parts).decode(), rules)
    base = {i for i, r in enumerate(rules) if r in BASE}
    places = [d for d in found if d.rule in base]
    kept = unsuppressed(found, rules)
    spans = [{"label": rules[d.rule].label, "first_word": d.first, "last_word": d.last, "confidence": CONFIDENCE[rules[d.rule].priority]} for d in kept]
    base_labels = sorted({rules[d.rule].label for d in places})
    labels = sorted({*base_labels, *(s["label"] for s in spans)})
    starts = [d.first for d in places]
    score = max((s["confidence"] for s in spans), default=0.0)
    return len(parts), len(places), min(starts, default=None), max(starts, default=None), base_labels, labels, score, spans


def _scan(batches: Iterator[pa.RecordBatch], at: int, rules: tuple[Rule, ...]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in pieces_of(whole, at):
            raw, cut = text_bytes(batch.column(at))
            rows = [scanned(raw[a:b].tobytes().translate(_WORD_BYTES), rules) for a, b in zip(cut, cut[1:])]
            made = [pa.array(c, t) for c, (_, t, _) in zip(zip(*rows), FIELDS)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *[n for n, _, _ in FIELDS]])


def scan_licenses(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """`docs` with its license detections.

    n_words; n_base, first_word, last_word and base_labels of the base phrases, at all places; license_labels (those that no
    other detection suppresses, and the base ones), license_spans (label, first and last word, confidence) and license_score
    (the best confidence, 0 without any). A null text is empty: zeros, nulls and empty lists. Repeated rows are scanned each on
    its own. Columns of `docs` named like an output are dropped before. Nothing is shuffled; a task holds one text at a time.
    """
    names = {n for n, _, _ in FIELDS}
    base = docs.select(*[c for c in docs.columns if c not in names])
    added = ", ".join(f"{n} {t}" for n, _, t in FIELDS)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields)
    run = partial(_scan, at=base.columns.index(text), rules=signatures() if rules is None else rules)
    return base.mapInArrow(run, f"{fields}, {added}")
