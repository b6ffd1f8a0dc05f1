"""License scans by ordered signature rules.

Rules are patterns over lower-cased text, built from licence families and notice templates: a
rule has a label, a priority, a confidence and a keyword that must occur before its pattern is
tried. Detections are resolved in order of priority, longer ones first: one whose interval lies
inside that of a detection already kept is suppressed. Four base phrases are counted beside the rules.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import blocks, share, shared, text_buffer

#: Word bytes of lower-cased UTF-8: digits, a-z, and all of a non-ASCII character.
WORD, GAP = rb"[0-9a-z\x80-\xff]", rb"[^0-9a-z\x80-\xff]+"
IS_WORD = np.array([bool(re.match(WORD, bytes([b]))) for b in range(256)])
#: Bytes of text whose kept detections are looked through together.
STRETCH = 256
#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: (label, names, versions, spdx stem). Names are patterns of words.
FAMILIES = [
    ("gpl", ["gnu general public licen[cs]e", "gnu gpl", "gpl"], ["1.0", "2.0", "3.0"], "gpl"),
    ("lgpl", ["gnu lesser general public licen[cs]e", "gnu library general public licen[cs]e", "gnu lgpl", "lgpl"], ["2.0", "2.1", "3.0"], "lgpl"),
    ("agpl", ["gnu affero general public licen[cs]e", "gnu agpl", "agpl"], ["1.0", "3.0"], "agpl"),
    ("gfdl", ["gnu free documentation licen[cs]e", "gfdl"], ["1.1", "1.2", "1.3"], "gfdl"),
    ("apache", ["apache licen[cs]e", "apache software licen[cs]e"], ["1.0", "1.1", "2.0"], "apache"),
    ("mit", ["mit licen[cs]e", "expat licen[cs]e", "mit/x11 licen[cs]e"], [], "mit"),
    ("bsd-2-clause", ["bsd 2 clause licen[cs]e", "simplified bsd licen[cs]e", "freebsd licen[cs]e"], [], "bsd-2-clause"),
    ("bsd-3-clause", ["bsd 3 clause licen[cs]e", "new bsd licen[cs]e", "modified bsd licen[cs]e"], [], "bsd-3-clause"),
    ("bsd", ["bsd licen[cs]e"], [], "bsd"),
    ("mpl", ["mozilla public licen[cs]e", "mpl"], ["1.0", "1.1", "2.0"], "mpl"),
    ("epl", ["eclipse public licen[cs]e", "epl"], ["1.0", "2.0"], "epl"),
    ("eupl", ["european union public licen[cs]e", "eupl"], ["1.1", "1.2"], "eupl"),
    ("cddl", ["common development and distribution licen[cs]e", "cddl"], ["1.0", "1.1"], "cddl"),
    ("artistic", ["artistic licen[cs]e"], ["1.0", "2.0"], "artistic"),
    ("isc", ["isc licen[cs]e"], [], "isc"),
    ("zlib", ["zlib licen[cs]e", "zlib/libpng licen[cs]e"], [], "zlib"),
    ("boost", ["boost software licen[cs]e"], ["1.0"], "bsl"),
    ("ofl", ["sil open font licen[cs]e", "open font licen[cs]e"], ["1.0", "1.1"], "ofl"),
    ("odbl", ["open database licen[cs]e", "odbl"], ["1.0"], "odbl"),
    ("unlicense", ["the unlicense", "unlicense"], [], "unlicense"),
    ("wtfpl", ["do what the fuck you want to public licen[cs]e", "wtfpl"], [], "wtfpl"),
    *(
        (f"cc-{part}", [f"cc {part.replace('-', ' ')}", f"creative commons {words}"], ["1.0", "2.0", "2.5", "3.0", "4.0"], f"cc-{part}")
        for part, words in (
            ("by", "attribution"),
            ("by-sa", "attribution share ?alike"),
            ("by-nd", "attribution no ?deriv(?:ative)?s"),
            ("by-nc", "attribution non ?commercial"),
            ("by-nc-sa", "attribution non ?commercial share ?alike"),
            ("by-nc-nd", "attribution non ?commercial no ?deriv(?:ative)?s"),
        )
    ),
    ("cc0", ["cc0", "creative commons zero"], ["1.0"], "cc0"),
]
#: (template, confidence); earlier templates have priority. {} is the licence's name and version.
TEMPLATES = [
    ("spdx license identifier {}", 1.0),
    ("(?:licensed|released|distributed|published|available|made available) under (?:the )?(?:terms of )?(?:the )?{}", 0.95),
    ("licen[cs]e {}", 0.85),
    ("{}", 0.7),
]
#: (label, pattern, confidence) of notices that name no family; they come after the templates. Signatures
#: are sentences of the licences' own texts.
NOTICES = [
    ("public-domain", "(?:released|placed|dedicated) (?:in ?to|in|to) the public domain", 0.9),
    ("public-domain", "public domain", 0.6),
    ("public-domain", "(?:waives?|waived) all copyright", 0.8),
    ("public-domain", "this work is free of known copyright restrictions", 0.9),
    ("all-rights-reserved", "all rights reserved", 0.8),
    ("all-rights-reserved", "tous droits réservés", 0.8),
    ("all-rights-reserved", "alle rechte vorbehalten", 0.8),
    ("all-rights-reserved", "todos los derechos reservados", 0.8),
    ("copyright", "copyright (?:c )?(?:19|20)[0-9][0-9]", 0.6),
    ("copyright", "© ?(?:19|20)[0-9][0-9]", 0.6),
    ("proprietary", "proprietary and confidential", 0.9),
    ("proprietary", "confidential and proprietary", 0.9),
    ("proprietary", "no part of this (?:document|publication|work|book|website) may be (?:reproduced|copied|distributed|transmitted)", 0.9),
    ("proprietary", "unauthori[sz]ed (?:copying|reproduction|distribution|use) (?:of this (?:file|document|work) )?is (?:strictly )?prohibited", 0.9),
    ("proprietary", "may not be (?:reproduced|copied|distributed) without (?:the )?(?:prior )?(?:express )?written (?:permission|consent)", 0.9),
    ("proprietary", "for internal use only", 0.7),
    ("proprietary", "contains trade secrets of", 0.7),
    ("noncommercial", "for (?:personal|private) (?:and )?non ?commercial use only", 0.8),
    ("noncommercial", "not for commercial use", 0.7),
    ("evaluation", "for evaluation purposes only", 0.7),
    ("freeware", "this (?:software|program) is freeware", 0.8),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions", 1.0),
    ("mit-0", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", 1.0),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("bsd", "redistributions of source code must retain the above copyright notice", 0.9),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("bsd-3-clause", "neither the names? of (?:the )?[^.]{1,80}? may be used to endorse or promote products", 1.0),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display", 1.0),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", 1.0),
    ("hpnd", "permission to use copy modify and distribute this software and its documentation for any purpose", 1.0),
    ("gpl", "under the terms of the gnu general public licen[cs]e as published by the free software foundation", 1.0),
    ("lgpl", "under the terms of the gnu lesser general public licen[cs]e as published by the free software foundation", 1.0),
    ("agpl", "under the terms of the gnu affero general public licen[cs]e as published by the free software foundation", 1.0),
    ("gpl", "this is free software and you are welcome to redistribute it under certain conditions", 0.9),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", 1.0),
    ("apache-2.0", "licensed under the apache licen[cs]e version 2(?: 0)? the license you may not use this file except in compliance with the license", 1.0),
    ("apache-2.0", "www apache org licenses license 2 0", 0.9),
    ("apache-1.1", "this product includes software developed by the apache software foundation", 0.9),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public licen[cs]e", 1.0),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", 1.0),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[cs]e", 1.0),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", 1.0),
    ("zlib", "altered source versions must be plainly marked as such", 0.9),
    ("boost-1.0", "permission is hereby granted free of charge to any person or organi[sz]ation obtaining a copy", 1.0),
    ("unlicense", "this is free and unencumbered software released into the public domain", 1.0),
    ("wtfpl-2.0", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed", 1.0),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied", 1.0),
    ("ofl", "the goals of the open font licen[cs]e", 1.0),
    ("python", "psf licen[cs]e agreement", 0.9),
    ("postgresql", "in no event shall the university of california be liable to any party", 0.8),
    ("openssl", "this product includes software developed by the openssl project", 0.9),
    ("cc0", "to the extent possible under law", 0.7),
    ("cc", "creativecommons org licenses", 0.7),
    ("cc", "some rights reserved", 0.6),
]


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: re.Pattern
    priority: int
    confidence: float
    keyword: bytes


def compiled(words: str) -> re.Pattern:
    """A pattern of words: a blank matches any run of other bytes (` ?`: also nothing), and no word
    continues at its ends."""
    gap, word = GAP.decode("latin-1"), WORD.decode("latin-1")
    body = words.encode().decode("latin-1").replace("/", " ").replace(" ?", f"(?:{gap})?").replace(" ", gap)
    return re.compile(f"(?<!{word})(?:{body})(?!{word})".encode("latin-1"))


def rules() -> tuple[Rule, ...]:
    """All rules; a template's place is its priority."""
    out = []
    for t, (template, confidence) in enumerate(TEMPLATES):
        for label, names, versions, stem in FAMILIES:
            spdx = template.startswith("spdx")
            for version in [*versions, None]:
                major = version and (f"{version[0]}(?: 0)?" if version.endswith(".0") else version.replace(".", " "))
                called = [stem.replace("-", " ")] if spdx else names
                tail = "" if version is None else f" (?:(?:version|v) ?)?v?{major}" + ("(?: (?:or later|only))?" if spdx else "")
                for name in called:
                    out.append(Rule(f"{label}-{version}" if version else label, compiled(template.replace("{}", name + tail)), t, confidence, keyword(name)))
    return (*out, *(Rule(label, compiled(words), len(TEMPLATES), confidence, keyword(words)) for label, words, confidence in NOTICES))


def keyword(words: str) -> bytes:
    """The longest run of plain words outside a pattern's groups; a text without it can't match."""
    runs, depth = [""], 0
    for c in words.replace("/", " "):
        if c in "?*+" and not depth:
            runs[-1] = runs[-1][:-1]  # what stands before may be absent
        if depth == 0 and c not in "([{)]}|?*+.^":
            runs[-1] += c
        else:
            runs.append("")
        depth += (c in "([{") - (c in ")]}")
    return max((r.strip() for r in runs), key=len).encode()


#: No rule or phrase matches a text without one of these; single words, as any gap may lie between two.
GATES = [b"licen", b"spdx", b"creative", b"gpl", b"gfdl", b"mpl", b"epl", b"eupl", b"cddl", b"odbl", b"wtfpl", b"domain", b"reserved", b"copyright", b"proprietary", b"part", b"granted", b"redistribution", b"permission"]
#: Gates of two or three letters, which many other words hold, must start a word.
SHORT_GATES = re.compile(rb"(?<![0-9a-z\x80-\xff])(?:cc[^a-z1-9]|cc0)|\xc2\xa9")


def base_patterns() -> tuple[tuple[str, re.Pattern], ...]:
    return tuple((label, compiled(phrase)) for phrase, label in BASE.items())


class Scanner:
    """The compiled rules by keyword, and the base phrases."""

    def __init__(self) -> None:
        self.base, self.by_keyword, self.gates, self.short = base_patterns(), {}, [*GATES], SHORT_GATES
        for rule in rules():
            self.by_keyword.setdefault(rule.keyword, []).append(rule)
        # a rule whose keyword holds no gate brings its longest word as one
        for key in self.by_keyword:
            if not any(g in key for g in self.gates) and not self.short.search(key + b" "):
                self.gates.append(max(key.split(), key=len))

    def passes(self, low: bytes) -> bool:
        return any(g in low for g in self.gates) or (b"cc" in low or b"\xc2\xa9" in low) and self.short.search(low) is not None

    def detections(self, low: bytes) -> list[tuple[str, int, int, float]]:
        """(label, start, end, confidence) of a lower-cased text, overlaps resolved, by place."""
        flat = re.sub(GAP, b" ", low)
        tried = (r for key, same in self.by_keyword.items() if key in flat for r in same)
        found = [(r.priority, m.start() - m.end(), r.label, m.start(), m.end(), r.confidence) for r in tried for m in r.pattern.finditer(low)]
        kept: list[tuple[str, int, int, float]] = []
        over: dict[int, list[tuple[int, int]]] = {}  # kept intervals by the stretches of text they touch
        for _, _, label, start, end, confidence in sorted(found):
            if not any(s <= start and end <= e for s, e in over.get(start // STRETCH, ())):
                kept.append((label, start, end, confidence))
                for k in range(start // STRETCH, (end - 1) // STRETCH + 1):
                    over.setdefault(k, []).append((start, end))
        return sorted(kept, key=lambda d: d[1:3])

    def scan_text(self, low: bytes, starts: np.ndarray) -> tuple:
        """n_base, first_word, last_word, base_labels, labels, score, n_detections of one text;
        `starts` are the places where its words start."""
        if not self.passes(low):
            return 0, None, None, "", "", 0.0, 0
        base = [(label, m.start()) for label, p in self.base for m in p.finditer(low)]
        at = np.searchsorted(starts, [s for _, s in base])
        found = self.detections(low)
        base_labels = {label for label, _ in base}
        miss = 1.0
        for *_, confidence in found:
            miss *= 1 - confidence
        return (
            len(base),
            int(at.min()) if base else None,
            int(at.max()) if base else None,
            ",".join(sorted(base_labels)),
            ",".join(sorted(base_labels | {d[0] for d in found})),
            1 - miss,
            len(found),
        )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections of every row.

    Text is lower-cased in A-Z; null counts as empty (no words, empty labels, score 0). score is
    the chance that a detection is right, were confidences independent. A row with an id seen
    before is scanned by itself. A text of any length is read whole; an empty table gives no rows.
    Other columns are not read.
    """
    sent = share(docs.sparkSession, Scanner())
    kind = docs.schema[doc_id].dataType.simpleString()
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_detections", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared(sent)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            rows = []
            for a, b in blocks(offsets):
                low = data[offsets[a] : offsets[b]].tobytes().lower()
                word = IS_WORD[np.frombuffer(low, np.uint8)]
                ends = offsets[a : b + 1] - offsets[a]
                new = word.copy()
                new[1:] &= ~word[:-1]
                heads = ends[:-1][ends[:-1] < len(word)]
                new[heads] = word[heads]  # a text starts anew
                starts = np.flatnonzero(new)
                cuts = np.searchsorted(starts, ends)
                for i in range(b - a):
                    s, e = int(ends[i]), int(ends[i + 1])
                    rows.append((int(cuts[i + 1] - cuts[i]), *scanner.scan_text(low[s:e], starts[cuts[i] : cuts[i + 1]] - s)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(fields))], ["doc_id", *(n for n, _ in fields)])

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_detections long"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
