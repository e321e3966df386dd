"""Licence scans by sentence rules.

A text is cut into sentences, each is normalised (lower case, comment marks and quotes away, punctuation and white space
to single blanks), and known licence sentences become identifiers, some with a version. Sentences that speak of a licence
without matching a rule become `Unknown`. The sequence of identifiers is then matched against licence rules in order,
most specific first: a rule's identifiers must follow each other, and a match uses its sentences up, so a full licence text
isn't also reported as its single clauses. Sentences with at most ``GAP`` others between neighbours are matched first, so
that licences side by side keep their own sentences; what is left is matched at any distance. Free stretches inside a
sentence rule span at most ``FREE`` characters, hits are indexed by identifier: the time grows with the length of a text
even where no sentence ends.

One narrow pass over whole texts; nothing is shuffled. Texts without any of the trigger words, one of which stands in
every sentence rule, are settled by one search.

Defined cases: null and empty texts have no sentence and no licence; very long texts are read whole; a repeated licence is
reported once, its sentences each; of rules that begin at one sentence the more specific one is listed; repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

OUT = "doc_id long, licences array<string>, sentence_ids array<string>, n_sentences int, n_unknown int"
GAP = 6
FREE = 300

#: Fixed values: (identifier, trigger, pattern on the normalised sentence); a group `v` is a version, `k` a kind.
SENTENCES = [
    ("MitGrant", "permission", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("MitNotice", "permission", r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included"),
    ("MitRef", "licen", r"(?:released|licensed|distributed|available) under (?:the )?(?:terms of )?(?:the )?mit licen[cs]e"),
    ("IscGrant", "permission", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("BsdGrant", "redistribut", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("BsdSource", "redistribut", r"redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", "redistribut", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BsdAdvert", "advertis", r"all advertising materials mentioning features or use of this software must display"),
    ("BsdEndorse", "endorse", r"neither the name.{0,300}? may be used to endorse or promote products"),
    ("BsdRef", "licen", r"(?:released|licensed|distributed) under (?:the )?(?:terms of )?(?:the )?(?:(?P<v>[234]) clause )?bsd(?: (?P<v2>[234]) clause)?(?: style)? licen[cs]e"),
    ("ApacheRef", "licen", r"licensed (?:to the .{0,300}? )?under (?:the )?(?:terms of )?(?:the )?apache licen[cs]e(?: version| v)? ?(?P<v>\d+(?:\.\d+)*)?"),
    ("ApacheUse", "licen", r"you may not use this file except in compliance with the licen[cs]e"),
    ("ApacheCopy", "licen", r"you may obtain a copy of the licen[cs]e at"),
    ("ApacheAsIs", "licen", r"unless required by applicable law or agreed to in writing software distributed under the licen[cs]e"),
    ("GplRedist", "licen", r"you can redistribute it and or modify it under the terms of the gnu (?P<k>lesser |library |affero )?general public licen[cs]e.{0,300}?version (?P<v>\d+(?:\.\d+)*)(?P<later>(?:(?!you can redistribute).){0,300}? any later version)?"),
    ("GplRef", "licen", r"(?:released|licensed|distributed) under (?:the )?(?:terms of )?(?:the )?gnu (?P<k>lesser |library |affero )?general public licen[cs]e(?:(?:(?!licensed under).){0,300}?(?:version|v) ?(?P<v>\d+(?:\.\d+)*))?(?P<later>(?:(?!licensed under).){0,300}? any later version)?"),
    ("GplWarranty", "warrant", r"without any warranty without even the implied warranty of merchantability or fitness"),
    ("GplCopy", "licen", r"you should have received a copy of the gnu (?:lesser |library |affero )?general public licen[cs]e"),
    ("MplRef", "licen", r"subject to the terms of the mozilla public licen[cs]e,?(?: version| v)? ?(?P<v>\d+(?:\.\d+)*)"),
    ("EplRef", "licen", r"under the terms of the eclipse public licen[cs]e(?: version| v)? ?(?P<v>\d+(?:\.\d+)*)"),
    ("CcRef", "licen", r"licensed under (?:a |the )?(?:cc|creative commons) ?(?P<k>by(?: (?:nc|nd|sa))*|attribution(?: (?:noncommercial|sharealike|noderivatives|non commercial|share alike|no derivatives))*)(?: (?P<v>\d+(?:\.\d+)*))?"),
    ("CcZero", "licen", r"licensed under (?:the )?(?:cc0|creative commons zero)(?: (?P<v>\d+(?:\.\d+)*))?"),
    ("Unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("AsIs", "warrant", r"(?:the software|this software) is provided .{0,300}?as is .{0,300}?without (?:any )?(?:express or implied )?warrant"),
    ("Liability", "liab", r"in no event (?:shall|will) .{0,300}? be (?:held )?liable"),
    ("AllRights", "reserved", r"\ball rights reserved"),
    ("ApacheTitle", "apache licen", r"^(?:the )?apache licen[cs]e version (?P<v>\d+(?:\.\d+)*) january 2004"),
    ("ApacheTerms", "licen", r"subject to the terms and conditions of this licen[cs]e each contributor hereby grants to you a perpetual"),
    ("GplTitle", "public licen", r"^(?:the )?gnu (?P<k>lesser |library |affero )?general public licen[cs]e version (?P<v>\d+(?:\.\d+)*) (?:\d\d? )?(?:january|february|june|november)"),
    ("GplTerms", "licen", r"everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document but changing it is not allowed"),
    ("MplTitle", "public licen", r"^(?:the )?mozilla public licen[cs]e version (?P<v>\d+(?:\.\d+)*)"),
    ("BoostGrant", "permission", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("ZlibGrant", "permission", r"permission is granted to anyone to use this software for any purpose including commercial applications"),
    ("ZlibMarked", "altered source", r"altered source versions must be plainly marked as such"),
    ("CddlRef", "licen", r"common development and distribution licen[cs]e(?: version| v)? ?(?P<v>\d+(?:\.\d+)*)?"),
    ("EuplRef", "licen", r"licensed under (?:the )?(?:eupl|european union public licen[cs]e)(?: version| v)? ?(?P<v>\d+(?:\.\d+)*)?"),
    ("ArtisticRef", "licen", r"under (?:the )?(?:terms of )?(?:the )?artistic licen[cs]e(?: version| v)? ?(?P<v>\d+(?:\.\d+)*)?"),
    ("Wtfpl", "public licen", r"do what the fuck you want to public licen[cs]e"),
    ("Spdx", "spdx", r"spdx licen[cs]e identifier (?P<k>[a-z0-9][a-z0-9. ]*)"),
]

#: Fixed values: (licence, identifiers in order), most specific first; `{v}` and `{k}` are taken from the first sentence.
RULES = [
    ("BSD-4-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAdvert", "BsdEndorse")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("MIT", ("MitGrant", "MitNotice", "AsIs")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("ISC", ("IscGrant", "AsIs")),
    ("ISC", ("IscGrant",)),
    ("Apache-{v}", ("ApacheTitle", "ApacheTerms")),
    ("Apache-{v}", ("ApacheRef", "ApacheUse", "ApacheCopy", "ApacheAsIs")),
    ("Apache-{v}", ("ApacheRef", "ApacheCopy", "ApacheAsIs")),
    ("Apache-{v}", ("ApacheTitle",)),
    ("{k}GPL-{v}", ("GplTitle", "GplTerms")),
    ("{k}GPL-{v}", ("GplTitle",)),
    ("{k}GPL-{v}", ("GplRedist", "GplWarranty", "GplCopy")),
    ("{k}GPL-{v}", ("GplRedist", "GplCopy")),
    ("{k}GPL-{v}", ("GplRedist",)),
    ("{k}GPL-{v}", ("GplRef",)),
    ("Apache-{v}", ("ApacheRef",)),
    ("MIT", ("MitRef",)),
    ("BSD-{v}-Clause", ("BsdRef",)),
    ("MPL-{v}", ("MplTitle",)),
    ("MPL-{v}", ("MplRef",)),
    ("BSL-1.0", ("BoostGrant",)),
    ("Zlib", ("ZlibGrant", "ZlibMarked")),
    ("CDDL-{v}", ("CddlRef",)),
    ("EUPL-{v}", ("EuplRef",)),
    ("Artistic-{v}", ("ArtisticRef",)),
    ("WTFPL", ("Wtfpl",)),
    ("EPL-{v}", ("EplRef",)),
    ("CC0-{v}", ("CcZero",)),
    ("CC-{k}-{v}", ("CcRef",)),
    ("Unlicense", ("Unlicense",)),
    ("SPDX:{k}", ("Spdx",)),
    ("Proprietary", ("AllRights",)),
]
_KINDS = {"lesser": "L", "library": "L", "affero": "A"}
_COMPILED = [(name, trigger, re.compile(pattern)) for name, trigger, pattern in SENTENCES]
TRIGGER = re.compile("|".join(sorted({t for _, t, _ in SENTENCES})))
HINT = re.compile(r"\blicen[cs]ed? (?:under|by|to)\b|\bunder (?:the|a) .{0,60}\blicen[cs]e\b|\blicen[cs]e agreement\b")
BREAK = re.compile(r"(?<=[.!?;])[\s\"')\]]+|\n\s*\n")
MARKS = re.compile(r"[^\w.]+|(?<!\d)\.|\.(?!\d)|_")


def normalise(sentence: str) -> str:
    return " ".join(MARKS.sub(" ", sentence.lower()).split())


def sentences(text: str) -> list[str]:
    return [x for x in (normalise(s) for s in BREAK.split(text)) if x]


def identify(sentence: str) -> list[tuple[str, dict[str, str]]]:
    """Identifiers of a normalised sentence, by place; several if short notices run together."""
    hits = []
    for name, trigger, pattern in _COMPILED:
        if trigger in sentence:
            hits += [(m.start(), m.end(), name, {k: v for k, v in m.groupdict().items() if v}) for m in pattern.finditer(sentence)]
    if not hits:
        return [("Unknown", {})] if HINT.search(sentence) else []
    hits.sort(key=lambda h: (h[0], -h[1]))
    return [(name, groups) for _, _, name, groups in hits]


def _name(rule: str, groups: dict[str, str]) -> str:
    kind = groups.get("k", "").strip()
    if "GPL" in rule:
        kind = _KINDS.get(kind, "")
    else:
        kind = kind.upper().replace(" ", "-")
        for long, short in (("ATTRIBUTION", "BY"), ("NON-COMMERCIAL", "NC"), ("NONCOMMERCIAL", "NC"), ("SHARE-ALIKE", "SA"), ("SHAREALIKE", "SA"), ("NO-DERIVATIVES", "ND"), ("NODERIVATIVES", "ND")):
            kind = kind.replace(long, short)
    version = groups.get("v") or groups.get("v2") or ""
    out = rule.format(k=kind, v=version).replace("--", "-").rstrip("-")
    return out + ("+" if groups.get("later") else "")


class _Unused:
    """Places of one identifier in a sequence; those used up are skipped in nearly constant time."""

    def __init__(self) -> None:
        self.places: list[int] = []
        self.next: list[int] = []

    def add(self, place: int) -> None:
        self.next.append(len(self.places))
        self.places.append(place)

    def _free(self, j: int) -> int:
        """The first unused entry from j on; one past the end if there is none."""
        n, path = self.next, []
        while j < len(n) and n[j] != j:
            path.append(j)
            j = n[j]
        for k in path:
            n[k] = j
        return j

    def after(self, place: int) -> int | None:
        j = self._free(bisect_right(self.places, place))
        return self.places[j] if j < len(self.places) else None

    def use(self, place: int) -> None:
        j = bisect_right(self.places, place) - 1
        self.next[j] = j + 1


def match_rules(found: list[tuple[int, str, dict[str, str]]]) -> list[str]:
    """Licences of a sequence of (sentence number, identifier, groups), in order of their first sentence."""
    by: dict[str, _Unused] = {}
    for k, (_, name, _) in enumerate(found):
        by.setdefault(name, _Unused()).add(k)
    out: list[tuple[int, str]] = []
    for gap in (GAP, None):
        for licence, wanted in RULES:
            if any(w not in by for w in wanted):
                continue
            start = by[wanted[0]].after(-1)
            while start is not None:
                path = [start]
                for want in wanted[1:]:
                    k = by[want].after(path[-1])
                    if k is None or gap is not None and found[k][0] - found[path[-1]][0] > gap + 1:
                        break
                    path.append(k)
                if len(path) == len(wanted):
                    for k, want in zip(path, wanted, strict=True):
                        by[want].use(k)
                    out.append((start, _name(licence, found[start][2])))
                start = by[wanted[0]].after(start)
    return list(dict.fromkeys(x for _, x in sorted(out)))


def match_rules_plainly(found: list[tuple[int, str, dict[str, str]]]) -> list[str]:
    """The same by search, for tests."""
    used = [False] * len(found)
    out: list[tuple[int, str]] = []
    for gap in (GAP, len(found) and found[-1][0] + 1):
        for licence, wanted in RULES:
            for start, (_, name, groups) in enumerate(found):
                if used[start] or name != wanted[0]:
                    continue
                path = [start]
                for want in wanted[1:]:
                    nxt = next((k for k in range(path[-1] + 1, len(found)) if not used[k] and found[k][1] == want), None)
                    if nxt is None or found[nxt][0] - found[path[-1]][0] > gap + 1:
                        break
                    path.append(nxt)
                if len(path) == len(wanted):
                    for k in path:
                        used[k] = True
                    out.append((start, _name(licence, groups)))
    return list(dict.fromkeys(x for _, x in sorted(out)))


def scan_text(text: str) -> tuple[list[str], list[str]]:
    """(licences, identifiers) of a whole text."""
    low = text.lower()
    if not TRIGGER.search(low):
        return [], []
    found = [(k, name, groups) for k, s in enumerate(sentences(low)) if TRIGGER.search(s) for name, groups in identify(s)]
    names = [name + (f":{g.get('v') or g.get('v2')}" if g.get("v") or g.get("v2") else "") for _, name, g in found]
    return match_rules(found), names


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: licences, identified sentences in order, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [scan_text(raw.decode("utf-8", "replace")) for raw in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    *(pa.array([x[k] for x in out], pa.list_(pa.string())) for k in (0, 1)),
                    pa.array([len(x[1]) for x in out], pa.int32()),
                    pa.array([x[1].count("Unknown") for x in out], pa.int32()),
                ],
                names=["doc_id", "licences", "sentence_ids", "n_sentences", "n_unknown"],
            )

    return texts(docs, id_col, text_col).mapInArrow(run, OUT)
