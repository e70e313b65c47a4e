"""License scans by sentence rules.

A text is cut into sentences, each is normalised (lower case, letters and digits only)
and looked up among known licence sentences, which are cut the same way and whose parts
have an id each; equal parts share one. What is then matched is the sequence of
ids, against ordered rules: a rule is a licence and the ids that must follow
each other, with at most ``GAP`` unknown sentences between two of them. Rules are tried
at each known sentence in order, longer rules first; a match uses up its sentences.
The endorsement sentence is known with any holder's name in it.

Edge cases: a null text has no sentences; a known sentence that no rule can use is
counted as loose, each part of it for itself; a licence found twice is two hits and one entry of ``licenses``; texts
of any length are read whole; rows that repeat an id each get a row; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import map_batches

GAP = 1

# A sentence ends with a mark before white space, a colon or semicolon too, or at a
# blank line. A single line end is white space, as licences are wrapped; lines that are
# a known sentence on their own are found as well, see ``sentences``.
ENDS = re.compile(r"(?<=[.!?:;])\s+|\n\s*\n")
APART = re.compile(r"[^0-9a-z]+")

# Sentences of public licences, by id.
SENTENCES = {
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-liability": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-licensed-the": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl3-licensed": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl-copy": "You should have received a copy of the GNU General Public License along with this program.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}

# Rules in the order tried among those of equal length, by whole sentences.
WHOLE_RULES = (
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-released",)),
    ("MIT", ("mit-licensed",)),
    ("Apache-2.0", ("apache-licensed-the", "apache-comply", "apache-copy", "apache-basis", "apache-see")),
    ("Apache-2.0", ("apache-licensed",)),
    ("Apache-2.0", ("apache-licensed-the",)),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details", "gpl-copy")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-details", "gpl-copy")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-3.0", ("gpl3-licensed",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-work",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-work",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-work",)),
)

def normal(sentence: str) -> str:
    return APART.sub(" ", sentence.lower()).strip()


def cut_sentences() -> tuple[dict[str, str], dict[str, tuple[str, ...]]]:
    """Ids of the normalised parts of all known sentences, and the ids of each sentence's parts."""
    known: dict[str, str] = {}
    parts: dict[str, tuple[str, ...]] = {}
    for name, sentence in SENTENCES.items():
        cut = [normal(part) for part in ENDS.split(sentence)]
        parts[name] = tuple(
            known.setdefault(part, name if len(cut) == 1 else f"{name}-{i}") for i, part in enumerate(cut, 1)
        )
    return known, parts


def known_sentences() -> dict[str, str]:
    return cut_sentences()[0]


PARTS = cut_sentences()[1]
RULES = tuple((licence, tuple(part for name in names for part in PARTS[name])) for licence, names in WHOLE_RULES)

# The endorsement sentence before and after the holder's name. Marks in a name
# ("Example, Inc.") may cut it, into a few pieces.
ENDORSE, HOLDER = "bsd-endorse", "the copyright holder"
BEFORE_HOLDER, AFTER_HOLDER = normal(SENTENCES[ENDORSE]).split(HOLDER)
HOLDER_PIECES = 4


def name_of(sentence: str, known: dict[str, str]) -> str | None:
    key = normal(sentence)
    if key.startswith(BEFORE_HOLDER) and key.endswith(AFTER_HOLDER) and len(key) > len(BEFORE_HOLDER) + len(AFTER_HOLDER):
        return ENDORSE
    return known.get(key)


def sentences(text: str, known: dict[str, str]) -> list[str | None]:
    """Ids of the sentences of a text in order, None for unknown ones.

    A sentence of several lines that is not known as a whole is taken line by line.
    """
    found: list[str | None] = []
    cut, at = ENDS.split(text), 0
    while at < len(cut):
        sentence, at = cut[at], at + 1
        name = name_of(sentence, known)
        if name is None and normal(sentence).startswith(BEFORE_HOLDER.rstrip()):
            whole = next((n for n in range(1, HOLDER_PIECES) if name_of(" ".join([sentence, *cut[at : at + n]]), known)), 0)
            if whole:
                name, at = ENDORSE, at + whole
        if name is None and "\n" in sentence:
            lines = [line for line in sentence.split("\n") if line.strip()]
            found += [name_of(line, known) for line in lines]
        elif name is not None or sentence.strip():
            found.append(name)
    return found


def match(ids: list[str | None], rules: list[tuple[str, tuple[str, ...]]], gap: int = GAP) -> tuple[list[tuple[str, int, int]], int]:
    """Hits (licence, first, last sentence) and the number of loose known sentences."""
    hits, loose, at, used = [], 0, 0, set()
    places = [i for i, name in enumerate(ids) if name is not None]
    for at in places:
        if at in used:
            continue
        for licence, parts in rules:
            where, here = [], at
            for part in parts:
                here = next((i for i in range(here, min(here + gap + 1, len(ids))) if ids[i] == part and i not in used), None) if where else (at if ids[at] == part else None)
                if here is None:
                    break
                where.append(here)
                here += 1
            else:
                hits.append((licence, where[0], where[-1]))
                used.update(where)
                break
        else:
            loose += 1
    return hits, loose


def by_length() -> list[tuple[str, tuple[str, ...]]]:
    return sorted(RULES, key=lambda rule: -len(rule[1]))


# What every known sentence has one of; other texts need no cutting.
HINTS = ("licen", "permi", "redistrib", "warrant", "free software", "software", "neither the name", "received a copy", "the license")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document its licences, the hits with their sentence numbers, and counts."""

    def run(batch: pa.RecordBatch) -> dict:
        known, rules, rows = known_sentences(), by_length(), []
        for value in batch.column("text"):
            text = value.as_py() or ""
            lower = text.lower()
            ids = sentences(text, known) if any(hint in lower for hint in HINTS) else []
            hits, loose = match(ids, rules)
            names = sorted({licence for licence, _, _ in hits})
            rows.append(("|".join(names), ",".join(f"{n}:{a}:{b}" for n, a, b in hits), len(hits), loose))
        return {"doc_id": batch.column("doc_id")} | dict(zip(("licenses", "hits", "n_hits", "n_loose"), zip(*rows)))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, licenses string, hits string, n_hits long, n_loose long")
