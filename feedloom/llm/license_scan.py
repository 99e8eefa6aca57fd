"""Licence scans by sentence rules.

Texts are read as words: runs of ASCII letters and digits in lower case, with
one spelling of "license" and of "http", so wrapping, comment signs, quotes and
punctuation don't count.  At each place where a sentence or a line may begin,
the longest known licence sentence that ends at a clause's end is looked up
in a tree of words and gives its identifier.  Grants ("this work is released
under the MIT or Apache 2.0 license") are sentences of a small grammar over the
names of licences; tags (``SPDX-License-Identifier: MIT OR Apache-2.0``) are
parsed as expressions.  The identifiers found, in order, are matched
against ordered rules: a rule matches where its identifiers follow each other
with at most ``gap`` unknown sentences between two of them.  Longer rules go
first and a sentence supports one rule only.

No text is set aside before recognition: the places to look at are found with a
pattern of the first two words of every known sentence and of every form of
a grant, which is derived from them.  Work is in proportion to the text's length:
at each place no more than the longest known sentence is read.

Defined results: null and empty texts give no row; a licence named twice gives
two rows; equal rows give equal findings each.  Offsets count characters of the
original text.  Of known sentences that begin at one place the longest counts.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidy

# The words of grants.
VERBS = ("licensed", "dual licensed", "released", "distributed", "published", "available", "made available", "provided", "offered", "covered", "relicensed")
DETERMINERS = ("this", "the", "all", "our", "its")
SUBJECTS = ("work", "works", "project", "program", "software", "library", "code", "source code", "content", "contents", "text", "document", "documents", "documentation", "file", "files", "package", "repository", "module", "dataset", "data", "material", "font", "model", "article", "page", "site", "website", "tool", "application")
BEFORE_VERB = ("is", "are", "is being", "was", "has been", "have been", "may be", "can be", "shall be", "is hereby", "are hereby", "is now", "is also")

#: Names under which licences are granted; fixed values.
NAMES = {
    "MIT": ("mit license", "mit", "expat license", "mit expat license", "x11 mit license"),
    "MIT-0": ("mit 0 license", "mit no attribution license"),
    "Apache-2.0": ("apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0", "apache license v2 0", "apache license v2", "apache v2", "asl 2 0", "apache 2", "apache license version 2", "apache software license 2 0"),
    "GPL-3.0": ("gnu general public license version 3", "gnu general public license v3 0", "gnu general public license v3", "gnu gpl version 3", "gnu gpl v3", "gpl version 3", "gpl v3", "gplv3 license", "gplv3", "gpl 3 0", "gpl 3"),
    "GPL-2.0": ("gnu general public license version 2", "gnu general public license v2 0", "gnu general public license v2", "gnu gpl version 2", "gnu gpl v2", "gpl version 2", "gpl v2", "gplv2 license", "gplv2", "gpl 2 0", "gpl 2"),
    "LGPL-2.1": ("gnu lesser general public license version 2 1", "gnu lesser general public license v2 1", "gnu lgpl version 2 1", "lgpl version 2 1", "lgpl v2 1", "lgplv2 1", "lgpl 2 1"),
    "LGPL-3.0": ("gnu lesser general public license version 3", "gnu lesser general public license v3", "gnu lgpl version 3", "lgpl version 3", "lgpl v3", "lgplv3", "lgpl 3 0"),
    "AGPL-3.0": ("gnu affero general public license version 3", "gnu affero general public license v3", "gnu agpl version 3", "agpl version 3", "agpl v3", "agplv3", "agpl 3 0"),
    "BSD-3-Clause": ("bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license", "bsd 3 clause", "three clause bsd license"),
    "BSD-2-Clause": ("bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "freebsd license", "bsd 2 clause", "two clause bsd license"),
    "ISC": ("isc license", "isc"),
    "MPL-2.0": ("mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0", "mpl 2 0", "mpl version 2 0"),
    "EPL-2.0": ("eclipse public license version 2 0", "eclipse public license 2 0", "eclipse public license v 2 0", "epl 2 0"),
    "CC0-1.0": ("cc0 1 0", "cc0 1 0 universal", "creative commons zero license", "creative commons cc0 1 0 universal license", "cc0"),
    "CC-BY-4.0": ("cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 license", "creative commons by 4 0 license"),
    "CC-BY-SA-4.0": ("cc by sa 4 0", "creative commons attribution sharealike 4 0 international license", "creative commons attribution share alike 4 0 international license"),
    "CC-BY-SA-3.0": ("cc by sa 3 0", "creative commons attribution sharealike 3 0 unported license", "creative commons attribution share alike 3 0 unported license"),
    "CC-BY-3.0": ("cc by 3 0", "creative commons attribution 3 0 unported license"),
    "CC-BY-NC-4.0": ("cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license", "creative commons attribution non commercial 4 0 international license"),
    "CC-BY-ND-4.0": ("cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"),
    "Unlicense": ("unlicense",),
    "BSL-1.0": ("boost software license version 1 0", "boost software license 1 0"),
    "Zlib": ("zlib license", "zlib libpng license"),
    "Artistic-2.0": ("artistic license 2 0", "artistic license version 2 0"),
    "OFL-1.1": ("sil open font license version 1 1", "sil open font license 1 1"),
}

#: Known sentences of licence texts; "..." stands for one or more words of its paragraph.  Fixed values.
SENTENCES = {
    "rights": "all rights reserved",
    "mit.title": "MIT License",
    "mit.title.the": "The MIT License (MIT)",
    "mit.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit0.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.',
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit.notice.next": "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software.",
    "mit.warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit.liability": "IN NO EVENT SHALL THE ... BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc.grant.and": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc.warranty": 'THE SOFTWARE IS PROVIDED "AS IS" AND ... DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "isc.liability": "IN NO EVENT SHALL ... BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd.name": "Neither the name of ... nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd.name.their": "Neither the name of ... nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd.warranty": 'THIS SOFTWARE IS PROVIDED BY ... "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd.liability": "IN NO EVENT SHALL ... BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "apache.grant": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache.use": "you may not use this file except in compliance with the License.",
    "apache.copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache.warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache.see": "See the License for the specific language governing permissions and limitations under the License.",
    "gpl.warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl.warranty": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl.terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl.copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "mpl.copy.www": "If a copy of the MPL was not distributed with this file, You can obtain one at http://www.mozilla.org/MPL/2.0/.",
    "epl.terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
    "cc0.waiver": "To the extent possible under law, ... waived all copyright and related or neighboring rights to ...",
    "cc0.dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "unlicense.domain": "This is free and unencumbered software released into the public domain.",
    "unlicense.use": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib.warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib.liability": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib.grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost.grant": "Distributed under the Boost Software License, Version 1.0.",
    "ofl.grant": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
}

#: Headers of the GNU licences: name of what is free, its licence, version and what follows "version".
GNU = [("program", "GNU General Public License", "GPL", ("2", "3")), ("library", "GNU Lesser General Public License", "LGPL", ("2.1", "3")), ("program", "GNU Lesser General Public License", "LGPL", ("2.1", "3")), ("program", "GNU Affero General Public License", "AGPL", ("3",))]


def _gnu() -> Iterator[tuple[str, str, str]]:
    """(identifier, sentence, licence) of the headers, for later versions and for one version only."""
    for n, (what, name, short, versions) in enumerate(GNU):
        for v in versions:
            license_ = f"{short}-{v if '.' in v else v + '.0'}"
            start = f"This {what} is free software; you can redistribute it and/or modify it under the terms of the {name}"
            yield f"{license_}.later.{n}", f"{start} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.", f"{license_}-or-later"
            yield f"{license_}.only.{n}", f"{start} version {v} as published by the Free Software Foundation.", f"{license_}-only"
            yield f"{license_}.only.{n}b", f"{start} as published by the Free Software Foundation, version {v}.", f"{license_}-only"


#: Rules: name, licence, known sentences; an alternative is written with "|", a sentence that may be missing with "?".
RULES = [
    ("mit.full", "MIT", ("mit.grant", "mit.notice|mit.notice.next", "mit.warranty", "?mit.liability")),
    ("mit0.full", "MIT-0", ("mit0.grant", "mit.warranty", "?mit.liability")),
    ("isc.full", "ISC", ("isc.grant|isc.grant.and", "isc.warranty", "?isc.liability")),
    ("0bsd.full", "0BSD", ("0bsd.grant", "isc.warranty", "?isc.liability")),
    ("bsd3.full", "BSD-3-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "bsd.name|bsd.name.their", "?bsd.warranty", "?bsd.liability")),
    ("bsd2.full", "BSD-2-Clause", ("bsd.grant", "bsd.source", "bsd.binary", "?bsd.warranty", "?bsd.liability")),
    ("apache2.full", "Apache-2.0", ("apache.grant", "apache.use", "apache.copy", "apache.warranty", "?apache.see")),
    ("mpl2.full", "MPL-2.0", ("mpl.terms", "mpl.copy|mpl.copy.www")),
    ("zlib.full", "Zlib", ("zlib.warranty", "zlib.liability", "zlib.grant")),
    ("unlicense.full", "Unlicense", ("unlicense.domain", "unlicense.use")),
    ("mit.grant", "MIT", ("mit.grant", "?mit.notice|mit.notice.next")),
    ("mit0.grant", "MIT-0", ("mit0.grant",)),
    ("isc.grant", "ISC", ("isc.grant|isc.grant.and",)),
    ("0bsd.grant", "0BSD", ("0bsd.grant",)),
    ("apache2.grant", "Apache-2.0", ("apache.grant", "?apache.use", "?apache.copy")),
    ("mpl2.grant", "MPL-2.0", ("mpl.terms",)),
    ("epl2.grant", "EPL-2.0", ("epl.terms",)),
    ("cc0", "CC0-1.0", ("cc0.waiver|cc0.dedicated",)),
    ("zlib.grant", "Zlib", ("zlib.grant",)),
    ("boost.grant", "BSL-1.0", ("boost.grant",)),
    ("ofl.grant", "OFL-1.1", ("ofl.grant",)),
    ("unlicense", "Unlicense", ("unlicense.domain",)),
    ("proprietary", "Proprietary", ("copyright", "rights")),
]
WORD = re.compile(r"[a-z0-9]+")
#: What follows a clause: its sign, the line's or the text's end.
_clause = re.compile(r"[\"'“”’)\]>]*[ \t]*(?:[.!?;:,()\n*<–—|]|-|$)")
#: What ends a sentence, also an empty line, with or without a comment's sign.
BOUNDARY = re.compile(r"[.!?;:][\"')\]]*(?=\s|$)|\n[ \t]*(?:#+|//+|\*|;+)?[ \t]*(?=\n)")
_spelling = {"licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "unlicence": "unlicense", "https": "http"}
_stop = re.compile(r"[.!?;:(]|\n\s*\n")
_item = re.compile(r"\(?[0-9a-z]{1,3}[.)][ \t]+$")


def lowered(text: str) -> str:
    """In lower case, character by character (U+0130 alone would become two)."""
    return text.replace("İ", "i").lower()


def words_of(text: str) -> list[str]:
    return [_spelling.get(w, w) for w in WORD.findall(lowered(text))]


@cache
def catalogue() -> dict[str, list[str]]:
    """Identifier to the words of its sentence; a wild part is an empty word."""
    known = dict(SENTENCES) | {i: s for i, s, _ in _gnu()}
    return {i: [w for k, part in enumerate(s.split("...")) for w in ([""] if k else []) + words_of(part)] for i, s in known.items()}


@cache
def sentence_tree() -> dict:
    root: dict = {}
    for i, words in catalogue().items():
        node = root
        for w in words:
            node = node.setdefault(w, {})
        node[None] = i
    return root


@cache
def name_tree() -> dict:
    root: dict = {}
    for license_, all_of in NAMES.items():
        for name in all_of:
            node = root
            for w in name.split():
                node = node.setdefault(w, {})
            node[None] = license_
    return root


@cache
def rules() -> list[tuple[str, str, list[tuple[set[str], bool]]]]:
    """RULES and those of the headers: (identifiers, whether it may be missing) of each sentence; the longest first.

    A rule may follow a copyright line and "all rights reserved", which then are part of it.
    """
    given = [*RULES, *((f"{i.rsplit('.', 1)[0].lower()}.full", l, (i, f"?{'lgpl' if 'library' in s else 'gpl'}.warranty")) for i, s, l in _gnu())]
    out = []
    for name, license_, wanted in given:
        steps = [(set(w.lstrip("?").split("|")), w.startswith("?")) for w in wanted]
        out.append((name, license_, steps))
        if name != "proprietary":
            out.append((name, license_, [({"copyright"}, False), ({"rights"}, False), *steps]))
    return sorted(out, key=lambda r: -sum(not may for _, may in r[2]))


@cache
def openings() -> re.Pattern:
    """The first two words of all that is looked up."""
    spelled = {}
    for k, v in _spelling.items():
        spelled.setdefault(v, [v]).append(k)
    pairs = {tuple(words[:2]) for words in catalogue().values()}
    subjects = [w.split() for w in (*SUBJECTS, *VERBS)]
    pairs |= {(d, s[0]) for d in DETERMINERS for s in subjects}
    pairs |= {tuple((s.split() + b.split())[:2]) for s in SUBJECTS for b in BEFORE_VERB}
    pairs |= {tuple((v.split() + ["under"])[:2]) for v in VERBS}
    by_first: dict[str, set[str]] = {}
    for a, b in pairs:
        for x, y in product(spelled.get(a, [a]), spelled.get(b, [b])):
            by_first.setdefault(x, set()).add(y)
    branches = [f"{a}[^a-z0-9]+(?:{'|'.join(sorted(bs, key=lambda w: (-len(w), w)))})(?![a-z0-9])" for a, bs in sorted(by_first.items())]
    return re.compile("|".join([*branches, r"copyright(?![a-z0-9])", r"spdx-license-identifier:"]))


@cache
def phrase_tree(phrases: tuple[str, ...]) -> dict:
    root: dict = {}
    for p in phrases:
        node = root
        for w in p.split():
            node = node.setdefault(w, {})
        node[None] = True
    return root


class Words:
    """The words of a text from a place on, read as they are needed: (word, start, end).

    ``vain`` belongs to the text: up to which place a search for the end of a wild part has already found none.
    """

    def __init__(self, low: str, at: int, vain: dict[int, int]):
        self.low, self.read, self.more, self.vain = low, [], WORD.finditer(low, at), vain

    def get(self, k: int) -> str | None:
        while len(self.read) <= k:
            m = next(self.more, None)
            if m is None:
                return None
            self.read.append((_spelling.get(m[0], m[0]), m.start(), m.end()))
        return self.read[k][0]

    def closes(self, k: int) -> bool:
        """Whether a clause may end after word ``k``."""
        return k >= 0 and _clause.match(self.low, self.read[k][2]) is not None

    def seems(self, k: int, phrases: tuple[str, ...]) -> int:
        """The number of words of the longest of the phrases that stands at ``k``."""
        node, n, best = phrase_tree(phrases), 0, 0
        while (w := self.get(k + n)) is not None and w in node:
            node, n = node[w], n + 1
            if None in node:
                best = n
        return best

    def parted(self, k: int) -> bool:
        """Whether an empty line stands before word ``k``."""
        return k > 0 and self.low.count("\n", self.read[k - 1][2], self.read[k][1]) > 1

    def ahead(self, k: int, what: int, test: Callable[[int], object]):
        """(place, result) of the first word from ``k`` on, in its paragraph, that passes; ``what`` names the test.

        A test looks at a place only, so what one search found to hold none, a later one needn't read: all searches
        of a text take linear time together.
        """
        if self.get(k) is None or self.read[k][1] < self.vain.get(what, 0) or self.parted(k) or self.parted(k - 1):
            return None
        while True:
            if found := test(k):
                return k, found
            k += 1
            if self.get(k) is None or self.parted(k):
                self.vain[what] = self.read[k - 1][2]
                return None


def _longest(words: Words, node: dict, k: int, wild: bool = False) -> tuple[int, str] | None:
    """The end (a number of words) and the identifier of the longest sentence below ``node``."""
    best = (k, node[None]) if None in node and k and (wild or words.closes(k - 1)) else None
    w = words.get(k)
    if w is not None and w in node:
        best = max(filter(None, (best, _longest(words, node[w], k + 1))), default=None)
    if "" in node:
        after = node[""]
        if None in after and (last := words.ahead(k, -id(after), words.closes)):  # a wild part at the end
            best = max(filter(None, (best, (last[0] + 1, after[None]))))
        found = words.ahead(k + 1, id(after), lambda j: words.get(j) in after and _longest(words, after[words.get(j)], j + 1))
        best = max(filter(None, (best, found and found[1])), default=None)
    return best


def _name(words: Words, k: int) -> tuple[int, str] | None:
    """The longest name of a licence at word ``k``, with what is said of its version."""
    node, best, at = name_tree(), None, k
    while (w := words.get(at)) is not None and w in node:
        node, at = node[w], at + 1
        if None in node:
            best = (at, node[None])
    if best is None:
        return None
    at, license_ = best
    at += words.seems(at, ("license", "licenses"))
    later = words.seems(at, ("or later", "or any later version", "or at your option any later version", "or newer", "or above", "or higher"))
    only = words.seems(at, ("only",))
    gnu = license_.split("-")[0] in ("GPL", "LGPL", "AGPL")
    return at + later + only, license_ + ("-or-later" if later and gnu else "-only" if only and gnu else "")


def _grant(words: Words) -> tuple[int, str] | None:
    """(end, licence expression) of a grant that begins with the first word."""
    k = words.seems(0, DETERMINERS)
    subject = words.seems(k, SUBJECTS)
    if subject:
        be = words.seems(k + subject, BEFORE_VERB)
        k = k + subject + be
        if not be:
            return None
    elif k:
        return None
    verb = words.seems(k, VERBS)
    k += verb
    if not verb or words.get(k) != "under":
        return None
    k += 1
    names, joint, best = [], "OR", None
    while True:
        k += words.seems(k, ("the terms of", "the terms and conditions of", "terms of", "either"))
        k += words.seems(k, ("the", "an", "a", "both the", "both"))
        found = _name(words, k)
        if found is None:
            return best
        k, name = found
        names.append(name)
        k += words.seems(k, ("license", "licenses"))
        if words.closes(k - 1) or words.get(k) is None:
            best = k, f" {joint} ".join(names)
        step = words.seems(k, ("and or", "or", "and"))
        if words.get(k) is None or _stop.search(words.low, words.read[k - 1][2], words.read[k][1]):
            return best
        if step == 1 and words.get(k) == "and":
            joint = "AND"
        if not step and "," not in words.low[words.read[k - 1][2] : words.read[k][1]]:
            return best if words.closes(k - 1) else None
        k += step
        if not words.get(k):
            return best


_token = re.compile(r"[ \t]*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*)")


def spdx(text: str, at: int) -> tuple[int, str] | None:
    """(end, expression) of the licence expression at a place: the longest valid beginning on its line."""

    def primary(i: int) -> tuple[int, str] | None:
        m = _token.match(text, i)
        if m is None or m[1] == ")":
            return None
        if m[1] == "(":
            inner = any_of(m.end())
            close = _token.match(text, inner[0]) if inner else None
            return (close.end(), f"({inner[1]})") if close and close[1] == ")" else None
        if m[1].upper() in ("AND", "OR", "WITH"):
            return None
        name = m[1].rstrip(".-")
        end = m.start(1) + len(name)
        with_ = _token.match(text, end)
        if with_ and with_[1].upper() == "WITH":
            what = _token.match(text, with_.end())
            if what and what[1] not in "()":
                exception = what[1].rstrip(".-")
                return what.start(1) + len(exception), f"{name} WITH {exception}"
        return end, name

    def chain(i: int, sign: str, of) -> tuple[int, str] | None:
        first = of(i)
        if first is None:
            return None
        end, parts = first[0], [first[1]]
        while (m := _token.match(text, end)) and m[1].upper() == sign and (more := of(m.end())):
            end, parts = more[0], [*parts, more[1]]
        return end, f" {sign} ".join(parts)

    def all_of(i: int):
        return chain(i, "AND", primary)

    def any_of(i: int):
        return chain(i, "OR", all_of)

    return any_of(at)


def _opens(low: str, at: int, done: int) -> bool:
    """Whether a sentence, a line or an item of a list begins here; ``done`` is the end of what is known."""
    k = at
    while k > done and not low[k - 1].isalnum():
        k -= 1
    if k == done and (k == 0 or k < at):
        return True
    gap = low[k:at]
    if "\n" in gap or re.match(r"[.!?;:][\"')\]]*\s", gap):
        return True
    item = _item.search(low, max(done, at - 8), at)
    return item is not None and (item.start() == 0 or low[item.start() - 1].isspace())


def recognised(text: str) -> list[tuple[int, int, str]]:
    """(start, end, identifier) of known sentences, grants (``=`` and an expression) and tags (``~``), in order."""
    low, out, done = lowered(text), [], 0
    vain: dict[int, int] = {}
    pattern, at = openings(), 0
    while m := pattern.search(low, at):
        start = m.start()
        at = start + 1 if low[start : start + 1].isalnum() else m.end()
        while at < len(low) and low[at].isalnum():
            at += 1
        if start and low[start - 1].isalnum():
            continue
        if m[0].startswith("spdx"):
            found = spdx(text, m.end())
            if found:
                out.append((start, found[0], "~" + found[1]))
                at = done = found[0]
            continue
        if not _opens(low, start, done):
            continue
        words = Words(low, start, vain)
        found = _longest(words, sentence_tree(), 0)
        if found is None and (granted := _grant(words)):
            found = (granted[0], "=" + granted[1])
        if found is None and m[0] == "copyright":
            cut = BOUNDARY.search(low, m.end())
            line = low.find("\n", m.end())
            end = min(x for x in (cut.start() + 1 if cut else len(low), line if line >= 0 else len(low)))
            out.append((start, end, "copyright"))
            at = done = end
            continue
        if found:
            end = words.read[found[0] - 1][2]
            end = re.compile(r"[\"'”)\]]*[.;:!]?").match(low, end).end()
            out.append((start, end, found[1]))
            at = done = end
    return out


def numbered(text: str, found: list[tuple[int, int, str]]) -> list[int]:
    """The number of each known sentence among all sentences of the text."""
    out, low, done, n = [], lowered(text) if found else "", 0, -1
    for start, end, _ in found:
        n += 1 + sum(1 for part in BOUNDARY.split(low[done:start]) if WORD.search(part))
        out.append(n)
        done = end
    return out


def match_rules(ids: list[str], at: list[int] | None = None, gap: int = 2) -> list[tuple[str, str, list[int]]]:
    """(rule, licence, places in ``ids``), each sentence in one rule at most; ``at`` holds the sentences' numbers."""
    at = list(range(len(ids))) if at is None else at
    where: dict[str, list[int]] = {}
    for k, i in enumerate(ids):
        where.setdefault(i, []).append(k)
    used: set[int] = set()
    out = []
    for name, license_, steps in rules():
        for first in sorted(k for i in steps[0][0] for k in where.get(i, ())):
            if first in used:
                continue
            paths = {first: [first]}  # the last sentence to a path that leads to it
            for wanted, may in steps[1:]:
                longer: dict[int, list[int]] = {}
                for last, path in sorted(paths.items()):
                    for i in wanted:
                        places = where.get(i, [])
                        for k in places[bisect_left(places, last + 1) :]:
                            if at[k] > at[last] + gap + 1:
                                break
                            if k not in used:
                                longer.setdefault(k, [*path, k])
                if longer or not may:
                    paths = longer
            if paths:
                path = paths[min(paths)]
                used.update(path)
                out.append((name, license_, path))
    out += [(f"named.{i[1:]}" if i[0] == "=" else "spdx", i[1:], [k]) for k, i in enumerate(ids) if i[0] in "=~"]
    begins = sorted(at[path[0]] for _, _, path in out)

    def reserved(path: list[int]) -> bool:
        """Whether no licence follows these rights."""
        last = at[path[-1]]
        k = bisect_left(begins, last + 1)
        return k == len(begins) or begins[k] > last + gap + 1

    return sorted((r for r in out if r[0] != "proprietary" or reserved(r[2])), key=lambda r: r[2])


def licenses(text: str, gap: int = 2) -> list[tuple[str, str, int, int, int, int]]:
    """(licence, rule, first and last sentence, start, end) of all licences of a text."""
    found = recognised(text)
    if not found:
        return []
    at = numbered(text, found)
    return [(license_, rule, at[path[0]], at[path[-1]], found[path[0]][0], found[path[-1]][1]) for rule, license_, path in match_rules([i for _, _, i in found], at, gap)]


KINDS = {"doc_id": pa.int64(), "license": pa.string(), "rule": pa.string(), "first_sentence": pa.int32(), "last_sentence": pa.int32(), "start": pa.int32(), "stop": pa.int32(), "span": pa.string()}


def _scan(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py()
                rows += [(doc, *f, t[f[-2] : f[-1]]) for f in licenses(t or "", gap)]
            columns = zip(*rows, strict=True) if rows else [()] * len(KINDS)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, KINDS.values(), strict=True)], names=list(KINDS))

    return run


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gap: int = 2) -> DataFrame:
    """One row per licence found: doc_id, license, rule, first_sentence, last_sentence, start, stop, span."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(tidy(_scan(gap)), "doc_id long, license string, rule string, first_sentence int, last_sentence int, start int, stop int, span string")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
