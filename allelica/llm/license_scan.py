"""License scans: template markup compiled into token automata.

Markup: ``<<beginOptional>> ... <<endOptional>>`` is wording that may be left out (regions nest), and
``<<var:LO-HI>>`` stands for LO to HI words of any kind. All other words are mandatory. A template is
compiled once into states with word, any-word and empty steps; a text is accepted from a place when the
automaton reaches its end, so its mandatory wording occurs there word for word and in order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allelica.llm.common import plain_words

# Phrases and their labels, as the task states them.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# The wording of public licenses, shared parts first. Words that a licensor fills in are
# replaceable, headings and lines that copies often lack are optional.
_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var:1-3>> software and associated documentation files "
    "(the <<beginOptional>>\"<<endOptional>>Software), to deal in the Software without restriction, including without limitation the rights to use, "
    "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
    "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
    "<<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software."
)
_MIT_WARRANTY = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var:1-8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR "
    "OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR "
    "OTHER DEALINGS IN THE SOFTWARE"
)
_ISC_GRANT = (
    "Permission to use, copy, modify, <<beginOptional>>and<<endOptional>> <<beginOptional>>or<<endOptional>> distribute this software for any purpose "
    "with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED AS IS AND <<var:1-8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var:1-8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<<beginOptional>><<var:1-1>><<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. <<beginOptional>><<var:1-1>><<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this "
    "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = (
    "<<beginOptional>><<var:1-1>><<endOptional>> Neither the name of <<var:1-10>> nor the names of <<var:1-3>> contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission."
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY <<var:1-8>> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var:1-8>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)

#: Public license notices and whole license texts, as templates. Labels follow the common short identifiers.
TEMPLATES = {
    "gpl-3.0": "<<beginOptional>>this <<var:1-3>> is<<endOptional>> licensed under the GNU General Public License version 3",
    "gpl-2.0": "<<beginOptional>>this <<var:1-3>> is<<endOptional>> licensed under the GNU General Public License version 2",
    "gpl-notice": (
        "This <<var:1-4>> is free software <<beginOptional>>:<<endOptional>> you can redistribute it and or modify it under the "
        "terms of the GNU General Public License as published by the Free Software Foundation "
        "<<beginOptional>>either<<endOptional>> version <<var:1-2>> of the License <<beginOptional>>or at your option any later version<<endOptional>>"
    ),
    "gpl-notice-text": (
        "This <<var:1-4>> is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version <<var:1-2>> of the License, or (at your option) any later version. This <<var:1-4>> is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR "
        "PURPOSE. See the GNU General Public License for more details."
    ),
    "apache-2.0": (
        "licensed under the Apache License Version 2.0 <<beginOptional>>the License you may not use this <<var:1-3>> except in "
        "compliance with the License<<endOptional>>"
    ),
    "apache-2.0-text": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this <<var:1-3>> except in compliance with the License. You may "
        "obtain a copy of the License at <<var:1-8>> Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "mit-notice": "<<beginOptional>>this <<var:1-3>> is<<endOptional>> released under the MIT License",
    "mit-grant": _GRANT,
    "mit-text": f"{_GRANT} {_MIT_WARRANTY}",
    "isc-grant": _ISC_GRANT,
    "isc-text": f"{_ISC_GRANT} {_ISC_WARRANTY}",
    "bsd-2-clause-text": f"{_BSD_TERMS} {_BSD_WARRANTY}",
    "bsd-3-clause-text": f"{_BSD_TERMS} {_BSD_NAMES} {_BSD_WARRANTY}",
    "bsd-terms": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "<<beginOptional>><<var:1-1>><<endOptional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer"
    ),
    "unlicense-text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "zlib-text": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from "
        "the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions: <<beginOptional>><<var:1-1>><<endOptional>> The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. <<beginOptional>><<var:1-1>><<endOptional>> Altered source versions must be plainly marked as "
        "such, and must not be misrepresented as being the original software. <<beginOptional>><<var:1-1>><<endOptional>> This notice may not be removed or "
        "altered from any source distribution."
    ),
    "cc-by-4.0": "licensed under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>>a<<endOptional>> CC BY 4.0",
    "cc-by-sa-4.0": "licensed under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>>a<<endOptional>> CC BY SA 4.0",
    "cc-by-nc-4.0": "licensed under <<beginOptional>>the terms of<<endOptional>> <<beginOptional>>a<<endOptional>> CC BY NC 4.0",
    "all-rights-reserved": "<<beginOptional>>copyright <<var:1-6>><<endOptional>> all rights reserved",
}

_MARK = re.compile(r"<<(beginOptional|endOptional|var:\d+-\d+)>>")


@dataclass
class Automaton:
    """States numbered from 0; the last one accepts."""

    words: list[dict[bytes, int]] = field(default_factory=list)  # state -> word -> next
    any_word: dict[int, int] = field(default_factory=dict)
    empty: dict[int, list[int]] = field(default_factory=dict)
    mandatory: set[bytes] = field(default_factory=set)
    closure: list[frozenset[int]] = field(default_factory=list)
    first: frozenset[bytes] = frozenset()

    def state(self) -> int:
        self.words.append({})
        return len(self.words) - 1

    def longest(self, text: list[bytes], at: int) -> int:
        """End of the longest accepted run of words from ``at``; -1 if there is none."""
        live, end, accept = self.closure[0], -1, len(self.words) - 1
        while True:
            if accept in live:
                end = at
            if at >= len(text) or not live:
                return end
            word, step = text[at], set()
            for s in live:
                if (n := self.words[s].get(word)) is not None:
                    step |= self.closure[n]
                if (n := self.any_word.get(s)) is not None:
                    step |= self.closure[n]
            live, at = frozenset(step), at + 1


def compile_template(markup: str) -> Automaton:
    a = Automaton()
    now, opened = a.state(), []
    for k, part in enumerate(_MARK.split(markup)):
        if k % 2 == 0:
            for w in plain_words(part.encode()):
                if not opened:
                    a.mandatory.add(w)
                n = a.state()
                a.words[now][w] = n
                now = n
        elif part == "beginOptional":
            opened.append(now)
            n = a.state()
            a.empty.setdefault(now, []).append(n)
            now = n
        elif part == "endOptional":
            start, n = opened.pop(), a.state()
            a.empty.setdefault(now, []).append(n)
            a.empty.setdefault(start, []).append(n)
            now = n
        else:
            low, high = map(int, part[4:].split("-"))
            exits = []
            for i in range(high):
                if i >= low:
                    exits.append(now)
                n = a.state()
                a.any_word[now] = n
                now = n
            n = a.state()
            for s in [*exits, now]:
                a.empty.setdefault(s, []).append(n)
            now = n
    if opened or not a.mandatory:
        raise ValueError("a template needs mandatory words and closed regions")
    for s in range(len(a.words)):
        seen, todo = {s}, [s]
        while todo:
            for n in a.empty.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        a.closure.append(frozenset(seen))
    if any(s in a.any_word for s in a.closure[0]):
        raise ValueError("a template must begin with a word")
    a.first = frozenset(w for s in a.closure[0] for w in a.words[s])
    return a


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.automata = {name: compile_template(t) for name, t in templates.items()}
        self.phrases = [(tuple(p.encode().split()), label) for p, label in phrases.items()]

    def scan(self, text: bytes | None) -> dict:
        """Base places (start, end, label) and accepted templates (start, end, label), and the words' number."""
        words = plain_words(text)
        held, places, accepted = set(words), [], []
        for phrase, label in self.phrases:
            if held.issuperset(phrase):
                at = -1
                while True:
                    try:
                        at = words.index(phrase[0], at + 1)
                    except ValueError:
                        break
                    if tuple(words[at : at + len(phrase)]) == phrase:
                        places.append((at, at + len(phrase), label))
        for name, a in self.automata.items():
            if held.issuperset(a.mandatory):
                for at in (k for k, w in enumerate(words) if w in a.first):
                    if (end := a.longest(words, at)) > 0:
                        accepted.append((at, end, name))
        return {"n_words": len(words), "places": sorted(places), "accepted": sorted(accepted)}


def score_of(places: list, accepted: list) -> float:
    """0 without evidence; half for base phrases or templates; one when every base phrase lies in accepted wording."""
    if not places and not accepted:
        return 0.0
    if not places:
        return 0.5
    inside = sum(any(a <= s and e <= b for a, b, _ in accepted) for s, e, _ in places)
    return 0.5 + 0.5 * inside / len(places)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (start, end, label of
    accepted templates).

    One row per row. A null or empty text has no words, no labels ('') and score 0; overlapping places of a
    phrase all count; repeated rows are scanned each; other columns are not read.
    """
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        scanner = Scanner(templates, phrases)
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for text in b.column("text").to_pylist():
                found = scanner.scan(text)
                places, accepted = found["places"], found["accepted"]
                base = {x[2] for x in places}
                for name, v in zip(out, (
                    found["n_words"], len(places), places[0][0] if places else None, places[-1][0] if places else None,
                    ",".join(sorted(base)), ",".join(sorted(base | {x[2] for x in accepted})), score_of(places, accepted),
                    [{"start": a, "end": e, "label": n} for a, e, n in accepted],
                ), strict=True):
                    out[name].append(v)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["doc_id", *out])

    return rows.mapInArrow(
        run,
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, "
        "score double, spans array<struct<start: bigint, `end`: bigint, label: string>>",
    )
