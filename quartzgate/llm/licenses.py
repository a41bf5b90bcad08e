"""License scans by template-markup matching.

A template is written in a small markup: plain words are mandatory, `[[ ... ]]` is optional and may
nest, `{{a-b}}` is replaceable by any a to b words, `{{#a-b}}` by a to b numbers. It is compiled once into an automaton over
tokens. A text is accepted where some run of its words leads from the template's opening words to
the end, so its mandatory wording matches exactly; punctuation, case and layout don't count.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from . import common

#: A-Z to lower case; other ASCII that is neither letter nor digit to a space.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

#: The base: phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: The templates, by label. Wording from the public licences.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files [[ the software ]] to deal in the software without restriction including without limitation "
    "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit "
    "persons to whom the software is furnished to do so subject to the following conditions the above copyright notice "
    "and this permission notice [[ including the next paragraph ]] shall be included in all copies or substantial "
    "portions of the software the software is provided as is without warranty of any kind express or implied including "
    "but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no "
    "event shall the {{1-5}} be liable for any claim damages or other liability whether in an action of contract tort or "
    "otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "mit-notice": "released under the {{0-1}} mit license",
    "apache-2": "licensed under the apache license version 2 0 [[ the license ]] you may not use this {{1-3}} except in "
    "compliance with the license [[ you may obtain a copy of the license at {{1-12}} ]] unless required by applicable "
    "law or agreed to in writing software distributed under the license is distributed on an as is basis without "
    "warranties or conditions of any kind either express or implied see the license for the specific language governing "
    "permissions and limitations under the license",
    "apache-2-notice": "licensed under the apache license version 2 [[ 0 ]]",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met [[ 1 ]] redistributions of source code must retain the above copyright notice this "
    "list of conditions and the following disclaimer [[ 2 ]] redistributions in binary form must reproduce the above "
    "copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
    "provided with the distribution [[ {{0-1}} neither the name of {{1-20}} nor the names of its contributors may be used "
    "to endorse or promote products derived from this software without specific prior written permission ]] this software "
    "is provided by {{1-12}} as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{1-12}} be "
    "liable for any direct indirect incidental special exemplary or consequential damages including but not limited to "
    "procurement of substitute goods or services loss of use data or profits or business interruption however caused and "
    "on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in "
    "any way out of the use of this software even if advised of the possibility of such damage",
    "isc": "permission to use copy modify and [[ or ]] distribute this software for any purpose with or without fee is "
    "hereby granted provided that the above copyright notice and this permission notice appear in all copies the software "
    "is provided as is and {{1-4}} disclaims all warranties with regard to this software including all implied warranties "
    "of merchantability and fitness in no event shall {{1-4}} be liable for any special direct indirect or consequential "
    "damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract "
    "negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the {{1-3}} be held "
    "liable for any damages arising from the use of this software permission is granted to anyone to use this software "
    "for any purpose including commercial applications and to alter it and redistribute it freely subject to the "
    "following restrictions [[ 1 ]] the origin of this software must not be misrepresented you must not claim that you "
    "wrote the original software if you use this software in a product an acknowledgment in the product documentation "
    "would be appreciated but is not required [[ 2 ]] altered source versions must be plainly marked as such and must not "
    "be misrepresented as being the original software [[ 3 ]] this notice may not be removed or altered from any source "
    "distribution",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify "
    "publish use compile sell or distribute this software either in source code form or as a compiled binary for any "
    "purpose commercial or non commercial and by any means",
    "gpl": "is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation either version {{1-2}} of the license or [[ at your "
    "option ]] any later version",
    "gpl-notice": "licensed under the gnu general public license",
    "lgpl-notice": "licensed under the gnu lesser general public license",
    "agpl-notice": "licensed under the gnu affero general public license",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was "
    "not distributed with this file you can obtain one at {{1-2}} mozilla org mpl 2 0",
    "cc-by": "licensed under a creative commons attribution {{#0-2}} [[ international ]] license",
    "cc-by-sa": "licensed under a creative commons attribution sharealike {{#0-2}} [[ international ]] license",
    "cc-by-nd": "licensed under a creative commons attribution noderivatives {{#0-2}} [[ international ]] license",
    "cc-by-nc": "licensed under a creative commons attribution noncommercial {{#0-2}} [[ international ]] license",
    "cc-by-nc-sa": "licensed under a creative commons attribution noncommercial sharealike {{#0-2}} [[ international ]] license",
    "cc-by-nc-nd": "licensed under a creative commons attribution noncommercial noderivatives {{#0-2}} [[ international ]] license",
    "cc-by-nc-notice": "licensed under [[ a ]] [[ the ]] [[ creative commons ]] cc by nc",
}
WORD = re.compile(rb"[^ ]+")


class Template:
    """One template as an automaton: numbered states, each with steps on a token, on any token or
    number, and free steps. State 0 follows the opening words, which every match must hold and which are searched."""

    def __init__(self, label: str, markup: str) -> None:
        self.label = label
        tokens = markup.split()
        opening: list[str] = []
        for t in tokens:
            if t.startswith(("[[", "{{")):
                break
            opening.append(t)
        if not opening:
            raise ValueError(f"template {label} must open with a mandatory word")
        self.opening = [t.encode() for t in opening[:6]]
        self.anchor = b" " + b" ".join(self.opening) + b" "
        self.on: list[dict[bytes, int]] = [{}]
        self.any: list[list[int]] = [[]]
        self.number: list[list[int]] = [[]]
        self.free: list[list[int]] = [[]]
        #: Mandatory words on the way to each state, the opening included.
        self.words = [len(self.opening)]
        end, rest = self._chain(0, tokens[len(self.opening) :])
        if rest:
            raise ValueError(f"template {label} closes an optional part that it never opened")
        self.accept, self.mandatory = end, self.words[end]

    def _state(self, words: int) -> int:
        self.on.append({})
        self.any.append([])
        self.number.append([])
        self.free.append([])
        self.words.append(words)
        return len(self.on) - 1

    def _chain(self, state: int, tokens: list[str]) -> tuple[int, list[str]]:
        """Append what `tokens` say until they end or close an optional part: (last state, what remains)."""
        while tokens:
            head, tokens = tokens[0], tokens[1:]
            if head == "]]":
                return state, ["]]", *tokens]
            if head == "[[":
                inner, tokens = self._chain(state, tokens)
                if tokens[:1] != ["]]"]:
                    raise ValueError(f"template {self.label} leaves an optional part open")
                tokens, after = tokens[1:], self._state(self.words[state])
                self.free[inner].append(after)
                self.free[state].append(after)
                state = after
            elif head.startswith("{{"):
                steps = self.number if "#" in head else self.any
                low, high = map(int, head.strip("{}#").split("-"))
                ends = [state] if low == 0 else []
                for k in range(1, high + 1):
                    after = self._state(self.words[state])
                    steps[state].append(after)
                    state = after
                    if k >= low:
                        ends.append(state)
                after = self._state(self.words[state])
                for e in ends:
                    self.free[e].append(after)
                state = after
            else:
                after = self._state(self.words[state] + 1)
                self.on[state][head.encode()] = after
                state = after
        return state, []

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def run(self, tokens) -> float:
        """How far the tokens after the opening words lead: 1.0 for acceptance, else the share of the
        mandatory words that were met."""
        states = self._closed({0})
        best = max(self.words[s] for s in states)
        if self.accept in states:
            return 1.0
        for token in tokens:
            after: set[int] = set()
            for s in states:
                if token in self.on[s]:
                    after.add(self.on[s][token])
                after.update(self.any[s])
                if token.isdigit():
                    after.update(self.number[s])
            if not after:
                break
            states = self._closed(after)
            best = max(best, *(self.words[s] for s in states))
            if self.accept in states:
                return 1.0
        return min(best, self.mandatory - 0.5) / self.mandatory


@functools.lru_cache(maxsize=8)
def compiled(templates: tuple[tuple[str, str], ...]) -> list[Template]:
    return [Template(label.removesuffix("-notice"), markup) for label, markup in templates]


def folded(text: str | None) -> bytes:
    """The words of a text, each between single spaces."""
    return b" " + b" ".join((text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()) + b" "


def places(words: bytes, phrase: bytes) -> Iterator[int]:
    """Where ` phrase ` starts, overlapping ones included."""
    at = words.find(phrase)
    while at >= 0:
        yield at
        at = words.find(phrase, at + 1)


def scan_text(text: str | None, phrases: dict[str, str], templates: list[Template]) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    words = folded(text)
    n_words = words.count(b" ") - 1 if len(words) > 2 else 0
    n_base, first, last, base = 0, None, None, set()
    for phrase, label in phrases.items():
        found = list(places(words, b" " + phrase.encode() + b" "))
        if found:
            n_base += len(found)
            base.add(label)
            first = found[0] if first is None else min(first, found[0])
            last = found[-1] if last is None else max(last, found[-1])
    labels, score = set(base), 1.0 if base else 0.0
    for t in templates:
        for at in places(words, t.anchor):
            got = t.run(m[0] for m in WORD.finditer(words, at + len(t.anchor) - 1))
            score = max(score, got)
            if got == 1.0:
                labels.add(t.label)
                break
    to_index = lambda at: None if at is None else words.count(b" ", 0, at)
    return n_words, n_base, to_index(first), to_index(last), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null text counts as empty: no words, no labels (empty strings), score 0. Null doc_id stays null;
    repeated rows give repeated results; other columns are not read. Empty table: empty result.
    """
    made = tuple(templates.items())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = compiled(made)
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for pdf in common.small_batches(batches):
            out = pd.DataFrame([scan_text(t, phrases, ready) for t in pdf["text"]], columns=names)
            out["first_word"], out["last_word"] = out["first_word"].astype("Int64"), out["last_word"].astype("Int64")
            out.insert(0, "doc_id", common.ids(pdf))
            yield out

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return common.id_and_text(docs).mapInPandas(run, schema)
