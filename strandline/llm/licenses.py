"""License scans: template markup compiled to token automata.

A template is wording in words, with four kinds of markup: ``[[...]]`` may be left out,
``((a|b|...))`` stands for one of its parts, ``{{*}}`` for any words, as many as there are up to
the next mandatory one (names of holders, addresses), ``{{n}}`` for up to n words of any kind and
``{{n~pattern}}`` for one to n words that match the pattern.  All nest but the last three.  It
compiles to an automaton over words; a text is accepted where the automaton runs through, that
is, where all mandatory words stand exactly.  Every text is read whole and once: an automaton
takes up a new start wherever one of the words stands with which its template may begin, and
starts that meet in a state go on as one, so the work is in proportion to the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, durable, keyed, small_batches, word_list

#: Phrases of the base scan and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Wording of public licenses and their notices, by label.  Those with SPDX's own names, and mit-text, have the whole mandatory wording;
#: ``-header`` is what a license says to put on a file, ``-grant`` its grant alone, ``-notice`` a common short reference.
TEMPLATES = {
    "mit-notice": "released under the [[terms of the]] mit license",
    "apache-2.0-notice": "licensed under the apache license version 2 0",
    "gpl-notice": "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation [[either]]]] version {{1}} [[or at your option any later version]]",
    "cc-by-nc-4.0": "((licensed under [[((a|the))]]|under a)) ((cc by nc 4 0|creative commons attribution non commercial 4 0 [[international]] [[public]] license|creative commons attribution noncommercial 4 0 [[international]] [[public]] license|creative commons {{*}} cc by nc 4 0))",
    "cc-by-sa-4.0": "((licensed under [[((a|the))]]|under a)) ((cc by sa 4 0|creative commons attribution ((sharealike|share alike)) 4 0 [[international]] [[public]] license|creative commons {{*}} cc by sa 4 0))",
    "cc-by-4.0": "((licensed under [[((a|the))]]|under a)) ((cc by 4 0|creative commons attribution 4 0 [[international]] [[public]] license|creative commons {{*}} cc by 4 0))",
    "cc0-1.0": "((cc0 1 0 universal|dedicated to the public domain under the creative commons zero|to the extent possible under law {{*}} ((has|have)) waived all copyright and related or neighboring rights))",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall {{*}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "mit-grant": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so"
    ),
    "isc": (
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and {{*}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall {{*}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ),
    "isc-grant": "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted",
    "bsd-2-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "[[((1|a))]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "[[((2|b))]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by {{*}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall {{*}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage"
    ),
    "bsd-3-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "[[((1|a))]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "[[((2|b))]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "[[((3|c))]] neither the name of {{*}} nor the names of {{*}} contributors may be used to endorse or promote products derived from this software without specific prior written permission "
        "this software is provided by {{*}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall {{*}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage"
    ),
    "bsd-grant": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "[[((1|a))]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    ),
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "{{*}} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
    ),
    "gpl-header": (
        "free software [[you can]] redistribute it and or modify it under the terms of the gnu general public license "
        "((as published by the free software foundation ((either version {{1~[23]}}|version {{1~[23]}})) [[of the license]] [[or at your option any later version]]|version {{1~[23]}} [[only]] as published by the free software foundation))"
    ),
    "lgpl-header": (
        "free software [[you can]] redistribute it and or modify it under the terms of the gnu ((lesser|library)) general public license "
        "as published by the free software foundation [[either]] version {{1~[23]}} [[{{1~[01]}}]] [[of the license]] [[or at your option any later version]]"
    ),
    "agpl-header": (
        "free software [[you can]] redistribute it and or modify it under the terms of the gnu affero general public license "
        "as published by the free software foundation [[either]] version 3 [[of the license]] [[or at your option any later version]]"
    ),
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[((http|https))]] [[www]] mozilla org mpl 2 0",
    "epl-2.0": "((this program and the accompanying materials|all rights reserved this program and the accompanying materials)) are made available under the terms of the eclipse public license [[v]] 2 0",
    "bsl-1.0": "((distributed under the boost software license version 1 0|permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license))",
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will {{*}} be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "[[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product "
        "an ((acknowledgment|acknowledgement)) in the product documentation would be appreciated but is not required "
        "[[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "[[3]] this notice may not be removed or altered from any source distribution"
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain "
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means "
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain "
        "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors "
        "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software"
    ),
    "unlicense-notice": "this is free and unencumbered software released into the public domain",
    "wtfpl": (
        "do what the fuck you want to public license {{*}} everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed "
        "[[do what the fuck you want to public license]] terms and conditions for copying distribution and modification [[0]] you just do what the fuck you want to"
    ),
    "wtfpl-notice": "do what the fuck you want to public license",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache-2.0": "spdx license identifier apache 2 0",
    "spdx-gpl": "spdx license identifier gpl {{1~[23]}} 0 [[((only|or later))]]",
    "spdx-lgpl": "spdx license identifier lgpl {{1~[23]}} {{1~[01]}} [[((only|or later))]]",
    "spdx-agpl": "spdx license identifier agpl 3 0 [[((only|or later))]]",
    "spdx-bsd": "spdx license identifier ((0bsd|bsd {{1~[234]}} clause))",
    "spdx-mpl-2.0": "spdx license identifier mpl 2 0",
    "spdx-other": "spdx license identifier ((isc|zlib|unlicense|cc0 1 0|epl 2 0|bsl 1 0|cc by [[((nc|sa|nd))]] {{1~[34]}} 0))",
}

SPLIT, WORD, LIKE, ANY, END = "split", "word", "like", "any", "end"
_MARKUP = re.compile(r"\[\[|\]\]|\(\(|\)\)|\||\{\{(?:\*|\d+(?:~[^{}]+)?)\}\}|[^\s\[\]{}()|]+")


def compile_template(markup: str) -> list[tuple]:
    """The automaton: (word, w) reads w, (like, pattern) a word that matches, (any,) any word, (split, places) goes on at any of the places, (end,)."""
    program: list = []
    opened: list[tuple[str, int, list[int], list[int]]] = []  # kind, where the split stands, starts of alternatives, jumps to the end
    for part in _MARKUP.findall(markup):
        if part in ("[[", "(("):
            opened.append((part, len(program), [len(program) + 1], []))
            program.append(None)
        elif part == "|":
            if not opened or opened[-1][0] != "((":
                raise ValueError("a bar stands outside of alternatives")
            opened[-1][3].append(len(program))
            program.append(None)
            opened[-1][2].append(len(program))
        elif part in ("]]", "))"):
            if not opened or (part == "]]") != (opened[-1][0] == "[["):
                raise ValueError("a region is closed that is not open")
            _, at, starts, jumps = opened.pop()
            if part == "]]":
                starts.append(len(program))
            program[at] = (SPLIT, tuple(starts))
            for jump in jumps:
                program[jump] = (SPLIT, (len(program),))
        elif part == "{{*}}":
            at = len(program)
            program += [(SPLIT, (at + 1, at + 3)), (ANY,), (SPLIT, (at,))]
        elif part.startswith("{{"):
            n, _, pattern = part[2:-2].partition("~")
            n, op = int(n), (LIKE, re.compile(pattern.encode())) if pattern else (ANY,)
            end = len(program) + 2 * n - bool(pattern)
            for k in range(n):
                if k or not pattern:  # of words with a pattern one must stand
                    program.append((SPLIT, (len(program) + 1, end)))
                program.append(op)
        else:
            program.append((WORD, part.lower().encode()))
    if opened:
        raise ValueError("a region is not closed")
    return [*program, (END,)]


def _reach(program: list[tuple], states: dict[int, int]) -> dict[int, int]:
    """The states from which a word is read or the end is reached, with the most words read on a way there."""
    todo, out = list(states.items()), {}
    while todo:
        at, read = todo.pop()
        if out.get(at, -1) >= read:
            continue
        out[at] = read
        if program[at][0] == SPLIT:
            todo += [(to, read) for to in program[at][1]]
    return out


def openings(program: list[tuple]) -> set[bytes]:
    """The words with which an accepted text may begin; an error where it may begin with any."""
    ops = [program[at] for at in _reach(program, {0: 0})]
    if any(op[0] in (ANY, LIKE, END) for op in ops):
        raise ValueError("a template must begin with a word")
    return {op[1] for op in ops if op[0] == WORD}


def mandatory(markup: str) -> int:
    """The fewest words of its own that an accepted text has."""
    program = compile_template(markup)
    best = {0: 0}
    for at in range(len(program)):  # all ways lead onwards but those of {{*}}, which lead back at no word
        if at in best:
            op, n = program[at], best[at]
            for to in op[1] if op[0] == SPLIT else (at + 1,):
                best[to] = min(best.get(to, 1 << 30), n + (op[0] == WORD))
    return best[len(program) - 1]


def stepped(program: list[tuple], states: dict[int, int], word: bytes) -> dict[int, int]:
    """The states after a word, each with the most of the template's own words read on a way there."""
    ahead: dict[int, int] = {}
    for at, read in states.items():
        op = program[at]
        if op[0] == ANY or op[0] == WORD and op[1] == word or op[0] == LIKE and op[1].fullmatch(word):
            ahead[at + 1] = max(ahead.get(at + 1, 0), read + (op[0] == WORD))
    return _reach(program, ahead)


def run(program: list[tuple], words: list[bytes], start: int) -> tuple[bool, int]:
    """Whether the automaton runs through from start, and how many of its words it read at most on one way."""
    states, most = _reach(program, {0: 0}), 0
    for word in [*words[start:], b""]:
        most = max(most, *states.values())
        if len(program) - 1 in states:
            return True, most
        states = stepped(program, states, word)
        if not states:
            break
    return False, most


def accepted(words: list[bytes], automata: dict[bytes, list[tuple[str, list[tuple], int]]]) -> tuple[set[str], float]:
    """Labels of the automata that run through from anywhere, and the largest share of mandatory words read; every word is read once."""
    done: set[str] = set()
    live: dict[str, tuple[list[tuple], int, dict[int, int]]] = {}
    score = 0.0
    for word in words:
        opened = automata.get(word, ())
        if not live and not opened:
            continue
        now = dict(live)
        for label, program, need in opened:
            if label not in done:
                _, _, states = now.get(label, (program, need, {}))
                now[label] = program, need, {**_reach(program, {0: 0}), **states}
        live = {}
        for label, (program, need, states) in now.items():
            states = stepped(program, states, word)
            if not states:
                continue
            if len(program) - 1 in states:
                done.add(label)
                continue
            live[label] = program, need, states
            if (read := max(states.values())) > 1:
                score = max(score, min(read / need, 0.99))
    return done, 1.0 if done else score


def places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase starts in `` w0 w1 ... ``."""
    found, at, upto, seen = [], joined.find(phrase), 0, 0
    while at >= 0:
        seen += joined.count(b" ", upto, at)
        upto = at
        found.append(seen)
        at = joined.find(phrase, at + 1)
    return found


def compiled(templates: dict[str, str]) -> dict[bytes, list[tuple[str, list[tuple], int]]]:
    """Opening word -> label, automaton and mandatory words of the templates that may begin with it."""
    out: dict[bytes, list[tuple[str, list[tuple], int]]] = {}
    for label, markup in templates.items():
        program = compile_template(markup)
        for word in openings(program):
            out.setdefault(word, []).append((label, program, mandatory(markup)))
    return out


def scan_text(text: str | None, automata: dict[bytes, list[tuple[str, list[tuple], int]]]) -> tuple:
    """One text's columns of scan()."""
    words = word_list(text)
    joined = b" " + b" ".join(words) + b" "
    starts, base = [], set()
    for phrase, label in PHRASES.items():
        if got := places(joined, b" " + phrase.encode() + b" "):
            starts += got
            base.add(label)
    more, score = accepted(words, automata)
    score = max(score, 0.5) if base else score
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score


SCHEMA = "_k1 long, _k2 long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Row key, doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    Score: 1 where a template is accepted; else the largest share of a template's mandatory
    words read in order from its opening (two at least), and at least 0.5 where a base phrase
    stands; else 0.  Null and empty texts have no words and no labels; a text of any length is read
    whole; equal rows get equal results; other columns are not looked at; an empty table gives no
    rows.
    """
    automata = compiled(templates or TEMPLATES)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(i) for i in range(3)]
            cols = list(zip(*(scan_text(t.as_py(), automata) for t in batch.column(3)), strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([*ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    rows = keyed(docs, id_col=id_col, text_col=text_col).select(*KEY, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        return durable(rows.mapInArrow(each, SCHEMA), "licenses")
