"""License notices in text by patience alignment with templates."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quorumfit.llm.words import slices

# The texts of well-known license notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
        "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
        "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE "
        "USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
        "more details. You should have received a copy of the GNU General Public License along with "
        "this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution. Neither the name of the copyright holder nor the names of "
        "its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-ND-4.0": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    ),
    "CC-BY-NC-SA-4.0": (
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-ND-4.0": (
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under the GNU General Public License, version 2.",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "2 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
        "more details. You should have received a copy of the GNU General Public License along with "
        "this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "LGPL-2.0": (
        "This work is licensed under the GNU Library General Public License, version 2.",
        "Licensed under the GNU Library General Public License, version 2.",
        "This library is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Library General Public License as published by the Free Software Foundation, either version "
        "2 of the License, or (at your option) any later version. This library is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Library General Public License for "
        "more details. You should have received a copy of the GNU Library General Public License along with "
        "this library. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation, either version "
        "2.1 of the License, or (at your option) any later version. This library is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for "
        "more details. You should have received a copy of the GNU Lesser General Public License along with "
        "this library. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version. This library is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for "
        "more details. You should have received a copy of the GNU Lesser General Public License along with "
        "this library. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Affero General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version. This program is distributed in the "
        "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
        "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for "
        "more details. You should have received a copy of the GNU Affero General Public License along with "
        "this program. If not, see <https://www.gnu.org/licenses/>.",
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution.",
    ),
    "BSD-4-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution. All advertising materials mentioning features or use of this "
        "software must display the following acknowledgement: This product includes software developed "
        "by the copyright holder. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission.",
    ),
    "Apache-1.1": ("Licensed under the Apache License, Version 1.1.",),
    "CC0-1.0": (
        "Licensed under CC0 1.0.",
        "This work is licensed under a Creative Commons CC0 1.0 Universal License.",
        "To the extent possible under law, the author has waived all copyright and related or "
        "neighboring rights to this work.",
        "To the extent possible under law, the author(s) have dedicated all copyright and related and "
        "neighboring rights to this software to the public domain worldwide. This software is "
        "distributed without any warranty.",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to "
        "copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
#: Words that tell sister licenses apart: those of a template must match, and the words of a
#: notice may not have more of them. Versions must match, too.
VARIANTS = (
    ("CC-", frozenset(
        "by by-sa by-nc by-nd by-nc-sa by-nc-nd cc0 attribution attribution-sharealike "
        "attribution-noncommercial attribution-noderivatives attribution-noncommercial-sharealike "
        "attribution-noncommercial-noderivatives sharealike noncommercial noderivatives noderivs "
        "share-alike non-commercial no-derivatives".split()
    )),
    ("GPL", frozenset("lesser library affero".split())),
    ("BSD", frozenset("advertising endorse".split())),
)
#: Names of licenses, which must match as well.
NAMES = frozenset("apache gnu mit mozilla creative commons cc".split())
#: Longest way, in words, from the end of a notice to a word that makes it a sister's.
AFTER = 60
# End of fixed values.

WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")


VERSION = re.compile(r"v?([0-9]+(?:\.[0-9]+)*?)(?:\.0)*")


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Words of a text in lower case, versions without "v" and final zeros, and their places."""
    out = []
    for m in WORD.finditer(text):
        word = m[0].lower()
        version = VERSION.fullmatch(word)
        out.append((version[1] if version else word, *m.span()))
    return out


def _variants(name: str) -> frozenset[str]:
    return next((words for part, words in VARIANTS if part in name), frozenset())


def marked(name: str, words: list[str]) -> list[int]:
    """Places of the words of a template that must match: first of each version, name and variant."""
    family = _variants(name)
    first: dict[str, int] = {}
    for k, word in enumerate(words):
        sister = word in family and ("GPL" not in name or words[k + 1 : k + 2] == ["general"])
        if sister or word in NAMES or VERSION.fullmatch(word):
            first.setdefault(word, k)
    return sorted(first.values())


def refused(name: str, wanted: list[str], must: list[int], words: list[str], pairs: list) -> bool:
    """Whether an alignment misses a marked word, or the notice has a sister's word.

    A marked word may be anywhere between the words matched around it.
    """
    at = {j: i for i, j in pairs}
    for j in must:
        if j not in at:
            low = max((i for i, k in pairs if k < j), default=pairs[0][0])
            high = min((i for i, k in pairs if k > j), default=pairs[-1][0])
            if wanted[j] not in words[low + 1 : high]:
                return True
    family = _variants(name) - {wanted[j] for j in must}
    last = pairs[-1][0] + 1
    # A clause of a sister may follow; a new notice ends the search.
    if name.startswith("BSD"):
        for k in range(last, min(last + AFTER, len(words))):
            if words[k] == "redistribution" or words[k : k + 2] == ["permission", "is"]:
                break
            last = k + 1
    for k in range(pairs[0][0], last):
        word = words[k]
        if word in family and word not in ("by", "attribution"):
            if "GPL" not in name or words[k + 1 : k + 2] == ["general"]:
                return True
    return False


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by the first place, that rises in the second."""
    tops: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        k = bisect.bisect_left(tops, j)
        before.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(j)
            at.append(n)
        else:
            tops[k], at[k] = j, n
    out, n = [], at[-1] if at else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Matched places of two word lists.

    Equal words at both ends match; between them, words that occur once in either list are
    anchors, their longest rising run is kept, and the gaps are aligned in the same way.
    A gap without anchors matches nothing. The gaps wait on a list, so depth is no limit.
    """
    out: list[tuple[int, int]] = []
    waiting = [(0, len(a), 0, len(b))]
    while waiting:
        a0, a1, b0, b1 = waiting.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        places: dict[str, list] = {}
        for i in range(a0, a1):
            places.setdefault(a[i], [[], []])[0].append(i)
        for j in range(b0, b1):
            if a_b := places.get(b[j]):
                a_b[1].append(j)
        anchors = _rising(sorted((p[0], q[0]) for p, q in places.values() if len(p) == len(q) == 1))
        if not anchors:
            continue
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        out += anchors
        waiting += [
            (i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges[:-1], edges[1:])
        ]
    return sorted(out)


def _seeds(templates: list[tuple[str, list[str], list[int]]]) -> dict[tuple[str, ...], list[tuple[int, int]]]:
    """Where each run of three words is in the templates."""
    out: dict = {}
    for t, (_, words, _) in enumerate(templates):
        for k in range(len(words) - 2):
            out.setdefault(tuple(words[k : k + 3]), []).append((t, k))
    return out


#: A start that this share of a template's runs agree on is tried by itself.
AGREED = 0.35


def _windows(starts: list[int], length: int, end: int) -> Iterator[tuple[int, int]]:
    """Stretches of words in which a notice may be, from the starts that its runs tell.

    Starts near one another make one stretch with slack on either side. A start that many
    runs agree on makes stretches of its own, as long as the template and with the slack
    cut where other such notices lie: next to another notice the words in the slack occur
    twice, and no word that does can be an anchor.
    """
    slack = max(3, length // 4)
    votes: dict[int, int] = {}
    for at in starts:
        votes[at] = votes.get(at, 0) + 1
    seen = sorted(votes)
    first = 0
    for k in range(1, len(seen) + 1):
        if k == len(seen) or seen[k] - seen[k - 1] > slack:
            yield max(0, seen[first] - slack), min(end, seen[k - 1] + length + slack)
            first = k
    agreed = [at for at in seen if votes[at] >= AGREED * (length - 2)]
    for k, at in enumerate(agreed):
        before = agreed[k - 1] + length if k else 0
        after = agreed[k + 1] if k + 1 < len(agreed) else end
        yield max(0, at), min(end, at + length)
        low, high = max(0, at - slack, min(before, at)), min(end, at + length + slack, max(after, at + length))
        yield low, high


def find_in(text: str, templates, seeds, coverage: float) -> list[tuple]:
    """(license, start, end, coverage) of the notices of a text, in order and apart.

    ``templates`` are (name, words, places of marked words).
    """
    found = tokens(text)
    words = [w for w, _, _ in found]
    starts: dict[int, list[int]] = {}
    for i, run in enumerate(zip(words, words[1:], words[2:])):
        for t, k in seeds.get(run, ()):
            starts.setdefault(t, []).append(i - k)
    hits = []
    for t, where in starts.items():
        name, wanted, must = templates[t]
        for low, high in dict.fromkeys(_windows(where, len(wanted), len(words))):
            pairs = patience(words[low:high], wanted)
            share = len(pairs) / len(wanted)
            whole = [(low + i, j) for i, j in pairs]
            if share >= coverage and not refused(name, wanted, must, words, whole):
                first, last = whole[0][0], whole[-1][0]
                hits.append((-len(pairs) * share, last - first, name, found[first][1], found[last][2], share))
    chosen: list[tuple] = []
    for _, _, name, start, end, share in sorted(hits):
        if all(end <= a or start >= b for _, a, b, _ in chosen):
            chosen.append((name, start, end, share))
    return sorted(chosen, key=lambda h: (h[1], h[0]))


def scan_licenses(docs: DataFrame, coverage: float = 0.85,
                  templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """License notices of every row: doc_id, n_licenses, licenses, best_coverage, spans.

    Three-word runs shared with a template say where a notice may be; there the words of
    the text are aligned with the template's, and a notice is found where at least
    ``coverage`` of the template's words match, all versions and words that tell sister
    licenses apart among them. Notices may follow one another without a gap. Overlapping finds
    leave the one with the most matched words, of equal ones the shortest, then the first by name.
    ``licenses`` are the distinct names, sorted and comma-joined; ``spans`` are
    name:start:end in code points, end exclusive. Whole texts, however long, are read in one
    pass without a shuffle. Null text has no words; repeated rows and null doc_ids stay
    rows; other columns are ignored, whatever their names. An empty table gives an empty
    table.
    """
    split = [(n, [w for w, _, _ in tokens(t)]) for n, ts in (templates or TEMPLATES).items() for t in ts]
    texts = [(n, words, marked(n, words)) for n, words in split]
    seeds = _seeds(texts)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, "text")):
            rows = [
                find_in(t or "", texts, seeds, coverage)
                for t in batch.column("text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(r) for r in rows], pa.int64()),
                    pa.array([",".join(sorted({h[0] for h in r})) for r in rows]),
                    pa.array([max((h[3] for h in r), default=0.0) for r in rows]),
                    pa.array([",".join(f"{n}:{a}:{b}" for n, a, b, _ in r) for r in rows]),
                ],
                ["doc_id", "n_licenses", "licenses", "best_coverage", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_licenses long, licenses string, best_coverage double, spans string"
    )
