"""Licence scan by patience alignment: anchors are words unique to both a stretch of text and a template, their longest increasing
subsequence is kept, and the gaps between anchors are aligned in turn. Coverage is the share of the template's words that align.

A stretch is a run of the text without a gap between template words that DENSITY rules out within a finding. A window slides over it, and
only where it shares enough words with the template to reach the threshold (an exact bound) are pieces aligned: where the template's rare
words point and overlapping ones of twice its length. The best is kept and aligned again with more text around it, then the text on both
sides of it is searched, so repeated notices are found again and again.

Rules for odd input: a null or wordless text has no findings; overlapping findings of different templates are all reported; repeated rows
are scanned alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from importlib.resources import files

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tidied

LEAST, DENSITY = 0.8, 0.5
WORD = re.compile(r"[a-z0-9.]*[a-z0-9]")
#: One-line notices and usual headers; the file licence_texts/NAME.txt holds the whole published text of NAME.
NOTICES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3",
    "mit-notice": "Released under the MIT License",
    "reserved-notice": "All rights reserved",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
}
TEMPLATES = NOTICES | {f.name[:-4]: f.read_text("utf-8") for f in sorted((files(__package__) / "licence_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def split(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience piles."""
    tops, at, back = [], [], []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
        back.append(at[k - 1] if k else -1)
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned positions (in a, in b), ascending."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if w in place and in_a[w] == 1]
        anchors = [anchors[k] for k in increasing([j for _, j in anchors])]
        if not anchors:
            continue
        out += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def indexed(templates: dict[str, list[str]]) -> tuple[dict[str, Counter], dict[str, list[tuple[str, int]]]]:
    """Word counts of every template, and for every word the templates that hold it, with its count."""
    needs = {n: Counter(m) for n, m in templates.items()}
    index: dict[str, list[tuple[str, int]]] = {}
    for name, need in needs.items():
        for w, c in need.items():
            index.setdefault(w, []).append((name, c))
    return needs, index


def find(text: str | None, templates: dict[str, list[str]], least: float = LEAST, density: float = DENSITY, index=None) -> list[tuple]:
    """(template, first word, one past the last word, coverage) of each finding, by place."""
    words = split(text)
    needs, holders = index or indexed(templates)
    shared = Counter()
    for w, c in Counter(words).items():
        for name, most in holders.get(w, ()):
            shared[name] += c if c < most else most
    out = []
    for name, most in shared.items():
        model, need = templates[name], needs[name]
        if most < least * len(model):
            continue
        # a finding has at most len(model) words that do not align for every density, so a longer gap parts it
        gap = len(model) * (1 / density - 1)
        hits = [i for i, w in enumerate(words) if w in need]
        k = 0
        while k < len(hits):
            m = k
            while m + 1 < len(hits) and hits[m + 1] - hits[m] - 1 <= gap:
                m += 1
            out += _stretch(words, hits[k], hits[m] + 1, name, model, need, least, density)
            k = m + 1
    return sorted(out, key=lambda f: (f[1], f[0]))


def _window_end(words, lo, hi, need, width, goal):
    """The first place in lo..hi where a window of width words ends that shares goal words with the template, or None."""
    have, shared = Counter(), 0
    for e in range(lo, hi):
        w = words[e]
        if w in need:
            shared += have[w] < need[w]
            have[w] += 1
        if e - width >= lo:
            w = words[e - width]
            if w in need:
                have[w] -= 1
                shared -= have[w] < need[w]
        if shared >= goal:
            return e
    return None


def _trim(pairs, goal):
    """The pairs without strays at the ends: every aligned word counts 1, every other word of the text between costs a tenth."""
    best, run, first, keep = 0.0, 0.0, 0, (0, len(pairs))
    for k, (i, _) in enumerate(pairs):
        cost = (i - pairs[k - 1][0] - 1) / 10 if k else 0.0
        if run - cost <= 0:
            run, first = 0.0, k
            cost = 0.0
        run += 1 - cost
        if run > best:
            best, keep = run, (first, k + 1)
    cut = pairs[slice(*keep)]
    return cut if len(cut) >= goal else pairs


def _best(words, lo, hi, model, need, goal, density):
    """(first, one past the last, aligned words) of the best finding within lo..hi, or None: most words, then shortest, then first."""
    size, slack = len(model), max(1, len(model) // 4)
    places: dict[str, list[int]] = {}
    for j, w in enumerate(model):
        if need[w] <= 2:
            places.setdefault(w, []).append(j)
    votes = Counter(i - j for i in range(lo, hi) for j in places.get(words[i], ()))
    near = Counter()
    for d, c in votes.items():
        near[d // slack] += c
    # where most rare words of the template point, and overlapping pieces of twice its length
    starts = sorted({d for d, _ in votes.most_common(3)} | {max((c, -d) for d, c in votes.items() if d // slack == g)[1] * -1 for g, _ in near.most_common(3)})
    spans = [(d, d + size) for d in starts] + [(d - slack, d + size + slack) for d in starts]
    spans += [(p, p + 2 * size) for p in range(lo, max(lo + 1, hi - size // 2), max(1, size // 2))]
    best, tried = None, set()

    def look(a, b):
        nonlocal best
        a, b = max(lo, a), min(hi, b)
        if b - a < goal or (a, b) in tried:
            return
        tried.add((a, b))
        pairs = align(words[a:b], model)
        if len(pairs) < goal:
            return
        for p in (_trim(pairs, goal), pairs):
            i, k = a + p[0][0], a + p[-1][0] + 1
            if len(p) >= density * (k - i):
                if best is None or (-len(p), k - i, i) < (-best[2], best[1] - best[0], best[0]):
                    best = (i, k, len(p))
                break

    for a, b in spans:
        look(a, b)
    while best and best[2] < size:  # align again around what was found, until that finds no more
        was = best
        for more in (slack, size):
            look(best[0] - more, best[1] + more)
        if best == was:
            break
    return best


def _stretch(words, lo, hi, name, model, need, least, density):
    """Findings within one stretch; what lies left and right of a finding is searched again."""
    goal, width = least * len(model), int(len(model) / density)
    todo = [(lo, hi)]
    while todo:
        lo, hi = todo.pop()
        e = _window_end(words, lo, hi, need, width, goal)
        if e is None:
            continue
        # no finding ends before e, and those that begin before e + 1 end within width of it
        left, right = max(lo, e + 1 - width), min(hi, e + 1 + width)
        got = _best(words, left, right, model, need, goal, density)
        if got is None:
            todo.append((e + 1, hi))
            continue
        a, b, n = got
        yield name, a, b, n / len(model)
        todo += [(left, a), (b, hi)]


def _scan(batches, templates):
    import pyarrow as pa

    kind = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]))
    index = indexed(templates)
    for b in batches:
        rows = [[dict(zip(("licence", "start", "end", "coverage"), f, strict=True)) for f in find(t.as_py(), templates, index=index)] for t in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, kind)], ["doc_id", "found"])


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id and its findings: array of (licence, start, end, coverage), places in words. No shuffle."""
    models = {n: split(t) for n, t in (templates or TEMPLATES).items()}
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidied(_scan, templates=models), "doc_id long, found array<struct<licence:string,start:long,end:long,coverage:double>>")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda f: f["licence"]))), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_found"), names.alias("licences"), F.coalesce(F.array_max(F.transform("found", lambda f: f["coverage"])), F.lit(0.0)).alias("best_coverage"))
