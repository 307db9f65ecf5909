"""Licence scan: normalised text against licence templates by the Dice coefficient of word bigrams.

Units are a text's lines, the sentences of its lines, its paragraphs (between blank lines) and the whole text.
With a and b bigrams, Dice cannot reach t unless a lies within b * t / (2 - t) and b * (2 - t) / t, so a unit is
only compared with templates inside those bounds, and units outside all of them are dropped first. Templates
are short notices, standard headers, whole licence texts and the paragraphs of these that stand for themselves;
a paragraph that several licences share has the name of their family. They are a literal of fixed size;
a text, and then a unit, without any word that a match must have (see anchors()) is compared with none;
everything happens inside each row. A notice may stand inside a longer sentence: every text with such a word is
also read by windows as long as a template, which begin where one of the template's bigrams stands. Only templates of
which the text has enough bigrams for the threshold, wherever they are, get windows. Of a template the
best window counts (of equals the first), unless it overlaps a better one of another template, or a unit that matches
has half of its bigrams: then it is that unit's notice read again.

Result: doc_id, n_units (different units that match a template, and windows that tell of more), license (that of the
highest Dice, of equals the one with the longer template, then by name; null without one) and dice. Cases: null and empty texts match
nothing; repeated rows each give a row; other columns are left out, whatever their names. A very long text is read whole: its
windows cost as many steps as it has bigrams of templates, times their length.
"""

from __future__ import annotations

import os.path
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.llm.common import long_id, table
from postmill.llm.rules import STOP_WORDS

THRESHOLD = 0.75
#: Public notices, headers and texts of common licences; a blank line parts paragraphs.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "This software is released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "This software is released under the BSD 3-Clause License."),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
WARRANTY_GPL = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
COPY_GPL3 = "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
COPY_GPL2 = "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
BSD_FIRST = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_LAST = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEXTS = [
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("BSD-2-Clause", f"{BSD_FIRST}\n\n{BSD_SOURCE}\n\n{BSD_BINARY}\n\n{BSD_LAST}"),
    ("BSD-3-Clause", f"{BSD_FIRST}\n\n{BSD_SOURCE}\n\n{BSD_BINARY}\n\n{BSD_NAMES}\n\n{BSD_LAST}"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"),
    ("GPL-2.0", f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\n{WARRANTY_GPL}\n\n{COPY_GPL2}"),
    ("GPL-3.0", f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\n{WARRANTY_GPL}\n\n{COPY_GPL3}"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\nThe origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\nAltered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\nThis notice may not be removed or altered from any source distribution."),
]


def all_templates() -> list[tuple[str, str]]:
    """Notices, whole texts and their paragraphs; one that several licences share is their family's."""
    owners: dict[str, set[str]] = {}
    for name, text in TEXTS:
        for part in {text, *text.split("\n\n")}:
            owners.setdefault(part, set()).add(name)
    shared = {part: os.path.commonprefix(sorted(names)).rstrip("-") if len(names) > 1 else min(names) for part, names in owners.items()}
    return list(dict.fromkeys([*NOTICES, *sorted((name, part) for part, name in shared.items())]))


def words_of(text: str) -> list[str]:
    """The words of a text, as the query normalises it."""
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip().split()


def bigrams(text: str) -> list[str]:
    """Distinct word bigrams of a text."""
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


TEMPLATES = all_templates()


def anchors(known: list[tuple[str, list[str]]], low: float) -> list[str]:
    """Words of which every unit that matches a template has one.

    A match shares at least low * b of the template's b bigrams, so it misses at most the others; of each
    template the longest words are taken, stop words last, until more bigrams than those hold one of them.
    """
    out: set[str] = set()
    for _, grams in known:
        held: set[str] = set()
        for word in sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (w in STOP_WORDS, -len(w), w)):
            if len(held) > (1 - low) * len(grams):
                break
            out.add(word)
            held |= {g for g in grams if word in g.split(" ")}
    return sorted(out)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_units, license, dice of every document."""
    known = [(name, bigrams(text)) for name, text in templates]
    long = [len(words_of(text)) - 1 for _, text in templates]
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    least, most = min(len(b) for _, b in known) * low, max(len(b) for _, b in known) * high
    literal = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(len(b)).alias("n"), F.split(F.lit(",".join(b)), ",").alias("b"), F.lit(m).alias("m")) for (name, b), m in zip(known, long, strict=True)))
    rows = docs.select(long_id(), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    telling = anchors(known, low)
    normal = lambda u: F.regexp_replace(F.lower(u), "[^a-z0-9]+", " ")
    anchored = lambda w: F.exists(w, lambda x: x.isin(telling))
    sentences = F.split(F.regexp_replace("t", r"([.!?])[\x20\t]+", "$1\n"), "\n")
    raw = F.concat(F.split("t", "\n"), sentences, F.filter(F.split("t", r"\n[\x20\t]*\n"), lambda p: F.contains(p, F.lit("\n"))), F.array("t"))
    plain = F.array_distinct(F.transform(F.array_distinct(raw), lambda u: F.trim(normal(u))))
    # n words have n - 1 bigrams at most, so too few words are dropped unseen; too many bigrams only once they are counted
    units = F.filter(F.transform(plain, lambda u: F.split(u, " ")), lambda w: (F.size(w) > least) & anchored(w))
    rows = rows.select("doc_id", "t", F.when(anchored(F.split(normal(F.col("t")), " ")), units).otherwise(F.array().cast("array<array<string>>")).alias("units"))
    pairs = lambda w: F.filter(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b)), lambda x: x.isNotNull())
    rows = rows.select("doc_id", "t", (F.size("units") > 0).alias("anchored"), F.transform("units", lambda w: F.array_distinct(pairs(w))).alias("grams"))
    rows = rows.select("doc_id", "t", "anchored", F.filter("grams", lambda g: F.size(g).between(least, most)).alias("grams"))

    def likeness(g, t):
        return F.struct((-2.0 * F.size(F.array_intersect(g, t["b"])) / (F.size(g) + t["n"])).alias("d"), (-t["n"]).alias("n"), t["name"].alias("name"))

    def compare(g):
        fits = F.filter(literal, lambda t: F.size(g).between(t["n"] * low, t["n"] * high))
        return F.array_min(F.filter(F.transform(fits, lambda t: likeness(g, t)), lambda x: x["d"] <= -threshold))

    def window(t, i):
        own = likeness(F.array_distinct(F.slice("all", i, t["m"])), t)
        return F.struct(own["d"].alias("d"), own["n"].alias("n"), own["name"].alias("name"), i.alias("at"), t["m"].alias("m"))

    def best_window(t):
        begins = F.filter(F.transform("all", lambda x, i: F.when(F.array_contains(t["b"], x), i + 1)), lambda i: i.isNotNull())
        return F.array_min(F.transform(begins, lambda i: window(t, i)))

    judged = F.filter(F.transform("grams", lambda g: F.struct(compare(g).alias("best"), g.alias("g"))), lambda u: u["best"].isNotNull())
    rows = rows.select("doc_id", "t", "anchored", judged.alias("units"))
    # a window that matches shares as many bigrams with its template as a unit must have at least
    rows = rows.withColumn("all", F.when(F.col("anchored"), pairs(F.split(F.trim(normal(F.col("t"))), " "))).otherwise(F.array().cast("array<string>")))
    telling = sorted({g for _, b in known for g in b})
    rows = rows.withColumn("some", F.array_distinct(F.filter("all", lambda x: x.isin(telling))))
    held = F.when(F.size("some") >= least, F.filter(literal, lambda t: F.size(F.array_intersect("some", t["b"])) >= t["n"] * low)).otherwise(F.filter(literal, lambda t: F.lit(False)))
    rows = rows.withColumn("windows", F.filter(F.transform(held, best_window), lambda x: x["d"] <= -threshold))

    def overtaken(w):
        return F.exists("windows", lambda v: (v < w) & (v["at"] < w["at"] + w["m"]) & (w["at"] < v["at"] + v["m"]))

    def explained(w):
        own = F.array_distinct(F.slice("all", w["at"], w["m"]))
        return F.exists("units", lambda u: 2 * F.size(F.array_intersect(own, u["g"])) >= F.size(own))

    more = F.filter("windows", lambda w: ~overtaken(w) & ~explained(w))
    found = F.concat(F.transform("units", lambda u: u["best"]), F.transform(more, lambda w: F.struct(w["d"].alias("d"), w["n"].alias("n"), w["name"].alias("name"))))
    rows = rows.select("doc_id", found.alias("found"))
    best = F.array_min("found")
    return rows.select("doc_id", F.size("found").cast("long").alias("n_units"), best["name"].alias("license"), F.round(-best["d"], 6).alias("dice"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def oracle() -> str:
    known = [(n, bigrams(t), len(words_of(t)) - 1) for n, t in TEMPLATES]
    values = ", ".join("('{}', {}, [{}], {})".format(name, len(b), ", ".join(f"'{x}'" for x in b), m) for name, b, m in known)
    least, most = min(len(b) for _, b, _ in known), max(len(b) for _, b, _ in known)
    return f"""
with tpl(name, n, b, m) as (values {values}),
d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
u as (
  select distinct r, trim(regexp_replace(lower(u), '[^a-z0-9]+', ' ', 'g')) as u from (
    select r, unnest(list_concat(string_split(t, chr(10)), string_split(regexp_replace(t, '([.!?])[\\x20\\t]+', '\\1' || chr(10), 'g'), chr(10)), string_split_regex(t, '\\n[\\x20\\t]*\\n'), [t])) as u from d)),
w as (select r, string_split(u, ' ') as w from u where len(string_split(u, ' ')) > {least} * {THRESHOLD} / (2 - {THRESHOLD})),
g as (select r, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from w),
f as (
  select g.r, g.g, tpl.name, tpl.n, 2.0 * len(list_intersect(g.g, tpl.b)) / (len(g.g) + tpl.n) as dice
  from g, tpl where len(g.g) between tpl.n * {THRESHOLD} / (2 - {THRESHOLD}) and tpl.n * (2 - {THRESHOLD}) / {THRESHOLD} and len(g.g) <= {most} * 4),
m as (select r, g, name, n, dice from f where dice >= {THRESHOLD}),
s as (select r, string_split(trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')), ' ') as w from d),
a as (select r, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as a from s),
e as (select e.r, e.i, k.name, k.n, k.b, k.m from (select r, unnest(a) as x, unnest(range(1, len(a) + 1)) as i from a) e join (select name, n, b, m, unnest(b) as x from tpl) k using (x)),
o as (select e.r, e.i, name, n, b, e.m, list_distinct(a[i : i + m - 1]) as g from e join a using (r)),
i as (select r, i, name, n, b, m, g, 2.0 * len(list_intersect(g, b)) / (len(g) + n) as dice from o),
v as (select * from (select *, row_number() over (partition by r, name, b order by dice desc, i) as z from i where dice >= {THRESHOLD}) where z = 1),
x as (
  select r, g, name, n, dice, 'unit' as k from m
  union all select r, g, name, n, dice, 'window ' || i || ' ' || m from v
  where not exists (select 1 from v y where y.r = v.r and row(-y.dice, -y.n, y.name, y.i, y.m) < row(-v.dice, -v.n, v.name, v.i, v.m) and y.i < v.i + v.m and v.i < y.i + y.m)
    and not exists (select 1 from m where m.r = v.r and 2 * len(list_intersect(v.g, m.g)) >= len(v.g))),
b as (select r, count(distinct {{'g': g, 'k': k}}) as n_units, arg_min(name, (-dice, -n, name)) as license, max(dice) as dice from x group by r)
select doc_id, coalesce(n_units, 0) as n_units, license, round(dice, 6) as dice from d left join b using (r)
"""
