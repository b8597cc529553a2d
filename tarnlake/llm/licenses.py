"""Licence scans with a positional index of rare words; DataFrame functions only.

Templates are the words of notices and licence texts, with mandatory key phrases. Of each template the
words of the highest IDF over all templates, up to ``rarest`` of them, are indexed by their positions.
A file in which no key phrase stands costs two passes of a regular expression. The words of the others
are looked up in the index, all of them; their postings are intersected by the distance between the
place in the file and the place in the template. Templates with enough words at one distance, and all
key phrases in the file, give their labels: however many licences a file holds, none hides another.

Base phrases are postings like any other: they stand where all their words meet at one distance.
Looking up is a join with the broadcast index, whose size the templates bound; what is shuffled are
counts by file, template and distance.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Base phrases and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, key phrases that must stand in the text, words of the notice or licence.
TEMPLATES = (
    ("mit", ("mit license",), "released under the MIT License"),
    ("mit", ("permission is hereby granted free of charge",), "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", ("the above copyright notice and this permission notice shall be included",), "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."),
    ("apache", ("apache license",), "Licensed under the Apache License, Version 2.0"),
    ("apache", ("apache license", "apache org licenses"), "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", ("gnu general public license",), "licensed under the GNU General Public License version 3"),
    ("gpl", ("gnu general public license", "free software foundation"), "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU General Public License for more details."),
    ("lgpl", ("lesser general public license",), "licensed under the GNU Lesser General Public License"),
    ("lgpl", ("lesser general public license", "free software foundation"), "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", ("affero general public license",), "licensed under the GNU Affero General Public License version 3"),
    ("agpl", ("affero general public license", "free software foundation"), "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl", ("mozilla public license",), "subject to the terms of the Mozilla Public License"),
    ("mpl", ("mozilla public license", "mozilla org mpl"), "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("bsd", ("redistribution and use in source and binary forms",), "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", ("redistributions in binary form must reproduce the above copyright notice",), "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-clause", ("nor the names of its contributors may be used to endorse or promote products",), "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", ("permission to use copy modify",), "Permission to use, copy, modify, and/or distribute this software for any purpose"),
    ("isc", ("the author disclaims all warranties with regard to this software",), "The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits"),
    ("zlib", ("the origin of this software must not be misrepresented",), "This software is provided as-is, without any express or implied warranty. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."),
    ("boost", ("boost software license",), "Distributed under the Boost Software License, Version 1.0"),
    ("epl", ("eclipse public license",), "made available under the terms of the Eclipse Public License"),
    ("cc0", ("creative commons zero",), "released under Creative Commons Zero 1.0 Universal public domain dedication"),
    ("cc0", ("cc0 1 0",), "CC0 1.0 Universal"),
    ("cc-by", ("creative commons attribution",), "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", ("cc by sa",), "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", ("creative commons attribution sharealike",), "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", ("cc by nc",), "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", ("creative commons attribution noncommercial",), "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc-sa", ("cc by nc sa",), "licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-sa", ("creative commons attribution noncommercial sharealike",), "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("unlicense", ("released into the public domain",), "This is free and unencumbered software released into the public domain"),
    ("wtfpl", ("do what the fuck you want to public license",), "Do what the fuck you want to public license"),
    ("proprietary", ("all rights reserved",), "all rights reserved"),
)

#: A reservation of rights that licences carry too: it stands alone or not at all.
RESERVED = "proprietary"

#: A word is a run of these; as ranges, which the matcher tests fastest.
WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate an expression once and use it many times within ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: str) -> list[str]:
    return [w.decode() for w in common.fold_words(text)]


def postings(templates=TEMPLATES, rarest: int = 24) -> list[tuple[str, int, int]]:
    """(word, template, position) for the positions of each template's rarest words.

    Rare is what stands in few templates (IDF); of equally rare words the first ones are taken. Words
    that more than half of the templates hold are indexed only where a template has no other ones.
    """
    bodies = [words_of(text) for _, _, text in templates]
    idf = {w: math.log(len(bodies) / sum(w in b for b in bodies)) for b in bodies for w in b}
    found = []
    for k, body in enumerate(bodies):
        order = sorted(set(body), key=lambda w: (-idf[w], body.index(w)))
        kept = [w for w in order if idf[w] >= math.log(2)][:rarest] or order[:rarest]
        found += [(w, k, at) for at, w in enumerate(body) if w in kept]
    return found


def phrase_pattern(phrases) -> str:
    """A regular expression for texts in which one of the phrases stands, whatever parts its words."""
    parts = ["[^0-9A-Za-z\\x80-\\x{10FFFF}]++".join(map(re.escape, words_of(p))) for p in sorted(set(phrases))]
    return f"(?<!{WORD})(?i:{'|'.join(parts)})(?!{WORD})"


def _stands(padded: Column, key: str, longer: list[str]) -> Column:
    """Whether a key phrase stands in a line of words, somewhere not as the beginning of a longer one."""
    if not longer:
        return F.contains(padded, F.lit(f" {key} "))
    # with spaces of its own on both sides of each word, so that what stands beside a longer phrase stays whole
    wide = lambda p: f" {p.replace(' ', '  ')} "
    own = F.replace(padded, F.lit(" "), F.lit("  "))
    for q in sorted(longer, key=lambda q: (-len(q), q)):
        own = F.replace(own, F.lit(wide(q)), F.lit(" "))
    return F.contains(own, F.lit(wide(key)))


def scan(docs: DataFrame, *, text: str = "text", base: dict[str, str] = BASE_PHRASES, templates=TEMPLATES, rarest: int = 24, least: float = 0.5, column: str = "licence") -> DataFrame:
    """Add ``column`` in place of the text: n_words, places of base phrases, base_labels, labels, score.

    A template counts when at least ``least`` of its indexed positions, and two or all of them, meet
    at one distance and all its key phrases stand in the text, somewhere not as the beginning of a longer
    key phrase (so that "CC BY-NC-SA" is no "CC BY-NC"). ``RESERVED`` goes where there is another label. The score is the best template's share,
    1 where a base phrase stands, else 0. Null is an empty text, without words; texts of any length
    are scanned whole; repeated rows are judged one by one; an empty table gives no rows. The text
    column is left out, an existing column of that name replaced; others pass through, whatever their names.
    """
    spark = docs.sparkSession
    phrases = [(words_of(p), k) for k, (_, keys, _) in enumerate(templates) for p in keys]
    wanted = [*base, *(p for _, keys, _ in templates for p in keys)]
    body = F.coalesce(F.col(text), F.lit(""))
    names = [c for c in common.without(docs, column).columns if c != text]
    row, id_, n_words, line, found = common.fresh(names, "row", "id", "n_words", "line", "found")
    rows = docs.select(
        F.struct(*names).alias(row) if names else F.lit(None).cast("int").alias(row),
        F.monotonically_increasing_id().alias(id_),
        F.regexp_count(body, F.lit(f"{WORD}++")).cast("long").alias(n_words),
        F.when(body.rlike(phrase_pattern(wanted)) if wanted else F.lit(False), common.folded(body)).alias(line),
    )
    rows = common.materialize(rows, "licences")
    held = rows.filter(F.col(line).isNotNull()).select(F.col(id_).alias("id"), F.col(line).alias("line"))

    # entries: base phrases first, then templates
    starts = [words_of(p) for p in base]
    entries = [(w, k, at) for k, p in enumerate(starts) for at, w in enumerate(p)] + [(w, len(starts) + k, at) for w, k, at in postings(templates, rarest)]
    word, entry, place = zip(*(entries or [("", -1, 0)]), strict=True)
    index = spark.range(1).select(F.inline(F.arrays_zip(F.lit(list(word)).alias("word"), F.lit(list(entry)).alias("entry"), F.lit(list(place)).alias("place"))))  # bounded by the templates
    sizes = [sum(e == k for _, e, _ in entries) for k in range(len(starts) + len(templates))]
    size = F.element_at(F.array(*[F.lit(n) for n in sizes]), F.col("entry") + 1) if sizes else F.lit(0)
    looked = held.select("id", F.posexplode(F.split("line", " ")).alias("at", "word")).join(F.broadcast(index), "word")
    met = looked.groupBy("id", "entry", (F.col("at") - F.col("place")).alias("offset")).agg(F.count("*").alias("n")).withColumn("size", size)
    phrase = F.col("entry") < len(starts)
    enough = F.when(phrase, F.col("n") == F.col("size")).otherwise((F.col("n") >= least * F.col("size")) & ((F.col("n") >= 2) | (F.col("n") == F.col("size"))))
    met = met.filter(enough).groupBy("id").agg(
        F.collect_list(F.when(phrase, F.struct("entry", F.col("offset").cast("long").alias("at")))).alias("places"),
        F.collect_set(F.when(~phrase, F.col("entry") - len(starts))).alias("met"),
        F.collect_set(F.when(~phrase, F.struct((F.col("entry") - len(starts)).alias("template"), (F.col("n") / F.col("size")).alias("share")))).alias("shares"),
    )
    # the key phrases of the templates that were met
    padded = F.concat(F.lit(" "), F.col("line"), F.lit(" "))
    every = {" ".join(p) for p, _ in phrases}
    stands = [(k, _stands(padded, key, [q for q in every if q.startswith(f"{key} ")])) for key, k in ((" ".join(p), k) for p, k in phrases)]
    lacking = F.array(*[F.when(F.array_contains("met", k) & ~test, F.lit(k)) for k, test in stands]) if stands else F.array().cast("array<int>")
    checked = held.join(met, "id").select("id", "places", "shares", lacking.alias("lacking"))
    label = lambda k: F.element_at(F.array(*[F.lit(t[0]) for t in templates]), k + 1) if templates else F.lit("")
    named = F.filter("shares", lambda x: ~F.array_contains(F.filter("lacking", lambda k: k.isNotNull()), x["template"]))
    base_label = lambda k: F.element_at(F.array(*[F.lit(x) for x in base.values()]), k + 1) if base else F.lit("")
    checked = checked.select("id", "places", named.alias("named"))
    result = checked.select(
        F.col("id").alias(found),
        F.struct(
            F.array_sort(F.transform("places", lambda x: x["at"])).alias("places"),
            F.array_sort(F.array_distinct(F.transform("places", lambda x: base_label(x["entry"])))).alias("base_labels"),
            let(
                F.array_sort(F.array_distinct(F.concat(F.transform("places", lambda x: base_label(x["entry"])), F.transform("named", lambda x: label(x["template"]))))),
                lambda x: F.when(F.size(x) > 1, F.array_remove(x, RESERVED)).otherwise(x),
            ).alias("labels"),
            F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("named", lambda x: x["share"])), F.lit(0.0))).alias("score"),
        ).alias("of"),
    )
    none = F.array().cast("array<string>")
    licence = F.struct(
        F.col(n_words).alias("n_words"),
        F.coalesce(F.col("of.places"), F.array().cast("array<bigint>")).alias("places"),
        F.coalesce(F.col("of.base_labels"), none).alias("base_labels"),
        F.coalesce(F.col("of.labels"), none).alias("labels"),
        F.coalesce(F.col("of.score"), F.lit(0.0)).alias("score"),
    )
    joined = rows.select(row, id_, n_words).join(result, F.col(id_) == F.col(found), "left")
    return joined.select(*[F.col(row)[c].alias(c) for c in names], licence.alias(column))
