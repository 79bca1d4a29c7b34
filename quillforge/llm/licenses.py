"""License scans with a positional rare-token index, in DataFrame operations only.

Words are weighted by their inverse document frequency over all documents. Templates are the notices that files carry and
whole license texts. Of each template the rarest words are posted, (word -> template, position), down to the weight at which
no file can have half of the template in place without two of them; the rarest word of its mandatory phrase always is.

A file's occurrences of posted words give offsets (position in the file less position in the template). Where the mandatory
phrase stands, the postings of its template are intersected by relative position: those whose offsets lie within SHIFT of the
phrase's, as words put in or left out move what follows. They must weigh enough to reach the score at all. The score is
the part of the template's weight, over all of its words, that stands in place at any of these offsets. A template is found
at LEAST_SCORE or more.

Scale: one pass over the texts stores, for each document, how many words it has and which license words. The frequencies,
and which documents can reach the score or hold a phrase at all, come from that small table. Only those documents are read
again, by a broadcast of their keys whose size is checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillforge.llm.common import sent_if_small, stage_table, table

#: Words as the contract has them, before A-Z are lower-cased (which moves no boundary).
TOKEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Phrases and labels of the base.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Label, words of the notice, its mandatory phrase.
NOTICES = (
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "source and binary forms"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("cc-by", "licensed under cc by 4 0", "cc by"),
    ("cc-by", "licensed under cc by nc 4 0", "cc by"),
    ("cc-by", "licensed under cc by sa 4 0", "cc by"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "free of charge"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software"),
)

# Label, words of the license text, its mandatory phrase.
TEXTS = (
    (
        "mit",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the
        software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
        the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the software the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders
        be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
        connection with the software or the use or other dealings in the software""",
        "distribute sublicense and or sell copies",
    ),
    (
        "bsd",
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions
        are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors
        as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a
        particular purpose are disclaimed""",
        "redistributions in binary form must reproduce",
    ),
    (
        "bsd",
        """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission""",
        "endorse or promote products",
    ),
    (
        "isc",
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the
        above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all
        warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be
        liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits
        whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of
        this software""",
        "the author disclaims all warranties",
    ),
    (
        "zlib",
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
        arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
        applications and to alter it and redistribute it freely subject to the following restrictions 1 the origin of this software must not be
        misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the
        product documentation would be appreciated but is not required 2 altered source versions must be plainly marked as such and must not be
        misrepresented as being the original software 3 this notice may not be removed or altered from any source distribution""",
        "altered source versions must be plainly marked",
    ),
    (
        "bsl",
        """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare
        derivative works of the software and to permit third parties to whom the software is furnished to do so""",
        "any person or organization obtaining",
    ),
    (
        "unlicense",
        """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
        distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any
        means""",
        "as a compiled binary",
    ),
    (
        "wtfpl",
        """everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as
        the name is changed""",
        "changing it is allowed",
    ),
    (
        "apache",
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may
        obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing
        software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or
        implied see the license for the specific language governing permissions and limitations under the license""",
        "governing permissions and limitations",
    ),
    (
        "gpl",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by
        the free software foundation either version 3 of the license or at your option any later version this program is distributed in the
        hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular
        purpose see the gnu general public license for more details""",
        "see the gnu general public license",
    ),
    (
        "lgpl",
        """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as
        published by the free software foundation either version 2 1 of the license or at your option any later version""",
        "gnu lesser general public license",
    ),
    (
        "mpl",
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this
        file you can obtain one at http mozilla org mpl 2 0""",
        "copy of the mpl",
    ),
)
TEMPLATES = NOTICES + TEXTS
LEAST_SCORE = 0.5
#: How many words may be put into a file's license text, or left out of it, between its phrase and any other word.
SHIFT = 16


def posted(words: list[str], weights: list[float], always: int) -> list[int]:
    """The positions of a template that are posted: the heaviest first, until what is left weighs less than LEAST_SCORE of the
    whole even with one posted word more. A file that reaches the score then has two of them in place."""
    whole = sum(weights)
    order = sorted(range(len(words)), key=lambda i: (-weights[i], i))
    taken, left = {always}, whole - weights[always]
    for i in order:
        if left + max(weights) < LEAST_SCORE * whole:
            break
        if i not in taken:
            taken.add(i)
            left -= weights[i]
    return sorted(taken)


def _words(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))
    # only words of ASCII letters and digits are lower-cased: others equal no license word anyway
    return F.transform(found, lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(w))


def _constant(words: list[str]) -> Column:
    """An array of strings without blanks, as one constant of the plan."""
    return F.split(F.lit(" ".join(words)), " ")


def _starts(words: str, phrase: list[str]) -> Column:
    """All places, from 0, at which the phrase's words stand one after another in the array column `words`."""

    def here(i: Column) -> Column:
        out = F.get(F.col(words), i) == phrase[0]
        for j, w in enumerate(phrase[1:], 1):
            out = out & (F.get(F.col(words), i + j) == w)
        return out

    last = F.size(words) - len(phrase)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), here)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, templates: tuple[tuple[str, str, str], ...] = TEMPLATES) -> DataFrame:
    """The result of op7 for every row of docs, and `found`: (label, template number, score, place) of each template found.

    Defined cases: null texts have no words; repeated rows give equal rows; a null doc_id keeps its row; phrases that
    overlap all count. Other columns are ignored. With no documents at all the result is empty."""
    lists = [(label, words.split(), phrase.split()) for label, words, phrase in templates]
    vocabulary = sorted({w for _, words, _ in lists for w in words} | {w for p in PHRASES for w in p.split()})
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    scanned = keyed.select("doc_id", "text_key", _words(F.col("text")).alias("words"))
    held = scanned.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", _constant(vocabulary)).alias("held"))
    held = stage_table(held, "license-words")

    # one number a word of the templates, and how many documents there are
    counts = {r["word"]: r["n"] for r in held.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    total = held.count()
    idf = {w: F.log(F.lit((total + 1.0) / (counts.get(w, 0) + 1.0))) for w in vocabulary}
    spark = docs.sparkSession
    weights = spark.range(1).select(F.explode(F.map_from_arrays(_constant(vocabulary), F.array(*idf.values()))).alias("word", "idf"))
    weights = stage_table(weights.select("word", F.greatest("idf", F.lit(1e-6)).alias("idf")), "license-idf")
    weight = {r["word"]: r["idf"] for r in weights.collect()}

    def mass(words: list[str]) -> float:
        return sum(weight[w] for w in words)

    def can_reach(words: list[str]) -> Column:
        distinct = sorted(set(words))
        worth = F.map_from_arrays(_constant(distinct), _constant([repr(weight[w] * words.count(w)) for w in distinct]).cast("array<double>"))
        got = F.aggregate("held", F.lit(0.0), lambda total, w: total + F.coalesce(F.try_element_at(worth, w), F.lit(0.0)))
        return got >= LEAST_SCORE * mass(words) - 1e-9

    def holds(words: list[str]) -> Column:
        return F.size(F.array_intersect("held", _constant(sorted(set(words))))) == len(set(words))

    possible = F.lit(False)
    for phrase in PHRASES:
        possible = possible | holds(phrase.split())
    for _, words, phrase in lists:
        possible = possible | (holds(phrase) & can_reach(words))  # few files hold all words of a phrase
    keys = stage_table(held.where(possible).select(F.col("doc_id").alias("at_doc"), F.col("text_key").alias("at_key")).distinct(), "license-keys")
    same = F.col("doc_id").eqNullSafe(F.col("at_doc")) & F.col("text_key").eqNullSafe(F.col("at_key"))
    near = keyed.join(sent_if_small(keys), same).select("at_doc", "at_key", _words(F.col("text")).alias("words"))
    near = stage_table(near.dropDuplicates(["at_doc", "at_key"]), "license-texts")

    postings: dict[str, list[tuple[int, int]]] = {}
    seeds: dict[str, list[tuple[int, int]]] = {}
    phrase_at, least_mass = [], []
    for t, (_, words, phrase) in enumerate(lists):
        phrase_at.append(next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase))
        rarest = phrase_at[t] + max(range(len(phrase)), key=lambda i: (weight[phrase[i]], phrase[i]))
        places = posted(words, [weight[w] for w in words], rarest)
        least_mass.append(LEAST_SCORE * mass(words) - sum(weight[w] for i, w in enumerate(words) if i not in places) - 1e-9)
        seeds.setdefault(words[rarest], []).append((t, rarest))
        for i in places:
            postings.setdefault(words[i], []).append((t, i))
    # of each template its words, their weights, and where its phrase begins and ends: constants of the plan
    template_words = F.array(*[_constant(words) for _, words, _ in lists])
    template_weights = F.array(*[_constant([repr(weight[w]) for w in words]).cast("array<double>") for _, words, _ in lists])
    numbers = lambda values: _constant(list(map(str, values))).cast("array<int>")
    doubles = lambda values: _constant(list(map(repr, values))).cast("array<double>")
    begins, ends = numbers(phrase_at), numbers([at + len(phrase) - 1 for at, (_, _, phrase) in zip(phrase_at, lists, strict=True)])
    labels_of, masses, needed = _constant([label for label, _, _ in lists]), doubles([mass(words) for _, words, _ in lists]), doubles(least_mass)

    def hits(index: dict[str, list[tuple[int, int]]]) -> Column:
        """(template, place in it, offset) of every occurrence of an indexed word."""
        listed = {w: F.array(*[F.struct(F.lit(t).alias("template"), F.lit(place).alias("place")) for t, place in places]) for w, places in index.items()}
        lookup = F.create_map(*[c for w, places in listed.items() for c in (F.lit(w), places)])
        at = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(*index))
        return F.flatten(F.transform(at, lambda x: F.transform(F.element_at(lookup, x["word"]), lambda p: F.struct(p["template"], p["place"], (x["at"] - p["place"]).alias("offset")))))

    def in_place(t: Column, j: Column, offset: Column) -> Column:
        return F.coalesce(F.get(F.col("words"), offset + j) == F.get(F.get(template_words, t), j), F.lit(False))

    def phrase_stands(c: Column) -> Column:
        t = c["template"]
        return F.forall(F.sequence(F.get(begins, t), F.get(ends, t)), lambda j: in_place(t, j, c["offset"]))

    def intersected(c: Column) -> Column:
        near = F.filter("hits", lambda h: (h["template"] == c["template"]) & (F.abs(h["offset"] - c["offset"]) <= SHIFT))
        return F.struct(c["template"], c["offset"], F.array_distinct(F.transform(near, lambda h: h["place"])).alias("places"), F.array_distinct(F.transform(near, lambda h: h["offset"])).alias("offsets"))

    def weighs_enough(c: Column) -> Column:
        got = F.aggregate(c["places"], F.lit(0.0), lambda total, place: total + F.get(F.get(template_weights, c["template"]), place))
        return got >= F.get(needed, c["template"])

    def scored(c: Column) -> Column:
        """(label, template number, score, place)."""
        t = c["template"]
        here = lambda j: F.exists(c["offsets"], lambda offset: in_place(t, j, offset))
        part = F.aggregate(F.sequence(F.lit(0), F.size(F.get(template_words, t)) - 1), F.lit(0.0), lambda got, j: got + F.when(here(j), F.get(F.get(template_weights, t), j)).otherwise(0.0)) / F.get(masses, t)
        return F.struct(F.get(labels_of, t).alias("label"), t.alias("template"), F.least(part, F.lit(1.0)).alias("score"), c["offset"].alias("place"))

    base = near.withColumn("hits", hits(postings)).withColumn("phrases", F.filter(hits(seeds), phrase_stands))
    base = base.withColumn("candidates", F.filter(F.transform("phrases", intersected), weighs_enough))
    base = base.withColumn("found", F.sort_array(F.filter(F.transform("candidates", scored), lambda x: x["score"] >= LEAST_SCORE)))
    base = base.select("at_doc", "at_key", F.array(*[F.struct(F.lit(label).alias("label"), _starts("words", phrase.split()).alias("starts")) for phrase, label in PHRASES.items()]).alias("base"), "found")
    every = F.flatten(F.transform("base", lambda x: x["starts"]))
    base = base.select("at_doc", "at_key", every.alias("starts"), F.transform(F.filter("base", lambda x: F.size(x["starts"]) > 0), lambda x: x["label"]).alias("base_labels"), F.when(F.size("found") > 0, F.col("found")).alias("found"))

    def again(df: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
        other = other.withColumnsRenamed({"at_doc": "other_doc", "at_key": "other_key"})
        return df.join(other, F.col("at_doc").eqNullSafe(F.col("other_doc")) & F.col("at_key").eqNullSafe(F.col("other_key")), how).drop("other_doc", "other_key")

    out = again(held.select(F.col("doc_id").alias("at_doc"), F.col("text_key").alias("at_key"), "n_words"), base, "left")
    labels = F.coalesce("base_labels", F.array().cast("array<string>"))
    mine = F.coalesce(F.transform("found", lambda x: x["label"]), F.array().cast("array<string>"))
    return out.select(
        F.col("at_doc").alias("doc_id"),
        "n_words",
        F.when(F.col("starts").isNull(), 0).otherwise(F.size("starts")).cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort(labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, mine)), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0)).alias("score"),
        "found",
    )


def op7_license_index(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("found")
