"""License scans by a positional index of rare licence words."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: Separators of words: ASCII other than digits and letters (texts are lower-cased first).
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose places count, and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Template:
    """A licence notice: its label, its words, and phrases that must stand at their own places in it."""

    label: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()

    def places(self) -> list[tuple[int, list[str]]]:
        """Where its mandatory phrases stand in it, and their words."""
        own = self.words
        return [(next(i for i in range(len(own)) if own[i : i + len(k)] == k), k) for k in (key.split() for key in self.keys)]


#: Identifiers of public licences as they stand in one-line notices. Longer ones that start like one of them (`GPL-2.0-or-later`) count as that one.
IDENTIFIERS = ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense", "Zlib", "BSL-1.0", "0BSD")


def _identifier(name: str) -> Template:
    """The one-line notice of a licence, all of which must be there."""
    line = "spdx license identifier " + " ".join(name.lower().replace("-", " ").replace(".", " ").split())
    return Template(f"{name.lower()}-spdx", line, (line,))


#: Notices of public licences, as words.
TEMPLATES = (
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission is hereby granted free of charge to any person obtaining a copy",)),
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("apache-2.0-text", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("except in compliance with the license",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-text", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("redistribute it and or modify it", "gnu general public license")),
    Template("gpl-2.0-text", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ("gnu general public license as published by the free software foundation either version 2",)),
    Template("gpl-3.0-text", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ("gnu general public license as published by the free software foundation either version 3",)),
    Template("lgpl-text", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    Template("agpl-text", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nd-4.0", "licensed under cc by nd 4 0", ("cc by nd 4 0",)),
    Template("cc-by-nc-sa-4.0", "licensed under cc by nc sa 4 0", ("cc by nc sa 4 0",)),
    Template("cc-by-nc-nd-4.0", "licensed under cc by nc nd 4 0", ("cc by nc nd 4 0",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-text", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international license",)),
    Template("cc-by-sa-text", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0 international license",)),
    Template("cc-by-nc-text", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0 international license",)),
    Template("cc-by-nc-sa-text", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ("creative commons attribution noncommercial sharealike 4 0 international license",)),
    Template("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistribution and use in source and binary forms",)),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("nor the names of its contributors may be used to endorse or promote products",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("for any purpose with or without fee",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0", ("mozilla public license v 2 0",)),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license 2 0",)),
    Template("cddl", "the contents of this file are subject to the terms of the common development and distribution license", ("common development and distribution license",)),
    Template("eupl-1.2", "licensed under the eupl version 1 2", ("the eupl version 1 2",)),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
    Template("bsl-text", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", ("free of charge to any person or organization obtaining a copy",)),
    Template("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented", ("for any purpose including commercial applications and to alter it and redistribute it freely",)),
    Template("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", ("without fee and without a written agreement",)),
    Template("ofl-1.1", "this font software is licensed under the sil open font license version 1 1", ("sil open font license version 1 1",)),
    Template("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ("changing it is allowed as long as the name is changed",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ("unencumbered software released into the public domain",)),
) + tuple(_identifier(name) for name in IDENTIFIERS)


def _lower(text: Column) -> Column:
    """A-Z lower-cased. lower() also changes letters beyond ASCII; of those only the Kelvin sign would become ASCII alone."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9")))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(_lower(text), GAP), "")


def licence_words(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> list[tuple[str, float]]:
    """The templates' words with their IDF over all documents, rarest first (ties by word). At most the templates' words go to the driver."""
    vocabulary = sorted({w for t in templates for w in t.words})
    found = docs.select(F.explode(F.array_intersect(F.lit(vocabulary), words_of(F.col("text")))).alias("word"))
    counts = found.groupBy("word").agg(F.count("*").alias("n")).collect()
    n_docs = docs.count()
    of = {r["word"]: r["n"] for r in counts}
    return sorted(((w, math.log((n_docs + 1) / (of.get(w, 0) + 1))) for w in vocabulary), key=lambda x: (-x[1], x[0]))


def _table(values: list | dict, kind: str) -> Column:
    """A nested table as one literal, which the optimizer folds; built from its parts it would take a call into the JVM for each."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def _phrase_starts(words: Column, phrases: list[list[str]]) -> Column:
    """Sorted starts (and numbers of the phrase) of places where a phrase's words stand consecutively."""

    def at(i: Column, phrase: list[str]) -> Column:
        test = F.get(words, i) == phrase[0]
        for k, w in enumerate(phrase[1:], 1):
            test = test & (F.get(words, i + k) == w)
        return F.coalesce(test, F.lit(False))

    which = lambda i: F.coalesce(*[F.when(at(i, p), F.lit(k)) for k, p in enumerate(phrases)])
    places = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.struct(i.alias("i"), which(i).alias("k")))
    return F.when(F.size(words) > 0, F.filter(places, lambda x: x["k"].isNotNull()))


def scan_licenses(docs: DataFrame, *, templates: tuple[Template, ...] = TEMPLATES, least_votes: int = 2) -> DataFrame:
    """For every row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices.

    The index holds, for each template, the `least_votes` places of its mandatory phrases whose words have the highest IDF. All of
    these words that a file has are looked up; each place of one votes for (template, place minus position). A notice with its phrases
    in place has every one of its votes, so none is lost, whatever else a file holds. An alignment with `least_votes` votes stands if
    every mandatory phrase is where it would put it; the template's label is added then. notices: label, first word and the share of the template's words in place. score: the
    greatest such share, 1 where a base phrase was found, else 0. Null and empty texts have no words and no
    label; repeated rows give a result each; an empty table gives an empty one.
    """
    rank = {w: k for k, (w, _) in enumerate(licence_words(docs, templates))}
    keys = [t.places() for t in templates]
    posting: dict[str, list[tuple[int, int]]] = {}
    anchors: list[list[str]] = []
    for t, own in enumerate(keys):
        rarest = sorted({(rank[w], p + j, w) for p, k in own for j, w in enumerate(k)})[:least_votes]
        if len(rarest) < least_votes:
            raise ValueError(f"the phrases of {templates[t].label} have fewer than {least_votes} words")
        anchors.append(sorted({w for _, _, w in rarest}))
        for _, p, w in rarest:
            posting.setdefault(w, []).append((t, p))
    looked_up = sorted(posting, key=rank.__getitem__)
    postings = _table({w: [{"t": t, "p": p} for t, p in posting[w]] for w in looked_up}, "map<string,array<struct<t:int,p:int>>>")
    phrases = [p.split() for p in BASE]

    at = lambda words, run, x: F.coalesce(F.get(words, run["o"] + x["p"]) == x["w"], F.lit(False))  # noqa: E731  template word x is where run (t, o) puts it
    listed = lambda places: _table([[{"p": p, "w": w} for p, w in own] for own in places], "array<array<struct<p:int,w:string>>>")
    key_words = listed([[(p + j, w) for p, k in own for j, w in enumerate(k)] for own in keys])
    all_words = listed([list(enumerate(t.words)) for t in templates])

    def verified(words: Column, run: Column) -> Column:
        return F.forall(F.get(key_words, run["t"]), lambda x: at(words, run, x))

    def share(words: Column, run: Column) -> Column:
        of = F.get(all_words, run["t"])
        return F.size(F.filter(of, lambda x: at(words, run, x))) / F.size(of)

    def notices(words: Column) -> Column:
        def from_rare(chosen: Column) -> Column:
            places = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(chosen, x["w"]))
            votes = F.flatten(F.transform(places, lambda x: F.transform(F.element_at(postings, x["w"]), lambda q: F.struct(q["t"].alias("t"), (x["i"] - q["p"]).alias("o")))))

            def agreed(v: Column) -> Column:
                # sorted votes: the first of each run of at least least_votes equal ones
                return F.filter(v, lambda x, j: (j + least_votes - 1 < F.size(v)) & (F.get(v, j + least_votes - 1) == x) & F.coalesce(F.get(v, j - 1) != x, F.lit(True)))

            aligned = let(F.array_sort(votes), agreed)
            return F.transform(F.filter(aligned, lambda r: verified(words, r)), lambda r: F.struct(F.get(F.lit([t.label for t in templates]), r["t"]).alias("label"), F.greatest(r["o"], F.lit(0)).alias("start"), share(words, r).alias("share")))

        none = F.array().cast("array<struct<label:string,start:int,share:double>>")
        # a text that lacks one of them for every template has no notice
        possible = lambda chosen: F.exists(F.lit(anchors), lambda own: F.size(F.array_except(own, chosen)) == 0)
        return let(F.array_intersect(F.lit(looked_up), words), lambda chosen: F.when(possible(chosen), from_rare(chosen)).otherwise(none))

    hint = "|".join(p.replace(" ", GAP) for p in BASE)
    no_place = F.array().cast("array<struct<i:int,k:int>>")
    row = let(words_of(F.col("text")), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.when(_lower(F.col("text")).rlike(hint), F.coalesce(_phrase_starts(w, phrases), no_place)).otherwise(no_place).alias("places"),
        notices(w).alias("notices")))
    out = docs.select("doc_id", row.alias("_r")).select("doc_id", "_r.*")
    base = F.array_sort(F.array_distinct(F.transform("places", lambda x: F.get(F.lit(list(BASE.values())), x["k"]))))
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda x: x["i"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda x: x["i"])).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform("notices", lambda x: x["label"])))), ",").alias("labels"),
        F.greatest(F.when(F.size("places") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("notices", lambda x: x["share"])), F.lit(0.0))).alias("score"),
        "notices",
    )
