"""Licence scans with built-in functions only, by a positional index of rare words.

Licence templates are word sequences with a mandatory key phrase. Their words'
inverse document frequencies come from all documents. Each template is posted under
the word of its key phrase with the highest one, and of the licence words of a file
those are looked up that a posting names: a lookup aligns template and file. The key
phrase is verified word for word at the aligned place, and the template's other words
are intersected with the file by their relative positions. The phrases of the base
labels are templates that are nothing but their key phrase, so every place of theirs
is found. A file is one row from beginning to end: lookups are numbers, whatever
their count, and nothing is exchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .native_text import in_list, with_words

#: Base labels: phrases counted at all places. Fixed values of the query's contract.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: (label, notice, key phrase) of common public licence notices.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "general public license version 3"),
    ("gpl-grant", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "redistribute it and or modify it"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
)
#: (label, text, key phrase) of whole licence texts, or their operative paragraphs.
TEXTS = (
    (
        "apache-2.0-text",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"
        " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
        " see the license for the specific language governing permissions and limitations under the license",
        "except in compliance with the license",
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
        " redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistributions of source code must retain the above copyright notice",
    ),
    (
        "gpl-text",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"
        " this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
        "redistribute it and or modify it",
    ),
    (
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
        " the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "permission to use copy modify",
    ),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "permission is hereby granted free of charge",
    ),
    (
        "zlib-text",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"
        " permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "permission is granted to anyone to use this software for any purpose",
    ),
)


def scan(docs: DataFrame, *, base=BASE, notices=NOTICES + TEXTS, least: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, first_word and last_word are their
    smallest and largest start (words from 0, else null). labels adds the notices
    whose key phrase stands at an alignment that matches at least `least` of the
    notice's inverse document frequency; score is the best such share, 0 without
    any. Null and empty texts have no words; ids may be null and may repeat.
    """
    templates = [(label, phrase.split(), 0, phrase, True) for label, phrase in base]
    for label, notice, key in notices:
        words, k = notice.split(), key.split()
        at = next((i for i in range(len(words) - len(k) + 1) if words[i : i + len(k)] == k), None)
        if at is None:
            raise ValueError(f"a notice must hold its key phrase: {notice}")
        templates.append((label, words, at, key, False))
    vocab = sorted({w for t in templates for w in t[1]})
    base_rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    words = with_words(base_rows, "text").drop("text")

    # document frequencies of the templates' words; a row per word comes to the driver
    present = words.select(F.explode_outer(F.array_intersect("words", F.array(*map(F.lit, vocab)))).alias("word"))
    counts = {r["word"]: r["n"] for r in present.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_docs = max(1, docs.count())
    idf = {w: math.log(1 + n_docs / (1 + counts.get(w, 0))) for w in vocab}

    posted = []
    for label, tw, at, key, is_base in templates:
        key_words = key.split()
        k = min(range(len(key_words)), key=lambda j: (-idf[key_words[j]], j))
        posted.append((label, tw, at, key, is_base, key_words[k], k, len(key_words)))

    looked = in_list("words[i - 1]", sorted({t[5] for t in posted}))
    found = words.withColumn("places", F.expr(f"filter(if(size(words) > 0, sequence(1, size(words)), array()), i -> {looked})"))
    shares, places, reached = [], {}, {}
    for t, (label, tw, at, key, is_base, word, k, n) in enumerate(posted):
        # the first condition keeps the slice's start above 0
        here = f"transform(filter(places, i -> i > {k} AND words[i - 1] = '{word}' AND array_join(slice(words, i - {k}, {n}), ' ') = '{key}'), i -> cast(i - {k + 1} AS long))"
        places[f"at_{t}"] = F.expr(here)  # where the key phrase begins
        if not is_base:
            total = sum(idf[w] for w in tw)
            terms = ", ".join(f"named_struct('o', {j - at}, 'w', '{w}', 's', {idf[w] / total!r}D)" for j, w in enumerate(tw))
            share = f"array_max(transform(at_{t}, b -> aggregate(array({terms}), 0D, (s, x) -> s + if(coalesce(get(words, cast(b AS int) + x.o) = x.w, false), x.s, 0D))))"
            shares.append((t, label, f"share_{t}"))
            reached[f"share_{t}"] = F.expr(f"if(size(at_{t}) > 0, {share}, 0D)")
    found = found.withColumns(places).withColumns(reached)
    bases = [(t, p[0]) for t, p in enumerate(posted) if p[4]]
    starts = F.flatten(F.array(*[F.col(f"at_{t}") for t, _ in bases])) if bases else F.array().cast("array<long>")
    base_labels = [F.when(F.size(f"at_{t}") > 0, F.lit(label)) for t, label in bases]
    other_labels = [F.when(F.col(c) >= least, F.lit(label)) for _, label, c in shares]
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",") if labels else F.lit("")
    best = [F.when(F.col(c) >= least, F.col(c)).otherwise(F.lit(0.0)) for _, _, c in shares]
    score = F.array_max(F.array(F.when(F.size("starts") > 0, 1.0).otherwise(0.0), *best))
    return found.withColumn("starts", starts).select(
        F.col("id").alias(id_col),
        F.size("words").cast("long").alias("n_words"),
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        joined(base_labels).alias("base_labels"),
        joined(base_labels + other_labels).alias("labels"),
        F.least(F.lit(1.0), F.round(score, 12)).alias("score"),
    )
