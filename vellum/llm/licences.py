"""License scans with a positional rare-token index (operator 4), in DataFrame functions only.

The templates are indexed by word: a posting says in which template a word stands and
where.  The document frequency of every indexed word is counted over the whole corpus.

1. The ``SEEDS`` rarest words of each template are looked up in all files: a posting and a
   place in the file give a relative position, and so propose a copy of the template there.
2. A proposal stays where one of the template's mandatory phrases stands in the file at the
   same relative position.
3. All indexed words of the template that stand there are weighed by their rarity; a copy
   has at least ``AGREE`` of the template's weight.

Relative positions agree within overlapping windows of ``DRIFT`` words, so that lost or added
words don't split a copy.  Of matches with one label that overlap, the best stays.

Scale: texts are read once; what is written to the shared folder and shuffled afterwards is
the places of indexed words and phrases.  Templates and their postings are constants of this
module, so broadcasting them is bounded.

Base findings (places of fixed phrases) do not depend on the index.

Defined results: a null text counts as empty and has no words; rows that repeat are
scanned each; an empty table has an empty result; other input columns are kept unless they
are called like an output column; words of any number and length are handled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import stage, without

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Separators between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Label, text that is looked for (public licence texts and the usual notices), phrases of which one is mandatory.
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["to any person obtaining a copy"]),
    (
        "mit",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
        the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to
        the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions
        of the software the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders
        be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in
        connection with the software or the use or other dealings in the software""",
        ["to deal in the software without restriction", "the rights to use copy modify merge publish"],
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    (
        "apache-2.0",
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may
        obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing
        software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or
        implied see the license for the specific language governing permissions and limitations under the license""",
        ["apache license", "except in compliance with the license"],
    ),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["binary forms"]),
    (
        "bsd-2-clause",
        """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions
        are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
        redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
        documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors
        as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a
        particular purpose are disclaimed""",
        ["provided with the distribution this software is provided by"],  # with a third clause other words stand between
    ),
    (
        "bsd-3-clause",
        """neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from
        this software without specific prior written permission""",
        ["endorse or promote products"],
    ),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    (
        "gpl-3.0",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published
        by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the
        hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular
        purpose see the gnu general public license for more details""",
        ["the gnu general public license as published by the free software foundation either version 3 of the license"],
    ),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    (
        "gpl-2.0",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published
        by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the
        hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular
        purpose see the gnu general public license for more details""",
        ["the gnu general public license as published by the free software foundation either version 2 of the license"],
    ),
    ("lgpl", "licensed under the gnu lesser general public license", ["lesser general public license"]),
    (
        "lgpl",
        """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as
        published by the free software foundation""",
        ["lesser general public license"],
    ),
    ("agpl", "licensed under the gnu affero general public license", ["affero general public license"]),
    (
        "agpl",
        """you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software
        foundation""",
        ["affero general public license"],
    ),
    ("mpl-2.0", "subject to the terms of the mozilla public license", ["mozilla public license"]),
    (
        "mpl-2.0",
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this
        file you can obtain one at http mozilla org mpl 2 0""",
        ["source code form is subject", "copy of the mpl"],
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-zero", "dedicated to the public domain under creative commons zero", ["creative commons zero"]),
    (
        "unlicense",
        """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
        distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any
        means""",
        ["free and unencumbered software"],
    ),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ["distribute this software"]),
    (
        "isc",
        """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the
        above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all
        warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be
        liable for any special direct indirect or consequential damages""",
        ["with or without fee is hereby granted", "the author disclaims all warranties"],
    ),
    (
        "zlib",
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages
        arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
        applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be
        misrepresented you must not claim that you wrote the original software""",
        ["alter it and redistribute it freely"],
    ),
    (
        "bsl-1.0",
        """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
        covered by this license the software to use reproduce display distribute execute and transmit the software""",
        ["any person or organization obtaining a copy"],
    ),
    ("bsl-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("epl-2.0", "under the terms of the eclipse public license v 2 0", ["eclipse public license"]),
    ("no-warranty", "merchantability fitness for a particular purpose and noninfringement", ["particular purpose"]),
    ("copyright", "copyright all rights reserved", ["rights reserved"]),
]
#: Labels and the identifiers that stand for them in a line "SPDX-License-Identifier: ...".
IDENTIFIERS = [
    ("mit", "MIT"), ("apache-2.0", "Apache-2.0"), ("bsd-2-clause", "BSD-2-Clause"), ("bsd-3-clause", "BSD-3-Clause"), ("gpl-2.0", "GPL-2.0"), ("gpl-3.0", "GPL-3.0"),
    ("lgpl", "LGPL-2.1"), ("lgpl", "LGPL-3.0"), ("agpl", "AGPL-3.0"), ("mpl-2.0", "MPL-2.0"), ("isc", "ISC"), ("zlib", "Zlib"), ("unlicense", "Unlicense"), ("bsl-1.0", "BSL-1.0"), ("epl-2.0", "EPL-2.0"), ("cc-zero", "CC0-1.0"),
]
TEMPLATES += [(label, said, [said]) for label, said in ((x, f"spdx license identifier {y.lower().replace('-', ' ').replace('.', ' ')}") for x, y in IDENTIFIERS)]
#: Words too frequent in any text to be indexed.
PLAIN = "a all an and any are as at be but by can do for from if in is it its may more must not of on one or other out so that the they this to under use was will with without work you your".split()
#: A copy needs this part of the weight of its template's words.
AGREE = 0.6
#: Rare words of a template that propose copies; relative positions that far apart agree.
SEEDS, DRIFT = 12, 16


def word_postings() -> list[tuple[str, int, int]]:
    """word, template, position."""
    return [(w, k, i) for k, (_, text, _) in enumerate(TEMPLATES) for i, w in enumerate(text.split()) if w not in PLAIN and not w.isdigit()]


def phrase_postings() -> list[tuple[str, int, int]]:
    """Mandatory phrase, template, position; a phrase stands once or more in its template."""
    out = []
    for k, (_, text, phrases) in enumerate(TEMPLATES):
        words = text.split()
        for phrase in phrases:
            own = phrase.split()
            out += [(phrase, k, i) for i in range(len(words)) if words[i : i + len(own)] == own]
    return out


def _lower(text: Column) -> Column:
    """A-Z lower-cased; the two other letters that lower() would turn into ASCII become one that it leaves."""
    odd = text.contains("\u212a") | text.contains("\u0130")
    return F.lower(F.when(odd, F.regexp_replace(text, "[\u212a\u0130]", "\u00df")).otherwise(text))


def _places(phrase: str) -> Column:
    """Where the words of ``phrase`` stand one after the other in the array ``words``."""
    first, *rest = phrase.split()
    test = " and ".join([f"w = '{first}'", *[f"get(__words, i + {k}) = '{w}'" for k, w in enumerate(rest, 1)]])
    return F.expr(f"filter(transform(__words, (w, i) -> if({test}, i, -1)), i -> i >= 0)")


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("word")))


def _standing(phrase: str) -> Column:
    return F.transform(_places(phrase), lambda i: F.struct(F.lit(phrase).alias("word"), i.alias("at")))


def scan_licences(docs: DataFrame, text: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """``docs`` with n_words, base (label, first word), templates (label, first word, score), score.

    ``carry``: the columns of ``docs`` to keep, all if None.
    """
    spark: SparkSession = docs.sparkSession
    base = without(docs, "n_words", "base", "templates", "score")
    own = [F.col(f"`{c}`") for c in base.columns if carry is None or c in carry]
    index, phrases = word_postings(), phrase_postings()
    indexed = sorted({w for w, _, _ in index})
    mandatory = sorted({p for p, _, _ in phrases})
    keys = sorted({max(p.split(), key=len) for p in [*BASE, *mandatory]})
    words = F.filter(F.split(_lower(F.coalesce(F.col(text), F.lit(""))), BETWEEN, -1), lambda w: w != "")
    read = base.select(F.monotonically_increasing_id().alias("__rid"), *own, words.alias("__words"))
    listed = ", ".join(f"'{w}'" for w in indexed)
    hits = F.expr(f"filter(transform(__words, (w, i) -> if(w in ({listed}), named_struct('word', w, 'at', i), null)), x -> x is not null)")
    found = F.concat(*[_labelled(_places(p), label) for p, label in BASE.items()])
    sure = F.concat(*[_standing(p) for p in mandatory])
    read = read.withColumn("__hits", hits)
    # a phrase needs its longest word; few texts have any
    some = F.exists("__words", lambda w: w.isin(keys))
    scanned = stage(
        read.withColumn("__some", some).select(
            "__rid",
            *own,
            F.size("__words").cast("long").alias("n_words"),
            F.when(F.col("__some"), found).alias("base"),
            F.when(F.size("__hits") > 0, F.col("__hits")).alias("__hits"),
            F.when(F.col("__some"), sure).alias("__sure"),
        ),
        "licence-scan",
    )

    n_docs = scanned.count()
    having = scanned.select(F.explode(F.array_distinct(F.transform("__hits", lambda x: x["word"]))).alias("word"))
    frequency = having.groupBy("word").agg(F.count("*").alias("df"))  # at most one row an indexed word
    weight = frequency.select("word", F.log((F.lit(n_docs) + 1) / F.col("df")).alias("idf"))
    posted = spark.createDataFrame(index, "word string, template int, position int").join(F.broadcast(weight), "word", "left")
    rarest = Window.partitionBy("template").orderBy(F.col("idf").desc_nulls_last(), "position")
    posted = stage(posted.withColumn("seed", F.row_number().over(rarest) <= SEEDS), "licence-postings")
    totals = F.broadcast(posted.groupBy("template").agg(F.sum("idf").alias("total")))

    def aligned(column: str, postings: DataFrame, *more: str) -> DataFrame:
        """Places of postings' words, in both windows of relative positions that they fall into."""
        places = scanned.select("__rid", F.explode(column).alias("x")).select("__rid", "x.word", "x.at")
        window = F.floor((F.col("at") - F.col("position")) / (DRIFT // 2))
        both = F.explode(F.array(window, window - 1)).alias("window")
        return places.join(F.broadcast(postings), "word").select("__rid", "template", both, *more)

    copy = ["__rid", "template", "window"]
    proposed = aligned("__hits", posted.filter("seed")).distinct()
    verified = stage(proposed.join(aligned("__sure", spark.createDataFrame(phrases, "word string, template int, position int")).distinct(), copy), "licence-copies")
    stands = aligned("__hits", posted, "position", "at", "idf").join(verified, copy)
    stands = stands.groupBy(*copy, "position").agg(F.first("idf").alias("idf"), F.min("at").alias("first"), F.max("at").alias("last"))
    weighed = stands.groupBy(*copy).agg(F.sum("idf").alias("weight"), F.min("first").alias("first"), F.max("last").alias("last"))
    labels = F.create_map(*[F.lit(x) for k, (label, _, _) in enumerate(TEMPLATES) for x in (k, label)])
    score = F.when(F.col("total") > 0, F.least(F.lit(1.0), F.round(F.col("weight") / F.col("total"), 6))).otherwise(F.lit(0.0))
    agreed = weighed.join(totals, "template").withColumn("score", score).filter(F.col("score") >= AGREE).withColumn("label", labels[F.col("template")])
    # neighbouring windows see the same copy, and so do templates of one label
    rank = F.struct("score", -F.col("window"), -F.col("template"))
    near = Window.partitionBy("__rid", "template").orderBy("window").rangeBetween(-1, 1)
    agreed = agreed.withColumn("rank", rank).withColumn("best", F.max("rank").over(near)).filter("rank = best")
    top = F.max(F.struct("rank", "first", "last")).over(Window.partitionBy("__rid", "label"))
    agreed = agreed.withColumn("top", top)
    agreed = agreed.filter((F.col("rank") == F.col("top.rank")) | (F.col("first") > F.col("top.last")) | (F.col("last") < F.col("top.first")))
    match = F.struct("label", F.col("first").cast("long").alias("word"), "score")
    matches = agreed.groupBy("__rid").agg(F.sort_array(F.collect_set(match)).alias("templates"))
    out = scanned.drop("__hits", "__sure").join(matches, "__rid", "left").drop("__rid")
    none = F.array().cast(matches.schema["templates"].dataType)
    out = out.withColumn("base", F.coalesce("base", F.array().cast(scanned.schema["base"].dataType)))
    out = out.withColumn("templates", F.coalesce("templates", none))
    best = F.coalesce(F.array_max(F.transform("templates", lambda m: m["score"])), F.lit(0.0))
    return out.withColumn("score", F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best))
