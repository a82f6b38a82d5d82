"""Licence notices by a trained paragraph classifier.

A paragraph is a line, or a group of neighbouring lines over which a notice may be wrapped. Its features are the content words and word pairs that occur in the training
notices; a multinomial logistic regression, trained here on variants of notices, of sentences made of
the licences' names, and of plain sentences, gives each family a score. The class `unknown` takes part
like a family, and a family counts only above a probability that was set on sentences of other
patterns, held out whole. Versions and neighbours (GPL 2 and 3, BSD 2 and 3, CC BY with more letters)
are families of their own. A prediction stands if the paragraph also holds a template of the family:
of a notice CONFIRM percent of its word pairs and all with a number, of a name all of its pairs and what
ties it to a licence (`under`, `licensed`, `identifier`). A second family of a paragraph stands if its
name has a template too, or is joined by `and` or `or` to one that has, and no rule speaks against it.
A sentence that negates (`not licensed`) is unknown. Weights are whole thousandths, so that sums are
exact everywhere.

Main path: DataFrame functions. Training happens on the driver, on the notices below, of a fixed
number, and not on the corpus. Only lines with a content word are cut into word pairs; weights and
notices are small tables of a size that the training set bounds.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Variants of each notice, and of each sentence made of a pattern and a name, for training.
VARIANTS, MADE_VARIANTS = 10, 5
#: Percent of a notice's word pairs that a paragraph must hold.
CONFIRM = 60
#: Weight, in thousandths, against a family whose name goes on as another's (MIT-0), and of a negation.
AGAINST = 30_000
SCALE = 1000
#: Words that a wrapped notice may have more than the longest notice, for words put in between.
SLACK = 8

# fixed values: how licences name themselves
NOTICES: dict[str, list[str]] = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT license", "This project is licensed under the terms of the MIT License", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0", "This project is licensed under the Apache 2.0 license", "SPDX-License-Identifier: Apache-2.0",
                   "you may not use this file except in compliance with the License"],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Released under the GNU General Public License version 3", "SPDX-License-Identifier: GPL-3.0",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"],
    "gpl-2.0": ["Released under the GNU General Public License version 2", "SPDX-License-Identifier: GPL-2.0",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"],
    "lgpl-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"],
    "bsd-3-clause": ["Licensed under the BSD 3-Clause License.", "Released under the 3-clause BSD license", "SPDX-License-Identifier: BSD-3-Clause",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, Version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "cc-by-sa-4.0": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc-by-nc-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."],
    "cc0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Licensed under CC0 1.0 Universal."],
    "proprietary": ["All rights reserved.", "Copyright, all rights reserved. No part may be reproduced without permission."],
}
# fixed values: the names of licences as sentences use them
NAMES: dict[str, list[str]] = {
    "mit": ["MIT License", "MIT licence", "MIT"],
    "apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache licence v2", "Apache-2.0"],
    "gpl-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3", "GPL-3.0"],
    "lgpl-3.0": ["GNU Lesser General Public License, version 3", "GNU LGPL version 3", "LGPLv3", "LGPL-3.0"],
    "agpl-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPLv3", "AGPL-3.0"],
    "bsd-3-clause": ["BSD 3-Clause License", "3-clause BSD license", "new BSD license", "BSD-3-Clause"],
    "mpl-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "gpl-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2", "GPL-2.0"],
    "lgpl-2.1": ["GNU Lesser General Public License, version 2.1", "GNU LGPL version 2.1", "LGPLv2.1", "LGPL-2.1"],
    "bsd-2-clause": ["BSD 2-Clause License", "2-clause BSD license", "simplified BSD license", "BSD-2-Clause"],
    "apache-1.1": ["Apache License, Version 1.1", "Apache License 1.1", "Apache-1.1"],
    "mpl-1.1": ["Mozilla Public License, version 1.1", "Mozilla Public License 1.1", "MPL 1.1", "MPL-1.1"],
    "epl-1.0": ["Eclipse Public License, version 1.0", "Eclipse Public License 1.0", "EPL 1.0", "EPL-1.0"],
    "mit-0": ["MIT No Attribution License", "MIT-0 License", "MIT-0"],
    "cc-by-nd-4.0": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "Creative Commons Attribution-NoDerivatives 4.0", "CC BY-ND 4.0"],
    "cc-by-nc-sa-4.0": ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0", "CC BY-NC-SA 4.0"],
    "cc-by-nc-nd-4.0": ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "CC BY-NC-ND 4.0"],
    "isc": ["ISC License", "ISC licence", "ISC"],
    "epl-2.0": ["Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL 2.0", "EPL-2.0"],
    "bsl-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"],
    "cc-by-4.0": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0", "CC BY 4.0"],
    "cc-by-sa-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 4.0"],
    "cc-by-nc-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0", "CC BY-NC 4.0"],
    "cc0-1.0": ["Creative Commons Zero 1.0", "CC0 1.0 Universal", "CC0 1.0"],
}
# what such sentences say around a name; every fourth is held out, whole
PATTERNS = [
    "Released under the {}.", "Licensed under the {}", "This project is licensed under the terms of the {}", "Distributed under the {}", "SPDX-License-Identifier: {}", "The code is {}-licensed.", "License: {}", "You can use this under {} terms",
    "Made available under {}.", "Use of this source code is governed by the {}", "It is covered by the {}", "Published under the {}",
]
# pieces of such sentences that confirm a name, and those that do so beside another one
TEMPLATES = ["under the {}", "under {}", "the {} terms", "under {} terms", "is {} licensed", "license {}", "license identifier {}", "governed by the {}", "covered by the {}", "terms of the {}"]
JOINED = ["or {}", "and {}", "or the {}", "and the {}"]
# pairs of common words that tie a name to a licence, and pairs that negate
CONTEXT = ["under the", "governed by", "covered by"]
NEGATIONS = ["not licensed", "not released", "not distributed", "not published", "not available", "not covered", "not governed", "not under", "isn t", "never licensed", "never released", "neither licensed", "longer licensed", "longer under"]
# plain sentences for the class unknown, with words of the notices; every fourth is held out
OTHER = [
    "The driver showed her license at the gate.", "He was released from the hospital under supervision.", "The general public may visit the museum free of charge.", "Version 2.0 of the game comes out in May.",
    "She studied at MIT in Boston.", "The Apache helicopter landed in the field.", "A permission slip is required for this trip.", "The source of the river lies in the north.", "Creative work is common in this international school.",
    "These conditions are met in binary stars.", "The fishing license costs 4 dollars.", "Rights and duties of the author under the new law.", "Use the following form to redistribute funds.", "GNU is an animal of the plains.",
    "Copyright law is taught in the third term.", "The software is new and the documentation is short.", "Licensed plumber, version unknown.", "no part of the work was done", "terms of trade", "a license to print money",
    "Researchers at MIT published a paper.", "The BSD family of systems is old.", "The eclipse of the sun was visible in public places.", "Boost your sales with this software.", "The ISC conference takes place in Hamburg.", "She published under a pseudonym.",
    "The council is governed by the mayor.", "The damage is covered by the insurance.", "Food was distributed under the bridge.", "The Apache server was released in version 2.0.", "Mozilla made a browser available to the public.", "The commons are shared fields.",
    "The clause was struck from the contract.", "Use of this road is governed by the law.", "MIT is a university.", "The attribution of the painting is disputed.", "Public license plates are blue.", "The universal joint is 4.0 inches long.", "An international license is needed to drive abroad.", "He waived his rights.",
]
# fixed value: words too common to be features on their own
STOP = frozenset(
    "a an and are as at available be by can code covered do any all file following for form free from governed in is it its made may new no not of on or part person project published that the this to under use was were with without work you your distributed".split()
)
_FILL = "house river stone market paper winter garden simple rapid green seven under of the in and for by with this".split()


def words_of(text: str) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split(" ") if w]


def features_of(words: list[str]) -> set[str]:
    """Content words and pairs of neighbours with at least one content word, or that tie or negate."""
    pairs = {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}
    pairs = {x for x in pairs if x in CONTEXT or x in NEGATIONS or any(w not in STOP for w in x.split())}
    return {w for w in words if w not in STOP} | pairs


def _variants(text: str, rng: np.random.Generator, n: int) -> list[set[str]]:
    """The notice with words around it and some of its own left out."""
    base, out = words_of(text), []
    for k in range(n):
        drop = 0.0 if k % 3 else 0.08
        own = [w for w in base if rng.random() >= drop]
        around = [list(rng.choice(_FILL, rng.integers(0, 6))) for _ in range(2)]
        out.append(features_of(around[0] + own + around[1]))
    return out


def sentences(held: bool) -> list[tuple[str, list[str]]]:
    """(class, texts): to train on, or those of the patterns and plain sentences that are held out."""
    pick = lambda xs: [x for k, x in enumerate(xs) if (k % 4 == 3) == held]
    out = [("unknown", pick(OTHER))]
    for family in dict.fromkeys([*NOTICES, *NAMES]):
        out.append((family, ([] if held else NOTICES.get(family, [])) + [p.format(x) for x in NAMES.get(family, []) for p in pick(PATTERNS)]))
    return out


@lru_cache(maxsize=1)
def model() -> tuple[list[str], dict[str, list[int]], list[int], float]:
    """(classes, unknown first; weights by feature; biases; least probability), whole thousandths."""
    rng = np.random.default_rng(11)
    known = sentences(held=False)
    classes = [c for c, _ in known]
    vocabulary = {f for c, texts in known[1:] for t in texts for f in features_of(words_of(t))}
    # a name may end beside any word; what the templates name counts, and no other pair of held-out patterns
    vocabulary |= {f for _, _, f, _, _, _ in notice_pairs()} | set(NEGATIONS)
    vocabulary = sorted(vocabulary)
    place = {f: i for i, f in enumerate(vocabulary)}

    def sample(told: list[tuple[str, list[str]]]):
        rows, labels = [], []
        for label, (_, texts) in enumerate(told):
            for t in texts:
                for found in _variants(t, rng, VARIANTS if t not in made else MADE_VARIANTS):
                    row = np.zeros(len(place), np.float32)
                    row[[place[f] for f in found if f in place]] = 1
                    rows.append(row)
                    labels.append(label)
        return np.array(rows), np.array(labels)

    made = {p.format(x) for names in NAMES.values() for x in names for p in PATTERNS}
    x, y = sample(known)
    held_x, held_y = sample(sentences(held=True))
    w, b, goal = np.zeros((len(place), len(classes)), np.float32), np.zeros(len(classes), np.float32), np.eye(len(classes), dtype=np.float32)[y]
    b[0] = 2.0  # a line without features is unknown
    for _ in range(1000):
        p = _softmax(x @ w + b)
        w -= 2.0 * (x.T @ (p - goal) / len(x) + 1e-4 * w)
        b[1:] -= 2.0 * (p - goal).mean(0)[1:]
    weights, bias = np.rint(w * SCALE).astype(int), np.rint(b * SCALE).astype(int)
    p = _softmax((held_x @ weights + bias) / SCALE)
    best, top = p[:, 1:].argmax(1) + 1, p[:, 1:].max(1)
    # the least probability of which 98 % of the held-out claims are right
    sure = top[best != held_y]
    claims = lambda least: (top >= least).sum()
    least = next((x for x in np.arange(0.1, 0.95, 0.01) if (sure >= x).sum() <= 0.02 * claims(x)), 0.95)
    return classes, {f: weights[i].tolist() for f, i in place.items()}, bias.tolist(), float(np.round(least, 2))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def notice_pairs() -> list[tuple[int, str, str, int, int, int]]:
    """(number, family, word pair, pairs in the template, whether this one is needed, what the template is:
    0 a name, 1 a name beside another, 2 a notice) for the template comparison."""
    told = [(f, t, None) for f, texts in NOTICES.items() for t in texts] + [(f, t.format(x), t) for f, names in NAMES.items() for x in names for t in [*TEMPLATES, *JOINED]]
    out, seen = [], set()
    for family, text, template in told:
        pairs = tuple(sorted({f for f in features_of(words_of(text)) if " " in f}))
        if pairs and (family, pairs) not in seen:
            seen.add((family, pairs))
            needed = [p for p in pairs if template or any(c.isdigit() for c in p)]
            out += [(len(seen), family, p, len(pairs), int(p in needed), 2 if template is None else int(template in JOINED)) for p in pairs]
    return out


def rules_against() -> list[tuple[str, int, int]]:
    """(word pair, class, weight): names that go on as another family's name, and negations for all."""
    classes = model()[0]
    names = [(f, words_of(x)) for f, own in NAMES.items() for x in own]
    goes_on = {(f"{a[-1]} {b[len(a)]}", f) for f, a in names for g, b in names if f != g and len(b) > len(a) and b[: len(a)] == a}
    return [(pair, classes.index(f), -AGAINST) for pair, f in sorted(goes_on)] + [(pair, 0, AGAINST) for pair in NEGATIONS]


def content_words() -> list[str]:
    return sorted({f for f in model()[1] if " " not in f})


def _quoted(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def weight_rows() -> list[tuple[str, int, int]]:
    return [(f, c, w) for f, row in model()[1].items() for c, w in enumerate(row) if w] + rules_against()


def _words(line: Column) -> Column:
    return F.split(F.lower(line), "[^a-z0-9]+")


def _paragraphs(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, h, pos, end and w (words): the lines that hold a content word (end is pos), and the
    groups of neighbouring lines pos to end over which a notice can be wrapped.

    Every line of a group has a word; the lines between its first and last have as many words as a
    notice can have, and of the first and last as many count, next to the others. First and last
    line hold a content word or stand beside a line that does.
    """
    most = max(len(words_of(t)) for texts in NOTICES.values() for t in texts) + SLACK
    content = F.array(*map(F.lit, content_words()))
    lines = F.transform(F.split(F.col(text), "\n"), lambda x: F.filter(_words(x), lambda y: y != ""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.explode(F.array(lines)).alias("all"))
    good = F.transform("all", lambda w: F.arrays_overlap(w, content))
    rows = rows.select("*", F.explode(F.array(good)).alias("good")).where(F.exists("good", lambda x: x))
    near = lambda i: F.coalesce(F.get("good", i), F.lit(False)) | F.coalesce(F.get("good", i + 1), F.lit(False))
    starts = F.filter(F.transform("all", lambda w, i: F.when(near(i), F.struct(i.alias("pos"), F.get("good", i).alias("own"), F.slice("all", i + 1, most + 2).alias("w"), F.slice("good", i + 1, most + 2).alias("good")))), lambda x: x.isNotNull())
    starts = rows.select("doc_id", "h", F.inline(starts))
    lone = starts.where("own").select("doc_id", "h", "pos", F.col("pos").alias("end"), F.col("w")[0].alias("w"))

    first = F.slice(F.col("w")[0], F.greatest(F.size(F.col("w")[0]) - most + 1, F.lit(1)), F.lit(most))
    rest = F.transform(F.slice("w", 2, most + 1), lambda w: F.slice(w, 1, most + 1))
    several = starts.where("size(w) > 1").select("doc_id", "h", "pos", "good", F.explode(F.array(first)).alias("first"), F.col("w")).where("size(first) > 0")
    several = several.select("doc_id", "h", "pos", "good", "first", F.explode(F.array(rest)).alias("rest"))
    several = several.select("*", F.explode(F.sequence(F.lit(1), F.size("rest"))).alias("k"))
    between = F.aggregate(F.slice("rest", F.lit(1), F.col("k") - 1), F.lit(0), lambda n, w: n + F.size(w))
    full = F.forall(F.slice("rest", F.lit(1), F.col("k")), lambda w: F.size(w) > 0)
    ends = F.get("good", F.col("k")) | F.get("good", F.col("k") - 1)
    several = several.where(ends & full & (between <= most))
    group = F.concat("first", F.flatten(F.slice("rest", F.lit(1), F.col("k") - 1)), F.slice(F.get("rest", F.col("k") - 1), 1, most))
    return lone.union(several.select("doc_id", "h", "pos", (F.col("pos") + F.col("k")).alias("end"), group.alias("w")))


def license_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), pos, end, family and confirmed: every line (end is pos) and
    every group of lines pos to end that has a feature, a row for each of its families.

    The best family is unknown where none reaches the least probability; others count that a
    template names there. Letters count in lower case.
    """
    spark = docs.sparkSession
    classes, features, bias, least = model()
    words = _paragraphs(docs, doc_id, text).select("doc_id", "h", "pos", "end", F.explode(F.array("w")).alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat(F.get("w", i), F.lit(" "), F.get("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    # a paragraph is its features once: repeated rows of one document meet here
    key = ["doc_id", "h", "pos", "end"]
    known = spark.sql(f"SELECT * FROM VALUES {_quoted([(f,) for f in sorted({*features, *(f for f, _, _ in rules_against())})])} AS t(f)")
    grams = words.select(*key, F.explode(F.array_distinct(F.concat("w", pairs))).alias("f")).join(F.broadcast(known), "f")
    weights = spark.sql(f"SELECT * FROM VALUES {_quoted(weight_rows())} AS t(f, c, v)")
    notices = spark.sql(f"SELECT * FROM VALUES {_quoted(notice_pairs())} AS t(k, family, f, of, need, joined)")
    grams = grams.distinct()
    hits = grams.join(F.broadcast(weights), "f")
    sums = hits.groupBy(*key).agg(*(F.coalesce(F.sum(F.when(F.col("c") == k, F.col("v"))), F.lit(0)).alias(f"s{k}") for k in range(len(classes))))
    score = [F.col(f"s{k}") + bias[k] for k in range(len(classes))]
    top = F.greatest(*score)
    family = F.greatest(*score[1:])
    share = F.exp((family - top) / SCALE) / sum((F.exp((s - top) / SCALE) for s in score), F.lit(0.0))
    best = F.coalesce(*(F.when(s == family, F.lit(c)) for s, c in zip(score[1:], classes[1:], strict=True)))
    alone = [F.when(s - score[0] >= -AGAINST // 2, F.lit(c)) for s, c in zip(score[1:], classes[1:], strict=True)]
    scored = sums.select(*key, F.when(share >= least, best).otherwise(F.lit("unknown")).alias("best"), F.array_compact(F.array(*alone)).alias("alone"))
    held = grams.join(F.broadcast(notices), "f").groupBy(*key, "k", "family").agg(F.count("*").alias("n"), F.max("of").alias("of"), F.sum("need").alias("needed"), F.max("joined").alias("joined"))
    needs = spark.sql(f"SELECT * FROM VALUES {_quoted(_needs())} AS t(k, needs)")
    held = held.join(F.broadcast(needs), "k").where((100 * F.col("n") >= CONFIRM * F.col("of")) & (F.col("needed") == F.col("needs")))
    held = held.groupBy(*key).agg(F.count_if(F.col("joined") != 1).alias("tied"), F.collect_set(F.when(F.col("joined") < 2, F.col("family"))).alias("names"), F.collect_set("family").alias("templates"))
    held = held.where("tied > 0").select(*(F.col(x).alias(f"{x}_") for x in key), "names", "templates")
    none = F.array().cast("array<string>")
    both = scored.join(held, [F.col(x).eqNullSafe(F.col(f"{x}_")) for x in key], "left").withColumns({c: F.coalesce(c, none) for c in ("names", "templates")})
    more = F.when(F.col("best") == "unknown", F.array("best")).otherwise(F.array_union(F.array("best"), F.array_intersect("names", "alone")))
    return both.select(*key, "templates", F.explode(more).alias("family")).select(*key, "family", F.array_contains("templates", F.col("family")).alias("confirmed"))


def _needs() -> list[tuple[int, int]]:
    found: dict[int, int] = {}
    for k, _, _, _, need, _ in notice_pairs():
        found[k] = found.get(k, 0) + need
    return list(found.items())


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, licenses, n_license_lines and n_unconfirmed for every row of docs.

    licenses: the families of confirmed lines and groups of lines, sorted, joined by commas; empty
    if none. A group counts if no confirmed line and no smaller confirmed group of its family lies
    in it. n_license_lines: confirmed lines and lines of such groups. n_unconfirmed: other lines
    that a family claims but no notice confirms. A null or empty text has none.
    Rows that agree in id and text share their result; other columns play no part; an empty table
    gives an empty result.
    """
    found = license_lines(docs.where(F.col(text).isNotNull()), doc_id, text).where("family <> 'unknown' AND (confirmed OR pos = end)")
    found = found.groupBy("doc_id", "h", "family").agg(F.collect_set(F.when(F.col("confirmed"), F.struct("pos", "end"))).alias("ok"), F.collect_set(F.when(~F.col("confirmed"), F.col("pos"))).alias("open"))
    # only the last group of each first line that ends before all later groups end holds no other
    least = F.aggregate(
        F.sort_array(F.transform("ok", lambda x: F.struct((-x["pos"]).alias("back"), x["end"].alias("end")))),
        F.array().cast("array<struct<back:int,end:int>>"),
        lambda done, x: F.when((F.size(done) == 0) | (x["end"] < F.try_element_at(done, F.lit(-1))["end"]), F.concat(done, F.array(x))).otherwise(done),
    )
    least = F.array_distinct(F.flatten(F.transform(least, lambda x: F.sequence(-x["back"], x["end"]))))
    found = found.select("doc_id", "h", "family", F.explode(F.array(least)).alias("in"), "open")
    found = found.select("doc_id", "h", "family", F.explode(F.concat(F.transform("in", lambda p: F.struct(p.alias("pos"), F.lit(True).alias("confirmed"))), F.transform(F.array_except("open", "in"), lambda p: F.struct(p.alias("pos"), F.lit(False).alias("confirmed"))))).alias("x")).select("doc_id", "h", "family", "x.*")
    # a line counts once, as confirmed if any family is
    lines = found.groupBy("doc_id", "h", "pos").agg(F.max("confirmed").alias("confirmed"), F.collect_set(F.when(F.col("confirmed"), F.col("family"))).alias("families"))
    by_text = lines.groupBy(F.col("doc_id").alias("id_"), F.col("h").alias("h_")).agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))), ",").alias("licenses"),
        F.count_if("confirmed").alias("n_license_lines"),
        F.count_if(~F.col("confirmed")).alias("n_unconfirmed"),
    )
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("h"))
    out = rows.join(by_text, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("h") == F.col("h_")), "left")
    return out.select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("n_license_lines", F.lit(0)).alias("n_license_lines"), F.coalesce("n_unconfirmed", F.lit(0)).alias("n_unconfirmed"))


def licenses_sql() -> str:
    classes, _, bias, least = model()
    score = [f"sum(CASE WHEN c = {k} THEN v ELSE 0 END) + {bias[k]}" for k in range(len(classes))]
    names = ", ".join(f"{s} AS s{k}" for k, s in enumerate(score))
    top = f"greatest({', '.join(f's{k}' for k in range(len(classes)))})"
    family = f"greatest({', '.join(f's{k}' for k in range(1, len(classes)))})"
    best = "CASE " + " ".join(f"WHEN s{k} = y THEN '{c}'" for k, c in enumerate(classes) if k) + " END"
    total = " + ".join(f"exp((s{k} - m) / {SCALE}.0::DOUBLE)" for k in range(len(classes)))
    alone = ", ".join(f"CASE WHEN s{k} - s0 >= {-AGAINST // 2} THEN '{c}' END" for k, c in enumerate(classes) if k)
    return f"""
WITH weight(f, c, v) AS (VALUES {_quoted(weight_rows())}),
pair(k, family, f, size, need, joined) AS (VALUES {_quoted(notice_pairs())}),
notice AS (SELECT *, sum(need) OVER (PARTITION BY k) AS needs FROM pair),
l AS (SELECT doc_id, unnest(range(len(p))) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents) x),
w AS (SELECT doc_id, pos, regexp_extract_all(lower(line), '[a-z0-9]+') AS w FROM l),
g AS (SELECT doc_id, pos, unnest(list_distinct(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])))) AS f FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, pos, {names} FROM g JOIN weight USING (f) GROUP BY doc_id, pos),
m AS (SELECT *, {top} AS m, {family} AS y FROM s),
named AS (SELECT doc_id, pos, CASE WHEN exp((y - m) / {SCALE}.0::DOUBLE) / ({total}) >= {least} THEN {best} ELSE 'unknown' END AS best, [{alone}] AS alone FROM m),
t AS (SELECT doc_id, pos, k, family, max(joined) AS kind FROM g JOIN notice USING (f) GROUP BY doc_id, pos, k, family
      HAVING 100 * count(*) >= {CONFIRM} * max(size) AND sum(need) = max(needs)),
held AS (SELECT doc_id, pos, list(DISTINCT family) AS templates, coalesce(list(DISTINCT family) FILTER (WHERE kind < 2), []) AS names FROM t GROUP BY doc_id, pos HAVING count(*) FILTER (WHERE kind <> 1) > 0),
r AS (SELECT n.doc_id, n.pos, family, list_contains(coalesce(templates, []), family) AS ok FROM (
  SELECT n.doc_id, n.pos, templates, unnest(list_distinct(list_concat([best], list_intersect(coalesce(names, []), alone)))) AS family
  FROM named n LEFT JOIN held h ON h.doc_id = n.doc_id AND h.pos = n.pos WHERE best <> 'unknown') n),
d AS (SELECT doc_id, coalesce(array_to_string(list_sort(list(DISTINCT family) FILTER (WHERE ok)), ','), '') AS licenses, count(DISTINCT pos) FILTER (WHERE ok) AS a,
             count(DISTINCT pos) - count(DISTINCT pos) FILTER (WHERE ok) AS b FROM r GROUP BY doc_id)
SELECT x.doc_id, coalesce(licenses, '') AS licenses, coalesce(a, 0)::BIGINT AS n_license_lines, coalesce(b, 0)::BIGINT AS n_unconfirmed
FROM documents x LEFT JOIN d ON d.doc_id = x.doc_id
"""
