"""License detection by ordered signature rules.

Texts are reduced to lower-case words joined by one space. A rule is a regular
expression with keywords and a priority: a license's name in some form, or a sentence of
its text. What a rule can match is a finite list of phrases; of each the longest word is a
keyword, and a rule is only tried on texts that have one of its keywords among their
words, which no match can lack. Where detections overlap, one that lies inside another of higher priority, or
of the same priority and more length, is suppressed. Four base phrases are counted
apart, on the words themselves, and their labels always stay.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text

#: Phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: A license's label and how its name is written, as a regular
#: expression over words with a space between.
NAMES = {
    "gpl": "(gnu )?(general public licen[sc]e|gpl)",
    "gpl-2.0": "(gnu )?(general public licen[sc]e|gpl) (version |v)?2( 0)?",
    "gpl-3.0": "(gnu )?(general public licen[sc]e|gpl) (version |v)?3( 0)?",
    "lgpl": "(gnu )?(lesser general public licen[sc]e|library general public licen[sc]e|lgpl)",
    "lgpl-2.1": "(gnu )?(lesser general public licen[sc]e|lgpl) (version |v)?2 1",
    "lgpl-3.0": "(gnu )?(lesser general public licen[sc]e|lgpl) (version |v)?3( 0)?",
    "agpl": "(gnu )?(affero general public licen[sc]e|agpl)",
    "agpl-3.0": "(gnu )?(affero general public licen[sc]e|agpl) (version |v)?3( 0)?",
    "fdl": "(gnu )?(free documentation licen[sc]e|fdl|gfdl)",
    "apache": "apache( software)?( licen[sc]e)?",
    "apache-1.1": "apache( software)?( licen[sc]e)? (version |v)?1 1",
    "apache-2.0": "apache( software)?( licen[sc]e)? (version |v)?2( 0)?",
    "mit": "(mit|expat|x11)( licen[sc]e)?",
    "mit-0": "mit no attribution",
    "bsd": "bsd( style)?( licen[sc]e)?",
    "bsd-2-clause": "((simplified|freebsd) bsd|bsd 2 clause|2 clause bsd)( licen[sc]e)?",
    "bsd-3-clause": "((new|modified|revised) bsd|bsd 3 clause|3 clause bsd)( licen[sc]e)?",
    "bsd-4-clause": "((original|old) bsd|bsd 4 clause|4 clause bsd)( licen[sc]e)?",
    "0bsd": "(0bsd|zero clause bsd)( licen[sc]e)?",
    "isc": "(isc|internet systems consortium)( licen[sc]e)?",
    "mpl": "(mozilla public licen[sc]e|mpl)",
    "mpl-1.1": "(mozilla public licen[sc]e|mpl) (version |v)?1 1",
    "mpl-2.0": "(mozilla public licen[sc]e|mpl) (version |v)?2( 0)?",
    "epl": "(eclipse public licen[sc]e|epl)",
    "epl-1.0": "(eclipse public licen[sc]e|epl) (version |v)?1( 0)?",
    "epl-2.0": "(eclipse public licen[sc]e|epl) (version |v)?2( 0)?",
    "eupl": "(european union public licen[sc]e|eupl)",
    "cddl": "(common development and distribution licen[sc]e|cddl)",
    "cpl": "(common public licen[sc]e|cpl)",
    "artistic": "(perl )?artistic licen[sc]e",
    "artistic-2.0": "(perl )?artistic licen[sc]e (version |v)?2( 0)?",
    "zlib": "(zlib|zlib libpng)( licen[sc]e)?",
    "libpng": "(libpng|png reference library)( licen[sc]e)?",
    "boost": "(boost software licen[sc]e|bsl 1 0)",
    "python": "(python software foundation licen[sc]e|psf licen[sc]e|python licen[sc]e)",
    "postgresql": "(postgresql|postgres)( licen[sc]e)",
    "openssl": "openssl( licen[sc]e)",
    "php": "php licen[sc]e",
    "ruby": "ruby licen[sc]e",
    "ofl": "(sil )?(open font licen[sc]e|ofl)",
    "unlicense": "(the )?unlicense",
    "wtfpl": "(wtfpl|do what the fuck you want to public licen[sc]e)",
    "beerware": "beer ?ware( licen[sc]e)?",
    "ms-pl": "(microsoft public licen[sc]e|ms pl)",
    "ms-rl": "(microsoft reciprocal licen[sc]e|ms rl)",
    "odbl": "(open database licen[sc]e|open data commons open database licen[sc]e|odbl)",
    "odc-by": "(open data commons attribution licen[sc]e|odc by)",
    "pddl": "(public domain dedication and licen[sc]e|pddl)",
    "cc0": "(cc0|cc zero|creative commons zero)( 1 0)?( universal)?",
    "cc-by": "(cc by|creative commons attribution)( [1-4] [05])?( international| unported)?( licen[sc]e)?",
    "cc-by-sa": "(cc by sa|creative commons attribution share ?alike)( [1-4] [05])?( international| unported)?( licen[sc]e)?",
    "cc-by-nc": "(cc by nc|creative commons attribution non ?commercial)( [1-4] [05])?( international| unported)?( licen[sc]e)?",
    "cc-by-nd": "(cc by nd|creative commons attribution no ?deriv(ative)?s)( [1-4] [05])?( international| unported)?( licen[sc]e)?",
    "cc-by-nc-sa": "(cc by nc sa|creative commons attribution non ?commercial share ?alike)( [1-4] [05])?( international| unported)?( licen[sc]e)?",
    "cc-by-nc-nd": "(cc by nc nd|creative commons attribution non ?commercial no ?deriv(ative)?s)( [1-4] [05])?( international| unported)?( licen[sc]e)?",
    "public-domain": "public domain( dedication)?",
    "proprietary": "(proprietary|commercial) licen[sc]e( agreement)?",
    "openrail": "(creativeml )?open ?rail( m)?( licen[sc]e)?",
}

#: What stands around a name, and its priority; {} is the name.
FORMS = (
    ("spdx license identifier {}", 4),
    ("(re)?licen[sc]ed( to you)? under( either)?( the)?( terms of)?( the)? {}", 3),
    ("(released|distributed|published|available|provided|covered|governed)( to you)? (under|by)( either)?( the)?( terms of)?( the)? {}", 3),
    ("(see|read)( the)? {} for( more)? details", 2),
    ("{}", 1),
)

#: Sentences of license texts and notices, as regular expressions over words.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "(the )?above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "to permit persons to whom the software is furnished to do so the software is provided as is"),
    ("x11", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-2-clause", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd-3-clause", "neither the name of (the |its )?[a-z0-9]+( [a-z0-9]+)? nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("isc", "permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("apache-2.0", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", "terms and conditions for use reproduction and distribution"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("gpl-2.0", "gnu general public licen[sc]e as published by the free software foundation either version 2"),
    ("gpl-3.0", "gnu general public licen[sc]e as published by the free software foundation either version 3"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public licen[sc]e"),
    ("lgpl-2.1", "gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1"),
    ("lgpl-3.0", "gnu lesser general public licen[sc]e as published by the free software foundation either version 3"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e"),
    ("agpl-3.0", "gnu affero general public licen[sc]e as published by the free software foundation either version 3"),
    ("fdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e"),
    ("mpl-1.1", "the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("eupl", "licen[sc]ed under the eupl version [0-9]+( [0-9]+)? or as soon they will be approved by the european commission"),
    ("artistic", "the intent of this document is to state the conditions under which a package may be copied"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ofl", "this font software is licen[sc]ed under the sil open font licen[sc]e"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed"),
    ("beerware", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("cc0", "to the extent possible under law .{1,60} (has|have) waived all copyright and related or neighboring rights"),
    ("cc-by", "this work is licen[sc]ed under a creative commons attribution [1-4] 0 international licen[sc]e"),
    ("cc-by-sa", "this work is licen[sc]ed under a creative commons attribution share ?alike [1-4] 0 international licen[sc]e"),
    ("cc-by-nc", "this work is licen[sc]ed under a creative commons attribution non ?commercial [1-4] 0 international licen[sc]e"),
    ("proprietary", "all rights reserved (unauthori[sz]ed|no part of) .{0,40}(copying|reproduced|reproduction|distribution)"),
    ("proprietary", "this software is (confidential and )?proprietary (information|property) of"),
)
SENTENCE_PRIORITY = 4


def expanded(pattern: str) -> list[str]:
    """Every string that a pattern of letters, groups, alternatives, character classes and
    optional parts matches; what it writes with repetition counts or dots stands as \0."""

    def alternatives(at: int) -> tuple[list[str], int]:
        every, parts = [], []
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                every += map("".join, product(*parts))
                parts, at = [], at + 1
                continue
            if pattern[at] == "(":
                part, at = alternatives(at + 1)
                at += 1
            elif pattern[at] == "[":
                end = pattern.index("]", at)
                inside = pattern[at + 1 : end]
                part, at = [f"{inside[k]}" for k in range(len(inside))] if "-" not in inside else ["\0"], end + 1
            else:
                part, at = ["\0" if pattern[at] == "." else pattern[at]], at + 1
            if pattern[at : at + 1] == "?":
                part, at = [*part, ""], at + 1
            elif pattern[at : at + 1] == "+":
                at += 1
            elif pattern[at : at + 1] == "{":
                part, at = ["\0", ""], pattern.index("}", at) + 1
            parts.append(part)
        every += map("".join, product(*parts))
        return every, at

    return list(dict.fromkeys(alternatives(0)[0]))


def longest_words(pattern: str) -> tuple[str, ...]:
    """Of each string that a pattern matches its longest word, the first of those."""
    out = {max((w for w in x.split() if "\0" not in w), key=len, default="") for x in expanded(pattern)}
    return tuple(sorted(out))


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keywords: tuple[str, ...]
    context: tuple[str, ...]
    priority: int


def rules() -> list[Rule]:
    """Every name in every form and all sentences, highest priority first."""
    out = []
    for label, name in NAMES.items():
        keywords = longest_words(name)
        for form, priority in FORMS:
            context = () if form == "{}" else longest_words(form.replace("{}", ""))
            # by itself a name has to say that it is a license
            written = name if context else name.replace("( licen[sc]e)?", "( licen[sc]e)")
            out.append(Rule(label, f"(?<= ){form.format(written)}(?= )", keywords if context else longest_words(written), context, priority))
    for label, sentence in SENTENCES:
        out.append(Rule(label, f"(?<= ){sentence}(?= )", longest_words(sentence), (), SENTENCE_PRIORITY))
    return sorted(out, key=lambda r: -r.priority)


#: Not a word: all ASCII but letters and digits.
APART = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _words(text: Column) -> Column:
    # lower() also lowers letters beyond ASCII; these stay word characters, and the one
    # that turns into an ASCII letter turns into k, which no base phrase has
    return F.array_remove(F.split(F.lower(text), APART), "")


def _base_places(phrase: str) -> str:
    parts = phrase.split()
    test = " and ".join(f"get(_w, i + {k}) = '{p}'" for k, p in enumerate(parts))
    held = " and ".join(f"array_contains(_k, '{p}')" for p in parts)
    return f"if({held}, filter(sequence(0, size(_w) - 1), i -> {test}), cast(array() as array<int>))"


def _quoted(words) -> str:
    return f"array({', '.join(repr(w) for w in words)})"


def _rule_table(every: list[Rule]) -> str:
    return "array(" + ", ".join(
        f"named_struct('label', '{r.label}', 'pattern', '{r.pattern}', 'keywords', {_quoted(r.keywords)}, 'context', {_quoted(r.context or ('',))}, 'priority', {r.priority}, 'rank', {i})"
        for i, r in enumerate(every)
    ) + ")"


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, detections``.

    ``detections`` are (start, end, label, priority), in characters of the reduced text,
    without the suppressed ones. ``score`` is 0 without any label, else a quarter of the
    highest priority kept, a base phrase counting as 2. A null text is empty: no words,
    no labels (empty strings), null positions. Repeated rows are scanned each for itself.

    Suppression runs as window functions over the detections of a row, sorted by start:
    one lies inside an earlier one if some end so far reaches as far as its own.
    """
    every = rules()
    names = {k for r in every for k in r.keywords}
    known = names.union(*(r.context for r in every), *(p.split() for p in BASE))
    rows = docs.select("doc_id", _words(whole_text()).alias("_w"), F.monotonically_increasing_id().alias("_row"))
    # "" stands for the context of rules that need none
    rows = rows.withColumn("_k", F.expr(f"array_append(array_intersect(_w, {_quoted(sorted(known))}), '')"))
    rows = rows.withColumn("_n", F.expr("if(size(_k) > 1, concat(' ', array_join(_w, ' '), ' '), '')"))
    hits = f"""if(arrays_overlap(_k, {_quoted(sorted(names))}),
        filter({_rule_table(every)}, r -> arrays_overlap(r.context, _k) and arrays_overlap(r.keywords, _k)),
        array())"""
    # What a pattern matches and what stands between give the places of its matches.
    found = rows.withColumn("_r", F.expr(hits)).withColumn(
        "_m",
        F.expr(
            """filter(transform(_r, r -> named_struct('r', r,
                 'm', transform(regexp_extract_all(_n, r.pattern, 0), x -> char_length(x)),
                 'g', transform(split(_n, r.pattern), x -> char_length(x)))), x -> size(x.m) > 0)"""
        ),
    )
    spans = F.expr(
        """flatten(transform(_m, x -> transform(sequence(1, size(x.m)), j -> named_struct(
             'start', aggregate(slice(x.g, 1, j), 0, (a, b) -> a + b) + aggregate(slice(x.m, 1, j - 1), 0, (a, b) -> a + b),
             'length', x.m[j - 1], 'label', x.r.label, 'priority', x.r.priority, 'rank', x.r.rank))))"""
    )
    base = {label: F.expr(_base_places(phrase)) for phrase, label in BASE.items()}
    slim = found.withColumns({f"_b{i}": b for i, b in enumerate(base.values())}).select(
        "_row",
        "doc_id",
        F.size("_w").cast("long").alias("n_words"),
        F.concat(*[f"_b{i}" for i in range(len(base))]).alias("_at"),
        F.array_compact(
            F.array(*[F.when(F.size(f"_b{i}") > 0, F.lit(label)) for i, label in enumerate(base)])
        ).alias("_base"),
        F.explode_outer(F.when(F.size("_m") > 0, spans)).alias("d"),
    )
    end = F.col("d.start") + F.col("d.length")
    before = Window.partitionBy("_row").orderBy(
        F.col("d.start"), end.desc(), F.col("d.priority").desc(), F.col("d.rank")
    ).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for level in sorted({r.priority for r in every}):
        reached = F.max(F.when(F.col("d.priority") >= level, end)).over(before)
        inside = inside | ((F.col("d.priority") == level) & (reached >= end))
    kept = slim.withColumn("_out", F.coalesce(inside, F.lit(False)))
    good = F.when(F.col("d").isNotNull() & ~F.col("_out"), F.struct(F.col("d.start").alias("start"), end.alias("end"), F.col("d.label").alias("label"), F.col("d.priority").alias("priority")))
    whole = kept.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.first("_at").alias("_at"),
        F.first("_base").alias("_base"),
        F.sort_array(F.collect_list(good)).alias("detections"),
    )
    labels = F.array_sort(F.array_distinct(F.concat("_base", F.col("detections.label"))))
    strength = F.greatest(
        F.coalesce(F.array_max(F.col("detections.priority")), F.lit(0)), F.when(F.size("_base") > 0, 2).otherwise(0)
    )
    return whole.select(
        "doc_id",
        "n_words",
        F.size("_at").cast("long").alias("n_base"),
        F.array_min("_at").cast("long").alias("first_word"),
        F.array_max("_at").cast("long").alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        (strength / F.lit(4.0)).alias("score"),
        "detections",
    )
