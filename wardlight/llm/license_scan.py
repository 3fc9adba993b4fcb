"""Sentence-rule licence recognition, in DataFrame functions alone.

Texts are normalised as a whole (lower case, runs of anything but letters and digits become one
separator), so that line wraps and comment marks do not matter. Known licence sentences are found
as leading parts of sentences; from LONG words on they count wherever they stand. The sequence of
identifiers found is then matched against ordered rules.

Null texts count as empty. A document without a known sentence gets an empty sequence and no
licence (null). Ties between rules go to the rule listed first. Rows that repeat a doc_id are
judged one by one; other columns are carried along, and a column of the input that shares a
name with a result is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.shared import text_or_empty

# Identifiers of known licence sentences and the sentences or their invariable part, normalised.
SENTENCES = {
    "apache-licensed": "licensed under the apache license version 2 0",
    "apache-may-not": "you may not use this file except in compliance with the license",
    "apache-copy-at": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "mit-released": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-retain": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-no-endorse": "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties",
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-no-warranty": "this program is distributed in the hope that it will be useful but without any warranty",
    "lgpl-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "mpl2-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "isc-permission": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc0": "has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "reserved": "all rights reserved",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "epl2-available": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "epl1-available": "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0",
    "cddl-subject": "the contents of this file are subject to the terms of the common development and distribution license",
    "spdx-apache": "spdx license identifier apache 2 0",
    "spdx-mit": "spdx license identifier mit",
    "spdx-bsd3": "spdx license identifier bsd 3 clause",
    "spdx-bsd2": "spdx license identifier bsd 2 clause",
    "spdx-isc": "spdx license identifier isc",
    "spdx-gpl2": "spdx license identifier gpl 2 0",
    "spdx-gpl3": "spdx license identifier gpl 3 0",
    "spdx-lgpl": "spdx license identifier lgpl",
    "spdx-agpl": "spdx license identifier agpl 3 0",
    "spdx-mpl2": "spdx license identifier mpl 2 0",
    "spdx-unlicense": "spdx license identifier unlicense",
    "spdx-cc0": "spdx license identifier cc0 1 0",
}

# Other forms of the same sentences.
VARIANTS = (
    ("apache-licensed", "the asf licenses this file to you under the apache license version 2 0"),
    ("bsd-as-is", "this software is provided by the regents and contributors as is and any express or implied warranties"),
    ("gpl-no-warranty", "this library is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("lgpl-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation"),
    ("isc-permission", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
)

# Fixed values: (licence, kind, identifiers that must follow one another in this order).
RULES = (
    ("Apache-2.0", "full", ("apache-licensed", "apache-may-not", "apache-copy-at", "apache-as-is")),
    ("Apache-2.0", "notice", ("apache-licensed",)),
    ("Apache-2.0", "notice", ("spdx-apache",)),
    ("BSD-3-Clause", "full", ("bsd-redistribution", "bsd-no-endorse", "bsd-as-is")),
    ("BSD-3-Clause", "notice", ("spdx-bsd3",)),
    ("BSD-2-Clause", "full", ("bsd-redistribution", "bsd-retain", "bsd-as-is")),
    ("BSD-2-Clause", "notice", ("spdx-bsd2",)),
    ("MIT", "full", ("mit-permission", "mit-as-is")),
    ("MIT", "notice", ("mit-released",)),
    ("MIT", "notice", ("mit-licensed",)),
    ("MIT", "notice", ("spdx-mit",)),
    ("LGPL", "full", ("lgpl-free", "gpl-no-warranty")),
    ("LGPL", "notice", ("spdx-lgpl",)),
    ("AGPL-3.0", "full", ("agpl-free", "gpl-no-warranty")),
    ("AGPL-3.0", "notice", ("spdx-agpl",)),
    ("GPL", "full", ("gpl-free", "gpl-no-warranty")),
    ("GPL-3.0", "notice", ("gpl3-work",)),
    ("GPL-3.0", "notice", ("spdx-gpl3",)),
    ("GPL-2.0", "notice", ("spdx-gpl2",)),
    ("MPL-2.0", "notice", ("mpl2-subject",)),
    ("MPL-2.0", "notice", ("spdx-mpl2",)),
    ("EPL-2.0", "notice", ("epl2-available",)),
    ("EPL-1.0", "notice", ("epl1-available",)),
    ("CDDL", "notice", ("cddl-subject",)),
    ("BSL-1.0", "full", ("bsl-grant", "mit-as-is")),
    ("Zlib", "full", ("zlib-as-is", "zlib-grant")),
    ("ISC", "full", ("isc-permission", "isc-as-is")),
    ("ISC", "full", ("isc-permission", "mit-as-is")),
    ("ISC", "notice", ("spdx-isc",)),
    ("CC-BY-NC-4.0", "notice", ("cc-by-nc",)),
    ("CC-BY-SA-4.0", "notice", ("cc-by-sa",)),
    ("CC-BY-4.0", "notice", ("cc-by",)),
    ("CC0-1.0", "notice", ("cc0",)),
    ("CC0-1.0", "notice", ("spdx-cc0",)),
    ("Unlicense", "full", ("unlicense",)),
    ("Unlicense", "notice", ("spdx-unlicense",)),
    ("proprietary", "notice", ("reserved",)),
)

#: A sentence starts at a line start (after comment marks), or after . ; : ! ? before white space.
SENTENCE_START = r"[\n\r\x0B\x0C\x01](?:[\x20\x09]*(?:dnl|@?rem)(?=[\x20\x09]))?|[.;:!?](?=[\x20\x09])"
#: Stands before the first word of a sentence; a blank stands before any other word.
MARK = "\x01"
#: Known sentences of so many words need not start a sentence: nothing else says them by chance.
LONG = 8
#: Only texts with such a word can hold a known sentence; every known sentence has one.
HINT = ("licen", "permission", "software", "redistribution", "program", "rights", "warranty")


def _known_pattern() -> str:
    """Known sentences between separators, those under LONG words after a mark."""
    separator = f"[\x20{MARK}]"
    short, long = [], []
    for sentence in [*SENTENCES.values(), *(v for _, v in VARIANTS)]:
        words = sentence.split()
        (long if len(words) >= LONG else short).append(separator.join(words))
    return f"(?<={separator})(?:{'|'.join(long)}|(?<={MARK})(?:{'|'.join(short)}))(?={separator})"


def license_columns(docs: DataFrame) -> DataFrame:
    """docs with license_sentences (identifiers in text order), licenses (all rules met, in rule order), license and license_kind."""
    known = F.create_map(*[F.lit(x) for pair in ((s, i) for i, s in (*SENTENCES.items(), *VARIANTS)) for x in pair])
    text = text_or_empty()
    hinted = reduce(lambda a, b: a | b, (F.contains(F.col("__low"), F.lit(h)) for h in HINT))
    rows = docs.withColumn("__low", F.lower(text))
    words = F.regexp_replace(F.concat(F.lit("\n"), "__low", F.lit("\n")), SENTENCE_START, MARK)
    words = F.regexp_replace(words, rf"[^\p{{L}}\p{{N}}{MARK}]+", " ")
    words = F.regexp_replace(words, f" ?{MARK}[ {MARK}]*", MARK)
    sentences = F.transform(F.regexp_extract_all(words, F.lit(_known_pattern()), F.lit(0)), lambda s: F.translate(s, MARK, " "))
    rows = rows.withColumn("__found", F.when(hinted, sentences).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("license_sentences", F.filter(F.transform("__found", lambda s: F.try_element_at(known, s)), lambda s: s.isNotNull()))
    sequence = F.concat(F.lit(" "), F.array_join("license_sentences", " "), F.lit(" "))
    rows = rows.withColumn("__sequence", sequence)
    met = F.array(
        *[
            F.when(
                F.contains(F.col("__sequence"), F.lit(f" {ids[0]} ")) & F.col("__sequence").rlike(" " + " (?:[^ ]+ )*".join(ids) + " "),
                F.struct(F.lit(name).alias("license"), F.lit(kind).alias("kind")),
            )
            for name, kind, ids in RULES
        ]
    )
    rows = rows.withColumn("__met", F.when(F.size("license_sentences") > 0, F.filter(met, lambda x: x.isNotNull())))
    return rows.withColumns(
        {
            "licenses": F.array_distinct(F.coalesce(F.transform("__met", lambda x: x["license"]), F.array().cast("array<string>"))),
            "license": F.get("__met", 0)["license"],
            "license_kind": F.get("__met", 0)["kind"],
        }
    ).drop("__low", "__found", "__sequence", "__met")
