"""Licence recognition by sentences.

A text is split into sentences; each is normalised and looked up among known
licence sentences. A sentence may run over lines, with comment signs before them,
and may follow text without a full stop: every run of whole lines is looked up, the
longest first. A line of comment signs alone is an empty line; an SPDX tag with one
identifier is a sentence of its own wherever it stands. What remains of a text is its sequence of sentence ids. Licence
rules are sequences of ids in a fixed order: the first rule that occurs takes its
sentences out of the sequence, then the next one looks at the rest. Known
sentences that no rule takes are counted, they stand for an unknown notice.

Null and empty texts have no licences. Every row is judged on its own, with
column functions only, so nothing is shuffled and no row depends on another.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- fixed values: licence names as they stand in notices, and sentences of the licences

NAMED = {
    "MIT": ("MIT License", "MIT licence", "The MIT License (MIT)", "Expat License"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0 License", "Apache 2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL version 2.1", "LGPLv2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL version 3", "LGPLv3"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPLv3"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "CC0-1.0": ("CC0 1.0", "Creative Commons Zero v1.0 Universal"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License, version 2.0", "Eclipse Public License v2.0"),
    "ISC": ("ISC License",),
    "Zlib": ("zlib License",),
}
#: More identifiers of SPDX tags.
IDENTIFIERS = (
    "0BSD", "AFL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Artistic-2.0", "BlueOak-1.0.0", "BSD-1-Clause",
    "BSD-3-Clause-Clear", "BSD-4-Clause", "CC-BY-3.0", "CC-BY-NC-SA-4.0", "CC-BY-SA-3.0", "CDDL-1.0", "CDDL-1.1", "ECL-2.0",
    "EPL-1.0", "EUPL-1.1", "EUPL-1.2", "GFDL-1.3-only", "GFDL-1.3-or-later", "GPL-1.0-or-later", "GPL-2.0-only",
    "GPL-2.0-or-later", "GPL-2.0+", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+", "LGPL-2.0-only", "LGPL-2.0-or-later",
    "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1+", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT-0", "MPL-1.1", "MS-PL",
    "MulanPSL-2.0", "NCSA", "OFL-1.1", "OSL-3.0", "PostgreSQL", "PSF-2.0", "Python-2.0", "Ruby", "Unicode-3.0", "Unlicense",
    "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "ZPL-2.1",
)
OPENINGS = ("Licensed under", "Released under", "This work is licensed under", "Distributed under")
SENTENCES = {
    "mit-grant": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated '
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mit-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software."
    ),
    "mit-as-is": (
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
    ),
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-as-is": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "gnu-free": "This program is free software:",
    "gpl-3-later": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "gpl-2-later": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer."
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "bsd-name": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."
    ),
    "gnu-library-free": "This library is free software;",
    "lgpl-2.1-later": (
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "lgpl-3-later": (
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "agpl-3-later": (
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mpl-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl-copy": (
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "mpl-copy-http": (
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "isc-grant-and": (
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "isc-as-is": (
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
        "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
    ),
    "0bsd-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted."
    ),
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions:"
    ),
    "boost-grant": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, '
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
        "to whom the Software is furnished to do so, all subject to the following:"
    ),
    "epl-2-terms": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
        "which is available at https://www.eclipse.org/legal/epl-2.0/"
    ),
}
#: (licence, ids in a row), longest evidence first; the notices that name a licence follow below.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-as-is")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("named Apache-2.0", "apache-comply", "apache-as-is")),
    ("Apache-2.0", ("named Apache-2.0", "apache-comply")),
    ("GPL-3.0-or-later", ("gnu-free", "gpl-3-later")),
    ("GPL-2.0-or-later", ("gnu-free", "gpl-2-later")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("LGPL-3.0-or-later", ("gnu-free", "lgpl-3-later")),
    ("LGPL-3.0-or-later", ("gnu-library-free", "lgpl-3-later")),
    ("LGPL-2.1-or-later", ("gnu-library-free", "lgpl-2.1-later")),
    ("AGPL-3.0-or-later", ("gnu-free", "agpl-3-later")),
    ("MPL-2.0", ("mpl-subject", "mpl-copy")),
    ("MPL-2.0", ("mpl-subject", "mpl-copy-http")),
    ("ISC", ("isc-grant", "isc-as-is")),
    ("ISC", ("isc-grant-and", "isc-as-is")),
    ("ISC", ("isc-grant",)),
    ("ISC", ("isc-grant-and",)),
    ("0BSD", ("0bsd-grant", "isc-as-is")),
    ("0BSD", ("0bsd-grant",)),
    ("Unlicense", ("unlicense-free", "unlicense-anyone")),
    ("Unlicense", ("unlicense-free",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("BSL-1.0", ("boost-grant",)),
    ("EPL-2.0", ("epl-2-terms",)),
]
#: Every known sentence has one of these.
MARKERS = r"(?i)licen|gpl|mpl|cc0|cc by|creative commons|permi|software|redistribut"

# ---- end of fixed values

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = "\x01"
SENTENCE_END = r"([.!?:;])[\t\n\f\r ]+"
BLANK_LINE = r"\n[\t\f\r ]*\n"

#: In columns, a line of comment signs alone counts as blank.
COMMENT_LINE = r"\n[\t\f\r #*/;%!<>-]*\n"
#: An SPDX tag with one identifier; an expression of several is left as it stands.
SPDX = r"(?i)(SPDX-License-Identifier:)[ \t]*+([a-z0-9.+-]++)(?![ \t]+(?:OR|AND|WITH)\b)"


def normal(text: str) -> str:
    """Lower case, words only, one spelling of licence; as ``normalised`` does in columns."""
    words = re.sub("[^a-z0-9+]+", " ", text.translate(str.maketrans(UPPER, LOWER))).strip()
    return words.replace("licence", "license")


def known_sentences() -> dict[str, str]:
    """Normalised sentence -> id. Sentences with an inner full stop or semicolon are known by their parts as well."""
    known = {}
    for name, texts in NAMED.items():
        for text in texts:
            for opening in OPENINGS:
                for words in (f"{opening} {text}", f"{opening} the {text}", f"{opening} the terms of the {text}"):
                    known[normal(words)] = f"named {name}"
            known[normal(f'Licensed under the {text} (the "License")')] = f"named {name}"
            known[normal(f"SPDX-License-Identifier: {name}")] = f"named {name}"
    for name in IDENTIFIERS:
        known[normal(f"SPDX-License-Identifier: {name}")] = f"named {name}"
    for key, text in SENTENCES.items():
        known[normal(text)] = key
        parts = [part for part in re.split(r"(?<=[.!?:;])\s+", text) if part]
        for number, part in enumerate(parts[1:], 1):
            known.setdefault(normal(part), f"{key} {number}")
        if len(parts) > 1:
            known.setdefault(normal(parts[0]), f"{key} 0")
    return known


def rules() -> list[tuple[str, tuple[str, ...]]]:
    parts = []
    for licence, ids in RULES:
        parts.append((licence, ids))
        # A long sentence may have come in its parts.
        split = []
        for key in ids:
            n = len([p for p in re.split(r"(?<=[.!?:;])\s+", SENTENCES.get(key, "")) if p])
            split += [f"{key} {i}" for i in range(n)] if n > 1 else [key]
        if tuple(split) != ids:
            parts.append((licence, tuple(split)))
    return parts + [(name, (f"named {name}",)) for name in (*NAMED, *IDENTIFIERS)]


def _coded(ids: tuple[str, ...]) -> str:
    return "".join(f"<{key}>" for key in ids)


def normalised_lines(text: Column) -> Column:
    """As ``normal``, but lines and breaks stay."""
    words = F.regexp_replace(F.translate(text, UPPER, LOWER), rf"[^a-z0-9+\n{BREAK}]+", " ")
    words = F.regexp_replace(words, " ?\n[ \n]*", "\n")
    words = F.regexp_replace(words, f"[ \n]*{BREAK}[ \n]*", BREAK)
    return F.replace(F.btrim(words, F.lit(" \n")), F.lit("licence"), F.lit("license"))


def _branches(sentences: list[list[str]], gap: str = r"[ \n]") -> str:
    """Pattern of word lists, factored by their first words; the longest is tried first."""
    ends = [] in sentences
    heads: dict[str, list[list[str]]] = {}
    for words in sentences:
        if words:
            heads.setdefault(words[0], []).append(words[1:])
    parts = [re.escape(head) + _branches(rest) for head, rest in heads.items()]
    if not parts:
        return ""
    return "(?:" + "|".join(gap + part for part in parts) + ")" + ("?" if ends else "")


def known_runs(known: dict[str, str]) -> str:
    """Pattern of every known sentence that fills whole lines."""
    heads = _branches([sentence.split(" ") for sentence in known], "")
    return rf"(?<![^\n{BREAK}]){heads}(?![^\n{BREAK}])"


def sentence_ids(text: Column) -> Column:
    """The known sentences of a text in their order, as one string of <id>s."""
    known = known_sentences()
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # One break for all kinds of ends, so that splitting needs no look-around.
    marked = F.regexp_replace(F.translate(text, BREAK, " "), SPDX, f"{BREAK}$1$2{BREAK}")
    marked = F.regexp_replace(F.regexp_replace(marked, COMMENT_LINE, BREAK), SENTENCE_END, f"$1{BREAK}")
    sentences = F.filter(F.split(marked, BREAK), lambda s: s.rlike(MARKERS))
    runs = F.regexp_extract_all(normalised_lines(F.array_join(sentences, BREAK)), F.lit(known_runs(known)), F.lit(0))
    found = F.transform(runs, lambda run: F.try_element_at(table, F.translate(run, "\n", " ")))
    return F.array_join(F.transform(found, lambda key: F.concat(F.lit("<"), key, F.lit(">"))), "")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licences (in the order of the rules, joined by commas), sentence ids and how many no rule took."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ordered = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_coded(ids)).alias("ids")) for name, ids in rules()])
    start = F.struct(F.col("sentence_ids").alias("rest"), F.array().cast("array<string>").alias("found"))

    def apply(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["ids"])
        return F.struct(
            F.replace(state["rest"], rule["ids"], F.lit("|")).alias("rest"),
            F.when(hit, F.array_append(state["found"], rule["name"])).otherwise(state["found"]).alias("found"),
        )

    matched = F.when(F.col("sentence_ids") != "", F.aggregate(ordered, start, apply))
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), sentence_ids(text).alias("sentence_ids"))
        .withColumn("matched", matched)
        .select(
            "doc_id",
            F.coalesce(F.array_join(F.array_distinct("matched.found"), ","), F.lit("")).alias("licences"),
            "sentence_ids",
            F.coalesce(F.length(F.translate("matched.rest", UPPER + LOWER + "0123456789 -.+|>", "")), F.lit(0))
            .cast("long")
            .alias("n_unmatched"),
        )
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def scan_sql() -> str:
    """The same for DuckDB: rules as a chain of replacements."""
    known = known_sentences()
    keys = "[" + ", ".join(map(_quoted, known)) + "]"
    ids = "[" + ", ".join(map(_quoted, known.values())) + "]"

    def norm(x: str) -> str:
        words = f"regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '[^a-z0-9+]+', ' ', 'g')"
        return f"replace(trim({words}, ' '), 'licence', 'license')"

    steps, last = [], "coded"
    for number, (name, sequence) in enumerate(rules()):
        code = _quoted(_coded(sequence))
        steps.append(
            f"r{number} AS (SELECT doc_id, sentence_ids, replace(rest, {code}, '|') AS rest, "
            f"CASE WHEN contains(rest, {code}) THEN list_append(found, {_quoted(name)}) ELSE found END AS found FROM {last})"
        )
        last = f"r{number}"
    return f"""
    WITH known AS (SELECT unnest({keys}) AS sentence, unnest({ids}) AS id),
    split AS (
      SELECT doc_id, unnest(range(len(parts))) AS n, unnest(parts) AS s FROM (
        SELECT doc_id, string_split(regexp_replace(regexp_replace(coalesce(text, ''), '{BLANK_LINE}', chr(1), 'g'),
                 '{SENTENCE_END}', '\\1' || chr(1), 'g'), chr(1)) AS parts FROM documents)),
    lines AS (
      SELECT doc_id, n, s, unnest(range(len(parts))) AS m, unnest(parts) AS line FROM (
        SELECT doc_id, n, s, string_split(s, chr(10)) AS parts FROM split WHERE regexp_matches(s, '{MARKERS}'))),
    found AS (
      SELECT doc_id, n, m, CASE WHEN w.id IS NULL THEN l.id WHEN m = 0 THEN w.id END AS id
      FROM lines LEFT JOIN known w ON w.sentence = {norm('s')} LEFT JOIN known l ON l.sentence = {norm('line')}),
    joined AS (SELECT doc_id, string_agg('<' || id || '>', '' ORDER BY n, m) AS ids FROM found WHERE id IS NOT NULL GROUP BY doc_id),
    coded AS (
      SELECT doc_id, coalesce(ids, '') AS sentence_ids, coalesce(ids, '') AS rest, []::VARCHAR[] AS found
      FROM documents LEFT JOIN joined USING (doc_id)),
    {", ".join(steps)}
    SELECT doc_id, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ',') AS licences, sentence_ids,
           (len(rest) - len(replace(rest, '<', '')))::BIGINT AS n_unmatched
    FROM {last}"""
