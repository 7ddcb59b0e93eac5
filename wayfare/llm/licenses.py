"""License scans (native): sentence rules.

The normalised text is cut at every place where a sentence may end, and each stretch
from one such place to another that reads as a known licence sentence is mapped to its
identifier; the sequence of identifiers of a text is then matched against licence rules,
each an ordered list of identifiers that must stand in that order (others may lie
between). The known sentences are a small fixed table, sent along as a pattern and a map
literal, so the scan shuffles nothing.

Sentences may end at a line feed, or at . ! ? ; : followed by a blank. A known sentence
may run over several lines and over such places within itself, but not over a blank line
(one that holds nothing but marks and blanks, as in a comment). Normalised: A-Z
lower-cased, everything but a-z, 0-9 and bytes above ASCII taken as a blank, blanks
collapsed, the words dnl, rem and c left out at the start of a line, where they are
comment leaders; leaders made of marks are blanks already.

Defined cases. Null and empty texts hold no sentence and match no rule. A sentence that
occurs twice is in the sequence twice; identifiers stand by where their sentences start,
shorter ones first. A sentence of any length, with any blanks in it, is looked at. When several rules match, all are named, in the
order of RULES. Repeated rows and rows with equal ids are scanned each on its own. Other
columns, whatever their names, pass through; where docs has a column `_ids` or `_licenses`,
the new one gets underscores more. An empty table gives an empty result.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import UPPER, free_name

#: Sentences of public licences, by identifier. Version numbers and names
#: stand as they do in the licence texts; normalisation takes their points for blanks.
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-title": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-file": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-use": "you may not use this file except in compliance with the License.",
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "ccbync4-notice": "Licensed under CC BY-NC 4.0.",
    "ccby4-notice": "Licensed under CC BY 4.0.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl-notice": "Distributed under the Boost Software License, Version 1.0.",
    "epl2-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "ccby4-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ccbysa4-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "ccbysa4-notice": "Licensed under CC BY-SA 4.0.",
    "spdx-mit": "SPDX-License-Identifier: MIT",
    "spdx-apache2": "SPDX-License-Identifier: Apache-2.0",
    "spdx-gpl2": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx-gpl3plus": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx-bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx-mpl2": "SPDX-License-Identifier: MPL-2.0",
    "spdx-isc": "SPDX-License-Identifier: ISC",
}
#: Ordered rules: licence, and the identifiers that must follow one another.
RULES = [
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("Apache-2.0", ["apache-notice"]),
    ("Apache-2.0", ["apache-file", "apache-use"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-warranty"]),
    ("CC-BY-4.0", ["ccby4-notice"]),
    ("CC-BY-NC-4.0", ["ccbync4-notice"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-warranty"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-warranty"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("Zlib", ["zlib-asis", "zlib-grant"]),
    ("BSL-1.0", ["bsl-notice"]),
    ("EPL-2.0", ["epl2-notice"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("CC-BY-4.0", ["ccby4-work"]),
    ("CC-BY-SA-4.0", ["ccbysa4-work"]),
    ("CC-BY-SA-4.0", ["ccbysa4-notice"]),
    ("MIT", ["spdx-mit"]),
    ("Apache-2.0", ["spdx-apache2"]),
    ("GPL-2.0-only", ["spdx-gpl2"]),
    ("GPL-3.0-or-later", ["spdx-gpl3plus"]),
    ("BSD-3-Clause", ["spdx-bsd3"]),
    ("MPL-2.0", ["spdx-mpl2"]),
    ("ISC", ["spdx-isc"]),
]
_WORD = r"a-z0-9\x{80}-\x{10FFFF}"
#: Marks in the cut text: | where a sentence may end, # at blank lines.
_STEPS = [
    (r"(?<=[.!?;:])[ \t\x0B\f\r]+", "|"),
    (rf"(?md)^[^{_WORD}\n]*(?:dnl|rem|c)(?![^ \t\r\n])", ""),
    (rf"[^{_WORD}|\n]+", " "),
    (r" ?\|[ |]*", "|"),
    (r"[ |]?\n[ |]?", "\n"),
    (r"\n{2,}", "#"),
]


def cut(text: Column) -> Column:
    """The normalised text with its marks; each step is linear in the text."""
    # a bar of the text itself is no mark
    out = F.translate(F.coalesce(text, F.lit("")), UPPER + "|", UPPER.lower() + "_")
    for pattern, mark in _STEPS:
        out = F.regexp_replace(out, pattern, mark)
    return F.concat(F.lit("|"), F.trim(F.translate(out, "\n", "|")), F.lit("|"))


def _normal(sentence: str) -> str:
    import re

    low = re.sub("[A-Z]", lambda m: m[0].lower(), sentence)
    return re.sub("[^a-z0-9\x80-\U0010ffff]+", " ", low).strip(" ")


def recognise(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None, text: str = "text") -> DataFrame:
    """docs with `_ids` (array of identifiers in order) and `_licenses` (array of licences)."""
    sentences, rules = sentences or SENTENCES, rules or RULES
    known: dict[str, str] = {}
    for name, sentence in sentences.items():
        known.setdefault(_normal(sentence), name)
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # the longest known sentence from each mark; a shorter one from there is a part of it that ends at a mark
    longest = "|".join(k.replace(" ", "[ |]") for k in sorted(known, key=len, reverse=True))
    found = F.regexp_extract_all(cut(F.col(f"`{text}`")), F.lit(f"[|#](?=({longest})[|#])"), F.lit(1))
    starts = lambda m: F.transform(F.sequence(F.lit(1), F.size(F.split(m, r"\|"))), lambda n: F.array_join(F.slice(F.split(m, r"\|"), 1, n), " "))
    ids = F.array_compact(F.flatten(F.transform(found, lambda m: F.transform(starts(m), lambda k: F.try_element_at(table, k)))))
    names = free_name(docs, "_ids"), free_name(docs, "_licenses")
    out = docs.withColumn(names[0], ids)
    met = [F.when(_in_order(F.col(names[0]), order), F.lit(name)) for name, order in rules]
    return out.withColumn(names[1], F.array_distinct(F.array_compact(F.array(*met))))


def _in_order(ids: Column, order: list[str]) -> Column:
    """Whether the identifiers stand in ids in this order."""
    step = lambda at, x: F.when(x == F.get(F.array(*map(F.lit, order)), at), at + 1).otherwise(at)
    return F.aggregate(ids, F.lit(0), step) == len(order)
