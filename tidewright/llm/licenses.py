"""Licence scans: known sentences give identifiers, and ordered rules match sequences of these. DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import fresh

#: Identifiers of sentences of public licences and notices.
SENTENCES = {
    "apache_line": "Licensed under the Apache License, Version 2.0.",
    "apache_grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache_copy": "You may obtain a copy of the License at",
    "apache_as_is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache_see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit_line": "Released under the MIT License.",
    "mit_licensed": "Licensed under the MIT License.",
    "mit_title": "The MIT License (MIT)",
    "mit_title_short": "MIT License",
    "mit_grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd_grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "gpl3_line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2_free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl_details": "See the GNU General Public License for more details.",
    "gpl_copy": "You should have received a copy of the GNU General Public License along with this program.",
    "gpl2_only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl21_free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl_details": "See the GNU Lesser General Public License for more details.",
    "agpl3_free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl_details": "See the GNU Affero General Public License for more details.",
    "mpl_notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "mpl_copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "mpl_line": "Licensed under the Mozilla Public License 2.0.",
    "epl_terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "zlib_warranty": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib_use": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "bsl_line": "Distributed under the Boost Software License, Version 1.0.",
    "bsl_grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "artistic_line": "This library is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0.",
    "python_line": "Licensed under the Python Software Foundation License, Version 2.",
    "wtfpl_title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "cc0_work": "This work is dedicated to the public domain.",
    "unlicense_free": "This is free and unencumbered software released into the public domain.",
    "reserved": "All rights reserved.",
}

#: The clauses of Creative Commons licences, by code and by name.
CREATIVE_COMMONS = {"BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY": "Attribution"}
#: Licences that a line of the SPDX form may name.
SPDX = ["Apache-2.0", "MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "Zlib", "BSL-1.0", "Artistic-2.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "WTFPL", "PSF-2.0"]
_cc = lambda code: "cc_" + code.lower().replace("-", "_")
SENTENCES |= {f"{_cc(c)}_line": f"Licensed under CC {c} 4.0." for c in CREATIVE_COMMONS}
SENTENCES |= {f"{_cc(c)}_work": f"This work is licensed under a Creative Commons {name} 4.0 International License." for c, name in CREATIVE_COMMONS.items()}
SENTENCES |= {f"spdx_{x}": f"SPDX-License-Identifier: {x}" for x in SPDX}

#: Rules in order of precedence: the licence, and sentence identifiers that stand one after the other among a document's recognised ones.
RULES = [
    ("Apache-2.0", ["apache_grant", "apache_copy", "apache_as_is", "apache_see"]),
    ("Apache-2.0", ["apache_grant"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("MIT", ["mit_title", "mit_grant"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope", "gpl_details"]),
    ("GPL-3.0-or-later", ["gpl_free"]),
    ("GPL-2.0-or-later", ["gpl2_free"]),
    ("GPL-2.0-only", ["gpl2_only"]),
    ("LGPL-2.1-or-later", ["lgpl21_free"]),
    ("LGPL-3.0-or-later", ["lgpl3_free"]),
    ("AGPL-3.0-or-later", ["agpl3_free"]),
    ("ISC", ["isc_grant"]),
    ("MPL-2.0", ["mpl_notice", "mpl_copy"]),
    ("MPL-2.0", ["mpl_notice"]),
    ("EPL-2.0", ["epl_terms"]),
    ("Zlib", ["zlib_warranty", "zlib_use"]),
    ("Zlib", ["zlib_use"]),
    ("BSL-1.0", ["bsl_grant"]),
    ("Unlicense", ["unlicense_free"]),
    ("Apache-2.0", ["apache_line"]),
    ("MIT", ["mit_line"]),
    ("MIT", ["mit_licensed"]),
    ("MIT", ["mit_title"]),
    ("MIT", ["mit_title_short"]),
    ("GPL-3.0-only", ["gpl3_line"]),
    ("MPL-2.0", ["mpl_line"]),
    ("BSL-1.0", ["bsl_line"]),
    ("Artistic-2.0", ["artistic_line"]),
    ("PSF-2.0", ["python_line"]),
    ("WTFPL", ["wtfpl_title"]),
    *((x, [f"spdx_{x}"]) for x in SPDX),
    *((f"CC-{c}-4.0", [f"{_cc(c)}_{kind}"]) for c in CREATIVE_COMMONS for kind in ("line", "work")),
    ("CC0-1.0", ["cc0_work"]),
    ("proprietary", ["reserved"]),
]

ENDS = r"([.!?])[ \t\r]+"


def normalise(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


def known_sentences(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Identifier by normalised sentence."""
    return {normalise(s): i for i, s in sentences.items()}


def telling_words(sentences: dict[str, str] = SENTENCES) -> list[str]:
    """Words such that every known sentence has one of them: a text with none of these, in any case, holds no known sentence.
    The longest and most shared are taken first."""
    left = [set(s.split()) for s in known_sentences(sentences)]
    found = []
    while left := [x for x in left if x]:
        shared: dict[str, int] = {}
        for x in left:
            for w in x:
                shared[w] = shared.get(w, 0) + 1
        best = max(shared, key=lambda w: (shared[w] * max(1, len(w) - 3), w))
        found.append(best)
        left = [x for x in left if best not in x]
    return found


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """The identifiers of a text's known sentences in order. Sentences end at . ! ? before white space, and either at line
    ends or, where that finds more, at empty lines only: licence texts are often wrapped."""
    known = F.create_map(*[F.lit(x) for pair in known_sentences(sentences).items() for x in pair])

    def found(whole: Column) -> Column:
        parts = F.split(F.regexp_replace(whole, ENDS, "$1\n"), "\n")
        plain = F.transform(parts, lambda s: F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")))
        return F.filter(F.transform(plain, lambda s: F.try_element_at(known, s)), lambda i: i.isNotNull())

    lines, wrapped = found(text), found(F.translate(F.regexp_replace(text, r"\n[ \t\r]*\n", "\u0001"), "\n\u0001", " \n"))
    ids = F.when(F.size(wrapped) > F.size(lines), wrapped).otherwise(lines)
    return F.when(text.rlike("(?iu)" + "|".join(telling_words(sentences))), ids).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """docs with sentence_ids (joined by commas, empty if none), n_sentences, license (of the first rule that fits) and
    licenses (of all rules that fit, each once, in the rules' order, joined by commas).

    Null and empty texts hold no sentence and get no licence. Each row is judged by itself, with no shuffle; columns of
    docs named as results are replaced.
    """
    results = ["sentence_ids", "n_sentences", "license", "licenses"]
    carried = [c for c in docs.columns if c not in results]
    found_ids, found_joined, found_fits = (fresh(x, docs) for x in ("__ids", "__joined", "__fits"))
    ids = F.coalesce(sentence_ids(F.col("text"), sentences), F.array().cast("array<string>"))
    joined = F.concat(F.lit(","), F.array_join(found_ids, ","), F.lit(","))
    fits = F.array_compact(F.array(*[F.when(F.col(found_joined).contains("," + ",".join(seq) + ","), F.lit(name)) for name, seq in rules]))
    found = docs.select(*carried, ids.alias(found_ids)).withColumn(found_joined, joined)
    found = found.withColumn(found_fits, F.when(F.size(found_ids) > 0, F.array_distinct(fits)).otherwise(F.array().cast("array<string>")))
    return found.select(*carried, F.array_join(found_ids, ",").alias("sentence_ids"), F.size(found_ids).cast("long").alias("n_sentences"), F.try_element_at(found_fits, F.lit(1)).alias("license"), F.array_join(found_fits, ",").alias("licenses"))


def oracle_sql() -> str:
    """DuckDB SQL for scan_licenses(documents) as the query returns it."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(i)})" for s, i in known_sentences().items())
    rules = ", ".join(f"({n}, {quote(name)}, {quote(',' + ','.join(seq) + ',')})" for n, (name, seq) in enumerate(RULES))
    return f"""
WITH known(sentence, id) AS (VALUES {known}), rules(n, name, seq) AS (VALUES {rules}),
texts AS (SELECT doc_id, 0 AS wrapped, text FROM documents UNION ALL SELECT doc_id, 1, translate(regexp_replace(text, '\\n[ \\t\\r]*\\n', chr(1), 'g'), chr(10) || chr(1), ' ' || chr(10)) FROM documents),
cuts AS (SELECT doc_id, wrapped, string_split(regexp_replace(text, '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) AS list FROM texts),
parts AS (SELECT doc_id, wrapped, unnest(list) AS s, generate_subscripts(list, 1) AS pos FROM cuts),
both_ids AS (SELECT p.doc_id, p.wrapped, string_agg(k.id, ',' ORDER BY p.pos) AS ids, count(*) AS n FROM parts p
  JOIN known k ON trim(regexp_replace(lower(p.s), '[^a-z0-9]+', ' ', 'g')) = k.sentence GROUP BY p.doc_id, p.wrapped),
ids AS (SELECT doc_id, arg_max(ids, 2 * n - wrapped) AS ids, max(n) AS n FROM both_ids GROUP BY doc_id),
fits AS (SELECT i.doc_id, r.name, min(r.n) AS n FROM ids i JOIN rules r ON contains(',' || i.ids || ',', r.seq) GROUP BY i.doc_id, r.name),
best AS (SELECT doc_id, arg_min(name, n) AS license, string_agg(name, ',' ORDER BY n) AS licenses FROM fits GROUP BY doc_id)
SELECT d.doc_id, coalesce(i.ids, '') AS sentence_ids, CAST(coalesce(i.n, 0) AS BIGINT) AS n_sentences, b.license, coalesce(b.licenses, '') AS licenses
FROM documents d LEFT JOIN ids i ON d.doc_id = i.doc_id LEFT JOIN best b ON d.doc_id = b.doc_id"""
