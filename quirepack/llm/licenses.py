"""Licence scans by sentence rules.

A text is split into sentences, each is normalised (lower case, runs of other
than ASCII letters and digits to one blank) and looked up among known licence
sentences; a few with names in them are known by a template. The identifiers found,
in text order, are then matched against RULES in their order: the first rule
whose sentences stand there in its order, other known sentences between them or not,
takes them away, as often as it finds them, and later rules see only what is left. More
specific rules stand first, so a three-clause text is not taken for a two-clause one as
well, nor a header's "or any later version" for the version alone. Only SQL functions.

Sentences end at . ! ? : ; before white space, at blank lines, and around lines that are
blank but for marks, state a copyright or are a known sentence by themselves; other line
ends are blanks, so hard-wrapped licences are seen whole, comment marks and all.

Null or empty texts, and texts without any of KEYWORDS, have no sentences and no
licences. Every input row gives one result row, repeated rows included; columns of
the input named like the results are replaced, others stay. Long texts take linear time.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and notices with their variants, by identifier.
SENTENCES = {
    "mit-name": ("MIT License", "The MIT License", "The MIT License (MIT)"),
    "mit-notice": ("Released under the MIT License.", "Licensed under the MIT License.", "Licensed under the MIT license", "This project is licensed under the MIT License.", "Distributed under the MIT License.", "This software is released under the MIT License."),
    "mit-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",),
    "mit-0-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",),
    "mit-keep": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."),
    "mit-warranty": ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",),
    "mit-liability": ("IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "0bsd-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",),
    "isc-warranty": ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",),
    "isc-notice": ("Licensed under the ISC License.", "Released under the ISC License."),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "bsd-name": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "The names of its contributors may not be used to endorse or promote products derived from this software without specific prior written permission."),
    "bsd-advertising": ("All advertising materials mentioning features or use of this software must display the following acknowledgement:", "All advertising materials mentioning features or use of this software must display the following acknowledgment:"),
    "bsd-notice-2": ("Licensed under the BSD 2-Clause License.", "Licensed under the Simplified BSD License."),
    "bsd-notice-3": ("Licensed under the BSD 3-Clause License.", "Licensed under the New BSD License."),
    "apache-notice": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.", "Licensed under the Apache License 2.0.", "This project is licensed under the Apache License, Version 2.0."),
    "apache-header": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this software except in compliance with the License."),
    "apache-copy": ("You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "apache-unless": ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",),
    "apache-see": ("See the License for the specific language governing permissions and limitations under the License.",),
    "gpl3-notice": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Licensed under the GPLv3."),
    "gpl2-notice": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "Licensed under the GPLv2."),
    "agpl3-notice": ("Licensed under the GNU Affero General Public License, version 3.", "Licensed under the AGPLv3."),
    "lgpl3-notice": ("Licensed under the GNU Lesser General Public License, version 3.", "Licensed under the LGPLv3."),
    "free-program": ("This program is free software:", "This library is free software:", "This file is free software:", "This software is free software:"),
    "gpl3-or-later": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "gpl2-or-later": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "gpl3-only": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3.", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation."),
    "gpl2-only": ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 2.", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    "agpl3-or-later": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "agpl3-only": ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License version 3 as published by the Free Software Foundation."),
    "lgpl3-or-later": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "lgpl21-or-later": ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "gnu-no-warranty": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    "gnu-merchantability": ("without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "gnu-see": ("See the GNU General Public License for more details.", "See the GNU Lesser General Public License for more details.", "See the GNU Affero General Public License for more details."),
    "mpl2-header": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "mpl2-copy": ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "epl2-header": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0."),
    "unlicense-free": ("This is free and unencumbered software released into the public domain.",),
    "unlicense-anyone": ("Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",),
    "boost-header": ("Distributed under the Boost Software License, Version 1.0.",),
    "boost-grant": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",),
    "zlib-as-is": ("This software is provided 'as-is', without any express or implied warranty.",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "wtfpl-name": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",),
    "wtfpl-grant": ("Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",),
    "cc0-notice": ("This work is dedicated to the public domain under CC0 1.0.", "Licensed under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
}
#: Creative Commons licences of version 4.0 by their attributes' words.
CREATIVE_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
#: Identifiers that a line "SPDX-License-Identifier:" may name.
SPDX = ("MIT", "MIT-0", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "Unlicense", "BSL-1.0", "Zlib", "WTFPL", "CC0-1.0", *(f"CC-{k}-4.0" for k in CREATIVE_COMMONS))
#: Sentences with a name in them, by identifier, as patterns of the normalised sentence.
TEMPLATES = {
    "bsd-name": "neither the names? of .{1,120} may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-acknowledgement": "this product includes software developed by .{1,120}",
}
SENTENCES |= {f"cc-{k.lower()}-notice": (f"Licensed under CC {k} 4.0.", f"This work is licensed under CC {k} 4.0.", f"This work is licensed under a Creative Commons {words} 4.0 International License.", f"Licensed under the Creative Commons {words} 4.0 International License.") for k, words in CREATIVE_COMMONS.items()}
SENTENCES |= {f"spdx-{k.lower()}": (f"SPDX-License-Identifier: {k}",) for k in SPDX}
#: Licences and the sentences that show them, in the order in which they are tried.
RULES = [
    ("MIT", ["mit-grant", "mit-keep", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-keep"]),
    ("MIT-0", ["mit-0-grant"]),
    ("MIT", ["mit-notice"]),
    ("ISC", ["isc-grant", "isc-warranty"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-grant"]),
    ("ISC", ["isc-notice"]),
    ("BSD-4-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-name"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["bsd-notice-2"]),
    ("BSD-3-Clause", ["bsd-notice-3"]),
    ("Apache-2.0", ["apache-header", "apache-copy", "apache-unless", "apache-see"]),
    ("Apache-2.0", ["apache-header", "apache-copy"]),
    ("Apache-2.0", ["apache-header"]),
    ("Apache-2.0", ["apache-notice"]),
    *((name, ["free-program", f"{i}-{which}", "gnu-no-warranty", "gnu-merchantability"]) for i, which, name in (
        ("agpl3", "or-later", "AGPL-3.0-or-later"), ("agpl3", "only", "AGPL-3.0-only"), ("lgpl3", "or-later", "LGPL-3.0-or-later"), ("lgpl21", "or-later", "LGPL-2.1-or-later"),
        ("gpl3", "or-later", "GPL-3.0-or-later"), ("gpl3", "only", "GPL-3.0-only"), ("gpl2", "or-later", "GPL-2.0-or-later"), ("gpl2", "only", "GPL-2.0-only"))),
    *((name, [f"{i}-{which}"]) for i, which, name in (
        ("agpl3", "or-later", "AGPL-3.0-or-later"), ("agpl3", "only", "AGPL-3.0-only"), ("lgpl3", "or-later", "LGPL-3.0-or-later"), ("lgpl21", "or-later", "LGPL-2.1-or-later"),
        ("gpl3", "or-later", "GPL-3.0-or-later"), ("gpl3", "only", "GPL-3.0-only"), ("gpl2", "or-later", "GPL-2.0-or-later"), ("gpl2", "only", "GPL-2.0-only"))),
    ("GPL-3.0", ["gpl3-notice"]),
    ("GPL-2.0", ["gpl2-notice"]),
    ("AGPL-3.0", ["agpl3-notice"]),
    ("LGPL-3.0", ["lgpl3-notice"]),
    ("MPL-2.0", ["mpl2-header", "mpl2-copy"]),
    ("MPL-2.0", ["mpl2-header"]),
    ("EPL-2.0", ["epl2-header"]),
    ("Unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("Unlicense", ["unlicense-free"]),
    ("BSL-1.0", ["boost-grant"]),
    ("BSL-1.0", ["boost-header"]),
    ("Zlib", ["zlib-as-is", "zlib-grant"]),
    ("WTFPL", ["wtfpl-name"]),
    ("CC0-1.0", ["cc0-notice"]),
    *((f"CC-{k}-4.0", [f"cc-{k.lower()}-notice"]) for k in CREATIVE_COMMONS),
    *((k, [f"spdx-{k.lower()}"]) for k in SPDX),
    ("MIT", ["mit-name", "mit-warranty"]),
]
#: Texts with none of these are not looked at.
KEYWORDS = ("licen", "permission", "copyright", "warrant", "redistribut", "public domain")
#: What stands before an SPDX identifier; its colon ends no sentence.
SPDX_LABEL = "SPDX-License-Identifier"
#: Normalised lines that state a copyright.
COPYRIGHT_LINE = "^copyright (c |[0-9])|^c [0-9]{4}"
_ENDS = r"(?<=[.!?:;])\s+"
BREAK = "\u001e"


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def parts_of(sentence: str) -> list[str]:
    """The normalised sentences that the scan sees in a known one, which may have sentence ends inside."""
    return [x for x in (normalised(p) for p in re.split(_ENDS, sentence.replace(f"{SPDX_LABEL}:", SPDX_LABEL))) if re.search("[a-z]", x)]


def known(sentences: dict[str, tuple[str, ...]] = SENTENCES) -> dict[str, str]:
    """Identifiers by normalised sentence. Of a sentence with ends inside, the first part has the identifier and the others are numbered."""
    out: dict[str, str] = {}
    for name, variants in sentences.items():
        for sentence in variants:
            for k, part in enumerate(parts_of(sentence)):
                out.setdefault(part, name if not k else f"{name}-{k + 1}")
    return out


def expanded(rules=RULES, sentences: dict[str, tuple[str, ...]] = SENTENCES) -> list[tuple[str, str]]:
    """Licences and the patterns of identifier sequences, each in brackets; $1, $2 ... are the sentences between."""
    table = known(sentences)
    out = []
    for name, ids in rules:
        for i in ids:
            if i not in sentences and i not in TEMPLATES:
                raise ValueError(f"no sentence {i!r}")
        own = [x for i in ids for x in ([table[p] for p in parts_of(sentences[i][0])] if i in sentences else [i])]
        # the least number of sentences, and of licences found before, between
        out.append((name, r"((?:[\[{][^\]}]*[\]}])*?)".join(rf"\[{re.escape(i)}\]" for i in own)))
    return out


def _sentences(text: Column, table: Column) -> Column:
    """The sentences' normalised forms."""
    plain = lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
    alone = lambda p: (p == "") | p.rlike(COPYRIGHT_LINE) | table[p].isNotNull()
    marked = lambda line: F.transform(F.array(plain(line)), lambda p: F.when(alone(p), F.concat(F.lit(BREAK), line, F.lit(BREAK))).otherwise(F.concat(line, F.lit(" "))))[0]
    joined = F.array_join(F.transform(F.split(text, "\n"), marked), "")
    return F.transform(F.split(joined, rf"{BREAK}|{_ENDS}"), plain)


def _identified(plain: Column, table: Column) -> Column:
    found = table[plain]
    for name, pattern in TEMPLATES.items():
        found = F.coalesce(found, F.when(plain.rlike(f"^(?:{pattern})$"), F.lit(name)))
    return found


def scan(df: DataFrame, text: str = "text", rules=RULES, sentences: dict[str, tuple[str, ...]] = SENTENCES) -> DataFrame:
    """Adds sentence_ids (array, in text order) and licenses (sorted array); columns of these names are replaced."""
    table = F.create_map(*(F.lit(x) for pair in known(sentences).items() for x in pair))
    lower = F.replace(F.lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), F.lit(f"{SPDX_LABEL}:".lower()), F.lit(SPDX_LABEL.lower()))
    none = F.array().cast("array<string>")
    ids = F.filter(F.transform(_sentences(lower, table), lambda s: _identified(s, table)), lambda x: x.isNotNull())
    out = df.withColumn("sentence_ids", F.when(lower.rlike("|".join(KEYWORDS)), ids).otherwise(none))
    left = F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit("["), i, F.lit("]"))), "")
    for name, pattern in expanded(rules, sentences):
        between = "".join(f"${k + 1}" for k in range(pattern.count("*?)")))
        left = F.regexp_replace(left, pattern, "{" + name + "}" + between)
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(left, F.lit(r"\{([^}]*)\}"), F.lit(1))))
    return out.withColumn("licenses", F.when(F.size("sentence_ids") > 0, names).otherwise(none))


def op6(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select("doc_id", F.size("sentence_ids").cast("long").alias("n_known"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def oracle() -> str:
    """DuckDB's form of op6, from the same tables of sentences and rules."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    pairs = ", ".join(f"{quote(k)}: {quote(v)}" for k, v in known().items())
    plain = lambda s: f"trim(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g'))"
    # this dialect has no look-behind: sentence ends are marked first
    ends = lambda x: f"regexp_replace({x}, '([.!?:;])\\s+', '\\1' || chr(30), 'g')"
    line = f"CASE WHEN {plain('l')} = '' OR regexp_matches({plain('l')}, {quote(COPYRIGHT_LINE)}) OR m[{plain('l')}] IS NOT NULL THEN chr(30) || l || chr(30) ELSE l || ' ' END"
    split = f"string_split({ends('array_to_string(list_transform(string_split(x, chr(10)), lambda l: ' + line + '), chr(0))').replace('chr(0)', quote(''))}, chr(30))"
    found = "coalesce(m[p], " + ", ".join(f"CASE WHEN regexp_full_match(p, {quote(v)}) THEN {quote(k)} END" for k, v in TEMPLATES.items()) + ")"
    left = "array_to_string(list_transform(ids, lambda i: '[' || i || ']'), '')"
    for name, pattern in expanded():
        between = "".join(f"\\{k + 1}" for k in range(pattern.count("*?)")))
        left = f"regexp_replace({left}, {quote(pattern)}, {quote('{' + name + '}' + between)}, 'g')"
    return f"""
WITH t AS (SELECT doc_id, replace(lower(coalesce(text, '')), '{SPDX_LABEL.lower()}:', '{SPDX_LABEL.lower()}') AS x, MAP {{{pairs}}} AS m FROM documents),
s AS (SELECT doc_id, m, CASE WHEN regexp_matches(x, '{"|".join(KEYWORDS)}') THEN list_transform({split}, lambda s: {plain('s')}) ELSE [] END AS ps FROM t),
i AS (SELECT doc_id, list_filter(list_transform(ps, lambda p: {found}), lambda z: z IS NOT NULL) AS ids FROM s),
r AS (SELECT doc_id, ids, CASE WHEN len(ids) > 0 THEN {left} ELSE '' END AS z FROM i)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_known, array_to_string(ids, ',') AS sentence_ids,
  array_to_string(list_sort(list_distinct(regexp_extract_all(z, '\\{{([^}}]*)\\}}', 1))), ',') AS licenses FROM r"""
