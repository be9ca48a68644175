"""Licence scan by canonical digests.

Texts are brought to one form: A-Z lowered, lines that begin with a copyright notice or a
reservation of rights dropped, everything but letters,
digits and bytes beyond ASCII turned into single blanks, and equivalent spellings made one. The SHA-256 of the whole
form is joined with those of known texts. That is done for whole documents, which a licence file matches, and for each
of their lines, which a notice matches. Everything is a DataFrame expression; the table of known digests is fixed: the
texts of ``KNOWN``, alone and under their headings, the notices, and the published files of which only digests are kept.

Defined cases: a null text, or one without a letter or digit, has the empty form and matches nothing; lines likewise.
Every row of the input gives one row, so repeated rows and a null doc_id are kept; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Public licence texts by identifier.
KNOWN = {
    "MIT": ["""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""],
    "ISC": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""],
    "BSD-2-Clause": ["""Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""],
    "BSD-3-Clause": [
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "0BSD": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "Zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    ],
    "BSL-1.0": [
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "Unlicense": [
        """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>""",
        "This is free and unencumbered software released into the public domain.",
    ],
    "Apache-2.0": ["""Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}
# The headings that whole texts stand under.
HEADINGS = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License'],
    "BSD-3-Clause": ["BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License'],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD"],
    "Zlib": ["zlib License", "The zlib License"],
    "BSL-1.0": ["Boost Software License - Version 1.0 - August 17th, 2003"],
}
# How notices name licences, by identifier.
NAMES = {
    "MIT": ["MIT", "the MIT License"],
    "ISC": ["ISC", "the ISC License"],
    "BSD-2-Clause": ["BSD-2-Clause", "the BSD 2-Clause License"],
    "BSD-3-Clause": ["BSD-3-Clause", "the BSD 3-Clause License"],
    "0BSD": ["0BSD"],
    "Zlib": ["the zlib License"],
    "BSL-1.0": ["the Boost Software License, Version 1.0"],
    "Unlicense": ["the Unlicense"],
    "Apache-2.0": ["Apache 2.0", "the Apache License, Version 2.0", "the Apache License 2.0"],
    "GPL-2.0-only": ["GPLv2", "the GNU General Public License, version 2", "the GNU General Public License v2.0"],
    "GPL-3.0-only": ["GPLv3", "the GNU General Public License, version 3", "the GNU General Public License v3.0"],
    "LGPL-2.1-only": ["LGPLv2.1", "the GNU Lesser General Public License, version 2.1"],
    "LGPL-3.0-only": ["LGPLv3", "the GNU Lesser General Public License, version 3"],
    "AGPL-3.0-only": ["AGPLv3", "the GNU Affero General Public License, version 3"],
    "MPL-2.0": ["MPL 2.0", "the Mozilla Public License, version 2.0"],
    "CC0-1.0": ["CC0 1.0", "CC0"],
    "CC-BY-4.0": ["CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0", "a Creative Commons Attribution-NoDerivatives 4.0 International License", "the Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "the Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0", "a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"],
}
# The notices around a name.
NOTICES = ["Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This project is licensed under {}", "This software is licensed under {}", "This document is licensed under {}"]
# Digests of the canonical form of whole licence files as they are published, where the text is too long to state.
PUBLISHED = {
    "Apache-2.0": "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543",
    "Artistic-1.0-Perl": "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    "CC0-1.0": "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    "GFDL-1.2-only": "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
    "GFDL-1.3-only": "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
    "GPL-1.0-only": "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    "GPL-2.0-only": "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    "GPL-3.0-only": "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    "LGPL-2.0-only": "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    "LGPL-2.1-only": "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
    "LGPL-3.0-only": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b",
    "MPL-2.0": "9672a697b80e59f5b1b0201e64d65dee8762b193cdd934dc5bcf2b57350a2ead",
}
#: Known texts of more characters are whole licences, which may have a heading.
WHOLE = 600
# Spellings that count as equal, in canonical form.
EQUIVALENT = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sublicence": "sublicense", "sub license": "sublicense", "sub licence": "sublicense",
    "non infringement": "noninfringement", "merchantibility": "merchantability", "acknowledgement": "acknowledgment",
    "whilst": "while", "favour": "favor", "organisation": "organization", "fulfil": "fulfill", "copyright owner": "copyright holder",
    "v 2 0": "version 2 0", "https": "http", "per cent": "percent",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Copyright notices and reservations of rights; a line that begins with the word without a year or a sign is none. Lines
#: end at line feeds only; in Java that takes the flag d besides.
COPYRIGHT_LINE = r"^[ \t]*(copyright[^\n]*([12][0-9][0-9][0-9]|\(c\)|©|<year>|\[year\]|\[yyyy\])|\(c\)[ \t]*[12][0-9][0-9][0-9]|©|all rights reserved)[^\n]*$"
_OTHER = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def canonical(text: Column) -> Column:
    """The canonical form, without blanks at its ends."""
    out = F.regexp_replace(F.translate(text, _UPPER, _LOWER), "(?md)" + COPYRIGHT_LINE, "")
    out = F.concat(F.lit(" "), F.regexp_replace(out, _OTHER, " "), F.lit(" "))
    for a, b in EQUIVALENT.items():
        out = F.replace(out, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def canonical_text(text: str) -> str:
    """The same in plain Python, for the table of known texts."""
    out = re.sub("(?m)" + COPYRIGHT_LINE, "", text.translate(str.maketrans(_UPPER, _LOWER)))
    out = f" {re.sub(_OTHER, ' ', out)} "
    for a, b in EQUIVALENT.items():
        out = out.replace(f" {a} ", f" {b} ")
    return re.sub(" +", " ", out).strip(" ")


def known_texts(known: dict[str, list[str]] | None = None) -> dict[str, list[str]]:
    """The known texts; for those that are whole licences also under each heading that they may have; and the notices."""
    if known is not None:
        return known
    out = {name: [*texts, *(f"{head}\n{t}" for head in HEADINGS.get(name, ()) for t in texts if len(t) > WHOLE)] for name, texts in KNOWN.items()}
    for name, spoken in NAMES.items():
        out[name] = [*out.get(name, []), f"SPDX-License-Identifier: {name}", *(notice.format(x) for x in spoken for notice in NOTICES)]
    return out


def known_digests(known: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Licences by digest. Without a table of one's own, with the published files of ``PUBLISHED``."""
    out = {} if known is not None else {digest: name for name, digest in PUBLISHED.items()}
    return out | stated_digests(known)


def stated_digests(known: dict[str, list[str]] | None = None) -> dict[str, str]:
    return {hashlib.sha256(canonical_text(t).encode()).hexdigest(): name for name, texts in known_texts(known).items() for t in texts}


def marks(known: dict[str, list[str]] | None = None) -> list[str] | None:
    """Words of which every known text without a line feed has one at least, taken from the known texts themselves: each
    text gives its longest word that no equivalent spelling touches, unless it has one of those taken before. A raw line
    that has the known form holds that word, A-Z lowered, as it is. None if some known text has no such word."""
    touched = {w for pair in EQUIVALENT.items() for side in pair for w in side.split()}
    forms = [canonical_text(t).split() for texts in known_texts(known).values() for t in texts]
    out: list[str] = []
    for words in sorted(forms, key=len):
        own = [w for w in words if w not in touched]
        if not own:
            return None
        if not set(own) & set(out):
            out.append(max(own, key=lambda w: (len(w), w)))
    return sorted(out)


def known_table(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted(known_digests(known).items()), "digest string, license string")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: dict[str, list[str]] | None = None) -> DataFrame:
    """(doc_id, digest, license, notices, n_notice_lines): the digest of the whole text and its licence or null; the
    licences that lines state, sorted and joined by commas, or null; how many lines do. known: texts by licence, instead
    of the table here.

    Whole texts are joined with the table of digests. The digests of lines are looked up among those of the stated texts, a
    literal map; only lines with one of the known texts' ``marks`` can match and are normalised."""
    lookup = F.create_map(*(F.lit(x) for kv in stated_digests(known).items() for x in kv))  # the known licences, a fixed table
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines, found = F.split(text, "\n"), marks(known)
    if found is not None:
        hint = "|".join(map(re.escape, found))
        lines = F.when(F.translate(text, _UPPER, _LOWER).rlike(hint), F.filter(lines, lambda x: F.translate(x, _UPPER, _LOWER).rlike(hint))).otherwise(F.array().cast("array<string>"))
    hits = F.filter(F.transform(lines, lambda x: F.try_element_at(lookup, F.sha2(canonical(x), 256))), lambda x: x.isNotNull())
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.sha2(canonical(text), 256).alias("digest"), hits.alias("hits"))
    rows = rows.join(F.broadcast(known_table(docs.sparkSession, known)), "digest", "left")  # as long as the table of known texts
    notices = F.when(F.size("hits") > 0, F.array_join(F.array_sort(F.array_distinct("hits")), ","))
    return rows.select("doc_id", "digest", "license", notices.alias("notices"), F.size("hits").cast("bigint").alias("n_notice_lines"))
