"""Licence scan by canonical digest, in DataFrame functions alone.

A text is brought to a canonical form: lower case, copyright lines and the usual leading notice dropped,
equivalent spellings unified, everything but letters and digits as single spaces. The digest of the whole
canonical text is looked up among those of known licences, most of which are kept as digests alone. Every line is looked up the same way, which
finds one-line notices within a text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence texts and notices, as published by their authors.
KNOWN = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}
KNOWN["BSD-3-Clause"] = KNOWN["BSD-2-Clause"].replace("\n\nTHIS", """

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS""")
#: Spellings that count as one (canonical text, so lower case and without punctuation).
SPELLINGS = (
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("favour", "favor"),
    ("organisation", "organization"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"),
)
#: Digests (SHA-256 of the canonical form, see ``canonical``) of published whole texts, with and without
#: what follows their terms.
DIGESTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543",
        "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40",
        "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f",
    ),
    "Artistic-1.0-Perl": (
        "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",
    ),
    "CC0-1.0": (
        "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
    ),
    "GFDL-1.2": (
        "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60",
        "84f3c9e8cdded0036378e7e6eb92ac6570731434d2fc46027f259264dc16501e",
    ),
    "GFDL-1.3": (
        "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",
        "ccfa2750c2a3b9dae93f959cfa64078cc3a306c4a4cd4cfaf18365396202da90",
    ),
    "GPL-1.0": (
        "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
        "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
        "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70",
    ),
    "GPL-2.0": (
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
        "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",
    ),
    "GPL-3.0": (
        "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
        "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
        "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",
    ),
    "LGPL-2.0": (
        "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
        "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2",
    ),
    "LGPL-2.1": (
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
    ),
    "LGPL-3.0": (
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "MPL-1.1": (
        "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",
        "80cd52a1836f5ea3706bd2afa402fc448999d4a22581ee62d4041bd8a08efd87",
    ),
    "MPL-2.0": (
        "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
        "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de",
    ),
}
#: What follows "copyright" in the wording of licences, where a wrapped line may begin with it.
WORDING = ("holders", "holder", "owners", "owner", "notices", "notice", "license", "licenses", "licence", "law", "laws", "statement", "interest", "and", "or", "in", "on", "to", "is")
#: Steps from text to canonical text: marks without one of which a text stays as it is, and (pattern, replacement) in turn; plain
#: enough to mean the same in Java and RE2.
STEPS = (
    (("copyright", "(c)", "©"), (
        (r"(?m)^[^a-z0-9\n]*(copyright|\(c\)|©)[^\n]*[0-9][0-9][0-9][0-9][^\n]*$", " "),
        # lines of a holder without a year; wording is tied by a sign that goes away below; (c) alone also numbers items
        (rf"copyright[ \t]+({'|'.join(WORDING)})\b", "copyright_$1"),
        (r"(?m)^[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©)|copyright[ \t]*:?[ \t]+[\p{L}\p{N}<\[{\"']|©|\(c\)[ \t]*copyright[ \t])[^\n]*", " "),
        (r"(?m)^[^\p{L}\p{N}\n]*\(c\)[ \t]+[^\n]*\b(inc|llc|ltd|corp|corporation|gmbh|foundation|affiliates|contributors|authors)\b[^\p{L}\p{N}\n]*$", " "),
    )),
    (("all rights reserved",), ((r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$", " "),)),
    (("license", "licence"), ((r"(?m)^[^a-z0-9\n]*(the )?(mit|isc|zlib|bsd)( [23]-clause)? licen[cs]e[^a-z0-9\n]*$", " "),)),
    (("http",), ((r"https?://", "http "),)),
    (("",), ((r"[^\p{L}\p{N}]+", " "),)),
)


def _step(text: Column, marks: tuple[str, ...], patterns: tuple[tuple[str, str], ...]) -> Column:
    done = lambda t: reduce(lambda x, s: F.regexp_replace(x, *s), patterns, t)
    if marks == ("",):
        return done(text)
    has = lambda t: reduce(lambda x, y: x | y, [F.contains(t, F.lit(m)) for m in marks])
    # in an array, so that the text before is computed once
    return F.element_at(F.transform(F.array(text), lambda t: F.when(has(t), done(t)).otherwise(t)), 1)


def canonical(text: Column) -> Column:
    """The canonical form of a whole text; a null text is empty. Only ASCII letters change case, so that
    all engines agree."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    text = F.translate(F.coalesce(text, F.lit("")), upper, lower)
    text = reduce(lambda t, s: _step(t, *s), STEPS, text)
    # each word between blanks of its own, so neighbours don't share one
    text = F.concat(F.lit(" "), F.replace(F.trim(text), F.lit(" "), F.lit("  ")), F.lit(" "))
    text = reduce(lambda t, s: F.replace(t, *(F.lit(f" {x.replace(' ', '  ')} ") for x in s)), SPELLINGS, text)
    return F.trim(F.replace(text, F.lit("  "), F.lit(" ")))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark, known: dict[str, str] = KNOWN) -> DataFrame:
    """digest, license: a row for each known licence; their number is that of ``known`` and DIGESTS, so it can be
    broadcast."""
    rows = spark.createDataFrame(sorted(known.items()), "license string, t string").select(digest(F.col("t")).alias("digest"), "license")
    if known is KNOWN:
        rows = rows.unionByName(spark.createDataFrame([(d, name) for name, ds in sorted(DIGESTS.items()) for d in ds], "digest string, license string"))
    return rows.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", known: dict[str, str] = KNOWN) -> DataFrame:
    """digest, license (null if the whole text is none) and notices (sorted names of known licences that are a
    whole line) of each row.

    Null and empty texts have the digest of an empty text and no licence. Texts are read whole, however long; repeated
    rows get equal results; other columns are not read."""
    table = F.broadcast(known_digests(docs.sparkSession, known))
    names = F.create_map(*[F.lit(x) for name, t in sorted(known.items()) if "\n" not in t for x in (_plain(t), name)])
    # a line is worth its canonical form only if it has a licence's words at all
    said, word = F.coalesce(F.col(f"`{text}`"), F.lit("")), "(?i)licen[cs]e"
    lines = F.filter(F.split(said, "\n"), lambda x: x.rlike(word))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: names[canonical(x)]), lambda x: x.isNotNull())))
    found = F.when(said.rlike(word), found).otherwise(F.array().cast("array<string>"))
    out = docs.select(F.col(f"`{key}`").alias(key), digest(F.col(f"`{text}`")).alias("digest"), found.alias("notices"))
    return out.join(table, "digest", "left").select(key, "digest", "license", F.array_join("notices", ",").alias("notices"))


def _plain(text: str) -> str:
    """The canonical form of a one-line notice without copyright line, on the driver."""
    import re

    text = f" {re.sub('[^a-z0-9]+', '  ', text.lower().replace('https://', 'http ')).strip()} "
    for old, new in SPELLINGS:
        text = text.replace(*(f" {x.replace(' ', '  ')} " for x in (old, new)))
    return text.strip().replace("  ", " ")
