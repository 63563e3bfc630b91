"""License scans by lookup of canonical digests.

A text is brought to a canonical form: copyright statements (mark, years, holder) go, case and
punctuation go, and equivalent spellings become one. The digest of the whole canonical text,
and those of its lines, are joined with the digests of known license texts and notices. Only
texts and lines of as many words as some known text has are digested: others cannot be equal.
Known texts are one small table; whether it is broadcast is left to Spark's own size rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaloom.llm.common import batches_of, stored, texts_of

# Spellings that count as equal in license texts.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "https": "http",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organise": "organize",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "signalling": "signaling",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

_MIT = """\
MIT License

Copyright (c) <year> <copyright holders>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or
substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""

_ISC = """\
ISC License

Copyright (c) <year> <owner>

Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission
notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE.
"""

_BSD_CONDITIONS = """\
Copyright (c) <year>, <owner>

Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of
   conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of
   conditions and the following disclaimer in the documentation and/or other materials provided
   with the distribution.
"""

_BSD_HOLDER = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to
   endorse or promote products derived from this software without specific prior written
   permission.
"""

_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR
IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.
"""

# Known texts: full licenses, and notices that stand for one.
KNOWN = (
    ("MIT", "license", _MIT),
    ("ISC", "license", _ISC),
    ("BSD-2-Clause", "license", _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "license", _BSD_CONDITIONS + _BSD_HOLDER + _BSD_DISCLAIMER),
    ("BSD-2-Clause", "license", "BSD 2-Clause License\n" + _BSD_CONDITIONS + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "license", "BSD 3-Clause License\n" + _BSD_CONDITIONS + _BSD_HOLDER + _BSD_DISCLAIMER),
    ("MIT", "license", _MIT.partition("\n")[2]),
    ("ISC", "license", _ISC.partition("\n")[2]),
    ("Apache-2.0", "notice", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "notice", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "notice", "Licensed under CC BY 4.0."),
    ("MIT", "notice", "Licensed under the MIT License."),
    (
        "GPL-3.0-only",
        "notice",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    ("LicenseRef-All-Rights-Reserved", "notice", "All rights reserved."),
)

# (license_id, n_words, digest) of whole texts.
# They are whole, or without what stands behind the terms and conditions.
KNOWN_DIGESTS = (
    ("Apache-2.0", 1602, "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2"),
    ("Apache-2.0", 1426, "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a"),
    ("Apache-2.0", 1431, "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    ("Artistic-1.0-Perl", 983, "08f1dc258c8f9e175155356aa1dd0dead8cfdec586bc1bb4c8b1452699a91702"),
    ("CC0-1.0", 1088, "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("GFDL-1.2-only", 3315, "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3-only", 3732, "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0-only", 2067, "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-1.0-only", 1636, "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70"),
    ("GPL-1.0-only", 1641, "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc"),
    ("GPL-2.0-only", 2975, "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-2.0-only", 2499, "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808"),
    ("GPL-2.0-only", 2504, "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    ("GPL-3.0-only", 5684, "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("GPL-3.0-only", 5236, "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191"),
    ("GPL-3.0-only", 5241, "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    ("LGPL-2.0-only", 4200, "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.0-only", 3860, "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2"),
    ("LGPL-2.0-only", 3865, "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260"),
    ("LGPL-2.1-only", 4401, "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-2.1-only", 4060, "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df"),
    ("LGPL-2.1-only", 4065, "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    ("LGPL-3.0-only", 1231, "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", 3789, "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", 2426, "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
)

_WORD = regex.compile(r"[\p{L}\p{N}]+")
# A mark with years, a placeholder or a holder; a letter of a list, or a sentence on copyright
# ("copyright notice", "copyright and related rights"), is none.
_COPYRIGHT = regex.compile(
    r"[\W_]*(?:"
    r"(?i:copyright)\s*(?i:\(c\)|©)"
    r"|©"
    r"|(?i:copyright)[\s:,]*(?=\d{4}|[<\[{]|(?i:by\s))"
    r"|(?i:\(c\))\s*(?i:copyright\b|(?=\d{4}|[<\[{]))"
    r"|Copyright\s+(?!(?i:notices?|holders?|owners?|licen[cs]es?|law|laws|acts?|statements?)\b)(?=\p{Lu})"
    r")"
)
# What may follow a holder in the line of a statement.
_NOTICE = regex.compile(
    r"\b(?:(?:all|some|no)\s+rights\s+reserved"
    r"|(?:this\s+\w+(?:\s+\w+)?\s+is\s+)?(?:dual[- ])?(?:licen[cs]ed|released|distributed)\s+under"
    r"|(?:permission|redistribution|use\s+of\s+this|this\s+(?:work|software|program|file|library))\b)",
    regex.IGNORECASE,
)
_RESERVED = ["all", "rights", "reserved"]


def _lines(text: str) -> Iterator[tuple[list[str], bool]]:
    """Canonical words of each line that has any, and whether they follow a copyright statement."""
    for line in text.split("\n"):
        stated = _COPYRIGHT.match(line)
        if stated:
            notice = _NOTICE.search(line, stated.end())
            line = line[notice.start() :] if notice else ""
        words = [SPELLINGS.get(w, w) for w in _WORD.findall(line.lower())]
        if words:
            yield words, bool(stated)


def canonical_lines(text: str) -> list[list[str]]:
    """Canonical words of each line that has any beside copyright statements."""
    return [words for words, _ in _lines(text)]


def _whole(lines: list[tuple[list[str], bool]]) -> list[str]:
    # Reserved rights in the line of a statement do not make a license another one.
    return [w for words, stated in lines if not (stated and words == _RESERVED) for w in words]


def digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def canonical(text: str) -> list[str]:
    return _whole(list(_lines(text)))


def known_digests(spark: SparkSession, known: tuple = KNOWN) -> DataFrame:
    """(digest, license_id, kind, n_words) of the known texts; with KNOWN, of KNOWN_DIGESTS, too."""
    rows = []
    for license_id, kind, text in known:
        words = canonical(text)
        rows.append((digest(words), license_id, kind, len(words)))
    if known is KNOWN:
        rows += [(d, license_id, "license", n) for license_id, n, d in KNOWN_DIGESTS]
    return spark.createDataFrame(rows, "digest string, license_id string, kind string, n_words int")


_UNITS = pa.schema(
    [
        ("row_id", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("whole", pa.string()),
        ("lines", pa.list_(pa.string())),
    ]
)
_UNITS_DDL = "row_id bigint, doc_id bigint, n_words bigint, whole string, lines array<string>"


def _digests(lengths: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                ids = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for (row_id, doc_id), text in zip(ids, texts_of(batch.column(2))):
                    lines = list(_lines((text or b"").decode()))
                    size = sum(len(x) for x, _ in lines)
                    of_whole = _whole(lines)
                    whole = digest(of_whole) if len(of_whole) in lengths else None
                    found = sorted({digest(x) for x, _ in lines if len(x) in lengths})
                    yield row_id, doc_id, size, whole, found

        yield from batches_of(rows(), _UNITS)

    return run


def scan(
    docs: DataFrame,
    known: DataFrame | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, license_id and notices of every row of `docs`.

    license_id: the known text that the whole document equals, canonically; null for none, the
    least id of several. notices: sorted ids of the known texts that a line equals. Null and
    empty texts have neither. Rows that repeat an id, or have none, are scanned one by one; an
    empty table, of documents or of known texts, gives no matches.
    """
    known = known_digests(docs.sparkSession) if known is None else known
    lengths = frozenset(r[0] for r in known.select("n_words").distinct().collect())
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col(id_col).cast("long"),
        F.col(text_col).cast("string"),
    )
    units = stored(rows.mapInArrow(_digests(lengths), _UNITS_DDL), "digests")
    asked = units.select("row_id", "whole", F.explode(F.array_distinct(
        F.concat("lines", F.array_compact(F.array("whole"))))).alias("digest"))
    found = (
        asked.join(known.select("digest", "license_id"), "digest")
        .groupBy("row_id")
        .agg(
            F.min(F.when(F.col("digest") == F.col("whole"), F.col("license_id"))).alias("license_id"),
            F.sort_array(F.collect_set("license_id")).alias("notices"),
        )
    )
    return units.join(found, "row_id", "left").select(
        "doc_id",
        "n_words",
        "license_id",
        F.coalesce("notices", F.array().cast("array<string>")).alias("notices"),
    )
