"""Licence scans by canonical digest look-up, in DataFrame functions only.

A text is normalised as licence texts are compared: copyright lines go, A-Z become lower case, equivalent
spellings become one, punctuation and white space become single spaces. The SHA-256 of the whole result is
joined to the digests of the known licences: the whole public texts of licence_texts and the short ones
below, with and without their usual titles, appendices and list marks, as wrapped there and unwrapped.
A licence that stands inside other text cannot be found by this method.

Defined results: a null or empty text, and one of punctuation only, has the digest of the empty text and
no licence; a text with anything besides the licence is not that licence; if several known licences
normalise alike, the smallest licence_id is given; repeated rows are looked up each.
"""

from __future__ import annotations

import re
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as equal, after punctuation has become spaces; whole words.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalisations", "capitalizations"), ("catalogue", "catalog"),
    ("categorise", "categorize"), ("centre", "center"), ("copyright owner", "copyright holder"), ("emphasised", "emphasized"), ("favour", "favor"),
    ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("https", "http"), ("initialise", "initialize"), ("judgement", "judgment"),
    ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"),
    ("non commercial", "noncommercial"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"),
    ("per cent", "percent"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("sub license", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
]

_DISCLAIMER = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
    "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
    "IN THE SOFTWARE."
)
_ISC = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
    "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
#: Public licence texts and notices.
KNOWN = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, '
    "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _DISCLAIMER,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies. " + _ISC,
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. " + _ISC,
    "WTFPL": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "MIT-notice": "Released under the MIT License.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
}
_MIT = KNOWN["MIT"]
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE '
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
    "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
    "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
    "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE.",
)
#: Short licences as paragraphs, a list of variants for each.
SHORT = {
    "MIT": [_MIT, _MIT.replace("permission notice shall", "permission notice (including the next paragraph) shall")],
    "ISC": [KNOWN["ISC"], KNOWN["ISC"].replace("and/or distribute", "and distribute")],
    "0BSD": [KNOWN["0BSD"]],
    "BSD-2-Clause": [f"{_BSD[0]}\n{a}{_BSD[1]}\n{b}{_BSD[2]}\n{_BSD[4]}" for a, b in (("1. ", "2. "), ("* ", "* "), ("a. ", "b. "))],
    "BSD-3-Clause": [f"{_BSD[0]}\n{a}{_BSD[1]}\n{b}{_BSD[2]}\n{c}{_BSD[3]}\n{_BSD[4]}" for a, b, c in (("1. ", "2. ", "3. "), ("* ", "* ", "* "), ("a. ", "b. ", "c. "))],
}
#: Usual title lines, which stand before the copyright lines.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "ISC"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "BSD Zero Clause License (0BSD)", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", 'BSD 2-Clause "Simplified" License', "BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "Modified BSD License", 'BSD 3-Clause "New" or "Revised" License', "BSD License", "The BSD License"],
}
RESERVED = "All rights reserved."
#: Postal addresses that copies of the GNU licences have had.
ADDRESS = "51 Franklin St(?:reet)?,\\s+Fifth\\s+Floor,\\s+Boston,\\s+MA\\s+02110-1301,?\\s+USA"
ADDRESSES = ["51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA"]
#: A copyright line begins with the word or the sign and goes on with the sign, a year, a placeholder or a name; text that a
#: wrapped licence has at a line's start ("COPYRIGHT HOLDERS BE LIABLE", "copyright notice", a clause "(c) You ...") does not. A
#: placeholder in brackets may be wrapped.
COPYRIGHT = (
    "(^|\\n)[ \\t/*#;-]*(?:[Cc]opyright[ \\t]+(?:by[ \\t]|\\([Cc]\\)|©|[0-9<\\[{]|[A-GI-KMP-Z]|H[^o]|Ho[^l]|L[^ai]|La[^w]|Li[^c]|N[^o]|No[^t]|O[^w]|Ow[^n])|COPYRIGHT[ \\t]+(?:\\([Cc]\\)|©|[0-9<\\[{])"
    "|\\(C\\)[ \\t]+[0-9<\\[{A-Z]|\\(c\\)[ \\t]+(?:[0-9<\\[{]|[Cc]opyright)|©)[^\\n\\[]*(?:\\[[^\\]\\[]{0,80}\\][^\\n\\[]*){0,8}[^\\n]*"
)
MARKS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F“”‘’–—©«»]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def canonical(text: Column) -> Column:
    """The normalised text."""
    plain = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), F.lit(COPYRIGHT), F.lit("\n"))
    # Two spaces between words, so that spellings which follow each other do not share one.
    plain = F.concat(F.lit(" "), F.regexp_replace(F.translate(plain, UPPER, LOWER), F.lit(MARKS), F.lit("  ")), F.lit(" "))
    for old, new in SPELLINGS:
        plain = F.replace(plain, F.lit(wide(old)), F.lit(wide(new)))
    return F.btrim(F.replace(plain, F.lit("  "), F.lit(" ")), F.lit(" "))


def wide(words: str) -> str:
    return f" {words.replace(' ', '  ')} "


def unwrapped(text: str) -> str:
    """Each paragraph on one line."""
    return "\n\n".join(" ".join(p.split()) for p in re.split("\n[ \t\f]*\n", text))


def public_texts() -> list[tuple[str, str]]:
    """(licence_id, text) of all known licences and their variants."""
    out = set(KNOWN.items())
    for name, bodies in SHORT.items():
        out |= {(name, "\n".join([*head, body])) for body in bodies for t in ["", *TITLES[name]] for head in ([t], [t, RESERVED])}
    for file in resources.files(__package__).joinpath("licence_texts").iterdir():
        if not file.name.endswith(".txt"):
            continue
        name, whole = file.name.removesuffix(".txt"), file.read_text(encoding="utf-8")
        end = re.search("\n[ \t]*END OF TERMS AND CONDITIONS[ \t]*\n", whole)
        forms = [whole, *([whole[: end.start()], whole[: end.end()]] if end else [])]
        forms = [re.sub(ADDRESS, a, f) for f in forms for a in (ADDRESSES if re.search(ADDRESS, f) else [""])]
        heads = [f"{t}\n" for t in ["", *TITLES.get(name, [])]]
        out |= {(name, h + form) for f in forms for form in (f, unwrapped(f)) for h in heads}
    return sorted(out)


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(sorted(texts.items()) if texts else public_texts(), "licence_id string, text string")


def scan(docs: DataFrame, licences: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, digest and licence_id (null: none known) for each row of docs. The side of the licences is
    broadcast only where the planner knows it to be small enough."""
    wanted = licences.select(F.sha2(canonical(F.col("text")).cast("binary"), 256).alias("known_digest"), "licence_id").groupBy("known_digest").agg(F.min("licence_id").alias("licence_id"))
    wanted = wanted.where(F.col("known_digest") != F.sha2(F.lit(b""), 256))
    own = docs.select(docs[key], F.sha2(canonical(docs[text]).cast("binary"), 256).alias("digest"))
    return own.join(wanted, own["digest"] == wanted["known_digest"], "left").select(key, "digest", "licence_id")


def oracle() -> str:
    """The same in DuckDB's SQL, over the documents table, for the licences of KNOWN alone."""
    quote = lambda s: s.replace("'", "''")

    def form(column: str) -> str:
        out = f"translate(regexp_replace(coalesce({column}, ''), '{COPYRIGHT}', chr(10), 'g'), '{UPPER}', '{LOWER}')"
        out = f"' ' || regexp_replace({out}, '{MARKS}', '  ', 'g') || ' '"
        for old, new in SPELLINGS:
            out = f"replace({out}, '{wide(old)}', '{wide(new)}')"
        return f"sha256(trim(replace({out}, '  ', ' '), ' '))"

    rows = ", ".join(f"('{k}', '{quote(v)}')" for k, v in sorted(KNOWN.items()))
    return f"""
        with l(licence_id, text) as (values {rows}),
        k as (select {form('text')} as digest, min(licence_id) as licence_id from l group by 1),
        d as (select doc_id, {form('text')} as digest from documents)
        select doc_id, d.digest, licence_id from d left join k using (digest)
    """
