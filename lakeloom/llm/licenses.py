"""Licence scans by sentence rules: normalised sentences become identifiers, sequences of identifiers become licences.

A text is cut into sentences at lines without letters and digits and after `.`, `!` and `?`, but not in `v. 2.0`. A sentence
is normalised to lower-case ASCII letters, digits, `.` and `+`, one blank between words, and looked up among SENTENCES; those
not known are passed over. A sentence that refers to licences (`licensed under either of ...`) gives an identifier for each of the NAMES
that follow each other there, an SPDX expression one for each of its identifiers; operators, exceptions and brackets aren't reported, but for
the choice of Apache-2.0 and MIT, which has a rule of its own. At other line ends (signs, `dnl` or `rem` before the next line's words
are left out) and after `;` and `:` a sentence may end or go on: both readings are looked up. OP4_SQL is narrower: it always ends a
sentence there and after `v.`, so it agrees only on texts whose known sentences don't cross such places. The known ones, in order,
form the document's sequence. RULES are tried from first to last: a rule whose identifiers follow each other
in the sequence names its licence and takes them out of the sequence, wherever they occur. What is left over at the end is
reported as `unmatched`.

Defined results: null and empty texts have no sentences; rows that repeat are scanned alike; texts, titles, names and copyright
lines count whole, however long; further columns aren't looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: What may stand before a phrase in its sentence: a title, a copyright line, the work's name. GAP: anything inside a sentence.
LEAD, GAP = r"(?:.* )?", "<>"
#: Public licence wording, as patterns of whole normalised sentences (fixed values).
SENTENCES = {
    "ApacheUnder": r"licensed under the apache license version 2.0 the license",
    "ApacheComply": r"you may not use this file except in compliance with the license",
    "ApacheCopy": r"you may obtain a copy of the license at(?: http.*)?",
    "ApacheAsIs": r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "ApacheLimits": r"see the license for the specific language governing permissions and limitations under the license",
    "MitGrant": LEAD + r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction.*",
    "MitNotice": r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "MitAsIs": r"the software is provided as is without warranty of any kind express or implied.*",
    "MitLiability": r"in no event shall the authors or copyright holders be liable for any claim.*",
    "GplRedistribute3": LEAD + r"is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GplRedistribute2": LEAD + r"is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "LgplRedistribute": LEAD + r"is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version .*",
    "AgplRedistribute": LEAD + r"is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "GplHope": LEAD + r"is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "GplDetails": r"see the gnu (?:lesser |affero )?general public license for more details",
    "GplReceived": r"you should have received a copy of the gnu (?:lesser |affero )?general public license along with this .*",
    "BsdGoverned": LEAD + r"governed by a (?:[23] clause )?bsd (?:style )?license(?: that .*)?",
    "BsdPermit": LEAD + r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "BsdSource": r"(?:[1-3a-c.]+ )?redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "BsdBinary": r"(?:[1-3a-c.]+ )?redistributions in binary form must reproduce the above copyright notice.*",
    "BsdEndorse": r"(?:[1-3a-c.]+ )?neither the name of <> may be used to endorse or promote products derived from this software without specific prior written permission",
    "BsdAsIs": r"this software is provided by <> as is and any express or implied warranties.*",
    "BsdLiability": r"in no event shall <> be liable for any direct indirect incidental special exemplary or consequential damages.*",
    "MplTerms": r"this source code form is subject to the terms of the mozilla public license v. 2.0",
    "MplCopy": r"if a copy of the mpl was not distributed with this file you can obtain one at .*",
    "IscPermit": LEAD + r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "UnlicenseDedicate": r"this is free and unencumbered software released into the public domain",
    "EplTerms": r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v. )?2.0(?: which .*)?",
    "ZlibAsIs": r"this software is provided as is without any express or implied warranty",
    "ZlibPermit": r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "OflTerms": LEAD + r"this font software is licensed under the sil open font license version 1.1",
    "Cc0Dedicate": r"to the extent possible under law <> dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "MitTitle": r"(?:the )?mit license(?: mit)?",
    "ApacheTitle": r"apache license(?: version)? 2.0(?: january 2004)?",
    "IscTitle": r"(?:the )?isc license",
    "UnlicenseTitle": r"the unlicense",
    "BoostTitle": r"boost software license version 1.0(?: august 17th 2003)?",
}
_NUMBER = r"(?:(?: version)? ?v?.? ?%s)"
#: Names of licences where a sentence refers to them, the longer of those that begin alike first (fixed values).
NAMES = {
    "ApacheRef": rf"apache(?: software)?(?: license)?{_NUMBER % '2(?:.0)?'}(?: license)?",
    "MitRef": r"(?:mit|expat) license|mit",
    "AgplRef": rf"(?:gnu )?(?:agpl|affero general public license)(?:{_NUMBER % '3(?:.0)?'})?",
    "LgplRef": rf"(?:gnu )?(?:lgpl|lesser general public license|library general public license)(?:{_NUMBER % '(?:2.1|2.0|3.0|2|3)'})?",
    "GplRef3": rf"(?:gnu )?(?:gpl|general public license){_NUMBER % '3(?:.0)?'}",
    "GplRef2": rf"(?:gnu )?(?:gpl|general public license){_NUMBER % '2(?:.0)?'}",
    "MplRef": rf"(?:mpl|mozilla public license){_NUMBER % '2(?:.0)?'}",
    "EplRef": rf"(?:epl|eclipse public license){_NUMBER % '2(?:.0)?'}",
    "BsdRef3": r"bsd 3 clause(?: license)?|(?:3 clause|new|revised|modified) bsd(?: license)?",
    "BsdRef2": r"bsd 2 clause(?: license)?|(?:2 clause|simplified|freebsd) bsd(?: license)?",
    "BsdRef": r"bsd(?: style)? license",
    "BoostRef": r"boost software license(?: version)?(?: 1.0)?",
    "IscRef": r"isc license",
    "ZlibRef": r"zlib license",
    "OflRef": rf"(?:sil )?open font license(?:{_NUMBER % '1.1'})?",
    "UnlicenseRef": r"unlicense",
    "Cc0Ref": r"(?:creative commons )?cc0(?: 1.0)?(?: universal)?(?: license)?",
    "CcByNcSaRef": r"(?:cc by nc sa|creative commons attribution noncommercial sharealike)(?: license)?(?: [34].0)?",
    "CcByNcNdRef": r"(?:cc by nc nd|creative commons attribution noncommercial noderiv(?:ative)?s)(?: license)?(?: [34].0)?",
    "CcByNcRef": r"(?:cc by nc|creative commons attribution noncommercial)(?: license)?(?: 4.0)?",
    "CcByNdRef": r"(?:cc by nd|creative commons attribution noderiv(?:ative)?s)(?: license)?(?: [34].0)?",
    "CcBySaRef": r"(?:cc by sa|creative commons attribution sharealike)(?: license)?(?: [34].0)?",
    "CcByRef": r"(?:cc by|creative commons attribution)(?: license)?(?: [34].0)?",
}
#: Identifiers of SPDX expressions (fixed values).
_LATER = r"(?: only| or later|\+)?"
SPDX = {
    "SpdxApache": r"apache 2.0", "SpdxMit": r"mit", "SpdxAgpl3": rf"agpl 3.0{_LATER}", "SpdxLgpl": rf"lgpl (?:2.0|2.1|3.0){_LATER}", "SpdxGpl3": rf"gpl 3.0{_LATER}", "SpdxGpl2": rf"gpl 2.0{_LATER}",
    "SpdxBsd3": r"bsd 3 clause", "SpdxBsd2": r"bsd 2 clause", "SpdxMpl2": r"mpl 2.0", "SpdxEpl2": r"epl 2.0", "SpdxBoost": r"bsl 1.0", "SpdxZlib": r"zlib", "SpdxIsc": r"isc", "SpdxCc0": r"cc0 1.0", "SpdxUnlicense": r"unlicense",
    "SpdxOfl": r"ofl 1.1", "SpdxCcByNcSa": r"cc by nc sa [34].0", "SpdxCcByNcNd": r"cc by nc nd [34].0", "SpdxCcByNc": r"cc by nc [34].0", "SpdxCcByNd": r"cc by nd [34].0", "SpdxCcBySa": r"cc by sa [34].0", "SpdxCcBy": r"cc by [34].0",
}
_either = lambda patterns: "|".join(f"(?:{p})" for p in patterns.values())
#: A reference: that something is licensed, then names with words that join them. An expression: names joined by operators, the brackets gone.
_JOIN = r"(?: (?:the|a|an|of|either|both|terms|conditions|or|and|plus|with|at your option|version|license|under|your choice))*"
NAMED = rf"(?:licensed|released|distributed|available|published|provided|covered|governed) (?:under|by){_JOIN} (?:{_either(NAMES)})\b(?:{_JOIN} (?:{_either(NAMES)})\b)*"
EXCEPTION = r"(?: with (?:classpath|gcc|llvm|autoconf|bison|font|linux syscall|openssl)(?: runtime| library)?(?: exception| note)?(?: [0-9.]+)?)?"
EXPRESSION = rf"spdx license identifier (?:{_either(SPDX)}){EXCEPTION}(?: (?:and|or) (?:{_either(SPDX)}){EXCEPTION})*"
#: Of these a sentence gives an identifier for each name in it, in order; of the two that stand for a choice of their own, one.
CHOICE = r"spdx license identifier (?:apache 2.0 or mit|mit or apache 2.0)"
#: Ordered: full texts and headers before references, longer sequences before their parts.
RULES = [
    ("Apache-2.0", ["ApacheUnder", "ApacheComply", "ApacheCopy", "ApacheAsIs", "ApacheLimits"]),
    ("Apache-2.0", ["ApacheUnder", "ApacheComply"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs", "MitLiability"]),
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs"]),
    ("ISC", ["IscPermit"]),
    ("BSD-3-Clause", ["BsdPermit", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdPermit", "BsdSource", "BsdBinary"]),
    ("GPL-3.0-or-later", ["GplRedistribute3", "GplHope", "GplDetails"]),
    ("GPL-3.0-or-later", ["GplRedistribute3"]),
    ("GPL-2.0-or-later", ["GplRedistribute2", "GplHope", "GplDetails"]),
    ("GPL-2.0-or-later", ["GplRedistribute2"]),
    ("LGPL", ["LgplRedistribute", "GplHope", "GplDetails"]),
    ("LGPL", ["LgplRedistribute"]),
    ("AGPL-3.0-or-later", ["AgplRedistribute", "GplHope", "GplDetails"]),
    ("AGPL-3.0-or-later", ["AgplRedistribute"]),
    ("EPL-2.0", ["EplTerms"]),
    ("Zlib", ["ZlibAsIs", "ZlibPermit"]),
    ("Zlib", ["ZlibPermit"]),
    ("CC0-1.0", ["Cc0Dedicate"]),
    ("MPL-2.0", ["MplTerms", "MplCopy"]),
    ("MPL-2.0", ["MplTerms"]),
    ("Unlicense", ["UnlicenseDedicate"]),
    ("Apache-2.0 OR MIT", ["SpdxApacheMit"]), ("BSD-2-Clause", ["SpdxBsd2"]), ("AGPL-3.0", ["SpdxAgpl3"]), ("LGPL", ["SpdxLgpl"]), ("MPL-2.0", ["SpdxMpl2"]), ("EPL-2.0", ["SpdxEpl2"]),
    ("BSL-1.0", ["SpdxBoost"]), ("Zlib", ["SpdxZlib"]), ("ISC", ["SpdxIsc"]), ("CC0-1.0", ["SpdxCc0"]), ("Unlicense", ["SpdxUnlicense"]),
    ("Apache-2.0", ["SpdxApache"]), ("MIT", ["SpdxMit"]), ("GPL-3.0", ["SpdxGpl3"]), ("GPL-2.0", ["SpdxGpl2"]), ("BSD-3-Clause", ["SpdxBsd3"]),
    ("OFL-1.1", ["SpdxOfl"]), ("CC-BY-NC-SA", ["SpdxCcByNcSa"]), ("CC-BY-NC-ND", ["SpdxCcByNcNd"]), ("CC-BY-NC-4.0", ["SpdxCcByNc"]), ("CC-BY-ND", ["SpdxCcByNd"]), ("CC-BY-SA", ["SpdxCcBySa"]), ("CC-BY", ["SpdxCcBy"]),
    ("OFL-1.1", ["OflTerms"]), ("BSD", ["BsdGoverned"]),
    ("Apache-2.0", ["ApacheRef"]), ("MIT", ["MitRef"]), ("GPL-3.0", ["GplRef3"]), ("GPL-2.0", ["GplRef2"]), ("LGPL", ["LgplRef"]), ("AGPL-3.0", ["AgplRef"]), ("MPL-2.0", ["MplRef"]), ("EPL-2.0", ["EplRef"]),
    ("BSD-3-Clause", ["BsdRef3"]), ("BSD-2-Clause", ["BsdRef2"]), ("BSD", ["BsdRef"]), ("BSL-1.0", ["BoostRef"]), ("ISC", ["IscRef"]), ("Zlib", ["ZlibRef"]), ("OFL-1.1", ["OflRef"]), ("Unlicense", ["UnlicenseRef"]), ("CC0-1.0", ["Cc0Ref"]),
    ("CC-BY-NC-SA", ["CcByNcSaRef"]), ("CC-BY-NC-ND", ["CcByNcNdRef"]), ("CC-BY-NC-4.0", ["CcByNcRef"]), ("CC-BY-ND", ["CcByNdRef"]), ("CC-BY-SA", ["CcBySaRef"]), ("CC-BY", ["CcByRef"]),
    ("MIT", ["MitTitle"]), ("Apache-2.0", ["ApacheTitle"]), ("ISC", ["IscTitle"]), ("Unlicense", ["UnlicenseTitle"]), ("BSL-1.0", ["BoostTitle"]),
]
#: Words of which every pattern above has at least one; texts without any need no look-up.
TRIGGER = r"(?i:licen[sc]e|(?:released|distributed|available|published|provided|covered|governed)\s+(?:under|by)|free\W+software|permi(?:t|ssion)|copyright\W+notice|warrant|as\W+is|liable|redistribut|endorse|mpl\W+was|public\W+domain|cc0)"
JUNK = r"[^A-Za-z0-9.+]+"


def normal_text(text: Column) -> Column:
    """The text's normalised pieces: a carriage return ends a sentence, a line feed is a place where one may end or go on."""
    out = F.regexp_replace(text, r"\r\n?", "\n")
    out = F.regexp_replace(out, r"(?m)^[ \t]*(?:dnl|rem|REM)\b", "")
    out = F.regexp_replace(out, r"\b([vV]\.)[^A-Za-z0-9.+]+(?=[0-9])", "$1 ")
    out = F.regexp_replace(out, r"\n[^A-Za-z0-9\r]*\n", "\r")
    out = F.regexp_replace(out, r"((?<!\b[vV])[.!?]|[.!?](?=[ \t\n]+[^0-9 \t\n]))[ \t\n]+", "$1\r")
    out = F.regexp_replace(out, r"[;:][ \t]+", "\n")
    out = F.lower(F.regexp_replace(out, r"[^A-Za-z0-9.+\n\r]+", " "))
    # Each run of blanks, dots and breaks is entered at its start only, so that long runs take linear time.
    out = F.regexp_replace(out, r"(?<![ .\n\r])[ .\n\r]*\r[ .\n\r]*", "\r")
    out = F.regexp_replace(out, r"(?<![ .\n])[ .\n]*\n[ .\n]*", "\n")
    return F.regexp_replace(out, r"^[ .\n\r]+|(?<![ .\n\r])[ .\n\r]+\z", "")


def _across(pattern: str) -> str:
    """A pattern for the normalised text: its blanks and gaps may hold a line feed, what follows its end may not. A lead isn't looked for, so a phrase is found where it begins."""
    pattern = pattern.removeprefix(LEAD)
    opening = " ".join(pattern.split(GAP)[0].replace("(?:[1-3a-c.]+ )?", "").split()[:4])
    gap = rf"(?:(?!{opening})[^\r])+?"  # a gap ends where its phrase begins anew, so that many openings take linear time
    parts = [re.sub(r"\[[^]]*\]|\.\*|[. ]", lambda m: {" ": r"[ \n]", ".*": r"[^\n\r]*", ".": r"[^\n\r]"}.get(m[0], m[0]), part) for part in pattern.split(GAP)]
    return gap.replace(" ", r"[ \n]").join(parts)


ACROSS = {name: _across(pattern) for name, pattern in SENTENCES.items()}
WHOLE = rf"(?:{'|'.join(ACROSS[n] for n in ACROSS if not SENTENCES[n].startswith(LEAD))}|{_across(CHOICE)}|{_across(EXPRESSION)})(?![^\n\r])"
ANY = rf"(?<![^\n\r]){WHOLE}|(?<![^ \n\r])(?:(?:{'|'.join(ACROSS[n] for n in ACROSS if SENTENCES[n].startswith(LEAD))})(?![^\n\r])|{_across(NAMED)})"


def _named(name: Column, patterns: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for known, pattern in reversed(patterns.items()):
        out = F.when(name.rlike(rf"\A(?:{pattern})\z"), F.lit(known)).otherwise(out)
    return out


def sentence_ids(text: Column) -> Column:
    """The identifiers of the text's known sentences, in order."""

    def known(s: Column) -> Column:
        plain = F.regexp_replace(s, "\n", " ")
        each = lambda patterns: F.transform(F.regexp_extract_all(plain, F.lit(rf"\b(?:{_either(patterns)})\b"), F.lit(0)), lambda x: _named(x, patterns))
        after = F.regexp_replace(plain, "^spdx license identifier ", "")
        each_spdx = F.transform(F.regexp_extract_all(after, F.lit(_either(SPDX)), F.lit(0)), lambda x: _named(x, SPDX))
        one = F.lit(None).cast("string")
        for name, pattern in reversed(ACROSS.items()):
            one = F.when(s.rlike(rf"\A(?:{pattern})\z"), F.lit(name)).otherwise(one)
        one = F.when(s.rlike(rf"\A(?:{_across(CHOICE)})\z"), F.lit("SpdxApacheMit")).otherwise(one)
        return F.when(one.isNotNull(), F.array(one)).when(s.startswith("spdx"), each_spdx).otherwise(each(NAMES))

    ids = F.flatten(F.transform(F.regexp_extract_all(normal_text(text), F.lit(ANY), F.lit(0)), known))
    return F.when(text.rlike(TRIGGER), ids).otherwise(F.array().cast("array<string>"))


def apply_rules(sequence: Column) -> Column:
    """A struct of what is left of the sequence and the licences found, in the order of the rules."""
    rules = F.array(*(F.struct(F.lit("".join(f"<{i}>" for i in ids)).alias("ids"), F.lit(name).alias("name")) for name, ids in RULES))
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["left"], rule["ids"])
        return F.when(hit, F.struct(F.replace(acc["left"], rule["ids"], F.lit("")).alias("left"), F.array_union(acc["names"], F.array(rule["name"])).alias("names"))).otherwise(acc)

    return F.aggregate(rules, start, step)


def licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_sentences, sentence_ids, licenses, unmatched; lists are joined by commas, identifiers as <id>."""
    found = docs.select(F.col(id_col), sentence_ids(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("ids"))
    found = found.withColumn("sequence", F.array_join(F.transform("ids", lambda x: F.concat(F.lit("<"), x, F.lit(">"))), ""))
    found = found.withColumn("ruled", F.when(F.col("sequence") != "", apply_rules(F.col("sequence"))))
    return found.select(id_col, F.size("ids").cast("long").alias("n_sentences"), F.col("sequence").alias("sentence_ids"), F.coalesce(F.array_join("ruled.names", ","), F.lit("")).alias("licenses"), F.coalesce("ruled.left", F.lit("")).alias("unmatched"))


def op4_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences(table(spark, sf_dir, "documents"))


def _sql() -> str:
    text = lambda s: "'" + s.replace("'", "''") + "'"
    case = lambda s, patterns: "CASE " + " ".join(f"WHEN regexp_full_match({s}, {text(p.replace(GAP, '.+'))}) THEN '{n}'" for n, p in patterns.items()) + " END"
    one = f"CASE WHEN regexp_full_match(s, {text(CHOICE)}) THEN 'SpdxApacheMit' ELSE {case('s', SENTENCES)} END"
    spdx = f"list_transform(regexp_extract_all(regexp_replace(s, '^spdx license identifier ', ''), {text(_either(SPDX))}), lambda x: {case('x', SPDX)})"
    named = rf"list_transform(regexp_extract_all(regexp_extract(s, {text(NAMED)}), {text(rf'\b(?:{_either(NAMES)})\b')}), lambda x: {case('x', NAMES)})"
    each = f"CASE WHEN {one} IS NOT NULL THEN [{one}] WHEN regexp_full_match(s, {text(EXPRESSION)}) THEN {spdx} WHEN regexp_matches(s, {text(rf'(?:^| )(?:{NAMED})')}) THEN {named} ELSE [] END"
    out = rf"""SELECT doc_id, ids, list_aggregate(list_transform(ids, lambda x: '<' || x || '>'), 'string_agg', '') AS seq FROM (
  SELECT doc_id, flatten(list_transform(parts, lambda s: {each})) AS ids FROM (
    SELECT doc_id, list_transform(string_split_regex(regexp_replace(coalesce(text, ''), '([.!?;:])[ \t\r\n]+', '\1' || chr(10), 'g'), '\n+'),
      lambda s: lower(regexp_replace(regexp_replace(s, {text(JUNK)}, ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'))) AS parts FROM documents))"""
    out = f"SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(seq, '') AS sentence_ids, coalesce(seq, '') AS l, []::VARCHAR[] AS names FROM ({out})"
    for name, ids in RULES:
        rule = "".join(f"<{i}>" for i in ids)
        out = f"SELECT doc_id, n_sentences, sentence_ids, replace(l, '{rule}', '') AS l, CASE WHEN contains(l, '{rule}') AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names FROM ({out})"
    return f"SELECT doc_id, n_sentences, sentence_ids, coalesce(array_to_string(names, ','), '') AS licenses, l AS unmatched FROM ({out})"


OP4_SQL = _sql()
