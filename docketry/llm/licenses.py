"""License scan by sentence rules.

A text is cut into sentences, which may be wrapped over lines; each is normalised (lower case, every run of other characters than a-z and
0-9 one space) and mapped to the identifier of a known licence sentence. The sequence of identifiers is
matched against ordered rules: a rule holds where its identifiers follow each other among the known sentences of a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import columns

#: Normalised sentences of public licences and notices.
SENTENCES = {
    "apache_notice": "licensed under the apache license version 2 0",
    "apache_compliance": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "apache_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    "mit_notice": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit_condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3_notice": "this work is licensed under the gnu general public license version 3",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_useful": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "cc_by_nc": "licensed under cc by nc 4 0",
    "cc_by": "licensed under cc by 4 0",
    "cc_by_sa": "licensed under cc by sa 4 0",
    "mpl_terms": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "spdx_apache": "spdx license identifier apache 2 0",
    "spdx_mit": "spdx license identifier mit",
    "spdx_gpl3": "spdx license identifier gpl 3 0 only",
    "rights_reserved": "all rights reserved",
}

#: Licence and sentence sequence of each rule.
RULES = [
    ("Apache-2.0", ("apache_notice",)),
    ("Apache-2.0", ("apache_compliance", "apache_copy")),
    ("Apache-2.0", ("spdx_apache",)),
    ("MIT", ("mit_notice",)),
    ("MIT", ("mit_licensed",)),
    ("MIT", ("mit_grant", "mit_condition")),
    ("MIT", ("spdx_mit",)),
    ("BSD-2-Clause", ("bsd_grant", "bsd_source", "bsd_binary")),
    ("BSD-3-Clause", ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names")),
    ("GPL-3.0", ("gpl3_notice",)),
    ("GPL-3.0", ("gpl_free", "gpl_useful")),
    ("GPL-3.0", ("spdx_gpl3",)),
    ("CC-BY-NC-4.0", ("cc_by_nc",)),
    ("CC-BY-4.0", ("cc_by",)),
    ("CC-BY-SA-4.0", ("cc_by_sa",)),
    ("MPL-2.0", ("mpl_terms",)),
    ("Proprietary", ("rights_reserved",)),
]

#: A longer rule that holds replaces the shorter one it contains.
REPLACES = {"BSD-3-Clause": "BSD-2-Clause"}

def _gnu() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Sentences and rules of the GNU notices; a semicolon ends a sentence, a colon or comma within a line does not."""
    texts, rules = {}, []
    for name, article, version, license in (
        ("gpl2", "general", "2", "GPL-2.0"), ("gpl", "general", "3", "GPL-3.0"), ("agpl", "affero general", "3", "AGPL-3.0"),
        ("lgpl21", "lesser general", "2 1", "LGPL-2.1"), ("lgpl", "lesser general", "3", "LGPL-3.0"),
    ):
        for it in ("program", "library"):
            useful = f"this {it} is distributed in the hope that it will be useful but without any warranty"
            texts[useful] = "gpl_useful"
            terms = f"you can redistribute it and or modify it under the terms of the gnu {article} public license as published by the free software foundation"
            later = f"either version {version} of the license or at your option any later version"
            start = f"this {it} is free software"
            texts[later] = "gnu_" + version.replace(" ", "_")
            texts[terms] = texts[f"{start} {terms}"] = article.replace(" ", "_") + "_terms"
            texts[f"{terms} {later}"] = texts[f"{start} {terms} {later}"] = f"{name}_free"
        rules.append((license, (f"{name}_free", "gpl_useful")))
        rules.append((license, (article.replace(" ", "_") + "_terms", "gnu_" + version.replace(" ", "_"), "gpl_useful")))
    return texts, rules


_GNU_TEXTS, _GNU_RULES = _gnu()
_MIT_GRANT = (
    SENTENCES["mit_grant"] + " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
    "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
)
_BSD_START = SENTENCES["bsd_grant"]

#: Sentences as they stand in whole licence texts, cut at WHOLE_END, and the identifiers they give.
WHOLE = {
    **_GNU_TEXTS,
    "licensed under the apache license version 2 0 the license": "apache_notice",
    SENTENCES["apache_as_is"] + " without warranties or conditions of any kind either express or implied": "apache_as_is",
    _MIT_GRANT: "mit_grant",
    f"{_MIT_GRANT} {SENTENCES['mit_condition']}": "mit_grant,mit_condition",
    SENTENCES["mit_as_is"] + " including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit_as_is",
    f"{_BSD_START} 1": "bsd_grant",
    f"{_BSD_START} {SENTENCES['bsd_source']}": "bsd_grant,bsd_source",
    "this source code form is subject to the terms of the mozilla public license v": "mpl_terms",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc_grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "bsd0_grant",
    "this is free and unencumbered software released into the public domain": "unlicense_free",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib_grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl_grant",
}

#: Rules for licences that only whole texts name.
WHOLE_RULES = [
    *_GNU_RULES, ("ISC", ("isc_grant",)), ("0BSD", ("bsd0_grant",)), ("Unlicense", ("unlicense_free",)),
    ("Zlib", ("zlib_grant",)), ("BSL-1.0", ("bsl_grant",)),
]

SENTENCE_END = "[.!?;:]+[ \\t\\r]*(?:\\n|\\z)|[.!?;]+[ \\t\\r]+|\\n"
#: The same for wrapped texts: a line break ends a sentence only after punctuation or before a blank line.
WHOLE_END = "[.!?;:]+[ \\t\\r]*(?:\\n|\\z)|[.!?;]+[ \\t\\r]+|\\n[ \\t\\r*/#>-]*(?=\\n|\\z)"
OTHER = "[^a-z0-9]+"


def _lookup(known: dict[str, str], parts: Column) -> Column:
    """What each part gives once it is normalised; unknown parts are left out."""
    table = F.create_map(*[F.lit(x) for item in known.items() for x in item])
    plain = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, OTHER, " ")))
    sizes = sorted({len(s) for s in known})
    # Sentences of other lengths are unknown; comparing a length costs less than looking one up.
    fit = F.filter(plain, lambda s: F.length(s).isin(sizes))
    return F.filter(F.transform(fit, lambda s: F.element_at(table, s)), lambda i: i.isNotNull())


def sentence_ids(text: Column, sentences: dict[str, str] | None = None) -> Column:
    """Identifiers of a text's known sentences, in order; null for null text.

    A sentence may be wrapped over lines. Where the whole is not known, each of its lines is looked up, so that
    a notice on a line of its own is found as well.
    """
    lines = {sentence: name for name, sentence in (sentences or SENTENCES).items()}
    whole = lines if sentences else lines | WHOLE

    def of(sentence: Column) -> Column:
        found = _lookup(whole, F.array(sentence))
        return F.when(F.size(found) > 0, found).otherwise(_lookup(lines, F.split(sentence, "\n")))

    ids = F.flatten(F.transform(F.split(F.lower(text), WHOLE_END), of))
    # One sentence may stand for several identifiers.
    return F.filter(F.split(F.array_join(ids, ","), ","), lambda i: i != "")


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", sentences: dict[str, str] | None = None,
    rules: list[tuple[str, tuple[str, ...]]] | None = None, replaces: dict[str, str] | None = None,
) -> DataFrame:
    """(doc_id, n_known, known, licenses), one row per row of ``docs``; lists are comma-separated strings.

    ``known`` has the sentence identifiers in order of the text, ``licenses`` each licence found once, in
    alphabetical order. Null and empty texts have none of either. Repeated rows are scanned one by
    one, two rules for one licence give it once. A narrow pass: each row is judged by its own text.
    """
    rules = [*RULES, *WHOLE_RULES] if rules is None else rules
    replaces = REPLACES if replaces is None else replaces
    own = columns(docs, doc_id=key, text=text).select(
        "doc_id", F.coalesce(sentence_ids(F.col("text"), sentences), F.array().cast("array<string>")).alias("ids")
    )
    own = own.select("doc_id", "ids", F.concat(F.lit(","), F.array_join("ids", ","), F.lit(",")).alias("path"))

    def holds(license: str) -> Column:
        found = F.lit(False)
        for name, sequence in rules:
            if name == license:
                found = found | F.contains("path", F.lit("," + ",".join(sequence) + ","))
        return found

    found = []
    for license in sorted({name for name, _ in rules}):
        hit = holds(license)
        for longer, shorter in replaces.items():
            if shorter == license:
                hit = hit & ~holds(longer)
        found.append(F.when(hit, F.lit(license)))
    return own.select(
        "doc_id", F.size("ids").alias("n_known"), F.array_join("ids", ",").alias("known"),
        F.concat_ws(",", *found).alias("licenses"),
    )
