"""License scans: known sentences by identifier, then ordered rules over identifier sequences.

Lines lose their comment marks. A text is cut into pieces at line ends and after . ! ? ; followed by white space. A known
sentence is one piece or several that follow each other without a blank line between them, so hard-wrapped texts and one-line
notices are both found; where several known sentences begin at a piece, the longest counts. Comparison is after
normalisation (ASCII lower case, runs of white space to one space, no quotes, no closing punctuation). What is left of a text
is its sequence of identifiers, in order, and rules, most specific first, are ordered sequences that must appear in a row
there. A text that has none of the words that every known sentence has at least one of is not cut at all.

Defined results: null and empty texts have no sentences. Rows that repeat an id each give their row; null ids pass through.
A sentence without a rule is reported in `sentences` and gives no licence. Other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webdelta.llm.common import text_of

#: The normalised sentences of public licence texts and notices, by identifier.
SENTENCES = {
    "mit-notice": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "mit-grant": ['permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions:'],
    "mit-condition": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-warranty": ["the software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"],
    "apache-notice": ["licensed under the apache license, version 2.0", "licensed under the apache license, version 2.0 (the license)"],
    "apache-compliance": ["you may not use this file except in compliance with the license"],
    "apache-warranty": ["unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied"],
    "gpl3-notice": ["this work is licensed under the gnu general public license, version 3", "licensed under the gnu general public license, version 3"],
    "gpl2-notice": ["this work is licensed under the gnu general public license, version 2", "licensed under the gnu general public license, version 2"],
    "gpl-later": ["this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version"],
    "gpl-warranty": ["this program is distributed in the hope that it will be useful, but without any warranty"],
    "ccbync-notice": ["licensed under cc by-nc 4.0", "this work is licensed under cc by-nc 4.0"],
    "ccby-notice": ["licensed under cc by 4.0", "this work is licensed under cc by 4.0"],
    "ccbysa-notice": ["licensed under cc by-sa 4.0", "this work is licensed under cc by-sa 4.0"],
    "bsd-redistribution": ["redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorsement": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "mpl-notice": ["this source code form is subject to the terms of the mozilla public license, v. 2.0"],
    "unlicense-notice": ["this is free and unencumbered software released into the public domain"],
}
#: Ordered rules, most specific first; a rule's identifiers must follow each other. What a rule has matched, later rules do not see.
RULES = [
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("Apache-2.0", ["apache-notice", "apache-compliance", "apache-warranty"]),
    ("GPL-3.0-or-later", ["gpl-later", "gpl-warranty"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorsement"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("MIT", ["mit-notice"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-2.0-only", ["gpl2-notice"]),
    ("GPL-3.0-or-later", ["gpl-later"]),
    ("CC-BY-NC-4.0", ["ccbync-notice"]),
    ("CC-BY-SA-4.0", ["ccbysa-notice"]),
    ("CC-BY-4.0", ["ccby-notice"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("Unlicense", ["unlicense-notice"]),
]
#: Each known sentence has one of these, in some case of its letters.
ANCHORS = "licen|permission|software|redistribut|warrant|copyright"
#: Known sentences from the start of a piece to the end of a piece, the longest first.
FIND = r"(?<=\n)[ #*/>-]*+(" + "|".join(re.escape(t).replace(r"\ ", r"[ \n]") for t in sorted((t for x in SENTENCES.values() for t in x), key=len, reverse=True)) + r")(?=[ .!?;]*\n)"


def pieces(text: Column) -> Column:
    """The normalised text with a line end before, between and after its pieces; blank lines stay empty pieces."""
    s = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ\"“”'‘’`", "abcdefghijklmnopqrstuvwxyz")
    s = F.regexp_replace(F.regexp_replace(s, r"\r\n?", "\n"), r"[ \t\x0b\x0c]+", " ")
    # Comment marks around a line. Java's $ is told that only \n ends a line.
    s = F.regexp_replace(F.regexp_replace(s, r"(?md)^[ #*/>-]+", ""), r"(?md) *(?:\*+/?)? *$", "")
    return F.concat(F.lit("\n"), F.regexp_replace(s, r"(?<=[.!?;]) ", "\n"), F.lit("\n"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, sentences (identifiers in order), licenses (distinct, in the order of the rules)."""
    known = F.create_map(*[F.lit(x) for name, texts in SENTENCES.items() for t in texts for x in (t, name)])
    text = text_of(docs, text_col)
    found = F.when(text.rlike(f"(?i){ANCHORS}"), F.transform(F.regexp_extract_all(pieces(text), F.lit(FIND), F.lit(1)), lambda s: F.element_at(known, F.translate(s, "\n", " ")))).otherwise(F.array().cast("array<string>"))
    rows = docs.select(docs[id_col].alias("id"), found.alias("sentences"))
    left = F.concat(F.lit("|"), F.array_join("sentences", "||"), F.lit("|"))
    rows, names = rows.withColumn("left", left), []
    for i, (_, sequence) in enumerate(RULES):
        # A matched run is replaced by a mark, so that nothing runs across it.
        run = "|" + "||".join(sequence) + "|"
        rows = rows.withColumns({f"r{i}": F.contains("left", F.lit(run)), "left": F.replace("left", F.lit(run), F.lit("#"))})
        names.append(F.when(F.col(f"r{i}"), F.lit(RULES[i][0])))
    return rows.select(F.col("id").alias(id_col), "sentences", F.array_distinct(F.array_compact(F.array(*names))).alias("licenses"))
