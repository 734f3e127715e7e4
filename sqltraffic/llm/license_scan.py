"""Licence scan by sentence rules.

A text is cut into sentences at full stops and the like, and at empty lines (also those of comments). Each is
normalised (lower case, runs of anything but letters, digits and the dots of version numbers become one
blank), so that notices match whether they are wrapped or not; a sentence over several lines that is not known as a whole counts
by its lines. Slots come next: the name of an organisation, and the words that lead to a licence's name, are put as SLOTS
says. A sentence that is among SENTENCES then has an identifier; those of FOLLOWERS have one only right after the sentence
that they are listed under. What follows the tag line's name is read as an expression: its parts, joined by AND and OR and without
exceptions, are looked up each. A document's identifiers in order make a sequence, and the ordered rules of RULES are matched against
it: a rule's identifiers have to occur in its order, with at most GAP other sentences between two of them.
The first rule that matches at a place wins it; a document's licences are those of all places.

All of it is DataFrame functions on each row by itself: nothing is shuffled, and one document, group
or source of any size makes no difference. A null or empty text has no licence. Repeated rows
are scanned alike; an empty table gives no rows; other columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots: how a sentence begins, the pattern that is put into other words, and those. Fixed values.
SLOTS = [
    ("neither the name", "^neither the name of .{1,120}? nor the names of its contributors may", "neither the name of the holder nor the names of its contributors may"),
    ("neither the name", "^neither the names? of .{1,120}? nor the names of .{1,60}? contributors may", "neither the name of the holder nor the names of its contributors may"),
    ("", "^((this|the) (project|software|code|source code|file|work|program|package|library|module|repository) is )?(licensed|released|distributed|available|made available) under (the )?(terms of the )?", "licensed under "),
]
_GPL = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation"
_LATER = "either version {} of the license or at your option any later version"
#: Normalised sentences, as the cutting below leaves them, and their identifiers: fixed values.
SENTENCES = {
    "licensed under apache license version 2.0": "apache-grant",
    "licensed under apache license version 2.0 the license": "apache-grant",
    "licensed under apache license 2.0": "apache-grant",
    "licensed under apache 2.0 license": "apache-grant",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "you may obtain a copy of the license at http www.apache.org licenses license 2.0": "apache-copy",
    "licensed under mit license": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-permission",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-permission",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-permission",
    "licensed under isc license": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-permission",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-permission",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost-permission",
    "licensed under boost software license version 1.0": "boost-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-dedication",
    "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide": "cc0-dedication",
    "licensed under gnu general public license version 3": "gpl3-grant",
    "licensed under gnu general public license version 2": "gpl2-grant",
    "licensed under gnu affero general public license version 3": "agpl3-grant",
    "this program is free software": "gpl-free",
    "this library is free software": "gpl-free",
    **{f"{_GPL.format('general public license')} {_LATER.format(n)}": f"gpl{n}-later" for n in (2, 3)},
    **{f"{_GPL.format('general public license')} version {n} of the license": f"gpl{n}-terms" for n in (2, 3)},
    **{f"you can redistribute it and or modify it under the terms of the gnu general public license version {n} as published by the free software foundation": f"gpl{n}-terms" for n in (2, 3)},
    **{f"{_GPL.format('lesser general public license')} {_LATER.format(n)}": f"lgpl{n}-later" for n in ("2.1", "3")},
    f"{_GPL.format('affero general public license')} {_LATER.format(3)}": "agpl3-later",
    _GPL.format("general public license"): "gpl-terms",
    _GPL.format("lesser general public license"): "lgpl-terms",
    _GPL.format("affero general public license"): "agpl-terms",
    "licensed under cc by nc 4.0": "cc-by-nc-grant",
    "licensed under cc by 4.0": "cc-by-grant",
    "licensed under cc by sa 4.0": "cc-by-sa-grant",
    "licensed under a creative commons attribution 4.0 international license": "cc-by-grant",
    "licensed under a creative commons attribution sharealike 4.0 international license": "cc-by-sa-grant",
    "licensed under a creative commons attribution noncommercial 4.0 international license": "cc-by-nc-grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-permission",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this source code form is subject to the terms of the mozilla public license v": "mpl-form",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0": "epl-terms",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v": "epl-form",
    "spdx license identifier": "spdx",
}
#: Sentences that are known only right after those of an identifier: fixed values.
FOLLOWERS = {
    ("mpl-form", "2.0"): "version-2",
    ("epl-form", "2.0 which accompanies this distribution"): "version-2",
    **{(f"{family}-terms", _LATER.format(n)): f"version-{n}-later" for family, numbers in (("gpl", ("2", "3")), ("lgpl", ("2.1", "3")), ("agpl", ("3",))) for n in numbers},
    **{("gpl-terms", f"version {n} of the license"): f"version-{n}-only" for n in ("2", "3")},
}
#: The tag line, which a colon cuts in two: its name's identifier, and the licences' short names, as normalised: fixed values.
TAG_NAME = "spdx"
TAGS = {
    "apache 2.0": "apache-tag",
    "mit": "mit-tag",
    "isc": "isc-tag",
    "0bsd": "0bsd-tag",
    "zlib": "zlib-tag",
    "bsl 1.0": "boost-tag",
    "unlicense": "unlicense-tag",
    "cc0 1.0": "cc0-tag",
    "epl 2.0": "epl-tag",
    "gpl 3.0": "gpl3-tag",
    "gpl 3.0 only": "gpl3-tag",
    "gpl 3.0 or later": "gpl3-later-tag",
    "gpl 2.0": "gpl2-tag",
    "gpl 2.0 only": "gpl2-tag",
    "gpl 2.0 or later": "gpl2-later-tag",
    "lgpl 2.1": "lgpl2.1-tag",
    "lgpl 2.1 only": "lgpl2.1-tag",
    "lgpl 2.1 or later": "lgpl2.1-later-tag",
    "lgpl 3.0": "lgpl3-tag",
    "lgpl 3.0 only": "lgpl3-tag",
    "lgpl 3.0 or later": "lgpl3-later-tag",
    "agpl 3.0": "agpl3-tag",
    "agpl 3.0 only": "agpl3-tag",
    "agpl 3.0 or later": "agpl3-later-tag",
    "bsd 3 clause": "bsd3-tag",
    "bsd 2 clause": "bsd2-tag",
    "mpl 2.0": "mpl-tag",
    "cc by 4.0": "cc-by-tag",
    "cc by sa 4.0": "cc-by-sa-tag",
    "cc by nc 4.0": "cc-by-nc-tag",
}
#: In a tag's expression: an exception, which is left out, and what joins two licences.
EXCEPTION, JOINS = r" with [a-z0-9. ]*?exception( [0-9.]+)?", " (and|or) "
#: Rules in order of precedence, from more to fewer sentences: fixed values.
RULES = [
    ("BSD-3-Clause", ["bsd-permission", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-permission", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-grant", "apache-compliance", "apache-copy"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-terms", "version-3-later"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-terms", "version-2-later"]),
    ("GPL-3.0", ["gpl-free", "gpl-terms", "version-3-only"]),
    ("GPL-2.0", ["gpl-free", "gpl-terms", "version-2-only"]),
    ("LGPL-2.1-or-later", ["gpl-free", "lgpl-terms", "version-2.1-later"]),
    ("LGPL-3.0-or-later", ["gpl-free", "lgpl-terms", "version-3-later"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl-terms", "version-3-later"]),
    ("MIT", ["mit-permission", "mit-notice"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl2-later"]),
    ("GPL-3.0", ["gpl-free", "gpl3-terms"]),
    ("GPL-2.0", ["gpl-free", "gpl2-terms"]),
    ("LGPL-2.1-or-later", ["gpl-free", "lgpl2.1-later"]),
    ("LGPL-3.0-or-later", ["gpl-free", "lgpl3-later"]),
    ("AGPL-3.0-or-later", ["gpl-free", "agpl3-later"]),
    ("MPL-2.0", ["mpl-form", "version-2"]),
    ("EPL-2.0", ["epl-form", "version-2"]),
    ("Apache-2.0", ["apache-grant"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-permission"]),
    ("ISC", ["isc-permission"]),
    ("ISC", ["isc-grant"]),
    ("0BSD", ["0bsd-permission"]),
    ("Zlib", ["zlib-permission"]),
    ("BSL-1.0", ["boost-permission"]),
    ("BSL-1.0", ["boost-grant"]),
    ("Unlicense", ["unlicense-dedication"]),
    ("CC0-1.0", ["cc0-dedication"]),
    ("EPL-2.0", ["epl-terms"]),
    ("GPL-3.0-or-later", ["gpl3-later"]),
    ("GPL-2.0-or-later", ["gpl2-later"]),
    ("LGPL-2.1-or-later", ["lgpl2.1-later"]),
    ("LGPL-3.0-or-later", ["lgpl3-later"]),
    ("AGPL-3.0-or-later", ["agpl3-later"]),
    ("GPL-3.0", ["gpl3-grant"]),
    ("GPL-2.0", ["gpl2-grant"]),
    ("AGPL-3.0", ["agpl3-grant"]),
    ("GPL-3.0", ["gpl3-terms"]),
    ("GPL-2.0", ["gpl2-terms"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-grant"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-grant"]),
    ("CC-BY-4.0", ["cc-by-grant"]),
    ("Apache-2.0", ["apache-tag"]),
    ("MIT", ["mit-tag"]),
    ("ISC", ["isc-tag"]),
    ("0BSD", ["0bsd-tag"]),
    ("Zlib", ["zlib-tag"]),
    ("BSL-1.0", ["boost-tag"]),
    ("Unlicense", ["unlicense-tag"]),
    ("CC0-1.0", ["cc0-tag"]),
    ("EPL-2.0", ["epl-tag"]),
    ("GPL-3.0-or-later", ["gpl3-later-tag"]),
    ("GPL-2.0-or-later", ["gpl2-later-tag"]),
    ("GPL-3.0", ["gpl3-tag"]),
    ("GPL-2.0", ["gpl2-tag"]),
    ("LGPL-2.1-or-later", ["lgpl2.1-later-tag"]),
    ("LGPL-2.1", ["lgpl2.1-tag"]),
    ("LGPL-3.0-or-later", ["lgpl3-later-tag"]),
    ("LGPL-3.0", ["lgpl3-tag"]),
    ("AGPL-3.0-or-later", ["agpl3-later-tag"]),
    ("AGPL-3.0", ["agpl3-tag"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-tag"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-tag"]),
    ("CC-BY-4.0", ["cc-by-tag"]),
    ("MPL-2.0", ["mpl-tag"]),
    ("BSD-3-Clause", ["bsd3-tag"]),
    ("BSD-2-Clause", ["bsd2-tag"]),
]
#: Sentences of other kinds that may stand between two of a rule.
GAP = 3
#: A sentence ends at a sign that blanks follow, or at a line that is empty but for signs of a comment.
SENTENCE_END = r"[.;:!?]+[ \t\r\n]+|\n[ \t\r#*/;%-]*\n"
#: What is taken out of a line: other signs, then dots that do not stand inside a number or name.
SIGNS, DOTS_BEFORE, DOTS_AFTER = r"[^a-z0-9.]+", r"(^| )\.+", r"\.+( |$)"


def _clean(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, SIGNS, " "), DOTS_BEFORE, " "), DOTS_AFTER, " "))


def _map(of: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in of.items() for x in pair])


def _slotted(sentence: Column) -> Column:
    """The sentence with its slots put into the words that SENTENCES has."""
    for begins, found, put in SLOTS:
        changed = F.regexp_replace(sentence, found, put)
        sentence = F.when(sentence.startswith(begins), changed).otherwise(sentence) if begins else changed
    return sentence


def sentences(text: Column) -> Column:
    """Array of normalised sentences, empty ones left out: whole where they are known or of one line, else by their lines."""
    known = _map(SENTENCES | {sentence: i for (_, sentence), i in FOLLOWERS.items()})
    lines = F.transform(F.split(F.lower(text), SENTENCE_END), lambda piece: F.filter(F.transform(F.split(piece, r"\n"), _clean), lambda s: s != ""))
    whole = lambda own: _slotted(F.array_join(own, " "))
    return F.flatten(F.transform(lines, lambda own: F.when((F.size(own) > 1) & F.map_contains_key(known, whole(own)), F.array(whole(own))).otherwise(F.transform(own, _slotted))))


def _expression(tag: Column) -> Column:
    """The identifiers of a tag line's licences, null for one that has none."""
    parts = F.split(F.replace(F.regexp_replace(tag, EXCEPTION, ""), F.lit(" or later"), F.lit(" later")), JOINS)
    tags = _map({k.replace(" or later", " later"): v for k, v in TAGS.items()})
    return F.transform(parts, lambda part: F.try_element_at(tags, part))


def sentence_ids(text: Column) -> Column:
    """Array of the sentences' identifiers, null for a sentence that has none. A tag line's expression gives as many as it has licences."""
    known, followers = _map(SENTENCES), _map({f"{before} {sentence}": i for (before, sentence), i in FOLLOWERS.items()})

    def identified(seq: Column) -> Column:
        before = lambda i: F.try_element_at(known, F.get(seq, i - 1))
        own = lambda s, i: F.coalesce(F.try_element_at(known, s), F.try_element_at(followers, F.concat(before(i), F.lit(" "), s)))
        return F.flatten(F.transform(seq, lambda s, i: F.when(before(i) == TAG_NAME, _expression(s)).otherwise(F.array(own(s, i)))))

    return F.get(F.transform(F.array(sentences(text)), identified), F.lit(0))  # an array of one array: so the sentences are made once


def pattern(needs: list[str]) -> str:
    """A rule's identifiers in order, with at most GAP others between two."""
    return rf"(?:(?:\.|<[^>]*>){{0,{GAP}}}?)".join(f"<{i}>" for i in needs)


def matches(ids: Column) -> Column:
    """The licences whose rules match the identifiers, each once, in the rules' order.

    The sequence is written as one string, `<id>` for a known sentence and `.` for another. A rule that
    matched takes its sentences away before the next is tried.
    """
    sequence = F.array_join(F.transform(ids, lambda i: F.coalesce(F.concat(F.lit("<"), i, F.lit(">")), F.lit("."))), "")
    start = F.struct(sequence.alias("left"), F.lit(None).cast("array<string>").alias("found"))
    state = start.withField("found", F.array().cast("array<string>"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern(needs)).alias("pattern")) for name, needs in RULES])

    def try_rule(so_far: Column, rule: Column) -> Column:
        rest = F.regexp_replace(so_far["left"], rule["pattern"], ".")
        hit = F.regexp_like(so_far["left"], rule["pattern"])
        return F.when(hit, F.struct(rest.alias("left"), F.array_append(so_far["found"], rule["name"]).alias("found"))).otherwise(so_far)

    return F.array_distinct(F.aggregate(rules, state, try_rule)["found"])


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each document packed as `row`, with sentence_ids (known ones, in order) and licenses."""
    rows = docs.select(F.struct("*").alias("row"), sentence_ids(F.col(text)).alias("ids"))
    known = F.exists("ids", lambda i: i.isNotNull())
    none = F.array().cast("array<string>")
    return rows.select(
        "row",
        F.when(known, F.filter("ids", lambda i: i.isNotNull())).otherwise(none).alias("sentence_ids"),
        F.when(known, matches(F.col("ids"))).otherwise(none).alias("licenses"),
    )
