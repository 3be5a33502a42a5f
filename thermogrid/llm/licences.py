"""Licence recognition by sentence rules.

A text is brought to its words (lower case, single spaces), so that line ends, comment and list marks, quotes
and punctuation do not matter, and the known licence sentences are looked for in them, the longest first.  The
sequence of identifiers found is matched against ordered rules: a rule that matches takes its sentences away,
so that a more general rule further down does not report them again.  Identifiers in ``SINGLE`` name a licence
by themselves.

All tables are fixed and small, so they are literals of the plan, and nothing is shuffled.  The SQL knows
``SENTENCES`` only, each as a whole line or sentence.
"""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, normalised, and their identifiers.
SENTENCES = {
    "licensed under the apache license, version 2.0": "apache-2-ref",
    "licensed under the apache license, version 2.0 (the \"license\")": "apache-2-ref",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "see the license for the specific language governing permissions and limitations under the license": "apache-limits",
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "this work is licensed under the gnu general public license, version 3": "gpl-3-ref",
    "this work is licensed under the gnu general public license, version 2": "gpl-2-ref",
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version": "gpl-3-grant",
    "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version": "gpl-2-grant",
    "this program is distributed in the hope that it will be useful, but without any warranty": "gpl-warranty",
    "licensed under cc by-nc 4.0": "cc-by-nc-4-ref",
    "licensed under cc by 4.0": "cc-by-4-ref",
    "licensed under cc by-sa 4.0": "cc-by-sa-4-ref",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "this is free and unencumbered software released into the public domain": "unlicense-ref",
    "all rights reserved": "all-rights",
}
# Ordered rules, each a licence and the identifiers that follow one another.
RULES = (
    ("Apache-2.0", ("apache-2-ref", "apache-comply", "apache-copy", "apache-limits")),
    ("Apache-2.0", ("apache-2-ref", "apache-comply")),
    ("Apache-2.0", ("apache-2-ref",)),
    ("MIT", ("mit-ref", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-ref",)),
    ("GPL-3.0-or-later", ("gpl-3-grant", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl-2-grant", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl-3-grant",)),
    ("GPL-2.0-or-later", ("gpl-2-grant",)),
    ("GPL-3.0-only", ("gpl-3-ref",)),
    ("GPL-2.0-only", ("gpl-2-ref",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-ref",)),
    ("CC-BY-4.0", ("cc-by-4-ref",)),
    ("Unlicense", ("unlicense-ref",)),
)
#: What ends a sentence: a mark before white space or the end, or a line end.
BREAK = "[.!?]+[ \\t\\r]+|[.!?]*\\n+|[.!?]+$"

# More sentences and clauses of the licence texts, and their identifiers.
_FSF = "as published by the free software foundation"
_LATER = "or (at your option) any later version"
_MODIFY = "you can redistribute it and/or modify it under the terms of the gnu"
NOTICES = {
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-ads",
    "is distributed in the hope that it will be useful, but without any warranty": "gpl-warranty",
    **{f"{_MODIFY} {name} {_FSF}{either} version {v} of the license {_LATER}": f"{key}-grant" for (name, v, key), either in product((
        ("general public license", "2", "gpl-2"), ("general public license", "3", "gpl-3"), ("library general public license", "2", "lgpl-2"),
        ("lesser general public license", "2.1", "lgpl-2.1"), ("lesser general public license", "3", "lgpl-3"), ("affero general public license", "3", "agpl-3")), ("", " either"))},
    **{f"{_MODIFY} {name} {order}": f"{key}-ref" for name, v, key in (
        ("general public license", "2", "gpl-2"), ("general public license", "3", "gpl-3"), ("lesser general public license", "2.1", "lgpl-2.1"),
        ("lesser general public license", "3", "lgpl-3"), ("affero general public license", "3", "agpl-3")) for order in (f"version {v} {_FSF}", f"{_FSF} version {v}", f"{_FSF} version {v} of the license")},
    "this source code form is subject to the terms of the mozilla public license, v. 2.0": "mpl-2-ref",
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    **{f"permission to use, copy, modify, {also} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies": "isc-grant" for also in ("and/or", "and")},
    "permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl-grant",
    "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely": "zlib-grant",
    "anyone is free to copy, modify, publish, use, compile, sell, or distribute this software": "unlicense-grant",
}
# Names under which a text refers to a licence, after one of the verbs, and their identifiers.
VERBS = ("licensed under", "licenced under", "released under", "distributed under", "available under", "published under", "provided under", "under the terms of")
NAMES = {
    **{n: "apache-2-ref" for n in ("apache license, version 2.0", "apache license, version 2.0 (the \"license\")", "apache license 2.0", "apache 2.0 license", "apache-2.0", "apache-2.0 license")},
    **{n: "mit-ref" for n in ("mit license", "mit licence")},
    **{f"{n} {v}": f"{key}-ref" for names, v, key in (
        (("gnu general public license", "gnu general public license version", "gnu gpl version", "gpl version"), "2", "gpl-2"),
        (("gnu general public license", "gnu general public license version", "gnu gpl version", "gpl version"), "3", "gpl-3"),
        (("gnu lesser general public license version", "gnu lgpl version", "lgpl version"), "2.1", "lgpl-2.1"),
        (("gnu lesser general public license version", "gnu lgpl version", "lgpl version"), "3", "lgpl-3"),
        (("gnu affero general public license version", "gnu agpl version", "agpl version"), "3", "agpl-3")) for n in names},
    **{f"{n}{v}": f"{key}-ref" for n, v, key in (("gpl", "v2", "gpl-2"), ("gpl", "v3", "gpl-3"), ("gpl ", "v2", "gpl-2"), ("gpl ", "v3", "gpl-3"), ("agpl", "v3", "agpl-3"), ("lgpl", "v3", "lgpl-3"))},
    **{f"{n} 2.0": "mpl-2-ref" for n in ("mozilla public license", "mozilla public license version", "mozilla public license v.", "mpl")},
    "boost software license, version 1.0": "bsl-ref",
    **{n: "isc-ref" for n in ("isc license",)},
    **{n: "bsd-3-ref" for n in ("bsd 3-clause license", "3-clause bsd license", "bsd-3-clause", "bsd-3-clause license")},
    **{n: "bsd-2-ref" for n in ("bsd 2-clause license", "2-clause bsd license", "bsd-2-clause", "bsd-2-clause license")},
    **{f"{n}{kind} 4.0{tail}": f"cc-{key}-4-ref" for n, kinds in (
        ("cc ", (("by", "by"), ("by-nc", "by-nc"), ("by-sa", "by-sa"), ("by-nd", "by-nd"), ("by-nc-sa", "by-nc-sa"), ("by-nc-nd", "by-nc-nd"))),
        ("creative commons attribution", (("", "by"), ("-noncommercial", "by-nc"), ("-sharealike", "by-sa"), ("-noderivatives", "by-nd"), ("-noncommercial-sharealike", "by-nc-sa"), ("-noncommercial-noderivatives", "by-nc-nd")))
    ) for kind, key in kinds for tail in ("", " international license")},
}
# SPDX names.
SPDX = (
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0",
    "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC",
    "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
# Identifiers that name a licence without a rule.
SINGLE = {
    **{f"spdx-{n.lower()}": n for n in SPDX},
    "lgpl-2-grant": "LGPL-2.0-or-later", "lgpl-2.1-grant": "LGPL-2.1-or-later", "lgpl-3-grant": "LGPL-3.0-or-later", "agpl-3-grant": "AGPL-3.0-or-later",
    "lgpl-2.1-ref": "LGPL-2.1-only", "lgpl-3-ref": "LGPL-3.0-only", "agpl-3-ref": "AGPL-3.0-only",
    "mpl-2-ref": "MPL-2.0", "0bsd-grant": "0BSD", "isc-grant": "ISC", "isc-ref": "ISC", "bsl-grant": "BSL-1.0", "bsl-ref": "BSL-1.0", "zlib-grant": "Zlib", "unlicense-grant": "Unlicense",
    "bsd-3-ref": "BSD-3-Clause", "bsd-2-ref": "BSD-2-Clause", "cc-by-nd-4-ref": "CC-BY-ND-4.0", "cc-by-nc-sa-4-ref": "CC-BY-NC-SA-4.0", "cc-by-nc-nd-4-ref": "CC-BY-NC-ND-4.0",
}
# Rules before ``RULES``.
NOTICE_RULES = (("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-ads")),)
#: What stands between words; ``rem`` and ``dnl`` are comment marks at a line's beginning.
GAP = r"(?:\n[ \t]*(?:rem|dnl)(?![\p{L}\p{N}])|[^\p{L}\p{N}])+"


def plain(sentence: str) -> str:
    """The words of a known sentence, as ``spaced`` makes them."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def spaced(text: Column) -> Column:
    """The words of a text, a space before, between and after them; ``2.0+`` is 2.0 or later."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit(".0+"), F.lit(".0 or later")), GAP, " ")), F.lit(" "))


def phrases(sentences: dict[str, str] = SENTENCES) -> tuple[dict[str, str], dict[str, str]]:
    """All that is looked for, in plain words, with its identifier: sentences, and SPDX names."""
    out = {plain(f"{verb} {the}{name}"): key for verb, the, (name, key) in product(VERBS, ("", "the ", "a "), NAMES.items())}
    for said, key in list(out.items()):
        if key.split("-ref")[0] in ("gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "agpl-3"):
            later = key.replace("-ref", "-grant")
            out |= {f"{said} {plain(tail)}": later for tail in ("or later", "or any later version", _LATER)}
    out |= {plain(k): v for k, v in (NOTICES | sentences).items()}
    # an older sentence on version 2 or 3 may go on with a later version, too
    out |= {f"{plain(k)} {plain(tail)}": v.replace("-ref", "-grant") for k, v in sentences.items() if v in ("gpl-2-ref", "gpl-3-ref") for tail in ("or later", "or any later version", _LATER)}
    names = {plain(n): f"spdx-{n.lower()}" for n in SPDX}
    return out, names | {k.removesuffix(" only"): v for k, v in names.items() if k.endswith(" only")}


def trie(known: list[str]) -> str:
    """A pattern for the longest of the known phrases that begins here."""
    tree: dict = {}
    for phrase in known:
        node = tree
        for word in phrase.split(" "):
            node = node.setdefault(word, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        nexts = []
        for word, below in sorted(node.items(), key=lambda x: x[0], reverse=True):
            run = [word]
            while len(below) == 1 and "" not in below:
                word, below = next(iter(below.items()))
                run.append(word)
            if run != [""]:
                nexts.append(" ".join(run) + rest(below))
        return nexts[0] if len(nexts) == 1 else "(?:" + "|".join(nexts) + ")"

    def rest(node: dict) -> str:
        if set(node) == {""}:
            return "(?= )"
        return "(?: " + pattern(node) + "|(?= ))" if "" in node else " " + pattern(node)

    return pattern(tree)


def _literal(table: dict[str, str]) -> Column:
    return F.str_to_map(F.lit("\n".join(f"{k}\t{v}" for k, v in table.items())), F.lit("\n"), F.lit("\t"))


def licences(docs: DataFrame, sentences: dict[str, str] = SENTENCES, rules: tuple = (*NOTICE_RULES, *RULES)) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licences for every row of ``docs``.

    ``n_sentences`` counts what lies between line ends and sentence marks.  ``sentence_ids`` are the identifiers
    of the known sentences in order, with spaces between them, wherever they stand and however they are
    wrapped, but not after the word "not"; ``licences`` the distinct licences whose rules match, in the order
    of the rules, and then those of identifiers in ``SINGLE``.  Both are empty strings where nothing is known,
    as for a null or empty text.  Repeated rows each get a result, extra columns are ignored, an empty table gives an
    empty result, and a text is searched whole, however long it is.
    """
    known, names = phrases(sentences)
    # an SPDX name follows its tag, or "or" and "and" right after what was found before
    leads = ("spdx license identifier", "or", "and")
    table = known | {f"{lead} {n}": v for lead, (n, v) in product(leads, names.items())}
    find = f"(?<= )(?<! not )(?:{trie(list(known))}|(?:spdx license identifier|(?<=\\G )(?:or|and)) {trie(list(names))})"
    ids, licence = _literal(table), _literal(SINGLE)
    text = F.coalesce("text", F.lit(""))
    found = F.transform(F.regexp_extract_all(spaced(text), F.lit(find), F.lit(0)), lambda s: F.try_element_at(ids, s))
    rows = docs.select("doc_id", F.size(F.filter(F.split(text, BREAK), lambda s: s != "")).cast("long").alias("n_sentences"), F.array_join(found, " ").alias("sentence_ids"))
    single = F.filter(F.transform(F.split("sentence_ids", " "), lambda s: F.try_element_at(licence, s)), lambda s: s.isNotNull())
    left = F.concat(F.lit(" "), F.replace("sentence_ids", F.lit(" "), F.lit("  ")), F.lit(" "))
    names, columns = [], {}
    for k, (name, ids) in enumerate(rules):
        run = F.lit(" " + "  ".join(ids) + " ")
        at = F.col(f"left{k - 1}") if k else left
        columns = {f"left{k}": F.replace(at, run, F.lit(" | ")), f"hit{k}": F.when(F.contains(at, run), F.lit(name))}
        rows = rows.withColumns(columns)
        names.append(f"hit{k}")
    return rows.select("doc_id", "n_sentences", "sentence_ids", F.array_join(F.array_distinct(F.concat(F.array(*names), single)), " ").alias("licences"))


def duckdb_sql(sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> str:
    """The same for DuckDB."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({q(k)}, {q(v)})" for k, v in sentences.items())
    steps, last = [], "s"
    for k, (name, ids) in enumerate(rules):
        run = q(" " + "  ".join(ids) + " ")
        steps.append(f"r{k} AS (SELECT *, CASE WHEN contains(left{k}, {run}) THEN {q(name)} END AS hit{k}, replace(left{k}, {run}, ' | ') AS left{k + 1} FROM {last})")
        last = f"r{k}"
    hits = ", ".join(f"hit{k}" for k in range(len(rules)))
    return f"""
        WITH known(sentence, id) AS (VALUES {values}),
        p AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{BREAK.replace("$", chr(92) + "z")}'), lambda x: x <> '') AS parts FROM documents),
        u AS (SELECT doc_id, parts, unnest(parts) AS part, unnest(range(len(parts))) AS pos FROM p),
        k AS (SELECT doc_id, string_agg(id, ' ' ORDER BY pos) AS ids FROM u JOIN known ON sentence = trim(regexp_replace(lower(part), '[ \\t\\r\\f]+', ' ', 'g'), ' ') GROUP BY doc_id),
        s AS (SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_sentences, coalesce(ids, '') AS sentence_ids, ' ' || replace(coalesce(ids, ''), ' ', '  ') || ' ' AS left0 FROM p LEFT JOIN k USING (doc_id)),
        {", ".join(steps)}
        SELECT doc_id, n_sentences, sentence_ids, coalesce((SELECT string_agg(h, ' ' ORDER BY f) FROM (SELECT h, min(i) AS f FROM (SELECT unnest([{hits}]) AS h, unnest(range({len(rules)})) AS i) WHERE h IS NOT NULL GROUP BY h)), '') AS licences
        FROM {last}"""
