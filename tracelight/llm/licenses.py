"""Licence scan: TF-IDF cosine to templates, then inheritance along directories.

A file is cut into blocks (its paragraphs); each block is compared with every
template by the cosine of sparse TF-IDF vectors. A term's weight is its count times
log((n + 1) / (df + 0.5)) with df its documents in the whole corpus; terms that no template
has weigh as if no document had them, so prose around a few licence words stays
far from every template. A block can reach the threshold only if it holds a key
term: the terms left out of a template's keys carry less than the threshold's share
of its length. Only such blocks are taken apart.

A file's own licence is its best template (ties: the first name). A licence file
states the licence of its directory; a file without one of its own inherits from the
nearest directory above it that has one, by joins on path prefixes. Licence files of
one directory that disagree: most files, then the first name. Directories are joined
once each, whatever number of files they hold.

Null text has no blocks, null path no directory. Rows that repeat an id are files of
their own. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tracelight.llm.url_rules import host_and_path
from tracelight.session import cut_lineage

#: Least cosine of a block and its template.
ALIKE = 0.6

# Short notices by which files name their licence, then the paragraphs of the licences themselves.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Proprietary", "All rights reserved. No part may be reproduced without permission."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
     "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the "
     "above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
     "conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
     "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
     "in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
     "this software without specific prior written permission."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
     "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
     "permissions and limitations under the License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
     "by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
     "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
     "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
     "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
     "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
     "arising from the use of this software."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
]
# What a page does not show, its comments, the tags inside a line of text, and the other tags.
# What never closes goes to the end, and loops give nothing back, so each pass is linear in the page.
HIDDEN = r"(?is)<(script|style)\b.*?(?:</\1\s*+>|\z)|<!--.*?(?:-->|\z)"
COMMENTS = r"(?s)<!--.*?(?:-->|\z)|/\*.*?(?:\*/|\z)|(?m:^[ \t]*+//[^\n]*+(?:\n[ \t]*+//[^\n]*+)*+)"
INLINE = r"(?i)</?(?:a|abbr|acronym|b|bdi|bdo|big|cite|code|data|del|dfn|em|font|i|img|ins|kbd|mark|nobr|q|s|samp|small|span|strike|strong|sub|sup|time|tt|u|var|wbr)(?=[\s/>])[^>]*+(?:>|\z)"
TITLE = r"(?is)<title[^>]*+(?:>|\z)(.*?)(?:</title>|\z)"
FOOTER, TAGS = r"(?i)<footer\b[^>]*+(?:>|\z)", r"<[^>]*+(?:>|\z)"
#: Line breaks with an empty line between them.
GAP = r"\n[^\S\n]*+\n\s*+"
#: In the text of a page: a tag inside a line, the start of a footer.
INSIDE, FOOT = "\x02", "\x03"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?!\p{N})"), lambda x: x != "")


def block_terms(text: Column) -> Column:
    """The terms of each block, in order."""
    return F.transform(F.split(text, r"\n\s*"), terms)


def _weighted(templates: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, Column]:
    """(template, licence, term, w, norm), key terms, and the weight of a term that no document has. ``files``: (row, blocks)."""
    each = templates.withColumn("template", F.xxhash64("licence", "text"))
    counted = each.select("template", "licence", F.explode(terms(F.col("text"))).alias("term")).groupBy("template", "licence", "term").agg(F.count("*").alias("tf"))
    counted = cut_lineage(counted)
    names = F.array(*[F.lit(r.term) for r in counted.select("term").distinct().orderBy("term").collect()])  # as many as the templates have
    held = files.select(F.array_intersect(F.flatten("blocks"), names).alias("t"))
    df = held.select(F.explode("t").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    n = files.count()
    unseen = F.log(F.lit((n + 1) / 0.5))
    weight = F.col("tf") * F.log((F.lit(n) + 1) / (F.coalesce("df", F.lit(0)) + 0.5))
    weighed = counted.join(df, "term", "left").withColumn("idf", F.log((F.lit(n) + 1) / (F.coalesce("df", F.lit(0)) + 0.5))).withColumn("w", weight)
    whole = Window.partitionBy("template")
    weighed = weighed.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(whole)))
    # From the heaviest term on: keys until what is left is too little.
    order = whole.orderBy("w", "term").rowsBetween(Window.unboundedPreceding, 0)
    rest = F.sqrt(F.sum(F.col("w") * F.col("w")).over(order))
    weighed = cut_lineage(weighed.withColumn("is_key", rest >= F.lit(ALIKE) * F.col("norm")))
    return weighed, weighed.filter("is_key").select("term").distinct(), unseen


def matches(files: DataFrame, templates: DataFrame, alike: float = ALIKE) -> DataFrame:
    """(row, block, licence, score): the best template of each block that reaches ``alike``. ``files``: (row, blocks), the terms of each block."""
    files = files.filter("blocks is not null")
    weighed, keys, unseen = _weighted(templates, files)
    names = F.array(*[F.lit(r.term) for r in keys.orderBy("term").collect()])
    blocks = files.select("row", F.posexplode("blocks").alias("block", "t"))
    open_ = blocks.filter(F.arrays_overlap("t", names))
    each = open_.select("row", "block", F.explode("t").alias("term")).groupBy("row", "block", "term").agg(F.count("*").alias("n"))
    each = cut_lineage(each)
    idf = weighed.groupBy("term").agg(F.max("idf").alias("idf"))
    vector = each.join(idf, "term", "left").withColumn("x", F.col("n") * F.coalesce("idf", unseen))
    length = vector.groupBy("row", "block").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("length"))
    dot = vector.join(weighed.select("template", "licence", "term", "w", "norm"), "term")
    dot = dot.groupBy("row", "block", "template", "licence", "norm").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    score = F.round(F.col("dot") / (F.col("length") * F.col("norm")), 9)
    found = dot.join(length, ["row", "block"]).withColumn("score", score).filter(F.col("score") >= alike)
    best = Window.partitionBy("row", "block").orderBy(F.desc("score"), "licence", "template")
    return found.withColumn("n", F.row_number().over(best)).filter("n = 1").select("row", "block", "licence", "score")


def _ancestors(path: Column) -> Column:
    """Directories of a path from its own to the root, each with a closing slash."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))


def scan(files: DataFrame, templates: DataFrame, alike: float = ALIKE) -> DataFrame:
    """Per row of ``files`` (id, path, text, header_blocks): id, path, own_licence, score, licence, origin, origin_dir.

    A file whose match lies in its first ``header_blocks`` blocks is a licence file of its directory.
    """
    # A text is taken apart once: what is written is its terms, by block.
    files = files.select(F.monotonically_increasing_id().alias("row"), "id", "path", "header_blocks", block_terms(F.col("text")).alias("blocks"))
    files = cut_lineage(files)
    found = cut_lineage(matches(files.select("row", "blocks"), templates, alike))
    order = Window.partitionBy("row").orderBy(F.desc("score"), "licence", "block")
    own = found.withColumn("n", F.row_number().over(order)).filter("n = 1").select("row", F.col("licence").alias("own_licence"), "score")
    heads = found.join(files.select("row", "header_blocks"), "row").filter("block < header_blocks").groupBy("row").agg(F.min(F.struct("block", "licence")).alias("h"))

    dirs = F.when(F.col("path").isNotNull() & F.col("path").contains("/"), _ancestors(F.col("path")))
    placed = cut_lineage(files.select("row", "id", "path", F.element_at(dirs, 1).alias("dir")).join(own, "row", "left"))
    stated = placed.join(heads.select("row", F.col("h.licence").alias("stated")), "row").filter("dir is not null")
    votes = stated.groupBy("dir", "stated").agg(F.count("*").alias("files"))
    says = votes.groupBy("dir").agg(F.min(F.struct((-F.col("files")).alias("n"), "stated")).alias("s")).select(F.col("dir").alias("above"), "s.stated")
    # Each directory once, however many files it holds.
    below = placed.filter("dir is not null").select("dir").distinct().select("dir", F.posexplode(_ancestors(F.col("dir"))).alias("up", "above"))
    near = below.join(says, "above").groupBy("dir").agg(F.min(F.struct("up", "above", "stated")).alias("n"))
    near = near.select("dir", F.col("n.above").alias("from_dir"), F.col("n.stated").alias("inherited"))
    whole = placed.join(near, "dir", "left")
    mine = F.col("own_licence").isNotNull()
    return whole.select(
        "id", "path", "own_licence", "score", F.coalesce("own_licence", "inherited").alias("licence"),
        F.when(mine, "own").when(F.col("inherited").isNotNull(), "inherited").alias("origin"), F.when(~mine, F.col("from_dir")).alias("origin_dir"),
    )


def _whole(lines: Column) -> Column:
    """Lines without the marks of the tags inside them."""
    return F.regexp_replace(lines, f"[{INSIDE}{FOOT}]", "")


def _pieces(lines: Column) -> Column:
    """Of lines that have tags inside: what stands between these, a line each."""
    cut = F.regexp_extract_all(lines, F.lit(rf"(?<![^\n])[^\n{INSIDE}]*+{INSIDE}[^\n]*"), F.lit(0))
    return F.regexp_replace(F.array_join(cut, "\n"), f"[{INSIDE}{FOOT}]", "\n")


def page_files(pages: DataFrame) -> DataFrame:
    """Web pages as files: the url's host and path, and the text, one block for each element and each text inside a line's tag.

    Header blocks: the title, the comments (of scripts and styles too), the last block before the footer, the footer.
    """
    host, path = host_and_path(F.col("url"))
    html = F.regexp_replace(F.coalesce("html", F.lit("")), "[\r\x01\x02\x03]", " ")
    title = F.trim(F.regexp_replace(F.regexp_extract(html, TITLE, 1), r"\s+", " "))
    hidden = F.array_join(F.regexp_extract_all(html, F.lit(HIDDEN), F.lit(0)), "\n")
    hidden = F.regexp_replace(hidden, r"(?i)(<script\b[^<>]*+>\s*+)<!--", "$1")  # an old way to open a script
    notes = F.array_join(F.regexp_extract_all(hidden, F.lit(COMMENTS), F.lit(0)), "\n\n")
    # Only an empty line closes a block inside an element or a comment.
    notes = F.replace(F.regexp_replace(F.regexp_replace(notes, r"\n[\s*/]*\n", "\x01"), r"\s+", " "), F.lit("\x01"), F.lit("\n"))
    body = F.regexp_replace(F.regexp_replace(html, TITLE, ""), GAP, "\x01")
    body = F.replace(F.replace(body, F.lit("\n"), F.lit(" ")), F.lit("\x01"), F.lit("\n"))
    for what, by in ((HIDDEN, ""), (INLINE, INSIDE), (FOOTER, f"\n{FOOT}\n"), (TAGS, "\n")):
        body = F.regexp_replace(body, what, by)
    parts = pages.select("page_id", "html", "url", title.alias("title"), notes.alias("notes"), body.alias("body"))
    foot = F.when(F.contains("body", F.lit(FOOT)), F.substring_index("body", FOOT, -1)).otherwise("")
    main = F.rtrim(F.substr("body", F.lit(1), F.length("body") - F.length(foot)), F.lit(f" \n\t\f\v{INSIDE}{FOOT}"))
    ends = F.concat(F.substring_index(main, "\n", -1), F.lit("\n"), foot)
    # The header first, so that its blocks are the first.
    head = F.concat_ws("\n", F.when(F.col("title") == "", "-").otherwise(F.col("title")), "notes", _whole(ends), _pieces(ends))
    parts = parts.withColumn("head", F.filter(F.split(head, r"\s*\n\s*"), lambda x: x != ""))
    text = F.concat_ws("\n", F.array_join("head", "\n"), _whole(F.col("body")), _pieces(F.col("body")))
    where = F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path)))
    return parts.select(F.col("page_id").alias("id"), where.alias("path"), F.when(F.col("html").isNotNull(), text).alias("text"), F.size("head").alias("header_blocks"))
