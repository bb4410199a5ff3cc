"""Licence scans by Dice coefficient over word bigrams, in DataFrame functions only.

A text is normalised (lower case, everything but letters, digits and line breaks to one
space) and looked at in units: each line, and each paragraph of several lines. Licences of several
paragraphs are templates as a whole and paragraph by paragraph, as they usually stand. A unit is
compared with the templates by 2 * |A and B| / (|A| + |B|) over the sets of its word bigrams.
A coefficient of at least LEAST needs sizes within a factor of LEAST / (2 - LEAST), so a
template is listed once for every size it can match, and the units find their templates by
an equality join on the number of bigrams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.scratch import given_id, id_and_text
from tidemark.session import small_frame

LEAST = 0.8
NOT_WORD = "[^\\p{L}\\p{N}\\n]+"

# The wording of public licences and of the notices that name them.
_AS_IS = (
    'the software is provided "as is", without warranty of any kind, express or implied, including but '
    "not limited to the warranties of merchantability, fitness for a particular purpose and "
    "noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages "
    "or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in "
    "connection with the software or the use or other dealings in the software."
)
_CONDITIONS = (
    "redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met:"
)
_IN_SOURCE = (
    "1. redistributions of source code must retain the above copyright notice, this list of conditions and "
    "the following disclaimer."
)
_IN_BINARY = (
    "2. redistributions in binary form must reproduce the above copyright notice, this list of conditions "
    "and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution."
)
_NO_ENDORSEMENT = (
    "3. neither the name of the copyright holder nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission."
)
_DISCLAIMER = (
    'this software is provided by the copyright holders and contributors "as is" and any express or '
    "implied warranties, including, but not limited to, the implied warranties of merchantability and "
    "fitness for a particular purpose are disclaimed. in no event shall the copyright holder or "
    "contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential "
    "damages (including, but not limited to, procurement of substitute goods or services; loss of use, "
    "data, or profits; or business interruption) however caused and on any theory of liability, whether in "
    "contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the "
    "use of this software, even if advised of the possibility of such damage."
)
# Licences of several paragraphs: they stand as one, or each paragraph for itself.
_MIT = (
    "permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "software"), to deal in the software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
    "sublicense, and/or sell copies of the software, and to permit persons to whom the software is "
    "furnished to do so, subject to the following conditions:",
    "the above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the software.",
    _AS_IS,
)
_BSD_2 = (_CONDITIONS, _IN_SOURCE, _IN_BINARY, _DISCLAIMER)
_BSD_3 = (_CONDITIONS, _IN_SOURCE, _IN_BINARY, _NO_ENDORSEMENT, _DISCLAIMER)
_ISC = (
    "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
    "is hereby granted, provided that the above copyright notice and this permission notice appear in all "
    "copies.",
    'the software is provided "as is" and the author disclaims all warranties with regard to this '
    "software including all implied warranties of merchantability and fitness. in no event shall the author "
    "be liable for any special, direct, indirect, or consequential damages or any damages whatsoever "
    "resulting from loss of use, data or profits, whether in an action of contract, negligence or other "
    "tortious action, arising out of or in connection with the use or performance of this software.",
)
_APACHE = (
    'licensed under the apache license, version 2.0 (the "license"); you may not use this file except in '
    "compliance with the license. you may obtain a copy of the license at",
    "http://www.apache.org/licenses/license-2.0",
    'unless required by applicable law or agreed to in writing, software distributed under the license is '
    'distributed on an "as is" basis, without warranties or conditions of any kind, either express or implied. '
    "see the license for the specific language governing permissions and limitations under the license.",
)
_GPL_3 = (
    "this program is free software: you can redistribute it and/or modify it under the terms of the gnu "
    "general public license as published by the free software foundation, either version 3 of the license, "
    "or (at your option) any later version.",
    "this program is distributed in the hope that it will be useful, but without any warranty; without even "
    "the implied warranty of merchantability or fitness for a particular purpose. see the gnu general public "
    "license for more details.",
    "you should have received a copy of the gnu general public license along with this program. if not, see "
    "<https://www.gnu.org/licenses/>.",
)
_LONG = (
    ("MIT", _MIT), ("BSD-2-Clause", _BSD_2), ("BSD-3-Clause", _BSD_3), ("ISC", _ISC), ("Apache-2.0", _APACHE), ("GPL-3.0", _GPL_3),
)
# Whole licences, and notices of one line or paragraph.
_SINGLE = (
    *((name, " ".join(paragraphs)) for name, paragraphs in _LONG),
    ("MIT", "released under the mit license."),
    ("MIT", "licensed under the mit license."),
    ("MIT", "this project is licensed under the mit license."),
    ("BSD-3-Clause", "use of this source code is governed by a bsd-style license that can be found in the license file."),
    ("Apache-2.0", "licensed under the apache license, version 2.0."),
    ("GPL-3.0", "this work is licensed under the gnu general public license, version 3."),
    ("GPL-2.0", "this work is licensed under the gnu general public license, version 2."),
    (
        "MPL-2.0",
        "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the "
        "mpl was not distributed with this file, you can obtain one at https://mozilla.org/mpl/2.0/.",
    ),
    ("CC-BY-4.0", "licensed under cc by 4.0."),
    ("CC-BY-SA-4.0", "licensed under cc by-sa 4.0."),
    ("CC-BY-NC-4.0", "licensed under cc by-nc 4.0."),
    ("CC-BY-ND-4.0", "licensed under cc by-nd 4.0."),
    ("CC-BY-NC-SA-4.0", "licensed under cc by-nc-sa 4.0."),
    ("CC-BY-4.0", "this work is licensed under a creative commons attribution 4.0 international license."),
    (
        "CC-BY-SA-4.0",
        "this work is licensed under a creative commons attribution-sharealike 4.0 international license.",
    ),
    (
        "CC-BY-NC-4.0",
        "this work is licensed under a creative commons attribution-noncommercial 4.0 international license.",
    ),
    (
        "Unlicense",
        "this is free and unencumbered software released into the public domain. anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)
# A paragraph that licences share is named after the first of them.
_paragraphs = {p: name for name, paragraphs in reversed(_LONG) for p in paragraphs}
TEMPLATES = (*_SINGLE, *((name, p) for p, name in _paragraphs.items()))


def _bigrams(words: str) -> Column:
    """Distinct pairs of adjacent words of the array column ``words``."""
    return F.expr(
        f"array_distinct(transform(slice({words}, 2, greatest(size({words}) - 1, 0)), "
        f"(w, i) -> concat({words}[i], ' ', w)))"
    )


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), NOT_WORD, " ")


def template_table(docs: DataFrame) -> DataFrame:
    """(_size, _template, licence, _grams): each template under every size it can match."""
    rows = [(k, licence, text) for k, (licence, text) in enumerate(TEMPLATES)]
    table = small_frame(docs.sparkSession, rows, "_template int, licence string, _text string")
    table = table.select("_template", "licence", F.split(F.trim(_normal(F.col("_text"))), " ").alias("_w"))
    table = table.select("_template", "licence", _bigrams("_w").alias("_grams"))
    low = F.ceil(F.size("_grams") * F.lit(LEAST / (2 - LEAST)) - 1e-9).cast("int")
    high = F.floor(F.size("_grams") * F.lit((2 - LEAST) / LEAST) + 1e-9).cast("int")
    return table.select("*", F.explode(F.sequence(low, high)).alias("_size"))


def licence_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, unit, unit_no, licence, dice): the units of each document that match a licence with
    LEAST or more, each with its best licence (ties: the first in name). Units are numbered from
    0 within ``line`` and within ``paragraph``; a paragraph is what empty lines surround.

    Null and empty texts and units of one word match nothing. Null ids stay null; repeated rows give
    repeated matches of equal rows only once each; other columns are not read; an empty table gives
    an empty result.
    """
    text = _normal(F.col("_text"))
    units = id_and_text(docs, id_col, text_col).filter("_text is not null").select(
        "_id", F.xxhash64("_text").alias("_th"), text.alias("_t")
    )
    lines = F.expr("transform(split(_t, '\\n', -1), (x, i) -> struct('line' as unit, i as no, x as t))")
    paragraphs = F.expr(
        "filter(transform(split(_t, '\\n(?: ?\\n)+', -1), (x, i) -> struct('paragraph' as unit, i as no, x as t)), "
        "s -> instr(trim(both ' \\n' from s.t), '\\n') > 0)"
    )
    units = units.select("_id", "_th", F.explode(F.concat(lines, paragraphs)).alias("_u"))
    words = F.filter(F.split("_u.t", "[ \\n]+"), lambda w: w != "")
    units = units.select("_id", "_th", F.col("_u.unit").alias("unit"), F.col("_u.no").alias("unit_no"), words.alias("_w"))
    units = units.filter(F.size("_w") > 1).select("_id", "_th", "unit", "unit_no", _bigrams("_w").alias("_own"))
    templates = F.broadcast(template_table(docs))
    common = F.size(F.array_intersect("_own", "_grams"))
    scored = (
        units.withColumn("_size", F.size("_own"))
        .join(templates, "_size")
        .select(
            "_id", "_th", "unit", "unit_no", "licence",
            (2.0 * common / (F.size("_own") + F.size("_grams"))).alias("dice"),
        )
        .filter(F.col("dice") >= LEAST)
    )
    best = scored.groupBy("_id", "_th", "unit", "unit_no").agg(
        F.min(F.struct((-F.col("dice")).alias("d"), F.col("licence"))).alias("_b")
    )
    return best.select(
        given_id().alias("doc_id"), "unit", F.col("unit_no").cast("long").alias("unit_no"),
        F.col("_b.licence").alias("licence"), (-F.col("_b.d")).alias("dice"),
    )


def _sql() -> str:
    quoted = ", ".join(
        "({}, '{}', '{}')".format(k, name, text.replace("'", "''")) for k, (name, text) in enumerate(TEMPLATES)
    )
    normal = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t AS (
  SELECT licence, {grams} AS g FROM (
    SELECT licence, string_split(trim({normal.format("text")}), ' ') AS w
    FROM (VALUES {quoted}) AS v(template, licence, text))
), d AS (
  SELECT doc_id, {normal.format("text")} AS t FROM documents WHERE text IS NOT NULL
), u AS (
  SELECT doc_id, 'line' AS unit, unnest(range(len(x))) AS unit_no, unnest(x) AS t
  FROM (SELECT doc_id, string_split(t, chr(10)) AS x FROM d)
  UNION ALL
  SELECT doc_id, unit, unit_no, t FROM (
    SELECT doc_id, 'paragraph' AS unit, unnest(range(len(x))) AS unit_no, unnest(x) AS t
    FROM (SELECT doc_id, regexp_split_to_array(t, '\\n(?: ?\\n)+') AS x FROM d))
  WHERE contains(trim(t, ' ' || chr(10)), chr(10))
), b AS (
  SELECT doc_id, unit, unit_no, {grams} AS own FROM (
    SELECT doc_id, unit, unit_no, list_filter(regexp_split_to_array(t, '[ \\n]+'), lambda x: x <> '') AS w FROM u)
  WHERE len(w) > 1
), s AS (
  SELECT doc_id, unit, unit_no, licence,
         2.0::DOUBLE * len(list_intersect(own, g)) / (len(own) + len(g)) AS dice
  FROM b JOIN t ON len(own) BETWEEN ceil(len(g) * {LEAST / (2 - LEAST)!r}::DOUBLE - 1e-9)
                             AND floor(len(g) * {(2 - LEAST) / LEAST!r}::DOUBLE + 1e-9)
)
SELECT doc_id, unit, unit_no, licence, dice FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, unit, unit_no ORDER BY dice DESC, licence) AS k
  FROM s WHERE dice >= {LEAST}) WHERE k = 1
"""


ORACLE = _sql()
