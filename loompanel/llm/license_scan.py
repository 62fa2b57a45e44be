r"""Licence scan by diagonal voting.

Templates are licence phrases and notices of any length.  Every rolling word pair of a text is joined to
the places of all templates where the same pair stands (for templates of ``LONG`` words or more: the same
three words, as "of the" stands in many texts); a match votes for the diagonal *text place minus
template place*.  Votes are gathered by text, template and diagonal as sets of template places (a
template's length at most), so nothing but counted diagonals is shuffled.

Each diagonal is merged with its neighbours up to ``slack`` beyond it (a word more in the text moves the
rest of a phrase to the next diagonal), so a span never drifts by more than ``slack`` words as a whole.
A merged span is verified: of the template's k-grams, each at its first place in the span, those count that
stand behind all before them; their share has to reach ``coverage``.  Licences have siblings that differ by a
word or a version ("2.0 only", "2.0 or later"; "by", "by-nc"): where half of a template's k-grams stand in a
template of another label too, those that do not stand there are obligatory, each one, so that no sibling's
text gives its label.  Phrases marked *base* count only where all their words stand consecutively, on one
diagonal.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.  Built-in functions only.  The
template table is a constant of the caller and broadcast; tables of over ``BROADCAST_PAIRS`` pairs
are joined by sorting.

Nulls count as empty texts (no words, no labels, score 0); repeated rows each get a row; other
input columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loompanel.llm.common import text_of

#: Identifiers of licences as file headers name them.
SPDX = "0BSD AFL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3-or-later GPL-1.0-only GPL-1.0-or-later GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-1.1 MPL-2.0 MS-PL NCSA OFL-1.1 PostgreSQL Python-2.0 Unlicense WTFPL Zlib".split()
#: The additions to "by" of licences of the 4.0 suite, and what they say.
CREATIVE_COMMONS = {"": "", "-nc": " noncommercial", "-nc-nd": " noncommercial noderivatives", "-nc-sa": " noncommercial sharealike", "-nd": " noderivatives", "-sa": " sharealike"}
#: Fixed values: (label, words, base) of phrases and notices.
TEMPLATES = [
    ("cc-by", "cc by", True),
    ("gpl", "general public license", True),
    ("reserved", "all rights reserved", True),
    ("agpl-3.0", "gnu affero general public license", False),
    ("apache-2.0", "licensed under the apache license version 2 0", False),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", False),
    ("artistic-2.0", "artistic license 2 0", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    ("bsd-2-clause", "bsd 2 clause license", False),
    ("bsd-3-clause", "bsd 3 clause license", False),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", False),
    ("bsd-disclaimer", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", False),
    ("bsl-1.0", "boost software license version 1 0", False),
    ("cc0-1.0", "cc0 1 0 universal", False),
    ("epl-2.0", "eclipse public license v 2 0", False),
    ("gfdl", "gnu free documentation license", False),
    ("gpl-2.0", "general public license version 2", False),
    ("gpl-3.0", "general public license version 3", False),
    ("gpl-header", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", False),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", False),
    ("lgpl", "gnu lesser general public license", False),
    ("mit", "released under the mit license", False),
    ("mit", "licensed under the mit license", False),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions", False),
    ("mpl-2.0", "subject to the terms of the mozilla public license", False),
    ("public-domain", "this is free and unencumbered software released into the public domain", False),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", False),
    *((f"cc-by{short}-4.0", f"licensed under cc by{short.replace('-', ' ')} 4 0", False) for short in CREATIVE_COMMONS),
    *((f"cc-by{short}-4.0", f"creative commons attribution{full} 4 0 international license", False) for short, full in CREATIVE_COMMONS.items()),
    *((name.lower(), "spdx license identifier " + name.lower().replace("-", " ").replace(".", " "), False) for name in SPDX),
]
#: Templates of so many words or more are joined by three words instead of two.
LONG = 12
#: The share of a template's k-grams from which on a template of another label is its sibling.
SIBLING = 0.5
BROADCAST_PAIRS = 100_000
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text_col: str):
    """The words of a text, A-Z lower-cased.  (The Kelvin sign, the one other character that
    lower-cases to a lone ASCII letter, is put out of the way first.)"""
    lowered = F.lower(F.replace(text_of(text_col), F.lit("K"), F.lit("å")))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def grams_of(phrase: str) -> list[tuple[str, str, str | None]]:
    """The rolling pairs of a template's words, or its triples if it is long (no third word in pairs)."""
    words = phrase.split()
    if len(words) < 2:
        raise ValueError(f"{phrase}: a template has two words or more")
    return list(zip(words, words[1:], words[2:])) if len(words) >= LONG else [(a, b, None) for a, b in zip(words, words[1:])]


def obligatory(templates=TEMPLATES) -> list[set[tuple]]:
    """For each template the k-grams that tell it from its siblings.  A template without any such against one
    that holds it whole could not be told from it: that is an error (base phrases are told by all their words)."""
    grams = [grams_of(phrase) for _, phrase, _ in templates]
    words = [phrase.split() for _, phrase, _ in templates]
    held = {3: [set(zip(w, w[1:], w[2:])) for w in words], 2: [{(a, b, None) for a, b in zip(w, w[1:])} for w in words]}
    out = []
    for i, (label, phrase, base) in enumerate(templates):
        own, must = set(grams[i]), set()
        for j, other in enumerate(held[2 if grams[i][0][2] is None else 3]) if not base else ():
            if templates[j][0] == label or len(own & other) < SIBLING * len(own):
                continue
            if own <= other:
                raise ValueError(f"{phrase}: stands whole in a template of {templates[j][0]}")
            must |= own - other
        out.append(must)
    return out


def template_grams(spark, templates=TEMPLATES) -> DataFrame:
    """One row for each rolling k-gram of each template (``must``: it is obligatory; ``needs``: how many are)."""
    musts = obligatory(templates)
    rows = []
    for number, (label, phrase, base) in enumerate(templates):
        grams = grams_of(phrase)
        needs = sum(g in musts[number] for g in grams)
        rows += [(number, label, base, len(grams), needs, at, g in musts[number], *g) for at, g in enumerate(grams)]
    table = spark.createDataFrame(rows, "template int, label string, base boolean, grams int, needs int, at int, must boolean, t_w string, t_v string, t_u string")
    table = table.select(F.xxhash64("t_w", "t_v").alias("t_h"), "*")
    return F.broadcast(table) if len(rows) <= BROADCAST_PAIRS else table


def _votes(docs: DataFrame, templates, slack: int, id_col: str, text_col: str) -> DataFrame:
    """row (a number for each input row), id, n_words, template, label, base, diagonal, first, last (word
    places of the span), share (of the template's k-grams, verified), told (from all siblings): one row for each diagonal, merged with
    those up to ``slack`` beyond it.  Each input row also has one row with a null label."""
    grams = template_grams(docs.sparkSession, templates)
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(text_col).alias("ws"))
    zipped = F.arrays_zip(F.col("ws").alias("w"), F.slice("ws", F.lit(2), F.size("ws")).alias("v"), F.slice("ws", F.lit(3), F.size("ws")).alias("u"))
    rolled = texts.select("row", "id", F.size("ws").cast("long").alias("n_words"), F.posexplode_outer(zipped).alias("pos", "p")).select(
        "row", "id", "n_words", "pos", F.col("p.w").alias("w"), F.col("p.v").alias("v"), F.col("p.u").alias("u"), F.xxhash64("p.w", "p.v").alias("h")
    )
    same = (F.col("h") == F.col("t_h")) & (F.col("w") == F.col("t_w")) & (F.col("v") == F.col("t_v")) & (F.col("t_u").isNull() | (F.col("u") == F.col("t_u")))
    # the rows without label stay, so that a text without any span keeps its row
    voted = rolled.join(grams, same, "left").where(F.col("label").isNotNull() | F.coalesce(F.col("pos") == 0, F.lit(True)))
    width = F.when(F.col("t_u").isNull(), 2).otherwise(3).alias("width")
    keys = ["row", "id", "n_words", "template", "label", "base", "grams", "needs"]
    diagonals = voted.groupBy(width, *keys, (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.array_sort(F.collect_set(F.struct("at", "must"))).alias("seen"))
    reach = W.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, slack)
    own = F.array(F.struct("diagonal", "seen"))
    merged = diagonals.withColumn("near", F.when(F.col("label").isNull() | F.col("base"), own).otherwise(F.collect_list(F.struct("diagonal", "seen")).over(reach)))
    places = F.array_sort(F.flatten(F.transform("near", lambda d: F.transform(d["seen"], lambda k: F.struct(k["at"].alias("k"), (k["at"] + d["diagonal"]).alias("pos"), k["must"].alias("must"))))))

    def further(seen, m):
        """The last template place, the furthest text place, the first one, how many places stand in order, and of obligatory ones."""
        new, behind = m["k"] != seen["k"], m["pos"] > seen["far"]
        taken = new & behind
        return F.struct(
            m["k"].alias("k"),
            F.when(taken, m["pos"]).otherwise(seen["far"]).alias("far"),
            F.when(seen["n"] > 0, seen["near"]).otherwise(m["pos"]).alias("near"),
            (seen["n"] + taken.cast("int")).alias("n"),
            (seen["told"] + (taken & m["must"]).cast("int")).alias("told"),
        )

    start = F.struct(F.lit(-1).alias("k"), F.lit(-1).alias("far"), F.lit(-1).alias("near"), F.lit(0).alias("n"), F.lit(0).alias("told"))
    checked = merged.withColumn("order", F.aggregate(places, start, further))
    return checked.select(
        "row", "id", "n_words", "template", "label", "base", "diagonal",
        F.col("order.near").alias("first"), (F.col("order.far") + F.col("width") - 1).alias("last"), (F.col("order.n") / F.col("grams")).alias("share"), (F.col("order.told") == F.col("needs")).alias("told"),
    )


def _held(coverage: float) -> Column:
    return F.col("label").isNotNull() & F.col("told") & (F.col("share") >= F.when(F.col("base"), F.lit(1.0)).otherwise(F.lit(coverage)))


def license_spans(
    docs: DataFrame, templates=TEMPLATES, coverage: float = 0.8, slack: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Verified spans: row (a number for each input row), id, label, base, first, last (word places of the
    span), share.  Of spans of a template on neighbouring diagonals the fullest, and of these the first."""
    votes = _votes(docs, templates, slack, id_col, text_col).where(_held(coverage))
    along = W.partitionBy("row", "template").orderBy("diagonal")
    new = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(along) > slack), F.lit(True))
    grouped = votes.withColumn("new", new.cast("int")).withColumn("span", F.sum("new").over(along))
    best = F.min_by(F.struct("first", "last", "share"), F.struct(-F.col("share"), F.col("diagonal")))
    return grouped.groupBy("row", "id", "template", "label", "base", "span").agg(best.alias("b")).select("row", "id", "label", "base", "b.first", "b.last", "b.share")


def license_scan(docs: DataFrame, templates=TEMPLATES, coverage: float = 0.8, slack: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (the largest verified share of a template found, 0 without any)."""
    votes = _votes(docs, templates, slack, id_col, text_col).withColumn("held", _held(coverage))
    found = F.when(F.col("held"), F.col("label"))
    is_base = F.col("held") & F.col("base")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  the template labels at most
    return (
        votes.groupBy("row", "id", "n_words")
        .agg(
            F.sum(F.coalesce(is_base, F.lit(False)).cast("long")).alias("n_base"),
            F.min(F.when(is_base, F.col("first").cast("long"))).alias("first_word"),
            F.max(F.when(is_base, F.col("first").cast("long"))).alias("last_word"),
            listed(F.when(is_base, F.col("label"))).alias("base_labels"),
            listed(found).alias("labels"),
            F.coalesce(F.max(F.when(F.col("held"), F.col("share"))), F.lit(0.0)).alias("score"),
        )
        .select(F.col("id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )


def license_scan_sql(templates=TEMPLATES, coverage: float = 0.8, slack: int = 2) -> str:
    """The same result in DuckDB SQL, from joined words instead of hashes and joined places instead of arrays."""
    rows = []
    for number, ((label, phrase, base), must) in enumerate(zip(templates, obligatory(templates))):
        grams = grams_of(phrase)
        rows += [f"({number}, '{label}', {str(base).lower()}, {len(grams)}, {at}, {str(g in must).lower()}, '{g[0]}', '{g[1]}', {repr(g[2]) if g[2] else 'NULL'})" for at, g in enumerate(grams)]
    return rf"""
WITH t(tpl, label, base, pairs, k, must, a, b, c) AS (VALUES {', '.join(rows)}),
d AS (SELECT row_number() OVER () AS rid, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM d),
p AS (SELECT rid, pos, w AS a, lead(w) OVER (PARTITION BY rid ORDER BY pos) AS b, lead(w, 2) OVER (PARTITION BY rid ORDER BY pos) AS c FROM w),
g AS (SELECT rid, tpl, label, base, pairs, k, must, pos, pos - k AS dg FROM p JOIN t ON p.a = t.a AND p.b = t.b AND (t.c IS NULL OR p.c = t.c)),
n AS (SELECT DISTINCT rid, tpl, label, base, pairs, dg FROM g),
e AS (SELECT n.rid, n.tpl, n.label, n.base, n.pairs, n.dg, g.k, g.must, min(g.pos) AS pos FROM n JOIN g ON n.rid = g.rid AND n.tpl = g.tpl
      AND g.dg BETWEEN n.dg AND n.dg + CASE WHEN n.base THEN 0 ELSE {slack} END GROUP BY ALL),
o AS (SELECT *, coalesce(pos > max(pos) OVER (PARTITION BY rid, tpl, dg ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS good FROM e),
m AS (SELECT rid, tpl, label, base, dg, count(*) FILTER (WHERE good) / pairs AS share, arg_min(pos, k) AS f, count(*) FILTER (WHERE good AND must) AS told FROM o GROUP BY rid, tpl, label, base, dg, pairs),
q AS (SELECT tpl, count(*) FILTER (WHERE must) AS needs FROM t GROUP BY tpl),
v AS (SELECT m.* FROM m JOIN q ON m.tpl = q.tpl AND told = needs WHERE share >= CASE WHEN base THEN 1.0 ELSE {coverage} END)
SELECT d.doc_id, CAST(len(any_value(d.ws)) AS BIGINT) AS n_words, CAST(count(*) FILTER (WHERE v.base) AS BIGINT) AS n_base,
  CAST(min(v.f) FILTER (WHERE v.base) AS BIGINT) AS first_word, CAST(max(v.f) FILTER (WHERE v.base) AS BIGINT) AS last_word,
  coalesce(string_agg(DISTINCT v.label, ',' ORDER BY v.label) FILTER (WHERE v.base), '') AS base_labels,
  coalesce(string_agg(DISTINCT v.label, ',' ORDER BY v.label), '') AS labels, coalesce(max(v.share), 0.0) AS score
FROM d LEFT JOIN v ON d.rid = v.rid GROUP BY d.rid, d.doc_id"""
