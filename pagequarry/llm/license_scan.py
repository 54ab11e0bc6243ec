"""License scans by a positional index of rare words.

Templates are short word sequences.  Texts are read once: each becomes the numbers of its words in the templates'
vocabulary (0 for any other word), which is written as a table that packs to little.  From it the document frequencies of
the vocabulary are counted over all texts.  A template is indexed by its two rarest words (highest IDF) inside its mandatory key
phrase: the postings of a word hold the templates that it leads to, and its place in them.

The words of a file that have postings are those that are rarest in some template; each is looked up, which gives (template,
start) by the word's place in the file less that in the template.  The postings of first and second words are intersected by (template, start): a
template is aligned where both stand at its distance.  An alignment counts if the key phrase stands
word for word and enough of the other words agree.  No phrase of the templates can be missed: where it stands, its two rarest words do.

Only DataFrame functions are used.  Index and templates are literals of the plan (some numbers per template), so the plan doesn't
grow with their number; no text is shuffled; the counts have one row per template word.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the whole text with A-Z in lower case (other capitals stay).  Defined results:
a null or empty text has no words and no labels; repeated rows are scanned each for
itself; an empty table gives no rows (and any order of words will do); a template that would begin before the text doesn't
count; further columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: What separates words, in a text whose letters A-Z are lower case.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Words of the template that must all stand there; (first, last + 1). None: all.
    key: tuple[int, int] | None = None
    #: Least share of words that agree.
    least: float = 1.0
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()


# Phrases and labels of the contract, then customary license notices.
TEMPLATES = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
    Template("gpl-3", "gnu general public license version 3"),
    Template("gpl-2", "gnu general public license version 2"),
    Template("gpl-3", "gnu gpl version 3"),
    Template("gpl-2", "gnu gpl version 2"),
    Template("lgpl", "gnu lesser general public license"),
    Template("lgpl", "gnu library general public license"),
    Template("agpl-3", "gnu affero general public license"),
    Template("gfdl", "gnu free documentation license"),
    Template("mpl-2", "mozilla public license version 2"),
    Template("mpl-2", "mozilla public license v 2"),
    Template("apache-2", "licensed under the apache license"),
    Template("apache-2", "spdx license identifier apache 2 0"),
    Template("mit", "spdx license identifier mit"),
    Template("gpl-2", "spdx license identifier gpl 2 0"),
    Template("gpl-3", "spdx license identifier gpl 3 0"),
    Template("bsd", "spdx license identifier bsd"),
    Template("mit", "released under the mit license"),
    Template("mit", "mit licensed"),
    Template("bsd", "bsd 2 clause license"),
    Template("bsd", "bsd 3 clause license"),
    Template("bsd", "use of this source code is governed by a bsd style license", key=(7, 11), least=0.7),
    Template("epl", "eclipse public license"),
    Template("edl", "eclipse distribution license"),
    Template("cddl", "common development and distribution license"),
    Template("bsl-1", "boost software license version 1 0"),
    Template("artistic-2", "artistic license 2 0"),
    Template("zlib", "zlib license"),
    Template("ofl", "sil open font license"),
    Template("odbl", "open database license"),
    Template("eupl", "european union public licence"),
    Template("upl", "universal permissive license"),
    Template("ms-pl", "microsoft public license"),
    Template("psf", "python software foundation license"),
    Template("postgresql", "postgresql license"),
    Template("sspl", "server side public license"),
    Template("elastic-2", "elastic license 2 0"),
    Template("busl", "business source license"),
    Template("blueoak", "blue oak model license"),
    Template("wtfpl", "do what the fuck you want to public license", key=(0, 4), least=0.8),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-nc-sa", "cc by nc sa"),
    Template("cc-by-nc-nd", "cc by nc nd"),
    Template("cc-by", "creative commons attribution 4 0 international"),
    Template("cc-by-sa", "creative commons attribution sharealike"),
    Template("cc-by-sa", "creative commons attribution share alike"),
    Template("cc-by-nc", "creative commons attribution noncommercial"),
    Template("cc-by-nc", "creative commons attribution non commercial"),
    Template("cc0", "cc0 1 0"),
    Template("cc0", "creative commons zero"),
    Template("all-rights", "all rights reserved"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", key=(3, 5), least=0.8),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", key=(2, 7), least=0.8),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee", key=(0, 5), least=0.8),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", key=(0, 5), least=0.8),
    Template("no-warranty", "the software is provided as is without warranty of any kind express or implied", key=(3, 8), least=0.8),
)


def vocabulary(templates) -> list[str]:
    """The words of the templates; their numbers are their places here, from 1."""
    return sorted({w for t in templates for w in t.words})


def tagged(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids: the vocabulary's number of each word, 0 for other words."""
    known = vocabulary(templates)
    lowered = F.translate(F.coalesce(F.col(text_col), F.lit("")), CAPITALS, SMALL)
    words = F.array_remove(F.split(lowered, BREAK, -1), "")
    wanted = F.array(*map(F.lit, known))
    number = lambda w: F.when(w.isin(known), F.array_position(wanted, w).cast("int")).otherwise(0)
    return docs.select(F.col(id_col).alias("doc_id"), F.transform(words, number).alias("ids"))


def document_frequencies(rows: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Of the templates' words, over all texts; a row per word comes to the driver."""
    known = vocabulary(templates)
    found = rows.select(F.explode(F.array_distinct(F.filter("ids", lambda w: w > 0))).alias("word"))
    counts = {known[r["word"] - 1]: int(r["n"]) for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: counts.get(w, 0) for w in known}


def anchors(template: Template, df: dict[str, int]) -> list[tuple[str, int]]:
    """(word, relative position) of the two highest-IDF words inside the key phrase; the only word twice."""
    low, high = template.key or (0, len(template.words))
    ranked = sorted({(df.get(w, 0), w) for w in template.words[low:high]})
    found = [(w, template.words.index(w, low)) for _, w in ranked[:2]]
    return found if len(found) == 2 else found * 2


def _literal(value, kind: str) -> Column:
    """A nested value as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def lookups(ids: str, templates, df: dict[str, int]):
    """Column builders over the numbers of a text's words: the words that have postings, the alignments that the
    postings k (0, 1) of those lead to, and an alignment's (t, start, share), with a null share if it doesn't hold."""
    number = {w: k for k, w in enumerate(vocabulary(templates), 1)}
    postings: list[list[list[dict]]] = [[[] for _ in range(len(number) + 1)] for _ in range(2)]
    for t, template in enumerate(templates):
        for k, (word, at) in enumerate(anchors(template, df)):
            postings[k][number[word]].append({"t": t, "at": at})
    rare = sorted({k for lists in postings for k, own in enumerate(lists) if own})
    index = [_literal(lists, "array<array<struct<t:int,at:int>>>") for lists in postings]
    shapes = []
    for template in templates:
        low, high = template.key or (0, len(template.words))
        own = [number[w] for w in template.words]
        shapes.append({"ids": own, "key": own[low:high], "low": low, "n": len(own), "least": template.least})
    shapes = _literal(shapes, "array<struct<ids:array<int>,key:array<int>,low:int,n:int,least:double>>")
    many = len(templates)

    hits = F.filter(F.transform(ids, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(rare))

    def looked_up(k: int) -> Column:
        """start * many + t of each posting: one number, so that sets of them are intersected by hashing."""
        led = lambda h: F.transform(F.get(index[k], h["w"]), lambda p: (h["i"] - p["at"]).cast("long") * F.lit(many) + p["t"])
        return F.filter(F.flatten(F.transform("hits", led)), lambda x: x >= 0)

    def checked(x: Column) -> Column:
        start, t = F.floor(x / many).cast("int"), F.pmod(x, F.lit(many)).cast("int")
        shape = F.get(shapes, t)
        key = F.slice(F.col(ids), start + shape["low"] + 1, F.size(shape["key"])) == shape["key"]
        agree = F.size(F.filter(F.transform(shape["ids"], lambda w, j: F.get(F.col(ids), start + j).eqNullSafe(w)), lambda same: same))
        share = agree / shape["n"].cast("double")
        return F.struct(t.alias("t"), start.alias("start"), F.when(key & (share >= shape["least"]), share).alias("share"))

    return hits, looked_up, checked


def scan(docs: DataFrame, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = written(tagged(docs, templates, id_col, text_col), "license-words")
    df = document_frequencies(rows, templates)
    hits, looked_up, checked = lookups("ids", templates, df)
    none = F.array().cast("array<bigint>")
    found = rows.select("doc_id", "ids", F.when(F.exists("ids", lambda w: w > 0), hits).alias("hits"))
    found = found.select("doc_id", "ids", F.when(F.size("hits") > 0, F.array_intersect(looked_up(0), looked_up(1))).otherwise(none).alias("aligned"))
    found = found.select("doc_id", F.size("ids").cast("long").alias("n_words"), F.filter(F.transform("aligned", checked), lambda p: p["share"].isNotNull()).alias("places"))
    names = F.array(*[F.lit(t.label) for t in templates])
    base = [t for t, template in enumerate(templates) if template.base]
    starts = F.transform(F.filter("places", lambda p: p["t"].isin(base)), lambda p: p["start"])

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: F.get(names, p["t"])))), ",")

    return found.withColumn("starts", starts).select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        labels(F.filter("places", lambda p: p["t"].isin(base))).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
