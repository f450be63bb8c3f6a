"""License texts in documents: an exact set-similarity join of text blocks with templates."""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.llm.text import words

# Phrases whose words stand consecutively, and their labels
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices found by the share of their words in a block, with that share; a notice of up to ``SHORT`` words needs them all.
SHORT = 10
NOTICES = (
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", 0.8),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.8),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", 0.8),
    ("cc-by-nc", "licensed under cc by nc 4 0", 0.8),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", 0.8),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 0.8),
    ("mpl", "this source code form is subject to the terms of the mozilla public license", 0.8),
)
#: A block is ``BLOCK`` words and starts every ``STRIDE`` words, so any run of up to BLOCK - STRIDE + 1 words lies in the block that holds its start.
BLOCK, STRIDE = 64, 32


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    need: int             # distinct words a block has to hold
    phrase: bool = False  # its words also have to stand consecutively


def templates(phrases=None, notices=None) -> list[Template]:
    found = []
    for text, label in (PHRASES if phrases is None else phrases).items():
        w = tuple(text.split())
        if len(w) > BLOCK - STRIDE + 1:
            raise ValueError(f"a phrase has at most {BLOCK - STRIDE + 1} words")
        found.append(Template(label, w, len(set(w)), True))
    for label, text, share in NOTICES if notices is None else notices:
        w = tuple(dict.fromkeys(text.split()))
        found.append(Template(label, w, len(w) if len(w) <= SHORT else math.ceil(share * len(w) - 1e-9)))
    return found


def _strings(values) -> F.Column:
    return F.array(*[F.lit(v) for v in values])


def token_order(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> list[str]:
    """The template words from rare to common in all documents; one row for each word of the templates comes back."""
    seen = (docs.select(F.explode(words(F.col(text_col))).alias("word")).filter(F.col("word").isin(vocabulary))
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect())
    n = {r.word: r.n for r in seen}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def find_licenses(docs: DataFrame, wanted: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, places, base_labels, labels, score)``, a row for each row of ``docs``.

    ``places`` are the word positions at which phrases stand, in order (one entry for each phrase and
    place), ``base_labels`` their labels, ``labels`` these and the labels of all templates of which some
    block of ``BLOCK`` words holds the needed number of words; ``score`` is the largest share of a
    template's words that such a block holds (of a phrase: that stands there), else 0.

    The join is exact. Words are ordered by their number in all documents. A block that holds
    ``need`` of a template's t words holds one of its first t - need + 1, so only blocks with a word
    of such a prefix go on; such a match at place i of the template and j of the block's
    template words leaves at most min(t - i, b - j) common words, which has to reach ``need``, and the
    block's own prefix and length bound it likewise. What remains is counted exactly.

    Null and empty texts have no words; repeated rows come out repeated; other columns are ignored.
    The templates are the only thing sent to tasks. Blocks of one text are cut inside its row."""
    wanted = templates() if wanted is None else wanted
    order = token_order(docs, sorted({w for t in wanted for w in t.words}), text_col)
    rank = {w: i for i, w in enumerate(order)}
    sets = [sorted({rank[w] for w in t.words}) for t in wanted]
    entries: dict[int, list[tuple[int, int]]] = {}
    for k, t in enumerate(wanted):
        for at, r in enumerate(sets[k][: len(sets[k]) - t.need + 1]):
            entries.setdefault(r, []).append((k, at))
    prefix = _strings(order[r] for r in sorted(entries))
    index = docs.sparkSession.createDataFrame(
        [(r, [(k, at, len(sets[k]), wanted[k].need) for k, at in es]) for r, es in sorted(entries.items())],
        "rank int, entries array<struct<t:int,at:int,size:int,need:int>>")

    split = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), words(F.col(text_col)).alias("w"))
    n_blocks = F.ceil(F.size("w") / STRIDE).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda b: F.struct(b.alias("b"), F.slice("w", b * STRIDE + 1, F.lit(BLOCK)).alias("words")))
    blocks = F.when(F.arrays_overlap("w", prefix), F.filter(cut, lambda x: F.arrays_overlap(x["words"], prefix)))
    rows = split.select("id", "text_key", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(blocks).alias("k", "block"))
    # a block's template words as sorted ranks
    rank_of = F.map_from_arrays(_strings(order), F.array(*[F.lit(i) for i in range(len(order))]))
    ranks = F.array_sort(F.transform(F.array_intersect(F.col("block.words"), _strings(order)), lambda x: F.element_at(rank_of, x)))
    rows = rows.select("id", "text_key", "n_words", "k", F.col("block.b").alias("b"), F.col("block.words").alias("words"), ranks.alias("ranks"))
    tokens = rows.select("*", F.posexplode_outer("ranks").alias("j", "rank"))
    left = F.size("ranks") - F.col("j")
    fits = F.transform(F.filter("entries", lambda e: F.least(e["size"] - e["at"], left) >= e["need"]), lambda e: e["t"])
    first = (F.col("k").isNull() | (F.col("k") == 0)) & (F.col("j").isNull() | (F.col("j") == 0))
    met = tokens.join(index, "rank", "left").select("id", "text_key", "n_words", "b", "words", "ranks", fits.alias("fits"), first.cast("long").alias("first"))
    # one row for each candidate block, one for each text without any
    per_block = met.groupBy("id", "text_key", "b").agg(
        F.first("n_words").alias("n_words"), F.first("words").alias("words"), F.first("ranks").alias("ranks"), F.sum("first").alias("copies"),
        F.array_distinct(F.flatten(F.collect_set("fits"))).alias("fits"))
    lists = F.array(*[F.array(*[F.lit(r) for r in s]) for s in sets])
    needs = F.array(*[F.lit(t.need) for t in wanted])
    common = lambda t: F.size(F.array_intersect("ranks", F.get(lists, t)))
    found = per_block.withColumn("found", F.filter("fits", lambda t: common(t) >= F.get(needs, t)))

    def stands(k: int, t: Template):
        """Places at which a phrase starts in the first ``STRIDE`` words of a block."""
        at = F.filter(F.sequence(F.lit(0), F.lit(STRIDE - 1)), lambda i: F.slice("words", i + 1, F.lit(len(t.words))) == _strings(t.words))
        at = F.transform(at, lambda i: (F.col("b") * STRIDE + i).cast("long"))
        return F.when(F.array_contains("found", k), at).otherwise(F.array().cast("array<long>")).alias(f"at{k}")

    phrases = [(k, t) for k, t in enumerate(wanted) if t.phrase]
    found = found.select("id", "text_key", "n_words", "copies", "found", "ranks", *[stands(k, t) for k, t in phrases])
    none = F.array().cast("array<string>")
    label_of = _strings(t.label for t in wanted)
    base = F.concat(none, *[F.when(F.size(f"at{k}") > 0, _strings([t.label])).otherwise(none) for k, t in phrases])
    own = F.transform(F.filter("found", lambda t: ~t.isin([k for k, _ in phrases])), lambda t: F.get(label_of, t))
    stood = F.array(*[F.size(f"at{k}") > 0 if t.phrase else F.lit(True) for k, t in enumerate(wanted)])
    counted = F.filter("found", lambda t: F.get(stood, t))
    share = F.array_max(F.transform(counted, lambda t: common(t) / F.size(F.get(lists, t))))
    found = found.select("id", "text_key", "n_words", "copies", F.concat(F.array().cast("array<long>"), *[F.col(f"at{k}") for k, _ in phrases]).alias("places"),
                         base.alias("base"), F.concat(base, own).alias("labels"), share.alias("share"))
    per_doc = found.groupBy("id", "text_key").agg(
        F.first("n_words").alias("n_words"), F.sum("copies").alias("copies"), F.array_sort(F.flatten(F.collect_list("places"))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("base")))).alias("base_labels"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"), F.coalesce(F.max("share"), F.lit(0.0)).alias("score"))
    per_doc = per_doc.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return per_doc.select(F.col("id").alias(id_col), "n_words", "places", "base_labels", "labels", "score")
