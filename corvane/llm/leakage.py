"""Evaluation passages inside training documents, by spaced-seed hashing.

Words of test items and documents are hashed under a few fixed masks that ignore
selected positions; hashes of the test side are joined with those of the documents,
and around every hit an alignment decides whether the document holds a stretch of
the item in order with few enough words replaced, dropped or inserted.

The contiguous mask makes the search lossless: a stretch of L >= 20 words with at
most L/5 edits has L - e unedited words in e + 1 runs, so a run of four at least.
The other masks of the same weight see past a replaced word.

Both sides may be of any size. What is broadcast is one bitmap of fixed size, in
which every hash of the test side sets two bits: it keeps nearly all other hashes of the
documents out of the join and loses none. Only documents with a hit are written, and
only the words around hits meet the items.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import cut_table, hot_parts, salted_join, spread
from .bitmaps import bitmap_of, known

MASKS = ("1111", "11011", "110101", "101011")
LEAST_WORDS = 20
#: One word in so many may be edited.
EDIT_SHARE = 5
#: A closing sentence that so many questions share is a stock instruction.
STOCK_ITEMS = 3

#: Cyrillic and Greek letters that look like Latin ones. Fixed values.
LOOKALIKES = str.maketrans("асеԁһіјӏорԛѕԝхуοαεικνρτυχАВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "acedhijlopqswxyoaeiknptuxABEKMHOPCTYXIJSABEZHIKMNOPTYX")
_CYRILLIC_GREEK = re.compile(r"[Ͱ-ϿЀ-ԯ]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-‐­][ \t]*\r?\n[\s>#*|/]*(?=[^\W\d_])")
_INVISIBLE = re.compile(r"[­​-‍⁠﻿]")
_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>")
_WORD = re.compile(r"[^\W_]+")


def _latin(m: re.Match) -> str:
    """A word in Latin letters if look-alikes make it one; other words stay."""
    plain = m.group().translate(LOOKALIKES)
    return m.group() if _CYRILLIC_GREEK.search(plain) else plain


def words_of(text: str | None) -> list[str]:
    """Runs of letters or digits, lower case. Words broken over a line are joined;
    tags, entities, invisible characters and letters of look-alike scripts inside
    Latin words don't matter. Null text has no words."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
        if _CYRILLIC_GREEK.search(text):
            text = _WORD.sub(_latin, text)
    if "-" in text or "‐" in text:
        text = _HYPHEN.sub("", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return _WORD.findall(text.lower())


def holds_straight(item: np.ndarray, doc: np.ndarray, least: int = LEAST_WORDS, share: int = EDIT_SHARE) -> bool:
    """``holds_stretch`` for stretches in which words are only replaced, all at once: on
    every diagonal a sum of 1 a word less ``share`` a replaced one may not fall below 0."""
    n, m = len(item), len(doc)
    if n < least or m < least:
        return False
    far = np.full(m + 2 * n, -(2**62), np.int64)
    far[n : n + m] = doc
    same = np.lib.stride_tricks.sliding_window_view(far, n)[1:] == item  # a row per diagonal
    same = same[same.sum(axis=1) >= least - least // share]
    total = np.cumsum(np.where(same, 1, 1 - share), axis=1)
    before = np.where(same, total - 1, 10**6)  # where a stretch may begin: the sum ahead of it
    lowest = np.minimum.accumulate(before, axis=1)[:, : n - least + 1]
    return bool((same[:, least - 1 :] & (total[:, least - 1 :] >= lowest)).any())


def holds_stretch(item: np.ndarray, doc: np.ndarray, least: int = LEAST_WORDS, share: int = EDIT_SHARE) -> bool:
    """Whether ``doc`` holds a stretch of at least ``least`` successive words of
    ``item`` with at most one edit in ``share`` item words; its ends are unedited.

    best[l, j]: the greatest (item words - share * edits) of an alignment that ends
    at the j-th document word and covers l item words, l cut at ``least``.
    """
    m = len(doc)
    low = -(10**6)
    best = np.full((least + 1, m + 1), low, np.int64)
    best[0] = 0
    slope = share * np.arange(m + 1)
    for word in item:
        same = np.concatenate([[False], doc == word])
        step = np.full((least + 1, m + 1), low, np.int64)  # words consumed by one more item word
        before = np.concatenate([np.full((least + 1, 1), low, np.int64), best[:, :-1]], axis=1)
        match = np.where(same, before + 1, low)
        # Edits continue a stretch but don't begin one: l = 0 can't be edited.
        edit = np.maximum(before, best) + 1 - share
        edit[0] = low
        moved = np.maximum(match, edit)
        step[1:] = moved[:-1]
        step[least] = np.maximum(step[least], moved[least])
        ends = np.maximum(match[least - 1], match[least])
        if (ends >= 0).any():
            return True
        step[1:] = np.maximum.accumulate(step[1:] + slope, axis=1) - slope  # document words inserted
        step[0] = 0
        best = step
    return False


def dense_enough(items: list[np.ndarray], docs: list[np.ndarray], least: int = LEAST_WORDS, share: int = EDIT_SHARE) -> np.ndarray:
    """Per pair a bound that any stretch meets: L item words with at most L/share edits take
    at most L + L/share document words, of which L - L/share or more are the item's, so some
    window of least + least/share document words holds least - least/share of them."""
    if not docs:
        return np.zeros(0, bool)
    width, need = least + least // share, least - least // share
    key = lambda parts: (np.concatenate(parts).astype(np.uint64) + np.repeat(np.arange(len(parts), dtype=np.uint64), [len(p) for p in parts]) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    size = np.array([len(d) for d in docs])
    so_far = np.concatenate([[0], np.cumsum(np.isin(key(docs), key(items)))])
    start = np.cumsum(size) - size
    last = np.minimum(np.arange(size.sum()) + width, np.repeat(start + size, size))
    inside = so_far[last] - so_far[np.arange(size.sum())]
    most = np.zeros(len(docs), np.int64)
    some = size > 0
    most[some] = np.maximum.reduceat(inside, start[some])
    return most >= need


def word_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit codes of all words of the texts, one after another, and their numbers."""
    words = [words_of(t) for t in texts]
    flat = pa.array([w for some in words for w in some], pa.string()).dictionary_encode()
    known = [int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little", signed=True) for w in flat.dictionary.to_pylist()]
    return np.array(known, np.int64)[flat.indices.to_numpy()] if known else np.zeros(0, np.int64), np.array([len(w) for w in words], np.int64)


def seeds(codes: np.ndarray, sizes: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash, place) of the places of concatenated texts at which the mask fits in a text."""
    spots = [k for k, c in enumerate(mask) if c == "1"]
    n = len(codes) - spots[-1]
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    key = np.full(n, int(mask, 2), np.uint64)
    for k in spots:
        key = (key ^ codes[k : k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    place = np.flatnonzero(of[:n] == of[spots[-1] :])
    return key.astype(np.int64)[place], place


def _part_codes(batches):
    for b in batches:
        codes, sizes = word_codes(b["text"].to_pylist())
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(codes))
        yield pa.RecordBatch.from_arrays([b["item_id"], lists], ["item_id", "words"]).filter(pa.array(sizes >= LEAST_WORDS))


def _part_seeds(batches):
    for b in batches:
        sizes = np.array([len(w) for w in b["words"]], np.int64)
        codes = b["words"].flatten().to_numpy()
        parts, lengths = b["part"].to_numpy(), sizes
        of = np.repeat(np.arange(len(sizes)), sizes)
        for mask in MASKS:
            h, place = seeds(codes, sizes, mask)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(parts[of[place]]), pa.array(lengths[of[place]].astype(np.int32))], ["h", "part", "n"])


def _document_hits(bitmap):
    """Documents with a hash that the filter knows: their words and those hashes."""

    def run(batches):
        bits = bitmap.value
        for b in batches:
            codes, sizes = word_codes(b["text"].to_pylist())
            start = np.cumsum(sizes) - sizes
            of = np.repeat(np.arange(len(sizes)), sizes)
            found = []
            for mask in MASKS:
                h, place = seeds(codes, sizes, mask)
                hit = known(bits, h)
                found.append((h[hit], place[hit]))
            h, place = (np.concatenate(x) for x in zip(*found))
            doc = of[place]
            order = np.argsort(doc, kind="stable")
            h, place, doc = h[order], place[order], doc[order]
            hit = np.unique(doc)
            if not len(hit):
                continue
            ends = np.concatenate([[0], np.searchsorted(doc, hit, "right")])
            hashes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(h))
            places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((place - start[doc]).astype(np.int32)))
            words = pa.array([codes[start[k] : start[k] + sizes[k]] for k in hit], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(hit)), words, hashes, places], ["doc_id", "words", "hashes", "places"])

    return run


def _verified(batches):
    for b in batches:
        items, docs = ([np.asarray(w) for w in b[c].to_numpy(zero_copy_only=False)] for c in ("item_words", "near"))
        kept = dense_enough(items, docs)
        kept[kept] = [holds_straight(items[k], docs[k]) or holds_stretch(items[k], docs[k]) for k in np.flatnonzero(kept)]
        yield b.select(["doc_id", "item_id"]).filter(pa.array(kept))


def _normal(text) -> Column:
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def _sentences(text: str) -> Column:
    """The sentences of a column, blank ones left out."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?:])\s+|\n+"), lambda s: _normal(s) != "")


def stock_sentences(rows: DataFrame) -> DataFrame:
    """(s): closing sentences of under LEAST_WORDS words, normalised, that STOCK_ITEMS
    different questions share; copies of a question count once. Longer ones could be leaked
    passages themselves, and an answer has no instructions."""
    last = rows.select(_normal(F.try_element_at(_sentences("question"), F.lit(-1))).alias("s"), _normal(F.col("question")).alias("whole"))
    some = last.where("s <> ''").groupBy("s").agg(F.count_distinct("whole").alias("n")).where(F.col("n") >= STOCK_ITEMS)
    return some.where(F.size(F.split("s", " ")) < LEAST_WORDS).select("s")


def item_texts(items: DataFrame) -> DataFrame:
    """(item_id, text) of questions without their closing stock instructions, and answers."""
    rows = items.where("item_id is not null").select("item_id", "question", "answer").distinct()
    asked = rows.where("question is not null").select("item_id", "question").distinct().withColumn("said", _sentences("question")).withColumn("row", F.monotonically_increasing_id())
    asked = cut_table(asked.select("row", "item_id", "said"), "questions").df
    each = asked.select("row", F.posexplode("said").alias("at", "sentence")).withColumn("s", _normal(F.col("sentence")))
    own = each.join(stock_sentences(rows), "s", "left_anti").groupBy("row").agg(F.max("at").alias("last"))
    kept = asked.join(own, "row").select("item_id", F.array_join(F.slice("said", 1, F.col("last") + 1), "\n").alias("text"))
    return kept.unionByName(rows.where("answer is not null").select("item_id", F.col("answer").alias("text"))).distinct()


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id), once each, of documents whose text holds a passage of an
    item's question or answer: at least 20 successive words of it, in order, with at
    most one in five replaced, dropped or inserted.

    Null and blank texts hold nothing; rows with a null id are left out; a doc_id or
    item_id with several texts counts with each of them. Closing sentences of
    ``stock_sentences`` are stock instructions and no passage. A table of items without
    words gives no rows.
    """
    spark = documents.sparkSession
    parts = item_texts(items).mapInArrow(_part_codes, "item_id bigint, words array<bigint>").withColumn("part", F.monotonically_increasing_id())
    parts = cut_table(parts, "leak-parts").df
    seeded = cut_table(parts.mapInArrow(_part_seeds, "h bigint, part bigint, n int").distinct(), "leak-seeds").df
    bitmap = spark.sparkContext.broadcast(bitmap_of(seeded.select("h").distinct()))
    texts = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))
    near = texts.mapInArrow(_document_hits(bitmap), "doc_id bigint, words array<bigint>, hashes array<bigint>, places array<int>")
    docs = cut_table(near.withColumn("doc", F.monotonically_increasing_id()), "leak-documents").df
    bitmap.destroy()

    said = docs.select("doc", F.explode(F.arrays_zip("hashes", "places")).alias("z")).select(F.col("z.hashes").alias("h"), "doc", F.col("z.places").alias("at"))
    hits = salted_join(said, seeded, "h", spread=F.xxhash64("doc"))
    # An item of n words covers at most this many words of a text, so a stretch around a hit
    # lies within as many before and behind it. Hits of one item near each other are one.
    reach = (F.col("n") + F.floor(F.col("n") / EDIT_SHARE) + 1).cast("int")
    spots = hits.withColumn("reach", reach).groupBy("doc", "part", "reach", F.floor(F.col("at") / F.col("reach")).alias("k")).agg(F.min("at").alias("low"), F.max("at").alias("high"))
    spots = cut_table(spots.drop("k"), "leak-spots").df
    begin = F.greatest(F.col("low") - F.col("reach"), F.lit(0))
    around = salted_join(spots, docs.select("doc", "doc_id", "words"), "doc", spread=F.xxhash64("part"))
    around = around.select("doc", "doc_id", "part", F.slice("words", begin + 1, F.col("high") + F.col("reach") - begin).alias("near"))
    met = salted_join(around, parts.select("part", "item_id", F.col("words").alias("item_words")), "part", spread=F.xxhash64("doc"), hot=hot_parts(spots, "part"))
    return met.select("doc_id", "item_id", "item_words", "near").mapInArrow(_verified, "doc_id bigint, item_id bigint").distinct()
