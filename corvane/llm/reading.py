"""Reading level of each document, by a familiar-word formula.

The formula is that of familiar-word measures: the share of words outside a list of
familiar words, plus the average sentence length. Both decide, on one scale. The list
comes from the corpus's document frequencies: first the words that very many of all
documents hold, then those that many of the documents hold which the formula itself puts
within a general reader's reach, and so on until the list settles. Frequencies
are counted over all English documents. Weights and cut points of the formula are fitted
on a bounded sample of labelled documents; without labels they are published constants.

Only a document's own prose counts: fenced code, quoted blocks, tables, logs and
sentences that carry identifiers, paths or code are left out, bullets and hard-wrapped
lines are put together again. A document without prose has no level.
"""

from __future__ import annotations

import re
import warnings
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import cut_table, spread

#: At most so many labelled documents, those of the smallest hashes of doc_id, are used to fit.
MAX_LABELLED = 20_000
#: The first list has the words that so large a share of all documents hold, later lists
#: those that so large a share of the general documents hold ...
FIRST_SHARE, FAMILIAR_SHARE = 0.2, 0.003
#: ... and relative to the others at least so often.
RELATIVE = 0.5
#: Lists settle when so small a share of them changes (on the given tables in three rounds);
#: with too few labels they may not, which is said after so many rounds.
STABLE, MOST_ROUNDS = 0.01, 12
#: A list has at most so many words, the most frequent ones.
FAMILIAR_WORDS = 50_000
DEMANDING = 4
#: Dale and Chall's weights and extra term, and the scores from which on levels 2 to 5 begin. Fixed values.
PUBLISHED = {"share": 15.79, "length": 0.0496, "extra": 3.6365, "extra_from": 0.05, "cuts": (5.0, 7.0, 9.0, 10.0)}

_FENCE = re.compile(r"^[ \t>#*|/]*(```|~~~).*?(^[ \t>#*|/]*\1|\Z)", re.S | re.M)
_BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")
_HEADING = re.compile(r"^\s{0,3}#{1,6}\s+\S")
_MARKED = re.compile(r"^\s*(>|#|\||//|--|%)")
_HYPHEN = re.compile(r"(?<=[^\W\d_])-[ \t]*\n[ \t]*(?=[^\W\d_])")
_CODE = re.compile(r"\w_\w|\w/\w|\b[A-Z]?[a-z]+[A-Z]\w*|`|\w\.\w|[=(){}\[\]<>|\\]|::|->|https?:|\d{4}-\d\d-\d\d")
#: Without one of these after its first letter a sentence holds no code.
_SUSPECT = re.compile(r"[_/`=(){}\[\]<>|\\:.\dA-Z]")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)]*\s+|\n+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: Frequent words that tell three languages apart. Fixed values.
_COMMON = {
    "en": frozenset("the a an and or of to in is are it that this we you i with for on not but if when at by from be was then".split()),
    "de": frozenset("der die das ein eine und oder von zu im ist sind es dass wir sie ich mit für auf nicht aber wenn bei wird den dem".split()),
    "es": frozenset("el la los las un una y o de a en es son que no con por para si cada del se lo su al como".split()),
}


def _blocks(text: str, keep_marked: bool) -> list[str]:
    """Paragraphs and list items of own prose, each on one line."""
    text = _FENCE.sub("\n\n", text.replace("\r\n", "\n").replace("\r", "\n"))
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if not line.strip():
            out.append([])
        elif _MARKED.match(line):
            out.append([])
            bare = line.lstrip(" \t>#|/-%")
            if keep_marked and bare and not (_HEADING.match(line) and len(bare.split()) < 6):
                out[-2].append(bare) if out[-2] and keep_marked else out[-1].append(bare)
        elif _BULLET.match(line):
            out.append([_BULLET.sub("", line)])
        else:
            out[-1].append(line.strip())
    return [_HYPHEN.sub("", "\n".join(b)).replace("\n", " ") for b in out if b]


def sentences(text: str | None) -> list[list[str]]:
    """Lower-case words of each sentence of a document's own prose. If all of it is
    marked (quoted or in comment style), the marks are taken as layout."""
    if not text or not text.strip():
        return []
    for keep_marked in (False, True):
        found = []
        for block in _blocks(text, keep_marked):
            for s in _SENTENCE.split(block):
                if _SUSPECT.search(s.rstrip(".!?\"”’) "), 1) and _CODE.search(s):
                    continue
                words = _WORD.findall(s.lower())
                if len(words) >= 3:
                    found.append(words)
        if found:
            return found
    return []


def is_english(lang: str | None, times: Counter) -> bool:
    """By the text's own frequent words; the stated language decides where they don't."""
    score = {k: sum(times[w] for w in v) for k, v in _COMMON.items()}
    others = max(v for k, v in score.items() if k != "en")
    if score["en"] != others:
        return score["en"] > others
    return (lang or "en").strip().lower()[:2] == "en"


def _prose(batches):
    for b in batches:
        ids, words, times, counts = [], [], [], []
        for d, text, lang in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), b["lang"].to_pylist()):
            found = sentences(text)
            n = Counter(w for s in found for w in s)
            if n and is_english(lang, n):
                ids.append(d)
                words.append(list(n))
                times.append(list(n.values()))
                counts.append(len(found))
        kinds = (pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((ids, words, times, counts), kinds)], ["doc_id", "words", "times", "n_sentences"])


PROSE = "doc_id bigint, words array<string>, times array<int>, n_sentences int"


def _features(b, familiar):
    """Of the documents of a batch the share of words outside the list and the average
    sentence length, with the batch's vocabulary, its places in it and words per document."""
    times = b["times"].flatten().to_numpy()
    coded = b["words"].flatten().dictionary_encode()
    strange = np.array([w not in familiar for w in coded.dictionary.to_pylist()], float)[coded.indices.to_numpy()]
    sizes = pc.list_value_length(b["words"]).to_numpy()
    starts = np.cumsum(sizes) - sizes
    n = np.add.reduceat(times, starts).astype(float)
    return np.add.reduceat(strange * times, starts) / n, n / b["n_sentences"].to_numpy(), coded, sizes


def _scored(familiar):
    def run(batches):
        for b in batches:
            if b.num_rows:
                share, length, _, _ = _features(b, familiar.value)
                yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(share), pa.array(length)], ["doc_id", "share", "length"])

    return run


def _frequencies(familiar, formula):
    """Per word the general documents (g) and the others (o) that hold it, in part; the row
    of the empty word counts the documents themselves. Without a formula all are general."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                share, length, coded, sizes = _features(b, familiar.value)
                general = np.ones(len(share), bool) if formula is None else formula.value(share, length) < formula.demanding
                at, in_general = coded.indices.to_numpy(), np.repeat(general, sizes)
                k = len(coded.dictionary)
                g, every = np.bincount(at[in_general], minlength=k), np.bincount(at, minlength=k)
                words = coded.dictionary.to_pylist() + [""]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(words, pa.string()), pa.array(np.append(g, general.sum()).astype(np.int64)), pa.array(np.append(every - g, (~general).sum()).astype(np.int64))], ["w", "g", "o"]
                )

    return run


def best_cut(score: np.ndarray, above: np.ndarray) -> float:
    """The threshold from which on ``above`` is predicted with the fewest errors; the
    middle of the gap it lies in."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], above[order].astype(int)
    errors = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    free = np.concatenate([[True], s[1:] > s[:-1], [True]])  # no cut between equal scores
    places = np.flatnonzero(free & (errors == errors[free].min()))
    k = places[len(places) // 2]
    return float(s[0] - 1e-9 if k == 0 else s[-1] + 1e-9 if k == len(s) else (s[k - 1] + s[k]) / 2)


class Formula:
    """score = intercept + a * share of unfamiliar words + b * log(average sentence length),
    with the scores from which on levels 2 to 5 begin."""

    def __init__(self, share, length, grade):
        x = self._inputs(np.asarray(share), np.asarray(length))
        self.weights = np.linalg.solve(x.T @ x + 1e-6 * np.eye(3), x.T @ np.asarray(grade))
        score = x @ self.weights
        cuts = [best_cut(score, np.asarray(grade) >= g - 0.5) for g in range(2, 6)]
        self.demanding = cuts[DEMANDING - 2]
        self.cuts = [min(cuts[0], cuts[1], self.demanding), min(cuts[1], self.demanding), self.demanding, max(cuts[3], self.demanding)]

    @staticmethod
    def _inputs(share, length):
        return np.column_stack([np.ones(len(share)), share, np.log(np.maximum(length, 1.0))])

    def value(self, share, length):
        return self._inputs(share, length) @ self.weights

    def column(self) -> Column:
        one, share, length = (F.lit(float(w)) for w in self.weights)
        return one + share * F.col("share") + length * F.log(F.greatest("length", F.lit(1.0)))


class Published:
    """The formula with published constants, for a corpus without labels."""

    cuts, demanding = PUBLISHED["cuts"], PUBLISHED["cuts"][DEMANDING - 2]

    def column(self) -> Column:
        extra = F.when(F.col("share") > PUBLISHED["extra_from"], PUBLISHED["extra"]).otherwise(0.0)
        return PUBLISHED["share"] * F.col("share") + PUBLISHED["length"] * F.col("length") + extra


def familiar_words(prose: DataFrame, familiar, formula, share: float, relative: float = RELATIVE) -> frozenset[str]:
    """The words that at least ``share`` of the general documents hold, and at least
    ``relative`` as often as the others, the FAMILIAR_WORDS most frequent ones."""
    words = cut_table(prose.mapInArrow(_frequencies(familiar, formula), "w string, g bigint, o bigint").groupBy("w").agg(F.sum("g").alias("g"), F.sum("o").alias("o")), "reading-words")
    total = words.df.where("w = ''").first()
    n_general, n_other = (total["g"], total["o"]) if total else (0, 0)
    listed = words.df.where((F.col("w") != "") & (F.col("g") >= share * n_general) & (F.col("g") * n_other >= F.col("o") * F.lit(relative) * n_general) & (F.col("g") > 0))
    found = frozenset(r["w"] for r in listed.orderBy(F.desc("g"), "w").limit(FAMILIAR_WORDS).select("w").collect())
    words.drop()
    return found


def reading_levels(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, familiar_share: float = FAMILIAR_SHARE) -> DataFrame:
    """doc_id, unfamiliar_share, sentence_length, level (1 to 5), too_demanding: one row
    per English document with prose of its own.

    ``documents``: doc_id, text, lang; ``labels``: doc_id, rater_id, grade. Null grades
    and grades outside 1 to 5 are ignored and repeated rows count once; a document's
    grade is the mean over its raters. Null and blank texts, texts in other languages,
    tables, logs and bare code have no row. Without any usable label the list is that of
    all documents and weights and cut points are the published ones. Repeated documents
    have a row each.
    """
    spark = documents.sparkSession
    send = spark.sparkContext.broadcast  # lists of at most FAMILIAR_WORDS words
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text", "lang")
    prose = cut_table(spread(rows).mapInArrow(_prose, PROSE), "reading").df
    graded = labels.where("doc_id is not null and grade between 1 and 5").select("doc_id", "rater_id", "grade").distinct().groupBy("doc_id").agg(F.avg("grade").alias("grade"))
    sample = cut_table(graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled), "reading-sample").df
    known = cut_table(prose.join(F.broadcast(sample), "doc_id"), "reading-known").df
    schema = "doc_id bigint, share double, length double"

    def fitted(familiar):
        mine = known.drop("grade").mapInArrow(_scored(familiar), schema).join(F.broadcast(sample), "doc_id").select("share", "length", "grade").collect()
        return Formula(*(np.array([r[c] for r in mine], float) for c in ("share", "length", "grade"))) if mine else None

    empty = send(frozenset())
    labelled = not known.isEmpty()
    listed = familiar_words(prose, empty, None, FIRST_SHARE if labelled else familiar_share)
    familiar = send(listed)
    formula = fitted(familiar) if labelled else Published()
    for n in range(MOST_ROUNDS if labelled else 0):
        before, listed = listed, familiar_words(prose, familiar, formula, familiar_share)
        familiar = send(listed)
        formula = fitted(familiar)
        if len(before ^ listed) <= STABLE * len(listed):
            break
        if n == MOST_ROUNDS - 1:
            warnings.warn("the list of familiar words didn't settle: too few labels for this corpus", stacklevel=2)
    level = F.lit(1)
    for cut in formula.cuts:
        level = level + (F.col("value") >= float(cut)).cast("int")
    final = prose.mapInArrow(_scored(familiar), schema).withColumn("value", formula.column())
    return final.select("doc_id", F.col("share").alias("unfamiliar_share"), F.col("length").alias("sentence_length"), level.alias("level"), (F.col("value") >= float(formula.demanding)).alias("too_demanding"))
