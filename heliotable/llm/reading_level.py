"""Reading level of documents from 1 to 5 (problem 9).

Method: the smallest frequency-ranked vocabulary that covers a fixed share of a
document's tokens. The ids of a public byte-level vocabulary stand in the order
in which its words were learned, by frequency, so the quantile of the ids of a
document's prose is the rank up to which a vocabulary must reach to cover that
share. These ranks and the mean complexity of the document's sentences are
calibrated in SQL: Gaussian classes around the means of graded specimens, whose
centres are then moved, until they rest, with the distinct texts of the whole
corpus, since specimens are worded otherwise.

The order of the public vocabulary is taken, not that of the corpus: a corpus of
few templates ranks its own words first, however hard they are, and leaves the
specimens' words without a rank.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heliotable.llm.tokenize_corpus import TOKENIZER_DIR, encoder
from heliotable.plans.durable import cut
from heliotable.plans.joins import spread
from heliotable.plans.tables import in_parallel

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Shares of tokens to be covered.
SHARES = (0.5, 0.8, 0.9)
#: Least number of sentences that make running prose.
LEAST_SENTENCES = 3
LEVELS = (1, 2, 3, 4, 5)
#: The specimens' fixed share in the class centres, whatever the size of the corpus, and the rounds within which centres must rest, or there is an error.
HOLD, MOST_ROUNDS = 0.5, 1000
#: The most specimens that are used for fitting; a documented bound of a fixed table.
MOST_SPECIMENS = 10_000
_BULLET = re.compile(r"^\s*(?:[・●○*■□◆◇‣•\-–—]|\d{1,2}[.)]|[①-⑳])\s*")
_NOTE = re.compile(r"[(【\[][^()【】\[\]]{0,12}\d[^()【】\[\]]{0,6}[)】\]]")
_JA = re.compile("[ぁ-んァ-ヶ一-龥々]")
_END_JA = re.compile(r"[。!?]+|\n+")
_END_EN = re.compile(r"(?<=[.!?])\s+|\n+|;\s+")
_WORD = re.compile(r"[A-Za-z'-]+")
# Polite endings of Japanese sentences; the commonest words of English, by which a text is told to be English.
_POLITE = re.compile(r"(です|ます|ました|ません|ください|ましょう|でした|なあに|だよ|ね)か?[、]?$")
ENGLISH = set("the of and a to in is you that it for on are as with they at be this have from or by not but what all were we when your can there an each which do how if will".split())
#: Least share of those words in English prose.
LEAST_ENGLISH = 0.12
_NEUTRAL = re.compile("[​-‏⁠﻿­�]")

JA_COMPLEXITY = ("hiragana", "kanji", "katakana", "log_length", "kanji_run", "longest_run", "polite", "tokens_per_char", "commas", "spaces")
EN_COMPLEXITY = ("word_length", "log_words", "long_words", "longest_words", "tokens_per_word", "commas", "short_words", "past")
WIDTH = len(SHARES) + max(len(JA_COMPLEXITY), len(EN_COMPLEXITY))


def is_japanese(text: str) -> bool:
    return len(_JA.findall(text)) > 0.2 * len(text)


def sentences(text: str | None) -> tuple[bool, list[str], int]:
    """(Japanese, sentences, how many of them end as sentences do). Null, lists and logs give none of the latter.

    Lines broken within a sentence are joined; bullets, notes and page marks are left out.
    """
    t = _NEUTRAL.sub("", unicodedata.normalize("NFKC", text or ""))
    ja = is_japanese(t)
    parts = []
    for line in t.split("\n"):
        line = _BULLET.sub("", line).strip()
        parts.append((line if ja else line + " ") if line else "\n")
    joined = _NOTE.sub("", "".join(parts))
    found, ended, at = [], 0, 0
    for m in (_END_JA if ja else _END_EN).finditer(joined + "\n"):
        s = joined[at : m.start()].strip()
        mark = m[0] if ja else s[-1:]
        at = m.end()
        prose = len(re.findall("[ぁ-ん]", s)) >= 2 if ja else len(_WORD.findall(s)) >= 2
        if not prose:
            continue
        ended += any(c in mark for c in ("。!?" if ja else ".!?"))
        if len(s) >= (6 if ja else 12):
            found.append(s.rstrip(".!?"))
    return ja, found, ended


def is_english(found: list[str]) -> bool:
    words = [w.lower() for s in found for w in _WORD.findall(s)]
    return sum(w in ENGLISH for w in words) >= LEAST_ENGLISH * max(1, len(words))


def covering_rank(ids: list[int], share: float) -> int | None:
    """How many entries of the vocabulary, the commonest first, cover a share of sorted ids; None for no ids."""
    return ids[max(0, math.ceil(share * len(ids) - 1e-9) - 1)] + 1 if ids else None


def complexity(sentence: str, ja: bool, tokens: int) -> list[float]:
    n = len(sentence)
    if ja:
        runs = [len(x) for x in re.findall("[一-龥々]+", sentence)] or [0]
        share = [len(re.findall(f"[{c}]", sentence)) / n for c in ("ぁ-ん", "一-龥々", "ァ-ヶー")]
        return [*share, math.log(n), sum(runs) / len(runs), float(max(runs)), float(bool(_POLITE.search(sentence))), tokens / n, 10 * sentence.count("、") / n, 10 * sentence.count(" ") / n]
    words = _WORD.findall(sentence) or ["a"]
    m, long = len(words), [len(w) for w in words]
    return [sum(long) / m, math.log(m), sum(x >= 7 for x in long) / m, sum(x >= 10 for x in long) / m, tokens / m, sentence.count(",") / m, sum(x <= 3 for x in long) / m, sum(w.endswith("ed") for w in words) / m]


def document_vector(found: list[str], ja: bool, encode) -> list[float]:
    """Coverage ranks of a document's sentences together, as logarithms, and the mean complexity of its sentences."""
    each = [encode(s if ja else " " + s) for s in found]
    ids = sorted(i for x in each for i in x)
    means = [sum(c) / len(found) for c in zip(*[complexity(s, ja, len(x)) for s, x in zip(found, each)])]
    out = [math.log(covering_rank(ids, p) + 49) for p in SHARES] + means
    return out + [0.0] * (WIDTH - len(out))


_MEASURED = pa.schema([("doc", pa.string()), ("ja", pa.bool_()), ("ended", pa.int32()), ("n", pa.int64()), ("vector", pa.list_(pa.float64()))])
_MEASURED_DDL = "doc string, ja boolean, ended int, n bigint, vector array<double>"


def _measure(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, VOCABULARY).encode_ordinary
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                ja, found, ended = sentences(text)
                if ended and found and (ja or is_english(found)):
                    rows.append((doc, ja, ended, len(found), document_vector(found, ja, encode)))
            columns = list(zip(*rows)) or [[]] * len(_MEASURED)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _MEASURED)], schema=_MEASURED)

    return run


def measured(documents: DataFrame, folder: str = TOKENIZER_DIR, scan: DataFrame | None = None) -> DataFrame:
    """One row for each text of ``doc, text`` with Japanese or English sentences: its vector of coverage and complexity."""
    rows = in_parallel(documents.where("text <> ''").select(F.col("doc").cast("string").alias("doc"), "text"), scan)
    return rows.mapInArrow(_measure(folder), _MEASURED_DDL)


def class_table(specimens: DataFrame) -> dict:
    """{(Japanese, level): (means, spread)} of graded specimens; two languages, five levels: ten rows."""
    flat = specimens
    each = [F.col("vector")[i] for i in range(WIDTH)]
    wide = {r["ja"]: r["v"] for r in flat.groupBy("ja").agg(F.array(*[F.var_pop(x) for x in each]).alias("v")).collect()}
    rows = flat.groupBy("ja", "level").agg(F.array(*[F.avg(x) for x in each]).alias("m"), F.array(*[F.var_pop(x) for x in each]).alias("v")).collect()
    within: dict = {}
    for r in rows:
        within.setdefault(r["ja"], []).append(r["v"])
    spread = {ja: [sum(c) / len(c) + 0.02 * w + 1e-6 for c, w in zip(zip(*v), wide[ja])] for ja, v in within.items()}
    return {(r["ja"], r["level"]): (list(r["m"]), spread[r["ja"]]) for r in rows}


def scores_table(spark: SparkSession, classes: dict) -> DataFrame:
    """Two rows at most, one for each language: the linear scores of all levels, as data.

    Classes share their spread, so the difference of two log densities is linear in the features.
    """
    rows = []
    for ja in sorted({ja for ja, _ in classes}):
        weights, constants = [], []
        for level in LEVELS:
            means, spread = classes.get((ja, level), ([0.0] * WIDTH, [1.0] * WIDTH))
            weights.append([m / v for m, v in zip(means, spread)])
            constants.append(-0.5 * sum(m * m / v for m, v in zip(means, spread)) if (ja, level) in classes else -1e300)
        rows.append((ja, weights, constants))
    return spark.createDataFrame(rows, "ja boolean, weights array<array<double>>, constants array<double>")


# The five scores of a document, written out so that they are compiled; the weights are data, so rounds compile nothing anew.
_SCORES = "array(" + ", ".join(f"constants[{k}] + " + " + ".join(f"weights[{k}][{i}] * vector[{i}]" for i in range(WIDTH)) for k in range(len(LEVELS))) + ")"


def levelled(texts: DataFrame, classes: dict) -> DataFrame:
    """The texts with their level: the likeliest, the lower of equals. One narrow stage."""
    scored = texts.join(F.broadcast(scores_table(texts.sparkSession, classes)), "ja").withColumn("scores", F.expr(_SCORES))
    return scored.withColumn("level", F.array_position("scores", F.array_max("scores")).cast("int")).drop("scores", "weights", "constants")


def reading_levels(documents: DataFrame, samples: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id, reading_level`` of every document with at least three sentences of running prose.

    Null, empty and blank texts, lists, logs and fragments have no row. Of two
    equally likely levels the lower one is given. A document is Japanese by its
    signs or English by its commonest words, whatever its ``lang`` says; in
    another language, or one without graded specimens, it has no row. A repeated doc_id gives one row.
    """
    graded = samples.where("text <> '' and reading_level between 1 and 5").limit(MOST_SPECIMENS)
    specimens = measured(graded.select(F.col("sample_id").alias("doc"), "text"), folder).join(graded.select(F.col("sample_id").cast("string").alias("doc"), F.col("reading_level").alias("level")), "doc")
    first = class_table(cut(specimens))
    rows = documents.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2("text", 256).alias("doc"))
    # each text once: a copy has no say in the centres
    table = cut(measured(rows.select("doc", "text").dropDuplicates(["doc"]), folder, rows))
    prose = table.where(F.col("ended") >= LEAST_SENTENCES).where(F.col("ja").isin(sorted({ja for ja, _ in first})) if first else F.lit(False))
    # a doc_id of several texts is told by the one of most sentences
    levels = levelled(prose, settled(prose, first)).select("doc", "n", "ja", "level")
    best = rows.select("doc_id", "doc").join(spread(levels), "doc").groupBy("doc_id").agg(F.max(F.struct("n", "ja", "level")).alias("b"))
    return best.select("doc_id", F.col("b.level").alias("reading_level"))


def settled(prose: DataFrame, first: dict) -> dict:
    """The classes with their centres moved by texts until they rest.

    A centre is a fixed share of the specimens' mean and, for the rest, the mean
    of the class's texts, each of which counts the same however long it is. So
    neither the number of texts nor a text's length shifts the balance.
    """
    classes = first
    for _ in range(MOST_ROUNDS):
        means = levelled(prose, classes).groupBy("ja", "level").agg(F.array(*[F.avg(F.col("vector")[i]) for i in range(WIDTH)]).alias("means")).collect()
        moved = {(r["ja"], r["level"]): r["means"] for r in means}
        new = {key: ([HOLD * a + (1 - HOLD) * b for a, b in zip(own, moved.get(key, own))], spread) for key, (own, spread) in first.items()}
        rest = all(abs(a - b) < 1e-9 for k in new for a, b in zip(new[k][0], classes[k][0]))
        classes = new
        if rest:
            return classes
    raise RuntimeError(f"class centres still move after {MOST_ROUNDS} rounds")


def coverage(documents: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """``doc_id, tokens, rank_50, rank_80, rank_90``: how far down the frequency order a vocabulary must reach to cover
    those shares of a document's tokens. Null and empty texts have 0 tokens and null ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(folder, VOCABULARY).encode_ordinary
        for batch in batches:
            docs = batch.column("doc_id")
            rows = []
            for text in batch.column("text").to_pylist():
                ids = sorted(encode(text or ""))
                rows.append((len(ids), *(covering_rank(ids, p) for p in SHARES)))
            columns = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([docs, pa.array(columns[0], pa.int64()), *(pa.array(c, pa.int32()) for c in columns[1:])], names=["doc_id", "tokens", "rank_50", "rank_80", "rank_90"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, tokens bigint, rank_50 int, rank_80 int, rank_90 int")


def profile(documents: DataFrame, levels: DataFrame, by: list[str]) -> DataFrame:
    """How many documents of each level, and which share of those with one, by columns of the documents."""
    both = documents.select("doc_id", *by).join(spread(levels), "doc_id")
    counted = both.groupBy(*by, "reading_level").agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy(*by)), 6))
