"""Language identification by word scores and a Viterbi pass.

A word's script narrows the languages that may own it; its character n-grams
score those. A Viterbi pass over the words, with a penalty for switching,
labels spans of mixed text; a document's language is the one with most
letters in its spans.

The model is counted from a bounded sample of labelled rows (at most
``per_language`` documents of each language), whole texts.
"""

from __future__ import annotations

import hashlib
import math
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, held, in_groups, read_table, text_or_empty

UNKNOWN = "und"
#: Words in a block of the Viterbi pass; blocks run side by side.
BLOCK = 64
CACHE_WORDS = 200_000
SWITCH, FOREIGN, CLIP = 10.0, -30.0, 12.0
_WORD = re.compile(r"[^\W\d_]+")
#: Signs of numbers that are no decimal digits (fractions, superscripts, Roman numerals): the pattern above would take them for letters.
_SIGNS = re.compile("[" + "".join(c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) in ("No", "Nl")) + "]")
#: First and last code point of ranges by script.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F),
    ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF),
    ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    words = _WORD.findall(text.lower())
    if text.isascii() or all(map(str.isalpha, words)):
        return words
    return _WORD.findall(_SIGNS.sub(" ", text).lower())


def script_of(word: str) -> str:
    """The script of most of a word's letters, the first of equals."""
    if word.isascii():
        return "latin"
    found: Counter[str] = Counter()
    for c in word:
        p = ord(c)
        found[next((s for s, lo, hi in SCRIPTS if lo <= p <= hi), "other")] += 1
    return found.most_common(1)[0][0]


def _grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)] + [w[i : i + 4] for i in range(len(w) - 3)]


class Model:
    """Languages, log probabilities of n-grams by language, and scripts of languages."""

    def __init__(self, samples: list[tuple[str, str]], smoothing: float = 0.3, least: int = 2):
        self.languages = sorted({lang for lang, _ in samples})
        counts = {lang: Counter() for lang in self.languages}
        scripts = {lang: Counter() for lang in self.languages}
        for lang, text in samples:
            words = Counter(words_of(text))
            for w, n in words.items():
                scripts[lang][script_of(w)] += n * len(w)
                for g in _grams(w):
                    counts[lang][g] += n
        total: Counter[str] = Counter()
        for c in counts.values():
            total.update(c)
        kept = sorted(g for g, n in total.items() if n >= least)
        self.ids = {g: i for i, g in enumerate(kept)}
        size = len(kept) + 1
        self.logs = np.empty((size, len(self.languages)), np.float32)
        for k, lang in enumerate(self.languages):
            c = counts[lang]
            among = math.log(sum(c.values()) + smoothing * size)
            self.logs[:, k] = [math.log(c.get(g, 0) + smoothing) - among for g in kept] + [math.log(smoothing) - among]
        self.scripts = {}
        for s in {s for c in scripts.values() for s in c}:
            self.scripts[s] = np.array([scripts[lang][s] >= 0.01 * sum(scripts[lang].values()) for lang in self.languages])


class Scorer:
    """Word scores with a memo, and the Viterbi pass."""

    def __init__(self, model: Model):
        self.model, self.n = model, len(model.languages)
        self.words = Memo(CACHE_WORDS, self._learn)

    def _learn(self, words: list[str]) -> list[bytes]:
        ids, unseen = self.model.ids, len(self.model.ids)
        flat, starts = [], []
        for w in words:
            starts.append(len(flat))
            flat += [ids.get(g, unseen) for g in _grams(w)]
        score = np.add.reduceat(self.model.logs[np.array(flat)], starts, axis=0)
        score = np.maximum(score - score.max(axis=1, keepdims=True), -CLIP)
        for i, w in enumerate(words):
            own = self.model.scripts.get(script_of(w))
            if own is None or not own.any():
                score[i] = 0  # no language here has the script: no evidence
            elif not own.all():
                score[i] = np.where(own, score[i], FOREIGN)
        return [row.tobytes() for row in score.astype(np.float32)]

    def label(self, texts: list[str]) -> list[tuple[list[str], np.ndarray, bool]]:
        """The words of each text, the language index of each word, and whether any word tells languages apart."""
        words = [words_of(t) for t in texts]
        known = self.words.holding(set().union(*words))
        scores = [np.frombuffer(b"".join([known[w] for w in x]), np.float32).reshape(-1, self.n) for x in words]
        return list(zip(words, viterbi(scores, SWITCH), [bool((x != x[:, :1]).any()) for x in scores], strict=True))


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best labels of each sequence of score rows; ties stay with the label, then take the first.

    Sequences are cut into blocks that run side by side, once for each state
    a block may be entered in; then entry states are chosen along each sequence.
    """
    sizes = [len(s) for s in scores]
    blocks_of = [-(-n // BLOCK) for n in sizes]
    total = sum(blocks_of)
    if not total:
        return [np.zeros(0, np.int8) for _ in scores]
    n = scores[0].shape[1]
    x = np.zeros((total * BLOCK, n), np.float32)
    at = np.cumsum([0, *blocks_of])
    for s, k in zip(scores, at, strict=False):
        x[k * BLOCK : k * BLOCK + len(s)] = s
    x = x.reshape(total, BLOCK, n)
    # v[b, i, j]: best score within block b, entered from state i, now in j
    v = np.full((total, n, n), -penalty, np.float32)
    v[:, np.arange(n), np.arange(n)] = 0
    back = np.empty((BLOCK, total, n, n), np.int8)
    states = np.arange(n, dtype=np.int8)
    v = v + x[:, None, 0, :]
    for t in range(1, BLOCK):
        top = v.max(axis=2, keepdims=True) - penalty
        stay = v >= top
        back[t] = np.where(stay, states, v.argmax(axis=2)[:, :, None])
        v = np.where(stay, v, top) + x[:, None, t, :]
    # along each sequence: best over exits of the block before
    entry = np.empty(total, np.int64)
    leave = np.empty(total, np.int64)
    first = np.array(at[:-1])
    deep = max(blocks_of)
    best = np.zeros((len(scores), n), np.float32)
    came = np.zeros((deep, len(scores), n), np.int8)
    for k in range(deep):
        live = np.flatnonzero(np.array(blocks_of) > k)
        step = best[live][:, :, None] + v[first[live] + k]  # the first block may be entered in any state
        came[k, live] = step.argmax(axis=1)
        best[live] = step.max(axis=1)
    state = best.argmax(axis=1)
    for k in range(deep - 1, -1, -1):
        live = np.flatnonzero(np.array(blocks_of) > k)
        leave[first[live] + k] = state[live]
        state[live] = came[k, live, state[live]]
        entry[first[live] + k] = state[live]
    labels = np.empty((total, BLOCK), np.int8)
    rows, now = np.arange(total), leave
    for t in range(BLOCK - 1, 0, -1):
        labels[:, t] = now
        now = back[t, rows, entry, now].astype(np.int64)
    labels[:, 0] = now
    flat = labels.ravel()
    return [flat[k * BLOCK : k * BLOCK + m] for k, m in zip(at, sizes, strict=False)]


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(labelled: DataFrame, per_language: int = 300, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Model from at most ``per_language`` rows of each language, chosen by a hash of id and text; rows alike in both count once.

    Rows without text or language do not count; if none is left, the model has no language. Of texts
    whose hashes tie, all count.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & (F.length(F.trim(text_or_empty(text_col))) > 0))
    rows = rows.select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    # the choice is made on hashes alone; then at most per_language texts of each language are fetched
    least = Window.partitionBy("lang").orderBy("h")
    chosen = rows.select("lang", "h").withColumn("r", F.row_number().over(least)).filter(F.col("r") <= per_language).select("lang", "h").distinct()
    picked = rows.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text"))
    samples = [(r["lang"], r["text"]) for r in picked.orderBy("lang", "h").collect()]
    return Model(samples)


def identify(documents: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), with_spans: bool = False) -> DataFrame:
    """lang_pred and score of every row, beside its ``keep`` columns.

    score is the share of letters that lie in spans of lang_pred; of languages with equal shares the first is
    taken. Where no word tells languages apart, that is the first and each has an even score. Null texts
    and texts without letters get 'und' and 0, and so do all where the model has no language. An empty table gives no rows. With ``with_spans``, spans is an array of
    (first word, last word exclusive, language). Repeated rows are judged alike;
    column names of the input cannot clash, as only ``keep`` is carried.
    """
    shipped, key = documents.sparkSession.sparkContext.broadcast(model), model_digest(model)
    kept = [documents.schema[c] for c in keep]
    at = keep.index(text_col) if text_col in keep else len(keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "lang_pred string", "score double"]) + ", spans array<struct<first:int,end:int,lang:string>>" * with_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = held(("languages", key), lambda: Scorer(shipped.value))
        names = scorer.model.languages
        for batch in batches:
            langs, scores, spans = [], [], []
            for group in in_groups((t.as_py() or "" for t in batch.column(at)), 1 << 19):
                for words, labels, told in scorer.label(group) if names else [((), None, False)] * len(group):
                    if not words:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        spans.append([])
                        continue
                    letters = np.bincount(labels, weights=np.fromiter(map(len, words), np.float64, len(words)), minlength=len(names))
                    langs.append(names[int(letters.argmax())])
                    scores.append(float(letters.max() / letters.sum()) if told else 1 / len(names))
                    if with_spans:
                        cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
                        spans.append([{"first": a, "end": b, "lang": names[labels[a]]} for a, b in zip(cuts, cuts[1:], strict=False)])
            columns = [*(batch.column(i) for i in range(len(kept))), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            labels_ = [*(f.name for f in kept), "lang_pred", "score"]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
                labels_.append("spans")
            yield pa.RecordBatch.from_arrays(columns, names=labels_)

    # a text that is kept is sent once
    return documents.select(*[F.col(c) for c in keep], *([] if text_col in keep else [F.col(text_col).alias("__text")])).mapInArrow(run, schema)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = train(documents.filter(F.col("doc_id").isNotNull() & ~held_out("doc_id")))
    rows = documents.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return identify(rows, model, keep=("doc_id", "held_out")).select("doc_id", "held_out", "lang_pred", "score")


def model_digest(model: Model) -> str:
    """Equal for models that score alike."""
    parts = [repr(model.languages), " ".join(model.ids), repr(sorted((s, own.tolist()) for s, own in model.scripts.items()))]
    return hashlib.sha256(model.logs.tobytes() + "\n".join(parts).encode("utf-8", "replace")).hexdigest()
