"""Packing token sequences: shortest-pack-first over the length histogram.

Documents are cut into pieces of at most ``max_tokens``. Only the histogram
of piece lengths (at most ``max_tokens`` entries) reaches the driver. There,
lengths are placed longest first: each goes to the packing patterns that have
the least tokens so far and still take it, whole groups of equal
patterns at once, so the work depends on the number of lengths and not on
the number of documents. The patterns then meet the pieces again by rank:
the r-th piece of a length takes the r-th slot of that length.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, held, in_groups, materialize, read_table, text_or_empty

END_ID = 1
#: Entries of a generation of a worker's memo of words.
CACHE_WORDS = 200_000
#: Outside these characters, Unicode's categories or the vocabulary's normalizer may matter.
_ODD = re.compile("[^\t\n\r -~¡-©«-±´¶-¸»¿-įı-ſ]")
#: The word pattern of the vocabulary file's pre-tokenizer, for lower-case text without odd characters.
_WORD = re.compile("[a-zß-öø-ſ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\\sa-zß-öø-ſ0-9]+")
_BLANKS = re.compile("[ \t\n\r]+")


class WordEncoder:
    """Token ids of texts, with a memo by word.

    The vocabulary's pre-tokenizer never joins across white space, so a
    text's ids are those of its words in turn. Words without odd characters
    are cut here, and those that the memo lacks encoded by the library in one
    call without normalizer and pattern; other words go to the library whole.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        rules = json.loads(vocabulary)
        self.full = Tokenizer.from_str(vocabulary)
        self.full.encode_special_tokens = True
        bare = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.bare = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": bare}))
        self.bare.encode_special_tokens = True
        vocab = rules["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(rules["model"]["end_of_word_suffix"])]] = True
        self.known = Memo(CACHE_WORDS, self._learn)

    def _learn(self, words: list[str]) -> Iterator[bytes]:
        odd = [w for w in words if _ODD.search(w)]
        found = {w: array("I", e.ids).tobytes() for w, e in zip(odd, self.full.encode_batch_fast(odd, add_special_tokens=False), strict=True)}
        plain = [w for w in words if w not in found] if odd else words
        if plain:
            ids = np.array(self.bare.encode_batch_fast([" ".join(plain)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            raw, at = ids.tobytes(), 0
            if len(cuts) != len(plain):
                raise AssertionError("a word without an end token")
            for w, end in zip(plain, cuts, strict=True):
                found[w] = raw[at:end]
                at = end
        return (found[w] for w in words)

    @staticmethod
    def _words(text: str) -> list[str]:
        if not _ODD.search(text):
            return _WORD.findall(text.lower())
        out = []
        for w in _BLANKS.split(text):
            if _ODD.search(w):
                out.append(w)
            else:
                out += _WORD.findall(w.lower())
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of whole texts."""
        words = [self._words(t) for t in texts]
        known = self.known.holding(set().union(*words))
        return [b"".join([known[w] for w in x]) for x in words]


def shortest_pack_first(histogram: dict[int, int], max_tokens: int) -> list[tuple[list[int], int]]:
    """(lengths of a pattern, number of sequences with it), for all pieces.

    ``open_`` holds the patterns by the room they have left; the shortest
    pack is the one with most room, so a length goes to the fullest-room group first.
    """
    open_: dict[int, list[tuple[list[int], int]]] = {}
    rooms: list[int] = []
    done: list[tuple[list[int], int]] = []

    def leave(room: int, pattern: list[int], count: int) -> None:
        if room == 0:
            done.append((pattern, count))
            return
        if room not in open_:
            open_[room] = []
            bisect.insort(rooms, room)
        open_[room].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and rooms and rooms[-1] >= length:
            room = rooms[-1]
            pattern, count = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop()
            used = min(count, left)
            if count > used:
                leave(room, pattern, count - used)
            # back at once: where it still has most room, it takes the next piece too
            leave(room - length, [*pattern, length], used)
            left -= used
        if left:
            # new patterns of this length alone, as many together as fit
            fit = max_tokens // length
            if left >= fit:
                leave(max_tokens - fit * length, [length] * fit, left // fit)
            if left % fit:
                leave(max_tokens - left % fit * length, [length] * (left % fit), 1)
    for groups in open_.values():
        done.extend(groups)
    return done


def _slots(patterns: list[tuple[list[int], int]], max_tokens: int) -> dict[str, np.ndarray]:
    """For each length, runs of ranks: first rank, first sequence, offset."""
    length, rank, seq, offset = [], [], [], []
    given = [0] * (max_tokens + 1)
    first = 0
    for lengths, count in patterns:
        at = 0
        for n in lengths:
            length.append(n)
            rank.append(given[n])
            seq.append(first)
            offset.append(at)
            given[n] += count
            at += n
        first += count
    order = np.lexsort((rank, length))
    return {k: np.asarray(v, np.int64)[order] for k, v in (("length", length), ("rank", rank), ("seq", seq), ("offset", offset))}


def token_pieces(documents: DataFrame, vocabulary: str, max_tokens: int = 2048, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    shipped = documents.sparkSession.sparkContext.broadcast(vocabulary)
    id_type = documents.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("words", zlib.crc32(shipped.value.encode())), lambda: WordEncoder(shipped.value))
        for batch in batches:
            who, start, length, crc, total = [], [], [], [], []
            texts = (t.as_py() for t in batch.column(1))
            for i, ids in enumerate(ids + end for group in in_groups(texts, 1 << 20) for ids in encoder.encode(group)):
                n = len(ids) // 4
                for s in range(0, n, max_tokens):
                    m = min(max_tokens, n - s)
                    who.append(i)
                    start.append(s)
                    length.append(m)
                    crc.append(zlib.crc32(memoryview(ids)[4 * s : 4 * (s + m)]))
                    total.append(n)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(who, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    texts = documents.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(cut, schema)


def pack_pieces(pieces: DataFrame, max_tokens: int = 2048, pieces_per_salt: int = 500_000) -> DataFrame:
    """Add sequence_id and offset to pieces that are already written.

    Ranks within a length are counted by salt, so that a length which most
    pieces have (the full one) is numbered by many tasks. Only the histogram
    goes to the driver, and only runs of slots, whose number depends on
    ``max_tokens`` and not on the rows, are sent to the executors.
    """
    total = pieces.count()
    salts = max(64, -(-total // pieces_per_salt))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(shortest_pack_first(histogram, max_tokens), max_tokens)
    shipped = pieces.sparkSession.sparkContext.broadcast(slots)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = salted.withColumn("r", F.row_number().over(inside)).join(bases, ["length", "salt"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("r") - 1).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shipped.value
        bounds = np.searchsorted(s["length"], np.arange(max_tokens + 2))
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                rows, lo, hi = length == n, bounds[n], bounds[n + 1]
                at[rows] = lo + np.searchsorted(s["rank"][lo:hi], rank[rows], "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in range(5)), pa.array(s["seq"][at] + rank - s["rank"][at]), pa.array(s["offset"][at])],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    id_type = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack_documents(documents: DataFrame, vocabulary: str, max_tokens: int = 2048, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Pack whole documents into sequences of at most ``max_tokens``.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    one row per piece. A null or empty text is the end id alone. Repeated
    rows are packed as often as they occur; a null doc_id stays null. Other
    columns are ignored, whatever their names. An empty table gives none.
    """
    pieces = materialize(token_pieces(documents, vocabulary, max_tokens, text_col, id_col), "pieces")
    return pack_pieces(pieces, max_tokens)


def vocabulary_text(path: str | None = None) -> str:
    """The vocabulary file's content; the path is a parameter of the caller."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), vocabulary_text())
