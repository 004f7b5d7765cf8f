"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is
itself a token is answered by one probe and a comparison of bytes. Tier two
merges the rest: bytes are a doubly linked list, and a heap gives the
adjacent pair of least rank, leftmost first, until none merges.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, in_groups, read_table, text_or_empty

#: Keys of the hash per bucket, and entries of a generation of a worker's memos.
BUCKET_KEYS, CACHE_CHUNKS = 2, 300_000
_M = 2**64 - 1
_CODECS: dict[int, ByteBpe] = {}


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys to 0 … n-1.

    A key's 64-bit hash gives its bucket; its slot is that hash mixed with
    the bucket's displacement. Buckets are placed largest first; a bucket of
    one key takes a free slot directly, kept as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, -(-n // BUCKET_KEYS))
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.displace = [0] * self.buckets
        slot_key = [-1] * n
        order = sorted(range(self.buckets), key=lambda b: -len(members[b]))
        free = n - 1
        for b in order:
            m = members[b]
            if not m:
                break
            if len(m) == 1:
                while slot_key[free] >= 0:
                    free -= 1
                slot_key[free] = m[0]
                self.displace[b] = -free - 1
                continue
            d = 0
            while True:
                slots = [self._mixed(hashes[i], d) for i in m]
                if len(set(slots)) == len(m) and all(slot_key[s] < 0 for s in slots):
                    break
                d += 1
            self.displace[b] = d
            for i, s in zip(m, slots, strict=True):
                slot_key[s] = i
        self.slot_key = slot_key

    def _mixed(self, h: int, d: int) -> int:
        return ((((h ^ d * 0x9E3779B97F4A7C15) & _M) * 0xFF51AFD7ED558CCD & _M) >> 29) % self.n

    def slot(self, key: bytes) -> int:
        """The slot of a key of the set; of any other key, some slot."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displace[h % self.buckets]
        return -d - 1 if d < 0 else self._mixed(h, d)


class ByteBpe:
    """Encoder and decoder for one rank file and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, placed: PerfectHash | None = None):
        import regex

        self.ranks = ranks
        self.find = regex.compile(pattern).findall
        tokens = list(ranks)
        self.hash = placed or PerfectHash(tokens)
        self.slot_token = [tokens[i] for i in self.hash.slot_key]
        self.slot_id = [ranks[t] for t in self.slot_token]
        self.of_id = {i: t for t, i in ranks.items()}
        self.chunks = Memo(CACHE_CHUNKS, self._of_chunks)
        self.pieces = Memo(CACHE_CHUNKS, self._of_pieces)

    def whole(self, piece: bytes) -> int | None:
        """Tier one: the id of a pre-token that is a token."""
        slot = self.hash.slot(piece)
        return self.slot_id[slot] if self.slot_token[slot] == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """Tier two: a heap of ranked pairs over linked bytes."""
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        rank = ranks.get
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != to or not alive[i]:
                continue  # one side has changed since
            end[i], alive[j] = to, False
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            h = before[i]
            if h >= 0 and (r := rank(piece[h:to])) is not None:
                heapq.heappush(heap, (r, h, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return out

    def _of_pieces(self, pieces: list[str]) -> list[bytes]:
        out = []
        for p in pieces:
            b = p.encode("utf-8", "replace")
            one = self.whole(b)
            out.append(array("I", [one] if one is not None else self.merged(b)).tobytes())
        return out

    def _of_chunks(self, chunks: list[str]) -> list[bytes]:
        cut = [self.find(c) for c in chunks]
        known = self.pieces.holding(set().union(*cut))
        return [b"".join([known[p] for p in x]) for x in cut]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers.

        A single space between two characters that are not white space
        always starts a pre-token, so texts are cut there and the chunks looked up;
        a text with other runs of spaces keeps the chunks around them whole.
        """
        cut = [self._chunks(t) for t in texts]
        known = self.chunks.holding(set().union(*cut))
        return [b"".join([known[c] for c in x]) for x in cut]

    @staticmethod
    def _chunks(text: str) -> list[str]:
        raw = text.split(" ")
        out = [raw[0], *[" " + c for c in raw[1:]]]
        if all(raw) and not any(c[0].isspace() or c[-1].isspace() for c in raw):
            return out
        joined: list[str] = []
        open_ = False  # whether the next chunk must stay with the last one
        for c, r in zip(out, raw, strict=True):
            stay = open_ or not r or r[0].isspace()
            if stay and joined:
                joined[-1] += c
            else:
                joined.append(c)
            open_ = not r or r[-1].isspace()
        return joined

    def decode(self, ids: bytes) -> bytes:
        of = self.of_id
        return b"".join([of[i] for i in array("I", ids)])


def rank_file(path: str | None = None) -> bytes:
    """The rank file's content; the path is a parameter of the caller."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def codec(content: bytes, pattern: str, placed: PerfectHash | None = None) -> ByteBpe:
    """The process's codec for a rank file; ``placed`` is its hash, if made already."""
    key = zlib.crc32(content + pattern.encode())
    if key not in _CODECS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
        _CODECS[key] = ByteBpe(ranks, pattern, placed)
    return _CODECS[key]


def encode_documents(documents: DataFrame, content: bytes, pattern: str, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Encode whole texts, decode the ids, and digest both.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for,
    ids as array<int>. Null text counts as empty: no ids. Repeated rows and
    null ids pass through; other columns are ignored.
    """
    shipped = documents.sparkSession.sparkContext.broadcast((content, codec(content, pattern).hash))
    id_type = documents.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(shipped.value[0], pattern, shipped.value[1])
        for batch in batches:
            n, ids_sha, back_sha, all_ids = [], [], [], []
            for group in in_groups((t.as_py() for t in batch.column(1)), 1 << 19):
                for ids in bpe.encode(group):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    back_sha.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                    if with_ids:
                        all_ids.append(np.frombuffer(ids, "<i4"))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    texts = documents.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return texts.mapInArrow(run, schema)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(read_table(spark, sf_dir, "documents"), rank_file(), public_tokenizers.PATTERN)
