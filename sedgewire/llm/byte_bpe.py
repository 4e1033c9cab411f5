"""Byte-level BPE by public rank files: whole pre-tokens by a minimal perfect hash, the rest by a heap over linked bytes."""

from __future__ import annotations

import base64
import functools
import itertools
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewire.llm.common import in_batches, map_arrow, with_fields, without_columns

_MASK = (1 << 64) - 1
#: About what a kept pre-token takes beside its characters and ids: two objects and its place in a dictionary.
_ENTRY = 180


class PerfectHash:
    """A minimal perfect hash of byte strings: bucket displacements send n keys to n slots.

    Buckets are placed from the largest on; a bucket tries displacements until all of its keys
    fall on free slots, and buckets of one key take the slots that remain (stored as -1 - slot).
    slot() gives a key its slot; other strings get any slot, so the caller compares the key there.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 2) -> None:
        self.n = max(1, len(keys))
        self.m = max(1, len(keys) // per_bucket)
        buckets: list[list[int]] = [[] for _ in range(self.m)]
        for k in keys:
            h = xxhash.xxh3_64_intdigest(k)
            buckets[h % self.m].append(h)
        self.displacement = [0] * self.m
        taken = bytearray(self.n)
        order = sorted(range(self.m), key=lambda b: -len(buckets[b]))
        single = [b for b in order if len(buckets[b]) == 1]
        for b in order:
            own = buckets[b]
            if len(own) < 2:
                break
            d = 1
            while True:
                slots = {self._place(h, d) for h in own}
                if len(slots) == len(own) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.displacement[b] = d
            for s in slots:
                taken[s] = 1
        free = (s for s in range(self.n) if not taken[s])
        for b, s in zip(single, free, strict=False):
            self.displacement[b] = -1 - s

    def _place(self, h: int, d: int) -> int:
        x = (h ^ (d * 0x9E3779B97F4A7C15)) & _MASK
        return (((x ^ (x >> 32)) * 0xD6E8FEB86659FD93 & _MASK) >> 20) % self.n

    def slot(self, key: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[h % self.m]
        return -1 - d if d < 0 else self._place(h, d)


class Vocabulary:
    """Ranks by token, with the structures of both tiers and of decoding."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.hash = PerfectHash(list(ranks))
        self.key_at: list[bytes | None] = [None] * self.hash.n
        self.rank_at = [0] * self.hash.n
        for token, rank in ranks.items():
            s = self.hash.slot(token)
            self.key_at[s], self.rank_at[s] = token, rank
        self.byte_rank = [ranks[bytes([b])] for b in range(256)]
        #: (left rank << 32 | right rank) of every two tokens that join to a token -> its rank
        self.joined = {ranks[t[:i]] << 32 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        by_rank = sorted((r, t) for t, r in ranks.items())
        size = self.none = by_rank[-1][0] + 1
        self.bytes_of = [b""] * size  # by rank
        for r, t in by_rank:
            self.bytes_of[r] = t
        self.digest = xxhash.xxh3_128_hexdigest(b"".join(r.to_bytes(4, "little") + len(t).to_bytes(4, "little") + t for r, t in by_rank))

    def whole(self, piece: bytes) -> int | None:
        """The rank of a piece that is a token."""
        s = self.hash.slot(piece)
        return self.rank_at[s] if self.key_at[s] == piece else None

    def merged(self, piece: bytes) -> list[int]:
        """Ranks of a piece that is no token: the lowest-ranked pair joins first, the leftmost of equal ones."""
        n = len(piece)
        ids = list(map(self.byte_rank.__getitem__, piece))
        get, none = self.joined.get, self.none
        pair = [get(a << 32 | b, none) for a, b in itertools.pairwise(ids)]  # what the part at i joins to with the next
        pair.append(none)
        heap = [r << 32 | i for i, r in enumerate(pair) if r < none]  # by rank, then place; an entry is stale if pair[i] has changed
        heapify(heap)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            x = heappop(heap)
            r, i = x >> 32, x & 0xFFFFFFFF
            if pair[i] != r:
                continue
            j = following[i]
            ids[i], ids[j], pair[j] = r, -1, none
            k = following[i] = following[j]
            if k < n:
                before[k] = i
                q = pair[i] = get(r << 32 | ids[k], none)
                if q < none:
                    heappush(heap, q << 32 | i)
            else:
                pair[i] = none
            h = before[i]
            if h >= 0:
                q = pair[h] = get(ids[h] << 32 | r, none)
                if q < none:
                    heappush(heap, q << 32 | h)
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of these ids; one outside the vocabulary stands for none."""
        ids = ids[(ids >= 0) & (ids < self.none)]
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Encoder:
    """Encodes texts; keeps the ids of the last pre-tokens met, packed: two generations of up to half of `kept_bytes` each."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, kept_bytes: int = 128 << 20) -> None:
        self.vocabulary, self.most, self.held = vocabulary, kept_bytes // 2, 0
        self.find = regex.compile(pattern).findall
        self.seen: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            rank = self.vocabulary.whole(raw)
            ids = array("i", (rank,) if rank is not None else self.vocabulary.merged(raw)).tobytes()
        if self.held > self.most:
            self.seen, self.older, self.held = {}, self.seen, 0
        self.seen[piece] = ids
        self.held += _ENTRY + 4 * len(piece) + len(ids)
        return ids

    def __call__(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers."""
        pieces = self.find(text)
        known = list(map(self.seen.get, pieces))
        if None in known:
            new = {p: self._learn(p) for p in {p for p, ids in zip(pieces, known, strict=True) if ids is None}}
            known = [new[p] if ids is None else ids for p, ids in zip(pieces, known, strict=True)]
        return b"".join(known)


@functools.lru_cache(maxsize=2)
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(read_ranks(path))


#: An encoder for each vocabulary (by the digest of its ranks) and pattern, kept while the Python worker lives.
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def _encoder(vocabulary: Vocabulary, pattern: str) -> Encoder:
    key = (vocabulary.digest, pattern)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocabulary, pattern)
    return _ENCODERS[key]


def _encode_batch(batch: pa.RecordBatch, shared, pattern: str) -> pa.RecordBatch:
    encoder = _encoder(shared.value, pattern)
    ids = [encoder(text or "") for text in batch.column("text").to_pylist()]
    ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), np.int32)))
    return batch.append_column("ids", lists)


def _decode_batch(batch: pa.RecordBatch, shared) -> pa.RecordBatch:
    out = [shared.value.decode(np.asarray(x.values.fill_null(-1), dtype=np.int64)) if x.is_valid else b"" for x in batch.column("ids")]
    return batch.append_column("decoded", pa.array(out, pa.binary()))


def _transcode_batch(batch: pa.RecordBatch, shared, pattern: str) -> pa.RecordBatch:
    both = _decode_batch(_encode_batch(batch, shared, pattern), shared)
    exact = pc.equal(pc.fill_null(batch.column("text"), "").cast(pa.binary()), both.column("decoded"))
    return both.drop_columns(["text"]).append_column("exact", exact)


def _shared(frame: DataFrame, path: str):
    """The rank file, read on the driver and broadcast: its size is the vocabulary's, not the data's."""
    return frame.sparkSession.sparkContext.broadcast(_vocabulary(path))


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs with ids, the token ids of the whole text. A null or empty text has none. A column of docs named ids is replaced; repeated rows give repeated results."""
    docs, shared = without_columns(docs, "ids"), _shared(docs, path)
    return map_arrow(docs, lambda it: in_batches(lambda b: _encode_batch(b, shared, pattern), it), with_fields(docs.schema, "ids array<int>"))


def decode(frame: DataFrame, path: str) -> DataFrame:
    """A frame with ids, plus decoded: the bytes they stand for (null ids, null in ids and numbers outside the vocabulary: none). A column named decoded is replaced."""
    frame, shared = without_columns(frame, "decoded"), _shared(frame, path)
    return map_arrow(frame, lambda it: in_batches(lambda b: _decode_batch(b, shared), it), with_fields(frame.schema, "decoded binary"))


def transcode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """docs without text, but with ids, decoded (the bytes that the ids stand for) and exact (whether those are the text's): encode and decode in one pass.

    A null text is empty and decodes to no bytes. Columns of the added names are replaced; an empty table gives an empty result.
    """
    docs, shared = without_columns(docs, "ids", "decoded", "exact"), _shared(docs, path)
    ddl = with_fields([f for f in docs.schema if f.name != "text"], "ids array<int>, decoded binary, exact boolean")
    return map_arrow(docs, lambda it: in_batches(lambda b: _transcode_batch(b, shared, pattern), it), ddl)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The contract's digests of encoding and decoding, a row for each row of docs; a null text is empty. Other columns of docs are ignored."""
    both = transcode(docs.select("doc_id", "text"), path, pattern)
    text = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
