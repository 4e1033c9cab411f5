"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language has a codeword of +1 and -1; one logistic classifier per bit sees the text's n-gram profile.
Decoding takes the language whose codeword costs least: the bits' logistic losses, weighted by how
reliable each bit was in training. A small lead over the runner-up marks the text as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sedgewire.llm.common import arrow_bytes, broadcast_if_small, checkpointed, in_batches, lower_ascii, map_arrow, with_fields, without_columns

DIMENSIONS = 4096
_LETTER = regex.compile(r"\p{L}")
_PIECE = 1 << 20


def profile(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unit-length vectors of hashed counts of 1- to 3-byte grams (square roots of counts), one for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, DIMENSIONS), np.float32)
    at = 0
    while at < n:
        to = at + 1
        while to < n and offsets[to + 1] - offsets[at] <= _PIECE // 4 and to - at < 256:
            to += 1
        _count(data, offsets[at : to + 1], out[at:to])
        at = to
    np.sqrt(out, out=out)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return out / np.maximum(norm, 1e-9)


def _count(data: np.ndarray, offsets: np.ndarray, out: np.ndarray) -> None:
    for base in range(int(offsets[0]), int(offsets[-1]), _PIECE):
        stop = min(base + _PIECE, int(offsets[-1]))
        x = lower_ascii(data[base : min(stop + 2, int(offsets[-1]))]).astype(np.uint32)
        owner = np.repeat(np.arange(len(out)), np.diff(np.clip(offsets, base, base + len(x)))).astype(np.int64) * DIMENSIONS
        code = np.zeros(len(x), np.uint32)
        for k in range(3):
            code = code[: len(x) - k] * np.uint32(0x9E3779B1) + x[k:] + np.uint32(k + 1)
            own = owner[: len(code)]
            same = (own == owner[k:]) if k else slice(None)
            index = own + ((code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(20)).astype(np.int64)
            index = index[: stop - base] if k == 0 else index[: stop - base][same[: stop - base]]
            out += np.bincount(index, minlength=out.size).reshape(out.shape)


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """A row of +1 and -1 for each language: of some random codes the one with the largest least distance; no bit is constant."""
    bits = max(15, 6 * int(np.ceil(np.log2(max(2, languages)))))
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = np.where(rng.random((languages, bits)) < 0.5, -1, 1)
        if languages > 1:
            flat = np.flatnonzero(np.abs(code.sum(axis=0)) == languages)
            code[rng.integers(languages, size=len(flat)), flat] *= -1
            distance = (bits - code @ code.T) // 2
            least = int((distance + bits * np.eye(languages, dtype=int)).min())
        else:
            least = 0
        if least > far:
            best, far = code, least
    return best


@dataclass
class LanguageModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    reliability: np.ndarray
    margin: float

    def losses(self, x: np.ndarray) -> np.ndarray:
        f = x @ self.weights + self.bias
        return np.stack([(np.logaddexp(0, -f * word) * self.reliability).sum(axis=1) for word in self.code], axis=1)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language index, score and ambiguity of each text."""
        loss = self.losses(profile(data, offsets))
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        score = p.max(axis=1) / p.sum(axis=1)
        two = np.sort(loss, axis=1)[:, :2]
        return loss.argmin(axis=1), score, (two[:, -1] - two[:, 0] < self.margin) & (loss.shape[1] > 1)


def fit(texts: list[str], langs: list[str], epochs: int = 12, margin: float = 1.0, seed: int = 11) -> LanguageModel:
    """Fit on whole texts and, so that short texts are known too, two random stretches of 30 to 200 bytes of each."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    label = np.array([names.index(x) for x in langs])
    raw = [t.encode() for t in texts]
    parts, own = list(raw), list(label)
    for b, y in zip(raw, label, strict=True):
        for _ in range(2):
            size = int(rng.integers(30, 201))
            at = int(rng.integers(max(1, len(b) - size)))
            parts.append(b[at : at + size])
            own.append(y)
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
    x = profile(np.frombuffer(b"".join(parts), np.uint8), offsets)
    y = np.array(own)
    code = codewords(len(names))
    target = code[y].astype(np.float32)
    w, b = np.zeros((DIMENSIONS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    gw, gb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    for _ in range(epochs):
        for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 256)):
            f = x[rows] @ w + b
            g = -target[rows] / (1 + np.exp(np.clip(target[rows] * f, -30, 30))) / len(rows)
            dw, db = x[rows].T @ g + 1e-6 * w, g.sum(axis=0)
            gw += dw * dw
            gb += db * db
            w -= 0.5 * dw / np.sqrt(gw)
            b -= 0.5 * db / np.sqrt(gb)
    error = ((x @ w + b) * target <= 0).mean(axis=0)
    return LanguageModel(names, code, w, b, np.maximum(1 - 2 * error, 0.05), margin)


def held_out(doc_id, modulus: int, remainder: int):
    """Whether crc32 of the id as text (null: the empty text) has this remainder."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def fit_on(docs: DataFrame, sample: int = 4_000, most_bytes: int = 100_000) -> LanguageModel | None:
    """Fit on a bounded sample of labelled rows that aren't held out: `sample` different rows at most, as many of each language
    (20 at most where there are more than sample / 20 languages, so that every one is learned), with the least hashes of id and text, of texts up to `most_bytes`.
    Null and empty texts and null languages teach nothing. None if nothing is left."""
    known = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"), 3, 1) & F.octet_length("text").between(1, most_bytes))
    known = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = checkpointed(known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")))
    languages = counts.count()
    if not languages:
        return None
    each = max(20, sample // languages)
    share = F.floor(1_000_003 * F.least(F.lit(1.0), 1.5 * each / F.col("n"))) + 1  # a few more than wanted, of which the least are taken
    drawn = known.join(broadcast_if_small(counts), "lang").where(F.pmod("h", F.lit(1_000_003)) < share).dropDuplicates(["lang", "h"])
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod("h", F.lit(1_000_003)), "h"))
    rows = drawn.withColumn("rank", rank).where(F.col("rank") <= each).select("text", "lang", "h").toPandas().sort_values(["h", "lang", "text"], kind="stable")
    return fit(rows["text"].tolist(), rows["lang"].tolist())


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """docs with lang_pred, lang_score (0 to 1) and lang_ambiguous; only the text decides.

    A null text or one without a letter, or no model (nothing to learn from), gives `und`, 0 and true. Columns of the added names are replaced.
    """
    added = ("lang_pred", "lang_score", "lang_ambiguous")
    docs = without_columns(docs, *added)
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "lang_score": F.lit(0.0), "lang_ambiguous": F.lit(True)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column("text")
        best, score, doubt = shared.value.predict(*arrow_bytes(column))
        letters = np.array([bool(t and _LETTER.search(t)) for t in column.to_pylist()], dtype=bool)
        names = [shared.value.languages[k] if ok else "und" for k, ok in zip(best, letters, strict=True)]
        batch = batch.append_column("lang_pred", pa.array(names, pa.string()))
        batch = batch.append_column("lang_score", pa.array(np.where(letters, score, 0.0).astype(np.float64)))
        return batch.append_column("lang_ambiguous", pa.array(doubt | ~letters))

    ddl = with_fields(docs.schema, "lang_pred string, lang_score double, lang_ambiguous boolean")
    return map_arrow(docs, lambda it: in_batches(run, it), ddl)
