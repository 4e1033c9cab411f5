"""Toxicity of texts by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input joins an embedding of the word with the last states of a smaller gated recurrent network that reads
its bytes in both directions, so that inflections of a stem share what is learned. The network reads windows
of 24 words, each overlapping the next by half. A text's score joins those of its worst windows that don't overlap,
as toxic texts have several, by weights that are learned on texts the windows' network didn't see. Labels are
given by text, so training picks the windows: first by how much more often their word pieces occur in toxic texts,
then by the network's own scores.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedgewire.llm.common import arrow_bytes, checkpointed, files_for, hash_spans, in_batches, lower_ascii, map_arrow, with_fields, without_columns

WORDS, STRIDE = 24, 12
#: Longer words are read as several of so many bytes.
LONGEST = 32
_SLOT_BITS, _DIM, _HIDDEN, _ATTENTION = 18, 8, 10, 8
_BYTE_DIM, _BYTE_HIDDEN, _BEGIN, _END = 8, 10, 256, 257
_SLOTS = 1 << _SLOT_BITS
#: Embedded words: those that tell the labels apart best. All others have a zero vector, so rare words can't be learned by heart.
KEPT = 1_000
#: Lengths in bytes of the word pieces by which the first training windows are picked.
PIECES = (3, 5, 7)
#: Worst windows that make a text's score, none overlapping another.
WORST = 3
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of ASCII letters, digits and bytes of other scripts, of LONGEST bytes at most."""
    inside = np.concatenate([[False], _LETTER[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return _cut(edges[0::2], edges[1::2])


def _cut(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    parts = -(-(ends - starts) // LONGEST)
    if len(parts) and parts.max() > 1:
        inside = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(starts, parts) + inside * LONGEST
        ends = np.minimum(starts + LONGEST, np.repeat(ends, parts))
    return starts, ends


def _pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each length of PIECES the slots of the pieces that start at each byte of the words with marked ends (_SLOTS: none), and where each word's begin."""
    lengths = ends - starts + 2
    firsts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    total = int(lengths.sum())
    owner = np.repeat(np.arange(len(starts)), lengths)
    inside = np.arange(total) - firsts[owner]
    left = lengths[owner] - inside
    code = np.ones(total + max(PIECES), np.uint32)
    middle = (inside > 0) & (left > 1)
    code[:total][middle] = data[(starts[owner] + inside - 1)[middle]]
    slots, mixed = [], np.zeros(total, np.uint32)
    for k in range(max(PIECES)):
        mixed = (mixed ^ code[k : k + total]) * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        if k + 1 in PIECES:
            slots.append(np.where(left > k, (mixed * np.uint32(0x85EBCA77)) >> np.uint32(32 - _SLOT_BITS), _SLOTS).astype(np.int64))
    return slots, firsts


def _byte_rows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A row for each word: its bytes between marks, -1 behind them."""
    place = np.arange(int((ends - starts).max()) + 2)[None, :]
    lengths = (ends - starts)[:, None]
    out = data[np.minimum(starts[:, None] + np.maximum(place - 1, 0), len(data) - 1)].astype(np.int64)
    out[:, 0] = _BEGIN
    return np.where(place <= lengths, out, np.where(place == lengths + 1, _END, -1))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Recurrent:
    """A gated recurrent layer in both directions, over rows of numbers (-1 behind the end) that pick from input vectors x. Its parameters are those of p with its name."""

    def __init__(self, name: str, hidden: int) -> None:
        self.name, self.hidden = name, hidden

    def parameters(self, d: int, normal) -> dict[str, np.ndarray]:
        h, out = self.hidden, {}
        for way in "fb":
            out |= {f"{self.name}w{way}": normal(d, 3 * h, scale=d**-0.5), f"{self.name}u{way}": normal(h, 3 * h, scale=h**-0.5), f"{self.name}c{way}": np.zeros(3 * h, np.float32)}
        return out

    def forward(self, p: dict, x: np.ndarray, index: np.ndarray, keep: bool = False):
        """States (steps, rows, both directions); behind the end the last one stays."""
        (n, steps), h = index.shape, self.hidden
        live = (index.T >= 0)[:, :, None]
        if not keep:
            return self._states(p, x, index), {}
        out = np.zeros((steps, n, 2 * h), x.dtype)
        saved = {}
        for k, way in enumerate("fb"):
            inputs = np.concatenate([x @ p[f"{self.name}w{way}"] + p[f"{self.name}c{way}"], np.zeros((1, 3 * h), x.dtype)])
            u, state = p[f"{self.name}u{way}"], np.zeros((n, h), x.dtype)
            trace = [np.zeros((steps, n, m * h), x.dtype) for m in (1, 2, 1, 1)]  # state before, gates, new, its recurrent part
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                a, b = inputs[index[:, t]], state @ u
                gates = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
                recurrent = b[:, 2 * h :]
                new = np.tanh(a[:, 2 * h :] + gates[:, h:] * recurrent)
                trace[0][t], trace[1][t], trace[2][t], trace[3][t] = state, gates, new, recurrent
                state = np.where(live[t], new + gates[:, :h] * (state - new), state)
                out[t, :, k * h : (k + 1) * h] = state
            saved[way] = trace
        return out, saved

    def _states(self, p: dict, x: np.ndarray, index: np.ndarray) -> np.ndarray:
        """The states alone: each gate has arrays of its own, as numpy is slow on parts of rows, and is computed in place."""
        (n, steps), h = index.shape, self.hidden
        live = np.ascontiguousarray(index.T >= 0)
        rows, full = np.where(live, index.T, len(x)), live.all(axis=1)
        out = np.empty((steps, n, 2 * h), x.dtype)
        for k, way in enumerate("fb"):
            w, u, c = (p[f"{self.name}{part}{way}"] for part in "wuc")
            gates = [(np.concatenate([x @ w[:, m : m + h] + c[m : m + h], np.zeros((1, h), x.dtype)]), np.ascontiguousarray(u[:, m : m + h])) for m in (0, h, 2 * h)]
            state = np.zeros((n, h), x.dtype)
            for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
                (z, r, new), (zu, ru, nu) = [i.take(rows[t], axis=0) for i, _ in gates], [state @ u for _, u in gates]
                for gate, recurrent in ((z, zu), (r, ru)):
                    gate += recurrent
                    np.negative(gate, out=gate)
                    with np.errstate(over="ignore"):
                        np.exp(gate, out=gate)
                    gate += 1
                    np.reciprocal(gate, out=gate)
                nu *= r
                new += nu
                np.tanh(new, out=new)
                after = state - new
                after *= z
                after += new
                state = after if full[t] else np.where(live[t][:, None], after, state)
                out[t, :, k * h : (k + 1) * h] = state
        return out

    def gradients(self, p: dict, g: dict, x: np.ndarray, index: np.ndarray, saved: dict, dout: np.ndarray) -> np.ndarray:
        """Adds the parameters' gradients to g; returns that of x."""
        (n, steps), h, dx = index.shape, self.hidden, np.zeros_like(x)
        live = (index.T >= 0)[:, :, None]
        for k, way in enumerate("fb"):
            u, dstate = p[f"{self.name}u{way}"], np.zeros((n, h), x.dtype)
            states, gates, news, recurrents = saved[way]
            da, db = np.zeros((steps, n, 3 * h), x.dtype), np.zeros((steps, n, 3 * h), x.dtype)
            for t in range(steps - 1, -1, -1) if way == "f" else range(steps):
                z, r, new = gates[t, :, :h], gates[t, :, h:], news[t]
                dstate = dstate + dout[t, :, k * h : (k + 1) * h]
                flow = np.where(live[t], dstate, 0)
                dnew = flow * (1 - z) * (1 - new * new)
                da[t, :, :h] = flow * (states[t] - new) * z * (1 - z)
                da[t, :, h : 2 * h] = dnew * recurrents[t] * r * (1 - r)
                da[t, :, 2 * h :] = dnew
                db[t] = da[t]
                db[t, :, 2 * h :] *= r
                dstate = dstate - flow * (1 - z) + db[t] @ u.T
            g[f"{self.name}u{way}"] += states.reshape(-1, h).T @ db.reshape(-1, 3 * h)
            dinputs = np.zeros((len(x) + 1, 3 * h), x.dtype)
            _add_rows(dinputs, index.T.ravel(), da.reshape(-1, 3 * h))
            g[f"{self.name}w{way}"] += x.T @ dinputs[:-1]
            g[f"{self.name}c{way}"] += dinputs[:-1].sum(axis=0)
            dx += dinputs[:-1] @ p[f"{self.name}w{way}"].T
        return dx


def _add_rows(total: np.ndarray, index: np.ndarray, rows: np.ndarray) -> None:
    """total[index] += rows, with repeats."""
    order = np.argsort(index, kind="stable")
    sorted_ = index[order]
    firsts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    total[sorted_[firsts]] += np.add.reduceat(rows[order], firsts, axis=0)


class Network:
    """Parameters p by name. known: the embedding (KEPT: none) of each word slot. head: weights of a text's worst windows, its length and 1."""

    bytes_layer, words_layer = Recurrent("byte_", _BYTE_HIDDEN), Recurrent("word_", _HIDDEN)

    def __init__(self, known: np.ndarray, seed: int = 5) -> None:
        rng, self.known = np.random.default_rng(seed), known
        h = _HIDDEN

        def normal(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"word": normal(KEPT, _DIM, scale=0.05), "byte": normal(258, _BYTE_DIM, scale=0.5)}
        self.p |= self.bytes_layer.parameters(_BYTE_DIM, normal) | self.words_layer.parameters(_DIM + 2 * _BYTE_HIDDEN, normal)
        self.p |= {"wa": normal(2 * h, _ATTENTION, scale=(2 * h) ** -0.5), "ca": np.zeros(_ATTENTION, np.float32), "va": normal(_ATTENTION, scale=0.5), "uo": normal(2 * h, scale=0.5), "co": np.zeros(1, np.float32)}
        self.head = np.array([1.0] + [0.0] * (WORST + 1))

    def vectors(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, keep: bool = False):
        """Inputs of some words; words of about one length go through the byte layer together."""
        p = self.p
        slot = self.known[_word_slots(hashes)]
        spelled = np.zeros((len(starts), 2 * _BYTE_HIDDEN), p["byte"].dtype)
        parts, h, at = [], _BYTE_HIDDEN, 0
        order = np.argsort(ends - starts, kind="stable")
        lengths = (ends - starts)[order]
        while at < len(order):
            to = min(max(int(np.searchsorted(lengths, lengths[at] + 2, side="right")), at + 400), at + 4096, len(order))
            rows, at = order[at:to], to
            index = _byte_rows(data, starts[rows], ends[rows])
            out, saved = self.bytes_layer.forward(p, p["byte"], index, keep)
            spelled[rows, :h], spelled[rows, h:] = out[-1, :, :h], out[0, :, h:]
            if keep:
                parts.append((rows, index, saved, len(out)))
        zero = np.zeros((1, _DIM), p["word"].dtype)
        return np.concatenate([np.concatenate([p["word"], zero])[slot], spelled], axis=1), (slot, parts)

    def forward(self, x: np.ndarray, index: np.ndarray, keep: bool = False):
        """Logits of windows: index has rows of word numbers into x, -1 behind the end."""
        p = self.p
        out, saved = self.words_layer.forward(p, x, index, keep)
        act = np.tanh(out @ p["wa"] + p["ca"])
        energy = np.where((index >= 0).T, act @ p["va"], -1e9)
        energy = energy - energy.max(axis=0)
        weight = np.exp(energy)
        weight /= weight.sum(axis=0)
        pooled = (weight[:, :, None] * out).sum(axis=0)
        return pooled @ p["uo"] + p["co"][0], (out, act, weight, pooled, saved)

    def gradients(self, x, index, inner, dlogit, words) -> dict[str, np.ndarray]:
        p = self.p
        out, act, weight, pooled, saved = inner
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["uo"], g["co"] = pooled.T @ dlogit, dlogit.sum(keepdims=True)
        dpooled = dlogit[:, None] * p["uo"]
        dweight = (out * dpooled).sum(axis=2)
        dout = weight[:, :, None] * dpooled
        denergy = weight * (dweight - (weight * dweight).sum(axis=0))
        g["va"] = np.einsum("tn,tna->a", denergy, act)
        dact = denergy[:, :, None] * p["va"] * (1 - act * act)
        g["wa"] = np.einsum("tnh,tna->ha", out, dact)
        g["ca"] = dact.sum(axis=(0, 1))
        dout += dact @ p["wa"].T
        dx = self.words_layer.gradients(p, g, x, index, saved, dout)
        slot, parts = words
        if (slot < KEPT).any():
            _add_rows(g["word"], slot[slot < KEPT], dx[slot < KEPT, :_DIM])
        h = _BYTE_HIDDEN
        for rows, spelled, trace, steps in parts:
            dstates = np.zeros((steps, len(rows), 2 * h), x.dtype)
            dstates[-1, :, :h], dstates[0, :, h:] = dx[rows, _DIM : _DIM + h], dx[rows, _DIM + h :]
            g["byte"] += self.bytes_layer.gradients(p, g, p["byte"], spelled, trace, dstates)
        return g


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers (-1 behind a text's end) of all windows of texts with so many words, and the text of each window."""
    each = np.where(counts > 0, np.maximum(1, -(-(counts - (WORDS - STRIDE)) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(counts)), each)
    begin = (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)) * STRIDE
    place = begin[:, None] + np.arange(WORDS)
    first = np.cumsum(counts) - counts
    return np.where(place < counts[owner][:, None], place + first[owner][:, None], -1), owner


def window_scores(net: Network, data: np.ndarray, offsets: np.ndarray, slab: int = 8192):
    """Logits of all windows of a chunk of texts, the text of each, and the words' spans."""
    base = offsets[0]
    chunk = lower_ascii(data[base : offsets[-1]])
    at = offsets - base
    starts, ends = words_of(chunk)
    if not len(starts):
        return np.zeros(0, np.float32), np.zeros(0, np.int64), np.zeros((0, WORDS), np.int64), (chunk, starts, ends)
    cut = np.searchsorted(starts, at[1:-1])  # a text's last word ends where the next text begins
    glued = (ends[np.maximum(cut - 1, 0)] > at[1:-1]) & (cut > 0) if len(cut) else np.zeros(0, bool)
    if glued.any():
        starts = np.sort(np.concatenate([starts, at[1:-1][glued]]))
        ends = np.sort(np.concatenate([ends, at[1:-1][glued]]))
    proper = ends > starts
    starts, ends = _cut(starts[proper], ends[proper])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, at[1:-1]), [len(starts)]])) if len(at) > 2 else np.array([len(starts)])
    hashes = hash_spans(chunk, starts, ends)
    unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    order = np.argsort(first)  # spans in order, as the pieces need
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    x, _ = net.vectors(chunk, starts[first[order]], ends[first[order]], unique[order])
    places, owner = windows_of(counts)
    index = np.where(places >= 0, number[inverse][np.maximum(places, 0)], -1)
    logits = [net.forward(x, index[a : a + slab])[0] for a in range(0, len(index), slab)]
    return np.concatenate(logits), owner, places, (chunk, starts, ends)


def worst_windows(logits: np.ndarray) -> np.ndarray:
    """Of one text's windows in order the WORST highest that don't overlap, clipped; what is lacking counts as _NONE."""
    out, values = np.full(WORST, _NONE), np.clip(logits, _NONE, -_NONE)
    for k in range(WORST):
        if not len(values):
            break
        at = int(values.argmax())
        if values[at] <= _NONE:
            break
        out[k] = values[at]
        values = values.copy() if k == 0 else values
        values[max(0, at - 1) : at + 2] = _NONE
    return out


_NONE = -8.0


def text_features(net: Network, data: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """A row for each text: its worst windows, the logarithm of its number of windows, and 1; and whether it has a word. Long texts go through in several chunks that overlap by a window."""
    n = len(offsets) - 1
    out, has = np.zeros((n, WORST + 2)), np.zeros(n, bool)

    def put(row: int, logits: np.ndarray) -> None:
        out[row, :WORST], out[row, WORST], out[row, -1] = worst_windows(logits), np.log1p(len(logits)), 1
        has[row] = len(logits) > 0

    at = 0
    while at < n:
        to = at + 1
        if offsets[to] - offsets[at] > chunk:
            parts = [window_scores(net, piece, np.array([0, len(piece)]))[0] for piece in _long(data[offsets[at] : offsets[to]], chunk)]
            put(at, np.concatenate([*parts, np.zeros(0, np.float32)]))
        else:
            while to < n and offsets[to + 1] - offsets[at] <= chunk:
                to += 1
            logits, owner, *_ = window_scores(net, data, offsets[at : to + 1])
            bounds = np.searchsorted(owner, np.arange(to - at + 1))
            for row in range(at, to):
                put(row, logits[bounds[row - at] : bounds[row - at + 1]])
        at = to
    return out, has


def score_texts(net: Network, data: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 22) -> np.ndarray:
    """The score of each text from 0 to 1; 0 without a word."""
    x, has = text_features(net, data, offsets, chunk)
    return np.where(has, _sigmoid(x @ net.head), 0.0)


def _long(text: np.ndarray, chunk: int):
    """Pieces of a long text of about `chunk` bytes; each begins WORDS words (at most LONGEST bytes and a gap each) before the last one ended, at the end of a word where there is one."""
    at = 0
    while at < len(text):
        to = min(at + chunk, len(text))
        if to < len(text):
            breaks = np.flatnonzero(~_LETTER[text[at + chunk // 2 : to]])
            to = at + chunk // 2 + int(breaks[-1]) if len(breaks) else to
        yield text[at:to]
        if to == len(text):
            return
        starts, _ = words_of(text[at:to])
        at = at + int(starts[-WORDS]) if len(starts) > WORDS and starts[-WORDS] > 0 else to


def _texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _window_text(spans, places: np.ndarray) -> bytes:
    chunk, starts, ends = spans
    real = places[places >= 0]
    return b" ".join(chunk[a:b].tobytes() for a, b in zip(starts[real], ends[real], strict=True))


def _word_slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)


def _odds(texts: list[bytes], toxic: np.ndarray) -> dict[int, np.ndarray]:
    """By word (0) and length of piece: smoothed log odds of the texts that hold it, times the root of their number; 0 where fewer than 4 do."""
    seen = {k: np.zeros((2, _SLOTS + 1)) for k in (0, *PIECES)}
    for t, y in zip(texts, toxic, strict=True):
        data = lower_ascii(np.frombuffer(t, np.uint8))
        starts, ends = words_of(data)
        if len(starts):
            seen[0][int(y), np.unique(_word_slots(hash_spans(data, starts, ends)))] += 1
            for k, slots in zip(PIECES, _pieces(data, starts, ends)[0], strict=True):
                seen[k][int(y), np.unique(slots)] += 1
    n = [max(1, (toxic == y).sum()) for y in (0, 1)]
    out = {}
    for k, (clean, bad) in seen.items():
        out[k] = np.where(clean + bad >= 4, (np.log((bad + 0.5) / n[1]) - np.log((clean + 0.5) / n[0])) * np.sqrt(clean + bad), 0)
        out[k][_SLOTS] = 0
    return out


def _known(values: np.ndarray) -> np.ndarray:
    best = np.argsort(-np.abs(values), kind="stable")[:KEPT]
    best = best[values[best] != 0]
    out = np.full(_SLOTS + 1, KEPT, np.int32)
    out[best] = np.arange(len(best))
    return out


def _chosen(texts: list[bytes], toxic: np.ndarray, score, rng) -> tuple[list[bytes], list[int]]:
    """Training windows: the worst of each toxic text; of the others the worst and two random ones."""
    windows, labels = [], []
    for (values, places, spans), y in zip(score(texts), toxic, strict=True):
        if not len(values):
            continue
        picks = {int(values.argmax())}
        if not y:
            picks |= set(rng.integers(len(values), size=2).tolist())
        windows += [_window_text(spans, places[k]) for k in sorted(picks)]
        labels += [int(y)] * len(picks)
    return windows, labels


def fit_windows(texts: list[bytes], toxic: np.ndarray, rounds: tuple[int, ...] = (2, 2), steps: int = 100, batch: int = 64, rate: float = 0.01, seed: int = 5) -> Network:
    """Fit the network on labelled texts; in each round windows are chosen, then seen `rounds[k]` times, more often if they make few batches (`steps`)."""
    odds = _odds(texts, toxic)
    net, rng = Network(_known(odds[0]), seed), np.random.default_rng(seed)

    def by_odds(texts: list[bytes]):
        for t in texts:
            data = lower_ascii(np.frombuffer(t, np.uint8))
            starts, ends = words_of(data)
            if len(starts):
                slots, firsts = _pieces(data, starts, ends)
                word = np.maximum.reduceat(np.max([odds[k][g] for k, g in zip(PIECES, slots, strict=True)], axis=0), firsts)
                places, _ = windows_of(np.array([len(starts)]))
                yield np.where(places >= 0, word[np.maximum(places, 0)], -9).max(axis=1), places, (data, starts, ends)
            else:
                yield np.zeros(0), None, None

    def by_net(texts: list[bytes], together: int = 200):
        for at in range(0, len(texts), together):
            part = texts[at : at + together]
            logits, owner, places, spans = window_scores(net, *_texts(part))
            bounds = np.searchsorted(owner, np.arange(len(part) + 1))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                yield logits[a:b], places[a:b], spans

    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    for k, times in enumerate(rounds):
        windows, labels = _chosen(texts, toxic, by_net if k else by_odds, rng)
        y = np.array(labels, np.float32)
        batches = max(1, len(y) // batch)
        for _ in range(max(times, -(-steps // batches))):
            for rows in np.array_split(rng.permutation(len(y)), batches):
                step += 1
                data = np.frombuffer(b"\n".join(windows[r] for r in rows) + b"\n", np.uint8)
                starts, ends = words_of(data)
                lengths = np.array([windows[r].count(b" ") + 1 for r in rows])
                places = np.where(np.arange(WORDS) < lengths[:, None], (np.cumsum(lengths) - lengths)[:, None] + np.arange(WORDS), -1)
                unique, first, number = np.unique(hash_spans(data, starts, ends), return_index=True, return_inverse=True)
                places = np.where(places >= 0, number[np.maximum(places, 0)], -1)
                x, words = net.vectors(data, starts[first], ends[first], unique, keep=True)
                x[:, :_DIM] *= (rng.random((len(x), 1)) > 0.3).astype(np.float32)  # the spelling must do without the word at times
                logits, inner = net.forward(x, places, keep=True)
                grads = net.gradients(x, places, inner, ((_sigmoid(logits) - y[rows]) / len(rows)).astype(np.float32), words)
                for name, g in grads.items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    net.p[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last column is 1 and isn't shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(30):
        q = _sigmoid(x @ w)
        w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + shrink, x.T @ (q - y) + shrink @ w)
    return w


def _fit_part(texts: list[bytes], toxic: np.ndarray, part: int, seed: int, options: dict):
    """Parts 0 and 1: the rows of the other half and what a network of this half makes of them (None: one label only). Part 2: the network of all rows."""
    if part == 2:
        return fit_windows(texts, toxic, seed=seed, **options)
    rows = np.random.default_rng(seed).permutation(len(texts))
    own, other = np.sort(rows[part::2]), np.sort(rows[1 - part :: 2])
    if len(np.unique(toxic[own])) < 2 or not len(other):
        return None
    net = fit_windows([texts[i] for i in own], toxic[own], seed=seed, **options)
    return other, text_features(net, *_texts([texts[i] for i in other]))[0]


def fit(texts: list[bytes], toxic: np.ndarray, seed: int = 5, spark: SparkSession | None = None, **options) -> Network:
    """Fit on labelled texts: the network on all of them, its head on the scores that networks of one half give to the other half. With `spark` each of the three networks is fitted by a task of its own."""
    if spark is None:
        *halves, net = [_fit_part(texts, toxic, part, seed, options) for part in range(3)]
    else:
        shared = spark.sparkContext.broadcast((texts, toxic))

        def run(batches):
            for batch in batches:
                for part in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_pydict({"part": [part], "made": [pickle.dumps(_fit_part(*shared.value, part, seed, options))]})

        made = spark.range(0, 3, 1, 3).mapInArrow(run, "part long, made binary").collect()
        *halves, net = [pickle.loads(row["made"]) for row in sorted(made)]
    known = [half for half in halves if half is not None]
    if known:
        rows, x = np.concatenate([half[0] for half in known]), np.concatenate([half[1] for half in known])
        if len(np.unique(toxic[rows])) == 2:
            order = np.argsort(rows)
            net.head = _logistic(x[order], toxic[rows[order]].astype(float))
    return net


def crc_remainder(doc_id, modulus: int):
    """crc32 of the id as text (null: the empty text) mod a number."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = 2_400, most_bytes: int = 30_000) -> Network | None:
    """Fit on a bounded sample of the labelled rows that may be learned from (crc32 of the id mod 4 is not 2): at most `sample` different rows of texts of up to
    `most_bytes`, at most 2 in 5 of them toxic, those with the least hash of id and text. Null labels, ids and texts, and empty texts, teach nothing; a document with both labels is toxic.
    None if there is no such row with a label of 0 or none with 1."""
    free = crc_remainder(F.col("doc_id"), 4) != 2
    marks = labels.where("toxic is not null").where(free).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).where(free & F.octet_length("text").between(1, most_bytes))
    told = checkpointed(known.select("doc_id", "h").join(marks, "doc_id").select("h", F.col("toxic").cast("int").alias("toxic")).distinct(), files_for(docs)[0])
    drawn = [told.where(F.col("toxic") == y).orderBy("h").limit(n) for y, n in ((1, sample * 2 // 5), (0, sample * 3 // 5))]
    chosen = known.join(F.broadcast(drawn[0].union(drawn[1])), "h").select("h", "text", "toxic").dropDuplicates(["h"])  # `sample` keys of 12 bytes
    rows = chosen.toPandas().sort_values(["h", "text"], kind="stable")
    if rows["toxic"].nunique() < 2:
        return None
    return fit([t.encode() for t in rows["text"]], rows["toxic"].to_numpy(), spark=docs.sparkSession)


def score(docs: DataFrame, net: Network | None, column: str = "toxicity") -> DataFrame:
    """docs with a score from 0 to 1; only the text decides. Null, empty and wordless texts score 0, and all do without a network (nothing to learn from). Equal texts score alike; a column of that name is replaced."""
    docs = without_columns(docs, column)
    if net is None:
        return docs.withColumn(column, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.append_column(column, pa.array(score_texts(shared.value, *arrow_bytes(batch.column("text"))).astype(np.float64)))

    ddl = with_fields(docs.schema, f"`{column}` double")
    return map_arrow(docs, lambda it: in_batches(run, it), ddl)
