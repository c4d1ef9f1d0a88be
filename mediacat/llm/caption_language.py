"""Language of captions by a bidirectional recurrent network over their bytes.

A gated recurrent network reads every caption in chunks of bytes from both ends. Its two
states at a byte give the languages' probabilities there, and the mean over all bytes those
of the caption. Gates are piecewise linear (a clipped line instead of the sigmoid). The
network is trained here, by backpropagation through time, on chunks of labelled captions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

_CHUNK = 64
_HIDDEN = 8
_ROWS = 2048
_F = np.float32


class ByteNetwork:
    """The network; direction 0 reads forwards, direction 1 backwards."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        h, n = _HIDDEN, len(languages)
        self.languages = languages
        self.w = {
            "bytes": (rng.standard_normal((2, 256, 3 * h)) * 0.3).astype(_F),
            "state": (rng.standard_normal((2, h, 3 * h)) / np.sqrt(h)).astype(_F),
            "bias": np.zeros((2, 1, h), _F),
            "out": (rng.standard_normal((2, h, n)) / np.sqrt(h)).astype(_F),
            "shift": np.zeros(n, _F),
        }

    def states(self, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (step, direction, chunk, unit) over codes (step, direction, chunk)."""
        h, w = _HIDDEN, self.w
        state = np.zeros((2, codes.shape[2], h), _F)
        out = np.empty((len(codes), *state.shape), _F)
        for t, code in enumerate(codes):
            x = np.stack([w["bytes"][0].take(code[0], axis=0), w["bytes"][1].take(code[1], axis=0)])
            y = np.matmul(state, w["state"])
            gates = x[..., : 2 * h] + y[..., : 2 * h]
            gates *= _F(0.2)
            gates += _F(0.5)
            np.clip(gates, 0, 1, out=gates)
            r, z = gates[..., :h], gates[..., h:]
            inner = y[..., 2 * h :] + w["bias"]
            new = np.tanh(x[..., 2 * h :] + r * inner)
            if keep is not None:
                keep.append((state, gates, inner, new))
            state = new + z * (state - new)
            out[t] = state
        return out

    def read(self, codes: np.ndarray) -> np.ndarray:
        """The same as ``states``, in single precision and with reused memory."""
        h, w = _HIDDEN, self.w
        scale = np.r_[np.full(2 * h, 0.2, _F), np.ones(h, _F)]
        lines = w["bytes"] * scale + np.r_[np.full(2 * h, 0.5, _F), np.zeros(h, _F)]
        gate_lines, new_lines = lines[..., : 2 * h].copy(), lines[..., 2 * h :].copy()
        gate_state, new_state = w["state"][..., : 2 * h] * _F(0.2), w["state"][..., 2 * h :].copy()
        chunks = codes.shape[2]
        out = np.empty((len(codes), 2, chunks, h), _F)
        gates, line = np.empty((2, 2, chunks, 2 * h), _F)
        new, more = np.empty((2, 2, chunks, h), _F)
        state = np.zeros((2, chunks, h), _F)
        for code, ahead in zip(codes.astype(np.intp), out):
            np.matmul(state, gate_state, out=gates)
            for d in (0, 1):
                np.take(gate_lines[d], code[d], axis=0, out=line[d], mode="clip")
                np.take(new_lines[d], code[d], axis=0, out=more[d], mode="clip")
            gates += line
            np.maximum(gates, 0, out=gates)
            np.minimum(gates, 1, out=gates)
            np.matmul(state, new_state, out=new)
            new += w["bias"]
            new *= gates[..., :h]
            new += more
            np.tanh(new, out=new)
            np.subtract(state, new, out=ahead)
            ahead *= gates[..., h:]
            ahead += new
            state = ahead
        return out

    def probabilities(self, states: np.ndarray, back: np.ndarray | None) -> np.ndarray:
        """Languages at every byte, (step, chunk, language); ``back`` is the place of a byte
        counted from the end of its chunk, None where all chunks are full."""
        logits = states[:, 0] @ self.w["out"][0] + self.w["shift"]
        behind = states[:, 1] @ self.w["out"][1]
        logits += behind[::-1] if back is None else behind[back, np.arange(back.shape[1])[None, :]]
        np.clip(logits, -40, 40, out=logits)
        np.exp(logits, out=logits)
        total = logits[..., 0].copy()
        for k in range(1, logits.shape[2]):  # much faster than a sum over so short an axis
            total += logits[..., k]
        logits /= total[..., None]
        return logits

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict]:
        """Loss over all bytes of full chunks, and its gradients by time-reversed passes."""
        h, w, steps, chunks = _HIDDEN, self.w, len(codes), codes.shape[2]
        keep: list = []
        states = self.states(codes, keep)
        p = self.probabilities(states, None)
        loss = -np.log(p[:, np.arange(chunks), labels] + 1e-9).mean()
        error = p
        error[:, np.arange(chunks), labels] -= 1
        error /= steps * chunks
        both = np.stack([error, error[::-1]])  # direction 1 met the last byte first
        g = {k: np.zeros_like(v) for k, v in w.items()}
        g["shift"] = error.sum(axis=(0, 1))
        for d in (0, 1):
            g["out"][d] = np.einsum("tbh,tbn->hn", states[:, d], both[d])
        ahead = np.zeros((2, chunks, h), _F)
        for t in range(steps - 1, -1, -1):
            state, gates, inner, new = keep[t]
            r, z = gates[..., :h], gates[..., h:]
            up = ahead + np.einsum("dbn,dhn->dbh", both[:, t], w["out"])
            d_new = up * (1 - z) * (1 - new * new)
            d_gates = np.concatenate([d_new * inner, up * (state - new)], axis=2)
            d_gates *= _F(0.2) * ((gates > 0) & (gates < 1))
            d_inner = d_new * r
            d_y = np.concatenate([d_gates, d_inner], axis=2)
            d_x = np.concatenate([d_gates, d_new], axis=2)
            g["bias"] += d_inner.sum(axis=1, keepdims=True)
            g["state"] += np.einsum("dbh,dbk->dhk", state, d_y)
            for d in (0, 1):
                np.add.at(g["bytes"][d], codes[t, d], d_x[d])
            ahead = up * z + np.einsum("dbk,dhk->dbh", d_y, w["state"])
        return float(loss), g

    def train(self, chunks: np.ndarray, labels: np.ndarray, epochs: int = 4, rate: float = 0.02, batch: int = 128) -> None:
        """Adam over shuffled chunks (chunk, byte) of full length."""
        rng = np.random.default_rng(1)
        mean = {k: np.zeros_like(v) for k, v in self.w.items()}
        square = {k: np.zeros_like(v) for k, v in self.w.items()}
        step, total = 0, max(1, epochs * -(-len(chunks) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(chunks))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                forward = chunks[some].T
                codes = np.stack([forward, forward[::-1]], axis=1)
                _, g = self.gradients(codes, labels[some])
                step += 1
                pace = rate * (1 - 0.9 * step / total)
                for k, v in g.items():
                    v = np.clip(v, -1, 1)
                    mean[k] += 0.1 * (v - mean[k])
                    square[k] += 0.01 * (v * v - square[k])
                    change = pace * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
                    self.w[k] = (self.w[k] - change).astype(_F)

    def label(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities of each text's bytes, (text, language); zeros for empty ones."""
        sizes = np.array([len(t) for t in texts], np.int64)
        data = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        pieces = -(-sizes // _CHUNK)
        owner = np.repeat(np.arange(len(texts)), pieces)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = np.repeat(np.cumsum(sizes) - sizes, pieces) + within * _CHUNK
        length = np.minimum(_CHUNK, sizes[owner] - within * _CHUNK)
        sums = np.zeros((len(texts), len(self.languages)))
        steps = np.arange(_CHUNK)[:, None]
        whole = length == _CHUNK
        for some in (np.flatnonzero(whole), np.flatnonzero(~whole)):
            for at in range(0, len(some), _ROWS):
                own = some[at : at + _ROWS]
                s, n = start[own], length[own]
                back = np.maximum(n - 1 - steps, 0)
                ahead = np.minimum(s + steps, len(data) - 1)
                states = self.read(np.stack([data[ahead], data[s + back]], axis=1))
                if whole[own[0]]:
                    p = self.probabilities(states, None)
                else:
                    p = self.probabilities(states, back) * (steps < n)[:, :, None]
                np.add.at(sums, owner[own], p.sum(axis=0))
        return sums / np.maximum(sizes, 1)[:, None]


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def learn_languages(labelled: DataFrame, most_labelled: int = 1_000) -> ByteNetwork | None:
    """A network trained on (media_item_id, google_description, language).

    At most ``most_labelled`` captions with a language are used, taken by hash of the id,
    and all bytes of each, in full chunks of which the last ends with the caption. NULL ids
    are left out; of repeated ids all rows are used. None without any caption.
    """
    known = labelled.filter(F.col("language").isNotNull() & F.col("media_item_id").isNotNull())
    some = known.select("media_item_id").distinct().orderBy(F.xxhash64("media_item_id"), "media_item_id").limit(most_labelled)
    sample = known.join(F.broadcast(some), "media_item_id").select("google_description", "language")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, language in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not has_letter(text):
                    continue
                raw = text.encode()
                if len(raw) < _CHUNK:
                    raw = (raw + b" ") * (_CHUNK // (len(raw) + 1) + 1)
                for at in [*range(0, len(raw) - _CHUNK, _CHUNK), len(raw) - _CHUNK]:
                    rows.append((raw[at : at + _CHUNK], language))
            columns = list(zip(*rows)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], names=["chunk", "language"])

    found = sample.mapInArrow(cut, "chunk binary, language string").toArrow().sort_by([("chunk", "ascending"), ("language", "ascending")])
    if not found.num_rows:
        return None
    names = found.column("language").to_pylist()
    network = ByteNetwork(sorted(set(names)))
    chunks = np.frombuffer(b"".join(found.column("chunk").to_pylist()), np.uint8).reshape(-1, _CHUNK)
    network.train(chunks, np.array([network.languages.index(n) for n in names]))
    return network


def predict_languages(media_items: DataFrame, network: ByteNetwork | None) -> DataFrame:
    """(media_item_id, language, score) of every caption, from all of its bytes.

    ``language`` is ``und`` for captions that are NULL or have no letter, with score 0, and
    for all where there is no network. Repeated rows and NULL ids are kept. No rows, no rows.
    """
    shared = media_items.sparkSession.sparkContext.broadcast(network)
    schema = T.StructType([
        T.StructField("media_item_id", media_items.schema["media_item_id"].dataType),
        T.StructField("language", T.StringType()), T.StructField("score", T.DoubleType()),
    ])

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column(1).to_pylist()
                found, score = ["und"] * len(texts), np.zeros(len(texts))
                lettered = [i for i, t in enumerate(texts) if net is not None and has_letter(t)]
                if lettered:
                    p = net.label([texts[i].encode() for i in lettered])
                    for i, row in zip(lettered, p):
                        found[i], score[i] = net.languages[int(row.argmax())], min(1.0, float(row.max()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found), pa.array(score)], names=schema.names)

    return media_items.select("media_item_id", "google_description").mapInArrow(label, schema)
