"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

The network is trained on the driver by backpropagation through time, on windows of a bounded sample of labelled texts,
and predicts a language at every byte; a document's probabilities are the mean over all its bytes. Texts are read whole,
in windows of ``WINDOW`` bytes that run through the network side by side, ``PART`` bytes of texts at a time, so that a
very long text takes time but no more memory. The sample counts distinct texts, and only cut-outs of ``TRAIN_WINDOW``
characters from all over them leave the tasks: at most ``SAMPLE`` x ``CUTS`` for each language.

Defined results: null texts and texts without a letter are ``und`` with score 0; with no learned language every text is
``und``; ties go to the first language in alphabetical order; repeated rows are predicted each; null languages are not
learned; input columns other than the text pass through ``identify`` and those with the names of its results are
replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from facetra.llm.common import crc_mod, fresh, mapped, ship

HIDDEN = 8
#: Labelled texts of each language that the network is trained on, about and at most.
SAMPLE = 400
STEPS, BATCH, TRAIN_WINDOW, RATE = 300, 96, 48, 0.02
#: Cut-outs of a text for training.
CUTS = 24
#: Bytes of a window, and windows side by side, when predicting.
WINDOW, SIDE = 128, 4096
#: Bytes of texts at once; a multiple of WINDOW.
PART = 1 << 22
HELD_MODULUS = 5
UND = "und"


def _squash(a: np.ndarray, room: np.ndarray) -> np.ndarray:
    """a / (1 + |a|) in place: an S-shaped curve like tanh, at a fraction of its time; gates take (1 + it) / 2."""
    np.abs(a, out=room)
    room += 1
    a /= room
    return a


@dataclass
class Network:
    """table: bytes to gates (update, reset, candidate), one of each direction; inner: state to gates; out: states to languages."""

    langs: tuple[str, ...]
    p: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, langs: tuple[str, ...], hidden: int = HIDDEN, seed: int = 3, kind=np.float32) -> Network:
        r = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p[f"table_{d}"] = r.normal(0, 0.3, (3, 256, hidden))
            p[f"table_{d}"][0] += 1.0  # states last at first
            p[f"inner_{d}"] = r.normal(0, hidden**-0.5, (3, hidden, hidden))
            p[f"out_{d}"] = r.normal(0, hidden**-0.5, (hidden, len(langs)))
        p["bias"] = np.zeros(len(langs))
        return cls(langs, {k: v.astype(kind) for k, v in p.items()})

    def _run(self, d: str, x: np.ndarray, valid: np.ndarray | None, keep: list | None) -> Iterator[tuple[int, np.ndarray]]:
        """(position, states) of one direction; x: bytes (window, side) as indices. keep: gets what the way back needs."""
        table, inner = self.p[f"table_{d}"], self.p[f"inner_{d}"]
        h = np.zeros((x.shape[1], inner.shape[1]), inner.dtype)
        own, room = np.empty_like(h), np.empty_like(h)

        def gate(k: int, y: np.ndarray) -> np.ndarray:
            y += np.take(table[k], x[t], axis=0, out=own, mode="clip")
            return _squash(y, room)

        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            z = gate(0, h @ inner[0])
            z += 1
            z *= 0.5
            r = gate(1, h @ inner[1])
            r += 1
            r *= 0.5
            u = h @ inner[2]
            n = gate(2, r * u)
            before = h
            h = h - n
            h *= z
            h += n
            if valid is not None:
                h *= valid[t][:, None]
            if keep is not None:
                keep.append((t, before, z, r, u, n))
            yield t, h

    def probabilities(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Of each language at each byte: (window, language, side); zeros after a window's end."""
        valid = None
        if lengths.min() < len(x):
            valid = (np.arange(len(x))[:, None] < lengths).astype(self.p["bias"].dtype)
        out = np.empty((len(x), len(self.langs), x.shape[1]), self.p["bias"].dtype)
        w = self.p["out_f"].T.copy()
        for t, h in self._run("f", x, valid, None):
            np.matmul(w, h.T, out=out[t])
        w = self.p["out_b"].T.copy()
        for t, h in self._run("b", x, valid, None):
            y = out[t]
            y += w @ h.T
            y += self.p["bias"][:, None]
            y -= y.max(0)
            np.exp(y, out=y)
            y /= y.sum(0)
            if valid is not None:
                y *= valid[t]
        return out

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all bytes of full windows x (window, side), whose languages are y (side), and its gradients."""
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        keep: dict[str, list] = {"f": [], "b": []}
        states = {d: dict(self._run(d, x, None, keep[d])) for d in "fb"}
        count, loss, errors = x.size, 0.0, {}
        for t in range(len(x)):
            a = states["f"][t] @ self.p["out_f"] + states["b"][t] @ self.p["out_b"] + self.p["bias"]
            a = np.exp(a - a.max(1, keepdims=True))
            a /= a.sum(1, keepdims=True)
            rows = np.arange(len(y))
            loss -= float(np.log(a[rows, y] + 1e-12).sum())
            a[rows, y] -= 1
            errors[t] = e = a / count
            g["bias"] += e.sum(0)
            for d in "fb":
                g[f"out_{d}"] += states[d][t].T @ e
        for d in "fb":
            inner, out = self.p[f"inner_{d}"], self.p[f"out_{d}"]
            dh = np.zeros_like(states[d][0])
            for t, before, z, r, u, n in reversed(keep[d]):
                dh = dh + errors[t] @ out.T
                dz = dh * (before - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
                dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
                dr = dn * u * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
                du = dn * r
                for k, e in enumerate((dz, dr, dn)):
                    np.add.at(g[f"table_{d}"][k], x[t], e)
                for k, e in enumerate((dz, dr, du)):
                    g[f"inner_{d}"][k] += before.T @ e
                dh = dh * z + dz @ inner[0].T + dr @ inner[1].T + du @ inner[2].T
        return loss / count, g


def fit(texts: list[tuple[str, bytes]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 3) -> Network:
    """Trains on (language, text) pairs: Adam on random windows, with each language as often."""
    langs = tuple(sorted({lang for lang, _ in texts}))
    net = Network.fresh(langs, hidden, seed)
    by = [[t for lang, t in texts if lang == name and t] for name in langs]
    if len(langs) < 2 or not all(by):
        return net
    r = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v = {k: np.zeros_like(w) for k, w in net.p.items()}
    for step in range(1, steps + 1):
        y = np.arange(BATCH) % len(langs)
        x = np.full((BATCH, TRAIN_WINDOW), 32, np.intp)
        for i, k in enumerate(y):
            t = by[k][r.integers(len(by[k]))]
            at = r.integers(max(1, len(t) - TRAIN_WINDOW + 1))
            part = np.frombuffer(t[at : at + TRAIN_WINDOW], np.uint8)
            x[i, : len(part)] = part
        _, g = net.gradients(np.ascontiguousarray(x.T), y)
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, w in net.p.items():
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            w -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(w.dtype)
    return net


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts (side, WINDOW), their lengths and their texts' numbers; the longest first."""
    sizes = np.array([len(t) for t in texts])
    per = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(texts)), per)
    x = np.zeros((int(per.sum()), WINDOW), np.uint8)
    lengths = np.full(len(x), WINDOW)
    at = 0
    for t, n in zip(texts, per, strict=True):
        x[at : at + n].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
        if n:
            lengths[at + n - 1] = len(t) - (n - 1) * WINDOW
        at += n
    order = np.argsort(-lengths, kind="stable")
    return x[order], lengths[order], owner[order]


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities over all bytes of each text (text, language)."""
    total = np.zeros((len(texts), len(net.langs)))

    def run(pieces: list[bytes], of: list[int]) -> None:
        x, lengths, owner = _windows(pieces)
        owner = np.array(of)[owner]
        for lo in range(0, len(x), SIDE):
            part, n = x[lo : lo + SIDE], lengths[lo : lo + SIDE]
            seen = np.ascontiguousarray(part[:, : n.max()].T, dtype=np.intp)
            sums = net.probabilities(seen, n).sum(0).T
            np.add.at(total, owner[lo : lo + SIDE], sums)

    pieces, of, size = [], [], 0
    for i, t in enumerate(texts):
        for lo in range(0, len(t), PART):
            piece = t[lo : lo + PART]
            if size + len(piece) > PART:
                run(pieces, of)
                pieces, of, size = [], [], 0
            pieces.append(piece)
            of.append(i)
            size += len(piece)
    if pieces:
        run(pieces, of)
    return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def positions(net: Network, text: str) -> list[str]:
    """The language at every byte of a text."""
    raw = text.encode("utf-8", "replace")
    out: list[str] = []
    for lo in range(0, len(raw), WINDOW):
        x = np.frombuffer(raw[lo : lo + WINDOW], np.uint8)[:, None].astype(np.intp)
        out += [net.langs[k] for k in net.probabilities(x, np.array([len(x)]))[:, :, 0].argmax(1)]
    return out


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Network:
    """Learns from rows with a language whose crc32 of the id is not 0 modulo 5: per language the distinct texts with small
    hashes, however often each occurs."""
    rows = docs.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"), F.col(f"`{doc_id}`").alias("doc_id"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (crc_mod("doc_id", HELD_MODULUS) != 0))
    distinct = F.approx_count_distinct(F.xxhash64("text"), 0.02).alias("n")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(distinct).collect()}  # a row per language
    scale = 1 << 31
    limit = F.lit(0)
    for name, n in counts.items():
        limit = F.when(F.col("lang") == name, F.lit(min(scale, int(1.3 * sample / max(n, 1) * scale)))).otherwise(limit)
    picked = rows.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(scale))).where(F.col("h") < limit)
    one = picked.groupBy("lang", "h").agg(F.min("text").alias("text"))  # equal texts once
    room = F.greatest(F.length("text") - TRAIN_WINDOW, F.lit(0)) + 1
    cuts = F.transform(F.sequence(F.lit(1), F.lit(CUTS)), lambda i: F.substring("text", (F.pmod(F.xxhash64("h", i), room) + 1).cast("int"), F.lit(TRAIN_WINDOW)))
    by: dict[str, list] = {}
    for r in sorted(one.select("lang", "h", cuts.alias("cuts")).collect()):
        by.setdefault(r["lang"], []).append([c.encode("utf-8", "replace") for c in r["cuts"]])
    return fit([(name, c) for name, texts in by.items() for cut in texts[:sample] for c in cut])


def identify(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with held_out, lang_pred and score."""
    ship(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("held_out", "lang_pred", "score")]
    body = F.when(F.col(f"`{text}`").rlike(r"\p{L}"), F.col(f"`{text}`").cast("string"))
    rows = docs.select(*[F.col(f"`{c}`") for c in names], (crc_mod(f"`{doc_id}`", HELD_MODULUS) == 0).alias("held_out"), body.alias(fresh(docs.columns, "body")))
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL("lang_pred string, score double")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from facetra.llm import language_id as own

        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                raw = [(t.as_py() or "").encode("utf-8", "replace") for t in batch.column(batch.num_columns - 1)]
                langs, scores = [own.UND] * len(raw), [0.0] * len(raw)
                if net.langs:
                    p = own.pooled(net, raw)
                    for i, t in enumerate(raw):
                        if t:
                            k = int(p[i].argmax())
                            langs[i], scores[i] = net.langs[k], min(1.0, float(p[i, k]))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return mapped(rows, run, schema)
