"""Toxicity with noisy-channel deobfuscation.

Obfuscated passages (digits and signs for letters, letters spaced out, letters drawn out) become a lattice of readings,
and Viterbi's algorithm picks the most likely one under a character trigram model, whose counts are taken over every
text of the corpus. Passages with one reading stay as they are. The restored text is then scored by words and word
beginnings that labelled rows show to be toxic. A beginning that clean texts hold now and then, the longer the more often,
is evidence where it is dense, that is, where it begins a share of ``DENSE`` of a text's words.

Three jobs: counts of trigrams (at most 32,768 sums), document frequencies of words in a bounded sample of labelled rows
(pre-aggregated in tasks), and one scoring pass over whole texts. Evidence is tested where the frequencies are counted, so
that only features that pass reach the driver, however many others are more frequent. A text with evidence starts from the
share of toxic labels, one without any gets the share of toxic ones among such texts, both learned.

Time and memory grow in proportion to a passage's length: where a lattice has one state left, its reading so far is
settled, and every ``STRETCH`` signs what all paths that are still alive have in common. Readings are exact however long a
passage stays ambiguous.

Defined results: null, empty and wordless texts get the model's base score; labels other than 0 and 1 and null labels
are not learned from, and without both classes nothing is toxic; of rows that share an id one is learned from; repeated
rows are scored each; input columns pass through ``score`` and those with the names of its results are replaced; an
empty table gives an empty table.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from facetra.llm.common import crc_mod, fresh, mapped, ship
from facetra.llm.quality_model import training_rows
from facetra.storage import clean, mark, stored

#: Labelled rows of each class that words are learned from, at most.
SAMPLE = 6000
#: Evidence (log likelihood ratio) from which a feature counts.
EVIDENCE = 20.0
THRESHOLD = 0.7
#: A feature is at least so many times as frequent in toxic texts; chosen among 20 to 80 on the labels learned from.
RATIO = 60
#: The same for a feature of no clean row, whose ratio the number of clean rows bounds.
UNSEEN = 20
#: A beginning counts if so many words with it do.
WORDS = 3
#: Share of a text's words with one beginning from which that beginning is dense; chosen on the labels learned from.
DENSE = 0.01
#: Score of a text without any feature where labels are of one class or missing.
BASE = 0.04
MODULUS, HELD = 3, 1
#: Passages that a worker remembers, and the longest of them.
REMEMBERED, LONGEST = 200_000, 256
#: Ambiguous signs after which paths are looked through for what they share.
STRETCH = 4096

#: Signs and the letters that they stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e",
}
COST = {"leet": 1.0, "drop_sign": 5.0, "break_sign": 4.0, "drop_gap": 0.3, "keep_gap": 3.0, "repeat": 0.5}

_SIGNS = "".join(re.escape(c) for c in LEET)
_SEED = re.compile(rf"[{_SIGNS}](?=[^\W\d_])|(?<=[^\W\d_])[0-9@$](?![{_SIGNS}\w])")
_TOKEN = re.compile(rf"(?<!\S)[^\s{_SIGNS}]*+[{_SIGNS}]\S*+")
_SPACED = re.compile(
    r"(?<![^\W_])(?:[^\W\d_](?:[ .\-_*]{1,3}[^\W\d_]){2,}|[^\W\d_]{1,3}(?:[.\-_*][^\W\d_]{1,3}){2,})(?![^\W_])"
)
_DRAWN = re.compile(r"\b\w*([^\W\d_])\1\1\w*")
_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(.)\1*", re.S)
_PLAIN = re.compile(r"[a-z]{3,4096}")
_THRICE = re.compile(r"([a-z])\1\1")

#: Symbols: 0 a gap, 1-26 a-z, 27-30 other letters (by bytes), 31 anything else.
_SYMBOL = np.array(
    [0 if b in (32, 9, 10, 11, 12, 13) else (b | 32) - 96 if chr(b).isalpha() and b < 128 else 27 + b % 4 if b > 127 else 31 for b in range(256)],
    np.int64,
)


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of symbol trigrams over all texts, (32, 32, 32)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from facetra.llm import toxicity as own

        total = np.zeros(1 << 15, np.int64)
        for batch in batches:
            for t in batch.column(0):
                raw = (t.as_py() or "").encode("utf-8", "replace")
                for lo in range(0, len(raw), 1 << 20):
                    s = own._SYMBOL[np.frombuffer(raw[lo : lo + (1 << 20) + 2], np.uint8)]
                    if len(s) > 2:
                        total += np.bincount((s[:-2] << 10) | (s[1:-1] << 5) | s[2:], minlength=1 << 15)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    rows = docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(1 << 15)
    for r in rows:  # at most 32,768
        out[r["code"]] = r["n"]
    return out.reshape(32, 32, 32)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first, second), backing off to shorter histories."""
    one = counts.sum((0, 1)) + 1.0
    p1 = one / one.sum()
    two = counts.sum(0)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    return np.log((counts + 5 * p2) / (counts.sum(2, keepdims=True) + 5)).astype(np.float32)


@functools.lru_cache(1 << 16)
def _code(c: str) -> int:
    return int(_SYMBOL[c.encode("utf-8", "replace")[0]])


def _ways(run: str) -> list[tuple[str, float]]:
    """Readings of a run of one character and their costs."""
    c, n = run[0], len(run)
    if c.isalpha():
        return [(run, 0.0)] if n < 3 else [(c, COST["repeat"]), (c * 2, COST["repeat"])]
    if c in LEET:
        ways = [(x * k, COST["leet"] * min(n, 2)) for x in LEET[c] for k in {1, min(n, 2)}]
        return [*ways, ("", COST["drop_sign"]), (" ", COST["break_sign"])]
    return [("", COST["drop_gap"]), (" ", COST["keep_gap"])]


def readings(passage: str) -> Iterator[list[tuple[str, float]]]:
    """The lattice: for each run of one character its readings and their costs. After two runs of plain letters, which
    leave one state, the rest of a word comes as one."""
    at = 0
    while at < len(passage):
        plain = _PLAIN.match(passage, at)
        end = at
        if plain:
            drawn = _THRICE.search(passage, at, plain.end())
            end = drawn.start() if drawn else plain.end()
            while at < end < len(passage) and passage[end] == passage[end - 1]:  # not within a run
                end -= 1
        for _ in range(2 if end > at else 1):
            if at < len(passage):
                m = _RUN.match(passage, at)
                yield _ways(m[0])
                at = m.end()
        if at < end:
            yield [(passage[at:end], 0.0)]
            at = end


def restore(passage: str, model) -> str:
    """The likeliest reading of a passage (Viterbi over the last two symbols). Paths are chains of back pointers, which end
    where a single state is left or where all paths have been the same so far."""
    out: list[str] = []
    best: dict[tuple[int, int], tuple[float, list | None]] = {(0, 0): (0.0, None)}
    depth = 0
    for ways in itertools.chain(readings(passage), [[(" ", 0.0)]]):
        if len(best) == 1 and len(ways) == 1:  # nothing to choose
            (x, y), (_, path) = next(iter(best.items()))
            for c in ways[0][0][-2:]:
                x, y = y, _code(c)
            best = {(x, y): (0.0, [path, ways[0][0]])}
        else:
            new: dict[tuple[int, int], tuple[float, list | None]] = {}
            for (a, b), (cost, path) in best.items():
                for text, extra in ways:
                    x, y, total = a, b, cost + extra
                    for c in text:
                        z = _code(c)
                        if not (z == 0 and y == 0):
                            total -= model[x][y][z]
                        x, y = y, z
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = (total, [path, text])
            best = new
        depth += 1
        if len(best) == 1:
            ((state, (_, path)),) = best.items()
            out.append(_said(path))
            best, depth = {state: (0.0, None)}, 0
        elif depth % STRETCH == 0:
            out.append(_shared([path for _, path in best.values()]))
    return ("".join(out) + _said(min(best.values(), key=lambda v: v[0])[1])).strip()


def _shared(paths: list[list | None]) -> str:
    """What the paths have in common from their beginning, which is cut off them."""
    trunk, node = [], paths[0]
    while node is not None:
        trunk.append(node)
        node = node[0]
    place = {id(n): i for i, n in enumerate(trunk)}
    cut = 0
    for path in paths[1:]:
        branch, node = [], path
        while node is not None and id(node) not in place:
            branch.append(node)
            node = node[0]
        at = len(trunk) if node is None else place[id(node)]
        place |= {id(n): at for n in branch}  # seen: where it leaves the first path
        cut = max(cut, at)
    said = "".join(n[1] for n in reversed(trunk[cut:]))
    if cut < len(trunk):
        trunk[cut][:] = [None, ""]
    return said


def _said(path: list | None) -> str:
    parts = []
    while path is not None:
        path, text = path
        parts.append(text)
    return "".join(reversed(parts))


class Restorer:
    """Restores whole texts; remembers passages."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model.tolist(), {}

    def _passage(self, m: re.Match) -> str:
        said = self.known.get(m[0])
        if said is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            said = restore(m[0], self.model)
            if len(m[0]) <= LONGEST:
                self.known[m[0]] = said
        return said

    def _token(self, m: re.Match) -> str:
        return self._passage(m) if _SEED.search(m[0]) else m[0]

    def __call__(self, text: str) -> str:
        text = text.lower()
        if _SEED.search(text):
            text = _TOKEN.sub(self._token, text)
        text = _SPACED.sub(self._passage, text)
        return _DRAWN.sub(self._passage, text)


def features(text: str) -> set[str]:
    """Words of a restored text, their beginnings of four and five letters, marked with ``*``, and the dense ones of those,
    marked with ``**``."""
    words = Counter(_WORD.findall(text))
    begun = beginnings(words)
    dense = DENSE * words.total()
    return set(words) | {b + "*" for b in begun} | {b + "**" for b, n in begun.items() if n >= dense}


def beginnings(words: Counter) -> Counter:
    """How many words begin with which four and five letters, and go on."""
    begun = Counter()
    for w, n in words.items():
        for k in (4, 5):
            if len(w) > k:
                begun[w[:k]] += n
    return begun


@dataclass
class Model:
    lm: np.ndarray
    weights: dict[str, float]  # feature -> log odds that it adds
    prior: float = BASE  # of a text with a feature, before its evidence
    base: float = BASE  # score of a text without one

    def __post_init__(self):
        self.starts = {f[:4] for f in self.weights}
        self.restorer = Restorer(self.lm)

    def evidence(self, restored: str) -> list[float]:
        """What each distinct word of a restored text adds, from its most specific feature, and what is dense in it, once
        for each beginning of four letters without such a word."""
        words = Counter(_WORD.findall(restored))
        known = Counter({w: n for w, n in words.items() if w[:4] in self.starts})
        found, seen = [], set()
        for w in sorted(known):
            for f in (w, w[:5] + "*", w[:4] + "*"):
                if f in self.weights and (f == w or len(w) >= len(f)):
                    found.append(self.weights[f])
                    seen.add(w[:4])
                    break
        begun, dense = beginnings(known), DENSE * words.total()
        for b in sorted(begun, key=lambda b: (-len(b), b)):
            if begun[b] >= dense and b + "**" in self.weights and b[:4] not in seen:
                found.append(self.weights[b + "**"])
                seen.add(b[:4])
        return found

    def score(self, text: str | None) -> float:
        found = self.evidence(self.restorer(text or ""))
        return float(1 / (1 + np.exp(-np.log(self.prior / (1 - self.prior)) - sum(found)))) if found else self.base


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Model:
    """Counts trigrams over all docs; learns features from labelled rows whose crc32 of the id is not 1 modulo 3."""
    lm = log_model(trigram_counts(docs, text))
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows, labelled = training_rows(narrow, labels.withColumnRenamed(doc_id, "doc_id"), label, MODULUS, HELD, sample)
    rows = rows.where(F.col("text").isNotNull()).groupBy("doc_id").agg(F.min(F.struct("_y", "text")).alias("r")).select("r._y", "r.text")

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from facetra.llm import toxicity as own

        restorer = own.Restorer(lm)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([restorer(t.as_py()) for t in batch.column(1)], pa.string())], ["y", "text"])

    at = mark()
    read = stored(rows.mapInArrow(restored, "y int, text string"), "restored")  # at most 2 * sample rows

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from facetra.llm import toxicity as own

        for batch in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n[y].update(own.features(t.as_py()))
                n[y][""] += 1  # documents
            names = sorted(n[0] | n[1])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([c[f] for f in names], pa.int64()) for c in n]], ["f", "n0", "n1"])

    counted = read.mapInArrow(counts, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = stored(counted.where((F.col("n1") > 2) | (F.col("f") == "")), "features")
    total = counted.where("f = ''").first()  # one row
    if not (total and total["n0"] and total["n1"]):
        clean(at)
        return Model(lm, {})
    got = counted.where((F.col("f") != "") & evident(total["n0"], total["n1"])).collect()
    weights = weigh({"": (total["n0"], total["n1"])} | {r["f"]: (r["n0"], r["n1"]) for r in got})

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from facetra.llm import toxicity as own

        known = own.Model(lm, weights)
        for batch in batches:
            free = [not known.evidence(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(free, pa.bool_())], ["y", "free"])

    free = {r["y"]: r["n"] for r in read.mapInArrow(without, "y int, free boolean").groupBy("y").agg(F.count_if("free").alias("n")).collect()}
    clean(at)
    share = {y: labelled[y] * (free.get(y, 0) + 0.5) / (total[f"n{y}"] + 1) for y in (0, 1)}
    kept_in = lambda p: float(min(0.5, max(1e-4, p)))
    return Model(lm, weights, kept_in(labelled[1] / (labelled[0] + labelled[1])), kept_in(share[1] / (share[0] + share[1])))


def evident(all0: int, all1: int) -> Column:
    """Whether n0 and n1 can pass ``weigh``, which decides; a hair wider, as logarithms may differ in their last bits."""
    n0, n1 = F.col("n0"), F.col("n1")
    e1, e0 = (n0 + n1) * all1 / F.lit(float(all0 + all1)), (n0 + n1) * all0 / F.lit(float(all0 + all1))
    llr = 2 * (n1 * F.log(n1 / e1) + F.when(n0 > 0, n0 * F.log(n0 / e0)).otherwise(0.0))
    p1, p0 = (n1 + 0.5) / (all1 + 1), (n0 + 0.5) / (all0 + 1)
    return (n1 * all0 > n0 * all1) & (llr >= EVIDENCE - 1e-6) & (p1 > F.when(n0 > 0, RATIO).otherwise(UNSEEN) * p0 * (1 - 1e-9))


def weigh(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Features with enough evidence for toxicity; "" has the numbers of documents. Words whose beginning passes where it
    is dense, but not by itself, are left to the dense beginning."""
    all0, all1 = counts.get("", (0, 0))
    out = {}
    if all0 and all1:
        for f, (n0, n1) in counts.items():
            if f and n1 * all0 > n0 * all1:
                e1, e0 = (n0 + n1) * all1 / (all0 + all1), (n0 + n1) * all0 / (all0 + all1)
                llr = 2 * (n1 * np.log(n1 / e1) + (n0 * np.log(n0 / e0) if n0 else 0.0))
                p1, p0 = (n1 + 0.5) / (all1 + 1), (n0 + 0.5) / (all0 + 1)
                if llr >= EVIDENCE and p1 > (RATIO if n0 else UNSEEN) * p0:
                    out[f] = float(np.log(p1 / p0))
    # a beginning that is evidence only where it is dense: its single words are not
    alone = lambda f: any(len(f) > k and f[:k] + "**" in out for k in (4, 5)) and not any(f[:k] + "*" in out for k in (4, 5))
    out = {f: w for f, w in out.items() if f.endswith("**") or not alone(f)}
    support = Counter(w[:k] + "*" for w in out if not w.endswith("*") for k in (4, 5) if len(w) > k)
    return {f: w for f, w in out.items() if not f.endswith("*") or f.endswith("**") or support[f] >= WORDS}


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in keep) with held_out, score and predicted."""
    ship(docs.sparkSession)
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("held_out", "score", "predicted")]
    held = (crc_mod(f"`{doc_id}`", MODULUS) == HELD).alias("held_out")
    rows = docs.select(*[F.col(f"`{c}`") for c in names], held, F.col(f"`{text}`").cast("string").alias(fresh(docs.columns, "body")))
    schema = StructType([*rows.schema.fields[:-1], *StructType.fromDDL("score double")])
    lm, weights, prior, base = model.lm, model.weights, model.prior, model.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from facetra.llm import toxicity as own

        known = own.Model(lm, weights, prior, base)
        for batch in batches:
            scores = [known.score(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], schema.names)

    return mapped(rows, run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
