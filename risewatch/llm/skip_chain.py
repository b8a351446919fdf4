"""Personal data by rules and a skip-chain conditional random field.

Rules find the base spans. The field labels the tokens around them: a linear chain joins neighbouring tokens, skip edges
join a token to the next one in the document that is equal or similar (same text without case and punctuation, same last
seven digits, same local part of an address), and loopy sum-product message passing with a flooding schedule makes the
labels of such tokens agree. Tokens under a base span are clamped to its kind. A token of another kind whose belief
reaches ``least`` becomes an added span; base spans are never changed.

The field is trained on the corpus by counting, with the base spans as labels: token shape given label, label pairs of
neighbours, label pairs of skip edges. The three tables have a fixed number of entries and are summed over all texts.

Only tokens with a digit or an @ and their neighbours are nodes: nothing else can get a label. Offsets are code points,
ends exclusive. Null texts are empty: no spans. Repeated rows get equal spans. Two base spans of different kinds may
overlap; a token under several is clamped to the first of ``KINDS``. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risewatch.llm.common import slices, spare

KINDS = ("email", "ip", "card", "phone")
SPAN = T.StructType(
    [
        T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
        T.StructField("base", T.BooleanType()), T.StructField("belief", T.DoubleType()),
    ]
)
#: Labels: no entity, then the kinds.
LABELS = 1 + len(KINDS)
ROUNDS = 12

# Possessive repeats and lookbehinds keep the searches linear; the matches are those of the plain patterns.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TOKEN = re.compile(r"\S+")
_SEED = re.compile(r"\S*[0-9@]\S*")
_EDGE = "\"'`,;:!?()[]{}<>."


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]+", "", s)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the rules' matches: leftmost, non-overlapping per kind, failing ones dropped."""
    out, last = [], 0
    if "@" in text:
        for m in _DOMAIN.finditer(text):
            at = start = m.start()
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                last = m.end()
                out.append((start, 0, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def shape(token: str) -> int:
    """One of ``SHAPES`` shapes: digits, dots, @, +, brackets, letters."""
    digits = sum(c.isdigit() for c in token)
    return min(digits, 20) + 21 * (min(token.count("."), 3) + 4 * (("@" in token) + 2 * (("+" in token) + 2 * (any(c in "()-" for c in token) + 2 * any(c.isalpha() for c in token)))))


SHAPES = 21 * 64


def nodes(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Token spans that the field sees, and for each its place in the text's token order (neighbours differ by one)."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = np.array([t[0] for t in tokens], np.int64)
    ends = np.array([t[1] for t in tokens], np.int64)
    hot = {int(np.searchsorted(starts, m.start(), "right")) - 1 for m in _SEED.finditer(text)}
    for start, _, end in spans:
        hot.update(range(int(np.searchsorted(ends, start, "right")), int(np.searchsorted(starts, end, "left"))))
    keep = sorted({j for i in hot for j in (i - 1, i, i + 1) if 0 <= j < len(tokens)})
    return [tokens[i] for i in keep], np.array(keep, np.int64)


def graph(text: str, at: list[tuple[int, int]], place: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Chain edges, skip edges (each to the next similar node, so as many as nodes and keys) and the shapes."""
    chain = np.flatnonzero(np.diff(place) == 1)
    last: dict[str, int] = {}
    skip, shapes = [], []
    for i, (a, b) in enumerate(at):
        word = text[a:b].strip(_EDGE).lower()
        shapes.append(shape(word))
        if not any(c.isdigit() or c == "@" for c in word):
            continue
        keys = {"w" + word}
        if len(d := _digits(word)) >= 7:
            keys.add("d" + d[-7:])
        if "@" in word:
            keys.add("l" + word.split("@", 1)[0])
        for key in keys:
            if (j := last.get(key)) is not None:
                skip.append((j, i))
            last[key] = i
    return np.stack([chain, chain + 1], 1), np.array(sorted(set(skip)), np.int64).reshape(-1, 2), shapes


def clamp(at: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Label of each token under a base span, else -1."""
    out = np.full(len(at), -1)
    starts, ends = np.array([a for a, _ in at]), np.array([b for _, b in at])
    for start, kind, end in sorted(spans, key=lambda s: -s[1]):
        out[np.searchsorted(ends, start, "right") : np.searchsorted(starts, end, "left")] = kind + 1
    return out


def beliefs(unary: np.ndarray, edges: np.ndarray, tables: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Sum-product beliefs. ``edges``: (from, to, table); ``tables``: positive potentials, [table, from label, to label]."""
    if not len(edges):
        return unary / unary.sum(1, keepdims=True)
    source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
    n = len(edges)
    potential = np.concatenate([tables[edges[:, 2]], tables[edges[:, 2]].transpose(0, 2, 1)])
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    log_unary, message = np.log(unary), np.zeros((2 * n, unary.shape[1]))
    for _ in range(rounds):
        total = log_unary.copy()
        np.add.at(total, target, message)
        out = total[source] - message[back]
        out = np.exp(out - out.max(1, keepdims=True))
        out = np.log(np.einsum("es,est->et", out, potential) + 1e-12)
        out -= out.max(1, keepdims=True)
        message = 0.5 * message + 0.5 * out
    total = log_unary.copy()
    np.add.at(total, target, message)
    total = np.exp(total - total.max(1, keepdims=True))
    return total / total.sum(1, keepdims=True)


class Field:
    """Potentials from counts: unary[shape, label], chain[label, label], skip[label, label]."""

    def __init__(self, counts: np.ndarray):
        unary = counts[: SHAPES * LABELS].reshape(SHAPES, LABELS) + 0.0
        chain = counts[SHAPES * LABELS : SHAPES * LABELS + LABELS**2].reshape(LABELS, LABELS)
        skip = counts[SHAPES * LABELS + LABELS**2 :].reshape(LABELS, LABELS)
        self.unary = (unary + np.array([0.5] + [0.05] * len(KINDS))) / (unary.sum(1, keepdims=True) + 0.7)
        self.tables = np.stack([self._ratio(chain, 0.5), self._ratio(skip + skip.T, 0.5) * (1 + 3 * np.eye(LABELS))])

    @staticmethod
    def _ratio(pairs: np.ndarray, prior: float) -> np.ndarray:
        """How much likelier a pair of labels is than by chance, within bounds."""
        p = pairs + prior
        p = p / p.sum()
        return np.clip(p / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)), 0.05, 20)


COUNTS = SHAPES * LABELS + 2 * LABELS**2


def _counts(texts: list[str]) -> np.ndarray:
    out = np.zeros(COUNTS, np.int64)
    for text in texts:
        if not text:
            continue
        spans = base_spans(text)
        at, place = nodes(text, spans)
        if not at:
            continue
        label = np.maximum(clamp(at, spans), 0)
        chain, skip, shapes = graph(text, at, place)
        np.add.at(out, np.array(shapes) * LABELS + label, 1)
        np.add.at(out, SHAPES * LABELS + label[chain[:, 0]] * LABELS + label[chain[:, 1]], 1)
        np.add.at(out, SHAPES * LABELS + LABELS**2 + label[skip[:, 0]] * LABELS + label[skip[:, 1]], 1)
    return out


def train(df: DataFrame, text: str) -> np.ndarray:
    """Counts over every text, summed by Spark; at most ``COUNTS`` rows come back."""

    def run(batches):
        total = np.zeros(COUNTS, np.int64)
        for batch in batches:
            for _, texts in slices(batch, "text"):
                total += _counts(texts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    seeds = df.select(F.col(text).alias("text")).where(F.col("text").rlike("[0-9@]"))
    rows = seeds.mapInArrow(run, "at int, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(COUNTS, np.int64)
    for r in rows:
        out[r["at"]] = r["n"]
    return out


def find(texts: list[str], field: Field, least: float) -> list[list[tuple[int, int, int, bool, float]]]:
    """(start, kind number, end, base, belief) of all spans of each text; one graph for the slice."""
    result: list[list] = []
    unary, edges, owner, spots, forced = [], [], [], [], []
    n = 0
    for i, text in enumerate(texts):
        result.append([])
        if not text:
            continue
        spans = base_spans(text)
        result[-1] = [(s, k, e, True, 1.0) for s, k, e in spans]
        at, place = nodes(text, spans)
        if not at:
            continue
        fixed = clamp(at, spans)
        chain, skip, shapes = graph(text, at, place)
        u = field.unary[shapes].copy()
        held = np.flatnonzero(fixed >= 0)
        u[held] = 1e-9
        u[held, fixed[held]] = 1.0
        unary.append(u)
        for pairs, table in ((chain, 0), (skip, 1)):
            edges.append(np.column_stack([pairs + n, np.full(len(pairs), table)]))
        n += len(at)
        owner += [i] * len(at)
        spots += [(a, b, p) for (a, b), p in zip(at, place.tolist())]
        forced.append(fixed >= 0)
    if not n:
        return result
    belief = beliefs(np.concatenate(unary), np.concatenate(edges).astype(np.int64), field.tables)
    label = belief.argmax(1)
    free = ~np.concatenate(forced)
    hit = np.flatnonzero(free & (label > 0) & (belief.max(1) >= least))
    before = None
    for j in hit.tolist():
        i, (a, b, place), text = owner[j], spots[j], texts[owner[j]]
        while a < b and text[a] in _EDGE and text[a] != "(":
            a += 1
        while b > a and text[b - 1] in _EDGE and text[b - 1] != ")":
            b -= 1
        if not any(c.isdigit() or c == "@" for c in text[a:b]):
            continue
        if before == (i, place - 1, label[j]):
            start, kind, _, _, p = result[i][-1]
            result[i][-1] = (start, kind, b, False, min(p, float(belief[j].max())))
        else:
            result[i].append((a, int(label[j]) - 1, b, False, float(belief[j].max())))
        before = (i, place, label[j])
    return [sorted(x) for x in result]


def detect(df: DataFrame, text: str, field: Field, least: float = 0.5) -> DataFrame:
    """Adds ``spans`` (kind, start, end, base, belief), by start, then kind as in ``KINDS``."""
    name, seed = spare(df.columns, "spans", "seed")
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(SPAN), False)])
    kind = pa.array(KINDS)

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, seed):
                found = find(texts, field, least)
                flat = [s for x in found for s in x]
                off = np.concatenate([[0], np.cumsum([len(x) for x in found])])
                columns = list(zip(*flat)) if flat else [[], [], [], [], []]
                values = pa.StructArray.from_arrays(
                    [
                        kind.take(pa.array(columns[1], pa.int64())), pa.array(columns[0], pa.int64()), pa.array(columns[2], pa.int64()),
                        pa.array(columns[3], pa.bool_()), pa.array(columns[4], pa.float64()),
                    ],
                    names=["kind", "start", "end", "base", "belief"],
                )
                kept = [c for c, f in zip(part.columns, part.schema.names) if f != seed]
                yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(off, pa.int32()), values)], [*(f for f in part.schema.names if f != seed), name])

    # texts without a digit or @ do not travel twice
    return df.withColumn(seed, F.when(F.col(text).rlike("[0-9@]"), F.col(text))).mapInArrow(run, schema)
