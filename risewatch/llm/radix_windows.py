"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id.

The suffixes are ordered only as far as ``LENGTH`` bytes, by radix passes on their most significant digits; after the
last pass, equal groups are exactly the repeated windows. Not every suffix enters: a window is entered by its first
anchor. Anchors are the places whose ``GRAM`` bytes have their least ``PART``-byte piece first or last (closed
syncmers), a property of these bytes alone; every window holds one, and equal windows hold the same one at the same
place. The first pass deals the grams of all anchors by their leading digit and drops those found in one document only,
which most are. The second deals the rest by gram together with the bytes around it, up to the last anchor before and
the window's end after, and orders every window of a gram by all its bytes: a window is a repeat if its group has a
smaller id.

Digits are dealt as packed numpy arrays, one for each digit and batch of documents; documents are dealt to batches once.
Equal texts are found before: all but the least id are repeats as a whole and enter nothing. Within a batch, places with
equal surroundings enter once, with the least id, so that hot passages and large groups of copies do not meet in a task.

Null texts are empty. Documents of null id are after all others, and not smaller than each other. Rows that repeat id
and text are one document and get equal results; rows that repeat only the id are not smaller than each other. Matches
never cross documents. Overlapping windows count, also with themselves; strings are judged on the input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risewatch.llm.common import mix, total_bytes
from risewatch.llm.prob_minhash import groups

LENGTH, GRAM, PART = 50, 29, 8
#: Bytes that a window has around its gram.
AROUND = LENGTH - GRAM
#: Grams of one leading digit: what a task of the first pass sorts at once.
DIGIT_GRAMS = 2_000_000
LOW = np.uint64((1 << 40) - 1)
LAST = np.int64(2**63 - 1)
STEP = 1 << 19


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number."""
    v = data.astype(np.uint64)
    for width in (1, 2, 4):
        v = (v[:-width] << np.uint64(8 * width)) | v[width:]
    return v


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat places and gram hashes of the anchors of the documents ``data[off[i]:off[i+1]]``."""
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo in range(0, max(0, len(data) - GRAM + 1), STEP):
        piece = data[lo : lo + STEP + GRAM - 1]
        words = _eight(piece)
        h = mix(words)
        n = len(piece) - GRAM + 1
        span = GRAM - PART  # parts in a gram, less one
        low, width = h, 1
        while 2 * width <= span + 1:
            low, width = np.minimum(low[:-width], low[width:]), 2 * width
        low = np.minimum(low[:n], low[span + 1 - width : span + 1 - width + n])
        at = np.flatnonzero((h[:n] == low) | (h[span : span + n] == low))
        g = mix(words[at])
        for shift in (8, 16, GRAM - 8):
            g = mix(g + words[at + shift])
        places.append(at + lo), hashes.append(g)
    at, g = np.concatenate(places), np.concatenate(hashes)
    doc = np.searchsorted(off, at, "right") - 1
    inside = at + GRAM <= off[doc + 1]
    return at[inside], g[inside]


class Batch:
    """The documents of a batch by id, then hash, repeats of a row once, without those that are equal to an earlier text."""

    def __init__(self, table: pa.Table, copies: set[tuple]):
        order = table.select(["id_order", "h1"]).to_pandas().sort_values(["id_order", "h1"], kind="stable").index.to_numpy()
        self.table = table.take(pa.array(order))
        ids, h1 = self.table.column("id_order").to_numpy(), self.table.column("h1").to_numpy()
        fresh = np.ones(len(ids), bool)
        fresh[1:] = (ids[1:] != ids[:-1]) | (h1[1:] != h1[:-1])
        self.copy = np.array([k in copies for k in zip(ids.tolist(), h1.tolist())], bool)
        self.same_as = np.maximum.accumulate(np.where(fresh, np.arange(len(ids)), 0))
        self.enter = fresh & ~self.copy
        self.ids = ids
        text = self.table.column("text").combine_chunks().cast(pa.binary())
        text = text if isinstance(text, pa.Array) else text.chunk(0)
        self.text = text
        sizes = pa.compute.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        self.size = sizes
        self.docs = np.flatnonzero(self.enter)
        self.data = np.frombuffer(b"".join(text.filter(pa.array(self.enter)).to_pylist()), np.uint8)
        self.off = np.concatenate([[0], np.cumsum(sizes[self.enter])])

    def grams(self):
        """(places, hashes, documents, sorted distinct hashes, hash number of each place)."""
        at, g = anchors(self.data, self.off)
        doc = np.searchsorted(self.off, at, "right") - 1
        distinct, number = np.unique(g, return_inverse=True)
        return at, g, doc, distinct, number


def _pack40(values: np.ndarray) -> bytes:
    return (values & LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack40(blob: bytes) -> np.ndarray:
    low = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return np.pad(low, ((0, 0), (0, 3))).reshape(-1).view("<u8")


def _parts(mail: pa.Table, kind: str) -> pa.Table:
    return mail.filter(pa.compute.equal(mail.column("kind"), kind))


def _copies(mail: pa.Table) -> set[tuple]:
    rows = _parts(mail, "copy")
    return set(zip(rows.column("id_order").to_pylist(), rows.column("h1").to_pylist()))


MAIL = "batch int, kind string, id_order bigint, h1 bigint, digit int, payload binary"


def _mail(batch, kind, digit, payload) -> pa.Table:
    n = len(payload)
    return pa.table(
        {
            "batch": pa.array(np.broadcast_to(batch, n), pa.int32()), "kind": pa.array([kind] * n, pa.string()), "id_order": pa.nulls(n, pa.int64()),
            "h1": pa.nulls(n, pa.int64()), "digit": pa.array(digit, pa.int32()), "payload": pa.array(payload, pa.binary()),
        }
    )


def _first_pass(bits: int):
    """Grams of a batch, dealt by leading digit: distinct ones in order, marked if two documents of the batch have them."""

    def run(table: pa.Table, mail: pa.Table) -> pa.Table:
        own = Batch(table, _copies(mail))
        at, g, doc, distinct, number = own.grams()
        low = np.full(len(distinct), len(own.off), np.int64)
        high = np.full(len(distinct), -1, np.int64)
        np.minimum.at(low, number, doc)
        np.maximum.at(high, number, doc)
        digit = (distinct >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(digit)) + 1, [len(digit)]]) if len(digit) else np.zeros(1, np.int64)
        payload = [_pack40(distinct[a:b]) + np.packbits(low[a:b] != high[a:b]).tobytes() for a, b in zip(cuts, cuts[1:])]
        return _mail(table.column("batch")[0].as_py(), "grams", digit[cuts[:-1]] if len(digit) else [], payload)

    return run


def _repeated(batches):
    """Of the grams of a digit: which are in two documents, as bits for each batch."""
    for table, bounds in groups(batches, "digit"):
        for lo, hi in zip(bounds, bounds[1:]):
            rows = table.slice(lo, hi - lo)
            values, marks = [], []
            for blob in rows.column("payload").to_pylist():
                n = len(blob) * 8 // 41  # five bytes and a bit each
                values.append(_unpack40(blob[: 5 * n]))
                marks.append(np.unpackbits(np.frombuffer(blob[5 * n :], np.uint8), count=n).astype(bool))
            size = [len(v) for v in values]
            flat = np.concatenate(values)
            order = np.argsort(flat, kind="stable")
            ordered = flat[order]
            twice = np.zeros(len(flat), bool)
            equal = ordered[1:] == ordered[:-1]
            twice[1:] |= equal
            twice[:-1] |= equal
            keep = np.concatenate(marks)
            keep[order] |= twice
            payload = [np.packbits(x).tobytes() for x in np.split(keep, np.cumsum(size)[:-1])]
            yield from _mail(rows.column("batch").to_numpy(), "bits", rows.column("digit").to_numpy(), payload).to_batches()


def _columns(n: int, *arrays: np.ndarray) -> bytes:
    """Number of rows, then the columns one after the other: what compresses best."""
    return np.int64(n).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _second_pass(bits: int):
    """Entries of the batch's repeated grams: gram, place and the bytes around, dealt by leading digit."""

    def run(table: pa.Table, mail: pa.Table) -> pa.Table:
        batch = table.column("batch")[0].as_py()
        own = Batch(table, _copies(mail))
        at, g, doc, distinct, number = own.grams()
        alive = np.zeros(len(distinct), bool)
        digit = (distinct >> np.uint64(64 - bits)).astype(np.int64)
        answers = _parts(mail, "bits")
        for d, blob in zip(answers.column("digit").to_pylist(), answers.column("payload").to_pylist()):
            a, b = np.searchsorted(digit, [d, d + 1])
            alive[a:b] = np.unpackbits(np.frombuffer(blob, np.uint8), count=int(b - a)).astype(bool)
        live = alive[number]
        start, end = own.off[doc], own.off[doc + 1]
        # a window belongs to its first anchor, so it starts after the anchor before; it holds no anchor that is alone
        before = np.maximum(start, np.concatenate([[-1], at[:-1]]) + 1)
        alone = np.where(live, LAST, at)
        after = np.concatenate([np.minimum.accumulate(alone[::-1])[::-1][1:], [LAST]]) if len(at) else at
        left = np.minimum(AROUND, at - before)
        right = np.minimum(AROUND, np.minimum(end - at - GRAM, after - at - 1))
        use = np.flatnonzero(live & (left + right >= AROUND))
        if not len(use):
            return _mail(batch, "entries", [], [])
        at, g, doc, left, right = at[use], g[use], doc[use], left[use], right[use]
        around = _around(own.data, at, left, right)
        # equal surroundings: those of larger ids repeat in all their windows, the least id alone is sent on
        key = mix(g + mix(_fold(around)) + (left * 64 + right).astype(np.uint64))
        ids = own.ids[own.docs[doc]]
        order = np.lexsort((ids, key))
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        least = np.empty(len(ids), np.int64)
        least[order] = ids[order][np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))]
        later = ids > least
        spot = own.docs[doc]
        local = (at - own.off[doc]).astype("<u4")
        offsets = np.arange(AROUND + 1)
        fits = (offsets[None, :] <= left[:, None]) & (AROUND - offsets[None, :] <= right[:, None])
        mask = (fits * (1 << offsets)).sum(1)
        out = [_mail(batch, "done", [0], [_columns(int(later.sum()), spot[later].astype("<u4"), local[later], mask[later].astype("<u4"))])] if later.any() else []
        keep = np.flatnonzero(~later)
        keep = keep[np.argsort(g[keep], kind="stable")]
        top = (g[keep] >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(top)) + 1, [len(top)]])
        payload = []
        for a, b in zip(cuts, cuts[1:]):
            k = keep[a:b]
            payload.append(_columns(b - a, g[k].astype("<u8"), ids[k].astype("<i8"), spot[k].astype("<u4"), local[k], left[k].astype(np.uint8), right[k].astype(np.uint8), around[k]))
        return pa.concat_tables([*out, _mail(batch, "entries", top[cuts[:-1]], payload)])

    return run


def _around(data: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bytes before (nearest first) and after the gram, zero beyond ``left`` and ``right``."""
    steps = np.arange(AROUND)
    a = np.where(steps < left[:, None], data[np.maximum(0, at[:, None] - 1 - steps)], 0)
    b = np.where(steps < right[:, None], data[np.minimum(len(data) - 1, at[:, None] + GRAM + steps)], 0)
    return np.concatenate([a, b], axis=1).astype(np.uint8)


def _fold(around: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(around), -(-around.shape[1] // 8) * 8), np.uint8)
    wide[:, : around.shape[1]] = around
    out = np.zeros(len(around), np.uint64)
    for column in wide.view("<u8").T:
        out = mix(out + column)
    return out


def _orders(batches):
    """Of the entries of a digit: for each, the windows that a smaller id has too, as a bit mask by bytes before the gram."""
    for table, bounds in groups(batches, "digit"):
        for lo, hi in zip(bounds, bounds[1:]):
            rows = table.slice(lo, hi - lo)
            done = _parts(rows, "done")
            if done.num_rows:
                yield from done.select(["batch", "kind", "id_order", "h1", "digit", "payload"]).to_batches()
            rows = _parts(rows, "entries")
            if not rows.num_rows:
                continue
            columns, owner = [], []
            for n, blob in enumerate(rows.column("payload").to_pylist()):
                size, at, parts = int(np.frombuffer(blob, "<i8", 1)[0]), 8, []
                for kind in ("<u8", "<i8", "<u4", "<u4", "u1", "u1"):
                    parts.append(np.frombuffer(blob, kind, size, at))
                    at += size * np.dtype(kind).itemsize
                parts.append(np.frombuffer(blob, np.uint8, offset=at).reshape(size, 2 * AROUND))
                columns.append(parts)
                owner.append(np.full(size, n))
            gram, ids, spot, local, left, right, around = (np.concatenate(x) for x in zip(*columns))
            mask = _masks(gram, ids, left, right, around)
            owner, batch = np.concatenate(owner), rows.column("batch").to_numpy()
            hit = np.flatnonzero(mask)
            for n in np.unique(owner[hit]).tolist():
                k = hit[owner[hit] == n] if len(batch) < 8 else hit[np.searchsorted(owner[hit], n) : np.searchsorted(owner[hit], n, "right")]
                yield from _mail(batch[n : n + 1], "done", [0], [_columns(len(k), spot[k], local[k], mask[k].astype("<u4"))]).to_batches()


def _masks(gram, ids, left, right, around) -> np.ndarray:
    # grams that are left in one document only have no repeat
    order = np.argsort(gram, kind="stable")
    g = gram[order]
    new = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    least, most = np.minimum.reduceat(ids[order], new), np.maximum.reduceat(ids[order], new)
    out = np.zeros(len(gram), np.int64)
    some = order[np.repeat(least < most, np.diff(np.append(new, len(g))))]
    if not len(some):
        return out
    gram, ids, left, right, around = gram[some], ids[some], left[some], right[some], around[some]
    n = len(gram)
    before, after = np.zeros((AROUND + 1, n), np.uint64), np.zeros((AROUND + 1, n), np.uint64)
    for j in range(AROUND):
        before[j + 1] = mix(before[j] * np.uint64(0x9E3779B97F4A7C15) + around[:, j] + np.uint64(1))
        after[j + 1] = mix(after[j] * np.uint64(0xD6E8FEB86659FD93) + around[:, AROUND + j] + np.uint64(1))
    mask = np.zeros(n, np.int64)
    for o in range(AROUND + 1):
        fit = np.flatnonzero((left >= o) & (right >= AROUND - o))
        if len(fit) < 2:
            continue
        window = mix(before[o, fit] + np.uint64(0x632BE59BD9B4E019)) ^ after[AROUND - o, fit]
        both = mix(window + gram[fit])
        order = np.argsort(both, kind="stable")
        b, w, g = both[order], window[order], gram[fit][order]
        new = np.flatnonzero(np.concatenate([[True], (b[1:] != b[:-1]) | (w[1:] != w[:-1]) | (g[1:] != g[:-1])]))
        own = ids[fit][order]
        least = np.repeat(np.minimum.reduceat(own, new), np.diff(np.append(new, len(own))))
        mask[fit[order[own > least]]] |= 1 << o
    out[some] = mask
    return out


def _cover(table: pa.Table, mail: pa.Table) -> pa.Table:
    """Every row of a batch with its kept bytes."""
    own = Batch(table, _copies(mail))
    spot, at, mask = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for blob in _parts(mail, "done").column("payload").to_pylist():
        n = int(np.frombuffer(blob, "<i8", 1)[0])
        for to, x in zip((spot, at, mask), np.frombuffer(blob, "<u4", 3 * n, 8).reshape(3, n)):
            to.append(x.astype(np.int64))
    spot, at, mask = np.concatenate(spot), np.concatenate(at), np.concatenate(mask)
    whole = np.concatenate([[0], np.cumsum(own.size)])
    change = np.zeros(whole[-1] + 1, np.int64)
    base = whole[spot] + at
    for o in range(AROUND + 1):
        start = base[(mask >> o) & 1 == 1] - o
        np.add.at(change, start, 1)
        np.add.at(change, start + LENGTH, -1)
    gone = np.cumsum(change[:-1]) > 0
    data = np.frombuffer(b"".join(own.text.to_pylist()), np.uint8)
    for i in np.flatnonzero(own.copy & (own.size >= LENGTH)).tolist():
        gone[whole[i] : whole[i + 1]] = True
    removed, spans, kept = [], [], []
    for i, j in enumerate(own.same_as.tolist()):
        mark = gone[whole[j] : whole[j + 1]]
        removed.append(int(mark.sum()))
        spans.append(int((mark[1:] & ~mark[:-1]).sum()) + int(len(mark) > 0 and mark[0]))
        kept.append(data[whole[i] : whole[i + 1]][~mark].tobytes())
    return pa.table({"id": own.table.column("id"), "n_bytes": pa.array(own.size), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept": pa.array(kept, pa.binary())})


def remove_repeats(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` are the bytes left."""
    total = max(1, total_bytes(docs, text))
    size = int(min(128 << 20, max(1 << 20, 34 * total**0.5)))
    n_batches = max(1, -(-total // size))
    bits = int(min(16, max(6, np.ceil(np.log2(max(1, 2 * total / (GRAM - PART + 1) / DIGIT_GRAMS))))))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), body.alias("text"))
    h1, h2 = F.xxhash64("text"), F.xxhash64(F.lit(7), "text")
    order = F.coalesce("id", F.lit(int(LAST)))
    batch = F.pmod(F.xxhash64("id_order", "h1"), F.lit(n_batches)).cast("int")
    texts = rows.select("id", order.alias("id_order"), h1.alias("h1"), "text").withColumn("batch", batch)
    narrow = rows.select(order.alias("id_order"), h1.alias("h1"), h2.alias("h2"))
    least = narrow.groupBy("h1", "h2").agg(F.min("id_order").alias("least"), F.max("id_order").alias("most")).where("least < most")
    copies = narrow.join(least, ["h1", "h2"]).where("id_order > least").select("id_order", "h1").distinct().withColumn("batch", batch)
    copies = copies.selectExpr("batch", "'copy' AS kind", "id_order", "h1", "CAST(NULL AS int) AS digit", "CAST(NULL AS binary) AS payload")
    dealt = texts.groupBy("batch")
    by_digit = lambda df: df.repartition("digit").sortWithinPartitions("digit")
    grams = dealt.cogroup(copies.groupBy("batch")).applyInArrow(_first_pass(bits), MAIL)
    alive = by_digit(grams).mapInArrow(_repeated, MAIL)
    entries = dealt.cogroup(alive.unionByName(copies).groupBy("batch")).applyInArrow(_second_pass(bits), MAIL)
    done = by_digit(entries).mapInArrow(_orders, MAIL)
    return dealt.cogroup(done.unionByName(copies).groupBy("batch")).applyInArrow(_cover, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
