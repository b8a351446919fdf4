"""Near-duplicate classes of documents by ProbMinHash, banding and verification.

Shingles are runs of five words (a shorter text is one shingle), weighted by the number of their occurrences in the
text. A signature has ``SIZE`` registers. Every shingle sends arrivals of a Poisson process whose rate is its weight,
each to a random register; a register keeps the element of its earliest arrival, and a shingle stops once its next
arrival is later than the latest register of its text. Two registers agree with the probability Jaccard similarity of
the weighted shingles: of texts without repeated shingles the Jaccard similarity of their sets; a text and the same text
twice over are alike, as their shares of shingles are.

Equal texts are one text from the start. Bands of ``ROWS`` registers are buckets. In a bucket, signatures estimate the
similarities; a spanning forest of the likeliest pairs is verified first: the probability Jaccard similarity of the
weighted shingles, computed from 32-bit hashes of them (two of a text's shingles fall together with a chance of 2**-32),
must reach ``least``. Then, in the buckets whose members are not yet one class, every pair across classes with an
estimate of ``least - SLACK`` or more is verified in place, and only links leave the task. Links make classes. A group of
near copies so sends on a forest, not its pairs; large buckets are cut into blocks of ``BLOCK`` members, and every two
blocks meet.

Null and empty texts: without shingles, alike only when equal (null counts as empty). Rows that repeat id and text are
in one class. A class is named by its least id; rows of null id take the name of their class, or null if it has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from risewatch.llm.common import hash_words, mix, shingles, slices, spare, stored

SIZE, ROWS = 96, 4
BANDS = SIZE // ROWS
#: A pair of similarity 0.8 has 54 agreeing registers of 96 but for a probability of 4e-8.
SLACK = 0.23
BLOCK = 1024
WIDTH = 5
#: Rows of ids that are broadcast at most; more are joined by a shuffle.
FEW = 500_000


def sets(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of the texts, their counts, and the offsets of the texts."""
    flat, off = hash_words([t.split() for t in texts])
    size = np.diff(off)
    own = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(flat)) - off[:-1][own]
    keep = (place >= WIDTH - 1) | ((size[own] < WIDTH) & (place == size[own] - 1))
    grams, own = shingles(flat, off, WIDTH)[keep], own[keep]
    order = np.lexsort((grams, own))
    grams, own = grams[order], own[order]
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(first)
    return grams[at], np.diff(np.append(at, len(grams))), np.searchsorted(own[at], np.arange(len(size) + 1))


def signatures(grams: np.ndarray, weight: np.ndarray, off: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Elements kept by the registers, [text, register]; zero for a text without shingles."""
    n = len(off) - 1
    least, who = np.full(n * size, np.inf), np.zeros(n * size, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(off))
    gram, rate, time, turn = grams, 1.0 / weight, np.zeros(len(grams)), 0
    limit = np.full(n, np.inf)
    while len(gram):
        arrivals = 1 if len(gram) > 20_000 else 4 if len(gram) > 2_000 else 32
        turns = np.arange(turn + 1, turn + arrivals + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        draw = mix(gram[:, None] + turns[None, :])
        gap = -np.log1p(-(draw >> np.uint64(11)).astype(np.float64) * 2.0**-53) * rate[:, None]
        times = time[:, None] + np.cumsum(gap, axis=1)
        slot = (doc[:, None] * size + (mix(draw ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(size)).astype(np.int64)).ravel()
        when = times.ravel()
        live = when < np.repeat(limit[doc], arrivals)
        slot, when, element = slot[live], when[live], np.repeat(gram, arrivals)[live]
        np.minimum.at(least, slot, when)
        best = when == least[slot]
        who[slot[best]] = element[best]
        limit = least.reshape(n, size).max(axis=1)
        turn, time = turn + arrivals, times[:, -1]
        go = time < limit[doc]
        gram, rate, time, doc = gram[go], rate[go], time[go], doc[go]
    return who.reshape(n, size)


def sketch(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, h1, h2, signature bytes, bands) of every row."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch, "text"):
                grams, count, off = sets(texts)
                who = signatures(grams, count.astype(float), off)
                some = np.diff(off) > 0
                band = np.zeros((len(texts), BANDS), np.uint64)
                for r in range(ROWS):
                    band = mix(band * np.uint64(31) + who[:, r::ROWS])
                band[some] += np.arange(BANDS, dtype=np.uint64)[None, :]
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some * BANDS)]), pa.int32()), pa.array(band[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array([x.tobytes() for x in (who % np.uint64(251)).astype(np.uint8)], pa.binary()), bands],
                    ["id", "h1", "h2", "signature", "bands"],
                )

    rows = keyed(docs, doc_id, text)
    return rows.select("id", "h1", "h2", "text").mapInArrow(run, "id bigint, h1 bigint, h2 bigint, signature binary, bands array<bigint>")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, text, h1, h2): the hashes name a text by 128 bits."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("bigint").alias("id"), body.alias("text"), F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(7), body).alias("h2"))


def groups(batches, key: str = "bucket"):
    """Tables of rows of whole groups, from batches sorted by ``key``, with the groups' bounds."""
    held: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        keys = table.column(key).to_numpy()
        last = int(np.searchsorted(keys, keys[-1], "left")) if (keys[:-1] <= keys[1:]).all() else int(np.flatnonzero(keys != keys[-1]).max(initial=-1)) + 1
        if held and keys[0] != held[-1].column(key)[0].as_py():
            yield from _cut(pa.concat_tables(held), key)
            held = []
        if last:
            yield from _cut(pa.concat_tables([*held, table.slice(0, last)]), key)
            held = []
        held.append(table.slice(last))
    if held:
        yield from _cut(pa.concat_tables(held), key)


def _cut(table: pa.Table, key: str):
    keys = table.column(key).to_numpy()
    yield table, [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]


def _estimates(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    out = np.zeros((len(left), len(right)), np.int16)
    for r in range(left.shape[1]):
        out += left[:, r][:, None] == right[:, r][None, :]
    return out


class _Trees:
    def __init__(self, n: int):
        self.root = list(range(n))

    def find(self, x: int) -> int:
        while self.root[x] != x:
            self.root[x] = self.root[self.root[x]]
            x = self.root[x]
        return x


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs, in the order given, that join two trees."""
    trees, kept = _Trees(n), []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = trees.find(x), trees.find(y)
        if x != y:
            trees.root[x] = y
            kept.append(i)
            if len(kept) == n - 1:
                break
    return np.array(kept, np.int64)


def _likely(signature: np.ndarray, side: np.ndarray, group: np.ndarray | None, least: int) -> np.ndarray:
    """(row, row, agreeing registers) of a bucket's pairs that may be links, likeliest first; with ``group`` only across groups."""
    same_block = side.min() == side.max()
    left, right = (np.arange(len(side)),) * 2 if same_block else (np.flatnonzero(side == side.min()), np.flatnonzero(side != side.min()))
    step = max(1, (1 << 20) // max(1, len(right)))
    found = [np.zeros((3, 0), np.int64)]
    for i in range(0, len(left), step):
        rows = left[i : i + step]
        close = _estimates(signature[rows], signature[right])
        likely = close >= least
        if same_block:
            likely &= rows[:, None] < right[None, :]
        if group is not None:
            likely &= group[rows][:, None] != group[right][None, :]
        x, y = np.nonzero(likely)
        found.append(np.stack([rows[x], right[y], close[x, y]]))
    pairs = np.concatenate(found, axis=1)
    return pairs[:, np.argsort(-pairs[2], kind="stable")]


def probability_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Probability Jaccard similarity of two bags (sorted, with repeats): over common elements i, the sum of
    1 / sum over all j of max(x_j / x_i, y_j / y_i). In the order of x_j / y_j both kinds of maxima are running sums."""
    (u, m), (v, n) = np.unique(x, return_counts=True), np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    a, b = m[i].astype(float), n[j].astype(float)
    order = np.argsort(a / b, kind="stable")
    a, b = a[order], b[order]
    at = np.searchsorted(a / b, a / b, "left")
    before_a, before_b = np.concatenate([[0], np.cumsum(a)]), np.concatenate([[0], np.cumsum(b)])
    return float((1 / ((len(x) - before_a[at]) / a + (len(y) - before_b[-1] + before_b[at]) / b)).sum())


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two bags (sorted, with repeats) have a probability Jaccard similarity of ``least``."""
    if (x[1:] == x[:-1]).any() or (y[1:] == y[:-1]).any():
        return probability_jaccard(x, y) >= least - 1e-9
    # without repeats it is the Jaccard similarity of the sets
    if min(len(x), len(y)) < least * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common >= least * (len(both) - common) - 1e-9


def _dealt(members: DataFrame, columns: list[str]) -> DataFrame:
    """Members of buckets (bucket, uid, size, ...) in blocks: a hot bucket is many groups of bounded size."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
    own = F.pmod(F.col("uid"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    rows = members.withColumn("blocks", blocks).withColumn("meet", F.explode(pairs)).withColumn("side", own)
    rows = rows.withColumn("bucket", F.when(F.col("blocks") == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", "meet.i", "meet.j")))
    return rows.select("bucket", "uid", "side", *columns).repartition("bucket").sortWithinPartitions("bucket")


def _pairs_out(a: list, b: list) -> pa.RecordBatch:
    x, y = np.concatenate([np.zeros(0, np.int64), *a]), np.concatenate([np.zeros(0, np.int64), *b])
    both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
    return pa.RecordBatch.from_pydict({"a": pa.array(both[0], pa.int64()), "b": pa.array(both[1], pa.int64())})


def forests(members: DataFrame, least: float) -> DataFrame:
    """Distinct (a, b): in each bucket a spanning forest of the likeliest pairs."""
    floor = int(np.floor((least - SLACK) * SIZE))

    def run(batches):
        for table, bounds in groups(batches):
            uid, side = table.column("uid").to_numpy(), table.column("side").to_numpy()
            signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, SIZE)
            a, b = [], []
            for lo, hi in zip(bounds, bounds[1:]):
                if hi - lo == 2:  # the usual bucket
                    if (signature[lo] == signature[lo + 1]).sum() >= floor:
                        a.append(uid[lo : lo + 1]), b.append(uid[lo + 1 : hi])
                elif hi - lo > 2:
                    x, y, _ = _likely(signature[lo:hi], side[lo:hi], None, floor)
                    kept = _forest(hi - lo, x, y)
                    a.append(uid[lo + x[kept]]), b.append(uid[lo + y[kept]])
            yield _pairs_out(a, b)

    return _dealt(members, ["signature"]).mapInArrow(run, "a bigint, b bigint").distinct()


def links_across(members: DataFrame, least: float) -> DataFrame:
    """Distinct (a, b) that join classes: in each bucket every likely pair across classes is verified in place, in the
    order of its estimate, unless links found before have joined the two classes."""
    floor = int(np.floor((least - SLACK) * SIZE))

    def run(batches):
        for table, bounds in groups(batches):
            uid, side, group = (table.column(c).to_numpy() for c in ("uid", "side", "class"))
            signature = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(-1, SIZE)
            sets_ = [np.frombuffer(x, np.uint32) for x in table.column("grams").to_pylist()]
            a, b = [], []
            for lo, hi in zip(bounds, bounds[1:]):
                if hi - lo < 2 or (group[lo:hi] == group[lo]).all():
                    continue
                number = np.unique(group[lo:hi], return_inverse=True)[1]
                trees = _Trees(int(number.max()) + 1)
                x, y, _ = _likely(signature[lo:hi], side[lo:hi], number, floor)
                for i, j in zip(x.tolist(), y.tolist()):
                    p, q = trees.find(int(number[i])), trees.find(int(number[j]))
                    if p != q and _alike(sets_[lo + i], sets_[lo + j], least):
                        trees.root[p] = q
                        a.append(uid[lo + i : lo + i + 1]), b.append(uid[lo + j : lo + j + 1])
            yield _pairs_out(a, b)

    return _dealt(members, ["signature", "class", "grams"]).mapInArrow(run, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Pairs whose shingles have a probability Jaccard similarity of ``least``; ``texts`` has (uid, grams)."""
    left = texts.select(F.col("uid").alias("a"), F.col("grams").alias("left"))
    right = texts.select(F.col("uid").alias("b"), F.col("grams").alias("right"))

    def run(batches):
        for batch in batches:
            sets_ = zip(batch.column("left").to_pylist(), batch.column("right").to_pylist())
            keep = [_alike(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) for x, y in sets_]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(uid, class): the least uid of each connected component, by least labels and two pointer jumps a round."""
    edges = stored(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("uid")).agg(F.least(F.first("a"), F.min("b")).alias("class")), "labels")
    while True:
        near = edges.join(labels.select(F.col("uid").alias("b"), "class"), "b").groupBy(F.col("a").alias("uid")).agg(F.min("class").alias("near"))
        step = labels.join(near, "uid").select("uid", F.col("class").alias("old"), F.least("class", "near").alias("class"))
        for _ in range(2):
            step = step.join(labels.select(F.col("uid").alias("class"), F.col("class").alias("far")), "class").select("uid", "old", F.col("far").alias("class"))
        step = stored(step, "labels")
        if step.where("old != class").isEmpty():
            return labels
        labels = step.select("uid", "class")


def classes(docs: DataFrame, doc_id: str, text: str, least: float = 0.8) -> DataFrame:
    """(id, h1, h2, class_id, first) of every row; ``first``: whether the row's id and text stand for the class."""
    spark = docs.sparkSession
    rows = stored(sketch(docs, doc_id, text), "minhash")
    # equal texts become one, partly before they are dealt
    distinct = rows.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.first("signature").alias("signature"), F.first("bands").alias("bands"))
    texts = stored(distinct.withColumn("uid", F.monotonically_increasing_id()), "texts")
    entries = texts.select("uid", F.explode("bands").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = stored(entries.join(sizes, "bucket"), "buckets")
    members = shared.join(texts.select("uid", "signature"), "uid")
    pairs = stored(forests(members, least), "pairs")

    # shingles, with repeats, of the texts that are in a bucket at all
    wanted = shared.select("uid").distinct().join(texts.select("uid", "h1", "h2", "id"), "uid").select("uid", "h1", "h2", F.coalesce("id", "h1").alias("at"))
    few = wanted.count() <= FEW
    body = keyed(docs, doc_id, text).withColumn("at", F.coalesce("id", "h1")).join(F.broadcast(wanted) if few else wanted, ["at", "h1", "h2"])

    def grams(batches):
        for batch in batches:
            for part, found in slices(batch, "text"):
                flat, count, off = sets(found)
                short = (flat >> np.uint64(32)).astype(np.uint32)
                # the order of the short hashes is that of the long ones
                bags = [np.repeat(short[a:b], count[a:b]).tobytes() for a, b in zip(off, off[1:])]
                yield pa.RecordBatch.from_pydict({"uid": part.column(0), "grams": pa.array(bags, pa.binary())})

    shingled = stored(body.select("uid", "text").mapInArrow(grams, "uid bigint, grams binary").dropDuplicates(["uid"]), "shingles")
    links = stored(verified(pairs, shingled, least), "links")
    first = components(links)
    # buckets that still hold several classes: every likely pair across them
    known = shared.join(first, "uid", "left").withColumn("class", F.coalesce("class", "uid"))
    open_ = known.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x != y").select("bucket")
    rest = known.join(open_, "bucket").join(texts.select("uid", "signature"), "uid").join(shingled, "uid")
    extra = stored(links_across(rest, least), "links")
    named = texts.select("uid", "h1", "h2", "id").join(first, "uid", "left").withColumn("class", F.coalesce("class", "uid"))
    if not extra.isEmpty():  # the classes that late links join
        of = known.select("uid", "class").distinct()
        late = extra.join(of.toDF("a", "x"), "a").join(of.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        joined = components(late).toDF("class", "whole")
        named = named.join(joined, "class", "left").withColumn("class", F.coalesce("whole", "class")).drop("whole")
    named = stored(named, "named")
    heads = named.groupBy("class").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "h1", "h2")).alias("head"))
    named = named.join(heads, "class").select("h1", "h2", F.col("head.id").alias("class_id"), ((F.col("head.h1") == F.col("h1")) & (F.col("head.h2") == F.col("h2"))).alias("leads"), "id")
    out = rows.select("id", "h1", "h2").join(named.withColumnRenamed("id", "least_id"), ["h1", "h2"])
    return out.select("id", "h1", "h2", "class_id", (F.col("leads") & F.col("id").eqNullSafe(F.col("least_id"))).alias("first"))


def keep_first(docs: DataFrame, doc_id: str, text: str, least: float = 0.8) -> DataFrame:
    """One row of each class: that of the least id; a class without ids keeps one of its rows."""
    found = stored(classes(docs, doc_id, text, least), "classes")
    body = F.coalesce(F.col(text), F.lit(""))
    at, x, y = spare(docs.columns, "at", "x", "y")
    losers = found.where(~F.col("first")).select(F.coalesce("id", "h1").alias(at), F.col("h1").alias(x), F.col("h2").alias(y)).distinct()
    few = losers.count() <= FEW
    own = F.coalesce(F.col(doc_id).cast("bigint"), F.xxhash64(body))
    same = (own == F.col(at)) & (F.xxhash64(body) == F.col(x)) & (F.xxhash64(F.lit(7), body) == F.col(y))
    out = docs.join(F.broadcast(losers) if few else losers, same, "left_anti")
    again = found.where("first").groupBy("id", "h1", "h2").count().where("count > 1")
    return out if again.isEmpty() else out.dropDuplicates([doc_id, text])
