"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a text, all per word or per character: density and number of lexicon words, learned and fixed, alone and
near a second person pronoun; share of capitals; punctuation marks; marks that stand for letters inside words
(obfuscation); length. The lexicon is the fixed list below plus what labelled texts teach: words and word beginnings,
said once, twice or three times, that are much likelier in toxic texts. Labelled rows are dealt to three disjoint parts by their id's checksum: lexicon,
trees, calibration, so that no part is fitted on what another part has memorised. Labels, language, source and id are
never features.

Each part is a bounded sample (``per_part`` documents, by the order of a hash of the text, so that equal rows give
equal models); scoring covers every whole text. Equal texts count once in each part. Labels that disagree, of one id or
of equal texts, become the commoner one, toxic if both are as common.

The trees are fitted by ``pyspark.ml`` and walked as flat arrays, so that a scoring task has one Python worker and takes
its texts a megabyte at a time.

Null and empty texts are scored by their features, all zero. Without labels of both kinds in the first two parts the
score is the share of toxic labels (0 if there are none). Repeated rows get equal scores. Extra columns stay.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risewatch.llm.common import map_texts, slices, spare, stored

#: Documents of each of the three training parts at most.
PER_PART = 6000
#: Word beginnings that may enter the lexicon.
STEMS = (4, 5, 6)
#: Entries of the learned lexicon at most: the likeliest.
LEXICON = 4000
#: Partial counts that a task holds before it passes them on, and words whose terms a task remembers.
TERMS, REMEMBERED = 100_000, 50_000

# Common insults, and second person pronouns.
INSULTS = "idiot idiots stupid moron morons pathetic worthless loser losers scum trash clown disgusting dumb fool garbage jerk ugly hate shut dummkopf trottel arschloch imbécile crétin connard idiota estúpido imbécil basura".split()
SECOND = "you your yours yourself u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros".split()

_WORD = re.compile(r"[^\W_]+(?:[*@$!'’][^\W_]+)*")
_MASKED = re.compile(r"[^\W_][*@$!#%&]+[^\W_]|(?<=[^\W\d_])[0-9]+(?=[^\W\d_])")
_PLAIN = str.maketrans({"@": "a", "$": "s", "!": "i", "*": None, "0": "o", "1": "i", "3": "e", "4": "a", "5": "s"})
FEATURES = ["lex", "lex_n", "lex_top", "stem", "stem_n", "stem_top", "fixed", "fixed_n", "near_you", "you", "capitals", "marks", "loud", "masked", "log_words"]


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Trees:
    """Boosted trees as flat arrays, so that a task needs nothing but numpy to walk them. A leaf points to itself."""

    weights: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    @classmethod
    def of(cls, model: GBTClassificationModel) -> Trees:
        flat, depth = [], 0
        for tree in model.trees:
            nodes: list[tuple] = []

            def add(node, nodes=nodes) -> int:
                at = len(nodes)
                nodes.append((0, np.inf, at, at, node.prediction()))
                if node.subtreeDepth() > 0:
                    split = node.split()
                    nodes[at] = (split.featureIndex(), split.threshold(), add(node.leftChild()), add(node.rightChild()), 0.0)
                return at

            add(tree._call_java("rootNode"))
            flat.append(nodes)
            depth = max(depth, tree.depth)
        size = max(map(len, flat))
        column = lambda k, kind: np.array([[n[k] for n in t] + [0] * (size - len(t)) for t in flat], kind)
        return cls(np.array(model.treeWeights), column(0, int), column(1, float), column(2, int), column(3, int), column(4, float), depth)

    def margins(self, rows: np.ndarray) -> np.ndarray:
        out, each = np.zeros(len(rows)), np.arange(len(rows))
        for t, weight in enumerate(self.weights):
            at = np.zeros(len(rows), int)
            for _ in range(self.depth):
                at = np.where(rows[each, self.feature[t, at]] <= self.threshold[t, at], self.left[t, at], self.right[t, at])
            out += weight * self.value[t, at]
        return out


@dataclass
class Model:
    lexicon: dict[str, list[float]]
    trees: Trees | None
    knots: tuple[list[float], list[float]]
    prior: float


def terms_of(found: list[str]) -> dict[str, int]:
    """How often a text says each word, and each beginning (marked by a leading tab)."""
    said = Counter(found)
    stems: dict[str, int] = {}
    for w, n in said.items():
        for size in STEMS:
            if len(w) > size:
                key = "\t" + w[:size]
                stems[key] = stems.get(key, 0) + n
    return said | stems


def feature_rows(texts: list[str | None], lexicon: dict[str, list[float]]) -> np.ndarray:
    """One row of ``FEATURES`` for each text; ``lexicon``: term -> weights of its first, second and third mention."""
    insults, second = frozenset(INSULTS), frozenset(SECOND)
    starts = frozenset(t[1:] for t in lexicon if t[0] == "\t")
    rows = np.zeros((len(texts), len(FEATURES)))
    remembered: dict[str, tuple] = {}

    def kind(w: str) -> tuple:
        """The lexicon's terms that a word says: itself, its unmasked form, its beginnings; insult; second person."""
        plain = w.translate(_PLAIN) if not w.isalpha() else w
        own = tuple(t for t in {w, plain} if t in lexicon)
        stems = tuple("\t" + w[:n] for n in STEMS if len(w) > n and w[:n] in starts)
        r = remembered[w] = (own, stems, float(w in insults or plain in insults), w in second)
        if len(remembered) > REMEMBERED:
            remembered.clear()
        return r

    for i, text in enumerate(texts):
        if not text:
            continue
        found = words(text)
        n = max(1, len(found))
        said: dict[str, int] = {}
        fixed = you = 0.0
        hits, persons = set(), set()
        get = remembered.get
        for w, times in Counter(found).items():
            own, stems, insult, person = get(w) or kind(w)
            for t in own + stems:
                said[t] = said.get(t, 0) + times
            fixed += insult * times
            if person:
                you += times
                persons.add(w)
            if own or stems or insult:
                hits.add(w)
        near = 0.0
        if persons and hits:
            last_you = last_hit = -(10**9)
            for at, w in enumerate(found):
                if w in persons:
                    last_you = at
                    near += at - last_hit <= 5
                elif w in hits:
                    last_hit = at
                    near += at - last_you <= 5
        weights = {False: [0.0], True: [0.0]}
        for t, times in said.items():
            weights[t[0] == "\t"].append(max(lexicon[t][:times]))
        lex, stem = weights[False], weights[True]
        c = max(1, len(text))
        capitals = sum(map(str.isupper, text)) if not text.islower() else 0
        rows[i] = (
            sum(lex) / n, len(lex) - 1, max(lex), sum(stem) / n, len(stem) - 1, max(stem), fixed / n, fixed, near / n, you / n, capitals / c,
            sum(map(text.count, ".,;:!?")) / c, (text.count("!") + text.count("?")) / c, len(_MASKED.findall(text)) / n, np.log1p(len(found)),
        )
    return rows


def features(texts, lexicon: dict[str, list[float]]):
    """``feature_rows`` as a pandas table, to look at."""
    import pandas as pd

    return pd.DataFrame(feature_rows(list(texts), lexicon), columns=FEATURES)


def checksum(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(5))


def _part(labelled: DataFrame, remainders: tuple[int, ...], per_part: int) -> DataFrame:
    """At most ``per_part`` distinct texts: those of the least hashes. Only hashes are sorted."""
    own = labelled.where(F.col("fold").isin(*remainders)).groupBy("h").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    last = own.select("h").orderBy("h").limit(per_part).agg(F.max("h")).first()[0]
    return own.where(F.col("h") <= F.lit(last)) if last is not None else own


def _counted(said: dict[tuple[str, int], list[int]]) -> pa.RecordBatch:
    """Partial counts as rows; forgets them."""
    keys, values = list(said), list(said.values())
    said.clear()
    return pa.RecordBatch.from_pydict(
        {
            "term": pa.array([k[0] for k in keys], pa.string()), "times": pa.array([k[1] for k in keys], pa.int32()),
            "t": pa.array([v[0] for v in values], pa.int64()), "n": pa.array([v[1] for v in values], pa.int64()),
        }
    )


def learn_lexicon(part: DataFrame, n_toxic: int, n_clean: int, least: int = 3) -> dict[str, list[float]]:
    """Words and beginnings, with the log of the likelihood ratio of toxic against clean texts when a text says them at
    least once, twice and three times; add-half smoothed."""

    def run(batches):
        said: dict[tuple[str, int], list[int]] = {}
        for batch in batches:
            for part, texts in slices(batch, "text"):
                for text, toxic in zip(texts, part.column("toxic").to_pylist()):
                    for term, n in terms_of(words(text)).items():
                        for times in range(1, min(n, 3) + 1):
                            count = said.setdefault((term, times), [0, 0])
                            count[0] += toxic
                            count[1] += 1
                    if len(said) > TERMS:
                        yield _counted(said)
        yield _counted(said)

    rows = part.select("text", "toxic").mapInArrow(run, "term string, times int, t bigint, n bigint")
    counts = rows.groupBy("term", "times").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    weight = F.log(((F.col("t") + 0.5) / (n_toxic + 1.0)) / ((F.col("n") - F.col("t") + 0.5) / (n_clean + 1.0)))
    # far likelier in toxic texts, and in enough of them
    kept = counts.where(F.col("t") >= least).select("term", "times", "t", weight.alias("w")).where(F.col("w") >= 1.7)
    out: dict[str, list[float]] = {}
    for r in kept.orderBy(F.desc(F.col("w") * F.log1p("t")), "term", "times").limit(LEXICON).collect():
        out.setdefault(r["term"], [0.0, 0.0, 0.0])[r["times"] - 1] = r["w"]
    return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_part: int = PER_PART, trees: int = 20, depth: int = 4) -> Model:
    """A model from the labelled rows whose checksum is not 0; rows without a label of 0 or 1 are left out."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("toxic")).where("toxic in (0, 1) and id is not null")
    known = known.groupBy("id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    known = known.withColumn("fold", checksum(F.col("id"))).where("fold != 0")
    # the sample is drawn by id first, so that few texts are moved
    spread = F.xxhash64("id")
    room = known.withColumn("part", F.when(F.col("fold") <= 2, 0).otherwise(F.col("fold"))).withColumn("r", spread)
    bounds = room.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("r", [i / 100 for i in range(1, 101)], 1000).alias("q")).collect()
    keep = F.lit(False)
    for b in bounds:
        part = 0 if b["part"] == 0 else b["part"]
        enough = min(100, int(np.ceil(130 * per_part / b["n"])))  # a third more than needed: equal texts go
        keep = keep | ((F.col("part") == part) & (F.col("r") <= (b["q"][enough - 1] if enough < 100 else 2**63 - 1)))
    few = room.where(keep).select("id", "toxic", "fold")
    own = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    joined = own.join(F.broadcast(few), "id").select("text", "toxic", "fold", F.xxhash64("text").alias("h"))
    joined = joined.groupBy("h", "fold").agg(F.min("text").alias("text"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    labelled = stored(joined.repartition(8), "toxic-sample")
    sizes = {(r["fold"], r["toxic"]): r["n"] for r in labelled.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, bad = sum(sizes.values()), sum(n for (_, t), n in sizes.items() if t)
    prior = bad / total if total else 0.0
    count = lambda folds, t: sum(n for (f, x), n in sizes.items() if f in folds and x == t)
    if not all(count(f, t) for f in ((1, 2), (3,)) for t in (0, 1)):
        return Model({}, None, ([0.0], [prior]), prior)
    first = _part(labelled, (1, 2), per_part)
    lexicon = learn_lexicon(first, count((1, 2), 1), count((1, 2), 0))
    blob = docs.sparkSession.sparkContext.broadcast(lexicon)
    doubles = pa.list_(pa.float64())

    def measure(part, texts):
        return pa.RecordBatch.from_arrays([pa.array(list(feature_rows(texts, blob.value)), doubles), part.column("toxic").cast(pa.float64())], ["x", "label"])

    rows = lambda folds: map_texts(_part(labelled, folds, per_part).select("text", "toxic"), "text", measure, "x array<double>, label double")
    train = stored(rows((3,)).coalesce(2), "toxic-features").select(array_to_vector("x").alias("x"), "label")
    grown = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, subsamplingRate=1.0, seed=17, maxBins=64, minInstancesPerNode=3, cacheNodeIds=False, checkpointInterval=-1).fit(train)
    flat = Trees.of(grown)

    def margins(part, texts):
        return pa.RecordBatch.from_arrays([pa.array(flat.margins(feature_rows(texts, blob.value))), part.column("toxic").cast(pa.float64())], ["margin", "label"])

    # calibration on the third part; a small one is helped by the trees' own part
    held = _part(labelled, (4,) if count((4,), 1) >= 5 and count((4,), 0) >= 5 else (3, 4), per_part).select("text", "toxic")
    pairs = map_texts(held, "text", margins, "margin double, label double").groupBy("margin").agg(F.sum("label").alias("s"), F.count(F.lit(1)).alias("n")).orderBy("margin").collect()
    return Model(lexicon, flat, isotonic([r["margin"] for r in pairs], [r["s"] for r in pairs], [r["n"] for r in pairs]), prior)


def isotonic(x: list[float], s: list[float], n: list[float]) -> tuple[list[float], list[float]]:
    """Pool adjacent violators: knots (margin, share) of the best non-decreasing fit; a half success and failure soften the ends."""
    pools: list[list[float]] = []
    for a, b, c in zip(x, s, n):
        pools.append([a, a, b, c])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            lo, hi = pools[-2], pools.pop()
            pools[-1] = [lo[0], hi[1], lo[2] + hi[2], lo[3] + hi[3]]
    knots, values = [], []
    for lo, hi, good, size in pools:
        share = (good + 0.5) / (size + 1.0)
        for at in (lo, hi) if hi > lo else (lo,):
            knots.append(at)
            values.append(share)
    return knots, np.maximum.accumulate(values).tolist()


def score(df: DataFrame, text: str, model: Model) -> DataFrame:
    """Adds ``score`` (calibrated, 0 to 1) and ``predicted`` (1 from 0.5 on) to every row."""
    name, flag = spare(df.columns, "score", "predicted")
    if model.trees is None:
        return df.withColumn(name, F.lit(float(model.prior))).withColumn(flag, F.lit(int(model.prior >= 0.5)))
    blob = df.sparkSession.sparkContext.broadcast((model.lexicon, model.trees, *(np.array(v) for v in model.knots)))

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        lexicon, trees, knots, values = blob.value
        out = [np.zeros(0)]
        for _, part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            margin = trees.margins(feature_rows(part, lexicon))
            # the margin breaks ties inside a pool by a hair, so that the order of the trees is kept
            out.append(np.clip(np.interp(margin, knots, values) + 1e-6 * np.tanh(margin), 0, 1))
        return pa.array(np.concatenate(out))

    return df.withColumn(name, scored(F.col(text))).withColumn(flag, (F.col(name) >= 0.5).cast("int"))
