"""Operator 8, toxicity by weak supervision.

Voters: a word of a fixed insult list, a text pattern, or a word or word beginning that the labelled training rows
show to mark toxic texts (counted over all of them). Each votes "toxic" or abstains. A generative label model, with a
rate of firing per voter and class, is fitted by EM on the vote patterns of all training documents, where a labelled
row's class is known and the others' is estimated; voters that fire
together more than the model explains are taken as correlated and share their weight. A linear classifier over
hashed words and word beginnings is then trained on posterior labels and scores every text.

Fixed bounds: MAX_MINED voters are mined, the best by lift of all features that LEAST_TOXIC toxic texts hold; the classifier is fitted on SAMPLE documents of either posterior label
(a hash of the text decides; all statistics before it cover all training documents).
A bitmap of fixed size keeps most texts without a label from the join with the labels; where it is full more texts
are shuffled, none is lost.

Cases: a null or empty text has no features and scores what the classifier gives to none; a null id falls in fold 0;
null labels and labels of unknown ids are not used, of several labels of one id the largest counts; repeated rows
count and are scored each; texts of any length are read whole; without any toxic label every score is 0; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, fold, mix, settle, sieve, sifted, slices, span_hashes, table

#: Bits of a feature's hash.
BITS = 40
#: Bytes of a word that a beginning has.
BEGINNINGS = (4, 5, 6)
MAX_MINED = 256
LEAST_TOXIC = 5
SAMPLE = 3000
EM_ROUNDS = 6
#: Voters with a residual correlation above this share their weight.
CORRELATED = 0.5
#: Standard deviations by which a feature's rate must differ between the posterior labels to enter the classifier.
TELLING = 4.0
#: Plain insults, in four languages.
INSULTS = (
    "idiot moron stupid dumb loser trash scum pathetic worthless disgusting clown jerk fool creep freak "
    "idioten dummkopf trottel abschaum versager widerlich erbärmlich wertlos depp vollidiot "
    "imbécile crétin abruti ordure minable dégoûtant pathétique nul raté connard "
    "idiota imbécil estúpido basura escoria patético inútil asqueroso payaso perdedor"
).split()
PATTERNS = ("shouting", "exclaiming", "addressed")


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of all texts, as hashes in order within each text, and where each text's begin (one end more)."""
    lowered = pa.array([(t or "").lower() for t in texts.to_pylist()], pa.string())
    data, ends = as_bytes(lowered)
    letter = (data >= 0x80) | ((data >= 0x61) & (data <= 0x7A))
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    edges = ends[(ends > 0) & (ends < len(data))]
    first[edges] |= letter[edges]
    last[edges - 1] |= letter[edges - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(ends, starts, side="right") - 1
    keys = [(owner.astype(np.uint64) << np.uint64(BITS)) | hashed(span_hashes(data, starts, stops), 0)]
    for n in BEGINNINGS:
        long = stops - starts > n
        keys.append((owner[long].astype(np.uint64) << np.uint64(BITS)) | hashed(span_hashes(data, starts[long], starts[long] + n), n))
    found = np.unique(np.concatenate(keys))
    return found & np.uint64((1 << BITS) - 1), np.searchsorted(found >> np.uint64(BITS), np.arange(len(ends)))


def hashed(h: np.ndarray, kind: int) -> np.ndarray:
    return mix(h + np.uint64(kind)) >> np.uint64(64 - BITS)


def lookup(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Place of each feature in the sorted ``keys``, or -1."""
    if not len(keys):
        return np.full(len(found), -1)
    at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
    return np.where(keys[at] == found, at, -1)


def word_hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(hashed(span_hashes(raw, np.array([0]), np.array([len(raw)])), 0)[0])


def patterns(texts: pa.Array, insulted: np.ndarray) -> np.ndarray:
    """Which text patterns each text shows; ``insulted``: it holds a word of the list."""
    data, ends = as_bytes(texts)
    sums = lambda mask: np.concatenate([[0], np.cumsum(mask)])[ends]
    upper, lower = np.diff(sums((data >= 0x41) & (data <= 0x5A))), np.diff(sums((data >= 0x61) & (data <= 0x7A)))
    marks = np.diff(sums(data == 0x21))
    addressed = np.array([" you " in t.lower() if t else False for t in texts.to_pylist()], bool) & insulted
    return np.stack([upper > 2 * lower, 20 * marks > np.maximum(1, np.diff(ends)), addressed], axis=1)


def labelled_texts(lean: DataFrame, marks: DataFrame) -> DataFrame:
    """(_text, _toxic) of every row of ``lean`` (_key, _text) whose key is in ``marks`` (_key, _toxic)."""
    shared = sieve(marks.select(F.xxhash64("_key").alias("_id")), "_id")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.select([0, 1]).filter(pa.array(sifted(shared.value, np.asarray(batch.column(2)))))

    some = lean.select("_text", "_key", F.xxhash64("_key").alias("_id")).mapInArrow(sift, f"_text string, _key {lean.schema['_key'].dataType.simpleString()}")
    return some.join(marks.hint("merge"), "_key").select("_text", "_toxic")


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic and clean texts that hold it); feature -1 stands for the texts themselves."""
    for batch in batches:
        for part in slices(batch, "_text"):
            found, bounds = features(part.column(0))
            toxic = np.asarray(part.column(1)) == 1
            keys, place = np.unique(found, return_inverse=True)
            held = np.bincount(place, minlength=len(keys))
            one = np.bincount(place[np.repeat(toxic, np.diff(bounds))], minlength=len(keys))
            rows = np.append(keys.astype(np.int64), -1), np.append(one, toxic.sum()), np.append(held - one, (~toxic).sum())
            yield pa.RecordBatch.from_arrays([pa.array(r.astype(np.int64)) for r in rows], ["feature", "one", "zero"])


def mined_voters(labelled: DataFrame) -> list[int]:
    """Features that mark toxic texts, the best first. ``labelled``: _text, _toxic."""
    counts = labelled.mapInArrow(_label_counts, "feature long, one long, zero long").groupBy("feature").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    counts = settle(counts.where((F.col("feature") < 0) | (F.col("one") >= LEAST_TOXIC) & (F.col("one") > F.col("zero"))))
    sizes = counts.where("feature < 0").first()
    if sizes is None or not sizes["one"]:
        return []
    toxic, clean = sizes["one"], sizes["zero"]
    lift = (F.col("one") / toxic - F.col("zero") / max(1, clean)) / F.sqrt((F.col("one") + F.col("zero") + 1) / (toxic + clean))
    return [r[0] for r in counts.where("feature >= 0").orderBy(lift.desc(), "feature").select("feature").limit(MAX_MINED).collect()]


class Voters:
    """Numbers 0 to ``insults`` - 1 are the list's words, then come the mined features, then the patterns."""

    def __init__(self, mined: list[int]):
        insults = dict.fromkeys(word_hash(w) for w in INSULTS)
        order = list(dict.fromkeys([*insults, *mined]))
        self.insults, self.words, self.n = len(insults), len(order), len(order) + len(PATTERNS)
        self.keys, self.number = np.unique(np.array(order, np.uint64), return_index=True)

    def votes(self, texts: pa.Array, found: np.ndarray, bounds: np.ndarray) -> list[tuple[int, ...]]:
        place = lookup(self.keys, found)
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        fired = np.zeros((len(bounds) - 1, self.n), bool)
        held = place >= 0
        fired[owner[held], self.number[place[held]]] = True
        fired[:, self.words :] = patterns(texts, fired[:, : self.insults].any(1))
        return [tuple(np.flatnonzero(row).tolist()) for row in fired]


class LabelModel:
    """Rates of firing for each voter and class, the share of class 1, and each voter's weight."""

    def __init__(self, n: int, prior: float):
        self.on1, self.on0, self.weight, self.prior = np.full(n, 0.2), np.full(n, 0.01), np.ones(n), prior
        self.first = True

    def posterior(self, votes: list[tuple[int, ...]], known: np.ndarray | None = None) -> np.ndarray:
        """Probability of class 1; ``known`` holds 0 or 1 where the class is known, else -1."""
        gain = self.weight * (np.log(self.on1) - np.log(self.on0))
        miss = self.weight * (np.log1p(-self.on1) - np.log1p(-self.on0))
        start = np.log(self.prior) - np.log1p(-self.prior) + miss.sum()
        logit = np.array([start + sum(gain[j] - miss[j] for j in v) for v in votes])
        p = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
        return p if known is None else np.where(known >= 0, known, p)

    def fit(self, table_: DataFrame) -> None:
        """EM over the table (votes, known, n); each round is one aggregation, its result of one row per voter."""
        n = len(self.on1)
        for round_ in range(2 * EM_ROUNDS):
            if round_ == EM_ROUNDS:
                self._correlate(table_)
            shared = table_.sparkSession.sparkContext.broadcast(self)

            def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                sums = np.zeros((n + 1, 2))
                for batch in batches:
                    votes, times = batch.column(0).to_pylist(), np.asarray(batch.column(2)).astype(np.float64)
                    # at first only the known rows count: the others have no rates yet
                    p = shared.value.posterior(votes, np.asarray(batch.column(1)))
                    if shared.value.first:
                        times = np.where(np.asarray(batch.column(1)) >= 0, times, 0)
                    for v, k, q in zip(votes, times, p, strict=True):
                        sums[v] += (k * q, k * (1 - q))
                    sums[n] += ((times * p).sum(), (times * (1 - p)).sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n + 1, dtype=np.int32)), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["voter", "one", "zero"])

            sums = np.zeros((n + 1, 2))
            for r in table_.mapInArrow(expect, "voter int, one double, zero double").groupBy("voter").agg(F.sum("one"), F.sum("zero")).collect():
                sums[r[0]] = r[1], r[2]
            self.first = False
            self.prior = float(np.clip(sums[n, 0] / max(sums[n].sum(), 1), 1e-4, 0.5))
            self.on1 = np.clip((sums[:n, 0] + 0.2) / (sums[n, 0] + 1), 1e-4, 1 - 1e-4)
            self.on0 = np.clip((sums[:n, 1] + 0.01) / (sums[n, 1] + 1), 1e-5, 1 - 1e-4)

    def _correlate(self, table_: DataFrame) -> None:
        """What voters fire together beyond what the classes explain lowers their weights."""
        n = len(self.on1)
        pairs = table_.select("n", F.explode("votes").alias("i"), "votes").select("n", "i", F.explode("votes").alias("j")).groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # voters squared at most
        total = max(1, table_.agg(F.sum("n")).first()[0] or 0)
        both = np.zeros((n, n))
        for r in pairs:
            both[r["i"], r["j"]] = r["n"] / total
        alone = np.diag(both)
        expected = self.prior * np.outer(self.on1, self.on1) + (1 - self.prior) * np.outer(self.on0, self.on0)
        spread = np.sqrt(np.outer(alone * (1 - alone), alone * (1 - alone))) + 1e-12
        self.correlation = np.clip((both - expected) / spread, 0, 1)
        np.fill_diagonal(self.correlation, 0)
        self.weight = 1 / (1 + np.where(self.correlation > CORRELATED, self.correlation, 0).sum(1))


def fit_linear(rows: list[np.ndarray], target: np.ndarray, shift: float, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on sets of features by full-batch Adam: features in order, weights, intercept.

    Features of fewer than LEAST_TOXIC texts, or whose rate hardly differs between the labels, get no weight; ``shift`` is taken off the intercept afterwards.
    """
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    keys, place, times = np.unique(np.concatenate([*rows, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    one = np.bincount(place, target[owner], minlength=len(keys))
    share, total = target.sum() / max(1, len(rows)), max(1, len(rows))
    spread = np.sqrt(times * share * (1 - share) * (1 - times / (total + 1)) + 1e-9)
    chosen = (times >= LEAST_TOXIC) & (np.abs(one - times * share) > TELLING * spread)
    keep = chosen[place]
    owner, place, keys = owner[keep], (np.cumsum(chosen) - 1)[place[keep]], keys[chosen]
    w, b = np.zeros(len(keys)), 0.0
    m, v, mb, vb = np.zeros(len(keys)), np.zeros(len(keys)), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(owner, w[place], minlength=len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(rows)
        g, gb = np.bincount(place, error[owner], minlength=len(keys)) + 1e-4 * w, error.sum()
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c, d = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.1 * (m / c) / (np.sqrt(v / d) + 1e-8)
        b -= 0.1 * (mb / c) / (np.sqrt(vb / d) + 1e-8)
    return keys, w, b - shift


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[np.ndarray, np.ndarray, float] | None:
    """Features, weights and intercept of the classifier, from training documents and their labels; None without a toxic label."""
    spark = docs.sparkSession
    lean = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).cast("int").alias("_toxic"))
    marked = {r[0]: r[1] for r in marks.groupBy("_toxic").agg(F.count("*")).collect()}
    if not marked.get(1):
        return None
    prior = marked[1] / sum(marked.values())
    mined = mined_voters(labelled_texts(lean, marks))
    voters = spark.sparkContext.broadcast(Voters(mined))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                found, bounds = features(part.column(0))
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(voters.value.votes(part.column(0), found, bounds), pa.list_(pa.int32()))], ["_key", "votes"])

    cast = lean.select("_text", "_key").mapInArrow(vote, f"_key {lean.schema['_key'].dataType.simpleString()}, votes array<int>")
    votes = settle(cast.join(marks, "_key", "left").groupBy("votes", F.coalesce("_toxic", F.lit(-1)).alias("known")).agg(F.count("*").alias("n")))
    model = LabelModel(voters.value.n, min(0.5, prior))
    model.fit(votes)
    shared = spark.sparkContext.broadcast(model)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.posterior(v) >= 0.5), batch.column(2)], ["one", "n"])

    sizes = {r["one"]: r["n"] for r in votes.mapInArrow(weigh, "one boolean, n long").groupBy("one").agg(F.sum("n").alias("n")).collect()}
    share = {y: min(1.0, SAMPLE / max(1, sizes.get(y, 0))) for y in (True, False)}

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                found, bounds = features(part.column(0))
                p = shared.value.posterior(voters.value.votes(part.column(0), found, bounds))
                draw = np.asarray(part.column(1))
                keep = np.flatnonzero(draw < np.where(p >= 0.5, share[True], share[False]))
                if len(keep):
                    yield pa.RecordBatch.from_arrays([pa.array([found[bounds[i] : bounds[i + 1]].astype(np.int64) for i in keep], pa.list_(pa.int64())), pa.array(p[keep])], ["features", "p"])

    draw = (F.pmod(F.xxhash64("_text", "_key"), F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("_draw")
    rows = lean.select("_text", draw).mapInArrow(sample, "features array<long>, p double").toArrow()  # about SAMPLE rows of either label
    sets = [np.asarray(x.values).astype(np.uint64) for x in rows["features"]]
    target = np.asarray(rows["p"])
    # the sample's mix of labels isn't that of the documents
    shift = float(np.log(max(1, (target >= 0.5).sum()) / max(1, (target < 0.5).sum())) - np.log(max(1, sizes.get(True, 0)) / max(1, sizes.get(False, 0))))
    return fit_linear(sets, target, shift)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float] | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "_text"):
                if shared.value is None:
                    p = np.zeros(part.num_rows)
                else:
                    keys, weights, intercept = shared.value
                    found, bounds = features(part.column(1))
                    place = lookup(keys, found)
                    held = place >= 0
                    z = intercept + np.bincount(np.repeat(np.arange(part.num_rows), np.diff(bounds))[held], weights[place[held]], minlength=part.num_rows)
                    p = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p)], ["_key", "score"])

    lean = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return lean.mapInArrow(scores, f"_key {lean.schema['_key'].dataType.simpleString()}, score double").withColumnRenamed("_key", key)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 3) != 1), table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1))
    return score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
SQL: dict[str, str] = {}
