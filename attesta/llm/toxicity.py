"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a fixed insult list and of a lexicon learned from labelled rows, the nearest second-person
pronoun to an insult, capitals, punctuation, and obfuscation (digits or symbols inside words that read as an insult once
undone). The learned lexicon holds words and word beginnings that occur in toxic training rows far more often than elsewhere.

Labelled rows are split by a hash of doc_id: the lexicon learns from four tenths, the trees from the rest. The isotonic regression learns from the trees'
scores of each half of that rest by the other half, so nothing judges rows that it has learned from itself; a thousandth of the raw score keeps the order within its
steps. Trees and regression are Spark ML models; features are computed in Arrow batches.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that the lexicon, the trees and the calibration learn from, at most, drawn by a hash of doc_id.
SAMPLE = 40_000
LEXICON_SIZE = 2000
LEXICON_MIN_DOCS = 3
LEXICON_MIN_Z = 3.0
PREFIXES = (4, 5, 6)
TREES = 25
DEPTH = 4

#: Common insults and the pronouns of address.
INSULTS = frozenset(
    """idiot idiots moron morons loser losers scum clown clowns stupid disgusting worthless pathetic trash garbage dumb fool fools
    imbecile retard retarded bastard bitch asshole jerk freak creep liar coward pig filth filthy vermin ugly hate kill die shut
    crap damn shit fuck fucking whore slut dumbass
    idiota imbécil estúpido estúpida basura asqueroso patético inútil payaso perdedor escoria mierda
    dumm dummkopf trottel abschaum arschloch wertlos erbärmlich müll scheiße ekelhaft verlierer
    imbécile crétin connard ordure minable dégoûtant merde pathétique""".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes tus vosotros".split())
_LEET = str.maketrans("013457@$!|", "oieastasil")
_TOKEN = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"(?<!\S)(?=\S*[^\W\d_])\S*[^\W\d_][0-9@$!*#|]+[^\W\d_]\S*")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
_RUNS = re.compile(r"([^\W\d_])\1{3,}")

FEATURES = (
    "insults insult_density learned_max learned_sum learned_strong learned_density pronouns nearest nearness capitals shouted exclamations questions "
    "punctuation symbols obfuscated spaced undone stretched words word_length distinct digits"
).split()


def lexicon_terms(word: str) -> list[str]:
    """The forms under which a word is counted: itself and its beginnings."""
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) > n)]


class _Words(dict):
    """What is to know of a word by itself: 0, or (lexicon weight, insult, pronoun, stretched)."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def __missing__(self, w: str):
        if len(self) > 1 << 20:
            self.clear()
        found = (max((self.lexicon.get(x, 0.0) for x in lexicon_terms(w)), default=0.0), w in INSULTS, w in SECOND_PERSON, bool(_RUNS.search(w)))
        self[w] = found = found if any(found) else 0
        return found


def features(text: str | None, known: _Words) -> list[float]:
    """The values of FEATURES for one whole text; all 0 but `nearest` (1) for null, empty and wordless texts."""
    import numpy as np

    text = text or ""
    low = text.lower()
    words = _TOKEN.findall(low)
    n = len(words)
    insults = pronouns = stretched = strong = weighted = undone = spaced = 0
    total = most = 0.0
    last_you, last_insult, nearest = -1000, -1000, 1000
    for i, found in enumerate(map(known.__getitem__, words)):
        if not found:
            continue
        x, bad, you, long = found
        stretched += long
        if x:
            weighted, total, most, strong = weighted + 1, total + x, max(most, x), strong + (x > 2)
        if bad or x > 2:
            insults += bad
            last_insult = i
            nearest = min(nearest, i - last_you)
        if you:
            pronouns += 1
            last_you = i
            nearest = min(nearest, i - last_insult)
    lengths = list(map(len, words))
    letters = sum(lengths)
    count = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    per = lambda chars: int(sum(count[ord(x)] for x in chars))
    digits = per("0123456789")
    mixed = _MIXED.findall(text) if digits or per("@$!*#|") else ()
    for w in mixed:
        undone += w.lower().translate(_LEET).strip(".,;:'\"()?*#") in INSULTS
    if lengths.count(1) >= 4:
        for w in _SPACED.findall(text):
            spaced += 1
            undone += re.sub(r"[\W_]", "", w).lower() in INSULTS
    upper = shouted = 0
    if low != text and len(low) == len(text):
        capital = np.frombuffer(text.encode("utf-32-le"), np.uint32) != np.frombuffer(low.encode("utf-32-le"), np.uint32)
        upper, shouted = int(capital.sum()), int((capital[1:] & capital[:-1]).sum())
    m, c, near = max(1, n), max(1, len(text)), None if nearest >= 1000 else nearest
    return [
        math.log1p(insults), 100 * insults / m, most, min(50.0, total), float(strong), 100 * weighted / m,
        100 * pronouns / m, 1.0 if near is None else min(1.0, near / 50), 0.0 if near is None else 1 / (1 + near),
        upper / max(1, letters), shouted / max(1, letters), 100 * per("!") / c, 100 * per("?") / c,
        100 * per(".,;:!?'\"()-") / c, 100 * per("#$%&*@|<>~^=+{}[]\\/") / c, 100 * len(mixed) / m, 100 * spaced / m, float(undone), 100 * stretched / m,
        math.log1p(n), letters / m, len(set(words)) / m, 100 * digits / c,
    ]


def learn_lexicon(labelled: DataFrame) -> dict[str, float]:
    """Terms with their log-odds from rows (text, label): of toxic rows at least LEXICON_MIN_DOCS, a z-score of LEXICON_MIN_Z, the LEXICON_SIZE strongest."""
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = sizes.get(1, 0), sizes.get(0, 0)
    if not bad or not good:
        return {}
    words = labelled.select("label", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("w")).where("w <> ''")
    terms = words.select("label", F.explode(F.array(F.col("w"), *(F.when(F.length("w") > n, F.concat(F.substring("w", 1, n), F.lit("~"))) for n in PREFIXES))).alias("term")).where("term is not null")
    counted = terms.groupBy("term").agg(F.sum("label").alias("b"), F.sum(1 - F.col("label")).alias("g")).where(F.col("b") >= LEXICON_MIN_DOCS)
    odds = F.log((F.col("b") + 0.5) / (bad + 1)) - F.log((F.col("g") + 0.5) / (good + 1))
    z = odds / F.sqrt(1 / (F.col("b") + 0.5) + 1 / (F.col("g") + 0.5))
    top = counted.select("term", odds.alias("odds"), z.alias("z")).where(F.col("z") >= LEXICON_MIN_Z).orderBy(F.desc("z"), "term").limit(LEXICON_SIZE)
    return {r["term"]: float(min(r["odds"], 6.0)) for r in top.collect()}


def with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """Adds the array `features` to doc_id, text (and drops the text)."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = _Words(shared.value)
        for batch in batches:
            rows = [features(x, known) for x in batch.column("text").to_pylist()]
            values = pa.array(np.array(rows, np.float64).ravel())
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "features"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, features array<double>")


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Adds a calibrated probability to every document: doc_id, score (0 to 1).

    labels: doc_id, label (0 or 1), one row a document. Labels without an id, a value or a text teach nothing; without rows of both labels
    every score is their share of toxic ones, or 0. Null and empty texts are scored by their (zero) features.
    The labels are drawn before their texts are read; as no more than about `sample` of them are left, they are broadcast.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    from attesta.llm.common import materialize

    labels = labels.where("doc_id is not null and label in (0, 1)").select("doc_id", F.col("label").cast("int").alias("label"))
    share = min(1.0, sample / max(1, labels.count()))
    drawn = labels.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) < share * (1 << 20)).withColumn("part", F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(10)))
    labelled = materialize(docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id"), "labelled")
    seen = labelled.agg(F.count("*").alias("n"), F.sum("label").alias("bad")).first()
    if not seen["n"] or seen["bad"] in (0, seen["n"]):
        return docs.select("doc_id", F.lit(float(seen["bad"] or 0) / max(1, seen["n"])).alias("score"))
    lexicon = learn_lexicon(labelled.where("part < 4"))
    known = materialize(with_features(labelled, lexicon).join(F.broadcast(drawn), "doc_id"), "known")
    known = known.where("part >= 4").withColumn("vector", array_to_vector("features")).withColumn("label", F.col("label").cast("double"))
    known = materialize(known, "training")
    raw = F.element_at(vector_to_array("probability"), 2)
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, maxBins=64, minInstancesPerNode=3, seed=3)
    both = {r["k"]: r["n"] for r in known.groupBy((F.col("part") % 2).alias("k")).agg(F.count_distinct("label").alias("n")).collect()}
    folds = [0, 1] if both == {0: 2, 1: 2} else []
    apart = [trees.fit(known.where(f"part % 2 = {1 - k}")).transform(known.where(f"part % 2 = {k}")).select(raw.alias("raw"), "label") for k in folds]
    if not known.where("label = 1").limit(1).count() or not known.where("label = 0").limit(1).count():
        return docs.select("doc_id", F.lit(float(seen["bad"]) / seen["n"]).alias("score"))
    model = trees.fit(known)
    tuned = apart[0].unionByName(apart[1]) if apart else model.transform(known).select(raw.alias("raw"), "label")
    curve = IsotonicRegression(featuresCol="raw", labelCol="label").fit(tuned)
    scored = model.transform(with_features(docs, lexicon).withColumn("vector", array_to_vector("features"))).select("doc_id", raw.alias("raw"))
    level = F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0))
    return curve.transform(scored).select("doc_id", (0.999 * level + 0.001 * F.col("raw")).alias("score"))


def op7_toxicity(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    from attesta.llm.langid import held_out

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(modulus=4, remainder=2)).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    found = score(docs, labels)
    return found.select("doc_id", held_out(modulus=4, remainder=2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
