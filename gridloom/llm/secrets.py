"""Operator 6, secret scans: candidates by patterns, false positives removed by a random forest.

Candidates are runs of 16 or more characters of keys, digests and encoded bytes; quoted or assigned values of 8 or more
characters beside a credential's name (the last part of a name split at _ and -); private-key blocks, passwords in
addresses (user:password@host) and the secret parts of webhook addresses. A random forest judges each by its
length, character transitions (how often the class of character changes, how many neighbours are letter pairs of
ordinary words), dictionary coverage (share of letters in runs that are words of the corpus), path (the source's
kind), and neighbouring words (the word before, an assignment sign, quotes). It is trained on labelled findings: a
finding is labelled by people (``labels``); without these, secret where a strict rule holds (a credential's name, an
assignment and a value of digits and other characters, or the fixed form of a known kind of key), and not secret where
nothing speaks for it (no name, no assignment, no quotes); what the rule can't decide is not trained on. A fixed form
(private-key block, password in an address, webhook) is a secret by its form alone.

Only DataFrame expressions and Spark's own forest run here.

Fixed bounds: the forest is fitted on TRAIN_FINDINGS findings of either label at most (a hash decides which).

Cases: a null or empty text has no candidate; ids and sources may be null; repeated rows are reported one by one and
candidates of a text in order; texts of any length are scanned whole; without findings of both labels nothing is
removed by the forest and the labels decide (what they leave open is no secret); an empty table gives an empty result;
other columns are not read, whatever their names, and ``redact`` gives them back as they are.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import settle, table

#: Names of credentials, as the last part of the word before a candidate.
NAMES = ("token", "secret", "secrets", "password", "passwd", "passphrase", "pwd", "pass", "key", "apikey", "auth", "credential", "credentials", "bearer")
#: What stands between a credential's name and its value, in the lookbehinds below.
_NAMED = r"(?i:(?<![A-Za-z])(?:" + "|".join(NAMES) + r"))[\"']?\s{0,3}[:=][=>]?\s{0,3}"
#: Forms that are secrets without a name.
BLOCK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----[\s\S]*?-----END [A-Z ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
ADDRESS = r"(?<=:)(?<=://[^\s/:@]{0,64}:)[^\s/@]+(?=@[A-Za-z0-9\[])"
WEBHOOK = r"(?<=/)(?<=hooks\.slack\.com/services/|discord\.com/api/webhooks/|discordapp\.com/api/webhooks/)[A-Za-z0-9_/\-]{16,}"
#: A candidate; a bare one holds what keys, digests and base64 hold.
CANDIDATE = (
    f"({BLOCK}|{ADDRESS}|{WEBHOOK}"
    rf"|(?<=\")(?<={_NAMED}\")[^\"\r\n]{{8,}}+(?=\")|(?<=')(?<={_NAMED}')[^'\r\n]{{8,}}+(?=')"
    rf"|(?<=[:=>\s])(?<={_NAMED})[^\s\"',;]{{8,}}"
    r"|(?<![A-Za-z0-9+/_\-])(?!(?<=hooks\.slack\.)com/services/|(?<=discord\.|discordapp\.)com/api/webhooks/)[A-Za-z0-9+/_\-]{16,}={0,2}(?![A-Za-z0-9+/_\-=]))"
)
#: Fixed forms of published kinds of keys.
KNOWN = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9\-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_\-]{35})$"
#: Path parts that hold samples rather than live keys.
SAMPLE_PATHS = r"(?i)(^|[/._\-])(test|tests|example|examples|sample|samples|docs?|fixtures?|mock)([/._\-]|$)"
#: Two-letter pairs that ordinary words hold often.
USUAL_PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur".split()
TRAIN_FINDINGS = 20_000
TREES, DEPTH = 20, 6
#: Characters kept around a candidate for its neighbours.
CONTEXT = 96
FEATURES = ("length", "digit_share", "upper_share", "hex_share", "switches", "usual_pairs", "distinct_share", "covered", "sample_path", "named", "assigned", "quoted", "word_before")
THRESHOLD = 0.5


def values_of(text: str | Column) -> Column:
    """A text's candidates in order; null without any."""
    return F.when(F.regexp_like(text, F.lit(CANDIDATE)), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(1)))


def candidates(found: DataFrame) -> DataFrame:
    """One row for each candidate: _key, _path, _row, n (place among the row's candidates), start, value, before, after.

    ``found``: _key, _path, _row (a number for each row), _text, _values (see ``values_of``).
    """
    # split at the candidates: the pieces between them and the candidates alternate
    held = found.where("_values IS NOT NULL").select("_key", "_path", "_row", "_values", F.split("_text", CANDIDATE).alias("_gaps"))
    zipped = F.arrays_zip(F.col("_values").alias("value"), F.slice("_gaps", 1, F.size("_values")).alias("lead"), F.slice("_gaps", 2, F.size("_values")).alias("trail"))
    rows = held.select("_key", "_path", "_row", F.posexplode(zipped).alias("n", "x"))
    upto = F.length("x.lead") + F.length("x.value")
    sizes = rows.select("_key", "_path", "_row", F.col("n").cast("int").alias("n"), upto.alias("_upto"), F.col("x.value").alias("value"), F.right(F.col("x.lead"), F.lit(CONTEXT)).alias("before"), F.left(F.col("x.trail"), F.lit(CONTEXT)).alias("after"))
    whole = Window.partitionBy("_row").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return sizes.select("_key", "_path", "_row", "n", (F.sum("_upto").over(whole) - F.length("value")).alias("start"), "value", "before", "after")


def _share(pattern: str) -> Column:
    return F.length(F.regexp_replace("value", f"[^{pattern}]", "")) / F.length("value")


def described(found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Adds the features. ``vocabulary``: (word), lower-case words of the corpus that candidates' letter runs are looked up in."""
    keyed = found.withColumn("_id", F.struct("_row", "n"))
    runs = keyed.select("_id", F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{2,}"), F.lit(0))).alias("word"))
    covered = runs.join(vocabulary, "word").groupBy("_id").agg(F.sum(F.length("word")).alias("n_covered"))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[0-9]", "0"), "[a-z]", "a"), "[A-Z]", "A"), "[^0aA]", "-")
    name = F.lower(F.regexp_extract("before", r"([A-Za-z_\-]+)[\"']?\s*(?:[:=][=>]?)?\s*[\"']?$", 1))
    pairs = F.size(F.regexp_extract_all(F.lower("value"), F.lit("(?=(" + "|".join(USUAL_PAIRS) + "))"), F.lit(1)))
    return keyed.join(covered, "_id", "left").select(
        "_key", "_path", "_row", "n", "start", "value", "before", "after",
        F.length("value").cast("double").alias("length"),
        _share("0-9").alias("digit_share"),
        _share("A-Z").alias("upper_share"),
        _share("0-9a-fA-F").alias("hex_share"),
        (F.length(F.regexp_replace(classes, r"(.)\1*", "x")) / F.length("value")).alias("switches"),
        (pairs / F.length("value")).alias("usual_pairs"),
        (F.size(F.array_distinct(F.split("value", ""))) / F.length("value")).alias("distinct_share"),
        (F.coalesce("n_covered", F.lit(0)) / F.length("value")).alias("covered"),
        F.coalesce(F.regexp_like("_path", F.lit(SAMPLE_PATHS)), F.lit(False)).cast("double").alias("sample_path"),
        F.regexp_extract(name, "([a-z]*)$", 1).isin(*NAMES).cast("double").alias("named"),
        F.regexp_like("before", F.lit(r"[:=]>?\s*[\"']?$")).cast("double").alias("assigned"),
        (F.regexp_like("before", F.lit("[\"']$")) & F.regexp_like("after", F.lit("^[\"']"))).cast("double").alias("quoted"),
        F.regexp_like("before", F.lit(r"[A-Za-z]\s*$")).cast("double").alias("word_before"),
        name.alias("name"),
    )


def labelled(features: DataFrame, labels: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Adds ``label``, 1 for a secret and 0 for none; null findings are not trained on.

    ``labels``: (key, start, label), findings that people have judged; of several judgements of one the largest counts.
    Without it a rule judges: 1 where it holds, 0 where nothing speaks for a secret.
    """
    if labels is not None:
        judged = labels.select(F.col(key).alias("_key2"), F.col("start").cast("long").alias("_start"), F.col("label").cast("double").alias("label")).groupBy("_key2", "_start").agg(F.max("label").alias("label"))
        return features.join(judged, F.col("_key").eqNullSafe(F.col("_key2")) & (F.col("start") == F.col("_start")), "left").drop("_key2", "_start")
    mixed = (F.col("digit_share") >= 0.1) & (F.col("digit_share") < 1) & ~F.regexp_like("value", F.lit(r"\s"))
    strict = (F.col("named") == 1) & (F.col("assigned") == 1) & mixed
    nothing = (F.col("named") == 0) & (F.col("assigned") == 0) & (F.col("quoted") == 0)
    return features.withColumn("label", F.when(strict | fixed_form() | F.regexp_like("value", F.lit(KNOWN)), 1.0).when(nothing, 0.0))


def fixed_form() -> Column:
    """Whether a finding is a private-key block, a password in an address or a webhook's secret part."""
    address = F.regexp_like("before", F.lit(r"://[^\s/:@]*:$")) & F.regexp_like("after", F.lit("^@"))
    webhook = F.regexp_like("before", F.lit(r"(hooks\.slack\.com/services|discord(app)?\.com/api/webhooks)/$"))
    return F.col("value").startswith("-----BEGIN ") | address | webhook


def words_of_corpus(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(word): the letter runs of candidates that also stand in the corpus as words of their own, in two texts or more."""
    asked = found.select(F.explode(F.regexp_extract_all(F.lower("value"), F.lit("[a-z]{2,}"), F.lit(0))).alias("word")).distinct()
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text)), r"[^a-z]+"))).alias("word")).where(F.length("word").between(2, 40))
    return words.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").join(asked, "word", "left_semi").select("word")


def train(findings: DataFrame) -> PipelineModel | None:
    """The forest, fitted on labelled findings; None unless both labels occur."""
    findings = findings.where("label IS NOT NULL")
    sizes = {r[0]: r[1] for r in findings.groupBy("label").agg(F.count("*")).collect()}
    if len(sizes) < 2:
        return None
    draw = F.pmod(F.xxhash64("_key", "n", "value"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.when(F.col("label") == 1, min(1.0, TRAIN_FINDINGS / sizes[1.0])).otherwise(min(1.0, TRAIN_FINDINGS / sizes[0.0]))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=6, minInstancesPerNode=2)
    model = forest.fit(vectors.transform(findings.where(draw < share)).select("features", "label"))
    return PipelineModel([vectors, model])


def judge(features: DataFrame, model: PipelineModel | None) -> DataFrame:
    """Adds ``score``, the forest's probability of a secret, and ``is_secret``."""
    if model is None:
        scored = features.withColumn("score", F.coalesce("label", F.lit(0.0)))
    else:
        scored = model.transform(features).withColumn("score", F.element_at(vector_to_array("probability"), 2)).drop("features", "rawPrediction", "probability", "prediction")
    scored = scored.drop("label")
    scored = scored.withColumn("score", F.when(fixed_form(), 1.0).otherwise(F.col("score")))
    return scored.withColumn("is_secret", F.col("score") >= THRESHOLD)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", labels: DataFrame | None = None) -> DataFrame:
    """All candidates with their features, score and verdict; ``labels``: see ``labelled``."""
    of = (F.col(path) if path in docs.columns else F.lit(None)).cast("string")
    rows = docs.select(F.col(key).alias("_key"), of.alias("_path"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"))
    return _judged(rows.withColumn("_values", values_of("_text")), labels, key)


def _judged(rows: DataFrame, labels: DataFrame | None, key: str) -> DataFrame:
    found = settle(candidates(rows))
    features = settle(labelled(described(found, words_of_corpus(rows, found, "_text")), labels, key))
    return judge(features, train(features))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", mark: str = "[SECRET]", labels: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, as they are but for secrets in the text, each replaced by ``mark`` where it stands."""
    names = docs.columns
    column = lambda c: F.col(f"_doc.f{names.index(c)}") if c in names else F.lit(None).cast("string")
    # written once with a number for each row: the pattern runs once over a text, and verdicts find the row again
    doc = F.struct(*(F.col(f"`{c}`").alias(f"f{i}") for i, c in enumerate(names)))
    whole = settle(docs.select(doc.alias("_doc"), F.monotonically_increasing_id().alias("_row"), values_of(F.col(f"`{text}`")).alias("_values")))
    rows = whole.select(column(key).alias("_key"), column(path).cast("string").alias("_path"), "_row", column(text).alias("_text"), "_values")
    secret = _judged(rows, labels, key).where("is_secret").groupBy("_row").agg(F.collect_set("n").alias("_secret"))  # no more than a text's candidates
    checked = whole.where("_values IS NOT NULL").join(secret, "_row")
    gaps, last = F.split(column(text), CANDIDATE), F.size("_values")
    parts = F.transform(F.arrays_zip(F.slice(gaps, 1, last).alias("gap"), F.col("_values").alias("value")), lambda x, i: F.concat(x["gap"], F.when(F.array_contains("_secret", i), F.lit(mark)).otherwise(x["value"])))
    masked = checked.select("_doc", F.concat(F.array_join(parts, ""), F.element_at(gaps, -1)).alias("_masked"))
    kept = whole.where("_values IS NULL").select("_doc", F.lit(None).cast("string").alias("_masked"))
    left = whole.where("_values IS NOT NULL").join(secret, "_row", "left_anti").select("_doc", F.lit(None).cast("string").alias("_masked"))
    return kept.unionAll(left).unionAll(masked).select(*((F.coalesce("_masked", column(c)) if c == text else column(c)).alias(c) for c in names))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("_key").alias("doc_id"), "n", "start", F.length("value").cast("int").alias("length"), F.sha2("value", 256).alias("value_sha256"), "name", "score", "is_secret")


QUERIES = {"op6_secrets": op6_secrets}
SQL: dict[str, str] = {}
