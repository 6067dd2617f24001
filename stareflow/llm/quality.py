"""Quality rules by weak supervision.

Each rule looks at one measure of a whole text and votes good, votes bad or abstains. Expectation-
maximisation over the votes of all documents estimates how often each rule is right when it votes
(and how often it abstains) for good and for bad documents; a document is kept when its posterior
probability of being good is high enough. Only the counts of distinct vote patterns leave the
tasks: at most 3 to the number of rules rows, whatever the number of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stareflow.llm.common import map_batches, stored, utf8

#: Posterior quality from which a document is kept.
KEEP = 0.5
#: Before any vote is seen: the share of good documents, and how often a rule that votes calls a good
#: document bad (rules are precise) and a bad one good (each knows one kind of junk).
PRIOR_GOOD, GOOD_CALLED_BAD, BAD_CALLED_GOOD = 0.9, 0.01, 0.7
#: Weight of these against the votes, as a share of the documents.
PRIOR_WEIGHT = 0.1

SYMBOLS = b"#*$%&|<>"
#: Frequent words of the languages that the rule on common words knows.
COMMON = frozenset(
    "the of and to in is that for it with as on by at be are was from or this an a "
    "der die das und in zu den von mit ist nicht ein eine auf im sich "
    "le la les de des et un une du en que qui pour dans est par "
    "el los las y que del se con por una su al es lo".encode().split()
)

#: name, lowest measure that is good, highest that is good, below it bad, above it bad; None: no bound.
#: Between the good range and the bad bounds the rule abstains.
RULES = (
    ("length", "n_words", 80, None, 50, None),
    ("word_length", "mean_word", 2.5, 10.5, 2.0, 14.0),
    ("symbols", "symbols_per_word", None, 0.05, None, 0.25),
    ("duplicate_lines", "dup_line_share", None, 0.1, None, 0.35),
    ("repeats", "repeat_share", None, 0.2, None, 0.5),
    ("common_words", "common_share", 0.08, None, 0.01, None),
    ("letters", "letter_share", 0.75, None, 0.5, None),
    ("distinct_words", "distinct_share", 0.25, None, 0.08, None),
    ("sentences", "line_words", 4.0, None, 1.5, None),
)
VOTES = len(RULES)

_NOT_WORD = bytes(i for i in range(128) if not (chr(i).isalpha()))
_TAIL_BYTES = bytes(range(0x80, 0xC0))


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that are found twice or more in the text, the first included."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, len(words))
    m = len(number)
    if m < 2_000_000:
        key = (w[:-2] * m + w[1:-1]) * m + w[2:]
    else:  # m cubed would overflow: number the pairs first
        pair = np.unique(w[:-1] * m + w[1:], return_inverse=True)[1]
        key = pair[:-1] * m + w[2:]
    order = np.argsort(key, kind="stable")
    same = np.flatnonzero(np.diff(key[order]) == 0)
    if not len(same):
        return 0
    hit = np.zeros(len(w) + 1, np.int64)
    at = np.unique(np.concatenate([order[same], order[same + 1]]))
    hit[at] += 1
    hit[np.minimum(at + 3, len(w))] -= 1
    return int((np.cumsum(hit)[: len(w)] > 0).sum())


def measures(text: str | None) -> dict[str, float]:
    """The measures of one whole text; null is empty. Words end at space and \\x09 to \\x0D only."""
    raw = utf8(text)
    words = raw.split()
    n = len(words)
    chars = sum(map(len, words)) - (0 if raw.isascii() else len(b"".join(words)) - len(b"".join(words).translate(None, _TAIL_BYTES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()] if b"\n" in raw else ([raw] if words else [])
    repeats = repeat_words(words)
    common = sum(map(COMMON.__contains__, raw.lower().split()))
    letters = len(raw.translate(None, _NOT_WORD + _TAIL_BYTES))
    most = max(n, 1)
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeats,
        "mean_word": chars / most, "symbols_per_word": symbols / most, "dup_line_share": (len(lines) - len(set(lines))) / max(len(lines), 1), "repeat_share": repeats / most,
        "common_share": common / most, "letter_share": letters / max(chars, 1), "distinct_share": len(set(words)) / most ** 0.8, "line_words": n / max(len(lines), 1),
    }


def vote(found: dict[str, float]) -> int:
    """The votes of all rules as one number in base 3: 0 abstains, 1 good, 2 bad."""
    pattern = 0
    for _, measure, low, high, bad_low, bad_high in RULES:
        x = found[measure]
        bad = bad_low is not None and x < bad_low or bad_high is not None and x > bad_high
        good = (low is None or x >= low) and (high is None or x <= high)
        pattern = pattern * 3 + (2 if bad else 1 if good else 0)
    return pattern


def unfold(patterns: np.ndarray) -> np.ndarray:
    """Patterns as rows of votes."""
    return np.stack([patterns // 3 ** (VOTES - 1 - i) % 3 for i in range(VOTES)], axis=1)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Expectation-maximisation over counted vote patterns: the share of good documents, and for
    each rule the chances of abstain, good and bad, given a good and given a bad document.

    Prior counts keep a rule that never votes bad from being certain, and keep the good class good.
    """
    votes, n = unfold(patterns), float(counts.sum())
    seen = np.stack([np.bincount(votes[:, i], weights=counts, minlength=3) for i in range(VOTES)])
    abstain = (seen[:, 0] + 1) / (seen.sum(axis=1) + 2)
    prior = np.empty((2, VOTES, 3))
    prior[:, :, 0] = abstain
    prior[0, :, 1], prior[0, :, 2] = (1 - abstain) * (1 - GOOD_CALLED_BAD), (1 - abstain) * GOOD_CALLED_BAD
    prior[1, :, 1], prior[1, :, 2] = (1 - abstain) * BAD_CALLED_GOOD, (1 - abstain) * (1 - BAD_CALLED_GOOD)
    class_weight = PRIOR_WEIGHT * n * np.array([PRIOR_GOOD, 1 - PRIOR_GOOD])
    share, chance = PRIOR_GOOD, prior.copy()
    for _ in range(rounds):
        good = posterior(patterns, share, chance)
        new = np.empty_like(chance)
        for c, weight in enumerate((counts * good, counts * (1 - good))):
            for i in range(VOTES):
                new[c, i] = np.bincount(votes[:, i], weights=weight, minlength=3) + class_weight[c] * prior[c, i]
        new /= new.sum(axis=2, keepdims=True)
        new_share = (float(counts @ good) + class_weight[0]) / (n + class_weight.sum())
        done = abs(new_share - share) < 1e-10 and float(np.abs(new - chance).max()) < 1e-9
        share, chance = new_share, new
        if done:
            break
    return share, chance


def posterior(patterns: np.ndarray, share: float, chance: np.ndarray) -> np.ndarray:
    """The probability of a good document, given each pattern."""
    votes, rules = unfold(patterns), np.arange(VOTES)
    good = np.log(share) + np.log(chance[0, rules, votes]).sum(axis=1)
    bad = np.log1p(-share) + np.log(chance[1, rules, votes]).sum(axis=1)
    return 1 / (1 + np.exp(np.clip(bad - good, -700, 700)))


_MEASURED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, the five base measures, pattern) for each row."""

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [measures(t) for t in batch.column(1).to_pylist()]
            cols = [pa.array([f[m] for f in found], pa.int64()) for m in _MEASURED]
            return pa.RecordBatch.from_arrays([batch.column(0), *cols, pa.array([vote(f) for f in found], pa.int32())], names=["doc_id", *_MEASURED, "pattern"])

        return step

    own = docs.select(F.col("doc_id").cast("long"), "text")
    return map_batches(own, start, "doc_id long, " + ", ".join(f"{m} long" for m in _MEASURED) + ", pattern int")


def verdicts(rows: DataFrame) -> DataFrame:
    """(pattern, quality): the posterior of each vote pattern that rows(pattern) hold, fitted on all rows."""
    found = rows.groupBy("pattern").count().collect()  # 3 ** VOTES rows at most
    schema = T.StructType([T.StructField("pattern", T.IntegerType()), T.StructField("quality", T.DoubleType())])
    table = []
    if found:
        patterns, counts = np.array([r.pattern for r in found], np.int64), np.array([r["count"] for r in found], np.float64)
        order = np.argsort(patterns)
        patterns, counts = patterns[order], counts[order]
        share, chance = fit(patterns, counts)
        table = [(int(p), round(float(q), 9)) for p, q in zip(patterns, posterior(patterns, share, chance), strict=True)]
    return rows.sparkSession.createDataFrame(table, schema)


def judged(rows: DataFrame) -> DataFrame:
    """rows of measured() with quality, base_failed and kept; the rules are fitted on all rows."""
    out = rows.join(F.broadcast(verdicts(rows)), "pattern")  # 3 ** VOTES rows at most
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= KEEP))


def quality_rules(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, quality.

    A null or empty text has no words, fails the base rules and is not kept. Repeated rows get the
    same verdict each; null ids stay; other columns are ignored; an empty table gives an empty one.
    Very long texts are measured whole.
    """
    rows = stored(measured(docs))
    return judged(rows).select("doc_id", *_MEASURED, "base_failed", "kept", "quality")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep.

    Each text is measured once: its votes travel beside the row, so that rows that repeat an id are kept
    or lost each by its own text. Null, empty and wordless texts fail the base rules and are lost; null
    ids are documents like others; all columns are kept as they are; an empty table gives an empty one.
    Very long texts are measured whole.
    """
    pattern, failed = "__sf_pattern", "__sf_failed"

    def start():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [measures(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            bad = [f["n_words"] < 50 or 100 * f["n_repeat_words"] > 50 * f["n_words"] for f in found]
            cols = [*batch.columns, pa.array([vote(f) for f in found], pa.int32()), pa.array(bad, pa.bool_())]
            return pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, pattern, failed])

        return step

    schema = T.StructType([*docs.schema.fields, T.StructField(pattern, T.IntegerType()), T.StructField(failed, T.BooleanType())])
    rows = stored(map_batches(docs, start, schema))
    good = verdicts(rows.select(F.col(pattern).alias("pattern"))).where(F.col("quality") >= KEEP).select(F.col("pattern").alias(pattern))
    return rows.where(~F.col(failed)).join(F.broadcast(good), pattern, "left_semi").select(*docs.columns)  # 3 ** VOTES rows at most
