"""Reference stripping chunk by chunk against the batch expression, for every way to split a text."""

import itertools
import random

from pyspark.sql import functions as F

from stareflow.operators import sequences as seq
from stareflow.streaming import references

TEXTS = [
    "See [[event:12]] and [[section:x], [judgment:y]] here.",
    "a[[x]]b]]c d [[open\nnext ]] line [[ok]]",
    "[[[a]] b]] [[[ c",
    "[[a [[b]]c d]]e",
    "tail [",
    "[",
    "[[never closed and more words",
    "x]] y",
    "one two",
    "w[[p q]]z[[r",
    "\t[[k]]\n\n]]",
    "[[é]]ü ]]\x0b[[ü",
    "",
]


def batch(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return {r.i: r.s for r in df.select("i", seq.without_references(F.col("t")).alias("s")).collect()}


def fold(chunks):
    held, out = "", ""
    for i, c in enumerate(chunks):
        said, held = references.fed(held, c, i == len(chunks) - 1)
        out += said
    assert held == ""
    return out


def splits(text, rng):
    n = len(text)
    yield [text]
    yield list(text) or [""]
    for i in range(1, n):
        yield [text[:i], text[i:]]
    for i, j in itertools.combinations(range(1, n), 2):
        yield [text[:i], text[i:j], text[j:]]
    for _ in range(30):
        cuts = sorted(rng.choices(range(n + 1), k=rng.randrange(1, 9)))
        yield [text[a:b] for a, b in zip([0, *cuts], [*cuts, n])]


def test_every_split_shows_what_the_batch_shows(spark):
    rng = random.Random(6)
    texts = TEXTS + ["".join(rng.choice("[[]] ab\n") for _ in range(rng.randrange(5, 40))) for _ in range(150)]
    want = batch(spark, texts)
    for i, text in enumerate(texts):
        for chunks in splits(text, rng):
            assert fold(chunks) == want[i], (text, chunks)


def test_what_is_shown_early_is_no_part_of_a_reference():
    held, out = "", []
    for c in "The [[event:1]] case; more ":
        said, held = references.fed(held, c, False)
        out.append(said)
    assert "".join(out) == "The  case; more " and held == ""


def test_as_a_stream(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for i, text in enumerate(TEXTS):
        chunks = list(splits(text, rng))[-1]
        rows += [(f"s{i}", j, c if c or j % 2 else None, j == len(chunks) - 1) for j, c in enumerate(chunks)]
    schema = "stream_id string, seq long, text string, last boolean"
    half = max(r[1] for r in rows) // 2  # two batches: state is carried over
    for n, part in enumerate(([r for r in rows if r[1] <= half], [r for r in rows if r[1] > half])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = references.stripped_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        run.awaitTermination(180)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect():
        got[r.stream_id] = got.get(r.stream_id, "") + r.shown
    want = batch(spark, TEXTS)
    assert got == {f"s{i}": want[i] for i in range(len(TEXTS))}
