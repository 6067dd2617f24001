"""Secret scan: fixed patterns, and password guess cost for values in a credential context.

The patterns give the base spans, which always stay. The method looks at values that stand where a
credential is named (a wider context than the patterns'), and computes the least number of guesses,
in bits, over all ways to cut the value into words, dates, repeats, keyboard walks and brute-force
spans. A value that stays costly however it is cut is a secret; a sentence's next word is not.
A value that reaches beyond the base span in it is looked at as a whole, and its span added.
"""

from __future__ import annotations

import functools
import hashlib
import re
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stareflow.llm.bpe import RANKS, merges
from stareflow.llm.common import map_batches, utf8

#: Bits of guess cost from which a value in a credential context is a secret.
SECRET_BITS = 40.0
#: Bits that each further span of a value adds: where it starts and what it is.
SPAN_BITS = 2.0
KINDS = ("assign", "access", "hex", "guess")
MASK = "[REDACTED]"

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private|secret)[_ -]?key|auth(?:orization)?|bearer|credentials?)s?"""
    r"""["']?(?:\x20*[:=]\x20*(?:bearer\x20+|basic\x20+)?|\x20+is\x20+:?|\x20+(?=[^\x20\x09-\x0D]*[0-9]))["'`(\[]?([^\x20\x09-\x0D"'`<>,;()\[\]]{6,})""",
    re.A | re.I,
)
_USERINFO = re.compile(r"://[^\x20\x09-\x0D:/@]+:([^\x20\x09-\x0D:/@]{6,})@", re.A)
_ASSIGN_NEEDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_CONTEXT_NEEDS = (b"pass", b"pwd", b"secret", b"token", b"key", b"auth", b"bearer", b"credential")
_HEX_RUN = re.compile(rb"[0-9a-f]{24}")

_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")
_NEXT = {}
for _row in _ROWS:
    for _a, _b in zip(_row, _row[1:], strict=False):
        _NEXT.setdefault(_a, set()).add(_b)
        _NEXT.setdefault(_b, set()).add(_a)
_LEET = str.maketrans("@4301!$5+7", "aaeoiisstt")
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:19|20)\d\d)\Z", re.A)


@functools.cache
def words(path: str = RANKS) -> dict[str, int]:
    """A word's place by frequency: the rank of the vocabulary's lower-case word of three letters or more."""
    found: dict[str, int] = {}
    for token, rank in sorted(merges(path).ranks.items(), key=lambda x: x[1]):
        word = token.lstrip(b" ")
        if len(word) > 2 and word.isalpha() and word.islower() and word.isascii():
            found.setdefault(word.decode(), rank)
    return found


def _alphabet(value: str) -> float:
    """Bits of one brute-force character, by the classes of characters that the value has."""
    size = 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value) + 33 * any(not c.isalnum() and c.isascii() for c in value) + 100 * (not value.isascii())
    return log2(max(size, 10))


@functools.cache
def longest_word(path: str = RANKS) -> int:
    return max(map(len, words(path)), default=0)


def _run(low: str, at: int, period: int) -> tuple[int, int]:
    """The longest stretch around a place in which each character equals the one a period before it:
    (first, end), with the first period included."""
    first, end = at - period, at
    while first > 0 and low[first - 1] == low[first - 1 + period]:
        first -= 1
    while end < len(low) and low[end] == low[end - period]:
        end += 1
    return first, end


def _blocks_again(low: str, at: int, known: dict[int, tuple[int, int]]) -> list[tuple[int, int]]:
    """(period, end) for each block that ends at a place and stands there again: the block's length, two or
    more and not all of one character, and how far the repeats reach. Inside a stretch of one period only
    that period counts, not its multiples, whose repeats it covers. known keeps stretches between places."""
    found, head, ones = [], low[at : at + 2], at - 1
    if at and len(head) == 2 and head[0] == head[1] == low[at - 1]:
        run = known.get(1)
        if run is None or not run[0] <= at - 1 < run[1]:
            run = known[1] = _run(low, at, 1)
        ones = run[0]
    q = low.rfind(head, 0, at) if len(head) == 2 else -1
    while q >= 0:
        period = at - q
        if q >= ones:
            q = ones  # blocks of one character are runs
        elif low[q:at] == low[at : at + period]:
            stretch = known.get(period)
            if stretch is None or not stretch[0] <= q < at < stretch[1]:
                stretch = known[period] = _run(low, at, period)
            found.append((period, stretch[1]))
            q = min(q, stretch[0])  # what starts inside the stretch is a multiple of its period
        q = low.rfind(head, 0, q + 1) if q else -1
    return found


def guess_bits(value: str, ranks: dict[str, int], enough: float = float("inf"), most: int | None = None) -> float:
    """The least guess cost of the value in bits, over all its cuts into known and brute-force spans.

    Spans: a word of the vocabulary (most: the length of its longest), plain or with letters written as
    signs; a date; a run of one character, a keyboard walk (three characters or more, two bits for each
    turn), a block of several characters that comes again any number of times, and brute force. Places are taken in order, and
    each hands its cost on to where its spans end. A value that costs enough or more is given as enough:
    then places that cost so much need no further look, so long values end early or run regular.
    """
    n, low = len(value), value.lower()
    if len(low) != n:  # lower-casing can change the length of a few characters
        low = value
    most = max(map(len, ranks), default=0) if most is None else most
    plain, keys, each = low.translate(_LEET), low.translate(_SHIFTED), _alphabet(value)
    best = [0.0] + [float("inf")] * n  # the least cost of the first i characters
    via: list[object] = [None] * (n + 1)  # the run, walk or stretch by which it came
    brute = float("inf")  # the least cost where the last span is brute force
    stretches: dict[int, tuple[int, int]] = {}
    cheapest: dict[tuple[int, int, int], tuple[float, int]] = {}  # of a stretch's starts at a distance of whole periods
    same_end = walk_end = reach = 0

    def put(to: int, cost: float, how: object = None) -> None:
        nonlocal reach
        if cost < best[to]:
            best[to], via[to] = cost, how
            if cost < enough and to > reach:
                reach = to

    for i in range(n):
        if brute < best[i]:
            best[i], via[i] = brute, None
        if best[i] >= enough:
            if i >= reach and brute >= enough:
                return enough
            brute += each
            continue
        now = best[i] + SPAN_BITS
        brute = min(brute, now) + each
        for size in range(3, min(most, n - i) + 1):
            part = low[i : i + size]
            rank = ranks.get(part)
            if rank is None and (rank := ranks.get(plain[i : i + size])) is not None:
                rank = 2 * rank + 2
            if rank is not None:
                shape = 0.0 if value[i : i + size] == part else 1.0 if value[i + 1 : i + size] == part[1:] else 3.0
                put(i + size, now + log2(rank + 2) + shape)
        if value[i].isdigit():
            for size in (4, 6, 8, 10):
                if i + size <= n and _DATE.match(value[i : i + size]):
                    put(i + size, now + (7.0 if size == 4 else 15.5))
        # A place reached by a run, walk or repeat need not start the same one anew: going on costs less.
        if i >= same_end:
            same_end = i + 1
            while same_end < n and low[same_end] == low[i]:
                same_end += 1
        if via[i] != ("run", same_end):
            for end in range(i + 3, same_end + 1):
                put(end, now + each + log2(end - i), ("run", same_end))
        if i >= walk_end:
            walk_end = i + 1
            while walk_end < n and keys[walk_end] in _NEXT.get(keys[walk_end - 1], ()):
                walk_end += 1
        if via[i] != ("walk", walk_end):
            turns, before = 0, 0
            for end in range(i + 2, walk_end + 1):
                step = ord(keys[end - 1]) - ord(keys[end - 2])
                turns += step * before < 0
                before = step
                if now + 2 * turns >= enough:
                    break
                if end >= i + 3:
                    put(end, now + log2(47) + log2(end - i) + 2 * turns, ("walk", walk_end))
        for period, end in _blocks_again(low, i, stretches):
            if via[i] != (period, end):
                times = (end - i) // period
                start = cheapest.get((period, end, i % period))
                if start is None or now <= start[0]:
                    cheapest[period, end, i % period] = now, i
                else:  # each block counts for less the more there are, so the cheaper start is ahead from some count on
                    ratio = 2.0 ** min(now - start[0], 60.0) - 1.0
                    times = min(times, int((i - start[1]) // period / ratio) + 1) if ratio > 1e-9 else times
                for t in range(1, times + 1):
                    put(i + t * period, now + log2(t + 1), (period, end))
    return min(best[n], brute, enough)


def find(text: str | None, ranks: dict[str, int], longest: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """The text's spans as (start, place of the kind in KINDS, end, and start and end of the secret
    itself), in that order. Starts and ends count code points, ends exclusive. longest: the length of
    the longest of the words."""
    if not text:
        return []
    raw = utf8(text)
    low = raw.lower()
    found = []
    if any(x in low for x in _ASSIGN_NEEDS):
        found += [(m.start(), 0, m.end(), *m.span(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if _HEX_RUN.search(raw):
        found += [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text)]
    known, at, reach = sorted(x[3:] for x in found), 0, 0
    wider = []
    if any(x in low for x in _CONTEXT_NEEDS):
        wider += [m.span(1) for m in _CONTEXT.finditer(text)]
    if b"://" in raw:
        wider += [m.span(1) for m in _USERINFO.finditer(text)]
    for start, end in sorted(set(wider)):
        while end > start and text[end - 1] in ".:!?":
            end -= 1
        while at < len(known) and known[at][0] <= start:
            reach = max(reach, known[at][1])  # how far secrets that begin no later go
            at += 1
        if end - start >= 6 and end > reach and guess_bits(text[start:end], ranks, SECRET_BITS, longest) >= SECRET_BITS:
            reach = end
            found.append((start, 3, end, start, end))
    return sorted(found)


def masked(text: str, spans: list[tuple[int, int, int, int, int]]) -> str:
    """The text with the secret itself of each span replaced by MASK; what overlaps is replaced once."""
    out, at = [], 0
    for start, end in sorted(x[3:] for x in spans):
        if start >= at:
            out += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess.

    spans: kind:start:end of all spans, by start, then kind in the order of KINDS, comma-joined;
    base_sha256 is the digest of the same over the first three kinds. A null or empty text has no
    span and the digest of an empty string. Repeated rows and null ids stay; other columns are
    ignored; an empty table gives an empty one. Texts are scanned whole, in time that grows with their
    length and the words in it, however many secrets or repeats they hold.
    """

    def start():
        ranks, longest = words(path), longest_word(path)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [find(t, ranks, longest) for t in batch.column(1).to_pylist()]
            said = [[(k, f"{KINDS[k]}:{s}:{e}") for s, k, e, *_ in x] for x in found]
            counts = [pa.array([sum(k == kind for k, _ in x) for x in said], pa.int64()) for kind in range(4)]
            base = [hashlib.sha256(",".join(t for k, t in x if k < 3).encode()).hexdigest() for x in said]
            told = [pa.array(base, pa.string()), pa.array([",".join(t for _, t in x) for x in said], pa.string())]
            return pa.RecordBatch.from_arrays([batch.column(0), *counts[:3], *told, counts[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

        return step

    own = docs.select(F.col("doc_id").cast("long"), "text")
    return map_batches(own, start, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document."""
    return scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with each secret replaced by MASK, and n_chars counted anew.

    No row is lost: null and empty texts, repeated rows and null ids stay as they are, and so do all other
    columns, whatever their names. An empty table gives an empty one. Texts are scanned whole.
    """

    def start():
        ranks, longest = words(RANKS), longest_word(RANKS)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            spans = [find(t, ranks, longest) for t in texts]
            texts = [masked(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            cols = list(batch.columns)
            cols[at] = pa.array(texts, batch.schema.field(at).type)
            return pa.RecordBatch.from_arrays(cols, schema=batch.schema)

        return step

    out = map_batches(docs, start, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
