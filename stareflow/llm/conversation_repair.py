"""Conversation structure repair: cheapest edits by dynamic programming over a trie of signatures.

A conversation in order is a signature: one symbol for each row, its role's class and its first fault.
Edits keep, re-role or delete a row, or insert an empty one, until the role initials read
``(s?(ua)+)?``. That pattern is an automaton of four states in which each edit letter leads to one state,
so a layer of the programme, for a prefix of a signature, holds four cells: cost, the cell before and
the letters between. A task sorts the signatures of many conversations and walks them as a prefix
trie: a layer is computed once for each shared prefix, and an answer is read back at each terminal node.

Ties go to the least string of letters. All strings of a layer have taken the same number of rows and
end in a row's letter, so none is a prefix of another and the order of the four cells carries over to
the next layer: comparing strings takes their ranks alone.

Spark divides the rows by conversation and sorts them; a task streams through them. A hash of a whole
conversation is sequential, so one task reads a conversation's rows, but holds them only while they
are few: those of LONG_ROWS rows or LONG_CHARS characters are streamed with four running hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stareflow.llm.common import bounded, slices, small_batches, stored

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Costs of the edits; a truncated row that stays adds KEPT_TRUNCATED.
REROLE, DELETE, INSERT, KEPT_TRUNCATED = 3, 4, 3, 3
#: From so many rows or characters on a conversation is streamed and not held.
LONG_ROWS, LONG_CHARS = 50_000, 16 << 20
#: Characters of short conversations that are solved together.
TOGETHER = 4 << 20

#: States: nothing yet, after s, after u, after a. What each role's initial leads to.
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_FORCED = ("user", "user", "assistant", "user")
_NEXT = (2, 2, 3, 2)
#: Letters that complete a conversation from each state.
_LAST = ("", "II", "I", "")
_FAR = 1 << 60

#: Symbols of a signature: a row that must go, or its role's class, in capitals if it is truncated.
MUST_GO, OTHER = "x", "o"


def _choices(symbol: str) -> list[list[tuple[int, str] | None]]:
    """For each pair of states, the cheapest letters (ties: least) that lead over a row of this symbol."""
    found: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for state in range(4):
        at = state
        for n in range(3):
            ways = [(at, DELETE, "D")]
            if symbol != MUST_GO:
                more = KEPT_TRUNCATED * symbol.isupper()
                ways.append((_NEXT[at], REROLE + more, "R"))
                if symbol.lower() in _KEEP[at]:
                    ways.append((_KEEP[at][symbol.lower()], more, "K"))
            for to, cost, letter in ways:
                new = (n * INSERT + cost, "I" * n + letter)
                found[state][to] = min(found[state][to] or new, new)
            at = _NEXT[at]
    return found


#: All (state before, letters) that a cell may point to, so that a cell is one byte.
_TABLE = {s: _choices(s) for s in "suaoSUAOx"}
_STEPS = sorted({(p, way[1]) for t in _TABLE.values() for p in range(4) for way in t[p] if way})
_CODE = {step: i for i, step in enumerate(_STEPS)}

Layer = tuple[list[int], list[int], bytes]
START: Layer = ([0, _FAR, _FAR, _FAR], [0, 1, 2, 3], bytes(4))


def next_layer(layer: Layer, symbol: str) -> Layer:
    """The layer after one more row: costs, ranks of the cells' strings, and each cell's step."""
    costs, ranks, _ = layer
    table = _TABLE[symbol]
    new_costs, steps, order = [], [], []
    for to in range(4):
        best = None
        for p in range(4):
            way = table[p][to]
            if way is not None and costs[p] < _FAR:
                this = (costs[p] + way[0], ranks[p], way[1], p)
                if best is None or this < best:
                    best = this
        if best is None:
            new_costs.append(_FAR)
            steps.append(0)
            order.append((9, "", to))
        else:
            new_costs.append(best[0])
            steps.append(_CODE[best[3], best[2]])
            order.append((best[1], best[2], to))
    new_ranks = [0] * 4
    for r, (_, _, to) in enumerate(sorted(order)):
        new_ranks[to] = r
    return new_costs, new_ranks, bytes(steps)


def ending(layer: Layer) -> tuple[int, int]:
    """(cost, state) of the cheapest completion, ties to the least string."""
    costs, ranks, _ = layer
    return min((costs[s] + INSERT * len(_LAST[s]), ranks[s], s) for s in range(4))[::2]


def read_back(steps: list[bytes] | bytearray, state: int) -> str:
    """The letters that lead to state after all steps."""
    parts = [_LAST[state]]
    for i in range(len(steps) // 4 if isinstance(steps, bytearray) else len(steps), 0, -1):
        code = steps[4 * i - 4 + state] if isinstance(steps, bytearray) else steps[i - 1][state]
        state, letters = _STEPS[code]
        parts.append(letters)
    return "".join(reversed(parts))


def trie_answers(signatures: set[str]) -> tuple[dict[str, tuple[int, str]], int]:
    """(cost, letters) of each signature, and how many layers were computed.

    Sorted signatures are inserted one after another: the stack holds the layers on the way to the
    current node, and only the branch below the common prefix with the one before is new.
    """
    answers, path, before, made = {}, [START], "", 0
    for signature in sorted(signatures):
        shared = 0
        for x, y in zip(before, signature, strict=False):
            if x != y:
                break
            shared += 1
        del path[shared + 1 :]
        for symbol in signature[shared:]:
            path.append(next_layer(path[-1], symbol))
            made += 1
        cost, state = ending(path[-1])
        answers[signature] = cost, read_back([layer[2] for layer in path[1:]], state)
        before = signature
    return answers, made


def edited(rows: Iterator[tuple[str, str]], letters: str) -> Iterator[tuple[str, str | None, str | None]]:
    """(letter, role, text) for each edit: what the row becomes, without role for a deleted one."""
    state, rows = 0, iter(rows)
    for letter in letters:
        if letter == "I":
            yield letter, _FORCED[state], ""
            state = _NEXT[state]
            continue
        role, text = next(rows)
        if letter == "D":
            yield letter, None, None
        elif letter == "R":
            yield letter, _FORCED[state], text
            state = _NEXT[state]
        else:
            yield letter, role, text
            state = _KEEP[state][role[0]]


class _Held:
    """A conversation as its rows come: counts of faults and its signature."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.rows, self.seen = conv_id, [], set()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.signature, self.chars = [], 0
        self.least = self.last_turn = self.last_role = None
        self.turns = 0

    def symbol(self, turn: int | None, role: str, text: str, again: bool | None) -> str:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.least = turn if self.least is None else self.least
            self.last_turn = turn
        if self.last_role is not None and self.last_role + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_role = role[:1]
        if again is None:
            again = (role, text) in self.seen
            self.seen.add((role, text))
        said = text.rstrip(BLANKS)
        if not said:
            self.blank += 1
            return MUST_GO
        if again:
            self.duplicate += 1
            return MUST_GO
        kind = role[:1] if role[:1] in ("s", "u", "a") else OTHER
        if said[-1] in ENDS:
            return kind
        self.truncated += 1
        return kind.upper()

    def hold(self, turn, role, text) -> None:
        self.signature.append(self.symbol(turn, role, text, None))
        self.rows.append((role, text))
        self.chars += len(role) + len(text) + 100

    def counts(self) -> tuple:
        gaps = 0 if self.least is None else self.last_turn - self.least + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal


class _Streamed(_Held):
    """A long conversation: a byte for each cell, and a running hash for each of the four states."""

    def __init__(self, conv_id):
        super().__init__(conv_id)
        self.layer, self.steps = START, bytearray()
        self.hashes = [(hashlib.sha256(), False)] * 4

    def take(self, turn, role, text, again) -> None:
        self.layer = next_layer(self.layer, self.symbol(turn, role, text, again))
        self.steps += self.layer[2]
        new = []
        for to in range(4):
            if self.layer[0][to] >= _FAR:
                new.append(self.hashes[to])
                continue
            p, letters = _STEPS[self.layer[2][to]]
            new.append(_add(*self.hashes[p], _lines(p, letters, role, text)))
        self.hashes = new

    def answer(self) -> tuple:
        cost, state = ending(self.layer)
        digest, _ = _add(*self.hashes[state], _lines(state, _LAST[state], "", ""))
        return *self.counts(), cost, read_back(self.steps, state), digest.hexdigest()


def _lines(state: int, letters: str, role: str, text: str) -> list[str]:
    out = []
    for letter in letters:
        if letter == "I":
            out.append(_FORCED[state] + ":")
            state = _NEXT[state]
        elif letter != "D":
            out.append(f"{role if letter == 'K' else _FORCED[state]}:{text}")
    return out


def _add(digest, some: bool, lines: list[str]):
    if not lines:
        return digest, some
    digest = digest.copy()
    digest.update(("\n" * some + "\n".join(lines)).encode("utf-8", "surrogatepass"))
    return digest, True


_SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _solved(held: list[_Held]) -> Iterator[tuple]:
    """The conversations' rows of the result, their signatures solved in one trie."""
    answers, _ = trie_answers({"".join(h.signature) for h in held})
    for h in held:
        cost, letters = answers["".join(h.signature)]
        lines = "\n".join(f"{role}:{text}" for _, role, text in edited(h.rows, letters) if role is not None)
        yield *h.counts(), cost, letters, hashlib.sha256(lines.encode("utf-8", "surrogatepass")).hexdigest()


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SCHEMA.split(", ")]
    kinds = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    held: list[_Held] = []
    now: _Held | None = None
    size = 0
    for batch in batches:
        for part in slices(batch):
            for conv_id, turn, gone, role, text, again in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if isinstance(now, _Streamed):
                        yield out([now.answer()])
                    elif now is not None:
                        held.append(now)
                        size += now.chars + 500
                        if size >= TOGETHER:
                            yield out(list(_solved(held)))
                            held, size = [], 0
                    now = _Held(conv_id) if again is None else _Streamed(conv_id)
                if gone:
                    continue
                if again is None:
                    now.hold(turn, role, text)
                else:
                    now.take(turn, role, text, again)
    if isinstance(now, _Streamed):
        yield out([now.answer()])
    elif now is not None:
        held.append(now)
    if held:
        yield out(list(_solved(held)))


def _ready(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, gone, role, text) with the rules for nulls."""
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    text = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    return rows.select(*(F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")), gone.alias("gone"), *text)


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    order = [F.asc_nulls_first(c) for c in ("conv_id", *first, "turn", "role", "text")]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


def audit_conversations(rows: DataFrame, long_rows: int = LONG_ROWS, long_chars: int = LONG_CHARS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each
    conversation of rows(conv_id, turn, role, text).

    Rows stand by turn, nulls first, ties by role and text. A null role or text is one space, and a
    null conv_id is a conversation as any other. A row's first fault counts: blank, duplicate (role
    and text seen earlier), truncated (it does not end in ``.!?``). audit: the letters D, I, K, R of
    the cheapest edits, ties to the least string; repaired_sha256: hash of the lines role:text that
    they give. Rows with a true column gone, if there is one, only tell that their conversation is
    there: without other rows it has zeros, an empty audit and the hash of nothing. Other columns are
    ignored; an empty table gives an empty one. Conversations of long_rows rows or long_chars
    characters are streamed, and repeats in them are found by a window that spills.
    """
    rows = _ready(rows)
    size = F.sum(F.length("role").cast("long") + F.length("text") + 100)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), size.alias("chars"))
    long = stored(sizes.where((F.col("n") >= long_rows) | (F.col("chars") >= long_chars)).select(F.col("conv_id").alias("c")))
    n = long.count()
    found = rows.withColumn("again", F.lit(None).cast("boolean"))
    if n:
        long = bounded(long, 24, n)
        same = F.col("conv_id").eqNullSafe(F.col("c"))
        w = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
        streamed = rows.join(long, same, "left_semi").withColumn("again", F.row_number().over(w) > 1)
        found = found.join(long, same, "left_anti").unionByName(streamed)
    small_batches(rows.sparkSession)
    return _in_order(found).mapInArrow(_audit, _SCHEMA)


def repaired_turns(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): a row for each edit of audits in order, as
    audit_conversations() gives them for the same rows. place counts from 0; a deleted row has
    neither role nor text, a row that was inserted an empty text.

    The letters of a conversation stand before its rows in the same sorted stream, so a task holds
    the letters and no rows.
    """
    rows = _ready(rows).where(~F.col("gone")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    none = F.lit(None)
    heads = audits.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), F.col("audit").alias("text"))

    def run(batches):
        letters, at, place, state = "", 0, 0, 0
        for batch in batches:
            for part in slices(batch):
                out = []
                for conv_id, kind, _, role, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if not kind:
                        letters, at, state = text, 0, 0
                    while at < len(letters):
                        letter = letters[at]
                        if letter != "I" and not kind:
                            break  # the head: only what is inserted before the first row
                        at += 1
                        if letter == "D":
                            out.append((conv_id, at - 1, letter, None, None))
                        elif letter == "I":
                            out.append((conv_id, at - 1, letter, _FORCED[state], ""))
                            state = _NEXT[state]
                        else:
                            out.append((conv_id, at - 1, letter, role if letter == "K" else _FORCED[state], text))
                            state = _KEEP[state][role[0]] if letter == "K" else _NEXT[state]
                        if letter != "I":
                            kind = 0  # this row is done: what is inserted after it follows
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names=["conv_id", "place", "edit", "role", "text"])

    small_batches(rows.sparkSession)
    return _in_order(heads.unionByName(rows), "kind").mapInArrow(run, "conv_id long, place long, edit string, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) with one row in four damaged, by crc32 of conv_id:turn modulo 20:
    0 drops a row (it stays with gone true), 1 empties its text, 2 removes ``.!?`` from it, 3 repeats
    it, 4 sets its role to user. Nulls are one space, in that key too."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return rows.select(
        "conv_id",
        "turn",
        (kind == 0).alias("gone"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ENDS, "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged row by row and audited."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return audit_conversations(damaged(rows))
