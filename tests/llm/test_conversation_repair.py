"""Conversation repair against all edits of short conversations and plain Python over whole tables."""

import hashlib
import itertools
import random
import re
import zlib

import pyarrow.parquet as pq
import pytest

from stareflow.llm import conversation_repair as repair

PATTERN = re.compile("(s?(ua)+)?")
ROWS = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, letters) by trying all edits; rows: (role, must go, truncated)."""
    gaps = [c for n in range(3) for c in itertools.product("ua", repeat=n)]
    choices = []
    for role, must, cut in rows:
        ways = [("D", 4, "")]
        if not must:
            more = 3 * cut
            ways += [("K", more, role[:1] or "-"), ("R", 3 + more, "u"), ("R", 3 + more, "a")]
        choices.append(ways)
    best = None
    for picked in itertools.product(*choices):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            initials = "".join(inserts[0]) + "".join(w[2] + "".join(g) for w, g in zip(picked, inserts[1:]))
            if not PATTERN.fullmatch(initials):
                continue
            cost = sum(w[1] for w in picked) + 3 * sum(map(len, inserts))
            letters = "I" * len(inserts[0]) + "".join(w[0] + "I" * len(g) for w, g in zip(picked, inserts[1:]))
            best = min(best or (cost, letters), (cost, letters))
    return best


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_edits_are_the_cheapest_and_least(n):
    kinds = "suaoSUAOx"
    all_of = list(itertools.product(kinds, repeat=n))
    rng = random.Random(n)
    asked = all_of if len(all_of) <= 100 else rng.sample(all_of, 40)
    answers, _ = repair.trie_answers({"".join(s) for s in asked})
    for s in asked:
        rows = [("u" if x == "x" else x.lower(), x == "x", x.isupper()) for x in s]
        assert answers["".join(s)] == cheapest(rows), s


def test_shared_prefixes_are_computed_once():
    answers, made = repair.trie_answers({"uaua", "uau", "uax", "s", "sua", ""})
    assert made == len({"u", "ua", "uau", "uaua", "uax", "s", "su", "sua"}) and answers[""] == (0, "")
    assert answers["uaua"] == (0, "KKKK") and answers["uau"] == (3, "KKKI")


def plain(rows):
    """The contract in plain Python; costs by a search over (row, state) with whole strings."""
    found = {}
    for conv_id, turn, role, text in rows:
        own = found.setdefault(conv_id, [])
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [(turn is not None, turn or 0, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv_id, own in found.items():
        own.sort()
        turns = {t for some, t, _, _ in own if some}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults, seen = [], set()
        for _, _, role, text in own:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        best = {"": (0, "", ())}  # state as the last initial; an empty one at the start
        step = {"": "su", "s": "u", "u": "a", "a": "u"}

        def inserted(cells):
            cells = dict(cells)
            for _ in range(3):
                for last, (cost, said, lines) in list(cells.items()):
                    for to in step[last].replace("s", ""):
                        new = (cost + 3, said + "I", (*lines, ("user:" if to == "u" else "assistant:")))
                        if to not in cells or new[:2] < cells[to][:2]:
                            cells[to] = new
            return cells

        for (_, _, role, text), fault in zip(own, faults):
            new = {}
            for last, (cost, said, lines) in inserted(best).items():
                ways = [(last, cost + 4, said + "D", lines)]
                if fault not in ("blank", "duplicate"):
                    cost += 3 * (fault == "truncated")
                    if role[:1] and role[:1] in step[last]:
                        ways.append((role[:1], cost, said + "K", (*lines, f"{role}:{text}")))
                    ways += [(to, cost + 3, said + "R", (*lines, f"{'user' if to == 'u' else 'assistant'}:{text}")) for to in step[last].replace("s", "")]
                for to, *cell in ways:
                    if to not in new or tuple(cell[:2]) < new[to][:2]:
                        new[to] = tuple(cell)
            best = new
        cost, said, lines = min((cell for last, cell in inserted(best).items() if last in ("", "a")), key=lambda c: c[:2])
        counts = (faults.count("blank"), faults.count("duplicate"), faults.count("truncated"))
        out[conv_id] = (gaps, *counts, illegal, cost, said, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def taken(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_query_equals_plain_python(spark, sf):
    folder = sf.replace("0.001", "0.01")
    want = plain(pq.read_table(f"{folder}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pandas().itertuples(index=False, name=None))
    got = taken(repair.op13_conversation_repair(spark, folder))
    assert got == want and {c for x in got.values() for c in x[6]} == set("DIKR")


def odd(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x."), (1, 3, "user", "a."), (1, 3, "user", "a."), (1, None, "assistant", "b."), (1, 9, "", "c"), (2, 1, "System", " \t"), (2, 2, "assistant", "é?" * 9)]
    rows += [(3, t, "user" if t % 3 else "tool", f"word {t % 7}{'.' * (t % 2)}") for t in range(900)] + [(4, 1, "assistant", "x" * 5_000_000), (4, 1, "assistant", "x" * 5_000_000)]
    rows += [(5 + i, 0, "user", "hi.") for i in range(40)]
    return spark.createDataFrame([(*r, 7, "s") for r in rows], f"{ROWS}, cost int, audit string"), rows


def test_odd_rows_and_streamed_conversations(spark):
    df, rows = odd(spark)
    want = plain(rows)
    hurt = repair.damaged(df)
    assert taken(repair.audit_conversations(hurt)) == want
    assert taken(repair.audit_conversations(hurt, long_rows=3)) == want
    assert taken(repair.audit_conversations(hurt, long_rows=1)) == want
    assert repair.audit_conversations(spark.createDataFrame([], ROWS)).count() == 0


def test_repaired_turns_are_what_the_audit_says(spark):
    df, rows = odd(spark)
    hurt = repair.damaged(df)
    audits = repair.audit_conversations(hurt)
    found = {}
    for r in repair.repaired_turns(hurt, audits).collect():
        found.setdefault(r.conv_id, []).append((r.place, r.edit, r.role, r.text))
    for a in audits.collect():
        own = sorted(found.get(a.conv_id, []))
        assert "".join(x[1] for x in own) == a.audit
        lines = "\n".join(f"{role}:{text}" for _, _, role, text in own if role is not None)
        assert hashlib.sha256(lines.encode()).hexdigest() == a.repaired_sha256
        assert PATTERN.fullmatch("".join(x[2][:1] for x in own if x[2] is not None))
