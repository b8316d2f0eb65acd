"""op11 against a search over all edits, on conversations of all kinds, whole and cut into small segments."""

import hashlib
import random
import re
import sys
import zlib
from functools import cache

import pytest

from pitchlake.llm.conversation_repair import damage, repair

sys.setrecursionlimit(20_000)
SCHEMA = "conv_id long, turn long, role string, text string, key string, n long"
WORD, LAST = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        space = lambda v: " " if v is None else str(v)
        role, text = space(role), space(text)
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        if not WORD.search(text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if LAST.search(text) else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """(cost, letters) of the least edits, and the repaired lines, by trying every edit at every place."""
    n = len(rows)

    def fits(initials):
        return re.fullmatch(r"(s?(ua)+)?", initials) is not None

    def onward(done, c):  # what comes last decides what may follow
        return c in {"": "su", "s": "u", "u": "a", "a": "u"}[done]

    @cache
    def best(i, done, inserted):
        out = []
        if i == n and fits({"": "", "s": "s", "u": "u", "a": "ua"}[done]):
            out.append((0, "", ()))
        if inserted < 3:
            for role in ("user", "assistant"):
                if onward(done, role[0]):
                    c, x, lines = best(i, role[0], inserted + 1)
                    out.append((c + 2, "I" + x, (f"{role}:", *lines)))
        if i < n:
            _, _, role, text = rows[i]
            c, x, lines = best(i + 1, done, 0)
            out.append((c + 3, "D" + x, lines))
            if kinds[i] in ("", "truncated"):
                extra = int(kinds[i] == "truncated")
                if role[:1] in ("s", "u", "a") and onward(done, role[0]):
                    c, x, lines = best(i + 1, role[0], 0)
                    out.append((c + extra, "K" + x, (f"{role}:{text}", *lines)))
                for made in ("user", "assistant"):
                    if onward(done, made[0]):
                        c, x, lines = best(i + 1, made[0], 0)
                        out.append((c + extra + 2, "R" + x, (f"{made}:{text}", *lines)))
        return min(out, default=(10**9, "", ()))

    return best(0, "", 0)


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in damaged(rows) if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        kinds = faults(mine)
        cost, audit, lines = cheapest(mine, kinds)
        turns = [r[1] for r in mine if r[1] is not None]
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest()
        )
    return out


def conversations(seed):
    rng, out = random.Random(seed), []
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant", "S"]
    texts = ["Hello.", "Why?", "no end", "", " \t\n", None, "Yes!", "a.\n ", "é…", "x" * 3000 + "."]
    for conv in [None, *range(60)]:
        n = rng.choice([0, 1, 2, 3, 5, 8, 14])
        for turn in rng.sample(range(40), n):
            text = rng.choice(texts)
            if text and rng.random() < 0.6:
                text = f"{rng.randrange(10**6)} {text}"
            out.append((conv, None if not turn else turn, rng.choice(roles), text))
        if n == 0:
            out.append((conv, next(t for t in range(1000) if zlib.crc32(f"{' ' if conv is None else conv}:{t}".encode()) % 20 == 0), "user", "gone."))
    return out


def check(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair(damage(df), df, **how).collect()}
    assert got == expected(rows)


@pytest.mark.parametrize("segment_rows", [1, 3, 1 << 16])
def test_against_a_search_over_all_edits(spark, segment_rows):
    check(spark, conversations(segment_rows), segment_rows=segment_rows)


def test_one_conversation_holds_most_rows(spark):
    rng = random.Random(4)
    hot = [(700, t, rng.choice(["user", "assistant", "assistant"]), rng.choice(["same.", f"{t} text.", f"{t} text"])) for t in range(300)]
    check(spark, hot + conversations(9), segment_rows=16)


def test_equal_rows_of_one_turn(spark):
    rows = [(1, 5, "user", "again and again.")] * 40 + [(1, 6, "assistant", "Yes.")] + [(2, None, "user", "a.")] * 3
    check(spark, rows, segment_rows=8)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert repair(damage(df), df).collect() == []


def test_ids_may_be_text(spark):
    df = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes."), (None, 0, "system", "S.")], "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: (r["audit"], r["cost"]) for r in repair(df).collect()}
    assert got == {"a": ("KK", 0), None: ("D", 3)}
