import functools
import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowgrain.llm import repair as R
from flowgrain.llm.common import table
from flowgrain.llm.queries_models import damaged, op13
from flowgrain.llm.repair import Repaired, fix_up, packed, repair, speculate, trace

from .cases import SMALL, folder

SCHEMA = "conv_id long, turn long, role string, text string"
STOPS = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        role = "user" if fault == 4 else role
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def faults(rows):
    """First fault of each (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(STOPS)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen
                   else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def searched(rows):
    """(cost, audit, turns) by recursion over rows and states of the role pattern."""
    found, n = faults(rows), len(rows)
    go = {("", "u"): "u", ("", "s"): "s", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @functools.lru_cache(None)
    def best(i, state, inserted):
        ways = []
        if i == n and state in ("", "a"):
            ways.append((0, "", ()))
        if inserted < 2:
            for put in "ua":
                if (state, put) in go:
                    c, a, t = best(i, go[state, put], inserted + 1)
                    ways.append((c + 5, "I" + a, ((("user", "assistant")["ua".index(put)], ""), *t)))
        if i < n:
            _, role, text = rows[i]
            c, a, t = best(i + 1, state, 0)
            ways.append((c + 2, "D" + a, t))
            if found[i] not in ("blank", "duplicate"):
                more = 5 if found[i] else 0
                if (state, role[:1]) in go:
                    c, a, t = best(i + 1, go[state, role[:1]], 0)
                    ways.append((c + more, "K" + a, ((role, text), *t)))
                for name in ("user", "assistant"):
                    if (state, name[0]) in go:
                        c, a, t = best(i + 1, go[state, name[0]], 0)
                        ways.append((c + 1 + more, "R" + a, ((name, text), *t)))
        return min(ways) if ways else (1 << 40, "", ())

    return best(0, "", 0)


def enumerated(rows):
    """(cost, audit) by trying all edits of every row and all insertions of every gap."""
    found, best = faults(rows), (1 << 40, "")
    gaps = ["", "u", "a", "ua", "au"]
    for puts in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product("DKUA", repeat=len(rows)):
            cost, audit, roles = 5 * sum(map(len, puts)), "", ""
            for put, edit, fault, (_, role, _) in zip(puts, edits, found, rows):
                must = fault in ("blank", "duplicate")
                if must and edit != "D":
                    break
                audit += "I" * len(put) + {"D": "D", "K": "K"}.get(edit, "R")
                roles += put + {"D": "", "K": role[:1]}.get(edit, edit.lower())
                cost += {"D": 2, "K": 0}.get(edit, 1) + (5 if edit != "D" and fault else 0)
            else:
                audit, roles = audit + "I" * len(puts[-1]), roles + puts[-1]
                if re.fullmatch("(s?(ua)+)?", roles):
                    best = min(best, (cost, audit))
    return best


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def expected(rows):
    """Result rows by conversation from undamaged rows and damaged ones."""
    original, rows = rows
    out = {}
    for conv in {r[0] for r in original}:
        mine = ordered([r[1:] for r in rows if r[0] == conv])
        found = faults(mine)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        roles = [r[:1] for _, r, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        cost, audit, done = searched(tuple(mine))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in done).encode()).hexdigest()
        out[conv] = (gaps, *[found.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest)
    return out


def as_dict(got):
    rows = got.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


TEXTS = ["Yes.", "No!", "Why?", "cut off", "", " \n", "One. Two", "Three.", "Four.", "Five."]
ROLES = ["user", "assistant", "system", "tool", " "]


def drawn(seed, sizes):
    r = random.Random(seed)
    return [(c, r.choice([None, *range(n)]), r.choice(ROLES[:r.choice([2, 3, 5])]), r.choice(TEXTS) + r.choice(["", str(i) + "."]))
            for c, n in enumerate(sizes) for i in range(n)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.just(0), st.sampled_from(ROLES[:4]), st.sampled_from(TEXTS)), max_size=3))
def test_recursion_finds_the_least_of_all_edits(rows):
    assert searched(tuple(rows))[:2] == enumerated(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=12), st.integers(1, 5))
def test_chunks_agree_with_one_run(codes, size):
    end, guess = packed(R.END), packed((3, 0, 1, 2))
    whole = speculate(codes, end)
    vector, total = end, 0
    for low in reversed(range(0, len(codes), size)):
        part = codes[low:low + size]
        known = speculate(part, guess)
        vector, shift = fix_up(part, vector, guess, *known)
        total += shift
    assert (vector, total) == whole


def test_fix_up_stops_at_a_converged_vector(monkeypatch):
    codes, calls = [0, 1] * 500, []
    known = speculate(codes, packed(R.END))
    plain = R.before
    monkeypatch.setattr(R, "before", lambda *a: calls.append(1) or plain(*a))
    assert fix_up(codes, packed((0, 5, 0, 5)), packed(R.END), *known)[0] == known[0]
    assert len(calls) < 40


@pytest.mark.parametrize("size", [3, 128])
def test_repair_against_recursion(spark, size):
    rows = drawn(size, [1, 2, 3, 5, 8, 50])
    frame = spark.createDataFrame(rows, SCHEMA)
    assert as_dict(repair(frame, frame, size, group_rows=20)) == expected((rows, rows))


def test_chunks_that_never_converge(spark):
    rows = [(1, i, "user", f"same role {i}.") for i in range(61)]
    rows += [(2, i, "system", f"same role {i}.") for i in range(60)]
    rows += [(3, i, "user", "again.") for i in range(60)]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert as_dict(repair(frame, frame, 4)) == expected((rows, rows))


def test_query_against_recursion(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert as_dict(op13(spark, SMALL)) == expected((rows, damage(rows)))


def test_awkward_rows(spark, tmp_path):
    rows = drawn(5, [30] * 6) + [(None, None, None, None), (None, 1, "user", "Null id."), (50, None, "user", "Hi.")]
    rows += [(60, 5, "user", "Same."), (60, 5, "assistant", "Same turn.")] * 30 + [(70, 1, "user", "x" * 200_000 + ".")]
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA + ", audit string, pos int")
    assert as_dict(op13(spark, folder(tmp_path, spark, conversations=frame))) == expected((rows, damage(rows)))


def test_rows_all_dropped_and_empty_table(spark):
    turn = next(t for t in range(99) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    frame = spark.createDataFrame([(9, turn, "user", "Gone.")], SCHEMA)
    got = as_dict(repair(damaged(frame), frame))
    assert got == {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair(frame.where("turn < 0"), frame.where("turn < 0")).collect() == []


def test_turns_of_the_repaired_table(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hello."), (1, 2, "tool", "Found it."), (1, 3, "user", "More?")]
    done = Repaired(spark.createDataFrame(rows, SCHEMA)).turns().orderBy("pos", "i").collect()
    assert [(r.edit, r.role, r.text) for r in done] == [
        ("Keep", "system", "Be kind."), ("Keep", "user", "Hello."), ("Rerole", "assistant", "More?")]


def test_trace_of_a_chunk():
    assert trace([0, 1], [0, 2], packed(R.END), R.START, True) == (R.ASSISTANT, ["K", "KDD", ""], ["K", "K", ""])
    assert trace([], [], packed(R.END), R.USER, True) == (R.ASSISTANT, ["I"], ["a"])
