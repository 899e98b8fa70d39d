import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from corvane.llm import repair as R

from .conftest import SF

TURNS = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [] if kind == 0 else [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows):
    """conv_id to the answer, by trying all ways of each conversation row by row, ways cut only by state."""
    out = {}
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, t, role, text) for c, t, role, text in after if c == conv))
        own = [r[2:] for r in own]
        faults, seen = [], set()
        for _, role, text in own:
            said = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        ways = {("", ()): 0}  # audit and result to cost
        shape = re.compile(r"(s?(ua)*u?)?")
        insert = lambda w: {(a + "I", (*m, f"{r}:")): c + 2 for (a, m), c in w.items() for r in ("user", "assistant")}
        fits = lambda w: {(a, m): c for (a, m), c in w.items() if shape.fullmatch("".join(x[0] if x[0] in "sua" else "-" for x in m))}

        def widened(w):
            one = fits(insert(w))
            return w | one | fits(insert(one))  # noqa: B023

        for (_, role, text), fault in zip(own, faults, strict=True):
            after_row, extra = {}, fault == "truncated"
            for (a, m), c in widened(ways).items():
                after_row[a + "D", m] = c + 3
                if fault not in ("blank", "duplicate"):
                    after_row[a + "K", (*m, f"{role}:{text}")] = c + extra
                    for r in ("user", "assistant"):
                        after_row[a + "R", (*m, f"{r}:{text}")] = c + 2 + extra
            best = {}
            for (a, m), c in fits(after_row).items():
                state = (len(m) == 0, m[-1][0] if m else "")
                best.setdefault(state, []).append((c, a, m))
            ways = {(a, m): c for found in best.values() for c, a, m in sorted(found)[:1]}
        whole = re.compile(r"(s?(ua)+)?")
        cost, audit, made = min((c, a, m) for (a, m), c in widened(ways).items() if whole.fullmatch("".join(x[0] if x[0] in "sua" else "-" for x in m)))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def answers(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def conversations(seed, n):
    pick = random.Random(seed)
    texts = ["Yes.", "No!", "so", "", " \n", "Why?", "end. \t", "é", None]
    roles = ["user", "assistant", "assistant", "user", "system", "tool", "", None, "aide"]
    return [(c if c else None, pick.choice([t, t, t, t + 2, None]), pick.choice(roles[: pick.choice((2, 4, 9))]), pick.choice(texts)) for c in range(n) for t in range(pick.randint(1, 12))]


@pytest.mark.parametrize("segment", [1, 2, 256])
def test_against_brute_force(spark, monkeypatch, segment):
    """Segments of one, two and many rows, batches of three: what is carried from one to the next gives the same answers."""
    rows = conversations(7, 60)
    if segment < 256:
        monkeypatch.setattr(R, "SEGMENT", segment)
        monkeypatch.setattr(R, "BATCH_ROWS", 3)
    sorted_rows = R.with_faults(R.damaged(spark.createDataFrame(rows, TURNS))).select("conv_id", "turn", "role", "text", "gone", "fault")
    found = {}
    for batch in R.repair_batches(iter(sorted_rows.coalesce(1).sortWithinPartitions("conv_id", "gone", "turn", "role", "text", "fault").toArrow().to_batches())):
        found |= {r["conv_id"]: tuple(r.values())[1:] for r in batch.to_pylist()}
    assert answers(R.repair(R.damaged(spark.createDataFrame(rows, TURNS)))) == brute(rows)
    if segment == 256:
        return
    assert {k: v for k, v in found.items() if not repeats(rows, k)} == {k: v for k, v in brute(rows).items() if not repeats(rows, k)}


def repeats(rows, conv):
    """Whether rows of a conversation are equal after damage: then the test's own order of them may differ."""
    own = [r for r in damage(rows) if r[0] == conv]
    return len(own) != len(set(own))


def test_long_texts_and_long_conversations(spark):
    roles = ["user", "assistant", "user", "system"]
    rows = [(5, t, roles[t % 4], f"turn {t}" + "." * (t % 3)) for t in range(3_000)] + [(6, 1, "user", "x" * 2_000_000 + "."), (6, 2, "assistant", None)]
    found = answers(R.repair(R.damaged(spark.createDataFrame(rows, TURNS))))
    assert found == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], TURNS)
    assert R.repair(R.damaged(empty)).collect() == []
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello."), (None, None, None, None)]
    wide = spark.createDataFrame(rows, TURNS).selectExpr("*", *[f"'junk' AS `{c}`" for c in ("gone", "fault", "kind", "copy", "again", "seg", "audit", "cost")])
    found = answers(R.repair(R.damaged(wide)))
    assert found == brute(rows)
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    found = R.op11_repair(spark, SF)
    assert answers(found) == {r[0]: r[1:] for r in con.sql(f"select {', '.join(found.columns)} from ({R.OP11_SQL})").fetchall()}
