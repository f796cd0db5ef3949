"""Conversation repair against all edits of short conversations, SQL, and its own blocks."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest

from feedtide.llm import conversations as C
from feedtide.llm.oracle import CONVERSATIONS

SCHEMA = "conv_id bigint, turn bigint, role string, text string, place string, fault int"


def all_edits(rows):
    """(cost, audit, messages) of every way to edit `rows` (role, text, fault) with at most two inserts in a row."""
    def after(k, inserts):
        if inserts < 2:
            for role in ("user", "assistant"):
                for cost, audit, said in after(k, inserts + 1):
                    yield cost + 2, "I" + audit, [(role, ""), *said]
        if k == len(rows):
            yield 0, "", []
            return
        role, text, fault = rows[k]
        rest = list(after(k + 1, 0))
        for cost, audit, said in rest:
            yield cost + 3, "D" + audit, said
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                yield cost + more, "K" + audit, [(role, text), *said]
                for other in ("user", "assistant"):
                    yield cost + more + 2, "R" + audit, [(other, text), *said]
    return after(0, 0)


def right(said):
    initials = "".join(role[:1] or "?" for role, _ in said)
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def solve(rows, block):
    endings, cuts = C.Endings(), list(range(0, len(rows), block))
    for at in reversed(cuts):
        part = [(role[:1], fault) for role, _, fault in rows[at : at + block]]
        endings.add(at, len(part), C.block_weights(part))
    letters = dict(endings.letters())
    report = C.Walk(1)
    said = []
    for k, row in enumerate(rows):
        if k in letters:
            report.block(letters[k])
        said += report.row(*row)
    said += report.end()
    return report.cost, "".join(report.audit), said


@pytest.mark.parametrize("seed", range(40))
def test_cheapest_edits_of_short_conversations(seed):
    rnd = random.Random(seed)
    faults = ["fine", "fine", "truncated", "blank", "duplicate"]
    rows = [(rnd.choice(["user", "assistant", "system", "tool", "", "u"]), f"t{k}", rnd.choice(faults)) for k in range(rnd.randrange(1, 4))]
    best = min((cost, audit, said) for cost, audit, said in all_edits(rows) if right(said))
    for block in (1, 2, 128):
        assert solve(rows, block) == best


def test_blocks_of_any_size_give_the_same_edits():
    rnd = random.Random(5)
    rows = [(rnd.choice(["user", "assistant", "system"]), f"t{k}", rnd.choice(["fine", "fine", "fine", "truncated", "duplicate"])) for k in range(700)]
    whole = solve(rows, 700)
    assert right(whole[2]) and all(solve(rows, block) == whole for block in (1, 7, 128))


def compare(spark, rows):
    """The report of our damage equals the SQL; returns it by conv_id."""
    frame = spark.createDataFrame(rows, SCHEMA)
    found = C.repair_report(frame, C.damage(frame))
    connection = duckdb.connect()
    connection.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR, place VARCHAR, fault INT)")
    if rows:
        connection.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?, ?, ?)", rows)
    result = connection.execute(CONVERSATIONS)
    names = [d[0] for d in result.description]
    assert names == found.columns
    ours = {tuple(r) for r in found.collect()}
    theirs = result.fetchall()
    assert ours == set(theirs) and len(theirs) == len(ours) == found.count()
    return {r[0]: r for r in theirs}


def test_nulls_ties_repeats_and_long_conversations(spark):
    rnd = random.Random(3)
    rows = [(k, t, rnd.choice(["user", "assistant", "system", None, "tool"]), rnd.choice(["Yes.", "No", None, "", " \t", "a.b", f"Text {t}!"]), "x", 7) for k in range(60) for t in range(rnd.randrange(1, 7))]
    rows += [(None, 0, "user", "Hi.", None, None), (None, 1, None, "Yes.", None, None), (100, None, "user", "Ask?", "p", 1), (100, None, None, None, "p", 1)]
    rows += [(101, 5, "user", "Same.", "p", 1)] * 30 + [(102, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.", "p", 1) for t in range(400)]
    rows += [(103, 9, "user", "é" * 5000 + ".", "p", 1), (103, 12, "assistant", "ok.", "p", 1)]
    found = compare(spark, rows)
    assert set(found) == {*range(60), None, 100, 101, 102, 103}
    assert found[101][3] >= 28 and found[102][7].count("K") > 300


def test_dropped_conversation_and_empty_table(spark):
    key = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert compare(spark, [(key, 0, "user", "Gone.", "p", 1)])[key] == (key, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert compare(spark, []) == {}


def test_repaired_conversations_are_right(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi?"), (1, 3, "assistant", "Hello"), (2, 0, None, "x."), (3, 0, "user", None)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    said = [(r.conv_id, r.role, r.text) for r in C.repair(frame).orderBy("conv_id", "position").collect()]
    # of two edits that cost 2, the insert comes before the new role in ASCII order; nothing can stay of 3, and 2 costs less deleted
    assert said == [
        (1, "system", "Be kind."), (1, "user", "Hi."), (1, "assistant", ""), (1, "user", "Hi?"), (1, "assistant", "Hello"),
    ]


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    found = C.op13_conversation_repair(spark, folder)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    assert sorted(map(tuple, found.collect())) == sorted(connection.execute(CONVERSATIONS).fetchall())
