import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from opsloom.llm import dialogue

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def expected(rows):
    """One conversation's results by a plain forward search over (cost, audit, lines)."""
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for _, t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(SPACE)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    turn = {0: 2, 1: 2, 2: 3, 3: 2}
    names = {2: "user", 3: "assistant"}
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(best):
        for _ in range(3):
            for s, (cost, audit, lines) in list(best.items()):
                t = turn[s]
                new = (cost + 2, audit + "I", lines + (names[t] + ":",))
                if t not in best or new < best[t]:
                    best[t] = new
        return best

    best = inserted({0: (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        new = {}
        for s, (cost, audit, lines) in best.items():
            ways = [(s, 3, "D", ())]
            if fault in ("", "truncated"):
                extra = 1 if fault else 0
                ways.append((turn[s], 2 + extra, "R", (f"{names[turn[s]]}:{text}",)))
                if (s, role[:1]) in keep:
                    ways.append((keep[s, role[:1]], extra, "K", (f"{role}:{text}",)))
            for t, more, letter, line in ways:
                way = (cost + more, audit + letter, lines + line)
                if t not in new or way < new[t]:
                    new[t] = way
        best = inserted(new)
    cost, audit, lines = min(best[s] for s in (0, 3) if s in best)
    turns = [t for t, _, _ in rows if t is not None]
    pairs = zip(rows, rows[1:])
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": faults.count("blank"),
            "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
            "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs),
            "cost": cost, "audit": audit, "sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest() if lines else None,
            "lines": [tuple(x.split(":", 1)) for x in lines]}


def make(rng, size):
    roles = ["user", "assistant", "system", "User", "", None, "tool", "user", "assistant"]
    texts = ["Fine.", "No end", "", " \t", None, "Why?\n", "a:b.", "Fine.", "x!"]
    return [(None if rng.random() < 0.1 else i * 2 if rng.random() < 0.2 else i, rng.choice(roles),
             f"text {rng.randrange(6)}." if rng.random() < 0.5 else rng.choice(texts)) for i in range(size)]


@pytest.mark.parametrize("rows, fan", [(8, 8), (1, 1)])
def test_repairs_equal_a_plain_search(spark, shared, monkeypatch, rows, fan):
    monkeypatch.setattr(dialogue, "ROWS", rows)
    monkeypatch.setattr(dialogue, "FAN", fan)
    rng = random.Random(rows)
    convs = {c: make(rng, size) for c, size in zip([None, *range(1, 40)], itertools.cycle([1, 2, 3, 5, 9, 17, 40]))}
    data = [(c, *r) for c, rs in convs.items() for r in rs]
    rng.shuffle(data)
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    for clash in ("conv", "pos", "code", "block", "edit", "n", "exits", "id"):
        df = df.withColumn(clash, F.lit("clash"))
    repair = dialogue.Repair(df)
    digests = {r.conv_id: r.sha256 for r in repair.digests().collect()}
    lines = {}
    for r in repair.repaired().orderBy("number").collect():
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: {**r.asDict(), "sha256": digests.get(r.conv_id), "lines": lines.get(r.conv_id, [])} for r in repair.summary().collect()}
    want = {c: {"conv_id": c, **expected([(c, *r) for r in rs])} for c, rs in convs.items()}
    assert got == want


def test_prices_are_costs_to_the_exit():
    """The auction's prices equal shortest distances by repeated relaxation, from every node."""
    rng = random.Random(4)
    for _ in range(300):
        rows = [(rng.randrange(4), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(0, 9))]
        tail = rng.random() < 0.5
        exits = rng.choice([list(dialogue.FINAL), [rng.randrange(9) for _ in range(4)],
                            [0 if t == e else dialogue.FAR for e in [rng.randrange(4)] for t in range(4)]])
        n = len(rows)
        least = [[dialogue.FAR] * 4 for _ in range(n)] + [list(exits)]
        for _ in range(4 * n + 8):
            for i in range(n, -1, -1):
                for s in range(4):
                    for _, cost, j, t in dialogue._arcs(rows, i, s, tail):
                        least[i][s] = min(least[i][s], cost + least[j][t])
        assert dialogue.converge(rows, exits, tail) == least


def test_one_long_conversation_and_long_texts(spark, shared):
    """A conversation over several blocks of full size, and a text of megabytes."""
    rng = random.Random(9)
    rows = [(7, i, rng.choice(["user", "assistant", "user"]), f"line {rng.randrange(900)}" + rng.choice([".", "", "!"])) for i in range(1_500)]
    rows += [(8, 0, "user", "a" * 3_000_000 + "."), (8, 1, "user", "b" * 2_000_000)]
    repair = dialogue.Repair(spark.createDataFrame(rows, SCHEMA).repartition(4))
    digests = {r.conv_id: r.sha256 for r in repair.digests().collect()}
    for r in repair.summary().collect():
        want = expected([x for x in rows if x[0] == r.conv_id])
        assert {**r.asDict(), "sha256": digests[r.conv_id]} == {"conv_id": r.conv_id, **{k: v for k, v in want.items() if k != "lines"}}


def test_damage_and_empty_tables(spark, shared):
    rows = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(4)] + [(None, None, None, None), (3, None, "user", "x")]
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        z = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if z == 4 else role, "" if z == 1 else text.translate({ord(x): None for x in ".!?"}) if z == 2 else text)
        want += [row] * (0 if z == 0 else 2 if z == 3 else 1)
    got = [tuple(r) for r in dialogue.damage(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    none = dialogue.Repair(spark.createDataFrame([], SCHEMA))
    assert none.summary().count() == none.digests().count() == none.repaired().count() == 0


def test_sql_and_query_agree(spark, shared, data):
    import duckdb

    from opsloom.llm.queries import QUERIES, SQL
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    df = QUERIES["op12_conversation_repair"](spark, data)
    cur = con.execute(SQL["op12_conversation_repair"])
    names = [d[0] for d in cur.description]
    theirs = [tuple(dict(zip(names, r))[c] for c in df.columns) for r in cur.fetchall()]
    assert sorted(map(tuple, df.collect())) == sorted(theirs)
