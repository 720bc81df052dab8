"""Repair of conversation structure: the cheapest edits that give a conversation legal roles.

Legal roles are nothing, or ``(system)? (user assistant)+``; only a role's first character counts. Places between the rows
times the states of that pattern form a lattice, whose arcs are the edits: Keep 0, Rerole 2, Delete 3, Insert 2, and 1 more
for a truncated row that stays. Blank and duplicate rows can only be deleted.

The cheapest edits come from an auction. Every node has a price, never above the cost of an arc plus the price at its end. A
path grows from its last node over an arc that attains that bound; where the price is below every arc's bound it is raised to
the least, and the path shrinks by that node. Paths start at the nodes next to the exit first, so each soon meets nodes whose
prices have converged, and then all its nodes have. Converged prices are costs to the exit: the tight arcs are exactly those of
cheapest repairs, and following the least letter among them traces the first of these.

A conversation is cut into blocks of 256 rows. Where it has several, a block's price matrix (state to state) stands for it:
products of matrices, in groups of 256 blocks and then groups of groups, bring to each block the prices at its exit; the states
in which the traced path crosses the blocks are found likewise. So no task holds a whole conversation's lattice. Texts aren't part of
that: they are shuffled once, to meet their edits in order, and stream through. (A digest over a whole conversation is a
sequential sum; its rows pass through one task, one at a time.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsloom.llm.merkle import _place
from opsloom.llm.text import SPACES
from opsloom.session import cut_lineage

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of a block, and blocks of a group, as powers of two.
ROWS, FAN = 8, 8

#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The state that an inserted or reroled row leads to.
TURN = (USER, USER, ASSISTANT, USER)
#: The state that a kept row leads to, by its initial: other, s, u, a.
KEPT = ((None, SYSTEM, USER, None), (None, None, USER, None), (None, None, None, ASSISTANT), (None, None, USER, None))
LEGAL_PAIRS = {(1, 2), (2, 3), (3, 2)}
FAR = 1 << 60
FINAL = (0, FAR, FAR, 0)

#: A row of the lattice: its initial, whether it must go, whether it is truncated.
Row = tuple[int, bool, bool]


# --- the auction on one block --------------------------------------------------------------------

def _arcs(rows: Sequence[Row], i: int, s: int, tail: bool) -> list[tuple[str, int, int, int]]:
    """(letter, cost, place, state) of the edits at a node, in the order of their letters."""
    turn = TURN[s]
    if i == len(rows):
        return [("I", INSERT, i, turn)] if tail else []
    initial, must_go, cut = rows[i]
    arcs = [("D", DELETE, i + 1, s), ("I", INSERT, i, turn)]
    if not must_go:
        extra = TRUNCATED if cut else 0
        if KEPT[s][initial] is not None:
            arcs.append(("K", KEEP + extra, i + 1, KEPT[s][initial]))
        arcs.append(("R", REROLE + extra, i + 1, turn))
    return arcs


def converge(rows: Sequence[Row], exits: Sequence[int], tail: bool) -> list[list[int]]:
    """Converged prices of all nodes (place, state): the least cost from there to an exit.

    ``exits`` are the costs of leaving after the last row, by state. Only the tail of a conversation may insert there; before
    it, the first place of the next block is the same place.
    """
    n = len(rows)
    if exits[USER] >= FAR and exits[ASSISTANT] >= FAR:
        states = [s for s in (START, SYSTEM) if any(exits[t] < FAR for t in range(s, USER))]  # no way back from later states
    else:
        states = list(STATES)
    price = [[FAR] * 4 for _ in range(n + 1)]
    settled = [[s not in states for s in STATES] for _ in range(n + 1)]
    # To begin with: what every path pays for the rows still to come.
    floor = min(exits[s] for s in states) if states else FAR
    for i in range(n, -1, -1):
        if i < n:
            _, must_go, cut = rows[i]
            floor += DELETE if must_go else TRUNCATED if cut else 0
        for s in states:
            price[i][s] = min(floor, FAR)
    for origin in range(n, -1, -1):
        for state in states:
            if settled[origin][state]:
                continue
            path = [(origin, state)]
            while path:
                i, s = path[-1]
                least, target = (exits[s], None) if i == n else (FAR, None)
                for _, cost, j, t in _arcs(rows, i, s, tail):
                    if cost + price[j][t] < least:
                        least, target = cost + price[j][t], (j, t)
                if least >= FAR:  # no exit can be reached
                    price[i][s], settled[i][s] = FAR, True
                    path.pop()
                elif price[i][s] < least:
                    price[i][s] = least
                    if len(path) > 1:
                        path.pop()
                elif target is None or settled[target[0]][target[1]]:
                    for j, t in path:
                        settled[j][t] = True
                    break
                else:
                    path.append(target)
    return price


def trace(rows: Sequence[Row], price: Sequence[Sequence[int]], exits: Sequence[int], tail: bool, state: int) -> tuple[int, list[str]]:
    """State at the exit, and the edits of each row, along the tight arcs of least letters from ``state``.

    A row's edits are ``u`` or ``a`` for rows inserted before it, then ``D``, ``K``, or ``U`` or ``A`` for its new role; rows
    inserted after the last one follow its letter.
    """
    edits, now, i, s = [], "", 0, state
    while True:
        if i == len(rows) and exits[s] == price[i][s]:
            if now:
                edits.append((edits.pop() if edits else "") + now)
            return s, edits
        letter, _, j, t = next(a for a in _arcs(rows, i, s, tail) if a[1] + price[a[2]][a[3]] == price[i][s])
        if letter == "I":
            now += ROLE[t][0]
        else:
            edits.append(now + (ROLE[t][0].upper() if letter == "R" else letter))
            now = ""
        i, s = j, t


def matrix(rows: Sequence[Row], tail: bool) -> list[int]:
    """Least costs from each state before the block to each state after it, row by row."""
    ends = [converge(rows, [0 if t == end else FAR for t in STATES], tail)[0] for end in STATES]
    return [ends[t][s] for s in STATES for t in STATES]


def _then(a: Sequence[int], b: Sequence[int]) -> list[int]:
    return [min(FAR, min(a[4 * s + u] + b[4 * u + t] for u in STATES)) for s in STATES for t in STATES]


def _before(a: Sequence[int], exits: Sequence[int]) -> list[int]:
    return [min(FAR, min(a[4 * s + t] + exits[t] for t in STATES)) for s in STATES]


# --- blocks in Spark -------------------------------------------------------------------------------

def _lattice(items: list[dict], firsts: list[int], after: int | None) -> tuple[list[Row], list[int]]:
    """Rows of a block's lattice, and how many are blank, duplicate, truncated, and followed by a row they can't precede."""
    first, rows, counts = set(firsts), [], [0, 0, 0, 0]
    for item in items:
        code = item["code"]
        blank, cut = bool(code & 4), bool(code & 8)
        twin = not blank and item["pos"] not in first
        cut = cut and not blank and not twin
        for k, hit in enumerate((blank, twin, cut)):
            counts[k] += hit
        rows.append((code & 3, blank or twin, cut))
    initials = [r[0] for r in rows] + ([after] if after is not None else [])
    counts[3] = sum(pair not in LEGAL_PAIRS for pair in zip(initials, initials[1:]))
    return rows, counts


def _over_blocks(solve: Callable[[list[Row], list[int], dict], dict], kept: Sequence[str], schema: pa.Schema):
    """A function for ``mapInArrow``: the columns of ``solve`` for every block, beside the ``kept`` ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                codes = part.select(["codes", "firsts", "after", "tail", *([] if "exits" not in part.schema.names else ["exits"])]).to_pylist()
                found = [solve(*_lattice(b["codes"], b["firsts"], b["after"]), b) for b in codes]
                made = [pa.array([f[name] for f in found], schema.field(name).type) for name in schema.names]
                yield pa.record_batch([*[part.column(c) for c in kept], *made], names=[*kept, *schema.names])
    return run


def _solve(rows: list[Row], counts: list[int], block: dict) -> dict:
    price = converge(rows, block["exits"], block["tail"])
    ways = [trace(rows, price, block["exits"], block["tail"], s) if price[0][s] < FAR else (s, []) for s in STATES]
    return {"counts": counts, "prices": price[0], "leads": [w[0] for w in ways], "edits": [w[1] for w in ways]}


def _scan(values: DataFrame, largest: int, combine: Callable, act: Callable, seed: Sequence[int], backward: bool) -> DataFrame:
    """``conv, block, state``: what ``seed`` becomes on the way to each block, from the end (``backward``) or the beginning.

    Blocks of a conversation meet in groups of 256 only, group results in groups again.
    """
    def spread(members, state):
        out, order = [None] * len(members), range(len(members))
        for i in reversed(order) if backward else order:
            out[i], state = list(state), act(members[i], state)
        return out

    merged = F.udf(lambda members: reduce(combine, members), "array<bigint>")
    passed = F.udf(spread, "array<array<bigint>>")
    groups, rows = [], values
    while True:
        groups.append(cut_lineage(rows.groupBy("conv", F.shiftright("block", FAN).alias("up")).agg(
            F.array_sort(F.collect_list(F.struct("block", "value"))).alias("members"))))
        largest = -(-largest >> FAN)
        if largest <= 1:
            break
        rows = groups[-1].select("conv", F.col("up").alias("block"), merged("members.value").alias("value"))
    state = groups[-1].select("conv", "up", F.lit(list(seed)).cast("array<bigint>").alias("state"))
    for group in reversed(groups):
        zipped = F.arrays_zip(F.col("members.block").alias("block"), passed("members.value", "state").alias("state"))
        state = group.join(state, ["conv", "up"]).select("conv", F.inline(zipped)).withColumnRenamed("block", "up")
    return cut_lineage(state.withColumnRenamed("up", "block"))


def _blocks(light: DataFrame) -> DataFrame:
    """Blocks of numbered rows: ``items`` in order, the places of first occurrences among them, the initial after the block."""
    block = F.shiftright("pos", ROWS)
    item = F.struct("pos", "code", "turn", "role", "digest")
    rows = light.select("conv", block.alias("block"), "n", item.alias("item"))
    firsts = light.groupBy("conv", "role", "digest").agg(F.min("pos").alias("pos")).select("conv", block.alias("block"), F.col("pos").alias("first"))
    heads = light.where((F.col("pos") > 0) & (F.pmod("pos", F.lit(1 << ROWS)) == 0)).select(
        "conv", (block - 1).alias("block"), F.col("code").bitwiseAND(3).alias("after"))
    both = rows.unionByName(firsts, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
    found = both.groupBy("conv", "block").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("item")).alias("items"),
                                              F.collect_list("first").alias("firsts"), F.max("after").alias("after"))
    return cut_lineage(found.withColumn("codes", F.transform("items", lambda x: F.struct(x["pos"], x["code"])))
                       .withColumn("tail", F.shiftright(F.col("n") - 1, ROWS) == F.col("block")))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows from texts and edits in one order: a text comes before all edits of the rows that hold it."""
    conv, text, number = None, "", 0
    out: list[tuple] = []
    size = 0

    def flush():
        columns = list(zip(*out))
        return pa.record_batch([pa.array(columns[0], schema.field("conv").type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
                                pa.array(columns[3], pa.string()), pa.array(columns[4], pa.string())],
                               names=["conv", "number", "role", "text", "edit"])

    for batch in batches:
        schema = batch.schema
        convs, roles, texts, edits = (batch.column(schema.get_field_index(c)) for c in ("conv", "role", "text", "edit"))
        for i in range(batch.num_rows):
            here = convs[i].as_py()
            if here != conv:
                conv, number = here, 0
            edit = edits[i].as_py()
            if edit is None:
                text = texts[i].as_py()
                continue
            for letter in edit:
                if letter != "D":
                    role, content = ("user" if letter in "uU" else "assistant", text if letter in "UA" else "") if letter != "K" else (roles[i].as_py(), text)
                    out.append((here, number, role, content, "I" if letter in "ua" else "R" if letter in "UA" else "K"))
                    number += 1
                    size += len(content) + 64
            if size > 4 << 20:
                yield flush()
                out, size = [], 0
    if out:
        yield flush()


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, digest, kind = None, None, None
    done: list[tuple] = []
    for batch in batches:
        kind = batch.schema.field("conv").type
        for here, role, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "role", "text"))):
            if digest is None or here != conv:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest, between = here, hashlib.sha256(), ""
            digest.update(f"{between}{role}:{text}".encode())
            between = "\n"
        if len(done) > 10_000:
            yield pa.record_batch([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], names=["conv", "sha256"])
            done = []
    if digest is not None:
        done.append((conv, digest.hexdigest()))
    if done:
        yield pa.record_batch([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], names=["conv", "sha256"])


class Repair:
    """Edits of all conversations of ``rows``, and what follows from them.

    ``rows`` needs a conversation id, a turn (integer), a role and a text; nulls in the last two count as one space. A
    conversation's rows ascend by turn, nulls first; equal turns by role, then by the text's digest; rows equal in all of
    these are repeats, in any order. A null id is a conversation of its own. Other columns aren't read. An empty table has no
    conversations.
    """

    def __init__(self, rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> None:
        self.key = conv
        role_, text_ = F.coalesce(F.col(role).cast("string"), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
        self.rows = rows.select(F.struct(F.col(conv).alias("id")).alias("conv"), F.col(turn).cast("long").alias("turn"), role_.alias("role"),
                                F.sha2(text_, 256).alias("digest"), text_.alias("text"))
        body = F.btrim("text", F.lit(SPACES))
        initial = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in (("s", 1), ("u", 2), ("a", 3)) for x in pair]),
                                              F.substring("role", 1, 1)), F.lit(0))
        code = initial + F.when(body == "", 4).otherwise(0) + F.when(F.right(body, F.lit(1)).isin(".", "!", "?"), 0).otherwise(8)
        # Texts stay behind from here on.
        light = cut_lineage(self.rows.select(F.col("conv").alias("group"), "turn", "role", "digest", code.cast("int").alias("code"),
                                             F.monotonically_increasing_id().alias("twin")))
        self.light = cut_lineage(_place(light, ["turn", "role", "digest", "twin"]).withColumnRenamed("group", "conv").drop("twin"))
        self._solve()

    def _solve(self) -> None:
        blocks = _blocks(self.light)
        # One figure: how many blocks the longest conversation has.
        largest = -(-(blocks.agg(F.max("n")).first()[0] or 0) >> ROWS)
        kind = blocks.schema["conv"].dataType.simpleString()
        final = F.lit(list(FINAL)).cast("array<bigint>")
        one, more = blocks.where(F.col("n") <= 1 << ROWS).withColumn("exits", final), blocks.where(F.col("n") > 1 << ROWS)
        if largest > 1:
            value = pa.schema([("value", pa.list_(pa.int64()))])
            ways = more.select("conv", "block", "codes", "firsts", "after", "tail").mapInArrow(
                _over_blocks(lambda rows, _, b: {"value": matrix(rows, b["tail"])}, ["conv", "block"], value),
                f"conv {kind}, block bigint, value array<bigint>")
            exits = _scan(ways, largest, _then, _before, FINAL, backward=True)
            one = one.unionByName(more.join(exits.withColumnRenamed("state", "exits"), ["conv", "block"]))
        kept = ["conv", "block", "n", "items"]
        made = pa.schema([("counts", pa.list_(pa.int64())), ("prices", pa.list_(pa.int64())), ("leads", pa.list_(pa.int64())),
                          ("edits", pa.list_(pa.list_(pa.string())))])
        items = blocks.schema["items"].dataType.simpleString()
        solved = cut_lineage(one.select(*kept, "codes", "firsts", "after", "tail", "exits").mapInArrow(
            _over_blocks(_solve, kept, made),
            f"conv {kind}, block bigint, n bigint, items {items}, counts array<bigint>, prices array<bigint>, leads array<bigint>, "
            "edits array<array<string>>"))
        picked = solved.where(F.col("n") <= 1 << ROWS).withColumn("edits", F.get("edits", F.lit(START)))
        if largest > 1:
            longer = solved.where(F.col("n") > 1 << ROWS)
            entry = _scan(longer.select("conv", "block", F.col("leads").alias("value")), largest,
                          lambda a, b: [b[s] for s in a], lambda a, state: [a[state[0]]], [START], backward=False)
            picked = picked.unionByName(longer.join(entry, ["conv", "block"]).withColumn(
                "edits", F.get("edits", F.get("state", F.lit(0)).cast("int"))).drop("state"))
        self.solved = picked

    def summary(self) -> DataFrame:
        """Per conversation: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost`` and ``audit``."""
        turns = self.light.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
        letters = F.translate(F.array_join("edits", ""), "uaUA", "IIRR")
        counts = [F.sum(F.get("counts", F.lit(i))).alias(c) for i, c in enumerate(("blank", "duplicate", "truncated", "illegal"))]
        cost = F.max(F.when(F.col("block") == 0, F.get("prices", F.lit(START)))).alias("cost")
        parts = F.array_sort(F.collect_list(F.struct("block", letters.alias("letters"))))
        found = self.solved.groupBy("conv").agg(*counts, cost, F.array_join(F.transform(parts, lambda p: p["letters"]), "").alias("audit"))
        return turns.join(found, "conv").select(F.col("conv.id").alias(self.key), *[c for c in (*turns.columns, *found.columns) if c != "conv"])

    def _ordered(self) -> DataFrame:
        edits = self.solved.select("conv", F.inline(F.arrays_zip(F.col("items").alias("item"), F.col("edits").alias("edit"))))
        edits = edits.select("conv", "item.turn", "item.role", "item.digest", "item.pos", "edit")
        both = self.rows.unionByName(edits, allowMissingColumns=True)
        order = ["conv", "turn", "role", "digest", F.col("pos").asc_nulls_first()]
        kind = self.rows.schema["conv"].dataType.simpleString()
        return both.repartition("conv").sortWithinPartitions(*order).mapInArrow(
            _merge, f"conv {kind}, number bigint, role string, text string, edit string")

    def repaired(self) -> DataFrame:
        """The repaired rows: id, ``number`` (from 0), ``role``, ``text`` and ``edit`` (K, R or I)."""
        return self._ordered().select(F.col("conv.id").alias(self.key), "number", "role", "text", "edit")

    def digests(self) -> DataFrame:
        """SHA-256 of each conversation's repaired ``role:text`` lines; conversations without rows have none."""
        kind = self.rows.schema["conv"].dataType.simpleString()
        found = self._ordered().mapInArrow(_hash, f"conv {kind}, sha256 string")
        return found.select(F.col("conv.id").alias(self.key), "sha256")


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Faults planted by the CRC-32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes ``.!?``, 3
    repeats it, 4 makes its role user. Nulls in role, text and the hashed numbers count as one space."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)]
    fault = F.pmod(F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")), F.lit(20))
    role_, text_ = F.coalesce(F.col(role), F.lit(" ")), F.coalesce(F.col(text), F.lit(" "))
    marked = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), role_.alias("role"), text_.alias("text"), fault.alias("_fault"))
    copies = F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.where("_fault > 0").select(
        "conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("_copy")).drop("_copy")
