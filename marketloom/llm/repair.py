"""Conversation repair: cheapest edits as a shortest path, by the auction algorithm over an integer-cost lattice.

A lattice node is (rows done, state of the role grammar ``(s?(ua)+)?``); its arcs are the edits. The auction keeps a
price for each node, at most the cost of an arc plus the price of its end, and a path from the origin: the path is
extended over an arc that meets its price, or else the price of its last node rises and the path contracts. With the
origin's converged prices every arc of every cheapest path is tight (price = cost + price of its end), so the first
path of tight arcs by letters is the answer.

Long conversations are cut into blocks. A block's prices for each pair of entry and exit state make it one row of a
coarser lattice, up to one row for the conversation; the chosen states then go back down. Inserts belong to the row
after them, so strings of one block never continue each other and can be ranked block by block.
"""
from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import sorted_groups
from marketloom.sources.shared import materialize

#: Costs of the edits, and of leaving a truncated row.
REROLE, DELETE, INSERT, LEFT_TRUNCATED = 1, 2, 5, 5
#: States: nothing yet, after system, after user, after assistant; what may follow, and what an edit writes there.
FOLLOW = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WRITE = ("user", "user", "assistant", "user")
#: Inserts that end a conversation in a state.
ENDING = (0, 2, 1, 0)
#: Rows of a block, bytes of text after which it ends, blocks of a coarser one.
ROWS, BYTES, FAN = 64, 4 << 20, 64
#: Faults of a row.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
BLANKS = " \t\n\u000b\f\r"

Arc = tuple[int, object, int]


def auction(arcs: list[list[Arc]], origin: int, target: int, price: list[int]) -> int:
    """Cost of the cheapest path; ``price`` must satisfy price <= cost + price of the end, and is left so.

    Every node must reach the target and no cycle be free.
    """
    path = [origin]
    while path[-1] != target:
        at = path[-1]
        offer, to = min((cost + price[end], end) for cost, _, end in arcs[at])
        if price[at] < offer:
            price[at] = offer
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)
    return price[origin] - price[target]


def least_path(arcs: list[list[Arc]], origin: int, target: int, price: list[int]) -> list[Arc]:
    """The first path of tight arcs to the target by labels; arcs of a node stand in the order of their labels."""
    path: list[Arc] = []
    stack = [iter(arcs[origin])]
    nodes, dead = [origin], set()
    while nodes[-1] != target:
        for arc in stack[-1]:
            cost, _, end = arc
            if price[nodes[-1]] == cost + price[end] and end not in dead:
                path.append(arc)
                nodes.append(end)
                stack.append(iter(arcs[end]) if end < len(arcs) else iter(()))
                break
        else:
            dead.add(nodes.pop())
            stack.pop()
            path.pop()
    return path


def living(arcs: list[list[Arc]], target: int) -> list[list[Arc]]:
    """Only arcs whose ends reach the target. Arcs lead onward, or between the four states of one place."""
    n = len(arcs)
    alive = [False] * n
    alive[target] = True
    for base in range((n - 1) // 4 * 4, -1, -4):
        for _ in range(3):
            for at in range(base, min(base + 4, n)):
                alive[at] = alive[at] or any(alive[end] for _, _, end in arcs[at])
    return [[arc for arc in out if alive[arc[2]]] if alive[at] else [] for at, out in enumerate(arcs)]


Row = tuple[str, int]  # role initial, fault


def lattice(rows: list[Row], ended: bool) -> tuple[list[list[Arc]], list[int]]:
    """Arcs and first prices of rows: node 4 i + state after i rows; with ``ended`` one node more, the end of the conversation.

    The first price of a node is what the faulty rows from there on cost at least.
    """
    n = len(rows)
    arcs: list[list[Arc]] = []
    for i, (initial, fault) in enumerate(rows):
        for state, follow in enumerate(FOLLOW):
            written, extra = follow[WRITE[state][0]], LEFT_TRUNCATED if fault == TRUNCATED else 0
            out: list[Arc] = [(DELETE, "D", 4 * i + 4 + state), (INSERT, "I", 4 * i + written)]
            if fault not in (BLANK, DUPLICATE):
                if initial in follow:
                    out.append((extra, "K", 4 * i + 4 + follow[initial]))
                out.append((REROLE + extra, "R", 4 * i + 4 + written))
            arcs.append(out)
    due = [0]
    for _, fault in reversed(rows):
        due.append(due[-1] + (DELETE if fault else 0))
    price = [v for v in reversed(due) for _ in range(4)]
    for state, follow in enumerate(FOLLOW):
        arcs.append(([(0, "", 4 * n + 4)] if not ENDING[state] else [(INSERT, "I", 4 * n + follow[WRITE[state][0]])]) if ended else [])
    if ended:
        arcs.append([])
        price.append(0)
    return arcs, price


Element = tuple[list[int | None], list[int | None]]  # cost and rank by 4 * entry + exit state; None: no path


def coarse(elements: list[Element]) -> tuple[list[list[Arc]], list[int]]:
    """Arcs and first prices of a lattice whose rows are blocks."""
    arcs: list[list[Arc]] = []
    due = [0]
    for i, (cost, rank) in enumerate(elements):
        for state in range(4):
            out = [(cost[4 * state + to], rank[4 * state + to], 4 * i + 4 + to) for to in range(4) if cost[4 * state + to] is not None]
            arcs.append(sorted(out, key=lambda arc: arc[1]))
    for cost, _ in reversed(elements):
        due.append(due[-1] + min(c for c in cost if c is not None))
    return arcs + [[], [], [], []], [v for v in reversed(due) for _ in range(4)]


def element(arcs: list[list[Arc]], price: list[int]) -> Element:
    """Costs between all entry and exit states, and for each entry state the order of the exits' strings."""
    last = len(arcs) - 4
    cost: list[int | None] = [None] * 16
    rank: list[int | None] = [None] * 16
    strings: list[list] = [[], [], [], []]
    for to in range(4):
        part, prices = living(arcs, last + to), price[:]
        for state in range(4):
            if part[state] or (last == 0 and state == to):
                cost[4 * state + to] = auction(part, state, last + to, prices)
                strings[state].append(([arc[1] for arc in least_path(part, state, last + to, prices)], to))
    for state, some in enumerate(strings):
        for k, (_, to) in enumerate(sorted(some)):
            rank[4 * state + to] = k
    return cost, rank


def between(arcs: list[list[Arc]], price: list[int], enter: int, leave: int) -> list[Arc]:
    """The least cheapest path from an entry to an exit state."""
    target = len(arcs) - 4 + leave
    part, prices = living(arcs, target), price[:]
    auction(part, enter, target, prices)
    return least_path(part, enter, target, prices)


def tokens(path: list[Arc]) -> Iterator[str]:
    """The path's letters cut after each row's edit: inserts with what follows them; those of the end last."""
    held = ""
    for _, letter, _ in path:
        held += letter
        if letter in ("D", "K", "R"):
            yield held
            held = ""
    if held:
        yield held


class Conversation:
    """Running figures and digest of a conversation whose rows and edits come in order."""

    def __init__(self):
        self.seen = [0, 0, 0, 0]
        self.illegal = self.turns = self.cost = 0
        self.first = self.last = self.initial = None
        self.state, self.any = 0, False
        self.audit: list[str] = []
        self.digest = hashlib.sha256()

    def say(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True

    def insert(self) -> None:
        role = WRITE[self.state]
        self.say(role, "")
        self.state, self.cost = FOLLOW[self.state][role[0]], self.cost + INSERT

    def add(self, turn: int | None, role: str, text: str, fault: int, edit: str) -> None:
        self.seen[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        self.audit.append(edit)
        for _ in edit[:-1]:
            self.insert()
        kind = edit[-1]
        if kind == "D":
            self.cost += DELETE
            return
        self.cost += (LEFT_TRUNCATED if fault == TRUNCATED else 0) + (REROLE if kind == "R" else 0)
        role = WRITE[self.state] if kind == "R" else role
        self.say(role, text)
        self.state = FOLLOW[self.state][role[0]]

    def result(self) -> dict:
        while ENDING[self.state]:
            self.insert()
            self.audit.append("I")
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {"gaps": gaps, "blank": self.seen[BLANK], "duplicate": self.seen[DUPLICATE], "truncated": self.seen[TRUNCATED], "illegal": self.illegal,
                "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.digest.hexdigest()}


FIGURES = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
FIGURE_FIELDS = [(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in FIGURES.split(", ")]
KEY_FIELDS = [("nameless", pa.int32()), ("conv", pa.int64())]
ROW_FIELDS = [("part", pa.int64()), ("node", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.int32())]
MATRIX_FIELDS = [("cost_of", pa.list_(pa.int64())), ("rank_of", pa.list_(pa.int64()))]


def out(rows: list[dict], fields: list) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(fields)
    return iter(pa.Table.from_pylist([{name: r.get(name) for name, _ in fields} for r in rows], schema=schema).to_batches())


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with a fixed rule of damage; null roles and texts are one space, and so are nulls in the rule's key."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("time")).drop("time")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in order over range partitions, with what the functions of Spark can tell of their faults.

    ``later``: the role and text were said in an earlier turn. Equal rows of one turn stand side by side in one partition.
    """
    rows = rows.select(F.col("conv_id").isNull().cast("int").alias("nameless"), F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    body: Column = F.rtrim("text", F.lit(BLANKS))
    rows = rows.withColumns({"blank": F.length(body) == 0, "cut": ~F.right(body, F.lit(1)).isin(".", "!", "?"),
                             "same": F.sha2(F.concat_ws(":", "nameless", "conv", F.length("role").cast("string"), "role", "text"), 256)})
    when = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    firsts = rows.groupBy("same").agg(F.min(when).alias("first"), F.max(when).alias("last")).where("NOT (first <=> last)")
    salts = 8  # what many rows say in one conversation meets its first turn in several parts
    firsts = firsts.select("same", "first", F.explode(F.array(*map(F.lit, range(salts)))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(salts)).cast("int")).join(firsts, ["same", "salt"], "left")
    later = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    place = ["nameless", "conv", F.col("turn").asc_nulls_first(), "role"]
    return (rows.select("nameless", "conv", "turn", "role", "text", "blank", "cut", later.alias("later"))
            .repartitionByRange(*place, F.substring("text", 1, 32)).sortWithinPartitions(*place, "text"))


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations that lie in one block of this partition; rows and block matrices of all others."""
    fields = [*KEY_FIELDS, *ROW_FIELDS, *MATRIX_FIELDS, *FIGURE_FIELDS]
    part = TaskContext.get().partitionId()
    now, opened, node, size = None, False, 0, 0
    held: list[tuple] = []  # turn, role, text, fault
    before = None

    def close(over: bool) -> list[dict]:
        """The block at hand; ``over``: the conversation begins and ends in this partition."""
        key = {"nameless": now[0], "conv": now[1]}
        simple = [(role[:1], fault) for _, role, _, fault in held]
        if over and node == 0:
            arcs, price = lattice(simple, True)
            auction(arcs, 0, len(arcs) - 1, price)
            edits = list(tokens(least_path(arcs, 0, len(arcs) - 1, price)))
            told = Conversation()
            for row, edit in zip(held, edits, strict=False):  # inserts of the end come with the result
                told.add(*row, edit)
            return [key | told.result()]
        cost, rank = element(*lattice(simple, False))
        rows = [key | {"part": part, "node": node, "seq": k, "turn": t, "role": r, "text": x, "fault": f} for k, (t, r, x, f) in enumerate(held)]
        rows[-1] |= {"cost_of": cost, "rank_of": rank}
        return rows

    ready: list[dict] = []
    for b in batches:
        for nameless, conv, turn, role, text, blank, ended, later in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (nameless, conv) != now:
                if held:
                    ready += close(opened)
                opened, now, held, node, size, before = now is not None, (nameless, conv), [], 0, 0, None
            elif len(held) >= ROWS or size >= BYTES:
                ready += close(False)
                held, node, size = [], node + 1, 0
            again = before == (turn, role, text)
            before = (turn, role, text)
            held.append((turn, role, text, BLANK if blank else DUPLICATE if later or again else TRUNCATED if ended else SOUND))
            size += len(text)
            if len(ready) >= 2048:
                yield from out(ready, fields)
                ready = []
    if held:
        ready += close(False)
    if ready:
        yield from out(ready, fields)


def grouped(rows: DataFrame, keys: list[str], order: list[str], fields: list, each: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``each`` applied to every group of ``rows`` in order; groups are bounded by FAN, by ROWS or by the partitions of a job."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, starts in sorted_groups(batches, keys):
            found = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                found += each(block.slice(s, e - s).to_pylist())
            yield from out(found, fields)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


KEYS = ["nameless", "conv"]
STATES = [("enter", pa.int32()), ("leave", pa.int32())]


def one_up(children: list[dict]) -> list[dict]:
    cost, rank = element(*coarse([(c["cost_of"], c["rank_of"]) for c in children]))
    return [{**children[0], "node": children[0]["up"], "cost_of": cost, "rank_of": rank}]


def down(children: list[dict]) -> list[dict]:
    path = between(*coarse([(c["cost_of"], c["rank_of"]) for c in children]), children[0]["enter"], children[0]["leave"])
    at = children[0]["enter"]
    found = []
    for c, (_, _, end) in zip(children, path, strict=True):
        found.append({**c, "enter": at, "leave": end % 4})
        at = end % 4
    return found


def top(parts: list[dict]) -> list[dict]:
    """States between the parts of a conversation: the cheapest exit with what its end costs, of equals the first string."""
    cost, rank = element(*coarse([(p["cost_of"], p["rank_of"]) for p in parts]))
    leave = min((to for to in range(4) if cost[to] is not None), key=lambda to: (cost[to] + INSERT * ENDING[to], rank[to]))
    return down([{**p, "enter": 0, "leave": leave} for p in parts])


def edited(rows: list[dict]) -> list[dict]:
    path = between(*lattice([(r["role"][:1], r["fault"]) for r in rows], False), rows[0]["enter"], rows[0]["leave"])
    return [{**r, "edit": e} for r, e in zip(rows, tokens(path), strict=True)]


def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Figures of conversations whose edited rows come in order: a digest is a chain, so one task takes a conversation, row by row."""
    fields, now, run, ready = [*KEY_FIELDS, *FIGURE_FIELDS], None, None, []
    for b in batches:
        for nameless, conv, turn, role, text, fault, edit in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (nameless, conv) != now:
                ready += [{"nameless": now[0], "conv": now[1], **run.result()}] if now else []
                now, run = (nameless, conv), Conversation()
            run.add(turn, role, text, fault, edit)
        if ready:
            yield from out(ready, fields)
            ready = []
    if now:
        yield from out([{"nameless": now[0], "conv": now[1], **run.result()}], fields)


def repaired(rows: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """``conv_id`` with figures of its faults and its cheapest repair; one row for each id of ``rows`` and of ``everyone``.

    Rows go by ``turn`` (null first), rows of one turn by role, then text, so repeated rows stand side by side and all but
    the first are duplicates. Null roles and texts are one space; a role without a first character, or with another
    one than s, u or a, can only be changed or deleted. A null ``conv_id`` is a conversation of its own. Ids without rows
    have zeros, an empty audit and the digest of an empty text. An empty table gives an empty result; extra columns are ignored.
    """
    keys, matrix = "nameless int, conv long", "cost_of array<long>, rank_of array<long>"
    all_ids = rows.select("conv_id") if everyone is None else rows.select("conv_id").unionByName(everyone.select("conv_id"))
    pieces = materialize(ordered(rows).mapInArrow(cut, f"{keys}, part long, node long, seq long, turn long, role string, text string, fault int, {matrix}, {FIGURES}"), "repair-pieces")
    names = [name for name, _ in FIGURE_FIELDS]
    done = pieces.where("part IS NULL").select(*KEYS, *names)

    lines = pieces.where("part IS NOT NULL")
    levels = [lines.where("cost_of IS NOT NULL").select(*KEYS, "part", "node", "cost_of", "rank_of")]
    most = levels[0].agg(F.max("node")).first()[0]
    if most is not None:
        fields = [*KEY_FIELDS, ("part", pa.int64()), ("node", pa.int64()), *MATRIX_FIELDS]
        up = F.floor(F.col("node") / FAN).cast("long")
        while most > 0:
            higher = grouped(levels[-1].withColumn("up", up), [*KEYS, "part", "up"], ["node"], fields, one_up, f"{keys}, part long, node long, {matrix}")
            levels.append(materialize(higher, "repair-level"))
            most //= FAN
        placed, states = [*KEY_FIELDS, ("part", pa.int64()), ("node", pa.int64()), *STATES], f"{keys}, part long, node long, enter int, leave int"
        chosen = materialize(grouped(levels[-1], KEYS, ["part"], placed, top, states), "repair-states")
        for level in reversed(levels[:-1]):
            above = chosen.withColumnRenamed("node", "up")
            chosen = materialize(grouped(level.withColumn("up", up).join(above, [*KEYS, "part", "up"]), [*KEYS, "part", "up"], ["node"], placed, down, states), "repair-states")
        line = [*KEY_FIELDS, *ROW_FIELDS, ("edit", pa.string())]
        edits = grouped(lines.drop("cost_of", "rank_of", *names).join(chosen, [*KEYS, "part", "node"]), [*KEYS, "part", "node"], ["seq"], line, edited,
                        f"{keys}, part long, node long, seq long, turn long, role string, text string, fault int, edit string")
        edits = edits.repartition(*KEYS).sortWithinPartitions(*KEYS, "part", "node", "seq").select(*KEYS, "turn", "role", "text", "fault", "edit")
        done = done.unionByName(edits.mapInArrow(told, f"{keys}, {FIGURES}"))

    wanted = all_ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", F.col("conv_id").isNull().cast("int").alias("nameless"), F.coalesce("conv_id", F.lit(0)).alias("conv"))
    found = wanted.join(done, KEYS, "left")
    return found.select("conv_id", *[F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in names[:6]], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
