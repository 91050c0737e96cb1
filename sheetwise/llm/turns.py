"""Repair of conversations: the cheapest edits that give the turns a grammar, by recursive DuckDB queries in batches.

A conversation may have one system turn at its start, then pairs of a user and an assistant turn. Edits keep a row, give it
another role, delete it or insert an empty turn. What matters of the rows before is one of four states:

    0  nothing yet        1  a system turn        2  a user turn        3  an assistant turn

Rows are numbered along all conversations, and every SPAN of them make a block. Blocks are dealt out by hash; in a batch of
blocks one recursive query moves one turn on in all conversations at a time and keeps, for each state that a stretch can begin in and each state that it can reach, the least
cost and the audit of edits. Most conversations lie within one block and are done then. The stretches of others are the elements
of the next level, SPAN blocks a group, and so on, by the same query; so a conversation of any length is never in one task.

Equal costs: the audit that is least by ASCII. Of two audits over the same rows at the same cost neither is a prefix of the other, for
each ends in the edit of a row and inserts cost; so the least of a whole has the least of each part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import product

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches, whole_groups

#: Rows of a block, and blocks of a group.
SPAN = 256
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a batch.
BATCH = 16384
_NOT_BLANK = r"[^\x20\x09-\x0D]"
#: The last character that is not blank ends no sentence.
_CUT_SHORT = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"
_ROLES = {"s": 1, "u": 2, "a": 3}
_ID_BITS = 33


def _after(state: int) -> int:
    """The state after the turn that may follow: an assistant's after a user's, else a user's."""
    return 3 if state == 2 else 2


def moves() -> list[tuple[int, int, int, int, str]]:
    """(kind, from, to, cost, audit) of each way to deal with one row, inserts before it included.

    A row's kind is its role (0 to 3, other, system, user, assistant), 4 more if it must go, 8 more if it is truncated.
    More than two inserts come back to a state that they have passed.
    """
    out = []
    for role, must_go, short, start, inserts in product(range(4), (0, 1), (0, 1), range(4), range(3)):
        kind, state = role + 4 * must_go + 8 * short, start
        for _ in range(inserts):
            state = _after(state)
        cost, audit = INSERT * inserts, "I" * inserts
        out.append((kind, start, state, cost + DELETE, audit + "D"))
        if must_go:
            continue
        cost += TRUNCATED * short
        to = _after(state)
        if role == to:
            out.append((kind, start, to, cost, audit + "K"))
        else:
            out.append((kind, start, to, cost + REROLE, audit + "R"))
        if role == 1 and state == 0:
            out.append((kind, start, 1, cost, audit + "K"))
    return out


#: One turn further in all stretches at once; the least of each state that a stretch began in and has come to.
_WALK = """
    WITH RECURSIVE walk(grp, entry, state, idx, best) USING KEY (grp, entry, state) AS (
      SELECT grp, entry, entry, 0, {'cost': 0::BIGINT, 'audit': '', 'path': ''} FROM starts
      UNION
      SELECT w.grp, w.entry, t.state, w.idx + 1,
             min({'cost': w.best.cost + t.cost, 'audit': w.best.audit || t.audit, 'path': w.best.path || t.state::VARCHAR})
      FROM walk w JOIN steps t ON t.grp = w.grp AND t.idx = w.idx AND t.entry = w.state
      GROUP BY w.grp, w.entry, t.state, w.idx)
    SELECT s.key, s.block, s.lo, s.begins, s.ends, s.illegal, w.entry, w.state, w.best.cost AS cost, w.best.audit AS audit, w.best.path AS path
    FROM walk w JOIN stretches s ON w.grp = s.grp AND w.idx = s.n"""
_STRETCH = "key string, block long, lo long, begins boolean, ends boolean, illegal long, entry int, state int, cost long, audit string, path string"
#: Blocks of rows: place -1 and 1 are the row before and the row after a block. A stretch is a conversation's part of a block.
_ROWS = (
    """CREATE OR REPLACE TEMP TABLE near AS
       SELECT key, block, number, kind, place, lag(kind & 3) OVER w AS before FROM input WINDOW w AS (PARTITION BY block, key ORDER BY number)""",
    """CREATE OR REPLACE TEMP TABLE stretches AS
       SELECT row_number() OVER () AS grp, key, block, min(number) FILTER (place = 0) AS lo, count(*) FILTER (place = 0) AS n, min(place) = 0 AS begins, max(place) = 0 AS ends,
              count(*) FILTER (place = 0 AND before IS NOT NULL AND (before, kind & 3) NOT IN ((1, 2), (2, 3), (3, 2))) AS illegal
       FROM near GROUP BY key, block HAVING count(*) FILTER (place = 0) > 0""",
    """CREATE OR REPLACE TEMP TABLE steps AS
       SELECT s.grp, (r.number - s.lo)::INT AS idx, m.entry, m.state, m.cost, m.audit
       FROM near r JOIN stretches s USING (key, block) JOIN moves m USING (kind) WHERE r.place = 0""",
)
#: Groups of stretches of the level below.
_GROUPS = (
    """CREATE OR REPLACE TEMP TABLE stretches AS
       SELECT row_number() OVER () AS grp, key, above AS block, min(block) AS lo, count(DISTINCT block) AS n, bool_or(begins) AS begins, bool_or(ends) AS ends, 0::BIGINT AS illegal
       FROM input GROUP BY key, above""",
    """CREATE OR REPLACE TEMP TABLE steps AS
       SELECT s.grp, (i.block - s.lo)::INT AS idx, i.entry, i.state, i.cost, i.audit FROM input i JOIN stretches s ON i.key = s.key AND i.above = s.block""",
)
_STARTS = "CREATE OR REPLACE TEMP TABLE starts AS SELECT grp, e.entry FROM stretches, (VALUES (0), (1), (2), (3)) e(entry) WHERE e.entry = 0 OR NOT begins"


def _walked(rows: DataFrame, group: str, order: list[str], prepare: tuple[str, ...]) -> DataFrame:
    """The stretches of all groups, walked in batches of whole groups that a hash deals out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        db.execute("CREATE TABLE moves (kind INT, entry INT, state INT, cost BIGINT, audit VARCHAR)")
        db.execute("INSERT INTO moves VALUES " + ", ".join(map(str, moves())))
        for batch in whole_groups(batches, group, BATCH):
            db.register("input", pa.Table.from_batches([batch]))
            for statement in (*prepare, _STARTS):
                db.execute(statement)
            yield from db.sql(_WALK).to_arrow_table().cast(_arrow).to_batches()
            db.unregister("input")
        db.close()

    _arrow = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in (f.split() for f in _STRETCH.split(", "))])
    return small_batches(rows).repartition(group).sortWithinPartitions(group, *order).mapInArrow(run, _STRETCH)


def numbered(rows: DataFrame) -> DataFrame:
    """rows of conv_id, turn, role and text, null counting as empty in the last two, with `key` and `number`: gapless along all conversations.

    In a conversation rows go by turn, null first, then role and text. Rows are sorted in ranges, a long conversation in several; only the
    counts of the ranges meet, to shift the numbers within each.
    """
    key = F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    rows = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text"))).withColumns({"key": key, "_n": F.monotonically_increasing_id()})
    order = ["key", F.col("turn").asc_nulls_first(), "role", "text", "_n"]  # _n: many equal rows may part
    ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_n").withColumn("_at", F.monotonically_increasing_id())
    written = cut(ranges)
    part = F.shiftright("_at", _ID_BITS)
    counts = written.groupBy(part.alias("_part")).count().orderBy("_part").collect()  # a row for each range
    before, shifts = 0, []
    for r in counts:
        shifts.append((r["_part"], before))
        before += r["count"]
    shift = rows.sparkSession.createDataFrame(shifts, "_part long, _before long")
    out = written.join(F.broadcast(shift), part == F.col("_part")).withColumn("number", F.col("_before") + F.col("_at").bitwiseAND((1 << _ID_BITS) - 1))
    out = out.drop("_at", "_part", "_before")
    out._sheetwise_path = written._sheetwise_path
    return out


def faults(rows: DataFrame) -> DataFrame:
    """The first fault of each numbered row: key, turn, number, `role` (0 to 3) and `fault`: blank, duplicate, truncated or null.

    A row is a duplicate if its conversation has a row of its role and text before. The first of these is found with partial sums and
    goes back to the row of its number, so many copies meet nowhere.
    """
    role = F.substring("role", 1, 1)
    code = F.lit(0)
    for letter, value in _ROLES.items():
        code = F.when(role == letter, value).otherwise(code)
    blank = ~F.col("text").rlike(_NOT_BLANK)
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    first = rows.where(~blank).groupBy("key", said.alias("_said")).agg(F.min("number").alias("_first")).select("_first")
    seen = rows.select("key", "turn", "number", code.alias("role"), blank.alias("_blank"), F.col("text").rlike(_CUT_SHORT).alias("_short"))
    seen = seen.join(first, F.col("number") == F.col("_first"), "left")
    fault = F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("_short"), "truncated")
    return seen.select("key", "turn", "number", "role", fault.alias("fault"))


def _levels(found: DataFrame, span: int) -> list[DataFrame]:
    """The stretches of each level, the lowest first; the last has no stretch that goes on."""
    kind = F.col("role") + F.when(F.col("fault").isin("blank", "duplicate"), 4).otherwise(0) + F.when(F.col("fault") == "truncated", 8).otherwise(0)
    block, at = F.expr(f"number div {span}"), F.col("number") % span
    near = [F.struct(block.alias("block"), F.lit(0).alias("place"))]
    near += [F.when(at == span - 1, F.struct((block + 1).alias("block"), F.lit(-1).alias("place"))), F.when(at == 0, F.struct((block - 1).alias("block"), F.lit(1).alias("place")))]
    rows = found.select("key", "number", kind.cast("int").alias("kind"), F.explode(F.array_compact(F.array(*near))).alias("_b"))
    rows = rows.select("key", "number", "kind", F.col("_b.block").alias("block"), F.col("_b.place").alias("place"))
    levels = [cut(_walked(rows, "block", ["number"], _ROWS))]
    while not (rest := levels[-1].where("NOT (begins AND ends)")).isEmpty():
        levels.append(cut(_walked(rest.withColumn("above", F.expr(f"block div {span}")), "above", ["key", "block"], _GROUPS)))
    return levels


def _chosen(level: DataFrame) -> DataFrame:
    """The cheapest way of each conversation that a level completes, with the inserts that close it."""
    last = F.col("state")
    closing = F.when(last == 1, "II").when(last == 2, "I").otherwise("")
    whole = level.where("begins AND ends").withColumn("closing", closing)
    whole = whole.withColumns({"total": F.col("cost") + INSERT * F.length("closing"), "all": F.concat("audit", "closing")})
    best = F.min(F.struct("total", "all", "lo", "entry", "state", "audit", "path", "closing")).alias("b")
    return whole.groupBy("key", "block").agg(best).select("key", F.col("b.total").alias("cost"), F.col("b.all").alias("whole"), "b.lo", "b.entry", "b.audit", "b.path", "b.closing")


def _parts(chosen: DataFrame, item: Column | None = None) -> DataFrame:
    """One row for each element of chosen stretches: its number, the states around it, and the closing inserts after the last."""
    states = F.split("path", "")
    out = chosen.select("key", "lo", "entry", "closing", *([item.alias("items")] if item is not None else []), states.alias("states"), F.posexplode(states).alias("i", "s"))
    entry = F.when(F.col("i") == 0, F.col("entry")).otherwise(F.get("states", F.col("i") - 1).cast("int"))
    closing = F.when(F.col("i") == F.size("states") - 1, F.col("closing")).otherwise("")
    more = [F.get("items", F.col("i")).alias("edit")] if item is not None else []
    return out.select("key", (F.col("lo") + F.col("i")).alias("block"), entry.alias("entry"), F.col("s").cast("int").alias("state"), closing.alias("closing"), *more)


def repair(rows: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """Audits and repaired turns of all conversations in rows (conv_id, turn, role, text; other columns are not read).

    audits: key and conv_id, gaps (turns missing between the least and the largest), blank, duplicate and truncated (rows by first fault),
    illegal (neighbours whose role initials are not su, ua or au), cost, and audit, the initials of the edits in order.
    repaired: key, conv_id, number and place (the order of turns), role, text, edit (K, R or I). A conversation that loses all rows
    has none there. A null conv_id is one conversation, a null role or text empty, a null turn the first and without a gap. Without rows
    there are none. The audit of a conversation is one string, which the rows of the levels hold for each pair of states.
    """
    lines = numbered(rows)
    found = cut(faults(lines))
    levels = _levels(found, span)
    best = [cut(_chosen(level)) for level in levels]
    costs = best[0].select("key", "cost", F.col("whole").alias("audit"))
    for b in best[1:]:
        costs = costs.unionByName(b.select("key", "cost", F.col("whole").alias("audit")))
    names = lines.groupBy("key").agg(F.first("conv_id").alias("conv_id"))
    each = found.groupBy("key", "turn").agg(*(F.sum((F.col("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")))
    each = each.groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"),
        *(F.coalesce(F.sum(f), F.lit(0)).cast("long").alias(f) for f in ("blank", "duplicate", "truncated")),
    )
    illegal = levels[0].groupBy("key", "block").agg(F.max("illegal").alias("illegal")).groupBy("key").agg(F.sum("illegal").alias("illegal"))
    audits = names.join(each, "key").join(illegal, "key").join(costs, "key")

    columns = ("key", "lo", "entry", "audit", "path", "closing")
    down = best[-1].select(*columns)
    for level, b in zip(levels[-2::-1], best[-2::-1]):
        parts = _parts(down)
        children = level.select("key", "block", "lo", "entry", "state", "audit", "path").join(parts, ["key", "block", "entry", "state"])
        down = b.select(*columns).unionByName(children.select(*columns))
    edits = _parts(down, F.regexp_extract_all("audit", F.lit("(I*[DKR])"), F.lit(1))).withColumnRenamed("block", "_number")
    there = lines.select("conv_id", "key", "number", "role", "text").join(edits.drop("key"), F.col("number") == F.col("_number"))
    own = F.substring("edit", -1, 1)
    now = F.when(own == "K", F.col("role")).when(F.col("state") == 2, "user").otherwise("assistant")
    blank = lambda n, after: F.expr(f"transform(sequence(1, {n}), i -> named_struct('role', IF((i + IF({after} = 2, 1, 0)) % 2 = 1, 'user', 'assistant'), 'text', '', 'edit', 'I'))")
    none = F.expr("array_remove(array(named_struct('role', '', 'text', '', 'edit', '')), named_struct('role', '', 'text', '', 'edit', ''))")
    before = F.when(F.length("edit") > 1, blank("length(edit) - 1", "entry")).otherwise(none)
    itself = F.when(own == "D", none).otherwise(F.array(F.struct(now.alias("role"), F.col("text"), own.alias("edit"))))
    after = F.when(F.length("closing") > 0, blank("length(closing)", "state")).otherwise(none)
    repaired = there.select("key", "conv_id", "number", F.posexplode(F.concat(before, itself, after)).alias("place", "t"))
    return audits, repaired.select("key", "conv_id", "number", "place", "t.role", "t.text", "t.edit")


def digests(repaired: DataFrame) -> DataFrame:
    """(key, sha256) of each conversation's `role:text` lines. Lines stream through the digest in order, so none is held but the present one.

    A digest is sequential, so the lines of one conversation pass one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = sha = None
        for batch in batches:
            keys, shas = [], []
            for k, line in zip(batch.column("key").to_pylist(), batch.column("line").to_pylist()):
                if k != key:
                    if sha is not None:
                        keys.append(key)
                        shas.append(sha.hexdigest())
                    key, sha = k, hashlib.sha256(line.encode())
                else:
                    sha.update(b"\n" + line.encode())
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(shas, pa.string())], ["key", "sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([sha.hexdigest()], pa.string())], ["key", "sha256"])

    lines = small_batches(repaired).select("key", "number", "place", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition("key").sortWithinPartitions("key", "number", "place").select("key", "line").mapInArrow(run, "key string, sha256 string")


def damage(rows: DataFrame) -> DataFrame:
    """conversations as a careless copy leaves them: by crc32 of `conv_id:turn` a twentieth each of the rows is lost, is emptied, loses its
    ends of sentences, comes twice, or gets the role user. Nulls of role and text become one space, also in the text that is hashed."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", part("role").alias("role"), part("text").alias("text"), lot.alias("lot")).where("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(0), F.when(F.col("lot") == 3, 2).otherwise(1))
    rows = rows.select("conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("_copy"))
    return rows.drop("_copy")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of conversations: what damage() did to it, the cost and audit of its repair, and the digest of the repaired turns."""
    audits, repaired = repair(damage(conversations))
    told = audits.join(digests(repaired), "key", "left").withColumnRenamed("conv_id", "_of").drop("key")
    every = conversations.select("conv_id").distinct()
    out = every.join(told, F.col("conv_id").eqNullSafe(F.col("_of")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(nothing)).alias("repaired_sha256"))
