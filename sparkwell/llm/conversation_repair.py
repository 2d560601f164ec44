"""Conversation structure repair: Dijkstra on the implicit lattice of (turn index, grammar state).

The grammar of role initials is (s?(ua)+)?: state 0 is the beginning, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
Edits are Keep (0), Rerole to user or assistant (2), Delete (3) and Insert of an empty user or assistant turn (2); blank and
duplicate turns must go, and a truncated turn that stays adds 1.  The priority is (cost, audit), audit being the edits'
initials, so the first accepting end node that is popped has the cheapest edits, and of equally cheap ones the least.

Rows are sorted by ranges of (conversation, turn), never by conversation, and the sorted stream is cut into segments of at most
SEGMENT turns, one row each.  A conversation that is one segment is repaired in place.  One of several segments (it
is long, or lies over the edge of a range) is repaired in pieces: from each entry state Dijkstra settles a segment's four exits,
whose costs and order are all that other segments need; segments are folded in order, and each is then walked again
from the entry that the fold chose.  Two entries' audits end with a turn's edit and never begin one another, so their order
decides every later tie.  A hash of a whole conversation is sequential by nature: its text passes through one task, in pieces.

Defined cases: a null role or text is one space, and so is a null conversation or turn in the damage's hash; null turns come
first; turns with equal numbers are ordered by role, the text's first 32 characters and its hash; repeated rows are repeated turns, and
so duplicates; a null conversation is one like others; without rows after damage: zeros, an empty audit, the empty
string's hash; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkwell.llm.common import streamed, table, trim, written

#: A segment has so many turns, and so many characters of text, at most (a longer turn is one by itself).
SEGMENT, SEGMENT_CHARS = 1024, 1 << 20
KEEP, REROLE, DELETE, INSERT, STAYS_TRUNCATED = 0, 2, 3, 2, 1
#: From each state, the state after a role's initial; the role that Insert and Rerole give there; states that may end.
AFTER = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEXT_ROLE = ("user", "user", "assistant", "user")
ENDS = (0, 3)
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: rows after damage; a dropped row stays as a mark of its conversation."""
    told = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    what = F.crc32(told) % 20
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), what.alias("what"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("what") < 2, "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("what") == 0).alias("gone"),
        F.explode(F.when(F.col("what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def cheapest(faults: list, initials: list, entry: int, exits=None) -> dict[int, tuple[int, str]]:
    """Exit state to (cost, audit) over these turns from a state.

    exits None: the whole conversation, of which only the first accepting end node is popped.  Otherwise the search goes on until the
    exits are settled, and turns are inserted only before a turn, so that no two segments share a place for them.
    """
    n, found, done = len(initials), {}, set()
    heap = [(0, "", 0, entry)]
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n and (exits is not None or state in ENDS):
            found[state] = (cost, audit)
            if exits is None or all(e in found for e in exits):
                break
        if exits is None or i < n:
            heapq.heappush(heap, (cost + INSERT, audit + "I", i, AFTER[state][NEXT_ROLE[state][0]]))
        if i < n:
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if faults[i] not in ("blank", "duplicate"):
                stays = STAYS_TRUNCATED * (faults[i] == "truncated")
                heapq.heappush(heap, (cost + REROLE + stays, audit + "R", i + 1, AFTER[state][NEXT_ROLE[state][0]]))
                if initials[i] in AFTER[state]:
                    heapq.heappush(heap, (cost + KEEP + stays, audit + "K", i + 1, AFTER[state][initials[i]]))
    return found


def repaired(audit: str, roles: list, texts: list, state: int = 0) -> list[str]:
    """The turns, as role:text, that the edits leave."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role = roles[i] if edit == "K" else NEXT_ROLE[state]
        out.append(f"{role}:{'' if edit == 'I' else texts[i]}")
        state = AFTER[state][role[:1]]
        i += edit != "I"
    return out


def faults_of(roles: list, texts: list, late: set) -> list[str]:
    """The first fault of each turn, "" without one; late: turns that repeat one of an earlier segment."""
    out, seen = [], set()
    for i, (role, text) in enumerate(zip(roles, texts)):
        last = text.rstrip(SPACE)[-1:]
        if not last:
            out.append("blank")
            continue
        key = (role, text)
        out.append("duplicate" if key in seen or i in late else "truncated" if last not in ".!?" else "")
        seen.add(key)
    return out


def illegal(initials: list) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def gaps(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"


def whole(turns: list, roles: list, texts: list) -> tuple:
    """The result's columns for a conversation of one segment."""
    faults, initials = faults_of(roles, texts, set()), [r[:1] for r in roles]
    ((cost, audit),) = cheapest(faults, initials, 0).values()
    told = hashlib.sha256("\n".join(repaired(audit, roles, texts)).encode()).hexdigest()
    return (gaps(turns), *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal(initials), cost, audit, told)


def segments(rows: DataFrame) -> DataFrame:
    """Sorted rows as segments: conv_id, part, seg (their order), edge (another segment may belong to it), turns, roles, texts."""
    order = ["conv_id", "turn", "role", F.substring("text", 1, 32), F.xxhash64("text"), "copy"]
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *T.StructType.fromDDL("part int, seg long, edge boolean, turns array<long>, roles array<string>, texts array<string>").fields])

    def cut(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        part, arrow = TaskContext.get().partitionId(), to_arrow_type(kind)
        ready, size, seg = [], 0, 0
        open_, first = None, True  # a conversation's segment that is being filled: id, turns, roles, texts, characters, edge

        def table_of(rows):
            columns = list(zip(*rows))
            kinds = (arrow, pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)

        def close(edge):
            nonlocal seg, size
            ready.append((open_[0], part, seg, edge or open_[5], *open_[1:4]))
            size += open_[4]
            seg += 1

        for batch in batches:
            for conv, turn, role, text, gone in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if open_ is not None and open_[0] != conv:
                    close(False)
                    open_ = None
                    if size > 8 * SEGMENT_CHARS or len(ready) >= 2000:
                        yield table_of(ready)
                        ready, size = [], 0
                if open_ is None:
                    open_, first = [conv, [], [], [], 0, first], False
                if gone:
                    continue
                if open_[1] and (len(open_[1]) >= SEGMENT or open_[4] + len(text) > SEGMENT_CHARS):
                    close(True)
                    open_ = [conv, [], [], [], 0, True]
                    if size > 8 * SEGMENT_CHARS:
                        yield table_of(ready)
                        ready, size = [], 0
                for k, x in ((1, turn), (2, role), (3, text)):
                    open_[k].append(x)
                open_[4] += len(text)
        if open_ is not None:
            close(True)
        if ready:
            yield table_of(ready)
        trim()

    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return ranged.select("conv_id", "turn", "role", "text", "gone").mapInArrow(cut, schema)


def with_late(parts: DataFrame) -> DataFrame:
    """parts with late: the places of turns that repeat a turn of an earlier segment of the conversation."""
    kind = T.StructType([parts.schema["conv_id"], *T.StructType.fromDDL("part int, seg long, i int, key binary").fields])

    def keys(rows):
        for row in rows:
            seen = set()
            for i, (role, text) in enumerate(zip(row["roles"], row["texts"])):
                key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                if text.strip(SPACE) and key not in seen:
                    seen.add(key)
                    yield row["conv_id"], row["part"], row["seg"], i, key

    told = streamed(parts.select("conv_id", "part", "seg", "roles", "texts"), [], keys, kind)
    at = F.struct("part", "seg")
    firsts = told.groupBy("conv_id", "key").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "first")
    again = told.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).where(at > F.col("first"))
    late = again.groupBy("part", "seg").agg(F.collect_list("i").alias("late"))  # no more than a segment has turns
    return parts.join(late, ["part", "seg"], "left").select(*parts.columns, F.coalesce("late", F.array().cast("array<int>")).alias("late"))


#: What a segment tells others: cost of (entry, exit) at 4 * entry + exit, -1 where there is no way; the exits of an entry, best audit first.
SUMMARY = "part int, seg long, n int, costs array<long>, orders array<int>, faults array<long>, illegal long, first string, last string, least long, most long, distinct long, first_turn long, last_turn long"


def summary(rows):
    (row,) = rows
    roles, turns = row["roles"], row["turns"]
    faults, initials = faults_of(roles, row["texts"], set(row["late"])), [r[:1] for r in roles]
    costs, orders = [-1] * 16, []
    for entry in range(4):
        ways = cheapest(faults, initials, entry, exits=range(4))
        for state, (cost, _) in ways.items():
            costs[4 * entry + state] = cost
        best = sorted(ways, key=lambda s: ways[s][1])
        orders += best + [-1] * (4 - len(best))
    known = [t for t in turns if t is not None]
    ends = (min(known), max(known), len(set(known)), known[0], known[-1]) if known else (None, None, 0, None, None)
    yield row["conv_id"], row["part"], row["seg"], len(roles), costs, orders, [faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal(initials), *((initials[0], initials[-1]) if roles else (None, None)), *ends


class Fold:
    """Segments of one conversation so far: for each state the cost and how its audit ranks, and which entry each exit came from."""

    def __init__(self):
        self.ways, self.places, self.back = {0: (0, 0)}, [], []
        self.counts, self.illegal, self.last, self.turn = [0, 0, 0], 0, None, None
        self.least = self.most = None
        self.distinct = 0

    def add(self, row):
        if not row["n"]:
            return
        found = {}
        for entry, (cost, rank) in self.ways.items():
            order = [s for s in row["orders"][4 * entry : 4 * entry + 4] if s >= 0]
            for place, state in enumerate(order):
                way = (cost + row["costs"][4 * entry + state], rank, place, entry)
                if state not in found or way[:2] < found[state][:2]:
                    found[state] = way
        ranks = {s: k for k, s in enumerate(sorted(found, key=lambda s: found[s][1:3]))}
        self.ways = {s: (w[0], ranks[s]) for s, w in found.items()}
        self.places.append((row["part"], row["seg"]))
        self.back.append(bytes(found[s][3] if s in found else 9 for s in range(4)))
        self.counts = [a + b for a, b in zip(self.counts, row["faults"])]
        self.illegal += row["illegal"] + (self.last is not None and self.last + row["first"] not in ("su", "ua", "au"))
        self.last = row["last"]
        if row["least"] is not None:
            self.distinct += row["distinct"] - (self.turn == row["first_turn"])
            self.turn = row["last_turn"]
            self.least = row["least"] if self.least is None else min(self.least, row["least"])
            self.most = row["most"] if self.most is None else max(self.most, row["most"])

    def chosen(self):
        """(part, seg, entry, exit, tail, the counts) for each segment with turns; tail: edits after the last turn."""
        best = None
        for state, (cost, rank) in self.ways.items():
            tail = ""
            while state_after(state, tail) not in ENDS:
                tail += "I"
            way = (cost + INSERT * len(tail), rank, tail, state)
            best = way if best is None or way < best else best
        cost, _, tail, state = best
        turns = 0 if self.least is None else self.most - self.least + 1 - self.distinct
        counts = [turns, *self.counts, self.illegal, cost]
        out = []
        for k in reversed(range(len(self.places))):
            entry = self.back[k][state]
            out.append((*self.places[k], entry, state, tail if k == len(self.places) - 1 else "", counts))
            state = entry
        return out


def state_after(state: int, tail: str) -> int:
    for _ in tail:
        state = AFTER[state][NEXT_ROLE[state][0]]
    return state


def folded(rows):
    fold = Fold()
    for row in rows:
        fold.add(row)
    return fold.chosen()


def pieces(rows):
    """Audit and repaired text of one segment, walked from its entry to its exit; a segment without turns has neither."""
    (row,) = rows
    audit, turns = "", []
    if row["entry"] is not None:
        faults = faults_of(row["roles"], row["texts"], set(row["late"]))
        audit = cheapest(faults, [r[:1] for r in row["roles"]], row["entry"], exits=(row["exit"],))[row["exit"]][1] + row["tail"]
        turns = repaired(audit, row["roles"], row["texts"], row["entry"])
    yield row["conv_id"], row["part"], row["seg"], row["counts"], audit, "\n".join(turns) if turns else None


def told(rows):
    """The result's row of one conversation from its pieces in order."""
    counts, audit, digest, between = None, [], hashlib.sha256(), ""
    for row in rows:
        counts = row["counts"] or counts
        audit.append(row["audit"])
        if row["text"] is not None:
            digest.update((between + row["text"]).encode())
            between = "\n"
    yield row["conv_id"], *(counts or [0] * len(COUNTS)), "".join(audit), digest.hexdigest()


def of_many(parts: DataFrame) -> DataFrame:
    """The result for conversations of several segments."""
    conv = parts.schema["conv_id"]

    def schema(ddl):
        return T.StructType([conv, *T.StructType.fromDDL(ddl).fields])

    def in_order(df):
        return df.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")

    parts = written(with_late(parts), "repair-parts")
    costs = in_order(streamed(parts, [], summary, schema(SUMMARY)))
    ways = streamed(costs, ["conv_id"], folded, T.StructType.fromDDL("part int, seg long, entry int, exit int, tail string, counts array<long>"))
    walked = streamed(parts.join(ways, ["part", "seg"], "left"), [], pieces, schema("part int, seg long, counts array<long>, audit string, text string"))
    return streamed(in_order(walked), ["conv_id"], told, schema(RESULT))


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: its counts of faults, the cost and audit of the cheapest repair, and the repaired turns' hash.

    rows: conv_id, turn, role, text and gone (true: a mark that the conversation exists, no turn), as `damaged` gives them;
    copy, where there is one, tells repeated rows apart.
    """
    if "copy" not in rows.columns:
        rows = rows.withColumn("copy", F.lit(0))
    parts = written(segments(rows), "repair-segments")
    schema = T.StructType([parts.schema["conv_id"], *T.StructType.fromDDL(RESULT).fields])

    def one(rows):
        for row in rows:
            yield row["conv_id"], *whole(row["turns"], row["roles"], row["texts"])

    return streamed(parts.where("not edge"), [], one, schema).unionByName(of_many(parts.where("edge")))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))
