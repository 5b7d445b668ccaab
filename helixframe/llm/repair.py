"""Repair of conversation structure by a Viterbi search whose survivors coalesce.

A repaired conversation is empty, or an optional system turn followed by pairs
of user and assistant turns.  Turns are walked in order; for each state (what
the last turn left standing was) the cheapest edits that lead there survive, as
a leaf of a tree of backpointers.  Nodes count their references: branches that
no survivor stands on go, and as soon as all survivors share an ancestor, the
edits up to it are decided and are emitted.  Equal costs are settled by
comparing the edits that are still open, as a whole, so that a task holds the
open part of one conversation.  That is a few turns, unless two ways of equal
cost stay open because only the conversation's end decides between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
#: States: nothing stands yet, a system turn, a user turn, an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: From which states a turn of the role leads where.
FROM = {SYSTEM: (START,), USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
BLANK = r"[\x20\x09-\x0D]"
#: Edits, and characters of text, that a batch of output holds at most (or one edit).
OUT_ROWS, OUT_CHARS = 1000, 1 << 22


class Node:
    """An edit on some survivor's path; uses: children and survivors that stand on it."""

    __slots__ = ("edit", "kids", "op", "parent", "uses")

    def __init__(self, parent: Node | None, op: str, edit: tuple):
        self.parent, self.op, self.edit, self.kids, self.uses = parent, op, edit, [], 0
        if parent is not None:
            parent.kids.append(self)
            parent.uses += 1


def _first(way: tuple) -> tuple:
    return way[:3]


class Survivors:
    """The search over one conversation: add() takes a turn and returns the edits that it decides, close() the rest.

    A survivor is (cost, rank, tail, node).  Ranks order the survivors' edits,
    from the first one that is still open to the last: those of lower rank come
    first.  Of survivors of one rank, one's edits begin all others', and tail is
    what each has beyond them (insertions, as all have passed the same turns).
    So a tie is a comparison of all open edits, at the cost of a few letters.
    """

    def __init__(self) -> None:
        self.root = Node(None, "", ())
        self.best: list[tuple[int, int, str, Node] | None] = [(0, 0, "", self.root), None, None, None]
        self.root.uses = 1
        self._insert()
        self._rank()

    def _stand(self, node: Node, on: bool) -> None:
        node.uses += 1 if on else -1
        while not node.uses and node is not self.root:
            parent = node.parent
            parent.kids.remove(node)
            parent.uses -= 1
            node = parent

    def _insert(self) -> None:
        """Insertions between two turns: a user turn, then an assistant turn; going round twice only costs."""
        for state in (USER, ASSISTANT):
            have = self.best[state]
            way = min(((b[0] + INSERT_COST, b[1], b[2] + INSERT, b[3]) for b in map(self.best.__getitem__, FROM[state]) if b is not None), key=_first, default=None)
            # Equal costs never tie in full: the surplus of edits that begin with all the others' could only be insertions, which cost.
            if way is not None and (have is None or way[:3] < have[:3]):
                new = Node(way[3], INSERT, (INSERT_COST, ROLE[state], "", "", None))
                self._stand(new, True)
                if have is not None:
                    self._stand(have[3], False)
                self.best[state] = (*way[:3], new)

    def _prune(self) -> None:
        """Survivors go that cost more than another one whatever follows.

        After a system turn the same turns must follow as may after an assistant turn; before the first turn as well,
        but for a system turn, whose deletion is dearer by that much at most.
        """
        done = self.best[ASSISTANT]
        for state, more in ((SYSTEM, 0), (START, DELETE_COST)):
            have = self.best[state]
            if have is not None and have[0] > done[0] + more:
                self.best[state] = None
                self._stand(have[3], False)

    def _rank(self) -> None:
        rank, lead = -1, None
        for cost, old, tail, node, state in sorted(((*b, s) for s, b in enumerate(self.best) if b is not None), key=lambda x: x[1:3]):
            if lead is None or old != lead[0] or not tail.startswith(lead[1]):
                rank, lead = rank + 1, (old, tail)
            self.best[state] = (cost, rank, tail[len(lead[1]) :], node)

    def add(self, role: str, text: str, fault: str, turn: object) -> list[tuple]:
        extra = TRUNCATED_COST if fault == "truncated" else 0
        new: list[tuple | None] = []
        for state in range(4):
            have = self.best[state]
            ways = [] if have is None else [(have[0] + DELETE_COST, have[1], have[2] + DELETE, have[3])]
            if fault not in ("blank", "duplicate") and state != START:
                kept = INITIAL.get(role[:1]) == state
                if kept or state in ROLE:
                    cost, op = (extra, KEEP) if kept else (extra + REROLE_COST, REROLE)
                    ways += [(b[0] + cost, b[1], b[2] + op, b[3]) for b in map(self.best.__getitem__, FROM[state]) if b is not None]
            if not ways:
                new.append(None)
                continue
            way = min(ways, key=_first)
            op = way[2][-1]
            edit = ({DELETE: DELETE_COST, KEEP: extra, REROLE: extra + REROLE_COST}[op], ROLE[state] if op == REROLE else role, text, fault, turn)
            new.append((*way[:3], Node(way[3], op, edit)))
        for n in new:
            if n is not None:
                self._stand(n[3], True)
        for have in self.best:
            if have is not None:
                self._stand(have[3], False)
        self.best = new
        self._insert()
        self._prune()
        self._rank()
        return self._decided()

    def _decided(self) -> list[tuple]:
        out = []
        while len(self.root.kids) == 1 and self.root.uses == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
            out.append((self.root.op, *self.root.edit))
        return out

    def close(self) -> list[tuple]:
        node = min((self.best[s] for s in (START, ASSISTANT) if self.best[s] is not None), key=_first)[3]
        out = []
        while node is not self.root:
            out.append((node.op, *node.edit))
            node = node.parent
        return out[::-1]


EDITS = "step long, op string, cost int, role string, text string, fault string, turn long, jump boolean"


def _walker(kind: pa.DataType):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv", kind), ("step", pa.int64()), ("op", pa.string()), ("cost", pa.int32()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("turn", pa.int64()), ("jump", pa.bool_())])
        out: list[tuple] = []
        chars = 0
        search, now, step, last, jumps = None, None, 0, None, []

        def put(edits: list[tuple]) -> None:
            nonlocal step, chars
            for op, cost, role, text, fault, turn in edits:
                # Whether the turn followed its predecessor, as the rows stood before repair.
                jump = jumps.pop(0) if op != INSERT else False
                out.append((now, step, op, cost, role, text, fault, turn, jump))
                step += 1
                chars += len(text)

        def batch() -> pa.RecordBatch:
            nonlocal chars
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            chars = 0
            return made

        for rows in batches:
            columns = [rows.column(i).to_pylist() for i in range(6)]
            for conv, turn, role, text, fault, again in zip(*columns, strict=True):
                if search is None or conv != now:
                    if search is not None:
                        put(search.close())
                    search, now, step, last = Survivors(), conv, 0, None
                # Equal turns of one number are neighbours: all but the first repeat it.
                if fault != "blank" and (again or last == (turn, role, text)):
                    fault = "duplicate"
                jumps.append(last is not None and (last[1][:1], role[:1]) not in LEGAL)
                last = (turn, role, text)
                put(search.add(role, text, fault, turn))
                if len(out) >= OUT_ROWS or chars >= OUT_CHARS:
                    yield batch()
        if search is not None:
            put(search.close())
        if out:
            yield batch()

    return run


def fault_of(text: Column) -> Column:
    """blank, truncated or an empty string."""
    blank = ~text.rlike(BLANK.replace("[", "[^", 1))
    return F.when(blank, "blank").when(text.rlike(rf"[^.!?\x20\x09-\x0D]{BLANK}*\z"), "truncated").otherwise("")


def repair_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The cheapest edits of every conversation, in order: conv, step (from 0), op, cost, role, text, fault, turn, jump.

    op: K keeps a turn, R gives it the role that stands in role, D deletes the
    turn (role and text are what it had), I inserts an empty turn.  The turns
    of K, R and I in order are the repaired conversation.  fault: the first
    that holds of blank, duplicate (role and text were seen earlier in the
    conversation), truncated (ends without . ! ?), or empty.  jump: the turn's
    and its predecessor's roles don't follow each other.  Ties go to the edits
    whose letters come first.

    Turns are ordered by number (integers; nulls first), then role, then text;
    nulls in role and text read as one space, rows without a conversation are
    one.  A role that is empty or begins with another letter than s, u or a can't be kept.
    Repeated rows are duplicates.  Other columns are ignored, whatever their
    names.  An empty table gives an empty table.  A conversation comes out in
    order within one partition, walked by one task, whose memory holds only
    undecided edits.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
    )
    rows = rows.withColumn("same", F.sha2(F.concat_ws("\0", "role", "text"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("at"))
    # Only what occurs twice comes into the join; copies are counted up before they are shuffled.
    seen = rows.groupBy(F.col("conv").alias("of"), F.col("same").alias("like")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(seen, F.col("conv").eqNullSafe(F.col("of")) & (F.col("same") == F.col("like")), "left")
    again = F.coalesce(place > F.col("first"), F.lit(False)).alias("again")
    rows = rows.select("conv", "turn", "role", "text", fault_of(F.col("text")).alias("fault"), again)
    rows = rows.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    kind = rows.schema["conv"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    return rows.mapInArrow(_walker(to_arrow_type(kind)), f"conv {kind.simpleString()}, {EDITS}")


def _summer(kind: pa.DataType):
    """Sums up neighbouring edits of a conversation; the repaired text goes through the hash as it comes."""
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, audit, digest, turns, some = None, None, [], None, None, False

        def row() -> list:
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
            return [now, gaps, sums["blank"], sums["duplicate"], sums["truncated"], sums["jump"], sums["cost"], "".join(audit), digest.hexdigest()]

        for batch in batches:
            out = []
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()  # noqa: B023, E731
            for conv, step, op, cost, role, text, fault, turn, jump in zip(*map(get, ("conv", "step", "op", "cost", "role", "text", "fault", "turn", "jump")), strict=True):
                if not step:
                    if sums is not None:
                        out.append(row())
                    now, sums, audit, digest, turns, some = conv, dict.fromkeys(("blank", "duplicate", "truncated", "jump", "cost", ""), 0), [], hashlib.sha256(), [None, None, 0], False
                sums[fault] += 1
                sums["jump"] += jump
                sums["cost"] += cost
                audit.append(op)
                if turn is not None and turn != turns[1]:
                    turns = [turn if turns[0] is None else turns[0], turn, turns[2] + 1]
                if op != DELETE:
                    digest.update(f"{chr(10) if some else ''}{role}:{text}".encode())
                    some = True
            if out:
                yield _rows(out)
        if sums is not None:
            yield _rows([row()])

    def _rows(out: list[list]) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def damaged(convs: DataFrame) -> DataFrame:
    """Turns damaged by crc32 of conversation and turn: dropped, emptied, without ends, repeated, or given to the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = convs.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20)).alias("what"))
    text = F.when(F.col("what") == 1, "").when(F.col("what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("what") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("what") == 3, 2).otherwise(1)
    return rows.where("what <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("copy"))


def op12_coalescent_repair(spark, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text of every conversation, after damage."""
    from pyspark.sql.pandas.types import to_arrow_type

    convs = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    edits = repair_conversations(damaged(convs))
    kind = edits.schema["conv"].dataType
    sums = edits.mapInArrow(_summer(to_arrow_type(kind)), f"conv {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    every = convs.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows"))
    out = every.join(sums, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    numbers = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: crc32 by its rule, a byte at a time; the search as a recursion over the turns, with the cheapest (cost, edits, repaired text) of each state.
OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([i] || range(8), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce([4294967295] || list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ord(x)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS what
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role,
    CASE what WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, range(CASE WHEN what = 3 THEN 2 ELSE 1 END) WHERE what <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
    WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
    lag(role) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM numbered),
counted AS (
  SELECT conv_id, CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (n > 1 AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
search AS (
  SELECT conv_id, 0::BIGINT AS n, {'c': 0, 'e': '', 'o': ''} AS z, {'c': 1000000000, 'e': '', 'o': ''} AS s, {'c': 2, 'e': 'I', 'o': chr(10) || 'user:'} AS u, {'c': 4, 'e': 'II', 'o': chr(10) || 'user:' || chr(10) || 'assistant:'} AS a
  FROM counted
  UNION ALL
  SELECT conv_id, n, z, s, u2, least(a1, {'c': u2.c + 2, 'e': u2.e || 'I', 'o': u2.o || chr(10) || 'assistant:'}) FROM (
    SELECT *, least(u1, {'c': z.c + 2, 'e': z.e || 'I', 'o': z.o || chr(10) || 'user:'}, {'c': s.c + 2, 'e': s.e || 'I', 'o': s.o || chr(10) || 'user:'}, {'c': a1.c + 2, 'e': a1.e || 'I', 'o': a1.o || chr(10) || 'user:'}) AS u2 FROM (
      SELECT f.conv_id, f.n, {'c': p.z.c + 3, 'e': p.z.e || 'D', 'o': p.z.o} AS z,
        least({'c': p.s.c + 3, 'e': p.s.e || 'D', 'o': p.s.o}, {'c': p.z.c + x.k + CASE WHEN left(f.role, 1) = 's' THEN 0 ELSE 1000000000 END, 'e': p.z.e || 'K', 'o': p.z.o || chr(10) || f.role || ':' || f.text}) AS s,
        least({'c': p.u.c + 3, 'e': p.u.e || 'D', 'o': p.u.o},
          {'c': p.z.c + x.k + x.u, 'e': p.z.e || x.eu, 'o': p.z.o || x.ou}, {'c': p.s.c + x.k + x.u, 'e': p.s.e || x.eu, 'o': p.s.o || x.ou}, {'c': p.a.c + x.k + x.u, 'e': p.a.e || x.eu, 'o': p.a.o || x.ou}) AS u1,
        least({'c': p.a.c + 3, 'e': p.a.e || 'D', 'o': p.a.o}, {'c': p.u.c + x.k + x.a, 'e': p.u.e || x.ea, 'o': p.u.o || x.oa}) AS a1
      FROM search p JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.n = p.n + 1,
      LATERAL (SELECT CASE f.fault WHEN '' THEN 0 WHEN 'truncated' THEN 1 ELSE 1000000000 END AS k,
        CASE WHEN left(f.role, 1) = 'u' THEN 0 ELSE 2 END AS u, CASE WHEN left(f.role, 1) = 'u' THEN 'K' ELSE 'R' END AS eu, chr(10) || CASE WHEN left(f.role, 1) = 'u' THEN f.role ELSE 'user' END || ':' || f.text AS ou,
        CASE WHEN left(f.role, 1) = 'a' THEN 0 ELSE 2 END AS a, CASE WHEN left(f.role, 1) = 'a' THEN 'K' ELSE 'R' END AS ea, chr(10) || CASE WHEN left(f.role, 1) = 'a' THEN f.role ELSE 'assistant' END || ':' || f.text AS oa) x))),
ended AS (SELECT conv_id, least(z, a) AS w FROM search QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1)
SELECT every.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(w.c, 0)::BIGINT AS cost, coalesce(w.e, '') AS audit, sha256(coalesce(w.o[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) every
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM every.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM every.conv_id
"""
