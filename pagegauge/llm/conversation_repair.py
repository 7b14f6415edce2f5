"""Conversation structure repair: the cheapest edits that make the turns of a conversation follow a role grammar.

The grammar is ``conversation -> empty | turns``, ``turns -> pair | system pair | turns pair``, ``pair -> user assistant``. Its LR
parser has four stack tops between which rows are read (``SHIFT``). The repair runs it generalised: a graph-structured stack holds every
top that some sequence of edits reaches; for each row it is kept, given another role, deleted, and rows are inserted before it; what
arrives at equal tops is merged, and the least (cost, audit) stays. What can be read from a top doesn't depend on what lies below it, so the
merged top needs one link only.

Edits, their initials and costs: Keep 0, Rerole (to user or assistant) 3, Delete 4, Insert (an empty user or assistant text) 3. Blank and
repeated rows must be deleted; a truncated row that stays costs 3 more. Of equally cheap audits the ASCII-least is taken. No audit of
equally many rows is the beginning of another, for each ends with the edit of the last row; so the order of two tops never changes once
they differ, and a frontier of tops is fully told by its order and its costs above the least. There are few such frontiers: each step from
one to the next is computed once (``_step``). A top more than ``SLACK`` dearer than the cheapest is dropped: from any top two inserts and
one deletion (a system turn) do whatever the other could.

On Spark: repeated rows are found by a window over (conversation, hash of role and text), so that one long conversation spreads; the rows
are then shuffled by conversation, sorted on disk and streamed. A conversation is never held: of the undecided part there are links, of the
decided part its audit, and the hash of the repaired text is carried by each top. That hash reads a conversation's texts in order, so a
conversation is one task's stream, however long; memory doesn't grow with its texts.

Nulls: a null text or role is one space, a null turn sorts first and isn't counted in gaps, rows of null conv_id make one conversation. Rows of
equal turn are ordered by role, then text; repeated rows are duplicates of the first. An empty role has no initial and can't be kept. Extra
columns are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3
#: Tops of the parser: nothing read, a system turn, an open user turn, whole pairs. A shift is followed by the reductions that are due:
#: an assistant turn closes its pair, and pairs join what stands before them, a system turn included.
NOTHING, SYSTEM, OPEN, PAIRS = range(4)
SHIFT = {NOTHING: {"s": SYSTEM, "u": OPEN}, SYSTEM: {"u": OPEN}, OPEN: {"a": PAIRS}, PAIRS: {"u": OPEN}}
ACCEPTED = (NOTHING, PAIRS)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
SLACK = 2 * COST[INSERT] + COST[DELETE]
BLANKS = " \t\n\x0b\x0c\r"

#: (top, cost above the least) in the order of the audits.
Frontier = tuple[tuple[int, int], ...]
#: Of a new top: the old one's index, the edits, and what is written: a role for an insert, (role,) for the row under another role, () as it is.
Back = tuple[int, str, tuple]


def _inserts(top: int) -> list[tuple[int, str, tuple]]:
    """Tops reached by inserts alone; more than two come back to a top that was there before."""
    out, last = [(top, "", ())], (top, "", ())
    for _ in range(2):
        at, edits, wrote = last
        letter = next(x for x in SHIFT[at] if x in ROLES)
        last = (SHIFT[at][letter], edits + INSERT, (*wrote, ROLES[letter]))
        if last[0] != top:
            out.append(last)
    return out


@lru_cache(maxsize=None)
def _step(frontier: Frontier, initial: str, fault: str) -> tuple[int, Frontier, tuple[Back, ...]]:
    """One row read from a frontier: what the least cost grows by, the next frontier, and where each of its tops comes from."""
    best: dict[int, tuple] = {}

    def offer(to: int, cost: int, back: Back) -> None:
        if to not in best or (cost, back[0], back[1]) < best[to][:3]:
            best[to] = (cost, back[0], back[1], back[2])

    more = TRUNCATED_COST if fault == "truncated" else 0
    for k, (top, cost) in enumerate(frontier):
        for at, edits, wrote in _inserts(top):
            paid = cost + COST[INSERT] * len(edits)
            offer(at, paid + COST[DELETE], (k, edits + DELETE, wrote))
            if fault in ("blank", "duplicate"):
                continue
            if initial in SHIFT[at]:
                offer(SHIFT[at][initial], paid + COST[KEEP] + more, (k, edits + KEEP, (*wrote, ())))
            for letter, role in ROLES.items():
                if letter in SHIFT[at]:
                    offer(SHIFT[at][letter], paid + COST[REROLE] + more, (k, edits + REROLE, (*wrote, (role,))))
    least = min(b[0] for b in best.values())
    kept = sorted(((b[1], b[2], top, b[0] - least, b[3]) for top, b in best.items() if b[0] <= least + SLACK), key=lambda x: x[:3])
    return least, tuple((top, cost) for _, _, top, cost, _ in kept), tuple((k, edits, wrote) for k, edits, _, _, wrote in kept)


class _Conversation:
    """The frontier over the rows of one conversation so far, with what the columns count."""

    SETTLE = 256

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.counts = dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal"), 0)
        self.first = self.turn = self.initial = None
        self.turns = self.cost = self.rows = 0
        self.frontier: Frontier = ((NOTHING, 0),)
        # of each top: its audit as links back to what is decided, and the hash of the repaired text
        self.decided: list[str] = []
        self.tops: list[tuple] = [(None, hashlib.sha256())]
        self.settle_at = self.SETTLE

    def read(self, turn, role: str, text: str, fault: str) -> None:
        if turn is not None and turn != self.turn:
            self.first, self.turn, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.initial = initial
        paid, after, backs = _step(self.frontier, initial if initial in "sua" else "", fault)
        self.cost += paid
        tops = []
        for k, edits, wrote in backs:
            link, digest = self.tops[k]
            if wrote:
                digest = _written(digest.copy(), wrote, self.frontier[k][0] != NOTHING, role, text)
            tops.append(((link, edits), digest))
        self.frontier, self.tops = after, tops
        self.rows += 1
        if self.rows >= self.settle_at:
            self._settle()

    def _settle(self) -> None:
        """Moves what all audits begin with to what is decided; waits longer if that was little."""
        audits = [_unlinked(link) for link, _ in self.tops]
        n = 0
        for signs in zip(*audits):
            if len(set(signs)) > 1:
                break
            n += 1
        self.decided.append(audits[0][:n])
        self.tops = [((None, a[n:]), digest) for a, (_, digest) in zip(audits, self.tops, strict=True)]
        self.settle_at = self.rows + max(self.SETTLE, *(len(a) - n for a in audits))

    def result(self) -> tuple:
        ends = []
        for k, (top, cost) in enumerate(self.frontier):
            ends += [(cost + COST[INSERT] * len(edits), k, edits, wrote) for at, edits, wrote in _inserts(top) if at in ACCEPTED]
        cost, k, edits, wrote = min(ends)
        link, digest = self.tops[k]
        digest = _written(digest.copy(), wrote, self.frontier[k][0] != NOTHING, "", "")
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, self.counts | {"gaps": gaps}, self.cost + cost, "".join(self.decided) + _unlinked((link, edits)), digest.hexdigest())


def _written(digest, wrote: tuple, begun: bool, role: str, text: str):
    for w in wrote:
        line = f"{w}:" if isinstance(w, str) else f"{w[0] if w else role}:{text}"
        digest.update((("\n" if begun else "") + line).encode("utf-8", "surrogatepass"))
        begun = True
    return digest


def _unlinked(link: tuple | None) -> str:
    parts = []
    while link is not None:
        link, edits = link
        parts.append(edits)
    return "".join(reversed(parts))


def _repaired(kind: pa.Schema, size: int = 4_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now: _Conversation | None = None

        def batch() -> pa.RecordBatch:
            rows = [{"conv_id": c, **counts, "cost": cost, "audit": audit, "repaired_sha256": sha} for c, counts, cost, audit, sha in out]
            out.clear()
            return pa.RecordBatch.from_pylist(rows, kind)

        for b in batches:
            cols = [b.column(name).to_pylist() for name in ("conv_id", "alive", "turn", "role", "text", "fault")]
            for conv_id, alive, turn, role, text, fault in zip(*cols, strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        out.append(now.result())
                        if len(out) >= size:
                            yield batch()
                    now = _Conversation(conv_id)
                if alive:
                    now.read(turn, role, text, fault)
        if now is not None:
            out.append(now.result())
        if out:
            yield batch()

    return run


def with_faults(rows: DataFrame, alive: Column | None = None) -> DataFrame:
    """``conv_id, turn, role, text, alive, fault`` with nulls as one space; the first of blank, duplicate, truncated that holds, else empty."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.lit(True).alias("alive") if alive is None else alive.alias("alive"))
    same = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "alive", same).orderBy(F.asc_nulls_first("turn"))) > 1
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(end == "", "blank").when(earlier, "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return plain.withColumn("fault", fault)


def _schema(rows: DataFrame, **columns: DataType) -> StructType:
    return StructType([StructField("conv_id", rows.schema["conv_id"].dataType), *(StructField(name, kind) for name, kind in columns.items())])


def _in_order(rows: DataFrame, *before: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *before, F.asc_nulls_first("turn"), "role", "text")


def repair(rows: DataFrame, alive: Column | None = None) -> DataFrame:
    """One row for each conversation of ``rows(conv_id, turn, role, text)``: gaps, faults, cost and audit of the cheapest repair, and its hash.

    Rows for which ``alive`` is false aren't read, but their conversation is in the result.
    """
    schema = _schema(rows, **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), LongType()), audit=StringType(), repaired_sha256=StringType())
    return _in_order(with_faults(rows, alive)).mapInArrow(_repaired(to_arrow_schema(schema)), schema)


def _edited(kind: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edits, position, top = iter(""), 0, NOTHING

        def one(conv_id, edit: str, role: str, text: str) -> dict:
            nonlocal position, top
            if edit != KEEP:
                role = ROLES[next(x for x in SHIFT[top] if x in ROLES)]
            top, position = SHIFT[top][role[:1]], position + 1
            return {"conv_id": conv_id, "position": position - 1, "role": role, "text": text, "edit": edit}

        for b in batches:
            out = []
            cols = [b.column(name).to_pylist() for name in ("conv_id", "audit", "role", "text", "closing")]
            for conv_id, audit, role, text, closing in zip(*cols, strict=True):
                if audit is not None:
                    edits, position, top = iter(audit), 0, NOTHING
                    continue
                for edit in edits:
                    if edit != DELETE:
                        out.append(one(conv_id, edit, role if edit != INSERT else "", text if edit != INSERT else ""))
                    if edit != INSERT and not closing:
                        break
            yield pa.RecordBatch.from_pylist(out, kind)

    return run


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, position, role, text, edit`` (K, R or I); deleted rows aren't there.

    Each conversation's audit goes before its rows in the stream, and a closing row behind them, for inserts at the end.
    """
    plain = with_faults(rows).select("conv_id", "turn", "role", "text", F.lit(1).alias("ord"), F.lit(None).cast("string").alias("audit"), F.lit(False).alias("closing"))
    audits = repair(rows).select("conv_id", "audit")
    ends = audits.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.explode(F.array(F.lit(0), F.lit(2))).alias("ord"), "audit")
    ends = ends.withColumns({"audit": F.when(F.col("ord") == 0, F.col("audit")), "closing": F.col("ord") == 2})
    schema = _schema(rows, position=LongType(), role=StringType(), text=StringType(), edit=StringType())
    return _in_order(plain.unionByName(ends), "ord").mapInArrow(_edited(to_arrow_schema(schema)), schema)
