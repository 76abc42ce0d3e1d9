"""Conversation structure repair by generalised LR parsing with edits.

The grammar of role initials (``GRAMMAR``) is compiled into an SLR table. A conversation's rows are
its input, in order; beside the plain shift (Keep) each row may be deleted or read as another role,
and roles may be inserted anywhere, at the weights in ``COSTS``. All readings go on together on a
graph-structured stack: each row's stack tops, one a table state, since tops of equal state accept
the same rest and merge by the least (cost, audit). The audit is the sequence of edit initials; it
determines the repaired roles. Merging is exact: an audit determines its state and cost, so of two
audits that meet with equal cost none begins with the other, and their order stays as they grow.

A conversation streams through one task in order, first without its texts, then with them: the
first pass holds the few tops and the audit (a letter a row, as in the result), the second the
audit and a hash under way. Neither holds a conversation's rows or texts. Repeated rows are counted
before the first pass. Ties of a turn go by role, then by the text's MD5.

Edge cases: null roles and texts count as one space; a role that is no user, assistant or system by
its initial is reread or deleted, an empty one too; a null conversation id is a conversation of its
own; null turns come first; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NOT_SPACE, SPACE

#: Role initials ``(s?(ua)+)?`` as productions; the first symbol is the start.
GRAMMAR = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "ua"), ("P", "Pua"))
ROLES = {"u": "user", "a": "assistant"}  # what may be reread or inserted, by initial
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
TRUNCATED = 1  # more for a truncated row that stays
END = "$"
#: Any top can go on as another would at this cost more at most: a role inserted, or two, or one inserted and a system row
#: deleted. A top that costs more than that above the cheapest is given up.
SLACK = COSTS["I"] + COSTS["D"]
FLUSH = 32  # rows after which the tops' common audit is put away


class Table:
    """SLR actions of a grammar without useless symbols: lists, as a generalised parser takes all that apply."""

    def __init__(self, grammar=GRAMMAR):
        self.grammar = (("", grammar[0][0]), *grammar)
        left = {a for a, _ in grammar}
        follow = self._follow(left)
        self.states, self.shifts, self.reductions, self.goto = [], [], [], []
        index: dict[frozenset, int] = {}

        def number(items: frozenset) -> int:
            if items not in index:
                index[items] = len(self.states)
                self.states.append(items)
            return index[items]

        number(self._closed({(0, 0)}, left))
        done = 0
        while done < len(self.states):
            items, moves, reduced = self.states[done], {}, {}
            for rule, dot in items:
                own = self.grammar[rule][1]
                if dot < len(own):
                    moves.setdefault(own[dot], set()).add((rule, dot + 1))
                else:
                    for look in follow[self.grammar[rule][0]]:
                        reduced.setdefault(look, []).append(rule)
            to = {x: number(self._closed(kernel, left)) for x, kernel in sorted(moves.items())}
            self.shifts.append({x: s for x, s in to.items() if x not in left})
            self.goto.append({x: s for x, s in to.items() if x in left})
            self.reductions.append(reduced)
            done += 1

    def _closed(self, items: set, left: set) -> frozenset:
        todo, out = list(items), set(items)
        while todo:
            rule, dot = todo.pop()
            own = self.grammar[rule][1]
            if dot < len(own) and own[dot] in left:
                new = {(i, 0) for i, (a, _) in enumerate(self.grammar) if a == own[dot]} - out
                out |= new
                todo += new
        return frozenset(out)

    def _follow(self, left: set) -> dict[str, set]:
        """Terminals that may come after a symbol."""
        empty, first, follow = set(), {a: set() for a in left}, {a: set() for a in (*left, "")}
        follow[""].add(END)
        while True:
            size = len(empty), sum(map(len, first.values())), sum(map(len, follow.values()))
            for a, own in self.grammar:
                if all(x in empty for x in own):
                    empty.add(a)
                for i, x in enumerate(own):
                    if a and all(y in empty for y in own[:i]):
                        first[a] |= first.get(x, {x})
                    if x in left:
                        for y in own[i + 1 :]:
                            follow[x] |= first.get(y, {y})
                            if y not in empty:
                                break
                        else:
                            follow[x] |= follow[a]
            if size == (len(empty), sum(map(len, first.values())), sum(map(len, follow.values()))):
                return follow


@dataclass(slots=True)
class Top:
    """A stack by its top: the table's state, what lies below, and the best way here."""

    state: int
    below: Top | None
    cost: int = 0
    audit: str = ""


@dataclass
class Repair:
    """The stack over one conversation's rows."""

    table: Table
    tops: dict[int, Top] = field(default_factory=dict)
    done: list[str] = field(default_factory=list)  # what all audits begin with
    rows: int = 0

    def __post_init__(self):
        self.tops = self._inserted({0: Top(0, None)})

    def _after(self, top: Top, symbol: str) -> Iterator[Top]:
        """Stacks after the reductions that ``symbol`` allows and, but for the end, its shift."""
        table, todo = self.table, [top]
        while todo:
            one = todo.pop()
            for rule in table.reductions[one.state].get(symbol, ()):
                a, own = table.grammar[rule]
                if not a:
                    yield one
                    continue
                base = one
                for _ in own:
                    base = base.below
                todo.append(Top(table.goto[base.state][a], base, one.cost, one.audit))
            if symbol in table.shifts[one.state]:
                yield Top(table.shifts[one.state][symbol], one, one.cost, one.audit)

    @staticmethod
    def _merge(tops: dict[int, Top], top: Top, cost: int, audit: str) -> bool:
        held = tops.get(top.state)
        if held is None or (cost, audit) < (held.cost, held.audit):
            tops[top.state] = Top(top.state, top.below, cost, audit)
            return True
        return False

    def _inserted(self, tops: dict[int, Top]) -> dict[int, Top]:
        """``tops`` and what insertions reach from them."""
        todo = list(tops.values())
        while todo:
            top = todo.pop()
            for symbol in ROLES:
                for new in self._after(top, symbol):
                    if self._merge(tops, new, top.cost + COSTS["I"], top.audit + "I"):
                        todo.append(tops[new.state])
        return tops

    def read(self, initial: str, must_go: bool, truncated: bool) -> None:
        """The next row."""
        out: dict[int, Top] = {}
        for top in self.tops.values():
            self._merge(out, top, top.cost + COSTS["D"], top.audit + "D")
            if must_go:
                continue
            stays = top.cost + TRUNCATED * truncated
            for new in self._after(top, initial or " "):
                self._merge(out, new, stays + COSTS["K"], top.audit + "K")
            for symbol in ROLES:
                for new in self._after(top, symbol):
                    self._merge(out, new, stays + COSTS["R"], top.audit + "R")
        least = min(x.cost for x in out.values())
        self.tops = self._inserted({state: x for state, x in out.items() if x.cost <= least + SLACK})
        self.rows += 1
        if not self.rows % FLUSH:
            common = os.path.commonprefix([x.audit for x in self.tops.values()])
            if common:
                self.done.append(common)
                for x in self.tops.values():
                    x.audit = x.audit[len(common) :]

    def best(self) -> tuple[int, str]:
        """(cost, audit) of the cheapest repair."""
        cost, audit = min((x.cost, x.audit) for top in self.tops.values() for x in self._after(top, END))
        return cost, "".join([*self.done, audit])


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
LEGAL = {"su", "ua", "au"}


class Conversation:
    """Counts of one conversation as its rows pass, and its repair."""

    def __init__(self, conv_id, table: Table):
        self.id, self.repair, self.before = conv_id, Repair(table), None
        self.low = self.high = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, initial: str, blank: bool, truncated: bool, is_new: bool, copies: int) -> None:
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += turn != self.last
            self.last = turn
        for k in range(copies):
            again = not blank and not (is_new and k == 0)
            self.blank += blank
            self.duplicate += again
            self.truncated += truncated and not blank and not again
            self.illegal += self.before is not None and self.before + initial not in LEGAL
            self.before = initial
            self.repair.read(initial, blank or again, truncated)

    def row(self) -> tuple:
        cost, audit = self.repair.best()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """``rows`` in batches, by number of rows and of letters in their strings."""
    held, letters = [], 0
    for row in rows:
        held.append(row)
        letters += sum(len(x) for x in row if isinstance(x, str))
        if len(held) >= size or letters >= 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)
            held, letters = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*held), schema)], schema=schema)


def _values(batches: Iterator[pa.RecordBatch], size: int = 2048) -> Iterator[tuple]:
    """Rows, as Python values."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, size).columns))


def _judge(id_type: pa.DataType):
    schema = pa.schema([("conv_id", id_type), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table()

        def rows() -> Iterator[tuple]:
            now = None
            for conv_id, turn, initial, blank, truncated, gone, is_new, copies in _values(batches):
                if now is None or conv_id != now.id:
                    if now is not None:
                        yield now.row()
                    now = Conversation(conv_id, table)
                if not gone:
                    now.add(turn, initial, blank, truncated, is_new, copies)
            if now is not None:
                yield now.row()

        yield from _batches(rows(), schema)

    return task


class Writer:
    """The repaired conversation, row by row, as an audit says; only its hash is kept."""

    def __init__(self, counts: tuple, audit: str):
        self.counts, self.audit, self.at, self.made, self.size, self.system = counts, audit, 0, sha256(), 0, False

    def _write(self, role: str, text: str) -> None:
        self.made.update((("\n" if self.size else "") + role + ":" + text).encode())
        self.size += 1

    def _next_role(self) -> str:
        return ROLES["ua"[(self.size - self.system) % 2]]

    def insert(self) -> None:
        while self.audit[self.at : self.at + 1] == "I":
            self._write(self._next_role(), "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self.insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.system |= self.size == 0 and role[:1] == "s"
            self._write(role, text)
        elif edit == "R":
            self._write(self._next_role(), text)

    def row(self) -> tuple:
        self.insert()
        return *self.counts, self.audit, self.made.hexdigest()


def _write(id_type: pa.DataType):
    schema = pa.schema([("conv_id", id_type), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now = None
            for row in _values(batches, 256):
                audit, role, text = row[-3:]
                if audit is not None:
                    if now is not None:
                        yield now.row()
                    now = Writer(row[: len(COUNTS) + 1], audit)
                else:
                    now.add(role, text)
            if now is not None:
                yield now.row()

        yield from _batches(rows(), schema)

    return task


def repair(turns: DataFrame, gone: str | None = None) -> DataFrame:
    """conv_id, the counts, audit and repaired_sha256 of each conversation of ``turns`` (conv_id, turn, role, text).

    ``gone`` names a column that marks rows which only say that their conversation exists.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = turns.schema["conv_id"].dataType
    id_type, id_name = to_arrow_type(kind), kind.simpleString()
    away = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), away.alias("gone"))
    rows = rows.withColumn("digest", F.md5("text"))
    seen = rows.select("conv_id", "turn", "role", "digest", "gone", (~F.col("text").rlike(NOT_SPACE)).alias("blank"), (~F.col("text").rlike(rf"[.!?]{SPACE}*\z")).alias("truncated"))
    distinct = seen.groupBy(*seen.columns).agg(F.count("*").alias("copies"))
    earlier = Window.partitionBy("conv_id", "role", "digest", "gone").orderBy("turn")
    ordered = distinct.withColumn("is_new", F.row_number().over(earlier) == 1).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    counts = ", ".join(f"{c} long" for c in COUNTS)
    judged = ordered.select("conv_id", "turn", F.substring("role", 1, 1), "blank", "truncated", "gone", "is_new", "copies").mapInArrow(_judge(id_type), f"conv_id {id_name}, {counts}, audit string")
    none = lambda k: F.lit(None).cast(k)
    heads = judged.select("*", none("string").alias("role"), none("string").alias("text"), F.lit(0).alias("part"), none("long").alias("turn"), none("string").alias("digest"))
    body = rows.where("not gone").select("conv_id", *(none("long").alias(c) for c in COUNTS), none("string").alias("audit"), "role", "text", F.lit(1).alias("part"), "turn", "digest")
    both = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest")
    return both.select("conv_id", *COUNTS, "audit", "role", "text").mapInArrow(_write(id_type), f"conv_id {id_name}, {counts}, audit string, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with rows dropped (marked ``gone``), emptied, cut, repeated or given to the user, by a checksum of their place."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("gone"), copies.alias("_copy")).drop("_copy")


def op12_glr_repair(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), gone="gone")


OP12_SQL = r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS place
  FROM conversations),
f AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(place) + 1), lambda i: ascii(place[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS fault
  FROM k),
d AS (
  SELECT coalesce(conv_id, -1) AS c, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM f, (VALUES (0), (1)) AS v(copy) WHERE fault != 0 AND (copy = 0 OR fault = 3)),
n AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM d),
g AS (
  SELECT *, substr(role, 1, 1) AS r, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS p,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut,
         row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again
  FROM n),
h AS (SELECT *, blank OR again AS must_go, CAST(cut AS INT) AS more FROM g),
ins(q, letters, q2, w) AS (VALUES ('0', '', '0', 0), ('s', '', 's', 0), ('u', '', 'u', 0), ('a', '', 'a', 0), ('0', 'I', 'u', 2), ('s', 'I', 'u', 2), ('u', 'I', 'a', 2), ('a', 'I', 'u', 2), ('0', 'II', 'a', 4), ('s', 'II', 'a', 4)),
mov(q, x, q2) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')),
act AS (
  SELECT ins.q, ins.letters || e.e AS letters, e.q2, ins.w + e.w AS w, e.e, e.x
  FROM ins JOIN (SELECT q, 'K' AS e, q2, 0 AS w, x FROM mov UNION ALL SELECT q, 'R', q2, 2, NULL FROM mov WHERE x != 's' UNION ALL SELECT q, 'D', q, 3, NULL FROM (VALUES ('0'), ('s'), ('u'), ('a')) AS v(q)) AS e ON e.q = ins.q2),
dp AS (
  SELECT DISTINCT c, 0::BIGINT AS i, '0' AS q, 0 AS cost, '' AS audit FROM h
  UNION ALL
  SELECT c, i, q, cost, audit FROM (
    SELECT dp.c, h.i, act.q2 AS q, dp.cost + act.w + CASE WHEN act.e = 'D' THEN 0 ELSE h.more END AS cost, dp.audit || act.letters AS audit
    FROM dp JOIN h ON h.c = dp.c AND h.i = dp.i + 1 JOIN act ON act.q = dp.q
    WHERE act.e = 'D' OR NOT h.must_go AND (act.e = 'R' OR act.x = h.r))
  QUALIFY row_number() OVER (PARTITION BY c, q ORDER BY cost, audit) = 1),
z AS (
  SELECT dp.c, dp.cost + ins.w AS cost, dp.audit || ins.letters AS audit
  FROM dp JOIN (SELECT c, max(i) AS i FROM h GROUP BY c) AS m ON m.c = dp.c AND m.i = dp.i JOIN ins ON ins.q = dp.q AND ins.q2 IN ('0', 'a')
  QUALIFY row_number() OVER (PARTITION BY dp.c ORDER BY dp.cost + ins.w, dp.audit || ins.letters) = 1),
l AS (SELECT c, audit, unnest(range(1, len(audit) + 1)) AS j FROM z),
o AS (
  SELECT l.c, l.j, audit[l.j] AS e, count(*) FILTER (WHERE audit[l.j] != 'I') OVER w AS i, count(*) FILTER (WHERE audit[l.j] != 'D') OVER w AS k
  FROM l WINDOW w AS (PARTITION BY c ORDER BY j)),
t AS (
  SELECT o.c, o.j, o.e, o.k, h.role, h.text, max(CASE WHEN o.k = 1 AND o.e = 'K' AND h.r = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY o.c) AS s
  FROM o LEFT JOIN h ON h.c = o.c AND h.i = o.i AND o.e != 'I' WHERE o.e != 'D'),
y AS (
  SELECT c, string_agg(CASE WHEN e = 'K' THEN role WHEN (k - 1 - s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS body
  FROM t GROUP BY c),
s AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
         count(*) FILTER (WHERE cut AND NOT blank AND NOT again) AS truncated, count(*) FILTER (WHERE p IS NOT NULL AND p || r NOT IN ('su', 'ua', 'au')) AS illegal
  FROM h GROUP BY c)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id, -1) AS c FROM conversations) AS a LEFT JOIN s USING (c) LEFT JOIN z USING (c) LEFT JOIN y USING (c)
"""
