"""Repair of conversations whose rows do not follow the grammar of roles.

A sound conversation is empty, or has the roles ``system? (user assistant)+``. The
cheapest edits that make it so are found by generalised LR parsing: every row may be
kept, given another role or deleted, and turns without text may be inserted anywhere,
each at its weight. All parses run side by side on a graph-structured stack; parses
with equal stack tops are merged by the least (cost, audit). The audit lists the edits
in order, by their letters D, I, K and R.

In the automaton of this grammar every state is entered from one state only, which is
checked when it is built, so the stack below a top is known from the top, and merging
by tops loses nothing. Two audits of equal cost up to the same row never are one the
beginning of the other - the longer one would have more inserts and so cost more - and
hence the lesser one stays the lesser however they go on.

Rows are put in order by one range shuffle, so that a conversation may hold any share of
them. It is then parsed in chunks, each from all tops that it may be entered with, and
the chunks' results are chained per conversation. What grows with a conversation in one
task is its audit, which is one value of the result.

Null ids are a conversation of their own, null turns come first, null roles and texts
are those of one space. Rows of one turn are ordered by the digest of role and text, and
of equal rows all but one are duplicates. A role is known by its first letter; one that
the grammar has not can be deleted or changed only. Other columns are not read, and an
empty table has no conversations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamline.llm.common import runs
from seamline.storage import store

#: Bits of the number of rows of a chunk.
BITS = 12

#: White space, and the marks a sentence ends with.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
ENDINGS = (".", "!", "?")

#: Roles by their letter, and the productions of the grammar over the letters.
ROLES = {"s": "system", "u": "user", "a": "assistant"}
GRAMMAR = (
    ("dialogue", ()),
    ("dialogue", ("turns",)),
    ("turns", ("u", "a")),
    ("turns", ("s", "u", "a")),
    ("turns", ("turns", "u", "a")),
)
#: Letters of neighbouring rows that follow each other in a sound conversation.
NEIGHBOURS = frozenset(("su", "ua", "au"))

#: A row as one character: its role's letter, or x, and whether it is sound, truncated or to be deleted.
LETTERS = "suax"
SOUND, TRUNCATED, DELETED = "suax", "SUAX", "0123"
_LETTER_OF = str.maketrans(TRUNCATED + DELETED, LETTERS * 2)


@dataclass(frozen=True)
class Repair:
    """Weights of the edits; ``truncated`` is added to a truncated row that stays.

    ``roles`` are the letters of the roles that rows are changed to and inserted with.
    All weights must be positive. ``bits`` sets the size of a chunk and never a result.
    """

    delete: int = 4
    rerole: int = 3
    insert: int = 3
    truncated: int = 3
    roles: str = "ua"
    grammar: tuple = GRAMMAR
    bits: int = BITS

    @cached_property
    def automaton(self) -> "Automaton":
        found = _automaton(self.grammar)
        if any(sum(x in moves for x in self.roles) > 1 for moves in found.moves):
            raise ValueError("the letters of the edits would not tell the roles they give")
        return found


# ------------------------------------------------------------------ automaton


@lru_cache
def _automaton(grammar: tuple) -> "Automaton":
    return Automaton(grammar)


class Automaton:
    """LR(0) states of a grammar whose first production's head is its start.

    ``moves[state][letter]`` is the top after the letter has been shifted and what must be
    reduced has been. A state that can shift as well reduces at the end only.
    """

    def __init__(self, grammar: Sequence[tuple[str, tuple[str, ...]]]) -> None:
        self.grammar = [("", (grammar[0][0],)), *grammar]
        self.heads = {head for head, _ in grammar}
        self.states = [self._closed({(0, 0)})]
        self.goto: dict[tuple[int, str], int] = {}
        self.below: dict[int, int] = {}
        for state, items in enumerate(self.states):  # grows on the way
            for symbol in sorted({s for s in map(self._next, items) if s}):
                core = self._closed({(p, dot + 1) for p, dot in items if self._next((p, dot)) == symbol})
                if core not in self.states:
                    self.states.append(core)
                to = self.states.index(core)
                if self.below.setdefault(to, state) != state:
                    raise ValueError("the grammar has a state that is entered from two others")
                self.goto[state, symbol] = to
        letters = {s for _, body in grammar for s in body} - self.heads
        self.moves = [
            {x: self._rested(self.goto[state, x]) for x in letters if (state, x) in self.goto}
            for state in range(len(self.states))
        ]
        self.ends = {s for s in range(len(self.states)) if self._accepts(s)}
        #: Tops that a row may meet.
        self.tops = sorted({0} | {to for moves in self.moves for to in moves.values()})

    def _next(self, item: tuple[int, int]) -> str | None:
        body = self.grammar[item[0]][1]
        return body[item[1]] if item[1] < len(body) else None

    def _closed(self, items: set) -> frozenset:
        found, more = set(items), list(items)
        while more:
            symbol = self._next(more.pop())
            new = {(p, 0) for p, (head, _) in enumerate(self.grammar) if head == symbol} - found
            found |= new
            more += new
        return frozenset(found)

    def _whole(self, state: int) -> list[int]:
        return [p for p, dot in self.states[state] if dot == len(self.grammar[p][1])]

    def _reduced(self, state: int, production: int) -> int:
        head, body = self.grammar[production]
        for _ in body:
            state = self.below[state]
        return self.goto[state, head]

    def _rested(self, state: int) -> int:
        while len(self.states[state]) == 1 and self._whole(state):
            state = self._reduced(state, self._whole(state)[0])
        return state

    def _accepts(self, state: int) -> bool:
        while whole := self._whole(state):
            if 0 in whole:
                return True
            state = self._reduced(state, whole[0])
        return False


# ---------------------------------------------------------------------- parse

#: The top nodes of the stack at a place: the least cost and audit that lead to each.
Front = dict[int, tuple[int, str]]


def _inserted(front: Front, repair: Repair) -> Front:
    """The front with whatever may be inserted here."""
    front, open_ = dict(front), list(front)
    while open_:
        top = open_.pop(0)
        cost, audit = front[top]
        for letter in repair.roles:
            to = repair.automaton.moves[top].get(letter)
            if to is not None:
                _merge(front, to, (cost + repair.insert, audit + "I"), open_)
    return front


def _merge(front: Front, top: int, found: tuple[int, str], changed: list[int] | None = None) -> None:
    if top not in front or found < front[top]:
        front[top] = found
        if changed is not None:
            changed.append(top)


def parsed(rows: str, front: Front, repair: Repair) -> Front:
    """The front after these rows, each given as one character."""
    moves = repair.automaton.moves
    for row in rows:
        letter, stays = row.translate(_LETTER_OF), row not in DELETED
        more = repair.truncated if row in TRUNCATED else 0
        after: Front = {}
        for top, (cost, audit) in _inserted(front, repair).items():
            _merge(after, top, (cost + repair.delete, audit + "D"))
            if stays:
                if letter in moves[top]:
                    _merge(after, moves[top][letter], (cost + more, audit + "K"))
                for new in repair.roles:
                    if new in moves[top]:
                        _merge(after, moves[top][new], (cost + repair.rerole + more, audit + "R"))
        front = after
    return front


def ended(front: Front, repair: Repair) -> tuple[int, str]:
    """The least cost and audit that make a sound conversation."""
    return min(found for top, found in _inserted(front, repair).items() if top in repair.automaton.ends)


def illegal(rows: str) -> int:
    letters = rows.translate(_LETTER_OF)
    return sum(a + b not in NEIGHBOURS for a, b in zip(letters, letters[1:]))


# --------------------------------------------------------------------- tables


@dataclass(frozen=True)
class Repaired:
    """What ``repair`` finds.

    ``lines``   the repaired conversations: id, ``chunk`` and ``place`` for their order,
                ``role``, ``text`` and ``edit`` (K, R or I)
    ``report``  per conversation: id, ``gaps``, ``blank``, ``duplicate``, ``truncated``,
                ``illegal``, ``cost`` and ``audit``
    """

    lines: DataFrame
    report: DataFrame


_MATRIX = "chunk bigint, enters int, leaves int, cost bigint, audit string, codes string"
_CHAIN = "chunk bigint, enters int, part string, cost bigint, audit string, illegal bigint"


def repair_conversations(
    rows: DataFrame,
    repair: Repair = Repair(),
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> Repaired:
    """Faults and cheapest repairs of conversations, rows in the order of their turns.

    A row is blank without a character other than white space, a duplicate if an earlier
    row has its role and text, and truncated if its last such character ends no sentence;
    the first of these counts. Blank rows and duplicates are deleted.
    """
    id_type = dict(rows.dtypes)[id_column]
    placed = _placed(
        rows.select(
            F.col(f"`{id_column}`").alias("id"),
            F.col(f"`{turn_column}`").alias("turn"),
            F.coalesce(F.col(f"`{role_column}`"), F.lit(" ")).alias("role"),
            F.coalesce(F.col(f"`{text_column}`"), F.lit(" ")).alias("text"),
        )
    )
    flagged = _flagged(placed)
    chunk = F.shiftright("at", repair.bits).alias("chunk")
    # A chunk has at most 2**bits rows.
    items = F.sort_array(F.collect_list(F.struct("at", "code")))
    codes = flagged.groupBy("id", chunk).agg(
        F.array_join(F.transform(items, lambda x: x["code"]), "").alias("codes"), F.min("at").alias("first")
    )
    matrices = codes.mapInArrow(_matrices(repair), f"id {id_type}, {_MATRIX}")
    chained = matrices.repartition("id").sortWithinPartitions("id", "chunk", "enters", "leaves")
    chained = store(chained.mapInArrow(_chains(repair), f"id {id_type}, {_CHAIN}"), "chains")

    whole = chained.where(F.col("cost").isNotNull()).select(F.col("id").alias("of"), "cost", "audit", "illegal")
    counts = flagged.groupBy("id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")],
    )
    report = counts.join(whole, F.col("id").eqNullSafe(F.col("of"))).select(
        F.col("id").alias(id_column), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"
    )

    none = F.lit(None)
    edits = chained.select(
        "id", "chunk", none.cast("bigint").alias("at"), "enters", none.cast("string").alias("role"), F.col("part").alias("text")
    )
    texts = placed.select("id", chunk, "at", none.cast("int").alias("enters"), "role", "text")
    # A chunk's edits come before its rows.
    dealt = edits.union(texts).repartition("id", "chunk").sortWithinPartitions("id", "chunk", "at")
    lines = dealt.mapInArrow(
        _lines(repair), f"id {id_type}, chunk bigint, place bigint, role string, text string, edit string"
    )
    return Repaired(lines.withColumnRenamed("id", id_column), report)


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``at``, which numbers all of them in order, and ``same``, equal for equal roles and texts.

    ``_nth`` tells equal rows apart, so that no task gets all of them.
    """
    named = rows.withColumn(
        "same", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    ).withColumn("_nth", F.monotonically_increasing_id())
    order = ["id", "turn", "same", "_nth"]
    ordered = named.repartitionByRange(*order).sortWithinPartitions(*order).drop("_nth")
    return store(ordered.withColumn("at", F.monotonically_increasing_id()), "placed")


def _flagged(placed: DataFrame) -> DataFrame:
    """``id``, ``at``, ``turn``, ``fault`` and ``code`` of each row."""
    # The first row of each text is found by aggregation and met by its number: no key is shared.
    firsts = placed.groupBy("id", "same").agg(F.min("at").alias("first_at")).select("first_at")
    solid = F.rtrim("text", F.lit(SPACES))
    slim = placed.select(
        "id",
        "at",
        "turn",
        F.substring("role", 1, 1).alias("letter"),
        (solid == "").alias("blank"),
        F.right(solid, F.lit(1)).isin(*ENDINGS).alias("ended"),
    ).join(firsts, F.col("at") == F.col("first_at"), "left")
    fault = (
        F.when(F.col("blank"), "blank").when(F.col("first_at").isNull(), "duplicate").when(~F.col("ended"), "truncated")
    )
    place = F.when(F.col("letter").isin(*LETTERS[:3]), F.instr(F.lit(LETTERS), F.col("letter"))).otherwise(4)
    letters = F.when(F.col("fault") == "truncated", TRUNCATED).when(F.col("fault").isNotNull(), DELETED).otherwise(SOUND)
    flagged = slim.withColumn("fault", fault).select("id", "at", "turn", "fault", F.substr(letters, place, F.lit(1)).alias("code"))
    return store(flagged, "flagged")


def _table(id_type: pa.DataType, kinds: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in kinds.split(", ")]
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), [id_type, *[types[k] for _, k in fields]])]
    return pa.RecordBatch.from_arrays(columns, ["id", *[name for name, _ in fields]])


def _matrices(repair: Repair):
    """Costs and audits of each chunk from every top it may be entered with to every top it leaves."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple]] = {}
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                # Rows of one conversation are neighbours, so a chunk that does not fill its
                # block from the start is its conversation's first.
                starts = row["first"] != row["chunk"] << repair.bits
                key = ("f" if starts else "m") + row["codes"]
                if key not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[key] = [
                        (enters, leaves, *found)
                        for enters in ([0] if starts else repair.automaton.tops)
                        for leaves, found in parsed(row["codes"], {enters: (0, "")}, repair).items()
                    ]
                rows += [(row["id"], row["chunk"], *found, row["codes"]) for found in known[key]]
            if rows:
                yield _table(batch.schema.field("id").type, _MATRIX, rows)

    return find


def _chains(repair: Repair):
    """The chunks of each conversation put one after another."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conversation in runs(batches, ["id"]):
            front: Front = {0: (0, "")}
            #: Per top, the tops that the chunks were entered with and where their audits begin.
            ways: dict[int, tuple] = {0: ()}
            last, bad, chunks = "", 0, []
            for chunk, ends in groupby(conversation.to_pylist(), key=lambda r: r["chunk"]):
                after: Front = {}
                after_ways: dict[int, tuple] = {}
                for end in ends:
                    if end["enters"] not in front:
                        continue
                    cost, audit = front[end["enters"]]
                    _merge(after, end["leaves"], (cost + end["cost"], audit + end["audit"]), taken := [])
                    if taken:
                        after_ways[end["leaves"]] = (ways[end["enters"]], end["enters"], len(audit))
                front, ways = after, after_ways
                bad += illegal(last + end["codes"])
                last = end["codes"][-1]
                chunks.append(chunk)
            (cost, audit), top = min((ended({top: found}, repair), top) for top, found in front.items())
            way, stop, parts = ways[top], len(audit), []
            total = (cost, audit, bad)
            for chunk in reversed(chunks):
                way, enters, start = way
                parts.append((conversation.column("id")[0].as_py(), chunk, enters, audit[start:stop], *total))
                stop, total = start, (None, None, None)
            yield _table(conversation.schema.field("id").type, _CHAIN, parts[::-1])

    return chain


def _lines(repair: Repair):
    """Applies each chunk's edits to its rows, one row at a time."""
    moves = repair.automaton.moves
    #: The role that a row gets by its place; the automaton leaves no choice.
    given = [next((x for x in repair.roles if x in letters), None) for letters in moves]
    kinds = "chunk bigint, place bigint, role string, text string, edit string"

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, left, top, place = "", 0, 0, 0, 0
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("id", "chunk", "at", "enters", "role", "text")]
            for conversation, chunk, number, enters, role, text in zip(*columns):
                if number is None:
                    # Letters after the last row's are inserts at the end.
                    part, at, left, top, place = text, 0, len(text.rstrip("I")), enters, 0
                    continue
                # This row's letter and the inserts before it, after the last row all others too.
                upto = at + 1
                while part[upto - 1] == "I":
                    upto += 1
                upto = len(part) if upto == left else upto
                for edit in part[at:upto]:
                    if edit == "D":
                        continue
                    letter = role[0] if edit == "K" else given[top]
                    line = (role if edit == "K" else ROLES[letter], "" if edit == "I" else text, edit)
                    out.append((conversation, chunk, place, *line))
                    top, place = moves[top][letter], place + 1
                at = upto
            if out:
                yield _table(batch.schema.field("id").type, kinds, out)

    return apply


def line_digests(lines: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Per conversation the lower-case hex SHA-256 of its lines ``role:text``, joined by newlines.

    A digest is worked out in order, so a task passes the lines of a conversation one after
    another; it never holds more than a batch of them.
    """
    id_type = dict(lines.dtypes)[id_column]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for one, role, text in zip(*[batch.column(c).to_pylist() for c in ("id", "role", "text")]):
                if state is None or one != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = one, sha256()
                    state.update(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            if out:
                yield _table(batch.schema.field("id").type, "sha256 string", out)
            kind = batch.schema.field("id").type
        if state is not None:
            yield _table(kind, "sha256 string", [(key, state.hexdigest())])

    ordered = lines.select(F.col(f"`{id_column}`").alias("id"), "chunk", "place", "role", "text")
    ordered = ordered.repartition("id").sortWithinPartitions("id", "chunk", "place")
    return ordered.mapInArrow(digest, f"id {id_type}, sha256 string").withColumnRenamed("id", id_column)
