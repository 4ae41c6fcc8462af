"""Conversation structure repair: cheapest edits to an alternating conversation, by Four-Russians block tables.

A repaired conversation has the role initials (s?(ua)+)?, an automaton of four states, in each of which one role of user and
assistant can follow. Its rows are symbols: what the role's initial is, and whether the row ends in the middle or has to go.
The costs from a place to the end, one per state, differ by a few units, so that less their least they are one of a few
dozen vectors. For each block of BLOCK symbols and each such vector behind it, a table that is computed once per worker
holds the vector before it and what was taken off. A piece of a conversation, thousands of symbols long, is thus a function
of vectors found by lookups, piece by piece in parallel; the pieces' functions are then applied from the end. Going forward,
blocks are expanded: the vectors within them, computed from behind, say which edits still lead to the least cost, and of these
the one of the least letter is taken, which gives the least audit of all cheapest ones.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import per_worker, read, ship

#: Symbols of a block, and of a piece of a conversation.
BLOCK = 4
PIECE = 4096
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: A row's symbol: what its role starts with (s, u, a, else -), in capitals where the row ends in the middle; b and d for
#: blank and duplicate rows.
SYMBOLS = "sua-SUA_bd"
#: States: nothing yet, after a system row, after a user row, after an assistant row. For each the state after a row of the
#: role that can follow, and that role; a system row can follow in the first alone.
START, OPENED, ASKED, ANSWERED = range(4)
NEXT = (ASKED, ASKED, ANSWERED, ASKED)
ROLE = ("user", "user", "assistant", "user")
#: Costs at the end of a conversation: what insertions are still needed.
LAST = (0, 2 * INSERT, INSERT, 0)

BLANK, NO_STOP = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
ROWS = "conv_id long, turn long, role string, mark binary, text string, copies int"


def kept_in(symbol: str, state: int) -> int | None:
    """The state after a kept row, None if it cannot be kept."""
    low = symbol.lower()
    if state == START and low == "s":
        return OPENED
    return NEXT[state] if low == ROLE[state][0] and symbol not in "bd" else None


def edits(symbol: str | None, state: int) -> list[tuple[str, int, int, int]]:
    """What can be done in a state with a row (None: at the end): (initial, cost, state after, rows taken), by initial."""
    out = [("I", INSERT, NEXT[state], 0)]
    if symbol is None:
        return out
    out.insert(0, ("D", DELETE, state, 1))
    if symbol not in "bd":
        more = TRUNCATED * (symbol in "SUA_")
        if kept_in(symbol, state) is not None:
            out.append(("K", more, kept_in(symbol, state), 1))
        out.append(("R", REROLE + more, NEXT[state], 1))
    return out


def costs_before(symbol: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs per state in front of a row, from those behind it."""
    costs = [min(cost + after[to] for _, cost, to, rows in edits(symbol, state) if rows) for state in range(4)]
    for _ in range(3):  # insertions go round in two steps
        costs = [min(c, INSERT + costs[NEXT[state]]) for state, c in enumerate(costs)]
    return tuple(costs)


class Blocks:
    """vectors: the normalised cost vectors that occur. to and less, by block and by the vector behind it: the vector in front
    and what was taken off it. A block's number reads its symbols as digits, the first one leading."""

    def __init__(self, size: int = BLOCK):
        import numpy as np

        self.size = size
        self.vectors, self.number = [LAST], {LAST: 0}
        at, one_to, one_less = 0, [], []
        while at < len(self.vectors):
            steps = []
            for symbol in SYMBOLS:
                before = costs_before(symbol, self.vectors[at])
                least = min(before)
                norm = tuple(c - least for c in before)
                if norm not in self.number:
                    self.number[norm] = len(self.vectors)
                    self.vectors.append(norm)
                steps.append((self.number[norm], least))
            one_to.append([s[0] for s in steps])
            one_less.append([s[1] for s in steps])
            at += 1
        # Tables of one symbol, then of one more in front each time.
        one_to, one_less = np.array(one_to, np.int16).T, np.array(one_less, np.int64).T
        self.one = one_to, one_less
        self.to, self.less = one_to, one_less
        for _ in range(size - 1):
            to = one_to[:, self.to].reshape(-1, len(self.vectors))
            less = (one_less[:, self.to] + self.less[None]).reshape(-1, len(self.vectors))
            self.to, self.less = to, less

    def function(self, symbols: bytes):
        """Of a piece: for each vector behind it, the vector in front and what was taken off."""
        import numpy as np

        digits = _digits(symbols)
        to, less = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        end = len(digits)
        whole = end - end % self.size
        for d in digits[whole:][::-1]:
            to, less = self.one[0][d, to], less + self.one[1][d, to]
        powers = len(SYMBOLS) ** np.arange(self.size - 1, -1, -1)
        for block in (digits[:whole].reshape(-1, self.size) @ powers)[::-1]:
            to, less = self.to[block, to], less + self.less[block, to]
        return to, less

    def trace(self, symbols: bytes, behind: int, state: int):
        """The edits of a piece that is entered in a state, with the vector behind it: for each symbol what is done up to and
        with it, as initials, the state after the piece, and their cost."""
        digits, size = _digits(symbols).tolist(), self.size
        starts = list(range(0, len(digits), size))
        ends, v = [], behind
        for at in reversed(starts):  # vectors behind the blocks
            ends.append(v)
            for d in reversed(digits[at : at + size]) if len(digits) - at < size else ():
                v = int(self.one[0][d, v])
            if len(digits) - at >= size:
                v = int(self.to[_block(digits[at : at + size]), v])
        out, total = [], 0
        for at, v in zip(starts, reversed(ends), strict=True):
            within = [self.vectors[v]]
            for d in reversed(digits[at : at + size]):
                within.append(costs_before(SYMBOLS[d], within[-1]))
            for i, d in enumerate(digits[at : at + size]):
                here, after = within[-1 - i], within[-2 - i]
                done = ""
                while True:
                    options = edits(SYMBOLS[d], state)
                    initial, cost, to, rows = next(e for e in options if here[state] == e[1] + (after if e[3] else here)[e[2]])
                    done, total, state = done + initial, total + cost, to
                    if rows:
                        break
                out.append(done)
        return out, state, total


def _digits(symbols: bytes):
    import numpy as np

    table = np.zeros(128, np.int64)
    table[list(SYMBOLS.encode())] = range(len(SYMBOLS))
    return table[np.frombuffer(symbols, np.uint8)]


def _block(digits: list[int]) -> int:
    out = 0
    for d in digits:
        out = out * len(SYMBOLS) + d
    return out


def closing(state: int) -> int:
    """How many insertions end a conversation from a state."""
    return LAST[state] // INSERT


#: A conversation's key and a row's place in it: turns in order, nulls first, ties by role and by the MD5 of the text.
KEY = ("c", "no_c")
PLACE = ("has_turn", "turn0", "role", "mark")
PIECES = "c long, no_c boolean, has_turn boolean, turn0 long, role string, mark binary, range int, k int, symbols binary, times long, behind int, to binary"
HEADS = "c long, no_c boolean, has_turn boolean, turn0 long, role string, mark binary, range int, k int, symbols binary, times long, behind int"
REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "conv_id long, place long, edit string, role string, text string"


def prepared(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text, copies) with keys and places; null roles and texts are one space."""
    space = F.lit(" ")
    return rows.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0).cast("long")).alias("c"), F.col("conv_id").isNull().alias("no_c"),
        F.col("turn").isNotNull().alias("has_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("turn0"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"), F.coalesce(F.col("text").cast("string"), space).alias("text"), F.col("copies").cast("int").alias("copies"),
    ).withColumn("mark", F.unhex(F.md5("text")))


def symbol() -> Column:
    """Of a row that is no duplicate: its letter in SYMBOLS."""
    low = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise(F.lit("-"))
    bare = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    cut = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    return F.when(F.length(bare) == 0, F.lit("b")).when(cut, F.when(low == "-", F.lit("_")).otherwise(F.upper(low))).otherwise(low)


def pieces(rows: DataFrame) -> DataFrame:
    """Conversations as pieces of symbols, in order of range and k, each with its function.

    Equal rows are counted before they are dealt. Rows are dealt by ranges, so that a long conversation spreads over many
    tasks; long runs of duplicates are one symbol and a number.
    """
    some = rows.where("copies > 0").withColumn("symbol", symbol())
    counted = some.groupBy(*KEY, *PLACE, "symbol").agg(F.sum("copies").alias("n"))
    turn = F.struct("has_turn", "turn0")
    first = counted.groupBy(*KEY, "role", "mark").agg(F.min(turn).alias("first"))
    again = counted.join(first, [*KEY, "role", "mark"]).withColumn("again", turn > F.col("first"))
    ordered = again.select(*KEY, *PLACE, "symbol", "n", "again").repartitionByRange(*KEY, *PLACE).sortWithinPartitions(*KEY, *PLACE)
    schema = T.StructType.fromDDL(PIECES)
    arrow = to_arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        blocks, part = per_worker("repair-blocks", Blocks), TaskContext.get().partitionId()
        out, key, head, symbols, k = [], None, None, bytearray(), 0

        def close(times: int = 1):
            nonlocal k
            if symbols:
                if times > 1:
                    to, symbol = list(range(len(blocks.vectors))), bytes(symbols)
                else:
                    to, symbol = blocks.function(bytes(symbols))[0].tolist(), bytes(symbols)
                out.append((*key, *head, part, k, symbol, times, None, bytes(to)))
                k += 1
                symbols.clear()

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*KEY, *PLACE, "symbol", "n", "again")]
            for c, no_c, *place, letter, n, seen in zip(*columns, strict=True):
                if (c, no_c) != key:
                    close()
                    key = (c, no_c)
                rest = letter if letter == "b" else "d"
                for one, count in ((rest if seen else letter, 1), (rest, n - 1)):
                    if count > PIECE:
                        close()
                        head = place
                        symbols += one.encode()
                        close(count)
                        continue
                    for _ in range(count):
                        if not symbols:
                            head = place
                        symbols += one.encode()
                        if len(symbols) >= PIECE:
                            close()
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out], schema=arrow)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out], schema=arrow)

    return ordered.mapInArrow(run, schema)


def behind(parts: DataFrame) -> DataFrame:
    """Each piece with the number of the cost vector behind it: the functions of a conversation's pieces from the last on."""
    schema = T.StructType.fromDDL(HEADS)
    arrow = to_arrow_schema(schema)

    def run(batches):
        import numpy as np

        key, v = None, 0
        for batch in batches:
            found = []
            for c, no_c, to in zip(*(batch.column(x).to_pylist() for x in (*KEY, "to")), strict=True):
                if (c, no_c) != key:
                    key, v = (c, no_c), 0
                found.append(v)
                v = to[v]
            columns = [batch.column(n) if n != "behind" else pa.array(np.array(found, np.int32)) for n in arrow.names]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return parts.repartition(*KEY).sortWithinPartitions(*KEY, F.desc("range"), F.desc("k")).mapInArrow(run, schema)


class Walk:
    """A conversation's rows in order, with its pieces: edits, counts, the repaired rows and their digest."""

    def __init__(self, blocks: Blocks, conv_id, emit=None):
        import collections
        import hashlib

        self.blocks, self.conv_id, self.emit = blocks, conv_id, emit
        self.pieces, self.ahead = collections.deque(), iter(())
        self.state, self.cost, self.audit, self.place, self.digest = START, 0, [], 0, hashlib.sha256()
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.initial = self.low = self.high = self.turn = None
        self.turns = 0

    def _next(self):
        """The symbol and edits of the next row."""
        for got in self.ahead:
            return got
        symbols, times, after = self.pieces.popleft()
        if times > 1:
            self.ahead = (("D", chr(symbols[0])) for _ in range(times))
        else:
            done, _, _ = self.blocks.trace(symbols, after, self.state)
            self.ahead = zip(done, symbols.decode(), strict=True)
        return next(self.ahead)

    def put(self, edit: str, role: str, text: str):
        line = f"{role}:{text}"
        self.digest.update((line if self.place == 0 else "\n" + line).encode("utf-8", "surrogatepass"))
        if self.emit:
            self.emit(self.conv_id, self.place, edit, role, text)
        self.place += 1

    def insert(self):
        self.put("I", ROLE[self.state], "")
        self.cost, self.state = self.cost + INSERT, NEXT[self.state]

    def row(self, turn, role: str, text: str):
        done, letter = self._next()
        self.audit.append(done)
        fault = {"b": "blank", "d": "duplicate"}.get(letter, "truncated" if letter in "SUA_" else None)
        if fault:
            self.counts[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.initial = role[:1]
        if turn is not None and turn != self.turn:
            self.turns, self.turn, self.high = self.turns + 1, turn, turn
            self.low = turn if self.low is None else self.low
        for edit in done:
            if edit == "I":
                self.insert()
            elif edit == "D":
                self.cost += DELETE
            else:
                self.cost += TRUNCATED * (letter in "SUA_") + REROLE * (edit == "R")
                self.put(edit, role if edit == "K" else ROLE[self.state], text)
                self.state = kept_in(letter, self.state) if edit == "K" else NEXT[self.state]

    def end(self) -> tuple:
        for _ in range(closing(self.state)):
            self.audit.append("I")
            self.insert()
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv_id, gaps, *self.counts.values(), self.cost, "".join(self.audit), self.digest.hexdigest())


def walked(rows: DataFrame, each_row: bool) -> DataFrame:
    """Conversations in order of place, pieces before the rows that they begin with; REPORT, or REPAIRED rows."""
    ship(rows.sparkSession)
    none = lambda kind: F.lit(None).cast(kind)
    at = prepared(rows)
    heads = behind(pieces(at)).select(*KEY, *PLACE, F.lit(0).alias("tag"), "range", "k", "symbols", "times", "behind", none("string").alias("text"), F.lit(0).alias("copies"))
    told = at.select(*KEY, *PLACE, F.lit(1).alias("tag"), F.lit(0).alias("range"), F.lit(0).alias("k"), none("binary").alias("symbols"), F.lit(0).cast("long").alias("times"), F.lit(0).alias("behind"), F.when(F.col("copies") > 0, F.col("text")).alias("text"), "copies")
    order = heads.unionByName(told).repartition(*KEY).sortWithinPartitions(*KEY, *PLACE, "tag", "range", "k")
    schema = T.StructType.fromDDL(REPAIRED if each_row else REPORT)
    arrow = to_arrow_schema(schema)

    def run(batches):
        blocks, key, walk, out = per_worker("repair-blocks", Blocks), None, None, []

        def ended():
            if walk is not None:
                report = walk.end()
                if not each_row:
                    out.append(report)

        def batch_of():
            columns = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, arrow.types, strict=True)], schema=arrow)

        emit = (lambda *r: out.append(r)) if each_row else None
        names = (*KEY, "has_turn", "turn0", "role", "tag", "symbols", "times", "behind", "text", "copies")
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for c, no_c, has_turn, turn, role, tag, symbols, times, after, text, copies in zip(*(some.column(n).to_pylist() for n in names), strict=True):
                    if (c, no_c) != key:
                        ended()
                        key, walk = (c, no_c), Walk(blocks, None if no_c else c, emit)
                    if tag == 0:
                        walk.pieces.append((symbols, times, after))
                    for _ in range(copies):
                        walk.row(turn if has_turn else None, role, text)
                if out:
                    yield batch_of()
                    out.clear()
        ended()
        if out:
            yield batch_of()

    return order.mapInArrow(run, schema)


def report(conversations: DataFrame) -> DataFrame:
    """A row of REPORT for each conversation of rows(conv_id, turn, role, text[, copies]): its faults, the cheapest edits, and
    the SHA-256 of the repaired conversation, role:text by line.

    Rows go by turn, nulls first, ties by role and the MD5 of the text. A null role or text is one space; rows without conv_id
    are one conversation, whose id is null. A row's first fault counts: blank, duplicate (role and text seen before),
    truncated (not ending in a full stop, question or exclamation mark). Blank and duplicate rows have to be deleted (3);
    other rows are kept (0), deleted (3) or given the other role (2), truncated ones for 1 more unless deleted; rows without
    text are put in for 2. A role that does not begin with s, u or a cannot be kept, one without letters neither. Of equally
    cheap edits the least audit is taken. A row with copies of 0 names its conversation and is no row of it; a conversation
    without rows has zeros and empty strings. An empty table gives no rows.

    Hashing goes row by row, so the last step reads a conversation in order in one task, whatever its length, holding one
    piece of it; cost vectors are found for its pieces in parallel.
    """
    return walked(_with_copies(conversations), False)


def repaired(conversations: DataFrame) -> DataFrame:
    """The rows of REPAIRED that the cheapest edits leave or put in, by place from 0; see report()."""
    return walked(_with_copies(conversations), True)


def _with_copies(rows: DataFrame) -> DataFrame:
    return rows if "copies" in rows.columns else rows.withColumn("copies", F.lit(1))


def damaged(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with faults put in by a checksum of conv_id:turn."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault"))
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).alias("copies"),
    )


def op12_four_russians_repair(spark, sf_dir: str) -> DataFrame:
    return report(damaged(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))


def _put(best: str, cost: str | int, initial: str, line: str = "''") -> str:
    """SQL: an edit in front of cost:audit, chr(1), lines."""
    return f"(printf('%09d', CAST({best}[1:9] AS BIGINT) + {cost}) || ':{initial}' || {best}[11:instr({best}, chr(1))] || {line} || {best}[instr({best}, chr(1)) + 1:])"


_KEEP, _ROLE_LINE = "role || ':' || text || chr(10)", "'{0}:' || text || chr(10)"
_AFTER = ("b2", "b2", "b3", "b2")


def _rows_taken(state: int) -> str:
    after, role = _AFTER[state], ROLE[state]
    kept = [f"CASE WHEN NOT gone AND initial = '{role[0]}' THEN {_put(after, 'cut', 'K', _KEEP)} END"]
    if state == START:
        kept.append(f"CASE WHEN NOT gone AND initial = 's' THEN {_put('b1', 'cut', 'K', _KEEP)} END")
    other = f"CASE WHEN NOT gone THEN {_put(after, f'{REROLE} + cut', 'R', _ROLE_LINE.format(role))} END"
    return f"least({_put(f'b{state}', DELETE, 'D')}, {', '.join(kept)}, {other})"


def _inserted(state: int, of: str) -> str:
    return f"least(a{state}, {_put(of, INSERT, 'I', chr(39) + ROLE[state] + ':' + chr(39) + ' || chr(10)')})"


#: The checksum of a text of ASCII, bit by bit: 4294967295, then each byte and eight times -1.
_CRC = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({0}, ''), lambda s: [CAST(ascii(s) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END), 4294967295)"
_BARE = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

OP12_SQL = f"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM named
), placed AS (
  SELECT *, row_number() OVER w AS p, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, count(*) OVER (PARTITION BY conv_id) AS rows,
    lead(role[1:1]) OVER w AS next_initial, role[1:1] AS initial, {_BARE} AS bare
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))
), judged AS (
  SELECT *, bare = '' AS blank, bare <> '' AND seen > 1 AS duplicate, bare <> '' AND seen = 1 AND bare[-1:] NOT IN ('.', '!', '?') AS truncated FROM placed
), symbols AS (
  SELECT conv_id, rows - p AS after, role, text, initial, blank OR duplicate AS gone, CASE WHEN truncated THEN {TRUNCATED} ELSE 0 END AS cut FROM judged
), best AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS after, '000000000:' || chr(1) AS b0, '000000004:II' || chr(1) || 'user:' || chr(10) || 'assistant:' || chr(10) AS b1,
    '000000002:I' || chr(1) || 'assistant:' || chr(10) AS b2, '000000000:' || chr(1) AS b3 FROM conversations
  UNION ALL
  SELECT conv_id, after, {_inserted(0, "c2")}, {_inserted(1, "c2")}, c2, c3 FROM (
    SELECT *, {_inserted(2, "a3")} AS c2, {_inserted(3, "a2")} AS c3 FROM (
      SELECT b.conv_id, b.after + 1 AS after, {", ".join(f"{_rows_taken(i)} AS a{i}" for i in range(4))} FROM best b JOIN symbols s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.after = b.after))
), ended AS (
  SELECT conv_id, arg_max(b0, after) AS b FROM best GROUP BY conv_id
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (next_initial IS NOT NULL AND initial || next_initial NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(b[1:9] AS BIGINT) AS cost, b[11:instr(b, chr(1)) - 1] AS audit, sha256(b[instr(b, chr(1)) + 1:-2]) AS repaired_sha256
FROM ended e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
