"""Repair of the structure of conversations by their cheapest edits.

A conversation is right when the initials of its roles read `(s?(ua)+)?`. A path through the graph (rows done, what the last kept
role was) is a sequence of edits. Its weight is one integer: the high digits are the cost, the low digits spell the edits' letters in
fixed places, a slot of three digits for each row (up to two inserts and what is done with the row itself) that ends in zeros where
fewer are needed. Smaller integers are cheaper edits and, at equal cost, those that come first in ASCII order, so the minimum of plain
integer sums decides everything.

A conversation of any length is cut into blocks of BLOCK rows over one range-partitioned sort. Each block alone gives the 4 x 4
minima between its states; the blocks of a conversation are put together from the last one, where the rank of the four
possible endings (one digit) stands for their letters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedtide.llm.common import store

ORDER_CHARS = 64  # of role and text that order rows of one turn: bounds what a sampled sort key can hold
BLOCK = 128  # rows whose letters one integer holds
DIGIT_BITS, SLOT_BITS = 3, 9
LETTERS = "_DIKR"  # a letter's digit is its place here, in ASCII order; 0 ends a slot
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1  # costs
ROLES = {"u": "user", "a": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)  # the last role of the repaired conversation so far
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDINGS = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]  # what each state still needs after the last row
BLANK, DUPLICATE, CUT, FINE = "blank", "duplicate", "truncated", "fine"
SPACE = r"\x20\x09-\x0D"
RUNS = "conv_id bigint, place bigint, rows int, weights array<binary>"
EDITS = "conv_id bigint, place bigint, letters string"
REPAIRED = "conv_id bigint, position bigint, role string, text string"
REPORT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage that crc32 of `conv_id:turn` chooses; a null is one space."""

    def spaced(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")
    ).filter("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def laid_out(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault, place, stored; `place` orders the rows of a conversation: by turn (null first), rows of one turn by
    the first ORDER_CHARS characters of role, then of text, then a hash of both, so that equal ones are neighbours. A row that repeats an earlier role and text is found by the first
    place of each (conversation, role, text), an aggregate; only those that occur twice are joined back."""
    blank = ~F.col("text").rlike(f"[^{SPACE}]")
    cut = ~F.col("text").rlike(rf"[.!?][{SPACE}]*\z")
    rows = rows.select(
        "conv_id", "turn", "role", "text", blank.alias("blank"), cut.alias("cut"),
        F.substring("role", 1, ORDER_CHARS).alias("by_role"), F.substring("text", 1, ORDER_CHARS).alias("by_text"), F.xxhash64("role", "text").alias("hash"),
        F.sha2("text", 256).alias("same"), F.monotonically_increasing_id().alias("tie"),
    )
    when = F.struct(F.col("turn").isNotNull().alias("dated"), "turn", "tie")
    firsts = rows.filter("not blank").groupBy("conv_id", "role", "same").agg(F.min(when).alias("first"), F.count("*").alias("n")).filter("n > 1")
    firsts = firsts.toDF("_conv_id", "_role", "_same", "first", "n")
    found = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("same") == F.col("_same")) & ~F.col("blank")
    again = F.col("first").isNotNull() & (F.col("first.tie") != F.col("tie"))
    fault = F.when(F.col("blank"), BLANK).when(again, DUPLICATE).when(F.col("cut"), CUT).otherwise(FINE)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "by_role", "by_text", "hash", "tie"]
    judged = rows.join(firsts, found, "left").select("conv_id", "turn", "role", "text", *order[2:], fault.alias("fault"))
    laid = judged.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    return store(laid.drop(*order[2:]), "conversations")


def steps(initial: str, fault: str) -> list[list[tuple[int, int] | None]]:
    """(cost, slot) of the best edits that lead from each state to each other over one row: inserts before it, then the row."""

    def spelled(letters: str) -> int:
        return sum(LETTERS.index(x) << DIGIT_BITS * (2 - k) for k, x in enumerate(letters))

    best: list[list[tuple[int, int] | None]] = [[None] * 4 for _ in range(4)]
    for start in range(4):
        state, cost, letters = start, 0, ""
        for _ in range(3):
            moves = [(state, DELETE, "D")]
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED if fault == CUT else 0
                moves += [(NEXT.get((state, initial)), more, "K")] + [(NEXT.get((state, x)), REROLE + more, "R") for x in ROLES]
            for end, price, letter in moves:
                if end is not None:
                    found = (cost + price, spelled(letters + letter))
                    if best[start][end] is None or found < best[start][end]:
                        best[start][end] = found
            state, cost, letters = next(s for x in ROLES if (s := NEXT.get((state, x))) is not None), cost + INSERT, letters + "I"
    return best


def block_weights(rows: list[tuple[str, str]]) -> list[bytes]:
    """The least weight of a path over the rows (initial, fault) between each pair of states, empty where there is none."""
    known = {row: steps(*row) for row in set(rows)}
    weights: list[list[int | None]] = [[0 if q == p else None for q in range(4)] for p in range(4)]
    width = 0
    for row in rows:
        width += SLOT_BITS
        edge = [[None if e is None else (e[0] << width) + e[1] for e in line] for line in known[row]]
        weights = [
            [min(((line[q] << SLOT_BITS) + edge[q][end] for q in range(4) if line[q] is not None and edge[q][end] is not None), default=None) for end in range(4)]
            for line in weights
        ]
    return [b"" if w is None else w.to_bytes(w.bit_length() // 8 + 1) for line in weights for w in line]


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<binary>": pa.list_(pa.binary())}
    fields = [column.split() for column in ddl.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(column.to_pylist() for column in batch.columns), strict=True)


def block_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, place, initial, fault in order -> one row for each run of at most BLOCK neighbours of a conversation."""
    run: list[tuple[str, str]] = []
    conv, first = None, 0
    for batch in batches:
        out = []
        for conv_id, place, initial, fault in _rows(batch):
            if run and (conv_id != conv or place != first + len(run) or len(run) == BLOCK):
                out.append((conv, first, len(run), block_weights(run)))
                run = []
            if not run:
                conv, first = conv_id, place
            run.append((initial, fault))
        yield _batch(out, RUNS)
    if run:
        yield _batch([(conv, first, len(run), block_weights(run))], RUNS)


class Endings:
    """The best ways to end a conversation from each state, built from its last block to its first."""

    def __init__(self) -> None:
        self.cost = [cost for cost, _ in ENDINGS]
        self.rank = _ranks([letters for _, letters in ENDINGS])
        self.blocks: list[tuple[int, int, list[tuple[int, int]]]] = []  # place, rows, per state: next state, low digits

    def add(self, place: int, rows: int, weights: list[bytes]) -> None:
        width = SLOT_BITS * rows
        chosen, cost, keys = [], [], []
        for start in range(4):
            totals = []
            for end, packed in enumerate(weights[4 * start : 4 * start + 4]):
                if packed:
                    totals.append((int.from_bytes(packed) + (self.cost[end] << width) << 2 | self.rank[end], end))
            total, end = min(totals)  # equal totals end in the same letters
            low = total >> 2 & (1 << width) - 1
            chosen.append((end, low))
            cost.append(total >> 2 + width)
            keys.append(low << 2 | self.rank[end])
        self.cost, self.rank = cost, _ranks(keys)
        self.blocks.append((place, rows, chosen))

    def letters(self) -> Iterator[tuple[int, str]]:
        """(place, letters) of each block, first to last, along the best path from the start."""
        state = START
        for k, (place, rows, chosen) in enumerate(reversed(self.blocks)):
            state, low = chosen[state]
            digits = (low >> DIGIT_BITS * i & 7 for i in reversed(range(3 * rows)))
            last = ENDINGS[state][1] if k == len(self.blocks) - 1 else ""
            yield place, "".join(LETTERS[d] for d in digits if d) + last


def _ranks(values: list) -> list[int]:
    order = sorted(set(values))
    return [order.index(v) for v in values]


def best_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs, each conversation's from the last to the first -> conv_id, place, letters for each run."""
    endings, conv = None, None
    for batch in batches:
        out = []
        for conv_id, place, rows, weights in _rows(batch):
            if endings is not None and conv_id != conv:
                out += [(conv, *found) for found in endings.letters()]
                endings = None
            if endings is None:
                endings, conv = Endings(), conv_id
            endings.add(place, rows, weights)
        yield _batch(out, EDITS)
    if endings is not None:
        yield _batch([(conv, *found) for found in endings.letters()], EDITS)


def edits(laid: DataFrame) -> DataFrame:
    """conv_id, place, letters: the cheapest edits of each block of `laid_out` rows; the last block's letters may end in inserts."""
    runs = laid.select("conv_id", "place", F.substring("role", 1, 1), "fault").mapInArrow(block_runs, RUNS)
    return runs.repartition("conv_id").sortWithinPartitions("conv_id", F.col("place").desc()).mapInArrow(best_edits, EDITS)


def _marked(conversations: DataFrame, laid: DataFrame) -> DataFrame:
    """Each conversation's rows in order, in one partition: first a row for the conversation itself, and each block's letters before its rows."""
    columns = ["conv_id", "place", "letters", "turn", "role", "text", "fault"]
    letters = edits(laid)
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("place", F.lit(-1).cast("long")).withColumn("letters", F.lit(""))
    union = every.unionByName(letters).unionByName(laid, allowMissingColumns=True).select(columns)
    return union.repartition("conv_id").sortWithinPartitions("conv_id", "place", F.col("letters").isNull())


class Walk:
    """Applies the edits of one conversation, row by row."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.state, self.letters, self.audit = conv_id, START, iter(()), []
        self.cost = 0

    def block(self, letters: str) -> None:
        self.audit.append(letters)
        self.letters = iter(letters)

    def _new(self) -> str:
        role, self.state = next((role, s) for x, role in ROLES.items() if (s := NEXT.get((self.state, x))) is not None)
        self.cost += 2  # an insert or a new role
        return role

    def row(self, role: str, text: str, fault: str) -> list[tuple[str, str]]:
        out = []
        for letter in self.letters:
            if letter == "I":
                out.append((self._new(), ""))
                continue
            if letter == "D":
                self.cost += DELETE
                return out
            self.cost += TRUNCATED if fault == CUT else 0
            if letter == "R":
                role = self._new()
            else:
                self.state = NEXT[self.state, role[:1]]
            return [*out, (role, text)]
        raise ValueError(f"conversation {self.conv_id} has more rows than edits")

    def end(self) -> list[tuple[str, str]]:
        return [(self._new(), "") for _ in self.letters]


class Report(Walk):
    """Counts a conversation's faults and hashes what it becomes, with a memory of a few numbers."""

    def __init__(self, conv_id: int | None):
        super().__init__(conv_id)
        self.faults = dict.fromkeys((BLANK, DUPLICATE, CUT, FINE), 0)
        self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.last_role = None
        self.hash, self.begun = hashlib.sha256(), False

    def _take(self, messages: list[tuple[str, str]]) -> None:
        for role, text in messages:
            self.hash.update((("\n" if self.begun else "") + role + ":" + text).encode())
            self.begun = True

    def see(self, turn: int | None, role: str, text: str, fault: str) -> None:
        self._take(self.row(role, text, fault))
        self.faults[fault] += 1
        if self.last_role is not None and self.last_role + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.last_role = role[:1]
        if turn is not None:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.turns += turn != self.last_turn
            self.last_turn = turn

    def result(self) -> tuple:
        self._take(self.end())
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        faults = [self.faults[f] for f in (BLANK, DUPLICATE, CUT)]
        return self.conv_id, gaps, *faults, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = None
    for batch in batches:
        out = []
        for conv_id, place, letters, turn, role, text, fault in _rows(batch):
            if place < 0:
                if found is not None:
                    out.append(found.result())
                found = Report(conv_id)
            elif letters is not None:
                found.block(letters)
            else:
                found.see(turn, role, text, fault)
        yield _batch(out, REPORT)
    if found is not None:
        yield _batch([found.result()], REPORT)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    walk, position = None, 0
    for batch in batches:
        out: list[tuple] = []
        for conv_id, place, letters, _, role, text, fault in _rows(batch):
            messages = []
            if place < 0:
                if walk is not None:
                    out += [(walk.conv_id, position + k, *m) for k, m in enumerate(walk.end())]
                walk, position = Walk(conv_id), 0
            elif letters is not None:
                walk.block(letters)
            else:
                messages = walk.row(role, text, fault)
            out += [(conv_id, position + k, *m) for k, m in enumerate(messages)]
            position += len(messages)
        yield _batch(out, REPAIRED)
    if walk is not None:
        yield _batch([(walk.conv_id, position + k, *m) for k, m in enumerate(walk.end())], REPAIRED)


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, position, role, text: the conversations after their cheapest edits, without any damage of our own.

    A null role or text is one space: such a text is blank and is deleted. Empty texts are blank. Repeated rows are duplicates of
    the first one. Rows of one turn are taken by role, then text (see `laid_out`). Rows without a conv_id are one conversation. A conversation
    of which nothing can stay has no row. An empty table gives an empty result. Other columns are not looked at. The rows must come
    from stored files: a row's number in its file tells equal rows apart.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))
    )
    return _marked(conversations, laid_out(rows)).mapInArrow(_repaired, REPAIRED)


def repair_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for every conversation of `conversations`: the faults of its `rows` (conv_id, turn, role, text), their cheapest edits, and the SHA-256
    of the repaired conversation. The hash reads a conversation's texts in order, so they pass through one task, as a stream: it
    holds one batch of them. A conversation without rows gets zeros, an empty audit and the hash of the empty string. Nulls, ties and
    repeated rows: as in `repair`."""
    return _marked(conversations, laid_out(rows)).mapInArrow(_walked, REPORT)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages all conversations, repairs them and reports each; see `damage` and `repair_report`."""
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair_report(conversations, damage(conversations))
