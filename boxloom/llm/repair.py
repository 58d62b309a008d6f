"""Conversation structure repair: the cheapest edits that give roles of the form (s?(ua)+)?, by cost layers of grammar states.

The rows of a conversation stand in the order of turn, then role, then text (its first 64 characters, then a hash), nulls first. A row's
first fault counts: blank (no character but white space), duplicate (role and text seen earlier in the conversation), truncated (its last
character but white space is none of . ! ?). Each row is kept (K, free), given the role user or assistant (R, 3) or deleted (D, 4; blank
and duplicate rows have to be); empty rows of user or assistant may be inserted anywhere (I, 3); each truncated row that stays adds 3.

The grammar has four states: nothing yet, after the system row, after a user, after an assistant. For each turn, from the last to the
first, one word holds layers: layer k is the bitset of states from which the rest can be accepted for at most k above the least cost
there. A row turns layers into layers by shifts (by its costs) and masks (by its role), all at once. From every state the end costs at
most 10 more than from the best one, as an assistant can be replaced by at most two inserts and a system row by a deletion, so 16 layers
lose nothing. The first layer that holds the first state gives the cost; from there bits are followed forward, the letter that comes
first in ASCII where several lead on, which gives the least of the cheapest audits.

Rows are dealt by ranges of (conversation, turn, role, text), so a conversation with most of all rows is spread like others. A
conversation that lies inside one range and one segment is repaired where it lies. Of others, at most two for each range and those of
several segments, hashes of rows are counted to find duplicates, a byte a row (role and fault) meets in one task for the layers, and
the audit, as long as that, goes back to the segments; texts stay where they are. Very long texts are held whole, a segment at a time.

A null turn stands first; null roles and texts are one space, so such rows are blank, or have no role of the grammar; a null conv_id is
a conversation of its own. Rows that tie are those of one turn; repeated rows are duplicates. Empty tables give empty tables. Only the
four columns are read, so others may have any names."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from boxloom.llm.common import parallelism, staged

#: White space, ends of sentences, and the costs of edits.
SPACE, ENDS = " \t\n\x0b\x0c\r", ".!?"
DELETE, REROLE, INSERT, CUT = 4, 3, 3, 3
#: States as bits of a layer: nothing yet, after system, user, assistant. Layers are four bits each, the lowest first.
START, SYSTEM, USER, ASSISTANT = 1, 2, 4, 8
LAYERS = 16
_ALL = (1 << 4 * LAYERS) - 1
#: A row is a byte: 4 * (s, u, a or another initial) + (sound, truncated, blank, duplicate).
SOUND, TRUNCATED, BLANK, DUPLICATE = range(4)
INITIALS = "sua"
NAMES = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def kind(role: str, text: str) -> int:
    """What a row is, duplicates left aside."""
    body = text.rstrip(SPACE)
    return 4 * (INITIALS.find(role[:1]) % 4 if role else 3) + (BLANK if not body else SOUND if body[-1] in ENDS else TRUNCATED)


def _lanes(bit: int) -> int:
    return sum(bit << 4 * k for k in range(2 * LAYERS))


_LANE = {b: _lanes(b) for b in (START, SYSTEM, USER, ASSISTANT)}


def _before(word: int, to: int) -> int:
    """The layers of states that one row of a role leads from, to the states of that role in word."""
    hit = (word & _LANE[to]) // to
    return hit * {SYSTEM: START, USER: START | SYSTEM | ASSISTANT, ASSISTANT: USER}[to]


def _spoken(word: int) -> int:
    return _before(word, USER) | _before(word, ASSISTANT)


def _settled(word: int) -> tuple[int, int]:
    """Layers with what inserts add, each holding the layers below it, and how many empty ones were dropped at the bottom."""
    for _ in range(2):  # a third insert comes back to where the first led
        word |= _spoken(word) << 4 * INSERT
    gone = 0
    while not word & 15:
        word >>= 4
        gone += 1
    for step in (4, 8, 16, 32):
        word |= word << step
    return word & _ALL, gone


class Layers:
    """The step over a row, worked out once for each pair of word and row; there are few, as words hold differences up to 10."""

    def __init__(self) -> None:
        self.end, self.steps = _settled(START | ASSISTANT)[0], {}

    def step(self, word: int, row: int) -> tuple[int, int]:
        if (got := self.steps.get((word, row))) is None:
            who, fault = divmod(row, 4)
            out = word << 4 * DELETE
            if fault < BLANK:
                more = CUT if fault == TRUNCATED else 0
                out |= _spoken(word) << 4 * (REROLE + more)
                if who < 3:
                    out |= _before(word, (SYSTEM, USER, ASSISTANT)[who]) << 4 * more
            got = self.steps[word, row] = _settled(out)
        return got

    def solve(self, rows: bytes) -> tuple[int, str]:
        """The least cost of a conversation, and the least of its audits."""
        n = len(rows)
        words, bases = array("Q", bytes(8 * (n + 1))), array("q", bytes(8 * (n + 1)))
        word, base = self.end, 0
        words[n] = word
        for i in range(n - 1, -1, -1):
            word, gone = self.step(word, rows[i])
            base += gone
            words[i], bases[i] = word, base
        layer = next(k for k in range(LAYERS) if word >> 4 * k & START)
        left = cost = base + layer
        has = lambda i, q, k: k >= bases[i] and words[i] >> 4 * min(k - bases[i], LAYERS - 1) & q
        out, i, q = [], 0, START
        while i < n or left:
            fault = rows[i] % 4 if i < n else None
            said = ASSISTANT if q == USER else USER
            more = CUT if fault == TRUNCATED else 0
            if i < n and has(i + 1, q, left - DELETE):
                out.append("D")
                left -= DELETE
            elif has(i, said, left - INSERT):
                out.append("I")
                left, q = left - INSERT, said
                continue
            elif fault < BLANK and (to := kept(q, rows[i])) and has(i + 1, to, left - more):
                out.append("K")
                left, q = left - more, to
            else:
                out.append("R")
                left, q = left - REROLE - more, said
            i += 1
        return cost, "".join(out)


def kept(q: int, row: int) -> int:
    """The state behind a row that is kept in state q; 0 where its role does not follow."""
    who = row // 4
    if who == 0:
        return SYSTEM if q == START else 0
    return USER if who == 1 and q != USER else ASSISTANT if who == 2 and q == USER else 0


def repaired(audit: str, q: int, rows: bytes, roles: list[str], texts: list[str]) -> tuple[list[tuple[str, str]], int]:
    """The rows that an audit makes of some rows from state q on, and the state behind them."""
    out, i = [], 0
    for letter in audit:
        said = ASSISTANT if q == USER else USER
        if letter == "I":
            out.append((NAMES[said], ""))
            q = said
            continue
        if letter == "K":
            out.append((roles[i], texts[i]))
            q = kept(q, rows[i])
        elif letter == "R":
            out.append((NAMES[said], texts[i]))
            q = said
        i += 1
    return out, q


def cut_audit(audit: str, rows: bytes, sizes: Iterable[int]) -> Iterator[tuple[str, int]]:
    """The audit in pieces for runs of rows of these sizes, and the state before each; inserts go to the row that follows them, at the
    end to the last run."""
    at, row, q, sizes = 0, 0, START, list(sizes)
    for k, n in enumerate(sizes):
        begin, first, stop = at, q, row + n
        while at < len(audit) and (row < stop or k == len(sizes) - 1):
            letter = audit[at]
            if letter == "K":
                q = kept(q, rows[row])
            elif letter != "D":
                q = ASSISTANT if q == USER else USER
            row += letter != "I"
            at += 1
        yield audit[begin:at], first


def gaps(turns: list[int | None]) -> tuple[int | None, int | None, int]:
    """First and last turn of rows in order, and how many there are; nulls don't count."""
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], 1 + sum(a != b for a, b in zip(known, known[1:], strict=False))) if known else (None, None, 0)


def counted(rows: bytes) -> dict[str, int]:
    pairs = zip((r // 4 for r in rows), (r // 4 for r in rows[1:]), strict=False)
    fault = [sum(r % 4 == f for r in rows) for f in range(4)]
    return {"blank": fault[BLANK], "duplicate": fault[DUPLICATE], "truncated": fault[TRUNCATED], "illegal": sum(p not in _LEGAL for p in pairs)}


REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
#: What is told of a run of rows; roles and texts are the repaired ones where it is done, else those that came.
SEGMENT = f"part int, no int, done boolean, {REPORT}, audit string, roles array<string>, texts array<string>"
RAW = "rows binary, hashes array<binary>, first_turn long, last_turn long, turns long"


def segments_of(rows: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    """Runs of the rows of a conversation, in order; those of a conversation that lies in one run, away from the edges, are repaired."""
    id_field = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    schema = T.StructType([id_field, *T.StructType.fromDDL(f"{SEGMENT}, {RAW}").fields])
    arrow = to_arrow_schema(schema)
    head = F.substring("text", 1, 64)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("_head"), F.col("_hash"), F.col("_id")]
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    # equal rows are told apart by a number, so that many of them fit no single range
    keyed = plain.select("*", head.alias("_head"), F.xxhash64("text").alias("_hash"), F.monotonically_increasing_id().alias("_id"))
    dealt = keyed.repartitionByRange(parallelism(rows.sparkSession), *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, layers, made, held = TaskContext.get().partitionId(), Layers(), [], 0
        of, first, no, chars = None, True, 0, 0
        turns, roles, texts = [], [], []

        def close(whole: bool) -> None:
            if not turns:
                return
            base = {"conv_id": of[0], "part": part, "no": no, "done": whole}
            kinds = bytearray(kind(r, t) for r, t in zip(roles, texts, strict=True))
            if whole:
                seen = set()
                for i, pair in enumerate(zip(roles, texts, strict=True)):
                    if kinds[i] % 4 != BLANK and pair in seen:
                        kinds[i] = kinds[i] // 4 * 4 + DUPLICATE
                    seen.add(pair)
                cost, audit = layers.solve(kinds)
                new, _ = repaired(audit, START, kinds, roles, texts)
                low, high, n = gaps(turns)
                made.append(base | counted(kinds) | {"gaps": high - low + 1 - n if n else 0, "cost": cost, "audit": audit, "roles": [r for r, _ in new], "texts": [t for _, t in new]})
            else:
                keys = [None if k % 4 == BLANK else hashlib.blake2b(f"{len(r)}:{r}{t}".encode(), digest_size=16).digest() for k, r, t in zip(kinds, roles, texts, strict=True)]
                low, high, n = gaps(turns)
                made.append(base | {"roles": roles, "texts": texts, "rows": bytes(kinds), "hashes": keys, "first_turn": low, "last_turn": high, "turns": n})

        for b in batches:
            for conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                new = of is not None and of != (conv,)
                if new or len(turns) >= most_rows or chars > most_chars:
                    close(new and no == 0 and not first)
                    held += chars
                    first, no = (False, 0) if new else (first, no + 1)
                    turns, roles, texts, chars = [], [], [], 0
                    if held > most_chars or len(made) > 2000:
                        yield pa.RecordBatch.from_pylist(made, schema=arrow)
                        made, held = [], 0
                of = (conv,)
                turns.append(turn)
                roles.append(role)
                texts.append(text)
                chars += len(text)
        close(False)
        yield pa.RecordBatch.from_pylist(made, schema=arrow)

    return dealt.mapInArrow(run, schema)


def key_of(c: str) -> Column:
    """A conversation's id as a text that is never null, to join by."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def duplicates(raw: DataFrame) -> DataFrame:
    """(key, part, no, repeats): the rows of each run that are no first ones. Only hashes of rows are counted and joined."""
    each = raw.select("key", "part", "no", F.posexplode("hashes").alias("pos", "hash")).where("hash is not null")
    place = F.struct("part", "no", "pos")
    often = each.groupBy("key", "hash").agg(F.min(place).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = each.join(often, ["key", "hash"]).where(place != F.col("least"))
    return later.groupBy("key", "part", "no").agg(F.collect_list("pos").alias("repeats"))  # at most the rows of a run


def audits(light: DataFrame) -> DataFrame:
    """(key, part, no, REPORT, audit, state): the audit of each run of conversations of several runs; their report stands at the first."""
    schema = T.StructType.fromDDL(f"key string, part int, no int, {REPORT}, audit string, state int")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers, of, mine = Layers(), None, []

        def close() -> pa.RecordBatch:
            rows = b"".join(m["rows"] for m in mine)
            cost, audit = layers.solve(rows)
            known = [m for m in mine if m["turns"]]
            n = sum(m["turns"] for m in known) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(known, known[1:], strict=False))
            report = counted(rows) | {"cost": cost, "gaps": known[-1]["last_turn"] - known[0]["first_turn"] + 1 - n if known else 0}
            pieces = cut_audit(audit, rows, (len(m["rows"]) for m in mine))
            out = [{k: m[k] for k in ("key", "part", "no")} | {k: v if i == 0 else 0 for k, v in report.items()} | {"audit": a, "state": q} for i, (m, (a, q)) in enumerate(zip(mine, pieces, strict=True))]
            return pa.RecordBatch.from_pylist(out, schema=arrow)

        for b in batches:
            for row in b.to_pylist():
                if mine and row["key"] != of:
                    yield close()
                    mine = []
                of, rows = row["key"], bytearray(row["rows"])
                for i in row.pop("repeats") or ():
                    rows[i] = rows[i] // 4 * 4 + DUPLICATE
                mine.append(row | {"rows": bytes(rows)})
        if mine:
            yield close()

    columns = ["key", "part", "no", "rows", "first_turn", "last_turn", "turns", "repeats"]
    return light.select(*columns).repartition(parallelism(light.sparkSession), "key").sortWithinPartitions("key", "part", "no").mapInArrow(run, schema)


def repair(rows: DataFrame, most_rows: int = 4096, most_chars: int = 4 << 20) -> DataFrame:
    """(conv_id, part, no, gaps, blank, duplicate, truncated, illegal, cost, audit, roles, texts) of rows (conv_id, turn, role, text).

    A conversation is one or more runs, in the order of part and no: its numbers are the sums over them, its audit and its repaired rows
    their concatenations. Conversations without rows have none."""
    cut = staged(segments_of(rows, most_rows, most_chars), "segments")
    names = [f.name for f in T.StructType.fromDDL(f"part int, no int, {REPORT}, audit string, roles array<string>, texts array<string>")]
    raw = cut.where("not done").withColumn("key", key_of("conv_id"))
    light = raw.drop("roles", "texts", "audit").join(duplicates(raw), ["key", "part", "no"], "left")
    found = audits(light)
    left = raw.select("conv_id", "key", "part", "no", "rows", "roles", "texts").join(found, ["key", "part", "no"])
    schema = T.StructType([cut.schema["conv_id"], *[cut.schema[n] for n in names]])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                new, _ = repaired(row["audit"], row["state"], row["rows"], row["roles"], row["texts"])
                yield pa.RecordBatch.from_pylist([row | {"roles": [r for r, _ in new], "texts": [t for _, t in new]}], schema=arrow)

    spanning = left.select("conv_id", *names, "rows", "state").mapInArrow(run, schema)
    return cut.where("done").select("conv_id", *names).unionByName(spanning)


def digests(segments: DataFrame) -> DataFrame:
    """(conv_id, REPORT, audit, repaired_sha256): a row for each conversation, its digest over `role:text` lines. The digest takes a
    conversation's runs one after the other, a run at a time."""
    schema = T.StructType([segments.schema["conv_id"], *T.StructType.fromDDL(f"{REPORT}, audit string, repaired_sha256 string").fields])
    arrow = to_arrow_schema(schema)
    sums = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, of = [], None

        def close() -> None:
            done.append({"conv_id": of[0], "audit": "".join(audit), "repaired_sha256": digest.hexdigest()} | dict(zip(sums, total, strict=True)))

        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                if of != (row["conv_id"],):
                    if of is not None:
                        close()
                    of, total, audit, digest, lead = (row["conv_id"],), [0] * len(sums), [], hashlib.sha256(), ""
                total = [a + row[k] for a, k in zip(total, sums, strict=True)]
                audit.append(row["audit"])
                for role, text in zip(row["roles"], row["texts"], strict=True):
                    digest.update(f"{lead}{role}:{text}".encode())
                    lead = "\n"
            if len(done) > 5000:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
                done = []
        if of is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, schema=arrow)

    dealt = segments.repartition(parallelism(segments.sparkSession), "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "part", "no")
    return dealt.mapInArrow(run, schema)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with faults planted by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 removes . ! ? from it, 3
    repeats it, 4 makes it a user's; nulls count as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    body = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace(text("text"), "[.!?]", "")).otherwise(text("text"))
    marked = rows.select("conv_id", "turn", "role", "text", fault.alias("_fault")).where("_fault != 0")
    copies = F.sequence(F.lit(1), F.when(F.col("_fault") == 3, 2).otherwise(1))
    out = marked.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(text("role")).alias("role"), body.alias("text"), F.explode(copies).alias("_copy"))
    return out.drop("_copy")
