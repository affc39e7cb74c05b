"""Repair of a conversation's structure at the least cost, by Hirschberg's divide and conquer.

A conversation's role initials have to read ``(s?(ua)+)?``. Its rows are edited in order: keep (K, cost 0), give the role user or assistant
(R, 1), delete (D, 2; the only edit of a blank or repeated row), and insert an empty user or assistant turn anywhere (I, 5); a truncated
row that stays costs 5 more. Before each row the pattern is in one of four states (start, after s, after u, after a), so what rows do is
a 4 x 4 table of least costs, and what two stretches do is the (min, +) product of theirs.

Edits (their initials) with the least cost whose text is ASCII-least are chosen. No text of edits that ends with a row's own edit is a
prefix of another that ends with the same row's, so the ways from one state into the four states behind a row have a strict order; four ranks carry
it along with the four costs. Hirschberg's recursion runs costs forward to the middle and backward from the end, takes
the crossing state of least cost, of several the one of the least rank, and repeats in both halves: two vectors of four, no table of
pointers. The same recursion serves rows in a run of at most ``blocks.BLOCK`` rows, and runs in a conversation, whose length
is not bounded; runs of one conversation are solved by different tasks.

Defined results: a null role, text, id or turn counts as one blank where the contract damages rows; null ids are one conversation; null
turns come first; rows of one turn are in the order of role and text; rows equal in all four columns stand together, and all but the first are repeats; a role that
begins with none of s, u, a (an empty one, say) can't be kept; texts of any length stay whole; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks
from .scratch import stored

BLANKS = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted turn, or after one whose role was set.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: What has to be inserted at the end, by the state there.
CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 50

Table = list[list[tuple[int, int]]]  # [state before][state after] -> (cost, rank among the ways from the same state)


def words_of(initial: str, removed: bool, truncated: bool) -> list[list[tuple[int, str]]]:
    """[state before][state after] -> (least cost, ASCII-least word of edits) of one row with the inserts before it."""
    out = [[(NEVER, "")] * 4 for _ in range(4)]
    more = TRUNCATED if truncated else 0
    for first in range(4):
        state = first
        for n in range(3):
            ways = [(DELETE, "D", state)]
            if not removed:
                if (state, initial) in KEPT:
                    ways.append((more, "K", KEPT[state, initial]))
                ways.append((REROLE + more, "R", NEXT[state]))
            for cost, edit, after in ways:
                out[first][after] = min(out[first][after], (cost + INSERT * n, "I" * n + edit))
            state = NEXT[state]
    return out


def table_of(words: list[list[tuple[int, str]]]) -> Table:
    """The same with ranks in place of words."""
    return [[(cost, sorted(w for _, w in row).index(word)) for cost, word in row] for row in words]


#: By (initial, has to go, truncated).
WORDS = {(i, d, t): words_of(i, d, t) for i, d, t in itertools.product(("s", "u", "a", ""), (False, True), (False, True))}
TABLES = {k: table_of(w) for k, w in WORDS.items()}


def kind_of(role: str, fault: str) -> tuple[str, bool, bool]:
    initial = role[:1]
    return initial if initial in ("s", "u", "a") else "", fault in ("blank", "duplicate"), fault == "truncated"


def onward(vector: list[tuple[int, int]], table: Table) -> list[tuple[int, int]]:
    """(cost, rank) of each state after a table, from those before it."""
    best = []
    for after in range(4):
        cost, rank, before = min((min(vector[b][0] + table[b][after][0], NEVER), vector[b][1], b) for b in range(4))
        best.append((cost, (rank, table[before][after][1])))
    order = sorted({way for _, way in best})
    return [(cost, order.index(way)) for cost, way in best]


def forward(tables: list[Table], state: int) -> list[tuple[int, int]]:
    vector = [(0 if s == state else NEVER, 0) for s in range(4)]
    for table in tables:
        vector = onward(vector, table)
    return vector


def backward(tables: list[Table], state: int) -> list[int]:
    costs = [0 if s == state else NEVER for s in range(4)]
    for table in reversed(tables):
        costs = [min(min(table[b][a][0] + costs[a] for a in range(4)), NEVER) for b in range(4)]
    return costs


def product(tables: list[Table]) -> Table:
    """One table for consecutive ones."""
    return [forward(tables, state) for state in range(4)]


def crossings(tables: list[Table], first: int, last: int) -> list[int]:
    """The state after each table on the best way from state ``first`` to state ``last``."""
    states = [last] * len(tables)

    def halve(lo: int, hi: int, before: int, after: int) -> None:
        if hi - lo < 2:
            return
        middle = (lo + hi) // 2
        ahead, behind = forward(tables[lo:middle], before), backward(tables[middle:hi], after)
        _, _, state = min((ahead[s][0] + behind[s], ahead[s][1], s) for s in range(4))
        states[middle - 1] = state
        halve(lo, middle, before, state)
        halve(middle, hi, state, after)

    halve(0, len(tables), first, last)
    return states


def final_state(vector: list[tuple[int, int]]) -> int:
    return min((vector[s][0] + INSERT * len(CLOSING[s]), vector[s][1], s) for s in range(4))[2]


def edits_of(kinds: list[tuple[str, bool, bool]], first: int, last: int, ends: bool) -> list[tuple[str, list[str | None]]]:
    """(edits, roles of the turns they leave; None: its own) of each row; ``ends``: the last row's take the closing inserts."""
    out, state = [], first
    for kind, after in zip(kinds, crossings([TABLES[k] for k in kinds], first, last)):
        word, roles = WORDS[kind][state][after][1], []
        for edit in word:
            state = state if edit == "D" else KEPT[state, kind[0]] if edit == "K" else NEXT[state]
            if edit != "D":
                roles.append(None if edit == "K" else NAMES[state])
        out.append((word, roles))
    if ends and out:
        for _ in CLOSING[state]:
            state = NEXT[state]
            out[-1] = (out[-1][0] + "I", [*out[-1][1], NAMES[state]])
    return out


# ---- rows, runs, conversations -------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage: one of five faults by the CRC-32 of ``conv_id:turn`` modulo 20."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), fault.alias("fault")).where("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def with_faults(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, again, fault): every row with its first fault; ``again`` counts equal rows."""
    plain = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = stored(plain.groupBy("conv_id", "turn", "role", "text").count(), "repair-rows").withColumn("_text", F.sha2("text", 256))
    turn = F.struct("turn")  # orders nulls first
    first = rows.groupBy(F.col("conv_id").alias("_id"), F.col("role").alias("_role"), F.col("_text").alias("_sha")).agg(F.min(turn).alias("_first"), F.max(turn).alias("_last")).where("_first < _last").drop("_last")
    joined = rows.join(first, rows["conv_id"].eqNullSafe(F.col("_id")) & (F.col("role") == F.col("_role")) & (F.col("_text") == F.col("_sha")), "left")
    copies = joined.select("conv_id", "turn", "role", "text", (F.coalesce(turn > F.col("_first"), F.lit(False))).alias("_late"), F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("again"))
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(end == "", "blank").when(F.col("_late") | (F.col("again") > 0), "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return copies.select("conv_id", "turn", "role", "text", "again", fault.alias("fault"))


def _summary(group):
    rows = list(group)
    yield {"grp": rows[0]["grp"], "block": rows[0]["block"], "summary": json.dumps([product([TABLES[kind_of(r["initial"], r["fault"])] for r in rows]), rows[-1]["initial"]])}


def _combine(summaries: list[str]) -> str:
    parts = [json.loads(s) for s in summaries]
    return json.dumps([product([p[0] for p in parts]), parts[-1][1]])


def _root(summary: str) -> str:
    table = json.loads(summary)[0]
    return json.dumps([START, final_state(table[START]), True, None])


def _push(context: str, summaries: list[str]) -> list[str]:
    first, last, ends, initial = json.loads(context)
    parts, out, state = [json.loads(s) for s in summaries], [], first
    for k, after in enumerate(crossings([p[0] for p in parts], first, last)):
        out.append(json.dumps([state, after, ends and k == len(parts) - 1, initial]))
        state, initial = after, parts[k][1]
    return out


def _solved(group):
    rows = list(group)
    first, last, ends, initial = json.loads(rows[0]["context"])
    kinds = [kind_of(r["role"], r["fault"]) for r in rows]
    for r, kind, (edits, roles) in zip(rows, kinds, edits_of(kinds, first, last, ends)):
        own = r["role"][:1]
        cost = sum({"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[e] for e in edits) + (TRUNCATED if kind[2] and "D" not in edits else 0)
        illegal, initial = initial is not None and initial + own not in ("su", "ua", "au"), own
        kept = [k for k, e in enumerate(x for x in edits if x != "D") if e != "I"]
        turns = [{"role": r["role"] if role is None else role, "text": r["text"] if k in kept else ""} for k, role in enumerate(roles)]
        yield {"conv_id": r["grp"], "seq": r["seq"], "turn": r["turn"], "role": r["role"], "text": r["text"], "fault": r["fault"], "illegal": illegal, "edits": edits, "cost": cost, "repaired": turns}


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq, turn, role, text, fault, illegal, edits, cost, repaired) of every row, by ``seq`` in order.

    ``edits`` are the row's, with the inserts before it (and, on the last row, after it); ``repaired`` is the array of turns (role, text) that
    they leave. ``illegal``: the initials of the row before and its own are no legal pair.
    """
    types = dict(conversations.dtypes)
    rows = blocks.numbered(with_faults(conversations), ["conv_id", "turn", "role", "text", "again"], "repair-sorted").withColumnRenamed("conv_id", "grp").withColumn("block", blocks.block_of(F.col("seq")))
    narrow = rows.select("grp", "block", "seq", F.left("role", F.lit(1)).alias("initial"), "fault")
    runs = blocks.streamed(narrow, ["grp", "block"], ["seq"], _summary, f"grp {types['conv_id']}, block long, summary string")
    told = blocks.contexts(runs, _combine, _root, _push, "repair").select(F.col("grp").alias("_grp"), F.col("block").alias("_block"), "context")
    joined = rows.join(told, rows["grp"].eqNullSafe(told["_grp"]) & (rows["block"] == told["_block"])).drop("_grp", "_block")
    schema = f"conv_id {types['conv_id']}, seq long, turn {types['turn']}, role string, text string, fault string, illegal boolean, edits string, cost long, repaired array<struct<role: string, text: string>>"
    return blocks.streamed(joined, ["grp", "block"], ["seq"], _solved, schema)


def _digest(group):
    sha, audit, conv, begun = hashlib.sha256(), [], None, False
    for r in group:
        conv = r["conv_id"]
        audit.append(r["edits"])
        for turn in r["repaired"]:
            sha.update(("\n" * begun + turn["role"] + ":" + turn["text"]).encode())
            begun = True
    yield {"conv_id": conv, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}



def repair_digest(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for every original conversation. Its digest is taken from its rows as they pass, one by one, in order."""
    kind = dict(conversations.dtypes)["conv_id"]
    rows = stored(rows, "repair-edits")
    digests = blocks.streamed(rows.select("conv_id", "seq", "edits", "repaired"), ["conv_id"], ["seq"], _digest, f"conv_id {kind}, audit string, repaired_sha256 string").withColumnRenamed("conv_id", "_a")
    sums = rows.groupBy(F.col("conv_id").alias("_b")).agg(
        F.min("turn").alias("_low"), F.max("turn").alias("_high"), F.sum("cost").alias("cost"), F.count(F.when(F.col("illegal"), 1)).alias("illegal"),
        *(F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")),
    )
    turns = rows.where("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy(F.col("conv_id").alias("_c")).agg(F.count("*").alias("_turns"))
    ids = conversations.select("conv_id").distinct()
    joined = ids
    for table, key in ((digests, "_a"), (sums, "_b"), (turns, "_c")):
        joined = joined.join(table, joined["conv_id"].eqNullSafe(table[key]), "left")
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")).alias(c)
    gaps = F.coalesce(F.col("_high") - F.col("_low") + 1 - F.col("_turns"), F.lit(0)).cast("long")
    return joined.select("conv_id", gaps.alias("gaps"), *(number(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
