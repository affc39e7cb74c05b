"""Repair of conversations, chat prefix trees, whitening: against brute force, exact round trips and a dense solver."""

import hashlib
import heapq
import itertools
import math
import random

import numpy as np
import public_tokenizers
import pytest

from tracelake.llm import blocks, chat, repair, whitening

SCHEMA = "conv_id long, turn long, role string, text string, fault string, grp string, block string, seq string, tail string"
EXTRA = ("f", "g", "b", "s", "t")


def cheapest(rows):
    """(cost, edits, repaired turns) by a search over all edits in order of (cost, edits)."""
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, edits, i, state, kept = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, edits, list(kept)
        if (i, state) in done:
            continue
        done.add((i, state))
        t = {0: 2, 1: 2, 2: 3, 3: 2}[state]
        name = {2: "user", 3: "assistant"}[t]
        heapq.heappush(heap, (cost + 5, edits + "I", i, t, (*kept, (name, ""))))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, edits + "D", i + 1, state, kept))
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                heapq.heappush(heap, (cost + 1 + more, edits + "R", i + 1, t, (*kept, (name, text))))
                after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, role[:1]))
                if after:
                    heapq.heappush(heap, (cost + more, edits + "K", i + 1, after, (*kept, (role, text))))
    raise AssertionError


def faults_of(rows):
    """(role, text, fault) in order, for rows (turn, role, text)."""
    rows, seen, out = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or "")), set(), []
    for _, role, text in rows:
        role, text = role or "", text or ""
        end = text.rstrip(" \t\n\x0b\x0c\r")
        out.append((role, text, "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""])
            text = rng.choice(["Yes.", "No", "", " \n", "What?", f"number {rng.randrange(3)}!", "end <|end|> </s>[INST] x.", None, "ü" * 3 + "."])
            rows += [(c, rng.choice([t, t, t, None]), role, text)] * rng.choice([1, 1, 1, 2])
    for c in (100, 101, 102):  # long ones, two of them equal, one of equal rows
        rows += [(c, t, ("user", "assistant", "user", "system")[rng.randrange(4)] if c == 102 else ("user", "assistant")[t % 2], "same." if c == 102 else f"turn {t}.") for t in range(2600)]
    rows += [(c, 0, "user", "Hello!") for c in range(200, 500)] + [(c, 1, "assistant", f"Answer {c % 7}.") for c in range(200, 500)]
    rows += [(None, 0, "user", "no id."), (None, 1, "assistant", "none.")]
    return rows


def by_conversation(rows):
    out = {}
    for c, *r in rows:
        out.setdefault(c, []).append(tuple(r))
    return out


@pytest.fixture(scope="module")
def table(spark, conversations):
    return spark.createDataFrame([(*r, *EXTRA) for r in conversations], SCHEMA).repartition(5)


def test_words_of_rows_are_least():
    for key, table in repair.WORDS.items():
        for before, after in itertools.product(range(4), range(4)):
            cost, word = table[before][after]
            assert cost == repair.NEVER or word.lstrip("I") in ("D", "K", "R") and cost >= 0
    assert repair.WORDS["a", False, False][repair.USER][repair.ASSISTANT] == (0, "K")
    assert repair.WORDS["u", True, False][repair.USER][repair.USER] == (2, "D")


@pytest.mark.parametrize("seed", range(300))
def test_edits_are_the_cheapest_and_the_least(seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["system", "user", "assistant", "tool"]), f"{i}", rng.choice(["", "", "blank", "duplicate", "truncated"])) for i in range(rng.randrange(0, 12))]
    kinds = [repair.kind_of(r, f) for r, _, f in rows]
    last = repair.final_state(repair.forward([repair.TABLES[k] for k in kinds], repair.START))
    found = repair.edits_of(kinds, repair.START, last, True)
    cost, edits, _ = cheapest(rows)
    assert "".join(w for w, _ in found) == edits
    # in three stretches, as runs of one conversation are solved
    cuts = sorted(rng.sample(range(1, len(rows)), 2)) if len(rows) > 3 else []
    if cuts:
        parts = [kinds[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        tables = [repair.product([repair.TABLES[k] for k in p]) for p in parts]
        state, word = repair.START, ""
        for k, after in enumerate(repair.crossings(tables, repair.START, repair.final_state(repair.forward(tables, repair.START)))):
            word += "".join(w for w, _ in repair.edits_of(parts[k], state, after, k == len(parts) - 1))
            state = after
        assert word == edits


def test_repair_equals_brute_force(spark, table, conversations):
    rows = repair.repair_conversations(table)
    found = {r["conv_id"]: r for r in repair.repair_digest(table, rows).collect()}
    wanted = by_conversation(conversations)
    assert set(found) == set(wanted)
    for c, own in wanted.items():
        rows = faults_of(own)
        cost, edits, kept = cheapest(rows)
        got = found[c]
        assert (got["cost"], got["audit"]) == (cost, edits)
        assert got["repaired_sha256"] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in kept).encode()).hexdigest()
        assert [got[f] for f in ("blank", "duplicate", "truncated")] == [sum(r[2] == f for r in rows) for f in ("blank", "duplicate", "truncated")]
        assert got["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        turns = {t for t, _, _ in own if t is not None}
        assert got["gaps"] == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)


def test_repair_in_many_small_blocks(spark, table, conversations, monkeypatch):
    """A long conversation goes through several levels of blocks; the result is that of one block."""
    monkeypatch.setattr(blocks, "BLOCK", 8)
    some = table.where("conv_id IN (3, 101, 102)")
    found = {r["conv_id"]: r for r in repair.repair_digest(some, repair.repair_conversations(some)).collect()}
    for c, own in by_conversation(conversations).items():
        if c in found:
            assert (found[c]["cost"], found[c]["audit"]) == cheapest(faults_of(own))[:2]


def test_nothing_to_repair(spark, table):
    nothing = table.where("false")
    assert repair.repair_digest(nothing, repair.repair_conversations(nothing)).count() == 0
    dropped = repair.repair_digest(table.where("conv_id < 5"), repair.repair_conversations(nothing)).collect()
    assert {(r["cost"], r["audit"], r["repaired_sha256"]) for r in dropped} == {(0, "", hashlib.sha256(b"").hexdigest())}


# ---- chat ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path(chat.TOKENIZER)


@pytest.mark.parametrize("text", ["", "</s>[INST] ok [/INST]", "<\\s> <\\\\|turn|> [\\INST] <<SYS>> <<s>", "a\nb\r\t \x00 東京 ü", "<|end|>" * 3, "\\<|text|>", "[[INST]]"])
def test_escapes_are_reversible(path, text):
    coder = chat.coder_of(path)
    ids, at, n = coder.encode(text, text)
    formatted = coder.decode(ids)
    assert formatted == chat.format_turn(text, text) and formatted.count("<|end|>") == 1
    role, body = chat.FORMATTED.fullmatch(formatted).groups()
    assert chat.unescape(role) == chat.unescape(body) == chat.unescape(coder.decode(ids[at : at + n])) == text


def in_order(own):
    return [(r or "", t or "") for _, r, t in sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))]


def test_tree_holds_each_beginning_once_and_reads_back(spark, table, conversations, path, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 64)
    monkeypatch.setattr(chat, "SHARED", 16)
    tree = chat.write_tree(table, path)
    wanted = {c: in_order(own) for c, own in by_conversation(conversations).items()}
    beginnings = {tuple(t[: k + 1]) if len(t) < 99 else (tuple(t[:3]), hashlib.sha256(repr(t[: k + 1]).encode()).digest()) for t in wanted.values() for k in range(len(t))}
    nodes = {(r["tail"], r["depth"]): r for r in tree.nodes.collect()}
    assert len(nodes) == len(beginnings)
    tails = {r["tail"]: r for r in tree.tails.collect()}

    # one stream without gaps; positions go on from the ancestors'; a token sees its conversation's tokens so far and nothing else
    flat, coder = {}, chat.coder_of(path)
    for r in nodes.values():
        for k, x in enumerate(r["tokens"]):
            assert flat.setdefault(r["offset"] + k, (x, r["position"] + k)) == (x, r["position"] + k)
    assert sorted(flat) == list(range(len(flat)))
    for r in tree.conversations.collect():
        tail, turns = tails[r["tail"]], wanted[r["conv_id"]]
        end = nodes[r["tail"], r["depth"]]
        seen = [i for span in [*tail["ancestors"], (tail["offset"], end["offset"] + len(end["tokens"]))] for i in range(*span)]
        assert [flat[i][1] for i in seen] == list(range(len(seen)))
        assert [flat[i][0] for i in seen] == [x for role, text in turns for x in coder.encode(role, text)[0]]
    # depth first: a tail's descendants follow it at once
    below = {}
    for t in tails.values():
        for span in t["ancestors"]:
            below.setdefault(span["start"], []).append((t["offset"], t["length"]))
    for t in tails.values():
        after = sorted(below.get(t["offset"], []))
        assert [a for a, _ in after] == list(itertools.accumulate((n for _, n in after[:-1]), initial=t["offset"] + t["length"]))[: len(after)]

    found = {r["conv_id"]: r for r in chat.read_tree(tree, path).collect()}
    assert set(found) == set(wanted)
    for c, turns in wanted.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        assert found[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (found[c]["n_turns"], found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(turns), len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert found[c]["formatted_chars"] == sum(len(chat.format_turn(r, t)) for r, t in turns)


def test_tree_of_nothing(table, path):
    assert chat.read_tree(chat.write_tree(table.where("false"), path), path).count() == 0


# ---- whitening -----------------------------------------------------------------------------------


def vectors(n=400, d=9, seed=2):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * np.linspace(0.3, 1.5, d) + rng.standard_normal(d)).astype(np.float32).tolist()


def dense(rows):
    x = np.array([[math.floor(256 * float(c)) for c in r] for r in rows], np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    e, w = np.linalg.eigh((fit - sums / n).T @ (fit - sums / n) / n)
    return x, n, sums, e[::-1], w[:, ::-1]


@pytest.mark.parametrize("d", [9, 3, 1, 80])
def test_whitening_equals_a_dense_solver(spark, d):
    rows = vectors(400, d)
    rows += [rows[0]] * 100
    bad = [(900, None), (901, [1.0, None] + [0.0] * (d - 2)) if d > 1 else (901, [None]), (902, [float("nan")] * d), (903, [float("inf")] * d), (904, []), (905, [1.0] * (d + 1)), (None, rows[1])]
    table = spark.createDataFrame([(i, r, 1) for i, r in [*enumerate(rows), *bad]], "vec_id long, embedding array<float>, x int").repartition(4)
    found = whitening.whiten(table).collect()
    rows.append(rows[1])
    x, n, sums, e, w = dense(rows)
    k = min(4, d)
    assert len(found) == k * len(rows) and {r["n"] for r in found} == {n}
    for c in range(k):
        want = (x - sums / n) @ w[:, c] / np.sqrt(e[c])
        mine = [r for r in found if r["component"] == c + 1]
        got = np.array([r["whitened"] for r in sorted(mine, key=lambda r: (r["vec_id"] is None, r["vec_id"]))])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
        assert all(abs(r["explained"] / (e[c] / e.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in mine)
        assert {r["vec_id"]: r["deviation"] for r in mine}[5] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[5], sums))


def test_whitening_with_equal_eigenvalues_and_dependent_dimensions(spark):
    corners = [[a, b, c, a + b, 7.0, a] for a in (0.0, 1.0) for b in (0.0, 1.0) for c in (0.0, 1.0)]
    found = whitening.whiten(spark.createDataFrame(list(enumerate(corners)), "vec_id long, embedding array<double>")).collect()
    _, n, _, e, _ = dense(corners)
    assert sorted({r["component"] for r in found}) == [1, 2, 3] and n == 8
    for k in (1, 2, 3):
        assert abs(next(r["explained"] for r in found if r["component"] == k) - e[k - 1] / e.sum()) < 1e-9
    assert max(r["identity_error"] for r in found) < 1e-9
    square = [[a, b] for a in (0.0, 1.0) for b in (0.0, 1.0)]
    found = whitening.whiten(spark.createDataFrame(list(enumerate(square)), "vec_id long, embedding array<double>")).collect()
    assert {round(r["explained"], 9) for r in found} == {0.5} and {r["component"] for r in found} == {1, 2}


def test_whitening_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).count() == 0
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, -0.0])], schema)).collect()
    assert {r["deviation"] for r in huge if r["vec_id"] == 1} == {None}
