"""Chat formatting as a prefix tree: turns that conversations share from their beginning are written once.

A turn becomes ``<|turn|>role<|text|>text<|end|>``; its tokens are those of role and text, between three control ids above the vocabulary. Control strings in
roles and texts (this template's and other common ones) get a backslash behind their first character, one more if they have some
already, so escaping is reversible and no text can pose as a turn. The loss mask covers the text of assistant turns.

A node of the tree is a sequence of first turns, known by a polynomial hash modulo 2**127 - 1 (two different ones among 10**12 have equal hashes with
a chance of some 10**-14). The first conversation that has a node owns it; since its later nodes are new too, a
conversation owns one *tail* of its turns, or none, and the tree hangs tails on tails. Written depth first - a tail whole, then the tails that hang on it, deepest
first - tails are sorted by their paths, arrays of (minus first depth, owner). A conversation of n turns takes n rows, so a path
of k tails needs k(k+1)/2 rows that share turns: no path has more than the square root of twice the rows. Nothing else is gathered
in one place: turns are hashed in blocks (``blocks``), turns that many conversations share are joined by frequency or salted, and the stream's offsets are sums
over partitions.

``write_tree`` gives the tables: nodes (tokens, position id of the first token, offset in the stream, loss span), tails (offset, length, position id,
ancestors' intervals of the stream that all its tokens attend to, beside those before them in the tail) and conversations (their tail and last depth).
``read_tree`` follows these back to each conversation's text.

Defined results: a null role or text counts as empty; null turns come first, rows of one turn are in the order of role and text; null ids are one conversation; repeated rows
are turns of their own; texts of any length stay whole (one task tokenises a text); an empty table gives empty tables; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .scratch import join_frequent, stored

# ---- template ------------------------------------------------------------------------------------

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Strings that a text may not bring in as they stand.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_LATER = {first: "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == first) for first in "<["}
ESCAPE = re.compile("|".join(rf"(?<=\{first})(\\*)(?=(?:{later}))" for first, later in _LATER.items()))
UNESCAPE = re.compile("|".join(rf"(?<=\{first})\\(?=\\*(?:{later}))" for first, later in _LATER.items()))
FORMATTED = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.DOTALL)
LEARNED = "assistant"
TOKENIZER = "byte_bpe_50k.json"
SHARED = 512  # conversations a copy of a node serves when they are read back


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: "\\" + (m[1] or m[2] or ""), text)


def unescape(text: str) -> str:
    return UNESCAPE.sub("", text)


def format_turn(role: str, text: str) -> str:
    return TURN + escape(role) + TEXT + escape(text) + END


class Coder:
    """Ids of formatted turns and back. Control ids follow the vocabulary's."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.marks = {size: TURN, size + 1: TEXT, size + 2: END}
        self.turn, self.text, self.end = self.marks

    def encode(self, role: str, text: str) -> tuple[list[int], int, int]:
        """(ids, where the ids of the text begin, how many they are)."""
        head = [self.turn, *self.tokenizer.encode(escape(role), add_special_tokens=False).ids, self.text]
        body = self.tokenizer.encode(escape(text), add_special_tokens=False).ids
        return [*head, *body, self.end], len(head), len(body)

    def decode(self, ids: list[int]) -> str:
        """The formatted string of ids."""
        out, begun = [], 0
        for i, x in enumerate(ids):
            if x in self.marks:
                out += [self.tokenizer.decode(ids[begun:i], skip_special_tokens=False) if i > begun else "", self.marks[x]]
                begun = i + 1
        return "".join([*out, self.tokenizer.decode(ids[begun:], skip_special_tokens=False) if begun < len(ids) else ""])


_CODERS: dict[str, Coder] = {}


def coder_of(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


# ---- hashes of first turns -------------------------------------------------------------------------

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"first turns").digest()[:15], "big") | 1


def turn_hash(role: str, text: str) -> int:
    data = role.encode()
    return int.from_bytes(hashlib.sha256(len(data).to_bytes(8, "big") + data + text.encode()).digest()[:15], "big") + 1


def joined(first: tuple[int, int, int], then: tuple[int, int, int]) -> tuple[int, int, int]:
    """(turns, hash, tokens) of one sequence of turns after another."""
    return first[0] + then[0], (first[1] * pow(BASE, then[0], PRIME) + then[1]) % PRIME, first[2] + then[2]


def _told(values: tuple[int, int, int]) -> str:
    return json.dumps([values[0], f"{values[1]:032x}", values[2]])


def _values(text: str) -> tuple[int, int, int]:
    n, value, tokens = json.loads(text)
    return n, int(value, 16), tokens


def _combine(summaries: list[str]) -> str:
    now = (0, 0, 0)
    for s in summaries:
        now = joined(now, _values(s))
    return _told(now)


def _root(summary: str) -> str:
    return _told((0, 0, 0))


def _push(context: str, summaries: list[str]) -> list[str]:
    out, now = [], _values(context)
    for s in summaries:
        out.append(_told(now))
        now = joined(now, _values(s))
    return out


@F.udf(T.StringType(), useArrow=True)
def _node(context: str, summary: str) -> str:
    return _told(joined(_values(context), _values(summary)))


def tokenised(rows: DataFrame, path: str) -> DataFrame:
    """Every turn with its tokens, loss span, and (turns, hash, tokens) of its run up to it."""

    def each(group):
        coder, now = coder_of(path), (0, 0, 0)
        last = None
        for r in group:
            if last:
                yield last
            ids, at, n = coder.encode(r["role"], r["text"])
            now = joined(now, (1, turn_hash(r["role"], r["text"]), len(ids)))
            last = {"grp": r["grp"], "block": r["block"], "seq": r["seq"], "summary": _told(now), "last": False, "size": len(ids), "loss_at": at, "loss_n": n if r["role"] == LEARNED else 0, "tokens": ids}
        yield last | {"last": True}

    schema = f"grp {dict(rows.dtypes)['grp']}, block long, seq long, summary string, last boolean, size long, loss_at int, loss_n int, tokens array<int>"
    return blocks.streamed(rows, ["grp", "block"], ["seq"], each, schema)


# ---- the tree --------------------------------------------------------------------------------------


@dataclass
class Tree:
    nodes: DataFrame  # tail, depth, shared (conversations that have it), position, offset, tokens, loss_at, loss_n
    tails: DataFrame  # tail, tree, depth (of its first turn), position, offset, length, ancestors array<struct<start,end>>
    conversations: DataFrame  # conv_id, base, tail, depth
    turns: DataFrame  # base, depth, tail, shared


def write_tree(conversations: DataFrame, path: str) -> Tree:
    """The prefix tree of all conversations (conv_id, turn, role, text)."""
    plain = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = blocks.numbered(plain, ["conv_id", "turn", "role", "text"], "chat-sorted").withColumnRenamed("conv_id", "grp").withColumn("block", blocks.block_of(F.col("seq")))
    wide = stored(tokenised(rows, path), "chat-tokens")
    told = blocks.contexts(wide.where("last").select("grp", "block", "summary"), _combine, _root, _push, "chat").select(F.col("grp").alias("_grp"), F.col("block").alias("_block"), "context")
    whole = wide.drop("tokens").join(told, wide["grp"].eqNullSafe(told["_grp"]) & (wide["block"] == told["_block"])).withColumn("found", F.from_json(_node("context", "summary"), "array<string>"))
    depth = F.col("found")[0].cast("long")
    steps = stored(whole.select("grp", "seq", "size", depth.alias("depth"), (F.col("seq") - depth + 1).alias("base"), F.col("found")[1].alias("node"), (F.col("found")[2].cast("long") - F.col("size")).alias("position")), "chat-steps")

    # the first conversation with a node owns it; numbers are dense, so its own first row is known from the node's depth
    firsts = stored(steps.groupBy("node").agg(F.min("seq").alias("first"), F.count("*").alias("shared")), "chat-nodes")
    owned = join_frequent(steps.drop("grp"), firsts.withColumn("n", F.col("shared")), "node", "n")
    turns = stored(owned.select("base", "seq", "depth", "position", "size", "shared", (F.col("first") - F.col("depth") + 1).alias("tail")), "chat-turns")

    paths = stored(turns.groupBy("base", "tail").agg(F.min("depth").alias("first_depth"), F.max("depth").alias("last_depth"), F.sum("size").alias("units"), F.min("position").alias("position")), "chat-paths")
    place = F.struct((-F.col("first_depth")).alias("minus"), "tail")
    keys = paths.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("first_depth", place.alias("place")))).alias("path"), F.max("tail").alias("tail")).where("base = tail")
    own = paths.where("base = tail").select(F.col("tail").alias("_tail"), "first_depth", "position", F.col("units").alias("length"))
    sized = keys.join(own, keys["base"] == own["_tail"]).select("tail", F.transform("path", lambda p: p["place"]).alias("key"), "first_depth", "position", "length")
    placed = stored(blocks.summed(sized, ["key"], "length", "chat-order").select("tail", F.col("key")[0]["tail"].alias("tree"), "first_depth", "position", F.col("before").alias("offset"), "length"), "chat-tails")

    # where each tail of a path stands in the stream
    used = paths.groupBy("tail").agg(F.count("*").alias("n"))
    spots = placed.select("tail", "offset").join(used, "tail")
    above = join_frequent(paths.where("tail < base").select("base", "tail", "first_depth", "units"), spots, "tail", "n")
    spans = F.array_sort(F.collect_list(F.struct("first_depth", F.col("offset").alias("start"), (F.col("offset") + F.col("units")).alias("end"))))
    ancestors = above.groupBy("base").agg(spans.alias("spans")).select(F.col("base").alias("_base"), F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("ancestors"))
    none = F.array().cast("array<struct<start: bigint, end: bigint>>")
    tails = placed.join(ancestors, placed["tail"] == ancestors["_base"], "left").select("tail", "tree", F.col("first_depth").alias("depth"), "position", "offset", "length", F.coalesce("ancestors", none).alias("ancestors"))

    begun = placed.select("tail", F.col("position").alias("_begun"), F.col("offset").alias("_offset"))
    new = turns.where("base = tail").join(begun, "tail").select("tail", "seq", "depth", "shared", "position", (F.col("_offset") + F.col("position") - F.col("_begun")).alias("offset"))
    nodes = new.join(wide.select("seq", "tokens", "loss_at", "loss_n"), "seq").drop("seq")
    last = paths.groupBy("base").agg(F.max(F.struct("first_depth", "tail", "last_depth")).alias("leaf"))
    ids = steps.where("depth = 1").select(F.col("grp").alias("conv_id"), F.col("base").alias("_base"))
    index = ids.join(last, ids["_base"] == last["base"]).select("conv_id", "base", F.col("leaf.tail").alias("tail"), F.col("leaf.last_depth").alias("depth"))
    return Tree(stored(nodes, "chat-stream"), tails, stored(index, "chat-index"), turns.select("base", "depth", "tail", "shared"))


def read_tree(tree: Tree, path: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the tokens and loss spans in the tree.

    Conversations with equal turns are read once. A node is read by up to ``SHARED`` conversations from each of its copies.
    """
    leaf = F.concat_ws(":", "tail", "depth")
    index = tree.conversations.withColumn("leaf", leaf)
    leaves = stored(index.groupBy("leaf").agg(F.min("base").alias("reader"), F.count("*").alias("n")), "chat-leaves")
    copies = F.floor((F.col("shared") - 1) / SHARED).cast("long") + 1
    read = tree.turns.join(leaves.select(F.col("reader").alias("base")), "base", "left_semi").select("base", "depth", "tail", F.pmod(F.xxhash64("base"), copies).alias("copy"))
    nodes = tree.nodes.select("tail", "depth", "tokens", "loss_at", "loss_n", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)).alias("copy"))
    found = nodes.join(read, ["tail", "depth", "copy"])

    def each(group):
        coder, turns, loss = coder_of(path), hashlib.sha256(), hashlib.sha256()
        base, n, learned, chars = None, 0, 0, 0
        for r in group:
            base, ids = r["base"], r["tokens"]
            formatted = coder.decode(ids)
            role, text = FORMATTED.fullmatch(formatted).groups()
            turns.update((unescape(role) + "\n" + unescape(text) + "\n").encode())
            if r["loss_n"]:
                part = unescape(coder.decode(ids[r["loss_at"] : r["loss_at"] + r["loss_n"]]))
                loss.update(part.encode())
                learned += len(part)
            n, chars = n + 1, chars + len(formatted)
        yield {"reader": base, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": learned, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}

    kept = blocks.streamed(found.select("base", "depth", "tokens", "loss_at", "loss_n"), ["base"], ["depth"], each, "reader long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    digests = stored(leaves.join(kept, "reader").drop("reader"), "chat-digests")
    return join_frequent(index.select("conv_id", "leaf"), digests, "leaf", "n").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
