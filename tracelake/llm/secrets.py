"""Secret scans by a trigram index.

Every rule's regex is parsed and turned into a Boolean query over trigrams (AND / OR) that any match
must satisfy. Each batch of documents is an index segment: postings (trigram -> rows) are built
for the trigrams that some query names, postings are intersected and united as the query says, and
only the candidate rows are verified with the regex. Rules without mandatory trigrams scan every row.

Trigrams are taken over bytes with A-Z lowered, so that one index serves case-blind rules. Where a rule is
case-blind beyond ASCII, letters with case partners outside it (i, k, s and all non-ASCII ones) bind no trigram.

Defined results: null text counts as empty; every row comes back with its spans (possibly none);
offsets are code points, end exclusive; repeated rows are scanned like any other; an empty table
stays empty; extra columns pass through, the result goes to the column ``name`` (default ``secrets``).
"""

from __future__ import annotations

import hashlib
import re
import re._constants as K
import re._parser as P
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import short_batches
from .textbytes import LOWER, utf8_list, utf8_views

#: Literal sets above this size, or longer than this, are turned into trigrams at once.
MOST_LITERALS, LONGEST_LITERAL = 24, 24


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a regex, a least length of ``group`` (0: the whole match)."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 1


#: A key runs to the END line of its label, short of another BEGIN line. Without that END it is the lines of base64 that
#: follow (line breaks may be escaped), the last of which may be short.
PRIVATE_KEY = (
    r"-----BEGIN ((?:[A-Z]+ )?)PRIVATE KEY-----"
    r"(?:(?:[^-]++|-(?!----(?:BEGIN |END \1PRIVATE KEY-----)))*+-----END \1PRIVATE KEY-----"
    r"|(?:(?:\s|\\[rn])*+(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+(?:(?:\s|\\[rn])*+[A-Za-z0-9+/=]{16,}+)*+"
    r"(?:[ \t]*(?:\r\n?|\n|\\r\\n|\\n)[ \t]*[A-Za-z0-9+/=]+(?=[ \t]*(?:[\r\n]|\\[rn]|\Z)))?)"
)

#: The base rules (fixed values), then those that this operator adds.
RULES = (
    Rule("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
    Rule("private_key", PRIVATE_KEY, 0, 1),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("forge_token", r"(?:ghp|gho|ghs|ghu)_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"(?:xoxa|xoxb|xoxp|xoxs)-[A-Za-z0-9-]+", 0, 15),
)
BASE_KINDS = ("assign", "access", "hex")


# ---- Boolean trigram queries -------------------------------------------------------------------
# A query is True (no condition), a trigram (bytes), ("and", frozenset) or ("or", frozenset).


def _both(op: str, parts) -> object:
    parts = set(parts)
    if op == "and":
        parts.discard(True)
    elif True in parts:
        return True
    if not parts:
        return True
    return parts.pop() if len(parts) == 1 else (op, frozenset(parts))


def trigrams_of(literals: set[bytes]) -> object:
    """A match holds one of these literals: OR over them of AND over their trigrams."""
    return _both("or", [_both("and", [x[i : i + 3] for i in range(len(x) - 2)]) for x in literals])


def _lowered(code: int) -> bytes:
    return chr(code).encode().translate(bytes(LOWER))


def _parse(items, flags: int) -> tuple[object, set[bytes] | None]:
    """(query, the exact lowered literals if these are few, else None) of a parsed sequence under ``flags``."""
    blind = bool(flags & re.I) and not flags & re.A
    query: object = True
    exact: set[bytes] = {b""}
    whole = True

    def flush() -> None:
        nonlocal query, exact, whole
        query, exact, whole = _both("and", [query, trigrams_of(exact)]), {b""}, False

    def open_letter(code: int) -> bool:
        """Python matches i, k and s with letters outside ASCII too if case doesn't count."""
        return blind and (code > 127 or chr(code) in "iksIKS")

    def append(literals: set[bytes]) -> None:
        nonlocal exact
        joined = {a + b for a in exact for b in literals}
        if len(joined) > MOST_LITERALS or max(map(len, joined)) > LONGEST_LITERAL:
            flush()
            joined = literals
        exact = joined

    for op, arg in items:
        if op is K.LITERAL and not open_letter(arg):
            append({_lowered(arg)})
        elif op is K.IN and all(o is K.LITERAL and not open_letter(a) for o, a in arg) and len(arg) <= 4:
            append({_lowered(a) for _, a in arg})
        elif op is K.SUBPATTERN:
            inner, literals = _parse(arg[3], (flags | arg[1]) & ~arg[2])
            query = _both("and", [query, inner])
            append(literals) if literals is not None else flush()
        elif op is K.BRANCH:
            found = [_parse(x, flags) for x in arg[1]]
            if all(x[1] is not None for x in found) and sum(len(x[1]) for x in found) <= MOST_LITERALS:
                append(set().union(*(x[1] for x in found)))
            else:
                flush()
                query = _both("and", [query, _both("or", [_both("and", [q, True if s is None else trigrams_of(s)]) for q, s in found])])
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, body = arg
            inner, literals = _parse(body, flags)
            if (low, high) == (0, 1) and literals is not None:
                append(literals | {b""})
            elif low == 0:
                flush()
            else:
                query = _both("and", [query, inner])
                if literals is not None and low == high and low <= 4:
                    for _ in range(low):
                        append(literals)
                else:
                    if literals is not None:
                        append(literals)
                    flush()
        elif op is K.AT:
            continue
        else:
            flush()
    if not whole:
        return _both("and", [query, trigrams_of(exact)]), None
    return query, exact


def trigram_query(pattern: str) -> object:
    """The Boolean trigram query that every match of ``pattern`` satisfies; True: scan all."""
    parsed = P.parse(pattern)
    query, literals = _parse(parsed, parsed.state.flags)
    return query if literals is None else _both("and", [query, trigrams_of(literals)])


def named_trigrams(query: object) -> set[bytes]:
    if query is True:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(named_trigrams, query[1]))


# ---- a segment: postings of one batch ----------------------------------------------------------


def postings(raw: np.ndarray, off: np.ndarray, wanted: list[bytes]) -> dict[bytes, np.ndarray]:
    """Rows (sorted, distinct) that hold each wanted trigram, over lowered bytes."""
    out = {t: np.zeros(0, np.int64) for t in wanted}
    if len(raw) < 3 or not wanted:
        return out
    low = LOWER[raw]
    last = {t[2] for t in wanted}
    is_last = np.zeros(256, bool)
    is_last[list(last)] = True
    first = np.zeros(256, bool)
    first[[t[0] for t in wanted]] = True
    at = np.flatnonzero(first[low[:-2]] & is_last[low[2:]])
    code = (low[at].astype(np.int32) << 16) | (low[at + 1].astype(np.int32) << 8) | low[at + 2]
    codes = np.array([int.from_bytes(t, "big") for t in wanted], np.int32)
    order = np.argsort(codes)
    spot = np.minimum(np.searchsorted(codes[order], code), len(codes) - 1)
    hit = codes[order][spot] == code
    at, which = at[hit], order[spot[hit]]
    row = np.searchsorted(off, at, side="right") - 1
    inside = at + 3 <= off[row + 1]
    row, which = row[inside], which[inside]
    for k in np.unique(which).tolist():
        out[wanted[k]] = np.unique(row[which == k])
    return out


def matching_rows(query: object, lists: dict[bytes, np.ndarray]) -> np.ndarray | None:
    """Rows that satisfy a query; None: every row."""
    if query is True:
        return None
    if isinstance(query, bytes):
        return lists[query]
    parts = sorted((matching_rows(q, lists) for q in query[1]), key=len)
    rows = parts[0]
    for p in parts[1:]:
        rows = np.intersect1d(rows, p, assume_unique=True) if query[0] == "and" else np.union1d(rows, p)
    return rows


def find_spans(text: str, rule: Rule, compiled: re.Pattern) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches whose group is long enough."""
    return [m.span() for m in compiled.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.at_least]


def faster(rule: Rule) -> re.Pattern:
    """One greedy class without context may ask for its least length at once: its runs are maximal."""
    single = re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern)
    return re.compile(f"{single[1]}{{{rule.at_least},}}" if single and rule.group == 0 else rule.pattern)


def scanner(rules: tuple[Rule, ...]):
    """A function: array of texts -> (texts of the rows with spans, spans of each row as (start, rule, end))."""
    queries = [trigram_query(r.pattern) for r in rules]
    wanted = sorted(set().union(*map(named_trigrams, queries)))

    def scan(texts: pa.Array) -> tuple[dict[int, str], list[list[tuple[int, int, int]]]]:
        raw, off = utf8_views(texts)
        lists = postings(raw, off, wanted)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        whole: dict[int, str] = {}
        raws = utf8_list(texts)
        for k, (rule, query) in enumerate(zip(rules, queries)):
            compiled = faster(rule)
            rows = matching_rows(query, lists)
            for i in range(len(texts)) if rows is None else rows.tolist():
                if i not in whole:
                    whole[i] = raws[i].decode("utf-8", "replace")
                found[i] += [(a, k, b) for a, b in find_spans(whole[i], rule, compiled)]
        return whole, [sorted(x) for x in found]

    return scan


def secrets_udf(rules: tuple[Rule, ...]):
    """Arrow UDF: text -> array<struct<kind, start, end>> ordered by start, then the rules' order."""
    scan = scanner(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in scan(texts)[1]], kind)

    return spans


def mask_udf(rules: tuple[Rule, ...] = RULES, mask: str = "[secret]"):
    """Arrow UDF: text -> text with every secret replaced, found and masked in one visit."""
    scan = scanner(rules)

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        whole, found = scan(texts)
        rows = [i for i, x in enumerate(found) if x]
        if not rows:
            return texts
        changed = pa.array([redacted_text(whole[i], [{"start": a, "end": b} for a, _, b in found[i]], mask) for i in rows], texts.type)
        chosen = np.zeros(len(texts), bool)
        chosen[rows] = True
        return pc.replace_with_mask(texts, pa.array(chosen), changed)

    return masked


def scan_secrets(documents: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", name: str = "secrets") -> DataFrame:
    """``documents`` with a column of all secret spans."""
    return short_batches(documents).withColumn(name, secrets_udf(tuple(rules))(F.col(text)))


def as_listing(spans: Column) -> Column:
    """kind:start:end, comma-joined in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted_text(text: str | None, spans: list, mask: str = "[secret]") -> str | None:
    """``text`` with every span replaced by ``mask`` (overlapping spans are merged)."""
    if text is None or not spans:
        return text
    out, at, end = [], 0, -1
    for s in sorted((x["start"], x["end"]) for x in spans):
        if s[0] >= end:
            out += [text[at : s[0]], mask]
        end = max(end, s[1])
        at = end
    return "".join([*out, text[at:]])


def secret_digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of base spans, and the listing of all spans."""
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return scanned.select("doc_id", *map(count, BASE_KINDS), F.sha2(as_listing(base), 256).alias("base_sha256"), as_listing(F.col("secrets")).alias("spans"))


def brute_force(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int]]:
    """All spans by scanning with every rule (for tests)."""
    found = [(m.start(), k, m.end()) for k, r in enumerate(rules) for m in re.finditer(r.pattern, text or "") if len(m.group(r.group)) >= r.at_least]
    return [(rules[k].kind, a, b) for a, k, b in sorted(found)]


def listing_sha(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
