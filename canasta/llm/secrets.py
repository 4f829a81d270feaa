"""Secret scan with one combined deterministic automaton.

Each rule is a head (any regular expression), then a run of at least one character of a tail class; a match is kept when the run
has `least` characters. The rules are compiled by subset construction (threads in order of their start, so that a match is the
leftmost one and the next begins after its end), combined as a product and minimised into one transition array over byte
classes. The scan reads every byte once for all rules: a batch of texts is one byte stream, cut into lanes that numpy advances
together; a lane that did not begin in the state in which the one before it ended is repeated from there until both agree.
"""

from __future__ import annotations

import re._constants as sre
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canasta.llm.batches import groups, map_arrow, texts_of

END = 0xFF            # never occurs in UTF-8; stands between the texts of a stream
STREAM_BYTES = 4 << 20
LANE_BYTES = 512


@dataclass(frozen=True)
class Rule:
    kind: str
    head: str
    tail: str
    least: int


# The base rules.
RULES = (Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]", 6),
         Rule("access", r"AKIA", r"[A-Z0-9]", 16),
         Rule("hex", r"", r"[0-9a-f]", 24))


class _Nfa:
    """Thompson automaton: `moves[q]` = (bytes, next) or None, `free[q]` = states reached without reading, best first."""

    def __init__(self) -> None:
        self.moves: list[tuple[frozenset[int], int] | None] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.moves.append(None)
        self.free.append([])
        return len(self.moves) - 1

    def read(self, begin: int, chars: frozenset[int]) -> int:
        end = self.state()
        self.moves[begin] = (chars, end)
        return end

    def add(self, tree, begin: int, fold: bool = False) -> int:
        for kind, arg in tree:
            here = self.state()
            self.free[begin].append(here)
            if kind in (sre.LITERAL, sre.IN):
                begin = self.read(here, _bytes([(kind, arg)] if kind is sre.LITERAL else arg, fold))
            elif kind is sre.SUBPATTERN:
                begin = self.add(arg[3], here, fold or bool(arg[1] & sre.SRE_FLAG_IGNORECASE))
            elif kind is sre.BRANCH:
                begin = self.state()
                for option in arg[1]:
                    first = self.state()
                    self.free[here].append(first)
                    self.free[self.add(option, first, fold)].append(begin)
            elif kind is sre.MAX_REPEAT:
                low, high, body = arg
                for _ in range(low):
                    here = self.add(body, here, fold)
                begin = self.state()
                if high is sre.MAXREPEAT:
                    first = self.state()
                    self.free[here] += [first, begin]
                    self.free[self.add(body, first, fold)] += [first, begin]
                else:
                    for _ in range(high - low):
                        first = self.state()
                        self.free[here] += [first, begin]
                        here = self.add(body, first, fold)
                    self.free[here].append(begin)
            else:
                raise ValueError(f"not supported in a rule: {kind}")
        return begin

    def reach(self, begin: int) -> list[int]:
        seen, todo = [], [begin]
        while todo:
            q = todo.pop()
            if q not in seen:
                seen.append(q)
                todo += reversed(self.free[q])
        return seen


def _bytes(items, fold: bool) -> frozenset[int]:
    chars: set[int] = set()
    negated = False
    for kind, arg in items:
        if kind is sre.LITERAL:
            chars.add(arg)
        elif kind is sre.RANGE:
            chars.update(range(arg[0], arg[1] + 1))
        elif kind is sre.NEGATE:
            negated = True
        else:
            raise ValueError(f"not supported in a rule: {kind}")
    if negated or max(chars) > 127:
        raise ValueError("rules hold ASCII characters and no negated classes")
    if fold:
        chars |= {c ^ 32 for c in chars if chr(c).isalpha()}
    return frozenset(chars)


class _RuleMachine:
    """Deterministic automaton of one rule. Labels: 0 no match is running, 1 one that is too short yet, 2 one to keep."""

    def __init__(self, rule: Rule) -> None:
        nfa = _Nfa()
        first = nfa.state()
        body = nfa.add(_parser.parse(rule.head), first)
        tail = _parser.parse(rule.tail)
        if len(tail) != 1 or rule.least < 1:
            raise ValueError("the tail is one character class, of at least one character")
        chars = _bytes(tail[0][1] if tail[0][0] is sre.IN else [tail[0]], False)
        label = {}
        for i in range(rule.least):
            body = nfa.read(body, chars)
            label[body] = 1 + (i + 1 == rule.least)
        nfa.moves[body] = (chars, body)
        threads = lambda q: [x for x in nfa.reach(q) if nfa.moves[x]]
        begin = threads(first)

        def step(state: tuple[int, ...], byte: int) -> tuple[tuple[int, ...], int]:
            out: list[int] = []
            for q in state:
                read, to = nfa.moves[q]
                if byte in read:
                    if to in label:
                        if out:
                            raise ValueError(f"rule {rule.kind}: a later start may end before an earlier one")
                        return (to,), label[to]
                    out += [x for x in threads(to) if x not in out]
            if state[0] in label:              # the match has ended; this byte may begin the next
                return step(tuple(begin), byte)
            return tuple(out + [x for x in begin if x not in out]), 0

        self.index = {(tuple(begin), 0): 0}
        self.table, self.labels, todo = [], [0], [(tuple(begin), 0)]
        while todo:
            state, _ = todo.pop(0)
            row = []
            for byte in range(256):
                to = step(state, byte)
                if to not in self.index:
                    self.index[to] = len(self.index)
                    self.labels.append(to[1])
                    todo.append(to)
                row.append(self.index[to])
            self.table.append(row)
        self.back = _backward(rule.head)


def _backward(head: str):
    """Automaton of the head read from its end, as (table of dicts, accepting states); None for an empty head."""
    if not head:
        return None
    nfa = _Nfa()
    first = nfa.state()
    last = nfa.add(_parser.parse(head), first)
    into: dict[int, list[tuple[frozenset[int], int]]] = {}
    freely: dict[int, list[int]] = {}
    for q, move in enumerate(nfa.moves):
        if move:
            into.setdefault(move[1], []).append((move[0], q))
        for to in nfa.free[q]:
            freely.setdefault(to, []).append(q)

    def closed(states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for p in freely.get(todo.pop(), []):
                if p not in states:
                    states.add(p)
                    todo.append(p)
        return frozenset(states)

    begin = closed({last})
    index, table, todo = {begin: 0}, [], [begin]
    while todo:
        state, row = todo.pop(0), {}
        for byte in range(128):
            to = closed({p for q in state for chars, p in into.get(q, []) if byte in chars})
            if to:
                if to not in index:
                    index[to] = len(index)
                    todo.append(to)
                row[byte] = index[to]
        table.append(row)
    return table, {i for state, i in index.items() if first in state}


@dataclass(frozen=True)
class Machine:
    kinds: tuple[str, ...]
    classes: np.ndarray        # byte -> class
    width: int                 # number of classes
    table: np.ndarray          # state * width + class -> state * width
    running: np.ndarray        # state * width -> bits of the rules with a match running there
    kept: np.ndarray           # state * width -> bits of the rules whose running match is long enough
    back: tuple


@lru_cache(maxsize=8)
def compile_rules(rules: tuple[Rule, ...]) -> Machine:
    """One minimal automaton for all rules (at most eight)."""
    if not 1 <= len(rules) <= 8:
        raise ValueError("one to eight rules")
    parts = [_RuleMachine(r) for r in rules]
    columns = np.vstack([np.array(p.table) for p in parts])
    _, classes = np.unique(columns, axis=1, return_inverse=True)
    classes = classes.ravel().astype(np.uint8)
    samples = [int(np.flatnonzero(classes == c)[0]) for c in range(int(classes.max()) + 1)]
    index, rows, order = {(0,) * len(parts): 0}, [], [(0,) * len(parts)]
    for state in order:
        row = []
        for byte in samples:
            to = tuple(p.table[q][byte] for p, q in zip(parts, state))
            if to not in index:
                index[to] = len(index)
                order.append(to)
            row.append(index[to])
        rows.append(row)
    table = np.array(rows)
    labels = np.array([[p.labels[q] for p, q in zip(parts, state)] for state in order])
    _, block = np.unique(labels, axis=0, return_inverse=True)
    block = block.ravel()
    while True:                                # refine until no block can be told apart further
        _, finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == block.max():
            break
        block = finer
    start = block[0]                           # the start state becomes number 0
    block = np.where(block == start, 0, np.where(block == 0, start, block))
    width, n = len(samples), int(block.max()) + 1
    small, marks = np.zeros((n, width), np.int32), np.zeros((n, len(parts)), np.int64)
    small[block], marks[block] = block[table] * width, labels
    bits = 1 << np.arange(len(parts))
    spread = lambda v: np.repeat(v.astype(np.uint8), width)
    return Machine(tuple(r.kind for r in rules), classes, width, small.ravel(), spread(((marks > 0) * bits).sum(1)),
                   spread(((marks == 2) * bits).sum(1)), tuple(p.back for p in parts))


def _states(machine: Machine, stream: np.ndarray) -> np.ndarray:
    """State after each byte, as (step, lane); byte p lies at (p % steps, p // steps)."""
    lanes = max(1, len(stream) // LANE_BYTES)
    steps = -(-len(stream) // lanes)
    x = np.full(lanes * steps, machine.classes[END], np.uint8)
    x[:len(stream)] = machine.classes[stream]
    x = np.ascontiguousarray(x.reshape(lanes, steps).T)
    out = np.empty((steps, lanes), np.int32)
    state = np.zeros(lanes, np.int32)
    for t in range(steps):
        state = machine.table[state + x[t]]
        out[t] = state
    began = np.zeros(lanes, np.int32)
    while True:
        right = np.concatenate([began[:1], out[-1, :-1]])
        lane = np.flatnonzero(right != began)
        if not len(lane):
            return out
        began = right
        state = right[lane]
        for t in range(steps):
            state = machine.table[state + x[t, lane]]
            new = state != out[t, lane]
            if not new.all():
                lane, state = lane[new], state[new]
                if not len(lane):
                    break
            out[t, lane] = state


def scan_texts(machine: Machine, texts: Sequence[bytes]) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
    """(text, [(start, end, rule)]) in code points for each text with a kept match, spans by start and rule."""
    for a, b in groups([len(t) for t in texts], STREAM_BYTES):
        begins = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
        stream = np.frombuffer(bytes([END]).join([*texts[a:b], b""]), np.uint8)
        states = _states(machine, stream)
        steps = len(states)
        kept = np.ascontiguousarray(machine.kept[states].T).ravel()
        places = np.flatnonzero(kept)
        ends: list[tuple[int, int]] = []
        for k in range(len(machine.kinds)):
            own = places[(kept[places] >> k) & 1 == 1]
            ends += [(int(p) + 1, k) for p in own[np.append(np.diff(own) > 1, True)]] if len(own) else []
        found: dict[int, list[tuple[int, int, int]]] = {}
        for end, k in ends:
            running = lambda p: machine.running[states[p % steps, p // steps]] >> k & 1
            begin = end - 1
            while begin > 0 and running(begin - 1):
                begin -= 1
            if machine.back[k]:
                table, last = machine.back[k]
                q, p = 0, begin
                while p > 0 and (q := table[q].get(int(stream[p - 1]), -1)) >= 0 and not running(p - 1):
                    p -= 1
                    if q in last:
                        begin = p
            i = int(np.searchsorted(begins, begin, "right")) - 1
            found.setdefault(i, []).append((begin - int(begins[i]), end - int(begins[i]), k))
        for i in sorted(found):
            raw = np.frombuffer(texts[a + i], np.uint8)
            points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
            yield a + i, sorted((int(points[s]), int(points[e]), k) for s, e, k in found[i])


SPANS = "array<struct<kind:string,start:int,end:int>>"


def _scanned(batches, text: int, rules: tuple[Rule, ...], spans: pa.DataType):
    machine = compile_rules(rules)
    for batch in batches:
        rows: list = [[]] * batch.num_rows
        for i, found in scan_texts(machine, texts_of(batch.column(text))):
            rows[i] = [{"kind": machine.kinds[k], "start": s, "end": e} for s, e, k in found]
        yield batch, pa.array(rows, spans)


_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row (id, spans) per row of `docs`, repeated rows and null ids included, in no order.

    `spans` are the kept matches in code points, end exclusive, by start and then rule. Null and empty texts have none. A text of
    any length is scanned whole. Other columns of `docs` are not read.
    """
    source = docs.select(F.col(id_column), F.col(text_column))

    def run(batches):
        for batch, spans in _scanned(batches, 1, rules, _ARROW_SPANS):
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], [id_column, "spans"])

    kind = source.schema[id_column].dataType.simpleString()
    return map_arrow(source, run, f"`{id_column}` {kind}, spans {SPANS}")


def redact_secrets(docs: DataFrame, text_column: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[{}]") -> DataFrame:
    """`docs` with every kept match replaced by its kind in brackets; overlapping matches are replaced together, by the first
    one's kind. All columns and rows stay, null texts stay null and texts without a match stay as they are."""
    at = docs.columns.index(text_column)

    def run(batches):
        for batch, spans in _scanned(batches, at, rules, _ARROW_SPANS):
            texts = batch.column(at).to_pylist()
            for i, found in enumerate(spans.to_pylist()):
                if found:
                    out, done = [], 0
                    for s in found:
                        if s["start"] >= done:
                            out += [texts[i][done:s["start"]], mark.format(s["kind"])]
                        done = max(done, s["end"])
                    texts[i] = "".join([*out, texts[i][done:]])
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return map_arrow(docs, run, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """Counts per base rule, digest of the base spans and all spans as text."""
    found = scan_secrets(docs)

    def of(kinds: Sequence[str]) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    def written(spans: Column) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))

    base = [r.kind for r in RULES]
    return found.select("doc_id", *[F.size(of([k])).cast("long").alias(f"n_{k}") for k in base],
                        F.sha2(written(of(base)).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def _either_case(words: Sequence[str]) -> str:
    return "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in words)


_WORDS = _either_case(["password", "passwd", "secret", "token"]) + "|" + _either_case(["api"]) + "_?" + _either_case(["key"])
_PATTERNS = {"assign": rf"(?:{_WORDS})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
_KEPT = {"assign": f"length(regexp_extract(p, '{_PATTERNS['assign']}', 1)) >= 6", "access": "length(p) >= 20", "hex": "length(p) >= 24"}
_PIECES = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS kind, {i} AS place, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM "
    f"(SELECT doc_id, regexp_extract_all(t, '(?s)(?:{pattern}|.)') AS ps FROM d WHERE regexp_matches(t, '{pattern}'))"
    for i, (kind, pattern) in enumerate(_PATTERNS.items()))
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pieces AS (SELECT *, sum(length(p)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS e FROM ({_PIECES})),
spans AS (SELECT doc_id, kind, place, CAST(e - length(p) AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM pieces
          WHERE {' OR '.join(f"(kind = '{k}' AND length(p) > 1 AND {v})" for k, v in _KEPT.items())}),
found AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h,
          string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, place) AS s FROM spans GROUP BY 1)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans
FROM d LEFT JOIN found USING (doc_id)"""
