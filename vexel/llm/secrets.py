"""Secret scan over a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: a match must hold the trigrams of some
string of each set of strings that the expression cannot do without. A segment (a run of documents) is indexed by
postings, trigram to documents; a query intersects and unites postings, and the rule's expression verifies the
candidates. A rule without mandatory trigrams (runs of hexadecimal digits, say) scans all texts.

Segments are indexed where they are read: nothing is shuffled, memory is bounded by a segment, and a lost task redoes
its own segments alone. Trigrams are of lower-cased bytes, and only those that a rule asks for are posted.

Nulls count as empty and give no spans; repeated rows are each reported; further columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser as regex

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.llm.common import Points, raw, runs

#: Strings that a piece of an expression may stand for, before it is given up as anything.
SPELLINGS = 64


@dataclass(frozen=True)
class Rule:
    """group/least: that group of a match has so many characters at least, else the match does not count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The kinds of the contract, in its order.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
)
#: Further kinds that the scan adds.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH |)PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
)

ANY = ("any",)


def _all(parts: list) -> tuple:
    parts = [p for p in parts if p != ANY]
    return ANY if not parts else parts[0] if len(parts) == 1 else ("all", *parts)


def _one(parts: list) -> tuple:
    return ANY if not parts or ANY in parts else parts[0] if len(parts) == 1 else ("one", *parts)


def _spelled(strings: set[str]) -> tuple:
    """What a match must hold if it holds one of these strings."""
    return _one([_all([("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(nodes) -> tuple[set[str] | None, tuple]:
    """The strings that a sequence stands for, if few; what its matches must hold."""
    run, needs, exact = {""}, [], True

    def broken():
        nonlocal run, exact
        needs.append(_spelled(run))
        run, exact = {""}, False

    for kind, arg in nodes:
        spells, need = None, ANY
        if kind is op.LITERAL:
            spells = {chr(arg).lower()}
        elif kind is op.IN:
            spells = set() if arg[0][0] is not op.NEGATE else None
            for what, x in arg:
                if spells is None or what is op.CATEGORY or what is op.RANGE and x[1] - x[0] > 16:
                    spells = None
                    break
                spells |= {chr(x).lower()} if what is op.LITERAL else {chr(c).lower() for c in range(x[0], x[1] + 1)}
        elif kind is op.SUBPATTERN:
            spells, need = _walk(arg[3])
        elif kind is op.BRANCH:
            made = [_walk(x) for x in arg[1]]
            spells = set().union(*(m[0] for m in made)) if all(m[0] is not None for m in made) else None
            need = _one([m[1] for m in made])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, body = arg
            inner, must = _walk(body)
            need = must if least else ANY
            if inner is not None and most == 1:
                spells = inner | ({""} if not least else set())
            elif inner is not None and least == most and len(inner) ** least <= SPELLINGS:
                spells = {"".join(p) for p in product(inner, repeat=least)}
        elif kind is op.AT:
            spells = {""}
        if spells is not None and len(run) * len(spells) <= SPELLINGS:
            run = {a + b for a in run for b in spells}
        else:
            broken()
            needs.append(need if need != ANY or spells is None else _spelled(spells))
    whole = run if exact else None
    return whole, _all([*needs, _spelled(run)])


def trigram_query(pattern: str) -> tuple:
    """("any",), ("tri", t), ("all", ...) or ("one", ...)."""
    return _walk(regex.parse(pattern))[1]


def asked(query: tuple) -> set[str]:
    return {query[1]} if query[0] == "tri" else set() if query == ANY else set().union(*map(asked, query[1:]))


def _code(t: str) -> int:
    a, b, c = t.encode()
    return a << 16 | b << 8 | c


class Segment:
    """Postings of the asked trigrams over a run of texts: trigram to sorted document numbers."""

    def __init__(self, texts: list[bytes], table: np.ndarray, trigrams: list[str]):
        self.n = len(texts)
        a = np.frombuffer(b"\0\0".join(texts).lower() + b"\0\0\0", np.uint8).astype(np.uint32)
        code = (a[:-2] << np.uint32(16)) | (a[1:-1] << np.uint32(8)) | a[2:]  # texts are apart, so no trigram spans two
        at = np.flatnonzero(table[code])
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 2)
        pairs = np.unique(table[code[at]].astype(np.int64) * self.n + np.searchsorted(ends, at, "right"))
        which = pairs // max(1, self.n)
        edges = np.searchsorted(which, np.arange(1, len(trigrams) + 2))
        self.postings = {t: pairs[edges[i] : edges[i + 1]] % max(1, self.n) for i, t in enumerate(trigrams)}

    def find(self, query: tuple) -> np.ndarray:
        if query == ANY:
            return np.arange(self.n)
        if query[0] == "tri":
            return self.postings[query[1]]
        parts = [self.find(q) for q in query[1:]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "all" else np.union1d(out, p)
        return out


class Scanner:
    """Rules with their queries; one per task."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern.encode()), trigram_query(r.pattern)) for r in rules]
        self.trigrams = sorted(set().union(*(asked(q) for _, _, q in self.rules)))
        self.table = np.zeros(1 << 24, np.uint8 if len(self.trigrams) < 256 else np.uint32)
        for i, t in enumerate(self.trigrams):
            self.table[_code(t)] = i + 1

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, end, rule number) in code points, sorted."""
        segment, out = Segment(texts, self.table, self.trigrams), [[] for _ in texts]
        for k, (rule, expression, query) in enumerate(self.rules):
            for d in segment.find(query).tolist():
                for m in expression.finditer(texts[d]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[d].append((m.start(), m.end(), k))
        for d, found in enumerate(out):
            if found and not texts[d].isascii():
                point = Points(texts[d])
                out[d] = [(point(a), point(b), k) for a, b, k in found]
            out[d].sort(key=lambda f: (f[0], f[2], f[1]))
        return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and its spans (kind, start, stop), by start and then by the rules' order; one row per document."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    def work(batches):
        scanner = Scanner(rules)
        for big in batches:
            for b in runs(big, 1):
                found = [[{"kind": rules[k].kind, "start": s, "stop": e} for s, e, k in x] for x in scanner.spans(raw(b.column(1)))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])

    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind: string, start: bigint, stop: bigint>>")


def digest(found: DataFrame) -> DataFrame:
    written = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(n(r.kind) for r in BASE), F.sha2(written(base), 256).alias("base_sha256"), written("spans").alias("spans"))


def _sql_pattern(pattern: str) -> str:
    """For an engine whose case folding goes beyond ASCII: both cases spelled out; quotes doubled."""
    if m := re.search(r"\(\?i:([^()]*)\)", pattern):
        both = re.sub(r"[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1])
        pattern = pattern.replace(m[0], f"(?:{both})")
    return pattern.replace("'", "''")


def sql(rules: tuple[Rule, ...] = BASE + MORE) -> str:
    """DuckDB: matches and the pieces between them; a match starts after all pieces and matches before it."""
    parts = []
    for k, r in enumerate(rules):
        p = _sql_pattern(r.pattern)
        parts.append(f"""select doc_id, {k} k, '{r.kind}' kind, i, length(m) m, sum(length(piece) + length(m)) over (partition by doc_id order by i) stop, length(g) g, {r.least} least from
            (select doc_id, unnest(ms) m, unnest(gs) g, unnest(string_split_regex(t, '{p}')[1 : len(ms)]) piece, generate_subscripts(ms, 1) i from
            (select doc_id, t, regexp_extract_all(t, '{p}') ms, regexp_extract_all(t, '{p}', {r.group}) gs from d) where len(ms) > 0)""")
    written = "kind || ':' || cast(stop - m as bigint) || ':' || cast(stop as bigint)"
    counts = ", ".join(f"count(*) filter (kind = '{r.kind}') n_{r.kind}" for r in BASE)
    zero = ", ".join(f"coalesce(n_{r.kind}, 0) n_{r.kind}" for r in BASE)
    return f"""with d as (select doc_id, coalesce(text, '') t from documents), f as (select *, {written} w, stop - m start from ({" union all ".join(parts)}) where g >= least),
      a as (select doc_id, {counts}, coalesce(string_agg(w, ',' order by start, k, stop) filter (k < {len(BASE)}), '') base, string_agg(w, ',' order by start, k, stop) spans from f group by doc_id)
      select d.doc_id, {zero}, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans from d left join a using (doc_id)"""
