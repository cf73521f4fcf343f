"""Secret scanning with a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams that any match must contain
(`trigram_query`). Documents are indexed in blocks: a block's postings list, for every trigram that
some rule asks for, the documents holding it. A rule's query intersects and unites postings; only
the candidates are scanned by the regex itself. A rule without mandatory trigrams (a run of hex
digits) scans every document. Blocks are Arrow batches inside Spark tasks, so nothing is shuffled.

A span is (kind, start, end) in code points, end exclusive, leftmost and non-overlapping per kind.
Null texts count as empty; empty texts have no spans; repeated rows are each scanned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlytics.llm.common import slices, table, utf8


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str
    #: Least length of `group`; shorter matches are dropped.
    least: int = 0
    group: int = 0


#: The base rules, in the order in which their kinds are listed.
BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
#: Rules beyond the base, public token formats.
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + MORE_RULES

# ---- trigram queries. A query is True (no condition), a trigram (bytes), or ("and"|"or", [queries]).

#: Strings that a part of a regex may match are listed while there are at most so many.
MOST_STRINGS = 32


def _join(op: str, parts: list):
    parts = list(dict.fromkeys(p for p in parts if not (op == "and" and p is True)))
    if op == "or" and (True in parts or not parts):
        return True
    if not parts:
        return True
    return parts[0] if len(parts) == 1 else (op, tuple(parts))


def _grams(word: str):
    raw = word.lower().encode()
    return _join("and", [raw[i : i + 3] for i in range(len(raw) - 2)])


def _one(op, arg):
    """Strings that one node can match, lower-cased, or None; and a query that holds in any case."""
    if op is rc.LITERAL:
        return [chr(arg).lower()], True
    if op is rc.SUBPATTERN:
        return _sequence(arg[3])
    if op is rc.BRANCH:
        parts = [_sequence(b) for b in arg[1]]
        if all(p[0] is not None for p in parts) and sum(len(p[0]) for p in parts) <= MOST_STRINGS:
            return sorted({s for p in parts for s in p[0]}), True
        return None, _join("or", [_closed(p) for p in parts])
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT):
        low, high, inner = arg
        if high == 1:
            got = _sequence(inner)
            if low == 0:
                return ([""] + got[0] if got[0] is not None else None), True
            return got
        return None, (_closed(_sequence(inner)) if low else True)
    if op is rc.IN and all(k is rc.LITERAL for k, _ in arg) and len(arg) <= MOST_STRINGS:
        return sorted({chr(c).lower() for _, c in arg}), True
    if op is rc.AT:
        return [""], True
    return None, True


def _closed(part):
    strings, asked = part
    return asked if strings is None else _join("and", [asked, _join("or", [_grams(s) for s in strings])])


def _sequence(items):
    strings, asked, whole = [""], [], True
    for op, arg in items:
        got, beside = _one(op, arg)
        asked.append(beside)
        if got is not None and len(strings) * len(got) <= MOST_STRINGS:
            strings = [a + b for a in strings for b in got]
            continue
        asked.append(_join("or", [_grams(s) for s in strings]))
        strings, whole = (got if got is not None else [""]), False
    if whole:
        return strings, _join("and", asked)
    asked.append(_join("or", [_grams(s) for s in strings]))
    return None, _join("and", asked)


def trigram_query(regex: str):
    """A Boolean query over lower-cased trigrams that every text matching `regex` fulfils; True: no mandatory trigram."""
    return _closed(_sequence(rp.parse(regex, re.ASCII)))


def trigrams_of(query) -> set[bytes]:
    if query is True:
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*map(trigrams_of, query[1]))


def _code(gram: bytes) -> int:
    return gram[0] << 16 | gram[1] << 8 | gram[2]


# ---- blocks

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def postings(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> dict[int, np.ndarray]:
    """trigram code -> sorted numbers of the block's documents that hold it. wanted: a flag for each code."""
    if len(data) < 3:
        return {}
    low = _LOWER[data]
    code = low[:-2].astype(np.uint32) << 16
    code |= low[1:-1].astype(np.uint32) << 8
    code |= low[2:]
    at = np.flatnonzero(wanted[code])
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + 3 <= offsets[row + 1]
    code, row = code[at[inside]], row[inside]
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    keys, first = np.unique(code, return_index=True)
    return {int(k): np.unique(r) for k, r in zip(keys, np.split(row, first[1:]))}


def candidates(query, lists: dict[int, np.ndarray], n: int) -> np.ndarray:
    """The documents of a block of n that fulfil a query."""
    if query is True:
        return np.arange(n)
    if isinstance(query, bytes):
        return lists.get(_code(query), np.zeros(0, np.int64))
    parts = [candidates(q, lists, n) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
    return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.regex = [re.compile(r.regex, re.ASCII) for r in rules]
        self.query = [trigram_query(r.regex) for r in rules]
        self.wanted = np.zeros(1 << 24, bool)
        for q in self.query:
            for gram in trigrams_of(q):
                self.wanted[_code(gram)] = True
        #: A rule that scans everything skips texts without a run of its bytes as long as it needs.
        self.runs = {i: self._byte_class(r) for i, r in enumerate(rules) if self.query[i] is True}

    @staticmethod
    def _byte_class(rule: Rule) -> np.ndarray | None:
        parsed = rp.parse(rule.regex, re.ASCII)
        if len(parsed) != 1 or parsed[0][0] is not rc.MAX_REPEAT or rule.group:
            return None
        one = re.compile(rule.regex[: rule.regex.rindex("]") + 1].encode(), re.ASCII)
        return np.array([bool(one.fullmatch(bytes([b]))) for b in range(256)]) if rule.regex.startswith("[") else None

    def block(self, data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each document the spans (start, end, rule number), by start and rule."""
        n = len(offsets) - 1
        lists = postings(data, offsets, self.wanted)
        found: list[list] = [[] for _ in range(n)]
        held: dict[int, str] = {}
        for k, rule in enumerate(self.rules):
            if (one := self.runs.get(k)) is not None:
                self._runs(data, offsets, one, rule.least, k, found)
                continue
            for i in candidates(self.query[k], lists, n).tolist():
                text = held.get(i)
                if text is None:
                    text = held[i] = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                for m in self.regex[k].finditer(text):
                    if len(m[rule.group]) >= rule.least:
                        found[i].append((m.start(), m.end(), k))
        for spans in found:
            spans.sort(key=lambda s: (s[0], s[2]))
        return found

    @staticmethod
    def _runs(data, offsets, one, least, k, found):
        """Maximal runs of single bytes, within documents; byte offsets become code points."""
        inside = one[data]
        step = np.diff(inside.astype(np.int8), prepend=0, append=0)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        across = np.searchsorted(start, offsets[1:-1], side="left") - 1  # a run that goes on past a document's end
        cut = offsets[1:-1][(across >= 0) & (end[np.maximum(across, 0)] > offsets[1:-1])] if len(start) else offsets[:0]
        if len(cut):
            cut = np.unique(cut)
            start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
        keep = end - start >= least
        for s, e in zip(start[keep].tolist(), end[keep].tolist()):
            i = int(np.searchsorted(offsets, s, side="right")) - 1
            a = int(((data[offsets[i] : s] & 0xC0) != 0x80).sum())
            found[i].append((a, a + e - s, k))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id and spans: array of (kind, start, end) for every document."""
    kinds = [r.kind for r in rules]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                spans = scanner.block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                value = [[{"kind": kinds[k], "start": a, "end": b} for a, b, k in s] for s in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(value, SPANS)], ["doc_id", "spans"])

    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(work, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def redact_secrets(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The same rows and columns, every span (overlapping ones as one) replaced by `mark`; n_chars, where present, follows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            data, offsets = utf8(batch.column(k))
            for i, j in slices(offsets):
                part = batch.slice(i, j - i)
                value = part.column(k).to_pylist()
                for n, spans in enumerate(scanner.block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])):
                    if spans:
                        out, at = [], 0
                        for a, b, _ in spans:
                            if a >= at:
                                out += [value[n][at:a], mark]
                            at = max(at, b)
                        value[n] = "".join(out) + value[n][at:]
                columns = part.columns
                columns[k] = pa.array(value, batch.schema.field(k).type)
                yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(work, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length(text_col), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return out


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE_RULES]
    shown = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    mine = F.filter("spans", lambda s: s["kind"].isin(base))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, base), F.sha2(shown(mine), 256).alias("base_sha256"), shown("spans").alias("spans"))

