"""Reviews by rules: line patterns, rules that a prompt switches on, and many literals in one pass."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from revlytics.functions.strings import strip

# Rule, severity and pattern of the line rules.
LINE_RULES = (
    ("SEC-EVAL", "critical", r"\b(eval|exec)\s*\("),
    ("SEC-SUBPROCESS-SHELL", "high", r"\bshell\s*=\s*True\b"),
    ("SEC-HARDCODED-SECRET", "high", r"(?i)\b(password|passwd|api[_-]?key|secret|token)\b\s*=\s*['\"][^'\"]{4,}['\"]"),
    ("SEC-SQL-CONCAT", "high", r"(?i)(execute|query)\s*\(\s*(f['\"]|['\"].*(\+|%))"),
    ("REL-EMPTY-EXCEPT", "medium", r"^\s*except\s*(Exception\s*)?:\s*(pass)?\s*$"),
    ("REL-DEBUG-PRINT", "low", r"\b(print\s*\(|console\.log\s*\()"),
)
# The supplemental rules.
EXTRA_RULES = (
    ("SEC-PATH-TRAVERSAL", "high", r"open\(base\s*/\s*user_path\)"),
    ("SEC-YAML-LOAD", "high", r"\byaml\.load\s*\("),
    ("SEC-WEAK-HASH", "medium", r"\bhashlib\.md5\s*\("),
    ("SEC-INSECURE-TEMPFILE", "medium", r"\btempfile\.mktemp\s*\("),
    ("SEC-WEAK-RANDOM", "medium", r"\brandom\.random\s*\("),
    ("REL-UNBOUNDED-RETRY", "medium", r"^\s*while\s+True\s*:"),
    ("SEC-ASSERT-AUTH", "medium", r"^\s*assert\s+user\.is_admin"),
    ("SEC-INSECURE-COOKIE", "medium", r"set_cookie\(.+secure\s*=\s*False"),
)
# Unfinished code, and where each set of rules doesn't look.
UNFINISHED_RULES = (("QUALITY-UNFINISHED", "low", r"\b(TODO|FIXME)\b"),)
GENERATED_SUFFIXES = (".lock", ".min.js", ".map")
TEST_PREFIXES = ("tests/",)
# The rules of each specialist, and the confidence of each set's findings.
SPECIALISTS = {
    "security": ("SEC-EVAL", "SEC-SUBPROCESS-SHELL", "SEC-HARDCODED-SECRET", "SEC-SQL-CONCAT"),
    "reliability": ("REL-EMPTY-EXCEPT", "REL-DEBUG-PRINT"),
}
LINE_CONFIDENCE, EXTRA_CONFIDENCE, UNFINISHED_CONFIDENCE = 0.9, 0.86, 0.8
# Fixed value: what a rule id looks like.
RULE_ID = "[A-Z][A-Z0-9_-]{1,79}"
#: Characters of a line that a finding quotes.
EVIDENCE_CHARS = 240


def scanned(lines: DataFrame, rules: tuple, confidence: float, skip_suffixes: tuple = (), skip_prefixes: tuple = (), active: Column | None = None) -> DataFrame:
    """lines with rule_id, severity, evidence, confidence: a row for each rule that a line (path, content) breaks; narrow, no shuffle.

    active: array of rule ids; others have no effect. Patterns know Unicode's letters and white space.
    """
    path = F.col("path")
    looked = ~F.coalesce(path.rlike("(" + "|".join(f"\\Q{s}\\E" for s in skip_suffixes) + ")$"), F.lit(False)) if skip_suffixes else F.lit(True)
    for p in skip_prefixes:
        looked = looked & ~F.coalesce(path.startswith(p), F.lit(False))
    hit = lambda r, s, p: F.when(F.col("content").rlike(f"(?U){p}") & (F.lit(True) if active is None else F.array_contains(active, F.lit(r))), F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity")))
    hits = F.array_compact(F.array(*(hit(*rule) for rule in rules)))
    out = lines.where(looked).withColumn("hit", F.explode(hits))
    return out.select(*lines.columns, "hit.*", F.substring(strip(F.col("content")), 1, EVIDENCE_CHARS).alias("evidence"), F.lit(confidence).alias("confidence"))


def first_findings(found: DataFrame, case: str, order: str) -> DataFrame:
    """One finding for each case, rule, path and line: the first by `order`; partial minima before the shuffle."""
    rest = [c for c in found.columns if c not in (case, "rule_id", "path", "line")]
    best = F.min_by(F.struct(*rest), F.col(order)).alias("x")
    return found.groupBy(case, "rule_id", "path", "line").agg(best).select(case, "rule_id", "path", "line", *(f"x.{c}" for c in rest))


def evidence_id(rule_id: Column, path: Column, line: Column, content: Column) -> Column:
    return F.concat(F.lit("local-rule:"), F.substring(F.sha2(F.concat(rule_id, path, line.cast("string"), content).cast("binary"), 256), 1, 16))


def switched_on(prompt: Column, mark: str = "focus-rule") -> Column:
    """Rule ids that a prompt names as [mark:RULE]."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(prompt, F.lit("")), F.lit(rf"\[{mark}:({RULE_ID})\]"), F.lit(1)))


def policy_findings(lines: DataFrame, focus: Column) -> DataFrame:
    """Findings of all line rules, and of the supplemental rules that `focus` names."""
    base = scanned(lines, LINE_RULES, LINE_CONFIDENCE, GENERATED_SUFFIXES)
    return base.unionByName(scanned(lines, EXTRA_RULES, EXTRA_CONFIDENCE, active=focus))


#: Rules of an artifact: they are sent to every task.
MOST_RULES = 10_000
#: Bytes of a literal by which lines are searched for it.
GRAM = 4
#: Places of the table that says whether a gram may begin a literal.
HASH_BITS = 18
FINDING = "rule_id string, severity string, confidence double"


class _Literals:
    """Finds which of many literals lines contain, in a pass over the bytes for each length of gram, whatever the number of literals.

    A literal is known by its first GRAM bytes (all of a shorter one) as a number. The numbers of all places of a block of lines are looked up by their hash,
    then in the sorted numbers, and the few places that have one are compared in full.
    """

    def __init__(self, literals: list[bytes]):
        self.by = defaultdict(lambda: defaultdict(list))
        for i, x in enumerate(literals):
            n = min(len(x), GRAM)
            self.by[n][int.from_bytes(x[:n], "big")].append((i, x))
        self.keys = {n: np.array(sorted(grams), np.uint64) for n, grams in self.by.items()}
        self.marked = {n: np.zeros(1 << HASH_BITS, bool) for n in self.keys}
        for n, keys in self.keys.items():
            self.marked[n][self._hash(keys)] = True

    @staticmethod
    def _hash(value: np.ndarray) -> np.ndarray:
        return (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - HASH_BITS)

    def find(self, body: bytes, offsets: np.ndarray) -> set[tuple[int, int]]:
        """(line, literal) of a block: body of all lines, each from one offset to the next."""
        out, data = set(), np.frombuffer(body, np.uint8).astype(np.uint64)
        for n, keys in self.keys.items():
            if len(data) < n:
                continue
            value = np.zeros(len(data) - n + 1, np.uint64)
            for k in range(n):
                value = (value << np.uint64(8)) | data[k : len(data) - n + 1 + k]
            maybe = np.flatnonzero(self.marked[n][self._hash(value)])
            place = np.minimum(np.searchsorted(keys, value[maybe]), len(keys) - 1)
            hits = maybe[keys[place] == value[maybe]]
            line = np.searchsorted(offsets, hits, side="right") - 1
            for at, row in zip(hits.tolist(), line.tolist()):
                for i, x in self.by[n][int(value[at])]:
                    if at + len(x) <= offsets[row + 1] and body[at : at + len(x)] == x:
                        out.add((row, i))
        return out


def literal_findings(lines: DataFrame, rules: list[dict]) -> DataFrame:
    """lines with rule_id, severity, confidence for each rule whose literal a line (path, content) contains; one finding a rule id and line.

    rules: rule_id, severity, match, and perhaps ignore_case, include_paths, exclude_paths, confidence, as `checked_rules` gives them. A path must begin with one of the
    included prefixes, if there are any, and with none of the excluded. Of rules with one id the first by match counts. Nulls contain nothing.
    """
    rules = sorted(rules, key=lambda r: (r["rule_id"], r["match"]))
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are sent to tasks")
    out = StructType([*lines.schema, *DataType.fromDDL(FINDING)])
    as_is, folded = ([i for i, r in enumerate(rules) if bool(r.get("ignore_case")) is f] for f in (False, True))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders = [(c, ids, _Literals([(rules[i]["match"].lower() if fold else rules[i]["match"]).encode() for i in ids])) for c, ids, fold in (("content", as_is, False), ("_folded", folded, True)) if ids]
        looked: dict = {}

        def looks(path: str, i: int) -> bool:
            if (path, i) not in looked:
                r = rules[i]
                held = lambda key: any(path.startswith(p) for p in r.get(key) or ())
                looked[path, i] = (not r.get("include_paths") or held("include_paths")) and not held("exclude_paths")
            return looked[path, i]

        for b in batches:
            best: dict = {}
            paths = b.column("path")
            for column, ids, finder in finders:
                held = [(x or "").encode() for x in b.column(column).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])])
                for row, k in finder.find(b"".join(held), offsets):
                    i = ids[k]
                    key = row, rules[i]["rule_id"]
                    if looks(paths[row].as_py() or "", i) and i < best.get(key, len(rules)):
                        best[key] = i
            looked.clear()
            rows, hits = [k[0] for k in sorted(best)], [rules[best[k]] for k in sorted(best)]
            held = b.drop_columns(["_folded"]).take(pa.array(rows, pa.int64()))
            more = [pa.array([r["rule_id"] for r in hits], pa.string()), pa.array([r["severity"] for r in hits], pa.string()), pa.array([float(r.get("confidence", 0.85)) for r in hits], pa.float64())]
            yield pa.RecordBatch.from_arrays([*held.columns, *more], out.names)

    return lines.withColumn("_folded", F.lower("content") if folded else F.lit(None).cast("string")).mapInArrow(scan, out)


def checked_rules(rules: list[dict], most: int = 100) -> list[dict]:
    """An artifact's rules, completed; the first that isn't right raises: at most `most`, ids in capitals, one-line literals up to 240, no rule twice."""
    if len(rules) > most:
        raise ValueError(f"at most {most} rules")
    out, seen = [], set()
    for r in rules:
        rule_id, match, severity = str(r.get("rule_id", "")).strip().upper(), str(r.get("match", "")).strip(), str(r.get("severity", "medium")).lower()
        if not re.fullmatch(RULE_ID, rule_id):
            raise ValueError(f"not a rule id: {rule_id}")
        if severity not in ("critical", "high", "medium", "low"):
            raise ValueError(f"not a severity: {severity}")
        if not match or len(match) > 240 or "\n" in match or "\r" in match:
            raise ValueError(f"not a literal of one line: rule {rule_id}")
        if (key := (rule_id, match, bool(r.get("ignore_case")))) in seen:
            raise ValueError(f"rule twice: {rule_id}")
        seen.add(key)
        if not 0 <= (confidence := float(r.get("confidence", 0.85))) <= 1:
            raise ValueError(f"not a confidence: {confidence}")
        paths = {k: r.get(k, default) for k, default in (("include_paths", []), ("exclude_paths", ["tests/"]))}
        if any(not isinstance(v, list) or any(not isinstance(p, str) or len(p) > 200 for p in v) for v in paths.values()):
            raise ValueError(f"not a list of paths: rule {rule_id}")
        out.append({"rule_id": rule_id, "severity": severity, "match": match, "ignore_case": key[2], "confidence": round(confidence, 4)} | paths)
    return sorted(out, key=lambda r: (r["rule_id"], r["match"]))
