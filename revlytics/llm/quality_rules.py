"""Quality rules as learned decision lists.

Every whole text gives a row of counts; ratios of them are the features. From labelled rows a
decision list is learned by sequential covering: a rule for rejection grows threshold by threshold
on two thirds of the rows (by information gain), is pruned on the other third, and is kept while
it is right more often than `min_precision`; the rows it covers are set aside and the next rule is
grown. The list becomes one ordered Spark CASE expression; a row that no rule covers is kept.

The learner reads at most `max_rows` labelled rows (those of smallest id hash), only their counts.
Words are `[^\\x20\\x09-\\x0D]+`. Null and empty texts have no words, all counts 0, and fail the base.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlytics.llm.common import at, slices, table, utf8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_stops", "n_upper", "n_digits")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?;:,")] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    with np.errstate(over="ignore"):
        w = _mix(h[:-2] * _ODD + _mix(h[1:-1]) * np.uint64(3) + _mix(h[2:] + _ODD))
    order = np.argsort(w, kind="stable")
    same = w[order][1:] == w[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = np.zeros(len(words), bool)
    inside[:-2] |= twice
    inside[1:-1] |= twice
    inside[2:] |= twice
    return int(inside.sum())


def count_block(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    first = (data & 0xC0) != 0x80
    space = _SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edge] = ~space[edge]
    out = {
        "n_words": _sums(begins, offsets), "word_chars": _sums(first & ~space, offsets), "n_symbols": _sums(_SYMBOL[data], offsets),
        "n_chars": _sums(first, offsets), "n_lines": _sums(data == 10, offsets) + 1, "n_stops": _sums(_STOP[data], offsets),
        "n_upper": _sums((data >= 65) & (data <= 90), offsets), "n_digits": _sums((data >= 48) & (data <= 57), offsets),
    }
    raw = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    out["n_dup_lines"] = np.array([_dup_lines(x) for x in raw], np.int64)
    out["n_repeat_words"] = np.array([_repeat_words(x.split()) for x in raw], np.int64)
    return out


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and COUNTS, a row for each document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets):
                got = count_block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], *(pa.array(got[c], pa.int64()) for c in COUNTS)], ["doc_id", *COUNTS])

    source = docs.select(at(id_col).alias("doc_id"), at(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(work, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS))


#: Feature -> numerator and denominator among COUNTS (None: 1).
FEATURES = {
    "words": ("n_words", None), "chars_per_word": ("word_chars", "n_words"), "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "words_per_line": ("n_words", "n_lines"),
    "stops_per_word": ("n_stops", "n_words"), "upper_share": ("n_upper", "n_chars"), "digit_share": ("n_digits", "n_chars"),
}


def feature(name: str) -> Column:
    top, under = FEATURES[name]
    return F.col(top).cast("double") / (F.greatest(F.col(under), F.lit(1)) if under else F.lit(1))


@dataclass(frozen=True)
class Rule:
    """Reject where all of (feature, above?, threshold) hold."""

    tests: tuple[tuple[str, bool, float], ...]

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, t in self.tests:
            out &= x[name] > t if above else x[name] <= t
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, t in self.tests:
            out = out & ((feature(name) > t) if above else (feature(name) <= t))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'>' if a else '<='} {t:.4g}" for n, a, t in self.tests)


@dataclass
class DecisionList:
    rules: list[Rule] = field(default_factory=list)

    def reject(self) -> Column:
        out = None
        for r in self.rules:
            out = F.when(r.column(), F.lit(True)) if out is None else out.when(r.column(), F.lit(True))
        return F.lit(False) if out is None else out.otherwise(F.lit(False))

    def which(self) -> Column:
        """The number of the first rule that covers a row, from 0; null if none."""
        out = F.lit(None).cast("int")
        for k in range(len(self.rules) - 1, -1, -1):
            out = F.when(self.rules[k].column(), F.lit(k)).otherwise(out)
        return out


def _gain(p, n, p0, n0):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _grow(x: dict, bad: np.ndarray, cuts: dict, most_tests: int) -> list:
    inside, tests = np.ones(len(bad), bool), []
    while len(tests) < most_tests:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if n0 == 0 or p0 == 0:
            break
        best = (0.0, None)
        for name, at in cuts.items():
            v = x[name][inside]
            k = np.searchsorted(at, v, side="left")  # v <= at[j] for j >= k
            below_p = np.cumsum(np.bincount(k[bad[inside]], minlength=len(at) + 1))[: len(at)]
            below_n = np.cumsum(np.bincount(k[~bad[inside]], minlength=len(at) + 1))[: len(at)]
            for above, p, n in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                g = _gain(p, n, p0, n0)
                j = int(np.argmax(g))
                if g[j] > best[0] + 1e-9:
                    best = (float(g[j]), (name, above, float(at[j])))
        if best[1] is None:
            break
        tests.append(best[1])
        inside &= Rule((best[1],)).covers(x)
    return tests


def learn(x: dict[str, np.ndarray], bad: np.ndarray, most_rules: int = 12, most_tests: int = 4, min_precision: float = 0.8, min_cover: int = 10, seed: int = 7) -> DecisionList:
    """Sequential covering over features x; bad marks rows to reject."""
    out = DecisionList()
    if not len(bad):
        return out
    cuts = {k: np.unique(np.quantile(v, np.linspace(0, 1, 65)[1:-1])) for k, v in x.items()}
    left = np.ones(len(bad), bool)
    rng = np.random.default_rng(seed)
    for _ in range(most_rules):
        if (left & bad).sum() < min_cover:
            break
        grows = rng.random(len(bad)) < 2 / 3
        a, b = left & grows, left & ~grows
        tests = _grow({k: v[a] for k, v in x.items()}, bad[a], cuts, most_tests)
        held, held_bad = {k: v[b] for k, v in x.items()}, bad[b]

        def worth(rule):
            c = Rule(tuple(rule)).covers(held)
            p, n = int((c & held_bad).sum()), int((c & ~held_bad).sum())
            return (p - n) / (p + n) if p + n else -1.0

        while len(tests) > 1 and worth(tests[:-1]) >= worth(tests):
            tests = tests[:-1]
        if not tests:
            break
        rule = Rule(tuple(tests))
        c = rule.covers(x) & left
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        if p < min_cover or p < min_precision * (p + n) or worth(tests) < 2 * min_precision - 1:
            break
        out.rules.append(rule)
        left &= ~c
    return out


def fit_decision_list(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, **learning) -> DecisionList:
    """Learn from documents whose label is 0 (reject) or 1; at most max_rows labels are used, and only counts of texts leave the tasks.

    The labels are broadcast (max_rows ids), so that texts are neither shuffled nor counted where they aren't needed.
    """
    marked = labels.select(at(id_col).alias("doc_id"), at(label_col).alias("label")).where("doc_id is not null and label in (0, 1)")
    marked = F.broadcast(marked.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_rows))
    known = docs.select(at(id_col).alias("doc_id"), at(text_col).alias("text")).join(marked, "doc_id", "left_semi")
    rows = text_counts(known).join(marked, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *COUNTS, "label").limit(2 * max_rows).select("label", *(feature(n).alias(n) for n in FEATURES)).toPandas()
    rows = rows.sort_values(list(rows.columns), ignore_index=True)
    return learn({n: rows[n].to_numpy(float) for n in FEATURES}, rows["label"].to_numpy() == 0, **learning)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rules = fit_decision_list(docs, labels)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return text_counts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & ~rules.reject()).alias("kept"), rules.which().alias("rule"),
    )
