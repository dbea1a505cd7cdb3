"""Quality rules: decision lists learned by sequential covering.

Every text yields counts (words, characters, symbols, repeated lines and windows, ...). From labelled documents a list
of rules is learned: a rule grows by threshold conditions of best information gain on two thirds of the rows, is pruned
from its end on the rest, and stays if it is precise there; rows it covers leave, and the next rule starts. The list
becomes an ordered Spark conditional expression.

Learning uses at most ``sample`` labelled rows, those with the smallest seeded draws; everything else covers all rows.

Defined cases: a null text has no words and fails the base rule; without labels of both kinds no rule is learned and
the base rule decides; labels of unknown documents, null labels and repeated labels are harmless; an empty table gives
an empty result; further columns pass through.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import draw, table
from loomframe.session import ship

SAMPLE, SEED = 20_000, 29
SPACES = bytes([9, 10, 11, 12, 13, 32])
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_word_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_distinct", "n_top_word")
#: Features of the rules, as numerator and denominator among the counts.
FEATURES = {
    "words": ("n_words", None),
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_word_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "words_a_line": ("n_words", "n_word_lines"),
    "upper": ("n_upper", "word_chars"),
    "lower": ("n_lower", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "marks": ("n_marks", "word_chars"),
    "distinct": ("n_distinct", "n_words"),
    "top_word": ("n_top_word", "n_words"),
}
Rule = list[tuple[str, str, float]]


def repeat_words(ids: np.ndarray, kinds: int) -> int:
    """Words inside three-word windows that are found at least twice; ``ids`` number the words below ``kinds``."""
    if len(ids) < 4:
        return 0
    code = ids[:-2] * kinds + ids[1:-1]
    if kinds >= 1 << 20:  # three factors would overflow
        code = np.unique(code, return_inverse=True)[1]
    code = code * kinds + ids[2:]
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    again = np.zeros(len(ids), bool)
    hit = np.zeros(len(code), bool)
    hit[order[1:]] |= same
    hit[order[:-1]] |= same
    for shift in range(3):
        again[shift : shift + len(code)] |= hit
    return int(again.sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The values of ``COUNTS`` for a text in UTF-8."""
    bins = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    total = lambda these: int(bins[list(these)].sum())
    words = text.split()  # bytes split at exactly the six ASCII white-space characters
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text) - total(range(0x80, 0xC0)) - total(SPACES),
        total(SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(ids, len(numbers)),
        text.count(b"\n") + 1,
        len(lines),
        total(range(65, 91)),
        total(range(97, 123)),
        total(range(48, 58)),
        total(b"!?"),
        len(numbers),
        int(np.bincount(ids).max()) if len(ids) else 0,
    )


def stats(text: Column) -> Column:
    """Struct of ``COUNTS`` for a text column; evaluated once, wherever it is used."""

    def run(texts: pa.Array) -> pa.Array:
        rows = [counts(texts[i].as_py()) for i in range(len(texts))]
        columns = zip(*rows, strict=True) if rows else [[] for _ in COUNTS]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COUNTS))

    udf = F.arrow_udf(run, "struct<" + ",".join(f"{c}:long" for c in COUNTS) + ">").asNondeterministic()
    return udf(F.coalesce(text, F.lit("")).cast("binary"))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def feature(s: Column, name: str) -> Column:
    over, under = FEATURES[name]
    return s[over].cast("double") / (F.greatest(s[under], F.lit(1)) if under else F.lit(1))


def features(rows: np.ndarray) -> dict[str, np.ndarray]:
    at = {c: rows[:, i].astype(float) for i, c in enumerate(COUNTS)}
    return {k: at[a] / (np.maximum(at[b], 1) if b else 1) for k, (a, b) in FEATURES.items()}


def _covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    hit = np.ones(len(next(iter(x.values()))), bool)
    for name, side, t in rule:
        hit &= x[name] > t if side == ">" else x[name] <= t
    return hit


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int = 5) -> Rule:
    rule: Rule = []
    hit = np.ones(len(bad), bool)
    while len(rule) < most and (hit & ~bad).any():
        p0, n0 = (hit & bad).sum(), (hit & ~bad).sum()
        best = (0.0, None)
        for name, values in x.items():
            seen = np.unique(values[hit])
            if len(seen) < 2:
                continue
            middle = (seen[1:] + seen[:-1]) / 2
            cuts = middle[np.unique(np.linspace(0, len(middle) - 1, 64).astype(int))]
            order = np.argsort(values[hit])
            sorted_, sum_bad = values[hit][order], np.r_[0, np.cumsum(bad[hit][order])]
            below = np.searchsorted(sorted_, cuts, side="right")
            for side, p, n in (("<=", sum_bad[below], below - sum_bad[below]), (">", p0 - sum_bad[below], n0 - (below - sum_bad[below]))):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
                k = int(np.argmax(gain))
                if gain[k] > best[0] + 1e-9:
                    best = (float(gain[k]), (name, side, float(cuts[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        hit = _covers(rule, x)
    return rule


def learn(rows: np.ndarray, bad: np.ndarray, precision: float = 0.9, most: int = 16) -> list[Rule]:
    """Ordered rules that find the bad among ``rows`` of counts."""
    rules: list[Rule] = []
    x = features(rows)
    left = np.ones(len(bad), bool)
    prune = np.arange(len(bad)) % 3 == 2
    take = lambda which: {k: v[which] for k, v in x.items()}
    while len(rules) < most and (bad & left & ~prune).any():
        rule = _grow(take(left & ~prune), bad[left & ~prune])
        held, held_bad = take(left & prune), bad[left & prune]
        worth = lambda r: ((c := _covers(r, held)) & held_bad).sum() * 2 / max(c.sum(), 1) - 1  # noqa: B023, E731
        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        covered = _covers(rule, held)
        if not rule or (covered & held_bad).sum() < 2 or ((covered & held_bad).sum() + 1) / (covered.sum() + 2) < precision:
            break
        rules.append(rule)
        left &= ~_covers(rule, x)
    return rules


def rejected(s: Column, rules: list[Rule]) -> Column:
    """The rules as an ordered conditional expression."""
    test = lambda c: feature(s, c[0]) > c[2] if c[1] == ">" else feature(s, c[0]) <= c[2]
    out = None
    for rule in rules:
        condition = reduce(Column.__and__, [test(c) for c in rule])
        out = F.when(condition, True) if out is None else out.when(condition, True)
    return F.lit(False) if out is None else out.otherwise(False)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from at most ``sample`` labelled documents; those that fail the base rule teach nothing more."""
    ship(docs.sparkSession)
    some = labels.where("quality is not null and doc_id is not null").select("doc_id", "quality").withColumn("u", draw(SEED, F.col("doc_id"))).orderBy("u", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("quality", "u", "doc_id", stats(F.col("text")).alias("s"))
    got = rows.where(~base_failed(F.col("s"))).select("quality", "u", "doc_id", "s.*").orderBy("u", "doc_id", *COUNTS).limit(2 * sample).toPandas()
    bad = got["quality"].to_numpy() == 0
    return learn(got[list(COUNTS)].to_numpy(), bad) if bad.any() and not bad.all() else []


def judge(docs: DataFrame, rules: list[Rule], into: str) -> DataFrame:
    """``docs`` with a struct ``into``: the counts, base_failed and kept."""
    ship(docs.sparkSession)
    raw = docs.withColumn(into, stats(F.col("text")))
    s = raw[into]
    failed = base_failed(s)
    return raw.withColumn(into, F.struct(*[s[c].alias(c) for c in COUNTS], failed.alias("base_failed"), (~failed & ~rejected(s, rules)).alias("kept")))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass."""
    into = "q" + uuid.uuid4().hex
    return judge(docs, train(docs, labels), into).where(F.col(into)["kept"]).select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    """op3: counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents")
    rules = train(docs, table(spark, sf_dir, "labels"))
    said = judge(docs.select("doc_id", "text"), rules, "s")
    return said.select("doc_id", *[F.col("s")[c].alias(c) for c in (*COUNTS[:5], "base_failed", "kept")])
