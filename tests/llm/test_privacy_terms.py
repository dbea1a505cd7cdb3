"""op7: terms that disclose an entity, against counts over whole texts."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from loomframe.llm import privacy
from loomframe.llm.common import stored


def test_terms_far_from_their_entity_and_strengths_of_whole_texts(spark):
    r = random.Random(21)
    filler = lambda n: " ".join(r.choices(["river", "stone", "market", "winter"], k=n))
    texts = [f"Quillon opened {filler(60)} write boss@corp.example or +49 30 1234567 {filler(60)} end{k}" for k in range(4)]
    texts += [f"Marrow {filler(40)} mail two@corp.example {filler(k)}" for k in (3, 9)]  # an entity of two texts
    texts += [f"solitary {filler(9)} one@corp.example", *[f"{filler(50)} opened" for _ in range(20)], "quillon again"]
    frame = spark.createDataFrame([(t,) for t in [*texts, *texts[:7]]], "text string")  # copies prove nothing
    found = stored(frame.distinct().select("text", privacy.base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0), "found")
    got = {x.term: x.strength for x in privacy.disclosing_terms(found, frame).collect()}
    entities = {"boss@corp.example": 4, "two@corp.example": 2, "one@corp.example": 1, "+49 30 1234567": 4}
    bare = {t: re.sub(r"\S+@\S+|\+49 30 1234567", " ", t).lower().split() for t in texts}
    want: dict = {}
    for e, n in entities.items():
        for w in {w for t in texts if e in t for w in bare[t]}:
            both, all_ = (sum(w in bare[t] for t in texts if x in t) for x in (e, ""))
            s = (both + n / len(texts)) / (all_ + 1)
            if s >= 0.5:
                want[w] = max(want.get(w, 0), s)
    assert {"quillon", "marrow", "solitary"} <= set(want)
    assert {w: round(s, 9) for w, s in got.items()} == {w: round(s, 9) for w, s in want.items()}


def test_strengths_of_a_random_corpus_against_all_pairs(spark):
    """Texts share entities and words at random; short words count, no strength exceeds certainty."""
    r = random.Random(3)
    vocabulary = [f"w{k}" for k in range(150)] + ["li", "x"]
    texts = sorted({" ".join([*r.choices(vocabulary, k=r.randint(1, 9)), *(f"u{r.randint(0, 12)}@corp.example" for _ in range(r.choice([0, 0, 1, 2])))]) for _ in range(150)})
    frame = spark.createDataFrame([(t,) for t in texts * 2], "text string").repartition(6)
    found = stored(frame.distinct().select("text", privacy.base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0), "found")
    got = {x.term: round(x.strength, 9) for x in privacy.disclosing_terms(found, frame, threshold=0.3).collect()}
    words = {t: {w for w in t.split() if "@" not in w} for t in texts}
    holds = {t: {w for w in t.split() if "@" in w} for t in texts}
    want: dict = {}
    for e in set().union(*holds.values()):
        n = sum(e in holds[t] for t in texts)
        for w in set().union(*(words[t] for t in texts if e in holds[t])):
            both, all_ = (sum(w in words[t] and (not x or e in holds[t]) for t in texts) for x in (True, False))
            s = (both + n / len(texts)) / (all_ + 1)
            if s >= 0.3:
                want[w] = max(want.get(w, 0), round(s, 9))
    assert len(want) > 3 and max(want.values()) <= 1
    assert got == want
