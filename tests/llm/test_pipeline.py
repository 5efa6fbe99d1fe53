"""The pipeline, stage by stage, against brute force on small tables."""

import random
import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from ledgerloom.llm.quality import fit_quality
from ledgerloom.llm.queries import tokenizer_path
from ledgerloom.plans.tables import materialise

SF = "/root/testdata/sf0.001"
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def _one_of_each_group(rows):
    """The rows that stay: by comparing all pairs, the row with the smallest id (null ids last) of each group of linked ones."""
    sets = [_shingles(r[1]) for r in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group[find(a)] = find(b)
    best = {}
    for k, r in enumerate(rows):
        if sets[k]:
            best.setdefault(find(k), []).append(r)
    return best.values(), [r for k, r in enumerate(rows) if not sets[k]]


def _redacted(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] + [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]{14,}", text)] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{16,}", text)]
    out, at = [], 0
    for a, _, b in sorted(spans):
        if b > at:
            out += [text[at:a], "<SECRET>"] if a >= at else []
            at = b
    return "".join(out) + text[at:]


def test_pipeline_is_what_its_stages_say(spark):
    """Every stage's rows, worked out in plain Python from what the stage before kept, and run()'s rows from the last one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(pipeline.STAGES)
    kept = {}
    for name in list(stages)[:-1]:
        before, docs = docs, materialise(stages[name](spark, docs, SF))
        assert docs.columns == before.columns
        kept[name] = [tuple(r) for r in before.collect()], sorted(map(tuple, docs.collect()))
    rows, got = kept["quality"]
    model = fit_quality(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert got == sorted(r for r in rows if model.probabilities([(r[1] or "").encode()])[0] >= 0.3)
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(good & {r[0] for r in got}) >= 0.95 * len(good)
    rows, got = kept["near_duplicates"]
    groups, alone = _one_of_each_group(rows)
    assert got == sorted([min(g) for g in groups] + alone) and len(got) < len(rows)
    rows, got = kept["decontamination"]
    items = [set(zip(w, w[1:], w[2:], w[3:], w[4:], w[5:], w[6:], w[7:])) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [r["text"].lower().split()]]
    copied = lambda t: any(len(g & set(zip(*(t.lower().split()[k:] for k in range(8))))) >= max(1, len(g) // 2) for g in items)
    gone = [r for r in rows if r not in set(got)]
    assert gone and all(copied(r[1]) for r in gone) and not any(copied(r[1] or "") for r in got)
    rows, got = kept["secrets"]
    want = [(i, _redacted(t), lang, source, n if _redacted(t) == t else len(_redacted(t))) for i, t, lang, source, n in rows]
    assert got == sorted(want) and got != sorted(rows)
    tokenizer = Tokenizer.from_file(tokenizer_path())
    pieces = pipeline.run(spark, SF).collect()
    sizes = Counter()
    for p in pieces:
        sizes[p["doc_id"]] += p["length"]
    assert sizes == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t, *_ in got}
    whole = Counter()
    for p in pieces:
        whole[p["sequence_id"]] += p["length"]
    assert max(whole.values()) <= 4096 and pipeline.ORACLE_SQL is None and len(pipeline.STAGES) == 5


@pytest.fixture(scope="module")
def odd_rows(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b = make(120), make(90)
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    return [
        (1, a), (1, a), (1, b), (None, a + " x"), (None, make(50)), (None, make(50)), (2, b + " y"), (3, None), (4, ""), (4, ""), (5, leak), (None, leak), (5, make(40)), (6, "long harmless text without any of them"),
        (6, "password=qwertyuiopasdf tail"), (None, "token: abcdefghijklmnop"), (None, None),
    ]


@pytest.fixture(scope="module")
def odd_table(spark, odd_rows):
    """Repeated rows, shared and missing ids, nulls, and extra columns whose names clash with those that operators use."""
    return materialise(spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "y") for i, t in odd_rows], SCHEMA + ", spans string, row int, component string").repartition(3))


def test_near_duplicates_of_odd_rows(spark, odd_rows, odd_table):
    groups, alone = _one_of_each_group(odd_rows)
    got = Counter((r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, odd_table, SF).collect())
    assert sum(got.values()) == len(groups) + len(alone)
    for group in groups:
        least = min((r[0] for r in group if r[0] is not None), default=None)
        assert sum(got[r] for r in set(group) if r[0] == least) == 1
    assert all(got[r] == n for r, n in Counter(alone).items())


def test_decontamination_of_odd_rows(spark, odd_rows, odd_table):
    leak = next(t for i, t in odd_rows if i == 5)
    got = Counter((r["doc_id"], r["text"]) for r in pipeline.decontaminate(spark, odd_table, SF).collect())
    assert got == Counter(r for r in odd_rows if r[1] != leak)


def test_redaction_of_odd_rows(spark, odd_rows, odd_table):
    out = pipeline.redact_secrets(spark, odd_table, SF)
    assert out.columns == odd_table.columns
    got = Counter((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect())
    assert got == Counter((i, t and _redacted(t), len(_redacted(t or ""))) for i, t in odd_rows)


def test_quality_and_packing_of_odd_rows(spark, odd_rows, odd_table):
    assert pipeline.quality(spark, odd_table, SF).columns == odd_table.columns
    assert pipeline.pack(spark, odd_table, SF).where("piece = 0").count() == len(odd_rows)


@pytest.mark.parametrize("k", range(5))
def test_empty_documents(spark, k):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert pipeline.STAGES[k][1](spark, docs, SF).count() == 0
