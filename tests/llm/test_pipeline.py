"""The pipeline stage by stage against brute force, over a small folder of tables."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.test_documents import SCHEMA, make_rows, sentence, shingle_set


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(make_rows(), SCHEMA).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 4 and 1) for i in range(100)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def test_stages(spark, folder):
    import corpus_pipeline as P

    stages = dict(P.STAGES)
    assert list(stages) == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    def after(name, df):
        out = P.cut(stages[name](spark, df, folder), name)
        if name != "packing":
            assert out.columns == columns
        return out, [tuple(r) for r in out.collect()]

    good, rows = after("quality_rules", docs)
    from gristmill.llm.quality_rules import judge

    verdicts = Counter((r.doc_id, r.n_words, r.kept) for r in judge(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect())
    assert not any(verdicts[(i, n, False)] and verdicts[(i, n, True)] for i, n, _ in verdicts)
    size = lambda r: len(re.findall("[^\x20\x09-\x0d]+", r[1] or ""))
    assert Counter(rows) == Counter(t for t in map(tuple, docs.collect()) if verdicts[(t[0], size(t), True)])
    assert any(r[0] is None for r in rows)  # a rejected row without an id takes no other along
    unique, rows2 = after("exact_dedup", good)
    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r)
    assert {r[0] for r in rows2} == {min(g, key=lambda r: (r[0] is None, r[0] or 0))[0] for g in groups.values()} and len(rows2) == len(groups)
    near, rows3 = after("near_dedup", unique)
    sets = {r[0]: shingle_set(r[1]) for r in rows2}
    linked = lambda x, y: 100 * len(x & y) >= 80 * len(x | y) > 0
    kept = {r[0] for r in rows3}
    for i, s in sets.items():
        if i is None:
            continue
        smaller = [j for j in sets if j is not None and i is not None and j < i and linked(sets[j], s)]
        assert (i in kept) or any(linked(s, sets[j]) for j in sets if j != i)
        assert not (smaller and i in kept)
    mixed, rows4 = after("mixing", near)
    assert not Counter(rows4) - Counter(rows3)
    packed, rows5 = after("packing", mixed)
    assert {r.doc_id for r in packed.collect()} == {r[0] for r in rows4}
    whole = Counter(tuple(r)[:5] for r in P.run(spark, folder).collect())
    assert whole == Counter(r[:5] for r in rows5)


def test_two_runs_at_once(spark, folder):
    """A run deletes its own tables only."""
    import threading

    import corpus_pipeline as P

    results, errors = [], []

    def run():
        try:
            results.append(sorted(map(tuple, P.run(spark, folder).collect())))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=run) for _ in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and results[0] == results[1]


def test_empty_input(spark, folder):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_near_stage_links_from_80_percent(spark, folder):
    """Pairs planted between 0.80 and 0.85, and one below, beside the ordinary rows."""
    import corpus_pipeline as P

    rng = random.Random(9)
    rows = [r for r in make_rows() if r[0] is not None]
    for i, n in enumerate((100, 112, 120, 90)):  # two words of the copy differ
        words = sentence(rng, n).split()
        copy = list(words)
        copy[30], copy[60] = f"other{i}a", f"other{i}b"
        rows += [(200 + 2 * i, " ".join(words), "en", "s1", 0, True, 1, "x"), (201 + 2 * i, " ".join(copy), "en", "s1", 0, True, 1, "x")]
    sets = {(r[0], r[1]): shingle_set(r[1]) for r in rows}
    alike = lambda i: next(len(x & y) / len(x | y) for (a, _), x in sets.items() for (b, _), y in sets.items() if (a, b) == (i, i + 1))
    assert all(0.80 <= alike(i) < 0.85 for i in (200, 202, 204)) and alike(206) < 0.80
    up = {r[0]: r[0] for r in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = list(sets)
    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            n = len(x & y)
            if x and y and 100 * n >= 80 * (len(x) + len(y) - n):
                p, q = top(keys[a][0]), top(keys[b][0])
                up[max(p, q)] = min(p, q)
    got = P.near(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), folder)
    assert Counter(tuple(r) for r in got.collect()) == Counter(r for r in rows if top(r[0]) == r[0])
