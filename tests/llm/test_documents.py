"""Operators over documents against brute force, on a small table of ordinary and odd rows."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, size long, bands string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def sentence(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta Epsilon zeta eta théta iota kappa lam mu nu xi omicron pi rho sigma tau".split()) + str(rng.randrange(40)) for _ in range(n))


def make_rows():
    rng = random.Random(5)
    rows, base = [], [sentence(rng, 120) for _ in range(6)]
    for i in range(60):
        words = base[i % 6].split()
        kind = i % 5
        if kind == 1:
            for _ in range(rng.randrange(1, 6)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(1000)}"
        elif kind == 2:
            words = sentence(rng, 60).split() + words[20:90] + sentence(rng, 30).split()
        elif kind == 3:
            words = sentence(rng, rng.randrange(1, 200)).split()
        text = " ".join(words)
        if kind == 4:
            text = text.replace(" ", "\n", 5).replace(" ", " \t ", 3).upper() + "\nthe same line\n## $$ ## %% || done"
        rows.append((i * 3 % 61, text, "en" if i % 3 else "de", f"s{i % 7}"))
    long_ = sentence(rng, 9000)
    odd = [
        (100, None, "en", "s1"), (101, "", None, None), (102, " \n\t ", "en", "s2"), (103, "one two", "en", "s0"), (104, "one two", "en", "s3"), (105, "One  two", "fr", "s0"),
        (106, long_, "en", "s4"), (107, long_ + " end", "de", "s5"), (None, "no id at all here", "en", "s1"), (None, base[0], "en", "s1"), (108, "x" * 70_000, "en", "s1"), (109, "a b c " * 400, "en", "s2"),
        (103, "one two", "en", "s0"), (110, "<|endoftext|> and  more\n text", "en", "s0"), (111, "ünïcode ﷺ 漢字 " * 30, "en", "s6"),
    ]
    return [(*r, 0, True, 1, "x") for r in rows + odd]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingle_set(t):
    w = WORD.findall(lower(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates(docs, rows, empty):
    from gristmill.llm.near_dedup import near_duplicates

    sets = {(r[0], r[1]): shingle_set(r[1]) for r in rows if r[0] is not None}
    up = {k[0]: k[0] for k in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = list(sets)
    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            n = len(x & y)
            if x and y and 100 * n >= 85 * (len(x) + len(y) - n):
                p, q = top(keys[a][0]), top(keys[b][0])
                up[max(p, q)] = min(p, q)
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.component_id == top(r.doc_id) and r.kept == (r.doc_id == top(r.doc_id))
    assert sorted(r.n_shingles for r in got) == sorted(len(shingle_set(r[1])) for r in rows)
    assert near_duplicates(empty).count() == 0


@pytest.mark.parametrize("how", [{}, {"block_members": 40}, {"block_members": 40, "hot": 3}])
def test_near_duplicates_in_one_large_bucket(spark, how):
    """A chain of close texts and a crowd below the limit share buckets: links are found, others not."""
    from gristmill.llm.near_dedup import near_duplicates

    rng = random.Random(1)
    base = sentence(rng, 100).split()
    rows = []
    for i in range(500):
        w = list(base)
        for j in rng.sample(range(100), rng.choice([1, 2, 3, 4])):
            w[j] = f"z{i}x{j}"
        rows.append((i, " ".join(w)))
    sets = {i: shingle_set(t) for i, t in rows}
    up = list(range(500))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(500):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}
    assert got == {i: top(i) for i in range(500)}
    assert len(set(got.values())) > 5


def thue_morse(n):
    """Two complementary sequences of 2**n symbols, alike under any polynomial with an odd base modulo a power of two."""
    x = [0]
    for _ in range(n):
        x += [1 - v for v in x]
    return x, [1 - v for v in x]


def test_words_and_sequences_made_to_collide_stay_apart(spark):
    from gristmill.llm.near_dedup import near_duplicates
    from gristmill.llm.substring_dedup import remove_repeated_spans

    long_words = ["".join("ab"[v] for v in x) for x in thue_morse(10)]
    runs = [" ".join(("left", "right")[v] for v in x) for x in thue_morse(10)]
    rows = [(1, long_words[0]), (2, long_words[1]), (3, runs[0]), (4, runs[1])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.kept for r in near_duplicates(table).collect() if r.doc_id < 3)
    passage = sentence(random.Random(3), 120)
    pair = spark.createDataFrame([(1, f"{passage} {long_words[0]}"), (2, f"{passage} {long_words[1]}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeated_spans(pair).collect()} == {1: 0, 2: 120}


def test_sketch_fills_every_coordinate_and_tracks_similarity():
    import numpy as np

    from gristmill.llm.near_dedup import fast_sketch

    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 63, 1500, dtype=np.uint64)
    sets = [pool[:1], pool[:3], pool[:1000], pool[200:1200], pool[:0]]
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    s = fast_sketch(np.concatenate(sets), first, 96)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    assert (s[:4] != full).all() and (s[4] == full).all()
    assert abs((s[2] == s[3]).mean() - 800 / 1200) < 0.2


def test_substring_dedup(docs, rows, empty):
    from gristmill.llm.substring_dedup import remove_repeated_spans, repeated_spans

    least = {}
    words = [(r[0], (r[1] or "").encode().split()) for r in rows]
    for i, w in words:
        if i is not None:
            for j in range(len(w) - 49):
                g = tuple(w[j : j + 50])
                least[g] = min(least.get(g, i), i)
    expected = Counter()
    for i, w in words:
        gone = [False] * len(w)
        if i is not None:
            for j in range(len(w) - 49):
                if least[tuple(w[j : j + 50])] < i:
                    gone[j : j + 50] = [True] * 50
        kept = [x for x, g in zip(w, gone) if not g]
        expected[(i, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())] += 1
    assert Counter(tuple(r) for r in remove_repeated_spans(docs).collect()) == expected
    assert sum(n for _, _, n, _ in expected) > 0
    assert remove_repeated_spans(empty).count() == 0
    by_id = defaultdict(list)
    for i, w in words:
        by_id[i].append(w)
    for s in repeated_spans(docs).collect():
        spans = [w[s.start : s.start + s.length] for w in by_id[s.doc_id]]
        assert any(w[s.source_start : s.source_start + s.length] in spans for w in by_id[s.source_id])


def test_exact_duplicates(spark, docs, rows, empty):
    from gristmill.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

    norm = lambda t: re.sub("[\x20\x09-\x0d]+", " ", t or "")
    groups = defaultdict(list)
    for r in rows:
        groups[norm(r[1])].append(r[0])
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # runs span batches
    try:
        got = exact_duplicates(docs).collect()
        left = drop_exact_duplicates(docs)
        kept_rows = left.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = Counter((r[0], keep[norm(r[1])], len(groups[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    assert sum(r.kept for r in got) == len(groups)
    assert left.columns == docs.columns and len(kept_rows) == len(groups)
    assert {norm(r.text) for r in kept_rows} == set(groups)
    assert exact_duplicates(empty).count() == 0 and drop_exact_duplicates(empty).count() == 0


def test_packing(docs, rows, empty):
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    from gristmill.llm.packing import pack

    how = (P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    got = pack(docs, *how).collect()
    t = Tokenizer.from_file(how[0])
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append(np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4"))
    total = Counter()
    for p in got:
        assert any(len(x) == p.doc_tokens and zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for x in ids[p.doc_id])
        total[p.doc_id] += p.length
    assert total == Counter({k: sum(map(len, v)) for k, v in ids.items()})
    bins = defaultdict(list)
    for p in got:
        bins[p.sequence_id].append((p.offset, p.length))
    used = 0
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
        used += at
    assert used >= 0.95 * 1024 * len(bins)
    assert pack(empty, *how).count() == 0


def test_cut_lengths():
    from gristmill.llm.packing import cut_lengths

    for n in range(1024):
        parts = cut_lengths(n)
        assert sum(parts) == n and all(1024 % p <= 12 or p == 1024 // (1024 // p) for p in parts) and len(parts) <= 6


def test_quality_rules(spark, docs, rows, empty):
    from gristmill.llm.quality_rules import judge

    labels = spark.createDataFrame([(r[0], 1 if (r[0] or 0) % 5 else 0, 7) for r in rows], "doc_id long, quality int, text int")
    got = judge(docs, labels).collect()
    expected = Counter()
    for i, text, *_ in rows:
        text = text or ""
        w = WORD.findall(text)
        seen, dup = set(), 0
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        c = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        covered = {j + d for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for d in range(3)}
        expected[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w))] += 1
    assert Counter(tuple(r)[:7] for r in got) == expected
    assert not any(r.kept and r.base_failed for r in got)
    assert judge(empty, labels).count() == 0
    none = judge(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in none)


def test_certified_cutoffs():
    from gristmill.llm.quality_rules import binomial_tail, certified

    assert binomial_tail(0, 10, 0.5) == pytest.approx(0.5**10)
    assert binomial_tail(2, 4, 0.5) == pytest.approx(11 / 16)
    assert certified([0, 0, 1, 9], 1000, 0.02, 0.001) == 2
    assert certified([0, 25, 0], 1000, 0.02, 0.001) == 0  # nothing after the first failure
    assert certified([0], 20, 0.02, 0.001) == -1


def test_classifier(spark, docs, rows, empty):
    from gristmill.llm.quality_classifier import classify

    rng = random.Random(2)
    many = [(i, sentence(rng, 40) if i % 3 else " ".join(f"{x}$$$" for x in sentence(rng, 40).split())) for i in range(300)]
    table = spark.createDataFrame(many, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(300)], "doc_id long, quality int")
    got = classify(table, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == (1 if r.doc_id % 3 else 0) for r in held) >= 0.95 * len(held)
    odd = classify(docs, labels).collect()
    assert len(odd) == len(rows) and all(0 <= r.score <= 1 for r in odd)
    one = classify(table, labels.where("quality = 1")).collect()
    assert len({r.score for r in one}) == 1
    assert classify(empty, labels.limit(0)).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    import numpy as np

    from gristmill.llm.quality_classifier import SIZE, descend

    rng = np.random.default_rng(0)
    rows = [np.sort(rng.choice(30, 6, replace=False)).astype(np.int32) for _ in range(80)]
    values = [np.full(6, 6**-0.5) for _ in rows]
    y = np.where([r[0] < 3 for r in rows], 1.0, -1.0)
    loss = lambda w: 0.5 * (w @ w) + sum(max(0, 1 - t * (w[r] @ v + w[SIZE])) for r, v, t in zip(rows, values, y))
    few, many = loss(descend(rows, values, y, epochs=60)), loss(descend(rows, values, y, epochs=600))
    assert few <= many * 1.01 + 1e-6


def test_mixing(docs, rows, empty):
    from gristmill.llm.mixing import mix, mix_counts

    got = mix_counts(docs, budget_share=1.0, entropy_share=0.9, max_repeat=4.0).collect()
    assert len(got) == len(rows)
    tokens = Counter()
    used = Counter()
    for r in got:
        tokens[r.source] += r.n_tokens
        used[r.source] += r.n_tokens * r.copies
    assert sum(used.values()) <= sum(tokens.values()) + len(tokens)
    assert max(used[s] / tokens[s] for s in tokens if tokens[s]) <= 4.0
    with pytest.raises(ValueError, match="repeats some source"):
        mix_counts(docs, budget_share=3.0, entropy_share=None, max_repeat=1.0)
    exact = mix_counts(docs, budget_share=3.0, entropy_share=None, max_repeat=3.0).collect()
    assert {r.copies for r in exact if r.n_tokens} <= {2, 3}
    capped = mix(docs, budget_share=0.9, entropy_share=None, max_repeat=1.0)
    assert capped.columns == docs.columns
    taken = [tuple(r) for r in capped.collect()]
    assert not Counter(taken) - Counter(tuple(r) for r in docs.collect())
    assert mix_counts(empty).count() == 0 and mix(empty).count() == 0


def brute_mix(rows, length, quota, passes):
    """Copies of (id, n) rows of one source: long documents first, longest first, then blocks in turn, then the edge."""
    md5 = lambda *p: hashlib.md5("/".join(["mix", *map(str, p)]).encode()).hexdigest()
    tokens = sum(n for _, n in rows)
    n_blocks, rest = max(1, -(-tokens // length)), quota - passes * tokens
    by_id = defaultdict(int)
    for i, n in rows:
        by_id[i] += n
    long = sorted({i for i, n in rows if n > length}, key=lambda i: (-by_id[i], md5(i), i))
    block = {i: n_blocks + long.index(i) if i in long else int(md5(i)[:8], 16) % n_blocks for i in by_id}
    sizes = Counter()
    for i, n in by_id.items():
        sizes[block[i]] += n
    turns = sorted(sizes, key=lambda b: (b < n_blocks, b if b >= n_blocks else 0, md5("a", passes, b), b))
    taken = set()
    for b in turns:
        if sizes[b] <= rest:
            taken.add(b)
            rest -= sizes[b]
    edge = next((b for b in turns if b < n_blocks and b not in taken), None)
    more = set()
    for i in sorted((i for i in by_id if block[i] == edge), key=lambda i: (by_id[i], md5(i), i)):
        if by_id[i] > rest:
            break
        more.add(i)
        rest -= by_id[i]
    return {i: (passes + (block[i] in taken or i in more), block[i], turns.index(block[i])) for i in by_id}, rest


@pytest.mark.parametrize("budget, repeat", [(0.9, 1.0), (0.5, 1.0), (2.3, 4.0)])
def test_mixing_behind_long_documents(spark, monkeypatch, budget, repeat):
    """Documents of many blocks' length, and rows that repeat an id: the quota is met but for a short document."""
    from gristmill.llm import mixing

    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 1000)
    rng = random.Random(8)
    rows = [(i, rng.randrange(1, 200)) for i in range(300)] + [(1000, 30_000), (1001, 9000), (1002, 9000), (1003, 1001), (7, 50), (7, 60), (1003, 5)]
    docs = spark.createDataFrame([(i, "w " * n, "a", "kept", 5) for i, n in rows], "doc_id long, text string, source string, copies string, __gm_copies int").repartition(3)
    got = mixing.mix_counts(docs, budget_share=budget, entropy_share=None, max_repeat=repeat).collect()
    tokens = sum(n for _, n in rows)
    quota = int(budget * tokens + 0.5)
    want, short = brute_mix(rows, 1000, quota, quota // tokens)
    assert Counter((r.doc_id, r.n_tokens, (r.copies, r.block, r.turn)) for r in got) == Counter((i, n, want[i]) for i, n in rows)
    assert quota - sum(r.n_tokens * r.copies for r in got) == short < 200
    out = mixing.mix(docs, ordered=True, budget_share=budget, entropy_share=None, max_repeat=repeat)
    assert out.columns == docs.columns and Counter(r.doc_id for r in out.collect()) == Counter({r.doc_id: 0 for r in got} | {i: sum(r.copies for r in got if r.doc_id == i) for i, _ in rows}) - Counter()


def test_reserved_names_may_come_with_the_table(spark):
    from gristmill.llm.exact_dedup import drop_exact_duplicates
    from gristmill.llm.near_dedup import drop_near_duplicates

    names = ["__gm_row", "__gm_key", "__gm_id", "__gm_digest", "__gm_all", "__gm_cell"]
    rows = [(i, f"some text of kind {i % 7} that is the same in a few rows", *range(i, i + 6)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    for some in (docs, docs.union(docs.where("doc_id = 3"))):  # ids that repeat go another way
        for keep in (drop_exact_duplicates, drop_near_duplicates):
            out = keep(some)
            assert out.columns == docs.columns
            assert {tuple(r) for r in out.collect()} == set(rows[:7])


def test_mixing_puts_passes_out_in_permuted_blocks(spark, monkeypatch):
    from gristmill.llm import mixing

    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 50)
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, sentence(rng, 10), "ab"[i % 3 == 0]) for i in range(120)], "doc_id long, text string, source string")
    how = {"budget_share": 2.0, "entropy_share": None, "max_repeat": 4.0}
    plan = {r.doc_id: r for r in mixing.mix_counts(docs, **how).collect()}
    out = [r.doc_id for r in mixing.mix(docs, ordered=True, **how).collect()]
    assert Counter(out) == Counter({i: r.copies for i, r in plan.items() if r.copies})
    runs, passes, seen = [], [], Counter()
    for i in out:  # every block stands in one piece in each pass, and passes differ
        key = (plan[i].source, plan[i].block, seen[i])
        seen[i] += 1
        if not runs or runs[-1] != key:
            runs.append(key)
    assert len(runs) == len(set(runs)) and [k[2] for k in runs] == sorted(k[2] for k in runs)
    for p in (0, 1):
        passes.append([k[:2] for k in runs if k[2] == p])
    assert sorted(passes[0]) != passes[0] and [k for k in passes[0] if k in passes[1]] != passes[1]


def test_line_spread(docs, rows, empty):
    from gristmill.llm.line_spread import remove_spread_lines

    ends = " \t\r\x0b\x0c"
    sites = defaultdict(set)
    for r in rows:
        for line in (r[1] or "").split("\n"):
            sites[line.strip(ends)].add(r[3] or "")
    gone = {k for k, v in sites.items() if k and len(v) >= 5}
    assert gone
    expected = Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if x.strip(ends) not in gone]
        expected[(r[0], sum(bool(x.strip(ends)) for x in lines), len(lines) - len(kept), "\n".join(kept))] += 1
    assert Counter(tuple(r) for r in remove_spread_lines(docs).collect()) == expected
    assert remove_spread_lines(empty).count() == 0


def test_line_spread_many_lines(spark):
    from gristmill.llm.line_spread import remove_spread_lines

    text = "\n".join(f"line {i % 700}" for i in range(1000))
    df = spark.createDataFrame([(i, text + f"\nown {i}", f"site{i}") for i in range(6)], "doc_id long, text string, source string")
    assert {r.kept_text for r in remove_spread_lines(df).collect()} == {f"own {i}" for i in range(6)}


def test_licenses(spark, docs, rows, empty):
    from gristmill.llm.licenses import license_of_files

    files = [
        (1, "a/LICENSE", "Some words.\n\nReleased under the MIT License."), (2, "a/b/x.txt", "no notice"), (3, "a/b/c/COPYING.md", "Licensed under CC BY-NC 4.0."), (4, "a/b/c/y.txt", None),
        (5, "a/b/c/z.txt", "text\nLicensed under the Apache License, Version 2.0.\nmore text follows here"), (6, "q/x.txt", "nothing"), (7, None, "This work is licensed under the GNU General Public License, version 3."),
        (8, "a/b/c/w.txt", "Licensed under the\nApache License, Version 2.0\n\nand then much else"), (9, "top.txt", ""), (2, "a/b/x.txt", "no notice"),
    ]
    got = Counter(tuple(r)[:3] + tuple(r)[4:] for r in license_of_files(spark.createDataFrame(files, "doc_id long, path string, text string")).collect())
    assert got == Counter([
        (1, "a/LICENSE", "MIT", "MIT", None), (2, "a/b/x.txt", None, "MIT", "a/LICENSE"), (3, "a/b/c/COPYING.md", "CC-BY-NC-4.0", "CC-BY-NC-4.0", None), (4, "a/b/c/y.txt", None, "CC-BY-NC-4.0", "a/b/c/COPYING.md"),
        (5, "a/b/c/z.txt", "Apache-2.0", "Apache-2.0", None), (6, "q/x.txt", None, None, None), (7, None, "GPL-3.0", "GPL-3.0", None), (8, "a/b/c/w.txt", "Apache-2.0", "Apache-2.0", None), (9, "top.txt", None, None, None), (2, "a/b/x.txt", None, "MIT", "a/LICENSE"),
    ])
    assert license_of_files(docs.withColumn("path", F.concat(F.lit("d/"), F.col("doc_id").cast("string")))).count() == len(rows)
    assert license_of_files(empty.withColumn("path", F.lit("x"))).count() == 0


def test_licenses_inside_longer_and_wrapped_lines(spark):
    from gristmill.llm.licenses import license_of_files

    rng = random.Random(4)
    prose = lambda n: sentence(rng, n)
    files = [
        (1, "Copyright 2024 Example Authors. Licensed under the Apache License, Version 2.0", "Apache-2.0"), (2, "This software is released under the MIT License, see LICENSE in this project for details.", "MIT"),
        (3, f"{prose(300)} Licensed under CC BY-NC 4.0, {prose(300)}", "CC-BY-NC-4.0"), (4, f"# {prose(9)}\n# This work is licensed under the GNU\n# Lesser General Public License,\n# version 3 {prose(9)}\n# {prose(9)}", "LGPL-3.0"),
        (5, prose(300) + " the terms of this work and of the public software", None), (6, "see the License for details", None), (7, prose(400), None), (8, "", None),
    ]
    files += [(10 + i, prose(50), None) for i in range(200)]
    got = license_of_files(spark.createDataFrame([(i, f"d{i}/x.txt", t) for i, t, _ in files], "doc_id long, path string, text string")).collect()
    assert {r.doc_id: r.license for r in got} == {i: x for i, _, x in files}
    assert all(r.score > 0.99 for r in got if r.license)


def test_exact_duplicates_of_one_partition_read_back_in_splits(spark, tmp_path):
    """Equal texts meet although their one run comes back in several splits."""
    from gristmill.llm.exact_dedup import drop_exact_duplicates, exact_duplicates

    conf = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}
    old = {k: spark.conf.get(k) for k in conf}
    spark.sparkContext._jsc.hadoopConfiguration().set("parquet.block.size", "65536")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        df = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.pmod(F.col("id"), F.lit(15_000)).cast("string")).alias("text")).coalesce(1)
        got = exact_duplicates(df).groupBy("kept", "group_size", (F.col("keep_id") < 15_000).alias("low")).count().collect()
        assert {tuple(r) for r in got} == {(True, 2, True, 15_000), (False, 2, True, 15_000)}
        assert drop_exact_duplicates(df).count() == 15_000
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        spark.sparkContext._jsc.hadoopConfiguration().unset("parquet.block.size")


def test_runs_merge_like_a_sort():
    import numpy as np

    from gristmill.llm.exact_dedup import Run, merge_runs

    rng = np.random.default_rng(1)
    expected, runs = {}, []
    for _ in range(7):
        n = int(rng.integers(0, 60))
        words = rng.integers(0, 3, (n, 4)).astype(np.uint64)
        known = rng.random(n) < 0.8
        rest = np.stack([rng.integers(0, 2, n), rng.integers(0, 2, n), np.where(known, rng.integers(0, 50, n), np.iinfo(np.int64).max), rng.integers(0, 9, n), np.ones(n, np.int64)], axis=1)
        for w, r, k in zip(words.tolist(), rest.tolist(), known.tolist(), strict=True):
            key = (*w, *r[:2])
            least, count = expected.get(key, ((True, 0, 0), 0))
            one = (not k, r[2], r[3])
            expected[key] = (min(least, one) if count else one, count + 1)
        run = Run(words, rest, known)
        runs.append(run.take(run.order()).distinct())
    out = merge_runs(runs)
    got = [(*w, *r[:2], (not k, r[2], r[3]), r[4]) for w, r, k in zip(out.words.tolist(), out.rest.tolist(), out.known.tolist(), strict=True)]
    assert got == [(*k, *v) for k, v in sorted(expected.items())]


def test_classifier_sample_is_bounded_in_rows_and_features(spark):
    from gristmill.llm.quality_classifier import bounded_sample, training_rows

    rng = random.Random(4)
    texts = {i: sentence(rng, 30) for i in range(40)}
    docs = spark.createDataFrame([(i, t) for i, t in texts.items() for _ in range(50)] + [(1, "another text")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in texts], "doc_id long, quality int")
    train = training_rows(docs, labels)
    assert bounded_sample(train, max_train=5).num_rows == 5
    everything = bounded_sample(train)
    known = {r.doc_id for r in train.collect()}
    assert known == {i for i in texts if zlib.crc32(str(i).encode()) % 5}
    assert everything.num_rows == len(known) + (1 in known)  # rows of one id and text count once
    sizes = [len(x.as_py()) // 4 for x in everything["ids"]]
    few = bounded_sample(train, max_features=sum(sizes[:7]))
    assert few.num_rows == 7


def test_classifier_against_brute_force(spark):
    """Features, class counts, log-count ratios and scores, one row at a time."""
    import math

    import numpy as np
    from xxhash import xxh3_128_digest

    from gristmill.llm import quality_classifier as Q
    from gristmill.llm.words import window_hashes

    rng = random.Random(8)
    docs = [(i, (sentence(rng, 12) + ("$ %" if i % 3 == 0 else "\n\tz")) if i else None) for i in range(60)]
    table, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 60, 2)], "doc_id long, quality int")

    def feature_set(text):
        words = (text or "").encode().split()
        h = np.array([int.from_bytes(xxh3_128_digest(w)[:8], "little") for w in words], np.uint64)
        out = {int(x) >> 46 for x in h} | {int(x) >> 46 for x in window_hashes(h, 2)}
        b = bytes(32 if c in b" \t\n\x0b\x0c\r" else c for c in (text or "").encode())
        for i in range(len(b) - 2):
            x = np.array([b[i] << 16 | b[i + 1] << 8 | b[i + 2]], np.uint64)
            out.add((int(Q.mix(x)[0]) >> 48) + (1 << 18))
        return out

    sets = {i: feature_set(t) for i, t in docs}
    chosen = [(i, int(i % 3 > 0)) for i in range(0, 60, 2) if zlib.crc32(str(i).encode()) % 5]
    count = {y: Counter(f for i, label in chosen if label == y for f in sets[i]) for y in (0, 1)}
    good, bad = Q.class_counts(Q.training_rows(table, labels))
    assert (good[-1], bad[-1]) == (sum(y for _, y in chosen), sum(1 - y for _, y in chosen))
    assert {f: int(n) for f, n in enumerate(good[:-1]) if n} == count[1] and {f: int(n) for f, n in enumerate(bad[:-1]) if n} == count[0]
    total = {y: sum(count[y].values()) + Q.SIZE for y in (0, 1)}
    ratio = {f: math.log((count[1][f] + 1) / total[1] / ((count[0][f] + 1) / total[0])) for f in count[0] | count[1]}
    scale = Q.log_ratios(good, bad)
    assert all(scale[f] == pytest.approx(r) for f, r in ratio.items()) and np.count_nonzero(scale) <= len(ratio)
    model = Q.fit(table, labels)
    got = {r.doc_id: r for r in Q.classify(table, labels).collect()}
    for i, s in sets.items():
        norm = math.sqrt(sum(ratio.get(f, 0) ** 2 for f in s))
        margin = sum(float(model.weights[f]) for f in s) / max(norm, 1e-12) + model.bias
        score = 1 / (1 + math.exp(-(model.a * margin + model.b)))
        assert got[i].score == pytest.approx(score, abs=1e-4) and got[i].predicted == int(got[i].score >= 0.3)


def test_rules_are_certified_together(spark):
    """Each rule alone would pass with errors below the limit; together they reach it, so the step before is used."""
    from gristmill.llm.quality_rules import GRIDS, STEPS, binomial_tail, cutoffs

    assert {len(g) for *_, g in GRIDS.values()} == {STEPS}
    zero = {c: 0 for c in ("n_symbols", "n_dup_lines", "n_repeat_words", "n_upper")}
    plain = {"stratum": "en", "n_words": 100, "word_chars": 500, "n_lines": 10, **zero}
    rows = [plain] * 1960 + [plain | {"n_symbols": 80}] * 12 + [plain | {"n_upper": 160}] * 14 + [plain | {"n_dup_lines": 4}] * 14
    assert all(binomial_tail(n, 2000, 0.02) <= 0.05 for n in (12, 14, 26)) and binomial_tail(40, 2000, 0.02) > 0.05
    rows += [plain | {"stratum": "few"}] * 20
    got = cutoffs(spark.createDataFrame(rows)).collect()
    assert [r.stratum for r in got] == ["en"]  # 20 documents certify nothing
    step = GRIDS["symbols"][2].index(got[0].symbols)
    assert all(GRIDS[n][2][step] == got[0][n] for n in GRIDS)
    errors = lambda i: sum(80 / 500 >= GRIDS["symbols"][2][i] for _ in range(12)) + sum(160 / 500 >= GRIDS["upper"][2][i] for _ in range(14)) + sum(4 / 10 >= GRIDS["dup_lines"][2][i] for _ in range(14))
    assert errors(step) < 40 and errors(step + 1) >= 40 or binomial_tail(errors(step + 1), 2000, 0.02) > 0.025


def test_near_miss_licenses_are_told_apart(spark):
    from gristmill.llm.licence_texts import NAMES, TEXTS
    from gristmill.llm.licenses import license_of_files

    rng = random.Random(11)
    wrap = lambda t, mark="": "\n".join(f"{mark}{' '.join(t.split()[i : i + 9])}" for i in range(0, len(t.split()), 9))
    mit, bsd2, bsd3 = TEXTS[0][1], TEXTS[2][1], TEXTS[3][1]
    notice = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    files = [
        ("Copyright (c) 2020 Some Body\n\n" + wrap(mit), "MIT"), (wrap(bsd2, " * "), "BSD-2-Clause"), (wrap(bsd3, "// "), "BSD-3-Clause"), (notice, "AGPL-3.0"), (notice.replace("Affero ", ""), "GPL-3.0"), (notice.replace("Affero", "Lesser").replace("program", "library"), "LGPL-3.0"),
        (notice.replace("Affero ", "").replace("version 3", "version 2"), "GPL-2.0"), ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", None),
        ("// SPDX-License-Identifier: LGPL-2.1\nint x;", "LGPL-2.1"), ("GNU LESSER GENERAL PUBLIC LICENSE\n   Version 2.1, February 1999", "LGPL-2.1"), ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007", "GPL-3.0"),
        ("Apache License\n Version 2.0, January 2004\n http://www.apache.org/licenses/", "Apache-2.0"), ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("Released under the Foo License.", None), ("the license of this work is unknown", None),
    ]
    files += [(f"{sentence(rng, 20)} Released under the {name}. {sentence(rng, 20)}", i) for i, name in NAMES.items() if i not in ("CC0-1.0", "Unlicense") and not i.startswith("CC")]
    files += [(sentence(rng, 60) + " the software and its license is free of any version", None) for _ in range(300)]
    got = license_of_files(spark.createDataFrame([(i, f"d{i}/x.txt", t) for i, (t, _) in enumerate(files)], "doc_id long, path string, text string")).collect()
    wrong = [(files[r.doc_id], r.license, r.score) for r in got if r.license != files[r.doc_id][1]]
    assert not wrong


WHOLE = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(WHOLE), reason="needs the texts of long licences")
def test_bodies_of_long_licenses_without_their_headings(spark):
    from gristmill.llm.licenses import license_of_files

    bodies = {"Apache-2.0": ("Apache-2.0", "1. Definitions"), "GPL-2": ("GPL-2.0", "0. This License applies"), "GPL-3": ("GPL-3.0", "0. Definitions"), "LGPL-2.1": ("LGPL-2.1", "0. This License Agreement"), "LGPL-3": ("LGPL-3.0", "0. Additional"), "MPL-2.0": ("MPL-2.0", "1. Definitions")}
    texts = []
    for name, (licence, begin) in bodies.items():
        with open(f"{WHOLE}/{name}") as f:
            body = f.read()
        body = body[body.index(begin) :]
        texts.append((licence, body[: len(body) // 2]))
    three = next(t for licence, t in texts if licence == "GPL-3.0")
    texts.append(("AGPL-3.0", three.replace("version 3 of the GNU General", "version 3 of the GNU Affero General", 1)))
    got = license_of_files(spark.createDataFrame([(i, f"d{i}/LICENSE", t) for i, (_, t) in enumerate(texts)], "doc_id long, path string, text string")).collect()
    assert {r.doc_id: r.license for r in got} == {i: licence for i, (licence, _) in enumerate(texts)}


@pytest.mark.parametrize("share", [0.0, 1e-3, 1.0])
def test_license_scores_do_not_depend_on_how_terms_meet(spark, monkeypatch, share):
    from gristmill.llm import licenses

    monkeypatch.setattr(licenses, "SHARE", share)
    files = [(i, f"d{i}/x.txt", f"some words before and after number {i} Licensed under the MIT License more words about number {i % 3} follow") for i in range(40)]
    got = licenses.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()
    assert len(got) == 40 and {r.license for r in got} == {"MIT"} and all(r.score > 0.99 for r in got)


def test_license_scores_against_brute_force(spark):
    """Every window, every template, dictionaries for vectors."""
    import math

    from gristmill.llm.licence_texts import templates
    from gristmill.llm.licenses import THRESHOLD, scan

    rng = random.Random(12)
    found = templates()
    short = [t for t in found if len(t[1].split()) < 14]
    files = []
    for i in range(60):
        words = rng.choice(short)[1].split()
        for _ in range(rng.randrange(3)):
            words.insert(rng.randrange(len(words)), rng.choice(["alpha", "the", "of", "2"]))
        files.append((i, f"p/{i}", f"{sentence(rng, 12)} the license of {' '.join(words)} {sentence(rng, 9)}" if i % 4 else sentence(rng, 30)))
    files += [(60, "p/60", None), (61, None, files[1][2])]
    tokens = lambda t: re.findall("[a-z0-9]+", lower(t).encode("ascii", "ignore").decode())
    assert all((t or "").isascii() or tokens(t) for *_, t in files)
    split = {i: re.findall("[a-z0-9\x80-\U0010ffff]+", lower(t)) for i, _, t in files}
    df = Counter(w for ws in split.values() for w in set(ws))
    weigh = lambda ws: {w: n * (math.log((1 + len(files)) / (1 + df[w])) + 1) for w, n in Counter(ws).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    best = {}
    for i, ws in split.items():
        top = 0.0
        for _, t in found:
            tw = re.findall("[a-z0-9]+", lower(t))
            u = weigh(tw)
            slack = max(1, len(tw) // 16)
            rare = max((math.log((1 + len(files)) / (1 + df[w])) for w in tw))
            for size in {max(1, len(tw) - slack), len(tw), len(tw) + slack}:
                for s in range(len(ws) - size + 1):
                    v = weigh(ws[s : s + size])
                    if any(w in u and math.log((1 + len(files)) / (1 + df[w])) >= rare - 1e-12 for w in v):
                        top = max(top, sum(x * u.get(w, 0) for w, x in v.items()) / norm(v) / norm(u))
        best[i] = top if top >= THRESHOLD else 0.0
    got = {r.doc_id: r.score for r in scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert sum(x > 0 for x in best.values()) > 20
    off = {i: (got[i], best[i]) for i in best if abs(got[i] - best[i]) > 1e-5}
    assert not off


def test_line_spread_near_a_large_limit(spark):
    """Around a limit of 200 sites the sketch only estimates, and lines near it are counted exactly."""
    from gristmill.llm.line_spread import remove_spread_lines

    spread = {f"on {n} sites": n for n in (20, 150, 196, 199, 200, 201, 204, 260, 400)}
    rows = [(s, "\n".join(x for x, n in spread.items() if s % 400 < n) + f"\nown {s}", f"site {s % 400}") for s in range(600)]
    got = remove_spread_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), least_sites=200).collect()
    gone = {x for x, n in spread.items() if n >= 200}
    assert {r.doc_id: r.kept_text for r in got} == {i: "\n".join(x for x in t.split("\n") if x not in gone) for i, t, _ in rows}


def test_agreeing_words():
    from gristmill.llm.substring_dedup import agreeing

    words = b"a b c d e f g h".split()
    assert agreeing(words, 1, b"b c d".split(), 3) == [(1, 4)] and agreeing(words, 1, b"b c d".split(), 4) == []
    assert agreeing(words, 0, b"a b x d e f".split(), 3) == [(3, 6)] and agreeing(words, 0, b"a b c x e f g".split(), 3) == [(0, 3), (4, 7)]
    assert agreeing(words, 6, b"g h i j".split(), 2) == [(6, 8)]
