"""Each stage against a plain version of itself, on rows with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import defaultdict

import corpus_pipeline
import pytest
from cases import CLASHING, DOCS
from test_operators import by_hand, lowered
from xxhash import xxh64_intdigest

from genoloom.llm import toxicity

SPACE, WORDS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BENCH = [(1, "the ancient harbour lies quiet under seven grey clouds tonight again and sleeps"), (2, "zebra"), (None, "x y z"), (3, None), (4, "")]


def rows_of():
    pick = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    text = lambda n: " ".join(pick.choice(words) for _ in range(n))
    rows, base = list(DOCS), [text(pick.randint(30, 90)) for _ in range(12)]
    for k in range(90):
        t = pick.choice(base).split()
        for _ in range(pick.choice([0, 0, 1, 2, 5])):
            t[pick.randrange(len(t))] = pick.choice(words)
        rows.append((100 + k, " ".join(t), pick.choice(["a", "a", "b", None, "é"])))
    rows += [(300 + k, f"{text(20)} you are a nasty moron and an idiot. {text(9)}", "tox") for k in range(30)]
    rows += [(400 + k, text(25), "ok") for k in range(60)]
    rows += [(500, f"{text(9)} {BENCH[0][1].upper()} {text(9)}", "a"), (501, "a Zebra", "b"), (501, "a Zebra", "b")]
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    extra = [f"'x' AS {c}" for c in CLASHING]
    spark.createDataFrame(rows_of(), "doc_id long, text string, source string").coalesce(3).selectExpr("*", *extra).write.parquet(f"file://{at}/documents.parquet")
    labels = [(300 + k, 1) for k in range(30)] + [(400 + k, 0) for k in range(60)] + [(100 + k, 0) for k in range(90)] + [(None, 1), (1, None), (300, 0)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"file://{at}/labels.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"file://{at}/benchmark.parquet")
    return f"file://{at}"


def clean(rows, model):
    of = toxicity._scores(model)
    return [r for r in rows if of([r[1]])[0] < toxicity.THRESHOLD]


def shingles(w, n):
    return [" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))] if w else []


def fingerprint(t):
    s = shingles(SPACE.findall(lowered(t)), 3)
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def unlike(rows):
    fps, sets = [fingerprint(r[1]) for r in rows], [set(shingles(SPACE.findall(lowered(r[1])), 5)) for r in rows]
    group = list(range(len(rows)))

    def top(k):
        while group[k] != k:
            k = group[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (fps[i] ^ fps[j]).bit_count() <= 3 or both and both >= 0.8 * len(sets[i] | sets[j]):
                group[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for k in sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k)):
        least.setdefault(top(k), k)
    return [r for k, r in enumerate(rows) if least[top(k)] == k]


def uncontaminated(rows):
    wins = defaultdict(set)
    for _, t in BENCH:
        w = WORDS.findall(lowered(t))
        for x in shingles(w, min(10, len(w))):
            wins[min(10, len(w))].add(x)
    return [r for r in rows if not any(x in own for n, own in wins.items() for w in [WORDS.findall(lowered(r[1]))] if len(w) >= n for x in shingles(w, n))]


def mixed(rows):
    size, queues = [len(SPACE.findall(r[1] or "")) for r in rows], defaultdict(list)
    for k, r in enumerate(rows):
        queues[r[2]].append(k)
    names, budget = sorted(queues, key=lambda s: (s is None, s or "")), 1.5 * sum(size)
    offers = []
    for i, s in enumerate(names):
        own = sorted(queues[s], key=lambda k: (hashlib.md5(str("" if rows[k][0] is None else rows[k][0]).encode()).hexdigest(), k))
        at = 0
        for epoch in range(2):
            for k in own:
                at += size[k]
                offers.append((at / (3, 1, 2)[i % 3], hashlib.md5(str("" if rows[k][0] is None else rows[k][0]).encode()).hexdigest(), epoch, k))
    taken, at = defaultdict(int), 0
    for _, _, _, k in sorted(offers):
        at += size[k]
        if at > budget:
            break
        taken[k] += 1
    return sorted(((*rows[k], size[k] * n, n) for k, n in taken.items()), key=str)


def plain(df):
    return sorted((tuple(r) for r in df.select("doc_id", "text", "source").collect()), key=str)


def test_stages_against_plain_versions(spark, tables):
    from genoloom.llm import shared

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    now = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    model = toxicity.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    plainly = {"toxicity": lambda rows: clean(rows, model), "exact_dedup": lambda rows: [rows[k] for k in kept_of(rows)], "simhash_dedup": unlike, "decontaminate": uncontaminated}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = shared.written(stage(spark, docs, tables), name)
        want = plainly[name](now)
        assert got.columns == docs.columns and plain(got) == sorted(want, key=str), name
        assert len(want) < len(now), name
        docs, now = got, [tuple(r) for r in got.select("doc_id", "text", "source").collect()]
    got = corpus_pipeline.STAGES[-1][1](spark, docs, tables)
    new = got.columns[len(docs.columns) :]
    assert got.columns[: len(docs.columns)] == docs.columns and len(new) == 5
    assert sorted((tuple(r) for r in got.select("doc_id", "text", "source", new[3], new[4]).collect()), key=str) == mixed(now)
    assert len(now) > 60 and 300 not in [r[0] for r in now] and not {500, 501} & {r[0] for r in now}


def kept_of(rows):
    groups = defaultdict(list)
    for n, (i, t, _) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, n))
    assert sum(r[3] for r in by_hand(rows)) == len(groups)
    return sorted(min(own)[3] for own in groups.values())


def test_stages_of_an_empty_table(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    docs.limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    none = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        got = stage(spark, none, f"file://{tmp_path}")
        assert got.count() == 0 and got.columns[: len(docs.columns)] == docs.columns


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got.columns[: len(docs.columns)] == docs.columns
    rows = got.collect()
    assert 0.5 * docs.count() < len(rows) <= docs.count() and len({r.doc_id for r in rows}) == len(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "decontaminate", "mix_sources"]
