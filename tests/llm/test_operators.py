import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from cases import DOCS, frame, saved
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from genoloom.llm import decontaminate, exact_dedup, html_text, minhash, mixing, ngram_lm, periodic_runs, queries, quote_links, shared, simhash, token_counts, toxicity, warc, wordarrays

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def canonical(v):
    return None if v is None or str(v) in ("<NA>", "nan") else round(v, 6) if isinstance(v, float) else v.tolist() if hasattr(v, "tolist") else v


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_gives_what_sql_gives(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.sql(queries.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    rows = lambda t: sorted((tuple(map(canonical, r)) for r in t[sorted(got.columns)].itertuples(index=False)), key=str)
    assert rows(got) == rows(want)


# 1


def test_warc_round_trip_of_odd_pages(spark, tmp_path):
    pages = [(2, "http://a b/\n", "<p>x"), (1, None, "<p>x"), (3, "u", None), (4, "u", ""), (None, "u", "<p>x"), (5, "u", "WARC/1.1\r\n\r\né" * 9), (5, "u", "WARC/1.1\r\n\r\né" * 9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS _key")
    for compression in ("gzip", "none"):
        at = f"file://{tmp_path}/{compression}"
        warc.write_pages(df, at, compression=compression)
        got = sorted(map(tuple, warc.read_pages(spark, at).select("page_id", "payload_bytes", "record_type", "refers_to").collect()), key=str)
        assert got == sorted([(1, 4, "response", None), (2, 4, "revisit", 1), (None, 4, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 126, "response", None), (5, 126, "revisit", 5)], key=str)
        full = spark.read.format("warc").load(at)
        assert {bytes(r.payload).decode() for r in full.filter("record_type = 'response'").collect()} == {"<p>x", "", "WARC/1.1\r\n\r\né" * 9}
        assert [r.target_uri for r in full.filter("record_type = 'revisit' and target_uri like 'http%'").collect()] == ["http://a%20b/%0A"]
        assert full.filter("record_id like 'urn:genoloom:page:x35%'").count() == 2
    at = f"file://{tmp_path}/empty"
    warc.write_pages(df.limit(0), at)
    assert warc.read_pages(spark, at).count() == 0


def test_warc_appends_and_overwrites(spark, tmp_path):
    pages = lambda a, b: spark.range(a, b).selectExpr("id AS page_id", "'u' AS url", "concat('p', id) AS html")
    at = f"file://{tmp_path}/w"
    warc.write_pages(pages(0, 5), at)
    warc.write_pages(pages(5, 8), at)
    assert sorted(r.page_id for r in warc.read_pages(spark, at).collect()) == list(range(8))
    warc.write_pages(pages(8, 10), at, mode="overwrite")
    assert sorted(r.page_id for r in warc.read_pages(spark, at).collect()) == [8, 9]
    assert len(list((tmp_path / "w").glob("_manifest*"))) == 1 and all(f.name.startswith(("part-", "_manifest")) for f in (tmp_path / "w").iterdir())


def test_numbers_of_rows_hold_when_files_are_split_anew(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    spark.range(20_000).selectExpr("id AS doc_id", "repeat(md5(string(id)), 20) AS text").repartition(7).write.parquet(at)
    docs, conf = spark.read.parquet(at), "spark.sql.files.maxPartitionBytes"
    places = []
    try:
        for size in ("128m", "100k", "37k"):
            spark.conf.set(conf, size)
            for t in (docs, docs.filter("doc_id % 3 = 0").select("doc_id"), docs.repartition(3)):
                rows = shared.numbered(t).select("doc_id", shared.RID).collect()
                assert len({r[1] for r in rows}) == len(rows) == t.count()
                if t is not docs and t.columns == ["doc_id"] or t is docs:
                    places.append(dict(map(tuple, rows)))
    finally:
        spark.conf.unset(conf)
    assert all(p.items() <= places[0].items() for p in places)
    assert shared.numbered(docs.limit(0)).count() == 0 and shared.numbered(spark.createDataFrame([(1,)], "a int")).columns == ["a", shared.RID]


def test_listed_numbers(spark):
    own = shared.Listed(spark.range(0, 1000, 3).unionByName(spark.range(0, 9, 3)))
    assert own.has(np.array([0, 1, 3, 998, 999, 5000, -1])).tolist() == [True, False, True, False, True, False, False]
    assert not shared.Listed(spark.range(0)).has(np.arange(5)).any()


def test_warc_reads_members_without_lengths_and_checks_digests(tmp_path):
    import gzip
    import io

    a = warc.record("urn:a", "response", "u", "d", b"x" * 100_000, warc.digest(b"x" * 100_000))
    b = warc.record("urn:b", "response", "u", "d", b"y", warc.digest(b"y"))
    got = list(warc.records(io.BytesIO(gzip.compress(a) + gzip.compress(b)), lambda h: True, True))
    assert [(h["warc-record-id"], n, len(p)) for h, n, p in got] == [("<urn:a>", 100_000, 100_000), ("<urn:b>", 1, 1)]
    only = list(warc.records(io.BytesIO(warc.member(a) + warc.member(b)), lambda h: h["warc-record-id"] == "<urn:b>", False))
    assert [(h["warc-record-id"], n, p) for h, n, p in only] == [("<urn:b>", 1, None)]
    bad = warc.record("urn:c", "response", "u", "d", b"z", warc.digest(b"y"))
    with pytest.raises(ValueError):
        list(warc.records(io.BytesIO(bad), lambda h: True, False, verify=True))


# 2


def by_hand(rows):
    groups = defaultdict(list)
    for n, (i, t, _) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, n))
    out = []
    for k, own in groups.items():
        best = min(own)
        for x in own:
            out.append((rows[x[3]][0], rows[best[3]][0], len(own), x == best, hashlib.sha256(k.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("digits", [32, 1])
def test_exact_dedup(spark, tmp_path, digits):
    docs = saved(spark, tmp_path)
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    got = exact_dedup.decisions(docs, hash_key=lambda n: F.substring(F.md5(n), 1, digits)).drop("_rid")
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[3] for r in by_hand(rows))
    assert exact_dedup.decisions(docs.limit(0)).count() == 0


# 3


def test_decontamination(spark, tmp_path):
    docs = saved(spark, tmp_path)
    items = [(10, "Quick brown FOX jumps over the lazy dog and runs, away"), (2, "word"), (None, "lazy DOG"), (3, None), (4, "..."), (2, "word"), (5, "漢字")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    want = []
    for i, t, _ in DOCS:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            p = words(text)
            n = min(10, len(p))
            wins = {tuple(p[k : k + n]) for k in range(len(p) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit |= set(range(k, k + n))
                    found |= {str(item)} if item is not None else set()
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    for size in (decontaminate.BLOCK_BYTES, 20):
        got = decontaminate.contamination(docs, bench, block_bytes=size).drop("_rid")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert decontaminate.contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.drop_contaminated(docs, bench).count() == sum(not x[5] for x in want)


def test_pieces_of_long_items_have_all_windows(spark):
    words = [f"w{k % 97}" for k in range(500)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "a b"), (None, "x " * 30), (3, None)], "item long, text string").coalesce(1)
    wins = lambda rows: {(i, tuple(w[k : k + 10])) for i, t in rows for w in [(t or "").split()] for k in range(max(0, len(w) - 9))}
    got = [tuple(r) for r in decontaminate.pieces(items, 10, 7).collect()]
    assert wins(got) == wins([tuple(r) for r in items.collect()]) and (2, "a b") in got and max(len(t.split()) for _, t in got) <= 16


def test_tables_of_a_full_block_and_repeated_windows():
    pick = random.Random(1)
    line = "one two three four five six seven eight nine ten eleven"
    rows = [(i, line) for i in range(3000)] + [(-1, "short one"), (-2, "short one")]
    size = sum(len(t) for _, t in rows)
    while size < decontaminate.BLOCK_BYTES:
        rows.append((len(rows), " ".join(f"v{pick.randrange(50_000)}" for _ in range(200))))
        size += len(rows[-1][1])
    tables = decontaminate.compiled(rows)
    assert sum(a.nbytes for t in tables for a in (t.places, t.suffixes, t.first, t.item_from, t.item_to, t.owners, t.shift)) < 16 * size
    import pyarrow as pa

    seg = next(decontaminate.segments(pa.array([f"x {line} y short one", rows[-1][1], "clean text " * 50]), decontaminate.ALNUM))
    (a, x), (b, y), (c, z) = decontaminate.hits(seg, tables)
    assert a == {str(i) for i in range(3000)} | {"-1", "-2"} and sorted(x) == [(1, 10), (2, 10), (13, 2)]
    assert b == {str(rows[-1][0])} and len(y) == 191 and not c and not z


# 4


def test_token_counts(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(token_counts.vocabulary_path())
    want = [(i, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, _ in DOCS]
    got = token_counts.token_counts(frame(spark))
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()), key=str) == sorted(want, key=str)
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got.collect())
    assert token_counts.safe_to_split(token_counts.vocabulary_path())
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in token_counts.op4_token_counts(spark, SF).collect()}
    assert got == {r.doc_id: len(t.encode(r.text, add_special_tokens=False).ids) for r in rows}


def test_token_counts_of_long_texts_without_white_space():
    from tokenizers import Tokenizer

    path = token_counts.vocabulary_path()
    assert token_counts.word_pattern(path) == token_counts.WORDS
    t, c, pick = Tokenizer.from_file(path), token_counts.Counter(path), random.Random(5)
    for chars in ("ab1.,'s|<>", "a'sé2!²e\u0301\u0327。漢Σ", "x<|endoftext|>it's9"):
        whole = "".join(pick.choice([chars, *chars]) for _ in range(3000))
        pieces = token_counts.cut(whole, c.special, 20)
        assert "".join(pieces) == whole and len(pieces) > 20
        assert sum(c.lengths(pieces)) == len(t.encode(whole, add_special_tokens=False).ids)
    long = "abc12.def" * 30_000
    assert max(map(len, token_counts.cut(long, c.special))) < token_counts.LONG + 20
    assert c.count([long, "a" * 200_000]) == [len(t.encode(x, add_special_tokens=False).ids) for x in (long, "a" * 200_000)]


# 5


def test_level_of_sources(spark):
    for sizes, weights, budget, want in (([10, 10, 10], [3, 1, 2], 45, [20.0, 25 / 3, 50 / 3]), ([0, 10], [3, 1], 15, [0.0, 15.0]), ([5, 5], [1, 1], 30, [10.0, 10.0]), ([1, 2, 100], [1, 1, 1], 30, [2.0, 4.0, 24.0])):
        at = mixing.level(spark.createDataFrame(list(zip(sizes, map(float, weights), strict=True)), "n long, w double"), budget)
        assert [min(2.0 * n, n * 2.0 if at is None else at * w) for n, w in zip(sizes, weights, strict=True)] == want
    assert mixing.level(spark.createDataFrame([], "n long, w double"), 0) is None


def test_mixing_of_very_many_sources(spark):
    docs = spark.range(0, 120_000).selectExpr("id AS doc_id", "repeat('w ', CAST(id % 7 AS INT)) AS text", "IF(id % 40 = 0, 'hot', concat('s', id)) AS source")
    out = mixing.mix(docs)[0].agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.sum("taken").alias("taken"), F.sum(F.when(F.col("source_size") > 10, F.col("taken"))).alias("hot"), F.max("target").alias("target")).first()
    assert out.n == 120_000 and 1.499 * out["size"] < out.taken <= 1.5 * out["size"] and abs(out.hot - out.target) < 20


def test_mixing(spark, tmp_path):
    docs = saved(spark, tmp_path)
    out, offers = mixing.mix(docs)
    rows = out.collect()
    assert len(rows) == len(DOCS) and all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert sum(r.taken for r in rows) <= 1.5 * sum(r["size"] for r in rows)
    assert sorted(map(str, mixing.mix(docs)[0].collect())) == sorted(map(str, rows))
    assert mixing.mix(docs.limit(0))[0].count() == 0
    mixed = mixing.mixture(docs)
    assert mixed.columns == [*docs.columns, "mix_size", "source_size", "target", "mix_taken", "copies"]
    assert mixed.count() == offers.select("_rid").distinct().count()


def test_mixing_of_rows_with_one_id(spark, tmp_path, monkeypatch):
    """Nulls, or one id, on every row: their ranges stay small, and the mix is as whole as any."""
    seen, written = {}, shared.written

    def noted(df, name):
        out = written(df, name)
        seen.setdefault(name, out)
        return out

    monkeypatch.setattr(shared, "written", noted)
    at = f"file://{tmp_path}/d"
    spark.range(0, 20_000, 1, 4).selectExpr("CAST(IF(id % 2 = 0, NULL, 7) AS LONG) AS doc_id", "concat_ws(' ', 'a', 'b', id) AS text", "'s' AS source").write.parquet(at)
    docs = spark.read.parquet(at)
    out, offers = mixing.mix(docs)
    rows = out.collect()
    queues = seen["queues"]
    seen.clear()
    assert len(rows) == 20_000 and sum(r.taken for r in rows) == 90_000 and {r.taken for r in rows} == {3, 6}
    assert sorted((str(r.doc_id), r.taken) for r in mixing.mix(docs)[0].collect()) == sorted((str(r.doc_id), r.taken) for r in rows)
    assert max(r["count"] for r in queues.groupBy("_part").count().collect()) < 10_000


# 6


def thue_morse(k):
    a, b = "a", "b"
    for _ in range(k):
        a, b = a + b, b + a
    return a, b


def test_words_of_one_polynomial_hash_differ(spark):
    """Such pairs have equal hashes under any polynomial modulo 2^64."""
    for k in (3, 6, 9, 10, 11, 12):
        a, b = thue_morse(k)
        model = ngram_lm.train(spark.createDataFrame([(a,), (a,)], "text string"))
        got = {r.doc_id: r.n_known for r in ngram_lm.score(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), model).collect()}
        assert got == {1: 2, 2: 1} and model["v"] == 2


def test_hashes_mix_every_byte():
    rng = np.random.default_rng(4)
    words = {bytes(rng.integers(97, 123, int(n)).astype(np.uint8)) for n in rng.integers(1, 40, 20_000)} | {b"x" * n for n in range(1, 600)}
    data = np.frombuffer(b" ".join(words), np.uint8)
    for salt in (0, 1, ngram_lm.CHECK):
        h = wordarrays.Segment(0, data, np.array([0, len(data)]), wordarrays.NOT_SPACE).hashes(salt)
        assert len(np.unique(h)) == len(words)
        bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64).mean(axis=0)
        assert bits.min() > 0.47 and bits.max() < 0.53


def test_clashing_words_take_another_hash(spark, monkeypatch):
    """Words are found to share a hash when counts are added up, and the model is as without the clash."""

    def clashing(*a):
        from genoloom.llm.wordarrays import segments

        for seg in segments(*a):
            real = seg.hashes
            seg.hashes = lambda salt=0, real=real: real(salt) & np.uint64(1) if salt == 0 else real(salt)
            yield seg

    monkeypatch.setattr(ngram_lm, "segments", clashing)
    rows = [("one two two",), ("three one",)]
    df = spark.createDataFrame(rows, "text string").coalesce(1)
    model = ngram_lm.train(df)
    assert (model["salt"], model["v"], model["n"]) == (1, 4, 7)


def test_language_model_against_plain_counts(spark):
    rows = [(i, t) for i, t, _ in DOCS if i != 7] + [(7, "a b " * 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = rows[:6]
    model = ngram_lm.train(spark.createDataFrame(train, "doc_id long, text string"), shard_bytes=40)
    assert len(model["words"]) > 4
    toks = lambda t: WORD.findall(lowered(t)) + ["</s>"]
    uni = Counter(w for _, t in train for w in toks(t))
    bi = Counter(p for _, t in train for p in zip(["<s>", *toks(t)], toks(t), strict=False))
    seen = Counter(bi.values())
    d = ngram_lm.discounts([seen[k] for k in (1, 2, 3, 4)])
    cont = Counter(b for _, b in bi)
    seen = Counter(cont.values())
    low = ngram_lm.discounts([seen[k] for k in (1, 2, 3, 4)])
    off = lambda c, x: x[min(c, 3) - 1] if c else 0
    mass, v, n = sum(off(c, low) for c in cont.values()) / len(bi), len(uni), sum(uni.values())
    total, left = Counter(), Counter()
    for (a, _), c in bi.items():
        total[a] += c
        left[a] += off(c, d)

    def p(w, a):
        lower = max(cont[w] - off(cont[w], low), 0) / len(bi) + mass / (v + 1)
        return max(bi[a, w] - off(bi[a, w], d), 0) / total[a] + left[a] / total[a] * lower if total[a] else lower

    for a in ("<s>", "the", "never"):
        assert math.isclose(sum(p(w, a) for w in uni) + p("??", a), 1)
    want = []
    for i, t in rows:
        w = toks(t)
        want.append((str(i), len(w), sum(uni[x] > 0 for x in w), sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(b, a)) for a, b in zip(["<s>", *w], w, strict=False))))
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.base_score, r.score) for r in ngram_lm.score(df, model).collect())
    for g, x in zip(got, sorted(want), strict=True):
        assert g[:3] == x[:3] and math.isclose(g[3], x[3], rel_tol=1e-9) and math.isclose(g[4], x[4], rel_tol=1e-9)
    assert model["n"] == n and model["v"] == v


def test_language_model_without_training(spark):
    model = ngram_lm.train(frame(spark).limit(0))
    assert all(r.score == 0.0 and r.n_known == 0 for r in ngram_lm.score(frame(spark, extra=False), model).collect())


# 7


def fingerprint(text, n=3):
    w = WORD.findall(lowered(text))
    if not w:
        return 0
    s = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    h = [xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(fps, distance=3):
    parent = list(range(len(fps)))

    def find(i):
        return i if parent[i] == i else find(parent[i])

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, tmp_path):
    docs = saved(spark, tmp_path)
    got = simhash.near_duplicates(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    fps = [fingerprint(r.text) for r in rows]
    root = roots(fps)
    least = [min((r.doc_id for r, x in zip(rows, root, strict=True) if x == own and r.doc_id is not None), default=None) for own in root]
    assert sorted(((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got), key=str) == sorted(((r.doc_id, f, x) for r, f, x in zip(rows, fps, least, strict=True)), key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns


def test_links_lose_nothing(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(12)]
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = simhash.components(simhash.links(spark.createDataFrame([(0, x) for x in signed], "t int, fp long"))).collect()
    root = {r.node: r.root for r in found}
    mine = roots(fps)
    for i in range(len(fps)):
        for j in range(i):
            assert (root.get(signed[i], signed[i]) == root.get(signed[j], signed[j])) == (mine[i] == mine[j])


def test_large_cells_are_exact(monkeypatch):
    rng = np.random.default_rng(4)
    x = np.array([0xABCDEF ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(400)], np.uint64)
    def sets(links, all_):
        parent = {int(v): int(v) for v in all_}
        def find(v):
            while parent[v] != v:
                v = parent[v]
            return v
        for a, b in links:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return sorted(find(int(v)) for v in all_)
    small = simhash.forest(x)
    monkeypatch.setattr(simhash, "LARGE", 16)
    assert sets(simhash.forest(x), np.unique(x)) == sets(small, np.unique(x))


# 8


def test_quote_links(spark):
    rows = [
        (1, 0, "user", "Hello there,\nhow are you?\n\nSecond para of text."), (1, 1, "assistant", "On Monday X wrote:\n> Hello there,\n> how are you?\nI am fine."),
        (1, 2, "user", "> > Hello there,\n> > how are you?\n>\n> I am fine.\nGood."), (1, 3, "user", "> second  PARA of text.\nIndeed."), (2, 0, "user", ">Indeed.\nwhat?"),
        (2, 1, None, None), (2, 1, None, None), (None, None, "user", "x"), (3, 0, "user", "> nothing known\nz"), (3, 2, "user", "> > what?\n> never said\nv"),
    ]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS position", "2 AS _conv").coalesce(1)
    got = {(r.conv_id, r.turn, r.position): r for r in quote_links.conversations(t, least=1).collect()}
    at = {(c, n): (r.thread_conv_id, p, r.depth, r.parent_conv_id, r.parent_turn, r.link, r.text) for (c, n, p), r in got.items()}
    assert at[1, 1] == (1, 1, 1, 1, 0, "quote", "I am fine.")
    assert at[1, 2] == (1, 3, 2, 1, 1, "quote", "Good.")
    assert at[1, 3] == (1, 2, 1, 1, 0, "quote", "Indeed.")
    assert at[2, 0] == (1, 4, 2, 1, 3, "quote", "what?")
    assert at[3, 2][:6] == (1, 6, 3, 2, 0, "quote")  # by the inner level, as the outer is unknown
    assert at[3, 0][3:6] == (None, None, "root") and at[None, None][3:] == (None, None, "root", "x")
    assert sorted(r.depth for (c, n, _), r in got.items() if (c, n) == (2, 1)) == [3, 4]
    assert got[1, 1, 1].formatted == "<|assistant|>\nI am fine." and len(got) == len(rows)
    for r in got.values():  # parents first
        assert r.link == "root" or any(p.conv_id == r.parent_conv_id and p.turn == r.parent_turn and p.position < r.position for p in got.values())
    assert quote_links.conversations(t.limit(0)).count() == 0


def test_conversations_without_quotes_keep_their_order(spark):
    got = quote_links.op8_chat_format(spark, SF).collect()
    assert all(r.position == r.turn == r.depth and r.thread_conv_id == r.conv_id for r in got)
    assert len(got) == spark.read.parquet(f"{SF}/conversations.parquet").count()


def linked_by_hand(rows, least, origins):
    """(conv, turn, place) of each message's parent, by looking at all messages before it. Rows in the order of conversations."""
    marks, by = re.compile(r"^(?:[ \t]*>)+"), re.compile(quote_links.ATTRIBUTION)
    norm = lambda t: re.sub(r"\s+", " ", t.lower()).strip(" ")
    parsed, own = [], []
    for conv, turn, _, text in rows:
        lines = [((m := marks.match(x)) and m[0].count(">") or 0, marks.sub("", x).strip(" ") if marks.match(x) else x.rstrip(" ")) for x in re.split(r"\r\n?|\n", text or "")]
        lines = [x for i, x in enumerate(lines) if not (by.match(x[1]) and i + 1 < len(lines) and lines[i + 1][0] == x[0] + 1)]
        found, run = set(), []
        for i, (level, t) in enumerate(lines):
            if i and (level != lines[i - 1][0] or lines[i - 1][1] == ""):
                run = []
            run.append(norm(t))
            found.add((level, norm(t)))
            if i + 1 == len(lines) or lines[i + 1][0] != level or t == "":
                found.add((level, " ".join(x for x in run if x)))
        parsed.append({x for x in found if x[1]})
        own.append(norm("\n".join(x for level, x in lines if not level).strip()))
    says = defaultdict(list)
    for i, found in enumerate(parsed):
        for level, t in found:
            if not level:
                says[t].append(i)
    out = []
    for i, (conv, _, _, _) in enumerate(rows):
        votes = Counter()
        for level, t in parsed[i]:
            if level:
                near = [j for j in says[t] if rows[j][0] == conv]
                to = near[0] if near and near[0] < i else says[t][0] if says[t] and says[t][0] < i and len(t) >= least and len({own[j] for j in says[t]}) <= origins else None
                if to is not None:
                    votes[level, to] += len(t)
        best = max(votes, key=lambda k: (-k[0], votes[k], -k[1]), default=None)
        before = i - 1 if i and rows[i - 1][0] == conv else None
        out.append(best[1] if best else before)
    return out


def generated_mail(seed):
    """Conversations that quote and nest, here and elsewhere, at length and shortly, with lines that many say."""
    pick, rows = random.Random(seed), []
    words = lambda n: " ".join(pick.choice("alpha beta gamma delta rho sigma tau Omega zeta eta".split()) for _ in range(n))
    for conv in range(60):
        for turn in range(pick.randint(1, 9)):
            parts = []
            for _ in range(pick.choice([0, 0, 1, 1, 2]) if rows else 0):
                near = [r for r in rows if r[0] == conv]
                src = pick.choice(near if near and pick.random() < 0.7 else rows)[3].split("\n")
                if pick.random() < 0.4:
                    parts.append("On Monday someone wrote:")
                parts += [pick.choice([">", "> ", ">  "]) + x for x in (src if pick.random() < 0.6 else [pick.choice(src)])]
                if pick.random() < 0.5:
                    parts.append("")
            parts += [pick.choice(["Thanks!", "ok", "I agree  with this", "", words(pick.randint(1, 9)), words(12)]) for _ in range(pick.randint(1, 4))]
            rows.append((conv, turn, pick.choice(["user", "assistant"]), "\n".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_quotes_are_linked_as_by_hand(spark, seed):
    rows = generated_mail(seed)
    for least, origins in ((quote_links.LEAST, quote_links.ORIGINS), (1, 3)):
        want = linked_by_hand(rows, least, origins)
        got = quote_links.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), least=least, origins=origins)
        found = {(r.conv_id, r.turn): (r.parent_conv_id, r.parent_turn) for r in got.collect()}
        assert found == {r[:2]: (None, None) if p is None else rows[p][:2] for r, p in zip(rows, want, strict=True)}
        assert sum(p is not None and rows[p][0] != r[0] for r, p in zip(rows, want, strict=True)) > 10
        assert sum(p is not None and rows[p][0] == r[0] and rows[p][1] < r[1] - 1 for r, p in zip(rows, want, strict=True)) > 20


def test_short_and_common_passages_stay_in_their_conversation(spark):
    long = "this sentence is said once and long enough to be known again"
    rows = [(1, 0, "user", "Thanks!"), (1, 1, "user", long), (2, 0, "user", "hello"), (2, 1, "user", "> Thanks!\nwelcome"), (3, 0, "user", f"> {long}\nyes"), (4, 0, "user", "a common line that people say very often\n\nand more"), (5, 0, "user", "a common line that people say very often"), (6, 0, "user", "> a common line that people say very often\nno")]
    got = {(r.conv_id, r.turn): (r.parent_conv_id, r.parent_turn, r.link) for r in quote_links.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[2, 1] == (2, 0, "turn") and got[3, 0] == (1, 1, "quote") and got[6, 0] == (None, None, "root")


def test_copies_of_a_message_are_one_origin(spark):
    """Whatever the case and white space; a quotation in a copy says nothing of it."""
    long = "this sentence is said more than once and is long enough to be known"
    rows = [(1, 0, "user", long), (2, 0, "user", long), (2, 1, "user", f"> other words that nobody said before\n\n{long.upper()} "), (3, 0, "user", f"> {long}\nyes")]
    got = {(r.conv_id, r.turn): (r.parent_conv_id, r.parent_turn, r.link) for r in quote_links.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[3, 0] == (1, 0, "quote") and got[2, 0] == (None, None, "root")


# 9

PAGES = [
    (None, ""), ("", ""), ("plain &amp; text\n\n here", "plain & text here"), ("<p>a<p>b &lt;c&gt;<br>d", "a\nb <c> d"),
    ("<nav>menu</nav><article><h1>T</h1><p>x <b>y</b>z<script>if (a<b) {}</script><p>q</article><footer>f</footer>", "T\nx yz\nq"),
    ("<body><header><h1>Site</h1></header><main><article><header><h1>Title</h1></header><p>x y</p><ul><li>one<li>two</ul><form><input>f</form><aside>s</aside></article></main>", "Title\nx y\none\ntwo"),
    ("<div class='content'><h1>T</h1><div><p>first long paragraph of the article here</p><p>and another one that follows it</p></div><div><p>third long paragraph with many words</p><p>Short.</p></div></div><div id=comments><p>nice</p></div><div class='cookie-notice'>We use cookies</div>", "T\nfirst long paragraph of the article here\nand another one that follows it\nthird long paragraph with many words\nShort."),
    ("<article><p title='a>b'>t</p><!-- <p>no --><p>u", "t\nu"), ("<p>1 < 2 and a<b", "1 < 2 and a"),
]


@pytest.mark.parametrize("page, want", PAGES)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def page_without_marks(pick):
    """A page of plain elements without telling names, and its main text."""
    words = lambda n: " ".join(pick.choice("stone water north letter garden winter bridge silver market".split()) for _ in range(n))
    paragraphs = [words(pick.randint(18, 60)).capitalize() + "." for _ in range(pick.randint(4, 9))]
    title = words(5)
    links = lambda n: "<div>" + "".join(f"<a href='/{words(1)}'>{words(2)}</a> " for _ in range(n)) + "</div>"
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    if pick.random() < 0.5:
        k = pick.randint(2, len(paragraphs) - 2)
        body = "".join(f"<p>{p}</p>" for p in paragraphs[:k]) + links(6) * pick.randint(0, 1) + "".join(f"<p>{p}</p>" for p in paragraphs[k:])
    page = f"<html><body>{links(12)}<div><div><h1>{title}</h1><div>{body}</div></div></div>{links(20)}<div><p><a href=/>{words(4)}</a></p></div></body></html>"
    return page, "\n".join([title, *paragraphs])


def test_density_alone_finds_the_text():
    pick = random.Random(7)
    for _ in range(60):
        page, want = page_without_marks(pick)
        assert html_text.main_text(page) == want


def test_reading_takes_time_in_proportion():
    import time

    for page in (lambda n: "<b>" * n + "x" + "</i>" * n, lambda n: "<i><table><tr><td>" + "<b>" * n + "x" + "</i>" * n, lambda n: "<div>" * n + "<header>x</header>" * n):
        took = []
        for n in (3000, 24_000):
            began = time.process_time()
            html_text.tree(page(n))
            took.append(time.process_time() - began)
        assert took[1] < 30 * max(took[0], 0.01)


def test_extraction(spark):
    t = spark.createDataFrame([(n, None if n % 2 else "u", p) for n, (p, _) in enumerate(PAGES)] + [(0, "u", None)], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS id")
    got = html_text.extract(t).collect()
    assert len(got) == len(PAGES) + 1 and all(r.n_chars == len(r.text) and r.text == PAGES[r.page_id][1] for r in got)
    assert html_text.extract(t.limit(0)).count() == 0
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"


# 10


def arcs_of(clause):
    """What the grammar says, by looking around each word of one clause."""
    t, out, done = toxicity, [], -1
    for i, k in enumerate(clause):
        back = lambda n, kinds: any(x in kinds for x in clause[max(0, i - n) : i])  # noqa: B023, E731
        if k in (t.INSULT, t.THREAT):
            mark = "reported" if t.REPORT in clause[:i] else "negated" if back(3, [t.NEGATION]) else "aimed" if back(6, [t.TARGET]) else ""
            out.append(("insult" if k == t.INSULT else "threat") + f"_{mark}" * bool(mark))
        elif k == t.TARGET:
            plain = [j for j in range(max(0, i - 3, done + 1), i) if clause[j] == t.THREAT and arcs_of(clause[: j + 1])[-1] == "threat"]
            out += ["threat_then_target"] * bool(plain)
            done = i
    return out


def test_grammar_against_its_definition():
    nexts, outs = toxicity.compose(*toxicity.GRAMMAR)
    pick = random.Random(3)
    for _ in range(4000):
        clause, state, got = pick.choices(range(6), weights=[6, 2, 2, 2, 1, 0.3], k=pick.randint(0, 14)), 0, []
        for k in [*clause, toxicity.END]:
            if outs[state][k] >= 0:
                got.append(toxicity.KINDS[outs[state][k]])
            state = nexts[state][k]
        assert state == 0 and got == arcs_of(clause), clause


def test_clauses_carry_the_weight():
    m = toxicity.Matcher({"moron": (50, 0)}, 0.1)
    x, arc = m.weight("moron"), toxicity.ARCS
    most = lambda t: m.features(t)[0]
    assert most("what a moron") == x and most("you are a moron") == arc["insult_aimed"] * x
    assert most("he is not a moron") == arc["insult_negated"] * x and most("they said: no. she wrote he is a moron") == arc["insult_reported"] * x
    assert most("I will kill you") == (arc["threat"] + arc["threat_then_target"]) * toxicity.THREAT_WEIGHT
    assert most("kill the process") == arc["threat"] * toxicity.THREAT_WEIGHT and most("nothing here") == most("") == 0
    assert m.features("a moron. a moron!").tolist() == [x, math.log1p(2 * x)]


def test_grammar_decides_scores(spark):
    sf = "/root/testdata/sf0.1"
    of = toxicity._scores(toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")))
    aimed, plain, negated, reported, threat, tool, none = of(["you are a moron", "what a moron day", "you are not a moron", "she wrote you are a moron", "I will kill you", "kill the process", "nothing here"])
    assert aimed > plain > max(negated, reported, none) and min(aimed, plain, threat) >= 0.3 > max(negated, reported, tool, none)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), model).join(labels, "doc_id").filter("held_out").toPandas()
    hit = (got.predicted == 1) & (got.toxic == 1)
    assert hit.sum() / (got.toxic == 1).sum() > 0.85 and hit.sum() / (got.predicted == 1).sum() > 0.85


def test_toxicity_of_odd_rows(spark, tmp_path):
    docs = saved(spark, tmp_path)
    for rows in ([], [(1, 0), (2, 0), (None, 1), (3, None)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        got = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
        assert len(got) == len(DOCS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.drop_toxic(docs, {"lexicon": {}, "prior": 0.5, "weights": None, "share": 0.0}).columns == docs.columns


def test_ids_of_any_type(spark, tmp_path):
    """String ids, and a source column without any value."""
    rows = [("b", "one two  three", None), ("a", "one two three", None), (None, "onetwothree", None), ("a", "other words in this text", None)]
    spark.createDataFrame(rows, "doc_id string, text string, source string").write.parquet(f"file://{tmp_path}/d")
    docs = spark.read.parquet(f"file://{tmp_path}/d")
    assert sorted((str(r.doc_id), r.keep_id, r.kept) for r in exact_dedup.decisions(docs).collect()) == [("None", "b", False), ("a", "a", True), ("a", "b", False), ("b", "b", True)]
    assert {r.component_id for r in simhash.near_duplicates(docs).collect()} >= {"a"}
    assert sorted(str(r.doc_id) for r in mixing.mix(docs)[0].collect()) == ["None", "a", "a", "b"]
    bench = spark.createDataFrame([("x", "three")], "item_id string, text string")
    assert sorted((str(r.doc_id), r.n_items) for r in decontaminate.contamination(docs, bench).collect()) == [("None", 0), ("a", 0), ("a", 1), ("b", 1)]
    assert {r.doc_id for r in token_counts.token_counts(docs).collect()} == {"a", "b", None}
    pages = spark.createDataFrame([("a:b", "u", "<p>x"), ("", "u", "<p>x"), (None, "u", "<p>y"), ("ü", "u", "<p>x")], "page_id string, url string, html string")
    warc.write_pages(pages, f"file://{tmp_path}/w")
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.read_pages(spark, f"file://{tmp_path}/w", "string").collect()) == [("", "response", None), ("None", "response", None), ("a:b", "revisit", ""), ("ü", "revisit", "")]
    void = docs.select("doc_id", "text", F.lit(None).alias("source"))
    assert mixing.mix(void)[0].agg(F.sum("taken")).first()[0] > 0


def test_similar_documents_of_the_tables_are_all_found(spark):
    """All pairs of five-word shingles with a similarity of 0.8 or more, by brute force."""
    docs = shared.numbered(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rows = docs.select(shared.RID, "text").collect()
    sets = []
    for r in rows:
        w = WORD.findall(lowered(r.text))
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    by, want = defaultdict(list), []
    for i, x in enumerate(sets):
        for t in x:
            by[t].append(i)
    for i, x in enumerate(sets):
        for j in {j for t in x for j in by[t] if j < i}:
            if len(x & sets[j]) >= 0.8 * len(x | sets[j]):
                want.append((rows[j][0], rows[i][0]))
    own = {}

    def top(x):
        while own.setdefault(x, x) != x:
            x = own[x]
        return x

    for a, b in simhash.similar_documents(docs).collect():
        own[max(top(a), top(b))] = min(top(a), top(b))
    assert len(want) > 20 and all(top(a) == top(b) for a, b in want)


def test_shared_folder(spark):
    assert shared.root(spark).startswith("file:")


def test_one_of_each_similar_group_stays(spark, tmp_path):
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in rng.permutation(4000)]
    texts = [words[k * 100 : k * 100 + 100] for k in range(12)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    for k in range(8):
        t = list(texts[k])
        t[50] = "edited"
        rows.append((100 + k, " ".join(t)))
    rows += [(3, " ".join(words[3000:3100])), (None, " ".join(words[3200:3300])), (None, " ".join(words[3400:3500]))]  # equal ids of unlike texts
    at = f"file://{tmp_path}/similar"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(at)
    kept = simhash.drop_near_duplicates(spark.read.parquet(at)).collect()
    assert sorted((str(r.doc_id) for r in kept)) == sorted(map(str, [*range(12), 3, None, None]))
    assert not simhash.similar_documents(spark.read.parquet(at), similarity=0.96).collect()


def _similar_groups(spark, tmp_path, texts):
    """Groups of the texts by similar_documents, and by all pairs."""
    at = f"file://{tmp_path}/groups"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(at)
    table = spark.read.parquet(at)
    sets = [{" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    got, want = list(range(len(texts))), list(range(len(texts)))

    def join(parent, a, b):
        a, b = parent[a], parent[b]
        parent[:] = [min(a, b) if x in (a, b) else x for x in parent]

    ids = {r.i: r.doc_id for r in table.selectExpr("monotonically_increasing_id() AS i", "doc_id").collect()}
    for r in simhash.similar_documents(table).collect():
        join(got, ids[r.a], ids[r.b])
    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                join(want, a, b)
    return got, want


def test_similar_documents_of_a_large_group(spark, tmp_path):
    """Variants are similar to their original only, and to the first text of their words not at all."""
    rng = random.Random(3)
    first = [f"w{rng.randrange(4000)}" for _ in range(100)]
    texts = []
    for n in range(120):
        x = list(first)
        for k in range(2):
            x[10 + (7 * n + 40 * k) % 80] = f"v{n}x{k}"
        texts.append(" ".join(x))
    texts.append(" ".join(first))
    base = [f"u{k}" for k in range(60)]
    for _ in range(3):  # one set of words, in other orders, each with a copy
        rng.shuffle(base)
        texts += [" ".join(base), " ".join(base[:-3] + base[-2:] + base[-3:-2])]
    got, want = _similar_groups(spark, tmp_path, texts)
    assert got == want and len(set(want)) == 4


def test_similar_documents_with_added_passages(spark, tmp_path):
    rng = random.Random(4)
    words = lambda n: [f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(n)]
    texts = []
    for n in (50, 100, 300, 1000):
        for _ in range(4):
            x = words(n)
            texts += [" ".join(x), " ".join(x + words(n // 5)), " ".join(words(n // 6) + x)]
    got, want = _similar_groups(spark, tmp_path, texts)
    assert got == want and len(set(want)) < len(texts) / 2


PROSE = "<p>The long river ran past the old mill, and the miller, who had seen it rise before, said that it would fall again by noon.</p>" * 4


@pytest.mark.parametrize("page", [f'<div class="site has-sidebar"><article>{PROSE}</article></div>', f'<div id="social-science">{PROSE}</div>', f"<form>{PROSE}</form>", f'<div class="no-sidebar"><div class="ad">Buy this now.</div>{PROSE}</div>'])
def test_names_are_hints(page):
    text = html_text.main_text(f"<body><nav><a href=x>home</a></nav>{page}<div class=sidebar>Some other words.</div></body>")
    assert text.count("The long river") == 4 and "Buy" not in text and "other" not in text


def test_prose_in_an_article_stays_whatever_its_name():
    text = html_text.main_text(f'<article>{PROSE}<section class="related-work">Others have told of this mill and of its miller before us.</section><div class="related"><a href=x>More</a></div></article>')
    assert "Others have told" in text and "More" not in text


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", "<body><div>{}</div></body>"])
@pytest.mark.parametrize("name", ["comments", "post-comments", "commentList", "newsletter", "newsletter-signup", "ad", "ad-slot top", "cookie-notice", "gdpr_consent", "notice", "sponsored", "share-buttons"])
def test_kinds_of_blocks_go_wherever_they_stand(wrap, name):
    """Also such as are longer than the article, and hold prose without links."""
    own = '<h1>The mill</h1><div class="has-comments">' + PROSE + "</div>"
    for n in (1, 8):
        other = f'<div class="{name}">' + "<p>We like what was said here, and we have said so to our friends.</p>" * n + "</div>"
        for page in (own + other, '<h1>The mill</h1><div>' + other + PROSE + "</div>"):
            text = html_text.main_text(wrap.format(page))
            assert text.count("The long river") == 4 and text.startswith("The mill") and "our friends" not in text


def test_comments_as_articles_go():
    text = html_text.main_text(f'<article><h1>The mill</h1>{PROSE}</article><section id="comments"><article class="comment">I was there, and it was just as they say it was.</article></section>')
    assert text.count("The long river") == 4 and "I was there" not in text


def test_few_links_between_parts_and_many_headings():
    text = html_text.main_text(f"<div><h1>One</h1><h2>Two</h2><h2>Three</h2><div>{PROSE}</div><div><a href=x>Also read this</a> <a href=y>And that</a></div><div>{PROSE.replace('river', 'road')}</div></div>")
    assert text.startswith("One\nTwo\nThree\n") and text.count("long road") == 4 and "Also read" not in text
    assert html_text.main_text(f"<div><h1>One</h1><h2>Two</h2><h2>Three</h2><div>{PROSE}</div></div>").startswith("One\nTwo\nThree\n")


def test_nested_hints_take_time_in_proportion():
    import time

    began = time.process_time()
    html_text.main_text("<article>" + "<div class=related>" * 4000 + "Some words of a sentence that is told here." + "</div>" * 4000)
    assert time.process_time() - began < 0.5


def plainly_chosen(root):
    """Roots of the chosen subtrees by the formulas alone, each figure counted anew by walking the tree."""
    every, walk = [], [root]
    while walk:
        x = walk.pop()
        every.append(x)
        walk += x.children

    def under(x):
        return [x, *(y for c in x.children for y in under(c))]

    chars = lambda x: sum(len(re.sub(r"\s", "", p)) for y in under(x) for p in y.parts if isinstance(p, str))

    def linked(x):
        return chars(x) if x.tag == "a" else sum(linked(c) for c in x.children)

    def density(x):
        c = chars(x)
        if not c:
            return 0.0
        t, lc, lt = max(len(under(x)) - 1, 1), max(linked(x), 1), max(sum(y.tag == "a" for y in under(x)[1:]), 1)
        log = math.log(math.log(c / max(c - linked(x), 1) * linked(x) + linked(root) / max(chars(root), 1) * c + math.e))
        ratio = math.log(c * t / (lc * lt))
        return c / t * (ratio / log if log > 1e-9 else ratio / 1e-3)

    score = {id(x): density(x) for x in every}
    total = {id(x): sum(score[id(c)] for c in x.children) for x in every}
    best = max(total.values())
    top = [x for x in every if total[id(x)] > best - 1e-9]
    x, least = top[0], math.inf
    while x is not None:
        x, least = x.parent, min(least, score[id(x)])
    marked = set()
    for x in every:
        up = x
        while up is not None and score[id(up)] >= least and chars(up):
            up = up.parent
        if up is None:
            most = max(total[id(y)] for y in under(x))
            marked.add(next(id(y) for y in under(x) if total[id(y)] >= most))
    kept = []
    for x in every:
        up, held = x.parent, False
        while up is not None:
            held, up = held or id(up) in marked, up.parent
        if id(x) in marked and not held:
            kept.append(x)
    return top, kept


def test_density_choice_against_its_definition():
    pick, looked_at = random.Random(11), 0
    words = lambda n: " ".join(pick.choice("stone water north letter garden".split()) for _ in range(n))

    def part(depth):
        kind = pick.random()
        if depth == 0 or kind < 0.35:
            return f"<p>{words(pick.randint(1, 40))}</p>"
        if kind < 0.5:
            return f"<div>{' '.join(f'<a>{words(2)}</a>' for _ in range(pick.randint(1, 5)))}</div>"
        return f"<div>{''.join(part(depth - 1) for _ in range(pick.randint(1, 4)))}</div>"

    for _ in range(150):
        root = html_text.tree("".join(part(3) for _ in range(pick.randint(1, 4))))
        top, kept = plainly_chosen(root)
        if len(top) > 1 or html_text._measure(root)[-1].sum <= 0:
            continue
        got = html_text._chosen(root)
        inside = lambda x, tops: any(y is t for t in tops for y in html_text._path(x))
        assert all(inside(x, got) or any(inside(g, [x]) for g in got) for x in kept)
        text = {id(t) for t in kept}
        for g in got:  # anything else is a heading or stands between
            assert any(inside(x, [g]) for x in kept) or inside(g, kept) or g.parent is not None and len(text) > 1
        looked_at += 1
    assert looked_at > 100


def test_articles_side_by_side_stay():
    links = "<div>" + "<a href=x>Another story</a> " * 5 + "</div>"
    text = html_text.main_text(f"<body><div><article>{PROSE}{links}</article><article>{PROSE.replace('river', 'road')}</article></div></body>")
    assert text.count("long river") == 4 and text.count("long road") == 4 and "Another" not in text


# 11


def linked_by_brute_force(rows, shingle=2, percent=80):
    """id, size of the set, component, kept of each of the rows (id, text)."""
    own, parent = {}, {}
    for i, text in rows:
        w = WORD.findall(lowered(text))
        own[i] = {tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
        parent[i] = i

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(own)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(own[a] & own[b])
            if both and 100 * both >= percent * (len(own[a]) + len(own[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(own[i]), find(i), find(i) == i) for i in ids)


def test_minhash_against_brute_force(spark, tmp_path):
    """Edits of one original from a few words to a third, so that many rows share bands and are no links; long blocks too."""
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for family in range(3):
        original = rng.choices(words, k=150)
        for _ in range(60):
            text = list(original)
            for _ in range(rng.choice([0, 1, 2, 4, 6, 8, 10, 14, 20, 40])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + k, " ".join(rng.choices(words, k=rng.randrange(1, 6)))) for k in range(60)]
    rows += [(1000, "a b c d e f"), (1001, "A  b\tc d e F"), (1002, "a b c d e"), (1003, "a b c d"), (1004, "x"), (1005, "X "), (1006, "x x x x"), (1007, ""), (1008, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"file://{tmp_path}/d")
    got = minhash.near_duplicates(spark.read.parquet(f"file://{tmp_path}/d"))
    want = linked_by_brute_force(rows)
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == want
    assert 3 < len({w[2] for w in want if w[0] < 180}) < 180


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_minhash_of_small_blocks(spark, tmp_path, monkeypatch, block):
    """Every pair of rows of one band is looked at, however the band is cut."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(9)
    base = [f"v{k}" for k in range(60)]
    rows = []
    for k in range(80):
        text = list(base)
        for _ in range(rng.randrange(0, 9)):
            text[rng.randrange(60)] = f"n{rng.randrange(12)}"
        rows.append((k, " ".join(text)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/d")
    got = minhash.near_duplicates(spark.read.parquet(f"file://{tmp_path}/d"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got.collect()) == linked_by_brute_force(rows)


def test_circulant_signatures():
    """Coordinate k is the least rank k places after a shingle; the share of equal coordinates follows the similarity."""
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    a, b = h[:300], h[60:360]
    rows = np.repeat([0, 2], [len(a), len(b)])
    got = minhash.signatures(rows, np.concatenate([a, b]), 3)
    place = (minhash.mixed(a ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(minhash.PLACES)).astype(int)
    rank = minhash.ranks()[:, 0]
    assert sorted(rank.tolist()) == list(range(minhash.PLACES))
    for k in (0, 1, 100, 254):
        assert got[0, k] == min(rank[(p + k) % minhash.PLACES] for p in place)
    assert (got[1] == np.iinfo(np.uint32).max).all()
    assert abs((got[0] == got[2]).mean() - 240 / 360) < 0.12


def test_minhash_of_odd_rows(spark, tmp_path):
    docs = saved(spark, tmp_path)
    got = minhash.near_duplicates(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == len(DOCS) and all(r.n_shingles == 0 for i in (4, 5, 6) for r in by[i])
    assert {r.component_id for r in by[2]} == {1} and [r.component_id for r in by[4]] == [4] and [r.kept for r in by[2]] == [False, False]
    assert sorted((r.component_id, r.kept, r.n_shingles) for r in by[None] if r.component_id is not None) == [(1, False, 12)]
    assert [(r.component_id, r.kept) for r in by[None] if r.component_id is None] == [(None, True)]
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == sorted(["1", "4", "5", "6", "None", "7", "8", "9"])
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    text_ids = docs.select(F.concat(F.lit("id:"), "doc_id").alias("doc_id"), "text")
    assert {r.component_id for r in minhash.near_duplicates(text_ids).collect()} >= {"id:1", "id:9", None}


# 12


def runs_by_brute_force(w, minimum=24, times=3):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(minimum, times * q) and not any(w[i + d : i + size] == w[i : i + size - d] for d in range(1, q)):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_against_brute_force(seed):
    """Few words and many, planted repeats side by side, one inside another, and with a word changed."""
    rng = random.Random(seed)
    for _ in range(40):
        w = []
        while len(w) < rng.choice([5, 60, 300]):
            q = rng.choice([1, 2, 3, 5, 8, 13, 40])
            part = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(q)]
            w += (part * rng.randrange(1, 8))[: rng.randrange(1, 8 * q + 1)]
            if rng.random() < 0.3:
                w[-1] = 99
        if rng.random() < 0.3:
            w = w * 4
        assert periodic_runs.find_runs(np.array(w, np.int32)) == runs_by_brute_force(w)
        assert periodic_runs.find_runs(np.array(w, np.int32), 6, 2) == runs_by_brute_force(w, 6, 2)


def test_lags_of_frequent_words_by_transforms_and_of_rare_ones_by_pairs():
    rng = np.random.default_rng(1)
    w = np.where(rng.random(3000) < 0.5, rng.integers(0, 4, 3000), rng.integers(4, 900, 3000)).astype(np.int32)
    want = [0] + [int((w[q:] == w[:-q]).sum()) for q in range(1, 1001)]
    assert periodic_runs.lag_counts(w, 1000)[1:].tolist() == want[1:]


def test_runs_of_long_texts_take_time_in_proportion():
    import time

    rng = random.Random(2)
    for text in (b"x " * 400_000, b" ".join(b"%d" % (k * k % 7919) for k in range(400_000)), b" ".join(rng.choice([b"a", b"b"]) for _ in range(60_000))):
        began = time.process_time()
        w, words = periodic_runs.numbers(text)
        assert [words[i] for i in w[:100].tolist()] == text.split()[:100]
        periodic_runs.find_runs(w)
        assert time.process_time() - began < 10


def test_periodic_runs_query(spark, tmp_path):
    """Whole rows of the query, with the repeats that it makes itself, against the contract written out."""
    from fractions import Fraction
    from zlib import crc32

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op12_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    planted = 0
    for i, text in docs:
        w = WORD.findall(text or "")
        if len(w) > 1200:
            continue
        h, n = crc32(str(i).encode()), len(w)
        if h % 10 == 0 and n:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            planted += 1
        runs = runs_by_brute_force(w)
        top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want = (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))
        assert got[i] == want
    assert planted > 5


def test_periodic_runs_of_odd_rows(spark, tmp_path):
    docs = saved(spark, tmp_path)
    got = periodic_runs.periodic_runs(docs)
    assert got.columns == ["doc_id", "n_words", "runs", "collapsed"] and got.count() == len(DOCS)
    by = {r.doc_id: r for r in got.collect()}
    assert [tuple(x) for x in by[7].runs] == [(0, 180_000, 6)] and by[7].collapsed == "lorem ipsum dolor sit amet consectetur"
    assert (by[4].n_words, by[4].runs, by[4].collapsed) == (0, [], "") and by[6].collapsed == ""
    out = periodic_runs.collapse_runs(docs)
    assert out.columns == docs.columns
    after, before = ({str(r.doc_id): r.text for r in t.collect()} for t in (out, docs))
    assert after["7"] == "lorem ipsum dolor sit amet consectetur" and {k: v for k, v in after.items() if k != "7"} == {k: v for k, v in before.items() if k != "7"}
    assert periodic_runs.periodic_runs(docs.limit(0)).count() == 0
    assert {r.doc_id for r in periodic_runs.periodic_runs(docs.select(F.concat(F.lit("id:"), "doc_id").alias("doc_id"), "text")).collect()} >= {"id:1", None}
