"""Mixing, token files, BPE, near-duplicates, nearest vectors, toxicity and the pipeline, against plain code."""

import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from opsloom.llm import ann, bpe, mixing, neardup, queries, token_file, toxicity
from opsloom.llm.graph import components
from test_text_operators import ODD, _run, prose

tokenizers = pytest.importorskip("tokenizers")
WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def library(name):
    found = tokenizers.Tokenizer.from_file(queries.tokenizer(name))
    found.no_padding(), found.no_truncation()
    return found


def odd_texts(n=400):
    rnd = random.Random(2)
    alphabet = "ab cd\n\tE'sé😀ñ<|>1 9  .,-"
    return ["", " ", "a  b", " lead", "trail ", "x\n", "<|endoftext|> foo<|startoftext|>bar  <|endoftext|>", "ΣΑΣ İstanbul ﬁ é a\x1cb \x1c",
            "it's I'LL don't", "a" * 500, "ab" * 300 + " x" * 3, "日本語 テキスト", " wide nb", "x" * 1000 + "é" * 200, "﻿bom", "\x85z"] + [
            "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_bpe_equals_the_library():
    texts, own = odd_texts(), bpe.Encoder(queries.tokenizer(WORD), cache=300)
    lib = library(WORD)
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 50):
        for (ids, shown), expected in zip(own.encode(texts[at:at + 50]), want[at:at + 50]):
            assert np.frombuffer(ids, "<u4").tolist() == expected
            assert shown == own.decode(ids) == lib.decode(expected, skip_special_tokens=False)


def test_frequent_runs_outlive_the_bound():
    own, spelled = bpe.Encoder(queries.tokenizer(WORD), cache=50), []
    merge = own.vocabulary.merge_many
    own.vocabulary.merge_many = lambda words: spelled.extend(words) or merge(words)
    lib = library(WORD)
    for k in range(20):
        texts = ["the often " + " ".join(f"w{'abcdefghij'[i % 10] * (i // 10 + 1)}{'klmnopqrstuvwxyzabcd'[k]}" for i in range(30)), ""]
        assert [np.frombuffer(ids, "<u4").tolist() for ids, _ in own.encode(texts)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(own.known) <= 50 + 32
    assert spelled.count(b"often") == 1


def test_known_runs_are_no_python_objects():
    own = bpe.Encoder(queries.tokenizer(WORD))
    runs = ["".join("abcdefghij"[int(c)] for c in str(i)) for i in range(30_000)]
    tracemalloc.start()
    try:
        for at in range(0, len(runs), 3000):
            for _ in own.encode([" ".join(runs[at:at + 3000])]):
                pass
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert kept < 100 * len(runs)


def test_short_and_long_words_merge_alike():
    v = bpe.Vocabulary(queries.tokenizer(WORD))
    rnd = random.Random(4)
    words = ["".join(rnd.choice("theinaos") for _ in range(rnd.randint(1, 120))).encode() for _ in range(200)]
    assert [a.tolist() for a in v.merge_many(words)] == [v._long(w).tolist() for w in words]


def test_pieces_equal_the_library():
    texts = odd_texts()
    own = token_file.Pieces(queries.tokenizer(BYTE), cache=100)
    want = [e.ids for e in library(BYTE).encode_batch(texts, add_special_tokens=False)]
    got = [x for at in range(0, len(texts), 50) for x in own.encode(texts[at:at + 50])]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


def test_cores_are_asked_once():
    own, asked, lib = token_file.Pieces(queries.tokenizer(BYTE)), [], library(BYTE)
    own.encode(["a snow flake, snow drift. End"])
    ask = own._ask
    own._ask = lambda texts: asked.extend(texts) or ask(texts)
    texts = ["a flake. snow, drift!? snow.\nNew flake", "a drift.\nNew snow,\nEnd"]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    words = "".join(asked)
    assert words.count("New") == 1 and not any(w in words for w in ("flake", "snow", "drift")), asked


def test_marks_and_line_feeds_equal_the_library():
    rnd = random.Random(8)
    units = [" ", " ", "  ", "\n", "\n\n", "\r\n", "\t", ",", ".", "!?", "'s", "'", "word", "Ñu", "中", "９", "²", "<|endoftext|>", "\x1c", "\xa0", "Ġ", "7"]
    texts = ["".join(rnd.choices(units, k=rnd.randrange(40))) for _ in range(3000)]
    own = token_file.Pieces(queries.tokenizer(BYTE), cache=60)
    got = [x for at in range(0, len(texts), 30) for x in own.encode(texts[at:at + 30])]
    want = [e.ids for e in library(BYTE).encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == want


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_codes_give_random_access(n):
    rnd = np.random.default_rng(n)
    ids = (rnd.integers(0, 2**32, n) >> rnd.integers(0, 32, n)).astype(np.uint32)
    codes = token_file.Codes(token_file.dumps(ids))
    assert len(codes) == n and (codes.read(0, n) == ids).all()
    for i in rnd.integers(0, n, 50 if n else 0).tolist():
        j = int(rnd.integers(i, n + 1))
        assert codes[i] == ids[i] and (codes.read(i, j) == ids[i:j]).all()


def test_token_file_reads_back(documents, spark, tmp_path):
    rows = [(d, t) for d, t in ODD] + [(1000 - i, prose(i, i)) for i in range(40)]
    path = str(tmp_path / "tokens")
    token_file.write_tokens(documents(rows), path, queries.tokenizer(BYTE), part_tokens=200)
    got = token_file.read_tokens(spark, path).orderBy("start").collect()
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    lib, at = library(BYTE), 0
    want = Counter((d, tuple(lib.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in rows)
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    assert _run("op9_bpe", documents(rows).where("false")).count() == 0


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return target | {s: weight[s] * level for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_mix_meets_its_targets(documents):
    rnd = random.Random(6)
    rows = [(i, prose(rnd.randrange(1, 60), i), rnd.choice(["a", "a", "a", "a", "b", "c", "é", "Z", None])) for i in range(300)]
    rows += [(500, None, "empty"), (501, "", "a"), (5, rows[5][1], rows[5][2]), (None, "x y", "b")]
    options = {"block_words": 100, "shard_words": 700}
    got = mixing.mix_plan(documents(rows), **options).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for d, t, s in rows:
        sizes[s] += len((t or "").split())
    for r in got:
        n = sum(d["taken"] for d in r["draws"])
        taken[r["source"]] += n
        assert n <= 2 * r["size"] and r["source_size"] == sizes[r["source"]]
    want = plain_targets(dict(sizes))
    for r in got:
        assert math.isclose(r["target"], want[r["source"]], abs_tol=1e-6)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix_plan(documents(rows), **options).collect()
    key = lambda r: (str(r["doc_id"]), r["order"], str(r["draws"]))
    assert sorted(map(key, got)) == sorted(map(key, again))
    shards = Counter(d["shard"] for r in got for d in r["draws"])
    assert len(shards) == math.ceil(sum(want.values()) / 700)


def test_mixed_rows_are_cut_at_a_word(documents):
    rows = [(i, f" w{i} x y\n z ", "ab"[i % 2]) for i in range(41)]
    out = mixing.mix(documents(rows), block_words=20, shard_words=30).collect()
    words = Counter()
    for r in out:
        words[r["source"]] += len(r["text"].split())
        assert f" w{r['doc_id']} x y\n z ".startswith(r["text"])
    want = plain_targets(Counter({s: 4 * n for s, n in Counter(r[2] for r in rows).items()}))
    assert all(abs(words[s] - want[s]) <= 1 for s in want)


def test_mix_gives_the_rows_of_its_plan(documents):
    rnd = random.Random(8)
    rows = [(i, f"w{i} " + prose(rnd.randrange(1, 30), i), rnd.choice(["a", "a", "a", "b", None])) for i in range(200)]
    rows += [(3, rows[3][1], rows[3][2]), (None, "w x y", "b"), (900, None, "a"), (901, " ", None)]
    options = {"block_words": 100, "shard_words": 500}
    planned, got = Counter(), Counter()
    for r in mixing.mix_plan(documents(rows), **options).collect():
        planned.update((r["doc_id"], r["source"], d["taken"]) for d in r["draws"])
    for r in mixing.mix(documents(rows), **options).collect():
        got[r["doc_id"], r["source"], len(r["text"].split())] += 1
    assert got == planned


def test_mix_shuffles_texts_for_blocks_and_shards_only(documents, capsys):
    """Two branches: the rows of whole blocks meet their draws, the few of cut blocks are numbered; then all go to shards."""
    out = mixing.mix(documents([(i, f"w{i} x y", "abc"[i % 3]) for i in range(60)]), block_words=20, shard_words=30)
    out.explain("formatted")
    steps = capsys.readouterr().out.split("\n\n")
    dealt = [s for s in steps if re.match(r"\(\d+\) Exchange\b", s) and re.search(r"\b(row|text)#", s.split("Arguments")[0])]
    keys = sorted(re.search(r"hashpartitioning\((.*?), \d+\)", s)[1] for s in dealt if "hashpartitioning" in s)
    names = [re.sub(r"#\d+L?", "", k) for k in keys]
    assert names == ["rank, block", "rank, block", "shard"], names


def test_quotas_split_exactly(spark, shared):
    quotas = [0, 1, 7, 1000, 123456, 50]
    row = spark.createDataFrame([(quotas,)], "quotas array<bigint>")
    for shards in (1, 2, 7, 64):
        rows = mixing.split_quotas(row, shards).collect()
        by_source, by_shard = Counter(), Counter()
        for r in rows:
            by_source[r["rank"]] += r["quota"]
            by_shard[r["shard"]] += r["quota"]
            assert r["quota"] >= 0
        assert [by_source[i] for i in range(len(quotas))] == quotas
        assert len(by_shard) == shards and max(by_shard.values()) - min(by_shard.values()) <= math.log2(shards) + 1


def test_hypergeometric_draws_have_the_right_distribution(spark):
    df = spark.range(4000).select(mixing._hypergeometric(F.lit(60).cast("long"), F.lit(20).cast("long"), F.lit(15).cast("long"),
                                                          (F.col("id") + 0.5) / 4000).alias("x"))
    got = Counter(r["x"] for r in df.collect())
    for x in range(16):
        p = math.comb(20, x) * math.comb(40, 15 - x) / math.comb(60, 15)
        assert abs(got[x] / 4000 - p) < 2e-3


def weighted(docs, rows):
    """Exact classes by plain code: every pair, same weights."""
    cells = neardup.document_frequencies(docs.where(F.length(F.trim("text")) > 0).select(F.lit(0).alias("node"), F.col("text").cast("binary").alias("_text")))
    n = sum(bool((t or "").split()) for _, t in rows)
    table = neardup.idf(cells, n)
    import pyarrow as pa
    out = []
    for d, t in rows:
        prints, counts, _ = neardup.shingles(pa.array([(t or "").encode()], pa.binary()))
        out.append((prints, counts.astype(np.float32) * table[(prints % np.uint64(neardup.CELLS)).astype(np.int64)]))
    return out


def test_near_duplicate_classes(documents, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rnd = random.Random(8)
    rows = [(d, t) for d, t in ODD if d is not None]
    for g in range(12):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.randrange(60, 160))]
        for k in range(rnd.choice([1, 2, 5, 25])):
            text = list(base)
            for _ in range(rnd.randrange(0, 4)):
                text[rnd.randrange(len(text))] = f"e{rnd.randrange(9999)}"
            rows.append((100 + g * 50 + k, " ".join(text)))
    docs = documents(rows)
    got = neardup.near_duplicates(docs.withColumn("class_id", F.lit(0)).withColumn("node", F.lit("x"))).collect()
    assert len(got) == len(rows)
    own, parent = weighted(docs, rows), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] == rows[j][1] and (rows[i][1] or "").split()
            if same or (len(own[i][0]) and len(own[j][0]) and neardup.weighted_jaccard(own[i], own[j]) >= 0.8):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    want = Counter((d, min(least[find(i)]) if (t or "").split() else d) for i, (d, t) in enumerate(rows))
    assert Counter((r["doc_id"], r["class_id"]) for r in got) == want
    kept = neardup.first_of_class(docs).collect()
    blank = sum(not (t or "").split() for _, t in rows)
    assert len(kept) == len({c for (d, c) in want if any(x == d and (t or "").split() for x, t in rows)}) + blank


def test_consistent_samples_estimate_similarity():
    rnd = np.random.default_rng(1)
    hits = total = 0
    for _ in range(60):
        prints = np.sort(rnd.choice(1 << 40, 60, replace=False)).astype(np.uint64)
        a, b = rnd.uniform(0.5, 2, 60).astype(np.float32), rnd.uniform(0.5, 2, 60).astype(np.float32)
        sa, _ = neardup.signatures(prints, a, np.zeros(60, np.int64), 1)
        sb, _ = neardup.signatures(prints, b, np.zeros(60, np.int64), 1)
        same = (sa & np.uint64(0xFFFFFFFF)) == (sb & np.uint64(0xFFFFFFFF))
        hits += same.mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()
        total += 1
    assert abs(hits / total) < 0.03


def test_components(spark, shared):
    rnd = random.Random(9)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2060)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_nearest_vectors(spark, shared):
    rnd = np.random.default_rng(3)
    vectors = rnd.normal(size=(900, 12)) * rnd.uniform(0.2, 3, size=(900, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(i, vectors[7].tolist()) for i in range(2000, 2300)]
    odd = [(5000, None), (5020, [0.0] * 12), (5040, [float("nan")] * 12), (5060, [None] * 12), (None, vectors[1].tolist()), (5080, []),
           (5100, [1.0, 2.0]), (5120, [2.0, 1.0]), (20, vectors[20].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = defaultdict(list)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ids, matrix = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    hits = 0
    asked = [(i, v) for i, v in rows if i % 20 == 0]
    for q, v in asked:
        scores = (matrix * np.array(v)).sum(axis=1)
        best = [(int(ids[i]), scores[i]) for i in np.lexsort((ids, -scores)) if ids[i] != q][:20]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        assert all(a[2] > b[2] or (a[2] == b[2] and a[1] < b[1]) for a, b in zip(mine, mine[1:]))
        exact = dict(zip(ids.tolist(), scores))
        assert all(abs(exact[x] - s) < 1e-12 for _, x, s in mine)
        hits += len({x for _, x, _ in mine} & {x for x, _ in best})
    assert hits / (20 * len(asked)) >= 0.97
    assert [x for _, x, _ in got[5100]] == [5120] and set(got) == {q for q, _ in asked} | {5100, 5120}
    assert ann.nearest(df.where("false"), df.where("false")).collect() == []


@pytest.mark.parametrize("long", [1e4, 1e20, 1e150])
def test_a_very_long_vector_hides_no_other(spark, shared, long):
    rnd = np.random.default_rng(4)
    matrix = rnd.normal(size=(1500, 12))
    matrix /= np.linalg.norm(matrix, axis=1)[:, None]
    matrix[700] *= long
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, 1500, 20):
        scores = matrix @ matrix[q]
        scores[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-scores)[:20].tolist()))
    assert hits / (20 * 75) >= 0.97


def test_toxicity_chain(documents, spark):
    rnd = random.Random(12)
    rows, labels = [], []
    for i in range(900):
        words = prose(60, i).split()
        toxic, low = i % 6 == 0, i % 4 == 0
        if toxic:
            words[rnd.randrange(60)] = rnd.choice(["vileword", "nastyone", "nastything"])
        if low:
            words = [w + "***" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not low), int(toxic)))
    docs = documents(rows + [(2000, None), (2001, ""), (None, "x")])
    marks = spark.createDataFrame(labels + [(2000, None, 1), (None, 1, 1), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    held = marks.where("doc_id % 7 > 1")
    categories = {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}
    chain = toxicity.train(docs, held, categories)
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    assert len(got) == 903
    tested = [(i, q, t) for i, q, t in labels if i % 7 <= 1]
    assert sum(got[i]["is_toxic"] == bool(t) for i, _, t in tested) / len(tested) > 0.98
    assert sum(got[i]["is_low_quality"] != bool(q) for i, q, _ in tested) / len(tested) > 0.98
    assert not got[2000]["is_toxic"] and not got[2001]["is_toxic"]
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1  # the later model sees the earlier odds
    none = toxicity.train(docs, marks.where("false"), categories)
    assert not any(r["is_toxic"] for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.where("false"), chain).collect() == []


def test_pipeline(documents, spark, tmp_path):
    import corpus_pipeline
    good = [(i, prose(80 + i, i), "ab"[i % 2]) for i in range(30)]
    bad = [(100, None), (101, ""), (102, "few words"), (103, " ".join(w + "***" for w in prose(90).split()))]
    copies = [(200 + i, good[i][1], good[i][2]) for i in range(5)]
    secret = (300, prose(80, 77) + ' password = "f4K9zQx2LmTq" ' + prose(80, 78), "a")
    documents([*good, *bad, *copies, secret]).withColumn("extra", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in out}
    assert ids <= {r[0] for r in good} | {300} and len(ids) > 20
    sizes = Counter()
    for d, t, s in [*good, secret]:
        sizes[s] += len(t.split())
    counted = {d: c for d, c in Counter(r["doc_id"] for r in out).items()}
    assert max(counted.values()) <= 2
    lib = library(WORD)
    by_id = {r[0]: r[1] for r in good}
    whole = [r for r in out if r["doc_id"] in by_id and
             np.frombuffer(r["ids"], "<u4").tolist() == lib.encode(by_id[r["doc_id"]], add_special_tokens=False).ids]
    assert len(whole) >= len([r for r in out if r["doc_id"] != 300]) - 2
    for r in out:
        assert len(r["ids"]) == 4 * r["n_tokens"]
        if r["doc_id"] == 300:
            assert "f4k9" not in lib.decode(np.frombuffer(r["ids"], "<u4").tolist()).replace(" ", "")
    documents([(1, "x")]).where("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_equal_products_go_to_the_smaller_ids(spark, shared):
    """Different vectors of one inner product with the query: the smaller ids win."""
    rng = np.random.default_rng(2)
    rows = [(0, [1.0, 0.0, 0.0, 0.0])] + [(i, [0.5, *map(float, rng.normal(0, 0.2, 3))]) for i in range(1, 120)]
    df = spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in rows], "vec_id bigint, embedding array<float>")
    got = ann.nearest(df, df.where("vec_id = 0"), width=200).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(1, 21)) and {r.score for r in got} == {0.5}
