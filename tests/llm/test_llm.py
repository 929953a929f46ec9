"""Operators against brute force, round trips and held-out accuracy, and their edge cases."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import chroma, common, ctw, decontaminate, langid, nearcopies, packing, queries, secrets, sharding, simhash, toxicity, urls

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, t string, key string, score double"


def frame(spark, rows):
    """rows: (doc_id, text); the further columns clash with names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", "k", 0.5) for i, t in rows], SCHEMA)


EDGE = [(1, None), (2, ""), (3, "word " * 30_000), (4, "same text here now"), (4, "same text here now"), (None, "a null id"), (5, "token = abcdefabcdefabcdef12"), (6, "é漢字 😀 \u0000 end")]


@pytest.fixture(params=["edge", "empty"])
def odd(request, spark):
    return frame(spark, EDGE) if request.param == "edge" else spark.createDataFrame([], SCHEMA)


def _oracle_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    s = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_match_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    for base in range(30):
        words = [rng.choice(vocabulary) for _ in range(60)]
        for _ in range(rng.randint(1, 5)):
            own = list(words)
            own[rng.randrange(60)] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    got = {r.doc_id: r for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    fp = {i: _oracle_fingerprint(t) for i, t in rows}
    assert all(got[i].fp & (1 << 64) - 1 == fp[i] for i, _ in rows)
    root = {i: i for i, _ in rows}
    for i in fp:
        for j in fp:
            if (fp[i] ^ fp[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert {i: got[i].component_id for i in fp} == root


def test_rows_are_told_apart_however_scans_are_cut(spark, tmp_path):
    """The keys of two scans agree though each is cut into other tasks, as when executors come or go in between."""
    path = str(tmp_path / "d")
    frame(spark, [(k % 7, f"text {k} " * 50) for k in range(400)]).repartition(3).write.parquet(path)
    keys = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        d = common.with_row_key(spark.read.parquet(path).select("text", "doc_id"))
        keys.append({bytes(r._row): r.text for r in d.collect()})
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert keys[0] == keys[1] and len(keys[0]) == 400


def test_deduplication_keeps_one_row_of_each_group(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, "quite another text of words"), (None, None), (9, "")]
    kept = simhash.deduplicated(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "a b c d e f"), (5, "quite another text of words"), (9, "")]


def _brute_kept(rows):
    """Ids kept of (id, text), unique ids: the least of each component of 5-word Jaccard >= 0.8."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = {}
    for i, s in sets.items():
        for x in s or {None}:
            holders.setdefault(x, []).append(i)
    for a, b in {(a, b) for own in holders.values() for a in own for b in own if a < b}:
        both = len(sets[a] & sets[b])
        if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and of(a) != of(b):
            root[max(of(a), of(b))] = min(of(a), of(b))
    return {i for i in sets if of(i) == i}


@pytest.mark.parametrize("bucket", [64, 3])
def test_near_duplicate_stage_matches_brute_force(spark, bucket):
    """Copies at all similarities around 0.8, in groups above and below the bucket; sharing a common passage is not enough."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One  two"), (4, "one two three")]
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 150))] + passage
        for _ in range(rng.randint(1, 9)):
            own = list(words)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
    got = nearcopies.deduplicated(frame(spark, rows), bucket=bucket).collect()
    assert len(got) < len(rows) and {r.doc_id for r in got} == _brute_kept(rows)


def test_bitmaps_let_every_similar_pair_pass():
    rng = np.random.default_rng(31)
    far = 0
    for _ in range(2000):
        both, a, b = rng.integers(0, 700), rng.integers(0, 120), rng.integers(0, 120)
        x = rng.integers(-(2**63), 2**63 - 1, both + a + b)
        m, n = both + a, both + b
        passes = nearcopies.could(m, nearcopies.parities(x[:m]), n, nearcopies.parities(np.r_[x[:both], x[m:]]))
        assert passes or 5 * both < 4 * (both + a + b)
        far += passes and 2 * both < both + a + b
    assert far < 100


def test_sets_are_stored_only_of_pairs_that_can_be_similar(spark, monkeypatch):
    """Texts with a tenth of their words in common share shingles of their prefixes, but their sets are neither stored nor shuffled."""
    rng = random.Random(14)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for k in range(40):
        passage = [word() for _ in range(20)]
        rows += [(2 * k + j, " ".join(passage + [word() for _ in range(180)])) for j in range(2)]
    rows += [(1000, rows[0][1] + " one more")]
    asked, whole = [], nearcopies.Texts.whole
    monkeypatch.setattr(nearcopies.Texts, "whole", lambda self, r: asked.append(r.count()) or whole(self, r))
    kept = {r.doc_id for r in nearcopies.deduplicated(frame(spark, rows)).collect()}
    assert kept == _brute_kept(rows) == set(range(80)) and 2 <= sum(asked) <= 8


def test_bitmap_of_shared_shingles_holds_them(spark):
    keys = np.random.default_rng(5).integers(-(2**63), 2**63 - 1, 9000)
    bits = nearcopies.held(spark.createDataFrame([(int(k),) for k in keys], "key long"))
    inside = lambda x: bits[(x & (8 * len(bits) - 1)) >> 3] >> (x & 7).astype(np.uint8) & 1
    assert inside(keys).all() and inside(np.random.default_rng(6).integers(-(2**63), 2**63 - 1, 9000)).mean() < 0.1
    assert not nearcopies.held(spark.createDataFrame([], "key long")).any()


def test_pipeline_stage_drops_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert kept == _brute_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_stages_leave_columns_of_their_own_names_alone(spark):
    names = ("_row", "_some", "_key", "_spans", "_toxicity")
    d = frame(spark, [(1, "token = abcdefghijklmnop"), (2, "other words"), (3, None)])
    for c in names:
        d = d.withColumn(c, F.col("doc_id") * 10)
    labels = spark.createDataFrame([(2, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    for out in (secrets.redact(d), simhash.deduplicated(d), toxicity.acceptable(d, toxicity.learned(d, labels))):
        got = out.collect()
        assert out.columns == d.columns and len(got) == 3 and all(r[c] == 10 * r.doc_id for r in got for c in names)


def test_simhash_blocks_keep_components(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 3, dtype=np.int64)
    fps = np.unique(np.concatenate([b ^ (1 << rng.integers(0, 62, (150, 2))).sum(1) for b in base]))
    d = spark.createDataFrame(pd.DataFrame({"fp": fps}))
    counts = simhash._counted(d, lambda x: np.rint(simhash._bits(x).astype(float).T @ simhash._bits(x)).astype(int).ravel())
    both = np.array([counts.get(k, 0) for k in range(4096)]).reshape(64, 64)
    parts = simhash.correlated_partitions(both, len(fps), 3)
    plan = simhash.Plan(parts, len(fps), 4, simhash._counted(d, simhash.Plan.cells(parts)))
    found = {tuple(r) for r in simhash.connected_components(simhash.links(d, plan, bucket=8, block=16)[0]).collect()}
    want, root = set(), {int(x): int(x) for x in fps}
    for x in fps.tolist():
        for y in fps.tolist():
            if x != y and ((x ^ y) & (1 << 64) - 1).bit_count() <= 4:
                a, b = root[x], root[y]
                if a != b:
                    root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
                want.add(x)
    assert found == {(x, root[x]) for x in want}


def test_allocation_is_least_cost():
    rng = np.random.default_rng(1)
    cost = rng.random((20, 3, 6))
    got = simhash.allocate(cost, 2)
    for q in range(20):
        best = min(((a, b, c) for a in range(6) for b in range(6) for c in range(6) if a + b + c - 3 == 2), key=lambda t: sum(cost[q, i, t[i]] for i in range(3)))
        assert tuple(got[q] + 1) == best


def test_langid_held_out(spark):
    out = queries.op2_langid(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas())
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and out.score.between(0, 1).all()


def test_toxicity_index_is_exact():
    rng = np.random.default_rng(2)
    for often in (1, 4, 10**9):
        toxicity.OFTEN = often
        idf = np.r_[0.0, 1 + np.arange(39) / 7]
        own = [np.sort(rng.choice(40, rng.integers(1, 9), replace=False)) for _ in range(400)]
        index = toxicity.Index(np.arange(40, dtype=np.uint64), idf, np.arange(400), rng.integers(0, 2, 400), [(t, rng.integers(1, 4, len(t))) for t in own], (1.0, 1.0), 0.1, k=9)
        dense = np.zeros((400, 40))
        for n, (t, w) in enumerate(index.vectors):
            dense[n, t] = w
        for _ in range(50):
            t, w = index._unit(np.sort(rng.choice(40, 6, replace=False)), np.ones(6))
            s = dense[:, t] @ w
            n, got = index.nearest(t, w)
            assert np.allclose(got, np.sort(s)[::-1][: len(got)], atol=1e-6) and len(got) == min(9, (s > 0).sum())
    toxicity.OFTEN = 8


def _brute_toxicity(docs, labels, k=15, eps=0.05):
    """doc_id -> score of the query, from dense vectors and the definitions; unique ids, every label learned."""
    toxic = {}
    for i, y in labels:
        if zlib.crc32(str(i).encode()) % 5 and y in (0, 1):
            toxic[i] = max(y, toxic.get(i, 0))
    words = {i: Counter(re.findall(r"[^\W\d_]+", (t or "").lower())) for i, t in docs}
    own = sorted(i for i in toxic if i in words)
    n1 = sum(toxic[i] for i in own)
    n0 = len(own) - n1
    a, b = Counter(), Counter()
    for i in own:
        (a if toxic[i] else b).update(words[i].keys())
    idf = {w: abs(np.log((n0 + 1) / (b[w] + 1)) - np.log((n1 + 1) / (a[w] + 1))) for w in a | b}

    def unit(c):
        v = {w: (1 + np.log(n)) * idf[w] for w, n in c.items() if idf.get(w, 0) > 0}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    vectors = {i: unit(words[i]) for i in own}
    useful = [i for i in own if vectors[i]]

    def vote(v, skip=None):
        s = sorted((-sum(x * v.get(w, 0) for w, x in vectors[i].items()), i) for i in useful if i != skip)
        s = [(-c, i) for c, i in s[:k] if c < 0]
        w = [1 / (1 - min(c, 1) + eps) for c, _ in s]
        return (sum(x * toxic[i] for x, (_, i) in zip(w, s)) / sum(w), [i for _, i in s]) if s else None

    cells = {}
    for i in useful:
        if got := vote(vectors[i], i):
            c = cells.setdefault(round(got[0], 2), [0, 0])
            c[0] += toxic[i]
            c[1] += 1
    xs = sorted(cells)
    y, n = np.array([cells[x][0] / cells[x][1] for x in xs]), np.array([cells[x][1] for x in xs])
    # isotonic means by the min-max formula
    fit = [max(min((y[i : j + 1] * n[i : j + 1]).sum() / n[i : j + 1].sum() for j in range(m, len(xs))) for i in range(m + 1)) for m in range(len(xs))]
    rest = [i for i in own if not vectors[i]]
    blank = sum(toxic[i] for i in rest) / len(rest) if rest else 0.0
    out = {}
    for i, _ in docs:
        got = vote(unit(words[i]))
        out[i] = (float(np.interp(got[0], xs, fit)), got[1]) if got else (blank, [])
    return out


def test_toxicity_query_matches_dense_cosine(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [(r.doc_id, r.toxic) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    want = _brute_toxicity(docs, labels)
    for r in queries.op3_toxicity(spark, SF).collect():
        assert abs(r.score - want[r.doc_id][0]) < 1e-4 and r.predicted == (r.score >= 0.5)
        assert len(set(r.evidence) ^ set(want[r.doc_id][1])) <= 2  # 32-bit weights may swap neighbours of equal cosine


def test_toxicity_of_repeated_ids_and_ties(spark):
    rows = [(1, "bad word"), (1, "bad word"), (1, "nice word"), (2, "fine day"), (3, "bad day"), (3, "bad day"), (7, "bad word")]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (3, 0), (3, None)], "doc_id long, toxic int")
    index = toxicity.fit(frame(spark, rows), labels, F.lit(True))
    assert index.ids[index.rank.argsort()].tolist() == [1, 1, 2, 3] and index.y.sum() == 3
    first, second = (toxicity.fit(frame(spark, r), labels, F.lit(True)).score("bad word day") for r in (rows, rows[::-1]))
    assert first == second


def test_toxicity_held_out(spark):
    out = queries.op3_toxicity(spark, "/root/testdata/sf0.01").toPandas().merge(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas())
    held = out[out.held_out]
    assert (held.toxic == held.predicted).mean() > 0.9


def test_every_labelled_example_is_found_by_its_copy(spark):
    """Among many other toxic rows, the only one of its language, with words no other row has: its copy has it as nearest evidence."""
    rng = random.Random(5)
    plain = [f"w{k}" for k in range(50)]
    rows = [(k, " ".join(rng.choices(plain, k=20)) + (" vile" if k % 2 else "")) for k in range(60)] + [(60, "ilkea gorrotoa"), (61, "ilkea gorrotoa"), (62, "w1 w2")]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)] + [(60, 1, 1)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(frame(spark, rows), labels, F.lit(True))
    score, evidence = index.score("ilkea gorrotoa")
    assert evidence[0] == 60 and score >= 0.5
    assert all(index.score(t)[1] for _, t in rows)
    assert index.score("w1 w2 w3 vile")[0] >= 0.5 > index.score("w1 w2 w3")[0]


def test_first_fit_decreasing_matches_a_scan():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 4097, 500)
    bins, offsets = packing.first_fit_decreasing(lengths)
    room, want = [], {}
    for k in np.argsort(-lengths, kind="stable"):
        at = next((b for b, r in enumerate(room) if r >= lengths[k]), len(room))
        if at == len(room):
            room.append(4096)
        want[k] = at, 4096 - room[at]
        room[at] -= lengths[k]
    assert [(b, o) for b, o in zip(bins, offsets)] == [want[k] for k in range(500)]


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    out = queries.op4_packing(spark, SF).toPandas()
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for i, own in out.groupby("doc_id"):
        ids = np.array([*whole.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        own = own.sort_values("start")
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())
    for _, own in out.sort_values("offset").groupby("sequence_id"):
        assert own.length.sum() <= 4096 and (own.offset.values == np.r_[0, own.length.cumsum()[:-1]]).all()


def test_fast_tokens_equal_the_tokenizer():
    import public_tokenizers
    from foliant.llm.tokens import WordTokenizer

    own = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", "It's HERE, naïve Ωmega ΣΑΣ x²³ 12", "漢字 kana", "a b c\x1cd", "é combining", "<|endoftext|> x", "İstanbul ǅ", "don't can't we're '' ''s"]
    assert [x.tolist() for x in own.many(texts)] == [own.whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_shards_balance_and_keep_groups(spark):
    out = queries.op5_sharding(spark, "/root/testdata/sf0.01").toPandas()
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() < 1.1 * sizes.mean()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in out.groupby("shard"))
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toPandas()
    assert (out.merge(texts).groupby("text").shard.nunique() == 1).all()


def test_decontamination_finds_copies_and_paraphrases(spark):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfghklm" for b in ("ane", "ilo", "ure", "est", "ond", "ark")]
    item = lambda: " ".join(rng.choice(words) for _ in range(40))
    items = [(k, item()) for k in range(20)]
    pad = lambda: " ".join(rng.choice(words) + "q" for _ in range(60))
    changed = items[3][1].split()
    for k in (5, 12, 19, 26):
        changed[k] = "other"
    rows = [(0, pad()), (1, f"{pad()} {items[0][1]} {pad()}"), (2, f"{pad()} {' '.join(changed)} {pad()}"), (3, pad()), (4, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert got == {(1, 0), (2, 3)}
    assert sorted(r.doc_id for r in decontaminate.clean(frame(spark, rows), bench).collect()) == [0, 3, 4]


def test_items_of_any_length_are_verified_whole(spark):
    """Items of 1, 63, 64, 65 and 200 words are found whole; their last word, or a third of them, is no copy."""
    rng = random.Random(19)
    make = lambda n, tag: [f"{tag}{rng.randrange(10**6)}" for _ in range(n)]
    items = {n: make(n, f"i{n}x") for n in (1, 63, 64, 65, 200)}
    rows, want = [], set()
    for n, w in items.items():
        for text, held in ((w, True), (w[-1:], n == 1), (w[: n // 3], False), (w[: int(n * 0.9)], n > 1)):
            rows.append((len(rows), " ".join([*make(70, "p"), *text, *make(70, "q")])))
            if held:
                want.add((rows[-1][0], n))
    bench = spark.createDataFrame([(n, " ".join(w)) for n, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert got.keys() == want and all(r.lcs >= 0.8 for r in got.values())
    split = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), bench, block_words=100).collect()}
    assert split == want  # however the items are dealt to blocks


def test_decontamination_matches_brute_force(spark):
    """All (document, item) pairs by their longest common subsequences, without retrieval."""
    docs = [(r.doc_id, decontaminate.tokens(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bench = [(r.item_id, decontaminate.tokens(r.text), decontaminate._answer(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = set()
    for i, w in docs:
        held = set(w)
        for k, item, answer in bench:
            if sum(map(held.__contains__, item)) < 0.6 * len(item):
                continue
            wide = max(decontaminate.CHUNK, len(item))
            for at in range(0, len(w), decontaminate.STRIDE):
                region = w[max(0, at - wide) : at + 2 * decontaminate.STRIDE + wide]
                own = decontaminate.lcs(item, region) / len(item)
                if own >= 0.8 or (own >= 0.6 and decontaminate.lcs(answer, region) >= 0.5 * len(answer)):
                    want.add((i, k))
                    break
    got = {(r.doc_id, r.item_id) for r in queries.op6_decontaminate(spark, SF).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_paraphrases_are_found(spark):
    """Items with a fifth of their words replaced, left out or followed by another, inside real texts: recall of 0.9 or more."""
    rng = random.Random(4)
    texts = [w for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if 50 < len(w := decontaminate.tokens(r.text)) < 600]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    word = lambda: rng.choice(rng.choice(texts))
    rows, items = [], [(r.item_id, decontaminate.tokens(r.text)) for r in bench.collect()]
    for i, w in items * 3:
        own = [y for x in w for y in rng.choices(([x], [word()], [], [x, word()]), (0.8, 0.1, 0.05, 0.05))[0]]
        host = rng.choice(texts)
        at = rng.randrange(len(host))
        rows.append((len(rows), " ".join([*host[:at], *own, *host[at:]])))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert sum((k, i) in got for k, (i, _) in enumerate(items * 3)) >= 0.9 * len(rows)


def test_lcs():
    def plain(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert decontaminate.lcs(a, b) == plain(a, b)


def test_tree_is_a_distribution_and_matches_recursion():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab c") for _ in range(60)) + b"\xff" for _ in range(20)]
    g, n = np.unique(ctw.byte_grams(texts)[0], return_counts=True)
    top = ctw.Top(*ctw.roots(g, n))
    for context in (0, int.from_bytes(b"ab ab", "big"), int.from_bytes(b"zzzzz", "big")):
        p = 10 ** ctw.codes(g, n, np.array([context << 8 | b for b in range(256)], np.int64), top)
        assert abs(p.sum() - 1) < 1e-9
    whole, held = ctw.codes(g, n, g, top), ctw.HotCodes(g[::2], ctw.codes(g, n, g[::2], top))
    code, missed = held.look(g)
    assert sorted(missed.tolist()) == list(range(1, len(g), 2)) and np.allclose(code[::2], whole[::2])
    # first decision at the root, by the definition
    count = Counter()
    for t in texts:
        h = b"\0" * ctw.DEPTH
        for b in t:
            for d in range(ctw.DEPTH + 1):
                count[h[len(h) - d :], b >> 7] += 1
            h = (h + bytes([b]))[-ctw.DEPTH :]
    seen = {c for c, _ in count}

    def pe(c):
        return float(ctw.kt(np.array([float(count[c, 0])]), np.array([float(count[c, 1])]))[0])

    def pw(c):
        if len(c) == ctw.DEPTH:
            return pe(c)
        kids = [k for k in seen if len(k) == len(c) + 1 and k.endswith(c)]
        return np.logaddexp(pe(c), sum(pw(k) for k in kids)) - np.log(2)

    def p1(c, full):
        own = (count[c, 1] + 0.5) / (count[c, 0] + count[c, 1] + 1)
        deeper = full[len(full) - len(c) - 1 :]
        if len(c) == ctw.DEPTH or deeper not in seen:
            return own
        kids = sum(pw(k) for k in seen if len(k) == len(c) + 1 and k.endswith(c))
        a = 1 / (1 + np.exp(kids - pe(c)))
        return a * own + (1 - a) * p1(deeper, full)

    full = texts[0][: ctw.DEPTH]
    high = np.array([int.from_bytes(full, "big") << 8 | b for b in range(128, 256)], np.int64)
    assert abs((10 ** ctw.codes(g, n, high, top)).sum() - p1(b"", full)) < 1e-9


def test_model_scores_match_one_whole_tree(spark):
    """Cold grams and words, which meet the tables in the join, score as hot ones do, and as one tree on the driver."""
    rng = random.Random(6)
    rows = [(k, " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 5))) for _ in range(30))) for k in range(60)] + [(60, None), (61, "")]
    d = frame(spark, rows)
    text = {i: " ".join((t or "").split()).encode() + b"\xff" for i, t in rows}
    g, n = np.unique(ctw.byte_grams([t for i, t in text.items() if i % 4])[0], return_counts=True)
    top = ctw.Top(*ctw.roots(g, n))
    for limit in (0, 50, 1 << 20):
        got = ctw.score(d, F.col("doc_id") % 4 != 0, hot_words=limit, max_hot=limit).collect()
        assert len(got) == len(rows)
        for r in got:
            asked = ctw.byte_grams([text[r.doc_id]])[0]
            assert abs(r.score - ctw.codes(g, n, asked, top).sum()) < 1e-6


def test_subtrees_may_lie_in_many_partitions(spark):
    counts = ctw.written(ctw.gram_counts(spark.read.parquet(f"{SF}/documents.parquet").select(F.col("text").cast("binary").alias("t"), (F.col("doc_id") % 3 != 0).alias("learned"))))
    one, many = ({r.gram: r.code for r in ctw.gram_codes(counts, size).collect()} for size in (1 << 30, 4096))
    assert one.keys() == many.keys() and all(abs(c - many[k]) < 1e-9 for k, c in one.items())


def test_base_scores(spark):
    out = queries.op7_ctw(spark, SF).toPandas()
    texts = {r.doc_id: r.text.encode().lower().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    learned = {i: w for i, w in texts.items() if zlib.crc32(str(i).encode()) % 10}
    c = Counter(w for t in learned.values() for w in t)
    n, v = sum(c.values()) + len(learned), len(c) + 1
    for r in out.itertuples():
        want = sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in texts[r.doc_id]) + np.log10((len(learned) + 0.1) / (n + 0.1 * (v + 1)))
        assert abs(r.base_score - want) < 1e-6 * abs(want) and r.train_tokens == n


def test_model_beats_the_base_on_held_out_texts(spark):
    """With a thousand documents; with a couple of hundred the byte contexts are too thin (see the README)."""
    held = queries.op7_ctw(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert held.score.sum() > held.base_score.sum()


def test_secret_spans_match_re(spark):
    rows = [(1, 'é password="abcdefghijkl" x'), (2, "token: secret: abcdefghijklmn"), (3, "AKIA" + "A1" * 8 + " deadbeefdeadbeef00"), (4, "API_KEY = short"), (5, None), (6, "Zx9Zx9Zx9Zx9Zx9Zx9Zx9Zq")]
    got = {r.doc_id: r for r in secrets.digests(frame(spark, rows)).collect()}
    assign = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    for i, t in rows:
        found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(t or "") if len(m[2]) >= 12]
        found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 18]
        found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 16]
        assert xxhash and got[i].base_sha256 == __import__("hashlib").sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found)).encode()).hexdigest()
    assert got[6].spans == "generic:0:23"
    masked = {r.doc_id: r.text for r in secrets.redact(frame(spark, rows)).collect()}
    assert masked[1] == "é [SECRET]\" x" and masked[4] == "API_KEY = short" and masked[5] is None


def test_widely_copied_secret_is_an_example(spark):
    rows = [(k, "token = abcdefghijklmnop", "en", f"s{k % 5}") for k in range(20)]
    got = secrets.digests(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert all((r.n_assign, r.n_live, r.n_example) == (1, 0, 1) for r in got)


def test_url_rules(spark):
    rows = [(1, "http://www.EXAMPLE.com/en/x", "allow", "www.example.com/en/"), (2, "https://a.example.com/en/1?q", "block", "example.com/en/"), (3, "http://x.net/es/", "block", "net/es/"), (4, "http://xnet/es/", "allow", None), (5, None, "allow", None), (6, "nothing", "allow", None), (7, "http://b.com", "allow", None), (8, "http://b.com/", "allow", "com/")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame([r[:2] for r in rows], "page_id long, url string"), urls.RuleIndex([])).collect()}
    assert all((got[i].verdict, got[i].rule) == (v, r) for i, _, v, r in rows)


def test_mined_rules_match_brute_force(spark):
    rows = [(f"http://{'spam' if k % 3 == 0 else 'good'}.org/en/{k}", k % 3 == 0) for k in range(300)]
    index = urls.mine(spark.createDataFrame(rows, "url string, block boolean"))
    assert index.size and all((index.confidence(urls.tokens(u)) > 0) == b for u, b in rows)
    kept = [x for own in index.under.values() for x in own]
    for u, _ in rows[:20]:
        assert index.confidence(urls.tokens(u)) == max((c for t, c in kept if t <= set(urls.tokens(u))), default=0.0)


def test_hot_hosts_do_not_crowd_out_other_rules(spark):
    """Two hosts whose URLs share 14 tokens, always blocked, leave room for a rule of lower confidence."""
    deep = "/".join(f"p{k}" for k in range(12))
    rows = [(f"http://hot{k % 2}.org/{k % 2}{deep}/{k}", True) for k in range(200)]
    rows += [(f"http://x{k}.net/shop/{k}", k % 4 != 0) for k in range(100)] + [(f"http://y{k}.com/news/{k}", False) for k in range(200)]
    index = urls.mine(spark.createDataFrame(rows, "url string, block boolean"))
    assert index.confidence(urls.tokens("http://new.net/shop/1")) == 0.75
    assert index.confidence(urls.tokens("http://hot1.org/other")) == 1.0 and index.confidence(urls.tokens("http://new.com/news/1")) == 0
    assert index.size < 50


def test_query_keys_of_deep_urls_are_mined(spark):
    deep = "/".join(f"p{k}" for k in range(14))
    rows = [(f"http://a.org/{deep}/{k}" + ("?utm=1" if k % 3 == 0 else ""), k % 3 == 0) for k in range(300)]
    index = urls.mine(spark.createDataFrame(rows, "url string, block boolean"))
    assert all((index.confidence(urls.tokens(u)) > 0) == b for u, b in rows)


def test_minimal_rules_match_all_subsets(spark):
    """A URL's confidence is that of the best of all its token sets that pass, by definition."""
    from itertools import combinations

    rng = random.Random(7)
    rows = [([x for x in "abcdefg" if rng.random() < 0.5] + ["z"], rng.random() < 0.4) for _ in range(120)]
    index = urls.minimal_rules(spark, rows, 5, 0.6)
    base = sum(b for _, b in rows) / len(rows)
    for own, _ in rows[:40]:
        best = 0.0
        for r in range(1, len(own) + 1):
            for t in combinations(own, r):
                got = [b for o, b in rows if set(t) <= set(o)]
                if sum(got) >= 5 and sum(got) / len(got) >= 0.6 and sum(got) / len(got) > base:
                    best = max(best, sum(got) / len(got))
        assert abs(index.confidence(own) - best) < 1e-12


def _brute_alignments(prints, every=20, most=0.125, least=16):
    """(query, other) -> (share of bit errors, frames) of the best offset, over all offsets of all recordings. prints: id -> integers."""
    out = {}
    for q, x in prints.items():
        for p, y in prints.items() if q % every == 0 else ():
            for d in range(least - len(x), len(y) - least + 1) if len(x) >= least and len(y) >= least and p != q else ():
                a, b = y[max(0, d) : len(x) + d], x[max(0, -d) : len(y) - d]
                e = float(np.bitwise_count(a ^ b).mean()) / 32
                if len(a) >= least and e <= most:
                    out[q, p] = min(out.get((q, p), (1.0, 0)), (e, -len(a)))
    return out


def _tune(rng, n=24):
    return (128 + 60 * np.sin(np.cumsum(np.repeat(rng.uniform(0.1, 1.5, n), 200)))).astype(np.uint8)


def test_chroma_search_matches_brute_force(spark):
    """Cuts at any sample, noise and both: at least nine in ten of all pairs that brute force over all offsets finds, and no other."""
    rng = np.random.default_rng(8)
    rows, noise = [], (0, 0, 1, 2, 4)
    for k in range(120):
        x = _tune(rng)
        y = x[rng.integers(0, 1500) : len(x) - rng.integers(0, 900)].astype(float)
        y = np.clip(y + rng.normal(0, noise[k % 5], len(y)), 0, 255).round().astype(np.uint8)
        rows += [(20 * k, bytes(x)), (20 * k + 1, bytes(y))]
    table = spark.createDataFrame(rows, "doc_id long, pcm binary")
    cuts = chroma.quartiles(table.select(F.col("doc_id").alias("id"), "pcm"))
    want = _brute_alignments({i: chroma.fingerprint(x, cuts) for i, x in rows})
    got = {(r.query_class_id, r.doc_id): r for r in chroma.search(table, "doc_id", "pcm").where("query_class_id is not null").collect()}
    assert len(want) >= 100 and got.keys() <= want.keys() and len(got) >= 0.9 * len(want)
    assert all(abs(r.bit_errors - want[k][0]) < 0.05 for k, r in got.items())


def _overlapping_cuts():
    """Cuts of one recording, a frame apart: most integers lie in over 64 of them."""
    rng = np.random.default_rng(17)
    x = np.concatenate([np.frombuffer(bytes(_tune(rng)), np.uint8) for _ in range(6)])
    return [(k, bytes(x[64 * k : 64 * k + 64 * 90 + 512])) for k in range(200)]


def test_integers_of_many_recordings_still_find_each(spark):
    rows = _overlapping_cuts()
    table = spark.createDataFrame(rows, "doc_id long, pcm binary")
    cuts = chroma.quartiles(table.select(F.col("doc_id").alias("id"), "pcm"))
    want = _brute_alignments({i: chroma.fingerprint(x, cuts) for i, x in rows})
    assert len(want) > 1000
    for block in (1 << 21, 3000):  # all queries at once, and in several blocks
        got = {(r.query_class_id, r.doc_id) for r in chroma.search(table, "doc_id", "pcm", block=block).where("query_class_id is not null").collect()}
        assert got <= want.keys() and len(got) >= 0.98 * len(want)


def test_alignment_by_diagonals_equals_correlation(monkeypatch):
    rng = np.random.default_rng(18)
    for _ in range(200):
        x = rng.integers(0, 2**32, 80, dtype=np.uint32)
        q, p = (x[(a := rng.integers(0, 40)) : a + rng.integers(1, 60)] ^ (rng.integers(0, 2**32, dtype=np.uint32) & np.uint32(7)) for _ in "qp")
        got = chroma.aligned(q, p, 0.125, 8)
        with monkeypatch.context() as m:
            m.setattr(chroma, "SMALL", 0)
            assert got == chroma.aligned(q, p, 0.125, 8)


def test_chroma_rows(spark):
    """Copies, short and null recordings, a class without an id, offsets, and equal offsets: errors tie on a constant recording."""
    rng = np.random.default_rng(9)
    x = bytes(_tune(rng))
    flat = bytes([128]) * 3000
    rows = [(20, x), (21, x[640:]), (7, x), (8, None), (9, b""), (None, x[1280:]), (None, x[1280:]), (40, flat), (41, flat[:2600]), (60, b"ab"), (61, b"ab")]
    out = chroma.search(spark.createDataFrame(rows, "doc_id long, pcm binary"), "doc_id", "pcm").collect()
    members = Counter((r.doc_id, r.class_id) for r in out)
    assert {(20, 7), (7, 7), (8, 8), (9, 8), (None, None), (60, 60), (61, 60)} <= set(members)
    found = {(r.doc_id, r.query_class_id): r for r in out if r.query_class_id is not None}
    assert found[21, 7].offset == -10 and found[None, 7].offset == -20 and found[41, 40].offset in (0, None)
    assert all(r.links == 1 for r in out if r.class_id in (21, 41) or (r.doc_id is None and r.query_class_id))
    assert len({(r.doc_id, r.class_id, r.frames) for r in out}) == len({(i, len(t or b"")) for i, t in rows})


@pytest.mark.parametrize("name", ["simhash", "langid", "packing", "sharding", "decontaminate", "ctw", "secrets", "chroma", "toxicity"])
def test_edge_cases(spark, odd, name):
    import public_tokenizers

    n = odd.count()
    labels = spark.createDataFrame([(2, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, "same text here now"), (2, ""), (3, None)], "item_id long, text string")
    run = {
        "simhash": lambda: simhash.near_duplicates(odd).count() == n and (n == 0 or simhash.near_duplicates(odd).where("keep").count() < n),
        "langid": lambda: langid.identify(odd).count() == n,
        "packing": lambda: packing.pack(odd, public_tokenizers.path("word_bpe_49k.json")).agg(F.coalesce(F.count_if(F.col("start") == 0), F.lit(0)).alias("n")).first().n == n,
        "sharding": lambda: sharding.shard(odd).count() == n,
        "decontaminate": lambda: decontaminate.contaminated(odd, bench).count() == (2 if n else 0),
        "ctw": lambda: ctw.language_model(odd).where("score is not null and base_score is not null").count() == n,
        "secrets": lambda: secrets.digests(odd).count() == n and secrets.redact(odd).columns == odd.columns,
        "chroma": lambda: chroma.search(odd, "doc_id", "text").count() == n,
        "toxicity": lambda: toxicity.assess(odd, labels).count() == n and toxicity.acceptable(odd, toxicity.learned(odd, labels)).columns == odd.columns,
    }[name]
    assert run()


def test_pipeline_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, SF))
        assert out.columns == docs.columns and 0 < out.count() <= kept, name
        docs, kept = out, out.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == kept


def _written(spark, path, docs):
    """A folder of tables for the pipeline: docs, a few labels and benchmark items."""
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(2, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "an item of its own with ten words or so"), (2, ""), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_on_odd_tables(spark, odd, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns, an empty table: one copy of each clean text is packed."""
    out = corpus_pipeline.run(spark, _written(spark, tmp_path / "t", odd)).where("start = 0").collect()
    n = odd.count()
    assert sorted((r.doc_id for r in out), key=str) == ([1, 3, 5, 6, None] if n and not any(r.doc_id == 4 for r in out) else [1, 3, 4, 5, 6, None] if n else [])


@pytest.mark.parametrize("stage", ["deduplicated", "near", "clean", "urls"])
def test_more_edge_cases(spark, odd, stage):
    n = odd.count()
    bench = spark.createDataFrame([(1, "same text here now"), (2, ""), (3, None)], "item_id long, text string")
    if stage == "clean":
        assert decontaminate.clean(odd, bench).count() == max(0, n - 2) and decontaminate.clean(odd, bench.limit(0)).count() == n
    elif stage == "urls":
        pages = odd.withColumn("page_id", F.col("doc_id")).withColumn("url", F.when(F.col("doc_id") == 3, F.concat(F.lit("http://a.org/"), F.repeat(F.lit("x/"), 50_000))).otherwise(F.col("text"))).withColumn("confidence", F.lit(7)).withColumn("host", F.lit("h"))
        labels = spark.createDataFrame([(3, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
        for known in (labels, labels.limit(0)):
            got = urls.filtered(pages, known).collect()
            assert len(got) == n and {r.verdict for r in got} <= {"allow"} and all((r.host == "a.org") == (r.page_id == 3) for r in got)
    else:
        out = (simhash if stage == "deduplicated" else nearcopies).deduplicated(odd)
        assert out.columns == odd.columns and out.count() == (n - 2 if n else 0)


def test_packing_does_not_hang_on_how_the_scan_is_cut(spark, tmp_path):
    """Repeated rows and pieces of equal length included."""
    import public_tokenizers

    path = str(tmp_path / "d")
    frame(spark, [(k % 50, f"text {k % 9} " * (k % 7 * 300)) for k in range(200)]).repartition(3).write.parquet(path)
    before, got = spark.conf.get("spark.sql.files.maxPartitionBytes"), []
    for size in ("128m", "2k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got.append(sorted(map(tuple, packing.pack(spark.read.parquet(path), public_tokenizers.path("word_bpe_49k.json"), group_pieces=64).collect())))
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got[0] == got[1]


def test_shards_match_brute_force(spark):
    """Sizes, digests, slots and groups, recomputed from the texts."""
    out = queries.op5_sharding(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(out) == len(texts)
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw)) and r.law == "bytes" and r.grown_shard is None
    slots, home = {}, {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
        assert home.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and slots.keys() == set(range(8))


def test_median_splits_match_brute_force(spark):
    """Each split of the tree lies at the weighted median of its node, along the dimension of the widest weighted spread."""
    rng = random.Random(21)
    rows = [(k, rng.randint(1, 50), rng.random(), rng.random() * 0.3) for k in range(400)]
    groups = spark.createDataFrame([(w, k, x, y) for k, w, x, y in rows], "weight long, tie long, a double, b double")
    nodes, node = sharding.kd_leaves(groups, ["a", "b"], 4)
    of = {r.tie: r.n for r in groups.select("tie", node.alias("n")).collect()}
    inside = {0: set(of)}
    for n, x in nodes.items():
        own = [r for r in rows if r[0] in inside[n]]
        total = sum(r[1] for r in own)
        if not x.children:
            assert {k for k, m in of.items() if m == n} == inside[n]
            continue
        spread = []
        for d in (2, 3):
            mean = sum(r[1] * r[d] for r in own) / total
            spread.append(sum(r[1] * (r[d] - mean) ** 2 for r in own))
        assert x.dim == spread.index(max(spread)) and x.weight == total
        own.sort(key=lambda r: r[2 + x.dim])
        best = min(range(len(own) + 1), key=lambda k: abs(sum(r[1] for r in own[:k]) - total / 2))
        left = {k for k in inside[n] if any(of[k] == c or of[k] in nodes[c].children for c in x.children[:1])}
        assert abs(sum(r[1] for r in own if r[0] in left) - total / 2) <= abs(sum(r[1] for r in own[:best]) - total / 2) + total / 1000 + 50
        inside[x.children[0]], inside[x.children[1]] = left, inside[n] - left


def test_langid_matches_brute_force(spark):
    """Word log frequencies, and for unseen words the longest known n-grams, by the definitions on plain dictionaries."""
    rows = [(1, "the cat sat on the mat", "en"), (2, "the dog sat", "en"), (4, "le chat est sur le tapis", "fr"), (5, "le chien est grand", "fr"), (6, None, "fr")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(d, F.lit(True))
    count, docs = {}, Counter(x for *_, x in rows)
    for _, t, x in rows:
        for w in (t or "").split():
            count.setdefault(w, Counter())[x] += 1
    langs = ["en", "fr"]
    seen = {x: sum(c[x] for c in count.values()) for x in langs}
    known = {w: c for w, c in count.items() if sum(c.values()) >= 2}
    grams = {}
    for w, c in count.items():
        m = f"<{w}>"
        for n in range(1, 6):
            for k in range(len(m) - n + 1):
                for x in c:
                    g = grams.setdefault(m[k : k + n], Counter())
                    g[x] += np.sqrt(c[x])
    total = {(n, x): sum(g[x] for s, g in grams.items() if len(s) == n) for n in range(1, 6) for x in langs}

    def score(text, x):
        out = np.log(docs[x] / len(rows))
        for w in text.split():
            if w in known:
                out += np.log((known[w][x] + 0.05) / (seen[x] + 0.05 * (len(known) + 1)))
                continue
            m, k = f"<{w}>", 0
            while k < len(m):
                n = next((n for n in range(min(5, len(m) - k), 0, -1) if m[k : k + n] in grams), 0)
                if n:
                    out += np.log((grams[m[k : k + n]][x] + 0.05) / (total[n, x] + 0.05 * (len(grams) + 1)))
                k += n or 1
        return out

    for text in ("the chat", "tapis mat zzz", "catte", "un grand doggo est the", "q"):
        s = np.array([score(text, x) for x in langs])
        p = np.exp((s - s.max()) / np.sqrt(len(text.split())))
        lang, got = model.predict(text)
        assert lang == langs[s.argmax()] and abs(got - p.max() / p.sum()) < 1e-4, text
    assert model.predict(None) == model.predict("12 ?!") == ("und", 0.0)


def test_many_spans_of_one_text(spark):
    """Thousands of spans, some touching base spans: the same as a plain scan."""
    rng = random.Random(13)
    parts = []
    for _ in range(1500):
        parts.append(rng.choice([f"token = {rng.getrandbits(64):016x}", "Zq9" + "".join(rng.choice("aB3x/=") for _ in range(25)), f"{rng.getrandbits(80):020x}", "word", 'secret="Ab1-"x', "Key9Zz" + f"{rng.getrandbits(64):016x}Xy", "\x01"]))
    text = " ".join(parts)
    base = []
    for kind, p, g, least in secrets.BASE:
        base += [(m.start(), kind, m.end()) for m in re.finditer(p.replace("(?i:password|passwd|secret|token|api_?key)", "(?:[Pp]assword|passwd|secret|token|api_?key)"), text) if len(m[g]) >= least]
    more = [(m.start(), "generic", m.end()) for m in re.finditer(secrets.FURTHER[1], text) if re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0])]
    starts = sorted((a, b) for a, _, b in base)
    apart = [x for x in more if not any(a < x[2] and x[0] < b for a, b in starts)]
    got = secrets.digests(frame(spark, [(1, text)])).first()
    assert sorted(got.spans.split(",")) == sorted(f"{k}:{a}:{b}" for a, k, b in base + apart) and len(apart) < len(more)


def test_fast_tokens_equal_the_tokenizer_on_random_texts():
    import public_tokenizers
    from foliant.llm.tokens import _RANGE, WordTokenizer

    own = WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(17)
    chars = [c for c in _RANGE if ord(c) not in range(0xD800, 0xE000)] + [chr(k) for k in (*range(0x2000, 0x2070), *range(0x20A0, 0x20C0), 0x4E2D, 0x1F600, 0x3A3, 0x301)]
    texts = ["".join(rng.choices(chars, k=rng.randint(1, 60))) for _ in range(400)] + [f"a{c}b {c}{c} 'S{c}" for c in chars]
    assert all((a == b).all() for a, b in zip(own.many(texts), (own.whole.encode(t, add_special_tokens=False).ids for t in texts), strict=True) if len(a) == len(b)) and [len(a) for a in own.many(texts)] == [len(own.whole.encode(t, add_special_tokens=False).ids) for t in texts]


def test_toxicity_learns_every_labelled_row(spark):
    """More rows of a class than a sample held, each with a word of its own, in several shards: each is its copy's nearest."""
    rows = [(k, f"own{k} w{k % 7}".translate({ord("0") + d: c for d, c in enumerate("abcdefghij")}) + (" vile" if k % 4 == 0 else "")) for k in range(13_000)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(frame(spark, rows), labels, F.lit(True))
    assert sorted(model.ids.tolist()) == [k for k, _ in rows] and len(model.shards) > 1
    asked = rows[::401]
    assert [e[0] for _, e in model.scores([t for _, t in asked])] == [k for k, _ in asked]


def test_toxicity_shards_match_one_index(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    one = toxicity.assess(docs, labels).select("doc_id", "score", "evidence").orderBy("doc_id", "score").collect()
    monkeypatch.setattr(toxicity, "SHARD", 9)
    model = toxicity.learned(docs, labels)
    assert len(model.shards) > 3
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r, (score, evidence) in zip(one, model.scores([texts[r.doc_id] for r in one]), strict=True):
        assert abs(r.score - score) < 1e-4 and len(set(r.evidence) ^ set(evidence)) <= 2


def test_toxicity_driver_makes_no_index(spark, monkeypatch):
    """The driver's memory holds a packed shard at most: indexes are made in tasks, which don't see what is replaced here."""
    rng = random.Random(8)
    rows = [(k, " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(40)) + " vile" * (k % 3 == 0)) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SHARD", 100)
    with monkeypatch.context() as m:
        m.setattr(toxicity.Index, "__init__", lambda *_: pytest.fail("an index is made on the driver"))
        model = toxicity.fit(frame(spark, rows), labels, F.lit(True))
    assert len(model.shards) > 3 and sorted(model.ids.tolist()) == [k for k, _ in rows]
    postings = sum(len(set(t.split())) for _, t in rows)
    assert sum(len(b.value) for b in model.shards) < 40 * postings
    assert [e[0] for _, e in model.scores([t for _, t in rows[::50]])] == [k for k, _ in rows[::50]]


def test_toxicity_shards_lie_in_no_memory(spark, monkeypatch):
    """Blocks of broadcasts stay in the driver's memory, which all shards together would fill. Ids are broadcast in parts."""
    rng = random.Random(9)
    rows = [(k, " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(300)) + " vile" * (k % 3 == 0)) for k in range(600)]
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _ in rows], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SHARD", 60)
    monkeypatch.setattr(toxicity, "PICKED", 150, raising=False)

    def held():
        spark._jvm.System.gc()
        memory = spark._jsc.sc().getExecutorMemoryStatus().head()._2()
        return memory._1() - memory._2()

    before = held()
    model = toxicity.fit(frame(spark, rows), labels, F.lit(True))
    assert len(model.shards) > 3 and sorted(model.ids.tolist()) == [k for k, _ in rows]
    packed = sum(len(x.value) for x in model.shards)
    assert packed > 2_000_000 and held() - before < packed / 4
    found = toxicity.with_scores(frame(spark, rows), model).select("doc_id", "_toxicity.evidence").collect()
    assert len(found) == 600 and all(r.evidence[0] == r.doc_id for r in found)


@pytest.mark.parametrize("most", [1, 3, 255, 256, 70_000])
def test_toxicity_packed_index(most):
    rng = np.random.default_rng(most)
    own = [np.sort(rng.choice(300, rng.integers(0, 30), replace=False)) for _ in range(200)]
    counts = [(t, rng.integers(1, most + 1, len(t))) for t in own]
    index = toxicity.Index(np.arange(300, dtype=np.uint64), np.r_[0.0, 1 + np.arange(299) / 7], np.arange(200), rng.integers(0, 2, 200), counts, (1.0, 1.0), 0.1, k=5)
    again = toxicity.Index.unpacked(index.packed())
    for name in ("terms", "idf", "ids", "y", "ties", "rank", "first", "doc", "count", "value", "often", "dense", "most"):
        assert np.array_equal(getattr(index, name), getattr(again, name)), name
    asked = [(*index._unit(*c), -1, 0.0) for c in counts]
    for alone, (n, s), (m, r) in zip(asked, index.many(asked), again.many(asked), strict=True):
        one = index.nearest(*alone)
        assert n.tolist() == m.tolist() == one[0].tolist() and s.tolist() == r.tolist() == one[1].tolist()


def test_freed_memory_goes_back():
    """Small arrays freed around one that stays: without settle() the C library keeps their pages."""

    def resident():
        return int(re.search(r"VmRSS:\s+(\d+)", open("/proc/self/status").read())[1]) / 1024

    held = [np.ones(1000) for _ in range(20_000)]
    full, last = resident(), held[-1]
    del held
    common.settle()
    assert resident() < full - 100 and last[0] == 1
