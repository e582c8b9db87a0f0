"""The opN_ queries against SQL in another engine, brute force, or held-out rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import bpe, components, lines, mixing, queries, rules, simhash, topk, toxicity


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, db, name):
    got = queries.queries()[name](spark, sf_dir)
    rel = db.sql(queries.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(rel.columns)
    want = rel.project(", ".join(names)).fetchall()
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, want))


def brute(fps, most=3):
    """Components by all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= most)[0]:
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash_brute(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").toPandas()
    fps = np.array([simhash.fingerprint(t) for t in docs.text], np.uint64)
    want = {int(d): (f"{int(f):016x}", int(docs.doc_id[r])) for d, f, r in zip(docs.doc_id, fps, brute(fps), strict=True)}
    got = queries.op4_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want


@pytest.mark.parametrize("dense", [2, 2048])
def test_links_of_crowded_keys(spark, dense):
    """Thousands of fingerprints around one, and chains, by plain and refined keys."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 1, dtype=np.uint64)
    crowd = base ^ (np.uint64(1) << rng.integers(0, 64, (400, 3), dtype=np.uint64)).sum(axis=1).astype(np.uint64)
    far = base ^ rng.integers(0, 2**32, 300, dtype=np.uint64)  # share one segment, mostly nothing else
    fps = np.unique(np.concatenate([crowd, far, rng.integers(0, 2**63, 200, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in components.components(simhash.links(df, dense)).collect()}
    want = brute(fps)
    signed = fps.view(np.int64)
    groups = {}
    for i, r in enumerate(want):
        groups.setdefault(r, []).append(int(signed[i]))
    assert {frozenset(g) for g in groups.values() if len(g) > 1} == {frozenset(k for k in got if got[k] == r) for r in set(got.values())}


def test_bounded_forest():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 2**16, 3000, dtype=np.uint64)) | np.uint64(5 << 40)
    sizes = lambda f: len(f(values))
    assert sizes(simhash.near) == sizes(simhash.near_bounded)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = components.components(edges).groupBy("root").count().collect()
    assert {r.root: r["count"] for r in got} == {0: 301, 1000: 2}


def test_alike(spark):
    words = [f"w{i}" for i in range(300)]
    near = [w if i % 60 else "other" for i, w in enumerate(words)]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, " ".join(words)), (4, " ".join(f"v{i}" for i in range(300))), (8, " ".join(words[:150] + [f"u{i}" for i in range(150)]))]
    got = {r.doc_id: r.component_id for r in simhash.alike(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 4: 4, 8: 8}


def test_alike_brute(spark):
    """Pairs planted at similarities from 0.5 to 1, and a crowd about one text, against all pairs."""
    rng = np.random.default_rng(11)
    texts = []
    for k in range(120):
        words = [f"w{k}x{i}" for i in range(204)]
        other = list(words)
        for i in rng.choice(40, k % 14, replace=False):  # each word is in up to five shingles
            other[5 * i] = f"new{i}"
        texts += [" ".join(words), " ".join(other)]
    base = [f"crowd{i}" for i in range(204)]
    texts += [" ".join(w if i not in at else f"c{k}x{i}" for i, w in enumerate(base)) for k in range(60) for at in [set(rng.choice(204, 3, replace=False).tolist())]]
    sets = [simhash.shingle_set(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            same = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if same * 5 >= (len(sets[a]) + len(sets[b]) - same) * 4 and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = [lo if r == hi else r for r in root]
    got = {r.doc_id: r.component_id for r in simhash.alike(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root))


def test_schedule(spark, sf_dir):
    """A prefix of the slots is near the weights, slots of a source take its blocks in turn."""
    per = spark.createDataFrame([("a", 60_000), ("b", 90_000), ("c", 30_000)], "source string, source_size long")
    quota = mixing.quotas(mixing.targets(per), 64)
    slots = mixing.schedule(quota, 64).orderBy("slot").toPandas()
    q = {r.source: r for r in quota.collect()}
    assert {s: int(n) for s, n in slots.groupby("source").words.sum().items()} == {s: r.words for s, r in q.items()}
    for s, g in slots.groupby("source"):
        assert list(g["rank"]) == list(range(len(g))) and list(g.block) == [r % q[s].blocks for r in g["rank"]]
    half = slots[slots.slot < slots.slot.max() // 2]
    for s in "abc":
        assert abs((half.source == s).mean() - (slots.source == s).mean()) < 0.02


def test_sequence(spark):
    """The mix reads each source's stream of words block by block; `taken` is its sum, and mixed rows
    come in its order, near the weights in any prefix."""
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(5 + i % 7)), "abc"[i % 3]) for i in range(1200)], "doc_id long, text string, source string")
    seq = mixing.sequence(docs, block_words=32).orderBy("slot", "start").toPandas()
    size = {r.doc_id: 5 + r.doc_id % 7 for r in docs.collect()}
    stream = {s: [w for d in g.sort_values("start").drop_duplicates("doc_id").doc_id for w in [(d, k) for k in range(size[d])]] for s, g in seq.groupby("source")}
    for (_, s, block), g in seq.groupby(["slot", "source", "block"]):
        got = [(r.doc_id, k) for r in g.itertuples() for k in range(r.first, r.first + r.words)]
        assert got == stream[s][block * 32 : block * 32 + len(got)]
    taken = {r.doc_id: r.taken for r in mixing.mix(docs, block_words=32).collect() if r.taken}
    assert taken == {d: int(n) for d, n in seq.groupby("doc_id").words.sum().items()}
    order = [(r.doc_id, r.source) for r in mixing.mixed(docs, block_words=32).collect()]
    share = lambda rows: [sum(s == x for _, s in rows) / len(rows) for x in "abc"]
    for part in (order[:200], order[: len(order) // 2]):
        assert max(abs(x - y) for x, y in zip(share(part), share(order), strict=True)) < 0.06


def test_lines_exact_near_threshold(spark):
    """Lines on 9, 10 and 11 sites around a threshold of 10, and the first document keeps them."""
    rows = [(100 * k + s, f"a line on {k} sites\nown line of {k} and {s}", f"s{s}") for k in (9, 10, 11) for s in range(k)]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    gone = {r.doc_id for r in got if r.removed_lines}
    assert gone == {100 * k + s for k in (10, 11) for s in range(1, k)}


def test_lines_of_the_pipeline(spark):
    """Passages in two documents, of one site too, stay in the first; so do lines of 20 words on three
    sites; exact copies go whole."""
    passage = lambda k, n=55: " ".join(f"p{k}x{i}" for i in range(n))
    rows = [(s, f"{passage('sites')}\nown line {s}", f"s{s}") for s in range(2)] + [(10 + s, f"{passage('hot')}\nown line 1{s}", "s1") for s in range(2)]
    rows += [(20 + s, f"{passage('mid', 20)}\nown line 2{s}", f"s{s}") for s in range(3)] + [(30 + s, f"{passage('few', 20)}\nown line 3{s}", f"s{s}") for s in range(2)]
    rows += [(70 + s, f"{passage('copy')}\nsmall own line", f"s{s}") for s in range(3)]
    got = {r.doc_id: r.text for r in lines.kept(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert set(got) == {d for d, _, _ in rows} - {71, 72}
    assert {d for d, t, _ in rows if d in got and got[d] != t} == {1, 11, 21, 22}


def test_short_lines_of_the_pipeline(spark):
    rows = [(s, f"All rights reserved.\nown line {s}", f"s{s}") for s in range(10)] + [(20 + s, f"Next\nown line 2{s}", f"s{s}") for s in range(10)] + [(40 + s, f"Home\nown line 4{s}", f"s{s}") for s in range(16)]
    got = {r.doc_id: r.text for r in lines.kept(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {d for d, t, _ in rows if got[d] != t} == {*range(1, 10), *range(41, 56)}


def test_frequent_lines_deplete(spark):
    body = " ".join(f"word{i}" for i in range(30))
    own = lambda i: " ".join(f"own{i}x{j}" for j in range(40))
    rows = [(i, body if i < 60 else f"{body}\n{own(i)}", "h") for i in range(120)] + [(500, body, "other")]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(got[i].kept for i in range(60)) and all(got[i].kept for i in range(60, 120)) and got[500].kept


def test_topk_in_chunks(spark, sf_dir, monkeypatch):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    whole = sorted(map(tuple, topk.search(vectors, vectors.where("vec_id % 50 = 0")).collect()))
    monkeypatch.setattr(topk, "QUERY_CHUNK", 8)
    assert sorted(map(tuple, topk.search(vectors.repartition(5), vectors.where("vec_id % 50 = 0")).collect())) == whole


def test_toxicity_held_out(spark):
    """Clean separation must be found, and rows that were not learned from."""
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "ll")]
    bad = ["worthless", "pathetic", "disgusting", "miserable"]
    text = lambda toxic: " ".join(rng.choice(plain, 60).tolist() + (rng.choice(bad, 4).tolist() if toxic else []) + rng.choice(plain, 20).tolist())
    rows = [(i, text(i % 5 == 0), int(i % 5 == 0)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.where("doc_id < 1000").select("doc_id", "toxic"))
    got = toxicity.score(df, model).where("doc_id >= 1000").toPandas()
    assert (got.predicted == (got.doc_id % 5 == 0)).mean() > 0.97


def test_quality_on_labels(spark, sf_dir):
    got = queries.op3_quality_classifier(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.95 and got[got.quality == 0].kept.mean() < 0.4


def test_words_make_up_the_text():
    import random

    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tok, rnd = Tokenizer.from_file(path), random.Random(5)
    bits = ["a", "B", "é", " ", " ", "  ", "\n", "\t", " ", "\u3000", "'s", "'", "ll", "12", "½", "!", "<|endoftext|>", "漢", "👍", "x" * 70, "\x1f", "\x85", "\r\n", "\u0301"]
    for _ in range(4000):
        text = "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 14)))
        words = bpe.split_words(text, bpe._specials(path), {})
        assert "".join(words) == text
        assert [i for w in words for i in tok.encode(w, add_special_tokens=False).ids] == tok.encode(text, add_special_tokens=False).ids


def test_pipeline(spark, sf_dir):
    """Each stage against a plain statement of what it may do, on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(_again(spark, stage(spark, seen[-1], sf_dir)))
    quality, line, near, mixed, encoded = seen[1:]
    assert all(d.columns == docs.columns for d in (quality, line, near, mixed))
    assert quality.subtract(docs).count() == 0 and 0 < quality.count() < docs.count()
    assert line.join(quality, "doc_id", "left_anti").count() == 0
    assert near.subtract(line).count() == 0
    assert mixed.distinct().subtract(near.distinct()).count() == 0 and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    from hashlib import sha256

    texts = {r.doc_id: sha256(r.text.encode()).hexdigest() for r in mixed.collect()}
    got = encoded.collect()
    assert len(got) == mixed.count() and all(r.decoded_sha256 == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in got)


def _again(spark, df):
    from tablewright.llm.common import cut

    return cut(df)
