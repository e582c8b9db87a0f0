"""Operators against independent versions: other hashes, other libraries, hand-worked numbers."""

import math
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import bpe, lines, mixing, quality, queries, rules, simhash, topk, toxicity, urls
from tablewright.llm.common import cut


def test_fingerprints_by_another_hash(spark, sf_dir):
    """Spark's own xxhash64 has the seed 42 too."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = []
    for d, text in docs.items():
        words = [w.decode() for w in (text or "").encode().lower().split()]
        if words:
            rows += [(d, " ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))]
    hashes: dict[int, list[int]] = {}
    for r in spark.createDataFrame(rows, "d long, s string").select("d", F.xxhash64("s").alias("h")).collect():
        hashes.setdefault(r.d, []).append(r.h)
    want = {d: sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) for d, hs in hashes.items()}
    got = {r.doc_id: int(r.fingerprint, 16) for r in queries.op4_simhash(spark, sf_dir).collect()}
    assert got == {d: want.get(d, 0) for d in docs}


def test_ids_of_all_documents(spark, sf_dir):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_path())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_bpe(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        decoded = tok.decode(ids, skip_special_tokens=False)
        assert got.pop(r.doc_id) == (len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest())
    assert not got


@pytest.mark.parametrize("kind", ["smallint", "decimal(9,0)", "date", "binary"])
def test_bpe_of_any_id(spark, kind):
    one = {"binary": "X'ff'", "date": "date'2020-01-02'"}.get(kind, f"cast(7 as {kind})")
    got = bpe.encode(spark.sql(f"select {one} as doc_id, 'hello there' as text"), queries.tokenizer_path())
    assert got.schema["doc_id"].dataType.simpleString() == kind and len(got.first().ids) == 2


def test_posteriors_by_single_votes():
    """The same model, document by document and in plain arithmetic."""
    rng = np.random.default_rng(4)
    docs = []
    for _ in range(300):
        good = rng.random() < 0.7
        docs.append("".join([("-" if rng.random() < (0.02 if good else 0.5) else "0") for _ in range(6)] + [("+" if rng.random() < (0.9 if good else 0.3) else "-") if rng.random() < 0.8 else "0" for _ in range(3)]))
    share, p = 0.8, {}
    for j in range(9):
        for good in (0, 1):
            p[j, good] = {"-": (0.4, 0.02)[good], "+": (0.2, 0.49)[good], "0": (0.4, 0.49)[good]} if j < 6 else {"-": (0.4, 0.02)[good], "+": (0.2, 0.49)[good], "0": 1.0}
    for _ in range(200):
        post = []
        for d in docs:
            a, b = ((share if good else 1 - share) * math.prod(p[j, good][c] for j, c in enumerate(d)) for good in (1, 0))
            post.append(a / (a + b))
        before, share = share, sum(post) / len(post)
        for j in range(9):
            for good in (0, 1):
                n = {c: 1 + sum((w if good else 1 - w) for w, d in zip(post, docs, strict=True) if d[j] == c) for c in "-+0"}
                total = sum(n.values()) if j < 6 else n["-"] + n["+"]
                p[j, good] = {c: 1.0 if j >= 6 and c == "0" else n[c] / total for c in "-+0"}
        if abs(before - share) < 1e-10:
            break
    got, accuracy, got_share = quality.posteriors(Counter(docs))
    # votes are coded bad, good, none, and start as p says
    assert max(abs(got[d] - x) for d, x in zip(docs, post, strict=True)) < 1e-6 and abs(got_share - share) < 1e-6
    assert all(abs(accuracy[j][0] - p[j, 1]["+"] / (p[j, 1]["+"] + p[j, 1]["-"])) < 1e-6 for j in range(9))


def test_labellers(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = quality.labellers(docs).collect()
    assert [r.labeller for r in got] == list(range(9)) and all(0 <= x <= 1 for r in got for x in (r.on_good, r.on_bad, r.good_share))
    assert quality.labellers(docs.where("false")).count() == 0


def test_reputation_by_hand(spark):
    """One domain, two hosts that differ: rates, strengths and bounds worked out step by step."""
    rows = [("a.x.com", 1)] * 40 + [("b.x.com", 1)] * 4 + [("b.x.com", 0)] * 36
    got = {r.host: r for r in urls.reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    # one suffix and one domain: too few groups, so priors of two pages
    p = 44 / 80
    for n, k in ((80, 44), (80, 44)):
        p = (2 * p + k) / (2 + n)
    var = p * (1 - p)
    between = 40 * (1 - p) ** 2 + 40 * (0.1 - p) ** 2
    room = var * (80 - (1600 + 1600) / 80 - 1)
    r = (between - var + 1.645 * var * math.sqrt(2)) / room
    m = min(max((1 - r) / r, 2.0), 1000.0) if r > 0 else 1000.0
    for host, k in (("a.x.com", 40), ("b.x.com", 4)):
        a, b = m * p + k, m * (1 - p) + 40 - k
        low = a / (a + b) - 1.645 * math.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
        assert abs(got[host].mean - a / (a + b)) < 1e-9 and abs(got[host].lower - low) < 1e-9
    assert got["a.x.com"].lower > 0.9 and got["b.x.com"].lower < 0.1


def test_bad_host_among_alike(spark):
    """Hosts that do not differ leave a prior that a host with 40 bad pages of 40 still gets away from,
    on a table of a few thousand labelled pages too."""
    rows = [(100 * h + i, f"http://h{h}.example.com/{'de' if i % 2 == 0 else 'fr'}/{i}") for h in range(60) for i in range(40)]
    rows += [(50_000 + i, f"http://planted.example.com/de/{i}") for i in range(60)] + [(99_999, "http://planted.example.com/xx"), (99_998, "http://h1.example.com/xx")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).where("rule is null and verdict = 'block'").collect()
    assert [r.page_id for r in got] == [99_999]


def test_slots_are_dealt_out(spark):
    per = spark.createDataFrame([("a", 60_000_000), ("b", 90_000_000)], "source string, source_size long")
    slots = mixing.schedule(cut(mixing.quotas(mixing.targets(per))))
    sizes = [r["count"] for r in slots.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * sum(sizes) / len(sizes) + mixing.CHUNK_SLOTS


def test_entries_read():
    """Results by all scores, and fewer entries read than there are."""
    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(size=(9000, 16)) / 4)
    x[5000:5400] = x[77]  # ties
    ids, q = np.arange(9000), x[::50]
    at, vec, score, read = topk.searched(ids, x, ids[::50], q)
    assert read < 0.8 * x.size * len(q)
    for j, qid in enumerate(ids[::50]):
        s = x @ q[j]
        s[qid] = -np.inf
        want = np.lexsort((ids, -s))[:5]
        assert list(vec[at == j]) == list(want) and list(score[at == j]) == [int(v) for v in s[want]]


def test_grid(spark, monkeypatch):
    """Many cells, one id in a third of the rows."""
    rng = np.random.default_rng(1)
    rows = [(i if i % 3 else 7, [float(v) for v in rng.normal(size=6)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0")
    whole = sorted(map(tuple, topk.search(df, asked).collect()))
    monkeypatch.setattr(topk, "VECTOR_PART", 60)
    monkeypatch.setattr(topk, "QUERY_CHUNK", 3)
    assert sorted(map(tuple, topk.search(df.repartition(3), asked).collect())) == whole


def test_frequent_lines_of_small_and_hot_hosts(spark):
    """The limit is 5 documents on a host of 50 and 20 on one of 2,000; copies of one text count once."""
    own = lambda k, n=40: " ".join(f"own{k}x{j}" for j in range(n))
    line = lambda k: " ".join(f"line{k}x{j}" for j in range(120))
    rows = [(i, f"{line('small')}\n{own(i)}" if i < 6 else f"{line('rare')}\n{own(i)}" if i < 11 else own(i), "small") for i in range(50)]
    rows += [(1000 + i, f"{line('hot')}\n{own(1000 + i)}" if i < 21 else f"{line('cold')}\n{own(1000 + i)}" if i < 41 else own(1000 + i), "hot") for i in range(2000)]
    rows += [(5000 + i, own("copied"), "hot") for i in range(300)]
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {d for d, r in got.items() if r.removed_words} == {*range(6), *range(1000, 1021)}
    assert {d for d, r in got.items() if not r.kept} == {*range(6), *range(1000, 1021)}


def test_passages_of_op10(spark):
    """A passage of over 50 words in two documents of one site goes from the second; the short lines of
    one site stay."""
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(i, f"own line {i}\n{passage}\nsame short line of this site", "s") for i in range(2)]
    got = {r.doc_id: r for r in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string"), spread=lines.SPREAD, long=lines.LONG).collect()}
    assert got[0].removed_lines == 0 and got[1].removed_lines == 1 and passage not in got[1].text


@pytest.fixture
def toxic_dir(spark, tmp_path):
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "ll")]
    bad = ["worthless", "pathetic", "disgusting", "miserable"]
    text = lambda toxic: " ".join(rng.choice(plain, 60).tolist() + (rng.choice(bad, 4).tolist() if toxic else []) + rng.choice(plain, 20).tolist())
    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    df.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    df.select("doc_id", "toxic").write.parquet(str(tmp_path / "labels.parquet"))
    return tmp_path, {d: y for d, _, y in rows}


def test_held_out_labels_are_never_seen(spark, toxic_dir):
    folder, truth = toxic_dir
    got = {r.doc_id: r for r in queries.op9_toxicity(spark, str(folder)).collect()}
    held = {d for d in truth if zlib.crc32(str(d).encode()) % 5 == 0}
    assert {d for d, r in got.items() if r.held_out} == held
    assert np.mean([got[d].predicted == truth[d] for d in held]) > 0.95
    other = folder / "other"
    other.mkdir()
    spark.read.parquet(str(folder / "documents.parquet")).write.parquet(str(other / "documents.parquet"))
    spark.createDataFrame([(d, 1 - y if d in held else y) for d, y in truth.items()], "doc_id long, toxic int").write.parquet(str(other / "labels.parquet"))
    again = {r.doc_id: r for r in queries.op9_toxicity(spark, str(other)).collect()}
    assert all(again[d].score == r.score for d, r in got.items())


def test_toxicity_of_beginnings(spark):
    """Words that share no more than their beginning with each other."""
    rng = np.random.default_rng(6)
    plain = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "ll")]
    word = lambda toxic: ("vilanza" if toxic else "") + "".join(rng.choice(["ko", "ri", "ta", "mu", "se"], 3))
    rows = [(i, " ".join(rng.choice(plain, 40).tolist() + [word(i % 3 == 0) for _ in range(4)] + rng.choice(plain, 20).tolist()), int(i % 3 == 0)) for i in range(1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.where("doc_id < 900").select("doc_id", "toxic"))
    got = toxicity.score(df, model).where("doc_id >= 900").toPandas()
    assert (got.predicted == (got.doc_id % 3 == 0)).mean() > 0.95


def test_windows_are_bounded():
    long = "x" * 100_000
    parts = toxicity.windows(f"a {long} b")
    assert max(map(len, parts)) <= toxicity.WINDOW + toxicity.LONG_WORD + 1 and b"".join(parts).replace(b" ", b"").decode() == f"a{long}b"


@pytest.mark.parametrize("turns", [1, 4])
def test_alike_in_crowds(spark, monkeypatch, turns):
    """Crowds about a text, chains out of it, and strangers that share its rare words, thinned or not."""
    monkeypatch.setattr(simhash, "CROWDED", 6)
    monkeypatch.setattr(simhash, "THINNINGS", turns)
    rng = np.random.default_rng(12)
    base = [f"b{i}" for i in range(240)]
    texts = [" ".join(base)]
    for k in range(60):
        words = list(base)
        for i in rng.choice(240, 1 + k % 9, replace=False):
            words[i] = f"n{k}x{i}"
        texts.append(" ".join(words))
    chain = list(base)
    for k in range(30):  # each step is alike to the one before, and less and less to the first
        for i in range(8 * k, 8 * k + 8):
            chain[i] = f"c{i}"
        texts.append(" ".join(chain))
    texts += [" ".join(base[:120] + [f"s{k}x{i}" for i in range(120)]) for k in range(20)]
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


def test_thinning_dissolves_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 20)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(w if i != k else "x" for i, w in enumerate(words)) for k in range(100)]
    rows = [(k, simhash._node(simhash.shingle_set(t)), simhash.shingle_set(t).tobytes()) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "k long, node long, shingles binary")
    members, links = simhash.thinned(df.selectExpr("5L as band", "node"), df.selectExpr("node as n", "shingles"))
    assert members.count() == 0 and sum(x.count() for x in links) == 99


def test_stages_on_edges(spark):
    """All stages one after the other, on nulls, empty and long texts, repeated rows, and on no rows."""
    long = " ".join(f"word{i % 997} the" for i in range(20_000))
    rows = [(1, "the cat sat on the mat and the dog ate it", "en", "a", 1), (1, "the cat sat on the mat and the dog ate it", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "no id here at all but words in a line", "en", None, 5), (5, long, "en", "a", len(long)), (7, "x", "en", "c", 1), (9, "###### $$$$ %%%% &&&& " * 30, "en", "a", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for df in (docs, docs.where("false")):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            made = cut(stage(spark, df, ""))
            assert i == 4 or made.columns == docs.columns
            df = made
        assert {"doc_id", "n_tokens", "ids", "decoded_sha256"} <= set(df.columns)


def test_spread_components_release(spark):
    """Rounds leave only their last table behind."""
    import os

    from tablewright.llm.components import components
    from tablewright.session import shared_dir

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    components(spark.createDataFrame([(i, i + 1) for i in range(100)], "a long, b long")).count()
    assert len(set(os.listdir(folder)) - before) == 1
    assert simhash.MOST_BITS == 3


def test_fingerprint_joins_merge(spark, monkeypatch):
    """Spark takes 66 keys of a fingerprint to be as small as its file; no join may send them through the driver."""
    from tablewright.llm import components

    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(simhash, "cut", noted)
    monkeypatch.setattr(components, "cut", noted)
    docs = spark.createDataFrame([(k, f"a b c d e f {k % 7} g h") for k in range(40)], "doc_id long, text string")
    assert noted(simhash.near_duplicates(docs)).count() == 40
    assert len(plans) > 6 and not [p for p in plans if "Broadcast" in p]


def test_near_stage_by_fingerprints(spark, monkeypatch):
    """Where no band shows anything: what is within three bits goes if it is alike to four fifths, and only then."""
    monkeypatch.setattr(simhash, "band_keys", lambda x: x.sum(keepdims=True, dtype=np.uint64))
    texts = []
    for k in range(8):
        words = [f"w{k}x{i}" for i in range(400)]
        texts += [" ".join(words), " ".join(w if i != 200 else "other" for i, w in enumerate(words))]
    words = [f"q1045x{i}" for i in range(30)]
    texts += [" ".join(words), " ".join(w if i != 10 else "z" for i, w in enumerate(words))]  # 21 of 31 shingles
    sets = [simhash.shingle_set(t) for t in texts]
    within = [(simhash.majority(x) ^ simhash.majority(y)).bit_count() <= 3 for x, y in zip(sets[::2], sets[1::2], strict=True)]
    assert sum(within[:8]) > 3 and within[8]
    df = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id for r in corpus_pipeline.STAGES[2][1](spark, df, "").collect()}
    assert left == set(range(18)) - {2 * k + 1 for k in range(8) if within[k]}
