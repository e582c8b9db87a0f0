"""Every operator over nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import pytest
from pyspark.sql import functions as F

from tablewright.llm import bpe, chat, lines, mixing, quality, rules, simhash, topk, toxicity, urls
from tablewright.llm.queries import tokenizer_path

LONG = " ".join(f"word{i % 997} the" for i in range(60_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside.
CLASH = ["key", "line", "size", "rank", "fp", "component_id", "score", "h", "votes", "kept", "n_words", "row", "bucket", "node", "chunk", "ids", "site", "first", "pos", "target", "host"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "the cat sat on the mat and the dog ate it", "en", "a", 1), (1, "the cat sat on the mat and the dog ate it", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t ", "en", "b", 4),
        (None, "no id here at all but words in a line", "en", None, 5), (5, LONG, "en", "a", len(LONG)), (6, "\n\n\n", "en", "a", 3), (7, "x", "en", "c", 1), (8, "é ü 漢字 👍 <|endoftext|> ok", "fr", "c", 9), (9, "###### $$$$ %%%% &&&& " * 30, "en", "a", 7),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def test_mix(docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert all(0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size for r in got)
    assert mixing.mix(none).count() == 0
    assert mixing.mixed(docs).columns == docs.columns and mixing.mixed(none).count() == 0


def test_rules(docs, none):
    got = {r.doc_id: r for r in rules.judge(docs).collect()}
    assert len(rules.judge(docs).collect()) == docs.count()
    assert got[2].n_words == 0 and got[2].base_failed and not got[2].kept
    assert got[5].n_words == 120_000 and got[5].base_failed  # the long text repeats itself
    assert got[9].n_symbols == 18 * 30
    assert rules.judge(none).count() == 0


def test_quality(docs, none):
    got = {r.doc_id: r for r in quality.scored(docs).collect()}
    assert got[2].score == 0 and not got[2].kept and not got[4].kept
    assert quality.scored(none).count() == 0
    assert quality.kept(docs).columns == docs.columns
    assert {r.doc_id for r in quality.kept(docs).collect()}.isdisjoint({2, 3, 4, 6})


def test_lines(docs, none):
    got = lines.dedup(docs, sites=2)
    assert got.columns == [*docs.columns, "line_count", "removed_lines"] and got.count() == docs.count()
    assert {r.text for r in got.where("doc_id = 2").collect()} == {None}
    assert lines.dedup(none).count() == 0 and lines.kept(docs).columns == docs.columns


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[2].fingerprint == "0" * 16 and by[2].component_id == by[3].component_id == by[4].component_id == by[6].component_id == 2
    assert simhash.near_duplicates(none).count() == 0
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 2, None, 5, 7, 8, 9}
    assert simhash.one_of_each(none).count() == 0


def test_one_of_each_by_row(spark):
    """An id with two texts loses only the copy; of copies without an id one stays."""
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a text of its own"), (None, "no id but the same words"), (None, "no id but the same words"), (None, "No id but the same words"), (None, "a b c d e f g")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text.lower()) for r in got) == [(0, "no id but the same words"), (1, "a b c d e f g"), (2, "a text of its own")]


def test_topk(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [0.5]), (50, [0.5]), (50, [0.5]), (9, [-1.0, 3e38])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("own")).withColumn("score", F.lit("own"))
    got = sorted(map(tuple, topk.search(df.where("vec_id != 9"), df.where("vec_id % 50 = 0")).collect()))
    assert got == [(0, 1, 1, 65536), (0, 2, 2, 65536), (50, 1, 8, 16384)]
    assert topk.search(df.where("false"), df.where("false")).count() == 0


def test_bpe(docs, none):
    from hashlib import sha256

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = bpe.digest(docs, tokenizer_path()).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    for r in docs.select("doc_id", "text").collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want = [len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((r.text or "").encode()).hexdigest()]
        assert [by[r.doc_id].n_tokens, by[r.doc_id].ids_sha256, by[r.doc_id].decoded_sha256] == want
    assert bpe.digest(none, tokenizer_path()).count() == 0
    odd = docs.sparkSession.createDataFrame([(1, [31373, -1, 10**9]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(odd, tokenizer_path()).collect()} == {1: "hello", 2: "", 3: ""}


def test_chat(spark):
    hard = ["", None, "</s>", "[INST]", "[~INST]", "[~~/INST] <~s>", "<", "[/", "\\$1 $2", "<s></s>[ROLE]x[/ROLE]", "a\nb", LONG]
    rows = [(c, i, role, text) for c in (1, 2, None) for i, (role, text) in enumerate((r, t) for r in ("user", "assistant", "system", "tool", None, "[/ROLE]</s>") for t in hard)]
    rows += [(3, 0, "user", "b"), (3, 0, "user", "a"), (3, None, "assistant", "last"), (3, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit("own"))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r or "", t or "") for _, _, r, t in rows[:72]]
    assert [t.text for t in got[3].turns] == ["a", "a", "b", "last"] and got[3].level == 0 and got[1].level == 1
    assert [got[3].formatted[s.start : s.start + s.length] for s in got[3].loss_spans] == ["last"]
    assert chat.format_chats(df.where("false")).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "HTTP://A.Example.ORG:80/es/1?x#y"), (6, "x://example.org"), (7, "://b.org/"), (7, "://b.org/"), (None, "http://c.com/de/1"), (8, "http://c.com/xx")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("own")).withColumn("path", F.lit("own"))
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert urls.judge(df).count() == len(rows)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("", "", None, "allow")
    assert (got[5].host, got[5].path, got[5].rule) == ("a.example.org:80", "/es/1", None)
    assert (got[6].rule, got[7].rule, got[None].verdict) == (None, "org/", "block")
    assert urls.judge(df.where("false")).count() == 0


def test_planted_host(spark):
    """A host whose pages with a rule are all bad loses the page without one; its neighbours keep theirs."""
    rows = [(100 * h + i, f"http://h{h}.example.com/{'de' if i % 4 == 0 else 'fr'}/{i}") for h in range(12) for i in range(16)]
    rows += [(5000 + i, f"http://planted.example.com/de/{i}") for i in range(40)]
    rows += [(9000 + h, f"http://h{h}.example.com/xx") for h in range(12)] + [(9999, "http://planted.example.com/xx")]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).where("rule is null and verdict = 'block'").collect()
    assert [r.page_id for r in got] == [9999]


def test_toxicity(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (2, None), (99, 1), (1, 1)], "doc_id long, toxic int")
    for known in (labels, labels.where("toxic = 1"), labels.where("false")):
        got = toxicity.score(docs, toxicity.fit(docs, known)).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
