"""Operators on literals: partition independence, comparison cases, edges of profiles, refusals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import names, scalar, types
from tablewright.operators import catalog, compare, profile, tighten, union
from tablewright.plans.dataset import Dataset, Recipe, SchemaDrift, hydrated, recipe_faults
from tablewright.sources import readers, sinks, text
from tablewright.streaming import windows

# --- partitioning does not matter -----------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 3, 16])
def test_partition_independence(spark, n):
    df = spark.createDataFrame([(i, float(i % 7) if i % 5 else None, f"v{i % 3}", [i] * (i % 4)) for i in range(200)], "k int, x double, s string, l array<int>")
    want, got = profile.profile(df), profile.profile(df.repartition(n))
    assert [r for r in got.drop("ndv_approx", "mean").collect()] == [r for r in want.drop("ndv_approx", "mean").collect()]
    assert tighten.plan(df.repartition(n)) == tighten.plan(df) == [("k", "uint8")]
    assert compare.tables_equal(df, df.repartition(n))


# --- profiles -------------------------------------------------------------------------------------


def row(df, column):
    return profile.profile(df).where(F.col("column") == column).first()


def test_profile_edges(spark):
    nothing = row(spark.range(3).select(F.lit(None).cast("timestamp_ntz").alias("ts")), "ts")
    assert nothing.null_count == 3 and nothing.min is None and nothing.counts is None
    s = row(spark.createDataFrame([(x,) for x in ["a", "b", "a", "c", None, "a", "b"]], "label string"), "label")
    assert s.null_count == 1 and s.ndv_approx == 3 and [tuple(v) for v in s.top_values] == [("a", 3), ("b", 2), ("c", 1)]
    assert row(spark.range(1024).select(F.col("id").cast("string").alias("s")), "s").top_values is None
    lists = row(spark.createDataFrame([([1, 2],), ([3],), ([],), ([4, 5, 6],), (None,)], "l array<int>"), "l")
    assert (lists.length_min, lists.length_max, lists.null_count) == (0, 3, 1)
    maps = row(spark.createDataFrame([({"a": 1, "b": 2},), ({},)], "m map<string,int>"), "m")
    assert (maps.length_min, maps.length_max) == (0, 2)
    one = row(spark.createDataFrame([(5,), (5,), (None,)], "x int"), "x")
    assert one.edges == ["5.0", "5.0"] and one.counts == [2]
    odd = row(spark.createDataFrame([(0.0,), (10.0,), (float("nan"),), (float("inf"),), (None,)], "x double"), "x")
    assert odd.counts == [1] + [0] * 8 + [1] and odd.not_finite == 2
    assert row(spark.createDataFrame([(1,)], 'struct<`we"ird``name`:int>'), 'we"ird`name') is not None
    b = row(spark.createDataFrame([(bytearray(b"abc"),), (bytearray(b"defgh"),), (bytearray(),)], "b binary"), "b")
    assert round(b.mean_length, 3) == 2.667 and b.top_values is None
    assert row(spark.createDataFrame([((1,),)], "s struct<v:int>"), "s").dtype == "struct"
    big = row(spark.createDataFrame([(2**62,), (2**62 + 1,)], "k long"), "k")
    assert (big.min, big.max) == (str(2**62), str(2**62 + 1))
    assert profile.profile(spark.range(0)).count() == 1


# --- comparison -----------------------------------------------------------------------------------

SAME = [("int", "bigint"), ("float", "double"), ("decimal(5,0)", "int"), ("string", "string")]
UNLIKE = [("int", "double"), ("int", "boolean"), ("binary", "string"), ("date", "int"), ("array<string>", "array<int>"), ("timestamp", "timestamp_ntz"), ("struct<a:int>", "struct<b:int>")]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_widths_do_not_matter(spark, a, b):
    df = spark.range(2)
    assert compare.tables_equal(df.select(F.lit(1).cast(a).alias("c")), df.select(F.lit(1).cast(b).alias("c")))


@pytest.mark.parametrize(("a", "b"), UNLIKE)
def test_families_matter_without_values(spark, a, b):
    none = lambda t: spark.range(2).select(F.lit(None).cast(t).alias("c"))
    assert compare.schema_difference(none(a), none(b)) and not compare.tables_equal(none(a), none(b))


def test_floats_bit_for_bit(spark):
    one = lambda v, t: spark.createDataFrame([(v,)], f"c {t}")
    for t, wrap in (("double", lambda x: x), ("array<double>", lambda x: [x]), ("struct<f:double>", lambda x: (x,)), ("array<struct<f:double>>", lambda x: [(x,)])):
        assert not compare.tables_equal(one(wrap(0.0), t), one(wrap(-0.0), t))
        assert compare.tables_equal(one(wrap(float("nan")), t), one(wrap(float("nan")), t))
    assert not compare.tables_equal(one(1.1, "double"), one(1.1, "float"))
    twice = one(1.0, "double").union(one(1.0, "double"))
    assert not compare.tables_equal(twice, one(1.0, "double"))
    assert compare.tables_equal(one({"a": 1, "b": 2}, "map<string,int>"), one({"b": 2, "a": 1}, "map<string,int>"))


def test_ordered_difference(spark):
    a = spark.createDataFrame([(0, "x", 1.0), (1, "y", 2.0), (2, "z", None)], "i long, s string, f double")
    b = spark.createDataFrame([(0, "x", 1.0), (1, "Y", 2.0), (3, "z", None)], "i long, s string, f double")
    assert {(r.i, tuple(r.columns)) for r in compare.ordered_difference(a, b, "i").collect()} == {(1, ("s",)), (2, ("s", "f")), (3, ("s", "f"))}


def test_keyed_difference(spark):
    cols = "slug string, cell string, status string, absent boolean"
    new = spark.createDataFrame([("a", "1", "pass", False), ("a", "2", "fail", False), ("a", "3", "skip", True), ("a", "4", "skip", False), ("a", "5", "pass", None), ("a", "6", "fail", False)], cols)
    old = spark.createDataFrame([("a", "1", "pass", False), ("a", "2", "pass", False), ("a", "3", "pass", False), ("a", "4", "pass", False), ("a", "5", "skip", True), ("a", "7", "pass", False), ("b", "1", "pass", False)], cols)
    got = compare.keyed_difference(new, old, ["slug", "cell"], measured="slug")
    assert {(r.slug, r.cell): r.outcome for r in got.collect()} == {("a", "1"): "unchanged", ("a", "2"): "mutated", ("a", "3"): "skipped", ("a", "4"): "mutated", ("a", "5"): "added", ("a", "6"): "added", ("a", "7"): "removed", ("b", "1"): "skipped"}
    assert {(r.slug, r.cell) for r in compare.violations(got).collect()} == {("a", "2"), ("a", "4"), ("a", "6"), ("a", "7")}


# --- unions and types -----------------------------------------------------------------------------


def test_union(spark):
    a = spark.createDataFrame([(1, 2, "train")], "n long, mixed int, split string")
    b = spark.createDataFrame([(0.5, 3, 7)], "mixed double, n int, later int")
    got = union.by_name([a, b], {"split": "source_split"}, [{"shard": "a"}, {"shard": "b"}], order_column="o")
    assert [f.simpleString() for f in got.schema] == ["n:bigint", "mixed:double", "source_split:string", "shard:string", "o:int", "later:int"]
    assert [tuple(r) for r in got.orderBy("o").collect()] == [(1, 2.0, "train", "a", 0, None), (3, 0.5, None, "b", 1, 7)]
    with pytest.raises(ValueError, match="collide"):
        union.by_name([a], {"split": "n"})
    empty = union.by_name([a.where("false"), b.where("false")])
    assert empty.count() == 0 and empty.schema["mixed"].dataType == T.DoubleType()


def test_tighten(spark):
    df = spark.createDataFrame([(1, -129, bytearray(b"ok"), bytearray(b"\xff"), [1, 2], [1]), (2**40, 32768, bytearray(b"fine"), None, [3, 4], [1, 2]), (None,) * 6], "id long, score long, t binary, raw binary, emb array<int>, ragged array<int>")
    assert tighten.plan(df) == [("id", "uint64"), ("score", "int32"), ("t", "string"), ("emb", "fixed_size_list[2]")]
    got = tighten.tighten(df)
    assert [types.label(f.dataType, f.metadata) for f in got.schema] == ["uint64", "int32", "string", "binary", "fixed_size_list<int32>[2]", "list<int32>"]
    assert got.where("id = 1099511627776 and score = 32768 and t = 'fine'").count() == 1
    none = spark.range(2).select(F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("b"))
    assert tighten.plan(none) == []


def test_narrowest_and_names():
    assert [types.narrowest(*b) for b in ((0, 255), (0, 256), (-1, 127), (-129, 0), (0, 2**63), (-(2**40), 1))] == ["uint8", "uint16", "int8", "int16", "uint64", "int64"]
    assert names.unique(["a", "a", "a [2]", "a"]) == ["a", "a [3]", "a [2]", "a [4]"]
    assert types.widest(T.IntegerType(), T.StringType()) == T.StringType()


def test_projection(spark):
    df = spark.createDataFrame([(1, (2, 3))], "a int, s struct<x:int,y:int>")
    assert names.project(df, ["s.y", "a"]).first().asDict(True) == {"s": {"y": 3}, "a": 1}
    assert names.project(df, []).columns == []
    with pytest.raises(KeyError, match="there are a, s"):
        names.project(df, ["b"])


# --- sources refuse what they cannot read ---------------------------------------------------------


@pytest.fixture
def put(tmp_path):
    def write(content, name="in.txt"):
        p = tmp_path / name
        p.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(p)

    return write


def test_csv(spark, put):
    got = readers.csv(spark, put('n,s,f\n1,"a\nb",1.5\n\n2,NULL,?\n', "x.csv"))
    assert [tuple(r) for r in got.collect()] == [(1, "a\nb", "1.5"), (2, None, "?")]
    with pytest.raises(Exception, match="ragged row"):
        readers.csv(spark, put('a,b,c\n1,"x\ny",3\n4,5\n', "bad.csv"), "a int, b string, c int").collect()
    assert readers.csv(spark, put("1|2\n", "p.csv"), sep="|", header=False, names=["x", "y"]).first().asDict() == {"x": 1, "y": 2}


def test_text_refusals(spark, put):
    with pytest.raises(Exception, match="269"):
        text.daily_fixed_width(spark, put("short\n")).collect()
    bad_day = "USW00000001202102TMAX" + "".join(f"{v:5d}   " for v in [-9999] * 29 + [1, -9999])
    with pytest.raises(Exception, match="(?i)invalid|february"):
        text.daily_fixed_width(spark, put(bad_day + "\n")).collect()
    with pytest.raises(readers.BadRecord, match="not in the schema: Odd"):
        text.xml_rows(spark, put('<rows>\n<row Id="1" Odd="x" />\n</rows>\n', "x.xml"), "Id int")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|malformed"):
        text.xml_rows(spark, put('<rows>\n<row Id="one" />\n</rows>\n', "y.xml"), "Id int").collect()
    with pytest.raises(Exception, match="fewer than five"):
        text.tabs_then_json(spark, put("a\tb\n", "t.tsv")).collect()
    with pytest.raises(readers.BadRecord, match="from 2 to 3"):
        text.white_space(spark, put("1 2\n1 2 3\n", "w.txt"))
    with pytest.raises(Exception, match="not a row of numbers"):
        text.after_preamble(spark, put("head\n1 2\n3 x\n", "c.txt"), ["a", "b"]).collect()
    with pytest.raises(Exception, match="fewer than 3"):
        text.word_vectors(spark, put("a 1 2\n", "g.txt"), 3).collect()
    with pytest.raises(readers.UnsupportedFormat):
        readers.read(spark, "x.vortex", "vortex")
    with pytest.raises(readers.BadRecord, match="cannot be zipped"):
        text.zipped_by_position([spark.range(2), spark.range(3)])


def test_wrapped_records(spark, put):
    import gzip

    whole = '{"k": "é' + "x" * 50 + '"}'
    raw = whole.encode()
    cut = [raw[i : i + 20] for i in range(0, len(raw), 20)]  # inside the two-byte character too
    p = put(gzip.compress(b"\n".join([b'{"k": "a"}', *cut, b"", b'{"k": "b"}'])), "w.json.gz")
    got = text.wrapped_jsonl(spark, p, wrap=20).selectExpr("variant_get(record, '$.k', 'string') as k").collect()
    assert [r.k for r in got] == ["a", "é" + "x" * 50, "b"]
    for bad in ('{"k": 1', "[1]\n", '{"k":\n{"k": 2}\n'):
        with pytest.raises(Exception, match="record|object"):
            text.wrapped_jsonl(spark, put(bad, "bad.json"), wrap=20).collect()


def test_more_sources(spark, put, tmp_path):
    r = text.readings(spark, put("04-21-1991\t9:09\t58\t100\n04-21-1991\t9:10\t33\t0Hi\n", "data-01")).orderBy("time").collect()
    assert [(x.code, x.value, x.raw_value) for x in r] == [(33, None, "0Hi"), (58, 100.0, "100")] or [(x.code, x.value, x.raw_value) for x in r] == [(58, 100.0, "100"), (33, None, "0Hi")]
    (tmp_path / "docs" / "africa").mkdir(parents=True)
    (tmp_path / "docs" / "africa" / "ao.json").write_text('{"a":\n 1}')
    d = text.json_documents(spark, str(tmp_path / "docs")).selectExpr("region", "code", "variant_get(document, '$.a', 'int') as a").first()
    assert tuple(d) == ("africa", "ao", 1)
    import zipfile

    inner = tmp_path / "inner.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a.csv", "x,y\n1,2\n")
    with zipfile.ZipFile(tmp_path / "outer.zip", "w") as z:
        z.write(inner, "inner.zip")
        z.writestr("b.csv", "x,z\n3,4\n")
    got = text.nested_zip_csv(spark, str(tmp_path / "outer.zip"), str(tmp_path / "unpacked"))
    assert {tuple(r) for r in got.select("x", "y", "z").collect()} == {(1, 2, None), (3, None, 4)}
    import duckdb

    with duckdb.connect(str(tmp_path / "t.db")) as c:
        c.execute("create table t as select range as id, 'é-' || range as label from range(7)")
        c.execute("create view v as select 1")
    assert readers.duckdb_table(spark, str(tmp_path / "t.db"), "t").count() == 7
    with pytest.raises(readers.BadRecord):
        readers.duckdb_table(spark, str(tmp_path / "t.db"), "v")
    spark.range(3).write.parquet(str(tmp_path / "train-0.parquet"))
    assert text.with_duration(spark.sql("select timestamp_ntz '2020-01-01 00:00:01' as a, timestamp_ntz '2020-01-01 00:00:00' as b"), "a", "b").first().duration_us == -1_000_000
    df = spark.read.parquet(str(tmp_path / "train-0.parquet"))
    seen = readers.unchanged(df)
    assert readers.unchanged(df, seen) == seen
    with pytest.raises(readers.BadRecord):
        readers.unchanged(df, {})


def test_row_index(spark):
    got = readers.with_index(spark.range(0, 1000, 1, 7)).collect()
    assert all(r.id == r.row_index for r in got)


# --- sinks, recipes, datasets ---------------------------------------------------------------------


def test_publish(spark, tmp_path):
    p = str(tmp_path / "out")
    assert sinks.publish(spark.range(5), p, verify=True).count() == 5
    assert sinks.publish(spark.range(9), p, verify=True).count() == 9
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.publish(bad, p)
    assert spark.read.parquet(p).count() == 9 and [x.name for x in tmp_path.iterdir()] == ["out"]


def test_recipes(spark, tmp_path, put):
    p = put("Fare Amount,Fare Amount\n1,x\n300,y\n", "in.csv")
    made = Recipe("fares", (p,), "csv", normalise=True, tight=True, rows=2)
    ds = made.build(spark, str(tmp_path / "fares"))
    assert ds.columns[0].startswith("fare_amount") and ds.frame().count() == 2
    with pytest.raises(SchemaDrift, match="2 rows, expected 3"):
        Recipe("fares", (p,), "csv", rows=3).build(spark, str(tmp_path / "no"))
    child = Recipe("child", (p,), "csv", parent="fares")
    assert child.fingerprint({"fares": made}) != child.fingerprint()
    assert recipe_faults([made, made, Recipe("x", (), handler="nope"), Recipe("y", (), parent="z"), child, Recipe("g", (), parent="child")]) == [("fares", "repeated slug"), ("x", "unknown handler nope"), ("y", "missing parent z"), ("g", "parent child has a parent")]
    by_handler = Recipe("w", (put("a 1 2\n", "v.txt"),), handler="word_vectors", parameters={"dimension": 2})
    assert by_handler.frame(spark).first().token == "a"


def test_dataset(spark):
    ds = Dataset(spark, "r", lambda: spark.createDataFrame([(1, "a"), (2, None)], "k int, s string"))
    ds.register("view_r")
    assert spark.sql("select count(s) as n from view_r").first().n == 1
    assert ds.to_arrow(["s"]).num_rows == 2 and list(ds.batches(["k"])) == [{"k": 1}, {"k": 2}]
    assert ds.validate(2, ds.schema_hash()[:8]) == [] and len(ds.validate(3, "0", strict=False)) == 2


def test_hydrate(spark):
    urls = ["https://ok.example/a", "HTTPS://Evil.example:443/", "ftp://x.example/", None, "http://x.onion/", "https://down.example/", "http://[::1]:8080/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "i int, url string")

    def fetch(url):
        if "down" in url:
            raise OSError("no route")
        return 200, "text/plain", b"body"

    got = {r.i: r for r in hydrated(df, "url", fetch, spark.createDataFrame([("evil.example",)], "host string")).collect()}
    assert [got[i].provenance.filter_decision for i in range(7)] == ["allowed", "blocked_by_host", "blocked_scheme", "blocked_scheme", "blocked_scheme", "allowed", "allowed"]
    assert got[0].content == b"body" and got[0].provenance.bytes_total == 4 and got[5].provenance.error == "no route" and got[1].content is None


# --- catalog and functions ------------------------------------------------------------------------


def test_facets(spark):
    df = spark.createDataFrame([(1, ["a", "b"], "xs", {"wide": True}), (2, ["b"], "s", {"wide": None}), (3, None, "s", None)], "k int, tags array<string>, size string, traits map<string,boolean>")
    find = lambda f: [r.k for r in df.where(f.condition(df)).orderBy("k").collect()]
    assert find(catalog.Facets({"tags": frozenset("ab")})) == [1, 2]
    assert find(catalog.Facets({"tags": frozenset("b"), "size": frozenset({"s"})})) == [2]
    assert find(catalog.Facets(with_traits=frozenset({"wide"}))) == [1] and find(catalog.Facets(without_traits=frozenset({"wide"}))) == [2, 3]
    assert find(catalog.Facets({"tags": frozenset("a")}) | catalog.Facets({"tags": frozenset("b")})) == [1, 2]
    assert (catalog.Facets(flag=True) | catalog.Facets(flag=False)).flag is False and find(catalog.Facets()) == [1, 2, 3]


def test_query_language():
    fields = {"slug": ["slug"], "tag": ["tags"], "lic": ["license"]}
    got = catalog.parse_query("slug:Foo license:mit what:ever tag: bar", fields, {"license": "lic"})
    everywhere = ["slug", "tags", "license"]
    assert got == [(["slug"], "foo"), (["license"], "mit"), (everywhere, "what:ever"), (everywhere, "tag:"), (everywhere, "bar")]


def test_column_tags(spark):
    rows = [("when", "timestamp[us]", None, None, None, None, None), ("fare_amount", "float64", None, 9, "0", "5", None), ("n", "int32", None, 9, "0", "5", None), ("id", "string", 10.0, 90, None, None, None), ("page_url", "string", 30.0, 90, None, None, None), ("emb", "list<float32>", None, None, None, None, None), ("kind", "string", 4.0, 3, None, None, [("a", 5)]), ("x", "string", 9.0, 5, None, None, [("http://a", 1)])]
    df = spark.createDataFrame(rows, "column string, dtype string, mean_length double, ndv_approx long, min string, max string, top_values array<struct<value:string,count:long>>").withColumn("rows", F.lit(100))
    got = {r["column"]: r.tag for r in df.select("column", catalog.column_tag().alias("tag")).collect()}
    assert got == {"when": "timestamps", "fare_amount": "monetary", "n": "counts", "id": "identifiers", "page_url": "urls", "emb": "embeddings", "kind": "enums", "x": "urls"}


def test_scalars(spark):
    df = spark.createDataFrame([("https://a:b@h/x?token=1&ok=2 /home/me/f",)], "s string").select(scalar.redacted(F.col("s")).alias("s"))
    assert df.first().s == "https://<redacted-credential>@h/x?token=<redacted-credential>&ok=2 <redacted-path>"
    assert spark.range(1).select(scalar.iso_millis(F.lit(1500)).alias("t")).first().t == "1970-01-01T00:00:01.500000+00:00"
    with pytest.raises(Exception, match="CAST_INVALID_INPUT|malformed"):
        spark.createDataFrame([("x1",)], "s string").select(scalar.optional_int(F.col("s"))).collect()


# --- streams --------------------------------------------------------------------------------------


def test_stream_equals_batch(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(t0 + dt.timedelta(minutes=7 * i), f"k{i % 2}") for i in range(60)]
    spark.createDataFrame(rows, "ts timestamp, kind string").repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = windows.events_stream(spark, str(tmp_path / "in"), batch.schema)
    q = windows.tumbling(stream, "ts", "1 hour", ["kind"], late="10 minutes").writeStream.outputMode("complete").format("memory").queryName("tumbling").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    want = {tuple(r) for r in windows.tumbling(batch, "ts", "1 hour", ["kind"]).collect()}
    assert {tuple(r) for r in spark.table("tumbling").collect()} == want
    assert windows.sliding(batch, "ts", "1 hour", "30 minutes", []).agg(F.sum("n")).first()[0] == 120
    assert windows.sessions(batch, "ts", "5 minutes", []).count() == 60


# --- archives, workbooks, generators --------------------------------------------------------------


def test_archives(tmp_path):
    import gzip
    import tarfile
    import zipfile

    from tablewright.sources import archives

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for n in ("x/a.csv", "x/b.csv", "x/b.txt"):
            z.writestr(n, n)
    got = archives.extract(str(tmp_path / "a.zip"), str(tmp_path / "o"), ["*.csv"], ["b.*"])
    assert [g.rsplit("/", 2)[1:] for g in got] == [["x", "a.csv"]]
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as t:
        t.add(got[0], "in/a.csv")
    assert len(archives.extract(str(tmp_path / "a.tar.gz"), str(tmp_path / "p"))) == 1
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"1"))
    assert archives.extract(str(tmp_path / "c.csv.gz"), str(tmp_path / "q"))[0].endswith("c.csv")
    with zipfile.ZipFile(tmp_path / "evil.zip", "w") as z:
        z.writestr("../out.csv", "x")
    with pytest.raises(readers.BadRecord, match="leaves"):
        archives.extract(str(tmp_path / "evil.zip"), str(tmp_path / "r"))
    with pytest.raises(readers.BadRecord, match="nothing"):
        archives.extract(str(tmp_path / "a.zip"), str(tmp_path / "s"), ["*.json"])


def _workbook(path, sheets):
    """A workbook with inline strings; a date is (number, 1), styled as one."""
    import zipfile

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'

    def cell(r, c, v):
        at = f'r="{chr(65 + c)}{r + 1}"'
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c {at} t="b"><v>{int(v)}</v></c>'
        if isinstance(v, tuple):
            return f'<c {at} s="1"><v>{v[0]}</v></c>'
        return f'<c {at} t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c {at}><v>{v}</v></c>"

    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {ns}><sheetData>" + "".join("<row>" + "".join(cell(r, c, v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows)) + "</sheetData></worksheet>")


def test_xlsx(spark, tmp_path):
    from tablewright.sources.xlsx import xlsx

    p = str(tmp_path / "w.xlsx")
    head = ["n", "x", "ok", "day", "mixed", "n"]
    _workbook(p, {"one": [["notes"], head, [1, 2, True, (44000, 1), 1, None], [None] * 6], "two": [["notes"], head, [2, 2.5, None, None, "a", 7]]})
    got = xlsx(spark, p, skip=1)
    assert [f.simpleString() for f in got.schema] == ["n:bigint", "x:double", "ok:boolean", "day:timestamp_ntz", "mixed:string", "n [2]:bigint", "sheet_name:string"]
    assert [tuple(r) for r in got.orderBy("n").collect()] == [(1, 2.0, True, dt.datetime(2020, 6, 18), "1", None, "one"), (2, 2.5, None, None, "a", 7, "two")]
    assert xlsx(spark, p, "two", 1).count() == 1
    _workbook(p, {"one": [["a"], [1]], "two": [["b"], [1]]})
    with pytest.raises(readers.BadRecord, match="header"):
        xlsx(spark, p)


def test_generator(spark):
    from tablewright.plans.generate import tables

    t = tables(spark, 0.001)
    assert {n: df.count() for n, df in t.items()} == {"region": 5, "nation": 25, "supplier": 10, "customer": 150, "part": 200, "orders": 1500, "lineitem": 6000}
    assert t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").isEmpty()
    assert compare.tables_equal(t["orders"], tables(spark, 0.001)["orders"].repartition(3))


def test_top_values_near_the_limit(spark):
    """Whether top values are listed is decided by the exact number of distinct values."""
    from tablewright.operators import profile

    df = spark.range(600).selectExpr(*[f"concat('{c}', id % {n}) as {c}{n}" for n in (250, 253, 256, 257, 260) for c in "abcdef"])
    found = profile.summary(df)
    listed = profile.top_values(df, found)
    assert {f for i, f in enumerate(df.columns) if i in listed} == {f"{c}{n}" for n in (250, 253, 256) for c in "abcdef"}
