"""Catalog queries: facets, a field query language, match ranks, rollups, tags."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_AND = lambda cs: reduce(lambda a, b: a & b, cs, F.lit(True))


@dataclass(frozen=True)
class Facets:
    """A choice on several axes: any value within an axis, all axes together. A trait that is unknown
    fails a wish for it and passes a wish against it."""

    any_of: dict[str, frozenset] = field(default_factory=dict)
    with_traits: frozenset = frozenset()
    without_traits: frozenset = frozenset()
    flag: bool | None = None

    def __or__(self, other: Facets) -> Facets:
        """Choices of both; a flag of the right side wins."""
        axes = {k: self.any_of.get(k, frozenset()) | other.any_of.get(k, frozenset()) for k in {*self.any_of, *other.any_of}}
        return Facets(axes, self.with_traits | other.with_traits, self.without_traits | other.without_traits, self.flag if other.flag is None else other.flag)

    def preset(self, **axes) -> Facets:
        """Only the named axes; all others are dropped."""
        return replace(Facets(), any_of={k: frozenset(v) for k, v in axes.items()})

    def condition(self, df: DataFrame, traits: str = "traits", flag: str = "available") -> Column:
        """As a predicate. An axis is a column, of values or of arrays."""
        asked = []
        for axis, values in sorted(self.any_of.items()):
            if values:
                c = F.col(axis)
                many = df.schema[axis].dataType.typeName() == "array"
                hit = F.arrays_overlap(c, F.array(*[F.lit(v) for v in sorted(values)])) if many else c.isin(*sorted(values))
                asked.append(F.coalesce(hit, F.lit(False)))
        known = lambda t: F.coalesce(F.element_at(F.col(traits), t), F.lit(False))
        asked += [known(t) for t in sorted(self.with_traits)] + [~known(t) for t in sorted(self.without_traits)]
        if self.flag is not None:
            asked.append(F.coalesce(F.col(flag), F.lit(False)) == self.flag)
        return _AND(asked)


def parse_query(query: str, fields: dict[str, list[str]], aliases: dict[str, str] | None = None) -> list[tuple[list[str], str]]:
    """(columns, lower-case text) for each token: field:text looks in the field's columns, anything
    else in all."""
    out = []
    everywhere = list(dict.fromkeys(c for cs in fields.values() for c in cs))
    for token in query.split():
        name, colon, text = token.partition(":")
        name = (aliases or {}).get(name.lower(), name.lower())
        out.append((fields[name], text.lower()) if colon and text and name in fields else (everywhere, token.lower()))
    return out


def query(text: str, fields: dict[str, list[str]], aliases: dict[str, str] | None = None) -> Column:
    """All tokens must be found."""
    hay = lambda cs: F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in cs]))
    return _AND([hay(cs).contains(t) for cs, t in parse_query(text, fields, aliases)])


def match_rank(terms: list[str], key: str, names: list[str]) -> Column:
    """How well a row answers a search, best first: 0 if the key is made of words that include all terms,
    1 if it contains them somewhere, 2 if it does so together with the names, 3 if not."""
    low = [t.lower() for t in terms]
    k = F.lower(F.col(key))
    words = F.split(k, "[-_]+")
    wide = F.lower(F.concat_ws(" ", F.col(key), *[F.col(n) for n in names]))
    return F.when(_AND([F.array_contains(words, t) for t in low]), 0).when(_AND([k.contains(t) for t in low]), 1).when(_AND([wide.contains(t) for t in low]), 2).otherwise(3)


def examples(df: DataFrame, by: str, item: str, group: str, n: int = 3) -> DataFrame:
    """by, items, groups (distinct), examples (the first n items by name), in the order of `by`."""
    firsts = df.select(by, item).distinct().selectExpr(by, item, f"row_number() over (partition by {by} order by {item}) as r").where(F.col("r") <= n)
    firsts = firsts.groupBy(by).agg(F.sort_array(F.collect_list(item)).alias("examples"))
    return df.groupBy(by).agg(F.count("*").alias("items"), F.count_distinct(group).alias("groups")).join(firsts, by).orderBy(by)


def status_counts(df: DataFrame, statuses: list[str], column: str = "status") -> DataFrame:
    """A row for each status, zero where none."""
    spark = df.sparkSession
    named = spark.createDataFrame([(s, i) for i, s in enumerate(statuses)], "status string, place int")
    counted = df.groupBy(F.col(column).alias("status")).agg(F.count("*").alias("n"))
    return named.join(counted, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"), "place").orderBy("place").drop("place")


#: Tags in order of preference among equals, and the words in names that speak for one; fixed values.
TAGS = ("prose", "code-strings", "urls", "identifiers", "enums", "timestamps", "measurements", "counts", "monetary", "coordinates", "embeddings", "nested-json", "binary-payload")
MONEY = ("price", "amount", "cost", "fee", "revenue", "salary", "income", "usd", "eur", "gbp", "dollar", "wage", "cents", "rent", "fare", "tip")
CODE = ("html", "markdown", "_md", "code", "source", "body", "xml")
PLACES = ("geometry", "wkb", "wkt", "geom")
LINKS = ("url", "href", "link")
AXES = ("lat", "lon")
#: Marks in frequent values that speak for code; fixed values.
MARKS = ("<html", "<div", "<p>", "<a ", "<b>", "<table", "<script", "<!--", "```", "function ", "def ", "import ", '{"', '"}')


def column_tag() -> Column:
    """The tag of a row of a profile: its type speaks first, then its name, then its content."""
    dtype, name = F.lower(F.col("dtype")), F.lower(F.col("column"))
    has = lambda c, words: reduce(lambda a, b: a | b, [c.contains(w) for w in words])
    top = F.array_join(F.transform(F.coalesce("top_values", F.array().cast("array<struct<value:string,count:long>>")), lambda v: v["value"]), " ")
    length, ndv, rows = F.col("mean_length"), F.col("ndv_approx"), F.col("rows")
    share = ndv / F.nullif(rows, F.lit(0))
    few = ((ndv <= 32) & (length <= 24)) | ((ndv <= 256) & (share <= 0.001) & (length <= 24))
    text = (
        F.when(has(name, LINKS), "urls")
        .when(has(name, CODE), "code-strings")
        .when(has(name, PLACES), "coordinates")
        .when(F.lower(top).rlike("https?://"), "urls")
        .when(has(top, MARKS) | F.ltrim(top).startswith("{"), "code-strings")
        .when(length.isNull(), None)
        .when(length > 80, "prose")
        .when(few, "enums")
        .when((share >= 0.5) & length.between(4, 40), "identifiers")
        .when(length >= 40, "prose")
        .when(ndv.isNotNull(), F.when(ndv > 256, "identifiers").otherwise("enums"))
    )
    whole = dtype.contains("int") & (F.col("min").try_cast("double") >= 0) & (F.col("max").try_cast("double") <= 1e6)
    number = F.when(has(name, AXES), "coordinates").when(has(name, MONEY), "monetary").when(F.coalesce(whole, F.lit(False)), "counts").otherwise("measurements")
    return (
        F.when(dtype.contains("timestamp") | dtype.startswith("date") | (dtype == "time"), "timestamps")
        .when(dtype.contains("binary"), "binary-payload")
        .when(dtype.contains("list"), F.when(has(dtype, ("float", "double")), "embeddings").otherwise("nested-json"))
        .when(has(dtype, ("struct", "map", "variant")), "nested-json")
        .when(dtype.contains("string"), text)
        .when(has(dtype, ("int", "double", "float", "decimal", "number")), number)
    )


def table_tags(profile: DataFrame, most: int = 3, table: str = "table") -> DataFrame:
    """table, tag, n, place: the `most` commonest tags of each table; enums count from two columns on."""
    order = F.array_position(F.array(*[F.lit(t) for t in TAGS]), F.col("tag"))
    counted = profile.select(table, column_tag().alias("tag")).where("tag is not null").groupBy(table, "tag").agg(F.count("*").alias("n")).where("tag != 'enums' or n >= 2")
    return counted.withColumn("o", order).selectExpr(table, "tag", "n", f"row_number() over (partition by {table} order by n desc, o) as place").where(F.col("place") <= most)


def shape_traits(df: DataFrame) -> dict[str, bool]:
    """What a schema alone says of a table."""
    from pyspark.sql import types as T

    kinds = [f.dataType for f in df.schema]
    return {
        "has_nested": any(isinstance(t, (T.ArrayType, T.MapType, T.StructType, T.VariantType)) for t in kinds),
        "has_timestamp": any(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) for t in kinds),
        "has_variant": any(isinstance(t, T.VariantType) for t in kinds),
        "string_heavy": bool(kinds) and sum(isinstance(t, T.StringType) for t in kinds) * 2 > len(kinds),
        "wide_row": len(kinds) > 50,
    }


def high_cardinality(profile: DataFrame, table: str = "table", share: float = 0.5) -> DataFrame:
    """table, high_cardinality: whether any string or binary column has so many distinct values."""
    hit = F.col("dtype").isin("string", "binary") & (F.coalesce("ndv_approx", F.lit(0)) >= share * F.col("rows"))
    return profile.where("rows > 0").groupBy(table).agg(F.max(F.coalesce(hit, F.lit(False))).alias("high_cardinality"))


def rollup(df: DataFrame, by: str, status: str, passing: str) -> DataFrame:
    """by, passed, n: how many rows of each group pass, and how many there are."""
    return df.groupBy(by).agg(F.count_if(F.col(status) == passing).alias("passed"), F.count("*").alias("n"))
