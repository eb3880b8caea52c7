"""Benchmark decontamination by a broadcast hash set of test n-grams, in DataFrame functions only.

Texts are normalised (A-Z lower-cased) and read as words, runs of digits, letters and
non-ASCII characters. Each benchmark item gives its windows of N consecutive words; an
item of fewer words, but not none, is one window. The distinct windows' 64-bit hashes
are the set, broadcast as far as their counted number allows and else joined. Training
texts are scanned once: the hashes of all their windows, for each window length that
the benchmark has, meet the set. Only texts with a hit are read again, where each hit
is verified by its words. Texts are known by their digest from there on, so copies,
however many, are one text until the last join.

The words of all occurrences are spans (`spans`), merged where they touch or overlap,
and either these (`remove_spans`) or the documents that have one (`remove_documents`)
go.

Defined results: null, empty and wordless texts have no words and no hits; wordless
items have no window; items that repeat an item_id are one item, those without one hit
words but are not listed; repeated rows are judged alike and stay; an empty table or an
empty benchmark gives no hits. Extra columns are ignored by `contamination` and passed
through by the removals, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, fresh, small, table
from .url_filter import LOWER, UPPER

N = 10
#: Rows of windows with their words, or of results, that may be broadcast after they have been counted (about 100 bytes each).
BROADCAST_TEXTS = 200_000
#: A word of a lower-cased text; words and what parts them in a text as it stands.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PIECE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str | Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def digest(text: str) -> Column:
    """What a text is known by: 128 bits."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _bound(value: Column, body) -> Column:
    """body(value), with value made once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(n: Column, of: int) -> Column:
    """0, 1, ..: where a window of `of` words begins in n words."""
    return F.when(n >= of, F.sequence(F.lit(0), n - of)).otherwise(F.array().cast("array<int>"))


def item_windows(benchmark: DataFrame, n: int = N, item: str = "item_id", text: str = "text") -> DataFrame:
    """Distinct (item, n, window) of the benchmark: the words of each window, parted by spaces."""
    w = benchmark.select(F.col(item).alias("item"), words(text).alias("w")).where(F.size("w") > 0).withColumn("n", F.least(F.lit(n), F.size("w")))
    at = w.select("item", "n", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("i"))
    return at.select("item", "n", F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("window")).distinct()


def _grams(h: Column, n: int) -> Column:
    """A hash for each window of n word hashes."""
    return F.transform(_places(F.size(h), n), lambda i: F.xxhash64(F.slice(h, i + 1, F.lit(n))))


def hits(docs: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (k, i, n, window): where a benchmark window begins in the text of digest k, by verified words."""
    distinct = cut(windows.select("n", "window").distinct())
    lengths = sorted(r["n"] for r in distinct.select("n").distinct().collect())  # N at most
    known = small(cut(distinct.select(F.xxhash64(F.transform(F.split("window", " "), lambda w: F.xxhash64(w))).alias("gram")).distinct()))
    grams = lambda h: F.array(*(F.struct(F.lit(n).alias("n"), _grams(h, n).alias("grams")) for n in lengths))
    none = F.array().cast("array<struct<n:int,grams:array<bigint>>>")
    scanned = docs.select(digest(text).alias("k"), F.explode(_bound(F.transform(words(text), lambda w: F.xxhash64(w)), grams) if lengths else none).alias("x"))
    scanned = scanned.select("k", F.col("x.n").alias("n"), F.posexplode("x.grams").alias("i", "gram"))
    found = scanned.join(known, "gram").select("k", "n", "i").distinct()
    of_text = cut(found.groupBy("k").agg(F.collect_list(F.struct("i", "n")).alias("at")))
    texts = docs.select(digest(text).alias("k"), F.col(text).alias("text")).join(small(of_text.select("k")), "k", "left_semi").groupBy("k").agg(F.first("text").alias("text"))
    read = texts.join(of_text, "k").select("k", F.explode(_bound(words("text"), lambda w: F.transform("at", lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n"), F.array_join(F.slice(w, x["i"] + 1, x["n"]), " ").alias("window"))))).alias("x"))
    return read.select("k", "x.*").join(small(distinct, BROADCAST_TEXTS), ["n", "window"]).select("k", "i", "n", "window")


def spans(found: DataFrame) -> DataFrame:
    """(k, begin, end): the hit words of each text, stretches that touch or overlap merged."""
    order = Window.partitionBy("k").orderBy("i", "n")  # a window holds the hits of one text
    ends = found.select("k", "i", "n").distinct().withColumn("reach", F.max(F.col("i") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    islands = ends.withColumn("island", F.count_if(F.coalesce(F.col("i") > F.col("reach"), F.lit(True))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("k", "island").agg(F.min("i").alias("begin"), F.max(F.col("i") + F.col("n")).alias("end")).drop("island")


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (key, n_words, n_hit, n_items, items_sha256, contaminated), one for each row of docs."""
    windows = cut(item_windows(benchmark, n, item, item_text))
    found = cut(hits(docs, windows, text))
    of_items = found.select("k", "window", "n").distinct().join(small(windows, BROADCAST_TEXTS), ["window", "n"]).where("item is not null").select("k", F.col("item").cast("string").alias("item")).distinct()
    listed = of_items.groupBy("k").agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    sums = spans(found).groupBy("k").agg(F.sum(F.col("end") - F.col("begin")).alias("n_hit"))
    result = small(cut(sums.join(listed, "k", "left").select("k", "n_hit", "n_items", F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"))), BROADCAST_TEXTS)
    rows = docs.select(F.col(key).alias("id"), digest(text).alias("k"), F.size(words(text)).cast("long").alias("n_words")).join(result, "k", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select(
        F.col("id").alias(key), "n_words", hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (hit > 0).alias("contaminated")
    )


def _with_spans(docs: DataFrame, benchmark: DataFrame, n: int, text: str) -> tuple[DataFrame, str]:
    """docs with the sorted spans of each text in a further column (null: none), and its name."""
    names = docs.columns
    k, at = fresh("_k", names), fresh("_spans", names)
    of_text = spans(cut(hits(docs, cut(item_windows(benchmark, n)), text))).groupBy(F.col("k").alias(k)).agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias(at))
    return docs.withColumn(k, digest(text)).join(of_text, k, "left").drop(k), at


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = N, text: str = "text") -> DataFrame:
    """The rows of docs that hold no window of the benchmark."""
    rows, at = _with_spans(docs, benchmark, n, text)
    return rows.where(F.col(at).isNull()).drop(at)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N, text: str = "text") -> DataFrame:
    """docs without the hit words and what stands before each of them; a text without a hit stays as it is."""
    rows, at = _with_spans(docs, benchmark, n, text)

    def rest(pieces: Column) -> Column:
        froms = F.concat(F.array(F.lit(0)), F.transform(at, lambda s: s["end"]))
        sizes = F.zip_with(froms, F.concat(F.transform(at, lambda s: s["begin"]), F.array(F.size(pieces))), lambda a, b: b - a)
        kept = F.zip_with(froms, sizes, lambda a, n: F.array_join(F.slice(pieces, a + 1, n), ""))
        return F.concat(F.array_join(kept, ""), F.substring(F.col(text), F.length(F.array_join(pieces, "")) + 1, F.lit(2**31 - 1)))

    return rows.withColumn(text, F.when(F.col(at).isNull(), F.col(text)).otherwise(_bound(F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0)), rest))).select(*docs.columns)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = rf"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') as w from benchmark),
g as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as g
  from (select item_id, w, least({N}, len(w)) as n, unnest(range(1, greatest(len(w) - {N}, 0) + 2)) as i from b where len(w) > 0)),
s as (select r, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from d join (select distinct n from g) on len(w) >= n)),
h as (select distinct r, i, n, item_id from s join g using (n, g)),
c as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + n)) as p from h) group by r),
t as (select r, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct r, item_id::varchar as item from h where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, coalesce(items_sha256, sha256('')) as items_sha256, n_hit is not null as contaminated
from d left join c using (r) left join t using (r)
"""
