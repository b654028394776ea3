"""License scans (DataFrame operations only).

Words are ``[a-z0-9]`` and everything beyond ASCII of the lower-cased text.  Documents are cut into overlapping
windows of ``WINDOW`` words, one every ``STRIDE`` words, so that any run of WINDOW - STRIDE + 1 words lies inside a
window; templates are cut into a window at every word (one shorter window, if they are shorter).  A window's MinHash
has ``BANDS`` values (bands of one row): the least of its 3-word shingles under BANDS hashes.  A document window
that lies inside a copied template equals a template window and collides for sure; one that holds a whole template
of four words (two of its six shingles) is missed with probability (1 - 1/3)^32 < 3e-6, one of five words with 2^-32.
Equal MinHash values mean a common shingle, so windows without a shingle in a fixed bitmap of the templates' shingles
cannot collide; they are passed over before any MinHash is computed.

Verification: the share of the template's distinct 3-word shingles that the document holds has to reach the template's
``contained`` (of the call, unless the table of templates has such a column).  The document's shingles that pass the bitmap hold all
that it shares with any template, so these few are kept in the first pass and neither texts nor words are moved.  Of templates of
one ``family`` (a column too; their own names, if there is none) those of the highest share stay, ties all.

The index of template windows and the templates' shingles are broadcast up to ``INDEX_ROWS`` rows (a frequent notice in a third of
all documents then meets them where it is); larger catalogues are joined by shuffles, which AQE splits.

Edge cases: null and short texts (fewer than three words) have no shingles and match nothing; repeated rows each get
their row; templates of fewer than three words or null text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hourwise.llm.common import lower_ascii, row_key, staged
from hourwise.llm.license_texts import CATALOGUE

WINDOW, STRIDE, BANDS, SHINGLE = 8, 4, 32, 3
BITMAP_WORDS = 1 << 14
#: Rows of template windows that are broadcast at most, 24 bytes each.
INDEX_ROWS = 1 << 20


def words(text: Column) -> Column:
    """Array of words; empty for null texts and texts without words."""
    t = F.trim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(F.length(t) > 0, F.split(t, " ")).otherwise(F.array().cast("array<string>"))


def _hashes(ws: Column) -> Column:
    """Hash of the shingle at each word; empty for fewer than SHINGLE words."""

    def of(w: Column) -> Column:
        n = F.size(w) - (SHINGLE - 1)
        return F.when(
            n > 0,
            F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)])),
        ).otherwise(F.array().cast("array<bigint>"))

    # the one-element array binds the words, so that they are split once for a document
    return F.transform(F.array(ws), of)[0]


def _sketches(hashes: Column, stride: int, seen=None) -> Column:
    """Struct of known and found: found are the MinHash values (at, band, value) of every window; with ``seen`` only of windows with a
    shingle that it passes, and known are those shingles."""
    per = WINDOW - SHINGLE + 1

    def window(h: Column, at: Column) -> Column:
        return F.transform(F.array(F.slice(h, at + 1, per)), lambda part: F.transform(
            F.sequence(F.lit(0), F.lit(BANDS - 1)),
            lambda b: F.struct(at.alias("at"), b.alias("band"), F.array_min(F.transform(part, lambda x: F.xxhash64(x, b))).alias("value")),
        ))[0]

    def last(h: Column) -> Column:
        return F.greatest(F.lit(0), F.size(h) - per + (stride - 1))

    def covering(h: Column, hits: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(hits, lambda p: F.filter(
            F.transform(F.sequence(F.lit(0), F.lit((per - 1) // stride)), lambda k: p - F.pmod(p, F.lit(stride)) - k * stride),
            lambda at: (at >= 0) & (at <= last(h)) & (p - at < per),
        ))))

    def every(h: Column) -> Column:
        starts = F.sequence(F.lit(0), last(h), F.lit(stride))
        return F.struct(h.alias("known"), F.flatten(F.transform(starts, lambda at: window(h, at))).alias("found"))

    def passing(h: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: seen(F.get(h, i)))
        return F.transform(F.array(hits), lambda ps: F.struct(
            F.array_distinct(F.transform(ps, lambda p: F.get(h, p))).alias("known"),
            F.flatten(F.transform(covering(h, ps), lambda at: window(h, at))).alias("found"),
        ))[0]

    # so are the hashes and the hits
    return F.transform(F.array(hashes), lambda h: F.when(F.size(h) > 0, every(h) if seen is None else passing(h)))[0]


def _slot(x: Column) -> tuple[Column, Column]:
    """Word and bit of a shingle hash in the bitmap."""
    return F.pmod(x, F.lit(BITMAP_WORDS)).cast("int"), F.pmod(F.shiftright(x, 20), F.lit(64)).cast("int")


def catalogue(spark: SparkSession) -> DataFrame:
    """The templates of the registered query: license, text, contained, family."""
    return spark.createDataFrame(CATALOGUE, "license string, text string, contained double, family string")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= INDEX_ROWS else df


def license_matches(docs: DataFrame, templates: DataFrame, contained: float = 0.8) -> DataFrame:
    """(rk, license, containment, at) of every verified match: containment and first window of each license in each document
    row key.  ``templates``: license, text, and, if wanted, contained and family."""
    least = F.coalesce("contained", F.lit(contained)) if "contained" in templates.columns else F.lit(contained)
    family = F.coalesce("family", "license") if "family" in templates.columns else F.col("license")
    tpl = templates.select("license", words(F.col("text")).alias("ws"), least.alias("least"), family.alias("family")).where(F.size("ws") >= SHINGLE)
    index = staged(
        tpl.select("license", F.explode_outer(_sketches(_hashes(F.col("ws")), 1)["found"]).alias("x"))
        .where("x is not null").select("license", "x.band", "x.value").distinct()
    )
    word, bit = _slot(F.col("h"))
    shingles = tpl.select(F.explode(_hashes(F.col("ws"))).alias("h"))
    marks = shingles.select(word.alias("word"), F.expr("1L").alias("one"), bit.alias("bit")).groupBy("word").agg(
        F.bit_or(F.call_function("shiftleft", F.col("one"), F.col("bit"))).alias("bits")
    )
    # at most BITMAP_WORDS longs, whatever the templates
    bitmap = marks.agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m")).select(
        F.transform(F.sequence(F.lit(0), F.lit(BITMAP_WORDS - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("bitmap")
    ).first()["bitmap"]
    bitmap = bitmap or [0] * BITMAP_WORDS
    bits = F.from_json(F.lit("[" + ",".join(map(str, bitmap)) + "]"), "array<bigint>")

    def seen(h: Column) -> Column:
        w, b = _slot(h)
        return F.getbit(F.get(bits, w), b) == 1

    keyed = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("rk"), _sketches(_hashes(words(F.col("text"))), STRIDE, seen).alias("s"))
    # written before the filter, which would compute the sketches once more below the projection
    hit = staged(keyed).where(F.size("s.found") > 0).select("rk", "s.known", "s.found")
    # a repeated row gives its windows once a copy; they are one row a license after the tasks' own aggregates
    found = (
        hit.select("rk", F.explode("found").alias("x")).select("rk", "x.at", "x.band", "x.value")
        .join(_small(index), ["band", "value"]).groupBy("rk", "license").agg(F.min("at").alias("at"))
    )
    known = hit.groupBy("rk").agg(F.first("known").alias("known"))  # equal in all copies
    terms = tpl.groupBy("license").agg(
        F.array_distinct(F.flatten(F.collect_list(_hashes(F.col("ws"))))).alias("ts"), F.max("least").alias("least"), F.min("family").alias("family")
    )
    share = F.size(F.array_intersect("known", "ts")) / F.size("ts")
    verified = found.join(known, "rk").join(_small(staged(terms)), "license").withColumn("containment", share).where(F.col("containment") >= F.col("least"))
    best = F.max("containment").over(Window.partitionBy("rk", "family"))  # no more rows than there are licenses
    return verified.withColumn("best", best).where("containment = best").select("rk", "license", "containment", "at")


def scan(docs: DataFrame, templates: DataFrame, contained: float = 0.8) -> DataFrame:
    """Per row of ``docs``: doc_id, n_licenses, licenses (names, sorted, comma-joined)."""
    m = license_matches(docs, templates, contained).groupBy("rk").agg(
        F.array_sort(F.collect_set("license")).alias("names")  # no more than there are templates
    )
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("rk"))
    return d.join(m, "rk", "left").select(
        "doc_id", F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce(F.concat_ws(",", "names"), F.lit("")).alias("licenses"),
    )
