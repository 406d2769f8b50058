"""Document fingerprints by Order MinHash, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gradus.llm.common import as_text, documents, written
from gradus.llm.quality import let, words_of

K = 5  # words of a k-mer
PICKS = 2  # k-mers of a tuple
TUPLES = 32
_PLACE_BITS = 24
_HASH_BITS = 39
_NONE = -(1 << 63)


def _numbered(kmers: Column) -> Column:
    """Hash and place of every k-mer; the second and later occurrence of one in a text get hashes of their own."""

    def one(h: Column, o: Column) -> Column:
        return F.when(o == 0, h).otherwise(F.xxhash64(h, o))

    def runs(rows: Column) -> Column:
        hash_at = lambda j: F.get(rows, j)["h"]
        places = F.sequence(F.lit(0), F.size(rows) - 1)
        begins = F.filter(places, lambda j: (j == 0) | (hash_at(j) != hash_at(j - 1)))

        def each(starts: Column) -> Column:
            def run(start: Column, r: Column) -> Column:
                n = F.coalesce(F.get(starts, r + 1), F.size(rows)) - start
                return F.transform(F.slice(rows, start + 1, n), lambda x, o: _packed(one(x["h"], o), x["i"]))

            return F.flatten(F.transform(starts, run))

        return let(begins, each)

    rows = F.array_sort(F.transform(kmers, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(
        F.size(F.array_distinct(kmers)) == F.size(kmers), F.transform(kmers, lambda h, i: _packed(h, i))
    ).otherwise(let(rows, runs))


def _packed(h: Column, place: Column) -> Column:
    """Leading hash bits over the place, so that sorting goes by hash; places past the last number share it."""
    low = F.least(place, F.lit((1 << _PLACE_BITS) - 1)).cast("bigint")
    return F.shiftleft(F.shiftrightunsigned(h, 64 - _HASH_BITS), _PLACE_BITS).bitwiseOR(low)


def _kmers(words: Column, k: int) -> Column:
    """Hashes of the k-mers of a text; fewer words than k make one, none make none."""
    return let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: F.when(F.size(h) >= k, F.transform(F.slice(h, 1, F.size(h) - (k - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, k)])))
        .when(F.size(h) > 0, F.array(F.xxhash64(h)))
        .otherwise(F.array().cast("array<bigint>")),
    )


def with_signature(df: DataFrame, text: str, name: str, k: int = K, picks: int = PICKS, tuples: int = TUPLES) -> DataFrame:
    """Adds ``name``: ``tuples`` numbers, each the hash of ``picks`` least k-mers in the order in which they stand in the text.

    K-mers are numbered by occurrence and hashed once. The orders that say which are least differ by where on the circle of
    hashes they begin, so one sort serves all. A text without a word has only zeros.
    """
    rest = [c for c in df.columns]
    marks = [(j << _HASH_BITS) // tuples << _PLACE_BITS for j in range(tuples)]
    df = df.select(*rest, words_of(F.col(text)).alias("_w")).select(*rest, _kmers(F.col("_w"), k).alias("_k"))
    df = df.select(*rest, F.sort_array(_numbered(F.col("_k"))).alias("_s"))
    df = df.select(*rest, "_s", F.sort_array(F.concat("_s", F.array(*[F.lit(m) for m in marks]))).alias("_m"))
    # how many k-mers come before each mark, and the sorted k-mers going round
    before = F.array(*[(F.array_position("_m", m) - (j + 1)).cast("int") for j, m in enumerate(marks)])
    round_ = F.concat("_s", *[F.slice("_s", 1, picks)] * picks)
    df = df.select(*rest, F.size("_s").alias("_n"), before.alias("_b"), round_.alias("_r"))
    place, head = F.lit((1 << _PLACE_BITS) - 1), lambda x: F.shiftright(x, _PLACE_BITS)

    def one(start: Column) -> Column:
        chosen = F.transform(F.slice("_r", start + 1, picks), lambda x: F.struct(x.bitwiseAND(place).alias("p"), head(x).alias("h")))
        return F.xxhash64(F.transform(F.array_sort(chosen), lambda x: x["h"])).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")

    signed = F.when(F.col("_n") > 0, F.transform("_b", one)).otherwise(F.array(*[F.lit(0)] * tuples))
    return df.select(*rest, signed.alias(name))


def likeness(a: str, b: str) -> Column:
    """Share of tuples that two signatures have in common."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda s: s)
    return F.size(same) / F.size(a)


def as_string(name: str) -> Column:
    return F.array_join(F.transform(name, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def following(keys: DataFrame) -> DataFrame:
    """``_o, _t, _no, _nt`` for distinct ``_o, _t``: the next in falling order of ``_o``, and after the last the first.

    Keys are cut to ranges; inside a range a window looks ahead, and the first keys of the ranges, one a range, close the gaps.
    """
    order = [F.desc("_o"), F.asc("_t")]
    ranged = written(keys.select("_o", "_t").repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range").orderBy(*order)
    ahead = ranged.select("_o", "_t", "_range", F.lead(F.struct("_o", "_t")).over(inside).alias("_next"))
    heads = ranged.groupBy("_range").agg(F.min_by(F.struct("_o", "_t"), F.struct((-F.col("_o")).alias("a"), "_t")).alias("_head"))
    ranges = Window.orderBy("_range")
    heads = heads.select("_range", F.coalesce(F.lead("_head").over(ranges), F.first("_head").over(ranges)).alias("_head"))
    joined = ahead.join(heads, "_range").withColumn("_next", F.coalesce("_next", "_head"))
    return joined.select("_o", "_t", F.col("_next._o").alias("_no"), F.col("_next._t").alias("_nt"))


def edited_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Signatures of every text and of its edited text, and their likeness to each other and to the next text's.

    The last half of a text (rounded down, in code points) is replaced by as many of the first of the next row's in falling
    order of the integer ``key``, or by all if that is shorter; the first row follows the last. Null texts are empty, null
    keys come last. Rows with equal keys follow each other by a hash of the text; equal rows count as one and share a result.
    """
    body = as_text(text)
    texts = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(_NONE + 1)).alias("_o"), F.xxhash64(body).alias("_t"), body.alias("_text"))
    keys = written(texts.select("_o", "_t", F.length("_text").alias("_n")).distinct())
    pairs = written(following(keys).join(keys, ["_o", "_t"]))
    wanted = pairs.select(F.col("_no").alias("_o"), F.col("_nt").alias("_t"), F.col("_o").alias("_yo"), F.col("_t").alias("_yt"), F.floor(F.col("_n") / 2).cast("int").alias("_half"))
    heads = texts.join(wanted, ["_o", "_t"]).select(
        F.col("_yo").alias("_o"), F.col("_yt").alias("_t"), F.substr("_text", F.lit(1), F.col("_half")).alias("_head")
    ).dropDuplicates(["_o", "_t"])
    n = F.length("_text")
    edited = texts.join(heads, ["_o", "_t"]).select(
        "_o", "_t", n.cast("bigint").alias("n_chars"), "_text",
        F.concat(F.substr("_text", F.lit(1), n - F.floor(n / 2).cast("int")), "_head").alias("_edited"),
    )
    edited = with_signature(with_signature(edited, "_text", "signature"), "_edited", "edited_signature")
    signed = written(edited.select("_o", "_t", "n_chars", F.sha2("_edited", 256).alias("edited_sha256"), "signature", "edited_signature"))
    nexts = pairs.select("_o", "_t", F.col("_no").alias("_xo"), F.col("_nt").alias("_xt"))
    others = signed.select(F.col("_o").alias("_xo"), F.col("_t").alias("_xt"), F.col("signature").alias("_other")).dropDuplicates(["_xo", "_xt"])
    out = signed.join(nexts.join(others, ["_xo", "_xt"]), ["_o", "_t"])
    return out.select(
        F.when(F.col("_o") > _NONE + 1, F.col("_o")).alias(key), "n_chars", "edited_sha256", "signature", "edited_signature",
        likeness("signature", "edited_signature").alias("near_edited"), likeness("signature", "_other").alias("near_next"),
    )


def op9_order_minhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, with their likeness."""
    out = edited_pairs(documents(spark, sf_dir))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", as_string("signature").alias("fingerprint"),
        as_string("edited_signature").alias("edited_fingerprint"), "near_edited", "near_next",
    )


QUERIES = {"op9_order_minhash": op9_order_minhash}
SQL: dict[str, str] = {}
