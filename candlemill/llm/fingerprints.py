"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A text's terms are its words, weighted by how often they occur. For each of SAMPLES hash functions every term draws
r, c ~ Gamma(2, 1) and b ~ U(0, 1), which depend on the term alone; with t = floor(ln w / r + b) its value is
ln a = ln c - r (t - b) - r, and the term of the least value, with its t, is the sample. Two texts agree in a sample with
the probability of their generalised Jaccard similarity, the sum of the lesser over the sum of the greater weights. A
sample is kept as 24 bits; texts without terms have zeros.

The least a of a text of W words is exponential with rate W, so it exceeds REACH / W with a chance of exp(-REACH), one
in 10^13; then the sample is zero. For a term that occurs once ln a = ln c - r (1 - b), and exp(-r) and exp(-c) are
products of two uniform draws. So a has a lower bound without logarithms, from 1 - exp(-c) <= c and from the harmonic
mean of exp(-r / 2) and 1; for other terms it is (1 - exp(-c)) exp(-r) over the weight. Only terms whose bound is
within reach are drawn in full: of a text of 400 words one in seven, of longer ones fewer.

Contract for odd input: a null text is an empty one; texts without words are alike (1) to each other and unlike (0) to
all others. Rows are ordered by descending id, nulls last, then by a hash of the text; a row that is repeated whole
follows its copy. An empty table gives an empty result, and a single row is its own next. Texts may be of any length.
Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlemill.llm.common import range_staged, stage_table

SAMPLES = 64
#: Where the search for a least value ends; what the numbers of second hashes are higher by.
REACH, SECOND = 30.0, 1 << 20
_SPACE, _MASK = r"[\x20\x09-\x0D]+", (1 << 24) - 1


def _uniform(bits: Column, shift: int) -> Column:
    """In (0, 1), from 32 bits at shift."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0xFFFFFFFF)).cast("double") + 0.5) * (1.0 / (1 << 32))


def _sample(log_weight: Column) -> Column:
    """Value and name of a term's sample in one long: ln a in the upper bits, so that the least long is the sample."""
    r, b = F.col("__r"), F.col("__b")
    t = F.when(log_weight == 0, F.lit(0).cast("long")).otherwise(F.floor(log_weight / r + b))  # b is below 1
    log_a = F.col("__c") - r * (t.cast("double") - b + 1.0)
    return F.shiftleft(((log_a + 128.0) * float(1 << 31)).cast("long"), 24).bitwiseOR(F.col("__name").bitwiseXOR(t).bitwiseAND(F.lit(_MASK)))


def signatures(texts: DataFrame, keys: list[str], versions: list[str], pieces: list[tuple[Column, list[int]]], samples: int = SAMPLES) -> DataFrame:
    """keys and, for each name in versions, array<int> name of samples; no row for a key without words.

    pieces: of a row of texts, pieces cut at white space and, for each version, 1 if the piece belongs to it, else 0. Two
    versions of a text share their pieces, and the draws of a term serve both.
    """
    cut = texts.select(*keys, *(F.split(p, _SPACE).alias(f"__p{i}") for i, (p, _) in enumerate(pieces)))
    n = [sum((F.size(f"__p{i}") * of[j] for i, (_, of) in enumerate(pieces)), F.lit(0)).alias(f"__n_{v}") for j, v in enumerate(versions)]
    sizes = [f"__n_{v}" for v in versions]
    each = F.array(*(F.struct(F.col(f"__p{i}").alias("p"), *(F.lit(x).alias(v) for x, v in zip(of, versions, strict=True))) for i, (_, of) in enumerate(pieces)))
    parts = cut.select(*keys, *n, F.explode(each).alias("__part"))
    words = parts.select(*keys, *sizes, *(F.col(f"__part.{v}").alias(v) for v in versions), F.explode("__part.p").alias("__word")).where("__word != ''")
    counted = words.select(*keys, *sizes, F.xxhash64("__word").alias("__h"), *versions).groupBy(*keys, *sizes, "__h").agg(*(F.sum(v).alias(v) for v in versions))
    once = F.greatest(F.lit(1), *(F.col(v) for v in versions)) == 1
    reach = F.greatest(F.lit(0.0), *(F.col(v) * (F.lit(REACH) / F.col(f"__n_{v}")) for v in versions))
    logs = counted.select(*keys, "__h", reach.alias("__reach"), once.alias("__once"), *(F.log(F.when(F.col(v) > 0, F.col(v)).cast("double")).alias(v) for v in versions))
    drawn = logs.select("*", F.explode(F.array(*(F.lit(k) for k in range(samples)))).alias("__k"))
    hashes = [F.xxhash64("__h", F.col("__k") + i * SECOND).alias(n) for i, n in enumerate(("__one", "__two", "__three"))]
    bits = drawn.select(*keys, *versions, "__k", "__reach", "__once", *hashes)
    uniform = bits.select(*keys, *versions, "__k", "__reach", "__once", "__three", (_uniform(F.col("__one"), 0) * _uniform(F.col("__one"), 32)).alias("__ur"), (_uniform(F.col("__two"), 0) * _uniform(F.col("__two"), 32)).alias("__uc"), _uniform(F.col("__three"), 32).alias("__b"))
    rooted = uniform.select("*", F.sqrt("__ur").alias("__root"), F.when(F.col("__b") > 0.5, F.lit(2.0)).otherwise(F.lit(1.0)).alias("__half"))
    # ur ^ (1 - b) is root ^ part, or root times it where b is below a half; part is in (0, 1).
    part, root = F.col("__half") - 2.0 * F.col("__b"), F.col("__root")
    power = F.when(F.col("__half") == 2.0, root).otherwise(F.col("__ur")) / (part + (1.0 - part) * root)
    bound = (1.0 - F.col("__uc")) * F.when(F.col("__once"), power).otherwise(F.col("__ur"))
    # As a generator and no filter: a filter would be pushed below the columns it reads and work out each hash many times.
    within = rooted.select("*", F.explode(F.when(bound <= F.col("__reach"), F.array(F.lit(True)))).alias("__within"))
    named = within.select(*keys, *versions, "__k", "__b", (-F.log("__ur")).alias("__r"), F.log(-F.log("__uc")).alias("__c"), F.col("__three").bitwiseAND(F.lit(_MASK)).alias("__name"))
    least = named.select(*keys, "__k", *(_sample(F.col(v)).alias(v) for v in versions)).groupBy(*keys, "__k").agg(*(F.min(v).alias(v) for v in versions))
    kept = least.select(*keys, F.struct("__k", *(F.coalesce(F.col(v), F.lit(0)).bitwiseAND(F.lit(_MASK)).cast("int").alias(v) for v in versions)).alias("__s"))
    found = kept.groupBy(*keys).agg(F.sort_array(F.collect_list("__s")).alias("__s"))
    whole = F.when(F.size("__s") == samples, F.col("__s")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: F.filter("__s", lambda s: s["__k"] == k)[0]))
    return found.select(*keys, whole.alias("__s")).select(*keys, *(F.transform(F.col(f"__s.{v}"), lambda x: F.coalesce(x, F.lit(0))).alias(v) for v in versions))


def likeness(a: Column, b: Column) -> Column:
    """The share of samples that agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def as_text(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 6, "0")), "")


def packed_likeness(a: Column, b: Column, samples: int) -> Column:
    """likeness of fingerprints that are packed as the three bytes of each sample."""
    same = F.filter(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: F.substring(a, i * 3 + 1, F.lit(3)) == F.substring(b, i * 3 + 1, F.lit(3)))
    return F.size(same) / F.lit(samples)


def _ring(texts: DataFrame) -> DataFrame:
    """(id, th, known, again, copies, n, n_id, n_th): for each distinct row its next one in descending order, the first after the
    last. A row with copies comes a second time, again = 1, for those copies that are followed by another."""
    distinct = texts.groupBy("id", "none", "th").agg(F.count("*").alias("copies"), F.min(F.length("text")).alias("n"))
    staged = range_staged(distinct.withColumn("known", 1 - F.col("none")), "print-order", "known", "id", "th")
    place = Window.partitionBy("__pid").orderBy("known", "id", "th")
    last = staged.groupBy("__pid").agg(F.max(F.struct("known", "id", "th")).alias("last"))  # a row for each range
    before = last.select(F.col("__pid").alias("p"), F.lag("last").over(Window.orderBy("__pid")).alias("up"), F.max("last").over(Window.partitionBy(F.lit(0))).alias("top"))
    own = staged.withColumn("down", F.lag(F.struct("known", "id", "th")).over(place)).join(before, F.col("__pid") == F.col("p"))
    own = own.withColumn("next", F.coalesce("down", "up", "top"))
    ring = own.select("id", "th", "known", F.lit(0).alias("again"), F.lit(1).cast("long").alias("copies"), "n", F.col("next.id").alias("n_id"), F.col("next.th").alias("n_th"))
    more = staged.where("copies > 1").select("id", "th", "known", F.lit(1).alias("again"), F.col("copies") - 1, "n", F.col("id").alias("n_id"), F.col("th").alias("n_th"))
    return stage_table(ring.unionByName(more.toDF(*ring.columns)), "print-ring")


def fingerprint_documents(docs: DataFrame, *, samples: int = SAMPLES) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the row's with its last third replaced by the beginning of the next row's.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    none = F.col("doc_id").isNull().cast("int")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), none.alias("none"), F.xxhash64(text, none).alias("th"), text.alias("text"))
    ring = _ring(texts)
    once = texts.dropDuplicates(["id", "th"])
    own = once.join(ring.drop("n_id", "n_th"), ["id", "th"])
    heads = once.select(F.col("id").alias("n_id"), F.col("th").alias("n_th"), F.col("text").alias("n_text")).join(ring, ["n_id", "n_th"])
    heads = heads.select(F.col("id").alias("h_id"), F.col("th").alias("h_th"), F.col("again").alias("h_again"), F.substring("n_text", F.lit(1), F.floor(F.col("n") / 3).cast("int")).alias("head"))
    # again is compared as a difference, so that it is no key: the texts stay where their id and hash have put them.
    both = own.join(heads, (F.col("id") == F.col("h_id")) & (F.col("th") == F.col("h_th")) & (F.col("again") - F.col("h_again") == 0))
    kept = F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 3)).cast("int"))
    both = both.select("id", "th", "again", "text", kept.alias("kept"), "head")
    common = F.regexp_extract("kept", r"(?s)^(.*[\x20\x09-\x0D])", 1)
    cut = both.select("id", "th", "again", "text", "kept", "head", common.alias("common"))
    tail = lambda x: F.substring(x, F.length("common") + 1, F.length(x))
    pieces = [(F.col("common"), [1, 1]), (tail(F.col("text")), [1, 0]), (tail(F.concat("kept", "head")), [0, 1])]
    hashes = both.select("id", "th", "again", F.sha2(F.concat("kept", "head").cast("binary"), 256).alias("edited_sha256"))
    none = F.array_repeat(F.lit(0), samples)
    # One query for both, so that they share the exchanges of the texts.
    found = hashes.join(signatures(cut, ["id", "th", "again"], ["own", "edited"], pieces, samples), ["id", "th", "again"], "left")
    found = found.select("id", "th", "again", "edited_sha256", F.coalesce("own", none).alias("own"), F.coalesce("edited", none).alias("edited"))
    packed = [F.unhex(as_text(F.col(c))).alias(c) for c in ("own", "edited")]
    prints = stage_table(found.select("id", "th", "again", F.unhex("edited_sha256").alias("sha"), *packed, likeness(F.col("own"), F.col("edited")).alias("near_edited")), "print-samples")

    # What comes next goes to its row, so that a row's own results move once.
    following = prints.where("again = 0").select(F.col("id").alias("n_id"), F.col("th").alias("n_th"), F.col("own").alias("n_own"))
    out = ring.join(following, ["n_id", "n_th"]).join(prints, ["id", "th", "again"])
    hexed = lambda c: F.lower(F.hex(c))
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(
        F.when(F.col("known") == 1, F.col("id")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), hexed("sha").alias("edited_sha256"),
        hexed("own").alias("fingerprint"), hexed("edited").alias("edited_fingerprint"),
        "near_edited", packed_likeness(F.col("own"), F.col("n_own"), samples).alias("near_next"),
    )
